"""Statistics of a corpus and of its books."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.errors import BookNotFound
from vellum.functions.pages import KEY
from vellum.functions.text import page_label
from vellum.operators.positions import page_sizes


def corpus_stats(page_tokens: DataFrame, definitions: DataFrame, lemmas: DataFrame | None = None) -> DataFrame:
    """One row: books, pages, tokens, lemmas, roots and token definitions. Repeated rows count once; roots are the distinct
    roots of the definitions other than 0; without a table of lemmas so are lemmas."""
    pages = page_sizes(page_tokens).agg(F.count_distinct("book_id").alias("book_count"), F.count("*").alias("page_count"), F.coalesce(F.sum("n"), F.lit(0)).alias("token_count"))
    defs = definitions.agg(F.count_distinct("id").alias("definition_count"), F.count_distinct(F.when(F.col("root_id") != 0, F.col("root_id"))).alias("root_count"), F.count_distinct(F.when(F.col("lemma_id") != 0, F.col("lemma_id"))).alias("own"))
    if lemmas is not None:
        defs = defs.join(lemmas.agg(F.count_distinct("id").alias("lemma_count")), F.lit(True))
    else:
        defs = defs.withColumnRenamed("own", "lemma_count")
    # one row each, so nothing is multiplied
    return pages.join(defs, F.lit(True)).select("book_count", "page_count", "token_count", "lemma_count", "root_count", "definition_count")


def book_info(page_tokens: DataFrame, page_lemmas: DataFrame) -> DataFrame:
    """(book_id, page_count, token_count, unique_lemmas, tokens_per_page) per book; lemma 0 counts as a lemma. ``page_lemmas``
    holds each page once."""
    pages = page_sizes(page_tokens).groupBy("book_id").agg(F.count("*").alias("page_count"), F.sum("n").alias("token_count"))
    unique = page_lemmas.select("book_id", F.explode("lemma_ids").alias("l")).groupBy("book_id").agg(F.count_distinct("l").alias("unique_lemmas"))
    return pages.join(unique, "book_id", "left").select("book_id", "page_count", "token_count", F.coalesce("unique_lemmas", F.lit(0)).alias("unique_lemmas"), (F.col("token_count") / F.col("page_count")).alias("tokens_per_page"))


def one_book_info(info: DataFrame, book_id: int) -> DataFrame:
    """The row of one book; BookNotFound if it has no page."""
    row = info.filter(F.col("book_id") == book_id)
    if row.isEmpty():
        raise BookNotFound(f"book {book_id} is not in the corpus")
    return row


def book_pages(page_tokens: DataFrame, pages: DataFrame) -> DataFrame:
    """(page key, token_count, label) of every page; the label is the page's number, else its part's label, else '-'."""
    labels = pages.select(*KEY, "page_number", "part_label").dropDuplicates(KEY)
    return page_sizes(page_tokens).join(labels, KEY, "left").select(*KEY, F.col("n").alias("token_count"), page_label(F.col("page_number"), F.col("part_label")).alias("label"))
