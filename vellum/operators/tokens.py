"""From packed pages to tokens, lemmas and roots."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.functions.cut import BROADCAST_BYTES
from vellum.functions.pages import KEY, one_row_per_page, unpack
from vellum.operators.positions import page_ranges, page_sizes

PAGE_KEY = "book_id bigint, part_index bigint, page_id bigint"


def token_dim(definitions: DataFrame) -> DataFrame:
    """(token_id, surface, lemma_id, root_id) of each defined token once; a null root is 0."""
    return definitions.filter("id is not null").select(F.col("id").alias("token_id"), "surface", "lemma_id", F.coalesce("root_id", F.lit(0)).cast("bigint").alias("root_id")).dropDuplicates(["token_id"])


def bad_pages(page_tokens: DataFrame) -> DataFrame:
    """Keys of pages whose blob is not a multiple of 4 bytes."""
    return page_tokens.filter("octet_length(token_ids) % 4 <> 0").select(*KEY).distinct()


def _unpacked(batches):
    for batch in batches:
        flat, at = unpack(batch.column("token_ids"))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in KEY), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(flat.astype(np.int64)))], names=[*KEY, "token_ids"])


def decoded_pages(page_tokens: DataFrame) -> DataFrame:
    """(page key, token_ids array<bigint>) of each page once; a null, empty or broken blob gives []."""
    return one_row_per_page(page_tokens, "token_ids").mapInArrow(_unpacked, f"{PAGE_KEY}, token_ids array<bigint>")


def _mapped(ids: np.ndarray, lemma: np.ndarray, root: np.ndarray):
    """Pages to lemma and root arrays by lookup in sorted ids; an unknown id maps to 0."""

    def run(batches):
        for batch in batches:
            flat, at = unpack(batch.column("token_ids"))
            flat = flat.astype(np.int64)
            k = np.minimum(np.searchsorted(ids, flat), max(0, len(ids) - 1))
            known = ids[k] == flat if len(ids) else np.zeros(len(flat), bool)
            offsets = pa.array(at.astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(np.where(known, v[k], 0) if len(ids) else np.zeros(len(flat), np.int64))) for v in (lemma, root)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in KEY), *lists], names=[*KEY, "lemma_ids", "root_ids"])

    return run


def page_lemmas(page_tokens: DataFrame, dim: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """(page key, lemma_ids, root_ids) of each page once; a token without a definition has lemma 0 and root 0.

    The dictionary goes to the tasks as three arrays if its counted rows fit ``limit`` bytes (24 a row); a larger one is joined.
    """
    pages = one_row_per_page(page_tokens, "token_ids")
    known = dim.filter("lemma_id is not null or root_id is not null").select("token_id", F.coalesce("lemma_id", F.lit(0)).alias("lemma_id"), "root_id")
    schema = f"{PAGE_KEY}, lemma_ids array<bigint>, root_ids array<bigint>"
    if known.count() * 24 <= limit:
        t = known.orderBy("token_id").toArrow()
        return pages.mapInArrow(_mapped(*(np.asarray(t.column(c), np.int64) for c in ("token_id", "lemma_id", "root_id"))), schema)
    tokens = pages.mapInArrow(_unpacked, f"{PAGE_KEY}, token_ids array<bigint>").select(*KEY, F.posexplode_outer("token_ids").alias("at", "token_id"))
    met = tokens.join(known, "token_id", "left").groupBy(*KEY).agg(F.array_sort(F.collect_list(F.when(F.col("at").isNotNull(), F.struct("at", F.coalesce("lemma_id", F.lit(0)).alias("l"), F.coalesce("root_id", F.lit(0)).alias("r"))))).alias("t"))
    return met.select(*KEY, F.col("t.l").alias("lemma_ids"), F.col("t.r").alias("root_ids"))


def token_stream(page_tokens: DataFrame, dim: DataFrame) -> DataFrame:
    """One row per token: (book_id, pos, part_index, page_id, page_off, token_id, surface, lemma_id, root_id), ``pos`` counting
    over the book from 0. Tokens without a definition keep their place with surface '', lemma 0 and root 0."""
    start = page_ranges(page_sizes(page_tokens)).select(*(F.col(k).alias(f"r_{k}") for k in KEY), "page_start")
    pages = decoded_pages(page_tokens)
    placed = pages.join(start, [F.col(k) == F.col(f"r_{k}") for k in KEY])
    tokens = placed.select(*KEY, "page_start", F.posexplode("token_ids").alias("page_off", "token_id"))
    out = tokens.join(dim, "token_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return out.select("book_id", (F.col("page_start") + F.col("page_off")).alias("pos"), "part_index", "page_id", F.col("page_off").cast("bigint").alias("page_off"), "token_id", F.coalesce("surface", F.lit("")).alias("surface"), zero("lemma_id"), zero("root_id"))


def lemma_stream(page_tokens: DataFrame, dim: DataFrame) -> DataFrame:
    """One row per token as the lemma-only reader has it: ids above the largest defined id are dropped before positions are
    counted; holes below it keep lemma 0. Columns (book_id, pos, lemma_id)."""
    top = dim.agg(F.max("token_id")).first()[0]
    if top is None:
        top = -1
    pages = decoded_pages(page_tokens).withColumn("token_ids", F.filter("token_ids", lambda x: x <= top)).withColumn("n", F.size("token_ids").cast("bigint"))
    start = page_ranges(pages.select(*KEY, "n")).select(*(F.col(k).alias(f"r_{k}") for k in KEY), "page_start")
    tokens = pages.join(start, [F.col(k) == F.col(f"r_{k}") for k in KEY]).select("book_id", "page_start", F.posexplode("token_ids").alias("off", "token_id"))
    return tokens.join(dim.select("token_id", "lemma_id"), "token_id", "left").select("book_id", (F.col("page_start") + F.col("off")).alias("pos"), F.coalesce("lemma_id", F.lit(0)).alias("lemma_id"))


#: Punctuation that is no part of a word's lemma.
PUNCTUATION = ".,;:!?()[]<>\"'"


def text_pages(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Texts as books of one page: (book_id, part_index, page_id, lemma_ids, root_ids).

    A token is what stands between blanks, tabs and line ends; its lemma is the token without punctuation at any place (the
    token itself if nothing else is left), its root the lemma's first three characters, none (0) below three. Ids are 64-bit
    hashes. Null texts are no books; a text without tokens has no windows.
    """
    words = F.filter(F.split(F.col(text), "[ \t\n\r\f]+"), lambda x: x != "")
    bare = F.transform(words, lambda x: F.translate(x, PUNCTUATION, ""))
    lemmas = F.zip_with(words, bare, lambda w, b: F.when(b == "", w).otherwise(b))
    root = lambda x: F.when(F.char_length(x) >= 3, F.xxhash64(F.substring(x, 1, 3))).otherwise(F.lit(0).cast("bigint"))
    t = texts.filter(F.col(text).isNotNull()).select(F.col(key).cast("bigint").alias("book_id"), F.lit(1).cast("bigint").alias("part_index"), F.lit(1).cast("bigint").alias("page_id"), lemmas.alias("x"))
    return t.select("book_id", "part_index", "page_id", F.transform("x", lambda x: F.xxhash64(x)).alias("lemma_ids"), F.transform("x", root).alias("root_ids"))
