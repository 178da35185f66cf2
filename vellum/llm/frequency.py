"""Problem 3: occurrences and record counts of every distinct term, by a range-partitioned sort and a run-length scan.

Pairs of term and record are range-partitioned on both, so that a term on every record is spread over many ranges while each
pair stays in one. Each sorted range is scanned once; the few partial counts of a term are added up.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.functions.cut import cut
from vellum.functions.pages import KEY, unlist
from vellum.operators.tokens import page_lemmas, token_dim


def _page_counts(batches):
    """(kind, term, page, n): the distinct lemmas (kind 0) and roots (kind 1) of each page."""
    for batch in batches:
        page = np.asarray(batch.column("page"), np.int64)
        for kind, column in enumerate(("lemma_ids", "root_ids")):
            flat, at = unlist(batch.column(column))
            rows = np.repeat(np.arange(len(page)), np.diff(at))
            rows, flat = rows[flat != 0], flat[flat != 0]
            terms, code = np.unique(flat, return_inverse=True)
            pair, n = np.unique(code.astype(np.int64) * max(1, len(page)) + rows, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pair), kind, np.int32)), pa.array(terms[pair // max(1, len(page))], pa.int64()), pa.array(page[pair % max(1, len(page))], pa.int64()), pa.array(n.astype(np.int32))], names=["kind", "term_id", "page", "n"])


def _scan(batches):
    """Partial (kind, term, occurrences, pages) of one sorted range, by the lengths of its runs."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        kind, term, page, n = (np.asarray(batch.column(c), np.int64) for c in ("kind", "term_id", "page", "n"))
        new_term = np.ones(len(term), bool)
        new_term[1:] = (kind[1:] != kind[:-1]) | (term[1:] != term[:-1])
        new_pair = new_term.copy()
        new_pair[1:] |= page[1:] != page[:-1]
        if (kind[0], term[0], page[0]) == last:
            new_pair[0] = False  # the batch goes on within a record
        last = (kind[-1], term[-1], page[-1])
        start = np.nonzero(new_term)[0]
        yield pa.RecordBatch.from_arrays([pa.array(kind[start].astype(np.int32)), pa.array(term[start]), pa.array(np.add.reduceat(n, start)), pa.array(np.add.reduceat(new_pair.astype(np.int64), start))], names=["kind", "term_id", "occurrences", "pages"])


def term_counts(page_tokens: DataFrame, definitions: DataFrame) -> DataFrame:
    """(kind, term_id, occurrences, pages) of every lemma and root that occurs; kind is 'lemma' or 'root'.

    Each page counts once, however often it is repeated. Null and 0 are no terms. Pages without tokens and tokens without a
    definition add nothing; empty tables give no rows.
    """
    pages = page_lemmas(page_tokens, token_dim(definitions)).withColumn("page", F.monotonically_increasing_id())
    # stored, for range partitioning reads its input twice
    pairs = cut(pages.select("page", "lemma_ids", "root_ids").mapInArrow(_page_counts, "kind int, term_id bigint, page bigint, n int"))
    order = ["kind", "term_id", "page"]
    partial = pairs.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_scan, "kind int, term_id bigint, occurrences bigint, pages bigint")
    total = partial.groupBy("kind", "term_id").agg(F.sum("occurrences").alias("occurrences"), F.sum("pages").alias("pages"))
    return total.select(F.when(F.col("kind") == 0, "lemma").otherwise("root").alias("kind"), "term_id", "occurrences", "pages")


def marked_terms(page_tokens: DataFrame, definitions: DataFrame, rare: int = 2, common: float = 0.3) -> DataFrame:
    """Every lemma and root of ``definitions`` with its counts and a ``mark``: 'rare' (occurs, but at most ``rare`` times),
    'common' (on more than the share ``common`` of all pages, pages without tokens included), 'unseen' (never occurs) or null.
    """
    pages = page_tokens.select(*KEY).distinct().count()
    known = definitions.select(F.explode(F.array(F.struct(F.lit("lemma").alias("kind"), F.col("lemma_id").alias("term_id")), F.struct(F.lit("root").alias("kind"), F.col("root_id").alias("term_id")))).alias("t")).select("t.*").filter("term_id <> 0").distinct()
    out = known.join(term_counts(page_tokens, definitions), ["kind", "term_id"], "left").fillna(0, ["occurrences", "pages"])
    # the share is compared in whole numbers, so that a page count on the border is exact
    bound = F.col("pages") * 1000 > F.lit(pages) * round(common * 1000)
    return out.withColumn("mark", F.when(F.col("occurrences") == 0, "unseen").when(F.col("occurrences") <= rare, "rare").when(bound, "common"))
