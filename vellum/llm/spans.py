"""Problem 4: long exact spans shared between records, by hashing every run of consecutive tokens and joining globally.

Hashing every run of 24 tokens and shuffling all of them would move many times the input. So it goes in two steps, both of
them exact. Every run contains 13 runs of 12; the smallest hash among them is the run's anchor, and equal runs have equal
anchors. First only anchors are counted (about one for seven tokens); then only runs whose anchor stands on several pages are
hashed, with 128 bits, and joined.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions.cut import cut, spread_join
from vellum.functions.pages import BASES, KEY, one_row_per_page, run_hashes, unpack

PAGE = "book_id bigint, part_index bigint, page_id bigint"


def anchors(flat: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every run inside a page: (its start in ``flat``, its page's row, its anchor)."""
    part = length // 2
    span = length - part + 1
    size = np.diff(at)
    row = np.repeat(np.arange(len(size)), size)
    left = np.repeat(at[1:], size) - np.arange(len(flat))
    start = np.nonzero(left >= length)[0]
    if not len(start):
        return start, row[:0], np.zeros(0, np.uint64)
    low, width = run_hashes(flat.astype(np.uint64), part, BASES[0]), 1
    while 2 * width <= span:
        low, width = np.minimum(low[: len(low) - width], low[width:]), 2 * width
    low = np.minimum(low[: len(low) - (span - width)], low[span - width :])
    return start, row[start], low[start]


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _anchor_rows(length: int):
    def run(batches):
        for batch in batches:
            flat, at = unpack(batch.column("token_ids"))
            _, row, low = anchors(flat, at, length)
            new = np.ones(len(row), bool)
            new[1:] = (row[1:] != row[:-1]) | (low[1:] != low[:-1])
            yield pa.RecordBatch.from_arrays([batch.column("page").take(pa.array(row[new])), _signed(low[new])], names=["page", "anchor"])

    return run


def _run_rows(length: int):
    def run(batches):
        for batch in batches:
            flat, at = unpack(batch.column("token_ids"))
            start, row, low = anchors(flat, at, length)
            shared = np.unique(np.asarray(batch.column("anchors").flatten(), np.int64).view(np.uint64))
            keep = np.isin(low, shared)
            start, row = start[keep], row[keep]
            a, b = (run_hashes(flat.astype(np.uint64), length, x)[start] for x in BASES) if len(start) else (low[:0], low[:0])
            yield pa.RecordBatch.from_arrays([batch.column("page").take(pa.array(row)), pa.array(start - at[row]), _signed(a), _signed(b)], names=["page", "pos", "ha", "hb"])

    return run


def numbered_pages(page_tokens: DataFrame) -> DataFrame:
    """(page, page key, token_ids) of each page once, stored; ``page`` numbers the pages in the order of their keys, nulls first,
    so that pages with a null in the key are told apart like any others."""
    once_each = one_row_per_page(page_tokens, "token_ids")
    return cut(once_each.repartitionByRange(*KEY).sortWithinPartitions(*KEY).withColumn("page", F.monotonically_increasing_id()))


def page_runs(pages: DataFrame, length: int = 24) -> DataFrame:
    """(page, pos, first) of numbered pages: every run of ``length`` tokens that stands on at least two pages; ``first`` marks the
    one that comes first in the order of page and position. An anchor or run on very many pages is joined in parts."""
    anchor = pages.select("page", "token_ids").mapInArrow(_anchor_rows(length), "page bigint, anchor bigint")
    several = lambda df, by, *more: df.groupBy(*by).agg(F.min("page").alias("lo"), F.max("page").alias("hi"), F.count("*").alias("n"), *more).filter("lo <> hi").drop("lo", "hi")
    hit = spread_join(anchor, several(anchor, ["anchor"]), ["anchor"], "left_semi").groupBy("page").agg(F.collect_set("anchor").alias("anchors"))
    runs = cut(pages.join(hit, "page").select("page", "token_ids", "anchors").mapInArrow(_run_rows(length), "page bigint, pos bigint, ha bigint, hb bigint"))
    group = several(runs, ["ha", "hb"], F.min(F.struct("page", "pos")).alias("at"))
    return spread_join(runs, group, ["ha", "hb"]).select("page", "pos", ((F.col("at.page") == F.col("page")) & (F.col("at.pos") == F.col("pos"))).alias("first"))


def page_stretches(runs: DataFrame, length: int = 24) -> DataFrame:
    """(page, span_start, span_end): the longest stretches of positions covered by runs. Touching runs are one stretch."""
    page = Window.partitionBy("page").orderBy("pos")
    broken = F.coalesce(F.col("pos") > F.lag("pos").over(page) + length, F.lit(True))
    isle = runs.select("page", "pos").distinct().withColumn("new", broken.cast("int")).withColumn("island", F.sum("new").over(page))
    return isle.groupBy("page", "island").agg(F.min("pos").alias("span_start"), (F.max("pos") + length).alias("span_end")).drop("island")


def shared_stretches(page_tokens: DataFrame, length: int = 24) -> DataFrame:
    """(page key, span_start, span_end): the longest stretches whose positions all lie in a run of ``length`` tokens that stands
    on another page as well.

    Repeated pages count once. Null, empty or broken blobs hold no runs; a run repeated within one page alone is not shared.
    """
    pages = numbered_pages(page_tokens)
    return page_stretches(page_runs(pages, length), length).join(pages.select("page", *KEY), "page").select(*KEY, "span_start", "span_end")


def shared_fraction(page_tokens: DataFrame, length: int = 24) -> DataFrame:
    """Per page: its tokens, those shared with another page, and those to remove if only the first of equal runs is to stay.

    Every page comes out; one without tokens or shared runs has zeros.
    """
    pages = numbered_pages(page_tokens)
    runs = cut(page_runs(pages, length))
    size = F.when(F.octet_length("token_ids") % 4 == 0, F.expr("octet_length(token_ids) div 4")).otherwise(0)
    out = pages.select("page", *KEY, F.coalesce(size, F.lit(0)).cast("bigint").alias("n_tokens"))
    for name, part in (("n_shared", runs), ("n_later", runs.filter("not first"))):
        out = out.join(page_stretches(part, length).groupBy("page").agg(F.sum(F.col("span_end") - F.col("span_start")).alias(name)), "page", "left")
    return out.drop("page").fillna(0, ["n_shared", "n_later"])


def _without(batches):
    for batch in batches:
        flat, at = unpack(batch.column("token_ids"))
        # +1 where a stretch begins and -1 behind its end: a token stays where the sum is 0
        edge = np.zeros(len(flat) + 1, np.int64)
        lists = batch.column("spans")
        row = np.repeat(np.arange(batch.num_rows), np.asarray(lists.value_lengths().fill_null(0), np.int64))
        spans = lists.flatten()
        np.add.at(edge, at[row] + np.asarray(spans.field("span_start"), np.int64), 1)
        np.add.at(edge, at[row] + np.asarray(spans.field("span_end"), np.int64), -1)
        keep = np.cumsum(edge[:-1]) == 0
        left = np.concatenate([[0], np.cumsum(keep)])[at]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in KEY), pa.ListArray.from_arrays(pa.array(left.astype(np.int32)), pa.array(flat[keep].astype(np.int64)))], names=[*KEY, "token_ids"])


def without_later(page_tokens: DataFrame, length: int = 24) -> DataFrame:
    """(page key, token_ids array<bigint>): every page without the tokens that a shared run other than its first covers. A page
    that repeats an earlier one as a whole comes out empty; null, empty and broken blobs give []."""
    pages = numbered_pages(page_tokens)
    later = page_stretches(page_runs(pages, length).filter("not first"), length).groupBy("page").agg(F.collect_list(F.struct("span_start", "span_end")).alias("spans"))
    return pages.join(later, "page", "left").select(*KEY, "token_ids", "spans").mapInArrow(_without, f"{PAGE}, token_ids array<bigint>")
