"""Problem 5: splitting oversized items at natural boundaries, with an overlap.

Two ways to cut. ``bisect`` halves an item at the strongest boundary near its middle (a change of part is stronger than a break
of page, and that than none) until every piece fits and then attaches the overlaps. ``forward`` goes from the start and ends each piece at the last boundary within the limit. The fixed result
wanted of this project is the forward one, which no bisection gives.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.operators.positions import page_ranges, page_sizes

#: Positions per bucket of the range join of windows with page breaks.
BUCKET = 4096


def forward(start: int, end: int, breaks: np.ndarray, strength: np.ndarray, limit: int, overlap: int) -> list[tuple[int, int]]:
    """Pieces (start, end) from the front: each ends at the last break in (start + overlap, start + limit], or at the limit."""
    out = []
    while end - start > limit:
        k = np.searchsorted(breaks, start + limit, "right") - 1
        cut_at = int(breaks[k]) if k >= 0 and breaks[k] > start + overlap else start + limit
        out.append((start, cut_at))
        start = cut_at - overlap
    out.append((start, end))
    return out


def bisect(start: int, end: int, breaks: np.ndarray, strength: np.ndarray, limit: int, overlap: int) -> list[tuple[int, int]]:
    """Pieces by recursive halving: of the breaks within a quarter of the length of the middle the strongest, the nearest of
    equals and the first of those, else the middle itself; until each fits the limit without its overlap. Then each but the
    first takes in the overlap before it."""
    todo, out, room = [(start, end)], [], max(1, limit - overlap)
    while todo:
        a, b = todo.pop()
        if b - a <= room:
            out.append((a, b))
            continue
        mid = (a + b) // 2
        inside = slice(np.searchsorted(breaks, a, "right"), np.searchsorted(breaks, b, "left"))
        off = np.abs(breaks[inside] - mid)
        close = off <= (b - a) // 4
        at = mid
        if close.any():
            at = int(breaks[inside][close][np.lexsort((off[close], -strength[inside][close]))[0]])
        todo += [(at, b), (a, at)]
    return [(max(start, a - overlap) if a > start else a, b) for a, b in out]


def _pieces(how, limit: int, overlap: int):
    def run(batches):
        for batch in batches:
            row, no, lo, hi = [], [], [], []
            at = zip(batch.column("global_start").to_pylist(), batch.column("global_end").to_pylist(), batch.column("breaks"), strict=True)
            for i, (a, b, breaks) in enumerate(at):
                where, strength = (np.asarray(breaks.values.field(c), np.int64) for c in ("at", "strength"))
                order = np.argsort(where)
                for k, (x, y) in enumerate(how(a, b, where[order], strength[order], limit, overlap)):
                    row.append(i), no.append(k), lo.append(x), hi.append(y)
            take = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("book_id").take(take), batch.column("window_idx").take(take), *(pa.array(x, pa.int64()) for x in (no, lo, hi))], names=["book_id", "window_idx", "piece_no", "piece_start", "piece_end"])

    return run


def split_windows(windows: DataFrame, page_tokens: DataFrame, limit: int = 400, overlap: int = 40, how=forward) -> DataFrame:
    """(book_id, window_idx, piece_no, piece_start, piece_end) of every window with more than ``limit`` lemma_ids.

    Positions are global, end exclusive. Windows with a null array or null position are no case; repeated windows count once.
    A window whose book has no pages is cut at the limit. No token is copied: the pieces are ranges.
    """
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be less than the limit")
    big = windows.filter((F.size("lemma_ids") > limit) & F.col("lemma_ids").isNotNull() & F.col("root_ids").isNotNull()).select("book_id", "window_idx", "global_start", "global_end").dropna(subset=["global_start", "global_end"]).dropDuplicates(["book_id", "window_idx"])
    ranges = page_ranges(page_sizes(page_tokens))
    # a part begins where its first page with tokens does; pages without tokens begin where the next one does
    opening = ranges.filter("n > 0").groupBy("book_id", "part_index").agg(F.min("page_start").alias("at")).select("book_id", "at", F.lit(2).alias("strength"))
    breaks = ranges.select("book_id", F.col("page_start").alias("at"), F.lit(1).alias("strength")).unionAll(opening)
    breaks = breaks.filter("at > 0").groupBy("book_id", "at").agg(F.max("strength").cast("bigint").alias("strength")).withColumn("bucket", F.expr(f"at div {BUCKET}"))
    spread = big.withColumn("bucket", F.explode(F.sequence(F.expr(f"global_start div {BUCKET}"), F.expr(f"global_end div {BUCKET}"))))
    b = breaks.select(F.col("book_id").alias("b_book"), F.col("bucket").alias("b_bucket"), "at", "strength")
    met = spread.join(b, (F.col("book_id") == F.col("b_book")) & (F.col("bucket") == F.col("b_bucket")) & (F.col("at") > F.col("global_start")) & (F.col("at") < F.col("global_end")), "left")
    grouped = met.groupBy("book_id", "window_idx", "global_start", "global_end").agg(F.collect_list(F.when(F.col("at").isNotNull(), F.struct("at", "strength"))).alias("breaks"))
    return grouped.mapInArrow(_pieces(how, limit, overlap), "book_id bigint, window_idx bigint, piece_no bigint, piece_start bigint, piece_end bigint")
