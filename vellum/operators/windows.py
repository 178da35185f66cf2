"""Overlapping token windows, shingles, candidate pairs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions.cut import once, sized_join, tasks_of_few_rows
from vellum.functions.pages import BASES, KEY, run_hashes, unlist
from vellum.operators.positions import page_ranges
from vellum.params import Params


def window_count(length: Column, p: Params) -> Column:
    """Windows of a book of ``length`` tokens: none if it is empty, one if it is shorter than a window; else the full ones and
    a last partial one if what is left from the next start has at least ``min_length`` tokens."""
    full = F.floor((length - p.window_size) / p.stride) + 1
    left = length - full * p.stride
    partial = F.when((left > 0) & (left >= p.min_length), 1).otherwise(0)
    return F.when(length <= 0, 0).when(length < p.window_size, 1).otherwise(full + partial).cast("bigint")


def window_ranges(lengths: DataFrame, p: Params) -> DataFrame:
    """(book_id, window_idx, global_start, global_end) from (book_id, length)."""
    k = F.explode(F.when(F.col("n") > 0, F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)).otherwise(F.array().cast("array<bigint>"))).alias("window_idx")
    w = lengths.withColumn("n", window_count(F.col("length"), p)).select("book_id", "length", k)
    start = F.col("window_idx") * p.stride
    return w.select("book_id", "window_idx", start.alias("global_start"), F.least(start + p.window_size, F.col("length")).alias("global_end"))


def token_windows(pages: DataFrame, p: Params, columns: tuple[str, ...] = ("lemma_ids", "root_ids")) -> DataFrame:
    """Windows of books given as pages (page key, arrays of equal length named by ``columns``): book_id, window_idx,
    global_start, global_end, start_page, start_offset, end_page, end_offset and the arrays.

    ``end_offset`` is that of the last token in its page. No book is gathered: every page goes, sliced, to the windows it
    overlaps, and a window's slices are joined, so that a task never holds more than windows. Pages without tokens are in no
    window.
    """
    sized = pages.select(*KEY, *columns).withColumn("n", F.size(columns[0]).cast("bigint")).filter("n > 0")
    ranges = page_ranges(sized.select(*KEY, "n"))
    lengths = ranges.groupBy("book_id").agg(F.sum("n").alias("length"))
    r = ranges.join(lengths, "book_id").select(*(F.col(k).alias(f"r_{k}") for k in KEY), "page_start", "page_end", "length")
    placed = sized.join(r, [F.col(k) == F.col(f"r_{k}") for k in KEY])
    first = F.greatest(F.lit(0), F.floor((F.col("page_start") - p.window_size) / p.stride) + 1)
    last = F.least(F.floor((F.col("page_end") - 1) / p.stride), window_count(F.col("length"), p) - 1)
    k = F.explode(F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))).alias("window_idx")
    met = placed.select(*KEY, "page_start", "page_end", "length", *columns, k)
    start = F.col("window_idx") * p.stride
    met = met.withColumn("global_start", start).withColumn("global_end", F.least(start + p.window_size, F.col("length")))
    lo, hi = F.greatest("page_start", "global_start"), F.least("page_end", "global_end")
    cut = [F.slice(c, (lo - F.col("page_start") + 1).cast("int"), (hi - lo).cast("int")).alias(c) for c in columns]
    parts = met.filter(hi > lo).select("book_id", "window_idx", "global_start", "global_end", F.struct(lo.alias("at"), F.struct("part_index", "page_id").alias("page"), (lo - F.col("page_start")).alias("off"), (hi - 1 - F.col("page_start")).alias("end"), *cut).alias("s"))
    whole = parts.groupBy("book_id", "window_idx", "global_start", "global_end").agg(F.array_sort(F.collect_list("s")).alias("s"))
    a, z = F.element_at("s", 1), F.element_at("s", -1)
    return whole.select("book_id", "window_idx", "global_start", "global_end", a["page"].alias("start_page"), a["off"].alias("start_offset"), z["page"].alias("end_page"), z["end"].alias("end_offset"), *(F.flatten(F.col("s")[c]).alias(c) for c in columns))


def shingle_array(ids: Column, n: int) -> Column:
    """The distinct runs of ``n`` ids as an array of arrays; [] if there are fewer than ``n`` ids, or for null."""
    none = F.array().cast("array<array<bigint>>")
    runs = F.transform(F.sequence(F.lit(1), F.size(ids) - n + 1), lambda i: F.slice(ids, i, n))
    return F.when(F.size(ids) >= n, F.array_distinct(runs)).otherwise(none)


def _shingled(n: int, on: str, keep: list[str], whole: bool):
    """Each window's distinct runs of ``n`` ids: 128 bits of hash, or with ``whole`` the ids themselves. They are told apart by
    their hashes, all windows of a batch in one sort."""

    def run(batches):
        for batch in batches:
            flat, at = unlist(batch.column(on))
            left = np.repeat(at[1:], np.diff(at)) - np.arange(len(flat))
            start = np.flatnonzero(left >= n)
            row = (np.searchsorted(at, start, "right") - 1).astype(np.int64)
            h, g = ((run_hashes(flat.view(np.uint64), n, x)[start] if len(start) else np.zeros(0, np.uint64)) for x in BASES)
            order = np.lexsort((g, h, row))
            new = np.ones(len(order), bool)
            new[1:] = (row[order][1:] != row[order][:-1]) | (h[order][1:] != h[order][:-1]) | (g[order][1:] != g[order][:-1])
            at_ = np.sort(order[new]) if whole else order[new]
            if whole:
                runs = np.lib.stride_tricks.sliding_window_view(flat, n)[start[at_]] if len(at_) else np.zeros((0, n), np.int64)
                found = [pa.ListArray.from_arrays(pa.array(np.arange(len(at_) + 1, dtype=np.int32) * n), pa.array(runs.ravel()))]
            else:
                found = [pa.array(x[at_].view(np.int64)) for x in (h, g)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(row[at_])) for c in keep), *found], names=[*keep, *(["shingle"] if whole else ["h", "g"])])

    return run


def shingles(windows: DataFrame, n: int, on: str = "lemma_ids") -> DataFrame:
    """(book_id, window_idx, shingle) with each window's distinct shingles."""
    keep = ["book_id", "window_idx"]
    return windows.select(*keep, on).filter(F.size(on) >= n).mapInArrow(_shingled(n, on, keep, True), "book_id bigint, window_idx bigint, shingle array<bigint>")


def candidate_pairs(windows: DataFrame, p: Params, pairs: DataFrame | None = None, on: str = "lemma_ids") -> DataFrame:
    """(book_a, widx_a, book_b, widx_b, shared): windows of two books with at least ``min_shared_shingles`` common shingles (0
    acts as 1). ``pairs`` (book_a, book_b) names the books to compare; without it every two books are, the smaller id first.

    A shingle travels as 128 bits of hash, and one that stands in one book only is dropped before the join. Without ``pairs``
    windows are put into tiles, and what two tiles share is counted at once, so that no row is made for a shared shingle.
    """
    if pairs is None:
        return _tiled_pairs(windows, p, on)
    keep = ["book_id", "window_idx"]
    w = windows.select(*keep, on).filter(F.size(on) >= p.ngram_size)
    named = pairs.select(F.explode(F.array("book_a", "book_b")).alias("own")).distinct()
    w = sized_join(w, named, w.book_id == named.own, "left_semi")
    s = w.mapInArrow(_shingled(p.ngram_size, on, keep, False), "book_id bigint, window_idx bigint, h bigint, g bigint")
    several = s.groupBy("h", "g").agg(F.min("book_id").alias("lo"), F.max("book_id").alias("hi"))
    if not _same_book(pairs):
        s = s.join(several.filter("lo < hi").select("h", "g"), ["h", "g"], "left_semi")
    a, b = (s.select("h", "g", F.col("book_id").alias(f"book_{x}"), F.col("window_idx").alias(f"widx_{x}")) for x in "ab")
    met = sized_join(a, pairs.select("book_a", "book_b").distinct(), "book_a", "inner").join(b, ["h", "g", "book_b"])
    return met.groupBy("book_a", "widx_a", "book_b", "widx_b").agg(F.count("*").alias("shared")).filter(F.col("shared") >= p.min_shared_shingles)


#: Windows of a book that are in a tile together, windows of a tile, and shared shingles counted at once.
RUN, TILE, AT_ONCE = 32, 2048, 4_000_000


def _tile_counts(tile: list[np.ndarray], same: bool, least: int):
    """A record batch of the pairs of windows of two tiles. ``tile`` has side, h, g, book_id and window_idx of each shingle of a
    window; of ``same`` tiles each is there once."""
    side, h, g, book, k = tile
    order = np.lexsort((g, h))
    new = np.ones(len(order), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (g[order][1:] != g[order][:-1])
    shingle = np.empty(len(order), np.int64)
    shingle[order] = np.cumsum(new) - 1
    n, sides = int(new.sum()), []
    for of in ((0, 0) if same else (0, 1)):
        rows = np.flatnonzero(side == of)
        rows = rows[np.lexsort((k[rows], book[rows]))]
        head = np.ones(len(rows), bool)
        head[1:] = (book[rows][1:] != book[rows][:-1]) | (k[rows][1:] != k[rows][:-1])
        window, by = np.cumsum(head) - 1, np.argsort(shingle[rows], kind="stable")
        sides.append((book[rows[head]], k[rows[head]], window[by], np.bincount(shingle[rows], minlength=n)))
    (book_a, k_a, win_a, n_a), (book_b, k_b, win_b, n_b) = sides
    shared = np.zeros(len(book_a) * len(book_b), np.int32)
    # each window of a meets those of b that hold its shingle
    of = np.repeat(np.arange(n), n_a)
    count, first = n_b[of], (np.cumsum(n_b) - n_b)[of]
    upto = np.cumsum(count)
    for part in np.split(np.arange(len(of)), np.searchsorted(upto, np.arange(AT_ONCE, int(upto[-1]) if len(upto) else 0, AT_ONCE))):
        c = count[part]
        at = np.arange(int(c.sum())) + np.repeat(first[part] - (np.cumsum(c) - c), c)
        shared += np.bincount(np.repeat(win_a[part] * len(book_b), c) + win_b[at], minlength=len(shared)).astype(np.int32)
    cell = np.flatnonzero(shared >= max(least, 1))
    a, b = np.divmod(cell, max(1, len(book_b)))
    keep = book_a[a] < book_b[b] if same else book_a[a] != book_b[b]
    a, b, n = a[keep], b[keep], shared[cell[keep]].astype(np.int64)
    turn = book_a[a] > book_b[b]
    pick = lambda x, y: np.where(turn, y[b], x[a])
    other = lambda x, y: np.where(turn, x[a], y[b])
    out = [pick(book_a, book_b), pick(k_a, k_b), other(book_a, book_b), other(k_a, k_b), n]
    order = np.lexsort(out[3::-1])
    return pa.RecordBatch.from_arrays([pa.array(x[order]) for x in out], names=["book_a", "widx_a", "book_b", "widx_b", "shared"])


def _counted(least: int):
    """Rows sorted by tiles: what two tiles share is counted when all of it is there."""

    def run(batches):
        key, held = None, []
        for batch in batches:
            a, b, *rest = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("tile_a", "tile_b", "side", "h", "g", "book_id", "window_idx"))
            bounds = np.flatnonzero((a[1:] != a[:-1]) | (b[1:] != b[:-1])) + 1
            for lo, hi in zip([0, *bounds.tolist()], [*bounds.tolist(), len(a)], strict=True):
                if lo == hi:
                    continue
                if (a[lo], b[lo]) != key:
                    if held:
                        yield _tile_counts([np.concatenate(x) for x in zip(*held, strict=True)], key[0] == key[1], least)
                    key, held = (a[lo], b[lo]), []
                held.append([x[lo:hi] for x in rest])
        if held:
            yield _tile_counts([np.concatenate(x) for x in zip(*held, strict=True)], key[0] == key[1], least)

    return run


def _tiled_pairs(windows: DataFrame, p: Params, on: str) -> DataFrame:
    """The candidates of every two books. A shingle goes to each two tiles that hold it, with their windows that do."""
    windows = once(windows.select("book_id", "window_idx", on).filter((F.size(on) >= p.ngram_size) & F.col("book_id").isNotNull()))
    tiles = windows.count() // TILE + 1
    tile = F.pmod(F.xxhash64("book_id", F.expr(f"window_idx div {RUN}")), F.lit(tiles)).cast("int")
    s = windows.mapInArrow(_shingled(p.ngram_size, on, ["book_id", "window_idx"], False), "book_id bigint, window_idx bigint, h bigint, g bigint").withColumn("tile", tile)
    several = s.groupBy("h", "g").agg(F.min("book_id").alias("lo"), F.max("book_id").alias("hi"), F.collect_set("tile").alias("tiles")).filter("lo < hi").select("h", "g", "tiles")
    met = s.join(several, ["h", "g"]).withColumn("other", F.explode("tiles"))
    rows = met.select(F.least("tile", "other").alias("tile_a"), F.greatest("tile", "other").alias("tile_b"), (F.col("tile") > F.col("other")).cast("int").alias("side"), "h", "g", "book_id", "window_idx")
    placed = rows.repartition(tasks_of_few_rows(windows.sparkSession), "tile_a", "tile_b").sortWithinPartitions("tile_a", "tile_b")
    return placed.mapInArrow(_counted(p.min_shared_shingles), "book_a bigint, widx_a bigint, book_b bigint, widx_b bigint, shared bigint")


def candidates_between(a: DataFrame, b: DataFrame, p: Params, on: str = "lemma_ids") -> DataFrame:
    """(book_a, widx_a, book_b, widx_b, shared) of the windows of one corpus and those of another, such as test items and
    documents; their book ids are to differ. Only shingles that both have are joined."""
    keep = ["book_id", "window_idx"]
    x, y = (w.select(*keep, on).filter(F.size(on) >= p.ngram_size).mapInArrow(_shingled(p.ngram_size, on, keep, False), "book_id bigint, window_idx bigint, h bigint, g bigint") for w in (a, b))
    x, y = (s.select("h", "g", F.col("book_id").alias(f"book_{k}"), F.col("window_idx").alias(f"widx_{k}")) for k, s in (("a", x), ("b", y)))
    met = x.join(y, ["h", "g"])
    return met.groupBy("book_a", "widx_a", "book_b", "widx_b").agg(F.count("*").alias("shared")).filter(F.col("shared") >= p.min_shared_shingles)


def _same_book(pairs: DataFrame) -> bool:
    return not pairs.filter("book_a = book_b").isEmpty()


def all_window_pairs(windows: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """(book_a, widx_a, book_b, widx_b) of every two windows of the books compared: the brute-force candidates, meant for pairs
    of short books. The books' window indices are joined by book pair, not crossed."""
    w = windows.select("book_id", "window_idx")
    if pairs is None:
        books = w.select("book_id").distinct()
        pairs = books.select(F.col("book_id").alias("book_a")).join(books.select(F.col("book_id").alias("book_b")), F.col("book_a") < F.col("book_b"))
    a, b = (w.select(F.col("book_id").alias(f"book_{x}"), F.col("window_idx").alias(f"widx_{x}")) for x in "ab")
    return pairs.join(a, "book_a").join(b, "book_b").select("book_a", "widx_a", "book_b", "widx_b")


def all_window_pair_counts(windows: DataFrame) -> DataFrame:
    """(book_a, book_b, n_pairs): how many pairs ``all_window_pairs`` has for every two books, which is the product of their
    windows; the pairs themselves are not made."""
    n = windows.filter("book_id is not null").groupBy("book_id").agg(F.count("*").alias("n"))
    a, b = (n.select(F.col("book_id").alias(f"book_{x}"), F.col("n").alias(f"n_{x}")) for x in "ab")
    # a book is one short row, so AQE would put all of them, and their whole product, into one task
    return sized_join(a.repartition(tasks_of_few_rows(windows.sparkSession), "book_a"), b, F.col("book_a") < F.col("book_b"), "inner").select("book_a", "book_b", (F.col("n_a") * F.col("n_b")).alias("n_pairs"))


def filter_rate(windows: DataFrame, candidates: DataFrame) -> DataFrame:
    """(book_a, book_b, total_pairs, candidates, rate_ppm) per pair of books that has candidates: the share of window pairs
    that the shingles rule out, in millionths (0 if there are none)."""
    n = windows.groupBy("book_id").agg(F.count("*").alias("n"))
    c = candidates.groupBy("book_a", "book_b").agg(F.count("*").alias("candidates"))
    out = c.join(n.select(F.col("book_id").alias("book_a"), F.col("n").alias("na")), "book_a").join(n.select(F.col("book_id").alias("book_b"), F.col("n").alias("nb")), "book_b").withColumn("total_pairs", F.col("na") * F.col("nb"))
    return out.select("book_a", "book_b", "total_pairs", "candidates", F.when(F.col("total_pairs") > 0, F.expr("((total_pairs - candidates) * 1000000) div total_pairs")).otherwise(0).alias("rate_ppm"))


def quick_similarity(a: Column, b: Column, least: int) -> Column:
    """Whether two arrays have at least ``least`` distinct ids in common."""
    return F.size(F.array_intersect(a, b)) >= least
