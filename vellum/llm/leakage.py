"""Problem 9: evaluation passages inside training text.

Every run of ten words of a test item holds six runs of five words. The one that fewest documents hold is the run's seed, so a
document with the passage holds the seed, and seeds are as rare as can be. Documents that hold a seed are aligned with the
seed's items by Smith-Waterman, and a run of ten equal words is checked for exactly. For edited copies every run of five words
that an item and a document share is a seed, and only stretches that may reach the least score by an upper bound are aligned.

The documents are read once, whatever the number of items: a bitmap of the items' runs, of bounded size, leaves out documents
that hold none; documents and items then meet in joins on the runs.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.functions.cut import cut
from vellum.functions.pages import BASES, run_hashes, unlist
from vellum.llm.lookalike import LATIN_TWINS, TABLE

#: Bits of the bitmap of the items' runs: 64 for each run, within these bounds (at most 32 MB go to each task).
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 28
#: Documents are aligned with an item together, about so many words at a time.
ROW_WORDS = 200_000
SEED, RUN = 5, 10
MATCH, MISMATCH, GAP = 2, -1, -1

_WORD = re.compile(r"[^\W_]+")


def _fold_table() -> dict[int, str | None]:
    """One step from a character to its folded form: without marks, look-alikes and case, digits by value."""
    out = dict(TABLE)
    for cp in range(0x80, 0x20000):
        if 0xD800 <= cp < 0xE000:
            continue
        c = chr(cp)
        s = TABLE.get(cp, c)
        if s is None:
            continue
        s = "".join(LATIN_TWINS.get(x, x) for x in unicodedata.normalize("NFKD", s))
        s = "".join(str(unicodedata.decimal(x)) if unicodedata.decimal(x, None) is not None else x for x in s if not unicodedata.category(x).startswith("M") and x != "ـ")
        s = s.replace("ی", "ي").replace("ى", "ي").replace("ک", "ك").casefold()
        if s != c:
            out[cp] = s or None
    return out


_FOLD: dict[int, str | None] = {}


def words(text: str) -> list[str]:
    """The words of a text: unbroken runs of letters and digits, folded so that what makes no difference is gone."""
    if not text.isascii():
        if not _FOLD:
            _FOLD.update(_fold_table())
        text = text.translate(_FOLD)
    return _WORD.findall(text.lower())


class Hasher:
    """Words to 64-bit hashes, remembering the words seen."""

    def __init__(self, most: int = 500_000):
        self.seen: dict[str, int] = {}
        self.most = most

    def __call__(self, ws: list[str]) -> np.ndarray:
        seen = self.seen
        if len(seen) > self.most:
            seen.clear()
        for w in set(ws).difference(seen):
            seen[w] = xxhash.xxh64_intdigest(w)
        return np.fromiter(map(seen.__getitem__, ws), np.uint64, len(ws))


def align(a: np.ndarray, b: np.ndarray) -> int:
    """Best Smith-Waterman score of two sequences. A row is filled at once: the gaps along it are a running maximum."""
    step = np.arange(len(b) + 1, dtype=np.int32) * -GAP
    h, best = np.zeros(len(b) + 1, np.int32), 0
    for x in a:
        t = np.zeros_like(h)
        np.maximum(h[:-1] + np.where(b == x, MATCH, MISMATCH).astype(np.int32), h[1:] + GAP, out=t[1:])
        np.maximum(t, 0, out=t)
        h = np.maximum.accumulate(t + step) - step
        best = max(best, int(h.max()))
    return best


def align_each(a: np.ndarray, parts: list[np.ndarray]) -> np.ndarray:
    """``align`` of ``a`` with each of ``parts``, whose entries are not negative. The parts stand in one row, a separator before each."""
    size = np.array([len(b) + 1 for b in parts])
    at = np.cumsum(size) - size
    row = np.concatenate([x for b in parts for x in (np.array([-1], b.dtype), b)])
    # a separator's step is larger than any score, so no gap runs over it
    step = np.arange(len(row)) * -GAP + np.repeat(np.arange(len(parts)), size) * (len(a) * MATCH + 1)
    if step[-1] < 2**30:
        step = step.astype(np.int32)
    h = np.zeros_like(step)
    best, yes, no = h.copy(), step.dtype.type(MATCH), step.dtype.type(MISMATCH)
    for x in a:
        t = h + step.dtype.type(GAP)
        np.maximum(t[1:], h[:-1] + np.where(row[1:] == x, yes, no), out=t[1:])
        np.maximum(t, 0, out=t)
        t[at] = 0
        h = np.maximum.accumulate(t + step) - step
        np.maximum(best, h, out=best)
    return np.maximum.reduceat(best, at)


def stretches(hit: np.ndarray, size: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(number of the text, start, end) of all stretches of texts in one row that an alignment with ``least`` may lie in: no
    alignment scores more than its words that are in the item at all (``hit``) less the others."""
    text = np.repeat(np.arange(len(size)), size)
    worth = np.where(hit, MATCH, max(MISMATCH, GAP)).astype(np.int64)
    total = np.cumsum(worth) - text * (2 * MATCH * len(hit) + 1)  # lower from text to text, so that nothing runs from one into the next
    before = total - worth
    most = np.maximum.accumulate(total[::-1])[::-1] - np.minimum.accumulate(before)
    where = np.flatnonzero(most >= least)
    if not len(where):
        return []
    new = np.flatnonzero((np.diff(where) > 1) | (np.diff(text[where]) > 0)) + 1
    first, last = where[np.append(0, new)], where[np.append(new, len(where)) - 1]
    return list(zip(text[first].tolist(), first.tolist(), (last + 1).tolist(), strict=True))


def longest_run(a: np.ndarray, b: np.ndarray) -> int:
    """Longest run of equal consecutive entries."""
    best, prev = 0, np.zeros(len(b) + 1, np.int32)
    for x in a:
        now = np.zeros_like(prev)
        now[1:] = np.where(b == x, prev[:-1] + 1, 0)
        prev, best = now, max(best, int(now.max()))
    return best


def _grams(flat: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of every run of five words that lies within one text."""
    g = run_hashes(flat, SEED, BASES[0])
    left = np.repeat(at[1:], np.diff(at)) - np.arange(len(flat))
    start = np.flatnonzero(left >= SEED)
    return start, g[start] if len(start) else np.zeros(0, np.uint64)


def _read(batch, column: str = "text") -> list[np.ndarray]:
    hasher = Hasher()
    return [hasher(words(t)) if t else np.zeros(0, np.uint64) for t in batch.column(column).to_pylist()]


def _flat(ws: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return (np.concatenate(ws) if ws else np.zeros(0, np.uint64)), np.concatenate([[0], np.cumsum([len(w) for w in ws])]).astype(np.int64)


def _item_words(batches):
    for batch in batches:
        ws = _read(batch)
        yield pa.RecordBatch.from_arrays([batch.column("item_id"), pa.array([w.view(np.int64) for w in ws], pa.list_(pa.int64()))], names=["item_id", "words"])


def _item_grams(batches):
    """(item row, place, run) of the runs of five words of each item."""
    for batch in batches:
        flat, at = unlist(batch.column("words"))
        start, g = _grams(flat.view(np.uint64), at)
        row = np.searchsorted(at, start, "right") - 1
        yield pa.RecordBatch.from_arrays([batch.column("item").take(pa.array(row)), pa.array(start - at[row]), pa.array(g.view(np.int64))], names=["item", "place", "g"])


def _places(g: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of the bitmap that each run sets."""
    return g & np.uint64(bits - 1), (g >> np.uint64(29)) & np.uint64(bits - 1)


def _bits(bits: int):
    def run(batches):
        for batch in batches:
            at = np.unique(np.concatenate(_places(np.asarray(batch.column("g"), np.int64).view(np.uint64), bits)))
            word, first = np.unique(at >> np.uint64(6), return_index=True)
            ones = np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), first) if len(first) else at
            yield pa.RecordBatch.from_arrays([pa.array(word.astype(np.int64)), pa.array(ones.view(np.int64))], names=["word", "ones"])

    return run


def _bitmap(grams: DataFrame, bits: int) -> np.ndarray:
    """The bitmap of the runs: at most ``bits`` / 64 rows reach the driver."""
    t = grams.mapInArrow(_bits(bits), "word bigint, ones bigint").groupBy("word").agg(F.bit_or("ones").alias("ones")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[np.asarray(t.column("word"), np.int64)] = np.asarray(t.column("ones"), np.int64)
    return out.view(np.uint64)


def _hits(bitmap, bits: int):
    """Documents that may hold a run of some item: their words and those runs."""

    def run(batches):
        table = bitmap.value
        test = lambda at: (table[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1
        for batch in batches:
            ws = _read(batch)
            flat, at = _flat(ws)
            start, g = _grams(flat, at)
            x, y = _places(g, bits)
            may = np.flatnonzero(test(x))
            may = may[test(y[may])]
            row = np.searchsorted(at, start[may], "right") - 1
            rows, first = np.unique(row, return_index=True)
            ends = np.append(first[1:], len(row))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(rows)), pa.array([ws[r].view(np.int64) for r in rows], pa.list_(pa.int64())),
                 pa.array([np.unique(g[may[a:b]]).view(np.int64) for a, b in zip(first, ends, strict=True)], pa.list_(pa.int64()))],
                names=["doc_id", "words", "grams"],
            )

    return run


def _rarest(batches):
    """(g, item): of every ten-word run whose parts are all in documents the part that fewest hold. A run of which some part is
    in no document is in none."""
    for batch in batches:
        items, seeds = [], []
        at = batch.column("held")
        for item, n, held in zip(batch.column("item").to_pylist(), batch.column("n").to_pylist(), at, strict=True):
            df, g = np.zeros(n, np.int64), np.zeros(n, np.int64)
            v = held.values
            place = np.asarray(v.field("place"), np.int64)
            df[place], g[place] = np.asarray(v.field("df"), np.int64), np.asarray(v.field("g"), np.int64)
            if n <= RUN - SEED:
                continue
            part = np.lib.stride_tricks.sliding_window_view(df, RUN - SEED + 1)
            good = np.flatnonzero(part.all(1))
            pick = np.unique(g[good + part[good].argmin(1)])
            seeds.append(pick), items.append(np.full(len(pick), item, np.int64))
        join = lambda x: pa.array(np.concatenate(x) if x else np.zeros(0, np.int64))
        yield pa.RecordBatch.from_arrays([join(seeds), join(items)], names=["g", "item"])


def _aligned(least: int):
    """(doc_id, item_id, score, run) of rows with the words of a document and of an item; rows of one item stand together and
    are aligned together."""

    def scored(item: np.ndarray, texts: list[np.ndarray]):
        """(number of the text, score, run)."""
        known = np.unique(item)
        flat, at = _flat(texts)
        code = np.searchsorted(known, flat)
        hit = known[np.minimum(code, len(known) - 1)] == flat
        code[~hit] = len(known)  # not in the item
        own = np.searchsorted(known, item)
        parts = stretches(hit, np.diff(at), least)
        if not parts:
            return
        best: dict[int, int] = {}
        for (n, _, _), s in zip(parts, align_each(own, [code[x:y] for _, x, y in parts]).tolist(), strict=True):
            best[n] = max(s, best.get(n, 0))
        for n, s in best.items():
            if s >= least:
                yield n, s, longest_run(own, code[at[n] : at[n + 1]])

    def run(batches):
        for batch in batches:
            text, item = (c.flatten().to_numpy().view(np.uint64) for c in (batch.column("words"), batch.column("item_words")))
            at, own = (np.concatenate([[0], np.cumsum(np.asarray(batch.column(c).value_lengths(), np.int64))]) for c in ("words", "item_words"))
            of = np.asarray(batch.column("item"), np.int64)
            out, a = [], 0
            while a < len(of):
                b, size = a, 0
                while b < len(of) and of[b] == of[a] and (b == a or size < ROW_WORDS):
                    size += at[b + 1] - at[b]
                    b += 1
                out += [(a + n, s, r) for n, s, r in scored(item[own[a] : own[a + 1]], [text[at[k] : at[k + 1]] for k in range(a, b)])]
                a = b
            row, score, longest = zip(*out, strict=True) if out else ((), (), ())
            take = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(take), batch.column("item_id").take(take), *(pa.array(x, pa.int64()) for x in (score, longest))], names=["doc_id", "item_id", "score", "run"])

    return run


def leaks(documents: DataFrame, items: DataFrame, least: int = RUN * MATCH, edited: bool = False) -> DataFrame:
    """(doc_id, item_id, score, run): the documents that hold a passage of an item.

    ``score`` is the best local alignment of their words, ``run`` the longest run of equal words; pairs below the score
    ``least`` are left out. Every document with a run of ten or more words of an item comes out. With ``edited`` so does every
    document that shares any five words in a row with an item and reaches the score: an item of five to nine words can then
    leak too, if ``least`` is within its reach. A copy without five words in a row is not looked for. Null and empty texts hold
    nothing, a repeated row counts once, empty tables give no rows.
    """
    spark = documents.sparkSession
    schema = "doc_id bigint, item_id bigint, score bigint, run bigint"
    known = items.select(F.col("item_id").cast("bigint"), "text").filter("item_id is not null and text is not null").distinct()
    known = known.mapInArrow(_item_words, "item_id bigint, words array<bigint>").filter(F.size("words") >= (SEED if edited else RUN)).distinct()
    known = cut(known.withColumn("item", F.monotonically_increasing_id()))
    runs = cut(known.select("item", "words").mapInArrow(_item_grams, "item bigint, place bigint, g bigint"))
    grams = runs.select("g").distinct()
    n = grams.count()
    if not n:
        return spark.createDataFrame([], schema)
    bits = 1 << int(np.clip(np.ceil(np.log2(64 * n)), np.log2(LEAST_BITS), np.log2(MOST_BITS)))
    table = spark.sparkContext.broadcast(_bitmap(grams, bits))
    docs = documents.select(F.col("doc_id").cast("bigint"), "text").filter("text is not null")
    hits = docs.mapInArrow(_hits(table, bits), "doc_id bigint, words array<bigint>, grams array<bigint>")
    hits = cut(hits.withColumn("doc", F.monotonically_increasing_id()))
    held = hits.select("doc", F.explode("grams").alias("g"))
    if edited:
        seeds = runs.select("g", "item").distinct()
    else:
        rare = runs.join(held.groupBy("g").agg(F.count("*").alias("df")), "g")
        length = known.select("item", (F.size("words") - SEED + 1).alias("n"))
        each = rare.groupBy("item").agg(F.collect_list(F.struct("place", "g", "df")).alias("held"))  # an item's own runs
        seeds = each.join(length, "item").mapInArrow(_rarest, "g bigint, item bigint").distinct()
    pairs = held.join(seeds, "g").select("doc", "item").distinct()
    met = pairs.join(hits.select("doc", "doc_id", "words"), "doc").join(known.withColumnRenamed("words", "item_words"), "item")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    # an item that stands in a third of the documents is several groups
    spread = met.repartition(tasks, "item", F.pmod("doc", F.lit(16))).sortWithinPartitions("item")
    return spread.mapInArrow(_aligned(least), schema).distinct()
