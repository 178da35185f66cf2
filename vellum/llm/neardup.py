"""Problem 7: near-duplicate records with small edits, by Golay-code fuzzy hashing.

A set is fingerprinted by one-bit min-hashes, so that two sets of similarity J differ in about (1 - J) / 2 of the bits. The bits
are cut into segments of 23, the length of the perfect binary Golay code. The indices of all codewords within distance 4 of a
segment (one, or about six) are its keys: words up to two errors apart share a key always, words a little further apart
mostly. Errors spread over the segments, so some segment of a similar pair has few of them. A 12-bit index alone would bring
together too many sets of a large collection, so each key also holds two min-hashes. Pairs that share a key and whose 128-bit
sketches are near enough are compared exactly. What chance may miss at the very bound, 2 pairs in 100,000, an exact way finds:
a join on the rarest ids of each set (``exact=True``).
"""

from __future__ import annotations

import functools
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.functions.cut import cut
from vellum.functions.pages import KEY, mix64, unlist
from vellum.llm.components import numbered

GENERATOR = 0b101011100011  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1
BITS = 23
#: A pair right at the bound shares no key with this probability at most.
MISS = 2e-5
SKETCH = 128
#: Sets fingerprinted at once; each has some 200 keys and 1,000 min-hashes.
ROWS = 1000
#: Standard deviations of the sketch's distance that a pair at the bound may lie off.
SLACK = 5.0


def _remainder(v):
    for i in range(BITS - 1, 10, -1):
        v = v ^ (((v >> i) & 1) * (GENERATOR << (i - 11)))
    return v


@functools.cache
def _errors() -> np.ndarray:
    """The error of at most three bits for each of the 2,048 syndromes; the code is perfect, so all are reached."""
    out = np.zeros(2048, np.int64)
    for k in range(4):
        for at in itertools.combinations(range(BITS), k):
            e = sum(1 << i for i in at)
            out[_remainder(e)] = e
    return out


def decode(words: np.ndarray) -> np.ndarray:
    """Index of the nearest codeword of each 23-bit word."""
    return (words ^ _errors()[_remainder(words)]) >> 11


@functools.cache
def _near() -> tuple[np.ndarray, np.ndarray]:
    """For each syndrome the (sorted, distinct) shifts to the codewords within distance 4, padded with the first."""
    syndrome = np.arange(2048, dtype=np.int64)
    # a 23-bit word below 2^11 is its own remainder, so it stands for its syndrome
    keys = np.stack([decode(syndrome), *(decode(syndrome ^ (1 << i)) for i in range(BITS))], 1)
    base = decode(syndrome)[:, None]
    rows = [np.unique(r) for r in keys ^ base]  # the code is linear
    most = max(map(len, rows))
    return np.array([np.pad(r, (0, most - len(r)), constant_values=r[0]) for r in rows]), np.array([len(r) for r in rows])


def keys(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codeword indices within distance 4 of each 23-bit word, one row each, and how many of them there are."""
    s = _remainder(words)
    shifts, n = _near()
    return decode(words)[:, None] ^ shifts[s], n[s]


@functools.cache
def _multipliers(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 1 << 32, n, dtype=np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, n, dtype=np.uint32)


def minima(values: np.ndarray, at: np.ndarray, n: int, seed: int) -> np.ndarray:
    """``n`` min-hashes of each set; the sets are ``values[at[i]:at[i+1]]`` and not empty."""
    x = (mix64(values.view(np.uint64) + np.uint64(seed)) >> np.uint64(16)).astype(np.uint32)
    mul, add = _multipliers(n, seed)
    out = np.empty((n, len(at) - 1), np.uint32)
    with np.errstate(over="ignore"):
        for i in range(n):
            h = x * mul[i]
            h ^= h >> np.uint32(15)
            h *= np.uint32(0x2C1B3C6D)
            h += add[i]
            out[i] = np.minimum.reduceat(h, at[:-1])
        # the bits of a minimum are not uniform, so they are scrambled before one of them is taken
        out ^= out >> np.uint32(16)
        out *= np.uint32(0x7FEB352D)
        out ^= out >> np.uint32(15)
    return out


@functools.cache
def segments_for(bound: float) -> int:
    """Segments so that a pair of this similarity shares a key but for the chance ``MISS``. The share of word pairs with a key in
    common is measured on random errors; both min-hashes of a key agree with the bound's square."""
    rng = np.random.default_rng(0)
    flips = (rng.random((20_000, BITS)) < (1 - bound) / 2) @ (1 << np.arange(BITS, dtype=np.int64))
    words = rng.integers(0, 1 << BITS, 20_000)
    (x, nx), (y, ny) = keys(words), keys(words ^ flips)
    met = np.zeros(len(words), bool)
    for i in range(x.shape[1]):
        for j in range(y.shape[1]):
            met |= (x[:, i] == y[:, j]) & (i < nx) & (j < ny)
    return max(1, int(np.ceil(np.log(MISS) / np.log1p(-met.mean() * bound**2))))


def _fingerprints(bound: float, seed: int):
    segments = segments_for(bound)

    def run(batches):
        for batch in (b.slice(k, ROWS) for b in batches for k in range(0, b.num_rows, ROWS)):
            ids, values, n = batch.column("rep"), *unlist(batch.column("ids"))
            if not len(ids):
                continue
            out_id, out_key = [], []
            h = minima(values, n, segments * (BITS + 2) + SKETCH, seed)
            bit = (h & np.uint32(1)).astype(np.uint64)
            sketch = [sum(bit[segments * (BITS + 2) + k * 64 + i] << np.uint64(i) for i in range(64)).view(np.int64) for k in range(2)]
            for s in range(segments):
                rows = slice(s * (BITS + 2), s * (BITS + 2) + BITS)
                word = sum(bit[rows][i] << np.uint64(i) for i in range(BITS)).astype(np.int64)
                index, many = keys(word)
                low = h[rows.stop].astype(np.uint64) << np.uint64(32) | h[rows.stop + 1]
                keep = np.arange(index.shape[1])[None, :] < many[:, None]
                row = np.nonzero(keep)[0]
                with np.errstate(over="ignore"):
                    key = mix64(mix64(low)[row] + (index[keep].astype(np.uint64) | np.uint64(s << 12) | np.uint64(seed << 32)))
                out_id.append(row), out_key.append(key)
            row = np.concatenate(out_id)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(row)), pa.array(np.concatenate(out_key).view(np.int64)), *(pa.array(f[row]) for f in sketch)], names=["rep", "key", "f0", "f1"])

    return run


def _reach(bound: float) -> int:
    p = (1 - bound) / 2
    return int(np.ceil(SKETCH * p + SLACK * np.sqrt(SKETCH * p * (1 - p))))


def similar_sets(sets: DataFrame, bound: float, seed: int = 1, exact: bool = False) -> DataFrame:
    """(a, b), a < b: pairs of rows (``rep`` bigint, ``ids`` array of distinct bigints) with at least the share ``bound`` of all
    their ids in common. Empty and null arrays are like nothing. Equal arrays should come in once, with the rows that hold them
    kept aside, as ``near_pages`` does. With ``exact`` the pairs to compare come from ``rare_id_pairs`` and none is missed."""
    sets = sets.filter(F.size("ids") > 0)
    if exact:
        pairs = rare_id_pairs(sets, bound)
    else:
        # sketches travel with the keys: without them the pairs that meet by chance would be shuffled to be told apart
        marked = sets.mapInArrow(_fingerprints(bound, seed), "rep bigint, key bigint, f0 bigint, f1 bigint")
        a, b = (marked.select("key", F.col("rep").alias(x), F.col("f0").alias(f"{x}0"), F.col("f1").alias(f"{x}1")) for x in "ab")
        near = f"bit_count(a0 ^ b0) + bit_count(a1 ^ b1) <= {_reach(bound)}"
        pairs = a.join(b, "key").filter(f"a < b and {near}").select("a", "b").distinct()
    of = lambda x: sets.select(F.col("rep").alias(x), F.col("ids").alias(f"ids_{x}"))
    both = pairs.join(of("a"), "a").join(of("b"), "b").withColumn("shared", F.size(F.array_intersect("ids_a", "ids_b")))
    all_ = F.size("ids_a") + F.size("ids_b") - F.col("shared")
    return both.filter(F.col("shared") * 1000 >= all_ * round(bound * 1000)).select("a", "b")


def rare_id_pairs(sets: DataFrame, bound: float) -> DataFrame:
    """(a, b), a < b: all pairs that may reach the bound. Two such sets share one of their first n - ceil(bound * n) + 1 ids
    in the order of rarity, and neither is larger than the other's size over the bound."""
    each = sets.select("rep", F.size("ids").alias("n"), F.explode("ids").alias("id"))
    rare = each.groupBy("id").agg(F.count("*").alias("df"))
    order = each.join(rare, "id").groupBy("rep", "n").agg(F.array_sort(F.collect_list(F.struct("df", "id"))).alias("o"))
    share = round(bound * 1000)
    first = order.select("rep", "n", F.explode(F.slice("o", 1, F.expr(f"cast(n - (n * {share} + 999) div 1000 + 1 as int)"))).alias("x")).select("rep", "n", F.col("x.id").alias("id"))
    a, b = (first.select("id", F.col("rep").alias(x), F.col("n").alias(f"n_{x}")) for x in "ab")
    return a.join(b, "id").filter(f"a < b and n_a * 1000 >= n_b * {share} and n_b * 1000 >= n_a * {share}").select("a", "b").distinct()


def near_pages(page_lemmas: DataFrame, least: int = 30, exact: bool = False) -> tuple[DataFrame, DataFrame]:
    """(members, links): each page with its class ``rep``, and the pairs (a, b) of classes that are nearly the same.

    Pages with the same sets of lemmas and of roots are one class; a class is numbered by its place in the order of the 128 bits
    of hash that name its content, so two contents never share a number. Pages with fewer than ``least`` lemma_ids, or a null
    array of them, are left out; null roots are no roots; 0 and null are no ids; repeated pages count once. Two classes are
    linked if at least 70 % of their lemmas, or 80 % of their roots, are common to both.
    """
    clean = lambda c: F.array_sort(F.array_distinct(F.filter(F.coalesce(F.col(c), F.array().cast("array<bigint>")), lambda x: x.isNotNull() & (x != 0))))
    pages = page_lemmas.filter(F.size("lemma_ids") >= least).select(*KEY, clean("lemma_ids").alias("l"), clean("root_ids").alias("r")).dropDuplicates(KEY)
    pages = cut(pages.withColumn("h", F.xxhash64("l", "r")).withColumn("g", F.xxhash64("r", "l", F.lit(7))))
    number = cut(numbered(pages.select("h", "g").distinct(), ["h", "g"])).withColumnRenamed("no", "rep")
    members = cut(pages.select(*KEY, "h", "g").join(number, ["h", "g"]).select(*KEY, "rep"))
    classes = cut(pages.dropDuplicates(["h", "g"]).join(number, ["h", "g"]).select("rep", "l", "r"))
    by_lemma = similar_sets(classes.select("rep", F.col("l").alias("ids")), 0.7, 1, exact)
    by_root = similar_sets(classes.select("rep", F.col("r").alias("ids")), 0.8, 2, exact)
    return members, by_lemma.unionByName(by_root).distinct()


def near_page_pairs(page_lemmas: DataFrame, exact: bool = False) -> DataFrame:
    """Every two pages that are nearly the same, the smaller key first; pages of one class included."""
    members, links = near_pages(page_lemmas, exact=exact)
    side = lambda x: members.select(F.col("rep").alias(x), *(F.col(k).alias(f"{k}_{x}") for k in KEY))
    order = lambda x: F.struct(*(F.col(f"{k}_{x}") for k in KEY))
    out = [f"{k}_{x}" for x in "ab" for k in KEY]
    across = links.join(side("a"), "a").join(side("b"), "b")
    flip = order("a") > order("b")
    across = across.select(*(F.when(flip, F.col(f"{k}_{y}")).otherwise(F.col(f"{k}_{x}")).alias(f"{k}_{x}") for x, y in ("ab", "ba") for k in KEY))
    several = members.groupBy("rep").count().filter("count > 1").select("rep")
    copies = members.join(several, "rep", "left_semi")
    one, two = (copies.select("rep", *(F.col(k).alias(f"{k}_{x}") for k in KEY)) for x in "ab")
    return across.unionByName(one.join(two, "rep").filter(order("a") < order("b")).select(*out)).select(*out)
