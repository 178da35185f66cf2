"""Problem 8: filling fixed-capacity containers with items of varying length.

The sizes' histogram, which has at most as many entries as the capacity, is all the planning needs. Dynamic programming over
it picks the bucket boundaries that minimise padding. Token-budget batches are then formed bucket by bucket from the largest
down: a batch takes as many items of a bucket as its budget holds, and what room is left goes to the smaller buckets. The plan
is a short list of runs (ranks of a bucket to containers), so items are assigned by their rank without being gathered.
"""

from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CAPACITY = 4096
BUCKETS = 256


def boundaries(sizes: np.ndarray, counts: np.ndarray, buckets: int = BUCKETS) -> np.ndarray:
    """Upper bounds of at most ``buckets`` buckets with the least total padding, by dynamic programming with a price per
    bucket; the price is found by bisection."""
    n = len(sizes)
    if n <= buckets:
        return sizes
    c, m = np.concatenate([[0], np.cumsum(counts)]).astype(float), np.concatenate([[0], np.cumsum(counts * sizes)]).astype(float)

    def plan(price: float) -> list[int]:
        best, back = np.zeros(n + 1), np.zeros(n + 1, int)
        for j in range(1, n + 1):
            cost = best[:j] + sizes[j - 1] * (c[j] - c[:j]) - (m[j] - m[:j])
            back[j] = cost.argmin()
            best[j] = cost[back[j]] + price
        out, j = [], n
        while j:
            out.append(j - 1)
            j = back[j]
        return out[::-1]

    low, high = 0.0, float(sizes[-1] * c[-1]) + 1
    for _ in range(40):
        mid = (low + high) / 2
        if len(plan(mid)) <= buckets:
            high = mid
        else:
            low = mid
        if high - low < 0.5:
            break
    return sizes[plan(high)]


def fill(bounds: np.ndarray, counts: np.ndarray, capacity: int = CAPACITY, first: int = 0) -> list[tuple[int, int, int, int, int]]:
    """Runs (bucket, rank from, rank to, first container, items in each container) that place ``counts`` items of each bucket."""
    room: list[int] = []  # the rooms left in open containers, in order
    of: dict[int, list[tuple[int, int]]] = {}  # room: runs of containers (first, how many)

    def leave(r: int, start: int, n: int) -> None:
        if r and n:
            if r not in of:
                of[r] = []
                bisect.insort(room, r)
            of[r].append((start, n))

    out, nxt = [], first
    for b in range(len(bounds) - 1, -1, -1):
        size, left, rank = int(bounds[b]), int(counts[b]), 0
        while left:
            k = bisect.bisect_left(room, size)
            if k < len(room):
                r = room[k]
                start, n = of[r].pop()
                if not of[r]:
                    del of[r], room[k]
            else:
                r, start, n = capacity, nxt, max(1, left // (capacity // size))
                nxt += n
            each = min(r // size, left)
            used = min(n, left // each)
            out.append((b, rank, rank + used * each, start, each))
            rank, left = rank + used * each, left - used * each
            leave(r - each * size, start, used)
            leave(r, start + used, n - used)
    return out


def _assigned(runs, offset, salts: int):
    bucket = np.array([r[0] for r in runs], np.int64)
    lo = np.array([r[1] for r in runs], np.int64)
    order = np.lexsort((lo, bucket))
    ranked = [np.array([r[i] for r in runs], np.int64)[order] for i in (0, 1, 3, 4)]

    def run(batches):
        for batch in batches:
            b, salt, rn = (np.asarray(batch.column(c), np.int64) for c in ("bucket", "salt", "rn"))
            rank = offset[b * salts + salt] + rn - 1
            # runs are in the order of (bucket, rank); ranks stay below 2^62 / buckets
            big = np.int64(1) << np.int64(52)
            at = np.searchsorted(ranked[0] * big + ranked[1], b * big + rank, "right") - 1
            container = ranked[2][at] + (rank - ranked[1][at]) // ranked[3][at]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "piece_no", "token_start", "token_end")), pa.array(container)], names=["doc_id", "piece_no", "token_start", "token_end", "container_id"])

    return run


def pack(documents: DataFrame, capacity: int = CAPACITY, buckets: int = BUCKETS, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, piece_no, token_start, token_end, container_id): every non-null text in containers of ``capacity`` tokens.

    A text has one token per UTF-8 byte and an end token; an empty text is an item of one token. A text of more than
    ``capacity`` tokens is cut into full pieces, each a container of its own, and a last piece that is packed like any item;
    no other text is cut. Null texts are no items. Rows with the same id are items of their own. Texts are not moved.
    """
    size = (F.octet_length(text) + 1).cast("bigint")
    sized = documents.filter(F.col(text).isNotNull()).select(F.col(key).cast("bigint").alias("doc_id"), size.alias("size"))
    hist = sized.filter(f"size % {capacity} > 0").groupBy(F.expr(f"size % {capacity}").alias("s")).agg(F.count("*").alias("n")).orderBy("s").collect()  # at most ``capacity`` rows
    sizes, counts = (np.array([r[i] for r in hist], np.int64) for i in (0, 1))
    spark = documents.sparkSession
    bounds = boundaries(sizes, counts, buckets) if len(sizes) else sizes
    of = np.searchsorted(bounds, sizes)
    per = np.bincount(of, weights=counts, minlength=len(bounds)).astype(np.int64) if len(sizes) else sizes
    runs = fill(bounds, per, capacity)
    last = max((r[3] + (r[2] - r[1]) // r[4] for r in runs), default=0)
    salts = int(np.clip(per.sum() // 2_000_000, 64, 4096)) if len(per) else 64
    small = sized.withColumn("s", F.expr(f"size % {capacity}")).filter("s > 0")
    small = small.withColumn("bucket", _bucket_of("s", bounds) if len(bounds) else F.lit(0).cast("bigint"))
    # ids repeat at most as rows repeat, so a salt of the id spreads a bucket that holds a third of all items
    small = small.withColumn("salt", F.pmod(F.xxhash64("doc_id", "size"), F.lit(salts)))
    offset = np.zeros(max(1, len(bounds)) * salts, np.int64)
    for b, s, n in small.groupBy("bucket", "salt").count().collect():  # at most buckets x salts rows
        offset[b * salts + s] = n
    table = offset.reshape(-1, salts)
    offset = (np.cumsum(table, axis=1) - table).reshape(-1)
    full = F.expr(f"size div {capacity}")
    ranked = small.withColumn("rn", F.row_number().over(Window.partitionBy("bucket", "salt").orderBy("doc_id", "size")).cast("bigint"))
    ranked = ranked.select("doc_id", full.cast("bigint").alias("piece_no"), (full * capacity).cast("bigint").alias("token_start"), F.col("size").alias("token_end"), "bucket", "salt", "rn")
    schema = "doc_id bigint, piece_no bigint, token_start bigint, token_end bigint, container_id bigint"
    packed = ranked.mapInArrow(_assigned(runs, offset, salts), schema) if runs else spark.createDataFrame([], schema)
    whole = sized.filter(f"size >= {capacity}").groupBy("doc_id", "size").agg(F.count("*").alias("copies"))
    whole = whole.select("doc_id", "size", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).select("doc_id", F.posexplode(F.sequence(F.lit(1).cast("bigint"), full)).alias("piece_no", "k"), "copy")
    return packed.unionByName(_numbered_pieces(whole, capacity, last))


def _bucket_of(column: str, bounds: np.ndarray):
    """Index of the first bound that is not below the column, as a lookup in a literal array of the sizes' buckets."""
    of = np.searchsorted(bounds, np.arange(1, int(bounds[-1]) + 1))
    return F.element_at(F.expr("array(" + ",".join(f"{int(x)}S" for x in of) + ")"), F.col(column).cast("int")).cast("bigint")


def _numbered_pieces(whole: DataFrame, capacity: int, first: int) -> DataFrame:
    """Full pieces with containers of their own, numbered from ``first`` by hashed groups and their counts."""
    groups = 256
    w = whole.withColumn("g", F.pmod(F.xxhash64("doc_id", "piece_no"), F.lit(groups)))
    counts = dict(w.groupBy("g").count().collect())  # at most 256 rows
    total, start = first, {}
    for g in range(groups):
        start[g] = total
        total += counts.get(g, 0)
    begin = F.element_at(F.array(*(F.lit(start[g]).cast("bigint") for g in range(groups))), (F.col("g") + 1).cast("int"))
    rn = F.row_number().over(Window.partitionBy("g").orderBy("doc_id", "piece_no", "copy"))
    return w.select("doc_id", F.col("piece_no").cast("bigint"), (F.col("piece_no") * capacity).cast("bigint").alias("token_start"), ((F.col("piece_no") + 1) * capacity).cast("bigint").alias("token_end"), (begin + rn - 1).cast("bigint").alias("container_id"))
