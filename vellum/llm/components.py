"""Problem 1: consolidating pairwise matches into groups.

Degree-one vertices are stripped and degree-two chains are compressed by list ranking (pointer doubling over arcs), again
and again; alternating large-star and small-star steps solve the reduced core; then labels go back to what was removed, in
reverse order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.functions.cut import cut, drop, spread_join

#: A round of stripping or compressing that removes a smaller share of the edges hands the rest to the core solver. This says
#: which step solves the rest, never what the groups are.
WORTH = 0.05


def _both(e: DataFrame) -> DataFrame:
    """Every edge in both directions."""
    return e.select("u", "v").unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _degrees(e: DataFrame) -> DataFrame:
    return _both(e).groupBy("u").agg(F.count("*").alias("d"), F.min("v").alias("x"), F.max("v").alias("y"))


def _without(e: DataFrame, gone: DataFrame) -> DataFrame:
    """Edges of which neither end is among ``gone.child``."""
    g = gone.select(F.col("child"))
    return e.join(g, e.u == g.child, "left_anti").join(g, e.v == g.child, "left_anti")


def _strip(e: DataFrame) -> DataFrame:
    """(child, parent) of each degree-one vertex. Of an edge that stands alone only the larger end is stripped."""
    leaf = _degrees(e).filter("d = 1").select("u", F.col("x").alias("near"))
    other = leaf.select(F.col("u").alias("o"))
    return leaf.join(other, leaf.near == other.o, "left").filter("o is null or u > near").select(F.col("u").alias("child"), F.col("near").alias("parent"))


def _compress(e: DataFrame) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """(child, parent) of each degree-two vertex, the edges that replace the chains, and the tables these hang on.

    Every arc out of a degree-two vertex is ranked by pointer doubling until it meets a vertex of another degree. Arcs that
    never do run around a plain cycle; their smallest vertex is the cycle's root.
    """
    two = cut(_degrees(e).filter("d = 2").select(F.col("u").alias("m"), "x", "y"))
    arcs = two.select(F.col("m").alias("v"), F.explode(F.array("x", "y")).alias("w"))
    on = two.select("m", "x", "y")
    a = cut(
        arcs.join(on, arcs.w == on.m, "left").select(
            "v", "w", F.when(F.col("m").isNull(), F.col("w")).alias("end"),
            F.when(F.col("m").isNotNull(), F.col("w")).alias("nv"),
            F.when(F.col("m").isNotNull(), F.when(F.col("x") == F.col("v"), F.col("y")).otherwise(F.col("x"))).alias("nw"),
            F.least("v", "w").alias("low"),
        )
    )
    before = (-1, None)
    while True:
        open_, low = a.filter("end is null").agg(F.count("*"), F.sum(F.col("low").cast("decimal(38,0)"))).first()
        if open_ == 0 or (open_, low) == before:
            break
        before = (open_, low)
        b = a.select(F.col("v").alias("bv"), F.col("w").alias("bw"), F.col("end").alias("bend"), F.col("nv").alias("bnv"), F.col("nw").alias("bnw"), F.col("low").alias("blow"))
        running, still = a.filter("end is null"), a.filter("end is not null")
        stepped = running.join(b, (running.nv == b.bv) & (running.nw == b.bw)).select("v", "w", F.col("bend").alias("end"), F.col("bnv").alias("nv"), F.col("bnw").alias("nw"), F.least("low", "blow").alias("low"))
        now = cut(still.unionByName(stepped))
        drop(a)
        a = now
    ends = cut(a.groupBy("v").agg(F.min("end").alias("p"), F.max("end").alias("q"), F.min("low").alias("low")))
    drop(a)
    pointer = ends.select(F.col("v").alias("child"), F.coalesce("p", "low").alias("parent"))
    bridge = ends.filter("p is not null and p <> q").select(F.col("p").alias("u"), F.col("q").alias("v"))
    return pointer, bridge, [two, ends]


def _core(e: DataFrame) -> DataFrame:
    """(child, parent) with the parent the smallest vertex of the component, by large-star and small-star steps."""
    e = cut(e)
    seen = None
    while True:
        # large star: every larger neighbour is linked to the smallest of the neighbours and the vertex itself
        n = _both(e)
        low = n.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = n.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        # small star: every smaller neighbour and the vertex are linked to the smallest of them
        large = cut(large)
        to = large.groupBy("u").agg(F.min("v").alias("m"))
        linked = large.join(to, "u")
        small = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(linked.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        small = cut(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")))
        mark = tuple(small.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        drop(e, large)
        e = small
        if mark == seen or mark[0] == 0:
            return e.select(F.col("u").alias("child"), F.col("v").alias("parent"))
        seen = mark


def components(pairs: DataFrame) -> DataFrame:
    """Group the bigint pairs ``u, v``: one row (``v``, ``root``) per vertex, ``root`` the smallest vertex linked to it.

    Pairs with a null end count for nothing; a pair of a vertex with itself makes the vertex known. Repeated and mirrored
    pairs count once. No rows give no rows. Other columns are ignored.
    """
    pairs = pairs.select("u", "v").filter("u is not null and v is not null")
    vertices = cut(pairs.select(F.explode(F.array("u", "v")).alias("v")).distinct())
    e = cut(pairs.filter("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    size = e.count()
    removed: list[DataFrame] = []
    keep: list[DataFrame] = [vertices]
    while size:
        start = size
        while size:
            gone = cut(_strip(e))
            rest = cut(_without(e, gone))
            removed.append(gone)
            left = rest.count()
            drop(e)
            e, less = rest, size - left
            size = left
            if less < WORTH * (size + less):
                break
        if size:
            pointer, bridge, held = _compress(e)
            gone = cut(pointer.filter("child <> parent"))
            # roots of plain cycles have no edges left, so they leave with the chain vertices
            rest = cut(_without(e, pointer).unionByName(bridge.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))).distinct())
            removed.append(gone)
            drop(e, *held)
            e, size = rest, rest.count()
        if start - size < WORTH * start:
            break
    label = _core(e) if size else e.select(F.col("u").alias("child"), F.col("v").alias("parent"))
    label = label.select("child", F.col("parent").alias("root"))
    for gone in reversed(removed):
        to = label.select(F.col("child").alias("c"), "root")
        back = gone.join(to, gone.parent == to.c, "left").select("child", F.coalesce("root", "parent").alias("root"))
        now = cut(label.unionByName(back))
        drop(label, gone)
        label = now
    # a component with a third of all vertices is one root, so its rows are joined in parts
    low = cut(label.groupBy("root").agg(F.least(F.min("child"), F.first("root")).alias("low"), F.count("*").alias("n")))
    named = spread_join(label, low, ["root"]).select(F.col("child").alias("v"), F.col("low").alias("root")).unionByName(low.select(F.col("root").alias("v"), F.col("low").alias("root")))
    alone = vertices.join(named.select("v"), "v", "left_anti").select("v", F.col("v").alias("root"))
    return named.unionByName(alone)


def consolidate(edges: DataFrame) -> DataFrame:
    """Groups of passages of a table of matches: (book_id, global_start, group_book_id, group_global_start).

    A passage is (book_id, global_start) of either side of a row whose four key columns are all non-null; other rows count
    for nothing. The group is named by its smallest passage. The two numbers are packed into one bigint that keeps their
    order; where their ranges are too wide for that, passages are numbered in order instead.
    """
    e = edges.select(*(F.col(f"{s}_{c}").cast("bigint").alias(f"{s[0]}_{c}") for s in ("source", "target") for c in ("book_id", "global_start"))).dropna()
    sides = [e.select(F.col(f"{s}_book_id").alias("book_id"), F.col(f"{s}_global_start").alias("global_start")) for s in "st"]
    both = sides[0].unionAll(sides[1])
    b0, b1, g0, g1 = both.agg(F.min("book_id"), F.max("book_id"), F.min("global_start"), F.max("global_start")).first()
    if b0 is None:
        return both.select("book_id", "global_start", F.col("book_id").alias("group_book_id"), F.col("global_start").alias("group_global_start"))
    bits = (g1 - g0).bit_length()
    if bits + (b1 - b0).bit_length() <= 62:
        pack = lambda b, g: F.shiftleft(F.col(b) - F.lit(b0), bits).bitwiseOR(F.col(g) - F.lit(g0))
        out = components(e.select(pack("s_book_id", "s_global_start").alias("u"), pack("t_book_id", "t_global_start").alias("v")))
        open_ = lambda c: (F.shiftright(F.col(c), bits) + F.lit(b0), F.col(c).bitwiseAND(F.lit((1 << bits) - 1)) + F.lit(g0))
        (b, g), (gb, gg) = open_("v"), open_("root")
        return out.select(b.alias("book_id"), g.alias("global_start"), gb.alias("group_book_id"), gg.alias("group_global_start"))
    places = cut(numbered(both.distinct(), ["book_id", "global_start"]))
    e = cut(e)
    for s in "st":
        e = e.join(places.select(F.col("book_id").alias(f"{s}_book_id"), F.col("global_start").alias(f"{s}_global_start"), F.col("no").alias(f"{s}_no")), [f"{s}_book_id", f"{s}_global_start"])
    out = components(e.select(F.col("s_no").alias("u"), F.col("t_no").alias("v")))
    of = places.select(F.col("book_id").alias("group_book_id"), F.col("global_start").alias("group_global_start"), F.col("no").alias("root"))
    return out.join(places.withColumnRenamed("no", "v"), "v").join(of, "root").select("book_id", "global_start", "group_book_id", "group_global_start")


def numbered(df: DataFrame, order: list[str]) -> DataFrame:
    """Rows with ``no``, their rank in the order of distinct columns, by range partitions and their counts."""
    ranged = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).select(*order, F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("mono")))
    counts = sorted(ranged.groupBy("part").agg(F.count("*"), F.min("mono")).collect())  # one row per partition
    spark, total, rows = df.sparkSession, 0, []
    for part, n, first in counts:
        rows.append((part, total - first))
        total += n
    shift = spark.createDataFrame(rows, "part int, shift bigint")
    return ranged.join(F.broadcast(shift), "part").select(*order, (F.col("mono") + F.col("shift")).alias("no"))
