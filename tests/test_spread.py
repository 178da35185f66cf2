"""Groups that hold most rows are spread over tasks, and give what small ones give."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tests.conftest import rows
from vellum.functions.cut import spread_join
from vellum.operators import edges as E
from vellum.operators import tokens, windows
from vellum.operators.align import window_alignments
from vellum.params import Params
from vellum.schemas import EDGE_COLUMNS, EDGES, METRICS


def test_numbers_of_a_group_with_most_rows(spark):
    df = spark.range(4000).select(F.when(F.col("id") % 3 > 0, 7).otherwise(F.col("id") % 50).alias("g"), ((F.col("id") * 7919) % 4001).alias("o"), F.lit("x").alias("own"))
    got = E.numbered_within(df, ["g"], ["o"], "n")
    want = {}
    for r in sorted(df.collect(), key=lambda r: (r.g, r.o)):
        want.setdefault(r.g, []).append(r.o)
    assert {(r.g, r.o): r.n for r in got.collect()} == {(g, o): k for g, os in want.items() for k, o in enumerate(os)}
    # small ranges are put together again; without that, as with large ones, the group is several tasks
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    stored = E._ranged(df, ["g"], ["o"])
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert stored.groupBy("rng").count().agg(F.max("count")).first()[0] < 0.6 * 4000 and stored.select("rng").distinct().count() > 1
    assert E.numbered_within(df.filter("false"), ["g"], ["o"], "n").count() == 0


def test_join_of_a_key_with_most_rows(spark):
    left = spark.range(3000).select(F.when(F.col("id") % 3 > 0, 7).otherwise(F.col("id") % 50).alias("g"), "id")
    right = left.groupBy("g").agg(F.count("*").alias("n"), F.max("id").alias("top")).filter("g <> 9")
    for how in ("inner", "left_semi"):
        want, got = left.join(right.drop("n"), ["g"], how), spread_join(left, right, ["g"], how, per=100)
        assert rows(got) == rows(want) and got.columns == want.columns
    salted = spread_join(left, right, ["g"], per=100)
    plan = salted._jdf.queryExecution().toString()
    assert "part" in plan and spread_join(left, right, ["g"], per=10**6)._jdf.queryExecution().toString().count("pmod") == 0


def _edge(k, a, b, start, end):
    page = {"part_index": 1, "page_id": 1}
    side = lambda s, book: {f"{s}_book_id": book, f"{s}_start_page": page, f"{s}_start_offset": 0, f"{s}_end_page": page, f"{s}_end_offset": 0, f"{s}_global_start": start, f"{s}_global_end": end}
    return {"id": k, **side("source", a), **side("target", b), "aligned_length": end - start, "lemma_matches": end - start, "substitutions": 0, "root_only_matches": 0, "gaps": 0, **dict.fromkeys(METRICS, 1.0)}


def test_fold_across_batches():
    """Islands of one edge pass unread; those cut by the end of a batch are folded on."""
    rng = np.random.default_rng(0)
    e, at = [], 0
    for k in range(60):
        at += int(rng.integers(1, 20))
        e.append(_edge(k, 1, 2, at, at + 12) | {"island": None})
    island, end = None, -1
    for x in e:
        if x["source_global_start"] >= end:
            island = x["source_global_start"]
        end = max(end, x["source_global_end"])
        x["island"] = island
    kind = {"bigint": pa.int64(), "float": pa.float32()}
    page = pa.struct([("part_index", pa.int64()), ("page_id", pa.int64())])
    schema = pa.schema([(c.split()[0], page if "struct" in c else kind[c.split()[1]]) for c in EDGES.replace("part_index:bigint,page_id:bigint", "").split(", ")] + [("island", pa.int64())])
    table = pa.RecordBatch.from_pylist(e, schema)
    whole = sorted((r["id"], r["source_global_end"]) for b in E._folded(0)([table]) for r in b.to_pylist())
    for size in (1, 2, 3, 7, 59):
        parts = [table.slice(k, size) for k in range(0, 60, size)]
        assert sorted((r["id"], r["source_global_end"]) for b in E._folded(0)(parts) for r in b.to_pylist()) == whole
    assert 1 < len(whole) < 60 and set(EDGE_COLUMNS) <= set(schema.names)


def test_texts_meet_texts(spark):
    text = " ".join(f"word{k}" for k in range(40))
    items = spark.createDataFrame([(-1, text, 1), (-2, None, 1), (-3, "", 1), (-4, text, 1)], "k bigint, text string, book_id int")
    docs = spark.createDataFrame([(1, f"before (that) {text.replace('word7', 'word7,')} after", 1), (2, "nothing of it", 1), (3, None, 1), (4, " \t\n", 1)], "k bigint, text string, book_id int")
    p = Params(use_weights=False)
    a, b = (windows.token_windows(tokens.text_pages(t, "k"), p) for t in (items, docs))
    c = windows.candidates_between(a, b, p)
    assert rows(c) == [(-1, 0, 1, 0, 36), (-4, 0, 1, 0, 36)]
    got = window_alignments(c, a.unionByName(b), p).select("book_a", "book_b", "a_start", "a_end", "b_start", "b_end", "pairs", "lemma_matches")
    assert rows(got) == [(-1, 1, 0, 40, 2, 42, 40, 40), (-4, 1, 0, 40, 2, 42, 40, 40)]
    assert windows.candidates_between(a.filter("false"), b, p).count() == 0


def test_all_window_pair_counts_makes_no_pairs(spark):
    import time

    from vellum.operators.windows import all_window_pair_counts, all_window_pairs

    small = spark.createDataFrame([(b, k) for b, n in ((1, 3), (2, 1), (5, 4)) for k in range(n)], "book_id bigint, window_idx bigint")
    want = small.unionAll(spark.createDataFrame([(None, 0)], small.schema))
    assert rows(all_window_pair_counts(want)) == rows(all_window_pairs(small).groupBy("book_a", "book_b").count()) == [(1, 2, 3), (1, 5, 12), (2, 5, 4)]
    began = time.time()
    large = spark.range(0, 600_000, 1, 4).selectExpr("id % 3 as book_id", "id div 3 as window_idx")
    assert rows(all_window_pair_counts(large)) == [(0, 1, 40_000_000_000), (0, 2, 40_000_000_000), (1, 2, 40_000_000_000)]
    assert time.time() - began < 60


def test_candidates_over_tiles(spark, monkeypatch):
    """Shared shingles are counted tile by tile, without a row for each; a formula in all windows is one of them."""
    rng = np.random.default_rng(8)
    formula = rng.integers(0, 50, 30).tolist()
    data = [(b, k, [*rng.integers(0, 9, 40).tolist(), *(formula if k % 3 else formula[:8])]) for b in range(6) for k in (0, 1, 2, 40, 41)]
    w = spark.createDataFrame([*data, (6, 0, [1, 2]), (None, 0, formula)], "book_id bigint, window_idx bigint, lemma_ids array<bigint>")
    grams = [(b, k, {tuple(x[i : i + 5]) for i in range(len(x) - 4)}) for b, k, x in data]
    for least in (0, 3):
        want = sorted((a, i, b, j, len(x & y)) for a, i, x in grams for b, j, y in grams if a < b and len(x & y) >= max(1, least))
        for tile in (2048, 7):
            monkeypatch.setattr(windows, "TILE", tile)
            got = windows.candidate_pairs(w, Params(min_shared_shingles=least))
            assert sorted(map(tuple, got.collect())) == want


def test_a_shingle_of_all_windows_is_counted_in_place():
    n, g = 1500, 20
    side = np.zeros(n * g, np.int32)
    h = np.tile(np.arange(g), n)
    book, k = np.repeat(np.arange(n), g), np.zeros(n * g, np.int64)
    out = windows._tile_counts([side, h, h, book, k], True, 3)
    assert out.num_rows == n * (n - 1) // 2 and set(out.column("shared").to_pylist()) == {g}
