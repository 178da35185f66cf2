"""Fixed cases of the comparison's parts."""

import math

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from vellum.errors import BookNotFound, CorpusError
from vellum.functions.text import decode_u32, diversity_label, encode_u32, page_label, page_location, truncate_text
from vellum.operators import edges as E
from vellum.operators import review as R
from vellum.operators import stats, tokens, weights, windows
from vellum.operators.passages import edges_with_text, passages
from vellum.operators.positions import page_ranges, page_sizes
from vellum.params import Params
from vellum.plans import catalogue
from vellum.plans.compare import compare, compare_lemmas
from vellum.schemas import COUNTS, EDGE_COLUMNS, EDGES, METRICS, PAGE_TOKENS, TOKEN_DEFINITIONS
from vellum.sinks.files import edges_report, flat_edges, flat_edges_with_text, result_header, summary_report, write_csv_file, write_result_file
from vellum.sinks.viewer import viewer_html, write_viewer_file
from vellum.sources.files import read_result
from vellum.sources.sqlite import read_table

PAGES = "book_id bigint, part_index bigint, page_id bigint, lemma_ids array<bigint>, root_ids array<bigint>"


def book(spark, *books):
    """Books as (id, lemma ids, tokens per page)."""
    out = []
    for b, ids, per in books:
        out += [(b, 1, k // per + 1, list(ids[k : k + per]), [0] * len(ids[k : k + per])) for k in range(0, len(ids), per)]
    return spark.createDataFrame(out, PAGES)


def edge(id_, s0, s1, t0=None, t1=None, a=1, b=2, **k):
    n = s1 - s0
    row = dict.fromkeys(EDGE_COLUMNS, 0) | dict.fromkeys(METRICS, 0.0) | {"id": id_, "source_book_id": a, "target_book_id": b, "source_global_start": s0, "source_global_end": s1, "target_global_start": s0 if t0 is None else t0, "target_global_end": s1 if t1 is None else t1, "aligned_length": n, "lemma_matches": n, "lemma_similarity": 1.0}
    for s in ("source", "target"):
        for e in ("start", "end"):
            row[f"{s}_{e}_page"] = (1, 1)
    return tuple((row | k)[c] for c in EDGE_COLUMNS)


def edges(spark, *e):
    return spark.createDataFrame(list(e), EDGES)


def test_blobs(spark):
    df = spark.createDataFrame([(b"\x01\0\0\0\x02\0\0\0\xff\0\0\0",), (b"\xff\xff\xff\xff",), (b"",), (b"abc",), (None,)], "t binary")
    assert [r[0] for r in df.select(decode_u32(F.col("t"))).collect()] == [[1, 2, 255], [4294967295], [], [], []]
    assert df.limit(1).select(encode_u32(decode_u32(F.col("t")))).first()[0] == b"\x01\0\0\0\x02\0\0\0\xff\0\0\0"


@pytest.mark.parametrize(
    ("n", "size", "stride", "want"),
    [(0, 275, 60, []), (50, 275, 60, [(0, 50)]), (275, 275, 275, [(0, 275)]), (275, 275, 60, [(0, 275), (60, 275)]), (500, 275, 60, [(0, 275), (60, 335), (120, 395), (180, 455), (240, 500)])],
)
def test_windows(spark, n, size, stride, want):
    p = Params(window_size=size, stride=stride)
    w = windows.token_windows(book(spark, (1, range(n), 70)), p)
    assert [(r.global_start, r.global_end) for r in w.orderBy("window_idx").collect()] == want
    assert all(r.lemma_ids == list(range(r.global_start, r.global_end)) for r in w.collect())
    assert spark.range(1).select(windows.window_count(F.lit(n), p)).first()[0] == len(want)
    assert [(r.global_start, r.global_end) for r in windows.window_ranges(spark.createDataFrame([(1, n)], "book_id bigint, length bigint"), p).orderBy("window_idx").collect()] == want


def test_window_places_and_tiling(spark):
    w = windows.token_windows(book(spark, (1, range(400), 100)), Params(window_size=150, stride=50)).orderBy("window_idx").collect()
    assert (tuple(w[0].start_page), tuple(w[0].end_page), w[0].end_offset) == ((1, 1), (1, 2), 49)
    t = windows.token_windows(book(spark, (1, range(1000), 100)), Params(window_size=100, stride=50)).orderBy("window_idx").collect()
    assert len(t) == 20 and (t[-1].global_start, t[-1].global_end) == (950, 1000)


def test_parameters():
    for bad in ({"stride": 0}, {"mode": "x"}, {"window_size": 0}, {"ngram_size": 0}, {"gap_penalty": 1}):
        with pytest.raises(ValueError):
            Params(**bad)
    assert set(Params(no_filters=True, min_weighted_similarity=0.1).bounds()) == {"weighted_similarity"} and len(Params().bounds()) == 4


@pytest.mark.parametrize(("ids", "n", "count"), [([], 3, 0), ([1, 2], 3, 0), ([1, 2, 3], 3, 1), ([1, 2, 3, 4, 5], 3, 3), ([1, 2, 1, 2, 1, 2], 2, 2), (list(range(10)), 3, 8), (list(range(10)), 20, 0)])
def test_shingles(spark, ids, n, count):
    df = spark.createDataFrame([(1, 0, ids)], "book_id bigint, window_idx bigint, lemma_ids array<bigint>")
    assert windows.shingles(df, n).count() == count


def test_candidates(spark):
    w = spark.createDataFrame([(1, 0, list(range(1, 11))), (1, 1, list(range(100, 110))), (2, 0, [*range(1, 6), *range(200, 205)]), (2, 1, list(range(300, 310)))], "book_id bigint, window_idx bigint, lemma_ids array<bigint>")
    p = Params(ngram_size=3, min_shared_shingles=2)
    pairs = spark.createDataFrame([(1, 2)], "book_a bigint, book_b bigint")
    assert rows(windows.candidate_pairs(w, p)) == rows(windows.candidate_pairs(w, p, pairs)) == [(1, 0, 2, 0, 3)]
    assert windows.all_window_pairs(w).count() == 4
    assert windows.filter_rate(w, windows.candidate_pairs(w, p)).first().rate_ppm == 750000
    q = spark.range(1).select(*(windows.quick_similarity(F.array(*map(F.lit, range(20))), F.array(*map(F.lit, range(10, 30))), k) for k in (5, 10, 15))).first()
    assert tuple(q) == (True, True, False)


def test_weights(spark):
    got = {r.lemma_id: r.weight for r in weights.lemma_weights(book(spark, (1, [1, 1, 1, 1, 2, 2, 3], 3))).collect()}
    assert got == {k: pytest.approx(v, abs=1e-6) for k, v in {1: 0.55961579, 2: 1.25276291, 3: 1.94591010}.items()}
    ends = {r.lemma_id: r.weight for r in weights.lemma_weights(book(spark, (1, [5] * 9, 4), (2, [*range(500)], 90))).collect()}
    assert ends[5] in (0.5, 3.0) and ends[77] == 3.0


def merged(spark, *e, slack=0):
    return sorted((r.id, r.source_global_start, r.source_global_end, r.target_global_start, r.target_global_end, r.lemma_matches) for r in E.merge_edges(edges(spark, *e), slack).collect())


def test_merge(spark):
    assert len(merged(spark, edge(1, 0, 100), edge(2, 200, 300))) == 2
    assert merged(spark, edge(1, 0, 100), edge(2, 50, 150)) == [(1, 0, 150, 0, 150, 150)]
    assert merged(spark, edge(1, 0, 100), edge(2, 50, 150), edge(3, 100, 200)) == [(1, 0, 200, 0, 200, 200)]
    chain = [edge(1, 0, 100), edge(2, 50, 150), edge(3, 100, 200), edge(4, 120, 220, 900, 950), edge(5, 130, 230, 140, 200)]
    assert [x[:5] for x in merged(spark, *chain)] == [(1, 0, 200, 0, 200), (4, 120, 220, 900, 950), (5, 130, 230, 140, 200)]
    assert len(merged(spark, edge(1, 0, 100), edge(2, 50, 150, 200, 300))) == 2
    assert len(merged(spark, edge(1, 0, 100), edge(2, 100, 200))) == 2
    assert merged(spark) == [] and merged(spark, edge(1, 0, 5, source_global_start=None)) == []


def test_merge_counts(spark):
    k = {"lemma_matches": 90, "root_only_matches": 5, "gaps": 5, "lemma_similarity": 0.9, "weighted_similarity": 0.9, "aligned_length": 100}
    r = E.merge_edges(edges(spark, edge(1, 0, 100, **k), edge(2, 50, 150, **k))).first()
    assert (r.aligned_length, r.lemma_matches, r.root_only_matches, r.gaps) == (150, 135, 8, 5)
    assert [round(x, 6) for x in (r.core_similarity, r.span_coverage, r.combined_similarity, r.weighted_similarity)] == [1.0, 0.9, 0.926667, 0.9]


def test_merge_extras(spark):
    near, far = [edge(1, 0, 100), edge(2, 105, 200)], [edge(1, 0, 100), edge(2, 150, 200)]
    assert E.merge_adjacent_edges(edges(spark, *near), 10).count() == 1 and E.merge_adjacent_edges(edges(spark, *far), 10).count() == 2
    assert [r.id for r in E.remove_subsumed_edges(edges(spark, edge(1, 0, 200), edge(2, 50, 150))).collect()] == [1]
    assert [r.id for r in E.remove_subsumed_edges(edges(spark, edge(4, 0, 200), edge(3, 0, 200))).collect()] == [3]


def test_coverage(spark):
    r = spark.createDataFrame([(1, 0, 50), (1, 25, 75), (1, 100, 150), (2, 0, 100), (2, 100, 200)], "k bigint, start bigint, end bigint")
    assert rows(E.covered_ranges(r, ["k"])) == [(1, 0, 75), (1, 100, 150), (2, 0, 200)]
    c = E.coverage(edges(spark, edge(1, 0, 50), edge(2, 25, 75)), spark.createDataFrame([(1, 100), (2, 0)], "book_id bigint, length bigint")).first()
    assert (c.coverage_a, c.coverage_b) == (0.75, 0.0)
    own = E.coverage(edges(spark, edge(1, 0, 50, 60, 70, b=1)), spark.createDataFrame([(1, 100)], "book_id bigint, length bigint")).first()
    assert own.coverage_a == own.coverage_b == 0.5


def shared(b, total, s, at):
    s = list(s)
    return [b * 100000 + i if i < at else s[i - at] if i < at + len(s) else b * 100000 + 50000 + i for i in range(total)]


CASES = [
    ("identical", range(500), range(500), 100, 50, 28, (0, 500, 0, 500, 500)),
    ("disjoint", range(500), range(10000, 10500), 100, 50, 0, None),
    ("partial", shared(1, 500, range(1000, 1100), 200), shared(2, 500, range(1000, 1100), 150), 50, 25, 13, (200, 300, 150, 250, 100)),
    ("long", shared(1, 1000, range(1000, 1050), 400), shared(2, 1000, range(1000, 1050), 500), 100, 50, 4, (400, 450, 500, 550, 50)),
    ("small", range(50), range(50), 100, 50, 1, (0, 50, 0, 50, 50)),
]


@pytest.mark.parametrize("case", CASES, ids=lambda c: c[0])
def test_whole_comparisons(spark, case):
    _, a, b, size, stride, n, want = case
    c = compare_lemmas(book(spark, (1, list(a), 120), (2, list(b), 120)), Params(window_size=size, stride=stride, no_filters=True))
    assert c.candidates.count() == n
    got = [(r.source_global_start, r.source_global_end, r.target_global_start, r.target_global_end, r.lemma_matches) for r in c.edges.collect()]
    assert got == ([want] if want else [])
    assert E.filter_edges(c.edges, Params()).count() == 0  # unweighted edges have no content weight


@pytest.fixture
def corpus(spark, blob):
    pages = [(1, 1, k + 1, bytearray(blob(*range(k * 100, k * 100 + 100)))) for k in range(5)] + [(2, 1, k + 1, bytearray(blob(*range(k * 100, k * 100 + 100)))) for k in range(5)]
    pages += [(1, 1, 1, pages[0][3]), (2, 1, 9, None), (2, 1, 8, bytearray(b"abc"))]
    defs = [(i, f"w{i}", i + 1, None if i % 2 else i, None, 1, 1) for i in range(499)] + [(0, "w0", 1, 0, None, 1, 1)]
    return spark.createDataFrame(pages, PAGE_TOKENS), spark.createDataFrame(defs, TOKEN_DEFINITIONS)


def test_weighted_comparison_and_outputs(spark, corpus, tmp_path):
    t, d = corpus
    p = Params(window_size=100, stride=50)
    c = compare(t, d, p)
    e = c.edges.collect()
    assert len(e) == 1 and (e[0].source_global_start, e[0].source_global_end, e[0].content_weight) == (0, 500, 3.0)
    assert compare(t, d, Params(window_size=100, stride=50, brute_force=True)).edges.count() == 1
    nested = edges_with_text(c.edges, tokens.decoded_pages(t), tokens.token_dim(d), 3)
    r = nested.first()
    assert r.source.text.matched.startswith("w0 w1 ") and r.source.text.before == "" and r.alignment.length == 500
    info = stats.book_info(t, tokens.page_lemmas(t, tokens.token_dim(d)))
    h = result_header(p, c.summary, info, 1, 2, generated_at="2024-01-01T00:00:00Z")
    assert "Edges found: 1" in summary_report(h) and "(untitled)" in summary_report(h) and h["book_a"]["token_count"] == 500
    write_result_file(h, nested, tmp_path / "r.json")
    header, back = read_result(spark, str(tmp_path / "r.json"))
    assert back.count() == 1 and header.first().version == h["version"]
    (tmp_path / "bad.json").write_text('{"edges": []}')
    with pytest.raises(CorpusError):
        read_result(spark, str(tmp_path / "bad.json"))
    assert write_csv_file(flat_edges(c.edges), tmp_path / "e.csv") == 1 and len((tmp_path / "e.csv").read_text().splitlines()[0].split(",")) == 31
    assert write_csv_file(flat_edges(c.edges.filter("false")), tmp_path / "n.csv") == 0 and len((tmp_path / "n.csv").read_text().splitlines()) == 1
    assert len(flat_edges_with_text(nested).columns) == 19
    assert "Source: w0 w1" in edges_report(nested, text=True)
    write_viewer_file(h, nested, tmp_path / "v.html")
    page = (tmp_path / "v.html").read_text()
    assert "Book 1 ↔ Book 2" in page and "{{" not in page and "http" not in page
    assert "<\\/script>" in viewer_html(h, ['{"x": "</script>"}'])
    out = R.validated_export(nested, spark.createDataFrame([(0, "valid"), (7, "noise")], "id bigint, validation string"))
    assert len(out.columns) == 14 and out.first().core_similarity == "1.0000"


def test_streams_and_stats(spark, corpus):
    t, d = corpus
    dim = tokens.token_dim(d)
    s = tokens.token_stream(t, dim)
    assert s.count() == 1000 and s.filter("token_id = 499 and lemma_id = 0 and surface = ''").count() == 2
    assert tokens.lemma_stream(t, dim).count() == 998  # ids above the largest defined one are dropped
    assert rows(tokens.bad_pages(t)) == [(2, 1, 8)]
    joined = tokens.page_lemmas(t, dim, limit=0)
    assert rows(joined.select("book_id", "page_id", "lemma_ids", "root_ids")) == rows(tokens.page_lemmas(t, dim).select("book_id", "page_id", "lemma_ids", "root_ids"))
    st = stats.corpus_stats(t, d).first()
    assert (st.book_count, st.page_count, st.token_count, st.definition_count) == (2, 12, 1000, 499)
    info = stats.book_info(t, tokens.page_lemmas(t, dim))
    with pytest.raises(BookNotFound):
        stats.one_book_info(info, 99)
    assert stats.one_book_info(info, 1).first().unique_lemmas == 500
    labels = spark.createDataFrame([(1, 1, 1, "I", "7"), (1, 1, 2, "I", None)], "book_id bigint, part_index bigint, page_id bigint, part_label string, page_number string")
    assert {r.page_id: r.label for r in stats.book_pages(t, labels).filter("book_id = 1").collect()} == {1: "7", 2: "I", 3: "-", 4: "-", 5: "-"}
    ranges = page_ranges(page_sizes(t))
    at = E.position_to_page(spark.createDataFrame([(1, 110), (1, 499), (1, 500), (2, 0)], "book_id bigint, pos bigint"), ranges)
    assert rows(at) == [(1, 110, 1, 2, 10), (1, 499, 1, 5, 99), (2, 0, 1, 1, 0)]
    p = passages(spark.createDataFrame([(1, 98, 102), (1, 495, 500), (3, 0, 5)], "book_id bigint, start bigint, end bigint"), tokens.decoded_pages(t), dim, 2)
    got = {(r.book_id, r.start): tuple(r.text) for r in p.collect()}
    assert got[1, 98] == ("w96 w97", "w98 w99 w100 w101", "w102 w103") and got[1, 495][2] == "" and got[3, 0] == ("", "", "")


def test_empty_tables(spark):
    t, d = spark.createDataFrame([], PAGE_TOKENS), spark.createDataFrame([], TOKEN_DEFINITIONS)
    c = compare(t, d)
    assert c.edges.count() == 0 and c.summary.count() == 0 and tokens.token_stream(t, tokens.token_dim(d)).count() == 0
    assert stats.corpus_stats(t, d).first().token_count == 0


def test_formats(spark):
    one = spark.range(1)
    pick = lambda *c: tuple(one.select(*c).first())
    assert pick(page_location(F.lit(1), F.lit(10), F.lit(5)), page_location(F.lit(0), F.lit(0), F.lit(0))) == ("1:10.5", "0:0.0")
    assert pick(truncate_text(F.lit("a" * 10), 10), truncate_text(F.lit("é" * 11), 10)) == ("a" * 10, "é" * 7 + "...")
    assert pick(diversity_label(F.lit(0.5)), page_label(F.lit(None).cast("string"), F.lit("x"))) == ("formulaic", "x")
    e = edges(spark, edge(1, 10, 110, 200, 300, a=100, b=200, aligned_length=100, lemma_matches=85, substitutions=5, root_only_matches=5, gaps=5, core_similarity=0.944, span_coverage=0.9, content_weight=1.5, lexical_diversity=0.7))
    text = edges_report(e, 1)
    for part in ("Edge 1", "Book 100", "Book 200", "len=100", "matches=85", "subs=5", "Core: 94.4%", "Coverage: 90.0%", "Weight: 1.50"):
        assert part in text
    assert "... and 1 more edges" in edges_report(e.unionAll(e), 1)


def test_review(spark):
    e = edges(spark, edge(1, 0, 10, core_similarity=0.95), edge(2, 0, 30, core_similarity=None, lemma_similarity=0.5), edge(3, 0, 20, core_similarity=0.6))
    v = R.View(min_core_similarity=0.55)
    assert [r.id for r in R.sort_edges(R.view_edges(e, v), v).collect()] == [1, 3]
    assert [r.id for r in R.top_edges(e, 2, R.View(sort_by="length"))[0].collect()] == [2, 3]
    assert v.toggled("core_similarity").descending is False and v.toggled("id").sort_by == "id"
    named = e.withColumn("source_text", F.lit("abc")).withColumn("target_text", F.lit(None).cast("string"))
    assert R.view_edges(named, R.View(search="bc")).count() == 3 and R.view_edges(named, R.View(search="x")).count() == 0
    labels = spark.createDataFrame([(1, "valid"), (2, "noise"), (3, None)], "id bigint, validation string")
    assert tuple(R.validation_counts(labels).first()) == (1, 1) and R.validated(e, labels).filter("validation is null").count() == 1


def test_sqlite(spark, tmp_path, blob):
    import sqlite3

    db = sqlite3.connect(tmp_path / "c.db")
    db.execute("create table page_tokens (book_id integer, part_index integer, page_id integer, token_ids blob, primary key (book_id, part_index, page_id))")
    db.executemany("insert into page_tokens values (?, 1, ?, ?)", [(b, k, blob(1, 2, k)) for b in (1, 2) for k in range(5)])
    db.execute("create table empty_one (id integer, x text)")
    db.commit()
    df = read_table(spark, str(tmp_path / "c.db"), "page_tokens", 3)
    assert dict(df.dtypes)["token_ids"] == "binary" and df.filter("book_id = 2 and page_id >= 3").count() == 2 and df.count() == 10
    assert read_table(spark, str(tmp_path / "c.db"), "page_tokens", book_id=1).count() == 5
    assert read_table(spark, str(tmp_path / "c.db"), "empty_one").count() == 0
    with pytest.raises(Exception, match="no table"):
        read_table(spark, str(tmp_path / "c.db"), "nothing").count()


def test_stream(spark, corpus, tmp_path):
    from vellum.streaming.arrivals import page_rate, shingle_index, stream_candidates

    t, d = corpus
    p, dim = Params(window_size=100, stride=50), tokens.token_dim(d)
    index = shingle_index(tokens.page_lemmas(t.filter("book_id = 1"), dim), p)
    src = str(tmp_path / "in")
    t.filter("book_id = 2").withColumn("loaded_at", F.lit("2024-01-01 00:00:00").cast("timestamp")).write.parquet(src)
    stream = spark.readStream.schema(spark.read.parquet(src).schema).parquet(src)
    stream_candidates(stream, dim, index, p, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 28
    q = page_rate(spark.readStream.schema(spark.read.parquet(src).schema).parquet(src)).writeStream.format("memory").queryName("rate").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("rate").first().tokens == 500


def test_metrics_have_single_precision(spark):
    r = E.with_metrics(spark.createDataFrame([(3, 1, 1, 1, 1, 0, 1.5)], "pairs bigint, gaps bigint, lemma_matches bigint, substitutions bigint, unique_lemmas bigint, root_only_matches bigint, match_weight_sum float")).first()
    assert r.core_similarity == 0.5 and r.span_coverage == 0.5 and math.isclose(r.weighted_similarity, 0.375) and len(COUNTS) == 5


def test_labels_of_edges_without_metrics(spark, tmp_path):
    full = dict(core_similarity=0.95, span_coverage=0.5, content_weight=1.6, lexical_diversity=0.8)
    e = edges(spark, edge(1, 0, 10, **full), edge(2, 0, 10, **full | {"content_weight": None, "avg_match_weight": 2.0}), edge(3, 0, 10, **dict.fromkeys(full)), edge(4, 0, 10, **dict.fromkeys(full), lemma_similarity=None))
    e.write.parquet(str(tmp_path / "edges.parquet"))
    got = catalogue.edge_labels_bands(spark, str(tmp_path)).select("id", "diversity_label", *(f"{c}_band" for c in ("core_similarity", "span_coverage", "content_weight", "lexical_diversity", "lemma_similarity")))
    assert rows(got) == [
        (1, "substantive", "high", "medium", "high", "high", "high"), (2, "substantive", "high", "medium", "medium", "high", "high"),
        (3, "formulaic", "high", "high", "medium", "low", "high"), (4, "formulaic", "low", "high", "medium", "low", "low"),
    ]


def test_passages_of_both_sides(spark, corpus, tmp_path):
    t, d = corpus
    t.write.parquet(str(tmp_path / "page_tokens.parquet")), d.write.parquet(str(tmp_path / "token_definitions.parquet"))
    edges(spark, edge(1, 100, 103, 40, 42), edge(2, 100, 103, 40, 42), edge(3, 5, 5, 100, 103, b=1)).write.parquet(str(tmp_path / "edges.parquet"))
    got = {tuple(r)[:3]: r for r in catalogue.passages_with_context(spark, str(tmp_path)).collect()}
    assert sorted(got) == [(1, 100, 103), (2, 40, 42)]
    r = got[2, 40, 42]
    assert (r.text_before, r.text_matched, r.text_after) == tuple(" ".join(f"w{k}" for k in range(*x)) for x in ((10, 40), (40, 42), (42, 72)))


def test_flat_export_holds_all_columns(spark, tmp_path):
    values = {m: k / 8 for k, m in enumerate(METRICS)}
    edges(spark, edge(1, 10, 30, **values | {"content_weight": None})).write.parquet(str(tmp_path / "edges.parquet"))
    out = catalogue.flat_export(spark, str(tmp_path))
    r = out.first()
    assert len(out.columns) == 31 and out.columns[-12:-7] == COUNTS and (r.source_start_page, r.source_global_end, r.lemma_matches) == (1, 30, 20)
    assert list(r)[-7:] == [None if m == "content_weight" else int(values[m] * 1000000) for m in METRICS[:-1]]
