"""Command line: compare, stats, info, benchmark over a folder of Parquet tables or a SQLite file."""

from __future__ import annotations

import argparse
from dataclasses import fields

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession

from vellum.errors import CorpusError
from vellum.operators import stats, tokens
from vellum.params import Params


def _tables(spark, corpus: str, *names: str, books: list[int] | None = None):
    """Tables of the corpus; of those with a book_id only the rows of ``books`` if they are named."""
    if corpus.endswith((".db", ".sqlite", ".sqlite3")):
        from vellum.sources.sqlite import read_table

        return [read_table(spark, corpus, n, book_id=books if n in ("page_tokens", "pages") else None) for n in names]
    from vellum.sources.files import read_corpus

    read = read_corpus(spark, corpus, *names)
    return read if books is None else [t.filter(t.book_id.isin(books)) if "book_id" in t.columns else t for t in read]


def _page_labels(spark, corpus: str, book: int):
    """The corpus's labels of pages; none if it has no such table."""
    from vellum.schemas import PAGES

    try:
        return _tables(spark, corpus, "pages", books=[book])[0].select("book_id", "part_index", "page_id", "page_number", "part_label")
    except (AnalysisException, CorpusError):
        return spark.createDataFrame([], PAGES)


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="vellum")
    sub = top.add_subparsers(dest="command", required=True)
    c = sub.add_parser("compare")
    for a, kind in (("corpus", str), ("book_a", int), ("book_b", int), ("output", str)):
        c.add_argument(a, type=kind)
    c.add_argument("--format", choices=["json", "csv", "viewer"], default="json")
    c.add_argument("--csv", help="also write a CSV file")
    c.add_argument("--include-text", action=argparse.BooleanOptionalAction, default=True)
    c.add_argument("--context-tokens", type=int, default=30)
    c.add_argument("--quiet", action="store_true")
    c.add_argument("--show-edges", type=int, default=0)
    for f in fields(Params):
        name = "--" + f.name.replace("_", "-")
        if f.name == "no_filters":
            c.add_argument(name, action="store_true")
        elif isinstance(f.default, bool):
            c.add_argument(name, action=argparse.BooleanOptionalAction, default=f.default)
        else:
            c.add_argument(name, type=float if f.default is None else type(f.default), default=f.default)
    sub.add_parser("stats").add_argument("corpus")
    i = sub.add_parser("info")
    i.add_argument("corpus")
    i.add_argument("book", type=int)
    i.add_argument("--show-pages", action="store_true")
    b = sub.add_parser("benchmark")
    b.add_argument("--iterations", type=int, default=1000)
    b.add_argument("--size", type=int, default=275)
    return top


def _compare(spark, a) -> None:
    from vellum.functions.text import utc_now
    from vellum.operators.passages import edges_with_text
    from vellum.plans.compare import compare
    from vellum.sinks.files import edges_report, flat_edges, flat_edges_with_text, result_header, summary_report, write_csv_file, write_result_file
    from vellum.sinks.viewer import write_viewer_file

    t, d = _tables(spark, a.corpus, "page_tokens", "token_definitions", books=[a.book_a, a.book_b])
    p = Params(**{f.name: getattr(a, f.name) for f in fields(Params)})
    pairs = spark.createDataFrame([(a.book_a, a.book_b)], "book_a bigint, book_b bigint")
    c = compare(t, d, p, pairs)
    dim = tokens.token_dim(d)
    info = stats.book_info(t, tokens.page_lemmas(t, dim))
    now = spark.range(1).select(utc_now()).first()[0] if a.include_text else None
    header = result_header(p, c.summary, info, a.book_a, a.book_b, generated_at=now)
    out = edges_with_text(c.edges, tokens.decoded_pages(t), dim, a.context_tokens) if a.include_text or a.format == "viewer" else c.edges
    flat = flat_edges_with_text(out) if a.include_text else flat_edges(c.edges)
    if a.format == "viewer":
        write_viewer_file(header, out, a.output)
    elif a.format == "csv":
        write_csv_file(flat, a.output)
    else:
        write_result_file(header, out, a.output)
    if a.csv:
        write_csv_file(flat, a.csv)
    if not a.quiet:
        print(summary_report(header))
    if a.show_edges:
        print(edges_report(out, a.show_edges, a.include_text))


def main(argv: list[str] | None = None) -> None:
    a = _parser().parse_args(argv)
    if a.command == "benchmark":
        from bench.align_speed import main as speed

        return speed(a.iterations, a.size)
    spark = SparkSession.builder.appName("vellum").getOrCreate()
    if a.command == "compare":
        return _compare(spark, a)
    own, d = _tables(spark, a.corpus, "page_tokens", "token_definitions", books=None if a.command == "stats" else [a.book])
    if a.command == "stats":
        for k, v in stats.corpus_stats(own, d).first().asDict().items():
            print(f"{k}: {v}")
        return None
    row = stats.one_book_info(stats.book_info(own, tokens.page_lemmas(own, tokens.token_dim(d))), a.book).first()
    for k, v in row.asDict().items():
        print(f"{k}: {v}")
    if a.show_pages:
        for r in stats.book_pages(own, _page_labels(spark, a.corpus, a.book)).orderBy("part_index", "page_id").toLocalIterator():
            print(f"{r.part_index}:{r.page_id} {r.label} {r.token_count}")
    return None


if __name__ == "__main__":
    main()
