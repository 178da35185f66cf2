"""Tables and reports as CSV and JSON, as folders of any size or as single files."""

from __future__ import annotations

import csv
import json
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum import __version__
from vellum.functions.text import diversity_label, page_location, truncate_text
from vellum.params import Params
from vellum.schemas import COUNTS, METRICS

# The columns of the flat table with text.
TEXT_COLUMNS = [*(f"{s}_{c}" for s in ("source", "target") for c in ("book_id", "location", "global_start", "global_end", "text_before", "text_matched", "text_after")), "aligned_length", "lemma_matches", "gaps", "similarity"]


def flat_edges(edges: DataFrame) -> DataFrame:
    """Edges as the 31 columns of the CSV: page structs become a part and a page column, avg_match_weight is left out."""
    side = []
    for s in ("source", "target"):
        side.append(F.col(f"{s}_book_id"))
        for e in ("start", "end"):
            side += [F.col(f"{s}_{e}_page.part_index").alias(f"{s}_{e}_part"), F.col(f"{s}_{e}_page.page_id").alias(f"{s}_{e}_page"), F.col(f"{s}_{e}_offset")]
        side += [F.col(f"{s}_global_start"), F.col(f"{s}_global_end")]
    return edges.select("id", *side, *COUNTS, *METRICS[:-1])


def flat_edges_with_text(nested: DataFrame) -> DataFrame:
    """Nested edges as the 19 columns of the CSV with text."""
    side = lambda s: [F.col(f"{s}.book_id").alias(f"{s}_book_id"), F.col(f"{s}.location").alias(f"{s}_location"), F.col(f"{s}.global_range.start").alias(f"{s}_global_start"), F.col(f"{s}.global_range.end").alias(f"{s}_global_end"), *(F.col(f"{s}.text.{t}").alias(f"{s}_text_{t}") for t in ("before", "matched", "after"))]
    a = lambda c, n: F.col(f"alignment.{c}").alias(n)
    return nested.select("id", *side("source"), *side("target"), a("length", "aligned_length"), a("lemma_matches", "lemma_matches"), a("gaps", "gaps"), a("similarity", "similarity"))


def write_csv(flat: DataFrame, folder: str) -> None:
    """A folder of CSV parts, each with a header; quotes are doubled."""
    flat.write.mode("overwrite").option("header", True).option("escape", '"').csv(folder)


def write_csv_file(flat: DataFrame, path: str | Path) -> int:
    """One CSV file with a header, also when there are no rows. Rows are streamed through the driver, one partition at a time."""
    n = 0
    with Path(path).open("w", newline="", encoding="utf-8") as f:
        w = csv.writer(f)
        w.writerow(flat.columns)
        for row in flat.toLocalIterator():
            w.writerow(row)
            n += 1
    return n


def write_json(df: DataFrame, folder: str) -> None:
    df.write.mode("overwrite").json(folder)


def result_header(p: Params, summary: DataFrame, books: DataFrame, book_a: int, book_b: int, titles: dict[int, str] | None = None, generated_at: str | None = None) -> dict:
    """All of the result of one pair of books but its edges."""
    info = {r.book_id: r.asDict() for r in books.filter(F.col("book_id").isin(book_a, book_b)).collect()}
    row = summary.filter((F.col("book_a") == book_a) & (F.col("book_b") == book_b)).first()
    s = row.asDict() if row else {}
    book = lambda b: {"id": b, "title": (titles or {}).get(b, ""), "author": "", "token_count": info.get(b, {}).get("token_count", 0), "page_count": info.get(b, {}).get("page_count", 0)}
    out = {"version": __version__, **({"generated_at": generated_at} if generated_at else {}), "parameters": p.as_dict(), "book_a": book(book_a), "book_b": book(book_b)}
    out["summary"] = {"edge_count": s.get("edge_count", 0), "total_aligned_tokens": s.get("total_aligned_tokens", 0), "book_a_coverage": s.get("coverage_a", 0.0), "book_b_coverage": s.get("coverage_b", 0.0), "avg_similarity": s.get("avg_similarity", 0.0), "avg_weighted_similarity": s.get("avg_weighted_similarity", 0.0)}
    return out


def write_result_file(header: dict, edges: DataFrame, path: str | Path) -> None:
    """One JSON document: the header and its edges, which are streamed into it."""
    body = json.dumps(header, ensure_ascii=False, indent=2)[:-2]
    with Path(path).open("w", encoding="utf-8") as f:
        f.write(body + ',\n  "edges": [')
        for k, row in enumerate(edges.select(F.to_json(F.struct("*")).alias("j")).toLocalIterator()):
            f.write(("," if k else "") + "\n    " + row.j)
        f.write("\n  ]\n}\n")


def edge_text(text: bool = False) -> Column:
    """An edge as lines to read, an absent metric as 'null'; with ``text`` for nested edges and with the first 100 characters of both passages."""
    a = lambda c, flat=None: F.col(f"alignment.{c}" if text else flat or c)
    shown = lambda f, x: F.when(x.isNotNull(), F.format_string(f, x)).otherwise("null")
    per = lambda c: F.concat(shown("%.1f", a(c).cast("double") * 100), F.lit("%"))
    num = lambda c: shown("%.2f", a(c))
    first = F.format_string("Edge %d: len=%d matches=%d subs=%d gaps=%d", F.col("id"), a("length", "aligned_length"), a("lemma_matches"), a("substitutions"), a("gaps"))
    second = F.concat(F.lit("  Core: "), per("core_similarity"), F.lit("  Coverage: "), per("span_coverage"), F.lit("  Weight: "), num("content_weight"), F.lit("  Diversity: "), num("lexical_diversity"), F.lit(" ("), diversity_label(a("lexical_diversity")), F.lit(")"))
    if text:
        third = F.format_string("  Book %d [%s] ↔ Book %d [%s]", F.col("source.book_id"), F.col("source.location"), F.col("target.book_id"), F.col("target.location"))
        return F.concat_ws("\n", first, second, third, *(F.concat(F.lit(f"{s.title()}: "), truncate_text(F.col(f"{s}.text.matched"), 100)) for s in ("source", "target")))
    at = lambda s: F.concat(*(x for e, x in (("start", None), ("end", None)) for x in ((page_location(F.col(f"{s}_{e}_page.part_index"), F.col(f"{s}_{e}_page.page_id"), F.col(f"{s}_{e}_offset")),) if e == "end" else (page_location(F.col(f"{s}_{e}_page.part_index"), F.col(f"{s}_{e}_page.page_id"), F.col(f"{s}_{e}_offset")), F.lit("→")))))
    third = F.concat(F.format_string("  Book %d [", F.col("source_book_id")), at("source"), F.format_string("] ↔ Book %d [", F.col("target_book_id")), at("target"), F.lit("]"))
    return F.concat_ws("\n", first, second, third)


def edges_report(edges: DataFrame, limit: int | None = None, text: bool = False) -> str:
    """Edges as text, the first ``limit`` of them in the order of their ids, and how many more there are."""
    shown = edges.orderBy("id")
    shown = shown if limit is None else shown.limit(limit)
    lines = [r[0] for r in shown.select(edge_text(text)).toLocalIterator()]
    more = 0 if limit is None else edges.count() - limit
    return "\n".join([*lines, *([f"... and {more} more edges"] if more > 0 else [])])


def summary_report(header: dict) -> str:
    """A result's header as text."""
    p, s = header["parameters"], header["summary"]
    dated = "generated_at" in header
    book = lambda x: f"Book {x.upper()}: {header[f'book_{x}']['id']}" + (f" - {header[f'book_{x}']['title'] or '(untitled)'}" if dated else "") + f" ({header[f'book_{x}']['token_count']} tokens)"
    per = lambda x: f"{x * 100:.1f}%"
    out = ["", "== Comparison ==", f"Version: {header['version']}", *([f"Generated: {header['generated_at']}"] if dated else []), "", book("a"), book("b"), "", "With"]
    out += [f"  {label}: {p[key]}" for label, key in (("tokens in a window", "window_size"), ("step between windows", "stride"), ("tokens in a shingle", "ngram_size"), ("least shared shingles", "min_shared_shingles"), ("least length", "min_length"))]
    out += [f"  least similarity: {per(p['min_similarity'])}", f"  all windows compared: {str(p['brute_force']).lower()}", "", "Found", f"  Edges found: {s['edge_count']}", f"  tokens aligned: {s['total_aligned_tokens']}"]
    return "\n".join([*out, f"  share of book A covered: {per(s['book_a_coverage'])}", f"  share of book B covered: {per(s['book_b_coverage'])}", f"  mean similarity: {per(s['avg_similarity'])}"])
