"""Text of edges, with context."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.functions.pages import KEY
from vellum.functions.text import span_location
from vellum.operators.positions import page_ranges

BUCKET = 4096


def page_surfaces(decoded: DataFrame, dim: DataFrame) -> DataFrame:
    """(page key, surfaces) of decoded pages; a token without a definition or surface is ''."""
    tokens = decoded.select(*KEY, F.posexplode("token_ids").alias("at", "token_id"))
    met = tokens.join(dim.select("token_id", "surface"), "token_id", "left")
    return met.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("at", F.coalesce("surface", F.lit("")).alias("s")))).alias("t")).select(*KEY, F.col("t.s").alias("surfaces"))


def passages(spans: DataFrame, decoded: DataFrame, dim: DataFrame, context: int = 30) -> DataFrame:
    """(book_id, start, end, text) for spans (book_id, start, end): text before, in and after each span of its book.

    A span meets only the pages that it and its context touch, in a bucketed range join; no book is gathered. A span beyond its
    book has empty texts.
    """
    s = spans.select("book_id", "start", "end").dropna().distinct()
    sized = decoded.withColumn("n", F.size("token_ids").cast("bigint")).filter("n > 0")
    ranges = page_ranges(sized.select(*KEY, "n")).select(*(F.col(k).alias(f"r_{k}") for k in KEY), "page_start", "page_end", F.explode(F.sequence(F.expr(f"page_start div {BUCKET}"), F.expr(f"(page_end - 1) div {BUCKET}"))).alias("bucket"))
    wide = s.withColumn("lo", F.greatest(F.col("start") - context, F.lit(0))).withColumn("hi", F.col("end") + context)
    wide = wide.withColumn("b", F.explode(F.sequence(F.expr(f"lo div {BUCKET}"), F.expr(f"greatest(hi - 1, lo) div {BUCKET}"))))
    hit = wide.join(ranges, (F.col("book_id") == F.col("r_book_id")) & (F.col("b") == F.col("bucket")) & (F.col("page_start") < F.col("hi")) & (F.col("page_end") > F.col("lo"))).drop("b", "bucket").distinct()
    # only pages that some span touches are spelled out
    need = hit.select(*(F.col(f"r_{k}").alias(k) for k in KEY)).distinct()
    text = page_surfaces(sized.join(need, KEY, "left_semi"), dim).select(*(F.col(k).alias(f"t_{k}") for k in KEY), "surfaces")
    part = hit.join(text, [F.col(f"r_{k}") == F.col(f"t_{k}") for k in KEY])
    # texts travel as strings, and once: the groups are those of the join that follows; null if nothing of the page is in the range
    start, end, first, last = (F.col(x) for x in ("start", "end", "page_start", "page_end"))
    piece = lambda x, y: F.when(F.greatest(x, first) < F.least(y, last), F.array_join(F.slice("surfaces", (F.greatest(x, first) - first + 1).cast("int"), F.greatest(F.least(y, last) - F.greatest(x, first), F.lit(0)).cast("int")), " "))
    pieces = part.select("book_id", "start", "end", F.struct("page_start", piece(F.col("lo"), start).alias("before"), piece(start, end).alias("matched"), piece(end, F.col("hi")).alias("after")).alias("p"))
    whole = pieces.groupBy("book_id", "start", "end").agg(F.array_sort(F.collect_list("p")).alias("p"))
    out = whole.select("book_id", "start", "end", F.struct(*(F.array_join(F.col(f"p.{x}"), " ").alias(x) for x in ("before", "matched", "after"))).alias("text"))
    return s.join(out, ["book_id", "start", "end"], "left").withColumn("text", F.coalesce("text", F.struct(*(F.lit("").alias(x) for x in ("before", "matched", "after")))))


def edges_with_text(edges: DataFrame, decoded: DataFrame, dim: DataFrame, context: int = 30) -> DataFrame:
    """Edges as nested records: id, source, target (book_id, location, global_range, text), alignment."""
    sides = [edges.select(F.col(f"{s}_book_id").alias("book_id"), F.col(f"{s}_global_start").alias("start"), F.col(f"{s}_global_end").alias("end")) for s in ("source", "target")]
    text = passages(sides[0].unionAll(sides[1]), decoded, dim, context)
    out = edges
    for s in ("source", "target"):
        t = text.select(F.col("book_id").alias("tb"), F.col("start").alias("ts"), F.col("end").alias("te"), F.col("text").alias(f"{s}_text"))
        out = out.join(t, (F.col(f"{s}_book_id") == F.col("tb")) & (F.col(f"{s}_global_start") == F.col("ts")) & (F.col(f"{s}_global_end") == F.col("te")), "left").drop("tb", "ts", "te")
    ref = lambda s: F.struct(F.col(f"{s}_book_id").alias("book_id"), span_location(F.col(f"{s}_start_page"), F.col(f"{s}_start_offset"), F.col(f"{s}_end_page"), F.col(f"{s}_end_offset")).alias("location"), F.struct(F.col(f"{s}_global_start").alias("start"), F.col(f"{s}_global_end").alias("end")).alias("global_range"), F.col(f"{s}_text").alias("text")).alias(s)
    al = F.struct(F.col("aligned_length").alias("length"), *("lemma_matches substitutions root_only_matches gaps core_similarity span_coverage content_weight lexical_diversity".split()), F.col("lemma_similarity").alias("similarity"), "combined_similarity", "weighted_similarity", "avg_match_weight").alias("alignment")
    return out.select("id", ref("source"), ref("target"), al)
