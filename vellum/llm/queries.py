"""The queries of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions.cut import cut, spread_join
from vellum.llm import components, distinctive, frequency, leakage, lookalike, neardup, packing, pii, spans, split


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def p1_found(s, d):
    return components.consolidate(_t(s, d, "edges"))


def p2_found(s, d):
    out = distinctive.distinctive_terms(_t(s, d, "page_tokens"), _t(s, d, "token_definitions"))
    return out.filter("score is not null and tf >= 6 and df between 2 and 3").select("book_id", "lemma_id")


def p2_scores(s, d):
    out = distinctive.distinctive_terms(_t(s, d, "page_tokens"), _t(s, d, "token_definitions"))
    return out.withColumn("score", F.round("score", 4))


def p3_found(s, d):
    out = frequency.marked_terms(_t(s, d, "page_tokens"), _t(s, d, "token_definitions"))
    return out.filter("mark in ('rare', 'common')").select("kind", "term_id", "mark")


def p3_counts(s, d):
    return frequency.marked_terms(_t(s, d, "page_tokens"), _t(s, d, "token_definitions"))


def p4_found(s, d):
    return spans.shared_stretches(_t(s, d, "page_tokens"))


def p4_shares(s, d):
    return spans.shared_fraction(_t(s, d, "page_tokens"))


def p4_kept(s, d):
    """Each page's tokens without those that a later copy of a run covers."""
    out = spans.without_later(_t(s, d, "page_tokens"))
    ids = F.concat_ws(",", F.transform("token_ids", lambda x: x.cast("string")))
    return out.select("book_id", "part_index", "page_id", F.size("token_ids").cast("bigint").alias("n_kept"), ids.alias("kept"))


def p5_found(s, d):
    return split.split_windows(_t(s, d, "windows"), _t(s, d, "page_tokens"))


def p5_halves(s, d):
    return split.split_windows(_t(s, d, "windows"), _t(s, d, "page_tokens"), how=split.bisect)


def p6_found(s, d):
    return lookalike.lookalike_pairs(_t(s, d, "token_definitions"))


def p6_forms(s, d):
    return lookalike.canonical_surfaces(_t(s, d, "token_definitions"))


def p7_found(s, d):
    return neardup.near_page_pairs(_t(s, d, "page_lemmas"))


def p7_groups(s, d):
    """Each page with its class (pages of the same content), its group of linked classes and the number of its class's links.
    A class is named by its smallest page, a group by the smallest page of all its classes."""
    members, links = neardup.near_pages(_t(s, d, "page_lemmas"))
    links = cut(links)
    ends = links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("n_links"))
    of = components.components(links.select(F.col("a").alias("u"), F.col("b").alias("v"))).select(F.col("v").alias("rep"), "root")
    page = F.struct("book_id", "part_index", "page_id")
    classes = members.groupBy("rep").agg(F.min(page).alias("class")).join(of, "rep", "left").withColumn("root", F.coalesce("root", "rep")).join(ends, "rep", "left")
    classes = cut(classes)
    groups = classes.groupBy("root").agg(F.min("class").alias("group"), F.count("*").alias("n"))
    named = spread_join(classes, groups, ["root"])
    at = [F.col(f"{x}.{c}").alias(f"{x}_{c}") for x in ("class", "group") for c in ("book_id", "part_index", "page_id")]
    return members.join(named, "rep").select("book_id", "part_index", "page_id", *at, F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"))


def p8_containers(s, d):
    return packing.pack(_t(s, d, "documents"))


def p9_found(s, d):
    return leakage.leaks(_t(s, d, "documents"), _t(s, d, "eval_items")).filter(f"run >= {leakage.RUN}").select("doc_id", "item_id").distinct()


def p9_scores(s, d):
    return leakage.leaks(_t(s, d, "documents"), _t(s, d, "eval_items"), edited=True)


def p10_found(s, d):
    return pii.find(_t(s, d, "documents")).select("doc_id", "kind", "start_pos")


def p10_redacted(s, d):
    return pii.redact(_t(s, d, "documents"))


_ALL = [p1_found, p2_found, p2_scores, p3_found, p3_counts, p4_found, p4_shares, p4_kept, p5_found, p5_halves, p6_found, p6_forms, p7_found, p7_groups, p8_containers, p9_found, p9_scores, p10_found, p10_redacted]


def queries():
    return {f.__name__: f for f in _ALL}
