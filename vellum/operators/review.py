"""Reviewing edges: filter, search, sort, label, export."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions.text import BANDS, band, diversity_label


@dataclass(frozen=True)
class View:
    """What to show. Sort keys: core_similarity, span_coverage, content_weight, similarity, length, position, id."""

    min_similarity: float = 0.0
    min_length: int = 0
    min_core_similarity: float = 0.0
    min_span_coverage: float = 0.0
    min_content_weight: float = 0.0
    search: str = ""
    sort_by: str = "core_similarity"
    descending: bool = True

    def toggled(self, key: str) -> View:
        """Another key sorts by it from the top; the same key turns the order."""
        from dataclasses import replace

        return replace(self, descending=not self.descending) if key == self.sort_by else replace(self, sort_by=key, descending=True)


def _metric(name: str) -> Column:
    c = F.col
    return {
        "core_similarity": F.coalesce(c("core_similarity"), c("lemma_similarity")),
        "span_coverage": F.coalesce(c("span_coverage"), F.lit(1).cast("float")),
        "content_weight": F.coalesce(c("content_weight"), c("avg_match_weight"), F.lit(1).cast("float")),
        "similarity": c("lemma_similarity"), "length": c("aligned_length"), "position": c("source_global_start"), "id": c("id"),
    }[name]


def view_edges(edges: DataFrame, view: View, source_text: str = "source_text", target_text: str = "target_text") -> DataFrame:
    """The rows that pass; older records without a metric fall back on similarity, 1 and 1. A search needs the text columns."""
    out = edges.filter(~F.coalesce(_metric("similarity") < F.lit(view.min_similarity).cast("float"), F.lit(False)) & ~F.coalesce(F.col("aligned_length") < view.min_length, F.lit(False)))
    for name in ("core_similarity", "span_coverage", "content_weight"):
        out = out.filter(~F.coalesce(_metric(name) < F.lit(getattr(view, f"min_{name}")).cast("float"), F.lit(False)))
    if view.search:
        out = out.filter(F.coalesce(F.col(source_text).contains(view.search), F.lit(False)) | F.coalesce(F.col(target_text).contains(view.search), F.lit(False)))
    return out


def sort_edges(edges: DataFrame, view: View) -> DataFrame:
    key = _metric(view.sort_by)
    return edges.orderBy(key.desc() if view.descending else key.asc(), "id")


def top_edges(edges: DataFrame, n: int, view: View | None = None) -> tuple[DataFrame, int]:
    """The first ``n`` edges in the view's order, and how many more there are."""
    return sort_edges(edges, view or View()).limit(n), max(0, edges.count() - n)


def _shown(name: str) -> Column:
    """The value the reference's match list bands; unlike ``_metric`` it takes a weight of 1 even where avg_match_weight is given."""
    absent = {"core_similarity": F.col("lemma_similarity"), "span_coverage": F.lit(1).cast("float"), "content_weight": F.lit(1).cast("float"), "lexical_diversity": F.lit(0).cast("float")}
    return F.coalesce(F.col(name), absent[name]) if name in absent else F.col(name)


def with_labels(edges: DataFrame) -> DataFrame:
    """Adds diversity_label and a band (high, medium, low) for each shown metric. A null metric falls back on similarity, 1, 1
    and 0 as in the reference's match list; a null similarity is low."""
    return edges.withColumns({"diversity_label": diversity_label(_shown("lexical_diversity")), **{f"{c}_band": band(_shown(c), *b) for c, b in BANDS.items()}})


def validated(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Edges with the reviewer's label (id, validation: 'valid' or 'noise'); null where there is none."""
    return edges.join(labels.select("id", "validation").dropDuplicates(["id"]), "id", "left")


def validation_counts(labels: DataFrame) -> DataFrame:
    return labels.agg(F.count_if(F.col("validation") == "valid").alias("valid"), F.count_if(F.col("validation") == "noise").alias("noise"))


def validated_export(nested: DataFrame, labels: DataFrame) -> DataFrame:
    """The labelled ones of nested edges as the flat table that is exported; metrics have four decimals."""
    a = lambda c: F.col(f"alignment.{c}")
    four = lambda c: F.format_string("%.4f", c)
    e = nested.join(labels.select("id", "validation").filter("validation is not null and validation <> ''").dropDuplicates(["id"]), "id")
    one = F.lit(1).cast("float")
    return e.select("id", "validation", F.col("source.location").alias("source_location"), F.col("source.text.matched").alias("source_text"), F.col("target.location").alias("target_location"), F.col("target.text.matched").alias("target_text"), a("length").alias("length"), a("lemma_matches").alias("lemma_matches"), F.coalesce(a("substitutions"), F.lit(0)).alias("substitutions"), a("gaps").alias("gaps"), four(F.coalesce(a("core_similarity"), a("similarity"))).alias("core_similarity"), four(F.coalesce(a("span_coverage"), one)).alias("span_coverage"), four(F.coalesce(a("content_weight"), one)).alias("content_weight"), four(a("similarity")).alias("similarity"))


def short_export(nested: DataFrame, labels: DataFrame) -> DataFrame:
    """The labelled ones of nested edges in five columns: id, validation, both texts and the similarity as it is."""
    e = nested.join(labels.select("id", "validation").filter("validation is not null and validation <> ''").dropDuplicates(["id"]), "id")
    return e.select("id", "validation", F.col("source.text.matched").alias("source_text"), F.col("target.text.matched").alias("target_text"), F.col("alignment.similarity").alias("similarity"))
