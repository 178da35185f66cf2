"""Scalar column functions: blobs, labels, formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def decode_u32(blob: Column) -> Column:
    """A little-endian u32 blob as array<bigint>, in JVM expressions. Null, empty and broken blobs give []."""
    h = F.hex(blob)
    one = lambda i: F.conv(F.concat(*(F.substr(h, (8 * i + k).cast("int"), F.lit(2)) for k in (7, 5, 3, 1))), 16, 10).cast("bigint")
    n = F.floor(F.octet_length(blob) / 4)
    whole = (F.octet_length(blob) % 4 == 0) & (F.octet_length(blob) > 0)
    return F.when(whole, F.transform(F.sequence(F.lit(0).cast("bigint"), n - 1), one)).otherwise(F.array().cast("array<bigint>"))


def encode_u32(ids: Column) -> Column:
    """array<bigint> as a little-endian u32 blob."""
    pad = lambda x: F.lpad(F.hex(x), 8, "0")
    one = lambda x: F.concat(*(F.substring(pad(x), k, 2) for k in (7, 5, 3, 1)))
    return F.unhex(F.array_join(F.transform(ids, one), ""))


def page_location(part: Column, page: Column, offset: Column) -> Column:
    """``part:page.offset``."""
    return F.format_string("%d:%d.%d", part, page, offset)


def span_location(start: Column, start_offset: Column, end: Column, end_offset: Column) -> Column:
    """``part:page.offset → part:page.offset`` of two page structs."""
    return F.concat(page_location(start["part_index"], start["page_id"], start_offset), F.lit(" → "), page_location(end["part_index"], end["page_id"], end_offset))


def truncate_text(text: Column, most: int) -> Column:
    """At most ``most`` characters, the last three of them dots if anything was cut."""
    return F.when(F.char_length(text) <= most, text).otherwise(F.concat(F.left(text, F.lit(most - 3)), F.lit("...")))


def preview(text: Column, most: int = 60) -> Column:
    """The first ``most`` characters, with dots after them if anything was cut."""
    return F.when(F.char_length(text) <= most, text).otherwise(F.concat(F.left(text, F.lit(most)), F.lit("...")))


def diversity_label(diversity: Column) -> Column:
    return F.when(diversity < F.lit(0.55).cast("float"), "formulaic").otherwise("substantive")


def band(value: Column, high: float, medium: float) -> Column:
    return F.when(value >= F.lit(high).cast("float"), "high").when(value >= F.lit(medium).cast("float"), "medium").otherwise("low")


# Lower bounds of the bands high and medium.
BANDS = {"core_similarity": (0.9, 0.7), "span_coverage": (0.7, 0.3), "content_weight": (1.5, 1.0), "lexical_diversity": (0.7, 0.55), "lemma_similarity": (0.9, 0.7)}


def page_label(page_number: Column, part_label: Column) -> Column:
    """The page's number, else its part's label, else a dash."""
    return F.coalesce(page_number, part_label, F.lit("-"))


def saturating_sub(a: Column, b: Column) -> Column:
    return F.greatest(F.lit(0), a - b)


def match_weight(weight: Column) -> Column:
    """The weight of a lemma, 1.0 where it is missing or not positive."""
    return F.coalesce(F.when(weight > 0, weight), F.lit(1.0).cast("float"))


def idf_weight(total: Column, count: Column) -> Column:
    """ln(total / count) within [0.5, 3], as float."""
    return F.least(F.greatest(F.log(total / count), F.lit(0.5)), F.lit(3.0)).cast("float")


def match_score(mode: str, la: Column, lb: Column, ra: Column, rb: Column, lemma: int = 2, root: int = 1, mismatch: int = -1, weight: Column | None = None) -> Column:
    """Score of one pair of positions; with ``weight`` (the smaller of the two) a lemma match scores trunc(lemma * weight)."""
    same = F.lit(lemma) if weight is None else (F.lit(float(lemma)).cast("float") * weight).cast("float").cast("int")
    roots = (ra == rb) & (ra != 0)
    if mode == "lemma":
        return F.when(la == lb, same).otherwise(mismatch)
    if mode == "root":
        return F.when(roots, lemma).otherwise(mismatch)
    return F.when(la == lb, same).when(roots, root).otherwise(mismatch)


def utc_now() -> Column:
    return F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
