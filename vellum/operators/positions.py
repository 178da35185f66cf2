"""Positions of pages in their books."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions.cut import cut, sized_join
from vellum.functions.pages import KEY


def page_sizes(page_tokens: DataFrame) -> DataFrame:
    """(page key, n) with n the tokens of the page: 0 if the blob is null, empty or not a multiple of 4 bytes. Each page once."""
    n = F.when(F.octet_length("token_ids") % 4 == 0, F.expr("octet_length(token_ids) div 4")).otherwise(0)
    return page_tokens.select(*KEY, F.coalesce(n, F.lit(0)).cast("bigint").alias("n")).dropDuplicates(KEY)


def page_ranges(sizes: DataFrame) -> DataFrame:
    """(page key, n, page_start, page_end): where each page stands in its book, end exclusive, by (part_index, page_id).

    A running sum over a book would put a huge book into one task. Pages are range-partitioned instead; each range sums its
    own part of a book, and the sums of the ranges before it, one row per range and book, are added.
    """
    ranged = cut(sizes.repartitionByRange(*KEY).withColumn("rng", F.spark_partition_id()))
    inner = Window.partitionBy("rng", "book_id").orderBy("part_index", "page_id")
    before = Window.partitionBy("book_id").orderBy("rng").rowsBetween(Window.unboundedPreceding, -1)
    shift = ranged.groupBy("rng", "book_id").agg(F.sum("n").alias("s")).withColumn("shift", F.coalesce(F.sum("s").over(before), F.lit(0))).drop("s")
    out = ranged.withColumn("upto", F.sum("n").over(inner))
    out = sized_join(out.filter("book_id is not null"), shift.filter("book_id is not null"), ["rng", "book_id"], "inner")
    return out.select(*KEY, "n", (F.col("shift") + F.col("upto") - F.col("n")).alias("page_start"), (F.col("shift") + F.col("upto")).alias("page_end"))
