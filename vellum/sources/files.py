"""Corpora as Parquet and results as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.errors import CorpusError


def read_corpus(spark: SparkSession, folder: str, *tables: str) -> list[DataFrame]:
    """Tables of a folder of Parquet tables, by name."""
    return [spark.read.parquet(f"{folder.rstrip('/')}/{t}.parquet") for t in tables]


def read_result(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(header, edges) of a JSON result. CorpusError if one of book_a, book_b or edges is missing."""
    doc = spark.read.option("multiLine", True).json(path)
    missing = [c for c in ("book_a", "book_b", "edges") if c not in doc.columns]
    if missing:
        raise CorpusError(f"{path} lacks {', '.join(missing)}")
    edges = doc.select(F.explode("edges").alias("e"))
    return doc.drop("edges"), edges.select("e.*") if edges.schema["e"].dataType.typeName() == "struct" else edges.filter("false")
