"""Cutting lineage and choosing joins by measured size.

Iterative plans are cut by writing a Parquet table into the shared folder the session names in
``spark.checkpoint.dir``. Such a table survives the loss of any executor.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only if it has at most so many bytes by count.
BROADCAST_BYTES = 32 << 20


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder. A local folder of our own is used only on a local master that names none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="vellum-")
    spark.sparkContext.setCheckpointDir(made)
    return made


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back. The files go when the JVM ends, or earlier by ``drop``."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/vellum-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    read = spark.read.schema(df.schema).parquet(path)
    read._vellum_path = path
    return read


def once(df: DataFrame) -> DataFrame:
    """``df`` itself if it was read back by ``cut``, else cut."""
    return df if getattr(df, "_vellum_path", None) else cut(df)


def drop(*tables: DataFrame) -> None:
    """Delete tables made by ``cut`` on which nothing depends any more."""
    for df in tables:
        path = getattr(df, "_vellum_path", None)
        if path:
            sc = df.sparkSession.sparkContext
            at = sc._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)


def tasks_of_few_rows(spark: SparkSession) -> int:
    """Into how many tasks to put rows that are few for the work they are, so that their number doesn't follow their bytes."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)


def sized_join(big: DataFrame, side: DataFrame, on, how: str = "left", row_bytes: int = 48, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Join, broadcasting ``side`` only if its counted rows times ``row_bytes`` fit ``limit``; else a shuffled join."""
    small = side.count() * row_bytes <= limit
    return big.join(F.broadcast(side) if small else side.hint("merge"), on, how)


def spread_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", per: int = 500_000) -> DataFrame:
    """Join with a side that has each key once and, in ``n``, the rows of the left that hold it. A key with more than ``per`` of
    them is split into parts of that size, its one row going to each part; ``n`` itself is left out."""
    right = once(right)
    hot = right.filter(F.col("n") > per).select(*on, F.ceil(F.col("n") / per).cast("int").alias("parts"))
    if hot.isEmpty():
        return left.join(right.drop("n"), on, how)
    # there are at most as many hot keys as rows over ``per``; their table is broadcast only if it is small by count
    part = F.pmod(F.xxhash64(*left.columns), F.coalesce(F.col("parts"), F.lit(1)))
    salted = sized_join(left, hot, on).withColumn("part", part.cast("int")).drop("parts")
    copies = right.withColumn("part", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("n") / per).cast("int"), F.lit(1)) - 1))).drop("n")
    return salted.join(copies, [*on, "part"], how).drop("part")
