"""File sources and sinks.

Reads use explicit schemas (no inference pass); dirty inputs are read as
all-string columns so bad cells survive (S7).  Writes are partitioned tables
instead of one file per corruption or batch (S16, S17), so later reads prune
partitions.  Paths go through the Hadoop FileSystem API: any scheme works.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


def string_schema(columns: Sequence[str]) -> StructType:
    """Every column a string, so dirty cells are kept as text."""
    return StructType([StructField(c, StringType(), True) for c in columns])


def read_csv(spark: SparkSession, path: str, schema: StructType | str, header: bool = True) -> DataFrame:
    """CSV with an explicit schema; malformed values become null
    (typed) or stay text (all-string schema)."""
    return spark.read.schema(schema).option("header", header).option("mode", "PERMISSIVE").csv(path)


def read_json(spark: SparkSession, path: str, schema: StructType | str, min_partitions: int | None = None) -> DataFrame:
    """JSON lines (gzip is decoded transparently but not splittable:
    spread the rows afterwards when asked)."""
    df = spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)
    return df.repartition(min_partitions) if min_partitions else df


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def first_existing(spark: SparkSession, paths: Sequence[str]) -> str:
    """The first path that exists, else FileNotFoundError."""
    for p in paths:
        if exists(spark, p):
            return p
    raise FileNotFoundError(f"none of {list(paths)} exists")


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV with a header."""
    df.write.mode(mode).option("header", True).csv(path)


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "overwrite",
                  small: bool = False) -> None:
    """Parquet, optionally partitioned (one table, many
    partitions, overwritten partition by partition).  ``small``: a partition's rows are few enough for
    one task, so they are dealt out by partition and each is one file, not one of every task."""
    if small and partition_by:
        df = df.repartition(*partition_by)
    w = df.write.mode(mode).option("partitionOverwriteMode", "dynamic")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def write_json(df: DataFrame, path: str, compression: str | None = None, mode: str = "overwrite") -> None:
    """JSON lines (one object per row; nested structs kept)."""
    w = df.write.mode(mode)
    if compression:
        w = w.option("compression", compression)
    w.json(path)


def files_with_counts(df: DataFrame) -> DataFrame:
    """Row count per input file (one aggregation)."""
    return df.groupBy(F.input_file_name().alias("file")).agg(F.count(F.lit(1)).alias("rows"))
