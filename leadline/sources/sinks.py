"""Sinks and lazily built tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def round_doubles(df: DataFrame, digits: int = 6) -> DataFrame:
    """Half-even rounding of every floating column."""
    return df.select(
        *[
            F.bround(F.col(f"`{name}`"), digits).alias(name) if kind in ("double", "float") else F.col(f"`{name}`")
            for name, kind in df.dtypes
        ]
    )


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = ()) -> None:
    """Overwrite ``path``; CSV gets a header and no index column."""
    writer = df.write.mode("overwrite").format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


def write_rounded(df: DataFrame, path: str, fmt: str = "parquet", digits: int = 6) -> None:
    write_table(round_doubles(df, digits), path, fmt)


def table_exists(spark: SparkSession, path: str) -> bool:
    """True when a finished write left its success marker at ``path``."""
    marker = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/_SUCCESS")
    return marker.getFileSystem(spark._jsc.hadoopConfiguration()).exists(marker)


def ensure_table(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """Read the table at ``path``, building and writing it first if it is not there."""
    if not table_exists(spark, path):
        write_table(build(), path)
    return spark.read.parquet(path)


def stack(frames: Sequence[DataFrame]) -> DataFrame:
    """Union by column name; columns a frame lacks are null."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out
