"""Sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """Headed CSV directory with missing values written as ``NA``."""
    df.write.mode(mode).option("header", True).option("nullValue", "NA").csv(path)
    return path


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    df.write.mode(mode).parquet(path)
    return path


def spanned_path(df: DataFrame, prefix: str, year: str = "year", suffix: str = "") -> str:
    """``prefix_<first year>_<last year>suffix``; two scalars reach the driver."""
    span = df.agg(F.min(year).cast("int").alias("lo"), F.max(year).cast("int").alias("hi")).first()
    return f"{prefix}_{span.lo}_{span.hi}{suffix}"


def write_spanned_csv(df: DataFrame, prefix: str, year: str = "year", suffix: str = "") -> str:
    """CSV under ``spanned_path``'s name in one pass: the span is observed while the rows are written.

    The directory is written beside its final name and renamed, so it appears complete; one
    of that name is replaced.
    """
    span = Observation()
    observed = df.observe(span, F.min(year).cast("int").alias("lo"), F.max(year).cast("int").alias("hi"))
    written = write_csv(observed, f"{prefix}_being_written{suffix}")
    found = span.get
    path = f"{prefix}_{found['lo']}_{found['hi']}{suffix}"
    paths = df.sparkSession._jvm.org.apache.hadoop.fs.Path
    source, target = paths(written), paths(path)
    files = source.getFileSystem(df.sparkSession._jsc.hadoopConfiguration())
    files.delete(target, True)
    if not files.rename(source, target):
        raise OSError(f"could not rename {written} to {path}")
    return path


def write_and_keep(df: DataFrame, path: str) -> DataFrame:
    """Write in the middle of a chain and go on from the written table.

    Later steps read the stored result, so nothing upstream runs again.
    """
    write_parquet(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
