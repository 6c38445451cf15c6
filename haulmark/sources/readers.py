"""Scans."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType

from haulmark.functions.nulls import as_col
from haulmark.functions.text import blank_to_null


def scan(
    table: DataFrame,
    columns: Mapping[str, str | Column] | Sequence[str],
    where: Column | None = None,
) -> DataFrame:
    """Filter then project. Both reach a Parquet or JDBC scan by pushdown."""
    rows = table if where is None else table.filter(where)
    if not isinstance(columns, Mapping):
        return rows.select(*columns)
    return rows.select(*[as_col(c).alias(name) for name, c in columns.items()])


def read_csv(
    spark: SparkSession,
    path: str,
    schema: StructType,
    null_tokens: Sequence[str] = (),
    multi_line: bool = False,
    renames: Mapping[str, str] | None = None,
    by_position: bool = False,
) -> DataFrame:
    """Headed CSV under a declared schema.

    ``NA`` with or without padding, an empty field and each of ``null_tokens`` are
    missing. Whole numbers may be written like ``2e3``, so they are read as doubles
    first. An unreadable number and a header that differs from the schema are errors;
    ``renames`` maps the schema's names to those of another vintage of the file, and
    ``by_position`` skips the header, for files that repeat a name. ``multi_line`` makes a
    file one task; use it only for files with line breaks inside quotes.
    """
    renames = renames or {}
    as_read = StructType(
        [
            StructField(renames.get(f.name, f.name), DoubleType() if isinstance(f.dataType, IntegerType) else f.dataType)
            for f in schema
        ]
    )
    reader = _csv_options(spark).schema(as_read).option("multiLine", multi_line).option("mode", "FAILFAST")
    rows = reader.option("enforceSchema", by_position).csv(path).toDF(*schema.names)
    return rows.select(*[_cleaned(f, null_tokens) for f in schema])


def read_csv_columns(
    spark: SparkSession, path: str, schema: StructType, null_tokens: Sequence[str] = ()
) -> DataFrame:
    """The named columns of a wide headed CSV, read as text and then cast."""
    rows = _csv_options(spark).csv(path)
    text = [StructField(f.name, StringType()) for f in schema]
    cleaned = rows.select(*[_cleaned(f, null_tokens) for f in text])
    number = {f.name: "double" for f in schema if isinstance(f.dataType, IntegerType)}
    return cleaned.select(
        *[F.col(f.name).cast(number.get(f.name, f.dataType)).cast(f.dataType).alias(f.name) for f in schema]
    )


def _csv_options(spark: SparkSession) -> DataFrameReader:
    return (
        spark.read.option("header", True)
        .option("nullValue", "NA")
        .option("ignoreLeadingWhiteSpace", True)
        .option("ignoreTrailingWhiteSpace", True)
    )


def _cleaned(field: StructField, null_tokens: Sequence[str]) -> Column:
    c = F.col(f"`{field.name}`")
    if isinstance(field.dataType, IntegerType):
        c = c.cast("int")
    elif isinstance(field.dataType, StringType):
        c = blank_to_null(c, *null_tokens)
    return c.alias(field.name)


def grouped_number(c: str | Column) -> Column:
    """``7,817,236`` as a number."""
    return F.regexp_replace(as_col(c), ",", "").try_cast("double")


def inline_series(
    spark: SparkSession,
    tags: Mapping[str, str],
    first_year: int,
    values: Sequence[float],
    value_name: str,
    year_name: str = "year",
) -> DataFrame:
    """A short annual series written in the code: one row per value.

    Built from literals, so its size is known to the optimizer.
    """
    points = F.array(*[F.lit(float(v)) for v in values])
    return (
        spark.range(1)
        .select(*[F.lit(v).alias(k) for k, v in tags.items()], F.posexplode(points).alias("_i", value_name))
        .select(*tags, (F.col("_i") + F.lit(first_year)).cast("int").alias(year_name), value_name)
    )
