"""Files in and out: flow CSV with its header checked, pinned schemas, atomic Parquet, small reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.tables import shared_folder  # noqa: F401
from ..operators.validate import Contract, InvalidInput, check_columns, check_header, validate


def read_flow_csv(spark: SparkSession, path: str, contract: Contract) -> DataFrame:
    """Validated rows of a flow CSV.  The header is read raw, as Spark would rename repeated columns."""
    first = spark.read.text(path).limit(1).collect()
    names = check_header(first[0].value if first else None)
    check_columns(names, contract)
    schema = StructType([StructField(n, StringType()) for n in names])
    return validate(spark.read.schema(schema).option("header", True).option("encoding", "UTF-8").csv(path), contract)


def pinned_csv_schema(spark: SparkSession, path: str) -> StructType:
    """The schema that all rows of a CSV fit, to be read with from then on."""
    return spark.read.option("header", True).option("inferSchema", True).csv(path).schema


def write_table(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """Compressed Parquet, refused if the folder exists; the committer makes it appear whole."""
    w = df.write.mode("errorifexists").option("compression", "zstd")
    (w.partitionBy(*by) if by else w).parquet(path)


def write_report(df: DataFrame, path: str) -> None:
    """A small aggregate as one CSV file with a header."""
    df.coalesce(1).write.mode("errorifexists").option("header", True).csv(path)


def write_summary(df: DataFrame, path: str) -> None:
    """A one-row run summary as JSON."""
    df.coalesce(1).write.mode("errorifexists").json(path)


def with_row_id(spark: SparkSession, path: str) -> DataFrame:
    """Rows of Parquet files with their file and place in it."""
    return spark.read.parquet(path).select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row_id"))


def routed(df: DataFrame, time: str, day: str) -> DataFrame:
    """``df`` with ``on_day``: whether the row's time, a timestamp or ISO text, is on that calendar day."""
    return df.withColumn("on_day", F.coalesce(F.col(time).cast("string").startswith(day), F.lit(False)))


def write_by_day(df: DataFrame, path: str, time: str) -> None:
    """Parquet in a folder a calendar day, so that readers of one day read only its files."""
    write_table(df.withColumn("capture_date", F.to_date(time)), path, ["capture_date"])


def read_day(spark: SparkSession, path: str, day: str, expected: int | None = None) -> DataFrame:
    """Rows of one day of `write_by_day`; refused if they are not as many as expected."""
    out = spark.read.parquet(path).where(F.col("capture_date") == F.lit(day).cast("date")).drop("capture_date")
    if expected is not None and (n := out.count()) != expected:
        raise InvalidInput(f"{n} rows on {day}, not {expected}")
    return out
