"""Tables in and out: CSV, Parquet, literal rows, views; single-file and diagnostic sinks."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A CSV with header; codes stay texts unless the schema says otherwise."""
    reader = spark.read.option("header", True)
    return (reader.schema(schema) if schema else reader).csv(path)


def from_rows(spark: SparkSession, rows: list[tuple], schema: str, view: str | None = None) -> DataFrame:
    df = spark.createDataFrame(rows, schema)
    if view:
        df.createOrReplaceTempView(view)
    return df


def write_csv(df: DataFrame, path: str, single: bool = False) -> None:
    """CSV with header; single puts all rows in one file, for results that are small by nature."""
    (df.coalesce(1) if single else df).write.mode("overwrite").option("header", True).csv(path)


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_text(text: str, path: str) -> None:
    """Reports, rules and graphs as JSON."""
    Path(path).write_text(text)
