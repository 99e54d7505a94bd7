"""Reading tables: parquet folders, pushed predicates, literal rows, system views."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def views(spark: SparkSession, sf_dir: str, text: str = " ".join(TABLES)) -> None:
    """Temporary views of the tables that a text names."""
    for name in TABLES:
        if re.search(rf"\b{name}\b", text, re.IGNORECASE):
            table(spark, sf_dir, name).createOrReplaceTempView(name)


def scan(spark: SparkSession, path: str, columns: list[str] | None = None, where: Column | None = None, fmt: str = "parquet", **options) -> DataFrame:
    """Only the columns asked for, with the predicate where the format can take it."""
    df = spark.read.format(fmt).options(**options).load(path)
    df = df.where(where) if where is not None else df
    return df.select(*columns) if columns else df


def point_lookup(df: DataFrame, column: str, value) -> DataFrame:
    return df.where(F.col(column) == value)


def range_lookup(df: DataFrame, column: str, low=None, high=None) -> DataFrame:
    """Both ends included; None is open."""
    df = df.where(F.col(column) >= low) if low is not None else df
    return df.where(F.col(column) <= high) if high is not None else df


def values(spark: SparkSession, rows: list[tuple], ddl: str) -> DataFrame:
    return spark.createDataFrame(rows, ddl)


def information_schema(spark: SparkSession, frames: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """tables and columns of the frames given, as DataFrames."""
    tables = [("default", n, "BASE TABLE") for n in frames]
    columns = [(n, f.name, i + 1, f.dataType.simpleString(), "YES" if f.nullable else "NO") for n, d in frames.items() for i, f in enumerate(d.schema.fields)]
    return {
        "tables": spark.createDataFrame(tables, "table_schema string, table_name string, table_type string"),
        "columns": spark.createDataFrame(columns, "table_name string, column_name string, ordinal_position int, data_type string, is_nullable string"),
    }
