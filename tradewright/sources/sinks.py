"""Sinks: named extracts, long metric tables, review lists and published score tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_extracts(tables: dict[str, DataFrame], folder: str) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")


def read_extract(spark, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}")


def metrics_long(df: DataFrame, report: str) -> DataFrame:
    """A one-row result as (report, metric, value) rows, stored as text-free numbers."""
    cols = df.columns
    pairs = ", ".join(f"'{c}', cast(`{c}` as double)" for c in cols)
    return df.selectExpr(f"stack({len(cols)}, {pairs}) as (metric, value)").select(F.lit(report).alias("report"), "metric", "value")


def write_metrics(df: DataFrame, folder: str) -> None:
    df.write.mode("append").json(folder)


def review_list(df: DataFrame, value: str, key: str, limit: int = 300) -> DataFrame:
    return df.orderBy(F.col(value).desc(), F.col(key).asc()).limit(limit)


def write_review_list(df: DataFrame, folder: str) -> None:
    """Semicolon file people correct line by line; at most a few hundred rows."""
    df.coalesce(1).write.mode("overwrite").option("header", "true").option("sep", ";").csv(folder)


def write_scores(df: DataFrame, folder: str, key: str) -> None:
    df.repartition(key).sortWithinPartitions(key).write.mode("overwrite").parquet(folder)
