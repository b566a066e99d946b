"""Small shared pieces of the training-data operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tradewright.session import cut_lineage

SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z, every other character as it is."""
    return F.translate(text, UPPER, LOWER)


def words_of(text: Column) -> Column:
    """Maximal runs of characters other than space and U+0009 to U+000D; none for null."""
    bare = F.trim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+"))


def text_or_empty(text: str = "text") -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def carried(df: DataFrame, *made: str) -> list[Column]:
    """The columns of a table, without those that a result replaces."""
    return [F.col(f"`{c}`") for c in df.columns if c not in made]


def crc_remainder(key: str, modulus: int) -> Column:
    """crc32 of the id written as text, modulo `modulus`; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % modulus


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, comp): the smallest node reachable from each node of an undirected edge list.

    Smallest neighbour labels and pointer jumping alternate until nothing changes; each round is checkpointed.
    Only the number of changed labels reaches the driver.
    """
    both = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    both = cut_lineage(both.union(both.select("v", "u")).distinct())
    labels = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("comp")).select(F.col("u").alias("node"), "comp")
    labels = cut_lineage(labels)
    while True:
        near = (both.join(labels, both.v == labels.node).groupBy("u").agg(F.min("comp").alias("low")))
        step = labels.join(near, labels.node == near.u).select("node", F.least("comp", "low").alias("next"), F.col("comp").alias("was"))
        up = step.select(F.col("node").alias("parent"), F.col("next").alias("above"))
        step = cut_lineage(step.join(up, step.next == up.parent, "left")
                           .select("node", F.least("next", F.coalesce("above", "next")).alias("comp"), "was"))
        changed = step.where("comp <> was").limit(1).count()
        labels = step.select("node", "comp")
        if not changed:
            return labels


def global_rank(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """Adds `rank` (from 0) in the order of the columns, without a window over all rows.

    Rows are dealt by range; a partition's rank starts where the counts of the partitions before it end.
    """
    from pyspark.sql import Window
    dealt = df.repartitionByRange(*[F.asc_nulls_last(c) for c in order]).withColumn("_part", F.spark_partition_id())
    dealt = cut_lineage(dealt)
    counts = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))   # one row per partition
    inner = Window.partitionBy("_part").orderBy(*[F.asc_nulls_last(c) for c in order])
    return (dealt.join(F.broadcast(before), "_part")
            .withColumn("rank", F.col("_before") + F.row_number().over(inner) - 1).drop("_part", "_before"))
