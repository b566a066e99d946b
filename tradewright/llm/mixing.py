"""Mixing sources to target weights by capped water-filling.

Each source asks for a share of the budget by weight. Sources asked for more than `epochs` times their size are
clamped there, and what they leave is shared again by weight until no source is above its cap. A source is then
repeated whole as often as its target allows, and its fraction is a prefix of its documents in a seeded order, so
the words taken come within one document of the target and reruns agree.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradewright.llm.common import SPACE, carried, global_rank, text_or_empty
from tradewright.session import cut_lineage

WEIGHTS = (3, 1, 2)
EPOCHS = 2
SHARE = (3, 2)                 # budget as a fraction of all sizes
SEED = "mix-1"
ROWS_PER_BUCKET = 20_000
SMALL_PLAN = 50_000            # sources up to which the plan is broadcast


def word_count(text: Column) -> Column:
    bare = F.trim(text, F.lit(SPACE))
    return F.when(bare == "", F.lit(0)).otherwise(F.size(F.split(bare, r"[\x20\x09-\x0D]+"))).cast("long")


def order_key(seed: str = SEED) -> Column:
    """The place of a document in its source's seeded order."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))


def fill(sources: DataFrame, epochs: int = EPOCHS, share: tuple[int, int] = SHARE) -> DataFrame:
    """Adds `target` to (…, source_size, weight). Whole numbers up to the last division, so the order of sums is of no effect.

    One row of sums reaches the driver in each round, and a round clamps at least one more source.
    """
    up, down = share
    state = cut_lineage(sources.withColumn("clamped", F.col("source_size") == 0))
    while True:
        s = state.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("all"), F.coalesce(F.sum(F.when(F.col("clamped"), F.col("source_size"))), F.lit(0)).alias("full"),
                      F.coalesce(F.sum(F.when(~F.col("clamped"), F.col("weight"))), F.lit(0)).alias("weights"), F.count_if("clamped").alias("n")).first()
        num, den = up * int(s["all"]) - down * epochs * int(s["full"]), down * int(s["weights"])
        if den == 0:
            break
        big = lambda c, by: F.col(c).cast("decimal(19,0)") * F.lit(by).cast("decimal(19,0)")
        state = cut_lineage(state.withColumn("clamped", F.col("clamped") | (big("weight", num) > big("source_size", epochs * den))))
        if state.where("clamped").count() == s["n"]:
            break
    level = (F.col("weight").cast("double") * F.lit(float(num)) / F.lit(float(den))) if den else F.lit(0.0)
    return state.withColumn("target", F.when(F.col("clamped"), (F.col("source_size") * epochs).cast("double")).otherwise(level)).drop("clamped")


def mix_plan(docs: DataFrame, weights: Sequence[int] = WEIGHTS, epochs: int = EPOCHS, share: tuple[int, int] = SHARE, seed: str = SEED) -> DataFrame:
    """One row per source: source, source_size, target, `whole` repetitions of every document and the last order key of one more (`last_key`)."""
    sized = cut_lineage(docs.select("source", order_key(seed).alias("key"), word_count(text_or_empty()).alias("size")))
    ranked = global_rank(sized.groupBy("source").agg(F.sum("size").alias("source_size")), ["source"])
    weight = F.element_at(F.lit(list(weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    plan = fill(ranked.select("source", "source_size", weight.cast("long").alias("weight")), epochs, share)
    plan = plan.withColumn("whole", F.when(F.col("source_size") == 0, 0).otherwise(F.floor(F.col("target") / F.col("source_size")))).withColumn(
        "rest", F.col("target") - F.col("whole") * F.col("source_size"))
    # rows per bucket stay the same at any size: the bucket is as many hex digits of the key as it takes
    digits, rows = 0, sized.count()
    while rows > ROWS_PER_BUCKET * 16 ** digits:
        digits += 1
    keyed = sized.groupBy("source", "key").agg(F.sum("size").alias("size")).withColumn("bucket", F.substring("key", 1, digits))
    totals = keyed.groupBy("source", "bucket").agg(F.sum("size").alias("size"))
    before = totals.withColumn("before", F.sum("size").over(Window.partitionBy("source").orderBy("bucket")) - F.col("size"))
    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    crossed = before.join(plan, same(before, plan)).where((F.col("rest") > 0) & (F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + F.col("size"))).select(
        before["source"], "bucket", "before", "rest")
    inner = Window.partitionBy("__tw_source", "bucket").orderBy("key")
    met = (keyed.withColumnRenamed("source", "__tw_source").withColumnRenamed("bucket", "__tw_bucket")
           .join(crossed, F.col("__tw_source").eqNullSafe(F.col("source")) & (F.col("__tw_bucket") == F.col("bucket")))
           .withColumn("upto", F.col("before") + F.sum("size").over(inner)))
    # the document on the line is taken if that comes nearer to the target
    inside = F.max(F.when(2 * F.col("upto") - F.col("size") <= 2 * F.col("rest"), F.col("key")))
    last = met.groupBy("source", "bucket").agg(inside.alias("key")).select(F.col("source").alias("__tw_source"), F.coalesce("key", "bucket").alias("last_key"))
    out = plan.join(last, F.col("source").eqNullSafe(F.col("__tw_source")), "left").select("source", "source_size", "target", F.col("whole").cast("long"), F.coalesce("last_key", F.lit("")).alias("last_key"))
    return cut_lineage(out)


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, epochs: int = EPOCHS, share: tuple[int, int] = SHARE, seed: str = SEED) -> DataFrame:
    """The documents with size, source_size, target and `repeats` (0 to `epochs` times each) added.

    Size is the number of words; a null or empty text has size 0, takes no words and is repeated like its source.
    Sources stand by code point with null last. Equal doc_ids share one place in the order, so repeated rows are
    taken together. An empty table gives no rows. Columns named like a result give way to it.
    """
    plan = mix_plan(docs, weights, epochs, share, seed).withColumnRenamed("source", "__tw_source")
    made = ("size", "source_size", "target", "repeats")
    if plan.count() <= SMALL_PLAN:              # beyond it a sort-merge join, whose hot sources are split by the adaptive skew join
        plan = F.broadcast(plan)
    joined = docs.join(plan.withColumnsRenamed({"source_size": "__tw_size", "target": "__tw_target"}), docs["source"].eqNullSafe(F.col("__tw_source")))
    return joined.select(*carried(docs, *made), word_count(text_or_empty()).alias("size"), F.col("__tw_size").alias("source_size"), F.col("__tw_target").alias("target"),
                         (F.col("whole") + (order_key(seed) <= F.col("last_key")).cast("long")).alias("repeats"))
