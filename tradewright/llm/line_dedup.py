"""Line deduplication over levelled sorted runs of line hashes.

Documents arrive in batches of ascending doc_id. The keys seen so far live in sorted, bucketed runs; a batch joins
the runs bucket by bucket, drops the lines whose key an earlier batch owns or a smaller doc_id of the batch holds,
and leaves its own new keys as another run. Runs of a level are merged into one of the next level once there are
`fanout` of them, so a batch meets a logarithmic number of runs.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tradewright.llm.common import SPACE, carried, lower_ascii, text_or_empty
from tradewright.session import stored

MIN_CHARS = 10
BATCHES = 4
FANOUT = 2


def line_key(line: Column) -> Column:
    """White space stripped at both ends, A-Z lower-cased."""
    return lower_ascii(F.trim(line, F.lit(SPACE)))


def hashed_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, version, pos, h1, h2) of every line whose key has `min_chars` code points or more."""
    lines = docs.where(F.col("doc_id").isNotNull()).select(
        "doc_id", F.xxhash64(text_or_empty()).alias("version"), F.posexplode(F.split(text_or_empty(), "\n")).alias("pos", "line"))
    keyed = lines.select("doc_id", "version", "pos", line_key(F.col("line")).alias("key")).where(F.length("key") >= min_chars)
    return keyed.select("doc_id", "version", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), "key").alias("h2"))


class LineRuns:
    """The keys of all batches so far: bucketed tables sorted by hash, by level."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT, buckets: int | None = None) -> None:
        self.spark, self.fanout = spark, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []

    def _write(self, keys: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex[:16]}"
        (keys.select("h1", "h2").repartition(self.buckets, "h1", "h2")
         .write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").format("parquet").saveAsTable(name))
        return name

    def _push(self, name: str, level: int = 0) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)
        if len(self.levels[level]) >= self.fanout:
            old, self.levels[level] = self.levels[level], []
            merged = self.spark.table(old[0])
            for other in old[1:]:
                merged = merged.union(self.spark.table(other))
            self._push(self._write(merged), level + 1)
            for table in old:
                self.spark.sql(f"DROP TABLE IF EXISTS {table}")

    def add(self, lines: DataFrame) -> DataFrame:
        """(doc_id, version, pos) of the lines of this batch that go; its new keys become a run."""
        keys = lines.groupBy("h1", "h2").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last"))
        seen = F.lit(False)
        for i, run in enumerate(name for level in self.levels for name in level):
            keys = keys.join(self.spark.table(run).withColumn(f"in_{i}", F.lit(True)), ["h1", "h2"], "left")
            seen = seen | F.coalesce(F.col(f"in_{i}"), F.lit(False))
        keys = stored(keys.select("h1", "h2", "owner", "last", seen.alias("seen")), "line-keys")
        self._push(self._write(keys.where(~F.col("seen"))))
        repeated = keys.where(F.col("seen") | (F.col("owner") < F.col("last")))
        # unique per key: a hot line is split on the side of the lines by the adaptive skew join
        return (lines.join(repeated, ["h1", "h2"]).where(F.col("seen") | (F.col("doc_id") > F.col("owner")))
                .select("doc_id", "version", "pos"))

    def drop(self) -> None:
        for level in self.levels:
            for table in level:
                self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        self.levels = []


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """The documents with `n_lines`, `n_dropped` and `kept_text` added.

    A text is split at \\n; null or empty text is one empty line and stays (its `kept_text` is empty). A key of `min_chars`
    code points or more, found in at least two documents, keeps its lines only in the smallest doc_id that holds
    it, where repeats within the document stay. Rows with a null doc_id take no part and stay whole. Rows that
    repeat a doc_id count as one document. An empty table gives no rows; extra columns are carried
    along, except that a column named like a result gives way to it.
    """
    lines = hashed_lines(docs, min_chars)
    cuts = docs.agg(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)] or [1.0], 1000)).first()[0]
    cuts = sorted(set(cuts or [])) if batches > 1 else []
    batch = F.lit(0)
    for cut in cuts:
        batch = batch + (F.col("doc_id") > F.lit(int(cut))).cast("int")
    lines = stored(lines.withColumn("batch", batch), "line-hashes", ("batch",))
    runs = LineRuns(docs.sparkSession, fanout)
    dropped = None
    for i in range(len(cuts) + 1):
        gone = runs.add(lines.where(F.col("batch") == i).drop("batch"))
        gone = stored(gone, "dropped-lines")
        dropped = gone if dropped is None else dropped.union(gone)
    runs.drop()
    gone = dropped.groupBy("doc_id", "version").agg(F.collect_set("pos").alias("__tw_gone")).withColumnsRenamed(
        {"doc_id": "__tw_doc", "version": "__tw_version"})
    doc = docs.withColumn("__tw_text", text_or_empty())
    doc = doc.join(gone, (doc.doc_id == gone.__tw_doc) & (F.xxhash64(doc.__tw_text) == gone.__tw_version), "left")
    all_lines = F.split("__tw_text", "\n")
    left = F.array_except(F.sequence(F.lit(0), F.size(all_lines) - 1), F.col("__tw_gone"))
    kept = F.when(F.col("__tw_gone").isNull(), F.col("__tw_text")).otherwise(
        F.array_join(F.transform(left, lambda i: F.get(F.col("__tw_lines"), i)), "\n"))
    return (doc.withColumn("__tw_lines", all_lines)
            .withColumn("n_lines", F.size("__tw_lines").cast("long"))
            .withColumn("n_dropped", F.coalesce(F.size("__tw_gone"), F.lit(0)).cast("long"))
            .withColumn("kept_text", kept).select(*carried(docs, "n_lines", "n_dropped", "kept_text"), "n_lines", "n_dropped", "kept_text"))
