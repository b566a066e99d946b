"""Approximate nearest neighbours by cosine: an NN-descent graph and greedy search over it.

Index: equal vectors are one node. A first graph comes from exact neighbours within bounded blocks of hyperplane
codes; then rounds of NN-descent join each node's neighbours and reverse neighbours with each other and keep the better
ones, until few edges change. Search: a beam for each query starts at its own node and the nearest of a fixed number of pivots and moves along the
edges of its best nodes not yet expanded, one Spark join a hop, until the beam stands still.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradewright.session import cut_lineage, ship_package

NEIGHBOURS = 24
BLOCK = 256
TREES = 3
ROUNDS = 100                      # a guard: a descent or search that has not settled by then is an error
SETTLED = 0.02                    # share of new edges in a round at which the descent ends
PIVOTS = 512
STARTS, BEAM, EXPAND = 8, 160, 40
HOPS = 200
EDGES = "u long, v long, sim float"


def _double(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, vec, norm): double components; without vectors that are null, zero, not finite somewhere, or of another length than most."""
    v = vectors.where("vec_id is not null and embedding is not null").select(F.col("vec_id").cast("long").alias("vec_id"), _double(F.col("embedding")).alias("vec"))
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    v = v.where((F.size("vec") > 0) & finite).withColumn("norm", F.sqrt(dot(F.col("vec"), F.col("vec")))).where((F.col("norm") > 0) & (F.col("norm") < float("inf")))
    lengths = v.groupBy(F.size("vec").alias("n")).count().agg(F.max(F.struct("count", "n")).alias("m")).select("m.n")
    return v.where(F.size("vec") == lengths.scalar())


def _matrix(column: pa.Array, rows: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(rows, -1)


def _coded(trees: int, bits: int):
    """(nid, vec) to (nid, vec, tree, code): sides of random hyperplanes, the same in every task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            m = _matrix(batch.column(1), n)
            for tree in range(trees):
                planes = np.random.Generator(np.random.PCG64(7919 + tree)).standard_normal((m.shape[1], max(bits, 1))).astype(np.float32)
                code = ((m @ planes > 0) @ (1 << np.arange(max(bits, 1), dtype=np.int64))) if bits else np.zeros(n, np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.full(n, tree, np.int32)), pa.array(code.astype(np.int64))], ["nid", "vec", "tree", "code"])
    return run


def _top_pairs(ids: np.ndarray, sims: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    k = min(k, len(ids) - 1)
    best = np.argpartition(-sims, k - 1, axis=1)[:, :k]
    return np.repeat(ids, k), ids[best].reshape(-1), np.take_along_axis(sims, best, 1).reshape(-1)


def _edges(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    u, v, s = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32))
    return pa.RecordBatch.from_arrays([pa.array(u.astype(np.int64)), pa.array(v.astype(np.int64)), pa.array(s.astype(np.float32))], ["u", "v", "sim"])


def _held(batch: pa.RecordBatch, column: int) -> tuple[np.ndarray, pa.StructArray]:
    return np.asarray(batch.column(column).offsets) - batch.column(column).offsets[0].as_py(), batch.column(column).flatten()


def _within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Exact neighbours within each block: a list of at most 2 * `BLOCK` nodes with their vectors."""
    for batch in batches:
        at, nodes = _held(batch, 0)
        ids = nodes.field(0).to_numpy(zero_copy_only=False)
        parts = []
        if len(ids):
            m = _matrix(nodes.field(1), len(ids))
            for a, b in zip(at[:-1], at[1:]):
                if b - a > 1:
                    sims = m[a:b] @ m[a:b].T
                    np.fill_diagonal(sims, -2)
                    parts.append(_top_pairs(ids[a:b], sims, NEIGHBOURS))
        yield _edges(parts)


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Neighbours of a node with each other: the pairs nearer than the farthest neighbour that the first of them has."""
    for batch in batches:
        at, nodes = _held(batch, 0)
        ids = nodes.field(0).to_numpy(zero_copy_only=False)
        parts = []
        if len(ids):
            far = nodes.field(1).to_numpy(zero_copy_only=False)
            m = _matrix(nodes.field(2), len(ids))
            for a, b in zip(at[:-1], at[1:]):
                if b - a > 1:
                    sims = m[a:b] @ m[a:b].T
                    np.fill_diagonal(sims, -2)
                    i, j = np.nonzero(sims > far[a:b, None] + 1e-6)
                    if len(i):
                        parts.append((ids[a:b][i], ids[a:b][j], sims[i, j]))
        yield _edges(parts)


def _best(edges: DataFrame, k: int) -> DataFrame:
    """The `k` nearest of each node; `old` tells edges that stood before."""
    one = edges.groupBy("u", "v").agg(F.max("sim").alias("sim"), F.max("old").alias("old"))
    w = Window.partitionBy("u").orderBy(F.desc("sim"), "v")
    return one.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).select("u", "v", "sim", "old")


def _around(edges: DataFrame, k: int, turn: int | None = None) -> DataFrame:
    """(w, x): each node's neighbours and `k` of those it is a neighbour of: the nearest, or in a turn of the descent any, dealt by a hash."""
    back = edges.select(F.col("v").alias("u"), F.col("u").alias("v"), "sim")
    w = Window.partitionBy("u").orderBy(F.desc("sim") if turn is None else F.xxhash64(F.lit(turn), "u", "v"), "v")
    back = back.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).select("u", "v")
    return edges.select("u", "v").union(back).distinct().select(F.col("u").alias("w"), F.col("v").alias("x"))


def build_graph(nodes: DataFrame, k: int = NEIGHBOURS) -> DataFrame:
    """(u, v, sim): about the `k` nearest nodes v of each node u of (nid, vec), vec of unit length."""
    ship_package(nodes.sparkSession)
    n = nodes.count()
    bits = max(0, math.ceil(math.log2(max(1, n / BLOCK))))
    coded = nodes.mapInArrow(_coded(TREES, bits), "nid long, vec array<float>, tree int, code long")
    sizes = coded.groupBy("tree", "code").agg(F.count(F.lit(1)).alias("n"))
    # a code with many nodes is cut by a hash of the node into blocks of about BLOCK
    cut = coded.join(sizes, ["tree", "code"]).withColumn("cut", F.pmod(F.xxhash64("nid", "tree"), F.ceil(F.col("n") / BLOCK)))
    blocks = cut.groupBy("tree", "code", "cut").agg(F.collect_list(F.struct("nid", "vec")).alias("held")).select("held")
    edges = cut_lineage(_best(blocks.mapInArrow(_within, EDGES).withColumn("old", F.lit(0)), k))
    for turn in range(ROUNDS):
        far = edges.groupBy("u").agg(F.min("sim").alias("far"), F.count(F.lit(1)).alias("n")).select(F.col("u").alias("id"), F.when(F.col("n") < k, -2.0).otherwise(F.col("far")).cast("float").alias("far"))
        held = nodes.join(far, nodes.nid == far.id, "left").select("nid", F.coalesce("far", F.lit(-2.0).cast("float")).alias("far"), "vec")
        lists = _around(edges, k, turn).join(held, F.col("x") == F.col("nid")).groupBy("w").agg(F.collect_list(F.struct("nid", "far", "vec")).alias("held"))
        found = lists.select("held").mapInArrow(_met, EDGES)
        edges = cut_lineage(_best(edges.withColumn("old", F.lit(1)).unionByName(found.withColumn("old", F.lit(0))), k))
        seen = edges.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(1 - F.col("old")), F.lit(0)).alias("fresh")).first()
        if seen.fresh <= SETTLED * seen.n:
            return edges.select("u", "v", "sim")
    raise RuntimeError(f"the neighbour graph has not settled after {ROUNDS} rounds: {seen.fresh} of {seen.n} edges are new")


def greedy_search(queries: DataFrame, nodes: DataFrame, edges: DataFrame, k: int = NEIGHBOURS) -> DataFrame:
    """(q, node, sim): the beam of each query (q, qvec), q a node, when it stands still."""
    near = cut_lineage(_around(edges, k).groupBy("w").agg(F.collect_list("x").alias("around")))
    pivots = nodes.orderBy(F.xxhash64("nid"), "nid").limit(PIVOTS).collect()                     # PIVOTS vectors, a fixed number
    ids = np.array([r.nid for r in pivots], np.int64)
    points = np.array([r.vec for r in pivots], np.float32)

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, parts = batch.num_rows, []
            if n and len(ids):
                sims = _matrix(batch.column(1), n) @ points.T
                best = np.argsort(-sims, axis=1, kind="stable")[:, :STARTS]
                parts.append((np.repeat(batch.column(0).to_numpy(), best.shape[1]), ids[best].reshape(-1), np.take_along_axis(sims, best, 1).reshape(-1)))
            yield _edges(parts)

    best = Window.partitionBy("q").orderBy(F.desc("sim"), "node")
    first = queries.select("q", "qvec").mapInArrow(start, EDGES).select(F.col("u").alias("q"), F.col("v").alias("node"), "sim")
    own = queries.select("q", F.col("q").alias("node"), dot(F.col("qvec"), F.col("qvec")).cast("float").alias("sim"))
    first = first.unionByName(own).groupBy("q", "node").agg(F.max("sim").alias("sim"))
    beam = cut_lineage(first.withColumns({"done": F.lit(False), "now": F.lit(True)}))
    for _ in range(HOPS):
        front = beam.where("now")
        if front.limit(1).count() == 0:
            return beam.select("q", "node", "sim")
        reached = front.join(near, front.node == near.w).select("q", F.explode("around").alias("node")).distinct().join(beam.select("q", "node"), ["q", "node"], "left_anti")
        pairs = reached.join(queries, "q").join(nodes, F.col("node") == F.col("nid"))
        new = pairs.select("q", "node", dot(F.col("qvec"), F.col("vec")).cast("float").alias("sim"), F.lit(False).alias("done"))
        held = beam.select("q", "node", "sim", (F.col("done") | F.col("now")).alias("done")).unionByName(new)
        held = held.withColumn("r", F.row_number().over(best)).where(F.col("r") <= BEAM)
        left = F.sum(F.when(F.col("done"), 0).otherwise(1)).over(best.rowsBetween(Window.unboundedPreceding, 0))
        beam = cut_lineage(held.select("q", "node", "sim", "done", (~F.col("done") & (left <= EXPAND)).alias("now")))
    raise RuntimeError(f"the search has not come to rest after {HOPS} hops")


def nearest(vectors: DataFrame, is_query: Column, top: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): for rows where `is_query` (over vec_id) the `top` nearest other rows found, all rows being indexed.

    score is the cosine in double precision of the vectors as given; ties go to the smaller vec_id. Vectors that are null, zero, or hold a null or
    a non-finite component take no part, nor do those of another length than most. Equal vectors share a node, of
    which the `top` + 1 smallest ids are enough for every answer. A repeated vec_id counts once for each
    different vector. An empty table gives no rows; other columns are not read.
    """
    good = cut_lineage(usable(vectors).dropDuplicates(["vec_id", "vec"]).withColumns({"h1": F.xxhash64("vec"), "h2": F.xxhash64(F.lit(7), "vec")}))
    first = good.groupBy("h1", "h2").agg(F.min("vec_id").alias("nid"))
    numbered = good.join(first, ["h1", "h2"])
    w = Window.partitionBy("h1", "h2").orderBy("vec_id")
    members = cut_lineage(numbered.withColumn("r", F.row_number().over(w)).where(F.col("r") <= top + 1).select("nid", "vec_id", "vec", "norm"))
    unit = F.transform(F.col("vec"), lambda x: (x / F.col("norm")).cast("float"))
    nodes = cut_lineage(members.where("nid = vec_id").select("nid", unit.alias("vec")).dropDuplicates(["nid"]))
    edges = build_graph(nodes)
    asked = numbered.where(is_query).select("vec_id", "nid", "vec", "norm")
    queries = cut_lineage(asked.select(F.col("nid").alias("q")).distinct().join(nodes.select(F.col("nid").alias("q"), F.col("vec").alias("qvec")), "q"))
    beam = greedy_search(queries, nodes, edges)
    own = asked.select(F.col("vec_id").alias("query_id"), F.col("nid").alias("qn"), F.col("vec").alias("qv"), F.col("norm").alias("qnorm"))
    # the beam holds a query's nearest nodes by single precision; its own node is among the candidates for its copies
    around = beam.select("q", "node").union(queries.select("q", F.col("q").alias("node"))).distinct()
    offered = around.join(members.select("nid", "vec_id", F.col("vec").alias("cv"), F.col("norm").alias("cnorm")), F.col("node") == F.col("nid"))
    scored = (own.join(offered, own.qn == offered.q).where("query_id <> vec_id")
              .select("query_id", "vec_id", (dot(F.col("qv"), F.col("cv")) / (F.col("qnorm") * F.col("cnorm"))).alias("score")))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return scored.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")
