"""Product recommendation: co-purchase similarity, candidates, rankers and examples."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradewright.functions import rules as R
from tradewright.functions.scale import scalar, top_k_per
from tradewright.operators.walk import bonus, spans, walk_scores
from tradewright.session import cut_lineage, ship_package, stored

PAIRS = 2_000_000
#: A task scores so many customers, owning so many items in all, over a tile of so many items: `TILES` tiles, if they are not narrower or wider than these.
USERS, ENTRIES = 262_144, 16_000_000
TILES, TILE, WIDEST = 48, 512, 8192
CELLS = 1 << 22
STRIDE = 7919


def purchases(lines: DataFrame, names: DataFrame) -> DataFrame:
    """(customer, item, date) of real goods, items by product reference, with the establishment type of the customer."""
    ok = lines.filter((F.col("amount") > 0) & ~F.upper(F.coalesce("family", F.lit(""))).startswith("SERVICE"))
    d = ok.groupBy("customer", F.col("reference").alias("item"), "date").agg(F.sum("amount").alias("amount"), F.min("family").alias("family"))
    return d.join(names.select("customer", R.establishment_type(F.col("customer_name")).alias("type")), "customer", "left")


def cutoff_dates(bought: DataFrame, horizon: int = 3, step: int = 3, warmup: int = 15) -> DataFrame:
    """Quarterly month-ends, backwards from the last one whose target window is complete."""
    last, first = F.max("date"), F.min("date")
    complete = F.when(last == F.last_day(last), last).otherwise(F.last_day(F.add_months(last, -1)))
    b = bought.agg(F.last_day(F.add_months(complete, -horizon)).alias("hi"), F.add_months(F.trunc(first, "month"), warmup).alias("lo"))
    n = F.floor(F.months_between("hi", "lo") / step).cast("int")
    return b.select(F.explode(F.sequence(F.lit(0), n)).alias("i"), "hi", "lo").select(F.last_day(F.add_months("hi", -step * F.col("i"))).alias("cutoff"), "lo").filter("cutoff >= lo").select("cutoff")


def _groups(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[object, pd.DataFrame]]:
    """Runs of one item from rows sorted by item; an item with many rows comes in several runs, one after the other."""
    for b in batches:
        change = np.flatnonzero(np.r_[True, b["item"].to_numpy()[1:] != b["item"].to_numpy()[:-1]])
        for lo, hi in zip(change, [*change[1:], len(b)], strict=True):
            yield b["item"].iat[lo], b.iloc[lo:hi]


def _merged(others: list[np.ndarray], sizes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct neighbours with their buyers and the sums of their counts."""
    other, first, at = np.unique(np.concatenate(others), return_index=True, return_inverse=True)
    return other, np.concatenate(sizes)[first], np.bincount(at, np.concatenate(counts)).astype(np.int64)


def _neighbours(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[object, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(item, its buyers, others, their buyers, common buyers) from the baskets that hold an item.

    Merged whenever `PAIRS` entries wait, so that no more than the distinct neighbours of one item and these are held.
    """
    item, size, held, waiting = None, 0, [], 0

    def closed():
        other, sizes, n = _merged(*zip(*held, strict=True))
        here = other != item
        return item, size, other[here], sizes[here], n[here]

    for key, rows in _groups(batches):
        if held and key != item:
            yield closed()
            held, waiting = [], 0
        item, size = key, int(rows["size"].iat[0])
        for other, sizes in zip(rows["others"], rows["sizes"], strict=True):
            held.append((np.asarray(other), np.asarray(sizes), np.ones(len(other), np.int64)))
            waiting += len(other)
            if waiting > PAIRS:
                held, waiting = [_merged(*zip(*held, strict=True))], 0
    if held:
        yield closed()


def _baskets_by_item(bought: DataFrame) -> DataFrame:
    """(item, size, others, sizes): a row for each item of each basket with the whole basket, sorted by item; sizes are numbers of buyers.

    This is the only shuffle of the co-purchases: a pair takes one place in an array, and pairs are counted where the item is.
    """
    basket = bought.groupBy("customer", "item").agg(F.lit(1).alias("_")).drop("_")
    size = basket.groupBy("item").agg(F.count(F.lit(1)).cast("int").alias("size"))
    whole = basket.where("customer is not null").join(size, "item").groupBy("customer").agg(F.sort_array(F.collect_list(F.struct("item", "size"))).alias("b"))
    rows = whole.select(F.explode("b").alias("own"), F.col("b.item").alias("others"), F.col("b.size").alias("sizes"))
    return rows.select("own.item", "own.size", "others", "sizes").repartition("item").sortWithinPartitions("item")


def _pairs(k: int | None):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, waiting = [], 0
        for item, size, other, sizes, n in _neighbours(batches):
            value = n / np.sqrt(float(size) * sizes)
            if k is not None and len(other) > k:
                # equal values are parted later by the item, so all that may tie with the last one stay
                near = value >= np.partition(value, len(value) - k)[len(value) - k] - 4e-9
                other, n, value = other[near], n[near], value[near]
            out.append((item, other, n, value))
            waiting += len(other)
            if waiting > 100_000:
                yield _frame(out)
                out, waiting = [], 0
        if out:
            yield _frame(out)
    return run


def _frame(found: list[tuple[object, np.ndarray, np.ndarray, np.ndarray]]) -> pd.DataFrame:
    item, other, n, value = zip(*found, strict=True)
    return pd.DataFrame({"item": np.repeat(np.asarray(item), [len(o) for o in other]), "other": np.concatenate(other), "n_common": np.concatenate(n), "similarity": np.concatenate(value)})


def item_similarity(bought: DataFrame, k: int | None = None) -> DataFrame:
    """Cosine between items over their buyers: item, other, n_common, similarity (both directions); with `k` at least the k nearest of each."""
    ship_package(bought.sparkSession)
    kind = bought.schema["item"].dataType.simpleString()
    return _baskets_by_item(bought).mapInPandas(_pairs(k), f"item {kind}, other {kind}, n_common bigint, similarity double")


def similar_items(bought: DataFrame, k: int = 10) -> DataFrame:
    return top_k_per(item_similarity(bought, k), ["item"], [F.round("similarity", 9).desc(), F.col("other").asc()], k).select(
        "item", "rank", "other", "n_common", F.round("similarity", 6).alias("similarity"))


def recent(bought: DataFrame, cutoff: Column, months: int) -> DataFrame:
    return bought.filter((F.col("date") <= cutoff) & (F.col("date") > F.add_months(cutoff, -months)))


def basket_of(bought: DataFrame) -> DataFrame:
    return bought.groupBy("customer", "item").agg(F.lit(1).alias("owned"))


def catalogue(bought: DataFrame, cutoff: Column) -> DataFrame:
    """(item, buyers, place): the items sold in the last twelve months, numbered from 0 by buyers."""
    return stored(popularity(bought, cutoff).select("item", "buyers", (F.col("pop_rank") - 1).alias("place")), "catalogue")


def _shelved(width: int):
    """The neighbours of an item by tile of `width` places: others within the tile, common buyers."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, waiting = [], 0
        for item, size, other, _, n in _neighbours(batches):
            tile = other // width
            change = np.flatnonzero(np.r_[True, tile[1:] != tile[:-1]]) if len(tile) else []
            for lo, hi in zip(change, [*change[1:], len(tile)], strict=False):
                out.append((int(tile[lo]), int(item), size, (other[lo:hi] - tile[lo] * width).astype(np.int16), n[lo:hi].astype(np.int32)))
                waiting += hi - lo
            if waiting > 200_000 or len(out) > 10_000:
                yield pd.DataFrame(out, columns=["shelf", "item", "size", "others", "n"])
                out, waiting = [], 0
        if out:
            yield pd.DataFrame(out, columns=["shelf", "item", "size", "others", "n"])
    return run


def _flat(arrays, kind) -> tuple[np.ndarray, np.ndarray]:
    arrays = [np.asarray(x, dtype=kind) for x in arrays]
    return np.concatenate([*arrays, np.zeros(0, kind)]), np.array([len(x) for x in arrays], dtype=np.int64)


def _tile_scores(k: int | None, pairs: bool, width: int):
    """Similarity sums and maxima of a block of customers over a tile of items, from the similarity rows of the items they own.

    Customers go in runs of `CELLS` cells, their similarity entries in runs of `CELLS` entries.
    """

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        shelf = left["item"].to_numpy() < 0
        buyers, bonus = np.zeros(width), np.full(width, np.nan)
        for others, sizes, values in zip(left["others"][shelf], left["n"][shelf], left["bonus"][shelf], strict=True):
            buyers[np.asarray(others)], bonus[np.asarray(others)] = sizes, values
        left = left[~shelf].sort_values("item", kind="stable")
        known = left["item"].to_numpy()
        other, length = _flat(left["others"], np.int32)
        start = np.cumsum(length) - length
        sim = _flat(left["n"], np.float64)[0] / np.sqrt(np.repeat(left["size"].to_numpy(), length) * buyers[other])
        at = int(right["tile"].iloc[0]) * width if len(right) else 0
        found = []
        begin = np.maximum.accumulate(np.where(np.r_[True, bonus[1:] != bonus[:-1]], np.arange(width), 0))        # first place of equal buyers
        step = max(1, CELLS // width)
        for lo in range(0, len(right), step):
            part = right.iloc[lo:lo + step]
            m = len(part)
            total = np.zeros(m * width)
            most = None if k is not None else np.zeros(m * width)                # not asked for by lists
            owned, sizes = _flat(part["items"], np.int64)
            who = np.repeat(np.arange(m), sizes)
            row = np.searchsorted(known, owned)
            row[row == len(known)] = 0
            hit = known[row] == owned if len(known) else np.zeros(len(owned), bool)
            row, by = row[hit], who[hit]
            runs = (np.cumsum(length[row]) // CELLS) if len(row) else np.zeros(0, np.int64)
            for a, z in zip(*(np.searchsorted(runs, np.unique(runs), side) for side in ("left", "right")), strict=True):
                places = spans(start[row[a:z]], length[row[a:z]])
                cell = np.repeat(by[a:z], length[row[a:z]]) * width + other[places]
                total += np.bincount(cell, sim[places], m * width)
                if most is not None:
                    np.maximum.at(most, cell, sim[places])
            total = total.reshape(m, width)
            if pairs:
                asked, n = _flat(part["wanted"], np.int64)
                i, j = np.repeat(np.arange(m), n), asked - at
            else:
                open_to = np.broadcast_to(~np.isnan(bonus), (m, width)).copy()
                here = (owned >= at) & (owned < at + width)
                open_to[who[here], owned[here] - at] = False
                if k is not None and k < width:
                    # unseen items of similarity zero and equal buyers are equal, and places give them in order of the item: `k` of them are enough
                    zero = open_to & (total == 0)
                    seen = np.cumsum(zero, axis=1, dtype=np.int32)
                    open_to &= ~zero | (seen - np.where(begin > 0, seen[:, begin - 1], 0) <= k)
                    score = np.where(open_to, total + np.nan_to_num(bonus), -1.0)
                    # equal scores are parted later by the item, so all that may tie with the last one stay
                    open_to &= score >= np.partition(score, width - k, axis=1)[:, width - k, None] - 4e-9
                i, j = np.nonzero(open_to)
            found.append(pd.DataFrame({"customer": part["customer"].to_numpy()[i], "place": j + at, "knn_sum": total[i, j],
                                       "knn_max": np.full(len(i), np.nan) if most is None else most.reshape(m, width)[i, j]}))
        return pd.concat(found, ignore_index=True) if found else pd.DataFrame({"customer": right["customer"], "place": [], "knn_sum": [], "knn_max": []})
    return run


def basket_scores(bought: DataFrame, cutoff: Column, items: DataFrame, k: int | None = None, pairs: DataFrame | None = None, walk: bool | None = None) -> DataFrame:
    """(customer, item, bonus, knn_sum, knn_max (not with `k`)): similarity of unseen catalogue items to the past basket, sum and maximum, zero included.

    For every active customer and every catalogue item it never bought, or only those that may be among the `k` of highest
    knn_sum + bonus, the bonus being log1p(buyers) / 1000, or only the given unseen (customer, item) `pairs`. Where a customer meets few items of a wide catalogue by
    those who own what it owns, sums come from a walk over the baskets (`operators/walk.py`), which grows with what is met. Where buyers are
    many and items few, blocks of customers meet tiles of items: a task adds the similarity entries of the items that its customers own, so
    a customer's neighbours are never listed. A similarity row goes to each block as small whole numbers (place within the tile, common buyers).
    """
    ship_package(bought.sparkSession)
    c = F.col
    own = bought.filter(c("date") <= cutoff).select("customer", "item").join(items.select("item", "place"), "item").groupBy("customer", "item", "place").agg(F.lit(1).alias("_"))
    own = stored(own.select("customer", c("place").cast("int").alias("item")), "baskets")
    active = recent(bought, cutoff, 12).select("customer").distinct()
    n_items = max(1, items.count())
    if pairs is not None:
        active = active.join(pairs.select("customer").distinct(), "customer", "left_semi")
    active = stored(active, "active-customers")
    # owners of what a customer owns, and what those own: their sums over all customers
    size = lambda key: own.groupBy(key).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(c("n") * c("n")), F.lit(0)).alias("squares"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    by_item, by_customer, asking = size("item"), size("customer"), active.count()
    entries = by_item.squares * by_customer.squares / max(1, by_customer.n)
    if walk if walk is not None else asking * n_items * 4 > entries:
        places = None if pairs is None else pairs.join(items.select("item", "place"), "item").select("customer", "place")
        return walk_scores(own.withColumnRenamed("item", "place"), active, items, n_items, by_item.squares, k, places)
    width = min(WIDEST, max(TILE, -(-n_items // TILES)))
    tile_of, in_tile = F.floor(c("place") / width).cast("int"), (c("place") % width).cast("smallint")
    if pairs is not None:
        asked = pairs.join(items, "item").groupBy("customer", tile_of.alias("tile")).agg(F.collect_list(c("place").cast("int")).alias("wanted"))
    baskets = stored(active.join(own, "customer", "left").groupBy("customer").agg(F.collect_list("item").alias("items")), "active-baskets")
    load = baskets.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.size("items")), F.lit(0)).alias("entries")).first()
    users = USERS if k is not None or pairs is not None else max(1, CELLS // width)               # all cells of a block are listed at once
    blocks, tiles = max(1, -(-load.n // users), -(-load.entries // ENTRIES)), -(-n_items // width)
    baskets = baskets.withColumn("block", F.pmod(F.xxhash64("customer"), F.lit(blocks)).cast("int"))
    everywhere = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("part")
    rows = stored(_baskets_by_item(own).mapInPandas(_shelved(width), "shelf int, item int, size int, others array<smallint>, n array<int>"), "similarity-rows")
    sent = rows.select(everywhere, "*", F.lit(None).cast("array<double>").alias("bonus"))
    # the buyers of a tile's items, as the similarity counts them, and what popularity adds
    held = own.groupBy("item").agg(F.count(F.lit(1)).cast("int").alias("held"))
    shelf = items.join(held, c("place") == held["item"], "left").groupBy(tile_of.alias("shelf")).agg(F.collect_list(F.struct(
        in_tile.alias("o"), F.coalesce("held", F.lit(0)).alias("n"), bonus().alias("s"))).alias("r"))                     # at most WIDEST of them
    shelf = shelf.select(everywhere, "shelf", F.lit(-1).alias("item"), F.lit(0).alias("size"), c("r.o").alias("others"), c("r.n").alias("n"), c("r.s").alias("bonus"))
    if pairs is not None:
        asking = baskets.join(asked, "customer").select("block", "tile", "customer", "items", "wanted")
    else:
        asking = baskets.select("block", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))).alias("tile"), "customer", "items", F.array().cast("array<int>").alias("wanted"))
    kind = bought.schema["customer"].dataType.simpleString()
    met = (sent.unionByName(shelf).groupBy("part", "shelf").cogroup(asking.groupBy("block", "tile"))
           .applyInPandas(_tile_scores(k, pairs is not None, width), f"customer {kind}, place long, knn_sum double, knn_max double"))
    return met.join(items.select("item", "place", bonus().alias("bonus")), "place").select("customer", "item", "bonus", "knn_sum", "knn_max")


def knn_candidates(bought: DataFrame, cutoff: Column) -> DataFrame:
    """Every catalogue item that an active customer never bought, with the sum and maximum of its similarity to the basket."""
    past = stored(bought.filter(F.col("date") <= cutoff), "past-purchases")
    return basket_scores(past, cutoff, catalogue(past, cutoff)).drop("bonus")


def popularity(bought: DataFrame, cutoff: Column, by: Sequence[str] = ()) -> DataFrame:
    """Buyers of the last twelve months per item (and per type), ranked."""
    cust = recent(bought, cutoff, 12).groupBy(*by, "customer", "item").agg(F.lit(1).alias("_"))
    g = cust.groupBy(*by, "item").agg(F.count(F.lit(1)).alias("buyers"))
    # items of one number of buyers are ranked together, after all with more
    sizes = g.groupBy(*by, "buyers").agg(F.count(F.lit(1)).alias("n"))
    above = Window.partitionBy(*(by or [F.lit(0)])).orderBy(F.col("buyers").desc()).rowsBetween(Window.unboundedPreceding, -1)      # one row per number of buyers
    before = sizes.select(*by, F.col("buyers"), F.coalesce(F.sum("n").over(above), F.lit(0)).alias("before"))
    inner = Window.partitionBy(*by, "buyers").orderBy("item")
    return g.join(before, [*by, "buyers"]).select(*by, "item", "buyers", (F.col("before") + F.row_number().over(inner)).cast("int").alias("pop_rank"))


def popular_unseen(bought: DataFrame, cutoff: Column, by_type: bool = False, k: int = 10) -> DataFrame:
    """The k most popular items each active customer never bought.

    A customer owning n items needs the first n + k ranks only, so ranks are looked up instead of crossing
    customers with the catalogue.
    """
    past = bought.filter(F.col("date") <= cutoff)
    own = basket_of(past)
    by = ["type"] if by_type else []
    active = recent(bought, cutoff, 12).groupBy("customer").agg(F.min("type").alias("type"))
    n = own.groupBy("customer").agg(F.count(F.lit(1)).alias("n_owned"))
    probe = active.join(n, "customer").select("customer", *by, F.explode(F.sequence(F.lit(1), (F.col("n_owned") + k).cast("int"))).alias("pop_rank"))
    seen = probe.join(popularity(bought, cutoff, by), [*by, "pop_rank"]).join(own, ["customer", "item"], "left_anti")
    return top_k_per(seen, ["customer"], [F.col("pop_rank").asc()], k).select("customer", "item", "rank", "buyers")


def knn_lists(bought: DataFrame, cutoff: Column, k: int = 10) -> DataFrame:
    """The k unseen catalogue items of highest score per active customer, items of similarity zero among them."""
    past = stored(bought.filter(F.col("date") <= cutoff).select("customer", "item", "date"), "past-purchases")           # read five times
    items = catalogue(past, cutoff)
    score = F.round(F.col("knn_sum") + F.col("bonus"), 9)
    return top_k_per(basket_scores(past, cutoff, items, k).withColumn("score", score), ["customer"], [F.col("score").desc(), F.col("item").asc()], k).select("customer", "item", "rank", "score")


def adoptions(bought: DataFrame, cutoff: Column, horizon: int = 3) -> DataFrame:
    """Catalogue items first bought by an active customer within the horizon after the cut-off."""
    fut = bought.filter((F.col("date") > cutoff) & (F.col("date") <= F.add_months(cutoff, horizon)))
    last12 = recent(bought, cutoff, 12)
    new = basket_of(fut).drop("owned").join(basket_of(bought.filter(F.col("date") <= cutoff)), ["customer", "item"], "left_anti")
    return new.join(last12.select("item").distinct(), "item", "left_semi").join(last12.select("customer").distinct(), "customer", "left_semi").select("customer", "item")


def dealt_negatives(bought: DataFrame, cutoff: Column, items: DataFrame, adopted: DataFrame, per_positive: int) -> DataFrame:
    """(customer, item): for each adoption `per_positive` unseen items that the customer did not adopt, out of the whole catalogue.

    A customer walks the catalogue from a place given by its hash in steps prime to its size, which meets every item once; items owned
    or adopted are skipped. So as many probes as items owned, adopted and wanted are enough, and nothing is crossed.
    """
    c = F.col
    n = scalar(items.agg(F.count(F.lit(1))))
    own = basket_of(bought.filter(c("date") <= cutoff)).select("customer", "item").join(items.select("item"), "item", "left_semi")
    taken = own.unionByName(adopted.select("customer", "item"))
    size = taken.groupBy("customer").agg(F.count(F.lit(1)).alias("taken"))
    wish = adopted.groupBy("customer").agg((F.count(F.lit(1)) * per_positive).alias("wish")).join(size, "customer")
    start = F.conv(F.substring(F.md5(c("customer").cast("string")), 1, 8), 16, 10).cast("long")
    walk = wish.withColumn("n", n).select("customer", "wish", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.least(c("wish") + c("taken"), c("n")) - 1)).alias("step"))
    stride = F.when(c("n") % STRIDE == 0, 1).otherwise(STRIDE)
    met = walk.select("customer", "wish", "step", ((start + c("step") * stride) % c("n")).alias("place")).join(items.select("item", "place"), "place")
    free = met.join(taken, ["customer", "item"], "left_anti")
    w = Window.partitionBy("customer").orderBy("step")                        # at most what the customer owns and wants
    return free.withColumn("_r", F.row_number().over(w)).filter(c("_r") <= c("wish")).select("customer", "item")


def examples(bought: DataFrame, cutoff: Column, horizon: int = 3, negatives: int | None = 10) -> DataFrame:
    """Features of (customer, unseen item) pairs at a cut-off, over the whole catalogue; ten dealt negatives per positive when training."""
    c = F.col
    past, last12 = bought.filter(F.col("date") <= cutoff), recent(bought, cutoff, 12)
    items, adopted = catalogue(bought, cutoff), stored(adoptions(bought, cutoff, horizon), "adoptions")
    if negatives is None:
        cand = basket_scores(bought, cutoff, items).drop("bonus").join(adopted.withColumn("y", F.lit(1)), ["customer", "item"], "left").fillna(0, ["y"])
    else:
        pairs = adopted.withColumn("y", F.lit(1)).unionByName(dealt_negatives(bought, cutoff, items, adopted, negatives).withColumn("y", F.lit(0)))
        pairs = stored(pairs, "example-pairs")
        cand = pairs.join(basket_scores(bought, cutoff, items, pairs=pairs.select("customer", "item")).drop("bonus"), ["customer", "item"])
    b12 = popularity(bought, cutoff).select("item", c("buyers").alias("b12"))
    b3 = basket_of(recent(bought, cutoff, 3)).groupBy("item").agg(F.count(F.lit(1)).alias("b3"))
    bt = popularity(bought, cutoff, ["type"]).select("type", "item", c("buyers").alias("bt"))
    nt = last12.groupBy("type", "customer").agg(F.lit(1).alias("_")).groupBy("type").agg(F.count(F.lit(1)).alias("nt"))
    prod = last12.groupBy("item").agg(F.sum("amount").alias("pr")).join(bought.groupBy("item").agg(F.min("date").alias("first"), F.min("family").alias("family")), "item")
    own = basket_of(past.join(last12.select("item").distinct(), "item", "left_semi")).join(prod.select("item", "family"), "item")
    fam = own.groupBy("customer", "family").agg(F.count(F.lit(1)).alias("nf"))
    size = own.groupBy("customer").agg(F.count(F.lit(1)).alias("n_own"))
    cm = last12.groupBy("customer", R.month_index(c("date")).alias("m")).agg(F.sum("amount").alias("a"))
    cust = cm.groupBy("customer").agg(F.sum("a").alias("cr"), F.count(F.lit(1)).alias("am")).join(
        past.groupBy("customer").agg(F.max("date").alias("lastd"), F.min("type").alias("type")), "customer").join(size, "customer")
    x = cand.join(cust, "customer").join(prod, "item").join(b12, "item").join(b3, "item", "left").join(bt, ["type", "item"], "left").join(nt, "type").join(fam, ["customer", "family"], "left").fillna(0, ["b3", "bt", "nf"])
    share = c("nf") / c("n_own")
    return x.select(
        "customer", "item", "y", F.log1p("b12").alias("log_buyers_12m"), F.log1p("b3").alias("log_buyers_3m"), (F.log1p(c("b3") * 4) - F.log1p("b12")).alias("trend"),
        F.log1p("bt").alias("log_buyers_type"), (c("bt") / c("nt")).alias("share_type"), "knn_sum", "knn_max", (F.datediff(cutoff, "first") / 365.0).alias("item_age_years"),
        F.log1p("pr").alias("log_item_revenue"), F.log1p("n_own").alias("log_owned"), F.log1p("cr").alias("log_customer_revenue"), (c("am") / 12.0).alias("active_share"),
        (F.datediff(cutoff, "lastd") / 365.0).alias("recency_years"), share.alias("family_share"), (share > 0).cast("double").alias("family_known"))


EXAMPLE_FEATURES = ["log_buyers_12m", "log_buyers_3m", "trend", "log_buyers_type", "share_type", "knn_sum", "knn_max", "item_age_years", "log_item_revenue", "log_owned",
                    "log_customer_revenue", "active_share", "recency_years", "family_share", "family_known"]


def learned_lists(bought: DataFrame, train_cut: Column, test_cut: Column, k: int = 10, kind: str = "logistic") -> DataFrame:
    """Logistic or boosted ranker trained at one cut-off and applied to every candidate of a later one."""
    from tradewright.operators.learning import classifier, predict
    model: Pipeline = classifier(kind, EXAMPLE_FEATURES).fit(cut_lineage(examples(bought, train_cut)))
    p = predict(model, cut_lineage(examples(bought, test_cut, negatives=None)))
    return top_k_per(p.withColumn("score", F.round("p", 9)), ["customer"], [F.col("score").desc(), F.col("item").asc()], k).select("customer", "item", "rank", "score")


def recommendation_table(bought: DataFrame, lists: DataFrame, cutoff: Column) -> DataFrame:
    """Lists enriched with buyers, adoption in the same type and the median yearly spend of a buyer."""
    last12 = recent(bought, cutoff, 12)
    spend = last12.groupBy("item", "customer").agg(F.sum("amount").alias("a")).groupBy("item").agg(F.count(F.lit(1)).alias("buyers"), F.percentile("a", F.lit(0.5)).alias("median_spend"))
    who = bought.groupBy("customer").agg(F.min("type").alias("type"))
    bt = popularity(bought, cutoff, ["type"]).select("type", "item", F.col("buyers").alias("bt"))
    nt = last12.groupBy("type", "customer").agg(F.lit(1).alias("_")).groupBy("type").agg(F.count(F.lit(1)).alias("nt"))
    x = lists.join(who, "customer").join(spend.withColumnRenamed("buyers", "item_buyers"), "item").join(bt, ["type", "item"], "left").join(nt, "type")
    return x.select("customer", "rank", "item", "item_buyers", F.round(R.pct(F.coalesce("bt", F.lit(0)), F.col("nt")), 6).alias("type_adoption_pct"), F.round(F.col("median_spend") + 1e-7, 4).alias("median_yearly_spend"))


def potential(table: DataFrame, top: int = 3) -> DataFrame:
    return table.filter(F.col("rank") <= top).groupBy("customer").agg(F.round(F.sum("median_yearly_spend"), 2).alias("potential"))
