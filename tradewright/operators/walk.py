"""Similarity sums of unseen items by a walk over baskets, without a table of similarities.

From the items of a customer to all who own them, and on to what those own: the similarity of j to a basket is the sum, over all
owners v of j, of 1 / sqrt(n_i) for each item i that v has in common with the basket, over sqrt(n_j). A block of customers is sent
the baskets in tiles of items, there and back again: on the way there the other owners of what its customers own are noted, on the
way back the sums over the items of a tile are worked out, one customer after the other. A task holds one tile and those owners.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradewright.session import ship_package, stored

#: A task holds so many basket entries of a tile and so many other owners, works on so many entries a step, and hands on so many rows at once.
PIECE, HELD, STEP, ROWS = 10_000_000, 1 << 25, 1 << 18, 100_000
#: Sums this near may be equal once rounded to nine digits.
NEAR = 4e-9
CHUNK = 1 << 16


def bonus() -> Column:
    """What popularity adds to a similarity sum."""
    return 1e-3 * F.log1p("buyers")


def spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Places of many runs, one after the other."""
    return np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths - starts, lengths)


def numbered(df: DataFrame, name: str, number: str) -> DataFrame:
    """Rows stored with whole numbers from 0 on; only one count for each task of the write reaches the driver."""
    rows = stored(df.withColumn("_id", F.monotonically_increasing_id()), name)
    task = F.shiftright("_id", 33).cast("int")
    sizes = {r.task: r.n for r in rows.groupBy(task.alias("task")).agg(F.count(F.lit(1)).alias("n")).collect()}
    starts = np.cumsum([0, *[sizes.get(t, 0) for t in range(max(sizes, default=0) + 1)]]).tolist()
    within = F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    return rows.withColumn(number, (F.element_at(F.lit(starts), task + 1) + within).cast("int")).drop("_id")


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(tile, place, users) sorted by both to rows of many items of a tile: first place, places, numbers of their users, users."""
    for b in batches:
        tile, place = b.column(0).to_numpy(), b.column(1).to_numpy()
        change = np.flatnonzero(np.r_[True, tile[1:] != tile[:-1]]) if len(tile) else []
        for lo, hi in zip(change, [*change[1:], len(tile)], strict=False):
            users = b.column(2).slice(lo, hi - lo)
            parts = [pa.array(place[lo:hi]), users.value_lengths(), users.flatten()]
            yield pa.RecordBatch.from_arrays([pa.array(tile[lo:lo + 1]), pa.array(place[lo:lo + 1]), *[pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in parts]],
                                             ["tile", "start", "items", "sizes", "users"])


def _flat(arrays: Sequence[pa.Array]) -> tuple[np.ndarray, np.ndarray]:
    """(values, ends) of lists, null ones empty."""
    sizes = np.concatenate([a.value_lengths().fill_null(0).to_numpy(zero_copy_only=False) for a in arrays])
    return np.concatenate([a.flatten().to_numpy() for a in arrays]), np.r_[0, np.cumsum(sizes, dtype=np.int64)]


class _Block:
    """Customers of one block. Steps: -2 the catalogue, -1 the customers, then the tiles there (0 to n - 1) and back (to 2 n - 2)."""

    def __init__(self, k: int | None, listed: bool, bounds: Sequence[int]) -> None:
        self.k, self.listed, self.bounds, self.step, self.held, self.owners = k, listed, bounds, -2, [], []

    def until(self, step: int) -> Iterator[pa.RecordBatch]:
        while self.step < step:
            held, self.held = self.held, []
            if self.step == -2:
                self.names = pa.concat_arrays([b.column("names").flatten() for b in held])
                self.bonus = np.concatenate([b.column("bonus").flatten().to_numpy() for b in held])
                self.inverse = 1 / np.sqrt(np.maximum(np.concatenate([b.column("sizes").flatten().to_numpy() for b in held]), 1))
            elif self.step == -1:
                self.keys = pa.concat_arrays([b.column("customer") for b in held]) if held else []
                if held:
                    (self.own, self.ends), (self.asked, self.asked_ends) = (_flat([b.column(x) for b in held]) for x in ("items", "users"))
            elif len(self.keys):
                yield from self._tile(held)
            self.step += 1

    def _tile(self, held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = len(self.bounds) - 2
        tile = min(self.step, 2 * last - self.step)
        places, sizes, users = (np.concatenate([np.zeros(0, np.int32), *[b.column(x).flatten().to_numpy() for b in held]]) for x in ("items", "sizes", "users"))
        held.clear()
        low, high = self.bounds[tile], self.bounds[tile + 1]
        if self.step <= last:
            start, size = np.zeros(high - low, np.int64), np.zeros(high - low, np.int64)
            start[places - low], size[places - low] = np.cumsum(sizes, dtype=np.int64) - sizes, sizes
            mine = np.flatnonzero((self.own >= low) & (self.own < high))
            own = self.own[mine]
            ends = np.concatenate([[0], np.cumsum(size[own - low])])
            others = np.empty(ends[-1], np.int32)
            for at in range(0, len(own), STEP):
                part = own[at:at + STEP] - low
                others[ends[at]:ends[min(at + STEP, len(own))]] = users.take(spans(start[part], size[part]))
            self.owners.append((others, ends, own, np.searchsorted(mine, self.ends)))
        if self.step >= last:
            # the items of the tile by user
            self.first = np.concatenate([[0], np.cumsum(np.bincount(users)), [len(users)]]) if len(users) else np.zeros(2, np.int64)
            order = users.astype(np.int64)
            del users
            order <<= 32
            order += np.repeat(places - low, sizes)
            order.sort()
            self.items = order.astype(np.int32)                                # the low half
            del order
            yield from self._scores(low, high)

    def _met(self, owners: tuple, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        """(items of the tile, their number by owned item) of the owners of the owned items lo to hi."""
        users, ends = owners[0][owners[1][lo]:owners[1][hi]], owners[1]
        known = np.minimum(users, len(self.first) - 2)                       # the last one is nobody, and owns nothing
        length = self.first[known + 1] - self.first[known]
        before = np.r_[0, np.cumsum(length)]
        return self.items.take(spans(self.first[known], length)).astype(np.intp), np.diff(before[ends[lo:hi + 1] - ends[lo]])

    def _runs(self) -> Iterator[tuple[int, int, bool]]:
        """Runs of customers of about `STEP` entries together; one with far more is alone and worked on in parts."""
        load = sum((ends[rows[1:]] - ends[rows[:-1]] for _, ends, _, rows in self.owners), np.zeros(len(self.keys), np.int64)) * (len(self.items) / max(1, len(self.first) - 2))
        alone = load > 16 * STEP
        run = np.cumsum(load + 1) // STEP
        starts = np.flatnonzero(np.r_[True, (run[1:] != run[:-1]) | alone[1:] | alone[:-1]])
        for a, z in zip(starts, [*starts[1:], len(run)], strict=True):
            yield int(a), int(z), bool(alone[a])

    def _scores(self, low: int, high: int) -> Iterator[pa.RecordBatch]:
        width = high - low
        total, seen, mark = np.zeros(width), np.zeros(width, bool), np.zeros(width, np.int64)
        inverse, bonus = self.inverse[low:high], self.bonus[low:high]
        out, waiting = [], 0
        for a, z, alone in self._runs():
            parts = []
            if not alone:
                for owners in self.owners:
                    met, n = self._met(owners, *owners[3][[a, z]])
                    parts.append((met, n, owners[2], owners[3], np.r_[0, np.cumsum(n)]))
            for u in range(a, z):
                own = self.own[self.ends[u]:self.ends[u + 1]]
                own = own[(own >= low) & (own < high)] - low
                if self.k is not None:
                    place = None
                elif self.listed:
                    seen[own] = True
                    place = np.flatnonzero(~seen)
                    seen[own] = False
                else:
                    place = self.asked[self.asked_ends[u]:self.asked_ends[u + 1]]
                    place = place[(place >= low) & (place < high)] - low
                if alone:
                    most = np.zeros(width)
                    for owners in self.owners:
                        for i in range(*owners[3][[u, u + 1]]):
                            value = self._count(owners, i, width) * self.inverse[owners[2][i]]
                            total += value
                            np.maximum(most, value, out=most)
                    item = np.flatnonzero(total)
                    most = None if place is None else most[place] * inverse[place]
                else:
                    item, by, n = [], [], []
                    for met, count, items, rows, ends in parts:
                        lo, hi = rows[u] - rows[a], rows[u + 1] - rows[a]
                        item.append(met[ends[lo]:ends[hi]])
                        by.append(items[rows[u]:rows[u + 1]])
                        n.append(count[lo:hi])
                    item, by, n = (x[0] if len(x) == 1 else np.concatenate([np.zeros(0, np.int64), *x]) for x in (item, by, n))
                    np.add.at(total, item, np.repeat(self.inverse[by], n))
                    most = None if place is None else self._most(item, by, n, place, mark, seen) * inverse[place]
                if place is None:
                    place = self._best(total, seen, item, own, inverse, bonus)
                out.append((u, place + low, total[place] * inverse[place], np.full(len(place), np.nan) if most is None else most))
                total[item] = 0
                waiting += len(place)
                if waiting > ROWS:
                    yield self._rows(out)
                    out, waiting = [], 0
        if out:
            yield self._rows(out)

    def _count(self, owners: tuple, i: int, width: int) -> np.ndarray:
        """Common buyers of an owned item and each item of the tile, some owners at a time."""
        users, count = owners[0][owners[1][i]:owners[1][i + 1]], np.zeros(width)
        for at in range(0, len(users), STEP):
            part = users[at:at + STEP]
            known = np.minimum(part, len(self.first) - 2)
            length = self.first[known + 1] - self.first[known]
            cut = np.r_[0, np.flatnonzero(np.diff(np.cumsum(length) // (4 * STEP))) + 1, len(part)]
            for lo, hi in zip(cut[:-1], cut[1:], strict=True):
                count += np.bincount(self.items[spans(self.first[known[lo:hi]], length[lo:hi])], minlength=width)
        return count

    def _best(self, total, seen, item, own, inverse, bonus) -> np.ndarray:
        """Places that may be among the `k` of highest sum and bonus: of those met all that may tie with the last, and as many not met, of the highest bonus."""
        k = self.k
        total[own] = 0
        near, least, top = total.take(item), -1.0, 4 * k
        near *= inverse.take(item)
        while len(near) >= k and least < 0:
            # an item that several owners give stands several times, so more than `k` are looked at
            some = np.argpartition(near, len(near) - top)[len(near) - top:] if len(near) > top else np.arange(len(near))
            each, first = np.unique(item[some], return_index=True)
            if len(each) >= k or top >= len(near):
                best = near[some[first]]
                best = best[best > 0]
                if len(best) < k:
                    break
                least = np.partition(best, len(best) - k)[len(best) - k]
            top *= 4
        # at least k score more than this without what popularity adds
        item = np.unique(item[near >= least - bonus[0] - NEAR] if least > 0 else item[near > 0])
        score = total[item] * inverse[item] + bonus[item]
        least = np.partition(score, len(score) - k)[len(score) - k] - NEAR if len(score) >= k else -1.0
        item, score = item[score >= least], score[score >= least]
        if bonus[0] < least:
            return item
        seen[own] = True
        free = lambda at, end, n: np.flatnonzero((total[at:end] == 0) & ~seen[at:end])[:n] + at
        found, at, size = np.zeros(0, np.int64), 0, 64
        while at < len(bonus) and bonus[at] >= least and len(found) < k:
            found = np.concatenate([found, free(at, at + size, k - len(found))])
            at, size = at + size, size * 2
        if len(found) == k:
            # places go by buyers, and by item for equal buyers; a bonus of fewer buyers may still be equal once rounded
            last = bonus[found[-1]]
            at = int(np.searchsorted(-bonus, -last, side="right"))
            while at < len(bonus) and bonus[at] >= last - NEAR:
                end = int(np.searchsorted(-bonus, -bonus[at], side="right"))
                found, at = np.concatenate([found, free(at, end, k)]), end
        seen[own] = False
        place, score = np.concatenate([item, found]), np.concatenate([score, bonus[found]])
        return place[score >= np.partition(score, len(score) - k)[len(score) - k] - NEAR] if len(place) > k else place

    def _most(self, item, by, n, place, mark, seen) -> np.ndarray:
        """The highest similarity of each place to an owned item, not yet over the root of the place's buyers."""
        most = np.zeros(len(place))
        if len(item) and len(place):
            if 4 * len(place) > len(seen):
                # nearly all places: those of the tile stand for themselves
                key, common = np.unique(np.repeat(np.arange(len(by)), n) * len(seen) + item, return_counts=True)
                most = np.zeros(len(seen))
                np.maximum.at(most, key % len(seen), common * self.inverse[by[key // len(seen)]])
                return most[place]
            seen[place] = True
            here = seen[item]
            seen[place] = False
            mark[place] = np.arange(len(place))
            key, common = np.unique(np.repeat(np.arange(len(by)), n)[here] * len(place) + mark[item[here]], return_counts=True)
            np.maximum.at(most, key % len(place), common * self.inverse[by[key // len(place)]])
        return most

    def _rows(self, out: list[tuple]) -> pa.RecordBatch:
        user, place, total, most = zip(*out, strict=True)
        return pa.RecordBatch.from_arrays([self.keys.take(pa.array(np.repeat(user, [len(p) for p in place]))), self.names.take(pa.array(np.concatenate(place))),
                                           pa.array(self.bonus[np.concatenate(place)]), pa.array(np.concatenate(total)), pa.array(np.concatenate(most), from_pandas=self.k is not None)],
                                          ["customer", "item", "bonus", "knn_sum", "knn_max"])


def _walked(k: int | None, listed: bool, bounds: Sequence[int]):
    """The rows of a block, by step, to its scores."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = None
        for b in batches:
            at = b.column("at").to_numpy()
            change = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else []
            for lo, hi in zip(change, [*change[1:], len(at)], strict=False):
                block = block or _Block(k, listed, bounds)
                yield from block.until(int(at[lo]))
                block.held.append(b.slice(lo, hi - lo))
        if block is not None:
            yield from block.until(2 * len(bounds) - 3)
    return run


def tiles(own: DataFrame, n_items: int) -> list[int]:
    """First places of tiles of at most about `PIECE` basket entries, and the end; a thousand sums reach the driver."""
    step = max(1, n_items // 1000)
    sums = {r.part: r.n for r in own.groupBy(F.floor(F.col("place") / step).cast("int").alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()}
    bounds, held = [0], 0
    for part in range(-(-n_items // step)):
        held += sums.get(part, 0)
        if held > PIECE and part * step > bounds[-1]:
            bounds.append(part * step)
            held = sums.get(part, 0)
    return [*bounds, n_items]


def walk_scores(own: DataFrame, active: DataFrame, items: DataFrame, n_items: int, others: int, k: int | None, asked: DataFrame | None) -> DataFrame:
    """(customer, item, bonus, knn_sum, knn_max (null with `k`)) of the unseen `items` (item, buyers, place) of `active` customers.

    All of them, or those that may be among the `k` of highest knn_sum + bonus, or the `asked` (customer, place), which
    are unseen. `own` holds the distinct (customer, place); there are about `others` owners of what each customer owns in all.
    """
    spark, c = own.sparkSession, F.col
    ship_package(spark)
    bounds = tiles(own, n_items)
    blocks = max(2 * spark.sparkContext.defaultParallelism, -(-others // HELD))
    lists = own.where("customer is not null").groupBy("customer").agg(F.sort_array(F.collect_list(c("place").cast("int"))).alias("items"))
    baskets = numbered(lists.join(active.select("customer", F.lit(True).alias("active")), "customer", "full"), "walk-baskets", "number")
    none = lambda kind: F.lit(None).cast(f"array<{kind}>")
    fields = lambda at, start, customer, items, sizes, users, bonus, names: [
        at.alias("at"), start.cast("int").alias("start"), customer.alias("customer"), items.alias("items"), sizes.alias("sizes"), users.alias("users"), bonus.alias("bonus"), names.alias("names")]
    kind, name = own.schema["customer"].dataType.simpleString(), items.schema["item"].dataType.simpleString()
    nobody = F.lit(None).cast(kind)
    # the buyers of an item, as the similarity counts them, and what popularity adds
    held = own.groupBy("place").agg(F.count(F.lit(1)).cast("int").alias("held"))
    part = items.join(held, "place", "left").groupBy(F.floor(c("place") / CHUNK).alias("start")).agg(F.sort_array(F.collect_list(F.struct(
        "place", F.coalesce("held", F.lit(0)).alias("n"), bonus().alias("b"), "item"))).alias("r"))                                  # CHUNK of them
    everywhere = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("part")
    shelf = part.select(everywhere, *fields(F.lit(-2), c("start"), nobody, none("int"), c("r.n"), none("int"), c("r.b"), c("r.item")))
    asking = baskets.where("active")
    if asked is not None:
        asking = asking.join(asked.groupBy("customer").agg(F.collect_list(c("place").cast("int")).alias("wanted")), "customer")
    wanted = c("wanted") if asked is not None else none("int")
    asking = asking.select(F.pmod(F.xxhash64("customer"), F.lit(blocks)).cast("int").alias("part"), *fields(F.lit(-1), F.lit(0), c("customer"), c("items"), none("int"), wanted, none("double"), none(name)))
    step = max(1, n_items // 1000)
    tile = F.element_at(F.lit([int(np.searchsorted(bounds, at, side="right")) - 1 for at in range(0, n_items, step)]), F.floor(c("place") / step).cast("int") + 1).cast("int")
    pieces = baskets.select("number", F.explode("items").alias("place")).groupBy("place").agg(F.sort_array(F.collect_list("number")).alias("users"))
    pieces = pieces.select(tile.alias("tile"), "place", "users").sortWithinPartitions("tile", "place").mapInArrow(
        _packed, "tile int, start int, items array<int>, sizes array<int>, users array<int>")
    last = len(bounds) - 2
    ways = F.explode(F.array_distinct(F.array(c("tile"), 2 * last - c("tile")))).alias("at")
    pieces = pieces.select("*", ways).select(everywhere, *fields(c("at"), c("start"), nobody, c("items"), c("sizes"), c("users"), none("double"), none(name)))
    rows = shelf.unionByName(asking).unionByName(pieces).repartitionById(blocks, c("part")).sortWithinPartitions("at", "start")
    return rows.mapInArrow(_walked(k, asked is None and k is None, bounds), f"customer {kind}, item {name}, bonus double, knn_sum double, knn_max double")
