"""Filling fixed-capacity containers with items of varying length: minimum bin slack.

Only the histogram of item lengths reaches the driver; it has at most one row
per length up to the capacity, however many items there are.  From the largest
length left, a bitset subset-sum over the lengths left finds the multiset that
comes closest to the capacity; the pattern is repeated while the counts last,
so every pattern uses up at least one length and there are at most as many
patterns as lengths.  The plan says, for each length, which ranks go to which
containers; items find their container by their rank within their length, by a
binary search in the plan, which is broadcast (its size depends on the capacity
only).

An item longer than the capacity is cut into full containers and a rest; no
other item is ever split.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.session import saved

#: Rows of one length that are ranked in one task.
RANKED_TOGETHER = 200_000
#: A bound on the capacity C: the histogram has C rows at most, the plan C patterns of at most sqrt(2 C) lengths each.
MOST_CAPACITY = 1 << 17
#: Bytes of bitsets kept in one search.
KEPT = 1 << 26


def fill(histogram: dict[int, int], capacity: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Patterns ``[(length, items of it), ...]`` and how many containers take each."""
    left = {size: n for size, n in histogram.items() if n > 0}
    order = sorted(left, reverse=True)
    plan = []
    while order:
        pattern = _closest(order, left, capacity)
        times = min(left[size] // n for size, n in pattern)
        plan.append((pattern, times))
        for size, n in pattern:
            left[size] -= n * times
        order = [size for size in order if left[size]]
    return plan


def _closest(order: list[int], left: dict[int, int], capacity: int) -> list[tuple[int, int]]:
    """The multiset with the largest length in it whose sum comes closest to the capacity.

    ``reached`` has bit s set where a sum of s can be made; copies are added in
    powers of two.  For the way back each step keeps the sums it was the first to
    make; beyond ``KEPT`` bytes these are turned into the number of the step of
    each sum, so memory is bounded by the capacity.
    """
    first = order[0]
    room = capacity - first
    mask = (1 << (room + 1)) - 1
    reached = 1
    lots: list[tuple[int, int]] = []
    made_by, pending = np.zeros(room + 1, np.int32), []
    for size in order:
        if size > room:
            continue
        copies = min(left[size] - (size == first), room // size)
        lot = 1
        while copies > 0:
            take = min(lot, copies)
            new = (reached << (size * take)) & mask & ~reached
            if new:
                pending.append(new)
                lots.append((size, take))
                if len(pending) * room > 8 * KEPT:
                    _unpack(pending, len(lots), made_by)
                reached |= new
            copies -= take
            lot *= 2
        if reached >> room:
            break
    at = reached.bit_length() - 1
    used: dict[int, int] = {first: 1}
    # a sum was made from one that an earlier step had made
    for step in range(len(lots) - 1, len(lots) - 1 - len(pending), -1):
        if pending.pop() >> at & 1:
            size, take = lots[step]
            used[size] = used.get(size, 0) + take
            at -= size * take
    while at:
        size, take = lots[made_by[at]]
        used[size] = used.get(size, 0) + take
        at -= size * take
    return list(used.items())


def _unpack(pending: list[int], steps: int, made_by: np.ndarray) -> None:
    """Notes the step of each sum of the last steps, and drops their bitsets."""
    for step, new in enumerate(pending, steps - len(pending)):
        bits = np.frombuffer(new.to_bytes(len(made_by) // 8 + 1, "little"), np.uint8)
        made_by[np.flatnonzero(np.unpackbits(bits, bitorder="little")[: len(made_by)])] = step
    pending.clear()


@dataclass
class Plan:
    """Which ranks of each length go to which containers: segments in order of length and rank."""

    base: np.ndarray  # ranks of smaller lengths, by length
    starts: np.ndarray  # base of the length plus the first rank
    each: np.ndarray  # items of a container
    first: np.ndarray  # the first container

    def containers(self, rest: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """The container of each item, by a binary search for its segment."""
        at = self.base[rest] + rank
        segment = np.searchsorted(self.starts, at, side="right") - 1
        return self.first[segment] + (at - self.starts[segment]) // self.each[segment]


def _plan(histogram: dict[int, int], capacity: int) -> tuple[Plan, int]:
    """The plan of one capacity and its number of containers."""
    base = np.zeros(capacity + 2, np.int64)
    for size, n in histogram.items():
        base[size + 1] = n
    base = np.cumsum(base)
    taken, rows, container = base.copy(), [], 0
    for pattern, times in fill(histogram, capacity):
        for size, n in pattern:
            rows.append((taken[size], n, container))
            taken[size] += n * times
        container += times
    starts, each, first = (np.array(sorted(rows), np.int64).reshape(-1, 3)).T
    return Plan(base, starts, each, first), container


def pack(items: DataFrame, sizes: Iterable[tuple[str, int]], key: str = "doc_id", length: str = "n_tokens") -> DataFrame:
    """Every item of ``items`` assigned to containers of each named capacity.

    Returns size_name, capacity_tokens, container_id, ``key``, part (0, 1, ...
    of a cut item), start and n_tokens (the item's tokens that the container
    takes).  Rows of a null key, a null length or a length below 1 hold nothing
    and are left out; a key sent twice is one item (of its greatest length); no
    rows give no rows.
    """
    sizes = [(str(name), int(capacity)) for name, capacity in sizes]
    if any(not 0 < capacity <= MOST_CAPACITY for _, capacity in sizes):
        raise ValueError(f"capacities must be from 1 to {MOST_CAPACITY}")
    kind = dict(items.dtypes)[key]
    spark = items.sparkSession
    plain = items.select(F.col(key).alias("item"), F.col(length).cast("bigint").alias("size")).filter("item is not null and size > 0")
    once = saved(plain.groupBy("item").agg(F.max("size").alias("size")))
    parts = None
    for name, capacity in sizes:
        rest = F.col("size") % capacity
        one = once.select(
            F.lit(name).alias("size_name"),
            F.lit(capacity).alias("capacity_tokens"),
            "item",
            "size",
            rest.alias("rest"),
            (F.col("size") - rest).alias("cut"),
        )
        parts = one if parts is None else parts.unionByName(one)
    schema = f"size_name string, capacity_tokens int, container_id bigint, `{key}` {kind}, part int, start bigint, n_tokens int"
    if parts is None:
        return spark.createDataFrame([], schema)
    counts = once.groupBy("size").agg(F.count("*").alias("n"))
    # at most one row per rest and capacity, so its size has a bound
    rests = None
    for name, capacity in sizes:
        one = counts.groupBy((F.col("size") % capacity).alias("rest")).agg(F.sum("n").alias("n")).select(F.lit(name).alias("size_name"), "rest", "n")
        rests = one if rests is None else rests.unionByName(one)
    histograms: dict[str, dict[int, int]] = {name: {} for name, _ in sizes}
    for row in rests.collect():
        if row["rest"]:
            histograms[row["size_name"]][row["rest"]] = row["n"]
    plans, offsets = {}, {}
    for name, capacity in sizes:
        plans[name], offsets[name] = _plan(histograms[name], capacity)
    sent = spark.sparkContext.broadcast(plans)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, rests, ranks = (batch.column(i) for i in range(3))
            containers = np.zeros(len(names), np.int64)
            named, rest, rank = np.array(names.to_pylist()), rests.to_numpy(zero_copy_only=False), ranks.to_numpy(zero_copy_only=False)
            for name in set(named.tolist()):
                of = named == name
                containers[of] = sent.value[name].containers(rest[of], rank[of])
            yield pa.RecordBatch.from_arrays([*batch.columns[3:], pa.array(containers)], [*batch.schema.names[3:], "container_id"])

    ranked = _ranked(parts.filter("rest > 0"), ["size_name", "rest"], "item", max([n for h in histograms.values() for n in h.values()], default=0))
    rest_rows = ranked.select("size_name", "rest", "rank", F.col("size_name").alias("name"), "capacity_tokens", "item", "cut", F.col("rest").alias("tokens")).mapInArrow(
        placed, f"name string, capacity_tokens int, item {kind}, cut bigint, tokens bigint, container_id bigint"
    ).select(
        F.col("name").alias("size_name"), "capacity_tokens", "container_id", "item",
        (F.col("cut") / F.col("capacity_tokens")).cast("int").alias("part"), F.col("cut").alias("start"), F.col("tokens").cast("int").alias("n_tokens"),
    )
    # an item with full parts owns their containers: ids behind those of the rests, numbered by a prefix sum
    big = parts.filter("cut > 0").withColumn("full", F.floor(F.col("cut") / F.col("capacity_tokens")))
    numbered = _summed(big, "size_name", "full", "item")
    shift: Column = F.lit(0)
    for name, container in offsets.items():
        shift = F.when(F.col("size_name") == name, container).otherwise(shift)
    full_rows = numbered.select("size_name", "capacity_tokens", "item", (shift + F.col("before")).alias("base"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("full") - 1)).alias("k")).select(
        "size_name", "capacity_tokens", (F.col("base") + F.col("k")).alias("container_id"), "item", F.col("k").cast("int").alias("part"), (F.col("k") * F.col("capacity_tokens")).alias("start"), F.col("capacity_tokens").alias("n_tokens")
    )
    return rest_rows.unionByName(full_rows).select(
        "size_name", F.col("capacity_tokens").cast("int"), F.col("container_id").cast("bigint"), F.col("item").alias(key), "part", "start", "n_tokens"
    )


def _salted(df: DataFrame, by: str, most: int) -> DataFrame:
    """A salt from the key, so that a hot group is spread over tasks of a bounded size."""
    salts = max(8, -(-most // RANKED_TOGETHER))
    return df.withColumn("salt", F.pmod(F.xxhash64(by), F.lit(salts)).cast("int"))


def _ranked(df: DataFrame, group: list[str], by: str, most: int) -> DataFrame:
    """``rank`` from 0 within each group, by (salt, key): a rank within the salt plus the salts before it."""
    salted = _salted(df, by, most)
    before = Window.partitionBy(*group).orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    base = salted.groupBy(*group, "salt").count().withColumn("base", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    inner = salted.withColumn("row", F.row_number().over(Window.partitionBy(*group, "salt").orderBy(by)) - 1)
    return inner.join(base, [*group, "salt"]).withColumn("rank", F.col("row") + F.col("base")).drop("row", "base", "salt")


def _summed(df: DataFrame, group: str, value: str, by: str) -> DataFrame:
    """``before``: the sum of ``value`` over the rows before, by (salt, key), within the group."""
    salted = df.withColumn("salt", F.pmod(F.xxhash64(by), F.lit(4096)).cast("int"))
    earlier = Window.partitionBy(group).orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    base = salted.groupBy(group, "salt").agg(F.sum(value).alias("s")).withColumn("base", F.coalesce(F.sum("s").over(earlier), F.lit(0))).drop("s")
    within = Window.partitionBy(group, "salt").orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    inner = salted.withColumn("inner", F.coalesce(F.sum(value).over(within), F.lit(0)))
    return inner.join(base, [group, "salt"]).withColumn("before", F.col("inner") + F.col("base")).drop("inner", "base", "salt")


def fill_report(packed: DataFrame) -> DataFrame:
    """Containers, tokens and the used share of each size."""
    return (
        packed.groupBy("size_name", "capacity_tokens")
        .agg(F.countDistinct("container_id").alias("containers"), F.sum("n_tokens").alias("tokens"))
        .withColumn("used_share", F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")))
    )
