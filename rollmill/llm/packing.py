"""Filling containers of fixed capacity: swap-based local search from a cheap first assignment."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Items of one independent packing. Containers hold few items each, so what shards of this size waste at their ends is negligible.
SHARD_ITEMS = 10_000
#: The kinds of containers are a stated table of at most so many rows; more are refused.
MAX_KINDS = 1_000


def next_fit(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """The first assignment: items in the given order, each into the last container or, if that can't take it, a new one."""
    containers: list[list[int]] = []
    room = 0
    for item, s in enumerate(sizes.tolist()):
        if s > room:
            containers.append([])
            room = capacity
        containers[-1].append(item)
        room -= s
    return containers


class _Index:
    """Numbers with what stands under them, and the smallest number from some value on: one bit for each number in use.

    What stands under a number carries the version of its container, and is skipped once that has changed.
    """

    def __init__(self, version: list[int]):
        self.version, self.bits, self.under = version, 0, {}

    def add(self, number: int, container: int, item: int = -1) -> None:
        self.under.setdefault(number, []).append((container, self.version[container], item))
        self.bits |= 1 << number

    def at(self, number: int) -> list[tuple[int, int, int]]:
        valid = [x for x in self.under[number] if self.version[x[0]] == x[1]]
        if valid:
            self.under[number] = valid
        else:
            del self.under[number]
            self.bits &= ~(1 << number)
        return valid

    def next(self, number: int) -> int | None:
        """The smallest number in use from ``number`` on."""
        above = self.bits >> number
        return number + (above & -above).bit_length() - 1 if above else None


class _Search:
    """Containers of one shard, with indexes of the underfull ones: by room, and by what an item of theirs could be exchanged for."""

    def __init__(self, containers: list[list[int]], sizes: np.ndarray, capacity: int):
        self.containers, self.size, self.capacity = containers, sizes.tolist(), capacity
        self.fill = [sum(self.size[i] for i in c) for c in containers]
        self.version = [0] * len(containers)
        self.rooms, self.exchanges = _Index(self.version), _Index(self.version)
        for k in range(len(containers)):
            self.file(k)

    def file(self, k: int) -> None:
        self.version[k] += 1
        room = self.capacity - self.fill[k]
        if 0 < room < self.capacity:
            self.rooms.add(room, k)
            for b in {self.size[i]: i for i in self.containers[k]}.values():
                self.exchanges.add(room + self.size[b], k, b)

    def gain(self, donor: int, k: int, shift: int) -> int:
        """Half of what the sum of squared fills rises by."""
        return shift * (self.fill[k] - self.fill[donor] + shift)

    def move(self, donor: int, amount: int) -> tuple[int, int, int] | None:
        """(gain, container, -1): the fullest other container with room for ``amount``."""
        number = self.rooms.next(amount)
        while number is not None:
            for k, _, _ in self.rooms.at(number):
                if k != donor:
                    gain = self.gain(donor, k, amount)
                    return (gain, k, -1) if gain > 0 else None
            number = self.rooms.next(number + 1)
        return None

    def exchange(self, donor: int, amount: int) -> tuple[int, int, int] | None:
        """(gain, container, item): a smaller item of another container for ``amount``, leaving as little room there as possible."""
        number = self.exchanges.next(amount)
        while number is not None and number - amount < self.capacity:
            best = None
            for k, _, b in self.exchanges.at(number):
                shift = amount - self.size[b]
                if k != donor and shift > 0:
                    gain = self.gain(donor, k, shift)
                    if gain > 0 and (best is None or gain > best[0]):
                        best = gain, k, b
            if best:
                return best
            number = self.exchanges.next(number + 1)
        return None

    def apply(self, donor: int, out: tuple[int, ...], k: int, back: int) -> None:
        shift = sum(self.size[i] for i in out) - (self.size[back] if back >= 0 else 0)
        self.containers[donor] = [i for i in self.containers[donor] if i not in out] + ([back] if back >= 0 else [])
        self.containers[k] = [i for i in self.containers[k] if i != back] + list(out)
        self.fill[donor] -= shift
        self.fill[k] += shift
        self.file(k)

    def step(self, donor: int) -> bool:
        """The first kind of step that the donor can make: an item moves, one is exchanged for one, or two for one."""
        own = {self.size[i]: i for i in self.containers[donor]}
        for amount in sorted(own, reverse=True):
            found = self.move(donor, amount)
            if found:
                self.apply(donor, (own[amount],), found[1], found[2])
                return True
        singles = [(found, (i,)) for amount, i in own.items() if (found := self.exchange(donor, amount))]
        if not singles:
            items = self.containers[donor]
            pairs = {self.size[a] + self.size[b]: (a, b) for x, a in enumerate(items) for b in items[x + 1 :]}
            singles = [(found, pair) for amount, pair in pairs.items() if (found := self.exchange(donor, amount))]
        if not singles:
            return False
        (_, k, back), out = max(singles, key=lambda x: x[0][0])
        self.apply(donor, out, k, back)
        return True


def local_search(containers: list[list[int]], sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Empties containers, the least filled first, by moves, one-for-one and two-for-one exchanges with other underfull ones.

    Every step raises the sum of squared fills, so the search ends. It goes over the underfull containers until a whole
    sweep makes no step, or as few are left as the items need at least.
    """
    search = _Search([list(c) for c in containers], sizes, capacity)
    least = -(-int(sizes.sum()) // capacity) if len(sizes) else 0
    alive = len(containers)
    stepped = True
    while stepped and alive > least:
        stepped = False
        for donor in sorted((k for k, f in enumerate(search.fill) if 0 < f < capacity), key=lambda k: search.fill[k]):
            if not 0 < search.fill[donor] < capacity:
                continue
            search.version[donor] += 1  # out of the indexes while it gives
            while search.fill[donor] and search.step(donor):
                stepped = True
            if search.fill[donor]:
                search.file(donor)
            else:
                alive -= 1
                if alive <= least:
                    break
    return [c for c in search.containers if c]


def pack_shard(rows: pd.DataFrame, capacity: int) -> pd.DataFrame:
    """Places the rows (id, size) of one shard: container, container of the first assignment, id, piece, first token and tokens of the piece."""
    ids, sizes = rows["id"].to_numpy(), rows["size"].to_numpy().astype(np.int64)
    order = np.lexsort((ids, sizes))
    order = order[np.random.default_rng(17).permutation(len(order))]
    ids, sizes = ids[order], sizes[order]
    whole = sizes // capacity
    full_owner = np.repeat(np.arange(len(ids)), whole)
    full_piece = np.arange(len(full_owner)) - np.repeat(np.cumsum(whole) - whole, whole)
    rest = sizes - whole * capacity
    some = np.flatnonzero(rest > 0)
    first = next_fit(rest[some], capacity)
    first_of = np.repeat(np.arange(len(first)), [len(c) for c in first]).astype(np.int64)  # next fit keeps the order of the items
    packed = local_search(first, rest[some], capacity)
    items = np.array([i for c in packed for i in c], np.int64)
    member = some[items]
    number = np.repeat(np.arange(len(packed)), [len(c) for c in packed]).astype(np.int64)
    return pd.DataFrame(
        {
            "container": np.concatenate([np.arange(len(full_owner)), len(full_owner) + number]).astype(np.int64),
            "first_container": np.concatenate([np.arange(len(full_owner)), len(full_owner) + first_of[items]]).astype(np.int64),
            "id": np.concatenate([ids[full_owner], ids[member]]),
            "piece": np.concatenate([full_piece, whole[member]]).astype(np.int32),
            "first_token": np.concatenate([full_piece * capacity, whole[member] * capacity]).astype(np.int64),
            "n_tokens": np.concatenate([np.full(len(full_owner), capacity), rest[member]]).astype(np.int32),
        }
    )


def pack_with_first(sizes: DataFrame, id: str, size: str, kinds: DataFrame, kind: str = "kind", capacity: str = "capacity", shard_items: int = SHARD_ITEMS) -> DataFrame:
    """:func:`pack` with ``first_container``, where the first assignment had put the item."""
    items = sizes.where(F.col(id).isNotNull() & (F.col(size) > 0)).select(F.col(id).alias("id"), F.col(size).cast("bigint").alias("size"))
    listed = kinds.where((F.col(capacity) >= 1) & F.col(kind).isNotNull()).select(F.col(kind).cast("string"), F.col(capacity).cast("bigint")).distinct()
    stated = sorted(tuple(r) for r in listed.limit(MAX_KINDS + 1).collect())
    if len(stated) > MAX_KINDS:
        raise ValueError(f"more than {MAX_KINDS} kinds of containers")
    if len({k for k, _ in stated}) < len(stated):
        raise ValueError("a kind of container is listed with several capacities")
    type_of_id = sizes.schema[id].dataType.simpleString()
    schema = f"kind string, container bigint, first_container bigint, id {type_of_id}, piece int, first_token bigint, n_tokens int"
    if not stated:
        return items.sparkSession.createDataFrame([], schema).withColumnRenamed("id", id)
    shards = max(1, -(-items.count() // shard_items))
    # Rows of one id are dealt to different shards, too: the place of the row in the table counts.
    dealt = items.withColumn("shard", F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.lit(shards)).cast("int"))
    wanted = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(c).cast("bigint").alias("capacity")) for k, c in stated])
    every = dealt.select("id", "size", "shard", F.explode(wanted).alias("x")).select("id", "size", "shard", "x.kind", "x.capacity")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out = pack_shard(rows, int(rows["capacity"].iloc[0]))
        for column in ("container", "first_container"):
            out[column] += np.int64(rows["shard"].iloc[0]) << 32
        out.insert(0, "kind", rows["kind"].iloc[0])
        return out

    # Few bytes, but much work: the number of tasks is stated, so that it isn't derived from the bytes.
    tasks = min(shards * len(stated), 4 * sizes.sparkSession.sparkContext.defaultParallelism + shards * len(stated) // 16)
    spread = every.repartition(max(1, tasks), "kind", "capacity", "shard")
    return spread.groupBy("kind", "capacity", "shard").applyInPandas(run, schema).withColumnRenamed("id", id)


def pack(sizes: DataFrame, id: str, size: str, kinds: DataFrame, kind: str = "kind", capacity: str = "capacity", shard_items: int = SHARD_ITEMS) -> DataFrame:
    """Places every item in containers of every kind: (``kind``, ``container``, ``id``, ``piece``, ``first_token``, ``n_tokens``).

    No container holds more than its capacity. An item is split only if it exceeds the capacity by itself: into full containers and
    a rest, pieces numbered from 0, which is placed like any other item. Items of null or non-positive size and null ids need no
    place and give no row; so do kinds whose name is null or whose capacity is null or below 1; more than ``MAX_KINDS`` kinds,
    and kinds with several capacities, are refused. Repeated rows are items of their own; an empty table gives an empty result; other columns aren't read.

    Items are dealt by hash to shards of about ``shard_items``, so a task's memory is bounded whatever the input. Every (kind, shard)
    is packed on its own: a next fit in seeded order, then :func:`local_search`, which moves items and exchanges one for one or two for
    one among underfull containers, each step raising the sum of squared fills, until no container can be emptied any more.
    """
    return pack_with_first(sizes, id, size, kinds, kind, capacity, shard_items).drop("first_container")
