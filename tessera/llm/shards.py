"""Sharding by minimax contiguous partition of atomic groups.

Rows with equal texts are one group and never part. Groups are ordered by a 128-bit hash of their text; the
shards are consecutive runs of that order, and the largest shard is as small as any such cut allows: the
smallest feasible capacity is found by binary search, each capacity being checked greedily.

No group list reaches the driver. It gets the sums of at most 16**``DIGITS`` runs of groups, finds from them the
interval of capacities that could be the answer, and looks closer at just the runs in which a cut could then fall: runs of
few groups are fetched, larger ones are summed again by further digits, and only the finer run in which the cut falls is
looked into. Cuts are keys, so rows find their shard by comparing hashes, without a join.

Defined results: a null text counts as an empty one (size 1, crc of no bytes); rows with equal ids are rows
of their own; with fewer groups than shards the last shards stay empty; an empty table gives an empty table;
further columns are not looked at.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.lean import lean
from tessera.llm.store import saved

#: Hexadecimal digits of a key that name a block: the driver holds the sums of 16**DIGITS blocks at most, and fetches at most
#: MOST_FETCHED groups of a block at once; larger blocks are summed by further digits first.
DIGITS, MOST_FETCHED = 4, 1 << 16


def greedy_cuts(sizes: list[int], capacity: int, shards: int) -> list[int] | None:
    """Ends of the runs that a greedy fill of ``capacity`` makes of ``sizes``; None if it takes more than ``shards``."""
    sums = np.r_[0, np.cumsum(sizes)].tolist()
    ends, at = [], 0
    while at < len(sizes):
        to = bisect.bisect_right(sums, sums[at] + capacity) - 1
        if to == at or len(ends) == shards:
            return None
        ends.append(to)
        at = to
    return ends + [len(sizes)] * (shards - len(ends))


def smallest_capacity(sizes: list[int], shards: int) -> int:
    """The smallest capacity with which a greedy fill takes at most ``shards`` runs."""
    lo, hi = max(max(sizes, default=0), -(-sum(sizes) // shards)), sum(sizes)
    while lo < hi:
        mid = (lo + hi) // 2
        lo, hi = (lo, mid) if greedy_cuts(sizes, mid, shards) else (mid + 1, hi)
    return lo


class Block:
    """The groups of a block in order: a list where they are few, else finer blocks that are looked into when a cut falls there."""

    def __init__(self, parts: list[tuple[int, str, object]]) -> None:
        """parts: (sum, least key, None for a group or a function that gives the finer block)."""
        self.parts = parts
        self.ends = np.cumsum([p[0] for p in parts]).tolist()

    def cut(self, room: int) -> tuple[int, str]:
        """(sum of the longest run from the first group with sum <= room, key of the group after it); the block's sum is larger."""
        at = bisect.bisect_right(self.ends, room)
        before, (_, key, finer) = self.ends[at - 1] if at else 0, self.parts[at]
        if finer is None:
            return before, key
        more, key = finer().cut(room - before)
        return before + more, key


def refined(prefix: str, number: int, summed, listed, most: int = MOST_FETCHED) -> Block:
    """The block of the keys that begin with ``prefix``: ``summed(prefixes, digits)`` sums finer ones, ``listed(prefix)`` fetches groups."""
    if number <= most or len(prefix) >= 32:
        return Block([(size, key, None) for key, size in sorted(listed(prefix))])
    finer = summed([prefix], min(DIGITS, 32 - len(prefix)))
    return Block([(s, key, lru_cache(maxsize=1)(lambda p=p, n=n: refined(p, n, summed, listed, most))) for p, (s, _, n, key) in sorted(finer.items())])


class Sums:
    """Group sizes by block, looked into only where a cut could fall."""

    def __init__(self, blocks: list[tuple[int, int]], fetch) -> None:
        """blocks: (sum, largest group) by number; fetch(numbers) gives {number: ``Block``}."""
        self.ends = np.cumsum([s for s, _ in blocks]).tolist()
        self.largest = max((m for _, m in blocks), default=0)
        self.fetch, self.known = fetch, {}

    def cut(self, target: int) -> tuple[int, str | None]:
        """(sum of the longest run of groups from the first with sum <= target, key of the group after it)."""
        b = bisect.bisect_right(self.ends, target)
        if b == len(self.ends):
            return self.ends[-1] if self.ends else 0, None
        if b not in self.known:
            self.known |= self.fetch([b])
        at = self.ends[b - 1] if b else 0
        more, key = self.known[b].cut(target - at)
        return at + more, key

    def fill(self, capacity: int, shards: int) -> list[str | None] | None:
        """First keys of shards 1, 2, ...; None if the groups do not fit."""
        keys, at = [], 0
        for _ in range(shards):
            at, key = self.cut(at + capacity)
            keys.append(key)
            if key is None:
                return (keys + [None] * shards)[: shards - 1]
        return None

    def bracket(self, shards: int) -> tuple[int, int]:
        """Capacities between which the answer lies, from the blocks' sums alone."""
        total = self.ends[-1] if self.ends else 0
        lo = hi = max(self.largest, -(-total // shards))
        blocks = np.diff([0, *self.ends]).tolist()
        if blocks:
            hi = max(lo, smallest_capacity(blocks, shards))
        return lo, hi

    def spans(self, lo: int, hi: int, shards: int) -> set[int]:
        """Blocks in which a cut could fall with a capacity from lo to hi: a cut is in its target's block or at its start."""
        found, a, b, last = set(), 0, 0, len(self.ends) - 1
        for _ in range(shards - 1):
            first, final = bisect.bisect_right(self.ends, a + lo), bisect.bisect_right(self.ends, b + hi)
            found |= set(range(first, min(final, last) + 1))
            a, b = max(a, self.ends[min(first, last + 1) - 1] if first else 0), b + hi
        return found

    def solve(self, shards: int, few: int = 64) -> tuple[int, list[str | None]]:
        """(smallest capacity, first keys of shards 1, 2, ...)."""
        lo, hi = self.bracket(shards)
        if len(want := self.spans(lo, hi, shards)) <= few and want:
            self.known |= self.fetch(sorted(want))
        while lo < hi:
            mid = (lo + hi) // 2
            lo, hi = (lo, mid) if self.fill(mid, shards) is not None else (mid + 1, hi)
        return lo, self.fill(lo, shards) or [None] * (shards - 1)


def _rows(docs: DataFrame, text: str) -> DataFrame:
    """(doc_id, size, text_crc32, key): a few bytes for each document, so that no later step moves texts."""
    value = F.coalesce(F.col(text), F.lit(""))
    return docs.select("doc_id", (F.octet_length(value) + 1).cast("long").alias("size"), F.crc32(value.cast("binary")).alias("text_crc32"), F.md5(value.cast("binary")).alias("key"))


def sharded(docs: DataFrame, shards: int = 8, text: str = "text") -> DataFrame:
    """Put every row into a shard: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    spark = docs.sparkSession
    ordered = saved(_rows(docs, text).repartitionByRange("key", "doc_id").sortWithinPartitions("key", "doc_id").withColumn("part", F.spark_partition_id()), "rows")
    groups = saved(ordered.groupBy("key").agg(F.sum("size").alias("size")), "groups")

    def summed(prefixes: list[str], digits: int) -> dict[str, tuple[int, int, int, str]]:
        """(sum, largest, number, least key) of the groups whose keys begin with the prefixes, by ``digits`` more digits."""
        some = groups.where(F.substring("key", 1, len(prefixes[0])).isin(prefixes)) if prefixes != [""] else groups
        block = F.substring("key", 1, len(prefixes[0]) + digits).alias("block")
        rows = some.groupBy(block).agg(F.sum("size").alias("s"), F.max("size").alias("m"), F.count("*").alias("n"), F.min("key").alias("key")).collect()
        return {r["block"]: (r["s"], r["m"], r["n"], r["key"]) for r in rows}

    found = summed([""], DIGITS)
    blocks = sorted(found)

    def fetch(numbers: list[int]) -> dict[int, list[tuple[str, int]]]:
        return {n: refined(blocks[n], found[blocks[n]][2], summed, lambda p: [(r["key"], r["size"]) for r in groups.where(F.col("key").startswith(p)).collect()]) for n in numbers}

    _, cuts = Sums([found[b][:2] for b in blocks], fetch).solve(shards)
    shard = F.lit(0)
    for key in cuts:
        if key is not None:
            shard = shard + (F.col("key") >= F.lit(key)).cast("int")
    placed = ordered.withColumn("shard", shard.cast("int"))
    before = {(r["part"], r["shard"]): r["n"] for r in placed.groupBy("part", "shard").agg(F.count("*").alias("n")).collect()}
    start, filled = {}, {}
    for part, s in sorted(before):
        start[part, s] = filled.get(s, 0)
        filled[s] = filled.get(s, 0) + before[part, s]

    @lean
    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[int, int], int] = {}
        for batch in batches:
            part, of = np.asarray(batch.column("part")), np.asarray(batch.column("shard"))
            slot = np.zeros(len(part), np.int64)
            both = part.astype(np.int64) * shards + of
            for k in np.unique(both).tolist():
                at, key = np.flatnonzero(both == k), divmod(k, shards)
                slot[at] = start[key] + seen.get(key, 0) + np.arange(len(at))
                seen[key] = seen.get(key, 0) + len(at)
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("doc_id", "size", "text_crc32", "shard")] + [pa.array(slot)], names=["doc_id", "size", "text_crc32", "shard", "slot"])

    whole = spark.createDataFrame([], ordered.schema) if not before else placed
    found = _by_part(whole).mapInArrow(slots, "doc_id long, size long, text_crc32 long, shard int, slot long")
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def _by_part(placed: DataFrame) -> DataFrame:
    """Rows of each part in one task, in order. A part is a range of keys and ids, of a size that the range split has evened out."""
    return placed.repartition("part").sortWithinPartitions("part", "key", "doc_id")


def text_crc(text: str | None) -> int:
    """text_crc32 as brute force has it."""
    return zlib.crc32((text or "").encode())


#: The same cut in SQL: the smallest capacity by binary search over prefix sums of groups, each capacity filled greedily.
ORACLE = """
with recursive r as (select doc_id, cast(octet_length(encode(coalesce(text, ''))) + 1 as bigint) as size, md5(coalesce(text, '')) as key from documents),
g as (select key, sum(size) as size from r group by key),
e as (select key, size, sum(size) over (order by key) as upto from g),
o as (select list(upto order by key) as ends, list(key order by key) as keys, max(size) as largest, max(upto) as total from e),
-- One row a step: a search interval, the capacity tried, and how far its greedy fill has come.
f(lo, hi, cap, pos, n, cuts, step) as (
    select cast(greatest(largest, ceil(total / 8)) as bigint), cast(total as bigint), cast((greatest(largest, ceil(total / 8)) + total)::bigint // 2 as bigint), cast(0 as bigint), 0, cast([] as varchar[]), 0 from o
    union all
    select case when done and not fits then cap + 1 else lo end, case when done and fits then cap else hi end,
        case when not done then cap when fits then (lo + cap) // 2 else (cap + 1 + hi) // 2 end,
        case when done then 0 else next end, case when done then 0 else n + 1 end, case when done then [] else list_append(cuts, coalesce(keys[next_at + 1], '~')) end, step + 1
    from (select f.*, keys, next_at, case when next_at = 0 then 0 else ends[next_at] end as next, pos >= total or n = 8 as done, pos >= total as fits
        from f, o, lateral (select len(list_filter(ends, lambda x: x <= f.pos + f.cap)) as next_at)) where not (lo = hi and done)),
c as (select cuts from f, o where lo = hi and cap = lo and pos >= total limit 1),
-- The crc of each distinct text, byte by byte.
t as (select list(c order by n) as t from (select n, list_reduce(range(0, 8), lambda a, k: case when a & 1 = 1 then xor(a >> 1, 3988292384) else a >> 1 end, n) as c from (select unnest(range(0, 256)) as n))),
x as (select key, hex(encode(any_value(text))) as h from (select coalesce(text, '') as text, md5(coalesce(text, '')) as key from documents) group by key),
y as (select key, xor(list_reduce(list_transform(range(0, len(h) // 2), lambda i: cast('0x' || h[2 * i + 1:2 * i + 2] as bigint)), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]), 4294967295), 4294967295) as text_crc32 from x, t),
p as (select r.*, cast((select len(list_filter(cuts, lambda k: k <= r.key)) from c) as int) as shard from r)
select doc_id, size, text_crc32, 'bytes' as law, shard, cast(row_number() over (partition by shard order by key, doc_id) - 1 as bigint) as slot, cast(null as int) as grown_shard from p join y using (key)
"""
