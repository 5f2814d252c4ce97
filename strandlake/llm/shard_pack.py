"""Sharding by best-fit-decreasing bin packing of indivisible groups.

Groups (rows with equal texts) are sorted by size; each enters the bin with the tightest remaining capacity that still
holds it, found in a balanced tree of remaining capacities.  The number of shards is given and the smallest workable
capacity is searched, so sizes come out near equal (law `bytes`).

Scale: only groups of at least 1/(64 * shards) of all bytes (so at most 64 * shards of them) are packed one by one on
the driver.  Smaller ones are first packed, bucket by bucket and streaming in order of size, into pallets of that capacity;
the pallets, at most 2 * 64 * shards + MAX_BUCKETS, are then packed like the large groups.  A group larger than a shard's
share has a shard of its own.  Slots are numbered per (shard, hash bucket), with offsets added, so no shard passes through
one task.

Defined cases: null text has no bytes and all null texts are one group, apart from the empty text; repeated rows are
placed together; null ids are allowed; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlake.llm.common import stage, take_column

PALLETS_A_SHARD = 64
MAX_BUCKETS = 4096
ROW_BYTES = 16


class CapacityTree:
    """A balanced search tree (treap) of (remaining capacity, bin)."""

    def __init__(self, seed: int = 1):
        self.root, self.rnd = None, np.random.default_rng(seed)
        self.pool: list[float] = []

    def _priority(self) -> float:
        if not self.pool:
            self.pool = self.rnd.random(1024).tolist()
        return self.pool.pop()

    # a node is [key, priority, left, right]
    def _merge(self, a, b):
        if a is None or b is None:
            return a or b
        if a[1] > b[1]:
            a[3] = self._merge(a[3], b)
            return a
        b[2] = self._merge(a, b[2])
        return b

    def _split(self, t, key):
        if t is None:
            return None, None
        if t[0] < key:
            t[3], right = self._split(t[3], key)
            return t, right
        left, t[2] = self._split(t[2], key)
        return left, t

    def add(self, key: tuple[int, int]) -> None:
        a, b = self._split(self.root, key)
        self.root = self._merge(self._merge(a, [key, self._priority(), None, None]), b)

    def take_tightest(self, size: int) -> tuple[int, int] | None:
        """Remove and return the smallest entry whose remaining capacity is size at least."""
        a, b = self._split(self.root, (size, -1))
        if b is None:
            self.root = a
            return None
        up, t = None, b
        while t[2] is not None:
            up, t = t, t[2]
        if up is None:
            b = t[3]
        else:
            up[2] = t[3]
        self.root = self._merge(a, b)
        return t[0]


def best_fit(sizes: list[int], capacity: int) -> list[int]:
    """Bins of the items, which come in descending order of size; an item above the capacity has a bin of its own."""
    tree, bins, out = CapacityTree(), 0, []
    for size in sizes:
        found = tree.take_tightest(size)
        if found is None:
            found, bins = (capacity, bins), bins + 1
        out.append(found[1])
        if found[0] > size:
            tree.add((found[0] - size, found[1]))
    return out


def pack_into(sizes: list[int], shards: int) -> list[int]:
    """Bins 0..shards-1 for items in descending order: best fit at the smallest workable capacity found by halving."""
    own, rest, total = 0, list(sizes), sum(sizes)
    while rest and own < shards - 1 and rest[0] * (shards - own) > total:
        total -= rest.pop(0)
        own += 1
    if not rest:
        return list(range(own))
    bins = shards - own
    low = max(-(-total // bins), rest[0])
    high = -(-total // bins) + rest[0]  # always enough: else every bin would be fuller than the mean
    best = best_fit(rest, high)
    while low < high:
        mid = (low + high) // 2
        tried = best_fit(rest, mid)
        if max(tried) < bins:
            best, high = tried, mid
        else:
            low = mid + 1
    return [*range(own), *(own + b for b in best)]


def _palletize(capacity: int):
    """Packs the groups of each bucket, which come in descending order of size; only open pallets are kept."""

    def run(batches):
        bucket, tree, count = None, CapacityTree(), 0
        for b in batches:
            out = []
            for k, size in zip(take_column(b, "bucket").to_pylist(), take_column(b, "bytes").to_pylist(), strict=True):
                if k != bucket:
                    bucket, tree, count = k, CapacityTree(), 0
                found = tree.take_tightest(size)
                if found is None:
                    found, count = (capacity, count), count + 1
                if found[0] > size:
                    tree.add((found[0] - size, found[1]))
                out.append((k << 32) | found[1])
            yield pa.RecordBatch.from_arrays([take_column(b, "key"), take_column(b, "bytes"), pa.array(out, pa.int64())], names=["key", "bytes", "pallet"])

    return run


def shard_documents(docs: DataFrame, shards: int = 40) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for every row of docs (doc_id, text)."""
    raw = F.col("text").cast("binary")
    sized = docs.select(
        F.monotonically_increasing_id().alias("row"),
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + ROW_BYTES).cast("long").alias("size"),
        F.coalesce(F.crc32(raw), F.lit(0).cast("long")).alias("text_crc32"),
        F.coalesce(F.md5(raw), F.lit("")).alias("key"),
    )
    sized = stage(sized, "sizes")
    spark = sized.sparkSession
    groups = stage(sized.groupBy("key").agg(F.sum("size").alias("bytes")), "groups")
    all_ = groups.agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n")).first()
    total, capacity = all_.bytes or 0, max(1, (all_.bytes or 0) // (PALLETS_A_SHARD * shards))
    buckets = int(min(MAX_BUCKETS, max(1, all_.n // 20_000)))

    large = groups.where(F.col("bytes") >= capacity)
    small = groups.where(F.col("bytes") < capacity).withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)))
    small = small.repartition("bucket").sortWithinPartitions("bucket", F.desc("bytes"), "key")
    palleted = stage(small.select("key", "bytes", "bucket").mapInArrow(_palletize(capacity), "key string, bytes long, pallet long"), "pallets")

    # bounded: large groups by their share of the bytes, pallets by more than half of a pallet's for all but one a bucket
    items = [(r.bytes, "", r.key) for r in large.collect()]
    items += [(r.bytes, r.pallet, None) for r in palleted.groupBy("pallet").agg(F.sum("bytes").alias("bytes")).collect()]
    items.sort(key=lambda x: (-x[0], str(x[1]), str(x[2])))
    placed = pack_into([x[0] for x in items], shards) if total else []
    keys = [(x[2], s) for x, s in zip(items, placed, strict=True) if x[2] is not None]
    pallets = [(x[1], s) for x, s in zip(items, placed, strict=True) if x[2] is None]
    of_key = spark.createDataFrame(keys, "key string, shard int")
    of_pallet = spark.createDataFrame(pallets, "pallet long, shard int")
    # a text that is repeated very often is a large group: these are few and broadcast, the others have few rows each
    marked = sized.join(F.broadcast(of_key), "key", "left")
    small = marked.where("shard is null").drop("shard").join(palleted.join(F.broadcast(of_pallet), "pallet").select("key", "shard"), "key")
    placed_rows = marked.where("shard is not null").unionByName(small)

    slots = max(1, sized.count() // (shards * 5_000))
    there = placed_rows.withColumn("deal", F.pmod(F.xxhash64("doc_id", "row"), F.lit(slots)))
    there = stage(there.select("row", "doc_id", "size", "text_crc32", "shard", "deal"), "placed")
    before = Window.partitionBy("shard").orderBy("deal").rowsBetween(Window.unboundedPreceding, -1)
    starts = there.groupBy("shard", "deal").agg(F.count("*").alias("n")).select("shard", "deal", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("at"))
    numbered = there.withColumn("no", F.row_number().over(Window.partitionBy("shard", "deal").orderBy("doc_id", "row")) - 1)
    out = numbered.join(starts, ["shard", "deal"])
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("at") + F.col("no")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
