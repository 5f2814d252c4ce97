"""Helpers that the training-data operators share: staged tables, components, fast text hashing.

Text kernels work on UTF-8 bytes with numpy.  They are handed small slices of a batch, so memory
depends on the longest single text and not on the batch.
"""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one call of a numpy kernel takes (a longer single text is taken alone).
SLICE_BYTES = 1 << 20
_LOCAL_DIR: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster; only where none is named (tests) a local one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _LOCAL_DIR:
        _LOCAL_DIR.append(tempfile.mkdtemp(prefix="strandlake-"))
        import shutil

        atexit.register(shutil.rmtree, _LOCAL_DIR[0], True)
    return _LOCAL_DIR[0]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/strandlake/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write a table into the shared folder and read it back: a cut of the lineage that outlives any executor."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._staged_path = path  # type: ignore[attr-defined]
    return out


def drop_staged(df: DataFrame) -> None:
    """Delete a staged table that no later plan reads."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._staged_path)  # type: ignore[attr-defined]
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Rows of a few longs that are broadcast at most; beyond it they are joined by shuffle.
MAX_BROADCAST_ROWS = 500_000


def bounded(small: DataFrame) -> DataFrame:
    """A staged table with the broadcast hint if it is small enough."""
    small = stage(small, "small")
    return F.broadcast(small) if small.count() <= MAX_BROADCAST_ROWS else small


@contextlib.contextmanager
def batch_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Smaller Arrow batches for rows that carry whole texts or sets; for plans that run inside the block."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, was)


def give_back() -> None:
    """Forget tables that are quickly made again, and give freed memory back to the system."""
    _POW.clear()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no malloc_trim
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def lean(run: Callable) -> Callable:
    """A batch function whose worker gives freed memory back to the system before its task and when it ends."""

    @functools.wraps(run)
    def wrapped(batches):
        give_back()
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


#: Pairs of a forest that are joined in one task at most; more are joined by rounds.
MAX_FOREST_ROWS = 500_000


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the pairs and the smallest id that each can reach; nodes that reach none smaller are left out."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    least = np.arange(len(nodes))
    while len(x):
        u, v = np.maximum(x, y), np.minimum(x, y)
        np.minimum.at(least, u, v)
        while (least[least] != least).any():
            least = least[least]
        x, y = least[x], least[y]
        apart = x != y
        x, y = x[apart], y[apart]
    down = np.flatnonzero(least != np.arange(len(nodes)))
    return nodes[down], nodes[least[down]]


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The forest of a task's pairs (u, v)."""
    u = v = np.zeros(0, np.int64)
    held, size = [], 0
    for b in batches:
        held.append((np.asarray(take_column(b, "u")), np.asarray(take_column(b, "v"))))
        size += b.num_rows
        if size > max(1 << 20, len(u)):
            u, v = forest(*(np.concatenate(x) for x in zip((u, v), *held, strict=True)))
            held, size = [], 0
    if held:
        u, v = forest(*(np.concatenate(x) for x in zip((u, v), *held, strict=True)))
    if len(u):
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])


def components(edges: DataFrame) -> DataFrame:
    """Connected components of (a, b) pairs as (id, component), component being the smallest id.

    Each task first makes a forest of its pairs, with a row for each node at most.  Forests of up to MAX_FOREST_ROWS
    rows are joined in one task; more by alternating large-star and small-star rounds over DataFrames: every step keeps
    at most as many pairs as before, each round is staged, and no node's neighbours are gathered in one row.
    Nulls and self-pairs are ignored; isolated nodes are not returned.
    """
    pairs = edges.select(F.greatest("a", "b").cast("long").alias("u"), F.least("a", "b").cast("long").alias("v")).where("u > v")
    pairs = stage(pairs.mapInArrow(_forests, "u long, v long"), "edges")

    def star(p: DataFrame, large: bool) -> DataFrame:
        both = p.union(p.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else p
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        out = both.join(least, "u")
        if large:
            return out.where("v > u and v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        moved = out.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        return moved.union(least.select("u", F.col("m").alias("v"))).distinct()

    def mark(p: DataFrame) -> tuple:
        return tuple(p.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first())

    seen = mark(pairs)
    while seen[0]:
        if seen[0] <= MAX_FOREST_ROWS:
            whole = stage(pairs.coalesce(1).mapInArrow(_forests, "u long, v long"), "edges")
            drop_staged(pairs)
            pairs = whole
            break
        after = stage(star(star(pairs, True), False), "edges")
        drop_staged(pairs)
        pairs, was, seen = after, seen, mark(after)
        if seen == was:
            break
    return pairs.select(F.col("u").alias("id"), F.col("v").alias("component")).union(
        pairs.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    )


# ---------------------------------------------------------------- bounded bit filters

#: log2 of the most bits of a filter on ids (64 MB).
MAX_FILTER_BITS = 29
BLOCK = 1 << 16


def cut_blocks(sketch: np.ndarray) -> list[tuple[int, bytes]]:
    """The blocks of a byte array that hold anything, numbered."""
    blocks = [(i // BLOCK, sketch[i : i + BLOCK]) for i in range(0, len(sketch), BLOCK)]
    return [(b, x.tobytes()) for b, x in blocks if x.any()]


def _filter_bits(ids: np.ndarray, bits: int) -> np.ndarray:
    return (mix(ids.view(np.uint64)) >> np.uint64(64 - bits)).astype(np.int64)


def in_filter(flags: np.ndarray, bits: int, ids: np.ndarray) -> np.ndarray:
    at = _filter_bits(ids, bits)
    return (flags[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def bit_filter(ids: DataFrame) -> tuple[bytes, int]:
    """A bit array over the hashed longs of a one-column table, of at most 2**MAX_FILTER_BITS bits.

    No id is missed, a few others pass.  Blocks are merged on the executors; the driver receives the array.
    """
    bits = int(np.clip(np.ceil(np.log2(16 * max(1, ids.count()))), 19, MAX_FILTER_BITS))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = np.zeros((1 << bits) // 8, np.uint8)
        for b in batches:
            at = _filter_bits(np.asarray(b.column(0)), bits)
            np.bitwise_or.at(flags, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))
        blocks = cut_blocks(flags)
        if blocks:
            yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in blocks], pa.int32()), pa.array([x for _, x in blocks], pa.binary())], names=["block", "flags"])

    def join(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags, block = np.zeros(0, np.uint8), 0
        for b in tables:
            for no, x in zip(take_column(b, "block").to_pylist(), take_column(b, "flags").to_pylist(), strict=True):
                v, block = np.frombuffer(x, np.uint8), no
                flags = v | flags if len(flags) else v
        if len(flags):
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([flags.tobytes()], pa.binary())], names=["block", "flags"])

    out = np.zeros((1 << bits) // 8, np.uint8)
    # staged first: an iterator over the partitions of a shuffle runs a job for each, one after the other
    merged = stage(ids.mapInArrow(mark, "block int, flags binary").groupBy("block").applyInArrow(join, "block int, flags binary"), "filter")
    for r in merged.toLocalIterator():
        part = np.frombuffer(r.flags, np.uint8)
        out[r.block * BLOCK : r.block * BLOCK + len(part)] = part
    drop_staged(merged)
    return out.tobytes(), bits


# ---------------------------------------------------------------- bytes and words

_MASK = (1 << 64) - 1
_P = 0x9E3779B97F4A7C15 | 1
_P_INV = pow(_P, -1, 1 << 64)
_POW: dict[int, np.ndarray] = {}

#: White space of the word rule: space and 0x09-0x0D.
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; filled by doubling and kept up to a few slices."""
    have = _POW.get(base)
    if have is not None and len(have) >= n:
        return have[:n]
    size = 1 << max(16, n.bit_length())
    out, full = np.ones(size, dtype=np.uint64), 1
    while full < size:
        more = min(full, size - full)
        np.multiply(out[:more], np.uint64(pow(base, full, 1 << 64)), out=out[full : full + more])
        full += more
    if size <= 8 * SLICE_BYTES:
        _POW[base] = out
    return out[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column one after the other, and the n+1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offs - offs[0]


def slices(offs: np.ndarray, most: int = SLICE_BYTES, rows: int = 60_000) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most `most` bytes together (at least one row each)."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + most, "right")) - 1)
        j = min(n, j, i + rows)
        yield i, j
        i = j


def word_spans(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words `[^\\x20\\x09-\\x0D]+`, and the n+1 word offsets of the texts."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    ns = ~IS_SPACE[data]
    first = np.zeros(len(data) + 1, bool)
    first[offs] = True
    before = np.empty(len(data), bool)
    before[0] = False
    before[1:] = ns[:-1]
    starts = np.flatnonzero(ns & (~before | first[:-1]))
    after = np.empty(len(data), bool)
    after[-1] = False
    after[:-1] = ns[1:]
    ends = np.flatnonzero(ns & (~after | first[1:])) + 1
    return starts, ends, np.searchsorted(starts, offs)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, from one running polynomial sum."""
    c = np.empty(len(data) + 1, np.uint64)
    c[0] = 0
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(_P, len(data)), out=c[1:])
    return mix((c[ends] - c[starts]) * powers(_P_INV, len(data) + 1)[starts] + (ends - starts).astype(np.uint64))


def trim_spans(keep: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word spans without the bytes at either end that are not to be kept (empty at the end if none is)."""
    n = len(keep)
    back = np.minimum.accumulate(np.where(keep, np.arange(n), n)[::-1])[::-1]
    ahead = np.maximum.accumulate(np.where(keep, np.arange(n), -1))
    a = np.minimum(back[starts], ends)
    return a, np.maximum(ahead[ends - 1] + 1, a)


_STEP = [np.uint64((0xD6E8FEB86659FD93 * (2 * k + 1) ** 3 | 1) & _MASK) for k in range(32)]


def shingle_sets(data: np.ndarray, offs: np.ndarray, k: int = 5, short: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-word shingle hashes of every text (A-Z lowered), sorted within the text, with n+1 offsets.

    With fewer than k words the whole sequence is one shingle if `short`; without words there is none.
    """
    data = LOWER[data]
    starts, ends, wo = word_spans(data, offs)
    w = span_hashes(data, starts, ends)
    n_docs = len(offs) - 1
    counts = np.diff(wo)
    doc = np.repeat(np.arange(n_docs, dtype=np.int64), counts)
    h, d = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if len(w) >= k:
        m = len(w) - k + 1
        h = w[:m] * _STEP[0]
        for j in range(1, k):
            h = h + w[j : j + m] * _STEP[j]
        ok = doc[:m] == doc[k - 1 :]
        h, d = mix(h[ok]), doc[:m][ok]
    if short:
        for n in range(1, k):
            at = np.flatnonzero(counts == n)
            if len(at):
                s = np.full(len(at), n, np.uint64)
                for j in range(n):
                    s = s + w[wo[at] + j] * _STEP[j]
                h, d = np.concatenate([h, mix(s)]), np.concatenate([d, at])
    order = np.argsort(h)
    order = order[np.argsort(d[order].astype(np.uint16) if n_docs < 65536 else d[order], kind="stable")]
    h, d = h[order], d[order]
    if len(h):
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
        h, d = h[new], d[new]
    return h, np.searchsorted(d, np.arange(n_docs + 1))


def take_column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))
