"""Exact repeats of LENGTH bytes anywhere in a corpus, by induced sorting from anchors, and their removal.

A suffix array of all bytes is not needed to find repeats of a fixed length: in every window of LENGTH bytes the k-gram
with the smallest hash is its anchor (a choice by content, so equal windows have equal anchors at equal offsets), and only
suffixes that begin at anchors which occur twice are sorted.

1. Anchors of all texts are counted; a bit filter keeps those that occur twice at least.
2. Each such anchor gives a tuple (anchor, bytes to the right, bytes to the left).  Spark's external sorter, which spills
   to disk, orders the tuples by anchor and right-hand bytes; neighbours' longest common prefixes follow.
3. Induction: the order of the suffixes that begin one byte earlier follows from the present one by a stable deal on the
   preceding byte, and their common prefixes are the minima over the tuples in between.  After l steps, two neighbours
   whose common prefix is LENGTH - l at least are equal windows that begin l bytes before their anchors.
4. Windows become byte runs per text; runs are merged and cut out.

Everything compared is bytes; hashes only choose and group.  Texts with equal bytes are one text in 2-3, and tuples with
equal bytes in one text are one tuple with many positions.

Scale: texts are never shuffled except those that lose some bytes; the tuples of an anchor are dealt by anchor; the
filters are bounded (MAX_FILTER_BITS): if they fill up at very large inputs more tuples are sorted, with the same result.

Defined cases: null text counts as empty; texts below LENGTH bytes keep everything; repeated rows are copies and lose
everything if LENGTH bytes or longer; null ids are allowed; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm.common import _P, _P_INV, bit_filter, drop_staged, in_filter, mix, powers, slices, stage, take_column, text_bytes

LENGTH = 400
GRAM = 144
_W = LENGTH - GRAM + 1
_POS_BITS = 21
_CHUNK = (1 << 20) - LENGTH
#: Tuples that are ordered at once (whole anchors, so more if one anchor has more).
CHUNK_ROWS = 8_000


def _windows(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of a slice of at most 2**21 bytes: hash, position, first and last window that has it."""
    none = np.zeros(0, np.int64)
    n = len(data)
    if n < LENGTH:
        return none.view(np.uint64), none, none, none
    c = np.empty(n + 1, np.uint64)
    c[0] = 0
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(_P, n), out=c[1:])
    h = mix((c[GRAM:] - c[:-GRAM]) * powers(_P_INV, n + 1)[: n + 1 - GRAM])
    m, low = len(h), np.uint64((1 << _POS_BITS) - 1)
    pad = -m % _W
    key = np.full(m + pad, ~np.uint64(0))
    key[:m] = (h & ~low) | (low - np.arange(m, dtype=np.uint64))
    grid = key.reshape(-1, _W)
    ahead = np.minimum.accumulate(grid, 1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], 1)[:, ::-1].ravel()
    starts = np.concatenate([np.arange(a, b - LENGTH + 1) for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True) if b - a >= LENGTH] or [none])
    if not len(starts):
        return none.view(np.uint64), none, none, none
    at = (low - (np.minimum(back[starts], ahead[starts + _W - 1]) & low)).astype(np.int64)
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    return h[at[first]], at[first], starts[first], starts[last]


def _anchors(data: np.ndarray, offs: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For slices of texts: first byte of the slice, text of each anchor, and what _windows gives."""
    for i, j in slices(offs):
        if j - i > 1 or offs[j] - offs[i] <= 1 << 20:
            part = offs[i : j + 1] - offs[i]
            h, p, a, b = _windows(data[offs[i] : offs[j]], part)
            yield int(offs[i]), i + np.searchsorted(part, p, "right") - 1, h, p, a, b
        else:  # one long text in overlapping pieces; no window is in two of them
            for s in range(offs[i], offs[j] - LENGTH + 1, _CHUNK):
                e = min(offs[j], s + _CHUNK + LENGTH - 1)
                h, p, a, b = _windows(data[s:e], np.array([0, e - s]))
                yield int(s), np.full(len(h), i), h, p, a, b


def _fresh(batches, seen: set[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Bytes of the texts of LENGTH or more that this task has not met yet."""
    for batch in batches:
        data, offs = text_bytes(take_column(batch, "text"))
        use = []
        for i in np.flatnonzero(np.diff(offs) >= LENGTH).tolist():
            d = hashlib.blake2b(data[offs[i] : offs[i + 1]], digest_size=16).digest()
            if d not in seen:
                seen.add(d)
                use.append(i)
        if use:
            yield np.concatenate([data[offs[i] : offs[i + 1]] for i in use]), np.r_[0, np.cumsum([offs[i + 1] - offs[i] for i in use])]


def _count(batches):
    for data, offs in _fresh(batches, set()):
        for _, _, h, _, _, _ in _anchors(data, offs):
            v, n = np.unique(h, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(v.view(np.int64)), pa.array(n)], names=["anchor", "n"])


def text_key(raw: bytes | np.ndarray) -> str:
    return hashlib.sha256(raw).hexdigest()


def _tuples(wanted, bits: int):
    schema = pa.schema([("anchor", pa.int64()), ("right", pa.binary()), ("left", pa.binary()), ("key", pa.string()), ("at", pa.list_(pa.int64()))])

    def run(batches):
        flags = np.frombuffer(wanted.value, np.uint8)
        for data, offs in _fresh(batches, set()):
            keys: dict[int, str] = {}
            found: dict[tuple, list[int]] = {}
            for base, doc, h, p, a, b in _anchors(data, offs):
                hit = np.flatnonzero(in_filter(flags, bits, h.view(np.int64)))
                piece = data[base : base + (int(b.max()) + LENGTH if len(b) else 0)].tobytes()
                for d, x, q, s, e in zip(*(v[hit].tolist() for v in (doc, h.view(np.int64), p, a, b)), strict=True):
                    found.setdefault((d, x, piece[q : e + LENGTH], piece[s:q][::-1]), []).append(base + q - int(offs[d]))
            rows = list(found.items())
            for i in range(0, len(rows), 4096):
                part = rows[i : i + 4096]
                for (d, *_), _at in part:
                    if d not in keys:
                        keys[d] = text_key(data[offs[d] : offs[d + 1]])
                cols = [[k[1] for k, _ in part], [k[2] for k, _ in part], [k[3] for k, _ in part], [keys[k[0]] for k, _ in part], [v for _, v in part]]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, schema.types, strict=True)], schema=schema)

    return run


def _padded(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    column = column.cast(pa.large_binary())
    offs = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    size = np.diff(offs)
    out = np.zeros((len(size), width), np.uint8)
    inside = np.arange(width)[None, :] < size[:, None]
    out[inside] = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offs[0] : offs[-1]]
    return out, size


def repeated_windows(anchor: np.ndarray, right: pa.Array, left: pa.Array, many: np.ndarray) -> np.ndarray:
    """For tuples sorted by (anchor, right): whether the window that begins l bytes before the anchor is repeated.

    many: tuples that stand for two places or more.  The result has a row for each tuple and a column for each l.
    """
    r, r_len = _padded(right, LENGTH)
    left_bytes, l_len = _padded(left, _W)
    n = len(anchor)
    out = np.zeros((n, _W), bool)
    differ = r[1:] != r[:-1]
    lcp = np.zeros(n, np.int64)
    lcp[1:] = np.where(differ.any(1), differ.argmax(1), LENGTH)
    lcp[1:] = np.minimum(lcp[1:], np.minimum(r_len[1:], r_len[:-1]))
    same = np.zeros(n, bool)
    same[1:] = anchor[1:] == anchor[:-1]
    order = np.arange(n)
    for step in range(_W):
        # order: suffixes `step` bytes before their anchors, sorted; lcp counts from the anchor, `same` marks equal left parts
        hit = same & (lcp >= LENGTH - step)
        out[order[hit], step] = True
        before = np.flatnonzero(hit) - 1
        out[order[before], step] = True
        keep = np.flatnonzero(l_len[order] > step)
        if not len(keep):
            break
        group = np.cumsum(~same)[keep]
        key = group * 256 + left_bytes[order[keep], step]
        at = keep[np.argsort(key, kind="stable")]
        key = np.sort(key, kind="stable")
        tied = np.zeros(len(at), bool)
        tied[1:] = key[1:] == key[:-1]
        low = np.zeros(len(at), np.int64)
        i = np.flatnonzero(tied)
        if len(i):
            cuts = np.stack([at[i - 1] + 1, at[i] + 1], 1).ravel()
            low[i] = np.minimum.reduceat(np.append(lcp, 0), cuts)[::2]
        stay = tied.copy()
        stay[:-1] |= tied[1:]
        order, lcp, same = order[at][stay], low[stay], tied[stay]
        if not len(order):
            break
    first = np.maximum(LENGTH - r_len, 0)
    steps = np.arange(_W)[None, :]
    out |= many[:, None] & (steps >= first[:, None]) & (steps <= l_len[:, None])
    return out


def _runs(batches):
    """(key, start, stop) of byte runs that repeated windows cover, from tuples in order."""
    schema = pa.schema([("key", pa.string()), ("start", pa.int64()), ("stop", pa.int64())])

    def give(t: pa.Table):
        t = t.combine_chunks()
        one = [c.chunk(0) if c.num_chunks else pa.array([], c.type) for c in t.columns]
        anchor = np.asarray(one[0])
        sizes = np.diff(np.asarray(one[4].offsets))
        flags = repeated_windows(anchor, one[1], one[2], sizes > 1)
        edge = np.diff(np.pad(flags, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        row, lo = np.nonzero(edge == 1)
        _, hi = np.nonzero(edge == -1)
        # one row for each place of the tuple: windows l = lo .. hi - 1 begin at place - l
        times = sizes[row]
        places = np.asarray(one[4].values)
        first = np.asarray(one[4].offsets)[:-1][row]
        pick = np.repeat(first - np.r_[0, np.cumsum(times)[:-1]], times) + np.arange(times.sum()) if len(row) else np.zeros(0, np.int64)
        at = places[pick]
        return pa.RecordBatch.from_arrays([one[3].take(pa.array(np.repeat(row, times))), pa.array(at - np.repeat(hi, times) + 1), pa.array(at - np.repeat(lo, times) + LENGTH)], schema=schema)

    held: list[pa.RecordBatch] = []
    size = 0
    for b in batches:
        held.append(b)
        size += b.num_rows
        if size >= CHUNK_ROWS:
            t = pa.Table.from_batches(held)
            anchors = np.asarray(t.column(0))
            cut = int(np.searchsorted(anchors, anchors[-1]))  # the last anchor may go on
            if cut:
                yield give(t.slice(0, cut))
            held = t.slice(cut).combine_chunks().to_batches()
            size = t.num_rows - cut
    if size:
        yield give(pa.Table.from_batches(held))


def _cut_out(batches):
    for b in batches:
        out = []
        for key, text, runs in zip(take_column(b, "key").to_pylist(), take_column(b, "text").to_pylist(), take_column(b, "runs").to_pylist(), strict=True):
            raw, kept, end, removed, spans = text.encode(), hashlib.sha256(), 0, 0, 0
            for r in [*sorted((x["start"], x["stop"]) for x in runs), (len(raw), len(raw))]:
                if r[0] > end or (not spans and r[0] >= end and r[0] < len(raw)):
                    kept.update(raw[end : r[0]])
                    spans += r[0] < len(raw)
                    removed += len(raw[r[0] : r[1]])
                    end = r[1]
                elif r[1] > end:
                    removed += r[1] - end
                    end = r[1]
            out.append((key, removed, spans, kept.hexdigest()))
        cols = list(zip(*out, strict=True)) if out else [[], [], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.string())], names=["key", "n_removed", "n_spans", "kept_sha256"])


def _only(wanted, bits: int):
    def run(batches):
        flags = np.frombuffer(wanted.value, np.uint8)
        for b in batches:
            data, offs = text_bytes(take_column(b, "text"))
            size = np.diff(offs)
            at = np.flatnonzero(size >= LENGTH).tolist()
            keys = [text_key(data[offs[i] : offs[i + 1]]) for i in at]
            if keys:
                hit = in_filter(flags, bits, _key_hash(keys))
                yield pa.RecordBatch.from_arrays([pa.array([k for k, x in zip(keys, hit, strict=True) if x], pa.string()), take_column(b, "text").take(pa.array([i for i, x in zip(at, hit, strict=True) if x], pa.int64()))], names=["key", "text"])

    return run


def _key_hash(keys: list[str]) -> np.ndarray:
    return np.array([int(k[:16], 16) for k in keys], np.uint64).view(np.int64)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for every row of docs (doc_id, text)."""
    sc = docs.sparkSession.sparkContext
    texts = docs.select(F.coalesce("text", F.lit("")).alias("text"))
    raw = F.coalesce("text", F.lit("")).cast("binary")
    rows = stage(docs.select("doc_id", F.octet_length(raw).cast("long").alias("n_bytes"), F.sha2(raw, 256).alias("key")), "texts")

    counted = texts.mapInArrow(_count, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1").select("anchor")
    counted = stage(counted, "anchors")
    flags, bits = bit_filter(counted)
    wanted = sc.broadcast(flags)
    drop_staged(counted)
    tuples = texts.mapInArrow(_tuples(wanted, bits), "anchor long, right binary, left binary, key string, at array<long>")
    runs = tuples.repartition("anchor").sortWithinPartitions("anchor", "right").mapInArrow(_runs, "key string, start long, stop long")
    runs = stage(runs.distinct(), "runs")
    wanted.unpersist()

    copied = rows.where(F.col("n_bytes") >= LENGTH).groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    runs = runs.join(copied, "key", "left_anti")
    merged = stage(runs.groupBy("key").agg(F.collect_list(F.struct("start", "stop")).alias("runs")), "merged")
    flags, bits = bit_filter(merged.select(F.conv(F.substring("key", 1, 16), 16, -10).cast("long").alias("id")))
    some = sc.broadcast(flags)
    there = texts.mapInArrow(_only(some, bits), "key string, text string").join(merged, "key").dropDuplicates(["key"])
    cut = there.select("key", "text", "runs").mapInArrow(_cut_out, "key string, n_removed long, n_spans long, kept_sha256 string")
    cut = stage(cut, "cut")

    nothing = hashlib.sha256(b"").hexdigest()
    every = copied.withColumn("copied", F.lit(True))
    out = rows.join(every, "key", "left").join(cut, "key", "left")
    whole = F.col("copied").isNotNull()
    return out.select(
        "doc_id",
        "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(whole, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(whole, F.lit(nothing)).otherwise(F.coalesce("kept_sha256", "key")).alias("kept_sha256"),
    )
