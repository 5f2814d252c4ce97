"""N-gram Jaccard join by vertical partitioning.

Every text becomes the set of its distinct word n-grams.  All n-grams stand in one global order: those that no other
text has first, then by hash.  The order is cut into fragments, the overlaps of a pair in each fragment are counted
apart, and the counts are summed per pair.

Only n-grams that recur in other texts can overlap, so the fragments also say early which texts can be linked at all:

1. One pass over the texts gives the size and signature of each set, and the n-grams of the first fragment (a third).
   They are dealt by hash; a text with more than n - ceil(0.8 n) n-grams that recur nowhere can be linked with nothing.
   An n-gram leaves a task once at most, however often it occurs there, so no frequent n-gram makes a hot group.
2. The texts that are left give all their n-grams.  Those that recur among them are gathered by text; texts with too few
   are out as well.  The first live - ceil(0.8 n) + 1 recurring n-grams of a set are its prefix: two linked sets share
   one in their prefixes (the prefix theorem).
3. Lists of the prefixes give pairs.  Rows carry a bitmap of their recurring n-grams, which bounds the overlap from above.
   In two rounds every set is compared with its best neighbours of other components in its lists; then all pairs between
   components that the bitmaps allow are compared.  Lists of more than SPLIT rows are cut into parts, and pairs of parts.
4. Pairs are verified: overlaps are counted fragment by fragment and summed.

So a group of n near copies costs O(n) comparisons, sets with equal n-grams are one set throughout, and what is sent
around is about the n-grams of the texts that may be linked.

Sets are named by a 64-bit sum of mixed hashes, and n-grams by 64-bit hashes: with N different sets the odds that any two
share a name are N**2 / 2**65.

Defined cases: null text and text without words have an empty set and link with nothing (component = own id); rows with
a null id are returned with a null component and link with nothing; repeated ids and rows are kept, one output row for
each input row, and different texts under one id are different documents; an empty table gives an empty result; very
long texts are hashed alone; further columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm.common import batch_rows, bit_filter, bounded, components, drop_staged, in_filter, lean, mix, shingle_sets, slices, stage, take_column, text_bytes

#: Fragments of the global order (equal ranges of hashes).
FRAGMENTS = 3
#: N-grams of the first fragment that a task holds before it sends them on.
HELD_GRAMS = 1 << 20
#: Texts that it holds until then: slices have at most as many rows, so owners fit into 16 bits.
HELD_ROWS = 32_000
#: Bits of the bitmap of a set's recurring n-grams.
BITMAP_BITS = 1024
#: Rows of a list before the present one that it is compared with in a round.
NEIGHBOURS = 8
#: Longer lists are cut into parts of about so many rows.
SPLIT = 1024
#: Rows of a list whose pairs are tested at once.
_ROWS_AT_ONCE = 256
#: Ids by which texts are picked with a bit filter (64 MB); beyond it they are joined by shuffle.
MAX_FILTER_IDS = 50_000_000
#: Rows of an Arrow batch: they hold texts or sets, so a batch is a few MB.
_BATCH_ROWS = 2000
#: Bytes of text whose sets are made at once (a longer single text is taken alone).
_SLICE_BYTES = 1 << 18
#: Parts in which the labels of repeated sets are spread when they are given back to the rows.
_SALTS = 16
_MANY = np.uint16(65535)


def _sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """(ids, hashes, offsets) for small slices of the rows."""
    for batch in batches:
        ids = take_column(batch, "doc_id")
        data, offs = text_bytes(take_column(batch, "text"))
        for i, j in slices(offs, _SLICE_BYTES, HELD_ROWS):
            h, o = shingle_sets(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], k)
            yield ids.slice(i, j - i), h, o


def _names(h: np.ndarray, o: np.ndarray) -> np.ndarray:
    """A sum of mixed hashes for each set: it depends on the set alone."""
    c = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(mix(h ^ np.uint64(0x1F83D9ABFB41BD6B)), out=c[1:])
    return (c[o[1:]] - c[o[:-1]]).view(np.int64)


def _need(n: np.ndarray, num: int, den: int) -> np.ndarray:
    """The least overlap of a set of n with any set that it is linked to."""
    return -(-n.astype(np.int64) * num // den)


def _links(differ: np.ndarray, both: np.ndarray, num: int, den: int) -> np.ndarray:
    """Whether two sets of `both` n-grams together, of which `differ` are in one only, are linked."""
    return differ * (den + num) <= (den - num) * both


# ---------------------------------------------------------------- the first fragment


_SURVEY = pa.schema([("doc_id", pa.int64()), ("sid", pa.int64()), ("n", pa.int64()), ("first", pa.int64()), ("live", pa.int64()), ("ref", pa.int64()), ("bucket", pa.int32()), ("base", pa.int64()), ("grams", pa.binary()), ("owners", pa.binary())])
_SURVEY_SQL = "doc_id long, sid long, n long, first long, live long, ref long, bucket int, base long, grams binary, owners binary"


def _survey(k: int, bucket_bits: int):
    """Names and sizes of all sets, and the n-grams of the first fragment by bucket.

    A row of a text has the number of its n-grams in the fragment and how many of them recur in this task's share; a row
    of a bucket has 32 bits of each n-gram and its owner, or _MANY if it has several here.
    """

    def run(batches):
        base = TaskContext.get().partitionId() << 20  # a number for each share of a task that is sent on
        seen: set[int] = set()
        held: list[tuple] = []
        size = rows = 0

        def flush():
            nonlocal base
            ids = pa.concat_arrays([x[0] for x in held])
            sid, n, use = (np.concatenate([x[i] for x in held]) for i in (1, 2, 3))
            doc = np.concatenate([x[5] + at for x, at in zip(held, np.cumsum([0, *(len(x[1]) for x in held[:-1])]), strict=True)])
            h = np.concatenate([x[4] for x in held])
            order = np.argsort(h)
            h, doc = h[order], doc[order]
            same = np.zeros(len(h) + 1, bool)
            same[1:-1] = h[1:] == h[:-1]
            live = same[1:] | same[:-1]
            count = len(sid)
            found = np.bincount(doc[live], minlength=count)
            ref = (base << 16) + np.arange(count)
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(sid, mask=~use), pa.array(n), pa.array(np.bincount(doc, minlength=count)), pa.array(found), pa.array(ref, mask=np.bincount(doc, minlength=count) == 0), pa.nulls(count, pa.int32()), pa.nulls(count, pa.int64()), pa.nulls(count, pa.binary()), pa.nulls(count, pa.binary())],
                schema=_SURVEY,
            )
            once = ~same[:-1]
            h, owner = h[once], np.where(live, _MANY, doc.astype(np.uint16))[once]
            if len(h):
                bucket = (h >> np.uint64(64 - bucket_bits)).astype(np.int64)
                grams = (h >> np.uint64(32 - bucket_bits)).astype(np.uint32)
                cut = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True])
                m = len(cut) - 1
                pairs = list(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True))
                yield pa.RecordBatch.from_arrays(
                    [*[pa.nulls(m, pa.int64())] * 6, pa.array(bucket[cut[:-1]].astype(np.int32)), pa.array(np.full(m, base)), pa.array([grams[i:j].tobytes() for i, j in pairs], pa.binary()), pa.array([owner[i:j].tobytes() for i, j in pairs], pa.binary())],
                    schema=_SURVEY,
                )
            base += 1

        for ids, h, o in _sets(batches, k):
            n, sid = np.diff(o), _names(h, o)
            use = (n > 0) & ~np.asarray(ids.is_null())
            new = use.copy()
            for i in np.flatnonzero(use).tolist():  # equal sets are given once a task
                name = int(sid[i])
                new[i] = name not in seen
                seen.add(name)
            doc = np.repeat(np.arange(len(n)), n)
            keep = ((h & np.uint64(0xFFFF)) < np.uint64(0x10000 // FRAGMENTS)) & new[doc]
            held.append((ids.cast(pa.int64()), sid, n, use, h[keep], doc[keep]))
            size, rows = size + len(held[-1][4]), rows + len(n)
            if size >= HELD_GRAMS or rows >= HELD_ROWS:
                yield from flush()
                held, size, rows = [], 0, 0
        if held:
            yield from flush()

    return run


def _recurring_owners(batches):
    """From the buckets, which come in order: owners of n-grams that recur, packed by base, with the number of such n-grams."""
    schema = pa.schema([("base", pa.int64()), ("owners", pa.binary()), ("counts", pa.binary())])
    waiting: list[np.ndarray] = []

    def give():
        refs, counts = np.unique(np.concatenate(waiting), return_counts=True)
        waiting.clear()
        cut = np.flatnonzero(np.r_[True, refs[1:] >> 16 != refs[:-1] >> 16, True]) if len(refs) else np.zeros(1, np.int64)
        pairs = list(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True))
        owners, counts = (refs & 0xFFFF).astype(np.uint16), counts.astype(np.uint32)
        return pa.RecordBatch.from_arrays([pa.array(refs[cut[:-1]] >> 16), pa.array([owners[i:j].tobytes() for i, j in pairs], pa.binary()), pa.array([counts[i:j].tobytes() for i, j in pairs], pa.binary())], schema=schema)

    def close(group):
        grams = np.concatenate([np.frombuffer(g, np.uint32) for _, g, _ in group])
        owners = np.concatenate([np.frombuffer(x, np.uint16) for _, _, x in group])
        bases = np.repeat(np.array([b for b, _, _ in group], np.int64), [len(g) // 4 for _, g, _ in group])
        key = np.sort(grams.astype(np.uint64) << np.uint64(32) | np.arange(len(grams), dtype=np.uint64))
        at, gram = (key & np.uint64(0xFFFFFFFF)).astype(np.int64), key >> np.uint64(32)
        same = np.zeros(len(gram) + 1, bool)
        same[1:-1] = gram[1:] == gram[:-1]
        at = at[same[1:] | same[:-1]]
        at = at[owners[at] != _MANY]
        waiting.append(bases[at] << 16 | owners[at])

    group, now = [], None
    for b in batches:
        for bucket, *row in zip(*(take_column(b, c).to_pylist() for c in ("bucket", "base", "grams", "owners")), strict=True):
            if bucket != now and group:
                close(group)
                group = []
                if sum(map(len, waiting)) > HELD_GRAMS:
                    yield give()
            now = bucket
            group.append(row)
    if group:
        close(group)
    if waiting:
        yield give()


def _added(batches):
    """(ref, live) from the packed counts, which come in order of base."""
    schema = pa.schema([("ref", pa.int64()), ("live", pa.int64())])
    now, sums = None, np.zeros(0, np.int64)

    def give():
        at = np.flatnonzero(sums)
        return pa.RecordBatch.from_arrays([pa.array((now << 16) + at), pa.array(sums[at])], schema=schema)

    for b in batches:
        for base, owners, counts in zip(*(take_column(b, c).to_pylist() for c in ("base", "owners", "counts")), strict=True):
            if base != now:
                if now is not None:
                    yield give()
                now, sums = base, np.zeros(1 << 16, np.int64)
            sums += np.bincount(np.frombuffer(owners, np.uint16), np.frombuffer(counts, np.uint32), 1 << 16).astype(np.int64)
    if now is not None:
        yield give()


# ---------------------------------------------------------------- recurring n-grams of the texts that are left


def _grams(k: int, flags, id_bits: int):
    """(h, sid, n) of the picked texts; n is negated where h recurs in this task, and a row (h, 0, 0) tells others so."""
    schema = pa.schema([("h", pa.int64()), ("sid", pa.int64()), ("n", pa.int64())])

    def picked(batches):
        data = None if flags is None else np.frombuffer(flags.value, np.uint8)
        for b in batches:
            ids = take_column(b, "doc_id")
            use = ~np.asarray(ids.is_null())
            if data is not None:
                use &= in_filter(data, id_bits, np.asarray(ids.fill_null(-1)))
            yield b.filter(pa.array(use))

    def run(batches):
        held: list[tuple] = []
        size = 0

        def flush():
            h, sid, n = (np.concatenate([x[i] for x in held]) for i in range(3))
            order = np.argsort(h)
            h, sid, n = h[order], sid[order], n[order]
            same = np.zeros(len(h) + 1, bool)
            same[1:-1] = h[1:] == h[:-1]
            live, first = same[1:] | same[:-1], same[1:] & ~same[:-1]
            token = np.zeros(int(first.sum()), np.int64)
            cols = [(h.view(np.int64), h[first].view(np.int64)), (sid, token), (np.where(live, -n, n), token)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in cols], schema=schema)

        for _, h, o in _sets(picked(batches), k):
            n = np.diff(o)
            held.append((h, np.repeat(_names(h, o), n), np.repeat(n, n)))
            size += len(h)
            if size >= HELD_GRAMS:
                yield from flush()
                held, size = [], 0
        if held:
            yield from flush()

    return run


def _recurring(batches):
    """Rows (sid, n, h) whose n-gram recurs, from rows that come in order of (n < 0 first, h)."""
    schema = pa.schema([("sid", pa.int64()), ("n", pa.int64()), ("h", pa.int64())])
    held = None  # the last row, not decided yet: h, sid, n, whether the row before has its n-gram
    for b in batches:
        h, sid, n = (np.asarray(take_column(b, c)) for c in ("h", "sid", "n"))
        known = n < 0
        if known.any():
            yield pa.RecordBatch.from_arrays([pa.array(sid[known]), pa.array(-n[known]), pa.array(h[known])], schema=schema)
            h, sid, n = h[~known], sid[~known], n[~known]
        if not len(h):
            continue
        if held:
            h, sid, n = np.r_[held[0], h], np.r_[held[1], sid], np.r_[held[2], n]
        same = np.zeros(len(h) + 1, bool)
        same[1:-1] = h[1:] == h[:-1]
        same[0] = bool(held and held[3])
        live = (same[1:] | same[:-1]) & (n > 0)
        live[-1] = False
        if live.any():
            yield pa.RecordBatch.from_arrays([pa.array(sid[live]), pa.array(n[live]), pa.array(h[live])], schema=schema)
        held = (h[-1], sid[-1], n[-1], same[-2])
    if held and held[3] and held[2] > 0:
        yield pa.RecordBatch.from_arrays([pa.array([held[1]]), pa.array([held[2]]), pa.array([held[0]])], schema=schema)


_SETS_SQL = "sid long, n long, live long, frag int, data binary, bitmap binary"


def _gathered(num: int, den: int):
    """Sets that can be linked, from rows (sid, n, h) in order of sid: a row -1 with prefix and bitmap, and one for each fragment."""
    schema = pa.schema([("sid", pa.int64()), ("n", pa.int64()), ("live", pa.int64()), ("frag", pa.int32()), ("data", pa.binary()), ("bitmap", pa.binary())])

    def give(sid, n, h):
        h = h.view(np.uint64)
        order = np.argsort(h, kind="stable")
        order = order[np.argsort(sid[order], kind="stable")]
        sid, n, h = sid[order], n[order], h[order]
        new = np.r_[True, (sid[1:] != sid[:-1]) | (h[1:] != h[:-1])]
        sid, n, h = sid[new], n[new], h[new]
        cut = np.flatnonzero(np.r_[True, sid[1:] != sid[:-1], True])
        live, sid, n = np.diff(cut), sid[cut[:-1]], n[cut[:-1]]
        need = _need(n, num, den)
        rows: list[tuple] = []
        frag = (h >> np.uint64(32)) * np.uint64(FRAGMENTS) >> np.uint64(32)
        for i in np.flatnonzero(live >= need).tolist():
            own = h[cut[i] : cut[i + 1]]
            bits = np.zeros(BITMAP_BITS, bool)
            bits[(mix(own) & np.uint64(BITMAP_BITS - 1)).astype(np.int64)] = True
            head = (int(sid[i]), int(n[i]), int(live[i]))
            rows.append((*head, -1, own[: live[i] - need[i] + 1].tobytes(), np.packbits(bits).tobytes()))
            ends = np.searchsorted(frag[cut[i] : cut[i + 1]], np.arange(FRAGMENTS + 1))
            rows += [(*head, f, own[ends[f] : ends[f + 1]].tobytes(), None) for f in range(FRAGMENTS) if ends[f + 1] > ends[f]]
        if rows:
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
        return None

    def run(batches):
        held: list[list[np.ndarray]] = []
        size = 0
        for b in batches:
            if not b.num_rows:
                continue
            cols = [np.asarray(take_column(b, c)) for c in ("sid", "n", "h")]
            held.append(cols)
            size += b.num_rows
            if size >= 1 << 16 and cols[0][-1] != held[0][0][0]:
                cols = [np.concatenate(x) for x in zip(*held, strict=True)]
                cut = int(np.searchsorted(cols[0], cols[0][-1]))
                if (out := give(*(x[:cut] for x in cols))) is not None:
                    yield out
                held = [[x[cut:] for x in cols]]
                size = len(held[0][0])
        if held and (out := give(*(np.concatenate(x) for x in zip(*held, strict=True)))) is not None:
            yield out

    return run


# ---------------------------------------------------------------- lists and pairs


def _listed(flags=None, id_bits: int = 0):
    """A row for each n-gram of each prefix, or for those in a bit filter."""

    def run(batches):
        chosen = None if flags is None else np.frombuffer(flags.value, np.uint8)
        for b in batches:
            data = take_column(b, "data").cast(pa.large_binary())
            counts = np.diff(np.frombuffer(data.buffers()[1], np.int64)[data.offset : data.offset + len(data) + 1]) // 8
            h, at = np.frombuffer(b"".join(data.to_pylist()), np.int64), np.repeat(np.arange(b.num_rows), counts)
            if chosen is not None:
                use = in_filter(chosen, id_bits, h)
                h, at = h[use], at[use]
            sid, n, live, comp, bitmap = (take_column(b, c).take(pa.array(at)) for c in ("sid", "n", "live", "comp", "bitmap"))
            yield pa.RecordBatch.from_arrays([pa.array(h), sid, n, pa.array(np.asarray(n) - np.asarray(live)), comp, bitmap], names=["h", "sid", "n", "dead", "comp", "bitmap"])

    return run


_LISTS_SQL = "h long, sid long, n long, dead long, comp long, bitmap binary"


def _bit_rows(b: pa.RecordBatch) -> np.ndarray:
    return np.frombuffer(b"".join(take_column(b, "bitmap").to_pylist()), np.uint64).reshape(b.num_rows, -1)


def _neighbours(num: int, den: int, head: bool):
    """For each row of a list the row of another component among the NEIGHBOURS before it that differs least, if it may be linked.

    Rows come in order of (h, salt); with `head` the first row of the list is compared too.
    """
    schema = pa.schema([("sid", pa.int64()), ("differ", pa.int64()), ("other", pa.int64()), ("head", pa.bool_())])
    names = ("h", "salt", "sid", "n", "dead", "comp")

    def run(batches):
        held: list[np.ndarray] | None = None  # the last NEIGHBOURS rows and the first row of the last list
        for b in batches:
            if not b.num_rows:
                continue
            cols = [np.asarray(take_column(b, c)) for c in names] + [_bit_rows(b)]
            before = 0
            if held is not None:
                before = len(held[0])
                cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
            h, salt, sid, n, dead, comp, bits = cols
            m = len(h)
            start = np.r_[True, (h[1:] != h[:-1]) | (salt[1:] != salt[:-1])]
            first = np.maximum.accumulate(np.where(start, np.arange(m), 0))
            least, other = np.full(m, np.iinfo(np.int64).max), np.zeros(m, np.int64)

            def differ(i, j):
                far = np.bitwise_count(bits[i] ^ bits[j]).sum(1, dtype=np.int64) + dead[i] + dead[j]
                return np.where(_links(far, n[i] + n[j], num, den), far, np.iinfo(np.int64).max)

            for lag in range(1, NEIGHBOURS + 1):
                i = np.arange(max(before, lag), m)
                i = i[(first[i] <= i - lag) & (comp[i] != comp[i - lag])]
                far = differ(i, i - lag)
                better = far < least[i]
                least[i[better]], other[i[better]] = far[better], sid[i - lag][better]
            ok = np.flatnonzero(least < np.iinfo(np.int64).max)
            out = [(sid[ok], least[ok], other[ok], np.zeros(len(ok), bool))]
            if head:
                i = np.arange(before, m)
                i = i[(first[i] < i) & (comp[i] != comp[first[i]])]
                far = differ(i, first[i])
                i, far = i[far < np.iinfo(np.int64).max], far[far < np.iinfo(np.int64).max]
                out.append((sid[i], far, sid[first[i]], np.ones(len(i), bool)))
            if any(len(x[0]) for x in out):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], schema=schema)
            keep = np.unique(np.r_[first[-1], np.arange(max(first[-1], m - NEIGHBOURS), m)])
            held = [x[keep] for x in cols]

    return run


def _cross(num: int, den: int):
    """Pairs of a list (or of two of its parts) whose ends are in different components and whose bitmaps allow a link."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("na", pa.int64()), ("nb", pa.int64())])
    names = ("h", "lo", "hi", "part", "sid", "n", "dead", "comp")

    def pairs(lo, hi, part, sid, n, dead, comp, bits):
        whole = lo[0] == hi[0]
        for i in range(0, len(sid), _ROWS_AT_ONCE):
            x = slice(i, i + _ROWS_AT_ONCE)
            both = n[x, None] + n
            ok = (comp[x, None] != comp) & (sid[x, None] < sid) & _links(dead[x, None] + dead, both, num, den)
            ok &= den * np.minimum(n[x, None], n) >= num * np.maximum(n[x, None], n)
            if not whole:
                ok &= part[x, None] != part
            p, q = np.nonzero(ok)
            for j in range(0, len(p), 1 << 16):
                s, t = p[j : j + (1 << 16)] + i, q[j : j + (1 << 16)]
                far = np.bitwise_count(bits[s] ^ bits[t]).sum(1, dtype=np.int64) + dead[s] + dead[t]
                keep = _links(far, n[s] + n[t], num, den)
                if keep.any():
                    s, t = s[keep], t[keep]
                    yield pa.RecordBatch.from_arrays([pa.array(sid[s]), pa.array(sid[t]), pa.array(n[s]), pa.array(n[t])], schema=schema)

    def run(batches):
        held: list[np.ndarray] | None = None
        pending: list[list[np.ndarray]] = []
        for b in batches:
            if not b.num_rows:
                continue
            cols = [np.asarray(take_column(b, c)) for c in names] + [_bit_rows(b)]
            if held is not None and all(x[0] == y[-1] for x, y in zip(cols[:3], held, strict=False)) and all((x == x[0]).all() for x in cols[:3]):
                pending.append(cols)  # the list goes on
                continue
            cols = [np.concatenate(x) for x in zip(*([held] if held is not None else []), *pending, cols, strict=True)]
            pending = []
            cut = np.flatnonzero(np.r_[True, np.any([x[1:] != x[:-1] for x in cols[:3]], axis=0)])
            for i, j in zip(cut[:-1], cut[1:], strict=True):
                yield from pairs(*(x[i:j] for x in cols[1:]))
            held = [x[cut[-1] :] for x in cols]
        if held is not None:
            yield from pairs(*(np.concatenate(x) for x in zip(*[y[1:] for y in (held, *pending)], strict=True)))

    return run


def _overlaps(batches):
    """Sizes of the intersections of pa and pb, for many rows by one sort."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("both", pa.int64()), ("common", pa.int64())])
    for batch in batches:
        sides = []
        for name in ("pa", "pb"):
            col = take_column(batch, name).cast(pa.large_binary())
            offs = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
            sides.append((np.frombuffer(col.buffers()[2] or b"", np.uint8), offs))
        both = sides[0][1] - sides[0][1][0] + sides[1][1] - sides[1][1][0]
        common = np.zeros(batch.num_rows, np.int64)
        for i, j in slices(both, 1 << 23):
            hs, rows = [], []
            for data, offs in sides:
                hs.append(data[offs[i] : offs[j]].view(np.uint64))
                rows.append(np.repeat(np.arange(j - i), np.diff(offs[i : j + 1]) // 8))
            h, r = np.concatenate(hs), np.concatenate(rows)
            order = np.argsort(h)
            order = order[np.argsort(r[order], kind="stable")]
            h, r = h[order], r[order]
            hit = (h[1:] == h[:-1]) & (r[1:] == r[:-1])
            common[i:j] = np.bincount(r[1:][hit], minlength=j - i)
        yield pa.RecordBatch.from_arrays([*(take_column(batch, c) for c in ("a", "b", "both")), pa.array(common)], schema=schema)


# ---------------------------------------------------------------- the join


def ngram_components(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of docs (doc_id, text).

    Two texts are linked if den * |intersection| >= num * |union| for their sets of k-word shingles.
    """
    with batch_rows(docs.sparkSession, _BATCH_ROWS):
        return _components(docs, k, num, den)


def _surveyed(docs: DataFrame, k: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """All rows with the name and size of their set, and a row for each different set: its smallest id, its copies, whether it can be linked."""
    spark = docs.sparkSession
    bits = int(np.clip(np.ceil(np.log2(8 * int(spark.conf.get("spark.sql.shuffle.partitions")))), 6, 20))
    survey = stage(docs.mapInArrow(lean(_survey(k, bits)), _SURVEY_SQL), "survey")
    buckets = survey.where("bucket is not null").select("bucket", "base", "grams", "owners")
    recur = buckets.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(lean(_recurring_owners), "base long, owners binary, counts binary")
    recur = recur.repartition("base").sortWithinPartitions("base").mapInArrow(lean(_added), "ref long, live long").withColumnRenamed("live", "more")
    rows = survey.where("bucket is null")
    named = rows.where("sid is not null")
    counted = named.where("ref is not null").join(recur, "ref", "left").select("doc_id", "sid", "n", "first", (F.col("live") + F.coalesce("more", F.lit(0))).alias("live"))
    others = named.where("ref is null").select("doc_id", "sid", "n", "first", "live")
    sets = counted.union(others).groupBy("sid", "n").agg(F.min("doc_id").alias("head"), F.count("*").alias("copies"), (F.max("first") - F.max("live")).alias("dead"))
    spare = F.floor(F.col("n") * (den - num) / den)  # n - ceil(n * num / den)
    sets = stage(sets.select("sid", "n", "head", "copies", (F.col("dead") <= spare + 1e-9).alias("open")), "sets")
    rows = stage(rows.select("doc_id", "sid", "n"), "rows")
    drop_staged(survey)
    return rows, sets


def _components(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    spark = docs.sparkSession
    rows, sets = _surveyed(docs, k, num, den)
    ids = sets.where("open").select(F.col("head").alias("id")).distinct()
    if ids.count() <= MAX_FILTER_IDS:
        flags, id_bits = bit_filter(ids)
        grams = docs.mapInArrow(lean(_grams(k, spark.sparkContext.broadcast(flags), id_bits)), "h long, sid long, n long")
    else:
        grams = docs.join(ids, docs["doc_id"] == ids["id"], "left_semi").mapInArrow(lean(_grams(k, None, 0)), "h long, sid long, n long")
    grams = grams.repartition(F.when(F.col("n") < 0, F.col("sid")).otherwise(F.col("h"))).sortWithinPartitions(F.col("n") >= 0, "h")
    live = grams.mapInArrow(lean(_recurring), "sid long, n long, h long")
    found = stage(live.repartition("sid").sortWithinPartitions("sid").mapInArrow(lean(_gathered(num, den)), _SETS_SQL), "recurring")
    parts = found.where("frag >= 0").select("sid", "frag", "data")
    heads = found.where("frag = -1").select("sid", "n", "live", "data", "bitmap")

    def verified(pairs: DataFrame) -> DataFrame:
        """The linked pairs of (a, b, na, nb): overlaps are counted in each fragment and summed."""
        pairs = stage(pairs.distinct(), "pairs")
        fragments = F.array(*map(F.lit, range(FRAGMENTS)))
        left = parts.select(F.col("sid").alias("a"), "frag", F.col("data").alias("pa"))
        right = parts.select(F.col("sid").alias("b"), "frag", F.col("data").alias("pb"))
        both = pairs.select("a", "b", (F.col("na") + F.col("nb")).alias("both"), F.explode(fragments).alias("frag")).join(left, ["a", "frag"]).join(right, ["b", "frag"])
        counted = both.select("a", "b", "both", "pa", "pb").mapInArrow(lean(_overlaps), "a long, b long, both long, common long")
        summed = counted.groupBy("a", "b").agg(F.sum("common").alias("common"), F.max("both").alias("both"))
        links = stage(summed.where(F.col("common") * (den + num) >= F.col("both") * num).select("a", "b"), "links")
        drop_staged(pairs)
        return links

    def best(rows: DataFrame) -> DataFrame:
        """For each set the neighbour, and the head of a list, that differ least."""
        one = rows.groupBy("sid", "head").agg(F.min(F.struct("differ", "other")).alias("m")).select("sid", F.col("m.other").alias("other"))
        one = one.select(F.least("sid", "other").alias("a"), F.greatest("sid", "other").alias("b"))
        sizes = heads.select("sid", "n")
        for x in "ab":
            one = one.join(sizes.select(F.col("sid").alias(x), F.col("n").alias(f"n{x}")), x)
        return one.select("a", "b", "na", "nb")

    def lists(sets: DataFrame, mixed_only: bool) -> DataFrame:
        """The lists of sets with a component, or those with several components, and into how many parts each is cut."""
        grams = sets.mapInArrow(lean(_listed()), _LISTS_SQL).groupBy("h").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("rows")).where("lo < hi")
        if not mixed_only:
            grams, out = grams.where(F.col("rows") > SPLIT), sets.mapInArrow(lean(_listed()), _LISTS_SQL)
        else:
            grams = stage(grams.select("h", "rows"), "mixed")
            flags, bits = bit_filter(grams.select("h"))
            out = sets.mapInArrow(lean(_listed(spark.sparkContext.broadcast(flags), bits)), _LISTS_SQL)
        long = bounded(grams.where(F.col("rows") > SPLIT).select(F.col("h").alias("long"), F.ceil(F.col("rows") / SPLIT).cast("int").alias("parts")))
        return out.join(long, out.h == long.long, "left").withColumn("k", F.coalesce("parts", F.lit(1))).drop("long", "parts")

    def labelled(links: DataFrame) -> DataFrame:
        comps = components(links).distinct()
        return stage(heads.join(comps, heads.sid == comps.id, "left").select(*heads.columns, F.coalesce("component", "sid").alias("comp")), "labelled")

    part = F.pmod(F.xxhash64("sid"), F.col("k")).cast("int")
    order = ["h", "salt", "sid", "n", "dead", "comp", "bitmap"]
    every = lists(heads.withColumn("comp", F.col("sid")), False)
    near = every.withColumn("salt", part).repartition("h", "salt").sortWithinPartitions("h", "salt", "n", "sid").select(*order)
    links = verified(best(near.mapInArrow(lean(_neighbours(num, den, True)), "sid long, differ long, other long, head boolean")))

    known = labelled(links)
    deal = F.xxhash64(F.lit(1), "sid")
    again = lists(known, True).withColumn("salt", F.pmod(deal, F.col("k")).cast("int"))
    again = again.repartition("h", "salt").sortWithinPartitions("h", "salt", F.xxhash64(F.lit(2), "sid")).select(*order)
    links = links.union(verified(best(again.mapInArrow(lean(_neighbours(num, den, False)), "sid long, differ long, other long, head boolean"))))
    drop_staged(known)

    known = labelled(links)
    cells = lists(known, True).withColumn("part", part).withColumn("to", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    cells = cells.select("h", F.least("part", "to").alias("lo"), F.greatest("part", "to").alias("hi"), "part", "sid", "n", "dead", "comp", "bitmap")
    cells = cells.repartition("h", "lo", "hi").sortWithinPartitions("h", "lo", "hi")
    links = links.union(verified(cells.mapInArrow(lean(_cross(num, den)), "a long, b long, na long, nb long")))
    drop_staged(known)

    comps = components(links).distinct()
    of_set = comps.join(sets, comps.id == sets.sid).select("sid", "n", "head", "component")
    roots = of_set.groupBy("component").agg(F.min("head").alias("label"))
    linked = of_set.join(roots, "component").select("sid", "n", "label")
    alone = sets.where("copies > 1").join(comps, sets.sid == comps.id, "left_anti").select("sid", "n", F.col("head").alias("label"))
    labels = stage(linked.union(alone), "labels")
    drop_staged(found)
    drop_staged(sets)

    salted = labels.withColumn("salt", F.explode(F.array(*map(F.lit, range(_SALTS)))))
    own = rows.where("sid is not null").withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(_SALTS)).cast("int")).join(salted, ["sid", "n", "salt"], "left")
    out = own.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("label", "doc_id").alias("component_id"))
    return out.union(rows.where("sid is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))
