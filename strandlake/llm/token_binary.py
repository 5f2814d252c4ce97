"""Token ids in compressed binary blocks: an adaptive context-mixing range coder.

A block holds the ids of whole documents in ascending doc_id order and is coded on its own: model and coder start anew
in each, and the header carries checksums of the ids and of the payload.  Within a block the ids are dealt to many
lanes (consecutive runs) that are coded in step, so every operation is one numpy call over all lanes; the lanes share
one model, which is updated after each step by encoder and decoder alike:

* order 2 and order 1: a table by context keeps a predicted id and a confidence;
* mixing: for each pair of confidences the learned shares of "order 2 right", "order 1 right" and "neither";
* order 0: adaptive frequencies of all ids, for what neither predicts;
* a carryless range coder with 64-bit low and range, 16-bit words out.

Files: Parquet through Spark's commit protocol (so lost tasks leave nothing behind), one row per block; a row has the
file number (ascending with doc_id), the block number, the documents with their lengths, and the block.

Defined cases: null text counts as empty and is its end id alone; null ids come first; repeated ids stay separate
documents, ordered by text; an empty table gives no blocks; a very long text makes one long block.
"""

from __future__ import annotations

import re
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandlake.llm.common import batch_rows, give_back, lean, new_path, slices, take_column, text_bytes

END_ID = 2
#: Ids after which a block is closed; lanes of a block; ids of a lane at least.
BLOCK_IDS, MAX_LANES, LANE_IDS = 1 << 21, 8192, 256
#: Pieces that a worker remembers; beyond it those that were not met again are forgotten.
CACHE_PIECES = 700_000
#: Pieces that are looked up at once.
_CHUNK = 1 << 18
#: Bytes of text that are cut and looked up at once (a longer single text is taken alone).
_SLICE_BYTES = 1 << 18
#: Rows of an Arrow batch: they hold texts.
_BATCH_ROWS = 1000

_MAGIC = b"TIDB1"
_HEAD = struct.Struct("<5sIIIII")
_MIX_BITS, _ID_BITS, _SLOTS2 = 12, 18, 1 << 18
_U = np.uint64
#: Confidence after a wrong and a right prediction, by the one before.
_CONFIDENCE = np.array([0, 0, 1, 1, 2, 2, 3, 3, 1, 2, 3, 4, 5, 6, 7, 7])
_SMALL, _SAME, _LOW32 = _U(1 << 32), _U(1 << 48), _U((1 << 32) - 1)


class _Model:
    """What encoder and decoder know before a step."""

    def __init__(self, vocab: int):
        self.vocab = vocab
        self.order1, self.order2 = np.zeros(vocab, np.int64), np.zeros(_SLOTS2, np.int64)  # predicted id * 8 + confidence
        self.seen = np.tile(np.array([2.0, 1.0, 4.0]), (128, 1))
        self.counts = np.zeros(vocab, np.int64)
        self.step, self.fresh = 0, []
        self._share()
        self._spread()

    def _share(self) -> None:
        total = (1 << _MIX_BITS) - 3
        f = (self.seen[:, :2] / self.seen.sum(1, keepdims=True) * total).astype(np.int64) + 1
        size = np.column_stack([f, (1 << _MIX_BITS) - f.sum(1)])
        self.f2, self.f12 = f[:, 0].copy(), f.sum(1)
        self.size, self.first = size.astype(_U).ravel(), (np.cumsum(size, 1) - size).astype(_U).ravel()  # by state * 3 + outcome

    def _spread(self) -> None:
        total, have = 1 << _ID_BITS, int(self.counts.sum())
        f = np.ones(self.vocab, np.int64)
        if have:
            f += self.counts * (total - self.vocab) // have
        f[int(self.counts.argmax())] += total - int(f.sum())
        self.freq = f
        self.cum = np.zeros(self.vocab + 1, np.int64)
        np.cumsum(f, out=self.cum[1:])
        self.of_slot: np.ndarray | None = None

    def look(self, prev1: np.ndarray, prev2: np.ndarray) -> None:
        self.at1 = prev1
        self.at2 = (prev2 * 8191 + prev1 * 9973 + (prev1 >> 3)) & (_SLOTS2 - 1)
        e1, e2 = self.order1.take(prev1), self.order2.take(self.at2)
        self.p1, self.p2 = e1 >> 3, e2 >> 3
        self.c1, self.c2 = e1 & 7, e2 & 7
        self.state = (self.c2 << 4) + (self.c1 << 1) + (self.p1 == self.p2)

    def learn(self, ids: np.ndarray, outcome: np.ndarray) -> None:
        """outcome: state * 3, and 0 if order 2 was right, 1 if order 1 was, 2 if neither."""
        for table, at, p, c in ((self.order1, self.at1, self.p1, self.c1), (self.order2, self.at2, self.p2, self.c2)):
            # of equal contexts in one step the last lane counts
            table[at] = (np.where(c > 1, p, ids) << 3) + _CONFIDENCE.take((p == ids) * 8 + c)
        self.seen += np.bincount(outcome, minlength=384).reshape(128, 3)
        if self.step < 32 or self.step % 8 == 0:
            self._share()
        self.fresh.append(ids)
        self.step += 1
        if self.step & (self.step - 1) == 0 or self.step % 32 == 0:
            self.counts += np.bincount(np.concatenate(self.fresh), minlength=self.vocab)
            self.fresh = []
            self._spread()

    def id_at(self, slot: np.ndarray) -> np.ndarray:
        if self.of_slot is None:
            self.of_slot = np.repeat(np.arange(self.vocab), self.freq)
        return self.of_slot.take(slot)


def _lanes(n: int) -> tuple[int, int]:
    lanes = max(1, min(MAX_LANES, n // LANE_IDS))
    return lanes, -(-n // lanes)


def _short(low: np.ndarray, rng: np.ndarray) -> tuple[np.ndarray, ...]:
    """Lanes whose range needs 16 more bits: where they are, their low and range, and whether their top bits are settled."""
    same = (low ^ (low + rng)) < _SAME
    m = np.flatnonzero(same | (rng < _SMALL))
    return m, low[m], rng[m], same[m]


def _little(ids: np.ndarray) -> memoryview:
    """The bytes of ids as little-endian unsigned 32-bit integers, without a copy where they are stored so."""
    return memoryview(np.ascontiguousarray(ids.astype("<u4", copy=False)).view(np.uint8))


def encode_block(ids: np.ndarray) -> bytes:
    """A block for an array of ids (unsigned, below 2**17)."""
    ids = np.ascontiguousarray(ids, np.uint32)
    vocab = int(ids.max()) + 1 if len(ids) else 1
    lanes, steps = _lanes(len(ids))
    grid = np.zeros(lanes * steps, np.int32)
    grid[: len(ids)] = ids
    grid = np.ascontiguousarray(grid.reshape(lanes, steps).T)
    low, rng = np.zeros(lanes, _U), np.full(lanes, (1 << 64) - 1, _U)
    out, pos = np.zeros((lanes, steps + 32), np.uint16), np.zeros(lanes, np.int64)
    model, prev1, prev2 = _Model(vocab), np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
    for row in grid:
        row = row.astype(np.int64)
        if int(pos.max()) > out.shape[1] - 16:  # far more than a step and the end write
            out = np.concatenate([out, np.zeros((lanes, steps // 2 + 32), np.uint16)], 1)
        model.look(prev1, prev2)
        neither = (row != model.p2) & (row != model.p1)
        outcome = model.state * 3 + (row != model.p2) + neither
        r = rng >> _U(_MIX_BITS)
        low += model.first.take(outcome) * r
        rng = model.size.take(outcome) * r
        at = np.flatnonzero(neither)
        if len(at):
            r, ids_ = rng.take(at) >> _U(_ID_BITS), row.take(at)
            low[at] += model.cum.take(ids_).view(_U) * r
            rng[at] = model.freq.take(ids_).view(_U) * r
        m, lo, ra, same = _short(low, rng)
        while len(m):
            out[m, pos[m]] = (lo >> _U(48)).astype(np.uint16)
            pos[m] += 1
            low[m], rng[m] = lo, ra = lo << _U(16), np.where(same, ra, (~lo + _U(1)) & _LOW32) << _U(16)
            k, lo, ra, same = _short(lo, ra)
            m = m[k]
        model.learn(row, outcome)
        prev2, prev1 = prev1, row
    end = (low + _LOW32) & ~_LOW32
    for shift in (48, 32):
        out[np.arange(lanes), pos] = (end >> _U(shift)).astype(np.uint16)
        pos += 1
    del grid
    words = out[np.arange(out.shape[1])[None, :] < pos[:, None]]
    payload = pos.astype("<u4").tobytes() + words.astype("<u2", copy=False).tobytes()
    return _HEAD.pack(_MAGIC, len(ids), lanes, vocab, zlib.crc32(_little(ids)), zlib.crc32(payload)) + payload


def decode_block(block: bytes) -> np.ndarray:
    """The ids of a block; ValueError if a checksum disagrees."""
    if len(block) < _HEAD.size:
        raise ValueError("not a block of token ids")
    magic, n, lanes, vocab, ids_crc, payload_crc = _HEAD.unpack_from(block)
    payload = memoryview(block)[_HEAD.size :]
    if magic != _MAGIC or zlib.crc32(payload) != payload_crc:
        raise ValueError("block is damaged")
    lengths = np.frombuffer(payload[: 4 * lanes], "<u4").astype(np.int64)
    words = np.zeros(int(lengths.sum()) + 8, np.uint16)
    words[:-8] = np.frombuffer(payload[4 * lanes :], "<u2")
    pos = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    stop = pos + lengths
    steps = -(-n // lanes)
    low, rng, code = np.zeros(lanes, _U), np.full(lanes, (1 << 64) - 1, _U), np.zeros(lanes, _U)
    for _ in range(4):
        code = code << _U(16) | np.where(pos < stop, words[pos].astype(_U), _U(0))
        pos = pos + 1
    model, prev1, prev2 = _Model(vocab), np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
    grid = np.zeros((steps, lanes), np.int32)
    for step in range(steps):
        model.look(prev1, prev2)
        r = rng >> _U(_MIX_BITS)
        v = ((code - low) // r).view(np.int64)
        wrong, neither = v >= model.f2.take(model.state), v >= model.f12.take(model.state)
        outcome = model.state * 3 + wrong + neither
        low += model.first.take(outcome) * r
        rng = model.size.take(outcome) * r
        row = np.where(wrong, model.p1, model.p2)
        at = np.flatnonzero(neither)
        if len(at):
            r = rng.take(at) >> _U(_ID_BITS)
            v = np.minimum((code.take(at) - low.take(at)) // r, _U((1 << _ID_BITS) - 1)).view(np.int64)
            row[at] = ids_ = model.id_at(v)
            low[at] += model.cum.take(ids_).view(_U) * r
            rng[at] = model.freq.take(ids_).view(_U) * r
        m, lo, ra, same = _short(low, rng)
        while len(m):
            p = pos[m]
            code[m] = code[m] << _U(16) | np.where(p < stop[m], words[np.minimum(p, len(words) - 1)].astype(_U), _U(0))
            pos[m] = p + 1
            low[m], rng[m] = lo, ra = lo << _U(16), np.where(same, ra, (~lo + _U(1)) & _LOW32) << _U(16)
            k, lo, ra, same = _short(lo, ra)
            m = m[k]
        model.learn(row, outcome)
        prev2, prev1 = prev1, row
        grid[step] = row
    ids = grid.T.reshape(-1)[:n].view(np.uint32)
    if zlib.crc32(_little(ids)) != ids_crc:
        raise ValueError("ids of the block disagree with their checksum")
    return ids


# ---------------------------------------------------------------- tokenizing


#: Controls that libraries disagree on as white space: such texts go through the tokenizers library whole.
_ODD_SPACE = re.compile("[\x1c-\x1f\x85]").search
#: Classes of bytes in texts of ASCII and Latin letters (U+00C0 to U+017F) only; bytes from 0x80 on belong to letters there.
_WHITE, _LETTER, _DIGIT, _OTHER, _UNUSUAL = range(5)
_CLASS = np.full(256, _UNUSUAL, np.uint8)
_CLASS[[0x20, *range(0x09, 0x0E)]] = _WHITE
_CLASS[0x21:0x7F] = _OTHER
_CLASS[0x30:0x3A] = _DIGIT
_CLASS[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0xC0), 0xC3, 0xC4, 0xC5]] = _LETTER


def _unusual(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Whether each text has letters or signs beyond those that _cuts knows."""
    bad = _CLASS[data] == _UNUSUAL
    bad[1:] |= (data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7))  # the signs of multiplication and division
    out = np.zeros(len(offs) - 1, bool)
    out[np.searchsorted(offs, np.flatnonzero(bad), "right") - 1] = True
    return out


def _cuts(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Whether a piece of the public pattern begins at each byte, for texts that are not unusual."""
    n, kind = len(data), _CLASS[data]
    first = np.zeros(n + 3, bool)
    first[offs] = True
    run = first[:n].copy()
    run[1:] |= kind[1:] != kind[:-1]
    # the last of several white spaces stands alone before something else, or, if it is a space, goes with it
    last = np.zeros(n, bool)
    last[:-1] = (kind[:-1] == _WHITE) & run[1:] & ~first[1:n]
    start = run | last
    start[1:] &= ~(last[:-1] & (data[:-1] == 0x20))
    # 's 't 'm 'd 're 've 'll where no other piece has taken the apostrophe
    at = np.flatnonzero((data == 0x27) & start)
    if len(at):
        more = np.concatenate([data, np.zeros(2, np.uint8)])
        b, c = more[at + 1], more[at + 2]
        inside = ~first[at + 1]
        one = inside & np.isin(b, np.frombuffer(b"stmd", np.uint8))
        two = inside & ~first[at + 2] & (((b == ord("r")) | (b == ord("v"))) & (c == ord("e")) | (b == ord("l")) & (c == ord("l")))
        start[at[one | two] + 1] = False
        ends = np.concatenate([at[one] + 2, at[two] + 3])
        start[ends[ends < n]] = True
    return start


class _Pieces:
    """Ids of pieces by their bytes: entries in arrays with an index of open addressing, and a dict for pieces of over 15 bytes.

    A key is a piece's bytes, filled up with zeros, and its length, so equal keys are equal pieces.  Entries are numbered
    from 1 on, so memory follows the pieces that are known; in the index 0 is a free slot.
    """

    _MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], _U)

    def __init__(self, merge):
        self.merge = merge  # ids and lengths of pieces that are not known yet
        self.bits = (2 * (CACHE_PIECES + _CHUNK) - 1).bit_length()
        self._empty()

    def _empty(self) -> None:
        self.index, most = np.zeros(1 << self.bits, np.int32), CACHE_PIECES + _CHUNK + 1
        self.low, self.high = np.zeros(most, _U), np.zeros(most, _U)
        self.at, self.count, self.again = np.zeros(most, np.int32), np.zeros(most, np.uint8), np.zeros(most, bool)
        self.pool, self.used, self.size = np.zeros(1 << 16, np.uint32), 0, 0
        self.long: dict[bytes, tuple[int, int]] = {}

    def _put(self, ids: np.ndarray) -> int:
        if self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(max(len(ids), len(self.pool) // 2), np.uint32)])
        self.pool[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        return self.used - len(ids)

    def _slot(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        h = (low ^ high * _U(0x9E3779B97F4A7C15)) * _U(0xD6E8FEB86659FD93)
        h = (h ^ h >> _U(32)) * _U(0xBF58476D1CE4E5B9)
        return (h >> _U(64 - self.bits)).astype(np.int64)

    def _find(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Entries of keys, 0 where there is none."""
        slot = self._slot(low, high)
        entry = self.index[slot]
        todo = np.flatnonzero((self.high[entry] != high) | (self.low[entry] != low))
        while len(todo):
            todo = todo[entry[todo] != 0]
            slot[todo] = slot[todo] + 1 & (1 << self.bits) - 1
            entry[todo] = e = self.index[slot[todo]]
            todo = todo[(self.high[e] != high[todo]) | (self.low[e] != low[todo])]
        return entry

    def _add(self, low: np.ndarray, high: np.ndarray, at: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Entries of different keys that were not there."""
        slot, todo = self._slot(low, high), np.arange(len(low))
        entry = np.arange(self.size + 1, self.size + 1 + len(low), dtype=np.int32)
        self.low[entry], self.high[entry], self.at[entry], self.count[entry] = low, high, at, count
        while len(todo):
            free = todo[self.index[slot[todo]] == 0]
            self.index[slot[free]] = entry[free]  # of several the last one gets the slot
            todo = todo[self.index[slot[todo]] != entry[todo]]
            slot[todo] = slot[todo] + 1 & (1 << self.bits) - 1
        self.size += len(low)
        return entry

    def _forget(self) -> None:
        """Only pieces that were met again since the last time stay, half of CACHE_PIECES at most."""
        keep = np.flatnonzero(self.again)[: CACHE_PIECES // 2]
        low, high, at, count, pool = self.low[keep], self.high[keep], self.at[keep], self.count[keep].astype(np.int64), self.pool
        self._empty()
        ends = np.cumsum(count)
        where = np.repeat(at - ends + count, count) + np.arange(count.sum())
        self._put(pool[where])
        self._add(low, high, (ends - count).astype(np.int32), count)

    def ids(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the pieces one after the other, and how many each has."""
        parts = [self._chunk(data, starts[i : i + _CHUNK], ends[i : i + _CHUNK]) for i in range(0, len(starts), _CHUNK)]
        if len(parts) == 1:
            return parts[0]
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.uint32), np.zeros(0, np.int64))

    def _chunk(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.size + len(self.long) > CACHE_PIECES:
            self._forget()
        length = ends - starts
        words = np.ndarray((len(data) + 1,), "<u8", np.concatenate([data, np.zeros(16, np.uint8)]), strides=(1,))
        at, count = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        far = length > 15
        short = np.flatnonzero(~far)
        a, n = starts[short], length[short]
        low = words[a] & self._MASK[np.minimum(n, 8)]
        high = words[np.minimum(a + 8, len(data))] & self._MASK[np.clip(n - 8, 0, 7)] | n.astype(_U) << _U(56)
        entry = self._find(low, high)
        missing = np.flatnonzero(entry == 0)
        self.again[entry] = True
        self.again[0] = False
        if len(missing):
            order = missing[np.lexsort((low[missing], high[missing]))]
            x, y = low[order], high[order]
            new = np.r_[True, (x[1:] != x[:-1]) | (y[1:] != y[:-1])]
            one = order[new]
            flat, sizes = self.merge(data, a[one], n[one])
            base = self._put(flat)
            entries = self._add(low[one], high[one], (base + np.cumsum(sizes) - sizes).astype(np.int32), sizes.astype(np.int32))
            entry[order] = entries[np.cumsum(new) - 1]
        at[short], count[short] = self.at[entry], self.count[entry]
        far = np.flatnonzero(far)
        pieces = [data[i:j].tobytes() for i, j in zip(starts[far].tolist(), ends[far].tolist(), strict=True)]
        fresh = {p: i for p, i in zip(pieces, far.tolist(), strict=True) if p not in self.long}
        if fresh:
            one = np.array(list(fresh.values()))
            flat, sizes = self.merge(data, starts[one], length[one])
            first = self._put(flat) + np.cumsum(sizes) - sizes
            self.long.update(zip(fresh, zip(first.tolist(), sizes.tolist(), strict=True), strict=True))
        for i, p in zip(far.tolist(), pieces, strict=True):
            at[i], count[i] = self.long[p]
        stop = np.cumsum(count)
        return self.pool[np.repeat(at - stop + count, count) + np.arange(stop[-1])], count


class Encoder:
    """Ids of texts, as the tokenizers library gives them; pieces between which it never merges are remembered.

    For byte-level tokenizers that split by the public pattern a text's ids are the ids of its pieces in a row, so
    every distinct piece goes through the library once.  Texts with an added token, and other tokenizers, go whole.
    """

    def __init__(self, path: str):
        import json

        import regex
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        self.split = None
        if pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("normalizer"):
            # Fixed value: the pattern by which byte-level tokenizers cut a text into pieces.
            self.split = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+").findall
        # byte-level tokenizers write each byte as one letter: printable bytes stand for themselves, the others follow from 256 on
        plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
        self.letters = np.arange(256, dtype="<u4")
        rest = [b for b in range(256) if b not in plain]
        self.letters[rest] = 256 + np.arange(len(rest))
        self.added = [t["content"].encode() for t in spec.get("added_tokens") or []]
        self.known = _Pieces(self._merged)

    def _merged(self, data: np.ndarray, starts: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What the library makes of pieces: all ids one after the other, and how many each has."""
        ends = np.cumsum(length)
        letters = self.letters[data[np.repeat(starts - ends + length, length) + np.arange(ends[-1])]].tobytes().decode("utf-32-le")
        merge, flat, sizes = self.lib.model.tokenize, array("I"), []
        for i, j in zip((ends - length).tolist(), ends.tolist(), strict=True):
            found = [t.id for t in merge(letters[i:j])]
            flat.extend(found)
            sizes.append(len(found))
        return np.frombuffer(flat, np.uint32), np.array(sizes, np.int64)

    def encode(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after the other, and how many each has."""
        n = len(offs) - 1
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(n, np.int64)
        blob = data.tobytes()
        odd = _unusual(data, offs) if self.split else np.ones(n, bool)
        seen = [a for a in self.added if a in blob]
        start = _cuts(data, offs)
        whole: dict[int, np.ndarray] = {}
        for i in np.flatnonzero(odd | bool(seen)).tolist():
            raw = blob[offs[i] : offs[i + 1]]
            if not odd[i] and not any(a in raw for a in seen):
                continue
            text = raw.decode()
            start[offs[i] : offs[i + 1]] = False
            if self.split is None or _ODD_SPACE(text) or any(a in raw for a in seen):
                whole[i] = np.array(self.lib.encode(text, add_special_tokens=False).ids, np.uint32)
            else:
                size = np.array([len(p.encode()) for p in self.split(text)], np.int64)
                start[offs[i] + np.cumsum(size) - size] = True
        starts = np.flatnonzero(start)
        gone = np.zeros(n, bool)
        gone[list(whole)] = True
        ends = np.append(starts[1:], len(data))
        if whole:
            of = np.searchsorted(offs, starts, "right") - 1
            ends = np.minimum(ends, offs[of + 1])
        ids, count = self.known.ids(data, starts, ends)
        stop = np.r_[0, np.cumsum(count)][np.searchsorted(starts, offs)]
        if not whole:
            return ids, np.diff(stop)
        parts = [whole[i] if i in whole else ids[stop[i] : stop[i + 1]] for i in range(n)]
        return np.concatenate(parts), np.array([len(x) for x in parts], np.int64)

    def ids(self, texts: list[str]) -> list[bytes]:
        """For each text its ids as little-endian unsigned 32-bit integers."""
        ids, count = self.encode(*text_bytes(pa.array(texts, pa.large_string())))
        ends = np.cumsum(count)
        return [ids[i:j].astype("<u4").tobytes() for i, j in zip((ends - count).tolist(), ends.tolist(), strict=True)]


_ENCODERS: dict[str, Encoder] = {}


def encoder_of(path: str) -> Encoder:
    """The worker's encoder of a tokenizer's file.

    Found through the module: what a task's function names itself comes with it as a copy, anew for each task.
    """
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
        give_back()  # what reading the file took
    return _ENCODERS[path]


_FILE = "file int, block int, n_ids long, doc_ids array<long>, lengths array<int>, ids binary"


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID) -> None:
    """Encode the texts of docs (doc_id, text), append end_id to each, and write block files in ascending doc_id order."""
    schema = pa.schema([("file", pa.int32()), ("block", pa.int32()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32())), ("ids", pa.binary())])

    def run(batches):
        encoder, file = encoder_of(tokenizer), TaskContext.get().partitionId()
        block, docs_, lengths, raw, size = 0, [], [], [], 0

        def close():
            ids = np.concatenate(raw)
            raw.clear()
            documents = [pa.ListArray.from_arrays([0, len(x)], x) for x in (pa.concat_arrays(docs_), pa.array(np.concatenate(lengths), pa.int32()))]
            return pa.RecordBatch.from_arrays([pa.array([file], pa.int32()), pa.array([block], pa.int32()), pa.array([len(ids)]), *documents, pa.array([encode_block(ids)], pa.binary())], schema=schema)

        for b in batches:
            names = take_column(b, "doc_id")
            data, offs = text_bytes(take_column(b, "text"))
            for i, j in slices(offs, _SLICE_BYTES):
                ids, count = encoder.encode(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                ids = np.insert(ids, np.cumsum(count), end_id)
                count = count + 1
                stop = np.cumsum(count)
                at = 0
                while at < j - i:
                    begin = int(stop[at] - count[at])
                    to = min(j - i, int(np.searchsorted(stop, begin + BLOCK_IDS - size)) + 1)  # the text that fills the block is its last
                    docs_.append(names.slice(i + at, to - at))
                    lengths.append(count[at:to])
                    raw.append(ids[begin : stop[to - 1]])
                    size += int(stop[to - 1]) - begin
                    at = to
                    if size >= BLOCK_IDS:
                        yield close()
                        block, docs_, lengths, raw, size = block + 1, [], [], [], 0
        if raw:
            yield close()

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    parts = max(1, docs.rdd.getNumPartitions())
    ordered = docs.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    with batch_rows(docs.sparkSession, _BATCH_ROWS):
        ordered.mapInArrow(lean(run), _FILE).write.option("compression", "none").parquet(path)


def _read_blocks(batches):
    for b in batches:
        for r in b.to_pylist():
            ids = decode_block(r["ids"])
            lengths = np.array(r["lengths"], np.int64)
            ends = np.cumsum(lengths)
            raw = _little(ids)
            yield r, lengths, ends, raw


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, doc_id, ids array<int>) for every document, decoded from the files."""

    def run(batches):
        for r, lengths, ends, raw in _read_blocks(batches):
            ids = pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), pa.array(np.frombuffer(raw, "<u4").astype(np.int32)))
            n = len(lengths)
            yield pa.RecordBatch.from_arrays([pa.array([r["file"]] * n, pa.int32()), pa.array([r["block"]] * n, pa.int32()), pa.array(r["doc_ids"], pa.int64()), ids], names=["file", "block", "doc_id", "ids"])

    return spark.read.parquet(path).mapInArrow(lean(run), "file int, block int, doc_id long, ids array<int>")


def digest_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) for every document, from the decoded files."""
    files = spark.read.schema(_FILE).parquet(path)

    def run(batches):
        for r, lengths, ends, raw in _read_blocks(batches):
            n, begin = len(lengths), ends - lengths
            crc = [zlib.crc32(raw[4 * a : 4 * z]) for a, z in zip(begin.tolist(), ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([r["file"]] * n, pa.int32()), pa.array([r["block"]] * n, pa.int32()), pa.array(r["doc_ids"], pa.int64()), pa.array(begin), pa.array(lengths), pa.array(crc, pa.int64())], names=["file", "block", "doc_id", "begin", "n_tokens", "ids_crc32"])

    sizes = files.select("file", "block", "n_ids")
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    of_file = sizes.groupBy("file").agg(F.sum("n_ids").alias("n")).select(F.col("file").alias("f"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("file_at"))
    inside = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    at = sizes.withColumn("block_at", F.coalesce(F.sum("n_ids").over(inside), F.lit(0))).join(of_file, F.col("file") == F.col("f"))
    at = at.select(F.col("file").alias("f"), F.col("block").alias("k"), (F.col("file_at") + F.col("block_at")).alias("at"))
    rows = files.select("file", "block", "doc_ids", "lengths", "ids").mapInArrow(lean(run), "file int, block int, doc_id long, begin long, n_tokens long, ids_crc32 long")
    out = rows.join(at, (F.col("file") == F.col("f")) & (F.col("block") == F.col("k")))
    return out.select("doc_id", (F.col("at") + F.col("begin")).alias("start"), "n_tokens", "ids_crc32")


def token_binary(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """Write the block files into the shared folder and return their digest, read back from them."""
    path = new_path(docs.sparkSession, "token-ids")
    write_token_files(docs, path, tokenizer, end_id)
    return digest_token_files(docs.sparkSession, path)
