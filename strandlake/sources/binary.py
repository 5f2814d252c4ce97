"""Binary formats, read through Spark's own file reader, so any path that Spark can open will do.

A file is decoded block by block in one task, as its records do not start at known places; Spark hands over files of up to
2 GB.  Larger inputs come as several files (one a chromosome, say), which are decoded side by side.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.functions.reads import aligned_blocks, aligned_end

#: Rows of an Arrow batch of alignments, and bases of a row of sequence.
BATCH, TILE = 10_000, 1_000_000

_ALIGNMENT = "qname string, flag int, chrom string, pos long, mapq int, cigar string, mate_chrom string, mate_pos long, tlen long, qlen long, seq string"
_BASES = "=ACMGRSVTWYHKDBN"
_PAIRS = [a + b for a in _BASES for b in _BASES]


def inflated(data: bytes) -> Iterator[bytes]:
    """The contents of the blocks of a BGZF file."""
    at = 0
    while at < len(data):
        if data[at : at + 4] != b"\x1f\x8b\x08\x04":
            raise ValueError("not a BGZF block")
        extra = struct.unpack_from("<H", data, at + 10)[0]
        size, x = None, at + 12
        while x < at + 12 + extra:
            tag, n = data[x : x + 2], struct.unpack_from("<H", data, x + 2)[0]
            if tag == b"BC":
                size = struct.unpack_from("<H", data, x + 4)[0] + 1
            x += 4 + n
        if size is None or at + size > len(data):
            raise ValueError("a BGZF block is cut off or lacks its size")
        yield zlib.decompress(data[at + 12 + extra : at + size - 8], -15)
        at += size


class _Bytes:
    """Takes whole pieces of a stream of blocks and forgets what it has given out."""

    def __init__(self, blocks: Iterator[bytes]):
        self.blocks, self.held, self.at = blocks, b"", 0

    def take(self, n: int) -> bytes | None:
        """The next n bytes; None at the end of the stream."""
        if len(self.held) - self.at < n:
            parts = [self.held[self.at :]]
            have = len(parts[0])
            while have < n:
                block = next(self.blocks, None)
                if block is None:
                    if have:
                        raise ValueError("the file ends within a record")
                    return None
                parts.append(block)
                have += len(block)
            self.held, self.at = b"".join(parts), 0
        self.at += n
        return self.held[self.at - n : self.at]

    def number(self) -> int:
        got = self.take(4)
        if got is None:
            raise ValueError("the file ends within its header")
        return struct.unpack("<i", got)[0]


def _bam_header(s: _Bytes) -> list[tuple[str, int]]:
    if s.take(4) != b"BAM\x01":
        raise ValueError("not a BAM file")
    s.take(s.number())
    names = []
    for _ in range(s.number()):
        name = s.take(s.number())[:-1].decode()
        names.append((name, s.number()))
    return names


def _alignment(r: bytes, names: list[str], seq: bool) -> tuple:
    ref, pos, name_len, mapq, _, ops, flag, length, mate_ref, mate_pos, tlen = struct.unpack_from("<iiBBHHHiiii", r)
    at = 32 + name_len
    cigar = "".join(f"{x >> 4}{'MIDNSHP=X'[x & 15]}" for x in struct.unpack_from(f"<{ops}I", r, at)) or "*"
    bases = None
    if seq:
        at += 4 * ops
        bases = "".join([_PAIRS[b] for b in r[at : at + (length + 1) // 2]])[:length]
    of = lambda i: names[i] if i >= 0 else "*"
    return r[32 : 31 + name_len].decode(), flag, of(ref), pos, mapq, cigar, of(mate_ref), mate_pos, tlen, length, bases


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("content")


def read_bam(spark: SparkSession, path: str, sample: str = "", seq: bool = False) -> DataFrame:
    """Alignments of BAM files with the columns of `read_sam`, and the bases as `seq` if asked for (else null)."""
    kinds = [pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
    schema = pa.schema([(c.split()[0], k) for c, k in zip(_ALIGNMENT.split(", "), kinds, strict=True)])

    def decode(batches):
        for batch in batches:
            for content in batch.column(0):
                s = _Bytes(inflated(content.as_py()))
                names, rows = [n for n, _ in _bam_header(s)], []
                while (head := s.take(4)) is not None:
                    rows.append(_alignment(s.take(struct.unpack("<i", head)[0]), names, seq))
                    if len(rows) == BATCH:
                        yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], schema=schema)
                        rows = []
                if rows:
                    yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], schema=schema)

    t = _files(spark, path).mapInArrow(decode, _ALIGNMENT).select(F.lit(sample).alias("sample"), "*", F.monotonically_increasing_id().alias("read_id"))
    return t.withColumn("end", aligned_end()).withColumn("blocks", aligned_blocks())


def bam_sizes(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, size) from the headers of BAM files; only the first blocks are inflated."""

    def decode(batches):
        for batch in batches:
            for content in batch.column(0):
                names = _bam_header(_Bytes(inflated(content.as_py())))
                yield pa.record_batch([pa.array([n for n, _ in names], pa.string()), pa.array([z for _, z in names], pa.int64())], names=["chrom", "size"])

    return _files(spark, path).mapInArrow(decode, "chrom string, size long").distinct()


def two_bit(data: bytes, tile: int = TILE) -> Iterator[tuple[str, int, int, str]]:
    """(name, size, start, bases) of the sequences of a 2bit file, in tiles; soft-masked bases come in capitals too."""
    order = "<" if struct.unpack_from("<I", data)[0] == 0x1A412743 else ">"
    magic, _, count, _ = struct.unpack_from(order + "4I", data)
    if magic != 0x1A412743:
        raise ValueError("not a 2bit file")
    at = 16
    letters = np.frombuffer(b"TCAG", np.uint8)
    for _ in range(count):
        n = data[at]
        name = data[at + 1 : at + 1 + n].decode()
        (place,) = struct.unpack_from(order + "I", data, at + 1 + n)
        at += 5 + n
        size, gaps = struct.unpack_from(order + "2I", data, place)
        starts = np.frombuffer(data, order + "u4", gaps, place + 8).astype(np.int64)
        lengths = np.frombuffer(data, order + "u4", gaps, place + 8 + 4 * gaps).astype(np.int64)
        (masks,) = struct.unpack_from(order + "I", data, place + 8 + 8 * gaps)
        packed = place + 16 + 8 * gaps + 8 * masks
        for lo in range(0, size, tile):
            hi = min(lo + tile, size)
            first = lo // 4
            codes = np.frombuffer(data, np.uint8, (hi + 3) // 4 - first, packed + first)
            bases = letters[(codes[:, None] >> np.array([6, 4, 2, 0], np.uint8)) & 3].reshape(-1)[lo - 4 * first : hi - 4 * first].copy()
            for i in np.flatnonzero((starts < hi) & (starts + lengths > lo)):
                bases[max(0, starts[i] - lo) : starts[i] + lengths[i] - lo] = ord("N")
            yield name, size, lo, bases.tobytes().decode()


def read_2bit(spark: SparkSession, path: str, tile: int = TILE) -> DataFrame:
    """(chrom, size, start, seq): the sequences of 2bit files in rows of at most `tile` bases."""
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string()]

    def decode(batches):
        for batch in batches:
            for content in batch.column(0):
                for row in two_bit(content.as_py(), tile):
                    yield pa.record_batch([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=["chrom", "size", "start", "seq"])

    return _files(spark, path).mapInArrow(decode, "chrom string, size long, start long, seq string")
