"""Binary readers on files that the tests write byte by byte."""

import struct
import zlib

import pytest

from strandlake.sources import binary, text


def _block(data):
    packed = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = packed.compress(data) + packed.flush()
    return b"\x1f\x8b\x08\x04" + bytes(6) + struct.pack("<HBBHH", 6, 66, 67, 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(data), len(data))


def _bgzf(data, size):
    return b"".join(_block(data[i : i + size]) for i in range(0, len(data), size)) + _block(b"")


REFS = [("chr1", 1000), ("chr2", 500)]
READS = [
    ("a", 99, 0, 10, 30, [(5, 0), (2, 4)], 0, 40, 35, "ACGTNAC"),
    ("b", 16, 1, 0, 0, [(3, 0), (4, 3), (2, 0)], -1, -1, 0, "GGGTT"),
    ("c", 4, -1, -1, 0, [], -1, -1, 0, ""),
]


def _bam(reads):
    out = b"BAM\x01" + struct.pack("<i", 3) + b"@CO" + struct.pack("<i", len(REFS))
    for n, z in REFS:
        out += struct.pack("<i", len(n) + 1) + n.encode() + b"\0" + struct.pack("<i", z)
    for name, flag, ref, pos, mapq, ops, mate, mate_pos, tlen, seq in reads:
        codes = ["=ACMGRSVTWYHKDBN".index(x) for x in seq] + [0] * (len(seq) % 2)
        body = struct.pack("<iiBBHHHiiii", ref, pos, len(name) + 1, mapq, 0, len(ops), flag, len(seq), mate, mate_pos, tlen) + name.encode() + b"\0"
        body += b"".join(struct.pack("<I", n << 4 | o) for n, o in ops) + bytes(a << 4 | b for a, b in zip(codes[::2], codes[1::2], strict=True)) + b"\xff" * len(seq)
        out += struct.pack("<i", len(body)) + body
    return out


@pytest.mark.parametrize("size", [7, 60000])
def test_bam(spark, tmp_path, size):
    (tmp_path / "x.bam").write_bytes(_bgzf(_bam(READS), size))
    p = str(tmp_path / "x.bam")
    got = binary.read_bam(spark, p, "s", seq=True).orderBy("qname").collect()
    assert [(r.qname, r.flag, r.chrom, r.pos, r.mapq, r.cigar, r.mate_chrom, r.mate_pos, r.tlen, r.qlen, r.seq) for r in got] == [
        ("a", 99, "chr1", 10, 30, "5M2S", "chr1", 40, 35, 7, "ACGTNAC"), ("b", 16, "chr2", 0, 0, "3M4N2M", "*", -1, 0, 5, "GGGTT"), ("c", 4, "*", -1, 0, "*", "*", -1, 0, 0, "")]
    assert [r.end for r in got] == [15, 9, -1] and [tuple(b) for b in got[1].blocks] == [(0, 3), (7, 9)]
    assert sorted(map(tuple, binary.bam_sizes(spark, p).collect())) == REFS
    sam = "\n".join(["a\t99\tchr1\t11\t30\t5M2S\t=\t41\t35\tACGTNAC\t*", "b\t16\tchr2\t1\t0\t3M4N2M\t*\t0\t0\tGGGTT\t*"])
    (tmp_path / "x.sam").write_text(sam)
    cols = ["sample", "qname", "flag", "chrom", "pos", "mapq", "cigar", "mate_chrom", "mate_pos", "tlen", "qlen", "end", "blocks"]
    assert text.read_sam(spark, str(tmp_path / "x.sam"), "s").select(cols).orderBy("qname").collect() == binary.read_bam(spark, p, "s").select(cols).where("chrom <> '*'").orderBy("qname").collect()


def test_bam_without_reads_and_cut_off(spark, tmp_path):
    (tmp_path / "e.bam").write_bytes(_bgzf(_bam([]), 50))
    assert binary.read_bam(spark, str(tmp_path / "e.bam")).count() == 0
    with pytest.raises(ValueError):
        list(binary.inflated(_block(b"abc")[:-3]))
    with pytest.raises(ValueError):
        binary._bam_header(binary._Bytes(binary.inflated(_block(b"SAM1"))))


def _two_bit(seqs, order):
    head = struct.pack(order + "4I", 0x1A412743, 0, len(seqs), 0)
    at, index, body = 16 + sum(5 + len(n) for n in seqs), b"", b""
    for name, (seq, gaps) in seqs.items():
        index += bytes([len(name)]) + name.encode() + struct.pack(order + "I", at + len(body))
        codes = ["TCAG".index(x) for x in seq] + [0] * (-len(seq) % 4)
        rec = struct.pack(order + "2I", len(seq), len(gaps)) + b"".join(struct.pack(order + "I", s) for s, _ in gaps) + b"".join(struct.pack(order + "I", n) for _, n in gaps)
        rec += struct.pack(order + "4I", 1, 0, 2, 0) + bytes(codes[i] << 6 | codes[i + 1] << 4 | codes[i + 2] << 2 | codes[i + 3] for i in range(0, len(codes), 4))
        body += rec
    return head + index + body


@pytest.mark.parametrize("order", ["<", ">"])
def test_2bit(spark, tmp_path, order):
    seqs = {"chr1": ("ACGTTGCAAC", [(2, 3), (9, 1)]), "x": ("GATTACA", []), "empty": ("", [])}
    (tmp_path / "g.2bit").write_bytes(_two_bit(seqs, order))
    for tile in (3, 4, 100):
        rows = binary.read_2bit(spark, str(tmp_path / "g.2bit"), tile).orderBy("chrom", "start").collect()
        got = {}
        for r in rows:
            assert r.start == len(got.get(r.chrom, "")) and r.size == len(seqs[r.chrom][0])
            got[r.chrom] = got.get(r.chrom, "") + r.seq
        assert got == {"chr1": "ACNNNGCAAN", "x": "GATTACA"}
