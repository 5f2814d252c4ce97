"""Expressions over alignments: flags, CIGAR, fragments, shifts, duplicate keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

REVERSE, PAIRED, PROPER, UNMAPPED, MATE_REVERSE, READ1, READ2 = 16, 1, 2, 4, 32, 64, 128


def has(bits: int) -> Column:
    return F.col("flag").bitwiseAND(F.lit(bits)) != 0


def cigar_ops(cigar: str = "cigar") -> Column:
    """array<struct<op, n>> of a CIGAR string."""
    ops = F.regexp_extract_all(cigar, F.lit(r"(\d+)([MIDNSHP=X])"), F.lit(0))
    return F.transform(ops, lambda x: F.struct(F.substring(x, -1, 1).alias("op"), F.regexp_extract(x, r"\d+", 0).cast("long").alias("n")))


def aligned_blocks(pos: str = "pos", cigar: str = "cigar") -> Column:
    """Reference blocks of an alignment: runs of M, = and X; D and N move on, I and S do not."""
    zero = F.struct(F.col(pos).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("blocks"))

    def step(acc: Column, x: Column) -> Column:
        end = acc["at"] + F.when(x["op"].isin("M", "=", "X", "D", "N"), x["n"]).otherwise(F.lit(0))
        block = F.array(F.struct(acc["at"].alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(x["op"].isin("M", "=", "X"), F.concat(acc["blocks"], block)).otherwise(acc["blocks"]).alias("blocks"))

    return F.aggregate(cigar_ops(cigar), zero, step, lambda acc: acc["blocks"])


def aligned_end(pos: str = "pos", cigar: str = "cigar") -> Column:
    return F.col(pos) + F.aggregate(cigar_ops(cigar), F.lit(0).cast("long"), lambda s, x: s + F.when(x["op"].isin("M", "=", "X", "D", "N"), x["n"]).otherwise(F.lit(0)))


def template_length(cigar: str | None = None) -> Column:
    """|tlen|, or for single reads the aligned bases (M, D, =, X) of the CIGAR, or qlen without one."""
    if cigar is None:
        alone = F.col("qlen").cast("long")
    else:
        alone = F.aggregate(cigar_ops(cigar), F.lit(0).cast("long"), lambda s, x: s + F.when(x["op"].isin("M", "D", "=", "X"), x["n"]).otherwise(F.lit(0)))
    return F.when(F.col("tlen") != 0, F.abs("tlen").cast("long")).otherwise(alone)


def filter_reads(df: DataFrame, min_mapq: int = 0, include: int = 0, exclude: int = 0, min_len: int = 0, max_len: int = 0, skip_chroms: tuple[str, ...] = (), strand: str | None = None) -> DataFrame:
    """Unmapped reads, mapping quality, flags, fragment length, chromosomes and RNA strand; 0 switches a limit off."""
    df = df.where(~has(UNMAPPED))
    if min_mapq:
        df = df.where(F.col("mapq") >= min_mapq)
    if include:
        df = df.where(F.col("flag").bitwiseAND(F.lit(include)) == include)
    if exclude:
        df = df.where(F.col("flag").bitwiseAND(F.lit(exclude)) == 0)
    if min_len:
        df = df.where(template_length() >= min_len)
    if max_len:
        df = df.where(template_length() <= max_len)
    if skip_chroms:
        df = df.where(~F.col("chrom").isin(*skip_chroms))
    return df.where(rna_strand(strand)) if strand else df


def rna_strand(strand: str) -> Column:
    """Reads of transcripts on a strand, for libraries of the dUTP kind."""

    def both(mask: int, value: int) -> Column:
        return F.col("flag").bitwiseAND(F.lit(mask)) == value

    if strand == "forward":
        return F.when(has(PAIRED), both(144, 128) | both(96, 64)).otherwise(both(16, 16))
    if strand == "reverse":
        return F.when(has(PAIRED), both(144, 144) | both(96, 96)).otherwise(both(16, 0))
    raise ValueError("strand is forward or reverse")


def duplicate_key() -> list[Column]:
    """Equal for reads that count as duplicates: with a mate on the chromosome the fragment's ends, else start and mate position."""
    there = F.col("mate_chrom") == F.col("chrom")
    return [F.col("sample"), F.col("chrom"), F.col("pos"), F.when(there, F.col("pos") + template_length()).otherwise(F.col("mate_pos")).alias("dup_end"), F.col("mate_chrom"), has(REVERSE).alias("rev")]


def drop_duplicates(df: DataFrame) -> DataFrame:
    """The first read of each duplicate key in order of read_id; to be used after the other filters.

    An aggregate, not a window: pile-ups are reduced before the shuffle.
    """
    keys = [k.alias(f"_k{i}") for i, k in enumerate(duplicate_key())]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*df.columns), "read_id").alias("_r")).select("_r.*")


def proper_pair(max_len: int) -> Column:
    """Proper, on one chromosome, not too long, mates on opposite strands and facing each other."""
    rev, mate_rev = has(REVERSE), has(MATE_REVERSE)
    inward = F.when(rev, F.col("pos") >= F.col("mate_pos")).otherwise(F.col("pos") <= F.col("mate_pos"))
    return has(PROPER) & (F.col("chrom") == F.col("mate_chrom")) & (F.abs("tlen") <= max_len) & (rev != mate_rev) & inward


def fragment(extend: int = 0, center: bool = False, max_pair: int | None = None) -> tuple[Column, Column]:
    """Start and end of the fragment of a read: the pair's span, or the read extended from its 5' end, or the read."""
    start, end = F.col("pos").cast("long"), F.col("end").cast("long")
    if extend:
        pair = proper_pair(max_pair or 4 * extend)
        left = F.when(has(REVERSE), F.least(start, F.greatest(F.col("end") - extend, F.lit(0)))).otherwise(start)
        right = F.when(has(REVERSE), end).otherwise(F.greatest(end, start + extend))
        whole_start = F.least("pos", "mate_pos").cast("long")
        start, end = F.when(pair, whole_start).otherwise(left), F.when(pair, whole_start + F.abs("tlen")).otherwise(right)
    if center:
        middle = end - (end - start - 1) / 2
        half = F.col("qlen") / 2
        start, end = (middle - half).cast("long"), (middle + half).cast("long")
    return start, end


def nucleosome_centre(low: int = 130, high: int = 200) -> tuple[Column, Column, Column]:
    """Condition, start and end of the centre of mono-nucleosome fragments (forward mates of proper pairs)."""
    ok = has(PROPER) & has(MATE_REVERSE) & ~has(REVERSE) & (F.abs("tlen") >= low) & (F.abs("tlen") <= high)
    size = F.abs("tlen")
    even = size % 2 == 0
    start = F.col("pos") + F.floor(size / 2) - 1
    return ok, start, start + F.when(even, 2).otherwise(4)


def shifted(shift: tuple[int, ...], chrom_size: Column) -> tuple[Column, Column, Column]:
    """Condition, start and end of the fragment of a leftmost read of a proper pair, moved by 2 or 4 shifts, within the chromosome."""
    s = shift if len(shift) == 4 else (shift[0], shift[1], -shift[1], -shift[0])
    first = has(READ1)
    a = F.when(first, F.lit(s[0])).otherwise(F.lit(s[2]))
    b = F.when(first, F.lit(s[1])).otherwise(F.lit(s[3]))
    start = F.greatest(F.lit(0), F.col("pos") + a)
    end = F.least(chrom_size, F.col("pos") + F.col("tlen") + b)
    return has(PROPER) & (F.col("tlen") > 0), start, F.greatest(end, start + 1)
