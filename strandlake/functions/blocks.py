"""Expressions over arrays of blocks (start, end): exons of a region or aligned parts of a read, in genomic order.

The bases of the blocks, laid end to end, form an axis from 0; all operators here cut that axis.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(blocks: Column) -> Column:
    """Number of bases."""
    return F.aggregate(blocks, F.lit(0).cast("long"), lambda s, b: s + b["end"] - b["start"])


def clip(blocks: Column, low: Column, high: Column) -> Column:
    """What lies within [low, high) of the axis, as blocks."""
    empty = F.array().cast("array<struct<start:bigint,end:bigint>>")

    def step(acc: Column, b: Column) -> Column:
        n = b["end"] - b["start"]
        a, z = F.greatest(low - acc["at"], F.lit(0)), F.least(high - acc["at"], n)
        piece = F.array(F.struct((b["start"] + a).cast("long").alias("start"), (b["start"] + z).cast("long").alias("end")))
        return F.struct((acc["at"] + n).alias("at"), F.when(z > a, F.concat(acc["out"], piece)).otherwise(acc["out"]).alias("out"))

    return F.aggregate(blocks, F.struct(F.lit(0).cast("long").alias("at"), empty.alias("out")), step, lambda acc: acc["out"])


def chop(blocks: Column, left: int, right: int) -> dict[str, Column]:
    """The first `left` bases, the last `right` of what remains, the body between, and the bases that were missing."""
    n = total(blocks)
    a = F.least(F.lit(left), n)
    z = F.greatest(n - right, a)
    return {"left": clip(blocks, F.lit(0), a), "body": clip(blocks, a, z), "right": clip(blocks, z, n), "pad_left": left - a, "pad_right": right - (n - z)}


def chop_middle(blocks: Column, left: int, right: int) -> dict[str, Column]:
    """`left` bases before and `right` bases after the middle of the axis, and the bases that were missing."""
    n = total(blocks)
    mid = F.floor(n / 2)
    return {"left": clip(blocks, mid - left, mid), "right": clip(blocks, mid, mid + right), "pad_left": F.greatest(left - mid, F.lit(0)), "pad_right": F.greatest(right - (n - mid), F.lit(0))}


def offsets(blocks: Column, reverse: Column, first: int, last: int | None = None) -> Column:
    """Bases `first` to `last` of a read along its strand: 1-based, both included; negative ones count from its end.

    One value picks one base.  Positions beyond the read give nothing.
    """
    if first == 0 or last == 0:
        raise ValueError("offsets are 1-based")
    n = total(blocks)
    last = first if last is None else last
    a = F.lit(first - 1) if first > 0 else n + first
    z = F.lit(last) if last > 0 else n + last + 1
    low, high = F.when(reverse, n - z).otherwise(a), F.when(reverse, n - a).otherwise(z)
    return clip(blocks, low, high)
