"""Interval helpers: everything is 0-based and half-open.  Pure DataFrame functions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def buckets(start: Column, end: Column, width: int) -> Column:
    """Numbers of the buckets that an interval touches (none for an empty one)."""
    return F.when(end > start, F.sequence(F.floor(start / width), F.floor((end - 1) / width))).otherwise(F.array().cast("array<bigint>"))


def overlap_join(left: DataFrame, right: DataFrame, how: str = "inner", bucket: int = 2000, min_overlap: int = 1, contained: bool = False) -> DataFrame:
    """Join on overlap of [start, end) within a chrom; right's chrom, start, end become r_chrom, r_start, r_end.

    Both sides are dealt into buckets and joined on (chrom, bucket); a pair counts only in the bucket of its overlap's first base,
    so no distinct is needed.  contained: left must lie inside right.  how: inner, left, semi, anti.  Left rows keep
    their multiplicity in every form.
    """
    r = right.select(*[F.col(c).alias(f"r_{c}" if c in ("chrom", "start", "end") else c) for c in right.columns])
    r = r.withColumn("_rb", F.explode(buckets(F.col("r_start"), F.col("r_end"), bucket)))
    marked = left if how == "inner" else left.withColumn("_row", F.monotonically_increasing_id())
    lb = marked.withColumn("_lb", F.explode(buckets(F.col("start"), F.col("end"), bucket)))
    first, last = F.greatest("start", "r_start"), F.least("end", "r_end")
    on = (F.col("chrom") == F.col("r_chrom")) & (F.col("_lb") == F.col("_rb")) & (last - first >= min_overlap)
    if contained:
        on &= (F.col("start") >= F.col("r_start")) & (F.col("end") <= F.col("r_end"))
    if how in ("semi", "anti"):
        hit = lb.join(r, on, "left_semi").select("_row").distinct()
        return marked.join(hit, "_row", f"left_{how}").drop("_row")
    pairs = lb.join(r, on).where(F.floor(first / bucket) == F.col("_lb")).drop("_lb", "_rb")
    if how == "inner":
        return pairs
    mine = [c for c in pairs.columns if c not in left.columns]
    return marked.join(pairs.select(*mine), "_row", "left").drop("_row")


#: Bases of a range within which one task adds up starts and ends; sums of whole ranges are added afterwards.
COUNT_RANGE = 65_536


def count_overlaps(spans: DataFrame, targets: DataFrame, keys: Sequence[str] = (), zeros: bool = False) -> DataFrame:
    """targets' rows with n, how many spans of each value of the keys meet them on [start, end); only rows above 0.

    zeros (without keys): every row of targets, also those that no span meets.

    No pairs are made: spans that start before a target's end, less those that end at or before its start.  Spans are reduced
    to counts by position before they are dealt out, so the work grows with spans and targets, not with their product.
    """
    keys, how = list(keys), "left" if zeros else "inner"
    if keys and zeros:
        raise ValueError("zeros are for counts without keys")
    ends = F.array(F.struct(F.col("start").cast("long").alias("at"), F.lit(1).alias("s"), F.lit(0).alias("e")), F.struct(F.col("end").cast("long").alias("at"), F.lit(0).alias("s"), F.lit(1).alias("e")))
    marks = spans.where("end > start AND chrom IS NOT NULL").select(*keys, "chrom", F.explode(ends).alias("m")).groupBy(*keys, "chrom", "m.at").agg(F.sum("m.s").alias("s"), F.sum("m.e").alias("e"))
    some = targets.where("end > start AND chrom IS NOT NULL")
    targets = targets if zeros else some
    asked = some.select("chrom", F.explode(F.array(F.col("start").cast("long"), F.col("end").cast("long"))).alias("at")).distinct()
    if keys:
        asked = asked.crossJoin(F.broadcast(marks.select(*keys).distinct()))
    asked = asked.select(*keys, "chrom", "at", F.lit(0).cast("long").alias("s"), F.lit(0).cast("long").alias("e"), F.lit(True).alias("asked"))
    part = F.floor(F.col("at") / COUNT_RANGE).alias("_part")
    both = marks.withColumn("asked", F.lit(False)).unionByName(asked).groupBy(*keys, "chrom", "at").agg(F.sum("s").alias("s"), F.sum("e").alias("e"), F.max("asked").alias("asked")).withColumn("_part", part)
    within = Window.partitionBy(*keys, "chrom", "_part").orderBy("at")
    before, upto = within.rowsBetween(Window.unboundedPreceding, -1), within.rowsBetween(Window.unboundedPreceding, 0)
    sums = both.withColumn("_started", F.coalesce(F.sum("s").over(before), F.lit(0))).withColumn("_ended", F.sum("e").over(upto)).where("asked")
    earlier = Window.partitionBy(*keys, "chrom").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    parts = both.groupBy(*keys, "chrom", "_part").agg(F.sum("s").alias("s"), F.sum("e").alias("e"))
    parts = parts.select(*keys, "chrom", "_part", F.coalesce(F.sum("s").over(earlier), F.lit(0)).alias("_s0"), F.coalesce(F.sum("e").over(earlier), F.lit(0)).alias("_e0"))
    named = [F.col(k).alias(f"_k_{k}") for k in keys]
    parts = parts.select(*named, F.col("chrom").alias("_c"), F.col("_part").alias("_p"), "_s0", "_e0")
    same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    on = (F.col("chrom") == F.col("_c")) & (F.col("_part") == F.col("_p"))
    for x in same:
        on &= x
    sums = sums.join(parts, on).select(*keys, "chrom", "at", (F.col("_started") + F.col("_s0")).alias("_started"), (F.col("_ended") + F.col("_e0")).alias("_ended"))
    low = sums.select(*keys, F.col("chrom").alias("_c"), F.col("at").alias("_at"), "_ended")
    high = sums.select(*named, F.col("chrom").alias("_c"), F.col("at").alias("_at"), "_started")
    out = targets.join(low, (F.col("chrom") == F.col("_c")) & (F.col("start") == F.col("_at")), how).drop("_c", "_at")
    on = (F.col("chrom") == F.col("_c")) & (F.col("end") == F.col("_at"))
    for x in same:
        on &= x
    out = out.join(high, on, how).withColumn("n", F.when(F.col("end") > F.col("start"), F.col("_started") - F.col("_ended")))
    out = out.withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    return (out if zeros else out.where("n > 0")).select(*keys, *targets.columns, "n")


def merge_intervals(df: DataFrame, keys: Sequence[str] = ("chrom",), gap: int = 0) -> DataFrame:
    """Unions of intervals that overlap or are at most `gap` apart."""
    df = df.groupBy(*keys, "start").agg(F.max("end").alias("end"))  # the longest of equal starts reaches as far
    w = Window.partitionBy(*keys).orderBy("start", "end")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    df = df.withColumn("_new", (reach.isNull() | (F.col("start") > reach + gap)).cast("int"))
    df = df.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return df.groupBy(*keys, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_island")


def common_chroms(first: DataFrame, *others: DataFrame) -> DataFrame:
    """(chrom, size) of `first` that all others have too; one with none in common is tried with chr added or cut off."""
    keys = ["chrom", "size"]
    common = first.select(*keys).distinct()
    for other in others:
        other = other.select(*keys).distinct()
        if common.join(other, keys, "left_semi").isEmpty():
            chrom = F.col("chrom")
            other = other.withColumn("chrom", F.when(chrom.startswith("chr"), F.substr(chrom, F.lit(4))).otherwise(F.concat(F.lit("chr"), chrom)))
            if common.join(other, keys, "left_semi").isEmpty():
                raise ValueError("no common chromosomes")
        common = common.join(other, keys, "left_semi")
    return common


def complement(sizes: DataFrame, taken: DataFrame) -> DataFrame:
    """What is left of each chromosome (chrom, size) outside the intervals `taken`, as numbered segments."""
    merged = merge_intervals(taken).join(sizes, "chrom").select("chrom", F.greatest(F.lit(0), "start").alias("start"), F.least("end", "size").alias("end"), "size").where("start < size")
    w = Window.partitionBy("chrom").orderBy("start")
    after = merged.select("chrom", F.col("end").alias("start"), F.coalesce(F.lead("start").over(w), F.col("size")).alias("end"))
    firsts = sizes.join(merged.groupBy("chrom").agg(F.min("start").alias("first")), "chrom", "left").select("chrom", F.lit(0).cast("long").alias("start"), F.coalesce("first", "size").alias("end"))
    out = firsts.union(after).where("end > start")
    return out.withColumn("segment", F.row_number().over(w) - 1)


def bin_domain(segments: DataFrame, width: int, step: int | None = None) -> DataFrame:
    """Bins of each segment, anchored at its start; the last partial one stays only where bins tile."""
    step = step or width
    last = F.col("end") - 1 if step == width else F.col("end") - width
    out = segments.where(last >= F.col("start")).select("chrom", "segment", F.col("end").alias("_e"), F.explode(F.sequence("start", last, F.lit(step).cast("long"))).alias("start"))
    return out.select("chrom", "segment", "start", F.least(F.col("start") + width, F.col("_e")).alias("end"))


#: Bases of a range within which runs are found in one task; runs at the borders of ranges are joined afterwards.
RUN_RANGE = 1_000_000


def _runs(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy("start")
    same = F.col(value).eqNullSafe(F.lag(value).over(w)) & (F.lag("end").over(w) == F.col("start"))
    df = df.withColumn("_run", F.sum(F.when(same, 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return df.groupBy(*keys, "_run", value).agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_run")


def run_lengths(df: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Adjacent intervals with equal values become one; null ends a run and is not written."""
    parts = _runs(df.select(*keys, "start", "end", value).withColumn("_range", F.floor(F.col("start") / RUN_RANGE)), [*keys, "_range"], value)
    own = Window.partitionBy(*keys, "_range")
    parts = parts.withColumn("_edge", (F.col("start") == F.min("start").over(own)) | (F.col("end") == F.max("end").over(own)))
    inner = parts.where("NOT _edge").select(*keys, "start", "end", value)
    edges = _runs(parts.where("_edge").select(*keys, "start", "end", value), keys, value)  # two rows a range
    return inner.unionByName(edges).where(F.col(value).isNotNull()).select(*keys, "start", "end", value)


def smooth(df: DataFrame, keys: Sequence[str], length: int, width: int, value: str = "value") -> DataFrame:
    """Mean over int(length / width) bins around each; windows end at the borders of the keys."""
    n = length // width
    if n <= 1:
        return df
    left, right = -(-(n - 1) // 2), (n - 1) // 2
    w = Window.partitionBy(*keys).orderBy("start").rowsBetween(-left, right)
    return df.withColumn(value, F.avg(value).over(w))
