"""Coverage of bins and regions, normalisation, comparison of tracks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from strandlake.functions.intervals import count_overlaps, merge_intervals, overlap_join


def count_in_bins(fragments: DataFrame, width: int) -> DataFrame:
    """Reads per bin of `width` from position 0: (sample, chrom, start, n).  A read counts once in a bin.

    fragments: sample, chrom and either start, end or blocks.  The bins of a read are made distinct before they are exploded,
    so no read id is needed and there is one shuffle, after partial counts.
    """
    if "blocks" in fragments.columns:
        bins = F.array_distinct(F.flatten(F.transform("blocks", lambda b: F.sequence(F.floor(b["start"] / width), F.floor((b["end"] - 1) / width)))))
    else:
        bins = F.sequence(F.floor(F.col("start") / width), F.floor((F.col("end") - 1) / width))
    hits = fragments.select("sample", "chrom", F.explode(bins).alias("bin"))
    return hits.groupBy("sample", "chrom", "bin").agg(F.count("*").alias("n")).select("sample", "chrom", (F.col("bin") * width).alias("start"), "n")


def count_in_domain(fragments: DataFrame, domain: DataFrame) -> DataFrame:
    """Reads per (sample, bin) of any domain of bins."""
    hits = count_overlaps(fragments.select("sample", "chrom", "start", "end"), domain.select("chrom", "start", "end"), ["sample"])
    return hits.groupBy("sample", "chrom", "start", "end").agg(F.sum("n").alias("n"))


def fill_domain(counts: DataFrame, domain: DataFrame, samples: DataFrame, value: str = "n") -> DataFrame:
    """A row for every bin of the domain and every sample; samples is a short list."""
    every = domain.join(F.broadcast(samples), F.lit(True))
    return every.join(counts.drop("end"), ["sample", "chrom", "start"], "left").withColumn(value, F.coalesce(value, F.lit(0)))


def covered_bases(fragments: DataFrame, width: int, sizes: DataFrame | None = None) -> DataFrame:
    """Summed overlap in bases per bin: (sample, chrom, start, bases); with sizes (chrom, size) only bins that end inside."""
    bins = F.sequence(F.floor(F.col("start") / width), F.floor((F.col("end") - 1) / width))
    hits = fragments.select("sample", "chrom", "start", "end", F.explode(bins).alias("bin"))
    part = F.least("end", (F.col("bin") + 1) * width) - F.greatest("start", F.col("bin") * width)
    out = hits.groupBy("sample", "chrom", "bin").agg(F.sum(part).alias("bases"))
    if sizes is not None:  # after the sums, and broadcast: a join by chromosome would put all reads of one into one task
        out = out.join(F.broadcast(sizes.select("chrom", F.col("size").alias("_size"))), "chrom").where((F.col("bin") + 1) * width <= F.col("_size"))
    return out.select("sample", "chrom", (F.col("bin") * width).alias("start"), "bases")


def scale_factor(method: str, kept: Column, width: int = 50, genome: int = 0, fragment: int = 0) -> Column:
    """Factors by which counts become normalised: RPKM, CPM, BPM (equal to CPM), RPGC or none."""
    if method in ("CPM", "BPM"):
        return 1e6 / kept
    if method == "RPKM":
        return 1.0 / ((kept / 1e6) * (width / 1000))
    if method == "RPGC":
        return genome / (kept * fragment)
    if method == "none":
        return F.lit(1.0)
    raise ValueError(f"unknown normalisation {method}")


def divide(a: Column, b: Column) -> Column:
    """a / b with infinities for division by zero and null for 0 / 0."""
    return F.when(b != 0, F.try_divide(a, b)).when(a > 0, float("inf")).when(a < 0, float("-inf"))


def log2(x: Column) -> Column:
    return F.when(x == 0, float("-inf")).when(x == float("inf"), float("inf")).otherwise(F.log2(x))


def compare(op: str, a: Column, b: Column, factors: tuple[float, float] = (1.0, 1.0), pseudo: tuple[float, float] = (1.0, 1.0)) -> Column:
    """Row function of two tracks; scaled first, pseudocounts only for ratios; a missing side makes it missing."""
    a, b = a * factors[0], b * factors[1]
    if op in ("ratio", "log2", "reciprocal_ratio"):
        r = divide(a + pseudo[0], b + pseudo[1])
        if op == "log2":
            return log2(r)
        return r if op == "ratio" else F.when(r >= 1, r).otherwise(-divide(F.lit(1.0), r))
    simple = {"subtract": a - b, "add": a + b, "mean": (a + b) / 2, "first": F.when(b.isNotNull(), a), "second": F.when(a.isNotNull(), b)}
    return simple[op]


def average(values: list[Column], factors: list[float] | None = None) -> Column:
    """Mean of scaled tracks; null if one is missing."""
    factors = factors or [1.0] * len(values)
    return sum((v * f for v, f in zip(values, factors, strict=True)), F.lit(0.0)) / len(values)


def region_counts(fragments: DataFrame, regions: DataFrame, exons: str | None = None) -> DataFrame:
    """Reads per region; with exons each exon counts on its own and the counts are summed."""
    if exons:
        regions = regions.select("region", "chrom", F.explode(exons).alias("x")).select("region", "chrom", "x.start", "x.end")
    hits = count_overlaps(fragments.select("sample", "chrom", "start", "end"), regions.select("region", "chrom", "start", "end"), ["sample"])
    return hits.groupBy("sample", "region").agg(F.sum("n").alias("n"))


#: Bases that one task holds as arrays when a signal is summed up.
SIGNAL_TILE = 4096


def signal_statistics(bins: DataFrame, signal: DataFrame) -> DataFrame:
    """(chrom, start, end, w, wv, wvv, lo, hi) of each distinct bin that meets a signal: bases under signal intervals, the sums of
    value and squared value by base, the least and the greatest value; the last four are null where all values are.

    Bins and signal are dealt out by tiles of SIGNAL_TILE bases, each bin once however many regions have it, and summed up in arrays
    by base; so the work grows with bins and signal, not with their pairs.
    """

    keys = ["chrom", "start", "end"]

    def dealt(t: DataFrame) -> DataFrame:
        t = t.where("end > start AND chrom IS NOT NULL")
        return t.withColumn("_tile", F.explode(F.sequence(F.floor(F.col("start") / SIGNAL_TILE), F.floor((F.col("end") - 1) / SIGNAL_TILE))))

    def summed(bins: pa.Table, signal: pa.Table) -> pa.Table:
        """The pieces of bins within one tile, from arrays by base that are doubled in length step by step (sums are never subtracted)."""
        n = SIGNAL_TILE
        names = ("w", "known", "wv", "wvv", "lo", "hi")
        if not len(bins) or not len(signal):
            return pa.table([pa.array([], t) for t in kinds], names=[*keys, *names])
        at = bins["_tile"][0].as_py() * n
        low, high = (np.clip(signal[c].to_numpy() - at, 0, n) for c in ("start", "end"))
        length = high - low
        base = np.repeat(low - np.r_[0, np.cumsum(length)[:-1]], length) + np.arange(length.sum())
        v, known = (np.repeat(signal[c].to_numpy(), length) for c in ("value", "known"))
        least, most = np.full(n, np.nan), np.full(n, -np.inf)
        np.fmin.at(least, base[known], v[known])
        np.maximum.at(most, base[known], v[known])
        tables = [np.bincount(base, x, n) for x in (None, known, v, v * v)] + [least, most]
        joins = [np.add] * 4 + [np.fmin, np.maximum]  # Spark has NaN above all numbers
        pos, end = (np.clip(bins[c].to_numpy() - at, 0, n) for c in ("start", "end"))
        size = end - pos
        got = [np.full(len(bins), x, float) for x in (0, 0, 0, 0, np.nan, -np.inf)]
        for k in range(n.bit_length()):
            rows = np.flatnonzero(size >> k & 1)
            for j, (t, f) in enumerate(zip(tables, joins, strict=True)):
                got[j][rows] = f(got[j][rows], t[pos[rows]])
            pos[rows] += 1 << k
            tables = [f(t[: -(1 << k)], t[1 << k :]) for t, f in zip(tables, joins, strict=True)]
        sums = [pa.array(x.astype(np.int64) if c in ("w", "known") else x) for c, x in zip(names, got, strict=True)]
        return pa.table([*[bins[c] for c in keys], *sums], names=[*keys, *names]).filter(pa.array(got[0] > 0))

    chrom = bins.schema["chrom"].dataType
    kinds = [to_arrow_type(chrom), *[pa.int64()] * 4, *[pa.float64()] * 4]
    b = dealt(bins.select("chrom", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end")).distinct())
    v = F.col("value").cast("double")
    s = dealt(signal.select("chrom", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.coalesce(v, F.lit(0.0)).alias("value"), v.isNotNull().alias("known")))
    schema = f"chrom {chrom.simpleString()}, start long, end long, w long, known long, wv double, wvv double, lo double, hi double"
    parts = b.groupBy("chrom", "_tile").cogroup(s.groupBy("chrom", "_tile")).applyInArrow(summed, schema)
    some = F.col("known") > 0
    parts = parts.select(*keys, "w", *[F.when(some, F.col(c)).alias(c) for c in ("wv", "wvv", "lo", "hi")])
    return parts.groupBy(*keys).agg(F.sum("w").alias("w"), F.sum("wv").alias("wv"), F.sum("wvv").alias("wvv"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def region_means(signal: DataFrame, regions: DataFrame) -> DataFrame:
    """Mean of a signal over the covered bases of each region, and their number."""
    hits = regions.select("region", "chrom", "start", "end").join(signal_statistics(regions, signal), ["chrom", "start", "end"])
    got = hits.groupBy("region").agg((F.sum("wv") / F.sum("w")).alias("mean"), F.sum("w").alias("covered"))
    return regions.select("region").join(got, "region", "left")


def tile_means(signal: DataFrame, domain: DataFrame, zero_missing: bool) -> DataFrame:
    """Mean per tile; a tile with a missing base is missing unless missing bases count as 0."""
    got = signal_statistics(domain, signal).select("chrom", "start", "end", F.col("wv").alias("s"), F.col("w").alias("covered"))
    out = domain.select("chrom", "start", "end").join(got, ["chrom", "start", "end"], "left")
    width = F.col("end") - F.col("start")
    value = F.coalesce("s", F.lit(0.0)) / width if zero_missing else F.when(F.col("covered") == width, F.col("s") / width)
    return out.select("chrom", "start", "end", value.alias("value"))


def enrichment(fragments: DataFrame, features: DataFrame) -> DataFrame:
    """(sample, feature, hits, total, percent): a read counts once for a feature type however many features it meets."""
    total = fragments.groupBy("sample").agg(F.count("*").alias("total"))
    islands = merge_intervals(features.where("end > start"), ("chrom", "feature"))  # unions meet the same reads, with far fewer pairs
    islands = islands.withColumn("_before", F.lag("end").over(Window.partitionBy("chrom", "feature").orderBy("start")))
    hits = overlap_join(fragments.select("sample", "chrom", "start", "end"), islands.select("chrom", "start", "end", "feature", "_before"))
    first = F.col("_before").isNull() | (F.col("_before") <= F.col("start"))  # of the islands that a read meets, so no ids and no distinct
    counted = hits.where(first).groupBy("sample", "feature").agg(F.count("*").alias("hits"))
    return counted.join(F.broadcast(total), "sample").withColumn("percent", 100.0 * F.col("hits") / F.col("total"))
