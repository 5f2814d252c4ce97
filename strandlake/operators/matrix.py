"""Region by bin matrices: (group, region, sample, bins array<double>), null for missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlake.functions.intervals import overlap_join
from strandlake.operators.coverage import signal_statistics


def zones_reference_point(regions: DataFrame, before: int, after: int, width: int, point: str = "TSS") -> DataFrame:
    """Bins around a point of each region, numbered in reading direction: (region, group, chrom, strand, bin, start, end)."""
    if before % width or after % width:
        raise ValueError("lengths have to be multiples of the bin size")
    fwd = F.col("strand") != "-"
    centre = ((F.col("start") + F.col("end")) / 2).cast("long")
    at = {"TSS": F.when(fwd, F.col("start")).otherwise(F.col("end")), "TES": F.when(fwd, F.col("end")).otherwise(F.col("start")), "center": centre}[point]
    n = (before + after) // width
    k = F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    out = regions.select("group", "region", "chrom", "strand", at.alias("_at"), fwd.alias("_f"), k.alias("bin"))
    start = F.when(F.col("_f"), F.col("_at") - before + F.col("bin") * width).otherwise(F.col("_at") + before - (F.col("bin") + 1) * width)
    return out.withColumn("start", start).withColumn("end", start + width).drop("_at", "_f")


def zones_scaled(regions: DataFrame, body: int, before: int, after: int, width: int) -> DataFrame:
    """Regions of any length scaled to body / width bins of at least one base, with fixed-size flanks.

    The bins of a region shorter than one bin (width) are empty, flanks too, so all its values are missing.
    """
    b, a, n = before // width, after // width, body // width
    size = F.col("end") - F.col("start")
    out = regions.select("group", "region", "chrom", "strand", F.col("start").alias("_s"), size.alias("_n"), F.explode(F.sequence(F.lit(0), F.lit(b + n + a - 1))).alias("_k"))
    k = F.when(F.col("strand") == "-", b + n + a - 1 - F.col("_k")).otherwise(F.col("_k"))
    left, right = F.when(F.col("strand") == "-", F.lit(after)).otherwise(F.lit(before)), F.when(F.col("strand") == "-", F.lit(a)).otherwise(F.lit(b))
    i = F.col("_k") - right
    start = (
        F.when(F.col("_k") < right, F.col("_s") - left + F.col("_k") * width)
        .when(i < n, F.col("_s") + F.floor(i * F.col("_n") / n))
        .otherwise(F.col("_s") + F.col("_n") + (i - n) * width)
    )
    end = F.when(F.col("_k") < right, start + width).when(i < n, F.greatest(F.col("_s") + F.floor((i + 1) * F.col("_n") / n), start + 1)).otherwise(start + width)
    start, end = (F.when(F.col("_n") < width, F.col("_s")).otherwise(x) for x in (start, end))
    return out.withColumn("bin", k.cast("int")).withColumn("start", start.cast("long")).withColumn("end", end.cast("long")).select("group", "region", "chrom", "strand", "bin", "start", "end")


STATISTICS = ("mean", "sum", "min", "max", "std", "median")


def bin_statistics(zones: DataFrame, signal: DataFrame, stats: tuple[str, ...], zero_missing: bool = False) -> DataFrame:
    """(group, region, bin and a column for each statistic) over the bases of a bin that have signal (or all, if missing ones count as 0).

    Each distinct bin is summed up once, however many regions have it; all statistics come from one pass;
    the values of a bin are gathered only for the median.
    """
    keys = ["chrom", "start", "end"]
    got = signal_statistics(zones, signal)
    if "median" in stats:
        hits = overlap_join(zones.select(*keys).distinct(), signal.select(*keys, "value"), bucket=200)
        part = F.least("end", "r_end") - F.greatest("start", "r_start")
        got = got.join(hits.groupBy(*keys).agg(F.percentile("value", 0.5, part.cast("long")).alias("mid")), keys, "left")
    width = F.col("end") - F.col("start")
    n = width if zero_missing else F.col("w")
    mean = F.col("wv") / n
    gap = F.lit(zero_missing) & (F.col("w") < width)
    value = {
        "mean": mean,
        "sum": F.col("wv"),
        "min": F.when(gap, F.least("lo", F.lit(0.0))).otherwise(F.col("lo")),
        "max": F.when(gap, F.greatest("hi", F.lit(0.0))).otherwise(F.col("hi")),
        "std": F.sqrt(F.greatest(F.col("wvv") / n - mean * mean, F.lit(0.0))),
        "median": F.col("mid"),
    }
    out = zones.join(got, keys, "left").select("group", "region", "bin", *[value[x].alias(x) for x in stats])
    return out.fillna(0.0, subset=list(stats)) if zero_missing else out


def bin_values(zones: DataFrame, signal: DataFrame, stat: str = "mean", zero_missing: bool = False) -> DataFrame:
    """One statistic of each zone bin as `value`."""
    return bin_statistics(zones, signal, (stat,), zero_missing).withColumnRenamed(stat, "value")


def to_rows(values: DataFrame) -> DataFrame:
    """Long bins to one array a region."""
    got = values.groupBy("group", "region").agg(F.array_sort(F.collect_list(F.struct("bin", "value"))).alias("b"))
    return got.select("group", "region", F.transform("b", lambda x: x["value"]).alias("bins"))


def _known(bins: str = "bins") -> Column:
    return F.filter(bins, lambda x: x.isNotNull())


def row_statistic(name: str, bins: str = "bins") -> Column:
    x = _known(bins)
    n = F.size(x)
    total = F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    ordered = F.array_sort(x)
    middle = (F.element_at(ordered, ((n + 1) / 2).cast("int")) + F.element_at(ordered, (n / 2).cast("int") + 1)) / 2
    value = {"mean": total / n, "sum": total, "min": F.array_min(x), "max": F.array_max(x), "median": F.when(n > 0, middle)}[name]
    return F.when(n > 0, value)


def sort_regions(m: DataFrame, using: str = "mean", descending: bool = True) -> DataFrame:
    """Adds the position of each region in its group, ties by region."""
    key = row_statistic(using)
    m = m.withColumn("_key", key)
    order = F.desc_nulls_last("_key") if descending else F.asc_nulls_last("_key")
    return m.withColumn("position", F.row_number().over(Window.partitionBy("group").orderBy(order, "region"))).drop("_key")


def filter_strand(m: DataFrame, strand: str) -> DataFrame:
    return m.where(F.col("strand") == strand)


def scaled(m: DataFrame, factor: float) -> DataFrame:
    """All bins times a factor; missing bins stay missing."""
    return m.withColumn("bins", F.transform("bins", lambda v: v * factor))


def subset(m: DataFrame, groups: list | None = None, samples: list[int] | None = None, bins: int = 0) -> DataFrame:
    """The named groups, with `group_order` as asked for, and of a row's samples (of `bins` bins each) the numbered ones in the order asked for."""
    if groups is not None:
        place = F.array_position(F.array(*[F.lit(g) for g in groups]), F.col("group"))
        m = m.where(F.coalesce(place, F.lit(0)) > 0).withColumn("group_order", place)
    if samples is not None:
        m = m.withColumn("bins", F.concat(*[F.slice("bins", 1 + i * bins, bins) for i in samples]))
    return m


def skip_zeros(m: DataFrame) -> DataFrame:
    return m.where(F.coalesce(row_statistic("mean"), F.lit(0.0)) != 0)


def thresholds(m: DataFrame, low: float | None = None, high: float | None = None) -> DataFrame:
    """At building: drops rows without missing bins whose least value is <= low or greatest >= high."""
    full = ~F.exists("bins", lambda x: x.isNull())
    bad = F.lit(False)
    if low is not None:
        bad |= full & (F.array_min("bins") <= low)
    if high is not None:
        bad |= full & (F.array_max("bins") >= high)
    return m.where(~bad)


def filter_values(m: DataFrame, low: float | None = None, high: float | None = None) -> DataFrame:
    ok = F.lit(True)
    if low is not None:
        ok &= F.coalesce(row_statistic("min") >= low, F.lit(True))
    if high is not None:
        ok &= F.coalesce(row_statistic("max") <= high, F.lit(True))
    return m.where(ok)


def profile(m: DataFrame) -> DataFrame:
    """(group, bin, mean, median, min, max, std, sum, n) over the regions of a group."""
    x = m.select("group", F.posexplode("bins").alias("bin", "v")).where("v is not null")
    got = x.groupBy("group", "bin").agg(
        F.avg("v").alias("mean"), F.percentile("v", 0.5).alias("median"), F.min("v").alias("min"), F.max("v").alias("max"), F.stddev_pop("v").alias("std"), F.sum("v").alias("sum"), F.count("v").alias("n")
    )
    return got.withColumn("se", F.col("std") / F.sqrt("n"))


def data_range(m: DataFrame) -> DataFrame:
    x = m.select(F.explode("bins").alias("v")).where("v is not null")
    q = F.percentile("v", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    return x.agg(F.min("v").alias("min"), F.max("v").alias("max"), q.alias("q")).select("min", "max", F.col("q")[0].alias("p10"), F.col("q")[1].alias("median"), F.col("q")[2].alias("p90"))


def rbind(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b)


def cbind(a: DataFrame, b: DataFrame, bins: int) -> DataFrame:
    """b's bins beside a's for equal (group, region); missing rows of b become `bins` nulls."""
    none = F.array_repeat(F.lit(None).cast("double"), bins)
    b = b.select("group", "region", F.col("bins").alias("_b"))
    return a.join(b, ["group", "region"], "left").withColumn("bins", F.concat("bins", F.coalesce("_b", none))).drop("_b")


def heat_limits(m: DataFrame) -> DataFrame:
    x = m.select(F.explode("bins").alias("v")).where("v is not null")
    return x.agg(F.percentile("v", 0.01).alias("low"), F.percentile("v", 0.98).alias("high"))


def k_means(m: DataFrame, k: int, seed: int = 1) -> DataFrame:
    """Adds a cluster 1..k, numbered by descending mean of the cluster; missing bins count as 0."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    x = m.withColumn("features", array_to_vector(F.transform("bins", lambda v: F.coalesce(v, F.lit(0.0)))))
    got = KMeans(k=k, seed=seed).fit(x).transform(x).drop("features")
    means = got.groupBy("prediction").agg(F.avg(row_statistic("mean")).alias("_m"))
    means = means.withColumn("cluster", F.row_number().over(Window.partitionBy().orderBy(F.desc("_m"), "prediction")))
    return got.join(F.broadcast(means.drop("_m")), "prediction").drop("prediction")
