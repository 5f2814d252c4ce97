"""Statistics over samples by bins: long form (sample, chrom, start, value)."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _pairs_of_samples(values: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(a, b, x, y) for a <= b: a bin's samples are gathered in one row (one shuffle, samples are few), pairs come from it."""
    rows = values.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("sample", F.col(value).cast("double").alias("v")))).alias("s"))
    pairs = F.flatten(F.transform("s", lambda p, i: F.transform(F.slice("s", i + 1, F.size("s")), lambda q: F.struct(p["sample"].alias("a"), q["sample"].alias("b"), p["v"].alias("x"), q["v"].alias("y")))))
    return rows.select(F.explode(pairs).alias("p")).select("p.*")


def pearson(values: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """(a, b, r) for all pairs of samples."""
    got = _pairs_of_samples(values, keys, value).groupBy("a", "b").agg(F.corr("x", "y").alias("r"))
    both = F.when(F.col("a") == F.col("b"), F.array(F.struct("a", "b"))).otherwise(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
    return got.select(F.explode(both).alias("p"), "r").select("p.a", "p.b", "r")


def complete_rows(values: DataFrame, keys: list[str], samples: int, value: str = "value") -> DataFrame:
    """The bins for which every one of `samples` samples has a number."""
    known = F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))
    full = values.groupBy(*keys).agg(F.count_if(known).alias("_k")).where(F.col("_k") == samples).drop("_k")
    return values.join(full, keys, "left_semi")


def zeros_to_missing(value: Column) -> Column:
    return F.nullif(value, F.lit(0).cast("double"))


def average_ranks(values: DataFrame, value: str = "value") -> DataFrame:
    """Ranks within a sample, the mean rank for ties.  Ranks come from counts by value, so only distinct values are sorted."""
    by_value = values.groupBy("sample", value).agg(F.count("*").alias("_n"))
    w = Window.partitionBy("sample").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    ranks = by_value.withColumn("rank", F.coalesce(F.sum("_n").over(w), F.lit(0)) + (F.col("_n") + 1) / 2)
    salt, spread = "_salt", 16  # one value, mostly 0, may hold most bins
    wide = ranks.drop("_n").withColumn(salt, F.explode(F.array(*map(F.lit, range(spread)))))
    others = [c for c in values.columns if c not in ("sample", value)]
    return values.withColumn(salt, F.pmod(F.xxhash64(*others), F.lit(spread)).cast("int")).join(wide, ["sample", value, salt]).drop(salt)


def spearman(values: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    return pearson(average_ranks(values, value), keys, "rank")


def skip_zero_rows(values: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    some = values.groupBy(*keys).agg(F.sum(F.coalesce(value, F.lit(0))).alias("_s")).where("_s <> 0").drop("_s")
    return values.join(some, keys, "left_semi")


def mad_outliers(values: DataFrame, keys: list[str], limit: float = 200.0, value: str = "value") -> DataFrame:
    """Keys that are outliers in every sample: |x - median| / (1.4826 * median(|x|)) above the limit."""
    of = values.groupBy("sample").agg(F.percentile(value, 0.5).alias("_m"), F.percentile(F.abs(value), 0.5).alias("_d"))
    far = F.when(F.col("_d") > 0, F.abs(F.col(value) - F.col("_m")) / (1.4826 * F.col("_d")) > limit).otherwise(False)
    return values.join(of, "sample").groupBy(*keys).agg(F.every(far).alias("out")).where("out").drop("out")


def size_factors(values: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Median of ratios to the geometric mean of a bin, inverted; bins with a zero are left out."""
    logs = values.groupBy(*keys).agg(F.min(value).alias("_low"), F.avg(F.when(F.col(value) > 0, F.ln(value))).alias("_g")).where("_low > 0")
    ratio = F.exp(F.percentile(F.ln(value) - F.col("_g"), 0.5))
    return values.join(logs, keys).groupBy("sample").agg((1 / ratio).alias("factor"))


def describe(values: DataFrame, value: str = "value") -> DataFrame:
    x = F.col(value).cast("long")
    q = F.percentile(x, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    out = values.groupBy("sample").agg(F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), F.min(x).alias("min"), q.alias("q"), F.max(x).alias("max"))
    return out.select("sample", "mean", "std", "min", F.col("q")[0].alias("q25"), F.col("q")[1].alias("q50"), F.col("q")[2].alias("q75"), "max")


def at_least(values: DataFrame, thresholds: list[int], value: str = "value") -> DataFrame:
    """Percent of bins with so much coverage, by threshold, in one pass."""
    shares = F.array(*[F.struct(F.lit(t).alias("threshold"), (F.avg((F.col(value) >= t).cast("int")) * 100).alias("percent")) for t in thresholds])
    return values.groupBy("sample").agg(shares.alias("s")).select("sample", F.explode("s").alias("s")).select("sample", "s.threshold", "s.percent")


def coverage_histogram(values: DataFrame, value: str = "value") -> DataFrame:
    """(sample, coverage, n, share of bins with this coverage or more)."""
    h = values.groupBy("sample", F.col(value).cast("long").alias("coverage")).agg(F.count("*").alias("n"))
    down = Window.partitionBy("sample").orderBy(F.desc("coverage")).rowsBetween(Window.unboundedPreceding, 0)
    return h.withColumn("share", F.sum("n").over(down) / F.sum("n").over(Window.partitionBy("sample")))


def fingerprint(values: DataFrame, value: str = "value") -> DataFrame:
    """The sorted cumulative curve of a sample, by distinct value: bins up to it and their share of the signal."""
    h = values.groupBy("sample", F.col(value).alias("v")).agg(F.count("*").alias("n"))
    up, every = Window.partitionBy("sample").orderBy("v").rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy("sample")
    return h.select("sample", "v", "n", F.sum("n").over(up).alias("bins"), (F.sum(F.col("v") * F.col("n")).over(up) / F.sum(F.col("v") * F.col("n")).over(every)).alias("share"), F.sum("n").over(every).alias("total"))


def fingerprint_metrics(values: DataFrame, value: str = "value") -> DataFrame:
    """AUC (mean of the curve over bins), x-intercept and elbow, from the curve by distinct value.

    Between two distinct values the curve is a straight line, so its sum over bins has a closed form and its farthest point
    from the diagonal lies at an end of such a line.
    """
    c = fingerprint(values, value)
    before = Window.partitionBy("sample").orderBy("v")
    low = F.coalesce(F.lag("share").over(before), F.lit(0.0))
    step = F.when(F.col("n") > 0, (F.col("share") - low) / F.col("n"))
    c = c.withColumn("area", F.col("n") * low + step * F.col("n") * (F.col("n") + 1) / 2).withColumn("x", F.col("bins") / F.col("total")).withColumn("gap", F.col("bins") / F.col("total") - F.col("share"))
    zero = F.sum(F.when(F.col("v") == 0, F.col("n")).otherwise(0))
    return c.groupBy("sample").agg((F.sum("area") / F.max("total")).alias("auc"), (zero / F.max("total")).alias("x_intercept"), F.max("gap").alias("elbow_gap"), F.max_by("x", F.struct("gap", -F.col("x"))).alias("elbow"))


def ses_factors(values: DataFrame, a: str, b: str, value: str = "value") -> DataFrame:
    """(sample, factor) of two samples with equal numbers of bins by signal extraction scaling; values are not negative.

    Sorted cumulative sums are straight lines between the last bins of distinct values, so the rank at which they lie
    farthest apart is one of those, and the sums at four fifths of it follow from the distinct values: what is ordered in
    one task is the distinct values, not the bins.  Ranks up to which a sample is all zero are stepped over.
    """
    h = values.where(F.col("sample").isin(a, b)).groupBy("sample", F.col(value).cast("double").alias("v")).agg(F.count("*").cast("double").alias("n"))
    w = Window.partitionBy("sample").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    c = h.select("sample", "v", F.sum("n").over(w).alias("r"), F.sum(F.col("n") * F.col("v")).over(w).alias("s"))
    ahead = Window.orderBy("r").rowsBetween(0, Window.unboundedFollowing)
    both = c.groupBy("r").agg(*[F.max(F.when(F.col("sample") == x, F.struct("r", "v", "s"))).alias(k) for x, k in ((a, "a"), (b, "b"))])
    both = both.select("r", *[F.first(k, ignorenulls=True).over(ahead).alias(k) for k in "ab"])

    def upto(k: str, rank: Column) -> Column:
        return F.col(f"{k}.s") - (F.col(f"{k}.r") - rank) * F.col(f"{k}.v")

    ends = c.groupBy().agg(*[F.max(F.when(F.col("sample") == x, F.col("s"))).alias(f"end_{k}") for x, k in ((a, "a"), (b, "b"))], F.coalesce(F.max(F.when(F.col("v") == 0, F.col("r"))), F.lit(0.0)).alias("zeros"))
    both = both.join(ends, F.lit(True)).where("a is not null and b is not null")
    gap = F.abs(upto("a", F.col("r")) / F.col("end_a") - upto("b", F.col("r")) / F.col("end_b"))
    far = both.agg(F.max_by("r", F.struct(gap, -F.col("r"))).alias("far"), F.max("zeros").alias("zeros"))
    cut = far.select((F.greatest(F.floor((F.col("far") - 1) * 0.8), F.col("zeros")) + 1).cast("double").alias("cut"))
    at = both.join(cut, F.col("r") >= F.col("cut")).agg(F.min_by(F.struct(upto("a", F.col("cut")).alias("a"), upto("b", F.col("cut")).alias("b")), "r").alias("x")).select("x.a", "x.b")
    least = F.least("a", "b")
    return at.select(F.explode(F.array(F.struct(F.lit(a).alias("sample"), (least / F.col("a")).alias("factor")), F.struct(F.lit(b).alias("sample"), (least / F.col("b")).alias("factor")))).alias("z")).select("z.*")


def least_over(values: DataFrame, how: str = "avg", value: str = "value") -> DataFrame:
    """min(statistic) / statistic per sample."""
    stat = F.avg(value) if how == "avg" else F.percentile(value, 0.5)
    got = values.groupBy("sample").agg(stat.alias("stat"))
    return got.withColumn("factor", F.try_divide(F.min("stat").over(Window.partitionBy()), F.col("stat")))


def read_count_factors(kept: DataFrame) -> DataFrame:
    """min(kept) / kept per sample; null for a sample without kept reads."""
    return kept.select("sample", F.try_divide(F.min("kept").over(Window.partitionBy()), F.col("kept")).alias("factor"))


def length_stats(lengths: DataFrame, value: str = "length") -> DataFrame:
    """n, min, max, mean, population deviation, median, quartiles and MAD by sample."""
    q = F.percentile(value, F.array(*[F.lit(x) for x in (0.1, 0.25, 0.5, 0.75, 0.9)]))
    base = lengths.groupBy("sample").agg(F.count("*").alias("n"), F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), q.alias("q"))
    mad = lengths.join((base.select("sample", F.col("q")[2].alias("_m"))), "sample").groupBy("sample").agg(F.percentile(F.abs(F.col(value) - F.col("_m")), 0.5).alias("mad"))
    out = base.join(mad, "sample")
    return out.select("sample", "n", "min", "max", "mean", "std", *[F.col("q")[i].alias(k) for i, k in enumerate(("q10", "q25", "median", "q75", "q90"))], "mad")


def principal_components(values: DataFrame, keys: list[str], top: int = 1000, value: str = "value") -> tuple[list[str], np.ndarray, np.ndarray]:
    """Samples, components (rows) and eigenvalues of the `top` bins by variance (0: all), columns centred and scaled.

    The Gram matrix is aggregated in Spark; its size is the number of samples squared.
    """
    if top:
        var = values.groupBy(*keys).agg(F.var_samp(value).alias("_v")).orderBy(F.desc("_v"), *keys).limit(top).drop("_v")
        values = values.join(var, keys, "left_semi")
    of = values.groupBy("sample").agg(F.avg(value).alias("_m"), F.stddev_samp(value).alias("_s"))
    z = values.join(of, "sample").select(*keys, "sample", F.when(F.col("_s") > 0, (F.col(value) - F.col("_m")) / F.col("_s")).otherwise(0.0).alias("z"))
    gram = _pairs_of_samples(z, keys, "z").groupBy("a", "b").agg(F.sum(F.col("x") * F.col("y")).alias("g")).collect()
    names = sorted({r.a for r in gram})
    g = np.zeros((len(names), len(names)))
    for r in gram:
        g[names.index(r.a), names.index(r.b)] = g[names.index(r.b), names.index(r.a)] = r.g
    w, v = np.linalg.eigh(g)
    order = np.argsort(w)[::-1]
    return names, v[:, order].T, np.maximum(w[order], 0)


def poisson_tail(rate: float, p: float, upper: bool) -> int:
    """The smallest k with P(X > k) <= p (upper) or P(X <= k) >= p, in logarithms around the mode."""
    if rate <= 0:
        return 0
    wide = int(40 * math.sqrt(rate)) + 200
    low = max(0, int(rate) - wide)
    k = np.arange(low, int(rate) + wide + 1)
    mode = int(rate) - low
    steps = math.log(rate) - np.log(np.maximum(k, 1))  # log pmf(k) - log pmf(k - 1)
    logs = np.cumsum(np.r_[0.0, steps[1:]])
    logs += mode_log(rate) - logs[mode]
    mass = np.exp(logs)
    if upper:
        beyond = np.r_[np.cumsum(mass[::-1])[::-1][1:], 0.0]
        return int(k[np.flatnonzero(beyond <= p)[0]])
    found = np.flatnonzero(np.cumsum(mass) >= p)
    return int(k[found[0]] if len(found) else k[-1])


def mode_log(rate: float) -> float:
    m = int(rate)
    return m * math.log(rate) - rate - math.lgamma(m + 1)


def gc_ratio(table: DataFrame) -> DataFrame:
    """Adds r = f / n * sum(n) / sum(f) to a GC table (gc, f, n); 1 where f or n is 0."""
    every = Window.partitionBy()
    return table.withColumn("r", F.when((F.col("f") > 0) & (F.col("n") > 0), F.col("f") / F.col("n") * F.sum("n").over(every) / F.sum("f").over(every)).otherwise(1.0))


def gc_fraction(seq: Column) -> Column:
    """(G + C) / length; null if fewer than 95 % of the letters are A, C, G or T."""
    up = F.upper(seq)
    known, gc = F.length(F.regexp_replace(up, "[^ACGT]", "")), F.length(F.regexp_replace(up, "[^GC]", ""))
    return F.when(known >= 0.95 * F.length(up), F.try_divide(gc, F.length(up)))


#: Coverage beyond it counts as it.
MAX_COVERAGE = 9_999_999


def jensen_shannon(a: DataFrame, b: DataFrame) -> float:
    """Distance of two coverage histograms (v, n): signal over bins, at 100,000 even steps; bins without reads left out before.

    Finished in numpy from the distinct whole coverages (at most MAX_COVERAGE rows).
    """

    def curve(h: DataFrame) -> np.ndarray:
        t = h.groupBy(F.least(F.floor("v"), F.lit(MAX_COVERAGE)).cast("long").alias("v")).agg(F.sum("n").alias("n")).toPandas().sort_values("v")
        n, s = np.cumsum(t["n"].to_numpy(float)), np.cumsum((t["n"] * t["v"]).to_numpy(float))
        return np.diff(np.interp(np.linspace(0, 1, 100_001), np.r_[0, n / n[-1]], np.r_[0, s / s[-1]]))

    p, q = curve(a), curve(b)
    m = (p + q) / 2

    def entropy(x: np.ndarray) -> float:
        ok = x > 0
        return float((x[ok] * np.log2(x[ok] / m[ok])).sum())

    return round(math.sqrt(max(0.0, (entropy(p) + entropy(q)) / 2)), 15)


def poisson_expected(mean: float) -> tuple[float, float, float]:
    """AUC, x-intercept and elbow of the fingerprint that Poisson coverage of this mean would have."""
    top = poisson_tail(mean, 1 - 5e-6, False)
    k = np.arange(top + 1)
    pmf = np.exp(k * math.log(mean) - mean - np.array([math.lgamma(x + 1) for x in k]))
    bins, signal = np.cumsum(pmf), np.cumsum(pmf * k)
    signal /= signal[-1]
    return float((pmf * signal).sum()), float(bins[np.flatnonzero(signal)[0]]), float(bins[np.argmax(bins - signal)])


def synthetic_jsd(h: DataFrame) -> float:
    """Distance of a coverage histogram (v, n) to Poisson coverage of its mean; bins without reads are left out.

    The Poisson side has the expected numbers of bins with 1, 2, ... reads at the coverages 0, 1, ...
    """
    r = h.agg(F.sum("n"), F.sum(F.col("v") * F.col("n"))).first()
    mean = r[1] / r[0]
    k = np.arange(1, max(2, poisson_tail(mean, 1 - 1e-12, False)) + 1)
    mass = np.exp(k * math.log(mean) - mean - np.array([math.lgamma(x + 1) for x in k]))
    rows = [(float(x - 1), float(r[1] * y)) for x, y in zip(k.tolist(), mass.tolist(), strict=True)]
    return jensen_shannon(h.where("v > 0"), h.sparkSession.createDataFrame(rows, "v double, n double"))


def chance(values: DataFrame, keys: list[str], treated: str, control: str, value: str = "value") -> DataFrame:
    """(percent, difference, divergence) of a treated sample against its control.

    Bins are taken in order of the treated value, bins of equal value together (their order is undefined otherwise); so the
    curves have one point for each distinct value.  At the widest gap between the curves: percent of bins beyond it, the
    gap in percent, and the root of the binary divergence of both shares.  Without a gap all are 0.
    """
    wide = values.groupBy(*keys).agg(*[F.coalesce(F.max(F.when(F.col("sample") == s, F.col(value))), F.lit(0.0)).alias(c) for s, c in ((treated, "t"), (control, "c"))])
    points = wide.groupBy("t").agg(F.count("*").alias("n"), F.sum("c").alias("c"))
    w = Window.orderBy("t").rowsBetween(Window.unboundedPreceding, 0)  # distinct counts only
    every = Window.partitionBy()
    curve = points.select("t", F.sum("n").over(w).alias("upto"), F.sum("n").over(every).alias("all"), (F.sum(F.col("t") * F.col("n")).over(w) / F.sum(F.col("t") * F.col("n")).over(every)).alias("p"), (F.sum("c").over(w) / F.sum("c").over(every)).alias("q"))
    best = curve.agg(F.max(F.struct((F.col("q") - F.col("p")).alias("gap"), (-F.col("t")).alias("t"), "upto", "all", "p", "q")).alias("b")).select("b.*")

    def entropy(x: Column, m: Column) -> Column:
        return F.when(x > 0, x * F.log2(x / m)).otherwise(0.0) + F.when(x < 1, (1 - x) * F.log2((1 - x) / (1 - m))).otherwise(0.0)

    m = (F.col("p") + F.col("q")) / 2
    div = F.sqrt(F.greatest(F.lit(0.0), (entropy(F.col("p"), m) + entropy(F.col("q"), m)) / 2))
    ok = F.col("gap") >= 1e-6
    return best.select(*[F.when(ok, x).otherwise(0.0).alias(c) for c, x in (("percent", 100.0 * (F.col("all") - F.col("upto") + 1) / F.col("all")), ("difference", 100.0 * F.col("gap")), ("divergence", div))])
