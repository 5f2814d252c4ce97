"""Grouping of matrix rows and of samples.  Ward linkage needs all distances at once, so its input is bounded and checked; silhouettes need them too, but tile by tile."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that Ward linkage takes (a distance matrix of 128 MB), and rows (about) of a part of which a task compares two for silhouettes.
MAX_LINKED = 4000
SILHOUETTE_ROWS = 8192


def _bounded(m: DataFrame, most: int) -> tuple[list, np.ndarray]:
    rows = m.select("region", F.transform("bins", lambda x: F.coalesce(x, F.lit(0.0))).alias("bins")).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows: use k-means")
    rows.sort(key=lambda r: r.region)
    return [r.region for r in rows], np.array([r.bins for r in rows], float).reshape(len(rows), -1)


def ward(x: np.ndarray, k: int) -> np.ndarray:
    """Cluster numbers 0.. of Ward linkage cut at k clusters, by chains of nearest neighbours."""
    n = len(x)
    size, centre = np.ones(n), x.copy()
    alive = np.ones(n, bool)
    merges: list[tuple[float, int, int]] = []
    chain: list[int] = []
    while len(merges) < n - 1:
        if not chain:
            chain.append(int(np.argmax(alive)))
        i = chain[-1]
        cost = ((centre - centre[i]) ** 2).sum(1) * size * size[i] / (size + size[i])
        cost[~alive] = np.inf
        cost[i] = np.inf
        j = int(np.argmin(cost))
        if len(chain) > 1 and cost[chain[-2]] <= cost[j]:
            j = chain[-2]
            chain = chain[:-2]
            centre[j] = (centre[i] * size[i] + centre[j] * size[j]) / (size[i] + size[j])
            size[j] += size[i]
            alive[i] = False
            merges.append((float(cost[j]), i, j))
        else:
            chain.append(j)
    root = np.arange(n)
    for _, i, j in sorted(merges, key=lambda m: m[0])[: max(0, n - k)]:
        a, b = root[i], root[j]
        root[root == a] = b
    return np.unique(root, return_inverse=True)[1]


def by_mean(labels: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Clusters renumbered from 1 by descending mean."""
    means = [x[labels == c].mean() for c in range(labels.max() + 1)] if len(x) else []
    rank = np.empty(len(means), int)
    rank[np.argsort(-np.array(means), kind="stable")] = np.arange(1, len(means) + 1)
    return rank[labels]


def hierarchical(m: DataFrame, k: int) -> DataFrame:
    """(region, cluster) of at most MAX_LINKED rows; missing bins count as 0."""
    ids, x = _bounded(m, MAX_LINKED)
    labels = by_mean(ward(x, k), x) if ids else []
    return m.sparkSession.createDataFrame([(int(i), int(c)) for i, c in zip(ids, labels, strict=True)], "region long, cluster int")


def silhouettes(m: DataFrame) -> DataFrame:
    """(region, cluster, silhouette) from columns region, cluster, bins; a row alone in its cluster gets 0.  A region names one row.

    Rows are dealt into parts, and each pair of parts is one group that adds up the distances of its rows by cluster.  All
    distances are taken, so time grows with the square of the rows; a task holds two parts, however many there are.
    """
    counts = {r.cluster: r["count"] for r in m.groupBy(F.col("cluster").cast("int").alias("cluster")).count().collect()}
    kinds, n = sorted(counts), sum(counts.values())
    parts = max(1, -(-n // SILHOUETTE_ROWS))

    def compared(t: pa.Table) -> pa.Table:
        mine = t["_part"].to_numpy() == t["_i"].to_numpy()
        x = np.array(t["_x"].to_pylist(), float).reshape(len(t), -1)
        x -= x.mean(0)
        member = (t["cluster"].to_numpy()[:, None] == np.array(kinds)).astype(float)
        left, right = np.flatnonzero(mine), np.flatnonzero(~mine)
        same = not len(right) and t["_i"][0].as_py() == t["_j"][0].as_py()
        right = left if same else right
        y, length = x[right], (x * x).sum(1)
        sums = np.zeros(member.shape)
        step = max(1, 2**21 // max(1, len(right)))
        for k in range(0, len(left), step):
            rows = left[k : k + step]
            far = length[rows][:, None] + length[right]
            d = far - 2 * (x[rows] @ y.T)
            near = np.argwhere(d <= 1e-7 * far)  # too close for the difference of large numbers
            for q in range(0, len(near), 65_536):
                a, b = near[q : q + 65_536].T
                d[a, b] = ((x[rows[a]] - y[b]) ** 2).sum(1)
            d = np.sqrt(d)
            sums[rows] += d @ member[right]
            if not same:
                sums[right] += d.T @ member[rows]
        return pa.table([t["region"], t["cluster"], *map(pa.array, sums.T)], names=["region", "cluster", *[f"s{i}" for i in range(len(kinds))]])

    rows = m.select(F.col("region").cast("long").alias("region"), F.col("cluster").cast("int").alias("cluster"), F.transform("bins", lambda v: F.coalesce(v, F.lit(0.0))).alias("_x"))
    rows = rows.withColumn("_part", F.pmod(F.xxhash64("region"), F.lit(parts)).cast("int"))
    low, high = (f(F.col("_part"), F.col("_o")) for f in (F.least, F.greatest))
    dealt = rows.withColumn("_o", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).select("region", "cluster", "_x", "_part", low.alias("_i"), high.alias("_j"))
    names = [f"s{i}" for i in range(len(kinds))]
    got = dealt.groupBy("_i", "_j").applyInArrow(compared, "region long, cluster int" + "".join(f", {c} double" for c in names))
    if len(kinds) < 2:
        return rows.select("region", "cluster", F.lit(0.0).alias("silhouette"))
    got = got.groupBy("region", "cluster").agg(*[F.sum(c).alias(c) for c in names])
    own = F.coalesce(*[F.when(F.col("cluster") == k, F.col(c) / (counts[k] - 1)) for k, c in zip(kinds, names, strict=True) if counts[k] > 1], F.lit(None).cast("double"))
    other = F.array_min(F.array(*[F.when(F.col("cluster") != k, F.col(c) / counts[k]) for k, c in zip(kinds, names, strict=True)]))
    most = F.greatest(own, other)
    return got.select("region", "cluster", F.when(own.isNotNull() & (most > 0), (other - own) / most).otherwise(0.0).alias("silhouette"))


def bin_density(m: DataFrame, levels: int) -> DataFrame:
    """(group, bin, level, n): how many rows of a group have each level of value (1 to `levels`, of the whole range) in a bin."""
    long = m.select("group", F.posexplode("bins").alias("bin", "v")).where("v is not null")
    ends = long.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    level = F.least(F.lit(levels), F.floor(F.try_divide((F.col("v") - F.col("lo")) * levels, F.col("hi") - F.col("lo"))) + 1)
    return long.join(F.broadcast(ends)).withColumn("level", F.coalesce(level, F.lit(1)).cast("long")).groupBy("group", "bin", "level").agg(F.count("*").alias("n"))
