"""Steps whose work must not grow with the product of their inputs, against plain loops."""

import math
import random
import time

import numpy as np
import pytest

from strandlake.functions import intervals as iv
from strandlake.operators import cluster as cl
from strandlake.operators import coverage as cv
from strandlake.operators import gc
from strandlake.operators import matrix as mx
from strandlake.plans import adapters, registry

SPANS = "sample string, chrom string, start long, end long"


def _spans(n, seed, far=200_000, longest=400):
    r = random.Random(seed)
    out = []
    for _ in range(n):
        a = r.choice([r.randrange(-300, far), iv.COUNT_RANGE - r.randrange(3)])
        out.append((r.choice(["F", "O", None]), r.choice(["A", "B", None]), a, a + r.randrange(longest)))
    return out


def test_count_overlaps(spark):
    reads, regs = _spans(300, 1), [(i, *x[1:]) for i, x in enumerate(_spans(200, 2))]
    got = cv.region_counts(spark.createDataFrame(reads, SPANS), spark.createDataFrame(regs, "region int, chrom string, start long, end long"))
    want = {}
    for s, c, a, z in reads:
        for i, rc, ra, rz in regs:
            if c and c == rc and a < z and ra < rz and a < rz and z > ra:
                want[s, i] = want.get((s, i), 0) + 1
    assert want and {(r["sample"], r.region): r.n for r in got.collect()} == want


def test_region_counts_of_many_pairs(spark):
    """4 * 10 ** 10 pairs: only counts by position can give them."""
    n = 200_000
    reads = spark.range(n).selectExpr("'F' AS sample", "'A' AS chrom", "id % 50 AS start", "id % 50 + 100 AS end")
    regs = spark.range(n).selectExpr("id AS region", "'A' AS chrom", "id % 40 AS start", "id % 40 + 200 AS end")
    began = time.time()
    r = cv.region_counts(reads, regs).selectExpr("count(*) AS k", "min(n) AS lo", "max(n) AS hi").first()
    assert tuple(r) == (n, n, n) and time.time() - began < 60


@pytest.mark.parametrize("zero", [False, True])
def test_bin_statistics(spark, zero):
    """Bins over tile borders, copies of bins, overlapping, missing and not-a-number values."""
    r, t = random.Random(5), cv.SIGNAL_TILE
    zones = [(f"g{i % 2}", i // 3, "A" if i % 5 else "B", i % 3, a, a + r.choice([0, 1, 7, 50, 3 * t])) for i, a in enumerate(r.choice([t - 9, 0, -20, 2 * t - 1, r.randrange(3 * t)]) for _ in range(120))]
    sig = [("A", a, a + r.choice([1, 20, 400]), r.choice([None, 0.1, -2.5, 7.0, 1e3])) for a in (r.choice([t - 3, r.randrange(-30, 4 * t)]) for _ in range(250))] + [("B", 0, 3, math.nan)] * (not zero)
    stats = ("mean", "sum", "min", "max", "std", "median")
    x = mx.bin_statistics(spark.createDataFrame(zones, "group string, region int, chrom string, bin int, start long, end long"), spark.createDataFrame(sig, "chrom string, start long, end long, value double"), stats, zero)
    got = {(g, k, b): v for g, k, b, *v in x.collect()}
    assert len(got) == len(zones)
    for g, k, c, b, a, z in zones:
        met = [(min(z, e) - max(a, s), v) for sc, s, e, v in sig if sc == c and s < z and e > a and z > a]
        w, known = sum(n for n, _ in met), [(n, v) for n, v in met if v is not None]
        n, mean, total, lo, hi, *_ = (z - a if zero else w), *got[g, k, b]
        if not known:
            assert (total, lo, hi) == ((0.0, 0.0, 0.0) if zero else (None, None, None))
            continue
        gap = zero and w < z - a
        up = lambda v: (math.isnan(v), v)
        want = [sum(n * v for n, v in known), min([v for _, v in known] + [0.0] * gap, key=up), max([v for _, v in known] + [0.0] * gap, key=up)]
        assert [mean, total, lo, hi] == pytest.approx([want[0] / n, *want], nan_ok=True)


def test_statistics_of_many_pairs(spark):
    """A million equal bins on a dense signal: each distinct bin is summed up once."""
    zones = spark.range(1_000_000).selectExpr("'g' AS group", "id AS region", "'A' AS chrom", "0 AS bin", "id % 1000 AS start", "id % 1000 + 1000 AS end")
    sig = spark.range(2000).selectExpr("'A' AS chrom", "id AS start", "id + 1 AS end", "1.0D AS value")
    began = time.time()
    r = mx.bin_statistics(zones, sig, ("sum", "max")).selectExpr("count(*) AS k", "min(sum) AS lo", "max(sum) AS hi").first()
    assert tuple(r) == (1_000_000, 1000.0, 1000.0) and time.time() - began < 60


def test_covered_bases_join_no_reads_by_chromosome(spark):
    """Reads of a chromosome never meet in one task: sizes are joined to sums, by broadcast."""
    reads = spark.createDataFrame([("F", "A", 5, 25), ("F", "A", 28, 33), ("F", "B", 0, 5)], SPANS)
    x = cv.covered_bases(reads, 10, spark.createDataFrame([("A", 30)], "chrom string, size long"))
    assert sorted(map(tuple, x.collect())) == [("F", "A", 0, 5), ("F", "A", 10, 10), ("F", "A", 20, 7)]
    plan = x._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_reads_per_window_of_many_pairs(spark):
    """4 * 10 ** 8 pairs on one short chromosome."""
    n = 1_000_000
    reads = spark.range(n).selectExpr("1L AS chrom", "id % 10 AS pos", "id % 10 + 9000 AS end")
    windows = spark.range(400).selectExpr("1L AS chrom", "id * 25 AS start", "50L AS gc")
    plan = gc.reads_per_window(windows, reads, 100)
    assert {(r.reads, r.gc) for r in plan.where("start < 8900").collect()} == {(n, 0.5)}
    assert plan.where("start >= 9025").selectExpr("max(reads)").first()[0] == 0
    assert "_lb" not in plan._jdf.queryExecution().optimizedPlan().toString()  # no pairs by bucket


def test_enrichment_needs_no_distinct_reads(spark):
    """A read that meets several islands of a feature counts once, equal reads count each; no shuffle of pairs by read."""
    reads = [x for x in _spans(300, 7, 3000) if x[0]] * 2
    feats = [(c, a, z, f) for (_, c, a, z), f in zip(_spans(60, 8, 3000, 30), "xyz" * 20, strict=True)]
    x = cv.enrichment(spark.createDataFrame(reads, SPANS), spark.createDataFrame(feats, "chrom string, start long, end long, feature string"))
    want = {}
    for s, c, a, z in reads:
        for f in {f for fc, fa, fz, f in feats if c and c == fc and a < z and fa < fz and a < fz and z > fa}:
            want[s, f] = want.get((s, f), 0) + 1
    assert want and {(r["sample"], r.feature): r.hits for r in x.collect()} == want
    assert "_id" not in x._jdf.queryExecution().optimizedPlan().toString()


def test_silhouettes_of_several_parts(spark, monkeypatch):
    """No limit of rows: parts are compared pair by pair, against all distances at once."""
    monkeypatch.setattr(cl, "SILHOUETTE_ROWS", 16)
    r = np.random.default_rng(3)
    x = np.round(r.normal(size=(90, 4)), 2) + 1000
    x[50:60] = x[40]
    labels = [1 + i % 3 for i in range(89)] + [9]
    m = spark.createDataFrame([(i, c, v.tolist()) for i, (c, v) in enumerate(zip(labels, x, strict=True))], "region long, cluster int, bins array<double>")
    d, k = np.sqrt(((x[:, None] - x) ** 2).sum(2)), np.array(labels)
    want = {}
    for i, c in enumerate(labels):
        a, b = d[i, k == c].sum() / max(1, (k == c).sum() - 1), min(d[i, k == o].mean() for o in {1, 2, 3, 9} - {c})
        want[i] = (b - a) / max(a, b) if (k == c).sum() > 1 else 0.0
    assert {s.region: s.silhouette for s in cl.silhouettes(m).collect()} == pytest.approx(want, abs=1e-9)


def test_mate_decisions_do_not_depend_on_the_order_of_rows(spark, monkeypatch):
    for rows in (ties := [("F", 8, 5, 0), ("F", 8, 5, 9), ("F", 9, 7, 9)], ties[::-1]):
        monkeypatch.setattr(adapters, "alignments", lambda *_, x=rows: spark.createDataFrame(x, "sample string, read_id long, pos long, mapq int").coalesce(1))
        assert [tuple(r) for r in registry.queries()["j12_w8_mate_decisions"](spark, "").collect()] == [("F", 3, 0, 2)]
