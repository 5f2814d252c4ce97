"""Blocks, names, GC limits and clusters on values that are known or plainly computed."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake.functions import blocks as bl
from strandlake.functions import names as nm
from strandlake.operators import cluster as cl
from strandlake.operators import gc, qc
from strandlake.operators import matrix as mx
from strandlake.sources import text

EXONS = [(0, 200), (300, 400), (800, 900)]


def _blocks(spark):
    return spark.createDataFrame([(EXONS,)], "b array<struct<start:bigint,end:bigint>>")


def _get(df, **cols):
    r = df.select(*[c.alias(k) for k, c in cols.items()]).first()
    return {k: [tuple(x) for x in v] if isinstance(v := r[k], list) else v for k in cols}


def test_chop(spark):
    b = F.col("b")
    assert _get(_blocks(spark), **bl.chop(b, 250, 50)) == {"left": [(0, 200), (300, 350)], "body": [(350, 400), (800, 850)], "right": [(850, 900)], "pad_left": 0, "pad_right": 0}
    assert _get(_blocks(spark), **bl.chop(b, 350, 100)) == {"left": [(0, 200), (300, 400), (800, 850)], "body": [], "right": [(850, 900)], "pad_left": 0, "pad_right": 50}
    assert _get(_blocks(spark), **bl.chop_middle(b, 250, 150)) == {"left": [(0, 200)], "right": [(300, 400), (800, 850)], "pad_left": 50, "pad_right": 0}


def test_offsets(spark):
    b = F.col("b")
    base = [x for s, e in EXONS for x in range(s, e)]
    for rev in (False, True):
        axis = base[::-1] if rev else base
        for first, last in [(1, None), (-1, None), (5, 10), (-201, -1), (150, 260), (390, 500), (500, None), (-500, None)]:
            got = [x for s, e in _get(_blocks(spark), b=bl.offsets(b, F.lit(rev), first, last))["b"] for x in range(s, e)]
            place = lambda o: o - 1 if o > 0 else len(axis) + o
            a, z = place(first), place(last if last is not None else first)
            assert got == sorted(axis[i] for i in range(max(a, 0), min(z + 1, len(axis))))
    with pytest.raises(ValueError):
        bl.offsets(b, F.lit(False), 0)


def test_names(spark):
    t = spark.createDataFrame([("/a/b.c.bam",), ("x",), (".bam",), (None,)], "p string")
    assert [r[0] for r in t.select(nm.smart_label(F.col("p"))).collect()] == ["b.c", "x", ".bam", None]
    c = spark.createDataFrame([("MT",), ("1",), ("chr2",)], "c string")
    assert [tuple(r) for r in c.select(nm.with_chr(F.col("c")), nm.without_chr(F.col("c"))).collect()] == [("chrM", "MT"), ("chr1", "1"), ("chr2", "2")]
    assert nm.scale_factors("1:0.5:2") == [1.0, 0.5, 2.0]
    assert [nm.axis_label(x) for x in (0, -3000, 200_000)] == ["0", "-3.0Kb", "0.2Mb"]


def test_limits_and_expected_curve():
    assert gc.binomial_limit(10, 0.5, 0.2) == 6  # P(X > 6) = 0.171875, P(X > 5) = 0.376953
    assert gc.binomial_limit(3, 1.0) == 3
    auc, first, elbow = qc.poisson_expected(4.0)
    assert abs(first - 5 * np.exp(-4)) < 1e-9 and 0 < auc < 0.5 and 0.43 < elbow < 0.63


def test_ward_and_silhouettes(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(c, 0.1, (8, 2)) for c in (0, 5, 9)])
    labels = cl.by_mean(cl.ward(x, 3), x)
    assert [set(labels[i : i + 8]) for i in (0, 8, 16)] == [{3}, {2}, {1}]
    m = spark.createDataFrame([(i, int(c), [float(v) for v in r]) for i, (c, r) in enumerate(zip(labels, x, strict=True))], "region long, cluster int, bins array<double>")
    got = {r.region: r.silhouette for r in cl.silhouettes(m).collect()}
    dist = np.sqrt(((x[:, None] - x) ** 2).sum(2))
    for i, s in got.items():
        inside = dist[i][(labels == labels[i])].sum() / 7
        outside = min(dist[i][labels == c].mean() for c in (1, 2, 3) if c != labels[i])
        assert abs(s - (outside - inside) / max(inside, outside)) < 1e-9
    assert {r.region: r.cluster for r in cl.hierarchical(m, 3).collect()} == {i: int(c) for i, c in enumerate(labels)}


def _regions(spark):
    rows = [("g", 2, "c", 10, 40, "b", 1.0, "-", [(10, 20), (30, 40)], [None, 2.5]), ("g", 1, "c", 5, 9, "a", None, "+", None, [1.0, 0.0])]
    return spark.createDataFrame(rows, "group string, region long, chrom string, start long, end long, name string, score double, strand string, exons array<struct<start:bigint,end:bigint>>, bins array<double>")


def test_matrix_file_round_trip(spark, tmp_path):
    p = str(tmp_path / "m")
    text.write_matrix(_regions(spark), {"bin size": [10]}, p)
    assert text.read_matrix_header(spark, p) == {"bin size": [10]}
    assert [(r.name, r.strand, r.bins) for r in text.read_matrix(spark, p).collect()] == [("a", "+", [1.0, 0.0]), ("b", "-", [None, 2.5])]


def test_region_and_profile_files(spark, tmp_path):
    r = _regions(spark)
    text.write_bed12(r, str(tmp_path / "bed"))
    lines = sorted(x.value for x in spark.read.text(str(tmp_path / "bed")).collect())
    assert lines == ["c\t10\t40\tb\t1.0\t-\t10\t40\t0\t2\t10,10\t0,20\tg", "c\t5\t9\ta\t.\t+\t5\t9\t0\t1\t4\t0\tg"]
    text.write_profile(mx.profile(r.select("group", "region", "bins")), str(tmp_path / "profile"))
    assert [x.value for x in spark.read.text(str(tmp_path / "profile")).collect()] == ["g\t1.0\t1.25"]
    text.split_by_group(r.select("group", "chrom", "start", "end"), str(tmp_path / "split"))
    assert spark.read.csv(str(tmp_path / "split" / "group=g"), sep="\t").count() == 2
