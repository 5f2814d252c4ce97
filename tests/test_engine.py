"""Known values on small alignments and tracks."""

import pytest
from pyspark.sql import functions as F

from strandlake.functions import intervals as iv
from strandlake.functions import reads as rd
from strandlake.operators import coverage as cv
from strandlake.operators import matrix as mx
from strandlake.operators import qc
from strandlake.sources import text

SAM = "@SQ\tSN:3R\tLN:200\n" + "".join(f"r{i}\t{flag}\t3R\t{pos + 1}\t{q}\t50M\t*\t0\t0\t{'A' * 50}\t*\n" for i, (flag, pos, q) in enumerate([(16, 50, 10), (0, 100, 20), (0, 150, 30), (0, 150, 40)]))


def _sam(spark, tmp_path):
    p = tmp_path / "b.sam"
    p.write_text(SAM)
    return text.read_sam(spark, str(p), "b")


def test_bins_duplicates_and_sizes(spark, tmp_path):
    a = _sam(spark, tmp_path)
    n = {r.start: r.n for r in cv.count_in_bins(a.select("sample", "chrom", "blocks"), 50).collect()}
    assert [n.get(s, 0) for s in (0, 50, 100, 150)] == [0, 1, 1, 2]
    once = rd.drop_duplicates(rd.filter_reads(a))
    assert once.count() == 3
    assert text.sam_sizes(spark, str(tmp_path / "b.sam")).first().size == 200


def test_spliced_read_counts_once_a_bin(spark):
    a = spark.createDataFrame([("s", "c", 10, "10S20M10N10M10S")], "sample string, chrom string, pos long, cigar string").withColumn("blocks", rd.aligned_blocks())
    assert [tuple(b) for b in a.first().blocks] == [(10, 30), (40, 50)]
    n = {r.start: r.n for r in cv.count_in_bins(a, 10).collect()}
    assert n == {10: 1, 20: 1, 40: 1}


def test_extension_runs_and_smoothing(spark, tmp_path):
    a = _sam(spark, tmp_path)
    s, e = rd.fragment(extend=100)
    f = a.select("sample", "chrom", s.alias("start"), F.least(e, F.lit(200)).alias("end"))
    n = {r.start: r.n for r in cv.count_in_bins(f, 50).collect()}
    assert [n.get(x, 0) for x in (0, 50, 100, 150)] == [1, 1, 1, 3]
    bins = spark.createDataFrame([("b", "3R", x, x + 50, float(v)) for x, v in ((0, 1), (50, 1), (100, 1), (150, 3))], "sample string, chrom string, start long, end long, value double")
    assert sorted((r.start, r.end, r.value) for r in iv.run_lengths(bins, ["sample", "chrom"]).collect()) == [(0, 150, 1.0), (150, 200, 3.0)]
    twenty = spark.createDataFrame([("b", "3R", x, x + 20, float(v)) for x, v in ((100, 1), (120, 1), (140, 1), (160, 2), (180, 2))], "sample string, chrom string, start long, end long, value double")
    assert [round(r.value, 5) for r in iv.smooth(twenty, ["sample", "chrom"], 60, 20).orderBy("start").collect()] == [1.0, 1.0, 1.33333, 1.66667, 2.0]


def test_compare(spark):
    t = spark.createDataFrame([(0.0, 0.0), (0.0, 1.0), (1.0, 1.0), (1.0, 2.0), (1.0, 0.0), (None, 1.0)], "a double, b double")
    got = [r[0] for r in t.select(cv.compare("log2", F.col("a"), F.col("b"), pseudo=(1.0, 0.0)).alias("x")).collect()]
    assert got[0] == float("inf") and got[1:4] == [0.0, 1.0, 0.0] and got[5] is None
    assert [r[0] for r in t.select(cv.compare("subtract", F.col("a"), F.col("b"))).collect()][:4] == [0.0, -1.0, 0.0, -1.0]


def test_size_factors(spark):
    rows = [("a", i, float(v)) for i, v in enumerate((0, 0, 1, 1))] + [("b", i, float(v)) for i, v in enumerate((0, 1, 1, 2))]
    got = {r["sample"]: round(r.factor, 4) for r in qc.size_factors(spark.createDataFrame(rows, "sample string, start int, value double"), ["start"]).collect()}
    assert got == {"a": 1.1892, "b": 0.8409}


def test_region_means_and_joins(spark):
    sig = spark.createDataFrame([("3R", 50, 150, 1.0), ("3R", 150, 200, 2.0)], "chrom string, start long, end long, value double")
    regs = spark.createDataFrame([(i, "3R", 50 * i, 50 * i + 50) for i in range(4)], "region int, chrom string, start long, end long")
    got = {r.region: r["mean"] for r in cv.region_means(sig, regs).collect()}
    assert got == {0: None, 1: 1.0, 2: 1.0, 3: 2.0}
    assert iv.overlap_join(regs, sig, "anti", bucket=30).count() == 1
    assert iv.overlap_join(regs, sig, "left", bucket=30).count() == 4


def test_blacklist_moves_bins(spark):
    sizes = spark.createDataFrame([("c", 100)], "chrom string, size long")
    black = spark.createDataFrame([("c", 20, 30), ("c", 25, 35)], "chrom string, start long, end long")
    segments = iv.complement(sizes, black)
    assert [(r.start, r.end) for r in segments.orderBy("start").collect()] == [(0, 20), (35, 100)]
    assert [(r.start, r.end) for r in iv.bin_domain(segments, 30).orderBy("start").collect()] == [(0, 20), (35, 65), (65, 95), (95, 100)]


def test_matrix_strand_and_text(spark, tmp_path):
    regs = spark.createDataFrame([("g", 1, "c", 10, 20, "+"), ("g", 2, "c", 10, 20, "-")], "group string, region int, chrom string, start long, end long, strand string")
    sig = spark.createDataFrame([("c", 0, 10, 1.0), ("c", 10, 30, 3.0)], "chrom string, start long, end long, value double")
    m = mx.to_rows(mx.bin_values(mx.zones_reference_point(regs, 10, 10, 5), sig))
    got = {r.region: r.bins for r in m.collect()}
    assert got == {1: [1.0, 1.0, 3.0, 3.0], 2: [3.0, 3.0, 3.0, 3.0]}
    p = tmp_path / "x.bg"
    p.write_text("\nc\t0\t10\t1\nc\t10\t30\t3\n")
    assert text.read_bedgraph(spark, str(p)).count() == 2
    b = tmp_path / "x.bed"
    b.write_text("c\t0\t10\n#one\nc\t5\t9\tn\t1\t-\n")
    assert {(r.group, r.strand) for r in text.read_bed(spark, str(b)).collect()} == {("one", "."), ("genes", "-")}


def test_scaled_regions_keep_short_ones(spark):
    """Under one bin: a row of missing values (or zeros); fewer bases than bins: bins of one base."""
    regs = spark.createDataFrame([("g", k, "c", 100, 100 + n, s) for k, (n, s) in enumerate([(0, "+"), (3, "-"), (7, "+"), (7, "-"), (20, "+")])], "group string, region int, chrom string, start long, end long, strand string")
    sig = spark.createDataFrame([("c", k, k + 1, float(k)) for k in range(80, 140)], "chrom string, start long, end long, value double")
    z = mx.zones_scaled(regs, 50, 5, 10, 5)
    got = {r.region: r.bins for r in mx.to_rows(mx.bin_values(z, sig)).collect()}
    body = [100.0 + k * 7 // 10 for k in range(10)]
    assert got[0] == got[1] == [None] * 13
    assert got[2] == [97.0, *body, 109.0, 114.0]
    assert got[3] == [109.0, *body[::-1], 97.0, 92.0]
    assert got[4] == [97.0, *[100.5 + 2 * k for k in range(10)], 122.0, 127.0]
    zero = {r.region: r.bins for r in mx.to_rows(mx.bin_values(z, sig, zero_missing=True)).collect()}
    assert zero[0] == zero[1] == [0.0] * 13 and zero[2] == got[2]


def test_kept_reads_without_blacklisted_ones(spark, monkeypatch):
    from strandlake.plans import adapters, registry

    rows = [("F", "A", 10, 20, 0, 5), ("F", "A", 50, 60, 0, 1), ("O", "A", 50, 60, 0, 5), ("O", "A", 70, 80, 4, 5)]
    monkeypatch.setattr(adapters, "alignments", lambda *_: spark.createDataFrame(rows, "sample string, chrom string, pos long, end long, flag int, mapq int"))
    for black, want in (([("A", 5, 25)], {"F": (2, 1, 0.5), "O": (1, 0, 1.0)}), ([], {"F": (2, 0, 1.0), "O": (1, 0, 1.0)})):
        monkeypatch.setattr(adapters, "blacklist", lambda *_, b=black: spark.createDataFrame(b, "chrom string, start long, end long"))
        got = {r["sample"]: (r.mapped, r.blacklisted, r.kept) for r in registry.queries()["a7_a8_kept_reads"](spark, "").collect()}
        assert got == want


def test_common_chroms_and_read_count_factors(spark):
    from strandlake.plans import registry

    t = [spark.createDataFrame(x, "chrom string, size long") for x in ([("1", 9), ("2", 8), ("X", 7)], [("chr1", 9), ("chr2", 8), ("chrX", 6)], [("2", 8), ("1", 5)], [("Y", 9)])]
    assert {tuple(r) for r in iv.common_chroms(*t[:2]).collect()} == {("1", 9), ("2", 8)}
    assert {tuple(r) for r in iv.common_chroms(*t[:3]).collect()} == {("2", 8)}
    with pytest.raises(ValueError):
        iv.common_chroms(t[0], t[3])
    kept = spark.createDataFrame([("a", 50.0), ("b", 200.0)], "sample string, kept double")
    assert {r["sample"]: r.factor for r in qc.read_count_factors(kept).collect()} == {"a": 1.0, "b": 0.25}
    names = set(registry.queries())
    assert {"q4_read_count_factors", "j10_common_chroms"} <= names
    assert not {i for n in names for i in n.split("_")} & {"a17", "f9", "m2", "a11"}


def test_registry_matches(spark):
    from strandlake.plans import registry

    assert set(registry.oracle_sql()) <= set(registry.queries())


def test_bench_times_joins_and_matrices():
    import bench
    from strandlake.plans import registry

    assert set(bench.HEADLINE) <= set(registry.queries())
    assert {"j2_a2_region_counts", "j3_s6_region_means", "j4_a16_enrichment", "m1_m5_m6_scaled_regions", "m8_reference_point"} <= set(bench.HEADLINE)


def test_signal_extraction_by_sorted_sums(spark):
    """Against the steps on sorted arrays, for dense and sparse counts."""
    import numpy as np

    from strandlake.operators import qc

    rnd = np.random.default_rng(4)
    pairs = [(rnd.poisson(5, 2000), rnd.poisson(8, 2000) * (1 + 4 * (rnd.random(2000) < 0.05))), (rnd.poisson(0.2, 3000), rnd.poisson(0.05, 3000) * 3), (np.arange(50), np.arange(50) ** 2)]
    for x, y in pairs:
        p, q = (np.cumsum(np.sort(v)).astype(float) for v in (x, y))
        gap = np.abs(p / p[-1] - q / q[-1])
        at = int(np.flatnonzero(gap == gap.max())[0] * 0.8)
        while min(p[at], q[at]) == 0:
            at += 1
        want = {"A": min(p[at], q[at]) / p[at], "B": min(p[at], q[at]) / q[at]}
        rows = [("A", i, float(v)) for i, v in enumerate(x.tolist())] + [("B", i, float(v)) for i, v in enumerate(y.tolist())]
        got = {r.sample: r.factor for r in qc.ses_factors(spark.createDataFrame(rows, "sample string, start long, value double"), "A", "B").collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_jensen_shannon_of_signal_over_bins(spark):
    import numpy as np

    from strandlake.operators import qc

    rnd = np.random.default_rng(9)
    x, y = rnd.poisson(4, 5000), rnd.poisson(2, 5000) * 2

    def steps(v):
        n = np.bincount(v[v > 0])
        bins, signal = np.cumsum(n) / n.sum(), np.cumsum(n * np.arange(len(n))) / (n * np.arange(len(n))).sum()
        return np.diff(np.interp(np.arange(100_001) / 100_000, bins, signal))

    p, q = steps(x), steps(y)
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        want = np.sqrt((np.nansum(p * np.log2(p / m)) + np.nansum(q * np.log2(q / m))) / 2)
    h = [spark.createDataFrame([(float(k), int(n)) for k, n in enumerate(np.bincount(v)) if n and k], "v double, n long") for v in (x, y)]
    assert abs(qc.jensen_shannon(*h) - want) < 1e-9


def test_poisson_tails():
    from fractions import Fraction
    from math import factorial

    from strandlake.operators.qc import poisson_tail

    def plain(rate, p, upper):  # exact shares of e**rate
        terms = [Fraction(rate) ** k / factorial(k) for k in range(int(rate * 3) + 60)]
        total, below = sum(terms), Fraction(0)
        for k, t in enumerate(terms):
            below += t
            if (total - below <= p * total) if upper else (below >= p * total):
                return k

    for rate in (1, 7, 40):
        for p in (1e-6, 0.01, 0.5):
            assert poisson_tail(rate, p, True) == plain(rate, p, True) and poisson_tail(rate, p, False) == plain(rate, p, False)
    for rate in (800, 1600, 1e6):  # within six deviations of the rate, where exp(-rate) is 0
        assert rate < poisson_tail(rate, 1e-6, True) < rate + 6 * rate**0.5 and rate - 6 * rate**0.5 < poisson_tail(rate, 1e-6, False) < rate
    assert poisson_tail(0, 1e-6, True) == 0


def test_runs_across_ranges(spark):
    """Runs that cross the borders of ranges are whole; nulls end runs."""
    from strandlake.functions import intervals as iv

    size = iv.RUN_RANGE // 4
    values = [1, 1, 1, 1, 1, 2, 2, None, None, 2, 2, 2, 2, 3, 3]
    rows = [("s", i * size, (i + 1) * size, None if v is None else float(v)) for i, v in enumerate(values)] + [("t", 0, 10, 5.0)]
    got = sorted(tuple(r) for r in iv.run_lengths(spark.createDataFrame(rows, "sample string, start long, end long, value double"), ["sample"]).collect())
    assert got == [("s", 0, 5 * size, 1.0), ("s", 5 * size, 7 * size, 2.0), ("s", 9 * size, 13 * size, 2.0), ("s", 13 * size, 15 * size, 3.0), ("t", 0, 10, 5.0)]
