"""Reads against a sequence: the registered queries against their SQL, and edges on small rows."""

import duckdb
import pytest

from strandlake.operators import gc
from strandlake.plans import gc_reads, registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["a17_gc_tabulation", "a19_reads_per_gc_region", "p15_read_gc", "f12_fetch_limits"])
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("lineitem", "documents", "orders", "supplier"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    cur = con.execute(registry.oracle_sql()[name])
    cols = [c[0] for c in cur.description]
    got = registry.queries()[name](spark, SF)
    assert sorted(cols) == sorted(got.columns)
    key = lambda r: tuple((x is None, x or 0) for x in r)
    want = sorted(cur.fetchall(), key=key)
    assert want and sorted((tuple(r) for r in got.select(cols).collect()), key=key) == want


def test_windows_cross_tiles(spark):
    seq = "ACGTN" * 3 + "GGcc" + "ACGT" * 20
    t = gc.tiles(spark.createDataFrame([("c", seq), ("short", "AC"), ("none", None), ("empty", "")], "chrom string, seq string"), 20)
    got = {(r.chrom, r.start): r.gc for r in gc.gc_windows(t, 20, 3, 20).collect()}
    part = lambda i: seq.upper()[i : i + 20]
    assert got == {("c", i): part(i).count("G") + part(i).count("C") for i in range(0, len(seq) - 19, 3) if part(i).count("N") <= 1}


def test_limits(spark):
    r = spark.createDataFrame([(1, "c", 100, 120), (2, "c", 5, 9), (3, "c", 40, 60), (1, "c", 100, 120)], "region int, chrom string, start long, end long")
    b = spark.createDataFrame([("c", 80, 90), ("c", 130, 140), ("c", 50, 55)], "chrom string, start long, end long")
    assert sorted(map(tuple, gc.fetch_limits(r, b, 30).collect())) == [(1, "c", 100, 120, 90, 130), (2, "c", 5, 9, 0, 39)]


def test_letters():
    assert len(gc_reads.LETTERS) == len(gc_reads.BASES) == 53
