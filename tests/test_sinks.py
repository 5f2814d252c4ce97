"""Text sinks, and groups of GTF files."""

from strandlake.sources import text


def _lines(spark, path):
    return [r.value for r in spark.read.text(str(path)).collect()]


def test_matrix_values(spark, tmp_path):
    m = spark.createDataFrame([("b", 1, [1.0, 123456.0]), ("a", 2, [0.00001234567, None]), ("a", 1, [0.5, 2.0])], "group string, region int, bins array<double>")
    text.write_matrix_values(m, {"downstream": 10, "bin size": 5}, {"s": 1, "t": 1}, str(tmp_path / "v"))
    assert _lines(spark, tmp_path / "v") == ["#a:2\tb:1", "#downstream:10\tupstream:0\tbody:0\tbin size:5\tunscaled 5 prime:0\tunscaled 3 prime:0", "a:2\tb:1\ts\tt", "0.5\t2", "1.235e-05\tnan", "1\t1.235e+05"]


def test_sam_round_trip_and_bedpe(spark, tmp_path):
    rows = ["a\t99\tc\t11\t30\t5M\t=\t41\t35\tACGTN\t*", "b\t16\td\t1\t0\t3M4N2M\t*\t0\t0\tGGGTT\t*", "a\t147\tc\t41\t30\t5M\t=\t11\t-35\tACGTN\t*", "u\t4\t*\t0\t0\t*\t*\t0\t0\t*\t*"]
    (tmp_path / "x.sam").write_text("@SQ\tSN:c\tLN:90\n" + "\n".join(rows) + "\n")
    t = text.read_sam(spark, str(tmp_path / "x.sam"), "s")
    text.write_sam(t, text.sam_sizes(spark, str(tmp_path / "x.sam")), str(tmp_path / "out"))
    lines = _lines(spark, tmp_path / "out")
    assert sorted(lines) == sorted(["@SQ\tSN:c\tLN:90", *["\t".join([*r.split("\t")[:9], "*", "*"]) for r in rows]])
    text.write_bedpe(t, str(tmp_path / "pe"))
    assert _lines(spark, tmp_path / "pe") == ["c\t10\t45"]


def test_gtf_groups(spark, tmp_path):
    attr = ['transcript_id "t1"; set "one";', 'transcript_id "t2";', 'transcript_id "t1"; set "one";']
    (tmp_path / "x.gtf").write_text("".join(f"c\tx\t{k}\t11\t20\t.\t+\t.\t{a}\n" for k, a in zip(["transcript", "transcript", "exon"], attr, strict=True)))
    got = {r.region: (r.group, r.start, r.end, r.exons) for r in text.read_gtf(spark, str(tmp_path / "x.gtf"), group_attribute="set").collect()}
    assert got["t1"][:3] == ("one", 10, 20) and [tuple(e) for e in got["t1"][3]] == [(10, 20)] and got["t2"] == ("genes", 10, 20, None)
