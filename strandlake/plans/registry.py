"""All registered queries and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandlake.functions import intervals as iv
from strandlake.functions import reads as rd
from strandlake.operators import coverage as cv
from strandlake.operators import matrix as mx
from strandlake.operators import qc
from strandlake.plans import adapters as ad
from strandlake.plans.adapters import with_tables as sql

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(text: str | None = None):
    def register(f):
        _QUERIES[f.__name__] = f
        if text:
            _SQL[f.__name__] = text
        return f

    return register


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def r6(c):
    return F.round(c, 6)


def full_coverage(spark: SparkSession, d: str) -> DataFrame:
    domain = iv.bin_domain(ad.sizes(spark).select("chrom", F.lit(0).cast("long").alias("start"), F.col("size").alias("end"), F.lit(0).alias("segment")), 50)
    counts = cv.count_in_bins(ad.fragments(spark, d), 50).withColumn("end", F.lit(0))
    return cv.fill_domain(counts, domain, ad.samples(spark))


def coverage_values(spark: SparkSession, d: str) -> DataFrame:
    return full_coverage(spark, d).select("sample", "chrom", "start", F.col("n").cast("double").alias("value"))


# ---------------------------------------------------------------- filters and projections


@query(sql("aln", "SELECT sample, chrom, count(*) AS n, sum(pos) AS s FROM aln WHERE flag & 4 = 0 AND mapq >= 3 AND flag & 2 = 2 AND flag & 1024 = 0 AND frag_len BETWEEN 120 AND 350 AND chrom NOT IN ('R') GROUP BY ALL"))
def f1_f8_read_filters(spark, d):
    kept = rd.filter_reads(ad.alignments(spark, d), min_mapq=3, include=2, exclude=1024, min_len=120, max_len=350, skip_chroms=("R",))
    return kept.groupBy("sample", "chrom").agg(F.count("*").alias("n"), F.sum("pos").alias("s"))


@query(sql("aln", """SELECT sample, chrom, count(*) AS n, sum(pos) AS s FROM (SELECT DISTINCT sample, chrom, pos, CASE WHEN mate_chrom = chrom THEN pos + frag_len ELSE mate_pos END AS e, mate_chrom, flag & 16 AS rev FROM aln WHERE flag & 4 = 0) GROUP BY ALL"""))
def f6_duplicate_removal(spark, d):
    return rd.drop_duplicates(rd.filter_reads(ad.alignments(spark, d))).groupBy("sample", "chrom").agg(F.count("*").alias("n"), F.sum("pos").alias("s"))


@query(sql("aln", """SELECT sample, count(*) FILTER (flag & 4 = 0 AND (CASE WHEN flag & 1 > 0 THEN flag & 144 = 128 OR flag & 96 = 64 ELSE flag & 16 = 16 END)) AS forward,
    count(*) FILTER (flag & 4 = 0 AND (CASE WHEN flag & 1 > 0 THEN flag & 144 = 144 OR flag & 96 = 96 ELSE flag & 16 = 0 END)) AS reverse FROM aln GROUP BY sample"""))
def f7_rna_strand(spark, d):
    a = ad.alignments(spark, d)
    mapped = ~rd.has(rd.UNMAPPED)
    return a.groupBy("sample").agg(F.count_if(mapped & rd.rna_strand("forward")).alias("forward"), F.count_if(mapped & rd.rna_strand("reverse")).alias("reverse"))


@query(sql("aln", """SELECT sample, chrom, count(*) AS n, sum("end" - pos) AS bases FROM aln WHERE chrom = 'A' AND pos < 60000 AND "end" > 20000 GROUP BY ALL"""))
def s2_region_fetch(spark, d):
    a = ad.alignments(spark, d).where("chrom = 'A' AND pos < 60000 AND end > 20000")
    return a.groupBy("sample", "chrom").agg(F.count("*").alias("n"), F.sum(F.col("end") - F.col("pos")).alias("bases"))


@query(sql("aln", "SELECT sample, chrom, count(*) FILTER (flag & 4 = 0) AS mapped, count(*) FILTER (flag & 4 <> 0) AS unmapped, count(*) FILTER (flag & 4 = 0 AND chrom <> 'R') AS counted FROM aln GROUP BY ALL"))
def s3_s4_mapping_stats(spark, d):
    un = rd.has(rd.UNMAPPED)
    return ad.alignments(spark, d).groupBy("sample", "chrom").agg(F.count_if(~un).alias("mapped"), F.count_if(un).alias("unmapped"), F.count_if(~un & (F.col("chrom") != "R")).alias("counted"))


@query(sql("sizes merged", """, m AS (SELECT m.chrom, greatest(0, m.start) AS start, least(m."end", s.size) AS "end", s.size FROM merged m JOIN sizes s USING (chrom) WHERE m.start < s.size),
    a AS (SELECT chrom, "end" AS start, coalesce(lead(start) OVER (PARTITION BY chrom ORDER BY start), size) AS "end" FROM m UNION ALL
          SELECT s.chrom, 0, coalesce(min(m.start), s.size) FROM sizes s LEFT JOIN m USING (chrom) GROUP BY s.chrom, s.size)
    SELECT chrom, start, "end", row_number() OVER (PARTITION BY chrom ORDER BY start) - 1 AS segment FROM a WHERE "end" > start"""))
def f10_w7_blacklist_segments(spark, d):
    return iv.complement(ad.sizes(spark), ad.blacklist(spark, d)).select("chrom", "start", "end", F.col("segment").cast("long").alias("segment"))


@query(sql("dom blacklist", """SELECT chrom, count(*) AS n, sum(start) AS s FROM dom d WHERE NOT EXISTS (SELECT 1 FROM blacklist b WHERE b.chrom = d.chrom AND b.start < d."end" AND b."end" > d.start) GROUP BY chrom"""))
def f11_j6_bins_off_blacklist(spark, d):
    domain = iv.bin_domain(ad.sizes(spark).select("chrom", F.lit(0).cast("long").alias("start"), F.col("size").alias("end"), F.lit(0).alias("segment")), 50)
    return iv.overlap_join(domain, ad.blacklist(spark, d), "anti").groupBy("chrom").agg(F.count("*").alias("n"), F.sum("start").alias("s"))


@query(sql("covfull", "SELECT count(*) AS n, sum(start) AS s FROM (SELECT chrom, start FROM covfull GROUP BY ALL HAVING sum(n) <> 0)"))
def f13_f14_skip_zero_bins(spark, d):
    kept = qc.skip_zero_rows(coverage_values(spark, d), ["chrom", "start"]).select("chrom", "start").distinct()
    return kept.agg(F.count("*").alias("n"), F.sum("start").alias("s"))


@query(sql("covfull", """, m AS (SELECT sample, quantile_cont(n, 0.5) AS m, quantile_cont(abs(n), 0.5) AS d FROM covfull GROUP BY sample)
    SELECT count(*) AS n, coalesce(sum(start), 0) AS s FROM (SELECT chrom, start FROM covfull JOIN m USING (sample) GROUP BY ALL HAVING bool_and(CASE WHEN d > 0 THEN abs(n - m) / (1.4826 * d) > 1.5 ELSE false END))"""))
def f16_mad_outliers(spark, d):
    return qc.mad_outliers(coverage_values(spark, d), ["chrom", "start"], 1.5).agg(F.count("*").alias("n"), F.coalesce(F.sum("start"), F.lit(0)).alias("s"))


@query(sql("aln", """, f AS (SELECT *, flag & 2 = 2 AND mate_chrom = chrom AND abs(tlen) <= 400 AND (flag & 16 > 0) <> (flag & 32 > 0) AND (CASE WHEN flag & 16 > 0 THEN pos >= mate_pos ELSE pos <= mate_pos END) AS pair FROM aln WHERE flag & 4 = 0),
    e AS (SELECT sample, CASE WHEN pair THEN least(pos, mate_pos) WHEN flag & 16 > 0 THEN least(pos, greatest("end" - 100, 0)) ELSE pos END AS s, CASE WHEN pair THEN least(pos, mate_pos) + abs(tlen) WHEN flag & 16 > 0 THEN "end" ELSE greatest("end", pos + 100) END AS e FROM f)
    SELECT sample, count(*) AS n, sum(s) AS starts, sum(e) AS ends FROM e GROUP BY sample"""))
def p1_p3_p4_fragments(spark, d):
    s, e = rd.fragment(extend=100)
    a = rd.filter_reads(ad.alignments(spark, d)).select("sample", s.alias("s"), e.alias("e"))
    return a.groupBy("sample").agg(F.count("*").alias("n"), F.sum("s").alias("starts"), F.sum("e").alias("ends"))


@query(sql("aln", """SELECT sample, count(*) AS n, sum(pos + abs(tlen) // 2 - 1) AS starts, sum(CASE WHEN abs(tlen) % 2 = 0 THEN 2 ELSE 4 END) AS bases FROM aln WHERE flag & 2 = 2 AND flag & 32 > 0 AND flag & 16 = 0 AND abs(tlen) BETWEEN 130 AND 200 GROUP BY sample"""))
def p6_nucleosome_centre(spark, d):
    ok, s, e = rd.nucleosome_centre()
    return ad.alignments(spark, d).where(ok).groupBy("sample").agg(F.count("*").alias("n"), F.sum(s).alias("starts"), F.sum(e - s).alias("bases"))


@query(sql("aln", """, p AS (SELECT sample, greatest(0, pos + CASE WHEN flag & 64 > 0 THEN 4 ELSE 5 END) AS s, least(100050, pos + tlen + CASE WHEN flag & 64 > 0 THEN -5 ELSE -4 END) AS e FROM aln WHERE flag & 2 = 2 AND tlen > 0)
    SELECT sample, count(*) AS n, sum(s) AS starts, sum(greatest(e, s + 1)) AS ends FROM p GROUP BY sample"""))
def p8_shift(spark, d):
    ok, s, e = rd.shifted((4, -5), F.lit(ad.CHROM_SIZE))
    return ad.alignments(spark, d).where(ok).groupBy("sample").agg(F.count("*").alias("n"), F.sum(s).alias("starts"), F.sum(e).alias("ends"))


@query(sql("aln", """SELECT chrom, pos AS start, least(pos + tlen, 100050) AS "end", count(*) AS n FROM aln WHERE tlen > 0 AND mapq >= 9 GROUP BY ALL"""))
def p9_s16_fragment_bed(spark, d):
    a = ad.alignments(spark, d).where("tlen > 0 AND mapq >= 9")
    return a.groupBy("chrom", F.col("pos").alias("start"), F.least(F.col("pos") + F.col("tlen"), F.lit(ad.CHROM_SIZE)).cast("long").alias("end")).agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- coverage


@query(sql("cov", "SELECT sample, chrom, start, n FROM cov"))
def a1_bin_coverage(spark, d):
    return cv.count_in_bins(ad.fragments(spark, d), 50)


@query(sql("covfull", """SELECT sample, chrom, start, "end", n FROM covfull"""))
def a6_zero_filled_coverage(spark, d):
    return full_coverage(spark, d).select("sample", "chrom", "start", "end", "n")


@query(sql("aln", """, b AS (SELECT start FROM range(0, 100050 - 30 + 1, 200) r(start)) SELECT sample, chrom, b.start, count(*) AS n FROM aln JOIN b ON aln.pos < b.start + 30 AND aln."end" > b.start GROUP BY ALL"""))
def a3_strided_bins(spark, d):
    segments = ad.sizes(spark).select("chrom", F.lit(0).cast("long").alias("start"), F.col("size").alias("end"), F.lit(0).alias("segment"))
    return cv.count_in_domain(ad.fragments(spark, d), iv.bin_domain(segments, 30, 200)).select("sample", "chrom", "start", "n")


@query(sql("aln", """SELECT sample, chrom, bin * 500 AS start, sum(least("end", (bin + 1) * 500) - greatest(pos, bin * 500)) AS bases FROM (SELECT *, unnest(range(pos // 500, ("end" - 1) // 500 + 1)) AS bin FROM aln) WHERE (bin + 1) * 500 <= 100050 GROUP BY ALL"""))
def a4_covered_bases(spark, d):
    return cv.covered_bases(ad.fragments(spark, d), 500, ad.sizes(spark))


@query(sql("aln", """SELECT sample, sum(CASE WHEN flag & 4 = 0 THEN 1 ELSE 0 END) AS kept, round(1e6 / kept, 6) AS cpm, round(1.0 / ((kept / 1e6) * 0.05), 6) AS rpkm, round(300150 / (kept * 100.0), 6) AS rpgc FROM aln GROUP BY sample"""))
def q5_scale_factors(spark, d):
    kept = rd.filter_reads(ad.alignments(spark, d)).groupBy("sample").agg(F.count("*").alias("kept"))
    k = F.col("kept")
    return kept.select("sample", "kept", r6(cv.scale_factor("CPM", k)).alias("cpm"), r6(cv.scale_factor("RPKM", k)).alias("rpkm"), r6(cv.scale_factor("RPGC", k, genome=300150, fragment=100)).alias("rpgc"))


_RUNS = """, v AS (SELECT sample, chrom, start, "end", n AS value FROM covfull),
    m AS (SELECT *, CASE WHEN value IS NOT DISTINCT FROM lag(value) OVER w AND lag("end") OVER w = start THEN 0 ELSE 1 END AS new FROM v WINDOW w AS (PARTITION BY sample, chrom ORDER BY start)),
    r AS (SELECT *, sum(new) OVER (PARTITION BY sample, chrom ORDER BY start ROWS UNBOUNDED PRECEDING) AS run FROM m)"""


@query(sql("covfull aln", _RUNS + """, t AS (SELECT sample, count(*) AS kept FROM aln GROUP BY sample)
    SELECT sample, chrom, min(start) AS start, max("end") AS "end", round(any_value(value) * 1e6 / any_value(kept), 6) AS value FROM r JOIN t USING (sample) GROUP BY sample, chrom, run"""))
def w1_coverage_runs(spark, d):
    """Coverage of 50-base bins per million reads, equal neighbours as one run."""
    runs = iv.run_lengths(full_coverage(spark, d).withColumnRenamed("n", "value"), ["sample", "chrom"])
    kept = ad.fragments(spark, d).groupBy("sample").agg(F.count("*").alias("kept"))
    return runs.join(F.broadcast(kept), "sample").select("sample", "chrom", "start", "end", r6(F.col("value") * 1e6 / F.col("kept")).alias("value"))


@query(sql("covfull", """SELECT sample, chrom, start, round(avg(n) OVER (PARTITION BY sample, chrom ORDER BY start ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS value FROM covfull"""))
def w3_smoothing(spark, d):
    x = iv.smooth(full_coverage(spark, d).withColumnRenamed("n", "value"), ["sample", "chrom"], 250, 50)
    return x.select("sample", "chrom", "start", r6("value").alias("value"))


_PAIR = """, p AS (SELECT chrom, start, "end", max(n) FILTER (sample = 'F') AS a, max(n) FILTER (sample = 'O') AS b FROM covfull GROUP BY ALL)"""


@query(sql("covfull", _PAIR + """ SELECT chrom, start, round(log2((a * 0.5 + 1) / (b + 1)), 6) AS log2, round((a * 0.5 + 1) / (b + 1), 6) AS ratio, CASE WHEN (a * 0.5 + 1) / (b + 1) >= 1 THEN round((a * 0.5 + 1) / (b + 1), 6) ELSE round(-1 / ((a * 0.5 + 1) / (b + 1)), 6) END AS recip,
    round(a * 0.5 - b, 6) AS subtract, round(a * 0.5 + b, 6) AS add, round((a * 0.5 + b) / 2, 6) AS mean, a * 0.5 AS first, CAST(b AS DOUBLE) AS second FROM p"""))
def p10_p11_compare_tracks(spark, d):
    wide = _wide(spark, d)
    ops = {"log2": "log2", "ratio": "ratio", "reciprocal_ratio": "recip", "subtract": "subtract", "add": "add", "mean": "mean", "first": "first", "second": "second"}
    return wide.select("chrom", "start", *[r6(cv.compare(op, F.col("a"), F.col("b"), (0.5, 1.0))).alias(name) for op, name in ops.items()])


def _wide(spark, d):
    x = full_coverage(spark, d)
    return x.groupBy("chrom", "start", "end").agg(F.max(F.when(F.col("sample") == "F", F.col("n"))).cast("double").alias("a"), F.max(F.when(F.col("sample") == "O", F.col("n"))).cast("double").alias("b"))


@query(sql("covfull", _PAIR + " SELECT chrom, start, round((a * 2.0 + b * 0.5) / 2, 6) AS value FROM p"))
def p12_average_tracks(spark, d):
    return _wide(spark, d).select("chrom", "start", r6(cv.average([F.col("a"), F.col("b")], [2.0, 0.5])).alias("value"))


@query(sql("covfull", "SELECT sample, chrom, start, round(ln(1 + n), 6) AS log1p, round(log2(n + 0.01), 6) AS log2 FROM covfull"))
def p13_log_transforms(spark, d):
    return full_coverage(spark, d).select("sample", "chrom", "start", r6(F.log1p("n")).alias("log1p"), r6(F.log2(F.col("n") + 0.01)).alias("log2"))


# ---------------------------------------------------------------- joins


@query(sql("aln regions", """SELECT sample, region, count(*) AS n FROM aln a JOIN regions r ON a.chrom = r.chrom AND a.pos < r."end" AND a."end" > r.start GROUP BY ALL"""))
def j2_a2_region_counts(spark, d):
    return cv.region_counts(ad.fragments(spark, d), ad.regions(spark, d)).select("sample", "region", "n")


@query(sql("signal regions", """SELECT r.region, round(sum(value * (least(r."end", s."end") - greatest(r.start, s.start))) / sum(least(r."end", s."end") - greatest(r.start, s.start)), 6) AS mean, CAST(sum(least(r."end", s."end") - greatest(r.start, s.start)) FILTER (s.start IS NOT NULL) AS BIGINT) AS covered
    FROM regions r LEFT JOIN signal s ON r.chrom = s.chrom AND s.start < r."end" AND s."end" > r.start GROUP BY r.region"""))
def j3_s6_region_means(spark, d):
    return cv.region_means(ad.signal(spark, d), ad.regions(spark, d)).select("region", r6("mean").alias("mean"), "covered")


@query(sql("signal dom", """, t AS (SELECT d.chrom, d.start, d."end" - d.start AS width, sum(value * (least(d."end", s."end") - greatest(d.start, s.start))) AS v, sum(least(d."end", s."end") - greatest(d.start, s.start)) AS covered
    FROM dom d LEFT JOIN signal s ON d.chrom = s.chrom AND s.start < d."end" AND s."end" > d.start GROUP BY ALL) SELECT chrom, start, round(CASE WHEN covered = width THEN v / width END, 6) AS strict, round(coalesce(v, 0) / width, 6) AS filled FROM t"""))
def s5_tile_means(spark, d):
    domain = iv.bin_domain(ad.sizes(spark).select("chrom", F.lit(0).cast("long").alias("start"), F.col("size").alias("end"), F.lit(0).alias("segment")), 50)
    a, b = (cv.tile_means(ad.signal(spark, d), domain, z) for z in (False, True))
    return a.join(b.select("chrom", "start", F.col("value").alias("filled")), ["chrom", "start"]).select("chrom", "start", r6("value").alias("strict"), r6("filled").alias("filled"))


@query(sql("aln regions", """, t AS (SELECT sample, count(*) AS total FROM aln GROUP BY sample), m AS (SELECT *, row_number() OVER () AS id FROM aln),
    h AS (SELECT sample, "group" AS feature, count(DISTINCT id) AS hits FROM m JOIN regions r ON m.chrom = r.chrom AND m.pos < r."end" AND m."end" > r.start GROUP BY ALL) SELECT sample, feature, hits, total, round(100.0 * hits / total, 6) AS percent FROM h JOIN t USING (sample)"""))
def j4_a16_enrichment(spark, d):
    got = cv.enrichment(ad.fragments(spark, d), ad.regions(spark, d).withColumnRenamed("group", "feature"))
    return got.select("sample", "feature", "hits", "total", r6("percent").alias("percent"))


@query(sql("aln blacklist", """SELECT sample, count(*) AS n, sum(pos) AS s FROM aln a WHERE EXISTS (SELECT 1 FROM blacklist b WHERE b.chrom = a.chrom AND a.pos >= b.start AND a."end" <= b."end") GROUP BY sample"""))
def j5_reads_in_blacklist(spark, d):
    inside = iv.overlap_join(ad.fragments(spark, d), ad.blacklist(spark, d), "semi", contained=True)
    return inside.groupBy("sample").agg(F.count("*").alias("n"), F.sum("start").alias("s"))


@query("""SELECT r_name AS name, min(n) AS size, count(*) AS members FROM (SELECT r.r_name, length(n.n_name) AS n FROM region r JOIN nation n ON r.r_regionkey = n.n_regionkey) GROUP BY r_name HAVING count(*) = 5""")
def j11_common_chroms(spark, d):
    r, n = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("region", "nation"))
    x = r.join(F.broadcast(n), r.r_regionkey == n.n_regionkey)
    return x.groupBy(F.col("r_name").alias("name")).agg(F.min(F.length("n_name")).cast("long").alias("size"), F.count("*").alias("members")).where("members = 5")


@query(sql("aln", """, f AS (SELECT DISTINCT chrom FROM aln WHERE sample = 'F'), o AS (SELECT DISTINCT 'chr' || chrom AS chrom FROM aln WHERE sample = 'O') SELECT f.chrom, CAST(100050 AS BIGINT) AS size FROM f JOIN o ON o.chrom = 'chr' || f.chrom"""))
def j10_common_chroms(spark, d):
    """The chromosomes of each sample as a file's header; those of O carry the prefix chr."""
    t = ad.alignments(spark, d).select("sample", "chrom").distinct().withColumn("size", F.lit(ad.CHROM_SIZE).cast("long"))
    return iv.common_chroms(t.where("sample = 'F'"), t.where("sample = 'O'").withColumn("chrom", F.concat(F.lit("chr"), "chrom")))


@query(sql("aln", """SELECT sample, sum(n - 1) AS repeats, max(n) AS most FROM (SELECT sample, chrom, pos, flag & 16 AS rev, mate_pos, count(*) AS n FROM aln GROUP BY ALL) GROUP BY sample"""))
def w6_repeated_starts(spark, d):
    w = Window.partitionBy("sample", "chrom", "pos", rd.has(rd.REVERSE), "mate_pos").orderBy("read_id")
    x = ad.alignments(spark, d).select("sample", F.row_number().over(w).alias("k"))
    return x.groupBy("sample").agg(F.count_if(F.col("k") > 1).alias("repeats"), F.max("k").cast("long").alias("most"))


# ---------------------------------------------------------------- sample statistics


@query(sql("aln blacklist", """, b AS (SELECT a.*, EXISTS (SELECT 1 FROM blacklist b WHERE b.chrom = a.chrom AND a.pos >= b.start AND a."end" <= b."end") AS bl FROM aln a WHERE flag & 4 = 0)
    SELECT sample, count(*) AS mapped, sum(CASE WHEN bl THEN 1 ELSE 0 END) AS blacklisted, round((mapped - sum(CASE WHEN bl THEN 1 ELSE 0 END)) * (1 - sum(CASE WHEN mapq < 3 THEN 1 ELSE 0 END) / count(*)), 6) AS kept FROM b GROUP BY sample"""))
def a7_a8_kept_reads(spark, d):
    a = rd.filter_reads(ad.alignments(spark, d)).select("sample", "chrom", F.col("pos").alias("start"), "end", "mapq")
    inside = iv.overlap_join(a, ad.blacklist(spark, d), "semi", contained=True).groupBy("sample").agg(F.count("*").alias("blacklisted"))
    every = a.groupBy("sample").agg(F.count("*").alias("mapped"), F.avg((F.col("mapq") < 3).cast("double")).alias("lost"))
    every = every.join(inside, "sample", "left").fillna({"blacklisted": 0})
    return every.select("sample", "mapped", "blacklisted", r6((F.col("mapped") - F.col("blacklisted")) * (1 - F.col("lost"))).alias("kept"))


@query(sql("aln blacklist", """, b AS (SELECT a.*, EXISTS (SELECT 1 FROM blacklist b WHERE b.chrom = a.chrom AND a.pos >= b.start AND a."end" <= b."end") AS bl FROM aln a WHERE flag & 4 = 0),
    k AS (SELECT sample, round((count(*) - count(*) FILTER (bl)) * (1 - count(*) FILTER (mapq < 3) / count(*)), 6) AS kept FROM b GROUP BY sample) SELECT sample, round(min(kept) OVER () / CASE WHEN kept > 0 THEN kept END, 6) AS factor FROM k"""))
def q4_read_count_factors(spark, d):
    return qc.read_count_factors(a7_a8_kept_reads(spark, d)).select("sample", r6("factor").alias("factor"))


@query(sql("aln", """, k AS (SELECT *, row_number() OVER (PARTITION BY sample, chrom, pos, "end", mate_pos, tlen, flag & 16 ORDER BY read_id) AS dup FROM aln) SELECT sample, count(*) AS total, count(*) FILTER (flag & 4 = 0) AS mapped, count(*) FILTER (mapq < 4) AS low_mapq,
    count(*) FILTER (flag & 2 <> 2) AS missing_flags, count(*) FILTER (flag & 1024 <> 0) AS excluded_flags, count(*) FILTER (dup > 1) AS internal_dups, count(*) FILTER (flag & 1 = 0) AS singletons, count(*) FILTER (mapq < 4 OR flag & 2 <> 2 OR flag & 1024 <> 0 OR dup > 1) AS filtered FROM k GROUP BY sample"""))
def a9_a10_filter_estimate(spark, d):
    w = Window.partitionBy("sample", "chrom", "pos", "end", "mate_pos", "tlen", rd.has(rd.REVERSE)).orderBy("read_id")
    a = ad.alignments(spark, d).withColumn("dup", F.row_number().over(w) > 1)
    low, miss, exc, dup = F.col("mapq") < 4, ~rd.has(rd.PROPER), rd.has(1024), F.col("dup")
    tests = {"mapped": ~rd.has(4), "low_mapq": low, "missing_flags": miss, "excluded_flags": exc, "internal_dups": dup, "singletons": ~rd.has(1), "filtered": low | miss | exc | dup}
    return a.groupBy("sample").agg(F.count("*").alias("total"), *[F.count_if(c).alias(n) for n, c in tests.items()])


@query(sql("aln", """, f AS (SELECT sample, frag_len AS x FROM aln WHERE flag & 2 = 2 AND flag & 64 > 0), m AS (SELECT sample, quantile_cont(x, 0.5) AS m FROM f GROUP BY sample)
    SELECT sample, count(*) AS n, min(x) AS min, max(x) AS max, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std, quantile_cont(x, 0.1) AS q10, quantile_cont(x, 0.25) AS q25, quantile_cont(x, 0.5) AS median, quantile_cont(x, 0.75) AS q75, quantile_cont(x, 0.9) AS q90, quantile_cont(abs(x - m), 0.5) AS mad FROM f JOIN m USING (sample) GROUP BY sample"""))
def read1_length_stats(spark, d):
    a = ad.alignments(spark, d).where(rd.has(rd.PROPER) & rd.has(rd.READ1)).select("sample", rd.template_length().alias("length"))
    x = qc.length_stats(a)
    return x.select(*[r6(c).alias(c) if c in ("mean", "std") else c for c in x.columns])


@query(sql("aln", "SELECT sample, CAST(frag_len AS BIGINT) AS length, count(*) AS n FROM aln WHERE flag & 2 = 2 AND flag & 64 > 0 GROUP BY ALL"))
def a12_length_histogram(spark, d):
    a = ad.alignments(spark, d).where(rd.has(rd.PROPER) & rd.has(rd.READ1))
    return a.groupBy("sample", rd.template_length().alias("length")).agg(F.count("*").alias("n"))


@query(sql("covfull", "SELECT sample, t AS threshold, round(avg(CASE WHEN n >= t THEN 1 ELSE 0 END) * 100, 6) AS percent FROM covfull, (VALUES (1), (3), (10)) v(t) GROUP BY ALL"))
def a13_coverage_thresholds(spark, d):
    return qc.at_least(coverage_values(spark, d), [1, 3, 10]).select("sample", "threshold", r6("percent").alias("percent"))


@query(sql("covfull", "SELECT sample, round(avg(n), 6) AS mean, round(stddev_pop(n), 6) AS std, min(n) AS min, quantile_cont(n, 0.25) AS q25, quantile_cont(n, 0.5) AS q50, quantile_cont(n, 0.75) AS q75, max(n) AS max FROM covfull GROUP BY sample"))
def a14_coverage_summary(spark, d):
    x = qc.describe(coverage_values(spark, d))
    return x.select(*[r6(c).alias(c) if c in ("mean", "std") else c for c in x.columns])


@query(sql("covfull", """, h AS (SELECT sample, n AS coverage, count(*) AS n FROM covfull GROUP BY ALL) SELECT sample, coverage, n, round(sum(n) OVER (PARTITION BY sample ORDER BY coverage DESC) / sum(n) OVER (PARTITION BY sample), 6) AS share FROM h"""))
def a15_coverage_histogram(spark, d):
    return qc.coverage_histogram(coverage_values(spark, d)).select("sample", "coverage", "n", r6("share").alias("share"))


@query(sql("covfull", """, s AS (SELECT sample, avg(n) AS mean, quantile_cont(n, 0.5) AS med FROM covfull GROUP BY sample) SELECT sample, round(min(mean) OVER () / mean, 6) AS by_mean, round(min(med) OVER () / CASE WHEN med > 0 THEN med END, 6) AS by_median FROM s"""))
def q2_mean_factors(spark, d):
    x = coverage_values(spark, d)
    by_median = qc.least_over(x, "median").select("sample", r6("factor").alias("by_median"))
    return qc.least_over(x).select("sample", r6("factor").alias("by_mean")).join(by_median, "sample")


@query(sql("covfull", """, g AS (SELECT chrom, start, avg(CASE WHEN n > 0 THEN ln(n) END) AS g FROM covfull GROUP BY ALL HAVING min(n) > 0) SELECT sample, round(1 / exp(quantile_cont(ln(n) - g, 0.5)), 6) AS factor FROM covfull JOIN g USING (chrom, start) GROUP BY sample"""))
def q3_size_factors(spark, d):
    return qc.size_factors(coverage_values(spark, d), ["chrom", "start"]).select("sample", r6("factor").alias("factor"))


@query(sql("covfull", "SELECT x.sample AS a, y.sample AS b, round(corr(x.n, y.n), 6) AS r FROM covfull x JOIN covfull y USING (chrom, start) GROUP BY ALL"))
def q6_pearson(spark, d):
    return qc.pearson(coverage_values(spark, d), ["chrom", "start"]).select("a", "b", r6("r").alias("r"))


@query(sql("covfull", """, k AS (SELECT *, rank() OVER (PARTITION BY sample ORDER BY n) + (count(*) OVER (PARTITION BY sample, n) - 1) / 2 AS k FROM covfull) SELECT x.sample AS a, y.sample AS b, round(corr(x.k, y.k), 6) AS r FROM k x JOIN k y USING (chrom, start) GROUP BY ALL"""))
def q7_w5_spearman(spark, d):
    return qc.spearman(coverage_values(spark, d), ["chrom", "start"]).select("a", "b", r6("r").alias("r"))


@query()
def q8_principal_components(spark, d):
    names, rows, eigen = qc.principal_components(coverage_values(spark, d), ["chrom", "start"])
    data = [(i + 1, n, float(v), float(e)) for i, (row, e) in enumerate(zip(rows, eigen, strict=True)) for n, v in zip(names, row, strict=True)]
    return spark.createDataFrame(data, "component int, sample string, loading double, eigenvalue double")


@query(sql("covfull", """, h AS (SELECT sample, n AS v, count(*) AS n FROM covfull GROUP BY ALL) SELECT sample, CAST(v AS DOUBLE) AS v, n, sum(n) OVER w AS bins, round(sum(v * n) OVER w / sum(v * n) OVER (PARTITION BY sample), 6) AS share FROM h WINDOW w AS (PARTITION BY sample ORDER BY v)"""))
def q9_w4_fingerprint(spark, d):
    return qc.fingerprint(coverage_values(spark, d)).select("sample", "v", "n", "bins", r6("share").alias("share"))


@query(sql("covfull", """, c AS (SELECT sample, n, row_number() OVER w AS k, sum(n) OVER w / sum(n) OVER (PARTITION BY sample) AS y, count(*) OVER (PARTITION BY sample) AS t FROM covfull WINDOW w AS (PARTITION BY sample ORDER BY n ROWS UNBOUNDED PRECEDING))
    SELECT sample, round(avg(y), 6) AS auc, round(count(*) FILTER (y = 0) / max(t), 6) AS x_intercept, round(max(k / t - y), 6) AS elbow_gap FROM c GROUP BY sample"""))
def q10_fingerprint_metrics(spark, d):
    x = qc.fingerprint_metrics(coverage_values(spark, d))
    return x.select("sample", r6("auc").alias("auc"), r6("x_intercept").alias("x_intercept"), r6("elbow_gap").alias("elbow_gap"))


@query(sql("covfull", """, r AS (SELECT sample, row_number() OVER w AS k, sum(n) OVER w AS c FROM covfull WINDOW w AS (PARTITION BY sample ORDER BY n ROWS UNBOUNDED PRECEDING)),
    p AS (SELECT k, max(c) FILTER (sample = 'F') AS p, max(c) FILTER (sample = 'O') AS q FROM r GROUP BY k), d AS (SELECT *, abs(p / max(p) OVER () - q / max(q) OVER ()) AS d FROM p),
    m AS (SELECT min(k) AS k FROM d WHERE d = (SELECT max(d) FROM d)), x AS (SELECT p.p, p.q FROM p, m WHERE p.k > floor((m.k - 1) * 0.8) AND p.p > 0 AND p.q > 0 ORDER BY p.k LIMIT 1)
    SELECT 'F' AS sample, round(least(p, q) / p, 6) AS factor FROM x UNION ALL SELECT 'O', round(least(p, q) / q, 6) FROM x"""))
def q1_signal_extraction_factors(spark, d):
    return qc.ses_factors(coverage_values(spark, d), "F", "O").select("sample", r6("factor").alias("factor"))


_CURVES = """, s AS (SELECT DISTINCT sample FROM h), c AS (SELECT sample, sum(n) OVER w / sum(n) OVER (PARTITION BY sample) AS x, sum(n * v) OVER w / sum(n * v) OVER (PARTITION BY sample) AS y FROM h WINDOW w AS (PARTITION BY sample ORDER BY v)),
    o AS (SELECT * FROM c UNION ALL SELECT sample, 0, 0 FROM s), k AS (SELECT *, lead(x) OVER (PARTITION BY sample ORDER BY x) AS x1, lead(y) OVER (PARTITION BY sample ORDER BY x) AS y1 FROM o),
    g AS (SELECT s.sample, i, i / 100000.0::DOUBLE AS x FROM s, range(0, 100001) t(i)), v AS (SELECT g.sample, g.i, k.y + coalesce((g.x - k.x) / (k.x1 - k.x) * (k.y1 - k.y), 0) AS y FROM g ASOF JOIN k ON g.sample = k.sample AND g.x >= k.x),
    f AS (SELECT sample, i, y - lag(y) OVER (PARTITION BY sample ORDER BY i) AS f FROM v), w AS (SELECT i, max(f) FILTER (sample = 'F') AS p, max(f) FILTER (sample <> 'F') AS q FROM f WHERE f IS NOT NULL GROUP BY i)"""
_JSD = "round(sqrt(sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2), 6)"


@query(sql("covfull", ", h AS (SELECT sample, CAST(n AS DOUBLE) AS v, CAST(count(*) AS DOUBLE) AS n FROM covfull WHERE n > 0 GROUP BY sample, covfull.n)" + _CURVES + f" SELECT 'F' AS a, 'O' AS b, {_JSD} AS jsd FROM w"))
def q12_jensen_shannon(spark, d):
    h = qc.fingerprint(coverage_values(spark, d)).where("v > 0").select("sample", "v", "n")
    return spark.createDataFrame([("F", "O", qc.jensen_shannon(h.where("sample = 'F'"), h.where("sample = 'O'")))], "a string, b string, jsd double").select("a", "b", r6("jsd").alias("jsd"))


@query(sql("covfull", """, m AS (SELECT avg(n) AS mean, CAST(sum(n) AS DOUBLE) AS cover FROM covfull WHERE sample = 'F'),
    h AS (SELECT 'F' AS sample, CAST(n AS DOUBLE) AS v, CAST(count(*) AS DOUBLE) AS n FROM covfull WHERE n > 0 AND sample = 'F' GROUP BY covfull.n UNION ALL
          SELECT 'P', CAST(k - 1 AS DOUBLE), cover * exp(k * ln(mean) - mean - lgamma(k + 1)) FROM m, range(1, 400) t(k))""" + _CURVES + f" SELECT 'F' AS sample, {_JSD} AS jsd FROM w"))
def q13_synthetic_jsd(spark, d):
    h = qc.fingerprint(coverage_values(spark, d)).where("sample = 'F'").select("v", "n")
    return spark.createDataFrame([("F", qc.synthetic_jsd(h))], "sample string, jsd double").select("sample", r6("jsd").alias("jsd"))


@query(sql("covfull", "SELECT sample, chrom, start, n AS value FROM covfull WHERE (chrom, start) IN (SELECT (chrom, start) FROM covfull WHERE n <> 0 GROUP BY ALL HAVING count(*) = 2)"))
def a5_f15_complete_rows(spark, d):
    """Zeros count as missing, then bins with a missing sample go."""
    x = coverage_values(spark, d).withColumn("value", qc.zeros_to_missing(F.col("value")))
    return qc.complete_rows(x, ["chrom", "start"], 2).select("sample", "chrom", "start", F.col("value").cast("long").alias("value"))


@query(sql("aln", """, q AS (SELECT read_id // 8 AS tmpl, sample, pos, read_id, mapq >= 3 AS ok FROM aln) SELECT sample, count(*) AS reads, count(*) FILTER (keep) AS kept, count(*) FILTER (keep <> ok) AS changed FROM (SELECT *, first_value(ok) OVER (PARTITION BY sample, tmpl ORDER BY pos, read_id) AS keep FROM q) GROUP BY sample"""))
def j12_w8_mate_decisions(spark, d):
    """The reads of a template share the decision on its first read by position; of reads equal in position and id a low quality one decides, so reruns agree."""
    w = Window.partitionBy("sample", "template").orderBy("pos", "read_id", "ok")
    x = ad.alignments(spark, d).select("sample", F.floor(F.col("read_id") / 8).alias("template"), "pos", "read_id", (F.col("mapq") >= 3).alias("ok")).withColumn("keep", F.first("ok").over(w))
    return x.groupBy("sample").agg(F.count("*").alias("reads"), F.count_if("keep").alias("kept"), F.count_if(F.col("keep") != F.col("ok")).alias("changed"))


# ---------------------------------------------------------------- sequence


_GC = """, g AS (SELECT doc_id AS chrom, CAST(length(regexp_replace(upper(text), '[^GC]', '', 'g')) AS BIGINT) AS gc, CAST(length(regexp_replace(upper(text), '[^ACGT]', '', 'g')) AS BIGINT) AS known FROM documents)"""


@query("WITH x AS (SELECT 1)" + _GC + " SELECT chrom, gc, known, round(gc / CASE WHEN known > 0 THEN known END, 6) AS share FROM g")
def p14_s10_gc_content(spark, d):
    up = F.upper("seq")
    x = ad.documents(spark, d).select("chrom", F.length(F.regexp_replace(up, "[^GC]", "")).cast("long").alias("gc"), F.length(F.regexp_replace(up, "[^ACGT]", "")).cast("long").alias("known"))
    return x.withColumn("share", r6(F.try_divide("gc", "known")))


@query(sql("aln", """, w AS (SELECT (l_orderkey + l_partkey) % 101 AS gc, l_suppkey % 2 AS fwd FROM lineitem), t AS (SELECT gc, count(*) FILTER (fwd = 0) AS f, count(*) AS n FROM w GROUP BY gc)
    SELECT gc, f, n, round(CASE WHEN f > 0 AND n > 0 THEN f / n * sum(n) OVER () / sum(f) OVER () ELSE 1 END, 6) AS r FROM t"""))
def a18_gc_table(spark, d):
    t = spark.read.parquet(f"{d}/lineitem.parquet").groupBy(((F.col("l_orderkey") + F.col("l_partkey")) % 101).alias("gc")).agg(F.count_if(F.col("l_suppkey") % 2 == 0).alias("f"), F.count("*").alias("n"))
    return qc.gc_ratio(t).select("gc", "f", "n", r6("r").alias("r"))


# ---------------------------------------------------------------- matrices


@query(sql("regions signal", """, z AS (SELECT region, chrom, k AS bin, CASE WHEN strand = '+' THEN start - 200 + k * 50 ELSE "end" + 200 - (k + 1) * 50 END AS s FROM regions, range(0, 12) r(k))
    SELECT z.region, CAST(z.bin AS INT) AS bin, round(sum(value * (least(z.s + 50, g."end") - greatest(z.s, g.start))) / sum(least(z.s + 50, g."end") - greatest(z.s, g.start)), 6) AS value FROM z LEFT JOIN signal g ON g.chrom = z.chrom AND g.start < z.s + 50 AND g."end" > z.s GROUP BY ALL"""))
def m8_reference_point(spark, d):
    z = mx.zones_reference_point(ad.regions(spark, d), 200, 400, 50)
    return mx.bin_values(z, ad.signal(spark, d)).select("region", "bin", r6("value").alias("value"))


_SCALED = """, k AS (SELECT *, "end" - start AS len FROM regions WHERE "end" - start >= 10),
    z AS (SELECT region, chrom, strand, k, CASE WHEN strand = '-' THEN 15 - k ELSE k END AS bin, CASE WHEN strand = '-' THEN 4 ELSE 2 END AS b, start, len FROM k, range(0, 16) r(k)),
    y AS (SELECT region, chrom, bin, CASE WHEN k < b THEN start - b * 20 + k * 20 WHEN k - b < 10 THEN start + (k - b) * len // 10 ELSE start + len + (k - b - 10) * 20 END AS s, CASE WHEN k < b THEN start - b * 20 + k * 20 + 20 WHEN k - b < 10 THEN start + (k - b + 1) * len // 10 ELSE start + len + (k - b - 10) * 20 + 20 END AS e FROM z)"""


@query(sql("regions signal", _SCALED + """, p AS (SELECT y.region, y.bin, y.s, y.e, value AS v, least(y.e, g."end") - greatest(y.s, g.start) AS w FROM y LEFT JOIN signal g ON g.chrom = y.chrom AND g.start < y.e AND g."end" > y.s)
    SELECT region, CAST(bin AS INT) AS bin, round(sum(v * w) / sum(w), 6) AS mean, round(max(v), 6) AS high, round(min(v), 6) AS low, round(sum(v * w), 4) AS sum, round(sqrt(greatest(sum(w * v * v) / sum(w) - (sum(v * w) / sum(w)) ** 2, 0)), 4) AS std FROM p GROUP BY region, bin, s, e"""))
def m1_m5_m6_scaled_regions(spark, d):
    """Five statistics of the bins of scaled regions in one pass."""
    z = mx.zones_scaled(ad.regions(spark, d), 200, 40, 80, 20)
    x = mx.bin_statistics(z, ad.signal(spark, d), ("mean", "max", "min", "sum", "std"))
    return x.select("region", "bin", r6("mean").alias("mean"), r6("max").alias("high"), r6("min").alias("low"), F.round("sum", 4).alias("sum"), F.round("std", 4).alias("std"))


@query(sql("regions signal", """, z AS (SELECT region, chrom, k AS bin, CASE WHEN strand = '+' THEN start - 200 + k * 50 ELSE "end" + 200 - (k + 1) * 50 END AS s FROM regions, range(0, 12) r(k)),
    p AS (SELECT z.region, z.bin, value AS v, least(z.s + 50, g."end") - greatest(z.s, g.start) AS w FROM z LEFT JOIN signal g ON g.chrom = z.chrom AND g.start < z.s + 50 AND g."end" > z.s)
    SELECT region, CAST(bin AS INT) AS bin, round(coalesce(sum(v * w), 0) / 50, 6) AS mean, round(coalesce(CASE WHEN sum(w) < 50 THEN least(min(v), 0) ELSE min(v) END, 0), 6) AS low, round(coalesce(max(v), 0), 6) AS high FROM p GROUP BY ALL"""))
def m7_missing_as_zero(spark, d):
    """Bins around the start of each region, bases without signal counting as 0."""
    z = mx.zones_reference_point(ad.regions(spark, d), 200, 400, 50)
    x = mx.bin_statistics(z, ad.signal(spark, d), ("mean", "min", "max"), True)
    return x.select("region", "bin", r6("mean").alias("mean"), r6("min").alias("low"), r6("max").alias("high"))


@query(sql("cells", """SELECT "group", CAST(bin AS INT) AS bin, round(avg(v), 6) AS mean, round(quantile_cont(v, 0.5), 6) AS median, round(min(v), 6) AS min, round(max(v), 6) AS max, round(stddev_pop(v), 6) AS std, round(sum(v), 4) AS sum, count(v) AS n, round(stddev_pop(v) / sqrt(count(v)), 6) AS se FROM cells WHERE v IS NOT NULL GROUP BY ALL"""))
def m10_profile(spark, d):
    x = mx.profile(ad.vectors(spark, d))
    return x.select("group", "bin", *[r6(c).alias(c) for c in ("mean", "median", "min", "max", "std", "se")], F.round("sum", 4).alias("sum"), "n")


@query(sql("cells", "SELECT round(min(v), 6) AS min, round(max(v), 6) AS max, round(quantile_cont(v, 0.1), 6) AS p10, round(quantile_cont(v, 0.5), 6) AS median, round(quantile_cont(v, 0.9), 6) AS p90 FROM cells WHERE v IS NOT NULL"))
def m11_data_range(spark, d):
    x = mx.data_range(ad.vectors(spark, d))
    return x.select(*[r6(c).alias(c) for c in x.columns])


@query(sql("cells", "SELECT round(quantile_cont(v, 0.01), 6) AS low, round(quantile_cont(v, 0.98), 6) AS high FROM cells WHERE v IS NOT NULL"))
def m12_heat_limits(spark, d):
    return mx.heat_limits(ad.vectors(spark, d)).select(r6("low").alias("low"), r6("high").alias("high"))


@query(sql("cells", """, k AS (SELECT "group", region, max(v) AS m FROM cells GROUP BY ALL) SELECT "group", region, row_number() OVER (PARTITION BY "group" ORDER BY m DESC NULLS LAST, region) AS position FROM k"""))
def o1_o4_sort_regions(spark, d):
    return mx.sort_regions(ad.vectors(spark, d), "max").select("group", "region", F.col("position").cast("long").alias("position"))


@query(sql("cells", """SELECT "group", region FROM cells GROUP BY ALL HAVING coalesce(min(v), 0) >= 0.001 AND coalesce(max(v), 0) <= 0.45 OR count(v) = 0"""))
def f18_filter_values(spark, d):
    return mx.filter_values(ad.vectors(spark, d), 0.001, 0.45).select("group", "region")


@query(sql("cells", """SELECT "group", region FROM cells GROUP BY ALL HAVING NOT (count(v) = 64 AND max(v) >= 0.3) AND coalesce(avg(v), 0) <> 0"""))
def f17_f20_build_thresholds(spark, d):
    return mx.skip_zeros(mx.thresholds(ad.vectors(spark, d), high=0.3)).select("group", "region")


@query("""SELECT label AS "group", vec_id AS region, CASE WHEN label = 1 THEN 128 ELSE 64 END AS bins FROM embeddings WHERE label IN (1, 2) UNION ALL SELECT label, vec_id, 64 FROM embeddings WHERE label = 3""")
def u1_u2_j8_bind(spark, d):
    m = ad.vectors(spark, d)
    both = mx.cbind(m.where("group IN (1, 2)"), m.where("group = 1"), 64)
    sized = both.select("group", "region", F.when(F.col("group") == 1, F.size("bins")).otherwise(F.size("bins") - 64).cast("int").alias("bins"))
    return mx.rbind(sized, m.where("group = 3").select("group", "region", F.size("bins").alias("bins")))


@query(sql("cells", """SELECT CASE WHEN "group" = 3 THEN 1 ELSE 2 END AS group_order, "group", region, CAST(bin AS INT) AS bin, round(v * 2.5, 6) AS value FROM cells WHERE "group" IN (1, 3) AND v IS NOT NULL AND bin < 16"""))
def u2_m9_subset_scaled(spark, d):
    """Groups 3 and 1, in this order; of four samples of 16 bins the first; all bins times 2.5."""
    m = mx.scaled(mx.subset(ad.vectors(spark, d), [3, 1], [0], 16), 2.5)
    x = m.select(F.col("group_order").cast("int").alias("group_order"), "group", "region", F.posexplode("bins").alias("bin", "v")).where("v is not null")
    return x.select("group_order", "group", "region", "bin", r6("v").alias("value"))


@query(sql("regions", """SELECT "group", count(*) AS n, sum(start) AS s FROM regions WHERE strand = '-' GROUP BY ALL"""))
def f19_filter_strand(spark, d):
    return mx.filter_strand(ad.regions(spark, d), "-").groupBy("group").agg(F.count("*").alias("n"), F.sum("start").alias("s"))


@query()
def m13_k_means(spark, d):
    return mx.k_means(ad.vectors(spark, d), 3).groupBy("cluster").agg(F.count("*").alias("n"))
