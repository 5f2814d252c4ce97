"""Further registered queries: blocks, names, GC correction, clustering, statistics and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandlake.functions import blocks as bl
from strandlake.functions import intervals as iv
from strandlake.functions import names as nm
from strandlake.operators import cluster as cl
from strandlake.operators import gc
from strandlake.operators import matrix as mx
from strandlake.operators import qc
from strandlake.plans import adapters as ad
from strandlake.plans.adapters import with_tables as sql
from strandlake.plans.registry import coverage_values, query, r6

# ---------------------------------------------------------------- blocks of regions and reads


def _exons(spark, d):
    q = F.floor((F.col("end") - F.col("start")) / 5)
    at = [(F.col("start"), F.col("start") + q), (F.col("start") + 2 * q, F.col("start") + 3 * q), (F.col("start") + 4 * q, F.col("end"))]
    return ad.regions(spark, d).withColumn("exons", F.array(*[F.struct(a.cast("long").alias("start"), z.cast("long").alias("end")) for a, z in at]))


_EXONS = """, q AS (SELECT region, start AS s, "end" AS e, ("end" - start) // 5 AS q FROM regions), x AS (SELECT region, 1 AS i, s, s + q AS e FROM q UNION ALL SELECT region, 2, s + 2 * q, s + 3 * q FROM q UNION ALL SELECT region, 3, s + 4 * q, e FROM q),
    y AS (SELECT *, sum(e - s) OVER (PARTITION BY region ORDER BY i) - (e - s) AS o, sum(e - s) OVER (PARTITION BY region) AS n FROM x)"""
_CUT = """, c AS (SELECT y.region, zone, n, s + greatest(lo - o, 0) AS s, s + least(hi - o, e - s) AS e FROM y JOIN z ON z.region = y.region)
    SELECT region, zone, sum(e - s) AS bases, min(s) AS first, max(e) AS last, count(*) AS parts FROM c WHERE e > s GROUP BY region, zone"""


def _summary(m, zones):
    rows = m.select("region", F.explode(F.array(*[F.struct(F.lit(k).alias("zone"), c.alias("b")) for k, c in zones.items()])).alias("z"))
    b = F.col("z.b")
    out = rows.select("region", F.col("z.zone").alias("zone"), bl.total(b).alias("bases"), F.array_min(F.transform(b, lambda x: x["start"])).alias("first"), F.array_max(F.transform(b, lambda x: x["end"])).alias("last"), F.size(b).cast("long").alias("parts"))
    return out.where("parts > 0")


@query(sql("regions", _EXONS + """, t AS (SELECT DISTINCT region, n, least(100, n) AS a, greatest(n - 60, least(100, n)) AS b FROM y),
    z AS (SELECT region, 'left' AS zone, 0 AS lo, a AS hi FROM t UNION ALL SELECT region, 'body', a, b FROM t UNION ALL SELECT region, 'right', b, n FROM t)""" + _CUT))
def m3_chopped_regions(spark, d):
    m = _exons(spark, d)
    z = bl.chop(F.col("exons"), 100, 60)
    return _summary(m, {k: z[k] for k in ("left", "body", "right")})


@query(sql("regions", _EXONS + """, t AS (SELECT DISTINCT region, n // 2 AS m FROM y),
    z AS (SELECT region, 'left' AS zone, m - 100 AS lo, m AS hi FROM t UNION ALL SELECT region, 'right', m, m + 60 FROM t)""" + _CUT))
def m4_chopped_from_middle(spark, d):
    z = bl.chop_middle(F.col("exons"), 100, 60)
    return _summary(_exons(spark, d), {k: z[k] for k in ("left", "right")})


@query(sql("aln", """SELECT sample, chrom, flag & 16 <> 0 AS rev, count(*) AS n, CAST(sum(CASE WHEN flag & 16 <> 0 THEN pos + 3 ELSE pos + 2 END) AS BIGINT) AS s, CAST(sum(CASE WHEN flag & 16 <> 0 THEN "end" - 2 ELSE "end" - 3 END) AS BIGINT) AS e FROM aln WHERE qlen > 5 GROUP BY ALL"""))
def p7_offsets(spark, d):
    rev = F.col("flag").bitwiseAND(F.lit(16)) != 0
    whole = F.array(F.struct(F.col("pos").cast("long").alias("start"), F.col("end").cast("long").alias("end")))
    x = ad.alignments(spark, d).select("sample", "chrom", rev.alias("rev"), bl.offsets(whole, rev, 3, -4).alias("b")).where(F.size("b") > 0)
    return x.groupBy("sample", "chrom", "rev").agg(F.count("*").alias("n"), F.sum(F.col("b")[0]["start"]).alias("s"), F.sum(F.col("b")[0]["end"]).alias("e"))


# ---------------------------------------------------------------- names and sets


@query("""SELECT p_partkey, regexp_replace(regexp_replace('/data/' || p_brand || '.' || p_size || '.bam', '^.*/', ''), '^(.*[^.].*)\\.[^.]*$', '\\1') AS label, CASE WHEN p_size = 1 THEN 'chrM' ELSE 'chr' || p_size END AS chrom FROM part""")
def p17_p18_labels(spark, d):
    t = spark.read.parquet(f"{d}/part.parquet")
    size = F.col("p_size").cast("string")
    path = F.concat(F.lit("/data/"), "p_brand", F.lit("."), size, F.lit(".bam"))
    return t.select("p_partkey", nm.smart_label(path).alias("label"), nm.with_chr(nm.without_chr(F.when(F.col("p_size") == 1, "chrM").otherwise(size))).alias("chrom"))


@query(sql("signal", "SELECT CASE chrom WHEN 'A' THEN 'chrA' ELSE 'chrN' END AS chrom, count(*) AS n, sum(value) AS total FROM signal WHERE chrom IN ('A', 'N') GROUP BY ALL"))
def s22_renamed_chroms(spark, d):
    table = spark.createDataFrame([("A", "chrA"), ("N", "chrN")], "chrom string, name string")
    return nm.rename_chroms(ad.signal(spark, d), table).groupBy("chrom").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


@query(sql("signal", """, u AS (SELECT *, CASE WHEN start <= max("end") OVER (PARTITION BY chrom ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM signal WHERE value < 25),
    i AS (SELECT *, sum(new) OVER (PARTITION BY chrom ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS island FROM u) SELECT chrom, min(start) AS start, max("end") AS "end" FROM i GROUP BY chrom, island"""))
def s24_low_signal_regions(spark, d):
    return iv.merge_intervals(ad.signal(spark, d).where("value < 25").select("chrom", "start", "end"))


@query(sql("regions", """SELECT 'p' || left("group", 1) AS "group", count(*) AS n FROM regions GROUP BY ALL"""))
def u3_u4_relabel_info(spark, d):
    names = {g: f"p{g[0]}" for g in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")}
    return nm.relabel(ad.regions(spark, d), "group", names).groupBy("group").agg(F.count("*").alias("n"))


@query(sql("aln", """, t AS (SELECT DISTINCT sample, chrom FROM aln), f AS (SELECT chrom FROM t WHERE sample = 'F'), o AS (SELECT chrom FROM t WHERE sample = 'O') SELECT chrom, 'F' AS only FROM f WHERE chrom NOT IN (SELECT chrom FROM o) UNION ALL SELECT chrom, 'O' FROM o WHERE chrom NOT IN (SELECT chrom FROM f)"""))
def u5_uncommon_chroms(spark, d):
    t = ad.alignments(spark, d).groupBy("chrom").agg(F.min("sample").alias("only"), F.max("sample").alias("other"))
    return t.where("only = other").select("chrom", "only")


@query(sql("regions", """SELECT chrom, start FROM regions WHERE "group" IN ('1-URGENT', '2-HIGH') EXCEPT SELECT chrom, start FROM regions WHERE "group" = '3-MEDIUM'"""))
def u6_u7_sampling_positions(spark, d):
    r = ad.regions(spark, d).select("group", "chrom", "start")
    extra = r.where("group = '1-URGENT'").union(r.where("group = '2-HIGH'")).select("chrom", "start").distinct()
    return extra.join(r.where("group = '3-MEDIUM'"), ["chrom", "start"], "left_anti")


@query("""SELECT e.vec_id AS region, e.label AS "group", -l.doc_id AS place FROM embeddings e JOIN labels l ON l.doc_id = e.vec_id AND l.quality = e.label""")
def j9_o2_order_by_list(spark, d):
    listed = spark.read.parquet(f"{d}/labels.parquet").select(F.col("doc_id").alias("region"), F.col("quality").alias("group"), (-F.col("doc_id")).alias("place"))
    return ad.vectors(spark, d).select("region", "group").join(listed, ["group", "region"]).orderBy("place")


# ---------------------------------------------------------------- GC correction


_GCTAB = """, w AS (SELECT (l_orderkey + l_partkey) % 101 AS gc, l_suppkey % 2 AS fwd FROM lineitem), t AS (SELECT gc, count(*) FILTER (fwd = 0) AS f, count(*) AS n FROM w GROUP BY gc),
    tab AS (SELECT gc, f, n, CASE WHEN f > 0 AND n > 0 THEN f / n * sum(n) OVER () / sum(f) OVER () ELSE 1 END AS r FROM t), reads AS (SELECT aln.*, (read_id % 101) AS g FROM aln), rr AS (SELECT reads.*, coalesce(tab.r, 1) AS r FROM reads LEFT JOIN tab ON tab.gc = reads.g)"""


def _gc_table(spark, d):
    t = spark.read.parquet(f"{d}/lineitem.parquet").groupBy(((F.col("l_orderkey") + F.col("l_partkey")) % 101).alias("gc")).agg(F.count_if(F.col("l_suppkey") % 2 == 0).alias("f"), F.count("*").alias("n"))
    return qc.gc_ratio(t)


def _gc_reads(spark, d):
    reads = ad.alignments(spark, d).withColumn("gc", F.col("read_id") % 101).withColumnRenamed("pos", "start")
    return gc.with_correction(reads, _gc_table(spark, d))


@query(sql("aln", _GCTAB + """, k AS (SELECT g, r, 1 / r AS v, (read_id * 40503) % 65536 / 65536.0 AS u FROM rr) SELECT g AS yg, round(min(v), 2) AS yc, count(*) AS n, CAST(sum(floor(v) + CASE WHEN u < v - floor(v) THEN 1 ELSE 0 END) AS BIGINT) AS copies FROM k GROUP BY ALL"""))
def p16_p19_j13_copies_and_tags(spark, d):
    return gc.annotate(_gc_reads(spark, d)).groupBy("yg").agg(F.min("yc").alias("yc"), F.count("*").alias("n"), F.sum("yn").alias("copies"))


@query(sql("aln", _GCTAB + """, b AS (SELECT sample, chrom, pos, "end", r, unnest(range(pos // 50, ("end" - 1) // 50 + 1)) AS bin FROM rr) SELECT sample, chrom, bin * 50 AS start, round(sum((least("end", bin * 50 + 50) - greatest(pos, bin * 50)) / r) / 50, 6) AS value FROM b GROUP BY ALL"""))
def a22_corrected_coverage(spark, d):
    return gc.corrected_coverage(_gc_reads(spark, d), 50).withColumn("value", r6("value"))


@query(sql("aln", """, t AS (SELECT count(*) / 300150.0 * 200 AS rate, count(*) AS n FROM aln), k AS (SELECT k, n, sum(exp(k * ln(4 * rate) - 4 * rate - lgamma(k + 1))) OVER (ORDER BY k) AS hi, sum(exp(k * ln(rate / 4) - rate / 4 - lgamma(k + 1))) OVER (ORDER BY k) AS lo FROM t, range(0, 20000) r(k))
    SELECT min(k) FILTER (1 - hi <= 1 / n) AS max_reads, min(k) FILTER (lo >= 1 / n) AS min_reads FROM k"""))
def a20_read_limits(spark, d):
    r = spark.read.parquet(f"{d}/lineitem.parquet").count()
    return spark.createDataFrame([gc.read_limits(r / 300_150 * 200, r)], "max_reads long, min_reads long")


@query()
def a20_a21_gc_limits(spark, d):
    t = spark.read.parquet(f"{d}/lineitem.parquet").agg((F.count("*") / F.lit(300_150.0) * 200).alias("rate")).first().rate
    high, low = gc.read_limits(t, 1_000_000)
    return gc.duplicate_limits(_gc_table(spark, d)).withColumn("max_reads", F.lit(high)).withColumn("min_reads", F.lit(low))


# ---------------------------------------------------------------- statistics and clusters


@query(sql("covfull", """, w AS (SELECT chrom, start, max(CASE WHEN sample = 'F' THEN n END) AS t, max(CASE WHEN sample = 'O' THEN n END) AS c FROM covfull GROUP BY ALL), p AS (SELECT t, count(*) AS n, sum(c) AS c FROM w GROUP BY t),
    k AS (SELECT t, sum(n) OVER (ORDER BY t) AS upto, sum(n) OVER () AS total, sum(t * n) OVER (ORDER BY t) / sum(t * n) OVER () AS p, sum(c) OVER (ORDER BY t) / sum(c) OVER () AS q FROM p),
    b AS (SELECT *, (p + q) / 2 AS m FROM k ORDER BY q - p DESC, t LIMIT 1),
    e AS (SELECT *, CASE WHEN p > 0 THEN p * log2(p / m) ELSE 0 END + CASE WHEN p < 1 THEN (1 - p) * log2((1 - p) / (1 - m)) ELSE 0 END AS ep, CASE WHEN q > 0 THEN q * log2(q / m) ELSE 0 END + CASE WHEN q < 1 THEN (1 - q) * log2((1 - q) / (1 - m)) ELSE 0 END AS eq FROM b)
    SELECT CASE WHEN q - p >= 1e-6 THEN round(100.0 * (total - upto + 1) / total, 6) ELSE 0 END AS percent, CASE WHEN q - p >= 1e-6 THEN round(100.0 * (q - p), 6) ELSE 0 END AS difference, CASE WHEN q - p >= 1e-6 THEN round(sqrt(greatest(0, (ep + eq) / 2)), 6) ELSE 0 END AS divergence FROM e"""))
def q14_chance(spark, d):
    x = qc.chance(coverage_values(spark, d), ["chrom", "start"], "F", "O")
    return x.select(*[r6(c).alias(c) for c in x.columns])


@query()
def q11_q13_poisson_reference(spark, d):
    h = qc.fingerprint(coverage_values(spark, d)).select("sample", "v", "n")
    rows = []
    for s in ("F", "O"):
        mean = h.where(F.col("sample") == s).agg(F.sum(F.col("v") * F.col("n")) / F.sum("n")).first()[0]
        rows.append((s, *qc.poisson_expected(mean), qc.synthetic_jsd(h.where(F.col("sample") == s).select("v", "n"))))
    return spark.createDataFrame(rows, "sample string, auc double, x_intercept double, elbow double, jsd double")


@query(sql("cells", """, k AS (SELECT min(v) AS lo, max(v) AS hi FROM cells), x AS (SELECT "group", bin, CAST(least(20, floor((v - lo) * 20 / (hi - lo)) + 1) AS BIGINT) AS level FROM cells, k WHERE v IS NOT NULL) SELECT "group", CAST(bin AS INT) AS bin, level, count(*) AS n FROM x GROUP BY ALL"""))
def m16_bin_density(spark, d):
    return cl.bin_density(ad.vectors(spark, d), 20)


@query()
def m15_silhouettes(spark, d):
    m = mx.k_means(ad.vectors(spark, d), 3)
    return cl.silhouettes(m).select("region", "cluster", r6("silhouette").alias("silhouette"))
