"""Positional tables from the driver's tables.  Integer arithmetic only, so SQL can mirror it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CHROM_SIZE = 100_050


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _read(spark, sf_dir, "lineitem")
    single, rev = "l_linenumber % 3 = 0", "l_suppkey % 2 = 1"
    t = t.selectExpr(
        "l_linestatus AS sample", "l_returnflag AS chrom", "(l_partkey * 37 + l_orderkey * 11) % 100000 AS pos", "CAST(l_quantity AS INT) AS qlen", "CAST(round(l_discount * 100) AS INT) AS mapq",
        f"CASE WHEN {single} THEN 0 ELSE (100 + l_partkey % 300) * CASE WHEN {rev} THEN -1 ELSE 1 END END AS tlen",
        f"CAST(16 * (l_suppkey % 2) + CASE WHEN {single} THEN 0 ELSE 3 + CASE WHEN {rev} THEN 0 ELSE 32 END + CASE WHEN l_orderkey % 2 = 0 THEN 64 ELSE 128 END END + CASE WHEN l_tax > 0.075 THEN 1024 ELSE 0 END + CASE WHEN l_orderkey % 97 = 0 THEN 4 ELSE 0 END AS INT) AS flag",
        "l_orderkey * 8 + l_linenumber AS read_id",
    )
    t = t.withColumn("end", F.col("pos") + F.col("qlen"))
    mate = F.when(F.col("tlen") == 0, -1).when(F.col("tlen") > 0, F.col("pos") + F.col("tlen") - F.col("qlen")).otherwise(F.col("end") + F.col("tlen"))
    return t.withColumn("mate_pos", mate).withColumn("mate_chrom", F.when(F.col("tlen") == 0, "*").otherwise(F.col("chrom")))


def fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignments(spark, sf_dir).select("sample", "chrom", F.col("pos").alias("start"), "end")


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "orders").selectExpr(
        "element_at(array('A', 'N', 'R'), CAST(o_custkey % 3 + 1 AS INT)) AS chrom", "(o_orderkey * 53) % 100000 AS start",
        "least((o_orderkey * 53) % 100000 + 100 + o_custkey % 900, 100050) AS end", "o_orderpriority AS group", "o_orderkey AS region", "CASE WHEN o_custkey % 2 = 0 THEN '+' ELSE '-' END AS strand",
    )


def blacklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _read(spark, sf_dir, "supplier").selectExpr("s_suppkey * 1000 AS start", "s_suppkey * 1000 + 200 AS end").where("start < 100050")
    return t.withColumn("chrom", F.explode(F.array(*map(F.lit, "ANR"))))


def sizes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(c, CHROM_SIZE) for c in "ANR"], "chrom string, size long")


def samples(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("F",), ("O",)], "sample string")


def signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a track on the chromosomes A, N, R: minutes as positions, at most one value for each."""
    t = _read(spark, sf_dir, "events").selectExpr("element_at(array('A', 'N', 'R'), CAST(user_id % 3 + 1 AS INT)) AS chrom", "(event_id * 17) % 100000 AS start", "CAST(event_id % 50 AS DOUBLE) AS value")
    t = t.groupBy("chrom", "start").agg(F.min("value").alias("value"))
    nxt = F.lead("start", 1, CHROM_SIZE).over(Window.partitionBy("chrom").orderBy("start"))
    return t.withColumn("end", F.least(nxt, F.col("start") + 40)).select("chrom", "start", "end", "value")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "documents").select(F.col("doc_id").alias("chrom"), F.col("text").alias("seq"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as a matrix; negative entries count as missing."""
    t = _read(spark, sf_dir, "embeddings")
    return t.select(F.col("label").alias("group"), F.col("vec_id").alias("region"), F.transform("embedding", lambda x: F.when(x >= 0, x.cast("double"))).alias("bins"))


SQL = {
    "aln0": """SELECT l_linestatus AS sample, l_returnflag AS chrom, (l_partkey * 37 + l_orderkey * 11) % 100000 AS pos, CAST(l_quantity AS INT) AS qlen, CAST(round(l_discount * 100) AS INT) AS mapq,
        CASE WHEN l_linenumber % 3 = 0 THEN 0 ELSE (100 + l_partkey % 300) * CASE WHEN l_suppkey % 2 = 1 THEN -1 ELSE 1 END END AS tlen,
        CAST(16 * (l_suppkey % 2) + CASE WHEN l_linenumber % 3 = 0 THEN 0 ELSE 3 + CASE WHEN l_suppkey % 2 = 1 THEN 0 ELSE 32 END + CASE WHEN l_orderkey % 2 = 0 THEN 64 ELSE 128 END END + CASE WHEN l_tax > 0.075 THEN 1024 ELSE 0 END + CASE WHEN l_orderkey % 97 = 0 THEN 4 ELSE 0 END AS INT) AS flag,
        l_orderkey * 8 + l_linenumber AS read_id, (l_partkey * 37 + l_orderkey * 11) % 100000 + CAST(l_quantity AS INT) AS "end" FROM lineitem""",
    "aln": """SELECT *, CASE WHEN tlen = 0 THEN -1 WHEN tlen > 0 THEN pos + tlen - qlen ELSE "end" + tlen END AS mate_pos, CASE WHEN tlen = 0 THEN '*' ELSE chrom END AS mate_chrom, CASE WHEN tlen <> 0 THEN abs(tlen) ELSE qlen END AS frag_len FROM aln0""",
    "regions": """SELECT ['A', 'N', 'R'][o_custkey % 3 + 1] AS chrom, (o_orderkey * 53) % 100000 AS start, least((o_orderkey * 53) % 100000 + 100 + o_custkey % 900, 100050) AS "end", o_orderpriority AS "group", o_orderkey AS region, CASE WHEN o_custkey % 2 = 0 THEN '+' ELSE '-' END AS strand FROM orders""",
    "blacklist": """SELECT chrom, s_suppkey * 1000 AS start, s_suppkey * 1000 + 200 AS "end" FROM supplier, (VALUES ('A'), ('N'), ('R')) c(chrom) WHERE s_suppkey * 1000 < 100050""",
    "sizes": "SELECT chrom, 100050 AS size FROM (VALUES ('A'), ('N'), ('R')) c(chrom)",
    "sig0": """SELECT ['A', 'N', 'R'][user_id % 3 + 1] AS chrom, (event_id * 17) % 100000 AS start, min(CAST(event_id % 50 AS DOUBLE)) AS value FROM events GROUP BY ALL""",
    "signal": """SELECT chrom, start, least(lead(start, 1, 100050) OVER (PARTITION BY chrom ORDER BY start), start + 40) AS "end", value FROM sig0""",
    "matrix": """SELECT label AS "group", vec_id AS region, list_transform(embedding, lambda x: CASE WHEN x >= 0 THEN CAST(x AS DOUBLE) END) AS bins FROM embeddings""",
    "cells": """SELECT "group", region, unnest(bins) AS v, unnest(range(64)) AS bin FROM matrix""",
    "cov": """SELECT sample, chrom, bin * 50 AS start, count(*) AS n FROM (SELECT sample, chrom, unnest(range(pos // 50, ("end" - 1) // 50 + 1)) AS bin FROM aln) GROUP BY ALL""",
    "dom": """SELECT chrom, CAST(start AS BIGINT) AS start, least(start + 50, 100050) AS "end" FROM sizes, range(0, 100050, 50) r(start)""",
    "covfull": """SELECT s.sample, d.chrom, d.start, d."end", coalesce(c.n, 0) AS n FROM dom d CROSS JOIN (VALUES ('F'), ('O')) s(sample) LEFT JOIN cov c ON c.sample = s.sample AND c.chrom = d.chrom AND c.start = d.start""",
    "merged": """SELECT chrom, min(start) AS start, max("end") AS "end" FROM (SELECT *, sum(new) OVER (PARTITION BY chrom ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS island FROM (
        SELECT chrom, start, "end", CASE WHEN start <= max("end") OVER (PARTITION BY chrom ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM blacklist)) GROUP BY chrom, island""",
}
_NEEDS = {"aln": ["aln0"], "signal": ["sig0"], "cells": ["matrix"], "cov": ["aln"], "dom": ["sizes"], "covfull": ["dom", "cov"], "merged": ["blacklist"]}


def with_tables(names: str, query: str) -> str:
    """SQL with the named tables (and those they need) as CTEs."""
    order: list[str] = []

    def add(n: str) -> None:
        for x in _NEEDS.get(n, []):
            add(x)
        if n not in order:
            order.append(n)

    for n in names.split():
        add(n)
    return "WITH " + ", ".join(f"{n} AS ({SQL[n]})" for n in order) + " " + query
