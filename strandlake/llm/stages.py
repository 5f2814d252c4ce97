"""Whole-table decisions of the operators, as steps of a corpus pipeline: documents in, documents out.

Decisions are taken for a pair of id and text, named by a 64-bit hash, so null ids, different texts under one id and
repeated rows are defined, and no copy of the texts is written; the mixing numbers the rows.  Columns that are added for
a while have names that the table does not have.  Empty tables give empty tables; null and empty texts are kept by the
first three steps, and the mixing takes them as often as its source's whole copies and chance give.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm.common import bounded, drop_staged, stage


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """A staged table of the documents with row numbers, and the name of their column."""
    name = "row"
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    return stage(docs.withColumn(name, F.monotonically_increasing_id()), "numbered"), name


def _named(docs: DataFrame) -> tuple[DataFrame, str]:
    """The documents with a hash of id and text, and the name of its column."""
    name = "hash"
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    return docs.withColumn(name, F.xxhash64(F.col("doc_id").isNull(), F.col("doc_id").cast("long"), F.col("text").isNull(), "text")), name


def _pick(named: DataFrame, name: str, hashes: DataFrame, how: str) -> DataFrame:
    """The rows whose hash is (left_semi) or is not (left_anti) in the one-column table hashes."""
    picked = hashes.toDF("picked_hash")
    return named.join(picked, named[name] == picked["picked_hash"], how)


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without those that the toxicity operator rejects."""
    from strandlake.llm.toxicity import THRESHOLD, fit_toxicity, score_toxicity

    name = "score"
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    return score_toxicity(docs, fit_toxicity(docs, labels), docs.columns, name).where(F.col(name) < THRESHOLD).drop(name)


def keep_one_of_near_copies(docs: DataFrame) -> DataFrame:
    """docs with one row of each component of the n-gram join: that with the smallest id, null ids last; of equal rows one,
    but texts without words are linked with nothing and all stay.
    """
    from strandlake.llm.ngram_join import ngram_components

    named, name = _named(docs)
    found = ngram_components(named.select(F.col(name).alias("doc_id"), "text"))
    comps = stage(found.groupBy(F.col("doc_id").alias("at"), F.col("component_id").alias("comp")).agg(F.count("*").alias("rows"), F.max("n_shingles").alias("n")), "components")
    grouped = comps.groupBy("comp").agg(F.count("*").alias("texts")).where("texts > 1").select("comp")
    spread = 16  # a component may hold a third of all texts
    wide = grouped.withColumn("salt", F.explode(F.array(*map(F.lit, range(spread)))))
    members = comps.withColumn("salt", F.pmod(F.xxhash64("at"), F.lit(spread)).cast("int")).join(wide, ["comp", "salt"], "left_semi").select("at", "comp")
    members = stage(members.join(named.select(F.col(name).alias("at"), "doc_id").distinct(), "at"), "members")
    best = members.groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "at")).alias("m")).select(F.col("m.at").alias("kept"))
    lost = stage(members.select("at").join(best, members["at"] == best["kept"], "left_anti"), "lost")
    again = bounded(comps.where("rows > 1 and n > 0").select("at").join(lost.withColumnRenamed("at", "gone"), F.col("at") == F.col("gone"), "left_anti"))
    others = bounded(lost.union(again).distinct())
    drop_staged(comps)
    once = _pick(named, name, again, "left_semi").dropDuplicates([name])
    return _pick(named, name, others, "left_anti").unionByName(once).drop(name)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    from strandlake.llm.decontaminate import contaminated

    named, name = _named(docs)
    found = contaminated(named.select(F.col(name).alias("doc_id"), "text"), benchmark)
    return _pick(named, name, bounded(found.select("doc_id").distinct()), "left_anti").drop(name)


def mix(docs: DataFrame) -> DataFrame:
    """docs as often as the source mixing takes each."""
    from strandlake.llm.mix_sources import mix_rows

    numbered, row = _numbered(docs)
    copies = bounded(mix_rows(numbered, row).where("copies > 0").select(F.col("row").alias("taken_row"), F.col("copies").alias("taken_copies")))
    taken = numbered.select(F.struct(*numbered.columns).alias("doc")).join(copies, F.col(f"doc.{row}") == F.col("taken_row"))
    return taken.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("taken_copies").cast("int")))).select(*[F.col("doc")[c].alias(c) for c in docs.columns])
