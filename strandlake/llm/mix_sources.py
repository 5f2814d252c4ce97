"""Mixing sources to target weights by Pareto order sampling (DataFrame functions only).

Each source gets a target number of words: its weight's share of the whole, capped at `cap` times its own words, the
excess being shared again by weight (water filling, closed form over the source table).  Within a source, documents get unequal mean numbers of
copies: min(cap, level * score), where a document's score grows with its length (1 + floor(log2(1 + words)) by default, so
long documents are preferred to fragments) and the source's level makes the means add up to the target: documents that
would exceed the cap get the cap for certain, and the level of the others is computed anew.  The whole part of the mean is
allocated to every document (certain copies); the rest is the inclusion probability p of one further copy.  Documents
are ranked by Pareto's variable

    q = (u / (1 - u)) / (p / (1 - p)),    u uniform from a hash of (seed, doc_id, text),

and taken in that order until the source's remaining words are used up (the sample's size is fixed in words); at the end
one document, the one whose size is closest to what is still missing, closes the gap if that brings the total nearer.

Scale: the text is read once and only (row, doc_id, source, size) is kept.  No source is sorted as a whole: ln q is
dealt into CUT_BINS ordered bins of 0.2 % of a source at most, bins are summed with partial aggregation, and only the bin in which the target is reached is
ordered row by row, so a source that holds most rows needs no large task.  Levels are solved on a table with a row for each
source and power of two of the length.  The tables by source are broadcast only up to MAX_BROADCAST_SOURCES rows, else
joined.  Sources are numbered in one task (a short row each).

Defined cases: null text has size 0; null source is a source of its own and stands last; null ids are allowed;
repeated rows are separate documents with one random number, ties going by row; very long texts are counted whole; an empty table gives an empty result; sources without
words have target 0; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlake.llm.common import stage

WORD = r"[^\x20\x09-\x0D]+"
CUT_BINS = 1 << 14
#: ln q lies between -_REACH and _REACH, as u has 52 bits and p below 1e-12 counts as 0.
_REACH = 66.0
MAX_BROADCAST_SOURCES = 20_000


def _bounded(small: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(small) if rows <= MAX_BROADCAST_SOURCES else small


def _targets(by_source: DataFrame, weights: tuple[int, ...], share: float, cap: float) -> DataFrame:
    """Adds weight and target; a source is capped if cap * words / weight lies below the water level."""
    at = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (at % len(weights) + 1).cast("int"))
    t = by_source.withColumn("weight", weight).withColumn("ratio", cap * F.col("words") / F.col("weight"))
    order = Window.orderBy("ratio", F.col("source").isNull(), "source")
    below, every = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    goal = share * F.sum("words").over(every)
    left = goal - F.coalesce(F.sum(cap * F.col("words")).over(below), F.lit(0.0))
    t = t.withColumn("level", left / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(below), F.lit(0.0))))
    t = t.withColumn("level", F.min(F.when(F.col("ratio") >= F.col("level"), F.struct("ratio", "level"))).over(every)["level"])
    return t.select("source", "words", "weight", F.least(cap * F.col("words"), F.coalesce(F.col("level") * F.col("weight"), cap * F.col("words"))).alias("target"))


def _sized(docs: DataFrame, row: Column) -> DataFrame:
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    sized = docs.select(row.alias("row"), "doc_id", "source", size.alias("size"), F.xxhash64("doc_id", "text").alias("key"))
    return stage(sized.withColumn("octave", F.floor(F.log2(F.col("size") + 1.0) + 1e-9).cast("int")), "sizes")


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, seed: int = 20, score: Column | None = None) -> DataFrame:
    """(row, doc_id, size, source_size, target, copies, taken) for every row of docs (doc_id, text, source).

    `score`, a positive expression of `octave` (floor(log2(1 + words))), is what mean numbers of copies are proportional to
    within a source; a constant gives equal ones.  The order of rows in `row` is that of the input read; copies is how often
    the mix takes the document.
    """
    return _mixed(_sized(docs, F.monotonically_increasing_id()), weights, share, cap, seed, score)


def mix_rows(docs: DataFrame, row: str, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, seed: int = 20) -> DataFrame:
    """As mix_sources, for docs that carry unique row numbers of their own in the column `row`."""
    return _mixed(_sized(docs, F.col(row)), weights, share, cap, seed, None)


def _plan(sized: DataFrame, weights: tuple[int, ...], share: float, cap: float, score: Column | None) -> DataFrame:
    """For each source and octave: the source's words and target, certain copies, inclusion probability of one more, words that it is to give."""
    octaves = sized.groupBy("source", "octave").agg(F.sum("size").cast("double").alias("in_octave")).withColumn("score", (score if score is not None else F.col("octave") + 1).cast("double"))
    octaves = stage(octaves, "octaves")
    targets = _targets(octaves.groupBy("source").agg(F.sum("in_octave").alias("words")), weights, share, cap).select(F.col("source").alias("s"), "words", "target")
    t = octaves.join(targets, octaves.source.eqNullSafe(F.col("s"))).drop("s")
    down = Window.partitionBy("source").orderBy(F.desc("score"), "octave")
    over, rest = down.rowsBetween(Window.unboundedPreceding, -1), down.rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy("source")
    t = t.withColumn("level", F.try_divide(F.col("target") - cap * F.coalesce(F.sum("in_octave").over(over), F.lit(0.0)), F.sum(F.col("in_octave") * F.col("score")).over(rest)))
    t = t.withColumn("level", F.max(F.when(F.col("level") * F.col("score") <= cap, F.struct("score", -F.col("octave"), "level"))).over(every)["level"])
    mean = F.when(F.col("target") > 0, F.least(F.lit(cap), F.coalesce(F.col("level") * F.col("score"), F.lit(cap)))).otherwise(F.lit(0.0))
    t = t.withColumn("mean", mean).withColumn("whole", F.floor(F.col("mean") + 1e-12))
    spare = F.col("mean") - F.col("whole")
    t = t.withColumn("p", F.when(spare > 1e-12, spare).otherwise(F.lit(0.0)))
    missing = F.greatest(F.col("target") - F.sum(F.col("whole") * F.col("in_octave")).over(every), F.lit(0.0))
    return t.select(F.col("source").alias("s"), F.col("octave").alias("o"), F.col("words").alias("source_size"), "target", F.col("whole").cast("long").alias("whole"), "p", missing.alias("missing"))


def _mixed(sized: DataFrame, weights: tuple[int, ...], share: float, cap: float, seed: int, score: Column | None) -> DataFrame:
    plan = stage(_plan(sized, weights, share, cap, score), "plan")
    sources = plan.count()

    # v = ln q orders like q; for any p it is a shifted logistic variable, so no bin of v has many rows
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "key"), 12).cast("double") + 0.5) / float(1 << 52)  # below 1
    p = F.col("p")
    ranked = sized.join(_bounded(plan, sources), sized.source.eqNullSafe(F.col("s")) & (sized.octave == F.col("o"))).drop("s", "o")
    ranked = ranked.withColumn("v", F.when(p > 0, F.ln(u) - F.ln(1 - u) - F.ln(p) + F.ln(1 - p)).otherwise(F.lit(2.0 * _REACH)))
    bin_ = F.floor((F.col("v") + _REACH) / (2 * _REACH) * CUT_BINS)
    ranked = ranked.withColumn("bin", F.when(p > 0, F.greatest(F.lit(0), F.least(bin_, F.lit(CUT_BINS - 1)))).otherwise(F.lit(CUT_BINS)).cast("int"))
    ranked = stage(ranked.select("row", "doc_id", "source", "size", "source_size", "target", "whole", "missing", "v", "bin"), "ranked")

    bins = ranked.where(F.col("bin") < CUT_BINS).groupBy("source", "bin").agg(F.sum("size").alias("in_bin"), F.first("missing").alias("missing"))
    upto = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    bins = bins.withColumn("upto", F.sum("in_bin").over(upto))
    cut = bins.where(F.col("upto") > F.col("missing")).groupBy(F.col("source").alias("s")).agg(F.min(F.struct("bin", (F.col("upto") - F.col("in_bin")).alias("before"))).alias("c"))
    cut = stage(cut.select("s", F.col("c.bin").alias("cut"), F.col("c.before").alias("before")), "cuts")

    at = ranked.join(_bounded(cut, sources), ranked.source.eqNullSafe(F.col("s")), "left").drop("s")
    edge = at.where(F.col("bin") == F.col("cut"))
    running = Window.partitionBy("source").orderBy("v", "doc_id", "size", "row").rowsBetween(Window.unboundedPreceding, 0)
    edge = edge.withColumn("upto", F.col("before") + F.sum("size").over(running))
    edge = stage(edge.where(F.col("upto") <= F.col("missing")).select(F.col("row").alias("edge_row"), "source", "size"), "edge")

    # what is still missing in each source, and the one further document that is nearest to it
    end = edge.groupBy(F.col("source").alias("e")).agg(F.sum("size").alias("edge_words"))
    gaps = cut.join(end, F.col("s").eqNullSafe(F.col("e")), "left").select("s", F.col("cut").alias("c"), (F.col("before") + F.coalesce("edge_words", F.lit(0))).alias("used"))
    rest = at.where((F.col("bin") >= F.col("cut")) & (F.col("bin") < CUT_BINS)).join(edge.select("edge_row"), F.col("row") == F.col("edge_row"), "left_anti")
    rest = rest.join(_bounded(gaps, sources), rest.source.eqNullSafe(F.col("s")))
    off = F.abs(F.col("missing") - F.col("used") - F.col("size"))
    last = rest.where(off < F.col("missing") - F.col("used")).groupBy("source").agg(F.min(F.struct(off.alias("off"), "v", "row")).alias("m"))
    chosen = edge.select("edge_row").union(last.select(F.col("m.row")))

    extra = F.when(F.col("cut").isNull(), F.col("bin") < CUT_BINS).otherwise(F.col("bin") < F.col("cut")) | F.col("edge_row").isNotNull()
    out = at.join(chosen, F.col("row") == F.col("edge_row"), "left").withColumn("copies", F.col("whole") + extra.cast("long"))
    return out.select("row", "doc_id", "size", F.col("source_size").cast("long").alias("source_size"), "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
