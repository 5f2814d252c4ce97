"""Benchmark decontamination by spaced-seed hashing (DataFrame functions only).

A mask picks some token positions of a short span and ignores the others, so that a substituted word on an ignored
position leaves the hash as it was.  Hashes of all positions of all texts are joined with those of the benchmark; a hit
fixes a diagonal (document position minus item position), and the words of document and item are compared along all of
it: its best stretch of at least SPAN words, in which at least `num` in `den` agree, is reported.

No such stretch is missed: one of 2 * SPAN words or more can be cut in two of which one meets num/den as well, and in
each of SPAN to 2 * SPAN - 1 words at least one seed is untouched (see `_masks`).

Scale: one pass over the texts for the seeds and one over those with hits; positions are generated lazily in blocks of
BLOCK words, so a long text is never expanded at once, and hashing and probing run in one generated stage.  Hits are
staged as ids and positions; stretches are found by sorting the positions of a diagonal, not by trying all of them.  The
benchmark is broadcast only up to MAX_BROADCAST_WORDS words and the ids of texts with hits only up to MAX_BROADCAST_IDS;
beyond it they are joined by shuffle.

Defined cases: null or empty texts and items match nothing; an item shorter than SPAN matches if all of its words occur
in sequence; rows and items with null ids are ignored; repeated rows and ids count once; further columns are ignored,
whatever their names; num/den has to be above 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlake.llm.common import stage

WORD = r"[^\x20\x09-\x0D]+"
#: Token positions that a seed reads.  Every window of 11 to 21 words of which 80 % agree keeps one of them at least.
MASKS = ((0, 1, 2, 4, 5), (0, 3, 5, 6, 7), (1, 2, 3, 6, 8))
SPAN = 11
BLOCK = 512
MAX_BROADCAST_WORDS = 200_000
MAX_BROADCAST_IDS = 500_000


def _words(text: str) -> Column:
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def _masks(num: int, den: int) -> tuple[tuple[int, ...], ...]:
    """Masks of which every window that meets num/den keeps one; below 80 % a run, as long as must be left between changes."""
    if num * 100 >= 80 * den:
        return MASKS
    need = {n: -(-n * num // den) for n in range(SPAN, 2 * SPAN)}
    return (tuple(range(max(1, min(-(-k // (n - k + 1)) for n, k in need.items())))),)


def _seeds(rows: DataFrame, picks: list[tuple[int, tuple[int, ...]]], keep: list[str]) -> DataFrame:
    """(keep..., pos, hash) for all seeds of the column words; picks are numbered masks."""
    reach = max(mask[-1] for _, mask in picks) + 1
    blocks = F.sequence(F.lit(0), F.floor((F.size("words") - 1) / BLOCK).cast("int"))
    rows = rows.where(F.size("words") > 0).select("*", F.explode(blocks).alias("block"))
    part = F.slice("words", F.col("block") * BLOCK + 1, F.lit(BLOCK + reach - 1))
    rows = rows.withColumn("part", part)
    size = F.least(F.size("part"), F.lit(BLOCK))
    shifted = [F.slice("part", F.lit(j + 1), size).alias(f"t{j}") for j in range(reach)]
    rows = rows.select(*keep, "block", F.posexplode(F.arrays_zip(*shifted)).alias("i", "z"))
    tokens = [F.col("z")[f"t{j}"] for j in range(reach)]
    seeds = [F.when(tokens[mask[-1]].isNotNull(), F.xxhash64(F.lit(no), *[tokens[j] for j in mask])) for no, mask in picks]
    rows = rows.select(*keep, (F.col("block") * BLOCK + F.col("i")).alias("pos"), F.explode(F.array(*seeds)).alias("hash"))
    return rows.where("hash is not null")


def _best_stretches(pairs: DataFrame, num: int, den: int) -> DataFrame:
    """(doc_id, item_id, diag, matched, window) from the words of both: on each diagonal the stretch that meets num/den
    with most agreeing words, and the fewest words that hold them (at least SPAN, or the whole of a shorter item)."""
    lo = F.greatest(F.lit(0), -F.col("diag"))
    n = F.least(F.size("item_words"), F.size("words") - F.col("diag")) - lo
    same = F.zip_with(F.slice("words", lo + F.col("diag") + 1, n), F.slice("item_words", lo + 1, n), lambda x, y: x == y)
    short = F.size("item_words") < SPAN
    least, num = F.least(F.size("item_words"), F.lit(SPAN)), F.when(short, F.lit(den)).otherwise(F.lit(num))
    one = pairs.where(n >= least).select("doc_id", "item_id", "diag", least.alias("least"), num.alias("num"), same.alias("same")).distinct()
    keys = ["doc_id", "item_id", "diag", "text"]  # repeated ids may have several texts
    one = one.select("*", F.xxhash64("same").alias("text"), F.posexplode("same").alias("at", "ok"))
    # Boundary k is the one after word k - 1; boundary 0 has neither matches nor surplus.
    ends = one.select(*keys, "least", "num", (F.col("at") + 1).alias("k"), F.col("ok").cast("int").alias("ok"))
    ends = ends.unionByName(one.where("at = 0").select(*keys, "least", "num", F.lit(0).alias("k"), F.lit(0).alias("ok")))
    ends = ends.withColumn("m", F.sum("ok").over(Window.partitionBy(*keys).orderBy("k").rowsBetween(Window.unboundedPreceding, 0)))
    ends = ends.withColumn("surplus", F.col("m") * den - F.col("k") * F.col("num"))
    # The first boundary from which the stretch up to k meets num/den; it begins at the first agreeing word from there on.
    # For one end it holds the most agreeing words, as these only grow towards the left.
    ends = ends.withColumn("next", F.min(F.when(F.col("ok") == 1, F.col("k") - 1)).over(Window.partitionBy(*keys).orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, -1)))
    ends = ends.withColumn("last", F.max(F.when(F.col("ok") == 1, F.col("k"))).over(Window.partitionBy(*keys).orderBy("k").rowsBetween(Window.unboundedPreceding, 0)))
    ends = ends.withColumn("from", F.min(F.struct("k", "m", "next")).over(Window.partitionBy(*keys).orderBy("surplus").rangeBetween(Window.unboundedPreceding, 0)))
    ends = ends.where(F.col("k") - F.col("from.k") >= F.col("least"))
    found = F.struct((F.col("m") - F.col("from.m")).alias("matched"), (-F.greatest("least", F.col("last") - F.col("from.next"))).alias("less"))
    return ends.groupBy("doc_id", "item_id", "diag").agg(F.max(found).alias("b"))


def contaminated(docs: DataFrame, benchmark: DataFrame, num: int = 80, den: int = 100) -> DataFrame:
    """(doc_id, item_id, matched, window, n_hits): the documents that repeat a passage of a benchmark item.

    docs: doc_id, text.  benchmark: item_id, text.  matched of window words agree in the best stretch, the one with most
    agreeing words; n_hits counts the positions of seeds on the diagonals that have one.
    """
    docs = docs.where("doc_id is not null").select("doc_id", "text")
    items = benchmark.where("item_id is not null").select("item_id", _words("text").alias("item_words")).where(F.size("item_words") > 0).distinct()
    shape = items.agg(F.sum(F.size("item_words")).alias("n"), F.array_sort(F.collect_set(F.when(F.size("item_words") < SPAN, F.size("item_words")))).alias("short")).first()
    bounded, short = (shape.n or 0) <= MAX_BROADCAST_WORDS, list(shape.short or [])  # at most SPAN - 1 lengths

    # A short item has one seed, all of its words; the others have the masks.
    masks, whole = list(enumerate(_masks(num, den))), [(-n, tuple(range(n))) for n in short]
    of = items.withColumnRenamed("item_words", "words")
    theirs = _seeds(of.where(F.size("words") >= SPAN), masks, ["item_id"])
    for pick in whole:
        theirs = theirs.unionByName(_seeds(of.where(F.size("words") == -pick[0]), [pick], ["item_id"]))
    theirs = theirs.select("item_id", F.col("pos").alias("j"), "hash").distinct()
    seeds = _seeds(docs.select("doc_id", _words("text").alias("words")), masks + whole, ["doc_id"])
    hits = seeds.join(F.broadcast(theirs) if bounded else theirs, "hash")
    hits = stage(hits.select("doc_id", "item_id", (F.col("pos") - F.col("j")).alias("diag"), "pos").distinct(), "hits")

    diagonals = hits.select("doc_id", "item_id", "diag").distinct()
    few = F.broadcast if diagonals.count() <= MAX_BROADCAST_IDS else lambda x: x
    pairs = docs.join(few(diagonals.select("doc_id").distinct()), "doc_id", "left_semi").select("doc_id", _words("text").alias("words")).join(few(diagonals), "doc_id")
    best = _best_stretches(pairs.join(F.broadcast(items) if bounded else items, "item_id"), num, den)
    n_hits = hits.join(best.select("doc_id", "item_id", "diag"), ["doc_id", "item_id", "diag"], "left_semi").groupBy("doc_id", "item_id").agg(F.countDistinct("pos").alias("n_hits"))
    out = best.groupBy("doc_id", "item_id").agg(F.max("b").alias("b")).join(n_hits, ["doc_id", "item_id"])
    return out.select("doc_id", "item_id", F.col("b.matched").cast("long").alias("matched"), (-F.col("b.less")).cast("long").alias("window"), "n_hits")
