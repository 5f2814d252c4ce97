"""License scan, pipeline stages and the whole pipeline against plain versions."""

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

WORD = re.compile("[^\x20\x09-\x0d]+")


def _lower(t):
    return (t or "").translate({c: c + 32 for c in range(65, 91)})


def _shingles(t):
    w = WORD.findall(_lower(t))
    return {tuple(w[j : j + 5]) for j in range(len(w) - 4)} or ({tuple(w)} if w else set())


def _components(texts):
    """For each text the smallest position that it reaches by links of 80 %."""
    sets = [_shingles(t) for t in texts]
    comp = list(range(len(sets)))
    links = [(a, b) for a in range(len(sets)) for b in range(a) if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    while True:
        was = list(comp)
        for a, b in links:
            comp[a] = comp[b] = min(comp[a], comp[b])
        if comp == was:
            return comp


def _one_of_each(rows):
    """Of rows (doc_id, text) that of each component with the smallest id, null ids last, then the first."""
    groups = {}
    for k, c in enumerate(_components([t for _, t in rows])):
        groups.setdefault(c, []).append(k)
    return [rows[min(g, key=lambda k: (rows[k][0] is None, rows[k][0] or 0, k))] for g in groups.values()]


def _stretch(x, y, span=11):
    """Whether 80 % agree in an aligned stretch of two word lists (all words of an item below the span)."""
    at = {}
    for j, w in enumerate(y):
        at.setdefault(w, []).append(j)
    diags = Counter(p - j for p, w in enumerate(x) for j in at.get(w, ()))
    for diag, hits in diags.items():
        if len(y) < span:
            if hits == len(y) and x[diag : diag + len(y)] == y and diag >= 0:
                return True
            continue
        if hits * 5 < 4 * span:
            continue
        sums = [0]
        for j in range(max(0, -diag), min(len(y), len(x) - diag)):
            sums.append(sums[-1] + (5 if x[diag + j] == y[j] else 0) - 4)
        least = float("inf")
        for b in range(span, len(sums)):
            least = min(least, sums[b - span])
            if sums[b] >= least:
                return True
    return False


def test_license_recall(spark):
    """Templates planted at every offset of a window with 80 to 100 % of their words: found wherever plain containment finds them."""
    from strandlake.llm.license_scan import TEMPLATES, scan_licenses

    rnd = random.Random(12)

    def plain_words(t):
        out = []
        for w in WORD.findall(_lower(t)):
            w = re.sub(r"^[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+|[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+$", "", w)
            out += [w] if w else []
        return out

    def shingles(words):
        return {tuple(words[j : j + 5]) for j in range(len(words) - 4)}

    rows = []
    for name in sorted(TEMPLATES):
        words = TEMPLATES[name].split()
        for k in range(24):
            w = list(words)
            for j in rnd.sample(range(len(w)), min(len(w) // 5, int(len(w) * 0.04 * (k % 6) / 5))):
                w[j] = f"changed{j}"
            rows.append((len(rows), " ".join([f"f{rnd.randrange(10**6)}" for _ in range(rnd.randrange(0, 300))] + w + [f"f{rnd.randrange(10**6)}" for _ in range(rnd.randrange(0, 80))])))
    rows += [(len(rows), None), (None, TEMPLATES["mit"]), (len(rows), TEMPLATES["mit"]), (len(rows), TEMPLATES["mit"]), (len(rows), "word " * 50_000)]
    wanted = {n: shingles(plain_words(t)) for n, t in TEMPLATES.items()}
    want = set()
    for i, t in rows:
        have = shingles(plain_words(t))
        want |= {(i, n) for n, s in wanted.items() if 100 * len(s & have) >= 80 * len(s)}
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("license", F.lit("x")).withColumn("total", F.lit(1)).repartition(4)
    got = {(r.doc_id, r.license) for r in scan_licenses(frame).collect()}
    assert got <= want and len(want) > 200
    assert len(got & want) >= 0.99 * len(want), sorted(want - got, key=str)[:20]


def test_stages_take_decisions_by_row(spark):
    """Null and repeated ids, repeated rows, clashing column names, empty tables."""
    from strandlake.llm import stages

    rnd = random.Random(2)

    def text(n):
        return " ".join(f"{rnd.choice('abcdefgh')}{rnd.randrange(40)}" for _ in range(n))

    base = [text(60) for _ in range(12)]
    rows = [(i, t) for i, t in enumerate(base)] + [(i + 20, t + " end") for i, t in enumerate(base[:4])]
    rows += [(None, base[5]), (None, "a text with a null id that nothing else resembles"), (None, "a text with a null id that nothing else resembles"), (None, None), (None, None), (3, "another text under an id that is there already"), (9, base[2]), (40, ""), (41, ""), (42, None)]
    names = ["row", "ROW_", "gone", "at", "comp", "copy", "doc", "taken_row", "taken_copies", "score", "salt"]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({n: F.lit(n) for n in names}).withColumn("source", F.lit("s")).coalesce(1)
    kept = stages.keep_one_of_near_copies(docs)
    assert kept.columns == docs.columns
    found = kept.collect()
    assert Counter((r.doc_id, r.text) for r in found) == Counter(_one_of_each(rows)) and all(r[n] == n for r in found for n in names)

    item = text(30)
    marked = docs.union(spark.createDataFrame([(None, text(50) + " " + item), (3, item), (77, item[: len(item) // 4])], "doc_id long, text string").withColumns({n: F.lit(n) for n in names}).withColumn("source", F.lit("s")))
    out = stages.drop_contaminated(marked, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert out.columns == docs.columns and Counter((r.doc_id, r.text) for r in out.collect()) == Counter([*rows, (77, item[: len(item) // 4])])

    mixed = stages.mix(docs)
    assert mixed.columns == docs.columns
    times = Counter((r.doc_id, r.text) for r in mixed.collect())
    there = Counter(rows)
    assert all(there[k] * 2 >= n for k, n in times.items())
    for f in (stages.keep_one_of_near_copies, stages.mix, lambda d: stages.drop_contaminated(d, spark.createDataFrame([(1, item)], "item_id long, text string"))):
        nothing = f(docs.limit(0))
        assert nothing.columns == docs.columns and nothing.count() == 0


def test_pipeline_against_a_plain_version(spark):
    """Each stage on its own input: decisions as plain code takes them, and the ids as the library gives them."""
    pipeline = pytest.importorskip("corpus_pipeline")
    import public_tokenizers
    from tokenizers import Tokenizer

    from strandlake.llm.common import stage, table
    from strandlake.llm.toxicity import toxicity

    d = "/root/testdata/sf0.001"
    docs = table(spark, d, "documents")
    items = [WORD.findall(_lower(r.text)) for r in table(spark, d, "benchmark").collect() if r.text]
    for name, f in pipeline.STAGES:
        rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
        out = stage(f(spark, docs, d), name)
        if name == "token_binary":
            lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
            start, want = 0, []
            for i, t, _ in sorted(rows, key=lambda r: (r[0], r[1])):
                ids = [*lib.encode(t or "", add_special_tokens=False).ids, 2]
                want.append((i, start, len(ids), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids))))
                start += len(ids)
            assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in out.collect()) == sorted(want)
            continue
        assert out.columns == docs.columns
        got = Counter((r.doc_id, r.text, r.source) for r in out.collect())
        if name == "toxicity":
            scores = {r.doc_id: r.score for r in toxicity(docs, table(spark, d, "labels")).collect()}
            assert got == Counter(r for r in rows if scores[r[0]] < 0.7)
        elif name == "ngram_join":
            assert Counter((k[0], k[1]) for k in got.elements()) == Counter(_one_of_each([r[:2] for r in rows]))
        elif name == "decontaminate":
            assert got == Counter(r for r in rows if not any(_stretch(WORD.findall(_lower(r[1])), y) for y in items))
        else:
            size = {k: len(WORD.findall(k[1] or "")) for k in rows}
            assert set(got) <= set(rows) and max(got.values()) <= 2
            assert abs(sum(size[k] * n for k, n in got.items()) - 1.5 * sum(size.values())) <= 0.02 * sum(size.values()) + max(size.values())
        docs = out
