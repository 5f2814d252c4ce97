"""Each operator against a plain version, and the defined cases: nulls, empty and repeated rows, empty tables, odd columns."""

import hashlib
import itertools
import os
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

WORD = re.compile("[^\x20\x09-\x0d]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def _text(rnd, n):
    return " ".join(rnd.choice(["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta", "iota", "kappa"]) + str(rnd.randrange(30)) for _ in range(n))


def _docs():
    rnd = random.Random(3)
    base = [_text(rnd, rnd.choice([3, 12, 60, 200])) for _ in range(30)]
    out = [*base, base[2], base[2], None, "", "  \n", "Only four words here", "x " * 3000]
    for t in base[:12]:
        w = t.split()
        w[len(w) // 2] = "changed"
        out.append(" ".join(w))
    return [(i, t, "en", None if i % 7 == 0 else f"s{i % 3}", len(t or "")) for i, t in enumerate(out)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(_docs(), DOCS).withColumn("text_", F.lit("x")).withColumn("size", F.lit(1)).withColumn("row", F.lit(2))


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_ngram_components(spark, docs, empty):
    from strandlake.llm.ngram_join import ngram_components

    sets = {}
    for i, t, *_ in _docs():
        w = WORD.findall((t or "").lower())
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} or ({tuple(w)} if w else set())
    comp = {i: i for i in sets}
    for _ in range(len(sets)):
        for a in sets:
            for b in sets:
                if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    comp[a] = comp[b] = min(comp[a], comp[b])
        if all(comp[comp[i]] == comp[i] for i in comp):
            break
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_components(docs).collect()}
    assert got == {i: (len(sets[i]), comp[i]) for i in sets}
    assert ngram_components(empty).count() == 0


def _components_by_pairs(texts):
    """(size of the set, smallest id reachable) by comparing all pairs of rows (id, text); rows with a null id link with nothing."""
    sets = []
    for _, t in texts:
        w = WORD.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets.append({tuple(w[j : j + 5]) for j in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    comp = [i for i, _ in texts]
    links = [(a, b) for a in range(len(texts)) for b in range(a) if sets[a] and None not in (comp[a], comp[b]) and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    for _ in texts:
        was = list(comp)
        for a, b in links:
            comp[a] = comp[b] = min(comp[a], comp[b])
        if comp == was:
            break
    return sorted(((i, len(s), c) for (i, _), s, c in zip(texts, sets, comp, strict=True)), key=str)


def test_ngram_components_near_the_threshold(spark, monkeypatch):
    """A large group of near copies with outliers: lists cut into parts, null and repeated ids, ties, repeated rows."""
    from strandlake.llm import ngram_join as nj

    rnd = random.Random(11)
    base = [f"w{i}" for i in range(110)]
    rows = []
    for i in range(90):
        w = list(base)
        for j in rnd.sample(range(110), rnd.choice([1, 1, 1, 2, 2, 3, 4])):
            w[j] = f"x{i}-{j}"
        rows.append((i, " ".join(w)))
    rows += [(100, rows[3][1]), (101, rows[3][1]), (101, rows[3][1]), (None, rows[3][1]), (None, None), (102, ""), (103, "a b"), (104, "A  B"), (103, "quite another text under the id of the one before")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("h", F.lit(1)).withColumn("sid", F.lit("x")).repartition(5)
    want = _components_by_pairs(rows)
    assert len({c for *_, c in want}) > 8
    monkeypatch.setattr(nj, "SPLIT", 16)
    assert sorted((tuple(r) for r in nj.ngram_components(frame).collect()), key=str) == want


def test_repeats(spark, docs, empty):
    from strandlake.llm.repeat_bytes import LENGTH, remove_repeats

    raw = {i: (t or "").encode() for i, t, *_ in _docs()}
    seen = {}
    for b in raw.values():
        for j in range(len(b) - LENGTH + 1):
            seen[b[j : j + LENGTH]] = seen.get(b[j : j + LENGTH], 0) + 1
    want = {}
    for i, b in raw.items():
        cut = bytearray(len(b))
        for j in range(len(b) - LENGTH + 1):
            if seen[b[j : j + LENGTH]] > 1:
                cut[j : j + LENGTH] = b"\1" * LENGTH
        spans = sum(1 for j in range(len(b)) if cut[j] and (j == 0 or not cut[j - 1]))
        want[i] = (len(b), sum(cut), spans, hashlib.sha256(bytes(x for x, y in zip(b, cut, strict=True) if not y)).hexdigest())
    assert {r[0]: tuple(r[1:]) for r in remove_repeats(docs).collect()} == want
    assert any(0 < v[1] < v[0] for v in want.values())
    assert remove_repeats(empty).count() == 0


def test_token_blocks(spark, docs, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    from strandlake.llm import token_binary as tb

    rnd = np.random.default_rng(1)
    for ids in (np.zeros(0), np.array([5]), rnd.integers(0, 50_257, 3000), rnd.zipf(1.3, 20_000) % 50_257, np.full(9000, 7)):
        block = tb.encode_block(ids.astype(np.uint32))
        assert (tb.decode_block(block) == ids).all()
    broken = bytearray(block)
    broken[-1] ^= 1
    with pytest.raises(ValueError):
        tb.decode_block(bytes(broken))
    path = public_tokenizers.path("byte_bpe_50k.json")
    lib, start, want = Tokenizer.from_file(path), 0, {}
    for i, t, *_ in _docs():
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 2]
        want[i] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in tb.token_binary(docs, path).collect()} == want
    assert tb.token_binary(empty, path).count() == 0


def test_pieces_equal_whole_texts():
    import public_tokenizers

    from strandlake.llm.token_binary import Encoder

    e = Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["", " ", "a  b\n\n c's don't <|endoftext|> x", "été 日本   x\t\r\nx", "1 234,5%%% ²½ é", "tab\tend   "]
    assert [np.frombuffer(x, "<u4").tolist() for x in e.ids(texts)] == [e.lib.encode(t, add_special_tokens=False).ids for t in texts]


def test_shards(spark, docs, empty):
    from strandlake.llm.shard_pack import CapacityTree, best_fit, shard_documents

    tree = CapacityTree()
    for k in ((5, 1), (3, 2), (9, 3)):
        tree.add(k)
    assert tree.take_tightest(4) == (5, 1) and tree.take_tightest(10) is None and tree.take_tightest(1) == (3, 2)
    assert best_fit([6, 5, 4, 3, 2], 10) == [0, 1, 0, 1, 1]
    got = shard_documents(docs, 5).toPandas()
    text = {i: t for i, t, *_ in _docs()}
    assert len(got) == len(text) and (got["size"] == [len((text[i] or "").encode()) + 16 for i in got.doc_id]).all()
    by_text = got.assign(t=[repr(text[i]) for i in got.doc_id]).groupby("t").shard.nunique()
    assert (by_text == 1).all()
    assert all(sorted(g) == list(range(len(g))) for _, g in got.groupby("shard").slot)
    assert shard_documents(empty).count() == 0


def test_mix(spark, docs, empty):
    from strandlake.llm.mix_sources import mix_sources

    got = mix_sources(docs).toPandas()
    again = mix_sources(docs.repartition(3)).toPandas()
    assert sorted(zip(got.doc_id, got.taken, strict=True)) == sorted(zip(again.doc_id, again.taken, strict=True))
    size = {i: len(WORD.findall(t or "")) for i, t, *_ in _docs()}
    assert (got["size"] == [size[i] for i in got.doc_id]).all() and (got.taken <= 2 * got["size"]).all()
    source = {i: s for i, _, _, s, _ in _docs()}
    names = sorted({s for s in source.values() if s}) + [None]
    words = {s: sum(size[i] for i in size if source[i] == s) for s in names}
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, left, open_ = dict.fromkeys(names, 0.0), 1.5 * sum(words.values()), set(names)
    while True:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 2 * words[s]}
        if not full:
            break
        for s in full:
            target[s] = 2.0 * words[s]
            left -= target[s]
        open_ -= full
    target |= {s: level * weight[s] for s in open_}
    for r in got.itertuples():
        assert abs(r.target - target[source[r.doc_id]]) < 1e-6
    for s in names:
        assert abs(got.taken[[source[i] == s for i in got.doc_id]].sum() - target[s]) <= max(size.values())
    assert mix_sources(empty).count() == 0


def test_mix_inclusion(spark):
    """Documents of a source are taken with unequal chances: over many seeds as often as the plan says, never beyond the cap."""
    from strandlake.llm import mix_sources as ms

    rnd = random.Random(6)
    sizes = [rnd.choice([1, 3, 7, 15, 40, 100]) for _ in range(600)]
    sizes = {i: n for i, n in enumerate(sizes)}
    rows = [(i, "w " * n, "a" if i % 3 else "b") for i, n in sizes.items()]
    rows += [(None, None, "a"), (None, "x", None), (None, "x", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("octave", F.lit("x")).withColumn("key", F.lit(1)).withColumn("level", F.lit(1)).cache()
    seeds = 8
    taken = dict.fromkeys(sizes, 0)
    for seed in range(seeds):
        out = ms.mix_sources(docs, seed=seed).collect()
        assert len(out) == len(rows) and all(r.taken <= 2 * r.size for r in out)
        for s in {r.target for r in out}:
            own = [r for r in out if r.target == s]
            assert abs(sum(r.taken for r in own) - s) <= 100
        for r in out:
            if r.doc_id is not None:
                taken[r.doc_id] += r.copies
        target = {rows[r.doc_id][2]: r.target for r in out if r.doc_id is not None}
    for s in "ab":
        own = [i for i in sizes if rows[i][2] == s]
        score = {n: 1 + (n + 1).bit_length() - 1 for n in set(sizes.values())}
        lo, hi = 0.0, 100.0  # the level by bisection
        for _ in range(100):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if sum(min(2.0, mid * score[sizes[i]]) * sizes[i] for i in own) < target[s] else (lo, mid)
        means = {}
        for n in score:
            of = [i for i in own if sizes[i] == n]
            want = min(2.0, lo * score[n])
            means[n] = want
            got = sum(taken[i] for i in of) / len(of) / seeds
            assert abs(got - want) < 0.03 + 4 * (0.25 / (len(of) * seeds)) ** 0.5, (s, n, got, want)
        assert len({round(m, 6) for m in means.values()}) > 2


def test_contaminated(spark, empty):
    from strandlake.llm import decontaminate as dc

    rnd = random.Random(5)
    item = _text(rnd, 40).split()
    changed = [w if k % 9 else "other" for k, w in enumerate(item)]
    rows = [(1, _text(rnd, 600) + " " + " ".join(item) + " " + _text(rnd, 30)), (2, _text(rnd, 700)), (3, " ".join(changed)), (4, None), (5, ""), (6, _text(rnd, 20) + " tiny item text " + _text(rnd, 5)), (None, " ".join(item))]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("item_id", F.lit(9)).withColumn("pos", F.lit(1))
    b = spark.createDataFrame([(7, " ".join(item)), (8, "tiny item text"), (9, None), (10, "")], "item_id long, text string")
    want = {(1, 7), (3, 7), (6, 8)}
    assert {(r.doc_id, r.item_id) for r in dc.contaminated(d, b).collect()} == want
    old, dc.MAX_BROADCAST_WORDS = dc.MAX_BROADCAST_WORDS, 0
    try:
        assert {(r.doc_id, r.item_id) for r in dc.contaminated(d, b).collect()} == want
    finally:
        dc.MAX_BROADCAST_WORDS = old
    assert dc.contaminated(empty, b).count() == 0 and dc.contaminated(d, b.limit(0)).count() == 0
    assert all(any(k not in m for m in dc.MASKS) for k in range(dc.SPAN))


def _stretch(x, y, span=11):
    """(matched, window) of the best aligned stretch of two word lists of which 80 % agree, by trying all; or None."""
    best = (0, 0)
    for diag in {p - j for p, v in enumerate(x) for j, w in enumerate(y) if v == w}:
        same = [x[diag + j] == y[j] for j in range(max(0, -diag), min(len(y), len(x) - diag))]
        for a in range(len(same)):
            for b in range(a + span, len(same) + 1):
                if sum(same[a:b]) * 5 >= 4 * (b - a):
                    best = max(best, (sum(same[a:b]), a - b))
    return (best[0], -best[1]) if best[0] else None


def test_contaminated_stretches(spark):
    """Passages from inside longer items in longer documents, with any placing of the changed words that num/den allows."""
    from strandlake.llm import decontaminate as dc

    rnd = random.Random(8)
    items = [[f"i{i}w{k}" for k in range(n)] for i, n in enumerate((60, 48, 11))]
    cases = [(0, lo, n, ()) for n in range(9, 22) for lo in (0, 20, 60 - n)]
    cases += [(1, rnd.choice([0, 4, 48 - n]), n, rnd.sample(range(n), n // 5 + more)) for n in (11, 14, 15, 16, 19, 20, 21, 40) for more in (0, 0, 0, 0, 0, 0, 1, 2)]
    cases += [(2, 0, 11, (3, 7)), (2, 0, 11, (3, 5, 7)), (1, 20, 15, (4, 7, 10)), (1, 20, 20, (4, 8, 12, 15))]
    docs = []
    for i, lo, n, changed in cases:
        at = rnd.choice([0, 1, 30, 40])
        words = [f"c{k}" if k in changed else w for k, w in enumerate(items[i][lo : lo + n])]
        docs.append([f"d{k}" for k in range(at)] + words + [f"e{k}" for k in range(40 - at)])
    want = {(d, i): found for d, x in enumerate(docs) for i, y in enumerate(items) if (found := _stretch(x, y))}
    d = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(docs)], "doc_id long, text string")
    b = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string")
    assert {(r.doc_id, r.item_id): (r.matched, r.window) for r in dc.contaminated(d, b).collect()} == want
    for n in range(dc.SPAN, 2 * dc.SPAN):
        for gone in itertools.combinations(range(n), n // 5):
            assert any(all(s + k not in gone for k in mask) for mask in dc.MASKS for s in range(n - mask[-1]))


def test_vectors(spark):
    from strandlake.llm.vector_join import vector_components

    rnd = np.random.default_rng(2)
    x = rnd.normal(size=(60, 8))
    x[10], x[11], x[12] = x[3], x[3] * 2, x[4] + 0.05 * rnd.normal(size=8)
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(60, None), (61, [0.0] * 8), (62, [float("nan")] * 8), (63, [None, *[1.0] * 7]), (64, [1.0]), (None, [1.0] * 8)]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vector_components(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    m = u @ u.T >= 0.95
    np.fill_diagonal(m, False)
    assert all(got[i][0] == m[i].sum() for i in range(60))
    assert got[11][1] == 3 and got[12][1] == 4 and not got[10][2] and all(got[i] == (0, i, True) for i in (60, 61, 62, 63, 64))
    assert vector_components(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_vectors_in_many_blocks(spark, monkeypatch):
    """Clustered vectors in many blocks and tiles against all pairs; repeated ids, null ids, further columns."""
    from strandlake.llm import vector_join as vj

    rnd = np.random.default_rng(3)
    centres = rnd.normal(size=(60, 12))
    x = np.concatenate([c + rnd.normal(size=(n, 12)) * 0.12 for c, n in zip(centres, rnd.integers(1, 30, 60), strict=True)])
    x[5], x[17] = x[6], x[18] * 3
    rows = [(int(i), [float(v) for v in r]) for i, r in enumerate(x)]
    frame = spark.createDataFrame([*rows, (None, rows[0][1]), (len(rows), None)], "vec_id long, embedding array<double>").withColumn("node", F.lit(1)).withColumn("copies", F.lit("x")).repartition(3)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = unit @ unit.T >= 0.95
    np.fill_diagonal(link, False)
    comp = np.arange(len(x))
    for _ in range(len(x)):
        new = np.minimum(comp, np.where(link, comp[None, :], len(x)).min(1))
        if (new == comp).all():
            break
        comp = new
    monkeypatch.setattr(vj, "BLOCK_VECTORS", 16)
    monkeypatch.setattr(vj, "TILE", 3)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vj.vector_components(frame).collect()}
    assert got == {i: (int(link[i].sum()), int(comp[i]), bool(comp[i] == i)) for i in range(len(x))} | {None: (0, None, False), len(x): (0, len(x), True)}


def test_best_fit_decreasing():
    """The balanced tree gives what a linear scan for the tightest bin gives."""
    from strandlake.llm.shard_pack import CapacityTree

    rnd = random.Random(5)
    for _ in range(30):
        sizes, tree, plain = sorted((rnd.randrange(1, 60) for _ in range(200)), reverse=True), CapacityTree(), []
        bins = 0
        for n in sizes:
            found, want = tree.take_tightest(n), min((c for c in plain if c >= n), default=None)
            assert (found[0] if found else None) == want
            if want is None:
                found, bins = (100, bins), bins + 1
            else:
                plain.remove(want)
            if found[0] > n:
                tree.add((found[0] - n, found[1]))
                plain.append(found[0] - n)


def test_toxicity(spark, docs, empty):
    from strandlake.llm.toxicity import isotonic, toxicity

    rnd = random.Random(8)
    rows = [(i, _text(rnd, 50) + (" you stupid idiot" if i % 4 == 0 else " fine"), i % 4 == 0) for i in range(400)]
    d = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(1000, None), (1001, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(x)) for i, _, x in rows], "doc_id long, quality int, toxic int")
    got = toxicity(d, labels).toPandas().set_index("doc_id")
    assert got.score.between(0, 1).all() and (got.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in got.index]).all()
    held = [i for i, _, _ in rows if got.held_out[i]]
    assert np.mean([got.predicted[i] == int(rows[i][2]) for i in held]) > 0.95
    assert toxicity(empty, labels).count() == 0 and toxicity(docs, labels.limit(0)).where("predicted = 1").count() == 0
    assert (np.diff(isotonic(np.arange(20.0), (np.arange(20) % 3 == 0).astype(float))[1]) >= 0).all()


def test_licenses(spark, docs, empty):
    from strandlake.llm.license_scan import TEMPLATES, scan_licenses

    rnd = random.Random(4)
    mit = TEMPLATES["mit"].split()
    rows = [(1, _text(rnd, 100) + "\n# " + "\n# ".join(" ".join(mit[i : i + 9]) for i in range(0, len(mit), 9)) + "\n" + _text(rnd, 50)), (2, _text(rnd, 300)), (3, "licensed UNDER the MIT license"), (4, " ".join(mit[:20])), (5, None)]
    got = {(r.doc_id, r.license) for r in scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, "mit"), (3, "mit-licensed")}
    assert scan_licenses(empty).count() == 0 and scan_licenses(docs).count() == 0
    with pytest.raises(ValueError):
        scan_licenses(docs, {"short": "too short"})


def test_html(spark):
    from strandlake.llm.html_text import extract_text, render

    page = """<!DOCTYPE html><title>t</title><style>.x{display:none}</style><p>One &amp; two<p>Three<br>four
    <ul><li>a<li>b<ol start=3><li>c</ol></ul><div class=x>no</div><div hidden>no</div><span style="display: none">no</span>
    <table><tr><th>k<th>value<tr><td>longer<td>1</table><pre>  x
  y</pre><script>if (a<b) {}</script>end"""
    assert render(page) == "One & two\n\nThree\nfour\n\n- a\n- b\n    3. c\n\nk       value\nlonger  1\n\n  x\n  y\n\nend"
    assert render("a < b <unclosed") == "a < b <unclosed" and render("<div>" * 3000 + "x") == "x"
    rows = spark.createDataFrame([(1, page), (2, None), (3, "")], "page_id long, html string")
    assert {r.page_id: r.text for r in extract_text(rows).collect()} == {1: render(page), 2: "", 3: ""}


def test_html_depth_spans_and_values():
    """No depth changes what is seen; cells span columns and rows; list items have values."""
    from strandlake.llm.html_text import render

    for n in (2, 9, 500):
        assert render("<p>a" + n * "<b>" + "x<div>y</div>z") == "ax\n\ny\nz"
    for n in (100, 1000, 50_000):
        assert render(n * "<div>" + "<div style='display:none'>no</div>seen") == "seen"
    grid = "<table><tr><td rowspan=2>a<td>b<td>c<tr><td>dd<td>e<tr><td colspan=2>wide<td>f</table>"
    assert render(grid) == "a  b   c\n   dd  e\nwide   f"
    assert render("<table><tr><td rowspan=0>a<td>b<tr><td>c<tr><td>d</table>") == "a  b\n   c\n   d"
    assert render("<ol><li value=5>x<li>y</ol>") == "5. x\n6. y"


def test_html_table(spark):
    """Null ids, repeated rows, an empty table, columns with clashing names, a very long page."""
    from strandlake.llm.html_text import extract_text

    long = "<p>word</p>" * 20_000
    frame = spark.createDataFrame([(None, "<p>a", "t"), (1, "<p>a", "t"), (1, "<p>a", "t"), (2, long, None)], "page_id long, html string, text string")
    got = sorted(((r.page_id, r.text) for r in extract_text(frame).collect()), key=str)
    assert got == sorted([(None, "a"), (1, "a"), (1, "a"), (2, "\n\n".join(["word"] * 20_000))], key=str)
    assert extract_text(frame.limit(0)).count() == 0


def test_html_against_the_standard_parser():
    """On plain markup the words are those that the standard library's parser hands out, in order."""
    from html.parser import HTMLParser

    from strandlake.llm.html_text import render

    class Words(HTMLParser):
        def __init__(self):
            super().__init__()
            self.words, self.skip = [], 0

        def handle_starttag(self, tag, attrs):
            self.skip += tag in ("script", "style")
            self.words.append(" ")

        def handle_endtag(self, tag):
            self.skip -= tag in ("script", "style")
            self.words.append(" ")

        def handle_data(self, data):
            self.words += [] if self.skip else [data]

    rnd = random.Random(8)
    for _ in range(300):
        page = ""
        for _ in range(rnd.randrange(1, 30)):
            word = f"w{rnd.randrange(50)} &amp; {rnd.choice('abc')}"
            tag = rnd.choice(["p", "div", "h2", "section", "blockquote"])
            page += rnd.choice([f"<{tag}>{word}</{tag}>", f"{word}<br>", f"<ul><li>{word}</li><li> z </li></ul>", "<script>if (a < b) x()</script>", f"<!-- {word} -->", f"<table><tr><td>{word}</td></tr></table>"])
        plain = Words()
        plain.feed(page)
        assert [w for w in render(page).split() if w != "-"] == "".join(plain.words).split()


def test_html_quotes():
    """Quotes open strings only after the = of an attribute."""
    from strandlake.llm.html_text import render

    assert render("<p data=it's>Don't lose me</p>") == "Don't lose me"
    assert render('<a href="x"">y</a>') == "y" and render('<a href=x="y>z</a>') == "z"
    assert render("<p data=it'hidden>seen</p>") == "seen" and render("a<p title = 'q>r' hidden>s</p>") == "a"
    assert render('<a href="a>b" title=\'"\'>t</a>') == "t"


def test_pipeline(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    from strandlake.llm.common import stage, table

    d = "/root/testdata/sf0.001"
    docs = table(spark, d, "documents")
    seen = []
    for name, f in pipeline.STAGES:
        out = stage(f(spark, docs, d), name)
        seen.append(out.count())
        assert name == "token_binary" or out.columns == docs.columns
        docs = out
    assert seen[0] >= seen[1] >= seen[2] > 0 and seen[3] == seen[4]


def test_pieces_cut_in_arrays_and_what_is_remembered(monkeypatch):
    import re
    import time

    import public_tokenizers
    import pyarrow as pa

    from strandlake.llm import token_binary as tb
    from strandlake.llm.common import text_bytes

    path = public_tokenizers.path("byte_bpe_50k.json")
    rng = np.random.default_rng(5)
    parts = ["a", "it", "'s", "'t", "'re", "'ve", "'ll", "'d", "'m", "'", "''", "'r", "S", "ll", "É", "ſ", "ÿ", "×", "÷", "7", "42", " ", "  ", "\n", "\t", "\r\n", ".", "!?", "\x00", "\x1c", "\x85", " ", "日本", "é", "м", "<|endoftext|>", "abcdefghijklmno", " abcdefghijklmnopqr", "🙂"]
    texts = ["".join(parts[i] for i in rng.integers(0, 18 if k % 2 else len(parts), rng.integers(0, 30))) for k in range(3000)]
    # few remembered pieces: they are forgotten again and again
    monkeypatch.setattr(tb, "CACHE_PIECES", 500)
    monkeypatch.setattr(tb, "_CHUNK", 64, raising=False)
    e = tb.Encoder(path)
    got = [x for i in range(0, len(texts), 100) for x in e.ids(texts[i : i + 100])]
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [e.lib.encode(t, add_special_tokens=False).ids for t in texts]

    # known pieces are looked up in arrays: less CPU than a split by the pattern and a look into a dict for each piece
    monkeypatch.undo()
    vocabulary = ["".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(2, 12))) for _ in range(200_000)]
    texts = [" ".join(vocabulary[i] for i in rng.integers(0, len(vocabulary), 500)) for _ in range(2000)]
    e, split = tb.Encoder(path), re.compile(r" ?[a-z]+").findall
    known = {p: b"1234" for t in texts for p in split(t)}
    e.ids(texts)

    def least(f):
        out = []
        for _ in range(3):
            began = time.process_time()
            f()
            out.append(time.process_time() - began)
        return min(out)

    data, offs = text_bytes(pa.array(texts))
    plain = least(lambda: [b"".join(map(known.__getitem__, split(t))) for t in texts])
    assert least(lambda: e.encode(data, offs) if hasattr(e, "encode") else e.ids(texts)) < 1.15 * plain


def test_memory_of_a_token_worker():
    """An executor's workers share what its JVM leaves: a block is coded in few copies, tables are small or go with the task."""
    import tracemalloc

    from strandlake.llm import common
    from strandlake.llm import token_binary as tb

    pieces = tb._Pieces(None)
    assert sum(x.nbytes for x in vars(pieces).values() if isinstance(x, np.ndarray)) < 32e6
    ids = (np.random.default_rng(7).zipf(1.3, 1 << 20) % 50_257).astype(np.uint32)
    for f, x, most in ((tb.encode_block, ids, 4.5), (tb.decode_block, tb.encode_block(ids), 4.5)):
        tracemalloc.start()
        f(x)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < most * ids.nbytes, (f.__name__, peak / ids.nbytes)
    # ids that no order predicts take more than a word each: the room for words grows
    ids = np.random.default_rng(8).integers(0, 1 << 17, 100_000).astype(np.uint32)
    block = tb.encode_block(ids)
    assert len(block) > 2.05 * len(ids) and (tb.decode_block(block) == ids).all()

    def run(batches):
        assert not common._POW
        common.powers(common._P, 1 << 18)
        yield sum(x.nbytes for x in common._POW.values())

    common.powers(common._P, 1 << 18)
    held = list(common.lean(run)([]))
    assert not common._POW and held[0] <= 4 << 20
    assert [int(x) for x in common.powers(common._P, 70_001)[[0, 1, 2, 70_000]]] == [pow(common._P, k, 1 << 64) for k in (0, 1, 2, 70_000)]
    common._POW.clear()


def test_a_worker_reads_the_tokenizer_once(tmp_path):
    """Tasks of a worker share its encoder: with one worker, one of many tasks reads the file."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    import public_tokenizers

    path, root = tmp_path / "byte_bpe.json", Path(__file__).resolve().parents[2]
    shutil.copy(public_tokenizers.path("byte_bpe_50k.json"), path)
    code = f"""if True:
        from pyspark.sql import SparkSession, functions as F
        from strandlake.llm import token_binary as tb
        spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
        rows = lambda a, b: spark.range(a, b, 1, 4).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
        tb.write_token_files(rows(0, 400), {str(tmp_path / "a")!r}, {str(path)!r})
        open({str(path)!r}, "w").close()  # no task can read it again
        tb.write_token_files(rows(400, 800), {str(tmp_path / "b")!r}, {str(path)!r})
        assert tb.digest_token_files(spark, {str(tmp_path / "b")!r}).count() == 400
    """
    done = subprocess.run([sys.executable, "-c", code], cwd=root, env=os.environ | {"PYTHONPATH": str(root)}, capture_output=True, text=True, timeout=150)
    assert not done.returncode, done.stderr[-2000:]


def test_components_by_forests_and_by_rounds(spark, monkeypatch):
    from strandlake.llm import common

    rng = np.random.default_rng(7)
    chain = [(i, i + 1) for i in range(300)]
    pairs = [*chain, *((500, i) for i in range(501, 560)), *((int(a), int(b)) for a, b in rng.integers(1000, 1400, (250, 2))), (None, 3), (7, None), (900, 900)]
    root: dict[int, int] = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    want = {(x, find(x)) for x in list(root)}
    edges = spark.createDataFrame(pairs, "a long, b long").repartition(5).cache()
    edges.count()

    def jobs(f):
        spark.sparkContext.setJobGroup(name := f"group {rng.integers(1 << 40)}", "")
        out = f()
        spark.sparkContext._jsc.clearJobGroup()
        return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))

    got, few = jobs(lambda: [tuple(r) for r in common.components(edges).collect()])
    assert set(got) == want and len(got) == len(want)
    assert few <= 12
    monkeypatch.setattr(common, "MAX_FOREST_ROWS", 0)
    assert {tuple(r) for r in common.components(edges).collect()} == want
    assert common.components(edges.where("a < 0")).count() == 0
    # an array of flags comes in a few jobs, however many partitions its shuffle has
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        (flags, bits), few = jobs(lambda: common.bit_filter(spark.range(0, 30_000, 3)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    hit = common.in_filter(np.frombuffer(flags, np.uint8), bits, np.arange(30_000))
    assert hit[::3].all() and hit.sum() < 12_000
    assert few <= 12
