"""Toxicity: gradient-boosted trees over dense text features, calibrated by isotonic regression.

Features of a whole text: densities of a fixed word list (plain, and after undoing obfuscation) and of a learned list
of words and word stems, how near second-person words stand to listed words, and rates of capitals, punctuation, digits,
symbols and obfuscated words.  They are counted by numpy over the bytes of many texts at a time, in bounded slices.

The model is fitted on a bounded sample of labelled rows (MAX_TRAIN, the smallest hashes of the id).  The learned list
holds stems that many toxic rows of the sample and hardly any others contain.  The calibration is fitted to scores of rows
by models (list and trees) that were fitted without them.  Fitting on the driver is therefore bounded; scoring is one pass
over the texts without a shuffle.

Defined cases: null and empty texts have all-zero features and get the score of those; rows with a null id are scored and
count as not held out; repeated rows are scored each; if no labelled row or only one class is usable, the score is the smoothed share
of toxic rows; further columns are ignored and never inputs of a score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm.common import LOWER, lean, slices, span_hashes, stage, take_column, text_bytes, trim_spans, word_spans

#: Labelled rows that a model is fitted on, at most.
MAX_TRAIN = 20_000
THRESHOLD = 0.7
#: Words between a second-person word and a listed word that still count as near.
NEAR = 5

# The word lists.
LEXICON = (
    "arse arsehole ass asshole bastard bitch bollocks bullshit clown coward cretin creep crap cunt damn degenerate "
    "despicable dick dimwit dirtbag disgrace disgusting douche douchebag dumb dumbass dunce dyke fag faggot filth filthy "
    "fool freak fuck fucker fucking garbage goon halfwit hate idiot idiotic idiots ignorant imbecile inferior jackass jerk "
    "kill knucklehead lame liar loathsome loser losers lowlife lunatic maggot moron moronic morons motherfucker nasty "
    "nincompoop nitwit numbskull parasite pathetic pig piss prick psycho puke pussy rat repulsive retard retarded rubbish "
    "scum scumbag shit shitty shut sick simpleton slag slob slut sleazy stupid stupidity subhuman suck sucks swine thug "
    "trash twat twit ugly useless vermin vile wanker weasel weirdo whore wimp worm worthless wretch "
    "abschaum arschloch depp dumm dummkopf ekelhaft hurensohn idioten miststück penner scheisse scheiße schlampe "
    "schwachkopf trottel verlierer versager wertlos widerlich wichser "
    "abruti bouffon connard connasse con crétin débile dégoûtant enculé imbécile merde minable nul ordure pourriture putain "
    "pute raclure salaud salope stupide taré "
    "asqueroso basura cabrón capullo cerdo escoria estúpido estúpida gilipollas idiota idiotas imbécil inútil maldito mierda "
    "payaso pendejo perdedor perra puta puto repugnante tonto zorra"
).split()
SECOND_PERSON = (
    "you your yours yourself yourselves u ur youre you're thou thee thy "
    "du dich dir dein deine deinen deiner ihr euch euer tu te toi ton ta tes vous votre vos ti tú tus usted ustedes vosotros"
).split()
# Signs that stand for letters in obfuscated words.
LOOKALIKE = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}

#: A learned stem occurs in so many toxic rows (and this share of them) at least, and so many times as often as in others.
STEM_ROWS, STEM_SHARE, STEM_LIFT = 3, 0.02, 25.0
STEM_BYTES = (4, 5)
FOLDS = 3
#: Bytes of text whose features are counted at once (a longer single text is taken alone).
_SLICE_BYTES = 1 << 18

FEATURES = ("learned", "learned_share", "listed", "listed_share", "hidden", "near", "second", "capitals", "upper_words", "punct", "marks", "digits", "symbols", "odd_words", "other", "length")

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_MARK = np.zeros(256, bool)
_MARK[[ord("!"), ord("?")]] = True
_COMMON = np.zeros(256, bool)
_COMMON[[ord(c) for c in ".,;:!?'\"-()"]] = True
_SYMBOL = ~(_LETTER | _DIGIT | _COMMON)
_SYMBOL[[0x20, *range(0x09, 0x0E)]] = False
_PLAIN = LOWER.copy()
for _a, _b in LOOKALIKE.items():
    _PLAIN[ord(_a)] = ord(_b)


def _hash_words(words: list[str]) -> np.ndarray:
    raw = [w.encode() for w in words]
    ends = np.cumsum([len(w) for w in raw])
    return np.unique(span_hashes(np.frombuffer(b"".join(raw), np.uint8), ends - [len(w) for w in raw], ends))


def _within(h: np.ndarray, listed: np.ndarray) -> np.ndarray:
    at = np.searchsorted(listed, h)
    return listed[np.minimum(at, len(listed) - 1)] == h


def _stems(lowered: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(word numbers, hashes) of the words and of their first bytes."""
    out = []
    for n in STEM_BYTES:
        at = np.flatnonzero(b - a >= n)
        out.append((at, span_hashes(lowered, a[at], a[at] + n) ^ np.uint64(n)))
    at = np.flatnonzero(b > a)
    return [*out, (at, span_hashes(lowered, a[at], b[at]))]


def stem_sets(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, stem hash) pairs."""
    starts, ends, wo = word_spans(data, offs)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    doc = np.repeat(np.arange(len(offs) - 1), np.diff(wo))
    parts = _stems(LOWER[data], *trim_spans(_LETTER[data], starts, ends))
    d, h = np.concatenate([doc[at] for at, _ in parts]), np.concatenate([h for _, h in parts])
    order = np.lexsort((h, d))
    d, h = d[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    return d[new], h[new]


def text_features(data: np.ndarray, offs: np.ndarray, listed: np.ndarray, second: np.ndarray, stems: list[np.ndarray]) -> list[np.ndarray]:
    """For each list of learned stems a row of FEATURES for each text."""
    n = len(offs) - 1
    out = [np.zeros((n, len(FEATURES))) for _ in stems]
    length = np.diff(offs).astype(float)

    def per_text(flags: np.ndarray) -> np.ndarray:
        c = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=c[1:])
        return c

    starts, ends, wo = word_spans(data, offs)
    if not len(starts):
        return out
    total = np.maximum(np.diff(wo), 1)
    letters, lowered = _LETTER[data], LOWER[data]
    a, b = trim_spans(letters, starts, ends)
    bad = _within(span_hashes(lowered, a, b), listed)
    you = _within(span_hashes(lowered, a, b), second)
    # obfuscated words: a sign or digit between the first and last letter-like byte, with the signs undone or left out
    upper, symbol_or_digit = _UPPER[data], ~letters
    inside = per_text(symbol_or_digit)
    likely = letters | _DIGIT[data] | np.isin(data, [ord(c) for c in "@$!"])
    c, d = trim_spans(likely, starts, ends)
    odd = (inside[d] - inside[c] > 0) & (d - c >= 3)
    hidden = np.zeros(len(starts), bool)
    if odd.any():
        plain = _PLAIN[data]
        at = np.flatnonzero(odd)
        hidden[at] = _within(span_hashes(plain, c[at], d[at]), listed)
        keep = _LETTER[plain]
        squeezed, new = plain[keep], np.zeros(len(plain) + 1, np.int64)
        np.cumsum(keep, out=new[1:])
        hidden[at] |= _within(span_hashes(squeezed, new[c[at]], new[d[at]]), listed)
    hidden &= ~bad
    any_bad = bad | hidden
    # second-person words near listed words, without crossing from one text to another
    doc = np.repeat(np.arange(n), np.diff(wo))
    near = np.zeros(len(starts), bool)
    for j in range(1, NEAR + 1):
        if len(starts) > j:
            same = doc[j:] == doc[:-j]
            near[j:] |= any_bad[j:] & you[:-j] & same
            near[:-j] |= any_bad[:-j] & you[j:] & same
    capitals = per_text(upper)
    whole = (capitals[b] - capitals[a] == b - a) & (b - a >= 3)

    def words(flags: np.ndarray) -> np.ndarray:
        c = per_text(flags)
        return (c[wo[1:]] - c[wo[:-1]]).astype(float)

    def bytes_(flags: np.ndarray) -> np.ndarray:
        c = per_text(flags)
        return (c[offs[1:]] - c[offs[:-1]]) / np.maximum(length, 1)

    cols = (
        words(bad), words(bad) / total, words(hidden), words(near), words(you) / total, bytes_(upper), words(whole) / total, bytes_(_COMMON[data]), bytes_(_MARK[data]), bytes_(_DIGIT[data]), bytes_(_SYMBOL[data]), words(odd) / total, bytes_(data >= 128), np.log1p(length),
    )
    hashed = _stems(lowered, a, b)
    for rows, known in zip(out, stems, strict=True):
        found = np.zeros(len(starts), bool)
        for at, h in hashed if len(known) else ():
            found[at[_within(h, known)]] = True
        for k, x in enumerate((words(found), words(found) / total, *cols)):
            rows[:, k] = x
    return out


# ---------------------------------------------------------------- trees and calibration


class Boosted:
    """Boosted regression trees for the logistic loss on binned features, then isotonic calibration."""

    def __init__(self, rounds: int = 40, depth: int = 3, rate: float = 0.25, bins: int = 24, least: int = 5):
        self.rounds, self.depth, self.rate, self.bins, self.least = rounds, depth, rate, bins, least

    def fit(self, x: np.ndarray, own: np.ndarray) -> Boosted:
        share = (own.sum() + 1) / (len(own) + 2)
        self.start, self.trees = float(np.log(share / (1 - share))), []
        self.steps = (np.array([-np.inf]), np.array([share]))
        if len(np.unique(own)) < 2:
            return self
        # edges from the distinct values, so that rare values are told apart too
        self.edges = [np.unique(np.quantile(np.unique(x[:, k]), np.linspace(0, 1, self.bins + 1)[1:-1])) for k in range(x.shape[1])]
        binned = self._bin(x)
        f = np.full(len(own), self.start)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-f))
            tree = self._tree(binned, own - p, p * (1 - p))
            self.trees.append(tree)
            f += self._apply(tree, binned)
        return self

    def calibrate(self, raw: np.ndarray, y: np.ndarray) -> None:
        if self.trees and len(y):
            self.steps = isotonic(raw, y)

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], "right") for k, e in enumerate(self.edges)], 1)

    def _tree(self, binned: np.ndarray, g: np.ndarray, h: np.ndarray) -> list[tuple]:
        """Nodes in heap order: (feature, bin) of a split, or (-1, value) of a leaf."""
        node = np.zeros(len(g), np.int64)
        tree: list[tuple] = [(-1, 0.0)] * (2 ** (self.depth + 1) - 1)
        for i in range(len(tree)):
            at = np.flatnonzero(node == i)
            if not len(at):
                continue
            sg, sh = g[at].sum(), h[at].sum()
            tree[i] = (-1, self.rate * sg / (sh + 1.0))
            if 2 * i + 2 >= len(tree) or len(at) < 2 * self.least:
                continue
            best = (1e-6, -1, 0)
            for k in range(binned.shape[1]):
                col, size = binned[at, k], self.bins + 1
                cg, ch, cn = (np.cumsum(np.bincount(col, w, size)) for w in (g[at], h[at], None))
                gain = cg**2 / (ch + 1) + (sg - cg) ** 2 / (sh - ch + 1) - sg**2 / (sh + 1)
                gain[(cn < self.least) | (len(at) - cn < self.least)] = -1
                if gain.max() > best[0]:
                    best = (float(gain.max()), k, int(gain.argmax()))
            if best[1] >= 0:
                tree[i] = (best[1], best[2])
                node[at] = 2 * i + 1 + (binned[at, best[1]] > best[2])
        return tree

    def _apply(self, tree: list[tuple], binned: np.ndarray) -> np.ndarray:
        feature = np.array([t[0] for t in tree])
        value = np.array([t[1] for t in tree], float)
        node, rows = np.zeros(len(binned), np.int64), np.arange(len(binned))
        for _ in range(self.depth):
            k = feature[node]
            node = np.where(k >= 0, 2 * node + 1 + (binned[rows, np.maximum(k, 0)] > value[node]), node)
        return value[node]

    def raw(self, x: np.ndarray) -> np.ndarray:
        f = np.full(len(x), self.start)
        if self.trees:
            binned = self._bin(x)
            for tree in self.trees:
                f += self._apply(tree, binned)
        return f

    def score(self, x: np.ndarray) -> np.ndarray:
        at, value = self.steps
        return value[np.maximum(np.searchsorted(at, self.raw(x), "right") - 1, 0)]


def isotonic(f: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: lower bounds of steps and their smoothed, non-decreasing values."""
    at, inverse = np.unique(f, return_inverse=True)
    total, hits = np.bincount(inverse).astype(float), np.bincount(inverse, y)
    blocks: list[list[float]] = []  # start, rows, hits
    for a, n, s in zip(at, total, hits, strict=True):
        blocks.append([a, n, s])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][1] >= blocks[-1][2] * blocks[-2][1]:
            _, n, s = blocks.pop()
            blocks[-1][1] += n
            blocks[-1][2] += s
    share = float(y.mean())
    value = np.array([(s + share) / (n + 1) for _, n, s in blocks])
    return np.array([b[0] for b in blocks]), np.clip(np.maximum.accumulate(value), 0.0, 1.0)


# ---------------------------------------------------------------- Spark


def _featured(batches: Iterator[pa.RecordBatch], stems: list[np.ndarray]) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    listed, second = _hash_words(LEXICON), _hash_words(SECOND_PERSON)
    for batch in batches:
        data, offs = text_bytes(take_column(batch, "text"))
        for i, j in slices(offs, _SLICE_BYTES):
            yield batch.slice(i, j - i), text_features(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], listed, second, stems)


def _fold(ids: np.ndarray) -> np.ndarray:
    return ((ids.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(FOLDS)).astype(np.int64)


def _stem_rows(batches):
    for batch in batches:
        data, offs = text_bytes(take_column(batch, "text"))
        kind = _fold(np.asarray(take_column(batch, "doc_id"))) * 2 + np.asarray(take_column(batch, "toxic"))
        for i, j in slices(offs):
            d, h = stem_sets(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(kind[i:j][d].astype(np.int32))], names=["stem", "kind"])


def _training_rows(stems: list[np.ndarray]):
    def run(batches):
        for batch, x in _featured(batches, stems):
            yield pa.RecordBatch.from_arrays([take_column(batch, "doc_id"), take_column(batch, "toxic"), pa.array(list(np.concatenate(x, 1)), pa.list_(pa.float64()))], names=["doc_id", "toxic", "x"])

    return run


def _learned(counts: np.ndarray, rows: np.ndarray, stems: np.ndarray) -> np.ndarray:
    """Stems by their counts in (other, toxic) rows of each fold, summed over the folds that may be seen."""
    (clean, toxic), (n_clean, n_toxic) = counts, np.maximum(rows, 1)
    lift = (toxic / n_toxic) / ((clean + 0.5) / n_clean)
    need = max(STEM_ROWS, STEM_SHARE * n_toxic)
    return np.sort(stems[(toxic >= need) & (lift >= min(STEM_LIFT, 0.6 * need / n_toxic * n_clean / 0.5))])


def held_out(doc_id: str = "doc_id"):
    """Rows kept from learning: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit_toxicity(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> Boosted:
    """A model from the labelled rows that are not held out: at most max_train of them, by the hash of their id."""
    known = labels.where("toxic is not null and doc_id is not null").where(~held_out()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), "doc_id")  # at most max_train rows
    rows = stage(rows, "labelled")
    kinds = [F.count_if(F.col("kind") == k).alias(f"k{k}") for k in range(2 * FOLDS)]
    toxic = sum(F.col(f"k{k}") for k in range(1, 2 * FOLDS, 2))
    marks = rows.mapInArrow(lean(_stem_rows), "stem long, kind int").groupBy("stem").agg(*kinds)
    n_toxic = rows.where("toxic = 1").count()
    # bounded: a stem that stays is in STEM_SHARE of the toxic rows of the sample at least, less one fold
    least = max(STEM_ROWS, STEM_SHARE * n_toxic * 0.5)
    marks = marks.where((toxic >= least) & (toxic > sum(F.col(f"k{k}") for k in range(0, 2 * FOLDS, 2)))).toPandas().sort_values("stem")
    names, counts = marks.stem.to_numpy(np.int64).view(np.uint64), marks.drop(columns="stem").to_numpy().reshape(-1, FOLDS, 2)
    key = rows.select("doc_id", "toxic").toPandas()
    size = np.bincount(_fold(key.doc_id.to_numpy(np.int64)) * 2 + key.toxic.to_numpy(np.int64), minlength=2 * FOLDS).reshape(FOLDS, 2)
    stems = [_learned(np.delete(counts, f, 1).sum(1).T, np.delete(size, f, 0).sum(0), names) for f in range(FOLDS)]
    stems.append(_learned(counts.sum(1).T, size.sum(0), names))

    got = rows.mapInArrow(lean(_training_rows(stems)), "doc_id long, toxic int, x array<double>").toPandas().sort_values("doc_id", kind="stable")
    model = Boosted()
    model.stems = stems[-1]
    if not len(got):
        return model.fit(np.zeros((0, len(FEATURES))), np.zeros(0))
    y, x, fold, k = got.toxic.to_numpy(float), np.stack(got.x.to_numpy()), _fold(got.doc_id.to_numpy(np.int64)), len(FEATURES)
    unseen = np.zeros(len(y))
    for f in range(FOLDS):
        own, at = x[:, f * k : (f + 1) * k], fold == f
        if at.any() and not at.all():
            unseen[at] = Boosted().fit(own[~at], y[~at]).raw(own[at])
    model.fit(x[:, FOLDS * k :], y).calibrate(unseen, y)
    return model


def score_toxicity(docs: DataFrame, model: Boosted, keep: list[str], score: str = "score") -> DataFrame:
    """The columns `keep` of docs, and the score as a double, for every row."""
    schema = docs.select(*keep).schema.add(score, "double")

    def run(batches):
        for batch, x in _featured(batches, [model.stems]):
            cols = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(model.score(x[0]))], names=[*keep, score])

    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(lean(run), schema)


def toxicity(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs (doc_id, text); labels: doc_id, toxic."""
    scored = score_toxicity(docs, fit_toxicity(docs, labels, max_train), ["doc_id"])
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
