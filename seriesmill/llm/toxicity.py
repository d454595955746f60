"""Toxicity: gradient-boosted trees over dense features, calibrated by isotonic regression.

Features of a whole text: densities of lexicon words (a short seed list, and words and
word beginnings learned from labelled rows), their nearness to words of the second
person, and rates of capitals, punctuation and obfuscation (letters mixed with digits or
signs, stretched letters, lexicon words found only after undoing such writing).

The lexicon, the trees and the calibration are fitted on separate parts of at most
``SAMPLE_ROWS`` labelled rows; scoring covers every text, in numpy, batch by batch.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ALNUM, U64, WordScanner, held_out, mix, stored, text_chunks, tidy, word_places

SAMPLE_ROWS = 20_000
LEXICON_SIZE = 4_000
PREFIXES = (4, 5, 6)
NEAR = 5
#: Bytes of text whose words' arrays are held at once.
CHUNK = 1 << 18

# A seed lexicon and words of the second person.
SEED_LEXICON = ("idiot", "idiots", "moron", "morons", "stupid", "trash", "scum", "loser", "losers", "worthless", "pathetic", "disgusting", "clown", "dumb", "fool", "garbage", "ugly", "hate", "shut", "filthy")
SECOND_PERSON = ("you", "your", "yours", "yourself", "u", "ur", "du", "dich", "dir", "dein", "deine", "ihr", "euch", "euer", "tu", "te", "toi", "ton", "vous", "votre", "vos", "usted", "ustedes", "vosotros", "ti", "tus")

FEATURES = ("learned_density", "learned_log", "learned_distinct", "learned_weight", "learned_top", "seed_density", "seed_log", "hidden_density", "second_person", "near_share", "capitals", "capital_words", "punctuation", "shouts", "mixed_words", "inner_signs", "stretched")

_KIND = mix(np.arange(8, dtype=U64) + U64(4099))


def _undo_table() -> np.ndarray:
    """Bytes of words with common stand-ins for letters undone."""
    table = np.arange(256)
    for sign, letter in zip(b"013457@$", b"oieastas"):
        table[sign] = letter
    return table.astype(np.uint8)


_UNDO = _undo_table()
_SIGNS = np.isin(np.arange(256), np.frombuffer(b"@$!*#+-_.", np.uint8))
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_JOINED = ALNUM | np.isin(np.arange(256), np.frombuffer(b"@$", np.uint8))
_ODD = _DIGIT | np.isin(np.arange(256), np.frombuffer(b"@$", np.uint8))


def hashes_of(words) -> np.ndarray:
    scan = WordScanner(ALNUM)
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    return np.unique(scan(data, np.array([0, len(data)]))[3])


def _tokens(scan: WordScanner, data, offsets):
    """row and hash of each word, and the hashes of its beginnings (0: shorter)."""
    row, start, end, h, beginnings = scan.with_beginnings(data, offsets, PREFIXES)
    return row, start, end, [h ^ _KIND[0], *(np.where(b != 0, b ^ _KIND[k + 1], U64(0)) for k, b in enumerate(beginnings))]


class Scorer:
    """Features of texts, given the learned lexicon (sorted hashes and weights)."""

    def __init__(self, lexicon: np.ndarray, weights: np.ndarray):
        self.lexicon, self.weights = lexicon, weights
        self.scan = WordScanner(ALNUM)
        self.seed, self.person = hashes_of(SEED_LEXICON), hashes_of(SECOND_PERSON)

    def _weight(self, kinds) -> tuple[np.ndarray, np.ndarray]:
        weight = np.zeros(len(kinds[0]))
        token = np.zeros(len(kinds[0]), U64)
        if len(self.lexicon):
            for h in kinds:
                at = np.searchsorted(self.lexicon, h)
                at[at == len(self.lexicon)] = 0
                w = np.where(self.lexicon[at] == h, self.weights[at], 0.0)
                better = w > weight
                weight[better], token[better] = w[better], h[better]
        return weight, token

    def features(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n = len(offsets) - 1
        row, start, end, kinds = _tokens(self.scan, data, offsets)
        word = kinds[0] ^ _KIND[0]
        sums = lambda r, w=None: np.bincount(r, w, minlength=n)[:n].astype(float)
        words = sums(row)
        per = 1.0 / np.maximum(words, 1)
        weight, token = self._weight(kinds)
        hit = weight > 0
        seed = np.isin(word, self.seed)
        person = np.isin(word, self.person)
        top = np.zeros(n)
        np.maximum.at(top, row[hit], weight[hit])
        pairs = np.unique(np.stack([row[hit].astype(U64), token[hit]], axis=1), axis=0) if hit.any() else np.zeros((0, 2), U64)

        any_hit = hit | seed
        reach = np.concatenate([[0], np.cumsum(person)])
        at = np.flatnonzero(any_hit)
        low = np.maximum(at - NEAR, np.searchsorted(row, row[at], "left"))
        high = np.minimum(at + NEAR + 1, np.searchsorted(row, row[at], "right"))
        near = reach[high] - reach[low] > 0

        size = np.diff(offsets)
        byte_row = np.repeat(np.arange(n), size)
        letters, uppers = sums(byte_row[_LETTER[data]]), sums(byte_row[_UPPER[data]])
        visible = sums(byte_row[~_BLANK[data]])
        signs = sums(byte_row[~(ALNUM | _BLANK)[data]])
        shouts = sums(byte_row[(data == 33) | (data == 63)])
        many = np.zeros(len(data), bool)
        many[2:] = (data[2:] == data[1:-1]) & (data[1:-1] == data[:-2]) & _LETTER[data[2:]]
        inner = np.zeros(len(data), bool)
        inner[1:-1] = _SIGNS[data[1:-1]] & _LETTER[data[2:]] & _LETTER[data[:-2]]

        total = lambda flags: np.concatenate([[0], np.cumsum(flags)])
        up, low_, digit = total(_UPPER[data]), total(_LETTER[data]), total(_DIGIT[data])
        of = lambda t: t[end] - t[start]
        shouted = (of(up) == end - start) & (end - start >= 3)
        mixed = (of(digit) > 0) & (of(low_) > 0)

        # words with stand-ins for letters, once these are undone
        hidden = np.zeros(n)
        jrow, jstart, jend = word_places(_JOINED[data], offsets)
        seen = total(_ODD[data])
        suspect = (seen[jend] - seen[jstart] > 0) & (low_[jend] - low_[jstart] > 0)
        if suspect.any():
            jrow, jstart, size = jrow[suspect], jstart[suspect], (jend - jstart)[suspect]
            ends = np.cumsum(size + 1)  # a blank behind each
            plain = np.full(ends[-1], 32, np.uint8)
            shift = np.repeat(jstart - (ends - size - 1), size)
            place = np.delete(np.arange(ends[-1]), ends - 1)
            plain[place] = _UNDO[data[place + shift]]
            kinds = _tokens(self.scan, plain, np.array([0, len(plain)]))[3]
            hidden = sums(jrow[(self._weight(kinds)[0] > 0) | np.isin(kinds[0] ^ _KIND[0], self.seed)])

        hits, seeds = sums(row[hit]), sums(row[seed])
        cells = 1.0 / np.maximum(visible, 1)
        return np.stack([
            hits * per, np.log1p(hits), np.log1p(sums(pairs[:, 0].astype(np.int64))), sums(row[hit], weight[hit]) * per, top,
            seeds * per, np.log1p(seeds), hidden * per, sums(row[person]) * per, sums(row[at[near]]) / np.maximum(hits + seeds, 1),
            uppers / np.maximum(letters, 1), sums(row[shouted]) * per, signs * cells, shouts * per, sums(row[mixed]) * per, sums(byte_row[inner]) * per, sums(byte_row[many]) * per,
        ], axis=1)


# --- the model -------------------------------------------------------------------------


class BoostedTrees:
    """Logistic gradient boosting over features cut into bins at quantiles."""

    def __init__(self, rounds: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 32, least: float = 2.0, shrink: float = 1.0):
        self.rounds, self.depth, self.rate, self.bins, self.least, self.shrink = rounds, depth, rate, bins, least, shrink
        self.cuts: list[np.ndarray] = []
        self.trees: list[tuple] = []
        self.base = 0.0

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, k], "left") for k, c in enumerate(self.cuts)], axis=1)

    def fit(self, x: np.ndarray, y: np.ndarray) -> "BoostedTrees":
        grid = np.linspace(0, 1, self.bins + 1)[1:-1]
        for k in range(x.shape[1]):
            # quantiles of the distinct values too: rare positives keep cuts of their own
            cuts = np.concatenate([np.quantile(x[:, k], grid), np.quantile(np.unique(x[:, k]), grid)])
            self.cuts.append(np.unique(cuts))
        b = self._binned(x)
        width = max(len(c) for c in self.cuts) + 1
        rate = np.clip(y.mean(), 1e-4, 1 - 1e-4)
        self.base = float(np.log(rate / (1 - rate)))
        score = np.full(len(y), self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            g, h = p - y, np.maximum(p * (1 - p), 1e-9)
            node = np.zeros(len(y), np.int64)
            split = []
            for level in range(self.depth):
                nodes = 1 << level
                best = np.full(nodes, 1e-9)
                feature, cut = np.zeros(nodes, np.int64), np.full(nodes, width, np.int64)
                for k in range(x.shape[1]):
                    cell = node * width + b[:, k]
                    gs = np.bincount(cell, g, nodes * width).reshape(nodes, width).cumsum(axis=1)
                    hs = np.bincount(cell, h, nodes * width).reshape(nodes, width).cumsum(axis=1)
                    gt, ht = gs[:, -1:], hs[:, -1:]
                    gain = gs**2 / (hs + self.shrink) + (gt - gs) ** 2 / (ht - hs + self.shrink) - gt**2 / (ht + self.shrink)
                    gain[(hs < self.least) | (ht - hs < self.least)] = 0
                    at = gain.argmax(axis=1)
                    top = gain[np.arange(nodes), at]
                    better = top > best
                    best[better], feature[better], cut[better] = top[better], k, at[better]
                split.append((feature, cut))
                node = 2 * node + (b[np.arange(len(y)), feature[node]] > cut[node])
            leaves = 1 << self.depth
            value = -np.bincount(node, g, leaves) / (np.bincount(node, h, leaves) + self.shrink) * self.rate
            self.trees.append((split, value))
            score += value[node]
        return self

    def raw(self, x: np.ndarray) -> np.ndarray:
        b = self._binned(x)
        score = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for split, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for feature, cut in split:
                node = 2 * node + (b[rows, feature[node]] > cut[node])
            score += value[node]
        return score


def isotonic(x: np.ndarray, y: np.ndarray) -> list[tuple[float, float, float]]:
    """The non-decreasing step function nearest to y (pool adjacent violators), as blocks
    of equal value in order: value, number of rows and mean x of each."""
    order = np.argsort(x, kind="stable")
    at, first = np.unique(x[order], return_index=True)
    weight = np.diff(np.append(first, len(x))).astype(float)
    value = np.add.reduceat(y[order].astype(float), first) / weight
    blocks: list[tuple[float, float, float]] = []
    for v, w, m in zip(value.tolist(), weight.tolist(), at.tolist()):
        while blocks and blocks[-1][0] >= v:
            v0, w0, m0 = blocks.pop()
            v, m, w = (v0 * w0 + v * w) / (w0 + w), (m0 * w0 + m * w) / (w0 + w), w0 + w
        blocks.append((v, w, m))
    return blocks


def calibration(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the centred isotonic regression: the isotonic value of each block stands at
    the block's mean, and between two blocks the calibration is a straight line, so that it
    rises strictly there."""
    blocks = isotonic(x, y)
    return np.array([m for _, _, m in blocks]), np.array([v for v, _, _ in blocks])


class ToxicityModel:
    def __init__(self, scorer: Scorer, trees: BoostedTrees | None, knots, values):
        self.scorer, self.trees, self.knots, self.values = scorer, trees, knots, values

    def scores(self, features: np.ndarray) -> np.ndarray:
        if self.trees is None:
            return np.full(len(features), float(self.values[0]))
        return np.clip(np.interp(self.trees.raw(features), self.knots, self.values), 0.0, 1.0)


def _count_tokens(batches):
    """Partial counts: in how many toxic and other texts of each fold a token stands."""
    scan = WordScanner(ALNUM)
    for batch in batches:
        kind = batch.column(1).to_numpy().astype(np.int64) * 2 + (batch.column(2).to_numpy() > 0)
        for lo, data, offsets in text_chunks(batch.column(0)):
            row, _, _, kinds = _tokens(scan, data, offsets)
            parts, kinds_of = [], []
            for h in kinds:
                pair = np.unique(np.stack([row.astype(U64), h], axis=1), axis=0)
                pair = pair[pair[:, 1] != 0]
                parts.append(pair[:, 1])
                kinds_of.append(kind[lo + pair[:, 0].astype(np.int64)])
            token, inverse = np.unique(np.concatenate(parts), return_inverse=True)
            cell = np.bincount(inverse * 2 * FOLDS + np.concatenate(kinds_of), minlength=len(token) * 2 * FOLDS).reshape(len(token), 2 * FOLDS)
            yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), *[pa.array(cell[:, k]) for k in range(2 * FOLDS)]], ["token", *_CELLS])


FOLDS = 4
_CELLS = [f"{kind}{k}" for k in range(FOLDS) for kind in ("good", "bad")]


def _lexicon(counts: pd.DataFrame, bad: np.ndarray, good: np.ndarray, folds) -> Scorer:
    """The lexicon that the given folds teach: tokens far likelier in toxic texts."""
    b = sum((counts[f"bad{k}"].to_numpy() for k in folds), np.zeros(len(counts), np.int64))
    g = sum((counts[f"good{k}"].to_numpy() for k in folds), np.zeros(len(counts), np.int64))
    n_bad, n_good = bad[list(folds)].sum(), good[list(folds)].sum()
    weight = np.log((b + 0.1) / (n_bad + 1)) - np.log((g + 0.5) / (n_good + 1))
    token = counts["token"].to_numpy(np.int64).view(U64)
    keep = np.flatnonzero((b >= max(2, round(n_bad / 200))) & (weight > 2.5))
    keep = keep[np.lexsort((token[keep], -weight[keep], -b[keep]))][:LEXICON_SIZE]
    keep = keep[np.argsort(token[keep])]
    # a token of few toxic texts is surer the more of them there are
    return Scorer(token[keep], weight[keep] * np.log2(1 + b[keep]) / np.log2(1 + max(n_bad, 2)))


def _featurise(scorers: list[Scorer]):
    """Features of each row by the scorer of its fold."""

    def run(batches):
        for batch in batches:
            fold = batch.column(2).to_numpy()
            x = np.zeros((batch.num_rows, len(FEATURES)))
            for k, scorer in enumerate(scorers):
                at = np.flatnonzero(fold == k)
                if len(at):
                    x[at] = np.concatenate([scorer.features(data, offsets) for _, data, offsets in text_chunks(batch.column(0).take(pa.array(at)), CHUNK)])
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(list(x), pa.list_(pa.float64()))], ["toxic", "fold", "x"])

    return run


def _constant(rate: float) -> ToxicityModel:
    return ToxicityModel(Scorer(np.zeros(0, U64), np.zeros(0)), None, [0.0], [rate])


def fit_toxicity(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS) -> ToxicityModel:
    """A model of ``labelled`` (doc_id, text, toxic): toxic 0 or 1, other rows ignored.

    Of all rows, about ``sample_rows`` chosen by a hash of id and text are learned from, in
    four folds: the features of a fold come from the lexicon of the other three, and the
    calibration from trees that did not see the fold. Texts whose long words have the same
    least hash (copies, near copies, and some others) are of one fold, and of them one a
    label, that with the least hash, counts in the lexicon: a much copied text lends it
    little and proves nothing about itself. Repeated rows (id, text and label equal) are
    learned from once. A lexicon has at most ``LEXICON_SIZE`` tokens, those of most toxic
    texts. Without rows of both kinds, the score is the share of toxic rows (0 without
    any). The order of rows makes no difference.
    """
    labelled = labelled.where("toxic in (0, 1)")
    n = labelled.count()
    if n == 0:
        return _constant(0.0)
    place = F.pmod(F.xxhash64(F.col("doc_id"), F.col("text"), F.lit(11)), F.lit(1 << 20))
    long_words = F.filter(F.split(F.lower("text"), r"[^\p{L}]+"), lambda w: F.length(w) >= 9)
    key = F.coalesce(F.array_min(F.transform(long_words, lambda w: F.xxhash64(w))), F.xxhash64("text"))
    sample = labelled.where(place < min(1 << 20, max(1, int((1 << 20) * sample_rows / n)))).select("text", F.col("toxic").cast("int").alias("toxic"), key.alias("key"), "doc_id")
    sample = sample.dropDuplicates(["doc_id", "text", "toxic"])
    sample = stored(sample.withColumn("fold", F.pmod("key", F.lit(FOLDS)).cast("int")), "toxic-sample")

    first = F.min_by("text", F.struct(F.xxhash64("text"), F.col("text"))).alias("text")
    words = stored(sample.groupBy("key", "toxic").agg(first, F.min("fold").alias("fold")).select("text", "fold", "toxic"), "toxic-words")
    held = {(r.fold, r.toxic): r["count"] for r in words.groupBy("fold", "toxic").count().collect()}
    bad, good = (np.array([held.get((k, kind), 0) for k in range(FOLDS)]) for kind in (1, 0))
    if not bad.sum() or not good.sum():
        return _constant(float(sample.agg(F.avg("toxic")).first()[0] or 0.0))
    cells = words.mapInArrow(tidy(_count_tokens), ", ".join(["token long", *[f"{c} long" for c in _CELLS]])).groupBy("token").agg(*[F.sum(c).alias(c) for c in _CELLS])
    every_bad, every_good = sum(F.col(f"bad{k}") for k in range(FOLDS)), sum(F.col(f"good{k}") for k in range(FOLDS))
    counts = cells.where((every_bad >= max(2, round(bad.sum() / 400))) & (every_bad * 4 * int(good.sum()) > every_good * int(bad.sum())))
    counts = counts.orderBy(every_bad.desc(), "token").limit(8 * LEXICON_SIZE).toPandas()
    scorers = [_lexicon(counts, bad, good, [j for j in range(FOLDS) if j != k]) for k in range(FOLDS)]

    rows = sample.orderBy("doc_id", "toxic", F.xxhash64("text")).select("text", "toxic", "fold").mapInArrow(tidy(_featurise(scorers)), "toxic int, fold int, x array<double>").toPandas()  # bounded by sample_rows
    x = np.array(rows["x"].tolist()).reshape(len(rows), -1)
    y, fold = rows["toxic"].to_numpy(float), rows["fold"].to_numpy()
    raw = np.full(len(y), np.nan)
    for k in range(FOLDS):
        seen, own = fold != k, fold == k
        if own.any() and len(set(y[seen])) == 2:
            raw[own] = BoostedTrees().fit(x[seen], y[seen]).raw(x[own])
    trees = BoostedTrees().fit(x, y)
    known = ~np.isnan(raw)
    knots, values = calibration(raw[known], y[known]) if len(set(y[known])) == 2 else calibration(trees.raw(x), y)
    return ToxicityModel(_lexicon(counts, bad, good, range(FOLDS)), trees, knots, values)


def _score(model: ToxicityModel):
    def run(batches):
        for batch in batches:
            parts = [model.scores(model.scorer.features(data, offsets)) for _, data, offsets in text_chunks(batch.column(batch.num_columns - 1), CHUNK)]
            score = np.concatenate(parts) if parts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score, pa.float64())], [*batch.schema.names, "score"])

    return run


def _scored(rows: DataFrame, model: ToxicityModel) -> DataFrame:
    """``rows`` (text last) with a column score."""
    return rows.mapInArrow(tidy(_score(model)), T.StructType([*rows.schema.fields, T.StructField("score", T.DoubleType())]))


def score_toxicity(docs: DataFrame, model: ToxicityModel, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted (score >= ``threshold``) for every row of
    ``docs`` (doc_id, text). Null and empty texts are scored like a text without words.
    Repeated rows are scored each; further columns are ignored."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    return _scored(rows, model).select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, model: ToxicityModel, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` whose text scores under ``threshold``, with all their columns
    whatever their names: these travel in one column past the score."""
    own = [F.col(f"`{c}`") for c in docs.columns]
    scored = _scored(docs.select(F.struct(*own).alias("row"), F.col("text").cast("string").alias("text")), model)
    return scored.where(F.col("score") < threshold).select("row.*")


def labelled_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, toxic) of the rows to learn from: labelled and not held out. An id
    with several labels is toxic if one says so; labels without an id are left out."""
    one = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    return docs.where(~held_out(F.col("doc_id"))).select("doc_id", "text").join(one, "doc_id")
