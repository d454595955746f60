import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from seriesmill.llm import language, toxicity
from seriesmill.llm.common import ALNUM, WordScanner, held_out

from .helpers import awkward, documents, prose


def labelled(spark, n=240):
    rows, labels = [], []
    for k in range(n):
        bad = k % 4 == 0
        words = prose(k % 7, 40) + [f"u{k}x{j}" for j in range(5)]
        if bad:
            words[3:3] = ["you", "are", "an", "awful", "gruntling", "gruntlers"]
        rows.append((k, " ".join(words)))
        labels.append((k, 0, int(bad)))
    return rows, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_learns_words_and_scores_held_out_rows(spark):
    rows, labels = labelled(spark)
    docs = documents(spark, rows)
    model = toxicity.fit_toxicity(toxicity.labelled_rows(docs, labels))
    got = toxicity.score_toxicity(docs, model).collect()
    assert all(r.predicted == (r.doc_id % 4 == 0) for r in got)
    assert all(0 <= r.score <= 1 for r in got) and {r.held_out for r in got} == {True, False}
    again = toxicity.score_toxicity(docs, toxicity.fit_toxicity(toxicity.labelled_rows(docs, labels))).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_labels_of_held_out_rows_are_not_seen(spark):
    rows, labels = labelled(spark)
    docs = documents(spark, rows)
    seen = {r.doc_id for r in toxicity.labelled_rows(docs, labels).collect()}
    out = {r.doc_id for r in docs.where(held_out(docs["doc_id"])).select("doc_id").collect()}
    assert out and not seen & out


def test_toxicity_of_awkward_rows(spark):
    rows, labels = labelled(spark)
    model = toxicity.fit_toxicity(toxicity.labelled_rows(documents(spark, rows), labels))
    got = toxicity.score_toxicity(documents(spark, awkward()), model).collect()
    assert len(got) == len(awkward()) and all(0 <= r.score <= 1 for r in got)
    kept = toxicity.drop_toxic(documents(spark, awkward()), model)
    assert kept.columns == documents(spark, []).columns and kept.count() == len(awkward())
    assert toxicity.score_toxicity(documents(spark, []), model).collect() == []


def test_toxicity_without_labels_or_of_one_kind(spark):
    docs = documents(spark, awkward())
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.fit_toxicity(toxicity.labelled_rows(docs, none))
    assert {r.score for r in toxicity.score_toxicity(docs, model).collect()} == {0.0}
    one = spark.createDataFrame([(4, 1), (5, 1), (6, 1), (7, 1), (None, 1), (8, None)], "doc_id long, toxic int")
    model = toxicity.fit_toxicity(toxicity.labelled_rows(docs, one))
    assert {r.score for r in toxicity.score_toxicity(docs, model).collect()} == {1.0}


def test_features_count_what_they_name():
    scorer = toxicity.Scorer(np.zeros(0, np.uint64), np.zeros(0))
    text = b"You STUPID st0ne, you 1d10t! sooo b@d"
    x = dict(zip(toxicity.FEATURES, scorer.features(np.frombuffer(text, np.uint8), np.array([0, len(text)]))[0]))
    assert x["seed_density"] == pytest.approx(1 / 8)
    assert x["hidden_density"] == pytest.approx(1 / 8)  # 1d10t
    assert x["second_person"] == pytest.approx(2 / 8) and x["near_share"] == 1
    assert x["mixed_words"] == pytest.approx(2 / 8) and x["stretched"] == pytest.approx(1 / 8)


def nearest_rising(x, y):
    """The isotonic value at each place: the greatest of the least means around it."""
    at = sorted(set(x.tolist()))
    groups = [y[x == v].tolist() for v in at]

    def mean(a, b):
        held = [v for g in groups[a : b + 1] for v in g]
        return sum(held) / len(held)

    return at, [max(min(mean(a, b) for b in range(k, len(at))) for a in range(k + 1)) for k in range(len(at))]


def test_isotonic_is_the_nearest_rising_function():
    rng = np.random.default_rng(5)
    for n in (1, 2, 7, 40):
        x, y = rng.integers(0, 12, n).astype(float), rng.integers(0, 2, n).astype(float)
        at, want = nearest_rising(x, y)
        got, k = [], 0
        for value, weight, centre in toxicity.isotonic(x, y):
            rows = 0
            own = []
            while rows < weight:
                rows += (x == at[k]).sum()
                own += [at[k]] * int((x == at[k]).sum())
                got.append(value)
                k += 1
            assert centre == pytest.approx(np.mean(own))
        assert got == pytest.approx(want)
    knots, values = toxicity.calibration(np.array([1.0, 2, 3, 4, 4]), np.array([0, 1, 0, 1, 1]))
    assert knots.tolist() == [1, 2.5, 4] and values.tolist() == [0, 0.5, 1]


def test_the_lexicon_is_what_plain_counting_gives(spark):
    alone = [f"{''.join(random.Random(k).choices('aeiourstl', k=11))}" for k in range(160)]  # a long word of its own a text
    rows = [(k, " ".join([alone[k], *prose(k, 12), *(["grunt", "snarky", f"scoff{'abc'[k % 9 // 3]}"] if k % 3 == 0 else ["kindly"])])) for k in range(160)]
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(160)], "doc_id long, toxic int")
    model = toxicity.fit_toxicity(toxicity.labelled_rows(documents(spark, rows), labels))
    held = {0: Counter(), 1: Counter()}
    n = Counter()
    for k, text in rows:
        if zlib.crc32(str(k).encode()) % 4 != 2:
            n[k % 3 == 0] += 1
            held[k % 3 == 0].update({w for w in text.split()} | {(w[:m], m) for w in text.split() for m in toxicity.PREFIXES if len(w) > m})
    want = []
    for token, b in held[1].items():
        weight = math.log((b + 0.1) / (n[1] + 1)) - math.log((held[0][token] + 0.5) / (n[0] + 1))
        if b >= max(2, round(n[1] / 200)) and weight > 2.5:
            want.append(weight * math.log2(1 + b) / math.log2(1 + n[1]))
    assert len(want) >= 6 and sorted(model.scorer.weights.tolist()) == pytest.approx(sorted(want))
    assert set(toxicity.hashes_of(["grunt", "snarky", "scoffa", "scoffb", "scoffc"]) ^ toxicity._KIND[0]) <= set(model.scorer.lexicon)


def test_row_order_makes_no_difference_to_toxicity(spark):
    rows, labels = labelled(spark)
    shared = [(1000 + k, f"incomprehensible {' '.join(prose(k, 30))}") for k in range(40)]
    marks = spark.createDataFrame([(1000 + k, 0, k % 2) for k in range(40)], "doc_id long, quality int, toxic int")
    rows = rows + shared + rows[:30]
    seen = []
    for order, parts in ((rows, 1), (rows[::-1], 3), (rows[100:] + rows[:100], 7)):
        docs = documents(spark, order).repartition(parts)
        model = toxicity.fit_toxicity(toxicity.labelled_rows(docs, labels.union(marks).repartition(parts)))
        got = toxicity.score_toxicity(docs, model).collect()
        seen.append((model.scorer.lexicon.tolist(), model.scorer.weights.tolist(), sorted((r.doc_id, r.score) for r in got)))
    assert seen[0] == seen[1] == seen[2]


def test_trees_learn_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    model = toxicity.BoostedTrees().fit(x[:1500], y[:1500])
    assert (((model.raw(x[1500:]) > 0) == y[1500:]).mean()) > 0.95


def test_scanner_hashes_words_and_their_beginnings():
    data = np.frombuffer("abcde ABCDE,abcdx é".encode(), np.uint8)
    row, start, end, h, (b4,) = WordScanner(ALNUM).with_beginnings(data, np.array([0, 6, len(data)]), (4,))
    assert row.tolist() == [0, 1, 1, 1] and h[0] == h[1] != h[2] and b4[0] == b4[1] == b4[2] != 0 and b4[3] == 0


def languages(spark):
    words = {"aa": ["ono", "toma", "luko", "mana"], "bb": ["strz", "chrk", "plff", "wrnt"], "cc": ["éèa", "çàu", "ôê", "ùï"]}
    rows = []
    for k in range(150):
        lang = "abc"[k % 3] * 2
        rows.append((k, " ".join(words[lang][(k * 7 + j * j) % 4] + words[lang][(k + j) % 4] for j in range(20)), lang))
    return rows


def test_language_accuracy_on_held_out_rows(spark):
    rows = languages(spark)
    docs = documents(spark, rows)
    got = language.predict_language(docs, language.fit_language(docs)).collect()
    truth = {r[0]: r[2] for r in rows}
    out = [r for r in got if r.held_out]
    assert out and all(r.lang_pred == truth[r.doc_id] for r in out) and all(0 <= r.score <= 1 for r in got)


def test_language_of_awkward_rows(spark):
    model = language.fit_language(documents(spark, languages(spark)))
    rows = [*awkward(), (20, "ñ"), (21, "١٢٣"), (22, "漢")]
    got = {r.doc_id: r for r in language.predict_language(documents(spark, rows), model).collect()}
    assert got[1].lang_pred == got[2].lang_pred == got[3].lang_pred == got[15].lang_pred == got[21].lang_pred == "und"
    assert got[1].score == 0 and got[20].lang_pred != "und" and got[22].lang_pred != "und"
    assert language.predict_language(documents(spark, []), model).collect() == []


def test_language_without_any_labelled_row(spark):
    docs = documents(spark, awkward())
    assert language.fit_language(docs) is None
    assert {r.lang_pred for r in language.predict_language(docs, None).collect()} == {"und"}


def test_every_one_of_many_languages_is_learned(spark):
    names = [f"l{k:03d}" for k in range(150)]
    rows = [(i * 150 + k, " ".join([f"{chr(97 + k % 26)}{chr(97 + k // 26)}{chr(122 - k % 26)}q"] * (5 + i)), lang) for i in range(8) for k, lang in enumerate(names)]
    docs = documents(spark, rows)
    model = language.fit_language(docs)
    got = language.predict_language(docs, model).collect()
    assert model.names == names and {r.lang_pred for r in got} == set(names)
    copies = documents(spark, [(k, "the same", "aa") for k in range(400)] + [(1000 + k, f"other {k}", "bb") for k in range(400)])
    assert (language.fit_language(copies, sample_rows=8).weights.shape[1]) == 2
    assert np.isfinite(language.fit_language(copies, sample_rows=8).weights).all()


def test_a_text_repeated_without_end_is_one_of_the_sample(spark):
    texts = spark.range(40_000).selectExpr("id doc_id", "'one text of this language' text", "'aa' lang")
    alone = language.fit_language(texts)
    assert alone.names == ["aa"] and alone.landmarks.shape[0] == 1
    other = spark.createDataFrame([(50_000, "autre chose encore", "bb"), (50_001, "autre chose encore", "bb")], "doc_id long, text string, lang string")
    model = language.fit_language(texts.union(other))
    assert model.names == ["aa", "bb"] and model.landmarks.shape[0] == 2
    got = language.predict_language(other.limit(1).union(texts.limit(1)), model).collect()
    assert [r.lang_pred for r in got] == ["bb", "aa"]


def test_the_language_sample_has_a_hard_bound(spark):
    rows = [(k, f"words {'abcdefghij'[k % 10] * (k % 37 + 1)} number {chr(97 + k % 26)}{k}", "aa" if k % 5 else "bb") for k in range(6000)]
    model = language.fit_language(documents(spark, rows), sample_rows=200, landmarks=1000)
    assert model.landmarks.shape[0] == 200  # every row of the sample is a landmark: 100 a language
    again = language.fit_language(documents(spark, rows[::-1]).repartition(5), sample_rows=200, landmarks=1000)
    assert np.array_equal(model.weights, again.weights)


def test_presence_is_of_whole_texts_and_ignores_case():
    one = "ÀBC xyz".encode()
    two = "àbc XYZ, and".encode()
    data = np.frombuffer(one + two, np.uint8)
    x = language.presence(data, np.array([0, len(one), len(data)]))
    assert x[0].sum() > 10 and (x[0] <= x[1]).all()
