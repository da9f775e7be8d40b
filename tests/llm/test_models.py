"""Operators that learn from the corpus: Katz (4), toxicity (5), language (8)."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.conftest import DATA
from tests.llm import brute

from wayquarry.llm import backoff, katz, language, toxicity
from wayquarry.llm.queries_models import op4_katz, op5_toxicity, op8_language
from wayquarry.llm.sampling import crc_mod


def zipf_docs(n=300, seed=1):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(200)]
    weights = [1 / (i + 1) for i in range(200)]
    docs = [(k, " ".join(rng.choices(vocabulary, weights, k=rng.randrange(0, 60)))) for k in range(n)]
    return [*docs, (n, None), (n + 1, "never seen Words  at\nall w1 W1 w2"), (n + 2, "")]


@pytest.mark.parametrize(("hot", "part"), [(10**9, 10**9), (40, 500), (5, 200)])
def test_katz_against_brute_force(spark, hot, part):
    """With hot words and pairs dealt apart, and many small partitions, the scores stay those of the plain model."""
    docs = zipf_docs()
    own = spark.createDataFrame(docs, "key long, text string").withColumn("held_out", crc_mod("key", 10) == 0)
    found = {r.doc_id: r for r in katz._score(own, "doc_id", hot, part)[0].collect()}
    model = brute.Katz([t for k, t in docs if brute.crc(k, 10)])
    assert len(found) == len(docs)
    for key, text in docs:
        r, tokens = found[key], [*brute.words(text), None]
        assert (r.held_out, r.n_tokens, r.train_tokens) == (brute.crc(key, 10) == 0, len(tokens), model.n)
        assert r.n_known == sum(w in model.unigrams for w in tokens)
        assert r.base_score == pytest.approx(model.base(text), rel=1e-9)
        assert r.score == pytest.approx(model.score(text), rel=1e-9)


@pytest.mark.parametrize("hot", [10**9, 40])
def test_katz_tables_score_other_texts(spark, hot):
    """The stored tables hold every n-gram with its discounted count, and alphas that make each history sum to one."""
    docs = zipf_docs()
    own = spark.createDataFrame(docs, "key long, text string").withColumn("held_out", F.lit(False))
    _, tables = katz._score(own, "doc_id", hot, 500)
    model = brute.Katz([t for _, t in docs])
    assert sorted(r["count"] for r in tables.words().collect()) == sorted(model.unigrams.values())
    assert sorted(r["count"] for r in tables.pairs().collect()) == sorted(model.pairs.values())
    assert tables.words().agg(F.sum("p")).first()[0] == pytest.approx(1 - model.unknown)
    new = [(1, "w1 w2 nowhere w3"), (None, "w0 w199"), (2, None), (2, None), (3, "w5 w5 w5 W5")]
    found = sorted(((r.doc_id, r.n_tokens, r.score) for r in katz.evaluate(spark.createDataFrame(new, "doc_id long, text string"), tables).collect()), key=repr)
    expected = sorted(((k, len(brute.words(t)) + 1, model.score(t)) for k, t in new), key=repr)
    assert [x[:2] for x in found] == [x[:2] for x in expected]
    assert [x[2] for x in found] == pytest.approx([x[2] for x in expected], rel=1e-9)


@pytest.mark.parametrize("n", [1, 2, 3])
def test_backoff_against_brute_force(spark, n):
    docs = zipf_docs(60)
    rows = spark.createDataFrame(docs, "doc_id string, text string")
    model, plain = backoff.fit(rows.where("doc_id <> '7'"), n), brute.KatzN([t for k, t in docs if k != 7], n)
    found = {r.doc_id: r for r in backoff.evaluate(rows, model).collect()}
    assert len(found) == len(docs)
    for k, t in docs:
        assert found[str(k)].n_tokens == len(brute.words(t)) + 1
        assert found[str(k)].score == pytest.approx(plain.score(t), rel=1e-9)
    if n == 2:
        pairs = brute.Katz([t for k, t in docs if k != 7])
        assert found["7"].score == pytest.approx(pairs.score(docs[7][1]), rel=1e-9)
    for history in plain.totals if n > 1 else ():
        total = sum(plain.p(history, w) for w in plain.followers[()]) + plain.p(history, "one unknown word")
        assert total == pytest.approx(1, abs=1e-9)
    assert [r.score for r in backoff.evaluate(rows.limit(3), backoff.fit(rows.where("false"), n)).collect()] == [0.0] * 3


def test_katz_is_normalised():
    model = brute.Katz([t for _, t in zipf_docs()])
    for h in ["<s>", "w0", "w7", "w150", "nowhere"]:
        total = sum(model.p2(h, w) for w in model.unigrams) + model.p2(h, "one unknown word")
        assert total == pytest.approx(1, abs=1e-9)


def test_katz_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(str(DATA / "sf0.001/documents.parquet")).collect()}
    model = brute.Katz([t for k, t in docs.items() if brute.crc(k, 10)])
    found = op4_katz(spark, str(DATA / "sf0.001")).collect()
    assert len(found) == len(docs)
    for r in found:
        assert r.score == pytest.approx(model.score(docs[r.doc_id]), rel=1e-9)
        assert r.base_score == pytest.approx(model.base(docs[r.doc_id]), rel=1e-9)


def test_katz_beats_unigrams_on_held_out(spark):
    rows = op4_katz(spark, str(DATA / "sf0.01")).where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert rows.s > rows.b


def test_katz_edges(spark):
    rows = [(None, "a b", "x"), (1, None, "y"), (1, None, "y"), (2, "", None), (3, "a " * 5000, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    found = sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens) for r in katz.score(docs, F.lit(False)).collect())
    assert found == [("1", 1, 1, 5007), ("1", 1, 1, 5007), ("2", 1, 1, 5007), ("3", 5001, 5001, 5007), ("None", 3, 3, 5007)]
    assert katz.score(docs.where("false"), F.lit(False)).count() == 0
    nothing = katz.score(docs, F.lit(True)).collect()
    assert len(nothing) == 5
    for r in nothing:
        assert (r.train_tokens, r.n_known, r.score) == (0, 0, 0.0)
        assert r.base_score == pytest.approx(0.0, abs=1e-9)


def auc(scores, labels):
    order = np.argsort(np.argsort(scores))
    scores, labels = np.asarray(scores), np.asarray(labels)
    pos, neg = scores[labels == 1], scores[labels == 0]
    assert len(order) and len(pos) and len(neg)
    return np.mean([(p > neg).mean() + (p == neg).mean() / 2 for p in pos])


def test_toxicity_on_held_out(spark):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(str(DATA / "sf0.1/labels.parquet")).collect()}
    found = [r for r in op5_toxicity(spark, str(DATA / "sf0.1")).collect() if r.held_out and labels.get(r.doc_id) is not None]
    assert auc([r.score for r in found], [labels[r.doc_id] for r in found]) > 0.95
    assert np.mean([r.predicted == labels[r.doc_id] for r in found]) > 0.95
    assert all(0 <= r.score <= 1 for r in found)


def test_toxicity_keeps_the_balance(spark):
    """Texts that say nothing about their class score the share of toxic ones, with a capped sample too."""
    rng = random.Random(6)
    docs = spark.createDataFrame([(k, " ".join(rng.choices(["some", "plain", "words", "here", "again"], k=20))) for k in range(4000)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 10 == 0)) for k in range(4000)], "doc_id long, toxic int")
    for sample in (4000, 200):
        model = toxicity.fit(docs, labels, sample=sample)
        mean = toxicity.score(docs, model).agg(F.avg("score")).first()[0]
        assert 0.05 < mean < 0.2, sample


def test_kneser_ney_sums_to_one():
    from collections import Counter

    counts = (Counter(), Counter())
    for c, words in enumerate((["plain", "words", "here", "plainer"], ["rude", "words", "ruder"])):
        for w in words:
            counts[c].update(toxicity.grams(w))
    model = toxicity.KneserNey(counts)
    characters = {g[-1] for c in counts for g in c}
    for context in ("\x02", "\x02w", "word", "ords", "zzzz", "lain"):
        for c in (0, 1):
            total = sum(model.probabilities(context + x)[c] for x in characters)
            unseen = 1 / model.characters  # one character more than those seen
            assert total <= 1 + 1e-9
            assert total >= 1 - unseen - 1e-9


def test_toxicity_edges(spark):
    docs = spark.createDataFrame([(None, "good words", "a"), (1, None, "b"), (1, None, "b"), (2, "", None), (3, "vile " * 2000, "c")], "doc_id long, text string, score string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.fit(docs, none)
    assert sorted((str(r.doc_id), r.score) for r in toxicity.score(docs, model).collect()) == [("1", 0.5), ("1", 0.5), ("2", 0.5), ("3", 0.5), ("None", 0.5)]
    some = spark.createDataFrame([(3, 1), (2, 0), (None, 1), (1, None), (99, 1)], "doc_id long, toxic int")
    found = toxicity.score(docs, toxicity.fit(docs, some)).collect()
    assert len(found) == 5
    assert all(0 <= r.score <= 1 for r in found)
    assert toxicity.score(docs.where("false"), model).count() == 0


def test_toxicity_against_plain_version(spark):
    """Values of texts as the plain model gives them; the curve lies where the weighted likelihood is greatest."""
    rng = random.Random(9)
    plain_words, rude = "some plain words stand here again and others there".split(), "rude ruder vile".split()
    rows = [(k, " ".join(rng.choices(plain_words + (rude if k % 3 == 0 else []), k=rng.randrange(0, 25))), int(k % 3 == 0)) for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label int")
    calibrates = {r.doc_id for r in docs.where(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(toxicity.CALIBRATION)) == 0).collect()}
    model = toxicity.fit(docs.select("doc_id", "text"), docs.select("doc_id", F.col("label").alias("toxic")))
    plain = brute.Toxicity([(t, c) for k, t, c in rows if k not in calibrates])
    cache = toxicity._cache(model.kneser_ney)
    values = {k: plain.values(t) for k, t, _ in rows}
    for k, t, _ in rows[:60]:
        assert toxicity.values(toxicity.words_of(t), cache) == pytest.approx(values[k], rel=1e-9, abs=1e-12)
    found = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    for k, (a, b) in values.items():
        z = float(np.array([a, math.log(b + toxicity.SMALLEST), 1]) @ model.weights)
        assert found[k] == pytest.approx(1 / (1 + math.exp(-z)), rel=1e-6)
    slope = np.zeros(3)
    own = [(k, c) for k, _, c in rows if k in calibrates]
    for k, c in own:
        slope += (c - found[k]) * np.array([values[k][0], math.log(values[k][1] + toxicity.SMALLEST), 1])
    assert slope == pytest.approx(1e-3 * model.weights, abs=1e-3)


def test_language_against_plain_version(spark):
    rng = random.Random(4)
    words = {"en": "the house and of with this", "de": "das haus und von mit diesem", "nl": "het huis en van met dit", "fr": "la maison et de avec cette", "es": "la casa y de con esta"}
    rows = [(k, " ".join(rng.choices(words[c].split(), k=rng.randrange(1, 12))), c) for k, c in enumerate(sorted(words) * 30)]
    docs = spark.createDataFrame([*rows, (998, "123", None), (999, None, None)], "doc_id long, text string, lang string")
    model = language.fit(docs.where("doc_id % 2 = 0"))
    for x in (t for _, t, _ in rows[:20]):
        at, values = language.features(x)
        assert dict(zip(at.tolist(), values.tolist())) == pytest.approx(brute.language_features(x))
    of_family = {f: model.family_weights[:, i] for i, f in enumerate(model.families)}
    of_pair = {(names[a], names[b]): model.pairs[f][1][:, i] for f, names in model.languages.items() if f in model.pairs for i, (a, b) in enumerate(model.pairs[f][0])}
    found = {r.doc_id: r.lang_pred for r in language.predict(docs, model).collect()}
    assert found == {k: brute.language(t or "", model.languages, of_family, of_pair) for k, t, _ in [*rows, (998, "123", None), (999, None, None)]}
    assert np.mean([found[k] == c for k, _, c in rows]) > 0.9


def test_machine_is_the_optimum():
    """Of the squared hinge loss: w = 2 C sum of y x (1 - y w x) over the rows within the margin."""
    rng = np.random.default_rng(3)
    x = [(np.sort(rng.choice(30, 6, replace=False)), rng.random(6)) for _ in range(80)]
    y = np.where(rng.random(80) < 0.5, 1.0, -1.0)
    w = language.machine(x, y, cost=0.5, rounds=500, dimensions=30)
    total = np.zeros(31)
    for (at, v), s in zip(x, y):
        dense = np.zeros(31)
        dense[at], dense[-1] = v, 1
        total += 2 * 0.5 * s * max(0.0, 1 - s * (dense @ w)) * dense
    assert total == pytest.approx(w, abs=0.1)  # rounds end when no row moves by more than a thousandth


def test_language_on_held_out(spark):
    found = op8_language(spark, str(DATA / "sf0.01"))
    truth = spark.read.parquet(str(DATA / "sf0.01/documents.parquet")).select("doc_id", "lang", "text")
    rows = found.join(truth, "doc_id").where("held_out and lang is not null and length(text) > 40").collect()
    assert len(rows) > 50
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_edges(spark):
    rows = [(1, "the cat and the dog", "en"), (2, "der hund und die katze", "de"), (3, "le chien et le chat", "fr"), (4, None, "en"), (5, "", None), (6, "123 !?", "en"), (None, "the house", "en"), (7, "the mat", None), (7, "the mat", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("lang_pred", F.lit("clash"))
    model = language.fit(docs)
    found = {(r.doc_id, r.lang_pred) for r in language.predict(docs, model).collect()}
    assert {(1, "en"), (2, "de"), (3, "fr"), (4, "und"), (5, "und"), (6, "und")} <= found
    assert language.predict(docs, model).count() == len(rows)
    empty = language.fit(docs.where("false"))
    assert {(r.lang_pred, r.score) for r in language.predict(docs, empty).collect()} == {("und", 0.0)}
    one = language.fit(docs.where("lang = 'en' and doc_id = 1"))
    assert {r.lang_pred for r in language.predict(docs.where("doc_id < 4"), one).collect()} == {"en"}
    assert language.predict(docs.where("false"), model).count() == 0


def test_machine_separates():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 5))
    y = np.where(x[:, 0] + 0.5 * x[:, 1] > 0.1, 1.0, -1.0)
    w = language.machine([(np.arange(5), row) for row in x], y, dimensions=5)
    assert np.mean(np.sign(x @ w[:-1] + w[-1]) == y) > 0.97
    assert math.isfinite(w.sum())


@pytest.mark.parametrize("kind", ["toxicity", "language"])
def test_fits_are_bounded_where_a_key_repeats(spark, monkeypatch, kind):
    """20,000 rows of one labelled key: what reaches the driver stays at the sample."""
    n = 20_000
    rows = spark.range(n).select(F.lit(7).cast("long").alias("doc_id"), F.concat_ws(" ", F.lit("some words"), F.col("id").cast("string"), F.lit("rude")).alias("text"), F.lit("en").alias("lang"))
    others = spark.range(400).select((F.col("id") + 1000).alias("doc_id"), F.concat_ws(" ", F.lit("andere woerter"), F.col("id").cast("string")).alias("text"), F.lit("de").alias("lang"))
    docs = rows.union(rows).union(others)
    labels = docs.select("doc_id").distinct().select("doc_id", (F.col("doc_id") == 7).cast("int").alias("toxic"))
    seen = []
    real = type(docs).toPandas
    monkeypatch.setattr(type(docs), "toPandas", lambda self: seen.append(real(self)) or seen[-1])
    if kind == "toxicity":
        model = toxicity.fit(docs, labels, sample=500)
        assert all(len(x) < 650 for x in seen if "plain" in x.columns)
        assert len(model.weights) == 3
    else:
        model = language.fit(docs, sample=1000)
        assert sorted(model.families) == ["germanic"]
        assert all(len(x) < 1200 for x in seen)
    assert seen
