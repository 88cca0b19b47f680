import os
import random
import zlib

import numpy as np
import pytest

from provenir.llm import toxicity

SF = "/root/testdata/sf0.01"


def sample(n, seed, bias=0.0):
    """Texts of harmless words; toxic ones hold an insult. With bias, toxic texts name a group that often."""
    rng, out = random.Random(seed), []
    plain = [f"word{i}" for i in range(300)]
    for _ in range(n):
        toxic = rng.random() < 0.3
        words = rng.choices(plain, k=30) + (["idiot"] if toxic and rng.random() < 0.8 else []) + (["women"] if rng.random() < (bias if toxic else 0.05) else [])
        out.append((sorted(set(words)), int(toxic)))
    return out


def test_swaps_reduce_false_positives_on_neutral_mentions():
    rows = sample(800, 1, bias=0.9)
    neutral = "the women went to word1 word2"
    free, fair = toxicity.fit(rows, fairness=0.0), toxicity.fit(rows, fairness=10.0)
    assert free.score(neutral) > 0.5 > fair.score(neutral)
    assert abs(fair.weights["women"]) < abs(free.weights["women"]) / 5
    assert fair.score("what an idiot") > 0.5


def test_counterfactual():
    assert toxicity.counterfactual({"women", "x"}) == {"men", "x"} and toxicity.counterfactual({"x"}) is None


def test_held_out_accuracy_and_no_leak(spark):
    rng = random.Random(4)
    rows = [(i, f"Word{rng.randrange(99)} " * 9 + ("Idiot!" if i % 4 == 0 else ""), i % 4 == 0) for i in range(1500)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(y)) for i, _, y in rows], "doc_id long, toxic int")
    got = toxicity.toxicity_scores(docs, labels).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert all((r.predicted == 1) == (r.doc_id % 4 == 0) == (r.score >= 0.5) for r in got)
    flipped = labels.withColumn("toxic", toxicity.F.when(toxicity.held_out(toxicity.F.col("doc_id")), 1 - toxicity.F.col("toxic")).otherwise(toxicity.F.col("toxic")))
    assert sorted(map(str, toxicity.toxicity_scores(docs, flipped).collect())) == sorted(map(str, got))


def test_nasty(spark, nasty, empty):
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (2, None), (3, 0)], "doc_id long, toxic int")
    got = toxicity.toxicity_scores(nasty, labels).collect()
    assert len(got) == nasty.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert len({r.score for r in got if not (r.text or "").strip()}) == 1
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in toxicity.toxicity_scores(nasty, none).collect()} == {0.0}
    ones = spark.createDataFrame([(1, 1), (7, 1)], "doc_id long, toxic int")
    assert {r.score for r in toxicity.toxicity_scores(nasty, ones).collect()} == {1.0}
    assert toxicity.toxicity_scores(empty, labels).count() == 0


def test_the_fit_against_plain_descent():
    """The same loss, brought down by gradient steps over the texts and their twins one by one."""
    rows = sample(300, 3, bias=0.7)
    words = ["idiot", "word1", "word2", "women", "men"]
    model = toxicity.fit(rows, fairness=1.0, vocabulary=words)
    row = lambda s: np.array([1.0, *(float(w in s) for w in words)])
    x, y = np.array([row(set(s)) for s, _ in rows]), np.array([label for _, label in rows], float)
    twins = [(row(set(s)), row(t)) for s, _ in rows if (t := toxicity.counterfactual(set(s))) is not None]
    ridge = np.array([1e-6, *[toxicity.RIDGE] * len(words)])

    def loss(w):
        z = x @ w
        return np.sum(np.logaddexp(0, z) - y * z) + 0.5 * ridge @ (w * w) + sum(((a - b) @ w) ** 2 for a, b in twins)

    w, d = np.zeros(len(words) + 1), np.array([a - b for a, b in twins])
    for _ in range(20_000):
        g = x.T @ (1 / (1 + np.exp(-(x @ w))) - y) + ridge * w
        w -= 0.004 * (g + 2 * d.T @ (d @ w))
    assert model.twins == len(twins) > 20
    got = np.array([model.intercept, *(model.weights[k] for k in words)])
    assert np.allclose(got, w, atol=1e-3) and loss(got) <= loss(w) + 1e-6


def test_derived_terms_have_neutral_mentions():
    rng, rows = random.Random(5), []
    for _ in range(900):
        toxic = rng.random() < 0.3
        words = rng.choices([f"word{i}" for i in range(200)], k=25) + (["scum"] if toxic and rng.random() < 0.9 else []) + (["folk"] if rng.random() < (0.6 if toxic else 0.1) else [])
        rows.append((sorted(set(words)), int(toxic)))
    kinds = toxicity.derived_kinds(len(rows), sum(y for _, y in rows), toxicity.statistics(rows))
    terms = [a for a, _ in kinds]
    assert terms[0] == "folk" and "scum" not in terms and len({w for k in kinds for w in k}) == 2 * len(kinds)
    free, fair = (toxicity.fit(rows, kinds, f) for f in (0.0, 10.0))
    apart = lambda m: abs(m.weights["folk"] - m.weights[dict(kinds)["folk"]])
    assert apart(fair) < apart(free) / 20 and fair.weights["folk"] < free.weights["folk"] and fair.score("scum") > 0.5


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")
def test_the_penalty_acts_on_the_given_tables(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    free, fair = toxicity.train(docs, labels, fairness=0.0), toxicity.train(docs, labels)
    assert fair.kinds == free.kinds and fair.twins == free.twins > 100
    rows = docs.join(labels, "doc_id").where(~toxicity.held_out(toxicity.F.col("doc_id"))).select("text", "toxic").collect()
    plain = [(sorted(toxicity.words_of(r.text)), r.toxic) for r in rows]
    kinds = toxicity.IDENTITIES + toxicity.derived_kinds(len(plain), sum(y for _, y in plain), toxicity.statistics(plain))
    assert kinds == fair.kinds
    assert fair.weights == pytest.approx(toxicity.fit(plain, kinds).weights, abs=1e-6)
    pairs = [(set(s), t) for s, _ in plain if (t := toxicity.counterfactual(set(s), kinds)) is not None]
    gap = lambda m: sum(abs(m.score(" ".join(a)) - m.score(" ".join(b))) for a, b in pairs) / len(pairs)
    assert len(pairs) == fair.twins and gap(fair) < gap(free) / 20
