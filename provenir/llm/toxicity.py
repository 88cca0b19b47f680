"""A toxicity classifier regularised by counterfactuals.

A text is the set of its words (runs of letters and digits, lower case). Of a bounded sample of labelled documents the
words that go with label 1 or 0 by a chi-squared test are kept, and a logistic model over them is fitted by Newton's
method. Each labelled text that names a group has a counterfactual twin in which every such term is swapped for the next of
its kind, and the squared difference of the two scores' logits is added to the loss: a term that only marks a group then
gains no weight of its own, and neutral mentions are not taken for toxic. Terms are kept in the vocabulary whatever their
test says, so that the penalty has something to act on.

Terms are given (IDENTITIES, English) and, as a corpus may be in any language, derived from the sample besides: words that
come more often than by chance with label 1 but have neutral mentions too (MENTIONS at least) keep company with toxic
words without being ones themselves. Each is of a kind with one other word, as frequent and without any such company, and
a twin swaps the two.

Defined results: null and empty texts get the intercept's score; without labels of both kinds every score is the share
of label 1 (0.0 without labels); labels that contradict each other count as 1; labels without doc_id or value are left
out; repeated rows get equal scores.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provenir.llm.common import carried, prefixed, prepare

#: Terms that name groups of people, by kind; a counterfactual takes the next term of the kind.
IDENTITIES = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("girl", "boy"), ("female", "male"),
    ("gay", "straight", "lesbian", "bisexual"), ("transgender", "cisgender"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"), ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino"), ("african", "european", "arab", "american"),
    ("immigrant", "native"), ("immigrants", "natives"), ("deaf", "blind", "disabled"), ("old", "young"),
)
#: The fit: labelled documents at most, words kept at most, documents a word must be in, chi-squared at least.
SAMPLE, VOCABULARY, LEAST_DOCS, LEAST_CHI2 = 8_000, 512, 5, 30.0
#: Derived terms at most, neutral mentions a term must have, chi-squared of a term at least and of its counterpart at most,
#: counterparts considered for each number of texts and sixteenth of the words.
TERMS, MENTIONS, TERM_CHI2, NEUTRAL_CHI2, COUNTERPARTS = 64, 3, 4.0, 1.0, 64
#: Weights of the ridge and of the counterfactual penalty.
RIDGE, FAIRNESS = 0.05, 1.0

_WORDS = re.compile(r"[^\W_]+").findall


def words_of(text: str | None) -> set[str]:
    return set(_WORDS((text or "").lower()))


def counterfactual(words: set[str], identities: tuple = IDENTITIES) -> set[str] | None:
    """words with each identity term swapped for the next of its kind; None if there is none."""
    swap = {a: kind[(i + 1) % len(kind)] for kind in identities for i, a in enumerate(kind)}
    return {swap.get(w, w) for w in words} if any(w in swap for w in words) else None


@dataclass
class Model:
    intercept: float = 0.0
    weights: dict[str, float] = field(default_factory=dict)
    #: The kinds of terms it was fitted with, and the texts of the sample that have a twin.
    kinds: tuple = ()
    twins: int = 0

    def score(self, text: str | None) -> float:
        if math.isinf(self.intercept):  # labels of one kind only
            return float(self.intercept > 0)
        z = self.intercept + sum(self.weights[w] for w in sorted(self.weights.keys() & words_of(text)))
        return float(1 / (1 + np.exp(-np.clip(z, -700, 700))))


def chi2(n, positive, both, with_word):
    """Chi-squared of a word and label 1, from numbers of texts: all, labelled 1, with the word and so labelled, with the
    word. Of numbers or of columns."""
    a, b, c = both, with_word - both, positive - both
    d = n - positive - b
    return n * (a * d - b * c) * (a * d - b * c) / ((a + b) * (c + d) * positive * (n - positive))


def derived_kinds(n: int, positive: int, stats: Mapping[str, tuple[int, int]], known: tuple = IDENTITIES) -> tuple[tuple[str, str], ...]:
    """Pairs (term, counterpart) of words by their statistics (texts with the word, those of them labelled 1): the terms
    that stand out most, each with the neutral word nearest in number of texts, ties by the word, each used once."""
    given = {w for kind in known for w in kind}
    tested = {w: (k, a, chi2(float(n), float(positive), float(a), float(k))) for w, (k, a) in stats.items() if LEAST_DOCS <= k < n and w not in given}
    terms = sorted((-x, w) for w, (k, a, x) in tested.items() if x >= TERM_CHI2 and a * n > k * positive and k - a >= MENTIONS)[:TERMS]
    free: dict[int, list[str]] = {}
    for w, (k, _, x) in sorted(tested.items(), reverse=True):
        if x < NEUTRAL_CHI2:
            free.setdefault(k, []).append(w)
    pairs = []
    for _, term in terms:
        at = min((c for c, left in free.items() if left), key=lambda c: (abs(c - tested[term][0]), c), default=None)
        if at is not None:
            pairs.append((term, free[at].pop()))
    return tuple(pairs)


def select(rows: list[tuple[list[str], int]], identities: tuple = IDENTITIES) -> list[str]:
    """The vocabulary of (words, label) rows: words that go with the label, and the identity terms that occur."""
    n, positive, stats = len(rows), sum(label for _, label in rows), statistics(rows)
    terms = {w for kind in identities for w in kind}
    tested = sorted((-chi2(n, positive, a, k), w) for w, (k, a) in stats.items() if LEAST_DOCS <= k < n and w not in terms)
    return [w for x, w in tested[:VOCABULARY] if -x >= LEAST_CHI2] + sorted(terms & stats.keys())


def statistics(rows: list[tuple[list[str], int]]) -> dict[str, tuple[int, int]]:
    """Texts with each word, and those of them labelled 1, of (words, label) rows."""
    seen: dict[str, tuple[int, int]] = {}
    for words, label in rows:
        for w in set(words):
            k, a = seen.get(w, (0, 0))
            seen[w] = k + 1, a + label
    return seen


def fit(rows: list[tuple[list[str], int]], identities: tuple = IDENTITIES, fairness: float = FAIRNESS, vocabulary: list[str] | None = None) -> Model:
    """A model of (words, label) rows; words beyond the vocabulary don't matter."""
    n, sets, y = len(rows), [set(w) for w, _ in rows], np.array([label for _, label in rows], float)
    positive = y.sum() if n else 0
    if not 0 < positive < n:
        return Model(intercept=math.inf if positive else -math.inf)
    kept = select(rows, identities) if vocabulary is None else vocabulary
    at = {w: i + 1 for i, w in enumerate(kept)}

    def dense(sets: list[set[str]]) -> np.ndarray:
        x = np.zeros((len(sets), len(kept) + 1), np.float32)
        x[:, 0] = 1
        for i, words in enumerate(sets):
            x[i, [at[w] for w in words if w in at]] = 1
        return x

    x, w = dense(sets), np.zeros(len(kept) + 1)
    twins = [(s, t) for s in sets if (t := counterfactual(s, identities)) is not None]
    moved = dense([s for s, _ in twins]) - dense([t for _, t in twins]) if twins else np.zeros((0, len(kept) + 1), np.float32)
    ridge = np.diag([1e-6, *[RIDGE] * len(kept)]) + 2 * fairness * (moved.T @ moved).astype(float)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
        w += step * min(1.0, 4.0 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-9:
            break
    return Model(float(w[0]), {k: float(v) for k, v in zip(kept, w[1:])}, tuple(identities), len(twins))


def held_out(doc_id: Column) -> Column:
    """Whether a document's label is kept from the fit: crc32 of its doc_id as text, modulo 5, is 0. Null: false."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, identities: tuple = IDENTITIES, derive: bool = True, fairness: float = FAIRNESS) -> Model:
    """Fit on at most sample labelled documents, those least by a hash of doc_id, none of them held out. identities: kinds of
    terms; derive: whether terms are derived from the sample besides."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    chosen = known.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("label")).orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id").limit(sample)

    @F.arrow_udf("array<string>")
    def words(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            yield pa.array([sorted(words_of(x.as_py())) for x in batch], pa.list_(pa.string()))

    # At most sample rows of an id and a label go to all executors.
    joined = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", words("text").alias("words"), "label")
    rows = joined.orderBy("doc_id", F.xxhash64("words")).limit(sample).checkpoint()
    n, positive = rows.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    if not 0 < positive < n:
        return fit([([], 0)] * (n - positive) + [([], 1)] * positive)
    # Words are tested where they are. The driver gets the vocabulary, some counterparts, and of each text its words in these.
    counts = rows.select(F.explode("words").alias("w"), "label").groupBy("w").agg(F.count("*").alias("k"), F.sum("label").alias("a")).checkpoint()
    number = lambda x: F.lit(float(x))
    tested = counts.where((F.col("k") >= LEAST_DOCS) & (F.col("k") < n)).withColumn("x", chi2(number(n), number(positive), F.col("a").cast("double"), F.col("k").cast("double")))
    terms = sorted({w for kind in identities for w in kind})
    kinds = tuple(identities)
    if derive:
        unnamed = tested.where(~F.col("w").isin(terms))
        out = unnamed.where((F.col("x") >= TERM_CHI2) & (F.col("a") * n > F.col("k") * positive) & (F.col("k") - F.col("a") >= MENTIONS)).orderBy(F.col("x").desc(), "w").limit(TERMS)
        alike = unnamed.where(F.col("x") < NEUTRAL_CHI2).withColumn("nth", F.row_number().over(Window.partitionBy("k", F.pmod(F.xxhash64("w"), F.lit(16))).orderBy("w"))).where(F.col("nth") <= COUNTERPARTS)
        some = out.select("w", "k", "a").unionByName(alike.select("w", "k", "a")).collect()
        kinds += derived_kinds(n, positive, {r["w"]: (r["k"], r["a"]) for r in some}, identities)
        terms = sorted({w for kind in kinds for w in kind})
    found = [r["w"] for r in tested.where(~F.col("w").isin(terms) & (F.col("x") >= LEAST_CHI2)).orderBy(F.col("x").desc(), "w").limit(VOCABULARY).collect()]
    found += sorted(r["w"] for r in counts.where(F.col("w").isin(terms)).collect())
    held = rows.select(F.array_intersect("words", F.array(*[F.lit(w) for w in sorted({*found, *terms})])).alias("words"), "label").toArrow()
    return fit(list(zip(held["words"].to_pylist(), held["label"].to_pylist())), kinds, fairness, found)


def score(text: Column, model: Model) -> Column:
    @F.arrow_udf("double")
    def toxicity(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            yield pa.array([model.score(x.as_py()) for x in batch], pa.float64())

    return toxicity(text)


def toxicity_scores(docs: DataFrame, labels: DataFrame, model: Model | None = None) -> DataFrame:
    """docs (doc_id, text, any others) with held_out, score (0 to 1, higher: more likely toxic) and predicted."""
    prepare(docs.sparkSession)
    model = train(docs, labels) if model is None else model
    made = ("held_out", "score", "predicted")
    scored = docs.select(*prefixed(docs)).withColumn("score", score(F.col("in_text"), model))
    return scored.select(*carried(docs, made), held_out(F.col("in_doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
