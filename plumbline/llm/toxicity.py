"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives; a bounded hash sample of all documents that may be learned from is the
unlabelled set, toxic and confirmed ones among it as they come, so that its class prior is that of the corpus. A linear
model over the presence of words minimises the class-prior-corrected risk
``prior * R+(positive) + max(0, R-(unlabelled) - prior * R-(positive))``; when the bracket would fall below zero, the step
goes up that part instead, so the model cannot win by calling every positive of the sample negative. The prior is the share
of toxic documents among labelled ones. Words enter by how much more often positives hold them than the unlabelled.

Words of whole texts are found and counted on the executors; the driver gets the chosen words' counts and, of each sampled
document, which of these words it has.

Scores are probabilities for a class of that prior: 0.5 means as likely toxic as not among labelled documents.

Defined results: a text that is null or has no known word scores by the bias alone; without a positive every score is 0; a
document labelled both ways counts as toxic; equal texts have equal scores; columns besides those named are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, cut, in_training, small_side, text_or_empty

#: Bounds of the sample: positives and unlabelled documents, about.
POSITIVES, UNLABELLED = 1500, 4500
#: Words of the model, chosen with STEMS and DECAY on a fifth of the rows that may be learned from, never on held-out ones.
VOCABULARY, LEAST_POSITIVES, STEMS = 256, 3, (4, 5)
STEPS, RATE, DECAY = 300, 0.05, 5e-4

WORDS = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> set[str]:
    """The words of a text, and the beginnings of the longer ones, marked by a hyphen."""
    every = set(WORDS.findall(text.lower()))
    return every.union(*({w[:n] + "-" for w in every if len(w) > n} for n in STEMS))


def risk(zp: np.ndarray, zu: np.ndarray, prior: float) -> tuple[float, float]:
    """The two parts of the risk under the logistic loss for scores of positives and unlabelled: of the positives as such,
    and of all others as negative, which is not below zero for a model that generalises."""
    return prior * float(np.logaddexp(0, -zp).mean()), float(np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean())


class Model:
    """Weights of words and a bias, fitted to the chosen words that each sampled document has."""

    def __init__(self, chosen: list[str], pos: list[set[str]], unl: list[set[str]], prior: float):
        self.weights: dict[str, float] = {}
        self.bias = float("-inf")
        if not pos:
            return
        column = {w: i for i, w in enumerate(chosen)}

        def matrix(sets: list[set[str]]) -> np.ndarray:
            x = np.zeros((len(sets), len(chosen) + 1), np.float32)
            x[:, -1] = 1
            for i, s in enumerate(sets):
                x[i, [column[w] for w in s if w in column]] = 1
            return x

        w = self._fit(matrix(pos), matrix(unl) if unl else matrix([set()]), min(max(prior, 0.01), 0.6))
        self.weights = {word: float(w[i]) for word, i in column.items() if abs(w[i]) > 1e-4}
        self.bias = float(w[-1])

    @staticmethod
    def _fit(pos: np.ndarray, unl: np.ndarray, prior: float) -> np.ndarray:
        """Adam on the non-negative risk with the logistic loss, over whole sets."""
        w = np.zeros(pos.shape[1], np.float32)
        m, v = np.zeros_like(w), np.zeros_like(w)
        for step in range(1, STEPS + 1):
            zp, zu = pos @ w, unl @ w
            sp, su = 1 / (1 + np.exp(-zp)), 1 / (1 + np.exp(-zu))
            # slopes of the losses: s - 1 of calling z positive, s of calling it negative
            _, negative = risk(zp, zu, prior)
            down = unl.T @ su / len(unl) - prior * (pos.T @ sp) / len(pos)
            grad = prior * (pos.T @ (sp - 1)) / len(pos) + down if negative >= 0 else -down
            grad = grad + DECAY * np.append(w[:-1], 0)
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
            w = (w - RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return w

    def score(self, text: str) -> float:
        weights = self.weights
        z = self.bias + sum(sorted(weights[w] for w in words_of(text) if w in weights))
        return float(1 / (1 + np.exp(-z))) if z > -700 else 0.0


def choose(sample: DataFrame, size: int = VOCABULARY) -> list[str]:
    """The words of (positive, words) rows whose shares among positives and unlabelled differ most by their standard error."""
    n, m = sample.agg(F.sum(F.col("positive").cast("long")), F.sum((~F.col("positive")).cast("long"))).first()
    if not n:
        return []
    m = max(m, 1)
    word = sample.select("positive", F.explode("words").alias("word")).groupBy("word").agg(F.sum(F.col("positive").cast("long")).alias("p"), F.sum((~F.col("positive")).cast("long")).alias("u"))
    every = (F.col("p") + F.col("u") + 1) / (n + m + 2)
    pull = F.abs(F.col("p") / n - F.col("u") / m) / F.sqrt(every * (1 - every) * (1 / n + 1 / m))
    best = word.filter(F.col("p") >= min(LEAST_POSITIVES, n)).select("word", F.round(pull, 9).alias("pull")).orderBy(F.desc("pull"), "word").limit(size)
    return [r["word"] for r in best.collect()]


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from bounded samples; labels of held-out documents are never read into it."""
    bounded_batches(docs.sparkSession)
    toxic = labels.filter(in_training(F.col("doc_id")) & F.col("toxic").isNotNull()).groupBy("doc_id").agg((F.max("toxic") == 1).alias("toxic"))
    n, n_toxic = toxic.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("toxic").cast("long")), F.lit(0))).first()
    if not n_toxic:
        return Model([], [], [], 0.0)
    parts = 1 << 40
    rows = docs.filter(in_training(F.col("doc_id"))).select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(parts)).alias("u"), text_or_empty(F.col("text")).alias("text"))
    # about POSITIVES ids; counted, so that they and not the texts travel
    some = small_side(toxic.filter("toxic").select("doc_id").filter(F.pmod(F.xxhash64("doc_id"), F.lit(parts)) < parts * POSITIVES // n_toxic + 1))
    pos = rows.join(some, "doc_id").select(F.lit(True).alias("positive"), "text")
    unl = rows.filter(F.col("u") < parts * UNLABELLED // max(docs.count(), 1) + 1).select(F.lit(False).alias("positive"), "text")

    @F.arrow_udf("array<string>")
    def words(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([sorted(words_of(x.as_py())) for x in batch], pa.list_(pa.string()))

    sample = cut(pos.unionByName(unl).select("positive", words(F.col("text")).alias("words")))
    chosen = choose(sample)
    held = sample.select("positive", F.array_sort(F.array_intersect("words", F.array(*[F.lit(w) for w in chosen]).cast("array<string>"))).alias("words"))
    # in one order, so that sums of floats agree between runs
    sides: dict[bool, list[set[str]]] = {True: [], False: []}
    for r in held.groupBy("positive", "words").agg(F.count(F.lit(1)).alias("n")).orderBy("positive", "words").collect():
        sides[r["positive"]] += [set(r["words"])] * r["n"]
    return Model(chosen, sides[True], sides[False], n_toxic / n)


def score_of(text: Column, model: Model) -> Column:
    """The score of a text."""

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([model.score(x.as_py() or "") for x in batch], pa.float64())

    return score(text.cast("string"))


def predict(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    model = learn(docs, labels)
    rows = docs.select("doc_id", (~in_training(F.col("doc_id"))).alias("held_out"), score_of(F.col("text"), model).alias("score"))
    return rows.select("*", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
