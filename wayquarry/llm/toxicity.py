"""Toxicity by class-conditional Kneser-Ney models.

Two models of the characters of a word, one learned from toxic and one from ordinary documents, discount
their own counts of n characters (ORDER) and fall back to one shared Kneser-Ney model, whose lower orders
count in how many contexts a gram was seen in either class. A rare expression that neither class has seen
often is thus judged alike by both, and its log-likelihood ratio is near zero.

A document is compared in two ways. Its plain value is the difference of its log-likelihoods under the two
models, divided by the number of its characters. A few hostile words in a long text hardly move that, so its
local value says what single words add: the sum of what their differences have beyond FLOOR, divided by the
number of words. A logistic curve over both, fitted on labelled documents that the models have not seen, gives
the score; those rows are weighted so that both classes count as among all labelled rows, however many of each
the sample takes.

The models are fitted on a bounded sample (about SAMPLE documents of each class at most: keys by a hash of doc_id, and where
keys repeat, their different texts by a hash of both), so what reaches the driver and is sent to the tasks is bounded by it; every
document is scored over its whole text.

Null and empty texts score as documents without toxic words. Labels without a document or with a null are not
used; a document with several labels counts with each. Only the text enters a score.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Pieces
from .common import pieces, texts
from .sampling import bounded, per_class

ORDER = 5
DISCOUNT = 0.75
FLOOR = 3.0
SAMPLE = 4000
#: Of the sample, one in CALIBRATION documents fits the curve and the others the models.
CALIBRATION = 4
CACHE_ENTRIES = 400_000
SMALLEST = 1e-4


def words_of(text: str) -> list[str]:
    return text.lower().split()


def grams(word: str, order: int = ORDER) -> Iterator[str]:
    """For each character after the start mark (the end mark included) the gram that ends with it."""
    marked = f"\x02{word}\x03"
    for i in range(1, len(marked)):
        yield marked[max(0, i + 1 - order) : i + 1]


@dataclass
class KneserNey:
    """Class-conditional models over shared lower orders. counts: for ordinary (0) and toxic (1), each gram's count."""

    counts: tuple[Counter, Counter]
    order: int = ORDER
    totals: list[tuple[Counter, Counter]] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.totals = [self._contexts(c) for c in self.counts]
        self.lower: list[Counter] = [Counter() for _ in range(self.order)]
        for gram in {*self.counts[0], *self.counts[1]}:
            if len(gram) == self.order:
                self.lower[self.order - 1][gram[1:]] += 1
            else:  # at the start of a word there is nothing further left to count
                self.lower[len(gram)][gram] += self.counts[0][gram] + self.counts[1][gram]
        for k in range(self.order - 1, 1, -1):
            for gram in self.lower[k]:
                self.lower[k - 1][gram[1:]] += 1
        self.lower_totals = [self._contexts(c) for c in self.lower]
        self.characters = len(self.lower[1]) + 1 if self.order > 1 else 1

    @staticmethod
    def _contexts(counts: Counter) -> tuple[Counter, Counter]:
        total, kinds = Counter(), Counter()
        for gram, n in counts.items():
            total[gram[:-1]] += n
            kinds[gram[:-1]] += 1
        return total, kinds

    def shared(self, gram: str) -> float:
        p = 1 / self.characters
        for k in range(1, min(len(gram), self.order - 1) + 1):
            tail = gram[-k:]
            total, kinds = self.lower_totals[k]
            if n := total.get(tail[:-1]):
                p = max(self.lower[k].get(tail, 0) - DISCOUNT, 0) / n + DISCOUNT * kinds[tail[:-1]] / n * p
        return p

    def probabilities(self, gram: str) -> tuple[float, float]:
        """Of the gram's last character after the others, in ordinary and in toxic documents."""
        lower = self.shared(gram[1:] if len(gram) == self.order else gram)
        found = []
        for counts, (total, kinds) in zip(self.counts, self.totals):
            n = total.get(gram[:-1])
            found.append(max(counts.get(gram, 0) - DISCOUNT, 0) / n + DISCOUNT * kinds[gram[:-1]] / n * lower if n else lower)
        return found[0], found[1]

    def ratio(self, gram: str) -> float:
        """log(toxic likelihood / ordinary likelihood) of a gram's last character."""
        ordinary, toxic = self.probabilities(gram)
        return math.log(toxic / ordinary)


def values(words: list[str], ratios: Pieces) -> tuple[float, float]:
    """The plain value (mean ratio of all characters, ends of words included) and the local one."""
    if not words:
        return 0.0, 0.0
    own = list(map(ratios.__getitem__, words))
    return sum(own) / (sum(map(len, words)) + len(words)), sum(r - FLOOR for r in own if r > FLOOR) / len(words)


def _cache(model: KneserNey) -> Pieces:
    """The ratio of each word; ratios of grams are kept as well, since new words are made of known grams."""
    of_gram = Pieces(model.ratio, CACHE_ENTRIES).__getitem__
    return Pieces(lambda w: sum(map(of_gram, grams(w, model.order))), CACHE_ENTRIES)


def design(plain: np.ndarray, local: np.ndarray) -> np.ndarray:
    """What the curve is linear in."""
    return np.stack([plain, np.log(local + SMALLEST), np.ones(len(plain))], axis=1)


def logistic(x: np.ndarray, y: np.ndarray, weights: np.ndarray | None = None, steps: int = 50) -> np.ndarray:
    """A weight for each column of x by Newton's method, with a little ridge so that separable classes stay finite."""
    weights = np.ones(len(x)) if weights is None else weights
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weights * (y - p)) - 1e-3 * w
        hessian = (x * (weights * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(len(w))
        w = w + np.linalg.solve(hessian, gradient)
    return w


@dataclass
class Model:
    kneser_ney: KneserNey
    weights: np.ndarray

    def scores(self, found: list[tuple[float, float]]) -> np.ndarray:
        plain, local = np.array(found, float).reshape(-1, 2).T
        return 1 / (1 + np.exp(-np.clip(design(plain, local) @ self.weights, -700, 700)))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE) -> Model:
    """labels: (key, label 0 or 1) of the rows to learn from. The sample's grams are counted by Spark."""
    spark = docs.sparkSession
    own = labels.select(labels[key].alias("key"), labels[label].cast("int").alias("label")).where("key is not null and label in (0, 1)")
    own = own.distinct()
    chosen = per_class(own, "label", "key", sample)
    sizes = lambda df: {r["label"]: r["count"] for r in df.groupBy("label").count().collect()}
    labelled, sampled = sizes(own), sizes(chosen)
    fold = F.pmod(F.xxhash64(F.col("key"), F.lit(1)), F.lit(CALIBRATION)) == 0
    matched = docs.select(docs[key].alias("key"), docs[text].alias("text")).join(F.broadcast(chosen), "key")
    learned, there, taken = bounded(matched, "label", sample)  # at most about SAMPLE rows a class, whatever a key repeats
    learned = learned.withColumn("calibrates", fold)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [Counter(), Counter()]
        for batch in batches:
            for x, c in zip(texts(batch), batch.column("label").to_pylist()):
                found[c].update(words_of(x))
        for c in (0, 1):
            total: Counter = Counter()
            for word, n in found[c].items():
                for gram in grams(word):
                    total[gram] += n
            yield pa.RecordBatch.from_arrays([pa.array([c] * len(total), pa.int32()), pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["label", "gram", "n"])

    counted = learned.where("not calibrates").mapInArrow(count, "label int, gram string, n long").groupBy("label", "gram").agg(F.sum("n").alias("n"))
    counts = (Counter(), Counter())
    for c, gram, n in counted.toPandas().itertuples(index=False):  # bounded by the sample
        counts[c][gram] = n
    model = KneserNey(counts)
    shared = spark.sparkContext.broadcast(counts)

    def value(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratios = _cache(KneserNey(shared.value))
        for batch in batches:
            plain, local = np.array([values(words_of(x), ratios) for x in texts(batch)], float).reshape(-1, 2).T
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(plain.copy()), pa.array(local.copy())], names=["label", "plain", "local"])

    rows = learned.where("calibrates").mapInArrow(value, "label int, plain double, local double").toPandas()
    x, y = design(rows["plain"].to_numpy(float), rows["local"].to_numpy(float)), rows["label"].to_numpy(float)
    # without both classes there is nothing to compare: every text is as likely as not
    each = np.array([labelled[int(c)] / sampled[int(c)] * there[int(c)] / taken[int(c)] for c in y])
    return Model(model, logistic(x, y, each / each.mean()) if len(set(y)) == 2 else np.zeros(3))


_models: dict[str, tuple[Model, Pieces]] = {}


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and score (0 to 1) of every row of docs."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((model.kneser_ney.counts, model.kneser_ney.order, model.weights))
    own = docs.select(docs[key].alias("key"), docs[text].alias("text"))
    kind = own.schema[0].dataType.simpleString()
    name = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _models:  # once in each worker
            counts, order, weights = shared.value
            own_model = Model(KneserNey(counts, order), weights)
            _models.clear()
            _models[name] = own_model, _cache(own_model.kneser_ney)
        own_model, ratios = _models[name]
        for batch in pieces(batches, 1):
            found = own_model.scores([values(words_of(x), ratios) for x in texts(batch)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], names=[key, "score"])

    return own.mapInArrow(run, f"`{key}` {kind}, score double")
