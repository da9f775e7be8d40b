"""Language identification in two steps: the family first, then the language within it.

A text's letters (anything but ASCII signs and digits, lower-cased, words parted by single spaces) give counts
of hashed grams of one to three bytes, scaled to length one. One-versus-rest linear support vector machines
choose the family; within it one-versus-one machines vote between its languages, the sum of their margins
deciding ties. Machines are trained by dual coordinate descent on a bounded sample (SAMPLE documents in all,
shared by the languages, by a hash of doc_id, and of doc_id and text where doc_ids repeat), so they are small and are sent to every task; every document
is judged over its whole text.

Texts that are null or hold no letter get ``und`` and score 0. Rows with a null language are not learned from;
with one language only, every text with letters gets it. Without any training rows all get ``und``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, texts
from .sampling import bounded, per_class

BITS = 13
DIMENSIONS = 1 << BITS
SAMPLE = 2000
UNDETERMINED = "und"

# Families of languages by ISO 639-1 code. A language that isn't listed is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb yi",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk",
    "baltic": "lt lv",
    "uralic": "fi et hu",
    "celtic": "ga gd cy br",
    "indic": "hi ur bn pa gu mr ne si",
    "iranian": "fa ku ps tg",
    "turkic": "tr az kk uz ky tk",
    "semitic": "ar he mt am",
    "malayic": "id ms jv su",
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}

# ASCII signs and digits become spaces
_LETTERS = bytes(b if chr(b).isalpha() or b >= 0x80 else 0x20 for b in range(256))


def features(text: str) -> tuple[np.ndarray, np.ndarray] | None:
    """The scaled gram counts as (dimensions, values), or None for a text without letters."""
    letters = b" ".join(text.lower().encode().translate(_LETTERS).split())
    if not letters or not letters.isascii() and not any(map(str.isalpha, text)):
        return None
    a = np.frombuffer(b" " + letters + b" ", np.uint8).astype(np.uint32)
    two = a[:-1] << 8 | a[1:]
    three = two[:-1] << 8 | a[2:]
    counts = np.zeros(DIMENSIONS, np.int64)
    for k, codes in enumerate((a, two, three)):
        mixed = (codes + np.uint32(k << 24)) * np.uint32(2654435761) >> np.uint32(32 - BITS)
        counts += np.bincount(mixed, minlength=DIMENSIONS)
    at = np.flatnonzero(counts)
    values = counts[at].astype(np.float64)
    return at, values / np.sqrt(values @ values)


Rows = list[tuple[np.ndarray, np.ndarray]]


def machine(x: Rows, y: np.ndarray, cost: float = 10.0, rounds: int = 30, dimensions: int = DIMENSIONS) -> np.ndarray:
    """A linear support vector machine (squared hinge loss) by dual coordinate descent over sparse rows; y is 1 or -1. The last weight is the offset."""
    w, alpha = np.zeros(dimensions + 1), np.zeros(len(x))
    diagonal = 1 / (2 * cost)
    norms = [v @ v + 1 + diagonal for _, v in x]
    order = np.random.default_rng(0)
    for _ in range(rounds):
        change = 0.0
        for i in order.permutation(len(x)):
            at, values = x[i]
            gradient = y[i] * (values @ w[at] + w[-1]) - 1 + diagonal * alpha[i]
            new = max(alpha[i] - gradient / norms[i], 0.0)
            if step := new - alpha[i]:
                w[at] += step * y[i] * values
                w[-1] += step * y[i]
                alpha[i] = new
                change = max(change, abs(step))
        if change < 1e-3:
            break
    return w


@dataclass
class Model:
    families: list[str]
    family_weights: np.ndarray  # a column for each family
    languages: dict[str, list[str]]
    pairs: dict[str, tuple[list[tuple[int, int]], np.ndarray]]  # by family: languages' indices, a column for each pair

    def predict(self, text: str) -> tuple[str, float]:
        x = features(text) if self.families else None
        if x is None:
            return UNDETERMINED, 0.0
        at, values = x
        margin = lambda weights: values @ weights[at] + weights[-1]
        sure = 1.0
        family = self.families[0]
        if len(self.families) > 1:
            margins = margin(self.family_weights)
            best = int(np.argmax(margins))
            family, sure = self.families[best], _squash(margins[best])
        names = self.languages[family]
        if len(names) == 1:
            return names[0], sure
        pairs, weights = self.pairs[family]
        margins = margin(weights)
        votes, sums = np.zeros(len(names)), np.zeros(len(names))
        for (a, b), m in zip(pairs, margins):
            votes[a if m >= 0 else b] += 1
            sums[a] += m
            sums[b] -= m
        best = max(range(len(names)), key=lambda k: (votes[k], sums[k]))
        return names[best], sure * _squash(sums[best] / (len(names) - 1))


def _squash(margin: float) -> float:
    return float(1 / (1 + np.exp(-2 * np.clip(margin, -20, 20))))


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> Model:
    """docs: the rows to learn from."""
    keys = docs.select(docs[key].alias("key"), docs[lang].cast("string").alias("lang")).where("lang is not null")
    languages = max(1, keys.select("lang").distinct().count())
    most = max(1, sample // languages)
    chosen = per_class(keys, "lang", "key", most).select("key").distinct()
    own = docs.select(docs[key].alias("key"), docs[text].alias("text"), docs[lang].cast("string").alias("lang")).where("lang is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            found = [(c, x[0].astype(np.uint16).tobytes(), x[1].astype(np.float32).tobytes()) for c, t in zip(batch.column("lang").to_pylist(), texts(batch)) if (x := features(t)) is not None]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], kind) for k, kind in enumerate((pa.string(), pa.binary(), pa.binary()))], names=["lang", "at", "x"])

    # about SAMPLE rows of at most DIMENSIONS values each, so their size is bounded, and so is what comes back
    learned, _, _ = bounded(own.join(F.broadcast(chosen), "key", "left_semi"), "lang", most)
    rows = learned.mapInArrow(run, "lang string, at binary, x binary").toPandas()
    rows = rows.sort_values(["lang", "at", "x"])  # machines depend on the order of rows, which depends on how they were dealt
    if rows.empty:
        return Model([], np.zeros((DIMENSIONS + 1, 0)), {}, {})
    x = [(np.frombuffer(at, np.uint16), np.frombuffer(b, np.float32)) for at, b in zip(rows["at"], rows["x"])]
    y = rows["lang"].to_numpy()
    family = np.array([FAMILY_OF.get(c, c) for c in y])
    families = sorted(set(family))
    weights = [machine(x, np.where(family == f, 1.0, -1.0)) for f in families] if len(families) > 1 else []
    by_family = {f: sorted(set(y[family == f])) for f in families}
    pairs = {}
    for f, names in by_family.items():
        some, own_weights = [], []
        for a in range(len(names)):
            for b in range(a + 1, len(names)):
                rows_of = np.flatnonzero((y == names[a]) | (y == names[b]))
                some.append((a, b))
                own_weights.append(machine([x[i] for i in rows_of], np.where(y[rows_of] == names[a], 1.0, -1.0)))
        if some:
            pairs[f] = some, np.stack(own_weights, axis=1)
    return Model(families, np.stack(weights, axis=1) if weights else np.zeros((DIMENSIONS + 1, 0)), by_family, pairs)


def predict(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, lang_pred and score (0 to 1) of every row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    own = docs.select(docs[key].alias("key"), docs[text].alias("text"))
    kind = own.schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1):
            found = [shared.value.predict(x) for x in texts(batch)]
            columns = [batch.column(0), pa.array([a for a, _ in found], pa.string()), pa.array([b for _, b in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=[key, "lang_pred", "score"])

    return own.mapInArrow(run, f"`{key}` {kind}, lang_pred string, score double")
