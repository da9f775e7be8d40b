"""Quality rules as a bitmask ledger.

``ledger`` measures every text once and evaluates every rule once: it returns the measurements and one long
``fail_bits`` in which bit b says that the rule with that bit failed. A policy is a versioned set of rules, so
applying one, changing one or asking what a rule contributes never reads the texts again:
``apply_policy`` tests the bits against the policy's mask and ``ablation`` counts equal bit patterns first
(at most 2^rules rows, whatever the corpus holds) and works on those.

Words are maximal runs of anything but the six ASCII white-space characters. Null texts have no words, like
empty ones. Rows are independent: repeated rows each get their own result, null ids stay null, other columns
are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import numbered, pieces, texts

SYMBOLS = b"#*$%&|<>"
WINDOW = 5
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rule:
    bit: int
    name: str
    fails: Column | str  # an SQL condition over the measurements

    @property
    def mask(self) -> int:
        return 1 << self.bit


@dataclass(frozen=True)
class Policy:
    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(r.mask for r in RULES if r.name in self.rules)


#: A bit is never given to another rule, so that old ledgers keep their meaning.
RULES = (
    Rule(0, "too_few_words", "n_words < 10"),
    Rule(1, "repeated_words", "100 * n_repeat_words > 20 * n_words"),
    Rule(2, "symbols", "10 * n_symbols > n_words"),
    Rule(3, "repeated_lines", "2 * n_dup_lines > n_lines"),
    Rule(4, "short_words", "word_chars < 2 * n_words"),
    Rule(5, "long_words", "word_chars > 20 * n_words"),
)
BASE = Policy("base", ("too_few_words", "repeated_words"))
V1 = Policy("v1", (*BASE.rules, "symbols", "repeated_lines"))
V2 = Policy("v2", (*V1.rules, "short_words", "long_words"))
POLICIES = (BASE, V1, V2)


def repeated_words(words: list[bytes]) -> int:
    """How many words lie in windows of five words that the text holds twice or more.

    Windows are compared by a 64-bit hash; those that share one are then compared word by word.
    """
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    mixed = np.zeros(n, np.uint64)
    for k in range(WINDOW):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n]
    order = np.sort(mixed)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    at = np.flatnonzero(np.isin(mixed, twice)).tolist()
    windows = [tuple(words[i : i + WINDOW]) for i in at]
    counts = Counter(windows)
    starts = np.array([i for i, w in zip(at, windows) if counts[w] > 1], np.int64)
    ends = np.zeros(len(words) + 1, np.int64)
    np.add.at(ends, starts, 1)
    np.add.at(ends, starts + WINDOW, -1)
    return int(np.count_nonzero(np.cumsum(ends)))


def measure(text: str) -> tuple[int, ...]:
    raw = text.encode()
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    spaces = len(raw) - sum(map(len, words))
    return (
        len(words),
        len(text) - spaces,
        len(raw) - len(raw.translate(None, SYMBOLS)),
        len(lines),
        len(lines) - len(set(lines)),
        repeated_words(words),
    )


def _measured(own: DataFrame, at: int, out: list[int]) -> DataFrame:
    """own: columns c0, c1, ... with the text at one place. Returns those named in out, the measurements and fail_bits."""
    schema = T.StructType([*(own.schema[i] for i in out), *(T.StructField(m, T.LongType()) for m in MEASURES)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, at):
            found = np.array([measure(x) for x in texts(batch, at)], np.int64).reshape(-1, len(MEASURES))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in out), *map(pa.array, found.T.copy())], names=schema.names)

    bits = F.lit(0).cast("long")
    for rule in RULES:
        bits = bits.bitwiseOR(F.when(F.expr(rule.fails), F.lit(rule.mask)).otherwise(0).cast("long"))
    return own.mapInArrow(run, schema).withColumn("fail_bits", bits)


def ledger(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, the measurements, and fail_bits, one row for each row of docs."""
    own, _ = numbered(docs.select(docs[key], docs[text]))
    return _measured(own, 1, [0]).withColumnRenamed("c0", key)


def keep(docs: DataFrame, policy: Policy, text: str = "text") -> DataFrame:
    """The rows of docs that no rule of the policy rejects."""
    own, (at,) = numbered(docs, text)
    return _measured(own, at, list(range(len(own.columns)))).where(~failed(policy)).select(*own.columns).toDF(*docs.columns)


def failed(policy: Policy, bits: str = "fail_bits") -> Column:
    return F.col(bits).bitwiseAND(F.lit(policy.mask)) != 0


def apply_policy(found: DataFrame, policy: Policy, name: str = "kept") -> DataFrame:
    """The ledger with a boolean column: no rule of the policy failed."""
    return found.withColumn(name, ~failed(policy))


def ablation(found: DataFrame, policies: tuple[Policy, ...] = POLICIES) -> DataFrame:
    """For each rule of each policy: documents, those it fails, and those that only it fails (kept without it).

    An empty ledger gives no rows.
    """
    counts = found.groupBy("fail_bits").agg(F.count(F.lit(1)).alias("n"))
    rules = found.sparkSession.createDataFrame(
        [(p.version, p.mask, r.name, r.mask) for p in policies for r in RULES if r.name in p.rules],
        "version string, policy_mask long, rule string, rule_mask long",
    )
    own = F.col("fail_bits").bitwiseAND(F.col("policy_mask"))
    total = lambda when, name: F.sum(F.when(when, F.col("n")).otherwise(0)).alias(name)
    return (
        counts.join(F.broadcast(rules))  # a handful of rules against at most 2^rules bit patterns
        .groupBy("version", "rule")
        .agg(
            F.sum("n").alias("n_docs"),
            total(own.bitwiseAND(F.col("rule_mask")) != 0, "n_failed"),
            total(own == F.col("rule_mask"), "n_failed_only_here"),
            total(own != 0, "n_rejected"),
        )
    )
