"""Katz back-off of any order in plain tables.

For each order k from 1 to n a table of n-grams (history of k - 1 tokens, word, count, p: the Good-Turing discounted
probability) and for each but the first a table of histories (history, alpha), where alpha makes the
distribution after the history sum to exactly one; both are stored in the shared folder, partitioned by order. A
token is evaluated recursively: by its n-gram if that was seen, else by alpha of its history (one if the history was never seen)
times what the order below says, down to the unknown word. ``katz`` computes the same for pairs with less traffic.

Tokens are words as in ``katz``; before a text stand n - 1 start tokens, after it one end. Null and empty
texts are the end alone. Texts are evaluated by key and text: repeated rows each get the same result. Without any
row to learn from every token has probability one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch
from .katz import K, LARGE, discounted

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: No word holds white space.
START, END = "\t", "\n"


def tokens(text: Column, n: int) -> Column:
    """n - 1 starts, the words, the end."""
    words = F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), "[ \\t\\n\\x0B\\f\\r]+"), lambda w: w != "")
    return F.concat(F.array_repeat(F.lit(START), n - 1), words, F.array(F.lit(END)))


def grams(docs: DataFrame, n: int, text: str, *by: str) -> DataFrame:
    """A row for each token: by, word, and its history of n - 1 tokens, joined by spaces."""
    own = docs.select(*by, tokens(F.col(text), n).alias("x"))
    places = F.sequence(F.lit(n), F.size("x"))
    whole = F.transform(places, lambda i: F.struct(F.array_join(F.slice("x", i - (n - 1), F.lit(n - 1)), " ").alias("history"), F.element_at("x", i).alias("word")))
    return own.select(*by, F.explode(whole).alias("g")).select(*by, "g.*")


def shorter(history: Column) -> Column:
    """The history without its first token."""
    return F.when(F.contains(history, F.lit(" ")), F.regexp_replace(history, "^[^ ]* ", "")).otherwise("")


@dataclass
class Model:
    n: int
    path: str
    unknown: float

    def ngrams(self, spark: SparkSession, order: int) -> DataFrame:
        return spark.read.parquet(f"{self.path}/ngrams/order={order}")

    def alphas(self, spark: SparkSession, order: int) -> DataFrame:
        return spark.read.parquet(f"{self.path}/alphas/order={order}")


def fit(docs: DataFrame, n: int = 3, text: str = "text") -> Model:
    """The model of all rows of docs."""
    spark = docs.sparkSession
    model = Model(n, scratch(spark, "backoff"), 1.0)
    for order in range(1, n + 1):
        counted = grams(docs, order, text).groupBy("history", "word").agg(F.count(F.lit(1)).alias("count"))
        counted.write.parquet(f"{model.path}/counts/order={order}")
        counted = spark.read.parquet(f"{model.path}/counts/order={order}")
        # counts of counts: K + 1 numbers
        of = {r["count"]: r["n"] for r in counted.where(F.col("count") <= K + 1).groupBy("count").agg(F.count(F.lit(1)).alias("n")).collect()}
        stars = discounted([0.0, *(float(of.get(r, 0)) for r in range(1, K + 2))])
        star = F.when(F.col("count") > K, F.col("count") - LARGE).otherwise(F.element_at(F.array(*map(F.lit, stars[1:])), F.col("count").cast("int")))
        totals = counted.groupBy("history").agg(F.sum("count").alias("total"))
        counted.join(totals, "history").select("history", "word", "count", (star / F.col("total")).alias("p")).write.parquet(f"{model.path}/ngrams/order={order}")
        found = model.ngrams(spark, order)
        if order == 1:
            left = found.agg(F.sum("p")).first()[0]
            model.unknown = 1.0 - left if left is not None else 1.0
            continue
        below = model.ngrams(spark, order - 1).select(F.col("history").alias("_h"), "word", F.col("p").alias("lower"))
        followers = found.withColumn("_h", shorter(F.col("history"))).join(below, ["_h", "word"])
        sums = followers.groupBy("history").agg(F.sum("p").alias("kept"), F.sum("lower").alias("lower"))
        rest = F.greatest(1 - F.col("lower"), F.lit(model.unknown)) if order == 2 else 1 - F.col("lower")
        sums.select("history", ((1 - F.col("kept")) / rest).alias("alpha")).write.parquet(f"{model.path}/alphas/order={order}")
    return model


def evaluate(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of docs: key, n_tokens, score (log10 probability of the text)."""
    spark = docs.sparkSession
    own = docs.select(docs[key].alias("key"), F.xxhash64(docs[text]).alias("t"), docs[text].alias("text"))
    rows = grams(own.dropDuplicates(["key", "t"]), model.n, "text", "key", "t").groupBy("key", "t", "history", "word").agg(F.count(F.lit(1)).alias("times"))
    rows = rows.withColumn(f"h{model.n}", F.col("history"))
    for order in range(model.n - 1, 0, -1):
        rows = rows.withColumn(f"h{order}", shorter(F.col(f"h{order + 1}")))
    p = F.lit(model.unknown)
    for order in range(1, model.n + 1):
        seen = model.ngrams(spark, order).select(F.col("history").alias(f"h{order}"), "word", F.col("p").alias(f"p{order}"))
        rows = rows.join(seen, [f"h{order}", "word"], "left")
        if order == 1:
            p = F.coalesce("p1", p)
            continue
        rows = rows.join(model.alphas(spark, order).select(F.col("history").alias(f"h{order}"), F.col("alpha").alias(f"a{order}")), f"h{order}", "left")
        p = F.coalesce(F.col(f"p{order}"), F.coalesce(F.col(f"a{order}"), F.lit(1.0)) * p)
    sums = rows.groupBy("key", "t").agg(F.sum("times").alias("n_tokens"), F.sum(F.col("times") * F.log10(p)).alias("score"))
    of = own.select("key", "t")
    return of.join(sums, of["key"].eqNullSafe(sums["key"]) & (of["t"] == sums["t"])).select(of["key"].alias(key), "n_tokens", "score")
