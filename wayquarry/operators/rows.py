"""Choosing rows: winners, versions, tiers, first and last wins, ordinals, paging and filters."""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import stored


#: Parts of a key whose first rows are found by themselves, so that a key of many rows isn't one task.
SPLIT = 16


def _heats(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """df with _heat (a part of the key's rows) and whether a row is the first of its heat."""
    split = df.withColumn("_heat", F.pmod(F.monotonically_increasing_id(), F.lit(SPLIT)) + 1)
    return split.withColumn("_first", F.row_number().over(Window.partitionBy(*keys, "_heat").orderBy(*order)) == 1)


def winner(df: DataFrame, keys: Sequence[str], order: Sequence[Column], flag: str = "keeps") -> DataFrame:
    """df with a boolean that holds for one row of each key: the first by order. Null keys are a key of their own.

    The first rows of a key's heats meet in a final; the others stay where they are.
    """
    final = _heats(df, keys, order).withColumn("_heat", F.when(F.col("_first"), F.lit(0).cast("long")).otherwise(F.col("_heat")))
    at = F.row_number().over(Window.partitionBy(*keys, "_heat").orderBy(*order))
    return final.withColumn(flag, F.col("_first") & (at == 1)).drop("_heat", "_first")


def winners(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    final = _heats(df, keys, order).where("_first").drop("_heat", "_first")
    return final.withColumn("_at", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_at = 1").drop("_at")


def reduced(df: DataFrame, keys: Sequence[str], best: Column, last: bool = False) -> DataFrame:
    """One whole row for each key: that of the least (or greatest) ``best``.

    An aggregate, so it is combined before the shuffle, which a window over hot keys isn't.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    pick = F.max_by(row, best) if last else F.min_by(row, best)
    return df.groupBy(*keys).agg(pick.alias("_row")).select("_row.*")


def filled_first(df: DataFrame, keys: Sequence[str], order: Column, columns: Sequence[str]) -> DataFrame:
    """One row for each key: of each column the first value by order that isn't null."""
    first = [F.min_by(F.col(c), F.when(F.col(c).isNotNull(), order)).alias(c) for c in columns]
    return df.groupBy(*keys).agg(*first)


def relaxed(candidates: DataFrame, request: Sequence[str], tiers: Sequence[Column], tier: str = "tier") -> DataFrame:
    """Candidates of the first tier, by request, that any candidate meets; tiers get wider from first to last."""
    own = reduce(lambda w, x: w.when(x[1], F.lit(x[0])), list(enumerate(tiers, 1))[1:], F.when(tiers[0], F.lit(1)))
    tagged = candidates.withColumn(tier, own).where(F.col(tier).isNotNull())
    least = tagged.groupBy(*request).agg(F.min(tier).alias(tier))
    return tagged.join(least, [*request, tier])


def ordinals(df: DataFrame, key: str, order: Sequence[Column], name: str = "unique_key") -> DataFrame:
    """A name that is unique: the key, with _1, _2, ... for those that repeat."""
    several = df.groupBy(F.col(key).alias("_key")).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    found = places(df, [key], order, "_place").join(several, F.col(key).eqNullSafe(F.col("_key")), "left")
    return found.withColumn(name, F.when(F.col("_n") > 1, F.concat(F.col(key), F.lit("_"), F.col("_place").cast("string"))).otherwise(F.col(key))).drop("_key", "_n", "_place")


def places(df: DataFrame, by: Sequence[str], order: Sequence[Column | str], out: str = "place", parts: int | None = None) -> DataFrame:
    """Each row's place (from 1) among those with the same values of ``by``, in order of some columns, without a task for a whole group.

    Rows are dealt by ranges and stored, so that both uses see the same ranges; they are numbered within their range, and what the
    ranges before it hold, a row for each range and value, is added. Equal rows stand in any order.
    """
    dealt = (df.repartitionByRange(parts, *by, *order) if parts else df.repartitionByRange(*by, *order)) if by or order else df
    found = stored(dealt.withColumn("_range", F.spark_partition_id()), "ranges")
    own = Window.partitionBy("_range", *by).orderBy(*order)
    counts = found.groupBy("_range", *by).agg(F.count(F.lit(1)).alias("_n"))
    # a row for each range: as many as the table has partitions
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1) if by else Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col("_range").alias("_of"), *[F.col(b).alias(f"_by_{b}") for b in by], F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    same = reduce(lambda c, b: c & F.col(b).eqNullSafe(F.col(f"_by_{b}")), by, F.col("_range") == F.col("_of"))
    return found.withColumn(out, F.row_number().over(own)).join(offsets, same).withColumn(out, F.col(out) + F.col("_before")).select(*df.columns, out)


def unique_names(df: DataFrame, name: str, order: Sequence[Column | str], out: str = "unique_name", sep: str = "-") -> DataFrame:
    """Names that differ without regard to case, given in order: a name that is taken gets sep and the first number from 2 on that makes it free.

    A number meets another name only where that name is the same but for numbers at its end. Names without such relatives are numbered by
    their places; families of several names are gone through in order, with one number to remember for each name.
    """
    lower = F.lower(F.coalesce(F.col(name), F.lit("")))
    own = df.withColumns({"_base": lower, "_root": F.regexp_replace(lower, f"({_quoted(sep)}[0-9]+)+$", "")})
    kinds = own.groupBy("_root").agg((F.min("_base") != F.max("_base")).alias("_several"))
    marked = stored(own.join(kinds, "_root"), "names")
    numbered = places(marked.where("not _several"), ["_base"], order, "_nth")
    alone = numbered.withColumn(out, F.when(F.col("_nth") == 1, F.col(name)).otherwise(F.concat(F.coalesce(name, F.lit("")), F.lit(sep), F.col("_nth").cast("string"))))
    schema, kept = T.StructType([*df.schema.fields, T.StructField(out, T.StringType())]), df.columns
    families = marked.where("_several").repartition("_root").sortWithinPartitions("_root", *order)

    def go_through(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root, taken = None, Taken(sep)
        for batch in batches:
            found = []
            for of, base, given in zip(*(batch.column(c).to_pylist() for c in ("_root", "_base", name))):
                if of != root:
                    root, taken = of, Taken(sep)
                number = taken.take(base)
                found.append(given if number == 1 else f"{given or ''}{sep}{number}")
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(found, pa.string())], names=schema.names)

    return alone.select(*schema.names).union(families.mapInArrow(go_through, schema))


class Taken:
    """The names that a family has given: of each base name the next number; all numbers below it are taken."""

    def __init__(self, sep: str) -> None:
        self.sep, self.next = sep, {}

    def has(self, name: str) -> bool:
        if name in self.next:
            return True
        digits = len(name) - len(name.rstrip("0123456789"))
        for n in range(1, min(digits, 18) + 1):  # without sep a name may be a base and its number in several ways
            base, number = name[:-n].removesuffix(self.sep), int(name[-n:])
            if name == f"{base}{self.sep}{number}" and 2 <= number < self.next.get(base, 0):
                return True
        return False

    def take(self, base: str) -> int:
        """The number that base gets, 1 for none."""
        if not self.has(base):
            self.next[base] = 2
            return 1
        number = self.next.get(base, 2)
        while self.has(f"{base}{self.sep}{number}"):
            number += 1
        self.next[base] = number + 1
        return number


def _quoted(text: str) -> str:
    return re.sub(r"[^\w\s]", lambda m: "\\" + m[0], text)


def page(df: DataFrame, order: Sequence[Column], number: int = 1, size: int = 25, most: int = 100) -> DataFrame:
    """A page of rows in order, 25 by default and 100 at most, each with the total number of rows."""
    size = max(1, min(size, most))
    total = df.agg(F.count(F.lit(1)).alias("total"))
    rows = df.orderBy(*order).offset((max(1, number) - 1) * size).limit(size)
    return rows.join(F.broadcast(total))  # one row


#: What a filter's operators mean.
OPERATORS = {
    "eq": lambda c, v: c == F.lit(v),
    "eqi": lambda c, v: F.lower(c) == F.lit(str(v).lower()),
    "ne": lambda c, v: c != F.lit(v),
    "lt": lambda c, v: c < F.lit(v),
    "lte": lambda c, v: c <= F.lit(v),
    "gt": lambda c, v: c > F.lit(v),
    "gte": lambda c, v: c >= F.lit(v),
    "in": lambda c, v: c.isin(list(v)),
    "contains": lambda c, v: c.contains(v),
    "containsi": lambda c, v: F.lower(c).contains(str(v).lower()),
    "null": lambda c, v: c.isNull() if v else c.isNotNull(),
    "notNull": lambda c, v: c.isNotNull() if v else c.isNull(),
}


def condition(where: Mapping[str, object]) -> Column:
    """A column from nested filters, as {"price": {"gte": 5}, "or": [{...}, {...}]}; all parts must hold."""
    parts = []
    for name, value in where.items():
        if name in ("or", "and"):
            joint = (lambda a, b: a | b) if name == "or" else (lambda a, b: a & b)
            parts.append(reduce(joint, map(condition, value)))
        elif name == "not":
            parts.append(~condition(value))
        elif isinstance(value, Mapping):
            parts += [OPERATORS[op](F.col(name), v) for op, v in value.items()]
        else:
            parts.append(F.col(name).isNull() if value is None else F.col(name) == F.lit(value))
    return reduce(lambda a, b: a & b, parts) if parts else F.lit(True)


def scan(df: DataFrame, where: Mapping[str, object] | None = None, select: Sequence[str] | None = None, order: Sequence[Column] = (), offset: int = 0, limit: int | None = None) -> DataFrame:
    """Filtered, projected rows, in order where one is asked for; the optimizer takes filters and columns to the files."""
    found = df.where(condition(where)) if where else df
    found = found.orderBy(*order) if order else found
    found = found.offset(offset) if offset else found
    found = found.limit(limit) if limit is not None else found
    return found.select(*select) if select else found


def positional(df: DataFrame, columns: Sequence[str], out: str = "row") -> DataFrame:
    """Compact rows: the columns' values as strings in one array, in order."""
    return df.select(F.array(*[F.col(c).cast("string") for c in columns]).alias(out))


def search(df: DataFrame, columns: Sequence[str], words: str) -> DataFrame:
    """Rows whose columns together hold the words, in any case; all rows for no words."""
    text = F.lower(F.concat_ws(" ", *[F.col(c).cast("string") for c in columns]))
    return df.where(text.contains(words.strip().lower())) if words.strip() else df


def published(df: DataFrame, versions: DataFrame, key: str = "document_id", at: str = "published_at") -> DataFrame:
    """Rows whose document has a published version."""
    return df.join(versions.where(F.col(at).isNotNull()).select(key), key, "left_semi")


def preferred_version(df: DataFrame, key: str, locale: str, wanted: str, default: str, order: Sequence[Column]) -> DataFrame:
    """One version of each document: the wanted locale, else the default one, else the first by order."""
    rank = F.when(F.col(locale) == wanted, 0).when(F.col(locale) == default, 1).otherwise(2)
    return winners(df, [key], [rank, *order])


def running_quota(df: DataFrame, eligible: Column, order: Sequence[Column], room: int, by: Sequence[str] = ()) -> DataFrame:
    """accepted: eligible rows, in order, while there is room (for each ``by``). As with ``winner``, heats come before a final of few rows."""
    split = df.withColumns({"_yes": F.coalesce(eligible, F.lit(False)), "_heat": F.pmod(F.monotonically_increasing_id(), F.lit(SPLIT)) + 1})
    place = F.row_number().over(Window.partitionBy(*by, "_yes", "_heat").orderBy(*order))
    heats = split.withColumn("_first", F.col("_yes") & (place <= room)).withColumn("_heat", F.when(F.col("_first"), F.lit(0).cast("long")).otherwise(F.col("_heat")))
    return heats.withColumn("accepted", F.col("_first") & (place <= room)).drop("_yes", "_heat", "_first")


def without_zeros(df: DataFrame, array: str, field: str) -> DataFrame:
    """Zeros in a field of an array of structs become null; n_fixed counts them."""
    zero = lambda x: F.coalesce(x[field] == 0, F.lit(False))
    fixed = F.transform(F.col(array), lambda x: x.withField(field, F.when(~zero(x), x[field])))
    return df.withColumns({"n_fixed": F.size(F.filter(F.col(array), zero)), array: fixed})


def attached(df: DataFrame, parts: DataFrame, key: str, columns: Sequence[str], order: Sequence[str], out: str = "parts") -> DataFrame:
    """df with the parts of each key as an array of structs, in order; an empty one where there are none."""
    own = parts.select(key, F.struct(*order, *[c for c in columns if c not in order]).alias("_part"))
    grouped = own.groupBy(key).agg(F.sort_array(F.collect_list("_part")).alias("_parts"))
    wanted = F.transform("_parts", lambda p: F.struct(*[p[c].alias(c) for c in columns]))
    return df.join(grouped.select(key, wanted.alias(out)), key, "left").withColumn(out, F.coalesce(out, F.array()))


def histogram(df: DataFrame, name: str, most: int = 25) -> DataFrame:
    """The most frequent values, ties by value."""
    return df.groupBy(name).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), name).limit(most)


def profile(df: DataFrame, samples: int = 2, chars: int = 400) -> DataFrame:
    """A row for each column: its type, and sample values cut to a length."""
    own = df.limit(samples).select(F.posexplode(F.array(*[
        F.struct(F.lit(c).alias("name"), F.lit(t).alias("type"), F.substring(F.col(f"`{c}`").cast("string"), 1, chars).alias("sample")) for c, t in df.dtypes
    ])).alias("position", "x"))
    return own.groupBy("position", "x.name", "x.type").agg(F.collect_list("x.sample").alias("samples"))


def overruled(df: DataFrame, keys: Sequence[str], order: Sequence[Column], size: str) -> DataFrame:
    """Per key with several rows: how many, the size of the winner, and whether a row that goes is larger (review)."""
    marked = winner(df, keys, order)
    kept, gone = F.max(F.when(F.col("keeps"), F.col(size))), F.max(F.when(~F.col("keeps"), F.col(size)))
    return marked.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), kept.alias("kept_size"), F.coalesce(gone > kept, F.lit(False)).alias("review")).where("n_rows > 1")


def inconsistent(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Keys whose rows don't agree in each of the columns, with the number of values there are."""
    found = df.groupBy(key).agg(*[F.count_distinct(c).alias(c) for c in columns])
    return found.where(reduce(lambda a, b: a | b, [F.col(c) > 1 for c in columns]))


def not_yet_stored(files: DataFrame, stored: DataFrame) -> DataFrame:
    """Files (name, folder, kb) that are to be uploaded: no stored one has the name, folder and size, to a thousandth."""
    of = lambda df: df.withColumn("_kb", F.round("kb", 3))
    once = of(files).dropDuplicates(["name", "folder", "_kb"])
    return once.join(of(stored).select("name", "folder", "_kb"), ["name", "folder", "_kb"], "left_anti").select(*files.columns)
