"""Synchronising a stored table with a source: differences, stale rows, guarded removal, upserts.

Nothing is changed in place: operators return frames of actions, and ``applied`` gives the table after them.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .rows import places

INSERT, UPDATE, KEEP, STALE = "insert", "update", "keep", "stale"


def differs(name: str, tolerance: float | None = None) -> Column:
    """Whether the source's and the stored value differ; numbers by more than a tolerance."""
    a, b = F.col(f"s.`{name}`"), F.col(f"t.`{name}`")
    if tolerance is None:
        return ~a.eqNullSafe(b)
    return (a.isNull() != b.isNull()) | F.coalesce(F.abs(a - b) > tolerance, F.lit(False))


def diff(source: DataFrame, stored: DataFrame, keys: Sequence[str], compare: Mapping[str, float | None]) -> DataFrame:
    """A row for each key of either side: keys, action, changed (names of columns that differ), source and stored rows.

    Keys must be unique on each side (rows.reduced makes them so). Null keys match each other.
    compare: columns to compare, with the tolerance of numbers.
    """
    s = source.select(F.struct("*").alias("source"), *[F.col(k).alias(f"s_{k}") for k in keys], F.lit(True).alias("s_there"))
    t = stored.select(F.struct("*").alias("stored"), *[F.col(k).alias(f"t_{k}") for k in keys], F.lit(True).alias("t_there"))
    same = reduce(lambda a, b: a & b, [s[f"s_{k}"].eqNullSafe(t[f"t_{k}"]) for k in keys])
    both = s.join(t, same, "full_outer").withColumns({"s": F.col("source"), "t": F.col("stored")})
    changed = F.array_compact(F.array(*[F.when(differs(c, tol), F.lit(c)) for c, tol in compare.items()]))
    changed = F.when(F.col("s_there") & F.col("t_there"), changed).otherwise(F.array().cast("array<string>"))
    action = F.when(F.col("t_there").isNull(), INSERT).when(F.col("s_there").isNull(), STALE).when(F.size("changed") > 0, UPDATE).otherwise(KEEP)
    keyed = [F.when(F.col("s_there"), F.col(f"s_{k}")).otherwise(F.col(f"t_{k}")).alias(k) for k in keys]
    return both.withColumn("changed", changed).select(*keyed, action.alias("action"), "changed", "source", "stored")


def counters(actions: DataFrame) -> DataFrame:
    return actions.groupBy("action").agg(F.count(F.lit(1)).alias("n"))


def guarded(actions: DataFrame, least: int, ratio: float = 0.0, whole_run: bool = True, origin: Column | None = None) -> DataFrame:
    """Actions in which stale rows are removed only where the source can be trusted; else they stay.

    It can be if the run covered everything, the source has at least ``least`` rows, and at least ``ratio``
    of those that would be kept or removed. origin: a condition on stored rows that may be removed at all.
    """
    stale = (F.col("action") == STALE) & (F.coalesce(origin, F.lit(False)) if origin is not None else F.lit(True))
    counts = actions.agg(
        F.count_if(F.col("action") != STALE).alias("n_source"), F.count_if((F.col("action") == KEEP) | (F.col("action") == UPDATE) | stale).alias("n_retained")
    )
    trusted = F.lit(whole_run) & (F.col("n_source") >= least) & (F.col("n_source") >= ratio * F.col("n_retained"))
    judged = actions.join(F.broadcast(counts.select(trusted.alias("trusted"))))  # one row
    return judged.withColumn("action", F.when(stale & F.coalesce("trusted", F.lit(False)), "delete").when(F.col("action") == STALE, KEEP).otherwise(F.col("action"))).drop("trusted")


def applied(actions: DataFrame) -> DataFrame:
    """The table after insert, update and delete; stale rows that weren't judged stay."""
    new = F.col("action").isin(INSERT, UPDATE)
    return actions.where("action <> 'delete'").select(F.when(new, F.col("source")).otherwise(F.col("stored")).alias("row")).select("row.*")


def after(actions: DataFrame, stored: DataFrame, id_name: str | None = "id") -> DataFrame:
    """action and the table's rows after the actions: new values over the stored row, whose other columns stay.

    id_name: a column that the stored table numbers its rows by; inserted rows are numbered on from its greatest, in order of their source rows.
    """
    kinds = {f.name: f.dataType for f in actions.schema["stored"].dataType.fields} | {f.name: f.dataType for f in actions.schema["source"].dataType.fields}
    own = {f.name for f in actions.schema["source"].dataType.fields}
    old = {f.name for f in actions.schema["stored"].dataType.fields}
    new = F.col("action").isin(INSERT, UPDATE)

    def value(name: str) -> Column:
        if name not in own:
            return F.col(f"stored.`{name}`")
        theirs = F.col(f"stored.`{name}`").cast(kinds[name]) if name in old else F.lit(None).cast(kinds[name])
        return F.when(new, F.col(f"source.`{name}`")).otherwise(theirs)

    rows = actions.select("action", *[value(n).alias(n) for n in kinds])
    if id_name is None or id_name in own:
        return rows
    last = stored.agg(F.max(id_name).alias("last")).first()["last"] or 0 if id_name in old else 0
    names = [n for n in kinds if n != id_name]
    given = places(rows.where(F.col("action") == INSERT).drop(id_name), [], sorted(n for n in names if n in own and _ordered(kinds[n])), "_nth").withColumn(id_name, F.col("_nth") + last)
    kind = kinds.get(id_name, T.LongType())
    return rows.where(F.col("action") != INSERT).withColumn(id_name, F.col(id_name).cast(kind) if id_name in old else F.lit(None).cast(kind)).select("action", id_name, *names).union(given.select("action", F.col(id_name).cast(kind), *names))


def _ordered(kind: T.DataType) -> bool:
    return isinstance(kind, T.AtomicType)


def upserted(stored: DataFrame, new: DataFrame, keys: Sequence[str], order: str | None = None) -> DataFrame:
    """stored with the rows of new in place of those with the same keys; of several new ones the greatest by order."""
    from .rows import reduced

    last = reduced(new, keys, F.col(order), last=True) if order else new.dropDuplicates(list(keys))
    return stored.join(last.select(*keys), list(keys), "left_anti").unionByName(last, allowMissingColumns=True)


def inserted_if_absent(stored: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    return stored.unionByName(new.dropDuplicates(list(keys)).join(stored, list(keys), "left_anti"), allowMissingColumns=True)


def linked(links: DataFrame, more: DataFrame) -> DataFrame:
    """A link table as a set, with more links."""
    return links.union(more.select(*links.columns)).distinct()


def resolved(rows: DataFrame, targets: DataFrame, attempts: Sequence[tuple[str, str]], target: str, out: str) -> DataFrame:
    """rows with ``out``: the target found by the first attempt (own column, target's column) that finds one.

    Of several targets for a key the least wins. Rows without any keep a null.
    """
    found = rows
    names = []
    for k, (own, theirs) in enumerate(attempts):
        side = targets.where(F.col(theirs).isNotNull()).groupBy(F.col(theirs).alias(f"_key{k}")).agg(F.min(target).alias(f"_hit{k}"))
        found = found.join(side, found[own] == side[f"_key{k}"], "left").drop(f"_key{k}")
        names.append(f"_hit{k}")
    return found.withColumn(out, F.coalesce(*names)).drop(*names)
