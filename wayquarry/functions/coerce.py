"""Numbers, flags and blanks as the content store reads them. All functions take and give columns."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def js_round(x: Column | str, places: int = 0) -> Column:
    """Rounds to nearest, ties towards plus infinity (built-in rounding takes ties away from zero)."""
    f = float(10**places)
    return F.floor(col(x) * f + 0.5) / f


def loose_number(x: Column | str) -> Column:
    """A number, with a decimal comma accepted. Null and blank are zero; what isn't a number is null."""
    text = F.trim(col(x).cast("string"))
    value = F.regexp_replace(text, ",", ".").try_cast("double")
    return F.when(text.isNull() | (text == ""), F.lit(0.0)).when(F.isnan(value), None).otherwise(value)


def source_number(x: Column | str) -> Column:
    """A number, with a decimal comma accepted. Null stays null; blank is zero."""
    return F.when(col(x).isNotNull(), loose_number(x))


def or_default(x: Column | str, default: object) -> Column:
    """The default where x is null or zero."""
    return F.when(col(x).isNull() | (col(x) == 0), F.lit(default)).otherwise(col(x))


def blank_to_null(x: Column | str) -> Column:
    """White space as single spaces, none around; null if nothing is left."""
    text = F.trim(F.regexp_replace(col(x).cast("string"), r"\s+", " "))
    return F.nullif(text, F.lit(""))


def flag(x: Column | str) -> Column:
    """Whether a text says yes."""
    return F.coalesce(F.lower(blank_to_null(x)).isin("1", "true", "yes", "ja", "y"), F.lit(False))


def first_filled(df: DataFrame, names: Iterable[str]) -> Column:
    """The first value that isn't blank among those of the named columns that df has."""
    there = {c.lower(): c for c in df.columns}
    found = [blank_to_null(F.col(f"`{there[n.lower()]}`")) for n in names if n.lower() in there]
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def fill_defaults(df: DataFrame, defaults: Mapping[str, object]) -> DataFrame:
    """Null or empty values of the named columns become the defaults."""
    new = {}
    for name, value in defaults.items():
        old = F.col(name) if name in df.columns else F.lit(None)
        new[name] = F.coalesce(F.when(old.cast("string") != "", old), F.lit(value))
    return df.withColumns(new)


def node_number(x: Column | str) -> Column:
    """The number on a node's sign; empty for a crossing without one (blank, zero or negative numbers)."""
    text = F.trim(F.coalesce(col(x).cast("string"), F.lit("")))
    number = text.try_cast("double")
    return F.when(text.startswith("-") | F.coalesce(number <= 0, F.lit(False)), F.lit("")).otherwise(text)


def kilometres(x: Column | str, unit: str = "km") -> Column:
    value = source_number(x)
    return value / 1000 if unit == "m" else value


def keyed(pairs: Mapping[str, str], key: Column) -> Column:
    """What a small table of fixed values has for a key."""
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])[key]


def first_reason(*rules: tuple[Column, Column | str]) -> Column:
    """The reason of the first rule whose condition holds; null if none does."""
    found = reduce(lambda w, rule: w.when(*_rule(rule)), rules[1:], F.when(*_rule(rules[0])))
    return found.otherwise(F.lit(None).cast("string"))


def _rule(rule: tuple[Column, Column | str]) -> tuple[Column, Column]:
    condition, reason = rule
    return F.coalesce(condition, F.lit(False)), F.lit(reason) if isinstance(reason, str) else reason


def safe_json(x: Column | str, schema: str) -> Column:
    """Parsed JSON; null where it can't be read."""
    return F.from_json(col(x), schema, {"mode": "PERMISSIVE"})
