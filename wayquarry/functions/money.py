"""Amounts, references and document numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .coerce import col, js_round


def totals(price: Column | str, discount: Column | str, vat: Column | str, vat_included: Column | bool) -> Column:
    """struct(excl, vat, incl), rounded to cents after each step; a missing discount is none."""
    net = col(price) * (1 - F.coalesce(col(discount), F.lit(0)) / 100)
    included = F.lit(vat_included) if isinstance(vat_included, bool) else vat_included
    incl = F.when(included, js_round(net, 2))
    excl = F.when(included, js_round(js_round(net, 2) / (1 + col(vat) / 100), 2)).otherwise(js_round(net, 2))
    tax = F.when(included, js_round(incl - excl, 2)).otherwise(js_round(excl * col(vat) / 100, 2))
    return F.struct(excl.alias("excl"), tax.alias("vat"), F.coalesce(incl, js_round(excl + tax, 2)).alias("incl"))


def structured_reference(number: Column | str) -> Column:
    """Bank reference of the last ten digits and their check (mod 97, 97 for zero)."""
    base = F.substring(F.concat(F.lit("0" * 10), col(number).cast("string")), -10, 10)
    rest = base.cast("long") % 97
    digits = F.concat(base, F.lpad(F.when(rest == 0, 97).otherwise(rest).cast("string"), 2, "0"))
    return F.concat(F.lit("+++"), F.substring(digits, 1, 3), F.lit("/"), F.substring(digits, 4, 4), F.lit("/"), F.substring(digits, 8, 5), F.lit("+++"))


def next_number(last: Column, start: Column, today: Column) -> Column:
    """The number after last, start at least; numbers of 12 digits are the day and a running count of four digits."""
    last, start = F.coalesce(last.cast("long"), F.lit(0)), F.coalesce(F.nullif(start.cast("long"), F.lit(0).cast("long")), F.lit(1))
    dated = F.length(F.greatest(last, start).cast("string")) == 12
    count = F.greatest(F.when(last > 0, last % 10000 + 1).otherwise(0), F.when(start >= 10**11, start % 10000).otherwise(0), F.lit(1))
    on_day = F.concat(F.date_format(today, "yyyyMMdd"), F.lpad((count % 10000).cast("string"), 4, "0")).cast("long")
    return F.when(dated, on_day).otherwise(F.greatest(last + 1, start))


def euro(x: Column | str) -> Column:
    """Two decimals, a comma before them and points between thousands."""
    return F.concat(F.lit("€ "), F.translate(F.format_number(F.coalesce(col(x), F.lit(0)), 2), ",.", ".,"))
