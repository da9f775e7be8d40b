"""Functions on pandas series as column functions."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def vectorised(kind: str) -> Callable[[Callable], Callable[..., Column]]:
    """Makes a column function of a function on pandas series; kind is the type it returns.

    The pandas UDF is made when columns are given, so modules can be imported before there is a session.
    """

    def of(f: Callable) -> Callable[..., Column]:
        @functools.wraps(f)
        def columns(*args: Column | str) -> Column:
            return F.pandas_udf(f, kind)(*args)

        return columns

    return of
