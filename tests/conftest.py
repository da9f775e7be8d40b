"""Shared by all tests: one session, and the driver's tables seen by DuckDB."""

from __future__ import annotations

import sys
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

DATA = Path("/root/testdata")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .config("spark.checkpoint.dir", "file://" + str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def plain(value):
    """Values as both engines may give them, made comparable."""
    if isinstance(value, float):
        return "nan" if value != value else round(value, 6) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    if isinstance(value, dict):
        return tuple(sorted((k, plain(v)) for k, v in value.items()))
    if hasattr(value, "asDict"):
        return plain(value.asDict())
    if hasattr(value, "isoformat"):
        return value.isoformat()[:26]
    return value


def rows_of(df: DataFrame) -> list[tuple]:
    names = sorted(df.columns)
    return sorted((tuple(plain(r[n]) for n in names) for r in df.collect()), key=repr)


class Oracle:
    def __init__(self, sf: str) -> None:
        self.db = duckdb.connect()
        self.db.execute("SET TimeZone = 'UTC'")
        for name in TABLES:
            self.db.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{DATA / sf / name}.parquet')")

    def rows(self, sql: str) -> tuple[list[str], list[tuple]]:
        found = self.db.execute(sql)
        names = [d[0] for d in found.description]
        order = sorted(range(len(names)), key=names.__getitem__)
        return [names[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in found.fetchall()), key=repr)


@pytest.fixture(scope="session")
def oracle():
    found: dict[str, Oracle] = {}

    def at(sf: str) -> Oracle:
        return found.setdefault(sf, None) or found.__setitem__(sf, Oracle(sf)) or found[sf]

    return at


def same_as_sql(spark: SparkSession, query, sql: str, oracle: Oracle, sf: str) -> None:
    df = query(spark, str(DATA / sf))
    names, expected = oracle.rows(sql)
    assert sorted(df.columns) == names
    found = rows_of(df)
    assert len(found) == len(expected)
    for a, b in zip(found, expected):
        assert a == b
