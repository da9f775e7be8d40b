"""Tables of a database: read in key ranges with the filters that it can apply itself, and written so that a run counts whole or not at all.

    database.register(spark)
    options = {"connect": '{"database": "/data/site.db"}', "table": "routes"}
    spark.read.format("database_table").schema("id long, slug string, status int").options(**options, key="id", parts=16).load().where("status = 1 and slug <> ''")
    rows.write.format("database_table").mode("append").options(**options, keys="id,month", write="replace").save()

The driver is any DB-API module (``module``, sqlite3 by default) and is called with ``connect``. Only the schema's columns are asked for.

Reading: comparisons, lists, null checks and beginnings of texts go into the query's condition; with ``key`` (a column of whole numbers) each of ``parts``
ranges of it is a partition, and ranges lie between the least and the greatest key that the condition leaves. Databases that compare texts without regard to
case or to spaces at the end are named by ``binary=false``: then only conditions that can't lose a row are sent (equality, lists), and Spark looks at them again.

Writing: tasks stage their rows beside the table, each under a name of its own attempt; when all are done the driver applies those of the attempts that
succeeded in one transaction, else what was staged goes. ``write`` says how they are applied: ``replace`` (rows with the same ``keys`` go first; of several new ones the one
that is greatest by ``order`` counts), ``union`` (rows that aren't there yet are added, whole rows or by ``keys``), or ``actions`` (the column ``action`` says insert, update, delete or keep, by
``keys``; keep changes nothing). So a rerun, or a task that failed and was run again, leaves the same table. Null keys equal each other.
"""

from __future__ import annotations

import importlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql import datasource as D
from pyspark.sql import types as T

from .paged import value_as

CHUNK = 500
COMPARED = {D.EqualTo: "=", D.GreaterThan: ">", D.GreaterThanOrEqual: ">=", D.LessThan: "<", D.LessThanOrEqual: "<="}


def register(spark: SparkSession) -> None:
    spark.dataSource.register(DatabaseTable)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


class Connection:
    """A connection in a with-block: committed at its end, rolled back on an error. Signs for values are written as ?."""

    def __init__(self, options: dict) -> None:
        self.module = importlib.import_module(options.get("module", "sqlite3"))
        self.own = self.module.connect(**json.loads(options["connect"]))

    def __enter__(self) -> Connection:
        return self

    def __exit__(self, kind: object, error: object, trace: object) -> None:
        try:
            self.own.rollback() if kind else self.own.commit()
        finally:
            self.own.close()

    def run(self, sql: str, values: tuple | list = (), many: bool = False) -> object:
        cursor = self.own.cursor()
        sql = sql if self.module.paramstyle == "qmark" else sql.replace("?", "%s")
        (cursor.executemany if many else cursor.execute)(sql, values)
        return cursor


def quoted(name: str, options: dict) -> str:
    sign = options.get("quote", '"')
    return sign + name.replace(sign, sign * 2) + sign


def condition(f: D.Filter, options: dict) -> tuple[str, list, bool] | None:
    """A filter as SQL with its values, and whether it says exactly the same there; None if it isn't sent."""
    binary = options.get("binary", "true") == "true"
    if isinstance(f, D.Not):
        inner = condition(f.child, options)
        # what is more than asked for would, negated, be less
        return (f"NOT ({inner[0]})", inner[1], True) if inner and inner[2] else None
    if not hasattr(f, "attribute") or len(f.attribute) != 1:
        return None
    name = quoted(f.attribute[0], options)
    if isinstance(f, D.IsNull):
        return f"{name} IS NULL", [], True
    if isinstance(f, D.IsNotNull):
        return f"{name} IS NOT NULL", [], True
    values = list(f.value) if isinstance(f, D.In) else [f.value]
    if not all(isinstance(v, (int, float, str)) and not isinstance(v, bool) for v in values):
        return None
    exact = binary or not any(isinstance(v, str) for v in values)
    if isinstance(f, D.In):
        return f"{name} IN ({', '.join('?' * len(values))})", values, exact
    if isinstance(f, D.EqualTo):
        return f"{name} = ?", values, exact
    if type(f) in COMPARED and exact:
        return f"{name} {COMPARED[type(f)]} ?", values, True
    if isinstance(f, D.StringStartsWith) and exact and values[0]:
        # all that starts with a text lies from it on, and before that text with its last sign one higher
        low = values[0]
        return (f"({name} >= ? AND {name} < ?)", [low, low[:-1] + chr(ord(low[-1]) + 1)], True) if ord(low[-1]) < 0xD7FF else None
    return None


@dataclass
class KeyRange(D.InputPartition):
    """From low up to, but not including, high; both None: rows without a key, or all where there is no key."""

    low: int | None
    high: int | None


class TableReader(D.DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict) -> None:
        self.kind, self.options = schema, dict(options)
        self.conditions: list[str] = []
        self.values: list = []

    def pushFilters(self, filters: list[D.Filter]) -> Iterator[D.Filter]:
        for f in filters:
            found = condition(f, self.options)
            if found:
                self.conditions.append(found[0])
                self.values += found[1]
            if not found or not found[2]:
                yield f

    def _where(self, *more: str) -> str:
        every = [*self.conditions, *more]
        return " WHERE " + " AND ".join(f"({c})" for c in every) if every else ""

    def partitions(self) -> list[D.InputPartition]:
        key = self.options.get("key")
        if not key:
            return [KeyRange(None, None)]
        name, table = quoted(key, self.options), quoted(self.options["table"], self.options)
        with Connection(self.options) as db:
            low, high, n, keyed = db.run(f"SELECT min({name}), max({name}), count(*), count({name}) FROM {table}{self._where()}", self.values).fetchone()
        found = [KeyRange(None, None)] if keyed < n else []
        if keyed:
            parts = min(int(self.options.get("parts", 8)), high - low + 1)
            cuts = [low + (high - low + 1) * k // parts for k in range(parts + 1)]
            found += [KeyRange(a, b) for a, b in zip(cuts, cuts[1:])]
        return found or [KeyRange(0, 0)]

    def read(self, partition: KeyRange) -> Iterator[tuple]:
        names = [quoted(f.name, self.options) for f in self.kind.fields]
        values, more = list(self.values), []
        if key := self.options.get("key"):
            name = quoted(key, self.options)
            more = [f"{name} IS NULL"] if partition.low is None else [f"{name} >= ? AND {name} < ?"]
            values += [] if partition.low is None else [partition.low, partition.high]
        with Connection(self.options) as db:
            cursor = db.run(f"SELECT {', '.join(names) or '1'} FROM {quoted(self.options['table'], self.options)}{self._where(*more)}", values)
            while rows := cursor.fetchmany(10_000):
                for row in rows:
                    yield tuple(value_as(f.dataType, v) for f, v in zip(self.kind.fields, row))


@dataclass
class Staged(D.WriterCommitMessage):
    attempt: str


class TableWriter(D.DataSourceWriter):
    def __init__(self, schema: T.StructType, options: dict, overwrite: bool) -> None:
        self.names, self.options, self.overwrite = [f.name for f in schema.fields], dict(options), overwrite
        self.how = self.options.get("write", "replace")
        self.keys = [k.strip() for k in self.options.get("keys", "").split(",") if k.strip()]
        missing = [k for k in [*self.keys, *([self.options["order"]] if "order" in self.options else [])] if k not in self.names]
        if self.how not in ("replace", "union", "actions") or missing or (not self.keys and self.how != "union") or (self.how == "actions") != ("action" in self.names):
            raise ValueError("write is replace or actions (both with keys; the latter with a column action) or union, and all columns named must be there")
        self.stage = f"{self.options['table']}_staged_{uuid.uuid4().hex[:12]}"
        column = lambda n: f"{quoted(n, self.options)} {self.options.get('stage_type', '')}".rstrip()
        with Connection(self.options) as db:
            db.run(f"CREATE TABLE {self._q(self.stage)} (wq_attempt CHAR(32), wq_place BIGINT, {', '.join(map(column, self.names))})")

    def _q(self, name: str) -> str:
        return quoted(name, self.options)

    def write(self, rows: Iterator) -> Staged:
        attempt = uuid.uuid4().hex
        sql = f"INSERT INTO {self._q(self.stage)} VALUES ({', '.join('?' * (len(self.names) + 2))})"
        chunk: list[tuple] = []

        def flush() -> None:
            with Connection(self.options) as db:
                db.run(sql, chunk, many=True)
            chunk.clear()

        for place, row in enumerate(rows):
            chunk.append((attempt, place, *(v.isoformat(" ") if hasattr(v, "isoformat") else v for v in row)))
            if len(chunk) == CHUNK:
                flush()
        if chunk:
            flush()
        return Staged(attempt)

    def _same(self, a: str, b: str, names: list[str]) -> str:
        one = lambda n: f"({a}.{n} = {b}.{n} OR ({a}.{n} IS NULL AND {b}.{n} IS NULL))"
        return " AND ".join(one(self._q(n)) for n in names)

    def commit(self, messages: list) -> None:
        stage, table = self._q(self.stage), self._q(self.options["table"])
        target = [n for n in self.names if n != "action"]
        columns = ", ".join(map(self._q, target))
        with Connection(self.options) as db:
            marks = ", ".join("?" * len(messages)) or "NULL"
            db.run(f"DELETE FROM {stage} WHERE wq_attempt NOT IN ({marks})", [m.attempt for m in messages])
            if self.overwrite:
                db.run(f"DELETE FROM {table}")
            if self.keys:  # of several rows of a key one counts
                order = [self._q(self.options["order"])] if "order" in self.options else []
                rank = [*order, "wq_attempt", "wq_place"]
                later = " OR ".join("(" + " AND ".join([*(f"b.{c} = a.{c}" for c in rank[:k]), f"b.{rank[k]} > a.{rank[k]}"]) + ")" for k in range(len(rank)))
                db.run(f"CREATE TEMPORARY TABLE wq_last AS SELECT * FROM {stage} a WHERE NOT EXISTS (SELECT 1 FROM {stage} b WHERE {self._same('a', 'b', self.keys)} AND ({later}))")
            source = "wq_last" if self.keys else stage
            exists = lambda of, names, more="": f"EXISTS (SELECT 1 FROM {of} s WHERE {self._same('s', 't', names)}{more})"
            if self.how == "union":
                names = self.keys or target
                db.run(f"INSERT INTO {table} ({columns}) SELECT DISTINCT {columns} FROM {source} t WHERE NOT {exists(table, names)}")
            else:
                changes = " AND s.action IN ('insert', 'update', 'delete')" if self.how == "actions" else ""
                db.run(f"DELETE FROM {table} AS t WHERE {exists(source, self.keys, changes)}")
                added = " WHERE action IN ('insert', 'update')" if self.how == "actions" else ""
                db.run(f"INSERT INTO {table} ({columns}) SELECT {columns} FROM {source}{added}")
            if self.keys:
                db.run("DROP TABLE wq_last")
            db.run(f"DROP TABLE {stage}")

    def abort(self, messages: list) -> None:
        with Connection(self.options) as db:
            db.run(f"DROP TABLE IF EXISTS {self._q(self.stage)}")


class DatabaseTable(D.DataSource):
    @classmethod
    def name(cls) -> str:
        return "database_table"

    def schema(self) -> str:
        raise ValueError("name the columns that are wanted: .schema(...)")

    def reader(self, schema: T.StructType) -> D.DataSourceReader:
        return TableReader(schema, self.options)

    def writer(self, schema: T.StructType, overwrite: bool) -> D.DataSourceWriter:
        return TableWriter(schema, self.options, overwrite)
