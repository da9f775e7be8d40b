"""Long files read in parallel, filters that reach the source, writes that count whole or not at all."""

from __future__ import annotations

import http.server
import json
import random
import sqlite3
import threading
import urllib.parse

import pytest
from pyspark.sql import functions as F

from wayquarry.sources import database, files, geojson, splits, sqldump
from wayquarry.sources.paged import PagedJson

NASTY = ["a", ")", "(", ";", "''", "\\'", "\\\\", "\n", "--  ", "/*", "*/", "#", '"', "`", ",", " VALUES (", " INSERT INTO t VALUES (9,9);", "é😀"]


def sql_value(rng):
    kind = rng.randrange(6)
    return "NULL" if kind == 0 else str(rng.randrange(-99, 99)) if kind == 1 else "'" + "".join(rng.choice(NASTY) for _ in range(rng.randrange(6))) + "'"


def sql_statement(rng, rows=7):
    kind = rng.randrange(9)
    others = ["-- it's a comment (with) \" signs;\n", "/* block ' ( ; */\n", "CREATE TABLE `t;(` (a int COMMENT 'x;(''y)', b int(3) DEFAULT \"q)\") ENGINE=x;\n", "# it's\n", "INSERT INTO o VALUES (1),(2);"]
    if kind < len(others):
        return others[kind]
    head = rng.choice(["INSERT INTO `t` (`a`,`b`) VALUES ", "insert ignore into t values\n"])
    return head + ",".join(f"({sql_value(rng)},{sql_value(rng)})" for _ in range(rng.randrange(1, rows))) + ";\n"


def cut(rng, text, sign):
    """The text's pieces in splits of chunks, as lists of lists of pieces, and whether the text ends with the sign."""
    pieces = text.split(sign)
    closed = text.endswith(sign)
    pieces = pieces[:-1] if closed else pieces

    def some(x, most):
        at = 0
        while at < len(x):
            n = rng.randrange(1, most)
            yield x[at : at + n]
            at += n

    return list(some(list(some(pieces, 5)), 4)), closed


def joined(sign, parts, closed):
    for k, split in enumerate(parts):
        yield [sign.join(c) + ("" if k == len(parts) - 1 and m == len(split) - 1 and not closed else sign) for m, c in enumerate(split)]


def done(parts, sign, states, summary, composed):
    found = []
    for split in parts:
        own = None
        for chunk in split:
            later = {s: summary(sign.join(chunk) + sign, s) for s in states}
            own = later if own is None else {s: composed(own[s], later) for s in states}
        found.append(own)
    return found


def test_dumps_in_any_cuts():
    """Rows of cut dumps are those of whole ones, wherever strings, comments and statements are cut, and where a dump breaks off."""
    rng = random.Random(5)
    for _ in range(800):
        dump = "".join(sql_statement(rng) for _ in range(rng.randrange(1, 9)))
        dump = dump[: rng.randrange(len(dump) + 1)] if rng.random() < 0.3 else dump
        parts, closed = cut(rng, dump, sqldump.CUT)
        does = done(parts, sqldump.CUT, sqldump.STATES, lambda t, s: (s, *sqldump.reduced(t, s)), sqldump.composed)
        got = []
        for left, texts in zip(sqldump._follow(does, ""), joined(sqldump.CUT, parts, closed)):
            for text in texts:
                text = left + text
                got += sqldump.inserts(text, "t")
                left = sqldump.reopened(sqldump.reduced(text)[2])
        assert got == list(sqldump.inserts(dump, "t")), dump


def test_what_is_left_of_a_long_statement_is_short():
    text = "INSERT INTO t (a, b) VALUES " + ",".join(f"({k},'row ({k})')" for k in range(5000)) + ",(7,'open"
    state, ended, left = sqldump.reduced(text)
    assert (state, ended) == (sqldump.STRING, False) and len(left) < 100
    assert sqldump.reopened(left) == "INSERT INTO t (a, b) VALUES (7,'open"


@pytest.mark.parametrize("sent", [splits.SENT_BYTES, 0])
def test_a_dump_is_read_by_many_tasks(spark, tmp_path, monkeypatch, sent):
    rng = random.Random(11)
    rows = [(str(k), "".join(rng.choice(NASTY).replace("''", "'").replace("\\'", "'").replace("\\\\", "\\") for _ in range(20))) for k in range(4000)]
    quote = lambda x: "'" + x.replace("\\", "\\\\").replace("'", "''" if rng.random() < 0.5 else "\\'") + "'"
    statement = lambda some: "INSERT INTO `t` (`a`,`b`) VALUES " + ",".join(f"({a},{quote(b)})" for a, b in some) + ";\n"
    (tmp_path / "one.sql").write_text("-- it's one\n" + statement(rows[:3000]))
    (tmp_path / "two.sql").write_text("".join(statement(rows[k : k + 50]) for k in range(3000, 4000, 50)) + "INSERT INTO t VALUES (1,2,3);")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    monkeypatch.setattr(splits.each_split, "__defaults__", (sent,))
    monkeypatch.setattr(splits, "CHUNK_CHARS", 1000)
    try:
        found = sqldump.read(spark, str(tmp_path), "t", ["a", "b"])
        assert sorted(map(tuple, found.collect())) == sorted(rows)
        assert splits.pieces(spark, str(tmp_path), ")").select("file", "start").distinct().count() > 20
        assert [r.n for r in sqldump.malformed(spark, str(tmp_path), "t", ["a", "b"]).collect()] == [1]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def feature(rng):
    text = lambda: "".join(rng.choice(["a", "}", "{", "[", "]", '"', "\\", ":", ",", "type", "features", " ", "é", "\n"]) for _ in range(rng.randrange(6)))
    geometry = rng.choice([None, {"type": "Point", "coordinates": [1.5, 2]}, {"type": "LineString", "coordinates": [[1, 2], [3, 4]]}, {"type": "Polygon", "coordinates": [[[1, 2], [3, 4]]]}])
    items = [("type", "Feature"), ("id", text()), ("geometry", geometry), ("properties", {text(): rng.choice([text(), 1, None, {"x": {"features": [{}]}}, [text()]]) for _ in range(rng.randrange(4))})]
    rng.shuffle(items)
    return dict(items)


def collection(rng, n):
    found = [feature(rng) for _ in range(n)]
    items = [("type", rng.choice(["FeatureCollection"] * 4 + ["Other"])), ("crs", {"properties": {"features": [{"a": 1}]}}), ("links", [{"no": 1}, {"features": [{"z": 2}]}]), ("features", found), ("name", "a } b"), ("bbox", [1, 2])]
    rng.shuffle(items)
    root = dict(items)
    return json.dumps(root, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 1])) + rng.choice(["", "\n"]), found if root["type"] == "FeatureCollection" else []


def test_collections_in_any_cuts():
    rng = random.Random(3)
    same = lambda x: sorted(json.dumps(f, sort_keys=True) for f in x)
    for _ in range(800):
        text, expected = collection(rng, rng.randrange(6))
        parts, closed = cut(rng, text, geojson.CUT)
        does = done(parts, geojson.CUT, (geojson.CODE, geojson.STRING), geojson.nesting, geojson.composed)
        got, open_one = [], []
        for (state, depth, container, wanted), texts in zip(geojson._follow(does, (geojson.CODE, 0, None)), joined(geojson.CUT, parts, closed)):
            for kind, piece in geojson.parts_of(iter(texts), state, depth, container) if wanted else ():
                open_one = [piece] if kind == "head" else [*open_one, piece]
                if kind in ("whole", "tail"):
                    got.append(json.loads(piece if kind == "whole" else "".join(open_one)))
        assert same(got) == same(expected), text


def test_a_collection_is_read_by_many_tasks(spark, tmp_path, monkeypatch):
    rng = random.Random(8)
    expected = []
    for k in range(3):
        text, found = collection(rng, 400)
        (tmp_path / f"{k}.json").write_text(text)
        expected += found
    big = {"type": "Feature", "id": "big", "geometry": {"type": "LineString", "coordinates": [[k, {"odd": "}"}] for k in range(9000)]}, "properties": {}}
    (tmp_path / "big.json").write_text(json.dumps({"features": [big, big], "type": "FeatureCollection"}))
    (tmp_path / "not.json").write_text("no json } at { all")
    expected += [big, big]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        found = [json.loads(r.feature) for r in geojson.texts(spark, str(tmp_path)).collect()]
        assert sorted(json.dumps(f, sort_keys=True) for f in found) == sorted(json.dumps(f, sort_keys=True) for f in expected)
        rows = files.features(spark, str(tmp_path)).where("id = 'big'").collect()
        assert [json.loads(r.geometry)["type"] for r in rows] == ["LineString"] * 2
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


# ---- tables of a database


@pytest.fixture
def site(spark, tmp_path):
    database.register(spark)
    path = str(tmp_path / "site.db")
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE routes (id INTEGER, slug TEXT, status INTEGER, body TEXT, km REAL)")
        db.executemany("INSERT INTO routes VALUES (?, ?, ?, ?, ?)", [(k if k % 50 else None, ["", "a-b", None, f"s{k}", "A-B "][k % 5], k % 3, "x" * 100, k / 2) for k in range(1, 1000)])
        db.execute("CREATE TABLE months (id INTEGER, month TEXT, views INTEGER)")
        db.executemany("INSERT INTO months VALUES (?, ?, ?)", [(1, "2024-01", 5), (2, "2024-01", 6), (None, "2024-02", 7)])
    return path, {"connect": json.dumps({"database": path, "timeout": 60})}


SCHEMA = "id long, slug string, status int, km double"


def routes(spark, options, **more):
    return spark.read.format("database_table").schema(SCHEMA).options(**options, table="routes", **more).load()


@pytest.mark.parametrize("more", [{}, {"key": "id", "parts": "7"}, {"key": "id", "binary": "false"}])
@pytest.mark.parametrize("where", ["true", "status = 1 and slug <> ''", "id between 100 and 130", "slug is null or status = 2", "slug like 'a-%'", "slug in ('a-b', 's3')", "not (slug = 'a-b')", "km > 17.5 and upper(slug) = 'A-B'", "id is null", "status = 9", "slug = 'a-b'", "id <=> 5", "slug > 's5'"])
def test_rows_are_those_of_the_filter(spark, site, where, more):
    path, options = site
    everything = spark.createDataFrame(sqlite3.connect(path).execute("SELECT id, slug, status, km FROM routes").fetchall(), SCHEMA)
    found = routes(spark, options, **more).where(where)
    assert sorted(map(repr, found.collect())) == sorted(map(repr, everything.where(where).collect()))


def test_filters_reach_the_source(spark, site):
    _, options = site
    found = routes(spark, options, key="id").where("status = 1 and slug <> '' and upper(slug) = 'A-B'")
    plan = found._jdf.queryExecution().toString()
    physical = plan[plan.index("== Physical Plan ==") :]
    assert "upper(slug" in physical
    assert "(status" not in physical.split("BatchScan")[0]
    reader = database.TableReader(found.schema, options | {"table": "routes", "key": "id", "parts": "4"})
    left = list(reader.pushFilters([database.D.EqualTo(("status",), 1), database.D.Not(database.D.EqualTo(("slug",), "")), database.D.StringContains(("slug",), "x"), database.D.GreaterThan(("id",), 900)]))
    assert [type(f).__name__ for f in left] == ["StringContains"]
    assert reader.conditions == ['"status" = ?', 'NOT ("slug" = ?)', '"id" > ?']
    assert all(p.low is None or p.low > 900 for p in reader.partitions())
    loose = database.TableReader(found.schema, options | {"table": "routes", "binary": "false"})
    left = list(loose.pushFilters([database.D.EqualTo(("slug",), "a"), database.D.Not(database.D.EqualTo(("slug",), "")), database.D.GreaterThan(("id",), 3)]))
    assert [type(f).__name__ for f in left] == ["EqualTo", "Not"] and loose.conditions == ['"slug" = ?', '"id" > ?']


def months(path):
    return sorted(sqlite3.connect(path).execute("SELECT id, month, views FROM months").fetchall(), key=repr)


def save(df, options, **more):
    df.write.format("database_table").mode("append").options(**options, table="months", **more).save()


def staged(path):
    return [r[0] for r in sqlite3.connect(path).execute("SELECT name FROM sqlite_master WHERE name LIKE '%staged%'").fetchall()]


def test_keyed_replace(spark, site):
    path, options = site
    new = spark.createDataFrame([(1, "2024-01", 50), (1, "2024-01", 40), (3, "2024-03", 9), (None, "2024-02", 70)], "id long, month string, views long").repartition(3)
    for _ in range(2):  # a rerun changes nothing
        save(new, options, keys="id,month", order="views")
        assert months(path) == sorted([(1, "2024-01", 50), (2, "2024-01", 6), (3, "2024-03", 9), (None, "2024-02", 70)], key=repr)
    assert staged(path) == []


def test_union_and_actions(spark, site):
    path, options = site
    links = spark.createDataFrame([(1, "2024-01", 5), (1, "2024-01", 5), (8, "2024-01", None)], "id long, month string, views long")
    for _ in range(2):
        save(links, options, write="union")
    assert months(path) == sorted([(1, "2024-01", 5), (2, "2024-01", 6), (None, "2024-02", 7), (8, "2024-01", None)], key=repr)
    acts = spark.createDataFrame([("delete", 1, "2024-01", 5), ("update", 2, "2024-01", 60), ("keep", None, "2024-02", 99), ("insert", 4, "2024-04", 1), ("stale", 8, "2024-01", 3)], "action string, id long, month string, views long")
    for _ in range(2):
        save(acts, options, keys="id,month", write="actions")
        assert months(path) == sorted([(2, "2024-01", 60), (None, "2024-02", 7), (4, "2024-04", 1), (8, "2024-01", None)], key=repr)


def test_a_failed_run_changes_nothing(spark, site):
    path, options = site
    before = months(path)
    rows = spark.range(4000).repartition(4).select((F.col("id") + 10).alias("id"), F.lit("m").alias("month"), F.when(F.col("id") == 3777, F.raise_error(F.lit("broken row"))).otherwise(F.col("id")).cast("long").alias("views"))
    with pytest.raises(Exception, match="broken row"):
        save(rows, options, keys="id,month")
    assert months(path) == before and staged(path) == []


def test_an_attempt_that_failed_leaves_nothing(spark, site):
    """Rows that an attempt staged before it broke aren't applied: the driver names those that succeeded."""
    path, options = site
    schema = spark.createDataFrame([], "id long, month string, views long").schema
    writer = database.TableWriter(schema, options | {"table": "months", "keys": "id,month"}, overwrite=False)

    def breaking():
        yield from ((k, "half", k) for k in range(database.CHUNK + 1))
        raise RuntimeError

    with pytest.raises(RuntimeError):
        writer.write(breaking())
    message = writer.write(iter([(77, "whole", 1)]))
    writer.commit([message])
    assert (77, "whole", 1) in months(path) and not any(m == "half" for _, m, _ in months(path)) and staged(path) == []


def test_only_filtered_pages_are_fetched(spark):
    """The service gets the conditions that it understands, so pages without wanted rows are never asked for."""
    rows = [{"id": k, "kind": "ab"[k % 10 == 0], "n": k % 4} for k in range(100)]
    asked = []

    class Service(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            query = dict(urllib.parse.parse_qsl(urllib.parse.urlparse(self.path).query))
            asked.append(query)
            found = [r for r in rows if query.get("type", r["kind"]) == r["kind"]]
            at, n = int(query["offset"]), int(query["limit"])
            body = json.dumps({"total": len(found), "rows": found[at : at + n]}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    spark.dataSource.register(PagedJson)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    url = f"http://127.0.0.1:{server.server_address[1]}/items?limit={{limit}}&offset={{offset}}{{filters}}"
    read = spark.read.format("paged_json").schema("id long, kind string, n int").options(url=url, total="total", records="rows", limit=5, parameters='{"kind": "type"}')
    found = read.load().where("kind = 'b' and n = 2")
    assert sorted(r.id for r in found.collect()) == [10, 30, 50, 70, 90]
    pages = [q for q in asked if q.get("type") == "b"]
    assert len(pages) == len(asked) and {q["offset"] for q in pages} == {"0", "5"}
    asked.clear()
    assert read.load().where("n = 1").count() == 25
    assert len({q["offset"] for q in asked}) == 20
    server.shutdown()
