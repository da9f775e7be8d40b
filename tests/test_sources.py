"""Readers, HTML, streaming."""

from __future__ import annotations

import json
import random

from pyspark.sql import functions as F
from tests.conftest import DATA

from wayquarry.operators import html
from wayquarry.sources import files, gpx, sqldump
from wayquarry.sources.paged import PagedJson
from wayquarry.streaming import views

DUMP = r"""-- comment
INSERT INTO `other` VALUES (1,'no');
INSERT INTO `t` (`id`,`name`,`x`) VALUES (1,'it''s; (fine)','a\'b\n\\'),(2,NULL,-1.5),(3,'short');
insert into t values (4, 'three', ''),
 (5, 'four', 'NULL');
"""


def test_sql_dump(spark, tmp_path):
    (tmp_path / "d.sql").write_text(DUMP)
    found = sqldump.read(spark, str(tmp_path / "d.sql"), "t", ["id", "name", "x"])
    assert sorted(map(tuple, found.collect())) == [("1", "it's; (fine)", "a'b\n\\"), ("2", None, "-1.5"), ("4", "three", ""), ("5", "four", "NULL")]
    assert [r.n for r in sqldump.malformed(spark, str(tmp_path / "d.sql"), "t", ["id", "name", "x"]).collect()] == [1]
    assert [r.x for r in sqldump.without_placeholders(found).where("id = 4").collect()] == [None]


def test_delimited_text(spark, tmp_path):
    (tmp_path / "a.csv").write_text('a,b\n"x ""y"", z",1\n"two\nlines",\n')
    assert [tuple(r) for r in files.csv(spark, str(tmp_path / "a.csv")).collect()] == [('x "y", z', "1"), ("two\nlines", None)]
    (tmp_path / "a.tsv").write_text('1\tNULL\t"q\n')
    assert [tuple(r) for r in files.tsv(spark, str(tmp_path / "a.tsv"), ["a", "b", "c"]).collect()] == [("1", None, '"q')]


def test_geojson(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"type": "FeatureCollection", "features": [{"id": "1", "geometry": {"type": "Point", "coordinates": [4, 51]}, "properties": {"NR": 5, "naam": " "}}]}))
    (tmp_path / "b.json").write_text('{"type": "Other"}')
    found = files.named(files.features(spark, str(tmp_path)), files.NODE_NAMES).collect()
    assert [(r.external_id, r.number, r.name) for r in found] == [("1", "5", None)]


def test_records_of_any_shape(spark):
    texts = ['[{"a": 1}, {"a": 2}]', '{"records": [{"a": 3}]}', '{"features": [{"properties": {"a": 4}}]}', "x"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert sorted(r.a for r in files.records(df, "t", "a: int").collect()) == [1, 2, 3, 4]


def test_files_by_name(spark, tmp_path):
    listing = spark.createDataFrame([("/x/Foto.JPG",), ("/a/foto.jpg",)], "path string")
    wanted = spark.createDataFrame([("img/FOTO.jpg",), ("none.png",)], "name string")
    assert sorted(((r.name, r.path) for r in files.latest_files(listing, wanted).collect()), key=repr) == [("img/FOTO.jpg", "/a/foto.jpg"), ("none.png", None)]
    (tmp_path / "p.js").write_text("var x = {'9000': [51.05, 3.72], \"1000\":[50.8,4.3]};")
    assert sorted(map(tuple, files.postcode_points(spark, str(tmp_path / "p.js")).collect())) == [("1000", 50.8, 4.3), ("9000", 51.05, 3.72)]


GPX = """<gpx><metadata><name>Meta</name></metadata><wpt lat="51" lon="4"><name>12</name><cmt>c</cmt></wpt><trk><name>A &amp; B</name><trkseg>
<trkpt lat="51.0" lon="4.0"><ele>5</ele><time>2024-01-01T10:00:00Z</time></trkpt><trkpt lat="51.0" lon="4.0"><ele>5</ele></trkpt><trkpt lat="51.1" lon="4.0"/>
<trkpt lon="4.1" lat="51.2"></trkpt></trkseg></trk></gpx>"""


def test_gpx(spark, tmp_path):
    (tmp_path / "a.gpx").write_text(GPX)
    (tmp_path / "b.gpx").write_text('<gpx><rte><name>R</name><rtept lat="1" lon="2"></rtept><rtept lat="1" lon="3"></rtept></rte></gpx>')
    (tmp_path / "c.gpx").write_text('<gpx><trk><trkseg><trkpt lat="1" lon="2"></trkpt></trkseg></trk></gpx>')
    strict = {r.path[-5]: r for r in gpx.read(spark, str(tmp_path)).collect()}
    assert set(strict) == {"a", "b"}
    assert (strict["a"].title, len(strict["a"].points), strict["a"].points[0].ele) == ("A & B", 2, 5.0)
    assert [(w.name, w.description) for w in strict["a"].waypoints] == [("12", "c")]
    lenient = {r.path[-5]: r for r in gpx.read(spark, str(tmp_path), lenient=True).collect()}
    assert len(lenient["a"].points) == 3
    assert gpx.points(gpx.read(spark, str(tmp_path))).count() == 4


def gpx_files(rng):
    """Files of every shape, some cut short or wrongly nested."""
    for k in range(24):
        point = lambda tag: rng.choice([f'<{tag} lat="{rng.randrange(3)}.5" lon="4"><ele>{rng.choice(["1", "2", "x", ""])}</ele><time>{rng.choice(["2024-01-01T10:00:00Z", "Jan 2 2024 3:04", "?"])}</time></{tag}>', f'<{tag} lon="{rng.randrange(2)}" lat="1"/>', f"<{tag.upper()} lat='1' lon='2'></{tag.upper()} >\n", f'<{tag} lat="1"></{tag}>'])
        some = lambda tag, most: "".join(point(tag) for _ in range(rng.randrange(most)))
        name = lambda: rng.choice(["", "<name></name>", f"<name>é &amp; {rng.random()}</name>", "<name><![CDATA[a > b]]></name><desc>d</desc>"])
        segments = "".join(f"<trkseg>{some('trkpt', 9)}</trkseg>" for _ in range(rng.randrange(4)))
        tracks = "".join(f"<trk>{name()}{segments}{name()}</trk>" for _ in range(rng.randrange(3)))
        routes = "".join(f"<rte>{name()}{some('rtept', 6)}</rte>" for _ in range(rng.randrange(3)))
        stop = '<wpt lat="5" lon="6"><name>w</name><cmt>c</cmt></wpt>'
        text = f"<?xml?><gpx><metadata>{name()}</metadata>{stop * rng.randrange(3)}{tracks}{routes}</gpx>"
        yield {20: text[: len(text) * 2 // 3], 21: text.replace("</trkseg>", "", 1), 22: text + "<trkpt lat='1' lon='2'>", 23: f"<trk>{point('trkpt') * 3}</trk>" + text}.get(k, text)


def test_gpx_points_of_cut_files(spark, tmp_path):
    texts = list(gpx_files(random.Random(3)))
    for k, text in enumerate(texts):
        (tmp_path / f"{k:02}.gpx").write_text(text)
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        assert gpx.splits.pieces(spark, str(tmp_path), gpx.CUT).select("file", "start").distinct().count() > 2 * len(texts)
        for lenient in (False, True):
            tracks, points, waypoints = gpx.read_points(spark, str(tmp_path), lenient)
            titles = {r.path[-6:-4]: (r.title, r.description) for r in tracks.collect()}
            found = {k: [] for k in titles}
            for r in points.orderBy("start", "seq").collect():
                found[r.path[-6:-4]].append((r.lat, r.lng, r.ele, r.time))
            places = {k: [] for k in titles}
            for r in waypoints.orderBy("start", "seq").collect():
                places[r.path[-6:-4]].append((r.name, r.description, r.lat, r.lng))
            wanted = {f"{k:02}": x for k, t in enumerate(texts) if (x := gpx.parse(t, lenient))}
            assert titles == {k: (x["title"], x["description"]) for k, x in wanted.items()}
            assert found == {k: [tuple(p.values()) for p in x["points"]] for k, x in wanted.items()}
            assert places == {k: [tuple(w.values()) for w in x["waypoints"]] for k, x in wanted.items()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_paged_source(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"page-{k}.json").write_text(json.dumps({"d": {"rows": [{"id": 2 * k + i, "tags": {"a": i}} for i in range(2)]}}))
    spark.dataSource.register(PagedJson)
    found = spark.read.format("paged_json").schema("id long, tags string").options(url=f"file://{tmp_path}/page-{{page}}.json", total=6, limit=2, records="d.rows").load()
    assert sorted(r.id for r in found.collect()) == [0, 1, 2, 3, 4, 5]
    assert found.first().tags in ('{"a": 0}', '{"a": 1}')
    (tmp_path / "page-0.json").write_text(json.dumps({"n": 5, "d": {"rows": [{"id": 9, "tags": None}]}}))
    counted = spark.read.format("paged_json").schema("id long").options(url=f"file:///nowhere/{{page}}.json|file://{tmp_path}/page-{{page}}.json", total="n", limit=2, records="d.rows", wait="0").load()
    assert sorted(r.id for r in counted.collect()) == [2, 3, 4, 5, 9]


def test_html_blocks():
    found = html.blocks_of('intro<h2>Head <b>bold</b></h2><p>Text with <a href="https://a.b">link</a> and <em>it</em>.<br>next</p><ul><li>one</li><li> </li><li>two <strong>x</strong></li></ul><img src="p.jpg" alt=" A  b "><script>no</script><p> </p>tail')
    assert [b["type"] for b in found] == ["paragraph", "heading", "paragraph", "paragraph", "list", "image", "paragraph"]
    assert found[1] == {"type": "heading", "level": 2, "children": [{"type": "text", "text": "Head "}, {"type": "text", "text": "bold", "bold": True}]}
    assert found[2]["children"][1] == {"type": "link", "url": "https://a.b", "children": [{"type": "text", "text": "link"}]}
    assert len(found[4]["children"]) == 2
    assert found[5] == {"type": "image", "src": "p.jpg", "alt": "A b"}
    assert html.blocks_of(None) == []
    assert html.blocks_of("<ul><li>open") == [{"type": "list", "format": "unordered", "children": [{"type": "list-item", "children": [{"type": "text", "text": "open"}]}]}]


PLACE = """<div class="card"><h3> Route  1 </h3><a href="/fietsroutes/x">go</a></div><div class="card"><a href="/other/y">no</a></div>
<h2>Title</h2><p>Prose <b>here</b></p><iframe src="https://www.youtube.com/embed/1"></iframe><div itemscope itemtype="https://schema.org/Question"><h3 itemprop="name">Why?</h3><div itemprop="text"><p>Because.</p></div></div>
<div id="map">map</div><ul><li>item</li></ul>"""


def test_place_page(spark):
    r = spark.createDataFrame([(PLACE,), (None,)], "h string").select(html.place_page()(F.col("h")).alias("p")).collect()
    p = r[0].p
    assert [tuple(x) for x in p.faqs] == [("Why?", "Because.")]
    assert [tuple(x) for x in p.cards] == [("Route 1", "/fietsroutes/x")]
    assert p.videos == ["https://www.youtube.com/embed/1"]
    assert [tuple(s) for s in p.sections] == [("Title", "Prose here item")]
    assert r[1].p.sections == []


def test_canonical_json(spark):
    df = spark.createDataFrame([('{"b": 1, "id": 5, "a": [{"id": 1, "c": null}]}',), ("x",), (None,)], "j string")
    assert [r[0] for r in df.select(html.canonical_json(F.col("j"))).collect()] == ['{"a": [{}], "b": 1}', None, None]


def test_streamed_scores_are_those_of_the_table(spark, tmp_path):
    events = spark.read.parquet(str(DATA / "sf0.001/events.parquet")).withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartition(3).write.parquet(f"file://{tmp_path}/events")
    as_of = F.lit("2024-02-01").cast("timestamp")
    run = views.scores(views.read(spark, f"file://{tmp_path}/events"), as_of).writeStream.format("memory").queryName("scores").outputMode("complete").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    run.awaitTermination(120)
    expected = {r.user_id: round(r.score, 9) for r in views.scores(events, as_of).collect()}
    assert {r.user_id: round(r.score, 9) for r in spark.table("scores").collect()} == expected
    twice = views.once(views.read(spark, f"file://{tmp_path}/events").union(views.read(spark, f"file://{tmp_path}/events")), "60 days")
    run = twice.writeStream.format("memory").queryName("once").option("checkpointLocation", f"{tmp_path}/d").trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert spark.table("once").count() == events.count()
