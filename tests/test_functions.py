"""Column functions on hand-made values."""

from __future__ import annotations

import datetime as dt
import math
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wayquarry.functions import coerce, dates, geo, money
from wayquarry.functions import text as t


def values(spark, column, rows, schema="x string"):
    df = spark.createDataFrame([(i, *(r if isinstance(r, tuple) else (r,))) for i, r in enumerate(rows)], f"i int, {schema}")
    return [r[0] for r in df.orderBy("i").select(column).collect()]


def test_numbers(spark):
    rows = [None, "", " ", "1,5", "-2.5", "x", "1e3", "NaN"]
    assert values(spark, coerce.loose_number("x"), rows) == [0.0, 0.0, 0.0, 1.5, -2.5, None, 1000.0, None]
    assert values(spark, coerce.source_number("x"), rows) == [None, 0.0, 0.0, 1.5, -2.5, None, 1000.0, None]
    assert values(spark, coerce.js_round("x"), [2.5, -2.5, 0.49, -0.5], "x double") == [3.0, -2.0, 0.0, 0.0]
    assert values(spark, coerce.or_default("x", 30), [None, 0, 7], "x int") == [30, 30, 7]
    assert values(spark, coerce.kilometres("x", "m"), ["1500", None]) == [1.5, None]


def test_blanks_and_flags(spark):
    assert values(spark, coerce.blank_to_null("x"), [None, "  ", " a \n b "]) == [None, None, "a b"]
    assert values(spark, coerce.flag("x"), [None, "", "JA", "y", "no", "1"]) == [False, False, True, True, False, True]
    assert values(spark, coerce.node_number("x"), [None, "-9999", "0", " 12 ", "7A", ""]) == ["", "", "", "12", "7A", ""]
    df = spark.createDataFrame([("", "b", None), ("a", "b", "c")], "First string, second string, third string")
    assert [r[0] for r in df.select(coerce.first_filled(df, ["first", "missing", "SECOND"])).collect()] == ["b", "a"]
    assert [tuple(r) for r in coerce.fill_defaults(df, {"third": "z", "fourth": 1}).collect()] == [("", "b", "z", 1), ("a", "b", "c", 1)]


def test_first_reason(spark):
    reason = coerce.first_reason((F.col("x").isNull(), "none"), (F.col("x") > 5, "large"), (F.col("x") > 3, "middling"))
    assert values(spark, reason, [None, 1, 4, 9], "x int") == ["none", None, "middling", "large"]


LATIN = "".join(chr(c) for c in range(0x20, 0x250))


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet=LATIN, max_size=30), min_size=20, max_size=20))
def test_fold_is_decomposition(spark, rows):
    """Letters with several marks fold like those with one; what doesn't decompose stays."""
    expected = ["".join(c for c in unicodedata.normalize("NFD", x) if not "̀" <= c <= "ͯ").lower() for x in rows]
    found = values(spark, F.struct(t.fold("x"), t.fold_exact("x")), rows)
    assert [f[1] for f in found] == expected
    plain = [i for i, x in enumerate(rows) if all(len(unicodedata.normalize("NFD", c)) == 1 or unicodedata.normalize("NFD", c)[0].isascii() for c in x)]
    assert [found[i][0] for i in plain] == [expected[i] for i in plain]


def test_slugs_and_names(spark):
    assert values(spark, t.slug("x"), ["Café  São-Tomé!", "--", None, "B&B Ôde"]) == ["cafe-sao-tome", "", None, "b-b-ode"]
    assert values(spark, t.slug("x", "en"), ["A & B"]) == ["a-en-b"]
    assert values(spark, t.name_tokens("x"), ["B&B De Oude Hoeve &amp; Spa", "x y"]) == [["oude"], []]
    assert values(spark, t.network_key("x"), ["Wandelnetwerk Bulskampveld", "WNW - De Bronbossen (2)", "uitbreiding fnw Waasland", "'t Hageland", "t Kanaal"]) == ["bulskampveld", "bronbossen", "waasland", "t-hageland", "kanaal"]
    assert values(spark, t.country_slug("x"), ["Belgium", "NL", "France", ""]) == ["belgie", "nederland", "france", None]
    assert values(spark, t.poi_type(F.lit(None), F.col("x")), ["Oude Molen", "Gentbrugse", "de brug", "", "Café X", "Wandelnetwerk y"]) == ["Gebouwen", "Locaties", "Gebouwen", None, "Gebouwen", "Wandelnetwerken"]
    assert values(spark, t.province_name(F.col("x"), F.col("y")), [("Limburg", "BE"), ("Limburg", "NL")], "x string, y string") == ["Limburg Vlaanderen", "Limburg"]


def test_entities_and_html(spark):
    assert values(spark, t.entities("x"), ["&amp;amp;lt; &#233;&#39; a", None]) == ["< é' a", ""]
    assert values(spark, t.strip_tags("x"), ["<p>a&nbsp;&AMP; <b>b</b></p>"]) == ["a & b"]
    assert values(spark, t.without_page_chrome("x"), ["<nav>x</nav>a<!-- y --><SCRIPT>1</SCRIPT>b", '<?php echo "<p>"; ?><div class="row"><section><h2>T</h2><i class="x icn-leaf">.</i><a class="btn big" href="/x">go</a><figure><a href="/p" data-glightbox="g"><img src="p"></a></figure><i>stays</i></section></div><form>f</form>']) == ["<nav>x</nav>ab", '<h2>T</h2><img src="p"><i>stays</i><form>f</form>']
    assert values(spark, t.linked("x"), ['see https://a.b/c <&"\n']) == ['see <a href="https://a.b/c">https://a.b/c</a> &lt;&amp;&quot;<br>']
    assert values(spark, t.truncate("x", 5), ["abcdef", "abc  fgh", "abcde", None]) == ["abcd…", "abc…", "abcde", None]
    assert values(spark, t.excerpt(F.col("x"), F.lit("<b>other</b> text"), most=8), ["", "<i> </i>", "short"]) == ["other t…", "other t…", "short"]
    assert values(spark, t.filename("x"), ["/a/b/Café  1.JPG?x=1", "plain"]) == ["cafe-1.jpg", "plain"]
    assert values(spark, t.repaired("x"), ["LiÃ¨ge", "Liège", "plain"]) == ["Liège", "Liège", "plain"]


def test_small_texts(spark):
    assert values(spark, t.filled(F.lit("Hi {name}, {what} {other}"), {"name": F.col("x"), "what": F.lit(5)}), ["Jo", None]) == ["Hi Jo, 5 {other}", "Hi , 5 {other}"]
    assert values(spark, t.display_name(F.col("x"), F.col("y"), F.col("z"), "Guest"), [("An", "peeters", "u"), (None, "P", "u"), ("", "", None)], "x string, y string, z string") == ["An P.", "u", "Guest"]
    assert values(spark, t.address(F.col("x"), F.lit("5"), F.lit(None), F.lit("Gent")), ["Street", ""]) == ["Street 5\nGent", "5\nGent"]
    assert values(spark, t.node_sequence("x"), ["12 - 7A > 30"]) == [["12", "7A", "30"]]
    assert values(spark, t.decimals("x"), ["1,5 - 2.25;3"]) == [[1.5, 2.25, 3.0]]
    assert values(spark, t.top_names("x"), ["a; b ;c", ""]) == ["a en b", None]
    assert values(spark, t.is_email("x"), ["a@b.c", "a@b", None]) == [True, False, False]
    assert values(spark, t.is_url("x"), ["https://a.b/c", "ftp://x", None, "http://"]) == [True, False, False, False]
    assert values(spark, t.is_phone("x"), ["+32 9 123 45 67", "abc"]) == [True, False]
    assert values(spark, t.password_kind("x"), ["$2y$10$" + "a" * 53, "a" * 32, "b" * 40, "", "secret"]) == ["bcrypt", "md5", "unknown", "unknown", "unknown"]
    assert [tuple(r) for r in values(spark, t.sorted_identity(F.col("x"), F.col("y")), [("jo", "a@b"), ("a@b", "jo")], "x string, y string")] == [("a@b", "jo"), ("a@b", "jo")]


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        old = row[:]
        for j, y in enumerate(b, 1):
            row[j] = old[j - 1] + 1 if x == y else max(old[j], row[j - 1])
    return row[-1]


def test_likeness(spark):
    pairs = [("koppenberg", "koppenherberg"), ("a", "b"), ("", "x"), ("same", "same"), ("abcabc", "bcbc"), ("ab", "ba")]
    found = values(spark, F.struct(t.edit_ratio(F.col("x"), F.col("y")), t.bigram_dice(F.col("x"), F.col("y")), t.subsequence_ratio(F.col("x"), F.col("y"))), pairs, "x string, y string")
    for (a, b), (edit, dice, sub) in zip(pairs, found):
        grams = lambda s: [s[i : i + 2] for i in range(len(s) - 1)]
        shared = sum(min(grams(a).count(g), grams(b).count(g)) for g in set(grams(a)))
        assert dice == pytest.approx(2 * shared / (len(a) + len(b) - 2) if min(len(a), len(b)) > 1 else float(a == b))
        assert sub == pytest.approx(2 * lcs(a, b) / (len(a) + len(b)) if a and b else 0)
        assert 0 <= edit <= 1
    names = spark.createDataFrame([(1, "Hotel Koppenberg", "B&B Koppenherberg"), (2, "De Zwaan", "Zwaan Gent"), (3, "", "x")], "i int, x string, y string")
    assert [r.similarity for r in t.with_similarity(names, "x", "y").orderBy("i").collect()] == [pytest.approx(20 / 23), 0.5, 0.0]


def test_dates(spark):
    d = lambda s: dt.date.fromisoformat(s)
    assert values(spark, dates.period_end("x", 12), [d("2024-02-29"), d("2024-01-31")], "x date") == [d("2025-02-27"), d("2025-01-30")]
    assert values(spark, dates.anniversary(F.col("x"), F.col("y")), [(d("2020-02-29"), d("2023-01-10")), (None, d("2023-01-10")), (d("2020-12-01"), d("2023-01-10")), (d("2020-01-01"), None)], "x date, y date") == [d("2023-02-28"), d("2023-01-10"), d("2022-12-01"), None]
    assert values(spark, dates.period_start("x"), ["Periode 19-07-2026 tot 18-07-2027", "none", None]) == [d("2026-07-19"), None, None]
    written = ["0000-00-00", "2020-05-06 10:00", "2020-00-01", "", "x", "2021-02-31", "1899-12-31", "2001-01-01"]
    assert values(spark, dates.cleaned("x", "2001-01-01"), written) == [None, "2020-05-06 10:00", None, None, None, "2021-02-31", None, None]
    assert values(spark, dates.cleaned_date("x"), written) == [None, d("2020-05-06"), None, None, None, None, None, d("2001-01-01")]
    assert values(spark, dates.duration_minutes("x"), ["1:30", "1,5 uur", "2u30", "20 min", "1 uur 5 min", "3", "90", "", "soon", "5 min 2H", "0u45", "2,5 min"]) == [90, 90, 150, 20, 65, 180, 90, None, None, 125, 45, 5]
    now = F.lit("2024-05-01 12:00:00").cast("timestamp")
    assert values(spark, dates.visited_on("x", now), ["2024-05-02", "2024-05-03", "2024-02-30", "x"]) == [d("2024-05-02"), None, None, None]
    assert values(spark, dates.fresh(F.col("x").cast("timestamp"), now), ["2024-04-30 12:00:00", "2024-04-30 11:59:59", None]) == [True, False, False]
    assert values(spark, dates.day_first("x"), [d("2024-05-01"), None], "x date") == ["01/05/2024", ""]


def test_money(spark):
    cases = [(100.0, 10.0, 21.0, False), (121.0, None, 21.0, True), (0.125, 0.0, 0.0, False), (19.99, 33.0, 6.0, False)]
    r2 = lambda x: math.floor(x * 100 + 0.5) / 100
    for (price, discount, vat, incl), m in zip(cases, values(spark, money.totals("x", "y", "z", F.col("w")), cases, "x double, y double, z double, w boolean")):
        net = price * (1 - (discount or 0) / 100)
        excl = r2(r2(net) / (1 + vat / 100)) if incl else r2(net)
        tax = r2(r2(net) - excl) if incl else r2(excl * vat / 100)
        assert tuple(m) == (excl, tax, r2(net) if incl else r2(excl + tax))
    assert values(spark, money.structured_reference("x"), [0, 97, 202611100220, 123], "x long") == ["+++000/0000/00097+++", "+++000/0000/09797+++", "+++261/1100/22094+++", "+++000/0000/12326+++"]
    today = F.lit("2026-11-10").cast("date")
    assert values(spark, money.next_number(F.col("x"), F.col("y"), today), [(None, None), (41, 50), (202601010220, 1), (None, 202601010005)], "x long, y long") == [1, 50, 202611100221, 202611100005]
    assert values(spark, money.euro("x"), [1234567.5, None, 0.0], "x double") == ["€ 1.234.567,50", "€ 0,00", "€ 0,00"]


PATHS = [[(51.0, 4.0), (51.0, 4.1), (51.1, 4.1)], [(50.0, 3.0), (50.0, 3.0)]]


def path_rows(paths):
    return [([{"lat": a, "lng": b} for a, b in p],) for p in paths]


def km(a, b):
    x = math.sin(math.radians(b[0] - a[0]) / 2) ** 2 + math.cos(math.radians(a[0])) * math.cos(math.radians(b[0])) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 6371 * 2 * math.atan2(math.sqrt(x), math.sqrt(1 - x))


def test_geometry(spark):
    found = values(spark, geo.path_km(F.col("x")), path_rows(PATHS), f"x {geo.PATH}")
    assert found == pytest.approx([sum(km(a, b) for a, b in zip(p, p[1:])) for p in PATHS])
    b = values(spark, geo.box(F.col("x")), path_rows(PATHS[:1]), f"x {geo.PATH}")[0]
    assert tuple(b) == (51.0, 4.0, 51.1, 4.1)
    runs = [([{"from": 0.0, "to": 0.25, "code": 1}, {"from": 0.25, "to": 1.0, "code": 0}],)]
    turned = values(spark, geo.reversed_runs(F.col("x")), runs, f"x {geo.RUNS}")[0]
    assert [tuple(r) for r in turned] == [(0.0, 0.75, 0), (0.75, 1.0, 1)]
    twice = values(spark, geo.reversed_runs(geo.reversed_runs(F.col("x"))), runs, f"x {geo.RUNS}")[0]
    assert [tuple(r) for r in twice] == [(0.0, 0.25, 1), (0.25, 1.0, 0)]
    assert values(spark, geo.paved_share(F.col("x")), runs, f"x {geo.RUNS}") == [25.0]
    raw = [([[0.0, 0.5, 1.0], [0.5, 0.5, 0.0], [0.5, 1.0, 7.0], [0.1]],)]
    assert [tuple(r) for r in values(spark, geo.parsed_runs(F.col("x")), raw, "x array<array<double>>")[0]] == [(0.0, 0.5, 1), (0.5, 1.0, -1)]
    assert values(spark, geo.valid_point("x", "y"), [("0", "0"), (None, "4"), ("51,2", "4"), ("x", "1"), (None, None)], "x string, y string") == [False, True, True, False, False]
    assert tuple(values(spark, geo.centroid(F.col("x")), path_rows([[(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0), (0.0, 0.0)]]), f"x {geo.PATH}")[0]) == (1.0, 1.0)


def test_geojson_lines(spark):
    texts = [
        '{"type":"LineString","coordinates":[[4,51],[4.1,51,7],["x",1],[4.2,"51,5"]]}',
        '{"type":"Feature","geometry":{"type":"MultiLineString","coordinates":[[[4,51],[4.1,51]],[[4.3,51],[4.1,51]],[]]}}',
        "not json", None, '{"type":"Point","coordinates":[1,2]}',
    ]
    found = values(spark, geo.joined(geo.lines_of("x")), texts)
    assert [[tuple(p) for p in x] for x in found] == [[(51.0, 4.0), (51.0, 4.1), (51.5, 4.2)], [(51.0, 4.0), (51.0, 4.1), (51.0, 4.1), (51.0, 4.3)], [], [], []]


def test_distance_to_segment(spark):
    found = values(spark, geo.to_segment(*[F.col(c) for c in "abcdef"]), [(51.0, 4.0, 51.0, 3.999, 51.0, 4.001), (51.001, 4.0, 51.0, 3.999, 51.0, 4.001), (51.0, 4.0, 51.0, 4.1, 51.0, 4.1)], ", ".join(f"{c} double" for c in "abcdef"))
    assert found[0].metres == pytest.approx(0, abs=1e-6)
    assert found[1].metres == pytest.approx(111.32, rel=1e-6)
    assert (found[0].east, found[0].north) == pytest.approx((1.0, 0.0))
    assert (found[2].east, found[2].north) == (0.0, 0.0)
