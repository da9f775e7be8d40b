"""Chat formatting (11), vector codes (12) and fill-in-the-middle (13)."""

from __future__ import annotations

import hashlib
import itertools
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tests.conftest import same_as_sql

from wayquarry.llm import chat, codes, middle
from wayquarry.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", ["op11_chat", "op12_codes", "op13_middle"])
@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_sql(spark, oracle, name, sf):
    same_as_sql(spark, QUERIES[name], ORACLE_SQL[name], oracle(sf), sf)


ODD = ["", " ", "\\", "\\\\", "\\<s>", "<\\s>", "<s>", "</s>", "< /s>", "[INST] a [/INST]", " [/INST]", "[/INST", "<<SYS>>\n\n<</SYS>>\n\n", "</s></s>\n", "a\n<", "$0 $1", "\r\n \u0085", "😀<s>é", "[ROLE] x [TEXT] y [/ROLE]\n", " [TEXT] ", "x" * 300_000]


def conversations(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def read_back(df):
    found = df.select("conv_id", "state", "refused_turn", "complete", chat.formatted(F.col("segments")).alias("whole"), chat.learned(F.col("segments")).alias("learned"))
    return {r.conv_id: r for r in found.withColumn("turns", chat.turns_of(F.col("whole"))).collect()}


def test_any_text_comes_back(spark):
    rows, k = [], 0
    for a, b in itertools.product(ODD, repeat=2):
        rows += [(k, 0, "user", a), (k, 1, "assistant", b), (k, 2, "tool <s>", b), (k, 3, "system", a)]
        k += 1
    found = read_back(chat.format_conversations(conversations(spark, rows)))
    assert len(found) == k
    for key in range(k):
        own = rows[4 * key : 4 * key + 4]
        assert [(t.role, t.text) for t in found[key].turns] == [(r, t) for _, _, r, t in own]
        assert found[key].learned == own[1][3]
        assert (found[key].state, found[key].refused_turn) == ("refused", 2)
        # no mark stands anywhere but where the template puts it
        assert found[key].whole.count("</s>") == 1 and found[key].whole.count("[INST]") == 1


@pytest.mark.parametrize("roles,state,refused,complete", [("", None, None, None), ("u", "user", None, False), ("ua", "assistant", None, True), ("sua", "assistant", None, True), ("s", "system", None, False), ("a", "refused", 0, False), ("uu", "refused", 1, False), ("uas", "refused", 2, False), ("uauaua", "assistant", None, True), ("ssua", "refused", 1, False), ("x", "refused", 0, False)])
def test_order_of_roles(spark, roles, state, refused, complete):
    names = {"u": "user", "a": "assistant", "s": "system", "x": "narrator"}
    rows = [(1, k, names[r], f"t{k}") for k, r in enumerate(roles)]
    random.Random(1).shuffle(rows)
    found = read_back(chat.format_conversations(conversations(spark, rows)))
    assert bool(found) == bool(roles)
    for r in found.values():
        assert (r.state, r.refused_turn, r.complete) == (state, refused, complete)
        assert [t.text for t in r.turns] == [f"t{k}" for k in range(len(roles))]


def test_chat_edges(spark):
    rows = [(None, 1, "user", "n"), (None, None, "assistant", None), (2, 0, None, None), (2, 0, "user", "b"), (2, 0, "user", "a"), (2, 0, "user", "a")]
    df = conversations(spark, rows).withColumn("segments", F.lit(3)).withColumn("_key", F.lit("x"))
    found = read_back(chat.format_conversations(df))
    assert [(t.role, t.text) for t in found[None].turns] == [("assistant", ""), ("user", "n")]
    assert [(t.role, t.text) for t in found[2].turns] == [("", ""), ("user", "a"), ("user", "a"), ("user", "b")]


def test_templates_that_cannot_be_read_back_are_refused():
    good = dict(turns={"user": chat.Turn("<u>", "</u>")}, controls=("<u>", "</u>", "<o>", "<t>", "<e>"), other=("<o>", "<t>", "<e>"), start="s", moves={})
    chat.Template(**good)
    for change in (
        {"controls": ("<u>", "</u>", "<o>", "<t>", "<e>", "x")},
        {"controls": ("<u>", "</u>", "<o>", "<t>", "<e>", "a\\b")},
        {"controls": ("<u>", "</u>", "<o>", "<t>", "<e>", "aba")},
        {"turns": {"user": chat.Turn("u:", "</u>")}},
        {"turns": {"user": chat.Turn("<u>", "\n")}},
        {"turns": {"user": chat.Turn("<u>", "</u>"), "guest": chat.Turn("<u> ", "</u>")}},
    ):
        with pytest.raises(ValueError):
            chat.Template(**(good | change))


def test_chat_is_native(spark):
    plan = QUERIES["op11_chat"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# ---- vector codes


def plain_nearest(x, entries):
    d = ((x[:, None].astype(object) - entries[None].astype(object)) ** 2).sum(axis=2)
    index = np.array([min(range(len(entries)), key=lambda e: (row[e], e)) for row in d])
    return index, np.array([row[i] for row, i in zip(d, index)])


@pytest.mark.parametrize("size", [1, 2, 3, 4, 6, 8, 16])
@pytest.mark.parametrize("spread", [2, 300, 1 << 24])
def test_bounds_lose_nothing(size, spread):
    rng = np.random.default_rng(size * spread)
    entries = rng.integers(-spread, spread, (50, size))
    entries[10] = entries[3]
    x = np.concatenate([rng.integers(-spread, spread, (300, size)), entries, np.repeat(entries[:5], 4, axis=0)])
    index, distance, _ = codes.nearest(x, entries)
    expected = plain_nearest(x, entries)
    assert (index == expected[0]).all() and (distance == expected[1]).all()


def test_bounds_filter():
    rng = np.random.default_rng(1)
    entries = np.repeat(rng.integers(-200, 200, (64, 4)), 4, axis=1) + rng.integers(-40, 40, (64, 16))
    x = entries[rng.integers(0, 64, 2000)] + rng.integers(-30, 30, (2000, 16))
    assert codes.nearest(x, entries)[2] < 2000 * 64 * 0.1
    # four independent components, as the parts of the given vectors: the hardest case
    x, entries = rng.integers(-40, 40, (2000, 4)), rng.integers(-40, 40, (64, 4))
    assert codes.nearest(x, entries)[2] < 2000 * 64 * 0.4


def test_nearest_without_rows():
    index, distance, n = codes.nearest(np.zeros((0, 4), np.int64), np.ones((3, 4), np.int64))
    assert len(index) == len(distance) == n == 0


def brute_codes(rows, parts, entries, rounds):
    kept = sorted(((k, [int(np.floor(256 * np.float64(v))) for v in x], label) for k, x, label in rows if x is not None and all(v is not None and np.isfinite(v) for v in x)), key=lambda r: (r[0] is None, r[0], r[1]))
    if not kept:
        return [], hashlib.sha256(b"").hexdigest()
    size = len(kept[0][1]) // parts
    cut = lambda q: [q[p * size : p * size + size] for p in range(parts)]
    books = [[cut(q)[p] for _, q, _ in kept[:entries]] for p in range(parts)]
    best = lambda v, p: min((sum((a - b) ** 2 for a, b in zip(v, e)), i) for i, e in enumerate(books[p]))
    for _ in range(rounds):
        new = [[list(e) for e in b] for b in books]
        for p in range(parts):
            own = {}
            for _, q, _ in kept:
                own.setdefault(best(cut(q)[p], p)[1], []).append(cut(q)[p])
            for e, vs in own.items():
                new[p][e] = [sum(c) // len(vs) for c in zip(*vs)]
        books = new
    found = [(k, label, [best(v, p) for p, v in enumerate(cut(q))]) for k, q, label in kept]
    of_label = {}
    for _, label, b in found:
        of_label[label] = of_label.get(label, 0) + sum(d for d, _ in b)
    out = [(k, "".join(f"{i:02x}" for _, i in b), sum(d for d, _ in b), of_label[label]) for k, label, b in found]
    return sorted(out, key=repr), hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()


@pytest.mark.parametrize("n", [0, 1, 40, 300])
def test_codes_against_brute_force(spark, n):
    rng = random.Random(n)
    base = [[rng.uniform(-1, 1) for _ in range(32)] for _ in range(n)]
    rows = [(k if k % 17 else None, base[k if rng.random() < 0.7 else 0], rng.choice([None, 1, 1, 2])) for k in range(n)]
    rows += [(900, None, 1), (901, [None] + [0.0] * 31, 1), (902, [float("nan")] * 32, 1), (903, [float("-inf")] + [1.0] * 31, None)]
    rows += rows[5:8] if n > 10 else []
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("error", F.lit("x")).withColumn("Q", F.lit(1))
    as_float = [(k, None if x is None else [None if v is None else float(np.float32(v)) for v in x], label) for k, x, label in rows]
    found, books = codes.compressed(df)
    expected, digest = brute_codes(as_float, codes.PARTS, codes.ENTRIES, codes.ROUNDS)
    assert sorted([(r.vec_id, r.code, r.error, r.label_error) for r in found.collect()], key=repr) == expected
    assert books.sha256 == digest


def test_decoded_vectors_have_the_stated_error(spark):
    rng = np.random.default_rng(4)
    rows = [(k, [float(v) for v in rng.normal(size=32)], 0) for k in range(200)]
    kept = codes.prepared(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    books = codes.fit(kept, entries=20)
    q = {r.key: r.q for r in kept.collect()}
    for r in codes.encode(kept, books).collect():
        assert sum((a - b) ** 2 for a, b in zip(books.decode(r.code), q[r.key])) == r.error


@pytest.mark.parametrize("vectors", [[[1.0] * 16, [1.0] * 32], [[1.0] * 17], [[]], [[1e30] + [0.0] * 15]])
def test_vectors_that_cannot_be_coded(spark, vectors):
    df = spark.createDataFrame([(k, x, 1) for k, x in enumerate(vectors)], "vec_id long, embedding array<double>, label int")
    with pytest.raises(Exception, match="must"):
        codes.compressed(df)[0].collect()


# ---- fill-in-the-middle


def plain_middle(key, text):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(f"7:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, _, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    n = len(units)
    if not text or re.search("<[PSM]>", text):
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < 50:
        return n, "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return n, "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.none(), st.integers(-5, 10**12)), st.text(alphabet=st.sampled_from("a\n\r 😀é<P>SM"), max_size=40))
def test_arranged(key, text):
    assert middle.arranged(key, text, middle.Format(), re.compile(middle.LINES)) == plain_middle(key, text)


def test_middle_edges(spark):
    texts = [None, "", "\n", "\n\n\n", "a", "a\n", "a\nb", "<P>", "<P <S", "<", "x<M>y", "line\n" * 50_000, "a" * 3_000_000, "é😀\n" * 7, "a\r\nb\r\nc"]
    rows = [(k, t, "z") for k, t in enumerate(texts)] + [(None, "a\nb\nc\nd", "y"), (4, "a", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, output string")
    found = middle.transform(docs).withColumn("back", middle.restored(F.col("output"), F.col("form"))).collect()
    assert len(found) == len(rows)
    got = sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.back) for r in found), key=repr)
    assert got == sorted(((k, *plain_middle(k, t), t or "") for k, t, _ in rows), key=repr)
    assert middle.transform(docs.where("false")).count() == 0


def test_rate_and_other_units(spark):
    docs = spark.createDataFrame([(k, "one two  three four ") for k in range(200)], "doc_id long, text string")
    form = middle.Format(prefix="[pre]", suffix="[suf]", middle="[mid]", rate=40, units=r"\S+\s*")
    found = middle.transform(docs, form).withColumn("back", middle.restored(F.col("output"), F.col("form"), form)).collect()
    assert all(r.back == "one two  three four " and r.n == 4 for r in found)
    assert 40 < sum(r.form != "plain" for r in found) < 120
    with pytest.raises(ValueError):
        middle.Format(prefix="<a>", suffix="<a>", middle="<b>")


def test_no_unit_is_stored():
    """A million units cost no more memory than one."""
    import tracemalloc

    units, text = re.compile(middle.LINES), "ab\n" * 1_000_000
    tracemalloc.start()
    n = middle.count_units(units, text)
    assert middle.cuts(units, text, n // 3, n // 2) == (3 * (n // 3), 3 * (n // 2))
    assert tracemalloc.get_traced_memory()[1] < 100_000
    tracemalloc.stop()
