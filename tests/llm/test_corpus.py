"""Operators that compare documents with each other (6, 7, 9, 10) and quality (3)."""

from __future__ import annotations

import random

import numpy as np
import pytest
from tests.conftest import DATA, same_as_sql
from tests.llm import brute

from wayquarry.llm import common, decontaminate, lines, quality, queries_text, sharding, simhash
from wayquarry.llm.queries import ORACLE_SQL, QUERIES
from wayquarry.llm.queries_corpus import op6_lines, op9_simhash


@pytest.mark.parametrize("name", ["op3_quality", "quality_ablation", "op7_sharding", "op10_decontaminate"])
def test_sql(spark, oracle, name):
    same_as_sql(spark, QUERIES[name], ORACLE_SQL[name], oracle("sf0.01"), "sf0.01")


def small(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(str(DATA / "sf0.001/documents.parquet")).collect()}


def test_simhash_query(spark):
    fps = {k: brute.fingerprint(t) for k, t in small(spark).items()}
    root = brute.components(fps)
    found = op9_simhash(spark, str(DATA / "sf0.001")).collect()
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in found) == sorted((k, f"{v:016x}", root[k]) for k, v in fps.items())


@pytest.mark.parametrize("max_shard", [3, 4096])
def test_simhash_links(spark, max_shard):
    """Chains, stars and dense balls of fingerprints: the components are those of all pairs."""
    rng = random.Random(7)
    values = {0, (1 << 64) - 1, 1 << 63}
    for _ in range(12):
        centre = rng.getrandbits(64)
        values.add(centre)
        for _ in range(rng.randrange(1, 25)):
            at = rng.choice([centre, centre, rng.choice(sorted(values))])
            for _ in range(rng.randrange(0, 4)):
                at ^= 1 << rng.randrange(64)
            values.add(at)
    values = sorted(values)
    root = brute.components(dict(enumerate(values)))
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    fps = spark.createDataFrame([(v,) for v in signed], "fp long")
    roots = {r.node: r.root for r in simhash.connected(simhash.links(fps, max_shard)).collect()}
    groups, expected = {}, {}
    for i, v in enumerate(signed):
        groups.setdefault(roots.get(v, v), set()).add(i)
        expected.setdefault(root[i], set()).add(i)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


def test_bk_tree_finds_all():
    rng = random.Random(3)
    tree, values = simhash.BKTree(), []
    for _ in range(300):
        v = rng.getrandbits(64) if not values or rng.random() < 0.3 else rng.choice(values) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64))
        near = {values[i] for i in tree.within(v, 2)}
        assert near == {x for x in values if (x ^ v).bit_count() <= 2}
        if v not in values:
            values.append(v)
            tree.add(v)


def test_simhash_edges(spark):
    rows = [(3, None, "x"), (1, "", "y"), (None, "a b c d", "z"), (7, "a b c d", "z"), (7, "a b c d", "z"), (9, "w", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    found = sorted(((r.doc_id, r.component_id) for r in simhash.components(docs).collect()), key=repr)
    assert found == sorted([(3, 1), (1, 1), (None, 7), (7, 7), (7, 7), (9, 9)], key=repr)
    kept = sorted(((r.doc_id, r.fp) for r in simhash.keep_one(docs).collect()), key=repr)
    assert kept == sorted([(1, "y"), (None, "z"), (7, "z"), (9, None)], key=repr)
    assert simhash.components(docs.where("false")).count() == 0
    assert simhash.keep_one(docs.where("false")).count() == 0


def test_keep_one_judges_rows(spark):
    """Other texts under a kept or dropped key are judged by themselves."""
    a, b = "one text that stands here twice", "quite another text without any copy"
    case = lambda *rows: sorted((r.doc_id, r.text) for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id string, text string")).collect())
    assert case(("2", a), ("5", a), ("5", b)) == [("2", a), ("5", b)]
    assert case(("5", a), ("5", b)) == [("5", b), ("5", a)] or case(("5", a), ("5", b)) == [("5", a), ("5", b)]
    assert case(("5", b), ("5", b), ("7", a), ("9", b)) == [("5", b), ("7", a)]
    assert case(("5", a), ("5", a.upper())) in ([("5", a)], [("5", a.upper())])


def line_docs():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(40)]
    base = [[rng.choice(vocabulary) for _ in range(rng.randrange(2, 16))] for _ in range(30)]
    docs = []
    for key in range(60):
        own = []
        for _ in range(rng.randrange(0, 5)):
            w = list(rng.choice(base))
            kind = rng.randrange(5)
            if kind == 1:
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            elif kind == 2:
                del w[rng.randrange(len(w))]
            elif kind == 3:
                w.insert(rng.randrange(len(w) + 1), rng.choice(vocabulary))
            own.append(rng.choice([" ", "  ", "\t"]).join(x.upper() if rng.random() < 0.1 else x for x in w))
        docs.append((key, "\n".join(own) if own or key % 2 else None))
    return docs


def test_lines_against_all_pairs(spark):
    docs = line_docs()
    expected = brute.removed_lines(docs)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    found = {r.doc_id: r.removed for r in lines.report(df).collect()}
    assert {k: v for k, v in found.items() if v} == {k: v for k, v in expected.items() if v}
    texts = {r.doc_id: r.text for r in lines.dedup(df).collect()}
    for key, text in docs:
        left = None if text is None else "\n".join(x for i, x in enumerate(text.split("\n")) if i not in expected[key])
        assert texts[key] == left


def test_lines_query(spark):
    docs = small(spark)
    expected = brute.removed_lines(list(docs.items()))
    found = {r.doc_id: r.removed for r in op6_lines(spark, str(DATA / "sf0.001")).collect()}
    assert found == expected


def test_lines_edges(spark):
    line = "one two three four five six seven eight"
    rows = [(None, line, "p"), (1, line, "q"), (1, line, "q"), (2, "", None), (2, None, "r"), (3, "one two\n" * 3, "s"), (4, line.replace("four", "FOUR") + " nine", "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, line string")
    found = sorted(((r.doc_id, r.text, r.line) for r in lines.dedup(docs).collect()), key=repr)
    assert found == sorted([(None, line, "p"), (1, "", "q"), (1, "", "q"), (2, "", None), (2, None, "r"), (3, "one two\n", "s"), (4, "", "t")], key=repr)
    assert lines.dedup(docs.where("false")).count() == 0
    assert lines.report(docs.where("false")).count() == 0


def test_lines_without_key(spark):
    """Rows without a key are documents of their own; those of one text keep the same lines."""
    rows = [(None, f"line number {i} of this corpus stands here for the first time {i * i}\nshared line of them all, with some words") for i in range(60)] + [(None, "x\ny\nx")] * 2
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    found = [r.text for r in lines.dedup(docs).collect()]
    assert len(found) == len(rows)
    assert sum("shared line" in x for x in found) == 1
    assert found.count("x\ny") == 2


def test_short_lines(spark):
    rows = [(1, "Page 1\nPage 2\nYes\nyes\nContents of this page\nContents of that page"), (2, "contents of thin page\nPage  1\n東京の天気は今日とても良いですねはい\n東京の天気は今日とても良いですね、はい")]
    found = {r.doc_id: r.text for r in lines.dedup(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    assert found == {1: "Page 1\nPage 2\nYes\nContents of this page\nContents of that page", 2: "東京の天気は今日とても良いですねはい"}


def test_deletions_are_those_of_the_rests():
    rng = random.Random(1)
    for symbols in (["a", "b", "a", "c"], [rng.choice("xyz") for _ in range(50)]):
        for own, cut in ((("".join(symbols)), lambda s, i: s[:i] + s[i + 1 :]), ([s.encode() for s in symbols], lambda s, i: s[:i] + s[i + 1 :])):
            rests, _ = lines.deletions(own)
            assert rests.tolist() == [lines.deletions(cut(own, i))[1] for i in range(len(own))]


def test_sharding_edges(spark):
    rows = [(i % 50, "x" * (i % 700), i) for i in range(1000)] + [(None, None, 1), (None, "y" * 5000, 2), (7, "big" * 5000, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, depth int")
    found = sharding.assign(docs, limit=20_000).collect()
    assert len(found) == len(rows)
    held, keys = {}, {}
    for r in found:
        held[r.shard] = held.get(r.shard, 0) + r.n_bytes
        keys.setdefault(r.shard.split("p")[0], set()).add(r.doc_id)
    for shard, size in held.items():
        assert size <= 20_000 or "p" in shard or len(keys[shard]) == 1
    names = sorted({s.split("p")[0] for s in held})
    assert not any(b.startswith(a) for a, b in zip(names, names[1:]))  # no bucket lies within another
    assert sharding.assign(docs.where("false")).count() == 0


def test_sharding_splits_only_large_buckets(spark):
    docs = spark.createDataFrame([(i, "x" * 100) for i in range(500)], "doc_id long, text string")
    found = sharding.assign(docs, limit=3000).collect()
    sizes = {r.shard: r.bucket_bytes for r in found}
    for shard in sizes:
        if shard:
            parent = sum(100 for r in found if r.shard.startswith(shard[:-1]))
            assert sizes[shard] <= 3000 < parent


def test_sharding_write(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text {i}", "a") for i in range(200)], "doc_id long, text string, lang string")
    sharding.write(docs, f"file://{tmp_path}/s", limit=400)
    back = spark.read.parquet(f"file://{tmp_path}/s")
    assert sorted((r.doc_id, r.text) for r in back.collect()) == sorted((i, f"text {i}") for i in range(200))


def test_sharding_write_names(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a", "mine")], "doc_id long, text string, Shard string")
    with pytest.raises(ValueError):
        sharding.write(docs, f"file://{tmp_path}/s")
    sharding.write(docs, f"file://{tmp_path}/s", column="bucket")
    assert [tuple(r) for r in spark.read.parquet(f"file://{tmp_path}/s").collect()] == [(1, "a", "mine", "all")]


def test_sharding_pages_fit(spark):
    """One key with many texts: every page fits, unless it holds one text, and reports its own bytes and rows."""
    rows = [(1, f"{i} " + "x" * (i % 90)) for i in range(900)] + [(1, "long" * 800)] * 2 + [(2, "same" * 300)] * 3 + [(i, "y" * 50) for i in range(3, 200)]
    found = sharding.assign(spark.createDataFrame(rows, "doc_id long, text string"), limit=2000, hashes=True).collect()
    assert len(found) == len(rows)
    shards = {}
    for r in found:
        shards.setdefault(r.shard, []).append(r)
    assert sum("p" in s for s in shards) > 20
    for own in shards.values():
        size = sum(r.n_bytes for r in own)
        assert size <= 2000 or len({(r.h, r.t) for r in own}) == 1
        assert {(r.bucket_bytes, r.bucket_rows) for r in own} == {(size, len(own))}
    names = sorted(shards)
    assert not any(b.startswith(a) for a, b in zip(names, names[1:]))


def test_quality_edges(spark):
    rows = [(1, None, 0), (None, "", 1), (2, "word " * 9, 2), (2, "word " * 9, 2), (3, "one two three four five six seven eight nine ten", 3), (4, "#" * 100_000, 4), (5, "héllo\x0b wörld\n" * 5, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words int")
    found = sorted(((r.doc_id, r.n_words, r.fail_bits) for r in quality.ledger(docs).collect()), key=repr)
    assert [x[1] for x in found if x[0] == 2] == [9, 9]
    assert sorted(x[0] for x in found if x[0] is not None and not x[2] & 3) == [3]
    assert [(r.doc_id, r.n_words) for r in quality.keep(docs, quality.V2).collect()] == [(3, 3)]
    assert quality.ledger(docs.where("false")).count() == 0
    assert quality.ablation(quality.ledger(docs.where("false"))).count() == 0


def test_quality_ablation(spark):
    docs = spark.read.parquet(str(DATA / "sf0.01/documents.parquet"))
    ledger = quality.ledger(docs)
    bits = [r.fail_bits for r in ledger.collect()]
    for r in quality.ablation(ledger).collect():
        policy = next(p for p in quality.POLICIES if p.version == r.version)
        rule = next(x for x in quality.RULES if x.name == r.rule)
        assert r.n_docs == len(bits)
        assert r.n_failed == sum(b & rule.mask != 0 for b in bits)
        assert r.n_failed_only_here == sum(b & policy.mask == rule.mask for b in bits)
        assert r.n_rejected == sum(b & policy.mask != 0 for b in bits)


def test_quality_ablation_takes_long_texts_in_small_batches(spark, tmp_path, monkeypatch):
    """A worker sees a few megabytes at once, however long the texts are."""
    sizes, was = str(tmp_path / "sizes"), spark.conf.get(common.BATCH_BYTES, None)
    spark.range(200).selectExpr("id AS doc_id", "repeat(concat('word', id, ' '), 20000) AS text").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))

    def noted(own, at, out):
        def run(batches):
            for batch in batches:
                with open(f"{sizes}-{batch.column(0)[0].as_py()}", "w") as f:
                    f.write(str(batch.num_rows))
                yield batch

        return measured(own.mapInArrow(run, own.schema), at, out)

    measured = quality._measured
    monkeypatch.setattr(quality, "_measured", noted)
    found = queries_text.quality_ablation(spark, str(tmp_path)).collect()
    assert {r.n_docs for r in found} == {200}
    rows = [int(f.read_text()) for f in tmp_path.glob("sizes-*")]
    assert sum(rows) == 200 and max(rows) * 140_000 < 2 * common.PIECE_BYTES
    assert spark.conf.get(common.BATCH_BYTES, None) == was


def bench_case():
    rng = random.Random(11)
    vocabulary = [f"v{i}" for i in range(30)] + ["É", "x1", "東京"]
    make = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(str(i), " ".join(make(n))) for i, n in enumerate([0, 1, 3, 9, 10, 11, 25, 40, 40])] + [("8", "other words for the same item " * 3)]
    docs = []
    for k in range(80):
        w = make(rng.randrange(0, 60))
        if k % 3 == 0:
            x = brute.bench_words(rng.choice(items)[1])
            a = rng.randrange(len(x) + 1)
            at = rng.randrange(len(w) + 1)
            w[at:at] = x[a : a + rng.randrange(1, 20)]
        docs.append((k, rng.choice([" ", ", ", "-"]).join(x.upper() if rng.random() < 0.2 else x for x in w)))
    return items, docs


@pytest.mark.parametrize("most", [10, 1_000_000])
def test_decontaminate_against_brute_force(spark, most):
    items, docs = bench_case()
    b = spark.createDataFrame(items, "item_id string, text string")
    d = spark.createDataFrame(docs, "doc_id long, text string")
    found = {r.doc_id: r for r in decontaminate.find(d, b, most=most).collect()}
    for key, text in docs:
        n, hit, names = brute.decontaminated(text, items)
        r = found[key]
        assert (r.n_words, r.n_hit, r.item_ids) == (n, len(hit), sorted(names))
        covered = {i for s in r.spans for i in range(s.start, s.end)}
        assert covered == hit


def test_decontaminate_removes_only_hits(spark):
    items, docs = bench_case()
    b = spark.createDataFrame(items, "item_id string, text string")
    d = spark.createDataFrame(docs, "doc_id long, text string")
    texts = {r.doc_id: r.text for r in decontaminate.remove(d, b).collect()}
    for key, text in docs:
        _, hit, _ = brute.decontaminated(text, items)
        assert brute.bench_words(texts[key]) == [w for i, w in enumerate(brute.bench_words(text)) if i not in hit]
        if not hit:
            assert texts[key] == text


def test_decontaminate_edges(spark):
    b = spark.createDataFrame([(1, None), (None, "a b c"), (2, "short item"), (2, "other item")], "item_id long, text string")
    d = spark.createDataFrame([(None, "short item here", 1), (1, None, 2), (1, "", 3), (2, "other item", 4), (2, "other item", 4)], "doc_id long, text string, spans int")
    found = sorted(((r.doc_id, r.n_words, r.n_hit, r.item_ids) for r in decontaminate.find(d, b).collect()), key=repr)
    assert found == sorted([(None, 3, 2, ["2"]), (1, 0, 0, []), (1, 0, 0, []), (2, 2, 2, ["2"]), (2, 2, 2, ["2"])], key=repr)
    assert decontaminate.find(d, b.where("false")).where("n_hit > 0").count() == 0
    assert decontaminate.find(d.where("false"), b).count() == 0
    assert sorted(str(r.text) for r in decontaminate.remove(d, b).collect()) == sorted([" here", "None", "", "", ""])


def test_decontaminate_null_item(spark):
    b = spark.createDataFrame([(None, "planted without id"), (1, "known item")], "item_id long, text string")
    d = spark.createDataFrame([(1, "here planted without id stands"), (2, "a known item planted without id"), (3, "clean")], "doc_id long, text string")
    found = sorted((r.doc_id, r.n_hit, r.item_ids) for r in decontaminate.find(d, b).collect())
    assert found == [(1, 3, []), (2, 5, ["1"]), (3, 0, [])]
    assert sorted(r.text for r in decontaminate.remove(d, b).collect()) == ["a ", "clean", "here stands"]
    # one pass for each item
    many = sorted((r.doc_id, r.item_ids, r.unnamed) for r in decontaminate.find(d, b, most=1).collect())
    assert many == [(1, [], True), (2, ["1"], True), (3, [], False)]


def test_null_items_count_as_in_sql(spark, tmp_path):
    """An item without an id is one item more, and has no part in the digest."""
    import duckdb

    from wayquarry.llm.queries_text import OP10_SQL, op10_decontaminate

    b = spark.createDataFrame([(None, "planted without id"), (None, "another without id"), (1, "known item"), (None, None)], "item_id long, text string")
    d = spark.createDataFrame([(1, "here planted without id stands another without id"), (2, "a known item planted without id"), (3, "clean"), (4, None)], "doc_id long, text string")
    b.write.parquet(str(tmp_path / "benchmark.parquet"))
    d.write.parquet(str(tmp_path / "documents.parquet"))
    db = duckdb.connect()
    for name in ("benchmark", "documents"):
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    found = db.execute(OP10_SQL)
    names = [c[0] for c in found.description]
    assert sorted(op10_decontaminate(spark, str(tmp_path)).select(names).collect()) == sorted(found.fetchall())


def test_suffix_array_and_wavelet():
    rng = np.random.default_rng(2)
    for n in (1, 2, 50, 400):
        text = np.append(rng.integers(0, 4, n), 0)
        order = decontaminate.suffix_array(text)
        assert order.tolist() == sorted(range(len(text)), key=lambda i: text[i:].tolist())
        tree = decontaminate.WaveletMatrix(text, 3)
        assert tree.access(np.arange(len(text))).tolist() == text.tolist()
        symbols, places = rng.integers(0, 4, 50), rng.integers(0, len(text) + 1, 50)
        assert tree.rank(symbols, places).tolist() == [int((text[:p] == s).sum()) for s, p in zip(symbols, places)]
