"""The pipeline (corpus_pipeline.py) against plain versions of its stages, and the driver's contract."""

from __future__ import annotations

import hashlib

import corpus_pipeline
import public_tokenizers
import pytest
from tests.conftest import DATA
from tests.llm import brute
from tokenizers import Tokenizer

from wayquarry.llm.common import stored
from wayquarry.llm.queries import QUERIES


def plain_pipeline(docs: dict, items: list) -> dict:
    """key -> text after the first four stages."""
    kept = {k: t for k, t in docs.items() if not brute.rejected(t)}
    removed = brute.removed_lines(list(kept.items()))
    kept = {k: "\n".join(x for i, x in enumerate(t.split("\n")) if i not in removed[k]) if t is not None else None for k, t in kept.items()}
    root = brute.components({k: brute.fingerprint(t) for k, t in kept.items()})
    return {k: brute.without_hits(t, brute.decontaminated(t, items)[1]) for k, t in kept.items() if root[k] == k}


def test_pipeline_against_plain_version(spark):
    sf = str(DATA / "sf0.001")
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    expected = plain_pipeline(docs, items)
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    found = {r.doc_id: r for r in corpus_pipeline.run(spark, sf).collect()}
    assert set(found) == set(expected)
    for key, text in expected.items():
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert list(found[key].ids) == ids
        assert found[key].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert found[key].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()


def test_stages_keep_the_columns(spark):
    sf = str(DATA / "sf0.001")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names, n = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, sf), "test-stage")
        assert docs.columns == names, name
        assert docs.where("n_chars <> length(text)").count() == 0
        assert 0 < docs.count() <= n
        n = docs.count()


@pytest.mark.parametrize("schema", ["doc_id long, text string, lang string, source string, n_chars long, row string, key string, h string"])
def test_stages_on_odd_rows(spark, schema):
    line = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(None, line + " a", None, None, None, "r", "k", "h"), (1, None, "en", "s", 0, None, None, None), (2, "", "en", "s", 0, "r", "k", "h"), (3, line + " b", "en", None, 3, "r", "k", "h"), (3, line + " b", "en", None, 3, "r", "k", "h"), (4, f"{line}\n" * 2 + "x " * 3000, "de", "s", 1, "r", "k", "h")]
    docs = spark.createDataFrame(rows, schema)
    for part in (docs, docs.where("false")):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            part = stored(stage(spark, part, str(DATA / "sf0.001")), "odd-stage")
            assert part.columns == docs.columns, name


def test_contract():
    import __spark_entry__ as e

    names = e.queries()
    assert [n for n in range(1, 11) if not any(q.startswith(f"op{n}_") for q in names)] == []
    assert "pipeline" in names
    assert set(e.oracle_sql()) <= set(names)
    assert set(QUERIES) <= set(names)
