"""BPE (1) and token files (2) against the tokenizers library."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tests.conftest import DATA
from tokenizers import Tokenizer

from wayquarry.llm import bpe, tokenfile
from wayquarry.llm.queries_text import op1_bpe, op2_tokenfile

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    "", " ", "\n", "a", "  a  b\n\n\tc ", "don't we'll I'M 'S 's", "x" * 5000, "ab " * 3000, "<|endoftext|>", "a<|endoftext|>  b <|endoftext|>", "<|endoftext", "  x　 y\u0085z\x1c\x1d q",
    "größe 東京 مرحبا 😀👩‍👩‍👧 ́e", "1234567890 12,345.67 ½²", "!!!??...;;; --- ___", "\r\n\r\n a\r b", "\x00\x01\x7f", " \n \n ", "naïve café", "a\x0bb\x0cc", "    x ", "﻿abc​def",
]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def expected_ids(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def splitter():
    return bpe._vocabulary(bpe.read_vocabulary(PATH))


@pytest.mark.parametrize("text", ODD)
def test_odd_texts(library, splitter, text):
    vocabulary, split = splitter
    ids = np.frombuffer(split.ids(text), np.int32)
    assert ids.tolist() == expected_ids(library, text)
    assert vocabulary.decode(ids) == library.decode(ids.tolist(), skip_special_tokens=False)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t'sadl.!19éß東  \u0085\x1c<|>"), st.characters(codec="utf-8")), max_size=60))
def test_any_text(text):
    library = Tokenizer.from_file(PATH) if not hasattr(test_any_text, "t") else test_any_text.t
    test_any_text.t = library
    _, split = bpe._vocabulary(bpe.read_vocabulary(PATH))
    assert np.frombuffer(split.ids(text), np.int32).tolist() == expected_ids(library, text)


def test_cache_is_bounded():
    pieces = bpe.Pieces(lambda x: x.encode(), 100)
    for i in range(1000):
        assert pieces[str(i)] == str(i).encode()
        assert len(pieces) <= 100


def test_words_after_a_space_are_computed_once():
    computed = []
    split = bpe.Splitter(lambda x: computed.append(x) or x.encode(), {}, 100)
    words = ["w" + "".join(chr(97 + int(d)) for d in str(i)) for i in range(150)]
    for _ in range(2):
        assert split.ids("x " + " ".join(words)) == ("x " + " ".join(words)).encode()
    split.ids("x " + " ".join(w + "," for w in words[:40]))
    assert sorted(computed) == sorted(["x", "\n", ",", *(" " + w for w in words)])
    assert len(split.fine) + len(split.bare) + len(split.spaced) <= 300


def test_query_matches_library(spark, library):
    docs = {r.doc_id: r.text for r in spark.read.parquet(str(DATA / "sf0.001/documents.parquet")).collect()}
    found = op1_bpe(spark, str(DATA / "sf0.001")).collect()
    assert len(found) == len(docs)
    for r in found:
        ids = expected_ids(library, docs[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_bpe_edges(spark):
    rows = [(1, None, "a"), (None, "hello", "b"), (2, "", None), (2, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, Decoded string")
    back = bpe.decode(bpe.encode(docs, PATH), PATH)
    assert sorted((str(r.doc_id), r.decoded, len(r.ids)) for r in back.collect()) == [("1", "", 0), ("2", "", 0), ("2", "", 0), ("None", "hello", 1)]
    at_once = bpe.encode(docs, PATH, decoded="decoded")
    assert sorted(map(str, at_once.select("doc_id", "text", "ids", "decoded").collect())) == sorted(map(str, back.select("doc_id", "text", "ids", "decoded").collect()))
    assert bpe.decode(bpe.encode(docs.where("false"), PATH), PATH).count() == 0
    nothing = spark.createDataFrame([(None,), ([],)], "ids array<int>")
    assert [r.decoded for r in bpe.decode(nothing, PATH).collect()] == ["", ""]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 10_000), min_size=1, max_size=700))
def test_elias_fano(steps):
    values = np.cumsum(steps)
    found, end = tokenfile.EliasFano.read(memoryview(data := tokenfile.EliasFano.of(values).tobytes()), 0)
    assert end == len(data)
    assert found.select(np.arange(len(values))).tolist() == values.tolist()


def test_elias_fano_is_small():
    values = np.cumsum(np.random.default_rng(1).integers(100, 1000, 10_000))
    assert len(tokenfile.EliasFano.of(values).tobytes()) < 1.6 * len(values)


def expected_file(library, docs):
    start, out = 0, []
    for doc_id, text in sorted(docs, key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or "")):
        ids = [*expected_ids(library, text), 2]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def ordered(rows):
    return sorted(map(tuple, rows), key=lambda x: x[1])


def test_token_files(spark, library):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(str(DATA / "sf0.001/documents.parquet")).collect()]
    assert ordered(op2_tokenfile(spark, str(DATA / "sf0.001")).collect()) == expected_file(library, docs)


def test_token_file_edges(spark, library, tmp_path):
    rows = [(5, "b", 1), (5, "a", 2), (None, "x", 3), (None, None, 4), (7, None, 5), (-3, "<|endoftext|> word " * 50, 6), (2**62, "big", 7), (7, None, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start int")
    tokenfile.write(docs, f"file://{tmp_path}/t", PATH, block_ids=20)
    assert ordered(tokenfile.read(spark, f"file://{tmp_path}/t").collect()) == expected_file(library, [r[:2] for r in rows])
    tokenfile.write(docs.where("false"), f"file://{tmp_path}/e", PATH)
    assert tokenfile.read(spark, f"file://{tmp_path}/e").count() == 0


def test_a_hot_key_is_shared(spark, library, tmp_path):
    """Rows of one doc_id, of different texts or all equal, come out as several parts, in order and complete."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else so few bytes make one part
    for name, text in (("different", "text {} of one key"), ("equal", "one text")):
        rows = [(3, text.format(k)) for k in range(3000)] + [(1, "first"), (9, "last")]
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
        tokenfile.write(docs, f"file://{tmp_path}/{name}", PATH)
        found = ordered(tokenfile.read(spark, f"file://{tmp_path}/{name}").collect())
        assert found == expected_file(library, rows)
        parts = spark.read.parquet(f"file://{tmp_path}/{name}").groupBy("part").sum("n_ids").collect()
        assert len(parts) > 2
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
