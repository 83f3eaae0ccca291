import hashlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from sparloom.llm import pieces, queries

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIB = sentencepiece.SentencePieceProcessor(model_file=PATH)
MODEL = pieces.PieceModel(PATH)
PIECES = [LIB.id_to_piece(i) for i in range(259, LIB.get_piece_size())]
ODD = ["", " ", "  ", "\n", "a", "a  b", " a b ", "a\n\n b", "<s> x </s>", "▁▁ a", "a▁b", "\ta b　", "日本語 テキスト 😀", "a\r\nb", "é" * 500, "ab" * 900, "\x00a \x00", "x " * 3000, " " * 77, "a" * 3001, "\n a", " \n\n  \n x"]


def _ids(text):
    return np.frombuffer(MODEL.encode_many([text])[0], "<i4").tolist()


@pytest.mark.parametrize("text", ODD)
def test_odd_texts_equal_the_library(text):
    want = LIB.encode(text)
    assert _ids(text) == want and MODEL.decode([*want, MODEL.end]) == LIB.decode(want)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("abthe .,\n\t▁é日#1'😀")), max_size=60))
def test_any_text_equals_the_library(text):
    assert _ids(text) == LIB.encode(text)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=12))
def test_strings_of_pieces_equal_the_library(parts):
    """Joined pieces offer merges that compete with one another."""
    text = "".join(parts).replace("▁", " ")
    assert _ids(text) == LIB.encode(text)


@settings(max_examples=600, deadline=None)
@given(st.lists(st.one_of(st.sampled_from([0, 1, 2, 259, *MODEL.byte_id[[0xE2, 0x96, 0x81, 0xC3, 0x41]].tolist()]), st.integers(0, 31999)), max_size=10))
def test_decoding_any_identifiers_equals_the_library(ids):
    assert MODEL.decode(ids) == LIB.decode(ids)


def test_words_beyond_the_cache_and_waiting_merges(monkeypatch):
    monkeypatch.setattr(pieces, "ENTRIES", 10)
    monkeypatch.setattr(pieces, "AT_ONCE", 64)
    monkeypatch.setattr(pieces, "LONG", 4)
    fresh = pieces.PieceModel(PATH)
    texts = [*ODD, "the quick brown fox " * 5, "  " * 40 + "x"]
    assert [np.frombuffer(b, "<i4").tolist() for b in fresh.encode_many(texts)] == LIB.encode(texts)
    assert len(fresh.kept) <= 10


def test_rows(spark):
    rows = [(i, t, "clash", i) for i, t in enumerate(ODD)] + [(None, None, None, None), (1, "a", None, 1), (1, "a", None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, decoded int")
    got = pieces.decode(pieces.encode(docs, PATH), PATH).collect()
    key = repr
    assert sorted(((r.doc_id, r.ids, r.decoded) for r in got), key=key) == sorted(((r[0], [*LIB.encode(r[1] or ""), 2], LIB.decode(LIB.encode(r[1] or ""))) for r in rows), key=key)
    assert pieces.decode(pieces.encode(docs.limit(0), PATH), PATH).count() == 0
    assert [r.ids for r in pieces.encode(docs.filter("doc_id = 4"), PATH, end=False).collect()] == [LIB.encode("a")]
    empty = spark.createDataFrame([(1, None), (2, [None, 2])], "doc_id long, ids array<int>")
    assert [r.decoded for r in pieces.decode(empty, PATH).collect()] == ["", ""]


def test_query_equals_the_library(spark, sf):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    got = queries.op11_pieces(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = [*LIB.encode(texts[r.doc_id]), 2]
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(LIB.decode(ids).encode()).hexdigest()
