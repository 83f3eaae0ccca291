import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparloom.llm import token_counts, token_files

MODEL = public_tokenizers.path("piece_bpe_32k.model")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", " ", "  ", "\n", "a", "a  b", " a b ", "a\nb", "a\n\n b", "<s> x </s>", "x<|endoftext|>y", "▁▁ a", "a▁b", "\ta b　", "日本語 テキスト 😀", "it's they're", "a\r\nb", "é" * 500, "ab" * 900, "The THE!! ###%%%", "\x00a \x00", "x " * 3000]


def _library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_counts_equal_the_library():
    lib, mine = _library(), token_counts.model(MODEL)
    for t in ODD:
        assert mine.count(t) == len(lib.encode(t)), repr(t)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("abthe .,\n\t▁é日#1'😀")), max_size=60))
def test_counts_equal_the_library_on_any_text(t):
    assert token_counts.model(MODEL).count(t) == len(_LIB.encode(t))


_LIB = _library()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("abthe .,\n\t é日#1's<|>\r")), max_size=60), max_size=4))
def test_encoder_equals_the_library(texts):
    coder = token_files.encoder(BYTES)
    for t, got in zip(texts, coder.encode_many(texts), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == coder.library.encode(t, add_special_tokens=False).ids


def test_encoder_equals_the_library_on_odd_texts():
    coder = token_files.encoder(BYTES)
    for t, got in zip(ODD, coder.encode_many(ODD), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == coder.library.encode(t, add_special_tokens=False).ids, repr(t)


def _counted_calls(coder, monkeypatch):
    """The texts that go through the whole tokenizer, its pattern included."""
    calls = []

    class Library:
        model = coder.library.model

        def __getattr__(self, name):
            calls.append(name)
            return getattr(coder_library, name)

    coder_library = coder.library
    monkeypatch.setattr(coder, "library", Library())
    return calls


def test_words_of_plain_runs_skip_the_tokenizers_pattern(monkeypatch):
    coder = token_files.WordEncoder(BYTES)
    texts = ["A word, another (word) 555-4042.\nÉté größer ¡Ñandú! a_b x2y\n$$$ end", "..., 12ab%% ça"]
    want = [coder.library.encode(t, add_special_tokens=False).ids for t in texts]
    want_odd = coder.library.encode("it's ªb x² µm 日本 ¡a", add_special_tokens=False).ids
    calls = _counted_calls(coder, monkeypatch)
    plain = [t.replace("¡", "") for t in texts]
    list(coder.encode_many(plain))
    assert calls == []
    assert [np.frombuffer(b, "<u4").tolist() for b in coder.encode_many(texts)] == want
    assert calls == ["encode_batch_fast"]
    assert np.frombuffer(next(coder.encode_many(["it's ªb x² µm 日本 ¡a"])), "<u4").tolist() == want_odd


def test_letters_and_punctuation_are_the_librarys():
    coder = token_files.WordEncoder(BYTES)
    letters = [chr(c) for c in range(0x250) if token_files.WordEncoder.RUN.fullmatch("a" + chr(c))]
    assert len(letters) > 400
    for text in (f"{m}{c}{m}{c}" for m in ("a", "é", "7", "!", ".x") for c in [*letters, *"0189", *coder.PUNCTUATION, "'", "ª", "²"]):
        for t in (text, f"b {text} c", f"b\n{text}"):
            got, want = next(token_files.WordEncoder.encode_many(coder, [t])), coder.library.encode(t, add_special_tokens=False).ids
            assert np.frombuffer(got, "<u4").tolist() == want, repr(t)


def test_words_beyond_what_is_kept(monkeypatch):
    monkeypatch.setattr(token_files.WordEncoder, "ENTRIES", 3)
    coder = token_files.WordEncoder(BYTES)
    texts = ["one two, three. four\nfive, six", "two, two seven! one", "five six, seven!"]
    for _ in range(2):
        assert [np.frombuffer(b, "<u4").tolist() for b in coder.encode_many(texts)] == [coder.library.encode(t, add_special_tokens=False).ids for t in texts]
    assert len(coder.kept) == 3


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 200), st.integers(0, 2**32 - 1)), max_size=1500))
def test_blocks_round_trip(values):
    ids = np.array(values, np.uint32)
    assert token_files.unpack_blocks(*token_files.pack_blocks(ids)).tolist() == values


def _docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, value int")


def test_count_query_shapes(spark):
    rows = [(i, t, "clash", i) for i, t in enumerate(ODD)] + [(None, None, None, None), (1, "a", None, 1), (1, "a", None, 1)]
    got = token_counts.token_counts(_docs(spark, rows), MODEL, limit=500).collect()
    want = sorted((r[0] if r[0] is not None else -1, len((r[1] or "").encode()), len(_LIB.encode(r[1] or ""))) for r in rows)
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_bytes, r.n_tokens) for r in got) == want
    assert all(r.over_limit == (r.n_tokens > 500) for r in got)
    assert token_counts.token_counts(_docs(spark, []), MODEL).count() == 0


def test_files_round_trip(spark, tmp_path):
    rows = [(i * 7 % 101, t, "clash", i) for i, t in enumerate(ODD)] + [(None, None, None, None), (500, "a", None, 1), (500, "a", None, 1), (500, "b", None, 2)]
    path = "file://" + str(tmp_path / "ids")
    token_files.write_token_files(_docs(spark, rows).repartition(3), path, BYTES)
    got = token_files.read_token_files(spark, path).orderBy("start").collect()
    lib = token_files.encoder(BYTES).library
    assert len(got) == len(rows)
    ids = [r.doc_id for r in got]
    assert ids[0] is None and ids[1:] == sorted(ids[1:])
    start, by_id = 0, {}
    for r in rows:
        by_id.setdefault(r[0], []).append(zlib.crc32(np.array([*lib.encode(r[1] or "", add_special_tokens=False).ids, 0], "<u4").tobytes()))
    for r in got:
        assert r.start == start
        start += r.n_tokens
        by_id[r.doc_id].remove(r.ids_crc32)
    assert {r.doc_id: r.ids for r in token_files.read_token_ids(spark, path).filter("doc_id = 7").collect()} == {7: [*lib.encode(ODD[1], add_special_tokens=False).ids, 0]}


def test_files_in_the_order_of_the_rows(spark, tmp_path):
    rows = [(900 - i, t, "clash", i) for i, t in enumerate(ODD)] + [(900, ODD[0], None, 1), (None, None, None, None)]
    path = "file://" + str(tmp_path / "ids")
    token_files.write_token_files(_docs(spark, rows).coalesce(1), path, BYTES, by_id=False)
    got = token_files.read_token_files(spark, path).orderBy("start").collect()
    assert [r.doc_id for r in got] == [r[0] for r in rows]
    assert {r.file for r in got} == {f.name for f in (tmp_path / "ids").glob("part-*")} and [r.first for r in got] == [r.start for r in got]


@pytest.mark.parametrize("width", range(1, 33))
def test_widths_round_trip(width):
    values = np.random.default_rng(width).integers(0, 1 << width, (3, token_files.BLOCK), dtype=np.uint64)
    packed = token_files._pack(values.astype(np.uint32), width)
    bits = "".join(format(int(v), f"0{width}b")[::-1] for v in values[0])
    assert packed[0].tobytes() == bytes(int(bits[i : i + 8][::-1], 2) for i in range(0, len(bits), 8))
    assert (token_files._unpack(packed, width) == values).all()


def test_files_of_an_empty_table(spark, tmp_path):
    path = "file://" + str(tmp_path / "none")
    token_files.write_token_files(_docs(spark, []), path, BYTES)
    assert token_files.read_token_files(spark, path).count() == 0
