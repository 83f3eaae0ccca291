"""Columns of the documents whose names operators use themselves."""

import public_tokenizers
import pytest

import corpus_pipeline
from sparloom.llm import decontaminate, disclosure, lz_fingerprint, mixing, pieces, quality, sharding, simhash, token_counts, token_files

CLASHES = ["_gone", "_Gone", "_changes", "_ends", "_plan", "_key", "_n", "_u", "_source", "row_key", "_text", "base", "near", "fp", "n_tokens", "component_id", "copies", "copy_no", "shuffle_key", "slot", "ids", "weight", "n"]


def _docs(spark, names):
    texts = ["mail jo@ex.org now", "mail jo@ex.org now", None, "", "one two three four five six seven eight nine ten", "another text that stands alone here"]
    rows = [(i, t, "en", f"s{i % 2}", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame([(*r, *["clash"] * len(names)) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in names))


def _names():
    """Each name once: those that differ in case alone can't stand in one table."""
    return [n for n in CLASHES if n != "_Gone"], ["_Gone"]


@pytest.mark.parametrize("names", _names(), ids=["all", "case"])
def test_filters_and_stages_take_any_column_names(spark, sf, names):
    docs = _docs(spark, names)
    labels = spark.createDataFrame([(0, 1, 0, "c"), (4, 1, 0, "c"), (5, 0, 1, "c")], "doc_id long, quality int, toxic int, _gone string")
    bench = spark.createDataFrame([(1, "one two three four five six seven eight", "c")], "item_id long, text string, _gone string")
    assert quality.keep_good(docs, labels).columns == docs.columns
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [0, 2, 4, 5]
    left = decontaminate.without_leaks(docs, bench)
    assert left.columns == docs.columns and 4 not in {r.doc_id for r in left.collect()}
    clean = disclosure.sanitise(docs)
    assert clean.columns == docs.columns and [r.text for r in clean.orderBy("doc_id").collect()][:3] == ["mail [EMAIL] now", "mail [EMAIL] now", None]
    mixed = corpus_pipeline.mix(spark, docs, sf)
    assert mixed.columns == docs.columns


def test_operators_take_any_column_names(spark, tmp_path):
    docs = _docs(spark, _names()[0])
    model = public_tokenizers.path("piece_bpe_32k.model")
    assert token_counts.token_counts(docs, model).count() == 6
    assert pieces.encode(docs, model).count() == 6
    assert simhash.near_duplicates(docs).count() == 6
    assert lz_fingerprint.edit_likeness(docs).count() == 6
    assert disclosure.find_personal_data(docs).count() == 6
    assert sharding.assign_shards(docs.select("doc_id", "source", "_gone"), "doc_id", ("a", "b")).count() == 6
    path = f"file://{tmp_path}/ids"
    token_files.write_token_files(docs, path, public_tokenizers.path("byte_bpe_50k.json"))
    assert token_files.read_token_files(spark, path).count() == 6
