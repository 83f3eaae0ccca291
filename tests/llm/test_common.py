import gc
import os
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparloom.llm import common, decontaminate, disclosure, simhash
from sparloom.llm.common import table
from sparloom.llm.words import PIECE, hashed_words


def size(folder):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(folder) for f in names)


def test_tables_on_the_way_go(spark, sf):
    """Disk before and after: scratch tables go with the operator, checkpoints with the frames that read them."""
    folder = common.shared_folder(spark).removeprefix("file://")
    docs, before = table(spark, sf, "documents"), {f for f in os.listdir(folder) if f.startswith("scratch-")}
    made = [simhash.near_duplicates(docs), simhash.keep_one(docs), decontaminate.find_leaks(docs, table(spark, sf, "benchmark")), disclosure.find_personal_data(docs)]
    assert {f for f in os.listdir(folder) if f.startswith("scratch-")} <= before
    kept = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    full = size(kept)
    assert full and [m.count() for m in made]
    del made
    for _ in range(40):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)
        if size(kept) < full / 2:
            break
    assert size(kept) < full / 2


def test_tables_go_on_an_error_too(spark):
    with pytest.raises(ZeroDivisionError), common.Scratch(spark) as scratch:
        t = scratch.write(spark.range(5))
        assert t.count() == 5 and t.dtypes == [("id", "bigint")]
        1 / 0
    assert not os.path.exists(scratch.folder.removeprefix("file://"))


def test_batch_setting_is_put_back(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    said = spark.conf.get(name)
    with common.small_batches(spark):
        assert spark.conf.get(name) == common.BATCH_BYTES
    assert spark.conf.get(name) == said


def test_row_keys(spark):
    rows = [(1, "a"), (1, "b"), (None, "a"), (None, None), (None, ""), (11, "x"), (1, "1:x")]
    got = [bytes(r.k).hex() for r in spark.createDataFrame(rows, "i long, t string").select(common.row_key("i", "t").alias("k")).collect()]
    assert len(set(got)) == 6 and got[3] == got[4]
    docs = spark.createDataFrame(rows, "i long, t string")
    gone = docs.filter("i = 1 AND t = 'a' OR i IS NULL AND t = 'a'").select(common.row_key("i", "t"))
    assert sorted(map(tuple, common.without_rows(docs, gone, "i", "t").collect()), key=str) == sorted([r for r in rows if r[1] != "a"], key=str)


def test_keys_beyond_the_broadcast_limit(spark, monkeypatch):
    monkeypatch.setattr(common, "MAX_BROADCAST_KEYS", 1)
    docs = spark.range(50).select(F.col("id").alias("i"), F.lit("t").alias("t"))
    gone = docs.filter("i < 20").select(common.row_key("i", "t"))
    assert common.without_rows(docs, gone, "i", "t").count() == 30


def test_chunks_hold_all_rows():
    texts = ["x" * n for n in (1, 5_000_000, 0, 3, 4_000_000, 200_000, 7)] + ["y"] * 3000
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["i", "t"])
    parts = list(common.text_chunks([batch.slice(0, 0), batch]))
    assert [i for p in parts for i in p.column(0).to_pylist()] == list(range(len(texts)))
    assert all(p.num_rows == 1 or sum(map(len, p.column(1).to_pylist())) <= 4 << 20 for p in parts)


def test_long_texts_hash_like_short_ones():
    """Pieces, neighbours in a chunk and case change no word's hash."""
    text = " ".join(f"word{i}" for i in range(60_000))
    assert len(text) > 2 * PIECE
    whole = hashed_words([text], "plain")[0]
    assert len(whole) == 60_000 and len(np.unique(whole)) == 60_000
    each = hashed_words(["", *[f"WORD{i}" for i in range(50)], "  "], "plain")
    assert [len(h) for h in each] == [0, *[1] * 50, 0] and [int(h[0]) for h in each[1:-1]] == whole[:50].tolist()
    assert len(hashed_words(["a" * (3 * PIECE)], "plain")[0]) == 3
    assert hashed_words(["Ünder"], "words")[0].tolist() == hashed_words(["ünder"], "words")[0].tolist()
    assert [len(h) for h in hashed_words(["a-b_c, d…e", "“q”"], "words")] == [4, 1]


def test_equal_groups_by_parity_maps():
    rng = np.random.default_rng(1)
    for n in (5, 400, 3000, 9000):
        a = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        b = np.unique(np.concatenate((a[: len(a) * 9 // 10], rng.integers(0, 2**64, n // 20 + 1, dtype=np.uint64))))
        x, y = simhash.parity_map(a), simhash.parity_map(b)
        assert simhash.differing(x, y) <= len(np.setxor1d(a, b)) and len(simhash.folded(x, 128)) == 128
        brief = np.bitwise_count(simhash.folded(x, 128) ^ simhash.folded(y, 128)).sum()
        assert brief <= len(np.setxor1d(a, b)) and simhash.differing(x, x) == 0


def test_steps_without_use_for_it_let_go_what_a_worker_keeps(spark):
    """Workers outlive stages: what the token files' encoder kept stayed in them through all of near_duplicates."""

    def fill(rows):
        common.kept_by_worker("things", lambda: list(range(1000)))
        yield from rows

    def look(rows):
        for (i,) in rows:
            yield i, len(common._KEPT)

    def look_in_batches(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(common._KEPT)] * batch.num_rows)], names=["id", "n"])

    ids = spark.range(0, 64, 1, 8)
    for _ in range(2):
        assert len(common.arrow_rows(ids, fill, "id long", keeps=True).collect()) == 64
        assert any(r["n"] for r in common.arrow_rows(ids, look, "id long, n long", keeps=True).collect())
        assert not any(r["n"] for r in common.arrow_rows(ids, look, "id long, n long").collect())
    common.arrow_rows(ids, fill, "id long", keeps=True).collect()
    assert not any(r["n"] for r in ids.mapInArrow(common.keeping_nothing(look_in_batches), "id long, n long").collect())
