import math

import numpy as np

from sparloom.llm import quality
from sparloom.llm.common import table


def test_kth_largest(spark):
    rng = np.random.default_rng(2)
    values = [int(v) for v in rng.integers(0, 2**52, 500)] + [7, 7, 7, 0, 2**52 - 1]
    df = spark.createDataFrame([(v,) for v in values], "x long")
    for k in (1, 2, 100, 503, 504, 505):
        assert quality.kth_largest(df, "x", k) == sorted(values, reverse=True)[k - 1]
    assert quality.kth_largest(df, "x", 506) is None


def test_best_cut():
    assert quality.best_cut(np.array([1.0, 2, 3, 4]), np.array([False, False, True, True])) == 2.5
    assert quality.best_cut(np.array([1.0]), np.array([True])) == -math.inf
    assert quality.best_cut(np.array([]), np.array([], bool)) == -math.inf


def test_models_equal_brute_force(spark):
    rows = [(1, "a b a"), (2, "c c c"), (3, None), (4, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    raw, target = quality.count_models(docs, {2}, "doc_id", "text")
    want = np.zeros(quality.BUCKETS)
    for _, t in rows:
        np.add.at(want, quality.text_buckets([t or ""])[0], 1)
    assert (raw == want).all() and raw.sum() == 12 and target.sum() == 6


def brute_weight(text, raw, target, ours):
    found = quality.text_buckets([text])[0].tolist()
    total, buckets = 0.0, quality.BUCKETS
    for b in found:
        own = found.count(b)
        prior = (raw[b] - own + 0.5) / (raw.sum() - len(found) + 0.5 * buckets)
        extra = 0.01 * buckets
        likely = (target[b] - own * ours + extra * prior) / (target.sum() - len(found) * ours + extra)
        total += math.log(likely / prior)
    return total


def test_sample_equals_brute_force(spark):
    rows = [(i, f"plain words number {i % 9} here") for i in range(60)] + [(60 + i, "### !!! %%% " * (1 + i % 3)) for i in range(20)] + [(None, None), (80, ""), (3, "plain words number 3 here")]
    docs = spark.createDataFrame([(*r, True) for r in rows], "doc_id long, text string, kept boolean").repartition(3)
    labels = spark.createDataFrame([(i, int(i < 60), 0, "x") for i in range(0, 80, 2)] + [(1, None, 0, "x"), (None, 1, 0, "x"), (5, 1, 1, "x")], "doc_id long, quality int, toxic int, text string")
    got = quality.importance_sample(docs, labels, smoothing=0.01).toPandas()
    assert len(got) == len(rows)
    raw, target = quality.count_models(docs, set(range(0, 60, 2)), "doc_id", "text")
    want = sorted(brute_weight(t or "", raw, target, i is not None and i < 60 and i % 2 == 0) for i, t in rows)
    assert np.allclose(sorted(got["log_weight"]), want, atol=1e-3)
    assert got[got["doc_id"] < 60]["kept"].all() and not got[(got["doc_id"] >= 60) & (got["doc_id"] < 80)]["kept"].any()
    few = quality.importance_sample(docs, labels, k=5, smoothing=0.01).toPandas()
    assert set(few[few["kept"]]["gumbel_key"]) == set(sorted(few["gumbel_key"], reverse=True)[:5])
    assert quality.importance_sample(docs, labels, k=0).filter("kept").count() == 0


def test_ngrams_are_those_of_the_text():
    """By words as they are: as many n-grams as the text has, equal ones in one bucket."""
    b = quality.text_buckets(["One two, one TWO x x x"])[0]
    parts = ["one", "two", ",", "one", "CAPITALS", "two", "x", "AGAIN", "AGAIN"]
    assert len(b) == 9 + 8 + 7
    for i in range(9):
        for j in range(9):
            assert (b[i] == b[j]) == (parts[i] == parts[j])
    assert b[9 + 7] != b[9 + 6] and len(set(b[9:17].tolist())) == 8
    assert len(set(b[17:].tolist())) == 7


def test_filter_keeps_rows_without_an_id(spark):
    rows = [(i, f"plain words number {i % 9} here") for i in range(60)] + [(60 + i, "### !!! %%% " * 3) for i in range(20)] + [(None, "plain words number 3 here"), (None, "### !!! %%% " * 3), (61, "plain words number 4 here"), (5, "plain words number 5 here")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, row_key string").repartition(3)
    labels = spark.createDataFrame([(i, int(i < 60), 0) for i in range(0, 80, 2)], "doc_id long, quality int, toxic int")
    got = quality.keep_good(docs, labels, smoothing=0.01).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in got) == sorted((i is None, i or 0, t) for i, t in rows if "words" in t)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.kept for r in quality.importance_sample(docs, labels).collect()] == [True]
    assert quality.importance_sample(docs.limit(0), labels).count() == 0


def test_held_out_accuracy(spark):
    where = "/root/testdata/sf0.01"
    docs, labels = table(spark, where, "documents"), table(spark, where, "labels")
    fit = labels.filter("doc_id % 2 = 0")
    got = quality.importance_sample(docs, fit).join(labels.filter("doc_id % 2 = 1"), "doc_id").toPandas()
    good, bad = got[got["quality"] == 1], got[got["quality"] == 0]
    print(good["kept"].mean(), (~bad["kept"]).mean())
    assert good["kept"].mean() > 0.9 and (~bad["kept"]).mean() > 0.8
