import math
import statistics

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparloom.operators import batching, medians


@settings(max_examples=200, deadline=None)
@given(st.lists(st.floats(allow_nan=False), min_size=1, max_size=20))
def test_keys_keep_the_order(values):
    x = np.array(values)
    keys = medians.keys_of(x)
    assert [medians.value_of(int(k)) for k in keys] == [v + 0.0 for v in values]
    assert sorted(range(len(x)), key=lambda i: x[i]) == sorted(range(len(x)), key=lambda i: int(keys[i]))


def test_medians_equal_a_plain_sort(spark):
    rng = np.random.default_rng(2)
    columns = {"even": rng.normal(size=300), "ties": rng.integers(0, 3, 300), "wide": rng.normal(size=300) * 10.0 ** rng.integers(-200, 200, 300), "zeros": rng.choice([0.0, -0.0, -1e-300], 300), "none": [None] * 300, "one": [None] * 299 + [7.5], "odd": [None, *rng.normal(size=299)], "bad": [math.nan, math.inf, *rng.normal(size=298)]}
    rows = list(zip(*[[None if v is None else float(v) for v in c] for c in columns.values()], strict=True))
    df = spark.createDataFrame(rows, ", ".join(f"`{c}` double" for c in columns)).repartition(5)
    want = {c: [v for v in col if v is not None and not math.isnan(v)] for c, col in zip(columns, zip(*rows, strict=True), strict=True)}
    assert medians.medians(df, list(columns)) == {c: statistics.median(v) if v else None for c, v in want.items()}
    assert medians.medians(df.limit(0), ["even"]) == {"even": None} and medians.medians(df, []) == {}


def _words(text):
    return F.transform(F.filter(F.split(text, r"\s+"), lambda w: w != ""), lambda w: (F.crc32(w.cast("binary")) % 1_000_003).cast("int"))


def test_masks_cover_the_answer(spark):
    talk = [("system", "be good"), ("user", "what is it"), ("assistant", "it is a part")]
    rows = [(1, talk), (2, talk[:1]), (3, []), (4, None), (5, [("user", None)])]
    df = spark.createDataFrame(rows, "id int, messages array<struct<role string, content string>>")
    got = {r.id: r for r in batching.masked(df, _words, 100).collect()}
    # SYSTEM: be good / USER: what is it / ASSISTANT: it is a part; the prompt ends with the cue
    assert len(got[1].input_ids) == 12 and got[1].labels == [-100] * 8 + got[1].input_ids[8:] and got[1].attention_mask == [1] * 12
    assert got[2].labels == [-100, *got[2].input_ids[1:]]
    assert all(got[i].input_ids == got[i].labels == got[i].attention_mask == [] for i in (3, 4))
    assert got[5].labels == [-100]
    short = {r.id: r for r in batching.masked(df, _words, 6).collect()}
    assert short[1].input_ids == got[1].input_ids[:6] and short[1].labels == [-100] * 6


def test_batches_are_padded_to_their_longest(spark):
    rows = [(i, list(range(1, 1 + i % 23))) for i in range(50)]
    df = spark.createDataFrame(rows, "id int, ids array<int>").select("id", F.col("ids").alias("input_ids"), F.transform("ids", lambda x: F.lit(1)).alias("attention_mask"), F.col("ids").alias("labels"))
    got = batching.padded_batches(df.repartition(4), "id", 8, F.lit(0), bucket=5, pad_id=9).collect()
    order = sorted(rows, key=lambda r: (math.ceil(len(r[1]) / 5), r[0]))
    for at in range(0, 50, 8):
        longest = max(len(ids) for _, ids in order[at : at + 8])
        for place, (i, ids) in enumerate(order[at : at + 8]):
            r = next(r for r in got if r.id == i)
            more = longest - len(ids)
            assert (r.batch, r.place) == (at // 8, place)
            assert (r.input_ids, r.attention_mask, r.labels) == (ids + [9] * more, [1] * len(ids) + [0] * more, ids + [-100] * more)
    assert batching.padded_batches(df.limit(0), "id", 8, F.lit(0)).count() == 0
