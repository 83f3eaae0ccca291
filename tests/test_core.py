"""Operators by hand-made rows: what the oracle queries don't reach."""

import json
import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparloom.functions import records as R
from sparloom.functions import text as X
from sparloom.functions import vocabulary as V
from sparloom.functions.lineage import numbered
from sparloom.operators import ensemble, gates, integrate, metrics, resample, sample, split
from sparloom.operators.gates import GateError


def one(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema)


# ---- text ----


def test_codes(spark):
    rows = [("EUH066 H300+H310",), ("h225; H360FD, H3001",), (None,), ("H271 h225 H225",)]
    got = [r.c for r in one(spark, "t string", *rows).select(X.extract_codes(F.col("t")).alias("c")).collect()]
    assert got == [["H066", "H300", "H310"], ["H225", "H360", "H300"], [], ["H271", "H225"]]
    labels = [r.c for r in one(spark, "t string", *rows).select(X.codes_to_labels(X.extract_codes(F.col("t"))).alias("c")).collect()]
    assert labels == [["acute_toxicity"], ["flammable", "cmr", "acute_toxicity"], [], ["flammable"]]
    assert len(V.CODE_TO_LABEL) == sum(len(c) for c in V.CODES.values())


def test_clean(spark):
    rows = [("　 a 　\t b\n",), (None,), (" NaN ",), ("None",)]
    df = one(spark, "t string", *rows)
    assert [r.x for r in df.select(X.normalize_text(F.col("t")).alias("x")).collect()] == ["a b", "", "NaN", "None"]
    assert [r.x for r in df.select(X.as_text(F.col("t")).alias("x")).collect()] == ["a 　\t b", "", "", ""]


def test_dialects(spark):
    values = ["1", "1.0", "True", "true", "TRUE", "yes", "0", "no", "", None, "nan"]
    df = one(spark, "v string", *[(v,) for v in values])
    got = df.select(X.is_positive(F.col("v")).alias("p"), X.normalize_binary(F.col("v")).alias("n"), X.parse_boolish(F.col("v")).alias("b")).collect()
    assert [r.p for r in got] == [True] * 4 + [False] * 7
    assert [r.n for r in got] == [1] * 6 + [0] * 5
    assert [r.b for r in got] == ["true", "", "true", "true", "true", "true", "false", "false", "", "", ""]


def test_numbers(spark):
    rows = [("about -12.5 C",), ("+.5 g",), ("none",), ("LD50 oral 12.5 MG/KG",), (None,)]
    got = one(spark, "t string", *rows).select(X.parse_float(F.col("t")).alias("a"), X.physical_number(F.col("t")).alias("b"), X.toxicity_number(F.col("t")).alias("c")).collect()
    assert [tuple(r) for r in got] == [(-12.5, -12.5, None), (5.0, 0.5, None), (None, None, None), (50.0, 50.0, 12.5), (None, None, None)]


def test_three_valued_or(spark):
    cells = ["Category 1", "Not classified", "-"]
    rows = [(a, b, c) for a in cells for b in cells for c in cells]
    df = one(spark, "a string, b string, c string", *rows)
    (_, status, _), = X.tri_state_labels(F.col, {"x": tuple((n, r"Category\s+1\b") for n in "abc")})
    value = {"Category 1": 1, "Not classified": 0, "-": None}
    for row, r in zip(rows, df.select(status.alias("s")).collect(), strict=True):
        v = [value[x] for x in row]
        assert r.s == (1 if 1 in v else 0 if all(x == 0 for x in v) else None)


def test_rule_table_covers_all_labels(spark):
    assert tuple(V.TRI_STATE_RULES) == V.LABELS and sum(map(len, V.TRI_STATE_RULES.values())) == 27
    df = one(spark, "`Oxidizing liquids` string, `Oxidizing solids` string", ("Category 1", "Not classified"), ("Category 2", None), (None, None))
    rules = {"oxidizing": V.TRI_STATE_RULES["oxidizing"]}
    (_, status, evidence), = X.tri_state_labels(lambda n: F.col(f"`{n}`"), rules)
    got = df.select(status.alias("s"), evidence.alias("e")).collect()
    assert [r.s for r in got] == [0, 1, None] and got[2].e == "Oxidizing liquids=<blank> | Oxidizing solids=<blank>"


def test_toxicity_class(spark):
    values = [5.0, 5.1, 50.0, 50.1, 300.0, 300.1, 2000.0, 2000.1, 5000.0, 5000.1, 0.0, None]
    got = [r.x for r in one(spark, "v double", *[(v,) for v in values]).select(X.toxicity_class(F.col("v")).alias("x")).collect()]
    assert got == [1, 2, 2, 3, 3, 4, 4, 5, 5, 6, None, None]


# ---- records ----


def test_records_round_trip(spark):
    row = {"CID": "7", "ConnectivitySMILES": "C:C", "IUPACName": "x", "MolecularFormula": "CCl4", "XLogP": "3.5", "WaterSolubility": None, "Pictograms": "Flame"}
    row |= {f"label_{n}": "1.0" if n == "cmr" else "0" for n in V.LABELS}
    df = spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} string" for k in row))
    rec = R.build_records(df, V.SYSTEM_PROMPT, evidence=V.EVIDENCE_FIELDS, cues=True, rubric=("- a: b",)).collect()[0]
    assert rec.id == "7" and [m.role for m in rec.messages] == ["system", "user", "assistant"]
    lines = rec.messages[1].content.split("\n")
    assert lines[:2] == list(V.PROMPT_HEAD) and lines[-1] == V.PROMPT_TAIL and "- ConnectivitySMILES: C:C" in lines
    assert "- Contains halogenated organic structure: yes" in lines and "- High hydrophobicity proxy XLogP >= 3: yes" in lines
    answer = json.loads(rec.messages[2].content)
    assert list(answer) == sorted(V.LABELS) and answer == {n: int(n == "cmr") for n in V.LABELS}
    back = spark.createDataFrame([(rec.messages[1].content,)], "c string").select(R.prompt_fields(F.col("c")).alias("f"), R.field_value(F.col("c"), "Pictograms").alias("p")).collect()[0]
    assert back.f["ConnectivitySMILES"] == "C:C" and back.p == "Flame"


def test_last_repeated_field_holds(spark):
    got = one(spark, "c string", ("- a: 1\n- a: 2\n- b:3\nno line",)).select(R.prompt_fields(F.col("c")).alias("f")).first().f
    assert got == {"a": "2", "b": "3"}


ALL = json.dumps({n: 1 for n in V.LABELS})
SAID = "; ".join(f"{n} = true" for n in V.LABELS)


def test_answers(spark):
    texts = [ALL, f"```json\n{ALL}\n```", f"so {ALL} there", SAID, SAID.rsplit(";", 1)[0], "", '{"cmr": 2}', None]
    got = [r.a for r in one(spark, "t string", *[(t,) for t in texts]).select(R.parse_answer(F.col("t")).alias("a")).collect()]
    assert [a.parse_status for a in got] == ["ok", "ok", "ok", "regex_recovered", "failed", "failed", "ok", "failed"]
    assert got[0].labels.cmr == 1 and got[6].labels.cmr == 0 and got[4].labels is None


def test_label_cascade(spark):
    df = one(spark, "prediction string, prediction_text string, messages array<struct<role:string,content:string>>", ("{}", ALL, None), ("x", None, [("assistant", "no"), ("assistant", f"a {ALL}")]), (None, None, None))
    got = [r.x for r in df.select(R.labels_cascade(df).alias("x")).collect()]
    assert got[0].cmr == 1 and got[1].stot == 1 and got[2] is None


def test_scores(spark):
    df = one(spark, "s struct<a:double,b:double>", ((0.5, 0.49),), ((None, 1.0),))
    with pytest.raises(Exception, match="not finite"):
        df.select(R.threshold_scores(F.col("s"), 0.5, ["a", "b"])).collect()
    got = df.select(R.threshold_scores(F.col("s"), 0.5, ["a", "b"], finite=False).alias("x")).collect()
    assert [tuple(r.x) for r in got] == [(1, 0), (0, 1)]


# ---- gates ----


def test_gates_raise(spark):
    a, b = one(spark, "id int, x int", (1, 1), (2, 0)), one(spark, "id int, y int", (1, 1), (3, 0))
    with pytest.raises(GateError):
        gates.require_unique(a.union(a), "id")
    with pytest.raises(GateError):
        gates.align_strict(a, b, "id")
    with pytest.raises(GateError):
        gates.align_gold(a, b, "id", "id")
    with pytest.raises(GateError):
        gates.require_binary(one(spark, "x int", (2,)), ["x"])
    with pytest.raises(GateError):
        gates.zip_by_position(a.withColumnRenamed("x", "p"), b.withColumnRenamed("y", "p"), "p", "id")
    joined, counts = gates.align_matched(a, b, "id")
    assert joined.count() == 1 and counts == {"missing": 1, "extra": 1}
    assert gates.align_gold(a, b.union(one(spark, "id int, y int", (2, 5))), "id", "id").count() == 2


def test_merges(spark):
    base, other = one(spark, "k int, v string", (1, "a"), (2, "b")), one(spark, "k int, v string, o int", (1, "x", 1), (1, "y", 2))
    assert Counter(r.v_y for r in integrate.left_merge(base, [other], "k").collect()) == {"x": 1, "y": 1, None: 1}
    got = {r.k: r.w for r in integrate.lookup_merge(base, other.withColumnRenamed("v", "w"), "k", "o", {"w": "none"}, ["w"]).collect()}
    assert got == {1: "y", 2: "none"}
    fixed = integrate.with_missing_columns(one(spark, "CanonicalSMILES string", ("C",)), {"ConnectivitySMILES": "string", "z": "double"})
    assert fixed.columns == ["ConnectivitySMILES", "z"]


# ---- splits and samples ----


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 10**6), st.sampled_from([(0.8, 0.1, 0.1), (1 / 3, 1 / 3, 1 / 3), (0.9, 0.1)]))
def test_allocation_sums_up(total, ratios):
    counts = split.allocate_counts(total, ratios)
    assert sum(counts) == total and all(abs(c - total * r) < 1.0001 for c, r in zip(counts, ratios, strict=True))


def test_allocation_known_sizes():
    rest, test = split.allocate_counts(11556, [0.9, 0.1])
    assert (split.allocate_counts(rest, [1 - 0.1 / 0.9, 0.1 / 0.9]), test) == ([9244, 1156], 1156)


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(0, 7), st.integers(1, 400), max_size=8), st.sampled_from([0.1, 0.2, 0.5]))
def test_quotas(masks, holdout):
    taken = split.mask_quotas(masks, 3, holdout, 1)
    total = sum(masks.values())
    assert sum(taken.values()) == split.allocate_counts(total, [1 - holdout, holdout])[1]
    assert all(0 <= taken[m] <= masks[m] for m in masks)


def test_quota_balance():
    masks = {1: 1000, 2: 300, 3: 100, 4: 50, 0: 2000}
    taken = split.mask_quotas(masks, 3, 0.1, 1)
    for i in range(3):
        whole = sum(c for m, c in masks.items() if m >> i & 1)
        assert abs(sum(c for m, c in taken.items() if m >> i & 1) - 0.1 * whole) <= 2


def test_stratified_split(spark):
    rows = [(i, int(i % 5 == 0), int(i % 17 == 0)) for i in range(1000)]
    got = split.stratified_split(one(spark, "id int, a int, b int", *rows), "id", ["a", "b"], 0.1, 0.1, 5).toPandas()
    assert len(got) == 1000 and got["id"].is_unique and Counter(got["split"]) == {"train": 800, "val": 100, "test": 100}
    assert all(abs(got[got["split"] == s]["a"].sum() - 20) <= 2 for s in ("val", "test"))
    again = split.stratified_split(one(spark, "id int, a int, b int", *rows[::-1]).repartition(7), "id", ["a", "b"], 0.1, 0.1, 5).toPandas()
    assert dict(zip(got["id"], got["split"], strict=True)) == dict(zip(again["id"], again["split"], strict=True))


def test_take_by_hash_equals_a_sort(spark):
    import hashlib

    rows = [(i, i % 3) for i in range(5000)]
    got = {r.id: r.split for r in split.take_by_hash(one(spark, "id int, g int", *rows), "id", "s", {0: [100, 250], 1: [0, 7], 2: [1666, 1666]}, ["x", "y", "z"], F.col("g")).collect()}
    for g, (a, b) in {0: (100, 250), 1: (0, 7), 2: (1666, 1666)}.items():
        order = sorted((i for i, k in rows if k == g), key=lambda i: (hashlib.md5(f"s:{i}".encode()).hexdigest(), i))
        for place, i in enumerate(order):
            assert got[i] == ("x" if place < a else "y" if place < b else "z")


def brute_groups(rows, seed):
    """rows: (id, group, label)"""
    import hashlib

    names, ratios = ("train", "val", "test"), [0.8, 0.1, 0.1]
    groups = {}
    for _, g, y in rows:
        size, pos = groups.get(g, (0, 0))
        groups[g] = (size + 1, pos + y)
    room = dict(zip(names, split.allocate_counts(len(rows), ratios), strict=True))
    need = dict(zip(names, split.allocate_counts(sum(y for *_, y in rows), ratios), strict=True))
    out = {}
    for g, (size, pos) in sorted(groups.items(), key=lambda x: (-x[1][0], -(x[1][1] > 0), hashlib.md5(f"{seed}:{x[0]}".encode()).hexdigest())):
        best = max(names, key=lambda s: (min(need[s], pos) if pos else 0, room[s] + 2 * min(0, room[s] - size), hashlib.md5(f"{seed}:{g}:{s}".encode()).hexdigest()))
        room[best] -= size
        need[best] -= pos
        out[g] = best
    return out


def test_group_split_equals_brute_force(spark):
    rows = [(i, f"g{i * i % 37}", int(i % 4 == 0)) for i in range(600)]
    df = one(spark, "id int, grp string, y int", *rows)
    got = split.group_split(df, "grp", ["y"], 0.1, 0.1, 3).select("grp", "split").distinct().collect()
    assert {r.grp: r.split for r in got} == brute_groups(rows, 3)


def test_manifest_overlap(spark):
    with pytest.raises(GateError):
        split.split_manifest(one(spark, "id int, split string", (1, "train"), (1, "val")), "id")
    assert {(r.id, r.split, r.exposure_count) for r in split.split_manifest(one(spark, "id int, split string", (1, "train"), (1, "train"), (2, "val")), "id").collect()} == {("1", "train", 2), ("2", "validation", 1)}


def test_oversampling_leaves_other_splits_alone(spark):
    rows = [(i, "train" if i % 3 else "test", int(i % 2)) for i in range(300)]
    got = sample.oversample(one(spark, "id int, split string, a int", *rows), {"a": 2.5}, "id", 1).toPandas()
    sizes = got.groupby("id").size()
    assert all(sizes[i] == 1 for i, s, a in rows if s == "test" or not a) and {2, 3} == {sizes[i] for i, s, a in rows if s == "train" and a}
    assert sample.parse_factors("cmr=3", 2) == dict.fromkeys(V.RARE_LABELS, 2.0) | {"cmr": 3.0}
    for bad in ("cmr=0.5", "nope=2", "cmr"):
        with pytest.raises(ValueError):
            sample.parse_factors(bad)


def test_hard_positive(spark):
    got = one(spark, "y int, t string", (1, "Has PHOSPHATE"), (0, "phosphate"), (1, None)).select(sample.hard_positive(F.col("y"), F.col("t"), ["phosphate"]).alias("h")).collect()
    assert [r.h for r in got] == [True, False, False]


def test_permutation_keeps_values(spark):
    rows = [(i, f"v{i % 11}") for i in range(200)]
    got = sample.permute_column(one(spark, "id int, v string", *rows), "v", "id", "id", 3).collect()
    assert Counter(r.v for r in got) == Counter(v for _, v in rows) and any(r.v != rows[r.id][1] for r in got)
    assert sorted(r.n for r in numbered(one(spark, "id int", *[(i,) for i in range(57)]), [F.desc("id")], "n").collect()) == list(range(57))


# ---- votes and metrics ----


def test_member_validation(spark):
    ids = one(spark, "id int", (1,), (2,))
    members = one(spark, "id int, member string, a int", (1, "m", 1), (2, "m", 0), (1, "n", 1), (2, "n", None))
    with pytest.raises(GateError):
        ensemble.validate_members(members, ids, "id", ["a"])
    assert ensemble.validate_members(members, ids, "id", ["a"], mode="lenient").count() == 4
    with pytest.raises(GateError):
        ensemble.validate_members(members, ids, "id", ["a"], mode="block")
    with pytest.raises(ValueError):
        ensemble.vote_thresholds(["a"], 3, 4)


def test_votes_fall_with_the_threshold(spark):
    rows = [(i, m, "a", int((i * m) % 3 == 0)) for i in range(50) for m in (1, 2, 3)]
    members = one(spark, "id int, member int, label string, pred int", *rows)
    counts = [ensemble.vote(members, "id", {"a": t}).agg(F.sum("pred")).first()[0] for t in (1, 2, 3)]
    assert counts == sorted(counts, reverse=True)


def test_failures_count_as_zero_only_inside(spark):
    long = one(spark, "id int, label string, truth int, pred int", (1, "a", 1, None), (2, "a", 1, 1))
    filled, failed = metrics.fill_failures(long)
    assert metrics.per_label(filled).first().recall == 0.5 and long.agg(failed).first()[0] == 1
    masked = metrics.masked_metrics(long.withColumn("mask", F.lit(1))).first()
    assert (masked.valid, masked.scored, masked.excluded, masked.recall) == (2, 1, 1, 1.0)
    with pytest.raises(Exception, match="unknown truth"):
        metrics.masked_metrics(one(spark, "label string, truth int, pred int, mask int", ("a", None, 1, 1))).collect()


def test_integrity_gate(spark):
    with pytest.raises(GateError):
        metrics.require_equal_counters(one(spark, "m string, n int", ("a", 1), ("b", 2)), "m", ["n"], 2)


def test_gold_equivalence_and_status(spark):
    rec = lambda t, y: ("1", 0, [("user", t), ("assistant", "z")], (y,))
    schema = "id string, o int, messages array<struct<role:string,content:string>>, labels struct<a:int>"
    a, b, c = (one(spark, schema, rec(*x)) for x in (("p", 1), ("p", 1), ("q", 0)))
    assert metrics.gold_equivalence(a, b, "o", ["a"]) == {"unpaired": 0, "moved": 0, "relabelled": 0, "same_prompts": True}
    assert metrics.gold_equivalence(a, c, "o", ["a"]) == {"unpaired": 0, "moved": 0, "relabelled": 1, "same_prompts": False}
    assert [metrics.run_status(*x) for x in ((None, a), (a, None), (a.union(a), a), (a, c.withColumn("id", F.lit("9"))), (a, b))] == ["missing_gold", "missing_prediction", "duplicate_ids", "id_mismatch", "evaluated"]


def test_interval_holds_the_point(spark):
    rows = [(i, i % 2, int(i % 3 == 0), i % 2 if i % 5 else 1 - i % 2, int(i % 4 == 0)) for i in range(80)]
    df = one(spark, "id int, ta int, tb int, pa int, pb int", *rows)
    stats = resample.row_statistics(df, "id", ["a", "b"], lambda n: F.col(f"t{n}"), lambda n: F.col(f"p{n}"))
    got = resample.bootstrap_ci(stats, "id", ["a", "b"], 300).collect()
    assert len(got) == 4 and all(r.ci95_low <= r.value <= r.ci95_high for r in got)
    other = resample.bootstrap_ci(stats.repartition(5), "id", ["a", "b"], 300).collect()
    assert {r.metric: (r.ci95_low, r.ci95_high) for r in got} == {r.metric: (r.ci95_low, r.ci95_high) for r in other}


def test_group_split_fills_rooms_beyond_the_groups_placed_singly(spark, monkeypatch):
    monkeypatch.setattr(split, "MAX_GREEDY_GROUPS", 50)
    rows = [(g, int(g % 4 == 0)) for g in range(50) for _ in range(100)] + [(g, int(g % 3 == 0)) for g in range(50, 3050)]
    df = spark.createDataFrame([*rows, (None, 1)], "grp int, y int")
    got = split.group_split(df, "grp", ["y"], 0.1, 0.1, 3).collect()
    assert len(got) == len(rows) + 1 and len({(r.grp, r.split) for r in got}) == 3051
    for part, share in zip(("train", "val", "test"), (0.8, 0.1, 0.1), strict=True):
        assert abs(sum(r.split == part for r in got) - share * len(got)) <= 2
        assert abs(sum(r.split == part and r.y for r in got) - share * sum(r.y for r in got)) <= 2


def test_first_and_last_of_ties_and_nulls(spark):
    rows = [(1, None, "x"), (1, 5, "b"), (1, 5, "a"), (2, None, "q"), (2, None, "p"), (None, 1, "n")]
    df = one(spark, "k int, o int, v string", *rows).repartition(3)
    assert {(r.k, r.v) for r in gates.keep_last(df, "k", "o").collect()} == {(1, "b"), (2, "q"), (None, "n")}
    assert {(r.k, r.v) for r in gates.keep_first(df, "k", "o").collect()} == {(1, "a"), (2, "p"), (None, "n")}
    with_map = df.withColumn("m", F.create_map(F.lit("a"), F.col("v")))
    assert {(r.k, r.v) for r in gates.keep_last(with_map, "k", F.col("o")).collect()} == {(1, "b"), (2, "q"), (None, "n")}


def test_more_gates_raise(spark):
    df = one(spark, "id int, label string, truth int, parse_status string", (1, "a", 1, "ok"), (2, "a", 0, "failed"))
    with pytest.raises(gates.GateError, match="failed"):
        gates.require_complete(df)
    gates.require_complete(df.filter("id = 1"))
    gates.require_same_gold(df, df, "id")
    for other in (df.withColumn("truth", F.lit(1)), df.filter("id = 1"), df.withColumn("truth", F.when(F.col("id") == 1, 1))):
        with pytest.raises(gates.GateError):
            gates.require_same_gold(df, other, "id")
    order = one(spark, "id int, o int", (2, 0), (1, 1))
    assert [r.id for r in gates.select_in_order(df, order, "id", "o").collect()] == [2, 1]
    with pytest.raises(gates.GateError):
        gates.select_in_order(df.filter("id = 1"), order, "id", "o")


def test_split_audit(spark):
    df = one(spark, "id int, text string, grp string, split string", (1, "a", "g", "train"), (2, "a", "", "train"), (2, "b", None, "train"), (3, "c", "h", "test"))
    got = {r.split: (r.n, r.n_ids, r.n_texts, r.with_group, r.without_group) for r in split.audit(df, "id", "text", "grp").collect()}
    assert got == {"train": (3, 2, 2, 1, 2), "test": (1, 1, 1, 1, 0)}


def test_permutation_within_splits(spark):
    rows = [(i, f"{'ab'[i % 2]}{i}", i % 2) for i in range(40)]
    got = sample.permute_column(one(spark, "id int, v string, s int", *rows).repartition(3), "v", "id", "id", 5, "dealt", split="s").collect()
    assert all(r.dealt[0] == "ab"[r.s] for r in got) and sorted(r.dealt for r in got) == sorted(v for _, v, _ in rows)
    assert any(r.dealt != r.v for r in got)


def test_cuts_by_an_ordinary_join(spark, monkeypatch):
    df = spark.range(500).withColumn("g", F.col("id") % 7)
    cuts = {g: [5, 20] for g in range(7)}
    take = lambda: {tuple(r) for r in split.take_by_hash(df, "id", 3, cuts, ["a", "b", "c"], F.col("g")).collect()}
    want = take()
    monkeypatch.setattr(split, "MAX_BROADCAST_ROWS", 0)
    assert take() == want


def test_whole_rule_statuses(spark):
    cells = ["Category 1A", " category  2 ", "Not classified", "-", None, "", "NaN", "Type C", "dissolved gas", "free text", "Classification not possible"]
    got = [r.s for r in one(spark, "i int, c string", *enumerate(cells)).select("i", X.status_for_cell(F.col("c"), r"Category\s+1A").alias("s")).orderBy("i").collect()]
    assert got == [1, 0, 0, None, None, None, None, 0, 0, None, None]


def test_bootstrap_by_class_agrees(spark):
    rows = [(i, int(i % 3 > 0), int(i % 3 > 0) ^ int(i % 7 == 0), int(i % 5 > 0), int(i % 5 > 0) ^ int(i % 4 == 0), int(i % 2)) for i in range(700)]
    wide = one(spark, "id int, t_a int, p_a int, t_b int, p_b int, q_b int", *rows)
    stats = resample.row_statistics(wide, "id", ["a", "b"], lambda n: F.col(f"t_{n}"), lambda n: F.col(f"p_{n}"))
    both = [{r.metric: r for r in resample.bootstrap_ci(stats, "id", ["a", "b"], 400, by_class=c).collect()} for c in (False, True)]
    for m in resample.METRICS:
        x, y = (b[m] for b in both)
        assert x.value == pytest.approx(y.value) and x.mean == pytest.approx(y.mean, abs=0.01)
        assert x.ci95_low == pytest.approx(y.ci95_low, abs=0.02) and x.ci95_high == pytest.approx(y.ci95_high, abs=0.02)
    other = resample.row_statistics(wide, "id", ["a", "b"], lambda n: F.col(f"t_{n}"), lambda n: F.col("q_b"), "b_")
    paired = resample.row_statistics(wide, "id", ["a", "b"], lambda n: F.col(f"t_{n}"), lambda n: F.col(f"p_{n}"), "a_").join(other, "id")
    x, y = ({r.metric: r for r in resample.paired_bootstrap(paired, "id", ["a", "b"], 400, by_class=c).collect()} for c in (False, True))
    for m in resample.METRICS:
        assert x[m].delta == pytest.approx(y[m].delta) and x[m].ci95_low == pytest.approx(y[m].ci95_low, abs=0.03) and x[m].p_not_better == pytest.approx(y[m].p_not_better, abs=0.05)


def test_bootstrap_in_many_blocks_of_classes(spark, monkeypatch):
    rng = random.Random(12)
    rows = [(i, *[rng.randint(0, 1) for _ in range(4)]) for i in range(400)]
    wide = spark.createDataFrame(rows, "id int, t_a int, t_b int, p_a int, p_b int")
    stats = resample.row_statistics(wide, "id", ["a", "b"], lambda n: F.col(f"t_{n}"), lambda n: F.col(f"p_{n}"))
    whole = {r.metric: r for r in resample.bootstrap_ci(stats, "id", ["a", "b"], 2000).collect()}
    monkeypatch.setattr(resample, "CLASSES_PER_BLOCK", 3)
    parted = {r.metric: r for r in resample.bootstrap_ci(stats.repartition(5), "id", ["a", "b"], 2000).collect()}
    for m, r in parted.items():
        assert r.value == whole[m].value
        for k in ("mean", "ci95_low", "ci95_high"):
            assert abs(r[k] - whole[m][k]) < 0.15 * (whole[m].ci95_high - whole[m].ci95_low)


def test_paired_systems_need_one_truth(spark):
    wide = spark.createDataFrame([(1, 1, 0, 1, 1), (2, 0, 0, 1, 0)], "id int, t int, u int, p int, q int")
    part = lambda t, p, prefix: resample.row_statistics(wide, "id", ["x"], lambda n: F.col(t), lambda n: F.col(p), prefix)
    good = part("t", "p", "a_").join(part("t", "q", "b_"), "id")
    assert resample.paired_bootstrap(good, "id", ["x"], 50).count() == 4
    with pytest.raises(GateError, match="another truth"):
        resample.paired_bootstrap(part("t", "p", "a_").join(part("u", "q", "b_"), "id"), "id", ["x"], 50)


def test_factors_of_texts(spark):
    specs = ["cmr=2.5, stot = 3", "", None, "cmr=2,cmr=4", " , flammable=1"]
    got = [r.f for r in spark.createDataFrame([(i, s) for i, s in enumerate(specs)], "i int, s string").orderBy("i").select(sample.factor_map(F.col("s"), 2).alias("f")).collect()]
    assert got == [sample.parse_factors(s, 2) for s in specs]
    assert spark.range(1).select(sample.factor_map(F.lit("")).alias("f")).first().f == {}
    for bad in ("cmr", "nope=2", "cmr=x", "cmr=0.5"):
        with pytest.raises(Exception, match="label=factor|at least 1"):
            spark.range(1).select(sample.factor_map(F.lit(bad), 2).alias("f")).collect()


def test_factors_where_repeated_keys_are_errors(spark):
    """Sessions that the package didn't build raise on repeated map keys."""
    before = spark.conf.get("spark.sql.mapKeyDedupPolicy")
    spark.conf.set("spark.sql.mapKeyDedupPolicy", "EXCEPTION")
    try:
        specs = ["cmr=2,cmr=4", "cmr=2, stot=3,cmr = 5,stot=1.5,cmr=4"]
        got = [r.f for r in spark.createDataFrame([(i, s) for i, s in enumerate(specs)], "i int, s string").orderBy("i").select(sample.factor_map(F.col("s"), 2).alias("f")).collect()]
        assert got == [sample.parse_factors(s, 2) for s in specs]
    finally:
        spark.conf.set("spark.sql.mapKeyDedupPolicy", before)


def test_number_text(spark):
    numbers = [0.0, 0.5, -0.00099, 0.00012345678901234567, 0.0001, 9e-05, -1e-05, 1.25e-07, 3.0, 1234567.0, 12345678.5, -1e15, 1e16, 1.5e22, 1e-300, None]
    got = [r.t for r in spark.createDataFrame([(i, x) for i, x in enumerate(numbers)], "i int, x double").orderBy("i").select(X.number_text(F.col("x")).alias("t")).collect()]
    assert got == [None if x is None else repr(x) for x in numbers]
