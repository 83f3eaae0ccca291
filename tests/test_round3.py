"""Queries on tables of odd values, held against their SQL."""

import os
import sys

from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from oracle import compare, connect  # noqa: E402

from sparloom.functions import lineage  # noqa: E402
from sparloom.operators import metrics  # noqa: E402
from sparloom.plans import contract  # noqa: E402
from sparloom.sources import sinks  # noqa: E402


def test_cues_of_small_numbers(spark, tmp_path):
    """Numbers below 1e-3 have exponents in Spark's texts, not in the SQL's."""
    values = [0.0, 0.01, 0.05, 0.09, 0.1, 0.32, 0.99, 1.0, -0.04, -0.56, -0.99, 5000.0, 3000.0]
    spark.createDataFrame([(i, x) for i, x in enumerate(values)], "s_suppkey long, s_acctbal double").write.parquet(f"{tmp_path}/supplier.parquet")
    assert compare(contract.queries()["environmental_cues"](spark, str(tmp_path)), connect(str(tmp_path)), contract.oracle_sql()["environmental_cues"]) == len(values)


def test_pivot_rounds_by_the_exact_value(spark):
    values = [0.03125, 0.09375, 0.00005, 0.00015, 0.56785, 0.1, 1.0, None]
    runs = spark.createDataFrame([(f"r{i}", x) for i, x in enumerate(values)], "run_name string, f1 double")
    (row,) = sinks.metric_pivot(runs, [f"r{i}" for i in range(len(values))] + ["absent"], ["f1"]).collect()
    assert [row[f"r{i}"] for i in range(len(values))] == [x if x is None else f"{x:.4f}" for x in values]
    assert row["absent"] is None and row["r0"] == "0.0312"


def test_short_rows_are_spread(spark):
    """A small file is one split; its rows are dealt out by their number."""
    dealt = lineage.spread(spark.range(1000).coalesce(1), "id", each=100)
    assert dealt.rdd.getNumPartitions() == 10 and dealt.count() == 1000
    assert lineage.spread(spark.range(0), "id").count() == 0


def test_each_combination_is_worked_out_once(spark):
    rows = [(i, None if i % 3 == 0 else f"k{i % 3}", i % 2) for i in range(60)]
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def work(k, n):
        seen.add(1)
        return f"{k}-{n}"

    df = spark.createDataFrame(rows, "i int, k string, n int")
    got = lineage.worked_out(df, ["k", "n"], {"w": work("k", "n")}, each=2)
    assert sorted(map(tuple, got.collect())) == [(i, k, n, f"{k}-{n}") for i, k, n in rows] and seen.value == 6


def test_flagship_deals_its_parts_first(spark, tmp_path):
    """Rows are dealt by part before 27 rows come of each."""
    spark.range(1, 60001).selectExpr("id AS p_partkey", "int(id % 50) + 1 AS p_size").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    plan = contract.queries()["flagship"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert any("hashpartitioning(p_partkey" in line and "REPARTITION_BY_NUM" in line for line in plan.split("\n"))


def test_digested_records_tell_the_same(spark):
    schema = "o int, id string, messages array<struct<role:string,content:string>>, labels struct<a:int>"
    a = spark.createDataFrame([(i, f"r{i}", [("user", f"t{i}"), ("assistant", "x")], (i % 2,)) for i in range(9)], schema)
    b = spark.createDataFrame([(i, f"r{i}", [("user", f"t{i}" if i else "other"), ("assistant", "y")], (1,)) for i in range(9)], schema)
    assert "messages" not in metrics.digested(a).columns
    for other, same in ((a, True), (b, False)):
        whole, narrow = metrics.gold_equivalence(a, other, "o", ["a"]), metrics.gold_equivalence(metrics.digested(a), metrics.digested(other), "o", ["a"])
        assert whole == narrow and whole["same_prompts"] is same
