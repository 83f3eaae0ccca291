"""Registered queries that show what weaker rows don't: quotas by label, factors from a table, all places where metrics
may lie, byte-order marks, models on noisy labels."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from sparloom.functions import text as X
from sparloom.functions import vocabulary as V
from sparloom.functions.lineage import cut, through_files
from sparloom.operators import ml, sample, split
from sparloom.plans.contract import _register, _table
from sparloom.sources import readers, sinks

# ---- splits --------------------------------------------------------------------------------------------

_MASKS_SQL = "l AS (SELECT DISTINCT doc_id, quality, toxic FROM labels), y AS (SELECT 'quality' AS label, sum(quality)::DOUBLE AS n FROM l UNION ALL SELECT 'toxic', sum(toxic) FROM l UNION ALL SELECT 'rows', count(*) FROM l)"


@_register(f"WITH {_MASKS_SQL}, s(split, share) AS (VALUES ('train', 0.8), ('val', 0.1), ('test', 0.1)) SELECT split, label, round(n * share, 6) AS wanted, true AS kept FROM y, s")
def stratified_quotas(spark, sf_dir):
    """How many rows of each label a split wants, and whether it has them up to two."""
    docs = _table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic").distinct()
    done = cut(split.stratified_split(docs, "doc_id", ["quality", "toxic"], 0.1, 0.1, 123))
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("label"), c.cast("long").alias("v")) for n, c in (("quality", F.col("quality")), ("toxic", F.col("toxic")), ("rows", F.lit(1)))])).alias("r")
    counted = done.select("split", each).select("split", "r.*").groupBy("split", "label").agg(F.sum("v").alias("n"))
    totals = counted.groupBy("label").agg(F.sum("n").alias("all"))
    wanted = F.col("all") * F.when(F.col("split") == "train", 0.8).otherwise(0.1)
    return counted.join(totals, "label").select("split", "label", F.round(wanted, 6).alias("wanted"), (F.abs(F.col("n") - wanted) <= 2).alias("kept"))


# ---- samples -------------------------------------------------------------------------------------------

_NAMES = ("cmr", "stot", "oxidizing", "flammable", "corrosive")
_NAMES = tuple(n for n in _NAMES if n in V.LABELS)
_SPEC_SQL = "' ' || list_extract(" + str(list(_NAMES)) + f", (p_partkey % {len(_NAMES)} + 1)::INT) || ' = ' || (1 + p_size / 10.0) || ',, ' || list_extract(" + str(list(_NAMES)) + f", (p_size % {len(_NAMES)} + 1)::INT) || '=' || (2 + p_partkey % 3)"


@_register(
    f"""WITH s AS (SELECT p_partkey, list_extract({list(_NAMES)}, (p_partkey % {len(_NAMES)} + 1)::INT) AS a, (1 + p_size / 10.0)::DOUBLE AS x, list_extract({list(_NAMES)}, (p_size % {len(_NAMES)} + 1)::INT) AS b, (2 + p_partkey % 3)::DOUBLE AS y FROM part),
f AS (SELECT p_partkey, unnest({list(V.RARE_LABELS)}) AS label, 1.5::DOUBLE AS factor, 0 AS nth FROM s UNION ALL SELECT p_partkey, a, x, 1 FROM s UNION ALL SELECT p_partkey, b, y, 2 FROM s)
SELECT p_partkey, label, round(arg_max(factor, nth), 6) AS factor FROM f GROUP BY p_partkey, label"""
)
def replay_specs(spark, sf_dir):
    """Factors by label of a text for each part, over a uniform one; of two for a label the later one holds."""
    name = lambda c: F.element_at(F.array(*[F.lit(n) for n in _NAMES]), (c % len(_NAMES) + 1).cast("int"))
    p, size = F.col("p_partkey"), F.col("p_size")
    spec = F.concat(F.lit(" "), name(p), F.lit(" = "), (1 + size / F.lit(10.0)).cast("string"), F.lit(",, "), name(size), F.lit("="), (2 + p % 3).cast("string"))
    found = _table(spark, sf_dir, "part").select("p_partkey", F.explode(sample.factor_map(spec, 1.5)).alias("label", "factor"))
    return found.withColumn("factor", F.round("factor", 6))


# ---- files ---------------------------------------------------------------------------------------------


@_register("SELECT CASE n_nationkey % 3 WHEN 0 THEN 'here' WHEN 1 THEN 'below' ELSE 'named by folder' END AS place, n_name AS run_name, (n_nationkey / 100.0)::DOUBLE AS micro_f1 FROM nation")
def metrics_places(spark, sf_dir):
    """Metric files in a folder, in folders below it, and such that bear their folder's name."""
    runs = _table(spark, sf_dir, "nation").select("n_nationkey", "n_name").collect()  # 25 rows
    forms = {"here": "{}_metrics.json", "below": "runs/{}_metrics.json", "named by folder": "{}/metrics.json"}

    def write(path):
        for r in runs:
            place = list(forms)[r["n_nationkey"] % 3]
            sinks.write_text_file(spark, f"{path}/{place.replace(' ', '-')}/{forms[place].format(r['n_name'])}", json.dumps({"micro_f1": r["n_nationkey"] / 100}))

    def read(path):
        parts = [readers.read_metrics(spark, readers.find_metrics(spark, f"{path}/{place.replace(' ', '-')}")).withColumn("place", F.lit(place)) for place in forms]
        return parts[0].unionByName(parts[1]).unionByName(parts[2])

    return through_files(spark, write, read).select("place", "run_name", F.col("metrics")["micro_f1"].cast("double").alias("micro_f1"))


@_register("SELECT c_custkey::VARCHAR AS c_custkey, c_name || ' é' AS name, true AS marked FROM customer")
def csv_mark(spark, sf_dir):
    """Every file begins with a byte-order mark, which is no part of the first header when it is read."""
    t = _table(spark, sf_dir, "customer").select("c_custkey", F.concat("c_name", F.lit(" é")).alias("name"))

    def read(path):
        files = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(path)
        marked = files.agg(F.every(F.hex(F.substring("content", 1, 3)) == "EFBBBF").alias("marked"))  # one row
        return readers.read_csv(spark, path).crossJoin(F.broadcast(marked))

    return through_files(spark, lambda p: sinks.write_csv(t, p, mark=True), read)


# ---- models --------------------------------------------------------------------------------------------


@_register(
    """WITH l AS (SELECT p_partkey, ((p_size > 25) <> (('0x' || substr(md5('a:' || p_partkey), 1, 8))::BIGINT % 10 = 0))::INT AS a, ((p_partkey % 2 = 1) <> (('0x' || substr(md5('b:' || p_partkey), 1, 8))::BIGINT % 10 = 0))::INT AS b,
(('0x' || substr(md5('c:' || p_partkey), 1, 8))::BIGINT % 2)::INT AS c, ('0x' || substr(md5('t:' || p_partkey), 1, 8))::BIGINT % 4 = 0 AS held_out FROM part)
SELECT model, label, count(*) AS n, sum(truth)::BIGINT AS n_pos, label <> 'c' AS informed FROM (SELECT 'a' AS label, a AS truth FROM l WHERE held_out UNION ALL SELECT 'b', b FROM l WHERE held_out UNION ALL SELECT 'c', c FROM l WHERE held_out),
(VALUES ('forest'), ('logistic'), ('chain'), ('frozen')) m(model) GROUP BY model, label"""
)
def noisy_models(spark, sf_dir):
    """Models on labels that are wrong in a tenth of the rows, and on one that nothing tells: right in more than 70 % of the
    rows that they haven't seen where there is something to know, and in no more where there isn't."""
    p = F.col("p_partkey")
    wrong = lambda name: X.hashed_int(name, p) % 10 == 0
    labels = {"a": (F.col("p_size") > 25) != wrong("a"), "b": (p % 2 == 1) != wrong("b"), "c": X.hashed_int("c", p) % 2 == 1}
    raw = _table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("string").alias("x"), F.when(p % 2 == 1, "odd").otherwise("").alias("k"), *[v.cast("int").alias(n) for n, v in labels.items()], (X.hashed_int("t", p) % 4 == 0).alias("held_out"))
    train, test = raw.filter("not held_out"), raw.filter("held_out")
    typed = [ml.typed_features(d, ["x"], ["k"]) for d in (train, test)]
    pipeline = ml.feature_pipeline(typed[0], ["x"], ["k"])
    made = [cut(pipeline.transform(t).select("p_partkey", *labels, "features")) for t in typed]
    models = {"forest": ml.OneVsRest(list(labels), "forest", trees=3), "logistic": ml.OneVsRest(list(labels), "logistic"), "chain": ml.ClassifierChain(list(labels), trees=3)}
    found = {n: m.fit(made[0]).transform(made[1]) for n, m in models.items()}
    found["frozen"] = ml.frozen_transfer(train, test.drop(*labels), list(labels), ["x"], ["k"], kind="logistic").join(test.select("p_partkey", *labels), "p_partkey")
    parts = None
    for name, said in found.items():
        each = said.select(F.explode(F.array(*[F.struct(F.lit(n).alias("label"), F.col(n).alias("truth"), F.col(f"pred_{n}").alias("pred")) for n in labels])).alias("r")).select("r.*")
        one = each.groupBy("label").agg(F.lit(name).alias("model"), F.count(F.lit(1)).alias("n"), F.sum("truth").cast("long").alias("n_pos"), (F.avg((F.col("truth") == F.col("pred")).cast("double")) > 0.7).alias("informed"))
        parts = one if parts is None else parts.unionByName(one)
    return parts
