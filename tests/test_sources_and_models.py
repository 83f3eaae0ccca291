import hashlib
import json
import os

import pandas as pd
import pytest
from pyspark.sql import functions as F

from sparloom.functions import records as R
from sparloom.functions import vocabulary as V
from sparloom.operators import hooks, ml, prepare
from sparloom.operators.gates import GateError
from sparloom.sources import documents, readers, sinks
from sparloom.streaming import landing


def test_csv_reading(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿CID,Name\n1,\"x\ny\"\n2,\n".encode())
    got = readers.read_csv(spark, str(tmp_path / "a.csv"), empty_as="").collect()
    assert [tuple(r) for r in got] == [("1", "x\ny"), ("2", "")] and got[0].__fields__[0] == "CID"
    (tmp_path / "b.csv").write_bytes("CID,Name\n1,毒性\n".encode("gb18030"))
    assert readers.guess_encoding(spark, str(tmp_path / "b.csv")) == "gb18030"
    assert readers.read_csv_any(spark, str(tmp_path / "b.csv")).first().Name == "毒性"


def test_jsonl_ids_cas(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": "1"}\n\n{"id": "2"}\n')
    assert [r.id for r in readers.read_jsonl(spark, str(tmp_path / "a.jsonl"), "id string").collect()] == ["1", "2"]
    (tmp_path / "b.jsonl").write_text("{bad\n")
    with pytest.raises(Exception):
        readers.read_jsonl(spark, str(tmp_path / "b.jsonl"), "id string").collect()
    (tmp_path / "ids.txt").write_text("12\n x\n 7 \n\n")
    assert sorted(r.cid for r in readers.read_ids(spark, str(tmp_path / "ids.txt")).collect()) == [7, 12]
    assert readers.read_ids(spark, start=3, end=5).count() == 3
    (tmp_path / "cas.tsv").write_text("50-00-0\t712\n50-00-0\t5\n50-00-0\t712\n60-00-1\t\n")
    assert {r.cas: r.cids for r in readers.read_cas_exchange(spark, str(tmp_path / "cas.tsv")).collect()} == {"50-00-0": [5, 712], "60-00-1": []}
    ids, cache = spark.createDataFrame([(1,), (2,)], "cid long"), spark.createDataFrame([(2, "x")], "cid long, v string")
    assert [r.cid for r in readers.missing_ids(ids, cache).collect()] == [1]
    spark.createDataFrame([(0, "a"), (1, "b")], "_ordinal int, ID string").write.parquet(str(tmp_path / "w.parquet"))
    assert sorted(r.nite_source_row for r in readers.read_workbook_export(spark, str(tmp_path / "w.parquet")).collect()) == [2, 3]


def test_metrics_and_checksums(spark, tmp_path):
    (tmp_path / "x_metrics.json").write_text(json.dumps({"micro_f1": 0.5}))
    os.makedirs(tmp_path / "runy")
    (tmp_path / "runy" / "metrics.json").write_text(json.dumps({"test": {"metrics": {"micro_f1": 0.7}}}))
    got = {r.run_name: r.metrics["micro_f1"] for r in readers.read_metrics(spark, [str(tmp_path / "x_metrics.json"), str(tmp_path / "runy")]).collect()}
    assert got == {"x": "0.5", "runy": "0.7"}
    sums = {r.path.rsplit("/", 1)[1]: r.sha256 for r in readers.file_checksums(spark, str(tmp_path)).collect()}
    assert sums["x_metrics.json"] == hashlib.sha256((tmp_path / "x_metrics.json").read_bytes()).hexdigest() and len(sums) == 2


def _info(name=None, text=None, number=None):
    value = {}
    if text is not None:
        value["StringWithMarkup"] = [{"String": t} for t in ([text] if isinstance(text, str) else text)]
    if number is not None:
        value["Number"] = [number]
    return {"Name": name, "Value": value}


BODY = {
    "Record": {
        "Section": [
            {
                "TOCHeading": "Safety and Hazards",
                "Section": [
                    {
                        "TOCHeading": "Hazards Identification",
                        "Section": [
                            {
                                "TOCHeading": "GHS Classification",
                                "Information": [_info("Pictogram(s)", ["Flame", ""]), _info("Signal", "Warning"), _info("Signal", "Danger"), _info("GHS Hazard Statements", ["H225: x", "H300"]), _info("Precautionary Statement Codes", "P210")],
                                "Section": [{"TOCHeading": "ECHA"}],
                            }
                        ],
                    },
                    {"TOCHeading": "Toxicity", "Section": [{"TOCHeading": "t", "Information": [_info(text="LC50 rat 4 ppm"), _info(text="IDLH 9 ppm")]}]},
                ],
            },
            {
                "TOCHeading": "Chemical and Physical Properties",
                "Section": [
                    {
                        "TOCHeading": "Experimental Properties",
                        "Section": [
                            {"TOCHeading": "Boiling Point", "Information": [_info(text="none given"), _info(text="78.5 C"), _info(text="80 C")]},
                            {"TOCHeading": "Physical Description", "Information": [_info(text="a solid"), _info(text="Liquid or gas")]},
                            {"TOCHeading": "Density", "Information": [_info(number=0.79)]},
                        ],
                    },
                    {"TOCHeading": "Computed Properties", "Information": [_info("XLogP3", number=-0.1)]},
                ],
            },
            {"TOCHeading": "Toxicity", "Section": [{"TOCHeading": "t", "Information": [_info(text="LD50 Rat oral 250 mg/kg"), _info(text="LD50 oral 9 mg/kg"), _info(text="LD50 dermal 20 mg/kg, LC50 1 ppm")]}]},
        ]
    }
}


def test_document_parsers(spark):
    df = documents.parse_json(spark.createDataFrame([(1, json.dumps(BODY)), (2, json.dumps({"Record": {}}))], "cid long, body string"), "body")
    hazards = {r.cid: r for r in documents.parse_hazards(df).collect()}
    h = hazards[1]
    assert (h.Has_GHS_Data, h.Signal_Word, h.H_Statements, h.P_Statements, h.Pictograms, h.GHS_Classifications) == (True, "Danger", "H225: x|H300", "P210", "Flame", "ECHA")
    assert hazards[2].Has_GHS_Data is False and hazards[2].Signal_Word is None
    p = {r.cid: r for r in documents.parse_properties(df).collect()}
    assert (p[1].BoilingPoint, p[1].Density, p[1].LogP, p[1].PhysicalState, p[1].Has_Physical_Data) == (78.5, 0.79, -0.1, "liquid", True)
    assert p[2].BoilingPoint is None and p[2].Has_Physical_Data is False
    t = {r.cid: r for r in documents.parse_toxicity(df).collect()}
    assert (t[1].LD50_oral, t[1].LD50_dermal, t[1].LC50_inhalation, t[1].IDLH, t[1].Toxicity_Class, t[1].Has_Toxicity_Data) == (250.0, 20.0, 4.0, 9.0, 3, True)
    assert t[2].Toxicity_Class is None


def test_stream_resumes(spark, tmp_path):
    src, out, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))
    os.makedirs(src)
    open(f"{src}/1.json", "w").write(json.dumps(BODY))
    landing.ingest(spark, src, out, ck)
    open(f"{src}/2.json", "w").write(json.dumps({"Record": {}}))
    landing.ingest(spark, src, out, ck)
    assert sorted((r.cid, r.Has_GHS_Data) for r in spark.read.parquet(out).collect()) == [(1, True), (2, False)]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(2, None), (1, "a")], "o int, v string")
    sinks.write_jsonl(df, str(tmp_path / "j"), "o")
    lines = "".join(p.read_text() for p in sorted((tmp_path / "j").glob("part-*"))).split()
    assert [json.loads(x) for x in lines] == [{"v": "a"}, {"v": None}]
    sinks.write_csv(df, str(tmp_path / "c"), ["v"], single=True)
    assert next((tmp_path / "c").glob("part-*")).read_text().split("\n")[0] == "v"
    with pytest.raises(ValueError):
        sinks.write_summary(df, str(tmp_path / "s"))
    runs = spark.createDataFrame([("a", 0.5), ("b", 0.25)], "run_name string, micro_f1 double")
    path = str(tmp_path / "board")
    sinks.save_leaderboard(spark, path, runs)
    sinks.save_leaderboard(spark, path, spark.createDataFrame([("b", 0.75)], "run_name string, micro_f1 double"))
    assert [tuple(r) for r in spark.read.parquet(path).collect()] == [("b", 0.75), ("a", 0.5)]
    wide = sinks.metric_pivot(runs, ["b", "a"], ["micro_f1"])
    assert sinks.markdown_table(wide, ["micro_f1"]).endswith("| micro_f1 | 0.2500 | 0.5000 |")
    assert [r.run_name for r in sinks.select_runs(runs, ["b", "a"]).collect()] == ["b", "a"]
    with pytest.raises(ValueError):
        sinks.select_runs(runs, ["zz"])


def test_models(spark):
    rows = [(i, float(i % 10), None, "ab"[i % 2], int(i % 10 > 4), int(i % 2)) for i in range(120)]
    df = spark.createDataFrame(rows, "id int, x double, empty double, c string, y int, z int")
    typed = ml.typed_features(df, ["x", "empty", "absent"], ["c", "Has_Physical_Data"])
    pipe = ml.feature_pipeline(typed, ["x", "empty", "absent"], ["c"])
    feats = pipe.transform(typed)
    unknown = pipe.transform(typed.limit(1).withColumn("c", F.lit("new"))).first()
    assert list(unknown.features.toArray()[1:]) == [0.0, 0.0]
    for kind in ("forest", "logistic"):
        out = ml.OneVsRest(["y", "z"], kind, trees=8).fit(feats).transform(feats)
        assert out.filter("pred_y = y and pred_z = z").count() > 110
    chain = ml.ClassifierChain(["y", "z"], trees=8).fit(feats).transform(feats)
    assert chain.filter("pred_y = y").count() > 110
    grid = ml.model_grid(feats, feats, ["y"], {"base": "features"}, ("logistic",), 4)
    assert list(grid) == ["logistic_base"]
    one = ml.OneVsRest(["k"], trees=4).fit(feats.withColumn("k", F.lit(1))).transform(feats.withColumn("k", F.lit(1)))
    assert one.filter("pred_k = 1").count() == 120


def test_hooks_and_preparation(spark):
    with pytest.raises(LookupError):
        hooks.fingerprint(F.col("x"))
    hooks.register_group_key(lambda s: s.map(lambda t: None if t == "bad" else t[:1] if t else ""))
    df = spark.createDataFrame([("bad",), ("",), ("CC",)], "s string")
    assert [r.g for r in df.select(hooks.group_key(F.col("s")).alias("g")).collect()] == ["INVALID_SMILES", "NO_SCAFFOLD", "C"]

    def answer(batches):
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "prediction_text": b["prompt"].str.upper()})

    hooks.register_generator(answer)
    got = hooks.generate(spark.createDataFrame([("1", "x")], "id string, prompt string")).first()
    assert got.prediction_text == "X"
    row = {"CID": None} | {f"label_{n}": "1" for n in V.LABELS}
    rows = [("1", "CC"), ("2", "bad"), ("3", "")]
    src = spark.createDataFrame([(a, b, *["1"] * 9) for a, b in rows], "CID string, ConnectivitySMILES string, " + ", ".join(f"{k} string" for k in row if k != "CID"))
    recs = R.build_records(src, V.SYSTEM_PROMPT)
    kept, gold, report = prepare.multitask_rows(recs, lambda c: c != "bad")
    assert [(r.id, r.smiles, r.cmr) for r in kept.collect()] == [("1", "CC", 1)] and gold.count() == 1
    assert {r.reason: (r.n, r.examples) for r in report.collect()} == {"missing": (1, "3"), "invalid": (1, "2")}
    with pytest.raises(GateError):
        prepare.predict_input(recs)
    assert prepare.predict_input(recs.filter("id = '1'")).first().smiles == "CC"


def test_leaderboard_survives_a_crash(spark, tmp_path):
    path = "file://" + str(tmp_path / "board")
    row = lambda n, f: spark.createDataFrame([(n, f)], "run_name string, micro_f1 double")
    assert sinks.read_leaderboard(spark, path) is None
    sinks.save_leaderboard(spark, path, row("a", 0.5))
    (tmp_path / "board").rename(tmp_path / "board.old")  # lost between the two renames
    sinks.save_leaderboard(spark, path, row("b", 0.7))
    assert [r.run_name for r in sinks.read_leaderboard(spark, path).collect()] == ["b", "a"]
    assert sorted(p.name for p in tmp_path.iterdir()) == ["board"]


def test_files_go_after_use(spark, tmp_path):
    from sparloom.functions.lineage import shared_folder, through_files

    t = spark.createDataFrame([(1, "x")], "a int, b string")
    seen = []
    got = through_files(spark, lambda p: (seen.append(p), t.write.parquet(p)), lambda p: spark.read.parquet(p))
    assert [tuple(r) for r in got.collect()] == [(1, "x")]
    assert seen[0].startswith(shared_folder(spark)) and not os.path.exists(seen[0].removeprefix("file://"))


def test_other_encodings_leave_the_session_alone(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("name,x\n\"中 文 \",1\n".encode("gb18030"))
    before = spark.conf.get("spark.sql.legacy.javaCharsets")
    got = readers.read_csv_any(spark, str(tmp_path / "a.csv")).collect()
    assert [tuple(r) for r in got] == [("中 文", "1")] and spark.conf.get("spark.sql.legacy.javaCharsets") == before


def test_metrics_are_found_in_turn(spark, tmp_path):
    base = "file://" + str(tmp_path)
    assert readers.find_metrics(spark, base) == []
    sinks.write_text_file(spark, f"{base}/r1/metrics.json", '{"f": 1}')
    assert [p.rsplit("/", 2)[1] for p in readers.find_metrics(spark, base)] == ["r1"]
    sinks.write_text_file(spark, f"{base}/r2/x_metrics.json", '{"f": 2}')
    assert [r.run_name for r in readers.read_metrics(spark, readers.find_metrics(spark, base)).collect()] == ["x"]
    sinks.write_text_file(spark, f"{base}/y_metrics.json", '{"f": 3}')
    assert [r.run_name for r in readers.read_metrics(spark, readers.find_metrics(spark, base)).collect()] == ["y"]


def test_frozen_transfer(spark):
    rows = [(i, str(i % 10), "a" if i % 10 > 4 else "", int(i % 10 > 4)) for i in range(80)]
    train = spark.createDataFrame(rows, "id int, x string, c string, y int")
    new = spark.createDataFrame([(1, "9", "a"), (2, "0", ""), (3, None, "unseen")], "id int, x string, c string")
    got = {r.id: r.pred_y for r in ml.frozen_transfer(train, new, ["y"], ["x"], ["c"], trees=5).collect()}
    assert got[1] == 1 and got[2] == 0 and got[3] in (0, 1)
