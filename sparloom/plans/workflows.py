"""Further registered queries: files written and read back, documents parsed, members validated, joins that keep
or count what doesn't match, audits, tables for outside models.  As in ``contract``, each has an equivalent SQL."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from sparloom.functions import records as R
from sparloom.functions import text as X
from sparloom.functions import vocabulary as V
from sparloom.functions.lineage import cut, spread, through_files, worked_out
from sparloom.operators import ensemble, gates, hooks, integrate, metrics, ml, prepare, sample, split
from sparloom.plans.contract import _COUNTS, _GOLD_SQL, _MEMBERS_SQL, _gold, _h, _members, _register, _rounded, _status_sql, _table
from sparloom.sources import documents, readers, sinks
from sparloom.streaming import landing

# ---- files ---------------------------------------------------------------------------------------------

_ODD_NAME = "c_name || ', \"' || c_mktsegment || '\"' || chr(10) || 'second  line'"


def _odd_names(spark, sf_dir):
    t = _table(spark, sf_dir, "customer")
    return t.select("c_custkey", F.concat("c_name", F.lit(', "'), "c_mktsegment", F.lit('"\nsecond  line')).alias("name"), "c_acctbal")


@_register(f"SELECT c_custkey::VARCHAR AS c_custkey, {_ODD_NAME} AS name, c_acctbal::DOUBLE::VARCHAR AS c_acctbal FROM customer")
def csv_raw(spark, sf_dir):
    t = _odd_names(spark, sf_dir).withColumn("c_acctbal", F.col("c_acctbal").cast("double").cast("string"))
    return through_files(spark, lambda p: sinks.write_csv(t, p), lambda p: readers.read_csv(spark, p, empty_as=""))


@_register(f"SELECT c_custkey, {_ODD_NAME} AS name, c_acctbal::DOUBLE AS c_acctbal FROM customer")
def csv_typed(spark, sf_dir):
    t = _odd_names(spark, sf_dir)
    return through_files(spark, lambda p: sinks.write_csv(t, p, ["c_custkey", "name", "c_acctbal"], single=True), lambda p: readers.read_csv(spark, p, "c_custkey bigint, name string, c_acctbal double"))


@_register("SELECT c_custkey::VARCHAR AS c_custkey, c_name || ' é second, line' AS name FROM customer")
def csv_fallback(spark, sf_dir):
    t = _table(spark, sf_dir, "customer").select("c_custkey", F.concat("c_name", F.lit(" é \n second,   line ")).alias("name"))
    return through_files(spark, lambda p: sinks.write_csv(t, p, encoding="iso-8859-1"), lambda p: readers.read_csv_any(spark, p))


@_register("SELECT doc_id, text, nullif(source, '') AS source FROM documents")
def jsonl_round_trip(spark, sf_dir):
    t = _table(spark, sf_dir, "documents").select("doc_id", "text", F.nullif("source", F.lit("")).alias("source"))
    return through_files(spark, lambda p: sinks.write_jsonl(t.withColumn("_o", F.col("doc_id")), p, order="_o"), lambda p: readers.read_jsonl(spark, p, "doc_id bigint, text string, source string"))


@_register("SELECT c_name AS name, c_custkey + 1 AS nite_source_row FROM customer")
def workbook_rows(spark, sf_dir):
    t = _table(spark, sf_dir, "customer").select(F.col("c_name").alias("name"), (F.col("c_custkey") - 1).alias("_ordinal"))
    return through_files(spark, lambda p: t.write.parquet(f"{p}/sheet.parquet"), lambda p: readers.read_workbook_export(spark, f"{p}/sheet.parquet"))


@_register("SELECT c_custkey AS cid FROM customer UNION ALL SELECT unnest(range(5, 21))")
def id_lists(spark, sf_dir):
    line = F.explode(F.array(F.concat(F.lit(" "), F.col("c_custkey").cast("string")), F.concat(F.lit("x"), F.col("c_custkey").cast("string")), F.lit("")))
    t = _table(spark, sf_dir, "customer").select(line)
    return through_files(spark, lambda p: t.write.text(p), lambda p: readers.read_ids(spark, p).union(readers.read_ids(spark, start=5, end=20)))


@_register("SELECT count(*) AS n, count_if(n_chars > 2000)::BIGINT AS long, NULL::BIGINT AS absent FROM documents")
def summary_file(spark, sf_dir):
    t = _table(spark, sf_dir, "documents").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("n_chars") > 2000).alias("long"), F.lit(None).cast("bigint").alias("absent"))
    return through_files(spark, lambda p: sinks.write_summary(t, f"{p}/summary.json"), lambda p: spark.read.schema(t.schema).option("multiLine", True).json(f"{p}/summary.json"))


@_register("SELECT sha256(string_agg(n_name, chr(10) ORDER BY n_nationkey)) AS sha256, length(string_agg(n_name, chr(10) ORDER BY n_nationkey))::BIGINT AS bytes, 'nations.txt' AS file FROM nation")
def file_digests(spark, sf_dir):
    names = "\n".join(r[0] for r in _table(spark, sf_dir, "nation").orderBy("n_nationkey").select("n_name").collect())  # 25 rows
    found = through_files(spark, lambda p: sinks.write_text_file(spark, f"{p}/a/nations.txt", names), lambda p: readers.file_checksums(spark, p))
    return found.select("sha256", "bytes", F.element_at(F.split("path", "/"), -1).alias("file"))


@_register("SELECT r_name AS run_name, r_regionkey / 10 AS micro_f1 FROM region")
def metrics_scan(spark, sf_dir):
    """Half of the runs' metrics are nested under test."""
    runs = _table(spark, sf_dir, "region").select("r_regionkey", "r_name").collect()  # 5 rows

    def write(path):
        for r in runs:
            flat = {"micro_f1": r["r_regionkey"] / 10}
            sinks.write_text_file(spark, f"{path}/{r['r_name']}/metrics.json", json.dumps(flat if r["r_regionkey"] % 2 else {"test": {"metrics": flat}}))

    found = through_files(spark, write, lambda p: readers.read_metrics(spark, readers.find_metrics(spark, p)))
    return found.select("run_name", F.col("metrics")["micro_f1"].cast("double").alias("micro_f1"))


# ---- nested documents ----------------------------------------------------------------------------------


def _info(name, *texts, number=None):
    value = {"StringWithMarkup": [{"String": t} for t in texts]} if number is None else {"Number": [number]}
    return {"Name": name, "Value": value}


def _body(k, sections):
    """JSON by template: ``{name}`` in a text stands for a column."""
    out = F.lit(json.dumps({"Record": {"Section": sections}}, ensure_ascii=False))
    for name, value in k.items():
        out = F.replace(out, F.lit("{" + name + "}"), value.cast("string"))
    return out


def _documents(spark, sf_dir):
    """A document of hazards, properties and toxicity for each part; one in five lacks all sections."""
    p = F.col("p_partkey")
    ghs = {
        "TOCHeading": "GHS Classification",
        "Information": [_info("Pictogram(s)", "", "Flame {size}"), _info("Signal", "Danger"), _info("Signal", "Warning {size}"), _info("GHS Hazard Statements", "H{code}: heat", "H300 {name}"), _info("Precautionary Statement Codes", "P210")],
        "Section": [{"TOCHeading": "Part {size}"}, {"TOCHeading": ""}],
    }
    hazards = {"TOCHeading": "Safety and Hazards", "Section": [{"TOCHeading": "Hazards Identification", "Section": [ghs]}, {"TOCHeading": "Toxicity", "Section": [{"Information": [_info("a", "IDLH {size} ppm")]}]}]}
    experimental = {
        "TOCHeading": "Experimental Properties",
        "Section": [
            {"TOCHeading": "Boiling Point", "Information": [_info("b", "unknown"), _info("b", "{size}.5 °C at 760"), _info("b", "999")]},
            {"TOCHeading": "Flash Point", "Information": [_info("f", number=-3.5)]},
            {"TOCHeading": "Physical Description", "Information": [_info("d", "Clear LIQUID"), _info("d", "white powder or gas")]},
        ],
    }
    chemical = {"TOCHeading": "Chemical and Physical Properties", "Section": [experimental, {"TOCHeading": "Computed Properties", "Information": [_info("XLogP3", number=1.25)]}]}
    toxicity = {"TOCHeading": "Toxicity", "Section": [{"TOCHeading": "Acute", "Information": [_info("t", "LD50 oral rat {code} mg/kg"), _info("t", "LD50 oral mouse 1 mg/kg"), _info("t", "LC50 {size} mg/L"), _info("t", "LD50 dermal none")]}]}
    k = {"size": F.col("p_size"), "code": 200 + p % 220, "name": F.col("p_name")}
    body = F.when(p % 5 == 0, F.lit('{"Record": {"Section": []}}')).otherwise(_body(k, [hazards, chemical, toxicity]))
    return spread(_table(spark, sf_dir, "part"), "p_partkey").select(p.alias("cid"), body.alias("body"))


_FULL = "p_partkey % 5 <> 0"
_HAZARDS_SQL = f"""{_FULL} AS Has_GHS_Data, CASE WHEN {_FULL} THEN 'Warning ' || p_size END AS Signal_Word, CASE WHEN {_FULL} THEN 'Part ' || p_size ELSE '' END AS GHS_Classifications,
CASE WHEN {_FULL} THEN 'H' || (200 + p_partkey % 220) || ': heat|H300 ' || p_name ELSE '' END AS H_Statements, CASE WHEN {_FULL} THEN 'P210' ELSE '' END AS P_Statements, CASE WHEN {_FULL} THEN 'Flame ' || p_size ELSE '' END AS Pictograms"""
_PROPERTIES_SQL = f"""CASE WHEN {_FULL} THEN p_size + 0.5::DOUBLE END AS BoilingPoint, NULL::DOUBLE AS MeltingPoint, CASE WHEN {_FULL} THEN -3.5::DOUBLE END AS FlashPoint, NULL::DOUBLE AS VaporPressure, NULL::DOUBLE AS Density, NULL::DOUBLE AS WaterSolubility,
CASE WHEN {_FULL} THEN 1.25::DOUBLE END AS LogP, CASE WHEN {_FULL} THEN 'gas' END AS PhysicalState, {_FULL} AS Has_Physical_Data"""
_ORAL = "(200 + p_partkey % 220)"
_TOXICITY_SQL = f"""CASE WHEN {_FULL} THEN {_ORAL}::DOUBLE END AS LD50_oral, NULL::DOUBLE AS LD50_dermal, CASE WHEN {_FULL} THEN p_size::DOUBLE END AS LC50_inhalation, CASE WHEN {_FULL} THEN p_size::DOUBLE END AS IDLH, {_FULL} AS Has_Toxicity_Data,
CASE WHEN {_FULL} THEN CASE WHEN {_ORAL} <= 300 THEN 3 ELSE 4 END END AS Toxicity_Class"""


@_register(f"SELECT p_partkey AS cid, {_HAZARDS_SQL} FROM part")
def parse_hazards(spark, sf_dir):
    return documents.parse_hazards(documents.parse_json(_documents(spark, sf_dir), "body"))


@_register(f"SELECT p_partkey AS cid, {_PROPERTIES_SQL} FROM part")
def parse_properties(spark, sf_dir):
    return documents.parse_properties(documents.parse_json(_documents(spark, sf_dir), "body"))


@_register(f"SELECT p_partkey AS cid, {_TOXICITY_SQL} FROM part")
def parse_toxicity(spark, sf_dir):
    return documents.parse_toxicity(documents.parse_json(_documents(spark, sf_dir), "body"))


@_register(f"SELECT p_partkey AS cid, {_HAZARDS_SQL}, {_PROPERTIES_SQL}, {_TOXICITY_SQL} FROM part JOIN nation ON p_partkey = n_nationkey + 1")
def landed_ingest(spark, sf_dir):
    """Documents landed as files, one for each nation, read as a stream in two runs."""
    few = _documents(spark, sf_dir).join(_table(spark, sf_dir, "nation").select((F.col("n_nationkey") + 1).alias("cid")), "cid").orderBy("cid").collect()  # 25 rows

    def write(path):
        for half in (few[:10], few[10:]):
            for r in half:
                sinks.write_text_file(spark, f"{path}/landed/{r['cid']}.json", r["body"])
            landing.ingest(spark, f"{path}/landed", f"{path}/table", f"{path}/progress", tuple(landing.PARSERS))

    return through_files(spark, write, lambda p: spark.read.parquet(f"{p}/table"))


# ---- tri-state labels over the whole rule table -----------------------------------------------------------

_CELLS = ("Category 1A", "Category 1", "category 2", "Not classified", "-", None, "Type B", "Compressed gas", "Classification not possible", "free text", "Category 3 (oral)", "")
_HEADERS = list(dict.fromkeys(h for parts in V.TRI_STATE_RULES.values() for h, _ in parts))


def _rule_sql() -> str:
    cell = lambda i: "CASE (l_partkey * 7 + l_suppkey * " + str(i + 1) + f" + {i}) % {len(_CELLS)} " + " ".join(f"WHEN {j} THEN '{t}'" for j, t in enumerate(_CELLS) if t is not None) + " END"
    cells = ", ".join(f"{cell(i)} AS c{i}" for i in range(len(_HEADERS)))
    statuses, labels = [], []
    for name, parts in V.TRI_STATE_RULES.items():
        own = []
        for h, pattern in parts:
            i = _HEADERS.index(h)
            statuses.append(f"{_status_sql(f'c{i}', pattern)} AS s_{name}_{i}")
            own.append((f"s_{name}_{i}", f"c{i}", h))
        one, zero = " OR ".join(f"{s} = 1" for s, _, _ in own), " AND ".join(f"{s} = 0" for s, _, _ in own)
        said = " || ' | ' || ".join(f"'{h}=' || coalesce(nullif({c}, ''), '<blank>')" for _, c, h in own)
        labels += [f"CASE WHEN {one} THEN 1 WHEN {zero} THEN 0 END AS {name}", f"{said} AS evidence_{name}"]
    return f"WITH c AS (SELECT l_orderkey, l_linenumber, {cells} FROM lineitem), s AS (SELECT *, {', '.join(statuses)} FROM c) SELECT l_orderkey, l_linenumber, {', '.join(labels)} FROM s"


@_register(_rule_sql())
def tri_state_rules(spark, sf_dir):
    def cell(i):
        n = (F.col("l_partkey") * 7 + F.col("l_suppkey") * (i + 1) + i) % len(_CELLS)
        return F.get(F.array(*[F.lit(t) for t in _CELLS]), n.cast("int"))

    t = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.array(*[cell(i) for i in range(len(_HEADERS))]).alias("cells"))
    found = X.tri_state_labels(lambda h: F.col("cells")[_HEADERS.index(h)])
    columns = {n: c for name, s, e in found for c, n in ((s, name), (e, f"evidence_{name}"))}
    return worked_out(t, ["cells"], columns).drop("cells")


# ---- records -------------------------------------------------------------------------------------------


def _compounds(spark, sf_dir):
    p = F.col("p_partkey")
    label = lambda i: F.when((p + i) % (i + 2) == 0, "1").otherwise("0")
    return spread(_table(spark, sf_dir, "part"), "p_partkey").select(
        p.cast("string").alias("CID"), F.when(p % 9 != 0, F.concat(F.lit("C"), F.col("p_size").cast("string"))).alias("ConnectivitySMILES"), F.col("p_name").alias("IUPACName"), F.when(p % 3 == 0, "nan").otherwise("H2O").alias("MolecularFormula"),
        (F.col("p_size") / 2).cast("string").alias("XLogP"), F.col("p_brand").alias("H_Statements"), F.lit("soil").alias("NonHCode_Evidence_Summary"), *[label(i).alias(f"label_{n}") for i, n in enumerate(V.LABELS)],
    )


_LABEL_SQL = {n: f"((p_partkey + {i}) % {i + 2} = 0)::INT" for i, n in enumerate(V.LABELS)}
_LINES_SQL = "CASE WHEN p_partkey % 9 <> 0 THEN '- ConnectivitySMILES: C' || p_size END, '- IUPACName: ' || p_name, CASE WHEN p_partkey % 3 <> 0 THEN '- MolecularFormula: H2O' END"
_JOINED = lambda *parts: "array_to_string(list_filter([" + ", ".join(parts) + "], lambda x: x IS NOT NULL), chr(10))"
_HEAD_SQL = ", ".join(f"'{t}'" for t in V.PROMPT_HEAD)
_XLOGP_SQL = "(p_size / 2)::DOUBLE"
_CUES_SQL = (
    "'" + V.BLOCK_TITLES["cues"] + "', '- Contains halogenated organic structure: ' || CASE WHEN h THEN 'yes' ELSE 'no' END, '- Contains halogenated aromatic structure: ' || CASE WHEN h AND a THEN 'yes' ELSE 'no' END, "
    f"'- High hydrophobicity proxy XLogP >= 3: ' || CASE WHEN {_XLOGP_SQL} >= 3 THEN 'yes' ELSE 'no' END, '- Very high hydrophobicity proxy XLogP >= 5: ' || CASE WHEN {_XLOGP_SQL} >= 5 THEN 'yes' ELSE 'no' END, "
    "'- Low water solubility proxy <= 1: no', '- Contains organometal/metalloid element: no'"
)
_WORDS_SQL = "lower(concat_ws(' ', CASE WHEN p_partkey % 9 <> 0 THEN 'C' || p_size ELSE '' END, p_name, CASE WHEN p_partkey % 3 <> 0 THEN 'H2O' ELSE '' END))"
_ANY_SQL = lambda words: "(" + " OR ".join(f"contains({_WORDS_SQL}, '{w}')" for w in words) + ")"
_RECORD_SQL = f"""p AS (SELECT *, {_ANY_SQL(V.HALOGEN_WORDS)} AS h, {_ANY_SQL(V.AROMATIC_WORDS)} AS a FROM part),
r AS (SELECT p_partkey, {_JOINED(_HEAD_SQL, "'- CID: ' || p_partkey", _LINES_SQL, f"'- XLogP: ' || {_XLOGP_SQL}", "'" + V.BLOCK_TITLES['evidence'] + "'", "'- H_Statements: ' || p_brand", "'" + V.BLOCK_TITLES['other'] + "'", "'- NonHCode_Evidence_Summary: soil'", _CUES_SQL, "'" + V.BLOCK_TITLES['rubric'] + "'", ", ".join(f"'{x}'" for x in V.RUBRIC_LINES), "'Return only JSON.'")} AS prompt,
'{{' || {" || ', ' || ".join(f"'\"{n}\": ' || {_LABEL_SQL[n]}" for n in sorted(V.LABELS))} || '}}' AS answer FROM p)"""


def _records(spark, sf_dir):
    return R.build_records(_compounds(spark, sf_dir), V.SYSTEM_PROMPT, evidence=V.EVIDENCE_FIELDS, other=V.OTHER_EVIDENCE_FIELDS, cues=True, rubric=V.RUBRIC_LINES)


@_register(f"WITH {_RECORD_SQL} SELECT p_partkey::VARCHAR AS id, '{V.SYSTEM_PROMPT}' AS system, prompt, answer, {', '.join(f'{q} AS {n}' for n, q in _LABEL_SQL.items())} FROM r JOIN part USING (p_partkey)")
def record_build(spark, sf_dir):
    turn = lambda i: F.col("messages")[i]["content"]
    return _records(spark, sf_dir).select("id", turn(0).alias("system"), turn(1).alias("prompt"), turn(2).alias("answer"), *[F.col(f"labels.{n}").alias(n) for n in V.LABELS])


@_register(f"SELECT p_partkey::VARCHAR AS id, {_JOINED(_HEAD_SQL, chr(39) + '- CID: ' + chr(39) + ' || p_partkey', _LINES_SQL, chr(39) + '- XLogP: ' + chr(39) + ' || ' + _XLOGP_SQL, chr(39) + V.PROMPT_TAIL + chr(39))} AS prompt FROM part")
def external_prompts(spark, sf_dir):
    t = _compounds(spark, sf_dir)
    return t.select(F.col("CID").alias("id"), R.external_prompt(t.columns).alias("prompt"))


@_register(
    """WITH l AS (SELECT doc_id, quality, toxic FROM labels) SELECT doc_id, CASE WHEN doc_id % 4 = 3 THEN 1 - quality ELSE quality END AS quality, toxic FROM l"""
)
def label_cascade(spark, sf_dir):
    """Labels come as a struct, as an object in a text, and in the last assistant turn; incomplete ones are passed over."""
    d, q, t = F.col("doc_id"), F.col("quality"), F.col("toxic")
    said = lambda a: F.format_string('{"quality": %d, "toxic": %d}', a, t)
    turns = F.array(*[F.struct(F.lit("assistant").alias("role"), x.alias("content")) for x in (F.lit('{"quality": 1, "toxic": 1}'), said(1 - q))])
    rows = _table(spark, sf_dir, "labels").select(
        "doc_id",
        F.when(d % 4 == 0, F.struct(q.alias("quality"), t.alias("toxic"))).alias("labels"),
        F.when(d % 4 == 1, F.concat(F.lit("Well: "), said(q), F.lit(" done"))).when(d % 4 == 3, '{"quality": 1}').alias("output"),
        F.when(d % 4 == 2, F.to_json(F.struct(q.alias("quality"), t.alias("toxic")))).alias("response"),
        F.when(d % 4 == 3, turns).alias("messages"),
    )
    return rows.select("doc_id", R.labels_cascade(rows, ["quality", "toxic"]).alias("l")).select("doc_id", "l.quality", "l.toxic")


def _plain_records(spark, sf_dir):
    return R.build_records(_compounds(spark, sf_dir), V.SYSTEM_PROMPT, with_answer=False)


_VALID_SQL = "p_partkey % 9 <> 0 AND p_size % 7 <> 0"



@_register(f"SELECT p_partkey::VARCHAR AS id, 'C' || p_size AS smiles, {', '.join(f'{q} AS {n}' for n, q in _LABEL_SQL.items())} FROM part WHERE {_VALID_SQL}")
def multitask_table(spark, sf_dir):
    with hooks.given(validity=lambda s: s.map(lambda x: bool(x) and int(x[1:]) % 7 != 0)):
        return prepare.multitask_rows(_plain_records(spark, sf_dir), hooks.is_valid)[0]


@_register(f"SELECT CASE WHEN p_partkey % 9 = 0 THEN 'missing' ELSE 'invalid' END AS reason, count(*) AS n, array_to_string(list_slice(list_sort(list(p_partkey::VARCHAR)), 1, 20), ',') AS examples FROM part WHERE NOT ({_VALID_SQL}) GROUP BY 1")
def multitask_report(spark, sf_dir):
    with hooks.given(validity=lambda s: s.map(lambda x: bool(x) and int(x[1:]) % 7 != 0)):
        return prepare.multitask_rows(_plain_records(spark, sf_dir), hooks.is_valid)[2]


@_register("SELECT p_partkey::VARCHAR AS id, 'C' || p_size AS smiles FROM part")
def predict_input(spark, sf_dir):
    t = _compounds(spark, sf_dir).withColumn("ConnectivitySMILES", F.concat(F.lit("C"), F.split(F.col("XLogP"), "x")[0])).drop("ConnectivitySMILES")
    whole = t.join(_table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("CID"), F.concat(F.lit("C"), F.col("p_size").cast("string")).alias("ConnectivitySMILES")), "CID")
    return prepare.predict_input(R.build_records(whole, V.SYSTEM_PROMPT, with_answer=False))


@_register("SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 'INVALID_SMILES' WHEN p_size % 5 = 1 THEN 'NO_SCAFFOLD' ELSE 'ring' || (p_size % 5) END AS scaffold FROM part")
def scaffold_keys(spark, sf_dir):
    with hooks.given(group_key=lambda s: s.map(lambda x: None if int(x) % 5 == 0 else "" if int(x) % 5 == 1 else f"ring{int(x) % 5}")):
        return _table(spark, sf_dir, "part").select("p_partkey", hooks.group_key(F.col("p_size").cast("string")).alias("scaffold"))


@_register("SELECT p_partkey, (p_size % 2)::DOUBLE AS b0, (p_size // 2 % 2)::DOUBLE AS b1, (p_size // 4 % 2)::DOUBLE AS b2 FROM part")
def structure_bits(spark, sf_dir):
    with hooks.given(fingerprint=lambda s: s.map(lambda x: [float(int(x) >> i & 1) for i in range(3)])):
        t = _table(spark, sf_dir, "part").select("p_partkey", hooks.fingerprint(F.col("p_size").cast("string")).alias("f"))
        return t.select("p_partkey", *[F.col("f")[i].cast("double").alias(f"b{i}") for i in range(3)])


@_register("SELECT doc_id::VARCHAR AS id, 'len ' || n_chars AS prediction_text FROM documents")
def generated_answers(spark, sf_dir):
    def answer(batches):
        for b in batches:
            yield b[["id"]].assign(prediction_text="len " + b["prompt"])

    with hooks.given(generator=answer):
        return hooks.generate(_table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("n_chars").cast("string").alias("prompt")))


# ---- joins ---------------------------------------------------------------------------------------------


@_register(
    """WITH b AS (SELECT o_custkey, arg_max(o_totalprice, o_orderkey) AS price, max(o_orderkey) AS o_orderkey FROM orders GROUP BY 1)
SELECT o_custkey, o_orderkey, price, coalesce(c_mktsegment, 'none') AS c_mktsegment, coalesce(c_acctbal, 0) AS c_acctbal FROM b LEFT JOIN (SELECT c_custkey, c_mktsegment, c_acctbal FROM customer) ON c_custkey = o_custkey"""
)
def lookup_merge_last(spark, sf_dir):
    """Both sides take the last row of a key; a subset of the right one's columns, with defaults."""
    orders = _table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.col("o_totalprice").alias("price"))
    customers = _table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "o_custkey")
    return integrate.lookup_merge(orders, customers, "o_custkey", "c_name", {"c_mktsegment": "none", "c_acctbal": 0.0}, ["c_mktsegment", "c_acctbal"], base_order="o_orderkey")


@_register("WITH g AS (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY 1) SELECT doc_id, quality, n_chars FROM g JOIN documents USING (doc_id)")
def gold_join(spark, sf_dir):
    """Every gold row has a prediction, repeated ones take the last, further predictions go."""
    gold = _table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    docs = _table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    twice = docs.withColumn("_n", F.lit(1)).unionByName(docs.withColumns({"n_chars": F.lit(-1).cast("bigint"), "_n": F.lit(0)}))
    return gates.align_gold(gold.withColumn("_n", F.lit(0)), twice, "doc_id", "_n").select("doc_id", "quality", "n_chars")


@_register("SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN c_name ELSE (row_number() OVER (ORDER BY c_custkey) - 1)::VARCHAR END AS id FROM customer")
def row_ids(spark, sf_dir):
    """Rows without an id are known by their place."""
    k = F.col("c_custkey") % 3
    t = _table(spark, sf_dir, "customer").select("c_custkey", F.when(k == 0, F.col("c_name")).when(k == 1, " ").alias("id"))
    return gates.with_row_ids(t, "id", "c_custkey")


@_register(
    "SELECT c_custkey, o_orderkey, (SELECT count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)) AS missing, (SELECT count(DISTINCT o_custkey) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)) AS extra "
    "FROM customer JOIN (SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY 1) ON o_custkey = c_custkey"
)
def matched_join(spark, sf_dir):
    orders = _table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min("o_orderkey").alias("o_orderkey"))
    joined, counts = gates.align_matched(_table(spark, sf_dir, "customer").select("c_custkey"), orders, "c_custkey")
    return joined.withColumns({k: F.lit(n).cast("bigint") for k, n in counts.items()})


@_register("SELECT c_custkey AS position, c_name AS name, c_mktsegment AS segment FROM customer")
def positional_zip(spark, sf_dir):
    t = _table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "position")
    return gates.zip_by_position(t.select("position", F.col("c_name").alias("name")), t.select("position", "c_mktsegment", F.when(F.col("position") % 2 == 0, F.col("c_name")).otherwise("").alias("name")), "position", "name").withColumnRenamed("c_mktsegment", "segment")


@_register("SELECT c_custkey, c_name FROM customer ORDER BY md5('3:' || c_custkey)")
def ordered_lookup(spark, sf_dir):
    t = _table(spark, sf_dir, "customer")
    return gates.select_in_order(t.select("c_custkey", "c_name"), t.select("c_custkey", X.hashed(3, F.col("c_custkey")).alias("_o")), "c_custkey", "_o").drop("_o")


@_register("SELECT r_regionkey, r_name FROM region WHERE r_name IN ('EUROPE', 'ASIA', 'AFRICA')")
def named_runs(spark, sf_dir):
    return sinks.select_runs(_table(spark, sf_dir, "region").select("r_regionkey", "r_name"), ["EUROPE", "ASIA", "AFRICA"], "r_name").select("r_regionkey", "r_name")


@_register("SELECT p_partkey AS CID, p_name AS ConnectivitySMILES, NULL::DOUBLE AS XLogP FROM part")
def missing_columns(spark, sf_dir):
    t = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("CID"), F.col("p_name").alias("CanonicalSMILES"))
    return integrate.with_missing_columns(t, {"CID": "bigint", "ConnectivitySMILES": "string", "XLogP": "double"})


# ---- members, failures, audits -------------------------------------------------------------------------

_WIDE_SQL = f"{_MEMBERS_SQL}, wide AS (SELECT doc_id, 'm' || member AS member, max(pred) FILTER (label = 'quality') AS quality, max(pred) FILTER (label = 'toxic') AS toxic FROM members GROUP BY ALL)"


def _wide(spark, sf_dir):
    own = lambda n: F.max(F.when(F.col("label") == n, F.col("pred"))).alias(n)
    return _members(spark, sf_dir).groupBy("doc_id", F.concat(F.lit("m"), F.col("member").cast("string")).alias("member")).agg(own("quality"), own("toxic"))


@_register(f"WITH {_WIDE_SQL} SELECT * FROM wide")
def members_strict(spark, sf_dir):
    wide = cut(_wide(spark, sf_dir))
    return ensemble.validate_members(wide, wide, "doc_id", ["quality", "toxic"]).select("doc_id", "member", "quality", "toxic")


@_register(f"WITH {_WIDE_SQL} SELECT doc_id, member, quality, coalesce(CASE WHEN doc_id % 3 > 0 THEN toxic END, 0) AS toxic FROM wide")
def members_lenient(spark, sf_dir):
    wide = cut(_wide(spark, sf_dir))
    sparse = wide.withColumn("toxic", F.when(F.col("doc_id") % 3 > 0, F.col("toxic")))
    return ensemble.validate_members(sparse, wide, "doc_id", ["quality", "toxic"], mode="lenient").select("doc_id", "member", "quality", "toxic")


@_register(f"WITH {_WIDE_SQL} SELECT * FROM wide")
def members_block(spark, sf_dir):
    """A second, unusable answer of each member goes; what is left covers all ids."""
    wide = cut(_wide(spark, sf_dir))
    failed = wide.withColumn("toxic", F.lit(None).cast("int"))
    return ensemble.validate_members(wide.unionByName(failed), wide, "doc_id", ["quality", "toxic"], mode="block").select("doc_id", "member", "quality", "toxic")


@_register(f"WITH {_MEMBERS_SQL}, f AS (SELECT label, truth, CASE WHEN doc_id % 5 > 0 THEN pred END AS p FROM members WHERE member = 1), g AS (SELECT label, truth, coalesce(p, 0) AS pred, p FROM f) SELECT label, {_COUNTS}, count_if(p IS NULL)::BIGINT AS failures FROM g GROUP BY label")
def failure_policy(spark, sf_dir):
    t = _members(spark, sf_dir).filter("member = 1").withColumn("pred", F.when(F.col("doc_id") % 5 > 0, F.col("pred")))
    filled, failures = metrics.fill_failures(t)
    return metrics.confusion(filled).join(t.groupBy("label").agg(failures.alias("failures")), "label")


@_register(f"WITH {_GOLD_SQL}, v AS (SELECT *, CASE WHEN {_h("'v:' || doc_id")} % 2 = 0 THEN 'val' ELSE 'test' END AS split FROM gold), m AS (SELECT doc_id, label, truth, split, count_if((CASE WHEN {_h("concat_ws(':', 'm', m, doc_id, label)")} % 10 < 2 THEN 1 - truth ELSE truth END) = 1) AS votes FROM v, (VALUES (1), (2), (3)) t(m) GROUP BY ALL),"
f"""c AS (SELECT label, t AS threshold, count_if(votes >= t AND truth = 1) AS tp, count_if(votes >= t AND truth = 0) AS fp, count_if(votes < t AND truth = 1) AS fn FROM m, (VALUES (1), (2), (3)) x(t) WHERE split = 'val' GROUP BY 1, 2),
s AS (SELECT label, threshold, coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0) AS precision, coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0) AS recall, coalesce((2 * tp)::DOUBLE / nullif(2 * tp + fp + fn, 0), 0) AS f1 FROM c),
b AS (SELECT label, precision AS base FROM s WHERE threshold = 2), best AS (SELECT label, threshold FROM s JOIN b USING (label) WHERE precision >= base - 0.15 QUALIFY row_number() OVER (PARTITION BY label ORDER BY f1 DESC, recall DESC, threshold) = 1)
SELECT doc_id, label, votes::INT AS votes, (votes >= threshold)::INT AS pred FROM m JOIN best USING (label) WHERE split = 'test'""")
def threshold_transfer(spark, sf_dir):
    """Thresholds learned on validation rows and applied to test rows only."""
    part = F.when(X.hashed_int("v", F.col("doc_id")) % 2 == 0, "val").otherwise("test")
    votes = ensemble.vote(_members(spark, sf_dir), "doc_id", {}).withColumn("split", part)
    chosen = ensemble.select_thresholds(ensemble.threshold_sweep(votes.filter("split = 'val'"), _gold(spark, sf_dir), "doc_id"), drops={}, default_drop=0.15)
    return ensemble.apply_thresholds(votes.filter("split = 'test'"), chosen).select("doc_id", "label", "votes", "pred")


@_register("SELECT 0::BIGINT AS unpaired, count_if(p_partkey % 10 = 0 AND p_partkey > 0)::BIGINT AS moved, count_if(p_partkey % 4 = 0)::BIGINT AS relabelled, true AS same_prompts FROM part")
def gold_audit(spark, sf_dir):
    """Two gold tables that differ in some places and labels, not in ids or prompts."""
    t = cut(metrics.digested(_records(spark, sf_dir)).withColumn("_o", F.col("id").cast("bigint")))
    other = t.withColumn("labels", F.when(F.col("_o") % 4 == 0, F.col("labels").withField("cmr", 1 - F.col("labels.cmr"))).otherwise(F.col("labels")))
    found = metrics.gold_equivalence(t, other, "_o", V.LABELS)
    swapped = metrics.gold_equivalence(t, t.withColumn("_o", F.when(F.col("_o") % 10 == 0, -F.col("_o")).otherwise(F.col("_o"))), "_o", V.LABELS)
    return spark.createDataFrame([(found["unpaired"], swapped["moved"], found["relabelled"], found["same_prompts"] and not swapped["same_prompts"])], "unpaired long, moved long, relabelled long, same_prompts boolean")


def _digest_sql() -> str:
    """Row digests over order, id and the prompt's turns as JSON, summed up in four numbers."""
    row = "sha256(concat_ws(chr(31), o, id, '[{\"role\":\"user\",\"content\":\"' || text || '\"}]'))"
    part = lambda i: f"sum(('0x' || substr(d, {1 + 15 * i}, 15))::BIGINT::HUGEINT)"
    return f"WITH x AS (SELECT c_custkey AS o, c_name AS id, c_mktsegment AS text FROM customer), y AS (SELECT {row} AS d FROM x) SELECT sha256(concat_ws(':', count(*), {', '.join(f'{part(i)}::VARCHAR' for i in range(4))})) AS digest FROM y"


@_register(_digest_sql())
def prompt_digest(spark, sf_dir):
    turn = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    t = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("_o"), F.col("c_name").alias("id"), F.array(turn("user", F.col("c_mktsegment")), turn("assistant", F.col("c_acctbal").cast("string"))).alias("messages"))
    return metrics.prompt_digest(t, "_o")


@_register("SELECT * FROM (VALUES ('none', 'missing_gold'), ('unanswered', 'missing_prediction'), ('twice', 'duplicate_ids'), ('other', 'id_mismatch'), ('same', 'evaluated')) t(run, status)")
def run_states(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"))
    labels = _table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id")).distinct()
    runs = {"none": (None, docs), "unanswered": (docs, None), "twice": (docs, docs.union(docs)), "other": (docs, labels), "same": (docs, docs)}
    return spark.createDataFrame([(n, metrics.run_status(*r)) for n, r in runs.items()], "run string, status string")


@_register("SELECT CASE WHEN doc_id % 10 = 0 THEN 'test' ELSE 'train' END AS split, count(*) AS n, count(DISTINCT doc_id) AS n_ids, count(DISTINCT text) AS n_texts, count_if(coalesce(source, '') <> '')::BIGINT AS with_group, count_if(coalesce(source, '') = '')::BIGINT AS without_group FROM documents GROUP BY 1")
def split_audit(spark, sf_dir):
    t = _table(spark, sf_dir, "documents").withColumn("split", F.when(F.col("doc_id") % 10 == 0, "test").otherwise("train"))
    return split.audit(t, "doc_id", "text", "source")


@_register(f"WITH {_GOLD_SQL} SELECT label, count(*) AS cells FROM gold GROUP BY label")
def gold_gate(spark, sf_dir):
    """Both members' gold must be the same before they are compared."""
    a, b = (_members(spark, sf_dir).filter(f"member = {i}") for i in (1, 2))
    gates.require_same_gold(a, b, "doc_id")
    return a.groupBy("label").agg(F.count(F.lit(1)).alias("cells"))


@_register("SELECT CASE WHEN doc_id % 4 = 2 THEN 'regex_recovered' ELSE 'ok' END AS parse_status, count(*) AS n FROM labels GROUP BY 1")
def complete_answers(spark, sf_dir):
    t = _table(spark, sf_dir, "labels").select(F.when(F.col("doc_id") % 4 == 2, "regex_recovered").otherwise("ok").alias("parse_status"))
    return metrics.status_histogram(gates.require_complete(t))


@_register("SELECT 'x' AS feature, count(*) FILTER (p_size % 4 <> 0) AS n FROM part UNION ALL SELECT 'c', count(*) FROM part UNION ALL SELECT 'absent', 0::BIGINT FROM region WHERE r_regionkey = (SELECT min(r_regionkey) FROM region)")
def observed_features(spark, sf_dir):
    raw = _table(spark, sf_dir, "part").select(F.when(F.col("p_size") % 4 == 0, "nan").otherwise(F.col("p_size").cast("string")).alias("x"), F.col("p_brand").alias("c"))
    return metrics.feature_counts(ml.typed_features(raw, ["x", "absent"], ["c"]), ["x", "absent", "c"])


# ---- splits, factors, permutations ---------------------------------------------------------------------


@_register(
    """WITH n AS (SELECT lang, count(*) AS n FROM documents GROUP BY 1), r AS (SELECT lang, n, s, ratio, i, floor(n * ratio)::BIGINT AS whole, n * ratio - floor(n * ratio) AS frac FROM n, (VALUES ('train', 0.8::DOUBLE, 1), ('val', 0.1::DOUBLE, 2), ('test', 0.1::DOUBLE, 3)) t(s, ratio, i)),
k AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY frac DESC, ratio DESC, i) AS k, n - sum(whole) OVER (PARTITION BY lang) AS over FROM r) SELECT lang, s AS split, (whole + (k <= over)::INT)::BIGINT AS n FROM k"""
)
def allocation(spark, sf_dir):
    counts = _table(spark, sf_dir, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()  # a row a language
    rows = [(r["lang"], s, n) for r in counts for s, n in zip(("train", "val", "test"), split.allocate_counts(r["n"], [0.8, 0.1, 0.1]), strict=True)]
    return spark.createDataFrame(rows, "lang string, split string, n long")


def _whole_sql(total: str, ratio: str) -> str:
    """The held-out part of a largest-remainder division in two."""
    return f"(floor({total} * {ratio}) + CASE WHEN {total} * {ratio} - floor({total} * {ratio}) > {total} * (1 - {ratio}) - floor({total} * (1 - {ratio})) THEN 1 ELSE 0 END)"


@_register(
    f"""WITH n AS (SELECT count(*)::DOUBLE AS n FROM (SELECT DISTINCT doc_id, quality, toxic FROM labels)), t AS (SELECT n, {_whole_sql('n', '0.1::DOUBLE')} AS test FROM n),
v AS (SELECT n, test, {_whole_sql('(n - test)', '(0.1::DOUBLE / 0.9::DOUBLE)')} AS val FROM t) SELECT 'test' AS split, test::BIGINT AS n FROM v UNION ALL SELECT 'val', val::BIGINT FROM v UNION ALL SELECT 'train', (n - test - val)::BIGINT FROM v"""
)
def stratified_sizes(spark, sf_dir):
    docs = _table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic").distinct()
    return split.stratified_split(docs, "doc_id", ["quality", "toxic"], 0.1, 0.1, 123).groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@_register("SELECT source, 1::BIGINT AS n_splits, count(*) AS n FROM documents GROUP BY source")
def whole_groups(spark, sf_dir):
    """A group split leaves every group in one piece, and loses no row."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", (F.col("n_chars") > 2000).cast("int").alias("long"))
    return split.group_split(docs, "source", ["long"], 0.1, 0.1, 123).groupBy("source").agg(F.count_distinct("split").alias("n_splits"), F.count(F.lit(1)).alias("n"))


@_register("SELECT * FROM (VALUES ('cmr', 2.5::DOUBLE), ('stot', 3.0::DOUBLE), ('oxidizing', 2.0::DOUBLE), ('gas_under_pressure', 2.0::DOUBLE), ('environmental_hazard', 2.0::DOUBLE)) t(label, factor)")
def replay_factors(spark, sf_dir):
    return spark.createDataFrame(list(sample.parse_factors("cmr=2.5, stot = 3", uniform=2).items()), "label string, factor double")


def _variants_sql() -> str:
    """All variants of a prompt that has four fields."""
    line = {"CID": "'- CID: ' || p_partkey", "ConnectivitySMILES": "CASE WHEN p_partkey % 9 <> 0 THEN '- ConnectivitySMILES: C' || p_size END", "IUPACName": "'- IUPACName: ' || p_name", "MolecularFormula": "CASE WHEN p_partkey % 3 <> 0 THEN '- MolecularFormula: H2O' END", "XLogP": f"'- XLogP: ' || {_XLOGP_SQL}"}
    parts = []
    for name, (fields, shown, mixed) in V.VARIANTS.items():
        kept = [q for f, q in line.items() if f in fields]
        picture = [f"'{V.BLOCK_TITLES['pictogram']}'", f"'- Pictograms: {'other' if mixed else 'pic'}' || (p_partkey % 5)"] if shown else []
        parts.append(f"SELECT p_partkey::VARCHAR AS id, '{name}' AS variant, {_JOINED(_HEAD_SQL, *kept, *picture, chr(39) + V.PROMPT_TAIL + chr(39))} AS prompt FROM part")
    return " UNION ALL ".join(parts)


@_register(_variants_sql())
def ablation_all(spark, sf_dir):
    t = _compounds(spark, sf_dir)
    n = (F.col("CID").cast("bigint") % 5).cast("string")
    p = t.select(F.col("CID").alias("id"), R.build_prompt(t.columns).alias("prompt"), F.concat(F.lit("pic"), n).alias("pictogram"), F.concat(F.lit("other"), n).alias("shuffled"))
    return sample.ablation_variants(p, "prompt", "pictogram", "shuffled").select("id", "variant", "prompt")


@_register(
    """WITH s AS (SELECT c_custkey, c_mktsegment, c_custkey % 3 AS s FROM customer), a AS (SELECT c_custkey, s, row_number() OVER (PARTITION BY s ORDER BY c_custkey) AS k FROM s), b AS (SELECT c_mktsegment, s, row_number() OVER (PARTITION BY s ORDER BY md5('5:' || c_custkey), c_custkey) AS k FROM s)
SELECT c_custkey, c_mktsegment AS dealt FROM a JOIN b USING (s, k)"""
)
def split_permute(spark, sf_dir):
    t = _table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", (F.col("c_custkey") % 3).alias("s"))
    return sample.permute_column(t, "c_mktsegment", "c_custkey", "c_custkey", 5, "dealt", split="s").select("c_custkey", "dealt")


# ---- features ------------------------------------------------------------------------------------------


@_register(
    """WITH t AS (SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN NULL ELSE (p_size % 3)::DOUBLE END AS x, CASE WHEN p_partkey % 6 = 5 THEN '' ELSE 'c' || (p_partkey % 3) END AS c FROM part),
tr AS (SELECT * FROM t WHERE p_partkey % 5 > 0), m AS (SELECT quantile_disc(x, 0.5) AS med FROM tr), i AS (SELECT avg(coalesce(x, med)) AS mu, stddev_samp(coalesce(x, med)) AS sd FROM tr, m)
SELECT p_partkey, round((coalesce(x, med) - mu) / sd, 6) AS f0, (c = '')::INT::DOUBLE AS f1, (c = 'c0')::INT::DOUBLE AS f2, (c = 'c1')::INT::DOUBLE AS f3, (c = 'c2')::INT::DOUBLE AS f4 FROM t, m, i"""
)
def feature_table(spark, sf_dir):
    """Median, scale and categories of the train rows, applied to all."""
    p = F.col("p_partkey")
    raw = _table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_size") % 4 == 0, "nan").otherwise((F.col("p_size") % 3).cast("string")).alias("x"), F.when(p % 6 == 5, "none").otherwise(F.concat(F.lit("c"), (p % 3).cast("string"))).alias("c"))
    t = ml.typed_features(raw, ["x", "absent"], ["c"])
    made = ml.feature_pipeline(t.filter("p_partkey % 5 > 0"), ["x", "absent"], ["c"]).transform(t)
    a = ml.vector_to_array("features")
    return _rounded(made.select("p_partkey", *[a[i].alias(f"f{i}") for i in range(5)]))


def _separable(spark, sf_dir):
    """Two labels that two features tell without doubt, so any sound model finds them."""
    p = F.col("p_partkey")
    own = {"a": (F.col("p_size") > 25).cast("int"), "b": (p % 2).cast("int")}
    return _table(spark, sf_dir, "part").select("p_partkey", (own["a"] * 3 + 1).cast("string").alias("x"), F.when(p % 2 == 1, "odd").otherwise("").alias("c"), *[v.alias(k) for k, v in own.items()])


@_register("SELECT p_partkey, model, (p_size > 25)::INT AS pred_a, (p_partkey % 2)::INT AS pred_b FROM part, (VALUES ('forest_plain'), ('logistic_plain'), ('chain_plain')) t(model)")
def model_grid(spark, sf_dir):
    t = ml.typed_features(_separable(spark, sf_dir), ["x"], ["c"])
    made = ml.feature_pipeline(t, ["x"], ["c"]).transform(t).select("p_partkey", "a", "b", "features")
    found = ml.model_grid(made, made, ["a", "b"], {"plain": "features"}, trees=5)
    parts = [d.select("p_partkey", F.lit(n).alias("model"), "pred_a", "pred_b") for n, d in found.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@_register("SELECT p_partkey, (p_size > 25)::INT AS pred_a, (p_partkey % 2)::INT AS pred_b FROM part")
def frozen_transfer(spark, sf_dir):
    """Fitted on four fifths of the rows, applied to all."""
    t = _separable(spark, sf_dir)
    train = t.filter(X.hashed_int("t", F.col("p_partkey")) % 5 > 0)
    return ml.frozen_transfer(train, t.drop("a", "b"), ["a", "b"], ["x"], ["c"], trees=5).select("p_partkey", "pred_a", "pred_b")
