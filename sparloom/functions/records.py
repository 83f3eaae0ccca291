"""Instruction records: prompts built and read, model answers parsed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparloom.functions import text as X
from sparloom.functions import vocabulary as V

LABEL_STRUCT = "struct<" + ",".join(f"{n}:int" for n in V.LABELS) + ">"
RECORD_SCHEMA = f"id string, messages array<struct<role:string,content:string>>, labels {LABEL_STRUCT}"
_FENCE = "```"


def prompt_lines(fields: Sequence[str], have: Sequence[str], column=F.col) -> Column:
    """``- Key: value`` lines of the fields there are; empty ones are null."""
    return F.array(*[F.when(X.as_text(column(f)) != "", F.concat(F.lit(f"- {f}: "), X.as_text(column(f)))) for f in fields if f in have])


def build_prompt(
    have: Sequence[str],
    fields: Sequence[str] = V.FEATURE_FIELDS,
    evidence: Sequence[str] = (),
    other: Sequence[str] = (),
    cues: bool = False,
    rubric: Sequence[str] = (),
    column=F.col,
) -> Column:
    """The user turn: head, feature lines, optional blocks, tail; empty lines are left out."""
    lit = lambda *t: F.array(*[F.lit(x) for x in t])
    parts = [lit(*V.PROMPT_HEAD), prompt_lines(fields, have, column)]
    if evidence:
        parts += [lit(V.BLOCK_TITLES["evidence"]), prompt_lines(evidence, have, column)]
    if other:
        parts += [lit(V.BLOCK_TITLES["other"]), prompt_lines(other, have, column)]
    if cues:
        get = lambda f: column(f) if f in have else F.lit(None).cast("string")
        found = X.environmental_cues(get("ConnectivitySMILES"), get("IUPACName"), get("MolecularFormula"), get("XLogP"), get("WaterSolubility"))
        parts += [lit(V.BLOCK_TITLES["cues"]), F.array(*[F.concat(F.lit(f"- {n}: "), F.when(c, "yes").otherwise("no")) for n, c in found])]
    if rubric:
        parts += [lit(V.BLOCK_TITLES["rubric"]), lit(*rubric)]
    return F.array_join(F.array_compact(F.concat(*[p for p in parts], lit(V.PROMPT_TAIL))), "\n")


def external_prompt(have: Sequence[str], column=F.col) -> Column:
    """The prompt of external records: seven fields that tell nothing of the labels."""
    return build_prompt(have, V.EXTERNAL_FIELDS, column=column)


def labels_struct(column=lambda n: F.col(f"label_{n}"), truth=X.is_positive) -> Column:
    return F.struct(*[F.coalesce(truth(column(n)), F.lit(False)).cast("int").alias(n) for n in V.LABELS])


def assistant_json(labels: Column) -> Column:
    """Keys in alphabetical order, with a space after separators."""
    names = sorted(V.LABELS)
    return F.format_string("{" + ", ".join(f'"{n}": %d' for n in names) + "}", *[labels[n] for n in names])


def build_records(rows: DataFrame, system: str, with_answer: bool = True, id_col: str = "CID", **prompt) -> DataFrame:
    labelled = rows.withColumn("labels", labels_struct())
    turn = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    turns = [turn("system", F.lit(system)), turn("user", build_prompt(rows.columns, **prompt))]
    if with_answer:
        turns.append(turn("assistant", assistant_json(F.col("labels"))))
    return labelled.select(X.as_text(F.col(id_col)).alias("id"), F.array(*turns).alias("messages"), "labels")


def user_content(messages: Column) -> Column:
    """Of the first user turn; empty if there is none."""
    return F.coalesce(F.try_element_at(F.filter(messages, lambda m: m["role"] == "user"), F.lit(1))["content"], F.lit(""))


def line_field(line: Column) -> Column:
    """The key of a ``- Key: value`` line, or null."""
    return F.when(line.rlike(r"^- [^:]*:"), F.trim(F.regexp_extract(line, r"^- ([^:]*):", 1)))


def line_value(line: Column) -> Column:
    return F.trim(F.regexp_extract(line, r"^- [^:]*:(.*)$", 1))


def prompt_fields(content: Column) -> Column:
    """map<key, value>; of repeated keys the last one holds (whatever the session's map setting)."""
    lines = F.filter(F.split(content, "\n"), lambda x: line_field(x).isNotNull())
    entries = F.transform(lines, lambda x, i: F.struct(line_field(x).alias("k"), i.alias("i"), line_value(x).alias("v")))

    def last_of_each(e: Column) -> Column:
        """Of entries in order of key and place those that another key follows, in order of place again."""
        kept = F.filter(e, lambda x, i: ~F.coalesce(F.get(e, i + 1)["k"] == x["k"], F.lit(False)))
        placed = F.array_sort(F.transform(kept, lambda x: F.struct(x["i"].alias("i"), x["k"].alias("k"), x["v"].alias("v"))))
        return F.map_from_entries(F.transform(placed, lambda x: F.struct(x["k"], x["v"])))

    return F.element_at(F.transform(F.array(F.array_sort(entries)), last_of_each), 1)


def field_value(content: Column, field: str) -> Column:
    """The first line of a field; empty if absent."""
    return F.trim(F.regexp_extract(content, rf"(?m)^- {field}:(.*)$", 1))


def render_chat(messages: Column) -> Column:
    """``ROLE: content`` by blank lines, without assistant turns, and the cue for one."""
    turns = F.transform(F.filter(messages, lambda m: m["role"] != "assistant"), lambda m: F.concat(F.upper(m["role"]), F.lit(": "), m["content"]))
    return F.array_join(F.concat(turns, F.array(F.lit("ASSISTANT:"))), "\n\n")


def strip_fences(c: Column) -> Column:
    t = F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    inner = F.regexp_replace(F.regexp_replace(t, rf"(?i)^{_FENCE}(?:json)?", ""), rf"{_FENCE}\s*$", "")
    return F.when(t.startswith(_FENCE), F.regexp_replace(inner, r"(?U)^\s+|\s+$", "")).otherwise(t)


def parse_object(c: Column, fences: bool = True) -> Column:
    """A lenient JSON object as map<string,string>: the text, or from its first { to its last }."""
    t = strip_fences(c) if fences else F.trim(c)
    sliced = F.regexp_extract(t, r"(?s)(\{.*\})", 1)
    read = lambda x: F.from_json(x, "map<string,string>")
    return F.coalesce(read(t), read(F.nullif(sliced, F.lit(""))))


def parse_answer(c: Column, labels: Sequence[str] = V.LABELS) -> Column:
    """struct(labels, parse_status) of a model's text: ``ok`` for an object (absent labels are 0),
    ``regex_recovered`` where every label is found as ``name: value``, ``failed`` with null labels else."""
    found = parse_object(c)
    from_map = F.struct(*[X.normalize_binary(F.try_element_at(found, F.lit(n))).alias(n) for n in labels])
    said = {n: F.regexp_extract(c, rf'(?i)"?{n}"?\s*[:=]\s*(true|false|1|0)', 1) for n in labels}
    every = F.array_min(F.array(*[F.length(v) for v in said.values()])) > 0
    recovered = F.struct(*[X.normalize_binary(v).alias(n) for n, v in said.items()])
    status = F.when(found.isNotNull(), "ok").when(every, "regex_recovered").otherwise("failed")
    return F.struct(F.when(status == "ok", from_map).when(status == "regex_recovered", recovered).alias("labels"), status.alias("parse_status"))


def labels_cascade(records: DataFrame, labels: Sequence[str] = V.LABELS) -> Column:
    """The first candidate that holds all labels: label structs, then texts, then the last assistant turn."""
    typed = dict(records.dtypes)
    candidates = []

    def from_map(m: Column) -> Column:
        whole = F.size(F.array_intersect(F.map_keys(m), F.array(*[F.lit(n) for n in labels]))) == len(labels)
        return F.when(m.isNotNull() & whole, F.struct(*[X.normalize_binary(F.try_element_at(m, F.lit(n))).alias(n) for n in labels]))

    for name in ("labels", "prediction", "predictions", "output", "outputs", "assistant", "response", "completion", "prediction_text", "output_text"):
        kind = typed.get(name, "")
        if kind.startswith("struct"):
            inner = {f.name for f in records.schema[name].dataType.fields}
            if set(labels) <= inner:
                some = F.col(name).isNotNull() & F.coalesce(*[F.col(f"{name}.{n}").cast("string") for n in labels]).isNotNull()
                candidates.append(F.when(some, F.struct(*[X.normalize_binary(F.col(f"{name}.{n}")).alias(n) for n in labels])))
        elif kind.startswith("map"):
            candidates.append(from_map(F.transform_values(F.col(name), lambda _, v: v.cast("string"))))
        elif kind == "string":
            candidates.append(from_map(parse_object(F.col(name), fences=False)))
    if typed.get("messages", "").startswith("array"):
        last = F.try_element_at(F.filter("messages", lambda m: m["role"] == "assistant"), F.lit(-1))["content"]
        candidates.append(from_map(parse_object(last, fences=False)))
    if not candidates:
        raise ValueError("no column that labels could come from")
    return F.coalesce(*candidates)


def threshold_scores(scores: Column, thresholds: dict[str, float] | float = 0.5, labels: Sequence[str] = V.LABELS, finite: bool = True) -> Column:
    """score >= threshold by label; scores that aren't finite raise unless ``finite`` is off."""

    def one(n: str) -> Column:
        x = scores[n]
        t = thresholds.get(n, 0.5) if isinstance(thresholds, dict) else thresholds
        bad = x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
        checked = F.when(bad, F.raise_error(F.lit(f"score of {n} is not finite")).cast("double")).otherwise(x) if finite else x
        return F.coalesce((checked >= t).cast("int"), F.lit(0)).alias(n)

    return F.struct(*[one(n) for n in labels])
