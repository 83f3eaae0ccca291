"""Oversampling, hard positives, ablation variants, column permutation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparloom.functions import records as R
from sparloom.functions import text as X
from sparloom.functions import vocabulary as V
from sparloom.functions.lineage import numbered


def parse_factors(spec: str | None, uniform: float | None = None, labels: Sequence[str] = V.RARE_LABELS, known: Sequence[str] = V.LABELS) -> dict[str, float]:
    """``label=factor`` items, comma-separated, over a uniform factor for ``labels``; factors are at least 1."""
    out = dict.fromkeys(labels, float(uniform)) if uniform is not None else {}
    for item in filter(None, (p.strip() for p in (spec or "").split(","))):
        name, eq, value = item.partition("=")
        if not eq or name.strip() not in known:
            raise ValueError(f"not label=factor: {item}")
        out[name.strip()] = float(value)
    if any(f < 1 for f in out.values()):
        raise ValueError("factors must be at least 1")
    return out


def factor_map(spec: Column, uniform: float | None = None, labels: Sequence[str] = V.RARE_LABELS, known: Sequence[str] = V.LABELS) -> Column:
    """``parse_factors`` of a column of texts: a map of label and factor; the same texts are errors."""
    start = F.create_map(*[x for n in labels for x in (F.lit(n), F.lit(float(uniform)))]) if uniform is not None and labels else F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>"))
    items = F.filter(F.transform(F.split(F.coalesce(spec, F.lit("")), ","), lambda p: F.trim(p)), lambda p: p != "")
    name = lambda p: F.trim(F.substring_index(p, "=", 1))
    value = lambda p: F.trim(F.substring(p, F.instr(p, "=") + 1, F.length(p))).try_cast("double")
    bad = F.filter(items, lambda p: ~F.contains(p, F.lit("=")) | ~name(p).isin(*known) | value(p).isNull())
    pairs = F.transform(items, lambda p: F.struct(name(p).alias("key"), value(p).alias("value")))
    # later items win over earlier ones, whatever the session does about repeated keys, and over the uniform factor
    said = F.map_from_entries(F.filter(pairs, lambda e, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda later: later["key"] == e["key"])))
    last = F.map_from_entries(F.filter(F.map_entries(start), lambda e: ~F.exists(items, lambda p: name(p) == e["key"])))
    whole = F.map_concat(last, said)
    low = F.exists(F.map_values(whole), lambda f: f < 1)
    return F.when(F.size(bad) > 0, F.raise_error(F.concat(F.lit("not label=factor: "), F.array_join(bad, ", "))).cast("map<string,double>")).when(low, F.raise_error(F.lit("factors must be at least 1")).cast("map<string,double>")).otherwise(whole)


def hard_positive(label: Column, text: Column, keywords: Sequence[str]) -> Column:
    """The label is set and any keyword (lower case) is in the text."""
    if not keywords:
        return F.lit(False)
    low = F.lower(F.coalesce(text, F.lit("")))
    return (label == 1) & F.exists(F.array(*[F.lit(k) for k in keywords]), lambda k: F.contains(low, k))


def copies(factors: Mapping[str, Column | float], label: Mapping[str, Column], id_col: str, seed, hard: Column | None = None, hard_factor: float = 1.0) -> Column:
    """1 + extra copies: the largest factor of the labels set; its fraction is drawn from the id's hash."""
    parts = [F.when(label[n] == 1, F.lit(float(f))).otherwise(F.lit(1.0)) for n, f in factors.items()]
    if hard is not None:
        parts.append(F.when(hard, F.lit(float(hard_factor))).otherwise(F.lit(1.0)))
    parts += [F.lit(1.0)] * max(0, 2 - len(parts))
    factor = F.greatest(*parts)
    whole = F.floor(factor)
    u = X.hashed_int(seed, F.col(id_col)).cast("double") / float(1 << 32)
    return (whole + (u < factor - whole).cast("bigint")).cast("int")


def oversample(df: DataFrame, factors: Mapping[str, float], id_col: str, seed, split: str = "split", train: str = "train", hard: Column | None = None, hard_factor: float = 1.0, shuffle: bool = True) -> DataFrame:
    """Rows of the train split repeat; others stay as they are.  ``replica`` counts from 0.  Rows come in the
    hash order of id and replica."""
    n = F.when(F.col(split) == train, copies(factors, {k: F.col(k) for k in factors}, id_col, seed, hard, hard_factor)).otherwise(1)
    out = df.withColumn("replica", F.explode(F.sequence(F.lit(0), n - 1)))
    return out.orderBy(split, X.hashed(seed, F.col(id_col), F.col("replica"))) if shuffle else out


def ablate(content: Column, fields: Sequence[str], pictogram: Column | None) -> Column:
    """Keeps the whitelisted lines of a prompt, and shows the given pictogram where there is one."""
    keep = F.array(*[F.lit(f) for f in fields])
    lines = F.filter(F.split(content, "\n"), lambda x: F.coalesce(F.array_contains(keep, R.line_field(x)), F.lit(False)))
    parts = [F.array(*[F.lit(t) for t in V.PROMPT_HEAD]), lines]
    if pictogram is not None:
        shown = F.array(F.lit(V.BLOCK_TITLES["pictogram"]), F.concat(F.lit("- Pictograms: "), pictogram))
        parts.append(F.when(pictogram != "", shown).otherwise(F.array().cast("array<string>")))
    return F.array_join(F.concat(*parts, F.array(F.lit(V.PROMPT_TAIL))), "\n")


def ablation_variants(prompts: DataFrame, content: str, pictogram: str, shuffled: str | None = None, variants: Mapping = V.VARIANTS) -> DataFrame:
    """One row a prompt and variant, exploded from one array: the prompts are read once."""
    made = []
    for name, (fields, shown, mixed) in variants.items():
        source = (shuffled or pictogram) if mixed else pictogram
        made.append(F.struct(F.lit(name).alias("variant"), ablate(F.col(content), fields, F.col(source) if shown else None).alias(content)))
    keep = [c for c in prompts.columns if c != content]
    return prompts.select(*keep, F.explode(F.array(*made)).alias("_v")).select(*keep, "_v.*")


def permute_column(df: DataFrame, column: str, order: str, id_col: str, seed, out: str | None = None, split: str | None = None) -> DataFrame:
    """The column's values dealt anew: the row at place k in file order gets the value at place k in hash
    order.  Both numberings are distributed sorts, joined on the place.  With ``split`` values stay in their
    split: both sorts go by it first, so the places of a split are the same in both."""
    first = [F.col(split)] if split else []
    places = numbered(df, [*first, F.col(order)], "_place")
    kept = df.select(F.col(column).alias("_value"), F.col(id_col).alias("_id"), F.col(order).alias("_o"), *first)
    dealt = numbered(kept, [*first, X.hashed(seed, F.col("_id")), F.col("_id"), F.col("_o")], "_place")
    return places.join(dealt.select("_place", "_value"), "_place").withColumn(out or column, F.col("_value")).drop("_place", "_value")
