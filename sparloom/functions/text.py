"""Scalar cleaning and extraction, Column to Column.  The dialects of truth and of numbers differ on purpose."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparloom.functions import vocabulary as V


def normalize_text(c: Column) -> Column:
    """Null to empty; runs of any Unicode white space to one space; trimmed."""
    return F.trim(F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"(?U)\s+", " "))


def as_text(c: Column) -> Column:
    """Trimmed of Unicode white space; null, nan and none in any case are empty."""
    t = F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"(?U)^\s+|\s+$", "")
    return F.when(F.lower(t).isin("nan", "none"), "").otherwise(t)


def is_positive(c: Column) -> Column:
    return as_text(c).isin("1", "1.0", "True", "true")


def normalize_binary(c: Column) -> Column:
    return F.lower(F.trim(F.coalesce(c.cast("string"), F.lit("")))).isin("1", "1.0", "true", "yes").cast("int")


def parse_boolish(c: Column) -> Column:
    t = F.lower(as_text(c))
    return F.when(t.isin("1", "true", "yes"), "true").when(t.isin("0", "false", "no"), "false").otherwise("")


def is_strict_binary(c: Column) -> Column:
    return F.coalesce(F.lower(c.cast("string")).isin("0", "1", "true", "false"), F.lit(False))


def _first_number(c: Column, pattern: str, group: int = 0) -> Column:
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit("")).try_cast("double")


def parse_float(c: Column) -> Column:
    return _first_number(as_text(c), r"-?\d+(?:\.\d+)?")


def physical_number(c: Column) -> Column:
    """The first number of a property text; units are not looked at."""
    return _first_number(F.coalesce(c, F.lit("")), r"[-+]?\d*\.?\d+")


def toxicity_number(c: Column) -> Column:
    return _first_number(F.lower(F.coalesce(c, F.lit(""))), r"(\d+(?:\.\d+)?)\s*(?:mg/kg|mg/l|ppm)", 1)


def number_text(c: Column) -> Column:
    """The text of a finite double as Python and DuckDB write it: exponents only below 1e-4 and from 1e16 on."""
    t = c.cast("double").cast("string")
    exponent = F.regexp_extract(t, r"E(-?\d+)$", 1).try_cast("int")
    plain = F.regexp_replace(F.regexp_replace(c.cast("double").cast("decimal(38,20)").cast("string"), "0+$", ""), r"\.$", ".0")
    digits = F.regexp_replace(F.substring_index(t, "E", 1), r"\.0$", "")
    power = F.concat(F.when(exponent < 0, "-").otherwise("+"), F.regexp_replace(F.abs(exponent).cast("string"), r"^(\d)$", "0$1"))
    return F.when(exponent.between(-4, 15), plain).when(exponent.isNotNull(), F.concat(digits, F.lit("e"), power)).otherwise(t)


def to_number(c: Column) -> Column:
    """Failures and not-a-number are null."""
    x = F.trim(c.cast("string")).try_cast("double")
    return F.when(~F.isnan(x), x)


def extract_codes(c: Column) -> Column:
    """Ordered distinct codes, without word boundaries."""
    return F.array_distinct(F.regexp_extract_all(F.upper(normalize_text(c)), F.lit(r"(H\d{3})"), 1))


def _label_map() -> Column:
    return F.create_map(*[F.lit(x) for pair in V.CODE_TO_LABEL.items() for x in pair])


def codes_to_labels(codes: Column) -> Column:
    """Ordered distinct labels in the order of their codes; unmapped codes have none."""
    return F.array_distinct(F.array_compact(F.transform(codes, lambda c: F.try_element_at(_label_map(), c))))


def one_hot(labels: Column, names=V.LABELS) -> list[Column]:
    """``label_<name>`` columns of 0 and 1."""
    return [F.coalesce(F.array_contains(labels, n), F.lit(False)).cast("int").alias(f"label_{n}") for n in names]


def formula_elements(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(as_text(c), F.lit("[A-Z][a-z]?"), 0))


def _any_word(c: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(c, F.lit(w)) for w in words])


def _any_of(elements: Column, names: tuple[str, ...]) -> Column:
    return F.arrays_overlap(elements, F.array(*[F.lit(n) for n in names]))


def environmental_cues(smiles: Column, name: Column, formula: Column, xlogp: Column, solubility: Column) -> list[tuple[str, Column]]:
    """The six (name, boolean) cues; unknown is false."""
    text = F.lower(F.concat_ws(" ", as_text(smiles), as_text(name), as_text(formula)))
    elements = formula_elements(formula)
    halogen = _any_of(elements, V.HALOGENS) | _any_word(text, V.HALOGEN_WORDS)
    x, s = parse_float(xlogp), parse_float(solubility)
    known = lambda c: F.coalesce(c, F.lit(False))
    return [
        ("Contains halogenated organic structure", known(halogen)),
        ("Contains halogenated aromatic structure", known(halogen & _any_word(text, V.AROMATIC_WORDS))),
        ("High hydrophobicity proxy XLogP >= 3", known(x >= 3)),
        ("Very high hydrophobicity proxy XLogP >= 5", known(x >= 5)),
        ("Low water solubility proxy <= 1", known(s <= 1)),
        ("Contains organometal/metalloid element", known(_any_of(elements, V.METALS))),
    ]


def normalize_cas(c: Column) -> Column:
    """The first registry number, or empty."""
    return F.regexp_extract(normalize_text(c), r"\b\d{2,7}-\d{2}-\d\b", 0)


def status_for_cell(c: Column, positive: str) -> Column:
    """1, 0 or null: unknown texts, the positive pattern, an explicit negative, any other classification.
    The text is normalised once for all rules."""

    def rules(t: Column) -> Column:
        low = F.lower(t)
        known = F.when(t.rlike(f"(?i){positive}"), 1).when(low.startswith(V.NEGATIVE_PREFIX) | t.rlike(f"(?i){V.ANY_CLASS}"), 0)
        return F.when(~low.isin(*V.UNKNOWN_TEXT), known).cast("int")

    return F.element_at(F.transform(F.array(normalize_text(c)), rules), 1)


def combine_statuses(statuses: list[Column]) -> Column:
    """Three-valued or: any 1 is 1, all 0 is 0, else null."""
    return reduce(lambda a, b: a | b, [s == 1 for s in statuses]).cast("int")


def tri_state_labels(column=F.col, rules=None) -> list[tuple[str, Column, Column]]:
    """(label, status, evidence) for each label of the rule table; ``column`` maps a header to a Column."""
    out = []
    for label, parts in (rules or V.TRI_STATE_RULES).items():
        said = [F.concat(F.lit(f"{name}="), F.coalesce(F.nullif(normalize_text(column(name)), F.lit("")), F.lit("<blank>"))) for name, _ in parts]
        out.append((label, combine_statuses([status_for_cell(column(n), p) for n, p in parts]), F.concat_ws(" | ", *said)))
    return out


def toxicity_class(ld50: Column) -> Column:
    """1 to 6 by oral dose; null or 0 is null."""
    x = F.when(ld50 != 0, ld50)
    return F.when(x <= 5, 1).when(x <= 50, 2).when(x <= 300, 3).when(x <= 2000, 4).when(x <= 5000, 5).when(x > 5000, 6).cast("int")


def hashed(seed, *parts: Column) -> Column:
    """md5 hex of seed and parts joined by colons: the order that shuffles use; any engine can repeat it."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts]).cast("binary"))


def hashed_int(seed, *parts: Column) -> Column:
    """The first 32 bits of ``hashed`` as a whole number."""
    return F.conv(F.substring(hashed(seed, *parts), 1, 8), 16, 10).cast("bigint")
