"""Nested source documents to rows.  Sections are found by their headings at fixed depths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparloom.functions import text as X

_INFO = "array<struct<Name:string,Value:struct<StringWithMarkup:array<struct<String:string>>,Number:array<double>>>>"
_S4 = f"array<struct<TOCHeading:string,Information:{_INFO}>>"
_S3 = f"array<struct<TOCHeading:string,Information:{_INFO},Section:{_S4}>>"
_S2 = f"array<struct<TOCHeading:string,Information:{_INFO},Section:{_S3}>>"
_S1 = f"array<struct<TOCHeading:string,Information:{_INFO},Section:{_S2}>>"
DOCUMENT_SCHEMA = f"struct<Record:struct<Section:{_S1}>>"


def parse_json(df: DataFrame, body: str) -> DataFrame:
    return df.withColumn("document", F.from_json(body, DOCUMENT_SCHEMA))


def _under(sections: Column, heading: str) -> Column:
    return F.filter(F.coalesce(sections, F.array()), lambda s: s["TOCHeading"] == heading)


def _below(sections: Column) -> Column:
    return F.flatten(F.transform(sections, lambda s: F.coalesce(s["Section"], F.array())))


def _strings(info: Column) -> Column:
    return F.transform(F.coalesce(info["Value"]["StringWithMarkup"], F.array()), lambda x: F.coalesce(x["String"], F.lit("")))


def parse_hazards(df: DataFrame, id_col: str = "cid") -> DataFrame:
    """One row a document: whether it has the section; its statements, pictograms and sub-headings (joined
    by bars); the last signal word.  Names dispatch by the first substring that fits."""
    top = _under(F.col("document.Record.Section"), "Safety and Hazards")
    found = _under(_below(_under(_below(top), "Hazards Identification")), "GHS Classification")
    info = F.flatten(F.transform(found, lambda s: F.coalesce(s["Information"], F.array())))
    kind = lambda i: F.when(F.contains(i["Name"], F.lit("GHS Hazard Statements")), "h").when(F.contains(i["Name"], F.lit("Precautionary Statement")), "p").when(F.contains(i["Name"], F.lit("Signal")), "s").when(F.contains(i["Name"], F.lit("Pictogram")), "i")
    texts = lambda k: F.flatten(F.transform(F.filter(info, lambda i: kind(i) == k), _strings))
    some = lambda k: F.array_join(F.filter(texts(k), lambda t: t != ""), "|")
    headings = F.filter(F.transform(_below(found), lambda s: F.coalesce(s["TOCHeading"], F.lit(""))), lambda t: t != "")
    return df.select(
        id_col,
        (F.size(found) > 0).alias("Has_GHS_Data"),
        F.try_element_at(texts("s"), F.lit(-1)).alias("Signal_Word"),
        F.array_join(headings, "|").alias("GHS_Classifications"),
        some("h").alias("H_Statements"),
        some("p").alias("P_Statements"),
        some("i").alias("Pictograms"),
    )


def _first_text(info: Column) -> Column:
    """The first markup text, or else the first number as text."""
    value = info["Value"]
    return F.when(value["StringWithMarkup"].isNotNull(), F.try_element_at(_strings(info), F.lit(1))).otherwise(F.try_element_at(value["Number"], F.lit(1)).cast("string"))


#: Property by the heading part that names it, in order of dispatch.
PROPERTIES = (("Boiling Point", "BoilingPoint"), ("Melting Point", "MeltingPoint"), ("Flash Point", "FlashPoint"), ("Vapor Pressure", "VaporPressure"), ("Density", "Density"), ("Solubility", "WaterSolubility"))


def parse_properties(df: DataFrame, id_col: str = "cid") -> DataFrame:
    """Physical properties: the first number found for each, the last physical state that a description
    tells, and the first computed partition coefficient.  A value of 0 doesn't count as data."""
    chem = _below(_under(F.col("document.Record.Section"), "Chemical and Physical Properties"))
    entries = F.flatten(
        F.transform(
            _below(_under(chem, "Experimental Properties")),
            lambda s: F.transform(F.coalesce(s["Information"], F.array()), lambda i: F.struct(s["TOCHeading"].alias("heading"), _first_text(i).alias("text"))),
        )
    )
    computed = F.flatten(F.transform(_under(chem, "Computed Properties"), lambda s: F.coalesce(s["Information"], F.array())))
    # what all properties are looked for in is a column of its own, so that it is worked out once
    df = df.select(id_col, F.filter(entries, lambda e: F.coalesce(e["text"], F.lit("")) != "").alias("_told"), computed.alias("_computed"))
    told, computed = F.col("_told"), F.col("_computed")

    def number(part: str) -> Column:
        values = F.transform(F.filter(told, lambda e: F.contains(e["heading"], F.lit(part))), lambda e: X.physical_number(e["text"]))
        return F.try_element_at(F.array_compact(values), F.lit(1))

    def state(t: Column) -> Column:
        t = F.lower(t)
        has = lambda *w: F.exists(F.array(*[F.lit(x) for x in w]), lambda x: F.contains(t, x))
        return F.when(has("liquid"), "liquid").when(has("gas", "vapor"), "gas").when(has("solid", "powder", "crystal"), "solid")

    states = F.array_compact(F.transform(F.filter(told, lambda e: F.contains(e["heading"], F.lit("Physical Description"))), lambda e: state(e["text"])))
    logp = F.transform(F.filter(computed, lambda i: F.contains(i["Name"], F.lit("LogP"))), lambda i: F.try_element_at(i["Value"]["Number"], F.lit(1)))
    out = df.select(id_col, *[number(part).alias(name) for part, name in PROPERTIES], F.try_element_at(F.array_compact(logp), F.lit(1)).alias("LogP"), F.try_element_at(states, F.lit(-1)).alias("PhysicalState"))
    known = F.lit(False)
    for name in ("BoilingPoint", "MeltingPoint", "FlashPoint", "VaporPressure"):
        known = known | F.coalesce(F.col(name) != 0, F.lit(False))
    return out.withColumn("Has_Physical_Data", known)


def parse_toxicity(df: DataFrame, id_col: str = "cid") -> DataFrame:
    """First oral and dermal dose, inhalation concentration and danger level, in document order; a text on
    the dose is not looked at for the others.  Class from the oral dose."""
    top = F.coalesce(F.col("document.Record.Section"), F.array())
    own = F.transform(F.filter(top, lambda s: s["TOCHeading"] == "Toxicity"), lambda s: F.transform(F.coalesce(s["Section"], F.array()), lambda x: F.coalesce(x["Information"], F.array())))
    safety = F.filter(_below(_under(top, "Safety and Hazards")), lambda s: s["TOCHeading"] == "Toxicity")
    nested = F.transform(safety, lambda s: F.transform(F.coalesce(s["Section"], F.array()), lambda x: F.coalesce(x["Information"], F.array())))
    info = F.flatten(F.concat(F.flatten(own), F.flatten(nested)))
    texts = F.filter(F.transform(info, lambda i: F.lower(F.try_element_at(_strings(i), F.lit(1)))), lambda t: X.toxicity_number(t).isNotNull())
    has = lambda t, w: F.contains(t, F.lit(w))

    def first(test) -> Column:
        return X.toxicity_number(F.try_element_at(F.filter(texts, test), F.lit(1)))

    # the texts are a column of their own, so that they are worked out once
    df = df.select(id_col, texts.alias("_texts"), ((F.size(_under(top, "Toxicity")) > 0) | (F.size(safety) > 0)).alias("_has"))
    texts = F.col("_texts")
    out = df.select(
        id_col,
        first(lambda t: has(t, "ld50") & has(t, "oral")).alias("LD50_oral"),
        first(lambda t: has(t, "ld50") & ~has(t, "oral") & has(t, "dermal")).alias("LD50_dermal"),
        first(lambda t: ~has(t, "ld50") & has(t, "lc50")).alias("LC50_inhalation"),
        first(lambda t: ~has(t, "ld50") & ~has(t, "lc50") & has(t, "idlh")).alias("IDLH"),
        F.col("_has").alias("Has_Toxicity_Data"),
    )
    return out.withColumn("Toxicity_Class", X.toxicity_class(F.col("LD50_oral")))
