"""Information-theoretic sanitisation of personal data (operator 9), with DataFrame functions only.

Protected entities are e-mail and network addresses, card and telephone numbers; with each goes the group it
belongs to (an address's domain or network, a card's issuer, a number's first digits) and its kind, so that
entities that are seen once or twice are covered too.  From all documents it is estimated how strongly each term
near an entity, group or kind reveals it: the pointwise mutual information of the two, as a share of the
entity's own information content.  At one, the term alone tells the entity.  Terms whose share exceeds a
disclosure threshold are generalised to a placeholder, those beyond a second one are removed, in every document
where they stand near that entity.

Positions come from splitting a text at the matches: what lies between them has known lengths, and these are
summed up in blocks.  Windows are cut from the text in pieces of a fixed length.  So the work on a text follows
its length and the number of its matches, not their product.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparloom.llm.common import Scratch, cut, few, free_name, text_of

KINDS = ("email", "ip", "card", "phone")
#: The patterns, with possessive repeats and look-behinds where those change no match: a run of address
#: characters is entered at its first one or where the last match ended; cards are maximal runs of digits.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){11,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: A cheap test that every text with a match passes.
HINTS = {"email": lambda t: F.contains(t, F.lit("@")), "ip": lambda t: t.rlike(r"[0-9]\.[0-9]"), "card": lambda t: t.rlike("[0-9](?:[ -]?[0-9]){11}"), "phone": lambda t: F.contains(t, F.lit("+"))}
_SPANS = "array<struct<start:bigint,end:bigint,value:string>>"


@dataclass(frozen=True)
class Policy:
    """``window``: code points on either side of an entity in which terms are looked at.  ``min_term``: the
    least length of a term.  ``min_contexts``: different surroundings of an entity, or different entities of a group
    or kind, beside which the term must stand, so that copies of one document are no evidence.  ``smoothing``: documents with the term that are taken
    to tell nothing beside those that are seen, so that few observations don't weigh like many.  ``generalise``, ``remove``: disclosure shares."""

    window: int = 120
    min_term: int = 4
    min_contexts: int = 2
    smoothing: float = 0.5
    generalise: float = 0.8
    remove: float = 0.95


def _let(value: Column, use) -> Column:
    """``use`` of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


#: Elements to a block of a running sum, and code points to a piece of a text.
_BLOCK, _PIECE = 512, 256
_LONGS = "array<bigint>"


def before(values: Column, combine, zero: Column) -> Column:
    """For each of an array of whole numbers what ``combine`` makes of those before it: within blocks, and over
    the blocks, since appending one by one to one long array would copy it each time."""
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / F.lit(_BLOCK)).cast("int")), lambda b: F.slice(values, b * _BLOCK + 1, _BLOCK))
    none = F.array().cast(_LONGS)

    def running(items: Column, start: Column, value) -> Column:
        first = F.struct(start.alias("at"), none.alias("out"))
        step = lambda acc, v: F.struct(combine(acc["at"], value(v)).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
        return F.aggregate(items, first, step, lambda acc: acc["out"])

    def all_blocks(parts: Column) -> Column:
        starts = running(parts, zero, lambda part: F.aggregate(part, zero, combine))
        return _let(starts, lambda at: F.flatten(F.transform(parts, lambda part, i: running(part, F.get(at, i), lambda v: v))))

    return F.when(F.size(values) == 0, none).otherwise(_let(blocks, all_blocks))


def positions(text: Column, pattern: str) -> Column:
    """All matches, leftmost and non-overlapping, as (start, end, value) in code points, end exclusive."""
    none = F.array().cast(_SPANS)

    def place(found: Column) -> Column:
        gaps = F.transform(F.split(text, pattern, -1), lambda g: F.char_length(g).cast("bigint"))

        def spans(gap: Column) -> Column:
            lengths = F.transform(found, lambda value, i: F.get(gap, i) + F.char_length(value))
            return _let(before(lengths, lambda x, y: x + y, F.lit(0).cast("bigint")), lambda at: F.transform(found, lambda value, i: _span(F.get(at, i) + F.get(gap, i), value)))

        return F.when(F.size(found) == 0, none).otherwise(_let(gaps, spans))

    return _let(F.regexp_extract_all(text, F.lit(pattern), 0), place)


def _span(start: Column, value: Column) -> Column:
    return F.struct(start.alias("start"), (start + F.char_length(value)).alias("end"), value.alias("value"))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    each = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(F.when(d.cast("int") > 4, d.cast("int") * 2 - 9).otherwise(d.cast("int") * 2)))
    return F.aggregate(each, F.lit(0), lambda a, d: a + d) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: _let(F.regexp_replace(p, "^0+(?=.)", ""), lambda q: (F.length(q) < 3) | ((F.length(q) == 3) & (q <= "255"))))
    if kind == "card":
        return _let(_digits(value), lambda d: F.length(d).between(12, 19) & _luhn(d))
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    return F.lit(True)


def _entity(kind: str, value: Column) -> Column:
    plain = F.lower(value) if kind == "email" else value if kind == "ip" else _digits(value)
    return F.concat(F.lit(f"{kind}:"), plain)


def _spans_of(kind: str, rank: int, text: Column) -> Column:
    found = F.filter(positions(text, PATTERNS[kind]), lambda s: _valid(kind, s["value"]))
    return F.transform(found, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind"), _entity(kind, s["value"]).alias("entity")))


def base_spans(text: Column) -> Column:
    """array<struct<start, rank, end, kind, entity>> of the four kinds, by start, then kind as listed."""
    none = F.array().cast("array<struct<start:bigint,rank:int,end:bigint,kind:string,entity:string>>")
    return F.array_sort(F.concat(*[F.when(HINTS[kind](text), _spans_of(kind, rank, text)).otherwise(none) for rank, kind in enumerate(KINDS)]))


def _group(entity: Column) -> Column:
    """The domain of an e-mail address, the first two parts of a network address, the first six digits of a
    card, the first four of a telephone number."""
    kind, plain = F.substring_index(entity, ":", 1), F.substring_index(entity, ":", -1)
    part = F.when(kind == "email", F.substring_index(plain, "@", -1)).when(kind == "ip", F.substring_index(plain, ".", 2)).when(kind == "card", F.substring(plain, 1, 6)).otherwise(F.substring(plain, 1, 4))
    return F.concat(kind, F.lit("*:"), part)


def _kind(entity: Column) -> Column:
    return F.concat(F.substring_index(entity, ":", 1), F.lit("**"))


def _cut_out(pieces: Column, start: Column, end: Column) -> Column:
    """A part of a text given in pieces of _PIECE code points."""
    first = F.floor(start / _PIECE).cast("int")
    some = F.array_join(F.slice(pieces, first + 1, F.floor(end / _PIECE).cast("int") - first + 1), "")
    return F.when(end > start, F.substring(some, (start - first * _PIECE + 1).cast("int"), (end - start).cast("int"))).otherwise("")


def _near(pieces: Column, length: Column, span: Column, policy: Policy) -> Column:
    """struct(entity, context, terms): the window's digest and the whole words around a span, outside it, as
    array<struct<term, start, end>>.  Words that the window cuts are not whole."""
    w = policy.window
    left_at, right_end = F.greatest(span["start"] - w, F.lit(0).cast("bigint")), F.least(span["end"] + w, length)

    def words(piece: Column, at: Column) -> Column:
        long = F.filter(positions(piece, r"\p{L}+"), lambda s: F.char_length(s["value"]) >= policy.min_term)
        return F.transform(long, lambda s: F.struct(F.lower(s["value"]).alias("term"), (s["start"] + at).alias("start"), (s["end"] + at).alias("end")))

    def left(text: Column) -> Column:
        cut_off = F.when(left_at > 0, F.char_length(F.regexp_extract(text, r"^\p{L}*+", 0))).otherwise(0)
        return _let(cut_off, lambda n: words(F.substring(text, n + 1, w), left_at + n))

    def right(text: Column) -> Column:
        return words(F.when(right_end < length, F.regexp_replace(text, r"(?<!\p{L})\p{L}++$", "")).otherwise(text), span["end"])

    before_it, after_it = _cut_out(pieces, left_at, span["start"]), _cut_out(pieces, span["end"], right_end)
    context = F.xxhash64(_cut_out(pieces, left_at, F.least(left_at + 2 * w, length)))
    return F.struct(span["entity"].alias("entity"), context.alias("context"), F.concat(_let(before_it, left), _let(after_it, right)).alias("terms"))


def mark(docs: DataFrame, id_col: str, text_col: str, policy: Policy) -> DataFrame:
    """(id, row_key, base, near): every document's base spans, and for each of them the terms around.  The key,
    a digest of the text, is null where there are no spans."""
    text = F.col("_text")
    spans = docs.select(F.col(id_col), text_of(text_col).alias("_text")).withColumn("base", base_spans(text))
    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_PIECE}}}"), 0)
    context = _let(pieces, lambda p: _let(F.char_length(text).cast("bigint"), lambda n: F.transform("base", lambda s: _near(p, n, s, policy))))
    loud = F.size("base") > 0
    return spans.select(id_col, F.when(loud, F.unhex(F.md5(text.cast("binary")))).alias("row_key"), "base", F.when(loud, context).alias("near"))


def occurrences(marks: DataFrame) -> DataFrame:
    """A row a text, entity, group or kind, and term near it.  Equal texts are one, with their number."""
    texts = marks.filter("row_key is not null").groupBy("row_key").agg(F.count(F.lit(1)).alias("copies"), F.first("near").alias("near"))
    each = texts.select("row_key", "copies", F.explode("near").alias("n")).select("row_key", "copies", "n.entity", "n.context", F.explode("n.terms").alias("t"))
    # what counts as one piece of evidence: for an entity a surrounding, for a group or kind an entity, since copies
    # with edits surround one entity in many ways
    of_value = F.xxhash64("entity")
    levels = [F.struct(name.alias("entity"), what.alias("context")) for name, what in ((F.col("entity"), F.col("context")), (_group(F.col("entity")), of_value), (_kind(F.col("entity")), of_value))]
    return each.withColumn("level", F.explode(F.array(*levels))).select("row_key", "copies", "level.entity", "level.context", "t.term", "t.start", "t.end")


def disclosing_terms(docs: DataFrame, marks: DataFrame, near: DataFrame, text_col: str, policy: Policy, scratch: Scratch) -> DataFrame:
    """(entity, term, share, action), a table of ``scratch``: all pairs whose disclosure share reaches a
    threshold.  Document counts cover every document of ``docs``, terms inside as well as outside the windows."""
    contexts = near.groupBy("entity", "term", "context").agg(F.count(F.lit(1)).alias("n")).groupBy("entity", "term").agg(F.count(F.lit(1)).alias("contexts"))
    often = scratch.write(contexts.filter(F.col("contexts") >= policy.min_contexts).select("entity", "term"))
    by_text = near.join(few(often), ["entity", "term"], "left_semi").groupBy("entity", "term", "row_key").agg(F.first("copies").alias("copies"))
    of_pair = by_text.groupBy("entity", "term").agg(F.sum("copies").alias("n_pair"))
    own = marks.filter("row_key is not null").select(F.transform("base", lambda s: s["entity"]).alias("e"))
    kinds = F.array_distinct(F.concat("e", F.transform("e", _group), F.transform("e", _kind)))
    of_entity = own.select(F.explode(kinds).alias("entity")).groupBy("entity").agg(F.count(F.lit(1)).alias("n_entity"))
    words = F.array_distinct(F.filter(F.split(F.lower(text_of(text_col)), r"[^\p{L}]+"), lambda t: F.char_length(t) >= policy.min_term))
    wanted = scratch.write(often.select("term").distinct())
    # terms that are no candidates go before anything is shuffled, if the candidates are few
    of_term = docs.select(F.explode(words).alias("term")).join(few(wanted), "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("n_term"))
    total = docs.count()
    counted = often.join(of_pair, ["entity", "term"]).join(of_entity, "entity").join(of_term, "term")
    # the chance of the entity where the term stands, as if ``smoothing`` more documents with the term were as any other
    usual = F.col("n_entity") / F.lit(float(max(total, 1)))
    there = (F.col("n_pair") + F.lit(policy.smoothing) * usual) / (F.col("n_term") + F.lit(policy.smoothing))
    share = F.when(usual < 1, F.log2(there / usual) / -F.log2(usual)).otherwise(F.lit(0.0))
    action = F.when(share >= policy.remove, "remove").otherwise("generalise")
    return scratch.write(counted.select("entity", "term", share.alias("share"), action.alias("action")).filter(F.col("share") >= policy.generalise))


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", policy: Policy = Policy()) -> DataFrame:
    """One row per input row: id, ``row_key`` (digest of a text that has spans, else null), ``base`` (the base
    spans) and ``added`` (array of (start, end, action, entity) for disclosing terms, in order; a term that
    several entities condemn is one span, with the stronger action and the first of them).

    Null texts are empty and have no spans; repeated rows get equal spans; null ids stay null; an empty table
    gives none; other columns are ignored.
    """
    with Scratch(docs.sparkSession) as scratch:
        marks = scratch.write(mark(docs, id_col, text_col, policy))
        near = scratch.write(occurrences(marks))
        telling = disclosing_terms(docs, marks, near, text_col, policy, scratch)
        hits = near.join(few(telling), ["entity", "term"]).groupBy("row_key", "start", "end").agg(F.max("action").alias("action"), F.min("entity").alias("entity"))
        added = hits.groupBy("row_key").agg(F.array_sort(F.collect_list(F.struct("start", "end", "action", "entity"))).alias("added"))
        none = F.array().cast("array<struct<start:bigint,end:bigint,action:string,entity:string>>")
        with_terms = marks.filter("row_key is not null").join(added, "row_key", "left").select(id_col, "row_key", "base", F.coalesce("added", none).alias("added"))
        quiet = marks.filter("row_key is null").select(id_col, "row_key", "base", none.alias("added"))
        return cut(quiet.unionByName(with_terms))


def spans_text(spans: Column, kind) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kind(s), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _count(kind: str) -> Column:
    return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")


def report(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The digest columns: counts by kind, the base spans' SHA-256, all spans as text, how many there are, how
    many of them are terms, and the terms' actions in order, as action:start:end."""
    counts = [_count(k).alias(f"n_{k}") for k in KINDS]
    base = spans_text(F.col("base"), lambda s: s["kind"])
    # base spans come first at equal starts
    terms = F.transform("added", lambda s: F.struct(s["start"].alias("start"), F.lit(len(KINDS)).alias("rank"), s["end"].alias("end"), F.lit("term").alias("kind")))
    plain = F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))
    return found.select(
        id_col,
        *counts,
        F.sha2(base.cast("binary"), 256).alias("base_sha256"),
        spans_text(F.array_sort(F.concat(plain, terms)), lambda s: s["kind"]).alias("spans"),
        (F.size("base") + F.size("added")).cast("long").alias("n_spans"),
        F.size("added").cast("long").alias("n_term"),
        spans_text(F.col("added"), lambda s: s["action"]).alias("actions"),
    )


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", policy: Policy = Policy()) -> DataFrame:
    """``docs`` with ``text_col`` sanitised: entities become ``[KIND]``, disclosing terms ``[TERM]`` or
    nothing.  A span that begins inside an earlier one only extends what that one covers.

    Rows pair up by the text's digest, so repeated rows stay as they are and unaffected texts aren't moved.
    Null and empty texts stay as they are, rows without an id are changed like others, an empty table stays empty.
    """
    found = find_personal_data(docs, id_col, text_col, policy).filter("row_key is not null")
    changes = F.array_sort(
        F.concat(
            F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")).alias("new"))),
            F.transform("added", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.when(s["action"] == "remove", "").otherwise("[TERM]").alias("new"))),
        )
    )
    # one column beside those of the documents, named unlike any of them
    plan = free_name(docs, "_plan")
    ends = before(F.transform("_changes", lambda c: c["end"]), lambda x, y: F.greatest(x, y), F.lit(0).cast("bigint"))
    plans = cut(found.groupBy("row_key").agg(F.first(changes).alias("_changes")).withColumn("_ends", ends).select(F.struct("row_key", "_changes", "_ends").alias(plan)))
    text = text_of(text_col)
    of_row, ends_of = F.col(plan)["_changes"], F.col(plan)["_ends"]

    def rewritten(pieces: Column) -> Column:
        n = F.size(of_row)
        # what stands between the changes before and this one, then the new text where no earlier one reaches it
        each = F.transform(of_row, lambda c, i: F.concat(_cut_out(pieces, F.get(ends_of, i), F.greatest(c["start"], F.get(ends_of, i))), F.when(c["start"] >= F.get(ends_of, i), c["new"]).otherwise("")))
        last = F.greatest(F.get(ends_of, n - 1), F.get(of_row, n - 1)["end"])
        return F.concat(F.array_join(each, ""), _cut_out(pieces, last, F.greatest(last, F.char_length(text).cast("bigint"))))

    made = _let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_PIECE}}}"), 0), rewritten)
    joined = docs.join(plans, F.unhex(F.md5(text.cast("binary"))) == F.col(plan)["row_key"], "left")
    return joined.withColumn(text_col, F.when(F.col(plan).isNull(), F.col(text_col)).otherwise(made)).select(*[F.col(f"`{c}`") for c in docs.columns])
