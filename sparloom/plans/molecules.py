"""Registered queries over structures.  The tables hold none, so lines are put together from fragments by the
numbers of ``part``; the SQL builds the same molecules as tables of atoms and bonds, without reading any line."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column
from pyspark.sql import functions as F

from sparloom.functions import structures as S
from sparloom.functions import text as X
from sparloom.functions.lineage import cut, spread, worked_out
from sparloom.operators import ml, split
from sparloom.plans.contract import _register, _table

#: Fragments as text; a chain has one to four of them between two methyl groups.  The ring of six has two spellings.
FRAGMENTS = ("C", "N", "O", "C(=O)", "c1ccc(cc1)", "C1CC(C1)", "S", "C(F)(Cl)")
RING_WITH_DOUBLE_BONDS = "C1=CC=C(C=C1)"
RINGS = (4, 5)

# SQL tables of the same: (fragment, atom, element, hydrogens, in a ring), (fragment, a, b, kind, in a ring), (fragment, atoms, last atom); 8 is a methyl
_ATOMS = "(0,0,6,2,0),(1,0,7,1,0),(2,0,8,0,0),(3,0,6,0,0),(3,1,8,0,0),(4,0,6,0,1),(4,1,6,1,1),(4,2,6,1,1),(4,3,6,0,1),(4,4,6,1,1),(4,5,6,1,1),(5,0,6,1,1),(5,1,6,2,1),(5,2,6,1,1),(5,3,6,2,1),(6,0,16,0,0),(7,0,6,0,0),(7,1,9,0,0),(7,2,17,0,0),(8,0,6,3,0)"
_BONDS = "(3,0,1,2),(4,0,1,5),(4,1,2,5),(4,2,3,5),(4,3,4,5),(4,4,5,5),(4,5,0,5),(5,0,1,1),(5,1,2,1),(5,2,3,1),(5,3,0,1),(7,0,1,1),(7,0,2,1)"
_SIZES = "(0,1,0),(1,1,0),(2,1,0),(3,2,0),(4,6,3),(5,4,2),(6,1,0),(7,3,0),(8,1,0)"
_CHAIN = "list_transform(range(1 + p_partkey % 4), lambda i: (p_partkey // (8 ** i)::BIGINT + p_size) % 8)"


def _chain() -> Column:
    """The numbers of a part's fragments."""
    n, size = F.col("p_partkey"), F.col("p_size")
    return F.transform(F.sequence(F.lit(0), (n % 4).cast("int")), lambda i: (F.floor(n / F.pow(F.lit(8.0), i)) + size) % 8)


def lines(spark, sf_dir):
    """(p_partkey, line): odd parts have their chain written from the other end, some rings with double bonds."""
    texts = F.array(*[F.when((F.lit(i) == 4) & (F.col("p_size") % 2 == 1), RING_WITH_DOUBLE_BONDS).otherwise(t) for i, t in enumerate(FRAGMENTS)])
    order = F.when(F.col("p_partkey") % 2 == 1, F.reverse(_chain())).otherwise(_chain())
    parts = F.transform(order, lambda i: F.get(texts, i.cast("int")))
    return _table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("C"), F.array_join(parts, ""), F.lit("C")).alias("line"))


#: Lines to a task: one takes milliseconds.
LINES = 250


def _digest(*parts: str) -> str:
    return f"('0x' || substr(md5(concat_ws(',', {', '.join(parts)})), 1, 15))::BIGINT"


def _round(level: int) -> str:
    """SQL of a round: codes and environments from those of the one before."""
    return f"""s{level} AS (SELECT x.p, x.atom, {_digest(str(level), 'any_value(o.code)', "string_agg(x.kind || ':' || lpad(n.code::VARCHAR, 19, '0'), ';' ORDER BY x.kind || ':' || lpad(n.code::VARCHAR, 19, '0'))")} AS code,
  list_sort(list_distinct(flatten(list(list_concat([x.bond], n.env))) || any_value(o.env))) AS env
  FROM near x JOIN s{level - 1} o ON o.p = x.p AND o.atom = x.atom JOIN s{level - 1} n ON n.p = x.p AND n.atom = x.other GROUP BY x.p, x.atom)"""


_BITS_SQL = f"""
WITH fa(f, i, element, hydrogens, ring) AS (VALUES {_ATOMS}), fb(f, a, b, kind) AS (VALUES {_BONDS}), fs(f, n, out_atom) AS (VALUES {_SIZES}),
c AS (SELECT p_partkey AS p, [8] || {_CHAIN} || [8] AS l FROM part),
e AS (SELECT p, unnest(l) AS f, unnest(range(len(l))) AS pos FROM c),
o AS (SELECT e.*, fs.out_atom, coalesce(sum(fs.n) OVER (PARTITION BY p ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS start FROM e JOIN fs USING (f)),
atoms AS (SELECT p, start + i AS atom, element, hydrogens, ring FROM o JOIN fa USING (f)),
links AS (SELECT p, start + a AS a, start + b AS b, kind FROM o JOIN fb USING (f)
  UNION ALL SELECT x.p, x.start + x.out_atom, y.start, 1 FROM o x JOIN o y ON x.p = y.p AND y.pos = x.pos + 1),
bonds AS (SELECT *, row_number() OVER (PARTITION BY p ORDER BY a, b) AS bond FROM links),
near AS (SELECT p, a AS atom, b AS other, kind, bond FROM bonds UNION ALL SELECT p, b, a, kind, bond FROM bonds),
s0 AS (SELECT p, atom, {_digest('any_value(element)', 'count(*)', 'any_value(hydrogens)', '0', '0', 'any_value(ring)')} AS code, []::BIGINT[] AS env FROM atoms JOIN near USING (p, atom) GROUP BY p, atom),
{_round(1)}, {_round(2)},
found AS (SELECT p, code FROM s0 UNION ALL
  SELECT p, code FROM (SELECT p, 1 AS level, code, env FROM s1 UNION ALL SELECT p, 2, code, env FROM s2) QUALIFY row_number() OVER (PARTITION BY p, env ORDER BY level, code) = 1)
SELECT p AS p_partkey, count(DISTINCT code % 2048)::INT AS n_bits, md5(string_agg(DISTINCT (code % 2048)::VARCHAR, ',' ORDER BY (code % 2048)::VARCHAR)) AS bits, any_value(n_atoms)::INT AS n_atoms
FROM found JOIN (SELECT p, count(*) AS n_atoms FROM atoms GROUP BY p) USING (p) GROUP BY p"""


@_register(_BITS_SQL)
def circular_bits(spark, sf_dir):
    bits = worked_out(lines(spark, sf_dir), ["line"], {"m": F.transform(F.array(S.parse(F.col("line"))), lambda m: F.struct(F.size(m["atoms"]).alias("n_atoms"), S.circular_bits(m).alias("b")))[0]}, LINES).select("p_partkey", "m.*")
    return bits.select("p_partkey", F.size("b").alias("n_bits"), F.md5(F.array_join(F.array_sort(F.col("b").cast("array<string>")), ",").cast("binary")).alias("bits"), "n_atoms")


# A frame reaches from the first ring to the last; side atoms go, but for those on double bonds.  Read from either end
# it is the same one.
_FRAMES_SQL = f"""
c AS (SELECT p_partkey AS p, {_CHAIN} AS l FROM part),
r AS (SELECT p, l, list_filter(range(1, len(l) + 1), lambda i: l[i] IN {RINGS}) AS rings FROM c),
k AS (SELECT p, CASE WHEN len(rings) = 0 THEN [] ELSE list_transform(l[rings[1]:rings[-1]], lambda f: CASE WHEN f = 7 THEN 0 ELSE f END) END AS l FROM r),
frames AS (SELECT p, least(array_to_string(l, ','), array_to_string(list_reverse(l), ',')) AS frame FROM k)"""


def _scaffolds(spark, sf_dir):
    found = worked_out(lines(spark, sf_dir), ["line"], {"scaffold": S.scaffold(F.col("line"))}, LINES)
    return found, found.groupBy("scaffold").agg(F.min("p_partkey").alias("first_key"), F.count(F.lit(1)).alias("n"))


@_register(f"WITH {_FRAMES_SQL} SELECT p AS p_partkey, min(p) OVER (PARTITION BY frame) AS first_key, count(*) OVER (PARTITION BY frame) AS n, frame <> '' AS has_ring FROM frames")
def ring_scaffolds(spark, sf_dir):
    """Each part's scaffold by the smallest part that has it."""
    found, groups = _scaffolds(spark, sf_dir)
    return found.join(groups, "scaffold").select("p_partkey", "first_key", "n", (F.col("scaffold") != "NO_SCAFFOLD").alias("has_ring"))


@_register(f"WITH {_FRAMES_SQL} SELECT min(p) AS first_key, count(*) AS n, 1 AS n_splits FROM frames GROUP BY frame")
def scaffold_split(spark, sf_dir):
    """A split by scaffold keeps each of them whole."""
    found = worked_out(lines(spark, sf_dir), ["line"], {"scaffold": S.scaffold(F.col("line"))}, LINES).withColumns({"lab_a": (F.col("p_partkey") % 3 == 0).cast("int"), "lab_b": (F.col("p_partkey") % 7 == 0).cast("int")})
    done = split.group_split(cut(found), "scaffold", ["lab_a", "lab_b"], 0.1, 0.1, 123)
    return done.groupBy("scaffold").agg(F.min("p_partkey").alias("first_key"), F.count(F.lit(1)).alias("n"), F.count_distinct("split").cast("int").alias("n_splits")).drop("scaffold")


#: Ways to spoil a line, by the part's number, and what is said about each.
SPOILT = (("{}(", "branch"), ("{}1", "ring closure"), ("F={}", "valence"), ("{}=", "bond"), ("X{}", "symbol"), ("c1cccc1{}", "aromatic"))
_SAID = "CASE p_partkey % 13 " + " ".join(f"WHEN {i} THEN '{why}'" for i, (_, why) in enumerate(SPOILT)) + " ELSE 'none' END"


@_register(f"SELECT {_SAID} AS problem, count(*) AS n, min(p_partkey) AS first_key FROM part GROUP BY 1")
def structure_problems(spark, sf_dir):
    line = F.col("line")
    for i, (form, _) in enumerate(SPOILT):
        before, after = form.split("{}")
        line = F.when(F.col("p_partkey") % 13 == i, F.concat(F.lit(before), F.col("line"), F.lit(after))).otherwise(line)
    said = worked_out(lines(spark, sf_dir).withColumn("line", line), ["line"], {"problem": F.coalesce(S.parse(F.col("line"))["problem"], F.lit("none"))}, LINES)
    return said.groupBy("problem").agg(F.count(F.lit(1)).alias("n"), F.min("p_partkey").alias("first_key"))


# ---- models --------------------------------------------------------------------------------------------

# Two labels, one told by the structure and one by a number, each wrong in a tenth of the rows.
_NOISE = "(('0x' || substr(md5('{0}:' || p_partkey), 1, 8))::BIGINT % 10 = 0)"
_LABELS_SQL = f"""
l AS (SELECT p_partkey, ((len(list_filter({_CHAIN}, lambda f: f IN (3, 4))) > 0) <> {_NOISE.format('a')})::INT AS a, ((p_size > 25) <> {_NOISE.format('b')})::INT AS b,
  ('0x' || substr(md5('t:' || p_partkey), 1, 8))::BIGINT % 4 = 0 AS held_out FROM part)"""


def _labelled(spark, sf_dir):
    p = F.col("p_partkey")
    wrong = lambda name: X.hashed_int(name, p) % 10 == 0
    told = F.exists(_chain(), lambda f: f.isin(3, 4))
    made = _table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("string").alias("size"), (told != wrong("a")).cast("int").alias("a"), ((F.col("p_size") > 25) != wrong("b")).cast("int").alias("b"), (X.hashed_int("t", p) % 4 == 0).alias("held_out"))
    bits = worked_out(lines(spark, sf_dir), ["line"], {"structure": array_to_vector(S.bit_vector(S.circular_bits(S.parse(F.col("line")), bits=256), 256))}, LINES)
    return spread(made, "p_partkey").join(bits.drop("line"), "p_partkey")


@_register(
    f"""WITH {_LABELS_SQL}, m(model, structure, physical) AS (VALUES ('both_joint', true, true), ('physical_joint', false, true), ('structure_joint', true, false), ('physical_logistic', false, true), ('structure_logistic', true, false))
SELECT model, label, count(*) AS n, sum(truth)::BIGINT AS n_pos, any_value(CASE label WHEN 'a' THEN structure ELSE physical END) AS informed
FROM (SELECT p_partkey, 'a' AS label, a AS truth FROM l WHERE held_out UNION ALL SELECT p_partkey, 'b', b FROM l WHERE held_out), m GROUP BY model, label"""
)
def five_models(spark, sf_dir):
    """Five models on three feature sets, judged on rows that none of them saw: a model that has what tells a label is
    right in more than 70 % of the rows (90 % can be known), one that hasn't isn't."""
    rows = ml.typed_features(_labelled(spark, sf_dir), ["size"], [])
    pipeline = ml.feature_pipeline(rows.filter("not held_out"), ["size"], [], out="physical")
    whole = VectorAssembler(inputCols=["physical", "structure"], outputCol="both").transform(pipeline.transform(rows))
    whole = cut(whole.select("p_partkey", "a", "b", "held_out", "physical", "structure", "both"))
    found = ml.baselines(whole.filter("not held_out"), whole.filter("held_out"), ["a", "b"], "p_partkey", {k: k for k in ("physical", "structure", "both")}, trees=4, depth=4)
    parts = None
    for model, said in found.items():
        each = said.select("a", "b", "pred_a", "pred_b").select(F.explode(F.array(*[F.struct(F.lit(x).alias("label"), F.col(x).alias("truth"), F.col(f"pred_{x}").alias("pred")) for x in "ab"])).alias("r")).select("r.*")
        one = each.groupBy("label").agg(F.lit(model).alias("model"), F.count(F.lit(1)).alias("n"), F.sum("truth").cast("long").alias("n_pos"), (F.avg((F.col("truth") == F.col("pred")).cast("double")) > 0.7).alias("informed"))
        parts = one if parts is None else parts.unionByName(one)
    return parts
