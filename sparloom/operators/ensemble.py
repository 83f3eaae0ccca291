"""Label-wise votes and thresholds chosen on validation data only."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparloom.functions import vocabulary as V
from sparloom.functions.text import is_strict_binary
from sparloom.operators.gates import GateError
from sparloom.operators.metrics import rates


def to_long(df: DataFrame, id_col: str, labels: Sequence[str], value: str) -> DataFrame:
    """(id, label, value) rows."""
    return df.unpivot([id_col], list(labels), "label", value)


def validate_members(members: DataFrame, ids: DataFrame, id_col: str, labels: Sequence[str], member: str = "member", mode: str = "strict") -> DataFrame:
    """Members (wide rows of id, member, labels) against the ids they must cover.

    ``strict``: values binary, no repeats, every member covers the ids exactly.  ``lenient``: absent labels
    are 0 first.  ``block``: rows that aren't binary are left out, and then a member that doesn't cover the
    ids is an error, since zeros must not stand in for missing answers.
    """
    rows = members
    if mode == "lenient":
        rows = rows.withColumns({n: F.coalesce(F.col(n), F.lit(0)) for n in labels})
    good = F.lit(True)
    for n in labels:
        good = good & is_strict_binary(F.col(n))
    if mode == "block":
        rows = rows.filter(good)
    elif rows.filter(~good).limit(1).count():
        raise GateError("labels that aren't binary")
    if rows.groupBy(member, id_col).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1).count():
        raise GateError("a member has an id twice")
    wanted = ids.select(id_col).distinct()
    total = wanted.count()
    names = members.select(member).distinct()
    covered = rows.join(wanted, id_col, "left_semi").groupBy(member).agg(F.count(F.lit(1)).alias("n"))
    short = names.join(covered, member, "left").filter(F.coalesce("n", F.lit(0)) != total).limit(5).collect()
    if short:
        raise GateError(f"members that don't cover all ids: {[r[0] for r in short]}")
    if mode != "lenient" and rows.join(wanted, id_col, "left_anti").limit(1).count():
        raise GateError("ids that aren't wanted")
    return rows.join(wanted, id_col, "left_semi")


def vote_thresholds(labels: Sequence[str], members: int, default: int = 2, relaxed: Mapping[str, int] | Sequence[str] = ()) -> dict[str, int]:
    special = dict(relaxed) if isinstance(relaxed, Mapping) else dict.fromkeys(relaxed, 1)
    out = {n: int(special.get(n, default)) for n in labels}
    if any(not 1 <= t <= members for t in out.values()):
        raise ValueError(f"thresholds must lie between 1 and {members}")
    return out


def _threshold(thresholds: Mapping[str, int], default: int) -> Column:
    out = F.lit(default)
    for name, t in thresholds.items():
        out = F.when(F.col("label") == name, t).otherwise(out)
    return out


def vote(members: DataFrame, id_col: str, thresholds: Mapping[str, int], default: int = 2, keep: Sequence[str] = ()) -> DataFrame:
    """(id, label, kept columns, votes, pred) from long members (id, member, label, pred): one partial aggregate.
    ``keep`` names columns that are the same for all members."""
    return members.groupBy(id_col, "label").agg(*[F.max(c).alias(c) for c in keep], F.sum("pred").cast("int").alias("votes")).withColumn("pred", (F.col("votes") >= _threshold(thresholds, default)).cast("int"))


def threshold_sweep(votes: DataFrame, gold: DataFrame, id_col: str, members: int = 3) -> DataFrame:
    """(label, threshold, tp, fp, fn, precision, recall, f1, support): all thresholds in one pass."""
    joined = gold.join(votes.select(id_col, "label", "votes"), [id_col, "label"])
    tested = joined.select("label", "truth", "votes", F.explode(F.sequence(F.lit(1), F.lit(members))).alias("threshold"))
    hit = F.col("votes") >= F.col("threshold")
    counts = tested.groupBy("label", "threshold").agg(F.count_if(hit & (F.col("truth") == 1)).alias("tp"), F.count_if(hit & (F.col("truth") == 0)).alias("fp"), F.count_if(~hit & (F.col("truth") == 1)).alias("fn"))
    return rates(counts).withColumn("support", F.col("tp") + F.col("fn"))


def select_thresholds(sweep: DataFrame, base: int = 2, drops: Mapping[str, float] = V.PRECISION_DROPS, default_drop: float = V.DEFAULT_DROP, rare: Sequence[str] = V.RELAXED_VOTE_LABELS) -> DataFrame:
    """(label, constrained, unconstrained, rare_only): the best f1, then recall, then smallest threshold;
    constrained to precision at least that of ``base`` less the label's drop."""
    drop = F.lit(default_drop)
    for name, d in drops.items():
        drop = F.when(F.col("label") == name, d).otherwise(drop)
    at_base = sweep.filter(F.col("threshold") == base).select("label", F.col("precision").alias("_base"))
    rank = F.struct("f1", "recall", -F.col("threshold"))
    allowed = F.col("precision") >= F.col("_base") - drop
    best = sweep.join(at_base, "label").groupBy("label").agg(F.max_by("threshold", F.when(allowed, rank)).alias("constrained"), F.max_by("threshold", rank).alias("unconstrained"))
    return best.withColumn("rare_only", F.when(F.col("label").isin(*rare), F.col("unconstrained")).otherwise(F.lit(base)))


def apply_thresholds(votes: DataFrame, chosen: DataFrame, column: str = "constrained") -> DataFrame:
    """Thresholds learned elsewhere (a row a label) applied to votes."""
    return votes.drop("pred").join(F.broadcast(chosen.select("label", F.col(column).alias("threshold"))), "label").withColumn("pred", (F.col("votes") >= F.col("threshold")).cast("int"))
