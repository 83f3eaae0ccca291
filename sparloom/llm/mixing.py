"""Mixing sources to target weights by Poisson replication (operator 7).

The mean repetition rate of a source is its target share of the output divided by its share of the input.
Each document's count is the Poisson distribution with that mean, inverted at a uniform number hashed from a
seed and the document's id, so any executor, retry or other engine draws the same count.  The document is
exploded by its count and the copies are put in a global order by a hash of seed, id and copy number.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparloom.llm.common import cut, free_name, range_count

#: Of the 60 hash bits, so that the quotient is exact enough on any engine.
_UNIT = float(1 << 60)


def hashed_unit(seed: int, *parts: Column) -> Column:
    """A uniform number in [0, 1) from md5; null parts count as empty."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long").cast("double") / F.lit(_UNIT)


def source_rates(docs: DataFrame, source_col: str, weights: Mapping[str, float] | None, temperature: float, size_ratio: float) -> DataFrame:
    """(source, n, rate), one row a source.

    ``weights`` are target shares by source (those not named get 0); without them a source's target share is
    its input share to the power ``temperature``, scaled to one.  The output has ``size_ratio`` times the
    input's rows on average.
    """
    counts = docs.groupBy(F.col(source_col).alias("source")).agg(F.count(F.lit(1)).alias("n"))
    if weights is None:
        share = F.pow(F.col("n").cast("double"), F.lit(float(temperature)))
    else:
        if not weights or min(weights.values()) < 0 or sum(weights.values()) <= 0:
            raise ValueError("target weights must not be negative, and not all zero")
        given = docs.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()], "source string, w double")
        counts = counts.join(F.broadcast(given), "source", "left")
        share = F.coalesce(F.col("w"), F.lit(0.0))
    shared = counts.withColumn("share", share)
    totals = shared.agg(F.sum("n").alias("all_n"), F.sum("share").alias("all_share"))
    joined = shared.crossJoin(F.broadcast(totals))  # of one row
    rate = F.lit(float(size_ratio)) * F.col("all_n") * F.col("share") / F.col("all_share") / F.col("n")
    return joined.select("source", "n", rate.alias("rate"))


def cumulative_table(rates: DataFrame) -> DataFrame:
    """(source, cdf array): the distribution of every source's count up to mean + 40 deviations + 60."""
    steps = F.sequence(F.lit(1), F.ceil(F.col("rate") + 40 * F.sqrt("rate") + 60).cast("int"))
    first = F.exp(-F.col("rate"))

    def add(acc: Column, j: Column) -> Column:
        p = acc["p"] * F.col("rate") / j
        return F.struct(p.alias("p"), F.concat(acc["cdf"], F.array(F.element_at(acc["cdf"], -1) + p)).alias("cdf"))

    start = F.struct(first.alias("p"), F.array(first).alias("cdf"))
    return rates.withColumn("cdf", F.aggregate(steps, start, add, lambda acc: acc["cdf"]))


#: A table for a rate above this would need more than its mean in entries, and exp(-rate) nears zero; counts of
#: higher rates are sums of several.  The whole output isn't larger than the input by more either.
MAX_RATE = 500.0
#: At about 1 to 15 kB a source.
MAX_BROADCAST_SOURCES = 2_000


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    weights: Mapping[str, float] | None = None,
    temperature: float = 0.5,
    size_ratio: float = 1.0,
    seed: int = 7,
    shuffle: bool = True,
) -> DataFrame:
    """The rows of ``docs``, each as often as its Poisson count, with ``copy_no`` (from 0) and ``shuffle_key``.

    Rows come in global order of ``shuffle_key`` (``shuffle=False`` leaves the order alone): the key is uniform,
    so its first digits say the partition, and no sample of the keys is taken, which would draw everything twice.  Columns of
    these two names are replaced.  A null source is a source of its own; null ids draw as the empty id;
    repeated rows draw alike; an empty table gives an empty one.  A source's rate may be any: above
    ``MAX_RATE`` the count is the sum of the fewest Poisson counts of equal rates up to it, each hashed by its
    number, which is Poisson of the whole rate.  ``size_ratio`` above ``MAX_RATE`` is an error.
    """
    if size_ratio > MAX_RATE:
        raise ValueError("size ratio above MAX_RATE")
    rates = source_rates(docs, source_col, weights, temperature, size_ratio).withColumn("_parts", F.greatest(F.lit(1), F.ceil(F.col("rate") / F.lit(MAX_RATE)).cast("int")))
    # one column beside those of the documents, and two that are worked out, named unlike any of them
    of_source, unit, number = (free_name(docs, name) for name in ("_rate", "_unit", "_number"))
    table = cumulative_table(rates.withColumn("rate", F.col("rate") / F.col("_parts")))
    tables = cut(table.select(F.struct("source", "cdf", F.col("_parts").alias("parts")).alias(of_source)))
    if tables.count() <= MAX_BROADCAST_SOURCES:
        tables = F.broadcast(tables)
    keep = [F.col(f"`{c}`") for c in docs.columns if c not in ("copy_no", "shuffle_key")]
    cdf, parts = F.col(of_source)["cdf"], F.col(of_source)["parts"]
    # broadcast only up to a counted number of sources; beyond it an ordinary join, whose hot keys AQE splits
    drawn = docs.select(*keep).join(tables, F.col(source_col).eqNullSafe(F.col(of_source)["source"]), "left").withColumn(unit, hashed_unit(seed, F.col(id_col)))
    count = F.size(F.filter(cdf, lambda c: c <= F.col(unit)))
    # the first count as for any rate; the others only where there are more
    others = F.aggregate(F.sequence(F.lit(1), parts - 1), F.lit(0), lambda acc, i: acc + F.size(F.filter(cdf, lambda c: c <= hashed_unit(seed, F.col(id_col), F.lit("part"), i))))
    count = count + F.when(parts > 1, others).otherwise(F.lit(0))
    copies = drawn.withColumn(number, count).filter(F.col(number) > 0).select(*keep, F.explode(F.sequence(F.lit(0), F.col(number) - 1)).alias("copy_no"))
    keyed = copies.withColumn("shuffle_key", F.md5(F.concat_ws(":", F.lit(f"{seed}s"), F.coalesce(F.col(id_col).cast("string"), F.lit("")), "copy_no").cast("binary")))
    if not shuffle:
        return keyed
    n = range_count(docs)
    at = F.shiftright(F.conv(F.substring("shuffle_key", 1, 8), 16, 10).cast("long") * F.lit(n), 32).cast("int")
    return keyed.repartitionById(n, at).sortWithinPartitions("shuffle_key")
