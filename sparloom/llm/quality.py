"""Quality classification by importance resampling (operator 6).

Two generative models over hashed word n-grams (one and two words, a fixed number of buckets) are counted:
the raw one over every document, the target one over labelled good documents.  A document's weight is the
log ratio of the two models over all its n-grams.  Documents are then sampled without replacement in
proportion to their weights: the k largest of log weight plus Gumbel noise, where the noise comes from a
hash of seed and id.  k is the number of documents whose weight passes the cut that separates the labelled
documents best, so the sample is as large as the corpus has documents like the target.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparloom.llm.common import cut, keeping_nothing, row_key, ship, small_batches, text_chunks, text_of, without_rows
from sparloom.llm.mixing import hashed_unit
from sparloom.llm.words import AGAIN, WORD, hashed_words

BUCKETS = 1 << 14
#: Labelled rows that the target model and the cut are fitted on, chosen by a hash of the id; the only sample.
LABELLED_ROWS = 50_000
#: Pseudo-counts a bucket, on average, that draw the target model to the raw one where there is little text.
SMOOTHING = 10.0


def ngram_buckets(words: np.ndarray, buckets: int = BUCKETS) -> np.ndarray:
    """The buckets of all one- and two-word n-grams of a whole text, given by its ``parts``, repeats included,
    and of its shape in threes: which of three neighbours are words, and what the others are.  A word that
    repeats the one before it shows as a mark, so that runs of one word are an n-gram of their own."""
    if not len(words):
        return np.zeros(0, np.int64)
    t = words.copy()
    t[1:][words[1:] == words[:-1]] = AGAIN
    one = t * np.uint64(0x9E3779B97F4A7C15)
    two = (t[:-1] * np.uint64(0xC2B2AE3D27D4EB4F)) ^ ((t[1:] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    two *= np.uint64(0xD6E8FEB86659FD93)
    shape = np.where(t & np.uint64(1), np.uint64(WORD), t)
    three = (shape[:-2] * np.uint64(0xA24BAED4963EE407)) ^ (shape[1:-1] * np.uint64(0x9FB21C651E98DF25)) ^ ((shape[2:] + np.uint64(3)) * np.uint64(0xC2B2AE3D27D4EB4F))
    three *= np.uint64(0xD6E8FEB86659FD93)
    shift = np.uint64(64 - int(buckets).bit_length() + 1)
    return np.concatenate((one >> shift, two >> shift, three >> shift)).astype(np.int64)


def text_buckets(texts: list[str], buckets: int = BUCKETS) -> list[np.ndarray]:
    return [ngram_buckets(w, buckets) for w in hashed_words(texts, "parts")]


def count_models(docs: DataFrame, target_ids: set, id_col: str, text_col: str, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """(raw, target) counts by bucket over every document.  Each task sends at most one row a bucket, and the
    driver gets at most ``buckets`` rows, whatever the input."""
    # the identifiers are at most LABELLED_ROWS
    wanted = docs.sparkSession.sparkContext.broadcast(target_ids)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        ids = wanted.value
        for part in text_chunks(batches):
            found = text_buckets(part.column(1).to_pylist(), buckets)
            raw += np.bincount(np.concatenate(found), minlength=buckets)
            ours = [b for key, b in zip(part.column(0).to_pylist(), found, strict=True) if key in ids]
            if ours:
                target += np.bincount(np.concatenate(ours), minlength=buckets)
        some = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(raw[some]), pa.array(target[some])], names=["bucket", "raw", "target"])

    ship(docs.sparkSession)
    sent = docs.select(F.col(id_col), text_of(text_col).alias("t")).mapInArrow(keeping_nothing(count), "bucket long, raw long, target long")
    with small_batches(docs.sparkSession):
        got = sent.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toPandas()
    raw, target = np.zeros(buckets), np.zeros(buckets)
    raw[got["bucket"]], target[got["bucket"]] = got["raw"], got["target"]
    return raw, target


def log_weights(found: list[np.ndarray], raw: np.ndarray, target: np.ndarray, is_target: np.ndarray, smoothing: float = SMOOTHING) -> np.ndarray:
    """For each document the log ratio of target and raw model over its n-gram buckets.  Its own counts are left
    out of both models, so that labelled documents aren't favoured.  The target model has the raw one as its
    prior.  0 where a document has no n-grams or no target text is left."""
    sizes = np.array([len(b) for b in found], np.int64)
    keys, own = np.unique(np.concatenate(found) + np.repeat(np.arange(len(found)) * len(raw), sizes), return_counts=True)
    doc, b = keys // len(raw), keys % len(raw)
    all_raw, all_target = raw.sum() - sizes, target.sum() - sizes * is_target
    weight = smoothing * len(raw)
    prior = (raw[b] - own + 0.5) / (all_raw + 0.5 * len(raw))[doc]
    likely = (target[b] - own * is_target[doc] + weight * prior) / (all_target + weight)[doc]
    out = np.bincount(doc, weights=own * np.log(likely / prior), minlength=len(found))
    return np.where((all_target <= 0) | (all_raw <= 0), 0.0, out)


def best_cut(weights: np.ndarray, good: np.ndarray) -> float:
    """The cut with the best balanced accuracy for weight >= cut, where losing good documents counts twice:
    the middle of its gap, or one that keeps all where only one class is labelled."""
    if not len(weights) or good.all() or not good.any():
        return -math.inf
    order = np.argsort(weights, kind="stable")
    w, g = weights[order], good[order]
    lost = np.concatenate(([0], np.cumsum(g))) / g.sum()
    caught = np.concatenate(([0], np.cumsum(~g))) / (~g).sum()
    edge = np.concatenate(([True], w[1:] > w[:-1], [True]))
    i = int(np.argmax(np.where(edge, caught - 2 * lost, -np.inf)))
    if i in (0, len(w)):
        return -math.inf if i == 0 else math.inf
    return float((w[i - 1] + w[i]) / 2)


def gumbel(seed: int, key: Column) -> Column:
    u = hashed_unit(seed, key)
    return -F.log(-F.log(F.greatest(u, F.lit(2.0**-61))))


def _sortable(x: Column) -> Column:
    """A double as a whole number of the same order, between 0 and 2^52: floor of an increasing map."""
    return F.floor((F.atan(x / F.lit(1024.0)) / F.lit(math.pi) + F.lit(0.5)) * F.lit(float(1 << 52))).cast("long")


def kth_largest(df: DataFrame, col: str, k: int) -> int | None:
    """The k-th largest of a column of whole numbers from 0 to 2^52, exactly, by four counted digits: each
    pass counts the rows by one 13-bit digit under the prefix found so far, so at most 8192 rows reach the
    driver, and no sort of the table is needed.  None if there are fewer than k rows."""
    prefix, left = 0, k
    for level in (39, 26, 13, 0):
        digit = F.shiftright(F.col(col), level)
        rows = df.filter(F.shiftright(F.col(col), level + 13) == prefix) if level < 39 else df
        counts = rows.groupBy(digit.alias("d")).agg(F.count(F.lit(1)).alias("n")).collect()
        for r in sorted(counts, key=lambda r: -r["d"]):
            if r["n"] >= left:
                prefix = r["d"]
                break
            left -= r["n"]
        else:
            return None
    return prefix


def importance_sample(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    quality_col: str = "quality",
    toxic_col: str | None = "toxic",
    k: int | None = None,
    seed: int = 6,
    labelled_rows: int = LABELLED_ROWS,
    buckets: int = BUCKETS,
    smoothing: float = SMOOTHING,
    with_key: bool = False,
) -> DataFrame:
    """One row per input row: id, ``row_key`` if asked for, ``n_ngrams``, ``log_weight``, ``gumbel_key``, ``kept``.

    Good documents are those with quality 1 that aren't toxic.  Toxic ones with quality 1 are neither good nor
    poor to the fit: quality is judged, not toxicity, so they are kept like others of their quality.  At most ``labelled_rows`` labelled rows are
    used, those with the smallest digest of their id; everything else covers all documents.  ``k`` fixes the
    size of the sample; without it, it is the number of documents above the cut.  Rows whose key ties with
    the k-th are kept too.  Null and empty texts have no n-grams and weight 0; null ids share one noise
    value; labels with null quality are not used; without good labels all weights are 0, and without both
    classes all documents are kept; an empty table gives none.
    """
    spark = docs.sparkSession
    toxic = F.coalesce(F.col(toxic_col), F.lit(0)) if toxic_col else F.lit(0)
    usable = labels.filter(F.col(quality_col).isNotNull() & F.col(id_col).isNotNull())
    sample = usable.select(F.col(id_col).alias("id"), F.when((F.col(quality_col) == 1) & (toxic == 0), 1).when(F.col(quality_col) == 0, 0).alias("good")).filter("good is not null")
    chosen = sample.groupBy("id").agg(F.min("good").alias("good")).orderBy(F.md5(F.col("id").cast("string").cast("binary")), "id").limit(labelled_rows).collect()
    good = {r["id"]: r["good"] == 1 for r in chosen}
    raw, target = count_models(docs, {i for i, g in good.items() if g}, id_col, text_col, buckets)
    models = spark.sparkContext.broadcast((raw, target, {i for i, g in good.items() if g}))  # ``buckets`` counts, ``labelled_rows`` ids

    def weigh(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, wanted, ours = models.value
        for part in text_chunks(batches):
            found = text_buckets(part.column(2).to_pylist(), buckets)
            labelled = np.array([key in ours for key in part.column(0).to_pylist()])
            weights = log_weights(found, counts, wanted, labelled, smoothing)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([len(b) for b in found], pa.int64()), pa.array(np.round(weights, 6))], names=[id_col, "row_key", "n_ngrams", "log_weight"])

    kind = docs.schema[id_col].dataType.simpleString()
    key = row_key(id_col, text_col) if with_key else F.lit(None).cast("binary")
    weighed = docs.select(F.col(id_col), key.alias("row_key"), text_of(text_col).alias("t")).mapInArrow(keeping_nothing(weigh), f"`{id_col}` {kind}, row_key binary, n_ngrams long, log_weight double")
    keyed = cut(weighed.withColumn("gumbel_key", F.col("log_weight") + gumbel(seed, F.col(id_col))).withColumn("_order", _sortable(F.col("gumbel_key"))))
    if k is None:
        marks = spark.createDataFrame([(i, g) for i, g in good.items()], f"_id {kind}, _good boolean") if good else None
        # one weight a labelled id, the smallest where ids repeat: as many rows as labelled ones at most
        weights = keyed.select(F.col(id_col).alias("_id"), "log_weight")
        seen = weights.join(F.broadcast(marks), "_id").groupBy("_id", "_good").agg(F.min("log_weight").alias("log_weight")).toPandas() if marks is not None else None
        bound = best_cut(seen["log_weight"].to_numpy(), seen["_good"].to_numpy(bool)) if seen is not None else -math.inf
        k = keyed.filter(F.col("log_weight") >= F.lit(bound)).count()
    last = kth_largest(keyed, "_order", k) if k > 0 else None
    kept = F.lit(True) if last is None and k > 0 else F.lit(False) if k <= 0 else F.col("_order") >= F.lit(last)
    return keyed.select(id_col, *["row_key"] * with_key, "n_ngrams", "log_weight", "gumbel_key", kept.alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The documents in the importance sample, all their columns and rows: weight and noise depend on id and
    text alone, so rows without an id or with a repeated one are kept or go each by its own text."""
    judged = importance_sample(docs, labels, id_col, text_col, with_key=True, **how)
    return without_rows(docs, judged.filter("not kept").select("row_key").distinct(), id_col, text_col)
