"""Hard negatives by a two-dimensional block matrix multiply (operator 12).

Rows are cut into blocks.  An anchor block i meets a row block j once in each of two passes, in a shuffled join of
the tiles (i, j), never a broadcast: both sides are copied once for every block of the other, far beyond what the
planner's estimate of the stored blocks says.  The task that has both multiplies them, a slab of anchors and a chunk
of components at a time.  The first pass gives the tile's best positives of every anchor; when those of all tiles are
reduced, the anchor-positive windows are known, travel with the anchor blocks, and the second pass gives the tile's
first negatives within each window, which are reduced again.  Scores are never stored: what leaves a tile is bounded
by its anchors, and no task holds more than a slab of scores.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparloom.llm.common import Scratch, cut, keeping_nothing, range_count, ship
from sparloom.llm.vectors import dimensions, floored, matrix, usable

#: Anchors and rows of a block, components of a chunk.
ANCHORS, ROWS, CHUNK = 1024, 8192, 256
#: Components of a block at most (wide vectors have fewer to a block), scores of a slab, and tiles to a task.
CELLS, SLAB, TILES = 1 << 20, 1 << 20, 16
#: Whole numbers beyond this aren't taken: products of 2**20 components still fit into 64 bits a hundredfold.
MOST = 1 << 17

RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def _tiles(rows: DataFrame, blocks: int, width: int, scale: int) -> DataFrame:
    """(block, number, id, label, cells): one row a block, its rows in order of id, cells as 32-bit numbers."""
    schema = "block int, u binary, id binary, label binary, cells binary"
    ship(rows.sparkSession)

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        at = -1

        def close() -> Iterator[pa.RecordBatch]:
            u, ids, labels, cells = (np.concatenate(c) for c in zip(*held, strict=True))
            held.clear()
            row = [at, *(a.astype("<i8").tobytes() for a in (u, ids, labels)), cells.astype("<i4").tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, [pa.int32()] + [pa.binary()] * 4, strict=True)], names=["block", "u", "id", "label", "cells"])

        for batch in batches:
            if not batch.num_rows:
                continue
            block, u, ids, labels = (batch.column(c).to_numpy() for c in range(4))
            cells = floored(matrix(batch.column(4), width), scale, MOST)
            firsts = np.append(0, np.flatnonzero(np.diff(block)) + 1)
            for a, z in zip(firsts.tolist(), [*firsts[1:].tolist(), len(block)], strict=True):
                if held and block[a] != at:
                    yield from close()
                at = int(block[a])
                held.append((u[a:z], ids[a:z], labels[a:z], cells[a:z]))
        if held:
            yield from close()

    placed = rows.withColumn("block", F.pmod(F.xxhash64("u"), F.lit(blocks)).cast("int"))
    parts = min(blocks, max(range_count(rows), 1))
    return placed.select("block", "u", "id", "label", "vector").repartition(parts, "block").sortWithinPartitions("block", "id", "u").mapInArrow(keeping_nothing(pack), schema)


def _longs(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<i8")


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a times b transposed, exact: by floating point where no sum can reach 2**53."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    if float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def leading(scores: np.ndarray, most: int) -> np.ndarray:
    """Places of the ``most`` highest scores, highest first; places are in order of id, which settles ties."""
    if len(scores) > 4 * most:
        kept = np.flatnonzero(scores >= np.partition(scores, len(scores) - most)[len(scores) - most])
        return kept[np.argsort(-scores[kept], kind="stable")[:most]]
    return np.argsort(-scores, kind="stable")[:most]


def reduced(found: list[np.ndarray], keys: int, most: int) -> np.ndarray:
    """Rows (keys, score, id, more) of several tiles: of each key the first ``most`` by falling score, then by the
    rest in their order."""
    rows = np.concatenate(found)
    by = [rows[:, i] for i in range(keys)] + [-rows[:, keys]] + [rows[:, i] for i in range(keys + 1, rows.shape[1])]
    rows = rows[np.lexsort(by[::-1])]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:, :keys] != rows[:-1, :keys]).any(axis=1)
    place = np.arange(len(rows))
    return rows[place - np.maximum.accumulate(np.where(new, place, 0)) < most]


def hard_negatives(
    embeddings: DataFrame,
    is_anchor: str,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    scale: int = 256,
    positives: int = 5,
    negatives: int = 10,
    window: tuple[int, int] = (30, 90),
    blocks: tuple[int, int, int] = (ANCHORS, ROWS, CHUNK),
) -> DataFrame:
    """For each anchor (rows for which the SQL condition ``is_anchor`` over the id column holds) and each of its
    ``positives`` best rows of its label, the ``negatives`` best rows of other labels whose score lies within
    ``window`` percent of the positive's, both ends included: RESULT's columns.

    A score is the inner product of the components as floor(scale * x).  Rows with a null id, label or vector, or
    with a null or non-finite component, take no part; components that a shorter vector lacks are zeros.  Ties go to
    the smaller id.  Rows with equal ids are rows of their own: each is an anchor, a positive or a negative for
    itself, an anchor's own row alone is left out, and which of two with equal scores comes first doesn't show.  An
    empty table, or one without anchors, gives no row.  Further columns are ignored, whatever their names.
    Components beyond 131,072 after scaling are an error.
    """
    spark = embeddings.sparkSession
    low, high = window
    named = embeddings.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).alias("vector"), F.expr(is_anchor).alias("anchor"))
    with Scratch(spark) as scratch:
        rows = scratch.write(named.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & usable("vector")))
        # a number for every row: the table is written, so a task that runs again gives the same ones
        rows = rows.withColumn("u", F.monotonically_increasing_id())
        n, width = dimensions(rows, "vector")
        n_anchors = rows.filter("anchor").count()
        if not n_anchors:
            return spark.createDataFrame([], RESULT)
        per_block = [max(1, min(most, CELLS // max(width, 1))) for most in blocks[:2]]
        of_anchors, of_rows = -(-n_anchors // per_block[0]), -(-n // per_block[1])
        left = scratch.write(_tiles(rows.filter("anchor"), of_anchors, width, scale))
        right = scratch.write(_tiles(rows, of_rows, width, scale))

        # the anchor-positive windows
        found = _each_tile(met(left, right, of_anchors, of_rows), _positives, width, blocks[2], positives, ["u", "anchor_id", "i", "positive_score", "positive_id", "pu"])
        order = Window.partitionBy("u").orderBy(F.desc("positive_score"), "positive_id", "pu")
        windows = scratch.write(found.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= positives))
        of_block = windows.groupBy(F.col("i").cast("int").alias("block")).agg(F.collect_list(F.struct("u", "nth", "positive_score")).alias("w"))  # a block's anchors x positives
        of_block = of_block.select("block", *[F.col(f"w.{c}").alias(f"w{i}") for i, c in enumerate(("u", "nth", "positive_score"))])
        windowed = scratch.write(left.hint("merge").join(of_block, "block"))

        # the first negatives of every window in every tile, then of all
        taken = _each_tile(met(windowed, right, of_anchors, of_rows), _negatives(low, high), width, blocks[2], negatives, ["u", "nth", "negative_score", "negative_id"])
        order = Window.partitionBy("u", "nth").orderBy(F.desc("negative_score"), "negative_id")
        ranked = taken.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= negatives)
        out = ranked.join(windows.select("u", "nth", "anchor_id", "positive_id", "positive_score"), ["u", "nth"])
        return cut(out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score"))


def met(left: DataFrame, right: DataFrame, of_anchors: int, of_rows: int) -> DataFrame:
    """The tiles: every anchor block beside every row block, some TILES of them to a task, in order of (i, j)."""
    more = [F.col(c) for c in left.columns if c.startswith("w")]
    a = left.select(F.col("block").alias("i"), F.col("u").alias("au"), F.col("id").alias("aid"), F.col("label").alias("al"), F.col("cells").alias("a"), *more).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(of_rows - 1))))
    b = right.selectExpr("block AS j", "u AS bu", "id AS bid", "label AS bl", "cells AS b").withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(of_anchors - 1))))
    parts = max(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-of_anchors * of_rows // TILES))
    a, b = (side.repartition(parts, "i", "j") for side in (a, b))
    return a.hint("merge").join(b, ["i", "j"]).select("i", "au", "aid", "al", "a", "bu", "bid", "bl", "b", *more)


def _each_tile(tiles: DataFrame, pick: Callable[..., np.ndarray], width: int, chunk: int, most: int, names: list[str]) -> DataFrame:
    """What ``pick`` takes of each slab of scores, the first ``most`` of each key over the tiles of an anchor block
    that a task has one after the other.  The key is what comes before the score among ``names``."""
    keys = next(i for i, n in enumerate(names) if n.endswith("score"))
    ship(tiles.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        at = None

        def close() -> Iterator[pa.RecordBatch]:
            rows = reduced(held, keys, most) if held else np.zeros((0, len(names)), np.int64)
            for k in range(0, len(rows), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in rows[k : k + (1 << 16)].T.copy()], names=names)

        for batch in batches:
            for k in range(batch.num_rows):
                i, au, aid, al, a, bu, bid, bl, b, *windows = (c[k].as_py() for c in batch.columns)
                if i != at:
                    yield from close()
                    held, at = [], i
                au, aid, al, bu, bid, bl = map(_longs, (au, aid, al, bu, bid, bl))
                left, right = (np.frombuffer(x, "<i4").astype(np.int64).reshape(n, width) for x, n in ((a, len(au)), (b, len(bu))))
                chosen: dict[int, list[tuple[int, int]]] = {}
                for u, nth, score in zip(*windows, strict=True):
                    chosen.setdefault(u, []).append((nth, score))
                for lo in range(0, len(au), max(1, SLAB // len(bu))):
                    part = slice(lo, lo + max(1, SLAB // len(bu)))
                    scores = np.zeros((len(au[part]), len(bu)), np.int64)
                    for c in range(0, width, chunk):
                        scores += product(left[part, c : c + chunk], right[:, c : c + chunk])
                    held += pick(i, scores, au[part], aid[part], al[part], bu, bid, bl, most, chosen)
                if sum(map(len, held)) > 1 << 20:
                    held = [reduced(held, keys, most)]
        yield from close()

    return tiles.mapInArrow(keeping_nothing(run), ", ".join(f"{n} long" for n in names))


def _positives(i: int, scores: np.ndarray, au: np.ndarray, aid: np.ndarray, al: np.ndarray, bu: np.ndarray, bid: np.ndarray, bl: np.ndarray, most: int, _: dict) -> list[np.ndarray]:
    """The first ``most`` other rows of each anchor's own label."""
    out = []
    for r in range(len(au)):
        same = np.flatnonzero((bl == al[r]) & (bu != au[r]))
        top = same[leading(scores[r, same], most)]
        out.append(np.stack([np.full(len(top), v) for v in (au[r], aid[r], i)] + [scores[r, top], bid[top], bu[top]], axis=1))
    return out


def _negatives(low: int, high: int) -> Callable[..., list[np.ndarray]]:
    def pick(_: int, scores: np.ndarray, au: np.ndarray, aid: np.ndarray, al: np.ndarray, bu: np.ndarray, bid: np.ndarray, bl: np.ndarray, most: int, windows: dict) -> list[np.ndarray]:
        """The first ``most`` rows of another label within each window."""
        out = []
        for r in range(len(au)):
            wanted = windows.get(int(au[r]))
            if not wanted:
                continue
            other = np.flatnonzero(bl != al[r])
            own = scores[r, other]
            for nth, score in wanted:
                # low * score <= 100 * own <= high * score, in whole numbers
                fits = np.flatnonzero((own >= -(-low * score // 100)) & (own <= high * score // 100))
                top = fits[leading(own[fits], most)]
                if len(top):
                    out.append(np.stack([np.full(len(top), int(au[r])), np.full(len(top), nth), own[top], bid[other[top]]], axis=1))
        return out

    return pick
