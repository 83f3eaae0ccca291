"""A multi-output forest: every tree splits for all labels at once, on balanced bootstrap samples.

Trees grow level by level, many at a time.  Features are binned once by quantiles.  In each round every task sums,
for the nodes that are open, counts and weights by candidate feature and bin over its own rows; the sums meet by
tree and node, where the best split is taken; only the splits reach the driver, which keeps the trees.  A task holds
one batch of rows and a bounded number of sums, a group one node's sums, so no rows are ever gathered.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparloom.functions.lineage import cut
from sparloom.session import ship

#: Bins of a feature at most, bytes of sums that a task holds, trees that grow at a time, rows worked on at a time.
BINS, HELD_BYTES, AT_ONCE, ROWS = 32, 64 << 20, 50, 8192


def mixed(*parts: object) -> np.ndarray:
    """64-bit hashes of whole numbers, by place; a single number goes with all places."""
    out = np.full(1, 0x243F6A8885A308D3, np.uint64)
    for p in parts:
        x = (out ^ np.atleast_1d(np.asarray(p, np.int64)).view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
        out = x ^ (x >> np.uint64(29))
    return out


_POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(20)])


def drawn(seed: int, tree: int, keys: np.ndarray) -> np.ndarray:
    """How often each row is in a tree's sample: a Poisson count of mean 1 by its hash."""
    return np.searchsorted(_POISSON, (mixed(keys, seed, tree) >> np.uint64(11)).astype(np.float64) / 2**53, "right")


def candidates(seed: int, tree: int, path: int, n: int, at: int, k: int) -> np.ndarray:
    """The features that a node tries in its ``at``-th attempt."""
    return np.argsort(mixed(np.arange(n), seed, tree, path), kind="stable")[at * k : (at + 1) * k]


@dataclass
class Tree:
    """Nodes by number: feature (-1: a leaf), bin up to which rows go left, children, shares of each label."""

    feature: list[int] = field(default_factory=lambda: [-1])
    cut: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [-1])
    right: list[int] = field(default_factory=lambda: [-1])
    shares: list[list[float]] = field(default_factory=lambda: [[]])
    path: list[int] = field(default_factory=lambda: [1])
    depth: list[int] = field(default_factory=lambda: [0])

    def split(self, node: int, feature: int, cut: int) -> tuple[int, int]:
        self.feature[node], self.cut[node] = feature, cut
        self.left[node], self.right[node] = len(self.feature), len(self.feature) + 1
        for side in (0, 1):
            for column, value in ((self.feature, -1), (self.cut, 0), (self.left, -1), (self.right, -1), (self.shares, []), (self.path, (2 * self.path[node] + side) % (1 << 62)), (self.depth, self.depth[node] + 1)):
                column.append(value)
        return self.left[node], self.right[node]

    def arrays(self) -> tuple[np.ndarray, ...]:
        return tuple(np.array(x, np.int64) for x in (self.feature, self.cut, self.left, self.right))


def leaf_of(arrays: tuple[np.ndarray, ...], bins: np.ndarray) -> np.ndarray:
    """The node that each row has reached."""
    feature, at, left, right = arrays
    node = np.zeros(len(bins), np.int64)
    rows = np.arange(len(bins))
    while len(rows):
        rows = rows[feature[node[rows]] >= 0]
        here = node[rows]
        node[rows] = np.where(bins[rows, feature[here]] <= at[here], left[here], right[here])
    return node


def best_split(sums: np.ndarray, least: int) -> tuple[float, int, int]:
    """(score, place among the candidates, bin) of sums[candidate, bin, (rows, weight, weight of each label)]; the
    score is the children's Gini impurity by weight, in the mean of all labels.  Ties go to the first."""
    left = np.cumsum(sums, axis=1)[:, :-1]
    right = sums.sum(axis=1)[:, None] - left
    score = sum(_impurity(side) for side in (left, right))
    score[(left[..., 0] < least) | (right[..., 0] < least) | (left[..., 1] <= 0) | (right[..., 1] <= 0)] = np.inf
    i = int(np.argmin(np.round(score, 9)))
    return float(score.flat[i]), *map(int, np.unravel_index(i, score.shape))


def _impurity(sums: np.ndarray) -> np.ndarray:
    weight = np.maximum(sums[..., 1], 1e-300)[..., None]
    share = sums[..., 2:] / weight
    return (2 * share * (1 - share) * weight).mean(axis=-1)


def _batches(batches: Iterable[pa.RecordBatch], n_features: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(keys, bins, labels) of ROWS rows at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            bins = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint8).reshape(part.num_rows, n_features)
            labels = np.frombuffer(b"".join(part.column(2).to_pylist()), np.uint8).reshape(part.num_rows, -1)
            yield part.column(0).to_numpy(), bins, labels


class MultiOutputForest:
    """``fit`` on a column of vectors and several 0/1 labels; ``transform`` adds ``pred_<label>`` and
    ``score_<label>`` (the mean of the trees' shares; 1 where it is above one half).

    A tree's sample draws each row by a Poisson count of mean 1.  A row's weight is its count times, for each label,
    n / (2 n of its class) within the tree's own sample.  A node tries ``sqrt(features)`` features, then as many
    others, until one of them parts its rows into two lots of ``least`` different rows; nodes that are pure in all
    labels, deeper than ``depth``, or without such a feature are leaves.

    Null labels count as 0; rows with a null vector are left out of the fit and have null scores; labels of a single
    class are predicted as that class; without rows all scores are 0.  Rows with equal ids draw alike.
    """

    def __init__(self, labels: Sequence[str], trees: int = 500, seed: int = 123, least: int = 2, depth: int = 30, per_node: int | None = None):
        self.labels, self.n_trees, self.seed, self.least, self.depth, self.per_node = list(labels), trees, seed, least, depth, per_node
        self.trees: list[Tree] = []
        self.thresholds: list[np.ndarray] = []

    # ---- binning ---------------------------------------------------------------------------------------

    def _bin(self, values: np.ndarray) -> np.ndarray:
        """Bins of rows of values: how many thresholds each is above."""
        return np.stack([np.searchsorted(t, values[:, j], "left") for j, t in enumerate(self.thresholds)], axis=1).astype(np.uint8) if self.thresholds else np.zeros((len(values), 0), np.uint8)

    def _learn_thresholds(self, values: DataFrame) -> None:
        """Quantiles of every feature, the largest left out: rows at or below one go left."""
        n = int(values.agg(F.max(F.size("v"))).first()[0] or 0)
        cuts = [i / BINS for i in range(1, BINS)]
        each = values.select(F.posexplode("v").alias("j", "x")).groupBy("j")
        found = {r["j"]: r for r in each.agg(F.percentile_approx("x", cuts, 10_000).alias("q"), F.max("x").alias("most")).collect()}  # a row a feature
        self.thresholds = [np.array(sorted({q for q in found[j]["q"] if q < found[j]["most"]})) if j in found else np.zeros(0) for j in range(n)]

    # ---- growing ---------------------------------------------------------------------------------------

    def fit(self, df: DataFrame, id_col: str, features: str = "features") -> MultiOutputForest:
        ship(df.sparkSession)
        values = df.filter(F.col(features).isNotNull()).select(F.xxhash64(id_col).alias("key"), _doubles(df, features).alias("v"), *[F.coalesce(F.col(c).cast("int"), F.lit(0)).alias(f"y{i}") for i, c in enumerate(self.labels)])
        self._learn_thresholds(values)
        binned = self._bin

        def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, ROWS):
                    part = batch.slice(at, ROWS)
                    bins = binned(np.array(part.column(1).to_pylist(), np.float64).reshape(part.num_rows, -1))
                    y = np.stack([part.column(i).to_numpy() for i in range(2, part.num_columns)], axis=1).astype(np.uint8)
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array([b.tobytes() for b in bins], pa.binary()), pa.array([v.tobytes() for v in y], pa.binary())], names=["key", "bins", "y"])

        rows = cut(values.mapInArrow(encode, "key long, bins binary, y binary"))
        self.trees = []
        for at in range(0, self.n_trees, AT_ONCE):
            self.trees += self._grow(rows, range(at, min(at + AT_ONCE, self.n_trees)))
        return self

    def _grow(self, rows: DataFrame, numbers: range) -> list[Tree]:
        n_features, n_labels, seed = len(self.thresholds), len(self.labels), self.seed
        k = self.per_node or max(1, int(math.sqrt(n_features)))
        least = self.least

        def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((len(numbers), 1 + n_labels))
            for keys, _, y in _batches(batches, n_features):
                for i, t in enumerate(numbers):
                    w = drawn(seed, t, keys)
                    total[i] += np.append(w.sum(), w @ y)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(numbers)), 1 + n_labels)), pa.array(np.tile(np.arange(1 + n_labels), len(numbers))), pa.array(total.ravel())], names=["t", "c", "v"])

        counted = np.zeros((len(numbers), 1 + n_labels))
        for r in rows.mapInArrow(count, "t long, c long, v double").groupBy("t", "c").agg(F.sum("v").alias("v")).collect():
            counted[r["t"], r["c"]] = r["v"]
        n, ones = counted[:, :1], counted[:, 1:]
        # the weight of a 0 and of a 1, by tree and label
        balance = np.stack([n / (2 * np.maximum(n - ones, 1)), n / (2 * np.maximum(ones, 1))], axis=-1)

        trees = [Tree() for _ in numbers]
        open_: dict[tuple[int, int], int] = {(i, 0): 0 for i in range(len(numbers))}  # (tree, node): attempts so far
        while open_:
            wanted = [(i, node, candidates(seed, numbers[i], trees[i].path[node], n_features, at, k)) for (i, node), at in open_.items()]
            shared = rows.sparkSession.sparkContext.broadcast(([t.arrays() for t in trees], _by_tree(wanted, trees)))
            found = self._round(rows, numbers, shared, balance, (seed, n_features, k, least))
            shared.unpersist()
            again: dict[tuple[int, int], int] = {}
            for (i, node), at in open_.items():
                tree = trees[i]
                said = found.get((i, node))
                if said is None:  # no row is here: the sample is empty
                    tree.shares[node] = [0.0] * n_labels
                    continue
                shares, place, bin_ = said
                tree.shares[node] = shares
                if all(s < 1e-9 or s > 1 - 1e-9 for s in shares) or tree.depth[node] >= self.depth:
                    continue
                if place >= 0:
                    tried = candidates(seed, numbers[i], tree.path[node], n_features, at, k)
                    for child in tree.split(node, int(tried[place]), bin_):
                        again[i, child] = 0
                elif (at + 1) * k < n_features:
                    again[i, node] = at + 1
            open_ = again
        return trees

    @staticmethod
    def _round(rows: DataFrame, numbers: range, shared, balance: np.ndarray, how: tuple[int, int, int, int]) -> dict[tuple[int, int], tuple[list[float], int, int]]:
        """Of each open node with rows: the labels' shares, and place and bin of the best split (-1: none)."""
        seed, n_features, k, least = how
        n_labels = balance.shape[1]
        shape = (k, BINS, 2 + n_labels)
        most = max(1, HELD_BYTES // (8 * int(np.prod(shape))))

        def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            trees, wanted = shared.value
            held: dict[tuple[int, int], np.ndarray] = {}

            def flush() -> Iterator[pa.RecordBatch]:
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in held], pa.int32()), pa.array([x[1] for x in held], pa.int32()), pa.array([v.tobytes() for v in held.values()], pa.binary())], names=["t", "node", "sums"])
                held.clear()

            for keys, bins, y in _batches(batches, n_features):
                for i, (nodes, place, tried) in wanted.items():
                    draws = drawn(seed, numbers[i], keys)
                    node = leaf_of(trees[i], bins)
                    slot = np.where(draws > 0, place[node], -1)
                    here = np.flatnonzero(slot >= 0)
                    if not len(here):
                        continue
                    slot, labels = slot[here], y[here].astype(np.int64)
                    weight = draws[here] * np.prod(balance[i][np.arange(n_labels), labels], axis=1)
                    used = np.unique(slot)
                    local = np.searchsorted(used, slot)
                    # rows by candidates; without any feature, one bin that holds all
                    value = bins[here[:, None], tried[slot]] if n_features else np.zeros((len(here), 1), np.uint8)
                    width = value.shape[1]
                    cell = ((local[:, None] * width + np.arange(width)) * BINS + value).ravel()
                    sums = np.zeros((len(used), *shape))
                    for c, v in enumerate((np.ones(len(here)), weight, *(weight[:, None] * labels).T)):
                        sums[:, :width, :, c] = np.bincount(cell, np.repeat(v, width), minlength=len(used) * width * BINS).reshape(len(used), width, BINS)
                    for u, s in zip(used.tolist(), sums, strict=True):
                        key = (i, int(nodes[u]))
                        if key in held:
                            held[key] += s
                        else:
                            held[key] = s
                    if len(held) >= most:
                        yield from flush()
            yield from flush()

        def choose(key: tuple, groups: pa.Table) -> pa.Table:
            total = np.zeros(shape)
            for data in groups.column("sums").to_pylist():
                total += np.frombuffer(data).reshape(shape)
            whole = total[0].sum(axis=0)
            score, place, bin_ = best_split(total, least)
            shares = (whole[2:] / max(whole[1], 1e-300)).tolist()
            place = place if math.isfinite(score) else -1
            return pa.table({"t": pa.array([key[0].as_py()], pa.int32()), "node": pa.array([key[1].as_py()], pa.int32()), "shares": pa.array([shares], pa.list_(pa.float64())), "place": pa.array([place], pa.int32()), "bin": pa.array([bin_], pa.int32())})

        sums = rows.mapInArrow(add, "t int, node int, sums binary")
        chosen = sums.groupBy("t", "node").applyInArrow(choose, "t int, node int, shares array<double>, place int, bin int")
        return {(r["t"], r["node"]): (list(r["shares"]), r["place"], r["bin"]) for r in chosen.collect()}

    # ---- use -------------------------------------------------------------------------------------------

    def transform(self, df: DataFrame, features: str = "features") -> DataFrame:
        ship(df.sparkSession)
        n_labels, binned = len(self.labels), self._bin
        model = df.sparkSession.sparkContext.broadcast([(t.arrays(), np.array([s or [0.0] * n_labels for s in t.shares])) for t in self.trees])
        width = len(self.thresholds)

        @F.pandas_udf("array<double>")
        def scores(vectors: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for some in vectors:
                out: list = [None] * len(some)
                usable = [i for i, v in enumerate(some) if v is not None]
                for at in range(0, len(usable), ROWS):
                    rows = usable[at : at + ROWS]
                    bins = binned(np.array([some.iloc[i] for i in rows], np.float64).reshape(len(rows), -1)[:, :width])
                    total = np.zeros((len(rows), n_labels))
                    for arrays, shares in model.value:
                        total += shares[leaf_of(arrays, bins)]
                    for i, v in zip(rows, (total / max(1, len(model.value))).tolist(), strict=True):
                        out[i] = v
                yield pd.Series(out, dtype=object)

        names = "_forest_scores"
        scored = df.withColumn(names, scores(_doubles(df, features)))
        for i, label in enumerate(self.labels):
            scored = scored.withColumns({f"score_{label}": F.col(names)[i], f"pred_{label}": (F.col(names)[i] > 0.5).cast("int")})
        return scored.drop(names)


def _doubles(df: DataFrame, features: str) -> Column:
    """A vector or array column as an array of doubles."""
    kind = df.schema[features].dataType.typeName()
    return F.col(features).cast("array<double>") if kind == "array" else vector_to_array(features)


def _by_tree(wanted: list[tuple[int, int, np.ndarray]], trees: list[Tree]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each tree with open nodes: the nodes, a node's place among them (-1: none), and the features that each
    tries; fewer than others are filled up with the last one, which can't win twice."""
    out = {}
    for i in {w[0] for w in wanted}:
        nodes = np.array([node for t, node, _ in wanted if t == i])
        tries = [tried for t, _, tried in wanted if t == i]
        width = max(len(t) for t in tries)
        place = np.full(len(trees[i].feature), -1)
        place[nodes] = np.arange(len(nodes))
        out[i] = nodes, place, np.stack([np.append(t, np.full(width - len(t), t[-1] if len(t) else 0)) for t in tries])
    return out
