import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparloom.llm import hard_negatives, queries, vectors, whitening

SCHEMA = "vec_id long, embedding array<float>, label int, id string, u int, score double"
INF, NAN = math.inf, math.nan


def _frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", 0, 0.5) for r in rows], SCHEMA)


def _usable(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def _brute(rows, positives=5, negatives=10):
    rows = [(i, lab, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v, lab in rows if i is not None and lab is not None and _usable(v)]
    out = []
    for a in rows:
        if a[0] % 10:
            continue
        scored = sorted(((-sum(x * y for x, y in zip(a[2], r[2], strict=False)), r[0], r[1]) for r in rows if r is not a), key=lambda x: x[:2])
        for s, p, _ in [x for x in scored if x[2] == a[1]][:positives]:
            fits = [x for x in scored if x[2] != a[1] and 30 * -s <= 100 * -x[0] <= 90 * -s][:negatives]
            out += [(a[0], p, r, x[1], -s, -x[0]) for r, x in enumerate(fits, 1)]
    return sorted(out)


def _rows(rng, n, d=7):
    v = rng.normal(size=(n, d)).astype(np.float32) + 0.6
    v[rng.random(n) < 0.3] = v[0]  # one vector many times
    return [(int(i), [float(x) for x in v[i]], int(rng.integers(3))) for i in range(n)]


@pytest.mark.parametrize("blocks", [(256, 2048, 32), (2, 5, 3), (1, 1, 1), (3, 7, 100)])
def test_negatives_equal_brute_force(spark, blocks):
    rows = _rows(np.random.default_rng(5), 90)
    rows += [(None, [1.0] * 7, 1), (200, None, 1), (210, [1.0] * 7, None), (220, [1.0, None] + [1.0] * 5, 1), (230, [NAN] * 7, 0), (240, [1.0] * 6 + [INF], 0), (250, [], 2), (260, [2.0, 2.0], 2), (40, [0.5] * 7, 0), (40, [0.5] * 7, 0)]
    got = hard_negatives.hard_negatives(_frame(spark, rows), "vec_id % 10 = 0", blocks=blocks).collect()
    assert sorted((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in got) == _brute(rows)
    assert len(got) > 100


def test_negatives_of_few_rows(spark):
    def run(rows):
        return sorted(map(tuple, hard_negatives.hard_negatives(_frame(spark, rows), "vec_id % 10 = 0").collect()))

    assert run([]) == [] and run([(1, [1.0], 0)]) == [] and run([(10, [1.0], 0)]) == []
    few = [(10, [1.0], 0), (11, [2.0], 0), (12, [1.5], 1), (13, [1.9], 1), (14, [0.5], 1)]
    assert run(few) == _brute(few) and len(run(few)) == 1  # 1.9 and 0.5 are beyond the window
    with pytest.raises(Exception, match="scale the vectors"):
        run([(10, [1e6], 0), (11, [2.0], 0)])


@settings(max_examples=100, deadline=None)
@given(st.integers(0, 2**31), st.sampled_from([10, 2**16, 2**30]))
def test_products_are_exact(seed, size):
    rng = np.random.default_rng(seed)
    a, b = rng.integers(-size, size, (3, 5)), rng.integers(-size, size, (4, 5))
    want = [[sum(int(x) * int(y) for x, y in zip(p, q, strict=True)) for q in b] for p in a]
    assert hard_negatives.product(a, b).tolist() == want


def test_matrix_of_uneven_lists():
    import pyarrow as pa

    lists = pa.array([[9.0], [1.0, 2.0], [], [3.0]], pa.list_(pa.float32())).slice(1)
    assert vectors.matrix(lists, 3).tolist() == [[1, 2, 0], [0, 0, 0], [3, 0, 0]]


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 9), st.integers(0, 2**31), st.booleans())
def test_rotations_make_columns_orthogonal(d, seed, steep):
    rng = np.random.default_rng(seed)
    r = np.triu(rng.normal(size=(d, d))) * (10.0 ** -np.arange(d) if steep else 1)
    v, sigma = whitening.jacobi(r)
    assert np.allclose(v.T @ v, np.eye(d), atol=1e-13) and (np.diff(sigma) <= 0).all()
    want = np.linalg.svd(r, compute_uv=False)
    assert np.allclose(sigma, want, rtol=1e-9, atol=1e-14)
    assert np.allclose(np.linalg.norm(r @ v, axis=0), sigma, rtol=1e-9, atol=1e-15)


def _check_whitening(got, rows, most=32):
    rows = [(i, v) for i, v in rows if _usable(v)]
    width = max(len(v) for _, v in rows)
    x = np.array([[math.floor(64 * float(np.float32(c))) for c in [*v, *[0.0] * (width - len(v))]] for _, v in rows]) + 1_000_000
    n, total = len(x), x.sum(0)
    y = (n * x - total) / n
    variance, basis = np.linalg.eigh(y.T @ y / n)
    variance, basis = variance[::-1], basis[:, ::-1]
    k = min(most, int((variance > variance[0] * 1e-12).sum()))
    assert len(got) == n * k and {r.n for r in got} == {n}
    by = {}
    for r in got:
        by.setdefault((r.vec_id, r.deviation), []).append(r)
        assert abs(r.explained / (variance[r.component - 1] / variance.sum()) - 1) < 1e-9 and r.identity_error < 1e-9
    want = sorted((i if i is not None else -1, sum(int(n * c - s) ** 2 for c, s in zip(row, total.tolist(), strict=True))) for (i, _), row in zip(rows, x.tolist(), strict=True))
    assert sorted({(i if i is not None else -1, d) for i, d in by}) == sorted(set(want))
    w = {(i, r.component): r.whitened for i, v in by.items() for r in v}
    sign = {}
    for (i, _), row in zip(rows, y, strict=True):
        for c in range(k):
            mine, theirs = w[next(key for key in by if key[0] == i), c + 1], row @ basis[:, c] / math.sqrt(variance[c])
            if abs(theirs) > 1e-6:
                assert sign.setdefault(c, math.copysign(1, mine * theirs)) * mine == pytest.approx(theirs, rel=1e-6, abs=1e-8)


def test_whitening_equals_eigenvectors(spark, monkeypatch):
    monkeypatch.setattr(whitening, "FAN_IN", 2)  # several levels of stacked factors
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(size=6) * [9, 5, 3, 2, 1.5, 1]).tolist()) for i in range(300)]
    rows += [(i, [4.0] * 6) for i in range(300, 400)] + [(None, [1.0] * 6), (500, None), (501, [None] * 6), (502, [NAN] * 6), (503, [1.0, -INF]), (504, []), (505, [2.0, 1.0])]
    got = whitening.whiten(_frame(spark, [(i, v, 0) for i, v in rows]).repartition(7)).collect()
    _check_whitening(got, rows)
    assert {r.component for r in whitening.whiten(_frame(spark, [(i, v, 0) for i, v in rows]), components=2).collect()} == {1, 2}


def test_whitening_without_variance(spark):
    assert whitening.whiten(_frame(spark, [])).count() == 0
    assert whitening.whiten(_frame(spark, [(1, None, 0)])).count() == 0
    assert whitening.whiten(_frame(spark, [(1, [], 0)])).count() == 0
    assert whitening.whiten(_frame(spark, [(i, [1.0, 2.0], 0) for i in range(5)])).count() == 0
    flat = [(i, [1.0, float(i)], 0) for i in range(5)]
    assert {r.component for r in whitening.whiten(_frame(spark, flat)).collect()} == {1}


def test_whitening_query(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    _check_whitening(queries.op13_whitening(spark, sf).collect(), rows)


def test_squares_beyond_64_bits():
    y = np.array([[3, 4], [3_000_000_000, 300_000_000], [4_000_000_000, 1]], np.int64)
    assert whitening._squares(y) == [25, 9 * 10**18 + 9 * 10**16, None]


def test_tiles_are_never_broadcast(spark):
    """Small blocks are copied once for every block of the other side, which the planner's estimate doesn't see."""
    blocks = spark.createDataFrame([(0, b"", b"", b"", b"")], "block int, u binary, id binary, label binary, cells binary")
    plan = hard_negatives.met(blocks, blocks, 3, 4)._jdf.queryExecution().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan and hard_negatives.met(blocks, blocks, 1, 1).count() == 1


def test_leading_scores_and_their_ties():
    rng = np.random.default_rng(2)
    for n in (0, 3, 7, 30, 500):
        scores = rng.integers(0, 9, n)
        assert hard_negatives.leading(scores, 5).tolist() == sorted(range(n), key=lambda i: (-scores[i], i))[:5]
