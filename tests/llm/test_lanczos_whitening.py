import math

import numpy as np
import pytest

from tidewarden.llm import lanczos_whitening as op

SF = "/root/testdata/sf0.01"


def plain(rows, components=16):
    """Brute force: eigenvectors of the covariance matrix."""
    xs = {i: [math.floor(64 * float(c)) + 1_000_000 for c in v] for i, v in rows}
    fit = np.array(sorted(set(map(tuple, xs.values()))), dtype=object)
    n, sums = len(fit), fit.sum(axis=0)
    off = ((fit * n - sums).astype(np.float64)) / n
    e, v = np.linalg.eigh(off.T @ off / n)
    order = np.argsort(-e)[:components]
    e, v, trace = e[order], v[:, order], e.sum()
    out = {}
    for i, x in xs.items():
        d = [n * a - s for a, s in zip(x, sums)]
        out[i] = (n, sum(a * a for a in d), np.array(d, float) / n @ v / np.sqrt(e), e / trace)
    return out, e


def found(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.vec_id, {})[r.component] = r
    return out


def hold(got, want, k, tol=1e-7):
    assert got.keys() == want.keys()
    flip = None
    for i, (n, far, white, share) in want.items():
        rows = [got[i][c + 1] for c in range(k)]
        assert len(got[i]) == k and all(r.n == n and r.deviation == far and r.identity_error < 1e-9 for r in rows)
        mine = np.array([r.whitened for r in rows])
        if flip is None:
            flip = np.ones(k)
        flip = np.where((flip == 1) & (np.abs(mine) > 1e-3) & (np.sign(mine) != np.sign(white[:k])), -1, flip)
        assert np.allclose([r.explained for r in rows], share[:k], rtol=1e-9)
    for i, (_, _, white, _) in want.items():
        assert np.allclose([got[i][c + 1].whitened for c in range(k)], white[:k] * flip, atol=tol)


def test_query_against_eigenvectors(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    want, _ = plain(rows)
    hold(found(op.query(spark, SF)), want, 16)


def test_rows_left_out_repeats_and_other_columns(spark):
    rnd = np.random.default_rng(5)
    rows = [(i, [float(c) for c in rnd.standard_normal(6) * [9, 5, 3, 2, 1, 0.5]]) for i in range(60)]
    copies = [(100 + i, rows[i % 3][1]) for i in range(40)]
    bad = [(200, None), (201, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (202, [float("nan")] * 6), (203, [float("-inf")] * 6), (204, []),
           (205, [1.0, 2.0])]
    data = [(i, v, 3, [7], 9) for i, v in rows + copies + bad]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, n int, x array<int>, component int")
    want, _ = plain(rows + copies)
    hold(found(op.whitened(df)), want, 6)
    twice = op.whitened(df.unionByName(df)).collect()
    assert len(twice) == 2 * 6 * 100 and {r.n for r in twice} == {60}


@pytest.mark.parametrize("kind", ["equal", "rank", "ties"])
def test_degenerate_spectra(spark, kind):
    if kind == "equal":  # every axis has the same variance
        rows = [(2 * a + s, [(4.0 if a == b else 0.0) * (1 - 2 * s) for b in range(8)]) for a in range(8) for s in (0, 1)]
        k = 8
    elif kind == "rank":  # two directions only
        rows = [(i, [float(i % 7), float(i // 7), float(i % 7 + i // 7), 5.0]) for i in range(49)]
        k = 2
    else:
        rows = [(i, [1.0, 2.0, 3.0]) for i in range(5)]
        k = 0
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = op.whitened(df).collect()
    assert len(got) == k * len(rows)
    if k:
        assert max(r.identity_error for r in got) < 1e-9
        share = {r.component: r.explained for r in got}
        assert abs(sum(share.values()) - 1) < 1e-12 and [*share] and all(share[c] >= share[c + 1] - 1e-12 for c in range(1, k))
        if kind == "equal":
            assert np.allclose(list(share.values()), 1 / 8)


def test_small_variances_beside_large_ones(spark):
    rnd = np.random.default_rng(6)
    rows = [(i, [float(c) for c in rnd.standard_normal(5) * [9_000, 1_000, 100, 3, 0.5]]) for i in range(300)]
    want, _ = plain(rows)
    hold(found(op.whitened(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))), want, 5, 1e-5)


def test_empty(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert op.whitened(none).count() == 0
    nulls = spark.createDataFrame([(None, None), (1, None)], "vec_id long, embedding array<float>")
    assert op.whitened(nulls).count() == 0
    one = spark.createDataFrame([(None, [1.0, 2.0]), (None, [3.0, 4.0]), (5, [9.0, 1.0])], "vec_id long, embedding array<float>")
    assert len(op.whitened(one).collect()) == 6


def test_deviation_beyond_a_long_is_null():
    off = np.array([[3, 4], [1 << 40, 1 << 40]], np.int64)
    assert op._squares(off, 1 << 40) == [25, None]
    assert op._squares(off[:1], 4) == [25]
