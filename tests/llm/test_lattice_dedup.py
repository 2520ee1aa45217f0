import math

import numpy as np
import pytest

from tidewarden.llm import lattice_dedup as op


def slow(rows, least=0.95):
    """(id, links, component) by all pairs, in double precision."""
    ids, unit = [], []
    for i, v in rows:
        ids.append(i)
        ok = v and all(x is not None and math.isfinite(x) for x in v) and any(v)
        x = np.asarray(v, np.float64) / np.abs(np.asarray(v, np.float64)).max() if ok else None
        unit.append(x / np.linalg.norm(x) if ok else None)
    top = {i: i for i in ids}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x
    links = dict.fromkeys(ids, 0)
    for a in range(len(ids)):
        for b in range(a):
            if unit[a] is not None and unit[b] is not None and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= least:
                links[ids[a]] += 1
                links[ids[b]] += 1
                x, y = sorted((find(ids[a]), find(ids[b])))
                top[y] = x
    return {i: (links[i], find(i), i == find(i)) for i in ids}


def near(rnd, base, cos):
    noise = rnd.normal(size=len(base))
    noise -= noise @ base * base / (base @ base)
    return cos * base / np.linalg.norm(base) + math.sqrt(1 - cos * cos) * noise / np.linalg.norm(noise)


def test_lattice():
    near_ = op.neighbours()[:-1]
    assert len(near_) == 240 and np.allclose((near_ ** 2).sum(axis=1), 2) and len(np.unique(near_, axis=0)) == 240
    rnd = np.random.default_rng(1)
    x = rnd.normal(size=(300, 8)) * 2
    p = op.nearest_point(x)
    assert np.allclose(p * 2, np.rint(p * 2)) and np.allclose(p.sum(axis=1) % 2, 0)
    best = ((x - p) ** 2).sum(axis=1)
    assert all((((x - p - v) ** 2).sum(axis=1) >= best - 1e-9).all() for v in near_)


def test_pairs_of_runs():
    i, j = op._pairs(np.array([0, 3, 4]), np.array([3, 1, 2]))
    assert list(zip(i, j)) == [(0, 1), (0, 2), (1, 2), (4, 5)]


@pytest.mark.parametrize("block", [256, 7])
def test_near_vectors_are_linked(spark, block):
    rnd = np.random.default_rng(block)
    rows = [(1000 + k, rnd.normal(size=48)) for k in range(300)]
    for k in range(60):
        rows.append((k, near(rnd, rows[k][1], 0.985)))
    centre = rnd.normal(size=48)
    rows += [(5000 + k, near(rnd, centre, 0.99) * 3) for k in range(40)]
    rows += [(7000 + k, rows[5][1]) for k in range(25)]
    rows = [(i, np.asarray(v, np.float32).tolist()) for i, v in rows]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in op.vector_links(df, block=block).collect()}
    want = slow(rows)
    assert len(got) == len(rows)
    assert sum(g[0] for g in got.values()) >= 0.97 * sum(w[0] for w in want.values())
    assert all(got[i][0] <= want[i][0] for i in want)
    assert sum(got[i][1] == want[i][1] for i in want) >= 0.97 * len(want)
    assert got[7000][0] >= 25


def test_recall_at_the_threshold(spark):
    rnd = np.random.default_rng(4)
    rows = []
    for k in range(400):
        v = rnd.normal(size=64)
        rows += [(2 * k, v.tolist()), (2 * k + 1, near(rnd, v, 0.9505).tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert op.vector_links(df).filter("n_links = 1").count() >= 0.93 * 800


def test_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, nan]), (5, [1.0, inf]), (6, [1.0, None]), (7, [1e-38, 2e-38]),
            (8, [1e38, 2e38]), (8, [1e38, 2e38]), (9, [1.0, 2.0, 0.0]), (10, [-1.0, -2.0]), (11, [1.0, 2.0]), (None, [1.0, 2.0])]
    df = spark.createDataFrame([(*r, 5, "x") for r in rows], "vec_id long, embedding array<float>, t int, cell string")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in op.vector_links(df).collect()}
    assert got.pop(None) == (0, None, False)
    assert got == slow([(i, v) for i, v in dict(rows).items() if i is not None])
    assert got[7] == (2, 7, True) and got[9] == (0, 9, True)
    assert op.vector_links(df.limit(0)).count() == 0


def test_query_recall_and_precision(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in op.query(spark, sf).collect()}
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want = slow(rows)
    assert sum(g[0] for g in got.values()) >= 0.95 * sum(w[0] for w in want.values())
    assert all(got[i][0] <= want[i][0] for i in want)


def by_blocks(x, least=0.95):
    """Links of each row by all pairs."""
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    return np.concatenate([(x[k:k + 1000] @ x.T >= least).sum(axis=1) - 1 for k in range(0, len(x), 1000)])


@pytest.mark.parametrize("crowd", [8, 64])
def test_crowds_at_every_distance(spark, crowd):
    rnd = np.random.default_rng(crowd)
    centre, other = rnd.normal(size=64), rnd.normal(size=64)
    beside = near(rnd, centre, 0.975)
    rows = [near(rnd, c, cos) for c in (centre, beside, other) for cos in (0.9995, 0.995, 0.98, 0.96) for _ in range(150)]
    rows += list(rnd.normal(size=(200, 64)))
    rows += rows[:40]
    x = np.asarray(rows)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in op.vector_links(df, crowd=crowd).collect()}
    plain = {r.vec_id: r for r in op.vector_links(df, crowd=10 ** 6).collect()}
    want, full = by_blocks(x), slow([(k, v.tolist()) for k, v in enumerate(x)])
    assert len(got) == len(x)
    assert all(plain[k].n_links <= got[k].n_links <= want[k] for k in got)
    assert sum(r.n_links for r in got.values()) >= 0.95 * want.sum()
    assert sum(got[k].component_id == full[k][1] for k in got) >= 0.95 * len(x)


def test_a_cell_of_many_thousands_needs_no_pairs(spark, monkeypatch):
    rnd = np.random.default_rng(9)
    centre = rnd.normal(size=64)
    x = np.asarray([near(rnd, centre, 0.999) for _ in range(20_000)] + list(rnd.normal(size=(500, 64))), np.float32)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>")
    rows, plain = [], op._ball_links

    def counted(*args):
        out = plain(*args)
        rows.append(out[2].count())
        return out
    monkeypatch.setattr(op, "_ball_links", counted)
    got = op.vector_links(df).collect()
    assert rows and rows[0] <= len(x)
    assert {(r.n_links, r.component_id) for r in got if r.vec_id < 20_000} == {(19_999, 0)}
    assert all(r.n_links == 0 for r in got if r.vec_id >= 20_000)
