import hashlib
import math
import random
from collections import defaultdict

import duckdb
import pytest

from tidewarden.llm import source_mixing as op


def weights(held, exponent):
    z = sum(v ** exponent for v in held.values())
    return {k: v ** exponent / z for k, v in held.items()}


def slow_exponent(held, max_epochs, entropy_share):
    total = sum(held.values())
    found = []
    for k in range(op.GRID + 1):
        w = weights({s: v / total for s, v in held.items()}, k / op.GRID)
        found.append((-sum(x * math.log(x) for x in w.values()), max(w[s] * total / held[s] for s in held)))
    most = max([k for k, (h, _) in enumerate(found) if h >= entropy_share * math.log(len(held))], default=0)
    return max(most, min(k for k, (_, r) in enumerate(found) if r <= max_epochs)) / op.GRID


def rows(n=4000):
    rnd = random.Random(2)
    sources = ["hot"] * 40 + ["mid"] * 12 + ["low"] * 3 + [None]
    return [(i, rnd.choice(sources), " ".join(["w"] * rnd.choice([0, 1, 5, 40, 200]))) for i in range(n)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), "doc_id long, source string, text string").repartition(3).cache()


def test_weights_budget_and_passes(spark, docs):
    held = defaultdict(int)
    for _, s, t in rows():
        held[s or ""] += len(t.split())
    exponent = slow_exponent(held, op.MAX_EPOCHS, op.ENTROPY_SHARE)
    want = weights(held, exponent)
    got = op.mixed(docs).collect()
    dealt, times = defaultdict(int), defaultdict(lambda: defaultdict(int))
    for r in got:
        dealt[r.source or ""] += r.mix_tokens
        times[r.source or ""][r.doc_id] += 1
        assert abs(r.mix_weight - want[r.source or ""]) < 1e-9
    total = sum(held.values())
    for s in held:
        quota = want[s] * total
        assert quota - 200 <= dealt[s] <= quota + 1, s
        passes = quota / held[s]
        assert passes <= op.MAX_EPOCHS + 1e-6
        counts = set(times[s].values())
        assert counts <= {math.floor(passes), math.ceil(passes)} | ({1} if passes < 1 else set())
    assert len({r.mix_epoch for r in got}) >= 2


def test_order_of_blocks_differs_by_pass(spark, docs):
    deal = op.plan(docs, budget=5 * 10 ** 5, max_epochs=None, entropy_share=0.9).collect()
    order = defaultdict(dict)
    for r in deal:
        order[r.mix_source, r.mix_epoch][r.mix_block] = r.mix_turn
    hot = [v for (s, e), v in order.items() if s == "low"]
    assert len(hot) > 2 and hot[0] != hot[1] and sorted(hot[0].values()) == list(range(len(hot[0])))


def test_bisected():
    for at_once in (1, 2, 3, 64):
        find = lambda holds, low, high: op.bisected(lambda ks: [holds(k) for k in ks], low, high, at_once)  # noqa: E731, B023
        assert find(lambda k: k >= 7, 0, 20) == 7 and find(lambda k: False, 0, 9) == 9
        assert find(lambda k: True, 0, 9) == 0 and all(find(lambda k: k >= t, 0, 300) == t for t in (0, 1, 63, 64, 255, 299, 300))  # noqa: B023


@pytest.mark.parametrize("budget,small", [(200, 0), (9_000, op.SMALL), (39_999, op.SMALL)])
def test_budget_of_a_dominant_source_ends_at_one_document(spark, monkeypatch, budget, small):
    """Nearly all rows in one source: its documents by pass, block and hash, cut where the budget ends."""
    monkeypatch.setattr(op, "SMALL", small)
    rnd = random.Random(budget)
    rows = [(i, "big" if i % 50 else "small", "w " * rnd.randint(1, 9)) for i in range(4_000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    plan = op.plan(docs, budget, None, None).filter("mix_source = 'big'").collect()
    cut = [r for r in plan if r.mix_cut is not None]
    assert len(cut) <= 1
    size, block = {i: len(t.split()) for i, s, t in rows if s == "big"}, {}
    for i in size:
        h = hashlib.md5(f"{op.SEED}:{i}".encode()).hexdigest()
        block.setdefault(h[:2], []).append((h, size[i]))
    quota = math.floor(plan[0].mix_weight * budget + 0.5)
    dealt = sum(n for r in plan for h, n in block[r.mix_block] if r.mix_cut is None or h <= r.mix_cut)
    assert quota - 9 < dealt <= quota
    for r in cut:
        after = min((h, n) for h, n in block[r.mix_block] if h > r.mix_cut)
        assert dealt + after[1] > quota



def test_sql_says_the_same(spark):
    sf = "/root/testdata/sf0.01"
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    mine = sorted(map(repr, map(tuple, op.query(spark, sf).collect())))
    assert mine == sorted(map(repr, duckdb.sql(op.oracle()).fetchall()))


def test_edge_cases(spark):
    schema = "doc_id long, source string, text string, epoch long, turn string"
    none = spark.createDataFrame([], schema)
    assert op.mixed(none).count() == 0 and op.resampled(none.drop("epoch", "turn")).count() == 0
    few = spark.createDataFrame([(1, None, "a b", 5, "x"), (1, None, "a b", 5, "x"), (2, None, None, 5, "x"), (None, "s", "c", 5, "x"),
                                 (3, "empty", "", 1, "y")], schema)
    got = op.mixed(few, max_epochs=1.0, entropy_share=None).collect()
    assert sorted((r.doc_id or 0, r.mix_epoch) for r in got) == [(0, 0), (1, 0), (1, 0), (2, 0)]
    one = spark.createDataFrame([(1, "s", "a b c")], "doc_id long, source string, text string")
    assert [r.doc_id for r in op.resampled(one, budget=7).collect()] == [1, 1]
