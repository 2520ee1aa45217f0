import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidewarden.llm import first_fit_packing as op

TOKENIZER = Tokenizer.from_file(public_tokenizers.path(op.VOCABULARY))


def ids(text):
    return np.array(TOKENIZER.encode(text or "", add_special_tokens=False).ids + [1], "<u4")


@pytest.mark.parametrize("seed", range(6))
def test_first_fit_is_the_plain_one(seed):
    rnd = random.Random(seed)
    sizes = [rnd.choice([rnd.randint(1, 64), 33, 21]) for _ in range(rnd.choice([0, 1, 2, 300]))]
    rooms, want = [], []
    for k in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        b = next((b for b, r in enumerate(rooms) if r >= sizes[k]), len(rooms))
        if b == len(rooms):
            rooms.append(64)
            want.append([])
        rooms[b] -= sizes[k]
        want[b].append(k)
    assert op.first_fit(sizes, 64) == want


@pytest.mark.parametrize("seed", range(6))
def test_dissolving_leaves_one_underfull_bin_and_every_token(seed):
    rnd = random.Random(seed)
    sizes = [rnd.randint(33, 63) for _ in range(rnd.randint(1, 200))]
    bins = op.dissolved(op.first_fit(sizes, 64), sizes, 64)
    loads = [sum(e - s for _, s, e in b) for b in bins]
    assert sum(n < 64 for n in loads) <= 1 and max(loads) <= 64 and sum(loads) == sum(sizes)
    assert sorted((k, t) for b in bins for k, s, e in b for t in range(s, e)) == [
        (k, t) for k, n in enumerate(sizes) for t in range(n)]
    assert sum(len(b) for b in bins) <= 2 * len(sizes)


def test_whole_items_stay_whole_where_they_fit():
    sizes = [40, 30, 24, 20, 14]
    assert [[(k, s, e) for k, s, e in b] for b in op.dissolved(op.first_fit(sizes, 64), sizes, 64)] == [
        [(0, 0, 40), (2, 0, 24)], [(1, 0, 30), (3, 0, 20), (4, 0, 14)]]


def test_powers():
    parts = [(0, 0, 5), (1, 2, 10)]
    assert op.in_powers(parts) == [[(0, 0, 5), (1, 2, 5)], [(1, 5, 9)], [(1, 9, 10)]]
    assert op.in_powers([(0, 0, 8)]) == [[(0, 0, 8)]]


def check_rows(rows, texts, capacity=2048):
    by_seq, by_doc = defaultdict(list), defaultdict(list)
    for r in rows:
        by_seq[r.sequence_id].append((r.offset, r.length))
        by_doc[r.doc_id].append((r.start, r.length, r.ids_crc32, r.doc_tokens))
    for parts in by_seq.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at and n > 0
            at += n
        assert at == capacity or at & (at - 1) == 0 and at < capacity
    want = defaultdict(list)
    for doc, text in texts:
        want[doc].append(ids(text))
    assert by_doc.keys() == want.keys()
    for doc, found in by_doc.items():
        assert sum(n for _, n, _, _ in found) == sum(map(len, want[doc]))
        if len(want[doc]) == 1:
            one, at = want[doc][0], 0
            for start, n, crc, tokens in sorted(found):
                assert start == at and tokens == len(one) and crc == zlib.crc32(one[start:start + n])
                at += n
    return by_seq


@pytest.mark.parametrize("per_group", [op.PER_GROUP, 20])
def test_query_against_definition(spark, per_group):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = op.pack_documents(docs, per_group=per_group).collect()
    found = check_rows(rows, [tuple(r) for r in docs.collect()])
    groups = -(-docs.count() // per_group)
    assert len(found) <= sum(r.length for r in rows) / 2048 + 11 * groups
    again = op.pack_documents(docs, per_group=per_group).collect()
    assert sorted(map(repr, rows)) == sorted(map(repr, again))


def test_edge_cases(spark):
    texts = [(1, None), (2, ""), (3, "a b"), (3, "a b"), (None, "x"), (4, "word " * 30_000), (5, "x" * 50_000)]
    df = spark.createDataFrame([(d, t, "u", 1) for d, t in texts], "doc_id long, text string, uid string, grp int")
    check_rows(op.pack_documents(df).collect(), texts)
    none = spark.createDataFrame([], "doc_id long, text string")
    assert op.pack_documents(none).count() == 0


def test_copies_are_spread_over_groups(spark):
    df = spark.range(900).selectExpr("7L AS doc_id", "'the same text of a hot group' AS text")
    found = op.stage(op.pieces(df))
    rows = op.pack(found, per_group=30).collect()
    assert len({r.sequence_id >> 24 for r in rows}) >= 25
    assert sum(r.length for r in rows) == 900 * len(ids("the same text of a hot group"))


def test_wide_ids():
    for top in (65_535, 65_536, 200_000):
        one = np.array([0, 1, top], "<u4")
        assert op._wide(op._narrow(one)).tolist() == one.tolist()
