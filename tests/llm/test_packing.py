import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from tidewarden.llm import packing as op

PATH = public_tokenizers.path(op.VOCABULARY)
TOKENIZER, ENCODER = Tokenizer.from_file(PATH), op.Encoder(PATH)


def ids(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids + [2]


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=" \n\t\r\x0b\x1c\x85\xa0ab.,'s1é中<|", max_size=24))
def test_encoder_has_the_ids_of_the_tokenizer(text):
    assert ENCODER.fast and ENCODER.ids(text).tolist() == ids(text)[:-1]


def test_special_and_long_texts():
    for text in ("<|endoftext|>", "a <|endoftext|> b", "x" * 5000, "a b " * 3000, "   a", "a   b\n\n  c ", "\n\t\n",
                 " " * 70_000, "\n" * 70_000, "xyz" * 30_000, "é!" * 20_000, "1" * 9_000, "\x1c" * 3_000, "日本語テキスト" * 400):
        assert ENCODER.ids(text).tolist() == ids(text)[:-1]


def test_other_vocabularies_go_by_their_own_tokenizer():
    other = op.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    assert not other.fast
    assert other.ids("A small test").tolist() == other.tokenizer.encode("A small test", add_special_tokens=False).ids


def test_cut():
    assert op.cut(1, 4) == [(0, 1)] and op.cut(4, 4) == [(0, 4)] and op.cut(8, 4) == [(0, 4), (4, 4)]
    assert op.cut(9, 4) == [(0, 1), (1, 4), (5, 4)]


@pytest.mark.parametrize("seed", range(4))
def test_best_fit_is_tight(seed):
    rnd = random.Random(seed)
    sizes = np.array([rnd.randint(1, 60) for _ in range(400)])
    uid = np.array(rnd.sample(range(10_000), 400))
    bins, offset, load = op.best_fit(uid, sizes, 64)
    by = defaultdict(list)
    for b, o, s, n in zip(bins, offset, sizes, load):
        by[b].append((o, s, n))
    for parts in by.values():
        at = 0
        for o, s, n in sorted(parts):
            assert o == at
            at += s
        assert at == parts[0][2] <= 64
    assert len(by) <= -(-sizes.sum() // 64) * 11 / 9 + 1


def check_rows(rows, texts):
    """Every document whole and with its ids, every sequence gapless and within the limit."""
    by_seq, seen = defaultdict(list), defaultdict(list)
    for r in rows:
        by_seq[r.sequence_id].append((r.offset, r.length))
        seen[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
    for parts in by_seq.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 1024
    want = defaultdict(list)
    for doc, text in texts:
        one = ids(text)
        for k, (s, n) in enumerate(op.cut(len(one), 1024)):
            want[doc].append((k, s, n, zlib.crc32(np.array(one[s:s + n], "<u4").tobytes())))
    key = lambda x: sorted(map(repr, x))
    assert {d: key(v) for d, v in seen.items()} == {d: key(v) for d, v in want.items()}
    return len(by_seq)


@pytest.mark.parametrize("per_task", [100_000, 25])
def test_query_against_definition(spark, per_task):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = op.pack_documents(docs, per_task=per_task).collect()
    bins = check_rows(rows, [tuple(r) for r in docs.collect()])
    least = -(-sum(r.length for r in rows) // 1024)
    assert bins <= least * 1.08 + 1


def test_edge_cases(spark):
    texts = [(1, None), (2, ""), (3, "a b"), (3, "a b"), (None, "x"), (4, "word " * 3000)]
    df = spark.createDataFrame([(d, t, 7, "u") for d, t in texts], "doc_id long, text string, piece int, uid string")
    check_rows(op.pack_documents(df).collect(), texts)
    none = spark.createDataFrame([], "doc_id long, text string")
    assert op.pack_documents(none).count() == 0


@pytest.mark.parametrize("small", [0, 150])
def test_pieces_that_nothing_fits_do_not_meet_in_one_task(spark, monkeypatch, small):
    rounds, plain = [], op._round

    def noted(items, tasks, *rest):
        rounds.append((items.count(), tasks))
        return plain(items, tasks, *rest)

    monkeypatch.setattr(op, "_round", noted)
    found = op.stage(spark.range(600 + small).selectExpr("id AS uid", "CAST(IF(id < 600, 513 + id % 400, 5 + id % 100) AS long) AS length"))
    rows = op.pack(found, per_task=25).collect()
    assert all(n <= 25 * tasks for n, tasks in rounds) and len(rounds) < 40
    loads = defaultdict(int)
    for r in rows:
        loads[r.sequence_id] += r.length
    assert len(rows) == 600 + small and max(loads.values()) <= 1024 and len(loads) <= 600 + small // 10
