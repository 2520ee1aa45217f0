import itertools
import random

import pytest
import xxhash

from tidewarden.llm import simhash_dedup as op
from tidewarden.llm.components import components


def slow_fingerprint(text, k=3):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words, word = [], ""
    for c in low + " ":
        if c in " \t\n\x0b\x0c\r":
            words, word = (words + [word] if word else words), ""
        else:
            word += c
    if not words:
        return 0
    grams = [" ".join(words[i:i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << i for i in range(64) if 2 * sum(x >> i & 1 for x in h) > len(h))


def slow_groups(prints, bits=2):
    best = {i: i for i, _ in prints}

    def top(i):
        while best[i] != i:
            i = best[i]
        return i
    for (i, a), (j, b) in itertools.combinations(prints, 2):
        if bin((a ^ b) & (2 ** 64 - 1)).count("1") <= bits:
            x, y = sorted((top(i), top(j)))
            best[y] = x
    return {i: top(i) for i, _ in prints}


TEXTS = ["", None, "one", "One", "two words", "a b c d e", "A  B\tC\nd e", "ÉTÉ été x", "ÉTÉ ÉTÉ x", "a b c d f",
         "x " * 40_000, " \n\t "]


def test_fingerprint_against_definition():
    for t in TEXTS:
        got = op.text_fingerprint(None if t is None else t.encode(), 3) & (2 ** 64 - 1)
        assert got == slow_fingerprint(t), t


def crowd(n, seed):
    """Random fingerprints, chains a bit or two apart, and a dense crowd around one."""
    rnd = random.Random(seed)
    base = [rnd.getrandbits(64) for _ in range(n)]
    chain = [base[0]]
    for _ in range(n):
        x = chain[-1]
        for _ in range(rnd.randint(1, 3)):
            x ^= 1 << rnd.randrange(64)
        chain.append(x)
    hub = [base[1] ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(0, 2))) for _ in range(3 * n)]
    return sorted(set(x - 2 ** 64 if x >> 63 else x for x in base + chain + hub))


@pytest.mark.parametrize("limit", [2, 256])
@pytest.mark.parametrize("bits", [0, 1, 2])
def test_links_connect_what_all_pairs_connect(spark, limit, bits, monkeypatch):
    monkeypatch.setattr(op, "SMALL", limit)  # both ways to join
    fps = crowd(40, bits)
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    links = op.near_links(df, bits, limit)
    assert all(bin((r.a ^ r.b) & (2 ** 64 - 1)).count("1") <= bits for r in links.collect())
    got = {r.id: r.component for r in components(links).collect()}
    want = slow_groups([(f, f) for f in fps], bits)
    assert {f: got.get(f, f) for f in fps} == want


def test_groups_and_edge_cases(spark):
    rows = [(i, t, "s") for i, t in enumerate(TEXTS)] + [(5, TEXTS[5], "again")]
    df = spark.createDataFrame(rows, "doc_id long, text string, component string")
    got = op.simhash_groups(df).collect()
    assert len(got) == len(rows)
    want = slow_groups([(i, slow_fingerprint(t)) for i, t in enumerate(TEXTS)])
    assert {r.id: r.component for r in got} == want
    kept = op.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))


def test_repeated_ids_and_rows_without_one(spark):
    rows = [(1, "b second text of this id", 2, {"k": 1}), (1, "a first text of this id", 9, None), (1, "a first text of this id", 3, None),
            (None, "no id", 1, None), (None, "no id", 1, None), (4, None, 5, {}), (6, "", 5, {})]
    schema = "doc_id long, text string, size int, more map<string, int>"
    kept = [sorted(map(tuple, op.keep_one(spark.createDataFrame(part, schema).repartition(3)).collect()), key=repr)
            for part in (rows, rows[::-1])]
    assert kept[0] == kept[1]
    assert sorted((r[0] or 0, r[1], r[2]) for r in kept[0]) == [
        (0, "no id", 1), (0, "no id", 1), (1, "a first text of this id", 3), (4, None, 5)]


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert op.simhash_groups(df).count() == 0 and op.keep_one(df).count() == 0


def test_components_of_paths_stars_and_noise(spark):
    rnd = random.Random(3)
    pairs = [(i, i + 1) for i in range(100, 160)] + [(7, x) for x in range(200, 260)] + [(1, 1), (None, 4), (9, 7)]
    pairs += [(rnd.randrange(300, 400), rnd.randrange(300, 400)) for _ in range(60)]
    got = {r.id: r.component for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    root = {}

    def top(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x
    for a, b in pairs:
        if a is not None and a != b:
            x, y = sorted((top(a), top(b)))
            root[y] = x
    assert got == {x: top(x) for x in root}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_query_against_definition(spark):
    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in op.query(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    prints = [(d.doc_id, slow_fingerprint(d.text)) for d in docs if len(d.text) < 20_000]
    assert all(got[i].fingerprint == f"{f:016x}" for i, f in prints)
    every = [(i, int(r.fingerprint, 16)) for i, r in got.items()]
    assert {i: r.component_id for i, r in got.items()} == slow_groups(every)
