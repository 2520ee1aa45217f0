import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import pytest

from tidewarden.llm import pivotal_spelling as op

LOWER = {c: c + 32 for c in range(65, 91)}


def plain_counts(docs, drop_every=97):
    n = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc is None else doc}:{word}".encode())
            if drop_every and h % drop_every == 0:
                k = h % len(word)
                word = word[:k] + word[k + 1:]
            n[word] += 1
    return {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}


def plain(n):
    """Every pair at distance 1, by deletions and by patterns with one open place."""
    by, near = defaultdict(set), defaultdict(set)
    for w in n:
        for k in range(len(w)):
            by[w[:k] + "*" + w[k + 1:]].add(w)
            shorter = w[:k] + w[k + 1:]
            if shorter in n:
                near[w].add(shorter)
                near[shorter].add(w)
    for group in by.values():
        for a, b in combinations(group, 2):
            near[a].add(b)
            near[b].add(a)
    form = {}
    for w, others in near.items():
        top = min(others, key=lambda o: (-n[o], o))
        if n[top] >= 2 * n[w]:
            form[w] = top
    out = {}
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out[w] = (form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None)
    return out


def rows_of(df):
    rows = df.collect()
    out = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(out) == len(rows)
    return out


def test_query_against_definition(spark):
    sf = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    want = plain(plain_counts(docs))
    assert rows_of(op.query(spark, sf)) == want and sum(f is not None for f, *_ in want.values()) > 20


@pytest.mark.parametrize("seed,long_list", [(0, 2000), (1, 3), (2, 7)])
def test_dense_words(spark, seed, long_list):
    rnd = random.Random(seed)
    letters = "ab" if seed < 2 else "abcé÷"
    n = {"".join(rnd.choice(letters) for _ in range(rnd.randint(5, 9))): rnd.choice([3, 4, 6, 12, 50, 400]) for _ in range(700)}
    df = spark.createDataFrame(list(n.items()), "word string, n long")
    assert rows_of(op.spellings(df, long_list=long_list)) == plain(n)


def test_pivots_are_the_lightest_disjoint_pair():
    rnd = random.Random(3)
    for _ in range(300):
        weight = [rnd.randint(1, 9) for _ in range(12)]
        prefix = sorted(((rnd.randrange(12), k) for k in rnd.sample(range(10), rnd.randint(3, 7))), key=lambda g: g[1])
        a, b = op.pivots(prefix, weight)
        least = min(weight[x[0]] + weight[y[0]] for x, y in combinations(prefix, 2) if abs(x[1] - y[1]) >= 2)
        assert abs(a[1] - b[1]) >= 2 and weight[a[0]] + weight[b[0]] == least


def test_chains_ties_and_hubs(spark):
    n = {"abcdef": 3, "abcdeg": 6, "abcdhg": 12, "abcihg": 24, "ajcihg": 48, "zzzzz": 3, "zzzzy": 7, "zzzzx": 7,
         "solitary": 9, "bcdef": 3}
    got = rows_of(op.spellings(spark.createDataFrame(list(n.items()), "word string, n long")))
    assert got["abcdef"] == ("abcdeg", "ajcihg", 3, 2, 6) and got["zzzzz"] == ("zzzzx", "zzzzx", 3, 2, 7)
    assert got["solitary"] == (None, "solitary", 9, 0, None) and got["zzzzy"] == (None, "zzzzy", 7, 2, None)
    hub = {"w" * k + "a" + "w" * (60 - k): 3 for k in range(60)} | {"w" * 61: 1000, "w" * 60: 3}
    assert rows_of(op.spellings(spark.createDataFrame(list(hub.items()), "word string, n long"))) == plain(hub)


def test_words_longer_than_the_lists_hold(spark):
    rnd = random.Random(8)
    n = {}
    for size in (63, 64, 65, 66, 300):
        word = "".join(rnd.choice("abc") for _ in range(size))
        n[word] = 100
        for k in range(0, size, 9):
            n[word[:k] + word[k + 1:]] = 5
            n[word[:k] + "d" + word[k + 1:]] = 3
            n[word[:k] + "da" + word[k:]] = 4
    assert rows_of(op.spellings(spark.createDataFrame(list(n.items()), "word string, n long"), long_list=5)) == plain(n)


def test_one_edit():
    words = ["", "a", "b", "ab", "ba", "aa", "aab", "abb", "abab", "aabb", "é", "aé"]
    for a in words:
        for b in words:
            table = [[max(i, j) if not i or not j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
            for i in range(1, len(a) + 1):
                for j in range(1, len(b) + 1):
                    table[i][j] = min(table[i - 1][j] + 1, table[i][j - 1] + 1, table[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            assert op.one_edit(a, b) == (table[-1][-1] == 1)


def test_counts_of_odd_rows(spark):
    docs = [(1, None), (2, ""), (None, "straße Straße STRASSE straße"), (4, "ÀÉÎÕÜ àéîõü ÀÉÎÕÜ ÀÉÎÕÜ"), (5, "x" * 200_000),
            (5, "x" * 200_000), (6, ("x" * 200_000 + " ") + "plain plain, plain.plain"), (6, "plain"), (6, "plain")]
    df = spark.createDataFrame([(d, t, "w", 3) for d, t in docs], "doc_id long, text string, word string, n int")
    for every in (None, 97, 2):
        want = plain_counts(docs, every)
        assert {r.word: r.n for r in op.counted(df, drop_every=every).collect()} == want
    more = docs + [(7, "x" * 199_999)] * 6
    df = spark.createDataFrame(more, "doc_id long, text string")
    assert rows_of(op.spellings(op.counted(df))) == {
        "straße": (None, "straße", 3, 0, None), "plain": (None, "plain", 6, 0, None),
        "ÀÉÎÕÜ": (None, "ÀÉÎÕÜ", 3, 0, None), "x" * 199_999: (None, "x" * 199_999, 6, 1, None),
        "x" * 200_000: ("x" * 199_999, "x" * 199_999, 3, 1, 6)}
    none = spark.createDataFrame([], "doc_id long, text string")
    assert op.spellings(op.counted(none)).count() == 0
