import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewarden.llm import quality_perplexity as op

SCHEMA = "doc_id long, lang string, text string"
LABELS = "doc_id long, quality int, toxic int"


def chars(text):
    """The symbols of a text, written plainly."""
    out, blank = [], True
    for c in text:
        c = chr(ord(c) & 0xFFFF)
        if c in "\0\1\t\n\x0b\x0c\r \x85\xa0  　":
            if not blank:
                out.append(" ")
            blank = True
        else:
            out.append("0" if c in "0123456789" else c)
            blank = False
    if out and out[-1] == " ":
        out.pop()
    return "".join(out) + "\1" if out else ""


def slow_model(learned, every):
    """P(g) of every 4-gram of ``every``, by the formulas, with dictionaries."""
    def grams(t):
        p = "\0" * 3 + chars(t)
        return [p[i:i + 4] for i in range(len(p) - 3)] if chars(t) else []

    top = Counter(g for t in learned for g in grams(t))
    tables = {4: top}
    for k in (3, 2, 1):
        tables[k] = Counter(g[1:] for g in tables[k + 1])
    cuts, totals = {}, {}
    for k, t in tables.items():
        n = [sum(1 for c in t.values() if c == i) for i in range(1, 5)]
        y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0
        cuts[k] = [min(max(i + 1 - (i + 2) * y * n[i + 1] / n[i], 0.1), i + 0.9) if n[0] and n[i] and n[i + 1] else 0.5
                   for i in range(3)]
        totals[k] = defaultdict(lambda: [0, 0.0])
        for g, c in t.items():
            totals[k][g[:-1]][0] += c
            totals[k][g[:-1]][1] += cuts[k][min(c, 3) - 1]

    def p(g):
        below = p(g[1:]) if len(g) > 1 else 1 / 65536
        total, freed = totals[len(g)].get(g[:-1], (0, 0))
        c = tables[len(g)][g]
        return (c - (cuts[len(g)][min(c, 3) - 1] if c else 0) + freed * below) / total if total else below

    return {t: math.exp(-sum(math.log(p(g)) for g in grams(t)) / len(grams(t))) if grams(t) else None for t in every}


def texts(n=60, seed=3):
    rnd = random.Random(seed)
    words = ["and", "the", "tion", "eau", "über", "of,", "x1", "Zz!", "漢字", "😀a", "\n", "aaaa" * 200]
    return [" ".join(rnd.choice(words) for _ in range(rnd.choice([0, 1, 3, 40]))) for _ in range(n)]


@pytest.fixture(scope="module")
def rows():
    return [(i, ["en", "fr", None][i % 3], t) for i, t in enumerate(texts())] + [(900, "en", None), (901, "en", " \n")]


def test_codes():
    for t in [*texts(), "", " a  b ", "\0\1", "7　 8", "\ud800"]:
        assert "".join(map(chr, op.codes_of(t))) == chars(t), repr(t)
    assert len(op.grams_of(op.codes_of(""))) == 0


@pytest.mark.parametrize("unit,part,small", [(op._UNIT, op._PART, op.SMALL), (2000, 500, 0)])
def test_perplexity_is_that_of_the_plain_model(spark, rows, monkeypatch, unit, part, small):
    for name, value in (("_UNIT", unit), ("_PART", part), ("SMALL", small)):
        monkeypatch.setattr(op, name, value)
    docs = op.stage(spark.createDataFrame(rows, SCHEMA).repartition(3))
    trusted = spark.range(40).select(F.col("id").alias("doc_id"))
    fold = {r.doc_id: r.f for r in docs.select("doc_id", op._fold(F.col("doc_id")).alias("f")).collect()}
    want = [slow_model([t for i, _, t in rows if i < 40 and fold[i] != f], {t or "" for _, _, t in rows}) for f in range(op.FOLDS)]
    got = op.perplexities(docs, trusted).collect()
    assert len(got) == len(rows)
    for r in got:
        w = want[fold[r.doc_id]][dict((i, t) for i, _, t in rows)[r.doc_id] or ""]
        assert (w is None) == (r.perplexity is None)
        assert w is None or math.isclose(w, r.perplexity, rel_tol=1e-9)


def test_documents_in_another_order_are_an_error(spark):
    import pyarrow as pa

    parts = pa.table({"unit": [0], "doc_id": [[1]], "lang": [["en"]], "fold": pa.array([[0]], pa.list_(pa.int32())), "bytes": [[2]],
                      "texts": [__import__("zstandard").compress(b"ab")]})
    known = pa.table({"gram": pa.array([5]), **{f"logp{f}": pa.array([-1.0]) for f in range(op.FOLDS)}})
    with pytest.raises(RuntimeError, match="another order"):
        op._summed((0,), parts, known)


def test_probabilities_sum_to_one(spark):
    """After a seen context, over all codes: seen ones by the model, the rest by what it leaves."""
    learned = ["abab", "abcb", "bcab", "cabd"] * 2
    codes = [ord(c) for c in "abcd"] + [1, 5000, 5001]
    counts = Counter(int(g) for t in learned for g in op.grams_of(op.codes_of(t)))
    context = [ord("a"), ord("b")]
    all_ = {int((0 << 48) | (context[0] << 32) | (context[1] << 16) | c) for c in codes}
    frame = spark.createDataFrame([(g, counts.get(g, 0)) for g in all_ | counts.keys()], "gram long, c long")
    p = {r.gram: math.exp(r.logp) for r in op.probabilities(op.stage(frame)).collect()}
    seen = sum(p[g] for g in all_ if g & 0xFFFF not in (5000, 5001))
    unseen = p[(context[0] << 32) | (context[1] << 16) | 5000]
    assert unseen == pytest.approx(p[(context[0] << 32) | (context[1] << 16) | 5001])
    assert seen + (op.CODES - 5) * unseen == pytest.approx(1.0)


def test_held_out_quality(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    found = op.query(spark, sf).join(labels, "doc_id").filter("toxic = 0")
    rate = {r.quality: r.rate for r in found.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("rate")).collect()}
    assert rate[1] > 0.97 and rate[0] < 0.3


def test_edge_cases(spark):
    none, no_labels = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], LABELS)
    assert op.judged(none, no_labels).count() == 0 and op.keep_good(none, no_labels).count() == 0
    schema = SCHEMA + ", gram long, kept string, learn string, size int"
    more = (1, "k", "l", 2)
    few = spark.createDataFrame([(1, "en", "some text", *more), (1, "en", "some text", *more), (2, None, None, *more),
                                 (None, "en", "other", *more), (3, "fr", "", *more), (None, None, None, *more)], schema)
    got = op.judged(few, no_labels).collect()
    assert sorted((r.doc_id or 0, r.kept) for r in got) == [(0, False), (0, True), (1, True), (1, True), (2, False), (3, False)]
    kept = op.keep_good(few, no_labels)
    assert kept.columns == few.columns and sorted((r.doc_id or 0) for r in kept.collect()) == [0, 0, 1, 1]
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (None, 1, 0), (2, None, 0)], LABELS)
    assert op.judged(few, labels).count() == 6


def test_frequent_ngrams_of_one_text(spark):
    docs = spark.createDataFrame([*[(i, "en", "a" * 3000) for i in range(10)], (99, "en", "b")], SCHEMA)
    labels = spark.createDataFrame([(i, 1, 0) for i in [*range(10), 99]], LABELS)
    got = {r.doc_id: r for r in op.judged(docs, labels).collect()}
    assert np.isfinite(got[1].perplexity) and got[1].perplexity < got[99].perplexity


@pytest.mark.parametrize("n_trusted", [0, 1, 10, 40])
def test_clean_documents_of_a_small_language_stay(spark, n_trusted):
    """Beside a large language; the small one has few trusted rows, or none."""
    rnd = random.Random(7)
    large = ["the", "and", "of", "a", "in", "time", "house", "water", "day", "people", "work", "small"]
    small = ["жизнь", "город", "вода", "работа", "день", "народ", "время", "дом", "рука", "слово", "мир", "дело"]
    rows = [(i, "en", " ".join(rnd.choice(large) for _ in range(60))) for i in range(400)]
    rows += [(1000 + i, lang, " ".join(rnd.choice(small) for _ in range(60))) for i in range(100) for lang in [["ru", None][i % 2]]]
    labels = [(i, 1, 0) for i in range(300)] + [(1000 + i, 1, 0) for i in range(2 * n_trusted)]
    got = op.judged(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, LABELS)).collect()
    for lang in ("ru", None):
        kept = [r.kept for r in got if r.lang == lang]
        assert len(kept) == 50 and sum(kept) >= 45, (lang, n_trusted, sum(kept))
        assert all((r.most is None) == (n_trusted == 0) for r in got if r.lang == lang)
    assert sum(r.kept for r in got if r.lang == "en") >= 390


def test_an_id_labelled_both_ways_is_not_trusted(spark):
    docs = spark.createDataFrame([(1, "en", "some text"), (2, "fr", "autre texte")], SCHEMA)
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, 1, 0), (2, 1, 0), (1, 1, 1)], LABELS)
    got = {r.doc_id: r.most for r in op.judged(docs, labels).collect()}
    assert got[1] is None and got[2] is not None
