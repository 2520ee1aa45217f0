import itertools
import random
import zlib

import numpy as np
import pytest

from tidewarden.llm import language_spans as op

FOX = {"en": "the quick brown fox jumps over the lazy dog and the cat with all of their friends in this house",
       "de": "der schnelle braune fuchs springt über den faulen hund und die katze mit ihren freunden in diesem haus",
       "ru": "быстрая коричневая лиса прыгает через ленивую собаку и кошку со всеми друзьями в этом доме"}


def training(spark, n=60):
    rnd, rows = random.Random(1), []
    for i in range(n):
        lang = list(FOX)[i % 3]
        words = FOX[lang].split()
        rows.append((i, " ".join(rnd.choice(words) for _ in range(60)), lang))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


@pytest.fixture(scope="module")
def model(spark):
    return op.train(training(spark))


def slow_viterbi(scores, switch):
    n, k = scores.shape
    best = max(itertools.product(range(k), repeat=n),
               key=lambda p: sum(scores[i, p[i]] for i in range(n)) - switch * sum(a != b for a, b in zip(p, p[1:])))
    return sum(scores[i, best[i]] for i in range(n)) - switch * sum(a != b for a, b in zip(best, best[1:]))


@pytest.mark.parametrize("seed", range(6))
def test_viterbi_finds_the_best_path(seed):
    rnd = np.random.default_rng(seed)
    counts = np.array([3, 0, 6, 1, 5, 6, 0])
    scores = rnd.normal(size=(counts.sum(), 3)) * 2
    labels = op.viterbi(scores, counts, 1.5)
    for start, n in zip(np.cumsum(counts) - counts, counts):
        if n:
            part, path = scores[start:start + n], labels[start:start + n]
            value = part[np.arange(n), path].sum() - 1.5 * (path[1:] != path[:-1]).sum()
            assert value == pytest.approx(slow_viterbi(part, 1.5))


def test_words():
    texts = ["Ab, cd", "", "9 é!", "x" * 60, "क्या है"]
    w = op.words_of(texts)
    assert [(t, texts[t][s:e]) for t, s, e in zip(w.text, w.start, w.end)] == [
        (0, "Ab"), (0, "cd"), (2, "é"), (3, "x" * 24), (3, "x" * 24), (3, "x" * 12), (4, "क्या"), (4, "है")]
    assert (op.words_of(["AB"]).buckets == op.words_of(["ab"]).buckets).all()


def test_mixed_texts_give_spans(model):
    text = FOX["en"] + ". " + FOX["ru"] + "! 123 " + FOX["de"]
    spans = op.spans_of([text, "", FOX["de"]], model)
    assert [s[2] for s in spans[0]] == ["en", "ru", "de"] and spans[1] == [] and [s[2] for s in spans[2]] == ["de"]
    assert text[spans[0][1][0]:spans[0][1][1]] == FOX["ru"]


def test_script_narrows(model):
    # Latin words that the Russian texts never had, Cyrillic words that no other language had.
    assert [s[2] for s in op.spans_of(["щщщ ъъъ", "qqqq"], model)[0]] == ["ru"]
    assert op.spans_of(["qqqq zzzz"], model)[0][0][2] in ("de", "en")


def test_edge_cases(spark, model):
    rows = [(1, None), (2, ""), (3, "123 ..."), (4, FOX["en"]), (4, FOX["en"]), (None, FOX["de"]), (6, "der hund " * 20_000)]
    df = spark.createDataFrame([(*r, "z", 1) for r in rows], "doc_id long, text string, lang string, start int")
    got = op.predicted(df, model).collect()
    assert sorted((r.doc_id or 0, r.lang_pred) for r in got) == [(0, "de"), (1, "und"), (2, "und"), (3, "und"), (4, "en"), (4, "en"), (6, "de")]
    assert all(0 <= r.score <= 1 for r in got)
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert op.train(empty) is None and op.predicted(empty, None).count() == 0
    assert op.predicted(df, None).select("lang_pred").distinct().collect()[0][0] == "und"


def test_held_out_texts_teach_nothing(spark, model):
    data = training(spark)
    rows = [(i, t, lang) for i, t, lang in data.collect()]
    keep = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 != 2]
    assert 0 < len(keep) < len(rows)
    other = op.train(spark.createDataFrame(keep + [(None, "zz", "xx"), (700, None, "yy")], data.schema))
    assert other.languages == model.languages and (other.table == model.table).all()


def test_query_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    out = op.query(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert len(out) == 1000
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out)
    tested = [r for r in out if r.held_out]
    assert sum(r.lang_pred == r.lang for r in tested) >= 0.97 * len(tested)


def test_portions_follow_characters():
    texts = ["x" * n for n in (5, 5, 100, 3, 0, 0, 8, 1)]
    got = list(op.portions(texts, 3, 10))
    assert got == [(0, 2), (2, 3), (3, 6), (6, 8)]
    assert list(op.portions([], 3, 10)) == [] and list(op.portions(["a" * 99], 3, 10)) == [(0, 1)]


def test_long_texts_in_portions_are_labelled_like_alone(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    model = op.train(docs)
    whole = sorted(map(repr, op.predicted(docs, model).collect()))
    monkeypatch.setattr(op.portions, "__defaults__", (7, 3000))
    assert sorted(map(repr, op.predicted(docs, model).collect())) == whole


def test_too_many_languages_are_an_error(spark):
    docs = spark.createDataFrame([(i, f"text number {i}", f"l{i}") for i in range(9)], "doc_id long, text string, lang string")
    with pytest.raises(ValueError, match="languages"):
        op.train(docs, most_languages=3)
