"""Language of texts, and of spans in texts of several languages.

The script of a word's first letter narrows its candidates to languages learned in that
script.  Each word gets a score per candidate from hashed letter trigrams and bigrams.
Viterbi over the words, with a penalty for each switch, labels them; runs of one label
are the spans.  A batch of texts is decoded in lockstep, so the work per word is a few
array operations.  The model is a table of fixed size, learned from a bounded sample of
whole texts and counted by Spark.
"""

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, Window

#: Whole texts that are learned from, per language: those with the smallest hashes.
SAMPLE = 2000
#: Texts scored together: rows, and characters (some 100 bytes each in a task); a longer text goes alone.
ROWS, CHARACTERS = 500, 2 << 20
#: Different languages that a model may have.
LANGUAGES = 400
#: Loss of a switch of language between two words, in natural logarithms of odds.
SWITCH = 8.0
#: Rows of the model: n-grams are hashed to so many.
BUCKETS = 1 << 16
#: A language is a candidate in a script that has at least this share of its letters.
SCRIPT_SHARE = 0.01
#: Letters without a break are cut into words of so many, for scripts without blanks.
LONGEST = 24

# First code points of ranges and the script from there on.
SCRIPTS = [
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"),
    (0x0780, "Other"), (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Gurmukhi"), (0x0A80, "Gujarati"),
    (0x0B00, "Oriya"), (0x0B80, "Tamil"), (0x0C00, "Telugu"), (0x0C80, "Kannada"), (0x0D00, "Malayalam"),
    (0x0D80, "Sinhala"), (0x0E00, "Thai"), (0x0E80, "Lao"), (0x0F00, "Tibetan"), (0x1000, "Myanmar"), (0x10A0, "Georgian"),
    (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x13A0, "Other"), (0x1780, "Khmer"), (0x1800, "Mongolian"), (0x18B0, "Other"),
    (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, "Other"), (0x2C60, "Latin"), (0x2C80, "Other"), (0x3040, "Kana"),
    (0x3100, "Other"), (0x3130, "Hangul"), (0x3190, "Other"), (0x3400, "Han"), (0xA000, "Other"), (0xAC00, "Hangul"),
    (0xD7B0, "Other"), (0xF900, "Han"), (0xFB00, "Latin"), (0xFB07, "Other"), (0x20000, "Han"), (0x323B0, "Other")]
_STARTS = np.array([s for s, _ in SCRIPTS], dtype=np.uint32)
_NAMES = sorted({n for _, n in SCRIPTS})
_OF_RANGE = np.array([_NAMES.index(n) for _, n in SCRIPTS])


@lru_cache
def _characters() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per code point: is a letter; is a letter or a mark on one; its lower case where that is one character."""
    every = [chr(c) for c in range(0x110000)]
    letter = np.array([c.isalpha() for c in every])
    part = letter | np.array([unicodedata.category(c)[0] == "M" for c in every])
    low = np.array([ord(c.lower()) if len(c.lower()) == 1 else ord(c) for c in every], dtype=np.uint32)
    return letter, part, low


@dataclass
class Words:
    """The words of some texts: where each lies, which text it is of, its script, and the buckets of its letters."""

    start: np.ndarray
    end: np.ndarray
    text: np.ndarray
    script: np.ndarray
    letter_start: np.ndarray
    buckets: np.ndarray  # (letters, 2): trigram and bigram around each letter of a word, words in order


def _hashed(*codes: np.ndarray) -> np.ndarray:
    h = np.full(len(codes[0]), len(codes), dtype=np.uint32)
    for c in codes:
        h = (h ^ c) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
    return (h & np.uint32(BUCKETS - 1)).astype(np.int64)


def words_of(texts: list[str]) -> Words:
    """All words: runs of letters and marks that hold a letter, cut where they are longer than ``LONGEST``."""
    letter, part, low = _characters()
    codes = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), dtype="<u4") for t in texts]
    sizes = np.array([len(c) for c in codes])
    # One zero between texts: no word and no n-gram crosses from one to the next.
    flat = np.concatenate([x for c in codes for x in (c, np.zeros(1, np.uint32))]) if texts else np.zeros(0, np.uint32)
    first = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]]).astype(np.int64) if texts else np.zeros(0, np.int64)
    mine = part[flat]
    edge = np.diff(np.concatenate([[0], mine.view(np.int8), [0]]))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    has = np.add.reduceat(letter[flat].astype(np.int32), start) if len(start) else np.zeros(0)
    # reduceat runs to the next start; what lies between two words is no letter.
    start, end = start[has > 0], end[has > 0]
    pieces = -(-(end - start) // LONGEST)
    if (pieces > 1).any():
        k = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start, end = np.repeat(start, pieces) + k * LONGEST, np.repeat(end, pieces)
        end = np.minimum(end, start + LONGEST)
    size = end - start
    at = np.repeat(start, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    lowered = np.where(mine, low[flat], 0).astype(np.uint32)
    padded = np.concatenate([[0], lowered, [0]]).astype(np.uint32)
    before, now, after = padded[at], padded[at + 1], padded[at + 2]
    buckets = np.stack([_hashed(before, now, after), _hashed(before, now)], axis=1)
    text = np.searchsorted(first, start, side="right") - 1
    script = _OF_RANGE[np.searchsorted(_STARTS, flat[start], side="right") - 1]
    return Words(start - first[text], end - first[text], text, script, np.cumsum(size) - size, buckets)


@dataclass
class Model:
    """Log probabilities (BUCKETS, languages) and the scripts each language may have (scripts, languages)."""

    languages: list[str]
    table: np.ndarray
    allowed: np.ndarray

    def scores(self, words: Words) -> np.ndarray:
        """(words, languages); languages not learned in a word's script are out, unless all are."""
        if not len(words.start):
            return np.zeros((0, len(self.languages)), np.float32)
        each = self.table[words.buckets[:, 0]]
        each += self.table[words.buckets[:, 1]]
        out = np.add.reduceat(each, words.letter_start, axis=0)
        fits = self.allowed[words.script]
        out = np.where(fits, out, out.min(axis=1, keepdims=True) - 50)
        return np.where(fits.any(axis=1)[:, None], out, 0).astype(np.float32)


def viterbi(scores: np.ndarray, counts: np.ndarray, switch: float) -> np.ndarray:
    """Best label of every row of ``scores``; ``counts``: rows of each text, in order.

    All texts advance by one word at a time; those that have ended drop out.
    """
    labels = np.zeros(len(scores), np.int16)
    order = np.argsort(-counts, kind="stable")
    firsts = (np.cumsum(counts) - counts)[order]
    sizes = counts[order]
    if not len(sizes) or not sizes[0]:
        return labels
    live = np.searchsorted(-sizes, -np.arange(1, sizes[0] + 1), side="right")  # texts with more than t words
    value = scores[firsts[:live[0]]].astype(np.float64)
    came: list[tuple[np.ndarray, np.ndarray]] = []  # per step: switched into the label; the best label before
    ends = np.zeros(live[0], np.int16)
    for t in range(1, sizes[0]):
        n = live[t]
        if n < len(value):
            ends[n:len(value)] = value[n:].argmax(axis=1)
            value = value[:n]
        top = value.argmax(axis=1)
        jump = (value[np.arange(n), top] - switch)[:, None]
        switched = jump > value
        came.append((switched, top.astype(np.int16)))
        value = np.where(switched, jump, value) + scores[firsts[:n] + t]
    ends[:len(value)] = value.argmax(axis=1)
    now = np.zeros(live[0], np.int16)
    for t in range(sizes[0] - 1, -1, -1):
        n, later = live[t], live[t + 1] if t + 1 < sizes[0] else 0
        now[later:n] = ends[later:n]
        if later:
            switched, top = came[t]
            now[:later] = np.where(switched[np.arange(later), now[:later]], top, now[:later])
        labels[firsts[:n] + t] = now[:n]
    return labels


def spans_of(texts: list[str], model: Model, switch: float = SWITCH) -> list[list[tuple[int, int, str, int]]]:
    """(start, end, language, letters) of each text: code points, ends exclusive, no two neighbours alike."""
    words = words_of(texts)
    counts = np.bincount(words.text, minlength=len(texts)) if len(texts) else np.zeros(0, int)
    labels = viterbi(model.scores(words), counts, switch)
    out: list[list[tuple[int, int, str, int]]] = [[] for _ in texts]
    if not len(labels):
        return out
    new = np.flatnonzero(np.concatenate([[True], (labels[1:] != labels[:-1]) | (words.text[1:] != words.text[:-1])]))
    last = np.append(new[1:], len(labels)) - 1
    letters = np.add.reduceat(words.end - words.start, new)
    for text, s, e, k, n in zip(words.text[new].tolist(), words.start[new].tolist(), words.end[last].tolist(),
                                labels[new].tolist(), letters.tolist()):
        out[text].append((s, e, model.languages[k], n))
    return out


def held_out(doc_id: Column) -> Column:
    """Whether the remainder by 4 of the CRC-32 of the id's digits is 2; false without an id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def portions(texts: list[str], rows: int = ROWS, characters: int = CHARACTERS) -> Iterator[tuple[int, int]]:
    """(from, to) of runs of texts with at most so many rows and, unless it is one text, characters."""
    start, size = 0, 0
    for k, text in enumerate(texts):
        if k > start and (k - start >= rows or size + len(text) > characters):
            yield start, k
            start, size = k, 0
        size += len(text)
    if texts:
        yield start, len(texts)


def train(docs: DataFrame, sample: int = SAMPLE, most_languages: int = LANGUAGES) -> Model | None:
    """A model of the languages in ``lang``, from ``sample`` whole texts of each; None without any.

    More than ``most_languages`` different values are an error: the ids chosen, the counts
    and the model, which every task holds, are proportional to their number.

    Rows held out, and rows with a null text, language or id, are not learned from.  Only
    ids are ranked, with their hashes; texts are then read for the few that were chosen.
    """
    usable = docs.filter(F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("doc_id").isNotNull()
                         & ~held_out(F.col("doc_id")))
    if usable.select("lang").distinct().limit(most_languages + 1).count() > most_languages:
        raise ValueError(f"more than {most_languages} languages: name them alike, or raise most_languages")
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = (usable.select("doc_id", "lang").distinct().withColumn("place", F.row_number().over(order))
              .filter(F.col("place") <= sample).select("doc_id", "lang"))
    texts = usable.select("doc_id", "lang", "text").join(F.broadcast(chosen), ["doc_id", "lang"])  # sample x languages ids

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for lang, group in frame.groupby("lang"):
                listed = group["text"].tolist()
                for start, end in portions(listed):
                    w = words_of(listed[start:end])
                    grams = np.bincount(w.buckets.ravel(), minlength=BUCKETS)
                    scripts = np.bincount(w.script, weights=w.end - w.start, minlength=len(_NAMES)).astype(np.int64)
                    for kind, counts in (("gram", grams), ("script", scripts)):
                        seen = np.flatnonzero(counts)
                        yield pd.DataFrame({"lang": lang, "kind": kind, "bucket": seen, "n": counts[seen]})

    sums = (texts.select("lang", "text").mapInPandas(count, "lang string, kind string, bucket long, n long")
            .groupBy("lang", "kind", "bucket").agg(F.sum("n").alias("n")))
    found = sums.toPandas()  # at most BUCKETS and the scripts, for each language
    languages = sorted(found["lang"].unique())
    if not languages:
        return None
    counts = np.zeros((BUCKETS, len(languages)))
    scripts = np.zeros((len(_NAMES), len(languages)))
    for target, kind in ((counts, "gram"), (scripts, "script")):
        part = found[found["kind"] == kind]
        target[part["bucket"], [languages.index(x) for x in part["lang"]]] = part["n"]
    table = np.log((counts + .5) / (counts + .5).sum(axis=0)).astype(np.float32)
    return Model(languages, table, scripts >= SCRIPT_SHARE * scripts.sum(axis=0))


def predicted(docs: DataFrame, model: Model | None, switch: float = SWITCH, id_col: str = "doc_id",
              text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score and spans (array of start, end, lang) of every row.

    ``lang_pred`` has the most letters of the text, ties by name; ``score`` is its share
    of the letters.  Null text, no letter, or no model: "und", 0, no spans.
    """
    schema = "doc_id long, lang_pred string, score double, spans array<struct<start:long, end:long, lang:string>>"
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            listed = [t or "" for t in batch.column(1).to_pylist()]
            for start, end in portions(listed):
                part, texts = batch.slice(start, end - start), listed[start:end]
                found = spans_of(texts, model, switch) if model else [[] for _ in texts]
                names, scores = [], []
                for spans in found:
                    letters: dict[str, int] = {}
                    for _, _, lang, n in spans:
                        letters[lang] = letters.get(lang, 0) + n
                    best = min(letters, key=lambda x: (-letters[x], x), default="und")
                    names.append(best)
                    scores.append(letters[best] / sum(letters.values()) if letters else 0.0)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64()),
                     pa.array([[{"start": s, "end": e, "lang": x} for s, e, x, _ in spans] for spans in found], kind)],
                    names=["doc_id", "lang_pred", "score", "spans"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    out = predicted(docs.select("doc_id", "text"), train(docs))
    listed = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"], s["end"], s["lang"])), ",")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", listed.alias("spans"))
