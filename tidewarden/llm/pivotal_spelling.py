"""Spelling variants: words one edit apart, found through pivotal bigrams.

A word's prefix is its three rarest bigrams (with all repeats of the third).  An edit
destroys two bigrams at most, so of two disjoint ones in a prefix, the pivots, one
survives; and where the other word's prefix reaches at least as far in the order of
rarity, the survivor is in it.  Pivots are the two disjoint bigrams of the prefix whose
lists are the shortest together, chosen by dynamic programming.  Prefixes are indexed
by bigram, position and word length: one edit keeps a surviving bigram in its place, or
moves it by as much as it changes the length.  Pivots meet that index in one equi-join,
and every pair is verified by its edit distance.  Long lists are split into pieces by
their measured sizes.
"""

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import BooleanType

from tidewarden.sources.stage import stage

MIN_LENGTH, MIN_COUNT = 5, 3
#: A word's form is at least so many times as frequent.
RATIO = 2
#: Every so many-th run of the fixed rule for planted misspellings loses a code point.
DROP_EVERY = 97
#: Words of an index list beyond which it is split.
LONG_LIST = 2_000
#: Code points up to which a word itself is in the lists; of longer ones a number is, and pairs fetch the words.
LONG_WORD = 64
#: Distinct words, and characters in them, that a task holds before it hands them on.
_WORDS, _CHARACTERS = 300_000, 16 << 20
_RUN = re.compile("[A-Za-zÀ-ÿ]+")


def _counts(docs: DataFrame, min_length: int, drop_every: int | None, id_col: str, text_col: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())],
                                              names=["word", "n"])

        held, size = Counter(), 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                # Bytes are lower-cased from A to Z only.
                found = Counter(_RUN.findall((text.as_py() or "").encode().lower().decode()))
                start = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                for word, n in found.items():
                    if len(word) < min_length:
                        continue
                    if drop_every:
                        h = zlib.crc32(word.encode(), start)
                        if h % drop_every == 0:
                            k = h % len(word)
                            word = word[:k] + word[k + 1:]
                            if len(word) < min_length:
                                continue
                    size += 0 if word in held else len(word)
                    held[word] += n
                if len(held) > _WORDS or size > _CHARACTERS:
                    yield done()
                    held, size = Counter(), 0
        if held:
            yield done()

    return docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "word string, n long")


def counted(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, drop_every: int | None = None,
            id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): letter runs of all texts, lower-cased from A to Z, with their occurrences.

    ``drop_every``: runs whose checksum with the document's id it divides lose the code
    point that the checksum names.  A null text has no words; a null id is an empty one.
    Repeated rows count as often.
    """
    each = _counts(docs, min_length, drop_every, id_col, text_col)
    return each.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


def pivots(prefix: list[tuple[int, int]], weight: list[int]) -> tuple[tuple[int, int], tuple[int, int]]:
    """The two disjoint bigrams (rank, position) of a prefix with the least weight together.

    ``prefix`` in order of position, ``weight`` by rank.  One pass: the best pair that
    ends at a bigram is that bigram with the best one that ends before it.
    """
    pair, least, before, at = None, None, None, 0
    for gram in prefix:
        while prefix[at][1] <= gram[1] - 2:
            if before is None or weight[prefix[at][0]] < weight[before[0]]:
                before = prefix[at]
            at += 1
        if before is not None:
            total = weight[before[0]] + weight[gram[0]]
            if least is None or total < least:
                pair, least = (before, gram), total
    return pair


def prefix_of(word: str, rank: dict[str, int]) -> list[tuple[int, int]]:
    """(rank, position) of the three rarest bigrams and the repeats of the third, by position."""
    grams = [(rank[word[k:k + 2]], k) for k in range(len(word) - 1)]
    last = sorted(grams)[2][0]
    return [g for g in grams if g[0] <= last]


def _letters(word: str) -> int:
    """A set of letters as bits; code points that are equal modulo 64 share one."""
    bits = 0
    for c in set(word):
        bits |= 1 << (ord(c) & 63)
    return bits - (bits >> 63 << 64)


_LIST = "gram int, place int, size int, id long, word string, n long, reach int, letters long"
_LIST_NAMES = [f.split()[0] for f in _LIST.split(", ")]
_LIST_KINDS = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.int64()]
# How one edit changes (length, position) of a bigram that it leaves alone.
_SHIFTS = ((0, 0), (1, 0), (1, 1), (-1, 0), (-1, -1))


def _lists(words: DataFrame, rank: dict[str, int], weight: list[int], pivotal: bool) -> DataFrame:
    """Index rows of every word's prefix, or (``pivotal``) the rows that its pivots look for."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _LIST_KINDS)], names=_LIST_NAMES)

        rows = []
        for batch in batches:
            for word, n, number in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                word = word.as_py()
                prefix, bits, size = prefix_of(word, rank), _letters(word), len(word)
                reach, short = max(r for r, _ in prefix), word if size <= LONG_WORD else None
                if pivotal:
                    rows += [(r, k + move, size + more, number, short, n, reach, bits)
                             for r, k in pivots(prefix, weight) for more, move in _SHIFTS]
                else:
                    rows += [(r, k, size, number, short, n, reach, bits) for r, k in prefix]
                if len(rows) > 20_000:
                    yield done()
                    rows = []
        if rows:
            yield done()

    return words.select("word", "n", F.xxhash64("word")).mapInArrow(run, _LIST)


def _bigrams(words: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Counter()
        for batch in batches:
            for word in batch.column(0):
                word = word.as_py()
                held.update(map("".join, zip(word, word[1:])))
        yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())],
                                         names=["gram", "n"])

    return words.select("word").mapInArrow(run, "gram string, n long")


def one_edit(a: str, b: str) -> bool:
    """Whether exactly one code point is inserted, deleted or replaced."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    same = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[same + (len(a) >= len(b)):] == b[same + (len(b) >= len(a)):]


@F.pandas_udf(BooleanType())
def _one_edit(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([one_edit(x, y) for x, y in zip(a, b)], dtype=bool)


def near_words(words: DataFrame, long_list: int = LONG_LIST) -> DataFrame:
    """(word, other, other_n), both ways round: words of ``words`` (word, n) at edit distance 1.

    ``words``: a written table of distinct words of four code points or more.
    """
    # Bigrams of two letters: some 8,000 of them at most, whatever the input.
    seen = sorted((r.n, r.gram) for r in _bigrams(words).groupBy("gram").agg(F.sum("n").alias("n")).collect())
    rank, weight = {g: k for k, (_, g) in enumerate(seen)}, [n for n, _ in seen]
    index = stage(_lists(words, rank, weight, False))
    key = ["gram", "place", "size"]
    split = stage(index.groupBy(*key).agg(F.count("*").alias("rows")).filter(F.col("rows") > long_list)
                  .select(*key, F.ceil(F.col("rows") / long_list).cast("int").alias("pieces")))
    pieces = F.coalesce("pieces", F.lit(1))
    index = (index.join(split, key, "left").withColumn("piece", F.pmod(F.xxhash64("id"), pieces).cast("int"))
             .select(*key, "piece", *[F.col(c).alias(f"other_{c}") for c in ("id", "word", "n", "reach", "letters")]))
    sought = (_lists(words, rank, weight, True).join(split, key, "left")
              .select(*_LIST_NAMES, F.explode(F.sequence(F.lit(0), pieces - 1)).alias("piece")))
    long_ones = F.col("word").isNull() | F.col("other_word").isNull()
    found = stage(sought.join(index, [*key, "piece"]).filter(
        (F.col("reach") <= F.col("other_reach"))
        & (F.bit_count(F.col("letters").bitwiseXOR(F.col("other_letters"))) <= 2)
        & (long_ones | (F.levenshtein("word", "other_word", 1) == 1))
    ).select("id", "word", "n", "other_id", "other_word", "other_n"))
    named = words.select(F.xxhash64("word").alias("id"), "word", "n")
    numbers = found.filter(long_ones).select("id", "other_id").distinct()
    fetched = (numbers.join(named, "id").join(named.select(*[F.col(c).alias(f"other_{c}") for c in named.columns]), "other_id")
               .filter(_one_edit("word", "other_word")))
    pairs = found.filter(~long_ones).select("word", "n", "other_word", "other_n").unionByName(
        fetched.select("word", "n", "other_word", "other_n"))
    both = pairs.select(F.inline(F.array(
        F.struct(F.col("word"), F.col("other_word").alias("other"), F.col("other_n")),
        F.struct(F.col("other_word").alias("word"), F.col("word").alias("other"), F.col("n").alias("other_n")))))
    return both.groupBy("word", "other").agg(F.max("other_n").alias("other_n"))


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of every word with a form: pointers doubled until none moves; a form is more frequent, so they end."""
    at = stage(forms.select("word", F.col("form").alias("root")))
    while True:
        up = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        at = stage(at.select("word", "root").join(up, "root", "left")
                   .select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if at.filter("moved").isEmpty():
            return at.select("word", "root")


def spellings(words: DataFrame, ratio: int = RATIO, long_list: int = LONG_LIST) -> DataFrame:
    """word, form, root, n, n_near, form_n for each row of ``words`` (word, n; distinct words).

    ``form``: the near word with the most occurrences (of equals, the first by code points),
    if it has ``ratio`` times the word's.  ``root``: the end of its chain of forms, or the
    word itself.  No words, no rows.
    """
    words = stage(words)
    best = near_words(words, long_list).groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best"))
    fits = -F.col("best.less") >= ratio * F.col("n")
    named = stage(words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(fits, F.col("best.other")).alias("form"), F.when(fits, -F.col("best.less")).alias("form_n")))
    roots = _roots(named.filter(F.col("form").isNotNull()))
    return named.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spellings(counted(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), drop_every=DROP_EVERY))
