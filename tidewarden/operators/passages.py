"""Passages and their retrieval by theme."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as T
from ..sources.stage import stage
from .mentions import WORD, anchor_word, name_surface
from .ranking import top_k
from .rows import unnest, unnest_numbered

# Standard constants of the BM25 score.
K1, B = 1.2, 0.75
#: Rows up to which phrases and winners are broadcast: some MB in a task.
FEW = 1 << 16
#: Phrases up to which each passage is searched for all of them; beyond, its distinct words meet theirs.
SCANNED = 64
#: Words of the passages that a task sorts: some tens of MB.
WORDS_A_TASK = 4_000_000


def few(written: DataFrame) -> DataFrame:
    return F.broadcast(written) if written.count() <= FEW else written


def passages(docs: DataFrame, keys: list[str], size: int = 500_000, overrun: int = 1000) -> DataFrame:
    """Cut texts into passages of at least ``size`` characters that end at whitespace."""
    return unnest_numbered(docs, T.chunks(F.col("text"), size, overrun), "passage_no", "passage", *keys)


def identified(passage_rows: DataFrame, doc: str) -> DataFrame:
    """``passage_id``: the document and the number in it, which orders like them and is unique however many there are."""
    return passage_rows.withColumn("passage_id", F.struct(doc, "passage_no"))


def attribute_filter(filters: dict | None) -> Column:
    """AND of equality tests on filing_type, ticker and fiscal_year.

    An entry of the wrong type, or an unknown one, is ignored.  The result is a
    plain predicate, so it reaches the scan and prunes partitions.
    """
    kinds = {"filing_type": str, "ticker": str, "fiscal_year": int}
    out = F.lit(True)
    for name, kind in kinds.items():
        value = (filters or {}).get(name)
        if isinstance(value, kind) and not (kind is int and isinstance(value, bool)):
            out = out & (F.col(name) == F.lit(value))
    return out


def with_word_counts(passage_rows: DataFrame) -> DataFrame:
    return passage_rows.withColumn("n_words", T.word_count(F.col("passage"), WORD))


def _occurrences(low: Column, surface: str, word: str) -> Column:
    """How often a lower-cased text holds the phrase; 0 if only its longest word, null if not even that.

    The pattern begins with the letters, which are found faster than boundaries of words.
    """
    count = F.nullif(F.regexp_count(low, F.lit(rf"(?U)\Q{surface}\E(?<=\b\Q{surface}\E)\b")), F.lit(0))
    if word != surface:
        count = F.coalesce(F.when(F.contains(low, F.lit(surface)), count),
                           F.when(F.regexp(low, F.lit(rf"(?U)(?<!\w)\Q{word}\E(?!\w)")), F.lit(0)))
    return F.when(F.contains(low, F.lit(word)), count)


def _scanned(passage_rows: DataFrame, wanted: list, tasks: int) -> DataFrame:
    """(theme, passage_id, n_words, tf) of the passages that hold a phrase, in one pass that moves no text.

    Passages of one id, if it repeats, meet each other as in a join by it.
    """
    counts = passage_rows.select("passage_id", "n_words", F.lower("passage").alias("_low")).select(
        "passage_id", "n_words", *[_occurrences(F.col("_low"), r.surface, r.word).alias(f"_{i}") for i, r in enumerate(wanted)])
    each = F.array(*[F.struct(F.lit(r.theme).alias("theme"), F.col(f"_{i}").alias("tf")) for i, r in enumerate(wanted)])
    found = counts.select("passage_id", "n_words", F.inline_outer(each)).filter(F.col("tf").isNotNull())
    same = Window.partitionBy("passage_id", "theme")
    met = found.repartition(tasks, "passage_id").withColumn("_n", F.count("*").over(same)).filter(F.col("tf") > 0)
    return met.select("theme", "passage_id", "n_words", "tf", F.explode(F.sequence(F.lit(1), F.col("_n").cast("int")))).drop("col")


def _looked_up(passage_rows: DataFrame, wanted: DataFrame, tasks: int) -> DataFrame:
    """The same rows for any number of phrases: distinct words of passages meet those of the phrases."""
    vocabulary = unnest(passage_rows, F.array_distinct(T.extract_all(F.lower("passage"), WORD)), "word", "passage_id")
    candidates = vocabulary.join(wanted, "word").select("theme", "surface", "passage_id")
    pattern = F.concat(F.lit(r"(?U)\b\Q"), F.col("surface"), F.lit(r"\E\b"))
    texts = passage_rows.select("passage_id", "n_words", "passage").repartition(tasks, "passage_id")
    counted = candidates.repartition(tasks, "passage_id").join(texts.hint("merge"), "passage_id").select(
        "theme", "passage_id", "n_words", F.regexp_count(F.lower("passage"), pattern).alias("tf"))
    return counted.filter(F.col("tf") > 0)


def theme_scores(passage_rows: DataFrame, themes: DataFrame) -> DataFrame:
    """BM25 score of every passage that holds a theme phrase.

    passage_rows: passage_id, passage, n_words.  themes: theme.  The phrase is
    the query term.  Up to SCANNED phrases, each passage is searched for all of them where
    it is read.  Beyond, the distinct words of each passage meet the longest word
    of each phrase in a hash join that moves ids only; the candidates are then
    joined to their passages, where the phrase is counted.  The hits are written
    once, because the document frequency and the score both read them.  Up to FEW phrases and
    their frequencies are broadcast, so that neither words nor hits travel to meet them: a word
    that most passages hold would do so in one task, and so would the hits of a theme.  Passages are dealt out by their words, not by how far they pack.
    """
    wanted = stage(themes.select("theme").distinct()
                   .withColumn("surface", name_surface(F.col("theme"))).filter(F.col("surface") != "")
                   .withColumn("word", anchor_word(T.extract_all(F.col("surface"), WORD))))
    stats = passage_rows.agg(F.struct(F.avg("n_words").alias("avg_words"), F.count("*").alias("n")).alias("s")).scalar()
    tasks = (passage_rows.agg(F.sum(F.col("n_words").cast("bigint"))).first()[0] or 0) // WORDS_A_TASK + 1
    if 0 < wanted.count() <= min(SCANNED, FEW):
        hits = stage(_scanned(passage_rows, wanted.collect(), tasks))
    else:
        hits = stage(_looked_up(passage_rows, few(wanted), tasks))
    df = few(stage(hits.groupBy("theme").agg(F.count("*").alias("df"))))
    scored = hits.join(df, "theme").withColumn("_s", stats)
    n, avg = F.col("_s.n"), F.col("_s.avg_words")
    idf = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    tf = F.col("tf")
    score = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("n_words") / avg))
    return scored.select("theme", "passage_id", "tf", score.alias("score"))


def top_passages(passage_rows: DataFrame, themes: DataFrame, k: int = 5) -> DataFrame:
    """Best ``k`` passages per theme; a hit holds a word, so no passage is blank.

    Only ids and scores are ranked; titles and texts are joined to the winners.
    """
    order = [F.round("score", 9).desc(), F.col("passage_id").asc()]
    best = few(stage(top_k(theme_scores(passage_rows, themes), ["theme"], order, k)))
    return best.join(passage_rows, "passage_id")


def snippets(top: DataFrame, excerpt: int = 1500) -> DataFrame:
    """Title, url, excerpt, type and score of each retrieved passage."""
    return top.select("theme", "position", "title", "url",
                      F.substring("passage", 1, excerpt).alias("excerpt"),
                      F.lit("DOCUMENT").alias("type"), "score")
