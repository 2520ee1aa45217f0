"""Quality rules as a ledger of failure bits and measurements.

Measurements are taken once per document, in the scan and without a shuffle; every rule
sets one bit.  A policy is a named, versioned mask: applying one, or asking what a rule
alone removes, works on the bits and never looks at a text again.  Built-in functions
only; thresholds are compared in whole numbers.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: (name, condition of failure); the place in the list is the bit, so new rules go to the end.
RULES = [
    ("few_words", "n_words < 10"),
    ("repeated_words", "100 * n_repeat_words > 20 * n_words"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 20 * n_words"),
    ("symbols", "100 * n_symbols > 10 * n_words"),
    ("repeated_lines", "n_dup_lines > 1 AND 100 * n_dup_lines > 30 * n_lines"),
    ("capitals", "100 * n_capitals > 40 * word_chars"),
    ("exclamations", "100 * n_exclamations > 20 * n_words"),
]
#: The rules whose failure alone decides ``base_failed``.
BASE = ("few_words", "repeated_words")

#: Characters that separate words: blank and \\t to \\r.
_BLANKS = " \t\n\x0b\x0c\r"
_WINDOW = 5


@dataclass(frozen=True)
class Policy:
    """Rules that must not fail, by name; results carry ``name`` and ``version``."""

    name: str
    version: int
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(1 << bit(r) for r in self.rules)


POLICY = Policy("default", 1, tuple(name for name, _ in RULES))


def bit(rule: str) -> int:
    return [name for name, _ in RULES].index(rule)


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id and the measurements, all long.

    A null text has no words and no lines.  Repeated word windows are found by 64-bit
    hashes of words, so windows with equal hashes count as equal; texts without a repeated
    window never sort.
    """
    whole = F.coalesce(F.col(text_col), F.lit(""))
    first = docs.select(F.col(id_col).alias("doc_id"), whole.alias("whole"), F.btrim(whole, F.lit(_BLANKS)).alias("body"))
    cut = first.select("doc_id", "body",
                       F.when(F.col("body") == "", F.array().cast("array<string>"))
                       .otherwise(F.split("body", "[ \t-\r]+")).alias("words"),
                       F.filter(F.split("whole", "\n"), lambda x: F.btrim(x, F.lit(_BLANKS)) != "").alias("lines"))
    size = F.size("words")
    counted = cut.select(
        "doc_id", size.cast("long").alias("n_words"), F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("body", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.regexp_count("body", F.lit("[A-ZÀ-ÖØ-Þ]")).cast("long").alias("n_capitals"),
        F.regexp_count("body", F.lit("!")).cast("long").alias("n_exclamations"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("h"))
    window = F.when(F.size("h") >= _WINDOW, F.transform(
        F.sequence(F.lit(0), F.size("h") - _WINDOW),
        lambda i: F.xxhash64(*[F.get("h", i + k) for k in range(_WINDOW)])))
    kept = [c for c in counted.columns if c != "h"]
    windows = counted.select(*kept, window.alias("w"))
    # Only texts with a repeated window go on: equal windows become neighbours.
    again = F.size(F.array_distinct("w")) < F.size("w")
    in_order = windows.select(*kept, F.when(again, F.array_sort(
        F.transform("w", lambda x, i: F.struct(x.alias("x"), i.alias("at"))))).alias("s"))
    twice = F.transform("s", lambda x, i: F.when(
        (F.get("s", i - 1)["x"] == x["x"]) | (F.get("s", i + 1)["x"] == x["x"]), x["at"]))
    places = in_order.select(*kept, F.array_sort(F.array_compact(twice)).alias("p"))
    covered = F.aggregate(
        F.transform("p", lambda x, i: F.least(F.lit(_WINDOW), F.coalesce(F.get("p", i + 1) - x, F.lit(_WINDOW)))),
        F.lit(0).cast("long"), lambda a, x: a + x)
    # Rows of a one-element array: no filter on what follows is pushed below the measurements, which would
    # write them out again in every condition.
    one = F.array(F.struct(*kept, F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words")))
    return places.select(F.inline_outer(one))


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The measurements and ``failed``: the bits of all rules that fail."""
    bits = [F.when(F.expr(rule), F.lit(1 << k)).otherwise(F.lit(0)).cast("long") for k, (_, rule) in enumerate(RULES)]
    failed = bits[0]
    for b in bits[1:]:
        failed = failed.bitwiseOR(b)
    return measured(docs, id_col, text_col).withColumn("failed", failed)


def fails(policy: Policy) -> Column:
    return F.col("failed").bitwiseAND(F.lit(policy.mask)) != 0


def judged(book: DataFrame, policy: Policy = POLICY) -> DataFrame:
    """A ledger with ``kept``, ``policy`` and ``version``."""
    return book.withColumns({"kept": ~fails(policy), "policy": F.lit(policy.name), "version": F.lit(policy.version)})


def ablation(book: DataFrame, policy: Policy = POLICY) -> DataFrame:
    """Per rule of a policy: documents that fail it, that only it removes, and kept without it.

    Documents are first counted by their bits: a handful of rows whatever the input.  An
    empty ledger gives zeros.
    """
    spark = book.sparkSession
    rules = spark.createDataFrame([(r, 1 << bit(r)) for r in policy.rules], "rule string, rule_bit long")
    masks = book.groupBy(F.col("failed").bitwiseAND(F.lit(policy.mask)).alias("bits")).agg(F.count("*").alias("n"))
    every = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(1 << bit(r)).cast("long").alias("b")) for r in policy.rules])
    each = masks.select("bits", "n", F.inline(every))
    hit = F.col("bits").bitwiseAND(F.col("b")) != 0
    alone = F.col("bits") == F.col("b")
    none = F.col("bits") == 0
    sums = each.groupBy("rule").agg(F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("failing"),
                                    F.sum(F.when(alone, F.col("n")).otherwise(0)).alias("only_this"),
                                    F.sum(F.when(none | alone, F.col("n")).otherwise(0)).alias("kept_without"))
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("failing", "only_this", "kept_without")]
    return rules.join(sums, "rule", "left").select("rule", *zero)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base columns, the verdict of the default policy, and the ledger it rests on."""
    book = judged(ledger(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")))
    base = Policy("base", 1, BASE)
    return book.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                       fails(base).alias("base_failed"), "kept", "failed", "n_lines", "n_capitals", "n_exclamations",
                       "policy", "version")


def ablation_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of the default policy removes, and what it alone removes."""
    return ablation(ledger(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")))


def ablation_oracle() -> str:
    rules = ", ".join(f"('{name}', {1 << k})" for k, (name, _) in enumerate(RULES))
    return f"""
    SELECT rule, CAST(count(*) FILTER (failed & b <> 0) AS BIGINT) AS failing,
           CAST(count(*) FILTER (failed = b) AS BIGINT) AS only_this,
           CAST(count(*) FILTER (failed = 0 OR failed = b) AS BIGINT) AS kept_without
    FROM (SELECT failed FROM ({oracle()})) AS book, (VALUES {rules}) AS r(rule, b) GROUP BY rule"""


def oracle() -> str:
    bits = " + ".join(f"CASE WHEN {rule} THEN {1 << k} ELSE 0 END" for k, (_, rule) in enumerate(RULES))
    base = sum(1 << bit(r) for r in BASE)
    return f"""
    WITH t AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS body FROM documents),
    cut AS (SELECT k, doc_id, body, regexp_extract_all(body, '[^\\x20\\x09-\\x0D]+') AS words,
              list_filter(string_split(body, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM t),
    word AS (SELECT k, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM cut),
    runs AS (SELECT k, i, w || ' ' || lead(w, 1) OVER o || ' ' || lead(w, 2) OVER o || ' ' || lead(w, 3) OVER o
              || ' ' || lead(w, 4) OVER o AS r FROM word WINDOW o AS (PARTITION BY k ORDER BY i)),
    twice AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, r) AS n FROM runs WHERE r IS NOT NULL) WHERE n > 1),
    covered AS (SELECT k, count(DISTINCT i + d) AS n FROM twice, range(5) AS u(d) GROUP BY k),
    m AS (SELECT doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
            len(regexp_extract_all(body, '[#*$%&|<>]')) AS n_symbols, len(lines) AS n_lines,
            len(lines) - len(list_distinct(lines)) AS n_dup_lines,
            len(regexp_extract_all(body, '[A-ZÀ-ÖØ-Þ]')) AS n_capitals, len(regexp_extract_all(body, '!')) AS n_exclamations,
            coalesce(n, 0) AS n_repeat_words FROM cut LEFT JOIN covered USING (k)),
    b AS (SELECT *, {bits} AS failed FROM m)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed & {base}) <> 0 AS base_failed,
           failed = 0 AS kept, failed, n_lines, n_capitals, n_exclamations,
           '{POLICY.name}' AS policy, {POLICY.version} AS version FROM b"""
