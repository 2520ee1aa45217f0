"""Theme retrieval over filings and the report of exposed companies."""

from pyspark.sql import Column, DataFrame, functions as F

from .. import config as C
from ..functions.numbers import strip
from ..operators import mentions as M, passages as P
from ..operators.ranking import top_k


def report_themes(supplied: Column, text: Column, n: int | None = None) -> Column:
    """Non-blank supplied themes, the first ``n`` if given; else the fixed words found in the text."""
    given = F.filter(F.transform(F.coalesce(supplied, F.array().cast("array<string>")), strip), lambda t: t != "")
    given = given if n is None else F.slice(given, 1, n)
    low = F.lower(text)
    words = F.array_compact(F.array(*[F.when(F.contains(low, F.lit(w)), F.lit(w)) for w in C.REPORT_THEMES]))
    fallback = F.when(F.size(words) > 0, words).otherwise(F.array(F.lit(C.REPORT_DEFAULT_THEME)))
    return F.when(F.size(given) > 0, given).otherwise(fallback)


def retrieved(filters: dict | None = None, form: str = "10-K") -> Column:
    """The filings that snippets come from: those of one form, narrowed by the attribute filter."""
    return (F.col("filing_type") == form) & P.attribute_filter(filters)


def theme_snippets(passage_rows: DataFrame, themes: DataFrame, filters: dict | None = None,
                   form: str = "10-K") -> DataFrame:
    """Snippets retrieved from filings of one form, narrowed by the attribute filter.

    A theme without any hit gets one row with an error text and does not
    disturb the others.
    """
    found = P.snippets(P.top_passages(passage_rows.filter(retrieved(filters, form)), themes))
    return (themes.select("theme").distinct().join(found, "theme", "left")
            .withColumn("error", F.when(F.col("position").isNull(), F.lit("no passage found"))))


def exposed_companies(snippets: DataFrame, companies: DataFrame, k: int = 5) -> DataFrame:
    """Companies named in the snippets, by total score; the best excerpt is the reason.

    snippets: reg_id, theme, position, excerpt, score.  companies: company (distinct).
    A snippet counts once per company and regulation even if several themes
    retrieved it.
    """
    texts = (snippets.filter(F.col("excerpt").isNotNull())
             .groupBy("reg_id", "url", "excerpt").agg(F.max("score").alias("score"))
             .withColumn("snippet", F.xxhash64("url", "excerpt")))
    names = companies.select("company").distinct().withColumn("surface", M.name_surface(F.col("company")))
    distinct = texts.select("snippet", F.col("excerpt").alias("text")).distinct()
    hits = M.text_mentions(distinct, names, "snippet", "company", [])
    evidence = texts.join(hits, "snippet").groupBy("reg_id", "company").agg(
        F.sum("score").alias("total_score"), F.count("*").alias("n_snippets"),
        F.min(F.struct((-F.round("score", 9)).alias("s"), "url", "excerpt"))["excerpt"].alias("exposure_reason"))
    return top_k(evidence, ["reg_id"], [F.round("total_score", 9).desc(), F.col("company").asc()], k)


def exposure_report(regs: DataFrame, exposed: DataFrame, snapshot: DataFrame | None = None) -> DataFrame:
    """One JSON body per request; a request without text answers an error record.

    exposed holds at most five rows per regulation, so nesting them is small.
    """
    row = F.struct("position", "company", "exposure_reason")
    lists = exposed.groupBy("reg_id").agg(F.transform(
        F.sort_array(F.collect_list(row)),
        lambda r: F.struct(r["company"].alias("company"), r["exposure_reason"].alias("exposure_reason")))
        .alias("companies"))
    joined = regs.select("reg_id", "text").join(lists, "reg_id", "left")
    companies = F.coalesce("companies", F.array().cast(
        "array<struct<company: string, exposure_reason: string>>"))
    body = [companies.alias("companies")]
    if snapshot is not None:
        body.append(snapshot.select(F.struct(
            F.col("n_holdings").alias("count"), "total_market_cap", "sample").alias("m")).scalar()
            .alias("market_data"))
    missing = F.col("text").isNull() | (F.col("text") == "")
    return joined.select(
        "reg_id",
        F.when(missing, F.lit(400)).otherwise(F.lit(200)).alias("status_code"),
        F.when(missing, F.to_json(F.struct(F.lit("Missing regulation_text").alias("error"))))
        .otherwise(F.to_json(F.struct(*body))).alias("body"))
