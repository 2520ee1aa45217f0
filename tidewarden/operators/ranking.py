"""Top-k per group.  ``row_number() <= k`` is cut on each task before the shuffle."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import numbers as N
from .portfolio import BOOK

IMPACT_COLUMNS = ["reg_id", "portfolio_id", "symbol", "company", "risk_score", "direct_risk",
                  "supply_chain_risk", "geographic_risk", "loss_pct", "loss"]


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, position: str = "position") -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(position, F.row_number().over(w)).filter(F.col(position) <= k)


def by_risk() -> list[Column]:
    """Highest risk first; ties go to the heavier holding.

    Scores that differ only in the last bits of a sum count as tied.
    """
    return [F.round("risk_score", 9).desc(), *heaviest()]


def heaviest() -> list[Column]:
    """Order of the holdings as loaded: by weight, then by the file's rank, then by symbol."""
    return [F.col("weight").desc(), F.col("rank").asc(), F.col("symbol").asc()]


def top_risks(scored: DataFrame, k: int = 15, keys: list[str] = BOOK) -> DataFrame:
    return top_k(scored, keys, by_risk(), k)


def top_losses(scored: DataFrame, k: int = 15, keys: list[str] = BOOK) -> DataFrame:
    return top_k(scored, keys, [F.col("loss").desc(), *heaviest()], k)


def top_impacted(scored: DataFrame, k: int = 10, keys: list[str] = BOOK) -> DataFrame:
    """Holdings with any risk, highest first, with those wanted columns that exist."""
    top = top_risks(scored.filter(F.col("risk_score") > 0), k, keys)
    return N.select_existing(top, [*IMPACT_COLUMNS, "position"])


def next_deadline(extracted: DataFrame) -> DataFrame:
    """First date string as the deadline, and the earliest mention that parses.

    Date strings sort as text, so the first is not always the earliest; both
    are given.
    """
    def parsed(d):
        plain = F.regexp_replace(F.regexp_replace(d, r"(?i)^through\s+", ""), r"(?i)^([a-z]{3})[a-z]*\.?", "$1")
        named = F.initcap(F.regexp_replace(plain, r"\s+", " "))
        return F.coalesce(
            F.try_to_date(d, "yyyy-MM-dd"), F.try_to_date(d, "M/d/yyyy"), F.try_to_date(named, "MMM d, yyyy"))

    return extracted.select(
        "reg_id", F.coalesce(F.get("dates", F.lit(0)), F.lit(None).cast("string")).alias("first_date"),
        F.array_min(F.transform("dates", parsed)).alias("next_deadline"))
