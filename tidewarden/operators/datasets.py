"""Chart-ready datasets."""

from pyspark.sql import DataFrame, functions as F

from .. import config as C
from ..functions import scoring as S
from .portfolio import BOOK, attention_zone, correlations, histogram, risk_stats
from .ranking import top_losses, top_risks
from .rows import unnest_fields, unnest_numbered


def risk_weight(scored: DataFrame) -> DataFrame:
    """Risk against weight with the mean risk and an attention-zone flag."""
    means = scored.groupBy(*BOOK).agg(F.avg("risk_score").alias("mean_risk"))
    return (scored.join(attention_zone(scored).join(means, BOOK), BOOK)
            .select(*BOOK, "symbol", "company", "risk_theme", "weight", "risk_score", "market_cap", "loss_pct",
                    "mean_risk",
                    ((F.col("weight") >= F.col("weight_q75")) & (F.col("risk_score") >= F.col("risk_q75")))
                    .alias("in_zone")))


def concentration_chart(concentration: DataFrame) -> DataFrame:
    return concentration.select(*BOOK, "risk_theme", "weight_exposure",
                                (F.col("avg_risk") * 100).alias("avg_risk_pct"))


def top_risks_chart(scored: DataFrame, n: int = 20) -> DataFrame:
    return top_risks(scored, n).select(
        *BOOK, "position", "symbol", "company", "risk_score", "risk_drivers",
        S.risk_tier(F.col("risk_score")).alias("tier"), F.lit(C.HIGH_RISK).alias("critical_line"))


def losses_chart(scored: DataFrame, n: int = 15) -> DataFrame:
    return top_losses(scored, n).select(
        *BOOK, "position", "symbol", "company", (F.col("loss") / 1e9).alias("loss_billions"), "loss_pct")


def components_chart(scored: DataFrame, n: int = 10) -> DataFrame:
    """Risk components of the riskiest holdings, one row per component."""
    return top_risks(scored, n).select(
        *BOOK, "position", "symbol", "direct_risk", "supply_chain_risk", "geographic_risk",
    ).unpivot([*BOOK, "position", "symbol"], ["direct_risk", "supply_chain_risk", "geographic_risk"],
              "component", "value")


def geography_chart(scored: DataFrame, facts: DataFrame, tickers: int = 10) -> DataFrame:
    """Exposure rows of the riskiest holdings, as many as asked."""
    top = top_risks(scored, tickers).select(*BOOK, "symbol")
    held = top.join(facts.select(F.col("ticker").alias("symbol"), "geographic_exposure"), "symbol")
    return (unnest_fields(held, "geographic_exposure", "region", *BOOK, "symbol")
            .withColumnRenamed("share", "exposure"))


def timeline_chart(extracted: DataFrame, n: int = 10) -> DataFrame:
    """The first ten dates with ordinal labels."""
    first = unnest_numbered(extracted, F.slice("dates", 1, n), "i", "date", "reg_id")
    return first.select("reg_id", "date",
                        S.template(C.TIMELINE_LABEL, (F.col("i") + 1).cast("string")).alias("event"))


def all_datasets(scored: DataFrame, concentration: DataFrame, extracted: DataFrame,
                 facts: DataFrame | None = None) -> dict[str, DataFrame]:
    """Every dataset as a lazy frame; the optional ones only if their columns exist."""
    out = {
        "risk_weight": risk_weight(scored), "concentration": concentration_chart(concentration),
        "top_risks": top_risks_chart(scored), "losses": losses_chart(scored),
        "distribution": histogram(scored), "distribution_lines": risk_stats(scored),
        "correlations": correlations(scored), "timeline": timeline_chart(extracted),
    }
    if {"direct_risk", "supply_chain_risk", "geographic_risk"} <= set(scored.columns):
        out["components"] = components_chart(scored)
    if facts is not None:
        out["geography"] = geography_chart(scored, facts)
    return out
