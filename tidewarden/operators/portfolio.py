"""Portfolio tables and their aggregates per regulation.

A scored portfolio is keyed by (reg_id, portfolio_id, symbol); aggregates are
keyed by (reg_id, portfolio_id).
"""

from pyspark.sql import Column, DataFrame, functions as F

from .. import config as C
from ..functions import numbers as N, scoring as S
from ..sources.tables import NUMERIC
from .ranges import quantiles

BOOK = ["reg_id", "portfolio_id"]


def merge_portfolio(holdings: DataFrame, fundamentals: DataFrame) -> DataFrame:
    """Left join on the symbol, margins, then 0 for missing numbers.

    Both sides are hash-partitioned on the symbol unless Spark measures one as
    small enough to broadcast.
    """
    joined = holdings.join(fundamentals.drop("company_name"), "symbol", "left")
    merged = joined.withColumns({
        "op_margin": N.ratio(F.col("op_income"), F.col("revenue")),
        "net_margin": N.ratio(F.col("net_income"), F.col("revenue")),
    })
    filled = merged.na.fill(0.0, ["weight", "price", *NUMERIC, "op_margin", "net_margin"])
    return N.ensure_columns(filled, {"risk_score": 0.0, "loss_pct": 0.0, "loss": 0.0})


def portfolio_risk(scored: DataFrame, keys: list[str] = BOOK) -> DataFrame:
    """Weight-weighted mean risk, plain mean where the weights sum to zero or less."""
    w = F.sum("weight")
    return scored.groupBy(*keys).agg(
        F.when(w > 0, F.sum(F.col("risk_score") * F.col("weight")) / w)
        .otherwise(F.avg("risk_score")).alias("portfolio_risk"))


def theme_concentration(scored: DataFrame, keys: list[str] = BOOK) -> DataFrame:
    """Weight, mean and largest risk, loss and count per theme."""
    return scored.groupBy(*keys, "risk_theme").agg(
        F.sum("weight").alias("weight_exposure"), F.avg("risk_score").alias("avg_risk"),
        F.max("risk_score").alias("max_risk"), F.sum("loss").alias("est_loss"),
        F.count("symbol").alias("n_holdings"))


def portfolio_summary(scored: DataFrame, keys: list[str] = BOOK) -> DataFrame:
    """Risk, capitalisation, loss and the nested concentration by theme.

    Built from theme subtotals, so the holdings are aggregated once and only
    one row per theme is nested.
    """
    themes = scored.groupBy(*keys, "risk_theme").agg(
        F.sum("weight").alias("weight_exposure"), F.avg("risk_score").alias("avg_risk"),
        F.max("risk_score").alias("max_risk"), F.sum("loss").alias("est_loss"),
        F.count("symbol").alias("n_holdings"), F.sum("market_cap").alias("_cap"),
        F.sum(F.col("risk_score") * F.col("weight")).alias("_rw"), F.sum("risk_score").alias("_r"))
    w = F.sum("weight_exposure")
    row = F.struct((-F.col("weight_exposure")).alias("_ord"), "risk_theme", "weight_exposure", "avg_risk",
                   "max_risk", "est_loss", "n_holdings")
    nested = F.transform(F.sort_array(F.collect_list(row)), lambda r: r.dropFields("_ord"))
    return themes.groupBy(*keys).agg(
        F.when(w > 0, F.sum("_rw") / w).otherwise(F.sum("_r") / F.sum("n_holdings")).alias("portfolio_risk"),
        F.sum("_cap").alias("total_market_cap"), F.sum("est_loss").alias("total_loss"),
        nested.alias("concentration"))


def kpis(scored: DataFrame, keys: list[str] = BOOK) -> DataFrame:
    return scored.groupBy(*keys).agg(
        F.avg("risk_score").alias("avg_risk"), F.sum("loss").alias("total_loss"),
        F.count_if(F.col("risk_score") > C.HIGH_RISK).alias("n_high_risk"))


def dominant_theme(concentration: DataFrame, keys: list[str] = BOOK) -> DataFrame:
    """Theme with the largest weight; the earlier name on a tie; Other when there is none."""
    top = F.min(F.struct((-F.col("weight_exposure")).alias("w"), "risk_theme"))["risk_theme"]
    return concentration.groupBy(*keys).agg(F.coalesce(top, F.lit(C.OTHER)).alias("dominant_theme"))


def risk_stats(scored: DataFrame, keys: list[str] = BOOK) -> DataFrame:
    means = scored.groupBy(*keys).agg(F.avg("risk_score").alias("mean_risk"))
    return means.join(quantiles(scored, keys, "risk_score", {"median_risk": 0.5}), keys)


def attention_zone(scored: DataFrame, keys: list[str] = BOOK) -> DataFrame:
    """Upper quartile of weight and risk, and the largest weight."""
    tops = scored.groupBy(*keys).agg(F.max("weight").alias("max_weight"))
    return (tops.join(quantiles(scored, keys, "weight", {"weight_q75": 0.75}), keys)
            .join(quantiles(scored, keys, "risk_score", {"risk_q75": 0.75}), keys))


def histogram(scored: DataFrame, keys: list[str] = BOOK, bins: int = C.HISTOGRAM_BINS) -> DataFrame:
    """Counts over equal bins of [0, 1]; a score of exactly 1 falls in the last bin."""
    slot = F.least(F.width_bucket("risk_score", F.lit(0.0), F.lit(1.0), F.lit(bins)), F.lit(bins))
    return (scored.groupBy(*keys, slot.cast("int").alias("bin")).agg(F.count("*").alias("n"))
            .withColumn("lower", (F.col("bin") - 1) / bins))


CORRELATED = ["risk_score", "direct_risk", "supply_chain_risk", "geographic_risk", "weight", "loss_pct"]


def correlations(scored: DataFrame, keys: list[str] = BOOK, wanted: list[str] = CORRELATED) -> DataFrame:
    """Pairwise Pearson correlations in long form; null for a constant metric.

    All pairs come out of one aggregation.  Fewer than two metrics give no rows.
    """
    cols = [c for c in wanted if c in scored.columns]
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]
    # A constant metric has no correlation; the range test is exact where the
    # running variance may leave a rounding residue.  ``corr`` itself raises on
    # a zero variance under ANSI rules.
    aggs = [F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)).alias(f"_c{i}")
            for i, (a, b) in enumerate(pairs)]
    spans = [(F.max(c) > F.min(c)).alias(f"_v_{c}") for c in cols]
    wide = scored.groupBy(*keys).agg(*spans, *aggs) if pairs else scored.groupBy(*keys).agg(*spans)
    rows = []
    for i, (a, b) in enumerate(pairs if len(cols) > 1 else []):
        value = F.when(F.col(f"_v_{a}") & F.col(f"_v_{b}"), F.col(f"_c{i}"))
        for x, y in {(a, b), (b, a)}:
            rows.append(F.struct(F.lit(x).alias("metric_a"), F.lit(y).alias("metric_b"), value.alias("corr")))
    shape = "array<struct<metric_a: string, metric_b: string, corr: double>>"
    return wide.select(*keys, F.inline(F.array(*rows) if rows else F.array().cast(shape)))


def market_snapshot(portfolio: DataFrame) -> DataFrame:
    """One row: number of holdings, capitalisation and the ten heaviest as a sample.

    The sample is cut by a top-k before it is nested.
    """
    sample = portfolio.orderBy(F.col("weight").desc(), "symbol").limit(10)
    head = sample.agg(F.transform(
        F.sort_array(F.collect_list(F.struct((-F.col("weight")).alias("_w"), "symbol", "company"))),
        lambda r: F.struct(r["symbol"].alias("symbol"), r["company"].alias("company"))).alias("s"))
    return portfolio.agg(
        F.count("*").alias("n_holdings"),
        F.coalesce(F.sum("market_cap"), F.lit(0.0)).alias("total_market_cap"),
    ).withColumn("sample", head.scalar())


def scenario_losses(scored: DataFrame, keys: list[str] = BOOK, scenarios=None) -> DataFrame:
    """Total loss in trillions under each scenario factor."""
    total = scored.groupBy(*keys).agg(F.sum("loss").alias("_total"))
    cases = F.array(*[F.struct(F.lit(n).alias("scenario"), F.lit(float(f)).alias("factor"))
                      for n, f in (scenarios or C.SCENARIOS)])
    return (total.select(*keys, "_total", F.inline(cases))
            .select(*keys, "scenario", (F.col("_total") / 1e12 * F.col("factor")).alias("loss_trillions")))


def risk_bands(scored: DataFrame) -> DataFrame:
    return scored.withColumn("band", S.risk_band(F.col("risk_score")))
