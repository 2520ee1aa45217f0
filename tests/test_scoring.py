import pytest
from pyspark.sql import functions as F

from tidewarden.functions import scoring as S
from tidewarden.operators import portfolio as PF, ranges, ranking as RK, recommend as RC, datasets as D
from tidewarden.plans import impact as I

SCORED = ("reg_id string, portfolio_id string, symbol string, company string, rank int, weight double, "
          "market_cap double, risk_theme string, risk_score double, loss_pct double, loss double, risk_drivers string")


def scored(spark, rows):
    """rows: (symbol, weight, theme, risk)."""
    return spark.createDataFrame(
        [("R", "P", s, s + " Co", i + 1, w, 1e12, t, r, r * 5, r * 5e10, "d")
         for i, (s, w, t, r) in enumerate(rows)], SCORED)


def dates(spark, values):
    return spark.createDataFrame([("R", "P", values)], "reg_id string, portfolio_id string, dates array<string>")


@pytest.mark.parametrize("finding, expected", [(0.0, 0.5 * 0.45 + 0.4 * 0.30 + 0.2 * 0.25),
                                               (0.3, 0.5 * 0.40 + 0.4 * 0.25 + 0.2 * 0.20 + 0.3 * 0.15)])
def test_blend(spark, finding, expected):
    got = spark.range(1).select(S.blended_risk(F.lit(0.5), F.lit(0.4), F.lit(0.2), F.lit(finding)).alias("r")).first().r
    assert got == pytest.approx(expected)


def test_blend_weights_sum_to_one():
    from tidewarden import config as C
    assert sum(C.BLEND_RULES_ONLY.values()) == pytest.approx(1) == sum(C.BLEND_WITH_FINDING.values())


def test_bands(spark):
    df = spark.createDataFrame([(x,) for x in (0.0, 0.3, 0.35, 0.4, 0.6, 0.61, 1.0)], "r double")
    assert [r.b for r in df.select(S.risk_band(F.col("r")).alias("b")).collect()] == [
        "none", "low", "low", "medium", "medium", "high", "high"]


def test_weighted_risk_and_zero_weights(spark):
    assert PF.portfolio_risk(scored(spark, [("A", 3.0, "x", 0.2), ("B", 1.0, "x", 0.6)])).first().portfolio_risk \
        == pytest.approx(0.3)
    assert PF.portfolio_risk(scored(spark, [("A", 0.0, "x", 0.2), ("B", 0.0, "x", 0.6)])).first().portfolio_risk \
        == pytest.approx(0.4)


def test_summary_matches_its_parts(spark):
    df = scored(spark, [("A", 3.0, "x", 0.2), ("B", 1.0, "y", 0.6), ("C", 2.0, "y", 0.1)])
    s = PF.portfolio_summary(df).first()
    assert s.portfolio_risk == pytest.approx(PF.portfolio_risk(df).first().portfolio_risk)
    assert s.total_market_cap == 3e12 and [c.risk_theme for c in s.concentration] == ["x", "y"]
    assert sum(c.weight_exposure for c in s.concentration) == pytest.approx(6.0)


def test_sell_and_urgency_at_the_mark(spark):
    df = scored(spark, [("A", 1.0, "x", 0.75), ("B", 1.0, "x", 0.76), ("C", 1.0, "x", 0.61), ("D", 1.0, "x", 0.60)])
    rows = {r.ticker: (r.action, r.urgency, r.timeline) for r in RC.reduce_rows(df, dates(spark, [])).collect()}
    assert rows == {"A": ("SELL", "MEDIUM", "Court terme"), "B": ("SELL", "HIGH", "Court terme"),
                    "C": ("REDUCE", "MEDIUM", "Court terme")}


def test_hedge_takes_the_first_five_in_file_order(spark):
    df = scored(spark, [(f"S{i}", 1.0, "x", 0.36 + i / 100) for i in range(8)])
    assert [r.ticker for r in RC.hedge_rows(df).orderBy("position").collect()] == [f"S{i}" for i in range(5)]


def test_rotation_targets_other_safe_themes(spark):
    df = scored(spark, [("A", 40.0, "hot", 0.5), ("B", 10.0, "s1", 0.1), ("C", 10.0, "s2", 0.2),
                        ("D", 10.0, "s3", 0.25), ("E", 10.0, "s4", 0.29), ("F", 20.0, "mid", 0.30)])
    rows = RC.rotation_rows(df).collect()
    assert [(r.from_sector, r.target_sectors, r.trim_weight) for r in rows] == [("hot", ["s1", "s2", "s3"], 10.0)]
    assert rows[0].recommendation == "Réduire exposition hot de 10.00%"
    own = {r.risk_theme: r.target_sectors for r in RC.safe_themes(PF.theme_concentration(df)).collect()}
    assert own["s1"] == ["s2", "s3", "s4"]


def test_monitor_below_the_calm_mark(spark):
    assert RC.monitor_rows(scored(spark, [("A", 1.0, "x", 0.2)])).count() == 1
    assert RC.monitor_rows(scored(spark, [("A", 1.0, "x", 0.25)])).count() == 0


def test_ties_keep_file_order(spark):
    df = scored(spark, [("Z", 1.0, "x", 0.1 + 0.2), ("A", 1.0, "x", 0.3), ("M", 1.0, "x", 0.4)])
    assert [r.symbol for r in RK.top_risks(df, 3).orderBy("position").collect()] == ["M", "Z", "A"]


def test_histogram_upper_edge(spark):
    df = scored(spark, [("A", 1.0, "x", 1.0), ("B", 1.0, "x", 0.0), ("C", 1.0, "x", 0.04)])
    assert {r.bin: r.n for r in PF.histogram(df).collect()} == {25: 1, 1: 1, 2: 1}


def test_correlation_of_constant_and_of_one_metric(spark):
    df = scored(spark, [("A", 1.0, "x", 0.1), ("B", 1.0, "x", 0.2)])
    got = {(r.metric_a, r.metric_b): r.corr for r in PF.correlations(df).collect()}
    assert got[("risk_score", "loss_pct")] == pytest.approx(1) and got[("risk_score", "weight")] is None
    assert PF.correlations(df, wanted=["weight"]).count() == 0


@pytest.mark.parametrize("few", [1, 150, 10_000])
def test_quantiles_are_exact(spark, few):
    import numpy as np
    rng = np.random.default_rng(5)
    groups = {"a": rng.random(501), "b": np.repeat(0.3, 40), "c": np.array([2.0]),
              "d": np.concatenate([np.repeat(0.5, 300), rng.random(100) * 9])}
    df = spark.createDataFrame([(k, float(v)) for k, vs in groups.items() for v in vs], "k string, v double")
    got = {r.k: r for r in ranges.quantiles(df, ["k"], "v", {"q25": 0.25, "q50": 0.5, "q90": 0.9}, few).collect()}
    for k, vs in groups.items():
        for name, p in (("q25", 0.25), ("q50", 0.5), ("q90", 0.9)):
            assert got[k][name] == pytest.approx(float(np.quantile(vs, p)), abs=1e-12)


def test_an_outlier_leaves_no_range_with_most_values(spark):
    df = spark.sql("SELECT 'a' AS k, IF(id = 7, 1e15D, sqrt(id) / 1000) AS v FROM range(200000)")
    cut = df.join(ranges._splitters(df, ["k"], "v", 10_000), "k").withColumn("_b", ranges._range("v"))
    sizes = [r["count"] for r in cut.groupBy("_b").count().collect()]
    assert sum(sizes) == 200_000 and max(sizes) < 4 * 200_000 / (ranges.COARSE * ranges.FINE)
    edges = cut.groupBy("_b").agg(F.min("v").alias("lo"), F.max("v").alias("hi")).orderBy("_b").collect()
    assert all(a.hi < b.lo for a, b in zip(edges, edges[1:]))
    got = ranges.quantiles(df, ["k"], "v", {"q50": 0.5, "q99": 0.99}).first()
    import numpy as np
    vs = np.sqrt(np.arange(200_000.0)) / 1000
    vs[7] = 1e15
    assert (got.q50, got.q99) == pytest.approx((np.quantile(vs, 0.5), np.quantile(vs, 0.99)), rel=1e-12)


@pytest.mark.parametrize("clustered", [False, True])
def test_running_total_is_a_prefix_sum(spark, clustered):
    """Also where nearly all rows share the order or the key."""
    import random
    rnd = random.Random(2)
    rows = [(None if i % 31 == 0 else "k" if i % 5 else f"g{i % 3}", 7 if clustered else rnd.randrange(60), f"n{rnd.randrange(900)}", rnd.randrange(9))
            for i in range(3000)] + [("k", 10 ** 12, "far", 3), ("k", None, None, 4)]
    df = spark.createDataFrame(rows, "k string, o long, name string, v long").repartition(5)
    got = ranges.running_total(df, ["k"], ["o", "name"], "v", "t")
    assert got.columns == ["k", "o", "name", "v", "t"]
    low = lambda x: (x is not None, x)
    want = []
    for key in {r[0] for r in rows}:
        total = 0
        for r in sorted((r for r in rows if r[0] == key), key=lambda r: (low(r[1]), low(r[2]), r[3])):
            want.append((*r, total))
            total += r[3]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))


def test_running_total_spreads_one_order_value(spark):
    df = spark.sql("SELECT 'k' AS k, 1 AS o, id AS name, 1L AS v FROM range(40000)")
    written = []
    plain = ranges.stage
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small partitions would be read as one
    try:
        ranges.stage = lambda d: written.append(plain(d)) or written[-1]
        ranges.running_total(df, ["k"], ["o", "name"], "v", "t")
    finally:
        ranges.stage = plain
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = [r["count"] for r in written[0].groupBy("_b").count().collect()]
    assert len(sizes) > 1 and max(sizes) < 40_000 / 2


def test_quantiles_leave_out_nan_and_null(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", float("nan")), ("a", None), ("a", 3.0)], "k string, v double")
    assert ranges.quantiles(df, ["k"], "v", {"q50": 0.5}).collect()[0].q50 == 2.0


def test_hedge_takes_the_heaviest(spark):
    rows = [("r", "p", f"S{i}", 10 - i, float(i), 0.5, 5.0) for i in range(8)]
    df = spark.createDataFrame(rows, "reg_id string, portfolio_id string, symbol string, rank int, weight double, "
                                     "risk_score double, loss_pct double").withColumn("company", F.col("symbol"))
    got = RC.hedge_rows(df).orderBy("position").collect()
    assert [r.ticker for r in got] == ["S7", "S6", "S5", "S4", "S3"]


def test_deadline(spark):
    from datetime import date
    df = dates(spark, ["09/30/2031", "2040", "Sept. 1, 2028", "Sep. 2, 2027", "through December 31, 2029"])
    row = RK.next_deadline(df).first()
    assert row.first_date == "09/30/2031" and row.next_deadline == date(2027, 9, 2)


def test_overrides_and_default_record(spark):
    rules = spark.createDataFrame([("R1", "P", "HEDGE"), ("R2", "P", "HEDGE"), ("R3", "P", "HEDGE"), ("R4", "P", "HEDGE")],
                                  "reg_id string, portfolio_id string, action string")
    supplied = spark.createDataFrame([("R1", "P", '{"action": "SELL"}'), ("R2", "P", '[{"action": "A"}, {"action": "B"}]'),
                                      ("R3", "P", "oops")], "reg_id string, portfolio_id string, reply string")
    got = sorted((r.reg_id, r.action) for r in RC.override_rules(rules, supplied).collect())
    assert got == [("R1", "SELL"), ("R2", "A"), ("R2", "B"), ("R3", "MONITOR"), ("R4", "HEDGE")]


def test_datasets_follow_the_columns(spark):
    df = scored(spark, [("A", 1.0, "x", 0.1), ("B", 2.0, "y", 0.8)])
    sets = D.all_datasets(df, PF.theme_concentration(df), dates(spark, ["2030", "2031"]))
    assert "components" not in sets and "geography" not in sets
    assert [(r.date, r.event) for r in sets["timeline"].orderBy("date").collect()] == [
        ("2030", "Échéance 1"), ("2031", "Échéance 2")]
    assert sets["top_risks"].filter("tier = 'critical'").count() == 1


def test_assessment_end_to_end(spark):
    held = spark.createDataFrame(
        [("P", "ACM", "Acme Software", 1, 60.0, 1e9), ("P", "OIL", "Deep Oil", 2, 40.0, None), ("Q", "ACM", "Acme Software", 1, 100.0, 1e9)],
        "portfolio_id string, symbol string, company string, rank int, weight double, market_cap double")
    docs = spark.createDataFrame(
        [("R", "P", "r.txt", "txt", "Sanctions on China: ACM and Acme Software buy from Foxconn Corp. Compliance by 2030.")],
        "reg_id string, portfolio_id string, name string, ext string, text string")
    filings = spark.createDataFrame(
        [("ACM", "10-k.txt", "Suppliers\nSuppliers include Foxconn Corp, China Parts and more.\nGeographic\nChina is 80% of sales."),
         ("ACM", "a.txt", "nothing")], "ticker string, name string, text string")
    findings = spark.createDataFrame([("R", "ACM", '{"impact_direct": 90, "impact_fournisseurs": 30}')],
                                     "reg_id string, symbol string, finding string")
    a = I.assess(held, docs, filings, findings).staged()
    rows = {r.symbol: r for r in a.scored.collect()}
    assert set(rows) == {"ACM", "OIL"} and {r.portfolio_id for r in rows.values()} == {"P"}
    acm, oil = rows["ACM"], rows["OIL"]
    # Sanctions, Compliance: intensity 0.10; mention 0.4 + 0.48; penalty 0.1; compliance 0.05; capped at 1.
    assert acm.direct_risk == pytest.approx(1.0)
    # "Foxconn Corp" is named; "China" lies inside "China Parts".
    assert acm.supply_chain_risk == pytest.approx(0.30)
    assert acm.geographic_risk == pytest.approx(0.40)
    assert acm.finding_risk == pytest.approx(0.4)
    assert acm.risk_score == pytest.approx(0.40 + 0.075 + 0.08 + 0.06)
    assert acm.risk_drivers == ("Impact direct élevé, Exposition supply chain (2 fournisseurs), "
                                "Exposition géographique (China)")
    assert oil.loss == 0.0 and oil.risk_theme == "Energy" and 0 <= oil.risk_score <= 1


def test_a_given_theme_is_kept(spark):
    held = spark.createDataFrame([("P", "S", "Oil Co", "Mine")], "portfolio_id string, symbol string, company string, risk_theme string")
    docs = spark.createDataFrame([("R", "P", "r", "txt", "tax")], "reg_id string, portfolio_id string, name string, ext string, text string")
    from tidewarden.operators.extract import extract_documents
    assert I.base_impact(held, extract_documents(docs)).first().risk_theme == "Mine"
    assert I.base_impact(held.limit(0), extract_documents(docs)).count() == 0
