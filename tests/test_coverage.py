"""Heavy keys, and regulations that concern several portfolios."""

import pytest
from pyspark.sql import functions as F

from tidewarden.operators import joins as J, mentions as M
from tidewarden.plans import impact as I
from tidewarden.sources.stage import stage


def collected(df):
    return sorted(map(repr, map(tuple, df.select(sorted(df.columns)).collect())))


@pytest.fixture(scope="module")
def sides(spark):
    left = spark.sql("SELECT IF(id < 300, 'hot', 'k' || id % 40) AS k, 1 AS j, id % 7 AS v FROM range(420) "
                     "UNION ALL SELECT NULL, 1, 5 UNION ALL SELECT 'alone', 1, 6")
    right = spark.sql("SELECT IF(id < 130, 'hot', 'k' || id % 50) AS k, 1 AS j, id % 5 AS w FROM range(200) "
                      "UNION ALL SELECT NULL, 1, 5")
    return stage(left), stage(right)


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
@pytest.mark.parametrize("limit", [50, 10_000])
def test_split_join_is_the_plain_join(sides, how, limit):
    left, right = sides
    assert collected(J.split_join(left, right, ["k", "j"], how, limit)) == collected(left.join(right, ["k", "j"], how))


def test_pieces_of_heavy_keys(sides):
    left, right = sides
    assert [tuple(r) for r in J.heavy_keys(left, right, ["k"], 50, True).collect()] == [("hot", 6, 3)]
    assert [tuple(r) for r in J.heavy_keys(left, right, ["k"], 50, False).collect()] == [("hot", 6, 1)]
    joined = J.split_join(left, right, ["k"], limit=50)
    assert "_l" in joined._jdf.queryExecution().analyzed().toString() and joined.columns.count("j") == 2
    with pytest.raises(ValueError):
        J.split_join(left, right, ["k"], "full")


def test_no_piece_has_more_than_its_share(spark):
    """One supplier, theme and region held by most rows: rows of a key and piece stay near the limit."""
    held = stage(spark.sql("SELECT 'B' AS portfolio_id, 'S' || id AS symbol, IF(id % 10 < 9, 'Tech', 'Energy') AS risk_theme FROM range(5000)"))
    themes = stage(spark.sql("SELECT 'R' || id AS reg_id, 'B' AS portfolio_id, 'Tech' AS risk_theme FROM range(3)"))
    heavy = J.heavy_keys(held, themes, ["portfolio_id", "risk_theme"], 500, True).collect()
    assert [tuple(r) for r in heavy] == [("B", "Tech", 9, 1)]
    out = M.theme_hits(themes, held, 500)
    assert out.count() == 3 * 4500
    dealt = held.filter("risk_theme = 'Tech'").groupBy(F.pmod(F.monotonically_increasing_id(), F.lit(9))).count()
    assert max(r["count"] for r in dealt.collect()) <= 1.1 * 500
    exposure = held.selectExpr("portfolio_id", "symbol", "risk_theme AS region", "1d AS share")
    regions = themes.withColumnRenamed("risk_theme", "region")
    assert collected(M.region_hits(regions, stage(exposure), 500)) == collected(exposure.join(regions, ["portfolio_id", "region"]))


TEXT = ("The Inflation Reduction Act concerns AAA1 and Bigco Capital. Deliveries of Vaaab Corp are reviewed. Sanctions and "
        "tariffs hit imports from China and Taiwan; a minimum tax applies on 2027-01-01.")


def inputs(spark, books):
    holdings = spark.range(books * 3).selectExpr(
        "'B' || id % {0} AS portfolio_id, 'AAA' || id AS symbol".format(books).split(", ")[0],
        "'AAA' || id AS symbol", "IF(id % 5 = 1, 'Bigco Capital', 'Other Software ' || id) AS company",
        "1.5D AS weight", "CAST(id + 1 AS int) AS rank", "1e9D AS market_cap")
    filings = spark.range(books * 3).filter("id % 2 = 0").selectExpr(
        "'AAA' || id AS ticker", "'a_10-k_.txt' AS name",
        "'Supply chain\nKey suppliers include Vaaab Corp, Vaaac China Corp and others.\nGeographic information\nChina had 40% of sales.' AS text")
    docs = spark.createDataFrame([("R1", "r1.txt", "txt", TEXT), ("R2", "r2.txt", "txt", "Nothing here."), ("R3", "r3.txt", "txt", None)],
                                 "reg_id string, name string, ext string, text string")
    return holdings, filings, docs


def test_a_regulation_of_many_books_is_extracted_once(spark, monkeypatch):
    books = 200
    holdings, filings, docs = inputs(spark, books)
    coverage = spark.range(books).selectExpr("'R1' AS reg_id", "'B' || id AS portfolio_id").unionByName(
        spark.createDataFrame([("R2", "B1"), ("R2", "B1"), ("R3", "B2"), ("R1", "none"), (None, "B1")], "reg_id string, portfolio_id string"))
    written = []

    def noted(df):
        out = stage(df)
        written.append((df.columns, out.count()))
        return out

    monkeypatch.setattr(I, "stage", noted)
    a = I.assess(holdings, docs, filings, coverage=coverage)
    assert [n for c, n in written if "entities" in c] == [3]
    got = a.scored.drop("risk_drivers")
    copies = docs.join(coverage.dropna().distinct(), "reg_id").select("portfolio_id", *docs.columns).withColumn(
        "reg_id", F.concat_ws("@", "reg_id", "portfolio_id"))
    want = I.assess(holdings, copies, filings).scored.drop("risk_drivers").withColumn("reg_id", F.split("reg_id", "@")[0])
    assert collected(got) == collected(want) and got.count() == books * 3 + 3 + 3
    assert got.filter("supply_chain_risk > 0").count() > 100 and got.filter("risk_score > 0.3").count() > 0
    assert {r.reg_id for r in a.regulations.select("reg_id").distinct().collect()} == {"R1", "R2", "R3"}
    assert "text" not in a.regulations.columns


def test_texts_meet_no_coverage(spark):
    holdings, filings, docs = inputs(spark, 4)
    coverage = spark.createDataFrame([("R1", f"B{i}") for i in range(4)], "reg_id string, portfolio_id string")
    hits = M.mentions(docs.select("reg_id", "text").na.fill(""), holdings, coverage)
    assert sorted((r.reg_id, r.symbol, r.symbol_hit, r.company_hit) for r in hits.collect()) == [
        ("R1", "AAA1", True, True), ("R1", "AAA11", False, True), ("R1", "AAA6", False, True)]


def test_without_coverage_nothing_is_scored(spark):
    holdings, filings, docs = inputs(spark, 4)
    none = spark.createDataFrame([], "reg_id string, portfolio_id string")
    assert I.assess(holdings, docs, filings, coverage=none).scored.count() == 0
