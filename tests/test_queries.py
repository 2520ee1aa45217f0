"""A cross-section of the registry against its SQL on the smallest tables, and plan checks."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from check import rows
from tidewarden.fixtures import TABLES, Inputs
from tidewarden.sources.stage import LARGE, stage

SF = "/root/testdata/sf0.001"
SAMPLE = ["holdings_load", "reg_docs_load", "reg_corpus", "config_overlay", "reg_extract", "filing_facts",
          "supplier_mentions", "base_risk", "blended_risk", "attention_zone", "reco_rotation",
          "reco_override", "chart_risk_weight", "passage_topk", "exposure_report"]


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, db, name):
    df = entry.queries()[name](spark, SF)
    res = db.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in res.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows(df.columns, df.collect()) == rows(columns, res.fetchall())


@pytest.mark.parametrize("name", ["filing_pick", "section_slice", "attribute_filter"])
def test_filings_of_every_company_are_read(spark, db, name):
    df = entry.queries()[name](spark, SF)
    mine = rows(df.columns, df.collect())
    res = db.execute(entry.oracle_sql()[name])
    assert mine == rows([d[0] for d in res.description], res.fetchall())
    orders = "orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)"
    count = {"filing_pick": "count(DISTINCT c_custkey)", "section_slice": "count(*)",
             "attribute_filter": "count(CASE WHEN o_orderkey % 4 <> 3 AND year(o_orderdate) = 1997 THEN 1 END)"}[name]
    assert len(mine) == db.execute(f"SELECT {count} FROM {orders}").fetchone()[0]


def test_tables_of_many_rows_are_not_broadcast(spark, tmp_path):
    """Customers and parts whose files lie far below the size up to which Spark broadcasts."""
    def plan(frame):
        return frame._jdf.queryExecution().executedPlan().toString()

    x = Inputs(spark, SF)
    for name in ("holdings", "filings", "regulation_docs"):
        assert "c_custkey" not in "".join(s.partition("FileScan")[2].partition("\n")[0] for s in plan(x[name]).split("BroadcastExchange")[1:])
    few = spark.range(10).withColumnRenamed("id", "k")
    large = stage(spark.range(2 * LARGE).select((F.col("id") % 10).alias("k"), F.lit("x").alias("v")))
    small = stage(spark.range(LARGE // 2).select((F.col("id") % 10).alias("k"), F.lit("x").alias("v")))
    far = spark.range(10 ** 9).select((F.col("id") % 10).alias("k"))
    assert "Broadcast" not in plan(far.join(large, "k")) and "Broadcast" in plan(far.join(small, "k"))


def test_every_query_has_sql():
    assert set(entry.QUERIES) == set(entry.oracle_queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["blended_risk", "supplier_geo_pairs", "passage_topk", "scenario_losses", "safe_themes"])
def test_plans_have_no_nested_loops(spark, name):
    plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_entry(spark):
    assert entry.entry(spark).count() > 0
