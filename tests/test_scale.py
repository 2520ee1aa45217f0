"""What travels, what is written and by how many tasks, where tables are large."""

import random
import re
from collections import Counter
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tidewarden.fixtures import FIXTURES, Inputs, plain
from tidewarden.functions import text as T
from tidewarden.operators import mentions as M, passages as P
from tidewarden.plans import impact as I, queries as Q
from tidewarden.sources import documents as SD
from tidewarden.sources.stage import LARGE, scratch, stage

SF = "/root/testdata/sf0.001"


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_orders_are_not_broadcast(spark):
    x = Inputs(spark, SF)
    for name in ("holdings", "fundamentals", "filings"):
        scans = [s.partition("FileScan")[2].partition("\n")[0] for s in plan(x[name]).split("BroadcastExchange")[1:]]
        assert "o_orderkey" not in "".join(scans)


def test_documents_are_written_by_tasks_in_proportion(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(SD, "WRITTEN", 5)
    docs = [(f"d{i}.txt", f"text {i}") for i in range(60)] + [("twice.txt", "one"), ("twice.txt", "two")]
    path = scratch(spark)
    SD.write_documents(spark.createDataFrame(docs, "name string, text string"), path)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path")
    assert len({r.path.rsplit("/", 1)[1].split("-")[1] for r in files.collect()}) > 4
    got = SD.read_regulations(spark, path, F.regexp_extract("path", "name=([^/]+)/", 1))
    assert {(r.name, r.ext, tuple(sorted(r.text.split("\n")[:-1]))) for r in got.collect()} == {
        *((n, "txt", (t,)) for n, t in docs[:60]), ("twice.txt", "txt", ("one", "two"))}


def test_words_of_passages_do_not_travel(spark, monkeypatch):
    """A word that every passage holds would be met in one task, and texts that pack well sorted in few."""
    plans, keep = [], P.stage
    monkeypatch.setattr(P, "stage", lambda df: plans.append(plan(df)) or keep(df))
    rows = P.with_word_counts(spark.createDataFrame(
        [(i, f"the tax of {i} " + "the supply chain " * (i % 3)) for i in range(50)], "passage_id bigint, passage string"))
    themes = spark.createDataFrame([("tax",), ("supply chain",), ("the",)], "theme string")
    want = Counter((r.theme, r.passage_id, r.tf, round(r.score, 9)) for r in P.theme_scores(rows, themes).collect())
    assert not any("hashpartitioning(word" in p for p in plans)
    monkeypatch.setattr(P, "WORDS_A_TASK", 40)
    got = Counter((r.theme, r.passage_id, r.tf, round(r.score, 9)) for r in P.theme_scores(rows, themes).collect())
    assert got == want and any("hashpartitioning(passage_id#" in p and ", 9)" in p for p in plans)
    monkeypatch.setattr(P, "FEW", 0)
    assert Counter((r.theme, r.passage_id, r.tf, round(r.score, 9)) for r in P.theme_scores(rows, themes).collect()) == want
    assert P.top_passages(rows, themes, 7).count() == 21


@pytest.mark.parametrize("names", [0, 1 << 16])
def test_lines_of_other_filings_do_not_meet_parts(spark, monkeypatch, names):
    """Beyond NAMES the chosen ids met finished slots of all filings."""
    monkeypatch.setattr(I, "NAMES", names)
    x = Inputs(spark, SF)
    got = Q.facts(x)
    tree = plan(got)
    assert re.search(r"Join \[l_orderkey#\d+L?\], \[filing_id#\d+L?\], LeftSemi", tree)
    assert tree.rindex("LeftSemi") > re.search(r"Join \[pk#\d+L?\], \[p_partkey", tree).start()
    assert Counter(map(str, got.collect())) == Counter(map(str, I.chosen_facts(x["filings"]).collect()))
    ids = stage(x["filings"].filter("filing_id % 7 = 0").select("filing_id"))
    want = x["filings"].join(ids, "filing_id", "left_semi")
    assert Counter(x.filings_of(ids).collect()) == Counter(want.collect()) and want.count() > 100


def test_sales_are_written_once(spark):
    x = Inputs(spark, SF)
    for name in ("holdings", "fundamentals", "company_findings"):
        assert "/lineitem.parquet" not in plan(x[name])


def test_sales_are_those_of_the_sql(spark):
    lines = [(1, 10.0, 0.1), (1, 5.5, 0.0), (1, None, 0.1), (2, 7.25, None), (2, 7.25, None), (3, 1.0, 0.0), (None, 4.0, 0.0), (9, 1.0, 0.0)]
    orders = [(1, 100), (2, 100), (2, 100), (3, None), (4, 101), (None, 102)]
    given = {"lineitem": spark.createDataFrame(lines, "l_orderkey long, l_extendedprice double, l_discount double"),
             "orders": spark.createDataFrame(orders, "o_orderkey long, o_custkey long")}
    for name, table in given.items():
        table.createOrReplaceTempView(name)
    want = spark.sql(plain(FIXTURES["sales"]))
    got = Inputs(spark, SF, given)["sales"]
    assert got.dtypes == want.dtypes and Counter(got.collect()) == Counter(want.collect())
    assert {r.k: r.gross for r in got.collect()} == {100: Decimal("44.50"), None: Decimal("1.00")}


def test_sums_of_lines_are_exact_for_any_number(spark):
    """Sums of whole cents where a price has no more; the others by their decimals, as the SQL has them."""
    prices = [0.01, 0.1 + 0.2, 1.005, 2.675, -3.125, 99999.99, 1e7, 1e7 + 0.01, 123456789012.35, 9007199254740993.0, -0.0, 1e-9, None]
    discounts = [0.0, 0.07, 0.075, 0.29, 1.0, -0.5, 99.99, None]
    lines = [(i % 7, p, d) for i, (p, d) in enumerate((p, d) for p in prices for d in discounts)]
    given = {"lineitem": spark.createDataFrame([*lines, (None, 5.0, 0.1)], "l_orderkey long, l_extendedprice double, l_discount double"),
             "orders": spark.createDataFrame([(i, i % 3) for i in range(7)], "o_orderkey long, o_custkey long")}
    for name, table in given.items():
        table.createOrReplaceTempView(name)
    got = Inputs(spark, SF, given)["sales"]
    want = spark.sql(plain(FIXTURES["sales"]))
    assert got.dtypes == want.dtypes and Counter(got.collect()) == Counter(want.collect())
    sums = [s for s in plan(got).split("\n") if "keys=[l_orderkey" in s and "functions=[partial_sum" in s]
    assert sums and not any("decimal" in s for s in sums)


def test_filings_are_chosen_without_their_lines(spark, monkeypatch):
    """Lines of all filings met parts and suppliers and became slots only to choose a name."""
    plans, keep = [], I.stage
    monkeypatch.setattr(I, "stage", lambda df: plans.append(plan(df)) or keep(df))
    x = Inputs(spark, SF)
    want = Counter(map(str, I.chosen_facts(x["filings"]).collect()))
    del plans[:]
    assert Counter(map(str, I.chosen_facts(x["filings"], x.filings_of, x["filing_names"]).collect())) == want
    assert "p_partkey" not in plans[0] and "p_partkey" in plans[1] and len(plans) == 3


@pytest.mark.parametrize("names", [0, 1 << 16])
def test_a_name_without_a_filing_is_not_chosen(spark, monkeypatch, names):
    """The first filing by name of most companies has no known part; that of some has no line; some have no filing at all."""
    monkeypatch.setattr(I, "NAMES", names)
    x = Inputs(spark, SF)
    first = stage(x["filings"].groupBy("ticker").agg(F.min_by("filing_id", "name").alias("l_orderkey")))
    lines = x.table("lineitem").join(first.withColumn("bad", F.length("ticker") > 0), "l_orderkey", "left")
    lost = F.coalesce("bad", F.lit(False)) | (F.col("l_orderkey") % 5 == 0)
    lines = stage(lines.withColumn("l_partkey", F.when(lost, -1).otherwise(F.col("l_partkey"))).drop("bad", "ticker")
                  .filter("l_orderkey % 11 <> 3"))
    y = Inputs(spark, SF, {"lineitem": lines})
    names = y["filing_names"]
    assert names.join(y["filings"], "filing_id", "left_anti").count() > 50
    want = Counter(map(str, I.chosen_facts(y["filings"]).collect()))
    assert Counter(map(str, I.chosen_facts(y["filings"], y.filings_of, names).collect())) == want
    assert Counter(map(str, I.chosen_facts(y["filings"], names=names).collect())) == want and sum(want.values()) > 50


def test_names_of_filings_are_those_of_the_sql(spark):
    x = Inputs(spark, SF)
    for name in ("customer", "orders", "lineitem"):
        x.table(name).createOrReplaceTempView(name)
    spark.sql(plain(FIXTURES["books"])).createOrReplaceTempView("books")
    got = Counter(x["filing_names"].collect())
    assert got == Counter(spark.sql(plain(FIXTURES["filing_names"])).collect())
    assert not Counter(x["filings"].select("filing_id", "ticker", "name").collect()) - got


def test_documents_are_extracted_by_tasks_in_proportion(spark, monkeypatch):
    """Texts are small for the time they take: all went to one task."""
    monkeypatch.setattr(I, "DOCUMENTS", 7)
    x = Inputs(spark, SF)
    docs = x["regulation_docs"].unionByName(x["regulation_docs"]).unionByName(x["regulation_docs"])
    got = I.dealt(docs)
    assert Counter(got.collect()) == Counter(docs.collect())
    assert got.rdd.getNumPartitions() == docs.count() // 7 + 1 > 4


def test_texts_of_passages_do_not_travel_to_few_phrases(spark, monkeypatch):
    """All texts were dealt and sorted to meet their candidates, and their words were listed once more."""
    texts = ["The tax of a supply  chain, the TAX.", "supply chain and supply-chain; tax", "a tax_man taxes", "été d'Été, the tax été", "supply only",
             "a.b (c) a.b", "", "tax", "naïve tax\nin the supply chain"]
    ids = [*range(len(texts)), 0, 0, 7]
    rows = stage(P.with_word_counts(spark.createDataFrame([(i, texts[i]) for i in ids], "passage_id bigint, passage string")))
    themes = spark.createDataFrame([(t,) for t in ("tax", "Tax", "supply chain", " (tax) ", "été", "a.b", "b (c) a", "a.b (c) a.b", "no", "...", None)], "theme string")

    def hits():
        return Counter((r.theme, r.passage_id, r.tf, round(r.score, 9)) for r in P.theme_scores(rows, themes).collect())

    plans, keep = [], P.stage
    monkeypatch.setattr(P, "stage", lambda df: plans.append(plan(df)) or keep(df))
    got = hits()
    scanned = next(p for p in plans if "Window" in p)
    assert "Join" not in scanned and "Exchange" in scanned and "passage#" not in scanned.partition("Exchange")[0]
    monkeypatch.setattr(P, "SCANNED", 0)
    assert hits() == got and sum(got.values()) > 40
    monkeypatch.setattr(P, "FEW", 0)
    assert hits() == got


def test_hits_of_a_theme_are_cut_before_they_travel(spark):
    """Hits met the frequency of their theme in one task a theme, which then sorted all of them."""
    rows = stage(P.with_word_counts(spark.range(2 * LARGE).selectExpr("id AS passage_id", "'tax ' || id AS passage")))
    themes = spark.createDataFrame([("tax",), ("7",)], "theme string")
    assert "hashpartitioning(theme" not in plan(P.theme_scores(rows, themes))
    best = P.top_passages(rows, themes, 3).collect()
    assert sorted((r.theme, r.passage_id) for r in best) == [("7", 7), ("tax", 0), ("tax", 1), ("tax", 2)]


def test_words_are_counted_as_they_are_matched(spark):
    chance = random.Random(7)
    texts = ["".join(chance.choice("aZ09_ .,-\t\n\x00\x1c\x7f") for _ in range(chance.randrange(30))) for _ in range(300)]
    texts += ["".join(chance.choice("aé_ -́‍中٣") for _ in range(chance.randrange(20))) for _ in range(200)]
    texts += ["one two " * n for n in (T.BATCHED // 8, T.BATCHED // 8 + 1)] + [None, "", "", "x"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").repartition(3)
    n = df.select("t", T.word_count(F.col("t"), M.WORD).alias("n"), F.size(T.extract_all(F.col("t"), M.WORD)).alias("matched"))
    assert n.dtypes[1:] == [("n", "int"), ("matched", "int")] and not [r for r in n.collect() if r.n != r.matched]
    assert n.filter("n > 3").count() > 100


def test_filings_of_other_forms_are_not_cut(spark):
    """Texts of all forms were cut, counted and written, though snippets come from one."""
    filings = spark.createDataFrame([(1, "A", "10-K", 2020, "a", "u", "tax law"), (2, "A", "10-Q", 2020, "b", "u", "tax law"), (3, "A", None, 2020, "c", "u", "tax")],
                                    "filing_id bigint, ticker string, filing_type string, fiscal_year int, title string, url string, text string")
    assert [r.filing_id for r in Q.filing_passages({"filings": filings}).collect()] == [1]


def test_slots_are_not_dealt_by_company(spark):
    """Orders met slots first, so that rows of all slots travelled to meet their company."""
    tables = ("customer", "orders", "lineitem", "supplier", "nation", "part")
    x = Inputs(spark, SF)
    doubled = {t: x.table(t).unionByName(x.table(t).limit(40)) for t in ("customer", "orders")}
    y = Inputs(spark, SF, {"customer": stage(doubled["customer"]), "orders": stage(doubled["orders"])})
    for name in ("filings", "every_filing"):
        tree = plan(y[name])
        assert tree.rindex("[o_custkey#") > re.search(r"Join \[ok#\d+L?\], \[o_orderkey", tree).start()
        for t in tables:
            y.table(t).createOrReplaceTempView(t)
        for dep in ("books", "filing_lines", "filing_slots"):
            spark.sql(plain(FIXTURES[dep])).createOrReplaceTempView(dep)
        assert Counter(y[name].collect()) == Counter(spark.sql(plain(FIXTURES[name])).collect())
