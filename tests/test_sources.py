import json

from pyspark.sql import functions as F

from tidewarden.functions import replies as R
from tidewarden.operators import passages as P, portfolio as PF
from tidewarden.plans import queries as Q, report as RP
from tidewarden.sources import documents as SD, facts as SF, tables as ST
from tidewarden.sources.stage import scratch, stage
from tidewarden.streaming.extraction import extract_stream


def test_csv_pair(spark, tmp_path):
    h = tmp_path / "h.csv"
    h.write_text('a,b,c,d,e\n1,"""Acme, Inc.""",ACM,"6,5","10,25"\n2,Beta,BET,"1,5",bad\n', encoding="utf-8")
    f = tmp_path / "f.csv"
    f.write_bytes("﻿Symbol,Company Name,Market Cap,Revenue,Op. Income,Net Income,EPS,FCF\n"
                  'ACM,  Acme ,"1,000,000",0,5,-,1.5,\n'.encode())
    held, fund = ST.read_holdings(spark, str(h)), ST.read_fundamentals(spark, str(f))
    assert [tuple(r) for r in ST.order_holdings(held).collect()] == [
        (1, "Acme, Inc.", "ACM", 6.5, 10.25), (2, "Beta", "BET", 1.5, None)]
    assert tuple(fund.first()) == ("ACM", "Acme", 1e6, 0.0, 5.0, 0.0, 1.5, 0.0)
    got = {r.symbol: r for r in PF.merge_portfolio(held, fund).collect()}
    assert got["ACM"].op_margin == 0.0 and got["BET"].market_cap == 0.0 and got["BET"].price == 0.0


def test_regulation_files(spark, tmp_path):
    (tmp_path / "a.v2.HTML").write_bytes(b"<p>caf\xc3\xa9 \xff\xfe ok</p>")
    (tmp_path / "noext").write_bytes(b"plain")
    got = {r.name: (r.ext, r.text) for r in SD.read_regulations(spark, str(tmp_path)).collect()}
    assert got == {"a.v2.HTML": ("HTML", "<p>café  ok</p>"), "noext": ("noext", "plain")}
    pasted = spark.createDataFrame([("typed",), ("  ",)], "text string")
    assert SD.add_pasted(SD.read_regulations(spark, str(tmp_path)), pasted).count() == 3


def test_filing_tree(spark, tmp_path):
    for ticker, files in {"AAPL": {"z 10K+x.txt": b"good", "a.txt": b"no"}, "MSFT": {"b.txt": b"b", "a.txt": b"first\xff"}}.items():
        (tmp_path / ticker).mkdir()
        for name, body in files.items():
            (tmp_path / ticker / name).write_bytes(body)
    got = {r.ticker: (r.name, r.text) for r in SD.read_filings(spark, str(tmp_path)).collect()}
    assert got == {"AAPL": ("z 10K+x.txt", "good"), "MSFT": ("a.txt", "first")}


def test_facts_roundtrip(spark):
    from tidewarden.operators.filings import filing_facts
    df = filing_facts(spark.createDataFrame([("T", "Geographic\nChina 5%")], "ticker string, text string"), ["ticker"])
    for fmt in ("json", "parquet"):
        path = scratch(spark)
        SF.write_facts(df, path, fmt)
        assert SF.read_facts(spark, path, fmt).select(sorted(df.columns)).collect() == df.select(sorted(df.columns)).collect()


def test_staging_uses_the_shared_folder(spark):
    path = scratch(spark)
    assert path.startswith(spark.conf.get("spark.checkpoint.dir"))
    plan = stage(spark.range(5).withColumn("x", F.rand()))._jdf.queryExecution().optimizedPlan().toString()
    assert "Range" not in plan


def test_replies(spark):
    cases = {
        'x ```json\n{"a": 1}\n``` y': '{"a": 1}', 'text {"a": {"b": 2}}': '{"a": {"b": 2}}', '{"a": 1} tail': '{"a": 1}',
        "nothing": None, "": "{}", 'bad {"a": [1} x': None, '{"a": 1} and {"b": 2}': None}
    df = spark.createDataFrame([(k,) for k in cases], "t string").select("t", R.reply_record(F.col("t")).alias("r"))
    for row in df.collect():
        assert row.r.json == cases[row.t], row.t
        assert (row.r.error is None) == (cases[row.t] is not None)


def test_finding_defaults(spark):
    df = spark.createDataFrame([("{",), (None,), ('{"impact_direct": 30}',)], "t string")
    got = [r.f for r in df.select(R.company_finding(F.col("t")).alias("f")).collect()]
    assert [f.impact_direct for f in got] == [0.0, 0.0, 30.0] and {f.action for f in got} == {"HOLD"}
    regs = [r.f for r in df.select(R.regulation_finding(F.col("t")).alias("f")).collect()]
    assert [f.severity for f in regs] == [0, 0, 5]
    sup = [r.f for r in df.select(R.supply_finding(F.col("t")).alias("f")).collect()]
    assert {f.risk_level for f in sup} == {"unknown"} and sup[0].affected_suppliers == []


def test_report_themes(spark):
    df = spark.createDataFrame([(["a", " ", "b ", "c", "d"], "x"), ([], "Tariffs and TAX"), (None, "x")], "g array<string>, t string")
    assert [r.r for r in df.select(RP.report_themes(F.col("g"), F.col("t")).alias("r")).collect()] == [
        ["a", "b", "c", "d"], ["tax", "tariffs"], ["regulatory risk"]]
    assert [r.r for r in df.select(RP.report_themes(F.col("g"), F.col("t"), 3).alias("r")).collect()] == [
        ["a", "b", "c"], ["tax", "tariffs"], ["regulatory risk"]]


def test_attribute_filter_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "f")
    spark.createDataFrame([("10-K", "A", 2020, "x")], "filing_type string, ticker string, fiscal_year int, text string") \
        .write.partitionBy("fiscal_year").parquet(path)
    df = spark.read.parquet(path).filter(P.attribute_filter({"ticker": "A", "fiscal_year": 2020, "filing_type": 5}))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert df.count() == 1 and "EqualTo(ticker,A)" in plan and "fiscal_year" in plan.split("PartitionFilters")[1]


def test_passage_scores_equal_bm25(spark):
    import math
    texts = ["tax on trade tax", "no hit here at all", "supply chain and tax", "taxes only"]
    rows = P.with_word_counts(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "passage_id bigint, passage string"))
    themes = spark.createDataFrame([("tax",), ("supply chain",)], "theme string")
    got = {(r.theme, r.passage_id): r.score for r in P.theme_scores(rows, themes).collect()}
    avg = sum(len(t.split()) for t in texts) / 4

    def bm25(tf, df, n):
        return math.log(1 + (4 - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / avg))
    want = {("tax", 0): bm25(2, 2, 4), ("tax", 2): bm25(1, 2, 4), ("supply chain", 2): bm25(1, 1, 4)}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_report_without_text_is_an_error(spark):
    regs = spark.createDataFrame([("R1", "t"), ("R2", "")], "reg_id string, text string")
    exposed = spark.createDataFrame([("R1", 1, "Acme", "why")], "reg_id string, position int, company string, exposure_reason string")
    got = {r.reg_id: (r.status_code, json.loads(r.body)) for r in RP.exposure_report(regs, exposed).collect()}
    assert got["R1"] == (200, {"companies": [{"company": "Acme", "exposure_reason": "why"}]})
    assert got["R2"] == (400, {"error": "Missing regulation_text"})


def test_a_theme_without_passages_does_not_fail_the_rest(spark):
    rows = P.with_word_counts(spark.createDataFrame(
        [(1, "10-K", "A", 2020, "t", "u", "tax law"), (2, "10-Q", "A", 2020, "t", "u", "tax")],
        "passage_id bigint, filing_type string, ticker string, fiscal_year int, title string, url string, passage string"))
    themes = spark.createDataFrame([("tax",), ("zzz",)], "theme string")
    got = {r.theme: (r.excerpt, r.error) for r in RP.theme_snippets(rows, themes).collect()}
    assert got == {"tax": ("tax law", None), "zzz": (None, "no passage found")}


def test_passages_of_a_long_filing_keep_their_own_text(spark):
    long = "".join(f"{'a' * 299} taxone{i} " for i in range(1300)) + "levy " * 70
    filings = spark.createDataFrame(
        [(1, "A", "10-K", 2020, "one", "u1", long), (2, "B", "10-K", 2020, "two", "u2", "word " * 12000 + "levy " * 10)],
        "filing_id bigint, ticker string, filing_type string, fiscal_year int, title string, url string, text string")
    rows = Q.filing_passages({"filings": filings})
    assert rows.count() == rows.select("passage_id").distinct().count() > 1400
    themes = spark.createDataFrame([("levy",)] + [(f"taxone{i}",) for i in range(1000, 1300, 50)], "theme string")
    got = RP.theme_snippets(rows, themes).collect()
    assert all(r.theme in r.excerpt for r in got)
    assert {(r.theme, r.title) for r in got} == {("levy", "one"), ("levy", "two")} | {(f"taxone{i}", "one") for i in range(1000, 1300, 50)}
    assert len(got) == len({(r.theme, r.title, r.position) for r in got})


def test_as_many_passages_as_asked_for(spark):
    rows = P.with_word_counts(spark.createDataFrame([(i, f"tax {i}") for i in range(40)], "passage_id bigint, passage string"))
    assert P.top_passages(rows, spark.createDataFrame([("tax",)], "theme string"), 25).count() == 25


def test_extraction_runs_on_a_stream(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "reg_id string, ext string, text string"
    spark.createDataFrame([("R", "html", "<p>tax by 2030</p>"), ("S", "xml", "<a>ai</a>")], schema).write.parquet(src)
    query = extract_stream(spark.readStream.schema(schema).parquet(src), out, str(tmp_path / "ck"))
    query.awaitTermination(120)
    got = {r.reg_id: (r.dates, r.type_reg) for r in spark.read.parquet(out).collect()}
    assert got == {"R": (["2030"], "Taxation / Economic"), "S": ([], "AI Promotion / Regulation")}


def test_filings_are_chosen_by_path_and_only_those_are_read(spark, tmp_path):
    for ticker, name, body in (("A B", "x [1]*.txt", "odd"), ("A B", "z_10-K.txt", "annual"), ("C+D", "q{2}?.txt", "odd too"),
                               ("E%20F", "only.txt", "percent"), ("G", "10k.txt", "marked"), ("G", "a.txt", "not read")):
        folder = tmp_path / ticker
        folder.mkdir(exist_ok=True)
        (folder / name).write_text(body)
    df = SD.read_filings(spark, str(tmp_path))
    assert sorted(map(tuple, df.collect())) == [("A B", "z_10-K.txt", "annual"), ("C+D", "q{2}?.txt", "odd too"),
                                                ("E%20F", "only.txt", "percent"), ("G", "10k.txt", "marked")]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan and len(df.inputFiles()) == 4


def test_filings_of_another_layout(spark, tmp_path):
    rows = [("T1", "a_10-k_.txt", "first"), ("T1", "b.txt", "second"), ("T2", "quarter.txt", "third")]
    path = str(tmp_path / "tree")
    spark.createDataFrame(rows, "ticker string, name string, text string").write.partitionBy("ticker", "name").text(path)
    part = lambda key: F.url_decode(F.regexp_extract("path", f"{key}=([^/]+)/", 1))
    got = SD.read_filings(spark, path, part("ticker"), part("name"))
    assert sorted((r.ticker, r.name, r.text.strip()) for r in got.collect()) == [("T1", "a_10-k_.txt", "first"), ("T2", "quarter.txt", "third")]
    (tmp_path / "none").mkdir()
    assert SD.read_filings(spark, str(tmp_path / "none")).count() == 0
