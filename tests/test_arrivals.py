"""Scores of arriving documents, and the layout of the filings table."""

import re

import pytest

from tidewarden.operators import passages as P
from tidewarden.plans import impact as I
from tidewarden.sources import filing_store as FS, stage as ST
from tidewarden.streaming.scores import read_scores, score_stream

DOCS = "reg_id string, portfolio_id string, name string, ext string, text string"
TEXTS = ["A tax on AAA by 2030 hits China.", "Sanctions and tariffs on Beta Corp by 2031.", "<p>A penalty for banks in Europe</p>", None]


def docs(spark, numbers):
    return spark.createDataFrame([(f"R{k}", "P", f"d{k}", "html", TEXTS[k % 4]) for k in numbers], DOCS)


@pytest.fixture
def tables(spark):
    held = spark.createDataFrame([("P", "AAA", "Alpha Bank", 5.0, 1, 1e9), ("P", "BBB", "Beta Corp", 3.0, 2, 2e9)],
                                 "portfolio_id string, symbol string, company string, weight double, rank int, market_cap double")
    filings = spark.createDataFrame([("AAA", "10-K.txt", "Suppliers\nVaaab Corp\nGeographic\nChina 40%")],
                                    "ticker string, name string, text string")
    return ST.stage(held), ST.stage(I.chosen_facts(filings))


def plain(df):
    return sorted(map(repr, map(tuple, df.drop("batch").collect())))


def run(spark, src, tables, out, checkpoint):
    stream = spark.readStream.schema(DOCS).option("maxFilesPerTrigger", 1).parquet(src)
    query = score_stream(stream, *tables, out, checkpoint)
    query.awaitTermination(300)
    assert query.exception() is None


def test_a_restarted_stream_equals_the_batch(spark, tables, tmp_path, monkeypatch):
    src, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "ck"))
    docs(spark, range(2)).coalesce(1).write.parquet(src)
    docs(spark, range(2, 4)).coalesce(1).write.mode("append").parquet(src)
    # The first run dies in its second batch, after that batch has written.
    left, whole = set(ST._written), I.full_impact
    seen = []

    def failing(*args, **more):
        scored = whole(*args, **more)
        seen.append(1)
        if len(seen) == 2:
            scored.write.mode("overwrite").parquet(f"{out}/batch=1")
            raise RuntimeError("lost")
        return scored
    monkeypatch.setattr(I, "full_impact", failing)
    with pytest.raises(Exception):
        run(spark, src, tables, out, checkpoint)
    monkeypatch.setattr(I, "full_impact", whole)
    run(spark, src, tables, out, checkpoint)
    docs(spark, range(4, 6)).coalesce(1).write.mode("append").parquet(src)
    run(spark, src, tables, out, checkpoint)
    assert set(ST._written) == left
    got = read_scores(spark, out)
    assert got.select("batch").distinct().count() == 3
    regs = I.E.extract_documents(docs(spark, range(6)))
    assert plain(got) == plain(I.full_impact(tables[0], ST.stage(regs), tables[1])) and got.count() == 12


def test_the_store_prunes_folders_and_joins_without_exchange(spark, tmp_path):
    rows = [(f"F{k}", f"T{k % 7}", "10-K" if k % 2 else "10-Q", 2020 + k % 3, "x" * k) for k in range(60)]
    filings = spark.createDataFrame(rows, "filing_id string, ticker string, filing_type string, fiscal_year int, text string")
    path = str(tmp_path / "filings")
    stored = FS.write_filings(filings, "stored_filings", path, 4)
    facts = FS.write_bucketed(filings.select("ticker").distinct(), "stored_facts", str(tmp_path / "facts"), buckets=4)
    wanted = P.attribute_filter({"filing_type": "10-K", "fiscal_year": 2021})
    want = sorted(r[0] for r in rows if r[2] == "10-K" and r[3] == 2021)
    for table in (stored, FS.open_filings(spark, "stored_filings", path), FS.open_filings(spark, "none", path)):
        found = table.filter(wanted)
        assert sorted(r.filing_id for r in found.collect()) == want
        plan = found._jdf.queryExecution().executedPlan().toString()
        folders = re.search(r"PartitionFilters: \[(.*?)\], ", plan).group(1)
        assert "fiscal_year" in folders and "filing_type" in folders
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = stored.filter(wanted).join(facts, "ticker")
        assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
        assert joined.count() == len(want)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE stored_filings")
        spark.sql("DROP TABLE stored_facts")


def test_a_bucket_stays_small_however_many_filings():
    for rows in (0, 1000, 10 ** 6, 50 * 10 ** 6):
        assert FS.buckets_for(rows) >= 8 and rows <= FS.buckets_for(rows) * FS.BUCKET_ROWS
    assert FS.buckets_for(1000) == 8
