import random
import re

from tidewarden.operators import mentions as M


def regs(spark, texts):
    return spark.createDataFrame([(f"R{i}", "P", t) for i, t in enumerate(texts)],
                                 "reg_id string, portfolio_id string, text string")


def held(spark, rows, portfolio="P"):
    return spark.createDataFrame([(portfolio, s, c) for s, c in rows],
                                 "portfolio_id string, symbol string, company string")


def pairs(df):
    return sorted((r.reg_id, r.symbol) for r in df.collect())


def test_symbols_are_whole_words(spark):
    h = held(spark, [("AI", "x"), ("BRK.B", "x"), ("T", "x")])
    r = regs(spark, ["maintain", "buy ai now", "BRK.B rises, BRK B falls", "at&t"])
    assert pairs(M.symbol_mentions(r, h)) == [("R1", "AI"), ("R2", "BRK.B"), ("R3", "T")]


def test_company_names_may_end_in_punctuation(spark):
    h = held(spark, [("A", "Acme Inc."), ("B", "Big Blue"), ("C", "One Two Three Four Five Six Seven Eight Nine Co")])
    r = regs(spark, ["acme inc. pays", "ACME INC", "acme incorporated", "Big  Blue", "big blue-ish",
                     "see one two three four five six seven eight nine co, there"])
    assert pairs(M.company_mentions(r, h)) == [("R0", "A"), ("R1", "A"), ("R4", "B"), ("R5", "C")]


def test_mentions_stay_inside_the_portfolio(spark):
    h = held(spark, [("AA", "x")], "Q")
    assert pairs(M.symbol_mentions(regs(spark, ["aa"]), h)) == []


def test_mentions_equal_brute_force(spark):
    rng = random.Random(7)
    words = ["ab", "abc", "b", "corp", "x1", "a_b", "été"]
    names = list({" ".join(rng.choices(words, k=rng.randint(1, 6))) for _ in range(40)})
    texts = [rng.choice([" ", ", "]).join(rng.choices(words, k=30)) for _ in range(30)]
    h = held(spark, [(f"S{i}", n) for i, n in enumerate(names)])
    want = sorted((f"R{i}", f"S{j}") for i, t in enumerate(texts) for j, n in enumerate(names)
                  if re.search(r"\b" + re.escape(n) + r"\b", t.lower()))
    assert pairs(M.company_mentions(regs(spark, texts), h)) == want


def test_supplier_substrings_equal_brute_force(spark):
    rng = random.Random(3)
    words = ["Acme", "Ab", "China", "Corp", "Beta", "Chi"]
    names = list({" ".join(rng.choices(words, k=rng.randint(1, 3))) for _ in range(30)})
    names = [n for n in names if len(n) > 3]
    texts = ["".join(rng.choices([w.lower() for w in words] + [" ", " ", "."], k=40)) for _ in range(40)]
    sup = spark.createDataFrame([("P", f"S{i % 5}", n) for i, n in enumerate(names)],
                                "portfolio_id string, symbol string, supplier string")
    got = sorted((r.reg_id, r.supplier) for r in M.supplier_mentions(regs(spark, texts), sup).collect())
    assert got == sorted((f"R{i}", n) for i, t in enumerate(texts) for n in names if n.lower() in t)
    counts = {(r.reg_id, r.symbol): r.supplier_hits for r in M.supplier_counts(regs(spark, texts), sup).collect()}
    for i, t in enumerate(texts):
        for s in range(5):
            n = sum(x.lower() in t for k, x in enumerate(names) if k % 5 == s)
            assert counts.get((f"R{i}", f"S{s}"), 0) == n


def test_geo_pairs_count_every_place_and_supplier(spark):
    r = spark.createDataFrame([("R", "P", ["China", "CHINA", "US", "tech"])],
                              "reg_id string, portfolio_id string, entities array<string>")
    sup = spark.createDataFrame([("P", "S", "China Corp"), ("P", "S", "Industry Plus"), ("P", "T", "Beta")],
                                "portfolio_id string, symbol string, supplier string")
    got = {x.symbol: x.geo_pairs for x in M.supplier_geo_pairs(r, sup).collect()}
    # "Industry Plus" holds "us" twice, which is one containment.
    assert got == {"S": 2}


def test_region_aliases_are_optional(spark):
    from pyspark.sql import functions as F
    df = spark.createDataFrame([(["US", "European Union", "japan"],)], "e array<string>")
    assert df.select(M.hit_regions(F.col("e")).alias("r")).first().r == ["Europe"]
    alias = {"United States": ["US", "USA"]}
    assert df.select(M.hit_regions(F.col("e"), alias).alias("r")).first().r == ["United States", "Europe"]


def test_a_hot_book_and_a_hot_supplier_give_every_pair(spark):
    from tidewarden.plans import impact as I
    held = spark.createDataFrame([("P" if i % 3 else "Q", f"S{i}") for i in range(90)], "portfolio_id string, symbol string")
    held = held.selectExpr("*", "symbol company", "false _own_theme", "'x' risk_theme")
    feats = spark.createDataFrame([(f"R{i}", "P") for i in range(7)], "reg_id string, portfolio_id string")
    feats = feats.selectExpr("*", "cast(null as array<struct<theme: string, words: array<string>>>) company_rules")
    for salts in (1, 8):
        assert I.assessment_pairs(held, feats, salts).select("reg_id", "symbol").distinct().count() == 7 * 60
    sup = spark.createDataFrame([("P", f"S{i}", "Acme Corp") for i in range(60)],
                                "portfolio_id string, symbol string, supplier string")
    assert M.supplier_counts(regs(spark, ["by acme corp"] * 20), sup).count() == 20 * 60
