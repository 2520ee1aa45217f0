import re

import pytest
from pyspark.sql import functions as F

from tidewarden import config as C
from tidewarden.functions import sections as S
from tidewarden.operators import filings as FI


def cut(one, text, name, chars=3000):
    return one(lambda c: S.section(c, S.lowered(c), name, chars), text)


@pytest.mark.parametrize("text", [
    "Intro\nSupply Chain here\nmore", "supply chain first line\nrest", "none at all",
    "a\r\nmid SUPPLY CHAIN\rtail\nend", "\n\nsupply chain", "İ ſ\nx supply chain y\nz", "é\n😀 supply chain"])
def test_section_starts_at_the_line_break(one, text):
    match = re.search(r"(?:^|\n).*supply chain.*?(?:\n|$)", text, re.I | re.M)
    expected = text[match.start():match.start() + 20] if match else ""
    assert cut(one, text, "supply chain", 20) == expected


def facts(spark, text):
    df = spark.createDataFrame([("T", text)], "ticker string, text string")
    return FI.filing_facts(df, ["ticker"]).first()


def test_suppliers(spark):
    got = facts(spark, "Supply chain\nKey suppliers include Foxconn Corp, The Maker Ltd, Abc and others of note. "
                       "Parts are sourced from Delta Works each year.").suppliers
    assert "Foxconn Corp" in got and "Delta Works" in got
    assert "Abc" not in got and got == sorted(got)


def test_geography_rules(spark):
    text = ("Geographic information\nChina had 12% and later China 45% of sales. Japan is a market.\n"
            "Segment\nChina 30% by segment.\n")
    got = {e.region: e.share for e in facts(spark, text).geographic_exposure}
    # The first slice runs on through the second; the later slice wins with its own share.
    assert got["China"] == 30.0
    # A percentage counts only on the line of the mention.
    assert got["Japan"] == 0.0
    only = facts(spark, "Geographic\nIndia matters.").geographic_exposure
    assert [(e.region, e.share) for e in only] == [("India", 0.0)]


def test_geography_keeps_order_of_appearance(spark):
    text = "Segment\nTaiwan 5%.\n" + "x" * 9000 + "\nGeographic\nJapan 7%.\n"
    assert [e.region for e in facts(spark, text).geographic_exposure] == ["Japan", "Taiwan"]


def test_percentage_within_200_characters(spark):
    near = facts(spark, "Geographic\nChina " + "x" * 190 + " 33%").geographic_exposure
    far = facts(spark, "Geographic\nChina " + "x" * 230 + " 33%").geographic_exposure
    assert near[0].share == 33.0 and far[0].share == 0.0


def test_risk_factor_is_the_longest_sentence(spark):
    text = ("Risk factors\nShort law. New government regulation could raise costs in many of our markets abroad! "
            "A law that has no stop")
    got = facts(spark, text).risk_factors
    best = " New government regulation could raise costs in many of our markets abroad!..."
    # "raise" holds the stem "ai", which the technology theme looks for.
    assert got == ["Réglementaire: " + best, "Technologie: " + best]


def test_products_split_on_whole_and(spark):
    text = "Products and services\nOur products include brand names, steel rods and long sand castings."
    assert facts(spark, text).main_products == ["brand names", "long sand castings", "steel rods"]


def test_dependencies_customers_sites(spark):
    text = ("Our customers\nBig Store Inc and Omega buy.\nManufacturing\nPlants in Taiwan and South Korea.\n"
            "The plan depends on imported rare metals.")
    got = facts(spark, text)
    assert got.dependencies == ["imported rare metals"]
    assert "Big Store Inc" in got.key_customers
    assert got.manufacturing_locations == ["Korea", "Taiwan"]


def test_holding_without_filing_has_empty_facts(spark):
    held = spark.createDataFrame([("T",), ("U",)], "symbol string")
    df = FI.filing_facts(spark.createDataFrame([("T", "Customers\nAlpha Beta")], "ticker string, text string"), ["ticker"])
    got = {r.symbol: r for r in FI.attach_facts(held, df).collect()}
    assert got["U"].suppliers == [] and got["U"].geographic_exposure == []
    assert got["T"].key_customers


def test_exposure_rank(spark):
    df = spark.sql("""SELECT 'T' AS ticker, array(named_struct('region', 'Japan', 'share', 5d),
        named_struct('region', 'China', 'share', 40d), named_struct('region', 'India', 'share', 5d)) AS geographic_exposure""")
    got = [(r["rank"], r.region, r.share) for r in FI.exposure_rank(df, "ticker").orderBy("rank").collect()]
    assert got == [(1, "China", 40.0), (2, "India", 5.0), (3, "Japan", 5.0)]


LINES = ["PART I", "Item 1. Business", "The group makes things.", "Much depends on Ore and", "others, sold abroad. ", "Customers",
         "Big Store Inc buys.", "", "Risk Factors (continued)", "A law may change!", "Geographic areas\r", "China had 5% of sales.",
         "Supply chain", "lower case goes on.", "Supply chain"]


def index(spark, text):
    df = spark.createDataFrame([(1, text, "x")], "filing_id long, text string, heading string")
    return [(r.number, r.heading, text[r.start:r.end]) for r in FI.section_index(df, ["filing_id"]).orderBy("number").collect()]


def test_section_index(spark):
    text = "\n".join(LINES)
    got = index(spark, text)
    assert [h for _, h, _ in got] == ["PART I", "Customers", "Risk Factors (continued)", "Geographic areas", "Supply chain"]
    assert "\n".join(part for _, _, part in got) == text and [n for n, _, _ in got] == list(range(5))
    assert index(spark, "") == [(0, None, "")] and index(spark, "no heading, one line.") == [(0, None, "no heading, one line.")]
    assert [h for _, h, _ in index(spark, "😀 x.\nÉtats financiers\n2 Notes to the accounts\nEnd.")] == [None, "États financiers"]
    none = spark.createDataFrame([(1, None)], "filing_id long, text string")
    assert FI.section_index(none, ["filing_id"]).count() == 0


def test_a_section_is_every_heading_with_its_name_and_ends_at_the_next(spark):
    filler = "Nothing of note happened. " * 900  # beyond every window
    text = (f"Customers\n{filler}\nOthers are Far Away Stores Inc.\nOther matters\nHidden Name Ltd is no buyer.\n"
            f"Customers (continued)\nLate Buyer Inc came.\nManufacturing\n{filler}\nIt is in Taiwan.\nOther sites\nAnd in Mexico.")
    got = facts(spark, text)
    assert {"Far Away Stores Inc", "Late Buyer Inc"} <= set(got.key_customers) and "Hidden Name Ltd" not in got.key_customers
    assert got.manufacturing_locations == ["Taiwan"]


def test_limits_cut_and_default_does_not(spark):
    names = [f"Maker{chr(97 + i // 26)}{chr(97 + i % 26)} Corp" for i in range(45)]
    text = "Supply chain\n" + "".join(f"Key suppliers include {a}, {b} and {c} for parts.\n" for a, b, c in zip(names[::3], names[1::3], names[2::3]))
    text += "Risk factors\n" + "A new law on trade and " + "many other things, " * 30 + "may come."
    df = spark.createDataFrame([("T", text)], "ticker string, text string")
    whole, short = FI.filing_facts(df, ["ticker"]).first(), FI.filing_facts(df, ["ticker"], S.SHORT).first()
    assert set(names) <= set(whole.suppliers) and len(short.suppliers) == 30 and short.suppliers == whole.suppliers[:30]
    assert len(whole.risk_factors[0]) > 500 and len(short.risk_factors[0]) < 250
    window = FI.filing_facts(df, ["ticker"], S.Limits(windows={"supply chain": 60, "suppliers": 60})).first()
    assert len(window.suppliers) <= 4


def test_sentences_of_a_long_text_without_a_stop(spark, one):
    assert one(S.sentences, "One. Two! " + "x y " * 100_000) == ["One.", " Two!"]


def test_composed_filings_exceed_every_short_list(spark):
    from tidewarden.fixtures import Inputs

    filings = Inputs(spark, "/root/testdata/sf0.001")["filings"]
    long = filings.filter("length(text) > 30000").limit(3)
    whole, short = FI.filing_facts(long, ["filing_id"]).collect(), FI.filing_facts(long, ["filing_id"], S.SHORT).collect()
    assert whole
    for a, b in zip(sorted(whole, key=lambda r: r.filing_id), sorted(short, key=lambda r: r.filing_id)):
        for name, n in (("suppliers", 30), ("main_products", 20), ("dependencies", 15), ("key_customers", 10)):
            assert len(a[name]) > n >= len(b[name]), name
        assert max(map(len, a.risk_factors)) > 250
        assert {"Taiwan", "Singapore"} <= {e.region for e in a.geographic_exposure}


def test_segments_look_back_at_line_breaks_only():
    assert S._BOUNDARY.startswith(r"\n(?<=")


def test_rare_letters_are_folded(one):
    assert one(lambda c: S.lowered(c), "İſ ABC") == "is abc" and one(lambda c: S.lowered(c), "ABC Ä") == "abc ä"


def test_words_are_found_as_patterns_find_them(spark):
    """Plain searches stand for patterns that ignore case, also of the letters that fold to ASCII ones."""
    themes = {w: t for t, p in C.RISK_THEMES.items() for w in S._words(p)}
    for theme, pattern in C.RISK_THEMES.items():
        assert all(re.fullmatch(pattern, w) for w in S._words(pattern))
        assert len(S._words(pattern)) == pattern.count("|") + 1
    odd = str.maketrans("isk", "\u0130\u017f\u212a")
    for turn in (str.upper, str.title, lambda w: w.translate(odd), lambda w: w.replace("i", "\u0131")):
        text = "Risk factors\n" + " ".join(f"The year could bring {turn(w)} beyond what our group can bear, number {i}." for i, w in enumerate(themes))
        lines = facts(spark, text).risk_factors
        assert [x.split(":")[0] for x in lines] == list(C.RISK_THEMES)
    kept = facts(spark, "Key \u017fUPPL\u0130ERS are Vabc Corp, Ebc Ltd and more. DEPENDENT\u017f; dependent on imported metal and oil.")
    assert kept.suppliers == ["Ebc Ltd", "Vabc Corp"] and kept.dependencies == ["imported metal and oil"]
    every = C.SUPPLIER_PHRASES + C.PRODUCT_PHRASES + C.DEPENDENCY_PHRASES
    assert all(p.startswith(S._start(p)) and len(S._start(p)) > 2 for p in every)
