from html.parser import HTMLParser

from pyspark.sql import functions as F

from tidewarden.functions import lexicon as L, overrides as O, text as T
from tidewarden.operators import extract as E


def test_dates_give_the_whole_mention(one):
    text = "On September 30, 2027, 2024-05-01, 9/3/2025, fiscal year 2026, FY2028, through Dec. 31, 2029."
    found = one(T.date_mentions, text)
    assert {"September 30, 2027", "2024-05-01", "9/3/2025", "fiscal year 2026", "FY2028",
            "through Dec. 31, 2029", "Dec. 31, 2029"} <= set(found)
    assert found == sorted(found)


def test_cited_numbers_are_not_years(one):
    assert one(T.date_mentions, "42 U.S.C. 1395 and Title 2030 stay") == []


def test_bare_year_needs_a_cue_within_three_words(one):
    years = lambda c: T.context_years(T.mask_citations(c))
    assert one(years, "before 2030 and 2031") == ["2030", "2031"]
    assert one(years, "before 2030 there is 2031") == ["2030"]
    assert one(years, "value of 2044") == []
    assert one(years, "until a b c 2044") == []
    assert one(years, "until a b 2044") == ["2044"]
    assert one(years, "until 1899 or 2101") == []


def test_year_cue_is_a_substring_unless_whole_word(one):
    assert one(lambda c: T.context_years(c), "money 2044") == ["2044"]
    assert one(lambda c: T.context_years(c, whole_word=True), "money 2044") == []
    assert one(lambda c: T.context_years(c, whole_word=True), "on 2044") == ["2044"]


def test_measures_keep_overlaps_and_case(one):
    found = one(L.measures, "A minimum tax, a Tax; maintain renewable energy")
    assert found == sorted(["minimum tax", "tax", "Tax", "renewable energy", "energy"])
    assert one(lambda c: L.measures(c, fold_case=True), "a tax, a Tax") == ["tax"]


def test_measures_overlap_across_terms_of_equal_length(one):
    assert one(lambda c: L.measures(c, ["a b", "b c", "c"]), "a b c") == ["a b", "b c", "c"]


def test_measure_fallback_has_no_boundaries(one):
    assert one(L.measures, "The factory maintains") == ["ai", "act"] or \
        set(one(L.measures, "The factory maintains")) == {"act", "ai"}


def test_entities(one):
    assert one(L.entities, "The SEC and the sec met in china and China") == ["China", "SEC", "china"]
    assert one(L.entities, "European Union, USA") == ["European Union", "USA"]


def test_type_order(one):
    kind = lambda c: L.regulation_type(F.lower(c))
    assert one(kind, "Energy price tax") == "Taxation / Economic"
    assert one(kind, "Energy price") == "Consumer Protection"
    assert one(kind, "emission") == "Energy / Environmental"
    assert one(kind, "maintain") == "AI Promotion / Regulation"
    assert one(kind, "none") == "Other"


def test_company_theme(one):
    assert one(L.company_theme, "Acme Chips") == "Technology"
    assert one(L.company_theme, "Acme Financial") == "Other"
    assert one(lambda c: L.company_theme(c, prefix=True), "Acme Financial") == "Financials"
    assert one(L.company_theme, "Power Bank") == "Energy"
    assert one(L.company_theme, None) == "Other"


def test_text_themes_whole_word(one):
    assert one(lambda c: L.text_themes(F.lower(c)), "Maintain") == ["Technology"]
    assert one(lambda c: L.text_themes(F.lower(c), whole_word=True), "Maintain") == []


def test_targeted_falls_back_to_other(one):
    empty = F.array().cast("array<string>")
    assert one(lambda c: L.targeted_themes(empty, empty), "x") == ["Other"]


class Visible(HTMLParser):
    """Stand-in for a DOM reader: visible strings outside the hidden subtrees."""

    def __init__(self):
        super().__init__()
        self.out, self.depth = [], 0

    def handle_starttag(self, tag, attrs):
        self.depth += tag in ("script", "style", "noscript", "header", "footer")

    def handle_endtag(self, tag):
        self.depth -= tag in ("script", "style", "noscript", "header", "footer")

    def handle_data(self, data):
        if not self.depth and data.strip():
            self.out.append(data.strip())


def test_html_equals_a_dom_reader(one, spark):
    page = ("<!DOCTYPE html><html><head><style>p{}</style><SCRIPT>var a='</p><!-- ';</SCRIPT></head><body>"
            "<header>no</header>a &amp;lt; b &#233;&#xE9; &copy;<!-- x <p> --><p>one<b>two</b> 1 < 2</p>"
            "<footer>no</footer></body></html>")
    reader = Visible()
    reader.feed(page)
    assert one(T.html_text, page) == " ".join(" ".join(reader.out).split())


def test_html_fallback_keeps_scripts(one):
    assert one(T.html_strip_simple, "<script>x=1</script><p>a&nbsp;b</p>") == "x=1 a b"


def test_xml_leading_text_and_malformed(one):
    assert one(T.xml_text, "<a> x <b>y</b> tail <c/>z</a>") == "x y"
    assert one(T.xml_text, "<a>x<b>y</a>") == "x y"
    assert one(T.xml_text, None) is None


def test_space_is_unicode(one):
    assert one(T.normalize_space, " a  b\r\n") == "a b"


def test_chunks_rejoin_and_end_at_space(one):
    text = "alpha beta gamma delta epsilon " * 20 + "x" * 90
    parts = one(lambda c: T.chunks(c, 25, 10), text)
    assert "".join(parts) == text
    for p in parts[:-1]:
        assert 25 <= len(p) <= 35


def test_inline_config(spark):
    rows = spark.createDataFrame([
        (1, 'a <<<X_CONFIG_START>>>{"params": {"mention_boost": 0.25, "penalty_boost": "0.5"}}<<<X_CONFIG_END>>> b'),
        (2, "a <<<CONFIG_START>>>{bad<<<CONFIG_END>>> b"), (3, "plain")], "id int, t string")
    got = rows.select("id", O.without_config(F.col("t")).alias("body"), O.parse_config(O.config_json(F.col("t"))).alias("c")) \
        .select("id", "body", O.param(F.col("c"), "mention_boost").alias("m"),
                O.param(F.col("c"), "penalty_boost").alias("p")).orderBy("id").collect()
    assert [tuple(r) for r in got] == [(1, "a  b", 0.25, 0.5), (2, "a  b", 0.4, 0.1), (3, "plain", 0.4, 0.1)]


def test_overrides_replace_add_and_keep_order(spark):
    cfg = ('<<<CONFIG_START>>>{"company_theme_keywords": {"Technology": ["zed"], "New": "foo"}, '
           '"text_theme_keywords": {"Zed": ["AI", "kk"]}, "reg_type_targets": {"Other": "Zed"}}<<<CONFIG_END>>>kk ai')
    row = spark.createDataFrame([(cfg,)], "t string").select(
        O.parse_config(O.config_json(F.col("t"))).alias("c"), O.without_config(F.col("t")).alias("b"))
    rules = O.company_rules(F.col("c"))
    got = row.select(
        O.company_theme_by(F.lit("Zed Foo"), rules).alias("both"), O.company_theme_by(F.lit("Foo"), rules).alias("new"),
        O.company_theme_by(F.lit("Chip"), rules).alias("gone"), O.company_theme_by(F.lit("Oil"), rules).alias("kept"),
        L.text_themes(F.lower("b"), O.text_rules(F.col("c"))).alias("themes"),
        O.targets_by(F.col("c"), F.lit("Other")).alias("targets")).first()
    assert (got.both, got.new, got.gone, got.kept) == ("Technology", "New", "Other", "Energy")
    assert got.themes == ["Zed"] and got.targets == ["Zed"]


def test_extraction_is_the_same_for_any_partitioning(spark):
    docs = spark.createDataFrame(
        [(i, "html" if i % 3 else "xml", f"<p>tax {i} by 20{i:02d} in China</p>") for i in range(20)],
        "reg_id int, ext string, text string")
    def run(n):
        return sorted(map(str, E.extract_documents(docs.repartition(n)).select(
            "reg_id", "dates", "entities", "measures", "type_reg").collect()))
    assert run(1) == run(7)


def test_empty_inputs_give_typed_empty_results(spark):
    none = spark.createDataFrame([], "reg_id string, ext string, text string, portfolio_id string, name string")
    assert E.digest(E.extract_documents(none)).count() == 0


def test_combined_record_equals_the_joined_text(spark):
    texts = ["Sanctions on China by 2030.", "A factory in Europe.", "Price cap before 2031"]
    docs = spark.createDataFrame([("g", i, "txt", t) for i, t in enumerate(texts)],
                                 "g string, i int, ext string, text string")
    whole = spark.createDataFrame([("g", 0, "txt", " ".join(texts))], docs.schema)
    parts = E.combine(E.extract_documents(docs), "g").first()
    full = E.extract_documents(whole).first()
    for name in ("entities", "dates", "measures", "type_reg", "penalty_hit", "compliance_hit"):
        assert parts[name] == full[name], name


def test_document_offsets_in_the_joined_text(spark):
    texts = ["ab", "cde", "", "f"] * 30
    docs = spark.createDataFrame([("g", i, t) for i, t in enumerate(texts)], "g string, ord bigint, text string")
    whole = " ".join(texts)
    for r in E.corpus_offsets(docs, "g", ["ord"]).collect():
        assert whole[r.start_pos:r.start_pos + r.n_chars] == texts[r.ord]
