"""Adapter: engine inputs composed from the driver's relational tables.

Each input is one SELECT that reads other inputs or driver tables as ``@name@``.
The same text runs on Spark and on the checking database, so both sides start
from equal rows.  Everything grows with the tables: one holding per customer in
books of 150, one regulation per supplier, one filing per order of a company with a
balance (``every_filing``: of any company); some filings are many times longer than the others.
``filing_names`` has those of all orders with lines, also where no line has a known part or supplier and there is no
filing.  Document texts are composed from a fixed number of slots, never by collecting a group.
"""

import uuid
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .sources.stage import stage

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def _letters(key: str, width: int) -> str:
    return (f"translate(lpad(cast({key} as string), {width}, '0'), "
            "'0123456789', 'aeioubdgkm')")


def _supplier_name(key: str) -> str:
    return (f"'V' || {_letters(key, 6)} || CASE {key} % 9 WHEN 2 THEN ' China' "
            "WHEN 5 THEN ' Europe' ELSE '' END || ' Corp'")


def _symbol(key: str) -> str:
    return f"'C' || lpad(cast({key} as string), 7, '0')"


def _company(key: str, segment: str) -> str:
    return f"""'N' || {_letters(key, 7)} || CASE {segment} WHEN 'BUILDING' THEN ' Capital'
      WHEN 'AUTOMOBILE' THEN ' Transport' WHEN 'MACHINERY' THEN ' Industrial'
      WHEN 'HOUSEHOLD' THEN ' Consumer Brands' ELSE ' Retail' END
      || CASE {key} % 7 WHEN 0 THEN ' Inc.' WHEN 1 THEN ' Software' WHEN 2 THEN ' Energy'
      WHEN 3 THEN ' Pharma' ELSE '' END"""


def _book(key: str, size: int) -> str:
    return f"'B' || lpad(cast(cast(floor({key} / {size}) as bigint) as string), 5, '0')"


def _slot(n: int, value: str, alias: str) -> str:
    return f"max(CASE WHEN l_linenumber = {n} THEN {value} END) AS {alias}{n}"


def _hundredths(c: Column, kind: str) -> Column:
    """A number as a decimal of this kind (two decimals), in whole hundredths.  A double up to ten million that is a whole
    number of hundredths is known without making the decimal, whose shortest text that double is."""
    double = c.cast("double")
    whole = F.when(F.abs(double) <= 10_000_000, F.rint(double * 100).cast("bigint"))
    return F.coalesce(F.when(whole / F.lit(100.0) == double, whole), (c.cast(kind) * 100).cast("bigint"))


def _region_line(number: int, name: str) -> str:
    return (f"CASE WHEN g{number} = 0 THEN '' WHEN (ok + {number}) % 6 = 0 THEN '{name} is a key market.' || chr(10) "
            f"ELSE '{name} represented ' || cast(cast(floor(100 * cast(g{number} as double) / cast(g as double)) as int) as string) "
            "|| '% of net sales.' || chr(10) END")


def _long_sections() -> str:
    """More sections of some filings: longer than any window, with more entries than any short list, under second headings.

    One literal, in which @ stands for letters of the filing and # for those of the book.
    """
    pairs = [a + b for a in "aeioub" for b in "aeioub"]
    letters = "aeioubdgkm"

    def filler(n):
        return "The weather was mild near the old plant again. " * n + "\n"

    lines = ["Suppliers in other markets\n", filler(70), f"Key suppliers include {', '.join(f'#{c} Corp' for c in letters)} for some parts.\n",
             *[f"Key suppliers include {', '.join(f'V@{p} Corp' for p in pairs[i:i + 4])} for some parts.\n" for i in range(0, 36, 4)],
             "Geographic information, continued\n", filler(180), "Taiwan represented 12% of net sales.\nSingapore is a small market.\n",
             "Principal products\n", filler(110),
             *[f"Our products include @{p} rods, @{p} tubes and small castings.\n" for p in pairs[:13]],
             "Sales by customers\n", filler(70), f"Others are {', '.join(f'Q@{p} Stores Inc' for p in pairs[:12])}.\n",
             "Other dependencies\n", *[f"The group depends on @{p} metal from abroad.\n" for p in pairs[:17]],
             "Risk factors (continued)\n", filler(330),
             "The legislation of several governments, and a market share lost to competition with pricing pressure, "
             "could reduce what is earned, " + "year after year and " * 15 + "for good. "]
    text = "".join(lines).replace("\n", "' || chr(10) || '")
    return f"replace(replace('{text}', '@', {_letters('ok', 7)}), '#', 'V' || {_letters('cast(floor(b.k / 150) as bigint)', 5)})"


#: Tables with a row per customer, part or order.  Their files are small for their rows, so by its size check Spark would
#: broadcast millions of rows through the driver; they are sorted and merged.  So are the inputs made of them.
MERGED = {"customer", "part", "orders", "sales", "book_totals"}

#: Inputs with a row per customer made from all lines, which others read several times over: written once.
WRITTEN = {"sales"}

#: Types of the sums in ``sales``, as the SQL gives them.
SUMS = {"gross": "decimal(28,2)", "net": "decimal(34,4)"}

#: The name of the filing of an order.
_FILING_NAME = """CASE ok % 4 WHEN 3 THEN 'quarter_' WHEN 2 THEN 'Form10K_' ELSE 'a_10-k_' END
         || lpad(cast(ok as string), 9, '0') || '.txt'"""

REGION_NAMES = ["India", "United States", "China", "Europe", "Japan"]

FIXTURES = {
    "books": f"""
SELECT c_custkey AS k, {_symbol('c_custkey')} AS symbol, {_book('c_custkey', 150)} AS portfolio_id,
       {_company('c_custkey', 'c_mktsegment')} AS company, cast(c_custkey % 150 + 1 as int) AS rank,
       c_acctbal AS price
FROM @customer@""",
    "sales": """
SELECT o_custkey AS k, sum(cast(l_extendedprice as decimal(18,2))) AS gross,
       sum(cast(l_extendedprice as decimal(18,2)) * (1 - cast(l_discount as decimal(4,2)))) AS net
FROM @lineitem@ JOIN @orders@ ON l_orderkey = o_orderkey GROUP BY o_custkey""",
    "book_totals": """
SELECT portfolio_id, sum(gross) AS total FROM @books@ JOIN @sales@ USING (k) GROUP BY portfolio_id""",
    "holdings": """
SELECT b.portfolio_id, b.symbol, b.company, b.rank, b.price, b.k,
       round(cast(s.gross as double) / cast(t.total as double) * 100, 6) AS weight
FROM @books@ b JOIN @sales@ s ON b.k = s.k JOIN @book_totals@ t ON b.portfolio_id = t.portfolio_id""",
    "fundamentals": f"""
SELECT {_symbol('k')} AS symbol, 'Issuer ' || cast(k as string) AS company_name,
       cast(gross * 100000 as double) AS market_cap,
       CASE WHEN k % 13 = 4 THEN 0.0 ELSE cast(net as double) END AS revenue,
       cast(net as double) * 0.25 - 1000 * (k % 5) AS op_income, cast(net as double) * 0.125 AS net_income,
       cast(k % 97 as double) / 8 AS eps, cast(net as double) * 0.0625 AS fcf
FROM @sales@ WHERE k % 11 <> 5""",
    "holding_strings": """
SELECT cast(rank as string) AS rank, '"' || company || '"' AS company, symbol,
       replace(cast(cast(weight as decimal(18,6)) as string), '.', ',') AS weight,
       replace(cast(cast(price as decimal(18,2)) as string), '.', ',') AS price, portfolio_id
FROM @holdings@""",
    "fundamental_strings": """
SELECT symbol, '  ' || company_name || ' ' AS company_name,
       substr(cast(cast(market_cap as decimal(28,0)) as string), 1, 3) || ','
         || substr(cast(cast(market_cap as decimal(28,0)) as string), 4) AS market_cap,
       CASE WHEN revenue = 0 THEN '-' ELSE cast(cast(revenue as decimal(20,8)) as string) END AS revenue,
       cast(cast(op_income as decimal(20,8)) as string) AS op_income,
       CASE WHEN eps = 1 THEN 'n/a' ELSE cast(cast(net_income as decimal(20,8)) as string) END AS net_income,
       cast(cast(eps as decimal(18,3)) as string) AS eps, cast(cast(fcf as decimal(20,8)) as string) AS fcf
FROM @fundamentals@""",
    "filing_lines": """
SELECT l_orderkey, l_linenumber, max(l_suppkey) AS sk, max(l_partkey) AS pk,
       sum(cast(l_extendedprice as decimal(18,2))) AS g
FROM @lineitem@ GROUP BY l_orderkey, l_linenumber""",
    "filing_slots": f"""
SELECT l_orderkey AS ok, {', '.join(_slot(n, _supplier_name('sk'), 's') for n in range(1, 8))},
       {', '.join(_slot(n, 'p_name', 'p') for n in range(1, 8))},
       {', '.join(f"sum(CASE WHEN n_regionkey = {r} THEN g ELSE 0 END) AS g{r}" for r in range(5))},
       sum(g) AS g
FROM @filing_lines@ JOIN @supplier@ ON sk = s_suppkey JOIN @nation@ ON s_nationkey = n_nationkey
JOIN @part@ ON pk = p_partkey GROUP BY l_orderkey""",
    "filings": f"""
SELECT cast(ok as bigint) AS filing_id, b.symbol AS ticker,
       CASE WHEN ok % 4 = 3 THEN '10-Q' ELSE '10-K' END AS filing_type,
       cast(year(o_orderdate) as int) AS fiscal_year,
       {_FILING_NAME} AS name,
       'Report ' || cast(ok as string) || ' of ' || b.symbol AS title,
       'filing://' || b.symbol || '/' || cast(ok as string) AS url,
       'Form 10-K annual report of ' || b.company || '.' || chr(10)
       || CASE WHEN ok % 7 = 0 THEN '' ELSE 'Supply chain and suppliers' || chr(10)
            || 'Key suppliers include ' || coalesce(s1 || ', ', '') || coalesce(s2 || ', ', '')
            || coalesce(s3 || ', ', '') || coalesce(s4, 'Omega Ltd') || ' for most parts.' || chr(10) END
       || CASE WHEN ok % 5 = 0 THEN '' ELSE 'Manufacturing' || chr(10) || 'Manufacturing is done with '
            || coalesce(s5, 'The Partner') || ' in ' || CASE ok % 3 WHEN 0 THEN 'Taiwan' WHEN 1 THEN 'Mexico'
               ELSE 'South Korea' END || '. Parts are sourced from ' || coalesce(s6, 'Delta Works Inc')
            || ' every year.' || chr(10) END
       || 'Geographic information' || chr(10)
       || {' || '.join(_region_line(i, n) for i, n in enumerate(REGION_NAMES))}
       || CASE WHEN ok % 5 = 1 THEN 'Segment results' || chr(10) || 'China had ' || cast(10 + ok % 30 as string)
            || '% and Europe had ' || cast(5 + ok % 40 as string) || '% of segment sales.' || chr(10) ELSE '' END
       || CASE WHEN ok % 9 = 4 THEN 'Revenue by region' || chr(10) || 'USA: ' || cast(ok % 60 as string)
            || '%, India: none.' || chr(10) ELSE '' END
       || 'Products and services' || chr(10) || 'Our products include ' || coalesce(p1 || ', ', '')
       || coalesce(p2 || ', ', '') || coalesce(p3, 'spare parts') || ' and ' || coalesce(p4, 'brand names')
       || '. The portfolio includes ' || coalesce(p5, 'long rods and tubes') || ', and '
       || coalesce(p6, 'sand castings') || '.' || chr(10)
       || CASE WHEN ok % 4 = 1 THEN '' ELSE 'Customers' || chr(10) || 'Large customers are ' || coalesce(s7, 'Gamma Co')
            || ' and Beta Stores Inc. The rest is small.' || chr(10) END
       || 'Dependencies' || chr(10) || 'The group depends on ' || coalesce(p7, 'imported metal')
       || ' delivered by sea. Our reliance on one plant near the coast is high! Cash is essential to the daily '
       || 'operation of ' || coalesce(p1, 'all sites') || '.' || chr(10)
       || CASE WHEN ok % 8 = 6 THEN '' ELSE 'Risk factors' || chr(10)
            || 'Changes in tax law and government regulation could raise the cost of doing business for ' || b.company || '. '
            || CASE WHEN ok % 3 = 0 THEN 'New tariffs and trade tension may reduce what ' || b.company || ' sells abroad, in '
                 || CASE WHEN ok % 2 = 0 THEN 'China' ELSE 'Europe' END || ' above all. ' ELSE '' END
            || CASE WHEN ok % 3 = 1 THEN 'A shortage at a single supplier may cause a long disruption in the supply chain of ' || b.company || '. '
                 ELSE 'Short supply chain note. ' END
            || CASE WHEN ok % 4 = 0 THEN 'A data breach or cyber event could harm ' || b.company || ' and lead to sanctions! ' ELSE '' END
            || CASE WHEN ok % 5 = 2 THEN 'Currency moves and interest rate changes affect the debt we carry each year. ' ELSE '' END
            || 'Does climate change matter' END
       || CASE WHEN ok % 97 = 5 THEN '.' || chr(10) || {_long_sections()} ELSE '' END AS text
FROM @filing_slots@ JOIN @orders@ ON ok = o_orderkey JOIN @books@ b ON o_custkey = b.k WHERE b.price >= 0""",
    "filing_names": f"""
SELECT cast(ok as bigint) AS filing_id, b.symbol AS ticker, {_FILING_NAME} AS name
FROM (SELECT o_orderkey AS ok, o_custkey FROM @orders@ WHERE o_orderkey IN (SELECT l_orderkey FROM @lineitem@)) o
JOIN @books@ b ON o_custkey = b.k WHERE b.price >= 0""",
    "regulation_bodies": f"""
SELECT k, 'The ' || CASE k % 4 WHEN 0 THEN 'Inflation Reduction Act' WHEN 1 THEN 'EU AI Act'
         WHEN 2 THEN 'Green Deal' ELSE 'Market Rules Notice' END || ' concerns ' || {_symbol('a.c_custkey')}
       || ', ' || lower({_symbol('b.c_custkey')}) || ' and ' || {_company('b.c_custkey', 'b.c_mktsegment')}
       || '; it was issued under 42 U.S.C. 1395 and Section 2031 by the European Commission on 2024-0'
       || cast(1 + k % 9 as string) || '-1' || cast(k % 10 as string) || '. Deliveries of '
       || {_supplier_name('k')} || ' and of ' || lower({_supplier_name('k - k % 10 + (k * 7 + 3) % 10')})
       || ' are reviewed. '
       || CASE k % 5 WHEN 0 THEN 'A minimum tax and an export ban apply, with Penalties for late filing. '
            WHEN 1 THEN 'Consumer rights and reporting obligations bind firms from China and Japan. '
            WHEN 2 THEN 'Sanctions and tariffs hit imports from China, Taiwan and the United States; compliance is checked. '
            WHEN 3 THEN 'Emissions of energy plants in Europe and India need renewable sources and a price cap. '
            ELSE 'Firms keep records of their own choice. ' END
       || CASE k % 3 WHEN 0 THEN 'It is effective September 30, 2027 through Dec. 31, 2029, for fiscal year 2026 and FY2028. '
            WHEN 1 THEN 'It ends on 09/30/2031, before 2033; a sum of 2044 units, money 2045, stays. '
            ELSE 'Pub. L. 117 and H.R. 5376 stand. ' END
       || CASE WHEN k % 8 = 4 THEN 'The Securities and Exchange Commission (SEC) and the FDA reply.' ELSE '' END AS body
FROM (SELECT s_suppkey AS k, cast(floor(s_suppkey / 10) * 150 + (s_suppkey * 37) % 150 as bigint) AS ka,
             cast(floor(s_suppkey / 10) * 150 + (s_suppkey * 53 + 7) % 150 as bigint) AS kb FROM @supplier@) s
JOIN @customer@ a ON a.c_custkey = ka JOIN @customer@ b ON b.c_custkey = kb""",
    "regulation_docs": f"""
SELECT 'R' || lpad(cast(k as string), 6, '0') AS reg_id, {_book('k', 10)} AS portfolio_id,
       'R' || lpad(cast(k as string), 6, '0') || CASE k % 10 WHEN 3 THEN '.v1.html' WHEN 7 THEN '.xml' ELSE '.txt' END AS name,
       CASE k % 10 WHEN 3 THEN 'html' WHEN 7 THEN 'xml' ELSE 'txt' END AS ext,
       cast(k as bigint) AS ord,
       CASE k % 12
         WHEN 1 THEN '<<<CONFIG_START>>>{{"params": {{"mention_boost": 0.25, "loss_pct_multiplier": 20, "ticker_min_len": 9}}, '
           || '"company_theme_keywords": {{"Technology": ["software", "capital"], "Logistics": "transport"}}, '
           || '"text_theme_keywords": {{"Logistics": ["deliveries"]}}, '
           || '"reg_type_targets": {{"Taxation / Economic": ["Financials"]}}}}<<<CONFIG_END>>>'
         WHEN 7 THEN '<<<CONFIG_START>>>{{"params": oops<<<CONFIG_END>>>' ELSE '' END
       || CASE k % 10
         WHEN 3 THEN '<!DOCTYPE html><html><head><style>p {{color: red}}</style><script>var tax = "</p>";</script></head>'
           || '<body><header>Inflation <b>banner</b></header><!-- penalty --><p>' || body || '</p><p>Rates &amp; fees</p><footer>drug</footer></body></html>'
         WHEN 7 THEN '<reg><title>Notice</title><body>' || body || '</body></reg>'
         ELSE body END AS text
FROM @regulation_bodies@""",
    "coverage": f"""
SELECT DISTINCT reg_id, portfolio_id FROM (
  SELECT 'R' || lpad(cast(s_suppkey as string), 6, '0') AS reg_id,
         {_book("(s_suppkey + 10 * d * (s_suppkey % 4)) % (SELECT max(s_suppkey) + 1 FROM @supplier@)", 10)} AS portfolio_id
  FROM @supplier@ CROSS JOIN (SELECT 0 AS d UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 5) n)""",
    "company_findings": """
SELECT r.reg_id, h.symbol,
       CASE h.rank % 3 WHEN 0 THEN '{"impact_direct": ' || cast(h.rank % 100 as string)
         || ', "impact_fournisseurs": 40, "impact_geographique": 25.5, "fournisseurs_a_risque": ["Omega Ltd"], "recommandation": "REDUCE"}'
       WHEN 1 THEN 'not json' ELSE '{"impact_direct": 0, "impact_fournisseurs": 0}' END AS finding
FROM @regulation_docs@ r JOIN @holdings@ h ON r.portfolio_id = h.portfolio_id AND (h.rank + r.ord) % 10 = 0""",
    "regulation_findings": """
SELECT reg_id, CASE ord % 4 WHEN 0 THEN '{"type_regulation": "Customs", "entreprises_a_risque": ["Omega China Ltd"], '
         || '"dates_cles": ["2030-01-01"], "mesures": ["duty relief"], "severite": 8, "resume": "Checked."}'
       WHEN 1 THEN '{"entreprises_a_risque": ["SEC"]}' ELSE 'broken {' END AS finding,
       CASE WHEN ord % 4 = 3 THEN 'timeout' END AS error
FROM @regulation_docs@ WHERE ord % 5 <> 2""",
    "supply_findings": """
SELECT symbol, CASE rank % 4 WHEN 0 THEN '{"risk_level": "HIGH", "risk_score": ' || cast(rank as string)
         || ', "affected_suppliers": ["Omega Ltd", "Beta"], "geographic_risks": {"China": "export ban"}}'
       WHEN 1 THEN '{"affected_suppliers": []}' WHEN 2 THEN '{"risk_level": ' ELSE NULL END AS finding
FROM @holdings@""",
    "recommendation_replies": """
SELECT reg_id, portfolio_id, CASE ord % 3
         WHEN 0 THEN '{"action": "SELL", "tickers_concernes": ["A", "B"], "justification": "one object", "timeline": "now", "urgence": "HIGH"}'
         WHEN 1 THEN '[{"action": "HEDGE", "justification": "first"}, {"action": "ROTATE", "justification": "second", "impact_estime": "2B"}]'
         ELSE 'garbage' END AS reply
FROM @regulation_docs@ WHERE ord % 4 = 1""",
    "report_requests": """
SELECT reg_id, CASE WHEN s_acctbal < 0 THEN NULL WHEN s_acctbal < 500 THEN '' ELSE text END AS text
FROM @regulation_docs@ JOIN @supplier@ ON ord = s_suppkey""",
    "model_replies": """
SELECT reg_id, CASE ord % 7
         WHEN 0 THEN 'Here: ```json' || chr(10) || '{"themes": ["tax", " ", "trade"]}' || chr(10) || '``` done'
         WHEN 1 THEN 'Sure. {"themes": ["supply chain", " tariffs ", "climate change", "debt"]}'
         WHEN 2 THEN '{"themes": ["data breach"]} is my answer' WHEN 3 THEN 'no object here'
         WHEN 4 THEN '' WHEN 5 THEN '{"themes": []}' ELSE 'bad {"themes": [tax} end' END AS reply
FROM @regulation_docs@""",
}

#: Filings of all companies; ``filings`` leaves some companies without one.
FIXTURES["every_filing"] = FIXTURES["filings"].removesuffix(" WHERE b.price >= 0")


def sql_with(names: list[str]) -> str:
    """CTE list for the checking database: the named inputs and what they need."""
    order: list[str] = []

    def visit(name):
        if name in order:
            return
        for dep in FIXTURES:
            if f"@{dep}@" in FIXTURES[name]:
                visit(dep)
        order.append(name)

    for n in names:
        visit(n)
    return ",\n".join(f"{n} AS ({plain(FIXTURES[n])})" for n in order)


def plain(sql: str) -> str:
    for name in [*TABLES, *FIXTURES]:
        sql = sql.replace(f"@{name}@", name)
    return sql


class Inputs:
    """Lazy frames over one data folder.  ``given``: tables that take the place of those in it."""

    def __init__(self, spark: SparkSession, sf_dir: str, given: dict[str, DataFrame] | None = None):
        self.spark, self.dir, self._tag = spark, sf_dir, "tw" + uuid.uuid4().hex[:10]
        self._given = given or {}
        self._made: set[str] = set()

    def table(self, name: str) -> DataFrame:
        return self._given[name] if name in self._given else self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def filings_of(self, ids: DataFrame) -> DataFrame:
        """The filings whose ``filing_id`` is in ``ids``.  Lines of other orders are left out before they meet
        suppliers and parts and become slots; Spark pushes a join with ids below that grouping only if it is broadcast."""
        lines = self.table("lineitem").join(ids, F.col("l_orderkey") == F.col("filing_id"), "left_semi")
        return Inputs(self.spark, self.dir, self._given | {"lineitem": lines})["filings"]

    def _view(self, name: str) -> str:
        view = f"{self._tag}_{name}"
        if name not in self._made:
            frame = self.table(name) if name in TABLES else self.get(name)
            frame = stage(frame) if name in WRITTEN else frame
            frame = frame.hint("merge") if name in MERGED else frame
            frame.createOrReplaceTempView(view)
            self._made.add(name)
        return view

    def _filing_slots(self) -> DataFrame:
        """The rows of the SQL.  Narrow lines are dealt by order before they become slots: lines of an order lie in
        several tasks, and grouped there first each would travel as a row of all slots."""
        lines, supplier, nation = self["filing_lines"], self.table("supplier"), self.table("nation")
        part = self.table("part").hint("merge")
        met = (lines.join(supplier, F.col("sk") == F.col("s_suppkey")).join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
               .join(part, F.col("pk") == F.col("p_partkey"))
               .select("l_orderkey", "l_linenumber", "sk", "p_name", "n_regionkey", "g").repartition("l_orderkey"))
        view = f"{self._tag}_met_lines"
        met.createOrReplaceTempView(view)
        head, _, rest = FIXTURES["filing_slots"].partition("FROM @filing_lines@")
        return self.spark.sql(f"{head} FROM {view} {rest[rest.index('GROUP BY'):]}")

    def _sales(self) -> DataFrame:
        """The rows of the SQL.  Lines are dealt by order and summed there before orders come in, so that no line is sorted
        to meet its order.  Decimal sums are exact in any order; those of lines are of whole numbers (of cents and of
        billions of them), as decimals beyond 18 digits take many times as long."""
        lines = self.table("lineitem").select("l_orderkey", "l_extendedprice", "l_discount").dropna(subset=["l_orderkey"])
        lines = lines.repartition("l_orderkey").select(
            "l_orderkey", _hundredths(F.col("l_extendedprice"), "decimal(18,2)").alias("p"),
            (100 - _hundredths(F.col("l_discount"), "decimal(4,2)")).alias("d"))
        lines = lines.withColumn("high", F.floor(F.col("p") / F.lit(1e9)).cast("bigint"))
        lines = lines.withColumn("low", F.col("p") - F.col("high") * 1_000_000_000)
        parts = lines.groupBy("l_orderkey").agg(
            F.sum("high").alias("gross_high"), F.sum("low").alias("gross_low"),
            F.sum(F.col("high") * F.col("d")).alias("net_high"), F.sum(F.col("low") * F.col("d")).alias("net_low"))

        def total(name, unit):
            high, low = [F.col(f"{name}_{part}").cast("decimal(20,0)") for part in ("high", "low")]
            return ((high * F.lit(Decimal(10 ** 9)) + low) * F.lit(Decimal(unit))).cast(SUMS[name]).alias(name)

        sums = parts.select("l_orderkey", total("gross", "0.01"), total("net", "0.0001"))
        out = sums.join(self.table("orders").hint("merge"), F.col("l_orderkey") == F.col("o_orderkey"))
        return out.groupBy(F.col("o_custkey").alias("k")).agg(*[F.sum(c).cast(kind).alias(c) for c, kind in SUMS.items()])

    def _filings(self, name: str) -> DataFrame:
        """The rows of the SQL.  Orders meet their books before they meet slots, so that rows of all slots are not dealt
        anew by company.  If only some lines are given, few slots are left to be dealt, and orders stay as they are."""
        if "lineitem" in self._given:
            return self.run(FIXTURES[name])
        joined = "JOIN @orders@ ON ok = o_orderkey JOIN @books@ b ON o_custkey = b.k"
        where = FIXTURES[name].partition(joined)[2]
        owned = self.run(f"SELECT o_orderkey, o_orderdate, b.* FROM @orders@ JOIN @books@ b ON o_custkey = b.k{where}")
        view = f"{self._tag}_owned_{name}"
        owned.hint("merge").createOrReplaceTempView(view)
        return self.run(FIXTURES[name].replace(joined + where, f"JOIN {view} b ON ok = b.o_orderkey"))

    def _filing_names(self) -> DataFrame:
        """The rows of the SQL.  Lines are merged: their keys alone pack into so little that they would be broadcast."""
        lines = self.table("lineitem").select("l_orderkey").hint("merge")
        held = self.table("orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi")
        asked = " WHERE o_orderkey IN (SELECT l_orderkey FROM @lineitem@)"
        return Inputs(self.spark, self.dir, self._given | {"orders": held}).run(FIXTURES["filing_names"].replace(asked, ""))

    def get(self, name: str) -> DataFrame:
        if name == "filing_slots":
            return self._filing_slots()
        if name == "sales":
            return self._sales()
        if name == "filing_names":
            return self._filing_names()
        if name in ("filings", "every_filing"):
            return self._filings(name)
        return self.run(FIXTURES[name])

    def run(self, sql: str) -> DataFrame:
        for dep in [*TABLES, *FIXTURES]:
            if f"@{dep}@" in sql:
                sql = sql.replace(f"@{dep}@", self._view(dep))
        return self.spark.sql(sql)

    __getitem__ = get
