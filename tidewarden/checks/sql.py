"""SQL for a second engine, one statement per query.

Written independently of the Spark plans: joins are brute force, dates are
found over token lists, sections by position of the matched line.  ``@name@``
refers to a driver table, a composed input or another step.
"""

import re

from .. import config as C
from ..fixtures import FIXTURES, TABLES


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def words(items) -> str:
    return "[" + ", ".join(lit(i) for i in items) + "]"


def esc(text: str) -> str:
    return "".join("\\" + ch if ch in ".^$*+?()[]{}|\\" else ch for ch in text)


def alternation(items) -> str:
    return "|".join(esc(i) for i in items)


def every(column: str, pattern: str, group: int = 0) -> str:
    return f"regexp_extract_all({column}, {lit(pattern)}, {group})"


def concat(parts) -> str:
    out = "[]::VARCHAR[]"
    for p in parts:
        out = f"list_concat({out}, {p})"
    return out


def in_order(column: str) -> str:
    return f"list_sort(list_distinct({column}))"


def bars(column: str) -> str:
    return f"array_to_string({column}, '|')"


def space(column: str) -> str:
    return f"trim(regexp_replace({column}, '\\s+', ' ', 'g'))"


def any_in(column: str, items) -> str:
    return "(" + " OR ".join(f"contains({column}, {lit(i)})" for i in items) + ")"


def masked(column: str) -> str:
    for p in C.CITATION_FORMATS:
        column = f"regexp_replace({column}, {lit(p)}, ' ', 'gi')"
    return column


def html(column: str) -> str:
    hidden = "|".join([r"<!--.*?-->"] + [rf"<{t}\b.*?</{t}\s*>" for t in C.HIDDEN_TAGS])
    body = f"regexp_replace({column}, {lit('(?is)' + hidden)}, ' ', 'g')"
    body = f"regexp_replace({body}, '<[a-zA-Z/!?][^>]*>', ' ', 'g')"
    for ref, value in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"),
                       ("&amp;", "&")):
        body = f"replace({body}, {lit(ref)}, {lit(value)})"
    return space(body)


CONFIG = "(?s)" + C.CONFIG_BLOCK


def reg_type(low: str) -> str:
    arms = " ".join(f"WHEN {any_in(low, w)} THEN {lit(t)}" for t, w in C.REG_TYPE_KEYWORDS.items())
    return f"CASE {arms} ELSE 'Other' END"


def param(name: str) -> str:
    return (f"coalesce(try_cast(json_extract_string(cfg, '$.params.{name}') AS double), "
            f"{C.DEFAULT_PARAMS[name]}::double)")


YEAR_CUES = "|".join(C.YEAR_CUES)
DATES = concat(every("masked", "(?i)" + p) for p in C.DATE_FORMATS)
YEARS = f"""list_transform(list_filter(range(1, len(toks) + 1), lambda i: regexp_full_match(toks[i], '\\d{{4}}')
  AND try_cast(toks[i] AS int) BETWEEN 1900 AND 2100
  AND regexp_matches(lower(array_to_string(toks[greatest(1, i - 6):i - 1], ' ')), {lit(YEAR_CUES)})), lambda i: toks[i])"""
GAZETTEER = every("text", r"\b(?:" + alternation(sorted((p for _, p in C.GAZETTEER), key=lambda p: (-len(p), p))) + r")\b")
KEYWORDS = every("text", r"(?i)\b(?:" + alternation(C.ENTITY_KEYWORDS) + r")\b")
EXACT = concat(every("text", rf"(?i)\b{esc(t)}\b") for t in C.MEASURE_TERMS)
LOOSE = every("text", "(?i)(?:" + alternation(C.FALLBACK_MEASURES) + ")")


def section(name: str, chars: int = 3000) -> str:
    line = f"regexp_extract(text, {lit('(?i)(?:^|\n).*' + esc(name))})"
    return f"CASE WHEN {line} = '' THEN '' ELSE substr(text, instr(text, {line}), {chars}) END"


HEADED = ([f"sup{i}" for i in range(5)], C.SUPPLIER_SECTIONS), ([f"geo{i}" for i in range(3)], C.GEOGRAPHY_SECTIONS), \
    ([f"pro{i}" for i in range(3)], C.PRODUCT_SECTIONS), (["cust", "site", "risk"], [C.CUSTOMER_SECTION, C.MANUFACTURING_SECTION, C.RISK_SECTION])
HEADING = "'^[ \\t]*[\\p{Lu}\\p{N}].{0,77}[\\p{L}\\p{N})][ \\t\\r]*$'"


def text_lines(source: str, key: str) -> str:
    """Numbered lines of every text with the number of their segment."""
    return f"""SELECT doc, i, line, h, len(line) AS n, sum(CASE WHEN i > 1 AND h AND ended AND NOT run_on THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY i) AS seg
FROM (SELECT doc, i, line, regexp_matches(line, {HEADING}) AS h,
        regexp_matches(prev, '[.!?:;][ \\t\\r]{{0,3}}$') OR (i > 2 AND regexp_matches(prev, '^[ \\t\\r]{{0,3}}$')) AS ended,
        coalesce(regexp_matches(next, '^[ \\t]*\\p{{Ll}}'), false) AS run_on
      FROM (SELECT *, lag(line) OVER w AS prev, lead(line) OVER w AS next FROM (
        SELECT {key} AS doc, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM {source})
      WINDOW w AS (PARTITION BY doc ORDER BY i)))"""


def captures(column: str, patterns) -> str:
    return concat(every(column, "(?i)" + p, 1) for p in patterns)


def trimmed(column: str) -> str:
    return f"regexp_replace({column}, '^\\s+|\\s+$', '', 'g')"


def geography_rows() -> str:
    parts = []
    for i, (region, pattern) in enumerate(C.REGION_PATTERNS.items()):
        def share(k):
            return (f"list_max(list_transform({every(f'geo{k}', '(?i)' + pattern + C.REGION_SHARE, 1)}, "
                    "lambda p: p::double))")
        seen = " ".join(f"WHEN regexp_matches(geo{k}, {lit('(?i)' + pattern)}) THEN {k}" for k in range(3))
        parts.append(f"SELECT doc, {i} AS ord, {lit(region)} AS region, CASE {seen} END AS seen, "
                     f"coalesce({share(2)}, {share(1)}, {share(0)}, 0) AS share FROM @slices@")
    return "SELECT * FROM (" + " UNION ALL ".join(parts) + ") WHERE seen IS NOT NULL"


def risk_lines() -> str:
    parts = []
    for i, (theme, pattern) in enumerate(C.RISK_THEMES.items()):
        hits = f"list_filter(sentences, lambda s: regexp_matches(s, {lit('(?i)' + pattern)}))"
        parts.append(f"""SELECT doc, {i} AS ord, (SELECT s FROM (SELECT unnest({hits}) AS s,
          generate_subscripts({hits}, 1) AS p) ORDER BY length(s) DESC, p LIMIT 1) AS best, {lit(theme)} AS theme FROM @slices@""")
    return ("SELECT doc, ord, theme || ': ' || best || '...' AS line FROM ("
            + " UNION ALL ".join(parts) + ") WHERE length(best) > 50")


def name_runs(column: str, pattern: str) -> str:
    return f"flatten(list_transform({column}, lambda m: {every('m', pattern, 1)}))"


SUP_SLICES = "list_distinct(list_filter([sup0, sup1, sup2, sup3, sup4], lambda s: s <> ''))"
PRO_SLICES = "list_distinct(list_filter([pro0, pro1, pro2], lambda s: s <> ''))"
SUPPLIERS = f"""list_sort(list_distinct(list_filter({name_runs(
    f"flatten(list_transform({SUP_SLICES}, lambda s: {captures('s', C.SUPPLIER_PHRASES)}))", C.SUPPLIER_NAME)},
    lambda n: length(n) > 3 AND NOT list_contains({words(C.SUPPLIER_STOP)}, n))))"""
PRODUCTS = f"""list_sort(list_distinct(list_filter(flatten(list_transform(
    flatten(list_transform({PRO_SLICES}, lambda s: {captures('s', C.PRODUCT_PHRASES)})),
    lambda m: list_transform(string_split_regex(m, ',\\s*(?:and\\s+)?|\\band\\s+'), lambda i: {trimmed('i')}))),
    lambda i: length(i) > 5 AND length(i) < 100)))"""
DEPENDENCIES = f"""list_sort(list_distinct(list_filter(list_transform({captures('text', C.DEPENDENCY_PHRASES)},
    lambda m: {trimmed('m')}), lambda m: length(m) > 15)))"""
CUSTOMERS = f"""list_sort(list_distinct(list_filter({every('cust', C.CUSTOMER_NAME, 1)}, lambda n: length(n) > 3)))"""
SITES = f"""list_sort(list_filter([{', '.join(
    f"CASE WHEN regexp_matches(site, {lit('(?i)' + p)}) THEN {lit(r)} END" for r, p in C.REGION_PATTERNS.items())}],
    lambda r: r IS NOT NULL))"""


def slices(source: str, key: str, lines: str) -> str:
    names = ", ".join(f"({lit(n)})" for n in sorted({n for _, group in HEADED for n in group}))
    cut = [f"coalesce(max(part) FILTER (parts.name = {lit(n)}), '') AS {alias}" for aliases, group in HEADED for alias, n in zip(aliases, group)]
    return f"""SELECT * EXCLUDE (risk), regexp_extract_all(risk, '[^.!?]*[.!?]') AS sentences FROM (
SELECT {key} AS doc, any_value(ticker) AS ticker, any_value(text) AS text, {', '.join(cut)} FROM {source} LEFT JOIN (
  SELECT doc, name, string_agg(line, chr(10) ORDER BY i) AS part FROM (
    SELECT doc, i, line, name, bool_or(contains(lower(line), name)) OVER (PARTITION BY doc, seg, name ORDER BY i) AS inside
    FROM @{lines}@, (VALUES {names}) v(name)) WHERE inside GROUP BY ALL) parts ON parts.doc = {key} GROUP BY {key})"""


def theme_of(rules: str, name: str) -> str:
    """Scalar subquery over a rules table (theme, ord, kw)."""
    return (f"coalesce((SELECT arg_min(theme, ord) FROM {rules} q WHERE "
            f"regexp_matches(lower({name}), '\\b' || regexp_escape(q.kw) || 's?\\b')), 'Other')")


DEFAULT_RULES = " UNION ALL ".join(
    f"SELECT {lit(t)} AS theme, {i} AS ord, unnest({words(w)}) AS kw"
    for i, (t, w) in enumerate(C.COMPANY_THEME_KEYWORDS.items()))
TEXT_RULES = " UNION ALL ".join(
    f"SELECT {lit(k)} AS kw, {lit(t)} AS theme" for k, t in C.TEXT_THEME_KEYWORDS.items())
TARGET_ROWS = " UNION ALL ".join(
    f"SELECT {lit(t)} AS type_reg, unnest({words(w)}) AS theme" for t, w in C.REG_TYPE_TARGETS.items())


def json_words(value: str) -> str:
    return (f"CASE WHEN json_type({value}) = 'ARRAY' THEN from_json({value}, '[\"VARCHAR\"]') "
            f"ELSE [json_extract_string({value}, '$')] END")


def override_rows(key: str) -> str:
    return (f"SELECT reg_id, k AS name, generate_subscripts(ks, 1) AS pos, {json_words('v')} AS items FROM ("
            f"SELECT reg_id, ks, unnest(ks) AS k, json_extract(cfg, '$.{key}.\"' || unnest(ks) || '\"') AS v FROM ("
            f"SELECT reg_id, cfg, json_keys(cfg, '$.{key}') AS ks FROM @cleaned@ WHERE cfg IS NOT NULL))")


def text_hit_themes(source: str) -> str:
    return f"""SELECT x.reg_id, r.theme FROM ({source}) x JOIN @text_rules@ r ON r.reg_id = x.reg_id AND contains(x.body, r.kw)"""


def targeted(with_measures: bool) -> str:
    sets = [
        "SELECT x.reg_id, t.theme FROM @extracted@ x JOIN @type_rules@ t ON t.reg_id = x.reg_id AND t.type_reg = x.type_reg",
        text_hit_themes("SELECT reg_id, lower(text) AS body FROM @extracted@"),
        text_hit_themes("SELECT reg_id, lower(array_to_string(entities, ' ')) AS body FROM @extracted@")]
    if with_measures:
        sets.append(text_hit_themes("SELECT reg_id, lower(array_to_string(measures, ' ')) AS body FROM @extracted@"))
    return (f"SELECT x.reg_id, x.portfolio_id, coalesce(list_sort(list_distinct(list(u.theme) FILTER (u.theme IS NOT NULL))), "
            f"['Other']) AS themes FROM @extracted@ x LEFT JOIN ({' UNION ALL '.join(sets)}) u ON u.reg_id = x.reg_id GROUP BY ALL")


def drivers(*pairs, default) -> str:
    items = ", ".join(f"CASE WHEN {c} THEN {v} END" for c, v in pairs)
    return f"coalesce(nullif(array_to_string(list_filter([{items}], lambda d: d IS NOT NULL), ', '), ''), {lit(default)})"


def slot(template: str, value: str) -> str:
    head, tail = template.split("{}")
    return f"({lit(head)} || {value} || {lit(tail)})"


def rotation_text() -> str:
    head, mid, tail = map(lit, C.ROTATION_TEXT.split("{}"))
    return f"{head} || from_sector || {mid} || printf('%.2f', trim_weight) || {tail}"


def boundary(name: str) -> str:
    return f"'\\b' || regexp_escape({name}) || '\\b'"


SURFACE = "regexp_replace(lower(company), '^[^a-z0-9_]+|[^a-z0-9_]+$', '', 'g')"
BOOK = "reg_id, portfolio_id"
RISK_ORDER = f"PARTITION BY {BOOK} ORDER BY round(risk_score, 9) DESC, weight DESC, rank, symbol"



def concentration(source: str) -> str:
    return f"""SELECT {BOOK}, risk_theme, sum(weight) AS weight_exposure, avg(risk_score) AS avg_risk, max(risk_score) AS max_risk,
  sum(loss) AS est_loss, count(*) AS n_holdings FROM {source} GROUP BY ALL"""


def safe(source: str) -> str:
    return f"""SELECT c.reg_id, c.portfolio_id, c.risk_theme, c.avg_risk, c.weight_exposure,
  coalesce(array_to_string((list(o.risk_theme ORDER BY round(o.avg_risk, 9), o.risk_theme) FILTER (o.risk_theme IS NOT NULL))[1:3], '|'), '') AS target_sectors
FROM {source} c LEFT JOIN {source} o ON o.reg_id = c.reg_id AND o.portfolio_id = c.portfolio_id
  AND o.risk_theme <> c.risk_theme AND o.avg_risk < 0.30 GROUP BY ALL"""


STEPS = {
    "cleaned": f"""SELECT reg_id, portfolio_id, name, ext, ord, body, CASE WHEN json_valid(block) THEN block END AS cfg,
  CASE ext WHEN 'html' THEN {html('body')} WHEN 'xml' THEN {space("regexp_replace(body, '<[^>]+>', ' ', 'g')")}
  ELSE {space('body')} END AS text
FROM (SELECT *, CASE WHEN regexp_matches(text, {lit(CONFIG)}) THEN regexp_extract(text, {lit(CONFIG)}, 1) END AS block,
  regexp_replace(text, {lit(CONFIG)}, '') AS body FROM @regulation_docs@)""",
    "tokens": f"""SELECT *, regexp_extract_all(masked, '\\w+|\\W+') AS toks FROM (SELECT *, {masked('text')} AS masked FROM @cleaned@)""",
    "extracted": f"""SELECT reg_id, portfolio_id, name, ord, text, cfg,
  {in_order(f'list_concat({GAZETTEER}, {KEYWORDS})')} AS entities, {in_order(f'list_concat({DATES}, {YEARS})')} AS dates,
  {in_order(f'CASE WHEN len({EXACT}) > 0 THEN {EXACT} ELSE {LOOSE} END')} AS measures, len({EXACT}) > 0 AS exact,
  {reg_type('lower(text)')} AS type_reg, {any_in('lower(text)', C.PENALTY_WORDS)} AS penalty_hit,
  {any_in('lower(text)', C.COMPLIANCE_WORDS)} AS compliance_hit FROM @tokens@""",
    "portfolio": """SELECT h.portfolio_id, h.symbol, h.company, h.rank, h.weight, h.price,
  coalesce(f.market_cap, 0) AS market_cap, coalesce(f.revenue, 0) AS revenue, coalesce(f.op_income, 0) AS op_income,
  coalesce(f.net_income, 0) AS net_income, coalesce(f.eps, 0) AS eps, coalesce(f.fcf, 0) AS fcf,
  coalesce(f.op_income / nullif(f.revenue, 0), 0) AS op_margin, coalesce(f.net_income / nullif(f.revenue, 0), 0) AS net_margin
FROM @holdings@ h LEFT JOIN @fundamentals@ f ON h.symbol = f.symbol""",
    "picked": """SELECT ticker, arg_min(name, (NOT (contains(lower(name), '10-k') OR contains(lower(name), '10k')))::int::varchar || name) AS name
FROM @filings@ GROUP BY ticker""",
    "picked_of_every": """SELECT ticker, arg_min(name, (NOT (contains(lower(name), '10-k') OR contains(lower(name), '10k')))::int::varchar || name) AS name
FROM @every_filing@ GROUP BY ticker""",
    "chosen_filings": "SELECT f.* FROM @filings@ f JOIN @picked@ p ON f.ticker = p.ticker AND f.name = p.name",
    "all_lines": text_lines("@filings@", "filing_id"),
    "chosen_lines": text_lines("@chosen_filings@", "ticker"),
    "all_slices": slices("@filings@", "filing_id", "all_lines"),
    "slices": slices("@chosen_filings@", "ticker", "chosen_lines"),
    "all_geography": geography_rows().replace("@slices@", "@all_slices@"),
    "geography": geography_rows(),
    "all_risks": risk_lines().replace("@slices@", "@all_slices@"),
    "risks": risk_lines(),
    "facts": f"""SELECT doc AS ticker, {SUPPLIERS} AS suppliers, {PRODUCTS} AS main_products, {DEPENDENCIES} AS dependencies,
  {CUSTOMERS} AS key_customers, {SITES} AS manufacturing_locations,
  (SELECT list(region ORDER BY seen, ord) FROM @geography@ g WHERE g.doc = s.doc) AS regions,
  (SELECT list(line ORDER BY ord) FROM @risks@ r WHERE r.doc = s.doc) AS risk_factors,
  (SELECT string_agg(region || '=' || share::int, '|' ORDER BY seen, ord) FROM @geography@ g WHERE g.doc = s.doc) AS geographic_exposure
FROM @slices@ s""",
    "company_rules": f"""SELECT x.reg_id, d.theme, d.ord, d.kw FROM @cleaned@ x, ({DEFAULT_RULES}) d
  WHERE NOT EXISTS (SELECT 1 FROM ({override_rows('company_theme_keywords')}) o WHERE o.reg_id = x.reg_id AND o.name = d.theme)
UNION ALL SELECT reg_id, name, coalesce(list_position({words(C.COMPANY_THEME_KEYWORDS)}, name) - 1, 100 + pos), unnest(items)
  FROM ({override_rows('company_theme_keywords')})""",
    "text_rules": f"""SELECT x.reg_id, d.kw, d.theme FROM @cleaned@ x, ({TEXT_RULES}) d
  WHERE NOT EXISTS (SELECT 1 FROM ({override_rows('text_theme_keywords')}) o WHERE o.reg_id = x.reg_id AND list_contains(list_transform(o.items, lambda i: lower(i)), d.kw))
UNION ALL SELECT reg_id, lower(unnest(items)), name FROM ({override_rows('text_theme_keywords')})""",
    "type_rules": f"""SELECT x.reg_id, d.type_reg, d.theme FROM @cleaned@ x, ({TARGET_ROWS}) d
  WHERE NOT EXISTS (SELECT 1 FROM ({override_rows('reg_type_targets')}) o WHERE o.reg_id = x.reg_id AND o.name = d.type_reg)
UNION ALL SELECT reg_id, name, unnest(items) FROM ({override_rows('reg_type_targets')})""",
    "targeted_full": targeted(False),
    "targeted_base": targeted(True),
    "params": f"SELECT reg_id, {', '.join(f'{param(n)} AS p_{n}' for n in C.DEFAULT_PARAMS)} FROM @cleaned@",
    "named": f"""SELECT x.reg_id, x.portfolio_id, p.symbol, p.company, p.rank, p.weight, p.market_cap,
  {theme_of("(SELECT * FROM @company_rules@ c WHERE c.reg_id = x.reg_id)", "p.company")} AS risk_theme,
  least(q.p_measure_intensity_scale * len(x.measures), q.p_measure_intensity_cap) AS intensity,
  CASE WHEN x.penalty_hit THEN q.p_penalty_boost ELSE 0 END AS penalty,
  CASE WHEN x.compliance_hit THEN 0.05::double ELSE 0 END AS compliance,
  regexp_matches(lower(x.text), {boundary('lower(p.symbol)')}) AS symbol_hit,
  regexp_matches(lower(x.text), {boundary(SURFACE)}) AS company_hit,
  q.*
FROM @extracted@ x JOIN @portfolio@ p ON x.portfolio_id = p.portfolio_id JOIN @params@ q ON q.reg_id = x.reg_id""",
    "base_parts": """SELECT n.*, list_contains(t.themes, n.risk_theme) AS theme_hit,
  symbol_hit AND length(symbol) >= greatest(1, trunc(p_ticker_min_len)) AS sym FROM @named@ n JOIN @targeted_base@ t ON t.reg_id = n.reg_id""",
    "base": f"""SELECT *, least(risk_score * p_loss_pct_multiplier, p_max_loss_pct) AS loss_pct FROM (SELECT *,
  least(0.05::double + intensity + CASE WHEN sym OR company_hit THEN p_mention_boost ELSE 0 END
    + CASE WHEN theme_hit THEN p_theme_boost ELSE 0 END + penalty + compliance, 1.0) AS risk_score,
  {drivers(("sym OR company_hit", lit(C.DRIVER_MENTION)), ("theme_hit", slot(C.DRIVER_THEME, 'risk_theme')),
           ("penalty <> 0", lit(C.DRIVER_PENALTY)), ("compliance <> 0", lit(C.DRIVER_COMPLIANCE)),
           default=C.DRIVER_DEFAULT)} AS risk_drivers FROM @base_parts@)""",
    "held_suppliers": """SELECT h.portfolio_id, h.symbol, unnest(f.suppliers) AS supplier FROM @holdings@ h JOIN @facts@ f ON f.ticker = h.symbol""",
    "supplier_hits": """SELECT x.reg_id, s.symbol, count(*) AS n FROM @extracted@ x JOIN @held_suppliers@ s ON s.portfolio_id = x.portfolio_id
  AND contains(lower(x.text), lower(s.supplier)) GROUP BY ALL""",
    "geo_pairs": f"""SELECT x.reg_id, s.symbol, count(*) AS n FROM (SELECT reg_id, portfolio_id, unnest(entities) AS e FROM @extracted@) x
  JOIN @held_suppliers@ s ON s.portfolio_id = x.portfolio_id AND contains(lower(s.supplier), lower(e))
  WHERE {any_in('e', C.SUPPLY_COUNTRIES)} GROUP BY ALL""",
    "region_pairs": f"""SELECT DISTINCT x.reg_id, h.symbol, g.region, g.share, g.seen, g.ord FROM
  (SELECT reg_id, portfolio_id, unnest(entities) AS e FROM @extracted@) x JOIN @holdings@ h ON h.portfolio_id = x.portfolio_id
  JOIN @geography@ g ON g.doc = h.symbol AND contains(lower(e), lower(g.region)) WHERE {any_in('e', C.EXPOSURE_COUNTRIES)}""",
    "finding_scores": """SELECT reg_id, symbol, coalesce(try_cast(json_extract_string(j, '$.impact_direct') AS double), 0) AS d,
  coalesce(try_cast(json_extract_string(j, '$.impact_fournisseurs') AS double), 0) AS s,
  coalesce(try_cast(json_extract_string(j, '$.impact_geographique') AS double), 0) AS g,
  json_extract_string(j, '$.recommandation') AS action, json_extract_string(j, '$.justification') AS reason
FROM (SELECT *, CASE WHEN json_valid(finding) THEN finding END AS j FROM @company_findings@)""",
    "full_parts": """SELECT n.*, f.suppliers, f.regions, list_contains(t.themes, n.risk_theme) AS theme_hit,
  symbol_hit AND length(n.symbol) >= 2 AS sym,
  least(0.20::double * coalesce(sh.n, 0) + 0.10::double * coalesce(gp.n, 0), 0.60::double) AS supply_chain_risk,
  least(coalesce(rp.total, 0), 0.60::double) AS geographic_risk, coalesce((fs.d + fs.s + fs.g) / 300.0::double, 0) AS finding_risk
FROM @named@ n JOIN @targeted_full@ t ON t.reg_id = n.reg_id LEFT JOIN @facts@ f ON f.ticker = n.symbol
LEFT JOIN @supplier_hits@ sh ON sh.reg_id = n.reg_id AND sh.symbol = n.symbol
LEFT JOIN @geo_pairs@ gp ON gp.reg_id = n.reg_id AND gp.symbol = n.symbol
LEFT JOIN (SELECT reg_id, symbol, sum(share / 100 * 0.5::double ORDER BY seen, ord) AS total FROM @region_pairs@ GROUP BY ALL) rp
  ON rp.reg_id = n.reg_id AND rp.symbol = n.symbol
LEFT JOIN @finding_scores@ fs ON fs.reg_id = n.reg_id AND fs.symbol = n.symbol""",
    "full_direct": """SELECT *, least(0.05::double + intensity + CASE WHEN sym THEN p_mention_boost ELSE 0 END
    + CASE WHEN company_hit THEN p_mention_boost * 1.2::double ELSE 0 END
    + CASE WHEN theme_hit THEN p_theme_boost ELSE 0 END + penalty + compliance, 1.0) AS direct_risk FROM @full_parts@""",
    "full_risk": """SELECT *, least(CASE WHEN finding_risk = 0
    THEN direct_risk * 0.45::double + supply_chain_risk * 0.30::double + geographic_risk * 0.25::double + finding_risk * 0.0::double
    ELSE direct_risk * 0.40::double + supply_chain_risk * 0.25::double + geographic_risk * 0.20::double + finding_risk * 0.15::double
    END, 1.0) AS risk_score FROM @full_direct@""",
    "scored": f"""SELECT * EXCLUDE (loss_pct), loss_pct, market_cap * (loss_pct / 100.0::double) AS loss,
  {drivers(("direct_risk > 0.3", lit(C.DRIVER_DIRECT)),
           ("supply_chain_risk > 0.2", slot(C.DRIVER_SUPPLY, 'coalesce(len(suppliers), 0)')),
           ("geographic_risk > 0.2", slot(C.DRIVER_GEOGRAPHIC, "array_to_string(regions[1:3], ', ')")),
           default=C.DRIVER_DEFAULT)} AS risk_drivers
FROM (SELECT *, least(risk_score * p_loss_pct_multiplier, p_max_loss_pct) AS loss_pct FROM @full_risk@)""",
    "concentration": concentration("@scored@"),
    "safe": safe("@concentration@"),
    "base_concentration": concentration("(SELECT *, market_cap * (loss_pct / 100.0::double) AS loss FROM @base@)"),
    "base_safe": safe("@base_concentration@"),
    "ranked": f"SELECT *, row_number() OVER ({RISK_ORDER}) AS position FROM @scored@",
    "reduce": f"""SELECT s.reg_id, s.portfolio_id, row_number() OVER (PARTITION BY s.reg_id, s.portfolio_id ORDER BY round(risk_score, 9) DESC, weight DESC, rank, symbol) AS position,
  CASE WHEN risk_score < 0.75 THEN 'REDUCE' ELSE 'SELL' END AS action, symbol AS ticker, company, weight AS current_weight,
  risk_score, loss / 1e9 AS estimated_loss_billions, risk_drivers AS reason,
  CASE WHEN risk_score > 0.75 THEN 'HIGH' ELSE 'MEDIUM' END AS urgency, coalesce(x.dates[1], {lit(C.NO_DEADLINE)}) AS timeline,
  coalesce(array_to_string(suppliers[1:3], '|'), '') AS suppliers_at_risk
FROM @scored@ s JOIN @extracted@ x ON x.reg_id = s.reg_id WHERE risk_score > 0.60 QUALIFY position <= 10""",
    "hedge": f"""SELECT {BOOK}, row_number() OVER (PARTITION BY {BOOK} ORDER BY weight DESC, rank, symbol) AS position, 'HEDGE' AS action, symbol AS ticker,
  company, {lit(C.HEDGE_STRATEGY)} AS hedge_strategy, -loss_pct AS strike_pct, {lit(C.HEDGE_REASON)} AS reason,
  loss_pct * 0.15::double AS cost_pct, 'MEDIUM' AS urgency FROM @scored@ WHERE risk_score > 0.35 AND risk_score <= 0.60 QUALIFY position <= 5""",
    "rotation": f"""SELECT {BOOK}, 'SECTOR_ROTATION' AS action, risk_theme AS from_sector, avg_risk AS sector_risk, weight_exposure AS sector_weight,
  weight_exposure * 0.25::double AS trim_weight, target_sectors, 'MEDIUM' AS urgency FROM @safe@ WHERE round(avg_risk, 9) > 0.40""",
    "base_rotation": f"""SELECT {BOOK}, 'SECTOR_ROTATION' AS action, risk_theme AS from_sector, avg_risk AS sector_risk, weight_exposure AS sector_weight,
  weight_exposure * 0.25::double AS trim_weight, target_sectors, 'MEDIUM' AS urgency FROM @base_safe@ WHERE round(avg_risk, 9) > 0.40""",
    "monitor": f"""SELECT {BOOK}, 'MONITOR' AS action, {lit(C.MONITOR_TEXT)} AS recommendation, {lit(C.MONITOR_REVIEW)} AS next_review, 'LOW' AS urgency
FROM @scored@ GROUP BY {BOOK} HAVING avg(risk_score) < 0.25""",
    "rules": f"""SELECT {BOOK}, action, position, ticker, NULL AS from_sector, urgency, risk_score, reason, timeline FROM @reduce@
UNION ALL SELECT {BOOK}, action, position, ticker, NULL, urgency, NULL, reason, NULL FROM @hedge@
UNION ALL SELECT {BOOK}, action, NULL, NULL, from_sector, urgency, NULL, NULL, NULL FROM @rotation@
UNION ALL SELECT {BOOK}, action, NULL, NULL, NULL, urgency, NULL, NULL, NULL FROM @monitor@""",
    "supplied": f"""SELECT {BOOK}, pos, json_extract_string(item, '$.action') AS action, json_extract_string(item, '$.justification') AS reason,
  json_extract_string(item, '$.timeline') AS timeline, json_extract_string(item, '$.impact_estime') AS estimated_impact,
  json_extract_string(item, '$.urgence') AS urgency,
  array_to_string(from_json(json_extract(item, '$.tickers_concernes'), '["VARCHAR"]'), '|') AS tickers
FROM (SELECT {BOOK}, unnest(items) AS item, generate_subscripts(items, 1) AS pos FROM (SELECT {BOOK},
  CASE WHEN NOT json_valid(reply) THEN [{lit('{"action": "MONITOR", "tickers_concernes": [], "justification": "' + C.FALLBACK_MONITOR_REASON + '", "timeline": "' + C.FALLBACK_MONITOR_TIMELINE + '", "urgence": "MEDIUM"}')}::JSON]
  WHEN json_type(reply) = 'ARRAY' THEN from_json(reply, '["JSON"]') ELSE [reply::JSON] END AS items FROM @recommendation_replies@))""",
    "portfolio_mean": f"""SELECT {BOOK}, CASE WHEN sum(weight) > 0 THEN sum(risk_score * weight) / sum(weight) ELSE avg(risk_score) END AS portfolio_risk
FROM @scored@ GROUP BY ALL""",
    "zone": f"""SELECT {BOOK}, max(weight) AS max_weight, quantile_cont(weight::double, 0.75) AS weight_q75,
  quantile_cont(risk_score::double, 0.75) AS risk_q75, avg(risk_score) AS mean_risk FROM @scored@ GROUP BY ALL""",
    "reply_parts": """SELECT *, CASE WHEN tail <> '' THEN tail ELSE body END AS raw FROM (SELECT *, regexp_extract(body, '(?s)\\{.*\\}\\s*$') AS tail
  FROM (SELECT *, CASE WHEN fenced <> '' THEN fenced ELSE reply END AS body FROM (SELECT reg_id, reply,
    regexp_extract(reply, '(?is)```(?:json)?\\s*(\\{.*?\\})\\s*```', 1) AS fenced FROM @model_replies@)))""",
    "reply_found": """SELECT *, CASE WHEN reply = '' THEN '{}' WHEN json_valid(raw) AND regexp_matches(ltrim(raw), '^[\\[{]') THEN raw
  WHEN json_valid(regexp_extract(raw, '(?s)\\{.*\\}')) THEN regexp_extract(raw, '(?s)\\{.*\\}') END AS found FROM @reply_parts@""",
    "reg_themes": f"""SELECT reg_id, text, CASE WHEN len(given) > 0 THEN given WHEN len(fallback) > 0 THEN fallback ELSE ['regulatory risk'] END AS themes
FROM (SELECT c.reg_id, c.text, list_filter(list_transform(coalesce(from_json(json_extract(r.found, '$.themes'), '["VARCHAR"]'), []), lambda t: trim(t)), lambda t: t <> '') AS given,
  list_filter({words(C.REPORT_THEMES)}, lambda w: contains(lower(c.text), w)) AS fallback FROM @cleaned@ c JOIN @reply_found@ r ON r.reg_id = c.reg_id)""",
    "filing_passages": """SELECT filing_id * 1000 + pos - 1 AS passage_id, title, url, piece AS passage, len(regexp_extract_all(piece, '\\w+')) AS n_words
FROM (SELECT filing_id, title, url, unnest(ps) AS piece, generate_subscripts(ps, 1) AS pos FROM
  (SELECT *, regexp_extract_all(text, '(?s).{300}\\S{0,100}|.{1,300}') AS ps FROM @filings@ WHERE filing_type = '10-K'))""",
    "theme_hits_p": """SELECT t.theme, p.*, len(regexp_extract_all(lower(p.passage), '\\b' || regexp_escape(lower(t.theme)) || '\\b')) AS tf
FROM (SELECT DISTINCT unnest(themes) AS theme FROM @reg_themes@) t JOIN @filing_passages@ p
  ON regexp_matches(lower(p.passage), '\\b' || regexp_escape(lower(t.theme)) || '\\b')""",
    "theme_scores": """SELECT h.theme, h.passage_id, title, url, passage, ln(1 + (s.n - d.df + 0.5) / (d.df + 0.5)) * tf * 2.2
  / (tf + 1.2 * (1 - 0.75 + 0.75 * n_words / s.avg_words)) AS score
FROM @theme_hits_p@ h JOIN (SELECT theme, count(*) AS df FROM @theme_hits_p@ GROUP BY ALL) d ON d.theme = h.theme,
  (SELECT count(*) AS n, avg(n_words) AS avg_words FROM @filing_passages@) s""",
    "theme_snippets": """SELECT t.theme, position, title, url, substr(passage, 1, 1500) AS excerpt, score,
  CASE WHEN position IS NULL THEN 'no passage found' END AS error
FROM (SELECT DISTINCT unnest(themes) AS theme FROM @reg_themes@) t LEFT JOIN
  (SELECT *, row_number() OVER (PARTITION BY theme ORDER BY round(score, 9) DESC, passage_id) AS position FROM @theme_scores@ QUALIFY position <= 5) b
  ON b.theme = t.theme""",
    "exposed": f"""SELECT reg_id, company, sum(score) AS total_score, count(*) AS n_snippets,
  (list(excerpt ORDER BY round(score, 9) DESC, url, excerpt))[1] AS exposure_reason,
  row_number() OVER (PARTITION BY reg_id ORDER BY round(sum(score), 9) DESC, company) AS position
FROM (SELECT r.reg_id, s.url, s.excerpt, max(s.score) AS score FROM (SELECT reg_id, unnest(themes) AS theme FROM @reg_themes@) r
  JOIN @theme_snippets@ s ON s.theme = r.theme WHERE s.excerpt IS NOT NULL GROUP BY ALL) e
JOIN (SELECT DISTINCT company FROM @holdings@) h ON regexp_matches(lower(e.excerpt), {boundary(SURFACE)})
GROUP BY reg_id, company QUALIFY position <= 5""",
}

EXPOSURE = "geographic_exposure"
FACT_COLUMNS = f"""{bars('suppliers')} AS suppliers, {bars('risk_factors')} AS risk_factors, {bars('main_products')} AS main_products,
  {bars('dependencies')} AS dependencies, {bars('key_customers')} AS key_customers, {bars('manufacturing_locations')} AS manufacturing_locations"""


def fact(column: str, expression: str) -> str:
    return f"SELECT doc AS filing_id, {bars(expression)} AS {column} FROM @all_slices@"


def score(*columns: str) -> str:
    return f"SELECT reg_id, symbol, {', '.join(f'round({c}, 6) AS {c}' for c in columns)} FROM @scored@"


CORRELATED = ["risk_score", "direct_risk", "supply_chain_risk", "geographic_risk", "weight", "loss_pct"]
DEADLINE = """list_min(list_transform(dates, lambda d: coalesce(try_strptime(d, '%Y-%m-%d'), try_strptime(d, '%m/%d/%Y'),
  try_strptime(regexp_replace(regexp_replace(d, '^through ', ''), '^([A-Za-z]{3})[a-z]*\\.?', '\\1'), '%b %d, %Y'))))"""

ORACLES = {
    "holdings_load": "SELECT rank, company, symbol, weight, round(price, 2) AS price, portfolio_id FROM @holdings@",
    "fundamentals_load": """SELECT symbol, company_name, round(market_cap) AS market_cap, revenue, op_income::decimal(20,8)::double AS op_income,
  CASE WHEN eps = 1 THEN 0 ELSE net_income END AS net_income, eps, fcf FROM @fundamentals@""",
    "filing_pick": "SELECT ticker, name FROM @picked_of_every@",
    "reg_docs_load": f"""SELECT name, ext, {space('text')} AS text FROM @regulation_docs@
UNION ALL SELECT 'Manual Input', 'txt', {space('reply')} FROM @model_replies@ WHERE trim(reply) <> ''""",
    "reg_concat": """SELECT portfolio_id, reg_id, length(text) AS n_chars,
  coalesce(sum(length(text) + 1) OVER (PARTITION BY portfolio_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_pos
FROM @regulation_docs@""",
    "reg_corpus": f"""SELECT x.portfolio_id, {reg_type("lower(string_agg(text, ' ' ORDER BY ord))")} AS type_reg,
  bool_or(penalty_hit) AS penalty_hit, bool_or(compliance_hit) AS compliance_hit, count(*) AS n_docs,
  {bars(in_order('flatten(list(entities))'))} AS entities, {bars(in_order('flatten(list(dates))'))} AS dates,
  {bars(in_order('flatten(CASE WHEN bool_or(exact) THEN list(measures) FILTER (exact) ELSE list(measures) END)'))} AS measures
FROM @extracted@ x GROUP BY x.portfolio_id""",
    "facts_roundtrip": f"SELECT ticker, {FACT_COLUMNS}, coalesce({EXPOSURE}, '') AS {EXPOSURE} FROM (SELECT * REPLACE (coalesce(risk_factors, []) AS risk_factors) FROM @facts@)",
    "decimal_comma_cast": "SELECT symbol, weight, round(price, 2) AS price FROM @holdings@",
    "strip_clean": "SELECT symbol, company, '\"' || company || '\"' AS stripped FROM @holdings@",
    "numeric_coerce": """SELECT symbol, round(market_cap) AS market_cap, revenue, op_income::decimal(20,8)::double AS op_income,
  CASE WHEN eps = 1 THEN 0 ELSE net_income END AS net_income, eps, fcf FROM @fundamentals@""",
    "margins": """SELECT symbol, round(op_income / nullif(revenue, 0), 6) AS op_margin, round(net_income / nullif(revenue, 0), 6) AS net_margin
FROM @fundamentals@""",
    "portfolio_merge": """SELECT portfolio_id, symbol, company, weight, price, market_cap, revenue, op_income, net_income, eps, fcf,
  round(op_margin, 6) AS op_margin, round(net_margin, 6) AS net_margin, 0.0::double AS risk_score, 0.0::double AS loss_pct, 0.0::double AS loss
FROM @portfolio@""",
    "risk_bands": """SELECT reg_id, symbol, round(risk_score, 6) AS risk_score, CASE WHEN risk_score > 0.60 THEN 'high'
  WHEN risk_score > 0.35 THEN 'medium' WHEN risk_score > 0 THEN 'low' ELSE 'none' END AS band FROM @scored@""",
    "html_clean": f"SELECT page_id, {html('html')} AS text FROM pages",
    "html_strip_simple": "SELECT page_id, " + space(
        "regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '&[^;]+;', ' ', 'g')") + " AS text FROM pages",
    "xml_text": "SELECT reg_id, text FROM @cleaned@ WHERE ext = 'xml'",
    "whitespace_norm": f"SELECT doc_id, {space('text')} AS text FROM documents",
    "inline_config": f"""SELECT reg_id, {param('mention_boost')} AS mention_boost, {param('loss_pct_multiplier')} AS loss_pct_multiplier,
  {param('max_loss_pct')} AS max_loss_pct, body FROM @cleaned@""",
    "config_overlay": f"""SELECT b.reg_id, b.symbol, b.risk_theme, {bars('t.themes')} AS targeted_themes FROM @base@ b
  JOIN @targeted_base@ t ON t.reg_id = b.reg_id""",
    "mask_citations": "SELECT reg_id, masked AS text FROM @tokens@",
    "date_mentions": "SELECT reg_id, unnest(dates) AS date FROM @extracted@",
    "context_years": f"SELECT reg_id, {bars(in_order(YEARS))} AS years FROM @tokens@",
    "entity_gazetteer": f"SELECT reg_id, {bars(in_order(GAZETTEER))} AS entities FROM @cleaned@",
    "entity_keywords": f"SELECT reg_id, {bars(in_order(KEYWORDS))} AS entities FROM @cleaned@",
    "measure_phrases": f"SELECT reg_id, {bars(in_order(EXACT))} AS measures FROM @cleaned@",
    "measure_fallback": f"SELECT reg_id, {bars(in_order(LOOSE))} AS measures FROM @cleaned@",
    "regulation_type": f"SELECT doc_id, {reg_type('lower(text)')} AS type_reg FROM documents",
    "company_theme": f"SELECT symbol, {theme_of(f'({DEFAULT_RULES})', 'company')} AS theme FROM @holdings@",
    "text_themes": """SELECT doc_id, array_to_string(list_sort(list_filter([CASE WHEN contains(lower(text), 'the') THEN 'Common' END,
  CASE WHEN contains(lower(text), 'tion') THEN 'Suffix' END, CASE WHEN contains(lower(text), 'ung') THEN 'German' END,
  CASE WHEN contains(lower(text), 'ai') THEN 'Technology' END, CASE WHEN contains(lower(text), 'eau') THEN 'French' END,
  CASE WHEN contains(lower(text), 'zzz') THEN 'Never' END], lambda t: t IS NOT NULL)), '|') AS themes FROM documents""",
    "targeted_themes": f"SELECT reg_id, {bars('themes')} AS targeted_themes FROM @targeted_full@",
    "passages": """SELECT doc_id, generate_subscripts(ps, 1) - 1 AS passage_no, unnest(ps) AS passage FROM
  (SELECT doc_id, regexp_extract_all(text, '(?s).{300}[^\\s\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]{0,100}|.{1,300}') AS ps FROM documents)""",
    "reg_extract": f"""SELECT reg_id, type_reg, {bars('entities')} AS entities, {bars('dates')} AS dates, {bars('measures')} AS measures,
  penalty_hit, compliance_hit FROM @extracted@""",
    "reg_digest": f"""SELECT reg_id, name, type_reg, len(entities) AS n_entities, len(dates) AS n_dates, len(measures) AS n_measures,
  {bars('entities[1:15]')} AS top_entities, {bars('dates[1:10]')} AS top_dates FROM @extracted@""",
    "measure_freq": """SELECT measure, count(*) AS occurrences FROM (SELECT unnest(measures) AS measure FROM @extracted@) GROUP BY ALL
ORDER BY occurrences DESC, measure LIMIT 10""",
    "section_slice": f"""SELECT filing_id, {section('supply chain', 120)} AS supply, {section('customers', 120)} AS customers,
  {section('form 10-k', 120)} AS "first", {section('no such heading', 120)} AS absent FROM @every_filing@""",
    "filing_sections": """SELECT doc AS filing_id, cast(seg AS int) AS number, CASE WHEN arg_min(h, i) THEN trim(arg_min(line, i), chr(32) || chr(9) || chr(13)) END AS heading,
  cast(min(place) AS int) AS "start", cast(max(place + n) AS int) AS "end"
FROM (SELECT *, coalesce(sum(n + 1) OVER (PARTITION BY doc ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place FROM @all_lines@) GROUP BY doc, seg""",
    "filing_suppliers": fact("suppliers", SUPPLIERS),
    "filing_geography": "SELECT doc AS filing_id, region, share FROM @all_geography@",
    "filing_risks": "SELECT doc AS filing_id, line AS risk_factor FROM @all_risks@",
    "filing_products": fact("main_products", PRODUCTS),
    "filing_dependencies": fact("dependencies", DEPENDENCIES),
    "filing_customers": fact("key_customers", CUSTOMERS),
    "filing_sites": fact("manufacturing_locations", SITES),
    "filing_facts": f"""SELECT h.symbol, coalesce({bars('suppliers')}, '') AS suppliers, coalesce({bars('risk_factors')}, '') AS risk_factors,
  coalesce({bars('main_products')}, '') AS main_products, coalesce({bars('dependencies')}, '') AS dependencies,
  coalesce({bars('key_customers')}, '') AS key_customers, coalesce({bars('manufacturing_locations')}, '') AS manufacturing_locations,
  coalesce({EXPOSURE}, '') AS {EXPOSURE} FROM @holdings@ h LEFT JOIN @facts@ f ON f.ticker = h.symbol""",
    "exposure_rank": """SELECT doc AS ticker, row_number() OVER (PARTITION BY doc ORDER BY share DESC, region) AS rank, region, share FROM @geography@""",
    "mention_symbol": f"""SELECT x.reg_id, h.symbol FROM @cleaned@ x JOIN @holdings@ h ON h.portfolio_id = x.portfolio_id
  AND regexp_matches(lower(x.text), {boundary('lower(h.symbol)')})""",
    "mention_company": f"""SELECT x.reg_id, h.symbol FROM @cleaned@ x JOIN @holdings@ h ON h.portfolio_id = x.portfolio_id
  AND regexp_matches(lower(x.text), {boundary(SURFACE)})""",
    "theme_hits": f"""SELECT t.reg_id, h.symbol, h.theme AS risk_theme FROM @targeted_full@ t JOIN
  (SELECT *, {theme_of(f'({DEFAULT_RULES})', 'company')} AS theme FROM @holdings@) h ON h.portfolio_id = t.portfolio_id AND list_contains(t.themes, h.theme)""",
    "supplier_mentions": "SELECT reg_id, symbol, n AS supplier_hits FROM @supplier_hits@",
    "supplier_geo_pairs": "SELECT reg_id, symbol, n AS geo_pairs FROM @geo_pairs@",
    "region_hits": "SELECT reg_id, symbol, region, share FROM @region_pairs@",
    "safe_themes": "SELECT reg_id, risk_theme, target_sectors FROM @base_safe@",
    "safe_themes_blended": "SELECT reg_id, risk_theme, target_sectors FROM @safe@",
    "model_findings_join": f"""SELECT r.reg_id, h.symbol, coalesce(f.d, 0) AS impact_direct, coalesce(f.s, 0) AS impact_suppliers, coalesce(f.g, 0) AS impact_geographic,
  coalesce(f.action, 'HOLD') AS action, coalesce(f.reason, {lit(C.FINDING_UNAVAILABLE)}) AS reason FROM @regulation_docs@ r
  JOIN @holdings@ h ON h.portfolio_id = r.portfolio_id LEFT JOIN @finding_scores@ f ON f.reg_id = r.reg_id AND f.symbol = h.symbol""",
    "supply_findings": """SELECT symbol, coalesce(json_extract_string(j, '$.risk_level'), 'unknown') AS risk_level,
  json_extract_string(j, '$.risk_score')::int AS risk_score,
  coalesce(array_to_string(from_json(json_extract(j, '$.affected_suppliers'), '["VARCHAR"]'), '|'), '') AS suppliers,
  json_extract_string(j, '$.geographic_risks.China') AS china_risk
FROM (SELECT symbol, CASE WHEN json_valid(finding) THEN finding END AS j FROM @supply_findings@)""",
    "measure_intensity": """SELECT x.reg_id, round(least(p_measure_intensity_scale * len(measures), p_measure_intensity_cap), 6) AS intensity
FROM @extracted@ x JOIN @params@ p ON p.reg_id = x.reg_id""",
    "base_risk": "SELECT reg_id, symbol, risk_theme, round(risk_score, 6) AS risk_score FROM @base@",
    "direct_risk": score("direct_risk"),
    "supply_chain_risk": score("supply_chain_risk"),
    "geographic_risk": score("geographic_risk"),
    "model_risk": score("finding_risk"),
    "blended_risk": score("risk_score"),
    "loss_estimate": "SELECT reg_id, symbol, round(loss_pct, 6) AS loss_pct, round(loss / 1e9, 6) AS loss FROM @scored@",
    "risk_drivers": "SELECT reg_id, symbol, risk_drivers FROM @base@",
    "risk_drivers_full": "SELECT reg_id, symbol, risk_drivers FROM @scored@",
    "extraction_merge": f"""SELECT x.reg_id, CASE WHEN f.reg_id IS NULL THEN type_reg WHEN NOT json_valid(finding) THEN 'Unknown'
    ELSE coalesce(json_extract_string(j, '$.type_regulation'), type_reg) END AS type_reg,
  {bars(in_order("list_concat(entities, coalesce(from_json(json_extract(j, '$.entreprises_a_risque'), '[\"VARCHAR\"]'), []))"))} AS entities,
  {bars(in_order("list_concat(dates, coalesce(from_json(json_extract(j, '$.dates_cles'), '[\"VARCHAR\"]'), []))"))} AS dates,
  {bars(in_order("list_concat(measures, coalesce(from_json(json_extract(j, '$.mesures'), '[\"VARCHAR\"]'), []))"))} AS measures,
  CASE WHEN f.reg_id IS NULL THEN NULL WHEN j IS NULL THEN 0 ELSE coalesce(json_extract_string(j, '$.severite')::int, 5) END AS severity,
  CASE WHEN f.reg_id IS NULL THEN NULL WHEN j IS NULL THEN {lit(C.FINDING_NO_SUMMARY)} ELSE coalesce(json_extract_string(j, '$.resume'), '') END AS summary,
  f.reg_id IS NOT NULL AND f.error IS NULL AS enabled, f.error
FROM @extracted@ x LEFT JOIN (SELECT *, CASE WHEN json_valid(finding) THEN finding END AS j FROM @regulation_findings@) f ON f.reg_id = x.reg_id""",
    "portfolio_risk": f"SELECT {BOOK}, round(portfolio_risk, 6) AS portfolio_risk FROM @portfolio_mean@",
    "theme_concentration": f"""SELECT {BOOK}, risk_theme, round(weight_exposure, 6) AS weight_exposure, round(avg_risk, 6) AS avg_risk,
  round(max_risk, 6) AS max_risk, round(est_loss / 1e9, 6) AS est_loss, n_holdings FROM @concentration@""",
    "portfolio_summary": f"""SELECT s.reg_id, s.portfolio_id, round(m.portfolio_risk, 6) AS portfolio_risk, round(sum(market_cap) / 1e9, 6) AS total_market_cap,
  round(sum(loss) / 1e9, 6) AS total_loss, (SELECT count(*) FROM @concentration@ c WHERE c.reg_id = s.reg_id) AS n_themes,
  (SELECT string_agg(risk_theme || ':' || n_holdings, '|' ORDER BY weight_exposure DESC, risk_theme) FROM @concentration@ c WHERE c.reg_id = s.reg_id) AS themes
FROM @scored@ s JOIN @portfolio_mean@ m ON m.reg_id = s.reg_id GROUP BY ALL""",
    "kpis": f"""SELECT {BOOK}, round(avg(risk_score), 6) AS avg_risk, round(sum(loss) / 1e9, 6) AS total_loss,
  count(*) FILTER (risk_score > 0.60) AS n_high_risk FROM @scored@ GROUP BY ALL""",
    "dominant_theme": f"""SELECT {BOOK}, risk_theme AS dominant_theme FROM @concentration@
QUALIFY row_number() OVER (PARTITION BY {BOOK} ORDER BY weight_exposure DESC, risk_theme) = 1""",
    "risk_stats": f"""SELECT {BOOK}, round(avg(risk_score), 6) AS mean_risk, round(quantile_cont(risk_score::double, 0.5), 6) AS median_risk
FROM @scored@ GROUP BY ALL""",
    "attention_zone": f"""SELECT {BOOK}, round(max_weight, 6) AS max_weight, round(weight_q75, 6) AS weight_q75, round(risk_q75, 6) AS risk_q75 FROM @zone@""",
    "risk_histogram": f"""SELECT {BOOK}, least(floor(risk_score * 25)::int + 1, 25) AS bin, count(*) AS n,
  (least(floor(risk_score * 25)::int + 1, 25) - 1) / 25.0::double AS lower FROM @scored@ GROUP BY ALL""",
    "risk_correlation": f"""SELECT {BOOK}, a.m AS metric_a, b.m AS metric_b,
  CASE WHEN max(a.v) > min(a.v) AND max(b.v) > min(b.v) THEN round(corr(a.v, b.v), 4) END AS corr
FROM (UNPIVOT (SELECT {BOOK}, symbol, {', '.join(f'{c}::double AS {c}' for c in CORRELATED)} FROM @scored@) ON {', '.join(CORRELATED)} INTO NAME m VALUE v) a
JOIN (UNPIVOT (SELECT reg_id, symbol, {', '.join(f'{c}::double AS {c}' for c in CORRELATED)} FROM @scored@) ON {', '.join(CORRELATED)} INTO NAME m VALUE v) b
USING (reg_id, symbol) GROUP BY ALL""",
    "market_snapshot": """SELECT count(*) AS n_holdings, round(sum(market_cap) / 1e9, 6) AS total_market_cap,
  array_to_string((list(symbol ORDER BY weight DESC, symbol))[1:10], '|') AS sample FROM @portfolio@""",
    "top_risks": "SELECT reg_id, position, symbol, round(risk_score, 6) AS risk_score FROM @ranked@ WHERE position <= 15",
    "top_impacted": f"""SELECT {BOOK}, symbol, company, round(risk_score, 6) AS risk_score, round(direct_risk, 6) AS direct_risk,
  round(supply_chain_risk, 6) AS supply_chain_risk, round(geographic_risk, 6) AS geographic_risk, round(loss_pct, 6) AS loss_pct,
  round(loss / 1e9, 6) AS loss, position FROM @ranked@ WHERE position <= 10 AND risk_score > 0""",
    "next_deadline": f"SELECT reg_id, dates[1] AS first_date, strftime({DEADLINE}, '%Y-%m-%d') AS next_deadline FROM @extracted@",
    "recommendations": "SELECT reg_id, action, position, ticker, from_sector, urgency, round(risk_score, 6) AS risk_score FROM @rules@",
    "portfolio_advice": f"""SELECT reg_id, generate_subscripts(lines, 1) - 1 AS pos, unnest(lines) AS advice FROM (
  SELECT reg_id, CASE WHEN len(rules) > 0 THEN rules ELSE [{slot(C.ADVICE_WATCH, 'dominant')}] END AS lines FROM (
  SELECT b.reg_id, list_filter([CASE WHEN b.risk > 0.5 THEN {lit(C.ADVICE_REBALANCE)} END,
    CASE WHEN list_contains(t.themes, 'Technology') THEN {lit(C.ADVICE_TECHNOLOGY)} END,
    CASE WHEN list_contains(t.themes, 'Energy') THEN {lit(C.ADVICE_ENERGY)} END,
    CASE WHEN len(x.dates) > 0 THEN {slot(C.ADVICE_DEADLINE, 'x.dates[1]')} END], lambda r: r IS NOT NULL) AS rules, d.dominant
  FROM (SELECT reg_id, CASE WHEN sum(weight) > 0 THEN sum(risk_score * weight) / sum(weight) ELSE avg(risk_score) END AS risk FROM @base@ GROUP BY ALL) b
  JOIN (SELECT reg_id, risk_theme AS dominant FROM (SELECT reg_id, risk_theme, sum(weight) AS w FROM @base@ GROUP BY ALL)
    QUALIFY row_number() OVER (PARTITION BY reg_id ORDER BY w DESC, risk_theme) = 1) d ON d.reg_id = b.reg_id
  JOIN @targeted_base@ t ON t.reg_id = b.reg_id JOIN @extracted@ x ON x.reg_id = b.reg_id))""",
    "reco_reduce": "SELECT * REPLACE (round(risk_score, 6) AS risk_score, round(estimated_loss_billions, 6) AS estimated_loss_billions) FROM @reduce@",
    "reco_hedge": "SELECT * REPLACE (round(strike_pct, 6) AS strike_pct, round(cost_pct, 6) AS cost_pct) FROM @hedge@",
    "reco_rotation": """SELECT * REPLACE (round(sector_risk, 6) AS sector_risk, round(sector_weight, 6) AS sector_weight,
  round(trim_weight, 6) AS trim_weight) FROM @base_rotation@""",
    "reco_rotation_blended": """SELECT * REPLACE (round(sector_risk, 6) AS sector_risk, round(sector_weight, 6) AS sector_weight,
  round(trim_weight, 6) AS trim_weight) FROM @rotation@""",
    "reco_monitor": "SELECT * FROM @monitor@",
    "reco_override": """SELECT reg_id, action, position, ticker, NULL AS tickers, reason, timeline, NULL AS estimated_impact, urgency FROM @rules@
  WHERE reg_id NOT IN (SELECT reg_id FROM @supplied@)
UNION ALL SELECT reg_id, action, pos, NULL, tickers, reason, timeline, estimated_impact, urgency FROM @supplied@""",
    "reco_display": f"""SELECT {BOOK}, company, ticker, risk_score, action, coalesce(comment, {lit(C.NO_COMMENT)}) AS comment, estimated_loss_billions FROM (
  SELECT {BOOK}, company, ticker, round(risk_score, 6) AS risk_score, action, reason AS comment, round(estimated_loss_billions, 6) AS estimated_loss_billions FROM @reduce@
  UNION ALL SELECT {BOOK}, company, ticker, NULL, action, reason, NULL FROM @hedge@
  UNION ALL SELECT {BOOK}, NULL, NULL, NULL, action, {rotation_text()}, NULL FROM @rotation@
  UNION ALL SELECT {BOOK}, NULL, NULL, NULL, action, recommendation, NULL FROM @monitor@)
WHERE reg_id NOT IN (SELECT reg_id FROM @supplied@)
UNION ALL SELECT {BOOK}, NULL, NULL, NULL, action, coalesce(reason, {lit(C.NO_COMMENT)}), NULL FROM @supplied@""",
    "scenario_losses": f"""SELECT {BOOK}, scenario, round(sum(loss) / 1e12 * factor, 6) AS loss_trillions FROM @scored@,
  (VALUES {', '.join(f'({lit(n)}, {f}::double)' for n, f in C.SCENARIOS)}) v(scenario, factor) GROUP BY {BOOK}, scenario, factor""",
    "chart_risk_weight": f"""SELECT s.reg_id, s.portfolio_id, symbol, company, risk_theme, round(weight, 6) AS weight, round(risk_score, 6) AS risk_score,
  round(market_cap / 1e9, 6) AS market_cap, round(loss_pct, 6) AS loss_pct, round(z.mean_risk, 6) AS mean_risk,
  weight >= weight_q75 AND risk_score >= risk_q75 AS in_zone FROM @scored@ s JOIN @zone@ z ON z.reg_id = s.reg_id""",
    "chart_concentration": f"""SELECT {BOOK}, risk_theme, round(weight_exposure, 6) AS weight_exposure, round(avg_risk * 100, 6) AS avg_risk_pct FROM @concentration@""",
    "chart_top_risks": f"""SELECT {BOOK}, position, symbol, company, round(risk_score, 6) AS risk_score, risk_drivers,
  CASE WHEN risk_score > 0.7 THEN 'critical' WHEN risk_score > 0.5 THEN 'elevated' ELSE 'moderate' END AS tier, 0.60::double AS critical_line
FROM @ranked@ WHERE position <= 20""",
    "chart_losses": f"""SELECT {BOOK}, row_number() OVER (PARTITION BY {BOOK} ORDER BY loss DESC, weight DESC, rank, symbol) AS position, symbol, company,
  round(loss / 1e9, 6) AS loss_billions, round(loss_pct, 6) AS loss_pct FROM @scored@ QUALIFY position <= 15""",
    "chart_components": " UNION ALL ".join(
        f"SELECT {BOOK}, position, symbol, '{c}' AS component, round({c}, 6) AS value FROM @ranked@ WHERE position <= 10"
        for c in ("direct_risk", "supply_chain_risk", "geographic_risk")),
    "chart_geography": f"""SELECT {BOOK}, symbol, g.region, g.share AS exposure FROM @ranked@ r JOIN @geography@ g ON g.doc = r.symbol WHERE position <= 15""",
    "chart_timeline": f"""SELECT reg_id, unnest(dates[1:10]) AS date, {slot(C.TIMELINE_LABEL, 'generate_subscripts(dates[1:10], 1)::varchar')} AS event FROM @extracted@""",
    "report_themes": f"SELECT reg_id, {bars('themes')} AS themes FROM @reg_themes@",
    "attribute_filter": """SELECT filing_id, ticker, filing_type, fiscal_year FROM @every_filing@ WHERE filing_type = '10-K' AND fiscal_year = 1997""",
    "filing_store": """SELECT filing_id, ticker, filing_type, fiscal_year, length(text) AS n_chars FROM @filings@
  WHERE filing_type = '10-K' AND fiscal_year = 1997""",
    "passage_topk": "SELECT * REPLACE (round(score, 6) AS score) FROM @theme_snippets@",
    "exposed_companies": "SELECT * REPLACE (round(total_score, 6) AS total_score) FROM @exposed@",
    "reply_json": """SELECT reg_id, found AS json, CASE WHEN found IS NULL THEN body END AS raw_response,
  CASE WHEN found IS NULL THEN 'json_parse_failed' END AS error FROM @reply_found@""",
    "exposure_report": """SELECT c.reg_id, CASE WHEN coalesce(c.text, '') = '' THEN 400 ELSE 200 END AS status_code,
  CASE WHEN coalesce(c.text, '') = '' THEN 'Missing regulation_text' END AS error,
  CASE WHEN coalesce(c.text, '') <> '' THEN coalesce((SELECT string_agg(company, '|' ORDER BY position) FROM @exposed@ e WHERE e.reg_id = c.reg_id), '') END AS companies,
  CASE WHEN coalesce(c.text, '') <> '' THEN (SELECT count(*) FROM @portfolio@) END AS n_holdings FROM @report_requests@ c""",
}


# Every regulation copied to every portfolio it concerns, under a name of its own: what one extraction must equal.
COPIED = {
    "own_docs": FIXTURES["regulation_docs"],
    "coverage": FIXTURES["coverage"],
    "regulation_docs": """SELECT * REPLACE (d.reg_id || '@' || c.portfolio_id AS reg_id, c.portfolio_id AS portfolio_id)
FROM @own_docs@ d JOIN @coverage@ c ON c.reg_id = d.reg_id""",
    "company_findings": "SELECT '' AS reg_id, '' AS symbol, '' AS finding WHERE false",
}
COVERED = {
    "coverage_risk": """SELECT split_part(reg_id, '@', 1) AS reg_id, portfolio_id, symbol, risk_theme, round(direct_risk, 6) AS direct_risk,
  round(supply_chain_risk, 6) AS supply_chain_risk, round(geographic_risk, 6) AS geographic_risk, round(risk_score, 6) AS risk_score FROM @scored@""",
    "coverage_themes": """SELECT split_part(reg_id, '@', 1) AS reg_id, portfolio_id, risk_theme, round(weight_exposure, 6) AS weight_exposure,
  round(avg_risk, 6) AS avg_risk, round(max_risk, 6) AS max_risk, n_holdings FROM @concentration@""",
}


def with_steps(sql: str, instead: dict[str, str] | None = None) -> str:
    """Prefix a statement with the steps and inputs it needs, as CTEs; ``instead`` takes the place of some."""
    parts = {**FIXTURES, **STEPS, **(instead or {})}
    order: list[str] = []

    def visit(text):
        for name in parts:
            if f"@{name}@" in text and name not in order:
                visit(parts[name])
                order.append(name)

    def plain(text):
        for name in [*TABLES, *parts]:
            text = text.replace(f"@{name}@", name)
        return text

    visit(sql)
    # Materialised: the second engine would otherwise expand shared steps anew.
    ctes = ",\n".join(f"{n} AS MATERIALIZED ({plain(parts[n])})" for n in order)
    return (f"WITH {ctes}\n" if ctes else "") + plain(sql)


# Six-decimal results carry the same tie-breaking offset as the Spark side.
SIX = re.compile(r"round\(((?:[^()]|\((?:[^()]|\([^()]*\))*\))*), 6\)")


def oracle_queries() -> dict[str, str]:
    def shifted(sql):
        return SIX.sub(r"round((\1) + 3e-10::double, 6)", sql)

    return ({name: with_steps(shifted(sql)) for name, sql in ORACLES.items()}
            | {name: with_steps(shifted(sql), COPIED) for name, sql in COVERED.items()})
