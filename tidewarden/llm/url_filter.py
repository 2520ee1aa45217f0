"""URL rules found through their rarest literal token.

Every rule is a regular expression with literal tokens that each matching URL holds
whole.  Token frequencies are counted over all URLs; a rule is filed under its rarest
token.  URLs are cut into tokens, tokens fetch the rules filed under them by an equality
join, and only fetched rules run their expressions.  A verdict depends on the URL
alone, so equal URLs are judged once.  Built-in functions only.
"""

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

#: (verdict, host, path): fits the host and its subdomains where the path starts so.
SITE_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
              ("block", "net", "/es/"), ("block", "net", "/fr/")]
#: Whole words of a URL, and endings of its path, that no training page has.
BLOCKED_WORDS = ["casino", "poker", "porn", "xxx", "viagra", "torrent", "warez", "login", "signin", "logout", "cart",
                 "checkout", "unsubscribe"]
BLOCKED_ENDINGS = ["exe", "zip", "gz", "tar", "rar", "iso", "dmg", "mp3", "mp4", "avi", "jpg", "jpeg", "png", "gif"]
#: Verdict where no rule fits.
OTHERWISE = "allow"

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SCHEMA = "rule string, verdict string, site boolean, rank int, host_size int, pattern string, literals array<string>"


@dataclass(frozen=True)
class Rule:
    """``site`` rules are matched with host and path and come first; others with the lower-cased URL.

    Among fitting rules of a kind the largest ``rank`` wins, then ``host_size``, then a block.
    ``literals``: lower-case runs of a-z and 0-9 that every match has as whole tokens.
    """

    rule: str
    verdict: str
    pattern: str
    literals: tuple[str, ...]
    site: bool = False
    rank: int = 0
    host_size: int = field(default=0)


def site_rule(verdict: str, host: str, path: str) -> Rule:
    """A (host, path) rule; the last run of a path that doesn't end it is no whole token."""
    host = host.translate(str.maketrans(_UPPER, _LOWER))
    whole = path if not path or re.search(r"[^A-Za-z0-9]$", path) else re.sub(r"[A-Za-z0-9]+$", "", path)
    return Rule(host + path, verdict, rf"^(?:[^/]*\.)?{re.escape(host)}{re.escape(path)}",
                tuple(_tokens(f"{host} {whole}")), True, len(host + path), len(host))


def word_rule(word: str, verdict: str = "block") -> Rule:
    return Rule(f"word {word}", verdict, rf"(?:^|[^a-z0-9]){word}(?:[^a-z0-9]|$)", (word,), rank=len(word))


def ending_rule(ending: str, verdict: str = "block") -> Rule:
    return Rule(f"ending {ending}", verdict, rf"^[^?#]*\.{ending}(?:[?#]|$)", (ending,), rank=len(ending))


def default_rules() -> list[Rule]:
    return [*(site_rule(*r) for r in SITE_RULES), *map(word_rule, BLOCKED_WORDS), *map(ending_rule, BLOCKED_ENDINGS)]


def _tokens(text: str) -> list[str]:
    return sorted({t for t in re.split(r"[^a-z0-9]+", text.translate(str.maketrans(_UPPER, _LOWER))) if t})


def _lowered(column):
    return F.translate(column, _UPPER, _LOWER)


def with_parts(urls: DataFrame) -> DataFrame:
    """``url`` with its host and path: both empty where there is no "://"."""
    at = F.locate("://", F.col("url"))
    rest = F.when(at > 0, F.expr("substring(url, locate('://', url) + 3)")).otherwise("")
    return (urls.withColumn("rest", rest)
            .select("url", _lowered(F.regexp_extract("rest", r"^[^/?#]*", 0)).alias("host"),
                    F.regexp_extract("rest", r"^[^/?#]*([^?#]*)", 1).alias("path")))


def judged_urls(urls: DataFrame, rules: list[Rule]) -> DataFrame:
    """(url, rule, verdict, site) of the winning rule, for distinct non-null URLs that a rule fits."""
    if bare := [r.rule for r in rules if not r.literals]:
        raise ValueError(f"rules without a literal token can't be indexed: {bare}")
    spark = urls.sparkSession
    table = spark.createDataFrame([(r.rule, r.verdict, r.site, r.rank, r.host_size, r.pattern, list(r.literals))
                                   for r in rules], _SCHEMA)
    parts = with_parts(urls)
    tokens = (parts.withColumn("token", F.explode(F.array_distinct(F.split(_lowered("url"), "[^a-z0-9]+"))))
              .filter("token <> ''"))
    filed = _rarest(table, tokens)
    text = F.when(F.col("site"), F.concat("host", "path")).otherwise(_lowered("url"))
    fitting = tokens.join(filed, "token").withColumn("text", text).filter("text RLIKE pattern")
    order = F.struct("site", "rank", "host_size", (F.col("verdict") == "block").alias("blocks"), "rule")
    return (fitting.groupBy("url").agg(F.max_by(F.struct("rule", "verdict", "site"), order).alias("best"))
            .select("url", "best.rule", "best.verdict", "best.site"))


def _rarest(table: DataFrame, tokens: DataFrame) -> DataFrame:
    """The rules with the token they are filed under: the rarest among URLs, then the longest, then by name."""
    words = table.select("rule", "pattern", F.explode("literals").alias("token"))
    counts = tokens.join(words.select("token").distinct(), "token").groupBy("token").agg(F.count("*").alias("n"))
    order = F.struct(F.coalesce("n", F.lit(0)), -F.length("token"), "token")
    choice = (words.join(counts, "token", "left").groupBy("rule", "pattern")
              .agg(F.min_by("token", order).alias("token")))
    return table.drop("literals").join(choice, ["rule", "pattern"])


def judge_pages(pages: DataFrame, rules: list[Rule] | None = None, otherwise: str = OTHERWISE,
                id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per row of ``pages``: page_id, host, path, rule (site rules only, else null), verdict, matched.

    ``matched`` names the winning rule of any kind.  A null URL, or one without "://",
    has an empty host and path; the former fits no rule.
    """
    mine = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    best = judged_urls(mine.select("url").filter("url IS NOT NULL").distinct(), default_rules() if rules is None else rules)
    best = best.withColumnRenamed("url", "judged").withColumnRenamed("rule", "matched")
    out = mine.join(best, F.col("url") == F.col("judged"), "left")
    at = F.locate("://", F.col("url"))
    rest = F.when(at > 0, F.expr("substring(url, locate('://', url) + 3)")).otherwise("")
    return out.withColumn("rest", rest).select(
        "page_id", _lowered(F.regexp_extract("rest", r"^[^/?#]*", 0)).alias("host"),
        F.regexp_extract("rest", r"^[^/?#]*([^?#]*)", 1).alias("path"),
        F.when(F.col("site"), F.col("matched")).alias("rule"),
        F.coalesce("verdict", F.lit(otherwise)).alias("verdict"), "matched")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_pages(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"))


def oracle() -> str:
    """Every rule tried on every page."""
    def text(v):
        return "'" + v.replace("'", "''") + "'"
    rules = ", ".join(f"({text(r.rule)}, {text(r.verdict)}, {str(r.site).lower()}, {r.rank}, {r.host_size}, {text(r.pattern)})"
                      for r in default_rules())
    return f"""
    WITH rules(rule, verdict, site, rank, host_size, pattern) AS (VALUES {rules}),
    cut AS (SELECT page_id, url, row_number() OVER () AS k,
              CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
    parts AS (SELECT page_id, k, translate(coalesce(url, ''), '{_UPPER}', '{_LOWER}') AS low,
              translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') AS host,
              regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
    fit AS (SELECT k, rule, verdict, site,
              row_number() OVER (PARTITION BY k ORDER BY site DESC, rank DESC, host_size DESC, verdict = 'block' DESC, rule DESC) AS place
            FROM parts JOIN rules ON regexp_matches(CASE WHEN site THEN host || path ELSE low END, pattern))
    SELECT page_id, host, path, CASE WHEN site THEN rule END AS rule, coalesce(verdict, '{OTHERWISE}') AS verdict,
           rule AS matched
    FROM parts LEFT JOIN (SELECT * FROM fit WHERE place = 1) USING (k)"""
