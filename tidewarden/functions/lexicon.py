"""Dictionary matching: entities, measures, regulation type, themes."""


from pyspark.sql import Column, functions as F

from .. import config as C
from .text import contains_any, extract_all, one_of


def _longest_first(words):
    return sorted(words, key=lambda w: (-len(w), w))


def gazetteer_matches(c: Column, labels: list[str], gazetteer=None) -> Column:
    """Case-sensitive whole-phrase hits of the gazetteer entries with these labels."""
    phrases = [p for label, p in (gazetteer or C.GAZETTEER) if label in labels]
    if not phrases:
        return F.array().cast("array<string>")
    return F.array_distinct(extract_all(c, rf"(?U)\b(?:{one_of(_longest_first(phrases))})\b"))


def keyword_entities(c: Column, words=None) -> Column:
    """Keyword hits in their surface case; alternatives are tried in list order."""
    return F.array_distinct(extract_all(c, rf"(?iU)\b({one_of(words or C.ENTITY_KEYWORDS)})\b", 1))


def entities(c: Column, gazetteer=None, words=None) -> Column:
    return F.sort_array(F.array_union(
        gazetteer_matches(c, C.ENTITY_LABELS, gazetteer), keyword_entities(c, words)))


def measure_phrases(c: Column, terms=None, fold_case: bool = False) -> Column:
    """Measure terms found as whole tokens, surface case kept, overlaps included.

    Terms of equal word count share one pass.  The match sits in a lookahead, so
    hits that overlap ("minimum tax" and "tax") are all reported.
    """
    by_words: dict[int, list[str]] = {}
    for term in terms or C.MEASURE_TERMS:
        by_words.setdefault(len(term.split()), []).append(term)
    found = [extract_all(c, rf"(?iU)\b(?=((?:{one_of(_longest_first(group))})\b))", 1)
             for _, group in sorted(by_words.items())]
    hits = F.concat(*found)
    return F.array_distinct(F.transform(hits, F.lower) if fold_case else hits)


def measure_fallback(c: Column, words=None) -> Column:
    """Looser scan without word boundaries."""
    return F.array_distinct(extract_all(c, rf"(?iu)({one_of(words or C.FALLBACK_MEASURES)})", 1))


def or_fallback(exact: Column, c: Column, fold_case: bool = False) -> Column:
    """The exact hits, or the loose scan where there are none."""
    loose = measure_fallback(c)
    if fold_case:
        loose = F.array_distinct(F.transform(loose, F.lower))
    return F.when(F.size(exact) > 0, exact).otherwise(loose)


def measures(c: Column, terms=None, fold_case: bool = False) -> Column:
    return F.sort_array(or_fallback(measure_phrases(c, terms, fold_case), c, fold_case))


def regulation_type(lower_text: Column, groups=None) -> Column:
    """First keyword group with a substring hit decides the type."""
    out = F.lit(C.OTHER)
    for label, words in reversed(list((groups or C.REG_TYPE_KEYWORDS).items())):
        out = F.when(contains_any(lower_text, words), F.lit(label)).otherwise(out)
    return out


def theme_pattern(words: list[str], prefix: bool = False) -> str:
    tail = "" if prefix else r"s?\b"
    return rf"(?U)\b(?:{one_of(words)}){tail}"


def company_theme(company: Column, dictionary=None, prefix: bool = False) -> Column:
    """First theme, in dictionary order, with a whole-word hit in the name.

    An optional plural "s" is accepted.  Word stems never match as whole words;
    ``prefix`` lets them.
    """
    name = F.lower(company)
    out = F.lit(C.OTHER)
    for theme, words in reversed(list((dictionary or C.COMPANY_THEME_KEYWORDS).items())):
        out = F.when(name.rlike(theme_pattern(words, prefix)), F.lit(theme)).otherwise(out)
    return out


def theme_rules(dictionary=None) -> Column:
    """Text-theme dictionary as an array of (keyword, theme)."""
    return F.array(*[F.struct(F.lit(k).alias("keyword"), F.lit(t).alias("theme"))
                     for k, t in (dictionary or C.TEXT_THEME_KEYWORDS).items()])


def text_themes(lower_text: Column, rules: Column | None = None, whole_word: bool = False) -> Column:
    """Themes whose keyword is a substring of the text ("maintain" holds "ai")."""
    rules = theme_rules() if rules is None else rules

    def hit(rule):
        if whole_word:
            return F.rlike(lower_text, F.concat(
                F.lit(r"(?U)\b\Q"), rule["keyword"], F.lit(r"\E\b")))
        return F.contains(lower_text, rule["keyword"])

    return F.sort_array(F.array_distinct(F.transform(F.filter(rules, hit), lambda r: r["theme"])))


def type_targets(reg_type: Column, targets=None) -> Column:
    """Themes that a regulation type targets; empty for an unknown type."""
    out = F.array().cast("array<string>")
    for label, themes in (targets or C.REG_TYPE_TARGETS).items():
        out = F.when(reg_type == label, F.array(*map(F.lit, themes))).otherwise(out)
    return out


def targeted_themes(*theme_sets: Column) -> Column:
    """Sorted union of theme sets, ``Other`` when nothing is targeted."""
    merged = F.sort_array(F.array_distinct(F.concat(*theme_sets)))
    return F.when(F.size(merged) > 0, merged).otherwise(F.array(F.lit(C.OTHER)))


def mentions_places(names: Column, countries: list[str]) -> Column:
    """Entity strings that hold a country name (case-sensitive)."""
    return F.filter(names, lambda e: contains_any(e, countries))


