"""Facts from annual filings as expressions over text sections.

A filing is cut into segments in one pass: a segment starts at a heading and ends where
the next one starts.  The section of a name is what every segment holds from its first
line with that name on, however long.  :class:`Limits` cuts sections and lists; by
default nothing is cut.
"""

import re
from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from .. import config as C
from .numbers import strip
from .text import contains_any, extract_all

STRINGS = "array<string>"

# A heading is a line of at most 80 characters that begins with a capital or a digit and ends with a letter, a
# digit or a bracket, after a line that ends a sentence (or an empty one), and is not continued in lower case.
HEADING_LINE = r"[ \t]*[\p{Lu}\p{N}][^\n]{0,77}[\p{L}\p{N})][ \t\r]*"
# The line break comes first, so that only there is looked back.
_BOUNDARY = r"\n(?<=[.!?:;\n][ \t\r]{0,3}\n)(?=" + HEADING_LINE + r"(?:\n(?![ \t]*\p{Ll})|\z))"


@dataclass(frozen=True)
class Limits:
    """What to read and report of a filing; None is all of it.

    ``windows``: cut sections to so many characters from the first line with their name
    (:data:`config.SECTION_CHARS`, by section name) instead of by headings.  The others
    are the most entries of a list (in its order) and the characters of a risk line.
    """

    windows: dict[str, int] | None = None
    suppliers: int | None = None
    products: int | None = None
    dependencies: int | None = None
    customers: int | None = None
    risk_lines: int | None = None
    risk_chars: int | None = None


#: The cuts of a short report.
SHORT = Limits(C.SECTION_CHARS, 30, 20, 15, 10, 15, 200)


def segments(text: Column) -> Column:
    """The text from heading to heading; joined by line breaks they are the text."""
    return F.split(text, _BOUNDARY, -1)


def heading(segment: Column) -> Column:
    """The heading that a segment starts with, null if it starts with something else."""
    line = F.substring_index(segment, "\n", 1)
    return F.when(line.rlike(f"^{HEADING_LINE}$"), F.btrim(line, F.lit(" \t\r")))


def headed(parts: Column, lower_parts: Column, name: str) -> Column:
    """Every segment from its first line that holds ``name`` on; '' if none does."""
    def rest(part, i):
        low = F.get(lower_parts, i)
        at = F.instr(low, name)
        before = F.substring_index(F.substring(part, F.lit(1), at - 1), "\n", -1)
        return F.when(at > 0, F.substring(part, at - F.length(before), F.length(part)))

    return F.array_join(F.array_compact(F.transform(parts, rest)), "\n")


def lowered(text: Column) -> Column:
    """Lower-cased text whose character positions equal those of the original.

    The dotted capital I is the one letter that grows when lower-cased; the long
    s is folded because patterns that ignore case take it for an s.
    """
    rare = F.contains(text, F.lit("İ")) | F.contains(text, F.lit("ſ"))
    return F.lower(F.when(rare, F.translate(text, "İſ", "Is")).otherwise(text))


def section(text: Column, lower_text: Column, name: str, chars: int = 3000) -> Column:
    """``chars`` characters from the first line that holds ``name``, '' if none does.

    The slice starts at the line break before that line, or at the text start.
    ``lower_text`` is ``lowered(text)``, computed once by the caller.
    """
    at = F.instr(lower_text, name)
    before = F.substring(text, F.lit(1), at - 1)
    start = at - 1 - F.length(F.substring_index(before, "\n", -1))
    return F.when(at > 0, F.substring(text, F.greatest(start, F.lit(1)), F.lit(chars))).otherwise(F.lit(""))


def folded(text: Column) -> Column:
    """Lower-cased text that holds an ASCII word where a pattern that ignores case, also beyond ASCII, finds it.

    Four other characters pass for a letter there: both Turkish i, the long s and the Kelvin sign.
    """
    rare = contains_any(text, list("İıſ\u212a"))
    return F.lower(F.when(rare, F.translate(text, "İıſ\u212a", "iisk")).otherwise(text))


def _start(pattern: str) -> str:
    """The letters that every match of a pattern begins with."""
    letters, optional = re.match(r"([a-z]+)([?*{]?)", pattern).groups()
    return letters[:-1] if optional else letters


def _captures(texts: Column, patterns: list[str]) -> Column:
    """First-group captures of several patterns over an array of texts.

    The plain test for the start of a pattern spares most scans.
    """
    none = F.array().cast(STRINGS)

    def found(s, low):
        return F.concat(*[F.when(~F.contains(low, F.lit(_start(p))), none).otherwise(extract_all(s, f"(?idU){p}", 1))
                          for p in patterns])

    return F.flatten(F.zip_with(texts, F.transform(texts, folded), found))


def _prefix(names: Column, n: int | None) -> Column:
    return _first(F.sort_array(F.array_distinct(names)), n)


def _first(items: Column, n: int | None) -> Column:
    return items if n is None else F.slice(items, 1, n)


def _present(*slices: Column) -> Column:
    return F.filter(F.array_distinct(F.array(*slices)), lambda s: s != "")


def suppliers(*slices: Column, n: int | None = None) -> Column:
    """Capitalised name runs inside supplier phrases, in order.

    The phrase patterns ignore case, so their ``[A-Z]`` takes any letter; the
    names are then matched case-sensitively.
    """
    phrases = _captures(_present(*slices), C.SUPPLIER_PHRASES)
    names = F.flatten(F.transform(F.array_distinct(phrases),
                                  lambda m: extract_all(m, f"(?U){C.SUPPLIER_NAME}", 1)))
    kept = F.filter(names, lambda n: (F.length(n) > 3) & ~n.isin(C.SUPPLIER_STOP))
    return _prefix(kept, n)


def _literals(pattern: str) -> list[str]:
    """Lower-cased words of a region pattern, all of them literal alternatives."""
    bare = pattern.replace(r"\b", "").replace("(?:", "").replace(")", "").replace("\\.", ".")
    return [w.lower() for w in bare.split("|")]


def _names_region(slice_: Column, low: Column, pattern: str) -> Column:
    """Whole-word mention; the plain substring test spares most pattern scans."""
    return contains_any(low, _literals(pattern)) & slice_.rlike(f"(?iU){pattern}")


def region_hits(slices: list[tuple[Column, Column]]) -> Column:
    """(region number, slice number, share) of every region that a slice names.

    ``share`` is the largest percentage found within 200 characters after a
    mention, null without one.  Slices come with their lower-cased text.
    """
    rows = []
    for i, pattern in enumerate(C.REGION_PATTERNS.values()):
        for k, (text, low) in enumerate(slices):
            share = F.array_max(F.transform(
                extract_all(text, f"(?idU){pattern}{C.REGION_SHARE}", 1), lambda p: p.cast("double")))
            rows.append(F.when(_names_region(text, low, pattern), F.struct(
                F.lit(i).alias("ord"), F.lit(k).alias("slice"), share.alias("share"))))
    return F.array_compact(F.array(*rows))


def geography(hits: Column) -> Column:
    """Regions and shares as an array of (region, share), in order of appearance.

    A later slice with a percentage replaces an earlier value; a mention
    without any percentage gives 0.
    """
    def entry(region, i):
        mine = F.filter(hits, lambda h: h["ord"] == i)
        share = F.reduce(mine, F.lit(None).cast("double"), lambda acc, h: F.coalesce(h["share"], acc))
        return F.struct(F.get(mine, F.lit(0))["slice"].alias("seen"), i.alias("ord"),
                        region.alias("region"), F.coalesce(share, F.lit(0.0)).alias("share"))

    names = F.array(*map(F.lit, C.REGION_PATTERNS))
    found = F.sort_array(F.filter(F.transform(names, entry), lambda r: r["seen"].isNotNull()))
    return F.transform(found, lambda r: F.struct(r["region"].alias("region"), r["share"].alias("share")))


def sentences(text: Column) -> Column:
    """Runs up to their stop.  Each starts where the one before ended, so a tail without a stop is read once."""
    return extract_all(text, r"\G[^.!?]*+[.!?]")


def _words(pattern: str) -> list[str]:
    """What a pattern of literal alternatives, some with a group of endings, stands for."""
    out = []
    for words in re.split(r"\|(?![^(]*\))", pattern):
        head, ends, tail = re.fullmatch(r"([a-z ]*)(?:\(\?:([a-z |]*)\))?([a-z ]*)", words).groups()
        out += [head + end + tail for end in (ends or "").split("|")]
    return out


def risk_factors(parts: Column, n: int | None = None, chars: int | None = None) -> Column:
    """One line per risk theme: its longest sentence, if over 50 characters.

    Deviation: the sentence bounds apply to every alternative of a theme.
    ``parts`` are the sentences of the section: a run up to its stop is exactly
    what the enclosing pattern would take, without re-scanning from every
    position.  The words of a theme are looked for one by one, without a pattern.
    """
    def line(pairs, theme, pattern):
        best = F.reduce(
            F.filter(pairs, lambda p: contains_any(p["low"], _words(pattern))), F.lit(""),
            lambda a, p: F.when(F.length(p["s"]) > F.length(a), p["s"]).otherwise(a))
        long = F.filter(F.array(best), lambda s: F.length(s) > 50)
        return F.transform(long, lambda s: F.concat(
            F.lit(f"{theme}: "), s if chars is None else F.substring(s, 1, chars), F.lit("...")))

    folds = F.transform(parts, lambda s: F.struct(s.alias("s"), folded(s).alias("low")))
    lines = F.transform(F.array(folds), lambda pairs: F.concat(*[line(pairs, t, p) for t, p in C.RISK_THEMES.items()]))
    return _first(F.flatten(lines), n)


def products(*slices: Column, n: int | None = None) -> Column:
    """Product names listed after a product phrase, in order.

    Deviation: "and" separates only as a whole word.
    """
    phrases = _captures(_present(*slices), C.PRODUCT_PHRASES)
    items = F.flatten(F.transform(F.array_distinct(phrases), lambda m: F.transform(
        F.split(m, r"(?U),\s*(?:and\s+)?|\band\s+", -1), strip)))
    return _prefix(F.filter(items, lambda p: (F.length(p) > 5) & (F.length(p) < 100)), n)


def dependencies(text: Column, n: int | None = None) -> Column:
    """What the company depends on, from the whole text, in order."""
    found = F.transform(_captures(F.array(text), C.DEPENDENCY_PHRASES), strip)
    return _prefix(F.filter(found, lambda m: F.length(m) > 15), n)


def customers(slice_: Column, n: int | None = None) -> Column:
    """Capitalised name runs of the customer section, in order."""
    names = extract_all(slice_, f"(?U){C.CUSTOMER_NAME}", 1)
    return _prefix(F.filter(names, lambda w: F.length(w) > 3), n)


def sites(slice_: Column, low: Column) -> Column:
    """Regions named in the manufacturing section."""
    hits = F.array(*[F.when(_names_region(slice_, low, p), F.lit(r)) for r, p in C.REGION_PATTERNS.items()])
    return F.sort_array(F.array_compact(hits))
