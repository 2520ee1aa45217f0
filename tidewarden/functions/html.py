"""Visible text of HTML pages, as built-in expressions.

A page is cut into tokens.  Its tags are folded from left to right with the stack of
open elements, which tells where a hidden subtree ends: nested ones end together, and one
that nobody closes ends with the element around it.  What is left is decoded once, from
left to right.
"""

import html.entities
import json
import re

from pyspark.sql import Column, functions as F

from .. import config as C

# Elements without content, and those whose content is not markup.
VOID = ["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"]
RAW = ["script", "style"]

#: The rest of a tag; a quote counts only where a value may begin.
_REST = r"""(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+>"""
_TOKEN = (rf"(?is)<!--.*?(?:-->|\z)|<({'|'.join(RAW)})(?=[\s/>]){_REST}.*?(?:</\1(?=[\s/>])[^>]*+>|\z)"
          rf"|</?[a-z]{_REST}|<[a-z/!?][^>]*+>|[^<]++|<")
_REFERENCE = r"&(?:#[0-9]++;?|#[xX][0-9a-fA-F]++;?|[a-zA-Z][a-zA-Z0-9]{0,31};?)|[^&]++|&"

_NAMES = html.entities.html5
#: Names by their first letter, so that a lookup walks one short map.
_BY_LETTER = json.dumps([{k: v for k, v in _NAMES.items() if ord(k[0]) == 65 + at} for at in range(58)])
#: Names that need no semicolon, longest first, for references such as "&copy2024".
_OPEN = "|".join(sorted((re.escape(k) for k in _NAMES if not k.endswith(";")), key=lambda k: (-len(k), k)))
#: Numbers 128 to 159 stand for the characters of the Windows alphabet.
_WINDOWS = "".join(bytes([n]).decode("cp1252", "ignore") or chr(n) for n in range(128, 160))


def _bind(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _code_point(n: Column) -> Column:
    """Character of a number: none for control codes and non-characters, U+FFFD for what is no code point."""
    return (F.when((n == 0) | n.between(0xD800, 0xDFFF) | (n > 0x10FFFF) | n.isNull(), F.lit("�"))
            .when(n.between(128, 159), F.substring(F.lit(_WINDOWS), (n - 127).cast("int"), F.lit(1)))
            .when(((n < 32) & ~n.isin(9, 10, 12, 13)) | (n == 127) | n.between(0xFDD0, 0xFDEF)
                  | (n.bitwiseAND(F.lit(0xFFFE)) == 0xFFFE), F.lit(""))
            .otherwise(F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")))


def _named(ref: Column) -> Column:
    """A reference by name; the longest open name at its start where the whole is unknown."""
    table = F.from_json(F.lit(_BY_LETTER), "array<map<string,string>>")

    def of(name):
        return F.try_element_at(F.get(table, F.ascii(name) - 65), name)

    name = F.substring(ref, F.lit(2), F.length(ref))
    start = F.regexp_extract(name, f"^(?:{_OPEN})", 0)
    opened = F.concat(of(start), F.substring(name, F.length(start) + 1, F.length(name)))
    return F.coalesce(of(name), F.when(start != "", opened), ref)


def unescape(c: Column) -> Column:
    """Resolve all character references in one pass, so that what a reference yields is never read again."""
    def one(p):
        digits = F.regexp_extract(p, r"^&#[xX]?([0-9a-fA-F]+)", 1)
        # More than nine digits are beyond any code point, or zeros that say nothing.
        short = F.regexp_replace(digits, "^0+(?=.)", "")
        number = F.when(F.length(short) > 9, F.lit(None).cast("bigint")).when(
            F.lower(F.substring(p, 3, 1)) == "x", F.conv(short, 16, 10).cast("bigint")).otherwise(short.cast("bigint"))
        return (F.when(~F.startswith(p, F.lit("&")) | (p == "&"), p)
                .when(F.startswith(p, F.lit("&#")), _code_point(number)).otherwise(_named(p)))

    pieces = F.regexp_extract_all(c, F.lit(_REFERENCE), F.lit(0))
    return F.when(F.contains(c, F.lit("&")), F.array_join(F.transform(pieces, one), "")).otherwise(c)


def _tags(tokens: Column) -> Column:
    """Tags by position: at, name, closes, alone (nothing follows that belongs to it)."""
    def tag(t, at):
        name = F.lower(F.regexp_extract(t, r"^</?([a-zA-Z][^\s/>]*)", 1))
        return F.struct(at.alias("at"), name.alias("name"), F.startswith(t, F.lit("</")).alias("closes"),
                        (F.endswith(t, F.lit("/>")) | name.isin(*VOID, *RAW)).alias("alone"))

    return F.filter(F.transform(tokens, tag), lambda g: g["name"] != "")


def _cuts(tokens: Column) -> Column:
    """Token ranges (first, last) that hidden elements cover."""
    hidden = [t for t in C.HIDDEN_TAGS if t not in RAW]

    def state(open_, first, level, cuts):
        return F.struct(open_.alias("open"), first.alias("first"), level.alias("level"), cuts.alias("cuts"))

    def step(s, g):
        starts = (s["first"] < 0) & g["name"].isin(*hidden)
        pushed = state(F.concat(s["open"], F.array(g["name"])), F.when(starts, g["at"]).otherwise(s["first"]),
                       F.when(starts, F.size(s["open"])).otherwise(s["level"]), s["cuts"])
        keep = F.size(s["open"]) - F.array_position(F.reverse(s["open"]), g["name"]).cast("int")
        ends = (s["first"] >= 0) & (keep <= s["level"])
        cut = F.struct(s["first"].alias("first"), g["at"].alias("last"))
        popped = state(F.slice(s["open"], F.lit(1), keep), F.when(ends, F.lit(-1)).otherwise(s["first"]), s["level"],
                       F.when(ends, F.concat(s["cuts"], F.array(cut))).otherwise(s["cuts"]))
        return (F.when(g["closes"] & F.array_contains(s["open"], g["name"]), popped)
                .when(g["closes"] | g["alone"], s).otherwise(pushed))

    none = F.lit(-1)
    start = state(F.array().cast("array<string>"), none, none, F.array().cast("array<struct<first:int,last:int>>"))
    return F.reduce(_tags(tokens), start, step, lambda s: F.when(s["first"] < 0, s["cuts"]).otherwise(
        F.concat(s["cuts"], F.array(F.struct(s["first"].alias("first"), F.lit(2**31 - 1).alias("last"))))))


def visible_text(c: Column) -> Column:
    """What a reader of the page sees: comments, tags and hidden subtrees become blanks, references their characters."""
    hidden = "|".join(t for t in C.HIDDEN_TAGS if t not in RAW)
    nothing = F.array().cast("array<struct<first:int,last:int>>")

    def shown(both):
        def piece(t, at):
            covered = F.exists(both["cuts"], lambda k: at.between(k["first"], k["last"]))
            return F.when(F.rlike(t, F.lit(r"^<[a-zA-Z/!?][^>]*+>|^<!--|^<[a-zA-Z]")) & (F.length(t) > 1) | covered, " ").otherwise(t)
        return F.array_join(F.transform(both["tokens"], piece), "")

    def cut(tokens):
        cuts = F.when(F.rlike(c, F.lit(rf"(?i)<({hidden})[\s/>]")), _cuts(tokens)).otherwise(nothing)
        return F.struct(tokens.alias("tokens"), cuts.alias("cuts"))

    tokens = F.regexp_extract_all(c, F.lit(_TOKEN), F.lit(0))
    return unescape(_bind(_bind(tokens, cut), shown))
