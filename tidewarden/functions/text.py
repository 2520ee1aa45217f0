"""Cleaning and date extraction for regulation texts, as built-in expressions."""

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, functions as F
from pyspark.sql.types import IntegerType, StringType

from .. import config as C
from .html import visible_text


def extract_all(c: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


def one_of(words: list[str]) -> str:
    """Alternation of literal words."""
    return "|".join(re.escape(w) for w in words)


def contains_any(c: Column, words: list[str]) -> Column:
    hits = [F.contains(c, F.lit(w)) for w in words]
    out = hits[0]
    for h in hits[1:]:
        out = out | h
    return out


def normalize_space(c: Column) -> Column:
    """Collapse whitespace runs to one blank and trim."""
    return F.btrim(F.regexp_replace(c, r"(?U)[\s\x1c-\x1f]+", " "))


def html_text(c: Column) -> Column:
    """Visible text of a page (see ``functions.html``)."""
    return normalize_space(visible_text(c))


def html_strip_simple(c: Column) -> Column:
    """Tags and ``&…;`` references become blanks; script bodies stay."""
    return normalize_space(F.regexp_replace(F.regexp_replace(c, r"<[^>]+>", " "), r"&[^;]+;", " "))


def strip_tags(c: Column) -> Column:
    return normalize_space(F.regexp_replace(c, r"<[^>]+>", " "))


@F.pandas_udf(StringType())
def _leading_texts(docs: pd.Series) -> pd.Series:
    from xml.etree import ElementTree

    def leading(doc):
        if doc is None:
            return None
        try:
            parts = ((e.text or "").strip() for e in ElementTree.fromstring(doc).iter())
        except ElementTree.ParseError:
            return None
        return " ".join(p for p in parts if p)

    return docs.map(leading)


def xml_text(c: Column) -> Column:
    """Leading text of each element in document order; tag strip when malformed.

    The one Python expression of the package: Spark's ``xpath`` fails the job on
    a malformed document, so an Arrow-batched parser answers null instead.
    """
    return normalize_space(F.coalesce(_leading_texts(c), F.regexp_replace(c, r"<[^>]+>", " ")))


def clean_text(c: Column, ext: Column) -> Column:
    """Clean a non-XML document by its extension (see ``operators.extract`` for XML)."""
    return F.when(F.lower(ext).isin("html", "htm"), html_text(c)).otherwise(normalize_space(c))


def mask_citations(c: Column) -> Column:
    """Blank out legal citations so that section numbers do not pass for years."""
    for pattern in C.CITATION_FORMATS:
        c = F.regexp_replace(c, f"(?iU){pattern}", " ")
    return c


#: Bytes of ASCII that a word may hold; and the length in bytes up to which words are counted in batches of texts.
_IN_WORD = np.array([b < 128 and (chr(b).isalnum() or chr(b) == "_") for b in range(256)])
BATCHED = 1000


@F.arrow_udf(IntegerType())
def _word_starts(texts: pa.Array) -> pa.Array:
    """Number of bytes of each text that a word starts with; null for null and for a text that is not of ASCII alone."""
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    at = np.frombuffer(texts.buffers()[1], kind)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    size = int(at[-1] - at[0])
    data = np.frombuffer(texts.buffers()[2], np.uint8, size, int(at[0])) if size else np.zeros(0, np.uint8)
    at = at - at[0]

    def of_each(marks):
        before = np.concatenate(([0], np.cumsum(marks)))
        return before[at[1:]] - before[at[:-1]]

    inside = _IN_WORD[data]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    first = at[:-1][at[:-1] < size]
    starts[first] = inside[first]
    unknown = texts.is_null().to_numpy(zero_copy_only=False)
    if size and data.max() > 127:
        unknown = unknown | (of_each(data > 127) > 0)
    return pa.array(of_each(starts).astype(np.int32), mask=unknown)


def word_count(c: Column, word: str) -> Column:
    r"""Number of matches of ``word``, which is \w+ in any notation.  Matching takes most of the time that short texts
    take, so in those of ASCII the bytes that start a word are counted, a batch at a time."""
    return F.coalesce(_word_starts(F.when(F.octet_length(c) <= BATCHED, c)), F.size(extract_all(c, word)))


def strong_dates(masked: Column) -> Column:
    """Unambiguous date mentions of a masked text.

    Deviation: the whole mention is returned for the month-name formats, not
    only the month.
    """
    found = [extract_all(masked, f"(?iU){p}") for p in C.DATE_FORMATS]
    return F.array_distinct(F.concat(*found))


def context_years(masked: Column, whole_word: bool = False) -> Column:
    """Bare years preceded, within three words, by a word holding a time cue.

    The cue is tested as a substring of the word ("money 2044" passes because of
    "on"); ``whole_word`` asks for the cue as a full word.
    """
    cue = rf"(?:{one_of(C.YEAR_CUES)})"
    word = rf"{cue}\b" if whole_word else rf"\w*{cue}\w*"
    found = [extract_all(masked, rf"(?iU)\b(?={word}\W+(?:\w+\W+){{{gap}}}(\d{{4}})\b)", 1)
             for gap in range(3)]
    return F.filter(F.array_distinct(F.concat(*found)),
                    lambda y: y.cast("int").between(C.YEAR_MIN, C.YEAR_MAX))


def date_mentions(c: Column, whole_word: bool = False) -> Column:
    """Sorted distinct date mentions of a text."""
    masked = mask_citations(c)
    return F.sort_array(F.array_union(strong_dates(masked), context_years(masked, whole_word)))


def chunks(c: Column, size: int, overrun: int) -> Column:
    """Cut a text into pieces of ``size`` characters, each extended to the next
    whitespace by at most ``overrun`` characters.  The pieces join back to the text."""
    return extract_all(c, rf"(?sU).{{{size}}}\S{{0,{overrun}}}|.{{1,{size}}}")
