"""Licences found by the digest of a canonical text.

A text is brought to a canonical form: lower case, no copyright lines, one spelling of
words that are spelled in several ways, no punctuation, single blanks, one name for the
holders that some licences name.  Its SHA-256 is looked up among the digests of known
licence texts (``licenses/`` and below) and notices by an equality join.
Units are the whole text, its paragraphs and its lines, so a notice is found where it is
a part of a document of its own.  Built-in functions only.
"""

import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: The rule of the reference SQL, which also drops licence prose that a wrap begins with "copyright".
COPYRIGHT_LINE = r"(?m)^[ \t]*[/*#;-]*[ \t]*(?:(?:copyright|\(c\)|©)[ \t][^\n]*|all rights reserved[. \t]*)$"
#: Words that follow "copyright" in the prose of licences, and words that no holder's name has.
_PROSE_NEXT = r"(?:and|or|in|on|by|of|the (?:software|program|work)|to|treaty|doctrines?|interests?|disclaimers?|permissions?|statements?|holders?)\b"
_PROSE = r"\b(?:holders?|owners?|ownership|notices?|licens\w*|laws?|patents?|trademarks?|rights|be|is|are|shall|must|may|you|your|that|which|if|under|from|any)\b"
#: To the line's end, or on to the end of "all rights reserved" where that is wrapped.
_TO_END = r"(?:[^\n]*?\ball[\s/*#;-]+rights[\s/*#;-]+reserved[. \t]*|[^\n]*)"
#: Notices that are in licence texts are left to PHRASES.
_NOT_QUOTED = r"(?![^\n]*(?:free software|name of author))"
#: Lines that name holders and years, and say nothing else; they are dropped.  A sign or a
#: year makes a notice, or a name up to the line's end; licence prose does neither, whatever
#: its wrap.  "(c)" alone also numbers clauses.
NOTICE_LINE = (
    r"(?m)^[ \t]*+[/*#;-]*+[ \t]*+(?:"
    rf"(?:copyright[ \t:]*+(?:\(c\)|©)|©){_NOT_QUOTED}{_TO_END}"
    rf"|(?:copyright|\(c\)){_NOT_QUOTED}[ \t:,]*+(?:(?:by\b|\(c\)|copyright)[ \t:,]*+){{0,4}}(?:(?:19|20)\d\d\b|[\[<{{]|yyyy\b|year\b){_TO_END}"
    rf"|(?:copyright|\(c\))[ \t]+(?:by[ \t]+)?(?!{_PROSE_NEXT})(?![^\n]*{_PROSE})[\w\x{{80}}-\x{{10FFFF}}][^\n;]{{0,80}}"
    r"|all rights reserved[. \t]*)$")
#: Equivalent spellings, as patterns on lower-case text and what they become.
SPELLINGS = [
    (r"licenc", "licens"),
    (r"(authori|organi|recogni|utili|initiali|reali|summari|sublicens)s(e|ed|ing|ation)\b", "$1z$2"),
    (r"(fav|behavi|col|hon)our", "$1or"),
    (r"\b(sub|non) ?- ?(licens|commercial|infring)", "$1$2"),
    (r"acknowledgement", "acknowledgment"),
    (r"per cent\b", "percent"),
    (r"https?://", "http "),
]
#: What is left between words becomes one blank.
NO_WORD = r"[^a-z0-9\x{80}-\x{10FFFF}]+"

#: Words of canonical texts that stand for a holder or an address, or were parted by a line's end, and what they become.
PHRASES = [
    (r"\b(sub|non) (licens|commercial|infring)", "$1$2"),
    (r"per cent\b", "percent"),
    (r"free software foundation inc (?:51 franklin|59 temple|675 mass) .{1,60}? usa\b", "free software foundation inc"),
    (r"copyright c [0-9 ]+ free software foundation inc(?: http (?:www )?fsf org\b)? ?", ""),
    (r"copyright c year name of author ?", ""),
    (r"neither the names? of .{1,120}? nor the names of (?:its|their|any) contributors", "neither the name of the holder nor the names of its contributors"),
    (r"provided by .{1,120}? as is and any express", "provided by the holders as is and any express"),
    (r"in no event shall .{1,160}? be liable for any direct", "in no event shall the holders be liable for any direct"),
]
#: A text without any of these has nothing that PHRASES change.
_PHRASES_IN = ("sub licens", "sub commercial", "sub infring", "non licens", "non commercial", "non infring", "per cent",
               "free software foundation", "name of author", "neither the name", "as is and any express", "be liable for any direct")

# Fixed values: (identifier, text) of licences and of the notices that stand for them.
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC_RIGHT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_REST = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING
ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION
OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
KNOWN = [
    ("MIT", _MIT),
    ("MIT", "MIT License\n\n" + _MIT),
    ("MIT", "The MIT License (MIT)\n\n" + _MIT),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("ISC", f"{_ISC_RIGHT}, provided that the above copyright notice and this permission notice appear in all copies.\n{_ISC_REST}"),
    ("ISC", f"ISC License\n\n{_ISC_RIGHT}, provided that the above copyright notice and this permission notice appear in all copies.\n{_ISC_REST}"),
    ("ISC", "SPDX-License-Identifier: ISC"),
    ("0BSD", f"{_ISC_RIGHT}.\n{_ISC_REST}"),
    ("0BSD", f"Zero-Clause BSD\n\n{_ISC_RIGHT}.\n{_ISC_REST}"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-3.0-or-later", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("GPL-2.0-only", "SPDX-License-Identifier: GPL-2.0-only"),
    ("MPL-2.0", "SPDX-License-Identifier: MPL-2.0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "SPDX-License-Identifier: CC0-1.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]

# Further notices, and what may be before or left out of an entire text.
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
You may obtain a copy of the License at"""
_GPL_REST = """This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""
_GPL_COPY = "You should have received a copy of the GNU General Public License along with this program"
_GPL_ENDS = [f"{_GPL_COPY}. If not, see <https://www.gnu.org/licenses/>.",
             f"{_GPL_COPY}; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA."]
_GPL = {
    "GPL-2.0-only": "under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.",
    "GPL-2.0-or-later": "under the terms of the GNU General Public License as published by the Free Software Foundation; "
                        "either version 2 of the License, or (at your option) any later version.",
    "GPL-3.0-only": "under the terms of the GNU General Public License version 3 as published by the Free Software Foundation.",
    "GPL-3.0-or-later": "under the terms of the GNU General Public License as published by the Free Software Foundation, "
                        "either version 3 of the License, or (at your option) any later version.",
}
HEADERS = [
    ("Apache-2.0", _APACHE),
    ("Apache-2.0", _APACHE + """ http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing
permissions and limitations under the License."""),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
                "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    *[(k, f"This program is free software: you can redistribute it and/or modify it {terms}{rest}")
      for k, terms in _GPL.items() for rest in ("", f"\n{_GPL_REST}", *[f"\n{_GPL_REST}\n{end}" for end in _GPL_ENDS])],
]
TITLES = {
    "BSD-2-Clause": ["BSD 2-Clause License", 'BSD 2-Clause "Simplified" License', "The 2-Clause BSD License", "Simplified BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", 'BSD 3-Clause "New" or "Revised" License', "The 3-Clause BSD License", "New BSD License"],
    "Unlicense": ["The Unlicense", "Unlicense"],
}
#: Patterns of what a copy may leave out: how to apply the licence, and what comes before it.
LEFT_OUT = [r"(?s)END OF TERMS AND CONDITIONS.*", r"(?s)(?<=END OF TERMS AND CONDITIONS).*", r"\ACreative Commons Legal Code\s*",
            r"(?s)\A.*?(?=\nStatement of Purpose)", r"(?s)\A.*?=\s+(?=Creative Commons Attribution)|=+\s+Creative Commons is not a party.*",
            r"(?s)For more information, please refer to.*", r"(?m)^[ ]*[1-3]\. (?=Redistributions|Neither)"]


def entire_texts() -> list[tuple[str, str]]:
    """(license, text) of every text in ``licenses/``, as it is and as copies have it."""
    out = []
    for path in sorted(Path(__file__).with_name("licenses").glob("*.txt")):
        whole = path.read_text(encoding="utf-8")
        forms = [whole, *[t for t in (re.sub(p, "", whole) for p in LEFT_OUT) if t != whole]]
        out += [(path.stem, title + t) for t in forms for title in ("", *[f"{x}\n\n" for x in TITLES.get(path.stem, [])])]
    return out


def _one_phrase(form: Column) -> Column:
    out = form
    for pattern, become in PHRASES:
        out = F.regexp_replace(out, pattern, become)
    some = F.lit(False)
    for words in _PHRASES_IN:
        some = some | form.contains(words)
    return F.when(some, F.trim(out)).otherwise(form)


def canonical(text: Column) -> Column:
    """The canonical form; "" for a text without a word."""
    out = F.regexp_replace(F.translate(text, _UPPER, _LOWER), NOTICE_LINE, "")
    # Line ends inside a phrase are blanks before spellings are compared.
    for pattern, become in SPELLINGS:
        out = F.regexp_replace(out, pattern, become)
    # In an array, so that the form has a name and is made once.
    return F.get(F.transform(F.array(F.trim(F.regexp_replace(out, NO_WORD, " "))), _one_phrase), F.lit(0))


def digests(texts: DataFrame) -> DataFrame:
    """(license, digest) of known texts (license, text), once each."""
    return (texts.select("license", F.sha2(canonical(F.col("text")), 256).alias("digest")).distinct())


def units(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, unit, digest): whole texts, and their paragraphs and lines where there are several."""
    text = F.coalesce(F.col(text_col), F.lit(""))

    def of(unit: str, texts: Column) -> Column:
        # Digests are made here, because a filter on a projected form would make every form again.
        return F.transform(texts, lambda x: F.struct(F.lit(unit).alias("unit"), F.sha2(canonical(x), 256).alias("digest")))

    parts = F.concat(
        of("text", F.array(text)),
        F.when(text.contains("\n"), of("line", F.split(text, "\n"))).otherwise(F.array()),
        F.when(text.rlike(r"\n[ \t\r]*\n"), of("paragraph", F.split(text, r"\n[ \t\r]*\n"))).otherwise(F.array()))
    # The outer form: an array that is dear to make is not made twice to see whether it is empty.
    each = docs.select(F.col(id_col).alias("doc_id"), F.inline_outer(parts))
    return each.filter(F.col("digest") != F.sha2(F.lit("").cast("binary"), 256))


def known_table(spark: SparkSession, known: list[tuple[str, str]] | None = None) -> DataFrame:
    return spark.createDataFrame(known or [*KNOWN, *HEADERS, *entire_texts()], "license string, text string")


def license_scan(docs: DataFrame, known: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per id: doc_id, text_license, licenses, n_notices.

    ``text_license`` is the licence that the whole text is, else null; ``licenses`` all
    that the text, a paragraph or a line is, sorted and joined by commas, "" without any
    (a text that is a licence has only that one, whatever notices it quotes); ``n_notices`` counts such lines, or the text where it is one line.  Rows that repeat
    an id add up.  A null text is an empty one, which is no licence.
    """
    table = digests(known_table(docs.sparkSession) if known is None else known)
    table = table.groupBy("digest").agg(F.min("license").alias("license"))  # one text, one licence
    hits = units(docs, id_col, text_col).join(table, "digest")
    lines = F.col("unit") == "line"
    per = hits.groupBy("doc_id").agg(
        F.min(F.when(F.col("unit") == "text", F.col("license"))).alias("text_license"),
        F.array_join(F.array_sort(F.collect_set("license")), ",").alias("licenses"),  # no more than there are known ones
        F.greatest(F.count(F.when(lines, 1)), F.count(F.when(F.col("unit") == "text", 1))).alias("n_notices"))
    ids = docs.select(F.col(id_col).alias("doc_id")).distinct()
    per = per.withColumn("licenses", F.coalesce("text_license", "licenses"))
    return (ids.join(per.withColumnRenamed("doc_id", "hit_id"), F.col("doc_id").eqNullSafe(F.col("hit_id")), "left")
            .select("doc_id", "text_license", F.coalesce("licenses", F.lit("")).alias("licenses"),
                    F.coalesce("n_notices", F.lit(0)).cast("long").alias("n_notices")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def oracle() -> str:
    def quoted(v):
        return "'" + v.replace("'", "''") + "'"

    def form(column):
        out = f"regexp_replace(translate({column}, '{_UPPER}', '{_LOWER}'), {quoted(COPYRIGHT_LINE)}, '', 'g')"
        for pattern, become in SPELLINGS:
            become = become.replace("$", "\\")
            out = f"regexp_replace({out}, {quoted(pattern)}, {quoted(become)}, 'g')"
        return f"trim(regexp_replace({out}, {quoted(NO_WORD)}, ' ', 'g'), ' ')"
    values = ", ".join(f"({quoted(k)}, {quoted(t)})" for k, t in KNOWN)
    return f"""
    WITH known AS (SELECT {form('t')} AS f, min(k) AS license FROM (VALUES {values}) AS v(k, t) GROUP BY ALL),
    whole AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
    part AS (SELECT doc_id, 'text' AS unit, text AS p FROM whole
      UNION ALL SELECT doc_id, 'line', unnest(string_split(text, chr(10))) FROM whole WHERE contains(text, chr(10))
      UNION ALL SELECT doc_id, 'paragraph', unnest(regexp_split_to_array(text, '\\n[ \\t\\r]*\\n')) FROM whole
        WHERE regexp_matches(text, '\\n[ \\t\\r]*\\n')),
    hit AS (SELECT doc_id, unit, license FROM (SELECT doc_id, unit, {form('p')} AS f FROM part) JOIN known USING (f) WHERE f <> ''),
    per AS (SELECT doc_id, min(license) FILTER (unit = 'text') AS text_license,
              string_agg(DISTINCT license, ',' ORDER BY license) AS licenses,
              greatest(count(*) FILTER (unit = 'line'), count(*) FILTER (unit = 'text')) AS n_notices FROM hit GROUP BY doc_id)
    SELECT DISTINCT d.doc_id, text_license, coalesce(licenses, '') AS licenses, coalesce(n_notices, 0) AS n_notices
    FROM documents d LEFT JOIN per USING (doc_id)"""
