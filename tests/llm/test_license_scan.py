import re
import textwrap
from pathlib import Path

import duckdb
from pyspark.sql.functions import col

from tidewarden.llm import license_scan as op

MIT = dict((v, k) for k, v in op.KNOWN if k == "MIT")


def scan(spark, texts):
    df = spark.createDataFrame([(i, t, "mine") for i, t in enumerate(texts)], "doc_id long, text string, digest string")
    return {r.doc_id: (r.text_license, r.licenses, r.n_notices) for r in op.license_scan(df).collect()}


def test_forms_of_one_licence(spark):
    full = op._MIT
    texts = [full, full.upper(), "Copyright (c) 2020 A. Person\n" + full, "MIT License\n\nCopyright 1999-2001 X, Inc.\nAll rights reserved.\n\n" + full,
             full.replace("sublicense", "sub-licence").replace('"', "'"), full.replace("\n", "\r\n * "), full + " And more.",
             "some text\n\nReleased under the MIT Licence!\nmore", "Released under the MIT License.",
             "x\nLicensed under CC BY-NC 4.0.\nLicensed under the Apache License, version 2.0\nlicensed under CC BY-NC 4.0"]
    got = scan(spark, texts)
    assert all(got[i] == ("MIT", "MIT", max(1, got[i][2])) for i in range(6)), got
    assert got[6] == (None, "", 0)
    assert got[7] == (None, "MIT", 1) and got[8] == ("MIT", "MIT", 1)
    assert got[9] == (None, "Apache-2.0,CC-BY-NC-4.0", 3)


def test_edge_cases(spark):
    got = scan(spark, [None, "", " \n \n", "...\n---", "word " * 50_000, "©\n"])
    assert set(got.values()) == {(None, "", 0)} and len(got) == 6
    df = spark.createDataFrame([(1, "Licensed under CC BY 4.0."), (1, "Licensed under CC BY 4.0."), (None, "SPDX-License-Identifier: MIT")],
                               "doc_id long, text string")
    rows = sorted(map(tuple, op.license_scan(df).collect()), key=repr)
    assert rows == [(1, "CC-BY-4.0", "CC-BY-4.0", 2), (None, "MIT", "MIT", 1)]
    assert op.license_scan(df.limit(0)).count() == 0


def test_known_texts_are_told_apart(spark):
    table = op.digests(op.known_table(spark)).groupBy("digest").count()
    assert table.filter("count > 1").count() == 0


def test_sql_says_the_same(spark):
    sf = "/root/testdata/sf0.01"
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    mine = sorted(map(repr, map(tuple, op.query(spark, sf).collect())))
    want = sorted(map(repr, duckdb.sql(op.oracle()).fetchall()))
    assert mine == want and any("CC-BY" in r for r in mine)


def test_each_spelling_becomes_its_equivalent(spark):
    said = {"Licence": "license", "organised": "organized", "favour": "favor",
            "sub-licensing": "sublicensing", "acknowledgement": "acknowledgment", "5 per cent": "5 percent",
            "https://a": "http a", "behaviour colour honour": "behavior color honor"}
    rows = spark.createDataFrame([(k, v) for k, v in said.items()], "text string, form string")
    assert {r.text: r.got for r in rows.withColumn("got", op.canonical(col("text"))).collect()} == said


STANDARD_MIT = [  # a paragraph each
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
    'files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, '
    "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
    "Software is furnished to do so, subject to the following conditions:",
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE '
    "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR "
    "COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, "
    "ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."]
NOTICES = ["Copyright (c) 2020 A. Person", "Copyright 1999-2001 X, Inc.", "(c) 2020 X", "© A. Person", "Copyright A. Person and others",
           "Copyright (c) <year> <copyright holders>", "Copyright [yyyy] [name of copyright owner]", "(C) Jane Doe",
           "Copyright (C) 2001, 2002 The Regents. All rights reserved.", " * Copyright: 2014 X", "Copyright The Project Authors"]


def wraps(paragraphs, widths):
    return ["\n\n".join(paragraphs), *["\n\n".join(textwrap.fill(p, w, break_long_words=False) for p in paragraphs) for w in widths]]


def test_a_licence_is_found_in_any_wrap(spark):
    texts = wraps(STANDARD_MIT, range(12, 160))
    assert any("\nCOPYRIGHT HOLDERS" in t for t in texts) and any("\ncopyright notice" in t for t in texts)
    got = scan(spark, texts + [f"MIT License\n\n{n}\n\n{texts[0]}" for n in NOTICES])
    assert {k: v[:2] for k, v in got.items()} == dict.fromkeys(got, ("MIT", "MIT"))


def test_notices_go_and_prose_stays(spark):
    prose = ["copyright holders be liable for", "copyright holders", "copyright notice", "COPYRIGHT OWNER OR CONTRIBUTORS BE LIABLE",
             "copyright license to reproduce", "(c) You must retain, in the Source form", "(c) You must", "copyright law.", "copyright"]
    rows = spark.createDataFrame([(t,) for t in NOTICES + prose], "text string").withColumn("got", op.canonical(col("text"))).collect()
    assert {r.text for r in rows if not r.got} == set(NOTICES)


def paragraphs(text):
    return [" ".join(p.split()) for p in re.split(r"\n\s*\n", text) if p.strip()]


ENTIRE = {p.stem: p.read_text() for p in Path(op.__file__).with_name("licenses").glob("*.txt")}


def test_entire_texts_are_found_in_any_wrap(spark):
    texts = [(k, t) for k, whole in ENTIRE.items() for t in [whole, whole.replace("\n", "\r\n"), *wraps(paragraphs(whole), (60, 65, 72, 76, 80, 100))]]
    got = scan(spark, [t for _, t in texts])
    assert {i: (k, got[i][:2]) for i, (k, _) in enumerate(texts)} == {i: (k, (k, k)) for i, (k, _) in enumerate(texts)}
    assert {"Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "CC0-1.0", "CC-BY-SA-4.0", "GPL-2.0", "GPL-3.0", "MPL-2.0", "Unlicense"} <= set(ENTIRE)


def test_copies_name_holders_and_leave_out(spark):
    bsd3, apache, gpl2 = ENTIRE["BSD-3-Clause"], ENTIRE["Apache-2.0"], ENTIRE["GPL-2.0"]
    mine = (bsd3.replace("the University", "Example Ltd.").replace("THE REGENTS AND CONTRIBUTORS", "THE COPYRIGHT HOLDERS AND CONTRIBUTORS")
            .replace("THE REGENTS OR CONTRIBUTORS", "THE COPYRIGHT OWNER OR CONTRIBUTORS").replace("The Regents of the University of California", "2019 E"))
    texts = [("BSD-3-Clause", "BSD 3-Clause License\n\n" + mine), ("BSD-3-Clause", re.sub(r"(?m)^\d\.", "*", mine)),
             ("Apache-2.0", apache.replace("[yyyy] [name of copyright owner]", "2020 Example Ltd.")),
             ("Apache-2.0", apache[:apache.index("   APPENDIX")]), ("GPL-2.0", gpl2[:gpl2.index("            How to Apply")]),
             ("GPL-2.0", gpl2.replace("51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA", "59 Temple Place, Suite 330, Boston, MA  02111-1307  USA")),
             ("CC0-1.0", ENTIRE["CC0-1.0"].replace("Creative Commons Legal Code\n", ""))]
    got = scan(spark, [t for _, t in texts])
    assert [got[i][0] for i in range(len(texts))] == [k for k, _ in texts]
    other = scan(spark, [mine.replace("with or without\nmodification", "without modification"), apache[:5000], gpl2 + "\nMore."])
    assert all(v[0] is None for v in other.values())


def test_header_notices(spark):
    apache = ENTIRE["Apache-2.0"]
    header = apache[apache.index("   Licensed under"):]
    commented = "# Copyright 2020 X\n#\n" + "".join(f"# {line}\n" for line in header.split("\n")) + "\nimport os\n"
    gpl = ENTIRE["GPL-3.0"]
    gpl = gpl[gpl.index("    This program is free software: you can"):gpl.index("Also add information")]
    got = scan(spark, [header + "\n\nimport os", commented, "Copyright (C) 2020 X\n\n" + gpl, gpl + "\nimport os"])
    assert [got[i][:2] for i in range(4)] == [(None, "Apache-2.0"), (None, "Apache-2.0"),
                                              ("GPL-3.0-or-later",) * 2, (None, "GPL-3.0-or-later")]
