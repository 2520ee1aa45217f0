from collections import Counter, defaultdict

import corpus_pipeline
from tidewarden.llm import packing, secret_scan, simhash_dedup

SF = "/root/testdata/sf0.001"


def test_stages_against_a_plain_version(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before, steps = docs, {}
    for name, step in corpus_pipeline.STAGES:
        before = steps[name] = corpus_pipeline.stage(step(spark, before, SF))
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert all(steps[n].columns == docs.columns for n in names[:-1])
    rows = [{r.doc_id: r for r in steps[n].collect()} for n in names[:3]]
    whole = {r.doc_id: r for r in docs.collect()}
    # Classified: rows as they were, only some gone.
    assert 0 < len(rows[0]) < len(whole) and all(whole[i] == r for i, r in rows[0].items())
    # One of each group of near copies, by all pairs.
    prints = {i: simhash_dedup.text_fingerprint((r.text or "").encode(), 3) for i, r in rows[0].items()}
    name = {i: i for i in prints}
    changed = True
    while changed:
        changed = False
        for a in prints:
            for b in prints:
                if name[b] < name[a] and ((prints[a] ^ prints[b]) & (1 << 64) - 1).bit_count() <= 2:
                    name[a], changed = name[b], True
    assert rows[1].keys() == {i for i in name if name[i] == i}
    # Secrets replaced, nothing else touched.
    scan = secret_scan.Scanner()
    for i, r in rows[2].items():
        text = rows[1][i].text
        assert r.text == (text if text is None else secret_scan.redacted(text, scan.spans(text)))
    assert rows[2].keys() == rows[1].keys()
    # Every row dealt is packed whole, without gaps.
    dealt = Counter(r.doc_id for r in steps[names[3]].collect())
    assert dealt.keys() <= rows[2].keys()
    packed = steps[names[4]].collect()
    assert Counter(r.doc_id for r in packed if r.piece == 0) == dealt
    bins = defaultdict(list)
    for r in packed:
        bins[r.sequence_id].append((r.offset, r.length))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY


def test_odd_rows_go_through_every_stage(spark):
    good = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").join(
        spark.read.parquet(f"{SF}/labels.parquet").filter("quality = 1 AND toxic = 0"), "doc_id").limit(4).collect()]
    rows = [(9_000 + i, t, "en", "s", 1, "u", 7) for i, t in enumerate(good)]
    rows += [rows[0], (None, good[1], None, None, None, None, None), (9_100, None, None, None, None, None, None), (9_101, "", "en", "s", 0, "u", 7)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, uid string, fold int"
    steps, docs = {}, spark.createDataFrame(rows, schema)
    for name, step in corpus_pipeline.STAGES:
        docs = steps[name] = corpus_pipeline.stage(step(spark, docs, SF))
        if name != "best_fit_packing":
            assert docs.columns == schema.replace(",", "").split()[::2]
    ids = Counter(r.doc_id for r in steps["quality_classifier"].collect())
    assert ids[9_000] == 2 and ids[None] == 1 and not ids[9_100] and not ids[9_101]
    assert Counter(r.doc_id for r in steps["simhash_near_dedup"].collect()) == {9_000: 1, 9_001: 1, 9_002: 1, 9_003: 1, None: 1}
    assert {r.doc_id for r in docs.collect()} == {r.doc_id for r in steps["mixing_sources"].collect()}


def test_empty_corpus(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, step in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stage(step(spark, docs, SF))
    assert docs.count() == 0
