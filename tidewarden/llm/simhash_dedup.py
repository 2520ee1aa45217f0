"""Near duplicates by SimHash with deletion-variant signatures.

A fingerprint of 64 bits is cut into two segments of 32.  Where two fingerprints
differ in at most two bits, one segment differs in at most one, so both sides have
a common *variant*: that segment with one bit replaced by a wildcard.  Variants are
indexed, joined by equality, and the whole fingerprints verified.

Copies meet before the index: the index holds distinct fingerprints.  A crowd of
fingerprints around one variant would give pairs in the square of its size; its
members are indexed by whole fingerprints with two wildcards instead, where a key
has four members at most and all of them are links.  Nothing is capped.
"""

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from tidewarden.llm.components import components
from tidewarden.sources.stage import stage

BITS, SEGMENT = 64, 32
#: Members of a one-wildcard variant from which two wildcards are used.
CROWD = 256
#: Shared variants (two longs each) up to which they are broadcast; beyond it both sides are shuffled.
SMALL = 1 << 18
_SLICE = 1 << 15


def text_fingerprint(data: bytes | None, shingle: int) -> int:
    """SimHash of a text's lower-cased word shingles (repeats count); 0 without a word.

    Only A-Z are lowered and only ASCII white space separates words: that is what
    ``bytes.lower`` and ``bytes.split`` do.
    """
    words = (data or b"").lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), 42)]
    else:
        digest, join = xxhash.xxh64_intdigest, b" ".join
        hashes = [digest(join(t), 42) for t in zip(*(words[i:] for i in range(shingle)))]
    h = np.array(hashes, dtype="<u8")
    ones = np.zeros(BITS, dtype=np.int64)
    for i in range(0, len(h), _SLICE):  # a very long text in slices: memory stays flat
        part = h[i:i + _SLICE].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * ones > len(h)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp long) of every row; a null text is an empty one."""
    @F.pandas_udf("long")
    def fp(texts: pd.Series) -> pd.Series:
        return pd.Series([text_fingerprint(t, shingle) for t in texts], dtype="int64")

    return docs.select(F.col(id_col).alias("id"), fp(F.col(text_col).cast("binary")).alias("fp"))


def _variants(fps: DataFrame) -> DataFrame:
    """(key, fp): each segment with each of its bits as a wildcard; the key names both."""
    j = F.col("j").cast("int")
    segment = F.expr("shiftrightunsigned(fp, CASE WHEN j >= 32 THEN 32 ELSE 0 END) & 4294967295L")
    hidden = F.expr("~shiftleft(1L, CAST(j % 32 AS INT))")
    return (fps.select("fp", F.explode(F.sequence(F.lit(0), F.lit(BITS - 1))).alias("j"))
            .select(F.shiftleft(j.cast("long"), SEGMENT).bitwiseOR(segment.bitwiseAND(hidden)).alias("key"), "fp"))


def _whole_variants(fps: DataFrame) -> DataFrame:
    """(key struct, fp): the whole fingerprint with every two bits as wildcards."""
    pairs = F.expr("flatten(transform(sequence(0, 62), i -> transform(sequence(i + 1, 63), j -> "
                   "struct(i, j))))")
    hidden = F.expr("~(shiftleft(1L, p.i) | shiftleft(1L, p.j))")
    return (fps.select("fp", F.explode(pairs).alias("p"))
            .select((F.col("p.i") * BITS + F.col("p.j")).alias("at"),
                    F.col("fp").bitwiseAND(hidden).alias("rest"), "fp"))


#: Of the variants that two close fingerprints share, the one that stands for the pair.
_FIRST_KEY = """CASE WHEN bit_count((a ^ b) & 4294967295L) = 0 THEN 0
    WHEN bit_count((a ^ b) & 4294967295L) = 1 THEN bit_count(((a ^ b) & 4294967295L) - 1)
    ELSE 32 END"""


def _close(max_bits: int):
    return F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits


def near_links(fps: DataFrame, max_bits: int = 2, crowd: int = CROWD) -> DataFrame:
    """Links (a, b) that connect all distinct fingerprints within ``max_bits`` (0 to 2).

    Not every pair of a crowd is listed, but every pair is connected by links that
    each hold: the components are those of all pairs.
    """
    if not 0 <= max_bits <= 2:
        raise ValueError("two segments with one wildcard find at most two differing bits")
    rows = _variants(fps)
    shared = stage(rows.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"))
    # Few keys are shared where fingerprints are few; the join then needs no second shuffle of all variants.
    wanted = F.broadcast(shared) if shared.count() <= SMALL else shared
    more = stage(rows.join(wanted, "key"))
    close = _close(max_bits) & (F.expr(_FIRST_KEY) == F.shiftright("key", SEGMENT))
    light = more.filter(F.col("n") <= crowd)
    some = (light.select("key", F.col("fp").alias("a")).join(light.select("key", F.col("fp").alias("b")), "key")
            .filter(F.col("a") < F.col("b")).filter(close).select("a", "b"))
    crowded = more.filter(F.col("n") > crowd).select("fp").distinct()
    # At most four fingerprints agree outside two wildcards, so the list has four entries at most.
    met = _whole_variants(crowded).groupBy("at", "rest").agg(F.collect_set("fp").alias("all")).filter(F.size("all") > 1)
    dense = (met.select("all", F.explode("all").alias("a")).select("a", F.explode("all").alias("b"))
             .filter("a < b").filter(_close(max_bits)))
    return some.unionByName(dense).distinct()


def simhash_groups(docs: DataFrame, shingle: int = 3, max_bits: int = 2, crowd: int = CROWD,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, fp (long), component (smallest id reachable).

    Null or empty texts have fingerprint 0 and link like any other; repeated rows
    stay; an empty table gives no rows; further columns are not looked at.
    """
    prints = stage(fingerprints(docs, shingle, id_col, text_col))
    classes = stage(prints.groupBy("fp").agg(F.min("id").alias("least")))
    found = components(near_links(classes.select("fp"), max_bits, crowd))
    # The component is named by a fingerprint; its smallest id comes from the classes.
    member = classes.join(found.select(F.col("id").alias("fp"), "component"), "fp", "left")
    member = member.withColumn("component", F.coalesce("component", "fp"))
    names = member.groupBy("component").agg(F.min("least").alias("name"))
    named = member.join(names, "component").select("fp", F.col("name").alias("component"))
    return prints.join(named, "fp").select("id", "fp", "component")


def keep_one(docs: DataFrame, shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its group.

    Of rows that share that id, the one whose text comes first in order stays.  Rows
    without an id can neither name a group nor be named by one, so they stay.
    """
    groups = simhash_groups(docs.filter("doc_id IS NOT NULL"), shingle, max_bits)
    first = groups.filter("id = component").select(F.col("id").alias("doc_id")).distinct()
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    kept = (docs.join(first, "doc_id", "left_semi").select("doc_id", row.alias("_row"))
            .groupBy("doc_id").agg(F.min_by("_row", F.struct("_row.text", F.to_json("_row"))).alias("_row")))
    return kept.select("_row.*").unionByName(docs.filter("doc_id IS NULL"))


def query(spark, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return simhash_groups(docs).select(
        F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.col("component").alias("component_id"))
