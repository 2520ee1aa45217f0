"""Quality by perplexity under interpolated modified Kneser-Ney models of trusted text.

Documents are dealt to folds by their ids.  There is one model for each fold, learned
from the whole texts of the trusted rows of all other folds, and every document is
scored by the model of its own fold.  So no trusted document is scored by a model that
learned from it, all are scored by models of the same size, and one rule serves large
and small languages: a document is kept where its perplexity is at most the threshold
of its language, a quantile over all its trusted documents times a margin.  A language
without any has no threshold and is kept.

A model counts runs of four characters.  Nothing of it is gathered: counts, contexts and
probabilities are tables with a column for each model, joined by n-gram, and an order is
computed from the one below.  A scan asks for each n-gram once per unit of some tens of
millions of characters; the probabilities go back to the unit, where they meet its
compressed texts, and one row comes of each document.

Characters are 16-bit codes (rarer planes share codes, digits are one, white space is
one blank); case is kept.  A text starts after three marks 0 and ends with a mark 1.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidewarden.sources.stage import stage

ORDER, CODE, CODES = 4, 16, 1 << 16
FOLDS = 5
QUANTILE, MARGIN = 0.99, 1.05
#: Ids up to which they are broadcast (some tens of MB); beyond it they are joined by shuffling.
SMALL = 1 << 20
#: Characters of a unit, which gets each probability once, and of the parts it is worked on in.
_UNIT, _PART = 32 << 20, 1 << 20
#: Documents of a part.
_DOCS = 1 << 15

_BLANKS = np.zeros(CODES, bool)
_BLANKS[[9, 10, 11, 12, 13, 32, 133, 160, 0x2028, 0x2029, 0x3000, 0, 1]] = True


def codes_of(text: str) -> np.ndarray:
    """Codes of a text with its end mark; empty for a text without anything but white space."""
    c = (np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4") & (CODES - 1)).astype(np.int64)
    c[(c >= 48) & (c <= 57)] = 48
    blank = _BLANKS[c]
    c[blank] = 32
    c = c[~(blank & np.concatenate([[True], blank[:-1]]))] if len(c) else c
    c = c[:-1] if len(c) and c[-1] == 32 else c
    return np.append(c, 1) if len(c) else c


def grams_of(codes: np.ndarray) -> np.ndarray:
    """One n-gram per code: it and the three before, packed from high to low."""
    p = np.concatenate([np.zeros(ORDER - 1, np.int64), codes])
    n, out = len(codes), np.zeros(len(codes), np.int64)
    for k in range(ORDER):
        out = (out << CODE) | p[k:k + n]
    return out


def _count_columns() -> list[str]:
    return [f"c{f}" for f in range(FOLDS)]


def _counts(trusted: DataFrame) -> DataFrame:
    """(gram, c0, c1, ...): n-grams of ``trusted`` (fold, text), counted outside each fold; not yet added up."""
    names = ["gram", *_count_columns()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(parts: list[tuple[np.ndarray, int]]) -> pa.RecordBatch:
            found, at = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
            fold = np.concatenate([np.full(len(g), f) for g, f in parts])
            n = np.bincount(at * FOLDS + fold, minlength=len(found) * FOLDS).reshape(-1, FOLDS)
            outside = n.sum(axis=1, keepdims=True) - n
            return pa.RecordBatch.from_arrays([pa.array(found), *[pa.array(outside[:, f]) for f in range(FOLDS)]], names=names)

        held, size = [], 0
        for batch in batches:
            for fold, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                grams = grams_of(codes_of(text.as_py() or ""))
                held.append((grams, fold))
                size += len(grams)
                if size >= _PART:
                    yield done(held)
                    held, size = [], 0
        if size:
            yield done(held)

    return trusted.select("fold", "text").mapInArrow(run, ", ".join(f"{n} long" for n in names))


def _suffix(gram: Column, order: int) -> Column:
    return gram.bitwiseAND(F.lit((1 << CODE * (order - 1)) - 1))


def _discounts(counts: DataFrame, columns: list[str]) -> dict[str, list[float]]:
    """By count column, discounts of counts 1, 2 and above, from the numbers of n-grams seen 1 to 4 times."""
    row = counts.agg(*[F.count(F.when(F.col(c) == i, 1)).alias(f"{c}_{i}") for c in columns for i in range(1, 5)]).first()

    def of(n: list[int]) -> list[float]:
        if not n[0]:
            return [0.5, 0.5, 0.5]
        y = n[0] / (n[0] + 2 * n[1])
        return [min(max(i + 1 - (i + 2) * y * n[i + 1] / n[i], 0.1), i + 0.9) if n[i] and n[i + 1] else 0.5 for i in range(3)]

    return {c: of([row[f"{c}_{i}"] for i in range(1, 5)]) for c in columns}


def probabilities(grams: DataFrame) -> DataFrame:
    """(gram, logp...) of every row of ``grams`` (gram, c...: count learned, 0 if unseen), by model.

    Each column beside ``gram`` is a model; what follows its ``c`` also follows ``logp``.
    Highest order by counts, lower ones by the number of distinct n-grams they end;
    the lowest is interpolated with all codes alike.
    """
    columns = [c for c in grams.columns if c != "gram"]
    tables = {ORDER: grams}
    for k in range(ORDER - 1, 0, -1):
        above = tables[k + 1]
        tables[k] = stage(above.groupBy(_suffix(F.col("gram"), k + 1).alias("gram"))
                          .agg(*[F.count(F.when(F.col(c) > 0, 1)).alias(c) for c in columns]))
    lower: DataFrame | None = None
    for k in range(1, ORDER + 1):
        now = tables[k].withColumns({"h": F.shiftrightunsigned("gram", CODE), "low": _suffix(F.col("gram"), k)})
        cuts = _discounts(tables[k], columns)
        off = {c: F.when(F.col(c) == 0, 0.0).when(F.col(c) == 1, d[0]).when(F.col(c) == 2, d[1]).otherwise(d[2])
               for c, d in cuts.items()}
        contexts = now.filter(F.greatest(F.lit(0), *columns) > 0).groupBy("h").agg(
            *[F.sum(c).alias(f"total_{c}") for c in columns], *[F.sum(off[c]).alias(f"freed_{c}") for c in columns])
        # One code makes at most CODES contexts, or n-grams of the first order.
        contexts = F.broadcast(contexts) if k <= 2 else contexts
        joined = now.join(contexts, "h", "left")
        if lower is None:
            joined = joined.withColumns({f"below_{c}": F.lit(1.0 / CODES) for c in columns})
        else:
            joined = joined.join(F.broadcast(lower) if k == 2 else lower, "low")

        def p(c: str) -> Column:
            total, below = F.nullif(F.col(f"total_{c}"), F.lit(0)), F.col(f"below_{c}")
            return F.coalesce((F.col(c) - off[c] + F.col(f"freed_{c}") * below) / total, below)

        scored = stage(joined.select("gram", *[p(c).alias(c) for c in columns]))
        lower = scored.select(F.col("gram").alias("low"), *[F.col(c).alias(f"below_{c}") for c in columns])
    return scored.select("gram", *[F.ln(c).alias("logp" + c[1:]) for c in columns])


class _Units:
    """Numbers of the units of one partition: a unit ends once it holds _UNIT characters."""

    def __init__(self):
        self.unit, self.size = TaskContext.get().partitionId() << 24, 0

    def after(self, size: int) -> bool:
        """Count a document; whether the unit ends with it."""
        self.size += size
        if self.size < _UNIT:
            return False
        self.unit, self.size = self.unit + 1, 0
        return True


def _asked(docs: DataFrame) -> DataFrame:
    """(unit, gram): the distinct n-grams of every unit of ``docs`` (text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(unit: int, parts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            grams = np.sort(pd.unique(np.concatenate(parts))) if parts else np.zeros(0, np.int64)
            for at in range(0, len(grams), 50_000):
                some = grams[at:at + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), unit)), pa.array(some)], names=["unit", "gram"])

        units, parts, held, size = _Units(), [], [], 0
        for batch in batches:
            for text in batch.column(0):
                grams, unit = grams_of(codes_of(text.as_py() or "")), units.unit
                held.append(grams)
                size += len(grams)
                ends = units.after(len(grams))
                if ends or size >= _PART:
                    parts = [pd.unique(np.concatenate([*parts, *held]))]
                    held, size = [], 0
                if ends:
                    yield from done(unit, parts)
                    parts = []
        yield from done(units.unit, parts + held)

    return docs.select("text").mapInArrow(run, "unit long, gram long")


_PARTS = "unit long, doc_id array<long>, lang array<string>, fold array<int>, bytes array<long>, texts binary"


def _texts(docs: DataFrame) -> DataFrame:
    """Parts of the units of ``docs`` (doc_id, lang, fold, text), the same units as of :func:`_asked`; texts compressed."""
    names = [f.split()[0] for f in _PARTS.split(", ")]
    kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        packer = zstandard.ZstdCompressor(level=3)

        def done(unit: int, rows: list[tuple]) -> pa.RecordBatch:
            ids, langs, folds, texts = zip(*rows)
            row = [unit, ids, langs, folds, [len(t) for t in texts], packer.compress(b"".join(texts))]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names=names)

        units, rows, size = _Units(), [], 0
        for batch in batches:
            for doc, lang, fold, text in zip(*[batch.column(k).to_pylist() for k in range(3)], batch.column(3)):
                text = text.as_py() or ""
                codes, unit = len(codes_of(text)), units.unit
                rows.append((doc, lang, fold, text.encode("utf-8", "surrogatepass")))
                size += len(text)
                if units.after(codes) or size >= _PART or len(rows) >= _DOCS:
                    yield done(unit, rows)
                    rows, size = [], 0
        if rows:
            yield done(units.unit, rows)

    return docs.select("doc_id", "lang", "fold", "text").mapInArrow(run, _PARTS)


def _summed(key: tuple, parts: pa.Table, known: pa.Table) -> pa.Table:
    """doc_id, lang, fold, size, logp of a unit's documents, from its texts and its n-grams' probabilities."""
    import zstandard

    unpacker, out = zstandard.ZstdDecompressor(), []
    place = pd.Index(known.column("gram").to_numpy())
    logp = np.column_stack([known.column(f"logp{f}").to_numpy() for f in range(FOLDS)])
    for part in parts.to_pylist():
        data, at, each = unpacker.decompress(part["texts"]), 0, []
        for n in part["bytes"]:
            each.append(grams_of(codes_of(data[at:at + n].decode("utf-8", "surrogatepass"))))
            at += n
        size, fold = np.array([len(g) for g in each]), np.array(part["fold"])
        where = place.get_indexer(np.concatenate(each))
        if len(where) and where.min() < 0:
            raise RuntimeError("the documents came in another order when read again; write them to a table first")
        total = np.bincount(np.repeat(np.arange(len(each)), size), weights=logp[where, np.repeat(fold, size)], minlength=len(each)).astype(float)
        out.append(pa.table({"doc_id": pa.array(part["doc_id"], pa.int64()), "lang": pa.array(part["lang"], pa.string()),
                             "size": pa.array(size), "logp": pa.array(total)}))
    return pa.concat_tables(out) if out else pa.table({"doc_id": pa.array([], pa.int64()), "lang": pa.array([], pa.string()),
                                                       "size": pa.array([], pa.int64()), "logp": pa.array([], pa.float64())})


def _fold(doc_id: Column) -> Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(FOLDS)).cast("int")


def _ids(trusted: DataFrame) -> DataFrame:
    ids = trusted.select("doc_id").dropna().distinct()
    return F.broadcast(ids) if ids.count() <= SMALL else ids


def perplexities(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """doc_id, lang, perplexity of every row of ``docs``; null for a text without a character.

    ``trusted`` (doc_id): the rows to learn from.  ``docs`` is read twice and must give
    the same rows in the same partitions and order, as a table does; an error otherwise.
    """
    flat = docs.select("doc_id", "lang", _fold(F.col("doc_id")).alias("fold"), "text")
    asked = stage(_asked(flat))
    columns = _count_columns()
    unseen = asked.select("gram", *[F.lit(0).cast("long").alias(c) for c in columns])
    learned = _counts(flat.join(_ids(trusted), "doc_id", "left_semi"))
    grams = stage(unseen.unionByName(learned).groupBy("gram").agg(*[F.sum(c).alias(c) for c in columns]))
    answers = asked.join(probabilities(grams), "gram")
    scored = (_texts(flat).groupBy("unit").cogroup(answers.groupBy("unit"))
              .applyInArrow(_summed, "doc_id long, lang string, size long, logp double"))
    return scored.select("doc_id", "lang", F.when(F.col("size") > 0, F.exp(-F.col("logp") / F.col("size"))).alias("perplexity"))


def _same_lang(a: DataFrame, b: DataFrame, how: str) -> DataFrame:
    """``a`` with what ``b`` (lang, ...) has of its language; a null one is a language too."""
    b = b.withColumnRenamed("lang", "_lang")
    return a.join(b, F.col("lang").eqNullSafe(F.col("_lang")), how).drop("_lang")


def thresholds(held: DataFrame, quantile: float = QUANTILE, margin: float = MARGIN) -> DataFrame:
    """(lang, most) by language, from perplexities of trusted documents (lang, perplexity); a null ``lang`` is one too."""
    each = F.percentile_approx("perplexity", F.lit(quantile), F.lit(10_000)) * margin
    return held.groupBy("lang").agg(each.alias("most"))


def judged(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, margin: float = MARGIN) -> DataFrame:
    """doc_id, lang, perplexity, most (the threshold), kept: one row per row of ``docs``.

    Trusted: ids with rows in ``labels`` of which each has quality 1 and toxic 0.  A text without a character is not
    kept.  A language without trusted rows has no threshold, and its texts with a character
    are kept.  Repeated rows get a row each; null ids are scored and never trusted.
    """
    # An id that is labelled both good and bad is not trusted.
    trusted = (labels.groupBy("doc_id").agg(F.min((F.expr("quality = 1 AND toxic = 0")).cast("int")).alias("good"))
               .filter("good = 1").select("doc_id"))
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text")
    scores = stage(perplexities(plain, trusted))
    most = stage(thresholds(scores.join(_ids(trusted), "doc_id", "left_semi"), quantile, margin))
    return (_same_lang(scores, F.broadcast(most) if most.count() <= SMALL else most, "left")
            .select("doc_id", "lang", "perplexity", "most",
                    (F.col("perplexity").isNotNull() & F.coalesce(F.col("perplexity") <= F.col("most"), F.lit(True))).alias("kept")))


def keep_good(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` that :func:`judged` keeps; rows that share an id go only where all are rejected.

    Only ids of rejected documents meet the texts: few ids are broadcast, many shuffled.
    """
    book = judged(docs, labels, **how)
    fate = book.groupBy("doc_id").agg(F.max("kept").alias("kept"))
    out = stage(fate.filter(~F.col("kept")).select("doc_id"))
    out = F.broadcast(out) if out.count() <= SMALL else out
    null_gone = out.filter("doc_id IS NULL").count() > 0
    left = docs.join(out, "doc_id", "left_anti").select(*docs.columns)
    return left.filter("doc_id IS NOT NULL") if null_gone else left


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "text")
    out = judged(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return out.select("doc_id", "lang", F.round("perplexity", 6).alias("perplexity"),
                      F.round("most", 6).alias("threshold"), "kept")
