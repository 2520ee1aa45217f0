"""Secrets in texts: fixed patterns, and random strings by token efficiency.

A vocabulary of byte pairs spends few tokens on words and many on random strings.  Of a
long run of key characters, what other spans, UUIDs and digests leave is cut at its
separators; neighbouring pieces with few characters per token make a span.  Plain
numbers and strings of a few characters are none.  Everything happens where the text is
read; only spans leave the scan.
"""

import base64
import hashlib
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Kinds in the order in which spans with an equal start are listed.
KINDS = ("assign", "access", "hex", "random")
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Shortest run that is measured, and the characters per token below which it counts as random.
MIN_RUN, MAX_RATIO = 20, 2.2
#: The same of a run of letters of one case, which a word is too.
MAX_RATIO_LETTERS = 2.0
#: Shortest rest of a run that another span, a UUID or a digest is cut out of.
MIN_REST = 12
#: Pieces between separators shorter than this are too short to be measured by themselves.
MIN_PIECE = 6
PLACEHOLDER = "[secret]"

# What a secret looks like, by kind.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.IGNORECASE | re.ASCII)
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
MIN_ASSIGN, MIN_ACCESS = 12, 18

# Strings that look random but are known shapes.
DIGEST_HEX = (32, 40, 56, 64, 96, 128)  # MD5, SHA-1, SHA-224, -256, -384, -512
UUID = re.compile(r"(?<![0-9A-Za-z])[0-9A-Fa-f]{8}-(?:[0-9A-Fa-f]{4}-){3}[0-9A-Fa-f]{12}(?![0-9A-Za-z])")
_UPPER_HEX = re.compile(r"(?<![0-9A-Za-z])[0-9A-F]{32,128}(?![0-9A-Za-z])")
_RUN = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % MIN_RUN)
_PIECE = re.compile(r"[A-Za-z0-9]+")

Span = tuple[str, int, int]


class Scanner:
    """All spans of one text; holds the vocabulary."""

    def __init__(self, vocabulary: str | None = None, max_ratio: float = MAX_RATIO):
        import public_tokenizers
        import tiktoken

        with open(vocabulary or public_tokenizers.path(VOCABULARY), "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                                          special_tokens={})
        self.max_ratio = max_ratio

    def ratio(self, run: str) -> float:
        """Characters per token."""
        return len(run) / max(1, len(self.encoding.encode_ordinary(run)))

    def base(self, text: str) -> list[Span]:
        found, low = [], text.lower()
        if any(w in low for w in ASSIGN_WORDS):
            found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGN]
        if "AKIA" in text:
            found += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
        found += [("hex", *m.span()) for m in HEX.finditer(text)]
        return in_order(found)

    def is_random(self, run: str) -> bool:
        """Letters with few characters per token; of several characters."""
        if len(set(run)) < 8 or not any(c.isalpha() for c in run):
            return False
        one_case = run.isalpha() and (run.islower() or run.isupper())
        return self.ratio(run) < (min(self.max_ratio, MAX_RATIO_LETTERS) if one_case else self.max_ratio)

    def random(self, text: str, taken: list[Span]) -> list[Span]:
        """Random parts of runs of key characters that no span of ``taken`` touches."""
        found, at = [], 0
        for m in _RUN.finditer(text):
            while at < len(taken) and taken[at][2] <= m.start():
                at += 1
            cuts = []
            for k in range(at, len(taken)):
                if taken[k][1] >= m.end():
                    break
                cuts.append(taken[k][1:])
            cuts += [u.span() for u in UUID.finditer(text, m.start(), m.end())]
            cuts += [d.span() for d in _UPPER_HEX.finditer(text, m.start(), m.end()) if d.end() - d.start() in DIGEST_HEX]
            least, start = MIN_REST if cuts else MIN_RUN, m.start()
            for s, e in [*sorted(cuts), (m.end(), m.end())]:
                if s - start >= least:
                    found += [("random", *span) for span in self._parts(text, start, s, least)]
                start = max(start, e)
        return found

    def _parts(self, text: str, start: int, end: int, least: int) -> Iterator[tuple[int, int]]:
        """Neighbouring random pieces of a rest of a run; very short ones go with their neighbours unless plain letters."""
        group: list[tuple[int, int, bool]] = []
        for p in [*_PIECE.finditer(text, start, end), None]:
            if p:
                piece = p[0]
                short = len(piece) < MIN_PIECE
                if short and not (piece.isalpha() and (piece.islower() or piece.isupper() or piece.istitle())):
                    group.append((*p.span(), False))
                    continue
                if not short and self._piece_is_random(piece):
                    group.append((*p.span(), True))
                    continue
            if any(sure for _, _, sure in group):
                s, e = group[0][0], group[-1][1]
                if e - s >= least and self.is_random(text[s:e]):
                    yield s, e
            group = []

    def _piece_is_random(self, piece: str) -> bool:
        return piece.isdigit() or self.ratio(piece) < (
            min(self.max_ratio, MAX_RATIO_LETTERS) if piece.isalpha() and (piece.islower() or piece.isupper()) else self.max_ratio)

    def spans(self, text: str) -> list[Span]:
        base = self.base(text)
        return in_order(base + self.random(text, base))


def in_order(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def redacted(text: str, spans: list[Span], placeholder: str = PLACEHOLDER) -> str:
    """The text with every run of overlapping spans replaced by one placeholder."""
    out, at = [], 0
    for _, s, e in spans:
        if s >= at:
            out += [text[at:s], placeholder]
        at = max(at, e)
    return "".join(out) + text[at:]


def secret_spans(docs: DataFrame, vocabulary: str | None = None, max_ratio: float = MAX_RATIO,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, counts of the base kinds, base digest, all spans.

    Whole texts; positions are code points, ends exclusive.  Null text: an empty one,
    with no span and the digest of the empty string.  Repeated rows stay.
    """
    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(vocabulary, max_ratio)
        for batch in batches:
            columns: list[list] = [[] for _ in range(5)]
            for text in batch.column(1):
                text = text.as_py() or ""
                base = scanner.base(text)
                kinds = [k for k, _, _ in base]
                row = [kinds.count(k) for k in KINDS[:3]]
                row += [hashlib.sha256(joined(base).encode()).hexdigest(),
                        joined(in_order(base + scanner.random(text, base)))]
                for column, value in zip(columns, row):
                    column.append(value)
            kinds = [pa.int64()] * 3 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds)]],
                names=[f.split()[0] for f in schema.split(", ")])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def redact(docs: DataFrame, vocabulary: str | None = None, max_ratio: float = MAX_RATIO) -> DataFrame:
    """``docs`` with every secret in ``text`` replaced; ``n_chars``, where there is one, follows.

    Texts without a secret, and null texts, stay as they are.
    """
    @F.pandas_udf("string")
    def clean(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scanner = Scanner(vocabulary, max_ratio)
        for texts in parts:
            yield texts.map(lambda t: t if t is None else redacted(t, scanner.spans(t)))

    out = docs.withColumn("text", clean("text"))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) \
        if "n_chars" in docs.columns else out


def query(spark, sf_dir: str) -> DataFrame:
    return secret_spans(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
