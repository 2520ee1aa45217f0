"""Best-fit packing of tokenised documents, hierarchically by residual room.

Documents are tokenised where they are read and leave that scan as pieces: ids never
travel, only lengths and checksums.  Pieces are dealt to tasks, each of which packs
its own by best fit in decreasing order.  Bins that are nearly full are done; the
others become items of the next, smaller round, dealt anew, until one task holds all
that are left or a round merges hardly any (bins that no other fits into).  A task never
packs more than a set number of items at once and gets about as many, so the number of
tasks grows with the input while the tasks do not.
"""

import re
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from tidewarden.sources.stage import stage

VOCABULARY, END_ID, CAPACITY = "byte_bpe_50k.json", 2, 1024
#: Items of one packing task; rounds end when one task takes all, or
PER_TASK = 50_000
#: when a round leaves more than this share of its items as bins.
HARDLY_MERGED = 31 / 32
#: A bin with at most this share of its room left is done.
NEARLY_FULL = 1 / 64

#: Texts handed on at once.
_ROWS = 256
# The splitter of byte-level vocabularies.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Runs without a place to cut; merging them takes the square of their length in the fast encoder.
_LONG_RUN = re.compile(r"\S{500}|\s{500}")


def _byte_characters() -> dict[str, int]:
    """The character that byte-level vocabularies write for each byte: itself if printable, else from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


def byte_ranks(model: dict) -> dict[bytes, int] | None:
    """Ids by bytes, where a tokenizer file's ids are its merge order (plain byte-level); else None."""
    splitter = model.get("pre_tokenizer") or {}
    if (model["model"].get("type") != "BPE" or model.get("normalizer") or splitter.get("type") != "ByteLevel"
            or splitter.get("add_prefix_space") or not splitter.get("use_regex", True)):
        return None
    of, vocab = _byte_characters(), model["model"]["vocab"]
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["model"]["merges"]]
    if any(vocab.get(a + b) != 256 + k for k, (a, b) in enumerate(merges)):
        return None
    return {bytes(of[c] for c in token): i for token, i in vocab.items() if i < 256 + len(merges)}


class Encoder:
    """Token ids of whole texts as arrays of unsigned 32-bit numbers.

    Ids are the tokenizer file's own.  Plain byte-level vocabularies are encoded by ranks;
    the file's tokenizer itself takes other vocabularies, texts with the name of a special
    token and texts with very long runs of one kind.
    """

    def __init__(self, path: str):
        import json

        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            model = json.load(file)
        ranks = byte_ranks(model)
        self.named = [t["content"] for t in model.get("added_tokens") or []]
        self.fast = ranks and tiktoken.Encoding("ranks", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        if self.fast and not any(t in text for t in self.named) and not _LONG_RUN.search(text):
            return self.fast.encode_to_numpy(text, disallowed_special=())
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids: whole capacities but for the first."""
    first = n if n <= capacity else n % capacity or capacity
    return [(0, first), *[(s, capacity) for s in range(first, n, capacity)]]


def pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None, end_id: int = END_ID,
           id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(uid, doc_id, piece, start, length, ids_crc32): the token pieces of every row.

    ``vocabulary``: path of a tokenizer file, by default the public byte-level one.
    A null text is an empty one: its only id is the end.  Repeated rows give repeated
    pieces, each with a ``uid`` of its own; a null id stays null.
    """
    schema = "uid long, doc_id long, piece int, start long, length long, ids_crc32 long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        import public_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder = Encoder(vocabulary or public_tokenizers.path(VOCABULARY))
        uid = TaskContext.get().partitionId() << 40
        names = [f.split()[0] for f in schema.split(", ")]
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                part = batch.slice(at, _ROWS)
                ids = part.column(0).to_pylist()
                rows = []
                for doc, text in zip(ids, part.column(1)):
                    data = np.append(encoder.ids(text.as_py() or ""), end_id).astype("<u4")
                    for k, (start, length) in enumerate(cut(len(data), capacity)):
                        rows.append((uid, doc, k, start, length, zlib.crc32(data[start:start + length])))
                        uid += 1
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def best_fit(ids: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best fit in decreasing order: bin (its first item's id), offset in it, and the bin's load, by item."""
    rooms: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, names, loads = 0, [], []  # mask: bit r is set where a bin with room r is open
    where, offset = np.empty(len(ids), np.int64), np.empty(len(ids), np.int64)
    for k in np.lexsort((ids, -sizes)).tolist():
        size = int(sizes[k])
        fits = mask >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            b = rooms[room].pop()
            if not rooms[room]:
                mask ^= 1 << room
        else:
            room, b = capacity, len(names)
            names.append(ids[k])
            loads.append(0)
        where[k], offset[k] = b, loads[b]
        loads[b] += size
        if room > size:
            rooms[room - size].append(b)
            mask |= 1 << (room - size)
    return np.array(names, np.int64)[where], offset, np.array(loads, np.int64)[where]


def _round(items: DataFrame, tasks: int, capacity: int, per_task: int, number: int) -> DataFrame:
    """``items`` (uid, length, ...) with bin, offset and load, packed within each of ``tasks`` tasks.

    ``number`` of the round: each deals the items differently.
    """
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def packed(held: list[pd.DataFrame]) -> pd.DataFrame:
            all_ = pd.concat(held, ignore_index=True)
            bins, offset, load = best_fit(all_["uid"].to_numpy(), all_["length"].to_numpy(), capacity)
            return all_.assign(bin=bins, offset=offset, load=load)

        held, n = [], 0
        for frame in frames:
            while len(frame):
                held.append(frame.iloc[:per_task - n])
                n, frame = n + len(held[-1]), frame.iloc[per_task - n:]
                if n == per_task:
                    yield packed(held)
                    held, n = [], 0
        if held:
            yield packed(held)

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in items.schema.fields)
    return items.repartition(tasks, F.xxhash64("uid", F.lit(number))).mapInPandas(run, f"{fields}, bin long, offset long, load long")


def pack(found: DataFrame, capacity: int = CAPACITY, per_task: int = PER_TASK,
         nearly_full: float = NEARLY_FULL) -> DataFrame:
    """``found`` (uid, length, ...; lengths from 1 to ``capacity``) with sequence_id and offset.

    ``uid`` must be unique and fixed (a written table).  A sequence is named by its
    first item's uid.  An empty table gives no rows.
    """
    enough = capacity - int(capacity * nearly_full)
    whole = found.filter(F.col("length") == capacity).withColumns({"bin": F.col("uid"), "offset": F.lit(0).cast("long")})
    items = found.filter(F.col("length") < capacity)
    n_items = items.count()
    placed, levels = None, []
    while n_items:
        level = stage(_round(items, -(-n_items // per_task), capacity, per_task, len(levels) + (placed is not None)))
        if placed is None:
            placed = level.drop("load")
        else:
            levels.append(level.select(F.col("uid").alias("bin"), F.col("bin").alias("up"), F.col("offset").alias("more")))
        if n_items <= per_task:
            break
        items = level.filter((F.col("offset") == 0) & (F.col("load") < enough)).select(
            F.col("bin").alias("uid"), F.col("load").alias("length"))
        before, n_items = n_items, items.count()
        # Where hardly anything merges, more rounds over as many items would not help either.
        if n_items > before * HARDLY_MERGED:
            break
    if placed is None:
        placed = whole.limit(0)
    placed = reduce(_lifted, levels, placed)
    return placed.unionByName(whole).withColumnRenamed("bin", "sequence_id")


def _lifted(placed: DataFrame, level: DataFrame) -> DataFrame:
    return (placed.join(level, "bin", "left")
            .withColumns({"bin": F.coalesce("up", "bin"), "offset": F.col("offset") + F.coalesce("more", F.lit(0))})
            .drop("up", "more"))


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None, end_id: int = END_ID,
                   per_task: int = PER_TASK) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of every document."""
    out = pack(stage(pieces(docs, capacity, vocabulary, end_id)), capacity, per_task)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def query(spark, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
