"""First-fit decreasing packing over a tournament tree of bin rooms, in random groups.

Whole capacities are cut off long documents where they are tokenised and are sequences
of their own.  What is left of each document, its tail, is dealt by a hash to a group of
a set mean size, so groups grow in number and not in size, whatever the documents are.
A group is packed by first fit in decreasing order: the leaves of a tournament tree are
the rooms of its bins, every inner node holds the larger of its two, and the first bin
with enough room is found by one descent.  Then the emptiest bins are dissolved into the
rooms that are left, cutting tails where needed, so that one bin of a group at most stays
underfull.  Its tokens become sequences whose lengths are powers of two, which need no
padding.
"""

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from tidewarden.llm.packing import VOCABULARY, Encoder
from tidewarden.sources.stage import stage

END_ID, CAPACITY = 1, 2048
#: Mean number of tails in a group.
PER_GROUP = 4096
#: Characters of the texts whose pieces are handed on at once.
_CHARACTERS = 4 << 20

_OUT = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_PIECES = "uid long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary"
_KINDS = {"long": pa.int64(), "binary": pa.binary()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, _KINDS[k]) for c, (_, k) in zip(columns, fields)],
                                      names=[n for n, _ in fields])


def pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None, end_id: int = END_ID,
           id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Whole capacities and the tail of every row's ids; only tails carry their ``ids``.

    A null text is an empty one: its only id is the end.  Repeated rows give repeated
    pieces, each with a ``uid`` of its own; a null id stays null.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        encoder = Encoder(vocabulary or public_tokenizers.path(VOCABULARY))
        uid, rows, size = TaskContext.get().partitionId() << 40, [], 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py() or ""
                ids = np.append(encoder.ids(text), end_id).astype("<u4")
                for start in range(0, len(ids), capacity):
                    part = ids[start:start + capacity]
                    tail = part.tobytes() if len(part) < capacity else None
                    rows.append((uid, doc, start, len(part), zlib.crc32(part), len(ids), tail and _narrow(part)))
                    uid += 1
                size += len(text) + 100
                if size > _CHARACTERS:
                    yield _batch(rows, _PIECES)
                    rows, size = [], 0
        if rows:
            yield _batch(rows, _PIECES)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, _PIECES)


def _narrow(ids: np.ndarray) -> bytes:
    """Ids in two bytes each where all fit, else in four; the last byte tells which."""
    return ids.astype("<u2").tobytes() + b"\2" if int(ids.max()) < 1 << 16 else ids.tobytes() + b"\4"


def _wide(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[-1]}", (len(data) - 1) // data[-1]).astype("<u4")


class Tournament:
    """Rooms of bins in order of opening; the first bin with enough room is found from the root."""

    def __init__(self, most: int, capacity: int):
        self.leaves = 1 << max(most - 1, 0).bit_length()
        self.capacity, self.opened = capacity, 0
        self.tree = [0] * (2 * self.leaves)

    def _set(self, leaf: int, room: int) -> None:
        tree, at = self.tree, leaf + self.leaves
        tree[at] = room
        at >>= 1
        while at:
            larger = max(tree[2 * at], tree[2 * at + 1])
            if tree[at] == larger:
                return
            tree[at] = larger
            at >>= 1

    def place(self, size: int) -> tuple[int, int]:
        """(bin, offset there) for an item, which takes its room; a bin is opened if none has enough."""
        if self.tree[1] < size:
            bin_, room = self.opened, self.capacity
            self.opened += 1
        else:
            at = 1
            while at < self.leaves:
                at *= 2
                at += self.tree[at] < size
            bin_, room = at - self.leaves, self.tree[at]
        self._set(bin_, room - size)
        return bin_, self.capacity - room


def first_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins of item numbers by first fit in decreasing order; equal sizes in their given order."""
    tree = Tournament(len(sizes), capacity)
    bins: list[list[int]] = []
    for k in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        bin_, _ = tree.place(sizes[k])
        if bin_ == len(bins):
            bins.append([])
        bins[bin_].append(k)
    return bins


def dissolved(bins: list[list[int]], sizes: list[int], capacity: int) -> list[list[tuple[int, int, int]]]:
    """Bins of (item, from, to): all full but one at most, the emptiest poured into the rooms of the others.

    Only items of dissolved bins are cut, and each room takes one cut at most.
    """
    load = [sum(sizes[k] for k in b) for b in bins]
    out = [[(k, 0, sizes[k]) for k in b] for b in bins]
    open_ = sorted((b for b in range(len(bins)) if load[b] < capacity), key=lambda b: (-load[b], b))
    low, high = 0, len(open_) - 1
    while low < high:
        donor, taker = out[open_[high]], open_[low]
        if not donor:
            high -= 1
            continue
        item, start, end = donor.pop()
        n = min(end - start, capacity - load[taker])
        out[taker].append((item, start, start + n))
        load[taker] += n
        if start + n < end:
            donor.append((item, start + n, end))
        load[open_[high]] -= n
        low += load[taker] == capacity
    return [b for b in out if b]


def in_powers(parts: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """A bin's parts as bins whose lengths are the powers of two that its length is the sum of."""
    left, out = [*reversed(parts)], []
    length = sum(end - start for _, start, end in parts)
    for power in reversed(range(length.bit_length())):
        if not length >> power & 1:
            continue
        room, now = 1 << power, []
        while room:
            item, start, end = left.pop()
            n = min(room, end - start)
            now.append((item, start, start + n))
            if start + n < end:
                left.append((item, start + n, end))
            room -= n
        out.append(now)
    return out


def _packed_group(capacity: int):
    def run(table: pa.Table) -> pa.Table:
        group = table.column("grp")[0].as_py()
        uid = np.array(table.column("uid"))
        table = table.take(pa.array(np.argsort(uid)))
        doc, at, size, crc, tokens, ids = (table.column(c).to_pylist() for c in (
            "doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"))
        rows, sequence = [], group << 24
        for parts in dissolved(first_fit(size, capacity), size, capacity):
            full = sum(e - s for _, s, e in parts) == capacity
            for one in [parts] if full else in_powers(parts):
                offset = 0
                for k, start, end in one:
                    whole = end - start == size[k]
                    check = crc[k] if whole else zlib.crc32(_wide(ids[k])[start:end])
                    rows.append((doc[k], at[k] + start, end - start, check, tokens[k], sequence, offset))
                    offset += end - start
                sequence += 1
        return pa.Table.from_batches([_batch(rows, _OUT)])

    return run


def pack(found: DataFrame, capacity: int = CAPACITY, per_group: int = PER_GROUP, seed: int = 13) -> DataFrame:
    """``found`` (see :func:`pieces`; a written table) with sequence_id and offset; tails may be cut further.

    Sequences of whole capacities have negative numbers.  An empty table gives no rows.
    """
    whole = found.filter(F.col("length") == capacity).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", (-1 - F.col("uid")).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"))
    tails = found.filter(F.col("length") < capacity)
    groups = max(1, -(-tails.count() // per_group))
    dealt = tails.withColumn("grp", F.pmod(F.xxhash64("uid", F.lit(seed)), F.lit(groups)))
    return dealt.groupBy("grp").applyInArrow(_packed_group(capacity), _OUT).unionByName(whole)


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None, end_id: int = END_ID,
                   per_group: int = PER_GROUP) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset for every piece of every document.

    Nulls, repeated rows and other columns: see :func:`pieces`.  No sequence is padded:
    each has ``capacity`` tokens or a power of two.
    """
    return pack(stage(pieces(docs, capacity, vocabulary, end_id)), capacity, per_group)


def query(spark, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
