"""Harmonic packing (operator 6).

A sequence holds ``capacity`` ids. Class k takes pieces whose length is at most capacity // k; a bin of class k is
filled with k of them, however long each is, so bins of a class need no search and no knowledge of other bins. A
document may be cut: a piece that would leave more than a 64th of its share free gives up one full share of the next
class, capacity // (k + 1), and its rest is classified anew. Each worker (partition) packs on its own. What is left in
bins that never filled is laid end to end and cut at the capacity, so a worker pads one such sequence at most.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm import arrays
from sievework.llm.bpe import ByteTokenizer
from sievework.llm.shared import distinct_names

#: A piece stays whole if at most this part of its share stays free.
SLACK = 64


def cuts(length: int, capacity: int) -> list[tuple[int, int]]:
    """(class, length) of each piece of a document, in order."""
    out = []
    while length:
        if length >= capacity:
            k, size = 1, capacity
        else:
            k = capacity // length
            share = capacity // k
            size = length
            if (share - length) * SLACK > share:
                k += 1
                size = capacity // k
        out.append((k, size))
        length -= size
    return out


class Packer:
    """The bins of one worker; add() and close() yield (key, start, ids, doc_tokens, sequence, offset)."""

    def __init__(self, capacity: int, first_sequence: int):
        self.capacity, self.sequence = capacity, first_sequence
        self.open: dict[int, list] = {}

    def full(self, pieces: list) -> Iterator[tuple]:
        offset = 0
        for key, start, ids, total in pieces:
            yield key, start, ids, total, self.sequence, offset
            offset += len(ids) // 4
        self.sequence += 1

    def add(self, key, ids: bytes) -> Iterator[tuple]:
        total, start = len(ids) // 4, 0
        for k, size in cuts(total, self.capacity):
            pieces = self.open.setdefault(k, [])
            pieces.append((key, start, ids[4 * start : 4 * (start + size)], total))
            start += size
            if len(pieces) == k:
                yield from self.full(self.open.pop(k))

    def close(self) -> Iterator[tuple]:
        row, used = [], 0
        for _, pieces in sorted(self.open.items()):
            for key, start, ids, total in pieces:
                while ids:
                    take = min(len(ids) // 4, self.capacity - used)
                    row.append((key, start, ids[: 4 * take], total))
                    start, ids, used = start + take, ids[4 * take :], used + take
                    if used == self.capacity:
                        yield from self.full(row)
                        row, used = [], 0
        if row:
            yield from self.full(row)
        self.open.clear()


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """Packs all documents into sequences of at most ``capacity`` ids.

    A document is the ids of its whole text by the byte-level vocabulary at ``path``, without special tokens added,
    then ``end_id``; a null or empty text is ``end_id`` alone. Returns one row for each piece: the id column, start
    (ids of the document before it), length, ids_crc32 (of the ids as little-endian unsigned 32-bit numbers),
    doc_tokens, sequence_id, offset, and with ``with_ids`` the ids. A document's pieces hold each id once; a sequence's
    pieces lie gapless from offset 0. Repeated rows are packed as often as they occur; other columns are not read; an id
    column named like a result is an error. Texts of any length are cut freely. An
    empty table gives no rows. Sequence ids hold the partition, so partitions need not talk to each other, and a
    partition that runs again gives the same ids.
    """
    key = docs.schema[id_col].dataType.simpleString()
    names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids
    distinct_names(id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids")
    schema = f"`{id_col}` {key}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        tokenizer = ByteTokenizer(path)
        packer = Packer(capacity, TaskContext.get().partitionId() << 36)
        end = end_id.to_bytes(4, "little")
        kind = None

        def table(rows: list[tuple]) -> pa.RecordBatch:
            keys, starts, ids, totals, sequences, offsets = zip(*rows, strict=True)
            whole = lambda x: pa.array(x, pa.int64())
            columns = [pa.array(keys, kind), whole(starts), whole([len(x) // 4 for x in ids]), whole([zlib.crc32(x) for x in ids]), whole(totals), whole(sequences), whole(offsets)]
            if with_ids:
                columns.append(pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in ids], pa.list_(pa.int32())))
            return pa.RecordBatch.from_arrays(columns, names=names)

        rows: list[tuple] = []
        for batch in batches:
            kind = batch.schema.field(0).type
            for k, text in zip(batch.column(0), batch.column(1), strict=True):
                rows.extend(packer.add(k.as_py(), tokenizer.encode(text.as_py() or "") + end))
                if len(rows) >= 5000:
                    yield table(rows)
                    rows = []
        rows.extend(packer.close())
        if rows:
            yield table(rows)
        tokenizer = rows = None  # a worker that waits holds neither the vocabulary nor its finished chunks
        arrays.trim()

    return docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string")).mapInArrow(run, schema)
