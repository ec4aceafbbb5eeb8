"""Media columns (operator 4): content-addressed payloads in tar shards.

A payload is stored as an 8-bit grey PNG of 64 samples a row, under the SHA-256 of its samples and its length, in a tar shard that its
task writes. A row carries digest, shard, offset and length; metadata come from a range read of the first bytes alone,
and features from a range read of the stored bytes.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import zlib
from collections.abc import Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm.arrays import utf8
from sievework.llm.shared import filesystem, shared_dir, written

WIDTH = 64
SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: An ancillary, private chunk with the number of bytes before padding; it follows IHDR.
LENGTH_CHUNK = b"tbYt"
#: Bytes that a header-only read takes: signature, IHDR, and the length chunk.
HEADER_BYTES = 8 + 25 + 20
SHARD_BYTES = 256 << 20


def payload_of(text: bytes) -> bytes:
    """The text and bytes 0 up to a positive multiple of 64."""
    return text + bytes(max(-(-len(text) // WIDTH) * WIDTH, WIDTH) - len(text))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(payload: bytes, n_bytes: int) -> bytes:
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)  # each row begins with filter type 0
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(LENGTH_CHUNK, struct.pack(">Q", n_bytes)) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 1)) + _chunk(b"IEND", b"")


def png_header(data: bytes) -> tuple[int, int, int, int]:
    """Width, height, bit depth and unpadded bytes, from the first HEADER_BYTES."""
    if data[:8] != SIGNATURE or data[12:16] != b"IHDR" or data[37:41] != LENGTH_CHUNK:
        raise ValueError("not a stored payload")
    width, height, depth = struct.unpack(">IIB", data[16:25])
    return width, height, depth, struct.unpack(">Q", data[41:49])[0]


def from_png(data: bytes) -> bytes:
    """The samples; every chunk's checksum is verified."""
    width = png_header(data)[0]
    at, packed = 8, []
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        if zlib.crc32(kind + body) != struct.unpack(">I", data[at + 8 + size : at + 12 + size])[0]:
            raise ValueError("damaged chunk")
        if kind == b"IDAT":
            packed.append(body)
        at += 12 + size
    return np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(-1, width + 1)[:, 1:].tobytes()


def feature_of(payload: bytes) -> str:
    """A 64-bit average hash over 64 equal parts, then minimum, maximum and sum of the samples; integers only."""
    sums = np.frombuffer(payload, np.uint8).reshape(64, -1).sum(1, dtype=np.int64)
    bits = sums * 64 > sums.sum()
    samples = np.frombuffer(payload, np.uint8)
    return f"{int(''.join('1' if b else '0' for b in bits), 2):016x}:{samples.min()}:{samples.max()}:{sums.sum()}"


def store(docs: DataFrame, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stores every whole text (null: empty) and returns its index: the id column, digest, shard, offset, length.

    Each task writes shards of its own, of about 256 MB, and stores a payload once a shard set: equal texts of one task
    share offset and length. A task that runs again writes new files, to which alone the index refers. The index is
    written to the shared folder as Parquet. Repeated rows have a row each; an empty table has an empty index; other columns
    are not read; a payload of any length is held whole while it is written.
    """
    spark = docs.sparkSession
    folder = folder or shared_dir(spark, "media")
    key = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = filesystem(folder)
        fs.create_dir(path, recursive=True)
        known: dict[bytes, tuple[str, int, int]] = {}
        out, name, at = None, "", 0
        for batch in batches:
            rows = []
            for text in utf8(batch.column(1)):
                payload = payload_of(text)
                digest = hashlib.sha256(payload + struct.pack(">Q", len(text))).digest()
                if digest not in known:
                    if out is None or at > SHARD_BYTES:
                        if out:
                            out.write(bytes(1024))
                            out.close()
                        name, at = f"{uuid4().hex}.tar", 0
                        out = fs.open_output_stream(f"{path}/{name}", compression=None)
                    png = to_png(payload, len(text))
                    info = tarfile.TarInfo(f"{digest.hex()}.png")
                    info.size = len(png)
                    head = info.tobuf(tarfile.PAX_FORMAT)
                    out.write(head)
                    out.write(png)
                    out.write(bytes(-len(png) % 512))
                    known[digest] = name, at + len(head), len(png)
                    at += len(head) + len(png) + -len(png) % 512
                rows.append((digest.hex(), *known[digest]))
            digests, shards, offsets, lengths = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.string()), pa.array(shards, pa.string()), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64())], names=[id_col, "digest", "shard", "offset", "length"])
        if out:
            out.write(bytes(1024))
            out.close()

    index = docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string")).mapInArrow(run, f"`{id_col}` {key}, digest string, shard string, offset bigint, length bigint")
    return written(index.withColumn("shard", F.concat(F.lit(folder + "/"), "shard")), "media-index")


def _ranges(index: DataFrame, columns: str, fill) -> DataFrame:
    """Adds columns that ``fill(read)`` makes from a range reader, once for each stored payload and task."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in index.schema) + ", " + columns
    names = [c.split()[0] for c in columns.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string() if c.endswith("string") else pa.int64() for c in columns.split(", ")]
        known: dict[tuple[str, int], tuple] = {}
        shard, file = "", None
        for batch in batches:
            rows = []
            for where, offset, length in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("shard", "offset", "length")), strict=True):
                if (where, offset) not in known:
                    if where != shard:
                        fs, path = filesystem(where)
                        shard, file = where, fs.open_input_file(path)
                    known[where, offset] = fill(lambda n, o=offset, m=length: file.read_at(min(n, m), o), length)
                rows.append(known[where, offset])
            added = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*batch.schema.names, *names])

    return index.mapInArrow(run, schema)


def with_metadata(index: DataFrame) -> DataFrame:
    """Adds width, height, bit_depth and n_bytes, from header-only range reads."""
    return _ranges(index, "width bigint, height bigint, bit_depth bigint, n_bytes bigint", lambda read, length: png_header(read(HEADER_BYTES)))


def with_features(index: DataFrame) -> DataFrame:
    """Reads the stored bytes back; adds payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature."""

    def fill(read, length: int) -> tuple:
        media = read(length)
        payload = from_png(media)
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature_of(payload)

    return _ranges(index, "payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string", fill)
