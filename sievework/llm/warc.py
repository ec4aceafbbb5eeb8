"""WARC as a PySpark Python data source (operator 9).

Reading plans one partition for each file, takes predicates on record type and headers, parses a record's headers
first, and inflates a payload only if its record passes. Every record is a gzip member of its own whose header says
the member's compressed length (extra field ``sl``), so a record that fails is skipped without inflating it.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from uuid import uuid4

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, StringStartsWith, WriterCommitMessage

from sievework.llm.shared import filesystem, shared_dir

SCHEMA = "record_id string, record_type string, target_uri string, refers_to string, payload_digest string, payload_bytes bigint, headers map<string,string>, payload binary"
#: Named header of each column that predicates can be pushed down on.
HEADERS = {"record_id": "WARC-Record-ID", "record_type": "WARC-Type", "target_uri": "WARC-Target-URI", "refers_to": "WARC-Refers-To", "payload_digest": "WARC-Payload-Digest"}
LENGTH = "X-Payload-Length"
MANIFEST = "_manifest.json"
FILE_BYTES = 128 << 20
WINDOW = 1 << 20


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One record, before compression. Line ends in header values become spaces."""
    lines = [f"{k}: {re.sub(r'[\r\n]+', ' ', v)}" for k, v in [*headers, ("Content-Length", str(len(block)))]]
    return "\r\n".join(["WARC/1.1", *lines, "", ""]).encode() + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """A gzip member with its own length and that of its contents in the extra field ``sl``."""
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    size = 10 + 2 + 12 + len(body) + 8
    extra = b"sl" + struct.pack("<HII", 8, size & 0xFFFFFFFF, len(data) & 0xFFFFFFFF)
    return b"\x1f\x8b\x08\x04" + bytes(4) + b"\x00\xff" + struct.pack("<H", 12) + extra + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


@dataclass
class Files(WriterCommitMessage):
    names: list


class WarcWriter(DataSourceArrowWriter):
    """Writes rows of record_id, record_type, target_uri, refers_to, payload.

    A task that runs again writes new files; the manifest, written at the end, names those that count.
    """

    def __init__(self, folder: str, date: str):
        self.folder, self.date = folder, date

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        fs, path = filesystem(self.folder)
        fs.create_dir(path, recursive=True)
        names, out, at = [], None, 0
        for batch in iterator:
            for part in (batch.slice(i, 200) for i in range(0, batch.num_rows, 200)):
                for row in part.to_pylist():
                    if out is None or at > FILE_BYTES:
                        if out:
                            out.close()
                        names.append(f"{uuid4().hex}.warc.gz")
                        out, at = fs.open_output_stream(f"{path}/{names[-1]}", compression=None), 0
                    data = member(self.record(**{k: row[k] for k in ("record_id", "record_type", "target_uri", "refers_to", "payload")}))
                    out.write(data)
                    at += len(data)
        if out:
            out.close()
        return Files(names)

    def record(self, record_id: str, record_type: str, target_uri: str | None, refers_to: str | None, payload: bytes | None) -> bytes:
        payload = payload or b""
        headers = [("WARC-Type", record_type), ("WARC-Record-ID", record_id), ("WARC-Date", self.date), ("Content-Type", "application/http;msgtype=response")]
        headers += [("WARC-Target-URI", target_uri)] * (target_uri is not None)
        headers += [("WARC-Payload-Digest", f"sha1:{sha1_base32(payload)}"), (LENGTH, str(len(payload)))]
        http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
        if record_type == "revisit":
            headers += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", refers_to or "")]
            return record(headers, http)
        return record(headers, http + payload)

    def commit(self, messages: list) -> None:
        fs, path = filesystem(self.folder)
        fs.create_dir(path, recursive=True)
        with fs.open_output_stream(f"{path}/{MANIFEST}", compression=None) as out:
            out.write(json.dumps(sorted(n for m in messages if m for n in m.names)).encode())

    def abort(self, messages: list) -> None:
        fs, path = filesystem(self.folder)
        for name in (n for m in messages if m for n in m.names):
            fs.delete_file(f"{path}/{name}")


class WarcFile(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)


class Wanted:
    """Predicates on headers."""

    def __init__(self):
        self.tests: list[tuple[str, str, object]] = []

    def take(self, f: Filter) -> bool:
        column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
        if column not in HEADERS:
            return False
        kind = {EqualTo: "equal", In: "in", StringStartsWith: "starts"}.get(type(f))
        if not kind:
            return False
        self.tests.append((HEADERS[column], kind, tuple(f.value) if kind == "in" else f.value))
        return True

    def __call__(self, headers: dict[str, str]) -> bool:
        for name, kind, value in self.tests:
            has = headers.get(name.lower())
            if has is None or not (has == value if kind == "equal" else has in value if kind == "in" else has.startswith(value)):
                return False
        return True


def parse_headers(data: bytes) -> dict[str, str]:
    """Header fields by lower-case name; continued lines are joined."""
    lines = re.sub(rb"\r\n[ \t]+", b" ", data).decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:] if x)}


class Records:
    """The records of one file, headers first. ``inflated`` counts bytes of content that were decoded."""

    def __init__(self, path: str, wanted: Wanted, payload: bool):
        self.path, self.wanted, self.payload, self.inflated = path, wanted, payload, 0

    def __iter__(self) -> Iterator[tuple[dict[str, str], bytes | None]]:
        fs, path = filesystem(self.path)
        with fs.open_input_file(path) as file:
            size, at = file.size(), 0
            while at < size:
                head = file.read_at(min(64 << 10, size - at), at)
                at, found = (self.packed if head[:2] == b"\x1f\x8b" else self.plain)(file, size, at, head)
                if found:
                    yield found

    def packed(self, file, size: int, at: int, head: bytes):
        length = None
        if head[3] & 4 and head[12:14] == b"sl" and struct.unpack("<H", head[14:16])[0] == 8:
            length, plain = struct.unpack("<II", head[16:24])
            length = length if plain < 0xFFFFFFFF and length > 24 else None
        inflate = zlib.decompressobj(31)
        data, fed, keep = b"", 0, head
        while b"\r\n\r\n" not in data and not inflate.eof:
            data += inflate.decompress(inflate.unconsumed_tail + keep if not fed else inflate.unconsumed_tail or keep, 4096)
            if not fed:
                fed = len(head)
            keep = b""
            if not inflate.unconsumed_tail and not inflate.eof and b"\r\n\r\n" not in data:
                keep = file.read_at(min(WINDOW, size - at - fed), at + fed)
                fed += len(keep)
                if not keep:
                    break
        self.inflated += len(data)
        top, _, body = data.partition(b"\r\n\r\n")
        headers = parse_headers(top)
        wanted = self.wanted(headers)
        need = wanted and self.payload
        if not need and length:
            return at + length, (headers, None) if wanted else None
        parts = [body] if need else []
        while not inflate.eof:
            more = inflate.unconsumed_tail
            if not more:
                more = file.read_at(min(WINDOW, size - at - fed), at + fed)
                fed += len(more)
                if not more:
                    break
            got = inflate.decompress(more, WINDOW)
            self.inflated += len(got)
            if need:
                parts.append(got)
        block = b"".join(parts)[: int(headers.get("content-length", 0))] if need else None
        return at + fed - len(inflate.unused_data), (headers, block) if wanted else None

    def plain(self, file, size: int, at: int, head: bytes):
        if not head.strip(b"\r\n"):
            return at + len(head), None
        lead = len(head) - len(head.lstrip(b"\r\n"))
        at, head = at + lead, head[lead:]
        while b"\r\n\r\n" not in head and at + len(head) < size:
            head += file.read_at(min(WINDOW, size - at - len(head)), at + len(head))
        top = head.partition(b"\r\n\r\n")[0]
        headers = parse_headers(top)
        begin, length = at + len(top) + 4, int(headers.get("content-length", 0))
        if not self.wanted(headers):
            return begin + length, None
        block = file.read_at(length, begin) if self.payload else None
        self.inflated += length if self.payload else 0
        return begin + length, (headers, block)


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.payload = options["path"], options.get("payload", "true").lower() == "true"
        self.wanted = Wanted()

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            if not self.wanted.take(f):
                yield f

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs as arrow_fs

        fs, path = filesystem(self.path)
        info = fs.get_file_info(path)
        if info.type == arrow_fs.FileType.File:
            return [WarcFile(self.path)]
        names = {x.base_name for x in fs.get_file_info(arrow_fs.FileSelector(path))}
        if MANIFEST in names:
            with fs.open_input_stream(f"{path}/{MANIFEST}") as f:
                names = json.loads(f.read())
        return [WarcFile(f"{self.path}/{n}") for n in sorted(names) if n.endswith((".warc", ".warc.gz"))]

    def read(self, partition: InputPartition):
        schema = pa.schema([*((c, pa.string()) for c in ("record_id", "record_type", "target_uri", "refers_to", "payload_digest")), ("payload_bytes", pa.int64()), ("headers", pa.map_(pa.string(), pa.string())), ("payload", pa.binary())])
        rows, held = [], 0

        def batch():
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)

        for headers, block in Records(partition.value, self.wanted, self.payload) if partition is not None else ():
            payload, length = None, headers.get(LENGTH.lower())
            if block is not None and headers.get("warc-type") != "revisit":
                payload = block.partition(b"\r\n\r\n")[2] if block[:5] == b"HTTP/" else block
                length = len(payload)
            named = [headers.get(HEADERS[c].lower()) for c in ("record_id", "record_type", "target_uri", "refers_to", "payload_digest")]
            rows.append((*named, int(length) if length is not None else None, list(headers.items()), payload))
            held += len(payload or b"")
            if held > 8 << 20 or len(rows) >= 2000:
                yield batch()
                rows, held = [], 0
        if rows:
            yield batch()


class WarcSource(DataSource):
    """``spark.read.format("warc")``: option ``payload`` (default true); ``write``: option ``date``."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"], self.options.get("date", "1970-01-01T00:00:00Z"))


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """Records of a WARC file or folder; filters on record_id, record_type, target_uri, refers_to and payload_digest are pushed down."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def write_pages(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Writes a record for each row: of equal payloads the row with the largest id is the response, the others revisit it.

    A null payload is empty, and empties are equal payloads too. Rows that repeat id and payload are all responses; a
    row with a null id revisits the largest id of its payload, or is a response where there is none. Owners are found
    by a maximum for each digest, which combines before the shuffle; a digest with very many pages is a skewed join
    key, which adaptive execution splits.
    """
    spark = pages.sparkSession
    spark.dataSource.register(WarcSource)
    rows = pages.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{url_col}`").cast("string").alias("target_uri"), F.encode(F.coalesce(F.col(f"`{html_col}`").cast("string"), F.lit("")), "utf-8").alias("payload"))
    rows = rows.withColumn("_digest", F.unhex(F.sha1("payload")))
    owners = rows.groupBy("_digest").agg(F.max("_id").alias("_owner"))
    uri = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))
    own = F.col("_owner").isNull() | F.coalesce(F.col("_id") == F.col("_owner"), F.lit(False))
    rows.join(owners, "_digest").select(
        uri("_id").alias("record_id"),
        F.when(own, "response").otherwise("revisit").alias("record_type"),
        "target_uri",
        F.when(~own, uri("_owner")).alias("refers_to"),
        "payload",
    ).write.format("warc").mode("append").save(path)


def archive_and_read(pages: DataFrame, path: str | None = None, **columns: str) -> DataFrame:
    """Writes the pages, reads the archives back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Ids come back in the type that the pages have, which may be any that a string can be cast to. Null and empty
    payloads, ties and null ids: see ``write_pages``. Other columns of ``pages`` are not read; an empty table gives no rows.
    """
    spark = pages.sparkSession
    kind = pages.schema[columns.get("id_col", "page_id")].dataType.simpleString()
    path = path or shared_dir(spark, "warc")
    write_pages(pages, path, **columns)
    number = lambda c: F.expr(f"try_cast(nullif(regexp_extract({c}, '(?s)^<urn:page:(.*)>$', 1), '') as {kind})")
    back = read_warc(spark, path)
    # a response's length is counted on the payload read; its digest is taken anew from it
    digest = F.regexp_replace("payload_digest", "^sha1:", "")
    return back.select(number("record_id").alias("page_id"), "payload_bytes", digest.alias("payload_digest"), "record_type", number("refers_to").alias("refers_to"), F.when(F.col("payload").isNotNull(), F.sha1("payload")).alias("_sha1")).withColumn(
        "stored_sha1", F.col("_sha1")).drop("_sha1")


def oracle() -> str:
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    return f"""
with p as (select page_id, coalesce(html, '') as payload, sha1(coalesce(html, '')) as hex from pages),
o as (select hex, max(page_id) as owner from p group by hex)
select page_id, strlen(payload)::bigint as payload_bytes,
       array_to_string(list_transform(generate_series(0, 31), lambda i: substr('{alphabet}', 1 + (((('0x' || substr(p.hex, 1 + 5 * (i // 4)::int, 5))::bigint >> (15 - 5 * (i % 4))::int) & 31))::int, 1)), '') as payload_digest,
       case when page_id = owner then 'response' else 'revisit' end as record_type,
       case when page_id <> owner then owner end as refers_to,
       case when page_id = owner then p.hex end as stored_sha1
from p join o on p.hex = o.hex"""
