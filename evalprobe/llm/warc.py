"""WARC archives: a writer that stores equal payloads once, and a Python data source that reads archives back.

Writing: every record is a gzip member of its own whose header tells the member's length, so a reader can step over
it. A task writes its files under names of its own attempt and reports them; the manifest lists what the tasks that
succeeded reported, so a lost executor leaves nothing behind that a reader would see.

Reading: files are packed into partitions by size. Of each record the header comes first, inflated alone; predicates
on header fields that Spark hands down are tried on it, and the payload of a record that fails is neither inflated
nor read. Archives of other writers (plain, or gzip without lengths) are read as well.
"""

from __future__ import annotations

import base64
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull

from .common import shared_dir, stored

#: Bytes after which a task starts its next file, and bytes of files that make a partition.
FILE_BYTES, PARTITION_BYTES = 256 << 20, 64 << 20
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Columns read from the header: name, header field.
HEADER_COLUMNS = (("record_type", "warc-type"), ("record_id", "warc-record-id"), ("target_uri", "warc-target-uri"), ("date", "warc-date"), ("refers_to", "warc-refers-to"), ("payload_digest", "warc-payload-digest"), ("payload_length", "x-payload-length"))
SCHEMA = ", ".join(f"{n} string" for n, _ in HEADER_COLUMNS) + ", payload binary"


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system and the path in it; ``viewfs`` and the like need Hadoop's client."""
    if re.match(r"[a-z0-9]+:", path):
        path = re.sub(r"^file:/+", "file:///", path)
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path


def _clean(value: str) -> str:
    """A header value on one line; control characters are percent-encoded."""
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def _member(record: bytes) -> bytes:
    """A gzip member with its own and its content's length in an ``sl`` field."""
    deflate = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = deflate.compress(record) + deflate.flush()
    total = 10 + 2 + 12 + len(body) + 8
    head = b"\x1f\x8b\x08\x04" + b"\0" * 4 + b"\0\xff" + struct.pack("<H", 12) + b"sl" + struct.pack("<HII", 8, total & 0xFFFFFFFF, len(record) & 0xFFFFFFFF)
    return head + body + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)


def _record(kind: str, name: str, uri: str | None, digest: str, size: int, refers: str | None, payload: bytes, date: str) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    block = http + (payload if kind == "response" else b"")
    fields = [("WARC-Type", kind), ("WARC-Record-ID", f"<{name}>"), ("WARC-Date", date)]
    if uri is not None:
        fields.append(("WARC-Target-URI", _clean(uri)))
    fields += [("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Payload-Length", str(size))]
    if kind == "revisit":
        fields += [("WARC-Profile", REVISIT), ("WARC-Refers-To", f"<{refers}>")]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode("utf-8", "surrogatepass") + b"\r\n" + block + b"\r\n\r\n"


def write(pages: DataFrame, path: str, least: int = 0, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html", date: str = "2024-01-01T00:00:00Z") -> int:
    """Write a record per row of ``pages`` below ``path`` and return how many; payloads in UTF-8.

    Of records with equal payloads of ``least`` bytes or more the one with the largest id is the response and the
    others revisit it; smaller payloads are all responses. A null payload is empty, a null URI leaves its field out.
    A null id is never the largest unless all ids of the payload are null: those are responses. Rows that share the
    largest id are all responses. An empty table leaves an empty manifest. Other columns are not read.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(uri_col).cast("string").alias("uri"), F.coalesce(F.col(payload_col).cast("string"), F.lit("")).alias("payload"))
    rows = rows.withColumns({"sha": F.sha1(F.col("payload")), "size": F.octet_length("payload").cast("long")})
    twins = stored(rows.filter(F.col("size") >= least).groupBy("sha").agg(F.max("id").alias("top"), F.count("*").alias("n")).filter("n > 1 AND top IS NOT NULL").select("sha", "top"), "warc-twins")
    placed = rows.join(twins, "sha", "left")
    again = F.col("top").isNotNull() & (F.col("size") >= least) & ~F.coalesce(F.col("id") == F.col("top"), F.lit(False))
    placed = placed.select("id", "uri", "sha", "size", F.when(again, F.col("top")).alias("refers"), F.when(again, F.lit(False)).otherwise(F.lit(True)).alias("full"), F.when(~again, F.col("payload")).alias("payload"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held, n, done = None, 0, 0, []
        system, top = _open(path)
        attempt, serial = uuid.uuid4().hex, 0
        system.create_dir(top, recursive=True)

        def close() -> None:
            nonlocal out, held, n
            if out is not None:
                out.close()
                done.append((f"{attempt}-{serial}.warc.gz", n, held))
            out, held, n = None, 0, 0

        for batch in batches:
            for id_, uri, sha, size, refers, full, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    serial += 1
                    out = system.open_output_stream(f"{top}/{attempt}-{serial}.warc.gz", compression=None)
                digest = base64.b32encode(bytes.fromhex(sha)).decode()
                data = _member(_record("response" if full else "revisit", f"urn:page:{'' if id_ is None else id_}", uri, digest, size, None if full else f"urn:page:{refers}", (payload or "").encode("utf-8", "surrogatepass"), date))
                out.write(data)
                held += len(data)
                n += 1
                if held >= FILE_BYTES:
                    close()
        close()
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64()), pa.array([d[2] for d in done], pa.int64())], names=["file", "records", "bytes"])

    told = stored(placed.mapInArrow(run, "file string, records long, bytes long"), "warc-manifest").collect()
    system, top = _open(path)
    system.create_dir(top, recursive=True)
    with system.open_output_stream(f"{top}/MANIFEST") as out:
        out.write(json.dumps([[t["file"], t["bytes"]] for t in told]).encode())
    return sum(t["records"] for t in told)


class _Input:
    """Records of one archive: headers first, the block on demand."""

    def __init__(self, source):
        self.source = source

    def _exactly(self, n: int) -> bytes:
        return self.source.read(n)

    def records(self, wanted) -> Iterator[tuple[dict[str, str], bytes]]:
        while True:
            start = self.source.tell()
            magic = self._exactly(4)
            if len(magic) < 4:
                return
            if magic[:2] == b"\x1f\x8b":
                yield from self._zipped(start, magic, wanted)
            elif magic == b"WARC":
                yield from self._plain(start, wanted)
            elif magic[:1] in b"\r\n":
                self.source.seek(start + 1)
            else:
                raise ValueError(f"no WARC record at byte {start}")

    def _zipped(self, start: int, magic: bytes, wanted) -> Iterator[tuple[dict[str, str], bytes]]:
        head, total = self._exactly(6), None
        if magic[3] & 4:
            size = struct.unpack("<H", self._exactly(2))[0]
            extra = self._exactly(size)
            if extra[:2] == b"sl" and size >= 12:
                total = struct.unpack("<I", extra[4:8])[0]
        del head
        self.source.seek(start)
        inflate = zlib.decompressobj(31)
        text, fed = b"", b""
        while b"\r\n\r\n" not in text and not inflate.eof:
            fed = inflate.unconsumed_tail or self._exactly(4096)
            if not fed:
                break
            text += inflate.decompress(fed, 8192)
        fields, rest = _fields(text)
        if total is not None and not wanted(fields):
            self.source.seek(start + total)
            return
        parts = [rest]
        while not inflate.eof:
            fed = inflate.unconsumed_tail or self._exactly(1 << 16)
            if not fed:
                break
            parts.append(inflate.decompress(fed))
        self.source.seek(start + total if total is not None else self.source.tell() - len(inflate.unused_data))
        if wanted(fields):
            yield fields, b"".join(parts)[: int(fields.get("content-length", 0))]

    def _plain(self, start: int, wanted) -> Iterator[tuple[dict[str, str], bytes]]:
        text = b"WARC"
        while b"\r\n\r\n" not in text:
            more = self._exactly(4096)
            if not more:
                break
            text += more
        fields, rest = _fields(text)
        begin, size = start + len(text) - len(rest), int(fields.get("content-length", 0))
        if wanted(fields):
            self.source.seek(begin)
            yield fields, self._exactly(size)
        self.source.seek(begin + size)


def _fields(text: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = text.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}, rest


class _Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class WarcReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.payload = options["path"], options.get("payload", "true").lower() == "true"
        self.tests: list[tuple[str, tuple]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes equality and membership tests of header columns; the others stay with Spark."""
        fields = dict(HEADER_COLUMNS)
        for f in filters:
            name = f.attribute[0] if isinstance(f, (EqualTo, In, IsNotNull)) and len(f.attribute) == 1 else None
            if name in fields and not isinstance(f, IsNotNull):
                self.tests.append((name, tuple(f.value) if isinstance(f, In) else (f.value,)))
            elif name not in fields:
                yield f
            else:
                self.tests.append((name, ()))

    def partitions(self) -> list[InputPartition]:
        system, top = _open(self.path)
        try:
            with system.open_input_stream(f"{top}/MANIFEST") as found:
                files = [(f"{self.path.rstrip('/')}/{name}", size) for name, size in json.loads(found.read())]
        except FileNotFoundError:
            info = system.get_file_info(top)
            if info.type == pafs.FileType.File:
                files = [(self.path, info.size)]
            else:
                files = [(f"{self.path.rstrip('/')}/{i.base_name}", i.size) for i in system.get_file_info(pafs.FileSelector(top)) if re.search(r"\.warc(\.gz)?$", i.path)]
        groups: list[list[str]] = [[]]
        held = 0
        for name, size in sorted(files, key=lambda x: -x[1]):
            if held and held + size > PARTITION_BYTES:
                groups.append([])
                held = 0
            groups[-1].append(name)
            held += size
        return [_Files(g) for g in groups]

    def _row(self, fields: dict[str, str]) -> tuple:
        strip = lambda v: v[1:-1] if v and v[0] == "<" and v[-1] == ">" else v
        return tuple(strip(fields.get(key)) for _, key in HEADER_COLUMNS)

    def read(self, partition: _Files) -> Iterator[pa.RecordBatch]:
        at = {n: i for i, (n, _) in enumerate(HEADER_COLUMNS)}

        def wanted(fields: dict[str, str]) -> bool:
            row = self._row(fields)
            return all(row[at[n]] in values if values else row[at[n]] is not None for n, values in self.tests)

        names = [n for n, _ in HEADER_COLUMNS] + ["payload"]
        for path in partition.paths:
            system, top = _open(path)
            rows, held = [], 0
            with system.open_input_file(top) as source:
                for fields, block in _Input(source).records(wanted):
                    payload = None
                    if self.payload:
                        payload = block.partition(b"\r\n\r\n")[2] if fields.get("content-type", "").startswith("application/http") else block
                    rows.append((*self._row(fields), payload))
                    held += len(block)
                    if held >= 8 << 20 or len(rows) >= 4000:
                        yield self._batch(rows, names)
                        rows, held = [], 0
            if rows:
                yield self._batch(rows, names)

    @staticmethod
    def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in columns[:-1]), pa.array(columns[-1], pa.binary())], names=names)


class WarcSource(DataSource):
    """``spark.read.format("warc").load(path)``; option ``payload=false`` leaves payloads null."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(dict(self.options))


def read(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """The records of the archives at ``path`` (a file or a folder)."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def round_trip(pages: DataFrame, least: int = 0, **columns: str) -> DataFrame:
    """Write ``pages`` to archives in the shared folder and read them back: the digest of every record.

    Responses come with their payload, whose bytes are counted; of revisits only headers are read.
    """
    spark = pages.sparkSession
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write(pages, path, least, **columns)
    number = lambda c: F.expr(f"try_cast(nullif(substr({c}, 10), '') AS long)")
    digest = F.expr("substr(payload_digest, 6)").alias("payload_digest")
    full = read(spark, path).filter("record_type = 'response'").select(number("record_id").alias("page_id"), F.octet_length("payload").cast("long").alias("payload_bytes"), digest, "record_type", F.lit(None).cast("long").alias("refers_to"))
    again = read(spark, path, payload=False).filter("record_type = 'revisit'").select(number("record_id").alias("page_id"), F.expr("cast(payload_length AS long)").alias("payload_bytes"), digest, "record_type", number("refers_to").alias("refers_to"))
    return full.unionByName(again)
