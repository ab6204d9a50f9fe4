"""WARC archives as a Spark data source.

Reading plans partitions of balanced size: small files together, and large gzip
files in byte ranges, as each record is a gzip member of its own (a file that is
one single member is read whole by the first range).  It takes predicates on the
record type and on header fields, parses a record's headers first and decodes
payloads only of the records that pass, and only if payloads are wanted
(``option("payload", "false")``).  Writing makes gzip files of one member per
record; tasks write under names of their own and the commit moves the finished
files into place, so a lost task leaves nothing behind.

Records with equal payloads are written once: the others become revisits that
refer to the response with the smallest page id.

Defined cases: null payloads are empty; null and odd URLs are escaped or left
out; rows of one page id whose payload is the first of its kind are all
responses; an empty table makes an empty archive; other columns are ignored;
payloads of any length are kept whole.  Files that aren't WARC raise an error.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
import zlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, StringStartsWith, WriterCommitMessage

from .common import forget_later, hot_keys, salted_join, scratch, shared_dir, staged, table

SCHEMA = "record_type string, record_id string, target_uri string, date string, payload_digest string, payload_bytes bigint, page_id string, refers_to string, payload binary"
#: Columns that come from a record's own headers, before its content.
HEADERS = {"record_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "date": "warc-date", "payload_digest": "warc-payload-digest", "page_id": "x-page-id", "refers_to": "x-refers-to-page-id"}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PARTITION_BYTES = 64 << 20
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20
_SPACE = uuid.UUID("6f0f6c5e-52f5-4b0b-9d0e-6a7c1b1c0b5a")


def record_id(page_id: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, page_id)}>"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _escaped(value: str) -> str:
    return "".join(c if " " <= c != "\x7f" else f"%{ord(c):02X}" for c in value)


def record(page_id: str | None, url: str | None, payload: bytes, first_id: str | None, date: str, sha1: str | None = None) -> bytes:
    """A response record, or a revisit of the page ``first_id``."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if first_id is not None else http + payload
    head = {"WARC-Type": "response" if first_id is None else "revisit", "WARC-Record-ID": record_id(page_id) if page_id is not None else f"<urn:uuid:{uuid.uuid5(_SPACE, digest(block))}>", "WARC-Date": date}
    if url is not None:
        head["WARC-Target-URI"] = _escaped(url)
    if page_id is not None:
        head["X-Page-Id"] = _escaped(page_id)
    if first_id is not None:
        head |= {"WARC-Refers-To": record_id(first_id), "WARC-Profile": PROFILE, "X-Refers-To-Page-Id": _escaped(first_id)}
    head |= {"WARC-Payload-Digest": f"sha1:{sha1 or digest(payload)}", "Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block))}
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


def _filesystem(path: str):
    from pyarrow import fs

    return (fs.LocalFileSystem(), path) if path.startswith("/") else fs.FileSystem.from_uri(path)


def _headers(stream) -> dict[str, str]:
    """Header fields up to the empty line, names in lower case."""
    out: dict[str, str] = {}
    last = None
    while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
        text = line.decode("utf-8", "replace").rstrip("\r\n")
        if text[:1] in " \t" and last:
            out[last] += " " + text.strip()
        else:
            last, _, value = text.partition(":")
            last = last.strip().lower()
            out[last] = value.strip()
    return out


def records(stream, wanted, payload: bool):
    """Rows of the records whose headers ``wanted`` accepts; the content of the others is skipped."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record begins with {line[:40]!r}")
        head = _headers(stream)
        size = int(head.get("content-length", 0))
        row = {c: head.get(h) for c, h in HEADERS.items()}
        if row["payload_digest"]:
            row["payload_digest"] = row["payload_digest"].removeprefix("sha1:")
        if not wanted(row):
            _skip(stream, size)
            continue
        row["payload_bytes"], row["payload"] = size, None
        if head.get("content-type", "").startswith("application/http"):
            counted = _Counted(stream)
            counted.readline()
            http = _headers(counted)
            size -= counted.n
            row["payload_bytes"] = int(http.get("content-length", size))
        if payload and row["record_type"] != "revisit":
            row["payload"] = stream.read(size)
        else:
            _skip(stream, size)
        yield row


class _Counted:
    def __init__(self, stream):
        self.stream, self.n = stream, 0

    def readline(self) -> bytes:
        line = self.stream.readline()
        self.n += len(line)
        return line


def _skip(stream, n: int) -> None:
    while n > 0 and (got := len(stream.read(min(n, 1 << 20)))):
        n -= got


@dataclass
class Files(InputPartition):
    """(path, begin, end): the records of gzip members that begin in the range; end 0: the whole file."""

    ranges: list[tuple[str, int, int]]


class _Members(io.RawIOBase):
    """The text of the gzip members that begin at ``begin`` or later and before ``end``."""

    MAGIC = b"\x1f\x8b\x08"

    def __init__(self, raw, begin: int, end: int):
        self.raw, self.end, self.at = raw, end, begin
        self.held, self.inflate, self.out = b"", None, b""
        raw.seek(begin)
        if begin:
            self._find()

    def readable(self):
        return True

    def _more(self) -> bool:
        got = self.raw.read(1 << 16)
        self.held += got
        return bool(got)

    def _drop(self, n: int) -> None:
        self.held, self.at = self.held[n:], self.at + n

    def _find(self) -> None:
        """Go to the first place that inflates to the beginning of a record."""
        while True:
            k = self.held.find(self.MAGIC)
            if k < 0:
                self._drop(max(0, len(self.held) - 2))
                if self.at >= self.end or not self._more():
                    self._drop(len(self.held))
                    return
                continue
            self._drop(k)
            if self.at >= self.end:
                return
            while len(self.held) < 1 << 12 and self._more():
                pass
            try:
                if zlib.decompressobj(31).decompress(self.held[: 1 << 12], 5) == b"WARC/":
                    return
            except zlib.error:
                pass
            self._drop(1)

    def readinto(self, into) -> int:
        while not self.out:
            if self.inflate is None:
                if self.at >= self.end or not self.held and not self._more():
                    return 0
                self.inflate = zlib.decompressobj(31)
            if not self.held and not self._more():
                raise EOFError("the archive ends inside a gzip member")
            given = self.held
            self.out = self.inflate.decompress(given, 1 << 20)
            self.held = self.inflate.unused_data if self.inflate.eof else self.inflate.unconsumed_tail
            self.at += len(given) - len(self.held)
            if self.inflate.eof:
                self.inflate = None
        n = min(len(into), len(self.out))
        into[:n], self.out = self.out[:n], self.out[n:]
        return n


@dataclass
class Written(WriterCommitMessage):
    name: str | None


class WarcReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.payload = options.get("payload", "true").lower() == "true"
        self.size = int(options.get("partitionbytes", PARTITION_BYTES))
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters):  # noqa: N802
        """Predicates on header columns are applied before the content is read; the rest goes back to Spark."""
        for f in filters:
            column = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
            if column in HEADERS and isinstance(f, (EqualTo, In, StringStartsWith)):
                self.tests.append((type(f).__name__, column, tuple(f.value) if isinstance(f, In) else f.value))
            else:
                yield f

    def partitions(self):
        from pyarrow import fs

        system, base = _filesystem(self.path)
        files = [(x.size, x.path) for x in system.get_file_info(fs.FileSelector(base, allow_not_found=True)) if x.is_file and x.base_name.endswith((".warc", ".warc.gz"))]
        pieces: list[tuple[int, tuple[str, int, int]]] = []
        for x in sorted(files, reverse=True):
            if x[1].endswith(".gz") and x[0] > self.size:
                step = -(-x[0] // -(-x[0] // self.size))
                pieces += [(min(step, x[0] - at), (x[1], at, min(at + step, x[0]))) for at in range(0, x[0], step)]
            else:
                pieces.append((x[0], (x[1], 0, 0)))
        parts: list[list] = []
        for size, piece in pieces:  # largest first, into the first partition with room
            near = next((p for p in parts[-64:] if p[0] + size <= self.size), None)
            if near is None:
                parts.append(near := [0, []])
            near[0] += size
            near[1].append(piece)
        return [Files(p) for _, p in parts] or [Files([])]

    def _wanted(self, row) -> bool:
        for kind, column, value in self.tests:
            v = row[column]
            if v is None or (kind == "EqualTo" and v != value) or (kind == "In" and v not in value) or (kind == "StringStartsWith" and not v.startswith(value)):
                return False
        return True

    def read(self, partition):
        system, _ = _filesystem(self.path)
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        kinds = {"payload_bytes": pa.int64(), "payload": pa.binary()}
        rows, size = [], 0

        def batch():
            return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kinds.get(c, pa.string())) for c in names], names)

        for path, begin, end in partition.ranges:
            with system.open_input_file(path) as raw:
                stream = io.BufferedReader(_Members(raw, begin, end or raw.size()), 1 << 16) if path.endswith(".gz") else io.BufferedReader(raw)
                for row in records(stream, self._wanted, self.payload):
                    rows.append(row)
                    size += len(row["payload"] or b"")
                    if len(rows) >= BATCH_ROWS or size >= BATCH_BYTES:
                        yield batch()
                        rows, size = [], 0
        if rows:
            yield batch()


class WarcWriter(DataSourceArrowWriter):
    """Rows of page_id, url, payload, first_id (null for responses) as records."""

    def __init__(self, options):
        self.path = options["path"]
        self.date = options.get("date", "1970-01-01T00:00:00Z")
        self.level = int(options.get("compresslevel", 1))

    def write(self, iterator):
        system, base = _filesystem(self.path)
        name, out = f"{uuid.uuid4().hex}.warc.gz", None
        for batch in iterator:
            cols = [batch.column(batch.schema.get_field_index(c)) for c in ("page_id", "url", "payload", "first_id")]
            for page_id, url, payload, first_id in zip(*(c.to_pylist() for c in cols), strict=True):
                if out is None:
                    system.create_dir(f"{base}/_writing", recursive=True)
                    out = system.open_output_stream(f"{base}/_writing/{name}", compression=None)
                out.write(gzip.compress(record(page_id, url, payload or b"", first_id, self.date), self.level, mtime=0))
        if out is not None:
            out.close()
        return Written(name if out is not None else None)

    def commit(self, messages):
        system, base = _filesystem(self.path)
        system.create_dir(base, recursive=True)
        for m in messages:
            if m is not None and m.name:
                system.move(f"{base}/_writing/{m.name}", f"{base}/{m.name}")
        self.abort([])

    def abort(self, messages):
        from pyarrow import fs

        system, base = _filesystem(self.path)
        if system.get_file_info(f"{base}/_writing").type != fs.FileType.NotFound:
            system.delete_dir(f"{base}/_writing")


class WarcSource(DataSource):
    """``format("warc")``."""

    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(self.options)

    def writer(self, schema, overwrite):
        return WarcWriter(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0) -> None:
    """Write a record for each row; payloads of ``least_bytes`` or more are written once."""
    register(pages.sparkSession)
    payload = F.coalesce(F.col(html_col).cast("string").cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"), F.sha1(payload).alias("same"))
    first = rows.filter(F.octet_length("payload") >= least_bytes).groupBy("same").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).filter("n > 1")
    first = staged(first, "warc-first", keep=True)  # digests and ids only
    # a page without an equal one meets nothing; rows of a frequent payload are dealt over salts
    linked = salted_join(rows, first.select("same", "first_id"), ["same"], hot_keys(first, ["same"]), F.xxhash64("page_id", "url"), "left")
    first_id = F.when(F.col("page_id") != F.col("first_id"), F.col("first_id")).cast("string")
    out = linked.select(F.col("page_id").cast("string").alias("page_id"), "url", "payload", first_id.alias("first_id"))
    out.write.format("warc").mode("append").save(path)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    forget_later(path)  # the result reads it
    with scratch(spark, everything=True):
        archive(pages, path)
    back = read(spark, path, payload=False).filter(F.col("record_type").isin("response", "revisit"))
    kind = pages.schema["page_id"].dataType
    return back.select(F.col("page_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))


#: Base32 by groups of 20 bits of the hexadecimal digest.
OP5_SQL = r"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY hex) AS first_id,
  array_to_string(list_transform(range(8), lambda k: list_reduce(list_transform(range(4), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(hex, (5 * k + 1)::INT, 5))::BIGINT >> (15 - 5 * j)::INT) & 31)::INT + 1, 1)), lambda a, b: a || b)), '') AS payload_digest FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id <> first_id THEN first_id END AS refers_to FROM f
"""
