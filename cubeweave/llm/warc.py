"""WARC archives as a PySpark Python data source: read and write ``warc``.

Every record is a gzip member of its own that carries its lengths in the `sl` extra field which the WARC
standard proposes, so a reader goes from record to record by seeking. The reader plans byte ranges of the files
as partitions, takes over predicates on the record type and on header columns, inflates the headers first and the
payload only where it is wanted. Files are read ahead by megabytes, so small records cost no request each.
Archives of others are read, too: in folders below the path, without lengths, with all records in one member,
or not compressed at all.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, IsNull, StringStartsWith, WriterCommitMessage
from pyspark.sql.types import StructType

from cubeweave.scratch import new_path

SCHEMA = "record_type string, record_id string, target_uri string, date string, payload_digest string, payload_length long, refers_to string, payload binary"
#: What is written: page_id long, url string, payload binary, digest string (hex SHA-1), refers_to long (null: a response).
WRITTEN = ("page_id", "url", "payload", "digest", "refers_to")
HEADERS = {"record_type": "WARC-Type", "record_id": "WARC-Record-ID", "target_uri": "WARC-Target-URI", "date": "WARC-Date", "payload_digest": "WARC-Payload-Digest", "payload_length": "X-Payload-Length", "refers_to": "WARC-Refers-To"}
PUSHED = (EqualTo, In, IsNull, IsNotNull, StringStartsWith)
SPLIT_BYTES = 64 << 20
ENDINGS = (".warc.gz", ".warc", ".gz")
#: Bytes that a request reads ahead; compressed and inflated bytes that are held at once, but for a payload that is asked for.
AHEAD, PIECE = 4 << 20, 1 << 16
URN = "urn:x-page:"
LEVEL = 1


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI (file:/x as Hadoop writes it, too)."""
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[len("file:") :]
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def member(data: bytes) -> bytes:
    """A gzip member with its own and its content's length in the extra field, where they fit 32 bits."""
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, -15)
    body = z.compress(data) + z.flush()
    size = 10 + 2 + 12 + len(body) + 8
    sized = size < 1 << 32 and len(data) < 1 << 32
    head = b"\x1f\x8b\x08" + (b"\x04" if sized else b"\x00") + b"\x00" * 4 + b"\x00\xff"
    extra = struct.pack("<H2sHII", 12, b"sl", 8, size, len(data)) if sized else b""
    return head + extra + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """The bytes of one response or revisit record."""
    clean = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{URN}{'' if page_id is None else page_id}>", f"WARC-Date: {date}"]
    lines += [f"WARC-Target-URI: {clean}"] * (url is not None)
    lines += [f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}", f"X-Payload-Length: {len(payload)}"]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <{URN}{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


@dataclass
class Range(InputPartition):
    path: str
    start: int
    end: int


@dataclass
class Written(WriterCommitMessage):
    path: str | None
    records: int


class WarcSource(DataSource):
    """Options: path; payload (true: give payloads); verify (false; true: inflate and hash every payload, whether it is
    given or not, and fail where digest or length are not those of the header); date of written records; split_bytes."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return WarcReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        if tuple(schema.names) != WRITTEN:
            raise ValueError(f"expected the columns {WRITTEN}")
        return WarcWriter(self.options)


class WarcWriter(DataSourceArrowWriter):
    """A file a task, under a name of its own; only files that the driver has committed to a manifest count."""

    def __init__(self, options: dict) -> None:
        self.path, self.date = options["path"].rstrip("/"), options.get("date", "2024-01-01T00:00:00Z")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, root = filesystem(self.path)
        path, n, out = f"{root}/part-{uuid.uuid4().hex}.warc.gz", 0, None
        for batch in iterator:
            if batch.num_rows and out is None:
                files.create_dir(root, recursive=True)
                out = files.open_output_stream(path, compression=None)
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                out.write(member(record(*row, self.date)))
                n += 1
        if out is not None:
            out.close()
        return Written(path if n else None, n)

    def commit(self, messages: list[Written | None]) -> None:
        files, root = filesystem(self.path)
        files.create_dir(root, recursive=True)
        with files.open_output_stream(f"{root}/_manifest-{uuid.uuid4().hex}.json") as out:
            out.write(json.dumps([[m.path, m.records] for m in messages if m and m.path]).encode())

    def abort(self, messages: list[Written | None]) -> None:
        files, _ = filesystem(self.path)
        for m in messages:
            if m and m.path:
                files.delete_file(m.path)


class WarcReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path = options["path"].rstrip("/")
        self.payload = options.get("payload", "true").lower() == "true"
        self.verify = options.get("verify", "false").lower() == "true"
        self.split = int(options.get("split_bytes", SPLIT_BYTES))
        self.filters: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, PUSHED) and f.attribute[0] in HEADERS:
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> list[Range]:
        files, root = filesystem(self.path)
        found = files.get_file_info(root)
        listed = [found] if found.is_file else files.get_file_info(fs.FileSelector(root, recursive=True))
        kept: dict[str, set[str]] = {}  # by folder; folders without a manifest count whole
        for m in listed:
            if m.base_name.startswith("_manifest-"):
                with files.open_input_stream(m.path) as f:
                    kept.setdefault(m.path.rpartition("/")[0], set()).update(p.rpartition("/")[2] for p, _ in json.loads(f.read()))
        archives = [m for m in listed if m.is_file and m.base_name.endswith(ENDINGS) and m.base_name in kept.get(m.path.rpartition("/")[0], {m.base_name})]
        step = lambda m: max(1, m.size) if m.base_name.endswith(".warc") else self.split  # noqa: E731  nothing tells where a plain record begins
        return [Range(m.path, at, min(at + step(m), m.size)) for m in archives for at in range(0, m.size, step(m))]

    def read(self, partition: Range | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # there are no archives
            return
        files, _ = filesystem(self.path)
        names = [f.split()[0] for f in SCHEMA.split(", ")]
        schema = pa.schema([(n, pa.int64() if n == "payload_length" else pa.binary() if n == "payload" else pa.string()) for n in names])
        rows: list[dict] = []
        held = 0
        with files.open_input_file(partition.path) as raw:
            for row in self._records(io.BufferedReader(raw, AHEAD), raw.size(), partition):
                rows.append(row)
                held += len(row["payload"] or b"") + 300
                if held > 8 << 20:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    def _records(self, f, size: int, part: Range) -> Iterator[dict]:
        zipped = not part.path.endswith(".warc")
        at = part.start if part.start == 0 else _next_member(f, part.start, part.end)
        while at is not None and at < part.end:
            f.seek(at)
            member = Member(f, zipped)
            while member.begins():
                row, length = _row(head := member.headers()), int(head["content-length"])
                if all(_holds(x, row) for x in self.filters):
                    if row["record_type"] != "revisit" and (self.payload or self.verify):
                        self._payload(member, head, row, length)
                    yield row
                if member.size:  # one record, whose end is known
                    break
                member.skip()
            at += member.size or member.read_bytes()
            if at >= size:
                return

    def _payload(self, member: Member, head: dict[str, str], row: dict, length: int) -> None:
        """Inflate the payload; keep it if it is asked for, and hold it against its header if it is to be verified."""
        parts, sha, n = [], hashlib.sha1(), 0
        for piece in member.body(length, http=head.get("content-type", "").startswith("application/http")):
            n += len(piece)
            if self.verify:
                sha.update(piece)
            if self.payload:
                parts.append(piece)
        if self.payload:
            row["payload"] = b"".join(parts)
        if self.verify:
            member.finish()
            ours = base64.b32encode(sha.digest()).decode()
            if row["payload_digest"] not in (None, ours) or row["payload_length"] not in (None, n):
                raise ValueError(f"{row['record_id']}: the payload is not that of its header")
            row["payload_digest"], row["payload_length"] = ours, n


class Member:
    """One gzip member, or a plain file, inflated as far as asked."""

    def __init__(self, f, zipped: bool = True) -> None:
        self.f, self.size, self.start = f, 0, f.tell()
        self.z = zlib.decompressobj(31) if zipped else None
        self.raw = f.read(4096)
        if zipped and len(self.raw) >= 24 and self.raw[3] & 4 and self.raw[12:14] == b"sl":
            self.size = struct.unpack("<I", self.raw[16:20])[0]
        self.data, self.left = b"", 0  # inflated bytes; those of the body that have not been handed out

    def _more(self) -> bool:
        """Inflate a piece; False at the end."""
        if self.z is None:
            data, self.raw = self.raw or self.f.read(PIECE), b""
        else:
            data = b""
            while not data and not self.z.eof:
                raw = self.z.unconsumed_tail or self.raw or self.f.read(PIECE)
                if not raw:
                    raise ValueError("a gzip member that has no end")
                self.raw = b""
                data = self.z.decompress(raw, 16 * PIECE)
        self.data += data
        return bool(data)

    def begins(self) -> bool:
        """Whether another record begins here; goes over the blank lines between records."""
        while True:
            self.data = self.data.lstrip(b"\r\n")
            if self.data or not self._more():
                return bool(self.data)

    def headers(self) -> dict[str, str]:
        lines = self._until_blank("a WARC record without an end of its headers").decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("not a WARC record")
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        self.left = int(head["content-length"])
        return head

    def _until_blank(self, what: str) -> bytes:
        while (i := self.data.find(b"\r\n\r\n")) < 0:
            if not self._more():
                raise ValueError(what)
        got, self.data = self.data[:i], self.data[i + 4 :]
        return got

    def body(self, length: int, *, http: bool) -> Iterator[bytes]:
        """The pieces of the record's payload: its block, for HTTP without the headers."""
        if http and self.left:
            self.left -= len(self._until_blank("an HTTP record without an end of its headers")) + 4
        while self.left and (self.data or self._more()):
            piece, self.data = self.data[: self.left], self.data[self.left :]
            self.left -= len(piece)
            yield piece
        if self.left:
            raise ValueError("a record that is shorter than its header says")

    def skip(self) -> None:
        """Go over what is left of the record."""
        for _ in self.body(self.left, http=False):
            pass

    def finish(self) -> None:
        """Inflate a member of one record to its end, where gzip holds its checksum."""
        while self.size and self._more():
            self.data = b""

    def read_bytes(self) -> int:
        """Bytes of the file up to the end of the member, which has been read."""
        return self.f.tell() - self.start - (len(self.z.unused_data) if self.z else 0)


def _next_member(f, start: int, end: int) -> int | None:
    """The first place from start, before end, at which a member with a WARC record begins."""
    at, step = start, 1 << 20
    while at < end:
        f.seek(at)
        data = f.read(step + 2)
        i = data.find(b"\x1f\x8b\x08")
        while 0 <= i < step and at + i < end:
            f.seek(at + i)
            try:
                if zlib.decompressobj(31).decompress(f.read(4096), 5) == b"WARC/":
                    return at + i
            except zlib.error:
                pass
            i = data.find(b"\x1f\x8b\x08", i + 1)
        at += step
    return None


def _row(head: dict[str, str]) -> dict:
    row: dict = {c: head.get(h.lower()) for c, h in HEADERS.items()}
    for c in ("record_id", "refers_to"):
        row[c] = row[c].strip("<>") if row[c] else row[c]
    row["payload_digest"] = (row["payload_digest"] or "").removeprefix("sha1:") or None
    row["payload_length"] = int(row["payload_length"]) if row["payload_length"] else None
    row["payload"] = None
    return row


def _holds(f: Filter, row: dict) -> bool:
    x = row[f.attribute[0]]
    if isinstance(f, IsNull):
        return x is None
    if x is None:
        return False
    if isinstance(f, EqualTo):
        return x == f.value
    if isinstance(f, In):
        return x in f.value
    return isinstance(f, IsNotNull) or x.startswith(f.value)


def to_warc(pages: DataFrame, path: str, *, least_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Write a record for every row. Of equal payloads of at least least_bytes bytes the one with the smallest id is
    a response and the others revisit it; smaller payloads are all responses.

    Null html is an empty payload. Rows repeated under the smallest id are all responses; null ids revisit, or
    are responses if no other id has their payload. The digests are worked out first, from two narrow columns;
    the html is then shuffled once, to meet the first id of its digest, by a join whose large keys Spark can split.
    """
    payload = F.coalesce(F.encode(F.col(html_col), "UTF-8"), F.lit(b""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"), F.sha1(payload).alias("digest"))
    enough = F.length("payload") >= least_bytes
    first = rows.filter(enough & F.col("page_id").isNotNull()).groupBy(F.col("digest").alias("__d")).agg(F.min("page_id").alias("__first"), F.count("*").alias("__n")).filter("__n > 1").drop("__n")
    joined = rows.join(first, F.when(enough, F.col("digest")) == F.col("__d"), "left")
    refers = F.when(F.col("__first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("__first")), F.col("__first"))
    register(pages.sparkSession)
    joined.select("page_id", "url", "payload", "digest", refers.alias("refers_to")).write.format("warc").mode("append").save(path)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read_warc(spark: SparkSession, path: str, *, payload: bool = True, verify: bool = False) -> DataFrame:
    """The records of all archives in and below path; with verify a record whose payload has been damaged is an error."""
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).option("verify", str(verify).lower()).load(path)


def page_number(c: str):
    """The id in a record's URN; null where it has none."""
    return F.expr(f"try_cast(substr({c}, {len(URN) + 1}) AS long)")


def round_trip(pages: DataFrame, *, least_bytes: int = 0) -> DataFrame:
    """Write pages as archives in the shared folder and read back page_id, payload_bytes, payload_digest, record_type, refers_to.

    Every payload that is stored is inflated again: bytes and digest of responses are those of what was read.
    """
    path = new_path(pages.sparkSession, "warc")
    to_warc(pages, path, least_bytes=least_bytes)
    back = read_warc(pages.sparkSession, path, payload=False, verify=True).filter(F.col("record_type").isin("response", "revisit"))
    return back.select(page_number("record_id").alias("page_id"), F.col("payload_length").alias("payload_bytes"), "payload_digest", "record_type", page_number("refers_to").alias("refers_to"))


def digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()
