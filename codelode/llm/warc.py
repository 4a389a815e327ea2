"""WARC archives as a PySpark data source.

Reading plans one partition per archive file, takes record-type and header predicates from the
query, parses a record's headers first and inflates a payload only if the record is wanted and
payloads are asked for. Archives of the writer carry each member's compressed length in a gzip
extra field, so that unwanted payloads are skipped by a seek; other gzip archives are inflated
member by member in bounded pieces, plain ones are skipped by Content-Length.

Writing rolls files at ``roll_bytes``. A task writes under hidden names with its attempt in
them; only the job's commit gives the files of successful attempts their names, so a lost
executor or a second attempt leaves nothing behind.

Odd cases of reading: a gzip member may hold any number of records, also part of one; blank
lines between records and header lines that end in LF alone are read; a header that a record
doesn't have is null; a file without records gives no rows; a block that doesn't start with
``WARC/``, a record without a valid Content-Length and one that the file ends in raise a
ValueError with the file's name, and no record is left out. For those of writing see ``write_warc``.

Options: path; payload (true, false); checks (true: size and SHA-1 of the payload as read).
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
import zlib
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualNullSafe,
    EqualTo,
    In,
    InputPartition,
    StringStartsWith,
    WriterCommitMessage,
)

from codelode.functions.shipping import ship
from codelode.llm.common import fresh_path

SCHEMA = "record_type string, record_id string, target_uri string, refers_to string, payload_digest string, http_length long, payload_size long, payload_sha1 string, payload binary"
#: Columns that come from one header each, for predicates.
HEADERS = {"record_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "refers_to": "warc-refers-to", "payload_digest": "warc-payload-digest"}
#: Bytes of a step in a file, and of the first one in a gzip member, which has room for most headers.
PIECE, FIRST = 1 << 16, 1 << 10


def open_store(path: str):
    """(file system, path on it) of a path or URI."""
    path = re.sub(r"^file:/+", "/", path)
    return (pafs.LocalFileSystem(), path) if path.startswith("/") else pafs.FileSystem.from_uri(path)


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data, usedforsecurity=False).digest()).decode()


def member(block: bytes) -> bytes:
    """One gzip member whose extra field SL has its compressed and plain length."""
    c = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = c.compress(block) + c.flush()
    total = 10 + 2 + 12 + len(body) + 8
    tail = struct.pack("<II", zlib.crc32(block), len(block) & 0xFFFFFFFF)
    if total >= 1 << 32:
        return b"\x1f\x8b\x08\x00" + bytes(4) + b"\x00\xff" + body + tail
    return b"\x1f\x8b\x08\x04" + bytes(4) + b"\x00\xff" + struct.pack("<H2sHII", 12, b"SL", 8, total, len(block) & 0xFFFFFFFF) + body + tail


def record(kind: str, record_id: str, uri: str | None, refers_to: str | None, digest: str, http_length: int, payload: bytes, date: str) -> bytes:
    clean = lambda s: "".join(c if 32 < ord(c) < 127 else "".join(f"%{b:02X}" for b in c.encode("utf-8", "surrogatepass")) for c in s)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {http_length}\r\n\r\n".encode()
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {date}"]
    if uri is not None:
        lines.append(f"WARC-Target-URI: {clean(uri)}")
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + len(payload)}", "", ""]
    return "\r\n".join(lines).encode() + http + payload + b"\r\n\r\n"


BLANK = re.compile(rb"\r?\n\r?\n")


def headers_of(block: bytes) -> dict[str, str]:
    out = {}
    for line in block.split(b"\n")[1:]:
        name, _, value = line.partition(b":")
        out[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    return out


class _Stream:
    """The plain bytes of a file, in pieces; what isn't wanted is passed over."""

    def __init__(self, pull):
        self.pull, self.have = pull, b""

    def more(self) -> bool:
        data = self.pull()
        self.have += data
        return bool(data)

    def blank(self) -> bool:
        """Pass over line ends; whether anything follows."""
        while True:
            self.have = self.have.lstrip(b"\r\n")
            if self.have:
                return True
            if not self.more():
                return False

    def headers(self) -> tuple[bytes, int]:
        """What stands before the next blank line, and the bytes up to the end of that line."""
        at = 0
        while not (found := BLANK.search(self.have, at)):
            at = max(0, len(self.have) - 3)
            if not self.more():
                raise ValueError("the file ends in the headers of a record")
        out, self.have = self.have[: found.start()], self.have[found.end() :]
        return out, found.end()

    def take(self, n: int) -> bytes:
        parts, left = [], n
        while left > 0:
            if not self.have and not self.more():
                raise ValueError("the file ends in a record")
            part = self.have[:left]
            parts.append(part)
            self.have, left = self.have[len(part) :], left - len(part)
        return b"".join(parts)

    def skip(self, n: int) -> None:
        while n > 0:
            if not self.have and not self.more():
                raise ValueError("the file ends in a record")
            part = min(n, len(self.have))
            self.have, n = self.have[part:], n - part


class _Gzip:
    """Pulls the plain bytes of the gzip members of a file one after the other, little of each at first."""

    def __init__(self, f):
        self.f, self.size, self.at, self.d, self.known, self.given = f, f.size(), 0, None, None, 0

    def _begin(self) -> None:
        self.f.seek(self.at)
        head = self.f.read(24)
        if head[:2] != b"\x1f\x8b":
            raise ValueError(f"no gzip member at byte {self.at}")
        self.known = struct.unpack("<II", head[16:24]) if len(head) == 24 and head[3] & 4 and head[12:14] == b"SL" else None
        self.f.seek(self.at)
        self.begun, self.raw, self.given, self.d = self.at, 0, 0, zlib.decompressobj(31)

    def __call__(self) -> bytes:
        while True:
            if self.d is None:
                if self.at >= self.size:
                    return b""
                self._begin()
            raw = self.d.unconsumed_tail
            if not raw:
                left = self.known[0] - self.raw if self.known else 0
                raw = self.f.read(min(PIECE, left) if left > 0 else PIECE)
                self.raw += len(raw)
            out = self.d.decompress(raw, PIECE if self.given else FIRST)
            if self.d.eof:
                self.at, self.d = self.begun + self.raw - len(self.d.unused_data), None
            elif not raw and not out:
                raise ValueError("the file ends in a gzip member")
            if out:
                self.given += len(out)
                return out

    def begins(self, held: int) -> bool:
        """Whether the ``held`` bytes not yet used are all that was given of the present member, and more is to come."""
        return self.d is not None and self.given == held

    def past(self, plain: int) -> bool:
        """Leave the present member if, by its extra field, it has just so many plain bytes: the next pull starts behind it."""
        if self.d is None or not self.known or self.known[1] != plain:
            return False
        self.at, self.d = self.begun + self.known[0], None
        return True


def records(f, gz: bool, wanted, payloads: bool):
    """(headers, HTTP headers, payload or None) of the wanted records of an open file."""
    pull = _Gzip(f) if gz else lambda: f.read(PIECE)
    stream = _Stream(pull)
    while stream.blank():
        alone = gz and pull.begins(len(stream.have))
        block, used = stream.headers()
        if not block.startswith(b"WARC/"):
            raise ValueError(f"no record starts with {block[:20]!r}")
        head = headers_of(block)
        if not head.get("content-length", "").isdecimal():
            raise ValueError(f"a record without a valid Content-Length: {head.get('content-length')!r}")
        left = int(head["content-length"])
        whole = used + left + 4  # plain bytes of a member that holds this record only
        asked, http, payload = wanted(head), {}, None
        if asked and head.get("content-type", "").startswith("application/http"):
            raw = b""
            while not (found := BLANK.search(raw)) and left and len(raw) < PIECE:
                raw += (part := stream.take(min(left, FIRST)))
                left -= len(part)
            cut = found.end() if found else len(raw)
            http = headers_of(raw[: found.start()] if found else raw)
            stream.have, left = raw[cut:] + stream.have, left + len(raw) - cut
        if asked and payloads:
            payload = stream.take(left)
        elif alone and pull.past(whole):
            stream.have = b""
        else:
            stream.skip(left)
        if asked:
            yield head, http, payload


@dataclass
class _File(InputPartition):
    path: str


class WarcReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.payloads = options.get("payload", "true").lower() == "true"
        self.checks = options.get("checks", "false").lower() == "true"
        self.tests: list[tuple[str, str, tuple]] = []

    def pushFilters(self, filters):
        for f in filters:
            at = getattr(f, "attribute", ())  # a negation has none
            name = at[0] if len(at) == 1 else ""
            if name in HEADERS and isinstance(f, (EqualTo, EqualNullSafe)) and f.value is not None:
                self.tests.append((name, "in", (f.value,)))
            elif name in HEADERS and isinstance(f, In):
                self.tests.append((name, "in", tuple(f.value)))
            elif name in HEADERS and isinstance(f, StringStartsWith):
                self.tests.append((name, "start", (f.value,)))
            else:
                yield f

    def partitions(self):
        store, root = open_store(self.path)
        info = store.get_file_info([root])[0]
        found = [info] if info.is_file else store.get_file_info(pafs.FileSelector(root, recursive=True, allow_not_found=True))
        return [_File(x.path) for x in sorted(found, key=lambda x: x.path) if x.is_file and not x.base_name.startswith((".", "_"))]

    def _wanted(self, head: dict) -> bool:
        for name, how, values in self.tests:
            value = _field(name, head)
            if value is None or not (value in values if how == "in" else value.startswith(values[0])):
                return False
        return True

    def _records(self, f, path: str):
        try:
            yield from records(f, path.endswith(".gz"), self._wanted, self.payloads or self.checks)
        except (ValueError, zlib.error) as e:
            raise ValueError(f"{path}: {e}") from e

    def read(self, partition):
        if partition is None:  # Spark makes one partition of none
            return
        store, _ = open_store(self.path)
        rows, held = [], 0
        with store.open_input_file(partition.path) as f:
            for head, http, payload in self._records(f, partition.path):
                checked = (len(payload), base32_sha1(payload)) if self.checks else (None, None)
                n = http.get("content-length")
                rows.append((*(_field(c, head) for c in HEADERS), int(n) if n else None, *checked, payload if self.payloads else None))
                held += len(payload or b"") if self.payloads else 0
                if len(rows) >= 1000 or held > 8 << 20:
                    yield _batch(rows)
                    rows, held = [], 0
        if rows:
            yield _batch(rows)


def _field(name: str, head: dict) -> str | None:
    value = head.get(HEADERS[name])
    if value is None:
        return None
    value = value.strip("<>") if name in ("record_id", "refers_to") else value
    return value.removeprefix("sha1:") if name == "payload_digest" else value


_TYPES = [pa.string()] * 5 + [pa.int64(), pa.int64(), pa.string(), pa.binary()]
_NAMES = [x.split()[0] for x in SCHEMA.split(", ")]


def _batch(rows):
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(_TYPES)], _NAMES)


@dataclass
class _Written(WriterCommitMessage):
    files: list[tuple[str, str]] = field(default_factory=list)


class WarcWriter(DataSourceArrowWriter):
    """Rows (record_type, record_id, target_uri, refers_to, payload_sha1 in hex, http_length, payload)."""

    def __init__(self, options):
        self.path = options["path"]
        self.roll = int(options.get("roll_bytes", 64 << 20))
        self.date = options.get("date", "1970-01-01T00:00:00Z")
        self.job = uuid.uuid4().hex[:12]

    def write(self, iterator):
        from pyspark import TaskContext

        context = TaskContext.get()
        store, root = open_store(self.path)
        store.create_dir(root, recursive=True)
        out, size, done = None, 0, _Written()
        try:
            for batch in iterator:
                for r in batch.to_pylist():
                    if out is None or size >= self.roll:
                        if out:
                            out.close()
                        name = f"part-{self.job}-{context.partitionId():05d}-{len(done.files):04d}.warc.gz"
                        hidden = f"{root}/.{name}.{context.taskAttemptId()}"
                        done.files.append((hidden, f"{root}/{name}"))
                        out, size = store.open_output_stream(hidden), 0
                    digest = base64.b32encode(bytes.fromhex(r["payload_sha1"])).decode()
                    data = member(record(r["record_type"], r["record_id"], r["target_uri"], r["refers_to"], digest, r["http_length"], r["payload"] or b"", self.date))
                    out.write(data)
                    size += len(data)
        finally:
            if out:
                out.close()
        return done

    def commit(self, messages):
        store, _ = open_store(self.path)
        for m in messages:
            for hidden, name in m.files if m else ():
                store.move(hidden, name)

    def abort(self, messages):
        store, _ = open_store(self.path)
        for m in messages:
            for hidden, _name in m.files if m else ():
                if store.get_file_info([hidden])[0].is_file:
                    store.delete_file(hidden)


class WarcSource(DataSource):
    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(dict(self.options))

    def writer(self, schema, overwrite):
        return WarcWriter(dict(self.options))


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def read_warc(spark: SparkSession, path: str, payload: bool = True, checks: bool = False) -> DataFrame:
    """Records under ``path``; filters on the columns of HEADERS are applied before payloads are inflated."""
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).option("checks", str(checks).lower()).load(path)


def write_warc(pages: DataFrame, path: str, page_id="page_id", url="url", html="html", least_bytes: int = 0) -> None:
    """One record per row. Of equal payloads of ``least_bytes`` or more, the row with the least id is the response and the others revisit it.

    A null html is an empty payload, a null url gives no target; a null id never is the one
    referred to, unless all are null, when all are responses; rows that repeat the least id are
    responses too; a payload of any length is one record; an empty table gives no file; extra
    columns are ignored.
    """
    register(pages.sparkSession)
    payload = F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8")
    rows = pages.select(F.col(page_id).alias("id"), F.col(url).cast("string").alias("target_uri"), payload.alias("payload")).withColumn("payload_sha1", F.sha1("payload"))
    firsts = rows.groupBy(F.unhex("payload_sha1").alias("d")).agg(F.min("id").alias("first")).select(F.lower(F.hex("d")).alias("payload_sha1"), "first")
    joined = rows.join(firsts, "payload_sha1")
    size = F.octet_length("payload").cast("long")
    again = (size >= least_bytes) & F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    name = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")))
    joined.select(
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        name("id").alias("record_id"),
        "target_uri",
        F.when(again, name("first")).alias("refers_to"),
        "payload_sha1",
        size.alias("http_length"),
        F.when(~again, F.col("payload")).alias("payload"),
    ).write.format("warc").mode("append").save(path)


def round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write ``pages`` to archives in the shared folder and return the records as read from them.

    Responses and revisits are read by predicates of their own: only the former inflate payloads,
    to check size and SHA-1; for the latter, responses are passed over by seeks.
    """
    spark, path = pages.sparkSession, fresh_path(pages.sparkSession, "warc")
    write_warc(pages, path, least_bytes=least_bytes)
    responses = read_warc(spark, path, payload=False, checks=True).where("record_type = 'response'")
    return responses.unionByName(read_warc(spark, path, payload=False).where("record_type = 'revisit'"))
