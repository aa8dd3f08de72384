"""WARC writer and salvage reader.

The writer puts each record into a gzip member of its own, with block and payload digests,
and rolls to a new archive at a size. The reader checks members (CRC), headers, lengths
and digests; a member may hold any number of records, and version lines of any number count. After a failed
check it searches for the next valid member or version line, goes on there, and logs the bytes between as a
quarantined gap; records behind the damage are not lost. A damaged record whose frame still holds (its length
leads to the next record) is skipped whole, so that no record inside its payload is taken for one of the
archive. Of a damaged member, records whose own digest holds are recovered. It reads through a window, never a
whole archive or member; a record's block is held, whatever its length.

Archives go to the shared folder through Arrow's file systems; a manifest names the ones of
successful tasks, so a task that is run again leaves no record twice.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import Scratch, new_path

#: Archives are rolled at so many bytes and read in blocks of so many.
ROLL, BLOCK = 32 << 20, 1 << 18
#: How a version line and a gzip member begin, and what ends a header and a record.
_VERSION, _GZIP, _BLANK = re.compile(rb"WARC/\d+\.\d+\r\n"), b"\x1f\x8b\x08", b"\r\n\r\n"

ORACLE_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS x, min(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (1 + ((('0x' || substr(x, 1 + (i // 4) * 5, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31))::INT, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM d
"""
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the public name space of URLs


def sha1_base32(b: bytes) -> str:
    return base64.b32encode(hashlib.sha1(b).digest()).decode()


@dataclass
class Record:
    start: int
    end: int
    headers: dict[str, str]
    block: bytes

    @property
    def payload(self) -> bytes:
        """The entity of an HTTP block, else the whole block."""
        if "application/http" in self.headers.get("content-type", ""):
            return self.block.partition(b"\r\n\r\n")[2]
        return self.block

    def http(self, name: str) -> str | None:
        for line in self.block.partition(b"\r\n\r\n")[0].split(b"\r\n")[1:]:
            key, _, value = line.partition(b":")
            if key.strip().lower() == name.lower().encode():
                return value.strip().decode("latin-1")
        return None


@dataclass
class Gap:
    start: int
    end: int
    reason: str


def record_bytes(kind: str, record_id: str, payload: bytes, uri: str = "", refers_to: str = "", more: dict[str, str] | None = None) -> bytes:
    """One record, not compressed. A revisit has the HTTP header alone."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head + (payload if kind != "revisit" else b"")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {record_id}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {quote(uri, safe='%:/?#[]@!$&()*+,;=~-._')}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{sha1_base32(payload)}",
        f"WARC-Block-Digest: sha1:{sha1_base32(block)}",
        *([f"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {refers_to}"] if kind == "revisit" else []),
        *(f"{k}: {v}" for k, v in (more or {}).items()),
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(b: bytes, level: int = 3) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(b) + z.flush()


@dataclass
class _Window:
    """Bytes of a file by place; keeps what is being read and no more."""

    read_at: Callable[[int, int], bytes]
    size: int
    at: int = 0
    held: bytearray = field(default_factory=bytearray)
    blank: int = -1

    def get(self, start: int, n: int) -> bytes:
        end = min(self.size, start + n)
        if start < self.at or start > self.at + len(self.held):
            self.at, self.held = start, bytearray()
        if start - self.at > 4 * BLOCK:
            del self.held[: start - self.at]
            self.at = start
        while self.at + len(self.held) < end:
            more = self.read_at(self.at + len(self.held), max(BLOCK, end - self.at - len(self.held)))
            if not more:
                break
            self.held += more
        return bytes(self.held[start - self.at : end - self.at])

    def find(self, marks: tuple[bytes, ...], start: int) -> int:
        """The first place of any mark from start on, or the size."""
        longest = max(map(len, marks))
        while start < self.size:
            part = self.get(start, BLOCK)
            hits = [i for m in marks if (i := part.find(m)) >= 0]
            if hits:
                return start + min(hits)
            start += max(1, len(part) - longest + 1) if start + len(part) < self.size else len(part) + 1
        return self.size


@dataclass
class _Inflated:
    """The bytes of the gzip member at a place of a window, forwards; it begins anew when asked for earlier ones."""

    w: _Window
    start: int
    z: object = None
    here: int = 0
    at: int = 0
    left: bytes = b""
    failed: Exception | None = None

    def read_at(self, at: int, n: int) -> bytes:
        if self.z is None or at < self.at:
            self.z, self.here, self.at, self.left = zlib.decompressobj(31), self.start, 0, b""
            self.failed = None
        out = bytearray()
        while len(out) < n:
            if not self.left:
                if self.failed or self.z.eof:
                    if self.failed and not out:
                        raise self.failed
                    break
                part = self.z.unconsumed_tail or self.w.get(self.here, BLOCK)
                if not part:  # the decompressor may still hold what the last call had no room for
                    self.left = self.z.decompress(b"", BLOCK)
                    if not self.left and not self.z.eof:
                        self.failed = ValueError("truncated member")
                    continue
                self.here += 0 if self.z.unconsumed_tail else len(part)
                before = self.z.copy()
                try:
                    self.left = self.z.decompress(part, BLOCK)
                except zlib.error:
                    # what comes before the damage, byte by byte; the error is met again behind it
                    self.z, rest = before, iter(range(len(part)))
                    more = []
                    try:
                        for k in rest:
                            more.append(self.z.decompress(part[k : k + 1]))
                    except zlib.error as e:
                        self.failed = e
                    self.left = b"".join(more)
                continue
            skip = min(len(self.left), max(0, at - self.at))
            take = self.left[skip : skip + n - len(out)]
            out += take
            self.at += skip + len(take)
            at = max(at, self.at)
            self.left = self.left[skip + len(take) :]
        return bytes(out)

    def checked(self) -> tuple[int, int, str]:
        """(bytes that can be read, the place behind the member, what is wrong with it); zlib checks CRC and length."""
        size = 0
        try:
            while part := self.read_at(size, BLOCK):
                size += len(part)
        except (ValueError, zlib.error) as e:
            return size, -1, str(e)
        return size, self.here - len(self.z.unused_data), ""


class _Damaged(ValueError):
    """A record that fails a check; end is the place behind it where its frame holds, else -1."""

    def __init__(self, reason: str, end: int = -1):
        super().__init__(reason)
        self.end = end


def _begins(w: _Window, at: int, gzip: bool = True) -> bool:
    return gzip and w.get(at, 3) == _GZIP or bool(_VERSION.match(w.get(at, 32)))


def _next(w: _Window, at: int, gzip: bool = True) -> int:
    """The first place from ``at`` on where a member or a version line begins, or the size."""
    while (at := w.find((_GZIP, b"WARC/") if gzip else (b"WARC/",), at)) < w.size and not _begins(w, at, gzip):
        at += 1
    return at


def _record(w: _Window, at: int, gzip: bool = True, sealed: bool = False) -> tuple[Record, int]:
    """The uncompressed record at a place and the place behind it; _Damaged where a check fails. ``sealed`` asks for a block digest."""
    if w.blank < at:
        w.blank = w.find((_BLANK,), at)
    if w.blank >= w.size:
        raise _Damaged("no end of headers")
    start = w.blank + len(_BLANK)
    headers, broken = {}, False
    for line in w.get(at, w.blank - at).split(b"\r\n")[1:]:
        key, colon, value = line.partition(b":")
        broken |= not colon
        headers[key.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    length = headers.get("content-length", "")
    if not re.fullmatch("[0-9]{1,18}", length) or start + int(length) > w.size:
        raise _Damaged("length")
    end = start + int(length)
    tail = w.get(end, 4)
    if tail not in (_BLANK, b""):
        raise _Damaged("no blank lines behind the block")
    record = Record(at, end + len(tail), headers, w.get(start, end - start))
    if record.end < w.size and not _begins(w, record.end, gzip):
        framed = -1
    else:
        framed = record.end
    if broken:
        raise _Damaged("broken header line", framed)
    digest = headers.get("warc-block-digest", "")
    known = digest.lower().startswith("sha1:")
    if known and digest[5:].upper() != sha1_base32(record.block):
        raise _Damaged("block digest", framed)
    if sealed and not known:
        raise _Damaged("no digest in a damaged member", framed)
    digest = headers.get("warc-payload-digest", "")
    if headers.get("warc-type") == "response" and digest.lower().startswith("sha1:") and digest[5:].upper() != sha1_base32(record.payload):
        raise _Damaged("payload digest", framed)
    return record, record.end


def _inside(w: _Window, sealed: bool) -> Iterator[Record | str]:
    """Records of a member's bytes, and why there are none wherever they begin to lack."""
    at, bad = 0, False
    while at < w.size:
        try:
            if not _begins(w, at, False):
                raise _Damaged("no version line")
            record, at = _record(w, at, False, sealed)
        except (ValueError, zlib.error) as e:
            if not bad:
                yield str(e)
            bad, at = True, e.end if getattr(e, "end", -1) >= 0 else _next(w, at + 1, False)
            continue
        bad = False
        yield record


def salvage(read_at: Callable[[int, int], bytes], size: int) -> Iterator[Record | Gap]:
    """Records of an archive in order, and a Gap for every run of bytes that held none or not all of a member's.

    start and end are places in the archive; records of one member share the member's. A gap follows what was
    recovered from its bytes. An empty archive gives nothing.
    """
    w = _Window(read_at, size)
    at, bad, reason = 0, -1, ""
    told: set[int] = set()  # records recovered from the last damaged member, which may stand in it as they are
    key = lambda x: hash((x.headers.get("warc-record-id"), x.headers.get("warc-block-digest")))
    while at < size:
        try:
            if w.get(at, 3) == _GZIP:
                held, end, wrong = _Inflated(w, at).checked()
                if wrong and not held:
                    raise _Damaged(wrong)
                inside, why, told = _Window(_Inflated(w, at).read_at, held), wrong, set()
                for x in _inside(inside, bool(wrong)):
                    if isinstance(x, str):
                        why = why or x
                        continue
                    if bad >= 0:
                        yield Gap(bad, at, reason)
                        bad = -1
                    x.start, x.end = at, end if end >= 0 else at + 1
                    if wrong:
                        told.add(key(x))
                    yield x
                if wrong:
                    raise _Damaged(wrong)
                if why:
                    raise _Damaged(why, end)
                if not held:
                    raise _Damaged("empty member", end)
                at = end
            elif _begins(w, at):
                record, end = _record(w, at)
                if bad >= 0 and key(record) in told:
                    at = end
                    continue
                if bad >= 0:
                    yield Gap(bad, at, reason)
                    bad = -1
                yield record
                at = end
            else:
                raise _Damaged("no member or version line")
        except (ValueError, zlib.error) as e:
            if bad < 0:
                bad, reason = at, str(e)
            at = e.end if getattr(e, "end", -1) >= 0 else _next(w, at + 1)
            continue
    if bad >= 0:
        yield Gap(bad, size, reason)


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'page:{page_id}')}>"


def write_archives(pages: DataFrame, out: str, least: int = 0, roll: int = ROLL) -> DataFrame:
    """Writes a record for each row of ``pages`` (page_id, url, html); (path, records, bytes) of the archives.

    Of payloads that are equal and have at least ``least`` bytes, the one with the smallest
    page_id is written whole and the others as revisits that refer to it. Rows repeated under that page_id are
    responses each. A null html is an empty payload, a null url an empty URI, a null page_id has no number and no
    revisit refers to it while another page has the payload. Payloads are held one at a time, at any length. Other columns are ignored,
    whatever their names. An empty table writes no archive.
    """
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    known = pages.select("page_id", F.unhex(F.sha2("html", 256)).alias("sha"), F.octet_length("html").alias("bytes"))
    firsts = known.where(F.col("bytes") >= least).groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    again = known.join(firsts, "sha").where(~F.col("page_id").eqNullSafe(F.col("first"))).select(F.col("page_id").alias("of"), F.col("sha").alias("of_sha"), "first").distinct()
    rows = pages.withColumn("sha", F.unhex(F.sha2("html", 256))).join(again, F.col("page_id").eqNullSafe(F.col("of")) & (F.col("sha") == F.col("of_sha")), "left").select("page_id", "url", "html", "first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = fs.FileSystem.from_uri(out)
        system.create_dir(base, recursive=True)
        task = TaskContext.get()
        file, path, n, size, k = None, "", 0, 0, 0
        told: list[tuple[str, int, int]] = []
        for batch in batches:
            for page_id, url, html, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if file is None:
                    path, n, size, k = f"{base}/part-{task.partitionId():05d}-{task.taskAttemptId()}-{k:04d}.warc.gz", 0, 0, k + 1
                    file = system.open_output_stream(path, compression=None)
                kind = "response" if first is None else "revisit"
                more = {} if page_id is None else {"X-Page-Id": str(page_id)}
                if first is not None:
                    more["X-Refers-To-Page-Id"] = str(first)
                member = gzip_member(record_bytes(kind, record_id(page_id), html.encode("utf-8", "surrogatepass"), url, record_id(first) if first is not None else "", more))
                file.write(member)
                n, size = n + 1, size + len(member)
                if size >= roll:
                    file.close()
                    told.append((path, n, size))
                    file = None
        if file is not None:
            file.close()
            told.append((path, n, size))
        if told:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*told, strict=True)], ["path", "records", "bytes"])

    return rows.mapInArrow(run, "path string, records long, bytes long")


def whole_number(value: str | None) -> int | None:
    """A header's value as a 64-bit number; null for what other writers put there."""
    value = (value or "").strip()
    return int(value) if re.fullmatch(r"[0-9]{1,18}", value) else None


def read_archives(manifest: DataFrame, out: str) -> DataFrame:
    """Records and gaps of the archives named by ``manifest`` (path, below ``out``), salvaged one archive a row.

    (path, start, end, kind, page_id, payload_bytes, payload_digest, refers_to, reason); kind is the
    record's type or ``gap``. Archives of other writers are read as well: page_id, refers_to and a revisit's payload_bytes
    are null where their headers aren't numbers.
    """
    schema = pa.schema([("path", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("reason", pa.string())])

    def rows(path: str, system: fs.FileSystem) -> Iterator[tuple]:
        with system.open_input_file(path) as file:
            for x in salvage(lambda at, n: file.read_at(n, at), file.size()):
                if isinstance(x, Gap):
                    yield path, x.start, x.end, "gap", None, None, None, None, x.reason
                    continue
                kind, number = x.headers.get("warc-type", ""), lambda h, x=x: whole_number(x.headers.get(h))
                if kind == "revisit":
                    size, digest = whole_number(x.http("Content-Length") or "0"), x.headers.get("warc-payload-digest", "")[5:]
                else:
                    size, digest = len(x.payload), sha1_base32(x.payload)
                yield path, x.start, x.end, kind, number("x-page-id"), size, digest, number("x-refers-to-page-id"), None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = fs.FileSystem.from_uri(out)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                wait: list[tuple] = []
                for row in rows(path, system):
                    wait.append(row)
                    if len(wait) == 1000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*wait, strict=True), schema, strict=True)], schema=schema)
                        wait = []
                if wait:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*wait, strict=True), schema, strict=True)], schema=schema)

    ddl = "path string, start long, end long, kind string, page_id long, payload_bytes long, payload_digest string, refers_to long, reason string"
    return manifest.select("path").mapInArrow(run, ddl)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page through archives in the shared folder and back.

    A null html is an empty payload; a null url an empty URI; repeated rows are records each. Quarantined
    gaps are written to the table warc-gaps beside the archives, in the shared folder; archives and gaps stay.
    """
    out = new_path(spark, "warc")
    manifest = Scratch(spark).cut(write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), out), "manifest")
    archives = manifest.count()  # a row for each archive; reading is dealt out by archive
    scratch = Scratch(spark)
    found = scratch.cut(read_archives(manifest.repartition(max(1, archives)), out), "warc-records")
    scratch.cut(found.where("kind = 'gap'").select("path", "start", "end", "reason"), "warc-gaps")
    return found.where("kind <> 'gap'").select("page_id", "payload_bytes", "payload_digest", F.col("kind").alias("record_type"), "refers_to")
