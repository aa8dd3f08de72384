"""Files as a Spark data source: ``spark.read.format("assets")`` and ``df.write.format("assets")``.

Reading packs files into tasks by what a task will read of them, longest first, so that a few large files don't
wait behind many small ones. A column that isn't asked for isn't read: without ``content`` only the first bytes of a file
are fetched, without ``head`` as well no file is opened. Conditions on path and length are settled on the listing.

Writing is all or nothing. A task writes to attempt files in a staging folder and lists them in a manifest; only when
every task has ended does the driver store the list of manifests as one file, the point of commit, and move the attempt
files to their places, each by a rename. A write that is killed before leaves nothing in place, one that is killed
after is completed by ``recover``. Messages to the driver are a path a task, manifests are read one after the other.
"""

from __future__ import annotations

import heapq
import json
import os
import threading
import uuid
from collections.abc import Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, StringEndsWith, StringStartsWith, WriterCommitMessage
from pyspark.sql.types import StructType

from .shared import shared_folder

SCHEMA = "path string, length long, head binary, content binary, error_kind string, error_message string"
WRITTEN = "path string, bytes long, error_kind string, error_message string, wanted string"
#: Bytes of a head; bytes that opening a file counts for; bytes of a batch; renames at a time.
HEAD, OPENING, BATCH, RENAMES = 1024, 1 << 16, 16 << 20, 32
#: Fixed value: the last number tried for a name.
MOST = 9999
_KINDS = {"path": pa.string(), "length": pa.int64(), "head": pa.binary(), "content": pa.binary(), "error_kind": pa.string(), "error_message": pa.string()}
_ERRORS = (OSError, pa.ArrowException, ValueError, TypeError)


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The store of a path or URI and the path in it."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class Files(InputPartition):
    """What one task reads: paths with their lengths."""

    found: list[tuple[str, int]]


def packed(found: Iterable[tuple[str, int]], cost: dict[str, int], most: int) -> list[list[tuple[str, int]]]:
    """Files in as many parts as their costs fill, each file to the part that is emptiest so far, the costliest first."""
    found = sorted(found, key=lambda f: (-cost[f[0]], f[0]))
    parts: list[list] = [[] for _ in range(max(1, -(-sum(cost.values()) // most)))]
    free = [(0, i) for i in range(len(parts))]
    for f in found:
        used, i = heapq.heappop(free)
        parts[i].append(f)
        heapq.heappush(free, (used + cost[f[0]], i))
    return [p for p in parts if p]


_TESTS = {
    EqualTo: lambda a, b: a == b, In: lambda a, b: a in b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b,
    LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b, StringStartsWith: str.startswith, StringEndsWith: str.endswith,
}


class AssetReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]):
        self.columns = schema.names
        self.folder, self.recursive = options["path"], options.get("recursive", "true") == "true"
        self.head, self.most = int(options.get("head", HEAD)), int(options.get("partitionbytes", 128 << 20))
        self.conditions: list[tuple[str, type, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Conditions on path and length are kept here, the others are Spark's."""
        for f in filters:
            if type(f) in _TESTS and f.attribute in (("path",), ("length",)):
                self.conditions.append((f.attribute[0], type(f), f.value))
            else:
                yield f

    def partitions(self) -> list[Files]:
        system, at = opened(self.folder)
        scheme = self.folder[: len(self.folder) - len(at)] if self.folder.endswith(at) else ""
        listed = system.get_file_info(fs.FileSelector(at, recursive=self.recursive, allow_not_found=True))
        found = [(scheme + i.path, i.size) for i in listed if i.type == fs.FileType.File]
        found = [(p, n) for p, n in found if all(_TESTS[kind](p if on == "path" else n, value) for on, kind, value in self.conditions)]
        reads = {"content": lambda n: n, "head": lambda n: min(n, self.head)}
        part = next((f for c, f in reads.items() if c in self.columns), None)
        return [Files(p) for p in packed(found, {p: OPENING + part(n) if part else 64 for p, n in found}, self.most)] or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        wait, held = [], 0
        for row in map(self._row, partition.found):
            wait.append(row)
            held += len(row["content"] or row["head"] or b"")
            if held >= BATCH or len(wait) == 1000:
                yield self._batch(wait)
                wait, held = [], 0
        yield self._batch(wait)

    def _batch(self, rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], _KINDS[c]) for c in self.columns], names=self.columns)

    def _row(self, found: tuple[str, int]) -> dict:
        row = dict.fromkeys(_KINDS) | dict(zip(("path", "length"), found, strict=True))
        whole = "content" in self.columns
        if whole or "head" in self.columns:
            try:
                system, at = opened(row["path"])
                with system.open_input_file(at) as f:
                    got = f.read() if whole else f.read(self.head)
                row |= {"head": got[: self.head], "content": got if whole else None}
            except _ERRORS as e:
                row |= {"error_kind": "Io", "error_message": str(e)}
        return row


@dataclass
class Manifest(WriterCommitMessage):
    path: str
    files: int = 0


@dataclass
class AssetWriter(DataSourceArrowWriter):
    """Writes rows (path, content); what can't be written is an error in its manifest, not a failed task."""

    staging: str
    columns: list[str] = field(default_factory=list)
    exclusive: bool = False

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Manifest:
        system, root = opened(self.staging)
        attempt = uuid.uuid4().hex
        system.create_dir(f"{root}/{attempt}", recursive=True)
        n = 0
        with system.open_output_stream(f"{root}/{attempt}.jsonl", compression=None) as manifest:
            for batch in iterator:
                for path, content in zip(batch.column(self.columns.index("path")).to_pylist(), batch.column(self.columns.index("content")).to_pylist(), strict=True):
                    row = {"path": path, "attempt": f"{attempt}/{n}", "bytes": None, "error_kind": None, "error_message": None}
                    try:
                        _check(path)
                        with system.open_output_stream(f"{root}/{row['attempt']}", compression=None) as f:
                            f.write(content)
                        row["bytes"] = len(content)
                    except _ERRORS as e:
                        row |= {"error_kind": "Io", "error_message": str(e)}
                    manifest.write(json.dumps(row).encode() + b"\n")
                    n += 1
        return Manifest(f"{attempt}.jsonl", n)

    def commit(self, messages: list[Manifest | None]) -> None:
        system, root = opened(self.staging)
        system.create_dir(root, recursive=True)
        with system.open_output_stream(f"{root}/commit.part", compression=None) as f:
            f.write(json.dumps({"exclusive": self.exclusive, "manifests": [m.path for m in messages if m]}).encode())
        system.move(f"{root}/commit.part", f"{root}/commit.json")
        publish(self.staging)

    def abort(self, messages: list[Manifest | None]) -> None:
        system, root = opened(self.staging)
        if system.get_file_info(root).type == fs.FileType.Directory:
            system.delete_dir(root)


def _check(path: str | None) -> None:
    """Raises what would keep a file from its place, as far as it shows beforehand."""
    system, at = opened(path or "")
    if not at.strip("/"):
        raise ValueError(f"no file name: {path!r}")
    if system.get_file_info(at).type == fs.FileType.Directory:
        raise IsADirectoryError(f"a folder is there: {path}")
    system.create_dir(at.rpartition("/")[0] or "/", recursive=True)


def numbered(path: str, n: int) -> str:
    """A path with (n) behind its stem; itself for 0."""
    folder, slash, name = path.rpartition("/")
    stem, dot, ext = name.rpartition(".")
    stem, ext = (stem, dot + ext) if stem and dot else (name, "")
    return f"{folder}{slash}{stem}({n}){ext}" if n else path


def _free(source: str, at: str) -> str:
    """Links a file to the first of its numbered names that nobody has, in one step for each; at once its place if it got one before."""
    for n in range(MOST + 1):
        name = numbered(at, n)
        try:
            os.link(source, name)
            return name
        except FileExistsError:
            if os.path.samefile(source, name):
                return name
    raise FileExistsError(at)


def _place(staging: str, row: dict, exclusive: bool = False) -> dict:
    """Moves one attempt file to its place; done already if it is gone. ``exclusive`` takes no name that is there."""
    row = row | {"wanted": row["path"]}
    if row["error_kind"]:
        return row
    try:
        system, root = opened(staging)
        target, at = opened(row["path"])
        source, scheme = f"{root}/{row['attempt']}", row["path"][: len(row["path"]) - len(at)]
        if system.get_file_info(source).type != fs.FileType.File:
            return row
        beside = f"{at.rpartition('/')[0]}/.{uuid.uuid4().hex}.part"
        if exclusive and target.type_name == "local":
            try:
                at = _free(source, at)
            except OSError as e:
                if isinstance(e, FileExistsError):
                    raise
                fs.copy_files(source, beside, source_filesystem=system, destination_filesystem=target)  # another device
                at = _free(beside, at)
                target.delete_file(beside)
            # the attempt file stays until its manifest is stored: a link to it tells later where it went
            return row | {"path": scheme + at}
        if exclusive:  # stores without links: looked up first, so two jobs at the same moment can still meet
            at = next((x for n in range(MOST + 1) if target.get_file_info(x := numbered(at, n)).type == fs.FileType.NotFound), at)
        if target.type_name == system.type_name:
            try:
                target.move(source, at)
                return row | {"path": scheme + at}
            except OSError:  # another device: copied beside its place first
                pass
        fs.copy_files(source, beside, source_filesystem=system, destination_filesystem=target)
        target.move(beside, at)
        system.delete_file(source)
        return row | {"path": scheme + at}
    except _ERRORS as e:
        return row | {"bytes": None, "error_kind": "Io", "error_message": str(e)}


def publish(staging: str) -> None:
    """Moves the files of a committed write to their places and stores what became of each; may run again."""
    system, root = opened(staging)
    with system.open_input_stream(f"{root}/commit.json", compression=None) as f:
        commit = json.loads(f.read())
    with ThreadPoolExecutor(RENAMES) as pool:
        for name in commit["manifests"]:
            if system.get_file_info(f"{root}/written/{name}").type == fs.FileType.File:
                continue  # done by an earlier call
            with system.open_input_stream(f"{root}/{name}", compression=None) as f, system.open_output_stream(f"{root}/{name}.part", compression=None) as out:
                lines = iter(f.read().splitlines())
                while some := [json.loads(line) for _, line in zip(range(1000), lines)]:
                    for row in pool.map(lambda r: _place(staging, r, commit["exclusive"]), some):
                        out.write(json.dumps({k: v for k, v in row.items() if k != "attempt"}).encode() + b"\n")
            system.create_dir(f"{root}/written", recursive=True)
            system.move(f"{root}/{name}.part", f"{root}/written/{name}")
            if system.get_file_info(f"{root}/{name[:-6]}").type == fs.FileType.Directory:
                system.delete_dir(f"{root}/{name[:-6]}")


def recover(folder: str) -> dict[str, bool]:
    """Each write that was cut off under a folder of stagings: completed if it was committed (True), else its attempts deleted.

    To be called while no write runs there; a committed write that was complete is left as it is.
    """
    system, root = opened(folder)
    base, done = folder[: len(folder) - len(root)] if folder.endswith(root) else "", {}
    for info in system.get_file_info(fs.FileSelector(root, allow_not_found=True)):
        if info.type == fs.FileType.Directory and info.base_name.startswith("staging-"):
            done[info.base_name] = system.get_file_info(f"{info.path}/commit.json").type == fs.FileType.File
            if done[info.base_name]:
                publish(base + info.path)
            else:
                system.delete_dir(info.path)
    return done


class AssetSource(DataSource):
    """Options of reading: path, recursive, head (bytes), partitionBytes. Of writing: staging, exclusive."""

    @classmethod
    def name(cls) -> str:
        return "assets"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> AssetReader:
        return AssetReader(schema, {k.lower(): v for k, v in self.options.items()})

    def writer(self, schema: StructType, overwrite: bool) -> AssetWriter:
        return AssetWriter(self.options["staging"], schema.names, self.options.get("exclusive") == "true")


_registering = threading.Lock()


def register(spark: SparkSession) -> None:
    """Makes the source known to a session, and to the active one, which Spark asks: in a micro-batch they differ."""
    active = SparkSession.getActiveSession()
    with _registering:
        for session in [spark] + ([active] if active else []):
            session.conf.set("spark.sql.python.filterPushdown.enabled", "true")
            session.dataSource.register(AssetSource)


def scan(spark: SparkSession, folder: str, columns: str = "path string, length long, head binary", head: int = HEAD, partition_bytes: int = 128 << 20, recursive: bool = True) -> DataFrame:
    """The files of a folder with the given columns of ``SCHEMA``; of a file nothing else is read."""
    register(spark)
    options = {"head": head, "partitionBytes": partition_bytes, "recursive": str(recursive).lower()}
    return spark.read.format("assets").schema(columns).options(**options).load(folder)


def write(files: DataFrame, staging: str | None = None, exclusive: bool = False, job: str | None = None) -> DataFrame:
    """Writes ``files`` (path, content) now, all or none; (path, bytes, error_kind, error_message, wanted) of each.

    With ``exclusive`` a file never takes a name that is there, whoever put it there meanwhile: it gets the lowest free number behind its
    stem, and ``path`` is where it stands. Names are taken by creating them, so jobs that run at once share none.

    A path that is null, names a folder or can't be written is an error row and doesn't hold up the others. Of rows with one
    path the last to be moved stays. ``staging`` is a folder of the store that the files go to, by default one in the shared folder.
    A ``job`` with a name of its own there is written once: called again, it completes what was committed and returns that.
    """
    spark = files.sparkSession
    register(spark)
    staging = f"{staging or shared_folder(spark)}/staging-{job or uuid.uuid4().hex}"
    system, root = opened(staging)
    if job and system.get_file_info(f"{root}/commit.json").type == fs.FileType.File:
        publish(staging)
        return spark.read.schema(WRITTEN).json(f"{staging}/written")
    if job and system.get_file_info(root).type == fs.FileType.Directory:
        system.delete_dir(root)  # attempts of a call that ended before its commit
    files.select("path", "content").write.format("assets").options(staging=staging, exclusive=str(exclusive).lower()).mode("append").save()
    system.create_dir(f"{root}/written", recursive=True)  # there is none where there was nothing to write
    return spark.read.schema(WRITTEN).json(f"{staging}/written")
