"""A data source for archive folders of documents as text files: spark.read.format("webloom_archive") after `register`.

A document lies in <folder>/<shard>/<raw_id>.md, a blocked one in <raw_id>.BLOCKED.md; the shard is the first `digits` hex digits
of its id's SHA-1, and a flat folder (digits 0) is read as well. Rows are (raw_id, blocked, size, modified, text).

* Tasks list shards themselves, so the driver lists the folder's own level only.
* Conditions `raw_id = ..`, `raw_id IN (..)` and `blocked = ..` go to the source: of an asked id only its own file is opened, without
  any listing; a file on the wrong side of `blocked` is not opened. `read_keys` does so for ids that are a table.
* Option `what`: `list` opens nothing (text is null), `head` reads up to the head's closing line, `text` (the default) all.
* A write makes each file under another name and moves it, so a document is whole or absent, and a task that runs twice
  writes the same files. A commit then names what was written; the offset of a stream is the number of commits, so a stream gets each
  commit's documents once, as they are when the batch reads them. One write at a time. Of a write that fails no stream learns,
  but documents that it finished stay.

Ids are percent-encoded in names, so any text is an id; a null id is refused. `size` is in bytes.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterable, Iterator, Sequence
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

FORMAT = "webloom_archive"
SCHEMA = "raw_id string, blocked boolean, size long, modified timestamp, text string"
_ARROW = pa.schema([("raw_id", pa.string()), ("blocked", pa.bool_()), ("size", pa.int64()), ("modified", pa.timestamp("us", "UTC")), ("text", pa.string())])
END, BLOCKED, COMMITS = ".md", ".BLOCKED", "_commits"
#: Name of the empty id; no encoded id is a lone percent sign.
EMPTY = "%"
#: Rows and bytes of a batch that a task hands over, and files of one task of a flat folder or of asked ids.
BATCH_ROWS, BATCH_BYTES, TASK_FILES = 512, 8 << 20, 1000


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system and the path within it of a path or URI."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    system, inner = fs.FileSystem.from_uri(path)
    return system, inner.rstrip("/")


def file_name(raw_id: str, blocked: bool) -> str:
    name = quote(raw_id, safe=" !$&'()+,;=@~") or EMPTY
    if name[:1] in ("_", "."):
        name = f"%{ord(name[0]):02X}{name[1:]}"
    if name.endswith(BLOCKED):
        name = f"{name[: -len(BLOCKED)]}%2E{BLOCKED[1:]}"
    return f"{name}{BLOCKED if blocked else ''}{END}"


def id_of(name: str) -> tuple[str, bool] | None:
    """(raw_id, blocked) of a file's name; None for other files."""
    if not name.endswith(END) or name.startswith(("_", ".")):
        return None
    plain = name[: -len(END)]
    blocked = plain.endswith(BLOCKED)
    own = plain[: -len(BLOCKED)] if blocked else plain
    return "" if own == EMPTY else unquote(own), blocked


def shard_of(raw_id: str, digits: int) -> str:
    return hashlib.sha1(raw_id.encode()).hexdigest()[:digits]


def _joined(*parts: str) -> str:
    return "/".join(p for p in parts if p)


def _text(system: fs.FileSystem, path: str, what: str) -> str | None:
    """A document's text, or its head up to the closing line; None where nothing is read."""
    if what == "list":
        return None
    with system.open_input_stream(path) as source:
        got = b""
        while block := source.read(16_384 if what == "head" else None):
            got += block
            if what == "head":
                at = got.find(b"\n---", 4)
                if not got.startswith(b"---") or at >= 0:
                    got = got[: at + 4] + b"\n" if got.startswith(b"---") else b""
                    break
        return got.decode("utf-8", "replace")


def _batches(system: fs.FileSystem, found: Iterable[fs.FileInfo], what: str, blocked: bool | None = None) -> Iterator[pa.RecordBatch]:
    """Record batches of the documents among files, in pieces of a bounded size."""
    rows, size = [], 0
    for info in found:
        named = id_of(info.base_name) if info.type == fs.FileType.File else None
        if named and blocked in (None, named[1]):
            text = _text(system, info.path, what)
            rows.append({"raw_id": named[0], "blocked": named[1], "size": info.size, "modified": info.mtime, "text": text})
            size += len(text or "")
            if len(rows) >= BATCH_ROWS or size >= BATCH_BYTES:
                yield pa.RecordBatch.from_pylist(rows, _ARROW)
                rows, size = [], 0
    if rows:
        yield pa.RecordBatch.from_pylist(rows, _ARROW)


def _levels(system: fs.FileSystem, folder: str) -> tuple[list[str], list[str]]:
    """Names of the shards and of the documents at the folder's own level."""
    found = system.get_file_info(fs.FileSelector(folder, allow_not_found=True))
    shards = [i.base_name for i in found if i.type == fs.FileType.Directory and re.fullmatch("[0-9a-f]{1,4}", i.base_name)]
    return sorted(shards), sorted(i.base_name for i in found if i.type == fs.FileType.File and id_of(i.base_name))


def _asked_paths(folder: str, raw_id: str, lengths: Iterable[int], blocked: bool | None = None) -> list[str]:
    kinds = (False, True) if blocked is None else (blocked,)
    return [_joined(folder, shard_of(raw_id, n), file_name(raw_id, b)) for n in lengths for b in kinds]


class Shards(InputPartition):
    """Shards that a task lists, or paths that it opens."""

    def __init__(self, shards: Sequence[str] = (), paths: Sequence[str] = ()) -> None:
        self.shards, self.paths = list(shards), list(paths)


class ArchiveReader(DataSourceReader):
    def __init__(self, folder: str, what: str, tasks: int) -> None:
        self.folder, self.what, self.tasks = folder, what, tasks
        self.keys: set[str] | None = None
        self.blocked: bool | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("blocked",) and self.blocked in (None, f.value):
                self.blocked = f.value
            elif isinstance(f, (EqualTo, In)) and f.attribute == ("raw_id",):
                asked = {v for v in (f.value if isinstance(f, In) else (f.value,)) if v is not None}
                self.keys = asked if self.keys is None else self.keys & asked
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        system, folder = opened(self.folder)
        shards, flat = _levels(system, folder)
        if self.keys is not None:
            lengths = sorted({len(s) for s in shards} | ({0} if flat else set()))
            paths = [p for key in sorted(self.keys) for p in _asked_paths(folder, key, lengths, self.blocked)]
        else:
            paths = [_joined(folder, name) for name in flat]
        parts = [Shards(paths=paths[k : k + TASK_FILES]) for k in range(0, len(paths), TASK_FILES)]
        if self.keys is None:
            parts += [Shards(shards=shards[k :: self.tasks]) for k in range(min(self.tasks, len(shards)))]
        return parts or [Shards()]

    def read(self, partition: Shards) -> Iterator[pa.RecordBatch]:
        system, folder = opened(self.folder)
        if partition.paths:
            yield from _batches(system, system.get_file_info(partition.paths), self.what, self.blocked)
        for shard in partition.shards:
            found = system.get_file_info(fs.FileSelector(_joined(folder, shard), allow_not_found=True))
            yield from _batches(system, found, self.what, self.blocked)


class ArchiveStream(DataSourceStreamReader):
    """What commits added; an offset is a number of commits."""

    def __init__(self, folder: str, what: str) -> None:
        self.folder, self.what = folder, what

    def initialOffset(self) -> dict:  # noqa: N802
        return {"commits": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        system, folder = opened(self.folder)
        return {"commits": _commits(system, folder)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        system, folder = opened(self.folder)
        parts = [part for k in range(start["commits"], end["commits"]) for part in _lines(system, _joined(folder, COMMITS, _number(k)))]
        return [Shards(paths=[part]) for part in parts]

    def read(self, partition: Shards) -> Iterator[pa.RecordBatch]:
        system, folder = opened(self.folder)
        for part in partition.paths:
            names = [_joined(folder, name) for name in _lines(system, _joined(folder, COMMITS, "parts", part))]
            for k in range(0, len(names), TASK_FILES):
                yield from _batches(system, system.get_file_info(names[k : k + TASK_FILES]), self.what)


def _number(k: int) -> str:
    return f"{k:020d}.txt"


def _commits(system: fs.FileSystem, folder: str) -> int:
    found = system.get_file_info(fs.FileSelector(_joined(folder, COMMITS), allow_not_found=True))
    return sum(i.type == fs.FileType.File and re.fullmatch(r"[0-9]{20}\.txt", i.base_name) is not None for i in found)


def _lines(system: fs.FileSystem, path: str) -> list[str]:
    with system.open_input_stream(path) as source:
        return source.read().decode().splitlines()


def _put(system: fs.FileSystem, path: str, content: bytes) -> None:
    """Makes a file whole or not at all."""
    above, name = path.rsplit("/", 1)
    hidden = _joined(above, f"_{uuid.uuid4().hex}")
    with system.open_output_stream(hidden) as sink:
        sink.write(content)
    system.move(hidden, path)


class Written(WriterCommitMessage):
    """Name of the file that lists what a task wrote."""

    def __init__(self, part: str) -> None:
        self.part = part


class ArchiveWriter(DataSourceArrowWriter):
    def __init__(self, folder: str, digits: int) -> None:
        self.folder, self.digits = folder, digits

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, folder = opened(self.folder)
        names, made = [], set()
        for batch in iterator:
            for raw_id, blocked, text in zip(*(batch.column(c).to_pylist() for c in ("raw_id", "blocked", "text")), strict=True):
                if raw_id is None:
                    raise ValueError("a document without raw_id has no place in an archive")
                shard = shard_of(raw_id, self.digits)
                if shard not in made:
                    system.create_dir(_joined(folder, shard), recursive=True)
                    made.add(shard)
                name = _joined(shard, file_name(raw_id, bool(blocked)))
                _put(system, _joined(folder, name), (text or "").encode())
                names.append(name)
        part = f"{uuid.uuid4().hex}.txt"
        system.create_dir(_joined(folder, COMMITS, "parts"), recursive=True)
        _put(system, _joined(folder, COMMITS, "parts", part), "\n".join(names).encode())
        return Written(part)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        system, folder = opened(self.folder)
        system.create_dir(_joined(folder, COMMITS), recursive=True)
        _put(system, _joined(folder, COMMITS, _number(_commits(system, folder))), "\n".join(m.part for m in messages if m).encode())

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        system, folder = opened(self.folder)
        for message in messages:
            if message:
                system.delete_file(_joined(folder, COMMITS, "parts", message.part))


class ArchiveSource(DataSource):
    """Options: path; what (list, head, text); tasks (256), at most so many tasks for the shards; digits (2, 0 to 4) of a write."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def _path(self) -> str:
        if not self.options.get("path"):
            raise ValueError("an archive needs a path")
        return self.options["path"]

    def _what(self) -> str:
        what = self.options.get("what", "text")
        if what not in ("list", "head", "text"):
            raise ValueError(f"what is list, head or text, not {what}")
        return what

    def reader(self, schema: StructType) -> DataSourceReader:
        return ArchiveReader(self._path(), self._what(), max(1, int(self.options.get("tasks", "256"))))

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:  # noqa: N802
        return ArchiveStream(self._path(), self._what())

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        digits = int(self.options.get("digits", "2"))
        if overwrite:
            raise ValueError("an archive is added to: a document of the same id and status replaces the older one")
        if not 0 <= digits <= 4:
            raise ValueError("digits is 0 to 4")
        return ArchiveWriter(self._path(), digits)


def register(spark: SparkSession) -> None:
    """Names the source in a session and lets conditions go to Python sources."""
    spark.dataSource.register(ArchiveSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read(spark: SparkSession, folder: str, what: str = "text", **options: str) -> DataFrame:
    """The archive's documents, in up to four tasks a core."""
    register(spark)
    return spark.read.format(FORMAT).options(**{"what": what, "tasks": str(4 * spark.sparkContext.defaultParallelism)} | options).load(folder)


def read_stream(spark: SparkSession, folder: str, what: str = "text") -> DataFrame:
    register(spark)
    return spark.readStream.format(FORMAT).option("what", what).load(folder)


def write(docs: DataFrame, folder: str, digits: int = 2) -> None:
    """Adds docs (raw_id, blocked, text) as one commit."""
    register(docs.sparkSession)
    docs.select("raw_id", "blocked", "text").write.format(FORMAT).option("digits", digits).mode("append").save(folder)


def read_keys(wanted: DataFrame, folder: str, what: str = "text") -> DataFrame:
    """The documents of wanted (raw_id), each id once: every task opens the files of its ids, and nothing is listed but the shards' names."""
    system, inner = opened(folder)
    shards, flat = _levels(system, inner)
    lengths = sorted({len(s) for s in shards} | ({0} if flat else set()))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, inner = opened(folder)
        for batch in batches:
            keys = [k for k in batch.column(0).to_pylist() if k is not None]
            for k in range(0, len(keys), TASK_FILES):
                paths = [p for key in keys[k : k + TASK_FILES] for p in _asked_paths(inner, key, lengths)]
                if paths:
                    yield from _batches(system, system.get_file_info(paths), what)

    return wanted.select("raw_id").distinct().mapInArrow(look, SCHEMA)
