"""Document files as a data source of Spark: spark.read.format("lectern_documents").load(path), and the same for readStream.

A planner lists the files of a folder and packs them into partitions of about partitionBytes, so many small files are one task and a large one
is a task of its own. A row is a parsed file, (name, kind, parts, error); lectern.sources.files.documents makes documents of them. A stream
takes files in the order of their time of change and path; its offset is the last of them. Files are listed and opened through Arrow's file
systems (local folders, object stores, HDFS), by the planner and by the tasks.

Options: recursive (false), extensions (pdf,txt,docx), partitionBytes (64 MiB), and for streams settleSeconds (2): files younger than that
wait for a later batch, as others of the same moment may still come; and maxBytes (none): about how much a batch takes.
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from lectern.sources.files import EXTENSIONS, pdf_parts, word_parts

FORMAT = "lectern_documents"
PARTITION_BYTES, SETTLE_SECONDS = 64 << 20, 2.0
SCHEMA = "name string, kind string, parts array<struct<page:int,text:string,rows:array<array<string>>>>, error string"


@dataclass(frozen=True, order=True)
class Found:
    """A listed file; files are ordered by their time of change, then path."""

    changed: int
    path: str
    size: int

    @property
    def name(self) -> str:
        return self.path.rsplit("/", 1)[-1]

    @property
    def kind(self) -> str:
        return self.name.rsplit(".", 1)[-1].lower() if "." in self.name else ""


@dataclass
class Files(InputPartition):
    """The files of one task."""

    files: tuple[Found, ...]


def _opened(path: str):
    """The file system of a path, and the path in it."""
    from pyarrow.fs import FileSystem

    if path.startswith("file:/"):
        path = "file:///" + quote(unquote(path[len("file:") :]).lstrip("/"))
    return FileSystem.from_uri(path if "://" in path else "file://" + quote(path))


def packed(files: list[Found], most: int) -> list[Files]:
    """Files in partitions of at most most bytes, larger ones alone: longest first, each into the first partition with room."""
    bins: list[tuple[list[Found], list[int]]] = []
    open_from = 0  # partitions before it have no room for the smallest file
    least = min((f.size for f in files), default=0)
    for f in sorted(files, key=lambda f: (-f.size, f.path)):
        for held, size in bins[open_from:]:
            if size[0] + f.size <= most:
                held.append(f)
                size[0] += f.size
                break
        else:
            bins.append(([f], [f.size]))
        while open_from < len(bins) and bins[open_from][1][0] + least > most:
            open_from += 1
    return [Files(tuple(held)) for held, _ in bins]


def parsed(content: bytes, kind: str) -> list[dict]:
    """The parts of a file: its text as a whole, its paragraphs and tables, or its pages."""
    if kind == "txt":
        return [{"page": None, "text": content.decode("utf-8", "replace"), "rows": None}]
    return (word_parts if kind == "docx" else pdf_parts)(content)


class _Reading:
    """What batch and stream share: listing, packing and parsing."""

    def __init__(self, options: dict[str, str]):
        self.path = options.get("path", "")
        self.recursive = options.get("recursive", "false").lower() == "true"
        self.extensions = frozenset(x.strip().lower() for x in options.get("extensions", ",".join(EXTENSIONS)).split(","))
        self.most = int(options.get("partitionbytes", options.get("partitionBytes", PARTITION_BYTES)))
        self.settle = float(options.get("settleseconds", options.get("settleSeconds", SETTLE_SECONDS)))
        limit = options.get("maxbytes", options.get("maxBytes"))
        self.limit = None if limit is None else int(limit)
        if not self.path:
            raise ValueError(f"{FORMAT} needs a path")

    def listed(self) -> list[Found]:
        """Files of the wanted kinds in order, hidden ones left out."""
        from pyarrow.fs import FileSelector, FileType

        system, root = _opened(self.path)
        at = root.rstrip("/") + "/"
        found = [Found(i.mtime_ns or 0, i.path, i.size) for i in system.get_file_info(FileSelector(root, recursive=self.recursive)) if i.type == FileType.File and not any(p.startswith(("_", ".")) for p in i.path.removeprefix(at).split("/"))]
        return sorted(f for f in found if f.kind in self.extensions)

    def read(self, partition: Files) -> Iterator[tuple]:
        system, _ = _opened(self.path)
        for f in partition.files:
            try:
                with system.open_input_stream(f.path) as stream:
                    parts = [(p["page"], p["text"], p["rows"]) for p in parsed(stream.read(), f.kind)]
                yield f.name, f.kind, parts, None
            except Exception as e:  # one broken file does not stop the others
                yield f.name, f.kind, [], f"{type(e).__name__}: {e}"[:500]


class DocumentReader(_Reading, DataSourceReader):
    def partitions(self) -> list[Files]:
        first: dict[str, Found] = {}
        for f in sorted(self.listed(), key=lambda f: f.path):  # one file for each name
            first.setdefault(f.name, f)
        return packed(list(first.values()), self.most) or [Files(())]


class DocumentStreamReader(_Reading, DataSourceStreamReader):
    """Offsets are the time of change and the path of the last file taken."""

    def initialOffset(self) -> dict:
        return {"changed": -1, "path": "", "taken": 0}

    def latestOffset(self) -> dict:
        settled = time.time_ns() - int(self.settle * 1e9)
        waiting = [f for f in self._after(getattr(self, "reached", None) or self.initialOffset()) if f.changed <= settled]
        taken, last = 0, None
        for f in waiting:
            if last is not None and self.limit is not None and taken + f.size > self.limit:
                break
            taken, last = taken + f.size, f
        if last is not None:
            self.reached = {"changed": last.changed, "path": last.path, "taken": taken}
        return getattr(self, "reached", None) or self.initialOffset()

    def _after(self, offset: dict) -> list[Found]:
        return [f for f in self.listed() if (f.changed, f.path) > (offset["changed"], offset["path"])]

    def partitions(self, start: dict, end: dict) -> list[Files]:
        self.reached = max((start, end), key=lambda o: (o["changed"], o["path"]))  # also after a restart
        return packed([f for f in self._after(start) if (f.changed, f.path) <= (end["changed"], end["path"])], self.most)

    def commit(self, end: dict) -> None:
        self.reached = end


class DocumentSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DocumentReader:
        return DocumentReader(dict(self.options))

    def streamReader(self, schema) -> DocumentStreamReader:
        return DocumentStreamReader(dict(self.options))


def register(spark: SparkSession) -> None:
    """Make the format known to a session."""
    spark.dataSource.register(DocumentSource)


def read_parsed(spark: SparkSession, path: str, **options: object) -> DataFrame:
    """The parsed files of a folder."""
    register(spark)
    return spark.read.format(FORMAT).options(**{k: json.dumps(v) if isinstance(v, bool) else str(v) for k, v in options.items()}).load(path)


def stream_parsed(spark: SparkSession, path: str, **options: object) -> DataFrame:
    """Files of a folder as they come, parsed."""
    register(spark)
    return spark.readStream.format(FORMAT).options(**{k: json.dumps(v) if isinstance(v, bool) else str(v) for k, v in options.items()}).load(path)
