"""Fact files as a data source: ``spark.read.format("facts").load(root)``, batch and stream, and the sink that writes them.

Files are planned into partitions of about ``bytes`` bytes, whole files each, so a
task's share does not follow their number.  Filters on ``uri`` (equal, in, starts with)
are taken over by the source: with the option ``layout`` set to ``uri`` a file is named
after its one document, and files of other documents are not opened; in any layout
other documents are dropped before they become rows.  A file that cannot be decoded is a row
with its error, whatever the filter, and the others go on.

The stream reads files by their time of change: a batch has those changed since the last
one, and those younger than ``settle`` seconds wait, so that none with an equal
time is missed.  The sink writes one file for each task, or one for each document with ``layout``
``uri``, beside the place and renames them when all tasks have ended.

Paths are local or a uri that Arrow's file systems open; other stores are read by
``facts.read_facts``.  Pushing filters needs ``spark.sql.python.filterPushdown.enabled``, which ``register`` sets.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition, StringStartsWith, WriterCommitMessage
from pyspark.sql.types import StructType

from plumbline.sources import facts

SUFFIX, BYTES, ROWS = ".semanticdb", 8 << 20, 256


def _place(options: dict) -> tuple[fs.FileSystem, str]:
    path = options["path"]
    return fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)


def listed(files: fs.FileSystem, root: str) -> list[fs.FileInfo]:
    """Fact files below a root, sorted by path; none if there is no such folder. Names that begin with a dot are not finished."""
    found = files.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
    return sorted((x for x in found if x.type == fs.FileType.File and x.path.endswith(SUFFIX) and not x.base_name.startswith(".")), key=lambda x: x.path)


@dataclass
class Files(InputPartition):
    paths: list[str]


def planned(found: list[fs.FileInfo], size: int) -> list[Files]:
    """Whole files in partitions of about ``size`` bytes."""
    parts: list[Files] = []
    held = size
    for x in found:
        if held >= size:
            parts.append(Files([]))
            held = 0
        parts[-1].paths.append(x.path)
        held += max(1, x.size or 0)
    return parts


class Wanted:
    """Filters on the uri: those it takes over, and whether a uri passes them all."""

    def __init__(self) -> None:
        self.taken: list[tuple[str, object]] = []

    def take(self, f: Filter) -> bool:
        if getattr(f, "attribute", None) != ("uri",):
            return False
        if isinstance(f, EqualTo) and f.value is not None:
            self.taken.append(("in", frozenset([f.value])))
        elif isinstance(f, In):
            self.taken.append(("in", frozenset(f.value)))
        elif isinstance(f, StringStartsWith):
            self.taken.append(("start", f.value))
        else:
            return False
        return True

    def __call__(self, uri: str) -> bool:
        return all(uri in x if kind == "in" else uri.startswith(x) for kind, x in self.taken)


def _read(files: fs.FileSystem, paths: list[str], wanted: Callable[[str], bool], errors: bool) -> Iterator[pa.RecordBatch]:
    rows: list[dict] = []
    for path in paths:
        with files.open_input_stream(path) as f:
            found = facts.rows_of(path, f.read(), wanted)
        rows += found if errors else [r for r in found if r["error"] is None]
        if len(rows) >= ROWS:
            yield facts.batch_of(rows)
            rows = []
    yield facts.batch_of(rows)


class FactReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options, self.wanted = dict(options), Wanted()

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        # A pushed filter on the uri also drops the rows with errors, whose uri is null.
        return iter([f for f in filters if not self.wanted.take(f)])

    def partitions(self) -> list[Files]:
        files, root = _place(self.options)
        found = listed(files, root)
        if self.options.get("layout") == "uri":
            top = len(root.rstrip("/")) + 1
            found = [x for x in found if self.wanted(x.path[top : -len(SUFFIX)])]
        return planned(found, int(self.options.get("bytes", BYTES)))

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        return _read(_place(self.options)[0], partition.paths if partition else [], self.wanted, not self.wanted.taken)


class FactStreamReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.options = dict(options)

    def initialOffset(self) -> dict:
        return {"changed": 0}

    def latestOffset(self) -> dict:
        files, root = _place(self.options)
        before = time.time_ns() - int(float(self.options.get("settle", 1)) * 1e9)
        return {"changed": max([0, *(x.mtime_ns for x in listed(files, root) if x.mtime_ns <= before)])}

    def partitions(self, start: dict, end: dict) -> list[Files]:
        files, root = _place(self.options)
        new = [x for x in listed(files, root) if start["changed"] < x.mtime_ns <= end["changed"]]
        return planned(new, int(self.options.get("bytes", BYTES)))

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        return _read(_place(self.options)[0], partition.paths if partition else [], lambda _: True, True)


@dataclass
class Written(WriterCommitMessage):
    names: list[tuple[str, str]]


class FactWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.options, self.overwrite, self.old = dict(options), overwrite, []
        if overwrite:
            files, root = _place(self.options)
            self.old = [x.path for x in listed(files, root)]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, root = _place(self.options)
        files.create_dir(root, recursive=True)
        names: list[tuple[str, str]] = []

        def put(docs: list[bytes], name: str) -> None:
            folder, _, last = f"{root}/{name}{SUFFIX}".rpartition("/")
            files.create_dir(folder, recursive=True)
            with files.open_output_stream(f"{folder}/.{last}") as f:
                f.writelines(docs)
            names.append((f"{folder}/.{last}", f"{folder}/{last}"))

        for batch in iterator:
            docs = facts.messages(batch)
            if self.options.get("layout") == "uri":
                for d, uri in zip(docs, batch.column("uri").to_pylist()):
                    if not uri or uri.startswith("/") or ".." in uri.split("/"):
                        raise ValueError(f"{uri!r} leads out of the folder")
                    put([d], uri)
            elif docs:
                put(docs, f"part-{uuid.uuid4().hex}")
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        files, _ = _place(self.options)
        for path in self.old:
            files.delete_file(path)
        for m in messages:
            for hidden, name in m.names if m else ():
                files.move(hidden, name)

    def abort(self, messages: list[Written | None]) -> None:
        files, _ = _place(self.options)
        for m in messages:
            for hidden, _ in m.names if m else ():
                files.delete_file(hidden)


class FactSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "facts"

    def schema(self) -> str:
        return facts.SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return FactReader(self.options)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return FactStreamReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return FactWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    """Makes the format ``facts`` known to a session, with filters pushed down."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FactSource)
