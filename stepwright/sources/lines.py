"""Text lines with their numbers, from large files and from members of archives, as Spark data sources.

``numbered_lines`` cuts each file into splits of bytes. A first pass counts the line
ends of each split, a running sum says how many lines lie before it, and the second
pass gives each line its number; no file is read by one task unless it is one split.

``archive_rows`` reads the members of zip archives, or the files of folders, without
unpacking: the driver sees the central directory only, a task reads one member and
digests it in the same read. A member's last row has no line but its digest and size.

Lines end with a line feed, and a carriage return before it is no part of the line.
"""

from __future__ import annotations

import hashlib
import os
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.window import Window

SPLIT_BYTES, CHUNK = 64 << 20, 1 << 20


def file_system(uri: str):
    """(file system, path) of a folder or file, for any task."""
    from pyarrow import fs

    if "://" in uri and not uri.startswith("file:"):
        return fs.FileSystem.from_uri(uri)
    return fs.LocalFileSystem(), os.path.abspath("/" + uri.removeprefix("file:").lstrip("/") if uri.startswith("file:") else uri)


def files_below(uri: str) -> list[tuple[str, str, int]]:
    """(name below the folder, path, size) of a file, or of the files of a folder whose names begin with no '_' or '.'."""
    from pyarrow import fs

    store, base = file_system(uri)
    info = store.get_file_info(base)
    if info.type == fs.FileType.File:
        return [(info.base_name, base, info.size)]
    found = store.get_file_info(fs.FileSelector(base, recursive=True)) if info.type == fs.FileType.Directory else []
    names = [(i.path[len(base) :].lstrip("/"), i.path, i.size) for i in found if i.type == fs.FileType.File]
    if not names and info.type != fs.FileType.Directory:
        raise FileNotFoundError(uri)
    return sorted(x for x in names if not any(part[0] in "_." for part in x[0].split("/")))


def _lines(stream, at: int = 0) -> Iterator[tuple[int, bytes]]:
    """(offset, line without its end) of a stream that is now at offset ``at``, a chunk at a time."""
    rest, start = [], at
    while chunk := stream.read(CHUNK):
        *whole, last = chunk.split(b"\n")
        for part in whole:
            line = b"".join([*rest, part])
            rest = []
            yield start, line.removesuffix(b"\r")
            start += len(line) + 1
        rest.append(last)
    if any(rest):
        yield start, b"".join(rest).removesuffix(b"\r")


@dataclass
class Split(InputPartition):
    """Bytes [start, stop) of a file; lines that begin there belong to it."""

    uri: str
    name: str
    path: str
    start: int
    stop: int


class _LineReader(DataSourceReader):
    def __init__(self, uri: str, size: int, count: bool):
        self.uri, self.size, self.count = uri, size, count

    def partitions(self):
        return [Split(self.uri, name, path, at, min(n, at + self.size)) for name, path, n in files_below(self.uri) for at in range(0, n, self.size)]

    def read(self, split: Split):
        store, _ = file_system(self.uri)
        with store.open_input_file(split.path) as f:
            if self.count:
                f.seek(split.start)
                left, n = split.stop - split.start, 0
                while left and (chunk := f.read(min(CHUNK, left))):
                    n, left = n + chunk.count(b"\n"), left - len(chunk)
                yield split.name, split.start, n, None
                return
            begin = max(0, split.start - 1)
            f.seek(begin)
            lines, number = _lines(f, begin), None
            if split.start:
                next(lines, None)  # it began in a split before, or is the line end just before this one
            for at, line in lines:
                if at >= split.stop:
                    return
                if number is None:
                    number = int(at > split.start)  # a line from before has its end in this split
                yield split.name, split.start, number, line.decode("utf-8", "replace")
                number += 1


class NumberedLines(DataSource):
    """file, split, n (line ends of the split before the line) and value; with ``count`` a row a split with its line ends as n."""

    @classmethod
    def name(cls):
        return "stepwright_lines"

    def schema(self):
        return "file string, split long, n long, value string"

    def reader(self, schema):
        return _LineReader(self.options["path"], int(self.options.get("splitbytes", self.options.get("splitBytes", SPLIT_BYTES))), self.options.get("count", "false") == "true")


def numbered_lines(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """file, line (from 1) and value of each line of a file or of the files of a folder."""
    spark.dataSource.register(NumberedLines)
    source = spark.read.format(NumberedLines.name()).option("splitBytes", split_bytes)
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    ends = source.option("count", "true").load(path).select("file", "split", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_ends"))
    lines = source.option("count", "false").load(path).join(ends, ["file", "split"])
    return lines.select("file", (F.col("_ends") + F.col("n") + 1).alias("line"), "value")


@dataclass
class Member(InputPartition):
    """A member of a zip archive, or a file of a folder (then without archive path)."""

    uri: str
    archive: str
    zip_path: str
    name: str
    path: str


class _MemberReader(DataSourceReader):
    def __init__(self, uri: str):
        self.uri = uri

    def partitions(self):
        store, base = file_system(self.uri)
        found, files = [], files_below(self.uri)
        for name, path, _ in files:
            if not path.endswith(".zip"):
                found.append(Member(self.uri, os.path.basename(base.rstrip("/")), "", name, path))
                continue
            with store.open_input_file(path) as f, zipfile.ZipFile(f) as z:
                for i in z.infolist():
                    if i.filename.startswith("/") or ".." in i.filename.split("/"):
                        raise ValueError(f"{i.filename} would be written outside the target folder")
                    if not i.is_dir():
                        found.append(Member(self.uri, os.path.basename(path), path, i.filename, ""))
        return found

    def read(self, m: Member):
        store, _ = file_system(self.uri)
        with store.open_input_file(m.zip_path or m.path) as f:
            if not m.zip_path:
                yield from self._rows(m, f)
                return
            with zipfile.ZipFile(f) as z, z.open(m.name) as inner:
                yield from self._rows(m, inner)

    def _rows(self, m: Member, stream):
        seen = _Digested(stream)
        for number, (_, line) in enumerate(_lines(seen), 1):
            yield m.archive, m.name, number, line.decode("utf-8", "replace"), None, None
        yield m.archive, m.name, None, None, seen.sha.hexdigest(), seen.size


class _Digested:
    """A stream that digests what is read from it."""

    def __init__(self, stream):
        self.stream, self.sha, self.size = stream, hashlib.sha256(), 0

    def read(self, n: int) -> bytes:
        chunk = self.stream.read(n)
        self.sha.update(chunk)
        self.size += len(chunk)
        return chunk


class ArchiveRows(DataSource):
    """archive, member, line, value of each line of each member, then sha256 and bytes of the member."""

    @classmethod
    def name(cls):
        return "stepwright_archive"

    def schema(self):
        return "archive string, member string, line long, value string, sha256 string, bytes long"

    def reader(self, schema):
        return _MemberReader(self.options["path"])


def archive_rows(spark: SparkSession, path: str) -> DataFrame:
    """The lines and digests of a zip, of all zips of a folder, or of the files of a folder; a task a member."""
    spark.dataSource.register(ArchiveRows)
    return spark.read.format(ArchiveRows.name()).load(path)
