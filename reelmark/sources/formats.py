"""Files of lines as data sources: `spark.read.format("hash_manifest").load(folder)`, `df.write.format("section_list").mode("append").save(folder)`.

A file is split among tasks by ranges of bytes, a line belonging to the range in which it begins. A writer's tasks write aside, into a folder
that readers skip; only when all have ended are their files moved in, so what failed leaves nothing behind. Stores are those that PyArrow
opens by their URI, which executors must reach as well; where only Spark reaches one, storage.text_lines() reads the same files.
"""

from __future__ import annotations

import posixpath
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs as fs
from pyspark.sql import Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

#: Bytes of a file that a task reads.
RANGE_BYTES = 64 << 20
_ASIDE = "_aside-"


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    found, inner = fs.FileSystem.from_uri(path if re.match("[a-z0-9+]+:", path) else "file://" + path)
    return found, inner.rstrip("/")


@dataclass
class Range(InputPartition):
    path: str
    start: int
    stop: int


@dataclass
class Written(WriterCommitMessage):
    name: str


class LineReader(DataSourceReader):
    def __init__(self, source: LineSource) -> None:
        self.source = source

    def partitions(self) -> list[Range]:
        store, folder = _opened(self.source.options["path"])
        found = store.get_file_info(folder)
        files = [found] if found.is_file else store.get_file_info(fs.FileSelector(folder))
        size = int(self.source.options.get("rangebytes", RANGE_BYTES))
        whole = [f for f in sorted(files, key=lambda f: f.path) if f.is_file and not f.base_name.startswith(("_", "."))]
        return [Range(f.path, at, min(at + size, f.size)) for f in whole for at in range(0, f.size, size)]

    def read(self, part: Range) -> Iterator[tuple]:
        store, _ = _opened(self.source.options["path"])
        name = posixpath.basename(part.path)
        with store.open_input_file(part.path) as file:
            # The line that the byte before belongs to is the range's before.
            at = max(0, part.start - 1)
            file.seek(at)
            held, first = b"", part.start > 0
            while True:
                block = file.read(1 << 20)
                lines = (held + block).split(b"\n")
                held = lines.pop() if block else b""
                for line in lines:
                    start, at = at, at + len(line) + 1
                    if first:
                        first = False
                        continue
                    if start >= part.stop:
                        return
                    if line or block:
                        yield (name, start, *self.source.parsed(line.rstrip(b"\r").decode("utf-8", "replace")))
                if not block:
                    return


class LineWriter(DataSourceWriter):
    def __init__(self, source: LineSource, overwrite: bool) -> None:
        self.source, self.overwrite, self.aside = source, overwrite, _ASIDE + uuid.uuid4().hex

    def write(self, rows: Iterator[Row]) -> Written:
        store, folder = _opened(self.source.options["path"])
        name, out = "", None
        for row in rows:
            if out is None:  # a task without rows leaves no file
                name = f"part-{uuid.uuid4().hex}.txt"
                store.create_dir(f"{folder}/{self.aside}", recursive=True)
                out = store.open_output_stream(f"{folder}/{self.aside}/{name}")
            out.write((self.source.rendered(row) + "\n").encode())
        if out is not None:
            out.close()
        return Written(name)

    def commit(self, messages: list[Written | None]) -> None:
        store, folder = _opened(self.source.options["path"])
        store.create_dir(folder, recursive=True)
        old = [f.path for f in store.get_file_info(fs.FileSelector(folder)) if f.is_file and not f.base_name.startswith(("_", "."))] if self.overwrite else []
        for message in messages:
            if message is not None and message.name:
                store.move(f"{folder}/{self.aside}/{message.name}", f"{folder}/{message.name}")
        for path in old:
            store.delete_file(path)
        self._clear(store, folder)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*_opened(self.source.options["path"]))

    def _clear(self, store: fs.FileSystem, folder: str) -> None:
        if store.get_file_info(f"{folder}/{self.aside}").type == fs.FileType.Directory:
            store.delete_dir(f"{folder}/{self.aside}")


class LineSource(DataSource):
    """A line's fields behind the name of its file and the place at which it begins there."""

    fields = ""

    @classmethod
    def name(cls) -> str:
        raise NotImplementedError

    def schema(self) -> str:
        return f"file string, place long, {self.fields}"

    def reader(self, schema: StructType) -> LineReader:
        return LineReader(self)

    def writer(self, schema: StructType, overwrite: bool) -> LineWriter:
        return LineWriter(self, overwrite)

    def parsed(self, line: str) -> tuple:
        raise NotImplementedError

    def rendered(self, row: Row) -> str:
        raise NotImplementedError


class HashManifest(LineSource):
    """Lines of 128 hexadecimal digits, two blanks and a name. A line that isn't one has no digest, and its text as name."""

    fields = "name string, digest string"

    @classmethod
    def name(cls) -> str:
        return "hash_manifest"

    def parsed(self, line: str) -> tuple:
        whole = re.fullmatch("([0-9A-Fa-f]{128})  (.+)", line)
        return (whole[2], whole[1].lower()) if whole else (line, None)

    def rendered(self, row: Row) -> str:
        return f"{row['digest']}  {row['name']}"


class SectionList(LineSource):
    """Lines of a frame, S or E, a number, a word, and the frames from which and up to which the change lies; other lines have nulls."""

    fields = "best long, is_start boolean, start long, end long"

    @classmethod
    def name(cls) -> str:
        return "section_list"

    def parsed(self, line: str) -> tuple:
        found = re.match(r"\s*(\d+)\s+(\S)\s+(\d+)\s+(\S+)\s+(\d+)\s+(\d+)", line)
        return (int(found[1]), found[2].lower() == "s", int(found[5]), int(found[6])) if found else (None,) * 4

    def rendered(self, row: Row) -> str:
        return f"{row['best']:>6} {'S' if row['is_start'] else 'E'} 0 ALL {row['start']:>6} {row['end']:>6}"


def register(spark: SparkSession) -> None:
    for source in (HashManifest, SectionList):
        spark.dataSource.register(source)
