"""JSON lines as a data source of Spark: ``spark.read.format("jsonrecords")``.

A file is cut into ranges of bytes, each a partition, and a range holds the lines that begin in it, so that many files, and
parts of a large one, are read at once. Each row is an object: ``ord`` (number of the file, then the byte at which the line
begins, so that it keeps the order of files and lines), ``file``, ``record`` (the line). A line that isn't JSON, or no object,
stops the read and is named by file and line number; the number is counted only then. With the option ``skip_invalid``,
such lines are left out; blank lines are left out always. An empty file or folder has no rows; a missing path is an error.

Paths are files, folders (files whose names begin with a dot or an underscore are left out), local or with a scheme that
Arrow's file systems know.
"""

from __future__ import annotations

import json

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

NAME = "jsonrecords"
SCHEMA = "ord long, file string, record string"
#: Bytes of a range, and of one piece of a file that is held at a time.
RANGE, PIECE = 64 << 20, 1 << 20
ROWS = 2_000
#: Bits of ``ord`` for the place in a file.
_PLACE = 42


class BadLine(ValueError):
    pass


class Range(InputPartition):
    def __init__(self, number: int, path: str, start: int, end: int):
        self.number, self.path, self.start, self.end = number, path, start, end


def filesystem(path: str):
    """(file system, path in it)."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def files_of(path: str) -> list[tuple[str, int]]:
    """(path, size) of the file, or of the files in the folder, sorted."""
    from pyarrow import fs

    store, inner = filesystem(path)
    info = store.get_file_info(inner)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(f"no such file or folder: {path}")
    found = [info] if info.type == fs.FileType.File else [x for x in store.get_file_info(fs.FileSelector(inner)) if x.type == fs.FileType.File and x.base_name[0] not in "._"]
    scheme = path[: path.index("://") + 3] if "://" in path else ""
    return sorted((scheme + x.path, x.size) for x in found)


def lines_of(stream, start: int, end: int):
    """(place, line) of lines that begin in [start, end); a line may be longer than a piece."""
    if start:
        stream.seek(start - 1)
        skipping, place = True, start - 1
    else:
        skipping, place = False, 0
    held: list[bytes] = []
    begins = place
    while True:
        piece = stream.read(PIECE)
        if not piece:
            break
        at = 0
        while (stop := piece.find(b"\n", at)) >= 0:
            if not skipping:
                if begins >= end:
                    return
                yield begins, b"".join([*held, piece[at:stop]])
            skipping, held, at = False, [], stop + 1
            begins = place + at
        if begins >= end and not skipping:
            return
        if not skipping:
            held.append(piece[at:])
        place += len(piece)
    if not skipping and begins < end and any(held):
        yield begins, b"".join(held)


def fault_of(line: bytes) -> str | None:
    """Why a line is no record, or null."""
    try:
        value = json.loads(line)
    except (ValueError, RecursionError):
        return "not JSON"
    return None if isinstance(value, dict) else "not an object"


class Reader(DataSourceReader):
    def __init__(self, path: str, size: int, skip: bool):
        self.path, self.size, self.skip = path, size, skip

    def partitions(self) -> list[Range]:
        ranges = []
        for number, (path, size) in enumerate(files_of(self.path)):
            ranges += [Range(number, path, a, min(a + self.size, size)) for a in range(0, size, self.size)]
        return ranges or [Range(0, "", 0, 0)]

    def read(self, partition: Range):
        import pyarrow as pa

        def batch(rows):
            ords, records = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(ords, pa.int64()), pa.array([partition.path] * len(rows), pa.string()), pa.array(records, pa.string())], names=["ord", "file", "record"])

        if not partition.path:
            return
        store, inner = filesystem(partition.path)
        rows = []
        with store.open_input_file(inner) as stream:
            for place, line in lines_of(stream, partition.start, partition.end):
                line = line.strip(b" \t\r\n\v\f")
                if not place:
                    line = line.removeprefix(b"\xef\xbb\xbf")
                if not line:
                    continue
                fault = fault_of(line)
                if fault and self.skip:
                    continue
                if fault:
                    raise BadLine(f"{partition.path}:{self.number(stream, place)}: {fault}, so not a JSON object: {line[:80].decode('utf-8', 'replace')}")
                rows.append((partition.number << _PLACE | place, line.decode("utf-8")))
                if len(rows) >= ROWS:
                    yield batch(rows)
                    rows = []
        if rows:
            yield batch(rows)

    @staticmethod
    def number(stream, place: int) -> int:
        """Number of the line that begins at ``place``."""
        stream.seek(0)
        number, left = 1, place
        while left and (piece := stream.read(min(left, PIECE))):
            number, left = number + piece.count(b"\n"), left - len(piece)
        return number


class JsonRecords(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        path = self.options.get("path")
        if not path:
            raise ValueError("jsonrecords needs a path")
        return Reader(path, max(1, int(self.options.get("range_bytes", RANGE))), self.options.get("skip_invalid", "false").lower() == "true")


def register(spark: SparkSession) -> None:
    spark.dataSource.register(JsonRecords)
