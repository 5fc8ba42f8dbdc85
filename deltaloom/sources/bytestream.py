"""A byte stream as a Python data source: images of a folder, pulled in bounded pieces.

    spark.dataSource.register(ByteStreamSource)
    spark.readStream.format("bytestream").option("path", folder).option("piece", 4096).load()

Rows are (name, start, data, last). Each read returns one piece of each file at most, which bounds
what a micro-batch holds; offsets are the bytes read so far, so a restart goes on where it was.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

SCHEMA = "name string, start long, data binary, last boolean"


def _files(options: dict) -> list[str]:
    folder = options["path"]
    return sorted(f"{folder}/{f}" for f in os.listdir(folder) if not f.startswith((".", "_")))


class FilePart(InputPartition):
    def __init__(self, path: str):
        self.path = path


class WholeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[FilePart]:
        return [FilePart(p) for p in _files(self.options)]

    def read(self, partition: FilePart) -> Iterator[tuple]:
        piece, size, at = int(self.options.get("piece", 4096)), os.path.getsize(partition.path), 0
        with open(partition.path, "rb") as f:
            while at < size:
                data = f.read(piece)
                yield os.path.basename(partition.path), at, data, at + len(data) >= size
                at += len(data)


class PulledReader(SimpleDataSourceStreamReader):
    def __init__(self, options: dict):
        self.options = options

    def initialOffset(self) -> dict:
        return {"at": "{}"}

    def _pull(self, start: dict, end: dict | None) -> tuple[list[tuple], dict]:
        piece = int(self.options.get("piece", 4096))
        at, stop = json.loads(start["at"]), json.loads(end["at"]) if end else None
        rows = []
        for path in _files(self.options):
            name = os.path.basename(path)
            a, size = at.get(name, 0), os.path.getsize(path)
            b = min(a + piece, size) if stop is None else stop.get(name, a)
            if b > a:
                with open(path, "rb") as f:
                    f.seek(a)
                    rows.append((name, a, f.read(b - a), b >= size))
                at[name] = b
        return rows, {"at": json.dumps(at)}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows, end = self._pull(start, None)
        return iter(rows), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter(self._pull(start, end)[0])


class ByteStreamSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "bytestream"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WholeReader:
        return WholeReader(self.options)

    def simpleStreamReader(self, schema) -> PulledReader:
        return PulledReader(self.options)
