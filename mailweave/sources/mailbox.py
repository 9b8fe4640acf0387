"""A mailbox as a data source: a folder of .eml files, read whole in a batch or by a cursor in a stream.

The cursor of a folder is its newest change: the time of change that the file system keeps for every
file and folder (not the name or the date, which senders and copiers choose), and the files of just
that time. A stream takes the mark before it lists what lies between two marks, so mail that arrives
during a walk is in the next one; the checkpoint keeps the mark, so a restart neither loses nor repeats.
Deleting mail changes its folder, so a mark never goes back. Writers move finished files into place.

The folder has to be mounted on the driver and the executors; other stores are read by
``streaming.ingest.eml_stream``.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "path string, content binary"
#: Files that a task reads.
FILES = 200


@dataclass
class Files(InputPartition):
    paths: list[str]


def _walk(folder: str) -> Iterator[tuple[int, str | None]]:
    """(time of change in nanoseconds, path below the folder) of every mail, and of every folder without a path."""
    for at, _, names in os.walk(folder):
        yield os.stat(at).st_ctime_ns, None
        for name in names:
            if name.endswith(".eml"):
                path = os.path.join(at, name)
                try:
                    yield os.stat(path).st_ctime_ns, os.path.relpath(path, folder)
                except FileNotFoundError:  # gone meanwhile
                    continue


def mark(folder: str) -> dict:
    """The cursor of everything that is there now."""
    newest, names = 0, []
    for changed, path in _walk(folder):
        if changed > newest:
            newest, names = changed, []
        if changed == newest and path is not None:
            names.append(path)
    return {"at": newest, "names": json.dumps(sorted(names))}


def between(folder: str, start: dict, end: dict) -> list[str]:
    """Mail that changed after one mark and not after another, by name."""
    seen, last = set(json.loads(start["names"])), set(json.loads(end["names"]))
    out = []
    for changed, path in _walk(folder):
        new = changed > start["at"] or changed == start["at"] and path not in seen
        if path is not None and new and (changed < end["at"] or changed == end["at"] and path in last):
            out.append(path)
    return sorted(out)


class _Reading:
    def __init__(self, options: dict[str, str]) -> None:
        if not os.path.isdir(options.get("path", "")):
            raise ValueError(f"the mailbox {options.get('path')!r} isn't a folder")
        self.folder, self.files = options["path"], max(1, int(options.get("filesPerTask", FILES)))

    def dealt(self, paths: list[str]) -> list[Files]:
        return [Files(paths[k : k + self.files]) for k in range(0, len(paths), self.files)]

    def read(self, partition: Files) -> Iterator[tuple[str, bytes]]:
        for name in partition.paths:
            path = os.path.join(self.folder, name)
            try:
                with open(path, "rb") as f:
                    yield path, f.read()
            except FileNotFoundError:  # deleted mail isn't in the mailbox any more
                continue


class MailboxReader(_Reading, DataSourceReader):
    def partitions(self) -> list[Files]:
        # a batch without mail still needs a task
        return self.dealt(sorted(p for _, p in _walk(self.folder) if p is not None)) or [Files([])]


class MailboxStreamReader(_Reading, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"at": 0, "names": "[]"}

    def latestOffset(self) -> dict:
        return mark(self.folder)

    def partitions(self, start: dict, end: dict) -> list[Files]:
        return self.dealt(between(self.folder, start, end))


class Mailbox(DataSource):
    """``spark.read.format("mailbox")`` and ``spark.readStream.format("mailbox")``; options path, filesPerTask."""

    @classmethod
    def name(cls) -> str:
        return "mailbox"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> MailboxReader:
        return MailboxReader(self.options)

    def streamReader(self, schema) -> MailboxStreamReader:
        return MailboxStreamReader(self.options)


def mailbox(spark: SparkSession, folder: str, stream: bool = False, files_per_task: int = FILES) -> DataFrame:
    """(path, content) of every mail of a folder, or of what arrives in it."""
    spark.dataSource.register(Mailbox)
    reader = spark.readStream if stream else spark.read
    return reader.format("mailbox").option("path", folder).option("filesPerTask", files_per_task).load()
