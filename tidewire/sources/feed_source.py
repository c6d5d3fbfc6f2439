"""Feeds as a data source: spark.read or readStream.format("feeds") over a folder of feed files.

Options: path (a folder that driver and executors reach), most (files in a batch, default 100).  A row for each file:
source_name (its name without the ending), modified (seconds), xml, error.  A file that can't be read or decoded is a
row with an error, and costs the others nothing.  What fetches a file's bytes is pluggable: FETCH[name] with the option
fetch; "file" opens a local or mounted path.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

ROW = "source_name string, modified bigint, xml string, error string"


def from_file(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


FETCH: dict[str, Callable[[str], bytes]] = {"file": from_file}


class Files(InputPartition):
    def __init__(self, found: list[tuple[int, str]]):
        super().__init__(None)
        self.found = found


class _Feeds:
    def __init__(self, options: dict):
        self.path, self.most, self.fetch = options["path"], int(options.get("most", 100)), options.get("fetch", "file")
        self.width = 16  # files in a task

    def listed(self) -> list[tuple[int, str]]:
        """(time of change, name) of all files, oldest first."""
        with os.scandir(self.path) as found:
            return sorted((int(f.stat().st_mtime_ns // 1000), f.name) for f in found if f.is_file() and not f.name.startswith((".", "_")))

    def dealt(self, found: list[tuple[int, str]]) -> list[Files]:
        return [Files(found[i:i + self.width]) for i in range(0, len(found), self.width)]

    def read(self, partition: Files) -> Iterator[tuple]:
        for at, name in partition.found:
            try:
                text, error = FETCH[self.fetch](os.path.join(self.path, name)).decode("utf-8"), None
            except Exception as e:  # any fetch's failure is the row's
                text, error = None, f"{type(e).__name__}: {e}"[:500]
            yield name.rsplit(".", 1)[0], at // 1_000_000, text, error


class FeedReader(_Feeds, DataSourceReader):
    def partitions(self) -> list[Files]:
        return self.dealt(self.listed())


class FeedStreamReader(_Feeds, DataSourceStreamReader):
    """Offsets are the last file's (time of change, name): a restart goes on behind it."""

    def initialOffset(self) -> dict:
        return {"at": 0, "name": ""}

    def latestOffset(self) -> dict:
        at, name = getattr(self, "reached", (0, ""))
        later = [f for f in self.listed() if f > (at, name)][: self.most]
        self.reached = later[-1] if later else (at, name)
        return {"at": self.reached[0], "name": self.reached[1]}

    def partitions(self, start: dict, end: dict) -> list[Files]:
        self.reached = max(getattr(self, "reached", (0, "")), (end["at"], end["name"]))
        return self.dealt([f for f in self.listed() if (start["at"], start["name"]) < f <= (end["at"], end["name"])])

    def commit(self, end: dict) -> None:
        pass


class FeedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "feeds"

    def schema(self) -> str:
        return ROW

    def reader(self, schema) -> FeedReader:
        return FeedReader(self.options)

    def streamReader(self, schema) -> FeedStreamReader:
        return FeedStreamReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FeedSource)
