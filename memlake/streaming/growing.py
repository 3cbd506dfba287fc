"""Tail of files that grow: a streaming source that remembers a byte offset per file.

A batch takes what was added since the last one up to the newest whole line; a torn last line
waits for its end. A file that became shorter was replaced and is read from its start. Each
stretch of a file is an input partition, long ones several, so executors do the reading; the
driver looks at sizes and at the end of what is new only. Offsets are kept by the query's
checkpoint.
"""

from __future__ import annotations

import fnmatch
import io
import posixpath
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

STRETCH = 64 << 20
LOOK = 1 << 16


@dataclass
class Stretch(InputPartition):
    """Lines of a file that begin in [start, stop), of a stretch that begins at ``first``."""

    file: str
    first: int
    start: int
    stop: int
    end: int

    def __post_init__(self):
        super().__init__(self.file)


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class GrowingReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.glob = options["path"], options.get("glob", "*")
        self.stretch = int(options.get("stretch", STRETCH))
        self.ends: dict[str, int] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self, *limits) -> dict:
        """The place after the last whole line of every file."""
        from pyarrow import fs

        store, root = _store(self.path)
        found = {}
        for info in store.get_file_info(fs.FileSelector(root, allow_not_found=True, recursive=True)):
            if info.type == fs.FileType.File and fnmatch.fnmatch(posixpath.basename(info.path), self.glob):
                found[info.path] = self._line_end(store, info.path, info.size)
        self.ends = found
        return found

    def _line_end(self, store, file: str, size: int) -> int:
        """Looks back from the end for a newline, not beyond the place known before."""
        known = self.ends.get(file, 0)
        low = known if known <= size else 0
        with store.open_input_file(file) as f:
            at = size
            while at > low:
                begin = max(low, at - LOOK)
                f.seek(begin)
                place = f.read(at - begin).rfind(b"\n")
                if place >= 0:
                    return begin + place + 1
                at = begin
        return low

    def partitions(self, start: dict, end: dict) -> list[Stretch]:
        out = []
        for file, stop in sorted(end.items()):
            first = start.get(file, 0)
            if stop < first:
                first = 0  # shorter than before: another file under this name
            out += [Stretch(file, first, at, min(at + self.stretch, stop), stop) for at in range(first, stop, self.stretch)]
        return out

    def read(self, partition: Stretch) -> Iterator[tuple[str, str]]:
        store, _ = _store(self.path)
        name = posixpath.basename(partition.file).rsplit(".", 1)[0]
        with io.BufferedReader(store.open_input_file(partition.file), 1 << 20) as f:
            at = partition.start
            if at > partition.first:
                f.seek(at - 1)
                at += len(f.readline()) - 1  # the line before goes with its own stretch
            else:
                f.seek(at)
            while at < min(partition.stop, partition.end):
                line = f.readline()
                if not line:
                    return
                at += len(line)
                yield name, line.rstrip(b"\r\n").decode("utf-8", "replace")

    def commit(self, end: dict) -> None:
        pass


class GrowingFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "growing_files"

    def schema(self) -> str:
        return "conversation_id string, line string"

    def streamReader(self, schema) -> GrowingReader:
        return GrowingReader(dict(self.options))


def tail_growing(spark: SparkSession, path: str, glob: str = "*.jsonl", stretch: int = STRETCH) -> DataFrame:
    """(conversation_id, line): whole lines added to the files under a folder, whatever file
    and run they were added in. The id is the file's name."""
    spark.dataSource.register(GrowingFiles)
    return spark.readStream.format("growing_files").option("path", path).option("glob", glob).option("stretch", stretch).load()
