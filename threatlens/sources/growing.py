"""Growing text files as a stream: every complete line once, from the end or the beginning.

An offset is a byte and a file identity per file.  A batch reads up to the last
line end present, so half a line is kept back until it is complete.  A file that
has another identity than before was rotated: what the old one still held is read
where it was moved to in its folder, and the new one from its beginning.  A file
that is now shorter was emptied and is read from its beginning.  Large additions
are cut into byte ranges that tasks read side by side; a line belongs to the range
it begins in.  Files must lie on a file system that all executors mount.
"""

from __future__ import annotations

import glob
import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

_BLOCK = 1 << 16
SPLIT_BYTES = 64 << 20


def mounted(path: str) -> str:
    """A path or a ``file:`` URI as a mounted path."""
    if path.startswith("file:"):
        return "/" + path[5:].lstrip("/")
    if "://" in path:
        raise ValueError(f"growing files need a mounted path, not {path}")
    return path


class _Range(InputPartition):
    """Lines that begin in [low, high) of a file; ``first`` is where the whole addition begins."""

    def __init__(self, path: str, inode: int, first: int, low: int, high: int) -> None:
        self.path, self.inode, self.first, self.low, self.high = path, inode, first, low, high


def line_end(path: str, size: int) -> int:
    """The byte after the last line end before ``size``."""
    with open(path, "rb") as file:
        at = size
        while at > 0:
            low = max(0, at - _BLOCK)
            file.seek(low)
            found = file.read(at - low).rfind(b"\n")
            if found >= 0:
                return low + found + 1
            at = low
    return 0


def _present(path: str) -> tuple[int, int] | None:
    """Identity and size of a file; None if there is none."""
    try:
        found = os.stat(path)
    except FileNotFoundError:
        return None
    return found.st_ino, found.st_size


def _moved(path: str, inode: int) -> str | None:
    """Where in its folder a file with this identity lies now."""
    folder = os.path.dirname(path) or "."
    for entry in os.scandir(folder):
        if entry.is_file() and entry.inode() == inode:
            return entry.path
    return None


class _Reader(DataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        self.pattern = mounted(options["path"])
        self.at_end = options.get("start", "end") == "end"
        self.split = int(options.get("splitbytes", SPLIT_BYTES))

    def _ends(self) -> dict[str, list[int]]:
        out = {}
        for path in sorted(glob.glob(self.pattern)):
            found = _present(path)
            if found:
                out[path] = [found[0], line_end(path, found[1])]
        return out

    def initialOffset(self) -> dict:
        ends = self._ends()
        return ends if self.at_end else {path: [inode, 0] for path, (inode, _) in ends.items()}

    def latestOffset(self) -> dict:
        return self._ends()

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        out: list[InputPartition] = []
        for path, (inode, high) in end.items():
            before = start.get(path)
            low = 0
            if before is not None and before[0] == inode:
                low = before[1] if before[1] <= high else 0
            elif before is not None and (old := _moved(path, before[0])) is not None:
                out += self._ranges(old, before[0], before[1], os.stat(old).st_size)
            out += self._ranges(path, inode, low, high)
        return out

    def _ranges(self, path: str, inode: int, low: int, high: int) -> list[InputPartition]:
        return [_Range(path, inode, low, at, min(at + self.split, high)) for at in range(low, high, self.split)]

    def read(self, partition: InputPartition) -> Iterator[tuple[str, str, int]]:
        r = partition
        found = _present(r.path)
        path = r.path if found and found[0] == r.inode else _moved(r.path, r.inode)
        if path is None:
            raise FileNotFoundError(f"{r.path}: the file read before is gone")
        with open(path, "rb") as file:
            at = r.low
            if at > r.first:                # a line that began before belongs to the range before
                file.seek(at - 1)
                at += len(file.readline()) - 1
            else:
                file.seek(at)
            while at < r.high:
                line = file.readline()
                if not line:
                    return
                yield line.rstrip(b"\r\n").decode("utf-8", "replace"), r.path, at
                at += len(line)

    def commit(self, end: dict) -> None:
        pass


class GrowingLines(DataSource):
    """The stream source ``growing_lines``: value, file, byte."""

    @classmethod
    def name(cls) -> str:
        return "growing_lines"

    def schema(self) -> str:
        return "value string, file string, byte bigint"

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _Reader(self.options)


def follow(spark: SparkSession, path: str, start: str = "end", split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """New lines of the files that match ``path``, with their place as arrival order.

    ``start`` "end" leaves out what is there at the first start; "beginning" reads it.
    """
    spark.dataSource.register(GrowingLines)
    lines = (spark.readStream.format("growing_lines").option("start", start).option("splitbytes", str(split_bytes))
             .option("path", path).load())
    return lines.select("value", F.struct(F.col("file").alias("part"), F.col("byte").alias("pos")).alias("seq"))
