"""A file that grows, rests, is rotated and is emptied, followed over restarts."""

import os
import random

import pytest

from threatlens.sources import growing
from threatlens.streaming import tail


class Tail:
    """Drains a followed path again and again from one checkpoint."""

    def __init__(self, spark, tmp_path, start="end", split=1 << 20):
        self.spark, self.tmp, self.start, self.split = spark, tmp_path, start, split
        self.path = str(tmp_path / "app.log")

    def append(self, data):
        with open(self.path, "ab") as file:
            file.write(data)

    def lines(self):
        stream = growing.follow(self.spark, self.path, self.start, self.split)
        table = tail.drain(stream, str(self.tmp / "out"), str(self.tmp / "cp"))
        return [r.value for r in table.orderBy("seq.part", "seq.pos").collect()], table


@pytest.fixture
def follower(spark, tmp_path):
    return Tail(spark, tmp_path)


def test_only_complete_new_lines(follower):
    follower.append(b"old 1\nold 2\nhalf")
    assert follower.lines()[0] == []
    follower.append(b" done\nnew 1\nne")
    assert follower.lines()[0] == ["half done", "new 1"]
    assert follower.lines()[0] == ["half done", "new 1"]
    follower.append("w 2 é\r\nbad \n".encode() + b"\xff\n")
    assert follower.lines()[0] == ["half done", "new 1", "new 2 é", "bad ", "�"]


def test_rotated_and_emptied(follower):
    follower.append(b"a\n")
    follower.lines()
    follower.append(b"b\nc")
    assert sorted(follower.lines()[0]) == ["b"]
    follower.append(b"c\nlast")                                  # written, then rotated before the next look
    os.rename(follower.path, follower.path + ".1")
    follower.append(b"d\ne\n")
    assert sorted(follower.lines()[0]) == ["b", "cc", "d", "e", "last"]
    with open(follower.path, "wb"):
        pass
    follower.append(b"f\n")
    assert sorted(follower.lines()[0]) == ["b", "cc", "d", "e", "f", "last"]


@pytest.mark.parametrize("split", [7, 50, 1 << 20])
def test_ranges_read_every_line_once(spark, tmp_path, split):
    draw = random.Random(split)
    follower, lines = Tail(spark, tmp_path, "beginning", split), []
    for _ in range(2):
        more = [f"{len(lines) + i} " + "x" * draw.randrange(40) for i in range(60)]
        lines += more
        data = ("\n".join(more) + "\n").encode()
        cut = draw.randrange(len(data))
        follower.append(data[:cut])
        follower.lines()
        follower.append(data[cut:])
        found, table = follower.lines()
        assert found == lines
    assert table.select("seq").distinct().count() == len(lines)


def test_paths():
    assert growing.mounted("file:///a/b") == growing.mounted("/a/b") == "/a/b"
    with pytest.raises(ValueError):
        growing.mounted("hdfs://x/y")
