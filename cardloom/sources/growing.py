"""Client logs that still grow, as a stream: new lines, rotation to newer files, truncation.

The offset of the stream is the number of bytes of every log file that are whole lines, and a
fingerprint of the file's first bytes:

    {"player/file": {"bytes": n, "head": "…"}}

The lines between two offsets are byte ranges, so a repeated batch reads the same bytes again and a
restart goes on where the checkpoint ends.

* A line counts once its line feed is there; the last line of a file counts without one as soon
  as the player has a newer file (the game has left it).
* Rotation: all files of a player are followed, the rest of an older one and the newer one alike,
  so no line is lost between two looks at the folder.
* Truncation: a file that became shorter, or whose first bytes changed, is read anew from its start;
  its lines carry ``reset``. (A file cut and refilled beyond its old length with the same first
  ``HEAD_BYTES`` bytes looks like one that grew.)
* ``startingOffsets``: ``latest`` starts at the present end of the files, ``earliest`` reads them whole.

Log files lie in the folder (player ``local``) or in one folder per player below it. The offset holds
one entry per file, so finished logs should leave the folder in time, and ``shard`` (``i/n``) divides
the players over ``n`` queries. Paths may name any file system that pyarrow reads. Ranges above
``splitBytes`` are cut and read by several tasks.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from cardloom.sources.scan import LOG_NAME

SOURCE = "cardloom_logs"
SCHEMA = "player_id string, source_file string, line_no bigint, line string, reset boolean"
LOCAL = "local"
HEAD_BYTES = 64
SPLIT_BYTES = 32 << 20
PIECE_BYTES = 1 << 20
BATCH_LINES = 10_000

_NAME = re.compile(LOG_NAME)


def name_order(name: str) -> tuple:
    """Order of a player's logs: the time in the name, as year first."""
    month, day, year, *clock = re.split(r"[- .]", _NAME.search(name).group(1))
    return year, month, day, *clock, name


@dataclass
class Range(InputPartition):
    """Bytes ``start`` to ``end`` of a log; ``first`` is where the batch's part of the file begins."""

    player_id: str
    source_file: str
    path: str
    first: int
    start: int
    end: int
    reset: bool


class GrowingLogs(DataSource):
    @classmethod
    def name(cls) -> str:
        return SOURCE

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> GrowingLogReader:  # noqa: N802
        return GrowingLogReader(dict(self.options))


class GrowingLogReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        found = {k.lower(): v for k, v in options.items()}
        self.root = found["path"].rstrip("/")
        self.starting = found.get("startingoffsets", "latest")
        if self.starting not in ("latest", "earliest"):
            raise ValueError(f"startingOffsets: {self.starting}")
        self.split_bytes = int(found.get("splitbytes", SPLIT_BYTES))
        shard, shards = (int(x) for x in found.get("shard", "0/1").split("/"))
        if not 0 <= shard < shards:
            raise ValueError("shard is i/n with 0 <= i < n")
        self.shard, self.shards = shard, shards
        self.seen: dict[str, tuple] = {}  # what a file looked like, to read changed ones only

    def _files(self):
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(self.root) if "://" in self.root else (fs.LocalFileSystem(), self.root)
        return system, root.rstrip("/")

    def _logs(self, system, root: str) -> dict[str, list]:
        """Log files by player, oldest first."""
        from pyarrow import fs

        players: dict[str, list] = {}
        for info in system.get_file_info(fs.FileSelector(root, recursive=True)):
            place = info.path[len(root) :].strip("/").split("/")
            if info.type != fs.FileType.File or len(place) > 2 or not _NAME.search(place[-1]):
                continue
            player = place[0] if len(place) == 2 else LOCAL
            if zlib.crc32(player.encode()) % self.shards == self.shard:
                players.setdefault(player, []).append(info)
        return {p: sorted(logs, key=lambda i: name_order(i.base_name)) for p, logs in players.items()}

    @staticmethod
    def _whole_lines(source, size: int) -> int:
        """Bytes up to the last line feed."""
        end = size
        while end > 0:
            start = max(0, end - PIECE_BYTES)
            source.seek(start)
            at = source.read(end - start).rfind(b"\n")
            if at >= 0:
                return start + at + 1
            end = start
        return 0

    def _look(self, system, info, left: bool) -> dict:
        """Offset of a file; ``left``: the player has a newer one."""
        key = (info.size, info.mtime_ns, left)
        held = self.seen.get(info.path)
        if held is None or held[0] != key:
            with system.open_input_file(info.path) as source:
                size = min(info.size, source.size())
                head = source.read(min(size, HEAD_BYTES))
                whole = size if left else self._whole_lines(source, size)
            mark = f"{zlib.crc32(head):08x}" if len(head) == HEAD_BYTES else ""
            held = self.seen[info.path] = (key, {"bytes": whole, "head": mark})
        return held[1]

    def _now(self) -> dict:
        system, root = self._files()
        offset = {}
        for player, logs in self._logs(system, root).items():
            for info in logs:
                offset[f"{player}/{info.base_name}"] = self._look(system, info, info is not logs[-1])
        return dict(sorted(offset.items()))  # equal offsets must be equal texts

    def initialOffset(self) -> dict:  # noqa: N802
        return {} if self.starting == "earliest" else self._now()

    def latestOffset(self) -> dict:  # noqa: N802
        return self._now()

    def partitions(self, start: dict, end: dict) -> list[Range]:
        _, root = self._files()
        out = []
        for key, now in end.items():
            player, name = key.split("/", 1)
            old = start.get(key, {"bytes": 0, "head": ""})
            changed = bool(old["head"] and now["head"] and old["head"] != now["head"])
            reset = changed or now["bytes"] < old["bytes"]
            first = 0 if reset else old["bytes"]
            path = f"{root}/{name}" if player == LOCAL else f"{root}/{player}/{name}"
            for at in range(first, now["bytes"], self.split_bytes):
                out.append(Range(player, name, path, first, at, min(at + self.split_bytes, now["bytes"]), reset))
        return out

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        """Non-blank lines that begin in the range."""
        system, _ = self._files()
        places: list[int] = []
        lines: list[str] = []
        with system.open_input_file(partition.path) as source:
            for place, line in lines_between(source, partition.first, partition.start, partition.end):
                text = line.decode("utf-8", "replace")
                if text.strip():
                    places.append(place)
                    lines.append(text)
                if len(lines) == BATCH_LINES:
                    yield self._batch(partition, places, lines)
                    places, lines = [], []
        if lines:
            yield self._batch(partition, places, lines)

    @staticmethod
    def _batch(partition: Range, places: list[int], lines: list[str]) -> pa.RecordBatch:
        n = len(lines)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([partition.player_id] * n, pa.string()),
                pa.array([partition.source_file] * n, pa.string()),
                pa.array(places, pa.int64()),
                pa.array(lines, pa.string()),
                pa.array([partition.reset] * n, pa.bool_()),
            ],
            ["player_id", "source_file", "line_no", "line", "reset"],
        )


def lines_between(source, first: int, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(place, line) of the lines that begin at ``start`` or later and before ``end``.

    ``first`` is a place where a line begins; a range inside a longer one starts behind the first
    line feed at or after the byte before it.
    """
    at = start if start == first else start - 1
    source.seek(at)
    skip = start != first
    held = b""
    while True:
        piece = source.read(PIECE_BYTES)
        if not piece:
            if held and not skip and at < end:
                yield at, held
            return
        held += piece
        *whole, held = held.split(b"\n")
        for line in whole:
            if skip:
                skip = False
            elif at >= end:
                return
            else:
                yield at, line
            at += len(line) + 1
        if at >= end and not skip:
            return


def stream_growing_logs(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """Lines of growing logs: ``player_id``, ``source_file``, ``line_no``, ``line``, ``reset``.

    ``line_no`` is the place of the line in its file; ``reset`` marks lines of a file that is read
    anew, whose places start again. Options: ``startingOffsets``, ``shard``, ``splitBytes``.
    """
    spark.dataSource.register(GrowingLogs)
    return spark.readStream.format(SOURCE).options(path=path, **options).load()
