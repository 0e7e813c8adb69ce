"""Messages of a stream of log lines: the block that a batch leaves open is kept as state.

Lines are those of ``sources.growing``. The state of a key holds the text and the brace depth of its
open block, and where its numbering stands, so a block may be cut anywhere between two batches.

Rows come and go as tables of bounded size: PySpark's interface of rows holds all rows that a key gives
in a batch, and makes one Arrow batch of them.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.shuffle import ExternalSorter
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from cardloom.functions.variants import emit_json
from cardloom.operators.messages import ARROWS, LONE_BRACE
from cardloom.sources.growing import name_order

SORT_MB = 400  # memory of a Python worker above which the lines it puts in order go to Spark's local folders
PIECE_ROWS, PIECE_CHARS = 10_000, 4 << 20  # rows and characters at which a table of messages leaves a Python worker

_LONE = re.compile(LONE_BRACE, re.ASCII)
_LINE_ENDS = "".join(map(chr, (0x0A, 0x0D, 0x85, 0x2028, 0x2029)))  # what a dot does not match in the batch
_ESCAPED = re.compile(rf"\\[^{_LINE_ENDS}]")
_QUOTED = re.compile('"[^"]*"')


def _no_constant(name: str):
    raise ValueError(name)


def is_json(text: str) -> bool:
    """Whether a text is one JSON value (no NaN or Infinity)."""
    try:
        json.loads(text, parse_constant=_no_constant)
    except (ValueError, RecursionError):
        return False
    return True


def braces(text: str) -> int:
    """Opening minus closing braces outside quoted text."""
    plain = _QUOTED.sub("", _ESCAPED.sub("", text))
    return plain.count("{") - plain.count("}")


def lines_of(tables: Iterator[pd.DataFrame]) -> Iterator[tuple]:
    """(file, place, line, reset) of the rows of tables; a null place is an error."""
    for table in tables:
        places = table["line_no"].astype("int64")
        yield from zip(table["source_file"].tolist(), places.tolist(), table["line"].tolist(), table["reset"].tolist(), strict=True)


def in_order(lines: Iterator[tuple]) -> Iterator[tuple]:
    """(file, place, line, reset) by the time of the file's name and the place, in bounded memory."""
    order = lru_cache(maxsize=1024)(name_order)
    return iter(ExternalSorter(SORT_MB).sorted(lines, key=lambda r: (order(r[0]), r[1])))


def pieces(rows: Iterator[tuple]) -> Iterator[list[tuple]]:
    """Rows that end with two texts, in lists of PIECE_ROWS or of about PIECE_CHARS."""
    piece, chars = [], 0
    for row in rows:
        piece.append(row)
        chars += len(row[-2]) + len(row[-1])
        if len(piece) == PIECE_ROWS or chars >= PIECE_CHARS:
            yield piece
            piece, chars = [], 0
    if piece:
        yield piece


class OpenBlocks(StatefulProcessor):
    """Lines of a key -> texts of its messages.

    State: ``is_open``; ``text`` and ``depth`` of the open block, whose text is dropped (null) once it
    came back to depth zero without being JSON, as only a lone brace ends it then; ``base``, which
    is added to places so that they keep growing when a file is read anew or another file follows;
    the ``last`` place and its ``file``.
    """

    def __init__(self, by: tuple[str, ...]):
        self.columns = [*by, "line_no", "line", "text"]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.block = handle.getValueState("block", "is_open boolean, text string, depth bigint, base bigint, last bigint, file string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        for piece in pieces((*key, *message) for message in self._messages(lines_of(rows))):
            yield pd.DataFrame(piece, columns=self.columns)

    def _messages(self, lines: Iterator[tuple]) -> Iterator[tuple]:
        """(place, line, text) of the messages; the state is written behind the last one."""
        held = self.block.get() if self.block.exists() else (False, None, 0, 0, -1, None)
        is_open, text, depth, base, last, file = held
        anew = set()
        for name, line_no, line, reset in in_order(lines):
            if (name != file and file is not None) or (reset and name not in anew):
                base = last + 1
            if reset:
                anew.add(name)
            file, last = name, base + line_no
            brace = line.find("{")
            if brace >= 0 and any(a in line for a in ARROWS):
                rest = line[brace:]
                if is_json(rest):
                    yield last, line, rest
                    continue
                is_open, depth = True, braces(rest)
                text = rest if depth > 0 else None
            elif is_open:
                if text is not None:
                    text, depth = f"{text}\n{line}", depth + braces(line)
                    if depth <= 0:
                        if is_json(text):
                            yield last, line, text
                            is_open = False
                        text = None
                if is_open and _LONE.search(line):
                    is_open, text = False, None
            elif brace >= 0 and line.rfind("}") > brace:
                part = line[brace : line.rfind("}") + 1]
                if is_json(part):
                    yield last, line, part
        self.block.update((is_open, text if is_open else None, depth if is_open else 0, base, last, file))


def stream_messages(lines: DataFrame, by: tuple[str, ...] = ("player_id", "source_file")) -> DataFrame:
    """Stream of lines -> stream of ``by``, ``line_no``, ``line``, ``payload``, as ``extract_messages`` gives.

    By player and file it equals the batch operator. By player alone one parser follows all files of a
    player in the order of their names' times, so a block may begin in one and end in the next;
    ``line_no`` then grows over the files. The rows of one key and batch are put in order in their task,
    on disk above SORT_MB of its Python worker, and its messages leave in tables of bounded size.
    """
    shape = ", ".join(f"{c} string" for c in by) + ", line_no bigint, line string, text string"
    texts = lines.groupBy(*by).transformWithStateInPandas(
        statefulProcessor=OpenBlocks(by), outputStructType=shape, outputMode="Append", timeMode="None"
    )
    keep = [*by, "line_no", "line"]
    return emit_json(texts, keep, F.col("text")).filter(F.col("payload").isNotNull())
