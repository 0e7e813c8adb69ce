"""Helpers of the corpus operators: shared folder, staged tables, word hashes of text batches."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_CHARS = 2_000_000  # characters hashed at once in a task; longer texts are cut between words
BATCH_BYTES = 4 << 20  # of rows handed to a Python worker at once; a longer row is a batch by itself
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def shared_folder(spark: SparkSession) -> str:
    """Folder all executors and the driver see: ``spark.checkpoint.dir``.

    Where that is unset a temporary folder serves, but only when everything runs in one process
    on one machine; on a cluster the missing setting is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            return held.get().rstrip("/")
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="cardloom-llm-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write a table that several jobs read, and read it back; the lineage ends at its files."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_staged(*tables: DataFrame) -> None:
    """Delete staged tables that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession) -> None:
    """Batches of at most BATCH_BYTES between the JVM and Python, unless the session has smaller ones.

    A batch is held several times, as it is written and read on both sides, next to the work on it.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    number, unit = re.fullmatch(r"(\d+)([bkmgtp]?)i?b?", spark.conf.get(name).lower()).groups()
    held = int(number) * 1024 ** "bkmgtp".index(unit or "b")
    if held > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def free_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have: ``name``, with underscores added where it is taken."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def with_text(docs: DataFrame, kept: DataFrame, text_col: str) -> tuple[DataFrame, int]:
    """``kept`` (columns of ``docs``) with the text, and its place: added at the end only where it is not among them."""
    if kept.columns.count(text_col) == 1:
        return kept, kept.columns.index(text_col)
    names = [F.col(f"`{c}`") for c in kept.columns]
    return docs.select(*names, F.col(text_col).alias(free_name(docs, "_text"))), len(names)


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser: every input bit reaches every output bit. Keeps the input array."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_WORD_CHAR: np.ndarray | None = None


def word_char_table() -> np.ndarray:
    """For each code point whether it is a letter or digit; built once in a worker."""
    global _WORD_CHAR
    if _WORD_CHAR is None:
        _WORD_CHAR = np.fromiter((chr(i).isalnum() for i in range(0x110000)), bool, 0x110000)
    return _WORD_CHAR


def _pieces(text: str) -> Iterator[str]:
    """Cut a very long text between words; a single longer word stays whole."""
    start = 0
    while len(text) - start > SLICE_CHARS:
        end = start + SLICE_CHARS
        while end < len(text) and text[end].isalnum():
            end += 1
        yield text[start:end]
        start = end
    yield text[start:] if start else text


def _hash_joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of some texts, and the number of words of each text."""
    lens = np.fromiter(map(len, texts), np.int64, len(texts))
    cp = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    inside = word_char_table()[cp]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).view(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    total = np.empty(len(cp) + 1, np.uint64)
    total[0] = 0
    power = np.full(len(cp), _BASE, np.uint64)
    np.cumprod(power, out=power)
    np.cumsum(cp.astype(np.uint64) * power, out=total[1:])
    hashes = total[ends] - total[starts]
    del total, power
    inverse = np.full(len(cp) + 1, _BASE_INVERSE, np.uint64)
    inverse[0] = 1
    np.cumprod(inverse, out=inverse)
    hashes *= inverse[starts]
    bounds = np.concatenate(([0], np.cumsum(lens + 1)))
    counts = np.diff(np.searchsorted(starts, bounds))
    return mix(hashes), counts


def word_batches(texts: list[str | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Lower-cased words (runs of letters and digits) of texts as 64-bit hashes, by slices.

    Yields (index of the first text, hashes of all words, word counts by text). Null counts as
    empty. Every text is read whole.
    """
    held: list[str] = []
    first = size = 0
    for i, text in enumerate(texts):
        low = (text or "").lower()
        if held and size + len(low) > SLICE_CHARS:
            yield first, *_hash_joined(held)
            held, size, first = [], 0, i
        if len(low) > SLICE_CHARS:
            parts = [_hash_joined([p])[0] for p in _pieces(low)]
            hashes = np.concatenate(parts)
            yield i, hashes, np.array([len(hashes)])
            first = i + 1
            continue
        held.append(low)
        size += len(low)
    if held:
        yield first, *_hash_joined(held)
