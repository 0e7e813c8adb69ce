"""Token counts of whole texts, huge ones by overlapping chunks that resynchronise.

The tokenizer file holds a BPE over words: it drops white space, and no token, merge, composition or
special string reaches over an ASCII white-space character. So a boundary before white space is
stable: what follows cannot change the tokens before it, and the other way round. A digit is a word
by itself in this vocabulary, and nothing before it composes with it, so the place before an ASCII
digit is stable as well.

A text up to ``chunk_chars`` is counted as the sum over its white-space separated words, each encoded
by the library once per task, many at once with spaces between them, and remembered. A longer text is encoded by the library in chunks that
overlap, with offsets: the tokens of a chunk count up to the last boundary in the overlap that is a
token boundary in both encodings and is stable, and those of the next chunk from there. Where the
overlap holds no such boundary it is doubled and the pair of chunks encoded again, up to the rest of
the text.

Null text counts as empty: 0 bytes, 0 tokens. Repeated rows and null ids each get their row.
"""

from __future__ import annotations

import os
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK_CHARS = 65_536
OVERLAP_CHARS = 256
LIMIT = 2048
REMEMBERED = 600_000  # words a task remembers; beyond, it starts anew
WORDS_AT_ONCE = 2000

_SPACE = " \t\n\r\x0b\x0c"


class Counter:
    def __init__(self, path: str, chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.chunk, self.overlap = chunk_chars, overlap_chars
        self.words: dict[bytes, int] = {}

    def encode(self, text: str) -> list[tuple[int, int]]:
        """Offsets of the tokens."""
        return self.tokenizer.encode(text, add_special_tokens=False).offsets

    def batch(self, texts: list[str]) -> list[int]:
        """Token counts of texts."""
        split = [t.encode("utf-8", "surrogatepass").split() if len(t) <= self.chunk else None for t in texts]
        known = self.words
        new = {w for words in split if words for w in words if w not in known}
        if len(known) + len(new) > REMEMBERED and known:
            known.clear()
            new = {w for words in split if words for w in words}
        listed = [w.decode("utf-8", "surrogatepass") for w in new]
        known.update(zip(new, self.counts_of(listed), strict=True))
        look = known.__getitem__
        return [self.huge(t) if words is None else sum(map(look, words)) for t, words in zip(texts, split, strict=True)]

    def counts_of(self, words: list[str]) -> list[int]:
        """Token counts of words without white space, encoded together with spaces between them."""
        out: list[int] = []
        for at in range(0, len(words), WORDS_AT_ONCE):
            part = words[at : at + WORDS_AT_ONCE]
            ends = np.cumsum([len(w) + 1 for w in part])
            begins = np.array([s for s, _ in self.encode(" ".join(part))], np.int64)
            out += np.bincount(np.searchsorted(ends, begins, side="right"), minlength=len(part)).tolist()
        return out

    def huge(self, text: str) -> int:
        """Token count by overlapping chunks."""
        total = start = 0
        while True:
            overlap = self.overlap
            while True:
                end = start + self.chunk + overlap
                here = self.encode(text[start:end])
                if end >= len(text):
                    return total + len(here)
                after = self.encode(text[end - overlap : end + self.chunk])
                cut = self.common(text, start, end, overlap, here, after)
                if cut is not None:
                    break
                overlap *= 2
            total += sum(1 for _, e in here if start + e <= cut)
            start = cut

    @staticmethod
    def common(text: str, start: int, end: int, overlap: int, here, after) -> int | None:
        """Last stable place in the overlap that lies between tokens in both encodings."""
        zone = end - overlap
        inside_here = {start + i for s, e in here if start + e > zone for i in range(s + 1, e)}
        inside_after = {zone + i for s, e in after if zone + s < end for i in range(s + 1, e)}
        for cut in range(end - 1, zone, -1):
            if (text[cut] in _SPACE or text[cut] in "0123456789") and cut not in inside_here and cut not in inside_after:
                return cut
        return None


def _count_batches(batches, path: str, chunk_chars: int, overlap_chars: int):
    counter = Counter(path, chunk_chars, overlap_chars)
    for batch in batches:
        texts = [t or "" for t in batch.column(batch.num_columns - 1).to_pylist()]
        n_bytes = [len(t.encode("utf-8", "surrogatepass")) for t in texts]
        n_tokens = np.zeros(len(texts), np.int64)
        at = 0
        while at < len(texts):
            stop, size = at, 0
            while stop < len(texts) and (stop == at or size + len(texts[stop]) <= 4_000_000):
                size += len(texts[stop])
                stop += 1
            n_tokens[at:stop] = counter.batch(texts[at:stop])
            at = stop
        kept = [batch.column(i) for i in range(batch.num_columns - 1)]
        yield pa.RecordBatch.from_arrays(
            [*kept, pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64())], [*batch.schema.names[:-1], "n_bytes", "n_tokens"]
        )


def count_tokens(
    docs: DataFrame,
    path: str,
    columns: tuple[str, ...] = ("doc_id",),
    text_col: str = "text",
    limit: int = LIMIT,
    chunk_chars: int = CHUNK_CHARS,
    overlap_chars: int = OVERLAP_CHARS,
) -> DataFrame:
    """``columns`` of each row with n_bytes, n_tokens and over_limit. ``path``: tokenizer file on every executor."""
    work = docs.select(*[F.col(f"`{c}`") for c in columns], F.col(text_col).alias("_text"))
    schema = work.drop("_text").schema.add("n_bytes", "long").add("n_tokens", "long")
    counted = work.mapInArrow(partial(_count_batches, path=path, chunk_chars=chunk_chars, overlap_chars=overlap_chars), schema)
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
