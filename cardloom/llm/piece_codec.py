"""SentencePiece BPE ids by exact backtracking, and their decoding.

A BPE of merge type joins, again and again, the adjacent pair whose union has the best score (the
leftmost of equals). Its result is the one split of a text into pieces in which every piece and every
two adjacent pieces come out unchanged when they are merged by themselves: the first merge over a
border of the split would also happen in the pair around that border. So the split is searched for
and no text is ever merged as a whole:

* an Aho-Corasick automaton of all pieces gives the longest piece at every place in one pass;
* from left to right the longest piece is taken that is compatible with the one before it, which is
  decided by merging the characters of the two again (remembered by pair);
* where none is, the place is marked in a bitfield of failed positions, the last piece is taken back
  and the next shorter prefix of it tried. A place is reached by one split only, so a failed place
  fails for good and every place is left at most once.

Characters without a piece become byte pieces; as no piece holds such a character, they are borders.
Where no piece of the model has a space after another character (checked when it is loaded), the
border before a space is never merged over: a text is then encoded word by word (its spaces lead the
word), and words of up to ``WORD_CHARS`` characters are encoded once a task. Otherwise each text is
searched whole.

Null text counts as empty: begin and end ids alone, decoded to the empty text. Repeated rows and null
ids each get their row; other columns are not read.
"""

from __future__ import annotations

import re
import struct
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"  # the model's sign for a space
WORD_CHARS = 64  # longer words are encoded anew each time, which bounds the memory of remembered ones
REMEMBERED = 500_000  # words and pairs of pieces a task remembers; beyond, it starts anew
BATCH_BYTES = 16_000_000  # decoded text in a result batch

_WORDS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
_BPE, _NORMAL, _UNKNOWN, _CONTROL, _BYTE = 2, 1, 2, 3, 6  # fixed values of the model format


class Codec:
    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        model = sentencepiece_model_pb2.ModelProto()
        model.ParseFromString(self.library.serialized_model_proto())
        kinds = {p.type for p in model.pieces}
        norm, trainer = model.normalizer_spec, model.trainer_spec
        if trainer.model_type != _BPE or not trainer.byte_fallback or kinds - {_NORMAL, _UNKNOWN, _CONTROL, _BYTE}:
            raise ValueError("only BPE models with byte fallback and without user-defined or unused pieces")
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or trainer.treat_whitespace_as_suffix:
            raise ValueError("only models that keep text as it is, with spaces before words")
        self.prefix = SPACE if norm.add_dummy_prefix else ""
        self.begin, self.end = self.library.bos_id(), self.library.eos_id()
        self.score = {p.piece: p.score for p in model.pieces if p.type == _NORMAL}
        self.bytes = [self.library.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        known = set("".join(self.score))
        if not known <= self.score.keys():
            raise ValueError("a character of a piece has no piece of its own")
        self.by_words = not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.score)
        self.piece = [p.piece for p in model.pieces]
        self.size = [len(p) for p in self.piece]
        # pieces that merging never makes can be no part of a result
        made = {p.piece: i for i, p in enumerate(model.pieces) if p.type == _NORMAL and self.merged(p.piece) == [p.piece]}
        self.shorter = [-1] * len(self.piece)
        self.automaton = ahocorasick.Automaton()
        for piece, i in made.items():
            self.automaton.add_word(piece, i)
            self.shorter[i] = next((made[piece[:n]] for n in range(len(piece) - 1, 0, -1) if piece[:n] in made), -1)
        self.automaton.make_automaton()
        self.pairs: dict[tuple[int, int], bool] = {}
        self.words: dict[str, bytes] = {}

    def merged(self, text: str) -> list[str]:
        """Pieces of a short text by merging its characters."""
        parts, score = list(text), self.score
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def compatible(self, left: int, right: int) -> bool:
        """Whether two pieces side by side stay as they are. Negative: characters without a piece."""
        if left < 0 or right < 0:
            return True
        told = self.pairs.get((left, right))
        if told is None:
            if len(self.pairs) >= REMEMBERED:
                self.pairs.clear()
            a, b = self.piece[left], self.piece[right]
            told = self.pairs[left, right] = self.merged(a + b) == [a, b]
        return told

    def search(self, text: str) -> list[int]:
        """Ids of a text with its spaces escaped."""
        n, size, shorter = len(text), self.size, self.shorter
        longest = [-1] * n
        for end, i in self.automaton.iter(text):
            longest[end + 1 - size[i]] = i  # ends ascend, so the longest comes last
        failed = bytearray(n // 8 + 1)
        path: list[int] = []
        at, tried = 0, longest[0] if n else -1
        fresh = True  # the place is entered, nothing was tried there yet
        while at < n:
            last = path[-1] if path else -1
            if fresh and tried < 0:
                end = at + 1  # a character without a piece
            else:
                end = -1
                while tried >= 0:
                    stop = at + size[tried]
                    if not failed[stop >> 3] >> (stop & 7) & 1 and self.compatible(last, tried):
                        end = stop
                        break
                    tried = shorter[tried]
            if end >= 0:
                path.append(tried)
                at, fresh = end, True
                tried = longest[at] if at < n else -1
            else:
                failed[at >> 3] |= 1 << (at & 7)
                back = path.pop()
                at -= size[back] if back >= 0 else 1
                tried, fresh = shorter[back] if back >= 0 else -1, False
        if path and min(path) >= 0:
            return path
        out, at = [], 0
        for i in path:
            if i >= 0:
                out.append(i)
                at += size[i]
            else:
                out += [self.bytes[b] for b in text[at].encode("utf-8", "surrogatepass")]
                at += 1
        return out

    def _packed(self, word: str) -> bytes:
        ids = self.search(word)
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str) -> bytes:
        """Begin id, ids, end id as little-endian unsigned 32-bit integers."""
        escaped = self.prefix + text.replace(" ", SPACE) if text else ""
        parts = [self.begin.to_bytes(4, "little")]
        if self.by_words:
            known = self.words
            for word in _WORDS.findall(escaped):
                ids = known.get(word)
                if ids is None:
                    ids = self._packed(word)
                    if len(word) <= WORD_CHARS:
                        if len(known) >= REMEMBERED:
                            known.clear()
                        known[word] = ids
                parts.append(ids)
        else:
            parts.append(self._packed(escaped))
        parts.append(self.end.to_bytes(4, "little"))
        return b"".join(parts)

    def decode(self, ids: bytes) -> str:
        """The text of packed ids, by the library's ``decode``."""
        return self.library.decode(np.frombuffer(ids, "<u4").tolist())


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """One codec for all tasks of a worker."""
    return Codec(path)


def _encode_batches(batches, path: str, names: list[str], decoded: bool):
    own = codec(path)
    for batch in batches:
        texts = batch.column(batch.num_columns - 1)
        at = 0
        while at < batch.num_rows or batch.num_rows == at == 0:
            ids, back, held, start = [], [], 0, at
            while at < batch.num_rows and held < BATCH_BYTES:
                packed = own.encode(texts[at].as_py() or "")
                ids.append(packed)
                held += 4 * len(packed)
                if decoded:
                    back.append(own.decode(packed))
                at += 1
            kept = [batch.column(i).slice(start, at - start) for i in range(batch.num_columns - 1)]
            n = pa.array([len(i) // 4 for i in ids], pa.int64())
            made = [n, pa.array(ids, pa.binary())] + ([pa.array(back, pa.string())] if decoded else [])
            yield pa.RecordBatch.from_arrays([*kept, *made], names)
            if batch.num_rows == 0:
                break


def encode(
    docs: DataFrame,
    path: str,
    columns: tuple[str, ...] = ("doc_id",),
    text_col: str = "text",
    decoded: bool = True,
) -> DataFrame:
    """``columns`` of each row with n_tokens, ids (binary: little-endian unsigned 32-bit) and decoded text.

    ``path``: model file on every executor. Texts of any length are encoded whole.
    """
    work = docs.select(*[F.col(f"`{c}`") for c in columns], F.col(f"`{text_col}`").alias("__text"))
    schema = work.drop("__text").schema.add("n_tokens", "long").add("ids", "binary")
    if decoded:
        schema = schema.add("decoded", "string")
    return work.mapInArrow(partial(_encode_batches, path=path, names=schema.names, decoded=decoded), schema)
