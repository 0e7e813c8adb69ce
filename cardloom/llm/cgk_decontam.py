"""Benchmark passages in documents by CGK random-walk embedding and bit-sampling LSH.

Texts are sequences of lower-cased words. A CGK walk reads a sequence with a pointer: at each step
it emits the word under the pointer and then advances or not, by a random bit that depends on the
step and that word. Two sequences within a small edit distance emit equal words at most steps, so
edit distance becomes Hamming distance. One repetition of the LSH draws a walk and a few steps of
it; the words emitted at those steps, hashed, are the key. A window of an item's size that shares
a key with the item in any repetition is a candidate, and the candidate is verified by the exact
word edit distance of the item to the best piece of the text around it. A text contains the item
if that distance is at most ``edit_share`` of the item's words.

The number of repetitions follows from the target recall: items are edited at random up to the
limit and the share of repetitions in which a copy meets its item is measured.

Windows that cannot be within the limit are skipped before the walks without loss: an item of n
words and a window within d edits share at least n - 1 - 2 d word pairs, so fewer pairs of the
benchmark in a window rule it out. Items of fewer than MIN_WORDS words must occur unchanged.

Null and empty texts hold no passage; items without words are never found; repeated rows and
repeated ids give one result row per input row and item. The benchmark is read in blocks of
``block_items`` items, which bounds what is sent to the tasks.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardloom.llm.shared import mix, word_batches

EDIT_SHARE = 0.2
TARGET_RECALL = 0.99
BLOCK_ITEMS = 5000
MIN_WORDS = 6
SAMPLES = 2  # steps of a walk in a key
MAX_REPETITIONS = 96
PAIR_BITS = 22


def walk_keys(words: np.ndarray, starts: np.ndarray, samples: list[np.ndarray], limit: np.ndarray, rep: int) -> list[np.ndarray]:
    """Keys of the windows at ``starts`` by the walk of one repetition, one array per set of samples.

    ``samples``: sets of sampled steps, ascending; ``limit``: where each window's text ends, beyond
    which the walk emits a constant.
    """
    pointer = starts.copy()
    keys = [np.zeros(len(starts), np.uint64) for _ in samples]
    last = len(words) - 1
    at_step: dict[int, list[int]] = {}
    for c, steps in enumerate(samples):
        for t in steps.tolist():
            at_step.setdefault(t, []).append(c)
    for t in range(max(at_step) + 1):
        at = np.where(pointer < limit, words[np.minimum(pointer, last)], np.uint64(0))
        for c in at_step.get(t, ()):
            keys[c] = mix(keys[c] * np.uint64(0x100000001B3) + at)
        salt = np.uint64((rep * 100_003 + t + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
        pointer += (mix(at + salt) >> np.uint64(63)).astype(np.int64)
    return keys


def edit_distance_within(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """(smallest word edit distance of the item to any piece of the text, end of that piece)."""
    row = np.zeros(len(text) + 1, np.int64)
    span = np.arange(len(text) + 1)
    for i, w in enumerate(item):
        swap = row[:-1] + (text != w)
        new = np.empty_like(row)
        new[0] = i + 1
        new[1:] = np.minimum(swap, row[1:] + 1)
        row = np.minimum.accumulate(new - span) + span
    end = int(row.argmin())
    return int(row[end]), end


class Block:
    """Lookup tables of some benchmark items: pairs, and keys by repetition and size class."""

    def __init__(self, ids: list, items: list[np.ndarray], edit_share: float, target_recall: float, seed: int):
        self.ids, self.items = ids, items
        self.edits = np.array([int(edit_share * len(w)) if len(w) >= MIN_WORDS else 0 for w in items])
        size = np.array([len(w) for w in items])
        self.pairs = np.zeros(1 << PAIR_BITS, bool)
        for w in items:
            self.pairs[self.pair_slots(w)] = True
        # classes of sizes that differ by an eighth at most
        self.classes: list[tuple[int, int, int, np.ndarray]] = []
        order = [i for i in np.argsort(size, kind="stable") if size[i] > 0]
        while order:
            least = size[order[0]]
            group = np.array([i for i in order if size[i] <= least + least // 8])
            order = order[len(group) :]
            need = int((size[group] - 1 - 2 * self.edits[group]).min())
            self.classes.append((int(least), int((size[group] + self.edits[group]).max()), max(need, 0), group))
        self.walks: list[list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = []
        self.met = self.plan(target_recall, seed)

    @staticmethod
    def pair_slots(words: np.ndarray) -> np.ndarray:
        """Slot of each word and its successor."""
        run = mix(words[:-1] * np.uint64(0x100000001B3) + words[1:])
        return (run >> np.uint64(64 - PAIR_BITS)).astype(np.int64)

    def plan(self, target: float, seed: int) -> float:
        """Draw repetitions until the measured recall at the edit limit reaches the target."""
        rng = np.random.default_rng(seed)
        copies = [(i, _edited(self.items[i], self.edits[i], rng)) for i in range(len(self.items)) if len(self.items[i])]
        copies = [c for c in copies for _ in range(1 if len(copies) > 1000 else 3)]
        missed = set(range(len(copies)))
        for rep in range(MAX_REPETITIONS):
            walk = []
            for least, _, _, group in self.classes:
                # a walk moves on every other step, so these steps lie within the smallest item
                steps = np.sort(rng.choice(max(SAMPLES, int(1.6 * least)), SAMPLES, replace=False))
                keys = np.array([walk_keys(w, np.zeros(1, np.int64), [steps], np.array([len(w)]), rep)[0][0] for w in (self.items[i] for i in group)], np.uint64)
                by_key = np.argsort(keys, kind="stable")
                walk.append((steps, keys[by_key], group[by_key]))
                own = dict(zip(group.tolist(), keys.tolist(), strict=True))
                for c in [c for c in missed if copies[c][0] in own]:
                    i, text = copies[c]
                    starts = np.arange(min(len(text), self.edits[i] + 1))
                    got = walk_keys(text, starts, [steps], np.full(len(starts), len(text)), rep)[0]
                    if (got == np.uint64(own[i])).any():
                        missed.discard(c)
            self.walks.append(walk)
            if 1 - len(missed) / max(1, len(copies)) >= target and rep >= 7:
                break
        return 1 - len(missed) / max(1, len(copies))

    @staticmethod
    def windows(hits: np.ndarray, longest: int, need: int, n: int) -> np.ndarray:
        """Starts of all windows of ``longest`` words with at least ``need`` benchmark pairs."""
        if need < 1:
            return np.arange(n)
        if len(hits) < need:
            return np.empty(0, np.int64)
        first, final = hits[: len(hits) - need + 1], hits[need - 1 :]
        close = final - first < longest - 1  # a window of so many words has one pair less
        low, high = np.maximum(final[close] - longest + 2, 0), first[close] + 1
        edge = np.zeros(n + 1, np.int32)
        np.add.at(edge, low, 1)
        np.add.at(edge, high, -1)
        return np.flatnonzero(np.cumsum(edge[:-1]) > 0) if len(low) else np.empty(0, np.int64)

    def find(self, words: np.ndarray, counts: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(text, item, first word of the region, edits) of each contained item."""
        out: dict[tuple[int, int], tuple[int, int]] = {}
        if len(words) < 1 or not self.classes:
            return []
        ends = np.cumsum(counts)
        hits = np.flatnonzero(self.pairs[self.pair_slots(words)])
        fits = [self.windows(hits, longest, need, len(words)) for _, longest, need, _ in self.classes]
        starts = np.unique(np.concatenate(fits))
        if not len(starts):
            return []
        mine = [np.searchsorted(starts, f) for f in fits]
        text = np.searchsorted(ends, starts, side="right")
        found: dict[tuple[int, int], set[int]] = {}
        for rep, walk in enumerate(self.walks):
            got = walk_keys(words, starts, [steps for steps, _, _ in walk], ends[text], rep)
            for c, (_, keys, owner) in enumerate(walk):
                own = got[c][mine[c]]
                lo, hi = np.searchsorted(keys, own), np.searchsorted(keys, own, side="right")
                for k in np.flatnonzero(hi > lo):
                    at = mine[c][k]
                    for i in owner[lo[k] : hi[k]]:
                        found.setdefault((int(text[at]), int(i)), set()).add(int(starts[at]))
        for (t, i), at in found.items():
            best = self.verify(words, int(ends[t] - counts[t]), int(ends[t]), i, sorted(at))
            if best:
                out[t, i] = best
        return [(t, i, *v) for (t, i), v in sorted(out.items())]

    def verify(self, words, first: int, last: int, i: int, at: list[int]) -> tuple[int, int] | None:
        item, d = self.items[i], int(self.edits[i])
        for s in at:
            if s + len(item) <= last and (words[s : s + len(item)] == item).all():
                return s - first, 0
        best = None
        while at:
            # one region serves candidates that start close to each other
            near = [s for s in at if s <= at[0] + len(item)]
            at = at[len(near) :]
            lo, hi = max(first, near[0] - d - 1), min(last, near[-1] + len(item) + d + 1)
            edits, end = edit_distance_within(item, words[lo:hi])
            if edits <= d and (best is None or edits < best[1]):
                best = (max(first, lo + end - len(item)) - first, edits)
        return best


def _edited(words: np.ndarray, edits: int, rng) -> np.ndarray:
    """A copy with some random word substitutions, insertions and deletions."""
    out = words.tolist()
    for _ in range(edits):
        kind, at = rng.integers(3), int(rng.integers(len(out)))
        new = int(rng.integers(1 << 62))
        if kind == 0:
            out[at] = new
        elif kind == 1:
            out.insert(at, new)
        elif len(out) > 1:
            del out[at]
    return np.array(out, np.uint64)


def _find_batches(batches, block: Block):
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1).to_pylist()
        row, item, start, edits = [], [], [], []
        for at, words, counts in word_batches(texts):
            for t, i, s, e in block.find(words, counts):
                row.append(at + t)
                item.append(i)
                start.append(s)
                edits.append(e)
        yield pa.RecordBatch.from_arrays(
            [
                ids.take(pa.array(row, pa.int64())),
                pa.array([block.ids[i] for i in item], pa.int64()),
                pa.array(start, pa.int64()),
                pa.array(edits, pa.int64()),
                pa.array([len(block.items[i]) for i in item], pa.int64()),
            ],
            ["id", "item_id", "start_word", "edits", "item_words"],
        )


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    edit_share: float = EDIT_SHARE,
    target_recall: float = TARGET_RECALL,
    block_items: int = BLOCK_ITEMS,
    seed: int = 9,
) -> DataFrame:
    """(id, item_id, start_word, edits, item_words, similarity): the benchmark items in each text."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"id {id_type}, item_id bigint, start_word bigint, edits bigint, item_words bigint"
    out = None
    for block in _blocks(benchmark, edit_share, target_recall, block_items, seed):
        found = rows.mapInArrow(partial(_find_batches, block=block), schema)
        out = found if out is None else out.unionAll(found)
    return out.withColumn("similarity", 1 - F.col("edits") / F.col("item_words"))


def _blocks(benchmark: DataFrame, edit_share: float, target_recall: float, block_items: int, seed: int):
    """The benchmark in blocks of ``block_items`` items; one empty block without items."""
    items = benchmark.select(F.col("item_id").cast("bigint"), "text").orderBy("item_id", "text").toLocalIterator()
    ids, texts, none = [], [], True

    def block() -> Block:
        words = []
        for _, hashes, counts in word_batches(texts):
            words += np.split(hashes, np.cumsum(counts)[:-1])
        return Block(ids[:], words, edit_share, target_recall, seed)

    for r in items:
        ids.append(r["item_id"])
        texts.append(r["text"])
        if len(ids) == block_items:
            yield block()
            ids, texts, none = [], [], False
    if ids or none:
        yield block()


def _clean_batches(batches, block: Block, text_at: int):
    """The rows that hold none of the block's items."""
    for batch in batches:
        clean = np.ones(batch.num_rows, bool)
        for at, words, counts in word_batches(batch.column(text_at).to_pylist()):
            for t, _, _, _ in block.find(words, counts):
                clean[at + t] = False
        yield batch.filter(pa.array(clean))


def without_contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    edit_share: float = EDIT_SHARE,
    target_recall: float = TARGET_RECALL,
    block_items: int = BLOCK_ITEMS,
    seed: int = 9,
) -> DataFrame:
    """Rows that hold no benchmark passage, all columns unchanged.

    Each row is judged by its own text in the scan and ``id_col`` is not read: rows with a null or
    repeated id stay or go one by one.
    """
    for block in _blocks(benchmark, edit_share, target_recall, block_items, seed):
        docs = docs.mapInArrow(partial(_clean_batches, block=block, text_at=docs.columns.index(text_col)), docs.schema)
    return docs
