"""Quality classifier: ordinal cumulative-link regression on graded ratings.

A rating is the number of good marks of a document (quality, and not toxic): 0, 1 or 2. The model
is one weight vector over hashed text features shared by all grades and ordered thresholds t1 < t2:
P(grade > j) = sigmoid(w.x - t_j). Features are the set of lower-cased words of the whole text and
its shape (shares of character classes, share of distinct words, length), hashed into 2**BITS
buckets; every document yields its expected grade and the tail probability of the best grade.

Weights are fitted by proximal gradient steps with an L1 penalty on about ``max_labels`` labelled
rows, drawn by a hash of the id and, where ids are repeated, of id and text (a bound that does not grow
with the corpus). Null text counts as empty. Rows with a null rating are not learned from; rows of equal
id and text are learned from once, with the smallest rating of the id.
Without labels every document gets the best grade.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardloom.llm.shared import mix, small_batches, with_text, word_batches

BITS = 18
GRADES = 3
MAX_LABELS = 8000
STEPS = 300
L1 = 5e-4
CLIP = 5.0  # documents of a feature from which on its gradient is scaled by its frequency
KEEP_TAIL = 0.5

_CLASS: np.ndarray | None = None


def _char_classes() -> np.ndarray:
    """Class of each code point: upper, lower, other letter, digit, space, other, or an ASCII sign."""
    global _CLASS
    if _CLASS is None:
        out = np.full(0x110000, 5, np.uint8)
        for i in range(0x110000):
            c = chr(i)
            if c.isupper():
                out[i] = 0
            elif c.islower():
                out[i] = 1
            elif c.isalpha():
                out[i] = 2
            elif c.isdigit():
                out[i] = 3
            elif c.isspace():
                out[i] = 4
            elif 32 < i < 127:
                out[i] = 6 + (i - 33) % 94
        _CLASS = out
    return _CLASS


def _shape(text: str, words: int, distinct: int) -> np.ndarray:
    """Feature codes of the shape of a text: (class, step of its share), length, variety."""
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    n = np.bincount(_char_classes()[cp], minlength=100) if len(cp) else np.zeros(100, np.int64)
    at = np.flatnonzero(n)
    step = np.minimum(np.floor(-2 * np.log2(n[at] / max(1, len(cp)))), 24).astype(np.int64)
    codes = at * 32 + step
    size = int(np.log2(len(cp) + 1))
    variety = int(10 * distinct / words) if words else 11
    return np.concatenate((codes, [4000 + size, 4100 + variety, 4200 + variety * 32 + size])).astype(np.uint64)


def features(texts: list[str | None]):
    """Yield the sorted distinct feature numbers of each whole text."""
    shift = np.uint64(64 - BITS)
    for first, hashes, counts in word_batches(texts):
        at = 0
        for i, n in enumerate(counts):
            own = hashes[at : at + n]
            at += n
            distinct = np.unique(own)
            shape = mix(_shape(texts[first + i] or "", int(n), len(distinct)) + np.uint64(0x5851F42D4C957F2D))
            yield np.unique(np.concatenate((distinct, shape)) >> shift).astype(np.int64)


class Model:
    def __init__(self):
        self.weights = np.zeros(1 << BITS, np.float32)
        self.thresholds = np.array([-20.0, -20.0])

    def tails(self, at: np.ndarray) -> np.ndarray:
        """P(grade > 0), P(grade > 1)."""
        return 1 / (1 + np.exp(-(float(self.weights[at].sum()) - self.thresholds)))

    def fit(self, rows: list[np.ndarray], grade: np.ndarray) -> None:
        if not len(rows):
            return
        flat, row = np.concatenate(rows), np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        known, at, seen = np.unique(flat, return_inverse=True, return_counts=True)
        use = (seen >= 3)[at]
        at, row = at[use], row[use]
        n, d = len(rows), len(known)
        w, look = np.zeros(d), np.zeros(d)
        t, t_look = np.array([-2.0, -1.0]), np.array([-2.0, -1.0])
        # a rare feature has a small gradient; scaling by its frequency makes all learn alike
        speed = n / np.maximum(np.bincount(at, minlength=d), CLIP)
        rate, momentum = 0.02, 1.0
        for _ in range(STEPS):
            s = np.bincount(row, look[at], n)
            up = np.column_stack((np.ones(n), 1 / (1 + np.exp(-(s[:, None] - t_look))), np.zeros(n)))
            own, above = up[np.arange(n), grade], up[np.arange(n), grade + 1]
            p = np.maximum(own - above, 1e-9)
            slope_own, slope_above = own * (1 - own), above * (1 - above)
            ds = -(slope_own - slope_above) / p / n
            dt = np.array([((slope_own * (grade == j + 1) - slope_above * (grade == j)) / p).sum() / n for j in range(GRADES - 1)])
            g = np.bincount(at, ds[row], d)
            new = look - rate * speed * g
            new = np.sign(new) * np.maximum(np.abs(new) - rate * speed * L1, 0)
            new_t = np.sort(t_look - 1.0 * dt)
            nxt = (1 + np.sqrt(1 + 4 * momentum * momentum)) / 2
            push = min((momentum - 1) / nxt, 0.9)
            look, t_look = new + push * (new - w), new_t + push * (new_t - t)
            w, t, momentum = new, new_t, nxt
        self.weights[known] = w
        self.thresholds = t


def _sample(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(list(features(batch.column(1).to_pylist())), pa.list_(pa.int64())), batch.column(2)], ["grade", "at", "key"]
        )


def drawn(docs: DataFrame, rated: DataFrame, max_labels: int) -> DataFrame:
    """(grade, text, key) of about ``max_labels`` rows of docs (_id, text) with a rating (_id, grade), whatever share one id has."""

    def below(key, share: float):
        return F.pmod(key, F.lit(1 << 30)) / F.lit(float(1 << 30)) < share

    # expected max_labels rows, so the broadcast is bounded by the parameter
    some = rated.filter(below(F.xxhash64("_id", F.lit(3)), max_labels / max(1, rated.count())))
    some = F.broadcast(some.groupBy("_id").agg(F.min("grade").alias("grade")))
    n = docs.select("_id").join(some, "_id").count()
    key = F.xxhash64("_id", "text", F.lit(33))
    rows = docs.join(some, "_id").filter(below(key, max_labels / max(1, n)))
    return rows.dropDuplicates(["_id", "text"]).select("grade", "text", key.alias("key"))


def train(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", max_labels: int = MAX_LABELS) -> Model:
    """Fit on documents with labels (doc_id, quality, toxic)."""
    grade = (F.col("quality") + 1 - F.col("toxic")).cast("int")
    rated = labels.select(F.col("doc_id").alias("_id"), grade.alias("grade")).filter("_id is not null and grade between 0 and 2")
    text = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"))
    sample = drawn(text, rated, max_labels).mapInArrow(_sample, "grade int, at array<bigint>, key bigint")
    fitted = sorted(((r["key"], r["grade"], np.array(r["at"], np.int64)) for r in sample.toLocalIterator()), key=lambda f: f[:2])
    model = Model()
    model.fit([at for _, _, at in fitted], np.array([grade for _, grade, _ in fitted], np.int64))
    return model


def _score_batches(batches, model: Model, text: int, n_kept: int):
    for batch in batches:
        tails = [model.tails(at) for at in features(batch.column(text).to_pylist())]
        tails = np.array(tails).reshape(-1, 2)
        kept = [batch.column(i) for i in range(n_kept)]
        yield pa.RecordBatch.from_arrays(
            [*kept, pa.array(tails.sum(axis=1)), pa.array(tails[:, 1])], [*batch.schema.names[:n_kept], "expected_grade", "tail_prob"]
        )


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with expected_grade and tail_prob; columns of these names are replaced."""
    rest = [c for c in docs.columns if c not in ("expected_grade", "tail_prob")]
    kept = docs.select(*[F.col(f"`{c}`") for c in rest])
    schema = kept.schema[:].add("expected_grade", "double").add("tail_prob", "double")
    work, text = with_text(docs, kept, text_col)
    small_batches(docs.sparkSession)
    return work.mapInArrow(partial(_score_batches, model=model, text=text, n_kept=len(rest)), schema)
