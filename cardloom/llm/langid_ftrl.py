"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are the one- to three-grams of the lower-cased text with everything but letters read as a
space, hashed into FEATURES buckets, weighted (1 + log tf) * idf and scaled to length one. Document
frequencies count all training documents. Weights are fitted by follow-the-regularised-leader with
an elastic net on a sample of about PER_LANG documents of each language (a bound that does not grow
with the corpus; rows are drawn by a hash of id and text, equal ones once); a fifth of the sample is kept back to choose
the temperature that calibrates the scores.

A document of null text or without letters is ``und`` with score 1. Repeated rows and ids each get
their row; a null id counts as the empty string where ids choose the training part. Without any
training document every text is ``und`` with score 0.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardloom.llm.shared import small_batches, with_text

SLICE_CHARS = 250_000  # characters counted at once in a task; longer texts are cut into overlapping slices
BITS = 15
FEATURES = 1 << BITS
PER_LANG = 1000
MAX_LANGS = 1000
EPOCHS = 2
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.05, 0.05
TEMPERATURES = np.geomspace(0.05, 5, 60)

_LETTER: np.ndarray | None = None


def _letters() -> np.ndarray:
    global _LETTER
    if _LETTER is None:
        _LETTER = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _LETTER


def _bucket(run: np.ndarray) -> np.ndarray:
    run = run * np.uint32(0x9E3779B1)
    run ^= run >> np.uint32(15)
    return ((run * np.uint32(0x85EBCA77)) >> np.uint32(32 - BITS)).astype(np.int32)


def _count(texts: list[str]) -> Iterator[tuple[np.ndarray, int]]:
    """(n-gram counts, number of letters) of each text; all together fit into one slice."""
    cp = np.frombuffer(" ".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[cp]
    cp = np.where(letter, cp, np.uint32(32))
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    place = np.concatenate(([0], np.cumsum(keep)))
    upto = np.concatenate(([0], np.cumsum(letter)))
    cp = cp[keep]
    one = _bucket(cp)
    two = _bucket(cp[:-1] * np.uint32(0x01000193) + cp[1:] + np.uint32(0x51ED270B)) if len(cp) > 1 else one[:0]
    three = two[:0]
    if len(cp) > 2:
        three = _bucket((cp[:-2] * np.uint32(0x01000193) + cp[1:-1]) * np.uint32(0x01000193) + cp[2:] + np.uint32(0x2545F491))
    at = 0
    for text in texts:
        s, e = place[at], place[at + len(text)]
        n = int(upto[at + len(text)] - upto[at])
        parts = (one[s:e], two[s : max(s, e - 1)], three[s : max(s, e - 2)])
        yield np.bincount(np.concatenate(parts), minlength=FEATURES), n
        at += len(text) + 1


def _count_slices(text: str) -> tuple[np.ndarray, int]:
    """The counts of one long text from slices that begin at a letter and reach two characters into the next.

    Those two characters are n-grams of both slices, so they are taken off once.
    """
    total, letters, at = np.zeros(FEATURES, np.int64), 0, 0
    while at < len(text):
        cut = at + SLICE_CHARS
        while cut < len(text) and not text[cut].isalpha():
            cut += 1
        counts, n = next(_count([text[at : cut + 2]]))
        total += counts
        letters += n
        if cut < len(text):
            counts, n = next(_count([text[cut : cut + 2]]))
            total -= counts
            letters -= n
        at = cut
    return total, letters


def ngram_counts(texts: Iterable[str | None]) -> Iterator[tuple[np.ndarray, int]]:
    """(n-gram counts, letters) of each whole text; null counts as empty."""
    held: list[str] = []
    size = 0
    for text in texts:
        low = (text or "").lower()
        if held and size + len(low) > SLICE_CHARS:
            yield from _count(held)
            held, size = [], 0
        if len(low) > SLICE_CHARS:
            yield _count_slices(low)
            continue
        held.append(low)
        size += len(low) + 1
    if held:
        yield from _count(held)


def tf_idf(counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.flatnonzero(counts)
    x = (1 + np.log(counts[at])) * idf[at]
    norm = np.sqrt((x * x).sum())
    return at, x / norm if norm else x


class Model:
    def __init__(self, langs: list[str], idf: np.ndarray):
        self.langs, self.idf = langs, idf
        self.weights = np.zeros((FEATURES, len(langs)))
        self.bias = np.zeros(len(langs))
        self.temperature = 1.0

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray, int]]) -> None:
        """rows: (features, values, language)."""
        held, train = rows[::5] if len(rows) >= 20 else rows, [r for i, r in enumerate(rows) if i % 5 or len(rows) < 20]
        k = len(self.langs)
        z, n = np.zeros((FEATURES + 1, k)), np.zeros((FEATURES + 1, k))
        for _ in range(EPOCHS):
            for at, x, y in train:
                at, x = np.append(at, FEATURES), np.append(x, 1.0)
                w = _ftrl_weights(z[at], n[at])
                g = _softmax(x @ w)
                g[y] -= 1
                g = x[:, None] * g
                old = n[at]
                n[at] = old + g * g
                z[at] += g - (np.sqrt(old + g * g) - np.sqrt(old)) / ALPHA * w
        all_w = _ftrl_weights(z, n)
        self.weights, self.bias = all_w[:-1].astype(np.float32), all_w[-1]
        if held:
            logits = np.array([x @ self.weights[at] + self.bias for at, x, _ in held])
            y = np.array([r[2] for r in held])
            loss = [-np.log(_softmax(logits / t)[np.arange(len(y)), y] + 1e-12).mean() for t in TEMPERATURES]
            self.temperature = float(TEMPERATURES[int(np.argmin(loss))])

    def predict(self, counts: np.ndarray) -> tuple[str, float]:
        at, x = tf_idf(counts, self.idf)
        p = _softmax((x @ self.weights[at] + self.bias) / self.temperature)
        best = int(p.argmax())
        return self.langs[best], float(p[best])


def _ftrl_weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Closed form of the leader under the elastic net."""
    shrunk = np.sign(z) * np.maximum(np.abs(z) - L1, 0)
    return -shrunk / ((BETA + np.sqrt(n)) / ALPHA + L2)


def _softmax(a: np.ndarray) -> np.ndarray:
    e = np.exp(a - a.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _document_frequencies(batches):
    df = np.zeros(FEATURES, np.int64)
    for batch in batches:
        for counts, n in ngram_counts(t.as_py() for t in batch.column(0)):
            if n:
                df += counts > 0
    at = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at])], ["feature", "df"])


def _sample_features(batches):
    for batch in batches:
        at, tf = [], []
        for counts, _ in ngram_counts(t.as_py() for t in batch.column(1)):
            f = np.flatnonzero(counts)
            at.append(f)
            tf.append(counts[f])
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(at, pa.list_(pa.int64())), pa.array(tf, pa.list_(pa.int64())), batch.column(2)], ["lang", "at", "tf", "key"]
        )


def drawn(rows: DataFrame, sizes: dict[str, int], per_lang: int) -> DataFrame:
    """(lang, text, key) of about ``per_lang`` rows (id, text, lang) of each language, whatever share one id or text has."""
    key = F.xxhash64("id", "text", F.lit(10))
    place = F.pmod(key, F.lit(1 << 30)) / F.lit(float(1 << 30))
    some = F.lit(False)
    for lang, n in sizes.items():
        some = some | ((F.col("lang") == lang) & (place < per_lang / n))
    return rows.filter(some).dropDuplicates(["id", "text", "lang"]).select("lang", "text", key.alias("key"))


def train(docs: DataFrame, id_col="doc_id", text_col="text", lang_col="lang", per_lang: int = PER_LANG) -> Model:
    """Fit on all rows of ``docs``; pass only rows that may be learned from."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    rows = rows.filter("lang is not null")
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n")).limit(MAX_LANGS + 1).collect()
    if len(sizes) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    langs = sorted(r["lang"] for r in sizes)
    df = np.zeros(FEATURES)
    for r in rows.select("text").mapInArrow(_document_frequencies, "feature bigint, df bigint").groupBy("feature").agg(F.sum("df").alias("df")).collect():
        df[r["feature"]] = r["df"]
    total = sum(r["n"] for r in sizes)
    model = Model(langs, np.log((1 + total) / (1 + df)) + 0.1)
    if not langs:
        return model
    picked = drawn(rows, {r["lang"]: r["n"] for r in sizes}, per_lang)
    sample = picked.mapInArrow(_sample_features, "lang string, at array<bigint>, tf array<bigint>, key bigint")
    number = {lang: i for i, lang in enumerate(langs)}
    fitted = []
    for r in sample.toLocalIterator():
        at, tf = np.array(r["at"], np.int64), np.array(r["tf"], np.int64)
        if len(at):
            x = (1 + np.log(tf)) * model.idf[at]
            fitted.append((r["key"], number[r["lang"]], at, x / np.sqrt((x * x).sum())))
    fitted = [(at, x, y) for _, y, at, x in sorted(fitted, key=lambda f: f[:2])]
    order = np.random.default_rng(10).permutation(len(fitted))
    model.fit([fitted[i] for i in order])
    return model


def _predict_batches(batches, model: Model, text: int, n_kept: int):
    for batch in batches:
        lang, score = [], []
        for counts, n in ngram_counts(t.as_py() for t in batch.column(text)):
            if not n:
                got = ("und", 1.0)
            elif not model.langs:
                got = ("und", 0.0)
            else:
                got = model.predict(counts)
            lang.append(got[0])
            score.append(got[1])
        kept = [batch.column(i) for i in range(n_kept)]
        names = batch.schema.names[:n_kept]
        yield pa.RecordBatch.from_arrays([*kept, pa.array(lang, pa.string()), pa.array(score, pa.float64())], [*names, "lang_pred", "score"])


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with lang_pred and score; columns of these names are replaced."""
    rest = [c for c in docs.columns if c not in ("lang_pred", "score")]
    kept = docs.select(*[F.col(f"`{c}`") for c in rest])
    schema = kept.schema[:].add("lang_pred", "string").add("score", "double")
    work, text = with_text(docs, kept, text_col)
    small_batches(docs.sparkSession)
    return work.mapInArrow(partial(_predict_batches, model=model, text=text, n_kept=len(rest)), schema)


def may_learn(docs: DataFrame, id_col: str = "doc_id"):
    """Condition of the training part: crc32 of the id as text leaves another remainder than 1 by 3."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 3 != 1
