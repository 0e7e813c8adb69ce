"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

The size of a document is its number of words (runs of other than ASCII white space). Sources in
code point order, null last, have the given weights in turn and share ``budget`` times all sizes in
their proportion; no target exceeds ``repeat`` times its source's size, and what is above goes to
the others by weight until none is above.

The total is cut into equal blocks. Each source gets as many blocks as Sainte-Lague gives it: the
blocks go to the highest quotients target / (2 k + 1), ties to the first source. The documents of a
source are dealt by a hash of their id into shards of about ``shard_words`` words, and the source's
blocks are apportioned to its shards by size in the same way. A shard's documents, in seeded order,
form one line of words, cut into blocks; all blocks are taken as often as the quota allows in full,
and the rest is a seeded choice of blocks.

``spans`` returns what is taken of each document: pass, first and last word of each piece, in the order
of the shard's line. ``mixed_texts`` cuts these pieces out of the texts, which gives the mixed corpus.
A document's ``taken`` in ``mix`` is the sum of its pieces, repeats counted.

Null text counts 0 words and is never taken. Repeated rows and ids are separate documents of the
line; a hash of the text orders those of equal id and size. Null ids hash like a fixed value. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cardloom.llm.shared import stage

WEIGHTS = (3, 1, 2)
BUDGET = 1.5
REPEAT = 2
BLOCK_WORDS = 32
SHARD_WORDS = 1_000_000
RESULT = ("size", "source_size", "target", "taken")
PLACES = ("source_number", "shard", "begin", "takes")

WORD = r"[^\x20\x09-\x0D]+"


def sizes_of(text: str = "text"):
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("bigint")


def capped_shares(weights: np.ndarray, sizes: np.ndarray, budget: float, repeat: float) -> np.ndarray:
    """Share the budget by weight; none above repeat times its size, the excess reshared."""
    target = np.zeros(len(sizes))
    capped = np.zeros(len(sizes), bool)
    while True:
        left = budget - repeat * sizes[capped].sum()
        free = ~capped
        if not free.any():
            break
        target[free] = left * weights[free] / weights[free].sum()
        above = free & (target > repeat * sizes)
        if not above.any():
            break
        capped |= above
        target[capped] = repeat * sizes[capped]
    return target


def sainte_lague(claims: np.ndarray, seats: int, most: np.ndarray) -> np.ndarray:
    """Seats by the highest quotients claim / (2 k + 1), at most ``most`` each; ties to the first.

    The lowest quotient that still gets a seat is found by bisection, so the work does not grow
    with the number of seats.
    """
    claims = np.asarray(claims, float)
    seats = int(min(seats, most[claims > 0].sum()))
    if seats <= 0:
        return np.zeros(len(claims), np.int64)

    def given(q: float) -> np.ndarray:
        return np.minimum(np.floor((claims / q + 1) / 2).astype(np.int64), most)

    low, high = claims[claims > 0].min() / (2.0 * most.max() + 3), claims.max() * 2
    for _ in range(200):
        mid = (low * high) ** 0.5
        if given(mid).sum() >= seats:
            low = mid
        else:
            high = mid
        if high / low < 1 + 1e-14:
            break
    out = given(high)
    while out.sum() < seats:
        quotient = np.where(out < most, claims / (2 * out + 1), -1)
        out[int(quotient.argmax())] += 1
    return out


def _shard_quotas(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values("shard")
    most = (group["repeat"].to_numpy() * group["n_blocks"].to_numpy()).astype(np.int64)
    quota = sainte_lague(group["shard_size"].to_numpy(), int(group["blocks"].iloc[0]), most)
    return group.assign(quota=quota)[["number", "shard", "n_blocks", "quota"]]


def spans(
    docs: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    weights: tuple[float, ...] = WEIGHTS,
    budget: float = BUDGET,
    repeat: int = REPEAT,
    block_words: int = BLOCK_WORDS,
    shard_words: int = SHARD_WORDS,
    seed: int = 4,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Id, source, the ``keep`` columns, and what is taken; one row per document.

    size, source_size, target and taken are the figures. source_number and shard name the shard, begin
    is the document's first word in the shard's line, and takes holds a struct (pass, first, last) for
    each piece, words counted from 0 in the document: the whole document for each pass in full, then
    one piece for each chosen block. Columns to keep that are named like a result are replaced by it.
    """
    spark = docs.sparkSession
    wide = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), sizes_of(text_col).alias("size"), F.xxhash64(text_col).alias("mark"), *[F.col(f"`{c}`").alias(f"keep_{c}") for c in keep])
    work = stage(wide.select("id", "source", "size", "mark"), "sizes")
    if not keep:
        wide = work
    # one row per source; a corpus names its sources, so they are few against the documents
    per_source = [(r["source"], r["n"]) for r in work.groupBy("source").agg(F.sum("size").alias("n")).toLocalIterator()]
    per_source.sort(key=lambda r: (r[0] is None, (r[0] or "").encode()))
    size = np.array([n for _, n in per_source], np.float64)
    w = np.array([weights[i % len(weights)] for i in range(len(size))], float)
    target = capped_shares(w, size, budget * size.sum(), repeat)
    blocks = sainte_lague(target, round(target.sum() / block_words), np.ceil(repeat * size / block_words).astype(np.int64))
    table = [
        (source, i, n, float(t), int(b), max(1, -(-n // shard_words)))
        for i, ((source, n), t, b) in enumerate(zip(per_source, target, blocks, strict=True))
    ]
    source_type = docs.schema[source_col].dataType
    fields = [T.StructField("m_source", source_type), T.StructField("number", T.LongType()), T.StructField("source_size", T.LongType()), T.StructField("target", T.DoubleType()), T.StructField("blocks", T.LongType()), T.StructField("shards", T.LongType())]
    sources = spark.createDataFrame(table, T.StructType(fields))

    def dealt(df: DataFrame) -> DataFrame:
        """Rows with their source's facts, the shard in the source, and its place in the line."""
        df = df.join(sources, F.col("source").eqNullSafe(F.col("m_source"))).drop("m_source")
        return df.withColumn("shard", F.pmod(F.xxhash64(F.col("id"), F.lit(seed)), F.col("shards")))

    shard = dealt(work).groupBy("number", "shard").agg(F.sum("size").alias("shard_size"), F.first("blocks").alias("blocks"))
    shard = shard.withColumns({"n_blocks": F.ceil(F.col("shard_size") / block_words), "repeat": F.lit(repeat)})
    quota = shard.groupBy("number").applyInPandas(_shard_quotas, "number long, shard long, n_blocks long, quota long")

    place = Window.partitionBy("number", "shard").orderBy(F.xxhash64(F.col("id"), F.lit(seed + 1)), "id", "size", "mark")
    # begin of the document in its shard's line of words
    line = dealt(wide).withColumn("begin", F.sum("size").over(place.rowsBetween(Window.unboundedPreceding, -1)))
    line = line.withColumn("begin", F.coalesce("begin", F.lit(0)))
    out = line.join(quota, ["number", "shard"])
    rest = F.col("quota") % F.greatest("n_blocks", F.lit(1))
    passes = F.floor(F.col("quota") / F.greatest("n_blocks", F.lit(1)))
    # the rest is every n-th block of the shard's line, from a seeded place on
    start = F.pmod(F.xxhash64("number", "shard", F.lit(seed + 2)), F.greatest("n_blocks", F.lit(1)))
    out = out.withColumns({"rest": rest, "passes": passes, "start": start})

    def span(pass_, first, last):
        return F.struct(pass_.cast("int").alias("pass"), first.cast("bigint").alias("first"), last.cast("bigint").alias("last"))

    def chosen(block):
        turn = F.pmod(block + F.col("start"), F.col("n_blocks"))
        # block k is chosen where the running count of rest / n_blocks steps up
        return F.floor((turn + 1) * F.col("rest") / F.col("n_blocks")) > F.floor(turn * F.col("rest") / F.col("n_blocks"))

    def piece(block):
        from_, to = F.greatest(F.col("begin"), block * block_words), F.least(F.col("begin") + F.col("size"), (block + 1) * block_words)
        return span(F.col("passes"), from_ - F.col("begin"), to - F.col("begin") - 1)

    nothing = F.array().cast("array<struct<pass:int,first:bigint,last:bigint>>")
    full = F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("passes") - 1), lambda p: span(p, F.lit(0), F.col("size") - 1))
    first, last = F.floor(F.col("begin") / block_words), F.floor((F.col("begin") + F.col("size") - 1) / block_words)
    some = F.transform(F.filter(F.sequence(first, last), chosen), piece)
    takes = F.concat(
        F.when((F.col("size") > 0) & (F.col("passes") > 0), full).otherwise(nothing),
        F.when((F.col("size") > 0) & (F.col("rest") > 0), some).otherwise(nothing),
    )
    out = out.withColumn("takes", takes)
    taken = F.aggregate("takes", F.lit(0).cast("bigint"), lambda n, t: n + t["last"] - t["first"] + 1)
    kept = [F.col(f"keep_{c}").alias(c) for c in keep if c not in (id_col, source_col, *RESULT, *PLACES)]
    names = [F.col("id").alias(id_col), F.col("source").alias(source_col)]
    return out.select(*names, *kept, "size", "source_size", "target", taken.alias("taken"), F.col("number").alias("source_number"), "shard", "begin", "takes")


def mix(docs: DataFrame, *args, **options) -> DataFrame:
    """The figures of ``spans``, which has the parameters: without the places and pieces."""
    return spans(docs, *args, **options).drop(*PLACES)


def _cut_batches(batches, n_text: int):
    """Pieces of each text, white space inside them as it stands."""
    word = re.compile(WORD)
    for batch in batches:
        row, cols = [], ([], [], [], [])
        for i, (text, begin, takes) in enumerate(zip(*(batch.column(k).to_pylist() for k in range(n_text, n_text + 3)), strict=True)):
            if not takes:
                continue
            at = np.array([m.span() for m in word.finditer(text)])
            for t in takes:
                row.append(i)
                for col, value in zip(cols, (t["pass"], begin + t["first"], begin + t["last"], text[at[t["first"], 0] : at[t["last"], 1]]), strict=True):
                    col.append(value)
        took = pa.array(row, pa.int64())
        types = (pa.int32(), pa.int64(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([*(batch.column(k).take(took) for k in range(n_text)), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], [*batch.schema.names[:n_text], "pass", "first", "last", "text"])


def mixed_texts(planned: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """The mixed corpus, of ``spans`` that keep the text: one row per piece.

    (id, source, source_number, shard, pass, first, last, text): first and last are words of the shard's
    line, so a shard's pieces by (pass, first) are its text in order.
    """
    names = [id_col, source_col, "source_number", "shard"]
    work = planned.select(*[F.col(f"`{c}`") for c in names], F.col(f"`{text_col}`").alias("_text"), "begin", "takes")
    schema = work.drop("_text", "begin", "takes").schema.add("pass", "integer").add("first", "long").add("last", "long").add("text", "string")
    return work.mapInArrow(partial(_cut_batches, n_text=len(names)), schema)
