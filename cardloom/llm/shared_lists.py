"""Hard negatives by inner product: anchor clusters walk shared candidate lists (MAXIMUS style).

Anchors are clustered by direction. For a cluster with centre c whose members lie within the angle
t of c, a candidate x at angle a to c has an inner product of at most |anchor| |x| cos(max(a - t, 0))
with every member. In each block of candidates a cluster sorts that bound once; all members walk the
one list from the top, in steps, and a member stops when the bound of what follows is below what it
still looks for: its k-th best so far, a floor known beforehand, or the lower end of its score range.
Bounds are widened by more than the rounding error of the angles, scores are exact integers, and a
walk goes on while the bound equals the k-th score, so ties by id are right and nothing is lost.

The walk is done twice: for the positives of each anchor (best rows of its label), then for the
negatives in the score range that each positive gives. Floors come from the same walk over the
anchors themselves, which are rows of the table as well. Every task gives its best rows per anchor
(or per anchor and positive) and a window takes the best of all tasks, so the result does not
depend on how rows are dealt.

Anchors are read in groups of ``group_anchors``, the only part that is sent to the tasks and whose
positives reach the driver; each group is a pass over the stored candidates. A hot label or a vector
with many copies is spread over all tasks like any other row.

Rows with a null label, a null vector or any null, NaN or infinite component take no part. Missing
components of a shorter vector count as 0, so an empty vector scores 0. Repeated rows and ids count
each; a row is never its own partner, but an equal row is one. Null ids come after all others in ties. An
empty table, or one without anchors, gives no rows. Vectors whose inner products could leave 64 bits
end the job with an error. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cardloom.llm.pivot_clusters import usable, whole_numbers
from cardloom.llm.shared import new_path, stage

SCALE = 256
POSITIVES = 5
NEGATIVES = 10
LOW_PCT, HIGH_PCT = 30, 90
GROUP_ANCHORS = 20_000
MEMBERS = 16  # anchors of a cluster, on average
BLOCK_ROWS = 16_384  # candidates of a list
STEP = 256  # candidates a walk takes at once
ANGLE_SLACK = 1e-6  # over the rounding error of arccos near 0
_LEAST, _GREATEST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


class Block:
    """Vectors with id, label and row key."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, no_id: np.ndarray, labels: np.ndarray, keys: np.ndarray):
        self.vectors, self.ids, self.no_id, self.labels, self.keys = vectors, ids, no_id, labels, keys
        self.norm = np.sqrt((vectors.astype(np.float64) ** 2).sum(axis=1))
        self.greatest = max(int(vectors.max(initial=0)), -int(vectors.min(initial=0)))

    def __len__(self) -> int:
        return len(self.ids)

    def directions(self) -> np.ndarray:
        return self.vectors / np.maximum(self.norm, 1e-300)[:, None]

    @classmethod
    def of_batches(cls, batches: list[pa.RecordBatch], width: int | None = None) -> Block:
        table = pa.Table.from_batches(batches).combine_chunks()
        ids = table.column("__id")
        return cls(
            padded(table.column("__v").combine_chunks(), width),
            ids.fill_null(0).to_numpy().astype(np.int64),
            ids.is_null().to_numpy(),
            table.column("__label").to_numpy().astype(np.int64),
            table.column("__key").to_numpy().astype(np.int64),
        )


def padded(column: pa.Array, width: int | None) -> np.ndarray:
    """Lists as a matrix of ``width`` columns (default: the longest list), short ones filled with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    sizes = np.diff(column.offsets.to_numpy())
    if width is None:
        width = int(sizes.max(initial=1)) or 1
    if (sizes == width).all():
        return flat.reshape(len(column), width)
    out = np.zeros((len(column), width), np.int64)
    row = np.repeat(np.arange(len(column)), sizes)
    at = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[row[at < width], at[at < width]] = flat[at < width]
    return out


class Anchors(Block):
    """A group of anchors, clustered by direction."""

    def __init__(self, block: Block, members: int = MEMBERS):
        self.__dict__.update(block.__dict__)
        unit = self.directions()
        count = max(1, len(self) // members)
        centres = unit[:: max(1, len(self) // count)][:count].copy()
        for _ in range(5):
            own = (unit @ centres.T).argmax(axis=1)
            for c in range(len(centres)):
                mean = unit[own == c].sum(axis=0)
                size = np.sqrt((mean**2).sum())
                if size > 0:
                    centres[c] = mean / size
        own = (unit @ centres.T).argmax(axis=1)
        self.clusters = []
        for c in range(len(centres)):
            all_own = np.flatnonzero(own == c)
            for at in range(0, len(all_own), 4 * members):  # bounds what a step holds
                mine = all_own[at : at + 4 * members]
                spread = np.arccos(np.clip(unit[mine] @ centres[c], -1, 1)).max()
                self.clusters.append((mine, centres[c], float(spread)))


class Wanted:
    """Searches by anchor: best ``top`` rows of the same (or another) label with scores in [low, high]."""

    def __init__(self, anchor: np.ndarray, low: np.ndarray, high: np.ndarray, top: int, same: bool):
        self.anchor, self.low, self.high, self.top, self.same = anchor, low, high, top, same

    def of_anchors(self, count: int) -> list[np.ndarray]:
        order = np.argsort(self.anchor, kind="stable")
        return np.split(order, np.searchsorted(self.anchor[order], np.arange(1, count)))


class Found:
    """Best rows of every search so far."""

    def __init__(self, wanted: Wanted):
        n = len(wanted.anchor)
        self.top = wanted.top
        self.score = np.full((n, self.top), _LEAST)
        self.id = np.zeros((n, self.top), np.int64)
        self.no_id = np.zeros((n, self.top), bool)
        self.count = np.zeros(n, np.int64)

    def add(self, search: np.ndarray, score: np.ndarray, ids: np.ndarray, no_id: np.ndarray) -> None:
        touched = np.unique(search)
        old = np.arange(self.top)[None, :] < self.count[touched][:, None]
        search = np.concatenate([np.repeat(touched, self.count[touched]), search])
        score = np.concatenate([self.score[touched][old], score])
        ids = np.concatenate([self.id[touched][old], ids])
        no_id = np.concatenate([self.no_id[touched][old], no_id])
        order = np.lexsort((ids, no_id, -score, search))
        search = search[order]
        start = np.searchsorted(search, touched)
        rank = np.arange(len(search)) - np.repeat(start, np.diff(np.append(start, len(search))))
        best = rank < self.top
        order, search, rank = order[best], search[best], rank[best]
        self.score[search, rank], self.id[search, rank], self.no_id[search, rank] = score[order], ids[order], no_id[order]
        self.count[touched] = np.bincount(np.searchsorted(touched, search), minlength=len(touched))

    def worst(self) -> np.ndarray:
        """Score of the last row of full searches, else the least number."""
        return np.where(self.count == self.top, self.score[:, -1], _LEAST)


def exact_products(left: np.ndarray, right: np.ndarray, greatest: int) -> np.ndarray:
    """Integer inner products; ``greatest``: bound of their absolute value."""
    if greatest < 1 << 53:  # every partial sum is exact in a double
        return (left.astype(np.float64) @ right.T.astype(np.float64)).astype(np.int64)
    return left @ right.T


def walk(anchors: Anchors, block: Block, wanted: Wanted, found: Found, step: int = STEP) -> int:
    """Take a block's rows into ``found``; returns the number of scores computed."""
    greatest = anchors.greatest * block.greatest * anchors.vectors.shape[1]
    if greatest >= 1 << 55:  # a hundredfold score still fits
        raise ValueError("inner products could leave 64 bits")
    unit = block.directions()
    searches = wanted.of_anchors(len(anchors))
    scored = 0
    for members, centre, spread in anchors.clusters:
        mine = np.concatenate([searches[m] for m in members])
        if not len(mine):
            continue
        angle = np.arccos(np.clip(unit @ centre, -1, 1))
        cosine = np.cos(np.maximum(angle - spread - ANGLE_SLACK, 0.0))
        bound = block.norm * (cosine + ANGLE_SLACK)
        order = np.argsort(-bound, kind="stable")
        bound = bound[order]
        size = anchors.norm[wanted.anchor[mine]]
        for at in range(0, len(order), step):
            least = np.maximum(wanted.low[mine], found.worst()[mine])
            going = size * bound[at] >= least
            mine, size, least = mine[going], size[going], least[going]
            if not len(mine):
                break
            rows = order[at : at + step]
            who, back = np.unique(wanted.anchor[mine], return_inverse=True)
            score = exact_products(anchors.vectors[who], block.vectors[rows], greatest)
            scored += score.size
            alike = anchors.labels[who][:, None] == block.labels[rows][None, :]
            good = (alike & (anchors.keys[who][:, None] != block.keys[rows][None, :])) if wanted.same else ~alike
            mark = score[back]
            good = good[back] & (mark >= least[:, None]) & (mark <= wanted.high[mine][:, None])
            which, row = np.nonzero(good)
            if len(which):
                found.add(mine[which], mark[which, row], block.ids[rows[row]], block.no_id[rows[row]])
    return scored


def _search_batches(batches: Iterator[pa.RecordBatch], group, wanted: Wanted, floors: np.ndarray):
    """A task's best rows of every search: (search, score, id)."""
    anchors = group.value
    wanted = Wanted(wanted.anchor, np.maximum(wanted.low, floors), wanted.high, wanted.top, wanted.same)
    found = Found(wanted)
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK_ROWS):
            held.append(batch.slice(at, BLOCK_ROWS))
            rows += held[-1].num_rows
            if rows >= BLOCK_ROWS:
                walk(anchors, Block.of_batches(held, anchors.vectors.shape[1]), wanted, found)
                held, rows = [], 0
    if rows:
        walk(anchors, Block.of_batches(held, anchors.vectors.shape[1]), wanted, found)
    full = np.arange(found.top)[None, :] < found.count[:, None]
    search = np.repeat(np.arange(len(found.count)), found.count)
    for at in range(0, len(search), 100_000):
        part = slice(at, at + 100_000)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(search[part], pa.int32()),
                pa.array(found.score[full][part], pa.int64()),
                pa.array(found.id[full][part], pa.int64(), mask=found.no_id[full][part]),
            ],
            ["search", "score", "found_id"],
        )


def _best(rows: DataFrame, anchors: Anchors, wanted: Wanted) -> DataFrame:
    """(search, rank, score, found_id): the best rows of each search over all candidates."""
    spark = rows.sparkSession
    own = Found(wanted)
    walk(anchors, anchors, wanted, own)
    group = spark.sparkContext.broadcast(anchors)  # at most group_anchors vectors
    parts = rows.mapInArrow(
        partial(_search_batches, group=group, wanted=wanted, floors=own.worst()), "search int, score long, found_id long"
    )
    order = Window.partitionBy("search").orderBy(F.desc("score"), F.asc_nulls_last("found_id"))
    return parts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= wanted.top)


def _groups(rows: DataFrame, is_anchor: Column, size: int) -> Iterator[Anchors]:
    """The anchors in groups; the driver holds one group and one partition of anchors at a time."""
    held: list = []

    def group() -> Anchors:
        fields = ("__key", "__id", "__label", "__v")
        types = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
        arrays = [pa.array([r[f] for r in held], t) for f, t in zip(fields, types, strict=True)]
        return Anchors(Block.of_batches([pa.RecordBatch.from_arrays(arrays, list(fields))]))

    for r in rows.filter(is_anchor).toLocalIterator():
        held.append(r)
        if len(held) == size:
            yield group()
            held = []
    if held:
        yield group()


def divided(a: np.ndarray, b: int) -> np.ndarray:
    """Ceiling of a / b."""
    return -(-a // b)


def hard_negatives(
    rows: DataFrame,
    is_anchor: Column,
    id_col: str = "vec_id",
    label: Column | None = None,
    vec_col: str = "embedding",
    scale: int = SCALE,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low_pct: int = LOW_PCT,
    high_pct: int = HIGH_PCT,
    group_anchors: int = GROUP_ANCHORS,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``is_anchor``: condition on the columns of ``rows``. A negative's score lies between ``low_pct`` and
    ``high_pct`` hundredths of its positive's.
    """
    spark = rows.sparkSession
    label = F.col("label") if label is None else label
    vec = F.col(f"`{vec_col}`")
    kept = rows.filter(usable(vec) & label.isNotNull())
    table = stage(
        kept.select(
            F.monotonically_increasing_id().alias("__key"),
            F.col(f"`{id_col}`").cast("long").alias("__id"),
            label.cast("long").alias("__label"),
            whole_numbers(vec, scale).alias("__v"),
            F.coalesce(is_anchor, F.lit(False)).alias("__anchor"),
        ),
        "candidates",
    )
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    path = None
    for anchors in _groups(table, F.col("__anchor"), group_anchors):
        n = len(anchors)
        any_score = Wanted(np.arange(n), np.full(n, _LEAST), np.full(n, _GREATEST), positives, same=True)
        best = sorted(_best(table, anchors, any_score).select("search", "rank", "score", "found_id").collect())
        if not best:
            continue
        anchor = np.array([r["search"] for r in best], np.int64)
        score = np.array([r["score"] for r in best], np.int64)
        ranges = Wanted(anchor, divided(score * low_pct, 100), score * high_pct // 100, negatives, same=False)
        told = [
            (i, None if anchors.no_id[r["search"]] else int(anchors.ids[r["search"]]), r["found_id"], r["score"])
            for i, r in enumerate(best)
        ]
        # at most positives x group_anchors rows
        names = spark.createDataFrame(told, "search int, anchor_id long, positive_id long, positive_score long")
        negative = _best(table, anchors, ranges).join(F.broadcast(names), "search").withColumnsRenamed(
            {"found_id": "negative_id", "score": "negative_score"}
        )
        path = path or new_path(spark, "negatives")
        columns = [c.split()[0] for c in schema.split(", ")]
        negative.select(columns).write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path) if path else spark.createDataFrame([], schema)
