"""Order-dependent operators that stay parallel inside one hot key.

A plain ``Window.partitionBy(key).orderBy(seq)`` puts every row of a key into one
task. One log file, player or match may hold a third of all rows, so each operator
here works in three steps:

1. count the rows per key (map-side combined) and keep the keys above ``hot_rows``;
2. cut only those keys into chunks of about equal numbers of rows and run the window
   inside ``(key, chunk)``;
3. reduce each chunk to a small summary, run the prefix over the summaries, and hand
   the carry back to the rows of the chunk.

Chunks end at quantiles of a sample of the key's rows, taken over all order columns together, so
clustered values, far-off ones, nulls and ties on the first columns do not matter; only rows equal
in every order column share a chunk. Order columns may be of any type that can be ordered.

The cuts and the carry table have about ``rows / hot_rows`` (+ one per hot key) entries. They are
broadcast up to ``BROADCAST_ROWS`` entries; above that Spark chooses the join. A key of many chunks is
cut in levels of at most ``FAN`` chunks each, so a row is compared with a few cuts of its own group and
no group sorts more than ``FAN * SAMPLES`` sampled rows. Whether there is a hot key at all is asked
once, by a job over the key columns; without one the plan is the plain window and nothing is
joined. With one, a job per level samples the rows of the hot keys; the cuts are then fixed for the plan.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cardloom.functions.exprs import col
from cardloom.plans.staging import stage

HOT_ROWS = 2_000_000

SAMPLES = 64  # sampled rows per chunk: chunks are within twice hot_rows with all but certainty
FAN = 64  # chunks that one level of cuts makes of a group of rows
BROADCAST_ROWS = 100_000  # entries of a table that is broadcast, keys, cuts or chunks

_CHUNK, _HOT = "__chunk", "__hot"


def _same(left: Column, right: Column) -> Column:
    return left.eqNullSafe(right)


def _joined_to(df: DataFrame, entries: int) -> DataFrame:
    return F.broadcast(df) if entries <= BROADCAST_ROWS else df


@dataclass(frozen=True)
class Chunked:
    """Rows with a chunk number; chunks of cold keys are always 0."""

    df: DataFrame
    keys: tuple[str, ...]
    order: tuple[str, ...]
    hot: bool
    chunks: int = 0  # number of chunks of hot keys, roughly

    @property
    def window(self):
        return Window.partitionBy(*self._group()).orderBy(*[col(o) for o in self.order])

    def _group(self) -> list[Column]:
        keys = [col(k) for k in self.keys]
        return [*keys, F.col(_CHUNK)] if self.hot else keys

    def chunk_key(self) -> list[Column]:
        return [*[col(k) for k in self.keys], F.col(_CHUNK)]

    def summary(self, *aggs: Column) -> DataFrame:
        """One row per chunk of a hot key."""
        return self.df.filter(_HOT).groupBy(*self.chunk_key()).agg(*aggs)

    def prefix(self):
        """Frame over all earlier chunks of the key (runs on summaries only)."""
        keys = [col(k) for k in self.keys] or [F.lit(0)]
        return (
            Window.partitionBy(*keys)
            .orderBy(_CHUNK)
            .rowsBetween(Window.unboundedPreceding, -1)
        )

    def attach(
        self,
        rows: DataFrame,
        make_carry: Callable[[], DataFrame],
        like: Mapping[str, str],
    ) -> DataFrame:
        """Left-join the per-chunk carry back onto the rows.

        ``like`` names the carry columns and a column (or type) of the same type; without a
        hot key they are null and the carry is not even planned.
        """
        names = [*self.keys, _CHUNK]
        if not self.hot:
            types = {f.name: f.dataType for f in rows.schema.fields}
            nulls = [F.lit(None).cast(types.get(t, t)).alias(n) for n, t in like.items()]
            return rows.select("*", *nulls)
        carry = make_carry()
        renamed = carry.select(
            *[col(n).alias(f"__r{i}") for i, n in enumerate(names)],
            *[col(c) for c in carry.columns if c not in names],
        )
        on = reduce(
            lambda a, b: a & b,
            [_same(col(n), F.col(f"__r{i}")) for i, n in enumerate(names)],
        )
        joined = rows.join(_joined_to(renamed, self.chunks), on, "left")
        return joined.drop(*[f"__r{i}" for i in range(len(names))])


def split_hot(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    hot_rows: int = HOT_ROWS,
    sized_by: DataFrame | None = None,
) -> Chunked:
    """Number the chunks of every key that holds more than ``hot_rows`` rows.

    ``sized_by`` is a cheaper table with the same keys and order values (or more of them)
    to count and sample on.
    """
    names = [f"__h{i}" for i in range(len(keys))]
    source = (df if sized_by is None else sized_by).select(
        *[col(k).alias(n) for k, n in zip(keys, names, strict=True)], _order_struct(order).alias("__order")
    )
    size = F.count(F.lit(1)).alias("__n")
    chunks = F.ceil(F.col("__n") / F.lit(hot_rows)).alias("__chunks")
    counts = (source.groupBy(*names) if names else source.groupBy()).agg(size).filter(F.col("__n") > hot_rows).select("*", chunks)
    hot = _fixed(counts, counts.limit(BROADCAST_ROWS + 1).toArrow())
    n_keys, most, n_chunks = hot.agg(F.count(F.lit(1)), F.max("__chunks"), F.sum("__chunks")).head()
    if not n_keys:
        plain = df.select("*", F.lit(False).alias(_HOT), F.lit(0).cast("bigint").alias(_CHUNK))
        return Chunked(plain, tuple(keys), tuple(order), False)
    levels = _cuts(source, hot, names, most, n_keys, n_chunks)
    placed = _place(df.select("*", _order_struct(order).alias("__order")), list(keys), names, levels)
    return Chunked(placed.drop("__order"), tuple(keys), tuple(order), True, n_chunks)


def _fixed(df: DataFrame, held=None) -> DataFrame:
    """A table that is computed once: a local one, or a staged one where it has many rows.

    Another sample would give other cuts, so the plan must not compute it again.
    """
    if held is not None and held.num_rows <= BROADCAST_ROWS:
        return df.sparkSession.createDataFrame(held, df.schema)
    return stage(df, "cuts")


def _place(rows: DataFrame, keys: Sequence[str], names: Sequence[str], levels: Sequence[tuple[DataFrame, int]]) -> DataFrame:
    """Rows (with ``__order``) and their chunk so far; every level numbers the chunks inside those of the level before."""
    rows = rows.select("*", F.lit(False).alias(_HOT), F.lit(0).cast("bigint").alias(_CHUNK))
    base = [col(x) for x in rows.columns if x not in (_HOT, _CHUNK)]
    for cuts, entries in levels:
        renamed = cuts.select(*[F.col(n).alias(f"{n}_") for n in names], "__place", "__cuts", F.lit(True).alias("__in"))
        on = reduce(lambda a, b: a & b, [_same(col(k), F.col(f"{n}_")) for k, n in zip(keys, names, strict=True)], F.col(_CHUNK) == F.col("__place"))
        below = F.coalesce(F.size(F.filter("__cuts", lambda cut: cut <= F.col("__order"))), F.lit(0))
        found = rows.join(_joined_to(renamed, entries), on, "left")
        within = F.when(F.col("__cuts").isNotNull(), below).otherwise(F.lit(0))
        rows = found.select(
            *base, (F.col(_HOT) | F.coalesce("__in", F.lit(False))).alias(_HOT), (F.col(_CHUNK) * FAN + within).cast("bigint").alias(_CHUNK)
        )
    return rows


def _cuts(source: DataFrame, hot: DataFrame, names: Sequence[str], most: int, n_keys: int, n_chunks: int) -> list[tuple[DataFrame, int]]:
    """Tables (key, place, first order values of its chunks but the first) of each level, and their entries.

    The first level holds every hot key; a group that needs no cut has none.
    """
    depth = 1
    while FAN**depth < most:
        depth += 1
    levels: list[tuple[DataFrame, int]] = []
    made = F.lit(1).cast("bigint")
    for level in range(depth):
        fan = F.least(F.lit(FAN), F.ceil(F.col("__chunks") / F.lit(FAN ** (depth - 1 - level))))
        # a group of this level has about n / made rows
        share = F.lit(SAMPLES) * fan * made / F.col("__n")
        wanted = hot.select(*[F.col(n).alias(f"{n}_") for n in names], fan.alias("__fan"), share.alias("__share")).filter("__fan > 1")
        made = made * fan
        placed = _place(source, names, names, levels)
        on = reduce(lambda a, b: a & b, [_same(F.col(n), F.col(f"{n}_")) for n in names], F.lit(True))
        sampled = placed.join(_joined_to(wanted, n_keys), on).filter(F.rand(7 + level) < F.col("__share"))
        per_group = sampled.groupBy(*names, F.col(_CHUNK).alias("__place"), "__fan").agg(F.sort_array(F.collect_list("__order")).alias("__s"))
        at = lambda i: F.floor(i * F.size("__s") / F.col("__fan")).cast("int") + 1
        cuts = F.transform(F.sequence(F.lit(1), F.col("__fan").cast("int") - 1), lambda i: F.element_at("__s", at(i)))
        found = per_group.select(*names, "__place", F.array_distinct(cuts).alias("__cuts"))
        entries = n_chunks if level == depth - 1 else min(n_chunks, n_keys * FAN ** (level + 1))
        fixed = _fixed(found, found.toArrow() if entries <= BROADCAST_ROWS else None)
        if level == 0:
            again = hot.select(*[F.col(n).alias(f"{n}_") for n in names])
            fixed = again.join(_joined_to(fixed, entries), on, "left").select(
                *[F.col(f"{n}_").alias(n) for n in names], F.lit(0).cast("bigint").alias("__place"), "__cuts"
            )
        levels.append((fixed, entries))
    return levels


def _order_struct(order: Sequence[str]) -> Column:
    return F.struct(*[col(o).alias(f"o{i}") for i, o in enumerate(order)])


def running_last(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    values: Mapping[str, Column],
    inclusive: bool = True,
    hot_rows: int = HOT_ROWS,
    cut: Chunked | None = None,
) -> DataFrame:
    """Add, per output name, the last non-null value up to (or before) each row.

    ``cut``: chunks of the same keys and order, whose columns ``df`` still holds; they are kept.
    """
    tmp = {name: f"__v{i}" for i, name in enumerate(values)}
    valued = df.select("*", *[v.alias(tmp[n]) for n, v in values.items()])
    c = split_hot(valued, keys, order, hot_rows) if cut is None else replace(cut, df=valued)
    frame = c.window.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    rows = c.df.select(
        "*", *[F.last(t, ignorenulls=True).over(frame).alias(f"{t}_in") for t in tmp.values()]
    )

    def carry() -> DataFrame:
        at = _order_struct(order)
        latest = c.summary(
            *[
                F.max_by(F.col(t), F.when(F.col(t).isNotNull(), at)).alias(t)
                for t in tmp.values()
            ]
        )
        return latest.select(
            *c.chunk_key(),
            *[
                F.last(t, ignorenulls=True).over(c.prefix()).alias(f"{t}_before")
                for t in tmp.values()
            ],
        )

    out = c.attach(rows, carry, {f"{t}_before": f"{t}_in" for t in tmp.values()})
    picked = [
        F.coalesce(F.col(f"{t}_in"), F.col(f"{t}_before")).alias(n) for n, t in tmp.items()
    ]
    keep = [col(x) for x in df.columns if x not in values]
    return out.select(*keep, *picked)


def previous(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    values: Mapping[str, Column],
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Add the values of the row just before; null on the first row of a key."""
    boxed = {n: F.struct(v.alias("x")) for n, v in values.items()}
    out = running_last(df, keys, order, boxed, inclusive=False, hot_rows=hot_rows)
    keep = [col(x) for x in df.columns if x not in values]
    return out.select(*keep, *[F.col(f"{n}.x").alias(n) for n in values])


def row_positions(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    out: str = "position",
    total: str | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Add the 1-based position of each row in its key, and the key's row count."""
    c = split_hot(df, keys, order, hot_rows)
    rows = c.df.select("*", F.row_number().over(c.window).alias("__rn"))

    def carry() -> DataFrame:
        counts = c.summary(F.count(F.lit(1)).alias("__cn"))
        return counts.select(*c.chunk_key(), F.sum("__cn").over(c.prefix()).alias("__off"))

    placed = c.attach(rows, carry, {"__off": "bigint"})
    base = [col(x) for x in df.columns]
    pos = (F.col("__rn") + F.coalesce(F.col("__off"), F.lit(0))).cast("bigint").alias(out)
    placed = placed.select(*base, pos)
    if total is None:
        return placed
    sizes = (df.groupBy(*[col(k) for k in keys]) if keys else df.groupBy()).agg(
        F.count(F.lit(1)).alias(total)
    )
    if not keys:
        return placed.select("*", sizes.scalar().alias(total))
    renamed = sizes.select(
        *[col(k).alias(f"__s{i}") for i, k in enumerate(keys)], total
    )
    on = reduce(
        lambda a, b: a & b,
        [_same(col(k), F.col(f"__s{i}")) for i, k in enumerate(keys)],
    )
    return placed.join(renamed, on, "left").drop(*[f"__s{i}" for i in range(len(keys))])


def running_sum(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    values: Mapping[str, Column],
    hot_rows: int = HOT_ROWS,
    cut: Chunked | None = None,
) -> DataFrame:
    """Add inclusive running sums of whole numbers; ``cut`` as in ``running_last``."""
    tmp = {name: f"__v{i}" for i, name in enumerate(values)}
    valued = df.select("*", *[v.alias(tmp[n]) for n, v in values.items()])
    c = split_hot(valued, keys, order, hot_rows) if cut is None else replace(cut, df=valued)
    frame = c.window.rowsBetween(Window.unboundedPreceding, 0)
    rows = c.df.select("*", *[F.sum(t).over(frame).alias(f"{t}_in") for t in tmp.values()])

    def carry() -> DataFrame:
        sums = c.summary(*[F.sum(t).alias(t) for t in tmp.values()])
        before = [F.sum(t).over(c.prefix()).alias(f"{t}_before") for t in tmp.values()]
        return sums.select(*c.chunk_key(), *before)

    out = c.attach(rows, carry, {f"{t}_before": f"{t}_in" for t in tmp.values()})
    zero = F.lit(0)
    picked = [
        (F.coalesce(F.col(f"{t}_in"), zero) + F.coalesce(F.col(f"{t}_before"), zero)).alias(n)
        for n, t in tmp.items()
    ]
    keep = [col(x) for x in df.columns if x not in values]
    return out.select(*keep, *picked)


def rolling_count(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    flag: Column,
    k: int,
    out: str,
    seen: str,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Count true flags over the last ``k`` rows; ``seen`` is the row's position.

    The carry of a chunk is the tail of ``k - 1`` flags before it. Every chunk that
    exists has a row, so the tails of the ``k - 1`` chunks before suffice.
    """
    flagged = df.select("*", F.when(flag, 1).otherwise(0).alias("__f"))
    c = split_hot(flagged, keys, order, hot_rows)
    last_k = c.window.rowsBetween(-(k - 1), 0)
    back = Window.partitionBy(*c._group()).orderBy(
        *[col(o).desc_nulls_last() for o in order]
    )
    rows = c.df.select(
        "*",
        F.row_number().over(c.window).alias("__rn"),
        F.sum("__f").over(last_k).alias("__in"),
    )

    def carry() -> DataFrame:
        tails = (
            c.df.filter(_HOT).select(*c.chunk_key(), "__f", F.row_number().over(back).alias("__b"))
            .filter(F.col("__b") < k)
            .groupBy(*c.chunk_key())
            .agg(
                F.sort_array(
                    F.collect_list(F.struct((-F.col("__b")).alias("p"), "__f"))
                ).alias("__t")
            )
        )
        names = [*c.keys, _CHUNK]
        counts = c.summary(F.count(F.lit(1)).alias("__cn")).select(
            *[col(x).alias(f"__k{i}") for i, x in enumerate(names)], "__cn"
        )
        on = reduce(
            lambda a, b: a & b, [_same(col(x), F.col(f"__k{i}")) for i, x in enumerate(names)]
        )
        keyed = Window.partitionBy(*([col(x) for x in c.keys] or [F.lit(0)])).orderBy(_CHUNK)
        joined_tails = F.flatten(
            F.collect_list(F.col("__t.__f")).over(keyed.rowsBetween(-(k - 1), -1))
        )
        return tails.join(counts, on).select(
            *c.chunk_key(),
            F.sum("__cn").over(c.prefix()).alias("__off"),
            F.reverse(joined_tails).alias("__back"),
        )

    placed = c.attach(rows, carry, {"__off": "bigint", "__back": "array<int>"})
    missing = F.greatest(F.lit(k) - F.col("__rn"), F.lit(0))
    before = F.aggregate(
        F.slice(F.coalesce(F.col("__back"), F.array().cast("array<int>")), F.lit(1), missing),
        F.lit(0),
        lambda a, x: a + x,
    )
    return placed.select(
        *[col(x) for x in df.columns],
        (F.col("__in") + before).cast("bigint").alias(out),
        (F.col("__rn") + F.coalesce(F.col("__off"), F.lit(0))).cast("bigint").alias(seen),
    )
