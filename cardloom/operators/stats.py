"""Aggregations over the match, collection and inventory tables.

Counts are conditional aggregates, so every operator is one partial + final hash
aggregate; nothing but group totals crosses the network, however skewed a key is.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cardloom.functions.exprs import col, first_text, rate_band, win_rate
from cardloom.operators.ordered import HOT_ROWS, rolling_count

UNKNOWN_DECK = "Unknown Deck"


def _of_deck(matches: DataFrame, deck_id) -> DataFrame:
    return matches if deck_id is None else matches.filter(F.col("deck_id") == deck_id)


def _record():
    result = F.col("result")
    return [
        F.count_if(result == "win").alias("wins"),
        F.count_if(result == "loss").alias("losses"),
        F.count_if(result == "draw").alias("draws"),
    ]


def _rate():
    return win_rate(F.col("wins"), F.col("losses")).alias("win_rate")


def match_stats(matches: DataFrame, deck_id=None, by: Sequence[str] = ()) -> DataFrame:
    """Wins, losses, draws and win rate, over all matches or per ``by``."""
    m = _of_deck(matches, deck_id)
    return m.groupBy(*by).agg(*_record()).select("*", _rate())


def play_draw_stats(matches: DataFrame, deck_id=None) -> DataFrame:
    """Record on the play and on the draw; both rows exist even when empty."""
    m = _of_deck(matches, deck_id)
    win, loss = F.col("result") == "win", F.col("result") == "loss"
    play = F.coalesce(F.col("on_play"), F.lit(False))
    totals = m.agg(
        F.count_if(win & play).alias("pw"),
        F.count_if(loss & play).alias("pl"),
        F.count_if(win & ~play).alias("dw"),
        F.count_if(loss & ~play).alias("dl"),
    )
    sides = F.array(
        F.struct(F.lit(True).alias("on_play"), F.col("pw").alias("wins"), F.col("pl").alias("losses")),
        F.struct(F.lit(False).alias("on_play"), F.col("dw").alias("wins"), F.col("dl").alias("losses")),
    )
    return totals.select(F.inline(sides)).select("*", _rate())


def opponent_stats(matches: DataFrame, deck_id=None) -> DataFrame:
    """Record per opponent with the time last played, most played first."""
    m = _of_deck(matches, deck_id)
    per = m.groupBy("opponent_name").agg(
        *_record(),
        F.count_if(F.col("result").isin("win", "loss", "draw")).alias("total"),
        F.max("started_at").alias("last_played"),
    )
    return per.select("*", _rate()).orderBy(F.desc("total"), "opponent_name")


def format_stats(matches: DataFrame, deck_id=None) -> DataFrame:
    """Record per format (event id where the format is blank), most played first."""
    m = _of_deck(matches, deck_id)
    name = first_text(F.col("format"), F.col("event_id")).alias("format")
    per = m.groupBy(name).agg(
        *_record(),
        F.count_if(F.col("result").isin("win", "loss", "draw")).alias("total"),
    )
    return per.select("*", _rate()).orderBy(F.desc("total"), "format")


def recent_matches(matches: DataFrame, n: int = 50, by: Sequence[str] = ()) -> DataFrame:
    """Newest ``n`` matches, overall or per ``by``.

    Without ``by`` the plan is TakeOrderedAndProject; with it, the rank limit is
    applied per partition before the shuffle, so a hot player sends ``n`` rows a task.
    """
    newest = [F.desc("started_at"), F.desc("id")]
    if not by:
        return matches.orderBy(*newest).limit(n)
    ranked = matches.withColumn(
        "__rank", F.row_number().over(Window.partitionBy(*by).orderBy(*newest))
    )
    return ranked.filter(F.col("__rank") <= n).drop("__rank")


def deck_stats(matches: DataFrame, last_n: int | None = 100) -> DataFrame:
    """Record per deck name over the ``last_n`` newest matches (all when None)."""
    m = matches.select("id", "deck_name", "result", "started_at")
    if last_n is not None:
        m = recent_matches(m, last_n)
    name = F.coalesce(first_text(F.col("deck_name")), F.lit(UNKNOWN_DECK))
    per = m.groupBy(name.alias("deck_name")).agg(
        F.count_if(F.col("result") == "win").alias("wins"),
        F.count_if(F.col("result") == "loss").alias("losses"),
        F.count(F.lit(1)).alias("matches"),
    )
    return per.select("*", _rate()).orderBy(F.desc("matches"), "deck_name")


def deck_chart(stats: DataFrame, n: int = 10) -> DataFrame:
    """Most played ``n`` decks with the bar width against the best rate of all decks."""
    top_rate = stats.agg(F.greatest(F.max("win_rate"), F.lit(100.0)).alias("m")).scalar()
    top = stats.orderBy(F.desc("matches"), "deck_name").limit(n)
    return top.select(
        "deck_name",
        "matches",
        "win_rate",
        (F.col("win_rate") / top_rate * F.lit(100.0)).alias("width"),
        rate_band("win_rate").alias("band"),
    )


def session_stats(
    matches: DataFrame, now: datetime, week_start: str = "midnight", by: Sequence[str] = ()
) -> DataFrame:
    """Wins, decided matches and rate of today and of the week from Sunday.

    ``week_start='clock'`` starts the week at the clock time of ``now`` instead of 00:00.
    """
    today = now.replace(hour=0, minute=0, second=0, microsecond=0)
    sunday = now - timedelta(days=(now.weekday() + 1) % 7)
    week = sunday if week_start == "clock" else sunday.replace(
        hour=0, minute=0, second=0, microsecond=0
    )
    kind = matches.schema["started_at"].dataType.simpleString()
    since_day = F.lit(today.isoformat(sep=" ")).cast(kind)
    since_week = F.lit(week.isoformat(sep=" ")).cast(kind)
    started, result = F.col("started_at"), F.col("result")
    decided = result != "draw"
    counts = matches.filter(started >= F.least(since_day, since_week)).groupBy(*by).agg(
        F.count_if((started >= since_day) & (result == "win")).alias("today_wins"),
        F.count_if((started >= since_day) & decided).alias("today_decided"),
        F.count_if((started >= since_week) & (result == "win")).alias("week_wins"),
        F.count_if((started >= since_week) & decided).alias("week_decided"),
    )
    return counts.select(
        "*",
        *[
            F.when(
                F.col(f"{p}_decided") > 0,
                F.col(f"{p}_wins") / F.col(f"{p}_decided") * F.lit(100.0),
            ).alias(f"{p}_rate")
            for p in ("today", "week")
        ],
    )


def rolling_win_rate(
    matches: DataFrame,
    now: datetime,
    days: int = 30,
    k: int = 7,
    by: Sequence[str] = (),
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Win share of the last ``k`` matches at every match of the last ``days`` days.

    The denominator is ``k``, so draws count. A group with fewer than two points has none.
    """
    kind = matches.schema["started_at"].dataType.simpleString()
    since = F.lit((now - timedelta(days=days)).isoformat(sep=" ")).cast(kind)
    recent = matches.select(*by, "id", "started_at", "result").filter(
        F.col("started_at") >= since
    )
    rolled = rolling_count(
        recent, list(by), ["started_at", "id"], F.col("result") == "win", k, "__w", "__p", hot_rows
    )
    points = rolled.filter(F.col("__p") >= k).select(
        *by, "id", "started_at", (F.col("__w") / F.lit(k) * F.lit(100.0)).alias("win_rate")
    )
    if not by:
        size = recent.agg(F.count(F.lit(1)).alias("n")).scalar()
        return points.filter(size > k)
    enough = recent.groupBy(*by).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > k)
    return points.join(enough.select(*by), list(by), "left_semi")


def collection_stats(collection: DataFrame, mapping: DataFrame | None = None) -> DataFrame:
    """Total and distinct cards, overall (rarity null) and, with a mapping, per rarity."""
    sums = [
        F.coalesce(F.sum("quantity"), F.lit(0)).cast("bigint").alias("total_cards"),
        F.count(F.lit(1)).alias("unique_cards"),
    ]
    overall = collection.agg(*sums).select(F.lit(None).cast("string").alias("rarity"), "*")
    if mapping is None:
        return overall
    named = collection.join(mapping.select("grp_id", "rarity"), "grp_id", "left")
    per = named.groupBy(F.coalesce("rarity", F.lit("common")).alias("rarity")).agg(*sums)
    return overall.unionByName(per)


def inventory_view(history: DataFrame, by: Sequence[str] = ("player_id",)) -> DataFrame:
    """Latest snapshot per player, vault progress capped at 100."""
    facts = [c for c in history.columns if c not in by]
    latest = history.groupBy(*by).agg(
        F.max_by(F.struct(*facts), F.struct("recorded_at", "id")).alias("s")
    )
    out = latest.select(*by, "s.*")
    return out.withColumn("vault_progress", F.least("vault_progress", F.lit(100.0)))
