"""Statistics and reports over the match records."""

from datetime import date, datetime

from pyspark.sql import functions as F

from cardloom.bindings.registry import MAPPING_SQL, MATCHES_SQL, mapping, matches, query, table, view
from cardloom.functions import formats
from cardloom.functions.exprs import rate_band
from cardloom.operators import report, stats

NOW = datetime(2001, 7, 25, 15, 30)
END = datetime(2001, 8, 1)

W = "count(*) FILTER (WHERE result = 'win')"
L = "count(*) FILTER (WHERE result = 'loss')"
D = "count(*) FILTER (WHERE result = 'draw')"
RATE = (
    f"CASE WHEN {W} + {L} > 0 THEN CAST({W} AS DOUBLE) / ({W} + {L}) * 100 ELSE CAST(0 AS DOUBLE) END"
)
RECORD = f"{W} AS wins, {L} AS losses, {D} AS draws, {RATE} AS win_rate"


def _m(body: str) -> str:
    return f"WITH {MATCHES_SQL} {body}"


@query("match_stats", _m(f"SELECT {RECORD} FROM matches"))
def _(spark, sf):
    return stats.match_stats(matches(spark, sf))


@query("match_stats_of_deck", _m(f"SELECT {RECORD} FROM matches WHERE deck_id = 7"))
def _(spark, sf):
    return stats.match_stats(matches(spark, sf), deck_id=7)


@query(
    "play_draw_stats",
    _m(f"SELECT on_play, {W} AS wins, {L} AS losses, {RATE} AS win_rate FROM matches GROUP BY on_play"),
)
def _(spark, sf):
    return stats.play_draw_stats(matches(spark, sf))


@query(
    "play_draw_stats_of_deck",
    _m(
        f"SELECT on_play, {W} AS wins, {L} AS losses, {RATE} AS win_rate FROM matches "
        "WHERE deck_id = 3 GROUP BY on_play"
    ),
)
def _(spark, sf):
    return stats.play_draw_stats(matches(spark, sf), deck_id=3)


@query(
    "opponent_stats",
    _m(
        f"SELECT opponent_name, {RECORD}, count(*) AS total, max(started_at) AS last_played "
        "FROM matches GROUP BY opponent_name"
    ),
)
def opponent_stats(spark, sf):
    return stats.opponent_stats(matches(spark, sf))


@query(
    "format_stats",
    _m(
        f"SELECT CASE WHEN format = '' THEN event_id ELSE format END AS format, {RECORD}, "
        "count(*) AS total FROM matches GROUP BY 1"
    ),
)
def _(spark, sf):
    return stats.format_stats(matches(spark, sf))


DECK_STATS = f"""
  SELECT CASE WHEN deck_name = '' THEN 'Unknown Deck' ELSE deck_name END AS deck_name,
    {W} AS wins, {L} AS losses, count(*) AS matches, {RATE} AS win_rate
  FROM {{source}} GROUP BY 1"""
LAST_100 = "(SELECT * FROM matches ORDER BY started_at DESC, id DESC LIMIT 100)"


@query("deck_stats", _m(DECK_STATS.format(source=LAST_100)))
def _(spark, sf):
    return stats.deck_stats(matches(spark, sf))


@query("deck_stats_all", _m(DECK_STATS.format(source="matches")))
def _(spark, sf):
    return stats.deck_stats(matches(spark, sf), last_n=None)


@query(
    "deck_chart",
    _m(
        f""", s AS ({DECK_STATS.format(source="matches")})
        SELECT deck_name, matches, win_rate,
          win_rate / greatest((SELECT max(win_rate) FROM s), 100) * 100 AS width,
          CASE WHEN win_rate >= 55 THEN 'positive' WHEN win_rate <= 45 THEN 'negative'
            ELSE 'neutral' END AS band
        FROM s ORDER BY matches DESC, deck_name LIMIT 10"""
    ),
)
def _(spark, sf):
    return stats.deck_chart(stats.deck_stats(matches(spark, sf), last_n=None))


def _session(since_day: str, since_week: str) -> str:
    cols = []
    for name, since in (("today", since_day), ("week", since_week)):
        t = f"TIMESTAMP '{since}'"
        won = f"count(*) FILTER (WHERE started_at >= {t} AND result = 'win')"
        dec = f"count(*) FILTER (WHERE started_at >= {t} AND result <> 'draw')"
        cols += [
            f"{won} AS {name}_wins",
            f"{dec} AS {name}_decided",
            f"CASE WHEN {dec} > 0 THEN CAST({won} AS DOUBLE) / {dec} * 100 END AS {name}_rate",
        ]
    return _m(f"SELECT {', '.join(cols)} FROM matches")


@query("session_stats", _session("2001-07-25 00:00:00", "2001-07-22 00:00:00"))
def _(spark, sf):
    return stats.session_stats(matches(spark, sf), NOW)


@query("session_stats_clock_week", _session("2001-07-25 00:00:00", "2001-07-22 15:30:00"))
def _(spark, sf):
    return stats.session_stats(matches(spark, sf), NOW, week_start="clock")


def _rolling(by: str, since: str) -> str:
    part = f"PARTITION BY {by}" if by else ""
    cols = f"{by}, " if by else ""
    return _m(
        f""", r AS (
          SELECT {cols} id, started_at,
            sum(CASE WHEN result = 'win' THEN 1 ELSE 0 END) OVER w7 AS wins,
            row_number() OVER (w) AS p, count(*) OVER ({part}) AS n
          FROM matches WHERE started_at >= TIMESTAMP '{since}'
          WINDOW w AS ({part} ORDER BY started_at, id),
            w7 AS ({part} ORDER BY started_at, id ROWS BETWEEN 6 PRECEDING AND CURRENT ROW))
        SELECT {cols} id, started_at, CAST(wins AS DOUBLE) / 7 * 100 AS win_rate
        FROM r WHERE p >= 7 AND n > 7"""
    ).replace("OVER (w)", "OVER w")


@query("rolling_win_rate", _rolling("", "2001-07-02 00:00:00"))
def _(spark, sf):
    return stats.rolling_win_rate(matches(spark, sf), END)


@query("rolling_win_rate_by_opponent", _rolling("opponent_name", "1990-08-18 00:00:00"))
def _(spark, sf):
    return stats.rolling_win_rate(matches(spark, sf), END, days=4000, by=["opponent_name"])


COLLECTION_COLUMNS = """
    user_id AS player_id, event_id AS seq, ts AS upd,
    CAST(get_json_object(props, '$.k') AS BIGINT) AS grp_id,
    CAST(floor(value) AS BIGINT) AS quantity
"""
COLLECTION_SQL = """ownings AS (
  SELECT user_id AS player_id, event_id AS seq, ts AS upd,
    CAST(json_extract_string(props, '$.k') AS BIGINT) AS grp_id,
    CAST(floor(value) AS BIGINT) AS quantity FROM events),
  collection AS (
    SELECT player_id, grp_id, arg_max(quantity, seq) AS quantity, arg_max(upd, seq) AS updated_at
    FROM ownings GROUP BY player_id, grp_id)"""


def ownings(spark, sf):
    return view(table(spark, sf, "events"), COLLECTION_COLUMNS)


@query(
    "collection_stats",
    f"""WITH {MAPPING_SQL}, {COLLECTION_SQL}
    SELECT NULL AS rarity, CAST(sum(quantity) AS BIGINT) AS total_cards, count(*) AS unique_cards
    FROM collection
    UNION ALL
    SELECT coalesce(rarity, 'common'), CAST(sum(quantity) AS BIGINT), count(*)
    FROM collection LEFT JOIN mapping USING (grp_id) GROUP BY 1""",
)
def _(spark, sf):
    from cardloom.operators.fold import fold_collection

    return stats.collection_stats(fold_collection(ownings(spark, sf), at="upd"), mapping(spark, sf))


@query(
    "rate_band",
    _m(
        f"""SELECT opponent_name, on_play,
          CASE WHEN {RATE} >= 55 THEN 'positive' WHEN {RATE} <= 45 THEN 'negative'
            ELSE 'neutral' END AS band
        FROM matches GROUP BY opponent_name, on_play"""
    ),
)
def _(spark, sf):
    per = stats.match_stats(matches(spark, sf), by=["opponent_name", "on_play"])
    return per.select("opponent_name", "on_play", rate_band("win_rate").alias("band"))


@query(
    "recent_matches",
    _m("SELECT id, opponent_name, result, started_at FROM matches ORDER BY started_at DESC, id DESC LIMIT 50"),
)
def _(spark, sf):
    m = matches(spark, sf).select("id", "opponent_name", "result", "started_at")
    return stats.recent_matches(m)


@query(
    "recent_matches_by_deck",
    _m(
        """SELECT deck_id, id, started_at FROM matches
        QUALIFY row_number() OVER (PARTITION BY deck_id ORDER BY started_at DESC, id DESC) <= 5"""
    ),
)
def _(spark, sf):
    m = matches(spark, sf).select("deck_id", "id", "started_at")
    return stats.recent_matches(m, 5, by=["deck_id"])


SNAPSHOT_COLUMNS = """
    user_id AS player_id, event_id AS id, ts AS recorded_at,
    CAST(floor(value * 100) AS BIGINT) AS gems, value AS vault_progress
"""


@query(
    "inventory_view",
    f"""WITH h AS (SELECT {SNAPSHOT_COLUMNS} FROM events)
    SELECT player_id, id, recorded_at, gems, least(vault_progress, 100) AS vault_progress FROM h
    QUALIFY row_number() OVER (PARTITION BY player_id ORDER BY recorded_at DESC, id DESC) = 1""",
)
def _(spark, sf):
    return stats.inventory_view(view(table(spark, sf, "events"), SNAPSHOT_COLUMNS))


# --- reports ---------------------------------------------------------------------------


@query(
    "filter_matches",
    _m(
        """SELECT id, format, event_id, result, deck_name, started_at FROM matches
        WHERE (lower(format) LIKE '%low%' OR lower(event_id) LIKE '%low%') AND result = 'win'
          AND lower(deck_name) LIKE '%deck 1%'
          AND started_at >= TIMESTAMP '1996-02-01' AND started_at < TIMESTAMP '1999-03-16'"""
    ),
)
def _(spark, sf):
    m = matches(spark, sf).select("id", "format", "event_id", "result", "deck_name", "started_at")
    return report.filter_matches(
        m, "LOW", "win", "DECK 1", date(1996, 2, 1), date(1999, 3, 15)
    )


def _contains_case(expr: str, pairs, default: str) -> str:
    whens = " ".join(f"WHEN contains(lower({expr}), '{p.lower()}') THEN '{n}'" for p, n in pairs)
    return f"CASE {whens} ELSE {default} END"


def _exact_case(expr: str, pairs) -> str:
    return "CASE " + " ".join(f"WHEN {expr} = '{p}' THEN '{n}'" for p, n in pairs) + " END"


STRIPPED = "e"
for _suffix in formats.SUFFIXES:
    STRIPPED = f"regexp_replace({STRIPPED}, '{_suffix}', '')"
SPACED = "regexp_replace(s, '([a-z])([A-Z])', '\\1 \\2', 'g')"
FULL_NAME = f"""CASE WHEN e = '' THEN 'Unknown' ELSE coalesce({_exact_case('e', formats.FORMAT_NAMES)},
  {_contains_case('e', formats.FORMAT_NAMES, f"CASE WHEN s = '' THEN e WHEN contains(s, '_') THEN s ELSE {SPACED} END")}) END"""
SHORT = [p for p in formats.FORMAT_NAMES if p[0] not in formats.NOT_IN_SHORT]
SHORT_NAME = f"coalesce({_exact_case('e', SHORT)}, {_contains_case('e', SHORT, 'split_part(e, chr(95), 1)')})"
# Event ids: those of the matches, those of the orders' priority text, names of customers.
EVENT_IDS = """
    o_orderkey AS id,
    CASE o_orderkey % 4
      WHEN 0 THEN concat(o_orderpriority, '_ABC_', CAST(20200000 + o_orderkey AS STRING))
      WHEN 1 THEN concat('Trad', CAST(o_orderkey AS STRING), 'premierdraft') WHEN 2 THEN ''
      ELSE concat('PickOne', 'camelCase_XYZ') END AS e
"""


def _formats(expr: str) -> str:
    return f"""WITH {MATCHES_SQL}, ids AS (
      SELECT id, event_id AS e FROM matches UNION ALL SELECT {EVENT_IDS} FROM orders),
    cut AS (SELECT id, e, {STRIPPED} AS s FROM ids),
    named AS (SELECT id, e, s, {FULL_NAME} AS full_name FROM cut)
    SELECT id, e, {expr} FROM named"""


def event_ids(spark, sf):
    m = matches(spark, sf).select("id", F.col("event_id").alias("e"))
    return m.unionByName(view(table(spark, sf, "orders"), EVENT_IDS))


@query("format_name", _formats("full_name"))
def _(spark, sf):
    return event_ids(spark, sf).select("id", "e", formats.format_name("e").alias("full_name"))


@query("format_name_short", _formats(f"{SHORT_NAME} AS short_name"))
def _(spark, sf):
    return event_ids(spark, sf).select("id", "e", formats.format_name_short("e").alias("short_name"))


@query(
    "format_category",
    _formats(
        f"{_contains_case('full_name', formats.FORMAT_CATEGORIES, chr(39) + 'Other' + chr(39))} AS category"
    ),
)
def _(spark, sf):
    return event_ids(spark, sf).select("id", "e", formats.format_category("e").alias("category"))


@query(
    "is_limited",
    _formats(
        "(contains(lower(e), 'draft') OR contains(lower(e), 'sealed')) AS limited, "
        "NOT (contains(lower(e), 'draft') OR contains(lower(e), 'sealed')) AS constructed"
    ),
)
def _(spark, sf):
    return event_ids(spark, sf).select(
        "id",
        "e",
        formats.is_limited("e").alias("limited"),
        formats.is_constructed("e").alias("constructed"),
    )


PLATFORM = """CASE WHEN contains(lower(p), 'android') OR contains(lower(p), 'ios') OR contains(lower(p), 'phone')
    THEN 'mobile' WHEN contains(lower(p), 'mac') OR contains(lower(p), 'windows')
    OR contains(lower(p), 'pc') THEN 'desktop' ELSE '' END"""


@query(
    "platform_class",
    _m(f"SELECT id, {PLATFORM} AS platform FROM (SELECT id, coalesce(opponent_platform, '') AS p FROM matches)"),
)
def _(spark, sf):
    return matches(spark, sf).select(
        "id", formats.platform_class("opponent_platform").alias("platform")
    )


@query(
    "match_report",
    _m(
        f""", x AS (SELECT *, CASE WHEN format = '' THEN event_id ELSE format END AS e,
            coalesce(opponent_platform, '') AS p FROM matches)
        SELECT id, result,
          CASE WHEN win_condition = 'Damage' THEN 'Damage' ELSE '' END AS win_condition,
          CASE WHEN deck_name = '' THEN 'Unknown Deck' ELSE deck_name END AS deck,
          opponent_name AS opponent, {PLATFORM} AS platform, {SHORT_NAME} AS format,
          CASE WHEN final_turn > 0 THEN concat('T', final_turn) ELSE '' END AS turn, started_at,
          coalesce(trim(notes) <> '', FALSE) AS has_notes
        FROM x"""
    ),
)
def _(spark, sf):
    return report.match_report(matches(spark, sf))


@query(
    "export_rows",
    _m(
        f""", x AS (SELECT *, CASE WHEN format = '' THEN event_id ELSE format END AS e FROM matches)
        SELECT strftime(started_at, '%Y-%m-%d %H:%M:%S') AS "Date",
          CASE WHEN deck_name = '' THEN 'Unknown' ELSE deck_name END AS "Deck",
          opponent_name AS "Opponent", {SHORT_NAME} AS "Format", upper(result) AS "Result",
          CAST(game_count AS VARCHAR) AS "Games",
          CASE WHEN on_play THEN 'Yes' ELSE 'No' END AS "On Play"
        FROM x"""
    ),
)
def _(spark, sf):
    return report.export_rows(matches(spark, sf))
