"""Folds over the event stream: the event type tells the operation, the user is the player."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from cardloom.bindings.registry import MATCHES_SQL, matches, query, table, view
from cardloom.operators import fold, ledger
from cardloom.operators.stats import match_stats

EV_COLUMNS = """
    event_id AS seq, ts AS upd, user_id AS player_id, event_type AS et, value,
    CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k
"""
EV = f"ev AS (SELECT {EV_COLUMNS} FROM events)"

# Match records are keyed by player and a quarter of the numbers.
MATCH_ID = "player_id * 4 + k % 4 AS match_id"
START_COLUMNS = f"""
    {MATCH_ID}, seq, concat('E', CAST(k AS STRING)) AS event_id,
    concat('F', CAST(k % 3 AS STRING)) AS format,
    CASE WHEN k % 3 = 0 THEN NULL ELSE concat('D', CAST(k AS STRING)) END AS deck_id,
    CASE k % 5 WHEN 0 THEN NULL WHEN 1 THEN 'Unknown Deck' WHEN 2 THEN NULL
      ELSE concat('Name ', CAST(k AS STRING)) END AS deck_name,
    concat('O', CAST(k AS STRING)) AS opponent_name, upd AS started_at, k % 2 = 0 AS on_play,
    CASE k % 4 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE concat('P', CAST(k AS STRING)) END
      AS opponent_platform
"""
END_COLUMNS = f"""
    {MATCH_ID}, seq, CASE k % 3 WHEN 0 THEN 'win' WHEN 1 THEN 'loss' ELSE 'draw' END AS result,
    CAST(1 + k % 3 AS INTEGER) AS game_count, upd AS ended_at,
    CASE WHEN k % 5 = 0 THEN '' ELSE 'Damage' END AS win_condition, k % 6 AS final_turn
"""
DECK_COLUMNS = f"""
    {MATCH_ID}, seq, CASE WHEN k % 2 = 0 THEN '' ELSE concat('C', CAST(k AS STRING)) END AS deck_id,
    CASE k % 4 WHEN 0 THEN 'Unknown Deck' WHEN 1 THEN '' WHEN 2 THEN NULL
      ELSE concat('Click ', CAST(k AS STRING)) END AS deck_name
"""
NOTE_COLUMNS = f"""
    {MATCH_ID}, seq, CASE k % 4 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE concat('n', CAST(k AS STRING)) END AS note
"""
STARTS = f"starts AS (SELECT {START_COLUMNS} FROM ev WHERE et = 'signup')"
ENDS = f"ends AS (SELECT {END_COLUMNS} FROM ev WHERE et = 'purchase')"
DECKS = f"decks AS (SELECT {DECK_COLUMNS} FROM ev WHERE et = 'click')"
FOLDED = """m AS (
  SELECT match_id, arg_max(event_id, seq) AS event_id, arg_max(format, seq) AS format,
    arg_max(deck_id, seq) FILTER (WHERE deck_id IS NOT NULL) AS deck_id,
    arg_max(deck_name, seq) FILTER (WHERE deck_name IS NOT NULL) AS deck_name,
    arg_max(opponent_name, seq) AS opponent_name, 'draw' AS result, CAST(1 AS INTEGER) AS game_count,
    arg_min(started_at, seq) AS started_at, arg_min(on_play, seq) AS on_play,
    arg_max(opponent_platform, seq) FILTER (WHERE opponent_platform <> '') AS opponent_platform,
    min(seq) AS first_seq, max(seq) AS last_seq,
    coalesce(max(seq) FILTER (WHERE deck_name IS NOT NULL), min(seq)) AS name_seq
  FROM starts GROUP BY match_id)"""


def ev(spark, sf):
    return view(table(spark, sf, "events"), EV_COLUMNS)


def starts(spark, sf):
    return view(ev(spark, sf).filter("et = 'signup'"), START_COLUMNS)


def ends(spark, sf):
    return view(ev(spark, sf).filter("et = 'purchase'"), END_COLUMNS)


def deck_events(spark, sf):
    return view(ev(spark, sf).filter("et = 'click'"), DECK_COLUMNS)


@query("fold_matches", f"WITH {EV}, {STARTS}, {FOLDED} SELECT * FROM m")
def _(spark, sf):
    return fold.fold_matches(starts(spark, sf))


ENDED = """x AS (
  SELECT m.*, e.* EXCLUDE (match_id) RENAME (seq AS e_seq, result AS e_result, game_count AS e_count)
  FROM m LEFT JOIN (SELECT * FROM ends QUALIFY row_number() OVER (PARTITION BY match_id ORDER BY seq DESC) = 1) e
    ON m.match_id = e.match_id),
ended AS (
  SELECT match_id, deck_id, deck_name, name_seq,
    CASE WHEN e_seq > first_seq AND e_seq > last_seq THEN e_result ELSE 'draw' END AS result,
    CASE WHEN e_seq > first_seq AND e_seq > last_seq THEN e_count ELSE 1 END AS game_count,
    CASE WHEN e_seq > first_seq THEN ended_at END AS ended_at,
    CASE WHEN e_seq > first_seq THEN nullif(win_condition, '') END AS win_condition,
    CASE WHEN e_seq > first_seq THEN nullif(final_turn, 0) END AS final_turn
  FROM x)"""


@query(
    "apply_match_end",
    f"""WITH {EV}, {STARTS}, {ENDS}, {FOLDED}, {ENDED}
    SELECT match_id, result, game_count, ended_at, win_condition, final_turn FROM ended""",
)
def _(spark, sf):
    out = fold.apply_match_end(fold.fold_matches(starts(spark, sf)), ends(spark, sf))
    return out.select("match_id", "result", "game_count", "ended_at", "win_condition", "final_turn")


@query(
    "fill_deck_name",
    f"""WITH {EV}, {STARTS}, {DECKS}, {FOLDED},
    c AS (SELECT m.match_id, arg_min(d.deck_name, seq) AS dn, arg_min(struct_pack(i := nullif(d.deck_id, '')), seq) AS di
      FROM m JOIN decks d ON d.match_id = m.match_id AND d.seq > m.name_seq
      WHERE d.deck_name NOT IN ('', 'Unknown Deck') GROUP BY m.match_id)
    SELECT match_id,
      CASE WHEN (deck_name IS NULL OR deck_name = 'Unknown Deck') AND dn IS NOT NULL THEN dn ELSE deck_name END AS deck_name,
      CASE WHEN (deck_name IS NULL OR deck_name = 'Unknown Deck') AND dn IS NOT NULL
        THEN coalesce(di.i, deck_id) ELSE deck_id END AS deck_id
    FROM m LEFT JOIN c USING (match_id)""",
)
def _(spark, sf):
    out = fold.fill_deck_name(fold.fold_matches(starts(spark, sf)), deck_events(spark, sf))
    return out.select("match_id", "deck_name", "deck_id")


SESSION_COLUMNS = """
    player_id, seq, CASE et WHEN 'signup' THEN 'match_start' WHEN 'purchase' THEN 'match_end'
      WHEN 'click' THEN 'deck' WHEN 'view' THEN 'name' ELSE 'other' END AS kind,
    CASE WHEN et IN ('signup', 'purchase') THEN concat('M', CAST(k AS STRING)) END AS match_id,
    CASE WHEN et IN ('click', 'view') THEN concat('D', CAST(k AS STRING)) END AS deck_id,
    CASE WHEN et IN ('click', 'view') THEN CASE WHEN k % 3 = 0 THEN 'Unknown Deck'
      ELSE concat('N', CAST(k AS STRING)) END END AS deck_name
"""
SESSION_SQL = f"""WITH {EV}, s AS (SELECT {SESSION_COLUMNS} FROM ev), c AS (
    SELECT *,
      last_value(CASE kind WHEN 'match_start' THEN match_id WHEN 'match_end' THEN '-' END IGNORE NULLS) OVER w AS cm,
      last_value(CASE kind WHEN 'deck' THEN deck_id WHEN 'match_end' THEN '-' END IGNORE NULLS) OVER w AS cd,
      last_value(CASE kind WHEN 'deck' THEN deck_name WHEN 'match_end' THEN '-' END IGNORE NULLS) OVER w AS cn,
      last_value(CASE WHEN deck_name <> 'Unknown Deck' THEN deck_name END IGNORE NULLS) OVER w AS known
    FROM s WINDOW w AS (PARTITION BY player_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
  SELECT player_id, seq, kind, coalesce(cm, '-') <> '-' AS in_match, nullif(cm, '-') AS current_match,
    nullif(cd, '-') AS current_deck_id, coalesce(known, nullif(cn, '-')) AS current_deck_name FROM c"""


def session(spark, sf, hot_rows):
    out = fold.session_context(view(ev(spark, sf), SESSION_COLUMNS), hot_rows=hot_rows)
    return out.select(
        "player_id", "seq", "kind", "in_match", "current_match", "current_deck_id",
        "current_deck_name",
    )


@query("session_context", SESSION_SQL)
def _(spark, sf):
    return session(spark, sf, fold.HOT_ROWS)


@query("session_context_hot_player", SESSION_SQL)
def _(spark, sf):
    """The same with every player above the hot-key limit."""
    return session(spark, sf, 20)


STATE_COLUMNS = """
    player_id AS match_id, seq, k % 12 AS turn, CASE WHEN k % 3 = 0 THEN NULL ELSE k % 20 END AS player_life,
    CASE WHEN k % 5 = 0 THEN NULL ELSE k % 7 END AS opponent_life
"""


def _carry(strict: bool) -> str:
    life = "> 0" if strict else "IS NOT NULL"
    return f"""WITH {EV}, m AS (SELECT player_id AS match_id, max(seq) AS last_seq FROM ev
        WHERE et = 'signup' GROUP BY 1),
    s AS (SELECT {STATE_COLUMNS} FROM ev WHERE et IN ('click', 'view')),
    f AS (SELECT m.match_id, s.* EXCLUDE (match_id) FROM m LEFT JOIN s ON s.match_id = m.match_id AND s.seq > last_seq)
    SELECT match_id, coalesce(arg_max(turn, seq) FILTER (WHERE turn > 0), 0) AS turn,
      coalesce(arg_max(player_life, seq) FILTER (WHERE player_life {life}), 20) AS player_life,
      coalesce(arg_max(opponent_life, seq) FILTER (WHERE opponent_life {life}), 20) AS opponent_life
    FROM f GROUP BY match_id"""


def carry(spark, sf, strict):
    e = ev(spark, sf)
    m = e.filter("et = 'signup'").groupBy(F.col("player_id").alias("match_id")).agg(
        F.max("seq").alias("last_seq")
    )
    states = view(e.filter("et IN ('click', 'view')"), STATE_COLUMNS)
    return fold.carry_last_state(states, m, strict_reference=strict)


@query("carry_last_state", _carry(False))
def _(spark, sf):
    return carry(spark, sf, False)


@query("carry_last_state_strict", _carry(True))
def _(spark, sf):
    return carry(spark, sf, True)


REASON = """CASE o_orderpriority WHEN '1-URGENT' THEN 'ResultReason_Concede' WHEN '2-HIGH' THEN 'Timeout'
  WHEN '3-MEDIUM' THEN 'Connection lost' WHEN '5-LOW' THEN 'Player idle' ELSE 'Game' END AS reason,
  o_orderkey % 4 AS opponent_life, o_orderkey % 3 AS player_life"""


@query(
    "win_condition",
    f"""WITH x AS (SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'win' WHEN 'O' THEN 'loss' ELSE 'draw' END AS result,
      {REASON} FROM orders)
    SELECT id, CASE
      WHEN reason ILIKE '%concede%' THEN CASE WHEN result = 'win' THEN 'Opponent Conceded' ELSE 'Conceded' END
      WHEN reason ILIKE '%timeout%' OR reason ILIKE '%idle%'
        THEN CASE WHEN result = 'win' THEN 'Opponent Timed Out' ELSE 'Timed Out' END
      WHEN reason ILIKE '%connection%' THEN CASE WHEN result = 'win' THEN 'Opponent Disconnected' ELSE 'Disconnected' END
      WHEN result = 'draw' THEN 'Unknown'
      WHEN CASE WHEN result = 'win' THEN opponent_life ELSE player_life END > 0 THEN 'Milled'
      ELSE 'Damage' END AS win_condition FROM x""",
)
def _(spark, sf):
    result = (
        "o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'win' WHEN 'O' THEN 'loss' "
        "ELSE 'draw' END AS result, "
    )
    x = view(table(spark, sf, "orders"), result + REASON)
    return x.select(
        "id",
        fold.win_condition("result", "reason", "opponent_life", "player_life").alias("win_condition"),
    )


NAMED_DECKS = """
    player_id, seq, concat('D', CAST(k % 10 AS STRING)) AS deck_id,
    CASE k % 3 WHEN 0 THEN 'Unknown Deck' WHEN 1 THEN '' ELSE concat('Own ', CAST(k AS STRING)) END AS deck_name
"""
SUMMARY_ROWS = """
    player_id, seq, concat('D', CAST(k % 10 AS STRING)) AS deck_id, concat('Sum ', CAST(k AS STRING)) AS deck_name
"""


@query(
    "resolve_deck_names",
    f"""WITH {EV}, d AS (SELECT {NAMED_DECKS} FROM ev WHERE et = 'click'),
    s AS (SELECT {SUMMARY_ROWS} FROM ev WHERE et = 'view')
    SELECT d.player_id, d.seq, d.deck_id,
      CASE WHEN d.deck_name IN ('', 'Unknown Deck') THEN coalesce(s.deck_name, d.deck_name)
        ELSE d.deck_name END AS deck_name
    FROM d ASOF LEFT JOIN s ON d.player_id = s.player_id AND d.deck_id = s.deck_id AND d.seq > s.seq""",
)
def _(spark, sf):
    e = ev(spark, sf)
    return fold.resolve_deck_names(
        view(e.filter("et = 'click'"), NAMED_DECKS), view(e.filter("et = 'view'"), SUMMARY_ROWS)
    )


@query(
    "fold_collection",
    f"""WITH {EV} SELECT player_id, k AS grp_id, CAST(floor(arg_max(value, seq)) AS BIGINT) AS quantity,
      arg_max(upd, seq) AS updated_at FROM ev GROUP BY player_id, k""",
)
def _(spark, sf):
    e = ev(spark, sf).selectExpr(
        "player_id", "seq", "upd", "k AS grp_id", "CAST(floor(value) AS BIGINT) AS quantity"
    )
    return fold.fold_collection(e, at="upd")


INVENTORY_COLUMNS = """
    player_id, seq, upd, k AS gems, k * 10 AS gold, k % 5 AS wc_common, k % 4 AS wc_uncommon,
    k % 3 AS wc_rare, k % 2 AS wc_mythic, value AS vault_progress
"""


@query(
    "inventory_history",
    f"""WITH {EV}, i AS (SELECT {INVENTORY_COLUMNS} FROM ev WHERE et = 'purchase')
    SELECT player_id, seq AS id, gems, gold, wc_common, wc_uncommon, wc_rare, wc_mythic,
      vault_progress, upd AS recorded_at FROM i""",
)
def _(spark, sf):
    rows = view(ev(spark, sf).filter("et = 'purchase'"), INVENTORY_COLUMNS)
    return fold.inventory_history(rows, at="upd")


DECK_VERSIONS = """
    k AS id, seq, concat('Deck ', CAST(seq AS STRING)) AS name, et AS format,
    CASE WHEN seq % 3 = 0 THEN NULL ELSE upd END AS last_played, upd AS created_at
"""
DECKS_FOLDED = f"""WITH {EV}, d AS (SELECT {DECK_VERSIONS} FROM ev)
    SELECT id, arg_max(name, seq) AS name, arg_max(format, seq) AS format,
      arg_max(struct_pack(x := last_played), seq).x AS last_played, arg_min(created_at, seq) AS created_at
    FROM d GROUP BY id"""


@query("fold_decks", DECKS_FOLDED)
def _(spark, sf):
    return fold.fold_decks(view(ev(spark, sf), DECK_VERSIONS))


@query("deck_by_id", f"SELECT * FROM ({DECKS_FOLDED}) WHERE id = 42")
def _(spark, sf):
    return fold.deck_by_id(fold.fold_decks(view(ev(spark, sf), DECK_VERSIONS)), 42)


@query(
    "apply_notes",
    f"""WITH {EV}, {STARTS}, {FOLDED}, n AS (SELECT {NOTE_COLUMNS} FROM ev WHERE et = 'error'),
    l AS (SELECT match_id, nullif(arg_max(struct_pack(x := note), seq).x, '') AS notes FROM n GROUP BY 1)
    SELECT match_id, event_id, notes FROM m LEFT JOIN l USING (match_id)""",
)
def _(spark, sf):
    notes = view(ev(spark, sf).filter("et = 'error'"), NOTE_COLUMNS)
    out = fold.apply_notes(fold.fold_matches(starts(spark, sf)), notes)
    return out.select("match_id", "event_id", "notes")


@query(
    "evolve_schema",
    """SELECT o_orderkey, o_orderstatus, CAST(NULL AS VARCHAR) AS notes, CAST(NULL AS INTEGER) AS final_turn
    FROM orders""",
)
def _(spark, sf):
    wanted = T.StructType().add("o_orderstatus", "string").add("notes", "string").add("final_turn", "integer")
    return fold.evolve_schema(
        table(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), wanted
    )


FLAWED = """
    CAST(CASE WHEN id % 50 = 1 THEN id - 1 ELSE id END AS STRING) AS id, event_id,
    CASE WHEN id % 70 = 3 THEN NULL ELSE format END AS format, opponent_name,
    CASE id % 40 WHEN 5 THEN 'tie' WHEN 6 THEN NULL ELSE result END AS result, started_at
"""


@query(
    "check_matches",
    f"""WITH {MATCHES_SQL}, f AS (SELECT {FLAWED} FROM matches)
    SELECT id, 'format is null' AS problem FROM f WHERE format IS NULL
    UNION ALL SELECT id, 'result is null' FROM f WHERE result IS NULL
    UNION ALL SELECT id, 'unknown result' FROM f WHERE result NOT IN ('win', 'loss', 'draw')
    UNION ALL SELECT id, 'repeated id' FROM f GROUP BY id HAVING count(*) > 1""",
)
def _(spark, sf):
    return fold.check_matches(view(matches(spark, sf), FLAWED))


TAG_COLUMNS = """
    concat('Deck ', CAST(k AS STRING)) AS deck_name, seq,
    CASE seq % 4 WHEN 0 THEN '' WHEN 1 THEN 'Aggro' WHEN 2 THEN 'Control' ELSE 'Combo' END AS tag
"""


@query(
    "archetype_tags",
    f"""WITH {EV}, t AS (SELECT {TAG_COLUMNS} FROM ev), l AS (
      SELECT deck_name, arg_max(tag, seq) AS tag FROM t GROUP BY 1)
    SELECT * FROM l WHERE tag <> ''""",
)
def _(spark, sf):
    return fold.archetype_tags(view(ev(spark, sf), TAG_COLUMNS))


@query(
    "tagged_deck_stats",
    f"""WITH {EV}, {MATCHES_SQL}, t AS (SELECT {TAG_COLUMNS} FROM ev), l AS (
      SELECT deck_name, arg_max(tag, seq) AS tag FROM t GROUP BY 1),
    r AS (SELECT deck_name, count(*) FILTER (WHERE result = 'win') AS wins FROM matches GROUP BY 1)
    SELECT deck_name, wins, nullif(tag, '') AS tag FROM r LEFT JOIN l USING (deck_name)""",
)
def _(spark, sf):
    tags = fold.archetype_tags(view(ev(spark, sf), TAG_COLUMNS))
    per = match_stats(matches(spark, sf), by=["deck_name"]).select("deck_name", "wins")
    return per.join(tags, "deck_name", "left")


# --- count ledger ----------------------------------------------------------------------

OP_COLUMNS = """
    concat('S', CAST(player_id AS STRING)) AS set_code, k AS card_id, seq,
    CASE et WHEN 'purchase' THEN 'set' WHEN 'click' THEN 'add' WHEN 'view' THEN 'subtract'
      WHEN 'signup' THEN 'add' ELSE CASE WHEN k % 20 = 0 THEN 'clear' ELSE 'other' END END AS op,
    CASE k % 7 WHEN 0 THEN 'abc' WHEN 1 THEN '12x' WHEN 2 THEN ' -3'
      ELSE CAST(CAST(floor(value) AS BIGINT) AS STRING) END AS value
"""
COUNTS_SQL = f"""WITH {EV}, o AS (SELECT {OP_COLUMNS} FROM ev),
  p AS (SELECT *, TRY_CAST(regexp_extract(value, '^\\s*([+-]?[0-9]+)', 1) AS BIGINT) AS v,
    max(seq) FILTER (WHERE op = 'clear') OVER (PARTITION BY set_code) AS cleared FROM o),
  live AS (SELECT * FROM p WHERE v IS NOT NULL AND op IN ('set', 'add', 'subtract') AND seq > coalesce(cleared, -1)),
  s AS (SELECT *, max(seq) FILTER (WHERE op = 'set') OVER (PARTITION BY set_code, card_id) AS last_set FROM live)
  SELECT set_code, card_id, CAST(sum(CASE WHEN op = 'set' THEN CASE WHEN seq = last_set THEN v ELSE 0 END
      WHEN seq < coalesce(last_set, -1) THEN 0 WHEN op = 'add' THEN v ELSE -v END) AS BIGINT) AS count
  FROM s GROUP BY set_code, card_id"""


@query("fold_counts", COUNTS_SQL)
def _(spark, sf):
    return ledger.fold_counts(view(ev(spark, sf), OP_COLUMNS))


@query("clear_set", f"SELECT * FROM ({COUNTS_SQL}) WHERE set_code <> 'S7'")
def _(spark, sf):
    return ledger.clear_set(ledger.fold_counts(view(ev(spark, sf), OP_COLUMNS)), "S7")
