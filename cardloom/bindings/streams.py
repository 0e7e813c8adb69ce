"""Streams over files that Spark writes from events in several steps, each read by a started query."""

from functools import partial

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import functions as F

from cardloom.bindings.folds import (
    DECK_VERSIONS,
    DECKS,
    DECKS_FOLDED,
    ENDED,
    ENDS,
    EV as FOLD_EV,
    FOLDED,
    STARTS,
    deck_events,
    ends,
    ev as fold_ev,
    starts,
)
from cardloom.bindings.logs import EV, FORMS, MESSAGES_SQL, _exploded, ev
from cardloom.bindings.registry import query, table, view
from cardloom.functions.variants import whole
from cardloom.plans.sessions import sessions
from cardloom.plans.staging import new_folder, stage
from cardloom.sources import scan
from cardloom.sources.growing import stream_growing_logs
from cardloom.streaming import refold
from cardloom.streaming.blocks import stream_messages
from cardloom.streaming.sessions import stream_sessions

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OLD_LOG, NEW_LOG = "UTC_Log - 03-01-2024 10.00.00.log", "UTC_Log - 03-02-2024 09.30.00.log"
FIRST_LINES, OLD_LINES = 100, 300


def stateful_session(spark):
    """A session whose state store can hold the state of stateful processors."""
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    own.conf.set("spark.sql.session.timeZone", spark.conf.get("spark.sql.session.timeZone"))
    return own


def run_once(df, out, checkpoint):
    """Take what is there now into parquet files."""
    writer = df.writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", out)
    q = writer.trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception():
        raise q.exception()


# --- growing logs ------------------------------------------------------------------------


def _write_logs(batches, root, step):
    """Write the log of a task's lines as it stands after a step.

    Step 1: the old log up to the middle of a line. Step 2: all of the old log. Step 3: the new log.
    """
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), root)
    folder = f"{path}/p{TaskContext.get().partitionId()}"
    system.create_dir(folder)
    first, stop = (0, OLD_LINES) if step < 3 else (OLD_LINES, None)
    at = 0
    with system.open_output_stream(f"{folder}/{OLD_LOG if step < 3 else NEW_LOG}") as out:
        for batch in batches:
            for line in batch.column("line").to_pylist():
                text = line.encode()
                if step == 1 and at == FIRST_LINES:
                    out.write(text[: len(text) // 2])
                elif at >= first and (stop is None or at < stop) and not (step == 1 and at > FIRST_LINES):
                    out.write(text + b"\n")
                at += 1
    yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64())], ["lines"])


def _through_logs(spark, lines, shape):
    """Lines, in the order of each file, written as growing logs and streamed while they grow."""
    root, out, check = (new_folder(spark, n) for n in ("growing", "streamed", "streamed-check"))
    parts = spark.sparkContext.defaultParallelism
    placed = stage(lines, "log-lines")
    own = stateful_session(spark)
    for step in (1, 2, 3):
        written = placed.repartition(parts, "source_file").sortWithinPartitions("source_file", "line_no").select("line")
        written.mapInArrow(partial(_write_logs, root=root, step=step), "lines long").agg(F.sum("lines")).collect()
        run_once(shape(stream_growing_logs(own, root, startingOffsets="earliest")), out, check)
    return spark.read.parquet(out)


@query("stream_growing_logs", "SELECT concat('e', CAST(event_id AS STRING), ' ', event_type) AS line FROM events")
def _(spark, sf):
    rows = table(spark, sf, "events").select(
        F.concat(F.lit("f"), F.col("user_id").cast("string")).alias("source_file"),
        F.col("event_id").alias("line_no"),
        F.concat_ws(" ", F.concat(F.lit("e"), F.col("event_id").cast("string")), "event_type").alias("line"),
    )
    return _through_logs(spark, rows, lambda lines: lines).select("line")


@query("read_client_logs", "SELECT concat('p', CAST(user_id % 4 AS STRING)) AS player_id, count(*) AS lines, CAST(sum(event_id) AS BIGINT) AS e FROM events GROUP BY 1")
def _(spark, sf):
    """The logs of four players, two files each, in folders of their own."""
    root = new_folder(spark, "logs")
    number = F.col("user_id") % 4
    rows = table(spark, sf, "events").select(number.cast("int").alias("n"), F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("line"))
    for step in (2, 3):
        rows.repartitionById(4, "n").select("line").mapInArrow(partial(_write_logs, root=root, step=step), "lines long").agg(F.sum("lines")).collect()
    lines = scan.read_client_logs(spark, root, per_player=True)
    return lines.groupBy("player_id").agg(F.count(F.lit(1)).alias("lines"), F.sum(F.substring("line", 2, 20).cast("bigint")).alias("e"))


@query("stream_messages", f"SELECT k, e FROM ({MESSAGES_SQL})")
def _(spark, sf):
    """Messages of growing logs; lines and blocks lie over the borders of looks and of files."""
    v = F.col("payload")
    shape = lambda lines: stream_messages(lines, ("player_id",)).select(whole(v, "$.k").alias("k"), whole(v, "$.e").alias("e"))
    return _through_logs(spark, _exploded(ev(spark, sf), FORMS), shape)


# --- sessions ----------------------------------------------------------------------------

PLAYER_COLUMNS = """
    CAST(user_id AS STRING) AS player_id, CAST(ts AS TIMESTAMP) AS occurred, event_id AS seq,
    CASE event_type WHEN 'signup' THEN 'match_start' WHEN 'purchase' THEN 'match_end' WHEN 'click' THEN 'deck'
      WHEN 'error' THEN 'state' ELSE CASE WHEN k % 2 = 0 THEN 'name' ELSE 'summary' END END AS kind,
    CASE WHEN event_type IN ('signup', 'purchase') THEN concat('M', CAST(k AS STRING)) END AS match_id,
    CASE WHEN event_type = 'signup' THEN CAST(1 + k % 2 AS INTEGER) END AS team,
    CASE WHEN event_type IN ('click', 'view') THEN concat('D', CAST(k % 4 AS STRING)) END AS deck_id,
    CASE WHEN event_type IN ('click', 'view') THEN CASE WHEN k % 3 = 0 THEN 'Unknown Deck'
      ELSE concat('N', CAST(k AS STRING)) END END AS deck_name,
    CASE WHEN event_type = 'error' THEN CAST(k % 7 AS INTEGER) END AS turn,
    CASE WHEN event_type = 'error' AND k % 4 <> 0 THEN CAST(k % 21 AS INTEGER) END AS player_life,
    CASE WHEN event_type = 'error' AND k % 4 <> 1 THEN CAST(k % 19 AS INTEGER) END AS opponent_life
"""
SHOWN = (
    "player_id, seq, kind, match_id, deck_name, in_match, current_match, current_deck_id, current_deck_name, own_team, "
    "last_turn, last_player_life, last_opponent_life"
)
PLAYERS = f"{EV.replace('ev AS', 'ev0 AS')}, ev1 AS (SELECT {PLAYER_COLUMNS} FROM ev0)"


def _context(source: str) -> str:
    """The context of the events of a table with ``kind`` and ``ends`` (whether the match ends)."""
    return f"""
  lists AS (SELECT *, last_value(CASE WHEN kind = 'summary' THEN struct_pack(n := deck_name, t := occurred) END IGNORE NULLS)
      OVER (PARTITION BY player_id, deck_id ORDER BY occurred, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS l FROM {source}),
  r AS (SELECT * REPLACE (CASE WHEN kind = 'deck' AND deck_name = 'Unknown Deck' THEN coalesce(CASE WHEN fresh(l) THEN l.n END, deck_name)
      ELSE deck_name END AS deck_name) FROM lists),
  c AS (SELECT *,
      last_value(CASE WHEN kind = 'match_start' THEN match_id WHEN ends THEN '-' END IGNORE NULLS) OVER w AS cm,
      last_value(CASE WHEN kind = 'deck' THEN deck_id WHEN ends THEN '-' END IGNORE NULLS) OVER w AS cd,
      last_value(CASE WHEN kind = 'deck' THEN deck_name WHEN ends THEN '-' END IGNORE NULLS) OVER w AS cn,
      last_value(CASE WHEN kind IN ('deck', 'name') AND deck_name <> 'Unknown Deck' THEN deck_name END IGNORE NULLS) OVER w AS known,
      last_value(CASE WHEN kind = 'match_start' THEN team WHEN ends THEN -1 END IGNORE NULLS) OVER w AS tm,
      last_value(CASE WHEN kind = 'match_start' THEN 0 WHEN turn > 0 THEN turn END IGNORE NULLS) OVER w AS tu,
      last_value(CASE WHEN kind = 'match_start' THEN 20 ELSE player_life END IGNORE NULLS) OVER w AS pl,
      last_value(CASE WHEN kind = 'match_start' THEN 20 ELSE opponent_life END IGNORE NULLS) OVER w AS ol
    FROM r WINDOW w AS (PARTITION BY player_id ORDER BY occurred, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
  SELECT player_id, seq, kind, match_id, deck_name, coalesce(cm, '-') <> '-' AS in_match, nullif(cm, '-') AS current_match,
    nullif(cd, '-') AS current_deck_id, coalesce(known, nullif(cn, '-')) AS current_deck_name, nullif(tm, -1) AS own_team,
    coalesce(tu, 0) AS last_turn, coalesce(pl, 20) AS last_player_life, coalesce(ol, 20) AS last_opponent_life FROM c"""


SESSIONS_SQL = f"WITH {PLAYERS}, p AS (SELECT *, kind = 'match_end' AS ends FROM ev1),{_context('p')}".replace("fresh(l)", "true")

SILENCE_HOURS, NAME_HOURS = 30, 60
# the last start or end of the player up to an event, and the next event, tell whether a silence closes a match
SILENT_SQL = f"""WITH {PLAYERS},
  o AS (SELECT *, last_value(CASE WHEN kind IN ('match_start', 'match_end') THEN
        struct_pack(s := seq, m := CASE WHEN kind = 'match_start' THEN match_id END) END IGNORE NULLS)
      OVER (PARTITION BY player_id ORDER BY occurred, seq) AS opened,
      lead(occurred) OVER (PARTITION BY player_id ORDER BY occurred, seq) AS next_at FROM ev1),
  closed AS (SELECT player_id, opened.m AS match_id, min(occurred) + INTERVAL {SILENCE_HOURS} HOUR AS occurred FROM o
    WHERE opened.m IS NOT NULL AND next_at - occurred > INTERVAL {SILENCE_HOURS} HOUR GROUP BY player_id, opened.s, opened.m),
  p AS (SELECT *, kind = 'match_end' AS ends FROM ev1 UNION ALL BY NAME
    SELECT player_id, occurred, -1 AS seq, 'match_timeout' AS kind, match_id, true AS ends FROM closed),
  {_context('p')}""".replace("fresh(l)", f"(occurred - l.t <= INTERVAL {NAME_HOURS} HOUR)")


def players(spark, sf):
    rows = table(spark, sf, "events").selectExpr("*", "CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k")
    return view(rows, PLAYER_COLUMNS).withColumnRenamed("occurred", "at")


@query("sessions", SESSIONS_SQL)
def _(spark, sf):
    return sessions(players(spark, sf)).selectExpr(*SHOWN.split(", "))


@query("sessions_silence", SILENT_SQL)
def _(spark, sf):
    out = sessions(players(spark, sf), timeout_seconds=SILENCE_HOURS * 3600, name_seconds=NAME_HOURS * 3600)
    return out.selectExpr(*SHOWN.split(", "))


def _through_sessions(spark, rows, **options):
    """Events come in four parts by time, each up to a day late; a last one moves the watermark past all."""
    source, out, check = (new_folder(spark, n) for n in ("events", "sessions", "sessions-check"))
    own = stateful_session(spark)
    late = F.unix_micros("at") + F.pmod(F.hash("seq"), F.lit(86_000)).cast("bigint") * 1_000_000
    timed = stage(rows.withColumn("__late", late), "timed-events")
    low, high = timed.agg(F.min("__late"), F.max("__late")).head()
    part = F.floor((F.col("__late") - low) * 4 / F.lit((high or 0) - (low or 0) + 1)) if low is not None else F.lit(0)
    far = rows.sparkSession.createDataFrame([("", (high or 0) // 1_000_000 + 10**9)], "player_id string, s long").select(
        *[
            F.timestamp_seconds("s").alias("at") if c == "at" else F.col(c) if c == "player_id"
            else F.lit("name").alias(c) if c == "kind" else F.lit(None).cast(rows.schema[c].dataType).alias(c)
            for c in rows.columns
        ]
    )
    for n in range(5):
        (far if n == 4 else timed.filter(part == n).drop("__late")).write.mode("append").parquet(source)
        events = own.readStream.schema(rows.schema).parquet(source)
        run_once(stream_sessions(events, delay="24 hours", **options), out, check)
    return spark.read.parquet(out)


@query("stream_sessions", SESSIONS_SQL)
def _(spark, sf):
    return _through_sessions(spark, players(spark, sf)).selectExpr(*SHOWN.split(", "))


# --- folds of touched keys ---------------------------------------------------------------


def _through_batches(spark, events, fold, batches=3):
    """Events in batches by hash, the last one given twice."""
    folder = new_folder(spark, "refold")
    held = stage(events.withColumn("__n", F.pmod(F.hash("seq"), F.lit(batches))), "fold-events")
    for n in [*range(batches), batches - 1]:
        refold.refold_batch(held.filter(F.col("__n") == n).drop("__n"), n, fold, folder, buckets=8)
    return refold.read_folded(spark, fold, folder, events.schema)


@query(
    "refold_collection",
    f"""WITH {FOLD_EV} SELECT player_id, k AS grp_id, CAST(floor(arg_max(value, seq)) AS BIGINT) AS quantity,
      arg_max(upd, seq) AS updated_at FROM ev GROUP BY player_id, k""",
)
def _(spark, sf):
    e = fold_ev(spark, sf).selectExpr("player_id", "seq", "upd AS at", "k AS grp_id", "CAST(floor(value) AS BIGINT) AS quantity")
    return _through_batches(spark, e, refold.collection_fold())


@query("refold_decks", DECKS_FOLDED)
def _(spark, sf):
    return _through_batches(spark, view(fold_ev(spark, sf), DECK_VERSIONS), refold.deck_fold())


@query(
    "refold_matches",
    f"""WITH {FOLD_EV}, {STARTS}, {ENDS}, {DECKS}, {FOLDED}, {ENDED},
    c AS (SELECT m.match_id, arg_min(d.deck_name, seq) AS dn, arg_min(struct_pack(i := nullif(d.deck_id, '')), seq) AS di
      FROM m JOIN decks d ON d.match_id = m.match_id AND d.seq > m.name_seq
      WHERE d.deck_name NOT IN ('', 'Unknown Deck') GROUP BY m.match_id)
    SELECT match_id, result, game_count, ended_at, win_condition, final_turn,
      CASE WHEN (deck_name IS NULL OR deck_name = 'Unknown Deck') AND dn IS NOT NULL THEN dn ELSE deck_name END AS deck_name,
      CASE WHEN (deck_name IS NULL OR deck_name = 'Unknown Deck') AND dn IS NOT NULL THEN coalesce(di.i, deck_id) ELSE deck_id END AS deck_id
    FROM ended LEFT JOIN c USING (match_id)""",
)
def _(spark, sf):
    parts = {"start": starts(spark, sf), "end": ends(spark, sf), "name": deck_events(spark, sf)}
    tagged = [df.withColumn("kind", F.lit(kind)) for kind, df in parts.items()]
    events = tagged[0].unionByName(tagged[1], allowMissingColumns=True).unionByName(tagged[2], allowMissingColumns=True)
    out = _through_batches(spark, events, refold.match_fold())
    return out.select("match_id", "result", "game_count", "ended_at", "win_condition", "final_turn", "deck_name", "deck_id")
