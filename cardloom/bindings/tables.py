"""Scans and sinks: whole tables written in the reference formats and read back."""

import uuid

from pyspark.sql import functions as F

from cardloom.bindings.cards import BULK, FLAT, APP, bulk, flat
from cardloom.bindings.ids import PRINT_COLUMNS, PRINTINGS_SQL, SOURCE_SQL, cards, loc, printings
from cardloom.bindings.registry import MATCHES_SQL, matches, query, table
from cardloom.bindings.stats import SHORT_NAME
from cardloom.bindings.wide import _dense, game_logs
from cardloom.functions.exprs import col
from cardloom.operators import catalogue as K
from cardloom.operators import idmap
from cardloom.plans.staging import shared_folder
from cardloom.sources import scan, sinks


def scratch(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query("read_wide_logs", f"WITH d AS ({_dense()}) SELECT game_id, game_id % 2 = 0 AS won, \"deck_A F\" AS deck_af, \"tutored_R O\" AS tutored_ro FROM d")
def _(spark, sf):
    """Wide logs as gzip CSV, scanned with the header's schema."""
    path = scratch(spark, "wide")
    name = scan.WIDE_FILE.format(data_type="game", set_code="LTR", limited_type="Sealed")
    logs = game_logs(spark, sf).withColumnRenamed("game_id", "draft_id")
    logs.write.option("compression", "gzip").csv(f"{path}/{name}", header=True)
    back = scan.read_wide_logs(spark, path, "LTR", "Sealed", "game", typed=True)
    return back.select(
        F.col("draft_id").cast("bigint").alias("game_id"),
        "won",
        col("deck_A F").cast("int").alias("deck_af"),
        col("tutored_R O").cast("int").alias("tutored_ro"),
    )


@query("read_cards_bulk", f"WITH {BULK} {FLAT}")
def _(spark, sf):
    """Bulk cards as JSON lines, scanned and flattened."""
    path = scratch(spark, "bulk")
    fields = [f.name for f in spark.createDataFrame([], scan.CARD_SCHEMA).schema.fields]
    full = bulk(spark, sf).withColumn("arena_id", F.lit(None).cast("bigint"))
    full.select(*fields).write.json(path)
    cards_ = scan.read_cards_bulk(spark, path, lines=True)
    return K.flatten_card(K.paper_english(cards_))


@query("read_cards_bulk_array", f"WITH {BULK} {FLAT}")
def _(spark, sf):
    """Bulk cards as JSON arrays, one per set, cut by all tasks; a file holds many."""
    path = scratch(spark, "bulk-array")
    fields = [f.name for f in spark.createDataFrame([], scan.CARD_SCHEMA).schema.fields]
    full = bulk(spark, sf).withColumn("arena_id", F.lit(None).cast("bigint"))
    arrays = full.groupBy("set_id").agg(F.to_json(F.collect_list(F.struct(*fields))).alias("value"))
    arrays.select("value").write.text(path)
    return K.flatten_card(K.paper_english(scan.read_cards_bulk(spark, path, hot_rows=500)))


@query(
    "read_printings",
    f"""WITH p AS (SELECT {PRINT_COLUMNS} FROM part) SELECT set_code, id_text, name, text,
      row_number() OVER (PARTITION BY set_code ORDER BY card_pos) - 1 AS card_pos FROM p""",
)
def _(spark, sf):
    """Printings documents of some sets each, with objects that are no sets beside them."""
    path = scratch(spark, "printings")
    cards_ = F.transform(F.sort_array(F.collect_list(F.struct("card_pos", "card"))), lambda x: x["card"])
    sets = printings(spark, sf).groupBy("set_code").agg(F.struct(F.lit("a } name").alias("name"), cards_.alias("cards")).alias("info"))
    entries = F.map_from_entries(F.collect_list(F.struct("set_code", "info"))).alias("data")
    meta = F.struct(F.struct(F.lit("1 {").alias("version")).alias("about")).alias("meta")
    docs = sets.groupBy(F.pmod(F.hash("set_code"), F.lit(4))).agg(entries).select(F.to_json(F.struct(meta, "data")).alias("value"))
    docs.write.text(path)
    back = scan.read_printings(spark, path, hot_rows=500)
    return back.select("set_code", F.col("card.identifiers.mtgArenaId").alias("id_text"), "card.name", "card.text", F.col("card_pos").cast("bigint"))


@query("read_card_tables", f"WITH {SOURCE_SQL} SELECT GrpId, c.TitleId, Loc FROM cards c LEFT JOIN loc ON LocId = TitleId")
def _(spark, sf):
    path = scratch(spark, "card-tables")
    cards(spark, sf).write.parquet(f"{path}/Cards")
    loc(spark, sf).write.parquet(f"{path}/Localizations_enUS")
    c, text = scan.read_card_tables(spark, path)
    return c.join(text, c["TitleId"] == text["LocId"], "left").select("GrpId", "TitleId", "Loc")


@query("require_rows", "SELECT o_orderkey, NULL AS problem FROM orders UNION ALL SELECT -1, 'no orders to write'")
def _(spark, sf):
    """A table passes as it is; an empty one is an error, here its text."""
    orders = table(spark, sf, "orders").select("o_orderkey")
    try:
        K.require_rows(orders.filter("o_orderkey < 0"), "orders")
        problem = None
    except ValueError as error:
        problem = str(error)
    told = spark.createDataFrame([(-1, problem)], "o_orderkey bigint, problem string")
    return K.require_rows(orders, "orders").withColumn("problem", F.lit(None).cast("string")).unionByName(told)


@query("write_processed", f"WITH {MATCHES_SQL} SELECT id, result, event_id, opponent_name FROM matches")
def _(spark, sf):
    """Partitioned table; a second write without refresh keeps what is there."""
    path = scratch(spark, "processed")
    m = matches(spark, sf).select("id", "result", "event_id", "opponent_name")
    by = ("result", "opponent_name")
    sinks.write_processed(m, path, by=by)
    sinks.write_processed(m.withColumn("id", -F.col("id")), path, by=by)
    return scan.read_processed(spark, path).select("id", "result", "event_id", "opponent_name")


@query(
    "write_catalogue_tables",
    f"""WITH {BULK}, s AS (SELECT set_id AS set, arg_min(set_name, input_pos) AS set_name FROM b
      WHERE lang = 'en' AND NOT coalesce(digital, FALSE) AND set_id <> '' GROUP BY set_id)
    SELECT c.id, c.set, s.set_name, f.faces FROM ({FLAT}) c LEFT JOIN s USING (set),
      (SELECT count(*) * 2 AS faces FROM ({FLAT})) f""",
)
def _(spark, sf):
    path = scratch(spark, "catalogue")
    kept = K.paper_english(bulk(spark, sf))
    sinks.write_catalogue_tables(
        K.flatten_card(kept), K.sets_from_cards(kept), K.card_faces(kept), path
    )
    read = {t: scan.read_processed(spark, f"{path}/{t}") for t in ("cards", "sets", "card_faces")}
    faces = read["card_faces"].agg(F.count(F.lit(1)).alias("n")).scalar()
    names = read["sets"].select("set", F.col("set_name").alias("s"))
    return read["cards"].join(names, "set", "left").select(
        "id", "set", F.col("s").alias("set_name"), faces.alias("faces")
    )


@query("write_app_catalogue", f"WITH {BULK}, {APP} SELECT * FROM app")
def _(spark, sf):
    path = scratch(spark, "app")
    app = K.app_catalogue(flat(spark, sf))
    sinks.write_app_catalogue(app, path)
    back = spark.read.schema(app.schema).json(path)
    return back.withColumn("colors", F.array_join("colors", ","))


@query("write_mapping", f"WITH {PRINTINGS_SQL} SELECT * FROM printings")
def _(spark, sf):
    path = scratch(spark, "mapping")
    mapping = idmap.printings_mapping(printings(spark, sf))
    sinks.write_mapping(mapping, path)
    back = spark.read.schema(mapping.schema).json(path)
    return back.withColumns({c: F.array_join(c, ",") for c in ("colors", "colorIdentity")})


@query(
    "export_matches_csv",
    f"""WITH {MATCHES_SQL}, x AS (SELECT *, CASE WHEN format = '' THEN event_id ELSE format END AS e FROM matches)
    SELECT strftime(started_at, '%Y-%m-%d %H:%M:%S') AS "Date", CASE WHEN deck_name = '' THEN 'Unknown' ELSE deck_name END AS "Deck",
      opponent_name AS "Opponent", {SHORT_NAME} AS "Format", upper(result) AS "Result", CAST(game_count AS VARCHAR) AS "Games",
      CASE WHEN on_play THEN 'Yes' ELSE 'No' END AS "On Play" FROM x""",
)
def _(spark, sf):
    path = scratch(spark, "export-csv")
    sinks.export_matches_csv(matches(spark, sf), path)
    return spark.read.csv(path, header=True)


@query("export_matches_json", f"WITH {MATCHES_SQL} SELECT id, event_id, result, notes, on_play FROM matches")
def _(spark, sf):
    path = scratch(spark, "export-json")
    m = matches(spark, sf)
    sinks.export_matches_json(m, path)
    return spark.read.schema(m.schema).json(path).select("id", "event_id", "result", "notes", "on_play")


# Lines of logs named by day; a player's newest log counts.
LINE_COLUMNS = """
    concat('p', CAST(user_id % 20 AS STRING)) AS player_id, event_id AS line_no, props AS line,
    CASE WHEN event_id % 10 = 0 THEN 'UTC_Log - broken.log'
      ELSE concat('UTC_Log - 01-', lpad(CAST(1 + event_id % 28 AS STRING), 2, '0'), '-20',
        lpad(CAST(10 + event_id % 13 AS STRING), 2, '0'), ' 12.00.', lpad(CAST(event_id % 60 AS STRING), 2, '0'), '.log')
      END AS source_file
"""


@query(
    "latest_log",
    f"""WITH l AS (SELECT {LINE_COLUMNS} FROM events), t AS (
      SELECT *, TRY_CAST(strptime(regexp_extract(source_file, 'UTC_Log - (.*)\\.log', 1), '%m-%d-%Y %H.%M.%S') AS TIMESTAMP) AS ts
      FROM l WHERE source_file NOT LIKE '%broken%')
    SELECT player_id, source_file, line_no, line FROM t
    QUALIFY ts = max(ts) OVER (PARTITION BY player_id)""",
)
def _(spark, sf):
    from cardloom.bindings.registry import view

    lines = view(table(spark, sf, "events"), LINE_COLUMNS)
    return scan.latest_log(lines, ("player_id",)).select("player_id", "source_file", "line_no", "line")


@query("latest_snapshot", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate = (SELECT max(o_orderdate) FROM orders)")
def _(spark, sf):
    return scan.latest_snapshot(table(spark, sf, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate")
