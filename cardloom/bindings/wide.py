"""Wide logs derived from order lines: one row per order, one column per place and card."""

from pyspark.sql import functions as F

from cardloom.bindings.registry import query, table, tasks
from cardloom.functions.exprs import col
from cardloom.operators import wide as Wd

KEY = ["game_id"]
CARDS = [f"{f} {s}" for f in "ANR" for s in "FO"]
META = ["rank", "num_turns", "won"]
COUNT_COLUMNS = [f"{p}_{c}" for p in Wd.CARD_POSITIONS for c in CARDS]
TURN_FIELDS = ["lands_played", "creatures_cast", "eot_user_life"]
TURN_COLUMNS = [
    f"{p}_turn_{t}_{f}" for p in ("user", "oppo") for t in range(1, 14) for f in TURN_FIELDS
]

# Cell of an order line: place by its number, card by its flags.
PLACE = "list_extract(['drawn', 'deck', 'opening_hand', 'sideboard', 'tutored'], l_linenumber % 5 + 1)"
CELLS = f"""cells AS (
  SELECT l_orderkey AS game_id, {PLACE} AS position, concat(l_returnflag, ' ', l_linestatus) AS card_name,
    CAST(sum(CAST(l_quantity AS INTEGER) - 10) AS INTEGER) AS n FROM lineitem GROUP BY 1, 2, 3)"""


def order_lines(spark, sf):
    """Order lines with those of a game in one task of bounded size; what is grouped by game stays there."""
    lines = table(spark, sf, "lineitem")
    return lines.repartition(tasks(lines), "l_orderkey")


def game_logs(spark, sf):
    places = F.array(*[F.lit(p) for p in Wd.CARD_POSITIONS])
    lines = order_lines(spark, sf).select(
        F.col("l_orderkey").alias("game_id"),
        F.concat_ws(
            "_",
            F.element_at(places, F.col("l_linenumber") % 5 + 1),
            F.concat_ws(" ", "l_returnflag", "l_linestatus"),
        ).alias("c"),
        (F.col("l_quantity").cast("int") - 10).alias("n"),
    )
    cells = [
        F.coalesce(F.sum(F.when(F.col("c") == c, F.col("n"))), F.lit(0)).cast("int").alias(c)
        for c in COUNT_COLUMNS
    ]
    meta = [
        F.lit("gold").alias("rank"),
        F.count(F.lit(1)).alias("num_turns"),
        (F.col("game_id") % 2 == 0).alias("won"),
    ]
    return lines.groupBy("game_id").agg(*meta, *cells)


def game_meta():
    return Wd.game_columns(["game_id", *META, *COUNT_COLUMNS])


@query("melt_cards", f"WITH {CELLS} SELECT * FROM cells WHERE n <> 0")
def _(spark, sf):
    return Wd.melt_cards(game_logs(spark, sf), game_meta(), KEY)


def _dense(filter_: str = "") -> str:
    cols = ", ".join(
        f"CAST(coalesce(sum(n) FILTER (WHERE concat(position, '_', card_name) = '{c}'), 0) AS INTEGER) AS \"{c}\""
        for c in COUNT_COLUMNS
    )
    return f"WITH {CELLS} SELECT game_id, {cols} FROM cells {filter_} GROUP BY game_id"


@query("pivot_cards", _dense("WHERE n <> 0"))
def _(spark, sf):
    meta = game_meta()
    return Wd.pivot_cards(Wd.melt_cards(game_logs(spark, sf), meta, KEY), meta, KEY)


@query("melt_pivot_identity", "SELECT count(*) AS changed_rows FROM orders WHERE FALSE")
def _(spark, sf):
    """Rows with a card that differ after melt and pivot: none."""
    meta, logs = game_meta(), game_logs(spark, sf)
    any_card = F.exists(F.array(*[col(c) for c in COUNT_COLUMNS]), lambda x: x != 0)
    before = logs.filter(any_card).select("game_id", *[col(c) for c in COUNT_COLUMNS])
    after = Wd.pivot_cards(Wd.melt_cards(logs, meta, KEY), meta, KEY)
    more = F.lit(1).cast("bigint").alias("__more")
    both = before.select("*", more).unionByName(after.select("*", (-more).alias("__more")))
    # a row that one side has more often than the other counts as often as it has it more
    apart = both.repartition(tasks(table(spark, sf, "lineitem")), "game_id").groupBy(*[col(c) for c in after.columns]).agg(F.sum("__more").alias("__more"))
    return apart.agg(F.coalesce(F.sum(F.abs("__more")), F.lit(0)).cast("bigint").alias("changed_rows"))


@query("row_count", "SELECT count(*) AS n FROM lineitem")
def _(spark, sf):
    return Wd.row_count(table(spark, sf, "lineitem"))


# A header made of the brands and sizes of the parts: card, turn and other columns, some of unknown kind.
HEADER = """SELECT DISTINCT CASE p_size % 7 WHEN 0 THEN concat('deck_', p_brand) WHEN 1 THEN concat('opening_hand_', p_brand)
    WHEN 2 THEN concat('user_turn_', CAST(p_size AS STRING), '_lands_played') WHEN 3 THEN concat('oppo_turn_', CAST(p_size AS STRING), '_creatures_cast')
    WHEN 4 THEN concat('sideboard_', p_brand) WHEN 5 THEN concat('odd ', p_brand) ELSE 'rank' END AS name FROM {part}"""
SQL_HEADER = f"h AS ({HEADER.format(part='part')})"


def header(spark, sf):
    """The names of the columns: as many as brands and sizes."""
    names = spark.sql(HEADER.format(part="{part}"), part=table(spark, sf, "part"))
    return [r.name for r in names.orderBy("name").collect()]


@query(
    "schema_for_header",
    f"""WITH {SQL_HEADER} SELECT name, CASE WHEN regexp_matches(name, '^(deck|opening_hand|sideboard)_') THEN 'tinyint'
      WHEN regexp_matches(name, '_turn_') THEN 'text?' ELSE 'string' END AS kind, name LIKE 'odd %' AS unknown FROM h""",
)
def _(spark, sf):
    schema, unmatched = Wd.schema_for_header(header(spark, sf))
    told = [(f.name, "text?" if "_turn_" in f.name else f.dataType.simpleString(), f.name in unmatched) for f in schema.fields]
    return spark.createDataFrame(told, "name string, kind string, unknown boolean")


PLAYED = "regexp_extract(name, '^(.*)_turn_([0-9]+)_(.*)$', {i})"


@query(
    "classify_game_columns",
    f"""WITH {SQL_HEADER}, p AS (SELECT name, regexp_extract(name, '^(deck|opening_hand|sideboard)_', 1) AS place FROM h)
    SELECT name AS "column", CASE WHEN place = '' THEN 'meta' ELSE place END AS category,
      CASE WHEN place <> '' THEN substr(name, length(place) + 2) END AS card FROM p""",
)
def _(spark, sf):
    return Wd.classify_game_columns(spark, header(spark, sf)).select("column", "category", "card")


@query(
    "classify_replay_columns",
    f"""WITH {SQL_HEADER} SELECT name AS "column", CASE WHEN name LIKE 'deck%' THEN 'deck' WHEN name LIKE 'sideboard%' THEN 'sideboard'
      WHEN name LIKE '%!_turn!_%' ESCAPE '!' THEN 'turn' ELSE 'meta' END AS category,
      CASE WHEN name LIKE 'deck%' OR name LIKE 'sideboard%' THEN regexp_extract(name, '^[a-z]*_(.*)$', 1) END AS card,
      nullif({PLAYED.format(i=1)}, '') AS player, TRY_CAST(nullif({PLAYED.format(i=2)}, '') AS INTEGER) AS turn,
      nullif({PLAYED.format(i=3)}, '') AS field FROM h""",
)
def _(spark, sf):
    return Wd.classify_replay_columns(spark, header(spark, sf)).drop("position")


@query(
    "check_columns",
    f"""WITH {SQL_HEADER}, p AS (SELECT regexp_extract(name, '^(deck|opening_hand|sideboard)_', 1) AS place, regexp_extract(name, '_(Brand.*)$', 1) AS card
      FROM h WHERE regexp_matches(name, '^(deck|opening_hand|sideboard)_')),
    s AS (SELECT DISTINCT place FROM p), c AS (SELECT DISTINCT card FROM p)
    SELECT 'card missing in position' AS problem, concat(place, '_', card) AS "column" FROM s CROSS JOIN c
      WHERE (place, card) NOT IN (SELECT (place, card) FROM p)
    UNION ALL SELECT 'duplicate column', 'rank'""",
)
def _(spark, sf):
    """A header of uneven card sets whose rank column stands there twice."""
    return Wd.check_columns(spark, [*header(spark, sf), "rank"])


@query(
    "split_meta_cards",
    f"""WITH d AS ({_dense()})
    SELECT game_id, 'gold' AS rank, game_id % 2 = 0 AS won, "deck_A F" AS deck_af, "tutored_R O" AS tutored_ro FROM d""",
)
def _(spark, sf):
    meta, cards = Wd.split_meta_cards(game_logs(spark, sf), game_meta(), KEY)
    return meta.select("game_id", "rank", "won").join(
        cards.select(
            "game_id", col("deck_A F").alias("deck_af"), col("tutored_R O").alias("tutored_ro")
        ),
        "game_id",
    )


# Turn cell of an order line: text with a fraction, as in the logs.
TURN_CELLS = """tcells AS (
  SELECT l_orderkey AS game_id, CASE WHEN l_returnflag = 'R' THEN 'oppo' ELSE 'user' END AS player,
    l_linenumber AS turn, CASE WHEN l_linestatus = 'O' THEN 'lands_played'
      WHEN l_suppkey % 2 = 0 THEN 'creatures_cast' ELSE 'eot_user_life' END AS field,
    max(CAST(l_quantity AS INTEGER)) AS n FROM lineitem GROUP BY 1, 2, 3, 4)"""


def replay_logs(spark, sf):
    field = (
        F.when(F.col("l_linestatus") == "O", "lands_played")
        .when(F.col("l_suppkey") % 2 == 0, "creatures_cast")
        .otherwise("eot_user_life")
    )
    player = F.when(F.col("l_returnflag") == "R", "oppo").otherwise("user")
    lines = order_lines(spark, sf).select(
        F.col("l_orderkey").alias("game_id"),
        F.concat_ws("_", player, F.lit("turn"), F.col("l_linenumber").cast("string"), field).alias("c"),
        F.col("l_quantity").cast("int").alias("n"),
    )
    cells = [
        F.concat(F.max(F.when(F.col("c") == c, F.col("n"))).cast("string"), F.lit(".0")).alias(c)
        if "eot" not in c
        else F.max(F.when(F.col("c") == c, F.col("n"))).cast("string").alias(c)
        for c in TURN_COLUMNS
    ]
    return lines.groupBy("game_id").agg((F.col("game_id") % 3 == 0).alias("won"), *cells)


WANTED = ["lands_played", "eot_user_life"]


@query(
    "melt_turns",
    f"""WITH {TURN_CELLS}, grid AS (
      SELECT g.game_id, p.player, t.turn, f.field FROM (SELECT DISTINCT l_orderkey AS game_id FROM lineitem) g,
        (SELECT unnest(['user', 'oppo']) AS player) p, (SELECT unnest(range(1, 14)) AS turn) t,
        (SELECT unnest(['lands_played', 'eot_user_life']) AS field) f)
    SELECT game_id, player, CAST(turn AS INTEGER) AS turn, field, CAST(n AS VARCHAR) AS value
    FROM grid LEFT JOIN tcells USING (game_id, player, turn, field)""",
)
def _(spark, sf):
    long = Wd.melt_turns(replay_logs(spark, sf), Wd.replay_columns(TURN_COLUMNS), WANTED, KEY)
    return long.withColumn("value", F.regexp_replace("value", r"\.0\b", ""))


def _features() -> str:
    cols = ", ".join(
        f"max(n) FILTER (WHERE player = '{p}' AND turn = {t} AND field = '{f}') AS {p}_turn_{t}_{f}"
        for p in ("user", "oppo")
        for t in range(1, 14)
        for f in TURN_FIELDS
        if f in WANTED
    )
    return f"""WITH {TURN_CELLS} SELECT game_id, CASE WHEN game_id % 3 = 0 THEN 1 ELSE 0 END AS won, {cols}
    FROM tcells GROUP BY game_id"""


@query("turn_features", _features())
def _(spark, sf):
    return Wd.turn_features(replay_logs(spark, sf), Wd.replay_columns(TURN_COLUMNS), WANTED, KEY)


@query(
    "select_meta",
    "SELECT l_orderkey AS game_id, l_orderkey % 2 = 0 AS won, count(*) AS num_turns FROM lineitem GROUP BY 1, 2",
)
def _(spark, sf):
    return Wd.select_meta(game_logs(spark, sf), ["game_id", "won", "num_turns"])
