"""Deck operators over order lines: a deck is an order, a card is a part."""

from pyspark.sql import functions as F

from cardloom.bindings.registry import MAPPING_SQL, mapping, query, table, tasks, view
from cardloom.bindings.stats import COLLECTION_SQL, ownings
from cardloom.functions.cards import card_type, draw_probability
from cardloom.operators import deck as D
from cardloom.operators.fold import fold_collection
from cardloom.operators.idmap import with_card

# Deck rows: one per order line; ids beyond the parts are unknown cards.
DECK_COLUMNS = """
    l_orderkey AS deck_id, CASE WHEN l_linestatus = 'O' THEN 'main' ELSE 'side' END AS board,
    CASE WHEN l_linenumber = 7 THEN l_partkey + 1000000 ELSE l_partkey END AS grp_id,
    CAST(l_quantity AS BIGINT) AS quantity
"""
DECKS_SQL = f"decks AS (SELECT {DECK_COLUMNS} FROM lineitem)"
NAMED_SQL = """named AS (
  SELECT d.*, coalesce(nullif(m.name, ''), concat('Card #', d.grp_id)) AS card_name,
    coalesce(m.type, '') AS type, coalesce(m.manaCost, '') AS cost
  FROM decks d LEFT JOIN mapping m USING (grp_id))"""


def type_case(t: str) -> str:
    order = ("creature", "instant", "sorcery", "enchantment", "artifact", "planeswalker", "land")
    whens = " ".join(f"WHEN lower({t}) LIKE '%{x}%' THEN '{x}'" for x in order)
    return f"CASE {whens} ELSE 'other' END"


CONSOLIDATED_SQL = f"""cons AS (
  SELECT deck_id, board, card_name AS name, CAST(sum(quantity) AS BIGINT) AS quantity,
    list_sort(list(DISTINCT grp_id)) AS ids,
    {type_case("arg_min(type, grp_id)")} AS card_type, arg_min(cost, grp_id) AS mana_cost
  FROM named GROUP BY deck_id, board, card_name)"""
BASE = f"WITH {MAPPING_SQL}, {DECKS_SQL}, {NAMED_SQL}, {CONSOLIDATED_SQL}"


def decks(spark, sf):
    return view(table(spark, sf, "lineitem"), DECK_COLUMNS)


def consolidated(spark, sf):
    lines = decks(spark, sf)
    return D.consolidate_deck(lines, mapping(spark, sf), tasks=tasks(lines))


@query(
    "consolidate_deck",
    f"{BASE} SELECT deck_id, board, name, quantity, array_to_string(ids, ',') AS ids, card_type, mana_cost FROM cons",
)
def _(spark, sf):
    c = consolidated(spark, sf)
    return c.select(
        "deck_id", "board", "name", "quantity", F.array_join("grp_ids", ",").alias("ids"),
        "card_type", "mana_cost",
    )


@query(
    "with_card",
    f"""WITH {MAPPING_SQL}, {DECKS_SQL}, {NAMED_SQL}
    SELECT deck_id, board, grp_id, quantity, card_name FROM named""",
)
def _(spark, sf):
    return with_card(decks(spark, sf), mapping(spark, sf).select("grp_id", "name"))


@query("card_type", f"WITH {MAPPING_SQL} SELECT grp_id, {type_case('type')} AS card_type FROM mapping")
def _(spark, sf):
    return mapping(spark, sf).select("grp_id", card_type("type").alias("card_type"))


# Visible cards: one per order line, in the zone its flags tell.
SEEN_COLUMNS = """
    l_orderkey AS deck_id,
    CASE WHEN l_linenumber = 7 THEN l_partkey + 1000000 ELSE l_partkey END AS grp_id,
    CASE l_returnflag WHEN 'A' THEN 'hand' WHEN 'R' THEN 'graveyard'
      ELSE CASE WHEN l_suppkey % 3 = 0 THEN 'exile' WHEN l_suppkey % 3 = 1 THEN 'battlefield'
        ELSE 'library' END END AS zone
"""
# Main boards with one copy per line, so that the zones can use them up.
SINGLES = "deck_id, board, grp_id, CAST(1 AS BIGINT) AS quantity"
REMAINING_SQL = f"""WITH {MAPPING_SQL}, {DECKS_SQL}, {NAMED_SQL},
  deck AS (SELECT deck_id, card_name AS name, count(*) AS quantity
    FROM named WHERE board = 'main' GROUP BY 1, 2),
  ids AS (SELECT DISTINCT deck_id, card_name AS name, grp_id FROM named WHERE board = 'main'),
  seen AS (SELECT {SEEN_COLUMNS} FROM lineitem),
  n AS (SELECT ids.deck_id, ids.name, count(*) FILTER (WHERE zone = 'hand') AS h,
      count(*) FILTER (WHERE zone IN ('graveyard', 'battlefield', 'exile')) AS o
    FROM seen JOIN ids ON seen.deck_id = ids.deck_id AND seen.grp_id = ids.grp_id GROUP BY 1, 2),
  lib AS (SELECT deck_id, count(*) AS library_size FROM seen WHERE zone = 'library' GROUP BY 1),
  rem AS (SELECT deck_id, name, quantity, coalesce(h, 0) AS in_hand,
      CASE WHEN quantity - coalesce(h, 0) <= 0 THEN quantity - coalesce(h, 0)
        ELSE greatest(quantity - coalesce(h, 0) - coalesce(o, 0), 0) END AS remaining
    FROM deck LEFT JOIN n USING (deck_id, name))"""


def remaining(spark, sf):
    singles = decks(spark, sf).filter("board = 'main'").selectExpr(
        "deck_id", "board", "grp_id", "CAST(1 AS BIGINT) AS quantity"
    )
    deck = D.consolidate_deck(singles, mapping(spark, sf), tasks=tasks(singles)).drop("board")
    return D.remaining_cards(deck, view(table(spark, sf, "lineitem"), SEEN_COLUMNS))


@query("remaining_cards", f"{REMAINING_SQL} SELECT * FROM rem")
def _(spark, sf):
    return remaining(spark, sf).select("deck_id", "name", "quantity", "in_hand", "remaining")


@query(
    "draw_probability",
    f"""{REMAINING_SQL} SELECT deck_id, name, remaining,
      CASE WHEN remaining <= 0 OR coalesce(library_size, 0) <= 0 THEN CAST(0 AS DOUBLE)
        ELSE least(CAST(remaining AS DOUBLE) / library_size * 100, CAST(100 AS DOUBLE)) END AS draw_pct
    FROM rem LEFT JOIN lib USING (deck_id)""",
)
def _(spark, sf):
    seen = view(table(spark, sf, "lineitem"), SEEN_COLUMNS)
    library = seen.filter("zone = 'library'").groupBy("deck_id").agg(
        F.count(F.lit(1)).alias("library_size")
    )
    joined = remaining(spark, sf).join(library, "deck_id", "left")
    return joined.select(
        "deck_id",
        "name",
        "remaining",
        draw_probability("remaining", F.coalesce("library_size", F.lit(0))).alias("draw_pct"),
    )


@query(
    "deck_by_type",
    f"""{BASE}, t AS (
      SELECT deck_id, board, card_type, CAST(sum(quantity // 2) AS BIGINT) AS remaining,
        CAST(sum(quantity) AS BIGINT) AS quantity, count(*) AS names
      FROM cons GROUP BY 1, 2, 3)
    SELECT *, CAST(CASE card_type WHEN 'creature' THEN 1 WHEN 'planeswalker' THEN 2
      WHEN 'instant' THEN 3 WHEN 'sorcery' THEN 4 WHEN 'enchantment' THEN 5
      WHEN 'artifact' THEN 6 WHEN 'land' THEN 7 ELSE 8 END AS INTEGER) AS type_rank FROM t""",
)
def _(spark, sf):
    deck = consolidated(spark, sf).withColumn("remaining", F.expr("quantity div 2"))
    return D.deck_by_type(deck)


@query(
    "mana_symbols",
    f"""WITH {MAPPING_SQL}, s AS (
      SELECT grp_id, manaCost, unnest(regexp_extract_all(manaCost, '\\{{([^}}]+)\\}}', 1)) AS x,
        generate_subscripts(regexp_extract_all(manaCost, '\\{{([^}}]+)\\}}', 1), 1) AS i
      FROM mapping)
    SELECT grp_id, CAST(i - 1 AS INTEGER) AS symbol_pos, upper(x) AS symbol,
      CASE WHEN upper(x) IN ('W', 'U', 'B', 'R', 'G', 'C') THEN 'colour' ELSE 'generic' END AS symbol_kind
    FROM s""",
)
def _(spark, sf):
    return D.mana_symbols(mapping(spark, sf).select("grp_id", "manaCost"), "manaCost").drop("manaCost")


# Deck texts: one entry per order line. Names are unique per (deck, board, line).
TEXT_ROWS = """
    l_orderkey AS deck_id, CASE WHEN l_linestatus = 'O' THEN 'main' ELSE 'side' END AS board,
    CAST(l_partkey * 10000000 + l_suppkey * 100 + l_linenumber AS BIGINT) AS pos,
    CAST(l_quantity AS BIGINT) AS quantity, l_partkey AS grp_id
"""


def text_rows(spark, sf):
    rows = view(table(spark, sf, "lineitem"), TEXT_ROWS)
    parts = table(spark, sf, "part").selectExpr("p_partkey AS grp_id", "p_name AS name")
    return rows.join(parts, "grp_id")


@query(
    "format_deck_lists",
    f"""WITH r AS (SELECT t.*, p_name AS name FROM (SELECT {TEXT_ROWS} FROM lineitem) t
        JOIN part ON p_partkey = grp_id),
    l AS (SELECT *, concat(quantity, ' ', name) AS line FROM r)
    SELECT deck_id, concat(
      coalesce(string_agg(line, chr(10) ORDER BY pos, line) FILTER (WHERE board = 'main'), ''),
      CASE WHEN count(*) FILTER (WHERE board = 'side') > 0 THEN concat(
        CASE WHEN count(*) FILTER (WHERE board = 'main') > 0 THEN chr(10) ELSE '' END, chr(10),
        string_agg(line, chr(10) ORDER BY pos, line) FILTER (WHERE board = 'side')) ELSE '' END) AS text
    FROM l GROUP BY deck_id""",
)
def _(spark, sf):
    return D.format_deck_lists(text_rows(spark, sf))


def deck_texts(spark, sf):
    return D.format_deck_lists(text_rows(spark, sf))


@query(
    "parse_deck_lists",
    f"""WITH r AS (SELECT t.*, p_name AS name FROM (SELECT {TEXT_ROWS} FROM lineitem) t
        JOIN part ON p_partkey = grp_id)
    SELECT deck_id, board, name, CAST(sum(quantity) AS BIGINT) AS quantity
    FROM r GROUP BY deck_id, board, name""",
)
def _(spark, sf):
    cards, _errors = D.parse_deck_lists(deck_texts(spark, sf))
    return cards.select("deck_id", "board", "name", "quantity")


@query(
    "parse_deck_lists_errors",
    """WITH l AS (
      SELECT doc_id AS deck_id, unnest(string_split(text, chr(10))) AS raw,
        generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents),
    t AS (SELECT deck_id, CAST(pos AS INTEGER) AS pos,
      regexp_replace(raw, '^[\\t\\n\\x0B\\f\\r ]+|[\\t\\n\\x0B\\f\\r ]+$', '', 'g') AS line FROM l)
    SELECT deck_id, pos, concat('Could not parse: ', line) AS error FROM t
    WHERE line <> '' AND NOT starts_with(line, '//') AND NOT regexp_matches(line, '^[0-9]+\\s+.')""",
)
def _(spark, sf):
    docs = table(spark, sf, "documents").selectExpr("doc_id AS deck_id", "text")
    return D.parse_deck_lists(docs)[1]


@query(
    "collection_grid",
    f"""WITH {MAPPING_SQL}, {COLLECTION_SQL}, mine AS (
      SELECT grp_id, max(quantity) AS quantity FROM collection GROUP BY grp_id)
    SELECT grp_id, name, CASE WHEN rarity = '' THEN 'common' ELSE rarity END AS rarity,
      coalesce(quantity, 0) AS owned
    FROM mapping LEFT JOIN mine USING (grp_id)""",
)
def _(spark, sf):
    held = fold_collection(ownings(spark, sf), at="upd").groupBy("grp_id").agg(
        F.max("quantity").alias("quantity")
    )
    return D.collection_grid(mapping(spark, sf), held)


@query(
    "collection_grid_of_set",
    f"""WITH {MAPPING_SQL}, {COLLECTION_SQL}, mine AS (
      SELECT grp_id, max(quantity) AS quantity FROM collection GROUP BY grp_id)
    SELECT grp_id, name, CASE WHEN rarity = '' THEN 'common' ELSE rarity END AS rarity,
      coalesce(quantity, 0) AS owned
    FROM mapping LEFT JOIN mine USING (grp_id) WHERE setCode = 'BRAND#7'""",
)
def _(spark, sf):
    held = fold_collection(ownings(spark, sf), at="upd").groupBy("grp_id").agg(
        F.max("quantity").alias("quantity")
    )
    return D.collection_grid(mapping(spark, sf), held, "BRAND#7")


STATE_COLUMNS = """
    user_id AS match_id, event_id AS seq, CAST(floor(event_id / 400) AS BIGINT) AS turn,
    CAST(floor(value / 40) AS BIGINT) AS library, event_type AS hand,
    CASE WHEN value > 30 THEN CAST(floor(value / 100) AS BIGINT) ELSE NULL END AS graveyard
"""


@query(
    "turn_changes",
    f"""WITH s AS (SELECT {STATE_COLUMNS} FROM events),
    p AS (SELECT *, lag(1) OVER w AS has_prev, lag(turn) OVER w AS pt, lag(library) OVER w AS pl,
        lag(hand) OVER w AS ph, lag(graveyard) OVER w AS pg
      FROM s WINDOW w AS (PARTITION BY match_id ORDER BY seq))
    SELECT match_id, seq, turn, library, hand, graveyard,
      has_prev IS NOT NULL AND turn IS DISTINCT FROM pt AS turn_changed,
      has_prev IS NOT NULL AND library IS DISTINCT FROM pl AS library_changed,
      has_prev IS NOT NULL AND hand IS DISTINCT FROM ph AS hand_changed,
      has_prev IS NOT NULL AND graveyard IS DISTINCT FROM pg AS graveyard_changed
    FROM p""",
)
def _(spark, sf):
    return D.turn_changes(view(table(spark, sf, "events"), STATE_COLUMNS))
