"""Card-id mapping over parts: card tables, printings and bulk cards derived from them."""

from pyspark.sql import functions as F

from cardloom.bindings.registry import MAPPING_SQL, mapping, query, table, view
from cardloom.functions import cards as C
from cardloom.operators import idmap as I

# Card table: one card per part; codes outside the tables occur.
CARDS_COLUMNS = """
    p_partkey AS GrpId, p_partkey AS TitleId, 1000000000 + p_size AS TypeTextId,
    p_size % 8 AS Rarity, CASE WHEN p_size % 11 = 0 THEN 1 ELSE 0 END AS IsToken,
    CASE WHEN p_size % 7 = 0 THEN 0 ELSE 1 END AS IsPrimaryCard,
    CASE WHEN p_size % 13 = 0 THEN NULL ELSE lower(p_brand) END AS ExpansionCode,
    CASE p_size % 5 WHEN 0 THEN '1,3' WHEN 1 THEN '' WHEN 2 THEN '5, 6' WHEN 3 THEN '2,,4'
      ELSE NULL END AS Colors,
    CASE p_size % 3 WHEN 0 THEN '1,2,3,4,5' WHEN 1 THEN '9' ELSE '' END AS ColorIdentity,
    CASE p_size % 4 WHEN 0 THEN 'o2oUoU' WHEN 1 THEN '' WHEN 2 THEN 'oXo(W/U)' ELSE NULL END
      AS OldSchoolManaText
"""
LOC_TITLES = "p_partkey AS LocId, p_name AS Loc"
LOC_TYPES = "1000000000 + p_size AS LocId, min(p_type) AS Loc"
SOURCE_SQL = f"""cards AS (SELECT {CARDS_COLUMNS} FROM part),
  loc AS (SELECT {LOC_TITLES} FROM part WHERE p_size <> 10
    UNION ALL SELECT {LOC_TYPES} FROM part WHERE p_size <> 9 GROUP BY p_size)"""
LOCALISED_SQL = """localised AS (
  SELECT c.*, coalesce(t.Loc, concat('Unknown (', c.TitleId, ')')) AS name, coalesce(y.Loc, '') AS type
  FROM cards c LEFT JOIN loc t ON t.LocId = c.TitleId LEFT JOIN loc y ON y.LocId = c.TypeTextId)"""


def _colours(c: str) -> str:
    names = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in ((1, "W"), (2, "U"), (3, "B"), (4, "R"), (5, "G")))
    return (
        f"array_to_string(list_transform(list_filter(list_transform(string_split(coalesce({c}, ''), ','), "
        f"lambda x: trim(x)), lambda x: x <> ''), lambda x: CASE x {names} ELSE x END), ',')"
    )


RARITY = """CASE Rarity WHEN 0 THEN 'token' WHEN 1 THEN 'common' WHEN 2 THEN 'uncommon'
  WHEN 3 THEN 'rare' WHEN 4 THEN 'mythic' WHEN 5 THEN 'land' ELSE 'common' END"""
MANA = "regexp_replace(coalesce(OldSchoolManaText, ''), 'o([^o]+)', '{\\1}', 'g')"
TABLE_MAPPING = f"""SELECT GrpId AS grp_id, name, {MANA} AS manaCost, type, {RARITY} AS rarity,
    {_colours('Colors')} AS colors, {_colours('ColorIdentity')} AS colorIdentity, '' AS text,
    upper(coalesce(ExpansionCode, '')) AS setCode
  FROM localised WHERE IsToken = 0 AND IsPrimaryCard = 1"""


def cards(spark, sf):
    return view(table(spark, sf, "part"), CARDS_COLUMNS)


def loc(spark, sf):
    part = table(spark, sf, "part")
    titles = view(part.filter("p_size <> 10"), LOC_TITLES)
    types = part.filter("p_size <> 9").groupBy("p_size").agg(F.min("p_type").alias("Loc"))
    typed = types.select(
        (F.lit(1000000000) + F.col("p_size")).cast("bigint").alias("LocId"), "Loc"
    )
    return titles.unionByName(typed)


def _flat(df):
    return df.select(
        *[
            F.array_join(c, ",").alias(c) if c in ("colors", "colorIdentity") else c
            for c in df.columns
        ]
    )


@query(
    "localise",
    f"WITH {SOURCE_SQL}, {LOCALISED_SQL} SELECT GrpId, name, type FROM localised",
)
def _(spark, sf):
    return I.localise(cards(spark, sf), loc(spark, sf)).select("GrpId", "name", "type")


@query(
    "primary_cards",
    f"WITH {SOURCE_SQL} SELECT GrpId, Rarity, ExpansionCode FROM cards WHERE IsToken = 0 AND IsPrimaryCard = 1",
)
def _(spark, sf):
    return I.primary_cards(cards(spark, sf)).select("GrpId", "Rarity", "ExpansionCode")


@query("decode_rarity", f"WITH {SOURCE_SQL} SELECT GrpId, {RARITY} AS rarity FROM cards")
def _(spark, sf):
    return cards(spark, sf).select("GrpId", C.decode_rarity("Rarity").alias("rarity"))


@query("decode_colours", f"WITH {SOURCE_SQL} SELECT GrpId, {_colours('Colors')} AS colors FROM cards")
def _(spark, sf):
    return cards(spark, sf).select(
        "GrpId", F.array_join(C.decode_colours("Colors"), ",").alias("colors")
    )


@query("normalise_mana", f"WITH {SOURCE_SQL} SELECT GrpId, {MANA} AS mana FROM cards")
def _(spark, sf):
    return cards(spark, sf).select("GrpId", C.normalise_mana("OldSchoolManaText").alias("mana"))


@query("card_table_mapping", f"WITH {SOURCE_SQL}, {LOCALISED_SQL} {TABLE_MAPPING}")
def _(spark, sf):
    return _flat(I.card_table_mapping(cards(spark, sf), loc(spark, sf)))


# Printings: several per id, ids as text, some of them no ids.
PRINT_COLUMNS = """
    CAST(p_size AS BIGINT) AS set_pos, p_brand AS set_code, p_partkey AS card_pos,
    CASE WHEN p_partkey % 17 = 0 THEN 'abc' WHEN p_partkey % 19 = 0 THEN '0'
      WHEN p_partkey % 23 = 0 THEN NULL
      ELSE CAST(CAST(floor(p_partkey / 3) AS BIGINT) AS STRING) END AS id_text,
    CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_name END AS name,
    CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_type END AS text
"""
PRINTINGS_SQL = f"""p AS (SELECT {PRINT_COLUMNS} FROM part),
  printings AS (SELECT TRY_CAST(id_text AS BIGINT) AS grp_id, coalesce(name, 'Unknown') AS name,
      '' AS manaCost, '' AS type, 'common' AS rarity, '' AS colors, '' AS colorIdentity,
      coalesce(text, '') AS text, set_code AS setCode FROM p
    WHERE TRY_CAST(id_text AS BIGINT) > 0
    QUALIFY row_number() OVER (PARTITION BY TRY_CAST(id_text AS BIGINT) ORDER BY set_pos, card_pos) = 1)"""


def printings(spark, sf):
    rows = view(table(spark, sf, "part"), PRINT_COLUMNS)
    none = F.lit(None).cast("string")
    lists = F.lit(None).cast("array<string>")
    card = F.struct(
        "name",
        none.alias("manaCost"),
        none.alias("type"),
        none.alias("rarity"),
        "text",
        lists.alias("colors"),
        lists.alias("colorIdentity"),
        F.struct(F.col("id_text").alias("mtgArenaId")).alias("identifiers"),
    )
    return rows.select("set_pos", "set_code", "card_pos", card.alias("card"))


@query("printings_mapping", f"WITH {PRINTINGS_SQL} SELECT * FROM printings")
def _(spark, sf):
    return _flat(I.printings_mapping(printings(spark, sf)))


BULK_COLUMNS = """
    CASE WHEN p_partkey % 13 = 0 THEN 'ja' ELSE 'en' END AS lang,
    CASE WHEN p_partkey % 29 = 0 THEN NULL ELSE CAST(floor(p_partkey / 2) AS BIGINT) - 5 END AS arena_id,
    p_name AS name, CAST(NULL AS STRING) AS mana_cost, p_type AS type_line,
    CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE 'rare' END AS rarity,
    CASE WHEN p_partkey % 6 = 0 THEN '' ELSE concat('bulk ', p_name) END AS oracle_text,
    CASE WHEN p_partkey % 31 = 0 THEN NULL ELSE lower(p_brand) END AS set_id,
    p_partkey AS input_pos
"""
BULK_SQL = f"""b AS (SELECT {BULK_COLUMNS} FROM part),
  bulk AS (SELECT arena_id AS grp_id, name, '' AS manaCost, type_line AS type,
      coalesce(rarity, 'common') AS rarity, '' AS colors, '' AS colorIdentity, oracle_text AS text,
      upper(coalesce(set_id, '')) AS setCode FROM b WHERE lang = 'en' AND arena_id > 0
    QUALIFY row_number() OVER (PARTITION BY arena_id ORDER BY input_pos) = 1)"""


def bulk(spark, sf):
    rows = view(table(spark, sf, "part"), BULK_COLUMNS)
    lists = F.lit(None).cast("array<string>")
    return rows.select(
        "*", F.col("set_id").alias("set"), lists.alias("colors"), lists.alias("color_identity")
    )


@query("bulk_mapping", f"WITH {BULK_SQL} SELECT * FROM bulk")
def _(spark, sf):
    return _flat(I.bulk_mapping(bulk(spark, sf)))


MERGE_SQL = f"""WITH {PRINTINGS_SQL}, {BULK_SQL}, j AS (
    SELECT coalesce(p.grp_id, b.grp_id) AS grp_id, p.grp_id AS pid, b.grp_id AS bid,
      p.name AS pn, b.name AS bn, p.text AS pt, b.text AS bt, p.setCode AS ps, b.setCode AS bs
    FROM printings p FULL JOIN bulk b ON p.grp_id = b.grp_id)"""


@query(
    "merge_backfill",
    f"""{MERGE_SQL} SELECT grp_id, coalesce(pn, bn) AS name,
      CASE WHEN pid IS NULL THEN bt WHEN pt = '' AND coalesce(bt, '') <> '' THEN bt ELSE pt END AS text,
      CASE WHEN pid IS NULL THEN bs ELSE ps END AS setCode FROM j""",
)
def _(spark, sf):
    merged, _counts = I.merge_backfill(
        I.printings_mapping(printings(spark, sf)), I.bulk_mapping(bulk(spark, sf))
    )
    return merged.select("grp_id", "name", "text", "setCode")


@query(
    "merge_backfill_counts",
    f"""{MERGE_SQL} SELECT count(*) FILTER (WHERE pid IS NULL) AS new_cards,
      count(*) FILTER (WHERE pid IS NOT NULL AND pt = '' AND coalesce(bt, '') <> '') AS text_backfills
    FROM j""",
)
def _(spark, sf):
    return I.merge_backfill(
        I.printings_mapping(printings(spark, sf)), I.bulk_mapping(bulk(spark, sf))
    )[1]


@query("choose_primary", f"WITH {SOURCE_SQL}, {LOCALISED_SQL} SELECT grp_id, name FROM ({TABLE_MAPPING})")
def _(spark, sf):
    chosen = I.choose_primary(
        I.card_table_mapping(cards(spark, sf), loc(spark, sf)),
        I.printings_mapping(printings(spark, sf)),
    )
    return chosen.select("grp_id", "name")


@query(
    "cards_per_set",
    f"""WITH {MAPPING_SQL}, wanted AS (
      SELECT DISTINCT upper(p_brand) AS setCode FROM part UNION SELECT DISTINCT upper(r_name) FROM region)
    SELECT setCode, count(grp_id) AS cards FROM wanted LEFT JOIN mapping USING (setCode) GROUP BY setCode""",
)
def _(spark, sf):
    own = table(spark, sf, "part").selectExpr("upper(p_brand) AS setCode")
    other = table(spark, sf, "region").selectExpr("upper(r_name) AS setCode")
    return I.cards_per_set(mapping(spark, sf), own.unionByName(other).distinct())


@query("set_list", f"WITH {MAPPING_SQL} SELECT DISTINCT setCode FROM mapping")
def _(spark, sf):
    return I.set_list(mapping(spark, sf))


@query("cards_in_set", f"WITH {MAPPING_SQL} SELECT grp_id, name, setCode FROM mapping WHERE setCode = 'BRAND#12'")
def _(spark, sf):
    return I.cards_in_set(mapping(spark, sf), "BRAND#12").select("grp_id", "name", "setCode")


@query("cards_in_all_sets", f"WITH {MAPPING_SQL} SELECT grp_id, name, setCode FROM mapping")
def _(spark, sf):
    return I.cards_in_set(mapping(spark, sf)).select("grp_id", "name", "setCode")
