"""Bulk card records derived from parts and documents."""

from pyspark.sql import functions as F

from cardloom.bindings.registry import MAPPING_SQL, mapping, query, table, view
from cardloom.functions import cards as C
from cardloom.functions.exprs import natural_sort_key
from cardloom.operators import catalogue as K

# Scalars of a bulk card; the nested record is put together from them.
BULK_COLUMNS = """
    CAST(p_partkey AS STRING) AS id, p_partkey AS input_pos, p_name AS name,
    CASE WHEN p_partkey % 8 = 0 THEN 'fr' ELSE 'en' END AS lang,
    CASE p_partkey % 9 WHEN 0 THEN TRUE WHEN 1 THEN NULL ELSE FALSE END AS digital,
    CASE WHEN p_partkey % 41 = 0 THEN '' ELSE lower(p_brand) END AS set_id,
    concat(p_type, CAST(p_partkey % 2 AS STRING)) AS set_name,
    CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE CAST(p_retailprice AS STRING) END AS usd,
    CASE p_partkey % 7 WHEN 0 THEN 'n/a' WHEN 1 THEN '' WHEN 2 THEN NULL ELSE '950.25' END AS foil,
    CASE WHEN p_partkey % 5 = 0 THEN ' 7.5 ' ELSE NULL END AS etched,
    CASE p_partkey % 4 WHEN 0 THEN 'u-normal' WHEN 1 THEN '' ELSE NULL END AS normal_uri,
    CASE WHEN p_partkey % 10 = 1 THEN 'u-large' ELSE NULL END AS large_uri,
    CASE WHEN p_partkey % 3 = 0 THEN 'face1' ELSE '' END AS face1,
    CASE WHEN p_partkey % 5 = 2 THEN 'face2' ELSE NULL END AS face2,
    CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'W' ELSE 'W,U' END AS colour_text,
    CASE p_size % 4 WHEN 0 THEN concat(CAST(p_size AS STRING), 'a') WHEN 1 THEN CAST(p_partkey AS STRING)
      WHEN 2 THEN concat('A-', CAST(p_size AS STRING)) ELSE concat('T', CAST(p_partkey AS STRING), 'b') END AS number,
    CASE WHEN p_size % 6 = 0 THEN NULL ELSE p_type END AS type_line
"""
BULK = f"b AS (SELECT {BULK_COLUMNS} FROM part)"


def bulk(spark, sf):
    b = view(table(spark, sf, "part"), BULK_COLUMNS)
    none = F.lit(None).cast("string")
    uris = lambda n, g: F.struct(
        n.alias("normal"), g.alias("large"), none.alias("png")
    )
    listed = F.when(
        F.col("colour_text").isNotNull(),
        F.filter(F.split("colour_text", ","), lambda x: x != ""),
    )
    face = lambda u, i: F.struct(
        F.concat_ws("/", "name", F.lit(str(i))).alias("name"),
        *[none.alias(n) for n in K.FACE_FIELDS[1:]],
        F.lit(None).cast("array<string>").alias("colors"),
        uris(u, none).alias("image_uris"),
    )
    return b.select(
        "*",
        F.col("set_id").alias("set"),
        F.col("name").alias("released_at"),
        F.col("number").alias("collector_number"),
        F.lit("rare").alias("rarity"),
        none.alias("mana_cost"),
        F.col("input_pos").cast("double").alias("cmc"),
        none.alias("oracle_text"),
        none.alias("power"),
        none.alias("toughness"),
        none.alias("loyalty"),
        F.lit("normal").alias("layout"),
        listed.alias("colors"),
        listed.alias("color_identity"),
        listed.alias("keywords"),
        F.struct(
            F.col("usd"), F.col("foil").alias("usd_foil"), F.col("etched").alias("usd_etched")
        ).alias("prices"),
        uris(F.col("normal_uri"), F.col("large_uri")).alias("image_uris"),
        F.array(face(F.col("face1"), 1), face(F.col("face2"), 2)).alias("card_faces"),
    )


PRICE = {c: f"TRY_CAST({c} AS DOUBLE)" for c in ("usd", "foil", "etched")}
BEST = f"greatest({PRICE['usd']}, {PRICE['foil']}, {PRICE['etched']})"
IMAGE = """coalesce(nullif(normal_uri, ''), nullif(large_uri, ''), nullif(face1, ''), nullif(face2, ''))"""
KEPT = "lang = 'en' AND NOT coalesce(digital, FALSE)"


@query("paper_english", f"WITH {BULK} SELECT id, lang, digital FROM b WHERE {KEPT}")
def _(spark, sf):
    return K.paper_english(bulk(spark, sf)).select("id", "lang", "digital")


@query(
    "normalise_prices",
    f"""WITH {BULK} SELECT id, {PRICE['usd']} AS price_usd, {PRICE['foil']} AS price_usd_foil,
      {PRICE['etched']} AS price_usd_etched, {BEST} AS price_best FROM b""",
)
def _(spark, sf):
    return K.normalise_prices(bulk(spark, sf)).select(
        "id", "price_usd", "price_usd_foil", "price_usd_etched", "price_best"
    )


@query("image_url", f"WITH {BULK} SELECT id, {IMAGE} AS image_url FROM b")
def _(spark, sf):
    return bulk(spark, sf).select("id", C.image_url("image_uris", "card_faces").alias("image_url"))


FLAT = f"""SELECT id, name, set_id AS set, set_name, number AS collector_number, 'rare' AS rarity,
    type_line, CAST(NULL AS VARCHAR) AS mana_cost, CAST(input_pos AS DOUBLE) AS cmc, CAST(NULL AS VARCHAR) AS oracle_text, CAST(NULL AS VARCHAR) AS power,
    CAST(NULL AS VARCHAR) AS toughness, CAST(NULL AS VARCHAR) AS loyalty, 'normal' AS layout, coalesce(colour_text, '') AS colors,
    coalesce(colour_text, '') AS color_identity, coalesce(colour_text, '') AS keywords,
    {IMAGE} AS image_url, {PRICE['usd']} AS price_usd, {PRICE['foil']} AS price_usd_foil,
    {PRICE['etched']} AS price_usd_etched, {BEST} AS price_best FROM b WHERE {KEPT}"""


def flat(spark, sf):
    return K.flatten_card(K.paper_english(bulk(spark, sf)))


@query("flatten_card", f"WITH {BULK} {FLAT}")
def _(spark, sf):
    return flat(spark, sf)


@query(
    "sets_from_cards",
    f"""WITH {BULK} SELECT set_id AS set, arg_min(set_name, input_pos) AS set_name,
      arg_min(name, input_pos) AS released_at FROM b WHERE {KEPT} AND set_id <> '' GROUP BY set_id""",
)
def _(spark, sf):
    return K.sets_from_cards(K.paper_english(bulk(spark, sf)))


@query(
    "card_faces",
    """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS name,
      generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents)
    SELECT CAST(doc_id AS VARCHAR) AS card_id, CAST(i AS INTEGER) AS face_index, name, CAST(NULL AS VARCHAR) AS mana_cost,
      CAST(NULL AS VARCHAR) AS type_line, CAST(NULL AS VARCHAR) AS oracle_text, CAST(NULL AS VARCHAR) AS power, CAST(NULL AS VARCHAR) AS toughness, CAST(NULL AS VARCHAR) AS loyalty,
      concat(length(name) % 3, ',x') AS colors FROM l""",
)
def _(spark, sf):
    none = F.lit(None).cast("string")
    docs = table(spark, sf, "documents")
    faces = F.transform(
        F.split("text", "\n"),
        lambda x: F.struct(
            x.alias("name"),
            *[none.alias(n) for n in K.FACE_FIELDS[1:]],
            F.array((F.length(x) % 3).cast("string"), F.lit("x")).alias("colors"),
        ),
    )
    return K.card_faces(
        docs.select(F.col("doc_id").cast("string").alias("id"), faces.alias("card_faces"))
    )


CODES = ["brand#1", "Brand#12", "BRAND#7", "brand#99"]


@query(
    "filter_sets",
    f"""WITH {BULK} SELECT id, upper(set_id) AS set FROM b
    WHERE upper(set_id) IN ('BRAND#1', 'BRAND#12', 'BRAND#7', 'BRAND#99')""",
)
def _(spark, sf):
    return K.filter_sets(bulk(spark, sf).select("id", "set"), CODES)


APP = f"""app AS (SELECT id, name, set AS setCode, set_name AS setName, collector_number AS collectorNumber,
    colors, coalesce(type_line, '') AS typeLine, rarity,
    CASE WHEN price_best > 0 THEN printf('$%.2f', price_best) END AS valueHint, image_url AS imageUrl
  FROM ({FLAT}))"""


@query("app_catalogue", f"WITH {BULK}, {APP} SELECT * FROM app")
def _(spark, sf):
    app = K.require_rows(K.app_catalogue(flat(spark, sf)), "cards")
    return app.withColumn("colors", F.array_join("colors", ","))


@query(
    "cards_by_set",
    f"""WITH {BULK}, h AS (SELECT set_id, min(input_pos) AS f, arg_min(set_name, input_pos) AS n,
        count(*) AS set_size FROM b GROUP BY set_id),
    r AS (SELECT *, row_number() OVER (ORDER BY f, set_id) AS set_index FROM h)
    SELECT set_index, set_size, id, input_pos, b.set_id AS setCode, n AS setName FROM b JOIN r USING (set_id)""",
)
def _(spark, sf):
    b = bulk(spark, sf).select(
        "id", "input_pos", F.col("set_id").alias("setCode"), F.col("set_name").alias("setName")
    )
    return K.cards_by_set(b)


@query(
    "browse_cards",
    f"""WITH {BULK}, {APP} SELECT id, name, collectorNumber FROM app
    WHERE setCode = 'brand#7' AND colors = 'W,U' AND lower(name) LIKE '%re%'""",
)
def _(spark, sf):
    app = K.app_catalogue(flat(spark, sf))
    return K.browse_cards(app, "brand#7", "MULTI", " RE ").select("id", "name", "collectorNumber")


@query(
    "colour_class",
    f"""WITH {BULK} SELECT id, CASE coalesce(colour_text, '') WHEN '' THEN 'C' WHEN 'W' THEN 'W' ELSE 'MULTI' END AS class
    FROM b""",
)
def _(spark, sf):
    return bulk(spark, sf).select("id", C.colour_class("colors").alias("class"))


# Numbers of the derived cards: '12a', '17', 'A-12' or 'T17b' (one digit run each).
NUMBER_ORDER = """coalesce(TRY_CAST(regexp_extract(number, '^([0-9]+)', 1) AS BIGINT), 4611686018427387904),
    lower(concat(regexp_extract(number, '^([^0-9]*)', 1),
      lpad(regexp_extract(number, '([0-9]+)', 1), 20, '0'), regexp_extract(number, '([^0-9]*)$', 1))), number, id"""


@query(
    "natural_sort_key",
    f"""WITH {BULK} SELECT id, number, row_number() OVER (ORDER BY {NUMBER_ORDER}) AS place FROM b""",
)
def _(spark, sf):
    from cardloom.operators.ordered import row_positions

    k = natural_sort_key("number")
    keyed = bulk(spark, sf).select(
        "id", "number", *[k[x].alias(f"k_{x}") for x in ("coarse", "side", "number", "beyond", "ordered", "raw")]
    )
    order = ["k_coarse", "k_side", "k_number", "k_beyond", "k_ordered", "k_raw", "id"]
    return row_positions(keyed, [], order, "place").select("id", "number", "place")


@query(
    "index_page",
    f"""WITH {BULK} SELECT id, set_id AS setCode, number AS collectorNumber,
      row_number() OVER (PARTITION BY set_id ORDER BY {NUMBER_ORDER}) AS position,
      count(*) OVER (PARTITION BY set_id) AS n FROM b""",
)
def _(spark, sf):
    b = bulk(spark, sf).select(
        "id", F.col("set_id").alias("setCode"), F.col("number").alias("collectorNumber")
    )
    return K.index_page(b)


@query(
    "index_page_hot_set",
    f"""WITH {BULK}, h AS (SELECT id, 'HOT' AS setCode, CASE WHEN number LIKE '%7' THEN NULL ELSE number END AS number FROM b)
    SELECT id, setCode, number AS collectorNumber, row_number() OVER (PARTITION BY setCode ORDER BY {NUMBER_ORDER}) AS position,
      count(*) OVER (PARTITION BY setCode) AS n FROM h""",
)
def _(spark, sf):
    """One set of all cards, cut into chunks; many cards share a number or have none."""
    number = F.when(~F.col("number").like("%7"), F.col("number")).alias("collectorNumber")
    b = bulk(spark, sf).select("id", F.lit("HOT").alias("setCode"), number)
    return K.index_page(b, hot_rows=100)


@query(
    "index_page_second",
    f"""WITH {BULK} SELECT id, set_id AS setCode, number AS collectorNumber,
      row_number() OVER (PARTITION BY set_id ORDER BY {NUMBER_ORDER}) AS position,
      count(*) OVER (PARTITION BY set_id) AS n FROM b QUALIFY position = 2""",
)
def _(spark, sf):
    b = bulk(spark, sf).select(
        "id", F.col("set_id").alias("setCode"), F.col("number").alias("collectorNumber")
    )
    return K.index_page(b, 1)


@query(
    "split_type_line",
    f"""WITH {MAPPING_SQL}, p AS (SELECT grp_id, type,
      list_filter(list_transform(string_split(type, '—'), lambda x: trim(x)), lambda x: x <> '') AS parts FROM mapping)
    SELECT grp_id, CASE WHEN len(parts) >= 2 THEN parts[1] ELSE type END AS main_type,
      CASE WHEN len(parts) >= 2 THEN array_to_string(parts[2:], ' — ') ELSE '' END AS subtype FROM p""",
)
def _(spark, sf):
    return mapping(spark, sf).select("grp_id", C.split_type_line("type").alias("t")).select(
        "grp_id", "t.main_type", "t.subtype"
    )
