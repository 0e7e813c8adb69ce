"""Registry of bound queries and the input views both sides start from.

An input view only renames and computes columns of the driver's tables; its text is valid
in Spark SQL and DuckDB. The operator under test is Spark code on one side and an
independent SQL statement on the other.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

ROWS_PER_TASK = 500_000  # rows of a table that one task groups; about 400 MB with wide logs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def tasks(df: DataFrame) -> int:
    """Tasks for the groups of a table: as many as its rows need, so that none grows with the table."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // ROWS_PER_TASK))


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` is its counterpart for DuckDB."""

    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


# Match records: one per order.
MATCH_COLUMNS = """
    o_orderkey AS id,
    CASE o_orderkey % 9
      WHEN 0 THEN 'Traditional_Historic_Ladder' WHEN 1 THEN 'QuickDraft_LTR_20230711'
      WHEN 2 THEN 'Alchemy_Ladder_x' WHEN 3 THEN 'FooBar_ABC_20200101' WHEN 4 THEN 'Play'
      WHEN 5 THEN 'Sealed_MOM' WHEN 6 THEN 'my_event' WHEN 7 THEN 'Explorer_Ladder'
      ELSE 'CamelCaseEvent' END AS event_id,
    CASE WHEN o_orderkey % 10 = 0 THEN '' ELSE o_orderpriority END AS format,
    o_custkey % 20 AS deck_id,
    CASE WHEN o_custkey % 20 = 0 THEN '' ELSE concat('Deck ', CAST(o_custkey % 20 AS STRING)) END
      AS deck_name,
    CASE o_orderstatus WHEN 'F' THEN 'win' WHEN 'O' THEN 'loss' ELSE 'draw' END AS result,
    1 + o_orderkey % 3 AS game_count,
    o_orderdate AS started_at,
    o_orderkey % 2 = 0 AS on_play,
    CASE o_orderkey % 5 WHEN 0 THEN 'a note' WHEN 1 THEN ' ' ELSE NULL END AS notes,
    CASE o_orderkey % 4 WHEN 0 THEN 'Damage' WHEN 1 THEN 'Unknown' ELSE NULL END AS win_condition,
    o_orderkey % 12 AS final_turn,
    CASE o_orderkey % 6 WHEN 0 THEN 'Android' WHEN 1 THEN 'WindowsPC' WHEN 2 THEN 'Mac'
      WHEN 3 THEN 'Web' WHEN 4 THEN '' ELSE NULL END AS opponent_platform
"""
MATCHES_SQL = f"""matches AS (
  SELECT {MATCH_COLUMNS}, c_mktsegment AS opponent_name
  FROM orders JOIN customer ON o_custkey = c_custkey)"""


def _columns(text: str) -> list[str]:
    """Split a select list at its top-level commas."""
    out, depth, quoted, start = [], 0, False, 0
    for i, ch in enumerate(text):
        if ch == "'":
            quoted = not quoted
        elif not quoted and ch in "([":
            depth += 1
        elif not quoted and ch in ")]":
            depth -= 1
        elif not quoted and ch == "," and depth == 0:
            out.append(text[start:i].strip())
            start = i + 1
    out.append(text[start:].strip())
    return [c for c in out if c]


def view(df: DataFrame, columns: str) -> DataFrame:
    """Apply an input view's select list."""
    return df.selectExpr(*_columns(columns))


def matches(spark: SparkSession, sf: str) -> DataFrame:
    orders, customers = table(spark, sf, "orders"), table(spark, sf, "customer")
    named = customers.select("c_custkey", "c_mktsegment")
    joined = orders.join(named, orders["o_custkey"] == named["c_custkey"])
    return view(joined, MATCH_COLUMNS + ", c_mktsegment AS opponent_name")


# Card records: one per part.
CARD_COLUMNS = """
    p_partkey AS grp_id, p_name AS name,
    CASE p_partkey % 5 WHEN 0 THEN '{2}{W}{W}' WHEN 1 THEN '{X}{u/r}{g}' WHEN 2 THEN ''
      WHEN 3 THEN '{10}{c}' ELSE 'none' END AS manaCost,
    CASE p_size % 9 WHEN 0 THEN 'Legendary Creature — Elf' WHEN 1 THEN 'Instant'
      WHEN 2 THEN 'Sorcery — Arcane' WHEN 3 THEN 'Enchantment Artifact' WHEN 4 THEN 'Artifact'
      WHEN 5 THEN 'Planeswalker — X — Y' WHEN 6 THEN 'Basic Land — Island'
      WHEN 7 THEN '' ELSE p_type END AS type,
    CASE p_size % 5 WHEN 0 THEN 'common' WHEN 1 THEN 'uncommon' WHEN 2 THEN 'rare'
      WHEN 3 THEN 'mythic' ELSE '' END AS rarity,
    CASE WHEN p_partkey % 3 = 0 THEN '' ELSE concat('text ', p_name) END AS text,
    upper(p_brand) AS setCode
"""
MAPPING_SQL = f"mapping AS (SELECT {CARD_COLUMNS} FROM part)"


def mapping(spark: SparkSession, sf: str) -> DataFrame:
    return view(table(spark, sf, "part"), CARD_COLUMNS)
