"""Log lines -> JSON messages -> routed messages -> deck names.

A line table has ``source_file``, ``line_no`` (order inside the file, of any type that can be ordered) and
``line``. ``plans.log_flow.parser_lines`` puts the player and the place among all files there.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cardloom.functions.exprs import col, emit
from cardloom.functions.variants import (
    emit_json,
    first_obj,
    first_text_of,
    has,
    is_object,
    items,
    obj,
    strict_json,
    sub,
    text,
)
from cardloom.operators.ordered import HOT_ROWS, running_last, split_hot
from cardloom.plans.staging import stage

# Marks of response and request lines.
ARROWS = ("<==", "==>")

# Words of a line that may carry a deck name, and the names of the fields.
DECK_LINE_WORDS = ("SetDeck", "DeckSubmit", "SubmitDeck", "CourseDeck", "courseDeck")
NAME_FIELD = r'(?i)"(?:deckName|name)"\s*:\s*"([^"]+)"'
ID_FIELD = r'(?i)"(?:deckId|id)"\s*:\s*"([^"]+)"'
UNKNOWN_DECK = "Unknown Deck"

LONE_BRACE = r"^\s*\},?\s*$"
EMBEDDED = r"(?s)\{.*\}"


def _braces(c: Column) -> Column:
    """Opening minus closing braces outside quoted text."""
    plain = F.regexp_replace(F.regexp_replace(c, r"\\.", ""), r'"[^"]*"', "")

    def without(brace: str) -> Column:
        return F.length(F.replace(plain, F.lit(brace), F.lit("")))

    return without("}") - without("{")


def extract_messages(lines: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """JSON messages of log lines, as ``(source_file, line_no, line, payload)``.

    * Arrow lines whose rest from the first ``{`` is JSON are emitted as they are. This is
      most of a log and needs no shuffle; nor do files in which no block opens.
    * An arrow line that is no JSON yet opens a block. The block ends at the first line
      where its text is JSON, or is dropped at a lone ``}`` / ``},``; lines in it belong to
      it. Strings cannot span lines, so the text can only be JSON where the brace depth is
      back at zero for the first time: depth is a running sum, and only the text up to
      that line is put together.
    * Other lines give their ``{…}`` part (first to last brace) if it is JSON.

    ``line`` of a block is its last line. Of a repeated key the last value counts; the
    session is set to read such objects. The parsed lines are staged (``plans.staging``).
    """
    lines.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    c = F.col("line")
    arrow = (c.contains(ARROWS[0]) | c.contains(ARROWS[1])) & c.contains("{")
    rest = F.expr("substring(line, locate('{', line))")
    cols = ["source_file", "line_no", "line"]

    # Each line is parsed once; everything else reads the result.
    own = F.when(arrow, rest).when(c.contains("{"), F.nullif(F.regexp_extract(c, EMBEDDED, 0), F.lit("")))
    base = lines.select(*cols, arrow.alias("arrow"))
    parsed = stage(emit_json(base, [*cols, "arrow"], own), "parsed-lines")
    whole = F.col("payload").isNotNull()
    starts = parsed.filter(F.col("arrow") & ~whole)
    if starts.isEmpty():
        return parsed.filter(whole).drop("arrow")
    # Only files in which a block opens need the order of their lines.
    files = starts.select(F.col("source_file").alias("__f")).distinct()
    in_file = F.col("source_file").eqNullSafe(F.col("__f"))
    alone = parsed.filter(whole & ~F.col("arrow")).join(files, in_file, "left_anti").drop("arrow")
    others = parsed.filter(~(F.col("arrow") & whole)).join(files, in_file, "left_semi")
    part = F.when(F.col("arrow"), rest).otherwise(c)
    marked = others.select(
        *cols,
        F.col("arrow").alias("start"),
        part.alias("part"),
        c.rlike(LONE_BRACE).alias("lone"),
        _braces(part).alias("delta"),
    )
    rows = _with_blocks(marked, parsed, hot_rows)

    # One group per block that reaches depth zero, and one per line outside blocks.
    group = F.coalesce("block", "line_no").alias("__g")
    pieces = F.sort_array(F.collect_list(F.struct("line_no", "part", "line"))).alias("__p")
    found = (
        rows.groupBy("source_file", group, "block", "unless_open")
        .agg(pieces)
        .select(
            "source_file",
            "block",
            "unless_open",
            F.element_at("__p", -1).alias("__last"),
            F.array_join(F.transform("__p", lambda x: x["part"]), "\n").alias("__text"),
        )
        .select(
            "source_file", "block", "unless_open", "__last.line_no", "__last.line", "__text"
        )
    )
    found = emit_json(found, ["source_file", "block", "unless_open", "line_no", "line"], F.col("__text"))
    # A block whose text is no JSON at depth zero stays open up to a lone brace, so the
    # lines after it that wait for its end are no messages.
    still_open = found.filter(F.col("block").isNotNull() & F.col("payload").isNull()).select(
        "source_file", F.col("block").alias("unless_open")
    )
    told = (
        found.filter(F.col("payload").isNotNull())
        .join(still_open, ["source_file", "unless_open"], "left_anti")
        .select("source_file", "line_no", "line", "payload")
    )
    whole_arrows = parsed.filter(F.col("arrow") & whole).drop("arrow")
    return whole_arrows.unionByName(alone).unionByName(told)


def _with_blocks(marked: DataFrame, lines: DataFrame, hot_rows: int) -> DataFrame:
    """Reduce lines to message parts.

    ``block`` is the first line of the block a part belongs to, null outside blocks;
    ``unless_open`` is the block that must have ended for the line to count. Everything
    runs on one partitioning by (file, chunk); a hot file hands its state from chunk to
    chunk through the carries.
    """
    c = split_hot(marked, ["source_file"], ["line_no"], hot_rows, sized_by=lines)
    upto = c.window.rowsBetween(Window.unboundedPreceding, 0)
    before = c.window.rowsBetween(Window.unboundedPreceding, -1)
    back = Window.partitionBy(*c._group()).orderBy(F.desc("line_no"))
    later = Window.partitionBy("source_file").orderBy(F.desc("__chunk")).rowsBetween(
        Window.unboundedPreceding, -1
    )
    hot_rows_df = c.df.filter("__hot")

    def depths(df: DataFrame) -> DataFrame:
        summed = df.select("*", F.sum("delta").over(upto).alias("__s"))
        opened = F.struct(F.col("line_no").alias("b"), (F.col("__s") - F.col("delta")).alias("s"))
        return summed.select("*", F.when(F.col("start"), opened).alias("__open"))

    def carry() -> DataFrame:
        sums = replace(c, df=depths(hot_rows_df)).summary(
            F.sum("delta").alias("__t"),
            F.max_by("__open", F.when(F.col("start"), F.col("line_no"))).alias("__o"),
        )
        offsets = sums.select(
            "*", F.coalesce(F.sum("__t").over(c.prefix()), F.lit(0)).alias("__off")
        )
        shifted = F.when(
            F.col("__o").isNotNull(),
            F.struct(F.col("__o.b").alias("b"), (F.col("__o.s") + F.col("__off")).alias("s")),
        )
        return offsets.select(*c.chunk_key(), "__off", shifted.alias("__o")).select(
            *c.chunk_key(), "__off", F.last("__o", True).over(c.prefix()).alias("__before")
        )

    keep = [*marked.columns, "__chunk", "__hot"]

    def blocks(df: DataFrame) -> DataFrame:
        placed = c.attach(
            depths(df).select("*", F.last("__open", True).over(upto).alias("__blk")),
            carry,
            {"__off": "bigint", "__before": "__blk"},
        )
        off = F.coalesce("__off", F.lit(0))
        base = F.coalesce(F.col("__blk.s") + off, F.col("__before.s"))
        b = F.coalesce("__blk.b", "__before.b")
        told = placed.select(*keep, b.alias("b"), (F.col("__s") + off - base).alias("depth"))
        line = F.col("line_no")
        return told.select(
            "*",
            F.when(F.col("depth") <= 0, line).alias("__zero"),
            F.when(F.col("lone") & (line > F.col("b")), line).alias("__brace"),
        )

    def ends_carry() -> DataFrame:
        ends = replace(c, df=blocks(hot_rows_df)).summary(
            F.max("__zero").alias("__z"), F.max("__brace").alias("__l")
        )
        return ends.select(
            *c.chunk_key(),
            F.last("__z", True).over(c.prefix()).alias("__zero_old"),
            F.last("__l", True).over(c.prefix()).alias("__brace_old"),
        )

    def states(df: DataFrame) -> DataFrame:
        seen = blocks(df).select(
            "*",
            F.last("__zero", True).over(before).alias("__zero_in"),
            F.last("__brace", True).over(before).alias("__brace_in"),
        )
        b = F.col("b")
        like = {"__zero_old": "__zero_in", "__brace_old": "__brace_in"}
        out = c.attach(seen, ends_carry, like).select(
            *keep,
            "b",
            "__zero",
            (F.coalesce("__zero_in", "__zero_old") > b).alias("after_zero"),
            (F.coalesce("__brace_in", "__brace_old") > b).alias("after_brace"),
        )
        no = F.lit(False)
        is_open = b.isNotNull() & ~F.coalesce("after_zero", no) & ~F.coalesce("after_brace", no)
        staged = out.select("*", is_open.alias("open"))
        hit = F.when(F.col("open") & F.col("__zero").isNotNull(), F.struct("line_no", "b"))
        return staged.select("*", hit.alias("__hit"))

    def firsts_carry() -> DataFrame:
        firsts = replace(c, df=states(hot_rows_df)).summary(
            F.min_by("__hit", F.when(F.col("__hit").isNotNull(), F.col("line_no"))).alias("__h")
        )
        return firsts.select(
            *c.chunk_key(), F.last("__h", True).over(later).alias("__hit_new")
        )

    ahead = states(c.df).select(
        "*",
        F.last("__hit", True)
        .over(back.rowsBetween(Window.unboundedPreceding, 0))
        .alias("__hit_in"),
    )
    full = c.attach(ahead, firsts_carry, {"__hit_new": "__hit_in"})
    b = F.col("b")
    reaches = F.col("open") & (F.coalesce("__hit_in", "__hit_new")["b"] == b)
    outside = ~F.col("open") & ~F.col("start") & F.col("line").contains("{")
    waits = F.col("after_zero") & ~F.coalesce("after_brace", F.lit(False))
    return full.filter(F.coalesce(reaches, F.lit(False)) | outside).select(
        "source_file",
        "line_no",
        "line",
        F.when(F.col("open"), F.col("part"))
        .otherwise(F.regexp_extract("line", EMBEDDED, 0))
        .alias("part"),
        F.when(F.col("open"), b).alias("block"),
        F.when(~F.col("open") & waits, b).alias("unless_open"),
    )


# Message kinds by the keys that tell them, in routing order.
INVENTORY_KEYS = ("InventoryInfo", "PlayerInventory", "inventoryInfo")
MATCH_KEY = "matchGameRoomStateChangedEvent"
GRE_KEYS = ("greToClientEvent", "GreToClientEvent")


def _any_key(v: Column, keys) -> Column:
    out = has(v, keys[0])
    for k in keys[1:]:
        out = out | has(v, k)
    return out


def route(messages: DataFrame) -> DataFrame:
    """Messages -> one row per kind they are handled as, with ``kind`` and ``ord``.

    Inventory, match and game-client messages are handled once; among the others a deck
    payload comes first, summaries and courses end the search, and what is left may be a
    course deck, a request and params at once. ``ord`` keeps the handling order in a line.
    """
    v = F.col("payload")
    is_list = {k: items(v, f"$.{k}").isNotNull() for k in ("Summaries", "Courses")}
    open_ended = F.array(
        F.when(has(v, "CourseDeck") | has(v, "DeckSubmit"), F.lit("course_deck")),
        F.when(has(v, "request") | has(v, "Request"), F.lit("request")),
        F.when(has(v, "params"), F.lit("params")),
    )
    rest = (
        F.when(is_list["Summaries"], F.array(F.lit("summaries")))
        .when(is_list["Courses"], F.array(F.lit("courses")))
        .otherwise(open_ended)
    )
    payload = F.array(
        F.when(F.schema_of_variant(sub(v, "$.Payload")) == "STRING", F.lit("payload"))
    )
    kinds = (
        F.when(_any_key(v, INVENTORY_KEYS), F.array(F.lit("inventory")))
        .when(has(v, MATCH_KEY), F.array(F.lit("match")))
        .when(_any_key(v, GRE_KEYS), F.array(F.lit("gre")))
        .otherwise(F.array_compact(F.concat(payload, rest)))
    )
    return messages.select(
        "source_file", "line_no", F.posexplode(kinds).alias("ord", "kind"), "payload"
    ).withColumn("ord", F.col("ord") + 1)


def deck_name_from_line(
    messages: DataFrame, other_names: DataFrame | None = None, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Deck selections told by the raw text of deck lines that gave a message.

    First name and id field of the line (any case). A line whose name is already the
    current one is no selection; ``other_names`` are the ``(source_file, line_no, ord,
    deck_name)`` of names that other operators found, which also change the current name.
    """
    line = F.col("line")
    worded = line.contains(DECK_LINE_WORDS[0])
    for w in DECK_LINE_WORDS[1:]:
        worded = worded | line.contains(w)
    found = (
        messages.filter(worded)
        .select(
            "source_file",
            "line_no",
            F.lit(0).alias("ord"),
            F.regexp_extract("line", ID_FIELD, 1).alias("deck_id"),
            F.regexp_extract("line", NAME_FIELD, 1).alias("deck_name"),
            F.lit(True).alias("__own"),
        )
        .filter(~F.col("deck_name").isin("", UNKNOWN_DECK))
    )
    if other_names is not None:
        found = found.unionByName(
            other_names.select("source_file", "line_no", "ord", "deck_name", F.lit(False).alias("__own")),
            allowMissingColumns=True,
        )
    told = running_last(
        found, ["source_file"], ["line_no", "ord"], {"__prev": F.col("deck_name")}, False, hot_rows
    )
    changed = F.col("__own") & ~F.col("deck_name").eqNullSafe(F.col("__prev"))
    return told.filter(changed).select("source_file", "line_no", "ord", "deck_id", "deck_name")


def deck_from_request(routed: DataFrame, other_names: DataFrame | None = None) -> DataFrame:
    """Deck selections in course-deck, request and params messages.

    A nested deck is always a selection when it has a known name. Direct name fields are
    one only while no name is known in the file: the earliest direct name, if it precedes
    every other name. Both are minima per file, so no order-dependent scan is needed.
    """
    p = F.col("payload")
    kind = F.col("kind")
    req = F.coalesce(sub(p, "$.request"), sub(p, "$.Request"))
    place = ["source_file", "line_no", "ord", "kind"]
    asked = emit(
        routed.filter(kind.isin("course_deck", "request", "params")),
        place,
        {
            "raw": F.when(kind == "request", req).when(kind == "params", obj(p, "$.params")),
            "course": F.when(kind == "course_deck", first_obj(p, "CourseDeck", "DeckSubmit")),
        },
    )
    raw, data = F.col("raw"), F.col("data")
    opened = emit(
        asked,
        [*place, "course"],
        {
            "data": F.when(F.schema_of_variant(raw) == "STRING", strict_json(text(raw, "$")))
            .otherwise(raw)
        },
    )
    typed = emit(
        opened,
        place,
        {
            "deck": F.coalesce(
                "course", first_obj(data, "deck", "Deck", "deckPayload", "DeckPayload")
            ),
            "data": F.when(is_object(data), data),
        },
    )
    d, x = F.col("deck"), F.col("data")
    course_row = kind == "course_deck"
    place = place[:3]

    def known(name: Column) -> Column:
        return ~F.coalesce(name, F.lit("")).isin("", UNKNOWN_DECK)

    nested = emit(
        typed.filter(d.isNotNull()),
        place,
        {
            "origin": F.lit("nested"),
            "deck_id": F.coalesce(
                F.when(course_row, first_text_of(d, "DeckId", "deckId")).otherwise(
                    first_text_of(d, "id", "Id", "deckId", "DeckId")
                ),
                F.lit(""),
            ),
            "deck_name": F.when(course_row, first_text_of(d, "Name", "name")).otherwise(
                first_text_of(d, "name", "Name", "deckName", "DeckName")
            ),
        },
        lambda r: known(r["deck_name"]),
    )
    direct = emit(
        typed.filter(x.isNotNull()).withColumn("ord", F.col("ord") + 0.5),
        place,
        {
            "origin": F.lit("direct"),
            "deck_id": F.coalesce(first_text_of(x, "deckId", "DeckId", "Id"), F.lit("")),
            "deck_name": first_text_of(x, "deckName", "DeckName", "Name"),
        },
        lambda r: known(r["deck_name"]),
    )
    at = F.struct("line_no", F.col("ord").cast("double").alias("ord"))
    names = nested.select("source_file", at.alias("at"))
    if other_names is not None:
        names = names.unionByName(
            other_names.filter(known(F.col("deck_name"))).select("source_file", at.alias("at"))
        )
    first_name = names.groupBy("source_file").agg(F.min("at").alias("__n"))
    first_direct = (
        direct.groupBy("source_file")
        .agg(F.min_by(F.struct("line_no", "ord", "origin", "deck_id", "deck_name"), at).alias("d"), F.min(at).alias("__at"))
        .join(first_name, "source_file", "left")
        .filter(F.col("__n").isNull() | (F.col("__at") < F.col("__n")))
        .select("source_file", "d.*")
    )
    return nested.withColumn("ord", F.col("ord").cast("double")).unionByName(
        first_direct.withColumn("ord", F.col("ord").cast("double"))
    )
