"""Objects inside large JSON documents, read by many tasks.

A document is scanned as text that is cut at every closing brace, which Spark splits like lines. Whether
a piece begins inside a string follows from the quotes before it, and its depth from the braces
outside strings before it: two running sums over the pieces of a file, in chunks where a file has
many. The chunks are cut once for all passes, and the measured pieces are staged (``plans.staging``). An object of the wanted depth then reaches from the piece that opens it to the one that
closes it, and only those pieces are put together; where the name of an object holds a brace, the
pieces of the name go along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cardloom.operators.ordered import HOT_ROWS, running_last, running_sum, split_hot
from cardloom.plans.staging import stage

_CUT = "}"
_STRING = r'"(?:[^"\\]|\\.)*"'
_FILE, _AT = "__file", "__at"


def _quotes(text: Column) -> Column:
    """Number of quotes, without escaped ones."""
    return F.length(text) - F.length(F.replace(text, F.lit('"'), F.lit("")))


def json_elements(
    spark: SparkSession, path: str, depth: int = 1, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """(``file``, ``input_pos``, ``key``, ``text``) of every object that ``depth`` braces enclose, its own included.

    ``input_pos`` grows through a file. ``key`` is the name the object has in its parent, null in an array. In a file
    the objects may stand in one or several documents; what is no object is passed over.
    """
    from cardloom.sources.scan import file_position

    scanned = spark.read.option("lineSep", _CUT).text(path)
    pieces = scanned.select(F.col("_metadata.file_path").alias(_FILE), file_position().alias(_AT), F.col("value").alias("text"))
    cut = split_hot(pieces, [_FILE], [_AT], hot_rows, sized_by=pieces)
    # an escape never goes over a cut, as a closing brace cannot be escaped
    bare = F.regexp_replace("text", r"(?s)\\.", "")
    plain = cut.df.withColumn("__bare", bare).withColumn("__odd", _quotes(F.col("__bare")) % 2)
    quoted = running_sum(plain, [_FILE], [_AT], {"__sum": F.col("__odd")}, cut=cut)
    inside = (F.col("__sum") - F.col("__odd")) % 2 == 1
    ends_inside = F.col("__sum") % 2 == 1
    whole = F.when(inside, F.concat(F.lit('"'), F.col("__bare"))).otherwise(F.col("__bare"))
    outside = F.regexp_replace(F.regexp_replace(whole, r'"[^"]*"', ""), r'"[^"]*$', "")
    opens = F.length(outside) - F.length(F.replace(outside, F.lit("{"), F.lit("")))
    chunk = ["__hot", "__chunk"]
    told = quoted.select(
        _FILE,
        _AT,
        "text",
        *chunk,
        opens.alias("__opens"),
        F.when(ends_inside, 0).otherwise(1).alias("__closes"),
        F.when(~inside, F.col(_AT)).alias("__clear"),  # begins outside strings
    )
    measured = stage(told, "json-pieces")
    delta = F.col("__opens") - F.col("__closes")
    deep = running_sum(measured, [_FILE], [_AT], {"__depth": delta}, cut=cut)
    linked = running_last(deep, [_FILE], [_AT], {"__link": F.col("__clear")}, cut=cut)
    before = F.col("__depth") - delta
    begins = (before < depth) & (before + F.col("__opens") >= depth)
    placed = linked.select(
        _FILE, _AT, "text", *chunk, "__link", before.alias("__before"), begins.alias("__begins"),
        (F.col("__closes") == 0).alias("__cut_string"),
    )
    inner = F.col("__before") >= depth
    held = placed.filter(F.col("__begins") | inner | F.col("__cut_string"))
    started = running_last(held, [_FILE], [_AT], {"__start": F.when(F.col("__begins"), F.col("__link"))}, cut=cut)
    own = F.when(F.col("__begins") | inner, F.col("__start")).otherwise(F.col("__link"))
    parts = F.sort_array(F.collect_list(F.struct(_AT, "text", "__before")))
    joined = started.groupBy(_FILE, own.alias("input_pos")).agg(parts.alias("__parts"), F.bool_or("__begins").alias("__object"))
    text = F.concat(F.array_join(F.transform("__parts", lambda p: p["text"]), _CUT), F.lit(_CUT))
    # braces up to the one that opens the object
    need = F.lit(depth) - F.col("__parts")[0]["__before"]
    rows = joined.filter("__object").select(_FILE, "input_pos", need.alias("__need"), text.alias("text"))
    head = F.lit("")
    for n in range(1, depth + 1):
        upto = rf"(?s)^((?:[^\"{{]|{_STRING})*\{{){{{n}}}"
        head = F.when(F.col("__need") == n, F.regexp_extract("text", upto, 0)).otherwise(head)
    cut = rows.withColumn("__head", head)
    name = F.regexp_extract("__head", rf"(?s)({_STRING})\s*:\s*\{{$", 1)
    key = F.when(name != "", F.from_json(F.concat(F.lit("["), name, F.lit("]")), "array<string>")[0])
    body = F.expr("substr(text, length(__head))")
    return cut.select(F.col(_FILE).alias("file"), "input_pos", key.alias("key"), body.alias("text"))
