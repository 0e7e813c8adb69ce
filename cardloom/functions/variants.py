"""Expressions over VARIANT payloads of unknown shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardloom.functions.exprs import as_col, emit, parse_int

JSON_SUSPECT = r"\}\s*\]"


def strict_json(text: Column | str) -> Column:
    """Text that is one whole JSON value as VARIANT, else null.

    ``try_parse_json`` stops after the first value and accepts what follows it. Inside
    brackets anything that follows is an error; text that may close the bracket itself is
    parsed a second time inside braces.
    """
    t = as_col(text)
    return _single_value(t, F.try_parse_json(_boxed(t)))


def _boxed(t: Column) -> Column:
    return F.concat(F.lit("["), t, F.lit("]"))


def _single_value(t: Column, boxed: Column) -> Column:
    alone = F.try_variant_get(boxed, "$[1]", "variant").isNull()
    sound = ~t.rlike(JSON_SUSPECT) | F.try_parse_json(
        F.concat(F.lit('{"v":'), t, F.lit("}"))
    ).isNotNull()
    return F.when(alone & sound, F.try_variant_get(boxed, "$[0]", "variant"))


def emit_json(df: DataFrame, keep: list[str], t: Column, out: str = "payload") -> DataFrame:
    """``strict_json`` of a text as a new column, in steps that parse each text once."""
    texts = emit(df, keep, {"__t": t})
    boxed = emit(texts, [*keep, "__t"], {"__b": F.try_parse_json(_boxed(F.col("__t")))})
    return emit(boxed, keep, {out: _single_value(F.col("__t"), F.col("__b"))})


def sub(v: Column, path: str) -> Column:
    """Value at a path as VARIANT; JSON null counts as present."""
    return F.try_variant_get(v, path, "variant")


def has(v: Column, key: str) -> Column:
    # An object is told without copying it; only other values are read.
    return is_object(v, f"$.{key}") | sub(v, f"$.{key}").isNotNull()


def text(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "string")


def whole(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "bigint")


def items(v: Column, path: str) -> Column:
    """Array at a path; null when it is none."""
    return F.try_variant_get(v, path, "array<variant>")


def is_object(v: Column, path: str = "$") -> Column:
    # Reading one absent field tells an object from other values without copying it.
    return F.try_variant_get(v, path, "struct<_:boolean>").isNotNull()


def obj(v: Column, path: str) -> Column:
    """Object at a path; null when it is none.

    The argument is used twice, so pass a column, not a nested expression.
    """
    return F.when(is_object(v, path), sub(v, path))


def first_obj(v: Column, *keys: str) -> Column:
    return F.coalesce(*[obj(v, f"$.{k}") for k in keys])


def first_items(v: Column, *keys: str) -> Column:
    return F.coalesce(*[items(v, f"$.{k}") for k in keys])


def first_text_of(v: Column, *keys: str) -> Column:
    """First alias with a non-empty text."""
    return F.coalesce(*[F.nullif(text(v, f"$.{k}"), F.lit("")) for k in keys])


def first_whole_of(v: Column, *keys: str) -> Column:
    """First alias with a non-zero whole number."""
    return F.coalesce(*[F.nullif(whole(v, f"$.{k}"), F.lit(0)) for k in keys])


def number(v: Column, *keys: str) -> Column:
    """First alias that is a number, or a text with a leading integer; else 0."""

    def one(key: str) -> Column:
        path = f"$.{key}"
        kind = F.schema_of_variant(sub(v, path))
        return F.when(kind == "STRING", parse_int(text(v, path)).cast("double")).when(
            kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.try_variant_get(v, path, "double")
        )

    return F.coalesce(*[one(k) for k in keys], F.lit(0.0))
