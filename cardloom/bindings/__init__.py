"""Operators bound to the driver's tables, each with its DuckDB counterpart."""

from cardloom.bindings import cards, decks, folds, ids, logs, stats, streams, tables, wide  # noqa: F401
from cardloom.bindings.registry import ORACLES, QUERIES  # noqa: F401
