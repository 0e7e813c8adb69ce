"""Sessions of players on a stream: the rows of ``plans.sessions`` with a watermark for late events.

Events wait until the watermark has passed them and are then taken in order of (at, seq), so rows may
come out of order within the delay; rows behind the watermark are left out by Spark, which counts
them. The state of a player holds the waiting events, what the session knows, and the last name of
each deck. Event-time timers wake a player when an event is due, when a match has been silent for the
time-out, and when names have expired, also without new events.

Each call of the state is a message to the JVM and each cell a conversion, so the state of a player
is one list of JSON texts of at most ``HELD`` entries, read and written once when the player is woken;
events come as JSON and leave as such texts. A player's first timer of a batch takes all that is due.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from itertools import batched

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from cardloom.operators.fold import UNKNOWN_DECK
from cardloom.plans.sessions import COLUMNS, EVENTS, FIRST_STATE, TIMEOUT, micros

HELD = 1_000  # entries of a text
_FACTS = COLUMNS[3:]  # kind and its facts
_ADDED = (
    "in_match boolean, current_match string, current_deck_id string, current_deck_name string, own_team int, "
    "last_turn int, last_player_life int, last_opponent_life int"
)
_ADDED_NAMES = tuple(c.split()[0] for c in _ADDED.split(", "))
_ROW = f"us bigint, seq bigint, {', '.join(EVENTS.split(', ')[3:])}, {_ADDED}"
OUTPUT = "player_id string, rows string"
# parts of a state: the session (a list like _NEW), names by deck ([deck, name, time] each), waiting events
_STATE = "part string, entries string"
SESSION, NAMES, WAITING = "session", "names", "waiting"
# time of the last event, whether in a match, match, deck and its own name, the name chosen last, team, turn, life totals
_NEW = (None, False, None, None, None, None, None, *FIRST_STATE)


def _known(name: str | None) -> bool:
    return name not in (None, "", UNKNOWN_DECK)


class Sessions(StatefulProcessor):
    def __init__(self, timeout_us: int | None, name_us: int | None):
        self.timeout_us, self.name_us = timeout_us, name_us
        self.shape = Row("player_id", "rows")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getListState("state", _STATE)
        self.woken: set[str | None] = set()  # players taken up to the watermark of this batch

    def _wake_at(self, us: int) -> None:
        self.handle.registerTimer(-(-us // 1000))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        first = None
        for piece in batched(rows, HELD):
            _, _, times, events = zip(*piece, strict=True)
            self.state.appendValue((WAITING, f"[{','.join(events)}]"))
            first = min(times) if first is None else min(first, *times)
        self._wake_at(first)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        if key[0] in self.woken:
            return
        self.woken.add(key[0])
        upto = timerValues.getCurrentWatermarkInMs() * 1000
        held: dict[str, list] = {SESSION: [], NAMES: [], WAITING: []}
        for part, entries in self.state.get():
            held[part] += json.loads(entries)
        due = [event for event in held[WAITING] if event["us"] <= upto]
        rest = [event for event in held[WAITING] if event["us"] > upto]
        due.sort(key=lambda event: (event["us"], event.get("seq")))
        self.now = tuple(held[SESSION]) or _NEW
        self.names = {deck_id: (name, us) for deck_id, name, us in held[NAMES]}
        before, listed = self.now, dict(self.names)
        for piece in batched(self._taken(due, upto), HELD):
            yield self.shape(*key, json.dumps(piece))
        self._forget(upto)
        if due or self.now != before or self.names != listed:
            names = [(deck_id, *known) for deck_id, known in self.names.items()]
            parts = {SESSION: self.now, NAMES: names, WAITING: rest}
            self.state.put([(part, json.dumps(piece)) for part, all_of in parts.items() for piece in batched(all_of, HELD)])
        if due and rest:
            self._wake_at(min(event["us"] for event in rest))
        if self.now[1] and self.timeout_us is not None:
            self._wake_at(self.now[0] + self.timeout_us)
        if self.name_us is not None:
            for us in {known[1] for deck_id, known in self.names.items() if known != listed.get(deck_id)}:
                self._wake_at(us + self.name_us + 1)

    def _taken(self, due: Iterable[dict], upto: int) -> Iterator[dict]:
        for event in due:
            yield from self._silence(event["us"] - 1)
            yield self._take(event)
        yield from self._silence(upto)

    def _silence(self, upto: int) -> Iterator[dict]:
        """Close a match whose time-out ends at ``upto`` or before."""
        last, in_match, match_id = self.now[:3]
        if self.timeout_us is None or not in_match or last + self.timeout_us > upto:
            return
        yield self._take({"us": last + self.timeout_us, "seq": -1, "kind": TIMEOUT, "match_id": match_id})

    def _take(self, event: dict) -> dict:
        """The row of an event; the session goes on behind it."""
        us = event["us"]
        kind, match, own_team, deck, deck_name, *state = map(event.get, _FACTS)
        if kind == "summary" and deck and deck_name:
            self.names[deck] = (deck_name, us)
        if kind == "deck" and deck and not _known(deck_name) and deck in self.names:
            told, since = self.names[deck]
            if self.name_us is None or us - since <= self.name_us:
                deck_name = told
        last, in_match, match_id, deck_id, deck_of, name, team, turn, life, other = self.now
        added = (in_match, match_id, deck_id, name or deck_of or None, team, turn, life, other)
        out = event | {"deck_name": deck_name} | dict(zip(_ADDED_NAMES, added, strict=True))
        if kind == "match_start":
            in_match, match_id, team = match is not None, match, own_team
            turn, life, other = FIRST_STATE
        elif kind in ("match_end", TIMEOUT):
            in_match, match_id, deck_id, deck_of, team = False, None, None, None, None
        elif kind == "deck":
            deck_id, deck_of = deck, deck_name
        elif kind == "state":
            new_turn, new_life, new_other = state
            turn = new_turn if new_turn and new_turn > 0 else turn
            life = new_life if new_life is not None else life
            other = new_other if new_other is not None else other
        if kind not in ("match_start", "match_end", TIMEOUT, "summary") and _known(deck_name):
            name = deck_name
        # a silence is no event: the time-out counts from the last real one
        self.now = (last if kind == TIMEOUT else us, in_match, match_id, deck_id, deck_of, name, team, turn, life, other)
        return out

    def _forget(self, upto: int) -> None:
        """Drop names that no later deck may use."""
        if self.name_us is not None:
            self.names = {k: v for k, v in self.names.items() if v[1] + self.name_us >= upto}


def stream_sessions(
    events: DataFrame,
    delay: str = "10 minutes",
    timeout_seconds: int | None = None,
    name_seconds: int | None = None,
) -> DataFrame:
    """Stream of events (``plans.sessions.EVENTS``) -> the rows of ``plans.sessions.sessions``.

    ``delay``: how late an event may come. Rows are given once the watermark has passed them.
    """
    us = micros("at").alias("us")
    timed = events.withWatermark("at", delay).select(  # "at" stays: by it Spark leaves out late rows
        "player_id", "at", us, F.to_json(F.struct(us, *COLUMNS[2:])).alias("event")
    )
    scaled = [None if s is None else s * 1_000_000 for s in (timeout_seconds, name_seconds)]
    groups = timed.groupBy("player_id").transformWithState(
        statefulProcessor=Sessions(*scaled), outputStructType=OUTPUT, outputMode="Append", timeMode="EventTime"
    )
    rows = groups.select("player_id", F.inline(F.from_json("rows", f"array<struct<{_ROW}>>", {"mode": "FAILFAST"})))
    at = "timestamp_micros(us) AS at"
    return rows.selectExpr("player_id", at, *COLUMNS[2:], *_ADDED_NAMES)
