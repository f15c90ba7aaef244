"""Live-session operators as steps that are chained over one event-ordered stream.

A stage is (start, step): start makes the state from the first row that reaches the stage, step
turns (state, row) into the rows that go on, with columns added. `ordered` runs a chain of stages
per key. Rows may arrive in any order: a key's rows wait until the watermark has passed them and
are then taken by time and `order`, so micro-batches make no difference. Rows later than the
watermark are dropped. The state of a key is a few values per stage and the rows still waiting.

Every stage has its batch form in `live`.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import StructType

Stage = tuple[Callable[[dict], dict], Callable[[dict, dict], list]]


def refractory(t: str, gap: int) -> Stage:
    """Keeps a row that is at least `gap` after the last one kept."""

    def step(st: dict, row: dict) -> list:
        if st["until"] is not None and row[t] < st["until"]:
            return []
        st["until"] = row[t] + gap
        return [row]

    return lambda row: {"until": None}, step


def timed_pages(t: str, every: int, pages: int, pause: int) -> Stage:
    """Adds `page`, `locked` and `cancelled` under a timer that turns the page every `every`."""

    def step(st: dict, row: dict) -> list:
        since = row[t] - st["began"]
        turns, before = since // every, st["turns"]
        st["turns"] = turns
        return [{**row, "page": turns % pages, "locked": turns > 0 and since - turns * every < pause, "cancelled": before is not None and turns != before}]

    return lambda row: {"began": row[t], "turns": None}, step


def user_pages(zone: str, turn: int, per_page: int, items: int) -> Stage:
    """Adds `page`, `choice` and `item` where zone `turn` turns the page."""
    pages = max(1, -(-items // per_page))

    def step(st: dict, row: dict) -> list:
        z = row[zone]
        if z is None:
            return [{**row, "page": None, "choice": "blank", "item": None}]
        if z == turn:
            st["page"] = (st["page"] + 1) % pages
            return [{**row, "page": st["page"], "choice": "page", "item": None}]
        number = st["page"] * per_page + z - (z > turn)
        known = number < items
        return [{**row, "page": st["page"], "choice": "item" if known else "blank", "item": number if known else None}]

    return lambda row: {"page": 0}, step


def flag(name: str, test: Callable[[dict], bool]) -> Stage:
    """Adds a boolean column."""
    return lambda row: {}, lambda st, row: [{**row, name: bool(test(row))}]


def repeat_confirm(value: str, ended: str | None = None, counts: str | None = None) -> Stage:
    """Adds `verdict` of the same value twice in a row. A row whose `ended` holds first ends what
    was half chosen; a row whose `counts` does not hold goes no further."""

    def step(st: dict, row: dict) -> list:
        if ended is not None and row[ended]:
            st["open"] = False
        if counts is not None and not row[counts]:
            return []
        v = row[value]
        if st["open"] and v is not None and v == st["value"]:
            st["open"] = False
            return [{**row, "verdict": "select"}]
        verdict = "disagreed" if st["open"] else "first of two"
        st.update({"open": True, "value": v})
        return [{**row, "verdict": verdict}]

    return lambda row: {"open": False, "value": None}, step


def two_step(zone: str, yes: int = 0) -> Stage:
    """Adds `step` and `asked`: every second row answers for the zone of the row before."""

    def step(st: dict, row: dict) -> list:
        if not st["open"]:
            st.update({"open": True, "asked": row[zone]})
            return [{**row, "step": "ask", "asked": row[zone]}]
        st["open"] = False
        return [{**row, "step": "select" if row[zone] == yes else "cancel", "asked": st["asked"]}]

    return lambda row: {"open": False, "asked": None}, step


def advance(stages: Sequence[Stage], states: list, row: dict) -> list:
    """Sends one row through the chain; `states` (None where a stage has seen nothing) is updated."""
    rows = [row]
    for i, (start, step) in enumerate(stages):
        passed = []
        for r in rows:
            if states[i] is None:
                states[i] = start(r)
            passed += step(states[i], r)
        rows = passed
    return rows


class OrderedProcessor(StatefulProcessor):
    """Holds a key's rows until the watermark has passed them, then sends them on in order."""

    def __init__(self, keys: Sequence[str], order: Sequence[str], stages: Sequence[Stage], fields: Sequence[str]):
        self.keys, self.order, self.stages, self.fields = list(keys), list(order), list(stages), list(fields)

    def init(self, handle) -> None:
        self.handle = handle
        self.states = handle.getValueState("states", "json string")
        self.held = handle.getListState("held", "due bigint, at bigint, json string")
        self.timer = handle.getValueState("timer", "due bigint")
        self.sent = handle.getValueState("sent", "upto bigint")

    def _wake(self, due: int) -> None:
        """One timer per key, at its first waiting row."""
        if self.timer.exists():
            if self.timer.get()[0] <= due:
                return
            self.handle.deleteTimer(self.timer.get()[0])
        self.handle.registerTimer(due)
        self.timer.update((due,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        sent, first = self.sent.get()[0] if self.sent.exists() else -(1 << 62), None
        for d in rows:
            new = [(int(due), int(at), r) for due, at, r in zip(d["due__"], d["at__"], d["row__"]) if due > sent]
            if new:
                self.held.appendList(new)
                first = min([r[0] for r in new] + ([] if first is None else [first]))
        if first is not None:
            self._wake(first)
        yield pd.DataFrame([], columns=[*self.keys, *self.fields])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        waiting = [tuple(r) for r in self.held.get()]
        ready = [(at, json.loads(r)) for due, at, r in waiting if due <= passed]
        ready.sort(key=lambda x: (x[0], *[x[1][c] for c in self.order]))
        states = json.loads(self.states.get()[0]) if self.states.exists() else [None] * len(self.stages)
        out = [(*key, *[r.get(f) for f in self.fields]) for _, row in ready for r in advance(self.stages, states, row)]
        self.states.update((json.dumps(states),))
        self.sent.update((passed,))
        self.timer.clear()
        rest = [r for r in waiting if r[0] > passed]
        if rest:
            self.held.put(rest)
            self._wake(min(r[0] for r in rest))
        else:
            self.held.clear()
        yield pd.DataFrame(out, columns=[*self.keys, *self.fields])

    def close(self) -> None:
        pass


def ordered(stream: DataFrame, keys: Sequence[str], ts: str, order: Sequence[str], stages: Sequence[Stage], fields: str, delay: str | None = "10 minutes") -> DataFrame:
    """`fields` (DDL) of what comes out of the chain, per key. `ts` is the event time; `delay` is how
    late rows may come (None: `ts` carries a watermark already). Rows without a time are dropped;
    `order` tells rows of equal time apart and has no nulls. Stages see the columns as JSON values:
    numbers, texts and booleans."""
    if delay is not None:
        stream = stream.withWatermark(ts, delay)
    at = F.unix_micros(ts)
    kinds = ", ".join(f"{k} {stream.schema[k].dataType.simpleString()}" for k in keys)
    schema = StructType.fromDDL(f"{kinds}, {fields}")
    row = F.to_json(F.struct(*[c for c in stream.columns if c != ts]), {"ignoreNullFields": "false"})
    packed = stream.where(F.col(ts).isNotNull()).select(*keys, ts, F.ceil(at / 1000).alias("due__"), at.alias("at__"), row.alias("row__"))
    p = OrderedProcessor(keys, order, stages, schema.names[len(keys) :])
    return packed.groupBy(*keys).transformWithStateInPandas(statefulProcessor=p, outputStructType=schema, outputMode="Append", timeMode="EventTime")
