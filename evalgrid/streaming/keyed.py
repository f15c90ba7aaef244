"""Run a keyed step function over a stream, with a small value state per key.

A step is (state, row) -> list of output tuples. Batch twins do without: see operators.chain and
operators.skew.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import StructType

Start = Callable[[dict], dict]
Step = Callable[[dict, dict], list]


def _ddl(df: DataFrame, keys: Sequence[str]) -> str:
    return ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)


class StepProcessor(StatefulProcessor):
    """The same step on a stream: the key's state is one JSON value, rows are taken in event order
    within a micro-batch."""

    def __init__(self, keys: Sequence[str], order: Sequence[str], start: Start, step: Step, names: Sequence[str]):
        self.keys, self.order, self.start, self.step, self.names = list(keys), list(order), start, step, list(names)

    def init(self, handle) -> None:
        self.state = handle.getValueState("state", "json string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        d = pd.concat(list(rows)).sort_values(self.order)
        recs = d.astype(object).where(d.notna(), None).to_dict("records")
        st = json.loads(self.state.get()[0]) if self.state.exists() else self.start(recs[0])
        out = [(*key, *r) for rec in recs for r in self.step(st, rec)]
        self.state.update((json.dumps(st),))
        yield pd.DataFrame(out, columns=self.names)

    def close(self) -> None:
        pass


def run_stream(stream: DataFrame, keys: Sequence[str], order: Sequence[str], start: Start, step: Step, fields: str) -> DataFrame:
    schema = StructType.fromDDL(f"{_ddl(stream, keys)}, {fields}")
    p = StepProcessor(keys, order, start, step, schema.names)
    return stream.groupBy(*keys).transformWithStateInPandas(statefulProcessor=p, outputStructType=schema, outputMode="Append", timeMode="None")
