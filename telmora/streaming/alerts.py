"""The alert state machine on a stream of rule evaluations."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from telmora.operators.alerts import HISTORY, RuleState, advance

_STATE = StructType(
    [
        StructField("state", StringType()),
        StructField("since_ms", LongType()),
        StructField("notified_ms", LongType()),
        StructField("last_value", DoubleType()),
        StructField("eval_ms", LongType()),
    ]
)
_HISTORY_NAMES = [c.split()[0] for c in HISTORY.split(", ")]


class AlertProcessor(StatefulProcessor):
    """Keeps one ``RuleState`` per rule; ticks of a micro-batch are applied in time order."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.stored = handle.getValueState("rule", _STATE)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        s = RuleState(*self.stored.get()) if self.stored.exists() else RuleState()
        ticks = pd.concat(rows).sort_values("t_ms")
        out = []
        for r in ticks.itertuples(index=False):
            step = advance(s, int(r.t_ms), bool(r.firing), float(r.value), bool(r.enabled), int(r.for_s), int(r.every_s))
            if step is None:
                continue
            s, notify = step
            out.append((key[0], int(r.t_ms), s.state, s.since_ms, s.notified_ms, s.last_value, float(r.value), notify))
        if s.state is not None:
            self.stored.update((s.state, s.since_ms, s.notified_ms, s.last_value, s.eval_ms))
        frame = pd.DataFrame(out, columns=_HISTORY_NAMES)
        yield frame.astype({"t_ms": "Int64", "since_ms": "Int64", "notified_ms": "Int64"})

    def close(self) -> None:
        pass


def state_stream(ticks: DataFrame) -> DataFrame:
    """``ticks``: streaming ``rule_id, t_ms, firing, value, enabled, for_s, every_s``. Needs the RocksDB
    state store provider."""
    return ticks.groupBy("rule_id").transformWithStateInPandas(
        statefulProcessor=AlertProcessor(),
        outputStructType=HISTORY,
        outputMode="Append",
        timeMode="None",
    )
