"""The phase machine on a stream of bars: its state is one string a symbol, kept by ``transformWithStateInPandas``."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import asdict
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.phases import SIGNAL, Phases, Rules, found, inputs, steps


class PhaseProcessor(StatefulProcessor):
    def __init__(self, rules: dict):
        self.rules = rules

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getValueState("machine", "machine string")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        rules = Rules(**self.rules)
        machine = Phases.load(key[0], rules, self.kept.get()[0]) if self.kept.exists() else Phases(key[0], rules)
        # a trigger's rows of a symbol may come in several frames, which only together are in order
        signals = list(steps(machine, pd.concat(list(rows), ignore_index=True)))
        self.kept.update((machine.dump(),))
        yield found(signals)

    def close(self) -> None:
        pass


def phase_stream(bars: DataFrame, rules: Rules | None = None) -> DataFrame:
    """Turns as their bars arrive, each symbol's in order. Needs the RocksDB state store."""
    return inputs(bars).groupBy("symbol").transformWithStateInPandas(PhaseProcessor(asdict(rules or Rules())), SIGNAL, "Append", "None")
