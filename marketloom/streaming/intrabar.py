"""The trigger within bars on a stream of closes and trades, its state kept by ``transformWithStateInPandas``."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import asdict
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.intrabar import LOOKS, Rules, Trigger, looks


class TriggerProcessor(StatefulProcessor):
    def __init__(self, rules: dict):
        self.rules = rules

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getValueState("trigger", "trigger string")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        rules = Rules(**self.rules)
        trigger = Trigger.load(key[0], rules, self.kept.get()[0]) if self.kept.exists() else Trigger(key[0], rules)
        found = list(looks(trigger, pd.concat(list(rows), ignore_index=True)))
        self.kept.update((trigger.dump(),))
        yield pd.DataFrame(found, columns=[c.split()[0] for c in LOOKS.split(", ")])

    def close(self) -> None:
        pass


def look_stream(rows: DataFrame, rules: Rules | None = None) -> DataFrame:
    """Evaluations as closes and trades (``operators.intrabar.asked``) arrive, each symbol's in order. Needs the RocksDB state store."""
    return rows.groupBy("symbol").transformWithStateInPandas(TriggerProcessor(asdict(rules or Rules())), LOOKS, "Append", "None")
