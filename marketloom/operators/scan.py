"""Recursions of the form ``s = keep * s + add`` over a key's whole history, cut into parts.

Two such steps make one of the same form, so a part of a key is two numbers: what it keeps of the state that it starts with, and what it
adds. Parts are summed up each in its own task, one pass over a key's parts (not rows) carries the state, and each part then
runs from its own start. No task holds more than a part of a key.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DAY_MS = 86_400_000


def affine_scan(rows: DataFrame, key: str, order: list[str], keep: Column, add: Column, name: str, start: float | Column = 0.0, part: int = DAY_MS) -> DataFrame:
    """``rows`` with ``name``: the state after each row of ``key`` in ``order``, whose first column is a number that is cut into parts of ``part``.

    ``start`` is the state before the first row: a number, or a column of which the first row's value counts.
    """
    names = [*rows.columns, name]
    fixed = None if isinstance(start, Column) else float(start)
    slim = rows.withColumns({"_part": F.floor(F.col(order[0]) / part).cast("long"), "_keep": keep.cast("double"), "_add": add.cast("double"), "_start": (F.lit(fixed) if fixed is not None else start).cast("double")})

    def sum_up(x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values(order)
        after = np.append(np.cumprod(x["_keep"].to_numpy()[::-1])[::-1][1:], 1.0)  # what later rows keep of each row's addition
        return pd.DataFrame({key: x[key].iloc[:1], "_part": x["_part"].iloc[:1], "keeps": [x["_keep"].prod()], "adds": [float((x["_add"].to_numpy() * after).sum())], "first": x["_start"].iloc[:1].to_numpy()})

    def carry(x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values("_part")
        state, starts = float(x["first"].iloc[0]), []
        for keeps, adds in zip(x["keeps"], x["adds"], strict=True):
            starts.append(state)
            state = keeps * state + adds
        return pd.DataFrame({key: x[key], "_part": x["_part"], "_from": starts})

    def run(x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values(order)
        state, out = float(x["_from"].iloc[0]), []
        for k, a in zip(x["_keep"], x["_add"], strict=True):
            state = k * state + a
            out.append(state)
        return x.assign(**{name: out})[names]

    kind = rows.schema[key].dataType.simpleString()
    parts = slim.select(key, "_part", "_keep", "_add", "_start", *[c for c in order if c != key]).groupBy(key, "_part").applyInPandas(sum_up, f"{key} {kind}, _part long, keeps double, adds double, first double")
    starts = parts.groupBy(key).applyInPandas(carry, f"{key} {kind}, _part long, _from double")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return slim.join(starts, [key, "_part"]).groupBy(key, "_part").applyInPandas(run, f"{schema}, `{name}` double")


def sample_ema(rows: DataFrame, key: str, order: list[str], value: str, alpha: float, name: str, part: int = DAY_MS) -> DataFrame:
    """Mean that gives each sample the weight ``alpha``, begun with the first one."""
    return affine_scan(rows, key, order, F.lit(1.0 - alpha), F.col(value) * alpha, name, F.col(value), part)


def decayed_sum(rows: DataFrame, key: str, order: list[str], value: str, since: Column, half_life: float, name: str, part: int = DAY_MS) -> DataFrame:
    """Sum that halves every ``half_life``; ``since`` is the time since the row before (null for the first)."""
    kept = F.pow(F.lit(0.5), F.coalesce(since, F.lit(0.0)) / half_life)
    return affine_scan(rows, key, order, kept, F.col(value), name, 0.0, part)
