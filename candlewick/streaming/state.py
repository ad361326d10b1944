"""Per-series stream state: how many bars, how much volume, and the last bars."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from candlewick.operators.indicators import PSAR_ROWS
from candlewick.sources.bars import BAR_SCHEMA

_PRICES = ("high", "low", "close")
_RECENT = tuple(f"recent_{c}" for c in _PRICES)
_SERIES_FIELDS = [
    T.StructField("n", T.LongType()),
    T.StructField("obv", T.DoubleType()),
    *[T.StructField(c, T.ArrayType(T.DoubleType())) for c in _RECENT],
]
# State of a series; and a bar with the state of its series just after it.
STATE_SCHEMA = T.StructType(_SERIES_FIELDS)
ROW_SCHEMA = T.StructType(
    [*BAR_SCHEMA.fields, T.StructField("volume", T.DoubleType()), *_SERIES_FIELDS]
)


def tail_column() -> Column:
    """The recent prices as one array of bars."""
    return F.arrays_zip(*_RECENT).cast("array<struct<high:double,low:double,close:double>>")


class RecentBars(StatefulProcessor):
    """Emits every bar with the count, volume and last ten bars up to it.

    The state is a few numbers and nine bars per series, however long the stream.
    Bars of a series that arrive in one micro-batch are taken in date order, undated ones
    last.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._state = handle.getValueState("recent", STATE_SCHEMA)

    def handleInputRows(
        self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any
    ) -> Iterator[pd.DataFrame]:
        n, obv, *past = self._state.get() or (0, 0.0, [], [], [])
        parts = list(rows)
        bars = parts[0] if len(parts) == 1 else pd.concat(parts)
        dates = bars["trade_date"].fillna("").to_numpy(object)
        # Undated rows sort first, and go behind the others. Most series have few rows a
        # batch, so plain arrays cost a fraction of what frames do.
        undated = int((dates == "").sum())
        order = np.argsort(dates, kind="stable")
        order = np.concatenate([order[undated:], order[:undated]])
        bars = {c: bars[c].to_numpy()[order] for c in bars.columns}
        size = len(order)
        added: dict[str, Any] = {
            "ts_code": np.full(size, key[0], object),
            "n": np.arange(n + 1, n + size + 1),
            "obv": obv + bars["counted"].cumsum(),
        }
        kept = []
        for name, price, before in zip(_RECENT, _PRICES, past):
            known = np.concatenate([np.array(before, dtype=float), bars[price].astype(float)])
            # Windows are views of one array; only the first bars of a series have fewer rows.
            short = max(0, min(PSAR_ROWS - 1, len(known)) - len(before))
            views = sliding_window_view(known, PSAR_ROWS) if len(known) >= PSAR_ROWS else known[:0]
            first = len(known) - size - PSAR_ROWS + 1
            added[name] = [known[: len(before) + i + 1] for i in range(short)]
            added[name] += list(views[max(0, first) :])
            kept.append(known[-(PSAR_ROWS - 1) :].tolist())
        self._state.update((n + size, float(added["obv"][-1]), *kept))
        out = bars | added
        yield pd.DataFrame({c: out[c] for c in ROW_SCHEMA.fieldNames()})

    def handleInitialState(self, key: Any, initialState: pd.DataFrame, timerValues: Any) -> None:
        row = initialState.iloc[0]
        recent = (list(row[name]) for name in _RECENT)
        self._state.update((int(row["n"]), float(row["obv"]), *recent))

    def close(self) -> None:
        pass
