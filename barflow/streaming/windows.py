"""Windows over rows on streams: a ring of the last bars a key, indicators brought up to date bar by bar.

``transformWithState`` keeps, for each series, the last values that the longest window
needs, the running EMAs and the last stamp; a bar costs its windows and nothing that grows
with the series.  A bar that is not later than the last one of its series is late: it changes
nothing and is told with ``late`` set.  State lives in the RocksDB store, whose provider
must be set (``needs_rocksdb``), and comes back from the checkpoint after a restart.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def needs_rocksdb(spark: SparkSession) -> None:
    """Set the state store that ``row_windows`` and ``trades`` need."""
    spark.conf.set(PROVIDER, ROCKSDB)


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """That store for streams started inside; the session's own setting comes back."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


def window_values(kind: str, ring: np.ndarray, n: int) -> float | None:
    """An indicator of the last n values of a ring; None during warm-up."""
    if len(ring) < n:
        return None
    x = ring[-n:]
    if kind == "sma":
        return float(x.mean())
    if kind == "std":
        return float(x.std())
    if kind == "max":
        return float(x.max())
    if kind == "min":
        return float(x.min())
    if kind == "mom":
        return float(x[-1] - x[0])
    raise ValueError(f"unknown window {kind!r}")


class Windows(StatefulProcessor):
    """wanted: out -> (kind, n); kinds: sma, std, max, min, mom (over n + 1 values), ema (seeded with the mean of its first n values)."""

    def __init__(self, wanted: dict[str, tuple[str, int]], key: str, time: str, value: str) -> None:
        self.wanted, self.key, self.time, self.value = wanted, key, time, value
        self.emas = [out for out, (kind, _) in wanted.items() if kind == "ema"]
        self.longest = max([n + (kind == "mom") for kind, n in wanted.values()])

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("series", "ring array<double>, emas array<double>, seen bigint, last timestamp")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        kept = self.state.get() if self.state.exists() else None
        ring, emas, seen, last = (np.array(kept[0], float), [*kept[1]], kept[2], pd.Timestamp(kept[3])) if kept else (np.zeros(0), [math.nan] * len(self.emas), 0, None)
        out = []
        for r in pd.concat(list(rows)).sort_values(self.time, kind="stable")[[self.time, self.value]].itertuples(index=False):
            t, x = pd.Timestamp(r[0]), float(r[1])
            if last is not None and t <= last:
                out.append((key[0], t, x, *[None] * len(self.wanted), True))
                continue
            ring, seen, last = np.append(ring, x)[-self.longest :], seen + 1, t
            for k, name in enumerate(self.emas):
                n = self.wanted[name][1]
                emas[k] = ring[-n:].mean() if seen == n else emas[k] + 2 / (n + 1) * (x - emas[k])
            now = {name: v if seen >= self.wanted[name][1] else None for name, v in zip(self.emas, emas, strict=True)}
            out.append((key[0], t, x, *[now[name] if kind == "ema" else window_values(kind, ring, n + (kind == "mom")) for name, (kind, n) in self.wanted.items()], False))
        self.state.update(([float(v) for v in ring], [float(v) for v in emas], seen, last.to_pydatetime()))
        yield pd.DataFrame(out, columns=[self.key, self.time, self.value, *self.wanted, "late"]).astype(dict.fromkeys(self.wanted, "float64"))

    def close(self) -> None:
        pass


def row_windows(bars: DataFrame, wanted: dict[str, tuple[str, int]], key: str = "symbol", time: str = "datetime", value: str = "close") -> DataFrame:
    """(key, time, value, wanted columns, late) of a stream of bars."""
    schema = f"{key} {dict(bars.dtypes)[key]}, {time} {dict(bars.dtypes)[time]}, {value} double, " + ", ".join(f"{c} double" for c in wanted) + ", late boolean"
    return bars.select(key, time, value).groupBy(key).transformWithStateInPandas(Windows(wanted, key, time, value), schema, "Append", "None")
