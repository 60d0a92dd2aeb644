"""Walks over peaks of a stream: the same picks as in batch, given out as soon as the watermark says that nothing can change them.

Peaks of a key wait in its state until the watermark has passed them and are then walked in the order of their times, whatever order they came in; a timer tells
when the last pick is settled. The state is what waits and the walk's few numbers, so it doesn't grow with the stream. Peaks behind the watermark are dropped.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tactus.operators.walks import CollapseWalk, TempoWalk

#: The state store that walks need.
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


class _Walked(StatefulProcessor):
    def __init__(self, keys: list[str], make: Callable, take: Callable, names: list[str]):
        self.keys, self.make, self.take, self.names = keys, make, take, names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "t double, v double, p double")
        self.walk = handle.getValueState("walk", "state string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  Spark's names
        for df in rows:
            new = [tuple(float(x) for x in r) for r in df[["t", "v", "p"]].itertuples(index=False)]
            if new:
                self.waiting.appendList(new)
                self._remind(max(r[0] for r in new))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = timerValues.getCurrentWatermarkInMs() / 1000
        walk = self.make()
        if self.walk.exists():
            walk.state = json.loads(self.walk.get()[0])
        rows = sorted(tuple(r) for r in self.waiting.get()) if self.waiting.exists() else []
        out = []
        for r in rows:
            if r[0] <= now:
                out += self.take(walk, r)
        out += walk.close(now)
        left = [r for r in rows if r[0] > now]
        self.waiting.put(left) if left else self.waiting.clear()
        self.walk.update((json.dumps(walk.state),))
        if walk.due() is not None:
            self._remind(walk.due())
        if out:
            own = dict(zip(self.keys, key, strict=True))
            yield pd.DataFrame([{**own, **dict(zip(self.names, x if isinstance(x, tuple) else (x,), strict=True))} for x in out])

    def _remind(self, t: float) -> None:
        self.handle.registerTimer(int(t * 1000) + 1)

    def close(self) -> None:
        pass


def _walked(peaks: DataFrame, keys: list[str], ts: str, value: str, period: str | None, late: str, make: Callable, take: Callable, names: list[str]) -> DataFrame:
    kinds = {f.name: f.dataType.simpleString() for f in peaks.schema.fields}
    seconds = F.unix_micros(F.col(ts)) / 1e6
    rows = peaks.withWatermark(ts, late).select(*keys, F.col(ts), seconds.alias("t"), F.col(value).cast("double").alias("v"), (F.col(period) if period else F.lit(0.0)).cast("double").alias("p")).where("t is not null and v is not null")
    schema = ", ".join([*[f"{k} {kinds[k]}" for k in keys], *[f"{n} double" for n in names]])
    return rows.groupBy(*keys).transformWithStateInPandas(_Walked(keys, make, take, names), schema, "Append", "EventTime")


def collapse_gaps_stream(peaks: DataFrame, keys: list[str], ts: str, value: str, gap: float, late: str = "1 hour") -> DataFrame:
    """keys, t (seconds), value of the peaks that operators.scans.collapse_gaps keeps, from a stream of peaks at time stamps `ts`; gap in seconds."""
    return _walked(peaks, keys, ts, value, None, late, lambda: CollapseWalk(gap), lambda w, r: w.peak(r[0], r[1]), ["t", "value"])


def follow_tempo_stream(peaks: DataFrame, keys: list[str], ts: str, value: str, period: str, late: str = "1 hour", share: float = 0.35, least: float = 0.02) -> DataFrame:
    """keys, t (seconds) of the peaks that operators.scans.follow_tempo picks, from a stream; the period of a key's first peak holds."""
    return _walked(peaks, keys, ts, value, period, late, lambda: TempoWalk(share, least), lambda w, r: w.peak(*r), ["t"])
