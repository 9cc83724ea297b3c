"""Quota counters as streaming state that timers clear."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.quota import verdict_columns

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
COUNTED = "callId string, tier string, userId string, ts timestamp, dayCount bigint, minuteCount bigint"
_DAY, _MINUTE = 86_400_000, 60_000


class QuotaCounter(StatefulProcessor):
    """Per (tier, user): calls of each open day and minute, as one small value.

    Days and minutes that end ``late`` before the user's newest call go at once, since calls as late as that are not counted; timers at the ends of
    the newest minute and day clear what is left, also of users who never call again. So the state holds open minutes and days only.
    """

    def __init__(self, late_ms: int) -> None:
        self.late_ms = late_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "widths array<bigint>, starts array<bigint>, counts array<bigint>")

    def _held(self) -> dict[tuple[int, int], int]:
        held = self.open.get()
        return {} if held is None else {(int(w), int(s)): int(n) for w, s, n in zip(*held)}

    def _keep(self, held: dict[tuple[int, int], int], until: int) -> None:
        left = [(w, s, n) for (w, s), n in sorted(held.items()) if s + w > until]
        if left:
            self.open.update(tuple(list(x) for x in zip(*left)))
        else:
            self.open.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        parts = list(rows)
        calls = parts[0] if len(parts) == 1 else pd.concat(parts, ignore_index=True)
        late = timerValues.getCurrentWatermarkInMs()
        stamps = (calls["ts"].to_numpy("datetime64[us]").astype("int64") // 1000).tolist()
        ids, exact = calls["callId"].tolist(), calls["ts"].to_numpy("datetime64[us]").astype("int64").tolist()
        order = sorted((i for i, s in enumerate(stamps) if s >= late), key=lambda i: (exact[i], ids[i] is None, ids[i] or ""))
        if not order:
            return
        # plain counting: most users have few calls, for which a table's own steps cost far more than the calls
        held, newest = self._held(), stamps[order[-1]]
        counts: dict[int, list[int]] = {_DAY: [], _MINUTE: []}
        for width, column in counts.items():
            for i in order:
                at = (width, stamps[i] // width * width)
                held[at] = n = held.get(at, 0) + 1
                column.append(n)
            self.handle.registerTimer(newest // width * width + width)
        self._keep(held, newest - self.late_ms)
        yield calls[["callId", "tier", "userId", "ts"]].take(order).assign(dayCount=counts[_DAY], minuteCount=counts[_MINUTE])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._keep(self._held(), timerValues.getCurrentWatermarkInMs())
        return iter(())

    def close(self) -> None:
        pass


def counted_calls(calls: DataFrame, late: str) -> DataFrame:
    """Streaming calls (callId, tier, userId, ts) with their running day and minute counts (UTC days); later ones than the watermark are dropped."""
    late_ms = int(pd.Timedelta(late).total_seconds() * 1000)
    keyed = calls.select("callId", "tier", "userId", "ts").withWatermark("ts", late).groupBy("tier", "userId")
    return keyed.transformWithStateInPandas(QuotaCounter(late_ms), outputStructType=COUNTED, outputMode="Append", timeMode="EventTime")


def judged_calls(calls: DataFrame, late: str) -> DataFrame:
    counted = counted_calls(calls, late)
    return counted.withColumns(verdict_columns(F.col("dayCount"), F.col("minuteCount"), F.col("ts")))
