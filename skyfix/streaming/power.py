"""Power from an energy counter on a stream: keyed state that holds a run's open samples and its last counter."""

from __future__ import annotations

import contextlib
import datetime
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextlib.contextmanager
def keyed_state(spark: SparkSession):
    """While it lasts, streams that start keep their state in the store that keyed state needs."""
    old = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, old)


def _step(last: tuple | None, now: tuple, most: float) -> float | None:
    """Watts between two samples (microseconds, counter in micro-joules); null next to an unreadable one or without one before."""
    if last is None or last[1] is None or now[1] is None:
        return None
    step = now[1] - last[1]
    return (step + most if step < 0 else step) / 1e6 / max(now[0] / 1e6 - last[0] / 1e6, 1e-6)


class _Power(StatefulProcessor):
    """Samples wait until the watermark has passed them, so that those that come late, but not too late, take their place in order.
    The state of a run is what waits, and one sample."""

    def __init__(self, most: float):
        self.most = most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "us bigint, counter double, value double")
        self.last = handle.getValueState("last", "us bigint, counter double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for part in rows:
            us = part["us"].astype("int64")
            number = lambda c: [None if pd.isna(x) else float(x) for x in part[c]]  # noqa: B023, E731
            self.waiting.appendList(list(zip(us.tolist(), number("counter"), number("value"), strict=True)))
            if len(us):
                self.handle.registerTimer(-(-int(us.min()) // 1000))  # the first that waits; those behind it follow
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        held = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        ready = sorted((r for r in held if r[0] <= passed), key=lambda r: (r[0], r[1] is not None, r[1] or 0.0))
        if not ready:
            yield pd.DataFrame()
            return
        rest = [r for r in held if r[0] > passed]
        if rest:
            self.waiting.put(rest)
            self.handle.registerTimer(-(-min(r[0] for r in rest) // 1000))
        else:
            self.waiting.clear()
        last = tuple(self.last.get()) if self.last.exists() else None
        out = []
        for us, counter, value in ready:
            out.append((datetime.datetime.fromtimestamp(us / 1e6, datetime.UTC), value, _step(last, (us, counter), self.most)))
            last = (us, counter)
        self.last.update(last)
        frame = pd.DataFrame(out, columns=["ts", "value", "power_w"])
        frame["ts"] = pd.to_datetime([r[0] for r in ready], unit="us")
        frame.insert(0, "run", [key[0]] * len(out))
        yield frame

    def close(self) -> None:
        pass


def counter_power_stream(
    samples: DataFrame, run: str, counter: str, value: str, most: float, late: str = "10 minutes", ts: str = "ts",
) -> DataFrame:
    """(run, ts, value, power_w) of a stream of samples, each as the watermark passes it: power as evaluate.counter_power has it.
    A sample that is later than `late` is dropped. ts keeps its watermark, so windows may follow. Start it inside keyed_state."""
    rows = samples.withWatermark(ts, late).select(
        F.col(run).alias("run"), F.col(ts).alias("ts"), F.unix_micros(ts).alias("us"), F.col(counter).cast("double").alias("counter"), F.col(value).cast("double").alias("value"),
    )
    kind = samples.schema[run].dataType.simpleString()
    out = rows.groupBy("run").transformWithStateInPandas(
        _Power(most), f"run {kind}, ts timestamp, value double, power_w double", "Append", "EventTime", eventTimeColumnName="ts",
    )
    return out


def power_windows(powered: DataFrame, length: str = "1 hour", ts: str = "ts") -> DataFrame:
    """(window_start, window_end, peak, mean, peak_power_w, mean_power_w, n) of samples with power, a table or a stream."""
    return powered.groupBy(F.window(ts, length).alias("w")).agg(
        F.max("value").alias("peak"), F.avg("value").alias("mean"), F.max("power_w").alias("peak_power_w"), F.avg("power_w").alias("mean_power_w"), F.count("*").alias("n"),
    ).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "peak", "mean", "peak_power_w", "mean_power_w", "n")
