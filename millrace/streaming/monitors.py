"""Streams: drift, latency, reminders at their levels, retries with back-off, ingest without repeats and daily statistics.

Keyed state lives in Spark's state store (``stateful`` chooses the one that keeps it on disk). A key's rows of a micro-batch are worked as arrays; what is kept is the last window,
or one row, and timers tell when the next reminder or retry is due, so a stream acts when nothing arrives, too. A stream that starts again from its checkpoint goes on as if it
had never stopped.

Rows of a key are taken in the order of (ts, event_id) within a micro-batch; earlier rows that come in a later one count as later. Null scores are not over a threshold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

DAY_MS = 86_400_000
#: Days before the due date at which a reminder is sent, by level; the day after it is overdue. Attempts in all, and seconds to wait after each failed one.
LEVELS = {"7d": 7, "3d": 3, "1d": 1, "overdue": -1}
ATTEMPTS, DELAYS = 3, (0, 30, 120)


def stateful(spark: SparkSession) -> None:
    """Keep the state of streams started from now on in RocksDB: on local disk and in the checkpoint, not on the heap. State with timers and lists needs it."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _keyed(rows: DataFrame, key: str, processor: StatefulProcessor, out: str, time: str = "None") -> DataFrame:
    stateful(rows.sparkSession)
    return rows.groupBy(key).transformWithStateInPandas(processor, T.StructType.fromDDL(out), "append", time)


def _in_order(rows: Iterator[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(list(rows)).sort_values(["ts", "event_id"])


def _sums(values: np.ndarray, window: int) -> np.ndarray:
    """Sliding sums; the first ones are shorter."""
    total = np.concatenate(([0.0], np.cumsum(values)))
    at = np.arange(1, len(values) + 1)
    return total[at] - total[np.maximum(at - window, 0)]


class Drift(StatefulProcessor):
    """The rate over the threshold among a key's last observations. State: their outcomes."""

    def __init__(self, window: int, least: int, factor: float, floor: float):
        self.window, self.least, self.factor, self.floor = window, least, factor, floor

    def init(self, handle) -> None:
        self.last = handle.getListState("last", "over boolean, eps double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new, kept = _in_order(rows), [tuple(x) for x in self.last.get()]
        over = np.array([k[0] for k in kept] + (new["score"] > new["tau"]).tolist(), dtype=float)
        eps = np.array([k[1] for k in kept] + new["eps"].tolist(), dtype=float)
        n = np.minimum(np.arange(1, len(over) + 1), self.window)
        rate = _sums(over, self.window) / n
        ref = pd.Series(eps).rolling(self.window, min_periods=1).max().to_numpy()
        drifting = (n >= self.least) & (rate > np.maximum(self.factor * ref, ref + self.floor))
        self.last.put([(bool(o), float(e)) for o, e in zip(over[-self.window :], eps[-self.window :], strict=True)])
        s = slice(len(kept), None)
        yield pd.DataFrame({"key": key[0], "event_id": new["event_id"].to_numpy(), "n": n[s].astype(np.int32), "rate": rate[s], "drifting": drifting[s]})

    def close(self) -> None:
        pass


def drift_stream(scores: DataFrame, window: int = 200, least: int = 30, factor: float = 3.0, floor: float = 0.05) -> DataFrame:
    """Per observation the rate over its threshold among the key's last ``window``; columns key, ts, event_id, score, tau, eps."""
    return _keyed(scores, "key", Drift(window, least, factor, floor), "key string, event_id long, n int, rate double, drifting boolean")


class Latency(StatefulProcessor):
    """Sliding mean of a key's times. State: the last ones and how many there were."""

    def __init__(self, window: int):
        self.window = window

    def init(self, handle) -> None:
        self.last = handle.getListState("last", "ms double")
        self.seen = handle.getValueState("seen", "n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new, kept = _in_order(rows), [x[0] for x in self.last.get()]
        seen = self.seen.get()[0] if self.seen.exists() else 0
        ms = np.array([*kept, *new["ms"]], dtype=float)
        mean = _sums(ms, self.window) / np.minimum(np.arange(1, len(ms) + 1), self.window)
        self.last.put([(float(x),) for x in ms[-self.window :]])
        self.seen.update((seen + len(new),))
        yield pd.DataFrame({"key": key[0], "event_id": new["event_id"].to_numpy(), "seen": seen + 1 + np.arange(len(new)), "mean_last": np.round(mean[len(kept) :], 1)})

    def close(self) -> None:
        pass


def latency_stream(rows: DataFrame, window: int = 20) -> DataFrame:
    """Sliding mean of a key's last ``window`` times (key, ts, event_id, ms)."""
    return _keyed(rows, "key", Latency(window), "key string, event_id long, seen long, mean_last double")


class Reminders(StatefulProcessor):
    """One reminder a level and item, at the start of the level's day, while the item is pending. State: the due day and the levels that are sent or past."""

    def init(self, handle) -> None:
        self.handle = handle
        self.item = handle.getValueState("item", "due long, pending boolean, level int")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last = pd.concat(list(rows)).sort_values("ts").iloc[-1]
        due, pending = last["due_date"], last["status"] == "pending"
        if due is None or pd.isna(due):
            return
        at = int(pd.Timestamp(due).timestamp()) * 1000
        known = self.item.get() if self.item.exists() else None
        sent = known[2] if known is not None and known[0] == at else -1
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.item.update((at, bool(pending), int(sent)))
        if pending:
            # Of the levels that the item has reached already only the latest counts; it fires with the next watermark.
            now = max(timerValues.getCurrentWatermarkInMs(), int(pd.Timestamp(last["ts"]).timestamp() * 1000))
            starts = [at - days * DAY_MS for days in LEVELS.values()]
            reached = [i for i, t in enumerate(starts) if t <= now]
            for i, t in enumerate(starts):
                if i > sent and (not reached or i >= reached[-1]):
                    self.handle.registerTimer(t)
        return
        yield

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        due, pending, sent = self.item.get()
        for i, (level, days) in enumerate(LEVELS.items()):
            if due - days * DAY_MS == expiredTimerInfo.getExpiryTimeInMs() and pending and i > sent:
                self.item.update((due, True, i))
                yield pd.DataFrame({"id": [key[0]], "level": [level], "day": [pd.Timestamp(due - days * DAY_MS, unit="ms").date()]})

    def close(self) -> None:
        pass


def reminder_stream(items: DataFrame, late: str = "0 seconds") -> DataFrame:
    """(id, level, day) of the reminders of items (id, due_date, status, ts): 7, 3 and 1 day before the due date and the day after it, as event time gets there. An item that
    comes when a level's day has passed gets the latest level it has reached; one whose due date moves starts anew; one that is no longer pending gets none."""
    return _keyed(items.withWatermark("ts", late), "id", Reminders(), "id long, level string, day date", "EventTime")


class Retries(StatefulProcessor):
    """Sends a failed message again after its back-off, until it succeeds or its attempts are used up. State: attempts made."""

    def init(self, handle) -> None:
        self.handle = handle
        self.made = handle.getValueState("made", "attempts int, open boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        made, open_ = self.made.get() if self.made.exists() else (0, True)
        for r in pd.concat(list(rows)).sort_values("ts").itertuples():
            if open_:
                made += 1
                open_ = not r.ok and made < ATTEMPTS
                if open_:
                    self.handle.registerTimer(int(pd.Timestamp(r.ts).timestamp() * 1000) + DELAYS[made] * 1000)
        self.made.update((int(made), bool(open_)))
        return
        yield

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        made, open_ = self.made.get()
        if open_:
            yield pd.DataFrame({"id": [key[0]], "attempt": [made + 1], "at": [pd.Timestamp(expiredTimerInfo.getExpiryTimeInMs(), unit="ms")]})

    def close(self) -> None:
        pass


def retry_stream(outcomes: DataFrame, late: str = "0 seconds") -> DataFrame:
    """(id, attempt, at) of the messages to send again, from the outcomes (id, ok, ts) of the attempts so far."""
    return _keyed(outcomes.withWatermark("ts", late), "id", Retries(), "id long, attempt int, at timestamp", "EventTime")


def once_per_level(fired: DataFrame) -> DataFrame:
    """Reminders, each (id, level) once over the life of the stream."""
    return fired.dropDuplicates(["id", "level"])


def new_files(files: DataFrame) -> DataFrame:
    """Files whose content the stream hasn't seen."""
    return files.withColumn("sha256", F.sha2(F.col("content").cast("binary"), 256)).dropDuplicates(["sha256"])


def daily_stats(results: DataFrame, late: str = "1 day") -> DataFrame:
    """Counts by day under a watermark: an extension, the batch form is the reference."""
    rows = results.withWatermark("created_at", late).groupBy(F.window("created_at", "1 day").alias("w"))
    return rows.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("verdict") == "NG").alias("ng_count")).select(F.to_date("w.start").alias("day"), "total", "ng_count")


def retry_delay(attempt: int) -> int | None:
    """Seconds before a failed message is sent again; None when attempts are used up."""
    return DELAYS[attempt] if 0 <= attempt < len(DELAYS) else None
