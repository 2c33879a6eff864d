"""Sessions, joins of two streams, and progress that is told at most so often."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType


def watermarked(rows: DataFrame, time: str, late: str) -> DataFrame:
    """A stream with a watermark; times without a zone are read in the session's, as watermarks need one."""
    return rows.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)


def sessions(events: DataFrame, key: str = "user_id", time: str = "ts", gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """``key``, ``start``, ``stop``, ``n``: runs of a key's events of which none comes more than ``gap`` after the one before; ``stop`` is ``gap`` after the last.

    Works on a table and, with a watermark, on a stream, where a session comes out once the watermark has passed it and its state goes. Events without a time are left out; null keys are a key.
    Sessions are merged before they are shuffled.
    """
    rows = watermarked(events, time, late) if events.isStreaming else events
    found = rows.where(F.col(time).isNotNull()).groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count("*").alias("n"))
    return found.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n")


def followed(first: DataFrame, then: DataFrame, key: str = "user_id", time: str = "ts", within: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Pairs of rows with the same ``key`` of which the second comes at the time of the first or up to ``within`` later: the columns of both, with ``first_`` and ``then_`` before their names.

    On streams both sides carry a watermark, so that rows which can't pair any more leave the state. Null keys and times pair with nothing. On a table a hot key's rows meet
    by time slices of ``within``, each with itself and the one before, so that a key is many groups.
    """
    named = lambda df, p: df.select(*[F.col(f"`{c}`").alias(f"{p}_{c}") for c in df.columns])
    if first.isStreaming or then.isStreaming:
        a, b = watermarked(named(first, "first"), f"first_{time}", late), watermarked(named(then, "then"), f"then_{time}", late)
        return a.join(b, F.expr(f"`first_{key}` = `then_{key}` AND `then_{time}` >= `first_{time}` AND `then_{time}` <= `first_{time}` + INTERVAL {within}"))
    seconds = lambda c: F.col(c).cast("timestamp").cast("double")
    width = first.sparkSession.sql(f"SELECT CAST(INTERVAL {within} AS INTERVAL SECOND)").first()[0].total_seconds()
    a = named(first, "first").withColumn("__s", F.floor(seconds(f"first_{time}") / width))
    b = named(then, "then").withColumn("__s", F.explode(F.array(F.floor(seconds(f"then_{time}") / width), F.floor(seconds(f"then_{time}") / width) - 1)))
    near = F.expr(f"`then_{time}` >= `first_{time}` AND `then_{time}` <= `first_{time}` + INTERVAL {within}")
    both = a.join(b.withColumnRenamed("__s", "__t"), (F.col(f"first_{key}") == F.col(f"then_{key}")) & (F.col("__s") == F.col("__t")) & near)
    return both.drop("__s", "__t")


PROGRESS = StructType([StructField("task", StringType()), StructField("at_ms", LongType()), StructField("message", StringType()), StructField("final", BooleanType())])


class _Throttle(StatefulProcessor):
    """Of a task: when something was last told, and when its state goes, on which a timer is set. A final message ends what was told."""

    def __init__(self, least_ms: int, keep_ms: int):
        self.least_ms, self.keep_ms = least_ms, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", StructType([StructField("told", LongType()), StructField("goes", LongType())]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        told, goes = tuple(self.state.get()) if self.state.exists() else (None, None)
        out, newest = [], 0
        for at, message, final in sorted((int(r.at_ms), r.message or "", bool(r.final)) for part in rows for r in part.itertuples()):
            newest = at
            if final or told is None or at - told >= self.least_ms:
                out.append((key[0], at, message, final))
                told = None if final else at
        if goes is not None:
            self.handle.deleteTimer(goes)
        goes = max(newest, timerValues.getCurrentWatermarkInMs()) + self.keep_ms
        self.state.update((told, goes))
        self.handle.registerTimer(goes)
        yield pd.DataFrame(out, columns=PROGRESS.names)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.state.clear()
        yield pd.DataFrame([], columns=PROGRESS.names)


def throttled_stream(progress: DataFrame, least_ms: int = 800, keep_ms: int = 3_600_000, late: str = "10 seconds") -> DataFrame:
    """The rule of ``throttled`` on a stream whose batches come in order of time, with a timestamp column ``at`` beside ``at_ms``.

    A task's state is two numbers. A timer drops it once the watermark is ``keep_ms`` past the task's last message; a message after that is told like a first one. Needs a state store that keeps
    several values for a key (RocksDB: ``spark.sql.streaming.stateStore.providerClass``).
    """
    kept = progress.where("task IS NOT NULL AND at_ms IS NOT NULL").withWatermark("at", late).select("task", "at_ms", "message", F.coalesce("final", F.lit(False)).alias("final"), "at")
    return kept.groupBy("task").transformWithStateInPandas(_Throttle(least_ms, keep_ms), PROGRESS, "append", "eventTime")


def throttled(progress: DataFrame, least_ms: int = 800) -> DataFrame:
    """Messages (``task``, ``at_ms``, ``message``, ``final``, in order of time by task) that are told: the first, each final one, and those at least ``least_ms`` after the one told before.

    The same rule on a table and in ``throttled_stream``. A task's messages are followed one by one, in order, where they lie sorted; no task's messages are held. Messages of the same
    time count in the order of their text; those without a task or time are left out.
    """
    kept = progress.where("task IS NOT NULL AND at_ms IS NOT NULL").select("task", "at_ms", "message", F.coalesce("final", F.lit(False)).alias("final"))
    dealt = kept.repartition("task").sortWithinPartitions("task", "at_ms", "message", "final")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, told = None, 0
        for part in parts:
            keep = []
            for t, at, final in zip(part["task"], part["at_ms"], part["final"], strict=True):
                tell = t != task or final or told is None or at - told >= least_ms
                keep.append(tell)
                if tell:
                    task, told = t, None if final else at
            yield part[keep]

    return dealt.mapInPandas(run, PROGRESS)
