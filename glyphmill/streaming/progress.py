"""Download progress as a stream: files of JSON lines in; fractions, or the lines worth showing, out."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from glyphmill.operators.settings import progress_fraction
from glyphmill.plans.session import ship_package
from glyphmill.sources.readers import pull_events

#: Phases that are shown whenever they come. Fixed values.
AT_ONCE = ("resolve", "done", "error")
#: The phase of the line that tells of a feed that fell silent.
STALLED = "stalled"
LINE = "backend string, model string, at timestamp, phase string, completed long, total long, message string"
_OUT = f"{LINE}, ms long"


def progress(spark: SparkSession, folder: str, *, files_a_batch: int = 1000) -> DataFrame:
    """status, completed, total, fraction of every sound line of the folder's files, as they come. No state, so no watermark."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_a_batch).text(folder)
    return pull_events(lines, "value").withColumn("fraction", progress_fraction(F.col("completed"), F.col("total")))


def write_progress(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends what is there now to a Parquet table and ends; the checkpoint keeps each file from counting twice."""
    return rows.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)


def throttle(every_ms: int, idle_ms: int) -> StatefulProcessor:
    """The processor of ``shown_lines``. Its class is made here so that it travels whole: where a query with state is planned, shipped packages aren't at hand."""

    class Throttle(StatefulProcessor):
        """Of a feed's rows those worth a line: state is when the last line was, and the last line of each phase that is shown at once."""

        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.state = handle.getValueState("lines", "shown long, resolve long, done long, error long, seen long, phase string, completed long, total long")

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            batch = pd.concat(list(rows)).sort_values(["at", "phase", "completed", "total", "message"], kind="stable", na_position="first")
            never = -(1 << 62)
            shown, resolve, done, error, seen, phase, completed, total = self.state.get() if self.state.exists() else (never, never, never, never, never, None, 0, 0)
            last = dict(zip(AT_ONCE, (resolve, done, error), strict=True))
            keep = []
            for at, name, have, of in zip(batch["ms"].tolist(), batch["phase"], batch["completed"], batch["total"], strict=True):
                show = at > last[name] if name in last else at - shown > every_ms
                if show:
                    shown = max(shown, at)
                    if name in last:
                        last[name] = at
                if at >= seen:
                    seen, phase, completed, total = at, name, int(have), int(of)
                keep.append(show)
            self.state.update((shown, *last.values(), seen, phase, completed, total))
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(max(seen, timerValues.getCurrentWatermarkInMs()) + idle_ms)
            yield batch[keep][[f.split(" ")[0] for f in _OUT.split(", ")]]

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            _, _, _, _, seen, phase, completed, total = self.state.get()
            self.state.clear()
            if phase in ("done", "error"):
                return
            none = pd.Series([None], dtype="datetime64[us]")
            yield pd.DataFrame({"backend": [key[0]], "model": [key[1]], "at": none, "phase": [STALLED], "completed": [completed], "total": [total], "message": [phase], "ms": [seen + idle_ms]})

        def close(self) -> None:
            pass

    return Throttle()


def shown_lines(rows: DataFrame, *, every_ms: int = 1000, idle_ms: int = 600_000, late: str = "1 minute") -> DataFrame:
    """The rows of a stream of backend, model, at, phase, completed, total, message that are worth a line, with their fraction.

    Rows are taken by time in each micro-batch (ties by phase, numbers and message). Within a feed, which is a backend and model, a row is
    shown if over ``every_ms`` have passed since the last line; resolve, done and error always are. Rows that come
    over ``late`` after later ones are left out; a row of those three phases no later than the last one of its phase (a repeat, or a feed sent
    again) is left out too, while a later resolve starts a feed anew. A feed that is silent for ``idle_ms`` is
    forgotten; unless it had ended, one line of the phase stalled tells so, with its last phase as the message. Rows without a time are
    left out; a null backend or model is a feed of its own, and null numbers are 0. State is one row a feed; a task holds a feed's rows of one micro-batch.
    """
    ship_package(rows.sparkSession)
    zero = lambda n: F.coalesce(F.col(n), F.lit(0)).cast("long").alias(n)
    whole = rows.where("at is not null").select("backend", "model", "at", F.coalesce("phase", F.lit("")).alias("phase"), zero("completed"), zero("total"), "message", F.unix_millis("at").alias("ms"))
    lines = whole.withWatermark("at", late).groupBy("backend", "model").transformWithStateInPandas(throttle(every_ms, idle_ms), _OUT, "Append", "EventTime")
    return lines.withColumn("at", F.coalesce("at", F.timestamp_millis("ms"))).drop("ms").withColumn("fraction", progress_fraction(F.col("completed"), F.col("total")))


#: Where state lives: timers need a store that keeps them in order.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def write_lines(lines: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends the lines of what is there now to a Parquet table and ends; feeds go on from the checkpoint."""
    lines.sparkSession.conf.set(*STORE)
    return write_progress(lines, path, checkpoint)
