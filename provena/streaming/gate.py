"""The attempt gate on a stream: the state of each task as attempts come in, in whatever order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The state store that timers and map states need.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def failures(attempts: DataFrame, time: str, key: str, ok: str, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Attempts and failures by task and window; what comes later than `late` is left out."""
    return attempts.withWatermark(time, late).groupBy(F.window(time, window).alias("window"), key).agg(F.count("*").alias("attempts"), F.count_if(~F.col(ok)).alias("failures"))


def gated(attempts: DataFrame, time: str, key: str, ok: str, retries: int = 2, late: str = "1 hour"):
    """(key, status, tries) each time a task's status changes: ok at its first clean attempt, escalated after retries + 1 without one."""
    import pandas as pd

    def step(keys, frames, state):
        status, tries = state.get if state.exists else ("open", 0)
        before = status
        for pdf in frames:
            for good in pdf.sort_values("_time")["_ok"]:
                if status == "open":
                    tries += 1
                    status = "ok" if good else "escalated" if tries > retries else "open"
        state.update((status, tries))
        if status != before:
            yield pd.DataFrame({"task": [str(keys[0])], "status": [status], "tries": [tries]})

    rows = attempts.withWatermark(time, late).select(F.col(key).cast("string").alias("_key"), F.col(time).alias("_time"), F.col(ok).alias("_ok"))
    return rows.groupBy("_key").applyInPandasWithState(step, "task string, status string, tries long", "status string, tries long", "append", "NoTimeout")


def _processor(retries: int, keep_ms: int):
    import pandas as pd
    from pyspark.sql.streaming.stateful_processor import StatefulProcessor

    class Gate(StatefulProcessor):
        """Attempts wait until the watermark passes them, so they count in order of their own time and each once.

        A timer stands at each attempt that waits. The last one, keep_ms after a task's latest attempt, ends
        what is kept of it.
        """

        def init(self, handle) -> None:
            self.handle = handle
            self.waiting = handle.getMapState("waiting", "at long", "ok boolean")
            self.state = handle.getValueState("state", "status string, tries long, until long")

        def handleInputRows(self, key, rows, timerValues):
            held = self.state.get()
            status, tries, until = held if held is not None else ("open", 0, 0)
            for pdf in rows:
                for at, good in zip(pdf["at"], pdf["good"], strict=True):
                    at = int(at)
                    # Of attempts at one time a clean one counts; a replayed one is the same.
                    before = self.waiting.getValue((at,)) if self.waiting.containsKey((at,)) else None
                    self.waiting.updateValue((at,), (bool(good) or bool(before and before[0]),))
                    if before is None:
                        self.handle.registerTimer(at)
                    if at + keep_ms > until:
                        if until:
                            self.handle.deleteTimer(until)
                        until = at + keep_ms
                        self.handle.registerTimer(until)
            self.state.update((status, int(tries), int(until)))
            yield from ()

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            at, held = expiredTimerInfo.getExpiryTimeInMs(), self.state.get()
            if held is None:
                return
            status, tries, until = held
            # Timers come in any order, attempts count in order: all that the watermark has passed.
            passed = sorted((k[0], v[0]) for k, v in self.waiting.iterator() if k[0] <= max(at, timerValues.getCurrentWatermarkInMs()))
            before = status
            for t, good in passed:
                if status == "open":
                    tries += 1
                    status = "ok" if good else "escalated" if tries > retries else "open"
                self.waiting.removeKey((t,))
            if at >= until:
                self.state.clear()
                self.waiting.clear()
            else:
                self.state.update((status, int(tries), int(until)))
            if status != before:
                yield pd.DataFrame({"task": [str(key[0])], "status": [status], "tries": [int(tries)]})

        def close(self) -> None:
            pass

    return Gate()


def settled(attempts: DataFrame, time: str, key: str, ok: str, retries: int = 2, late: str = "1 hour", keep: str = "1 day") -> DataFrame:
    """(task, status, tries) of each task once the watermark has passed what decides it: ok at its first clean attempt, escalated after retries + 1 without one.

    Attempts count in order of their own time, whatever batch they come in; one that comes again counts once.
    What is later than `late` is left out. A task is forgotten `keep` after its latest attempt: no state
    stays of it, and an attempt after that begins it anew. Null keys and times are left out.
    """
    spark = attempts.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    keep_ms = spark.range(1).select((F.unix_millis(F.timestamp_seconds(F.lit(0)) + F.expr(f"INTERVAL {keep}"))).alias("ms")).first()["ms"]
    rows = attempts.where(F.col(key).isNotNull() & F.col(time).isNotNull()).withWatermark(time, late)
    rows = rows.select(F.col(key).cast("string").alias("task"), F.col(time).alias("time"), F.unix_millis(time).alias("at"), F.coalesce(ok, F.lit(False)).alias("good"))
    return rows.groupBy("task").transformWithStateInPandas(_processor(retries, keep_ms), "task string, status string, tries long", "Append", "EventTime")


def by_batch(folder: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: each batch in a folder of its own number, which a batch that comes again writes anew, so that nothing is there twice."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder.rstrip('/')}/batch={number}")

    return write


def written(spark: SparkSession, folder: str, schema: str = "task string, status string, tries long") -> DataFrame:
    """What by_batch() wrote."""
    return spark.read.schema(schema).parquet(f"{folder.rstrip('/')}/batch=*")
