"""The state of jobs as a stream over a log of their changes, kept by job, with timers for those that get stuck."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: Where the state is kept; only this store has timers.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
#: Statuses of a job that is not done, and what a job is called that stayed in one of them for too long.
OPEN, TIMED_OUT = ("queued", "running"), "timed out"


class JobState(StatefulProcessor):
    """The last change of a job, by time, then status, then number; older ones that come later change nothing."""

    def __init__(self, open_statuses: tuple[str, ...], stuck_after_ms: int):
        self.open, self.after = frozenset(open_statuses), stuck_after_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "micros long, status string, event_id long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        known = self._known()
        best = max((r.micros, str(r.status), r.event_id) for r in rows)
        if known is None or best > known:
            if known is not None and known[1] in self.open:
                self.handle.deleteTimer(self._due(known))
            yield self._changed(key, best, None)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        known, expiry = self._known(), expiredTimerInfo.getExpiryTimeInMs()
        if known is not None and known[1] in self.open:
            if self._due(known) > expiry:  # set when stuck_after_ms was shorter
                self.handle.registerTimer(self._due(known))
            else:
                yield self._changed(key, (expiry * 1000, "failed", known[2]), TIMED_OUT)

    def _known(self) -> tuple | None:
        before = self.last.get()
        return None if before is None else tuple(before)

    def _due(self, state: tuple) -> int:
        return state[0] // 1000 + self.after

    def _changed(self, key, best: tuple, error: str | None) -> Row:
        self.last.update(best)
        if best[1] in self.open:
            self.handle.registerTimer(self._due(best))
        return Row(id=key[0], status=best[1], event_id=best[2], micros=best[0], error=error)

    def close(self) -> None:
        pass


def job_changes(log: DataFrame, late: str = "1 hour", stuck_after_ms: int | None = None, open_statuses: tuple[str, ...] = OPEN) -> DataFrame:
    """(id, status, event_id, updated_at, error): the changes of state of every job in a log (id, status, event_id, updated_at), streamed or not.

    Without timers this is an aggregation that keeps the last change of a job: no row is too late, and a job has a row for each batch that
    names it, the same again where that batch brings older rows only. With stuck_after_ms a job that stays open for so long fails as timed
    out, once the watermark is there; rows later than the watermark are then passed over, and only changes have a row. State is kept by
    job, so it grows with the number of jobs and not with the log.
    """
    spark = log.sparkSession
    spark.conf.set(*STORE)
    rows = log.select("id", "status", F.col("event_id").cast("long").alias("event_id"), F.col("updated_at").cast("timestamp").alias("updated_at"))
    if stuck_after_ms is None:
        last = rows.groupBy("id").agg(F.max(F.struct("updated_at", "status", "event_id")).alias("c"))
        return last.select("id", "c.status", "c.event_id", "c.updated_at", F.lit(None).cast("string").alias("error"))
    kind = log.schema["id"].dataType.simpleString()
    changes = rows.withWatermark("updated_at", late).withColumn("micros", F.unix_micros("updated_at")).groupBy("id").transformWithState(
        statefulProcessor=JobState(open_statuses, stuck_after_ms), outputStructType=f"id {kind}, status string, event_id long, micros long, error string", outputMode="Update", timeMode="EventTime"
    )
    return changes.select("id", "status", "event_id", F.timestamp_micros("micros").alias("updated_at"), "error")


def run_job_stream(spark: SparkSession, log: DataFrame, out: str, checkpoint: str, **options: object) -> None:
    """Take what a log has now, append the changes to a table at out, and end; run again it goes on from its checkpoint."""

    def write(batch: DataFrame, number: int) -> None:  # a batch that runs again writes its folder anew
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = job_changes(log, **options).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def last_changes(changes: DataFrame) -> DataFrame:
    """The last change of every job in a table of changes."""
    return changes.groupBy("id").agg(F.max(F.struct("updated_at", "status", "event_id", "error")).alias("c")).select("id", "c.status", "c.event_id", "c.updated_at", "c.error")
