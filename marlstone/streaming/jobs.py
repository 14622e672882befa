"""Streams: ingest with rollups, a live tail, status transitions, and alert states.

Arrival order decides, not event time, so no watermark drops late rows: rollups append partial rows that merge
later, the tail windows on arrival, and states are keyed.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from marlstone.operators.alerts import step
from marlstone.operators.rollups import hourly, log_counts, metric_rollup
from marlstone.sources.tables import conform, write


def ingest(stream: DataFrame, path: str, table: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Append a stream of rows to a table and their partial aggregates to its rollups.

    A batch that is repeated after a failure replaces what it wrote: each batch has a folder of its own
    under the table, by its number.
    """

    def batch(df: DataFrame, number: int) -> None:
        rows = conform(df, table).persist()
        try:
            if rows.isEmpty():
                return
            for name, part in [(table, rows), *_rollups(rows, table)]:
                write(part, path, name, mode="overwrite", within=f"/batch={number}")
        finally:
            rows.unpersist()

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 second")).start()


def _rollups(rows: DataFrame, table: str) -> list[tuple[str, DataFrame]]:
    if table == "logs":
        return [("logs_counts_5m", log_counts(rows))]
    if table == "metrics":
        five = metric_rollup(rows)
        return [("metrics_5m", five), ("metrics_1h", hourly(five))]
    return []


def read_batches(spark, path: str, table: str) -> DataFrame:
    """A table that :func:`ingest` writes, of all batches. Rollups are partial rows, to be merged by the query."""
    from marlstone.sources.tables import schema

    declared = schema(table).add("d", "date").add("batch", "long")
    return spark.read.schema(declared).parquet(f"{path}/{table}").drop("batch")


def tail_stream(stream: DataFrame, tenant: str, now_column: str = "ingested_at") -> DataFrame:
    """Rows of a tenant as they arrive, if they were observed at most an hour before and five minutes after."""
    at, seen = F.col(now_column), F.col("observed_at")
    return stream.where(F.col("tenant_id") == tenant).where((seen >= at - F.expr("INTERVAL 1 HOUR")) & (seen < at + F.expr("INTERVAL 5 MINUTES")))


class AlertState(StatefulProcessor):
    """The alert state machine of one key, over evaluations as they come."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("alert", "phase string, since timestamp")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).sort_values("at", kind="stable")
        was = self.state.get() if self.state.exists() else None
        phase, since = (was[0], pd.Timestamp(was[1])) if was else (None, None)
        out = []
        for r in pdf.itertuples(index=False):
            if r.suppressed:
                continue
            phase, since, notify = step(phase, since, bool(r.breaching), r.hold_seconds, r.at)
            out.append((key[0], r.at, phase, since, notify and not r.muted))
        if phase is not None:
            self.state.update((phase, since.to_pydatetime()))
        yield pd.DataFrame(out, columns=["dedup_key", "at", "phase", "since", "notify"])

    def close(self) -> None:
        pass


TRANSITIONS = "dedup_key string, at timestamp, phase string, since timestamp, notify boolean"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def alert_stream(evaluations: DataFrame) -> DataFrame:
    """Transitions of a stream of evaluations (dedup_key, at, breaching, hold_seconds, suppressed, muted). The session
    needs the RocksDB state store."""
    return evaluations.groupBy("dedup_key").transformWithStateInPandas(AlertState(), TRANSITIONS, "append", "none")


def status_stream(checks: DataFrame) -> DataFrame:
    """Changes of status (resource_id, at, previous_status, current_status) of a stream of checks (resource_id, at,
    status). A resource under maintenance or out of use keeps its status."""

    def change(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        out = []
        for r in pd.concat(list(batches)).sort_values("at", kind="stable").itertuples(index=False):
            if last in ("maintenance", "decommissioned") and r.status not in ("maintenance", "decommissioned", "active"):
                continue
            if r.status != last:
                out.append((key[0], r.at, last, r.status))
                last = r.status
        if last is not None:
            state.update((last,))
        yield pd.DataFrame(out, columns=["resource_id", "at", "previous_status", "current_status"])

    return checks.groupBy("resource_id").applyInPandasWithState(
        change, "resource_id string, at timestamp, previous_status string, current_status string", "status string", "append", "NoTimeout")


def expire(spark, path: str, table: str, now: datetime) -> list[str]:
    """Delete the day partitions of a table that are past its retention; their paths."""
    from marlstone.operators.rollups import RETENTION

    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(f"{path}/{table}")
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    floor = (now - pd.Timedelta(days=RETENTION[table])).date().isoformat()
    gone, todo = [], [root]
    while todo:
        for entry in fs.listStatus(todo.pop()):
            at, name = entry.getPath(), entry.getPath().getName()
            if not entry.isDirectory():
                continue
            if not name.startswith("d="):
                todo.append(at)
            elif name[2:] < floor:
                fs.delete(at, True)
                gone.append(at.toString())
    return gone
