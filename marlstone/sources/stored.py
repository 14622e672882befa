"""Telemetry tables as they are stored: written once for a session, read by partition afterwards."""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Callable, Iterator, Mapping

from pyspark.sql import DataFrame, SparkSession

from marlstone.operators.rollups import hourly, log_counts, merge_counts, merge_metrics, metric_rollup
from marlstone.sources.tables import read, write

#: Tables that follow from another one.
DERIVED = {"logs_counts_5m": ("logs", log_counts), "metrics_5m": ("metrics", metric_rollup), "metrics_1h": ("metrics_5m", hourly)}
_open: dict[tuple[str, str], Stored] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one where the session names none and all run in one process."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = spark.conf.get("marlstone.stored.dir", None)
    if not made:
        made = tempfile.mkdtemp(prefix="marlstone-stored-")
        spark.conf.set("marlstone.stored.dir", made)
    return made


class Stored(Mapping):
    """Tables by name under a folder. A table is written when it is first asked for, base tables as ``build`` gives
    them and rollups from what is stored; each is opened once, so its files are listed once."""

    def __init__(self, spark: SparkSession, path: str, build: Mapping[str, Callable[[], DataFrame]], parts: int = 1):
        self.spark, self.path, self.build, self.parts = spark, path, build, parts
        self._opened: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._opened:
            if name in DERIVED:
                source, roll = DERIVED[name]
                rows = roll(self[source])
            else:
                rows = self.build[name]()
            write(rows, self.path, name, mode="overwrite", parts=self.parts)
            self._opened[name] = read(self.spark, self.path, name)
        return self._opened[name]

    def __iter__(self) -> Iterator[str]:
        return iter([*self.build, *DERIVED])

    def __len__(self) -> int:
        return len(self.build) + len(DERIVED)


def stored(spark: SparkSession, source: str, build: Mapping[str, Callable[[], DataFrame]]) -> Stored:
    """The stored tables of a source in this session."""
    key = (spark.sparkContext.applicationId, source)
    if key not in _open:
        name = hashlib.sha256(source.encode()).hexdigest()[:12]
        _open[key] = Stored(spark, f"{shared_dir(spark)}/telemetry-{key[0]}-{name}", build)
    return _open[key]


def compact(spark: SparkSession, path: str, table: str, parts: int = 1) -> int:
    """Replace the batch folders of an ingested table by one, with the partial rows of rollups merged; the number of
    batches before. The new folder is written beside the old ones and named when it is whole, and the old ones go after
    that; ingest must not run meanwhile, and a batch it repeats later replaces nothing, so compact at a checkpoint."""
    from marlstone.streaming.jobs import read_batches

    jvm = spark._jvm
    at = lambda name: jvm.org.apache.hadoop.fs.Path(f"{path}/{table}/{name}")
    fs = at("").getFileSystem(spark._jsc.hadoopConfiguration())
    batches = [s.getPath().getName() for s in fs.listStatus(at("."))if s.getPath().getName().startswith("batch=")]
    if len(batches) < 2:
        return len(batches)
    rows = read_batches(spark, path, table)
    if table == "logs_counts_5m":
        rows = merge_counts(rows)
    elif table in ("metrics_5m", "metrics_1h"):
        rows = merge_metrics(rows)
    last = max(int(b[6:]) for b in batches)
    write(rows, path, table, mode="overwrite", within="/_compacted", parts=parts)
    for b in batches:
        fs.delete(at(b), True)
    fs.rename(at("_compacted"), at(f"batch={last}"))
    return len(batches)
