"""What the operators share: tables cut from their lineage, size-checked joins, text helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key of more rows is a hub; of E rows at most E / HUB keys are.
HUB = 1000
#: Most rows that a broadcast side may have; its rows are a few dozen bytes wide.
BROADCAST_ROWS = 100_000
#: Most rows of a broadcast side that has nothing but an id or a hash.
BROADCAST_IDS = 1_000_000
#: Rows and bytes that Spark hands Python at a time, where the session names none. By default a batch has 10 000 rows, which
#: is all texts of a task: they are held as Arrow buffers beside the heap, and again, as strings and results, in every worker.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": 1000, "spark.sql.execution.arrow.maxBytesPerBatch": 4 << 20}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def light_batches(spark: SparkSession) -> None:
    """Let Spark hand Python a few megabytes at a time in this session; what it names itself stays. No row is left out."""
    for key, most in BATCHES.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, most)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the session names none (tests in one process) is a temporary folder made and set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        found = spark.conf.get("marlstone.test.dir", None)
        if not found:
            if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            found = tempfile.mkdtemp(prefix="marlstone-")
            spark.conf.set("marlstone.test.dir", found)
    return found.rstrip("/")


_scopes: list[list[Staged]] = []


@contextmanager
def scratch():
    """Within it, every table that operators stage is deleted at the end; what is needed later has to be written elsewhere."""
    own: list[Staged] = []
    _scopes.append(own)
    try:
        yield
    finally:
        _scopes.remove(own)
        for staged in own:
            staged.only()


class Staged:
    """Written tables of one operator run; ``keep`` cuts the lineage, ``drop`` removes what was superseded, and ``only``
    leaves nothing but the tables that a result is still read from."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self.n = 0
        self.paths: list[str] = []
        if _scopes:
            _scopes[-1].append(self)

    def keep(self, df: DataFrame, what: str = "t") -> DataFrame:
        """Write ``df`` as Parquet in the shared folder and read it back."""
        self.n += 1
        path = f"{self.base}/{self.n:03d}-{what}"
        df.write.mode("overwrite").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._marlstone_path = path
        self.paths.append(path)
        return out

    def drop(self, *tables: DataFrame) -> None:
        for path in (getattr(df, "_marlstone_path", None) for df in tables):
            if path in self.paths:
                self.paths.remove(path)
                at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
                at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)

    def only(self, *tables: DataFrame) -> None:
        """Delete all tables but these."""
        left = {getattr(df, "_marlstone_path", None) for df in tables}
        for path in [p for p in self.paths if p not in left]:
            self.paths.remove(path)
            at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)


def unused(name: str, *tables: DataFrame) -> str:
    """A column name that none of the tables has, letter case aside."""
    taken = {c.lower() for df in tables for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> bool:
    """Whether a written table has few enough rows to broadcast (reads Parquet footers only)."""
    return df.count() <= most


def lookup(big: DataFrame, side: DataFrame, key: str, how: str = "left", most: int = BROADCAST_ROWS, salts: int = 32) -> DataFrame:
    """Join ``big`` to ``side`` (a written table, one row per key).

    A side of a checked size is broadcast.  Beyond that both are shuffled, with ``salts`` copies of each
    side row, so that one hot key is dealt over several tasks; equal rows of different partitions are dealt apart too.
    """
    if small(side, most):
        return big.join(F.broadcast(side), key, how)
    salt = unused("salt", big, side)
    hashable = [F.col(f"`{f.name}`") for f in big.schema if "map<" not in f.dataType.simpleString() and f.dataType.simpleString() != "variant"]
    salted = big.withColumn(salt, F.pmod(F.xxhash64(*hashable, F.spark_partition_id()), F.lit(salts)).cast("int"))
    copies = side.withColumn(salt, F.explode(F.array(*[F.lit(i) for i in range(salts)])))
    return salted.join(copies, [key, salt], how).drop(salt)


def of_ids(big: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows of ``big`` whose key is in ``ids`` (a written table of that one column); the ids are broadcast up to a checked
    number, so that what is wide isn't shuffled."""
    return big.join(F.broadcast(ids) if small(ids, BROADCAST_IDS) else ids, key, "left_semi")


def hub_join(staged: Staged, big: DataFrame, side: DataFrame, key: str, hubs: DataFrame | None = None, fits: Callable[[DataFrame], bool] | None = None) -> DataFrame:
    """Inner join to ``side`` (one row per key). Keys of more than HUB rows are few; what is joined to their rows is
    broadcast, if ``fits`` says so, so that no task gets all rows of one. ``hubs`` are these keys, where they are known."""
    if hubs is None:
        hubs = big.groupBy(key).agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > HUB)
    hubs = staged.keep(hubs.select(key), "hubs")
    if hubs.isEmpty() or not small(hubs):
        return big.join(side, key)
    of_hubs = side.join(F.broadcast(hubs), key, "left_semi")
    if fits and not fits(of_hubs):
        return big.join(side, key)
    joined = big.join(F.broadcast(of_hubs), key)
    return joined.unionByName(big.join(F.broadcast(hubs), key, "left_anti").join(side, key))


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5; 0 is the held-out part."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5))


def text_of(name: str = "text") -> Column:
    """The whole text, null as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))
