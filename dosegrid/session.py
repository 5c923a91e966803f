"""Session defaults and durable intermediate results."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import TypeVar
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

T_ = TypeVar("T_")

# Largest side that is broadcast, measured in bytes of its rows; a session setting. A run has a
# dozen such sides, and all go through the driver.
BROADCAST_SETTING = "spark.dosegrid.broadcastBytes"
BROADCAST_BYTES = 64 * 1024 * 1024


def broadcast_limit(spark: SparkSession) -> int:
    """The limit that holds just now."""
    return int(spark.conf.get(BROADCAST_SETTING, str(BROADCAST_BYTES)))


def build_session(master: str | None = None, **conf: object) -> SparkSession:
    """Session with the adaptive settings the operators are designed for."""
    builder = (
        SparkSession.builder.appName("dosegrid")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # Split hot join keys even where that costs one more exchange.
        .config("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
        .config("spark.sql.session.timeZone", "UTC")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, str(value))
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """Checkpoint folder of the cluster.

    Where none is set, a temporary one serves if driver and executors are one
    process; on a cluster each machine would write to a disk of its own.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if configured is None and context.getCheckpointDir() is None and not _one_process(context.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(configured or tempfile.mkdtemp(prefix="dosegrid-"))
    return configured or context.getCheckpointDir()


def _one_process(master: str) -> bool:
    return master.split("[")[0] == "local"


def scratch_path(spark: SparkSession, name: str, folder: str | None = None) -> str:
    """Fresh path below the shared folder, or below the one given."""
    return f"{(folder or shared_folder(spark)).rstrip('/')}/{name}-{uuid.uuid4().hex}"


# Size of the tables stored by this process, seen while they were written.
_STORED: WeakKeyDictionary[DataFrame, int] = WeakKeyDictionary()
_PATHS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()

# Folders of the runs that are open, the latest last.
_FOLDERS: list[str] = []


def durable(df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
    """Compute once and cut the lineage: a Parquet table in the shared folder.

    It outlives executors, is read column by column, and gives later plans its
    true size. A table that is stored already is returned as it is.
    ``partition_by`` keeps rows with different values apart, so that a part of
    the table can be read by itself.
    """
    if df in _STORED:
        return df
    path = scratch_path(df.sparkSession, "table", _FOLDERS[-1] if _FOLDERS else None)
    seen = Observation()
    writer = df.observe(seen, _row_bytes(df).alias("bytes")).write
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    _STORED[table] = seen.get["bytes"] or 0
    _PATHS[table] = path
    return table


#: Largest stored table, in bytes of its rows, that is handled by one task without a shuffle.
ONE_TASK_BYTES = 32 * 1024 * 1024


def one_task(table: DataFrame) -> DataFrame:
    """A small stored table as one partition, so that grouping it moves nothing.

    A larger one, or one whose size is not known, comes back as it is.
    """
    if not fits_one_task(table):
        return table
    whole = table.coalesce(1)
    _STORED[whole], _PATHS[whole] = _STORED[table], _PATHS[table]
    return whole


def fits_one_task(table: DataFrame) -> bool:
    """Whether a table is stored and small."""
    return _STORED.get(table, ONE_TASK_BYTES + 1) <= ONE_TASK_BYTES


# What is known of a table by now, by the table and a name; gone with the table.
_KNOWN: WeakKeyDictionary[DataFrame, dict[str, object]] = WeakKeyDictionary()


def remembered(table: DataFrame, name: str, build: Callable[[], T_]) -> T_:
    """What ``build`` makes of a table, made once for all operators that ask by this name."""
    known = _KNOWN.setdefault(table, {})
    if name not in known:
        known[name] = build()
    return known[name]


@contextmanager
def run_store(spark: SparkSession) -> Iterator[str]:
    """Keep the stored tables of a run in a folder of its own, and remove it at the end.

    Results that are read after the run have to be written elsewhere within it.
    """
    folder = scratch_path(spark, "run")
    _FOLDERS.append(folder)
    try:
        yield folder
    finally:
        _FOLDERS.remove(folder)
        for tables in (_STORED, _KNOWN):
            for table in [t for t in tables.keys() if folder in _PATHS.get(t, "")]:
                del tables[table]
        _KNOWN.clear()
        context = spark.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def _row_bytes(df: DataFrame) -> Column:
    """Sum over the rows: text by its length, arrays by 64 a field, the rest by 16."""
    width = F.lit(16 * max(1, len(df.columns))).cast("long")
    for field in df.schema.fields:
        name = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.StringType):
            width = width + F.coalesce(F.octet_length(name), F.lit(0))
        elif isinstance(field.dataType, T.ArrayType):
            width = width + F.coalesce(F.lit(64) * F.size(name), F.lit(0))
            if isinstance(field.dataType.elementType, T.StringType):
                width = width + F.coalesce(F.octet_length(F.array_join(name, "")), F.lit(0))
    return F.coalesce(F.sum(width), F.lit(0))


def measured_bytes(df: DataFrame) -> int:
    """Bytes of the rows of ``df``; runs it unless it is a stored table."""
    if df in _STORED:
        return _STORED[df]
    return df.agg(_row_bytes(df)).first()[0]


def fits_broadcast(df: DataFrame, within: DataFrame | None = None) -> bool:
    """Whether ``df`` is small enough to go to every executor.

    ``within`` may name a stored table that ``df`` is no larger than; if that
    one fits, nothing has to run.
    """
    limit = broadcast_limit(df.sparkSession)
    if within is not None and _STORED.get(within, limit + 1) <= limit:
        return True
    return measured_bytes(df) <= limit


def broadcast_if_small(df: DataFrame, within: DataFrame | None = None) -> DataFrame:
    """Broadcast hint if the measured size allows it, else ``df`` unchanged."""
    return F.broadcast(df) if fits_broadcast(df, within) else df
