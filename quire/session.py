"""Session settings and the shared scratch folder."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession

_local_scratch: tempfile.TemporaryDirectory | None = None
_written: list[str] = []


def build_session(app: str = "quire", master: str | None = None, **conf: object) -> SparkSession:
    """A session with adaptive execution on; ``conf`` overrides single settings.

    Dots in setting names are written as double underscores:
    ``build_session(spark__sql__shuffle__partitions=8)``.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master is not None:
        builder = (
            builder.master(master)
            .config("spark.driver.host", "127.0.0.1")
            .config("spark.driver.bindAddress", "127.0.0.1")
        )
    for name, value in conf.items():
        builder = builder.config(name.replace("__", "."), str(value))
    return builder.getOrCreate()


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path for an intermediate table.

    The parent is ``spark.checkpoint.dir``, which a cluster points at storage
    every executor can reach. Only a local master may go without it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        base = _local_base()
    _written.append(f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}")
    return _written[-1]


def _local_base() -> str:
    global _local_scratch
    if _local_scratch is None:
        _local_scratch = tempfile.TemporaryDirectory(prefix="quire-")
    return _local_scratch.name


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the scratch folder and read it back.

    Used for small fitted tables (a vocabulary, a label list): the plan that
    consumes them then starts from files of known size, so the planner can
    choose between broadcast and shuffle, and a lost executor costs no refit.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    with _shuffles_dropped(spark):
        df.write.parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found.scratch = path
    return found


#: Whether Spark deletes what a plan has shuffled when the plan has run.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def _shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What a table's plan shuffles is of no use once the table is written. Left alone it
    stays on disk until the driver happens to collect its garbage."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def kept_as(table: DataFrame, view: DataFrame) -> DataFrame:
    """``view``, which reads only the written ``table`` and can be discarded in its place."""
    view.scratch = getattr(table, "scratch", None)
    return view


def discard(*tables: DataFrame | None) -> None:
    """Delete written tables that nothing reads any more."""
    for table in tables:
        path = None if table is None else getattr(table, "scratch", None)
        if path in _written:
            _written.remove(path)
            _delete(table.sparkSession, path)


def settled(build: Callable[[], DataFrame], label: str) -> DataFrame:
    """Write what ``build`` gives. The tables that were written for it on the way go."""
    before = set(_written)
    found = materialise(build(), label)
    for path in [path for path in _written if path not in before and path != found.scratch]:
        _written.remove(path)
        _delete(found.sparkSession, path)
    return found


def _delete(spark: SparkSession, path: str) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    folder = jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(conf).delete(folder, True)


def drop_scratch(spark: SparkSession) -> None:
    """Delete every table this process wrote to the scratch folder.

    For the end of a job: frames that still read such a table are void afterwards.
    """
    while _written:
        _delete(spark, _written.pop())


def spread_small(df: DataFrame) -> DataFrame:
    """Repartition an input that arrives as fewer pieces than there are cores.

    A file with one row group is one task, however many cores wait. Inputs of a
    cluster's size come in more pieces than cores and are left as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    pieces = len(df.inputFiles())
    return df.repartition(cores) if pieces < cores else df
