"""Session defaults, and the tables that runs write to the shared folder to cut lineage.

Every table has an owner. Inside :func:`run_tables` that is the run, and the
tables are removed when it ends; elsewhere it is the session, whose tables are
removed when Python exits. :func:`release` removes a table as soon as nothing
reads it any more.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
import weakref
from collections.abc import Iterator
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

# The folder of the run that this thread is in, and where the tables that are in use were written.
_RUN: ContextVar[str | None] = ContextVar("run", default=None)
_PATHS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
_SESSIONS: dict[str, str] = {}


def local_session(cpus: int | str = "*", app: str = "corpusloom", memory: str = "8g") -> SparkSession:
    """A single-JVM session for tests and the benchmark. Clusters bring their own."""
    partitions = "8" if cpus == "*" else str(cpus)
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", partitions)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        # Files of several row groups are read in more tasks; Settings.read_partitions serves the others.
        .config("spark.sql.files.maxPartitionBytes", "2m")
        .config("spark.sql.files.openCostInBytes", "512k")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor sees, from ``spark.checkpoint.dir``.

    Only a local-mode session, where all tasks share one disk, may fall back to
    a temporary folder.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        folder = tempfile.mkdtemp(prefix="corpusloom-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder


def _file_system(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def is_folder(spark: SparkSession, path: str) -> bool:
    """Whether a path of any store that Spark reaches is a folder; a missing one is not."""
    system, place = _file_system(spark, path)
    return system.exists(place) and system.getFileStatus(place).isDirectory()


def remove_path(spark: SparkSession, path: str) -> None:
    """Remove a file or folder in any store that Spark reaches; a missing one is fine."""
    system, place = _file_system(spark, path)
    system.delete(place, True)


def _session_folder(spark: SparkSession) -> str:
    """The folder of this session's own tables, removed when Python exits."""
    application = spark.sparkContext.applicationId
    if application not in _SESSIONS:
        _SESSIONS[application] = f"{shared_folder(spark).rstrip('/')}/session-{application}-{uuid.uuid4().hex}"
        # Looked up now, as a stopped session has no configuration.
        system, place = _file_system(spark, _SESSIONS[application])

        def remove() -> None:
            # The JVM may be gone; then only the folder's name tells whose tables they were.
            with contextlib.suppress(Exception):
                system.delete(place, True)

        atexit.register(remove)
    return _SESSIONS[application]


@contextlib.contextmanager
def run_tables(spark: SparkSession, name: str = "run") -> Iterator[str]:
    """Tables written inside go to a folder of their own, which is removed at the end, after an error too.

    What the run returns must be written or collected inside. Runs may be nested,
    and may overlap in threads: each knows its own folder only.
    """
    folder = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    token = _RUN.set(folder)
    try:
        yield folder
    finally:
        _RUN.reset(token)
        remove_path(spark, folder)


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder of the run, or of the session outside of runs."""
    return f"{_RUN.get() or _session_folder(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Evaluate ``df`` once into a table in the shared folder and go on from there.

    The table survives lost executors, is pruned by column when read, and gives
    the optimizer its size.
    """
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    _PATHS[table] = path
    return table


def release(*tables: DataFrame) -> None:
    """Remove tables of :func:`materialize` that no later step reads.

    What was made from them must be written by then, so that a lost executor
    does not ask for them again. Other DataFrames are left alone.
    """
    for table in tables:
        path = _PATHS.pop(table, None)
        if path is not None:
            remove_path(table.sparkSession, path)
