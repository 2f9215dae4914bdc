"""Session helpers: a builder for local use, and the one way this library cuts lineage."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}
_folders: set[str] = set()
_scopes: list[list[DataFrame]] = []


def local_session(cpus: int | str = 8, app: str = "shutterloom", **conf: str) -> SparkSession:
    """A local session with the settings the tests and the bench use."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("SHUTTERLOOM_DRIVER_MEMORY", "8g"))
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only where the setting is absent and the master is
    local (tests), because a cluster's executors cannot share a machine-local folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        if "folder" not in _local:
            _local["folder"] = tempfile.mkdtemp(prefix="shutterloom-")
            atexit.register(shutil.rmtree, _local["folder"], ignore_errors=True)
        folder = "file://" + _local["folder"]
    return folder.rstrip("/")


def cut_lineage(df: DataFrame, replaces: DataFrame | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and go on from the written copy, with fresh statistics.

    ``replaces`` is an earlier result of this function that nothing will read any more; its files go. All tables of an
    application lie in a folder of its own, which goes with the application; ``scratch`` lets them go earlier.
    """
    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/shutterloom/{spark.sparkContext.applicationId}"
    path = f"{folder}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut = path
    if folder not in _folders:
        _folders.add(folder)
        atexit.register(_forget, folder)
    if _scopes:
        _scopes[-1].append(out)
    if replaces is not None:
        release(replaces)
    return out


def release(df: DataFrame) -> None:
    """Delete the files of a table that ``cut_lineage`` wrote, once nothing will read it any more."""
    path = df.__dict__.pop("_cut", None)
    if path:
        remove(df.sparkSession, path)


@contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Within this scope tables are written for passing use: at its end all go, but the one that was handed to ``keep``.

    >>> with scratch() as keep:
    ...     result = keep(program(df))  # written, so that it needs no other table
    """
    own: list[DataFrame] = []
    kept: list[DataFrame] = []

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df if "_cut" in df.__dict__ else cut_lineage(df))
        return kept[-1]

    _scopes.append(own)
    try:
        yield keep
    finally:
        _scopes.pop()
        for df in own:
            if not any(df is k for k in kept):
                release(df)
        if _scopes:
            _scopes[-1].extend(kept)


def _forget(folder: str) -> None:
    """Delete the tables of an application at its end: through Spark where it still runs, else where the folder is a path."""
    sc = SparkContext._active_spark_context
    try:
        if sc is not None:
            at = sc._jvm.org.apache.hadoop.fs.Path(folder)
            at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)
        elif folder.startswith("file:"):
            shutil.rmtree(folder.removeprefix("file://"), ignore_errors=True)
    except Exception:  # the gateway may be gone by now
        if folder.startswith("file:"):
            shutil.rmtree(folder.removeprefix("file://"), ignore_errors=True)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system."""
    sc = spark.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)


def ship(spark: SparkSession) -> None:
    """Let the Python workers import this package: nothing to do where PYTHONPATH names its folder, as on a cluster that
    has it installed or mounted; otherwise Spark hands the sources out with the application."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    sc = spark.sparkContext
    if root in os.environ.get("PYTHONPATH", "").split(os.pathsep) or getattr(sc, "_shutterloom", False):
        return
    folder = tempfile.mkdtemp(prefix="shutterloom-code-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    sc.addPyFile(shutil.make_archive(os.path.join(folder, "shutterloom"), "zip", root, "shutterloom"))
    sc._shutterloom = True


def stored_blocks(df: DataFrame, blocks: int) -> tuple[DataFrame, Callable[[], Iterator]]:
    """``df`` written in about ``blocks`` files of the shared folder, and what yields them as pandas frames within a task,
    one at a time: a table that many rows meet, but that no task or driver has to hold."""
    written = cut_lineage(df.repartition(blocks))
    files = sorted(written.inputFiles())

    def read() -> Iterator:
        import pyarrow.fs
        import pyarrow.parquet

        for f in files:
            fs, at = pyarrow.fs.FileSystem.from_uri(f)
            yield pyarrow.parquet.read_table(at, filesystem=fs).to_pandas()

    return written, read
