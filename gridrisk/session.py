"""Session settings and the shared folder that cut lineage and intermediate tables go to."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build_session(cores: str | int = "*", app: str = "gridrisk", **conf: str) -> SparkSession:
    """A local session with the settings every job here assumes.

    On a cluster the session is given; only the time zone and adaptive execution matter.
    """
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.bindAddress", "127.0.0.1")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return ship_package(builder.getOrCreate())


def ship_package(spark: SparkSession) -> SparkSession:
    """Send this package to the executors, once per application, so that tasks find its functions."""
    context = spark.sparkContext
    if not getattr(context, "_gridrisk_shipped", False):
        root = Path(__file__).resolve().parent
        # executors fetch the archive when their first task starts, so it stays until the driver ends
        folder = tempfile.mkdtemp(prefix="gridrisk-ship-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        archive = f"{folder}/gridrisk-{uuid.uuid4().hex[:8]}.zip"
        with zipfile.ZipFile(archive, "w") as out:
            for path in sorted(root.rglob("*.py")):
                out.write(path, f"{root.name}/{path.relative_to(root)}")
        context.addPyFile(archive)
        context._gridrisk_shipped = True
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it.

    Only a local session without the setting falls back to a folder of this machine.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is not set; a cluster needs a shared folder")
    # kept on the context: a running session does not take the setting any more
    context = spark.sparkContext
    if not getattr(context, "_gridrisk_folder", None):
        context._gridrisk_folder = tempfile.mkdtemp(prefix="gridrisk-")
        atexit.register(shutil.rmtree, context._gridrisk_folder, ignore_errors=True)
    return context._gridrisk_folder


_watchers: list[list[str]] = []


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path under the shared folder that no earlier run has written to."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    for made in _watchers:
        made.append(path)
    return path


@contextmanager
def staged_paths() -> Iterator[list[str]]:
    """The paths that are staged meanwhile, to remove when what rests on them has been written."""
    made: list[str] = []
    _watchers.append(made)
    try:
        yield made
    finally:
        # by identity: two empty lists are equal
        _watchers[:] = [x for x in _watchers if x is not made]


def remove_staged(spark: SparkSession, paths: list[str]) -> None:
    """Delete staged tables, wherever the shared folder lies."""
    hadoop, conf = spark.sparkContext._jvm.org.apache.hadoop.fs, spark.sparkContext._jsc.hadoopConfiguration()
    for path in map(hadoop.Path, paths):
        path.getFileSystem(conf).delete(path, True)


def cut_lineage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write the rows to the shared folder and go on from there.

    They survive the loss of the executors that made them, are computed once, and come back with
    a known size, so the joins that follow can tell a small side from a large one.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
