"""Session helpers."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    builder = SparkSession.builder.master(f"local[{cores}]").appName("stratafield")
    settings = {"spark.sql.shuffle.partitions": str(shuffle_partitions), "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false", "spark.sql.adaptive.enabled": "true"} | conf
    for k, v in settings.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once for each application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp()
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = os.path.join(folder, "stratafield.zip")
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, f"{root.name}/{p.relative_to(root)}")
    context.addPyFile(path)
    _shipped.add(context.applicationId)


def shared_folder(spark: SparkSession) -> str:
    """Folder that the driver and all executors see: spark.checkpoint.dir, or in local mode one of our own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return os.path.join(tempfile.gettempdir(), "stratafield-checkpoints")


def own_folder(spark: SparkSession) -> str:
    """This application's part of the shared folder."""
    return f"{shared_folder(spark)}/stratafield/{spark.sparkContext.applicationId}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: plans start there, and a lost executor costs nothing before it."""
    _drop_at_the_end(df.sparkSession)
    path = f"{own_folder(df.sparkSession)}/{uuid.uuid4().hex}-{name}"
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back.written_to = path
    return back


_dropped: set[str] = set()


def _drop_at_the_end(spark: SparkSession) -> None:
    """The application's part of the shared folder goes when its driver ends, once all that reads it has ended too."""
    folder = own_folder(spark)
    if folder not in _dropped:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
        _dropped.add(folder)


def read_written(tables: list[DataFrame]) -> DataFrame:
    """Tables of one schema that materialize() wrote, as one scan."""
    return tables[0].sparkSession.read.schema(tables[0].schema).parquet(*[t.written_to for t in tables])


def clear(spark: SparkSession) -> None:
    """Delete what this application has put into the shared folder; frames that were built on it can't be read after that."""
    path = spark._jvm.org.apache.hadoop.fs.Path(own_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
