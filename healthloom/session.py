"""A session with the settings that the plans are written for."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "healthloom", master: str | None = None) -> SparkSession:
    """Local by default; on a cluster the submitted settings win over these."""
    cores = os.cpu_count() or 4
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    if master or "SPARK_MASTER" not in os.environ:
        builder = builder.master(master or f"local[{cores}]").config("spark.sql.shuffle.partitions", str(cores))
        builder = builder.config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    return builder.getOrCreate()


def shared_root(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; one on this machine only where none is set and the session is local."""
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
    return context._jsc.sc().getCheckpointDir().get()


def new_place(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has yet; ``gone`` removes it."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def open_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one that the driver and the executors can open as files."""
    folder = new_place(spark, name).removeprefix("file://").removeprefix("file:")
    if "://" in folder:
        raise RuntimeError("files need a shared folder that can be opened as such; spark.checkpoint.dir names none")
    os.makedirs(folder, exist_ok=True)
    return folder


def gone(spark: SparkSession, path: str) -> None:
    """Removes what this library has written there, through Spark's file system."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def moved(spark: SparkSession, source: str, target: str) -> None:
    """Renames a folder; nothing may be at ``target``."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    if not path(source).getFileSystem(spark._jsc.hadoopConfiguration()).rename(path(source), path(target)):
        gone(spark, source)
        raise OSError(f"{source} could not be moved to {target}")


def names_in(spark: SparkSession, folder: str) -> list[str]:
    """What a folder holds, by name."""
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(f.getPath().getName() for f in system.listStatus(place)) if system.exists(place) else []


def there(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


class Tables:
    """Written tables of steps that follow each other, in one folder of the shared one.

    Unlike a checkpoint a written table keeps no estimates or constraints of the plan that made it, so plans of
    many rounds stay small.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.folder, self.n = spark, new_place(spark, name), 0

    def put(self, df: DataFrame) -> DataFrame:
        self.n += 1
        df.write.parquet(f"{self.folder}/{self.n}")
        return self.spark.read.schema(df.schema).parquet(f"{self.folder}/{self.n}")

    def drop(self) -> None:
        gone(self.spark, self.folder)


def spread(df: DataFrame, *by: str) -> DataFrame:
    """``df`` dealt by ``by`` to a few tasks for each core, where work on a row is far more than its size tells.

    Spark deals rows by their bytes: a hundred thousand names are one task, whatever is opened, read or parsed for each.
    """
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, *by)


def durable(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read from there: a lost executor does not take it along."""
    shared_root(df.sparkSession)
    return df.checkpoint()
