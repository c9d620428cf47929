"""Session helpers: table access and lineage cuts in the folder all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession) -> None:
    """Give the workers this package, once per context: they may not have it on their path.

    The archive lies in the folder from which Spark serves files to the executors.
    """
    context = spark.sparkContext
    if getattr(context, "_corpusloom_shipped", False):
        return
    root = Path(__file__).resolve().parent
    archive = Path(SparkFiles.getRootDirectory(), f"corpusloom-{uuid.uuid4().hex}.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, path.relative_to(root.parent))
    context.addPyFile(str(archive))
    context._corpusloom_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a data directory."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; only in local mode, as in tests, an own one where that is unset."""
    context = spark.sparkContext
    known = context.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not known:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        own = tempfile.mkdtemp(prefix="corpusloom-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        known = f"file://{own}"
        spark.conf.set("spark.checkpoint.dir", known)
    return known.rstrip("/")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as a table in the shared folder and read it back.

    This cuts the lineage and keeps an expensive stage from running again; unlike cached blocks the
    files survive the loss of an executor.  ``clear`` removes them.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/corpusloom/{_run(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _run(spark: SparkSession) -> str:
    """Folder of this application's tables."""
    return f"run-{spark.sparkContext.applicationId}"


def clear(spark: SparkSession) -> None:
    """Remove the tables of ``materialize``; results that have not been written by then can no longer be read."""
    path = hadoop_path(spark, f"{shared_dir(spark)}/corpusloom/{_run(spark)}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def hadoop_path(spark: SparkSession, path: str):
    """``path`` for the file system that its scheme names."""
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, on whatever store Spark reads it from."""
    at = hadoop_path(spark, path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def files(spark: SparkSession, path: str) -> dict[str, list[int]]:
    """Size and change time of each file below ``path``, hidden ones and marks left out."""
    at = hadoop_path(spark, path)
    found, out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(at, True), {}
    while found.hasNext():
        status = found.next()
        if not status.getPath().getName().startswith(("_", ".")):
            out[status.getPath().toString()] = [status.getLen(), status.getModificationTime() // 1000]
    return out
