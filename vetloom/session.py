"""Session, table and shared-folder helpers used by every operator."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Bytes a task should at least have before spread() leaves the layout to the files.
SMALL = 4 << 20


def get_spark(app: str = "vetloom", cores: str | int = "*", shuffle: int = 8) -> SparkSession:
    """A local session for tests and the benchmark; a cluster brings its own session."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("VETLOOM_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once for each SparkContext, so that Python workers find it anywhere."""
    sc = spark.sparkContext
    if getattr(sc, "_vetloom_shipped", False):
        return
    home = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="vetloom-code-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    with zipfile.ZipFile(f"{folder}/vetloom.zip", "w") as z:
        for p in sorted(home.rglob("*.py")):
            z.write(p, str(p.relative_to(home.parent)))
    sc.addPyFile(f"{folder}/vetloom.zip")
    sc._vetloom_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data folder."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df over all tasks where its files are so small that they give few; rows and results stay the same."""
    tasks = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(tasks) if size < tasks * SMALL else df


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; where that is unset, a temporary one for a local master, else an error."""
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not where:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = tempfile.mkdtemp(prefix="vetloom-")
        atexit.register(shutil.rmtree, where, ignore_errors=True)
        sc.setCheckpointDir(where)
    return where


def cut(df: DataFrame) -> DataFrame:
    """df computed once, its lineage cut by a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """df written once as Parquet into the shared folder and read again, so later readers prune columns."""
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/vetloom-{uuid.uuid4().hex}"
    df.write.parquet(at)
    gone = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    conf = spark.sparkContext._jsc.hadoopConfiguration()

    def remove() -> None:
        try:
            gone.getFileSystem(conf).delete(gone, True)
        except Exception:
            pass  # the session is closed; the shared folder's owner clears it

    atexit.register(remove)
    return spark.read.parquet(at)
