"""Session helpers: a configured local session and tables kept between two passes."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", name: str = "siftwood", **conf: str) -> SparkSession:
    """A local session with the settings that the plans of this package expect."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from spark.checkpoint.dir.

    Only where the session names none, as in tests on one machine, a temporary
    folder is made and set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    path = tempfile.mkdtemp(prefix="siftwood-")
    spark.conf.set("spark.checkpoint.dir", "file://" + path)
    atexit.register(_remove_local, path)
    return "file://" + path


def _remove_local(path: str) -> None:
    import shutil

    shutil.rmtree(path, ignore_errors=True)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df once to the shared folder and read it back.

    The written table cuts the lineage, so an executor may be lost afterwards
    without the work being done again, and a frame that is used twice is
    computed once. The files are removed when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/siftwood-{label}-{os.getpid()}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove_shared, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _remove_shared(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may have ended before
        pass


def text_batches(spark: SparkSession, rows: int = 512) -> None:
    """See that a batch of long texts fits in a Python worker's memory.

    Batches are bounded by their bytes, by default 64 MB, and the session is left as
    it is; only where Spark doesn't know that bound, the rows are bounded instead.
    """
    try:
        spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
        return
    except PySparkException:
        pass
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows or int(spark.conf.get(key)) <= 0:
        spark.conf.set(key, str(rows))


def reachable(spark: SparkSession) -> None:
    """Let the Python workers import this package from where the driver has it.

    Enough where the executors see the driver's files; elsewhere the package must
    be installed or shipped with addPyFile.
    """
    home = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if home not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([home, *([known] if known else [])])
