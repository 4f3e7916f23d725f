"""Tables of an index on disk: generations that appear at once, upserts, retention, counters.

A generation is a folder that is written whole and then named in a pointer file;
readers follow the pointer, so they see all of a generation or none of it.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POINTER = "CURRENT"


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target, jvm


def write_small(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file beside its place and move it there."""
    fs, target, jvm = _fs(spark, path)
    part = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    out = fs.create(part, True)
    out.write(bytearray(text.encode()))
    out.close()
    fs.delete(target, False)
    if not fs.rename(part, target):
        raise OSError(f"can't write {path}")


def read_small(spark: SparkSession, path: str) -> str | None:
    fs, target, jvm = _fs(spark, path)
    if not fs.exists(target):
        return None
    stream = fs.open(target)
    text = jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    stream.close()
    return text


class Store:
    """The generations of an index below a folder that all executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def current(self) -> str:
        """The folder of the published generation; an error if there is none."""
        text = read_small(self.spark, f"{self.root}/{POINTER}")
        if text is None:
            raise FileNotFoundError(f"no complete generation below {self.root}")
        return f"{self.root}/{json.loads(text)['generation']}"

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.current()}/{name}.parquet")

    def publish(self, tables: dict[str, DataFrame], **about) -> str:
        """Write a generation of all tables, then point to it; what was published before stays readable."""
        name = f"gen={uuid.uuid4().hex}"
        for table, df in tables.items():
            df.write.parquet(f"{self.root}/{name}/{table}.parquet")
        write_small(self.spark, f"{self.root}/{POINTER}", json.dumps({"generation": name, "tables": sorted(tables), **about}))
        return name

    def about(self) -> dict:
        text = read_small(self.spark, f"{self.root}/{POINTER}")
        return json.loads(text) if text else {}

    def append(self, name: str, df: DataFrame) -> None:
        df.write.mode("append").parquet(f"{self.root}/log/{name}.parquet")

    def log(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/log/{name}.parquet")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """new, and the rows of old whose key new doesn't have."""
    return old.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def replaced(old: DataFrame, new: DataFrame, files: DataFrame) -> DataFrame:
    """old without the rows of the files, and new: the derived rows of files that were read again."""
    return old.join(files.select("file_id"), "file_id", "left_anti").unionByName(new, allowMissingColumns=True)


def without_files(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """All tables without the rows of files that are gone."""
    return {n: df.join(gone.select("file_id"), "file_id", "left_anti") if "file_id" in df.columns else df for n, df in tables.items()}


def unresolved_dropped(edges: DataFrame, kinds: list[str]) -> DataFrame:
    return edges.where(F.col("resolved") | ~F.col("kind").isin(kinds))


def counters(log: DataFrame) -> DataFrame:
    """name and total of counters that are kept as increments."""
    return log.groupBy("name").agg(F.sum("n").alias("total"))


def retained(rows: DataFrame, at: str, now: str, days: int = 30) -> DataFrame:
    """The rows of the last days."""
    return rows.where(F.col(at) >= F.to_timestamp(F.lit(now)) - F.expr(f"INTERVAL {days} DAYS"))
