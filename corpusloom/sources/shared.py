"""Cutting lineage through the storage that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders written by ``stash`` and not yet deleted, oldest first.
_WRITTEN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the one the session names in ``spark.checkpoint.dir``.

    Where that is unset, a session that runs in one process (tests) gets a temporary folder; on a
    cluster that is an error, since executors couldn't read each other's files.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.corpusloom.shared.dir", None)
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="corpusloom-")
        spark.conf.set("spark.corpusloom.shared.dir", found)
    return found.rstrip("/")


def stash(df: DataFrame, what: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` to the shared folder, in a folder for each value of ``by``, and read it back.

    The rows are then computed once, their lineage ends in replicated storage, and a lost executor
    costs the re-read of its files only. Non-deterministic columns become fixed.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path)
    drop_later(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_later(path: str) -> None:
    """Count a folder among those that ``sweep`` deletes."""
    _WRITTEN.append(path)


def _delete(spark: SparkSession, path: str) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(conf).delete(at, True)
    if path in _WRITTEN:
        _WRITTEN.remove(path)


def unstash(*tables: DataFrame) -> None:
    """Delete stashed tables that no later plan reads."""
    for df in tables:
        names = df.inputFiles()
        for path in [p for p in _WRITTEN if any(p.split("://")[-1] + "/" in n for n in names)]:
            _delete(df.sparkSession, path)


def mark() -> int:
    """A point in time for ``sweep``."""
    return len(_WRITTEN)


def sweep(spark: SparkSession, since: int = 0, keep: tuple[DataFrame, ...] = ()) -> None:
    """Delete all that was stashed since a ``mark``, but for ``keep``; for use once a result has been written."""
    kept = [n for df in keep for n in df.inputFiles()]
    for path in _WRITTEN[since:]:
        if not any(path.split("://")[-1] + "/" in n for n in kept):
            _delete(spark, path)
