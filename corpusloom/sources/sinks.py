"""Writers of stores, status files and bundles."""

from __future__ import annotations

import json
import os
import shutil
import zipfile
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas


def _path(df: DataFrame, path: str):
    spark = df.sparkSession
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def save_store(chunks: DataFrame, path: str, config: Mapping[str, object], rows_per_file: int = 200_000) -> bool:
    """Write a chunk store by tenant and index, and beside it each tenant's config with its number of chunks; an empty store removes the folder.

    Only the tenants and indexes in ``chunks`` are overwritten. Returns whether a store is there. What
    was written is counted, so the rows are worked out once.
    """
    spark = chunks.sparkSession
    at, fs = _path(chunks, path)
    rows = schemas.conform(chunks, schemas.CHUNK)
    if rows.isEmpty():
        fs.delete(at, True)
        fs.delete(_path(chunks, config_path(path))[0], True)
        return False
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("maxRecordsPerFile", rows_per_file).partitionBy("tenant", "index_name").parquet(path)
    told = spark.createDataFrame([(k, json.dumps(list(v)) if isinstance(v, (list, tuple)) else str(v)) for k, v in config.items() if k != "num_chunks"], "key string, value string")
    counted = spark.read.schema(schemas.CHUNK).parquet(path).groupBy("tenant").agg(F.count("*").cast("string").alias("value")).withColumn("key", F.lit("num_chunks"))
    facts = counted.select("tenant", "key", "value").unionByName(counted.select("tenant").crossJoin(F.broadcast(told)))  # a few settings for each tenant
    facts.write.mode("overwrite").parquet(config_path(path))
    return True


def config_path(path: str) -> str:
    return path.rstrip("/") + "_config"


def delete_tenant(any_frame: DataFrame, path: str, tenant: str) -> int:
    """Remove a tenant's partition; returns how many files went."""
    at, fs = _path(any_frame, f"{path.rstrip('/')}/tenant={tenant}")
    if not fs.exists(at):
        return 0
    n = fs.getContentSummary(at).getFileCount()
    fs.delete(at, True)
    return n


def append_messages(messages: DataFrame, path: str) -> None:
    schemas.conform(messages, schemas.MESSAGE).write.mode("append").parquet(path)


def write_status(status: DataFrame, path: str, updated_at: str) -> None:
    """A JSON line for each document with its state and when it was told; as many files as tasks, so no task sees all."""
    status.select(F.lit(updated_at).alias("updated_at"), "doc_name", "status", "chunks", "mode", "error").write.mode("overwrite").json(path)


def read_status(spark: SparkSession, path: str) -> DataFrame:
    """What ``write_status`` wrote; a line that isn't JSON gives no row."""
    kind = "updated_at string, doc_name string, status string, chunks bigint, mode string, error string"
    return spark.read.schema(kind).option("mode", "DROPMALFORMED").json(path)


def zip_folder(folder: str, target: str) -> int:
    """Deflate a local folder into a zip file; returns the number of files."""
    n = 0
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for base, _, names in os.walk(folder):
            for name in sorted(names):
                full = os.path.join(base, name)
                z.write(full, os.path.relpath(full, folder))
                n += 1
    return n


def delete_files(paths: list[str]) -> int:
    """Remove those of the local files that exist; returns how many."""
    found = [p for p in paths if os.path.isfile(p)]
    for p in found:
        os.remove(p)
    return len(found)


def read_config(path: str) -> dict:
    """A local config file, or an empty one."""
    if not os.path.isfile(path):
        return {}
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def free_space(path: str) -> int:
    return shutil.disk_usage(path).free
