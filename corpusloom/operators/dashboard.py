"""Ingestion dashboards: document states, key figures, listings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import text as X


def document_states(files: DataFrame, indexed: DataFrame, reported: DataFrame, running: DataFrame) -> DataFrame:
    """``files`` (tenant, name) with ``status``.

    ``indexed`` has (tenant, name), ``reported`` (tenant, name, status), ``running`` (tenant, current): tenants being ingested.
    """
    rows = files.join(indexed.select("tenant", "name").distinct().withColumn("_indexed", F.lit(True)), ["tenant", "name"], "left")
    rows = rows.join(reported.groupBy("tenant", "name").agg(F.max("status").alias("_reported")), ["tenant", "name"], "left")
    rows = rows.join(running.withColumn("_running", F.lit(True)), "tenant", "left")
    done = F.coalesce("_indexed", F.lit(False))
    status = (
        F.when(F.col("_running") & ((F.col("name") == F.col("current")) | ~done), "In progress")
        .when(F.col("_running") | done, "Completed")
        .when(F.lower("_reported") == "failed", "Failed")
        .otherwise("Uploaded")
    )
    return rows.select("tenant", "name", status.alias("status")).orderBy("tenant", "name")


def with_completed(listing: DataFrame, completed: DataFrame) -> DataFrame:
    """Rows whose key was completed since the listing was read show as completed."""
    done = completed.select("tenant", "name").distinct().withColumn("_done", F.lit(True))
    return listing.join(done, ["tenant", "name"], "left").withColumn("status", F.when(F.col("_done"), "Completed").otherwise(F.col("status"))).drop("_done")


def kpis(listing: DataFrame) -> DataFrame:
    """One row of counts, the share completed (halves round up), and units of work."""
    is_ = lambda s: F.count_if(F.col("status") == s)
    total = F.count("*")
    base = listing.agg(total.alias("total"), is_("Completed").alias("completed"), is_("In progress").alias("in_progress"), is_("Failed").alias("failed"))
    share = F.when(F.col("total") == 0, 0).otherwise(F.floor(100.0 * F.col("completed") / F.col("total") + 0.5)).cast("bigint")
    units = F.greatest(F.lit(100), 22 * F.col("total") + 12 * F.col("completed")).cast("bigint")
    return base.select("*", (F.col("total") - F.col("completed") - F.col("in_progress") - F.col("failed")).alias("uploaded"), share.alias("completed_pct"), units.alias("units"))


def tenant_progress(listing: DataFrame) -> DataFrame:
    counted = listing.groupBy("tenant").agg(F.count("*").alias("total"), F.count_if(F.col("status") == "Completed").alias("completed"))
    return counted.withColumn("completed_pct", F.floor(100.0 * F.col("completed") / F.col("total") + 0.5).cast("bigint"))


def search_listing(listing: DataFrame, query: str) -> DataFrame:
    """A tenant whose name matches shows all its files; others show the files that match."""
    needle = F.lit(query.strip().lower())
    return listing.where((needle == "") | F.contains(F.lower("tenant"), needle) | F.contains(F.lower("name"), needle))


def page(listing: DataFrame, number: int, size: int, *order: str) -> DataFrame:
    return listing.orderBy(*order).offset(max(0, number - 1) * size).limit(size)


def pager_tokens(current: int, pages: int) -> list[str]:
    """Labels of a pager: all of up to seven pages, else the ends and the neighbourhood of the current one."""
    if pages <= 7:
        return [str(i) for i in range(1, pages + 1)]
    near = sorted({1, pages, *(i for i in (current - 1, current, current + 1) if 1 <= i <= pages)})
    out: list[str] = []
    for before, i in zip([0, *near], near, strict=False):
        if i - before > 1:
            out.append("…")
        out.append(str(i))
    return out


def document_index(files: DataFrame) -> DataFrame:
    """(key, tenant, path): of equal lower-cased names the first tenant's."""
    key = F.lower(X.base_name(F.col("path")))
    ranked = files.withColumn("key", key).withColumn("_n", F.row_number().over(W.partitionBy("key").orderBy("tenant", "path")))
    return ranked.where(F.col("_n") == 1).select("key", "tenant", "path")


def resolve_paths(wanted: DataFrame, index: DataFrame, chunks: DataFrame) -> DataFrame:
    """``path`` for (doc_name, doc_path): by name, by base name, then the stored path, then the path a chunk of that name has."""
    rows = wanted.withColumn("_name", F.lower(X.text_of("doc_name"))).withColumn("_base", F.lower(X.base_name(X.text_of("doc_name"))))
    by = lambda c: index.select(F.col("key").alias(c), F.col("path").alias(f"{c}_path"))
    stored = chunks.where(X.text_of("doc_path") != "").groupBy("doc_name").agg(F.min("doc_path").alias("_chunk_path"))
    rows = rows.join(by("_name"), "_name", "left").join(by("_base"), "_base", "left").join(stored, "doc_name", "left")
    path = F.coalesce("_name_path", "_base_path", F.nullif(F.col("doc_path"), F.lit("")), "_chunk_path")
    return rows.select("doc_name", "doc_path", path.alias("path"))


def latest_tenant(tenants: DataFrame) -> DataFrame:
    return tenants.agg(F.max_by("tenant", F.struct("mtime", "tenant")).alias("tenant"))


def indexed_names(chunks: DataFrame) -> DataFrame:
    name = X.pystrip(X.text_of("doc_name"))
    return chunks.select("tenant", name.alias("name")).where(F.col("name") != "").distinct()
