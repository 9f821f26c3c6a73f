"""Incremental ingestion: what to keep, what to process, and changes to the store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import text as X

EXTENSIONS = ("pdf", "docx", "txt", "md", "markdown", "mp4")


def fingerprint(df: DataFrame, content_col: str = "content") -> DataFrame:
    return df.withColumn("doc_fingerprint", F.sha2(F.col(content_col).cast("binary"), 256))


def incremental_plan(rows: DataFrame, listing: DataFrame, keys: tuple[str, ...] = ("doc_name",)) -> DataFrame:
    """``listing`` (keys, doc_fingerprint) with ``action``: keep or process.

    A document is kept if it has rows, all with its fingerprint or, as in old stores, none, and none of
    them holds an embedded image payload.
    """
    fp = F.nullif(X.text_of("doc_fingerprint"), F.lit(""))
    old = rows.groupBy(*keys).agg(F.collect_set(fp).alias("_fps"), F.bool_or(F.contains(F.lower(X.text_of("text")), F.lit("data:image/"))).alias("_payload"))
    joined = listing.join(old, list(keys), "left")
    fits = (F.size("_fps") == 0) | ((F.size("_fps") == 1) & F.array_contains("_fps", F.col("doc_fingerprint")))
    keep = F.coalesce(fits & ~F.col("_payload"), F.lit(False))
    return joined.withColumn("action", F.when(keep, "keep").otherwise("process")).drop("_fps", "_payload")


def kept_rows(rows: DataFrame, plan: DataFrame, keys: tuple[str, ...] = ("doc_name",)) -> DataFrame:
    """Rows of kept documents; those of documents no longer listed go."""
    return rows.join(plan.where(F.col("action") == "keep").select(*keys), list(keys), "left_semi")


def merge(kept: DataFrame, new: DataFrame) -> DataFrame:
    return kept.unionByName(new, allowMissingColumns=True)


def delete_document(rows: DataFrame, doc_name: str, tenant: str | None = None) -> DataFrame:
    gone = F.col("doc_name").eqNullSafe(F.lit(doc_name))
    if tenant is not None:
        gone = gone & F.col("tenant").eqNullSafe(F.lit(tenant))
    return rows.where(~gone)


def accept_uploads(uploads: DataFrame, existing: DataFrame) -> DataFrame:
    """``uploads`` (tenant, name) with ``saved``: not blank, of an allowed extension, and new; of equal names the first."""
    ext = F.lower(F.regexp_extract("name", r"\.([^.]+)$", 1))
    there = existing.select("tenant", "name").distinct().withColumn("_there", F.lit(True))
    rows = uploads.join(there, ["tenant", "name"], "left")
    fine = (X.pystrip(X.text_of("name")) != "") & ext.isin(*EXTENSIONS) & F.col("_there").isNull()
    order = F.row_number().over(W.partitionBy("tenant", "name").orderBy(*[c for c in uploads.columns if c not in ("tenant", "name")] or ["name"]))
    return rows.withColumn("saved", fine & (order == 1)).drop("_there")


def ingest_status(processed: DataFrame) -> DataFrame:
    """(doc_name, status, chunks, mode, error): one row a document."""
    return processed.groupBy("doc_name").agg(
        F.when(F.max("error").isNotNull(), "failed").otherwise("completed").alias("status"),
        F.count("chunk_index").alias("chunks"),
        F.max("ingest_mode").alias("mode"),
        F.max("error").alias("error"),
    )


def parse_status(raw: DataFrame, col: str = "json") -> DataFrame:
    """Rows of a status file's ``documents`` map; text that isn't JSON gives none."""
    schema = "updated_at string, documents map<string, struct<status:string,chunks:bigint,mode:string,error:string>>"
    parsed = raw.select(F.from_json(col, schema).alias("s"))
    return parsed.select(F.col("s.updated_at").alias("updated_at"), F.explode("s.documents").alias("doc_name", "v")).select("updated_at", "doc_name", "v.status", "v.chunks", "v.mode", "v.error")


def usage_statistics(plan: DataFrame, chunks: DataFrame) -> DataFrame:
    docs = plan.agg(F.count("*").alias("docs_total"), F.count_if(F.col("action") == "process").alias("docs_processed"), F.count_if(F.col("action") == "keep").alias("docs_reused"))
    return docs.join(chunks.agg(F.count("*").alias("num_chunks"), F.max(F.size("embedding")).alias("dim")))  # one row each


def stale_bundles(files: DataFrame, states: DataFrame, prefix: str) -> DataFrame:
    """Export files with the prefix that no building or ready export names."""
    protected = states.where(F.col("state").isin("building", "ready")).select(F.col("zip_path").alias("path"))
    return files.where(F.startswith(X.text_of(F.element_at(F.split("path", "/"), -1)), F.lit(prefix))).join(protected, "path", "left_anti")


def queue_positions(queue: DataFrame) -> DataFrame:
    """A FIFO of exports; few rows, numbered in one place."""
    return queue.withColumn("ordinal", F.row_number().over(W.orderBy("position")))


def upsert_states(states: DataFrame, changes: DataFrame) -> DataFrame:
    """Last change of each slug wins; ``seq`` orders changes, states have 0."""
    every = states.withColumn("seq", F.lit(0).cast("bigint")).unionByName(changes, allowMissingColumns=True)
    value = F.struct(*[c for c in every.columns if c not in ("slug", "seq")])
    return every.groupBy("slug").agg(F.max_by(value, "seq").alias("v")).select("slug", "v.*")


def export_transition(states: DataFrame) -> DataFrame:
    """The next state of each export: one slot, first come first served."""
    busy = F.bool_or(F.col("state").isin("building", "ready")).over(W.partitionBy(F.lit(1)))
    first = F.min(F.when(F.col("state") == "queued", F.col("position"))).over(W.partitionBy(F.lit(1)))
    return states.withColumn("next_state", F.when((F.col("state") == "queued") & ~busy & (F.col("position") == first), "building").otherwise(F.col("state")))


def password_policy(users: DataFrame, col: str = "password") -> DataFrame:
    c = F.col(col)
    return users.withColumn("accepted", (F.char_length(c) >= 8) & F.rlike(c, F.lit("[A-Za-z]")) & F.rlike(c, F.lit("[0-9]")) & F.rlike(c, F.lit("[^A-Za-z0-9]")))


def labelled_uuid(df: DataFrame, col: str) -> DataFrame:
    return df.withColumn(col, F.uuid())
