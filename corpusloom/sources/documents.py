"""Readers of raw documents, transcripts and stores. Conversion of PDF, DOCX and video stays outside; its output is read here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import text as X
from ..operators.ingest import EXTENSIONS
from ..plans.config import RetrievalConfig


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))


def discover(spark: SparkSession, folder: str) -> DataFrame:
    """(path, doc_name, ext, doc_size, modified) of all documents below a folder, in no order, without reading their bytes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select("path", X.base_name(F.col("path")).alias("doc_name"), extension(F.col("path")).alias("ext"), F.col("length").alias("doc_size"), F.col("modificationTime").alias("modified")).where(F.col("ext").isin(*EXTENSIONS))


def with_content(spark: SparkSession, folder: str) -> DataFrame:
    """``discover`` with the bytes and their SHA-256."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    rows = files.withColumn("ext", extension(F.col("path"))).where(F.col("ext").isin(*EXTENSIONS))
    return rows.select("path", X.base_name(F.col("path")).alias("doc_name"), "ext", F.col("length").alias("doc_size"), (F.unix_micros("modificationTime") * 1000).alias("doc_mtime_ns"), F.sha2("content", 256).alias("doc_fingerprint"), "content")


def decode_text(content: Column) -> Column:
    """UTF-8 text; bytes that aren't are dropped."""
    return F.translate(content.cast("string"), "\ufffd", "")


def read_texts(spark: SparkSession, folder: str) -> DataFrame:
    """(path, doc_name, text) of text files; undecodable bytes go."""
    files = spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").text(folder)
    rows = files.select(F.col("_metadata.file_path").alias("path"), F.translate("value", "�", "").alias("text"))
    return rows.select("path", X.base_name(F.col("path")).alias("doc_name"), "text").where(extension(F.col("path")).isin("txt", "md", "markdown"))


def dispatch(files: DataFrame) -> DataFrame:
    """``reader`` by extension; an unknown extension is an error when the row is read."""
    ext = extension(F.col("path"))
    plain = ("txt", "md", "markdown", "csv", "json", "log")
    reader = F.when(ext == "pdf", "pdf").when(ext == "docx", "docx").when(ext.isin(*plain), "text").otherwise(F.raise_error(F.concat(F.lit("unsupported extension: "), ext)))
    return files.withColumn("reader", reader)


def pages_of(rows: DataFrame, pages_col: str = "pages") -> DataFrame:
    """(doc_name, page_number from 1, text) of an array of page texts; blank pages go."""
    each = rows.select("doc_name", F.posexplode(pages_col).alias("_p", "text"))
    return each.where(X.pystrip(X.text_of("text")) != "").select("doc_name", (F.col("_p") + 1).alias("page_number"), "text")


def joined_pages(rows: DataFrame, parts_col: str = "pages", skip_blank: bool = False) -> DataFrame:
    """One text a document: its pages or paragraphs joined by line breaks."""
    parts = F.filter(parts_col, lambda p: X.pystrip(X.text_of(p)) != "") if skip_blank else F.col(parts_col)
    return rows.select("doc_name", F.array_join(parts, "\n", "").alias("text"))


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """Transcript segments of JSON files with a ``transcription`` array."""
    schema = "transcription array<struct<text:string,offsets:struct<`from`:bigint,`to`:bigint>>>"
    raw = spark.read.schema(schema).option("multiLine", "true").json(path).select(X.base_name(F.col("_metadata.file_path")).alias("doc_name"), "transcription")
    return raw.select("doc_name", F.posexplode("transcription").alias("seg_no", "s")).select("doc_name", F.col("seg_no").cast("bigint").alias("seg_no"), "s.text", "s.offsets")


def read_store(spark: SparkSession, path: str, tenants: list[str] | None = None) -> DataFrame:
    """A chunk store, partitioned by tenant and index; naming tenants prunes partitions. Columns that files lack are null."""
    rows = schemas.conform(spark.read.schema(schemas.CHUNK).parquet(path), schemas.CHUNK)
    return rows.where(F.col("tenant").isin(tenants)) if tenants is not None else rows


def open_store(spark: SparkSession, path: str, tenants: list[str] | None = None) -> tuple[DataFrame, RetrievalConfig]:
    """The chunks of all usable tenants, and the settings of the first of them by name.

    A tenant is usable if it has a config; its number of chunks must be the one that was written.
    """
    store = read_store(spark, path, tenants)
    facts = spark.read.schema("tenant string, key string, value string").parquet(path.rstrip("/") + "_config")
    told = facts.where(F.col("key") == "num_chunks").select("tenant", F.col("value").cast("bigint").alias("told"))
    state = store.groupBy("tenant").agg(F.count("*").alias("found")).join(told, "tenant")
    wrong = state.where("found <> told").orderBy("tenant").first()
    if wrong:
        raise ValueError(f"tenant {wrong.tenant} has {wrong.found} chunks, its config says {wrong.told}")
    first = state.agg(F.min("tenant")).first()[0]
    if first is None:
        raise FileNotFoundError(f"no usable tenant in {path}")
    own = {r.key: r.value for r in facts.where(F.col("tenant") == first).collect()}  # a few settings
    return store.join(told.select("tenant"), "tenant", "left_semi"), RetrievalConfig.of(own)


def tenants_of(store: DataFrame) -> DataFrame:
    return store.select("tenant").distinct().orderBy("tenant")


def read_images(spark: SparkSession, path: str) -> DataFrame:
    return schemas.conform(spark.read.schema(schemas.IMAGE).parquet(path), schemas.IMAGE)


def read_jdbc(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    """A table of a relational store; the driver's jar must be on the class path."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()
