"""Views of the test tables that stand for the engine's own: chunks, vectors, segments, messages. Each has its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .session import read_table
from .sources.shared import stash


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents; a line of fewer than 40 characters is a section title."""
    rows = read_table(spark, sf_dir, "documents").select(F.col("source").alias("tenant"), "doc_id", F.posexplode(F.split("text", "\n")).alias("chunk_index", "text"))
    short = F.when(F.char_length("text") < 40, F.col("text"))
    return rows.select("tenant", "doc_id", F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("doc_name"), F.col("chunk_index").cast("bigint").alias("chunk_index"), "text", short.alias("section_path_str"), (F.floor(F.col("chunk_index") / 3) + 1).cast("bigint").alias("page_number"), (F.col("doc_id") * 100000 + F.col("chunk_index")).alias("vector_id"))


CHUNKS = """f_chunk AS (SELECT source AS tenant, doc_id, 'doc_'||doc_id AS doc_name, (i-1)::BIGINT AS chunk_index, parts[i] AS text,
  CASE WHEN length(parts[i]) < 40 THEN parts[i] END AS section_path_str, ((i-1)//3+1)::BIGINT AS page_number, doc_id*100000+i-1 AS vector_id
  FROM (SELECT *, string_split(text, chr(10)) AS parts FROM documents), unnest(generate_series(1, len(parts))) t(i))"""


def titled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks of documents whose names say what they are about, as manuals' names do."""
    return chunks(spark, sf_dir).withColumn("doc_name", F.concat(F.lit("Vacuum_pump-"), F.col("tenant"), F.lit(" "), F.col("doc_id").cast("string"), F.lit(".pdf")))


TITLED = CHUNKS.replace("'doc_'||doc_id AS doc_name", "'Vacuum_pump-'||source||' '||doc_id||'.pdf' AS doc_name")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their vector, one chunk each."""
    return _with_vectors(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "embeddings"))


def stored_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``vectors`` written once, as an engine's store is, in files of like size wherever documents lie (the join is a shuffle).

    Documents outside the vectors' range of ids, which have none, don't come to the join.
    """
    docs, vecs = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "embeddings")
    ends = vecs.agg(F.min("vec_id").alias("low"), F.max("vec_id").alias("high")).first()
    return stash(_with_vectors(docs.where(F.col("doc_id").between(ends.low, ends.high)), vecs.hint("merge")), "chunks")


def _with_vectors(docs: DataFrame, vecs: DataFrame) -> DataFrame:
    joined = docs.join(vecs, docs.doc_id == vecs.vec_id)
    title = F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("Model "), F.col("lang"))).when(F.col("doc_id") % 7 == 1, F.lit("Technical specifications")).otherwise(F.left("text", F.lit(30)))
    return joined.select(F.col("source").alias("tenant"), F.concat(F.lit("doc_"), (F.col("doc_id") % 50).cast("string")).alias("doc_name"), F.floor(F.col("doc_id") / 50).cast("bigint").alias("chunk_index"), F.col("doc_id").alias("vector_id"), "text", title.alias("section_path_str"), F.lit(1).cast("bigint").alias("page_number"), "embedding")


VECTORS = """f_vec AS (SELECT source AS tenant, 'doc_'||(doc_id%50) AS doc_name, doc_id//50 AS chunk_index, doc_id AS vector_id, text,
  CASE WHEN doc_id%7=0 THEN 'Model '||lang WHEN doc_id%7=1 THEN 'Technical specifications' ELSE left(text,30) END AS section_path_str, 1::BIGINT AS page_number, embedding
  FROM documents JOIN embeddings ON doc_id=vec_id)"""


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as transcript segments: times are milliseconds since the user's first event."""
    e = read_table(spark, sf_dir, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    start = F.floor((F.col("us") - F.min("us").over(W.partitionBy("user_id"))) / 1000)
    return e.select(F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("doc_name"), F.col("event_id").alias("seg_no"), F.col("event_type").alias("text"), F.struct(start.alias("from"), (start + 900).alias("to")).alias("offsets"))


SEGMENTS = """f_segment AS (SELECT 'user_'||user_id AS doc_name, event_id AS seg_no, event_type AS text,
  (epoch_us(ts::TIMESTAMP) - min(epoch_us(ts::TIMESTAMP)) OVER (PARTITION BY user_id))//1000 AS t_from FROM events)"""


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "conversations")
    return rows.select(F.col("conv_id").alias("session_id"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("turn").alias("created_at"), "role", F.col("text").alias("content"))


MESSAGES = "f_message AS (SELECT conv_id AS session_id, conv_id*1000+turn AS id, turn AS created_at, role, text AS content FROM conversations)"


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages(spark, sf_dir).select("session_id").distinct().withColumn("created_at", F.lit(0).cast("bigint"))


def message_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source for each assistant message: one of ten documents."""
    own = messages(spark, sf_dir).where(F.col("role") == "assistant")
    return own.select(F.col("id").alias("message_id"), F.concat(F.lit("doc_"), (F.col("id") % 10).cast("string")).alias("doc_name"), F.concat(F.lit("/d/"), (F.col("id") % 10).cast("string")).alias("doc_path"))


SOURCES = "f_source AS (SELECT id AS message_id, 'doc_'||(id%10) AS doc_name, '/d/'||(id%10) AS doc_path FROM f_message WHERE role='assistant')"


def stored(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(rows of an older store, current listing): a third of documents new, one in ten changed, some without fingerprint."""
    docs = read_table(spark, sf_dir, "documents")
    name = F.concat(F.lit("doc_"), F.col("doc_id").cast("string"))
    listing = docs.select(name.alias("doc_name"), F.sha2(F.col("text").cast("binary"), 256).alias("doc_fingerprint"))
    fp = F.when(F.col("doc_id") % 10 == 1, "changed").when(F.col("doc_id") % 10 == 2, None).otherwise(F.sha2(F.col("text").cast("binary"), 256))
    old = docs.where(F.col("doc_id") % 3 != 0).select(name.alias("doc_name"), fp.alias("doc_fingerprint"), F.when(F.col("doc_id") % 11 == 0, F.concat(F.lit("x data:image/png;base64,AA"), F.col("text"))).otherwise(F.col("text")).alias("text"))
    return old, listing


STORED = """f_list AS (SELECT 'doc_'||doc_id AS doc_name, sha256(text) AS fp, doc_id, text FROM documents),
f_plan AS (SELECT doc_name, CASE WHEN doc_id%3<>0 AND doc_id%11<>0 AND doc_id%10<>1 AND NOT contains(lower(text), 'data:image/') THEN 'keep' ELSE 'process' END AS action FROM f_list)"""


def marked_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as Markdown: the whole text in halves, a heading a page, the second page after a page break, a blank page between."""
    docs = read_table(spark, sf_dir, "documents")
    half = F.floor(F.char_length("text") / 2).cast("int")
    half += F.char_length(F.regexp_extract(F.substr("text", half + 1), r"^[\s#]*", 0))  # no mark inside a line becomes a heading
    head = F.concat(F.lit("# Title "), F.col("doc_id").cast("string"), F.lit("\n\n"), F.left("text", half))
    tail = F.concat(F.lit("## Part "), F.col("lang"), F.lit("\n"), F.substr("text", half + 1))
    brk = F.lit("\n<!-- page break -->\n")
    return docs.select(F.col("doc_id"), F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("doc_name"), F.concat(head, brk, F.lit("  "), brk, tail).alias("md"))
