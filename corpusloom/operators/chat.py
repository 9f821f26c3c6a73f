"""Chat sessions, messages and their sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .. import schemas
from ..functions import text as X


def session_list(sessions: DataFrame, messages: DataFrame, limit: int = 50) -> DataFrame:
    """Sessions by last activity: message_count, last_message_at, and the second message as title, else the first."""
    order = F.row_number().over(W.partitionBy("session_id").orderBy("id"))
    ranked = messages.select("session_id", "id", "created_at", "content").withColumn("_n", order)
    nth = lambda k: F.max(F.when(F.col("_n") == k, F.col("content")))
    per = ranked.groupBy("session_id").agg(F.max("created_at").alias("last_message_at"), F.count("id").alias("message_count"), F.coalesce(nth(2), nth(1)).alias("title"))
    joined = sessions.join(per, "session_id", "left").withColumn("message_count", F.coalesce("message_count", F.lit(0)).cast("bigint"))
    return joined.orderBy(F.coalesce("last_message_at", "created_at").desc(), "session_id").limit(limit)


def latest_session(sessions: DataFrame) -> DataFrame:
    return sessions.orderBy(F.desc("created_at"), F.desc("session_id")).limit(1)


def session_messages(messages: DataFrame, session_id, limit: int | None = None) -> DataFrame:
    """Messages of one session by id; sources and images only where their JSON parses."""
    own = messages.where(F.col("session_id") == session_id)
    out = own.select("id", "created_at", "role", "content", F.from_json("sources_json", schemas.SOURCES_JSON).alias("sources"), F.from_json("images_json", schemas.IMAGES_JSON).alias("images")).orderBy("id")
    return out.limit(limit) if limit else out


def source_rows(messages: DataFrame) -> DataFrame:
    """A row for each source with a name or a path; a blank name reads ``(unknown)``."""
    each = messages.select(F.col("id").alias("message_id"), F.explode(F.from_json("sources_json", schemas.SOURCES_JSON)).alias("s"))
    name, path = X.pystrip(X.text_of("s.doc_name")), X.pystrip(X.text_of("s.doc_path"))
    return each.where((name != "") | (path != "")).select("message_id", F.when(name == "", "(unknown)").otherwise(name).alias("doc_name"), path.alias("doc_path"))


def insert_or_ignore(rows: DataFrame, stored: DataFrame, keys: tuple[str, ...], order: tuple[str, ...] = ()) -> DataFrame:
    """Rows whose keys aren't stored yet, the first of each key; a batch that is offered again gives none."""
    first = F.row_number().over(W.partitionBy(*keys).orderBy(*(order or keys)))
    fresh = rows.withColumn("_n", first).where(F.col("_n") == 1).drop("_n")
    known = stored.select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct()
    same = [fresh[k].eqNullSafe(known[f"_{k}"]) for k in keys]
    return fresh.join(known, same, "left_anti")


def document_usage(messages: DataFrame, sources: DataFrame) -> DataFrame:
    joined = messages.select(F.col("id").alias("message_id")).join(sources, "message_id")
    return joined.groupBy("doc_name", "doc_path").agg(F.count("*").alias("cnt")).orderBy(F.desc("cnt"), "doc_name", "doc_path")


def sessions_of_document(messages: DataFrame, sources: DataFrame, doc_name: str) -> DataFrame:
    """Sessions that cite a document, the one with the newest such message first."""
    hits = sources.where(F.col("doc_name") == doc_name).select("message_id")
    joined = messages.join(hits, messages.id == hits.message_id, "left_semi")
    return joined.groupBy("session_id").agg(F.max("id").alias("last_id")).orderBy(F.desc("last_id"))


def new_sessions(df: DataFrame) -> DataFrame:
    """Session ids and whole-second times for each row; the ids are random, so write the result once."""
    return df.withColumn("session_id", F.uuid()).withColumn("created_at", F.date_trunc("second", F.current_timestamp()))


def resolve_cited(messages: DataFrame, cited: DataFrame) -> DataFrame:
    """For each (session_id, doc) the source path of the newest assistant message that names the document."""
    each = messages.where(F.col("role") == "assistant").select("session_id", "id", F.explode(F.from_json("sources_json", schemas.SOURCES_JSON)).alias("s"))
    named = each.select("session_id", "id", F.lower(X.base_name(X.text_of("s.doc_name"))).alias("_key"), "s.doc_name", "s.doc_path")
    wanted = cited.withColumn("_key", F.lower(X.base_name(F.col("doc"))))
    newest = named.groupBy("session_id", "_key").agg(F.max_by(F.struct("doc_name", "doc_path"), "id").alias("s"))
    return wanted.join(newest, ["session_id", "_key"], "left").select("session_id", "doc", "s.doc_name", "s.doc_path")


def merge_maps(messages: DataFrame, map_col: str = "payload") -> DataFrame:
    """One entry a key over all messages of a session: that of the last message which has it."""
    each = messages.select("session_id", "id", F.explode(map_col).alias("key", "value"))
    return each.groupBy("session_id", "key").agg(F.max_by("value", "id").alias("value"))


def search(listing: DataFrame, query: str, columns: tuple[str, ...]) -> DataFrame:
    needle = query.strip().lower()
    hit: Column = F.lit(not needle)
    for c in columns:
        hit = hit | F.contains(F.lower(X.text_of(F.col(c).cast("string"))), F.lit(needle))
    return listing.where(hit)
