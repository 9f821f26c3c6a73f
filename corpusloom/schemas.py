"""Fixed, nullable superset schemas of the engine's tables; readers fill what is missing with nulls."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK = (
    "tenant string, index_name string, vector_id bigint, doc_name string, doc_path string, doc_fingerprint string, doc_size bigint, doc_mtime_ns bigint, "
    "chunk_index bigint, text string, raw_content string, section_path array<string>, section_path_str string, is_table boolean, level_depth int, page_number bigint, "
    "chunk_type string, ingest_mode string, timestamp string, start_sec bigint, end_sec bigint, ground_id string, embedding array<float>"
)
IMAGE = "tenant string, image_uuid string, caption string, text string, image binary, image_mime string, doc_name string, doc_path string, image_index bigint, chunk_type string, vector_id bigint, doc_fingerprint string, doc_size bigint, doc_mtime_ns bigint, embedding array<float>"
SESSION = "session_id string, created_at timestamp"
MESSAGE = "id bigint, session_id string, created_at timestamp, role string, content string, sources_json string, images_json string"
MESSAGE_SOURCE = "id bigint, message_id bigint, doc_name string, doc_path string"
SEGMENT = "doc_name string, seg_no bigint, text string, offsets struct<`from`:bigint,`to`:bigint>"
SOURCES_JSON = "array<struct<doc_name:string,doc_path:string,page_number:bigint,timestamp:string,start_sec:bigint,end_sec:bigint>>"
IMAGES_JSON = "array<struct<image_uuid:string,caption:string,image_mime:string,doc_name:string>>"


def columns_of(ddl: str) -> list[tuple[str, str]]:
    """(name, type) pairs of a flat DDL string; types may hold commas inside brackets."""
    out, depth, start = [], 0, 0
    for i, c in enumerate(ddl + ","):
        depth += c in "<("
        depth -= c in ">)"
        if c == "," and depth == 0:
            name, kind = ddl[start:i].strip().split(" ", 1)
            out.append((name, kind))
            start = i + 1
    return out


def conform(df: DataFrame, ddl: str) -> DataFrame:
    """``df`` with exactly the columns of ``ddl``: missing ones null, others cast where the type differs."""
    have = set(df.columns)
    return df.select(*[(F.col(n).cast(t) if n in have else F.lit(None).cast(t)).alias(n) for n, t in columns_of(ddl)])
