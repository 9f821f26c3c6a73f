"""Markdown and transcripts to chunk rows, section context, and windows for grouping chunks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import text as X
from ..sources.shared import stash
from .scans import PART, in_parts, running


def chunk_array(text: Column, size: int, overlap: int) -> Column:
    """Chunks of at most ``size`` characters, in order.

    Paragraphs (split at blank lines) are joined while they fit. One that is longer by itself is cut
    into slices that overlap; its tail is a chunk of its own, nothing is joined to it.
    """
    if size <= 0 or not 0 <= overlap < size:
        raise ValueError("size must be positive, and overlap from 0 up to below size")
    flat = X.pystrip(F.regexp_replace(X.text_of(text), r"\r\n?", "\n"))
    paragraphs = F.filter(F.transform(F.split(flat, "\n\n"), X.pystrip), lambda p: p != "")
    empty = F.array().cast("array<string>")
    start = F.struct(empty.alias("done"), F.lit("").alias("open"))

    def slices(p: Column) -> Column:
        # a slice starts only where the one before did not reach the end
        last = F.greatest(F.lit(0), F.char_length(p) - overlap - 1)
        starts = F.sequence(F.lit(0), last.cast("int"), F.lit(size - overlap))
        return F.filter(F.transform(starts, lambda i: X.pystrip(F.substring(p, i + 1, F.lit(size)))), lambda x: x != "")

    def flushed(state: Column) -> Column:
        return F.when(state["open"] != "", F.array_append(state["done"], state["open"])).otherwise(state["done"])

    def step(state: Column, p: Column) -> Column:
        fits = F.char_length(state["open"]) + F.char_length(p) + 2 <= size
        joined = F.when(state["open"] == "", p).otherwise(F.concat(state["open"], F.lit("\n\n"), p))
        too_long = F.char_length(p) > size
        return (
            F.when(fits, F.struct(state["done"].alias("done"), joined.alias("open")))
            .when(too_long, F.struct(F.concat(flushed(state), slices(p)).alias("done"), F.lit("").alias("open")))
            .otherwise(F.struct(flushed(state).alias("done"), p.alias("open")))
        )

    def chunks(ps: Column) -> Column:
        short = lambda joined: F.when(F.char_length(joined) <= size, F.when(joined == "", empty).otherwise(F.array(joined)))
        # what fits as a whole needs no fold
        return F.coalesce(X.bind(F.array_join(ps, "\n\n"), short), F.aggregate(ps, start, step, flushed))

    return X.bind(paragraphs, chunks)


def chunk_markdown(docs: DataFrame, size: int = 1200, overlap: int = 150, md_col: str = "md") -> DataFrame:
    """Pages at the page placeholder (numbered from 1, blank ones keep their number), sections before headings, then chunks.

    Adds content, page_number, section_heading, chunk_type and chunk_index, the place in the document.
    """
    keep = [c for c in docs.columns if c != md_col]
    pages = docs.withColumn("_md", X.strip_embedded_images(X.text_of(md_col))).select(*keep, F.posexplode(F.split("_md", X.PAGE_BREAK)).alias("_page", "_text"))
    sections = pages.select(*keep, "_page", F.posexplode(F.when(F.contains("_text", F.lit("#")), F.split(X.pystrip(F.col("_text")), r"(?m)^(?=#{1,6}\s+\S)")).otherwise(F.array("_text"))).alias("_sec", "_section"))
    sections = sections.withColumn("_section", X.pystrip(F.col("_section"))).where(F.col("_section") != "")
    pieces = sections.withColumn("section_heading", X.first_heading(F.col("_section"))).select(*keep, "_page", "_sec", "section_heading", F.posexplode(chunk_array(F.col("_section"), size, overlap) if size > 0 else F.array("_section")).alias("_piece", "content"))
    order = F.struct("_page", "_sec", "_piece")
    numbered = pieces.withColumn("chunk_index", F.row_number().over(W.partitionBy(*keep).orderBy(order)).cast("bigint") - 1) if keep else pieces.withColumn("chunk_index", F.lit(None).cast("bigint"))
    return numbered.select(*keep, "chunk_index", "content", (F.col("_page") + 1).cast("bigint").alias("page_number"), "section_heading", F.lit("markdown").alias("chunk_type"))


def chunk_rows(chunks: DataFrame, ingest_mode: str = "markdown") -> DataFrame:
    """Chunk-table rows of chunked Markdown: text to embed, section path, table flag."""
    heading = X.text_of("section_heading")
    return chunks.select(
        *[c for c in chunks.columns if c not in ("content", "section_heading")],
        X.embedding_text(heading, F.col("content")).alias("text"),
        F.col("content").alias("raw_content"),
        F.when(heading != "", F.array(heading)).otherwise(F.array().cast("array<string>")).alias("section_path"),
        heading.alias("section_path_str"),
        X.is_table(F.col("content")).alias("is_table"),
        F.lit(0).alias("level_depth"),
        F.lit(ingest_mode).alias("ingest_mode"),
    )


def forward_fill_sections(chunks: DataFrame, doc_cols: tuple[str, ...] = ("doc_name",), order_col: str = "chunk_index", parts: int | None = None) -> DataFrame:
    """Rows without a section take the last one of their document, and its path goes before their text unless they start with it.

    A document may lie in several tasks; the section that is open where one ends is carried to the next.
    """
    parts = parts or int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = in_parts(chunks.withColumn("_own", X.pystrip(X.text_of("section_path_str"))), doc_cols, order_col, parts)
    filled = running(ranged, doc_cols, order_col, lasts={"_path": F.nullif("_own", F.lit(""))}).drop(PART)
    raw = F.coalesce("raw_content", "text") if "raw_content" in chunks.columns else F.col("text")
    inherits = (F.col("_own") == "") & F.col("_path").isNotNull()
    repeats = X.first_line_plain(X.text_of(raw)) == F.lower(F.col("_path"))
    out = filled.withColumn("text", F.when(inherits & ~repeats, F.concat("_path", F.lit("\n\n"), X.text_of("text"))).otherwise(F.col("text")))
    if "section_path" in chunks.columns:
        out = out.withColumn("section_path", F.when(inherits, F.array("_path")).otherwise(F.col("section_path")))
    return out.withColumn("section_path_str", F.coalesce("_path", F.col("section_path_str"))).drop("_own", "_path")


def minute_buckets(segments: DataFrame, keys: tuple[str, ...] = ("doc_name",)) -> DataFrame:
    """Transcript segments in windows of 60 seconds; texts are joined in input order (``seg_no``)."""
    start = F.greatest(F.lit(0).cast("bigint"), F.col("offsets.from"))
    rows = segments.where((X.pystrip(X.text_of("text")) != "") & F.col("offsets.from").isNotNull() & F.col("offsets.to").isNotNull())
    rows = rows.withColumn("_bucket", F.floor(start / 60000).cast("bigint"))
    grouped = rows.groupBy(*keys, "_bucket").agg(F.array_sort(F.collect_list(F.struct("seg_no", X.pystrip(F.col("text")).alias("t")))).alias("_parts"))
    begin = F.col("_bucket") * 60
    return grouped.select(
        *keys,
        F.array_join(F.transform("_parts", lambda p: p["t"]), " ").alias("content"),
        (F.col("_bucket") + 1).alias("page_number"),
        X.range_label(begin, begin + 60).alias("timestamp"),
        begin.alias("start_sec"),
        (begin + 60).alias("end_sec"),
        F.lit("video_segment").alias("chunk_type"),
    )


def renumber(chunks: DataFrame, order: tuple[str, ...] = ("tenant", "vector_id"), buckets: int = 64) -> DataFrame:
    """``vector_id`` dense from 0 in the order given.

    Rows are range-partitioned and numbered within a part; only the sizes of parts are added up in one
    place, so that no task sees all rows.
    """
    ranged = chunks.repartitionByRange(buckets, *order).withColumn("_part", F.spark_partition_id())
    ranged = stash(ranged, "renumber")  # the part of a row must be the same when it is counted and when it is numbered
    before = ranged.groupBy("_part").agg(F.count("*").alias("_n")).withColumn("_before", F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)))
    local = F.row_number().over(W.partitionBy("_part").orderBy(*order)) - 1
    numbered = ranged.withColumn("_local", local).join(F.broadcast(before.select("_part", "_before")), "_part")  # one row a part
    return numbered.withColumn("vector_id", (F.coalesce("_before", F.lit(0)) + F.col("_local")).cast("bigint")).drop("_part", "_local", "_before")


# ---------------------------------------------------------------- windows and ground ids


def ground_windows(rows: DataFrame, size: int = 100, overlap: int = 10) -> DataFrame:
    """(start_i, end_i, vector_id, section path) of sliding windows over ``pos`` (dense from 0 in a document).

    Windows start every ``size - overlap`` rows and stop with the first that reaches the end.
    """
    step = size - overlap
    rows, n = rows.withColumn("_n", F.max("pos").over(W.partitionBy("doc_name")) + 1), F.col("_n")
    newest = F.floor(F.col("pos") / step)
    last = F.greatest(F.lit(0), F.ceil((n - size) / step))
    starts = F.array(newest, newest - 1)
    valid = F.filter(starts, lambda k: (k >= 0) & (k <= last) & (F.col("pos") < k * step + size))
    return rows.withColumn("_k", F.explode(valid)).withColumn("start_i", F.col("_k") * step).withColumn("end_i", F.least(F.col("start_i") + size, n)).drop("_k", "_n")


def section_pairs(chunks: DataFrame) -> DataFrame:
    """(doc_name, vector_id, path): the path, or the joined section list where it is missing."""
    joined = F.array_join(F.coalesce("section_path", F.array().cast("array<string>")), " > ")
    return chunks.select("doc_name", "vector_id", F.coalesce(F.nullif(X.pystrip(X.text_of("section_path_str")), F.lit("")), joined).alias("path"))


def window_listing(windows: DataFrame) -> DataFrame:
    """One sorted listing ``id: path`` a window."""
    listing = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("vector_id", "path"))), lambda r: F.concat(r["vector_id"].cast("string"), F.lit(": "), r["path"])), "\n")
    return windows.groupBy("doc_name", "start_i", "end_i").agg(listing.alias("listing"), F.count("*").alias("n"))


def parse_assignments(replies: DataFrame, expected: DataFrame) -> DataFrame:
    """(doc_name, start_i, end_i, vector_id, label) from a model's JSON reply a window.

    Fences and text around the outermost braces go; labels keep letters, digits and underscores; what is
    missing is ``missing_<id>``, but id 0 copies id 1 where only 0 is missing.
    """
    keys = ["doc_name", "start_i", "end_i"]
    bare = F.regexp_extract(X.text_of("reply"), r"(?s)\{.*\}", 0)
    entries = F.map_entries(F.coalesce(F.from_json(F.coalesce(F.get_json_object(bare, "$.assignments"), bare), "map<string,string>"), F.from_json(F.lit("{}"), "map<string,string>")))
    given = replies.select(*keys, F.explode(entries).alias("e")).select(*keys, F.col("e.key").try_cast("bigint").alias("vector_id"), F.regexp_replace(F.regexp_replace(X.pystrip(F.col("e.value")), "[^a-zA-Z0-9_]+", "_"), "^_+|_+$", "").alias("label"))
    given = given.where((F.col("label") != "") & F.col("vector_id").isNotNull()).groupBy(*keys, "vector_id").agg(F.max("label").alias("label"))
    rows = expected.select(*keys, "vector_id").join(given, [*keys, "vector_id"], "left")
    own = W.partitionBy(*keys)
    missing = F.sum(F.col("label").isNull().cast("int")).over(own)
    one = F.max(F.when(F.col("vector_id") == 1, F.col("label"))).over(own)
    copied = F.when((F.col("vector_id") == 0) & (missing == 1), one)
    return rows.withColumn("label", F.coalesce("label", copied, F.concat(F.lit("missing_"), F.col("vector_id").cast("string"))))


def merge_windows(assigned: DataFrame, rows: DataFrame) -> DataFrame:
    """One label a row: the window that starts later wins; rows in none are singletons."""
    best = assigned.groupBy("doc_name", "vector_id").agg(F.max_by("label", F.struct("start_i", "end_i")).alias("label"))
    return rows.join(best, ["doc_name", "vector_id"], "left").withColumn("label", F.coalesce("label", F.concat(F.lit("singleton_"), F.col("vector_id").cast("string"))))


def ground_ids(labelled: DataFrame, prefix: Column | None = None) -> DataFrame:
    """Labels of a document in the order of their first row become ``<prefix>ground-<i>``."""
    first = labelled.groupBy("doc_name", "label").agg(F.min("vector_id").alias("_first"))
    name = prefix if prefix is not None else F.concat(X.slug(F.regexp_replace(F.col("doc_name"), r"(?<=.)\.[^.]*$", ""), "doc"), F.lit("-"))
    numbered = first.withColumn("ground_id", F.concat(name, F.lit("ground-"), (F.dense_rank().over(W.partitionBy("doc_name").orderBy("_first")) - 1).cast("string")))
    return labelled.join(numbered.select("doc_name", "label", "ground_id"), ["doc_name", "label"])


def ground_id_counts(rows: DataFrame, keys: tuple[str, ...] = ("doc_name",)) -> DataFrame:
    """How many distinct ground ids each document has; rows without one count as none."""
    return rows.groupBy(*keys).agg(F.count_distinct("ground_id").alias("ground_ids"))


def split_batches(windows: DataFrame, n: int, order: str = "start_i") -> DataFrame:
    return windows.withColumn("batch", F.ntile(n).over(W.partitionBy("doc_name").orderBy(order)) - 1)


def head_then_rest(ranked: DataFrame, first: int = 2, following: int = 5, rank_col: str = "rank") -> DataFrame:
    """``batch`` of each row by its rank from 1: the head, then batches of equal size; a head or size of 0 means one batch."""
    if first <= 0 or following <= 0:
        return ranked.withColumn("batch", F.lit(0).cast("bigint"))
    return ranked.withColumn("batch", F.when(F.col(rank_col) <= first, F.lit(0)).otherwise(1 + F.floor((F.col(rank_col) - first - 1) / following)).cast("bigint"))


# ---------------------------------------------------------------- section stack and block chunks

HEADING = r"^((?:\d+\.?)+)\s+(.+)$"


def numeric_heading(line: Column) -> Column:
    """struct(number, title, level), or null: plain numbers above 15 and titles of more than 12 words are no headings."""
    flat = X.pystrip(X.text_of(line))
    number, title = F.regexp_extract(flat, HEADING, 1), F.regexp_extract(flat, HEADING, 2)
    plain = ~F.contains(number, F.lit("."))
    bad = (number == "") | (plain & (number.try_cast("bigint") > 15)) | (F.size(F.split(X.squeeze(title), " ")) > 12)
    level = F.size(F.filter(F.split(number, r"\."), lambda x: x != ""))
    return F.when(~bad, F.struct(F.regexp_replace(number, r"\.$", "").alias("number"), title.alias("title"), level.alias("level")))


def section_stack(blocks: DataFrame, parts: int | None = None) -> DataFrame:
    """``section_path`` of each block (doc_name, block_no, content): parents up to the heading's level, and itself.

    A heading of level L keeps the first L - 1 entries of the path and adds itself, so with the i-th
    heading the path has min(length before, L - 1) + 1 entries, which is i + min(0, least L_j - j so far).
    Its p-th entry is the last heading that ended a path of p entries. All of these are running values,
    so a document may lie in any number of tasks. There is a running value for each length that occurs.
    """
    key, at = ("doc_name",), "block_no"
    parts = parts or int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = in_parts(blocks.select("doc_name", "block_no", "content").withColumn("_h", numeric_heading(F.col("content"))), key, at, parts)
    counted = running(ranged, key, at, sums={"_i": F.col("_h").isNotNull().cast("long")})
    counted = running(counted, key, at, mins={"_least": F.when(F.col("_h").isNotNull(), F.col("_h.level") - F.col("_i"))})
    rows = stash(counted.withColumn("_depth", F.col("_i") + F.least(F.lit(0), F.coalesce("_least", F.lit(0)))), "depths")
    deepest = rows.agg(F.max("_depth")).first()[0] or 0
    entry = F.concat(F.lit("Section "), F.col("_h.number"), F.lit(" "), F.col("_h.title"))
    ends = {f"_p{p}": F.when(F.col("_h").isNotNull() & (F.col("_depth") == p), entry) for p in range(1, deepest + 1)}
    found = running(rows, key, at, lasts=ends) if ends else rows
    path = F.slice(F.array(*ends).cast("array<string>"), F.lit(1), F.col("_depth").cast("int"))
    return found.select("doc_name", "block_no", "content", F.col("_h").isNotNull().alias("is_heading"), path.alias("section_path"), F.array_join(path, " > ").alias("section_path_str"))


def block_chunks(blocks: DataFrame, size: int = 1200) -> DataFrame:
    """Chunks of typed blocks (doc_name, block_no, type, content, page_number), one document at a time.

    Paragraphs are joined by a blank until a heading, a table or the size ends them; headings and tables are chunks of their own.
    """
    located = section_stack(blocks).join(blocks.select("doc_name", "block_no", "type", "page_number"), ["doc_name", "block_no"])

    def per_document(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in it:
            out, held = [], None
            for r in frame.sort_values("block_no").itertuples():
                alone = r.is_heading or r.type == "table"
                joins = held is not None and not alone and held["section_path_str"] == r.section_path_str and len(held["text"]) + 1 + len(r.content) <= size
                if joins:
                    held["text"] += " " + r.content
                    continue
                if held is not None:
                    out.append(held)
                held = {"doc_name": r.doc_name, "text": r.content, "section_path_str": r.section_path_str, "page_number": r.page_number, "chunk_type": "heading" if r.is_heading else r.type}
                if alone:
                    out.append(held)
                    held = None
            if held is not None:
                out.append(held)
            for i, row in enumerate(out):
                row["chunk_id"] = f"chunk_{i:05d}"
            yield pd.DataFrame(out, columns=["doc_name", "chunk_id", "text", "section_path_str", "page_number", "chunk_type"])

    schema = "doc_name string, chunk_id string, text string, section_path_str string, page_number bigint, chunk_type string"
    return located.groupBy("doc_name").applyInPandas(lambda frame: next(per_document(iter([frame]))), schema)


def patch_ground_ids(chunks: DataFrame, replies: DataFrame, size: int = 100, overlap: int = 10) -> DataFrame:
    """A store's chunks with ``ground_id`` from the replies for the windows over each document."""
    pairs = section_pairs(chunks).withColumn("pos", F.row_number().over(W.partitionBy("doc_name").orderBy("vector_id")) - 1)
    windows = ground_windows(pairs, size, overlap)
    labelled = merge_windows(parse_assignments(replies, windows), pairs.select("doc_name", "vector_id"))
    return chunks.drop("ground_id").join(ground_ids(labelled).select("doc_name", "vector_id", "ground_id"), ["doc_name", "vector_id"], "left")


def require_chunks(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """``chunks``, or an error that names a document without any."""
    empty = docs.select("doc_name").join(chunks, "doc_name", "left_anti").select("doc_name").head(1)
    if empty:
        raise ValueError(f"no chunks: {empty[0].doc_name}")
    return chunks
