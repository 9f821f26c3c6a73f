"""Images embedded in Markdown, and their retrieval by caption."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import text as X

IMAGE_LINK = r"!\[[^\]]*\]\([^)]+\)"
DATA_URI = r"(?i)^data:(image/[a-zA-Z0-9.+-]+);base64,([A-Za-z0-9+/=\s]+)$"
FIGURE = r"(?i)\b(fig(ure)?|diagram|layout|schematic)\b"


def nearby_caption(left: Column, right: Column) -> Column:
    """A caption from the six lines after an image, else the six before it, nearest first; lines that look like one come first."""
    tidy = lambda c: F.filter(F.transform(X.lines(c), X.pystrip), lambda x: x != "")
    after, before = F.slice(tidy(F.left(right, F.lit(800))), 1, 6), tidy(F.right(left, F.lit(800)))
    candidates = F.concat(after, F.slice(F.reverse(before), 1, 6))
    plain = F.filter(candidates, lambda x: ~F.contains(F.lower(x), F.lit("data:image/")) & ~F.startswith(x, F.lit("![")) & ~F.startswith(x, F.lit("<!--")))
    captions = F.filter(F.transform(plain, X.clean_caption_line), lambda x: F.rlike(x, F.lit(FIGURE)))
    others = F.filter(F.transform(candidates, X.clean_caption_line), lambda x: F.char_length(x) >= 4)
    return F.left(F.coalesce(X.first_of(captions), X.first_of(others), F.lit("")), F.lit(220))


def extract_images(docs: DataFrame, md_col: str = "md") -> DataFrame:
    """(doc_name, image_index, caption, text, image, image_mime, chunk_type): every image link with a valid data URI.

    Text around a link is found by splitting at links, so nothing leaves the JVM.
    """
    parts = docs.select("doc_name", F.col(md_col).alias("md"), F.regexp_extract_all(F.col(md_col), F.lit(IMAGE_LINK), F.lit(0)).alias("links"), F.split(F.col(md_col), IMAGE_LINK).alias("between"))
    rows = parts.select("doc_name", "links", "between", F.posexplode("links").alias("pos", "link"))
    around = lambda a, n: F.array_join(F.flatten(F.transform(F.slice("between", a, n), lambda s, i: F.array(s))), "\n")
    left = around(F.lit(1), F.col("pos") + 1)
    right = around(F.col("pos") + 2, F.size("between"))
    src = X.pystrip(F.regexp_extract("link", r"\]\(([^)]+)\)", 1))
    mime, data = F.regexp_extract(src, DATA_URI, 1), F.regexp_replace(F.regexp_extract(src, DATA_URI, 2), r"\s+", "")
    rows = rows.select("doc_name", "pos", X.pystrip(F.regexp_extract("link", r"!\[([^\]]*)\]", 1)).alias("alt"), F.lower(mime).alias("image_mime"), F.try_to_binary(data, F.lit("base64")).alias("image"), nearby_caption(left, right).alias("near"))
    rows = rows.where((F.col("image_mime") != "") & F.col("image").isNotNull() & (F.length("image") > 0))
    rows = rows.withColumn("image_index", F.row_number().over(W.partitionBy("doc_name").orderBy("pos")).cast("bigint") - 1)
    stem = F.regexp_replace("doc_name", r"(?<=.)\.[^.]*$", "")
    own = F.concat(stem, F.lit(" figure "), (F.col("image_index") + 1).cast("string"))
    generic = (F.col("alt") == "") | F.lower("alt").isin(*X.GENERIC_ALT)
    caption = F.when(generic, F.coalesce(F.nullif("near", F.lit("")), own)).otherwise(F.col("alt"))
    return rows.select("doc_name", "image_index", caption.alias("caption"), caption.alias("text"), "image", "image_mime", F.lit("embedded_image").alias("chunk_type"))


def visual_reason(image: Column, width: Column, height: Column, least_bytes: int = 2500) -> Column:
    """Why an image is too small to show, or empty; sizes come from the image reader, without them the bytes decide."""
    size = F.concat(width.cast("string"), F.lit("x"), height.cast("string"))
    known = width.isNotNull() & height.isNotNull()
    return (
        F.when(image.isNull(), "invalid_b64")
        .when(F.length(image) == 0, "empty_b64")
        .when(~known & (F.length(image) < least_bytes), "small_payload")
        .when(known & (width * height < 9000), F.concat(F.lit("small_area:"), size))
        .when(known & (F.least(width, height) < 35), F.concat(F.lit("small_side:"), size))
        .otherwise("")
    )


def png_size(image: Column) -> Column:
    """struct(width, height) of a PNG's header; null for other formats."""
    number = lambda at: F.conv(F.hex(F.substring(image, at, 4)), 16, 10).cast("bigint")
    is_png = F.hex(F.substring(image, 1, 8)) == "89504E470D0A1A0A"
    return F.when(is_png & (F.length(image) >= 24), F.struct(number(17).alias("width"), number(21).alias("height")))


def synonym_hits(a: Column, b: Column) -> Column:
    """How many tokens of ``a`` have a synonym, or themselves, in ``b``."""
    groups = F.transform(b, X.synonym_group)
    return F.size(F.filter(a, lambda t: F.array_contains(groups, X.synonym_group(t))))


def caption_match(caption: Column, query: Column) -> Column:
    """The larger share of keywords matched, of the query's or of the caption's; without query keywords 1."""
    c = F.lower(X.pystrip(X.text_of(caption)))
    q, k = X.caption_keywords(query), X.caption_keywords(c)
    a, b = synonym_hits(q, k), synonym_hits(k, q)
    flat = F.lower(X.squeeze(X.text_of(query)))
    phrase = F.when((F.char_length(flat) >= 6) & F.contains(c, flat), 1.0).otherwise(0.0)
    shares = F.greatest(a / F.greatest(F.lit(1), F.size(q)), b / F.greatest(F.lit(1), F.size(k)))
    return F.when((c == "") | c.isin(*X.GENERIC_ALT), 0.0).when(F.size(q) == 0, 1.0).when((a > 0) | (b > 0), shares).otherwise(phrase)


def image_query(questions: DataFrame, context: DataFrame) -> DataFrame:
    """(query_id, question, caption_query, chunk_ctx, top_doc) from a question and its retrieved chunks."""
    ranked = context.withColumn("_r", F.row_number().over(W.partitionBy("query_id").orderBy("position")))
    top = F.first("doc_name").over(W.partitionBy("query_id").orderBy("position").rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    ranked = ranked.withColumn("_top", X.pystrip(X.text_of(top)))
    same = (F.col("_top") == "") | (X.pystrip(X.text_of("doc_name")) == F.col("_top"))
    ranked = ranked.withColumn("_same", F.sum(same.cast("int")).over(W.partitionBy("query_id").orderBy("position")))
    joined = lambda entries: F.array_join(F.transform(F.array_sort(entries), lambda e: e["t"]), "\n")
    head = F.when(F.col("_r") <= 6, F.struct("_r", F.left(X.pystrip(X.text_of("text")), F.lit(600)).alias("t")))
    near = F.when(same & (F.col("_same") <= 4), F.struct("_r", F.left(X.text_of("text"), F.lit(800)).alias("t")))
    per = ranked.groupBy("query_id").agg(joined(F.collect_list(head)).alias("head"), X.pystrip(joined(F.collect_list(near))).alias("chunk_ctx"), F.first("_top").alias("top_doc"))
    q = questions.select("query_id", "question").join(per, "query_id", "left")
    return q.select("query_id", "question", X.pystrip(F.concat_ws("\n", X.pystrip(F.col("question")), F.nullif("head", F.lit("")))).alias("caption_query"), X.text_of("chunk_ctx").alias("chunk_ctx"), X.text_of("top_doc").alias("top_doc"))


def retrieve_images(found: DataFrame, queries: DataFrame, k: int = 8, most: int = 4, least: float = 0.6, strict: float = 0.75) -> DataFrame:
    """Up to ``most`` images a query, from the ``3 k`` nearest (``found`` has query_id, vec_score and image columns).

    Rows carry ``kind``: lexical matches first, for explicit requests without one the fallback, and
    caption-less images by vector score in the slots left.
    """
    pool = found.withColumn("_p", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("vec_score"), "image_uuid"))).where(F.col("_p") <= 3 * k)
    rows = pool.join(F.broadcast(queries), "query_id")
    ok = (X.pystrip(X.text_of("image_uuid")) != "") & (visual_reason(F.col("image"), F.col("width"), F.col("height")) == "")
    doc = X.pystrip(X.text_of("doc_name"))
    rows = rows.where(ok & ((F.col("top_doc") == "") | (doc == "") | (doc == F.col("top_doc"))))
    caption, body = X.clean_image_caption(F.col("caption")), X.clean_image_caption(F.col("text"))
    rows = rows.withColumn("_c", caption).withColumn("_t", body).withColumn("_all", X.pystrip(F.concat_ws(" ", F.nullif(F.col("_c"), F.lit("")), F.nullif(F.col("_t"), F.lit("")))))
    q, ctx, chunk = caption_match(F.col("_all"), F.col("question")), caption_match(F.col("_all"), F.col("caption_query")), F.when(F.col("chunk_ctx") == "", 0.0).otherwise(caption_match(F.col("_all"), F.col("chunk_ctx")))
    keys = X.caption_keywords(F.col("question"))
    rows = rows.withColumn("_q", q).withColumn("_x", ctx).withColumn("_k", chunk).withColumn("_overlap", synonym_hits(keys, X.caption_keywords(F.col("_all")))).withColumn("_n", F.size(keys))
    explicit = X.contains_any(F.lower(X.squeeze(F.col("question"))), ("show image", "give image", "display image", "image of", "picture of", "figure of"))
    bare = (F.col("_c") == "") & (F.col("_t") == "")
    share = F.col("_overlap") / F.greatest(F.lit(1), F.col("_n"))
    lexical = (F.col("_n") == 0) | (F.col("_overlap") >= 1)
    demanding = explicit & (F.col("_n") > 0)
    misses = (share < strict) | (F.col("_q") < strict)
    best = F.greatest("_q", "_x", "_k")
    score = F.greatest("_q", "_x")
    kind = (
        F.when(bare, "semantic")
        .when(X.is_bad_caption(F.col("_c")) | ~lexical, None)
        .when(demanding & misses, F.when((share >= 0.45) & (best >= least), "fallback"))
        .when((score >= least) & (F.greatest("_q", "_k") >= 0.45), "lexical")
    )
    rows = rows.withColumn("kind", kind).where(F.col("kind").isNotNull())
    rows = rows.withColumn("score", F.when(F.col("kind") == "semantic", F.col("vec_score")).when(F.col("kind") == "fallback", best).otherwise(score))
    any_lexical = F.bool_or(F.col("kind") == "lexical").over(W.partitionBy("query_id"))
    rows = rows.withColumn("_any", any_lexical).where((F.col("kind") != "fallback") | ~F.col("_any"))
    tier = F.when(F.col("kind") == "semantic", 1).otherwise(0)
    once = F.row_number().over(W.partitionBy("query_id", "image_uuid").orderBy(tier, F.desc("score"), "_p"))
    rows = rows.withColumn("_once", once).where(F.col("_once") == 1)
    order = F.row_number().over(W.partitionBy("query_id").orderBy(tier, F.desc("score"), F.desc("vec_score"), "_p"))
    return rows.withColumn("image_rank", order).where(F.col("image_rank") <= max(1, min(most, k))).select("query_id", "image_rank", "image_uuid", F.col("_c").alias("caption"), "doc_name", "kind", "score")


def image_by_uuid(images: DataFrame, uuid: str) -> DataFrame:
    return images.where(F.col("image_uuid") == uuid).select("image", F.coalesce(F.nullif("image_mime", F.lit("")), F.lit("image/png")).alias("image_mime")).limit(1)
