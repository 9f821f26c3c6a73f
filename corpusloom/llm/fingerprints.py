"""Document fingerprints (SimHash) and permuted block tables, with DataFrame functions only.

A term is a word with the word before it; its weight is 1, plus 1 for each of its two words that has
more than three characters. The hash of a term votes with its weight for or against each of 64 bits; a
bit is set if the votes for it are more than those against. The likeness of two fingerprints is
1 - differing bits / 64.

Null and empty texts have no terms and the fingerprint 0. Equal texts have equal fingerprints. Repeated
rows come back each; where a next document has several rows, its smallest text counts. An empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import SPACES, stash, text_or_empty

BITS = 64


def term_rows(texts: DataFrame, keys: list[str], text: str) -> DataFrame:
    """One row for each term: the keys, ``h`` (hash), ``w`` (weight) and ``last``, 1 in the one row that closes each text."""
    words = F.array_remove(F.split(F.lower(F.col(text)), SPACES), "")
    split = texts.select(*keys, words.alias("_b")).select(*keys, F.concat(F.array(F.lit("")), F.col("_b")).alias("_a"), "_b")
    terms = split.select(*keys, F.explode(F.arrays_zip("_a", "_b")).alias("t")).select(*keys, F.col("t._a").alias("a"), F.col("t._b").alias("b"))
    long_ = lambda c: (F.char_length(c) > 3).cast("long")
    # the arrays differ by one: the pair without a second word has weight 0 and stands for the text's end
    closed = F.col("b").isNull()
    return terms.select(*keys, F.xxhash64("a", "b").alias("h"), F.when(closed, F.lit(0)).otherwise(1 + long_(F.col("a")) + long_(F.col("b"))).cast("long").alias("w"), closed.cast("long").alias("last"))


def fingerprint_of(terms: DataFrame, keys: list[str]) -> DataFrame:
    """keys, ``fp`` and ``rows`` (how many texts were closed), from weighted votes with map-side partial sums.

    Two bits share a sum, 32 bits of it each: the weight for bit k is added below, for bit k + 32 above.
    A bit is set where the votes for it are more than half of all.
    """
    lanes = F.lit(1 | 1 << 32)
    both = [F.sum(F.shiftrightunsigned(F.col("h"), k).bitwiseAND(lanes) * F.col("w")).alias(f"v{k}") for k in range(BITS // 2)]
    votes = terms.groupBy(*keys).agg(*both, F.sum("w").alias("all"), F.sum("last").alias("rows"))
    fp: Column = F.lit(0).cast("long")
    for k in range(BITS // 2):
        low, high = F.col(f"v{k}").bitwiseAND(F.lit((1 << 32) - 1)), F.shiftrightunsigned(F.col(f"v{k}"), 32)
        for bit, sum_ in ((k, low), (k + 32, high)):
            fp = fp.bitwiseOR(F.when(2 * sum_ > F.col("all"), F.lit(1 << bit if bit < 63 else -(1 << 63))).otherwise(F.lit(0)).cast("long"))
    return votes.select(*keys, fp.alias("fp"), "rows")


def likeness(a: str, b: str) -> Column:
    return F.lit(1.0) - F.bit_count(F.col(a).bitwiseXOR(F.col(b))) / F.lit(float(BITS))


def hex16(column: str) -> Column:
    return F.lower(F.lpad(F.hex(F.col(column)), 16, "0"))


def successors(docs: DataFrame, partitions: int | None = None) -> DataFrame:
    """(doc_id, next_id): the next larger id, and after the largest the smallest.

    Ids are range-partitioned; only one row a partition is put in order in one place.
    """
    spark = docs.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = docs.select("doc_id").where(F.col("doc_id").isNotNull()).distinct()
    ids = stash(ids.repartitionByRange(n, "doc_id").withColumn("_part", F.spark_partition_id()), "ids")  # the part of an id is fixed from here on
    following = ids.withColumn("_next", F.lead("doc_id").over(W.partitionBy("_part").orderBy("doc_id")))
    firsts = ids.groupBy("_part").agg(F.min("doc_id").alias("first"))
    ring = W.partitionBy(F.lit(0)).orderBy("_part")  # one row a partition
    after = firsts.select("_part", F.coalesce(F.lead("first").over(ring), F.first("first").over(ring)).alias("after"))
    return following.join(after, "_part").select("doc_id", F.coalesce("_next", "after").alias("next_id"))


def edited_texts(docs: DataFrame) -> DataFrame:
    """doc_id, text, n_chars, edited and next_id; one exchange of the texts serves both joins.

    Rows without an id have no next document; they lose their last quarter.
    """
    every = docs.select("doc_id", text_or_empty().alias("text"))
    rows = every.where(F.col("doc_id").isNotNull())  # the same rows on both sides, so that Spark reuses their exchange
    sized = rows.select("doc_id", F.floor(F.char_length("text") / 4).cast("int").alias("q"))
    wanted = sized.groupBy("doc_id").agg(F.max("q").alias("q")).join(successors(docs), "doc_id")
    wanted = stash(wanted, "wanted")
    heads = rows.join(wanted.select(F.col("next_id").alias("doc_id"), F.col("doc_id").alias("for_id"), "q"), "doc_id")
    heads = heads.select("for_id", "doc_id", F.substring("text", F.lit(1), F.col("q")).alias("head"))
    heads = heads.groupBy("for_id").agg(F.min("head").alias("head"), F.first("doc_id").alias("next_id"))
    both = rows.join(heads, rows.doc_id == heads.for_id).select("doc_id", "text", "head", "next_id")
    alone = every.where(F.col("doc_id").isNull()).select("doc_id", "text", F.lit("").alias("head"), F.col("doc_id").alias("next_id"))
    both = both.unionByName(alone)
    n = F.char_length("text")
    q = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - q), F.substring("head", F.lit(1), q))
    return both.select("doc_id", "text", n.cast("long").alias("n_chars"), edited.alias("edited"), "next_id")


def smallest_only(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """``pairs`` without the texts of a repeated id but its smallest, whose head the edit takes."""
    rows = docs.where(F.col("doc_id").isNotNull()).select("doc_id", text_or_empty().alias("text"))
    repeated = rows.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    if repeated.isEmpty():
        return pairs
    least = rows.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))
    least = least.select(F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_least"))
    return pairs.join(least, F.col("doc_id") == F.col("_id"), "left").where(F.col("_least").isNull() | (F.col("_least") == F.col("text_hash"))).drop("_id", "_least")


def compare_edits(docs: DataFrame, search_every: int = 50, radius: int = 3) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_near.

    ``n_near``: for ids divisible by ``search_every``, how many documents (itself and copies included)
    have a fingerprint within the radius, found through the block tables; null for others.
    """
    keys = ["doc_id", "next_id", "n_chars", "text_hash", "edited_sha256"]
    rows = edited_texts(docs).select("doc_id", "next_id", "n_chars", F.xxhash64("text").alias("text_hash"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "text", "edited")
    kinds = F.array(F.struct(F.lit(0).alias("kind"), F.col("text").alias("t")), F.struct(F.lit(1).alias("kind"), F.col("edited").alias("t")))
    each = rows.select(*keys, F.explode(kinds).alias("x")).select(*keys, "x.kind", "x.t")
    prints = fingerprint_of(term_rows(each, [*keys, "kind"], "t"), [*keys, "kind"])
    own = lambda k: F.max(F.when(F.col("kind") == k, F.col("fp")))
    pairs = stash(prints.groupBy(*keys).agg(own(0).alias("fp"), own(1).alias("edited_fp"), F.max("rows").alias("rows")), "prints")
    counted = smallest_only(docs, pairs)
    following = counted.groupBy(F.col("doc_id").alias("next_id")).agg(F.min("fp").alias("next_fp"))
    asked = pairs.where(F.col("doc_id") % search_every == 0).select(F.col("doc_id").alias("_id"), F.col("fp").alias("query")).distinct()
    weight = pairs.groupBy("fp").agg(F.sum("rows").alias("n"))
    found = within_radius(asked.select(F.col("query").alias("fp")), pairs.select("fp"), radius).join(weight, "fp").groupBy("query").agg(F.sum("n").alias("n_near"))
    near = asked.join(found, "query").withColumnRenamed("query", "_fp")
    pairs = pairs.join(near, (F.col("doc_id") == F.col("_id")) & (F.col("fp") == F.col("_fp")), "left")
    out = pairs.join(following, "next_id", "left").withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
    out = out.withColumn("next_fp", F.coalesce("next_fp", "fp"))
    return out.select("doc_id", "n_chars", "edited_sha256", hex16("fp").alias("fingerprint"), hex16("edited_fp").alias("edited_fingerprint"), likeness("fp", "edited_fp").alias("near_edited"), likeness("fp", "next_fp").alias("near_next"), "n_near")


def block_tables(fps: DataFrame, radius: int = 3, blocks: int = 6) -> DataFrame:
    """(fp, table, key) of each distinct ``fp``: in each table other blocks are permuted to the front and form the key.

    Two fingerprints within the radius differ in at most ``radius`` blocks, so they agree on the key of
    at least one of the tables, of which there are ``blocks`` choose ``blocks - radius``.
    """
    edges = [round(i * BITS / blocks) for i in range(blocks + 1)]
    mask = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(blocks)]
    masks = [sum(mask[i] for i in kept) for kept in combinations(range(blocks), blocks - radius)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keys = F.array(*[F.col("fp").bitwiseAND(F.lit(m).cast("long")) for m in signed])
    return fps.select("fp").distinct().select("fp", F.posexplode(keys).alias("table", "key"))


def within_radius(queries: DataFrame, fps: DataFrame, radius: int = 3, blocks: int = 6) -> DataFrame:
    """(query, fp): every distinct fingerprint of ``fps`` within the radius of a distinct one of ``queries``."""
    left = block_tables(queries, radius, blocks).select(F.col("fp").alias("query"), "table", "key")
    pairs = left.join(block_tables(fps, radius, blocks), ["table", "key"])
    near = F.bit_count(F.col("query").bitwiseXOR(F.col("fp"))) <= radius
    return pairs.where(near).select("query", "fp").distinct()
