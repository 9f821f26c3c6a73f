"""BM25 over a stored inverted index, without a scan of texts.

Chunks are cut into segments of consecutive ids. A row of the index is a term in a segment: the ids of
the chunks there that have it, how often, and how long they are, with the most that one of them can
count. Rows lie in folders by a hash of the term and are sorted by term, so a question reads the folders
of its terms and of these the row groups that may hold them. A row is never longer than a segment.

Of a segment no chunk scores above the sum of what its terms can count. The segments with the largest
sums are scored first; those whose sum is below the k-th score found are skipped, ids and all.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import text as X
from ..sources.shared import stash
from . import vocab

#: Slack for the order in which the terms of a sum are added.
SLACK = 1e-9


def saturated(tf: Column, dl: Column, avgdl: Column | float, k1: float, b: float) -> Column:
    """What ``tf`` occurrences count in a text of ``dl`` tokens, without the weight of the term."""
    average = avgdl if isinstance(avgdl, Column) else F.lit(avgdl)
    return tf / (tf + k1 * (1 - b + b * dl / average) + 1e-8)


@dataclass(frozen=True)
class PostingsIndex:
    spark: SparkSession
    path: str
    n: int
    avgdl: float
    buckets: int
    k1: float
    b: float

    @classmethod
    def build(cls, chunks: DataFrame, path: str, buckets: int = 64, segment: int = 512, id_col: str = "vector_id", text_col: str = "text", k1: float = 1.2, b: float = 0.75) -> PostingsIndex:
        """Write the index of ``chunks``, whose ids are whole numbers and tell them apart; dense ones fill the segments."""
        spark = chunks.sparkSession
        rows = chunks.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).where(F.col("id").isNotNull())
        lengths = rows.select(F.greatest(F.lit(1), F.size(X.bm25_tokens(F.col("text")))).alias("dl"))
        facts = lengths.agg(F.count("*").alias("n"), (F.coalesce(F.avg("dl"), F.lit(0.0)) + 1e-6).alias("avgdl")).first()
        counted = vocab.term_frequencies(rows, "id").withColumn("segment", F.floor(F.col("id") / segment))
        entry = F.array_sort(F.collect_list(F.struct("id", "tf", F.col("doc_len").alias("dl"))))
        most = F.max(saturated(F.col("tf"), F.col("doc_len"), facts.avgdl, k1, b))
        # for other settings than these the bound follows from the largest count and the smallest length
        lists = counted.groupBy("term", "segment").agg(entry.alias("_e"), most.alias("most"), F.max("tf").alias("most_tf"), F.min("doc_len").alias("least_dl"), F.count("*").alias("df"))
        split = [F.col(f"_e.{c}").alias(f"{c}s") for c in ("id", "tf", "dl")]
        lists = lists.select(cls._bucket(F.col("term"), buckets).alias("bucket"), "term", "segment", "df", "most", "most_tf", "least_dl", *split)
        # by ranges, so that a term that stands everywhere is written by as many tasks as its segments need
        lists.repartitionByRange("bucket", "term", "segment").sortWithinPartitions("bucket", "term", "segment").write.mode("overwrite").partitionBy("bucket").parquet(path)
        told = spark.createDataFrame([(facts.n, float(facts.avgdl), buckets, k1, b)], "n bigint, avgdl double, buckets int, k1 double, b double")
        told.coalesce(1).write.mode("overwrite").parquet(path.rstrip("/") + "_facts")
        return cls(spark, path, facts.n, float(facts.avgdl), buckets, k1, b)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> PostingsIndex:
        r = spark.read.parquet(path.rstrip("/") + "_facts").first()
        return cls(spark, path, r.n, r.avgdl, r.buckets, r.k1, r.b)

    @staticmethod
    def _bucket(term: Column, buckets: int) -> Column:
        return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")

    KIND = "bucket int, term string, segment bigint, df bigint, most double, most_tf bigint, least_dl int, ids array<bigint>, tfs array<bigint>, dls array<int>"

    def rows(self, terms: list[str]) -> DataFrame:
        """The index rows of some terms: other folders aren't listed, other row groups not read."""
        at = self.spark.range(1).select(F.explode(F.array_distinct(F.transform(F.array(*[F.lit(t) for t in terms]), lambda t: self._bucket(t, self.buckets)))).alias("b"))
        folders = [r.b for r in at.collect()] if terms else []
        return self.spark.read.schema(self.KIND).parquet(self.path).where(F.col("bucket").isin(folders) & F.col("term").isin(terms))

    def _weights(self, queries: DataFrame, k1: float) -> tuple[DataFrame, DataFrame]:
        """The index rows of all terms of the queries, and (query_id, term, w), what a saturated occurrence counts."""
        asked = queries.select("query_id", F.explode("bm25_terms").alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))
        rows = self.rows(sorted(r.term for r in asked.select("term").distinct().collect()))
        df = rows.groupBy("term").agg(F.sum("df").alias("n_docs"))
        idf = F.ln((self.n - F.col("n_docs") + 0.5) / (F.col("n_docs") + 0.5) + 1.0)
        weights = asked.join(F.broadcast(df), "term").select("query_id", "term", (F.col("times") * (k1 + 1) * idf).alias("w"))  # a row a term
        return rows, stash(weights, "weights")

    def _read(self, rows: DataFrame, weights: DataFrame, k: int, k1: float, b: float, first: int) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(query_id, segment, place) with places by bound; the answers of the ``first`` of them; and the others that may still hold a better chunk."""
        most = F.col("most") if (k1, b) == (self.k1, self.b) else saturated(F.col("most_tf"), F.col("least_dl"), self.avgdl, k1, b)
        bound = rows.select("term", "segment", most.alias("most")).join(F.broadcast(weights), "term")  # a row for each question and term
        bounds = bound.groupBy("query_id", "segment").agg(F.sum(F.col("w") * F.col("most")).alias("bound"))
        place = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("bound"), "segment"))
        bounds = stash(bounds.withColumn("place", place), "bounds")
        head = bounds.where(F.col("place") <= first).select("query_id", "segment")
        found = stash(self._ranked(self._scores(rows, weights, k1, b, head), k), "found")
        least = found.where(F.col("rank") == k - 1).select("query_id", F.col("bm25").alias("least"))  # a row a question
        rest = bounds.where(F.col("place") > first).join(F.broadcast(least), "query_id", "left")
        rest = rest.where(F.col("least").isNull() | (F.col("bound") >= F.col("least") - SLACK * (1 + F.col("least"))))
        return bounds, found, rest.select("query_id", "segment")

    def search(self, queries: DataFrame, k: int | None, k1: float | None = None, b: float | None = None, first: int | None = None) -> DataFrame:
        """(query_id, id, bm25, rank from 0) of each query's ``k`` best chunks with a term of it, or of all of them if ``k`` is None.

        ``queries`` has query_id and bm25_terms; a term counts as often as it stands there. Terms of a
        batch go into one filter, so a batch is some thousand questions at most. ``first`` segments a
        question are scored before any is skipped; ``k`` by default.
        """
        k1, b = self.k1 if k1 is None else k1, self.b if b is None else b
        rows, weights = self._weights(queries, k1)
        if k is None:
            return self._ranked(self._scores(rows, weights, k1, b), None)
        _, found, rest = self._read(rows, weights, k, k1, b, first or k)
        return self._ranked(found.drop("rank").unionByName(self._scores(rows, weights, k1, b, rest)), k)

    def segments_read(self, queries: DataFrame, k: int, first: int | None = None) -> tuple[int, int]:
        """(segments scored, segments with a term) over all questions: what the bounds leave out."""
        rows, weights = self._weights(queries, self.k1)
        bounds, _, rest = self._read(rows, weights, k, self.k1, self.b, first or k)
        return bounds.where(F.col("place") <= (first or k)).count() + rest.count(), bounds.count()

    def _scores(self, rows: DataFrame, weights: DataFrame, k1: float, b: float, segments: DataFrame | None = None) -> DataFrame:
        """(query_id, id, bm25) of the chunks in some segments of each question, or in all."""
        held = rows.join(F.broadcast(weights), "term")  # a row for each question and term
        if segments is not None:
            held = held.join(segments, ["query_id", "segment"], "left_semi")
        entries = held.select("query_id", "term", "w", F.explode(F.arrays_zip("ids", "tfs", "dls")).alias("e"))
        part = F.col("w") * saturated(F.col("e.tfs"), F.col("e.dls"), self.avgdl, k1, b)
        return entries.groupBy("query_id", F.col("e.ids").alias("id")).agg(F.sum(part).alias("bm25"))

    @staticmethod
    def _ranked(scores: DataFrame, k: int | None) -> DataFrame:
        ranked = scores.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("bm25"), "id")) - 1)
        return ranked if k is None else ranked.where(F.col("rank") < k)
