"""Scoring and ranking of chunks for one or many questions.

Every function keys its work by ``query_id``, so that a batch of questions is one plan.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import text as X
from ..sources.shared import stash
from . import topk


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2_normalize(v: Column) -> Column:
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.transform(v, lambda x: x.cast("double") / F.greatest(norm, F.lit(1e-12)))


def fused_query_vectors(variants: DataFrame) -> DataFrame:
    """(query_id, query_vec): the element-wise mean of each query's variant vectors, normalised."""
    parts = variants.select("query_id", F.posexplode("embedding").alias("i", "x")).groupBy("query_id", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    vec = F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"])
    return parts.groupBy("query_id").agg(vec.alias("v")).select("query_id", l2_normalize(F.col("v")).alias("query_vec"))


def pool_sizes(n: int, top_k: int, pool: int, multiplier: int) -> tuple[int, int]:
    """(pool_k, initial_k) for ``n`` chunks."""
    pool_k = min(n, max(top_k, pool))
    mult = max(1, multiplier, 3 if n > 40 else 1)
    return pool_k, min(n, max(pool_k * mult, pool_k + min(32, n // 4)))


MOST_QUERIES = 10_000


def numbered(df: DataFrame, column: str) -> DataFrame:
    """``df`` with dense numbers from 0: the number within its part, which Spark's increasing id holds, plus the sizes of parts before."""
    rows = stash(df.withColumn("_at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_at", 33)
    sizes = rows.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("_part", before.alias("_before"))
    joined = rows.withColumn("_part", part).join(F.broadcast(offsets), "_part")  # one row a part
    return joined.withColumn(column, F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_at", "_part", "_before")


def _slices(queries: DataFrame, most: int | None = None) -> list[DataFrame]:
    """The queries in parts of at most ``most`` (MOST_QUERIES), so that each may be broadcast."""
    n, most = queries.count(), min(most or MOST_QUERIES, MOST_QUERIES)
    if n <= most:
        return [queries]
    rows = stash(numbered(queries, "_no"), "queries")
    slice_of = F.floor(F.col("_no") / most)
    return [rows.where(slice_of == i).drop("_no") for i in range(-(-n // most))]


def query_matrices(queries: DataFrame) -> Iterator[tuple[DataFrame, np.ndarray]]:
    """(q, query_id) and the matrix whose row ``q`` is that query's vector: for each slice of queries and length of vectors."""
    kind = dict(queries.dtypes)["query_id"]
    for part in _slices(queries.where(F.col("query_vec").isNotNull()).select("query_id", "query_vec")):
        by_length: dict[int, list] = {}
        for r in part.collect():  # at most MOST_QUERIES
            by_length.setdefault(len(r.query_vec), []).append(r)
        for length, own in sorted(by_length.items()):
            names = queries.sparkSession.createDataFrame([(i, r.query_id) for i, r in enumerate(own)], f"q bigint, query_id {kind}")
            yield names, np.array([r.query_vec for r in own], np.float64).reshape(len(own), length)


def _keys(chunks: DataFrame, id_col: str) -> list[str]:
    return [c for c in ("tenant", id_col) if c in chunks.columns]


def nearest_ids(chunks: DataFrame, queries: DataFrame, k: int, id_col: str = "vector_id") -> DataFrame:
    """(query_id, tenant and id, dense, dense_rank from 0) of the ``k`` chunks of largest inner product for each query.

    Reads ids and embeddings only. A task keeps ``k`` rows a question (see ``topk``), so there are no more
    tasks than cores: with more input tasks grow, not what they leave.
    """
    keys, found = _keys(chunks, id_col), None
    chunks = chunks.coalesce(max(1, chunks.sparkSession.sparkContext.defaultParallelism))
    for names, vectors in query_matrices(queries):
        ranked = topk.best(chunks, vectors, k, keys, id_col).join(F.broadcast(names), "q")  # at most MOST_QUERIES names
        ranked = ranked.select("query_id", *keys, F.col("score").alias("dense"), F.col("rank").alias("dense_rank"))
        found = ranked if found is None else found.unionByName(ranked)
    if found is None:
        kinds = {**dict(chunks.dtypes), **dict(queries.dtypes)}
        found = chunks.sparkSession.createDataFrame([], f"query_id {kinds['query_id']}, " + ", ".join(f"`{c}` {kinds[c]}" for c in keys) + ", dense double, dense_rank int")
    return found


#: Rows of an answer that are broadcast to fetch their chunks; more are joined by a shuffle.
MOST_FETCHED = 500_000


def fetch(chunks: DataFrame, found: DataFrame, queries: int, k: int, keys: list[str]) -> DataFrame:
    """The chunks of an answer (keys and its own columns) of at most ``queries * k`` rows, whose size decides how they are joined."""
    small = found.withColumnsRenamed({c: f"_{c}" for c in keys})
    small = F.broadcast(small) if queries * k <= MOST_FETCHED else small
    same = [chunks[c].eqNullSafe(small[f"_{c}"]) for c in keys]
    return chunks.join(small, same, "inner").drop(*[f"_{c}" for c in keys])


def dense_topk(chunks: DataFrame, queries: DataFrame, k: int, id_col: str = "vector_id") -> DataFrame:
    """The ``k`` chunks of largest inner product for each query, with ``dense`` and ``dense_rank`` from 0.

    Ids and scores are found by ``nearest_ids``; the chunks themselves are read for these only.
    """
    keys = _keys(chunks, id_col)
    return fetch(chunks, nearest_ids(chunks, queries, k, id_col), queries.count(), k, keys)


def _term_lists(queries: DataFrame) -> DataFrame:
    """query_id with ``_terms``, its distinct query terms, and ``_times``, how often it has each."""
    rows = queries.select("query_id", "bm25_terms", F.array_sort(F.array_distinct("bm25_terms")).alias("_terms"))
    return rows.select("query_id", "_terms", F.transform("_terms", lambda t: F.size(F.filter("bm25_terms", lambda x: x == t))).alias("_times"))


def _counted(text: Column) -> Column:
    """Of one text its length in tokens (1 at least) and how often it has each of ``_terms``; tokens are cut once."""
    return F.transform(F.array(X.bm25_tokens(text)), _counts_of)[0]


def _counts_of(tokens: Column) -> Column:
    count = F.transform("_terms", lambda t: F.size(F.filter(tokens, lambda x: x == t)))
    return F.struct(F.greatest(F.lit(1), F.size(tokens)).alias("dl"), count.alias("tf"))


def _bm25_weights(rows: DataFrame, terms: DataFrame, k1: float) -> DataFrame:
    """query_id, ``_avgdl`` and ``_weights``, what each of its terms counts, from the rows of each query: one row a query."""
    size = rows.groupBy("query_id").agg(F.count("*").alias("n"), (F.avg("_c.dl") + 1e-6).alias("_avgdl"))
    df = rows.select("query_id", F.posexplode("_c.tf").alias("i", "f")).where("f > 0").groupBy("query_id", "i").agg(F.count("*").alias("df"))
    df = df.groupBy("query_id").agg(F.map_from_entries(F.collect_list(F.struct("i", "df"))).alias("df"))
    known = size.join(df, "query_id", "left").join(terms, "query_id")
    def weight(times: Column, i: Column) -> Column:
        seen = F.coalesce(F.col("df")[i], F.lit(0))
        return times * (k1 + 1) * F.ln((F.col("n") - seen + 0.5) / (seen + 0.5) + 1.0)

    return known.select("query_id", "_avgdl", F.transform("_times", weight).alias("_weights"))


def _bm25_score(k1: float, b: float) -> Column:
    norm = k1 * (1 - b + b * F.col("_c.dl") / F.col("_avgdl")) + 1e-8
    return F.aggregate(F.zip_with("_c.tf", "_weights", lambda f, w: w * f / (f + norm)), F.lit(0.0), lambda s, x: s + x)


def bm25(pool: DataFrame, queries: DataFrame, k1: float = 1.2, b: float = 0.75, text_col: str = "text") -> DataFrame:
    """``pool`` with ``bm25``: statistics are of each query's own pool; query terms count as often as they stand in ``bm25_terms``.

    Terms are counted row by row, if ``measured`` hasn't done so; only the statistics, one row a query, are joined back.
    """
    terms = _term_lists(queries)
    rows = pool if "_c" in pool.columns else pool.join(terms, "query_id").withColumn("_c", _counted(F.col(text_col)))
    scored = rows.join(_bm25_weights(rows.select("query_id", "_c"), terms, k1), "query_id").withColumn("bm25", _bm25_score(k1, b))
    return scored.select(*[c for c in pool.columns if c != "_c"], "bm25")


def _counts(chunks: DataFrame, queries: DataFrame, columns: list[str]) -> DataFrame:
    """``columns``, the length and the counts of the queries' terms of every chunk, written once: a row a chunk, however many questions there are."""
    asked = queries.select(F.explode("bm25_terms").alias("t")).distinct().collect()  # the terms of at most MOST_QUERIES questions
    terms = F.array(*[F.lit(r.t) for r in asked]).cast("array<string>")

    def counted(k: Column) -> Column:
        entry = lambda t: F.struct(t.alias("t"), F.size(F.filter(k, lambda x: x == t)).alias("f"))
        return F.struct(F.greatest(F.lit(1), F.size(k)).alias("dl"), F.transform(F.array_intersect(k, terms), entry).alias("tf"))

    own = F.transform(F.array(X.bm25_tokens(F.col("text"))), counted)[0]
    return stash(chunks.select(*columns, own.alias("_c")), "counts")


def _weighted(counts: DataFrame, queries: DataFrame, k1: float) -> DataFrame:
    """The queries with ``_weights``, struct(term, what it counts), and the corpus' ``_avgdl``: one row a query."""
    size = counts.agg(F.count("*").alias("n"), (F.avg("_c.dl") + 1e-6).alias("_avgdl"))
    df = counts.select(F.explode("_c.tf.t").alias("t")).groupBy("t").agg(F.count("*").alias("df"))
    rows = _term_lists(queries).select("query_id", F.explode(F.arrays_zip("_terms", "_times")).alias("e")).select("query_id", F.col("e._terms").alias("t"), F.col("e._times").alias("times"))
    rows = rows.join(df, "t").join(F.broadcast(size))  # one row
    weight = F.col("times") * (k1 + 1) * F.ln((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1.0)
    weights = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("t", weight.alias("w")))).alias("_weights"))
    vectors = ["query_vec"] if "query_vec" in queries.columns else []
    return queries.select("query_id", *vectors).join(weights, "query_id", "left").join(F.broadcast(size.select("_avgdl")))  # one row


def _pair_scores(counts: DataFrame, weighted: DataFrame, id_col: str, k1: float, b: float) -> DataFrame:
    """(query_id, id, bm25, and ``dense`` where there are vectors) of each question and chunk, worked out where they are used and not stored."""
    pairs = counts.crossJoin(F.broadcast(weighted))  # at most MOST_QUERIES rows
    norm = k1 * (1 - b + b * F.col("_c.dl") / F.col("_avgdl")) + 1e-8

    def part(w: Column) -> Column:
        f = F.coalesce(F.get(F.filter("_c.tf", lambda e: e["t"] == w["t"]), F.lit(0))["f"], F.lit(0))
        return w["w"] * f / (f + norm)

    score = F.coalesce(F.aggregate("_weights", F.lit(0.0), lambda s, w: s + part(w)), F.lit(0.0))
    dense = [dot(F.col("embedding"), F.col("query_vec")).alias("dense")] if "query_vec" in weighted.columns else []
    return pairs.select("query_id", id_col, *dense, score.alias("bm25"))


def corpus_scores(chunks: DataFrame, queries: DataFrame, id_col: str = "vector_id", k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(query_id, id, bm25, and ``dense`` where queries have a ``query_vec``) of every chunk, with statistics of the corpus.

    One scan of texts leaves a row a chunk, which is written once; scores of pairs aren't.
    """
    found = None
    for part in _slices(queries):
        counts = _counts(chunks, part, [id_col, *(["embedding"] if "query_vec" in part.columns else [])])
        scored = _pair_scores(counts, _weighted(counts, part, k1), id_col, k1, b)
        found = scored if found is None else found.unionByName(scored)
    return found


def hybrid_search(chunks: DataFrame, queries: DataFrame, k: int, id_col: str = "vector_id", rrf_k: int = 58) -> DataFrame:
    """(query_id, id, dense, bm25, dense_rank, bm25_rank, rrf) of the ``k`` best chunks of the whole corpus by reciprocal ranks.

    Exact without ranking the corpus: a chunk in neither list's first 2 k + rrf_k has at most
    2 / (2 k + 2 rrf_k), less than the k-th of the dense list has from that list alone. Ranks of those
    few in the other list are counts of better chunks, added up in one pass. Questions come in slices
    whose candidates may be broadcast, and scores of pairs are never stored.
    """
    n, found = 2 * k + rrf_k, None
    for part in _slices(queries, max(1, MOST_FETCHED // (2 * n))):
        ranked = _hybrid(chunks, part, n, id_col, rrf_k)
        found = ranked if found is None else found.unionByName(ranked)
    best = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("rrf"), id_col))
    return found.withColumn("_r", best).where(F.col("_r") <= k).drop("_r")


def _hybrid(chunks: DataFrame, queries: DataFrame, n: int, id_col: str, rrf_k: int) -> DataFrame:
    """The candidates of a slice of questions, ranked in both lists."""
    counts = _counts(chunks, queries, [id_col, "embedding"])
    weighted = stash(_weighted(counts, queries, 1.2), "weighted")
    scores = _pair_scores(counts, weighted, id_col, 1.2, 0.75)
    first = lambda c: scores.withColumn("_r", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc(c), id_col))).where(F.col("_r") <= n).drop("_r")
    candidates = stash(first("dense").unionByName(first("bm25")).dropDuplicates(["query_id", id_col]), "candidates")
    names = {"query_id": "_q", id_col: "_id", "dense": "_dense", "bm25": "_bm25"}
    asked = F.broadcast(candidates.withColumnsRenamed(names))  # at most 2 n rows a query, MOST_FETCHED in all
    better = lambda c: (F.col(c) > F.col(f"_{c}")) | ((F.col(c) == F.col(f"_{c}")) & (F.col(id_col) < F.col("_id")))
    counted = scores.join(asked, (F.col("query_id") == F.col("_q")) & (better("dense") | better("bm25")))
    counted = counted.groupBy("_q", "_id").agg(F.count_if(better("dense")).alias("dense_rank"), F.count_if(better("bm25")).alias("bm25_rank"))
    none = F.lit(0).cast("long")
    ranked = candidates.join(counted, (F.col("query_id") == F.col("_q")) & (F.col(id_col) == F.col("_id")), "left")
    ranked = ranked.select("query_id", id_col, "dense", "bm25", F.coalesce("dense_rank", none).alias("dense_rank"), F.coalesce("bm25_rank", none).alias("bm25_rank"))
    return ranked.withColumn("rrf", 1.0 / (rrf_k + F.col("dense_rank")) + 1.0 / (rrf_k + F.col("bm25_rank")))


def minmax(column: str) -> Column:
    """To 0..1 within a query; all ones where the range is nearly 0."""
    own = W.partitionBy("query_id")
    low, high = F.min(column).over(own), F.max(column).over(own)
    return F.when(high - low < 1e-8, 1.0).otherwise((F.col(column) - low) / (high - low + 1e-8))


def fuse(pool: DataFrame, bm25_weight: float = 0.65, blend: float = 0.25, id_col: str = "vector_id", k: float = 58.0) -> DataFrame:
    """``rrf`` of the dense and BM25 ranks, and ``fused``: a weighted mean of the normalised scores, blended with it.

    For pools that a first stage has cut to some hundred rows a query; for whole corpora see ``hybrid_search``.
    """
    w, beta = min(max(bm25_weight, 0.0), 0.95), min(max(blend, 0.0), 0.95)
    rank = lambda c: F.row_number().over(W.partitionBy("query_id").orderBy(F.desc(c), id_col)) - 1
    ranked = pool.withColumn("dense_rank", rank("dense")).withColumn("bm25_rank", rank("bm25"))
    ranked = ranked.withColumn("rrf", 1.0 / (k + F.col("dense_rank")) + 1.0 / (k + F.col("bm25_rank")))
    linear = (1 - w) * minmax("dense") + w * minmax("bm25")
    return ranked.withColumn("fused", (1 - beta) * linear + beta * minmax("rrf"))


def section_factors(section: Column, text: Column, thin: Column | None = None, title: Column | None = None) -> Column:
    """The product of the multipliers that look at a chunk's section and length; two of them, which depend on the chunk alone, may be given."""
    terms, phrases, focus = F.col("terms"), F.col("phrases"), F.col("has_focus")
    thin, title = X.thin_chunk(text) if thin is None else thin, X.title_only(section, text) if title is None else title
    return X.section_match(section, focus, terms, phrases) * X.generic_section(section, phrases) * thin * title * X.spec_section(section, terms)


def measured(rows: DataFrame, questions: DataFrame) -> DataFrame:
    """``rows`` of questions with what the fusion stage needs of their texts, so that texts need not travel on.

    ``_c``: length and counts of the query's terms; ``_section``: multipliers of section and length; ``_factor``: all multipliers.
    Rows may also be of chunks, with what their questions have of them in a list ``_asks``: what depends on the
    chunk alone is then worked out once for all of them.
    """
    section, text = F.col("section_path_str"), F.col("text")
    alone = {"_tokens": X.bm25_tokens(text), "_low": F.lower(X.text_of(text)), "_boiler": X.boilerplate(text), "_thin": X.thin_chunk(text), "_title": X.title_only(section, text)}
    own = rows.withColumns(alone)
    if "_asks" in rows.columns:
        own = own.withColumn("_ask", F.explode("_asks")).drop("_asks").select("*", "_ask.*").drop("_ask")
    facts = questions.select("query_id", "terms", "phrases", "has_focus", F.array_sort(F.array_distinct("bm25_terms")).alias("_terms"))
    joined = own.join(F.broadcast(facts), "query_id").withColumn("_c", _counts_of(F.col("_tokens")))
    joined = joined.withColumn("_section", section_factors(section, text, F.col("_thin"), F.col("_title")))
    factor = F.col("_boiler") * X.term_coverage(text, F.col("terms"), F.col("_low")) * F.col("_section")
    return joined.withColumn("_factor", factor).drop("terms", "phrases", "has_focus", "_terms", *alone)


def adjust(fused: DataFrame, questions: DataFrame) -> DataFrame:
    """``fused`` times all multipliers of the fusion stage, by ``measured`` if they aren't there."""
    rows = fused if "_factor" in fused.columns else measured(fused, questions).drop("_c", "_section")
    return rows.withColumn("fused", F.col("fused") * F.col("_factor")).drop("_factor")


def cut_and_dedupe(fused: DataFrame, pool_k: int, keys: tuple[str, ...] = ("tenant", "doc_name", "chunk_index"), id_col: str = "vector_id") -> DataFrame:
    """The best ``pool_k`` of each query, and of rows that share their keys the best one."""
    order = [F.desc("fused"), F.col(id_col)]
    cut = fused.withColumn("_r", F.row_number().over(W.partitionBy("query_id").orderBy(*order))).where(F.col("_r") <= pool_k)
    own = [F.coalesce(F.col(k).cast("string"), F.concat(F.lit("#"), F.col(id_col).cast("string")) if k == "chunk_index" else F.lit("")) for k in keys]
    first = F.row_number().over(W.partitionBy("query_id", *own).orderBy(*order))
    return cut.withColumn("_k", first).where(F.col("_k") == 1).drop("_k", "_r")


def mmr(pool: DataFrame, queries: DataFrame, k: int, weight: float = 0.68, id_col: str = "vector_id", keys: tuple[str, ...] = ()) -> DataFrame:
    """(query_id, id, sim, mmr_rank) of up to ``k`` rows a query, chosen for relevance and novelty and ranked by similarity.

    A query's pool is bounded by the caller's cut; each is one pandas group. Of rows equal in ``keys``, if given, one counts.
    """
    rows = pool.select("query_id", id_col, "embedding", "fused", *[F.col(c).alias(f"_key_{c}") for c in keys]).join(F.broadcast(queries.select("query_id", "query_vec")), "query_id")
    schema = f"query_id {dict(pool.dtypes)['query_id']}, {id_col} bigint, sim double, mmr_rank int"

    def choose(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.drop_duplicates([f"_key_{c}" for c in keys]) if keys else frame
        frame = frame.sort_values(["fused", id_col], ascending=[False, True])
        v = np.stack([np.asarray(x, float) for x in frame["embedding"]])
        sim = v @ np.asarray(frame["query_vec"].iloc[0], float)
        picked = list(range(len(frame)))
        if len(frame) > k:
            between = v @ v.T
            picked = [int(np.argmax(sim))]
            nearest = between[picked[0]].copy()
            while len(picked) < k:
                gain = weight * sim - (1 - weight) * nearest
                gain[picked] = -np.inf
                picked.append(int(np.argmax(gain)))
                nearest = np.maximum(nearest, between[picked[-1]])
        order = sorted(picked, key=lambda i: -sim[i])
        return pd.DataFrame({"query_id": frame["query_id"].iloc[0], id_col: frame[id_col].to_numpy()[order], "sim": sim[order], "mmr_rank": np.arange(len(order), dtype=np.int32)})

    return rows.groupBy("query_id").applyInPandas(choose, schema)


def overlaps(rows: DataFrame, questions: DataFrame) -> DataFrame:
    """``rows`` with ``_lexical``, the token overlap of question with section and body, ``_plain``: the question has no token to compare, and ``_section``."""
    rows = rows.join(F.broadcast(questions.select("query_id", "terms", "phrases", "has_focus", "rerank_terms")), "query_id")
    share = lambda c: F.size(F.array_intersect(F.col("rerank_terms"), X.overlap_tokens(F.col(c)))) / F.greatest(F.lit(1), F.size("rerank_terms"))
    rows = rows.withColumn("_lexical", 0.35 * share("section_path_str") + 0.65 * share("text")).withColumn("_plain", F.size("rerank_terms") == 0)
    if "_section" not in rows.columns:
        rows = rows.withColumn("_section", section_factors(F.col("section_path_str"), F.col("text")))
    return rows.drop("terms", "phrases", "has_focus", "rerank_terms")


def hybrid_rerank(candidates: DataFrame, questions: DataFrame, top_k: int, alpha: float = 0.30, id_col: str = "vector_id") -> DataFrame:
    """``score`` and ``rank`` (from 1) of each query's ``top_k``: normalised fused score and token overlap with section and body, times the multipliers.

    Where a question has no token to compare, the fused score decides. Candidates may come from ``overlaps``, without texts then.
    """
    a = min(max(alpha, 0.05), 0.95)
    rows = candidates if "_lexical" in candidates.columns else overlaps(candidates, questions)
    own = W.partitionBy("query_id")
    low, high = F.min("fused").over(own), F.max("fused").over(own)
    sem = F.when(high > low, (F.col("fused") - low) / (high - low)).otherwise(1.0)
    combined = (a * sem + (1 - a) * F.col("_lexical")) * F.col("_section")
    scored = rows.withColumn("score", F.when(F.col("_plain"), F.col("fused")).otherwise(combined))
    ranked = scored.withColumn("rank", F.row_number().over(own.orderBy(F.desc("score"), id_col)))
    return ranked.where(F.col("rank") <= top_k).drop("_lexical", "_plain", "_section")


def top_fused(candidates: DataFrame, top_k: int, id_col: str = "vector_id") -> DataFrame:
    ranked = candidates.withColumn("score", F.col("fused")).withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("fused"), id_col)))
    return ranked.where(F.col("rank") <= top_k)
