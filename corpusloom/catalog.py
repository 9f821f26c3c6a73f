"""Queries of the engine's operators over the test tables, each with DuckDB SQL for the same rows where SQL can say it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from . import fixtures as fx
from .functions import answers, speech
from .functions import text as X
from .operators import chat, chunking, dashboard, expand, exports, images, ingest, rank, vocab
from .operators.postings import PostingsIndex
from .operators.vector_index import VectorIndex
from .plans.config import RetrievalConfig
from .plans.retrieval import retrieve
from .session import read_table
from .sources.shared import drop_later, shared_dir

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

TERMS = ("the", "and", "onen")


def query(sql: str | None = None):
    """Register a function under its name, with its SQL."""

    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return put


def r6(c, digits: int = 6):
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


def docs_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents")


def first_question(spark: SparkSession, sf_dir: str, text: str = " ".join(TERMS)) -> DataFrame:
    """One query: vector 0 and literal terms."""
    vec = read_table(spark, sf_dir, "embeddings").where("vec_id = 0").select(F.lit(0).cast("bigint").alias("query_id"), F.col("embedding").cast("array<double>").alias("query_vec"))
    return vec.withColumn("bm25_terms", X.words(TERMS)).withColumn("question", F.lit(text))


DENSE = "f_dense AS (SELECT v.*, list_inner_product(v.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS dense FROM f_vec v, (SELECT embedding FROM embeddings WHERE vec_id=0) q)"
BM25 = """f_tok AS (SELECT vector_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM f_pool),
f_len AS (SELECT vector_id, greatest(1, len(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS dl FROM f_pool),
f_tf AS (SELECT vector_id, term, count(*) AS f FROM f_tok WHERE term IN ('the','and','onen') GROUP BY ALL),
f_df AS (SELECT term, count(*) AS df FROM f_tf GROUP BY term),
f_n AS (SELECT count(*) AS n, avg(dl) + 1e-6 AS avgdl FROM f_len),
f_bm AS (SELECT vector_id, sum(ln((n-df+0.5)/(df+0.5)+1.0)*f*2.2/(f+1.2*(0.25+0.75*dl/avgdl)+1e-8)) AS bm25 FROM f_tf JOIN f_df USING(term) JOIN f_len USING(vector_id), f_n GROUP BY vector_id),
f_scored AS (SELECT p.*, coalesce(bm25, 0.0) AS bm25 FROM f_pool p LEFT JOIN f_bm USING(vector_id))"""
RRF = """f_rank AS (SELECT *, row_number() OVER (ORDER BY dense DESC, vector_id)-1 AS dense_rank, row_number() OVER (ORDER BY bm25 DESC, vector_id)-1 AS bm25_rank FROM f_scored),
f_rrf AS (SELECT *, 1.0/(58+dense_rank)+1.0/(58+bm25_rank) AS rrf FROM f_rank)"""
POOL = "f_pool AS (SELECT * FROM f_dense ORDER BY dense DESC, vector_id LIMIT 100)"


def dense_pool(spark: SparkSession, sf_dir: str, k: int = 100) -> tuple[DataFrame, DataFrame]:
    q = first_question(spark, sf_dir)
    return q, rank.dense_topk(fx.vectors(spark, sf_dir), q.select("query_id", "query_vec"), k)


# ---------------------------------------------------------------- retrieval


@query(f"WITH {fx.VECTORS}, {DENSE}, f_pool AS (SELECT * FROM f_dense), {BM25}, {RRF} SELECT vector_id, round(dense,6) AS dense, round(bm25,6) AS bm25, round(rrf,8) AS rrf FROM f_rrf ORDER BY rrf DESC, vector_id LIMIT 20")
def hybrid_topk(spark, sf_dir):
    """Dense ranking and BM25 over the corpus, joined by reciprocal ranks."""
    q = first_question(spark, sf_dir).drop("question")
    return rank.hybrid_search(fx.vectors(spark, sf_dir), q, 20).select("vector_id", r6("dense").alias("dense"), r6("bm25").alias("bm25"), r6("rrf", 8).alias("rrf"))


@query(f"WITH {fx.VECTORS}, {DENSE} SELECT vector_id, round(dense,6) AS dense, row_number() OVER (ORDER BY dense DESC, vector_id)-1 AS dense_rank FROM f_dense QUALIFY dense_rank < 20")
def dense_topk(spark, sf_dir):
    return dense_pool(spark, sf_dir, 20)[1].select("vector_id", r6("dense").alias("dense"), F.col("dense_rank").cast("bigint").alias("dense_rank"))


@query(f"""WITH {fx.VECTORS}, q AS (SELECT vec_id AS query_id, embedding FROM embeddings WHERE vec_id % 50 = 0),
s AS (SELECT query_id, vector_id, list_inner_product(v.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS dense FROM f_vec v, q)
SELECT query_id, vector_id, round(dense,6) AS dense, row_number() OVER (PARTITION BY query_id ORDER BY dense DESC, vector_id)-1 AS dense_rank FROM s QUALIFY dense_rank < 10""")
def dense_topk_batch(spark, sf_dir):
    """Every vector whose id is divisible by 50 asks, in one plan."""
    return rank.nearest_ids(fx.vectors(spark, sf_dir), asking(spark, sf_dir), 10).select("query_id", "vector_id", r6("dense").alias("dense"), F.col("dense_rank").cast("bigint").alias("dense_rank"))


def asking(spark, sf_dir: str) -> DataFrame:
    """Every vector whose id is divisible by 50 asks."""
    return read_table(spark, sf_dir, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").cast("array<double>").alias("query_vec"))


def stored_index(spark, sf_dir: str) -> VectorIndex:
    path = f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"
    drop_later(path)
    drop_later(path + "_cells")
    return VectorIndex.build(fx.vectors(spark, sf_dir), path)


@query(f"""WITH {fx.VECTORS}, q AS (SELECT vec_id AS query_id, embedding FROM embeddings WHERE vec_id % 50 = 0),
s AS (SELECT query_id, vector_id, doc_name, list_inner_product(v.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS dense FROM f_vec v, q)
SELECT query_id, vector_id, doc_name, round(dense,6) AS dense, row_number() OVER (PARTITION BY query_id ORDER BY dense DESC, vector_id)-1 AS dense_rank FROM s QUALIFY dense_rank < 10""")
def indexed_topk(spark, sf_dir):
    """Exact answers from the stored index: cells are left out by their bounds only; chunks are read from the cells of the answers."""
    index, q = stored_index(spark, sf_dir), asking(spark, sf_dir)
    found = index.fetch(index.search(q, 10), q.count(), 10)
    return found.select("query_id", "vector_id", "doc_name", r6("dense").alias("dense"), F.col("dense_rank").cast("bigint").alias("dense_rank"))


@query()
def ann_topk(spark, sf_dir):
    """Approximate: as many cells a question as a sample needs for a recall of 0.92; its test measures the recall against brute force."""
    index, q = stored_index(spark, sf_dir), asking(spark, sf_dir)
    return index.search(q, 10, index.fitted_probe(10)).select("query_id", "vector_id", r6("dense").alias("dense"), F.col("dense_rank").cast("bigint").alias("dense_rank"))


@query("""SELECT vec_id, round(sqrt(list_sum(list_transform(u, lambda x: x*x))),6) AS norm, round(u[1],6) AS first FROM
(SELECT vec_id, list_transform(e, lambda x: x/greatest(sqrt(list_sum(list_transform(e, lambda y: y*y))),1e-12)) AS u FROM (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x*3) AS e FROM embeddings))""")
def l2_normalize(spark, sf_dir):
    v = read_table(spark, sf_dir, "embeddings").withColumn("u", rank.l2_normalize(F.transform("embedding", lambda x: x.cast("double") * 3)))
    return v.select("vec_id", r6(F.sqrt(rank.dot(F.col("u"), F.col("u")))).alias("norm"), r6(F.col("u")[0]).alias("first"))


@query("""WITH p AS (SELECT label AS query_id, i, avg(embedding[i]::DOUBLE) AS x FROM embeddings, unnest(generate_series(1,64)) t(i) GROUP BY ALL),
v AS (SELECT query_id, list(x ORDER BY i) AS m FROM p GROUP BY query_id)
SELECT query_id::BIGINT AS query_id, i::BIGINT AS i, round(m[i]/greatest(sqrt(list_sum(list_transform(m, lambda y: y*y))),1e-12),6) AS x FROM v, unnest(generate_series(1,64)) t(i)""")
def mean_vectors(spark, sf_dir):
    """The normalised mean vector of each label, as for a question's variants."""
    rows = read_table(spark, sf_dir, "embeddings").select(F.col("label").cast("bigint").alias("query_id"), "embedding")
    means = rank.fused_query_vectors(rows)
    return means.select("query_id", F.posexplode("query_vec").alias("p", "x")).select("query_id", (F.col("p") + 1).cast("bigint").alias("i"), r6("x").alias("x"))


@query(f"WITH {fx.VECTORS}, {DENSE}, f_pool AS (SELECT * FROM f_dense), {BM25} SELECT vector_id, round(bm25,6) AS bm25 FROM f_scored WHERE bm25 > 0")
def bm25_corpus(spark, sf_dir):
    q = first_question(spark, sf_dir).select("query_id", "bm25_terms")
    return rank.corpus_scores(fx.vectors(spark, sf_dir), q).where("bm25 > 0").select("vector_id", r6("bm25").alias("bm25"))


def stored_postings(spark, sf_dir: str, segment: int = 64) -> PostingsIndex:
    path = f"{shared_dir(spark)}/postings-{uuid.uuid4().hex}"
    drop_later(path)
    drop_later(path + "_facts")
    return PostingsIndex.build(fx.vectors(spark, sf_dir), path, buckets=16, segment=segment)


@query(f"WITH {fx.VECTORS}, {DENSE}, f_pool AS (SELECT * FROM f_dense), {BM25} SELECT vector_id, round(bm25,6) AS bm25 FROM f_scored WHERE bm25 > 0")
def bm25_postings(spark, sf_dir):
    """All chunks with a term, from the stored postings: the rows of ``bm25_corpus``."""
    q = first_question(spark, sf_dir).select("query_id", "bm25_terms")
    return stored_postings(spark, sf_dir).search(q, None).select(F.col("id").alias("vector_id"), r6("bm25").alias("bm25"))


@query(f"WITH {fx.VECTORS}, {DENSE}, f_pool AS (SELECT * FROM f_dense), {BM25} SELECT vector_id, round(bm25,6) AS bm25 FROM f_scored WHERE bm25 > 0 ORDER BY f_scored.bm25 DESC, vector_id LIMIT 20")
def bm25_postings_topk(spark, sf_dir):
    """The best of them, with segments skipped by their bounds."""
    q = first_question(spark, sf_dir).select("query_id", "bm25_terms")
    return stored_postings(spark, sf_dir, 16).search(q, 20).select(F.col("id").alias("vector_id"), r6("bm25").alias("bm25"))


@query(f"WITH {fx.VECTORS}, {DENSE}, {POOL}, {BM25} SELECT vector_id, round(bm25,6) AS bm25 FROM f_scored")
def bm25_pool(spark, sf_dir):
    q, pool = dense_pool(spark, sf_dir)
    return rank.bm25(pool, q).select("vector_id", r6("bm25").alias("bm25"))


@query(f"WITH {fx.VECTORS}, {DENSE}, {POOL}, {BM25}, {RRF} SELECT vector_id, dense_rank, bm25_rank, round(rrf,8) AS rrf FROM f_rrf")
def rrf_fusion(spark, sf_dir):
    q, pool = dense_pool(spark, sf_dir)
    return rank.fuse(rank.bm25(pool, q)).select("vector_id", F.col("dense_rank").cast("bigint").alias("dense_rank"), F.col("bm25_rank").cast("bigint").alias("bm25_rank"), r6("rrf", 8).alias("rrf"))


MINMAX = """f_mm AS (SELECT *, CASE WHEN max(dense) OVER () - min(dense) OVER () < 1e-8 THEN 1.0 ELSE (dense-min(dense) OVER ())/(max(dense) OVER ()-min(dense) OVER ()+1e-8) END AS dn,
CASE WHEN max(bm25) OVER () - min(bm25) OVER () < 1e-8 THEN 1.0 ELSE (bm25-min(bm25) OVER ())/(max(bm25) OVER ()-min(bm25) OVER ()+1e-8) END AS bn,
CASE WHEN max(rrf) OVER () - min(rrf) OVER () < 1e-8 THEN 1.0 ELSE (rrf-min(rrf) OVER ())/(max(rrf) OVER ()-min(rrf) OVER ()+1e-8) END AS rn FROM f_rrf),
f_fused AS (SELECT *, 0.75*(0.35*dn+0.65*bn)+0.25*rn AS fused FROM f_mm)"""


@query(f"WITH {fx.VECTORS}, {DENSE}, {POOL}, {BM25}, {RRF}, {MINMAX} SELECT vector_id, round(fused,6) AS fused FROM f_fused")
def minmax_fusion(spark, sf_dir):
    q, pool = dense_pool(spark, sf_dir)
    return rank.fuse(rank.bm25(pool, q)).select("vector_id", r6("fused").alias("fused"))


@query(f"""WITH {fx.VECTORS}, {DENSE}, {POOL}, {BM25}, {RRF}, {MINMAX}, c AS (SELECT * FROM f_fused ORDER BY fused DESC, vector_id LIMIT 60)
SELECT vector_id, doc_name, chunk_index, round(fused,6) AS fused FROM c QUALIFY row_number() OVER (PARTITION BY doc_name, chunk_index ORDER BY fused DESC, vector_id)=1""")
def dedupe_keep_first(spark, sf_dir):
    q, pool = dense_pool(spark, sf_dir)
    kept = rank.cut_and_dedupe(rank.fuse(rank.bm25(pool, q)), 60, ("doc_name", "chunk_index"))
    return kept.select("vector_id", "doc_name", "chunk_index", r6("fused").alias("fused"))


@query()
def mmr_select(spark, sf_dir):
    """Greedy choice: not said in SQL; its test redoes it in plain Python."""
    q, pool = dense_pool(spark, sf_dir)
    fused = rank.fuse(rank.bm25(pool, q))
    return rank.mmr(fused, q, 28).select("query_id", "vector_id", r6("sim").alias("sim"), "mmr_rank")


@query()
def retrieve_context(spark, sf_dir):
    """The whole plan for a table of questions: every fiftieth chunk's vector, with its section as what is asked for."""
    chunks = fx.stored_vectors(spark, sf_dir)
    asked = chunks.where("vector_id % 50 = 0").select(F.col("vector_id").alias("query_id"), F.concat(F.lit("what is the "), F.col("section_path_str"), F.lit(" of the machine")).alias("question"), F.col("embedding").cast("array<double>").alias("query_vec"))
    found = retrieve(chunks, asked, RetrievalConfig(min_hybrid_rerank_score=0.0))
    return found.context.select("query_id", "position", "vector_id", "doc_name", F.char_length("text").alias("n_chars"), r6("score", 5).alias("score"))


# ---------------------------------------------------------------- multipliers


@query("SELECT doc_id, CASE WHEN n<60 THEN 0.35 WHEN n<120 THEN 0.55 WHEN n<180 THEN 0.85 ELSE 1.0 END::DOUBLE AS m FROM (SELECT doc_id, length(regexp_replace(text,'^[\\s\\p{Z}]+|[\\s\\p{Z}]+$','','g')) AS n FROM documents)")
def thin_chunk(spark, sf_dir):
    return docs_of(spark, sf_dir).select("doc_id", X.thin_chunk(F.col("text")).alias("m"))


STRIP = "regexp_replace({},'^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$','','g')"
NORM = "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower({}),'^#+\\s*',''),'^[ivxlc]+\\.\\s*',''),'[^a-z0-9\\s]',' ','g'),'\\s+',' ','g'))".format(STRIP.format("section_path_str"))


@query(f"""WITH {fx.VECTORS} SELECT vector_id, CASE WHEN n<100 AND regexp_matches(norm,'^model\\b') THEN 0.45 WHEN n<80 THEN 0.55 ELSE 1.0 END::DOUBLE AS m
FROM (SELECT *, length({STRIP.format("text")}) AS n, {NORM} AS norm FROM f_vec)""")
def title_only(spark, sf_dir):
    return fx.vectors(spark, sf_dir).select("vector_id", X.title_only(F.col("section_path_str"), F.col("text")).alias("m"))


@query("""SELECT doc_id, CASE WHEN t = '' THEN 1.0 ELSE round(0.78+0.5*((CASE WHEN contains(t,'onen') THEN 1 ELSE 0 END)+(CASE WHEN contains(t,'ther') THEN 1 ELSE 0 END)+(CASE WHEN contains(t,'ight') THEN 1 ELSE 0 END))/3,6) END::DOUBLE AS m FROM (SELECT doc_id, lower(coalesce(text,'')) AS t FROM documents)""")
def term_coverage(spark, sf_dir):
    return docs_of(spark, sf_dir).select("doc_id", r6(X.term_coverage(F.col("text"), X.words(("onen", "ther", "ight", "onen")))).alias("m"))


NOISE_SQL = X.NOISE_PATTERN[4:].replace("'", "''")
TECH_SQL = X.TECH_PATTERN[4:].replace("'", "''")


@query(f"""SELECT item_id, CASE WHEN regexp_matches(t,'(?i){NOISE_SQL}') AND NOT regexp_matches(t,'(?i){TECH_SQL}') THEN 0.32 ELSE 1.0 END::DOUBLE AS m FROM
(SELECT item_id, CASE item_id%4 WHEN 0 THEN 'ISO 9001 quality  management system ' WHEN 1 THEN 'about this document: voltage ' WHEN 2 THEN 'Registered Trademarks ' ELSE '' END || text AS t FROM benchmark)""")
def boilerplate(spark, sf_dir):
    k = F.col("item_id") % 4
    head = F.when(k == 0, "ISO 9001 quality  management system ").when(k == 1, "about this document: voltage ").when(k == 2, "Registered Trademarks ").otherwise("")
    return read_table(spark, sf_dir, "benchmark").select("item_id", X.boilerplate(F.concat(head, F.col("text"))).alias("m"))


SECTIONS = """SELECT doc_id, CASE doc_id%6 WHEN 0 THEN '# II. Model X-100' WHEN 1 THEN 'Vacuum pump settings!' WHEN 2 THEN 'Overview' WHEN 3 THEN 'Technical Parameters' WHEN 4 THEN 'pump and settings guide' ELSE '' END AS section FROM documents"""


def sections(spark, sf_dir):
    k = F.col("doc_id") % 6
    title = F.when(k == 0, "# II. Model X-100").when(k == 1, "Vacuum pump settings!").when(k == 2, "Overview").when(k == 3, "Technical Parameters").when(k == 4, "pump and settings guide").otherwise("")
    return docs_of(spark, sf_dir).select("doc_id", title.alias("section"))


@query(f"""SELECT doc_id, CASE doc_id%6 WHEN 1 THEN 1.55 WHEN 4 THEN round(1+0.35*2/3,6) ELSE 1.0 END::DOUBLE AS plain, CASE doc_id%6 WHEN 0 THEN 1.0 WHEN 2 THEN 0.58 ELSE 1.0 END::DOUBLE AS generic,
CASE WHEN doc_id%6=0 THEN 0.62 WHEN doc_id%6=1 THEN 1.55 WHEN doc_id%6=4 THEN round(1+0.35*2/3,6) ELSE 1.0 END::DOUBLE AS focused, CASE doc_id%6 WHEN 3 THEN 1.22 ELSE 1.0 END::DOUBLE AS spec FROM ({SECTIONS})""")
def section_multipliers(spark, sf_dir):
    terms, phrases = X.words(("vacuum", "pump", "settings")), X.words(("vacuum pump settings", "vacuum pump", "pump settings"))
    s = F.col("section")
    return sections(spark, sf_dir).select("doc_id", r6(X.section_match(s, F.lit(False), terms, phrases)).alias("plain"), X.generic_section(s, phrases).alias("generic"), r6(X.section_match(s, F.lit(True), terms, phrases)).alias("focused"), X.spec_section(s, terms).alias("spec"))


# ---------------------------------------------------------------- tokens and vocabulary


@query("SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text),'[a-z0-9]+')) AS term FROM documents) GROUP BY term")
def doc_freq(spark, sf_dir):
    """Distinct per document, so repeated rows count each."""
    return vocab.document_frequencies(docs_of(spark, sf_dir)).select("term", "df")


@query("SELECT doc_id, term, count(*) AS tf, any_value(n) AS doc_len FROM (SELECT doc_id, greatest(1, len(t)) AS n, unnest(t) AS term FROM (SELECT doc_id, regexp_extract_all(lower(text),'[a-z0-9]+') AS t FROM documents)) GROUP BY doc_id, term")
def term_freq(spark, sf_dir):
    return vocab.term_frequencies(docs_of(spark, sf_dir), "doc_id").select("doc_id", "term", "tf", F.col("doc_len").cast("bigint").alias("doc_len"))


def _stops(values) -> str:
    return "[" + ",".join(f"'{v}'" for v in values) + "]"


@query(f"SELECT doc_id, len(list_filter(regexp_extract_all(lower(text),'[a-z]{{3,}}'), lambda x: NOT list_contains({_stops([*X.QUESTION_STOPS, *X.BASELINE_GENERIC])}, x)))::BIGINT AS n FROM documents")
def lexical_terms(spark, sf_dir):
    return docs_of(spark, sf_dir).select("doc_id", F.size(X.lexical_terms(F.col("text"))).cast("bigint").alias("n"))


def _stem_sql(t: str) -> str:
    cases = " ".join(f"WHEN ends_with({t},'{s}') AND length({t})-{len(s)}>=4 THEN left({t},length({t})-{len(s)})" for s in X.SUFFIXES)
    return f"CASE WHEN length({t})<2 THEN '' WHEN length({t})<=4 THEN {t} {cases} ELSE {t} END"


@query(f"SELECT s AS stem, count(*) AS n FROM (SELECT {_stem_sql('t')} AS s FROM (SELECT unnest(list_filter(regexp_extract_all(lower(text),'[a-z0-9]+'), lambda x: NOT list_contains({_stops(X.OVERLAP_STOPS)}, x))) AS t FROM documents)) WHERE length(s)>=2 AND NOT list_contains({_stops(X.OVERLAP_STOPS)}, s) GROUP BY s")
def overlap_stems(spark, sf_dir):
    return docs_of(spark, sf_dir).select(F.explode(X.overlap_tokens(F.col("text"))).alias("stem")).groupBy("stem").agg(F.count("*").alias("n"))


COUNTERS = f"""f_t AS (SELECT doc_name, text, length(regexp_replace(text,'^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$','','g')) AS n, regexp_extract_all(lower(regexp_replace(doc_name,'[()\\[\\]_\\-]+',' ','g')),'[a-z0-9]+') || regexp_extract_all(lower(coalesce(section_path_str,'')),'[a-z0-9]+') AS tt FROM f_chunk),
f_title AS (SELECT doc_name, n, unnest(list_distinct(list_filter(tt, lambda x: length(x)>=3 AND NOT regexp_full_match(x,'[0-9]+') AND NOT list_contains({_stops(X.TITLE_SKIP)}, x)))) AS token FROM f_t),
f_body AS (SELECT n, unnest(list_distinct(list_filter(regexp_extract_all(lower(text),'[a-z0-9]+'), lambda x: length(x)>=3))) AS token FROM f_t),
f_tc AS (SELECT token, count(*) AS title_hits, count(DISTINCT doc_name) AS title_docs, count(*) FILTER (n<100) AS short_header_hits FROM f_title GROUP BY token),
f_bc AS (SELECT token, count(*) AS body_hits, count(*) FILTER (n>=120) AS long_body_hits FROM f_body GROUP BY token),
f_c AS (SELECT token, coalesce(title_hits,0) AS title_hits, coalesce(title_docs,0) AS title_docs, coalesce(body_hits,0) AS body_hits, coalesce(long_body_hits,0) AS long_body_hits, coalesce(short_header_hits,0) AS short_header_hits FROM f_tc FULL JOIN f_bc USING(token))"""


@query(f"WITH {fx.CHUNKS}, {COUNTERS} SELECT * FROM f_c")
def vocab_counters(spark, sf_dir):
    return vocab.token_counters(fx.chunks(spark, sf_dir))


RULES = f"""f_r AS (SELECT token, title_docs >= greatest(2, floor(nd*0.4)) AS r1, short_header_hits>=2 AND long_body_hits < greatest(2, short_header_hits*0.25) AND title_hits>=2 AS r2,
title_hits>0 AND title_hits/greatest(1,nc)>=0.12 AND body_hits/greatest(1,title_hits)<0.45 AS r3 FROM f_c, (SELECT count(*) AS nc, count(DISTINCT doc_name) AS nd FROM f_chunk) WHERE NOT list_contains({_stops(X.QUESTION_STOPS)}, token))"""


def _rule(k: str):
    def run(spark, sf_dir):
        return vocab.named_by_rules(fx.chunks(spark, sf_dir)).where(k).select("token")

    run.__name__ = f"corpus_vocab_{k}"
    return query(f"WITH {fx.CHUNKS}, {COUNTERS}, {RULES} SELECT token FROM f_r WHERE {k}")(run)


for _k in ("r1", "r2", "r3"):
    _rule(_k)


@query(f"WITH {fx.TITLED}, {COUNTERS}, {RULES} SELECT token, r1, r2, r3 FROM f_r WHERE r1 OR r2 OR r3")
def corpus_vocab_titled(spark, sf_dir):
    """Documents that are all named alike: their words are in all titles and hardly in bodies, so that every rule has something to name."""
    return vocab.named_by_rules(fx.titled(spark, sf_dir))


@query(f"WITH {fx.TITLED.replace('FROM documents)', 'FROM documents WHERE doc_id % 5 <> 0)')}, {COUNTERS} SELECT * FROM f_c")
def vocab_kept_up_to_date(spark, sf_dir):
    """The counters after documents came in two changes and some went in a third, one of them offered twice."""
    path = f"{shared_dir(spark)}/vocabulary-{uuid.uuid4().hex}"
    drop_later(path)
    log, chunks = vocab.VocabularyLog(spark, path), fx.titled(spark, sf_dir)
    log.change("first", chunks.where("doc_id % 3 <> 0"))
    for _ in range(2):
        log.change("second", chunks.where("doc_id % 3 = 0"))
    log.change("third", removed=chunks.where("doc_id % 5 = 0"))
    return log.counters()


@query(f"WITH {fx.CHUNKS}, {COUNTERS}, {RULES} SELECT DISTINCT token FROM (SELECT token FROM f_r WHERE r1 OR r2 OR r3 UNION ALL SELECT unnest({_stops([*X.BASELINE_GENERIC, 'widget'])}) AS token) WHERE token NOT IN ('manual')")
def generic_terms(spark, sf_dir):
    return vocab.generic_terms(fx.chunks(spark, sf_dir), (" Widget ",), ("manual",))


# ---------------------------------------------------------------- text


@query("SELECT item_id, regexp_replace(t,'^[\\s\\p{Z}]+|[\\s\\p{Z}]+$','','g') AS clean FROM (SELECT item_id, 'intro'||chr(10)||CASE WHEN item_id%2=0 THEN '' ELSE 'Pump view'||chr(10) END||'tail '||text AS t FROM benchmark)")
def strip_images(spark, sf_dir):
    """Generic alt texts leave a break, others their own line."""
    alt = F.when(F.col("item_id") % 2 == 0, "Image").otherwise("Pump view")
    md = F.concat(F.lit("intro  "), F.lit("!["), alt, F.lit("](data:image/png;base64,AAAA)"), F.lit("tail "), F.col("text"))
    return read_table(spark, sf_dir, "benchmark").select("item_id", X.strip_embedded_images(md).alias("clean"))


@query("SELECT doc_id, 'Title '||doc_id AS heading, 'title '||doc_id AS first_line FROM documents")
def headings(spark, sf_dir):
    md = fx.marked_up(spark, sf_dir)
    return md.select("doc_id", X.first_heading(F.col("md")).alias("heading"), X.first_line_plain(F.col("md")).alias("first_line"))


@query("SELECT doc_id, regexp_replace(source||'/'||lang||' (a).pdf','[^A-Za-z0-9_.-]','_','g') AS name FROM documents")
def safe_names(spark, sf_dir):
    return docs_of(spark, sf_dir).select("doc_id", X.safe_name(F.concat("source", F.lit("/"), "lang", F.lit(" (a).pdf")), "doc").alias("name"))


@query("SELECT event_id, CASE WHEN event_id%5=0 THEN nullif(event_id%7,0) WHEN event_id%5=1 THEN nullif(event_id%9,0) WHEN event_id%5=2 THEN NULL WHEN event_id%5=3 THEN NULL ELSE 12 END::BIGINT AS page, CASE WHEN event_id%5=0 THEN event_id%7 END::BIGINT AS ci FROM events")
def page_numbers(spark, sf_dir):
    e = F.col("event_id")
    raw = F.when(e % 5 == 0, (e % 7).cast("string")).when(e % 5 == 1, F.concat(F.lit("p. "), (e % 9).cast("string"))).when(e % 5 == 2, "").when(e % 5 == 3, "-1").otherwise("12-14")
    return read_table(spark, sf_dir, "events").select("event_id", X.parse_page(raw).alias("page"), X.parse_chunk_index(raw).alias("ci"))


@query("SELECT doc_id, len(regexp_extract_all(text,'[A-Za-z]'))::BIGINT AS latin FROM documents")
def latin_letters(spark, sf_dir):
    return docs_of(spark, sf_dir).select("doc_id", speech.count_of(F.col("text"), speech.LATIN).cast("bigint").alias("latin"))


@query("""SELECT item_id, CASE item_id%3 WHEN 0 THEN 'Hindi' WHEN 1 THEN 'Hinglish' ELSE 'English' END AS lang FROM benchmark""")
def language_routes(spark, sf_dir):
    k = F.col("item_id") % 3
    q = F.when(k == 0, "मशीन what").when(k == 1, "machine ka manual kya hai").otherwise("How to reset?")
    return read_table(spark, sf_dir, "benchmark").select("item_id", X.language_route(q).alias("lang"))


SPLIT = "regexp_split_to_array({}, '\\r\\n|\\r|\\n')"
DISCLAIMED = " OR ".join(f"contains(lower(x),'{d}')" for d in X.DISCLAIMERS)
NEGATIVE_SQL = X.NEGATIVE_LINE[4:]


@query(f"""WITH a AS (SELECT item_id, {STRIP.format(f"array_to_string(list_filter({SPLIT.format('t')}, lambda x: NOT ({DISCLAIMED})), chr(10))")} AS t FROM
(SELECT item_id, 'This is NOT specified in the provided context.'||chr(10)||'keep '||text||chr(10)||'End of answer'||chr(10)||'It does not mention '||text AS t FROM benchmark))
SELECT item_id, {STRIP.format(f"array_to_string(list_filter({SPLIT.format('t')}, lambda x: NOT regexp_matches(x,'(?i){NEGATIVE_SQL}')), chr(10))")} AS answer FROM a""")
def disclaimers_dropped(spark, sf_dir):
    """Whole texts, line by line: some lines hold disclaimers or say that nothing is told."""
    b = read_table(spark, sf_dir, "benchmark")
    t = F.concat(F.lit("This is NOT specified in the provided context.\nkeep "), F.col("text"), F.lit("\nEnd of answer\nIt does not mention "), F.col("text"))
    return b.select("item_id", X.without_negative_lines(X.without_disclaimers(t)).alias("answer"))


TOKS = lambda c: f"list_distinct(regexp_extract_all(lower({c}),'[a-z0-9]{{2,}}'))"


@query(f"""SELECT a, b, round(CASE WHEN len(x)=0 OR len(y)=0 THEN 0 ELSE len(list_intersect(x,y))/len(list_distinct(x||y)) END,6) AS jaccard, round(CASE WHEN len(x)=0 OR len(y)=0 THEN 0 ELSE len(list_intersect(x,y))/len(x) END,6) AS coverage,
(CASE WHEN len(x)=0 OR len(y)=0 THEN FALSE ELSE len(list_intersect(x,y))/len(x)>=0.72 OR len(list_intersect(x,y))/len(list_distinct(x||y))>=0.75 END) AS redundant
FROM (SELECT p.id AS a, q.id AS b, {TOKS('p.content')} AS x, {TOKS('q.content')} AS y FROM (SELECT conv_id*1000+turn AS id, conv_id, turn, text AS content FROM conversations) p JOIN (SELECT conv_id*1000+turn AS id, conv_id, turn, text AS content FROM conversations) q ON p.conv_id=q.conv_id AND q.turn=p.turn-1)""")
def turn_redundancy(spark, sf_dir):
    """Each turn against the one before it."""
    m = read_table(spark, sf_dir, "conversations")
    before = W.partitionBy("conv_id").orderBy("turn")
    rows = m.select("conv_id", "turn", "text", F.lag("text").over(before).alias("prev"), F.lag("turn").over(before).alias("prev_turn")).where(F.col("prev_turn") == F.col("turn") - 1)
    r = rows.select((F.col("conv_id") * 1000 + F.col("turn")).alias("a"), (F.col("conv_id") * 1000 + F.col("prev_turn")).alias("b"), X.token_redundancy(F.col("text"), F.col("prev")).alias("r"))
    return r.select("a", "b", r6("r.jaccard").alias("jaccard"), r6("r.coverage").alias("coverage"), F.col("r.redundant").alias("redundant"))


@query(f"SELECT doc_id, {STRIP.format('right(t,1400)')} AS tail FROM (SELECT doc_id, {STRIP.format('text')} AS t FROM documents)")
def draft_tails(spark, sf_dir):
    return docs_of(spark, sf_dir).select("doc_id", X.draft_tail(F.col("text")).alias("tail"))


@query()
def rolling_drafts(spark, sf_dir):
    """What each line of a text is told of the lines before it, as parts of an answer are; a fold, so its test redoes it in plain Python."""
    rows = docs_of(spark, sf_dir).select("doc_id", F.posexplode(answers.rolling_drafts(F.split("text", "\n"), 40)).alias("part", "draft"))
    return rows.select("doc_id", F.col("part").cast("bigint").alias("part"), "draft")


@query()
def answer_parts(spark, sf_dir):
    """What each line of a text lets through after what came before, as parts of an answer do; the stream's test has the same rows in pieces."""
    rows = docs_of(spark, sf_dir).select("doc_id", F.posexplode(answers.streamed_parts(F.split("text", "\n"), 40)).alias("part", "s"))
    return rows.select("doc_id", F.col("part").cast("bigint").alias("part"), "s.draft", "s.text")


@query("SELECT doc_id, sha256(text) AS fp FROM documents")
def fingerprints(spark, sf_dir):
    return ingest.fingerprint(docs_of(spark, sf_dir), "text").select("doc_id", F.col("doc_fingerprint").alias("fp"))


@query("SELECT doc_id, (i)::BIGINT AS pos, substr(text, i*56+1, 56) AS piece FROM documents, unnest(generate_series(0, (length(text)-1)//56)) t(i) WHERE length(text) > 0")
def delta_slices(spark, sf_dir):
    d = docs_of(spark, sf_dir)
    return d.select("doc_id", F.posexplode(X.delta_slices(F.col("text"))).alias("pos", "piece")).select("doc_id", F.col("pos").cast("bigint").alias("pos"), "piece")


# ---------------------------------------------------------------- chunking


@query("""SELECT doc_id, i::BIGINT AS pos, substr(t, i*180+1, 200) AS n_text FROM (SELECT doc_id, regexp_replace(text,'[\\s\\p{Z}]+','x','g') AS t FROM documents) d, unnest(generate_series(0, greatest(0,(length(t)-20-1))//180)) s(i) WHERE length(t) > 0""")
def chunk_hard_slice(spark, sf_dir):
    """Each whole text as one paragraph: slices of 200 characters that overlap by 20; shorter texts are a chunk each."""
    d = docs_of(spark, sf_dir).select("doc_id", F.regexp_replace("text", r"[\s\p{Z}]+", "x").alias("t"))
    return d.select("doc_id", F.posexplode(chunking.chunk_array(F.col("t"), 200, 20)).alias("pos", "n_text")).select("doc_id", F.col("pos").cast("bigint").alias("pos"), "n_text")


@query()
def chunk_markdown(spark, sf_dir):
    """Greedy joining is a fold; its test redoes it in plain Python."""
    md = docs_of(spark, sf_dir).select("doc_id", F.regexp_replace("text", "\n", "\n\n").alias("md"))
    return chunking.chunk_markdown(md, 1200, 150)


@query("""SELECT doc_id, 0::BIGINT AS chunk_index, 1::BIGINT AS page_number, 'Title '||doc_id AS section_heading FROM documents UNION ALL SELECT doc_id, 1, 3, 'Part '||lang FROM documents""")
def page_sections(spark, sf_dir):
    """Pages and headings without size limits; the blank page keeps its number. Texts hold no heading lines."""
    md = fx.marked_up(spark, sf_dir).select("doc_id", "md")
    return chunking.chunk_markdown(md, 0).select("doc_id", "chunk_index", "page_number", "section_heading")


@query(f"""WITH {fx.CHUNKS}, s AS (SELECT *, nullif(regexp_replace(coalesce(section_path_str,''),'^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$','','g'),'') AS own FROM f_chunk),
f AS (SELECT *, last_value(own IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY chunk_index ROWS UNBOUNDED PRECEDING) AS path FROM s)
SELECT vector_id, coalesce(path, section_path_str) AS section_path_str FROM f""")
def section_forward_fill(spark, sf_dir):
    return chunking.forward_fill_sections(fx.chunks(spark, sf_dir), ("doc_id",)).select("vector_id", "section_path_str")


@query(f"""WITH {fx.SEGMENTS} SELECT doc_name, string_agg(text, ' ' ORDER BY seg_no) AS content, t_from//60000+1 AS page_number, (t_from//60000)*60 AS start_sec, (t_from//60000)*60+60 AS end_sec FROM f_segment GROUP BY doc_name, t_from//60000""")
def minute_buckets(spark, sf_dir):
    return chunking.minute_buckets(fx.segments(spark, sf_dir)).select("doc_name", "content", "page_number", "start_sec", "end_sec")


@query("SELECT event_id, CASE WHEN event_id>=3600 THEN format('{:02d}:', event_id//3600) ELSE '' END||format('{:02d}:{:02d}', (event_id//60)%60, event_id%60) AS clock, event_id AS back FROM events")
def clock_labels(spark, sf_dir):
    label = F.substring_index(X.range_label(F.col("event_id"), F.col("event_id")), "-", 1)
    return read_table(spark, sf_dir, "events").select("event_id", label.alias("clock"), X.parse_clock(label).alias("back"))


@query("""WITH d AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id)-1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM documents)
SELECT lang AS doc_name, k*90 AS start_i, least(k*90+100, any_value(n)) AS end_i, count(*) AS n FROM d, unnest(generate_series(0, greatest(0, ceil((n-100)/90.0)::BIGINT))) t(k) WHERE pos >= k*90 AND pos < k*90+100 GROUP BY lang, k""")
def ground_windows(spark, sf_dir):
    rows = docs_of(spark, sf_dir).withColumn("pos", F.row_number().over(W.partitionBy("lang").orderBy("doc_id")) - 1).select(F.col("lang").alias("doc_name"), "pos", F.col("doc_id").alias("vector_id"))
    w = chunking.ground_windows(rows)
    return w.groupBy("doc_name", F.col("start_i").cast("bigint").alias("start_i"), F.col("end_i").cast("bigint").alias("end_i")).agg(F.count("*").alias("n"))


@query("""SELECT doc_id AS vector_id, lang AS doc_name, lang||'-ground-'||(dense_rank() OVER (PARTITION BY lang ORDER BY f)-1) AS ground_id FROM (SELECT *, min(doc_id) OVER (PARTITION BY lang, doc_id%13) AS f FROM documents)""")
def ground_labels(spark, sf_dir):
    rows = docs_of(spark, sf_dir).select(F.col("lang").alias("doc_name"), F.col("doc_id").alias("vector_id"), F.concat(F.lit("l"), (F.col("doc_id") % 13).cast("string")).alias("label"))
    return chunking.ground_ids(rows).select("vector_id", "doc_name", "ground_id")


@query("SELECT source AS tenant, doc_id AS old_id, row_number() OVER (ORDER BY source, doc_id)-1 AS vector_id FROM documents")
def renumber(spark, sf_dir):
    rows = docs_of(spark, sf_dir).select(F.col("source").alias("tenant"), F.col("doc_id").alias("vector_id"), F.col("doc_id").alias("old_id"))
    return chunking.renumber(rows, ("tenant", "vector_id")).select("tenant", "old_id", "vector_id")


@query("SELECT doc_id, rk, CASE WHEN rk<=2 THEN 0 ELSE 1+(rk-3)//5 END AS batch FROM (SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rk FROM documents)")
def head_then_rest(spark, sf_dir):
    rows = docs_of(spark, sf_dir).withColumn("rk", F.row_number().over(W.partitionBy("source").orderBy("doc_id")).cast("bigint"))
    return chunking.head_then_rest(rows, 2, 5, "rk").select("doc_id", "rk", "batch")


@query("SELECT doc_id, ntile(4) OVER (PARTITION BY source ORDER BY doc_id)-1 AS batch FROM documents")
def split_batches(spark, sf_dir):
    rows = docs_of(spark, sf_dir).select("doc_id", F.col("source").alias("doc_name"))
    return chunking.split_batches(rows, 4, "doc_id").select("doc_id", F.col("batch").cast("bigint").alias("batch"))


# ---------------------------------------------------------------- neighbours and packing


SEEDS = "f_seed AS (SELECT * FROM f_chunk WHERE doc_id % 50 = 0 AND chunk_index = 2)"


def seeds(spark, sf_dir):
    rows = fx.chunks(spark, sf_dir).where("doc_id % 50 = 0 and chunk_index = 2")
    return rows.withColumn("query_id", F.lit(0).cast("bigint")).withColumn("score", F.lit(1.0)).withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("vector_id")))


@query(f"WITH {fx.CHUNKS}, {SEEDS} SELECT DISTINCT c.vector_id, (c.chunk_index=2) AS seed FROM f_chunk c JOIN f_seed s ON c.doc_id=s.doc_id AND c.chunk_index BETWEEN greatest(0, s.chunk_index-5) AND s.chunk_index+1")
def neighbour_expand(spark, sf_dir):
    rows = expand.chunk_neighbours(seeds(spark, sf_dir), fx.chunks(spark, sf_dir), 5, 1)
    return rows.select("vector_id", (F.col("ord.kind") == 0).alias("seed"))


@query(f"""WITH {fx.CHUNKS}, f AS (SELECT *, 'sec_'||(chunk_index//4) AS sec FROM f_chunk), s AS (SELECT DISTINCT tenant, doc_name, sec FROM f WHERE doc_id%50=0 AND chunk_index=2)
SELECT vector_id, doc_id%50=0 AND chunk_index=2 AS seed FROM f JOIN s USING(tenant, doc_name, sec)""")
def section_expand(spark, sf_dir):
    own = F.concat(F.lit("sec_"), F.floor(F.col("chunk_index") / 4).cast("string"))
    chunks = fx.chunks(spark, sf_dir).withColumn("section_path_str", own)
    start = expand.chunk_neighbours(seeds(spark, sf_dir).withColumn("section_path_str", own), chunks, 0, 0)
    return expand.section_mates(start, chunks).select("vector_id", (F.col("ord.kind") == 0).alias("seed"))


@query(f"WITH {fx.CHUNKS}, {SEEDS}, r AS (SELECT *, row_number() OVER (ORDER BY vector_id) AS rk FROM f_seed) SELECT vector_id FROM r WHERE doc_name=(SELECT doc_name FROM r WHERE rk=1)")
def topdoc_restrict(spark, sf_dir):
    return expand.restrict_to_top_document(seeds(spark, sf_dir)).select("vector_id")


@query(f"""WITH {fx.CHUNKS}, o AS (SELECT *, sum(length(text)) OVER w AS run, row_number() OVER w AS rk FROM f_chunk WHERE regexp_matches(text,'[^\\s\\p{{Z}}]') WINDOW w AS (PARTITION BY doc_id ORDER BY page_number, chunk_index ROWS UNBOUNDED PRECEDING)),
c AS (SELECT *, lag(run,1,0::HUGEINT) OVER (PARTITION BY doc_id ORDER BY rk) AS before FROM o)
SELECT doc_id AS query_id, vector_id, (CASE WHEN run<=1500 THEN length(text) ELSE 1500-before END)::BIGINT AS n FROM c WHERE run<=1500 OR (before<1500 AND 1500-before>=280)""")
def pack_topdoc(spark, sf_dir):
    """Each document as the only one of its own query, packed into 1500 characters."""
    rows = fx.chunks(spark, sf_dir).withColumn("query_id", F.col("doc_id")).withColumn("ord", F.struct(F.lit(0).alias("kind"), F.col("chunk_index").alias("rank")))
    return expand.pack_top_document(rows, 1500).select("query_id", "vector_id", F.char_length("text").cast("bigint").alias("n"))


@query()
def pack_mixed(spark, sf_dir):
    """Skips what doesn't fit: a fold; its test redoes it in plain Python."""
    rows = fx.chunks(spark, sf_dir).withColumn("query_id", F.col("doc_id")).withColumn("ord", F.struct(F.lit(0).alias("kind"), F.col("chunk_index").alias("rank")))
    return expand.pack_mixed(rows, 1500).select("query_id", F.col("position").cast("bigint").alias("position"), "vector_id", F.char_length("text").cast("bigint").alias("n"))


@query(f"""WITH {fx.CHUNKS}, d AS (SELECT DISTINCT tenant, doc_id, doc_name FROM f_chunk), r AS (SELECT *, row_number() OVER (PARTITION BY tenant ORDER BY doc_id) AS rk FROM d)
SELECT substr(tenant,4)::BIGINT AS query_id, rk AS source_rank, doc_name FROM r WHERE rk<=3""")
def answer_sources(spark, sf_dir):
    rows = fx.chunks(spark, sf_dir).withColumn("query_id", F.substring("tenant", 4, 9).cast("bigint")).withColumn("timestamp", F.lit(None).cast("string"))
    rows = rows.withColumn("position", F.col("vector_id"))
    return expand.sources(rows).select("query_id", F.col("source_rank").cast("bigint").alias("source_rank"), "doc_name")


@query(f"""WITH {fx.CHUNKS}, p AS (SELECT doc_id AS query_id, 'Passage ['||(chunk_index+1)||'] — Document: '||doc_name||' | page '||page_number||CASE WHEN coalesce(section_path_str,'')<>'' THEN ' | section: '||section_path_str ELSE '' END||chr(10)||text AS t, chunk_index FROM f_chunk)
SELECT query_id, string_agg(t, chr(10)||chr(10) ORDER BY chunk_index) AS context FROM p GROUP BY query_id""")
def serialized_context(spark, sf_dir):
    rows = fx.chunks(spark, sf_dir).select(F.col("doc_id").alias("query_id"), (F.col("chunk_index") + 1).alias("position"), "doc_name", "page_number", F.lit(None).cast("string").alias("timestamp"), "section_path_str", "text")
    return expand.serialize(rows)


# ---------------------------------------------------------------- chat


@query(f"""WITH {fx.MESSAGES}, r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY id) AS n FROM f_message)
SELECT session_id, max(created_at) AS last_message_at, count(id) AS message_count, coalesce(max(content) FILTER (n=2), max(content) FILTER (n=1)) AS title FROM r GROUP BY session_id ORDER BY last_message_at DESC, session_id LIMIT 50""")
def session_list(spark, sf_dir):
    return chat.session_list(fx.sessions(spark, sf_dir), fx.messages(spark, sf_dir)).select("session_id", "last_message_at", "message_count", "title")


@query(f"WITH {fx.MESSAGES} SELECT session_id, created_at FROM f_message ORDER BY created_at DESC, session_id DESC LIMIT 1")
def latest_session(spark, sf_dir):
    return chat.latest_session(fx.messages(spark, sf_dir).select("session_id", "created_at"))


@query(f"WITH {fx.MESSAGES} SELECT id, role, content FROM f_message WHERE session_id = 3")
def session_messages(spark, sf_dir):
    m = fx.messages(spark, sf_dir).withColumn("sources_json", F.lit("not json")).withColumn("images_json", F.lit(None).cast("string"))
    return chat.session_messages(m, 3).select("id", "role", "content")


@query(f"WITH {fx.MESSAGES}, {fx.SOURCES} SELECT doc_name, doc_path, count(*) AS cnt FROM f_message JOIN f_source ON id=message_id GROUP BY doc_name, doc_path")
def document_usage(spark, sf_dir):
    return chat.document_usage(fx.messages(spark, sf_dir), fx.message_sources(spark, sf_dir))


@query(f"WITH {fx.MESSAGES}, {fx.SOURCES} SELECT session_id, max(id) AS last_id FROM f_message JOIN f_source ON id=message_id WHERE doc_name='doc_1' GROUP BY session_id")
def sessions_of_document(spark, sf_dir):
    return chat.sessions_of_document(fx.messages(spark, sf_dir), fx.message_sources(spark, sf_dir), "doc_1")


@query(f"WITH {fx.MESSAGES} SELECT id AS message_id, CASE WHEN id%3=0 THEN '(unknown)' ELSE 'd'||(id%5)||'.pdf' END AS doc_name, '/p/'||(id%5) AS doc_path FROM f_message WHERE id%4<>0")
def source_rows(spark, sf_dir):
    i = F.col("id")
    name = F.when(i % 3 == 0, " ").otherwise(F.concat(F.lit("d"), (i % 5).cast("string"), F.lit(".pdf")))
    good = F.to_json(F.array(F.struct(name.alias("doc_name"), F.concat(F.lit("/p/"), (i % 5).cast("string")).alias("doc_path")), F.struct(F.lit("").alias("doc_name"), F.lit("").alias("doc_path"))))
    return chat.source_rows(fx.messages(spark, sf_dir).withColumn("sources_json", F.when(i % 4 == 0, "{broken").otherwise(good)))


@query(f"WITH {fx.MESSAGES} SELECT session_id, role AS key, arg_max(content, id) AS value FROM f_message GROUP BY session_id, role")
def merged_maps(spark, sf_dir):
    m = fx.messages(spark, sf_dir).withColumn("payload", F.create_map("role", "content"))
    return chat.merge_maps(m)


@query(f"WITH {fx.MESSAGES} SELECT session_id, id FROM f_message WHERE contains(lower(content), 'onen') OR contains(session_id::VARCHAR, 'onen')")
def chat_search(spark, sf_dir):
    return chat.search(fx.messages(spark, sf_dir), " ONEN ", ("content", "session_id")).select("session_id", "id")


@query(f"WITH {fx.MESSAGES} SELECT id, CASE WHEN t='' THEN '(empty)' WHEN length(t)>800 THEN left(t,799)||'…' ELSE t END AS title FROM (SELECT id, regexp_replace(replace(content,chr(10),' '),'^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$','','g') AS t FROM f_message)")
def chat_titles(spark, sf_dir):
    return fx.messages(spark, sf_dir).select("id", X.chat_title(F.concat(F.col("content"), F.lit(" (asked before)"))).alias("title"))


# ---------------------------------------------------------------- ingestion and dashboards


@query(f"WITH {fx.STORED} SELECT doc_name, action FROM f_plan")
def incremental_plan(spark, sf_dir):
    return ingest.incremental_plan(*fx.stored(spark, sf_dir)).select("doc_name", "action")


@query(f"WITH {fx.STORED} SELECT doc_name FROM f_plan WHERE action='keep'")
def incremental_keep(spark, sf_dir):
    old, listing = fx.stored(spark, sf_dir)
    return ingest.kept_rows(old, ingest.incremental_plan(old, listing)).select("doc_name")


@query(f"WITH {fx.STORED} SELECT doc_name FROM f_plan WHERE action='process'")
def incremental_process(spark, sf_dir):
    old, listing = fx.stored(spark, sf_dir)
    return ingest.incremental_plan(old, listing).where("action = 'process'").select("doc_name")


@query("SELECT doc_id, lang FROM documents WHERE source <> 'src3'")
def delete_document(spark, sf_dir):
    rows = docs_of(spark, sf_dir).withColumnRenamed("source", "doc_name")
    return ingest.delete_document(rows, "src3").select("doc_id", "lang")


@query("SELECT source AS tenant, 'f'||doc_id||'.'||CASE doc_id%4 WHEN 0 THEN 'PDF' WHEN 1 THEN 'exe' ELSE 'md' END AS name, doc_id%4<>1 AND doc_id%6<>0 AS saved FROM documents")
def accept_uploads(spark, sf_dir):
    d = docs_of(spark, sf_dir)
    k = F.col("doc_id") % 4
    rows = d.select(F.col("source").alias("tenant"), F.concat(F.lit("f"), F.col("doc_id").cast("string"), F.lit("."), F.when(k == 0, "PDF").when(k == 1, "exe").otherwise("md")).alias("name"), "doc_id")
    return ingest.accept_uploads(rows, rows.where("doc_id % 6 = 0")).select("tenant", "name", "saved")


def _listing(spark, sf_dir):
    files = docs_of(spark, sf_dir).select(F.col("source").alias("tenant"), F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("name"), "doc_id")
    indexed = files.where("doc_id % 2 = 0")
    reported = files.where("doc_id % 5 = 1").withColumn("status", F.lit("FAILED"))
    running = spark.createDataFrame([("src1", "f1"), ("src2", "none")], "tenant string, current string")
    return dashboard.document_states(files.select("tenant", "name"), indexed, reported.select("tenant", "name", "status"), running)


STATES = """f_state AS (SELECT source AS tenant, 'f'||doc_id AS name, CASE WHEN source IN ('src1','src2') AND ((source='src1' AND doc_id=1) OR doc_id%2<>0) THEN 'In progress' WHEN doc_id%2=0 OR source IN ('src1','src2') THEN 'Completed' WHEN doc_id%5=1 THEN 'Failed' ELSE 'Uploaded' END AS status FROM documents)"""


@query(f"WITH {STATES} SELECT * FROM f_state")
def document_states(spark, sf_dir):
    return _listing(spark, sf_dir)


@query(f"""WITH {STATES}, k AS (SELECT count(*) AS total, count(*) FILTER (status='Completed') AS completed, count(*) FILTER (status='In progress') AS in_progress, count(*) FILTER (status='Failed') AS failed FROM f_state)
SELECT *, total-completed-in_progress-failed AS uploaded, floor(100.0*completed/total+0.5)::BIGINT AS completed_pct, greatest(100, 22*total+12*completed)::BIGINT AS units FROM k""")
def dashboard_kpis(spark, sf_dir):
    return dashboard.kpis(_listing(spark, sf_dir))


@query(f"WITH {STATES} SELECT tenant, count(*) AS total, count(*) FILTER (status='Completed') AS completed, floor(100.0*count(*) FILTER (status='Completed')/count(*)+0.5)::BIGINT AS completed_pct FROM f_state GROUP BY tenant")
def tenant_progress(spark, sf_dir):
    return dashboard.tenant_progress(_listing(spark, sf_dir))


@query(f"WITH {STATES} SELECT tenant, name, CASE WHEN name LIKE 'f1%' THEN 'Completed' ELSE status END AS status FROM f_state")
def completed_override(spark, sf_dir):
    rows = _listing(spark, sf_dir)
    return dashboard.with_completed(rows, rows.where("name like 'f1%'"))


@query(f"WITH {STATES} SELECT * FROM f_state WHERE contains(tenant,'src1') OR contains(name,'src1')")
def listing_search(spark, sf_dir):
    return dashboard.search_listing(_listing(spark, sf_dir), " SRC1 ")


@query(f"WITH {STATES} SELECT * FROM f_state ORDER BY tenant, name LIMIT 10 OFFSET 20")
def listing_page(spark, sf_dir):
    return dashboard.page(_listing(spark, sf_dir), 3, 10, "tenant", "name")


@query("SELECT 'f'||(doc_id%40) AS key, min(source) AS tenant FROM documents GROUP BY doc_id%40")
def document_index(spark, sf_dir):
    files = docs_of(spark, sf_dir).select(F.col("source").alias("tenant"), F.concat(F.lit("/x/"), "source", F.lit("/F"), (F.col("doc_id") % 40).cast("string")).alias("path"))
    return dashboard.document_index(files).select("key", "tenant")


@query("SELECT arg_max(source, (m, source)) AS tenant FROM (SELECT source, max(doc_id)//100 AS m FROM documents GROUP BY source)")
def latest_tenant(spark, sf_dir):
    t = docs_of(spark, sf_dir).groupBy(F.col("source").alias("tenant")).agg(F.floor(F.max("doc_id") / 100).alias("mtime"))
    return dashboard.latest_tenant(t)


@query("SELECT DISTINCT source AS tenant, lang AS name FROM documents")
def indexed_names(spark, sf_dir):
    rows = docs_of(spark, sf_dir).select(F.col("source").alias("tenant"), F.concat(F.lit(" "), F.col("lang"), F.lit(" ")).alias("doc_name"))
    return dashboard.indexed_names(rows)


@query("SELECT source AS doc_name, CASE WHEN count(*) FILTER (doc_id%97=0)>0 THEN 'failed' ELSE 'completed' END AS status, count(*) AS chunks, 'markdown' AS mode FROM documents GROUP BY source")
def ingest_status(spark, sf_dir):
    rows = docs_of(spark, sf_dir).select(F.col("source").alias("doc_name"), F.col("doc_id").alias("chunk_index"), F.lit("markdown").alias("ingest_mode"), F.when(F.col("doc_id") % 97 == 0, "broken").alias("error"))
    return ingest.ingest_status(rows).select("doc_name", "status", "chunks", "mode")


@query("SELECT source AS slug, CASE WHEN source='src0' THEN 'ready' ELSE 'queued' END AS state FROM (SELECT DISTINCT source FROM documents)")
def export_states(spark, sf_dir):
    slugs = docs_of(spark, sf_dir).select(F.col("source").alias("slug")).distinct().withColumn("state", F.lit("queued"))
    changes = spark.createDataFrame([("src0", "building", 1), ("src0", "ready", 2)], "slug string, state string, seq bigint")
    return ingest.upsert_states(slugs, changes)


def export_events(spark, sf_dir: str) -> DataFrame:
    """Events as logs of twenty export queues, a slug a user."""
    kinds = {"view": "requested", "click": "built", "purchase": "fetched", "error": "failed", "signup": "removed"}
    kind = F.coalesce(*[F.when(F.col("event_type") == k, v) for k, v in kinds.items()])
    slug = F.concat(F.lit("s"), F.col("user_id").cast("string"))
    return read_table(spark, sf_dir, "events").select(F.concat(F.lit("q"), (F.col("user_id") % 20).cast("string")).alias("queue"), F.col("event_id").alias("seq"), kind.alias("kind"), slug.alias("slug"), F.concat(F.lit("/"), slug).alias("zip_path"), F.lit(1).cast("bigint").alias("zip_size"), F.lit("").alias("error"))


@query()
def export_log(spark, sf_dir):
    """What each event of an export queue leads to: a fold over its log, redone with SQLite in its test."""
    return exports.fold(export_events(spark, sf_dir)).select("queue", "seq", "kind", "slug", "state", "position", "started")


@query(f"WITH {fx.MESSAGES} SELECT id, session_id, role FROM f_message WHERE id % 3 <> 0")
def messages_inserted(spark, sf_dir):
    """Every message is offered twice to a store that has a third of them: what is inserted."""
    m = fx.messages(spark, sf_dir)
    return chat.insert_or_ignore(m.unionByName(m), m.where("id % 3 = 0"), ("id",)).select("id", "session_id", "role")


# ---------------------------------------------------------------- images, speech


@query()
def caption_images(spark, sf_dir):
    """Images made of documents: the ranking's own test redoes its rules in plain Python."""
    q, pool = dense_pool(spark, sf_dir, 24)
    png = F.unhex(F.concat(F.lit("89504E470D0A1A0A0000000D4948445200000100000001000802000000"), F.repeat(F.lit("00"), 2600)))
    found = pool.select("query_id", F.col("dense").alias("vec_score"), F.concat(F.lit("img-"), F.col("vector_id").cast("string")).alias("image_uuid"), F.when(F.col("vector_id") % 3 == 0, "").otherwise(F.col("text")).alias("caption"), F.lit("").alias("text"), F.lit("").alias("doc_name"), png.alias("image"))
    found = found.withColumn("_s", images.png_size(F.col("image"))).withColumn("width", F.col("_s.width")).withColumn("height", F.col("_s.height")).drop("_s")
    asked = q.select("query_id", F.lit("onen therion the").alias("question"), F.lit("onen therion the").alias("caption_query"), F.lit("").alias("chunk_ctx"), F.lit("").alias("top_doc"))
    return images.retrieve_images(found, asked).select("query_id", F.col("image_rank").cast("bigint").alias("image_rank"), "image_uuid", "kind", r6("score").alias("score"))


@query("SELECT item_id, 'fig '||item_id||': pump' AS caption, 0::BIGINT AS image_index, 'image/png' AS image_mime, 3::BIGINT AS n_bytes FROM benchmark WHERE item_id%2=0 UNION ALL SELECT item_id, 'Named view', 0, 'image/png', 3 FROM benchmark WHERE item_id%2=1")
def extract_images(spark, sf_dir):
    alt = F.when(F.col("item_id") % 2 == 0, "image").otherwise("Named view")
    md = F.concat(F.lit("start line\n!["), alt, F.lit("](data:image/PNG;base64,AAEC)\n\nsome text\n**Fig "), F.col("item_id").cast("string"), F.lit(": pump**\n![x](data:image/png;base64,%%%)"))
    docs = read_table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("doc_name"), md.alias("md"))
    return images.extract_images(docs).select(F.col("doc_name").cast("bigint").alias("item_id"), F.when(F.startswith("caption", F.lit("Fig")), F.lower("caption")).otherwise(F.col("caption")).alias("caption"), "image_index", "image_mime", F.length("image").cast("bigint").alias("n_bytes"))


@query(f"""WITH t AS (SELECT doc_id, {STRIP.format("coalesce(text,'')")} AS t FROM documents),
c AS (SELECT doc_id, i, substr(t, i, 1) AS c FROM t, unnest(generate_series(1, length(t))) s(i)),
r AS (SELECT doc_id, c, i - row_number() OVER (PARTITION BY doc_id, c ORDER BY i) AS run FROM c WHERE ord(c) NOT IN (10, 13, 133, 8232, 8233)),
n AS (SELECT doc_id, count(*) AS runs FROM (SELECT doc_id FROM r GROUP BY doc_id, c, run HAVING count(*) >= 6) GROUP BY doc_id),
w AS (SELECT doc_id, t, len(w) AS n, len(list_distinct(list_transform(w, lambda x: lower(x)))) AS d, list_sum(list_transform(w, lambda x: length(x))) AS a FROM (SELECT doc_id, t, regexp_extract_all(t,'[\\p{{L}}\\p{{N}}_]+') AS w FROM t))
SELECT doc_id, CASE WHEN t='' THEN 1000.0 ELSE round(4.0*coalesce(runs,0)+CASE WHEN n=0 THEN 0 ELSE (CASE WHEN d/n<0.45 THEN (0.45-d/n)*8 ELSE 0 END)+(CASE WHEN a/n>18 THEN least(3.0,(a/n-18)*0.5) ELSE 0 END) END,6) END::DOUBLE AS penalty FROM w LEFT JOIN n USING(doc_id)""")
def quality_penalty(spark, sf_dir):
    """Runs of one character are counted as islands in the SQL, since its patterns can't refer back."""
    return docs_of(spark, sf_dir).select("doc_id", r6(speech.quality_penalty(F.col("text"))).alias("penalty"))


@query()
def best_transcripts(spark, sf_dir):
    d = docs_of(spark, sf_dir)
    one = lambda t, lang: F.struct(t.alias("text"), lang.alias("detected"))
    best = speech.best_candidate(one(F.col("text"), F.col("lang")), one(F.left("text", F.lit(100)), F.lit("hi")), one(F.right("text", F.lit(300)), F.lit("en")))
    return d.select("doc_id", best["lang"].alias("lang"), r6(best["score"], 4).alias("score"))


@query("SELECT time_bucket(INTERVAL 60 SECOND, ts::TIMESTAMP) AS window_start, event_type, count(*) AS n, round(sum(value),4) AS total FROM events GROUP BY ALL")
def tumbling_counts(spark, sf_dir):
    """Batch form of the streaming window."""
    e = read_table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    w = e.groupBy(F.window("ts", "60 seconds").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return w.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", "total")


@query("""SELECT item_id, CASE item_id%4 WHEN 0 THEN 5 WHEN 1 THEN 3 WHEN 2 THEN 1 END::BIGINT AS score, item_id%4<>3 AS ok FROM benchmark""")
def judge_scores(spark, sf_dir):
    k = F.col("item_id") % 4
    reply = F.when(k == 0, '```json\n{"score": 9, "explanation": "good"}\n```').when(k == 1, 'Sure: {"score": 3, "explanation": ""} done').when(k == 2, '{"score": -2}').otherwise("no json here")
    rows = read_table(spark, sf_dir, "benchmark").select("item_id", X.judge_reply(reply).alias("j"))
    return rows.select("item_id", F.col("j.score").cast("bigint").alias("score"), F.col("j.error").isNull().alias("ok"))


CITED = "'see '||replace(replace(text,chr(10),' '),'.',',')||', Manual '||(item_id%30)||'.pdf, page '||(item_id%40+1)||'; ['||text||'] [**Guide.pdf**; **page 7**]'||chr(10)||'[Passage 2, page '||(item_id%9)||'], [Passage 3] **page 4**, clip.mp4, time 00:10 - 01:'||(item_id%50+10)"


@query(f"""WITH t AS (SELECT item_id, {CITED} AS t FROM benchmark)
SELECT item_id, trim(regexp_replace(trim(regexp_extract(c,'(?i)([^\\[\\],;\\n]+\\.pdf)',1), ' *('),'(?i)^(according\\s+to|from|in|per|see|refer\\s+to)\\s+','')) AS doc, regexp_extract(c,'(\\d+)$',1)::BIGINT AS page, NULL::BIGINT AS passage, NULL::VARCHAR AS time
FROM (SELECT item_id, unnest(list_distinct(regexp_extract_all(t,'(?i)[^\\[\\],;\\n]+\\.pdf\\s*\\*{{0,2}}\\s*[,;]\\s*\\*{{0,2}}\\s*page\\s+\\d+'))) AS c FROM t)
UNION ALL SELECT item_id, NULL, item_id%9, 2, NULL FROM benchmark UNION ALL SELECT item_id, NULL, 4, 3, NULL FROM benchmark UNION ALL SELECT item_id, 'clip.mp4', NULL, NULL, '00:10-01:'||(item_id%50+10) FROM benchmark""")
def citations(spark, sf_dir):
    """Citations of all shapes in and behind whole texts."""
    i = lambda n, plus=0: (F.col("item_id") % n + plus).cast("string")
    flat = F.translate(F.regexp_replace("text", "\n", " "), ".", ",")
    t = F.concat(F.lit("see "), flat, F.lit(", Manual "), i(30), F.lit(".pdf, page "), i(40, 1), F.lit("; ["), F.col("text"), F.lit("] [**Guide.pdf**; **page 7**]\n[Passage 2, page "), i(9), F.lit("], [Passage 3] **page 4**, clip.mp4, time 00:10 - 01:"), i(50, 10))
    rows = read_table(spark, sf_dir, "benchmark").select("item_id", F.explode(X.citations(t)).alias("c"))
    return rows.select("item_id", "c.doc", "c.page", "c.passage", "c.time")


ANSWER = "'User query: x'||chr(10)||'draft Answer: no'||chr(10)||'Answer: '||text||chr(10)||'[2] Source: y'||chr(10)||replace(text,' ','  ')||'..'||chr(10)||'Rated 1.2 kW'||chr(10)||'Rated 12 kW'"


@query(f"""WITH t AS (SELECT item_id, regexp_replace({ANSWER}, '(?is)^.*answer:', '') AS t FROM benchmark),
l AS (SELECT item_id, i, {STRIP.format("p[i]")} AS x FROM (SELECT item_id, {SPLIT.format('t')} AS p FROM t), unnest(generate_series(1, len(p))) u(i)),
k AS (SELECT item_id, i, x, trim(regexp_replace(lower(x), '[\\s\\p{{Z}}]+', ' ', 'g'), ' .') AS k FROM l WHERE x <> '' AND NOT regexp_matches(lower(x), '^(user query:|retrieved context:|rag input contract|\\[\\d+\\]\\s+source:\\s)'))
SELECT item_id, string_agg(x, chr(10) ORDER BY i) AS answer FROM (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY item_id, k ORDER BY i) = 1) GROUP BY item_id""")
def clean_answers(spark, sf_dir):
    """Whole texts as answers, with echoes of the prompt, repeats, and numbers that differ by a dot."""
    text = F.col("text")
    t = F.concat(F.lit("User query: x\ndraft Answer: no\nAnswer: "), text, F.lit("\n[2] Source: y\n"), F.replace(text, F.lit(" "), F.lit("  ")), F.lit("..\nRated 1.2 kW\nRated 12 kW"))
    return read_table(spark, sf_dir, "benchmark").select("item_id", answers.clean_answer(t).alias("answer"))


@query(f"WITH {fx.MESSAGES}, l AS (SELECT id, lag(content) OVER (PARTITION BY session_id ORDER BY id) AS before, content FROM f_message) SELECT id, CASE WHEN before='' THEN chr(10)||' '||content ELSE regexp_replace(content,'^\\s+','') END AS rest FROM l WHERE before IS NOT NULL")
def repeats_suppressed(spark, sf_dir):
    """Each message with the one before it in front: the part that was emitted already goes."""
    m = fx.messages(spark, sf_dir).withColumn("before", F.lag("content").over(W.partitionBy("session_id").orderBy("id")))
    return m.where(F.col("before").isNotNull()).select("id", answers.suppress_repeat(F.col("before"), F.concat("before", F.lit("\n "), "content")).alias("rest"))


@query("""SELECT item_id, CASE item_id%2 WHEN 0 THEN '4. check zinc valve' ELSE '' END AS novel FROM benchmark""")
def novel_items(spark, sf_dir):
    context = F.lit("1. open lid\n2. press the start button\n3. wait for lamp")
    new = F.when(F.col("item_id") % 2 == 0, "1. press the start button\n2. check zinc valve").otherwise("1. open lid\n2. wait for lamp")
    return read_table(spark, sf_dir, "benchmark").select("item_id", answers.novel_items(new, context).alias("novel"))


# ---------------------------------------------------------------- rerank, scope, context


RERANK_DOC = f"""f_terms AS (SELECT ['valve','pump','onen'] AS qt), f_tk AS (SELECT vector_id, text, fused, list_filter(list_transform(list_filter(regexp_extract_all(lower(text),'[a-z0-9]+'), lambda x: NOT list_contains({_stops(X.OVERLAP_STOPS)}, x)), lambda t: {_stem_sql('t')}), lambda x: length(x)>=2) AS toks,
length(regexp_replace(text,'^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$','','g')) AS n FROM f_fused),
f_re AS (SELECT vector_id, (0.3*(CASE WHEN max(fused) OVER ()>min(fused) OVER () THEN (fused-min(fused) OVER ())/(max(fused) OVER ()-min(fused) OVER ()) ELSE 1 END)+0.7*0.65*len(list_intersect(qt, list_distinct(toks)))/3)
*(CASE WHEN n<60 THEN 0.35 WHEN n<120 THEN 0.55 WHEN n<180 THEN 0.85 ELSE 1.0 END)*(CASE WHEN n<80 THEN 0.55 ELSE 1.0 END) AS score FROM f_tk, f_terms)"""


def _rerank(spark, sf_dir, top_k):
    q, pool = dense_pool(spark, sf_dir)
    facts = q.select("query_id").withColumn("terms", X.words(("valve", "pump"))).withColumn("phrases", X.words(("valve pump",))).withColumn("has_focus", F.lit(False)).withColumn("rerank_terms", X.words(("valve", "pump", "onen")))
    fused = rank.fuse(rank.bm25(pool, q)).withColumn("section_path_str", F.lit(""))
    return rank.hybrid_rerank(fused.drop("embedding"), facts, top_k)


@query(f"WITH {fx.VECTORS}, {DENSE}, {POOL}, {BM25}, {RRF}, {MINMAX}, {RERANK_DOC} SELECT vector_id, round(score,6) AS score FROM f_re ORDER BY score DESC, vector_id LIMIT 20")
def hybrid_rerank(spark, sf_dir):
    return _rerank(spark, sf_dir, 20).select("vector_id", r6("score").alias("score"))


@query(f"WITH {fx.VECTORS}, {DENSE}, {POOL}, {BM25}, {RRF}, {MINMAX}, {RERANK_DOC} SELECT vector_id FROM (SELECT * FROM f_re ORDER BY score DESC, vector_id LIMIT 20) WHERE score >= 0.3")
def score_threshold(spark, sf_dir):
    return expand.above(_rerank(spark, sf_dir, 20), 0.3).select("vector_id")


@query(f"WITH {fx.VECTORS}, {DENSE}, {POOL}, {BM25}, {RRF}, {MINMAX} SELECT vector_id, round(fused,6) AS score, row_number() OVER (ORDER BY fused DESC, vector_id) AS rank FROM f_fused QUALIFY rank <= 10")
def top_fused(spark, sf_dir):
    q, pool = dense_pool(spark, sf_dir)
    return rank.top_fused(rank.fuse(rank.bm25(pool, q)), 10).select("vector_id", r6("score").alias("score"), F.col("rank").cast("bigint").alias("rank"))


_CUTS = {"f92": 0.92, "f85": 0.85, "f75": 0.75, "f65": 0.65, "f55": 0.55}
_CUT = lambda f: f"CASE WHEN blank THEN n ELSE least(n,greatest(200,floor(n*{f}::DOUBLE))) END"


@query(f"""WITH {fx.CHUNKS}, c AS (SELECT doc_id, chunk_index, length(text) AS n, {STRIP.format("text")}='' AS blank FROM f_chunk),
r AS (SELECT *, chunk_index+1 AS p, sum(n) OVER w AS f100, {", ".join(f"sum({_CUT(f)}) OVER w AS {name}" for name, f in _CUTS.items())} FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY chunk_index ROWS UNBOUNDED PRECEDING)),
g AS (SELECT *, CASE WHEN f100<=1500 THEN 1.0 {" ".join(f"WHEN p>1 AND {name}<=1500 THEN {f}" for name, f in _CUTS.items())} END AS factor FROM r),
m AS (SELECT *, max(CASE WHEN factor IS NOT NULL THEN p END) OVER (PARTITION BY doc_id) AS last FROM g)
SELECT doc_id AS query_id, p AS kept, factor::DOUBLE AS factor, (CASE WHEN factor IS NULL THEN least(n, 1500) WHEN factor=1 THEN f100 {" ".join(f"WHEN factor={f} THEN {name}" for name, f in _CUTS.items())} END)::BIGINT AS n_chars FROM m WHERE p=coalesce(last,1)""")
def shrink_factors(spark, sf_dir):
    """The lines of each document as its passages, fitted into 1500 characters."""
    rows = fx.chunks(spark, sf_dir).select(F.col("doc_id").alias("query_id"), F.col("chunk_index").alias("position"), "text")
    fitted = expand.shrink_to_fit(rows, 1500)
    return fitted.groupBy("query_id").agg(F.count("*").alias("kept"), F.first("factor").alias("factor"), F.sum(F.char_length("text")).cast("bigint").alias("n_chars"))


@query("SELECT doc_id AS query_id, count(*) AS pages FROM (SELECT DISTINCT doc_id, i//3 AS p FROM (SELECT *, string_split(text, chr(10)) AS parts FROM documents), unnest(generate_series(0, len(parts)-1)) t(i)) GROUP BY doc_id")
def context_pages(spark, sf_dir):
    """Distinct pages of each context."""
    return fx.chunks(spark, sf_dir).groupBy(F.col("doc_id").alias("query_id")).agg(F.size(F.array_sort(F.collect_set("page_number"))).cast("bigint").alias("pages"))


@query(f"""SELECT doc_id AS query_id, CASE WHEN doc_id%3=0 THEN sum(CASE WHEN length(t)>=80 THEN length(t) ELSE 0 END)>=120 ELSE FALSE END AS override FROM
(SELECT doc_id, {STRIP.format("regexp_replace(x,'(?m)^\\s*#+\\s*','','g')")} AS t FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM documents)) GROUP BY doc_id""")
def domain_override(spark, sf_dir):
    rows = fx.chunks(spark, sf_dir).withColumn("query_id", F.col("doc_id")).withColumn("ingest_mode", F.when(F.col("doc_id") % 3 == 0, "video_transcript"))
    return expand.domain_override(rows)


@query("SELECT doc_id AS query_id, 'From doc_'||doc_id||' (page 1): '||left(t,420)||CASE WHEN length(t)>420 THEN '…' ELSE '' END AS answer FROM (SELECT doc_id, regexp_replace(text,'^[\\s\\p{Z}]+|[\\s\\p{Z}]+$','','g') AS t FROM documents)")
def fallback_answers(spark, sf_dir):
    rows = docs_of(spark, sf_dir).select(F.col("doc_id").alias("query_id"), F.lit(1).alias("position"), F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("doc_name"), F.lit(1).alias("page_number"), F.lit("").alias("section_path_str"), X.pystrip(F.col("text")).alias("text"))
    return expand.fallback_answer(rows)


@query("""SELECT doc_id AS query_id, contains(lower(regexp_replace(text,'[\\s\\p{Z}]+',' ','g')),'re le') OR contains(lower(text),'tion') AS replaced,
CASE WHEN contains(lower(regexp_replace(text,'[\\s\\p{Z}]+',' ','g')),'re le') OR contains(lower(text),'tion') THEN 'From doc_'||doc_id||': the text' ELSE 'x' END AS answer FROM documents""")
def answers_shown(spark, sf_dir):
    """Whole texts as raw answers with two pieces of words as stock phrases; what isn't replaced is marked only, since its format has queries of its own."""
    d = docs_of(spark, sf_dir)
    context = d.select(F.col("doc_id").alias("query_id"), F.lit(1).alias("position"), F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("doc_name"), F.lit(None).cast("bigint").alias("page_number"), F.lit("").alias("section_path_str"), F.lit("the text").alias("text"))
    shown = expand.shown_answers(d.select(F.col("doc_id").alias("query_id"), F.col("text").alias("answer")), context, ("re le", "tion"))
    return shown.select("query_id", "replaced", F.when(F.col("replaced"), F.col("answer")).otherwise("x").alias("answer"))


# ---------------------------------------------------------------- more text


@query("SELECT a.doc_id AS a, b.doc_id AS b, round(CASE WHEN len(a.w)=0 OR len(b.w)=0 THEN 0 ELSE len(list_intersect(a.w,b.w))/len(list_distinct(a.w||b.w)) END,6) AS j FROM (SELECT doc_id, list_distinct(list_filter(regexp_split_to_array(lower(text),'[ \\t\\n\\r\\f\\v]+'), lambda x: x<>'')) AS w FROM documents) a JOIN (SELECT doc_id, list_distinct(list_filter(regexp_split_to_array(lower(text),'[ \\t\\n\\r\\f\\v]+'), lambda x: x<>'')) AS w FROM documents) b ON b.doc_id=a.doc_id+1")
def neighbour_jaccard(spark, sf_dir):
    """Word overlap of each document with the next one."""
    a, b = docs_of(spark, sf_dir).select(F.col("doc_id").alias("a"), F.col("text").alias("x")), docs_of(spark, sf_dir).select(F.col("doc_id").alias("b"), F.col("text").alias("y"))
    rows = a.join(b, F.col("b") == F.col("a") + 1)
    return rows.select("a", "b", r6(X.word_jaccard(F.col("x"), F.col("y"))).alias("j"))


@query(f"SELECT doc_id, section, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(section)),'^#+\\s*',''),'^[ivxlc]+\\.\\s*',''),'[^a-z0-9\\s]',' ','g'),'\\s+',' ','g')) AS norm FROM ({SECTIONS})")
def normalized_sections(spark, sf_dir):
    return sections(spark, sf_dir).select("doc_id", "section", X.normalize_section(F.col("section")).alias("norm"))


@query("SELECT url, regexp_extract(url,'[^/\\\\]*$') AS base, NOT contains(regexp_extract(url,'[^/\\\\]*$'),'.') AS plain FROM pages")
def base_names(spark, sf_dir):
    rows = read_table(spark, sf_dir, "pages").select("url", X.base_name(F.col("url")).alias("base"))
    return rows.withColumn("plain", ~F.contains("base", F.lit(".")))


@query("SELECT url, rtrim(replace(replace(to_base64(encode(url)),'+','-'),'/','_'),'=') AS fid, url AS back FROM pages")
def file_ids(spark, sf_dir):
    rows = read_table(spark, sf_dir, "pages").select("url", X.file_id(F.col("url")).alias("fid"))
    return rows.withColumn("back", X.path_of(F.col("fid")))


@query("SELECT item_id, item_id%5 IN (0,1,3,4) AS bad FROM benchmark")
def bad_captions(spark, sf_dir):
    k = F.col("item_id") % 5
    caption = F.when(k == 0, " Image ").when(k == 1, "see www.site").when(k == 2, "Pump head").when(k == 3, "").otherwise("<!-- page  break -->")
    return read_table(spark, sf_dir, "benchmark").select("item_id", X.is_bad_caption(caption).alias("bad"))


@query("SELECT item_id, CASE item_id%4 WHEN 0 THEN 1.0 WHEN 1 THEN 0.5 WHEN 2 THEN 0.0 ELSE 1.0 END::DOUBLE AS m FROM benchmark")
def caption_scores(spark, sf_dir):
    k = F.col("item_id") % 4
    caption = F.when(k == 0, "suction head").when(k == 1, "vacuum gauge").when(k == 2, "figure").otherwise("hexagon nut")
    asked = F.when(k == 1, "suck hose").when(k == 3, "show image").otherwise("the vacuum")
    return read_table(spark, sf_dir, "benchmark").select("item_id", images.caption_match(caption, asked).alias("m"))


@query("SELECT conv_id, turn, CASE WHEN length(text)>=8 AND regexp_matches(text,'[A-Za-z]') AND regexp_matches(text,'[0-9]') AND regexp_matches(text,'[^A-Za-z0-9]') THEN TRUE ELSE FALSE END AS accepted FROM conversations")
def password_policy(spark, sf_dir):
    return ingest.password_policy(read_table(spark, sf_dir, "conversations"), "text").select("conv_id", "turn", "accepted")


@query("SELECT conv_id, turn, contains(upper(replace(text,'re le','irrelevant')),'IRRELEVANT')=FALSE AS relevant FROM conversations")
def gate_replies(spark, sf_dir):
    """A pair of words that some turns have stands for the verdict."""
    return read_table(spark, sf_dir, "conversations").select("conv_id", "turn", X.gate_reply(F.replace("text", F.lit("re le"), F.lit("irrelevant"))).alias("relevant"))


@query("SELECT event_id, greatest(1, least(5, trunc(value)::BIGINT)) AS score, event_type AS explanation FROM events")
def judge_scores_of_events(spark, sf_dir):
    """Replies with the events' values as scores, fenced or inside other text."""
    e = read_table(spark, sf_dir, "events")
    body = F.concat(F.lit('{"score": '), F.col("value").cast("string"), F.lit(', "explanation": "'), F.col("event_type"), F.lit('"}'))
    reply = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(F.concat(F.lit("Verdict: "), body, F.lit(" end")))
    judged = e.select("event_id", X.judge_reply(reply).alias("j"))
    return judged.select("event_id", F.col("j.score").cast("bigint").alias("score"), "j.explanation")


@query(f"""SELECT doc_id, CASE WHEN regexp_matches(text,'[ऀ-ॿ]') THEN 'Hindi' WHEN list_has_any(t, {_stops(X.HINGLISH)}) AND list_has_any(t, {_stops(X.HINGLISH_TRIGGERS)}) THEN 'Hinglish' ELSE 'English' END AS lang
FROM (SELECT doc_id, text, regexp_extract_all(lower(text),'[a-z'']+') AS t FROM documents)""")
def document_routes(spark, sf_dir):
    """The language route of every whole text."""
    return docs_of(spark, sf_dir).select("doc_id", X.language_route(F.col("text")).alias("lang"))


@query("SELECT item_id, 'Answer briefly.'||chr(10)||chr(10)||CASE WHEN item_id%2=1 THEN 'Answer in Hindi.'||chr(10)||chr(10) ELSE '' END||'Question: '||text||chr(10)||chr(10)||'Context:'||chr(10)||'c' AS prompt FROM benchmark")
def prompts(spark, sf_dir):
    lang = F.when(F.col("item_id") % 2 == 1, "Hindi").otherwise("English")
    return read_table(spark, sf_dir, "benchmark").select("item_id", X.assemble_prompt(F.col("text"), F.lit("c"), lang, F.lit(1), F.lit(1), "Answer briefly.").alias("prompt"))


# ---------------------------------------------------------------- windows, stores, queues


def _assigned(spark, sf_dir):
    rows = docs_of(spark, sf_dir).withColumn("pos", F.row_number().over(W.partitionBy("lang").orderBy("doc_id")) - 1).select(F.col("lang").alias("doc_name"), "pos", F.col("doc_id").alias("vector_id"))
    return rows, chunking.ground_windows(rows).withColumn("label", F.concat(F.lit("w"), F.col("start_i").cast("string")))


@query("""WITH d AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id)-1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM documents),
w AS (SELECT lang AS doc_name, doc_id AS vector_id, k*90 AS s FROM d, unnest(generate_series(0, greatest(0, ceil((n-100)/90.0)::BIGINT))) t(k) WHERE pos >= k*90 AND pos < k*90+100)
SELECT doc_name, vector_id, 'w'||max(s) AS label FROM w GROUP BY ALL""")
def merged_windows(spark, sf_dir):
    rows, assigned = _assigned(spark, sf_dir)
    return chunking.merge_windows(assigned, rows.select("doc_name", "vector_id"))


@query("""WITH d AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id)-1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM documents),
w AS (SELECT lang AS doc_name, doc_id, source, k*90 AS start_i FROM d, unnest(generate_series(0, greatest(0, ceil((n-100)/90.0)::BIGINT))) t(k) WHERE pos >= k*90 AND pos < k*90+100)
SELECT doc_name, start_i, string_agg(doc_id||': '||source, chr(10) ORDER BY doc_id) AS listing FROM w GROUP BY ALL""")
def window_listings(spark, sf_dir):
    d = docs_of(spark, sf_dir)
    rows = d.withColumn("pos", F.row_number().over(W.partitionBy("lang").orderBy("doc_id")) - 1).select(F.col("lang").alias("doc_name"), "pos", F.col("doc_id").alias("vector_id"), F.col("source").alias("path"))
    return chunking.window_listing(chunking.ground_windows(rows)).select("doc_name", F.col("start_i").cast("bigint").alias("start_i"), "listing")


@query("SELECT source AS doc_name, doc_id AS vector_id, CASE WHEN doc_id%3=0 THEN lang ELSE lang||' > part' END AS path FROM documents")
def section_pairs(spark, sf_dir):
    third = F.col("doc_id") % 3 == 0
    rows = docs_of(spark, sf_dir).select(F.col("source").alias("doc_name"), F.col("doc_id").alias("vector_id"), F.when(third, F.col("lang")).alias("section_path_str"), F.array("lang", F.lit("part")).alias("section_path"))
    return chunking.section_pairs(rows)


@query("SELECT tenant, count(*) AS n, min(vid) AS first_id, max(vid) AS last_id FROM (SELECT tenant, row_number() OVER (ORDER BY tenant, doc_id)-1 AS vid FROM (SELECT coalesce(source,'none') AS tenant, doc_id FROM documents)) GROUP BY tenant")
def tenant_union(spark, sf_dir):
    """Three stores that hold all sources between them, as one, numbered anew."""
    d = docs_of(spark, sf_dir).select(F.coalesce("source", F.lit("none")).alias("tenant"), F.col("doc_id").alias("vector_id"))
    own = F.pmod(F.crc32(F.col("tenant").cast("binary")), F.lit(3))
    merged = ingest.merge(ingest.merge(d.where(own == 2), d.where(own == 1)), d.where(own == 0).withColumn("extra", F.lit(1)))
    ids = chunking.renumber(merged, ("tenant", "vector_id"), 4)
    return ids.groupBy("tenant").agg(F.count("*").alias("n"), F.min("vector_id").alias("first_id"), F.max("vector_id").alias("last_id"))


@query("SELECT lang AS doc_name, count(DISTINCT doc_id%13) AS ground_ids FROM documents GROUP BY lang")
def ground_id_counts(spark, sf_dir):
    rows = docs_of(spark, sf_dir).select(F.col("lang").alias("doc_name"), F.col("doc_id").alias("vector_id"), F.concat(F.lit("l"), (F.col("doc_id") % 13).cast("string")).alias("label"))
    return chunking.ground_id_counts(chunking.ground_ids(rows))


@query("SELECT '/x/exp_'||doc_id||'.zip' AS path FROM documents WHERE doc_id%2=0 AND doc_id%6<>0")
def stale_bundles(spark, sf_dir):
    d = docs_of(spark, sf_dir)
    path = F.concat(F.when(F.col("doc_id") % 2 == 0, "/x/exp_").otherwise("/x/log_"), F.col("doc_id").cast("string"), F.lit(".zip"))
    files = d.select(path.alias("path"), "doc_id")
    states = files.where("doc_id % 3 = 0").select(F.when(F.col("doc_id") % 2 == 0, "ready").otherwise("failed").alias("state"), F.col("path").alias("zip_path"))
    return ingest.stale_bundles(files.select("path"), states, "exp_")


@query("SELECT source AS slug, row_number() OVER (ORDER BY m) AS ordinal FROM (SELECT source, min(doc_id) AS m FROM documents GROUP BY source)")
def queue_positions(spark, sf_dir):
    q = docs_of(spark, sf_dir).groupBy(F.col("source").alias("slug")).agg(F.min("doc_id").alias("position"))
    return ingest.queue_positions(q).select("slug", F.col("ordinal").cast("bigint").alias("ordinal"))


@query(f"WITH {fx.STORED} SELECT count(*) AS docs_total, count(*) FILTER (action='process') AS docs_processed, count(*) FILTER (action='keep') AS docs_reused, (SELECT count(*) FROM embeddings) AS num_chunks, 64::BIGINT AS dim FROM f_plan")
def usage_statistics(spark, sf_dir):
    plan = ingest.incremental_plan(*fx.stored(spark, sf_dir))
    stats = ingest.usage_statistics(plan, read_table(spark, sf_dir, "embeddings"))
    return stats.withColumn("dim", F.col("dim").cast("bigint"))


@query(f"WITH {fx.CHUNKS}, t AS (SELECT *, contains(text,'|') AND contains(text,'---') AS tab FROM f_chunk) SELECT doc_id, count(*) AS n, count(*) FILTER (tab) AS tables FROM t GROUP BY doc_id")
def chunk_tables(spark, sf_dir):
    c = fx.chunks(spark, sf_dir)
    return c.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if(X.is_table(F.col("text"))).alias("tables"))


@query(f"WITH {fx.MESSAGES} SELECT session_id, 'Doc_'||(session_id%5)||'.PDF' AS doc, '/p/'||max(id) AS doc_path FROM f_message WHERE role='assistant' GROUP BY session_id UNION ALL SELECT session_id, 'Doc_'||(session_id%5)||'.PDF', NULL FROM f_message GROUP BY session_id HAVING count(*) FILTER (role='assistant')=0")
def cited_sources(spark, sf_dir):
    """The newest assistant message of a session whose sources name the cited document."""
    m = fx.messages(spark, sf_dir)
    name = F.concat(F.lit("/x/doc_"), (F.col("session_id") % 5).cast("string"), F.lit(".pdf"))
    m = m.withColumn("sources_json", F.to_json(F.array(F.struct(name.alias("doc_name"), F.concat(F.lit("/p/"), F.col("id").cast("string")).alias("doc_path")))))
    cited = m.select("session_id").distinct().withColumn("doc", F.concat(F.lit("Doc_"), (F.col("session_id") % 5).cast("string"), F.lit(".PDF")))
    return chat.resolve_cited(m, cited).select("session_id", "doc", "doc_path")
