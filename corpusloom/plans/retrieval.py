"""One plan from questions to packed context."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import BASELINE_GENERIC
from ..operators import expand, rank, vocab
from ..operators.vector_index import VectorIndex
from ..sources.shared import stash
from .config import RetrievalConfig
from .questions import question_columns, question_rows, words_asked

# Documents that keywords of a question hint at.
DOCUMENT_HINTS: dict[str, tuple[str, ...]] = {
    "Calibration-and-Maintenance-of-Store-Equipment": ("calibration", "calibrate", "maintenance", "equipment", "pms", "preventive", "breakdown"),
    "AccessControlandSecurityofStoreArea": ("access", "security", "visitor", "cctv", "entry", "surveillance", "id card"),
    "Change-Control-and-Deviation-Management-in-Stores": ("change control", "deviation", "capa", "impact analysis"),
    "Handling-and-Storage-of-Controlled-Substances": ("controlled substances", "ndps", "narcotic", "drug storage"),
    "Handling-of-Expired-and-Obsolete-Materials": ("expired", "obsolete", "quarantine", "disposal"),
}


#: What a chunk is known by: its own keys, and its place in a document.
KEYS = ("tenant", "vector_id", "doc_name", "chunk_index")
CHUNK = KEYS[2:]


@dataclass(frozen=True)
class Retrieved:
    """``reranked``: scored seeds; ``rows``: seeds and what was added; ``context``: packed texts with their chunk's columns."""

    reranked: DataFrame
    rows: DataFrame
    context: DataFrame


def generic_words(chunks: DataFrame, config: RetrievalConfig, questions: list[str]) -> list[str]:
    """The words of the questions that have no signal in this corpus; the list of all such words stays a table."""
    asked = chunks.sparkSession.createDataFrame([(w,) for w in words_asked(questions)], "token string")
    found = vocab.generic_terms(chunks, config.retrieval_generic_terms, config.retrieval_generic_terms_exclude, config.retrieval_corpus_vocab_enabled)
    return sorted(r.token for r in found.join(asked, "token", "left_semi").collect())


def one_vector_each(questions: DataFrame) -> DataFrame:
    """(query_id, question, query_vec) of a table that may have several variants a question."""
    if "variant" not in questions.columns:
        return questions
    texts = questions.groupBy("query_id").agg(F.min_by("question", "variant").alias("question"))
    means = rank.fused_query_vectors(questions.select("query_id", F.col("query_vec").alias("embedding")))
    return texts.join(means, "query_id")


def retrieve(
    chunks: DataFrame,
    questions: list[tuple] | DataFrame,
    config: RetrievalConfig | None = None,
    generic: list[str] | DataFrame | None = None,
    n_chunks: int | None = None,
    index: VectorIndex | None = None,
    probe: int | None = None,
) -> Retrieved:
    """Answer contexts for questions, from a chunk table with embeddings.

    Questions are (query_id, question, query vector) tuples, or a table with the columns query_id,
    question and query_vec, or with several rows of them a question, one for each variant: the mean of
    a question's vectors is looked for, and of its texts the first by ``variant``. With a stored ``index`` of
    the chunks the dense stage reads its cells instead: all that may matter, or ``probe`` of them.

    What travels between the stages are keys and numbers, at most a few hundred rows a question: all that a
    stage needs of texts is worked out where they are read. Texts are read for the pool and for the
    candidates that are ranked again, embeddings by the dense stage and for the cut, and whole rows only for
    the ranked ones and what packing can reach of their sections; ``rows`` has all of these.
    What later stages use several times is written once, so that a scan isn't repeated for each use.
    """
    c = config or RetrievalConfig()
    known = BASELINE_GENERIC if generic is None else generic
    if isinstance(questions, DataFrame):
        q = stash(question_columns(one_vector_each(questions), known, c.retrieval_query_clean_enabled), "questions")
    else:
        q = question_rows(chunks.sparkSession, questions, known, c.retrieval_query_clean_enabled)
    n = chunks.count() if n_chunks is None else n_chunks
    pool_k, initial_k = rank.pool_sizes(n, c.top_k, c.retrieval_pool_k, c.initial_pool_multiplier)
    columns = ["tenant", "doc_name", "doc_path", "chunk_index", "vector_id", "text", "section_path_str", "page_number", "timestamp", "ingest_mode"]
    present = [x for x in columns if x in chunks.columns]
    base = chunks.select(*present, "embedding", *[F.lit(None).cast("bigint" if x == "page_number" else "string").alias(x) for x in columns if x not in present])
    asked = q.select("query_id", "query_vec")
    many = asked.count()

    def read(found: DataFrame, k: int, *wanted: str) -> DataFrame:
        """``found``, at most ``k`` rows a question, with columns ``wanted`` of its chunks."""
        own = found.withColumnsRenamed({x: f"_own_{x}" for x in CHUNK})
        if index is None:
            got = rank.fetch(base, own, many, k, ["tenant", "vector_id"])
        else:
            got = index.fetch(own.withColumn("cell", F.col("_cell_of")), many, k)
            got = got.select(*[x for x in got.columns if x not in base.columns], *[(F.col(x) if x in got.columns else F.lit(None)).cast(base.schema[x].dataType).alias(x) for x in base.columns])
        for x in CHUNK:
            got = got.where(F.col(x).eqNullSafe(F.col(f"_own_{x}"))) if x in found.columns else got
        return got.select(*found.columns, *[x for x in wanted if x not in found.columns])

    if index is None:
        found = rank.nearest_ids(base, asked, initial_k)
    else:
        found = index.search(asked, initial_k, probe).withColumnRenamed("cell", "_cell_of")
    own = ["query_id", "dense", "dense_rank"]
    asks = found.groupBy(*[x for x in found.columns if x not in own]).agg(F.collect_list(F.struct(*own)).alias("_asks"))
    pool = stash(rank.measured(read(asks, initial_k, *KEYS, "text", "section_path_str"), q).drop("text", "section_path_str"), "pool")
    scored = rank.adjust(rank.fuse(rank.bm25(pool, q), c.bm25_weight, c.rrf_linear_blend), q)
    cut = stash(rank.cut_and_dedupe(scored, pool_k), "cut")
    take = min(c.mmr_k, pool_k)
    candidates = cut
    if take < pool_k:
        vectors = read(cut.drop("dense", "dense_rank", "bm25", "bm25_rank", "rrf", "_section"), pool_k, "embedding")
        chosen = rank.mmr(vectors, q, take, c.mmr_lambda, keys=KEYS).select("query_id", "vector_id")
        candidates = cut.join(chosen, ["query_id", "vector_id"], "left_semi")
    if c.hybrid_rerank_enabled:
        compared = rank.overlaps(read(candidates, take, "text", "section_path_str"), q).drop("text", "section_path_str")
        ranked = rank.hybrid_rerank(compared.dropDuplicates(["query_id", *KEYS]), q, c.top_k, c.hybrid_alpha_semantic)
    else:
        ranked = rank.top_fused(candidates.drop("_section"), c.top_k)
    if c.restrict_top_document:
        ranked = expand.restrict_to_top_document(expand.scope_to_hint(ranked, q, DOCUMENT_HINTS, c.top_k))
    ranked = stash(expand.above(ranked, c.min_hybrid_rerank_score), "places")
    ranked = stash(read(ranked, c.top_k, *columns).drop("_cell_of").dropDuplicates(["query_id", "rank"]), "ranked")
    # the documents of the ranked chunks
    near = base.drop("embedding").join(ranked.select(*expand.DOC).distinct(), list(expand.DOC), "left_semi")
    around = max(c.top_doc_chunk_neighbors_before, 0) + max(c.top_doc_chunk_neighbors_after, 0)
    near = stash(near, "near") if around else near
    rows = expand.chunk_neighbours(ranked, near, c.top_doc_chunk_neighbors_before, c.top_doc_chunk_neighbors_after)
    reached = rows
    if c.top_doc_section_expand:
        reach = expand.within_budget(c.max_context_chars, c.max_chunks_for_prompt, not c.restrict_top_document)
        few = many * c.top_k * (1 + around) <= rank.MOST_FETCHED
        reached = stash(expand.section_mates(rows, near if around else base.drop("embedding"), reach, few), "reached")
        rows = expand.section_mates(rows, near)
    pack = expand.pack_top_document if c.restrict_top_document else expand.pack_mixed
    packed = expand.never_empty(pack(reached, c.max_context_chars, c.max_chunks_for_prompt), reached, c.max_context_chars)
    facts = reached.select("query_id", "vector_id", "tenant", "doc_name", "doc_path", "chunk_index", "section_path_str", "page_number", "timestamp", "ingest_mode", "score").dropDuplicates(["query_id", "vector_id"])
    return Retrieved(ranked, rows, packed.join(facts, ["query_id", "vector_id"]))
