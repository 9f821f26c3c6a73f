"""A corpus pipeline of five stages over ``documents``.

Each stage takes what its predecessor kept and wrote, and its decisions take effect: toxic documents go,
one document of each near-duplicate group stays, secrets are replaced, sources are brought to their
weights by leaving out or repeating whole documents, and what is left is encoded.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from corpusloom.llm import mixing, pieces, secrets, simhash, toxicity
from corpusloom.llm.common import crc_mod, mark, read_table, stash, sweep

#: A public SentencePiece model file.
PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"

#: Runs of text that a worker remembers with their pieces. Workers outlive the stage, so all stages have them beside their own.
MEMO_RUNS = 100_000


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below 0.5, from a model of the labelled rows outside the held-out fold.

    Null and empty texts get the score of the intercept; without a label every document stays.
    """
    labels = read_table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels.where(crc_mod("doc_id", 5) != 0))
    return docs.where(toxicity.score_column(model, F.col("text")) < 0.5)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: that of the smallest id (null ids come last).

    Links are those of ``op3_simhash_near_dedup``, fingerprints within 2 bits, and of pairs whose shingle sets are similar.

    Rows are known by id and text, so neither a null id nor an id with several texts loses a document
    that no other is like. Of rows equal in both one stays; the tasks drop the others before the shuffle.
    Documents travel as one column, so their columns may have any names, and are dealt out once.
    """
    has_id, some_id = F.col("doc_id").isNotNull().alias("has_id"), F.coalesce("doc_id", F.lit(0)).alias("id")
    key = ["has_id", "id", "hash"]
    kept = simhash.representatives(docs).select(has_id, some_id, F.col("text_hash").alias("hash"))
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    others = F.xxhash64(*[c for c in docs.columns if c not in ("doc_id", "text")]).alias("others")
    packed = docs.select(has_id, some_id, F.xxhash64("text").alias("hash"), others, F.struct(*[F.col(c).alias(k) for c, k in names.items()]).alias("doc"))
    first = packed.withColumn("n", F.row_number().over(W.partitionBy(*key).orderBy("others"))).where(F.col("n") == 1)
    return first.join(kept, key, "left_semi").select(*[F.col("doc")[k].alias(c) for c, k in names.items()])


def replace_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every span that looks like a secret replaced; null texts stay null, repeated rows stay, an empty table stays empty."""
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, rounded to whole documents; texts without a word take nothing, so they go.

    Repeated rows are taken each for itself; an empty table stays empty.
    """
    packed = docs.select("doc_id", "text", "source", F.struct(*docs.columns).alias("_doc"))
    mixed = mixing.copies(mixing.mix(packed, keep=("_doc",))).where(F.col("n_copies") > 0)
    return mixed.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("n_copies")))).select("_doc.*")


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with ``ids``, repeated rows each; null texts have null ids. A column of that name is replaced."""
    return pieces.encode(docs, pieces.model_bytes(PIECE_MODEL), memo=MEMO_RUNS)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("secret_scans", replace_secrets),
    ("source_mix", mix_sources),
    ("sentencepiece", encode_pieces),
]

#: SQL expresses neither the classifier nor the encoding.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``; what a stage wrote on its way is deleted when its result is written."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before = mark()
        done = stash(stage(spark, docs, sf_dir), name)
        sweep(spark, before, keep=(done,))
        docs = done
    return STAGES[-1][1](spark, docs, sf_dir)
