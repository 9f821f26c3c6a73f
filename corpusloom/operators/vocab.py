"""Corpus vocabulary: which words carry no signal in a given set of chunks."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources.shared import stash


def term_frequencies(texts: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """(id, term, tf, doc_len); a text without a token has length 1 and no rows."""
    tokens = texts.select(id_col, X.bm25_tokens(F.col(text_col)).alias("t"))
    rows = tokens.select(id_col, F.greatest(F.lit(1), F.size("t")).alias("doc_len"), F.explode("t").alias("term"))
    return rows.groupBy(id_col, "term", "doc_len").agg(F.count("*").alias("tf"))


def document_frequencies(texts: DataFrame, text_col: str = "text") -> DataFrame:
    return texts.select(F.explode(F.array_distinct(X.bm25_tokens(F.col(text_col)))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


COUNTS = ("title_hits", "body_hits", "long_body_hits", "short_header_hits")


#: Tokens that a task counts before it gives them back.
MOST_TOKENS = 400_000

#: Tokens that a task may be given to look for; where rules may name more, all are counted.
MOST_WANTED = 100_000


#: Bytes of UTF-8 as they stand in a token, blanks for all that no token holds.
_IN_TOKENS = bytes(ord(chr(i).lower()) if chr(i).isascii() and chr(i).isalnum() else 32 for i in range(256))

#: The two characters outside ASCII whose lower case holds a letter within: the Kelvin sign and the dotted I.
_ODD = ("\u212a".encode(), "\u0130".encode())


def _tokens(text: bytes) -> list[bytes]:
    """Runs of [a-z0-9] of a lower-cased text."""
    if any(x in text for x in _ODD):
        text = text.decode("utf-8", "replace").lower().encode()
    return text.translate(_IN_TOKENS).split()


def _body_counts(batches: Iterator[pa.RecordBatch], wanted: frozenset[bytes] | None = None) -> Iterator[pa.RecordBatch]:
    """(token, body_hits, long_body_hits) of batches of (text, long), added up for MOST_TOKENS tokens at a time; each text counts a token once. Of all tokens or those ``wanted``."""
    shorts, longs = Counter(), Counter()
    distinct = set if wanted is None else wanted.intersection

    def added() -> pa.RecordBatch:
        names = [t for t in {**longs, **shorts} if len(t) >= 3]
        long = pa.array([longs[t] for t in names], pa.int64())
        every = pa.array([longs[t] + shorts[t] for t in names], pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(names, pa.binary()).cast(pa.string()), every, long], names=["token", "body_hits", "long_body_hits"])

    for batch in batches:
        for text, long in zip(batch.column(0).cast(pa.binary()).to_pylist(), batch.column(1).to_pylist(), strict=True):
            (longs if long else shorts).update(distinct(_tokens(text)))
            if len(longs) + len(shorts) >= MOST_TOKENS:
                yield added()
                shorts.clear()
                longs.clear()
    yield added()


def _length() -> Column:
    return F.char_length(X.pystrip(X.text_of("text")))


def body_hits(chunks: DataFrame, wanted: frozenset[bytes] | None = None) -> DataFrame:
    """(token, body_hits, long_body_hits): added up in tasks, so that what is shuffled of them is their distinct words."""
    texts = chunks.select(X.text_of("text").alias("text"), (_length() >= 120).alias("long"))
    bodies = texts.mapInArrow(lambda it: _body_counts(it, wanted), "token string, body_hits bigint, long_body_hits bigint").groupBy("token")
    return bodies.agg(F.sum("body_hits").alias("body_hits"), F.sum("long_body_hits").alias("long_body_hits"))


def title_hits(chunks: DataFrame) -> DataFrame:
    """(token, doc, title_hits, body_hits, long_body_hits, short_header_hits), with no hits in bodies. Titles are cut into tokens once a document and section, not once a chunk."""
    alike = chunks.groupBy("doc_name", "section_path_str").agg(F.count("*").alias("n"), F.count_if(_length() < 100).alias("n_short"))
    title = F.array_distinct(X.title_tokens(F.col("doc_name"), F.col("section_path_str")))
    titles = alike.select(X.pystrip(X.text_of("doc_name")).alias("doc"), "n", "n_short", F.explode(title).alias("token")).groupBy("token", "doc")
    titles = titles.agg(F.sum("n").alias("title_hits"), F.sum("n_short").alias("short_header_hits"))
    none = F.lit(0).cast("bigint")
    return titles.select("token", "doc", "title_hits", none.alias("body_hits"), none.alias("long_body_hits"), "short_header_hits")


def token_hits(chunks: DataFrame) -> DataFrame:
    """(token, doc, title_hits, body_hits, long_body_hits, short_header_hits): what chunks add to a token's counts.

    Only titles are counted by document, since only their documents are counted later. Hits in bodies, which are
    nearly all, have a null ``doc``.
    """
    none = F.lit(0).cast("bigint")
    bodies = body_hits(chunks).select("token", F.lit(None).cast("string").alias("doc"), none.alias("title_hits"), "body_hits", "long_body_hits", none.alias("short_header_hits"))
    return title_hits(chunks).unionByName(bodies)


def _counters(hits: DataFrame) -> DataFrame:
    per = hits.groupBy("token").agg(F.count_if(F.col("title_hits") > 0).alias("title_docs"), *[F.sum(c).alias(c) for c in COUNTS])
    return per.select("token", *[F.col(c).cast("bigint").alias(c) for c in ("title_hits", "title_docs", "body_hits", "long_body_hits", "short_header_hits")])


def token_counters(chunks: DataFrame) -> DataFrame:
    """Five counts a token: title_hits, title_docs, body_hits, long_body_hits, short_header_hits."""
    return _counters(token_hits(chunks))


def corpus_sizes(chunks: DataFrame) -> DataFrame:
    return chunks.agg(F.count("*").alias("n_chunks"), F.count_distinct(F.nullif(X.pystrip(X.text_of("doc_name")), F.lit(""))).alias("n_docs"))


def generic_rules(chunks: DataFrame) -> DataFrame:
    """(token, r1, r2, r3): in many documents' titles; in short headers but hardly in bodies; in many titles but few bodies."""
    return rules_of(token_counters(chunks), corpus_sizes(chunks))


ANY_RULE = "r1 or r2 or r3"


def named_by_rules(chunks: DataFrame) -> DataFrame:
    """The rows of ``generic_rules`` in which a rule holds.

    Rules name tokens of titles only, and hits in bodies only speak against a token. So titles are counted first,
    and in bodies only those tokens which a rule would name if no body had them.
    """
    sizes = corpus_sizes(chunks)
    likely = stash(_ruled(_counters(title_hits(chunks)), sizes).where(ANY_RULE).drop("body_hits", "long_body_hits", "r1", "r2", "r3"), "likely")
    some = likely.select("token").limit(MOST_WANTED + 1).collect()
    bodies = body_hits(chunks, frozenset(r.token.encode() for r in some) if len(some) <= MOST_WANTED else None)
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("body_hits", "long_body_hits")]
    counters = likely.join(bodies, "token", "left").select("token", "title_hits", "title_docs", *counts, "short_header_hits", "n_chunks", "n_docs")
    return _ruled(counters).select("token", "r1", "r2", "r3").where(ANY_RULE)


def rules_of(counters: DataFrame, sizes: DataFrame) -> DataFrame:
    """The rules for given counts and sizes (n_chunks, n_docs; one row)."""
    return _ruled(counters, sizes).select("token", "r1", "r2", "r3")


def _ruled(counters: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """Counts, sizes and what each rule says; without ``sizes`` the counts come with them."""
    c = counters if sizes is None else counters.join(F.broadcast(sizes))  # one row
    usable = ~F.col("token").isin(*X.QUESTION_STOPS) & (F.col("n_docs") > 0)
    r1 = F.col("title_docs") >= F.greatest(F.lit(2), F.floor(F.col("n_docs") * 0.4))
    short = F.col("short_header_hits")
    r2 = (short >= 2) & (F.col("long_body_hits") < F.greatest(F.lit(2.0), short * 0.25)) & (F.col("title_hits") >= 2)
    hits = F.col("title_hits")
    r3 = (hits > 0) & (hits / F.greatest(F.lit(1), F.col("n_chunks")) >= 0.12) & (F.col("body_hits") / F.greatest(F.lit(1), hits) < 0.45)
    return c.withColumns({"r1": usable & r1, "r2": usable & r2, "r3": usable & r3})


class VocabularyLog:
    """The counts of a corpus kept up to date by signed deltas, a folder each under ``path``.

    A change is the chunks that came and those that went; only these are read. Its name makes it take
    effect once: the same change written again replaces itself. ``compact`` sums the deltas into one.
    Distinct documents of a token's titles need the counts by document, so a delta has a row for each
    token and document whose titles it touches, and one for each token of bodies.
    """

    HITS = "token string, doc string, title_hits bigint, body_hits bigint, long_body_hits bigint, short_header_hits bigint"
    SIZES = "doc string, n_chunks bigint"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def change(self, name: str, added: DataFrame | None = None, removed: DataFrame | None = None) -> None:
        hits, sizes = None, None
        for chunks, sign in ((added, 1), (removed, -1)):
            if chunks is None:
                continue
            own = token_hits(chunks).select("token", "doc", *[(F.col(c) * sign).alias(c) for c in COUNTS])
            size = chunks.groupBy(X.pystrip(X.text_of("doc_name")).alias("doc")).agg((F.count("*") * sign).alias("n_chunks"))
            hits, sizes = (own, size) if hits is None else (hits.unionByName(own), sizes.unionByName(size))
        if hits is not None:
            self._write(name, hits, sizes)

    def _write(self, name: str, hits: DataFrame, sizes: DataFrame) -> None:
        """Sizes go last: a delta counts once they are there."""
        hits = hits.groupBy("token", "doc").agg(*[F.sum(c).alias(c) for c in COUNTS])
        hits.where(" or ".join(f"{c} <> 0" for c in COUNTS)).write.mode("overwrite").parquet(f"{self.path}/hits/delta={name}")
        sizes.groupBy("doc").agg(F.sum("n_chunks").alias("n_chunks")).write.mode("overwrite").parquet(f"{self.path}/sizes/delta={name}")

    def _read(self, what: str, kind: str) -> DataFrame:
        return self.spark.read.schema(f"{kind}, delta string").parquet(f"{self.path}/{what}")

    def _now(self) -> tuple[DataFrame, DataFrame]:
        sizes = self._read("sizes", self.SIZES)
        done = sizes.select("delta").distinct()
        return self._read("hits", self.HITS).join(done, "delta", "left_semi"), sizes

    def counters(self) -> DataFrame:
        """As ``token_counters`` of the whole corpus."""
        hits = self._now()[0].groupBy("token", "doc").agg(*[F.sum(c).alias(c) for c in COUNTS])
        return _counters(hits).where(" or ".join(f"{c} <> 0" for c in COUNTS))

    def sizes(self) -> DataFrame:
        per = self._now()[1].groupBy("doc").agg(F.sum("n_chunks").alias("n")).where("n <> 0")
        return per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_chunks"), F.count_if(F.col("doc") != "").alias("n_docs"))

    def rules(self) -> DataFrame:
        return rules_of(self.counters(), self.sizes())

    def compact(self, path: str, name: str = "base") -> VocabularyLog:
        """The same counts as one delta under another path, from which changes can go on."""
        hits, sizes = self._now()
        fresh = VocabularyLog(self.spark, path)
        fresh._write(name, hits.drop("delta"), sizes.drop("delta"))
        return fresh


def generic_terms(chunks: DataFrame, extras: tuple[str, ...] = (), exclude: tuple[str, ...] = (), enabled: bool = True) -> DataFrame:
    """(token): the baseline, tokens that a rule names, and extras, without the excluded."""
    spark = chunks.sparkSession
    tidy = lambda xs: sorted({x.strip().lower() for x in xs if x.strip()})
    listed = spark.createDataFrame([(t,) for t in sorted({*X.BASELINE_GENERIC, *tidy(extras)})], "token string")
    found = listed
    if enabled:
        found = listed.unionByName(named_by_rules(chunks).select("token"))
    return found.distinct().where(~F.col("token").isin(tidy(exclude)))
