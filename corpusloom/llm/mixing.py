"""Mixing sources to target weights by Sainte-Laguë apportionment.

Sizes are words. Targets come from weights by water filling; equal-token blocks are then dealt to the
sources by highest quotients (Sainte-Laguë), and each source's blocks to its hash shards in the same
way. A source has as many shards as its size asks for, so that a shard holds about ``shard_words`` words
however large a hot source is. A shard's quota is filled by whole passes over its documents and one
partial pass in a seeded order.

A null source is a source of its own, last in order; null texts have size 0 and take nothing; repeated
rows are rows of their own; an empty table gives an empty result; further columns are ignored. Nothing
is gathered by the driver. One task sees one row a source, and one task of each source one row a shard.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import stash, text_or_empty


def words_in(column: str = "text") -> Column:
    """Number of runs of characters that are not white space (space, 0x09 to 0x0D)."""
    return F.coalesce(F.regexp_count(F.col(column), F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def water_fill(sizes: list[int], weights: list[float], total: float, most: float) -> list[float]:
    """Targets in proportion to weights, none above ``most`` times its size; the excess is shared again."""
    target, open_ = [0.0] * len(sizes), set(range(len(sizes)))
    left = float(total)
    while open_:
        share = left / sum(weights[i] for i in open_)
        full = [i for i in open_ if share * weights[i] > most * sizes[i]]
        if not full:
            for i in open_:
                target[i] = share * weights[i]
            break
        for i in full:
            target[i] = most * sizes[i]
            left -= target[i]
            open_.discard(i)
    return target


def sainte_lague(votes: np.ndarray, seats: int, most: np.ndarray | None = None) -> np.ndarray:
    """Seats by the highest quotients votes / (2k + 1), at most ``most`` each; ties go to the first.

    All seats but a few come from one divisor found by bisection, the rest one by one, so that the
    work depends on the number of parties and not on the number of seats.
    """
    votes = np.maximum(np.asarray(votes, float), 0.0)
    most = np.full(len(votes), np.iinfo(np.int64).max // 4, np.int64) if most is None else np.asarray(most, np.int64)
    most = np.where(votes > 0, most, 0)
    seats = int(min(seats, most.sum()))
    if not len(votes) or seats <= 0:
        return np.zeros(len(votes), np.int64)

    def dealt(divisor: float) -> np.ndarray:  # seats whose quotient votes / (2k + 1) is above the divisor
        return np.minimum(np.maximum(np.ceil((votes / divisor - 1) / 2), 0).astype(np.int64), most)

    low, high = votes.max() / (4.0 * seats + 4) / (len(votes) + 1), votes.max() * 2
    while dealt(low).sum() < seats:
        low /= 4
    for _ in range(200):
        mid = (low + high) / 2
        if mid in (low, high):
            break
        if dealt(mid).sum() >= seats:
            low = mid
        else:
            high = mid
    given = dealt(high)
    for _ in range(seats - int(given.sum())):
        quotient = np.where(given < most, votes / (2 * given + 1), -1.0)
        given[int(np.argmax(quotient))] += 1
    return given


#: Shards are multiples of these finest parts of the hash space.
PARTS = 1 << 20


def mix(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, block_tokens: int = 16, shard_words: int = 1_000_000, seed: int = 42, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row a document: doc_id, size, source, source_size, target, taken, and the columns in ``keep``.

    ``most`` must be a whole number: a document is taken at most that many times. Rows are dealt to shards by
    id and text, so an id or the null id with many texts lies in as many shards as they need.
    """
    passes = math.floor(most)
    columns = [F.col("doc_id"), words_in("text").alias("size"), F.col("source").cast("string").alias("source"), F.xxhash64(F.col("doc_id"), F.col("text"), F.lit(seed)).alias("_h"), F.crc32(text_or_empty().cast("binary")).alias("_crc")]
    rows = docs.select(*columns, *keep)
    if not keep:
        rows = stash(rows, "sizes")  # words are counted once
    part = F.pmod("_h", F.lit(PARTS)).cast("int")
    parts = stash(rows.select("source", "size", part.alias("part")).groupBy("source", "part").agg(F.sum("size").alias("size")), "parts")

    def targets(frame: pd.DataFrame) -> pd.DataFrame:
        """Targets and blocks of the sources, and how many shards each has."""
        frame = frame.loc[sorted(frame.index, key=lambda i: (frame.source[i] is None, (frame.source[i] or "").encode("utf-8", "surrogatepass")))]
        sizes = frame["size"].tolist()
        goals = water_fill(sizes, [weights[i % len(weights)] for i in range(len(sizes))], share * sum(sizes), most)
        blocks = sainte_lague(np.array(goals), round(sum(goals) / block_tokens), np.array([-(-math.floor(most * s) // block_tokens) for s in sizes]))
        shards = [min(PARTS, 1 << max(0, math.ceil(s / shard_words) - 1).bit_length()) for s in sizes]
        return pd.DataFrame({"source": frame["source"], "source_size": sizes, "target": goals, "blocks": blocks, "shards": shards})

    sources = parts.groupBy("source").agg(F.sum("size").alias("size"))
    sources = stash(sources.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(targets, "source string, source_size long, target double, blocks long, shards int"), "sources")

    def quotas(frame: pd.DataFrame) -> pd.DataFrame:
        """Tokens that each shard of one source gives."""
        frame = frame.sort_values("shard")
        held = frame["words"].to_numpy(np.int64)
        quota = sainte_lague(held.astype(float), int(frame["blocks"].iloc[0]), -(-passes * held // block_tokens))
        return frame.assign(quota=np.minimum(quota * block_tokens, passes * held)).drop(columns="blocks")

    same_source = F.col("source").eqNullSafe(F.col("_s"))
    named = sources.withColumnRenamed("source", "_s")
    shards = parts.join(named, same_source).groupBy("source", "source_size", "target", "blocks", "shards", F.pmod("part", "shards").alias("shard")).agg(F.sum("size").alias("words"))
    plan = shards.groupBy("source").applyInPandas(quotas, "source string, source_size long, target double, shards int, shard int, words long, quota long")
    plan = stash(plan, "plan")  # so that its size is known: it is broadcast only below the session's threshold
    plan = plan.select(F.col("source").alias("_s"), F.col("shard").alias("_k"), "source_size", "target", F.col("words").alias("_words"), F.col("quota").alias("_quota"))
    # the shard counts of sources come first, so that a row can name its shard; both joins are split if a source is hot
    rows = rows.join(named.select("_s", "shards"), same_source).withColumn("_shard", F.pmod(part, "shards")).drop("_s", "shards")
    order = W.partitionBy("source", "_shard").orderBy("_h", "doc_id", "_crc", "size")
    before = F.sum("size").over(order.rowsBetween(W.unboundedPreceding, 0)) - F.col("size")
    whole = F.when(F.col("_words") > 0, F.floor(F.col("_quota") / F.col("_words"))).otherwise(F.lit(0)).cast("long")
    rest = F.col("_quota") - whole * F.col("_words")
    return (
        rows.join(plan, same_source & (F.col("_shard") == F.col("_k")))
        .withColumn("_before", before)
        .withColumn("taken", (whole * F.col("size") + F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), rest - F.col("_before")))).cast("long"))
        .select("doc_id", "size", "source", "source_size", "target", "taken", *keep)
    )


def copies(mixed: DataFrame) -> DataFrame:
    """Whole documents instead of words: each document as often as its taken words round to (half up)."""
    n = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + F.lit(0.5))).otherwise(F.lit(0)).cast("int")
    return mixed.withColumn("n_copies", n)
