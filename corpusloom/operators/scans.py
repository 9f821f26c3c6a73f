"""Running values within groups of any size.

A window over a group puts the group into one task. Here rows are range-partitioned by group and order,
each part runs its own window, and what the earlier parts of a group leave behind is carried over: one
row for each part of a group that spans several, of which there are at most two a part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..sources.shared import stash

PART = "_part"


def in_parts(df: DataFrame, keys: tuple[str, ...], order: str, parts: int) -> DataFrame:
    """``df`` range-partitioned by group and order and written once, so that the part of a row, ``_part``, is fixed."""
    return stash(df.repartitionByRange(parts, *keys, order).withColumn(PART, F.spark_partition_id()), "parts")


def running(ranged: DataFrame, keys: tuple[str, ...], order: str, sums: dict[str, Column] | None = None, mins: dict[str, Column] | None = None, lasts: dict[str, Column] | None = None) -> DataFrame:
    """``ranged`` with running sums, minima and last non-null values up to and including each row, in the order of a group.

    Rows of a group that are equal in ``order`` must lie in one part and come in any order among themselves.
    """
    sums, mins, lasts = sums or {}, mins or {}, lasts or {}
    own = W.partitionBy(PART, *keys).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    rows = ranged.withColumns({f"_in_{n}": v for n, v in {**sums, **mins, **lasts}.items()})
    latest = lambda n: F.max_by(f"_in_{n}", F.when(F.col(f"_in_{n}").isNotNull(), F.col(order)))
    left = [*[F.sum(f"_in_{n}").alias(f"_of_{n}") for n in sums], *[F.min(f"_in_{n}").alias(f"_of_{n}") for n in mins], *[latest(n).alias(f"_of_{n}") for n in lasts]]
    ends = rows.groupBy(PART, *keys).agg(*left)
    before = W.partitionBy(*keys).orderBy(PART).rowsBetween(W.unboundedPreceding, -1)
    carry = [*[F.sum(f"_of_{n}").over(before).alias(f"_by_{n}") for n in sums], *[F.min(f"_of_{n}").over(before).alias(f"_by_{n}") for n in mins], *[F.last(f"_of_{n}", ignorenulls=True).over(before).alias(f"_by_{n}") for n in lasts]]
    place = F.row_number().over(W.partitionBy(*keys).orderBy(PART))
    carried = ends.select(PART, *keys, *carry, place.alias("_place")).where(F.col("_place") > 1).drop("_place")
    carried = carried.withColumnsRenamed({c: f"_to_{c}" for c in (PART, *keys)})
    values = {}
    for n in sums:
        values[n] = F.coalesce(F.sum(f"_in_{n}").over(own), F.lit(0))
    for n in mins:
        values[n] = F.min(f"_in_{n}").over(own)
    for n in lasts:
        values[n] = F.last(f"_in_{n}", ignorenulls=True).over(own)
    rows = rows.withColumns(values)
    same = [rows[c].eqNullSafe(carried[f"_to_{c}"]) for c in (PART, *keys)]
    joined = rows.join(F.broadcast(carried), same, "left")  # a part continues one group at most
    final = {}
    for n in sums:
        final[n] = F.col(n) + F.coalesce(F.col(f"_by_{n}"), F.lit(0))
    for n in mins:
        final[n] = F.least(F.col(n), F.col(f"_by_{n}"))
    for n in lasts:
        final[n] = F.coalesce(F.col(n), F.col(f"_by_{n}"))
    names = [*sums, *mins, *lasts]
    return joined.withColumns(final).drop(*[f"_in_{n}" for n in names], *[f"_by_{n}" for n in names], *[f"_to_{c}" for c in (PART, *keys)])
