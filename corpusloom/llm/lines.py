"""Line de-duplication with levelled sorted runs of line keys.

A line's key is the line without white space at its ends, with A-Z lower-cased; a line of few characters
has none. Keys are known by 128 bits of hash. A run is a table of keys, bucketed and sorted by them, with
the number of documents that hold a key and the one that keeps it. A new batch is aggregated to its keys
and merge-anti-joined to the runs, whose buckets are never shuffled: keys that the runs have settled need
no entry more, for their count is reached and their keeper known. The rest is added as a run of the first
level. ``fanout`` runs of a level are compacted to one of the next, so an entry is rewritten once a level
and a batch meets at most ``fanout - 1`` runs a level.

Batches come in order of precedence: what keeps a key is in the first batch that has it. ``drop_repeated``
deals a table to batches by descending id, so that the largest id keeps a line; within a batch that is
the rule of the aggregate.

Rows of one id are one document, and so are all rows whose id is null, which is smaller than any other.
Null and empty texts are one empty line, which has no key. Repeated rows lose the same lines each. An
empty table gives an empty result. Columns of the input stay, but for those with the names of new ones.
The lines to drop of a row are gathered as positions, so no list is longer than its text; a key however
common is counted where it is read before it is shuffled.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import drop_later, shared_dir
from .common import stash, text_or_empty

BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
KEY = ["k1", "k2"]
RUN = "k1 long, k2 long, docs long, batch int, keeper long"


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER)


class LineRuns:
    """Levels of runs; ``levels[0]`` holds the newest. ``least_docs`` documents settle a key.

    A run has k1, k2, docs (how many documents of its batches hold the key), batch (the first of them)
    and keeper (the largest id in that batch).
    """

    def __init__(self, spark: SparkSession, least_docs: int, fanout: int = 3, buckets: int | None = None):
        self.spark, self.least_docs, self.fanout = spark, least_docs, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[tuple[str, str]]] = []  # table and folder of each run
        self.batches = 0

    def add(self, lines: DataFrame) -> None:
        """A batch of (k1, k2, id), an entry for each line or for each line and document."""
        keys = lines.groupBy(*KEY).agg((F.count_distinct("id") + F.max(F.col("id").isNull().cast("int"))).alias("docs"), F.max("id").cast("long").alias("keeper"))
        for name, _ in sum(self.levels, []):
            keys = keys.join(self.spark.table(name).where(F.col("docs") >= self.least_docs).select(*KEY), KEY, "left_anti")
        self._put(keys.select(*KEY, "docs", F.lit(self.batches).alias("batch"), "keeper"), 0)
        self.batches += 1

    def settled(self) -> DataFrame:
        """(k1, k2, keeper) of the keys that ``least_docs`` documents hold."""
        return self._merged([path for level in self.levels for _, path in level]).where(F.col("docs") >= self.least_docs).select(*KEY, "keeper")

    def drop(self) -> None:
        for name, _ in sum(self.levels, []):
            self.spark.sql(f"DROP TABLE {name}")
        self.levels = []

    def _merged(self, paths: list[str]) -> DataFrame:
        """Runs are read by their folders here: a union of bucketed tables counts as bucketed, which it is not."""
        if not paths:
            raise ValueError("no batch has been added")
        rows = self.spark.read.schema(RUN).parquet(*paths)
        return rows.groupBy(*KEY).agg(F.sum("docs").alias("docs"), F.min("batch").alias("batch"), F.min_by("keeper", "batch").alias("keeper"))

    def _put(self, rows: DataFrame, level: int) -> None:
        if level == len(self.levels):
            self.levels.append([])
        name = f"line_run_{uuid.uuid4().hex}"
        path = f"{shared_dir(self.spark)}/{name}"
        drop_later(path)
        rows.write.bucketBy(self.buckets, *KEY).sortBy(*KEY).option("path", path).saveAsTable(name)
        self.levels[level].insert(0, (name, path))
        if len(self.levels[level]) >= self.fanout:
            old, self.levels[level] = self.levels[level], []
            self._put(self._merged([path for _, path in old]), level + 1)
            for name, _ in old:
                self.spark.sql(f"DROP TABLE {name}")


def _batch_of(docs: DataFrame, id_col: str, batches: int) -> Column:
    """The batch of a row, 0 for the largest ids; ids of null come last. At most ``batches`` bounds reach the driver."""
    shares = [i / batches for i in range(batches - 1, 0, -1)]
    bounds = docs.agg(F.percentile_approx(id_col, shares, 1000).alias("b")).first().b if shares else None
    return sum((F.coalesce(F.col("id") <= b, F.lit(True)).cast("int") for b in sorted(set(bounds or ()), reverse=True)), F.lit(0))


def drop_repeated(docs: DataFrame, least_docs: int = 5, least_chars: int = 40, batches: int = 6, fanout: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with ``n_lines``, ``n_dropped`` and ``kept``, the text without the lines it loses.

    A line goes if its key has at least ``least_chars`` characters and stands in at least ``least_docs``
    documents, unless its document is the one with the largest id of them. Ids must be numbers.
    """
    text = text_or_empty(text_col)
    rows = docs.select(F.struct(*docs.columns).alias("doc"), F.col(id_col).alias("id"), text.alias("t"), F.xxhash64(text).alias("h"))
    long_line = lambda line: F.octet_length(line) >= least_chars  # noqa: E731  no key has more bytes than its line
    lines = rows.where(F.octet_length("t") >= least_chars).select("id", "h", F.posexplode(F.split("t", "\n")).alias("pos", "line")).where(long_line(F.col("line")))
    keyed = lines.select("id", "h", "pos", line_key(F.col("line")).alias("key")).where(F.char_length("key") >= least_chars)
    keyed = keyed.select("id", "h", "pos", F.xxhash64("key").alias("k1"), F.xxhash64(F.lit(1), "key").alias("k2"), _batch_of(docs, id_col, batches).alias("batch"))
    keyed = stash(keyed, "lines", by=("batch",))
    runs = LineRuns(docs.sparkSession, least_docs, fanout)
    for i in range(batches):
        runs.add(keyed.where(F.col("batch") == i).select("id", *KEY))
    settled = stash(runs.settled(), "settled")
    runs.drop()
    gone = keyed.join(settled, KEY).where(~F.col("id").eqNullSafe(F.col("keeper")))
    gone = gone.groupBy("id", "h").agg(F.collect_set("pos").alias("gone")).select(F.col("id").alias("_id"), F.col("h").alias("_h"), "gone")
    found = rows.join(gone, F.col("id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h")), "left")

    def without(x: Column) -> Column:
        """Of a row's lines and the positions that go, the text that is left; bound once, so that lines are split once."""
        stay = F.array_except(F.sequence(F.lit(0), F.size(x["lines"]) - 1), x["gone"])
        return F.array_join(F.transform(stay, lambda i: F.get(x["lines"], i)), "\n")

    cut = F.transform(F.array(F.struct(F.split("t", "\n").alias("lines"), F.col("gone"))), without)[0]
    new = {
        "n_lines": (F.char_length("t") - F.char_length(F.replace("t", F.lit("\n"), F.lit(""))) + 1).cast("long"),
        "n_dropped": F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long"),
        "kept": F.when(F.col("gone").isNull(), F.col("t")).otherwise(cut),
    }
    return found.select(*[F.col("doc")[c].alias(c) for c in docs.columns if c not in new], *[v.alias(k) for k, v in new.items()])
