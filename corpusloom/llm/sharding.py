"""Resharding by minimum-cost flow.

Old shards are cut into blocks by a hash of the id, the text and the number of a run of equal rows, so
that neither an id (or the null id) with many rows nor a row with many copies makes a block that can't
be divided. From the bytes each old shard holds and the capacity each new shard gets, a minimum-cost
flow says how many bytes go from where to where; whole blocks are then chosen to carry that flow, and
only shards that gain or lose blocks are rewritten. The driver sees ``old_shards * blocks`` sizes, a
number fixed by parameters and not by the data.

Null texts count as empty, null ids hash like any value, repeated rows get a place each (equal rows are
interchangeable), an empty table gives an empty placement, and columns beyond the id and the text are
ignored.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from .common import stash, text_or_empty

ROW_OVERHEAD = 16


@dataclass
class Arc:
    to: int
    room: int
    cost: int
    back: int


@dataclass
class FlowNet:
    """Successive shortest paths with potentials on a small graph with integer capacities."""

    n: int
    arcs: list[list[Arc]] = field(init=False)

    def __post_init__(self) -> None:
        self.arcs = [[] for _ in range(self.n)]

    def connect(self, a: int, b: int, room: int, cost: int) -> Arc:
        there, here = Arc(b, room, cost, len(self.arcs[b])), Arc(a, 0, -cost, len(self.arcs[a]))
        self.arcs[a].append(there)
        self.arcs[b].append(here)
        return there

    def run(self, source: int, sink: int) -> tuple[int, int]:
        """Send all that fits; returns the amount and its cost. Costs must not be negative."""
        height, sent, paid = [0] * self.n, 0, 0
        while True:
            far: list[int | None] = [None] * self.n
            via: list[Arc | None] = [None] * self.n
            far[source], heap = 0, [(0, source)]
            while heap:
                d, v = heapq.heappop(heap)
                if d > far[v]:
                    continue
                for arc in self.arcs[v]:
                    if arc.room > 0 and (far[arc.to] is None or d + arc.cost + height[v] - height[arc.to] < far[arc.to]):
                        far[arc.to] = d + arc.cost + height[v] - height[arc.to]
                        via[arc.to] = arc
                        heapq.heappush(heap, (far[arc.to], arc.to))
            if far[sink] is None:
                return sent, paid
            reached = max(x for x in far if x is not None)
            height = [h + (reached if x is None else x) for h, x in zip(height, far, strict=True)]
            path, v = [], sink
            while v != source:
                path.append(via[v])
                v = self.arcs[v][via[v].back].to
            amount = min(arc.room for arc in path)
            for arc in path:
                arc.room -= amount
                self.arcs[arc.to][arc.back].room += amount
                paid += amount * arc.cost
            sent += amount


def plan_flow(sizes: list[int], capacities: list[int], cost=lambda old, new: 0 if old == new else 1) -> dict[tuple[int, int], int]:
    """Bytes to place from each old shard into each new one, at the least total cost."""
    n_old, n_new = len(sizes), len(capacities)
    net = FlowNet(n_old + n_new + 2)
    source, sink = n_old + n_new, n_old + n_new + 1
    lanes = {}
    for i, size in enumerate(sizes):
        net.connect(source, i, size, 0)
        for j in range(n_new):
            lanes[i, j] = net.connect(i, n_old + j, size, cost(i, j))
    for j, room in enumerate(capacities):
        net.connect(n_old + j, sink, room, 0)
    net.run(source, sink)
    return {k: sizes[k[0]] - arc.room for k, arc in lanes.items() if sizes[k[0]] > arc.room}


def capacities_for(total: int, shards: int) -> list[int]:
    return [total // shards + (j < total % shards) for j in range(shards)]


def place_blocks(blocks: dict[tuple[int, int], int], old_shards: int, new_shards: int, spread: float = 0.01, rounds: int = 20_000) -> dict[tuple[int, int], int]:
    """The new shard of each (old shard, block).

    Blocks of an old shard fill its lanes, largest block to the lane with most room left; in a tie the
    lane that stays. Rounding to whole blocks leaves shards uneven; blocks are then moved or swapped
    between the fullest shard and the emptiest one until the two differ by at most ``spread`` of a mean
    shard, or no step narrows the gap. Of the steps that close at least half of the gap the one is taken
    that moves the fewest bytes away from their old shards.
    """
    sizes = [0] * old_shards
    for (old, _), size in blocks.items():
        sizes[old] += size
    flow = plan_flow(sizes, capacities_for(sum(sizes), new_shards))
    placed: dict[tuple[int, int], int] = {}
    load = [0] * new_shards
    by_old: dict[int, list[tuple[int, tuple[int, int]]]] = {}
    for key, size in blocks.items():
        by_old.setdefault(key[0], []).append((size, key))
    for old in range(old_shards):
        lanes = [(-amount, new != old, new) for (i, new), amount in flow.items() if i == old] or [(0, False, min(old, new_shards - 1))]
        heapq.heapify(lanes)
        for size, key in sorted(by_old.get(old, ()), key=lambda x: (-x[0], x[1])):
            room, moves, new = heapq.heappop(lanes)
            placed[key] = new
            load[new] += size
            heapq.heappush(lanes, (room + size, moves, new))
    held: list[set] = [set() for _ in range(new_shards)]
    for key, new in placed.items():
        held[new].add(key)
    enough = spread * sum(sizes) / max(1, new_shards)

    def moved(key: tuple[int, int] | None, to: int) -> int:
        """Bytes that leave their old shard if ``key`` lies in ``to``."""
        return 0 if key is None or key[0] == to else blocks[key]

    def step(high: int, low: int) -> tuple | None:
        """The best move or swap of a block of ``high`` for none or one of ``low``, if any narrows the gap."""
        gap = load[high] - load[low]
        give = sorted((blocks[k], k) for k in held[high])
        take = sorted([(0, (-1, -1)), *((blocks[k], k) for k in held[low])])
        best, i = None, 0
        for size, key in give:  # partners whose difference is near half the gap, by two pointers
            while i + 1 < len(take) and size - take[i + 1][0] >= gap / 2:
                i += 1
            for other_size, other in take[max(0, i - 2) : i + 4]:
                gain = size - other_size
                if not 0 < gain < gap:
                    continue
                other = None if other[0] < 0 else other
                cost = moved(key, low) - moved(key, high) + moved(other, high) - moved(other, low)
                off = abs(gain - gap / 2)
                rated = (off > gap / 4, cost if off <= gap / 4 else off, off, key)
                if best is None or rated < best[0]:
                    best = (rated, key, other)
        return best

    for _ in range(rounds if new_shards > 1 else 0):
        by_load = sorted(range(new_shards), key=lambda j: (load[j], j))
        if load[by_load[-1]] - load[by_load[0]] <= enough:
            break
        # the widest gap that some step narrows, the fullest shard against others or the emptiest one against others
        pairs = [(by_load[-1], low) for low in by_load[:-1]] + [(high, by_load[0]) for high in by_load[-2:0:-1]]
        found = next(((high, low, best) for high, low in pairs if (best := step(high, low))), None)
        if found is None:
            break
        high, low, best = found
        for key, a, b in ((best[1], high, low), (best[2], low, high)):
            if key is not None:
                held[a].discard(key)
                held[b].add(key)
                placed[key] = b
                load[a] -= blocks[key]
                load[b] += blocks[key]
    return placed


#: Equal rows go to blocks in runs of this many.
RUN = 16


def reshard(docs: DataFrame, old_shards: int = 32, new_shards: int = 40, blocks: int = 256, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Place every row: id, size, text_crc32, text_hash, old_shard, block, shard and slot (gapless from 0 in a shard).

    A slot is the offset of its block plus the row's number in the block, so no window holds a shard.
    Equal rows are one row with a count until they are dealt to blocks, run by run.
    """
    text = text_or_empty(text_col)
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + ROW_OVERHEAD).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("text_hash"),
        F.pmod(F.xxhash64(F.col(id_col)), F.lit(old_shards)).cast("int").alias("old_shard"),
    )
    equal = ["doc_id", "size", "text_crc32", "text_hash", "old_shard"]
    rows = rows.groupBy(*equal).agg(F.count("*").alias("copies"))
    runs = rows.withColumn("_run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / RUN).cast("long"))))
    h = F.xxhash64("doc_id", "text_hash", "_run")
    runs = runs.withColumn("block", F.pmod(F.shiftright(h, 20), F.lit(blocks)).cast("int")).withColumn("n", F.least(F.lit(RUN).cast("long"), F.col("copies") - F.col("_run") * RUN))
    runs = stash(runs.drop("copies"), "runs")
    found = runs.groupBy("old_shard", "block").agg(F.sum(F.col("size") * F.col("n")).alias("bytes"), F.sum("n").alias("n")).collect()  # at most old_shards * blocks rows
    bytes_of = {(r.old_shard, r.block): r.bytes for r in found}
    count_of = {(r.old_shard, r.block): r.n for r in found}
    placed = place_blocks(bytes_of, old_shards, new_shards)
    offset, table = [0] * new_shards, []
    for key in sorted(placed):
        table.append((*key, placed[key], offset[placed[key]]))
        offset[placed[key]] += count_of[key]
    schema = T.StructType([T.StructField("old_shard", T.IntegerType()), T.StructField("block", T.IntegerType()), T.StructField("shard", T.IntegerType()), T.StructField("_first", T.LongType())])
    plan = docs.sparkSession.createDataFrame(table, schema)
    in_block = W.partitionBy("old_shard", "block").orderBy("doc_id", "text_crc32", "size", "text_hash", "_run")
    before = F.sum("n").over(in_block.rowsBetween(W.unboundedPreceding, 0)) - F.col("n")
    return (
        runs.join(F.broadcast(plan), ["old_shard", "block"])  # at most old_shards * blocks rows
        .withColumn("_at", F.col("_first") + before)
        .withColumn("slot", F.explode(F.sequence(F.col("_at"), F.col("_at") + F.col("n") - 1)))  # at most RUN
        .select("doc_id", "size", "text_crc32", "text_hash", "old_shard", "block", "shard", "slot")
    )


def affected_shards(placement: DataFrame) -> DataFrame:
    """Shards that gain or lose rows, with the bytes that come and go; the others keep their files."""
    moved = placement.where(F.col("old_shard") != F.col("shard"))
    come = moved.groupBy(F.col("shard")).agg(F.sum("size").alias("bytes_in"), F.lit(0).cast("long").alias("bytes_out"))
    go = moved.groupBy(F.col("old_shard").alias("shard")).agg(F.lit(0).cast("long").alias("bytes_in"), F.sum("size").alias("bytes_out"))
    return come.unionByName(go).groupBy("shard").agg(F.sum("bytes_in").alias("bytes_in"), F.sum("bytes_out").alias("bytes_out"))


def rewrite_affected(docs: DataFrame, placement: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the rows of shards that change under ``path/shard=N``; shards without moves are not touched.

    The new rows are written beside the old ones first, so ``docs`` may be read from ``path``; then each
    changed shard's folder is replaced, and that of a shard that lost all its rows is deleted. Rows are
    matched by id and text; the copies of a row, equal in both, are numbered on either side.
    """
    spark = docs.sparkSession
    changed = stash(affected_shards(placement).select("shard"), "affected")  # at most one row a shard
    numbered = lambda df, order: df.withColumn("n", F.row_number().over(W.partitionBy("id", "hash").orderBy(*order)))
    where = placement.select(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"), "shard", "slot")
    where = numbered(where, ("shard", "slot")).join(F.broadcast(changed), "shard")
    own = [c for c in docs.columns if c not in ("shard", "slot")]
    rows = docs.select(F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(own)]).alias("doc"), F.col(id_col).alias("id"), F.xxhash64(text_or_empty(text_col)).alias("hash"))
    rows = numbered(rows, ("id",))
    same = rows["id"].eqNullSafe(where["id"]) & (rows["hash"] == where["hash"]) & (rows["n"] == where["n"])
    found = rows.join(where, same).select(*[rows["doc"][f"c{i}"].alias(c) for i, c in enumerate(own)], where["slot"], where["shard"])
    beside = stash(found, "rewritten")
    beside.write.partitionBy("shard").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
    filled = {r.shard for r in beside.select("shard").distinct().collect()}
    for shard in sorted({r.shard for r in changed.collect()} - filled):
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/shard={shard}")
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
