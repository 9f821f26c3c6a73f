"""Export jobs: one slot a queue, claimed first come first served, folded from a log of events.

A job is idle, queued, building, ready or failed. The slot is claimed by a request when it is free and
released when the build fails, its bundle was fetched, or its owner is removed; the first in line then
claims it. A log is one queue's history in order, so queues run beside each other and a log runs alone:
a task reads it sorted, batch by batch, and holds the queue only. An event costs the logarithm of the line's length.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterable, Iterator, MutableMapping

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

IDLE = {"state": "idle", "zip_path": None, "zip_size": 0, "error": ""}
OUT = "queue string, seq bigint, kind string, slug string, state string, position bigint, started string"
OUT_NAMES = [c.split()[0] for c in OUT.split(", ")]
TYPES = [pa.int64() if c.endswith(" bigint") else pa.string() for c in OUT.split(", ")]


class Line:
    """Who waits, first come first served. Places are counts of earlier tickets, added up in a Fenwick tree."""

    def __init__(self, slugs: Iterable[str] = ()):
        self._tickets: OrderedDict[str, int] = OrderedDict.fromkeys(slugs, 0)
        self._renumber()

    def __contains__(self, slug: str) -> bool:
        return slug in self._tickets

    def __iter__(self) -> Iterator[str]:
        return iter(self._tickets)

    def __len__(self) -> int:
        return len(self._tickets)

    def _renumber(self) -> None:
        """Tickets from 1 again, with room for as many more."""
        n = len(self._tickets)
        self._tickets = OrderedDict(zip(self._tickets, range(1, n + 1)))
        self._next, self._size = n + 1, max(64, 2 * n)
        self._tree = [max(0, min(i, n) - (i - (i & -i))) for i in range(self._size + 1)]

    def _add(self, at: int, by: int) -> None:
        while at <= self._size:
            self._tree[at] += by
            at += at & -at

    def join(self, slug: str) -> None:
        """To the end of the line; who waits already keeps the place."""
        if slug in self._tickets:
            return
        if self._next > self._size:
            self._renumber()
        self._tickets[slug] = self._next
        self._add(self._next, 1)
        self._next += 1

    def leave(self, slug: str) -> None:
        at = self._tickets.pop(slug, None)
        if at is not None:
            self._add(at, -1)

    def pop_first(self) -> str:
        slug, at = self._tickets.popitem(last=False)
        self._add(at, -1)
        return slug

    def place(self, slug: str) -> int | None:
        """From 1; None for who doesn't wait."""
        at = self._tickets.get(slug)
        if at is None:
            return None
        n = 0
        while at:
            n += self._tree[at]
            at &= at - 1
        return n


class Queue:
    """Who has the slot, who waits for it, and the state of each slug."""

    def __init__(self, slot: str | None = None, waiting: Iterable[str] | None = None, states: MutableMapping | None = None):
        self.slot, self.waiting, self.states = slot, Line(waiting or ()), {} if states is None else states
        self.started: str | None = None

    def _put(self, slug: str, state: str, zip_path: str | None = None, zip_size: int = 0, error: str = "") -> None:
        self.states[slug] = {"state": state, "zip_path": zip_path, "zip_size": zip_size, "error": error}

    def _claim(self, slug: str) -> None:
        self.slot = self.started = slug
        self._put(slug, "building")

    def _release(self, slug: str) -> None:
        """If the slug has the slot, the first in line gets it."""
        if self.slot == slug:
            self.slot = None
            if self.waiting:
                self._claim(self.waiting.pop_first())

    def requested(self, slug: str, now: dict) -> None:
        served = self.slot == slug and (now["state"] == "building" or (now["state"] == "ready" and now["zip_path"]))
        if slug in self.waiting or served:
            return
        if self.slot is None:
            self._claim(slug)
        else:
            self.waiting.join(slug)
            self._put(slug, "queued")

    def apply(self, kind: str, slug: str, zip_path: str | None, zip_size: int | None, error: str | None) -> tuple:
        """(kind, slug, state, position from 1 or None, slug that starts to build or None) after an event; unknown kinds change nothing."""
        self.started = None
        now = self.states.get(slug, IDLE)
        if kind == "requested":
            self.requested(slug, now)
        elif kind == "built" and self.slot == slug:
            self._put(slug, "ready", zip_path, int(zip_size or 0))
        elif kind == "failed":
            self._put(slug, "failed", error=error or "")
            self._release(slug)
        elif kind == "fetched":
            if slug in self.states and (now["zip_path"] or "") == (zip_path or ""):
                self._put(slug, "idle")
            self._release(slug)
        elif kind == "removed":
            self.states.pop(slug, None)
            self.waiting.leave(slug)
            self._release(slug)
        elif kind == "lost" and now["state"] == "ready":
            self._put(slug, "failed", error="Prepared export file is missing")
        return kind, slug, self.states.get(slug, IDLE)["state"], self.waiting.place(slug), self.started


def _values(column: pa.Array) -> list:
    """``to_pylist`` at a tenth of its time; only integers with nulls would become floats on the way."""
    return column.to_pylist() if column.null_count and pa.types.is_integer(column.type) else column.to_numpy(zero_copy_only=False).tolist()


def fold(events: DataFrame) -> DataFrame:
    """What each event of (queue, seq, kind, slug, zip_path, zip_size, error) leads to; events of equal ``seq`` count once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queue, at, last = None, None, None
        for batch in batches:
            out = []
            for name, seq, *event in zip(*[_values(c) for c in batch.columns]):
                if queue is None or name != at:
                    queue, at = Queue(), name
                elif seq == last:
                    continue
                last = seq
                out.append((name, seq, *queue.apply(*event)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * len(TYPES), TYPES)], OUT_NAMES)

    rows = events.select("queue", F.col("seq").cast("bigint").alias("seq"), "kind", "slug", "zip_path", F.col("zip_size").cast("bigint").alias("zip_size"), "error")
    return rows.repartition("queue").sortWithinPartitions("queue", F.asc_nulls_last("seq")).mapInArrow(run, OUT)


def states(folded: DataFrame) -> DataFrame:
    """The state that each slug of a queue is in last: an event may change another slug's state by starting it."""
    own = folded.select("queue", "seq", "slug", "state")
    begun = folded.where("started is not null").select("queue", "seq", F.col("started").alias("slug"), F.lit("building").alias("state"))
    return own.unionByName(begun).groupBy("queue", "slug").agg(F.max_by("state", F.struct("seq", F.col("state") == "building")).alias("state"))
