"""Keyed state across micro-batches: answers that arrive in pieces, and export queues folded from their events.

Both take pieces in any order and more than once: what is ahead of its turn waits in the state, what had
its turn is left out, so a stream that is cut, shuffled or replayed gives what the one-row form gives.
State lives in the RocksDB provider, which ``state_store`` sets. With a ``ttl`` an answer or a queue is
forgotten when nothing came for so long; as time passes without rows too, such a stream runs until it is
stopped, whatever its trigger.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions.text import WHITE
from ..operators.exports import OUT as EXPORT_OUT
from ..operators.exports import Queue

BLANKS = " \t\n\x0b\x0c\r"


def state_store(spark: SparkSession) -> None:
    """The provider that these processors need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class PiecesInOrder(StatefulProcessor):
    """Rows of a key by ``seq`` from 0, dense; ``fold`` sees each once and in order.

    A key's state is one value, read and written once a micro-batch: the turn that is next, the rows that
    came before theirs, and what the fold keeps.
    """

    columns: tuple[str, ...] = ()
    out: tuple[str, ...] = ()

    def __init__(self, ttl: timedelta | None = None):
        self.ttl = int(ttl.total_seconds() * 1000) if ttl else None

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", "json string", self.ttl)

    def fold(self, kept: dict, seq: int, row: list) -> tuple:
        raise NotImplementedError

    def stored(self, kept: dict) -> dict:
        """What is kept, as JSON can say it."""
        return kept

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = self.held.get()
        turn, waiting, kept = json.loads(held[0]) if held else (0, {}, {})
        for frame in rows:
            for r in frame[["seq", *self.columns]].itertuples(index=False):
                if r.seq >= turn:
                    waiting.setdefault(str(int(r.seq)), [None if pd.isna(x) else x.item() if hasattr(x, "item") else x for x in r[1:]])
        out = []
        while (row := waiting.pop(str(turn), None)) is not None:
            out.append((key[0], turn, *self.fold(kept, turn, row)))
            turn += 1
        self.held.update((json.dumps([turn, waiting, self.stored(kept)]),))
        yield pd.DataFrame(out, columns=self.out)

    def close(self) -> None:
        pass


class AnswerParts(PiecesInOrder):
    """Pieces of an answer's parts (part from 1, text, last: whether the part ends here) without what repeats the draft.

    The draft of a part is the tail of what was let through before it. A part loses the longest prefix it
    shares with its draft and, if that is all of the draft, the blanks behind it; the first part has no
    draft. Nothing has to be held back for that: what agrees with the draft so far is dropped whether the
    part goes on to repeat it or not.
    """

    columns = ("part", "text", "last")
    out = ("answer_id", "seq", "part", "text", "draft")

    def __init__(self, most: int = 1400, ttl: timedelta | None = None):
        super().__init__(ttl)
        self.most = most

    def fold(self, kept: dict, seq: int, row: list) -> tuple:
        # matched: characters of the draft seen again, -1 when the part has parted from it
        draft, matched, passed = kept.get("draft", ""), kept.get("matched", 0), kept.get("passed", "")
        part, text, last = row
        told = draft
        matched, text = unrepeated(draft, matched, text or "")
        passed += text
        if last:
            if passed.strip(WHITE):
                draft = f"{draft}\n\n{passed}" if draft else passed
                draft = draft.strip(WHITE)[-self.most :].strip(WHITE)
            matched, passed = 0, ""
        kept.update(draft=draft, matched=matched, passed=passed)
        return part, text, told


def unrepeated(draft: str, matched: int, text: str) -> tuple[int, str]:
    """The state after ``text``, and what of it is not a repeat of the draft."""
    if not draft or matched < 0:
        return matched, text
    at = 0
    while at < len(text) and matched < len(draft):
        if text[at] != draft[matched]:
            return -1, text[at:]
        at, matched = at + 1, matched + 1
    if matched < len(draft):
        return matched, ""
    rest = text[at:].lstrip(BLANKS)
    return (-1, rest) if rest else (matched, "")


def answer_stream(pieces: DataFrame, most: int = 1400, ttl: timedelta | None = None) -> DataFrame:
    """(answer_id, seq, part, text, draft) of a stream of (answer_id bigint, seq, part, text, last)."""
    state_store(pieces.sparkSession)
    rows = pieces.selectExpr("answer_id", "seq", "part", "text", "last")
    return rows.groupBy("answer_id").transformWithStateInPandas(AnswerParts(most, ttl), "answer_id bigint, seq bigint, part int, text string, draft string", "Append", "ProcessingTime" if ttl else "None")


class ExportQueues(PiecesInOrder):
    """The fold of ``exports.Queue`` over a stream of a queue's events."""

    columns = ("kind", "slug", "zip_path", "zip_size", "error")
    out = ("queue", "seq", "kind", "slug", "state", "position", "started")

    def fold(self, kept: dict, seq: int, row: list) -> tuple:
        if "queue" not in kept:
            kept["queue"] = Queue(kept.get("slot"), kept.get("waiting"), kept.get("states"))
        return kept["queue"].apply(*row)

    def stored(self, kept: dict) -> dict:
        queue = kept.get("queue")
        return {"slot": queue.slot, "waiting": list(queue.waiting), "states": queue.states} if queue else kept

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for frame in super().handleInputRows(key, rows, timerValues):
            yield frame.astype({"position": "Int64"})


def export_stream(events: DataFrame, ttl: timedelta | None = None) -> DataFrame:
    """What each event leads to; see ``exports.Queue``. A queue without a ``ttl`` is kept for good."""
    state_store(events.sparkSession)
    rows = events.selectExpr("queue", "seq", "kind", "slug", "zip_path", "zip_size", "error")
    return rows.groupBy("queue").transformWithStateInPandas(ExportQueues(ttl), EXPORT_OUT, "Append", "ProcessingTime" if ttl else "None")
