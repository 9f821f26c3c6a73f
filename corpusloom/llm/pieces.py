"""SentencePiece encoding and decoding by a streaming Viterbi search.

The model file is read here and nothing is trained. Text goes through a lattice whose arcs are pieces;
for each end position one backpointer is kept, so a path is a chain of backpointers. Only positions
within one maximum piece length can still be continued; as soon as the chains of all of them meet at
one boundary, the ids before it are final, are emitted, and their part of the window is forgotten.
Memory is a window however long a text is, and each run that isn't in the memo goes through that search.

What a backpointer is chosen by depends on the model's type, so that ids equal the library's:

* unigram: the path of the largest sum of scores;
* BPE: the last piece that the merges give for the text up to the position. It is unique, and a piece
  can follow another exactly if the two, merged alone, fall back into the same two pieces; that is
  found by unwinding their merges. The search is then exact for BPE too, without a merge queue.

Characters without a piece become byte pieces if the model has them, else the unknown id. No piece of a
supported model holds a word-start mark behind another character, so a mark is always a boundary where
all paths meet; the runs between marks are looked up in a bounded memo first.

Null texts give null ids; empty texts give none. Decoding gives the text back unless it holds U+2581,
the mark itself, which reads as a space, or an unpaired surrogate. Repeated rows are encoded each; an
empty table gives an empty result; further columns pass through.
"""

from __future__ import annotations

import re
import struct
from array import array
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MARK = "▁"

# Piece and model types of the model file.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of each field of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            byte = data[at]
            at += 1
            out |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return out

    while at < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
            continue
        n = {1: 8, 5: 4}.get(key & 7) or varint()
        yield key >> 3, data[at : at + n]
        at += n


@dataclass
class PieceModel:
    pieces: list[str]
    scores: list[float]
    types: list[int]
    kind: int = UNIGRAM
    dummy_prefix: bool = True
    squeeze: bool = True
    escape: bool = True
    ids: dict[str, int] = field(init=False)

    @classmethod
    def parse(cls, data: bytes) -> PieceModel:
        pieces, scores, types = [], [], []
        options = {"kind": UNIGRAM, "dummy_prefix": True, "squeeze": True, "escape": True}
        for number, value in _fields(data):
            if number == 1:
                entry = dict(_fields(value))
                pieces.append(entry.get(1, b"").decode())
                scores.append(struct.unpack("<f", entry[2])[0] if 2 in entry else 0.0)
                types.append(entry.get(3, NORMAL))
            elif number == 2:
                options["kind"] = dict(_fields(value)).get(3, UNIGRAM)
            elif number == 3:
                norm = dict(_fields(value))
                if norm.get(2):
                    raise ValueError("models with a character map are not supported")
                options |= {"dummy_prefix": bool(norm.get(3, 1)), "squeeze": bool(norm.get(4, 1)), "escape": bool(norm.get(5, 1))}
        return cls(pieces, scores, types, **options)

    def __post_init__(self) -> None:
        if self.kind not in (UNIGRAM, BPE) or self.squeeze or not self.escape or USER in self.types:
            raise ValueError("only unigram and BPE models that keep white space and have no user pieces are supported")
        self.ids = {p: i for i, p in enumerate(self.pieces) if self.types[i] == NORMAL}
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("a piece holds a word-start mark behind another character")
        self.longest = max(map(len, self.ids), default=1)
        self.bytes_ = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if self.types[i] == BYTE}
        self.unknown = self.types.index(UNKNOWN) if UNKNOWN in self.types else 0
        self.unknown_score = min((self.scores[i] for i in self.ids.values()), default=0.0) - 10.0
        self.parts: dict[int, tuple[int, int] | None] = {}
        self.fits: dict[int, bool] = {}
        self.trie: dict = {}  # by character; the empty key holds the id of the piece that ends here
        for piece, i in self.ids.items():
            if self.kind == UNIGRAM or self.reachable(i):
                node = self.trie
                for char in piece:
                    node = node.setdefault(char, {})
                node[""] = i

    # -- BPE: how a piece is made, and whether two pieces stay apart

    def _rank(self, i: int) -> float:
        return -self.scores[i]

    def split(self, i: int) -> tuple[int, int] | None:
        """The last merge that makes piece ``i`` from its characters, or None if it is one or can't be made."""
        if i not in self.parts:
            parts, last = list(self.pieces[i]), None
            while len(parts) > 1:
                ranked = [(self._rank(self.ids[x]), k) for k in range(len(parts) - 1) if (x := parts[k] + parts[k + 1]) in self.ids]
                if not ranked:
                    last = None
                    break
                k = min(ranked)[1]  # best rank, leftmost
                last = (parts[k], parts[k + 1])
                parts[k : k + 2] = [parts[k] + parts[k + 1]]
            known = last is not None and last[0] in self.ids and last[1] in self.ids
            self.parts[i] = (self.ids[last[0]], self.ids[last[1]]) if known else None
        return self.parts[i]

    def reachable(self, i: int) -> bool:
        return len(self.pieces[i]) == 1 or self.split(i) is not None

    def apart(self, a: int, b: int) -> bool:
        """Whether the merges leave ``a`` followed by ``b`` as these two pieces.

        The newest merges are undone one after another, on whichever side was merged later. At each
        stage a merge across the seam would have come before what has been undone exactly if its rank is
        better; in a tie of ranks the left one comes first.
        """
        key = a << 32 | b
        known = self.fits.get(key)
        if known is not None:
            return known
        left, right = a, b
        # what was undone so far was made at (rank, side); a seam merge wins if it comes before that
        undone: tuple[float, int] | None = None
        ok = True
        while True:
            across = self.ids.get(self.pieces[left] + self.pieces[right])
            if across is not None and (undone is None or (self._rank(across), 1) < undone):
                ok = False
                break
            made_left, made_right = self.split(left), self.split(right)
            if made_left is None and made_right is None:
                break
            # order of making: by rank; at the same rank the left piece first, so the right one is the newer
            if made_right is None or made_left is not None and self._rank(left) > self._rank(right):
                undone, left = (self._rank(left), 0), made_left[1]
            else:
                undone, right = (self._rank(right), 2), made_right[0]
        if len(self.fits) > 300_000:
            self.fits.clear()
        self.fits[key] = ok
        return ok


#: Characters that a stream takes in at once.
PART = 256


class Stream:
    """The search over one text, fed in parts of any size; final ids appear in ``out``.

    Starts are taken in turn, each as soon as one maximum piece length lies ahead of it: it walks down
    the trie and offers itself as the backpointer of every position where a piece ends. For BPE at most
    one piece fits a position; for unigram models the best sum of scores stays. Positions ahead of the
    starts taken so far are the ends of all paths that survive; where their chains meet, what lies before
    is emitted and leaves the window.
    """

    __slots__ = ("at", "fed", "model", "out", "piece", "score", "start", "window")

    def __init__(self, model: PieceModel, text: str = "") -> None:
        self.model = model
        self.out = array("i")
        self.fed = len(text)  # characters so far
        self._restart(text)

    def _restart(self, window: str) -> None:
        self.window = window  # characters from the last boundary that all paths share
        self.at = 0  # the next start
        n = len(window) + 1
        self.piece: list[int | None] = [None] * n  # by position: the piece that ends there, -1 before all
        self.piece[0] = -1
        self.start = [0] * n
        self.score = [0.0] * n if self.model.kind == UNIGRAM else []

    def feed(self, chars: str) -> None:
        self.fed += len(chars)
        longest = self.model.longest
        for at in range(0, len(chars), PART):  # the window stays small, so that moving it on is cheap
            part = chars[at : at + PART]
            self.window += part
            self.piece += [None] * len(part)
            self.start += [0] * len(part)
            if self.model.kind == UNIGRAM:
                self.score += [0.0] * len(part)
            while len(self.window) - self.at > 2 * longest:
                self._advance(self.at + longest)
                self._commit()

    def close(self) -> array:
        longest = self.model.longest
        while len(self.window) - self.at > longest:
            self._advance(self.at + longest)
            self._commit()
        self._advance(len(self.window))
        self._emit(len(self.window))
        return self.out

    def _advance(self, to: int) -> None:
        """Take the starts before ``to``; characters ahead of them suffice for the longest piece, or the text ends."""
        (self._merges if self.model.kind == BPE else self._sums)(to)

    def _merges(self, to: int) -> None:
        model, trie = self.model, self.model.trie
        known, apart, longest = model.fits.get, model.apart, model.longest
        window, piece, back = self.window, self.piece, self.start
        for start in range(self.at, to):
            if window[start] not in trie:
                # no piece has this character: what came before is final, and the character stands alone
                self._emit(start)
                self._raw(window[start])
                self._restart(window[start + 1 :])
                return self._merges(min(to - start - 1, len(self.window))) if to > start + 1 else None
            before, node, end = piece[start], trie, start
            pair = before << 32
            for char in window[start : start + longest]:
                if char not in node:
                    break
                node = node[char]
                end += 1
                if piece[end] is None and "" in node:
                    i = node[""]
                    fit = before < 0 or known(pair | i)
                    if apart(before, i) if fit is None else fit:
                        piece[end] = i
                        back[end] = start
        self.at = to

    def _sums(self, to: int) -> None:
        model, trie = self.model, self.model.trie
        window, piece, back, score = self.window, self.piece, self.start, self.score
        for start in range(self.at, to):
            if piece[start] is None:
                continue
            so_far = score[start]
            if window[start] not in model.ids:
                told = so_far + model.unknown_score
                if piece[start + 1] is None or told > score[start + 1]:
                    piece[start + 1], back[start + 1], score[start + 1] = -2, start, told
            node, end = trie, start
            for char in window[start : start + model.longest]:
                node = node.get(char)
                if node is None:
                    break
                end += 1
                i = node.get("")
                if i is not None:
                    told = so_far + model.scores[i]
                    if piece[end] is None or told > score[end]:
                        piece[end], back[end], score[end] = i, start, told
        self.at = to

    def _commit(self) -> None:
        """Emit what all paths share: follow the chains of the surviving ends until they meet."""
        alive = [p for p in range(self.at, min(self.at + self.model.longest, len(self.window)) + 1) if self.piece[p] is not None]
        alive.reverse()
        while len(alive) > 1:  # the farthest one steps back; positions are merged where chains meet
            q = self.start[alive.pop(0)]
            if q not in alive:
                alive.append(q)
                alive.sort(reverse=True)
        if not alive or not alive[0]:
            return
        cut = alive[0]
        self._emit(cut)
        self.window, self.at = self.window[cut:], self.at - cut
        if self.at < 0:  # a single path ends ahead of the starts taken; the positions before its end are on no path
            self.at = 0
        self.piece = self.piece[cut:]  # the piece before the boundary still decides what may follow
        self.start = [max(0, x - cut) for x in self.start[cut:]]
        self.score = [x - self.score[cut] for x in self.score[cut:]]

    def _emit(self, end: int) -> None:
        chain, p = [], end
        while p > 0:
            chain.append(p)
            p = self.start[p]
        for p in reversed(chain):
            i = self.piece[p]
            if i == -2:
                self._raw(self.window[self.start[p]])
            else:
                self.out.append(i)

    def _raw(self, char: str) -> None:
        model = self.model
        if model.bytes_:
            self.out.extend(model.bytes_[b] for b in char.encode("utf-8", "replace"))
        elif not (model.kind == UNIGRAM and len(self.out) and self.out[-1] == model.unknown):
            self.out.append(model.unknown)


#: Runs that a worker remembers.
MEMO = 400_000


class Codec:
    """Encoder and decoder with a bounded memo of the runs between word-start marks, in two generations."""

    RUN = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")

    def __init__(self, data: bytes, memo: int = MEMO, memo_run: int = 64) -> None:
        self.model = PieceModel.parse(data)
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.memo_size, self.memo_run = memo // 2, memo_run
        self.bytes_of = [p.replace(MARK, " ").encode() for p in self.model.pieces]
        for value, i in self.model.bytes_.items():
            self.bytes_of[i] = bytes([value])
        for i, kind in enumerate(self.model.types):
            if kind == CONTROL:
                self.bytes_of[i] = b""
            elif kind == UNKNOWN:
                self.bytes_of[i] = " ⁇ ".encode()

    def _run(self, key: str, run: str) -> bytes:
        ids = self.old.get(key)
        if ids is None:
            stream = Stream(self.model, run if len(run) <= PART else "")
            if len(run) > PART:
                stream.feed(run)
            ids = stream.close().tobytes()
        if len(run) <= self.memo_run:  # long runs are seldom seen again
            if len(self.young) >= self.memo_size:
                self.old, self.young = self.young, {}
            self.young[key] = ids
        return ids

    def encode(self, text: str) -> array:
        out = array("i")
        if not text:
            return out
        prefix = MARK if self.model.dummy_prefix else ""
        plain = prefix and MARK not in text and "  " not in text and text[0] != " "
        # where every mark stands before one word, the word is the key: narrow strings take half the memory
        keys = text.split(" ") if plain else self.RUN.findall(prefix + text.replace(" ", MARK))
        for at in range(0, len(keys), 65_536):
            some = keys[at : at + 65_536]
            found = list(map(self.young.get, some))
            if None in found:
                for i, ids in enumerate(found):
                    if ids is None:
                        ids = self.young.get(some[i])  # it may have come up since
                        found[i] = self._run(some[i], prefix + some[i] if plain else some[i]) if ids is None else ids
            out.frombytes(b"".join(found))
        return out

    def decode(self, ids) -> str:
        table = self.bytes_of
        text = b"".join(map(table.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.model.dummy_prefix and text.startswith(" ") else text


def model_bytes(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


_CODECS: dict[tuple[bytes, int], Codec] = {}


def codec_for(model: bytes, memo: int = MEMO) -> Codec:
    """One codec a Python worker, so that later tasks find the memo warm."""
    if (model, memo) not in _CODECS:
        _CODECS.clear()
        _CODECS[model, memo] = Codec(model, memo)
    return _CODECS[model, memo]


def encode(docs: DataFrame, model: bytes, text_col: str = "text", ids_col: str = "ids", check_col: str | None = None, memo: int = MEMO) -> DataFrame:
    """``docs`` with ``ids_col`` added, and if named, ``check_col``: whether decoding gives the text back.

    The model (a file of fixed size, read by the driver) travels with the task. A worker remembers up to
    ``memo`` runs, some 200 bytes each. Columns of these names
    that are there already are replaced.
    """
    docs = docs.drop(ids_col, *([check_col] if check_col else []))
    fields = [T.StructField(ids_col, T.ArrayType(T.IntegerType(), False))] + ([T.StructField(check_col, T.BooleanType())] if check_col else [])
    schema = T.StructType([*docs.schema.fields, *fields])
    names = docs.columns

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_for(model, memo)
        for batch in it:
            column = batch.column(names.index(text_col))
            for start in range(0, batch.num_rows, 256):  # small outputs: ids of a batch of long texts are many
                part = batch.slice(start, 256)
                flat, offsets, null, checks = array("i"), [0], [], []
                for value in column.slice(start, 256):
                    text = value.as_py()
                    ids = codec.encode(text) if text is not None else None
                    null.append(ids is None)
                    if ids is not None:
                        flat.extend(ids)
                    if check_col:
                        checks.append(None if ids is None else codec.decode(ids) == text)
                    offsets.append(len(flat))
                values = pa.Array.from_buffers(pa.int32(), len(flat), [None, pa.py_buffer(flat)])
                ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values, mask=pa.array(null, pa.bool_()))
                ids = ids.cast(pa.list_(pa.field("element", pa.int32(), nullable=False)))
                extra = [pa.array(checks, pa.bool_())] if check_col else []
                yield pa.RecordBatch.from_arrays([*part.columns, ids, *extra], names=[f.name for f in schema.fields])

    return docs.mapInArrow(batches, schema)


def decode(rows: DataFrame, model: bytes, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """``rows`` with ``text_col`` added or replaced: the text of the ids; null ids give null."""
    rows = rows.drop(text_col)
    schema = T.StructType([*rows.schema.fields, T.StructField(text_col, T.StringType())])
    at = rows.columns.index(ids_col)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_for(model)
        for batch in it:
            texts = [None if ids is None else codec.decode(ids) for ids in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[f.name for f in schema.fields])

    return rows.mapInArrow(batches, schema)
