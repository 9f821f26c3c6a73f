"""LM scoring by prediction by partial matching (PPM), with a unigram base beside it.

A whole text is coded byte by byte, white space as any other, and an end symbol after the last byte. The
PPM model is a trie of byte contexts of up to DEPTH symbols, the text's start included, pretrained on the
texts of the training documents. A symbol is coded in the longest context that was
seen; one that never followed it costs an escape (method C: distinct / (total + distinct)) and is coded
in the next shorter context, where symbols that the longer one offered are excluded; below order 0 all
symbols left are equal. As the model is fixed, the code length of a symbol is a function of its gram, the
symbol and the DEPTH before it, and that of a text is the sum over its grams.

Grams and words grow with the corpus, so neither is gathered in one place. Documents go in chunks of a
bounded number of bytes; a chunk has each of its distinct grams and words once, dealt to slices by the hash of
a gram's context or a word. A slice adds up what the chunks have, and codes the grams that training texts hold by their
whole context. Others need shorter contexts: they meet the counts of order 5, which are plain aggregates, where
the last four context symbols are equal, and those of order 3 by a join. The answers of a slice
go back to its chunks, with their names. What one group holds is bounded: a chunk by its bytes, a slice as there is one for each
chunk's bytes of text, and what shares four context symbols by the alphabet. The
driver sees the counts of orders 0 to 2 only, whose number is bounded by the alphabet.

Null texts count as empty. Repeated rows are scored each. Without training documents every symbol costs
log10(257). An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, stash, text_or_empty, unstash

CHUNK_BYTES = 24_000_000
CHUNK_DOCS = 65_535
LEVEL = 5  # of compression: what chunks and slices send each other is most of what is written
BLOCK = 1_000_000  # symbols whose grams are worked out at once
DOCS, GRAMS, WORDS = 0, 1, 2

#: Of a chunk's documents (DOCS) what ``DOC`` holds and their texts; of its grams or words in a slice the names, in order, and how often training texts have them. All packed.
PARTIAL = "chunk long, kind int, slice int, names binary, data binary"

#: Of a chunk's grams or words in a slice, in order, the names, so that the chunk needn't gather them again, and the counts ``n``; of grams also what they are divided by (0: never seen), and of those never seen the log10 probabilities.
ANSWER = "of_chunk long, kind int, slice int, names binary, n binary, scale binary, rest binary"
DOC = np.dtype([("id", "<i8"), ("no_id", "?"), ("bytes", "<i8"), ("train", "?")])

DEPTH = 6
BITS = 9  # of a symbol; DEPTH + 1 symbols fit a long
START, END, PAD = 256, 258, 259  # START + kind
MASK = (1 << BITS) - 1
SYMBOLS = 257  # what can be coded: bytes and END


def symbols_mask(n: int) -> int:
    """Of the last ``n`` symbols of a gram."""
    return (1 << BITS * n) - 1


def grams_of(data: np.ndarray, lengths: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Codes of all symbols of texts, ends included, with the DEPTH symbols before each; ``lengths + 1`` of each text."""
    lengths = lengths.astype(np.int64)
    size = lengths + DEPTH + 1
    first = np.cumsum(size) - size
    symbols = np.full(int(size.sum()), PAD, np.int64)
    symbols[first + DEPTH - 1] = START + kinds
    within = np.cumsum(lengths) - lengths
    symbols[np.arange(len(data)) + np.repeat(first + DEPTH - within, lengths)] = data
    symbols[first + size - 1] = END
    codes = symbols[DEPTH:].copy()
    for k in range(1, DEPTH + 1):
        codes |= symbols[DEPTH - k : -k] << (BITS * k)
    coded = lengths + 1
    return codes[np.arange(int(coded.sum())) + np.repeat(first - (np.cumsum(coded) - coded), coded)]


def blocks(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(codes, text of each), in turn, some BLOCK at a time; a longer text comes in pieces."""

    def told(a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        lengths = np.fromiter(map(len, texts[a:b]), np.int64, b - a)
        data = np.frombuffer(b"".join(texts[a:b]), np.uint8)
        return grams_of(data, lengths, np.zeros(b - a, np.int64)), np.repeat(np.arange(a, b), lengths + 1)

    first = held = 0
    for i, text in enumerate(texts):
        if held and held + len(text) > BLOCK:
            yield told(first, i)
            first, held = i, 0
        if len(text) <= BLOCK:
            held += len(text) + 1
            continue
        for at in range(0, len(text), BLOCK):
            before = min(at, DEPTH)
            piece = np.frombuffer(text[at - before : at + BLOCK], np.uint8)
            codes = grams_of(piece, np.array([len(piece)]), np.zeros(1, np.int64))[before:]
            codes = codes if at + BLOCK >= len(text) else codes[:-1]
            yield codes, np.full(len(codes), i)
        first = i + 1
    if held:
        yield told(first, len(texts))


class Order:
    """The grams of one order that were seen, in order, and of their contexts the total, the number of symbols, and what these count in the next shorter context."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray, order: int, shorter: Order | None) -> None:
        self.order = order
        seen = counts > 0
        self.grams, to = np.unique(grams[seen] & symbols_mask(order + 1), return_inverse=True)
        self.counts = np.bincount(to, weights=counts[seen], minlength=len(self.grams))
        self.contexts, to = np.unique(self.grams >> BITS, return_inverse=True)
        shut = np.zeros(len(self.grams)) if shorter is None else shorter.count(self.grams)
        self.told = [np.bincount(to, weights=w, minlength=len(self.contexts)) for w in (self.counts, np.ones(len(self.grams)), shut)]

    @staticmethod
    def _found(names: np.ndarray, asked: np.ndarray, values: np.ndarray) -> np.ndarray:
        if not len(names):
            return np.zeros(len(asked))
        at = np.minimum(np.searchsorted(names, asked), len(names) - 1)
        return np.where(names[at] == asked, values[at], 0.0)

    def count(self, codes: np.ndarray) -> np.ndarray:
        """Of the grams of this order that ``codes`` end with."""
        return self._found(self.grams, codes & symbols_mask(self.order + 1), self.counts)

    def context(self, codes: np.ndarray) -> list[np.ndarray]:
        """Total, distinct symbols and their counts one order below, of the contexts of ``codes``; 0 where never seen."""
        context = (codes & symbols_mask(self.order + 1)) >> BITS
        return [self._found(self.contexts, context, values) for values in self.told]


class LowOrders:
    """Counts of symbols after two, one and no symbols; their number is bounded by the alphabet, at most 260 * 260 * 257."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray) -> None:
        """``grams``: codes of a symbol and the two before it."""
        self.orders: list[Order] = []
        for order in range(3):
            self.orders.append(Order(grams, np.asarray(counts, np.float64), order, self.orders[-1] if self.orders else None))


def code_lengths(codes: np.ndarray, counts: np.ndarray, low: LowOrders, five: tuple[np.ndarray, np.ndarray] | None = None, three: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """log10 probabilities of grams; ``counts`` may be 0.

    ``codes`` holds all that was seen in each of its contexts of DEPTH symbols. ``five`` has grams of order 5 and counts,
    all that end with the same four context symbols, and ``three`` those of order 3 with the same three; without them,
    ``codes`` hold all with the same three.

    Contexts nest: what a longer context offers, a shorter one does too, so what is excluded at an order
    is what the next longer context has seen.
    """
    five = five or (codes & symbols_mask(6), counts)
    orders = [*low.orders]
    for order, (grams, n) in ((3, three or five), (4, five), (5, five), (6, (codes, counts))):
        orders.append(Order(grams, n, order, orders[-1]))
    reach = np.zeros(len(codes))
    out = np.full(len(codes), np.nan)
    open_ = np.ones(len(codes), bool)
    shut_n, shut_d = np.zeros(len(codes)), np.zeros(len(codes))  # of the next longer context: its symbols' counts here, and their number
    for order in reversed(orders):
        n = order.count(codes)
        total, distinct, below = order.context(codes)
        t, d = total - shut_n, distinct - shut_d
        some = open_ & (d > 0)
        scale = np.where(distinct >= SYMBOLS, t, t + d)
        hit = some & (n > 0)
        out[hit] = reach[hit] + np.log10(n[hit] / scale[hit])
        open_ &= ~hit
        miss = some & ~hit
        reach[miss] += np.log10(d[miss] / scale[miss])
        shut_n, shut_d = below, distinct
    out[open_] = reach[open_] - np.log10(SYMBOLS - len(low.orders[0].grams))
    return out


def _squeezed(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + (pa.Codec("zstd", LEVEL).compress(data, asbytes=True) if data else b"")


def _text(squeezed: bytes) -> bytes:
    size = int.from_bytes(squeezed[:8], "little")
    return pa.Codec("zstd").decompress(squeezed[8:], size, asbytes=True) if size else b""


def _packed(values: np.ndarray) -> bytes:
    """Numbers compressed, their bytes of equal weight together."""
    return _squeezed(np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize).T.tobytes())


def _unpacked(packed: bytes, kind: type) -> np.ndarray:
    planes = np.frombuffer(_text(packed), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).reshape(-1)


def _packed_grams(codes: np.ndarray) -> bytes:
    """Codes in order: the contexts, how many symbols follow each, and the symbols."""
    contexts, sizes = _distinct(codes >> BITS)
    parts = [_packed(np.diff(contexts, prepend=0)), _packed(sizes.astype(np.int16)), _packed((codes & MASK).astype(np.int16))]
    return b"".join(len(x).to_bytes(8, "little") + x for x in parts)


def _unpacked_grams(packed: bytes) -> np.ndarray:
    parts, at = [], 0
    for kind in (np.int64, np.int16, np.int16):
        size = int.from_bytes(packed[at : at + 8], "little")
        parts.append(_unpacked(packed[at + 8 : at + 8 + size], kind).astype(np.int64))
        at += 8 + size
    return np.repeat(np.cumsum(parts[0]), parts[1]) << BITS | parts[2]


def _distinct(ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of numbers in order, and how often each occurs."""
    first = np.flatnonzero(np.diff(ordered, prepend=-1))
    return ordered[first], np.diff(first, append=len(ordered))


def _slice_of(codes: np.ndarray, slices: int) -> np.ndarray:
    """By the context, so that all that was seen in one is in one slice."""
    mixed = (codes >> BITS).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed ^ (mixed >> np.uint64(32))) % np.uint64(slices)).astype(np.int32)


class Tally:
    """Counts by code; memory for distinct codes, those of some parts apart. Parts of like size become one, so that a code is moved a few times only."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, codes: np.ndarray, counts: np.ndarray) -> None:
        """``codes`` are distinct and in order."""
        while self.parts and len(self.parts[-1][0]) <= 2 * len(codes):
            codes, counts = self._both(self.parts.pop(), (codes, counts))
        self.parts.append((codes, counts))

    @staticmethod
    def _both(*parts: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        codes, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(codes, kind="stable")  # two runs in order: merged in one pass
        codes = codes[order]
        first = np.flatnonzero(np.diff(codes, prepend=-1))
        return codes[first], np.add.reduceat(counts[order], first) if len(first) else counts

    def whole(self) -> tuple[np.ndarray, np.ndarray]:
        """All codes in order, and their counts."""
        while len(self.parts) > 1:
            self.parts.append(self._both(self.parts.pop(), self.parts.pop()))
        return self.parts[0] if self.parts else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _slices(batches: Iterator[pa.RecordBatch], most: int = CHUNK_BYTES) -> Iterator[tuple[list, list[bool], list[bytes]]]:
    """(ids, train, lower-cased texts) of runs of rows with at most ``most`` bytes and CHUNK_DOCS rows, or of one row."""
    ids, train, texts, held = [], [], [], 0
    for batch in batches:
        for own_id, learns, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            text = value.as_py().lower()
            if texts and (held + len(text) > most or len(texts) == CHUNK_DOCS):
                yield ids, train, texts
                ids, train, texts, held = [], [], [], 0
            ids.append(own_id)
            train.append(learns)
            texts.append(text)
            held += len(text)
    if texts:
        yield ids, train, texts


def _partials(batches: Iterator[pa.RecordBatch], slices: int) -> Iterator[pa.RecordBatch]:
    """Rows of PARTIAL for (doc_id, train, text) batches."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId() << 32
    for n, (ids, learns, texts) in enumerate(_slices(batches)):
        chunk, train = part + n, np.array(learns)
        doc = np.zeros(len(texts), DOC)
        doc["id"], doc["no_id"] = [i or 0 for i in ids], [i is None for i in ids]
        doc["bytes"], doc["train"] = list(map(len, texts)), train
        yield _rows(chunk, DOCS, [(0, doc.tobytes(), _squeezed(b"".join(texts)))])
        yield _rows(chunk, GRAMS, _grams_by_slice(texts, train, slices))
        yield _rows(chunk, WORDS, _words_by_slice(texts, train, slices))


def _words_by_slice(texts: list[bytes], train: np.ndarray, slices: int) -> list[tuple[int, bytes, bytes]]:
    learned: Counter = Counter()
    others: set[bytes] = set()
    for text, learns in zip(texts, train.tolist(), strict=True):
        (learned if learns else others).update(text.split())  # bytes: separates at 0x20 and 0x09-0x0D only
    learned.update(dict.fromkeys(others - learned.keys(), 0))
    by: list[list[bytes]] = [[] for _ in range(slices)]
    for word in sorted(learned):
        by[zlib.crc32(word) % slices].append(word)
    return [(at, _squeezed(b" ".join(words)), _packed(np.array([learned[w] for w in words], np.int64))) for at, words in enumerate(by) if words]


def _grams_by_slice(texts: list[bytes], train: np.ndarray, slices: int) -> list[tuple[int, bytes, bytes]]:
    tally = Tally()
    for learns in (True, False):
        for codes, _ in blocks([text for text, x in zip(texts, train.tolist(), strict=True) if x == learns]):
            names, times = _distinct(np.sort(codes))
            tally.add(names, times * learns)
    names, times = tally.whole()
    slice_of = _slice_of(names, slices)
    order = np.argsort(slice_of, kind="stable")
    bounds = np.searchsorted(slice_of[order], np.arange(slices + 1))
    some = [(s, order[a:b]) for s, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)) if a < b]
    return [(s, _packed_grams(names[at]), _packed(times[at])) for s, at in some]


def _rows(chunk: int, kind: int, packed: list[tuple[int, bytes, bytes]]) -> pa.RecordBatch:
    n = len(packed)
    columns = [pa.array([x[k] for x in packed], t) for k, t in enumerate((pa.int32(), pa.binary(), pa.binary()))]
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, chunk)), pa.array(np.full(n, kind, np.int32)), *columns], names=["chunk", "kind", "slice", "names", "data"])


def _merged_grams(rows: list[dict]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Of a slice: codes by chunk, all codes, their counts, and what these are divided by, 0 where a gram was never seen."""
    own, tally = [_unpacked_grams(r["names"]) for r in rows], Tally()
    for codes, row in zip(own, rows, strict=True):
        tally.add(codes, _unpacked(row["data"], np.int64))
    codes, n = tally.whole()
    total, distinct, _ = Order(codes, n, DEPTH, None).context(codes)
    scale = np.where(distinct >= SYMBOLS, total, total + distinct)
    return own, codes, n, np.where(n > 0, scale, 0).astype(np.int64)


def _merged_words(rows: list[dict]) -> tuple[list[list[bytes]], Counter]:
    """Of a slice: words by chunk, and the counts of all."""
    own = [_text(r["names"]).split() for r in rows]
    counts: Counter = Counter()
    for words, row in zip(own, rows, strict=True):
        for word, n in zip(words, _unpacked(row["data"], np.int64).tolist(), strict=True):
            counts[word] += n
    return own, counts


def _of_kind(table: pa.Table, kind: int) -> list[dict]:
    return table.filter(pc.field("kind") == kind).to_pylist()


#: What a slice tells: at order DEPTH its grams in contexts that an unseen one needs, at order 5 counts, at TOLD the distinct training words and their occurrences.
TOLD = -1


def _slice_counts(table: pa.Table) -> pa.Table:
    """(slice, order, code, n) of a slice."""
    _, counts = _merged_words(_of_kind(table, WORDS))
    out = [(TOLD, np.array([sum(n > 0 for n in counts.values())]), np.array([sum(counts.values())]))]
    _, codes, n, _ = _merged_grams(_of_kind(table, GRAMS))
    needed = np.isin(codes >> BITS, (codes >> BITS)[n == 0])
    out.append((DEPTH, codes[needed], n[needed]))
    names, to = np.unique(codes[n > 0] & symbols_mask(DEPTH), return_inverse=True)
    out.append((DEPTH - 1, names, np.bincount(to, weights=n[n > 0], minlength=len(names)).astype(np.int64)))
    size = [len(x[1]) for x in out]
    at = table["slice"][0].as_py()
    return pa.table({"slice": np.full(sum(size), at, np.int32), "order": np.repeat(np.array([x[0] for x in out], np.int32), size), "code": np.concatenate([x[1] for x in out]), "n": np.concatenate([x[2] for x in out])})


def _answers(table: pa.Table, lengths: pa.Table) -> pa.Table:
    """Of a slice, for each of its chunks: rows of ANSWER."""
    out = []
    rows = _of_kind(table, WORDS)
    own, counts = _merged_words(rows)
    for words, row in zip(own, rows, strict=True):
        out.append((row["chunk"], WORDS, row["names"], _packed(np.array([counts[w] for w in words], np.int64)), None, None))
    rows = _of_kind(table, GRAMS)
    own, codes, n, scale = _merged_grams(rows)
    rest = np.zeros(len(scale))
    rest[np.searchsorted(codes, lengths["code"].to_numpy())] = lengths["len"].to_numpy()
    for names, row in zip(own, rows, strict=True):
        at = np.searchsorted(codes, names)
        out.append((row["chunk"], GRAMS, row["names"], _packed(n[at]), _packed(scale[at]), _packed(rest[at][scale[at] == 0])))
    columns = [pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary()))]
    at = pa.array(np.full(len(out), table["slice"][0].as_py() if len(table) else 0, np.int32))
    return pa.table([*columns[:2], at, *columns[2:]], names=["of_chunk", "kind", "slice", "names", "n", "scale", "rest"])


def _word_sums(texts: list[bytes], logs: dict[bytes, float]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each text: its words, those that training texts have, and the sum of log10(c + 1)."""
    log_of = logs.__getitem__
    out = np.array([(len(own), len(own) - own.count(0.0), math.fsum(own)) for own in (list(map(log_of, text.split())) for text in texts)])
    return out[:, 0].astype(np.int64), out[:, 1].astype(np.int64), out[:, 2]


def _gram_sums(texts: list[bytes], names: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Of each text the sum of the log10 probabilities of its symbols; ``names`` in order."""
    out = np.zeros(len(texts))
    for codes, of in blocks(texts):
        starts = np.flatnonzero(np.diff(of, prepend=-1))
        order = np.argsort(codes)
        own, times = _distinct(codes[order])
        each = np.empty(len(codes))
        each[order] = np.repeat(lengths[np.searchsorted(names, own)], times)
        out[of[starts]] += np.add.reduceat(each, starts)
    return out


def _gram_lengths(answers: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    """A chunk's grams in order and their log10 probabilities."""
    grams, lengths = [], []
    for told in answers:
        n, scale = _unpacked(told["n"], np.int64), _unpacked(told["scale"], np.int64)
        each = np.zeros(len(n))
        each[scale > 0] = np.log10(n[scale > 0] / scale[scale > 0])
        each[scale == 0] = _unpacked(told["rest"], np.float64)
        grams.append(_unpacked_grams(told["names"]))
        lengths.append(each)
    names = np.concatenate(grams)
    order = np.argsort(names)
    return names[order], np.concatenate(lengths)[order]


def _sum_up(docs: pa.Table, answers: pa.Table, tokens: int, distinct: int, ends: int) -> pa.Table:
    """Scores of a chunk's documents from the answers of the slices."""
    row = docs.to_pylist()[0]
    doc, whole = np.frombuffer(row["names"], DOC), _text(row["data"])
    bounds = np.cumsum(doc["bytes"])
    texts = [whole[b - n : b] for b, n in zip(bounds.tolist(), doc["bytes"].tolist(), strict=True)]
    score = _gram_sums(texts, *_gram_lengths(_of_kind(answers, GRAMS)))
    logs: dict[bytes, float] = {}
    for told in _of_kind(answers, WORDS):
        logs.update(zip(_text(told["names"]).split(), map(math.log10, (_unpacked(told["n"], np.int64) + 1).tolist()), strict=True))
    n_words, known, base = _word_sums(texts, logs)
    n_tokens, n_known = n_words + 1, known + (ends > 0)
    base = base + math.log10(ends + 1) - n_tokens * math.log10(tokens + distinct + 1)
    return pa.table({"doc_id": pa.array(doc["id"], mask=doc["no_id"]), "held_out": ~doc["train"], "n_tokens": n_tokens, "n_known": n_known, "base_score": base, "score": score})


def score(docs: DataFrame, fold: int = 7, held: int = 2, group: int = 500_000) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Training documents are those whose crc32 of the id modulo ``fold`` is not ``held``; some ``group`` grams are coded at once.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (crc_mod("doc_id", fold) != held).alias("train"), text_or_empty().cast("binary").alias("text"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes"), F.count_if("train").alias("ends")).first()
    slices, ends = max(1, -(-size["bytes"] // CHUNK_BYTES)), size["ends"]
    partial = stash(rows.mapInArrow(lambda it: _partials(it, slices), PARTIAL), "partials")
    parts = partial.where(F.col("kind") != DOCS)
    told = stash(parts.groupBy("slice").applyInArrow(_slice_counts, "slice int, order int, code long, n long"), "told")
    words = told.where(F.col("order") == TOLD).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("code"), F.lit(0)).alias("v")).first()
    tokens, distinct = words.n + ends, words.v + (ends > 0)

    last = lambda n: F.col("code").bitwiseAND(F.lit(symbols_mask(n)))
    five = stash(told.where(F.col("order") == DEPTH - 1).groupBy("code").agg(F.sum("n").alias("n")), "five")
    told_low = five.groupBy(last(3).alias("gram")).agg(F.sum("n").alias("n")).toArrow()  # orders 0 to 2: bounded by the alphabet
    low = LowOrders(told_low["gram"].to_numpy(), told_low["n"].to_numpy())
    needed = told.where(F.col("order") == DEPTH).select("slice", "order", "code", "n")
    groups = max(1, -(-(needed.count() + five.count()) // group))
    context = lambda n: F.shiftright("code", BITS).bitwiseAND(F.lit(symbols_mask(n)))
    grouped = F.pmod(F.xxhash64(context(4)), F.lit(groups)).cast("int").alias("group")
    needed = needed.select(grouped, "slice", "order", "code", "n")
    five = five.select(grouped, F.lit(0).alias("slice"), F.lit(5).alias("order"), "code", "n")
    three = five.groupBy(last(4).alias("code")).agg(F.sum("n").alias("n")).withColumn("three", context(3))
    three = five.select("group", context(3).alias("three")).distinct().join(three, "three").select("group", F.lit(0).alias("slice"), F.lit(3).alias("order"), "code", "n")

    def coded(table: pa.Table) -> pa.Table:
        order, at, codes, n = (table[c].to_numpy() for c in ("order", "slice", "code", "n"))
        whole, fives, threes = (order == k for k in (DEPTH, 5, 3))
        lengths = code_lengths(codes[whole], n[whole], low, (codes[fives], n[fives]), (codes[threes], n[threes]))
        new = n[whole] == 0
        return pa.table({"of_slice": at[whole][new], "code": codes[whole][new], "len": lengths[new]})

    lengths = stash(needed.unionByName(five).unionByName(three).groupBy("group").applyInArrow(coded, "of_slice int, code long, len double"), "lengths")
    unstash(told)
    answers = parts.groupBy("slice").cogroup(lengths.groupBy("of_slice")).applyInArrow(_answers, ANSWER)
    chunks = partial.where(F.col("kind") == DOCS).select("chunk", "names", "data")
    scored = chunks.groupBy("chunk").cogroup(answers.groupBy("of_chunk")).applyInArrow(lambda a, b: _sum_up(a, b, tokens, distinct, ends), "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")
