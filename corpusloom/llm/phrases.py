"""Phrase collocations: candidates from sketch upper bounds, counted exactly by automata.

Passes over the texts, none of which sends a phrase anywhere before it is known to be able to pass:

1. Every task adds its n-grams to a count-min sketch of two rows, which ends as one bit a counter: can
   what falls into it reach ``least``? An n-gram can if it does in both rows. Counters are added up block
   by block of them, saturated at ``least``, which loses nothing for that question. The bits are at most
   ``2 ** most_bits``, a parameter, and are all that the driver sees. Words and pairs go first; longer
   phrases are added to a second sketch if every pair of words in them can pass.
2. A task cuts its texts into shards of some megabytes. A phrase is a candidate in a shard if it stands
   there and its own bits and those of all phrases within it are set. The candidates of a shard are
   compiled into an Aho-Corasick automaton of strings guarded by a delimiter on either side, which then
   scans the shard and counts every match, overlapping ones too. A shard with more candidates than
   ``most_patterns`` is halved, so an automaton is bounded whatever the corpus is. The counts of a
   task's shards are added up before they are shuffled, packed by buckets of phrases, and summed.
3. Thresholds and scores are joins of the counts with themselves: both parts of a candidate are as
   frequent as it is, so they were counted too.

With more n-grams than counters the sketch lets more through, which costs time and not rows.

Null texts are empty and null languages ``und``. Texts are taken whole; a piece between delimiters is
held in memory at once. Repeated rows count each. An empty table gives an empty result. Columns beyond
the text and the language are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import stash, text_or_empty

MOST_WORDS = 5
#: A-Z in lower case, tabs as blanks, every delimiter of pieces as a line feed.
BYTES = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz " + b"\n" * 9)
BREAK = b" \n "
BASE = 0x9E3779B97F4A7C15
MIX, STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Languages whose numbers of words are broadcast; more are joined by a shuffle.
MOST_LANGS = 10_000
#: Counters that go as one row through the exchange.
BLOCK = 1 << 16


def guarded(text: bytes) -> bytes:
    """The words with one blank on either side; a line feed stands as a word of its own between pieces."""
    s = b" " + text.translate(BYTES).replace(b"\n", BREAK) + b" "
    while b"  " in s:
        s = s.replace(b"  ", b" ")
    return s


def shards(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[dict[str, bytes]]:
    """The guarded texts by language, ``size`` bytes or a little more at a time; long texts are cut between pieces."""
    held: dict[str, list[bytes]] = {}
    n = 0
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            s, at = guarded(text.as_py()), 0
            while at < len(s):
                end = s.find(BREAK, at + size - n) + 1 or len(s)
                held.setdefault(lang, []).append(s[at:end])
                n, at = n + end - at, end + 1 if end < len(s) else end
                if n >= size:
                    yield {k: b"\n".join(v) for k, v in held.items()}
                    held, n = {}, 0
    if held:
        yield {k: b"\n".join(v) for k, v in held.items()}


class Hasher:
    """Hashes of all n-grams of a shard at once, from prefix sums of a polynomial of its bytes."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def grams(self, s: bytes, lang: str) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
        """Where words begin and end (blanks before and after), and for 1 to MOST_WORDS words the hashes and whether no break lies in between."""
        a = np.frombuffer(s, np.uint8)
        if len(self.up) < len(a):
            n = len(a) + len(a) // 4
            self.up = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, BASE, np.uint64))])
            self.down = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, pow(BASE, -1, 1 << 64), np.uint64))])
        gaps = np.flatnonzero(a == 32)
        start, end = gaps[:-1] + 1, gaps[1:]
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((a + np.uint64(1)) * self.up[: len(a)])])
        word = (sums[end] - sums[start]) * self.down[start]
        word = (word ^ word >> np.uint64(32)) * MIX
        word ^= word >> np.uint64(29)
        whole = ~((end - start == 1) & (a[start] == 10))
        hashes, valid = [word ^ np.uint64(zlib.crc32(lang.encode()))], [whole]
        for m in range(1, MOST_WORDS):
            n = max(0, len(word) - m)
            h = hashes[-1][:n] * STEP + word[m : m + n]
            hashes.append(h ^ h >> np.uint64(31))
            valid.append(valid[-1][:n] & whole[m : m + n])
        return gaps, hashes, valid

    def passing(self, s: bytes, lang: str, bits: int, pairs: np.ndarray, longer: np.ndarray | None) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
        """``grams`` with, in place of whether no break lies in between, whether the sketches let the n-gram and all within it pass; None lets all pass."""
        gaps, hashes, valid = self.grams(s, lang)
        can: list[np.ndarray] = []
        for m, (h, ok) in enumerate(zip(hashes, valid, strict=True)):
            if m:
                ok = ok & can[-1][:-1] & can[-1][1:]
            heavy = pairs if m < 2 else longer
            if heavy is not None:
                at = np.flatnonzero(ok)
                for row in range(2):
                    cell = cells_of(h[at], bits)[row]
                    at = at[(heavy[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8) & 1).astype(bool)]
                ok = np.zeros(len(ok), bool)
                ok[at] = True
            can.append(ok)
        return gaps, hashes, can


def cells_of(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The counters of an n-gram in the two rows, which share ``2 ** bits`` counters."""
    row = np.uint64(64 - bits + 1)
    return (h * MIX >> row).astype(np.int64), (h * STEP >> row).astype(np.int64) + (1 << bits - 1)


def sketch(texts: DataFrame, least: int, bits: int, size: int, pairs=None) -> bytes:
    """A bit for each of ``2 ** bits`` counters: whether the n-grams that fall into it are ``least`` or more together.

    Words and pairs of words are counted, or, given their bits, the longer phrases that these let pass.
    """
    kind = np.uint8 if least < 256 else np.uint32

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, cells = Hasher(), np.zeros(1 << bits, np.uint32)
        known = None if pairs is None else np.frombuffer(pairs.value, np.uint8)
        for shard in shards(batches, size):
            for lang, s in shard.items():
                _, hashes, ok = hasher.grams(s, lang) if known is None else hasher.passing(s, lang, bits, known, None)
                for m in range(2) if known is None else range(2, MOST_WORDS):
                    for cell in cells_of(hashes[m][ok[m]], bits):
                        np.add.at(cells, cell, np.uint32(1))
        for i in range(0, len(cells), BLOCK):
            block = cells[i : i + BLOCK]
            if block.any():
                packed = zlib.compress(np.minimum(block, least).astype(kind).tobytes(), 1)
                yield pa.RecordBatch.from_arrays([pa.array([i // BLOCK], pa.int32()), pa.array([packed], pa.binary())], names=["block", "cells"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows stream by; what is held is a block of counters for each of the task's blocks."""
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, packed in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                cells = np.frombuffer(zlib.decompress(packed.as_py()), kind).astype(np.uint32)
                held[i] = np.minimum(held[i] + cells, least) if i in held else cells
        for i, cells in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([np.packbits(cells >= least).tobytes()], pa.binary())], names=["block", "bits"])

    found = texts.mapInArrow(count, "block int, cells binary").repartition("block").mapInArrow(add, "block int, bits binary")
    length = min(BLOCK, 1 << bits) // 8
    whole = bytearray((1 << bits) // 8)
    for row in found.collect():  # 2 ** bits bits in all
        whole[row["block"] * length : (row["block"] + 1) * length] = row["bits"]
    return bytes(whole)


def matches(s: str, patterns: list[str]) -> np.ndarray:
    """How often each pattern stands in ``s``, overlaps included."""
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for i, p in enumerate(patterns):
        automaton.add_word(p, i)
    automaton.make_automaton()
    return np.bincount(np.fromiter(map(itemgetter(1), automaton.iter(s)), np.int64), minlength=len(patterns))


def scan(s: bytes, lang: str, hasher: Hasher, bits: int, heavy: tuple[np.ndarray, np.ndarray], most_patterns: int, totals: dict) -> None:
    """Add the counts of a shard's candidates, and of its words under the empty phrase, to ``totals``."""
    gaps, _, can = hasher.passing(s, lang, bits, *heavy)
    text = s.decode("latin-1")  # a character a byte
    found = set()
    for m, ok in enumerate(can):
        at = np.flatnonzero(ok)
        found.update(text[i:j] for i, j in zip(gaps[at].tolist(), (gaps[at + m + 1] + 1).tolist(), strict=True))
    middle = s.find(BREAK, len(s) // 2)
    if len(found) > most_patterns and middle > 0:
        scan(s[: middle + 1], lang, hasher, bits, heavy, most_patterns, totals)
        scan(s[middle + 2 :], lang, hasher, bits, heavy, most_patterns, totals)
        return
    totals[lang, ""] = totals.get((lang, ""), 0) + len(gaps) - 1 - s.count(b"\n")
    if found:
        patterns = list(found)
        for p, n in zip(patterns, matches(text, patterns).tolist(), strict=True):
            totals[lang, p] = totals.get((lang, p), 0) + n


def phrase_counts(docs: DataFrame, least: int = 100, most_bits: int = 24, size: int = 4 << 20, most_patterns: int = 200_000, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, phrase, n_words, a) of every phrase of 1 to 5 words with ``a >= least``; the empty phrase has all words of the language."""
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), text_or_empty(text_col).cast("binary").alias("text"))
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(most_bits, max(16, (total // 8).bit_length()))
    share = texts.sparkSession.sparkContext.broadcast  # at most 2 ** most_bits bits
    pairs = share(sketch(texts, least, bits, size))
    longer = share(sketch(texts, least, bits, size, pairs))

    buckets = max(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-int(np.unpackbits(np.frombuffer(pairs.value + longer.value, np.uint8)).sum()) // 100_000))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The counts of a task's shards, packed to a row for each bucket of phrases."""
        hasher, totals = Hasher(), {}
        heavy = np.frombuffer(pairs.value, np.uint8), np.frombuffer(longer.value, np.uint8)

        def rows() -> Iterator[pa.RecordBatch]:
            dealt: dict[int, list] = {}
            for (lang, p), a in totals.items():
                phrase = p.strip(" ").encode("latin-1")
                dealt.setdefault(zlib.crc32(phrase) % buckets, []).append((lang, phrase, a))
            totals.clear()
            for bucket, own in dealt.items():
                columns = [pa.array([list(x)], pa.list_(kind)) for x, kind in zip(zip(*own, strict=True), (pa.string(), pa.binary(), pa.int64()), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), *columns], names=["bucket", "lang", "phrase", "a"])

        for shard in shards(batches, size):
            for lang, s in shard.items():
                scan(s, lang, hasher, bits, heavy, most_patterns, totals)
            if len(totals) > 2 * most_patterns:
                yield from rows()
        yield from rows()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums of the packed counts; a task that holds very many phrases gives partial ones."""
        totals: Counter = Counter()

        def rows() -> pa.RecordBatch:
            columns = [pa.array([k[0] for k in totals], pa.string()), pa.array([k[1] for k in totals], pa.binary()), pa.array(list(totals.values()), pa.int64())]
            totals.clear()
            return pa.RecordBatch.from_arrays(columns, names=["lang", "phrase", "a"])

        for batch in batches:
            for lang, phrase, a in zip(*(batch.column(c).flatten().to_pylist() for c in ("lang", "phrase", "a")), strict=True):
                totals[lang, phrase] += a
            if len(totals) > 10 * most_patterns:
                yield rows()
        if totals:
            yield rows()

    packed = texts.mapInArrow(count, "bucket int, lang array<string>, phrase array<binary>, a array<long>")
    counted = packed.repartition("bucket").mapInArrow(add, "lang string, phrase binary, a long")
    counted = counted.groupBy("lang", F.col("phrase").cast("string").alias("phrase")).agg(F.sum("a").alias("a"))
    words = F.when(F.col("phrase") == "", 0).otherwise(F.size(F.split("phrase", " ")))
    return counted.where((F.col("a") >= least) | (F.col("phrase") == "")).select("lang", "phrase", words.alias("n_words"), "a")


def collocations(counts: DataFrame, top: int = 2000, inside: int = 100) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the ``top`` best of each language.

    A candidate goes if a longer one that holds it has at least ``inside`` percent of its occurrences.
    Those with one word more are enough to see that: each phrase between the two is as frequent as the
    longer one at least, so it is a candidate and has that share itself.
    """
    n = counts.where("n_words = 0").select("lang", F.col("a").alias("n"))
    if n.count() <= MOST_LANGS:
        n = F.broadcast(n)
    words = F.split("phrase", " ")
    cand = counts.where("n_words > 1").select("lang", "phrase", "n_words", "a", words.alias("w"))
    part = lambda first, length: F.array_join(F.slice("w", first, length), " ")
    cuts = cand.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n_words") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("head"), part(F.col("k") + 1, F.col("n_words") - F.col("k")).alias("rest"))
    known = counts.where("n_words > 0")
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("head"), F.col("a").alias("l")), ["lang", "head"])
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("rest"), F.col("a").alias("r")), ["lang", "rest"]).join(n, "lang")
    big = lambda c: F.col(c).cast("decimal(19,0)")
    cuts = cuts.withColumn("above", (big("a") * big("n") * 1000).cast("decimal(38,0)")).withColumn("below", big("l") * big("r"))
    scored = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct(F.expr("above div below").alias("score"), "k", "l", "r")).alias("c"))
    longer = cand.where("n_words > 2").withColumn("phrase", F.explode(F.array(part(F.lit(1), F.col("n_words") - 1), part(F.lit(2), F.col("n_words") - 1))))
    longer = longer.groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    kept = scored.join(longer, ["lang", "phrase"], "left").where(F.col("most").isNull() | (100 * F.col("most") < inside * F.col("a")))
    best = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("c.score"), F.desc("a"), "phrase"))
    return kept.withColumn("rank", best).where(F.col("rank") <= top).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "c.l", "c.r", "n", "c.score")


def mine(docs: DataFrame, least: int = 100, top: int = 2000, inside: int = 100, **how) -> DataFrame:
    return collocations(stash(phrase_counts(docs, least, **how), "phrases"), top, inside)
