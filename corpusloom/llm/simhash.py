"""SimHash near-duplicates by anchor-point covering.

Fingerprints are 64 bits; a bit is set if it is set in over half the XXH64 hashes of the word shingles.
Pairs at ``2`` or fewer differing bits are found through a covering code: the anchors are the words of
the perfect Hamming code of length 63 (covering radius 1, so every fingerprint is within 1 of an anchor).
For a pair x, y at distance 2 or less some m is within 1 of both; the anchor next to m is within
1 (covering radius) + 1 (half the threshold) of both. Replicating every fingerprint to all anchors
within 2 of its first 63 bits therefore brings each pair together at one anchor at least; there are 32
of them (1 for an anchor itself). The textbook rule, home anchor against radius plus the whole
threshold, would need about 650 replicas. The 64th bit is left to the comparison.

A ball of radius 2 holds at most 2 * 2017 fingerprints, so no anchor's group is larger, whatever the
data. Equal fingerprints are collapsed before they are replicated, so a group of copies costs one row.

That is the contract of ``op3`` (``near_fingerprints``). Two bits mean nearly equal texts, so where no contract says
otherwise ``near_duplicates`` links by the texts themselves: pairs whose sets of five-word shingles have a
Jaccard similarity of 0.8 or more. Bands of minimum hashes only propose pairs; each is then verified on
the whole sets of 64-bit shingle hashes. A pair at exactly 0.8 shares none of the 24 bands of 5 with
probability 0.00007, and a more similar one with less.

Null texts count as empty; without a word the fingerprint is 0, linked like any other. Repeated rows
come back each; an empty table gives an empty result; extra columns are ignored. In ``near_duplicates`` and
``representatives`` a null text has no shingles, so that it is a near duplicate of texts without a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash, unstash

SEED = 42


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """The hash of each word shingle in turn; a shorter text is one shingle, and without a word there is none."""
    words = (text or "").encode("utf-8", "replace").lower().split()  # bytes: only A-Z change, only 0x20 and 0x09-0x0D separate
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    n = len(words) - shingle + 1
    if n <= 1:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter((len(w) + 1 for w in words), np.int64, len(words))) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest, view = xxhash.xxh64_intdigest, memoryview(joined)
    return np.fromiter((digest(view[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends[shingle - 1 :].tolist(), strict=True)), np.uint64, n)


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The unsigned fingerprint of one text."""
    hashes = shingle_hashes(text, shingle)
    n = len(hashes)
    votes = np.zeros(64, np.int64)
    for at in range(0, n, 65_536):  # bounded memory for texts of any length
        bits = np.unpackbits(hashes[at : at + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long."""

    def batches(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in it:
            yield pd.Series(np.array([fingerprint(t if isinstance(t, str) else None, shingle) for t in texts], np.uint64).view(np.int64))

    return docs.select(F.col(id_col).alias("doc_id"), F.pandas_udf(batches, "long")(F.col(text_col)).alias("fp"))


#: The 63 low bits; bit k - 1 has position k in the code, and the syndrome of a word is the XOR of its positions.
LOW = (1 << 63) - 1


def anchors(fps: DataFrame) -> DataFrame:
    """Each distinct ``fp`` with every anchor within 2 of its low 63 bits.

    Flipping positions i and j (0: none) gives a code word exactly if i XOR j is the syndrome.
    """
    bit = [sum(1 << (k - 1) for k in range(1, 64) if k >> b & 1) for b in range(6)]
    syndrome = sum((F.bit_count(F.col("fp").bitwiseAND(F.lit(m))) % 2) * (1 << b) for b, m in enumerate(bit))
    flip = F.array(F.lit(0).cast("long"), *[F.lit(1 << k).cast("long") for k in range(63)])
    x = fps.select("fp", syndrome.cast("int").alias("_s")).select("fp", "_s", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("_i"))
    x = x.withColumn("_j", F.col("_i").bitwiseXOR(F.col("_s"))).where((F.col("_i") < F.col("_j")) | ((F.col("_s") == 0) & (F.col("_i") == 0)))
    low = F.col("fp").bitwiseAND(F.lit(LOW))
    return x.select("fp", low.bitwiseXOR(F.element_at(flip, F.col("_i") + 1)).bitwiseXOR(F.element_at(flip, F.col("_j") + 1)).alias("anchor"))


def _forest(fps: np.ndarray, within: int) -> tuple[np.ndarray, np.ndarray]:
    """Links enough to connect what lies within the threshold in one anchor's group, at most one a member."""
    left = np.sort(fps.view(np.uint64))
    a, b = [], []
    while len(left):  # breadth first; each member is compared while it is not yet linked
        root, front, left = left[0], [left[0]], left[1:]
        while front and len(left):
            x = front.pop()
            near = np.bitwise_count(left ^ x) <= within
            if near.any():
                new = left[near]
                front += list(new)
                a += [root] * len(new)
                b += list(new)
                left = left[~near]
    return np.array(a, np.uint64).view(np.int64), np.array(b, np.uint64).view(np.int64)


def links(fps: DataFrame, within: int = 2) -> DataFrame:
    """(a, b), a < b as unsigned: links between distinct fingerprints with the components of all pairs within the threshold."""
    if within > 2:
        raise ValueError("the code has anchors for thresholds up to 2")
    groups = anchors(fps).groupBy("anchor").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1).select("fps")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, a, b = batch.column(0), [], []
            flat, offsets = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
            for i in range(len(column)):
                own = flat[offsets[i] : offsets[i + 1]]
                if len(own) == 2:
                    x, y = own.view(np.uint64)
                    if np.bitwise_count(x ^ y) <= within:
                        a.append(np.array([min(x, y)], np.uint64).view(np.int64))
                        b.append(np.array([max(x, y)], np.uint64).view(np.int64))
                else:
                    u, v = _forest(own, within)
                    a.append(u)
                    b.append(v)
            none = np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a or [none])), pa.array(np.concatenate(b or [none]))], names=["a", "b"])

    return groups.mapInArrow(compare, "a long, b long").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) of every node that has a link and is not its own root, by alternating large-star and small-star steps.

    Minima are partial aggregates and the joins that follow are plain equi-joins, so a node with a third
    of all links is split by adaptive execution. Every round is written to the shared folder.
    """
    now = stash(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links")
    state = None
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # written before it is joined: both sides of the join are then exchanges that can be split
        least = stash(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "links")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stash(large.distinct(), "links")
        small_least = stash(large.groupBy("u").agg(F.min("v").alias("m")), "links")
        small = large.join(small_least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small_least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        new = stash(small, "links")
        told = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        for old in (now, least, large, small_least):
            unstash(old)
        now = new
        if told == state:
            break
        state = told
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _named(prints: DataFrame, roots: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, the smallest id of what ``roots`` puts together."""
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    tied = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    # only fingerprints with a link need their component's smallest id; the rest have their own
    best = roots.join(distinct, roots.node == distinct.fp).groupBy("root").agg(F.min("least").alias("best"))
    best = stash(best.join(distinct.select(F.col("fp").alias("root"), F.col("least").alias("own")), "root").select("root", F.least("best", "own").alias("best")), "best")
    named = stash(tied.join(best, "root", "left").select("fp", F.coalesce("best", "least").alias("component_id")), "named")
    # both sides are now exchanged for this join, and the rows of a hot fingerprint can be split
    return prints.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def near_fingerprints(docs: DataFrame, within: int = 2, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, the smallest id reachable over links of ``within`` bits."""
    prints = stash(fingerprints(docs, id_col, text_col, shingle), "prints")
    # each fingerprint becomes 32 rows, so the few bytes it has must not be taken for few rows to come
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return _named(prints, components(links(prints.select("fp").distinct().repartition(parts), within)))


# Bands of minimum hashes: BANDS x ROWS multiplications of the shingle hashes by odd constants.
BANDS, ROWS = 24, 5
_MIX = np.random.default_rng(SEED).integers(0, 2**64, (2, BANDS * ROWS, 1), dtype=np.uint64) | np.uint64(1)

#: In a bucket of up to 2 * REACH + 1 all pairs are proposed at once; in a larger one first the next REACH of each
#: member in a circle, then every pair that these have left in different components.
REACH = 4

NO_KEY = np.iinfo(np.int64).min

#: Rows that a worker gives back at once.
SLICE = 256


# A finer sketch, a byte of each of SKETCH minimum hashes, for members of large buckets only. Two sets at a similarity of
# 0.8 agree in fewer than ALIKE of its bytes with probability 0.00001 (binomial, 512 draws), less than what the bands
# leave out; two at 0.7 agree in as many with probability 0.1, two at 0.65 with 0.0003.
SKETCH, ALIKE = 512, 370
_FINE = np.random.default_rng(SEED + 1).integers(0, 2**64, (2, SKETCH, 1), dtype=np.uint64) | np.uint64(1)


def least_hashes(hashes: np.ndarray, mix: np.ndarray) -> np.ndarray:
    """The minimum hashes of one set."""
    least = np.full(mix.shape[1], 2**64 - 1, np.uint64)
    some = 400_000 // mix.shape[1]
    for at in range(0, len(hashes), some):  # bounded memory for texts of any length
        np.minimum(least, ((hashes[at : at + some] ^ mix[0]) * mix[1]).min(axis=1), out=least)
    return least


def sketch(hashes: np.ndarray) -> bytes:
    """Bytes that two sets share as often as they are similar, and one in 256 times else."""
    return (least_hashes(hashes, _FINE) >> np.uint64(20)).astype(np.uint8).tobytes()


def bands(hashes: np.ndarray) -> np.ndarray:
    """A key for each band of the minimum hashes of one set."""
    least = least_hashes(hashes, _MIX)
    keys = np.arange(1, BANDS + 1, dtype=np.uint64)
    for row in least.reshape(BANDS, ROWS).T:
        keys = (keys ^ row) * _MIX[1, 0, 0]
        keys ^= keys >> np.uint64(29)
    return keys


def shingle_prints(docs: DataFrame, shingle: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash, of the set of shingle hashes a hash ``fp`` (0 without words), its size and its bands, and the text's fingerprint ``simhash``."""

    def batches(it: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in it:
            for at in range(0, len(texts), SLICE):
                out = []
                for t in texts.iloc[at : at + SLICE]:
                    own = np.unique(shingle_hashes(t if isinstance(t, str) else None, shingle))
                    fp = xxhash.xxh64_intdigest(own.tobytes(), SEED) if len(own) else 0
                    bits = fingerprint(t if isinstance(t, str) else None)
                    out.append((fp - (fp >> 63 << 64), len(own), bands(own).view(np.int64) if len(own) else np.zeros(0, np.int64), bits - (bits >> 63 << 64)))
                yield pd.DataFrame(out, columns=["fp", "size", "bands", "simhash"])

    found = F.pandas_udf(batches, "fp long, size int, bands array<long>, simhash long")(F.col(text_col))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), found.alias("_s"))
    return rows.select("doc_id", "text_hash", "_s.fp", "_s.size", "_s.bands", "_s.simhash")


def packed_texts(texts: DataFrame) -> DataFrame:
    """fp and its text, compressed; a set of hashes can't be, and takes three times as much."""

    def batches(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = pa.Codec("zstd")
        for batch in it:
            data = (t.encode("utf-8", "replace") for t in batch)
            yield pd.Series([len(d).to_bytes(8, "little") + codec.compress(d, asbytes=True) for d in data], dtype=object)

    return texts.select("fp", F.pandas_udf(batches, "binary")(F.col("text")).alias("packed"))


#: Hashes of sets that a task keeps, since pairs of one text come together.
KEPT_HASHES = 500_000


def alike(pairs: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """(a, b) of those (a, b, x, y), x and y being packed texts, whose whole sets of shingle hashes are as similar."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, kept, held = pa.Codec("zstd"), {}, 0

        def hashes(fp: int, packed: pa.Scalar) -> np.ndarray:
            nonlocal held
            if fp not in kept:
                data = packed.as_py()
                text = codec.decompress(data[8:], int.from_bytes(data[:8], "little"), asbytes=True).decode()
                kept[fp] = np.unique(shingle_hashes(text, shingle))
                held += len(kept[fp])
            own = kept[fp] = kept.pop(fp)
            while held > KEPT_HASHES and len(kept) > 1:
                held -= len(kept.pop(next(iter(kept))))
            return own

        for batch in batches:
            a, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            found = np.zeros(len(a), bool)
            for i, (u, v) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
                x, y = hashes(u, batch.column(2)[i]), hashes(v, batch.column(3)[i])
                common = len(np.intersect1d(x, y, assume_unique=True))
                found[i] = common >= similarity * (len(x) + len(y) - common) - 1e-6
            yield pa.RecordBatch.from_arrays([pa.array(a[found]), pa.array(b[found])], names=["a", "b"])

    return pairs.select("a", "b", "x", "y").mapInArrow(compare, "a long, b long")


def sketches(texts: DataFrame, shingle: int) -> DataFrame:
    """fp and its sketch."""

    def batches(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in it:
            yield pd.Series([sketch(np.unique(shingle_hashes(t, shingle))) for t in batch])

    return texts.select("fp", F.pandas_udf(batches, "binary")(F.col("text")).alias("sketch"))


def _values(column: pa.Array) -> np.ndarray:
    """Numbers as they are; binaries of one length as rows of bytes; lists as rows, filled up with NO_KEY."""
    if pa.types.is_binary(column.type):
        return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)
    if pa.types.is_list(column.type):
        sizes = np.diff(column.offsets.to_numpy())
        out = np.full((len(column), max(1, sizes.max(initial=0))), NO_KEY)
        out[np.arange(out.shape[1])[None, :] < sizes[:, None]] = column.flatten().to_numpy()
        return out
    return column.to_numpy(zero_copy_only=False)


def _proposals(groups: DataFrame, similarity: float, pairs_of) -> DataFrame:
    """Distinct (a, b), a < b, of what ``pairs_of(members)`` pairs in each bucket and the sizes of the sets allow."""

    def propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x or [np.zeros(0, np.int64)])) for x in (a, b)], names=["a", "b"])

        for batch in batches:
            column, a, b, n = batch.column(0), [], [], 0
            offsets = column.offsets.to_numpy()
            flat = {f.name: _values(pc.struct_field(column.values, f.name)) for f in column.type.value_type}
            for at in range(len(column)):
                own = {k: v[offsets[at] : offsets[at + 1]] for k, v in flat.items()}
                fp, size = own["fp"], own["size"]
                for i, j in pairs_of(own):
                    fits = (fp[i] != fp[j]) & (np.minimum(size[i], size[j]) >= similarity * np.maximum(size[i], size[j]) - 1e-6)
                    x, y = fp[i][fits], fp[j][fits]
                    a.append(np.minimum(x, y))
                    b.append(np.maximum(x, y))
                    n += len(x)
                    if n > 500_000:
                        yield told()
                        a, b, n = [], [], 0
            yield told()

    return groups.mapInArrow(propose, "a long, b long").distinct()


def _circle(own: dict) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    n = len(own["fp"])
    bits = own["fp"].view(np.uint64)
    i = np.argsort((bits ^ bits.sum(dtype=np.uint64)) * _MIX[1, 0, 0])  # other neighbours in each bucket
    for d in range(1, min(REACH, n // 2) + 1):
        yield i, np.roll(i, -d)


def _across(own: dict) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of different components that their sketches let pass: one of the two is outside the bucket's largest.

    A pair that meets in several buckets is proposed in that of the smallest key.
    """
    keys, here = own["keys"], own["key"][0]
    roots, at, count = np.unique(own["root"], return_inverse=True, return_counts=True)
    sketched = own["sketch"]
    outside = at != count.argmax()
    for i in np.flatnonzero(outside):
        # a pair within ``outside`` comes once, from its smaller place
        for j0 in range(0, len(at), 65_536):
            j = np.arange(j0, min(j0 + 65_536, len(at)))
            j = j[(at[j] != at[i]) & (~outside[j] | (j > i))]
            j = j[(sketched[j] == sketched[i]).sum(axis=1) >= ALIKE]
            shared = np.isin(keys[j], keys[i]) & (keys[j] != NO_KEY)
            j = j[np.where(shared, keys[j], here).min(axis=1, initial=here) == here]
            yield np.full(len(j), i), j


def similar_links(prints: DataFrame, texts: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """(a, b): links between sets with the components of all pairs at the similarity or above.

    Only the texts of proposed pairs are read again; ``texts`` has them with their ``text_hash``.
    """
    one = prints.groupBy("fp").agg(F.first("bands").alias("bands"), F.first("size").alias("size"))
    keys = one.select("fp", "size", F.explode("bands").alias("key"))
    groups = keys.groupBy("key").agg(F.collect_list(F.struct("fp", "size")).alias("members")).where(F.size("members") > 1)
    groups = stash(groups, "buckets")

    def read(asked: DataFrame) -> DataFrame:
        """A text for each of the sets."""
        named = prints.select("fp", "text_hash").join(asked, "fp", "left_semi").groupBy("fp").agg(F.min("text_hash").alias("text_hash"))
        return texts.join(stash(named, "asked"), "text_hash").groupBy("fp").agg(F.first("text").alias("text"))

    def verified(pairs: DataFrame) -> DataFrame:
        pairs = stash(pairs, "pairs")
        sets = stash(packed_texts(read(pairs.select(F.explode(F.array("a", "b")).alias("fp")).distinct())), "sets")
        both = pairs.join(sets.select(F.col("fp").alias("a"), F.col("packed").alias("x")), "a").join(sets.select(F.col("fp").alias("b"), F.col("packed").alias("y")), "b")
        return stash(alike(both, similarity, shingle), "similar")

    first = verified(_proposals(groups.select("members"), similarity, _circle))
    large = groups.where(F.size("members") > 2 * REACH + 1).select("key", F.explode("members").alias("m")).select("key", "m.fp", "m.size")
    if large.isEmpty():
        return first
    roots = components(first)
    tied = large.join(roots, large.fp == roots.node, "left").select("key", "fp", "size", F.coalesce("root", "fp").alias("root"))
    tied = stash(tied, "tied")
    mixed = tied.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("key")
    tied = stash(tied.join(mixed, "key", "left_semi"), "mixed")
    fine = stash(sketches(read(tied.select("fp").distinct()), shingle), "sketches")
    keys = tied.groupBy("fp").agg(F.collect_list("key").alias("keys"))  # at most BANDS
    known = stash(fine.join(keys, "fp"), "known")
    large = tied.join(known, "fp").select("key", F.struct("fp", "size", "root", "sketch", "keys", "key").alias("m"))
    left = large.groupBy("key").agg(F.collect_list("m").alias("members"))
    return first.unionByName(verified(_proposals(left.select("members"), similarity, _across)))


def fingerprint_links(prints: DataFrame, within: int = 2) -> DataFrame:
    """(a, b): links between sets with the components of all whose fingerprints differ in ``within`` bits or fewer, by the anchors."""
    own = stash(prints.select("simhash", "fp").distinct(), "simhashes")
    first = stash(own.groupBy("simhash").agg(F.min("fp").alias("first")), "simhashes")
    same = own.join(first, "simhash").where("fp <> first").select(F.col("first").alias("a"), F.col("fp").alias("b"))
    # each fingerprint becomes 32 rows, so the few bytes it has must not be taken for few rows to come
    parts = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    near = links(first.select(F.col("simhash").alias("fp")).repartition(parts), within)
    end = lambda c: first.select(F.col("simhash").alias(c), F.col("first").alias(f"of_{c}"))
    near = near.join(end("a"), "a").join(end("b"), "b").select(F.col("of_a").alias("a"), F.col("of_b").alias("b"))
    return same.unionByName(near).where("a <> b")


def _linked(docs: DataFrame, similarity: float, shingle: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """The prints of all rows, and (node, root) of the sets that have a link."""
    if not 0.8 <= similarity <= 1:
        raise ValueError("the bands reach pairs at a similarity of 0.8 or more")
    prints = stash(shingle_prints(docs, shingle, id_col, text_col), "prints")
    texts = docs.select(F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    return prints, components(fingerprint_links(prints).unionByName(similar_links(prints, texts, similarity, shingle)))


def representatives(docs: DataFrame, similarity: float = 0.8, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and text_hash of one row of each group of near duplicates: the smallest id, null ids last, and of its texts that of the smallest hash.

    Near duplicates are linked as by ``near_fingerprints``, and beyond it where their shingle sets are as similar as told.
    """
    prints, roots = _linked(docs, similarity, shingle, id_col, text_col)
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    least = stash(prints.groupBy("fp").agg(F.min(row).alias("row")), "least")  # a group of copies is one row from here on
    tied = least.join(roots, least.fp == roots.node, "left").groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("row").alias("row"))
    return tied.select("row.doc_id", "row.text_hash")


def near_duplicates(docs: DataFrame, similarity: float = 0.8, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits, of the set of shingles) and component_id, the smallest id reachable over pairs within 2 bits of their fingerprints, or at the similarity or above."""
    prints, roots = _linked(docs, similarity, shingle, id_col, text_col)
    return _named(prints.select("doc_id", "fp"), roots)
