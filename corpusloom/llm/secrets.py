"""Secret scans with corpus-wide ownership frequency.

One pass finds spans in whole texts: three base kinds, and opaque tokens as further candidates. Hashes
of the matched values are counted over the corpus by distinct repositories and owners. A candidate that
few owners hold looks live and becomes a span, however many documents of theirs have it; one that many
owners hold is a copied example. Base spans stay whatever their frequency.

Null and empty texts have no spans. A null owner or repository counts as one of its own. Repeated rows
are scanned and returned each. An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash

# The base patterns of the contract, with the least lengths of what they must match.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ASSIGN_MIN = 6
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
ACCESS_MIN = 20
HEX = re.compile(r"[0-9a-f]{24,}")  # maximal runs, so the same spans as runs of any length that pass the least length
KINDS = ("assign", "access", "hex", "opaque")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

OPAQUE = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}")  # maximal runs of any length
OPAQUE_MIN_BITS = 3.5

FOUND = "kinds array<string>, starts array<int>, ends array<int>, hashes array<long>"


def entropy(s: str) -> float:
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in (s.count(x) for x in set(s)))


def opaque(s: str) -> bool:
    """Digits and both cases mixed, with many bits a character: unlike words, paths and numbers."""
    return any(c.isdigit() for c in s) and any(c.islower() for c in s) and any(c.isupper() for c in s) and entropy(s) >= OPAQUE_MIN_BITS


def value_hash(value: str) -> int:
    return int.from_bytes(hashlib.blake2b(value.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def scan(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, value) in one text, by start, then kind as listed; code points, end exclusive."""
    found: list[tuple[str, int, int, str]] = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        found += [("assign", m.start(), m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_MIN]
    if "AKIA" in text:
        found += [("access", m.start(), m.end(), m[0]) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_MIN]
    found += [("hex", m.start(), m.end(), m[0]) for m in HEX.finditer(text)]
    base, at = sorted((a, b) for _, a, b, _ in found), 0
    reach = 0  # the end of the base spans passed so far
    for m in OPAQUE.finditer(text):  # tokens and base spans both go from left to right
        while at < len(base) and base[at][0] < m.end():
            reach, at = max(reach, base[at][1]), at + 1
        if reach <= m.start() and opaque(m[0]):
            found.append(("opaque", m.start(), m.end(), m[0]))
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


def _scan_batches(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for texts in batches:
        out = []
        for text in texts:
            spans = scan(text) if isinstance(text, str) and text else []
            out.append(([s[0] for s in spans], [s[1] for s in spans], [s[2] for s in spans], [value_hash(s[3]) for s in spans]))
        yield pd.DataFrame(out, columns=["kinds", "starts", "ends", "hashes"])





def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str | None = None, max_owners: int = 1) -> DataFrame:
    """One row a document: ``doc_id``, ``text_hash`` and ``spans``, an array of (kind, start, end, owners, repos, live) by start and kind.

    ``repo_col`` defaults to the id, so that each document counts as a repository. ``live`` holds where
    at most ``max_owners`` owners have the value; ``repos`` only informs, since copies and files of one
    owner make no example of its key. Candidates that aren't live are left out; base spans never are.
    """
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.col(owner_col).cast("string"), F.lit("\u0000")).alias("_owner"),
        F.xxhash64(F.col(repo_col or id_col)).alias("_repo"),
        F.xxhash64(F.col(text_col)).alias("text_hash"),
        F.pandas_udf(_scan_batches, FOUND)(F.col(text_col)).alias("f"),
    ).withColumn("_row", F.monotonically_increasing_id())
    rows = stash(rows, "secrets")  # the texts are scanned once; the row keys are fixed from here on
    spans = (
        rows.where(F.size("f.kinds") > 0)
        .select("_row", "_owner", "_repo", F.explode(F.arrays_zip("f.kinds", "f.starts", "f.ends", "f.hashes")).alias("s"))
        .select("_row", "_owner", "_repo", F.col("s.kinds").alias("kind"), F.col("s.starts").alias("start"), F.col("s.ends").alias("end"), F.col("s.hashes").alias("hash"))
    )
    # pairs first, so that a value copied everywhere reaches a task as one row for each owner and repository
    pairs = spans.groupBy("hash", "_owner", "_repo").agg(F.lit(1).alias("one"))
    owners = pairs.groupBy("hash", "_owner").agg(F.count("*").alias("repos")).groupBy("hash").agg(F.count("*").alias("owners"), F.sum("repos").alias("repos"))
    owners = stash(owners, "owners")  # the join below then has two exchanges, and a value held by many rows is split
    live = F.col("owners") <= max_owners
    judged = spans.join(owners, "hash").withColumn("live", live).where((F.col("kind") != "opaque") | F.col("live"))
    rank = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    per_row = judged.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("start", rank.alias("rank"), "end", "kind", "owners", "repos", "live"))).alias("spans"))
    none = F.array().cast(per_row.schema["spans"].dataType)
    return rows.select("_row", "doc_id", "text_hash").join(per_row, "_row", "left").select("doc_id", "text_hash", F.coalesce("spans", none).alias("spans"))


def digest(found: DataFrame) -> DataFrame:
    """Counts and joined spans of the contract."""
    of = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    joined = lambda xs: F.array_join(F.transform(xs, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["kind"] != "opaque")
    return found.select(
        "doc_id",
        of("assign").alias("n_assign"),
        of("access").alias("n_access"),
        of("hex").alias("n_hex"),
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda s: s["live"])).cast("long").alias("n_live"),
        F.size(F.filter("spans", lambda s: ~s["live"])).cast("long").alias("n_copied"),
    )


def _replaced(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """The texts with their spans (start, end, live; by start) replaced; of overlapping ones the first."""
    for texts, spans in batches:
        out = []
        for text, own in zip(texts, spans, strict=True):
            if own is None or text is None:
                out.append(None)
                continue
            parts, at = [], 0
            for s in own:
                if s["start"] >= at:
                    parts += [text[at : s["start"]], "<SECRET>" if s["live"] else "<EXAMPLE>"]
                at = max(at, s["end"])
            out.append("".join([*parts, text[at:]]))
        yield pd.Series(out, dtype=object)


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents with every span replaced: live ones by <SECRET>, copied ones by <EXAMPLE>; n_chars follows.

    Overlapping spans are replaced by the first of them. Documents without spans pass as they are, and a
    null text stays null. Only texts with spans are rebuilt, in one go from left to right. Repeated rows
    are treated alike, an empty table stays empty, and columns keep their names whatever these are.
    """
    spans = find_secrets(docs, id_col, text_col, **options).where(F.size("spans") > 0)
    few = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["live"].alias("live")))
    spans = spans.groupBy("doc_id", "text_hash").agg(F.first(few).alias("spans"))
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}  # no name of a column meets one used here
    packed = docs.select(F.struct(*[F.col(c).alias(k) for c, k in names.items()]).alias("doc"), F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("hash"))
    joined = packed.join(spans, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("hash") == F.col("text_hash")), "left")
    text = F.col("doc")[names[text_col]]
    asked = F.when(F.col("spans").isNotNull(), text)
    joined = joined.select("doc", F.coalesce(F.pandas_udf(_replaced, "string")(asked, "spans"), text).alias("clean"))
    columns = {c: F.col("doc")[k] for c, k in names.items()} | {text_col: F.col("clean")}
    if "n_chars" in names:
        columns["n_chars"] = F.when(F.col("clean").isNull(), columns["n_chars"]).otherwise(F.char_length("clean").cast(docs.schema["n_chars"].dataType))
    return joined.select(*[columns[c].alias(c) for c in docs.columns])
