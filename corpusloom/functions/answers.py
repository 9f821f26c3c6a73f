"""Answers that come in parts: what is new in a later part, and text cut for speech."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as X

ITEM = r"^\s*(\d+)\.\s+(.+)$"


def novel_items(new: Column, context: Column) -> Column:
    """The items of a numbered list that are less than 65 % covered by the context, numbered on from its last number.

    Null where the text isn't mostly such a list; empty where no item is new.
    """
    rows = F.transform(X.lines(X.pystrip(X.text_of(new))), lambda x: F.struct(F.regexp_extract(x, ITEM, 1).alias("no"), X.pystrip(F.regexp_extract(x, ITEM, 2)).alias("item"), x.alias("line")))
    items = F.filter(rows, lambda r: r["no"] != "")
    others = F.filter(rows, lambda r: (r["no"] == "") & (X.pystrip(r["line"]) != ""))
    tokens = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]{2,}"), F.lit(0)))
    known = tokens(X.text_of(context))
    share = lambda c: F.size(F.array_intersect(tokens(c), known)) / F.greatest(F.lit(1), F.size(tokens(c)))
    fresh = F.filter(items, lambda r: (F.size(tokens(r["item"])) > 0) & (share(r["item"]) < 0.65))
    numbers = F.transform(F.regexp_extract_all(X.text_of(context), F.lit(r"(?m)^\s*(\d+)\."), F.lit(1)), lambda n: n.cast("bigint"))
    last = F.coalesce(F.array_max(numbers), F.lit(0).cast("bigint"))
    listed = F.transform(fresh, lambda r, i: F.concat((last + 1 + i).cast("string"), F.lit(". "), r["item"]))
    body = F.array_join(F.concat(F.transform(others, lambda r: F.regexp_replace(r["line"], r"\s+$", "")), listed), "\n")
    is_list = (F.size(items) > 0) & (F.size(others) <= F.size(items))
    return F.when(~is_list, None).when(F.size(fresh) == 0, "").otherwise(body)


def packed_sentences(text: Column, most: int = 900) -> Column:
    """Sentences joined to pieces of at most ``most`` characters; one that is longer stays whole up to twice that, then is cut."""
    kind = "array<string>"
    pieces = F.flatten(F.transform(X.speech_sentences(text), lambda s: F.when(F.char_length(s) <= 2 * most, F.array(s)).otherwise(F.transform(F.sequence(F.lit(1), F.char_length(s), F.lit(2 * most)), lambda i: F.substring(s, i, F.lit(2 * most))))))
    start = F.struct(F.array().cast(kind).alias("done"), F.lit("").alias("open"))

    def step(state: Column, s: Column) -> Column:
        fits = (state["open"] == "") | (F.char_length(state["open"]) + 1 + F.char_length(s) <= most)
        joined = F.when(state["open"] == "", s).otherwise(F.concat(state["open"], F.lit(" "), s))
        return F.when(fits, F.struct(state["done"].alias("done"), joined.alias("open"))).otherwise(F.struct(F.array_append(state["done"], state["open"]).alias("done"), s.alias("open")))

    return F.aggregate(pieces, start, step, lambda s: F.when(s["open"] == "", s["done"]).otherwise(F.array_append(s["done"], s["open"])))


# Lines of the prompt that a model may repeat, and lines that say nothing.
ECHOES = ("user query:", "retrieved context:", "rag input contract")
NUMBERED_SOURCE = r"^\[\d+\]\s+source:\s"
OFFER = "would you like to know"
FILLERS = ("hi", "hello", "hey", "ok", "okay", "thanks", "thank you", "thankyou")
INNER_CITATIONS = (r"(?i)\s*\[Source:\s*chunk[^\]]+\]", r"(?i)\s*\(Source:\s*chunk[^)]+\)", r"(?i)\s*\[chunk\s*\d+[^\]]*\]", r"(?i)\s*\[Passage\s*\d+[^\]]*\]")


def distinct_lines(text: Column) -> Column:
    """Lines without blank ones and repeats; case, the width of blanks, and dots and blanks at the ends don't tell lines apart."""
    rows = F.filter(F.transform(X.lines(text), X.pystrip), lambda x: x != "")
    key = lambda x: F.regexp_replace(X.squeeze(F.lower(x)), r"^[ .]+|[ .]+$", "")

    def kept(r: Column) -> Column:
        return X.bind(F.transform(r, key), lambda keys: F.filter(r, lambda x, i: F.array_position(keys, key(x)) == i + 1))

    return X.pystrip(F.array_join(X.bind(rows, kept), "\n"))


def clean_answer(text: Column, denial: str | None = None, phrases: tuple[str, ...] = ()) -> Column:
    """An answer without echoes of the prompt and repeated lines.

    What stands before the last ``Answer:`` goes. Where a text holds all of the ``phrases`` (lower case)
    that give a refusal away, it becomes ``denial``.
    """
    body = F.regexp_replace(X.pystrip(X.text_of(text)), r"(?is)^.*answer:", "")

    def echo(x: Column) -> Column:
        low = F.lower(X.pystrip(x))
        found = F.rlike(low, F.lit(NUMBERED_SOURCE))
        for start in ECHOES:
            found |= F.startswith(low, F.lit(start))
        return found

    body = X.drop_lines(body, lambda x: ~echo(x))
    tidy = F.regexp_replace(F.regexp_replace(body, r"(?im)^as an assistant,?\s*", ""), rf"(?im)^{OFFER}:?\s*$", "")
    tidy = distinct_lines(X.pystrip(F.regexp_replace(tidy, r"\n{3,}", "\n\n")))
    if not phrases or denial is None:
        return tidy
    refused = F.lit(True)
    for phrase in phrases:
        refused &= F.contains(F.lower(body), F.lit(phrase))
    return F.when(refused, F.lit(denial)).otherwise(tidy)


def finished_answer(text: Column) -> Column:
    """An answer without offers, second lists of bullets or key points, closing greetings, and citations of chunks."""
    t = X.drop_lines(X.pystrip(X.text_of(text)), lambda x: ~F.startswith(F.lower(X.pystrip(x)), F.lit(OFFER)))

    def one_bullet_list(t: Column) -> Column:
        parts = F.split(t, r"(?im)^\s*bullet\s*points?\s*:\s*$")
        bullet = F.lit(r"(?m)^\s*(?:•|-)\s+\S")
        several = X.pystrip(F.concat(F.get(parts, 0), F.lit("\n\n"), X.pystrip(F.get(parts, 1))))
        twice = F.rlike(X.pystrip(F.get(parts, 0)), bullet) & F.rlike(X.pystrip(F.get(parts, 1)), bullet)
        return F.when(F.size(parts) >= 3, several).when((F.size(parts) == 2) & twice, X.pystrip(F.get(parts, 0))).otherwise(t)

    header = r"^\s*key\s*points\s*:\s*$"
    t = F.regexp_replace(X.bind(t, one_bullet_list), rf"(?ims)\A(.*?{header}.*?)\s*{header}.*\z", "$1")
    t = F.array_join(F.transform(X.lines(X.run_on_bullets(t)), X.inline_bullets), "\n")
    rows = X.lines(X.key_points_spacing(t))
    filler = lambda x: F.lower(X.pystrip(x)).isin(*FILLERS)

    def without_fillers(r: Column) -> Column:
        last = F.array_max(F.transform(r, lambda x, i: F.when(~filler(x) | (i == 0), i + 1)))
        return F.slice(r, 1, F.greatest(F.lit(1), last))

    t = X.pystrip(F.array_join(X.bind(rows, without_fillers), "\n"))
    for pattern in INNER_CITATIONS:
        t = F.regexp_replace(t, pattern, "")
    return X.pystrip(F.regexp_replace(F.regexp_replace(t, r"[ \t]{2,}", " "), r"\n{3,}", "\n\n"))


def suppress_repeat(emitted: Column, new: Column) -> Column:
    """``new`` without the longest prefix that it shares with what was emitted, and, if that is all of it, without the blanks behind."""
    a, b = X.text_of(emitted), X.text_of(new)
    chars = lambda c: F.regexp_extract_all(c, F.lit("(?s)."), F.lit(0))
    same = F.zip_with(chars(a), chars(b), lambda x, y: x.eqNullSafe(y))
    first = F.array_position(F.array_append(same, F.lit(False)), F.lit(False))  # where they part, from 1

    def rest(at: Column) -> Column:
        left = F.substring(b, at.cast("int"), F.char_length(b))
        return F.when(at > F.char_length(a), F.regexp_replace(left, r"^\s+", "")).otherwise(left)

    return F.when(a == "", b).otherwise(X.bind(first, rest))


def rolling_drafts(parts: Column, most: int = 1400) -> Column:
    """For each part of an answer (an array in order) the tail of all that came before it."""
    none = F.struct(F.lit("").alias("draft"), F.array().cast("array<string>").alias("seen"))

    def step(state: Column, part: Column) -> Column:
        joined = X.draft_tail(F.concat_ws("\n\n", F.nullif(state["draft"], F.lit("")), part), most)
        told = F.when(X.pystrip(X.text_of(part)) == "", state["draft"]).otherwise(joined)
        return F.struct(told.alias("draft"), F.array_append(state["seen"], state["draft"]).alias("seen"))

    return F.aggregate(parts, none, step, lambda s: s["seen"])


def streamed_parts(parts: Column, most: int = 1400) -> Column:
    """For each part of an answer struct(draft, text): what it is told of the parts before, and what of it is no repeat of that."""
    kind = "array<struct<draft:string,text:string>>"
    none = F.struct(F.lit("").alias("draft"), F.array().cast(kind).alias("out"))

    def step(state: Column, part: Column) -> Column:
        def told(text: Column) -> Column:
            draft = X.draft_tail(F.concat_ws("\n\n", F.nullif(state["draft"], F.lit("")), text), most)
            seen = F.array_append(state["out"], F.struct(state["draft"].alias("draft"), text.alias("text"))).cast(kind)
            return F.struct(F.when(X.pystrip(text) == "", state["draft"]).otherwise(draft).alias("draft"), seen.alias("out"))

        return X.bind(suppress_repeat(state["draft"], part), told)

    return F.aggregate(parts, none, step, lambda s: s["out"])
