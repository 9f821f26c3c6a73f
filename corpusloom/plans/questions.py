"""What a question asks for: for a caller's few questions on the driver, for a table of them as columns."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.text import BASELINE_GENERIC, OVERLAP_STOPS, QUESTION_STOPS, SUFFIXES

# How a question names an attribute of a thing.
FOCUS = (
    r"^(?:what|which)\s+is\s+(?:the\s+)?(.+?)\s+of\s+(?:the\s+)?.+$",
    r"^(?:what|which)\s+are\s+(?:the\s+)?(.+?)\s+of\s+(?:the\s+)?.+$",
    r"^(?:tell\s+me|explain|describe)\s+(?:the\s+)?(.+?)\s+of\s+(?:the\s+)?.+$",
)
# Triggers (substrings of the question) and what is added to its words for them.
EXPANSIONS = (
    (
        ("voltage", "volt", "vac", "vdc", "electrical", "power supply", "line voltage", "mains", "frequency", "hz", "amp", "current"),
        "rated input voltage AC DC electrical specifications power consumption frequency",
    ),
    (
        ("troubleshoot", "troubleshooting", "not light", "does not light", "indicator", "power indicator", "lamp", "fault", "not working", "doesn't work", "won't turn"),
        "troubleshooting diagnostic fault repair power connection indicator lamp supply",
    ),
    (
        ("safe", "safety", "hazard", "precaution", "warning", "ppe", "protective", "eye"),
        "safety hazard warning precaution operation protective equipment",
    ),
    (
        ("weight", "kg", "dimension", "size", "mass"),
        "physical specifications weight dimensions",
    ),
    (
        ("calibrat", "verification", "qualification", "validation protocol", " as-found", "as-left", "iq ", "oq ", "pq "),
        "calibration verification qualification adjustment tolerance specification check procedure",
    ),
    (
        ("temperature", "humidity", "dew point", "relative humidity", "rh ", "pressure", " psi", " bar", " kpa", " mpa"),
        "environmental operating conditions range limits specifications",
    ),
    (
        ("chromatograph", "hplc", "uhplc", "lc-ms", "gc-ms", "2d-lc", "2d lc", "two-dimensional", "heart-cut", "heart cut", "heart-cutting", "multiple heart", "comprehensive 2d", "lc x lc", "lclc"),
        "separation column valve sample loop injection modulation multidimensional chromatography method principle backward reverse order contamination flush gradient parking deck peak lost occupied loop analysis",
    ),
    (
        ("what is", "define", "definition", "principle", "principles", "overview", "purpose of"),
        "characteristics description notes operation overview",
    ),
)
BM25_QUERY_CHARS = 900


def tokens(s: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", s.lower())


def informative(token: str) -> bool:
    return len(token) >= 3 or (len(token) == 2 and any(c.isdigit() for c in token))


def lexical_terms(s: str, generic: Iterable[str]) -> list[str]:
    noise = {*QUESTION_STOPS, *generic}
    return [t for t in re.findall(r"[a-z]{3,}", s.lower()) if t not in noise]


def words_asked(questions: Iterable[str]) -> list[str]:
    """All words that any step looks up in the list of generic terms."""
    return sorted({t for q in questions for t in [*tokens(q), *re.findall(r"[a-z]{3,}", q.lower())]})


def focus_of(question: str) -> str | None:
    flat = " ".join(question.split())
    for pattern in FOCUS:
        if m := re.match(pattern, flat, re.IGNORECASE):
            focus = m[1].strip().rstrip("?.!,;:")
            if len(focus) >= 3:
                return focus
    return None


def retrieval_query(question: str, generic: Iterable[str] = BASELINE_GENERIC, clean: bool = True) -> str:
    """The words that are looked for: those of the focus, else terms that carry signal, else the question as it is."""
    raw = question.strip()
    if not raw or not clean:
        return raw
    generic = set(generic)
    if focus := focus_of(raw):
        kept = [t for t in tokens(focus) if t not in QUESTION_STOPS and informative(t)]
        return " ".join(kept) or " ".join(focus.lower().split())
    terms = lexical_terms(raw, generic)
    if len(terms) >= 2:
        return " ".join(terms)
    kept = [t for t in tokens(raw) if t not in QUESTION_STOPS and t not in generic and informative(t)]
    return " ".join(kept) or raw


def variants(question: str, generic: Iterable[str] = BASELINE_GENERIC, clean: bool = True) -> list[str]:
    """The retrieval query, the question, and an expansion for each kind of question it is; repeats (but for case) go."""
    raw = question.strip()
    if not raw:
        return ["equipment manual"]
    base = retrieval_query(raw, generic, clean) or raw
    low = raw.lower()
    every = [base, *([raw] if clean else []), *(f"{base} {added}" for triggers, added in EXPANSIONS if any(t in low for t in triggers))]
    return list({v.lower(): v for v in reversed(every)}.values())[::-1]


def bm25_query(question: str, generic: Iterable[str] = BASELINE_GENERIC, clean: bool = True) -> str:
    """The first two variants, cut to a length, and cleaned once more."""
    found = variants(question, generic, clean)
    joined = " ".join(v.strip() for v in found[:2])[:BM25_QUERY_CHARS]
    return retrieval_query(joined, generic, clean)


def stem(token: str) -> str:
    if len(token) < 2:
        return ""
    if len(token) > 4:
        for suffix in SUFFIXES:
            if token.endswith(suffix) and len(token) - len(suffix) >= 4:
                return token[: -len(suffix)]
    return token


def question_rows(spark: SparkSession, questions: Iterable[tuple], generic: Iterable[str] = BASELINE_GENERIC, clean: bool = True) -> DataFrame:
    """One row a question (query_id, question, query_vec): terms, phrases, focus, BM25 and rerank terms.

    A batch of questions is a list that the caller holds, so it is small.
    """
    generic = sorted(set(generic))
    out = []
    for query_id, question, vec in questions:
        active = retrieval_query(question, generic, clean)
        terms = lexical_terms(active, generic)
        phrases = [" ".join(terms[i : i + n]) for n in (3, 2) for i in range(len(terms) - n + 1)]
        overlap = [s for t in tokens(active) if t not in OVERLAP_STOPS and len(s := stem(t)) >= 2 and s not in OVERLAP_STOPS]
        out.append((query_id, question, [float(x) for x in vec], active, terms, phrases, focus_of(question) is not None, tokens(bm25_query(question, generic, clean)), sorted(set(terms)) or sorted(set(overlap))))
    schema = "query_id bigint, question string, query_vec array<double>, active string, terms array<string>, phrases array<string>, has_focus boolean, bm25_terms array<string>, rerank_terms array<string>"
    return spark.createDataFrame(out, schema)


# ---------------------------------------------------------------- as columns


def focus_column(question: Column) -> Column:
    """``focus_of`` as a column; null without a focus."""
    flat = X.pystrip(F.regexp_replace(F.translate(question, X.WHITE, " " * len(X.WHITE)), " +", " "))
    named = lambda f: F.array(*[F.regexp_replace(X.pystrip(F.regexp_extract(f, f"(?i){pattern}", 1)), r"[?.!,;:]+$", "") for pattern in FOCUS])
    return F.get(F.filter(X.bind(flat, named), lambda f: F.char_length(f) >= 3), F.lit(0))


def _informative(t: Column) -> Column:
    return (F.char_length(t) >= 3) | ((F.char_length(t) == 2) & F.rlike(t, F.lit("[0-9]")))


def _known(words: Column, listed) -> Column:
    """``words`` that aren't listed; ``listed`` is a column of words or a sequence."""
    stop = listed if isinstance(listed, Column) else X.words(tuple(listed))
    return F.filter(words, lambda t: ~F.array_contains(stop, t))


def lexical_column(c: Column, generic) -> Column:
    return _known(_known(F.regexp_extract_all(F.lower(c), F.lit("[a-z]{3,}"), F.lit(0)), QUESTION_STOPS), generic)


def retrieval_column(question: Column, generic, clean: bool = True) -> Column:
    """``retrieval_query`` as a column."""
    if not clean:
        return X.pystrip(question)

    def words_of(q: Column) -> Column:
        raw, focus = q["raw"], q["focus"]
        asked = lambda c: F.array_join(F.filter(_known(X.bm25_tokens(c), QUESTION_STOPS), _informative), " ")
        plain = F.regexp_replace(F.translate(F.lower(focus), X.WHITE, " " * len(X.WHITE)), " +", " ")
        focused = F.coalesce(F.nullif(asked(focus), F.lit("")), X.pystrip(plain))
        terms = lexical_column(raw, generic)
        kept = F.array_join(F.filter(_known(_known(X.bm25_tokens(raw), QUESTION_STOPS), generic), _informative), " ")
        free = F.when(F.size(terms) >= 2, F.array_join(terms, " ")).otherwise(F.coalesce(F.nullif(kept, F.lit("")), raw))
        return F.when(raw == "", raw).when(focus.isNotNull(), focused).otherwise(free)

    return X.bind(X.pystrip(question), lambda raw: X.bind(F.struct(raw.alias("raw"), focus_column(raw).alias("focus")), words_of))


def variant_columns(question: Column, generic, clean: bool = True) -> Column:
    """``variants`` as an array column."""

    def listed(q: Column) -> Column:
        raw, low = q["raw"], F.lower(q["raw"])
        base = F.coalesce(F.nullif(q["base"], F.lit("")), raw)
        added = [F.when(X.contains_any(low, triggers), F.concat(base, F.lit(f" {more}"))) for triggers, more in EXPANSIONS]
        every = F.filter(F.array(base, *([raw] if clean else []), *added), lambda v: v.isNotNull())
        lower = F.transform(every, F.lower)
        first = F.filter(every, lambda v, i: F.array_position(lower, F.lower(v)) == i + 1)
        return F.when(raw == "", F.array(F.lit("equipment manual"))).otherwise(first)

    return X.bind(X.pystrip(question), lambda raw: X.bind(F.struct(raw.alias("raw"), retrieval_column(raw, generic, clean).alias("base")), listed))


def bm25_column(question: Column, generic, clean: bool = True) -> Column:
    """``bm25_query`` as a column."""
    joined = lambda v: F.left(F.array_join(F.transform(F.slice(v, 1, 2), X.pystrip), " "), F.lit(BM25_QUERY_CHARS))
    return retrieval_column(X.bind(variant_columns(question, generic, clean), joined), generic, clean)


def generic_of(questions: DataFrame, generic: DataFrame) -> DataFrame:
    """(query_id, question, query_vec, _generic): of a table of generic words (token) those that some step looks up for the question."""
    added = sorted({t for _, more in EXPANSIONS for t in [*tokens(more), *re.findall(r"[a-z]{3,}", more.lower())]})
    asked = F.array_union(X.bm25_tokens(F.col("question")), F.regexp_extract_all(F.lower(X.text_of("question")), F.lit("[a-z]{3,}"), F.lit(0)))
    each = questions.select("query_id", F.explode(F.array_union(asked, X.words(tuple(added)))).alias("token"))
    held = each.join(generic.select("token").distinct(), "token").groupBy("query_id").agg(F.array_sort(F.collect_set("token")).alias("_generic"))
    return questions.join(held, "query_id", "left").withColumn("_generic", F.coalesce("_generic", F.array().cast("array<string>")))


def question_columns(questions: DataFrame, generic: Iterable[str] | DataFrame = BASELINE_GENERIC, clean: bool = True) -> DataFrame:
    """The rows of ``question_rows`` for a table of (query_id, question, query_vec) of any size; a null question is an empty one.

    ``generic`` is a list, or a table with ``token``, of which a question is joined with the words it needs.
    """
    rows = generic_of(questions, generic) if isinstance(generic, DataFrame) else questions
    known = F.col("_generic") if isinstance(generic, DataFrame) else sorted(set(generic))
    question = X.text_of("question")
    # each step is a projection of its own kind of row, so that nothing is worked out twice
    rows = rows.select("query_id", question.alias("question"), F.col("query_vec").cast("array<double>").alias("query_vec"), retrieval_column(question, known, clean).alias("active"), *(["_generic"] if isinstance(generic, DataFrame) else []))
    terms = lexical_column(F.col("active"), known)

    def analysed(t: Column) -> Column:
        grams = lambda n: F.when(F.size(t) >= n, F.transform(F.sequence(F.lit(1), F.size(t) - n + 1), lambda i: F.array_join(F.slice(t, i, n), " "))).otherwise(F.array().cast("array<string>"))
        overlap = F.array_sort(F.array_distinct(X.overlap_tokens(F.col("active"))))
        rerank = F.when(F.size(t) > 0, F.array_sort(F.array_distinct(t))).otherwise(overlap)
        return F.struct(t.alias("terms"), F.concat(grams(3), grams(2)).alias("phrases"), rerank.alias("rerank_terms"))

    found = rows.withColumn("_a", X.bind(terms, analysed))
    bm25 = X.bm25_tokens(bm25_column(F.col("question"), known, clean))
    return found.select("query_id", "question", "query_vec", "active", "_a.terms", "_a.phrases", focus_column(F.col("question")).isNotNull().alias("has_focus"), bm25.alias("bm25_terms"), "_a.rerank_terms")
