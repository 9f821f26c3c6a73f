"""From ranked chunks to the packed context: document scope, thresholds, neighbours, sections, budgets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import text as X

DOC = ("tenant", "doc_name")


def _top_doc() -> Column:
    return F.first(F.struct(*DOC)).over(W.partitionBy("query_id").orderBy("rank").rowsBetween(W.unboundedPreceding, W.unboundedFollowing))


def restrict_to_top_document(ranked: DataFrame) -> DataFrame:
    """Rows of each query's first document; where that has no name, all rows."""
    top = ranked.withColumn("_top", _top_doc())
    return top.where((X.text_of("_top.doc_name") == "") | (F.struct(*DOC) == F.col("_top"))).drop("_top")


def scope_to_hint(ranked: DataFrame, questions: DataFrame, hints: dict[str, tuple[str, ...]], top_k: int) -> DataFrame:
    """Narrow to the document that a question's keywords hint at (two or more of them), if it is also the first."""
    rows = ranked.join(F.broadcast(questions.select("query_id", F.lower("question").alias("_q"))), "query_id").withColumn("_top", _top_doc())
    strengths = F.array(*[F.struct(F.size(F.filter(X.words(keys), lambda k: F.contains(F.col("_q"), k))).alias("n"), (-F.lit(i)).alias("first"), F.lit(hint.lower()).alias("hint")) for i, (hint, keys) in enumerate(hints.items())])
    present = F.array_distinct(F.collect_list(F.lower("doc_name")).over(W.partitionBy("query_id")))
    rows = rows.withColumn("_docs", present).withColumn("_all", strengths)
    best = F.array_max(F.filter("_all", lambda h: (h["n"] > 0) & F.exists("_docs", lambda d: F.contains(d, h["hint"]))))
    rows = rows.withColumn("_best", best)
    narrow = F.coalesce((F.col("_best.n") >= 2) & F.contains(F.lower("_top.doc_name"), F.col("_best.hint")), F.lit(False))
    kept = rows.where(~narrow | (F.struct(*DOC) == F.col("_top"))).where(F.col("rank") <= top_k)
    return kept.drop("_q", "_top", "_docs", "_all", "_best")


def above(ranked: DataFrame, least: float) -> DataFrame:
    """Rows that reach the least score; none may be left. A least of 0 filters nothing."""
    floor = min(max(least, 0.0), 1.0)
    return ranked.where(F.col("score") >= floor) if floor > 0 else ranked


def chunk_neighbours(ranked: DataFrame, chunks: DataFrame, before: int, after: int) -> DataFrame:
    """Seeds in order, then their neighbours in the document by chunk index, with score 0. ``ord`` is the new order."""
    seeds = ranked.withColumn("ord", F.struct(F.lit(0).alias("kind"), F.col("rank").cast("bigint").alias("rank"), F.lit("").alias("doc"), F.lit(0).cast("bigint").alias("ci"), F.col("vector_id").alias("vid")))
    if before <= 0 and after <= 0:
        return seeds
    span = F.sequence(F.greatest(F.lit(0).cast("bigint"), F.col("chunk_index") - before), F.col("chunk_index") + after)
    wanted = ranked.where((X.text_of("doc_name") != "") & F.col("chunk_index").isNotNull()).select("query_id", *DOC, F.explode(span).alias("chunk_index")).distinct()
    extra = chunks.join(wanted, [*DOC, "chunk_index"])
    return _append(seeds, extra, 1)


def section_mates(ranked: DataFrame, chunks: DataFrame, reach: Callable[[DataFrame], DataFrame] | None = None, few: bool = False) -> DataFrame:
    """``ranked`` (with ``ord``) and all chunks of the sections that its rows lie in, or those of them that ``reach`` leaves.

    Every question has all chunks of its sections, whose number is that of questions times that of a section's chunks:
    what can't be packed anyway should go before. The sections are broadcast if they are ``few``.
    """
    keys = [*DOC, "section_path_str"]
    wanted = ranked.where((X.text_of("doc_name") != "") & (X.pystrip(X.text_of("section_path_str")) != "")).select("query_id", *keys).distinct()
    if reach is not None:
        sections = wanted.select(*keys).distinct()
        chunks = reach(chunks.join(F.broadcast(sections) if few else sections, keys, "left_semi"))
    return _append(ranked, chunks.join(wanted, keys), 2)


def within_budget(budget: int, most: int = 0, mixed: bool = False) -> Callable[[DataFrame], DataFrame]:
    """For ``section_mates``: of each section the chunks that ``pack_top_document`` (``mixed``: ``pack_mixed``) can get to.

    What stands before a chunk in its own section stands before it in every question's rows too, so a chunk is out of
    reach where these alone are longer than the budget. Where packing skips what is too long, short ones may follow: of
    one length as many as the budget holds. Texts are cut as in ``_in_reach``. Mixed rows of which the ``most`` first are
    taken, with blank ones, are counted only.
    """
    limit, last = max(budget, 0) + 1, F.lit(10**9).cast("bigint")
    keys = [*DOC, "section_path_str"]
    page = [] if mixed else [F.coalesce(X.parse_page(F.col("page_number")), last)]
    order = [*page, F.coalesce("chunk_index", last), F.col("vector_id")]

    def reach(chunks: DataFrame) -> DataFrame:
        rows = chunks.repartition(*keys).dropDuplicates([*keys, "vector_id"])
        by_order = W.partitionBy(*keys).orderBy(*order)
        if mixed and most > 0:
            return rows.withColumn("_r", F.row_number().over(by_order)).where(F.col("_r") <= most).drop("_r")
        head = F.left("text", F.lit(limit))
        rows = rows.where(X.pystrip(X.text_of("text")) != "").withColumn("_n", F.char_length(head))
        rows = rows.withColumn("text", F.when(X.pystrip(head) == "", F.col("text")).otherwise(head))
        rows = rows.withColumn("_sum", F.sum("_n").over(by_order.rowsBetween(W.unboundedPreceding, 0)))
        near = F.col("_sum") - F.col("_n") <= budget
        if mixed:
            rows = rows.withColumn("_r", F.row_number().over(W.partitionBy(*keys, "_n").orderBy(*order)))
            near = near | ((F.col("_n") < LEAST_SLICE) & (F.col("_r") * F.col("_n") <= budget))
        return rows.where(near).drop("_n", "_sum", "_r")

    return reach


def _append(seeds: DataFrame, extra: DataFrame, kind: int) -> DataFrame:
    keys = ["query_id", *DOC, "vector_id"]
    fresh = extra.join(seeds.select(*keys), keys, "left_anti").dropDuplicates(keys)
    doc = F.concat_ws("\u0001", F.col("doc_name"), F.col("section_path_str") if kind == 2 else F.lit(""))
    order = F.struct(F.lit(kind).alias("kind"), F.lit(0).cast("bigint").alias("rank"), doc.alias("doc"), F.coalesce("chunk_index", F.lit(10**9)).cast("bigint").alias("ci"), F.col("vector_id").alias("vid"))
    fresh = fresh.withColumn("ord", order).withColumn("score", F.lit(0.0))
    return seeds.unionByName(fresh, allowMissingColumns=True).select(*seeds.columns)


LEAST_SLICE = 280


def _in_reach(rows: DataFrame, order: Column, budget: int, skips: bool) -> DataFrame:
    """(query_id, _o, vector_id, text) of the rows that packing can get to, in any number of tasks.

    Rows are taken in order until one is too long for what is left; of those there are no more than the
    budget has characters. Where packing then skips what is too long (with less than ``LEAST_SLICE`` left),
    rows behind that are not longer than what is left may follow: of one length n no more than fit, since
    once one of them is skipped so are all later ones. Texts are cut to the budget and one character, which
    is as much too long as the whole is.
    """
    most = max(budget, 0) + 1
    own = rows.where(X.pystrip(X.text_of("text")) != "").select("query_id", order.alias("_o"), "vector_id", F.left("text", F.lit(most)).alias("text"))
    own = own.withColumn("_n", F.char_length("text"))
    by_order = W.partitionBy("query_id").orderBy("_o")
    head = own.withColumn("_r", F.row_number().over(by_order)).where(F.col("_r") <= most)  # limited in each task before the shuffle
    head = head.withColumn("_sum", F.sum("_n").over(by_order.rowsBetween(W.unboundedPreceding, 0)))
    head = head.where(F.col("_sum") - F.col("_n") <= budget)  # the first that is too long included
    taken = head.select("query_id", "_o", "vector_id", "text")
    if not skips:
        return taken
    full = head.where(F.col("_sum") > budget).groupBy("query_id").agg(F.min(F.struct("_o", (F.lit(budget) - F.col("_sum") + F.col("_n")).alias("left"))).alias("f"))
    later = own.join(full.where(F.col("f.left") < LEAST_SLICE), "query_id").where((F.col("_o") > F.col("f._o")) & (F.col("_n") <= F.col("f.left")))
    later = later.withColumn("_r", F.row_number().over(W.partitionBy("query_id", "_n").orderBy("_o"))).where(F.col("_r") <= LEAST_SLICE)
    later = later.where(F.col("_r") * F.col("_n") <= F.col("f.left"))
    return taken.unionByName(later.select("query_id", "_o", "vector_id", "text"))


def _listed(reached: DataFrame) -> DataFrame:
    entry = F.struct(F.col("_o").alias("o"), F.col("vector_id").alias("vector_id"), F.col("text").alias("text"))
    return reached.groupBy("query_id").agg(F.array_sort(F.collect_list(entry)).alias("_rows"))


def _pack(rows: Column, budget: int, stop_when_full: bool, most: int) -> Column:
    """Fold over rows in order: take what fits; of the first that doesn't, a prefix if enough room is left, and stop.

    With little room, rows that don't fit are skipped, or the fold stops if ``stop_when_full``.
    """
    kind = "array<struct<vector_id:bigint,text:string>>"
    start = F.struct(F.lit(budget).alias("left"), F.lit(budget <= 0).alias("done"), F.array().cast(kind).alias("out"))

    def step(s: Column, r: Column) -> Column:
        n = F.char_length(r["text"])
        fits = n <= s["left"]
        full = F.size(s["out"]) >= most if most > 0 else F.lit(False)
        taken = lambda text: F.array_append(s["out"], F.struct(r["vector_id"].alias("vector_id"), text.alias("text"))).cast(kind)
        whole = F.struct((s["left"] - n).alias("left"), (s["left"] - n <= 0).alias("done"), taken(r["text"]).alias("out"))
        part = F.struct(F.lit(0).alias("left"), F.lit(True).alias("done"), taken(F.left(r["text"], s["left"])).alias("out"))
        skip = F.struct(s["left"].alias("left"), F.lit(stop_when_full).alias("done"), s["out"].alias("out"))
        halt = F.struct(s["left"].alias("left"), F.lit(True).alias("done"), s["out"].alias("out"))
        return F.when(s["done"], s).when(full, halt).when(fits, whole).when(s["left"] >= LEAST_SLICE, part).otherwise(skip)

    return F.aggregate(rows, start, step, lambda s: s["out"])


def _unfold(packed: DataFrame) -> DataFrame:
    return packed.select("query_id", F.posexplode("_out").alias("pos", "c")).select("query_id", (F.col("pos") + 1).alias("position"), "c.vector_id", "c.text")


def pack_mixed(rows: DataFrame, budget: int, most: int = 0) -> DataFrame:
    """(query_id, position, vector_id, text) in the order of ``ord``; ``most`` first rows only if above 0."""
    if most > 0:
        rows = rows.withColumn("_n", F.row_number().over(W.partitionBy("query_id").orderBy("ord"))).where(F.col("_n") <= most).drop("_n")
    reached = _in_reach(rows, F.col("ord"), budget, True)
    return _unfold(_listed(reached).select("query_id", _pack(F.col("_rows"), budget, False, 0).alias("_out")))


def pack_top_document(rows: DataFrame, budget: int, most: int = 0) -> DataFrame:
    """The first document's chunks by page, chunk index and id, until the budget is full."""
    first = rows.groupBy("query_id").agg(F.min_by(F.struct(*DOC), "ord").alias("_top"))  # a row a question
    own = rows.join(first, "query_id").where(F.struct(*DOC) == F.col("_top")).dropDuplicates(["query_id", *DOC, "vector_id"])
    last = F.lit(10**9).cast("bigint")
    order = F.struct(F.coalesce(X.parse_page(F.col("page_number")), last).alias("p"), F.coalesce("chunk_index", last).alias("ci"), F.col("vector_id").alias("vid"))
    reached = _in_reach(own, order, budget, False)
    return _unfold(_listed(reached).select("query_id", _pack(F.col("_rows"), budget, True, most).alias("_out")))


def never_empty(packed: DataFrame, rows: DataFrame, budget: int) -> DataFrame:
    """Where packing left nothing of a query's rows, its first row cut to the budget (8001 if that is not positive)."""
    first = rows.where(X.pystrip(X.text_of("text")) != "").groupBy("query_id").agg(F.min_by(F.struct("vector_id", "text"), "ord").alias("r"), F.min("ord").alias("o"))
    very_first = rows.groupBy("query_id").agg(F.min("ord").alias("o"))
    saved = first.join(very_first, ["query_id", "o"]).join(packed.select("query_id").distinct(), "query_id", "left_anti")
    return packed.unionByName(saved.select("query_id", F.lit(1).alias("position"), "r.vector_id", F.left("r.text", F.lit(budget if budget > 0 else 8001)).alias("text")))


def shrink_to_fit(packed: DataFrame, limit: int | Column, factors: tuple[float, ...] = (1.0, 0.92, 0.85, 0.75, 0.65, 0.55), floor: int = 200, length=F.char_length, order: str = "position", around: Column | None = None) -> DataFrame:
    """As many first texts of a query as fit, and ``factor``, the first one by which all of them are cut (to ``floor`` at least) for that.

    A text that doesn't fit alone is cut to its longest prefix that does, of ``floor`` characters at
    least; its factor is null. ``length`` measures a text as the limit does, in tokens for instance; a
    longer prefix must not be shorter by it. Texts of blanks are left as they are. ``around`` is what each
    text takes besides itself, and ``limit`` may be a column, the same for all rows of a query.
    """
    around = F.lit(0) if around is None else around
    blank = X.pystrip(X.text_of("text")) == ""
    cut = lambda f: F.when(blank, F.col("text")).otherwise(F.left("text", F.greatest(F.lit(floor), F.floor(F.char_length("text") * f)).cast("int"))) if f < 1 else F.col("text")
    upto = W.partitionBy("query_id").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    rows = packed.withColumn("_p", F.row_number().over(W.partitionBy("query_id").orderBy(order)))
    fits = F.lit(None).cast("double")
    for f in reversed(factors):
        total = F.sum(length(cut(f)) + around).over(upto)
        fits = F.when((total <= limit) & ((F.col("_p") > 1) | F.lit(f >= 1)), F.lit(float(f))).otherwise(fits)
    rows = rows.withColumn("_fits", fits)
    own = W.partitionBy("query_id")
    rows = rows.withColumn("_last", F.coalesce(F.max(F.when(F.col("_fits").isNotNull(), F.col("_p"))).over(own), F.lit(1)))
    rows = rows.withColumn("factor", F.max(F.when(F.col("_p") == F.col("_last"), F.col("_fits"))).over(own)).where(F.col("_p") <= F.col("_last"))
    steps = F.sequence(F.lit(1), F.lit(32))
    start = F.struct(F.lit(floor).alias("low"), F.char_length("text").alias("high"))

    def halve(s, _):  # the longest prefix that fits lies from low to high
        mid = F.floor((s["low"] + s["high"] + 1) / 2).cast("int")
        fine = length(F.left("text", mid)) + around <= limit
        open_ = s["low"] < s["high"]
        return F.struct(F.when(open_ & fine, mid).otherwise(s["low"]).alias("low"), F.when(open_ & ~fine, mid - 1).otherwise(s["high"]).alias("high"))

    prefix = F.left("text", F.aggregate(steps, start, halve, lambda s: s["low"]))
    text = F.when(F.col("factor").isNull(), prefix)
    for f in factors:
        text = text.when(F.col("factor") == float(f), cut(f))
    return rows.withColumn("text", text).drop("_p", "_fits", "_last")


def passage_head() -> Column:
    """What stands above a passage: its number, document, page or time, and section."""
    where = F.when(F.col("timestamp").isNotNull(), F.concat(F.lit(" | timestamp "), F.col("timestamp"))).otherwise(F.coalesce(F.concat(F.lit(" | page "), F.col("page_number").cast("string")), F.lit("")))
    section = F.when(X.text_of("section_path_str") != "", F.concat(F.lit(" | section: "), F.col("section_path_str"))).otherwise("")
    return F.concat(F.lit("Passage ["), F.col("position").cast("string"), F.lit("] — Document: "), X.text_of("doc_name"), where, section, F.lit("\n"))


def serialize(context: DataFrame) -> DataFrame:
    """(query_id, context): numbered passages, each under its head."""
    passage = F.concat(passage_head(), F.col("text"))
    listed = context.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("position", passage.alias("p")))).alias("_p"))
    return listed.select("query_id", F.array_join(F.transform("_p", lambda x: x["p"]), "\n\n").alias("context"))


def sources(context: DataFrame, most: int = 3) -> DataFrame:
    """The first ``most`` distinct documents of each query, in order, with where they were first met."""
    first = F.row_number().over(W.partitionBy("query_id", "doc_name").orderBy("position"))
    own = context.where(X.text_of("doc_name") != "").withColumn("_n", first).where(F.col("_n") == 1)
    return own.withColumn("source_rank", F.row_number().over(W.partitionBy("query_id").orderBy("position"))).where(F.col("source_rank") <= most).select("query_id", "source_rank", "doc_name", "page_number", "timestamp")


def batch_progress(batched: DataFrame) -> DataFrame:
    """A line for each batch: up to four distinct pages and the first section."""
    listed = batched.groupBy("query_id", "batch").agg(F.array_sort(F.collect_list(F.struct("rank", X.parse_page(F.col("page_number")).alias("page"), X.text_of("section_path_str").alias("section")))).alias("_r"))
    pages = F.slice(F.array_distinct(F.filter(F.transform("_r", lambda r: r["page"]), lambda p: p.isNotNull())), 1, 4)
    section = F.coalesce(F.get(F.filter(F.transform("_r", lambda r: r["section"]), lambda s: s != ""), F.lit(0)), F.lit(""))
    return listed.select("query_id", "batch", pages.alias("pages"), F.left(section, F.lit(70)).alias("section"))


def fallback_answer(context: DataFrame) -> DataFrame:
    """An answer from the first passage alone."""
    first = context.where(F.col("position") == 1)
    where = F.concat_ws(", ", F.concat(F.lit("page "), F.col("page_number").cast("string")), F.concat(F.lit("section "), F.nullif("section_path_str", F.lit(""))))
    tail = F.when(F.char_length("text") > 420, "…").otherwise("")
    return first.select("query_id", F.concat(F.lit("From "), X.text_of("doc_name"), F.when(where != "", F.concat(F.lit(" ("), where, F.lit(")"))).otherwise(""), F.lit(": "), F.left(X.pystrip(F.col("text")), F.lit(420)), tail).alias("answer"))


def shown_answers(raw: DataFrame, context: DataFrame, stock: tuple[str, ...], denial: tuple[str, ...] = ()) -> DataFrame:
    """(query_id, answer, replaced): what is shown for each raw answer.

    It is formatted; where it then holds one of the assistant's own ``stock`` phrases (lower case), the answer
    from the first passage stands in its place, if there is one. Lines equal to one of ``denial`` go where
    the answer has others.
    """
    shown = raw.select("query_id", X.answer_for_display(F.col("answer"), denial).alias("_shown"))
    instead = fallback_answer(context).withColumnRenamed("answer", "_instead")
    joined = shown.join(instead, "query_id", "left").withColumn("replaced", X.out_of_domain(F.col("_shown"), stock) & F.col("_instead").isNotNull())
    return joined.select("query_id", F.when(F.col("replaced"), F.col("_instead")).otherwise(F.col("_shown")).alias("answer"), "replaced")


def domain_override(context: DataFrame) -> DataFrame:
    """(query_id, override): some chunk is a video's, and chunks of 80 characters or more hold 120 in all."""
    video = (X.text_of("ingest_mode") == "video_transcript") | F.rlike(F.lower(X.text_of("doc_name")), F.lit(r"\.(mp4|mov|mkv|avi|webm)$"))
    n = F.char_length(X.pystrip(F.regexp_replace(X.text_of("text"), r"(?m)^\s*#+\s*", "")))
    return context.groupBy("query_id").agg((F.bool_or(video) & (F.coalesce(F.sum(F.when(n >= 80, n)), F.lit(0)) >= 120)).alias("override"))
