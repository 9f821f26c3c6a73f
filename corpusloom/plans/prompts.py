"""From packed contexts to prompts that fit the model: the last step before an answer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import expand


def prompt_cap(n_ctx: int, max_new_tokens: int) -> int:
    """What a prompt may take of a model's context: room for the answer and some slack stay free."""
    context = max(512, n_ctx)
    answer = 512 if max_new_tokens <= 0 else min(max_new_tokens + 128, context // 2)
    return max(128, context - answer - 256)


def fitted_prompts(context: DataFrame, questions: DataFrame, static: str, cap: int, length=F.char_length) -> tuple[DataFrame, DataFrame]:
    """(query_id, prompt) for each question with a context, and the context as it was cut for that.

    Texts are cut evenly in steps, then the last passage goes, and so on; a passage that is left alone is
    cut to a prefix (see ``expand.shrink_to_fit``). ``length`` measures the static part, the question and each
    passage as the cap does; where the whole of a prompt may measure more than its parts, take a lower cap.
    Questions need query_id and question; ``language`` is worked out where the column is missing.
    """
    q = questions.select("query_id", X.text_of("question").alias("_question"), (F.col("language") if "language" in questions.columns else X.language_route(X.text_of("question"))).alias("_lang"))
    prompt = lambda passages: X.assemble_prompt(F.col("_question"), passages, F.col("_lang"), F.lit(1), F.lit(1), static)
    gap = F.lit("\n\n")
    rows = context.join(q.withColumn("_left", F.lit(cap) - length(prompt(F.lit(""))) + length(gap)), "query_id")  # passages have a gap less than there are of them
    around = length(expand.passage_head()) + length(gap)
    fitted = expand.shrink_to_fit(rows, F.col("_left"), length=length, around=around).drop("_left", "_question", "_lang")
    told = expand.serialize(fitted).join(q, "query_id")
    return told.select("query_id", prompt(F.col("context")).alias("prompt")), fitted
