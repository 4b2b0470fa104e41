"""Model stages as distributed jobs around an injected callable."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.constants import MAX_RETRIES, REVIEW_THRESHOLD
from lexweave.operators.validation import verdict_column, with_verdict
from lexweave.runtime import materialize

# A model call: up to CALL_ROWS prompts for one model in, one answer per row out. Columns in:
# opinion_id, attempt, extraction_model, system_prompt, user_prompt. Columns out, in row order:
# content, prompt_tokens, completion_tokens, call_error (null when it worked).
Infer = Callable[[pd.DataFrame], pd.DataFrame]
# Rows of one call, and calls of one task that run at the same time.
CALL_ROWS, IN_FLIGHT = 32, 4

_ANSWER = "content string, prompt_tokens bigint, completion_tokens bigint, call_error string"


def fill(template: str, **values: Column) -> Column:
    """A template with ``{name}`` places as one concatenation."""
    parts, rest = [], template
    while rest:
        spots = {name: rest.find("{" + name + "}") for name in values}
        spots = {n: at for n, at in spots.items() if at >= 0}
        if not spots:
            parts.append(F.lit(rest))
            break
        name = min(spots, key=spots.get)
        if spots[name]:
            parts.append(F.lit(rest[:spots[name]]))
        parts.append(values[name])
        rest = rest[spots[name] + len(name) + 2:]
    return F.concat(*parts)


def build_prompts(docs: DataFrame, system: str, user: str) -> DataFrame:
    """System and user prompt of every document; ``user`` has case_name, court, opinion_text."""
    return docs.withColumns({
        "system_prompt": F.lit(system),
        "user_prompt": fill(user, case_name=F.col("case_name"), court=F.col("court"),
                            opinion_text=F.col("raw_text")),
    })


def corrective_prompt(template: str, error: Column, previous: Column) -> Column:
    """Follow-up after an invalid answer; the template has error_message, previous_output."""
    return fill(template, error_message=F.coalesce(error, F.lit("Unknown error")),
                previous_output=F.coalesce(previous, F.lit("")))


def route_model(model: Column) -> Column:
    """Provider that serves a model, told by the model's name."""
    return F.when(model.startswith("claude"), "anthropic").otherwise("openai")


def call_model(
    prompts: DataFrame, infer: Infer | Mapping[str, Infer], call_rows: int = CALL_ROWS, in_flight: int = IN_FLIGHT,
) -> DataFrame:
    """Answers to ``prompts`` (opinion_id, attempt, extraction_model, system_prompt, user_prompt), each row asked once.

    Rows go to the provider of their own model: ``infer`` has a callable for each
    (:func:`route_model` names them), or is one for all. A call takes at most
    ``call_rows`` rows of one model, and a task has at most ``in_flight`` calls
    running. A row that fails has its error as a value; a call that raises gives
    its error to its own rows and to no others, and is not repeated here.
    """
    extra = [c for c in prompts.columns if c not in ("system_prompt", "user_prompt")]
    kinds = {f.name: f.dataType.simpleString() for f in prompts.schema.fields}
    schema = ", ".join(f"{c} {kinds[c]}" for c in extra) + ", " + _ANSWER
    names = [part.split()[0] for part in _ANSWER.split(", ")]
    routed = prompts.withColumn("_provider", route_model(F.col("extraction_model")))

    def answer(rows: pd.DataFrame) -> pd.DataFrame:
        provider = rows["_provider"].iloc[0]
        try:
            ask = infer[provider] if isinstance(infer, Mapping) else infer
            out = ask(rows.drop(columns="_provider"))[names].reset_index(drop=True)
            if len(out) != len(rows):
                raise ValueError(f"{len(out)} answers to {len(rows)} prompts")
        except Exception as exc:
            text = f"no provider {provider!r}" if isinstance(exc, KeyError) and exc.args == (provider,) else str(exc)
            out = pd.DataFrame({"content": None, "prompt_tokens": 0, "completion_tokens": 0, "call_error": text}, index=range(len(rows)))
        return pd.concat([rows[extra], out], axis=1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(in_flight) as pool:
            for batch in batches:
                calls = [
                    own.iloc[i:i + call_rows].reset_index(drop=True)
                    for _, own in batch.groupby("extraction_model", dropna=False, sort=False) for i in range(0, len(own), call_rows)]
                yield from pool.map(answer, calls)

    return routed.mapInPandas(run, schema)


def extract_documents(
    docs: DataFrame, infer: Infer | Mapping[str, Infer], model: str, system: str, user: str, corrective: str,
    max_retries: int = MAX_RETRIES, threshold: float = REVIEW_THRESHOLD, strict: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """Runs a model on every document, again with a corrective prompt on bad output.

    ``docs`` has ``opinion_id``, ``case_name``, ``court``, ``raw_text`` and may name
    the ``extraction_model`` of each row; ``model`` serves rows that name none.
    Rows are told apart by opinion and model. Every round handles the documents
    still open as one DataFrame; its answers are written before they are judged,
    so no call is made twice by a later step. Returns outcomes (one row per
    document and model: intelligence or null, status, summed tokens, attempts,
    error) and the log of all attempts.
    """
    rounds = []
    keys = ["opinion_id", "extraction_model"]
    verdict = verdict_column("content", threshold, strict)
    named = F.coalesce(F.col("extraction_model"), F.lit(model)) if "extraction_model" in docs.columns else F.lit(model)
    asked = build_prompts(docs.withColumn("extraction_model", named), system, user).select(*keys, "system_prompt", "user_prompt")
    for attempt in range(1, max_retries + 2):
        prompts = asked.withColumn("attempt", F.lit(attempt))
        answers = materialize(call_model(prompts, infer), "answers")
        judged = with_verdict(answers, verdict)
        checked = judged.withColumn("error", F.coalesce("call_error", "error")).withColumn(
            "valid", F.col("call_error").isNull() & (F.col("stage") == "ok"))
        checked = materialize(checked.drop("call_error", "stage"), "attempts")
        rounds.append(checked)
        failing = checked.filter(~F.col("valid"))
        if attempt > max_retries or failing.isEmpty():
            break
        asked = failing.select(
            *keys, F.lit(system).alias("system_prompt"),
            corrective_prompt(corrective, F.col("error"), F.col("content")).alias("user_prompt"))
    log = rounds[0]
    for more in rounds[1:]:
        log = log.unionByName(more)
    outcomes = log.groupBy(*keys).agg(
        F.max_by("intelligence", "attempt").alias("intelligence"),
        F.max_by("status", "attempt").alias("status"),
        F.max_by("error", "attempt").alias("error"),
        F.max("attempt").alias("attempts"),
        F.sum("prompt_tokens").alias("prompt_tokens"),
        F.sum("completion_tokens").alias("completion_tokens"),
    ).withColumn("status", F.coalesce("status", F.lit("needs_review")))
    return outcomes, log


def embed_texts(rows: DataFrame, text: str, embed: Callable[[pd.Series], list], output: str = "embedding") -> DataFrame:
    """Vector of every row's text, each distinct text embedded once.

    The vectors are written before they are joined back, so a retried task never
    repeats a call that was made.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield pd.DataFrame({text: batch[text], output: list(embed(batch[text]))})

    distinct = rows.select(text).filter(F.col(text).isNotNull()).distinct()
    vectors = materialize(distinct.mapInPandas(run, f"{text} string, {output} array<float>"), "vectors")
    return rows.join(vectors, text, "left")
