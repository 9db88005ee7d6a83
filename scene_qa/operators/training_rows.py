"""Rows that a trainer reads: chat messages, image sizes, loss masks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

IGNORED = -100


def messages(question: Column, answer_space: Column, target: Column, evidence_json: Column | None = None) -> Column:
    """A user message with the question and the answers to choose from, and the assistant's; a trace target states its
    evidence before the answer."""
    prompt = F.concat(question, F.lit("\nChoose one answer: "), F.array_join(answer_space, ", "))
    said = target if evidence_json is None else F.when(evidence_json.isNotNull(), F.concat(F.lit("Evidence: "), evidence_json, F.lit("\nAnswer: "), target)).otherwise(target)
    return F.array(F.struct(F.lit("user").alias("role"), prompt.alias("content")), F.struct(F.lit("assistant").alias("role"), said.alias("content")))


def bounded_size(width: Column, height: Column, max_pixels: int) -> Column:
    """Width and height of an image scaled, at its proportions, to at most max_pixels; smaller images keep theirs."""
    if max_pixels <= 0:
        raise ValueError("max_pixels must be positive")
    scale = F.sqrt(F.lit(float(max_pixels)) / (width * height))
    fit = lambda side: F.when(width * height > max_pixels, F.greatest(F.lit(1), F.floor(side * scale).cast("int"))).otherwise(side.cast("int"))
    return F.struct(fit(width).alias("width"), fit(height).alias("height"))


def loss_labels(ids: Column, prompt: Column, pad: int | None, support: Column, answer_end: Column, attention: Column | None = None) -> tuple[Column, Column]:
    """(labels, error) of a token array. Padding is ignored, with pad None there is none; AA ignores all but the answer, from
    the prompt's end to answer_end (null: the end of the array); PC keeps the prompt. The error is null for a sound row: a
    prompt that is empty or no prefix, an unknown support, an attention mask of another length, a span out of bounds, or
    nothing left to learn after the first place."""
    shown = lambda x, i: (F.get(attention, i) != 0) if attention is not None else F.lit(True) if pad is None else (x != pad)
    end = F.coalesce(answer_end, F.size(ids))
    inside = lambda i: (support == "PC") | ((i >= F.size(prompt)) & (i < end))
    labels = F.transform(ids, lambda x, i: F.when(shown(x, i) & inside(i), x).otherwise(IGNORED))
    error = F.when(prompt.isNull() | (F.size(prompt) == 0) | ~F.slice(ids, 1, F.greatest(F.size(prompt), F.lit(1))).eqNullSafe(prompt), "prompt is no prefix").when(support.isNull() | ~support.isin("PC", "AA"), "support")
    if attention is not None:
        error = error.when(F.size(attention) != F.size(ids), "attention length")
    error = error.when((end <= F.size(prompt)) | (end > F.size(ids)), "answer span").when(~F.exists(F.slice(labels, 2, F.greatest(F.size(ids), F.lit(1))), lambda x: x != IGNORED), "nothing to learn")
    return labels, error
