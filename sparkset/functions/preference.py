"""Comparisons of two responses and labels that say which is preferred, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkset.functions.conversations import from_text, user_prompt

#: Names of outcomes in public data.
OUTCOMES = {"a": "a", "b": "b", "tie": "tie", "chosen": "a", "rejected": "b", "model_a": "a", "model_b": "b"}
SCORES = {"a": 1.0, "b": 0.0, "tie": 0.5}


def comparison(prompt: Column, a: Column, b: Column, **metadata: Column) -> Column:
    notes = F.struct(*[v.alias(k) for k, v in metadata.items()]) if metadata else F.lit(None).cast("struct<source:string>")
    return F.struct(prompt.alias("prompt"), a.alias("response_a"), b.alias("response_b"), notes.alias("metadata"))


def preferred(label: Column) -> Column:
    """a, b or tie, from any of the names of outcomes in any case; null for others."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in OUTCOMES.items() for x in kv]), F.lower(F.trim(label)))


def labelled(label: Column, margin: Column | None = None) -> Column:
    return F.struct(label.alias("preferred"), (F.lit(None).cast("double") if margin is None else margin).alias("margin"))


def label_score(label: Column) -> Column:
    """1 if the first response is preferred, 0 if the second, a half for a tie."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in SCORES.items() for x in kv]), preferred(label))


def is_preferred(label: Column, which: str) -> Column:
    return preferred(label) == which


def from_dialogues(chosen: Column, rejected: Column) -> Column:
    """Comparison of two dialogues written as text; the prompt is what the user says in the first. Null if either has no turn."""
    a, b = from_text(chosen), from_text(rejected)
    return F.when(a.isNotNull() & b.isNotNull(), comparison(user_prompt(a), a, b, source=F.lit("hh_rlhf")))


def from_ranked(prompt: Column, responses: Column, score_fields: tuple[str, ...] = ("score",)) -> Column:
    """Comparison of the best with the worst of an array of responses by score (the first field that is set; none: 0).

    Responses that tie stay in order. Null where there are fewer than two.
    """
    score = lambda r: F.coalesce(*[r[f].cast("double") for f in score_fields], F.lit(0.0))
    ranked = F.array_sort(F.transform(responses, lambda r, i: F.struct((-score(r)).alias("by"), i.alias("i"), r.alias("r"))))
    best, worst = F.get(ranked, 0)["r"], F.try_element_at(ranked, F.lit(-1))["r"]
    return F.when(F.size(responses) >= 2, comparison(prompt, best["response"], worst["response"], source=F.lit("ultrafeedback"), model_a=best["model"], model_b=worst["model"]))


def label_of_sign(preference: Column) -> Column:
    """a below zero, b above it and for null, null (no row) at zero."""
    return F.when(preference < 0, "a").when((preference > 0) | preference.isNull(), "b")


def label_of_winner(winner: Column) -> Column:
    return F.when(winner == "model_a", "a").when(winner == "model_b", "b")
