"""Answers, steps and difficulty in solutions of mathematical and code tasks, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: a boxed answer with one level of braces in it.
BOXED = r"\\boxed\{([^{}]*(?:\{[^{}]*\}[^{}]*)*)\}"
#: Signs of written-out reasoning.
REASONING_SIGNS = ("<think>", "Let me", "First,")


def numerical_answer(answer: Column) -> Column:
    """The number after the last ####, without commas and dollar signs; null where there is none."""
    tail = F.element_at(F.split(answer, "####"), -1)
    number = F.regexp_extract(F.trim(F.regexp_replace(tail, "[,$]", "")), r"^[+-]?\d+(\.\d+)?", 0)
    return F.when(answer.contains("####"), number.try_cast("double"))


def count_steps(answer: Column) -> Column:
    """Calculator marks (<<) and one more; 1 for null."""
    return F.coalesce(F.size(F.split(answer, "<<")), F.lit(1))


def difficulty_of_steps(answer: Column) -> Column:
    n = count_steps(answer)
    return F.when(n <= 2, "easy").when(n <= 4, "medium").otherwise("hard")


def boxed_answer(solution: Column) -> Column:
    """What the first \\boxed{} holds, trimmed; null where there is none."""
    return F.when(solution.rlike(BOXED), F.regexp_replace(F.regexp_extract(solution, BOXED, 1), r"^\s+|\s+$", ""))


def final_answer(solution: Column) -> Column:
    """What follows the last ####, or else the boxed answer."""
    tail = F.regexp_replace(F.element_at(F.split(solution, "####"), -1), r"^\s+|\s+$", "")
    return F.when(solution.contains("####"), tail).otherwise(boxed_answer(solution))


def has_long_reasoning(solution: Column) -> Column:
    return F.char_length(F.coalesce(solution, F.lit(""))) > 100


def has_reasoning_signs(text: Column) -> Column:
    out = F.lit(False)
    for sign in REASONING_SIGNS:
        out |= F.coalesce(text, F.lit("")).contains(sign)
    return out


def code_description(prompt: Column) -> Column:
    """First line with three double quotes, trimmed; empty where there is none."""
    lines = F.filter(F.split(prompt, "\n"), lambda x: x.contains('"""'))
    return F.coalesce(F.regexp_replace(F.get(lines, 0), r"^\s+|\s+$", ""), F.lit(""))


def code_difficulty(solution: Column) -> Column:
    n = F.char_length(solution)
    return F.when(n < 100, "easy").when(n < 300, "medium").when(n >= 300, "hard").otherwise("medium")


def choice_index(answer: Column) -> Column:
    """A to D as 0 to 3, whole numbers as they are, anything else 0."""
    text = F.trim(answer.cast("string"))
    letter = F.array_position(F.array(*map(F.lit, "ABCD")), text) - 1
    return F.coalesce(F.when(letter >= 0, letter), F.when(text.rlike(r"^[+-]?\d+$"), text.try_cast("long")), F.lit(0)).cast("int")


def choices(df) -> Column:
    """The columns A to D that there are, without nulls."""
    return F.array_compact(F.array(*[F.col(c).cast("string") for c in "ABCD" if c in df.columns]).cast("array<string>"))
