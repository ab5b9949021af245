"""Raw rows of public dataset families as canonical rows: ``id``, ``input``, ``expected``, ``metadata``.

A shape takes a DataFrame with a dense ``pos`` column; an id is a prefix and the row's position, given before invalid rows go.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkset.functions import answers as an
from sparkset.functions import conversations as cv
from sparkset.functions import preference as pf


def _first(df: DataFrame, *names: str, default: str | None = None) -> Column:
    """The first of the columns that there are and that is not null."""
    found = [F.col(f"`{n}`") for n in names if n in df.columns]
    more = [F.lit(default)] if default is not None else []
    return F.coalesce(*found, *more) if found or more else F.lit(None).cast("string")


def _row(df: DataFrame, prefix: Column | str, given: dict[str, Column], expected: Column, metadata: dict[str, Column], where: Column | None = None) -> DataFrame:
    made = lambda d: F.struct(*[v.alias(k) for k, v in d.items()])
    rows = df if where is None else df.where(where)
    head = F.lit(prefix) if isinstance(prefix, str) else prefix
    return rows.select("pos", F.concat_ws("_", head, F.col("pos")).alias("id"), made(given).alias("input"), expected.alias("expected"), made(metadata).alias("metadata"))


def local(df: DataFrame, name: str) -> DataFrame:
    known = {"input", "question", "text", "expected", "answer", "label"}
    rest = [c for c in df.columns if c not in known | {"pos"}]
    return df.select("pos", F.concat_ws("_", F.lit(name), F.col("pos")).alias("id"), _first(df, "input", "question", "text").alias("input"), _first(df, "expected", "answer", "label").alias("expected"), (F.struct(*[F.col(f"`{c}`") for c in rest]) if rest else F.lit(None).cast("struct<source:string>")).alias("metadata"))


def grade_school_math(df: DataFrame, name: str = "gsm8k") -> DataFrame:
    answer = _first(df, "answer", default="")
    expected = F.struct(an.numerical_answer(answer).alias("answer"), answer.alias("reasoning"))
    return _row(df, "gsm8k", {"question": _first(df, "question")}, expected, {"complexity": an.count_steps(answer), "difficulty": an.difficulty_of_steps(answer)})


def multiple_choice(df: DataFrame, split: str = "test", subjects: list[str] | None = None) -> DataFrame:
    """Rows of the wanted subjects; positions are those among them."""
    given = _first(df, "choices").cast("array<string>") if "choices" in df.columns else an.choices(df)
    head = F.concat_ws("_", F.lit("mmlu"), F.col("subject"), F.lit(split))
    where = None if subjects is None else F.col("subject").isin(*subjects)
    return _row(df, head, {"question": _first(df, "question"), "choices": F.coalesce(given, F.array().cast("array<string>"))}, an.choice_index(_first(df, "answer")), {"subject": F.col("subject"), "split": F.lit(split)}, where)


def function_synthesis(df: DataFrame, name: str = "humaneval") -> DataFrame:
    prompt, solution = _first(df, "prompt"), _first(df, "canonical_solution")
    given = {"signature": prompt, "tests": _first(df, "test"), "entry_point": _first(df, "entry_point"), "description": an.code_description(prompt)}
    return _row(df, "humaneval", given, solution, {"task_id": _first(df, "task_id"), "difficulty": an.code_difficulty(solution)})


def competition_math(df: DataFrame, name: str = "math_500") -> DataFrame:
    solution = _first(df, "solution")
    prefix = {"math_500": "math500", "hendrycks_math": "hendrycks"}.get(name, name)
    if name in ("math_500", "hendrycks_math"):
        expected = an.boxed_answer(_first(df, "solution", "answer") if name == "math_500" else solution)
        notes = {"solution": solution, "level": _first(df, "level"), "type": _first(df, "type", "subject") if name == "math_500" else _first(df, "type")}
    else:
        expected = F.coalesce(_first(df, "answer"), an.boxed_answer(solution))
        extra = "source" if name == "deepmath" else "difficulty"
        notes = {"solution": solution, extra: _first(df, extra)}
    problem = _first(df, "problem") if name == "hendrycks_math" else _first(df, "problem", "question")
    return _row(df, prefix, {"problem": problem}, expected, notes)


def code_tasks(df: DataFrame, name: str = "deepcoder") -> DataFrame:
    given = {"problem": _first(df, "problem", "prompt", "instruction"), "language": _first(df, "language", default="python")}
    return _row(df, "deepcoder", given, _first(df, "solution", "code", "response"), {k: _first(df, k) for k in ("source", "difficulty", "tags")})


def chats(df: DataFrame, name: str = "chat") -> DataFrame:
    """Rows whose messages form a conversation; no messages are an empty one."""
    column = "messages" if "messages" in df.columns else "conversations"
    kind = df.schema[column].dataType
    fields = kind.elementType.names if isinstance(kind, T.ArrayType) else []
    given = F.coalesce(F.col(column), F.array().cast(kind)) if fields else F.col(column)
    talk = cv.from_messages(given, *(("from", "value") if "from" in fields else ("role", "content"))) if fields else cv.from_text(given)
    return _row(df, "chat", {"conversation": talk}, F.lit(None).cast("string"), {"source": _first(df, "source", default="unknown"), "turn_count": cv.turn_count(talk)}, talk.isNotNull())


def reasoning(df: DataFrame, name: str = "open_thoughts3") -> DataFrame:
    if name == "deepmath_reasoning":
        solution = _first(df, "solution", "answer", default="")
        expected = F.struct(solution.alias("reasoning"), an.final_answer(solution).alias("answer"))
        return _row(df, "deepmath_reasoning", {"prompt": _first(df, "problem", "question", default="")}, expected, {"source": F.lit("deepmath"), "has_reasoning": an.has_long_reasoning(solution)})
    turns = F.col("conversations")
    names = F.create_map(*[F.lit(x) for x in ("human", "user", "gpt", "assistant", "system", "system")])
    talk = F.transform(turns, lambda m: F.struct(F.coalesce(F.try_element_at(names, m["from"]), F.lit("user")).alias("role"), F.coalesce(m["value"], F.lit("")).alias("content")))
    of = lambda who: F.filter(turns, lambda m: m["from"] == who)
    prompt = F.coalesce(F.get(of("human"), 0)["value"], F.lit(""))
    last = F.coalesce(F.try_element_at(of("gpt"), F.lit(-1))["value"], F.lit(""))
    return _row(df, "open_thoughts", {"prompt": prompt, "conversation": talk}, F.struct(last.alias("reasoning")), {"source": F.lit("open_thoughts3"), "turn_count": F.size(turns), "has_reasoning": an.has_reasoning_signs(last)})


def rubrics(df: DataFrame, name: str = "feedback_collection") -> DataFrame:
    pick = lambda c: _first(df, f"orig_{c}", c, default="")
    scores = F.map_from_entries(F.array(*[F.struct(F.lit(i).alias("k"), _first(df, f"orig_score{i}_description", f"score{i}_description").alias("v")) for i in range(1, 6)]))
    rubric = F.map_filter(scores, lambda _, v: v.isNotNull())
    expected = F.struct(pick("reference_answer").alias("reference_answer"), rubric.alias("rubric"))
    return _row(df, "feedback", {"instruction": pick("instruction"), "criteria": pick("criteria")}, expected, {"source": F.lit("feedback_collection"), "has_rubric": F.size(rubric) > 0})


def images(df: DataFrame, name: str) -> DataFrame:
    kind = df.schema["image"].dataType
    image = F.col("image") if isinstance(kind, T.StructType) else F.struct(F.col("image").cast("binary").alias("bytes"), F.lit(None).cast("string").alias("path"))
    notes = {"dataset": F.lit(name)} | ({"species": F.col("species")} if name == "oxford_iiit_pet" and "species" in df.columns else {})
    return _row(df, name, {"image": image}, _first(df, "label"), notes)


def preferences(df: DataFrame, name: str) -> DataFrame:
    label = lambda x: pf.labelled(F.lit(x) if isinstance(x, str) else x)
    if name == "hh_rlhf":
        c = pf.from_dialogues(F.col("chosen"), F.col("rejected"))
        return _row(df, "hh_rlhf", {"comparison": c}, label("a"), {"source": F.lit("hh-rlhf")}, c.isNotNull())
    if name == "helpsteer3":
        better = pf.label_of_sign(F.col("overall_preference"))
        c = pf.comparison(cv.first_content(F.col("context"), "user"), _first(df, "response1", default=""), _first(df, "response2", default=""), source=F.lit("helpsteer3"))
        return _row(df, "helpsteer", {"comparison": c}, label(better), {"source": F.lit("helpsteer3"), "overall_preference": F.col("overall_preference")}, better.isNotNull())
    if name == "helpsteer2":
        rates = ("helpfulness", "correctness", "coherence", "complexity", "verbosity")
        score = F.coalesce(_first(df, "helpfulness", "correctness").cast("double"), F.lit(3.0))
        c = pf.comparison(_first(df, "prompt"), _first(df, "response"), F.lit(""), score=score)
        return _row(df, "helpsteer2", {"comparison": c}, F.lit(None).cast("struct<preferred:string,margin:double>"), {"source": F.lit("helpsteer2"), **{k: _first(df, k) for k in rates}})
    if name == "ultrafeedback":
        c = pf.comparison(_first(df, "instruction", "prompt", default=""), _first(df, "chosen_response", default=""), _first(df, "rejected_response", default=""), source=F.lit("ultrafeedback"))
        return _row(df, "ultrafeedback", {"comparison": c}, label("a"), {"source": F.lit("ultrafeedback"), **{k: _first(df, k) for k in ("chosen_model", "rejected_model")}})
    if name == "arena_140k":
        better = pf.label_of_winner(F.col("winner"))
        first = F.get(F.filter("conversation_a", lambda m: m["role"] == "user"), 0)["content"]
        typed = isinstance(df.schema["conversation_a"].dataType.elementType["content"].dataType, T.ArrayType)
        c = pf.comparison(F.coalesce(cv.typed_text(first) if typed else first, F.lit("")), F.col("conversation_a"), F.col("conversation_b"), source=F.lit("arena"))
        return _row(df, "arena", {"comparison": c}, label(better), {"source": F.lit("arena"), **{k: _first(df, k) for k in ("model_a", "model_b")}}, better.isNotNull())
    head = F.get(F.col("chosen"), 0)
    prompt = F.when(head["role"] == "user", head["content"]).otherwise(_first(df, "prompt", default=""))
    c = pf.comparison(prompt, F.col("chosen"), F.col("rejected"), source=F.lit("tulu_preference"))
    return _row(df, "tulu_pref", {"comparison": c}, label("a"), {"source": F.lit("tulu_preference")})


#: Shape of each family.
SHAPES: dict[str, Callable[..., DataFrame]] = {
    "multiple_choice": multiple_choice, "function_synthesis": function_synthesis, "grade_school_math": grade_school_math, "competition_math": competition_math, "chats": chats,
    "preferences": preferences, "code_tasks": code_tasks, "reasoning": reasoning, "rubrics": rubrics, "images": images,
}
