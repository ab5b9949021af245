"""Catalogue of public datasets by name."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Entry:
    name: str
    repo: str
    config: str
    shape: str
    domain: str
    task_type: str
    description: str
    license: str
    citation: str
    difficulty: str
    languages: tuple[str, ...]
    tags: tuple[str, ...]
    num_items: int | None = None

    @property
    def source_url(self) -> str:
        return f"https://huggingface.co/datasets/{self.repo}"


_H = "Hendrycks et al., 2021"
_EN = ("en",)
#: Facts about public datasets (the descriptions are our own).
ENTRIES = [
    Entry("mmlu", "cais/mmlu", "all", "multiple_choice", "general_knowledge", "multiple_choice_qa", "Exam questions with four options on 57 school, college and professional subjects", "MIT", _H, "challenging", _EN, ("knowledge", "reasoning", "multiple_choice", "stem", "humanities", "social_sciences"), 15908),
    Entry("mmlu_stem", "cais/mmlu", "stem", "multiple_choice", "stem", "multiple_choice_qa", "The exam subjects on nature, computing and mathematics alone", "MIT", _H, "challenging", _EN, ("knowledge", "reasoning", "multiple_choice", "stem")),
    Entry("humaneval", "openai/openai_humaneval", "default", "function_synthesis", "code", "code_generation", "Python functions to be completed from a docstring, each checked by unit tests", "MIT", "Chen et al., 2021", "medium", ("python",), ("code", "programming", "python", "generation"), 164),
    Entry("gsm8k", "openai/gsm8k", "main", "grade_school_math", "math", "math_word_problems", "Grade school arithmetic told as short stories; answers show the steps and end in a number", "MIT", "Cobbe et al., 2021", "medium", _EN, ("math", "reasoning", "word_problems", "arithmetic"), 8500),
    Entry("math_500", "HuggingFaceH4/MATH-500", "default", "competition_math", "math", "math_reasoning", "Five hundred contest problems held out for evaluation", "MIT", _H, "challenging", _EN, ("math", "reasoning"), 500),
    Entry("hendrycks_math", "EleutherAI/hendrycks_math", "default", "competition_math", "math", "math_reasoning", "Contest problems with worked solutions, by subject and level", "MIT", _H, "challenging", _EN, ("math", "reasoning")),
    Entry("deepmath", "zwhe99/DeepMath-103K", "default", "competition_math", "math", "math_reasoning", "Hard mathematics problems with checked answers, for training", "unknown", "unknown", "medium", _EN, ("math", "reasoning")),
    Entry("polaris", "POLARIS-Project/Polaris-Dataset-53K", "default", "competition_math", "math", "math_reasoning", "About 53,000 mathematics problems chosen for reinforcement learning", "unknown", "unknown", "medium", _EN, ("math", "reasoning")),
    Entry("tulu3_sft", "allenai/tulu-3-sft-mixture", "default", "chats", "chat", "instruction_following", "Chats from many sources, mixed for supervised fine-tuning", "apache-2.0", "unknown", "mixed", _EN, ("chat", "instruction")),
    Entry("no_robots", "HuggingFaceH4/no_robots", "default", "chats", "chat", "instruction_following", "Instructions and answers that people wrote", "apache-2.0", "unknown", "mixed", _EN, ("chat", "instruction")),
    Entry("hh_rlhf", "Anthropic/hh-rlhf", "default", "preferences", "preference", "preference_modeling", "Pairs of replies, one of which people found more helpful or harmless", "unknown", "unknown", "mixed", _EN, ("preference", "rlhf")),
    Entry("helpsteer3", "nvidia/HelpSteer3", "preference", "preferences", "preference", "preference_modeling", "Pairs of replies with graded preferences, in several fields and languages", "unknown", "unknown", "mixed", _EN, ("preference",)),
    Entry("helpsteer2", "nvidia/HelpSteer2", "default", "preferences", "preference", "preference_modeling", "Replies rated for helpfulness and other traits", "unknown", "unknown", "mixed", _EN, ("preference",)),
    Entry("ultrafeedback", "argilla/ultrafeedback-binarized-preferences", "default", "preferences", "preference", "preference_modeling", "Pairs of replies that a model's ratings have ranked", "unknown", "unknown", "mixed", _EN, ("preference",)),
    Entry("arena_140k", "lmarena-ai/arena-human-preference-140k", "default", "preferences", "preference", "preference_modeling", "Votes of visitors between the replies of two unnamed models", "unknown", "unknown", "mixed", _EN, ("preference",)),
    Entry("tulu3_preference", "allenai/llama-3.1-tulu-3-8b-preference-mixture", "default", "preferences", "preference", "preference_modeling", "Pairs of chosen and rejected replies, mixed for preference tuning", "unknown", "unknown", "mixed", _EN, ("preference",)),
    Entry("deepcoder", "agentica-org/DeepCoder-Preview-Dataset", "default", "code_tasks", "code", "code_generation", "Programming tasks with tests, for reinforcement learning", "unknown", "unknown", "mixed", ("code",), ("code", "generation")),
    Entry("open_thoughts3", "open-thoughts/OpenThoughts3-1.2M", "default", "reasoning", "reasoning", "chain_of_thought", "Questions with long worked-out thoughts before the answer", "unknown", "unknown", "mixed", _EN, ("reasoning", "chain_of_thought")),
    Entry("deepmath_reasoning", "zwhe99/DeepMath-103K", "default", "reasoning", "reasoning", "chain_of_thought", "The hard mathematics problems with their worked-out thoughts", "unknown", "unknown", "mixed", _EN, ("reasoning", "math")),
    Entry("feedback_collection", "prometheus-eval/Feedback-Collection", "default", "rubrics", "rubric_evaluation", "rubric_grading", "Answers graded from one to five against a written rubric", "apache-2.0", "unknown", "mixed", _EN, ("rubric", "evaluation")),
    Entry("caltech101", "dpdl-benchmark/caltech101", "default", "images", "vision", "image_classification", "Photographs of objects in 101 classes", "unknown", "unknown", "medium", (), ("vision", "image_classification")),
    Entry("oxford_flowers102", "dpdl-benchmark/oxford_flowers102", "default", "images", "vision", "image_classification", "Photographs of flowers of 102 species", "unknown", "unknown", "medium", (), ("vision", "image_classification")),
    Entry("oxford_iiit_pet", "dpdl-benchmark/oxford_iiit_pet", "default", "images", "vision", "image_classification", "Photographs of cats and dogs of 37 breeds", "unknown", "unknown", "medium", (), ("vision", "image_classification")),
    Entry("stanford_cars", "tanganke/stanford_cars", "default", "images", "vision", "image_classification", "Photographs of cars by make, model and year", "unknown", "unknown", "medium", (), ("vision", "image_classification")),
]
BY_NAME = {e.name: e for e in ENTRIES}


def _where(test: Callable[[Entry], bool]) -> list[Entry]:
    return sorted(filter(test, ENTRIES), key=lambda e: e.name)


def list_available() -> list[str]:
    return sorted(BY_NAME)


def get_metadata(name: str) -> Entry:
    if name not in BY_NAME:
        raise KeyError(f"unknown dataset: {name}")
    return BY_NAME[name]


def list_by_domain(domain: str) -> list[str]:
    return [e.name for e in _where(lambda e: e.domain == domain)]


def list_by_task_type(task_type: str) -> list[str]:
    return [e.name for e in _where(lambda e: e.task_type == task_type)]


def list_by_difficulty(difficulty: str) -> list[str]:
    return [e.name for e in _where(lambda e: e.difficulty == difficulty)]


def list_by_tag(tag: str) -> list[str]:
    return [e.name for e in _where(lambda e: tag in e.tags)]


def search(text: str) -> list[str]:
    return [e.name for e in _where(lambda e: text.lower() in e.description.lower())]


def all_metadata() -> list[Entry]:
    return _where(lambda e: True)


def available(name: str) -> bool:
    return name in BY_NAME


def of_shape(shape: str) -> list[str]:
    """Names of a family."""
    return [e.name for e in _where(lambda e: e.shape == shape)]


def stats() -> dict:
    count = lambda f: dict(sorted(Counter(getattr(e, f) for e in ENTRIES).items()))
    return {"total": len(ENTRIES), **{f: count(f) for f in ("domain", "task_type", "difficulty")}, "tags": sorted({t for e in ENTRIES for t in e.tags}), "languages": sorted({x for e in ENTRIES for x in e.languages})}


def summary() -> str:
    s = stats()
    return "\n".join([f"{s['total']} datasets", *[f"  {k}: {n}" for k, n in s["domain"].items()]])


def as_frame(spark: SparkSession) -> DataFrame:
    """The catalogue as a table."""
    rows = [{**asdict(e), "languages": list(e.languages), "tags": list(e.tags), "source_url": e.source_url} for e in all_metadata()]
    text = ("name", "repo", "config", "shape", "domain", "task_type", "description", "license", "citation", "difficulty", "source_url")
    return spark.createDataFrame(rows, ", ".join(f"{c} string" for c in text) + ", languages array<string>, tags array<string>, num_items long")
