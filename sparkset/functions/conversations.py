"""Messages and conversations: ``struct<role, content>`` and ``array<struct<role, content>>`` as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MESSAGES = "array<struct<role:string,content:string>>"
#: Names of roles in public data.
ROLES = {"human": "user", "Human": "user", "gpt": "assistant", "bot": "assistant"}
#: Marks of speakers in dialogues written as text.
SPEAKERS = {"Human": "user", "H": "user", "Assistant": "assistant", "A": "assistant"}
_MARK = r"(?:Human|Assistant|H|A):"


def role(name: Column) -> Column:
    """A role by its usual name; others are kept."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in ROLES.items() for x in kv]), name), name)


def message(role_name: Column, content: Column) -> Column:
    return F.struct(role(role_name).alias("role"), content.alias("content"))


def from_messages(messages: Column, role_field: str = "role", content_field: str = "content") -> Column:
    """A conversation from an array of structs. Null if the array is, or if any message lacks its role or content."""
    whole = F.forall(messages, lambda m: m[role_field].isNotNull() & m[content_field].isNotNull())
    return F.when(whole, F.transform(messages, lambda m: message(m[role_field], m[content_field])))


def from_text(text: Column) -> Column:
    """A conversation from a dialogue with Human: and Assistant: (or H: and A:) before each turn. Null if there is no mark.

    Each mark goes with the text up to the next one; text before the first is left out.
    """
    turns = F.regexp_extract_all(text, F.lit(rf"(?s)\n*{_MARK}.*?(?=\n*{_MARK}|\z)"), F.lit(0))
    speaker = lambda t: F.regexp_extract(t, r"^\n*(Human|Assistant|H|A):", 1)
    body = lambda t: F.regexp_replace(F.regexp_replace(t, rf"^\n*{_MARK}", ""), r"^\s+|\s+$", "")
    roles = F.create_map(*[F.lit(x) for kv in SPEAKERS.items() for x in kv])
    return F.when(F.size(turns) > 0, F.transform(turns, lambda t: F.struct(F.element_at(roles, speaker(t)).alias("role"), body(t).alias("content"))))


def turn_count(conversation: Column) -> Column:
    """Pairs of user and assistant messages."""
    return F.floor(F.size(F.filter(conversation, lambda m: m["role"].isin("user", "assistant"))) / 2).cast("int")


def last_message(conversation: Column) -> Column:
    return F.try_element_at(conversation, F.lit(-1))


def system_prompt(conversation: Column) -> Column:
    """Content of the first system message; null where there is none."""
    return F.get(F.filter(conversation, lambda m: m["role"] == "system"), 0)["content"]


def first_content(conversation: Column, of: str) -> Column:
    """Content of the first message of a role; empty where there is none."""
    return F.coalesce(F.get(F.filter(conversation, lambda m: m["role"] == of), 0)["content"], F.lit(""))


def last_content(conversation: Column, of: str) -> Column:
    return F.coalesce(F.try_element_at(F.filter(conversation, lambda m: m["role"] == of), F.lit(-1))["content"], F.lit(""))


def user_prompt(conversation: Column) -> Column:
    """All user messages, with an empty line between them."""
    return F.array_join(F.transform(F.filter(conversation, lambda m: m["role"] == "user"), lambda m: m["content"]), "\n\n")


def typed_text(parts: Column) -> Column:
    """Texts of an array of ``struct<type, text>``, joined by spaces."""
    return F.array_join(F.transform(F.filter(parts, lambda p: p["type"] == "text"), lambda p: F.coalesce(p["text"], F.lit(""))), " ")


def assemble(df, by: str, order: str, role_col: str = "role", content_col: str = "text"):
    """One row a conversation from one row a message."""
    turns = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), role(F.col(role_col)).alias("role"), F.col(content_col).alias("content"))))
    return df.groupBy(by).agg(F.transform(turns, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages"))
