"""ChatML text and prompt cuts."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# ChatML delimiters and the boundary between causal prompt and answer.
TURN_START = "<|im_start|>"
TURN_END = "<|im_end|>\n"
OUTPUT_MARKER = "\n\n### Output:\n"
PROMPT_CUT = "### Output:\n"


def chat_turn(role: Column, content: Column) -> Column:
    return F.concat(F.lit(TURN_START), role, F.lit("\n"), content, F.lit(TURN_END))


def open_turn(role: str = "assistant") -> Column:
    """The start of a turn the generator is to continue."""
    return F.lit(f"{TURN_START}{role}\n")


def render_messages(messages: Column, generation_prompt: bool = False) -> Column:
    """``array<struct<role, content>>`` of any length as one ChatML string."""
    text = F.array_join(F.transform(messages, lambda m: chat_turn(m["role"], m["content"])), "")
    return F.concat(text, open_turn()) if generation_prompt else text


def chat_full(system: Column, user: Column, assistant: Column) -> Column:
    return F.concat(
        chat_turn(F.lit("system"), system),
        chat_turn(F.lit("user"), user),
        chat_turn(F.lit("assistant"), assistant),
    )


def chat_prompt(system: Column, user: Column) -> Column:
    return F.concat(chat_turn(F.lit("system"), system), chat_turn(F.lit("user"), user), open_turn())


def causal_prompt(text: Column) -> Column:
    """Everything up to the first output boundary, boundary included."""
    return F.concat(F.substring_index(text, PROMPT_CUT, 1), F.lit(PROMPT_CUT))
