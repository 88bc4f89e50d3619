"""Chat prompts as arrays of (role, content)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

# Fixed value: the instruction that is put before each problem.
SYSTEM_PROMPT = (
    "You are a math teacher. You will be given a math problem and you will solve it step by step.\n"
    "You will output your final solution like \\boxed{ANSWER}. Be sure to include relevant units within the brackets and fully evaluate arithmetic expressions.\n"
)


def prompt_messages(problem: Column, system: str = SYSTEM_PROMPT) -> Column:
    """A system and a user message."""
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return F.array(message("system", F.lit(system)), message("user", F.concat(strip(problem), F.lit("\n"))))


def render_chat(messages: Column, head: str = "<|{}|>\n", tail: str = "<|end|>\n", generate: bool = False) -> Column:
    """Messages in blocks with a role header; with ``generate`` an open assistant header at the end. Other roles are left out."""
    before, after = head.split("{}")
    known = F.filter(messages, lambda m: m["role"].isin("system", "user", "assistant"))
    text = F.array_join(F.transform(known, lambda m: F.concat(F.lit(before), m["role"], F.lit(after), strip(m["content"]), F.lit(tail))), "")
    return F.concat(text, F.lit(head.format("assistant") if generate else ""))


def judge_message(problem: Column, trace: Column) -> Column:
    """A problem and its trace in two sections."""
    return F.concat(F.lit("## Problem\n"), strip(problem), F.lit("\n\n## Trace\n"), strip(trace), F.lit("\n"))
