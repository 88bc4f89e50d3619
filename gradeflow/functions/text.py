"""Answers in reasoning traces: boxed spans, normal form, fallbacks, variants. All are Column -> Column."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Patterns and markers that results depend on.
BOX = r"\boxed{"
NUMBER_AT_END = r"(?i)(?:answer is|=\s*)\s*([-+]?\d+(?:\.\d+)?)\s*[.\s]*$"
PLACEHOLDER = "ANSWER"
UNIT_COMMANDS = ("text", "mbox", "mathrm")
FORCE_MARKERS = ("\n\n**Final Answer**\n\\boxed{", "\n\n**Final Answer**\n\\[\\boxed{")
FINAL_MARKER = "**Final Answer**"
FORCE_SUFFIX = "\n\n**Final Answer**\n\\[\\boxed{"
THINK_END = "</think>"
GOLD_MARK = "####"


def strip(x: Column) -> Column:
    """Without white space (of any script) at either end."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def bind(x: Column, use: Callable[[Column], Column]) -> Column:
    """``use(x)`` with ``x`` worked out once: inside a lambda a repeated expression would be worked out again."""
    return F.get(F.transform(F.array(x), use), F.lit(0))


def kept(x: Column) -> Column:
    """``x`` as a column that doesn't count as deterministic: the optimizer copies an expression to every place where it is used together
    with a Python function, however dear it is, but not such a one."""
    return F.when(F.monotonically_increasing_id() >= 0, x)


def _inside(depth: int) -> str:
    """Pattern of text whose braces are balanced, up to a depth; nothing is tried twice."""
    return r"[^{}]*+" + (rf"(?:\{{{_inside(depth - 1)}\}}[^{{}}]*+)*+" if depth else "")


#: Depth of braces that the pattern of a box follows; texts with boxes that it doesn't close take the general way.
DEPTH = 8
BRACE = re.compile(r"\\boxed\{|[{}]", re.IGNORECASE)


def boxed_spans(text: Column) -> Column:
    """Contents of all closed ``\\boxed{...}`` in order of their starts, nested ones too."""
    # the content is looked ahead at, so the next search starts inside it
    quick = F.regexp_extract_all(text, F.lit(rf"(?i)(?=\\boxed\{{({_inside(DEPTH)})\}})\\boxed\{{"), 1)
    braces = F.length(text) - F.length(F.replace(text, F.lit("{"), F.lit("")))
    deep = (braces > DEPTH + 1) & (F.regexp_count(text, F.lit(r"(?i)\\boxed\{")) > F.size(quick))
    return F.coalesce(_deep_spans(F.when(deep, text)), quick)


def closed_boxes(text: str) -> list[str]:
    """The same for any depth, in one pass with a stack of open braces."""
    stack, spans = [], []
    for m in BRACE.finditer(text):
        if m[0] != "}":
            stack.append((m.end(), len(m[0]) > 1))
        elif stack and (opened := stack.pop())[1]:
            spans.append((opened[0], m.start()))
    return [text[a:b] for a, b in sorted(spans)]


@F.arrow_udf(T.ArrayType(T.StringType()))
def _deep_spans(texts: pa.Array) -> pa.Array:
    """``closed_boxes`` of the texts that the pattern doesn't serve; null for the others, which stay in the JVM."""
    out: list[list[str] | None] = [None] * len(texts)
    for k in np.flatnonzero(np.asarray(texts.is_valid())):
        out[k] = closed_boxes(texts[k].as_py())
    return pa.array(out, pa.list_(pa.string()))


def has_complete_box(text: Column) -> Column:
    """Whether any box is closed."""
    return F.size(boxed_spans(text)) > 0


# The patterns in the next two functions.
def normalize_answer(s: Column) -> Column:
    """Without outer quotes, trailing backslashes, dollar signs, commas and a leading "answer:"; single blanks."""
    s = F.regexp_replace(strip(s), r"""^['"]+|['"]+$""", "")
    s = F.regexp_replace(s, r"\\+$", "")
    s = F.regexp_replace(s, "[$,]", "")
    s = F.regexp_replace(s, r"(?i)^\s*answer\s*:\s*", "")
    return F.trim(F.regexp_replace(s, r"(?U)\s+", " "))


def strip_units(s: Column) -> Column:
    """Without unit commands: closed ones of each kind first, then those left open to the end. Without a backslash there is none to look for."""

    def without(x: Column, tail: str) -> Column:
        out = x
        for command in UNIT_COMMANDS:
            out = F.regexp_replace(out, rf"(?i)\\{command}\{{[^}}]*{tail}", "")
        return F.when(F.contains(x, F.lit("\\")), out).otherwise(x)

    return strip(bind(bind(s, lambda x: without(x, r"\}")), lambda x: without(x, "$")))


def numeric_fallback(text: Column) -> Column:
    """The number after "answer is" or "=" at the end of the text; null if there is none."""
    return bind(F.regexp_extract(text, NUMBER_AT_END, 1), lambda n: F.when(n != "", normalize_answer(n)))


def is_placeholder(span: Column) -> Column:
    """Whether a span's normal form is the placeholder; that form is made only where the letters allow it, and not where they are all there is."""
    may = F.contains(F.upper(F.translate(span, "$,", "")), F.lit(PLACEHOLDER))
    return F.when(F.upper(span) == PLACEHOLDER, F.lit(True)).when(may, F.upper(normalize_answer(span)) == PLACEHOLDER).otherwise(F.lit(False))


def real_spans(spans: Column) -> Column:
    """Spans that aren't the placeholder."""
    return F.filter(spans, lambda s: ~is_placeholder(s))


#: Texts of these characters alone are their own normal form and have no units.
SIMPLE = r"^[0-9A-Za-z.+/(){}^_=*<>|-]+$"


def without_units(span: Column) -> Column:
    """Normal form without units; null if nothing is left. What isn't simple is worked out in a lambda: once, and out of the compiled code."""
    full = bind(span, lambda s: bind(normalize_answer(strip_units(normalize_answer(s))), lambda a: F.when(a != "", a)))
    return F.when(F.regexp_like(span, F.lit(SIMPLE)), span).otherwise(full)


def comparable(s: Column) -> Column:
    """An answer as it is compared: without units, outer quotes, trailing backslashes and a leading "answer:"; commas stay, since they may part it."""
    whole = lambda x: F.regexp_replace(F.regexp_replace(strip_units(x), r"""^['"]+|['"]+$""", ""), r"(?i)^\s*answer\s*:\s*", "")
    return F.when(F.regexp_like(s, F.lit(SIMPLE)), s).otherwise(bind(s, lambda x: F.trim(F.regexp_replace(whole(x), r"\\+$", ""))))


def given_answer(text: Column, real: Column) -> Column:
    """Last of the real spans as it stands, or else the number at the end of the text."""
    return F.when(F.length(text) > 0, F.when(F.size(real) > 0, F.get(real, F.size(real) - 1)).otherwise(numeric_fallback(text)))


def answer_of(text: Column, real: Column) -> Column:
    """Last of the real spans, without units (null if nothing is left); where there is none, the number at the end of the text."""
    return F.when(F.length(text) > 0, F.when(F.size(real) > 0, without_units(F.get(real, F.size(real) - 1))).otherwise(numeric_fallback(text)))


def extract_answer(text: Column) -> Column:
    """Content of the last box that isn't the placeholder, without units (null if nothing is left); without such a box the number at the end."""
    return bind(real_spans(boxed_spans(text)), lambda real: answer_of(text, real))


def with_answer(df: DataFrame, text: Column, out: str | None, spans: str | None = None, given: str | None = None, found: str | None = None) -> DataFrame:
    """``df`` with the answer in a text (``out``), all its boxes (``spans``), and the answer as it is compared (``given``), as far as they are named.

    Spans are found once, in a column of their own, unless they are there already (``found``).
    """
    own = ["_own_spans", "_own_real", "_own_given"]
    rows = df if found else df.withColumn(spans or own[0], kept(boxed_spans(text)))
    rows = rows.withColumn(own[1], real_spans(F.col(found or spans or own[0])))
    if out:
        rows = rows.withColumn(out, answer_of(text, F.col(own[1])))
    if given:
        rows = rows.withColumn(own[2], given_answer(text, F.col(own[1]))).withColumn(given, comparable(F.col(own[2])))
    return rows.drop(*own)


def trace_variants(trace: Column) -> Column:
    """The trace, and, around the last of the first kind of forcing marker that it has, what is before and after."""
    out = F.array(trace)
    for marker in reversed(FORCE_MARKERS):
        after = F.substring_index(trace, marker, -1)
        before = F.substring(trace, F.lit(1), F.length(trace) - F.length(after) - len(marker))
        out = F.when(F.contains(trace, F.lit(marker)), F.array(trace, before, after)).otherwise(out)
    return out


def without_prefix(text: Column, prefix: Column) -> Column:
    """Stripped text after a prefix that it may have."""
    return strip(F.when(F.startswith(text, prefix), F.substring(text, F.length(prefix) + 1, F.length(text))).otherwise(text))


def final_answer_tail(tail: Column) -> Column:
    """From the first final-answer marker on; the whole tail without one; null is empty."""
    at = F.instr(tail, FINAL_MARKER)
    return F.coalesce(strip(F.when(at > 0, F.substring(tail, at, F.length(tail))).otherwise(tail)), F.lit(""))


def gold_answer(solution: Column, absent: Column) -> Column:
    """Stripped text after the last gold mark; ``absent`` if there is none."""
    return F.when(F.contains(solution, F.lit(GOLD_MARK)), strip(F.substring_index(solution, GOLD_MARK, -1))).otherwise(absent)


def close_thinking(text: Column, response_mark: str, suffix: str = FORCE_SUFFIX) -> Column:
    """Text with the thinking tag closed after the last response mark, then the suffix."""
    after = F.when(F.contains(text, F.lit(response_mark)), F.substring_index(text, response_mark, -1)).otherwise(F.lit(""))
    return F.concat(text, F.when(F.contains(after, F.lit(THINK_END)), F.lit("")).otherwise(F.lit(f"\n{THINK_END}")), F.lit(suffix))


def clean_special(text: Column, bos: str, eos: str, pad: str) -> Column:
    """Without the first begin mark, end marks and padding; one end mark at the end."""
    quoted = lambda t: r"\Q" + t + r"\E"
    begun = F.instr(text, bos)
    text = F.when(begun > 0, F.concat(F.substring(text, F.lit(1), begun - 1), F.substring(text, begun + len(bos), F.length(text)))).otherwise(text)
    text = F.regexp_replace(F.replace(text, F.lit(eos), F.lit("")), rf"(?U)^(?:{quoted(pad)}\s*)+", "")
    return F.concat(F.replace(text, F.lit(pad), F.lit("")), F.lit(eos))
