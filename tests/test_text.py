from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from gradeflow.functions import formats, numbers, prompts, text
from gradeflow.operators import grading


def one(spark, value, use):
    row = spark.createDataFrame([(value,)], "x string").select(use(F.col("x")).alias("y")).first()
    return row.y


@pytest.mark.parametrize(
    ("trace", "spans"),
    [
        (r"\boxed{\frac{1}{2}}", [r"\frac{1}{2}"]), (r"\boxed{\boxed{5}}", [r"\boxed{5}", "5"]), (r"\boxed{7", []), ("", []), (r"\BOXED{a} \boxed{b}", ["a", "b"]), (r"\boxed{x} {\boxed{y}", ["x", "y"]),
        (r"\boxed{" + "{" * 12 + "z" + "}" * 12 + "}", ["{" * 12 + "z" + "}" * 12]), (r"\boxed{a}}}}} \boxed{{}", ["a"]), (r"\boxed{\boxed{1} \boxed{2", ["1"]),
    ],
)
def test_boxed_spans(spark, trace, spans):
    assert one(spark, trace, text.boxed_spans) == spans
    assert one(spark, trace, text._deep_spans) == spans


@pytest.mark.parametrize(("raw", "out"), [('"1,234$"', "1234"), ("answer:  3   apples", "3 apples"), (" a \n\t b ", "a b"), ("5\\\\", "5")])
def test_normalize(spark, raw, out):
    assert one(spark, raw, text.normalize_answer) == out


@pytest.mark.parametrize(("raw", "out"), [(r"5\text{ cm}", "5"), (r"5\mbox{ cm", "5"), (r"5\MATHRM{kg}", "5")])
def test_units(spark, raw, out):
    assert one(spark, raw, text.strip_units) == out


@pytest.mark.parametrize(
    ("raw", "out"),
    [(r"\boxed{3} then \boxed{ANSWER}", "3"), (r"\boxed{\text{cm}} = 4", None), (None, None), ("", None), ("so the answer is 12 = 42. ", "42"), ("= 42 apples", None), (r"\boxed{7", None), (r"\boxed{answer} = 3", "3")],
)
def test_extract(spark, raw, out):
    assert one(spark, raw, text.extract_answer) == out


def test_variants_and_tails(spark):
    forced = "work\n\n**Final Answer**\n\\[\\boxed{5}"
    assert one(spark, forced, text.trace_variants) == [forced, "work", "5}"]
    assert one(spark, "plain", text.trace_variants) == ["plain"]
    assert one(spark, forced, text.final_answer_tail) == "**Final Answer**\n\\[\\boxed{5}"
    assert one(spark, None, text.final_answer_tail) == ""
    assert one(spark, "a #### 1 #### 2", lambda x: text.gold_answer(x, F.lit(""))) == "2"
    assert one(spark, "<pad> <pad><s>x</s><pad></s>", lambda x: text.clean_special(x, "<s>", "</s>", "<pad>")) == "x</s>"
    assert one(spark, "q<A>t</think>u", lambda x: text.close_thinking(x, "<A>", "!")) == "q<A>t</think>u!"
    assert one(spark, "q</think><A>t", lambda x: text.close_thinking(x, "<A>", "!")) == "q</think><A>t\n</think>!"


@pytest.mark.parametrize(("a", "b", "same"), [("1/2", "0.5", True), (r"\frac{1}{2}", "50%", True), (r"-\frac{1}{2}", "-0.5", True), ("x", "x", True), ("x", "y", False), ("1/0", "1", False), (None, "1", False), ("3.0", "3", True),
    (r"2\sqrt{3}", r"\sqrt{12}", True), (r"\frac{\sqrt{3}}{2}", r"\sqrt{0.75}", True), (r"1\frac{1}{2}", "1.5", True), ("-1 1/2", "-1.5", True), (r"\frac{\pi}{3}", r"2\pi/6", True), (r"2\pi", "6.28", False), ("1.5e3", "1500", True),
    (r"1.5 \times 10^{-3}", "0.0015", True), (r"12\%", "0.12", True), (r"\dfrac{-3}{4}", "-.75", True), ("(1 2)", "(1 2)", True), ("(1 2)", "(1 3)", False), (r"\sqrt{2}", "1.41421356", False), ("", "0", False), ("-", "0", False), ("/2", "0.5", False), (r"\frac{x}{2}", r"\frac{x}{2}", True), (r"\frac{x}{2}", "1/2", False)])
def test_same_answer(spark, a, b, same):
    assert spark.createDataFrame([(a, b)], "a string, b string").select(grading.same_answer(F.col("a"), F.col("b")).alias("y")).first().y is same


def test_formats(spark):
    of = lambda x, use: spark.createDataFrame([(float(x),)], "x double").select(use(F.col("x")).alias("y")).first().y
    assert [of(x, formats.percent) for x in (12.5, 12.0, 100.0, 0.0)] == ["12.5%", "12%", "100%", "0%"]
    assert [of(x, formats.duration) for x in (59.94, 61, 3661)] == ["59.9s", "1m 1s", "1h 1m 1s"]
    assert of(0.03125, formats.four_places) == "0.0312"
    assert math.isclose(of(100.0, lambda x: numbers.penalty(x, "exp")), math.exp(10))
    assert math.isclose(of(3.0, lambda x: numbers.penalty(x, "softplus")), math.log1p(math.exp(3)))
    with pytest.raises(ValueError):
        numbers.penalty(F.lit(1.0), "cube")


def test_prompts(spark):
    row = spark.createDataFrame([(" p ",)], "x string").select(prompts.prompt_messages(F.col("x")).alias("m"), prompts.render_chat(prompts.prompt_messages(F.col("x"), "s"), generate=True).alias("r")).first()
    assert [m.role for m in row.m] == ["system", "user"]
    assert row.m[1].content == "p\n"
    assert row.r == "<|system|>\ns<|end|>\n<|user|>\np<|end|>\n<|assistant|>\n"


@pytest.mark.parametrize(("raw", "out"), [(r"5\text{ cm}\mbox{ a", "5"), (r"5 \te\mbox{}xt{cm}", r"5 \text{cm}"), (r"5\TEXT{a}", "5"), (r"\frac{1}{2}\mathrm{m} ", r"\frac{1}{2}"), (" 5 ", "5"), ("", ""), (None, None)])
def test_units_are_stripped_kind_after_kind(spark, raw, out):
    assert one(spark, raw, text.strip_units) == out
