from __future__ import annotations

import time
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from gradeflow.functions import algebra, text
from gradeflow.operators import grading

EQUAL = [
    ('2x+1', '1+2x'), ('1+\\sqrt{2}', '\\sqrt{2}+1'), ('2^3', '8'), ('\\frac12', '1/2'), ('\\{1,2\\}', '\\{2,1\\}'), ('1,234', '1234'), ('\\sqrt{8}', '2\\sqrt2'),
    ('\\frac{\\sqrt3}{3}', '\\frac{1}{\\sqrt{3}}'), ('(x+1)^2', 'x^2+2x+1'), ('90^\\circ', '90'), ('2\\frac{1}{2}', '2.5'), ('-3 1/4', '-13/4'), ('\\frac{2\\pi}{4}', '\\pi/2'),
    ('50\\%', '0.5'), ('5\\times 10^{3}', '5000'), ('x=5', '5'), ('1,2', '2, 1'), ('(1,2)\\cup(3,4)', '(3,4)\\cup(1,2)'), ('(1/2, 3)', '(0.5,3)'), ('[0,\\infty)', '[0, \\infty)'),
    ('\\sqrt{16}', '4'), ('i^2', '-1'), ('xy+2', '2+yx'), ('\\sqrt[3]{27}', '3'), ('\\sqrt{2}\\sqrt{3}', '\\sqrt{6}'), ('x=y+1', 'y+1=x'), ('\\frac{x^2-1}{x-1}', 'x+1'), ('3!', '6'),
    ('\\sin(0)', '0'), ('\\ln{x^2}', '2\\ln x'), ('2^{10}', '1024'), ('\\left(1,\\frac{1}{2}\\right)', '(1,.5)'), ('10{,}000', '10000'), ('\\sqrt{-4}', '2i'), ('1e3', '1000'),
    ('-(-3)', '3'), ('2(x+1)', '2x+2'), ('\\dfrac{3}{4}', '0.75'), ('x^{-1}', '\\frac1x'), ('$5', '5'), ('\\sqrt{3+2\\sqrt{2}}', '1+\\sqrt2'), ('4^{1/2}', '2'), ('Tuesday', 'Tuesday'),
]

UNEQUAL = [
    ('1000000001', '1000000000'), ('123456789012345', '123456789012346'), ('0.0000000001', '0'), ('(1,2)', '(12)'), ('12', '1,2'), ('[1,2)', '(1,2]'), ('(1,2)', '(2,1)'), ('2x+1', '2x+2'),
    ('east', 'seat'), ('1/3', '0.3333'), ('\\sqrt2', '1.41421356237309'), ('(1,2)', '\\{1,2\\}'), ('1,2', '1,3'), ('x', 'y'), ('5 apples', '5'), ('xy', 'yx2'), ('\\pi', '3.14159265358979'),
    ('2^{x}', 'x^2'), ('[0,\\infty)', '[0,1)'), ('3', '-3'), ('1,2,2', '1,2,3'), ('1234', '1,2,3,4'), ('12,34', '1234'), ('x=5', '6'), ('no', 'on'), ('10^{-30}', '0'), ('1+10^{-50}', '1'),
]


def test_equal_and_unequal_answers():
    for a, b in EQUAL:
        assert algebra.same(a, b) and algebra.same(b, a), (a, b)
    for a, b in UNEQUAL:
        assert not algebra.same(a, b) and not algebra.same(b, a), (a, b)
    forms = sorted({x for pair in EQUAL for x in pair})
    assert all(algebra.same(x, x) for x in forms)


def test_grades_of_the_same_pairs(spark):
    """Through columns: what they decide themselves and what goes to the typed comparison."""
    rows = [(a, b, True) for a, b in EQUAL] + [(b, a, False) for a, b in UNEQUAL]
    df = spark.createDataFrame([(n, f"so \\boxed{{{a}}}", b, want) for n, (a, b, want) in enumerate(rows)], "n int, trace string, gold string, want boolean")
    out = grading.is_correct(grading.grade(df, "trace", "gold", "x"), "trace", "gold", "plain").collect()
    assert [(r.trace, r.gold) for r in out if r.x_correct != r.want or r.plain != r.want] == []
    assert grading.grade(df.withColumn("trace", F.lit(None).cast("string")), "trace", "gold", "x").filter("x_correct is null").count() == len(rows)


@pytest.mark.parametrize(
    ("answer", "kind", "brackets", "parts"),
    [("(1,2)", "tuple", "()", ["1", "2"]), ("[1,2)", "interval", "[)", ["1", "2"]), (r"\{1, (2,3)\}", "set", "{}", ["1", "(2,3)"]), ("1,2", "set", "", ["1", "2"]), ("1,234", "number", "", ["1234"]), ("x=2", "relation", "=", ["x", "2"]),
     (r"(1,2)\cup[3,4]", "union", "", ["(1,2)", "[3,4]"]), ("Monday", "text", "", ["Monday"]), (r"\{\}", "set", "{}", []), ("", "text", "", [""]), ("(12)", "number", "", ["(12)"]), ("1,23", "set", "", ["1", "23"])],
)
def test_typed_answers(spark, answer, kind, brackets, parts):
    assert algebra.typed(answer) == algebra.Answer(kind, brackets, tuple(parts))
    row = spark.createDataFrame([(answer,)], "a string").select(algebra.answer_type(F.col("a")).alias("t")).first().t
    assert (row.kind, row.brackets, list(row.parts)) == (kind, brackets, parts)


def test_random_ratios_are_compared_exactly(spark):
    import random

    rng = random.Random(6)
    ratio = lambda: (rng.randint(-20, 20), rng.randint(1, 12))
    pairs = [(ratio(), ratio()) for _ in range(400)]
    df = spark.createDataFrame([(f"{n}/{d}", f"{m}/{e}", n * e == m * d) for (n, d), (m, e) in pairs], "a string, b string, want boolean")
    assert df.filter(grading.same_answer(F.col("a"), F.col("b")) != F.col("want")).count() == 0
    for (n, d), (m, e) in pairs:
        assert algebra.same(rf"\frac{{{n}}}{{{d}}}", f"{m}/{e}") == (Fraction(n, d) == Fraction(m, e))


def test_long_answers_end(spark):
    for x in ("(" * 5000, "1" * 100_000, "2^" * 3000 + "2", "{" * 3000 + "1" + "}" * 3000, "1," * 20_000 + "1", "9^{9^{9^9}}", "\\sqrt" * 1000 + "2", "-" * 5000 + "1", "\\frac" * 2000, "10^{10^{10}}\\sqrt{2}"):
        began = time.perf_counter()
        assert algebra.same(x, x) in (True, False)
        assert time.perf_counter() - began < 5, x[:20]


def test_many_boxes_take_linear_time(spark):
    def seconds(n):
        trace = "".join(f"\\boxed{{a{{{k}}}}} " for k in range(n))
        df = spark.createDataFrame([(trace,)], "t string")
        began = time.perf_counter()
        spans = df.select(text.boxed_spans(F.col("t")).alias("s")).first().s
        assert spans == [f"a{{{k}}}" for k in range(n)]
        return time.perf_counter() - began

    seconds(10)
    assert seconds(20_000) < 5
    assert text.closed_boxes("\\boxed{" * 3000 + "x" + "}" * 3000)[-1] == "x"


@pytest.mark.parametrize("most", [0, grading.BROADCAST_BYTES])
def test_each_pair_of_texts_is_compared_once(spark, monkeypatch, most):
    """However many rows have it, with and without a broadcast of the compared pairs."""
    pairs = [("\\frac12", "0.5", True, True), ("\\sqrt8", "2\\sqrt2", True, True), ("x", "5", False, False), ("5", "5", True, True), (None, "5", False, False), ("5", None, False, False), (None, None, False, False)]
    df = spark.createDataFrame(pairs * 300, "a string, b string, want boolean, want_turned boolean")
    judged, written = [], grading.scratch.written
    monkeypatch.setattr(grading.scratch, "written", lambda rows, name: judged.append(out := written(rows, name)) or out)
    monkeypatch.setattr(grading, "BROADCAST_BYTES", most)
    out = grading.with_same(df, "a", "b", "equal", "turned")
    assert out.columns == [*df.columns, "equal", "turned"]
    assert out.count() == len(pairs) * 300
    assert out.filter("equal is distinct from want or turned is distinct from want_turned").count() == 0
    assert [x.count() for x in judged] == [4]


@pytest.mark.parametrize("name", ["q_algebra", "q_answer_equality"])
def test_queries_of_answers_compare_each_pair_once(spark, data, monkeypatch, name):
    import __spark_entry__ as registered

    judged, written = [], grading.scratch.written
    monkeypatch.setattr(grading.scratch, "written", lambda rows, name: judged.append(out := written(rows, name)) or out)
    registered.queries()[name](spark, data)
    assert judged and all(x.count() == x.select("_a", "_b").distinct().count() for x in judged)
