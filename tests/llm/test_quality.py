from __future__ import annotations

import random

import numpy as np
import pytest

from gradeflow.llm import quality as X


def graded(spark, n=1200):
    """Grades 0 to 3: the better, the fewer filler words."""
    rng = random.Random(1)
    docs, labels = [], []
    for k in range(n):
        g = rng.randrange(4)
        docs.append((k, " ".join(rng.choice(["spam", "win", "CLICK!!"]) if rng.random() < 0.6 - 0.2 * g else rng.choice(["river", "stone", "cloud", "tree"]) for _ in range(80))))
        labels.append((k, g))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([*labels, (3, None), (None, 2)], "doc_id long, grade int")


def test_ordinal(spark):
    docs, labels = graded(spark)
    m = X.learn(docs, labels, "grade")
    assert len(m.thresholds) == 3 and (np.diff(m.thresholds) > 0).all() and m.grades.tolist() == [0, 1, 2, 3]
    got = X.grade(docs, m, tail=2).withColumn("held_out", X.is_held_out()).join(labels, "doc_id").filter("held_out and grade is not null").collect()
    e, g = np.array([r.expected_grade for r in got]), np.array([r.grade for r in got])
    assert np.corrcoef(e, g)[0, 1] > 0.85 and np.abs(e - g).mean() < 0.6
    t = np.array([r.tail_probability for r in got])
    assert ((t > 0.5) == (g >= 2)).mean() > 0.9
    kept = X.select(docs, m, 2, 0.5)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()


def test_probabilities():
    m = X.OrdinalModel(np.zeros(1 << X.FEATURE_BITS), np.array([-1.0, 0.5]), np.array([1.0, 2.0, 5.0]))
    p = m.above(np.array([0.3]))[0]
    each = [1 - p[0], p[0] - p[1], p[1]]
    assert min(each) > 0 and m.expected(np.array([0.3]))[0] == pytest.approx(np.dot(each, [1, 2, 5]))


def test_rows(spark, odd, empty):
    docs, labels = graded(spark, 200)
    m = X.learn(docs, labels, "grade", most=100)
    got = X.grade(odd, m).collect()
    assert len(got) == odd.count() and all(0 <= r.expected_grade <= 3 and 0 <= r.tail_probability <= 1 for r in got)
    assert X.grade(empty, m).count() == 0
    assert {r.expected_grade for r in X.grade(odd, X.learn(docs, labels.limit(0), "grade")).collect()} == {0.0}
    assert {r.expected_grade for r in X.grade(odd, X.learn(docs, labels.filter("grade = 2"), "grade")).collect()} == {2.0}
    assert X.select(odd, m, 1, 0.0).count() == odd.count()
