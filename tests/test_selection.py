from __future__ import annotations

import math
import random
import struct

import pytest
from pyspark.sql import functions as F

from gradeflow.functions.numbers import ordered_bits
from gradeflow.operators import metrics, selection


def real_bits(x):
    if math.isnan(x):
        return (2047 << 52) + 1
    b = struct.unpack("<q", struct.pack("<d", abs(x)))[0]
    return -b if x < 0 else b


def test_ordered_bits_are_those_of_the_double(spark):
    rng = random.Random(2)
    xs = [0.0, -0.0, 1.0, -1.0, 0.1, 1e308, -1e308, 5e-324, -5e-324, 2.0**-1022, 2.0**-1022 - 5e-324, 2.0**1023, math.inf, -math.inf, math.nan, math.nextafter(1, 2), math.nextafter(2, 1), math.nextafter(8, 0)]
    xs += [struct.unpack("<d", struct.pack("<Q", rng.getrandbits(64)))[0] for _ in range(3000)] + [rng.uniform(-5, 5) for _ in range(1000)] + [math.nextafter(2.0**k, 0) for k in range(-1060, 1020, 7)]
    rows = spark.createDataFrame([(x,) for x in xs], "x double").select("x", ordered_bits(F.col("x")).alias("b")).collect()
    assert all(r.b == real_bits(r.x) for r in rows)
    assert spark.range(1).select(ordered_bits(F.lit(None).cast("double"))).first()[0] is None


def plain_top(rows, k):
    """rows: (key, value, item) -> the first k of each key by value descending, item ascending in UTF-8 order."""
    out = {}
    for key, value, item in rows:
        out.setdefault(key, []).append((-value, item.encode()))
    return {(key, i.decode(), n) for key, xs in out.items() for n, (_, i) in enumerate(sorted(xs)[:k], 1)}


@pytest.mark.parametrize("small", [1, 10_000])
def test_first_rows_equal_a_full_sort(spark, small):
    rng = random.Random(small)
    rows = [("many", rng.choice([7, 7, 7, 1 << 29, 3]), "".join(rng.choice(["a", "b", "é", "z", "中"]) for _ in range(rng.randint(0, 5))) + f"-{n}") for n in range(300)]
    rows += [("few", 5, "x"), ("few", 5, "xa"), (None, 1, "n"), (None, 1, "m"), (None, 0, "o"), ("tied", 9, "")] + [("tied", 9, "prefix-" + c * 3) for c in "qwertzuiop"]
    df = selection.written(spark.createDataFrame(rows, "k string, v long, item string").repartition(4), "t")
    digits = lambda: [*selection.long_digits(F.col("v"), 30, 10, True), *(d for d, _ in zip(selection.byte_digits(F.col("item")), range(4), strict=False))]
    for k in (3,) if small == 1 else (3, 1000):
        out = selection.first_rows(df, ["k"], k, digits(), [F.desc("v"), F.asc("item")], small=small)
        assert {(r.k, r.item, r.place) for r in out.collect()} == plain_top(rows, k)
        assert out.columns == ["k", "v", "item", "place"]
    assert selection.first_rows(df, ["k"], 0, digits(), [F.desc("v")]).count() == 0
    assert selection.first_rows(df.limit(0), ["k"], 3, digits(), [F.desc("v"), F.asc("item")]).count() == 0


def plain_mass(xs, share=0.2):
    k = max(1, math.floor(len(xs) * share))
    return sum(sorted(xs, reverse=True)[:k]) / max(sum(xs), 1e-12)


@pytest.mark.parametrize("small", [20])
def test_top_mass_with_outliers_and_ties(spark, small):
    rng = random.Random(1)
    groups = {
        "outlier": [rng.random() for _ in range(400)] + [1e12], "half": [2.0] * 300 + [rng.random() * 4 for _ in range(300)], "equal": [0.3] * 100, "one": [5.0], "signs": [rng.gauss(0, 1) for _ in range(200)],
        "steps": [float(rng.randint(0, 3)) for _ in range(500)], "tiny": [rng.random() * 1e-310 for _ in range(90)] + [1e-300],
    }
    rows = [(k, x, n) for k, xs in groups.items() for n, x in enumerate(xs)] + [("half", None, 999)]
    df = spark.createDataFrame(rows, "k string, x double, i long")
    out = {r.k: r for r in metrics.moments_and_mass(df, ["k"], "x", "i", small=small).collect()}
    assert set(out) == set(groups)
    for k, xs in groups.items():
        assert out[k].n == len(xs) and out[k].top_mass == pytest.approx(plain_mass(xs), rel=1e-9), k
        assert out[k]["mean"] == pytest.approx(sum(xs) / len(xs))


def test_cells_are_small(spark):
    """An outlier and ties leave no cell of more rows than asked for, unless all its values are equal."""
    df = spark.range(20_000).select(F.lit("g").alias("k"), F.when(F.col("id") == 7, 1e12).when(F.col("id") % 2 == 0, 1.0).otherwise(1 + F.rand(3) * 1e-6).alias("x"), "id")
    df = selection.written(df, "t")
    cuts, digits = selection.find_cuts(df, ["k"], lambda n: F.floor(n * 0.3), selection.number_digits(F.col("x"), descending=True), measure="x", small=100)
    one = cuts.first()
    assert one["_cell"] <= 100 and one["_n"] == 20_000 and len(digits) > 1
    cuts, _ = selection.find_cuts(df, ["k"], lambda n: F.floor(n * 0.8), selection.number_digits(F.col("x"), descending=True), measure="x", small=100)
    one = cuts.first()
    assert one["_cell"] == 10_000 - 0 or one["_cell"] > 100  # the equal half
    assert selection.in_cell(df, cuts, ["k"], selection.number_digits(F.col("x"), descending=True)).select("x").distinct().count() == 1
