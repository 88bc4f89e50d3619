from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from gradeflow.functions import numbers
from gradeflow.operators import ordering


@pytest.mark.parametrize("leaf_rows", [1, 2, 40])
def test_positions_of_a_deep_tree(spark, leaf_rows):
    want = {k: i for i, (_, k) in enumerate(sorted((hashlib.md5(f"3|{k}".encode()).hexdigest(), k) for k in range(3000)))}
    got = ordering.with_position(spark.range(3000), 3, "id", leaf_rows=leaf_rows).collect()
    assert {r.id: r.pos for r in got} == want and {r.n_total for r in got} == {3000}


def test_no_leaf_holds_more_rows_than_allowed(spark):
    levels = ordering._tree(spark.range(20_000).select(ordering.seeded_hash(1, F.col("id")).alias("_h")), 4)
    assert len(levels) > 1
    leaves = [r["_count"] for k, level in enumerate(levels) for r in level.collect() if k == len(levels) - 1 or r["_count"] <= 4]
    assert max(leaves) <= 4 and sum(leaves) == 20_000
    assert ordering.with_position(spark.range(0), 1, "id").count() == 0


def in_turns(rows, seed, n):
    """Rows taken in turns by a loop: {key: (turn, position)}."""
    strata = {}
    for k, s in sorted(rows):
        strata.setdefault(s, []).append(k)
    piles = [sorted(ks, key=lambda k: hashlib.md5(f"{seed}|{k}".encode()).hexdigest()) for ks in strata.values()]
    taken, turn = {}, 0
    while len(taken) < n and any(len(p) > turn for p in piles):
        for p in piles:
            if len(p) > turn and len(taken) < n:
                taken[p[turn]] = turn + 1
        turn += 1
    order = sorted(taken, key=lambda k: hashlib.md5(f"{seed}-again|{k}".encode()).hexdigest())
    return {k: (taken[k], order.index(k)) for k in taken}


@pytest.mark.parametrize(("strata", "n", "spare"), [(1, 10, 6.0), (7, 100, 6.0), (7, 100, 0.0), (1000, 1500, 6.0), (1000, 300, 6.0), (5, 0, 6.0), (5, 10_000, 6.0)])
def test_sample_in_turns_equals_a_loop(spark, strata, n, spare):
    rnd = random.Random(strata)
    rows = [(k, None if (s := int(strata * rnd.random() ** 3)) == 3 else s) for k in range(3000)]
    df = spark.createDataFrame(rows, "id long, s int").repartition(5)
    got = ordering.stratified_sample(df, "id", "s", 9, n, spare)
    assert {r.id: (r.turn, r.position) for r in got.collect()} == in_turns(rows, 9, n)


def test_subsequence_index(spark):
    def slow(seq, template):
        if seq is None or template is None:
            return None
        return next((i + len(template) for i in range(len(seq) - len(template) + 1) if seq[i : i + len(template)] == template), 0) if template else 0

    rnd = random.Random(1)
    part = lambda n: [rnd.choice(["a", "b", "", ",", "-", "é", None]) for _ in range(rnd.randrange(n))]
    rows = [(part(12), part(4)) for _ in range(500)] + [([], []), ([], ["a"]), (None, ["a"]), (["a"], None), (["aa", "b"], ["a", "b"]), ([None], ["-"])]
    got = spark.createDataFrame(rows, "s array<string>, t array<string>").select("s", "t", numbers.subsequence_index(F.col("s"), F.col("t")).alias("at")).collect()
    assert [r.at for r in got] == [slow(r.s, r.t) for r in got]
    ids = spark.createDataFrame([([1, 12, 3, 2, 3], [2, 3])], "s array<int>, t array<int>")
    assert ids.select(numbers.subsequence_index(F.col("s"), F.col("t")).alias("at")).first().at == 5
    long = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(300_000)), lambda x: x % 1000).alias("s"))
    assert long.select(numbers.subsequence_index(F.col("s"), F.array(F.lit(999), F.lit(0), F.lit(7))).alias("at")).first().at == 0
