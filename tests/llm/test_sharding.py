from __future__ import annotations

import collections
import hashlib

import pytest

from gradeflow.llm import sharding as X

NAMES = [f"s{k}" for k in range(7)]


def brute(shards, size):
    """Whole permutations, then turns."""
    draw = lambda s, tag, below: int(hashlib.md5(f"{tag}|{s}".encode()).hexdigest()[:15], 16) % below
    orders = [iter([(draw(s, "offset", size) + j * (draw(s, "skip", size - 1) + 1)) % size for j in range(size)]) for s in shards]
    table = [None] * size
    while None in table:
        for k, order in enumerate(orders):
            if None in table:
                table[next(x for x in order if table[x] is None)] = k
    return table


def test_table_by_brute_force():
    assert X.lookup_table(NAMES, 101).tolist() == brute(NAMES, 101)


def test_shares_and_moves():
    a = X.lookup_table(NAMES, 10_007)
    sizes = collections.Counter(a.tolist())
    assert max(sizes.values()) - min(sizes.values()) <= 1
    b = X.lookup_table(NAMES[:-1], 10_007)
    moved = sum(NAMES[x] != NAMES[y] for x, y in zip(a.tolist(), b.tolist(), strict=True) if x != 6)
    assert moved < 0.1 * 10_007
    w = collections.Counter(X.lookup_table(["x", "y"], 1009, [3, 1]).tolist())
    assert 2.9 < w[0] / w[1] < 3.1


def test_refusals():
    for shards, size in (([], 101), (["a", "a"], 101), (["a"], 100), (NAMES, 5)):
        with pytest.raises(ValueError):
            X.lookup_table(shards, size)


def test_rows(odd, empty):
    got = X.assign_shards(odd, "doc_id", NAMES, 101)
    assert got.count() == odd.count() and set(odd.columns) <= set(got.columns)
    table = X.lookup_table(NAMES, 101)
    for r in got.collect():
        key = "null" if r.doc_id is None else f"k{r.doc_id}"
        assert r.slot == int(hashlib.md5(key.encode()).hexdigest()[:15], 16) % 101 and r.shard == NAMES[table[r.slot]]
    assert X.assign_shards(empty, "doc_id", NAMES, 101).count() == 0


def test_written_shards(spark, tmp_path):
    X.write_shards(X.assign_shards(spark.range(50).withColumnRenamed("id", "k"), "k", NAMES, 101), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 50
