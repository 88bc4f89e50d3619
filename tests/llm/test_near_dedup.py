from __future__ import annotations

import collections
import random
import re

import numpy as np
import pytest

from gradeflow.llm import near_dedup as X
from gradeflow.llm import textkernel as K
from gradeflow.llm.components import components, joined

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def bag(text):
    w = WORD.findall((text or "").translate(LOW))
    return collections.Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else collections.Counter()


def brute(rows, threshold=0.8):
    """Class of each row: smallest doc_id over links of all pairs."""
    bags, up = [bag(t) for _, t in rows], list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = sum((bags[i] & bags[j]).values())
            if both and both >= threshold * sum((bags[i] | bags[j]).values()) - 1e-9:
                up[root(i)] = root(j)
    ids = collections.defaultdict(list)
    for k, (i, _) in enumerate(rows):
        ids[root(k)].append(i)
    return sorted((str(i), str(min((x for x in ids[root(k)] if x is not None), default=None)), len(ids[root(k)])) for k, (i, _) in enumerate(rows))


def got(df):
    return sorted((str(r.doc_id), str(r.class_id), r.class_size) for r in df.collect())


def planted(n=150):
    rng = random.Random(4)
    vocabulary = [f"w{k}" for k in range(300)]
    base = [[rng.choice(vocabulary) for _ in range(rng.randint(30, 200))] for _ in range(n // 3)]
    rows = []
    for k in range(n):
        w = list(rng.choice(base[:10] if k % 2 else base))
        for _ in range(rng.choice([0, 0, 1, 2, 4])):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        rows.append((k, " ".join(w)))
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_signatures_are_unbiased(seed):
    rng = np.random.default_rng(seed)
    a = {int(k): int(rng.integers(1, 40)) for k in rng.integers(0, 1000, 60)}
    b = {k: (v if rng.random() < 0.7 else int(rng.integers(1, 60))) for k, v in a.items() if rng.random() < 0.9}
    j = sum(min(a.get(k, 0), b.get(k, 0)) for k in a | b) / sum(max(a.get(k, 0), b.get(k, 0)) for k in a | b)

    def sign(x):
        key = K.mix(np.array(list(x), dtype=np.uint64))
        return X.signatures(np.zeros(len(x), np.int64), key, np.array(list(x.values())), 1, 4096)[0]

    assert (sign(a) == sign(b)).mean() == pytest.approx(j, abs=0.035)


def test_equals_brute_force(spark):
    rows = planted()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = X.near_duplicates(df)
    assert got(out) == brute(rows)
    assert out.filter("kept").select("class_id").distinct().count() == out.filter("kept").count()
    assert X.keep_one(df).count() == len({c for _, c, _ in brute(rows)})


@pytest.mark.parametrize(("small", "rounds"), [(2, 2), (1000, 0)])
def test_steps_dont_matter(spark, monkeypatch, small, rounds):
    monkeypatch.setattr(X, "SMALL", small)
    monkeypatch.setattr(X, "PIVOT_ROUNDS", rounds)
    monkeypatch.setattr(X, "TOGETHER", 100)
    monkeypatch.setattr(X, "BLOCK_ROWS", 10)
    rows = planted(90)
    assert got(X.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_one_pair_a_node_and_round(spark):
    rows = [(b, n, 10, 30, 0, 10) for b in range(24) for n in range(30)]
    filled = spark.createDataFrame(rows, "bucket long, node long, size long, n long, rep long, rep_size long")
    pairs = X._star(filled, 0.8).collect()
    assert len(pairs) == len({r.b for r in pairs}) == 29
    labels = spark.createDataFrame([(k, 5 if k > 5 else k) for k in range(30)], "node long, comp long")
    pairs = X._pivots(X._apart(filled, labels), 0, 0.8).collect()
    assert {r.b for r in pairs} == {0, 1, 2, 3, 4} and all(r.a >= 5 for r in pairs)
    assert X._apart(filled, spark.createDataFrame([(k, 5) for k in range(30)], "node long, comp long")).isEmpty()


def test_rows(odd, empty):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert got(X.near_duplicates(odd)) == brute(rows)
    assert X.near_duplicates(empty).count() == 0
    kept = X.keep_one(odd)
    assert kept.count() == X.near_duplicates(odd).filter("kept").count()  # the row that repeats as a whole stays once
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} == {None, 1, 3, 4, 5, 6, 7, 8, 9, 10, 11}
    assert X.keep_one(empty).count() == 0


def test_components(spark):
    links = [(1, 2), (2, 3), (3, 4), (10, 11), *((k, k + 1) for k in range(100, 140)), (7, 7)]
    got = {r.node: r.comp for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 10: 10, 11: 10, 7: 7} | {k: 100 for k in range(100, 141)}


@pytest.mark.parametrize("block_rows", [100])
def test_template_group_in_one_bucket(spark, monkeypatch, block_rows):
    """Hundreds of texts of one template share buckets and are apart (0.78), but for pairs that have one more word in common (0.81)."""
    monkeypatch.setattr(X, "BLOCK_ROWS", block_rows)
    rows = []
    for k in range(330):
        w = [f"t{p}" for p in range(300)]
        for p in range(0, 300, 38):
            w[p] = f"own{k % 300 if p == 152 else k}x{p}"
        rows.append((k, " ".join(w)))
    want = brute(rows)
    assert len({c for _, c, _ in want}) == 300
    assert got(X.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))) == want


def test_components_after_more_links(spark):
    """Links that come later lead to the components of all links at once; nodes may be new, links may repeat or join nothing."""
    rng = np.random.default_rng(5)
    sets = [[tuple(map(int, x)) for x in rng.integers(0, 400, (n, 2)) if x[0] != x[1]] for n in (150, 60, 40)]
    table = lambda rows: spark.createDataFrame(rows, "a long, b long")
    as_set = lambda df: sorted((r.node, r.comp) for r in df.collect())
    labels = components(table(sets[0]))
    assert joined(labels, table(sets[0][:20])) is labels and joined(labels, table([])) is labels
    for more in sets[1:]:
        labels = joined(labels, table([*more, *more]))
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in (y for x in sets for y in x):
        p, q = sorted((root(a), root(b)))
        up[q] = p
    assert as_set(labels) == sorted((x, root(x)) for x in up)
    assert components(table([])).count() == 0
