from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest

from gradeflow.llm import substring_dedup as X

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, size=50):
    first, words, largest = {}, [WORD.findall(t or "") for _, t in rows], 1 << 64
    key = lambda i: largest if i is None else i
    for (i, _), w in zip(rows, words, strict=True):
        for k in range(len(w) - size + 1):
            g = tuple(w[k : k + size])
            first[g] = min(first.get(g, largest), key(i))
    out = []
    for (i, _), w in zip(rows, words, strict=True):
        gone = [False] * len(w)
        for k in range(len(w) - size + 1):
            if first[tuple(w[k : k + size])] < key(i):
                gone[k : k + size] = [True] * size
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def planted(n=120):
    rng = random.Random(5)
    vocabulary = ["w%d" % k for k in range(40)]
    passages = [[rng.choice(vocabulary) for _ in range(rng.randint(49, 130))] for _ in range(6)]
    rows = []
    for k in range(n):
        w = [rng.choice(vocabulary) for _ in range(rng.randint(0, 150))]
        for _ in range(rng.randint(0, 2)):
            p, at = rng.choice(passages), rng.randint(0, len(w))
            a = rng.randint(0, 30)
            w[at:at] = p[a : rng.randint(a, len(p))]
        rows.append((k // 2 if k % 7 == 0 else k, rng.choice([" ", "\n", " \t"]).join(w)))
    return rows + rows[:5] + [(500, " ".join(["same"] * 400)), (501, " ".join(["same"] * 90)), (None, rows[9][1]), (None, rows[9][1] + " tail")]


def got(df):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in df.collect()), key=str)


@pytest.mark.parametrize(("window", "sizes"), [(1, [1]), (2, [1, 2]), (20, [10, 20]), (50, [25, 50]), (70, [25, 50, 70]), (200, [25, 50, 100, 200])])
def test_levels_double(window, sizes):
    assert X.levels(window) == sizes


@pytest.mark.parametrize(("window", "start"), [(50, 25), (20, 25), (50, 10), (70, 9), (3, 25), (200, 25)])
def test_equals_brute_force(spark, window, start):
    rows = planted()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(X.remove_repeats(df.repartition(4), window, start=start)) == brute(rows, window)


def test_three_levels_are_needed(spark):
    """Repeats of 25 and of 50 words that don't go on to 100, and one that does."""
    common = [f"c{k}" for k in range(120)]
    rows = [(k, " ".join([f"a{k}x{j}" for j in range(60)] + common[:n] + [f"z{k}x{j}" for j in range(60)])) for k, n in enumerate((120, 120, 60, 60, 30, 30, 0))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows, 100)
    assert [r[2] for r in want] == [0, 120, 0, 0, 0, 0, 0] and X.levels(100) == [25, 50, 100]
    assert got(X.remove_repeats(df, 100)) == want
    assert got(X.remove_repeats(df, 130)) == brute(rows, 130)  # survives 25, 50 and 100, not 130
    assert got(X.remove_repeats(df.filter("doc_id > 3"))) == brute(rows[4:])  # none survives 50


def test_ends_when_no_candidate_survives(spark):
    rows = [(k, " ".join(f"w{k}x{j}" for j in range(300))) for k in range(5)]
    texts = X._texts(spark.createDataFrame(rows, "doc_id long, text string"), 2)
    assert X.repeated_windows(texts, X.levels(200), 2) is None


def test_parts_keys_and_flushes_dont_matter(spark):
    rows = planted(60)
    df = spark.createDataFrame(rows, "doc_id long, text string")

    def places(bits, flush):
        found = X.repeated_windows(X._texts(df, bits), [25, 50], bits, flush)
        out = set()
        for r in found.collect():
            ids, rids, counts, at = (np.frombuffer(x, t) for x, t in ((r.ids, "<i8"), (r.rids, "<i8"), (r.counts, "<u4"), (r.places, "<u4")))
            out |= set(zip(np.repeat(ids, counts).tolist(), np.repeat(rids, counts).tolist(), at.tolist(), strict=True))
        return out

    assert places(2, 500) == places(6, 1 << 30) != set()


def test_largest_id_and_null(spark):
    text = " ".join(f"w{k}" for k in range(60))
    rows = [((1 << 63) - 1, text), (None, text), (-(1 << 63), text), (0, text)]
    assert got(X.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_rows(odd, empty):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert got(X.remove_repeats(odd)) == brute(rows)
    assert X.remove_repeats(empty).count() == 0
    texts = {r.doc_id: r.kept_text for r in X.remove_repeats(odd, keep_text=True).collect()}
    assert texts[7] == "naïve café № ☃ 中文 ١٢"
