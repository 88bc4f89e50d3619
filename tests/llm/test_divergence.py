from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import pytest

from gradeflow.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least=10, top=10):
    """rows: (text, lang, source)."""
    rows = [tuple(x or "" for x in r) for r in rows]
    docs, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        found = Counter(TERM.findall(text.translate(LOWER)))
        docs[lang].update(found.keys())
        counts[lang, source].update(found)
        groups[lang].add(source)
    f = lambda p, q: (p - q) ** 2 // (p + q)
    out = set()
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= least]
        total = lambda c: sum(c[t] for t in kept)
        share = lambda c, t, n: 1 + 10**9 * (c[t] + 2) // (n + 2 * len(kept))
        whole = sum((counts[lang, s] for s in sources), Counter())
        n_all, n = total(whole), {s: total(counts[lang, s]) for s in sources}
        p = {s: {t: share(counts[lang, s], t, n[s]) for t in kept} for s in sources}
        q = {t: share(whole, t, n_all) for t in kept}
        for s in sources:
            pairs = [(-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in sources if o != s]
            terms = [(-f(p[s][t], q[t]), t.encode()) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, items, most in (("pair", pairs, None), ("term", terms, top)):
                out |= {(lang, s, part, item.decode(), -v, k) for k, (v, item) in enumerate(sorted(items)[:most], 1)}
    return out


def run(spark, rows, **more):
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "doc_id long, text string, lang string, source string").repartition(3)
    out = divergence.audit(df, **more)
    assert out.columns == ["lang", "source", "part", "item", "value", "rank"]
    got = [tuple(r) for r in out.collect()]
    assert len(got) == len(set(got))
    return set(got)


ROWS = [("Ünïté ünïté THE the 中文 x1y", "en", "a"), ("the cat", "en", "b"), ("dog DOG", "en", "c"), (None, "en", "d"), ("the", None, "a"), ("the", "", None), ("", "de", "only"), ("123 --- ", "fr", "x"), ("rare", "fr", "y"), ("the cat", None, "b"), ("cat@the[dog]`{é}", "en", "b"), ("z" * 70_000, "en", "a"), ("z" * 70_000, "en", "b")]


@pytest.mark.parametrize("least", [1, 2, 10])
def test_equals_a_dense_version(spark, least):
    assert run(spark, ROWS, least_docs=least) == brute(ROWS, least)


def test_many_sources_in_blocks_and_parts(spark, monkeypatch):
    monkeypatch.setattr(divergence, "BLOCK", 3)
    monkeypatch.setattr(divergence, "PART_CELLS", 20)
    rng = random.Random(4)
    words = [f"w{''.join(rng.choice('abé') for _ in range(5))}" for _ in range(60)]
    rows = [(" ".join(rng.choices(words, k=rng.randint(0, 25))), rng.choice(["en", "en", "de"]), f"s{min(rng.randint(0, 12), rng.randint(0, 12))}") for _ in range(150)]
    assert run(spark, rows, least_docs=3, small=2) == brute(rows, 3)
    assert run(spark, rows, least_docs=2, top=3) == brute(rows, 2, 3)


def test_a_tasks_table_is_sent_on_when_full(spark):
    rows = [(f"a{k % 3}b c d{k % 7}x yy zzz é{k}", "en", f"s{k % 4}") for k in range(90)]
    df = spark.createDataFrame(rows, "text string, lang string, source string").repartition(40)
    out = divergence.count_terms(df, most_terms=2).groupBy("lang", "source", "term").agg({"n": "sum", "docs": "sum"}).collect()
    want = {s: Counter() for _, _, s in rows}
    for text, _, s in rows:
        want[s].update(TERM.findall(text))
    got = {(r.source, r.term): (r["sum(n)"], r["sum(docs)"]) for r in out if not r.term.startswith(divergence.MARK)}
    assert {k: n for k, (n, _) in got.items()} == {(s, t): n for s, c in want.items() for t, n in c.items()}
    assert {r.source for r in out if r.term.startswith(divergence.MARK)} == set(want)
    assert all(d == n for (_, t), (n, d) in got.items())  # each of these texts has a term once


def test_ties_are_ranked_by_bytes(spark):
    rows = [("b a Z é zz", "en", "x"), ("q r s t", "en", "y")] * 3
    got = run(spark, rows, least_docs=1, small=1)
    assert got == brute(rows, 1)
    assert [i for _, i in sorted((r, i) for _, s, part, i, _, r in got if s == "x" and part == "term")] == ["a", "b", "z", "zz", "é"]


def test_odd_and_empty_tables(spark, odd, empty):
    from pyspark.sql import functions as F

    more = lambda df: df.withColumns({c: F.lit("x") for c in ("lang", "source", "term", "n", "p", "value", "rank", "part")})
    assert {tuple(r) for r in divergence.audit(more(odd), least_docs=2).collect()} == brute([(r.text, "x", "x") for r in odd.collect()], 2)
    assert divergence.audit(more(empty)).collect() == []


def test_documents(docs):
    rows = [tuple(r) for r in docs.select("text", "lang", "source").collect()]
    assert {tuple(r) for r in divergence.audit(docs).collect()} == brute(rows)
