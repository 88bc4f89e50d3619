from __future__ import annotations

import collections
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from gradeflow.llm import lm_score as L
from gradeflow.llm.textkernel import text_bytes

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(t):
    return [*WORD.findall((t or "").translate(LOW)), None]


def held_out(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0


def run(df, **more):
    return L.score(df, *L.train(df.filter(~L.is_held_out()), **more)).withColumn("held_out", L.is_held_out())


def check_base(rows, got):
    c = collections.Counter(w for i, t in rows if not held_out(i) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    want = sorted((str(i), len(w := tokens(t)), sum(c[x] > 0 for x in w), n, round(sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), 5)) for i, t in rows)
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got) == want
    assert all(r.held_out == held_out(r.doc_id) for r in got)


def test_base_is_exact_and_model_is_better(docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = run(docs, bits=3).collect()
    check_base(rows, got)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_blocks_add_up(docs):
    a = {r.doc_id: (r.n_known, r.base_score, r.score) for r in run(docs, bits=3, block_words=700, flush=5000).collect()}
    b = {r.doc_id: (r.n_known, r.base_score, r.score) for r in run(docs, bits=3).collect()}
    for k in a:
        assert a[k] == pytest.approx(b[k], abs=1e-6)


def test_rows(odd, empty):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    got = run(odd, bits=2).collect()
    check_base(rows, got)
    assert run(empty, bits=2).count() == 0
    assert {r.score for r in L.score(odd, *L.train(empty, bits=2)).collect()} == {0.0}


def filter_of(keys, level, first, bits=2):
    parts = keys >> np.uint64(48 - bits)
    rows = [{"kind": "run2", "part": p, "keys": keys[parts == p].tobytes(), "more": b"", "counts": level[parts == p].astype("<u8").tobytes()} for p in range(1 << bits)]
    schema = pa.schema([("kind", pa.string()), ("part", pa.int32()), ("keys", pa.binary()), ("more", pa.binary()), ("counts", pa.binary())])
    segments = [(r["part"], r["data"]) for b in L._segment(iter([pa.RecordBatch.from_pylist(rows, schema=schema)]), first) for r in b.to_pylist()]
    out = L.LogFrequencyFilter({p: len(d) // 8 for p, d in segments}, bits, first)
    for p, d in segments:
        out.put(p, d)
    return out


@pytest.mark.parametrize("first", [1, 2, 3])
def test_filter_has_every_key_and_few_others(first):
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 1 << 48, 50_000).astype(np.uint64))
    level = np.minimum(rng.geometric(0.6, len(keys)), 20)
    found, others = filter_of(keys, level, first), rng.integers(0, 1 << 48, 2_000_000).astype(np.uint64)
    assert (found.levels(keys) >= level).all() and (found.levels(keys) == level).mean() > 0.99
    assert (found.levels(others) > 0).mean() <= 1.3 * L.FALSE_PLACE**first


def test_levels_and_masses():
    for least in (1, 2):
        c = np.arange(least, 5000)
        j = L.level(c, least)
        assert (np.diff(j) >= 0).all() and j[0] == 1 and L.values(least)[0] == 0 and L.values(least)[1] == (1 if least == 1 else 2.5)
        assert (np.abs(np.log(L.values(least)[j] / c)) <= np.log(L.BASE)).all()
    m = np.arange(2, 100_000) / 2
    power, step = L.mass_code(m)
    assert (np.abs(L.mass_of(power, step) / m - 1) <= 0.067).all() and L.mass_of(np.array([0]), np.array([0]))[0] == 0
    assert [L.presence(v) for v in (10, 10**5, 10**9)] == [1, 3, 4]


def test_probabilities_sum_to_one(docs):
    """Over all words and the unknown one, in contexts of every kind."""
    train = [r.text for r in docs.filter(~L.is_held_out()).collect()]
    model, blocks = L.train(docs.filter(~L.is_held_out()), bits=3, order=3)
    raw, offs = text_bytes(pa.array(train, pa.string()))
    token, contexts, _ = L.tokens(raw, offs, 3)
    words = np.append(np.unique(token), np.uint64(12345))
    below = model.n + 0.1 * (model.v + 1)
    single = (blocks[0].value.find(words) + 0.1) / below
    assert single.sum() == pytest.approx(1)
    rng, sums = np.random.default_rng(0), []
    for at in [0, *rng.integers(0, len(token), 60)]:
        own = [np.full(len(words), x[at]) for x in contexts]
        sums.append(L.smoothed(single, model.filters[0].value.levels(words, own), model.least).sum())
    sums = np.array(sums)
    assert (np.abs(sums - 1) < 0.05).mean() >= 0.9 and abs(np.median(sums) - 1) < 0.02


@pytest.mark.parametrize(("order", "least"), [(2, 2), (2, 1), (3, 2), (3, 1)])
def test_score_equals_a_dictionary_model(docs, order, least):
    """The same formula over exact dictionaries; the filter may differ by the rounding of masses and by false positives."""
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    counts, single = collections.Counter(), collections.Counter()
    for i, t in rows:
        if not held_out(i):
            w = [*["<"] * (order - 1), *tokens(t)]
            single.update(w[order - 1 :])
            for k in range(order - 1, len(w)):
                for n in range(2, order + 1):
                    counts[tuple(w[k - n + 1 : k + 1])] += 1
    kept = {g: L.values(least)[L.level(np.array([c]), least)[0]] for g, c in counts.items() if c >= least}
    mass = collections.Counter()
    for g, q in kept.items():
        mass[g[:-1]] += q
    n, v = sum(single.values()), len(single)
    got = {r.doc_id: r.score for r in run(docs, bits=3, order=order, least=least).collect()}
    for i, t in rows:
        w, total = [*["<"] * (order - 1), *tokens(t)], 0.0
        for k in range(order - 1, len(w)):
            p = (single[w[k]] + 0.1) / (n + 0.1 * (v + 1))
            for m in range(2, order + 1):
                g = tuple(w[k - m + 1 : k + 1])
                h = g[:-1]
                if mass[h]:
                    c = single[h[0]] if len(h) == 1 else kept.get(h, 0)
                    total_h = max(mass[h], L.values(1)[L.level(np.array([max(c, mass[h])]), 1)[0]])
                    p = (kept.get(g, 0) + (total_h - mass[h] + L.KAPPA) * p) / (total_h + L.KAPPA)
            total += math.log10(p)
        assert got[i] == pytest.approx(total, rel=0.01, abs=0.05 * len(tokens(t)) ** 0.5 + 0.02 * len(tokens(t)))


def test_filter_blocks_keep_precision(docs):
    """A filter limit far below the keys gives more blocks, not fewer bits a key: scores don't change."""
    train = docs.filter(~L.is_held_out())
    model, words = L.train(train, bits=4, most_filter_mb=0.02, block_words=700, flush=5000, order=3)
    assert len(model.filters) > 2
    assert all(sum(x.data.nbytes for x in f.value.by_kind.values()) < 60_000 for f in model.filters)
    a = {r.doc_id: (r.n_known, r.base_score, r.score) for r in L.score(docs, model, words).collect()}
    b = {r.doc_id: (r.n_known, r.base_score, r.score) for r in run(docs, bits=4, order=3).collect()}
    for k in a:
        assert a[k] == pytest.approx(b[k], abs=1e-6)


def test_full_segments_end():
    full = L.LogFrequencyFilter({p: 1 for p in range(4)}, 2, 3)
    for p in range(4):
        full.put(p, bytes([255] * 8))
    assert (full.levels(np.arange(5, dtype=np.uint64)) == L.MOST_LEVEL).all()
