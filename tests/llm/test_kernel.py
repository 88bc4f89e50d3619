from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from gradeflow.llm import textkernel as K

PATTERNS = [(K.NOT_SPACE, re.compile(r"[^\x20\x09-\x0D]+")), (K.ALNUM, re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"))]


@pytest.mark.parametrize(("table", "pattern"), PATTERNS)
def test_words(table, pattern):
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab \n\té ß€1,Z") for _ in range(rng.randint(0, 60))) for _ in range(800)] + [None, "", " ", "x" * 99]
    raw, offs = K.text_bytes(pa.array(texts).slice(0))
    w = K.find_words(raw, offs, table)
    h, seen = K.hash_spans(raw, w.starts, w.ends), {}
    for k, t in enumerate(texts):
        own = range(w.rows[k], w.rows[k + 1])
        assert [bytes(raw[w.starts[i] : w.ends[i]]).decode() for i in own] == pattern.findall(t or "")
        for i in own:
            assert seen.setdefault(bytes(raw[w.starts[i] : w.ends[i]]), h[i]) == h[i]
    assert len(set(seen.values())) == len(seen)


def test_sliced_arrays_and_slices():
    a = pa.array(["x", None, "yy", "zzz"]).slice(1, 3)
    raw, offs = K.text_bytes(a)
    assert raw.tobytes() == b"yyzzz" and offs.tolist() == [0, 0, 2, 5]
    assert [x for a, b in K.slices(raw, offs, 2) for x in range(a, b)] == [0, 1, 2]


def test_windows_and_extremes():
    h = np.random.default_rng(0).integers(0, 1 << 63, 60).astype(np.uint64)
    for n in (1, 2, 5, 13, 25):
        w = K.windows(np.concatenate([h, h]), n)
        assert len(w) == 121 - n and (w[:10] == w[60:70]).all() and len(set(w[: 61 - n].tolist())) == 61 - n
        assert K.extremes(h, n, np.minimum).tolist() == [h[i : i + n].min() for i in range(61 - n)]
    assert len(K.windows(h[:3], 5)) == 0


def test_hash_index():
    index, keys = K.HashIndex(3), np.random.default_rng(0).integers(0, 1 << 63, 5000).astype(np.uint64)
    for part in np.split(keys, 10):
        assert (index.find(part) == -1).all()
        index.add(part)
    assert index.find(keys).tolist() == list(range(5000))
