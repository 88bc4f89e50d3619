from __future__ import annotations

import collections
import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from gradeflow.llm import bpe, packing
from gradeflow.llm import textkernel as K

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_ids_equal_the_library():
    rng, exact, mine = random.Random(3), Tokenizer.from_file(PATH), bpe.encoder(PATH)
    parts = ["a", "B", " ", " ", "\n", "\t", "\r", "é", "ß", "€", "1", "'s", "'", "!!", " ", "　", "​", "中", "😀", "\x1c", "\x85", "don't", "the", "<|endoftext|>", "\x00", "."]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(8000)]
    raw, offs = K.text_bytes(pa.array(texts))
    for a, b in K.slices(raw, offs, 3000):
        ids, at = mine.batch(raw[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
        for k in range(a, b):
            assert ids[at[k - a] : at[k - a + 1]].tolist() == exact.encode(texts[k], add_special_tokens=False).ids, texts[k]


def optimum(lengths, size):
    lengths, best = sorted(lengths, reverse=True), [len(lengths)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(lengths):
            best[0] = len(bins)
            return
        for k, b in enumerate(bins):
            if b + lengths[i] <= size and b not in bins[:k]:
                bins[k] += lengths[i]
                go(i + 1, bins)
                bins[k] -= lengths[i]
        go(i + 1, [*bins, lengths[i]])

    go(0, [])
    return best[0]


def test_bounds_and_best_fit():
    rng = np.random.default_rng(0)
    for _ in range(200):
        size = int(rng.integers(5, 40))
        lengths = rng.integers(1, size, rng.integers(1, 9))
        bins, offsets, fills = packing.best_fit_decreasing(lengths, size)
        assert packing.lower_bound(lengths, size) <= optimum(lengths.tolist(), size) <= len(fills) and fills.max() <= size
        for b in range(len(fills)):
            spans = sorted((int(o), int(n)) for o, n, x in zip(offsets, lengths, bins, strict=True) if x == b)
            assert [o for o, _ in spans] == np.cumsum([0, *[n for _, n in spans]])[:-1].tolist()
    assert packing.lower_bound(np.zeros(0, np.int64), 9) == 0


def test_cuts():
    assert packing.cut(5, 4) == [1, 4] and packing.cut(8, 4) == [4, 4] and packing.cut(3, 4) == [3]


def check(df, out, size):
    exact, rows = Tokenizer.from_file(PATH), out.collect()
    want = collections.Counter()
    for r in df.collect():
        ids, at = [*exact.encode(r.text or "", add_special_tokens=False).ids, 0], 0
        for p, n in enumerate(packing.cut(len(ids), size)):
            want[r.doc_id, p, at, n, zlib.crc32(np.array(ids[at : at + n], dtype="<u4").tobytes())] += 1
            at += n
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    by = collections.defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for spans in by.values():
        spans.sort()
        assert [o for o, _ in spans] == [sum(n for _, n in spans[:k]) for k in range(len(spans))] and sum(n for _, n in spans) <= size
    return len(by), packing.lower_bound(np.array([r.length for r in rows]), size)


@pytest.mark.parametrize("part_rows", [40, 100_000])
def test_round_trip(docs, part_rows):
    n, bound = check(docs, packing.pack(docs, PATH, part_rows=part_rows), 2048)
    assert n <= 1.02 * bound + 1


def test_rows(odd, empty):
    check(odd, packing.pack(odd, PATH), 2048)
    assert packing.pack(empty, PATH).count() == 0


def test_gap_is_that_of_all_pieces(spark):
    rows = [(k, k % 7, 1 + k * 37 % 2048, k // 2) for k in range(60)]
    packed = spark.createDataFrame(rows, "uid long, piece int, length long, sequence_id long")
    assert packing.gap(packed) == (30, packing.lower_bound(np.array([r[2] for r in rows]), 2048))
