from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import public_tokenizers
from tokenizers import Tokenizer, models, normalizers

from gradeflow.llm import textkernel as K
from gradeflow.llm import token_count as C

PATH = public_tokenizers.path("piece_bpe_32k.model")


def exact():
    from sentencepiece import sentencepiece_model_pb2

    m = sentencepiece_model_pb2.ModelProto()
    with open(PATH, "rb") as f:
        m.ParseFromString(f.read())
    t = Tokenizer(models.Unigram([(p.piece, p.score) for p in m.pieces], 0, True))
    t.normalizer = normalizers.Sequence([normalizers.Prepend("▁"), normalizers.Replace(" ", "▁")])
    return t


def counts(counter, texts, most=400):
    raw, offs = K.text_bytes(pa.array(texts))
    return np.concatenate([counter.batch(raw[offs[a] : offs[b]], offs[a : b + 1] - offs[a])[1] for a, b in K.slices(raw, offs, most)]).tolist()


def test_equals_the_library():
    rng, t = random.Random(3), exact()
    parts = ["a", "B", " ", " ", "th", "é", "ß", "€", "1", "ing", "he", "!!", "中", "😀", "don't", "the", ".", "\n", "▁"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(4000)]
    assert counts(C.counter(PATH), texts) == [len(t.encode(x, add_special_tokens=False).ids) for x in texts]


def brute(pieces, text):
    low = min(pieces.values()) - C.UNKNOWN_PENALTY
    best = [(0.0, 0)] + [(C.NEG, 0)] * len(text)
    for end in range(1, len(text) + 1):
        for start in range(end):  # the earliest start wins ties
            if text[start:end] in pieces and best[start][0] + pieces[text[start:end]] > best[end][0]:
                best[end] = (best[start][0] + pieces[text[start:end]], best[start][1] + 1)
        if text[end - 1] not in pieces and best[end - 1][0] + low > best[end][0]:
            best[end] = (best[end - 1][0] + low, best[end - 1][1] + len(text[end - 1].encode()))
    return best[-1]


def test_ties_by_brute_force():
    pieces = {"a": -2.0, "b": -2.0, "ab": -4.0, "ba": -3.0, "aba": -5.0, "bb": -4.0, "▁": -1.0, "▁a": -3.0}
    rng, c = random.Random(1), C.UnigramCounter(pieces)
    for _ in range(500):
        x = "".join(rng.choice("aab▁zé") for _ in range(rng.randint(0, 9)))
        assert c.search(x) == brute(pieces, x)


def test_pieces_across_blanks_are_searched_whole():
    pieces = {"a": -2.0, "▁": -2.0, "a▁a": -1.0, "b": -1.0}
    c = C.UnigramCounter(pieces)
    assert not c.by_chunk
    assert counts(c, ["a a b", "", "aa"]) == [brute(pieces, "▁" + x.replace(" ", "▁"))[1] if x else 0 for x in ("a a b", "", "aa")]


def test_cache_starts_anew(monkeypatch):
    monkeypatch.setattr(C, "MOST_CHUNKS", 3)
    c = C.UnigramCounter({"a": -1.0, "▁": -1.0})
    assert counts(c, [f"{'a' * k} a" for k in range(9)], 4) == [k + 3 for k in range(9)]


def test_rows(odd, empty):
    got = C.count_tokens(odd, PATH).collect()
    assert len(got) == odd.count()
    assert sorted(r.n_tokens for r in got)[:3] == [0, 0, 0]
    assert C.count_tokens(empty, PATH).count() == 0
