"""Byte-level BPE ids of whole texts, with a cache over chunks.

Before merging, the tokenizer cuts text with a pattern. A single blank before a visible character, and a
lone line break between visible characters, always start a new cut, so text is taken apart
there with vector operations and each distinct chunk is encoded once per worker. Chunks are known by a
64-bit hash. Other spots (runs of blanks, unusual white space) stay inside a chunk, which the encoder cuts itself.
"""

from __future__ import annotations

import json
from functools import lru_cache
from itertools import chain

import numpy as np

from .textkernel import HashIndex, hash_spans, ragged

#: Chunks kept during a task; the cache starts anew beyond it (some 60 bytes each).
MOST_CHUNKS = 500_000

#: The tokenizer family's published cutting pattern (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: First bytes of characters that can't be white space; visible ASCII; first bytes of such two-byte characters.
VISIBLE = np.zeros(256, dtype=bool)
VISIBLE[[*range(0x21, 0x7F), *range(0xC3, 0xE1), *range(0xE4, 0xF5)]] = True
ASCII = np.zeros(256, dtype=bool)
ASCII[0x21:0x7F] = True
TWO = np.zeros(256, dtype=bool)
TWO[0xC3:0xE0] = True
BREAK = np.zeros(256, dtype=bool)
BREAK[0x09:0x0E] = True


def cuts(raw: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Starts of chunks; every row that isn't empty starts one."""
    n = len(raw)
    cut = np.zeros(n + 1, dtype=bool)
    if n > 1:
        seen = VISIBLE[raw[1:]]
        cut[: n - 1] = (raw[:-1] == 0x20) & seen
        before = ASCII[raw]
        before[1:] |= (raw[1:] >> 6 == 2) & TWO[raw[:-1]]
        lone = np.flatnonzero(BREAK[raw[1:-1]] & before[:-2] & seen[1:]) + 1
        # a row's first or last byte is no lone break: what stands next to it belongs to another row
        edge = np.zeros(n + 1, dtype=bool)
        edge[offs] = True
        lone = lone[~(edge[lone] | edge[lone + 1])]
        cut[lone] = cut[lone + 1] = True
        last = offs[1:] - 1
        cut[last[(last >= 0)]] &= False
    starts = offs[:-1][np.diff(offs) > 0]
    cut[starts] = True
    return np.flatnonzero(cut[:n])


def _byte_of() -> dict[str, int]:
    """Characters that stand for bytes in the vocabulary file: visible bytes are themselves, others follow from U+0100 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class BpeEncoder:
    """Ids as the ``tokenizers`` library gives them for a byte-level BPE file, without special tokens added."""

    def __init__(self, path: str) -> None:
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        of = _byte_of()
        self.specials = [t["content"] for t in spec.get("added_tokens", [])]
        ranks = {bytes(of[c] for c in word): k for word, k in spec["model"]["vocab"].items() if word not in self.specials}
        self.encode = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_ordinary
        self.whole = Tokenizer.from_file(path)
        self.clear()

    def clear(self) -> None:
        """Forgets all chunks."""
        self.slots = HashIndex()
        self.sizes = np.zeros(1 << 16, dtype=np.int32)
        self.at = np.zeros(1 << 16, dtype=np.int64)
        self.ids = np.zeros(1 << 18, dtype=np.int32)
        self.used = 0

    def _learn(self, hashes: np.ndarray, chunks: list[str]) -> np.ndarray:
        found = list(map(self.encode, chunks))
        sizes = np.fromiter(map(len, found), dtype=np.int32, count=len(found))
        ids = np.fromiter(chain.from_iterable(found), dtype=np.int32, count=int(sizes.sum()))
        have, need = self.slots.n, self.used + len(ids)
        while have + len(found) > len(self.sizes):
            self.sizes, self.at = np.resize(self.sizes, 2 * len(self.sizes)), np.resize(self.at, 2 * len(self.at))
        while need > len(self.ids):
            self.ids = np.resize(self.ids, 2 * len(self.ids))
        self.sizes[have : have + len(found)] = sizes
        self.at[have : have + len(found)] = self.used + np.cumsum(sizes) - sizes
        self.ids[self.used : need] = ids
        self.used = need
        return self.slots.add(hashes)

    def batch(self, raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, offsets of rows in them) of the texts that ``offs`` delimits in ``raw``."""
        if self.slots.n > MOST_CHUNKS:
            self.clear()
        starts = cuts(raw, offs)
        ends = np.append(starts[1:], len(raw))
        h = hash_spans(raw, starts, ends)
        slot = self.slots.find(h)
        if len(new := np.flatnonzero(slot < 0)):
            distinct, first, back = np.unique(h[new], return_index=True, return_inverse=True)
            data, first = raw.tobytes(), new[first]
            spans = zip(starts[first].tolist(), ends[first].tolist(), strict=True)
            slot[new] = self._learn(distinct, [data[a:b].decode() for a, b in spans])[back]
        sizes = self.sizes[slot].astype(np.int64)
        ids = self.ids[ragged(self.at[slot], sizes)]
        upto = np.concatenate([[0], np.cumsum(sizes)])
        at = upto[np.searchsorted(starts, offs)]
        return self._with_specials(raw, offs, ids, at)

    def _with_specials(self, raw: np.ndarray, offs: np.ndarray, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows that hold a special token's string are encoded by the library itself."""
        data = raw.tobytes()
        odd = set()
        for s in self.specials:
            k = data.find(s.encode())
            while k >= 0:
                odd.add(int(np.searchsorted(offs, k, "right")) - 1)
                k = data.find(s.encode(), k + 1)
        if not odd:
            return ids, at
        rows = [ids[at[k] : at[k + 1]] for k in range(len(at) - 1)]
        for k in odd:
            rows[k] = np.array(self.whole.encode(data[offs[k] : offs[k + 1]].decode(), add_special_tokens=False).ids, dtype=np.int32)
        return np.concatenate(rows), np.concatenate([[0], np.cumsum([len(r) for r in rows])])


@lru_cache(maxsize=2)
def encoder(path: str) -> BpeEncoder:
    """One for each worker and file."""
    return BpeEncoder(path)
