"""Token counts by a count-only Viterbi search (operator 1).

The vocabulary is a public SentencePiece file, read as a unigram model: pieces and their scores. An
Aho-Corasick automaton enumerates the pieces that end at each character; for each place only the best score
and the number of pieces so far are kept, so no segmentation is stored. Tie rules are the tokenizer's: of equal scores
the candidate with the earliest start wins; a character without a piece of its own may be an unknown one,
whose score is the lowest of all pieces less 10 and which becomes its UTF-8 bytes; a blank is put before the text.

As long as no piece holds a blank after another character (checked when the file is loaded), the best path never crosses the start of
a run of blanks, so the search works chunk by chunk and each distinct chunk is searched once per
worker (a cache of bounded size). Sums of this file's scores are whole numbers, so sums by chunk are exact.

Edge cases: null and empty texts have no tokens and score 0; very long texts and chunks are searched whole; rows that repeat
are each counted; an empty table gives no rows; other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkernel import HashIndex, hash_spans, slices, text_bytes

#: Chunks kept per worker; the cache starts anew beyond it (some 40 bytes each).
MOST_CHUNKS = 2_000_000
#: The mark that stands for a blank, and by how much an unknown character scores less than any piece (fixed values).
MARK, UNKNOWN_PENALTY = "▁", 10.0
NEG = float("-inf")


class UnigramCounter:
    """Counts pieces of texts under pieces with scores."""

    def __init__(self, pieces: dict[str, float], byte_fallback: bool = True) -> None:
        self.by_chunk = not any(MARK in p.lstrip(MARK) for p in pieces)
        self.byte_fallback = byte_fallback
        self.unknown = min(pieces.values()) - UNKNOWN_PENALTY
        self.tree = ahocorasick.Automaton()
        for piece, score in pieces.items():
            self.tree.add_word(piece, (len(piece), score))
        self.tree.make_automaton()
        self._clear()

    def _clear(self) -> None:
        self.known, self.scores, self.counts = HashIndex(), np.zeros(1 << 16), np.zeros(1 << 16, dtype=np.int32)

    def search(self, text: str) -> tuple[float, int]:
        """(best score, its number of pieces) of a text whose blanks are marks."""
        n = len(text)
        best, count = [NEG] * (n + 1), [0] * (n + 1)
        best[0] = 0.0
        single, done, unknown = False, 0, self.unknown
        for end, (size, score) in self.tree.iter(text):
            end += 1
            while done < end - 1:  # places before this one are settled
                if not single and best[done] + unknown > best[done + 1]:
                    best[done + 1] = best[done] + unknown
                    count[done + 1] = count[done] + (len(text[done].encode()) if self.byte_fallback else 1)
                done, single = done + 1, False
            start = end - size
            if best[start] + score > best[end]:
                best[end], count[end] = best[start] + score, count[start] + 1
            single = single or size == 1
        while done < n:
            if not single and best[done] + unknown > best[done + 1]:
                best[done + 1] = best[done] + unknown
                count[done + 1] = count[done] + (len(text[done].encode()) if self.byte_fallback else 1)
            done, single = done + 1, False
        return best[n], count[n]

    def batch(self, raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(scores, counts) of the texts that ``offs`` delimits in ``raw``."""
        if self.known.n > MOST_CHUNKS:
            self._clear()
        n = len(raw)
        cut = np.zeros(n + 1, dtype=bool)
        if self.by_chunk and n > 1:
            blank = raw == 0x20
            cut[1:n] = blank[1:] & ~blank[:-1]
            after = np.flatnonzero((raw[:-3] == 0xE2) & (raw[1:-2] == 0x96) & (raw[2:-1] == 0x81)) + 3 if n > 3 else []
            cut[after] = False  # a mark in the text is a blank too
        heads = offs[:-1][np.diff(offs) > 0]
        cut[heads] = True
        starts = np.flatnonzero(cut[:n])
        ends = np.append(starts[1:], n)
        h = hash_spans(raw, starts, ends)
        first = np.searchsorted(starts, heads)
        h[first] ^= np.uint64(0xA5A5A5A55A5A5A5A)  # a row's first chunk has a mark before it
        number = self.known.find(h)
        if len(new := np.flatnonzero(number < 0)):
            distinct, at, back = np.unique(h[new], return_index=True, return_inverse=True)
            is_first = np.zeros(len(starts), dtype=bool)
            is_first[first] = True
            data, at = raw.tobytes(), new[at]
            spans = zip(starts[at].tolist(), ends[at].tolist(), is_first[at].tolist(), strict=True)
            found = [self.search((MARK if f else "") + data[a:b].decode().replace(" ", MARK)) for a, b, f in spans]
            got = self.known.add(distinct)
            while self.known.n > len(self.scores):
                self.scores, self.counts = np.resize(self.scores, 2 * len(self.scores)), np.resize(self.counts, 2 * len(self.counts))
            self.scores[got], self.counts[got] = [x[0] for x in found], [x[1] for x in found]
            number[new] = got[back]
        rows = np.searchsorted(offs, starts, "right") - 1
        m = len(offs) - 1
        return np.bincount(rows, self.scores[number], m), np.bincount(rows, self.counts[number], m).astype(np.int64)


@lru_cache(maxsize=2)
def counter(path: str) -> UnigramCounter:
    """One for each worker and file; reads a SentencePiece model's pieces of the normal and user-defined kinds."""
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    return UnigramCounter({p.piece: float(p.score) for p in model.pieces if p.type in (1, 4)}, model.trainer_spec.byte_fallback)


def count_tokens(docs: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, n_tokens, best_score) of every whole text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = counter(vocabulary)
        for batch in batches:
            raw, offs = text_bytes(batch.column("text"))
            for a, b in slices(raw, offs):
                scores, counts = tool.batch(raw[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(counts), pa.array(scores)], names=["doc_id", "n_tokens", "best_score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(count, "doc_id long, n_tokens long, best_score double")
