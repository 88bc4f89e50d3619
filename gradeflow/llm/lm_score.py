"""Language-model scores from a log-frequency Bloom filter (operator 4).

Training counts words and runs of 2 to ``order`` tokens of all training texts. Each task sums its own and sends sorted hashes and counts
in packets, one for each part of the hash space, so a hot word or run costs one entry a task. Runs met ``least`` times
or more enter the filter with their quantised count: level j is stored as the j keys (run, 1) ... (run, j), and read by probing
1, 2, ... until a key is missing. For each context (a run's tokens before its last) the filter also holds the mass K of its kept runs, the sum of their
counts as the filter gives them back, as a power of two and eighths of it, and D, a quantised count of the context itself (K at least), read by
probes in the same way. With these
    p_k(w | h) = (q(hw) + (D(h) - K(h) + KAPPA) p_(k-1)(w | h')) / (D(h) + KAPPA),    p_1(w) = (c + 0.1) / (N + 0.1 (V + 1)),
h' being h without its first token: what runs left out would have goes to the shorter context. That is a probability: q sums up to K, but for the
rounding of K (6 percent at most, 2 on average) and false positives. A false positive would add to the sum for each of the V words, so the first key of a run is looked up in ``presence`` places, so many that
V words have 0.1 false ones together; keys of contexts in two, all others in one.

The filter is an array of 64-bit words; a place is one of them and a mask of up to 8 of its bits, and takes ``PLACE_BITS`` bits of the array.

Bounds of what is sent to workers: the filter has its precision at every size and travels in blocks of at most
``MOST_FILTER_MB``, cut by part of the hash space. Where there are several, each is one more pass over the rows, which adds the levels
of its part to a column of four bytes a token and order (written after each pass, so that a worker holds one block). The exact word counts travel in blocks of at most ``BLOCK_WORDS`` words; every
block is one more pass over the rows, and the passes' sums add up. Everything else is tables in the shared folder.
Words and runs are known by 64 and 48 bits of hash.

Edge cases: null and empty texts have the end token only; without training rows every count is 0 and every token has probability 1; very long texts are scored whole; rows that repeat are each scored; an empty table gives no rows; other
columns don't matter.
"""

from __future__ import annotations

import itertools
import math
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import id_crc
from .shared import broadcast, discard, parts_bits, written
from .textkernel import LOWER, NOT_SPACE, U64, find_words, give_back, hash_spans, mix, slices, text_bytes, trim

#: Tokens of the longest run; least count of a kept run (1 keeps all); base of the quantised counts; weight of the shorter run's probability.
ORDER, LEAST, BASE, KAPPA = 2, 2, 2.0, 4.0
#: No count of 64 bits has a higher level; steps of K between powers of two.
MOST_LEVEL, STEPS = 120, 8
#: Bits of the filter for each place of a key, and how often a place is taken where a key wasn't put in (measured, for the number of places).
PLACE_BITS, FALSE_PLACE = 18, 0.003
#: False runs that all words together may have in a context.
FALSE_RUNS = 0.1
#: Limits of what is sent to workers, and tokens that a task sums before it sends them.
MOST_FILTER_MB, BLOCK_WORDS, FLUSH_TOKENS = 160, 8_000_000, 1_500_000
#: Bytes of text whose words and pairs make one part of the hash space, which is merged, and is a segment of the filter, by itself; most bits of parts.
PART_BYTES, MOST_BITS = 4 << 20, 16

END, BEGIN = U64(0x5D1E5D1E0E0E0E01), U64(0x5D1E5D1E0B0B0B01)
POWER_TAG, STEP_TAG, COUNT_TAG = U64(0x1B873593CC9E2D51), U64(0x85EBCA6BC2B2AE35), U64(0x27D4EB2F165667C5)
#: Levels of a token and order: of its run, and of its context's power, step and count.
LEVELS = 4


def tokens(raw: np.ndarray, offs: np.ndarray, order: int = ORDER) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """(token hashes, for each order from 2 on the hashes of the contexts before them, row of each token): words of each row, then an end."""
    w = find_words(LOWER[raw], offs, NOT_SPACE)
    h, row, m = hash_spans(w.raw, w.starts, w.ends), w.row_of(), len(offs) - 1
    out, rows = np.empty(len(h) + m, dtype=U64), np.empty(len(h) + m, dtype=np.int64)
    at = np.arange(len(h)) + row
    out[at], rows[at] = h, row
    ends = w.rows[1:] + np.arange(m)
    out[ends], rows[ends] = END, np.arange(m)
    firsts = np.concatenate([[0], ends[:-1] + 1])
    contexts, run = [], out
    for _ in range(order - 1):
        before = np.empty_like(run)
        before[1:] = run[:-1]
        before[firsts] = BEGIN
        contexts.append(before)
        run = pair_hash(before, out)
    return out, contexts, rows


def pair_hash(before: np.ndarray, token: np.ndarray) -> np.ndarray:
    """Hash of a run from that of its context and its last token; the upper 48 bits are what is kept."""
    return mix(before * U64(0x9E3779B97F4A7C15) + token)


def _sum_by(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sorted distinct keys and the sums of values by key."""
    if not len(keys):
        return (keys, *values)
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return (keys[first], *(np.add.reduceat(v[order].astype(np.int64), first) for v in values))


PACKET = "kind string, part int, keys binary, more binary, counts binary"


def _packets(kind: str, keys: np.ndarray, more: np.ndarray | None, counts: np.ndarray, bits: int) -> pa.RecordBatch:
    """Sorted keys cut into parts by their upper bits."""
    edges = np.searchsorted(keys, np.arange(1, 1 << bits).astype(U64) << U64(64 - bits))
    cut = lambda x: [p.tobytes() for p in np.split(x, edges)]
    n = 1 << bits
    data = [cut(keys), cut(more) if more is not None else [b""] * n, cut(counts)]
    full = [k for k in range(n) if data[0][k]]
    columns = [pa.array([kind] * len(full)), pa.array(full, pa.int32()), *(pa.array([d[k] for k in full], pa.binary()) for d in data)]
    return pa.RecordBatch.from_arrays(columns, names=["kind", "part", "keys", "more", "counts"])


def _count(batches: Iterator[pa.RecordBatch], bits: int, flush: int, order: int) -> Iterator[pa.RecordBatch]:
    held, n = [], 0

    def flushed() -> Iterator[pa.RecordBatch]:
        token, *contexts = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        words, c = _sum_by(token, np.ones(len(token), np.int64))
        yield _packets("word", words, None, c.astype(np.uint32), bits)
        for k, before in enumerate(contexts):
            runs = pair_hash(before, token)
            by = np.argsort(runs)
            runs, before = runs[by], before[by]
            first = np.flatnonzero(np.concatenate([[True], runs[1:] != runs[:-1]]))
            c = np.diff(np.append(first, len(runs)))
            # two columns of a key: the run's 48 bits, and the context's 48 bits
            yield _slim(_packets(f"run{k + 2}", runs[first] & U64(0xFFFFFFFFFFFF0000), (before[first] >> U64(16)), c.astype(np.uint32), bits))

    for batch in batches:
        raw, offs = text_bytes(batch.column("text"))
        for a, b in slices(raw, offs):
            token, contexts, _ = tokens(raw[offs[a] : offs[b]], offs[a : b + 1] - offs[a], order)
            held.append((token, *contexts))
            n += len(token)
            if n >= flush:
                yield from flushed()
                n = 0
    if held:
        yield from flushed()


def _slim(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Runs as six bytes of run and six of context, counts as one byte where that is enough."""
    six = lambda data, shift: (np.frombuffer(data, "<u8") >> U64(shift)).view(np.uint8).reshape(-1, 8)[:, :6].T.tobytes()
    keys = [six(x.as_py(), 16) for x in batch.column("keys")]
    more = [six(x.as_py(), 0) for x in batch.column("more")]
    counts = []
    for x in batch.column("counts"):
        c = np.frombuffer(x.as_py(), np.uint32)
        small = np.minimum(c, 255).astype(np.uint8)
        counts.append(small.tobytes() + c[small == 255].tobytes())
    return pa.RecordBatch.from_arrays([batch.column("kind"), batch.column("part"), *(pa.array(x, pa.binary()) for x in (keys, more, counts))], names=batch.schema.names)


def _wide(data: bytes) -> np.ndarray:
    six = np.frombuffer(data, np.uint8).reshape(6, -1).T
    out = np.zeros((len(six), 8), np.uint8)
    out[:, :6] = six
    return out.view("<u8").ravel()


def _counts(data: bytes, n: int) -> np.ndarray:
    small = np.frombuffer(data[:n], np.uint8).astype(np.int64)
    small[small == 255] = np.frombuffer(data[n:], np.uint32)
    return small


def _merged(packets: DataFrame, least: int) -> DataFrame:
    return packets.groupBy("kind", "part").applyInArrow(lambda table: _merge(table, least), PACKET)


def _merge(table: pa.Table, least: int) -> pa.Table:
    """One part's packets: exact word counts; kept runs with levels, and their mass by context (twice, to be whole)."""
    kind, part = table.column("kind")[0].as_py(), table.column("part")[0].as_py()
    if kind == "word":
        keys = np.concatenate([np.frombuffer(x.as_py(), "<u8") for x in table.column("keys")])
        keys, c = _sum_by(keys, np.concatenate([np.frombuffer(x.as_py(), np.uint32) for x in table.column("counts")]))
        rows = [("word", part, keys, keys[:0], c)]
    else:
        keys = [_wide(x.as_py()) for x in table.column("keys")]
        c = np.concatenate([_counts(x.as_py(), len(k)) for x, k in zip(table.column("counts"), keys, strict=True)])
        context, keys = np.concatenate([_wide(x.as_py()) for x in table.column("more")]), np.concatenate(keys)
        order = np.argsort(keys, kind="stable")
        keys, context, c = keys[order], context[order], c[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        c = np.add.reduceat(c, first)
        keys, context = keys[first], context[first]
        kept = c >= least
        keys, context, c = keys[kept], context[kept], c[kept]
        levels = level(c, least)
        by, mass = _sum_by(context, np.round(2 * values(least)[levels])) if len(c) else (context, c)
        rows = [(kind, part, keys, keys[:0], levels), (kind.replace("run", "context"), part, by, by[:0], mass)]
    return pa.table([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows], pa.int32()), *(pa.array([np.ascontiguousarray(r[k]).astype("<u8").tobytes() for r in rows], pa.binary()) for k in (2, 3, 4))], names=["kind", "part", "keys", "more", "counts"])


def level(c: np.ndarray, least: int = LEAST) -> np.ndarray:
    """Level of a count from ``least`` on; a level stands for counts of one power of ``BASE``."""
    return 1 + np.floor(np.log(np.maximum(c, least) / least) / np.log(BASE) + 1e-9).astype(np.int64)


@lru_cache(maxsize=8)
def values(least: int = LEAST) -> np.ndarray:
    """Count that each level stands for: the mean of the whole numbers in its range; 0 for level 0."""
    edges = np.ceil(least * BASE ** np.arange(MOST_LEVEL + 1.0) - 1e-9)
    return np.concatenate([[0.0], (edges[:-1] + np.maximum(edges[1:] - 1, edges[:-1])) / 2])


def mass_code(mass: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(power, step) of a mass: the power of two below it, from 1 on, and the eighths of that beyond it."""
    power = np.floor(np.log2(np.maximum(mass, 1))).astype(np.int64)
    return power + 1, np.minimum(STEPS - 1, np.floor((mass / 2.0**power - 1) * STEPS)).astype(np.int64)


def mass_of(power: np.ndarray, step: np.ndarray) -> np.ndarray:
    """The mass that a code stands for; 0 where there is none."""
    return np.where(power > 0, 2.0 ** (power - 1) * (1 + (np.minimum(step, STEPS - 1) + 0.5) / STEPS), 0.0)


def _contexts(table: pa.Table) -> pa.Table:
    """One part of the context space: codes of the masses of its contexts, and levels of their counts."""
    of = lambda c, mine: [np.frombuffer(x.as_py(), "<u8") for x, m in zip(table.column(c), table.column("more"), strict=True) if (m.as_py() == b"") == mine]
    none = [np.zeros(0, U64)]
    by, mass = _sum_by(np.concatenate(none + of("keys", True)), np.concatenate(none + of("counts", True)))
    keys, counts = np.concatenate(none + of("keys", False)), np.concatenate(none + of("counts", False))
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    at = np.minimum(np.searchsorted(keys, by), max(0, len(keys) - 1))
    count = np.where(keys[at] == by, counts[at], 0) if len(keys) else np.zeros(len(by))  # a text's begin has no count of its own
    mass = mass / 2
    power, step = mass_code(mass)
    kind, part = (table.column(c)[0].as_py() for c in ("kind", "part"))
    codes = np.stack([power, step, level(np.maximum(count, mass), 1)], axis=1) if len(by) else np.zeros((0, 3), np.int64)
    return pa.table([pa.array([kind]), pa.array([part], pa.int32()), pa.array([by.astype("<u8").tobytes()], pa.binary()), pa.array([b""], pa.binary()), pa.array([codes.astype("<u8").tobytes()], pa.binary())], names=["kind", "part", "keys", "more", "counts"])


def _dealt(batches: Iterator[pa.RecordBatch], bits: int, order: int, least: int) -> Iterator[pa.RecordBatch]:
    """Masses of contexts cut anew, by the context's own part; counts of words and runs as those of the contexts that they are (``more`` is set)."""
    for batch in batches:
        for r in batch.to_pylist():
            keys, counts = np.frombuffer(r["keys"], "<u8"), np.frombuffer(r["counts"], "<u8")
            if r["kind"].startswith("context"):
                edges = np.searchsorted(keys, np.arange(1, 1 << bits).astype(U64) << U64(48 - bits))
                pieces = [[p.tobytes() for p in np.split(x, edges)] for x in (keys, counts)]
                yield pa.RecordBatch.from_pylist([{"kind": r["kind"], "part": k, "keys": a, "more": b"", "counts": c} for k, (a, c) in enumerate(zip(*pieces, strict=True)) if a], schema=batch.schema)
            elif (k := 1 if r["kind"] == "word" else int(r["kind"][3:])) < order:
                keys, counts = (keys >> U64(16), counts) if k == 1 else (keys, values(least)[counts.astype(np.int64)])
                yield pa.RecordBatch.from_pylist([{"kind": f"context{k + 1}", "part": r["part"], "keys": keys.tobytes(), "more": b"count", "counts": counts.astype("<u8").tobytes()}], schema=batch.schema)


def _masks() -> np.ndarray:
    """4,096 sets of four bits of a word."""
    x = np.arange(4096, dtype=U64) + U64(1)
    out = np.zeros(4096, U64)
    for k in range(4):
        out |= U64(1) << (mix(x * U64(2 * k + 3)) >> U64(58))
    return out


MASKS = _masks()


def presence(n_words: int) -> int:
    """Places of a run's first key, so that ``n_words`` words have ``FALSE_RUNS`` false runs together."""
    return max(1, math.ceil(math.log(max(1, n_words) / FALSE_RUNS) / -math.log(FALSE_PLACE)))


def _place(keys: np.ndarray, j: int, k: int, n: np.ndarray | np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """(word, mask) of the k-th place of the keys (key, j) in segments of n (under 2 ** 32) words."""
    a = mix(keys + U64((j * 0xD6E8FEB86659FD93 + k * 0x9E3779B97F4A7C15) & (1 << 64) - 1))
    return ((a >> U64(32)) * n >> U64(32)).astype(np.int64), MASKS[(a & U64(0xFFF)).astype(np.int64)] | MASKS[(a >> U64(12) & U64(0xFFF)).astype(np.int64)]


def _places(tag: np.uint64 | int, first: int) -> tuple[int, int]:
    """Places of a key's first level and of the others; tag 0: runs."""
    return (2, 2) if tag else (first, 1)


def _sets(r: dict) -> list[tuple[np.uint64 | int, np.ndarray, np.ndarray]]:
    """(tag, keys, levels) that a row of runs or contexts puts in the filter."""
    keys, counts = np.frombuffer(r["keys"], "<u8"), np.frombuffer(r["counts"], "<u8").astype(np.int64)
    if r["kind"].startswith("run"):
        return [(0, keys, counts)]
    return [(tag, keys ^ tag, codes) for tag, codes in zip((POWER_TAG, STEP_TAG, COUNT_TAG), counts.reshape(-1, 3).T, strict=True)]


def _size(r: dict, first: int) -> int:
    """64-bit words of a row's segment."""
    n = 0
    for tag, _, levels in _sets(r):
        one, more = _places(tag, first)
        n += more * int(levels.sum()) + (one - more) * int((levels > 0).sum())
    return max(1, -(-n * PLACE_BITS // 64))


def _segment(batches: Iterator[pa.RecordBatch], first: int) -> Iterator[pa.RecordBatch]:
    """Each part's keys as 64-bit words."""
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            words = np.zeros(_size(r, first), dtype=U64)
            for tag, key, levels in _sets(r):
                j = 1
                while len(key := key[levels >= j]):
                    levels = levels[levels >= j]
                    for k in range(_places(tag, first)[j > 1]):
                        np.bitwise_or.at(words, *_place(key, j, k, U64(len(words))))
                    j += 1
            out.append({"kind": r["kind"], "part": r["part"], "n": len(words), "data": words.tobytes()})
        yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("kind", pa.string()), ("part", pa.int32()), ("n", pa.int64()), ("data", pa.binary())]))


class LogFrequencyFilter:
    """Segments of one kind, in a row; reads levels by repeated probes."""

    def __init__(self, sizes: dict[int, int], parts_bits: int, first: int) -> None:
        """sizes: 64-bit words of each part's segment; ``put`` fills them in, so that the array is held once."""
        self.shift, self.first = 48 - parts_bits, first
        self.n = np.ones(1 << parts_bits, dtype=U64)
        self.start = np.zeros(1 << parts_bits, dtype=np.int64)  # other parts are at the first word, which is empty
        at = 1
        for part, n in sorted(sizes.items()):
            self.n[part], self.start[part] = n, at
            at += n
        self.data = np.zeros(at, dtype=U64)

    def put(self, part: int, segment: bytes) -> None:
        """Fills a part's segment in."""
        self.data[self.start[part] : self.start[part] + int(self.n[part])] = np.frombuffer(segment, U64)

    def levels(self, keys: np.ndarray, tag: np.uint64 | int = 0) -> np.ndarray:
        """Levels of 48-bit keys; 0: not there."""
        part = (keys >> U64(self.shift)).astype(np.int64)
        start, n = self.start[part], self.n[part]
        out, on, j = np.zeros(len(keys), dtype=np.uint8), np.arange(len(keys)), 1
        keys = keys ^ U64(tag)
        while len(on) and j <= MOST_LEVEL:
            for k in range(_places(tag, self.first)[j > 1]):  # those that miss a place are asked no more
                word, mask = _place(keys, j, k, n)
                hit = self.data[start + word] & mask == mask
                on, keys, start, n = on[hit], keys[hit], start[hit], n[hit]
            out[on] = j
            j += 1
        return out


class Filters:
    """Runs and contexts whose hashes lie in the parts of one block."""

    def __init__(self, by_kind: dict[str, LogFrequencyFilter]) -> None:
        self.by_kind = by_kind

    def levels(self, token: np.ndarray, contexts: list[np.ndarray]) -> np.ndarray:
        """For each order ``LEVELS`` levels of each token; 0: not there, or in another block."""
        out = np.zeros((len(token), LEVELS * len(contexts)), np.uint8)
        for k, before in enumerate(contexts):
            runs, masses = (self.by_kind[f"{kind}{k + 2}"] for kind in ("run", "context"))
            context, back = np.unique(before >> U64(16), return_inverse=True)
            power = masses.levels(context, POWER_TAG)
            for n, tag in enumerate((STEP_TAG, COUNT_TAG)):
                found = np.zeros_like(power)
                found[power > 0] = masses.levels(context[power > 0], tag)
                out[:, LEVELS * k + 2 + n] = found[back]
            out[:, LEVELS * k + 1] = power[back]
            out[:, LEVELS * k] = runs.levels(pair_hash(before, token) >> U64(16))
        return out


def smoothed(p: np.ndarray, levels: np.ndarray, least: int) -> np.ndarray:
    """Probabilities of tokens from those of single tokens and the levels of their runs."""
    for k in range(0, levels.shape[1], LEVELS):
        run, power, step, count = (np.minimum(levels[:, k + n], MOST_LEVEL).astype(np.int64) for n in range(LEVELS))
        mass = mass_of(power, step)
        total = np.maximum(mass, values(1)[count]) + KAPPA
        p = (np.minimum(values(least)[run], mass) + (total - mass) * p) / total
    return p


class Model:
    """The broadcast blocks of the filters, totals, and what the model was trained with."""

    def __init__(self, filters: list, n: int, v: int, order: int, least: int) -> None:
        self.filters, self.n, self.v, self.order, self.least = filters, n, v, order, least


class Block:
    """Exact counts of the words whose hashes lie in one range, looked up by their upper bits first."""

    INDEX_BITS = 20

    def __init__(self, keys: np.ndarray, counts: np.ndarray, low: int, high: int) -> None:
        self.keys, self.counts, self.low, self.high = keys, counts, low, high
        self.edges = np.searchsorted(keys >> U64(64 - self.INDEX_BITS), np.arange((1 << self.INDEX_BITS) + 1).astype(U64))

    def find(self, h: np.ndarray) -> np.ndarray:
        """Counts, 0 where unknown."""
        if not len(self.keys):
            return np.zeros(len(h), np.int64)
        top = (h >> U64(64 - self.INDEX_BITS)).astype(np.int64)
        low, high = self.edges[top], self.edges[top + 1]
        for _ in range(int((high - low).max(initial=0)).bit_length()):
            middle = (low + high) >> 1
            less = (low < high) & (self.keys[np.minimum(middle, len(self.keys) - 1)] < h)
            low, high = np.where(less, middle + 1, low), np.where(less | (low >= high), high, middle)
        at = np.minimum(low, len(self.keys) - 1)
        return np.where(self.keys[at] == h, self.counts[at], 0).astype(np.int64)


def _ranges(keyed: DataFrame, most_filter_mb: float, first: int) -> list[dict[str, dict[int, int]]]:
    """Sizes of segments by kind and part, for ranges of parts that take at most ``most_filter_mb``; a part is never cut."""

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("kind"), b.column("part"), pa.array([_size(r, first) for r in b.to_pylist()], pa.int64())], names=["kind", "part", "n"])

    out, held = [defaultdict(dict)], 0.0
    # a row for each kind and part: 2 ** MOST_BITS parts at most
    rows = keyed.mapInArrow(sizes, "kind string, part int, n long").orderBy("part", "kind").collect()
    for part, own in itertools.groupby(rows, key=lambda r: r.part):
        own = list(own)
        mb = sum(r.n for r in own) * 8 / 1e6
        if held and held + mb > most_filter_mb:
            out.append(defaultdict(dict))
            held = 0.0
        for r in own:
            out[-1][r.kind][part] = r.n
        held += mb
    return out


def _filters(keyed: DataFrame, sizes: dict[str, dict[int, int]], bits: int, first: int, order: int) -> Filters:
    """The filters of one range of parts; the driver holds one block at a time, and that once."""
    out = {f"{kind}{k}": LogFrequencyFilter(sizes.get(f"{kind}{k}", {}), bits, first) for k in range(2, order + 1) for kind in ("run", "context")}
    parts = {part for found in sizes.values() for part in found}
    own = keyed.filter((F.col("part") >= min(parts, default=0)) & (F.col("part") <= max(parts, default=0)))
    for r in own.mapInArrow(lambda it: _segment(it, first), "kind string, part int, n long, data binary").toLocalIterator():
        out[r.kind].put(r.part, r.data)
    return Filters(out)


def train(docs: DataFrame, bits: int | None = None, most_filter_mb: float = MOST_FILTER_MB, block_words: int = BLOCK_WORDS, flush: int = FLUSH_TOKENS, order: int = ORDER, least: int = LEAST) -> tuple[Model, list]:
    """The model of all rows of ``docs`` and the broadcast blocks of word counts."""
    spark = docs.sparkSession
    bits = parts_bits(docs, PART_BYTES, MOST_BITS) if bits is None else bits
    packets = docs.select("text").mapInArrow(lambda it: give_back(_count(it, bits, flush, order)), PACKET)
    merged = written(_merged(packets, least), "lm-counts")
    dealt = merged.mapInArrow(lambda it: _dealt(it, bits, order, least), PACKET)
    contexts = written(dealt.groupBy("kind", "part").applyInArrow(_contexts, PACKET), "lm-contexts")
    total = {"n": 0, "v": 0}
    blocks, keys, counts, low = [], [], [], 0

    def close(high: int) -> None:
        nonlocal low
        own = np.concatenate([np.frombuffer(k, "<u8") for k in keys]) if keys else np.zeros(0, U64)
        blocks.append(broadcast(spark, Block(own, np.concatenate([np.frombuffer(c, "<u8") for c in counts]).astype(np.uint32) if counts else np.zeros(0, np.uint32), low, high)))
        keys.clear()
        counts.clear()
        low = high

    # the driver holds one block at a time, parts come in the order of their hashes
    held = 0
    for r in merged.filter("kind = 'word'").orderBy("part").toLocalIterator():
        c = np.frombuffer(r.counts, "<u8")
        if held and held + len(c) > block_words:
            close(r.part << (64 - bits))
            held = 0
        keys.append(r.keys)
        counts.append(r.counts)
        held += len(c)
        total["n"] += int(c.sum())
        total["v"] += len(c)
    close(1 << 64)
    keyed, first = merged.filter(F.startswith("kind", F.lit("run"))).unionByName(contexts), presence(total["v"])
    filters = [broadcast(spark, _filters(keyed, sizes, bits, first, order)) for sizes in _ranges(keyed, most_filter_mb, first)]
    trim()  # the driver's copies went to the broadcasts
    return Model(filters, total["n"], total["v"], order, least), blocks


SCORES = "n_tokens long, n_known long, base_score double, score double"
#: Bytes of text that are scored together.
SCORE_BYTES = 1 << 20


def _read_levels(batches: Iterator[pa.RecordBatch], filters, order: int) -> Iterator[pa.RecordBatch]:
    """Adds one filter block's levels to those of the blocks before: ``LEVELS`` bytes of each token and order."""
    filters = filters.value
    for batch in batches:
        raw, offs = text_bytes(batch.column("text"))
        for a, b in slices(raw, offs, SCORE_BYTES):
            part = batch.slice(a, b - a)
            token, contexts, row = tokens(raw[offs[a] : offs[b]], offs[a : b + 1] - offs[a], order)
            found = filters.levels(token, contexts)
            if "levels" in batch.schema.names:  # a key is in one block alone
                found = np.maximum(found, _levels_of(part, order))
            edges = LEVELS * (order - 1) * np.searchsorted(row, np.arange(b - a + 1))
            data = found.tobytes()
            levels = [data[x:y] for x, y in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text"), pa.array(levels, pa.binary())], names=["doc_id", "text", "levels"])


def _levels_of(part: pa.RecordBatch, order: int) -> np.ndarray:
    """Levels of all tokens of a batch's rows."""
    return np.frombuffer(b"".join(x.as_py() for x in part.column("levels")), np.uint8).reshape(-1, LEVELS * (order - 1))


def _score(batches: Iterator[pa.RecordBatch], facts: tuple[int, int, int, int], filters, block, keep: list[str]) -> Iterator[pa.RecordBatch]:
    """Adds one block's tokens to the sums; levels come from the only filter block, or else from their column. ``keep``: columns that go along."""
    (n, v, order, least), block, filters = facts, block.value, filters.value if filters is not None else None
    below = n + 0.1 * (v + 1)
    for batch in batches:
        raw, offs = text_bytes(batch.column("text"))
        before_sums = [batch.column(c).to_numpy() for c in ("n_tokens", "n_known", "base_score", "score")] if "score" in batch.schema.names else None
        for a, b in slices(raw, offs, SCORE_BYTES):
            token, contexts, row = tokens(raw[offs[a] : offs[b]], offs[a : b + 1] - offs[a], order)
            n_tokens = np.bincount(row, minlength=b - a)
            given = None if filters is not None else _levels_of(batch.slice(a, b - a), order)
            if block.low or block.high < 1 << 64:
                own = (token >= U64(block.low)) & (token <= U64(block.high - 1))
                token, contexts, row = token[own], [x[own] for x in contexts], row[own]
                given = given[own] if given is not None else None
            c = block.find(token)
            p = (c + 0.1) / below
            base = np.log10(p)
            p = smoothed(p, filters.levels(token, contexts) if given is None else given, least)
            m = b - a
            sums = [n_tokens.astype(np.int64), np.bincount(row[c > 0], minlength=m).astype(np.int64), np.bincount(row, base, m), np.bincount(row, np.log10(p), m)]
            if before_sums:
                sums = [sums[0], *(x + y[a:b] for x, y in zip(sums[1:], before_sums[1:], strict=True))]
            part = batch.slice(a, m)
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *(pa.array(x) for x in sums)], names=[*keep, "n_tokens", "n_known", "base_score", "score"])


def score(docs: DataFrame, model: Model, blocks: list) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of every row."""
    facts, one = (model.n, model.v, model.order, model.least), model.filters[0] if len(model.filters) == 1 else None
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    more, before = [] if one else ["levels"], None
    for filters in model.filters if more else []:
        out = written(out.mapInArrow(lambda it, filters=filters: give_back(_read_levels(it, filters, facts[2])), "doc_id long, text string, levels binary"), "lm-levels")
        if before is not None:
            discard(before)
        before = out
    types = {"doc_id": "doc_id long", "text": "text string", "levels": "levels binary"}
    for k, block in enumerate(blocks):
        keep = ["doc_id", "text", *more] if k + 1 < len(blocks) else ["doc_id"]  # the text goes along while it is needed
        out = out.mapInArrow(lambda it, block=block, keep=keep: give_back(_score(it, facts, one, block, keep)), ", ".join([*(types[c] for c in keep), SCORES]))
    return out.select("doc_id", "n_tokens", "n_known", F.lit(model.n).cast("long").alias("train_tokens"), "base_score", "score")


def is_held_out():
    """The contract's fold."""
    return F.pmod(id_crc(F.col("doc_id")), F.lit(10)) == 0
