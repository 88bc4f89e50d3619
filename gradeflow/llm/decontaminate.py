"""Benchmark decontamination by Wu-Manber multi-pattern search over words (operator 7).

A pattern is a window of ``WINDOW`` words of a benchmark item, or the whole item if it is shorter. For each pattern
length there is one searcher: a shift table over blocks of two words says how far every
position can be skipped, a bucket of the block at a window's end selects the patterns to test, and
their words are compared byte by byte. All rows of a slice are searched in step: the words are cut
into lanes, and in each step every lane moves on by its own shift.

The patterns are sent to the workers. Their size is bounded: the benchmark is read in blocks of at most ``BLOCK_WORDS``
words. Where there are several, each is one more pass over the rows, whose hits add to the former ones and are written after each pass, so
that a worker holds one block. Nothing is shuffled, so groups of copies and hot sources cost what other rows cost.

Edge cases: null texts and items have no words; an item without words gives no pattern; windows
that several items share count for each; rows of the benchmark that repeat an item_id are one item; windows of a null item_id hit words but
count as no item; an empty benchmark hits nothing; an empty table gives no rows; rows
that repeat are each returned; other columns of ``docs`` are kept out of the result but may have any name.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import broadcast, discard, free_name, written
from .textkernel import ALNUM, LOWER, U64, Words, find_words, give_back, hash_spans, list_array, mix, ragged, same_spans, slices, text_bytes

WINDOW = 13
#: Words of benchmark text whose patterns are sent to the workers together (some 100 bytes a word).
BLOCK_WORDS = 500_000
#: Positions of a lane, and bits of the shift table's index.
LANE, SHIFT_BITS = 512, 18


def words_of(raw: np.ndarray, offs: np.ndarray) -> Words:
    """The contract's words: A-Z in lower case, runs of letters, digits and bytes beyond ASCII."""
    return find_words(LOWER[raw], offs, ALNUM)


def _joined(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of the block that ends at each position; 0 where there is none."""
    if size == 1:
        return mix(h)
    out = np.zeros(len(h), U64)
    out[1:] = mix(h[:-1] * U64(0x9E3779B97F4A7C15) + h[1:])
    return out


class Searcher:
    """Patterns of one length in words."""

    def __init__(self, length: int, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, owners: list[list[int]]) -> None:
        """starts, ends: byte spans of the patterns' words, a row each; owners: items of each pattern."""
        self.length, self.raw, self.block = length, raw, min(2, length)
        n = len(owners)
        h = hash_spans(raw, starts.ravel(), ends.ravel()).reshape(n, length)
        most = length - self.block + 1
        self.shift = np.full(1 << SHIFT_BITS, most, dtype=np.uint8 if most < 256 else np.int32)
        suffix = None
        for at in range(self.block - 1, length):  # smallest distance from a block to its window's end
            key = mix(h[:, at]) if self.block == 1 else mix(h[:, at - 1] * U64(0x9E3779B97F4A7C15) + h[:, at])
            np.minimum.at(self.shift, key >> U64(64 - SHIFT_BITS), length - 1 - at)
            suffix = key
        order = np.argsort(suffix, kind="stable")
        self.suffix, self.starts, self.ends = suffix[order], starts[order], ends[order]
        self.first = h[order, 0]
        self.n_owners = np.array([len(owners[k]) for k in order])
        self.owners = np.array([i for k in order for i in owners[k]], dtype=np.int64)
        self.owner_at = np.cumsum(self.n_owners) - self.n_owners

    def find(self, words: Words, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first word, pattern) of all occurrences; a row's words are never joined with another row's."""
        total, m = len(h), self.length
        if total < m:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        keys = _joined(h, self.block)
        index = keys >> U64(64 - SHIFT_BITS)
        at = np.arange(m - 1, total, LANE)
        stop = np.minimum(at + LANE, total)
        tries = []
        while len(at):
            skip = self.shift[index[at]]
            tries.append(at[skip == 0])
            at = at + np.maximum(skip, 1)
            on = at < stop
            at, stop = at[on], stop[on]
        end = np.concatenate(tries)
        low, high = np.searchsorted(self.suffix, keys[end]), np.searchsorted(self.suffix, keys[end], "right")
        found = high > low
        end, low, size = end[found], low[found], (high - low)[found]
        end, pattern = np.repeat(end, size), ragged(low, size)
        begin = end - m + 1
        row = words.row_of()
        ok = (row[begin] == row[end]) & (h[begin] == self.first[pattern])
        begin, pattern = begin[ok], pattern[ok]
        return self._confirmed(words, begin, pattern)

    def _confirmed(self, words: Words, begin: np.ndarray, pattern: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Those whose words are the same bytes."""
        for k in range(self.length):
            a, b = words.starts[begin + k], self.starts[pattern, k]
            size = words.ends[begin + k] - a
            ok = size == self.ends[pattern, k] - b
            ok[ok] = same_spans(words.raw, a[ok], self.raw, b[ok], size[ok])
            begin, pattern = begin[ok], pattern[ok]
        return begin, pattern


def searchers(texts: list[str | None], window: int = WINDOW, numbers: list[int] | None = None) -> list[Searcher]:
    """One searcher for each length of pattern among the items, which are known by their ``numbers`` (or else positions)."""
    raw, offs = text_bytes(pa.array(texts, pa.string()))
    w = words_of(raw, offs)
    numbers = range(len(texts)) if numbers is None else numbers
    found: dict[int, dict[bytes, tuple[int, dict[int, None]]]] = defaultdict(dict)
    for item in range(len(texts)):
        a, b = int(w.rows[item]), int(w.rows[item + 1])
        size = min(window, b - a)
        for at in range(a, b - size + 1) if size else ():
            text = b" ".join(bytes(w.raw[w.starts[k] : w.ends[k]]) for k in range(at, at + size))
            found[size].setdefault(text, (at, {}))[1][numbers[item]] = None
    out = []
    for size, patterns in sorted(found.items()):
        spans = np.array([at for at, _ in patterns.values()])[:, None] + np.arange(size)
        out.append(Searcher(size, w.raw, w.starts[spans], w.ends[spans], [list(items) for _, items in patterns.values()]))
    return out


def _blocks(benchmark: DataFrame, block_words: int, window: int) -> Iterator[tuple[list[str | None], list[Searcher]]]:
    """(item_ids, searchers) of bounded size; the driver holds one block at a time."""

    def made() -> tuple[list[str | None], list[Searcher]]:
        names = list(dict.fromkeys(ids))
        number = {name: k for k, name in enumerate(names)}
        return names, searchers(texts, window, [number[i] for i in ids])

    ids, texts, size = [], [], 0
    for r in benchmark.select(F.col("item_id").cast("string"), "text").toLocalIterator():
        n = 1 + len(r[1] or "") // 4
        if ids and size + n > block_words:
            yield made()
            ids, texts, size = [], [], 0
        ids.append(r[0])
        texts.append(r[1])
        size += n
    if ids:
        yield made()


SCHEMA = "doc_id long, text string, n_words long, hit_words array<int>, items array<string>"


def _search(batches: Iterator[pa.RecordBatch], block) -> Iterator[pa.RecordBatch]:
    ids, tools = block.value
    names = np.array(ids, dtype=object)
    named = np.array([i is not None for i in ids], dtype=bool)
    for batch in batches:
        raw, offs = text_bytes(batch.column("text"))
        for a, b in slices(raw, offs):
            part = batch.slice(a, b - a)
            w = words_of(raw[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
            h = hash_spans(w.raw, w.starts, w.ends)
            rows, covered = w.row_of(), np.zeros(len(h) + 1, dtype=np.int64)
            pairs = []
            for tool in tools:
                begin, pattern = tool.find(w, h)
                np.add.at(covered, begin, 1)
                np.add.at(covered, begin + tool.length, -1)
                size = tool.n_owners[pattern]
                pairs.append(np.stack([np.repeat(rows[begin], size), tool.owners[ragged(tool.owner_at[pattern], size)]]))
            hit = np.flatnonzero(np.cumsum(covered)[:-1] > 0)
            hit_rows, hit_at = rows[hit], hit - w.rows[:-1][rows[hit]]
            pair = np.unique(np.concatenate(pairs, axis=1), axis=1) if pairs else np.zeros((2, 0), np.int64)
            hits = list_array(pa.array(hit_at.astype(np.int32)), np.bincount(hit_rows, minlength=b - a))
            pair = pair[:, named[pair[1]]] if len(named) else pair
            items = list_array(pa.array(names[pair[1]].tolist(), pa.string()), np.bincount(pair[0], minlength=b - a))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text"), pa.array(w.counts.astype(np.int64)), hits, items], names=["doc_id", "text", "n_words", "hit_words", "items"])


def find_contamination(docs: DataFrame, benchmark: DataFrame, block_words: int = BLOCK_WORDS, window: int = WINDOW) -> DataFrame:
    """(doc_id, text, n_words, hit_words: positions of hit words, items: item_ids with occurrences) for every row."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = block = held = None
    for made in _blocks(benchmark, block_words, window):
        if block is not None:  # a block more: what was found so far is written first, so that no worker holds two
            table = written(found, "contamination")
            block.destroy()
            if held is not None:
                discard(held)
            held = table
        block = broadcast(spark, made)
        found = _also(held, block) if held is not None else rows.mapInArrow(lambda it, block=block: give_back(_search(it, block)), SCHEMA)
    if found is None:
        none = broadcast(spark, ([], []))
        found = rows.mapInArrow(lambda it: _search(it, none), SCHEMA)
    return found


def _also(found: DataFrame, block) -> DataFrame:
    """The next block's hits beside the former ones."""

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for part in _search(iter([batch]), block):
                was = batch.slice(done, part.num_rows)
                done += part.num_rows
                yield pa.RecordBatch.from_arrays([*part.columns, was.column("hit_words"), was.column("items")], names=[*part.schema.names, "hits_before", "items_before"])

    more = found.mapInArrow(lambda it: give_back(both(it)), SCHEMA + ", hits_before array<int>, items_before array<string>")
    return more.select("doc_id", "text", "n_words", F.array_union("hit_words", "hits_before").alias("hit_words"), F.array_union("items", "items_before").alias("items"))


def is_contaminated(n_hit: Column, n_words: Column) -> Column:
    """The contract's rule: five percent of a document's words, one at least."""
    return (n_hit > 0) & (20 * n_hit >= n_words)


def report(found: DataFrame) -> DataFrame:
    """The digest columns of the contract."""
    n_hit = F.size("hit_words").cast("long")
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256).alias("items_sha256"), is_contaminated(n_hit, F.col("n_words")).alias("contaminated"),
    )


def _hits(batch: pa.RecordBatch, block) -> Iterator[tuple[int, int, np.ndarray, list[list[int]]]]:
    """(first row, end row, words of each row, places of its hit words) of a batch, slice by slice."""
    at = 0
    for part in _search(iter([batch]), block):
        hits = part.column("hit_words")
        sizes = np.diff(hits.offsets.to_numpy())
        yield at, at + part.num_rows, part.column("n_words").to_numpy(), [hits[k].as_py() if sizes[k] else [] for k in range(part.num_rows)]
        at += part.num_rows


def decontaminate(docs: DataFrame, benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` without contaminated rows: a filter within the tasks, on the searched text itself; all columns are kept."""
    spark, schema, hit = docs.sparkSession, docs.schema, free_name(docs, "_hit_words")
    names, before, last = docs.columns, docs, None
    for made in _blocks(benchmark, block_words, WINDOW):
        if last is not None:  # a block more: the last one's hits are written beside the rows, so that no worker holds two
            done = written(before.mapInArrow(lambda it, block=last: give_back(_marked(it, block, names, hit)), _with(schema, hit)), "hits")
            if before is not docs:
                discard(before)
            last.destroy()
            before = done
        last = broadcast(spark, made)
    if last is None:
        return docs

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for marked in _marked(batches, last, names, hit):
            n_hit = np.diff(marked.column(hit).offsets.to_numpy())
            n_words = np.array([len(words_of(*text_bytes(marked.column("text").slice(k, 1))).starts) if n else 0 for k, n in enumerate(n_hit.tolist())])
            keep = pa.array(~((n_hit > 0) & (20 * n_hit >= n_words)))
            yield pa.RecordBatch.from_arrays([marked.column(c).filter(keep) for c in names], names=names)

    return before.mapInArrow(lambda it: give_back(clean(it)), schema)


def _with(schema: T.StructType, hit: str) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField(hit, T.ArrayType(T.IntegerType()))])


def _marked(batches: Iterator[pa.RecordBatch], block, names: list[str], hit: str) -> Iterator[pa.RecordBatch]:
    """The rows with the places of their hit words, by this block and those before."""
    for batch in batches:
        for a, b, _, hits in _hits(batch, block):
            part = batch.slice(a, b - a)
            if hit in batch.schema.names:
                hits = [sorted({*x, *y}) if y else x for x, y in zip(hits, part.column(hit).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(hits, pa.list_(pa.int32()))], names=[*names, hit])
