"""Divergence audit of sources by language (operator 13).

Terms are runs of letters (A-Z lower-cased) and of anything beyond ASCII. A language keeps the terms that enough of its documents have. Sources
of a language are compared with one another over all kept terms (part ``pair``), and each source with its language term by term (part ``term``), on
smoothed shares in whole billionths:

    p = 1 + floor(10^9 (count + 2) / (N + 2 V)),   f(p, q) = floor((p - q)^2 / (p + q))

with N the counts' sum and V the kept terms. All of it is whole numbers (decimals in the division), so results don't depend on partitioning.

Pairs are sparse: a term that neither source has adds the baseline f(p0, q0), the same for all such terms. Terms that only one has are summed up by
that source's distinct counts, of which there are few. Terms that both have add a correction to these two sums; corrections are summed within tasks, block by block
of sources and part by part of the terms, so no pair of cells is ever a row. What leaves a task is one row for each pair of sources, as many as the result has.

Terms are ranked by radix selection (``operators.selection``): distributed histograms over ten bits of the values at a time find the cell that
a group's last place is in, then ties refine by the terms' UTF-8 bytes; only a cell's rows, ``SMALL`` at most, are put in order.

Counts are made within tasks first (slices of bounded size, terms known by 64-bit hashes of term and group inside one slice of a task's table), so
a term that every text has costs one row a task and group. One shuffle by language and term serves both the sums and the terms' document counts.

Edge cases: null text, lang and source count as ''; a group without terms has its rows of part ``pair`` (value 0 if its language keeps no
term); a language of one source has no pairs; very long texts and terms are taken whole; rows that repeat are documents of their own; an empty
table gives no rows; other columns don't matter. Tables on the way are deleted when the result is written.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.selection import SMALL, byte_digits, first_rows, long_digits
from .shared import finished, written
from .textkernel import LOWER, U64, HashIndex, find_words, give_back, hash_spans, mix, ragged, slices, text_bytes

#: Documents that a kept term has at least; places that are ranked in part ``term``.
LEAST_DOCS, TOP = 10, 10
#: Scale of shares, and what is added to counts.
SCALE, ADDED = 1_000_000_000, 2
#: Bits of the largest value: f(p, q) < p <= SCALE + 1 where p > q.
VALUE_BITS = 30
#: Counted terms, and their bytes, that a task holds before it sends them on.
MOST_TERMS, MOST_BYTES = 1_000_000, 64 << 20
#: Sources of a block, cells of a part, and terms looked at together in it.
BLOCK, PART_CELLS, ROWS = 192, 16_000, 4_096

TERM = np.zeros(256, dtype=bool)
TERM[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: Begins the mark of a group among the terms; no term has it.
MARK = "\x00"


class _Counts:
    """Occurrences and documents by (group, term) of a task."""

    def __init__(self) -> None:
        self.index, self.n, self.docs, self.group, self.size = HashIndex(), [], [], [], []
        self.held, self.bytes = [], 0

    def add(self, raw: np.ndarray, offs: np.ndarray, groups: np.ndarray) -> None:
        """groups: number of each row's group."""
        words = find_words(raw, offs, TERM)
        if not len(words.starts):
            return
        h = hash_spans(raw, words.starts, words.ends)
        row = words.row_of()
        # first by row, so that documents are counted, then by group
        _, first, times = np.unique(mix(h ^ mix(row.astype(U64) + U64(1))), return_index=True, return_counts=True)
        key, at, inverse = np.unique(mix(h[first] + mix(groups[row[first]].astype(U64) + U64(7))), return_index=True, return_inverse=True)
        n, docs, first = np.bincount(inverse, times).astype(np.int64), np.bincount(inverse), first[at]
        known = self.index.find(key)
        new = np.flatnonzero(known < 0)
        if len(new):
            known[new] = self.index.add(key[new])
            starts, sizes = words.starts[first[new]], words.ends[first[new]] - words.starts[first[new]]
            self.held.append(raw[ragged(starts, sizes)])
            self.bytes += int(sizes.sum())
            self.size.append(sizes)
            self.group.append(groups[row[first[new]]])
        self.n.append((known, n))
        self.docs.append((known, docs))
        if len(self.n) > 64:
            self.n, self.docs = [self._summed(self.n)], [self._summed(self.docs)]

    def _summed(self, parts: list) -> tuple[np.ndarray, np.ndarray]:
        out = np.zeros(self.index.n, np.int64)
        for at, x in parts:
            out[at] += x  # a part has each entry once
        return np.arange(len(out)), out

    def batches(self, langs: list[str], sources: list[str], rows: int = 50_000) -> Iterator[pa.RecordBatch]:
        """All entries, then a mark for each group."""
        names = ["lang", "source", "term", "n", "docs"]
        lang, source = pa.array(langs, pa.string()), pa.array(sources, pa.string())
        if self.index.n:
            (_, n), (_, docs), group = self._summed(self.n), self._summed(self.docs), np.concatenate(self.group)
            data, ends = np.concatenate(self.held), np.concatenate([[0], np.cumsum(np.concatenate(self.size))])
            for a in range(0, len(n), rows):
                b = min(len(n), a + rows)
                offsets = (ends[a : b + 1] - ends[a]).astype(np.int32)
                term = pa.StringArray.from_buffers(b - a, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data[ends[a] : ends[b]].tobytes()))
                g = pa.array(group[a:b])
                yield pa.RecordBatch.from_arrays([lang.take(g), source.take(g), term, pa.array(n[a:b]), pa.array(docs[a:b].astype(np.int64))], names=names)
        if langs:
            zero = pa.array(np.zeros(len(langs), np.int64))
            yield pa.RecordBatch.from_arrays([lang, source, pa.array([MARK + s for s in sources], pa.string()), zero, zero], names=names)


def count_terms(docs: DataFrame, most_terms: int = MOST_TERMS) -> DataFrame:
    """(lang, source, term, n, docs) counted within tasks, and a row with a mark for each group that a task meets."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, numbers = _Counts(), {}
        for batch in batches:
            raw, offs = text_bytes(batch.column("text"))
            raw = LOWER[raw]
            lang, source = batch.column("lang").to_pylist(), batch.column("source").to_pylist()
            for a, b in slices(raw, offs):
                groups = np.array([numbers.setdefault(g, len(numbers)) for g in zip(lang[a:b], source[a:b], strict=True)], dtype=np.int64)
                held.add(raw[offs[a] : offs[b]], offs[a : b + 1] - offs[a], groups)
                if held.index.n > most_terms or held.bytes > MOST_BYTES:
                    yield from held.batches([g[0] for g in numbers], [g[1] for g in numbers])
                    held, numbers = _Counts(), {}
        yield from held.batches([g[0] for g in numbers], [g[1] for g in numbers])

    return docs.select(text("lang"), text("source"), text("text")).mapInArrow(lambda it: give_back(count(it)), "lang string, source string, term string, n long, docs long")


def kept_cells(docs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(lang, source, term, n, n_lang, first) of kept terms, and the groups' marks. first: 1 on one row of each language and term."""
    cells = count_terms(docs).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    every = Window.partitionBy("lang", "term")
    cells = cells.withColumns({"n_lang": F.sum("n").over(every), "n_docs": F.sum("docs").over(every), "low": F.min("source").over(every)})
    marked = F.startswith("term", F.lit(MARK))
    return cells.filter(marked | (F.col("n_docs") >= least_docs)).select("lang", "source", "term", "n", "n_lang", (~marked & (F.col("source") == F.col("low"))).cast("long").alias("first"))


def _div(a: Column, b: Column) -> Column:
    """Whole division of numbers that aren't negative."""
    return F.call_function("div", a, b)


def share(count: Column, total: Column, terms: Column) -> Column:
    """p of a count; null where there are no kept terms."""
    whole = "decimal(20,0)"
    below = F.nullif((total + 2 * terms).cast(whole), F.lit(0).cast(whole))
    return _div((count.cast(whole) + ADDED) * F.lit(SCALE).cast("decimal(10,0)"), below) + 1


def f(p: Column, q: Column) -> Column:
    """Divergence of two shares."""
    return _div((p - q) * (p - q), p + q)


def group_totals(cells: DataFrame) -> DataFrame:
    """(lang, source, n_group, n_all, terms, p0) of every group."""
    sums = written(cells.groupBy("lang", "source").agg(F.sum("n").alias("n_group"), F.sum("first").alias("first")), "groups")
    langs = sums.groupBy("lang").agg(F.sum("n_group").alias("n_all"), F.sum("first").alias("terms"))
    out = sums.drop("first").join(langs, "lang")
    return written(out.withColumn("p0", share(F.lit(0), F.col("n_group"), F.col("terms"))), "totals")


def _f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def _corrections(cells: pa.Table) -> pa.Table:
    """Of the cells of two blocks of sources in a part of a language's terms: (low, high, value) by pair of sources.

    For a term that both have, f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0); it is 0 where one of them hasn't the term and so has its p0.
    """
    names, term = pc.dictionary_encode(cells["source"].combine_chunks()), pc.dictionary_encode(cells["term"].combine_chunks())
    source, row, p = names.indices.to_numpy(), term.indices.to_numpy().astype(np.int64), cells["p"].to_numpy()
    order = np.array(sorted(range(len(names.dictionary)), key=lambda k: names.dictionary[k].as_py().encode()))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    source = rank[source]
    m = len(order)
    p0, block = np.zeros(m, np.int64), np.zeros(m, np.int64)
    p0[source], block[source] = cells["p0"].to_numpy(), cells["block"].to_numpy()
    total = np.zeros((m, m), np.int64)
    base = _f(p0[:, None], p0[None, :])
    by = np.argsort(row, kind="stable")
    source, row, p = source[by], row[by], p[by]
    one_block = len(np.unique(block)) < 2 and cells["low_block"][0].as_py() == cells["high_block"][0].as_py()
    for a in range(0, int(row[-1]) + 1, ROWS):
        lo, hi = np.searchsorted(row, [a, a + ROWS])
        if lo == hi:
            continue
        dense = np.repeat(p0[None, :], min(ROWS, int(row[hi - 1]) + 1 - a), axis=0)
        dense[row[lo:hi] - a, source[lo:hi]] = p[lo:hi]
        for g in range(m):
            with_g = row[lo:hi][source[lo:hi] == g] - a
            others = np.arange(g + 1, m) if one_block else np.flatnonzero((block != block[g]) & (np.arange(m) > g))
            if len(with_g) and len(others):
                mine, theirs = dense[with_g, g][:, None], dense[np.ix_(with_g, others)]
                total[g, others] += (_f(mine, theirs) - _f(mine, p0[others]) - _f(p0[g], theirs) + base[g, others]).sum(axis=0)
    low, high = np.nonzero(total)
    sorted_names = names.dictionary.take(pa.array(order))
    return pa.table({"lang": pa.repeat(cells["lang"][0], len(low)), "low": sorted_names.take(pa.array(low)), "high": sorted_names.take(pa.array(high)), "value": pa.array(total[low, high])}, schema=_PAIR)


_PAIR = pa.schema([("lang", pa.string()), ("low", pa.string()), ("high", pa.string()), ("value", pa.int64())])


def _pair_sums(cells: DataFrame, totals: DataFrame) -> DataFrame:
    """(lang, low, high, value) of every pair of sources of a language, low before high. cells: with p and p0."""
    other = totals.select("lang", F.col("source").alias("other"), F.col("p0").alias("q0"))
    low, high = F.least("source", "other").alias("low"), F.greatest("source", "other").alias("high")
    # terms that neither has: as if all were such
    base = totals.join(other, "lang").filter(F.col("source") < F.col("other"))
    base = base.select("lang", low, high, F.coalesce(F.col("terms") * f(F.col("p0"), F.col("q0")), F.lit(0)).alias("value"))
    # terms that one has: by its distinct shares
    counts = written(cells.groupBy("lang", "source", "p", "p0").agg(F.count(F.lit(1)).alias("m")), "counts")
    alone = counts.join(other, "lang").filter(F.col("source") != F.col("other")).select("lang", low, high, (F.col("m") * (f(F.col("p"), F.col("q0")) - f(F.col("p0"), F.col("q0")))).alias("value"))
    # terms that both have: blocks of sources and parts of terms; a cell goes to every block that its own meets
    size = totals.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks")).join(cells.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / PART_CELLS).alias("parts")), "lang")
    size = written(size, "sizes")  # a row a language: known to be small when it is small, and else a side that Spark can split for a hot language
    block = F.pmod(F.xxhash64("source"), F.col("blocks"))
    dealt = cells.join(size, "lang").withColumns({"block": block, "part": F.pmod(F.xxhash64("term"), F.col("parts"))})
    dealt = dealt.withColumn("meets", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.select("lang", "part", F.least("block", "meets").alias("low_block"), F.greatest("block", "meets").alias("high_block"), "block", "source", "term", "p", "p0")
    both = dealt.groupBy("lang", "part", "low_block", "high_block").applyInArrow(_corrections, "lang string, low string, high string, value long")
    return base.unionByName(alone).unionByName(both).groupBy("lang", "low", "high").agg(F.sum("value").alias("value"))


COLUMNS = ("lang", "source", "part", "item", "value", "rank")


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP, small: int = SMALL) -> DataFrame:
    """(lang, source, part, item, value, rank): all other sources by divergence, and the ``top`` terms that a source has too much of."""

    def make() -> DataFrame:
        every = written(kept_cells(docs, least_docs), "cells")
        totals = group_totals(every)
        cells = every.filter(~F.startswith("term", F.lit(MARK))).join(totals, ["lang", "source"])
        shares = cells.select(
            "lang", "source", "term", share(F.col("n"), F.col("n_group"), F.col("terms")).alias("p"), "p0", share(F.col("n_lang"), F.col("n_all"), F.col("terms")).alias("q"),
        )
        shares = written(shares, "shares")
        sums = written(_pair_sums(shares, totals), "pairs")
        both_ways = sums.select("lang", F.col("low").alias("source"), F.col("high").alias("item"), "value").unionByName(sums.select("lang", F.col("high").alias("source"), F.col("low").alias("item"), "value"))
        place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))  # over as many rows as sources
        pairs = both_ways.withColumn("rank", place).withColumn("part", F.lit("pair"))
        over = written(shares.filter("p > q").select("lang", "source", F.col("term").alias("item"), f(F.col("p"), F.col("q")).alias("value")), "terms")
        digits = chain(long_digits(F.col("value"), VALUE_BITS, 10, True), byte_digits(F.col("item")))
        terms = first_rows(over, ["lang", "source"], top, digits, [F.desc("value"), F.asc("item")], small).withColumnRenamed("place", "rank").withColumn("part", F.lit("term"))
        return pairs.select(*COLUMNS).unionByName(terms.select(*COLUMNS))

    return finished(docs.sparkSession, "divergence", make)
