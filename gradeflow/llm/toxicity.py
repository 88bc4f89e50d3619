"""Toxicity by a weighted lexicon, matched with Aho-Corasick on folded text (operator 2).

Folding: lower case, compatibility forms of letters, homoglyphs of other scripts as Latin letters, digits and signs that
stand for letters as those letters; letters that are commonly taken for one another (i, l, 1) are one. What is
left of a text is words of letters, each after a blank.

The lexicon holds word beginnings (a whole word ends with a blank) with weights: smoothed log odds of the number of toxic
and other training documents with such a word, less a margin for chance. Exception phrases are pairs of neighbouring words around a match that are met
in other documents rather than toxic ones, plus those given by the caller; a match inside one does not count. A
text's density is its matched weight over its words; a logistic curve fitted on training documents turns it into a score. Entries are
chosen in ``PASSES``: after the first, toxic training documents that the lexicon matches already are left out of the counts, so that terms
which few toxic documents share are found too.

Bounds: the fit looks at ``labelled.MOST_LABELLED`` documents at most; the lexicon has ``MOST_ENTRIES`` entries and
as many exceptions at most, which are broadcast.

Edge cases: null and empty texts have density 0 and get that score; without labels of both kinds the lexicon is
empty and every score is 0; very long texts are matched whole; labels that are null are ignored; rows that repeat are each
scored; an empty table gives no rows; other columns don't matter.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import labelled
from .shared import broadcast, discard, written
from .textkernel import give_back

#: Entries of the lexicon, and exception phrases, at most.
MOST_ENTRIES = 2_000
#: Lengths of word beginnings, in letters; least toxic documents with an entry; least log odds.
SHORTEST, LONGEST, LEAST_DOCS, LEAST_ODDS = 3, 8, 3, 1.8
#: Entries with less than this share of a pass's best odds are left out: they are side effects of better ones. Passes over the training documents.
LEAST_SHARE, PASSES = 0.6, 3
#: Rows of a batch that are looked at together.
ROWS = 500
#: Words added to a text's length, so that one match in a few words is no certainty.
PRIOR_WORDS = 5

# Letters of other scripts, and digits and signs, that look like Latin letters.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ё": "e", "һ": "h", "н": "h", "і": "i", "ї": "i", "ј": "j", "к": "k", "м": "m", "о": "o", "р": "p",
    "ѕ": "s", "т": "t", "у": "y", "ѵ": "v", "ԝ": "w", "х": "x", "ӏ": "l", "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "μ": "m", "µ": "m", "ν": "v", "ο": "o", "ρ": "p",
    "σ": "o", "τ": "t", "υ": "u", "χ": "x", "γ": "y", "ω": "w", "ı": "i", "ł": "l", "ø": "o", "ɑ": "a", "ɡ": "g", "ɩ": "i", "ո": "n", "օ": "o", "ս": "u", "ց": "g",
    "0": "o", "1": "l", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "€": "e", "£": "l",
}
#: Marks without width, inside words.
UNSEEN = "­​‌‍⁠﻿"


class _Folding(dict):
    """Code point -> folded text, worked out when first met."""

    def __missing__(self, code: int) -> str:
        c = unicodedata.normalize("NFKC", chr(code)).lower()
        c = "".join(HOMOGLYPHS.get(x, x) for x in c)
        if chr(code) in UNSEEN:
            c = ""
        elif not all(x.isalpha() or unicodedata.combining(x) for x in c):
            c = " " if chr(code) != "|" else "i"
        out = self[code] = c.replace("l", "i")
        return out


FOLD = _Folding()
SPACES = re.compile(" +")


def fold(text: str | None) -> str:
    """Words of letters, each after one blank, and a blank at the end."""
    return SPACES.sub(" ", f" {(text or '').lower().translate(FOLD)} ")


@dataclass
class Lexicon:
    """entries: folded word beginning -> weight; exceptions: folded pairs of words; slope, offset: of the logistic curve."""

    entries: dict[str, float] = field(default_factory=dict)
    exceptions: tuple[str, ...] = ()
    slope: float = 0.0
    offset: float = -50.0

    def automaton(self) -> ahocorasick.Automaton | None:
        """All beginnings and exceptions, each after a blank."""
        if not self.entries:
            return None
        tree = ahocorasick.Automaton()
        for word, weight in self.entries.items():
            tree.add_word(f" {word}", (len(word) + 1, weight))
        for phrase in self.exceptions:
            tree.add_word(f" {phrase} ", (len(phrase) + 2, None))
        tree.make_automaton()
        return tree


def matches(tree: ahocorasick.Automaton | None, folded: str) -> dict[int, float]:
    """Place of a matched word -> its heaviest entry; without words inside exception phrases."""
    found: dict[int, float] = {}
    free: list[tuple[int, int]] = []
    for end, (size, weight) in tree.iter(folded) if tree is not None else ():
        at = end - size + 1
        if weight is None:
            free.append((at, end))
        elif weight > found.get(at, 0.0):
            found[at] = weight
    if free:  # one sweep over matches and phrases, both in order of their starts
        free.sort()
        reach, k = -1, 0
        for at in sorted(found):
            while k < len(free) and free[k][0] <= at:
                reach, k = max(reach, free[k][1]), k + 1
            if at < reach:
                del found[at]
    return found


def density(found: dict[int, float], folded: str) -> float:
    """Matched weight by length, on a logarithmic scale."""
    return float(np.log1p(100 * sum(found.values()) / (folded.count(" ") - 1 + PRIOR_WORDS))) if found else 0.0


def curve(lexicon: Lexicon, x: np.ndarray) -> np.ndarray:
    """Scores of densities."""
    return 1 / (1 + np.exp(-np.clip(lexicon.slope * x + lexicon.offset, -50, 50)))


def _beginnings(folded: str) -> set[str]:
    out = set()
    for w in set(folded.split(" ")):
        out.update(w[:k] for k in range(SHORTEST, min(LONGEST, len(w)) + 1))
        if w:
            out.add(f"{w} ")
    return out


def _counted(rows: DataFrame, of) -> DataFrame:
    """(term, toxic, other): documents of either kind with a term; ``of``: folded text -> its terms. Summed within each task first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = (Counter(), Counter())
        for batch in batches:
            for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True):
                by[label > 0].update(of(fold(text)))
        terms = list(by[0] | by[1])
        for a in range(0, len(terms), 50_000):
            part = terms[a : a + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), *(pa.array([by[k][t] for t in part], pa.int64()) for k in (1, 0))], names=["term", "toxic", "other"])

    counted = rows.select("text", "label").mapInArrow(count, "term string, toxic long, other long")
    return counted.groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))


def _odds(n_toxic: int, n_other: int, margin: float):
    """Smoothed log odds of a term, less what chance makes of few documents (in standard errors)."""
    a, b = F.col("toxic") + 0.5, F.col("other") + 0.5
    return F.log(a / (n_toxic + 1)) - F.log(b / (n_other + 1)) - margin * F.sqrt(1 / a + 1 / b)


def _pruned(found: list[tuple[str, int, float]]) -> dict[str, float]:
    """Without entries whose own beginning is an entry of nearly the same weight."""
    out: dict[str, float] = {}
    for word, _, odds in sorted(found, key=lambda x: (len(x[0]), x[0])):
        if not any(out.get(word[:k], 0.0) >= odds - 0.3 for k in range(SHORTEST, len(word))):
            out[word] = odds
    return out


def _unmatched(rows: DataFrame, held) -> DataFrame:
    """Rows without toxic ones that the lexicon matches."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = _tree(held)
        for batch in batches:
            for a in range(0, batch.num_rows, ROWS):
                part = batch.slice(a, ROWS)
                on = [not label > 0 or not matches(tree, fold(text)) for text, label in zip(part.column("text").to_pylist(), part.column("label").to_pylist(), strict=True)]
                yield part.filter(pa.array(on, pa.bool_()))

    return rows.select("text", "label").mapInArrow(keep, "text string, label int")


def _entries(rows: DataFrame, n_toxic: int, n_other: int, margin: float) -> dict[str, float]:
    """Weighted word beginnings that tell toxic rows from others."""
    best = _counted(rows, _beginnings).withColumn("odds", _odds(n_toxic, n_other, margin)).filter((F.col("toxic") >= LEAST_DOCS) & (F.col("odds") >= LEAST_ODDS))
    # bounded: the lexicon's size is a parameter, and a word has so many beginnings at most, of which pruning leaves one
    best = best.select("term", "toxic", "odds").orderBy(F.desc("odds"), "term").limit((LONGEST - SHORTEST + 2) * MOST_ENTRIES)
    found = [tuple(r) for r in best.collect()]
    return _pruned([x for x in found if x[2] >= LEAST_SHARE * found[0][2]])


def fit(rows: DataFrame, exceptions: Sequence[str] = ()) -> Lexicon:
    """Learns entries, exceptions and the curve from (text, label): see ``labelled.sample`` for their bound."""
    spark = rows.sparkSession
    n = {bool(r[0]): r[1] for r in rows.groupBy((F.col("label") > 0).alias("toxic")).count().collect()}
    if len(n) < 2:
        return Lexicon()
    given, entries, left, n_left, held = tuple(fold(e).strip() for e in exceptions), {}, rows, n[True], None
    for turn in range(PASSES):
        margin = 3.0 if turn else 1.64  # what is left may be there by chance, so it takes more to count
        more = {e: w for e, w in _entries(left, n_left, n[False], margin).items() if e not in entries} if n_left >= LEAST_DOCS else {}
        if not more:
            break
        entries = dict(sorted((entries | more).items(), key=lambda x: (-x[1], x[0]))[:MOST_ENTRIES])
        if held is not None:
            held.destroy()
        held = spark.sparkContext.broadcast(Lexicon(entries, given))
        left = _unmatched(rows, held)
        n_left = left.filter("label > 0").count()
    lexicon = Lexicon(entries, given)
    if held is not None:
        held.destroy()
    if not lexicon.entries:
        return lexicon
    held = spark.sparkContext.broadcast(lexicon)

    def pairs(folded: str) -> set[str]:
        out = set()
        for at in matches(_tree(held), folded):
            end = folded.find(" ", at + 1)
            before = folded.rfind(" ", 0, at) if at else -1
            after = folded.find(" ", end + 1)
            if before >= 0:
                out.add(folded[before + 1 : end])
            if after >= 0:
                out.add(folded[at + 1 : after])
        return out

    benign = _counted(rows, pairs).filter((F.col("other") >= LEAST_DOCS) & (_odds(n[True], n[False], 0.0) < -1)).orderBy(F.desc("other"), "term").limit(MOST_ENTRIES)
    lexicon = Lexicon(lexicon.entries, tuple(dict.fromkeys([*lexicon.exceptions, *(r[0] for r in benign.select("term").collect())])))
    held_all = spark.sparkContext.broadcast(lexicon)
    held.destroy()
    points = np.array([(r[0], r[1]) for r in scored(rows.select("text", "label"), held_all, ["label int"]).select("density", "label").collect()], dtype=float)
    held_all.destroy()
    lexicon.slope, lexicon.offset = _logistic(points[:, 0], points[:, 1] > 0)
    return lexicon


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset by Newton steps, both kinds weighing the same, with a small penalty that keeps separated data finite."""
    w = np.where(y, 0.5 / max(1, y.sum()), 0.5 / max(1, (~y).sum()))
    X, beta = np.stack([x, np.ones_like(x)], axis=1), np.zeros(2)
    for _ in range(60):
        p = 1 / (1 + np.exp(-X @ beta))
        grad = X.T @ (w * (p - y)) + 1e-4 * beta
        hess = (X.T * (w * p * (1 - p))) @ X + 1e-4 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        beta -= step * min(1.0, 4 / max(1e-9, np.abs(step).max()))
    return float(beta[0]), float(beta[1])


@lru_cache(maxsize=4)
def _tree_of(key: tuple, exceptions: tuple) -> ahocorasick.Automaton | None:
    return Lexicon(dict(key), exceptions).automaton()


def _tree(held) -> ahocorasick.Automaton | None:
    lexicon = held.value
    return _tree_of(tuple(lexicon.entries.items()), lexicon.exceptions)


def scored(rows: DataFrame, held, keep: Sequence[str]) -> DataFrame:
    """``keep`` ("name type") columns with density, matched words and score. held: a broadcast Lexicon."""
    names = [k.split()[0] for k in keep]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, tree = held.value, _tree(held)
        for batch in batches:
            dense, hits = [], []
            for value in batch.column("text"):  # one text at a time: long ones aren't held together
                folded = fold(value.as_py())
                found = matches(tree, folded)
                hits.append(len(found))
                dense.append(density(found, folded))
            x = np.array(dense)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(x), pa.array(hits, pa.int64()), pa.array(curve(lexicon, x))], names=[*names, "density", "n_matched", "score"])

    return rows.mapInArrow(lambda it: give_back(score(it)), ", ".join([*keep, "density double", "n_matched long", "score double"]))


def is_held_out():
    """The contract's fold."""
    return F.pmod(labelled.id_crc(F.col("doc_id")), F.lit(3)) == 1


def learn(docs: DataFrame, labels: DataFrame, exceptions: Sequence[str] = ()) -> Lexicon:
    """The lexicon of the training fold. Its sample is written once, since every pass reads it."""
    rows = written(labelled.sample(docs, labels, "toxic", ~is_held_out()).select("text", "label"), "labelled")
    try:
        return fit(rows, exceptions)
    finally:
        discard(rows)


def score_documents(docs: DataFrame, lexicon: Lexicon, threshold: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted, n_matched) of every row."""
    held = broadcast(docs.sparkSession, lexicon)
    out = scored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), held, ["doc_id long"])
    return out.select("doc_id", is_held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "n_matched")


def drop_toxic(docs: DataFrame, lexicon: Lexicon, threshold: float = 0.7) -> DataFrame:
    """``docs`` without rows that score ``threshold`` or more; all columns are kept, nothing is shuffled."""
    held = broadcast(docs.sparkSession, lexicon)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, tree = held.value, _tree(held)
        for batch in batches:
            for a in range(0, batch.num_rows, ROWS):
                part = batch.slice(a, ROWS)
                folded = (fold(value.as_py()) for value in part.column("text"))
                x = np.array([density(matches(tree, f), f) for f in folded], dtype=float)
                yield part.filter(pa.array(curve(lexicon, x) < threshold))

    return docs.mapInArrow(lambda it: give_back(clean(it)), docs.schema)
