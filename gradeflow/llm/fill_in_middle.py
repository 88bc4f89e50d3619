"""Fill-in-middle transformation (operator 12).

A ``tokenizers`` ``Split`` pre-tokenizer with isolated matches of a pattern cuts a text into units; nothing is trained. It supplies
the units' code-point offsets: how many there are gives ``n``, and the offsets at two ranks drawn from a hash of the identifier give
where prefix and middle end. All else is column functions: slices, the output in one of three forms, and the text restored from it.

Forms: ``psm`` is prefix, suffix, middle; ``spm`` suffix, prefix, middle, each after its sentinel; ``plain`` is the text itself, taken
for texts that are empty or hold a sentinel, and for the share of texts that ``Recipe.rate`` leaves out.

Choices depend on the identifier alone, so rows that repeat are cut alike and partitioning doesn't matter. Nothing is
shuffled. A task holds the offsets of one text at a time.

Edge cases: null texts count as empty and are plain; a null identifier hashes as the empty text; very long texts and lines are cut
whole; an empty table gives no rows; other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textkernel import give_back

#: Lines with their breaks.
LINES = r"[^\n]*\n|[^\n]+"


@dataclass(frozen=True)
class Recipe:
    """unit: pattern of units, whose matches must cover any text; rate, spm: percent of texts transformed, and of those in suffix-first form."""

    unit: str = LINES
    seed: int = 7
    rate: int = 100
    spm: int = 50
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def __post_init__(self) -> None:
        marks = (self.prefix, self.suffix, self.middle)
        # else a mark could stand across the border of a mark and a text without marks
        if any(not a or (a in b and i != j) or any(a.endswith(b[:k]) for k in range(1, len(b))) for i, a in enumerate(marks) for j, b in enumerate(marks)):
            raise ValueError(f"marks must not be empty, hold one another or begin as one ends: {marks}")


def draws(doc_id: Column, seed: int) -> list[Column]:
    """Four unsigned 32-bit numbers from the sha256 of seed and identifier."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def cut_points(rows: DataFrame, unit: str) -> DataFrame:
    """(doc_id, text, h1..h4) -> the same with n, and at, to: code points where the first and the second cut are."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Regex
        from tokenizers.pre_tokenizers import Split

        splitter = Split(Regex(unit), behavior="isolated")
        for batch in batches:
            found = []
            for text, *h in zip(*(batch.column(c) for c in ("text", "h1", "h2")), strict=True):  # one text's offsets at a time
                ends = [0, *(end for _, (_, end) in splitter.pre_tokenize_str(text.as_py()))]
                ranks = sorted(x.as_py() % len(ends) for x in h)  # there is one more place to cut than units
                found.append((len(ends) - 1, ends[ranks[0]], ends[ranks[1]]))
            more = [pa.array(list(x), pa.int64()) for x in (zip(*found, strict=True) if found else ((), (), ()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, "n", "at", "to"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(lambda it: give_back(cut(it)), f"{kinds}, n long, at long, to long")


def _slice(text: Column, start: Column, end: Column) -> Column:
    return F.substring(text, (start + 1).cast("int"), (end - start).cast("int"))


def transform(docs: DataFrame, recipe: Recipe = Recipe()) -> DataFrame:
    """(doc_id, n, form, output, prefix_chars, middle_chars) of every row; lengths are null if the form is plain."""
    text = F.coalesce("text", F.lit(""))
    h = draws(F.col("doc_id"), recipe.seed)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), *(x.alias(f"h{k}") for k, x in enumerate(h, 1)))
    rows = cut_points(rows, recipe.unit)
    marks = [recipe.prefix, recipe.suffix, recipe.middle]
    marked = F.lit(False)
    for m in marks:
        marked = marked | F.contains("text", F.lit(m))
    plain = (F.col("text") == "") | marked | (F.col("h3") % 100 >= recipe.rate)
    form = F.when(plain, F.lit("plain")).when(F.col("h4") % 100 < recipe.spm, F.lit("spm")).otherwise(F.lit("psm"))
    prefix, middle = _slice(F.col("text"), F.lit(0), F.col("at")), _slice(F.col("text"), F.col("at"), F.col("to"))
    suffix = F.substring(F.col("text"), (F.col("to") + 1).cast("int"), F.length("text"))
    p, s, m = (F.lit(x) for x in marks)
    output = F.when(F.col("form") == "psm", F.concat(p, prefix, s, suffix, m, middle)).when(F.col("form") == "spm", F.concat(s, suffix, p, prefix, m, middle)).otherwise(F.col("text"))
    cut = lambda x: F.when(F.col("form") != "plain", x)
    return rows.withColumn("form", form).select("doc_id", "n", "form", output.alias("output"), cut(F.col("at")).alias("prefix_chars"), cut(F.col("to") - F.col("at")).alias("middle_chars"))


def restore(output: Column, form: Column, recipe: Recipe = Recipe()) -> Column:
    """The exact text from an output and its form: in an output that isn't plain each sentinel stands once (see ``Recipe``)."""
    after = lambda mark: F.substring_index(output, mark, -1)
    between = lambda a, b: F.substring_index(F.substring_index(output, b, 1), a, -1)
    p, s, m = recipe.prefix, recipe.suffix, recipe.middle
    psm = F.concat(between(p, s), after(m), between(s, m))
    spm = F.concat(between(p, m), after(m), between(s, p))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def report(done: DataFrame, recipe: Recipe = Recipe()) -> DataFrame:
    """Digests of a transformation: (doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256)."""
    digest = lambda x: F.sha2(x, 256)
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restore(F.col("output"), F.col("form"), recipe)).alias("restored_sha256"))
