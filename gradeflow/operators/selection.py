"""Exact selection of the first rows of each group by refinement of a radix histogram.

The order is a sequence of digits, most significant first, each of few values. A step counts the candidates of
each group by one digit (summed within tasks first), finds the cell that the group's k-th row is in, and leaves that cell's rows as candidates. It ends
when every group's cell has ``small`` rows at most or is taken as a whole, so no window ever sees more than that, whatever the values are: one outlier,
or half the rows equal, cost steps and not memory. Between steps there is one row a group, written as a table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import ordered_bits
from ..sources.scratch import discard, written

#: Rows of a cell that may be put in order together.
SMALL = 10_000


def number_digits(x: Column, bits: int = 16, descending: bool = False) -> list[Column]:
    """Digits of a double, of ``bits`` bits each, by its ordered bits."""
    return long_digits(ordered_bits(x), 64, bits, descending)


def long_digits(x: Column, size: int, bits: int = 10, descending: bool = False) -> list[Column]:
    """Digits of a long of ``size`` bits; of 64 bits it may be negative, of less it isn't."""
    out = []
    for shift in reversed(range(0, size, bits)):
        part = F.shiftright(x, shift)
        part = part if size == 64 and shift + bits >= 64 else part.bitwiseAND(F.lit((1 << bits) - 1).cast("long"))
        out.append(-part if descending else part)
    return out


def byte_digits(x: Column, bytes_a_digit: int = 2) -> Iterable[Column]:
    """Digits of a string's UTF-8 bytes, without end: a string that is over comes before longer ones."""
    k = 0
    while True:
        yield F.hex(F.substring(F.encode(x, "UTF-8"), k * bytes_a_digit + 1, bytes_a_digit))
        k += 1


def _matched(rows: DataFrame, cuts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``rows`` with the cut of their group; null keys are a group too."""
    on = F.lit(True)
    for k in keys:
        on = on & rows[k].eqNullSafe(cuts[f"_cut_{k}"])
    return rows.join(cuts, on)


def in_cell(rows: DataFrame, cuts: DataFrame, keys: Sequence[str], digits: Sequence[Column]) -> DataFrame:
    """Rows that are in their group's cell, with the group's cut."""
    on = F.lit(True)
    for i, d in enumerate(digits):
        on = on & ((F.col("_depth") <= i) | (F.coalesce(d.cast("string"), F.lit("")) == F.get("_at", F.lit(i))))
    return _matched(rows, cuts, keys).filter(on)


def find_cuts(rows: DataFrame, keys: Sequence[str], k: Callable[[Column], Column], digits: Iterable[Column], measure: str | None = None, small: int = SMALL) -> tuple[DataFrame, list[Column]]:
    """(cuts, digits used). rows: a table that is cheap to read again. k: how many rows of a group of so many are asked for.

    cuts, one row a group: _cut_<key>; _n, its rows; _need, rows wanted of the cell; _cell, rows in it; _depth, digits that the
    cell is known by; _at, these digits as text; with ``measure`` its sum over rows before the cell (_above) and in it (_in).
    """
    value = F.col(measure) if measure else F.lit(0.0)
    done, used = None, []
    for digit in digits:
        open_ = (F.col("_cell") > small) & (F.col("_cell") > F.col("_need"))
        if done is not None and done.filter(open_).isEmpty():
            break
        text = F.coalesce(digit.cast("string"), F.lit(""))
        if done is None:
            left = rows.select(*(F.col(c).alias(f"_cut_{c}") for c in keys), digit.alias("_d"), text.alias("_t"), value.alias("_v"))
            held = [F.lit(None).cast("long").alias("_held"), F.lit(0.0).alias("_before"), F.lit(None).cast("array<string>").alias("_path")]
        else:
            left = in_cell(rows, done.filter(open_), keys, used).select(*(f"_cut_{c}" for c in keys), digit.alias("_d"), text.alias("_t"), value.alias("_v"), "_need", "_above", "_at", "_n")
            held = [F.first("_need").alias("_held"), F.first("_above").alias("_before"), F.first("_at").alias("_path"), F.first("_n").alias("_rows")]
        by = [f"_cut_{c}" for c in keys]
        group, ahead = Window.partitionBy(*by), Window.partitionBy(*by).orderBy("_d").rowsBetween(Window.unboundedPreceding, -1)
        cells = left.groupBy(*by, "_d", "_t").agg(F.count(F.lit(1)).alias("_c"), F.sum("_v").alias("_s"), *(h for h in held if done is not None))
        if done is None:
            cells = cells.select("*", *held)
        cells = cells.withColumns({"_all": F.sum("_c").over(group), "_less": F.coalesce(F.sum("_c").over(ahead), F.lit(0)), "_sum_less": F.coalesce(F.sum("_s").over(ahead), F.lit(0.0))})
        want = F.least(F.coalesce(F.col("_held"), k(F.col("_all")).cast("long")), F.col("_all"))
        cells = cells.withColumn("_want", want).filter((F.col("_less") < F.col("_want")) & (F.col("_less") + F.col("_c") >= F.col("_want")))
        now = cells.select(
            *by, (F.col("_all") if done is None else F.col("_rows")).alias("_n"), (F.col("_want") - F.col("_less")).alias("_need"), F.col("_c").alias("_cell"), F.lit(len(used) + 1).alias("_depth"),
            F.concat(F.coalesce("_path", F.array().cast("array<string>")), F.array("_t")).alias("_at"), (F.col("_before") + F.col("_sum_less")).alias("_above"), F.col("_s").alias("_in"),
        )
        before, done = done, written(now if done is None else done.filter(~open_).unionByName(now), "cuts")
        discard(before)
        used.append(digit)
    return done, used


def first_rows(rows: DataFrame, keys: Sequence[str], k: int, digits: Iterable[Column], order: Sequence[Column], small: int = SMALL) -> DataFrame:
    """The first ``k`` rows of each group with ``place`` (from 1). order: the order that the digits are of."""
    if k < 1:
        return rows.limit(0).withColumn("place", F.lit(0))
    cuts, used = find_cuts(rows, keys, lambda n: F.lit(k), digits, small=small)
    found = _matched(rows, cuts, keys)
    ahead, equal = F.lit(False), F.lit(True)
    for i, d in enumerate(used):
        # digits are compared as what they are: the cut's text is cast back
        kind = rows.select(d.alias("d")).schema["d"].dataType
        at = F.get("_at", F.lit(i)).cast(kind)
        inside = F.col("_depth") > i
        ahead = ahead | (equal & inside & (d < at))
        equal = equal & (~inside | (d == at))
    found = found.withColumns({"_ahead": ahead, "_equal": equal})
    whole = F.col("_cell") <= F.col("_need")
    sure = found.filter(F.col("_ahead") | (F.col("_equal") & whole))
    within = F.row_number().over(Window.partitionBy(*(f"_cut_{c}" for c in keys)).orderBy(*order))
    tied = found.filter(F.col("_equal") & ~whole).withColumn("_r", within).filter("_r <= _need").drop("_r")
    place = F.row_number().over(Window.partitionBy(*(f"_cut_{c}" for c in keys)).orderBy(*order))  # over k rows
    return sure.unionByName(tied).withColumn("place", place).select(*rows.columns, "place")
