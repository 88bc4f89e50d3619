"""Aggregates of grades, scores and weights."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import FLOOR
from ..sources.scratch import written
from .selection import SMALL, find_cuts, in_cell, number_digits


def accuracy(correct: Column) -> Column:
    """Share of true values; 0 where there is none."""
    return F.coalesce(F.avg(correct.cast("double")), F.lit(0.0))


def mean_stderr(df: DataFrame, keys: Sequence[str], x: str) -> DataFrame:
    """(keys, mean, stderr, n) of non-null values; the standard error of one value is 0, of none null."""
    n = F.count(x)
    return df.groupBy(*keys).agg(F.avg(x).alias("mean"), F.when(n == 1, F.lit(0.0)).otherwise(F.stddev_samp(x) / F.sqrt(n)).alias("stderr"), n.alias("n"))


def mean_of_means(df: DataFrame, outer: Sequence[str], inner: str, x: str) -> DataFrame:
    """``mean_stderr`` over the means of an inner group."""
    return mean_stderr(df.groupBy(*outer, inner).agg(F.avg(x).alias("_m")), outer, "_m")


def pmf(df: DataFrame, keys: Sequence[str], score: str, bins: Sequence[int]) -> DataFrame:
    """(keys, bin, n, share) for every bin, empty ones too; shares are of the values in range, null if there are none."""
    counts = df.filter(F.col(score).isin(list(bins))).groupBy(*keys, F.col(score).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    grid = df.select(*keys).distinct().select(*keys, F.explode(F.lit(list(bins))).alias("bin"))
    full = grid.join(counts, [*keys, "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))
    return full.withColumn("share", F.try_divide(F.col("n"), F.sum("n").over(Window.partitionBy(*keys))))


def moments_and_mass(df: DataFrame, keys: Sequence[str], x: str, tiebreak: str, share: float = 0.2, small: int = SMALL) -> DataFrame:
    """(keys, mean, std of the population, top share of the mass, n): the largest int(share * n) values, one at least. Null values don't count.

    Values are written once. The cut is found by radix refinement over their ordered bits (see ``selection``): rows are put in order only within
    a cell of ``small`` rows at most, and not at all where a cell's values are all equal.
    """
    keys = list(keys)
    rows = written(df.filter(F.col(x).isNotNull()).select(*keys, F.col(x).cast("double").alias(x), tiebreak), "weights")
    stats = rows.groupBy(*(F.col(c).alias(f"_stat_{c}") for c in keys)).agg(F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), F.count(F.lit(1)).alias("n"), F.sum(x).alias("_sum"))
    cuts, digits = find_cuts(rows, keys, lambda n: F.greatest(F.lit(1), F.floor(n * share)), number_digits(F.col(x), descending=True), measure=x, small=small)
    few = (F.col("_cell") > F.col("_need")) & (F.col("_cell") <= small)
    w = Window.partitionBy(*(f"_cut_{c}" for c in keys)).orderBy(F.desc(x), tiebreak)
    inside = in_cell(rows, cuts.filter(few), keys, digits).withColumn("_r", F.row_number().over(w)).filter("_r <= _need")
    partial = inside.groupBy(*(F.col(f"_cut_{c}").alias(f"_part_{c}") for c in keys)).agg(F.sum(x).alias("_part"))
    same = lambda a, b: reduce(and_, (F.col(f"{a}_{c}").eqNullSafe(F.col(f"{b}_{c}")) for c in keys), F.lit(True))
    top = F.col("_above") + F.when(F.col("_cell") <= F.col("_need"), F.col("_in")).otherwise(F.coalesce("_part", F.col("_in") / F.col("_cell") * F.col("_need")))
    out = stats.join(cuts, same("_stat", "_cut")).join(partial, same("_stat", "_part"), "left")
    return out.select(*(F.col(f"_stat_{c}").alias(c) for c in keys), "mean", "std", (top / F.greatest(F.col("_sum"), F.lit(1e-12))).alias("top_mass"), "n")


def mean_one(df: DataFrame, keys: Sequence[str], x: str, out: str) -> DataFrame:
    """``df`` with values divided by their group's mean; as they are if their sum isn't positive."""
    means = df.groupBy(*keys).agg(F.avg(x).alias("_mean"), F.sum(x).alias("_sum"))
    return df.join(means, list(keys)).withColumn(out, F.when(F.col("_sum") > 0, F.col(x) / F.col("_mean")).otherwise(F.col(x))).drop("_mean", "_sum")


def shifted(df: DataFrame, keys: Sequence[str], x: str, out: str) -> DataFrame:
    """``df`` with values less their group's smallest, which comes out just above zero."""
    return df.join(df.groupBy(*keys).agg(F.min(x).alias("_low")), list(keys)).withColumn(out, F.col(x) - F.col("_low") + FLOOR).drop("_low")


def masked_mean(x: Column, mask: Column) -> Column:
    """Mean of the values under a mask, by one at least."""
    return F.coalesce(F.sum(F.when(mask, x)), F.lit(0.0)) / F.greatest(F.count(F.when(mask, 1)), F.lit(1))
