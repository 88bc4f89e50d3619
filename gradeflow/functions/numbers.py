"""Elementwise and array number functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CLIP, FLOOR = 10.0, 1e-8


def penalty(x: Column, kind: str, beta: float = 1.0) -> Column:
    """identity; exp or clipped_exp: exp(beta * x) with x held within 10 of zero; softplus of the same."""
    z = F.lit(beta) * F.greatest(F.lit(-CLIP), F.least(F.lit(CLIP), x))
    if kind == "identity":
        return x
    if kind in ("exp", "clipped_exp"):
        return F.exp(z)
    if kind == "softplus":
        return F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z)))
    raise ValueError(f"unknown transform {kind!r}")


def ordered_bits(x: Column) -> Column:
    """A double as a long that sorts as it does: its bits, of negative ones less than zero. Both zeros are 0, NaN is largest.

    Spark has no function for a double's bits; powers of two are exact, and so is what is multiplied by them.
    """
    size = F.abs(x)
    guess = F.floor(F.log2(size))
    power = lambda e: F.pow(F.lit(2.0), e.cast("double"))
    e = F.when(power(guess) > size, guess - 1).when(power(guess + 1) <= size, guess + 1).otherwise(guess)
    whole = F.lit(float(1 << 52))
    normal = (e + 1023).cast("long") * F.lit(1 << 52) + ((size * power(-e) - 1) * whole).cast("long")
    tiny = (size * F.lit(2.0**537) * F.lit(2.0**537)).cast("long")
    bits = F.when(F.isnan(x), F.lit((2047 << 52) + 1)).when(size == F.lit(float("inf")), F.lit(2047 << 52)).when(size == 0, F.lit(0)).when(size < F.lit(2.0**-1022), tiny).otherwise(normal)
    return F.when(x.isNotNull(), F.when((x < 0) & ~F.isnan(x), -bits).otherwise(bits))


def to_percent(x: Column) -> Column:
    """Times 100."""
    return x * 100


def subsequence_index(seq: Column, template: Column) -> Column:
    """Index after the first place where ``template`` lies in ``seq``; 0 if nowhere or if the template is empty. Null elements equal each other.

    Elements are written as hex between commas, so one text search finds the place and the commas before it are the index.
    """
    text = lambda xs: F.concat(F.lit(","), F.array_join(F.transform(xs, lambda x: F.coalesce(F.hex(F.encode(x.cast("string"), "UTF-8")), F.lit("-"))), ","), F.lit(","))
    whole, m = text(seq), F.size(template)
    at = F.when((m > 0) & (F.size(seq) > 0), F.instr(whole, text(template)))
    before = F.substring(whole, F.lit(1), at - 1)
    commas = F.length(before) - F.length(F.replace(before, F.lit(","), F.lit("")))
    return F.when(seq.isNotNull() & template.isNotNull(), F.when(at > 0, commas + m).otherwise(F.lit(0))).cast("long")
