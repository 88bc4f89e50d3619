"""Grades of traces against solutions.

Equality has three tiers. Equal texts, plain numbers (compared exactly as canonical decimals of any length) and small ratios (cross-multiplied) are decided
in columns. All else goes to ``functions.algebra``: typed answers (numbers and expressions, tuples, intervals, sets, unions) and
identity testing of expressions. There is no tolerance but for roots and functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.algebra import any_equal
from ..sources import scratch

PLAIN = r"^[-+]?(?:\d+(?:\.\d*)?|\.\d+)$"
#: Short numbers and their ratios to whole numbers: products of two are exact decimals.
RATIO = r"^[-+]?\d{1,9}(?:\.\d{0,9})?(?:\s*/\s*\d{1,9})?$"

#: Compared pairs of so many bytes at most, with so many a pair besides its texts, are broadcast; more are joined by shuffle.
BROADCAST_BYTES, PAIR_BYTES = 1 << 25, 64


def canonical(plain: Column) -> Column:
    """A plain number without needless zeros and signs: equal numbers have equal forms, of any length."""
    return F.regexp_replace(F.regexp_replace(plain, r"^(?:\+|(-))?0*(\d*)(?:(\.\d*[1-9])0*|\.?0*)$", "$1$2$3"), "^-$", "")


def _parts(ratio: Column) -> tuple[Column, Column]:
    """Of a text that is a ratio. An empty text isn't cast: each failing cast makes an exception with its stack."""
    at = lambda k: F.nullif(F.trim(F.split_part(ratio, F.lit("/"), F.lit(k))), F.lit(""))
    return at(1).try_cast("decimal(18,9)"), F.coalesce(at(2).try_cast("decimal(9,0)"), F.lit(1).cast("decimal(9,0)"))


def decided(a: Column, b: Column) -> Column:
    """Whether two answers are equal where columns can tell; null where they can't or one is null. Numbers are compared in a lambda: where there are two, and
    out of the compiled code, which the JVM doesn't compile further where it is long."""
    return F.when(a == b, F.lit(True)).when(a.isNotNull() & b.isNotNull(), T.bind(F.struct(a.alias("a"), b.alias("b")), lambda x: _same_numbers(x["a"], x["b"])))


def _same_numbers(a: Column, b: Column) -> Column:
    both = lambda pattern: F.regexp_like(a, F.lit(pattern)) & F.regexp_like(b, F.lit(pattern))
    (n, d), (m, e) = _parts(a), _parts(b)
    return F.when(both(PLAIN), canonical(a) == canonical(b)).when(both(RATIO) & (d != 0) & (e != 0), n * e == m * d)


def wanted(gold: Column) -> Column:
    """A gold answer as it is compared."""
    return T.comparable(gold)


def _asked(known: list[Column], answers: list[Column], want: Column) -> list[Column]:
    """Answers that columns can't decide; all null if one is known to be right: such rows don't leave the JVM."""
    return [F.when(~_right(known) & k.isNull() & want.isNotNull(), a) for k, a in zip(known, answers, strict=True)]


def _right(known: list[Column]) -> Column:
    return F.coalesce(F.greatest(*known) if len(known) > 1 else known[0], F.lit(False))


def same_answer(a: Column, b: Column) -> Column:
    """Whether two answers are equal; false if either is null."""
    known = decided(a, b)
    return F.coalesce(known, any_equal(b, F.when(known.isNull() & b.isNotNull(), a)), F.lit(False))


def with_same(df: DataFrame, a: str, b: str, out: str, turned: str | None = None) -> DataFrame:
    """``df`` with whether two answers, as they are compared, are equal, and whether they are when ``turned``; false if either is null.

    Each pair of different texts is brought to its compared form and compared once, however many rows have it: distinct pairs are written, then joined to
    the rows by both texts. Comparing is dear for a text's few bytes, so pairs are dealt by number, not by size.
    """
    spark = df.sparkSession
    pairs = df.select(F.col(a).alias("_a"), F.col(b).alias("_b")).dropna().distinct().repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = pairs.withColumns({"_x": T.kept(T.comparable(F.col("_a"))), "_y": T.kept(T.comparable(F.col("_b")))})
    tests = {out: ("_x", "_y")} | ({turned: ("_y", "_x")} if turned else {})
    rows = rows.withColumns({f"_k_{c}": T.kept(decided(F.col(x), F.col(y))) for c, (x, y) in tests.items()})
    asked = {c: any_equal(F.col(y), F.when(F.col(f"_k_{c}").isNull(), F.col(x))) for c, (x, y) in tests.items()}
    judged = scratch.written(rows.select("_a", "_b", *(F.coalesce(f"_k_{c}", test, F.lit(False)).alias(c) for c, test in asked.items())), "pairs")
    size = judged.agg(F.sum(F.length("_a") + F.length("_b") + PAIR_BYTES)).first()[0] or 0
    found = df.join(F.broadcast(judged) if size <= BROADCAST_BYTES else judged, (F.col(a) == F.col("_a")) & (F.col(b) == F.col("_b")), "left")
    return found.withColumns({c: F.coalesce(c, F.lit(False)) for c in tests}).drop("_a", "_b")


def grade(df: DataFrame, trace: str, gold: str, prefix: str) -> DataFrame:
    """``grades`` of one trace a row."""
    return grades(df, {prefix: trace}, gold)


def grades(df: DataFrame, traces: dict[str, str], gold: str, complete: str | None = None) -> DataFrame:
    """``df`` with {prefix}_extracted_answer and {prefix}_correct of each trace, by its prefix, found independently; both null where there is no trace.

    Right is a trace of which any variant (three at most) has an answer equal to the gold one. ``complete`` names a column of whether the first trace has a
    closed box. Every step is a column of its own, so nothing is worked out twice. All texts of a row take a step at once: each step in Python keeps a worker
    a core, so there are two of them (boxes that are too deep for the pattern, answers that columns can't decide), however many traces a row has.
    """
    prefixes = list(traces)
    at = [f"{n}{k}" for n in range(len(prefixes)) for k in range(3)]
    texts = {i: F.col(traces[prefixes[int(i[0])]]) if i[1] == "0" else F.col(f"_t{i}") for i in at}
    rows = df.withColumns({f"_v{n}": T.trace_variants(F.col(traces[p])) for n, p in enumerate(prefixes)} | {"_want": wanted(F.col(gold))})
    rows = rows.withColumns({f"_t{i}": F.get(f"_v{i[0]}", F.lit(int(i[1]))) for i in at if i[1] != "0"})
    rows = rows.withColumns({f"_s{i}": T.kept(T.boxed_spans(t)) for i, t in texts.items()})
    rows = rows.withColumns({f"_r{i}": T.kept(T.real_spans(F.col(f"_s{i}"))) for i in at})
    rows = rows.withColumns({f"_o{i}": T.kept(T.given_answer(t, F.col(f"_r{i}"))) for i, t in texts.items()})
    rows = rows.withColumns({f"{p}_extracted_answer": T.kept(T.answer_of(F.col(traces[p]), F.col(f"_r{n}0"))) for n, p in enumerate(prefixes)} | {f"_g{i}": T.kept(T.comparable(F.col(f"_o{i}"))) for i in at})
    rows = rows.withColumns({f"_k{i}": T.kept(decided(F.col(f"_g{i}"), F.col("_want"))) for i in at})
    mine = {n: [i for i in at if i[0] == str(n)] for n in range(len(prefixes))}
    known, answers = ({n: [F.col(f"_{c}{i}") for i in own] for n, own in mine.items()} for c in "kg")
    rows = rows.withColumns({f"_a{i}": T.kept(a) for n, own in mine.items() for i, a in zip(own, _asked(known[n], answers[n], F.col("_want")), strict=True)} | {f"_known{n}": _right(known[n]) for n in mine})
    rows = rows.withColumns({f"_equal{n}": T.kept(any_equal(F.col("_want"), *(F.col(f"_a{i}") for i in own))) for n, own in mine.items()})
    right = {f"{p}_correct": F.when(F.col(traces[p]).isNotNull(), F.col(f"_known{n}") | F.coalesce(f"_equal{n}", F.lit(False))) for n, p in enumerate(prefixes)}
    if complete:
        right[complete] = F.size("_s00") > 0
    return rows.withColumns(right).drop("_want", *(f"_{c}{n}" for c in ("v", "known", "equal") for n in mine), *(f"_{c}{i}" for c in "tsrogka" for i in at))


def is_correct(df: DataFrame, trace: str, gold: str, out: str = "correct") -> DataFrame:
    """``df`` with whether a trace is right; false where there is none."""
    rows = grade(df, trace, gold, "_only")
    return rows.withColumn(out, F.coalesce("_only_correct", F.lit(False))).drop("_only_correct", "_only_extracted_answer")


RECORD = ("example_id", "split", "method", "prompt", "trace", "af_final_answer_only", "raw_correct", "af_correct", "raw_extracted_answer", "af_extracted_answer")


def records(df: DataFrame, *more: str) -> DataFrame:
    """Graded traces as typed records of ten fields, and more columns as they are."""
    flags = ("raw_correct", "af_correct")
    return df.select(*(F.col(c).cast("boolean" if c in flags else "string").alias(c) for c in RECORD), *more)


def with_forced(traces: DataFrame, forced: DataFrame, key: str, column: str) -> DataFrame:
    """Traces with their forced answers, matched by key and never by place; null where there is none."""
    return traces.join(forced.select(key, column), key, "left")


def compact(df: DataFrame) -> DataFrame:
    """Final grades: those of the forced answer where there are any, else those of the raw trace."""
    return df.withColumn("correct", F.coalesce("af_correct", "raw_correct")).withColumn("extracted_answer", F.coalesce("af_extracted_answer", "raw_extracted_answer"))


def inspection(df: DataFrame, forced: str) -> DataFrame:
    """As ``compact``, but a forced trace counts even if nothing was extracted from it."""
    pick = lambda c: F.when(F.col(forced).isNotNull(), F.col(f"af_{c}")).otherwise(F.col(f"raw_{c}"))
    return df.withColumn("correct", pick("correct")).withColumn("extracted_answer", pick("extracted_answer"))


def valid_scores(df: DataFrame, score: str) -> DataFrame:
    """Rows with a judge's score from 1 to 5."""
    return df.filter(F.col(score).between(1, 5))


def method_label(method: Column, gamma: Column) -> Column:
    """poe methods carry their gamma."""
    return F.when(method == "poe", F.concat(F.lit("poe_gamma_"), gamma.cast("string"))).otherwise(method)


def split_of(example_id: Column) -> Column:
    """Split that an example id begins with."""
    return F.split_part(example_id, F.lit("_"), F.lit(1))
