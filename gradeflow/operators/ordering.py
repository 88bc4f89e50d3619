"""Seeded order, positions, splits and samples that don't depend on partitioning.

A seeded shuffle is the order of ``md5(seed|key)``. Positions in it are found without a global sort: rows are counted by the
first hex digits of the hash, a prefix that holds too many rows is counted by more digits, and so on (a tree of prefixes); counts are summed up
from the root, and rows are numbered within their leaf only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import discard, written

#: Hex digits that a level of the tree adds; 3: 4096 counts under a node.
DIGITS = 3
#: Rows of a leaf at most.
LEAF_ROWS = 1_000_000


def seeded_hash(seed: int | str, *key: Column) -> Column:
    """Sort key of the seeded shuffle."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(k.cast("string") for k in key)))


def _prefix(size: int) -> Column:
    return F.substring("_h", 1, size)


def _tree(hashes: DataFrame, leaf_rows: int) -> list[DataFrame]:
    """Levels of the tree of prefixes of ``_h``: (_d, _count, _before, n_total); nodes of more than ``leaf_rows`` rows are counted anew on the next level."""
    levels: list[DataFrame] = []
    for size in range(DIGITS, 31, DIGITS):
        up = _prefix(size - DIGITS).alias("_up")
        rows = hashes.select("_h", up)
        if levels:
            full = levels[-1].filter(F.col("_count") > leaf_rows).select(F.col("_d").alias("_up"), F.col("_before").alias("_base"), "n_total")
            rows = rows.join(full, "_up", "left_semi")
        siblings = Window.partitionBy("_up").orderBy("_d")  # 4096 rows
        counts = rows.groupBy("_up", _prefix(size).alias("_d")).agg(F.count(F.lit(1)).alias("_count"))
        nodes = counts.withColumn("_before", F.coalesce(F.sum("_count").over(siblings.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        if levels:
            nodes = nodes.join(full, "_up").withColumn("_before", F.col("_before") + F.col("_base"))
        else:
            nodes = nodes.withColumn("n_total", F.sum("_count").over(siblings.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
        levels.append(written(nodes.select("_d", "_count", "_before", "n_total"), "positions"))
        if levels[-1].filter(F.col("_count") > leaf_rows).isEmpty():
            break
    return levels


def with_position(df: DataFrame, seed: int | str, *key: str, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """``df`` with ``pos`` (from 0, in the seeded order of a unique key) and ``n_total``.

    Counts are taken at once, a job a level: up to 4096 times ``leaf_rows`` rows have one level, whose 4096 counts at most are broadcast.
    """
    h = seeded_hash(seed, *(F.col(k) for k in key))
    levels = _tree(df.select(h.alias("_h")), leaf_rows)
    rows, leaves = df.withColumn("_h", h).withColumn("_d", F.substring(h, 1, DIGITS)), None
    for k, level in enumerate(levels):
        last = k == len(levels) - 1
        found = level if last else level.filter(F.col("_count") <= leaf_rows)
        leaves = found if leaves is None else leaves.unionByName(found)
        if not last:
            full = level.filter(F.col("_count") > leaf_rows).select("_d", F.lit(True).alias("_full"))
            rows = rows.join(full, "_d", "left").withColumn("_d", F.when(F.col("_full"), _prefix((k + 2) * DIGITS)).otherwise(F.col("_d"))).drop("_full")
    leaves = leaves.drop("_count")
    inside = F.row_number().over(Window.partitionBy("_d").orderBy("_h", *key)) - 1
    return rows.join(F.broadcast(leaves) if len(levels) == 1 else leaves, "_d").withColumn("pos", F.col("_before") + inside).drop("_h", "_d", "_before")


def seeded_split(df: DataFrame, key: str, seed: int, train: int, holdout: int, test: int = 0) -> DataFrame:
    """(…, split, example_id): train, then holdout, then test rows of the shuffle; others go. Ids count from 0 in each split."""
    edges = [("train", 0, train), ("holdout", train, train + holdout), ("test", train + holdout, train + holdout + test)]
    split = example = F.lit(None).cast("string")
    for name, a, b in edges:
        inside = (F.col("pos") >= a) & (F.col("pos") < b)
        split = F.when(inside, F.lit(name)).otherwise(split)
        example = F.when(inside, F.concat(F.lit(f"{name}_"), (F.col("pos") - a).cast("string"))).otherwise(example)
    return with_position(df, seed, key).withColumn("split", split).withColumn("example_id", example).filter("split is not null").drop("pos", "n_total")


def ratio_split(df: DataFrame, key: str, seed: int, train: int, holdout: int) -> DataFrame:
    """(…, split): exact sizes if there are enough rows, else all rows in that ratio, the remainder to holdout."""
    cut = F.when(F.col("n_total") >= train + holdout, F.lit(train)).otherwise(F.floor(F.col("n_total") * train / (train + holdout))).cast("long")
    last = F.when(F.col("n_total") >= train + holdout, F.lit(train + holdout)).otherwise(F.col("n_total"))
    rows = with_position(df, seed, key).filter(F.col("pos") < last)
    return rows.withColumn("split", F.when(F.col("pos") < cut, "train").otherwise("holdout")).drop("pos", "n_total")


def simple_sample(df: DataFrame, key: str, seed: int, n: int) -> DataFrame:
    """The first ``n`` rows of the shuffle: a bounded top-n, with ``position``."""
    taken = df.withColumn("_h", seeded_hash(seed, F.col(key))).orderBy("_h", key).limit(n)
    return taken.withColumn("position", F.row_number().over(Window.orderBy("_h", key)) - 1).drop("_h")  # over n rows


def quotas(counts: DataFrame, n: int) -> DataFrame:
    """How many of ``n`` rows each stratum gives if they give one each in turns, in order of ``_first``. counts: (..., _count, _first), a written table.

    A level is found up to which all strata give, by sums over the distinct counts (fewer than the root of twice the number of rows);
    what is left goes to the first of the strata that have more. Returns ``counts`` with _quota, strata that give none left out: ``n`` rows at most.
    """
    sizes = counts.groupBy("_count").agg(F.count(F.lit(1)).alias("_strata")).unionByName(counts.sparkSession.sql("SELECT 0L AS _count, 0L AS _strata"))
    upto = Window.orderBy("_count").rowsBetween(Window.unboundedPreceding, 0)
    more = F.coalesce(F.sum("_strata").over(Window.orderBy("_count").rowsBetween(1, Window.unboundedFollowing)), F.lit(0))
    filled = sizes.select("_count", more.alias("_more"), (F.sum(F.col("_count") * F.col("_strata")).over(upto) + F.col("_count") * more).alias("_taken"))
    at = filled.filter(F.col("_taken") <= max(0, n)).orderBy(F.desc("_count")).first()
    share, rest = divmod(max(0, n) - at["_taken"], at["_more"]) if at["_more"] else (0, 0)
    level = at["_count"] + share
    first = counts.filter(F.col("_count") > level).orderBy("_first").limit(rest).select(F.col("_first").alias("_lucky"))
    given = counts.join(first, F.col("_first") == F.col("_lucky"), "left")
    return given.withColumn("_quota", F.least(F.col("_count"), F.lit(level)) + F.col("_lucky").isNotNull().cast("long")).drop("_lucky").filter("_quota > 0")


def stratified_sample(df: DataFrame, key: str, stratum: str, seed: int, n: int, spare: float = 6.0) -> DataFrame:
    """``n`` rows taken in turns from the strata (in order of first appearance by key), each in its shuffle; then shuffled again. A null stratum is one too.

    Each stratum's quota is known first, then a threshold on the hash takes its quota and ``spare`` standard errors more, and only these few are put in order. Where a
    threshold took too few, thresholds are raised and it is done again, so the result is exact. ``key`` is unique and not null.
    """
    h = seeded_hash(seed, F.col(key))
    counts = written(df.groupBy(F.col(stratum).alias("_s")).agg(F.count(F.lit(1)).alias("_count"), F.min(key).alias("_first")), "strata")
    given = written(quotas(counts, n), "quotas")
    rows = df.withColumn("_h", h)
    at = F.conv(F.substring("_h", 1, 12), 16, 10).cast("double") / F.lit(float(16**12))
    while True:
        limit = (F.col("_quota") + F.lit(spare) * F.sqrt("_quota") + F.lit(spare)) / F.col("_count")
        near = written(rows.join(given, F.col(stratum).eqNullSafe(F.col("_s"))).filter(at <= limit), "near")
        short = near.groupBy("_s").agg(F.count(F.lit(1)).alias("_near"), F.first("_quota").alias("_q"))
        enough = short.agg(F.count_if(F.col("_near") >= F.col("_q")).alias("n")).first().n == given.count()
        if enough:
            break
        discard(near)
        spare = 4 * spare + 1
    discard(counts)
    turn = F.row_number().over(Window.partitionBy("_s").orderBy("_h", key))
    taken = near.withColumn("turn", turn).filter(F.col("turn") <= F.col("_quota"))
    again = Window.orderBy(seeded_hash(f"{seed}-again", F.col(key)), key)  # over n rows
    return taken.withColumn("position", F.row_number().over(again) - 1).select(*df.columns, "turn", "position")


def rows_between(df: DataFrame, key: str, start: int, stop: int) -> DataFrame:
    """Rows ``start`` to ``stop`` in order of a key."""
    return df.orderBy(key).offset(start).limit(max(0, stop - start))


def resume(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't done yet; null keys stay."""
    return df.join(done.select(key).distinct(), key, "left_anti")


def capped_resume(df: DataFrame, done: DataFrame, key: str, seed: int, cap: int) -> DataFrame:
    """Rows still to do, so many that done and new ones make ``cap``, in seeded order."""
    n_done = df.select(key).distinct().join(done.select(key).distinct(), key, "left_semi").agg(F.count(F.lit(1)).alias("n_done"))
    left = with_position(resume(df, done, key), seed, key)
    return left.crossJoin(F.broadcast(n_done)).filter(F.col("pos") < F.lit(cap) - F.col("n_done")).drop("pos", "n_total", "n_done")


def union_all(*frames: DataFrame) -> DataFrame:
    """All rows, with the number of the frame they are from."""
    out = None
    for k, f in enumerate(frames):
        f = f.withColumn("subset_ord", F.lit(k))
        out = f if out is None else out.unionByName(f)
    return out


def latest_per_key(df: DataFrame, keys: list[str], stamp: str, tiebreak: str) -> DataFrame:
    """The row with the largest stamp of each key; of equal stamps the smallest tiebreak."""
    w = Window.partitionBy(*keys).orderBy(F.desc(stamp), F.asc(tiebreak))
    return df.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def inverted(text: Column) -> Column:
    """A string that sorts the other way round than ``text`` does by its UTF-8 bytes."""
    return F.concat(F.translate(F.hex(F.encode(text, "UTF-8")), "0123456789ABCDEF", "FEDCBA9876543210"), F.lit("G"))


def latest_by_state(df: DataFrame, keys: list[str], stamp: str, tiebreak: str) -> DataFrame:
    """``latest_per_key`` as one aggregate, on a table or a stream: a row a key is all that a stream's state holds. tiebreak: a string or a whole number."""
    kind = dict(df.dtypes)[tiebreak]
    last = F.struct(stamp, inverted(F.col(tiebreak)) if kind == "string" else -F.col(tiebreak))
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), last).alias("_row")).select(*keys, "_row.*")
