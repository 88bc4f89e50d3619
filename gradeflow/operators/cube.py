"""Nested maps: made of long tables, and taken apart whatever their depth is."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def nested(df: DataFrame, keys: Sequence[str], value: Column) -> DataFrame:
    """One row, ``cube``: a map of maps ... of values by the keys, sorted; for report-sized frames. Rows with a null last key make an empty map. No rows: null."""
    rows = df.select(*(F.col(k).cast("string").alias(k) for k in keys), value.alias("_v"))
    by_key = lambda a, b: F.when(a.k < b.k, -1).when(a.k > b.k, 1).otherwise(0)
    for k in range(len(keys) - 1, -1, -1):
        entry = F.when(F.col(keys[k]).isNotNull(), F.struct(F.col(keys[k]).alias("k"), F.col("_v").alias("v")))
        rows = rows.groupBy(*keys[:k]).agg(F.map_from_entries(F.array_sort(F.collect_list(entry), by_key)).alias("_v"))
    return rows.select(F.when(F.size("_v") > 0, F.col("_v")).alias("cube"))


def leaves(df: DataFrame, column: str, depth: int = 8) -> DataFrame:
    """``df`` without ``column`` (JSON text), a row for each leaf in it: ``path`` (keys, and places in lists from 0) and ``leaf`` (variant).

    Leaves are numbers, texts, booleans, nulls and empty maps and lists; null or broken JSON has one without a path, which is null. Objects nested deeper
    than ``depth`` are an error, not left out. Labels needn't be known ahead: each level is one generator in the same stage, without a shuffle.
    """
    spark, rest = df.sparkSession, [c for c in df.columns if c != column]
    rows = df.select(*rest, F.try_parse_json(column).alias("leaf"), F.array().cast("array<string>").alias("path"))
    for _ in range(depth):
        inside = spark.tvf.variant_explode_outer(F.col("leaf").outer())
        rows = rows.lateralJoin(inside).select(
            *rest, F.when(F.coalesce("pos", F.lit(-1)) >= 0, F.col("value")).otherwise(F.col("leaf")).alias("leaf"),
            F.when(F.col("pos").isNotNull(), F.concat("path", F.array(F.coalesce("key", F.col("pos").cast("string"))))).otherwise(F.col("path")).alias("path"),
        )
    more = F.schema_of_variant("leaf").rlike("^(OBJECT<.+>|ARRAY<(?!VOID>).+>)$")
    return rows.withColumn("leaf", F.when(more, F.raise_error(F.lit(f"nested deeper than {depth}")).cast("variant")).otherwise(F.col("leaf")))


def probe(cube: Column, *path: str, kind: str = "double") -> Column:
    """Value at a path of a cube (variant); null where it is missing or isn't of that kind. A key with both kinds of quotes can't be asked for."""
    quoted = (f'["{p}"]' if "'" in p else f"['{p}']" for p in path)
    return F.try_variant_get(cube, "$" + "".join(quoted), kind)
