"""Labelled rows for fitting: a bounded sample whose identifiers can be broadcast."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most labelled rows that a fit looks at. Which ones: those with the smallest hash of their identifier.
MOST_LABELLED = 24_000


def id_crc(doc_id: Column) -> Column:
    """crc32 of the identifier as text (null: of the empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, most: int = MOST_LABELLED) -> DataFrame:
    """(doc_id, text, label) of at most ``most`` labelled documents for which ``learn`` holds.

    A document with several labels has the largest. Only identifiers and labels, ``most`` rows at most, are
    broadcast; the texts stay where they are.
    """
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).filter(F.col("label").isNotNull() & F.col("doc_id").isNotNull() & learn)
    ids = rows.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(ids), "doc_id")
