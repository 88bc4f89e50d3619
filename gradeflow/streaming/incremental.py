"""Resumable work as a stream: what has been done is the query's checkpoint, not a set of keys.

The batch form is ``operators.ordering.resume``; this one suits folders to which files are added.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators.ordering import latest_by_state
from ..sources.sinks import rewrite_json_lines


def resume_stream(spark: SparkSession, folder: str, schema: T.StructType, key: str, checkpoint: str, work: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Hands each new key of the JSON files in ``folder`` to ``work`` once, over all restarts; ends when no new file is left."""
    rows = spark.readStream.schema(schema).json(folder).dropDuplicates([key])
    return rows.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(work).start()


def keep_latest(rows: DataFrame, keys: list[str], stamp: str, tiebreak: str, checkpoint: str, path: str) -> StreamingQuery:
    """Keeps the latest row of each key of a stream at ``path``, replaced as a whole after each batch; ends when no new file is left.

    A restart goes on from the checkpoint: keyed state has one row a key, so a row that comes late changes nothing unless it is the latest.
    """
    latest = latest_by_state(rows, keys, stamp, tiebreak)
    write = lambda df, batch: rewrite_json_lines(df, path)
    return latest.writeStream.outputMode("complete").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()


def windowed_counts(events: DataFrame, ts: str, length: str, late: str, *keys: str) -> DataFrame:
    """Counts by tumbling window and keys; rows later than ``late`` are dropped and state ends with the window."""
    from pyspark.sql import functions as F

    return events.withWatermark(ts, late).groupBy(F.window(ts, length), *keys).agg(F.count(F.lit(1)).alias("n"))
