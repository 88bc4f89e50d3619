"""Where intermediate tables live: the folder that driver and executors share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import scratch
from ..sources.scratch import delete

#: Most buckets of a written table (Spark's own limit is 100,000).
MOST_BUCKETS = 100_000
#: Folders and broadcasts of the innermost ``temporary`` block.
_made: list[list] = []


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder path that driver and executors share (see ``scratch``), deleted with the ``temporary`` block around it or else when the process ends."""
    path = scratch.folder(spark, name)
    if _made:
        _made[-1].append(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: cuts lineage, survives lost executors."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._folder = path
    return out


def bucketed(df: DataFrame, key: str, keys: int, name: str) -> DataFrame:
    """As ``written``, but rows are dealt by ``key`` (of about ``keys`` values) into buckets, so that grouping by it shuffles them no more."""
    spark, path = df.sparkSession, shared_folder(df.sparkSession, name)
    n = min(MOST_BUCKETS, max(int(spark.conf.get("spark.sql.shuffle.partitions")), keys // 8))
    table = f"gradeflow_{uuid.uuid4().hex}"
    df.repartition(n, key).write.option("path", path).option("compression", "zstd").bucketBy(n, key).saveAsTable(table)
    out = spark.table(table)
    out.schema  # noqa: B018  resolved: the catalog's entry is needed no more, the files stay
    spark.sql(f"DROP TABLE {table}")
    out._folder = path
    return out


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, in whatever store it is."""
    fs, at = scratch.store(spark, path)
    return fs.exists(at)


def discard(df: DataFrame) -> None:
    """Deletes a written table that no frame still to be computed reads."""
    delete(df.sparkSession, df._folder)


def broadcast(spark: SparkSession, value: object):
    """A broadcast that the ``temporary`` block around it destroys."""
    out = spark.sparkContext.broadcast(value)
    if _made:
        _made[-1].append(out)
    return out


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Deletes the folders and destroys the broadcasts made inside when it is over; results must be written elsewhere by then."""
    _made.append([])
    try:
        yield
    finally:
        for x in _made.pop():
            if isinstance(x, str):
                delete(spark, x)
            else:
                x.destroy()


def finished(spark: SparkSession, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """What ``make`` returns, written; what was made on the way to it is deleted."""
    path = shared_folder(spark, name)
    with temporary(spark):
        df = make()
        schema = df.schema
        df.write.parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out._folder = path
    return out


def parts_bits(docs: DataFrame, bytes_a_part: int, most: int) -> int:
    """Bits of a hash space cut into parts of about ``bytes_a_part`` bytes of text: parts grow in number, not in size.

    One scan of the text column sums its bytes up. ``most`` bits bound what a task has to keep apart.
    """
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return min(most, max(2, (total // bytes_a_part).bit_length()))


def free_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def keep_rows(docs: DataFrame, judged: DataFrame, key: Column) -> DataFrame:
    """Rows of ``docs`` that stay. judged: (doc_id, a hash of the text, kept) of every row; key: that hash in ``docs``.

    Of rows that repeat both as a whole, where one is kept, one stays.
    """
    ident, kept_id, kept_key = judged.columns[1], free_name(docs, "_kept_id"), free_name(docs, "_kept_key")
    rows = judged.groupBy("doc_id", ident).agg(F.bool_or("kept").alias("kept"), F.count(F.lit(1)).alias("n")).filter("kept")
    rows = written(rows.select(F.col("doc_id").alias(kept_id), F.col(ident).alias(kept_key), "n"), "kept")
    same = docs["doc_id"].cast("long").eqNullSafe(rows[kept_id]) & (key == rows[kept_key])
    many = rows.filter(rows["n"] > 1)
    if many.isEmpty():
        return docs.join(rows, same, "left_semi")
    repeated = docs.join(many.drop("n"), same).dropDuplicates([kept_id, kept_key]).drop(kept_id, kept_key)
    return docs.join(rows.filter(rows["n"] == 1), same, "left_semi").unionByName(repeated)
