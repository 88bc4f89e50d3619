"""Exact deduplication as a stateful stream (operator 9, native).

Texts are equal when they are the same bytes after lower-casing A-Z. A stream over the documents
keeps one state entry for each digest, without expiry, on disk (RocksDB): the digest, the stable
identifier of the row that stays (the largest ``doc_id``), the locator of its content (that identifier with a hash of the
text as it stands in the input, as several rows may share an identifier) and the number of rows. Every micro-batch writes the entries
that it changed; counts and identifiers only grow, so the largest of each is the last. With a ``state`` folder the stream goes on
where the call before ended: new rows meet the retained entries.

On a hit (a digest with more than one row) whole texts are compared with the text at the locator. The retained
text is copied once for every ``SALT_ROWS`` rows of its group, so a group with a third of all
rows is spread over many tasks. Should a digest ever stand for different texts, its
rows are grouped again by their whole text (``_by_text``).

Everything is DataFrame or SQL functions. State is partitioned by digest; before it, counts are
summed within each task, so copies cost one row a task. Rows meet the entries in a join with plain exchanges on both sides, which
Spark splits where a digest is hot.

Edge cases: a null text counts as empty; empty texts are equal to one another; an empty table gives no
rows; rows that repeat a ``doc_id`` are each counted and each returned; rows with a null ``doc_id``
are counted, are never kept unless all of the group are null; extra columns are ignored here.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import exists, keep_rows, shared_folder, written

#: Rows of a group that are compared against one copy of its retained text.
SALT_ROWS = 2_000
#: Bytes of identifiers and digests (some 45 a row) in one micro-batch.
TRIGGER_BYTES = 8 << 30
#: Settings while the stream runs: disk-backed state; no file space is set aside ahead, as a small store would hold megabytes of it.
STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised(text: Column) -> Column:
    """A-Z in lower case, everything else as it is; null is empty. For ASCII texts that is ``lower``, which is faster."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def _hash(norm: Column) -> Column:
    return F.unhex(F.sha2(norm.cast("binary"), 256))


def _digest(text: Column) -> Column:
    return _hash(normalised(text))


def _content(text: Column) -> Column:
    """With the identifier, where a text is found in the input."""
    return F.xxhash64(text)


ROW, ENTRY = "doc_id long, content long, digest binary", "digest binary, keep_id long, locator long, group_size long"


def digests(docs: DataFrame, folder: str, trigger_bytes: int = TRIGGER_BYTES) -> tuple[DataFrame, DataFrame]:
    """(doc_id, content, digest) of every row, added to ``folder``: this call's as a table, and the folder as a stream."""
    spark, path = docs.sparkSession, f"{folder}/call={uuid.uuid4().hex}"
    text = F.col("text").cast("string")
    docs.select(F.col("doc_id").cast("long").alias("doc_id"), _content(text).alias("content"), _digest(text).alias("digest")).write.parquet(path)
    stream = spark.readStream.schema(ROW + ", call string").option("maxBytesPerTrigger", trigger_bytes).parquet(folder)
    return spark.read.schema(ROW).parquet(path), stream.drop("call")


def digest_state(stream: DataFrame, folder: str) -> DataFrame:
    """Runs a stream of rows to its end: (digest, keep_id, locator, group_size) of all rows of this and former calls."""
    spark, out = stream.sparkSession, f"{folder}/entries"

    def store(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{out}/batch={batch}")

    before = {k: spark.conf.get(k, None) for k in STORE}
    for k, v in STORE.items():
        spark.conf.set(k, v)
    try:
        state = stream.groupBy("digest").agg(F.max(F.struct("doc_id", "content")).alias("keep"), F.count(F.lit(1)).alias("group_size"))
        changed = state.select("digest", F.col("keep.doc_id").alias("keep_id"), F.col("keep.content").alias("locator"), "group_size")
        changed.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/stream").trigger(availableNow=True).foreachBatch(store).start().awaitTermination()
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
    if not exists(spark, out):  # no row, no batch
        return spark.createDataFrame([], ENTRY)
    entries = spark.read.schema(ENTRY).option("recursiveFileLookup", "true").parquet(out)
    last = entries.groupBy("digest").agg(F.max(F.struct("group_size", "keep_id", "locator")).alias("last"))
    return written(last.select("digest", "last.keep_id", "last.locator", "last.group_size"), "dedup-entries")


def _by_text(rows: DataFrame) -> DataFrame:
    """The exact answer for rows whose digest stands for several texts: groups by the whole text."""
    keep = rows.groupBy("digest", "norm").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    return rows.select("doc_id", "digest", "norm").join(keep, ["digest", "norm"]).select("doc_id", "digest", "keep_id", "group_size")


def exact_dedup(docs: DataFrame, state: str | None = None, corpus: DataFrame | None = None, trigger_bytes: int = TRIGGER_BYTES) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for every row of ``docs``.

    state: a shared folder that further calls with more rows go on from; corpus: then all rows of this and former calls, where the texts
    at the locators are read (if this call's rows differ, earlier answers may be overtaken by larger identifiers).
    """
    folder = state or shared_folder(docs.sparkSession, "dedup")
    table, stream = digests(docs, f"{folder}/rows", trigger_bytes)
    entries = digest_state(stream, folder)
    # texts of the hits and of what they are compared with only; places are told apart before they meet the entries, as a group that is
    # dealt by its digest could not be split for it afterwards
    several = entries.filter("group_size > 1")
    if state:  # entries that no row of this call meets
        several = several.join(table.select("digest").distinct(), "digest", "left_semi")
    retained = several.select(F.col("keep_id").alias("doc_id"), F.col("locator").alias("content"), "digest")
    places = table.unionByName(retained).distinct().join(several, "digest")
    texts = (corpus if corpus is not None else docs).select(F.col("doc_id").cast("long").alias("_id"), F.col("text").cast("string").alias("text"))
    texts = texts.withColumn("_content", _content(F.col("text")))
    at = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("content") == F.col("_content"))
    hits = written(texts.join(places, at).select("doc_id", "content", "digest", "keep_id", "locator", "group_size", normalised(F.col("text")).alias("norm")), "dedup-hits")
    copies = F.ceil(F.col("group_size") / SALT_ROWS).cast("int")
    located = hits.filter(F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("content") == F.col("locator")))
    held = located.groupBy("digest").agg(F.first("norm").alias("held"), F.max(copies).alias("copies")).select("digest", "held", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("salt"))
    salted = hits.select("digest", "norm", F.pmod(F.xxhash64("doc_id"), copies).cast("int").alias("salt"))
    compared = salted.join(held, ["digest", "salt"], "left")
    wrong = written(compared.filter(~F.col("norm").eqNullSafe(F.col("held"))).select("digest").distinct(), "dedup-collisions")
    answer = table.join(entries, "digest").select("doc_id", "digest", "keep_id", "group_size")
    if not wrong.isEmpty():
        answer = answer.join(wrong, "digest", "left_anti").unionByName(_by_text(hits.join(wrong, "digest", "left_semi")))
    return answer.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each text, that of the largest doc_id."""
    return keep_rows(docs, exact_dedup(docs).select("doc_id", "text_sha256", "kept"), F.lower(F.hex(_digest(docs["text"].cast("string")))))
