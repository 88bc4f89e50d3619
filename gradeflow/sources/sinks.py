"""Sinks: JSON lines and arrays, append and staged rewrite, manifests, summaries, a stage log."""

from __future__ import annotations

import json
import logging
import time
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .scratch import store
from .tables import POINTER, current


def write_json_lines(df: DataFrame, path: str) -> None:
    """A row a line, in as many files as tasks."""
    df.write.mode("overwrite").json(path)


def append_json_lines(df: DataFrame, path: str) -> None:
    """Adds rows; a failed job adds none."""
    df.write.mode("append").json(current(df.sparkSession, path))


def to_json_array(df: DataFrame) -> str:
    """A report-sized frame as one JSON array."""
    return json.dumps([json.loads(r) for r in df.toJSON().toLocalIterator()], indent=2)


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """A small file, in whatever store Spark can reach; folders on the way are made."""
    fs, at = store(spark, path)
    out = fs.create(at, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def write_json_array(df: DataFrame, path: str) -> None:
    """A report-sized frame as a file that is one JSON array."""
    write_text(df.sparkSession, to_json_array(df), path)


def _point(spark: SparkSession, path: str, version: str) -> None:
    """Makes a version the current one: the pointer is replaced by one rename, so it names the old or the new version at any time."""
    beside = f"{path}/{POINTER}-{uuid.uuid4().hex}"
    write_text(spark, version, beside)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    (fs, made), (_, pointer) = store(spark, beside), store(spark, f"{path}/{POINTER}")
    over = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
    over[0] = hadoop.Options.Rename.OVERWRITE
    hadoop.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(fs.makeQualified(made), fs.makeQualified(pointer), over)


def rewrite_json_lines(df: DataFrame, path: str) -> None:
    """Replaces what is at ``path``, which ``df`` may read: written as a version of its own, then made the current one in one step.

    What fails on the way leaves the old rows; old versions are deleted last. Readers find the rows by ``tables.current``.
    """
    spark, path = df.sparkSession, path.rstrip("/")
    version = f"_version-{uuid.uuid4().hex}"
    df.write.json(f"{path}/{version}")
    _point(spark, path, version)
    fs, at = store(spark, path)
    for old in fs.listStatus(at):
        if old.getPath().getName() not in (version, POINTER):
            fs.delete(old.getPath(), True)


def manifest(splits: DataFrame, split: str, planned: dict | None = None, **facts) -> dict:
    """Facts of a run with the sizes of its splits and the planned methods: {"teachers": {...}, "students": {"modes": [...], "beta_s_values": [...]}}."""
    sizes = {r[split]: r["count"] for r in splits.groupBy(split).count().orderBy(split).collect()}
    return facts | {"split_sizes": sizes, "planned_methods": planned or {}}


def console_summary(selected: DataFrame, fallbacks: DataFrame, missing: DataFrame, stats: DataFrame) -> str:
    """Report-sized frames as lines for a terminal: selected runs, fallbacks used, gaps, means with their errors."""
    lines = []
    for title, df in (("Selected runs", selected), ("Fallbacks", fallbacks), ("Missing", missing)):
        rows = sorted(tuple("-" if x is None else str(x) for x in r) for r in df.toLocalIterator())
        lines += [f"{title}: {len(rows)}", *("  " + "  ".join(r) for r in rows)]
    value = lambda x: "-" if x is None else f"{100 * x:.1f}"
    lines += ["Values", *(f"  {r.dataset}  {r.label}: {value(r['mean'])} +- {value(r['stderr'])} (n={r.n})" for r in sorted(stats.collect(), key=lambda r: (r.dataset, r.label)))]
    return "\n".join(lines)


class Counted:
    """Counts of a frame that the job writing it takes on its way: no second pass. Ask for ``counts`` after that job."""

    def __init__(self, df: DataFrame, split: str | None = None, splits: Sequence[str] = ()) -> None:
        """split: a column; rows of each of ``splits`` are counted too."""
        self._seen = Observation(f"counted-{uuid.uuid4().hex}")
        parts = [F.count_if(F.col(split) == s).alias(f"{split}_{k}") for k, s in enumerate(splits)]
        self.df, self._split, self._splits = df.observe(self._seen, F.count(F.lit(1)).alias("rows"), *parts), split, list(splits)

    @property
    def counts(self) -> dict[str, int]:
        """rows, and the size of each split."""
        got = self._seen.get
        return {"rows": got["rows"]} | {s: got[f"{self._split}_{k}"] for k, s in enumerate(self._splits)}


@contextmanager
def stage(label: str, extra: str = "", counted: Counted | None = None) -> Iterator[None]:
    """Logs a stage's label, seconds, remark and, after a job over ``counted.df``, its counts when it is over."""
    began, failed = time.perf_counter(), True
    try:
        yield
        failed = False
    finally:
        counts = ", ".join(f"{k}={v}" for k, v in counted.counts.items()) if counted and not failed else ""
        logging.getLogger("gradeflow").info("%s: %.1f s%s", label, time.perf_counter() - began, "".join(f", {x}" for x in (extra, counts, "failed" if failed else "") if x))


def trace_file(provider: str, dataset: str) -> str:
    """Name of a provider's trace file (fixed value)."""
    return f"{provider}_{dataset}_traces.jsonl"


def pmf_series(shares: DataFrame, series: str) -> DataFrame:
    """Plot-ready bars of score distributions: (series, bin, percent), a bin without values 0."""
    return shares.select(F.col(series).alias("series"), "bin", F.coalesce(F.col("share") * 100, F.lit(0.0)).alias("percent"))


def series_table(stats: DataFrame, order: list[str]) -> DataFrame:
    """Plot-ready bars: (dataset, label, place, percent, stderr_percent); a label without a mean has nulls."""
    place = F.array_position(F.array(*(F.lit(x) for x in order)), F.col("label"))
    return stats.withColumn("place", place).filter("place > 0").select("dataset", "label", "place", (F.col("mean") * 100).alias("percent"), (F.col("stderr") * 100).alias("stderr_percent"))
