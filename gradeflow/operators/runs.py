"""Experiment runs: discovery, selection of the latest, fallbacks, gaps, statistics and the whole report."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .metrics import mean_of_means, mean_stderr
from .ordering import latest_per_key

# Run names, labels of result rows, display names and their order.
RUN_NAME = r"^real_([^_]+)_(gsm8k|math)_traces_seed(\d+)_(\d{8}_\d{6})$"
ROW_LABELS = (("base", None, None, "Base"), ("qa", "naive", None, "SFT on Q&A"), ("traces", "naive", None, "Trace SFT"))
SERIES = {"gemini": "Gemini", "claude": "Claude", "openai": "GPT"}
BASELINES = ("Base", "SFT on Q&A")
TRACES = "Trace SFT"
KEY = ["dataset", "provider", "seed"]


def parse_run_names(df: DataFrame, name: str) -> DataFrame:
    """``df`` with provider, dataset, seed, timestamp of names that are run names; others go."""
    part = lambda k: F.regexp_extract(F.col(name), RUN_NAME, k)
    rows = df.filter(F.regexp_like(F.col(name), F.lit(RUN_NAME)))
    return rows.withColumns({"provider": part(1), "dataset": part(2), "seed": part(3).cast("int"), "timestamp": part(4)})


def row_label(source: Column, mode: Column, beta: Column, labels: Sequence[tuple] = ROW_LABELS) -> Column:
    """Label of a result row by its three keys, null-aware; null if there is none."""
    out = F.lit(None).cast("string")
    for s, m, b, label in labels:
        out = F.when(source.eqNullSafe(F.lit(s)) & mode.eqNullSafe(F.lit(m)) & beta.eqNullSafe(F.lit(b)), F.lit(label)).otherwise(out)
    return out


def series_label(provider: Column, names: Mapping[str, str] = SERIES) -> Column:
    """Display name of a provider; by default its first letter upper, the rest lower case."""
    known = F.create_map(*(F.lit(x) for kv in names.items() for x in kv))
    return F.coalesce(F.try_element_at(known, provider), F.concat(F.upper(F.substring(provider, 1, 1)), F.lower(F.substring(provider, F.lit(2), F.length(provider)))))


def display_order(label: Column, order: Sequence[str]) -> Column:
    """Place of a label in an explicit order, from 1; 0 if it isn't in it."""
    return F.array_position(F.array(*(F.lit(x) for x in order)), label)


def read_fallbacks(df: DataFrame, column: str) -> DataFrame:
    """(dataset, provider, seed, label, accuracy) of JSON maps "dataset/provider/[seed]N" -> label -> accuracy."""
    maps = df.select(F.from_json(column, "map<string,map<string,double>>").alias("m")).select(F.explode("m").alias("k", "v"))
    parts = F.split("k", "/")
    return maps.select(parts[0].alias("dataset"), parts[1].alias("provider"), F.regexp_replace(parts[2], "seed", "").cast("int").alias("seed"), F.explode("v").alias("label", "accuracy"))


def fill(actual: DataFrame, fallback: DataFrame, keys: Sequence[str] = tuple(KEY)) -> DataFrame:
    """Actual rows, and fallback rows of keys that have none, with ``from_fallback``."""
    more = fallback.join(actual.select(*keys).distinct(), list(keys), "left_anti")
    return actual.withColumn("from_fallback", F.lit(False)).unionByName(more.withColumn("from_fallback", F.lit(True)))


def grid(spark: SparkSession, **values: Sequence) -> DataFrame:
    """All combinations of small parameter lists, as one row exploded."""
    out = spark.range(1).select()
    for name, xs in values.items():
        out = out.select("*", F.explode(F.array(*(F.lit(x) for x in xs)) if xs else F.array().cast("array<string>")).alias(name))
    return out


def students_of(runs: DataFrame, source: str, modes: Sequence[str], betas: Sequence[float], strategic: str = "strategic_fd") -> DataFrame:
    """(source, mode, beta_s) planned for every source that a table has: every beta for the strategic mode, 1 for the others."""
    values = F.when(F.col("mode") == strategic, F.array(*map(F.lit, betas))).otherwise(F.array(F.lit(1.0)))
    found = runs.filter(F.col(source).isNotNull()).select(F.col(source).alias("source")).distinct()
    return found.select("source", F.explode(F.array(*map(F.lit, modes))).alias("mode")).select("source", "mode", F.explode(values).alias("beta_s"))


def missing(cells: DataFrame, observed: DataFrame, fallback: DataFrame, stamp: str, name: str) -> DataFrame:
    """Cells of the grid with neither a completed run nor a fallback, and the newest run seen for them, complete or not."""
    keys = cells.columns
    newest = observed.groupBy(*keys).agg(F.max(F.struct(stamp, name)).alias("_n")).select(*keys, F.col(f"_n.{stamp}").alias("newest_timestamp"), F.col(f"_n.{name}").alias("newest_run"))
    done = observed.filter("has_results").select(*keys).distinct()
    left = cells.join(done, keys, "left_anti").join(fallback.select(*keys).distinct(), keys, "left_anti")
    return left.join(newest, keys, "left")


def plot_stats(values: DataFrame, baselines: Sequence[str] = BASELINES, traces: str = TRACES, names: Mapping[str, str] = SERIES) -> DataFrame:
    """(dataset, label, mean, stderr, n): baselines by means of a seed's providers; traces by provider over seeds."""
    base = mean_of_means(values.filter(F.col("label").isin(list(baselines))), ["dataset", "label"], "seed", "accuracy")
    own = mean_stderr(values.filter(F.col("label") == traces).withColumn("label", series_label(F.col("provider"), names)), ["dataset", "label"], "accuracy")
    return base.unionByName(own)


def run_report(runs: DataFrame, fallback: DataFrame, baselines: Sequence[str], traces: str, names: Mapping[str, str]) -> DataFrame:
    """From run rows (dataset, provider, seed, timestamp, run, has_results, label, accuracy) to statistics.

    The latest completed run of each key is kept with all its labels, gaps are filled from the fallbacks.
    """
    chosen = latest_per_key(runs.filter("has_results").select(*KEY, "timestamp", "run").distinct(), KEY, "timestamp", "run")
    actual = runs.join(chosen, [*KEY, "timestamp", "run"], "left_semi").filter(F.col("label").isNotNull()).select(*KEY, "label", "accuracy")
    return plot_stats(fill(actual, fallback), baselines, traces, names)
