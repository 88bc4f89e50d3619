"""The run report from folders to its files: discovery, selection, fallbacks, statistics of the whole grid, gaps, summary, bars, console lines."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import sinks
from ..sources.run_folders import read_runs
from ..sources.scratch import discard, written
from ..sources.settings import Report
from .cube import nested
from .ordering import latest_per_key
from .runs import BASELINES, KEY, ROW_LABELS, SERIES, TRACES, grid, missing, plot_stats, row_label, series_label

# Fixed value: the summary's file name.
SUMMARY = "llm_accuracy_summary.json"


@dataclass
class RunSummary:
    """Frames of a report; all but ``found`` are of the size of the grid."""

    found: DataFrame  # every run seen
    selected: DataFrame  # the latest completed run of each key
    used: DataFrame  # keys filled from fallbacks
    values: DataFrame  # (dataset, provider, seed, label, accuracy); a null label for a run without a labelled row
    stats: DataFrame  # (dataset, label, mean, stderr, n) of every bar
    gaps: DataFrame  # cells of the grid with neither
    bars: list[str]


def _values(chosen: DataFrame) -> DataFrame:
    """Labelled accuracies of runs; of rows with one label the last counts."""
    rows = chosen.select(*KEY, F.posexplode_outer("results").alias("at", "row"))
    labelled = rows.withColumn("label", row_label(F.col("row.source"), F.col("row.mode"), F.col("row.beta_s"), ROW_LABELS))
    last = labelled.groupBy(*KEY, "label").agg(F.max_by("row.accuracy", F.coalesce("at", F.lit(-1))).alias("accuracy"))
    return last.withColumn("accuracy", F.when(F.col("label").isNotNull(), F.col("accuracy")))


def _labelled(values: DataFrame) -> DataFrame:
    """A null label stays only where its run has no other."""
    some = values.groupBy(*KEY).agg(F.count("label").alias("_some"))
    return values.join(some, KEY).filter(F.col("label").isNotNull() | (F.col("_some") == 0)).drop("_some")


def summarize(spark: SparkSession, asked: Report, fallbacks: DataFrame) -> RunSummary:
    """Report of the runs under ``asked.runs_root``. fallbacks: (dataset, provider, seed, label, accuracy). An empty list of what is asked for stands for all that is found.

    A fallback is used for a key without a completed run, in the grid or not; statistics are of the grid of providers, datasets and seeds asked for, whose every
    bar has a row (null mean and n = 0 without values).
    """
    found = written(read_runs(spark, asked.runs_root, asked.providers, asked.datasets, asked.seeds), "runs")
    seen = lambda name: sorted(r[0] for r in found.select(name).distinct().toLocalIterator())
    asked = asked.model_copy(update={k: getattr(asked, k) or seen(k.removesuffix("s")) for k in ("providers", "datasets", "seeds")})
    # of the size of the grid, written once so that the frames made of them have short plans
    selected = written(latest_per_key(found.filter("has_results"), KEY, "timestamp", "run"), "selected")
    free = written(fallbacks.select(*KEY, "label", "accuracy").join(selected.select(*KEY), KEY, "left_anti"), "free")
    values = written(_labelled(_values(selected)).unionByName(free), "values")
    inside = values.filter(F.col("dataset").isin(asked.datasets) & F.col("provider").isin(asked.providers) & F.col("seed").isin(asked.seeds))
    bars = [*BASELINES, *dict.fromkeys(SERIES.get(p, p.capitalize()) for p in asked.providers)]
    cells = grid(spark, dataset=asked.datasets, label=bars)
    stats = cells.join(plot_stats(inside, BASELINES, TRACES, SERIES), ["dataset", "label"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    keys = grid(spark, dataset=asked.datasets, provider=asked.providers, seed=asked.seeds)
    used = free.select(*KEY).distinct()
    gaps = missing(keys, found, free, "timestamp", "run")  # a fallback that isn't free is of a key that has a completed run
    return RunSummary(found, selected, used, values, written(stats, "stats"), gaps, bars)


def summary_parts(report: RunSummary, root: str) -> dict[str, str]:
    """JSON texts of the summary's parts."""
    run = F.struct("timestamp", F.concat(F.lit(root.rstrip("/") + "/"), F.col("run")).alias("run_dir"))
    named = report.selected.withColumn("key", F.concat_ws("/", "dataset", "provider", F.concat(F.lit("seed"), F.col("seed"))))
    parts = {
        "selected_runs": nested(named, ["key"], run),
        "per_seed_provider": nested(report.values, [*KEY, "label"], F.col("accuracy")),
        "plot_stats": nested(report.stats, ["dataset", "label"], F.struct("mean", "stderr", "n")),
    }
    texts = {k: df.select(F.to_json("cube", {"ignoreNullFields": "false"}).alias("j")).first() for k, df in parts.items()}
    used = report.used.orderBy(*KEY).toJSON().toLocalIterator()
    return {k: (r.j if r else None) or "{}" for k, r in texts.items()} | {"used_fallbacks": f"[{','.join(used)}]"}


def write_report(spark: SparkSession, asked: Report, fallbacks: DataFrame, out: str) -> str:
    """Writes the summary and the bars (JSON lines) to ``out``; the lines for a terminal are returned. Stages are logged."""
    with sinks.stage("find and select runs", asked.runs_root):
        report = summarize(spark, asked, fallbacks)
    with sinks.stage("write summary", out):
        payload = {k: json.loads(v) for k, v in summary_parts(report, asked.runs_root).items()}
        config = {"providers": asked.providers, "datasets": asked.datasets, "seeds": asked.seeds, "runs_root": asked.runs_root, "plot_dir": out}
        sinks.write_text(spark, json.dumps(payload | {"config": config}, indent=2, sort_keys=True), f"{out.rstrip('/')}/{SUMMARY}")
    bars = sinks.Counted(sinks.series_table(report.stats, report.bars))
    with sinks.stage("write bars", counted=bars):
        sinks.write_json_lines(bars.df, f"{out.rstrip('/')}/bars")
    lines = sinks.console_summary(report.selected.select(*KEY, "run"), report.used, report.gaps.select(*KEY, "newest_run"), report.stats)
    discard(report.found, report.selected, report.values, report.stats)
    return lines
