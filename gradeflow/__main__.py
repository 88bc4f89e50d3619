"""Command line: ``python -m gradeflow report|split|grade``, over settings in YAML."""

from __future__ import annotations

import argparse
import logging
from collections.abc import Sequence

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import grading, metrics, ordering, report, runs
from .operators.summary import write_report
from .sources import settings, sinks, tables


def _settings(args: argparse.Namespace) -> settings.Settings:
    """From the file, with ``--set part.name=value`` over it (lists between commas), validated again."""
    tree = (settings.read_settings(args.settings) if args.settings else settings.Settings()).model_dump()
    for key, value in settings.overrides(args.set).items():
        part, _, name = key.partition(".")
        if name not in tree.get(part, {}):
            raise ValueError(f"no setting {key!r}")
        tree[part][name] = [x.strip() for x in value.split(",") if x.strip()] if isinstance(tree[part][name], list) else value
    return settings.Settings.model_validate(tree)


def report_runs(spark: SparkSession, args: argparse.Namespace, chosen: settings.Settings) -> str:
    """Summary, bars and console lines of run folders."""
    none = spark.createDataFrame([], "value string")
    text = spark.read.text(args.fallbacks, wholetext=True) if args.fallbacks else none
    return write_report(spark, chosen.report, runs.read_fallbacks(text, "value"), args.out)


def split_problems(spark: SparkSession, args: argparse.Namespace, chosen: settings.Settings) -> str:
    """Seeded splits of a problem set, its prompt dictionary, manifest and the settings used. The key of a problem is what it says, and which of its copies it is."""
    want = chosen.splits
    problems = tables.load_problems(spark, want.dataset, all=args.input).groupBy("problem", "solution", "type").agg(F.count(F.lit(1)).alias("copies"))
    problems = problems.select("problem", "solution", "type", F.explode(F.sequence(F.lit(1), "copies")).alias("copy"))
    problems = problems.withColumn("key", F.to_json(F.struct("problem", "solution", "type", "copy"))).drop("copy")
    splits = ordering.seeded_split(problems, "key", want.seed, want.train, want.holdout, want.test).drop("key")
    rows = sinks.Counted(splits, "split", ["train", "holdout", "test"])
    with sinks.stage("split", args.input, rows):
        sinks.write_json_lines(rows.df, f"{args.out}/splits")
    again = tables.read_json_lines(spark, f"{args.out}/splits", splits.schema)
    at = F.substring_index("example_id", "_", -1).cast("long")
    with sinks.stage("prompts"):
        sinks.write_json_lines(report.prompt_dictionary(again, "split", at, ["example_id", "problem", "solution"]), f"{args.out}/prompts")
    counts = rows.counts
    facts = {"dataset": want.dataset, "seed": want.seed, "split_sizes": {k: counts[k] for k in ("train", "holdout", "test")}}
    sinks.write_text(spark, report.summary_json({}, facts), f"{args.out}/manifest.json")
    sinks.write_text(spark, chosen.model_dump_json(indent=2), f"{args.out}/settings.json")
    return f"{counts['rows']} rows in splits: " + ", ".join(f"{k} {n}" for k, n in facts["split_sizes"].items())


def grade_traces(spark: SparkSession, args: argparse.Namespace, chosen: settings.Settings) -> str:
    """Traces graded against their gold answers, with accuracy by subject; bad lines are kept beside them."""
    rows, bad = tables.quarantined(spark, args.input, tables.TRACE)
    graded = grading.grade(rows, "trace", "gold_answer", "raw")
    with sinks.stage("grade", args.input):
        sinks.write_json_lines(graded, f"{args.out}/graded")
        sinks.write_json_lines(bad, f"{args.out}/bad_lines")
    seen = tables.read_json_lines(spark, f"{args.out}/graded", graded.schema)
    by = seen.groupBy("subject").agg(F.round(metrics.accuracy(F.col("raw_correct")), 4).alias("accuracy"), F.count(F.lit(1)).alias("n"))
    sinks.write_json_array(by.orderBy("subject"), f"{args.out}/accuracy.json")
    return report.markdown_table(by, "subject")


COMMANDS = {"report": report_runs, "split": split_problems, "grade": grade_traces}


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> str:
    """Runs a command; its lines for the terminal are printed and returned."""
    parser = argparse.ArgumentParser(prog="gradeflow", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    for name, run in COMMANDS.items():
        sub = commands.add_parser(name, help=run.__doc__)
        sub.add_argument("--settings", help="YAML file; all defaults without it")
        sub.add_argument("--set", action="append", default=[], metavar="PART.NAME=VALUE", help="one setting over the file's")
        sub.add_argument("--out", required=True, help="folder for what is written")
        if name == "report":
            sub.add_argument("--fallbacks", help='JSON file: {"dataset/provider/seed": {label: accuracy}}')
        else:
            sub.add_argument("--input", required=True, help="JSON lines")
    args = parser.parse_args(argv)
    args.out = args.out.rstrip("/")
    logging.basicConfig(level=logging.INFO)
    lines = COMMANDS[args.command](spark or SparkSession.builder.appName("gradeflow").getOrCreate(), args, _settings(args))
    print(lines)
    return lines


if __name__ == "__main__":
    main()
