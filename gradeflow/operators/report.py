"""Comparison matrices, Markdown and JSON reports."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.formats import beta_of, four_places, notes_without_beta


def teacher_accuracy(results: DataFrame) -> DataFrame:
    """(source, teacher_accuracy): test rows of teachers, the last by ``ord``."""
    rows = results.filter(F.coalesce("eval_model", F.lit("")).startswith("teacher_") & F.col("eval_model").endswith("_test"))
    return rows.groupBy(F.regexp_replace("eval_model", "_test$", "").alias("source")).agg(F.max_by(four_places(F.col("accuracy")), "ord").alias("teacher_accuracy"))


def student_cells(results: DataFrame) -> DataFrame:
    """(source, label, cell): accuracy and notes of students, the last by ``ord`` of each source and label."""
    rows = results.filter(F.coalesce("eval_model", F.lit("")).startswith("student_"))
    beta, more = beta_of(F.col("notes")), notes_without_beta(F.col("notes"))
    label = F.when(beta.isNotNull(), F.concat("eval_model", F.lit(" (beta_s="), beta, F.lit(")"))).otherwise(F.col("eval_model"))
    cell = F.concat(four_places(F.col("accuracy")), F.when(more != "", F.concat(F.lit("<br><sub>"), more, F.lit("</sub>"))).otherwise(F.lit("")))
    return rows.groupBy(F.col("train_source").alias("source"), label.alias("label")).agg(F.max_by(cell, "ord").alias("cell"))


def comparison_matrix(results: DataFrame, labels: Sequence[str] | None = None) -> DataFrame:
    """One row for each teacher or training source; a column for each student label (sorted); gaps are empty."""
    cells, teachers = student_cells(results), teacher_accuracy(results)
    if labels is None:  # column names: as many as there are students
        labels = sorted(r[0] for r in cells.select("label").distinct().collect())
    table = cells.groupBy("source").pivot("label", list(labels)).agg(F.first("cell"))
    return teachers.join(table, "source", "full").na.fill("")


def markdown_row(columns: Sequence[Column]) -> Column:
    """Cells between bars."""
    return F.concat(F.lit("| "), F.concat_ws(" | ", *columns), F.lit(" |"))


def markdown_table(df: DataFrame, order: str) -> str:
    """A report-sized frame as a Markdown table."""
    line = lambda cells: "| " + " | ".join(cells) + " |"
    rows = df.orderBy(order).select(markdown_row([F.col(f"`{c}`").cast("string") for c in df.columns]).alias("line"))
    return "\n".join([line(df.columns), line(["---"] * len(df.columns)), *(r.line for r in rows.toLocalIterator())])


def markdown_example(null: str = "None") -> Column:
    """One graded trace as a section: prompt, trace, forced answer, then its fields."""
    text = lambda c: F.coalesce(F.trim(c), F.lit(""))
    flag = lambda c: F.coalesce(F.initcap(F.col(c).cast("string")), F.lit(null))
    value = lambda c: F.coalesce(F.col(c), F.lit(null))
    fields = [("Raw extracted answer", value("raw_extracted_answer")), ("AF extracted answer", value("af_extracted_answer")), ("Raw correct", flag("raw_correct")), ("AF correct", flag("af_correct")), ("Extracted answer", value("extracted_answer")), ("Correct", flag("correct"))]
    lines = [F.concat(F.lit("## "), F.col("example_id")), F.lit("")]
    for title, c in (("Prompt:", "prompt"), ("Trace:", "trace"), ("Answer-Forced Final Answer:", "af_final_answer_only")):
        lines += [F.lit(title), F.lit(""), text(c), F.lit("")]
    lines += [F.concat(F.lit(f"{t}: `"), v, F.lit("`")) for t, v in fields]
    return F.concat_ws("\n", *lines, F.lit(""), F.lit("---"), F.lit(""))


def prompt_dictionary(df: DataFrame, split: str, position: Column, fields: Sequence[str], rows: int = 1000) -> DataFrame:
    """(split, chunk, examples): each split's examples as JSON arrays of ``rows`` examples, in order of their positions."""
    chunk = F.floor(position / rows).cast("long").alias("chunk")
    lists = F.sort_array(F.collect_list(F.struct(position.alias("_at"), F.struct(*fields).alias("x"))))  # of ``rows`` examples at most
    return df.groupBy(split, chunk).agg(F.to_json(F.transform(lists, lambda r: r["x"])).alias("examples"))


def summary_json(parts: dict[str, DataFrame], config: dict) -> str:
    """Report-sized frames and a configuration as one JSON text with sorted keys."""
    rows = {name: [json.loads(r) for r in df.toJSON().toLocalIterator()] for name, df in parts.items()}
    return json.dumps(rows | {"config": config}, sort_keys=True, indent=2)
