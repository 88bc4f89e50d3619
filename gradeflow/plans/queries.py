"""One query for each operator group of SURVEY §2, over the shared tables. Operator ids are in the docstrings."""

from __future__ import annotations

from collections.abc import Callable
from string import Formatter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import formats, numbers, prompts, text
from ..operators import cube, grading, metrics, ordering, report, runs, summary
from ..sources import run_folders, scratch, sinks, tables
from ..sources.settings import Report
from ..sources.tables import table
from ..streaming.incremental import keep_latest
from ..streaming.incremental import windowed_counts as counts_by_window


def _q(x: Column) -> Column:
    return x.cast("long").cast("string")


def boxed_trace() -> Column:
    """Synthesised trace of a line item: a box, some with units, placeholders after it, or an unclosed box at the end."""
    n = F.col("l_linenumber")
    unit = F.when(n % 2 == 0, F.lit("\\text{ items}")).otherwise(F.lit(""))
    return F.concat(
        F.lit("step "), n.cast("string"), F.lit(" \\boxed{"), _q(F.col("l_quantity")), unit, F.lit("}"),
        F.when(n % 3 == 0, F.lit(" \\boxed{ANSWER}")).otherwise(F.lit("")), F.when(n % 5 == 0, F.lit(" \\boxed{7")).otherwise(F.lit("")),
    )


def forced_trace(trace: Column) -> Column:
    """A trace with a forced final answer."""
    return F.concat(trace, F.lit(text.FORCE_SUFFIX), _q(F.col("l_quantity")), F.lit("}"))


def accuracy_by_lang(spark: SparkSession, d: str) -> DataFrame:
    """Share of good labels by language."""
    rows = table(spark, d, "labels").filter("quality is not null").join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    return rows.groupBy("lang").agg(F.round(metrics.accuracy(F.col("quality") == 1), 6).alias("accuracy"), F.count(F.lit(1)).alias("n"))


def accuracy_empty_group(spark: SparkSession, d: str) -> DataFrame:
    """A1: sources without labels have accuracy 0."""
    rows = table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    return rows.groupBy("source").agg(F.round(metrics.accuracy(F.col("quality") == 1), 6).alias("accuracy"), F.count("quality").alias("n"))


def _split(spark: SparkSession, d: str) -> DataFrame:
    return ordering.seeded_split(table(spark, d, "documents").select("doc_id"), "doc_id", 7, 300, 100, 50)


def seeded_split(spark: SparkSession, d: str) -> DataFrame:
    """Sizes taken in order of the shuffle."""
    return _split(spark, d).select("doc_id", "split", "example_id")


def ratio_split(spark: SparkSession, d: str) -> DataFrame:
    """Exact sizes where there are enough rows, else the ratio."""
    convs = table(spark, d, "conversations").select("conv_id").distinct()
    few = ordering.ratio_split(convs, "conv_id", 11, 60, 40).withColumn("case", F.lit("exact"))
    return few.unionByName(ordering.ratio_split(convs, "conv_id", 11, 6_000_000, 4_000_000).withColumn("case", F.lit("ratio")))


def split_counts(spark: SparkSession, d: str) -> DataFrame:
    """A2, K8."""
    return _split(spark, d).groupBy("split").agg(F.count(F.lit(1)).alias("n"))


def stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    """Languages take turns."""
    docs = table(spark, d, "documents").select("doc_id", "lang")
    return ordering.stratified_sample(docs, "doc_id", "lang", 3, 200).select("doc_id", "lang", "turn", "position")


def simple_sample(spark: SparkSession, d: str) -> DataFrame:
    """L7, L2."""
    return ordering.simple_sample(table(spark, d, "events").select("event_id", "event_type"), "event_id", 5, 100)


def slice_offset(spark: SparkSession, d: str) -> DataFrame:
    """L3, L4, L9."""
    return ordering.rows_between(table(spark, d, "part").select("p_partkey", "p_brand"), "p_partkey", 20, 50)


def resume_anti_join(spark: SparkSession, d: str) -> DataFrame:
    """J1, A11, U3."""
    return ordering.resume(table(spark, d, "documents").select("doc_id", "lang"), table(spark, d, "labels"), "doc_id")


def capped_resume(spark: SparkSession, d: str) -> DataFrame:
    """Labelled documents and new ones make 500."""
    return ordering.capped_resume(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), "doc_id", 13, 500)


def subset_union(spark: SparkSession, d: str) -> DataFrame:
    """Rows of two subsets, and their distinct keys."""
    a = table(spark, d, "customer").select(F.col("c_nationkey").alias("nation"))
    b = table(spark, d, "supplier").select(F.col("s_nationkey").alias("nation"))
    return ordering.union_all(a, b).groupBy("nation").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("subset_ord").alias("n_subsets"))


def prompt_messages(spark: SparkSession, d: str) -> DataFrame:
    """User turns as prompts; the problem is read by its other name."""
    rows = tables.with_alias(table(spark, d, "conversations").withColumnRenamed("text", "question"), "problem", "question").withColumnRenamed("problem", "text").filter("role = 'user'").withColumn("m", prompts.prompt_messages(F.col("text")))
    return rows.select("conv_id", "turn", F.size("m").cast("long").alias("n_messages"), F.array_join("m.role", ",").alias("roles"), F.get("m.content", F.lit(1)).alias("content"), prompts.judge_message(F.col("text"), F.lit(" done ")).alias("judge"))


def chat_render(spark: SparkSession, d: str) -> DataFrame:
    """Whole conversations as one prompt."""
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("m"))
    return rows.select("conv_id", prompts.render_chat(F.col("m"), generate=True).alias("prompt"))


def split_from_id(spark: SparkSession, d: str) -> DataFrame:
    """P5: the split is part of the example id."""
    return _split(spark, d).groupBy(grading.split_of(F.col("example_id")).alias("split")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc"))


def extract_boxed(spark: SparkSession, d: str) -> DataFrame:
    """T1, T2, T3, T4."""
    rows = table(spark, d, "lineitem").withColumn("trace", boxed_trace())
    return text.with_answer(rows, F.col("trace"), "answer", "spans").select("l_orderkey", "l_linenumber", F.size("spans").cast("long").alias("n_spans"), "answer")


def numeric_fallback(spark: SparkSession, d: str) -> DataFrame:
    """T5: a number at the end, with and without words after it."""
    tail = F.when(F.col("l_linenumber") % 3 == 0, F.lit(" apples")).when(F.col("l_linenumber") % 3 == 1, F.lit(". ")).otherwise(F.lit(".5"))
    rows = table(spark, d, "lineitem").withColumn("t", F.concat(F.lit("so the answer is "), _q(F.col("l_quantity")), tail))
    return rows.select("l_orderkey", "l_linenumber", text.extract_answer(F.col("t")).alias("answer"))


def gold_answer(spark: SparkSession, d: str) -> DataFrame:
    """T12, P13."""
    s = F.when(F.col("o_orderkey") % 4 == 0, F.lit("no mark")).otherwise(F.concat(F.lit("work #### 1 #### "), F.col("o_custkey").cast("string"), F.lit(" ")))
    rows = table(spark, d, "orders").withColumn("s", s)
    return rows.select("o_orderkey", text.gold_answer(F.col("s"), F.lit("")).alias("gold"), F.concat(F.lit("\\boxed{"), text.gold_answer(F.col("s"), F.col("s")), F.lit("}")).alias("qa_trace"))


def trace_variants(spark: SparkSession, d: str) -> DataFrame:
    """Variants, and whether any ends in the order's number."""
    trace = F.when(F.col("l_linenumber") % 2 == 0, forced_trace(boxed_trace())).otherwise(boxed_trace())
    rows = table(spark, d, "lineitem").withColumn("v", text.trace_variants(trace))
    return rows.select("l_orderkey", "l_linenumber", F.size("v").cast("long").alias("n"), F.element_at("v", -1).alias("last"), F.exists("v", lambda x: F.startswith(x, F.concat(_q(F.col("l_quantity")), F.lit("}")))).alias("any_hit"))


def final_answer_tail(spark: SparkSession, d: str) -> DataFrame:
    """What generation leaves around a trace."""
    prompt, trace = F.concat(F.lit("Q"), F.col("l_linenumber").cast("string"), F.lit(": ")), boxed_trace()
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", prompt.alias("p"), trace.alias("t"), forced_trace(trace).alias("f"))
    special = F.concat(F.lit("<pad><pad><s>"), F.col("t"), F.lit("</s></s>"))
    return rows.select(
        "l_orderkey", "l_linenumber", text.without_prefix(F.concat("p", "t"), F.col("p")).alias("reply"), text.final_answer_tail(text.without_prefix(F.col("f"), F.col("t"))).alias("final"),
        text.close_thinking(F.concat(F.lit("<|assistant|>"), "t"), "<|assistant|>", "!").alias("closed"), text.clean_special(special, "<s>", "</s>", "<pad>").alias("clean"),
    )


def grade(spark: SparkSession, d: str) -> DataFrame:
    """G1 (native tiers), G2, G3, P2: raw and forced grades and the final ones."""
    gold = F.when(F.col("l_linenumber") % 4 == 0, F.concat(_q(F.col("l_quantity") * 2), F.lit("/2"))).otherwise(_q(F.col("l_quantity") + F.col("l_linenumber") % 2))
    rows = table(spark, d, "lineitem").withColumns({"trace": boxed_trace(), "gold": gold})
    rows = rows.withColumn("af", F.when(F.col("l_linenumber") % 3 == 0, F.concat(F.lit("\\boxed{"), _q(F.col("l_quantity")), F.lit(".0}"))))
    done = grading.compact(grading.grades(rows, {"raw": "trace", "af": "af"}, "gold"))
    return done.select("l_orderkey", "l_linenumber", "raw_extracted_answer", "raw_correct", "af_extracted_answer", "af_correct", "correct", "extracted_answer")


def method_label(spark: SparkSession, d: str) -> DataFrame:
    """P4, P11, P12."""
    method = F.when(F.col("event_type") == "click", F.lit("poe")).otherwise(F.col("event_type"))
    rows = table(spark, d, "events").select(grading.method_label(method, (F.col("event_id") % 3).cast("int")).alias("method"), "event_type")
    order = ["Base", "Purchase", "View", "Click"]
    named = rows.withColumn("series", runs.series_label(F.col("event_type"), {"buy": "Purchase"}))
    return named.groupBy("method", "series").agg(F.count(F.lit(1)).alias("n")).withColumn("place", runs.display_order(F.col("series"), order))


def label_map(spark: SparkSession, d: str) -> DataFrame:
    """P10: three nullable keys to a label; the rest is dropped."""
    k = F.col("event_id") % 5
    source = F.when(k == 0, F.lit("base")).when(k == 1, F.lit("qa")).when(k == 2, F.lit("traces")).otherwise(F.lit("other"))
    mode = F.when(k != 0, F.lit("naive"))
    beta = F.when(F.col("event_id") % 7 == 0, F.lit(1.0))
    rows = table(spark, d, "events").select("value", runs.row_label(source, mode, beta).alias("label")).filter("label is not null")
    return rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 4).alias("mean_value"))


def latest_per_key(spark: SparkSession, d: str) -> DataFrame:
    """The latest event of each user and type, of equal times the smallest id; and the newest of all."""
    events = table(spark, d, "events").select("user_id", "event_type", "ts", "event_id", "value")
    last = ordering.latest_per_key(events, ["user_id", "event_type"], "ts", "event_id")
    newest = events.groupBy("user_id").agg(F.max(F.struct("ts", "event_id")).alias("n")).select("user_id", F.col("n.event_id").alias("newest_event"))
    return last.join(newest, "user_id").select("user_id", "event_type", "event_id", "value", "newest_event")


def mean_stderr(spark: SparkSession, d: str) -> DataFrame:
    """A3: none, one and many values."""
    x = F.when(F.col("o_orderpriority").startswith("5"), F.lit(None)).otherwise(F.col("o_totalprice"))
    rows = table(spark, d, "orders").withColumn("x", x.cast("double")).withColumn("k", F.when(F.col("o_orderkey") == 1, F.lit("one")).otherwise(F.col("o_orderpriority")))
    out = metrics.mean_stderr(rows, ["k"], "x")
    return out.select("k", F.round("mean", 4).alias("mean"), F.round("stderr", 4).alias("stderr"), "n")


def mean_of_means(spark: SparkSession, d: str) -> DataFrame:
    """A4, A5."""
    rows = table(spark, d, "orders").select("o_custkey", "o_orderpriority", "o_totalprice").join(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    out = metrics.mean_of_means(rows, ["c_mktsegment"], "o_orderpriority", "o_totalprice")
    return out.select("c_mktsegment", F.round("mean", 4).alias("mean"), F.round("stderr", 4).alias("stderr"), "n")


def pmf(spark: SparkSession, d: str) -> DataFrame:
    """Shares of the bins 1 to 5 by ship status; 6 and more are out of range."""
    rows = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("flag"), (F.floor(F.col("l_quantity") / 10) + 1).cast("int").alias("score"))
    all_scores = rows.groupBy("flag").agg(F.round(F.avg("score"), 6).alias("mean_all"), F.count("score").alias("n_all"))
    out = metrics.pmf(rows, ["flag"], "score", [1, 2, 3, 4, 5]).join(all_scores, "flag")
    return out.select("flag", "bin", "n", F.round("share", 6).alias("share"), "mean_all", "n_all")


def moments_mass(spark: SparkSession, d: str) -> DataFrame:
    """A8, A9, A10, L8."""
    rows = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    rows = metrics.mean_one(rows, ["o_orderpriority"], "o_totalprice", "w")
    out = metrics.moments_and_mass(rows, ["o_orderpriority"], "w", "o_orderkey")
    return out.select("o_orderpriority", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), F.round("top_mass", 6).alias("top_mass"), "n")


def transforms(spark: SparkSession, d: str) -> DataFrame:
    """M1, M2."""
    x = (F.col("l_discount") - 0.05) * 400
    rows = table(spark, d, "lineitem").select("l_returnflag", x.alias("x"))
    named = {k: numbers.penalty(F.col("x"), k, 0.5) for k in ("exp", "softplus", "clipped_exp")}
    wide = metrics.shifted(rows, ["l_returnflag"], "x", "shifted").withColumns(named)
    return wide.groupBy("l_returnflag").agg(*(F.round(F.avg(k), 4).alias(f"mean_{k}") for k in (*named, "shifted")), F.count(F.lit(1)).alias("n"))


def _cells(spark: SparkSession, d: str) -> DataFrame:
    """Run rows made of orders: keys, time stamp, whether there are results, accuracy."""
    return table(spark, d, "orders").select(
        F.col("o_orderpriority").alias("dataset"), F.col("o_orderstatus").alias("provider"), (F.col("o_custkey") % 40).cast("int").alias("seed"),
        formats.run_stamp(F.col("o_orderdate")).alias("timestamp"), F.format_string("run%012d", "o_orderkey").alias("run"), (F.col("o_orderkey") % 4 != 0).alias("has_results"), ((F.col("o_orderkey") % 100) / 100).alias("accuracy"),
        F.when(F.col("o_orderkey") % 3 == 0, F.lit("Base")).when(F.col("o_orderkey") % 3 == 1, F.lit("Trace SFT")).alias("label"), F.col("o_orderkey").alias("key"),
    )


def _fallback(spark: SparkSession, d: str, step: int = 1) -> DataFrame:
    """A fallback table read from JSON maps, one for each nation, whose key times ``step`` is the seed."""
    label = lambda name, value: F.concat(F.lit(f'"{name}":'), value)
    key = F.concat(F.lit('{"1-URGENT/P/seed'), (F.col("n_nationkey") * step).cast("string"), F.lit('":{'))
    maps = table(spark, d, "nation").select(F.concat(key, label("Base", F.lit("0.25")), F.lit(","), label("Trace SFT", F.lit("0.5")), F.lit("}}")).alias("j"))
    return runs.read_fallbacks(maps, "j")


def fallback_fill(spark: SparkSession, d: str) -> DataFrame:
    """Fallbacks for keys without results: seeds beyond those of the runs."""
    actual = _cells(spark, d).filter("has_results").groupBy("dataset", "provider", "seed").agg(F.max("accuracy").alias("accuracy")).withColumn("label", F.lit("Base"))
    out = runs.fill(actual, _fallback(spark, d, 3))
    return out.select("dataset", "provider", "seed", "label", F.round("accuracy", 6).alias("accuracy"), "from_fallback")


def missing_grid(spark: SparkSession, d: str) -> DataFrame:
    """Cells of the grid with neither results nor a fallback: seeds from 30 on never ended, seeds from 40 on never ran."""
    cells = runs.grid(spark, dataset=["1-URGENT", "2-HIGH", "5-LOW"], provider=["F", "O", "P"], seed=list(range(50)))
    seen = _cells(spark, d).withColumn("has_results", F.col("has_results") & (F.col("seed") < 30))
    return runs.missing(cells, seen, _fallback(spark, d), "timestamp", "run")


def pivot_report(spark: SparkSession, d: str) -> DataFrame:
    """The comparison matrix."""
    k = F.col("o_orderkey")
    model = F.when(k % 3 == 0, F.lit("teacher_")).otherwise(F.lit("student_"))
    results = table(spark, d, "orders").select(
        F.col("o_orderpriority").alias("train_source"), F.when(k % 3 == 0, F.concat(model, "o_orderpriority", F.when(k % 2 == 0, F.lit("_test")).otherwise(F.lit("_train")))).otherwise(F.lit("student_small")).alias("eval_model"),
        ((k % 1000) / 1000).alias("accuracy"), F.when(k % 3 == 1, F.concat(F.lit("beta_s="), (k % 2).cast("string"), F.lit(", seed "), (k % 7).cast("string"))).otherwise(F.lit("")).alias("notes"), k.alias("ord"),
    )
    out = report.comparison_matrix(results, ["student_small", "student_small (beta_s=0)", "student_small (beta_s=1)"])
    names = {"student_small": "plain", "student_small (beta_s=0)": "beta_0", "student_small (beta_s=1)": "beta_1"}
    return out.withColumnsRenamed(names).withColumn("line", report.markdown_row([F.col(c) for c in ("source", "teacher_accuracy", *names.values())]))


def success_tally(spark: SparkSession, d: str) -> DataFrame:
    """A13."""
    return table(spark, d, "orders").groupBy("o_orderstatus").agg(F.count_if(F.col("o_custkey") % 4 == 0).alias("succeeded"), F.count(F.lit(1)).alias("n"))


def format_percent_duration(spark: SparkSession, d: str) -> DataFrame:
    """T19, T20, T21, M7."""
    share = F.col("o_orderkey") % 1000 / 1000
    seconds = F.col("o_custkey") % 9000
    return table(spark, d, "orders").select("o_orderkey", formats.percent(numbers.to_percent(share)).alias("share"), formats.duration(seconds.cast("double")).alias("took"), formats.run_stamp(F.col("o_orderdate")).alias("stamp"))


def subsequence_index(spark: SparkSession, d: str) -> DataFrame:
    """Where the third and fourth words of a turn end, as many of them as it has."""
    words = F.filter(F.split("text", " "), lambda w: w != "")
    rows = table(spark, d, "conversations").select("conv_id", "turn", words.alias("w"))
    return rows.select("conv_id", "turn", numbers.subsequence_index(F.col("w"), F.slice("w", 3, 2)).alias("at"), numbers.subsequence_index(F.col("w"), F.array(F.lit("no"), F.lit("such"))).alias("nowhere"))


def json_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Events' properties parsed, written as JSON and read back, by type."""
    events = table(spark, d, "events").select("event_id", "event_type", "props")
    again = F.from_json(F.to_json(F.from_json("props", "map<string,string>")), "map<string,string>")
    rows = events.withColumn("m", again)
    return rows.groupBy("event_type").agg(F.count("m").alias("n"), F.sum(F.size("m")).alias("n_keys"), F.count_if(F.size("m") > 0).alias("n_full"))


def prompt_dictionary(spark: SparkSession, d: str) -> DataFrame:
    """K9: examples of each split as JSON arrays, in order of their positions."""
    at = F.substring_index("example_id", "_", -1).cast("long")
    out = report.prompt_dictionary(_split(spark, d), "split", at, ["example_id", "doc_id"], 100)
    return out.select("split", "chunk", F.length("examples").cast("long").alias("n_chars"), F.md5("examples").alias("digest"))


def markdown_examples(spark: SparkSession, d: str) -> DataFrame:
    """K5: graded traces as Markdown sections."""
    k = F.col("o_orderkey")
    rows = table(spark, d, "orders").select(
        k.cast("string").alias("example_id"), F.lit(" solve ").alias("prompt"), F.concat(F.lit("trace "), F.col("o_custkey").cast("string")).alias("trace"), F.when(k % 2 == 0, F.lit("forced")).alias("af_final_answer_only"),
        F.col("o_custkey").cast("string").alias("raw_extracted_answer"), F.lit(None).cast("string").alias("af_extracted_answer"), (k % 3 == 0).alias("raw_correct"), F.lit(None).cast("boolean").alias("af_correct"), F.col("o_custkey").cast("string").alias("extracted_answer"), (k % 3 == 0).alias("correct"),
    )
    return rows.select("example_id", report.markdown_example().alias("section"))


def series(spark: SparkSession, d: str) -> DataFrame:
    """Plot-ready bars of the report."""
    out = sinks.series_table(flagship_run_report(spark, d), ["Base", "Finished", "Open"])
    return out.select("dataset", "label", F.col("place").cast("long").alias("place"), F.round("percent", 4).alias("percent"), F.round("stderr_percent", 4).alias("stderr_percent"))


def flagship_run_report(spark: SparkSession, d: str) -> DataFrame:
    """From run rows to statistics by dataset and series."""
    out = runs.run_report(_cells(spark, d), _fallback(spark, d), ["Base"], "Trace SFT", {"F": "Finished", "O": "Open", "P": "Pending"})
    return out.select("dataset", "label", F.round("mean", 6).alias("mean"), F.round("stderr", 6).alias("stderr"), "n")


def run_names(spark: SparkSession, d: str) -> DataFrame:
    """Run directory names parsed and filtered."""
    k = F.col("o_orderkey")
    provider = F.element_at(F.array(*map(F.lit, ("gemini", "claude", "openai", "bad_name"))), (k % 4 + 1).cast("int"))
    name = F.concat(F.lit("real_"), provider, F.lit("_"), F.when(k % 2 == 0, F.lit("math")).otherwise(F.lit("gsm8k")), F.lit("_traces_seed"), (k % 3).cast("string"), F.lit("_"), formats.run_stamp(F.col("o_orderdate")))
    rows = runs.parse_run_names(table(spark, d, "orders").select(name.alias("run")), "run").filter(F.col("seed").isin(0, 1))
    return rows.groupBy("provider", "dataset", "seed").agg(F.count(F.lit(1)).alias("n"), F.max("timestamp").alias("newest"))


def inspection(spark: SparkSession, d: str) -> DataFrame:
    """Typed records of graded traces and forced answers joined by key (finished orders have one); a forced grade counts even if nothing was extracted."""
    k = F.col("o_orderkey")
    box = F.concat(F.lit("so \\boxed{"), (k % 7).cast("string"), F.when(k % 2 == 0, F.lit("}")).otherwise(F.lit("")))
    traces = table(spark, d, "orders").select(k.cast("string").alias("example_id"), F.lit("test").alias("split"), F.lit("standard").alias("method"), F.lit("solve").alias("prompt"), box.alias("trace"), (k % 3).cast("string").alias("gold"))
    forced = table(spark, d, "orders").filter("o_orderstatus = 'F'").select(k.cast("string").alias("example_id"), F.when(k % 4 == 0, F.lit("nothing")).otherwise(F.concat(F.lit("\\boxed{"), (k % 3).cast("string"), F.lit("}"))).alias("af_final_answer_only"))
    rows = grading.with_forced(traces, forced, "example_id", "af_final_answer_only")
    graded = grading.grades(rows, {"raw": "trace", "af": "af_final_answer_only"}, "gold", "complete")
    full = grading.records(graded, "complete")
    return grading.inspection(full, "af_final_answer_only").select("example_id", "complete", "raw_correct", "af_correct", "raw_extracted_answer", "af_extracted_answer", "correct", "extracted_answer")


def judge_scores(spark: SparkSession, d: str) -> DataFrame:
    """Scores of the rubric by status, and their shares as plot-ready bars."""
    rows = table(spark, d, "orders").select(F.col("o_orderstatus").alias("source"), (F.col("o_custkey") % 8).cast("int").alias("score"))
    shares = metrics.pmf(grading.valid_scores(rows, "score"), ["source"], "score", [1, 2, 3, 4, 5])
    return sinks.pmf_series(shares, "source").select("series", "bin", F.round("percent", 6).alias("percent"))


def answer_equality(spark: SparkSession, d: str) -> DataFrame:
    """G1: values of answers in many notations, against an equal and an unequal one."""
    k = F.col("p_partkey") % 50 + 2
    t = lambda *xs: F.concat(*(F.lit(x) if isinstance(x, str) else x.cast("long").cast("string") for x in xs))
    forms = [
        (t("\\frac{", k, "}{4}"), (k / 4).cast("decimal(20,4)").cast("string")), (t(k, "\\sqrt{3}"), t("\\sqrt{", k * k * 3, "}")), (t(k, "\\frac{1}{2}"), t(k * 2 + 1, "/2")), (t("\\frac{", k, "\\pi}{2}"), t(k * 2, "\\pi/4")),
        (t(k, " \\times 10^{3}"), t(k * 1000)), (t(k, "\\%"), t(k, "/100")), (t("-", k, " 1/4"), t("-", k * 4 + 1, "/4")), (t("x+", k), t("x+", k)),
    ]
    cases = F.array(*(F.struct(F.lit(n).cast("long").alias("form"), a.alias("a"), b.alias("b"), F.concat(b, F.lit("1")).alias("c")) for n, (a, b) in enumerate(forms)))
    parts = table(spark, d, "part").select("p_partkey").repartition("p_partkey")  # few bytes make many rows
    rows = parts.select("p_partkey", F.explode(cases).alias("f")).select("p_partkey", "f.*")
    return grading.with_same(grading.with_same(rows, "a", "b", "equal"), "a", "c", "other").select("p_partkey", "form", "equal", "other")


#: Pairs of answers made of two numbers k and m of a part, and when they are equal.
ALGEBRA = [
    ("{k}x+{m}", "{m}+{k}x", "true"), ("{k}x+{m}", "{m}x+{k}", "k = m"), ("\\sqrt{{{k}}}+{m}", "{m}+\\sqrt{{{k}}}", "true"), ("\\sqrt{{{k}}}+\\sqrt{{{m}}}", "\\sqrt{{{k}+{m}}}", "false"),
    ("2^{{{k}}}", "2^{{{m}}}", "k = m"), ("(x+{k})(x+{m})", "x^2+{s}x+{p}", "true"), ("(x+{k})(x-{m})", "x^2+{s}x-{p}", "false"), ("\\frac{k1}{m1}", "{k1}/{m1}", "true"), ("\\frac{{{k}}}{{{m}}}", "\\frac{{{m}}}{{{k}}}", "k = m"),
    ("\\frac{{x^2-{kk}}}{{x-{k}}}", "x+{k}", "true"), ("{k},{m}", "{m},{k}", "true"), ("({k},{m})", "({m},{k})", "k = m"), ("({k},{m})", "({k}{m})", "false"), ("\\{{{k},{m}\\}}", "\\{{{m},{k}\\}}", "true"),
    ("\\{{{k},{m}\\}}", "({k},{m})", "false"), ("[{k},{m})", "[{k}, {m})", "true"), ("[{k},{m})", "({k},{m}]", "false"), ("{k},{m}", "{k}{m}", "false"), ("{k},234", "{k}234", "true"), ("{k},23", "{k}23", "false"),
    ("{k}^\\circ", "{k}", "true"), ("x={k}", "{m}", "k = m"), ("x={k}", "{k}", "true"), ("{k}\\pi+{m}", "{m}+\\pi{k1}", "false"), ("1000000000{k}", "1000000000{m}", "k = m"), ("0.0000000000{k}", "0", "false"),
    ("{k}.{m}00", "{k}.{m}", "true"), ("{k}/{m}", "{kk}/{p}", "true"), ("{k}\\sqrt{{{m}}}", "\\sqrt{{{kkm}}}", "true"), ("\\frac{{1}}{{\\sqrt{{{m}}}}}", "\\frac{{\\sqrt{{{m}}}}}{{{m}}}", "true"),
    ("(-\\infty,{k})\\cup({m},\\infty)", "({m},\\infty)\\cup(-\\infty,{k})", "true"), ("[{k},\\infty)", "[{k},{m})", "false"), ("{k} apples", "{k}", "false"), ("{k}i^2", "-{k}", "true"), ("\\sqrt{{-{kk}}}", "{k}i", "true"),
    ("{k}\\text{{ cm}}", "{k}", "true"), ("\\left({k},\\frac{{{m}}}{{2}}\\right)", "({k},{m}/2)", "true"), ("\\log({k})", "\\log({m})", "k = m"), ("{k}x+{m}y", "{k}x+{m}z", "false"), ("x^{{{k}}}x^{{{m}}}", "x^{{{s}}}", "true"),
    ("{k}!/{k}", "({k}-1)!", "true"), ("-(-{k})", "{k}", "true"), ("{k}\\times10^{{3}}", "{k}000", "true"), ("{k}%", "{k}/100", "true"), ("{k}:{m}", "{k}/{m}", "false"),
]


def algebra(spark: SparkSession, d: str) -> DataFrame:
    """G1: expressions, tuples, intervals, sets and exact numbers of two numbers a part, with the kind of the first of each pair."""
    k, m = F.col("p_partkey") % 50 + 2, (F.col("p_size") % 50 + 2).cast("long")
    numbers_of = {"k": k, "m": m, "k1": k % 9 + 1, "m1": m % 9 + 1, "s": k + m, "p": k * m, "kk": k * k, "kkm": k * k * m}

    def made(template: str) -> Column:
        """The template's text with numbers in their places."""
        parts = [(a, F.lit(a)) if not name else (a, F.concat(F.lit(a), numbers_of[name].cast("string"))) for a, name, _, _ in Formatter().parse(template)]
        return F.concat(*(c for _, c in parts))

    cases = F.array(*(F.struct(F.lit(n).cast("long").alias("form"), made(a).alias("a"), made(b).alias("b")) for n, (a, b, _) in enumerate(ALGEBRA)))
    parts = table(spark, d, "part").select("p_partkey", "p_size").repartition("p_partkey")  # few bytes make many rows
    rows = parts.select("p_partkey", F.explode(cases).alias("c")).select("p_partkey", "c.*")
    return grading.with_same(rows, "a", "b", "equal", "turned").select("p_partkey", "form", "equal", "turned")


def student_grid(spark: SparkSession, d: str) -> DataFrame:
    """Runs planned for each teacher that has results; beta varies for one mode only."""
    results = table(spark, d, "orders").select(F.concat(F.lit("teacher_"), "o_orderpriority").alias("teacher"))
    planned = runs.students_of(results, "teacher", ["naive", "strategic_fd"], [0.5, 1.0, 2.0])
    return planned.groupBy("source", "mode").agg(F.count(F.lit(1)).alias("n"), F.sum("beta_s").alias("sum_beta"))


def masked_loss(spark: SparkSession, d: str) -> DataFrame:
    """Mean of values under a mask."""
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.round(metrics.masked_mean(F.col("l_quantity"), F.col("l_linenumber") % 2 == 0), 6).alias("loss"))


def problem_files(spark: SparkSession, d: str) -> DataFrame:
    """Problem sets written as JSON lines and loaded by split, subset after subset."""
    folder = scratch.folder(spark, "problems")
    rows = table(spark, d, "orders").select(F.concat(F.lit("q"), "o_orderkey").alias("question"), F.concat(F.lit("#### "), "o_custkey").alias("answer"), F.col("o_orderpriority").alias("type"), F.col("o_orderstatus").alias("status"))
    part = F.when(F.col("status").isin("F", "P"), F.col("status")).otherwise(F.lit("rest"))
    for name in ("F", "rest", "P"):
        sinks.write_json_lines(rows.filter(part == name).drop("status"), f"{folder}/{name}")
    found = tables.load_problems(spark, "question_answer", train=[f"{folder}/F", f"{folder}/rest"], test=f"{folder}/P")
    return found.groupBy("split", F.col("subset_ord").cast("long").alias("subset_ord"), "type").agg(F.count(F.lit(1)).alias("n"), F.min("problem").alias("first_problem"), F.max(text.gold_answer(F.col("solution"), F.lit(""))).alias("last_gold"))


def trace_files(spark: SparkSession, d: str) -> DataFrame:
    """Traces appended as JSON lines, rewritten as a whole, read by stem, with keys done so far and a JSON array."""
    folder = scratch.folder(spark, "traces")
    path = f"{folder}/{sinks.trace_file('gemini', 'math')}"
    rows = table(spark, d, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("question"), F.col("role").alias("subject"), (F.col("turn") % 2 == 0).alias("correct"))
    user = F.coalesce(F.col("subject") == "user", F.lit(False))
    for some in (user, ~user):
        sinks.append_json_lines(rows.filter(some), path)
    sinks.rewrite_json_lines(tables.read_traces(spark, path.removesuffix(".jsonl")).withColumn("predicted_answer", F.upper("subject")), path)
    again = tables.read_traces(spark, path.removesuffix(".jsonl"))
    by = again.groupBy("subject", "predicted_answer").agg(F.count(F.lit(1)).alias("n"), F.count_if("correct").alias("n_correct"))
    sinks.write_json_array(by, f"{folder}/summary.json")
    found = tables.read_json_array(spark, f"{folder}/summary.json", by.schema)
    n_done = tables.done_keys(spark, path).agg(F.count(F.lit(1)).alias("n_done"))  # one row
    return found.join(F.broadcast(n_done))


def quarantine(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as JSON lines, every seventh turn broken off: rows by role, and bad lines by how they begin."""
    folder = scratch.folder(spark, "lines")
    whole = F.to_json(F.struct("conv_id", "turn", "role", "text"))
    table(spark, d, "conversations").select(F.when(F.col("turn") % 7 == 3, F.substring(whole, 1, 12)).otherwise(whole).alias("value")).write.text(folder)
    rows, bad = tables.quarantined(spark, folder, table(spark, d, "conversations").schema)
    counts = rows.groupBy(F.col("role").alias("part")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("n_chars"))
    return counts.unionByName(bad.groupBy(F.concat(F.lit("bad "), F.substring("line", 1, 10)).alias("part")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("line")).alias("n_chars")))


def latest_stream(spark: SparkSession, d: str) -> DataFrame:
    """W2, W3 on a stream: the latest event of each user and type, kept in state and rewritten after each batch."""
    folder = scratch.folder(spark, "stream")
    rows = spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d}/events.parque[t]").select("user_id", "event_type", "ts", "event_id", "value")  # a pattern, since a stream takes no file by its name
    keep_latest(rows, ["user_id", "event_type"], "ts", "event_id", f"{folder}/state", f"{folder}/latest").awaitTermination()
    found = tables.read_json_lines(spark, f"{folder}/latest", rows.schema)
    return found.select("user_id", "event_type", "event_id", "value")


def _run_folders(spark: SparkSession, d: str) -> DataFrame:
    """Runs made of orders, one for each provider, dataset, seed and month; those of some months and of the last seed haven't ended."""
    month = F.date_format("o_orderdate", "yyyyMM")
    provider = F.when(F.col("o_orderstatus") == "F", "claude").when(F.col("o_orderstatus") == "O", "gemini").otherwise("openai")
    rows = table(spark, d, "orders").select(
        F.concat(F.lit("real_"), provider, F.lit("_"), F.when(F.col("o_orderpriority") < "3", "math").otherwise("gsm8k"), F.lit("_traces_seed"), F.col("o_custkey") % 5, F.lit("_"), month, F.lit("01_000000")).alias("run"),
        ((F.month("o_orderdate") % 5 != 0) & (F.col("o_custkey") % 5 < 4)).alias("ended"), F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"),
    )
    row = lambda source, mode, x: F.struct(F.lit(source).alias("source"), F.lit(mode).cast("string").alias("mode"), F.lit(None).cast("double").alias("beta_s"), F.avg(x).alias("accuracy"))
    results = F.array(row("base", None, F.col("k") % 100 / 100), row("qa", "naive", F.col("c") % 100 / 100), row("traces", "naive", (F.col("k") % 3 == 0).cast("double")), row("traces", "strategic_fd", F.lit(1.0)))
    return rows.groupBy("run").agg(F.when(F.first("ended"), results).alias("results"))


def run_summary(spark: SparkSession, d: str) -> DataFrame:
    """Run folders written by tasks, found, reported, and the leaves of the summary's JSON with the gaps."""
    folder = scratch.folder(spark, "runs")
    run_folders.write_runs(_run_folders(spark, d), folder)
    key = F.concat(F.when(F.col("n_nationkey") % 2 == 0, "math").otherwise("gsm8k"), F.lit("/"), F.element_at(F.array(*map(F.lit, ("claude", "gemini", "openai"))), (F.col("n_nationkey") % 3 + 1).cast("int")), F.lit("/seed"), F.col("n_nationkey") + 4)
    maps = table(spark, d, "nation").select(F.concat(F.lit('{"'), key, F.lit('":{"Base":0.25,"Trace SFT":0.5}}')).alias("j"))
    asked = Report(runs_root=folder, providers=["claude", "gemini", "openai"], datasets=["gsm8k", "math"], seeds=[0, 1, 2, 3, 4])
    found = summary.summarize(spark, asked, runs.read_fallbacks(maps, "j"))
    texts = spark.createDataFrame(list(summary.summary_parts(found, folder).items()), "part string, j string")
    number, said = F.try_variant_get("leaf", "$", "double"), F.replace(F.try_variant_get("leaf", "$", "string"), F.lit(folder), F.lit("runs"))
    out = cube.leaves(texts, "j", 4).select("part", F.array_join("path", " > ").alias("path"), F.round(number, 6).alias("number"), F.when(number.isNull(), said).alias("text"))
    gaps = found.gaps.select(F.lit("missing").alias("part"), F.concat_ws(" > ", "dataset", "provider", "seed").alias("path"), F.lit(None).cast("double").alias("number"), F.col("newest_run").alias("text"))
    return out.unionByName(gaps)


def event_leaves(spark: SparkSession, d: str) -> DataFrame:
    """J9 where labels aren't known ahead: leaves of events' properties by type and path."""
    events = table(spark, d, "events").select("event_type", "props")
    rows = cube.leaves(events, "props").withColumn("text", F.try_variant_get("leaf", "$", "string"))
    return rows.groupBy("event_type", F.array_join("path", ".").alias("path")).agg(F.count(F.lit(1)).alias("n"), F.min("text").alias("first"), F.max("text").alias("last"))


def windowed_counts(spark: SparkSession, d: str) -> DataFrame:
    """Events by day and type: the stream's operator on a table, where the watermark does nothing."""
    events = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return counts_by_window(events, "ts", "1 day", "1 hour", "event_type").select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "event_type", "n")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Name -> query."""
    own = [
        accuracy_by_lang, accuracy_empty_group, seeded_split, ratio_split, split_counts, stratified_sample, simple_sample, slice_offset, resume_anti_join, capped_resume, subset_union, prompt_messages, chat_render,
        split_from_id, extract_boxed, numeric_fallback, gold_answer, trace_variants, final_answer_tail, grade, method_label, label_map, latest_per_key, mean_stderr, mean_of_means, pmf, moments_mass, transforms, fallback_fill,
        missing_grid, pivot_report, success_tally, format_percent_duration, subsequence_index, json_roundtrip, prompt_dictionary, markdown_examples, series, flagship_run_report, run_names,
        inspection, judge_scores, answer_equality, algebra, student_grid, masked_loss, problem_files, trace_files, quarantine, latest_stream, run_summary, event_leaves, windowed_counts,
    ]
    return {f"q_{f.__name__}": f for f in own}
