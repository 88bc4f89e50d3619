from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from gradeflow.functions import text
from gradeflow.operators import grading, metrics, ordering, report, runs
from gradeflow.sources import settings, sinks, tables


def test_accuracy_of_nothing(spark):
    assert spark.createDataFrame([], "c boolean").agg(metrics.accuracy(F.col("c")).alias("a")).first().a == 0.0


def test_mean_stderr(spark):
    rows = spark.createDataFrame([("none", None), ("one", 0.5), ("two", 0.4), ("two", 0.6)], "k string, x double")
    got = {r.k: (r["mean"], r["stderr"], r.n) for r in metrics.mean_stderr(rows, ["k"], "x").collect()}
    assert got["none"] == (None, None, 0) and got["one"] == (0.5, 0.0, 1)
    assert got["two"][0] == pytest.approx(0.5) and got["two"][1] == pytest.approx(0.1)


def test_pmf_and_mass(spark):
    rows = spark.createDataFrame([("a", s) for s in (1, 1, 5, 9)] + [("b", 9)], "k string, s int")
    got = {(r.k, r.bin): r.share for r in metrics.pmf(rows, ["k"], "s", [1, 2, 3, 4, 5]).collect()}
    assert [got["a", k] for k in range(1, 6)] == pytest.approx([2 / 3, 0, 0, 0, 1 / 3]) and got["b", 1] is None
    w = spark.createDataFrame([(k, "g", x) for k, x in enumerate((5.0, 3.0, 1.0, 1.0))], "id int, g string, x double")
    assert metrics.moments_and_mass(w, ["g"], "x", "id").first().top_mass == pytest.approx(0.5)


@pytest.mark.parametrize(("n", "train", "holdout", "out"), [(10, 6, 6, (5, 5)), (20, 6, 6, (6, 6)), (0, 6, 6, (0, 0))])
def test_ratio_split(spark, n, train, holdout, out):
    got = ordering.ratio_split(spark.range(n), "id", 1, train, holdout).groupBy("split").count().collect()
    got = {r.split: r["count"] for r in got}
    assert (got.get("train", 0), got.get("holdout", 0)) == out


def test_positions_dont_depend_on_partitions(spark):
    a = ordering.with_position(spark.range(0, 500, 1, 7), 3, "id").collect()
    b = ordering.with_position(spark.range(0, 500, 1, 1), 3, "id").collect()
    assert sorted((r.id, r.pos) for r in a) == sorted((r.id, r.pos) for r in b)
    assert sorted(r.pos for r in a) == list(range(500)) and a[0].n_total == 500


def test_splits_are_disjoint(spark):
    rows = ordering.seeded_split(spark.range(100), "id", 1, 60, 30, 30).collect()
    assert len(rows) == len({r.id for r in rows}) == 100
    assert sorted(r.example_id for r in rows if r.split == "test") == [f"test_{k}" for k in range(10)]


def test_stratified_sample_is_even(spark):
    rows = spark.range(300).withColumn("s", F.when(F.col("id") < 5, "small").when(F.col("id") < 100, "mid").otherwise("big"))
    got = {r.s: r["count"] for r in ordering.stratified_sample(rows, "id", "s", 1, 65).groupBy("s").count().collect()}
    assert got == {"small": 5, "mid": 30, "big": 30}


def test_resume(spark):
    rows, done = spark.createDataFrame([(1,), (2,), (None,)], "k int"), spark.createDataFrame([(2,), (None,), (9,)], "k int")
    assert sorted(r.k or 0 for r in ordering.resume(rows, done, "k").collect()) == [0, 1]
    assert ordering.capped_resume(spark.range(50), spark.range(10), "id", 1, 25).count() == 15
    assert ordering.capped_resume(spark.range(50), spark.range(40), "id", 1, 25).count() == 0


def test_run_names_and_labels(spark):
    names = spark.createDataFrame([("real_gemini_math_traces_seed3_20250101_120000",), ("other",)], "n string")
    assert [(r.provider, r.dataset, r.seed, r.timestamp) for r in runs.parse_run_names(names, "n").collect()] == [("gemini", "math", 3, "20250101_120000")]
    rows = spark.createDataFrame([("base", None, None), ("qa", "naive", None), ("qa", "naive", 1.0), (None, None, None)], "s string, m string, b double")
    assert [r.y for r in rows.select(runs.row_label(F.col("s"), F.col("m"), F.col("b")).alias("y")).collect()] == ["Base", "SFT on Q&A", None, None]


def test_latest_and_missing(spark):
    rows = spark.createDataFrame([("d", "p", 1, "t1", "r1", True), ("d", "p", 1, "t2", "r2", False), ("d", "q", 1, "t1", "r3", False)], "dataset string, provider string, seed int, timestamp string, run string, has_results boolean")
    assert ordering.latest_per_key(rows.filter("has_results"), runs.KEY, "timestamp", "run").first().run == "r1"
    cells = runs.grid(spark, dataset=["d"], provider=["p", "q", "r"], seed=[1])
    none = spark.createDataFrame([], "dataset string, provider string, seed int, label string, accuracy double")
    got = {r.provider: r.newest_run for r in runs.missing(cells, rows, none, "timestamp", "run").collect()}
    assert got == {"q": "r3", "r": None}


def test_matrix(spark):
    rows = [("t", "teacher_t_test", 0.5, "", 1), ("t", "student_a", 0.25, "beta_s=1, x", 2), ("u", "student_a", 0.75, "", 3), ("u", "student_a", 0.125, "", 4), ("v", None, 0.1, None, 5)]
    df = spark.createDataFrame(rows, "train_source string, eval_model string, accuracy double, notes string, ord int")
    got = {r.source: r for r in report.comparison_matrix(df).collect()}
    assert got["t"]["student_a (beta_s=1)"] == "0.2500<br><sub>x</sub>" and got["u"]["student_a"] == "0.1250" and got["teacher_t"].teacher_accuracy == "0.5000" and got["u"].teacher_accuracy == ""
    assert report.markdown_table(spark.createDataFrame([("a", 1)], "x string, y int"), "x") == "| x | y |\n| --- | --- |\n| a | 1 |"


def test_json_sources(spark, tmp_path):
    (tmp_path / "t.jsonl").write_text('{"question": "a"}\n\nbad\n{"other": 1}\n{"question": "b"}\n')
    path = str(tmp_path / "t.jsonl")
    assert sorted(r.question for r in tables.done_keys(spark, path).collect()) == ["a", "b"]
    assert tables.done_keys(spark, str(tmp_path / "none.jsonl")).count() == 0
    (tmp_path / "u.json").write_text(json.dumps([{"question": "a", "correct": True}]))
    assert tables.read_traces(spark, str(tmp_path / "u")).first().correct is True
    with pytest.raises(FileNotFoundError):
        tables.read_traces(spark, str(tmp_path / "v"))
    with pytest.raises(ValueError):
        tables.load_problems(spark, "nothing", train=path)
    run = tmp_path / "runs" / "real_gemini_math_traces_seed3_20250101_120000"
    run.mkdir(parents=True)
    (run / "results.json").write_text(json.dumps([{"source": "base", "accuracy": 0.5}]))
    (tmp_path / "runs" / "empty").mkdir()
    assert [tuple(r) for r in tables.list_runs(spark, str(tmp_path / "runs")).collect()] == [("empty", False), (run.name, True)]
    assert tables.read_run_results(spark, str(tmp_path / "runs")).first().run == run.name
    sinks.append_json_lines(spark.range(2), str(tmp_path / "out"))
    sinks.append_json_lines(spark.range(2), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 4
    assert sinks.manifest(spark.createDataFrame([("train",), ("train",)], "split string"), "split", {"teachers": {"standard": True}}, run="x") == {"run": "x", "split_sizes": {"train": 2}, "planned_methods": {"teachers": {"standard": True}}}
    stats = spark.createDataFrame([("d", "Base", 0.5, 0.25, 2), ("d", "GPT", None, None, 0)], "dataset string, label string, mean double, stderr double, n int")
    pairs = lambda *rows: spark.createDataFrame(list(rows), "a string, b string")
    assert sinks.console_summary(pairs(("r", "x")), pairs(), pairs(("m", None)), stats).split("\n") == ["Selected runs: 1", "  r  x", "Fallbacks: 0", "Missing: 1", "  m  -", "Values", "  d  Base: 50.0 +- 25.0 (n=2)", "  d  GPT: - +- - (n=0)"]
    sinks.write_text(spark, report.summary_json({"stats": stats}, {"seed": 1}), str(tmp_path / "deep" / "summary.json"))
    assert json.loads((tmp_path / "deep" / "summary.json").read_text())["config"] == {"seed": 1}


def test_settings(tmp_path):
    path = str(tmp_path / "s.yaml")
    settings.write_settings(settings.Settings(), path)
    assert settings.read_settings(path) == settings.Settings()
    (tmp_path / "bad.yaml").write_text("splits: {nothing: 1}\n")
    with pytest.raises(ValueError):
        settings.read_settings(str(tmp_path / "bad.yaml"))
    assert settings.overrides(["a = b=c "]) == {"a": "b=c"}
    with pytest.raises(ValueError):
        settings.overrides(["a"])


def test_resume_stream(spark, tmp_path):
    from pyspark.sql import types as T

    from gradeflow.streaming.incremental import resume_stream

    folder, seen = tmp_path / "in", []
    folder.mkdir()
    schema = T.StructType([T.StructField("k", T.StringType())])
    work = lambda df, batch: seen.extend(r.k for r in df.collect())
    for k, rows in enumerate((["a", "b"], ["b", "c"])):
        (folder / f"{k}.json").write_text("".join(json.dumps({"k": x}) + "\n" for x in rows))
        resume_stream(spark, str(folder), schema, "k", str(tmp_path / "mark"), work).awaitTermination()
    assert sorted(seen) == ["a", "b", "c"]


@pytest.mark.parametrize("name", ["q_inspection", "q_grade"])
def test_graded_rows_meet_python_twice(spark, data, name):
    """However many traces a row has: each step in Python keeps a worker for each core."""
    import __spark_entry__ as registered

    plan = registered.queries()[name](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 2


def test_traces_graded_together_are_graded_as_alone(spark):
    deep = "\\boxed{" + "{" * 12 + "7" + "}" * 13
    traces = [None, "", "so \\boxed{7}", "\\boxed{ANSWER}", "\\boxed{14/2} \\boxed{an$swer}", "\\boxed{7\\text{ cm}}", "\\boxed{\\sqrt{49}}", "\\boxed{8", "the answer is 7.0", deep, "\\boxed{1} **Final Answer**\n\\boxed{7}"]
    rows = [(n, a, b, gold) for n, (a, b, gold) in enumerate((a, b, gold) for a in traces for b in traces for gold in ("7", "\\frac{14}{2}", None))]
    df = spark.createDataFrame(rows, "id int, a string, b string, gold string")
    out = grading.grades(df, {"raw": "a", "af": "b"}, "gold", "complete")
    assert out.columns == [*df.columns, "raw_extracted_answer", "af_extracted_answer", "raw_correct", "af_correct", "complete"]
    alone = {(r.a, r.gold): r for r in grading.grade(df.withColumn("complete", text.has_complete_box(F.col("a"))), "a", "gold", "x").collect()}
    for r in out.collect():
        a, b = alone[r.a, r.gold], alone[r.b, r.gold]
        assert (r.raw_extracted_answer, r.raw_correct, r.af_extracted_answer, r.af_correct) == (a.x_extracted_answer, a.x_correct, b.x_extracted_answer, b.x_correct)
        assert (None if r.a is None else r.complete) == (None if r.a is None else a.complete)
    assert alone[deep, "7"].x_correct and alone[deep, "7"].complete and not alone["\\boxed{8", "7"].complete
