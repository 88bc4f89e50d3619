from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from gradeflow.__main__ import main
from gradeflow.operators import cube
from gradeflow.sources import run_folders

RESULT = "run string, results array<struct<source: string, mode: string, beta_s: double, accuracy: double>>"


def made(spark, root):
    """Runs of two providers: an older and a newer completed one, a newest that hasn't ended, one without labelled rows."""
    name = "real_{}_math_traces_seed{}_2025010{}_120000".format
    base, qa, traces = ("base", None, None, 0.25), ("qa", "naive", None, 0.5), ("traces", "naive", None, 0.75)
    rows = [
        (name("gemini", 1, 1), [("base", None, None, 0.125)]), (name("gemini", 1, 2), [("base", None, None, 0.0), base, qa, traces, ("traces", "naive", 0.5, 1.0)]),
        (name("gemini", 1, 3), None), (name("claude", 1, 1), []), (name("claude", 2, 1), None), (name("other", 1, 1), [base]), ("notes", None),
    ]
    run_folders.write_runs(spark.createDataFrame(rows, RESULT).repartition(3), root)
    return name


@pytest.mark.parametrize("runs_a_task", [1, 500])
def test_run_folders_round_trip(spark, tmp_path, runs_a_task):
    root = str(tmp_path / "runs")
    name = made(spark, root)
    (tmp_path / "runs" / "real_claude_math_traces_seed9_20250101_120000.txt").write_text("a file")
    found = {r.run: r for r in run_folders.read_runs(spark, f"file:{root}", runs_a_task=runs_a_task).collect()}
    assert set(found) == {name("gemini", 1, k) for k in (1, 2, 3)} | {name("claude", 1, 1), name("claude", 2, 1), name("other", 1, 1)}
    row = found[name("gemini", 1, 2)]
    assert (row.provider, row.dataset, row.seed, row.timestamp, row.has_results, len(row.results)) == ("gemini", "math", 1, "20250102_120000", True, 5)
    assert not found[name("claude", 2, 1)].has_results and found[name("claude", 2, 1)].results is None and found[name("claude", 1, 1)].results == []
    few = run_folders.read_runs(spark, root, providers=["claude"], datasets=["math"], seeds=[2], runs_a_task=runs_a_task)
    assert [r.run for r in few.collect()] == [name("claude", 2, 1)]
    assert run_folders.read_runs(spark, str(tmp_path / "none")).collect() == []


def test_broken_results_are_named(spark, tmp_path):
    folder = tmp_path / "real_claude_math_traces_seed1_20250101_120000"
    folder.mkdir()
    for text in ('[{"source": "base"', "{}x", "[1]"):
        (folder / "results.json").write_text(text)
        with pytest.raises(Exception, match="results.json"):
            run_folders.read_runs(spark, str(tmp_path)).collect()


def test_report_command(spark, tmp_path):
    root, out = str(tmp_path / "runs"), str(tmp_path / "out")
    name = made(spark, root)
    (tmp_path / "f.json").write_text(json.dumps({"math/claude/seed2": {"Base": 0.75}, "math/gemini/1": {"Base": 0.5}, "gsm8k/x/seed7": {"Trace SFT": 1}}))
    (tmp_path / "s.yaml").write_text(f"report: {{runs_root: {root}, providers: [gemini], datasets: [math], seeds: [1, 2]}}\n")
    lines = main(["report", "--settings", str(tmp_path / "s.yaml"), "--set", "report.providers=claude,gemini", "--fallbacks", str(tmp_path / "f.json"), "--out", out], spark)
    got = json.loads((tmp_path / "out" / "llm_accuracy_summary.json").read_text())
    assert got["selected_runs"] == {k: {"run_dir": f"{root}/{r}", "timestamp": r[-15:]} for k, r in (("math/gemini/seed1", name("gemini", 1, 2)), ("math/claude/seed1", name("claude", 1, 1)))}
    assert got["per_seed_provider"] == {"math": {"claude": {"1": {}, "2": {"Base": 0.75}}, "gemini": {"1": {"Base": 0.25, "SFT on Q&A": 0.5, "Trace SFT": 0.75}}}, "gsm8k": {"x": {"7": {"Trace SFT": 1.0}}}}
    assert got["used_fallbacks"] == [{"dataset": "gsm8k", "provider": "x", "seed": 7}, {"dataset": "math", "provider": "claude", "seed": 2}]
    stats = got["plot_stats"]["math"]
    assert stats["Base"] == {"mean": 0.5, "stderr": pytest.approx(0.25), "n": 2} and stats["Gemini"] == {"mean": 0.75, "stderr": 0.0, "n": 1}
    assert stats["Claude"] == {"mean": None, "stderr": None, "n": 0} and set(stats) == {"Base", "SFT on Q&A", "Claude", "Gemini"}
    assert got["config"]["providers"] == ["claude", "gemini"] and got["config"]["plot_dir"] == out
    assert "Missing: 1" in lines and "  math  gemini  2  -" in lines and "Selected runs: 2" in lines and "math  Claude: - +- - (n=0)" in lines
    assert {(r.label, r.percent) for r in spark.read.json(f"{out}/bars").collect()} == {("Base", 50.0), ("SFT on Q&A", 50.0), ("Claude", None), ("Gemini", 75.0)}


def test_report_of_nothing(spark, tmp_path):
    main(["report", "--set", f"report.runs_root={tmp_path / 'none'}", "--out", str(tmp_path / "out")], spark)
    got = json.loads((tmp_path / "out" / "llm_accuracy_summary.json").read_text())
    assert (got["selected_runs"], got["per_seed_provider"], got["plot_stats"], got["used_fallbacks"]) == ({}, {}, {}, [])
    with pytest.raises(ValueError, match="no setting"):
        main(["report", "--set", "report.nothing=1", "--out", str(tmp_path / "out")], spark)


def test_split_command(spark, tmp_path):
    rows = [{"question": f"q{k}", "answer": f"#### {k}"} for k in range(40)] + [{"question": "q0", "answer": "#### 0"}]
    (tmp_path / "p.jsonl").write_text("".join(json.dumps(r) + "\n" for r in rows))
    sizes = [f"--set=splits.{k}={n}" for k, n in (("train", 20), ("holdout", 10), ("test", 30))]
    for out in ("a", "b"):
        main(["split", "--input", str(tmp_path / "p.jsonl"), "--out", str(tmp_path / out), *sizes], spark)
    a, b = (sorted((r.example_id, r.problem) for r in spark.read.json(str(tmp_path / o / "splits")).collect()) for o in ("a", "b"))
    assert a == b and sorted(p for _, p in a) == sorted(r["question"] for r in rows)
    facts = json.loads((tmp_path / "a" / "manifest.json").read_text())["config"]
    assert facts["split_sizes"] == {"train": 20, "holdout": 10, "test": 11}
    assert json.loads((tmp_path / "a" / "settings.json").read_text())["splits"]["train"] == 20


def test_grade_command(spark, tmp_path):
    rows = [{"subject": "s", "trace": "so \\boxed{3}", "gold_answer": str(k)} for k in (3, 4)]
    (tmp_path / "t.jsonl").write_text("".join(json.dumps(r) + "\n" for r in rows) + "broken\n")
    assert "| s | 0.5 | 2 |" in main(["grade", "--input", str(tmp_path / "t.jsonl"), "--out", str(tmp_path / "out")], spark)
    assert [r.line for r in spark.read.json(str(tmp_path / "out" / "bad_lines")).collect()] == ["broken"]


def test_leaves_of_any_depth(spark):
    rows = [(1, '{"a":{"b":[1,{"c":null}],"d":{}},"e":"x","f":[]}'), (2, None), (3, "bad{"), (4, "5"), (5, "{}"), (6, '{"k.l":true}')]
    got = cube.leaves(spark.createDataFrame(rows, "id int, j string"), "j", 4).select("id", "path", F.to_json("leaf").alias("leaf")).collect()
    want = {(1, ("a", "b", "0"), "1"), (1, ("a", "b", "1", "c"), "null"), (1, ("a", "d"), "{}"), (1, ("e",), '"x"'), (1, ("f",), "[]"), (2, (), None), (3, (), None), (4, (), "5"), (5, (), "{}"), (6, ("k.l",), "true")}
    assert {(r.id, tuple(r.path), r.leaf) for r in got} == want
    with pytest.raises(Exception, match="nested deeper than 2"):
        cube.leaves(spark.createDataFrame([(json.dumps({"a": {"b": {"c": 1}}}),)], "j string"), "j", 2).collect()


def test_cube_and_probe(spark):
    rows = spark.createDataFrame([("y", "p", None, None), ("x", "q", 2, 0.25), ("x", "p", 1, 0.5)], "a string, b string, c int, v double")
    made = cube.nested(rows, ["a", "b", "c"], F.col("v")).select(F.to_json("cube").alias("j"))
    assert made.first().j == '{"x":{"p":{"1":0.5},"q":{"2":0.25}},"y":{"p":{}}}'
    at = made.select(F.parse_json("j").alias("v")).select(cube.probe(F.col("v"), "x", "q", "2").alias("a"), cube.probe(F.col("v"), "x", "it's", "2").alias("b")).first()
    assert (at.a, at.b) == (0.25, None)
