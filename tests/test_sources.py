from __future__ import annotations

import json
import logging

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradeflow.operators import ordering
from gradeflow.sources import sinks, tables
from gradeflow.streaming import incremental

SCHEMA = T.StructType([T.StructField("k", T.StringType()), T.StructField("v", T.LongType())])


def test_rewrite_survives_a_crash_at_any_step(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t.jsonl")
    rows = lambda: sorted(tuple(r) for r in tables.read_traces(spark, path.removesuffix(".jsonl"), SCHEMA).collect())
    more = lambda n: tables.read_json_lines(spark, path, SCHEMA).withColumn("v", F.col("v") + n)
    sinks.append_json_lines(spark.createDataFrame([("a", 1), ("b", 2)], SCHEMA), path)
    fail = lambda *_: (_ for _ in ()).throw(OSError("crash"))
    for step in ("_point", "write_text"):  # before the pointer is written, and before it is put in its place
        with monkeypatch.context() as m:
            m.setattr(sinks, step, fail)
            with pytest.raises(OSError):
                sinks.rewrite_json_lines(more(10), path)
        assert rows() == [("a", 1), ("b", 2)]
    sinks.rewrite_json_lines(more(10), path)
    assert rows() == [("a", 11), ("b", 12)]
    with monkeypatch.context() as m:
        m.setattr(sinks, "_point", fail)
        with pytest.raises(OSError):
            sinks.rewrite_json_lines(more(100), path)
    assert rows() == [("a", 11), ("b", 12)]
    sinks.append_json_lines(spark.createDataFrame([("c", 3)], SCHEMA), path)
    sinks.rewrite_json_lines(more(100), path)
    assert rows() == [("a", 111), ("b", 112), ("c", 103)] and tables.done_keys(spark, path, "k").count() == 3
    assert len(list((tmp_path / "t.jsonl").glob("_version-*"))) == 1


def test_quarantine_keeps_every_line(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"k": "a", "v": 1}\n\n{"k": "b", "v"\nnull\n[1]\n{"v": "word"}\n{}\n{"k": "c", "v": 3, "other": 1}\n')
    rows, bad = tables.quarantined(spark, str(tmp_path / "x.jsonl"), SCHEMA)
    assert sorted((r.k or "", r.v or 0) for r in rows.collect()) == [("", 0), ("a", 1), ("c", 3)]
    assert sorted(r.line for r in bad.collect()) == ["[1]", "null", '{"k": "b", "v"', '{"v": "word"}']


def test_runs_are_found_without_a_call_for_each(spark, tmp_path):
    for k in range(40):
        (tmp_path / f"run {k}+x").mkdir()
        (tmp_path / f"run {k}+x" / "log.txt").write_text("x")
        if k % 3 == 0:
            (tmp_path / f"run {k}+x" / "results.json").write_text("[]")
    (tmp_path / "run 1+x" / "deeper").mkdir()
    (tmp_path / "run 1+x" / "deeper" / "results.json").write_text("[]")
    assert {(r.run, r.has_results) for r in tables.list_runs(spark, str(tmp_path)).collect()} == {(f"run {k}+x", k % 3 == 0) for k in range(40)}
    assert tables.list_runs(spark, str(tmp_path / "none")).collect() == []


def test_counts_cost_no_job_of_their_own(spark, tmp_path, caplog):
    df = spark.createDataFrame([("train",), ("train",), ("test",), (None,)], "split string")
    counted = sinks.Counted(df, "split", ["train", "test", "holdout"])
    with caplog.at_level(logging.INFO, "gradeflow"):
        spark.sparkContext.setJobGroup("counted", "counted")
        with sinks.stage("write", "seed=1", counted):
            sinks.write_json_lines(counted.df, str(tmp_path / "out"))
        jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("counted")
    assert counted.counts == {"rows": 4, "train": 2, "test": 1, "holdout": 0} and len(jobs) == 1
    assert "seed=1, rows=4, train=2, test=1, holdout=0" in caplog.text
    with pytest.raises(ValueError), sinks.stage("fails"):
        raise ValueError


def test_inverted_order(spark):
    texts = ["", "a", "ab", "b", "é", "中", "a\x00", "Z"]
    got = [r.t for r in spark.createDataFrame([(t,) for t in texts], "t string").orderBy(ordering.inverted(F.col("t"))).collect()]
    assert got == sorted(texts, key=str.encode, reverse=True)


def test_latest_of_a_stream_in_three_batches(spark, tmp_path):
    folder, schema = tmp_path / "in", "k string, t long, run string, v long"
    folder.mkdir()
    batches = [[("a", 1, "r1", 1), ("b", 5, "r2", 2)], [("a", 3, "r9", 3), ("a", 3, "r5", 4), ("b", 4, "r0", 5)], [("a", 3, "r7", 6), ("c", None, "x", 7)]]
    whole = spark.createDataFrame([r for b in batches for r in b], schema)
    for k, rows in enumerate(batches):
        (folder / f"{k}.json").write_text("".join(json.dumps(dict(zip(("k", "t", "run", "v"), r, strict=True))) + "\n" for r in rows))
        stream = spark.readStream.schema(schema).json(str(folder))
        incremental.keep_latest(stream, ["k"], "t", "run", str(tmp_path / "state"), str(tmp_path / "latest")).awaitTermination()
    got = {tuple(r) for r in tables.read_json_lines(spark, str(tmp_path / "latest"), whole.schema).collect()}
    assert got == {tuple(r) for r in ordering.latest_per_key(whole, ["k"], "t", "run").collect()} == {("a", 3, "r5", 4), ("b", 5, "r2", 2), ("c", None, "x", 7)}


def test_late_rows_of_windowed_counts_are_dropped(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    out, batches = {}, [["2025-01-01T00:10:00", "2025-01-01T00:20:00"], ["2025-01-01T05:00:00"], ["2025-01-01T00:30:00", "2025-01-01T05:10:00"], ["2025-01-01T09:00:00"], []]
    take = lambda df, _: out.update({(r.window.start.isoformat(), r.k): r.n for r in df.collect()})
    for k, rows in enumerate(batches):
        (folder / f"{k}.json").write_text("".join(json.dumps({"ts": t, "k": "x"}) + "\n" for t in rows))
        stream = spark.readStream.schema("ts timestamp, k string").json(str(folder))
        counts = incremental.windowed_counts(stream, "ts", "1 hour", "1 hour", "k")
        counts.writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).foreachBatch(take).start().awaitTermination()
    # the row of 00:30 comes when its window is over: the count stays 2
    assert {k[0][11:16]: n for k, n in out.items()} == {"00:00": 2, "05:00": 2}


def test_train_info_is_read_by_its_schema(spark, tmp_path):
    for tag, more in (("a", {"beta_s": 0.5, "stats": {"mean_a": 1.0, "std_a": 0.25, "frac_mass_top20": 0.5}}), ("b", {"beta_s": None})):
        (tmp_path / "run" / tag).mkdir(parents=True)
        (tmp_path / "run" / tag / "train_info.json").write_text(json.dumps({"source": tag, "mode": "naive", "n_train": 512, "accuracy": 0.75, "unknown": 1} | more, indent=1))
        (tmp_path / "run" / tag / "results.json").write_text("[]")
    got = {r.tag: r for r in tables.read_train_info(spark, str(tmp_path)).collect()}
    assert {k: (r.source, r.n_train, r.beta_s, r.accuracy) for k, r in got.items()} == {"a": ("a", 512, 0.5, 0.75), "b": ("b", 512, None, 0.75)}
    assert got["a"].stats.frac_mass_top20 == 0.5 and got["b"].stats is None and got["b"].seed is None
