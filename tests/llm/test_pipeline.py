from __future__ import annotations

import shutil

import corpus_pipeline
import duckdb
import pytest

import __spark_entry__ as registered
from gradeflow.llm import queries, toxicity
from tests.llm.test_decontaminate import brute as contaminated
from tests.llm.test_exact_dedup import brute as exact
from tests.llm.test_near_dedup import brute as near
from tests.llm.test_packing import check
from tests.llm.test_toxicity import brute as toxic_score
from tests.llm.test_toxicity import corpus
from tests.test_queries import rows


def test_registered():
    names = registered.queries()
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10 and "pipeline" in names


def test_stages_by_brute_force(spark, data, tmp_path):
    docs, bench = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/benchmark.parquet").collect()
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, data)
        if name == "packing":
            n, bound = check(docs, out, 2048)
            assert n <= 1.02 * bound + 1
            break
        out.write.parquet(path := str(tmp_path / name))
        kept = spark.read.parquet(path)
        assert kept.columns == docs.columns
        before, after = [(r.doc_id, r.text) for r in docs.collect()], sorted(r.doc_id for r in kept.collect())
        if name == "exact_dedup":
            assert after == sorted(int(x[0]) for x in exact(before) if x[3])
        if name == "near_dedup":
            assert after == sorted({int(c) for _, c, _ in near(before)})
        if name == "decontamination":
            assert after == sorted(int(x[0]) for x in contaminated(before, [(r.item_id, r.text) for r in bench]) if not x[-1])
        docs = kept


def test_toxicity_stage_by_brute_force(spark, tmp_path):
    docs, labels = corpus(spark)
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    kept, lexicon = sorted(r.doc_id for r in corpus_pipeline.without_toxic(spark, docs, str(tmp_path)).collect()), toxicity.learn(docs, labels)
    assert kept == sorted(r.doc_id for r in docs.collect() if toxic_score(lexicon, r.text) < 0.7)
    assert 0 < len(kept) < docs.count()


def test_odd_rows(spark, odd, empty, data, tmp_path):
    for k, df in enumerate((odd, empty)):
        folder = tmp_path / str(k)
        df.write.parquet(str(folder / "documents.parquet"))
        for t in ("labels", "benchmark"):
            shutil.copy(f"{data}/{t}.parquet", folder / f"{t}.parquet")
        assert (corpus_pipeline.run(spark, str(folder)).count() > 0) == (k == 0)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, data, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{data}/{t}.parquet')")
    assert rows(queries.queries()[name](spark, data).toPandas()) == rows(con.sql(queries.oracle_sql()[name]).df())
