from __future__ import annotations

import collections
import hashlib

from pyspark.sql import functions as F

from gradeflow.llm import exact_dedup as X

LOW = str.maketrans(X.UPPER, X.LOWER)


def brute(rows, digest=True):
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[(t or "").translate(LOW)].append(i)
    out = []
    for i, t in rows:
        own = groups[(t or "").translate(LOW)]
        keep = max((x for x in own if x is not None), default=None)
        out.append((str(i), str(keep), len(own), i == keep, hashlib.sha256((t or "").translate(LOW).encode()).hexdigest() if digest else ""))
    return sorted(out)


def got(df, digest=True):
    return sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept, r.text_sha256 if digest else "") for r in df.collect())


def test_equals_brute_force(docs):
    assert got(X.exact_dedup(docs)) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_rows(odd, empty):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert got(X.exact_dedup(odd)) == brute(rows)
    assert X.exact_dedup(empty).count() == 0
    kept = X.keep_one(odd)
    assert kept.columns == odd.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(x[0] for x in set(brute(rows)) if x[3])
    assert X.keep_one(empty).count() == 0


def test_state_goes_on(spark, tmp_path):
    """A second call's rows meet the retained entries; several batches a call."""
    one = [(k, f"text {k % 7}") for k in range(20)]
    two = [(k, f"TEXT {k % 9}") for k in range(20, 40)]
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    state = str(tmp_path / "state")
    assert got(X.exact_dedup(frame(one), state, trigger_bytes=1)) == brute(one)
    batches = len(list((tmp_path / "state" / "entries").iterdir()))
    assert batches > 1
    both = brute(one + two)
    assert got(X.exact_dedup(frame(two), state, frame(one + two), 1)) == sorted(x for x in both if int(x[0]) >= 20)
    assert len(list((tmp_path / "state" / "entries").iterdir())) > batches


def test_locator_tells_rows_of_one_id_apart(spark):
    rows = [(5, "t"), (5, "t"), (4, "t"), (5, "u"), (3, "u"), (5, "v")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(X.exact_dedup(df)) == brute(rows)
    assert sorted(tuple(r) for r in X.keep_one(df).collect()) == [(5, "t"), (5, "u"), (5, "v")]


def test_only_ascii_is_folded(spark):
    df = spark.createDataFrame([(1, "ÄB"), (2, "äb"), (3, "Äb"), (4, "İI")], "doc_id long, text string")
    assert {(r.doc_id, r.keep_id) for r in X.exact_dedup(df).collect()} == {(1, 3), (2, 2), (3, 3), (4, 4)}


def test_hot_groups_are_salted(spark, monkeypatch):
    monkeypatch.setattr(X, "SALT_ROWS", 3)
    rows = [(k, "hot" if k % 3 else f"t{k // 6}") for k in range(60)]
    assert got(X.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_one_digest_of_several_texts(spark, monkeypatch):
    monkeypatch.setattr(X, "_hash", lambda norm: F.substring(norm, 1, 1).cast("binary"))
    rows = [(k, f"{'ab'[k % 2]}{k % 6}") for k in range(40)] + [(50, "c"), (51, "dd")]
    assert got(X.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string")), False) == brute(rows, False)


def test_settings_are_put_back(spark, docs):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    X.exact_dedup(docs.limit(3)).count()
    assert spark.conf.get(key, None) == before
