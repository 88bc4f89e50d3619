from __future__ import annotations

import collections
import hashlib
import re

from gradeflow.llm import decontaminate as X

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(t):
    return WORD.findall((t or "").translate(LOW))


def brute(rows, items):
    wins = collections.defaultdict(set)
    for i, t in items:
        w = words(t)
        m = min(13, len(w))
        for k in range(len(w) - m + 1) if m else ():
            wins[tuple(w[k : k + m])] |= set() if i is None else {str(i)}
    out = []
    for i, t in rows:
        w, hit, ids = words(t), set(), set()
        for m in {len(x) for x in wins}:
            for k in range(len(w) - m + 1):
                if tuple(w[k : k + m]) in wins:
                    ids |= wins[tuple(w[k : k + m])]
                    hit.update(range(k, k + m))
        out.append((str(i), len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out)


def got(df):
    return sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in X.report(df).collect())


def items(spark, docs):
    text = docs.orderBy("doc_id").first().text
    w = text.split(" ")
    rows = [(1, " ".join(w[3:40])), (2, " ".join(w[20:60])), (10, " ".join(w[5:9])), (11, None), (12, " ?! "), (13, "the"), (14, "The"), (15, " ".join(w[3:40])), (None, "of the")]
    return rows, spark.createDataFrame(rows, "item_id long, text string")


def test_equals_brute_force(spark, docs):
    bench, table = items(spark, docs)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert got(X.find_contamination(docs, table)) == brute(rows, bench)


def test_blocks_give_the_same(spark, docs):
    bench, table = items(spark, docs)
    assert got(X.find_contamination(docs, table, block_words=8)) == got(X.find_contamination(docs, table))


def test_rows(spark, odd, empty):
    rows, bench = [(r.doc_id, r.text) for r in odd.collect()], [(1, "cat sat on the mat"), (2, "NAÏVE CAFÉ"), (3, "a b c d e f g h i j k l m n")]
    table = spark.createDataFrame(bench, "item_id long, text string")
    assert got(X.find_contamination(odd, table)) == brute(rows, bench)
    assert X.find_contamination(empty, table).count() == 0
    none = X.report(X.find_contamination(odd, table.limit(0))).collect()
    assert len(none) == len(rows) and not any(r.contaminated for r in none)
    clean = X.decontaminate(odd, table)
    assert clean.columns == odd.columns and clean.count() == sum(not x[-1] for x in brute(rows, bench))
    assert X.decontaminate(odd, table.limit(0)).count() == len(rows)


def test_items_that_repeat_and_blocks_of_the_filter(spark, odd, docs):
    """Rows of one item_id are one item in whatever blocks they come; the filter gives the same for any blocks."""
    text = docs.orderBy("doc_id").first().text.split(" ")
    bench = [(7, " ".join(text[3:20])), (8, " ".join(text[30:50])), (7, " ".join(text[40:60])), (None, " ".join(text[3:20])), (9, "cat sat on the mat")]
    table = spark.createDataFrame(bench, "item_id long, text string").coalesce(1)
    for df in (docs, odd):
        rows = [(r.doc_id, r.text) for r in df.collect()]
        want = brute(rows, bench)
        assert got(X.find_contamination(df, table)) == want == got(X.find_contamination(df, table, block_words=8))
        clean = sorted(str(r.doc_id) for r in X.decontaminate(df, table, 8).collect())
        assert clean == sorted(str(r.doc_id) for r in X.decontaminate(df, table).collect()) == sorted(x[0] for x in want if not x[-1])
