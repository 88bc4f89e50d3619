from __future__ import annotations

import math
import random
import time

import pytest
from pyspark.sql import functions as F

from gradeflow.llm import toxicity as X


def corpus(spark, n=900):
    rng = random.Random(2)
    words = ["lorem", "ipsum", "dolor", "amet", "magna", "aliqua", "veniam", "nostrud"]
    docs, labels = [], []
    for k in range(n):
        text = [rng.choice(words) for _ in range(rng.randint(20, 60))]
        toxic = k % 6 == 0
        if toxic:
            for _ in range(3):
                text[rng.randrange(len(text))] = rng.choice(["grumbo", "Grumb0", "snarkle", "SN4RKLE!"])
        elif k % 36 == 1:  # the word is harmless in this phrase
            text[3:5] = ["captain", "grumbo"]
        docs.append((k, " ".join(text)))
        labels.append((k, int(toxic)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([*labels, (5, None), (None, 1)], "doc_id long, toxic int")


def brute(lexicon, text):
    """The score, word by word."""
    words = X.fold(text).split()
    free = {i + k for p in map(str.split, lexicon.exceptions) for i in range(len(words)) if words[i : i + len(p)] == p for k in range(len(p))}
    heaviest = (max((x for e, x in lexicon.entries.items() if f"{w} ".startswith(e)), default=0.0) for k, w in enumerate(words) if k not in free)
    dense = math.log1p(100 * sum(heaviest) / (len(words) + X.PRIOR_WORDS))
    return 1 / (1 + math.exp(-max(-50, min(50, lexicon.slope * dense + lexicon.offset))))


def test_folding():
    assert X.fold("Ｉd10t! Уоu аre STU​PID$") == " idiot you are stupids "
    assert X.fold(None) == X.fold("") == X.fold("?!") == " "
    assert X.fold("a  b") == " a b "


def test_matches_and_exceptions():
    lexicon = X.Lexicon({"bad": 2.0, "badi": 3.0, "rot ": 1.0}, ("bad iuck",))
    tree, text = lexicon.automaton(), X.fold("bad badly rot rotten bad luck")
    assert sorted(X.matches(tree, text).values()) == [1.0, 2.0, 3.0]
    assert X.matches(X.Lexicon().automaton(), text) == {}


def test_learned_lexicon(spark):
    docs, labels = corpus(spark)
    lexicon = X.learn(docs, labels)
    assert lexicon.entries and any("captain" in e for e in lexicon.exceptions)
    got = X.score_documents(docs, lexicon).join(labels, "doc_id").filter("held_out and toxic is not null").collect()
    wrong = [r for r in got if r.predicted != r.toxic]
    assert len(got) > 200 and len(wrong) <= 0.02 * len(got)
    assert X.drop_toxic(docs, lexicon).count() == X.score_documents(docs, lexicon).filter("predicted = 0").count()


def test_scores_equal_brute_force(spark, data):
    made, labels = corpus(spark)
    docs, own = (spark.read.parquet(f"{data}/../sf0.01/{t}.parquet") for t in ("documents", "labels"))
    for rows, lexicon in ((made, X.learn(made, labels, ["magna snarkle"])), (docs, X.learn(docs, own))):
        assert lexicon.entries
        texts = {r.doc_id: r.text for r in rows.collect()}
        got = X.score_documents(rows, lexicon).collect()
        assert len(got) == rows.count() and {r.predicted for r in got} == {0, 1}
        for r in got:
            assert r.score == pytest.approx(brute(lexicon, texts[r.doc_id]), abs=1e-9) and r.predicted == (r.score >= 0.7)


def test_rows(spark, odd, empty):
    docs, labels = corpus(spark, 300)
    lexicon = X.learn(docs, labels)
    got = X.score_documents(odd, lexicon).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 and r.predicted == 0 for r in got)
    assert X.score_documents(empty, lexicon).count() == 0
    assert X.drop_toxic(odd, lexicon).columns == odd.columns and X.drop_toxic(odd, lexicon).count() == odd.count()
    none = X.learn(docs, labels.limit(0))
    assert none.entries == {} and {r.predicted for r in X.score_documents(docs, none).collect()} == {0}
    assert X.learn(empty, labels).entries == {}


def test_long_text_of_exceptions_takes_linear_time():
    lexicon = X.Lexicon({"bad": 2.0}, ("bad iuck",))
    tree, text = lexicon.automaton(), X.fold("bad luck " * 250_000 + "bad day")
    began = time.perf_counter()
    assert list(X.matches(tree, text).values()) == [2.0] and time.perf_counter() - began < 20


def test_few_toxic_documents_with_words_of_their_own(spark):
    docs, labels = corpus(spark)
    rare = docs.filter("doc_id % 6 = 0 and doc_id % 5 = 0").withColumn("text", F.lit("lorem zorkblat ipsum zorkblat dolor amet zorkblat magna"))
    docs = docs.join(rare, "doc_id", "left_anti").unionByName(rare)
    lexicon = X.learn(docs, labels)
    got = X.score_documents(rare, lexicon).select("predicted").distinct().collect()
    assert [r.predicted for r in got] == [1]
