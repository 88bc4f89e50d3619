from __future__ import annotations

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from gradeflow.llm import fill_in_middle as fim


def brute(doc_id, text, recipe=fim.Recipe()):
    text = text or ""
    units = re.findall(recipe.unit, text)
    assert "".join(units) == text
    digest = hashlib.sha256(f"{recipe.seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    p, s, m = recipe.prefix, recipe.suffix, recipe.middle
    if not text or any(x in text for x in (p, s, m)) or h3 % 100 >= recipe.rate:
        return n, "plain", text, None, None
    if h4 % 100 < recipe.spm:
        return n, "spm", s + suffix + p + prefix + m + middle, len(prefix), len(middle)
    return n, "psm", p + prefix + s + suffix + m + middle, len(prefix), len(middle)


TEXTS = ["", None, "one line", "a\n", "\n\n\n", "ab\ncü😀d\r\ne f\x85g\nlast", "has <P> in it\nx", "a <M>\n", "x\x00y\nz", "no sentinel <P\n>\n", "word " * 40_000, "é\n" * 20_000, "\r\n\r\n", "a\nb\nc\nd\ne\nf\ng\nh"]


def check(df, rows, recipe=fim.Recipe()):
    out = fim.transform(df, recipe).withColumn("restored", fim.restore(F.col("output"), F.col("form"), recipe)).collect()
    assert len(out) == len(rows)
    want = sorted((repr(i), *map(repr, brute(i, t, recipe)), repr(t or "")) for i, t in rows)
    assert sorted(tuple(map(repr, (r.doc_id, r.n, r.form, r.output, r.prefix_chars, r.middle_chars, r.restored))) for r in out) == want
    return {r.form for r in out}


def test_equals_a_plain_version(spark):
    rows = [(k * len(TEXTS) + j, t) for k in range(6) for j, t in enumerate(TEXTS)] + [(None, "a\nb\n"), (3, "x\ny"), (3, "x\ny")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert check(df, rows) == {"plain", "psm", "spm"}
    check(df, rows, fim.Recipe(unit=r"\s*\S+|\s+$", seed=11, rate=60, spm=0, prefix="[pre]", suffix="[suf]", middle="[mid]"))


def test_odd_and_empty_tables(odd, empty):
    check(odd.select("doc_id", "text"), [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()])
    out = fim.report(fim.transform(odd))
    assert out.count() == odd.count()
    assert fim.report(fim.transform(empty)).collect() == []


def test_restored_digest_is_that_of_the_text(docs):
    out = fim.report(fim.transform(docs)).join(docs.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("want")), "doc_id")
    assert out.count() == docs.count() and out.filter("restored_sha256 <> want").count() == 0


def test_marks_that_could_be_mistaken_are_refused():
    for marks in (("", "b", "c"), ("aa", "b", "c"), ("ab", "bc", "x"), ("<P>", "<P>", "<M>"), ("<P>", "a<P>b", "<M>")):
        with pytest.raises(ValueError):
            fim.Recipe(prefix=marks[0], suffix=marks[1], middle=marks[2])
