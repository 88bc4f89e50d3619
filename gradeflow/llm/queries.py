"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, divergence, exact_dedup, fill_in_middle, lm_score, near_dedup, packing, pii, quality, sharding, substring_dedup, token_count, toxicity

SHARDS = [f"shard-{k:03d}" for k in range(64)]


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")


def vocabulary(name: str) -> str:
    """Path of a public vocabulary file; operators take any path."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its number of unigram pieces."""
    return token_count.count_tokens(_docs(spark, sf_dir), vocabulary("piece_bpe_32k.model"))


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its toxicity score."""
    docs = _docs(spark, sf_dir)
    return toxicity.score_documents(docs, toxicity.learn(docs, _labels(spark, sf_dir)))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its words outside repeated passages."""
    return substring_dedup.remove_repeats(_docs(spark, sf_dir))


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its base score and its score under the bigram filter."""
    docs = _docs(spark, sf_dir)
    out = lm_score.score(docs, *lm_score.train(docs.filter(~lm_score.is_held_out())))
    return out.withColumn("held_out", lm_score.is_held_out())


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its expected quality grade."""
    docs = _docs(spark, sf_dir)
    return quality.grade(docs, quality.learn(docs, _labels(spark, sf_dir))).withColumn("held_out", quality.is_held_out())


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its class of near duplicates."""
    return near_dedup.near_duplicates(_docs(spark, sf_dir))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its words inside benchmark windows."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.report(decontaminate.find_contamination(_docs(spark, sf_dir), benchmark))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its sequence."""
    return packing.pack(_docs(spark, sf_dir), vocabulary("byte_bpe_50k.json"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the row of its text that stays."""
    return exact_dedup.exact_dedup(_docs(spark, sf_dir))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its slot and shard."""
    return sharding.assign_shards(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id"), "doc_id", SHARDS)


def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its personal data."""
    return pii.report(pii.find_identifiers(_docs(spark, sf_dir)))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with digests of its transformed and its restored text."""
    return fill_in_middle.report(fill_in_middle.transform(_docs(spark, sf_dir)))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every source's divergence from the others of its language, and the terms that it has too much of."""
    return divergence.audit(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _op7_sql() -> str:
    words = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""
        WITH d AS (SELECT doc_id, {words} AS w FROM documents),
        b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {words} AS w FROM benchmark),
        bw AS (SELECT DISTINCT item_id, m, array_to_string(w[i:i + m - 1], ' ') AS win
               FROM (SELECT item_id, w, least(13, len(w)) AS m, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
        lens AS (SELECT DISTINCT m FROM bw),
        dw AS (SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS win
               FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, lens WHERE len(w) >= m)),
        hit AS (SELECT doc_id, item_id, i, dw.m FROM dw JOIN bw ON dw.win = bw.win AND dw.m = bw.m),
        words AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS pos FROM hit) GROUP BY doc_id),
        items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids FROM hit GROUP BY doc_id)
        SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
               coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
        FROM d LEFT JOIN words ON words.doc_id = d.doc_id LEFT JOIN items ON items.doc_id = d.doc_id"""


def _op9_sql() -> str:
    norm = f"translate(coalesce(text, ''), '{exact_dedup.UPPER}', '{exact_dedup.LOWER}')"
    return f"""
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, sha256({norm}) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY {norm})"""


def _op10_sql() -> str:
    table = ",".join(map(str, sharding.lookup_table(SHARDS).tolist()))
    return f"""
        WITH placed AS (
            SELECT doc_id, CAST(CAST('0x' || substr(md5(coalesce('k' || CAST(doc_id AS VARCHAR), 'null')), 1, 15) AS BIGINT) % {sharding.DEFAULT_TABLE} AS INTEGER) AS slot
            FROM documents),
        filled AS (SELECT [{table}] AS t)
        SELECT doc_id, slot, 'shard-' || lpad(CAST(t[slot + 1] AS VARCHAR), 3, '0') AS shard FROM placed, filled"""


def _op12_sql() -> str:
    return r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u,
                          sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
        drawn AS (SELECT *, len(u) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (len(u) + 1) AS r1, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (len(u) + 1) AS r2,
                         CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 < 50 AS spm,
                         t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') AS plain FROM d),
        cut AS (SELECT *, array_to_string(u[1:least(r1, r2)], '') AS p, array_to_string(u[least(r1, r2) + 1:greatest(r1, r2)], '') AS m,
                       array_to_string(u[greatest(r1, r2) + 1:], '') AS s FROM drawn)
        SELECT doc_id, n, CASE WHEN plain THEN 'plain' WHEN spm THEN 'spm' ELSE 'psm' END AS form,
               CASE WHEN NOT plain THEN length(p) END AS prefix_chars, CASE WHEN NOT plain THEN length(m) END AS middle_chars,
               sha256(CASE WHEN plain THEN t WHEN spm THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE '<P>' || p || '<S>' || s || '<M>' || m END) AS output_sha256,
               sha256(t) AS restored_sha256
        FROM cut"""


def _op13_sql() -> str:
    share = "1 + (1000000000 * CAST({0} + 2 AS HUGEINT)) // CAST({1} + 2 * v AS HUGEINT)"
    f = "(({0} - {1}) * ({0} - {1})) // ({0} + {1})"
    ranked = "CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, encode(item)) AS INTEGER) AS rank"
    return rf"""
        WITH d AS (SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                          regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
        words AS (SELECT i, lang, source, unnest(w) AS item FROM d),
        kept AS (SELECT lang, item, count(*) AS n_lang FROM words GROUP BY lang, item HAVING count(DISTINCT i) >= 10),
        sizes AS (SELECT lang, count(*) AS v, sum(n_lang) AS n_all FROM kept GROUP BY lang),
        grp AS (SELECT DISTINCT lang, source FROM d),
        cells AS (SELECT lang, source, item, count(*) AS n FROM words JOIN kept USING (lang, item) GROUP BY lang, source, item),
        tot AS (SELECT lang, source, sum(n) AS n_group FROM cells GROUP BY lang, source),
        dense AS (SELECT g.lang, g.source, k.item, coalesce(c.n, 0) AS n,
                         {share.format("coalesce(c.n, 0)", "coalesce(t.n_group, 0)")} AS p, {share.format("k.n_lang", "s.n_all")} AS q
                  FROM grp g JOIN kept k ON k.lang = g.lang JOIN sizes s ON s.lang = g.lang
                  LEFT JOIN cells c ON c.lang = g.lang AND c.source = g.source AND c.item = k.item LEFT JOIN tot t ON t.lang = g.lang AND t.source = g.source),
        sums AS (SELECT a.lang, a.source, b.source AS item, sum({f.format("a.p", "b.p")}) AS value FROM dense a JOIN dense b ON a.lang = b.lang AND a.item = b.item AND a.source <> b.source GROUP BY ALL),
        pairs AS (SELECT g.lang, g.source, o.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value FROM grp g JOIN grp o ON g.lang = o.lang AND g.source <> o.source
                  LEFT JOIN sums s ON s.lang = g.lang AND s.source = g.source AND s.item = o.source),
        terms AS (SELECT lang, source, item, CAST({f.format("p", "q")} AS BIGINT) AS value FROM dense WHERE n > 0 AND p > q)
        SELECT lang, source, 'pair' AS part, item, value, {ranked} FROM pairs
        UNION ALL SELECT * FROM (SELECT lang, source, 'term' AS part, item, value, {ranked} FROM terms) WHERE rank <= 10"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Name -> query of the operators on this list."""
    found = (op1_token_counts, op2_toxicity, op3_substring_dedup, op4_lm_score, op5_quality, op6_near_dedup, op7_decontaminate, op8_packing, op9_exact_dedup, op10_sharding, op11_pii, op12_fill_in_middle, op13_divergence)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    """Name -> SQL where SQL can express the query."""
    return {"op7_decontaminate": _op7_sql(), "op9_exact_dedup": _op9_sql(), "op10_sharding": _op10_sql(), "op12_fill_in_middle": _op12_sql(), "op13_divergence": _op13_sql()}
