"""DuckDB SQL for each query of ``queries``, on the same tables."""

from __future__ import annotations

from .queries import ALGEBRA

_SPLIT = """
    shuffled AS (SELECT doc_id, row_number() OVER (ORDER BY md5('7|' || doc_id), doc_id) - 1 AS pos FROM documents),
    split AS (SELECT doc_id, CASE WHEN pos < 300 THEN 'train' WHEN pos < 400 THEN 'holdout' ELSE 'test' END AS split,
                     CASE WHEN pos < 300 THEN 'train_' || pos WHEN pos < 400 THEN 'holdout_' || (pos - 300) ELSE 'test_' || (pos - 400) END AS example_id
              FROM shuffled WHERE pos < 450)"""

_Q = "CAST(CAST(l_quantity AS BIGINT) AS VARCHAR)"
_TRACE = rf"""'step ' || l_linenumber || ' \boxed{{' || {_Q} || CASE WHEN l_linenumber % 2 = 0 THEN '\text{{ items}}' ELSE '' END || '}}'
    || CASE WHEN l_linenumber % 3 = 0 THEN ' \boxed{{ANSWER}}' ELSE '' END || CASE WHEN l_linenumber % 5 = 0 THEN ' \boxed{{7' ELSE '' END"""
_FORCE = r"chr(10) || chr(10) || '**Final Answer**' || chr(10) || '\[\boxed{'"
_SPANS = r"regexp_extract_all({0}, '\\boxed\{{((?:[^{{}}]|\{{[^{{}}]*\}})*)\}}', 1)"
_NUMBER = r"(?i)(?:answer is|=\s*)\s*([-+]?\d+(?:\.\d+)?)\s*[.\s]*$"


def _answer(trace: str) -> str:
    """Last real box without units, else the number at the end; boxes of these traces nest two deep at most."""
    real = f"list_filter({_SPANS.format(trace)}, lambda s: upper(trim(s)) <> 'ANSWER')"
    unit = rf"nullif(trim(regexp_replace(list_extract({real}, -1), '(?i)\\(text|mbox|mathrm)\{{[^}}]*\}}', '', 'g')), '')"
    return f"CASE WHEN len({real}) > 0 THEN {unit} ELSE nullif(regexp_extract({trace}, '{_NUMBER}', 1), '') END"


_CELLS = """
    cells AS (SELECT o_orderpriority AS dataset, o_orderstatus AS provider, CAST(o_custkey % 40 AS INTEGER) AS seed, strftime(o_orderdate, '%Y%m%d_%H%M%S') AS timestamp,
                     printf('run%012d', o_orderkey) AS run, o_orderkey % 4 <> 0 AS has_results, (o_orderkey % 100) / 100 AS accuracy,
                     CASE o_orderkey % 3 WHEN 0 THEN 'Base' WHEN 1 THEN 'Trace SFT' END AS label, o_orderkey AS key FROM orders),
    fallback AS (SELECT '1-URGENT' AS dataset, 'P' AS provider, n_nationkey AS seed, label, accuracy
                 FROM nation, (VALUES ('Base', 0.25::DOUBLE), ('Trace SFT', 0.5::DOUBLE)) v(label, accuracy))"""

_REPORT = f"""
    {_CELLS},
    chosen AS (SELECT DISTINCT dataset, provider, seed, timestamp, run FROM cells WHERE has_results
               QUALIFY row_number() OVER (PARTITION BY dataset, provider, seed ORDER BY timestamp DESC, run) = 1),
    actual AS (SELECT c.dataset, c.provider, c.seed, c.label, c.accuracy FROM cells c SEMI JOIN chosen USING (dataset, provider, seed, timestamp, run) WHERE c.label IS NOT NULL),
    filled AS (SELECT * FROM actual UNION ALL SELECT * FROM fallback f ANTI JOIN actual USING (dataset, provider, seed)),
    seeds AS (SELECT dataset, label, seed, avg(accuracy) AS m FROM filled WHERE label = 'Base' GROUP BY ALL),
    points AS (SELECT dataset, label, m FROM seeds
               UNION ALL SELECT dataset, CASE provider WHEN 'F' THEN 'Finished' WHEN 'O' THEN 'Open' ELSE 'Pending' END, accuracy FROM filled WHERE label = 'Trace SFT'),
    stats AS (SELECT dataset, label, avg(m) AS mean, CASE WHEN count(m) = 1 THEN 0.0 ELSE stddev_samp(m) / sqrt(count(m)) END AS stderr, count(m) AS n FROM points GROUP BY ALL)"""


def oracle_sql() -> dict[str, str]:
    """Name -> SQL."""
    fold = lambda x: f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"
    value = lambda a: f"TRY_CAST({a} AS DOUBLE)"
    return {
        "q_accuracy_by_lang": """
            SELECT lang, round(coalesce(avg(CAST(quality = 1 AS DOUBLE)), 0), 6) AS accuracy, count(*) AS n
            FROM labels JOIN documents USING (doc_id) WHERE quality IS NOT NULL GROUP BY lang""",
        "q_accuracy_empty_group": """
            SELECT source, round(coalesce(avg(CAST(quality = 1 AS DOUBLE)), 0), 6) AS accuracy, count(quality) AS n
            FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source""",
        "q_seeded_split": f"WITH {_SPLIT} SELECT doc_id, split, example_id FROM split",
        "q_ratio_split": """
            WITH c AS (SELECT DISTINCT conv_id FROM conversations),
            r AS (SELECT conv_id, row_number() OVER (ORDER BY md5('11|' || conv_id), conv_id) - 1 AS pos, count(*) OVER () AS n FROM c),
            sizes AS (SELECT * FROM (VALUES ('exact', 60, 40), ('ratio', 6000000, 4000000)) v("case", train, holdout))
            SELECT conv_id, CASE WHEN pos < CASE WHEN n >= train + holdout THEN train ELSE floor(n * train / (train + holdout)) END THEN 'train' ELSE 'holdout' END AS split, "case"
            FROM r, sizes WHERE pos < CASE WHEN n >= train + holdout THEN train + holdout ELSE n END""",
        "q_split_counts": f"WITH {_SPLIT} SELECT split, count(*) AS n FROM split GROUP BY split",
        "q_stratified_sample": """
            WITH f AS (SELECT lang, min(doc_id) AS first FROM documents GROUP BY lang),
            r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('3|' || doc_id), doc_id) AS turn FROM documents),
            t AS (SELECT doc_id, lang, turn FROM r JOIN f USING (lang) ORDER BY turn, first LIMIT 200)
            SELECT doc_id, lang, turn, row_number() OVER (ORDER BY md5('3-again|' || doc_id), doc_id) - 1 AS position FROM t""",
        "q_simple_sample": """
            SELECT event_id, event_type, row_number() OVER (ORDER BY md5('5|' || event_id), event_id) - 1 AS position
            FROM events QUALIFY position < 100""",
        "q_slice_offset": "SELECT p_partkey, p_brand FROM part ORDER BY p_partkey LIMIT 30 OFFSET 20",
        "q_resume_anti_join": "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)",
        "q_capped_resume": """
            WITH done AS (SELECT count(DISTINCT doc_id) AS n FROM documents SEMI JOIN labels USING (doc_id)),
            todo AS (SELECT doc_id, row_number() OVER (ORDER BY md5('13|' || doc_id), doc_id) - 1 AS pos FROM documents ANTI JOIN labels USING (doc_id))
            SELECT doc_id FROM todo, done WHERE pos < 500 - n""",
        "q_subset_union": """
            SELECT nation, count(*) AS n_rows, count(DISTINCT k) AS n_subsets
            FROM (SELECT c_nationkey AS nation, 0 AS k FROM customer UNION ALL SELECT s_nationkey, 1 FROM supplier) GROUP BY nation""",
        "q_prompt_messages": f"""
            SELECT conv_id, turn, 2::BIGINT AS n_messages, 'system,user' AS roles, {fold("text")} || chr(10) AS content,
                   '## Problem' || chr(10) || {fold("text")} || chr(10) || chr(10) || '## Trace' || chr(10) || 'done' || chr(10) AS judge
            FROM conversations WHERE role = 'user'""",
        "q_chat_render": f"""
            SELECT conv_id, string_agg('<|' || role || '|>' || chr(10) || {fold("text")} || '<|end|>' || chr(10), '' ORDER BY turn) || '<|assistant|>' || chr(10) AS prompt
            FROM conversations WHERE role IN ('system', 'user', 'assistant') GROUP BY conv_id""",
        "q_split_from_id": f"WITH {_SPLIT} SELECT split_part(example_id, '_', 1) AS split, count(*) AS n, min(doc_id) AS first_doc FROM split GROUP BY 1",
        "q_extract_boxed": f"""
            WITH t AS (SELECT l_orderkey, l_linenumber, {_TRACE} AS trace FROM lineitem)
            SELECT l_orderkey, l_linenumber, len({_SPANS.format("trace")}) AS n_spans, {_answer("trace")} AS answer FROM t""",
        "q_numeric_fallback": f"""
            WITH t AS (SELECT l_orderkey, l_linenumber, 'so the answer is ' || {_Q} || CASE l_linenumber % 3 WHEN 0 THEN ' apples' WHEN 1 THEN '. ' ELSE '.5' END AS t FROM lineitem)
            SELECT l_orderkey, l_linenumber, nullif(regexp_extract(t, '{_NUMBER}', 1), '') AS answer FROM t""",
        "q_gold_answer": r"""
            WITH t AS (SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'no mark' ELSE 'work #### 1 #### ' || o_custkey || ' ' END AS s FROM orders)
            SELECT o_orderkey, CASE WHEN contains(s, '####') THEN trim(string_split(s, '####')[-1]) ELSE '' END AS gold,
                   '\boxed{' || CASE WHEN contains(s, '####') THEN trim(string_split(s, '####')[-1]) ELSE s END || '}' AS qa_trace FROM t""",
        "q_trace_variants": f"""
            WITH t AS (SELECT l_orderkey, l_linenumber, l_quantity, {_TRACE} AS trace, l_linenumber % 2 = 0 AS forced FROM lineitem)
            SELECT l_orderkey, l_linenumber, CASE WHEN forced THEN 3 ELSE 1 END::BIGINT AS n, CASE WHEN forced THEN {_Q} || '}}' ELSE trace END AS last, forced AS any_hit FROM t""",
        "q_final_answer_tail": f"""
            WITH t AS (SELECT l_orderkey, l_linenumber, l_quantity, {_TRACE} AS t FROM lineitem)
            SELECT l_orderkey, l_linenumber, t AS reply, {fold(_FORCE)} || {_Q} || '}}' AS final,
                   '<|assistant|>' || t || chr(10) || '</think>!' AS closed, t || '</s>' AS clean FROM t""",
        "q_grade": f"""
            WITH t AS (SELECT l_orderkey, l_linenumber, {_TRACE} AS trace, CASE WHEN l_linenumber % 4 = 0 THEN l_quantity ELSE l_quantity + l_linenumber % 2 END AS gold,
                              CASE WHEN l_linenumber % 3 = 0 THEN {_Q} || '.0' END AS af_extracted_answer FROM lineitem),
            g AS (SELECT *, {_answer("trace")} AS raw_extracted_answer FROM t),
            h AS (SELECT *, coalesce({value("raw_extracted_answer")} = gold, false) AS raw_correct, CASE WHEN af_extracted_answer IS NOT NULL THEN {value("af_extracted_answer")} = gold END AS af_correct FROM g)
            SELECT l_orderkey, l_linenumber, raw_extracted_answer, raw_correct, af_extracted_answer, af_correct,
                   coalesce(af_correct, raw_correct) AS correct, coalesce(af_extracted_answer, raw_extracted_answer) AS extracted_answer FROM h""",
        "q_method_label": """
            WITH t AS (SELECT CASE WHEN event_type = 'click' THEN 'poe_gamma_' || (event_id % 3) ELSE event_type END AS method,
                              CASE WHEN event_type = 'buy' THEN 'Purchase' ELSE upper(event_type[1]) || lower(event_type[2:]) END AS series FROM events)
            SELECT method, series, count(*) AS n, coalesce(list_position(['Base', 'Purchase', 'View', 'Click'], series), 0)::BIGINT AS place FROM t GROUP BY method, series""",
        "q_label_map": """
            WITH t AS (SELECT value, CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 5 = 0 THEN 'Base' WHEN event_id % 5 = 1 THEN 'SFT on Q&A' WHEN event_id % 5 = 2 THEN 'Trace SFT' END AS label FROM events)
            SELECT label, count(*) AS n, round(avg(value), 4) AS mean_value FROM t WHERE label IS NOT NULL GROUP BY label""",
        "q_latest_per_key": """
            WITH l AS (SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id) = 1),
            n AS (SELECT user_id, event_id AS newest_event FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1)
            SELECT user_id, event_type, event_id, value, newest_event FROM l JOIN n USING (user_id)""",
        "q_mean_stderr": """
            WITH t AS (SELECT CASE WHEN o_orderkey = 1 THEN 'one' ELSE o_orderpriority END AS k, CASE WHEN o_orderpriority LIKE '5%' THEN NULL ELSE o_totalprice END AS x FROM orders)
            SELECT k, round(avg(x), 4) AS mean, round(CASE WHEN count(x) = 1 THEN 0.0 ELSE stddev_samp(x) / sqrt(nullif(count(x), 0)) END, 4) AS stderr, count(x) AS n FROM t GROUP BY k""",
        "q_mean_of_means": """
            WITH m AS (SELECT c_mktsegment, o_orderpriority, avg(o_totalprice) AS m FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)
            SELECT c_mktsegment, round(avg(m), 4) AS mean, round(CASE WHEN count(m) = 1 THEN 0.0 ELSE stddev_samp(m) / sqrt(count(m)) END, 4) AS stderr, count(m) AS n FROM m GROUP BY c_mktsegment""",
        "q_pmf": """
            WITH t AS (SELECT l_returnflag AS flag, CAST(floor(l_quantity / 10) AS INTEGER) + 1 AS score FROM lineitem),
            a AS (SELECT flag, round(avg(score), 6) AS mean_all, count(score) AS n_all FROM t GROUP BY flag),
            b AS (SELECT flag, unnest([1, 2, 3, 4, 5])::INTEGER AS bin FROM a),
            c AS (SELECT flag, bin, count(score) AS n FROM b LEFT JOIN t ON t.flag = b.flag AND score = bin GROUP BY ALL)
            SELECT c.flag, bin, n, round(n / nullif(sum(n) OVER (PARTITION BY c.flag), 0), 6) AS share, mean_all, n_all FROM c JOIN a USING (flag)""".replace("SELECT flag, bin, count(score) AS n FROM b", "SELECT b.flag, bin, count(score) AS n FROM b"),
        "q_moments_mass": """
            WITH w AS (SELECT o_orderpriority, o_orderkey, o_totalprice / avg(o_totalprice) OVER (PARTITION BY o_orderpriority) AS w FROM orders),
            r AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY w DESC, o_orderkey) AS r, count(*) OVER (PARTITION BY o_orderpriority) AS c FROM w)
            SELECT o_orderpriority, round(avg(w), 6) AS mean, round(stddev_pop(w), 6) AS std, round(sum(w) FILTER (r <= greatest(1, floor(c * 0.2))) / sum(w), 6) AS top_mass, count(*) AS n
            FROM r GROUP BY o_orderpriority""",
        "q_transforms": """
            WITH t AS (SELECT l_returnflag, (l_discount - 0.05) * 400 AS x FROM lineitem),
            z AS (SELECT l_returnflag, x, 0.5 * greatest(-10, least(10, x)) AS z, min(x) OVER (PARTITION BY l_returnflag) AS low FROM t)
            SELECT l_returnflag, round(avg(exp(z)), 4) AS mean_exp, round(avg(ln(1 + exp(z))), 4) AS mean_softplus, round(avg(exp(z)), 4) AS mean_clipped_exp, round(avg(x - low + 1e-8), 4) AS mean_shifted, count(*) AS n
            FROM z GROUP BY l_returnflag""",
        "q_fallback_fill": f"""
            WITH {_CELLS}, actual AS (SELECT dataset, provider, seed, 'Base' AS label, max(accuracy) AS accuracy FROM cells WHERE has_results GROUP BY dataset, provider, seed),
            far AS (SELECT dataset, provider, seed * 3 AS seed, label, accuracy FROM fallback)
            SELECT dataset, provider, seed, label, round(accuracy, 6) AS accuracy, false AS from_fallback FROM actual
            UNION ALL SELECT dataset, provider, seed, label, round(accuracy, 6), true FROM far ANTI JOIN actual USING (dataset, provider, seed)""",
        "q_missing_grid": f"""
            WITH {_CELLS}, seen AS (SELECT * REPLACE (has_results AND seed < 30 AS has_results) FROM cells),
            grid AS (SELECT dataset, provider, CAST(seed AS INTEGER) AS seed FROM (VALUES ('1-URGENT'), ('2-HIGH'), ('5-LOW')) a(dataset), (VALUES ('F'), ('O'), ('P')) b(provider), range(50) c(seed)),
            newest AS (SELECT dataset, provider, seed, timestamp AS newest_timestamp, run AS newest_run FROM seen QUALIFY row_number() OVER (PARTITION BY dataset, provider, seed ORDER BY timestamp DESC, run DESC) = 1)
            SELECT dataset, provider, seed, newest_timestamp, newest_run
            FROM (SELECT * FROM grid ANTI JOIN (SELECT * FROM seen WHERE has_results) USING (dataset, provider, seed)) g
            ANTI JOIN fallback USING (dataset, provider, seed) LEFT JOIN newest USING (dataset, provider, seed)""",
        "q_pivot_report": """
            WITH t AS (SELECT o_orderpriority AS source, o_orderkey AS k, printf('%.4f', (o_orderkey % 1000) / 1000) AS acc FROM orders),
            teacher AS (SELECT 'teacher_' || source AS source, arg_max(acc, k) AS teacher_accuracy FROM t WHERE k % 6 = 0 GROUP BY 1),
            cells AS (SELECT source, arg_max(acc, k) FILTER (k % 3 = 2) AS plain, arg_max(acc || '<br><sub>seed ' || (k % 7) || '</sub>', k) FILTER (k % 3 = 1 AND k % 2 = 0) AS beta_0,
                             arg_max(acc || '<br><sub>seed ' || (k % 7) || '</sub>', k) FILTER (k % 3 = 1 AND k % 2 = 1) AS beta_1 FROM t WHERE k % 3 <> 0 GROUP BY source),
            j AS (SELECT source, coalesce(teacher_accuracy, '') AS teacher_accuracy, coalesce(plain, '') AS plain, coalesce(beta_0, '') AS beta_0, coalesce(beta_1, '') AS beta_1 FROM teacher FULL JOIN cells USING (source))
            SELECT *, '| ' || source || ' | ' || teacher_accuracy || ' | ' || plain || ' | ' || beta_0 || ' | ' || beta_1 || ' |' AS line FROM j""",
        "q_success_tally": "SELECT o_orderstatus, count(*) FILTER (o_custkey % 4 = 0) AS succeeded, count(*) AS n FROM orders GROUP BY o_orderstatus",
        "q_format_percent_duration": r"""
            WITH t AS (SELECT o_orderkey, o_orderdate, o_custkey % 9000 AS s FROM orders)
            SELECT o_orderkey, regexp_replace(regexp_replace(printf('%.2f', o_orderkey % 1000 / 1000 * 100), '0+$', ''), '\.$', '') || '%' AS share,
                   CASE WHEN s < 60 THEN printf('%.1f', s::DOUBLE) || 's' WHEN s < 3600 THEN (s // 60) || 'm ' || (s % 60) || 's' ELSE (s // 3600) || 'h ' || (s // 60 % 60) || 'm ' || (s % 60) || 's' END AS took,
                   strftime(o_orderdate, '%Y%m%d_%H%M%S') AS stamp FROM t""",
        "q_subsequence_index": """
            WITH t AS (SELECT conv_id, turn, list_filter(string_split(text, ' '), lambda w: w <> '') AS w FROM conversations)
            SELECT conv_id, turn, CASE WHEN len(w[3:4]) = 0 THEN 0 ELSE list_position([w[i:i + len(w[3:4]) - 1] = w[3:4] FOR i IN range(1, len(w) - len(w[3:4]) + 2)], true) + len(w[3:4]) - 1 END::BIGINT AS at, 0::BIGINT AS nowhere FROM t""",
        "q_json_roundtrip": """
            SELECT event_type, count(props) AS n, sum(len(json_keys(props)))::BIGINT AS n_keys, count(*) FILTER (len(json_keys(props)) > 0) AS n_full FROM events GROUP BY event_type""",
        "q_prompt_dictionary": f"""
            WITH {_SPLIT}, p AS (SELECT *, CAST(split_part(example_id, '_', 2) AS BIGINT) AS pos FROM split),
            j AS (SELECT split, CAST(floor(pos / 100) AS BIGINT) AS chunk, '[' || string_agg('{{"example_id":"' || example_id || '","doc_id":' || doc_id || '}}', ',' ORDER BY pos) || ']' AS examples FROM p GROUP BY ALL)
            SELECT split, chunk, length(examples) AS n_chars, md5(examples) AS digest FROM j""",
        "q_markdown_examples": """
            WITH t AS (SELECT o_orderkey AS k, o_custkey AS c, chr(10) AS n, CASE WHEN o_orderkey % 3 = 0 THEN 'True' ELSE 'False' END AS ok FROM orders)
            SELECT CAST(k AS VARCHAR) AS example_id, '## ' || k || n || n || 'Prompt:' || n || n || 'solve' || n || n || 'Trace:' || n || n || 'trace ' || c || n || n
                || 'Answer-Forced Final Answer:' || n || n || CASE WHEN k % 2 = 0 THEN 'forced' ELSE '' END || n || n
                || 'Raw extracted answer: `' || c || '`' || n || 'AF extracted answer: `None`' || n || 'Raw correct: `' || ok || '`' || n || 'AF correct: `None`' || n
                || 'Extracted answer: `' || c || '`' || n || 'Correct: `' || ok || '`' || n || n || '---' || n AS section FROM t""",
        "q_series": f"""
            WITH {_REPORT} SELECT dataset, label, list_position(['Base', 'Finished', 'Open'], label)::BIGINT AS place, round(round(mean, 6) * 100, 4) AS percent, round(round(stderr, 6) * 100, 4) AS stderr_percent
            FROM stats WHERE label IN ('Base', 'Finished', 'Open')""",
        "q_flagship_run_report": f"WITH {_REPORT} SELECT dataset, label, round(mean, 6) AS mean, round(stderr, 6) AS stderr, n FROM stats",
        "q_inspection": r"""
            WITH t AS (SELECT o_orderkey AS k, o_orderstatus = 'F' AS forced, o_orderkey % 2 = 0 AS complete, o_orderkey % 3 AS gold FROM orders),
            g AS (SELECT *, CASE WHEN complete THEN CAST(k % 7 AS VARCHAR) END AS raw_extracted_answer, CASE WHEN forced AND k % 4 <> 0 THEN CAST(k % 3 AS VARCHAR) END AS af_extracted_answer,
                         complete AND k % 7 = gold AS raw_correct, CASE WHEN forced THEN k % 4 <> 0 END AS af_correct FROM t)
            SELECT CAST(k AS VARCHAR) AS example_id, complete, raw_correct, af_correct, raw_extracted_answer, af_extracted_answer,
                   CASE WHEN forced THEN af_correct ELSE raw_correct END AS correct, CASE WHEN forced THEN af_extracted_answer ELSE raw_extracted_answer END AS extracted_answer FROM g""",
        "q_judge_scores": """
            WITH t AS (SELECT o_orderstatus AS series, o_custkey % 8 AS score FROM orders WHERE o_custkey % 8 BETWEEN 1 AND 5),
            b AS (SELECT series, unnest([1, 2, 3, 4, 5])::INTEGER AS bin, count(*) AS c FROM t GROUP BY series)
            SELECT b.series, bin, round(100.0 * count(t.score) / c, 6) AS percent FROM b LEFT JOIN t ON t.series = b.series AND t.score = bin GROUP BY b.series, bin, c""",
        "q_answer_equality": "SELECT p_partkey, form, true AS equal, false AS other FROM part, range(8) f(form)",
        "q_algebra": f"""
            SELECT p_partkey, form, equal, equal AS turned
            FROM (SELECT p_partkey, form, CASE form {" ".join(f"WHEN {n} THEN {want}" for n, (_, _, want) in enumerate(ALGEBRA))} END AS equal
                  FROM (SELECT p_partkey, p_partkey % 50 + 2 AS k, p_size % 50 + 2 AS m FROM part), range({len(ALGEBRA)}) f(form))""",
        "q_student_grid": """
            SELECT source, mode, CASE mode WHEN 'naive' THEN 1 ELSE 3 END::BIGINT AS n, CASE mode WHEN 'naive' THEN 1.0 ELSE 3.5 END::DOUBLE AS sum_beta
            FROM (SELECT DISTINCT 'teacher_' || o_orderpriority AS source FROM orders WHERE o_orderpriority IS NOT NULL) s, (VALUES ('naive'), ('strategic_fd')) m(mode)""",
        "q_masked_loss": "SELECT l_returnflag, round(coalesce(sum(l_quantity) FILTER (l_linenumber % 2 = 0), 0) / greatest(count(*) FILTER (l_linenumber % 2 = 0), 1), 6) AS loss FROM lineitem GROUP BY l_returnflag",
        "q_problem_files": """
            SELECT CASE o_orderstatus WHEN 'P' THEN 'test' ELSE 'train' END AS split, CASE WHEN o_orderstatus IN ('F', 'P') THEN 0 ELSE 1 END::BIGINT AS subset_ord, o_orderpriority AS type,
                   count(*) AS n, min('q' || o_orderkey) AS first_problem, max(CAST(o_custkey AS VARCHAR)) AS last_gold
            FROM orders GROUP BY ALL""",
        "q_trace_files": """
            WITH t AS (SELECT conv_id || '-' || turn AS question, role AS subject, turn % 2 = 0 AS correct FROM conversations)
            SELECT subject, upper(subject) AS predicted_answer, count(*) AS n, count(*) FILTER (correct) AS n_correct, (SELECT count(DISTINCT question) FROM t) AS n_done FROM t GROUP BY subject""",
        "q_quarantine": """
            SELECT role AS part, count(*) AS n, sum(length(text))::BIGINT AS n_chars FROM conversations WHERE turn % 7 <> 3 GROUP BY role
            UNION ALL SELECT 'bad ' || '{"conv_id"' AS part, count(*) AS n, (12 * count(*))::BIGINT AS n_chars FROM conversations WHERE turn % 7 = 3 HAVING count(*) > 0""",
        "q_latest_stream": """
            SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id) AS r FROM events) WHERE r = 1""",
        "q_run_summary": """
            WITH o AS (SELECT CASE o_orderstatus WHEN 'F' THEN 'claude' WHEN 'O' THEN 'gemini' ELSE 'openai' END AS provider, CASE WHEN o_orderpriority < '3' THEN 'math' ELSE 'gsm8k' END AS dataset,
                              CAST(o_custkey % 5 AS INTEGER) AS seed, strftime(o_orderdate, '%Y%m01_000000') AS timestamp, month(o_orderdate) % 5 <> 0 AND o_custkey % 5 < 4 AS ended, o_orderkey AS k, o_custkey AS c FROM orders),
            runs AS (SELECT dataset, provider, seed, timestamp, ended, avg((k % 100) / 100) AS base, avg((c % 100) / 100) AS qa, avg(CAST(k % 3 = 0 AS DOUBLE)) AS traces FROM o GROUP BY ALL),
            named AS (SELECT *, 'real_' || provider || '_' || dataset || '_traces_seed' || seed || '_' || timestamp AS run FROM runs),
            selected AS (SELECT * FROM named WHERE ended QUALIFY row_number() OVER (PARTITION BY dataset, provider, seed ORDER BY timestamp DESC) = 1),
            fallback AS (SELECT CASE n_nationkey % 2 WHEN 0 THEN 'math' ELSE 'gsm8k' END AS dataset, ['claude', 'gemini', 'openai'][n_nationkey % 3 + 1] AS provider, CAST(n_nationkey + 4 AS INTEGER) AS seed FROM nation),
            used AS (SELECT *, row_number() OVER (ORDER BY dataset, provider, seed) - 1 AS place FROM fallback ANTI JOIN selected USING (dataset, provider, seed)),
            vals AS (SELECT dataset, provider, seed, unnest(['Base', 'SFT on Q&A', 'Trace SFT']) AS label, unnest([base, qa, traces]) AS x FROM selected
                     UNION ALL SELECT dataset, provider, seed, unnest(['Base', 'Trace SFT']), unnest([0.25, 0.5]) FROM used),
            inside AS (SELECT * FROM vals WHERE seed < 5),
            points AS (SELECT dataset, label, avg(x) AS m FROM inside WHERE label <> 'Trace SFT' GROUP BY dataset, label, seed
                       UNION ALL SELECT dataset, CASE provider WHEN 'claude' THEN 'Claude' WHEN 'gemini' THEN 'Gemini' ELSE 'GPT' END, x FROM inside WHERE label = 'Trace SFT'),
            bars AS (SELECT dataset, label, avg(m) AS mean, CASE WHEN count(m) = 1 THEN 0.0 ELSE stddev_samp(m) / sqrt(count(m)) END AS stderr, count(m) AS n
                     FROM (SELECT * FROM (VALUES ('gsm8k'), ('math')) d(dataset), (VALUES ('Base'), ('SFT on Q&A'), ('Claude'), ('Gemini'), ('GPT')) l(label)) g LEFT JOIN points USING (dataset, label) GROUP BY dataset, label),
            cells AS (SELECT dataset, provider, CAST(seed AS INTEGER) AS seed FROM (VALUES ('gsm8k'), ('math')) d(dataset), (VALUES ('claude'), ('gemini'), ('openai')) p(provider), range(5) s(seed)),
            newest AS (SELECT dataset, provider, seed, max(run) AS run FROM named GROUP BY ALL),
            gaps AS (SELECT g.*, run FROM (SELECT * FROM cells ANTI JOIN selected USING (dataset, provider, seed)) g ANTI JOIN fallback USING (dataset, provider, seed) LEFT JOIN newest USING (dataset, provider, seed)),
            leaves AS (
                SELECT 'selected_runs' AS part, dataset || '/' || provider || '/seed' || seed || ' > ' || unnest(['timestamp', 'run_dir']) AS path, NULL::DOUBLE AS number, unnest([timestamp, 'runs/' || run]) AS text FROM selected
                UNION ALL SELECT 'per_seed_provider', dataset || ' > ' || provider || ' > ' || seed || ' > ' || label, x, NULL FROM vals
                UNION ALL SELECT 'plot_stats', dataset || ' > ' || label || ' > ' || unnest(['mean', 'stderr', 'n']), unnest([mean, stderr, n]), NULL FROM bars
                UNION ALL SELECT 'used_fallbacks', place || ' > ' || unnest(['dataset', 'provider', 'seed']), unnest([NULL, NULL, seed]), unnest([dataset, provider, NULL]) FROM used
                UNION ALL SELECT 'missing', dataset || ' > ' || provider || ' > ' || seed, NULL, run FROM gaps)
            SELECT part, path, round(number, 6) AS number, text FROM leaves""",
        "q_event_leaves": """
            SELECT event_type, replace(substr(t.fullkey, 3), '"', '') AS path, count(*) AS n, min(t.atom ->> '$') AS first, max(t.atom ->> '$') AS last
            FROM events, json_tree(props) t WHERE t.type NOT IN ('OBJECT', 'ARRAY') GROUP BY ALL""",
        "q_windowed_counts": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY ALL",
        "q_run_names": """
            SELECT ['gemini', 'claude', 'openai'][o_orderkey % 4 + 1] AS provider, CASE WHEN o_orderkey % 2 = 0 THEN 'math' ELSE 'gsm8k' END AS dataset, CAST(o_orderkey % 3 AS INTEGER) AS seed,
                   count(*) AS n, max(strftime(o_orderdate, '%Y%m%d_%H%M%S')) AS newest
            FROM orders WHERE o_orderkey % 4 < 3 AND o_orderkey % 3 < 2 GROUP BY ALL""",
    }
