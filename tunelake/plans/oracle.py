"""Independent DuckDB SQL for every SQL-expressible registered query.

The tables of the data folder are views with the same names.  Derived
inputs are spelled out as CTE text so both engines start from the same rows.
"""

from __future__ import annotations

import math

PAIRS_RAW = """
SELECT conv_id,
       arg_max(text, turn) FILTER (WHERE role = 'user') AS prompt,
       arg_max(text, turn) FILTER (WHERE role = 'assistant') AS response
FROM conversations GROUP BY conv_id"""

PAIRS = f"SELECT * FROM ({PAIRS_RAW}) WHERE length(prompt) > 0 AND length(response) > 0"

# Python whitespace (str.split) as an RE2 class, same set as text.PY_SPACE_CLASS.
WS = r"'[^\t\n\x{000B}\f\r\x{001C}-\x{001F} \x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+'"

LENGTHS = f"""
SELECT conv_id,
       CAST(len(regexp_extract_all(prompt, {WS})) AS BIGINT) AS prompt_tokens,
       CAST(len(regexp_extract_all(response, {WS})) AS BIGINT) AS response_tokens,
       CAST(len(regexp_extract_all(prompt, {WS})) + len(regexp_extract_all(response, {WS})) AS BIGINT) AS total_tokens
FROM ({PAIRS})"""

LOSS_LOG = """
SELECT user_id AS run,
       row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step,
       ts, event_id, value / 100.0 AS loss,
       CAST(json_extract_string(props, '$.k') AS BIGINT) AS num_tokens
FROM events"""


def stats(x: str, name: str | None = None) -> str:
    pre = f"{name}_" if name else ""
    return (f"quantile_cont({x}, 0.5) AS {pre}p50, quantile_cont({x}, 0.9) AS {pre}p90, "
            f"quantile_cont({x}, 0.95) AS {pre}p95, quantile_cont({x}, 0.99) AS {pre}p99, "
            f"CAST(max({x}) AS BIGINT) AS {pre}max_len, CAST(min({x}) AS BIGINT) AS {pre}min_len, "
            f"avg({x}) AS {pre}mean, stddev_pop({x}) AS {pre}std_dev")


def histogram_sql(values_sql: str, bins: int, group: str | None = None) -> str:
    g = f"{group}, " if group else ""
    on = f"b.{group} = c.{group} AND " if group else ""
    return f"""
WITH v AS ({values_sql}),
     b0 AS (SELECT {g}min(v) AS lo0, max(v) AS hi0 FROM v WHERE v IS NOT NULL {('GROUP BY ' + group) if group else ''}),
     b AS (SELECT {g}CASE WHEN lo0 = hi0 THEN lo0 - 0.5 ELSE lo0 END AS lo,
                  CASE WHEN lo0 = hi0 THEN hi0 + 0.5 ELSE hi0 END AS hi FROM b0),
     c AS (SELECT {('v.' + group + ', ') if group else ''}
                  CAST(least(floor((v.v - b.lo) * {float(bins)} / (b.hi - b.lo)), {bins - 1}) AS BIGINT) AS bin,
                  count(*) AS n
           FROM v JOIN b ON {('v.' + group + ' = b.' + group) if group else 'TRUE'}
           WHERE v.v IS NOT NULL GROUP BY ALL)
SELECT {('b.' + group + ', ') if group else ''}CAST(r.bin AS BIGINT) AS bin,
       b.lo + r.bin * (b.hi - b.lo) / {float(bins)} AS bin_lo,
       CASE WHEN r.bin = {bins - 1} THEN b.hi ELSE b.lo + (r.bin + 1) * (b.hi - b.lo) / {float(bins)} END AS bin_hi,
       CAST(coalesce(c.n, 0) AS BIGINT) AS count
FROM b CROSS JOIN (SELECT range AS bin FROM range({bins})) r
LEFT JOIN c ON {on}c.bin = r.bin"""


SQL: dict[str, str] = {}

SQL["read_pairs_source"] = "SELECT conv_id, turn, role, text FROM conversations"

SQL["cap_samples"] = """
SELECT * FROM conversations
WHERE conv_id IN (SELECT DISTINCT conv_id FROM conversations ORDER BY conv_id LIMIT 50)"""

SQL["dataset_slug"] = r"""
WITH s AS (SELECT page_id, regexp_extract(regexp_replace(url, '/+$', ''), '([^/]*)$', 1) AS last FROM pages)
SELECT page_id,
       replace(CASE WHEN regexp_matches(last, '^\.[^.]*$') OR NOT regexp_matches(last, '.\.[^.]+$') THEN last
            ELSE regexp_extract(last, '^(.*)\.[^.]+$', 1) END, '/', '_') AS slug
FROM s"""

SQL["pairs_from_turns"] = PAIRS_RAW
SQL["pairs_from_messages"] = PAIRS_RAW
SQL["pairs_from_columns"] = "SELECT doc_id, CAST(text AS VARCHAR) AS prompt, CAST(source AS VARCHAR) AS response FROM documents"
SQL["nonempty_pairs"] = PAIRS
SQL["drop_null_pairs"] = f"SELECT * FROM ({PAIRS_RAW}) WHERE prompt IS NOT NULL AND response IS NOT NULL"
SQL["chat_template"] = f"""
SELECT conv_id,
       '<|im_start|>user' || chr(10) || prompt || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) AS formatted_prompt,
       response || '<|im_end|>' AS formatted_response
FROM ({PAIRS})"""

SQL["whitespace_tokens_docs"] = f"""
SELECT doc_id, CAST(len(regexp_extract_all(text, {WS})) AS BIGINT) AS n_tokens,
       array_to_string(regexp_extract_all(text, {WS}), ' ') AS tokens
FROM documents"""

SQL["pair_token_lengths"] = LENGTHS

SQL["length_quantiles"] = f"""
WITH l AS ({LENGTHS})
SELECT 'prompt_tokens' AS measure, {stats('prompt_tokens')} FROM l
UNION ALL SELECT 'response_tokens', {stats('response_tokens')} FROM l
UNION ALL SELECT 'total_tokens', {stats('total_tokens')} FROM l"""

SQL["length_quantiles_by_lang"] = f"""
WITH d AS (SELECT lang, CAST(len(regexp_extract_all(text, {WS})) AS BIGINT) AS doc_tokens FROM documents)
SELECT lang, 'doc_tokens' AS measure, {stats('doc_tokens')} FROM d GROUP BY lang"""

SQL["recommended_length"] = f"""
WITH l AS ({LENGTHS})
SELECT quantile_cont(total_tokens, 0.99) AS total_p99,
       CAST(CASE WHEN quantile_cont(total_tokens, 0.99) <= 2048 THEN 2048 ELSE 4096 END AS BIGINT)
         AS recommended_max_seq_length
FROM l"""

SQL["null_profile"] = f"""
WITH p AS ({PAIRS_RAW}),
     c AS (SELECT count(*) FILTER (WHERE conv_id IS NULL) AS a, count(*) FILTER (WHERE prompt IS NULL) AS b,
                  count(*) FILTER (WHERE response IS NULL) AS c FROM p)
SELECT 'conv_id' AS feature, CAST(a AS BIGINT) AS null_count, CASE WHEN a = 0 THEN 'PASS' ELSE 'WARNING (' || a || ' nulls)' END AS status FROM c
UNION ALL SELECT 'prompt', CAST(b AS BIGINT), CASE WHEN b = 0 THEN 'PASS' ELSE 'WARNING (' || b || ' nulls)' END FROM c
UNION ALL SELECT 'response', CAST(c AS BIGINT), CASE WHEN c = 0 THEN 'PASS' ELSE 'WARNING (' || c || ' nulls)' END FROM c"""

SQL["eda_summary"] = f"""
WITH p AS ({PAIRS_RAW}),
     l AS (SELECT *, CASE WHEN prompt IS NOT NULL AND response IS NOT NULL THEN len(regexp_extract_all(prompt, {WS})) END AS pl,
                     CASE WHEN prompt IS NOT NULL AND response IS NOT NULL THEN len(regexp_extract_all(response, {WS})) END AS rl
           FROM p)
SELECT 'conversations' AS dataset_name, CAST(count(*) AS BIGINT) AS total_samples,
       CAST(count(*) FILTER (WHERE prompt IS NULL) AS BIGINT) AS null_prompt,
       CAST(count(*) FILTER (WHERE response IS NULL) AS BIGINT) AS null_response,
       {stats('pl', 'prompt')}, {stats('rl', 'response')}, {stats('pl + rl', 'total')},
       CAST(CASE WHEN quantile_cont(pl + rl, 0.99) <= 2048 THEN 2048 ELSE 4096 END AS BIGINT) AS recommended_max_seq_length
FROM l"""

SQL["cutoff_coverage"] = f"""
WITH l AS ({LENGTHS}),
     c AS (SELECT CASE WHEN quantile_cont(total_tokens, 0.99) <= 2048 THEN 2048 ELSE 4096 END AS cutoff FROM l)
SELECT CAST(c.cutoff AS BIGINT) AS cutoff, CAST(count(*) AS BIGINT) AS n,
       avg(CASE WHEN total_tokens <= c.cutoff THEN 1.0 ELSE 0.0 END)::DOUBLE AS coverage
FROM l, c GROUP BY c.cutoff"""

SQL["length_histogram"] = histogram_sql(
    f"SELECT CAST(len(regexp_extract_all(text, {WS})) AS DOUBLE) AS v FROM documents", 60)

SQL["pair_length_histogram"] = histogram_sql(
    f"""SELECT 'prompt' AS measure, CAST(prompt_tokens AS DOUBLE) AS v FROM ({LENGTHS})
        UNION ALL SELECT 'response', CAST(response_tokens AS DOUBLE) FROM ({LENGTHS})""", 50, group="measure")

SQL["seeded_shuffle_rank"] = """
SELECT doc_id, md5('42:' || CAST(doc_id AS VARCHAR)) AS shuffle_key,
       CAST(row_number() OVER (ORDER BY md5('42:' || CAST(doc_id AS VARCHAR)), doc_id) - 1 AS BIGINT) AS position
FROM documents"""

SQL["hash_split"] = """
WITH b AS (SELECT doc_id, CAST(CAST(('0x' || substr(md5('42:' || CAST(doc_id AS VARCHAR)), 1, 8)) AS UBIGINT) % 10000 AS BIGINT) AS bucket
           FROM documents)
SELECT doc_id, bucket, CASE WHEN bucket < 9000 THEN 'train' WHEN bucket < 9500 THEN 'validation' ELSE 'test' END AS split
FROM b"""

# -- vocabulary, sequences, batches ----------------------------------------

DOC_TOKENS = f"SELECT doc_id, regexp_extract_all(text, {WS}) AS t FROM documents"
DOC_VOCAB = f"""
SELECT token, CAST(c AS BIGINT) AS count, CAST(row_number() OVER (ORDER BY c DESC, token) + 1 AS BIGINT) AS id
FROM (SELECT token, count(*) AS c FROM (SELECT unnest(t) AS token FROM ({DOC_TOKENS})) GROUP BY token
     )"""

SQL["vocab_table"] = DOC_VOCAB

SQL["encode_tokens"] = f"""
WITH v AS ({DOC_VOCAB}),
     e AS (SELECT doc_id, unnest(t) AS token, generate_subscripts(t, 1) AS pos FROM ({DOC_TOKENS})),
     j AS (SELECT e.doc_id, e.pos, coalesce(v.id, 1) AS id FROM e LEFT JOIN v ON e.token = v.token),
     g AS (SELECT doc_id, list(id ORDER BY pos) AS ids FROM j GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(len(g.ids), 0) AS BIGINT) AS n_tokens,
       CAST(coalesce(len(list_filter(g.ids, lambda x: x = 1)), 0) AS BIGINT) AS n_unk,
       coalesce(array_to_string(g.ids, ' '), '') AS ids
FROM documents d LEFT JOIN g ON d.doc_id = g.doc_id"""

PAIR_TOKENS = f"""
SELECT conv_id,
       regexp_extract_all('<|im_start|>user' || chr(10) || prompt || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10), {WS}) AS pt,
       regexp_extract_all(response || '<|im_end|>', {WS}) AS rt
FROM ({PAIRS})"""

PAIR_IDS = f"""
WITH t AS ({PAIR_TOKENS}),
     v AS (SELECT token, row_number() OVER (ORDER BY c DESC, token) + 1 AS id
           FROM (SELECT token, count(*) AS c FROM (SELECT unnest(pt) AS token FROM t UNION ALL SELECT unnest(rt) FROM t)
                 GROUP BY token)),
     e AS (SELECT conv_id, 'p' AS side, unnest(pt) AS token, generate_subscripts(pt, 1) AS pos FROM t
           UNION ALL SELECT conv_id, 'r', unnest(rt), generate_subscripts(rt, 1) FROM t),
     j AS (SELECT e.conv_id, e.side, e.pos, CAST(coalesce(v.id, 1) AS BIGINT) AS id FROM e LEFT JOIN v ON e.token = v.token)
SELECT conv_id, list(id ORDER BY pos) FILTER (WHERE side = 'p') AS pid,
       list(id ORDER BY pos) FILTER (WHERE side = 'r') AS rid
FROM j GROUP BY conv_id"""

SEQS = f"""
WITH i AS ({PAIR_IDS}), s AS (SELECT conv_id, pid, rid, list_slice(list_concat(pid, rid), 1, 48) AS ids FROM i)
SELECT conv_id, pid, ids,
       list_concat(list_transform(range(least(len(pid), len(ids))), lambda x: CAST(-100 AS BIGINT)),
                   list_slice(ids, len(pid) + 1, len(ids))) AS labels,
       list_transform(ids, lambda x: CAST(1 AS BIGINT)) AS mask
FROM s"""

SQL["build_sequences"] = f"""
SELECT conv_id, CAST(len(pid) AS BIGINT) AS prompt_len, CAST(len(ids) AS BIGINT) AS seq_len,
       array_to_string(ids, ' ') AS input_ids, array_to_string(labels, ' ') AS labels,
       array_to_string(mask, ' ') AS attention_mask
FROM ({SEQS})"""

# The same sequences under a rule that stands for a user tokenizer: a word's id is its length plus 2.
WORD_LENGTHS = "lambda x: CAST(length(x) + 2 AS BIGINT)"
SQL["tokenizer_sequences"] = f"""
WITH i AS (SELECT conv_id, list_transform(pt, {WORD_LENGTHS}) AS pid, list_transform(rt, {WORD_LENGTHS}) AS rid
           FROM ({PAIR_TOKENS})),
     s AS (SELECT conv_id, pid, list_slice(list_concat(pid, rid), 1, 48) AS ids FROM i)
SELECT conv_id, CAST(len(pid) AS BIGINT) AS prompt_len, CAST(len(ids) AS BIGINT) AS seq_len,
       array_to_string(ids, ' ') AS input_ids,
       array_to_string(list_concat(list_transform(range(least(len(pid), len(ids))), lambda x: CAST(-100 AS BIGINT)),
                                   list_slice(ids, len(pid) + 1, len(ids))), ' ') AS labels
FROM s"""

SQL["supervised_tokens"] = f"""
SELECT conv_id, CAST(len(list_filter(labels, lambda x: x <> -100)) AS BIGINT) AS supervised_tokens,
       len(list_filter(labels, lambda x: x <> -100)) = 0 AS no_target
FROM ({SEQS})"""

SQL["generated_suffix"] = f"""
SELECT conv_id, CAST(len(rid) AS BIGINT) AS generated_count, array_to_string(rid, ' ') AS generated_ids
FROM ({PAIR_IDS})"""

BATCHED = f"""
WITH s AS ({SEQS}),
     o AS (SELECT *, CAST(row_number() OVER (ORDER BY md5('42:' || CAST(conv_id AS VARCHAR)), conv_id) - 1 AS BIGINT) AS position FROM s),
     b AS (SELECT *, position // 2 AS batch_id FROM o)
SELECT *, CAST(max(len(ids)) OVER (PARTITION BY batch_id) AS BIGINT) AS batch_max_len FROM b"""

SQL["padded_batches"] = f"""
SELECT conv_id, position, CAST(batch_id AS BIGINT) AS batch_id, batch_max_len,
       array_to_string(list_concat(ids, list_transform(range(batch_max_len - len(ids)), lambda x: 0)), ' ') AS input_ids,
       array_to_string(list_concat(mask, list_transform(range(batch_max_len - len(ids)), lambda x: 0)), ' ') AS attention_mask,
       array_to_string(list_concat(labels, list_transform(range(batch_max_len - len(ids)), lambda x: -100)), ' ') AS labels
FROM ({BATCHED})"""

SQL["accumulation_plan"] = f"""
WITH o AS (SELECT conv_id, row_number() OVER (ORDER BY md5('42:' || CAST(conv_id AS VARCHAR)), conv_id) - 1 AS position FROM ({PAIRS})),
     b AS (SELECT position // 2 AS batch_id, count(*) AS batch_rows FROM o GROUP BY 1),
     nb AS (SELECT count(*) AS n FROM b),
     e AS (SELECT b.batch_id, b.batch_rows, r.range AS epoch, r.range * nb.n + b.batch_id AS k
           FROM b, nb, range(CAST(ceil(8000.0 / nb.n) AS BIGINT)) r)
SELECT CAST(k // 8 AS BIGINT) AS step, CAST(k % 8 AS BIGINT) AS micro_step, CAST(epoch AS BIGINT) AS epoch,
       CAST(batch_id AS BIGINT) AS batch_id, CAST(batch_rows AS BIGINT) AS batch_rows
FROM e WHERE k < 8000"""

# -- losses and runs ---------------------------------------------------------

VALID = "(loss IS NOT NULL AND NOT isnan(loss) AND abs(loss) < 'inf'::DOUBLE)"

SQL["perplexity_by_run"] = f"""
WITH a AS (SELECT run, sum(CASE WHEN {VALID} THEN loss * num_tokens END) AS tl,
                  sum(CASE WHEN {VALID} THEN num_tokens END) AS tt, count(*) FILTER (WHERE {VALID}) AS steps
           FROM ({LOSS_LOG}) GROUP BY run),
     m AS (SELECT *, CASE WHEN coalesce(tt, 0) = 0 THEN 0.0 ELSE tl / tt END AS ml FROM a)
SELECT run, CAST(steps AS BIGINT) AS steps, CAST(coalesce(tt, 0) AS BIGINT) AS total_tokens, ml::DOUBLE AS mean_loss,
       CASE WHEN ml <= 0 THEN 1.0 ELSE exp(least(ml, 100.0)) END::DOUBLE AS perplexity
FROM m"""

SQL["running_perplexity"] = f"""
WITH r AS (SELECT run, step,
                  -- exact sums, like the query's: decimals of 18 places, by way of text
                  CAST(CAST(sum(CAST(CAST(CASE WHEN {VALID} THEN loss * num_tokens END AS VARCHAR) AS DECIMAL(38, 18)))
                            OVER w AS VARCHAR) AS DOUBLE) AS tl,
                  sum(CASE WHEN {VALID} THEN num_tokens END) OVER w AS tt,
                  count(CASE WHEN {VALID} THEN 1 END) OVER w AS vs
           FROM ({LOSS_LOG}) WINDOW w AS (PARTITION BY run ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
     m AS (SELECT *, CASE WHEN coalesce(tt, 0) = 0 THEN 0.0 ELSE tl / tt END AS ml FROM r)
SELECT run, step, CAST(vs AS BIGINT) AS valid_steps, ml::DOUBLE AS running_loss,
       CASE WHEN ml <= 0 THEN 1.0 ELSE exp(least(ml, 100.0)) END::DOUBLE AS running_perplexity
FROM m"""

SQL["train_log_intervals"] = f"""
WITH l AS ({LOSS_LOG}),
     iv AS (SELECT run, CAST(ceil(step / 10.0) AS BIGINT) AS interval, count(*) AS n_steps,
                   sum(loss * 8) AS s, avg(loss) AS loss_mean, max(ts) AS te FROM l GROUP BY ALL),
     r AS (SELECT run, max(step) AS last_step, min(ts) AS t0 FROM l GROUP BY run)
SELECT iv.run, iv.interval, CAST(least(iv.interval * 10, r.last_step) AS BIGINT) AS log_step,
       CAST(n_steps AS BIGINT) AS n_steps, s / 10.0 AS loss_ref, loss_mean,
       CASE WHEN epoch_us(te) - epoch_us(t0) = 0 THEN NULL
            ELSE least(iv.interval * 10, r.last_step) * 16 / ((epoch_us(te) - epoch_us(t0)) / 1e6) END AS samples_per_sec
FROM iv JOIN r ON iv.run = r.run"""

CKPT_BEST = """
WITH c AS (SELECT user_id AS run, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step,
                  value AS metric FROM events),
     p AS (SELECT *, min(CASE WHEN isnan(metric) THEN NULL ELSE metric END)
                       OVER (PARTITION BY run ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM c)
SELECT run, step, metric,
       coalesce(metric < coalesce(prev, 'inf'::DOUBLE), false) AS is_best,
       CASE WHEN coalesce(metric < coalesce(prev, 'inf'::DOUBLE), false) THEN metric ELSE coalesce(prev, 'inf'::DOUBLE) END AS best_metric_value
FROM p"""

SQL["running_best"] = CKPT_BEST

SQL["checkpoint_retention"] = f"""
WITH b AS ({CKPT_BEST}),
     r AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY step DESC) AS recency,
                  sum(CAST(is_best AS INTEGER)) OVER (PARTITION BY run ORDER BY step DESC
                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS later_best FROM b)
SELECT run, step, is_best, CAST(recency AS BIGINT) AS recency, recency <= 3 AS kept,
       is_best AND coalesce(later_best, 0) = 0 AS best_copy,
       CASE WHEN recency <= 3 OR (is_best AND coalesce(later_best, 0) = 0) THEN 'keep' ELSE 'purge' END AS action
FROM r"""

LATENCY = """
WITH l AS (SELECT event_type AS variant, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS seq,
                  value AS elapsed_ms, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS peak_mb FROM events)
SELECT variant, CAST(count(*) AS BIGINT) AS n, avg(elapsed_ms) AS mean_latency_ms,
       quantile_cont(elapsed_ms, 0.5) AS p50_latency_ms, quantile_cont(elapsed_ms, 0.9) AS p90_latency_ms,
       quantile_cont(elapsed_ms, 0.99) AS p99_latency_ms, max(peak_mb) AS peak_vram_mb
FROM l WHERE seq > 2 GROUP BY variant"""

SQL["latency_percentiles"] = LATENCY

SQL["generation_throughput"] = """
WITH g AS (SELECT event_type AS variant, count(*) AS n, sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS tok,
                  sum(value) AS sec FROM events GROUP BY event_type)
SELECT variant, CAST(n AS BIGINT) AS total_samples, CAST(tok AS BIGINT) AS total_tokens_generated,
       round(sec, 4) AS total_latency_seconds,
       round(CASE WHEN tok > 0 THEN sec / tok * 1000.0 ELSE 0.0 END, 2) AS latency_per_token_ms,
       round(CASE WHEN sec > 0 THEN tok / sec ELSE 0.0 END, 2) AS tokens_per_second
FROM g"""

SQL["variant_speedup"] = f"""
WITH s AS ({LATENCY})
SELECT 'click' AS variant_a, 'view' AS variant_b,
       max(mean_latency_ms) FILTER (WHERE variant = 'click') / greatest(max(mean_latency_ms) FILTER (WHERE variant = 'view'), 1e-6) AS speedup_factor,
       max(peak_vram_mb) FILTER (WHERE variant = 'click') - max(peak_vram_mb) FILTER (WHERE variant = 'view') AS vram_saved_mb
FROM s"""

SQL["memory_telemetry"] = """
WITH m AS (SELECT user_id % 4 AS device, ts, event_id, value AS allocated,
                  value + CAST(json_extract_string(props, '$.k') AS DOUBLE) AS reserved, 1000.0 AS total FROM events),
     r AS (SELECT device, ts, event_id, round(allocated, 3) AS allocated_gb, round(reserved, 3) AS reserved_gb,
                  round(total - reserved, 3) AS free_gb FROM m)
SELECT device, event_id, allocated_gb, reserved_gb, free_gb,
       round((reserved_gb - allocated_gb) / (reserved_gb + 1e-6) * 100.0, 2) AS fragmentation_pct,
       round(lag(reserved_gb) OVER (PARTITION BY device ORDER BY ts, event_id) - reserved_gb, 3) AS freed_gb
FROM r"""

SQL["metric_log_long"] = f"""
WITH l AS ({LOSS_LOG})
SELECT run, step, 'train/loss' AS key, loss AS value FROM l WHERE loss IS NOT NULL
UNION ALL SELECT run, step, 'train/num_tokens', CAST(num_tokens AS DOUBLE) FROM l WHERE num_tokens IS NOT NULL
UNION ALL SELECT run, step, 'train/ppl', CASE WHEN loss <= 0 THEN 1.0 ELSE exp(least(loss, 100.0)) END FROM l WHERE loss IS NOT NULL AND NOT isnan(loss)"""

# -- text metrics ------------------------------------------------------------

EVAL = f"SELECT conv_id, response AS prediction, prompt AS reference FROM ({PAIRS})"


def lcs_sql(a: str, b: str) -> str:
    """LCS length by folding the DP row over b (outer) and positions of a (inner)."""
    return (f"list_reduce({b}, lambda prev, y: list_reduce(range(1, len({a}) + 1), "
            f"lambda acc, i: list_append(acc, CASE WHEN {a}[i] = y THEN prev[i] + 1 "
            f"ELSE greatest(prev[i + 1], acc[i]) END), [0]), "
            f"list_transform(range(len({a}) + 1), lambda x: 0))[len({a}) + 1]")


def f1_sql(ov: str, pn: str, rn: str) -> str:
    p, r = f"({ov} / {pn})", f"({ov} / {rn})"
    return f"CASE WHEN {pn} > 0 AND {rn} > 0 AND {ov} > 0 THEN 2.0 * {p} * {r} / ({p} + {r}) ELSE 0.0 END"


WORDS = "'[a-z0-9]+'"

LCS_WS = f"""
WITH t AS (SELECT conv_id, regexp_extract_all(prediction, {WS}) AS a, regexp_extract_all(reference, {WS}) AS b FROM ({EVAL}))
SELECT conv_id, CAST(len(a) AS BIGINT) AS pred_len, CAST(len(b) AS BIGINT) AS ref_len,
       CAST({lcs_sql('a', 'b')} AS BIGINT) AS lcs FROM t"""

SQL["lcs_length"] = LCS_WS
ROUGE_L = f"SELECT conv_id, lcs, {f1_sql('lcs', 'pred_len', 'ref_len')} AS rouge_l FROM ({LCS_WS})"
SQL["rouge_l"] = ROUGE_L
SQL["sample_scores"] = f"SELECT conv_id, round(rouge_l * 100.0, 4) AS score FROM ({ROUGE_L})"
SQL["generation_metrics_fallback"] = f"""
WITH s AS (SELECT CASE WHEN count(*) > 0 THEN round(avg(rouge_l) * 100.0, 4) ELSE 0.0 END AS v FROM ({ROUGE_L}))
SELECT v AS rouge1, v AS rouge2, v AS rougeL, 0.0::DOUBLE AS bleu FROM s"""


def ngram_list(t: str, n: int) -> str:
    return f"list_transform(range(1, len({t}) - {n} + 2), lambda i: array_to_string({t}[i:i + {n} - 1], ' '))"


def overlap_sql(tokens_sql: str, orders) -> str:
    """(conv_id, pred_len, ref_len, overlap_n...) from (conv_id, pt, rt)."""
    parts = []
    for n in orders:
        parts.append(f"SELECT conv_id, {n} AS n, 'p' AS side, unnest({ngram_list('pt', n)}) AS gram FROM t")
        parts.append(f"SELECT conv_id, {n}, 'r', unnest({ngram_list('rt', n)}) FROM t")
    ovs = ", ".join(f"CAST(coalesce(sum(least(cp, cr)) FILTER (WHERE n = {n}), 0) AS BIGINT) AS overlap_{n}" for n in orders)
    sel = ", ".join(f"coalesce(o.overlap_{n}, 0) AS overlap_{n}, CAST(greatest(len(t.pt) - {n} + 1, 0) AS BIGINT) AS pred_{n}grams, "
                    f"CAST(greatest(len(t.rt) - {n} + 1, 0) AS BIGINT) AS ref_{n}grams" for n in orders)
    return f"""
WITH t AS ({tokens_sql}),
     g AS ({' UNION ALL '.join(parts)}),
     c AS (SELECT conv_id, n, gram, count(*) FILTER (WHERE side = 'p') AS cp, count(*) FILTER (WHERE side = 'r') AS cr
           FROM g GROUP BY ALL),
     o AS (SELECT conv_id, {ovs} FROM c GROUP BY conv_id)
SELECT t.conv_id, CAST(len(t.pt) AS BIGINT) AS pred_len, CAST(len(t.rt) AS BIGINT) AS ref_len, {sel}
FROM t LEFT JOIN o ON t.conv_id = o.conv_id"""


WORD_TOKENS = f"SELECT conv_id, regexp_extract_all(lower(prediction), {WORDS}) AS pt, regexp_extract_all(lower(reference), {WORDS}) AS rt FROM ({EVAL})"


def rouge_n_sql(n: int) -> str:
    p, r = f"(overlap_{n} / greatest(pred_{n}grams, 1))", f"(overlap_{n} / greatest(ref_{n}grams, 1))"
    return f"""
SELECT conv_id, overlap_{n}, pred_{n}grams, ref_{n}grams,
       CASE WHEN {p} + {r} > 0 THEN 2.0 * {p} * {r} / ({p} + {r}) ELSE 0.0 END AS rouge{n}
FROM ({overlap_sql(WORD_TOKENS, (n,))})"""


SQL["rouge_1"] = rouge_n_sql(1)
SQL["rouge_2"] = rouge_n_sql(2)

LCS_LIB = f"""
WITH t AS (SELECT conv_id, pt AS a, rt AS b FROM ({WORD_TOKENS})),
     l AS (SELECT conv_id, len(a) AS pl, len(b) AS rl, CAST({lcs_sql('a', 'b')} AS BIGINT) AS lib_lcs FROM t)
SELECT conv_id, lib_lcs, {f1_sql('lib_lcs', 'pl', 'rl')} AS lib_rouge_l FROM l"""
SQL["rouge_l_lib"] = LCS_LIB


def bleu_tok(x: str) -> str:
    s = x
    for old, new in (("'<skipped>'", "''"), ("'-' || chr(10)", "''"), ("chr(10)", "' '"),
                     ("'&quot;'", "'\"'"), ("'&amp;'", "'&'"), ("'&lt;'", "'<'"), ("'&gt;'", "'>'")):
        s = f"replace({s}, {old}, {new})"
    s = f"(' ' || {s} || ' ')"
    for pat, rep in ((r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", r" \1 "), (r"([^0-9])([\.,])", r"\1 \2 "),
                     (r"([\.,])([^0-9])", r" \1 \2"), (r"([0-9])(-)", r"\1 \2 ")):
        s = f"regexp_replace({s}, '{pat}', '{rep}', 'g')"
    return f"regexp_extract_all({s}, {WS})"


BLEU_TOKENS = f"SELECT conv_id, {bleu_tok('prediction')} AS pt, {bleu_tok('reference')} AS rt FROM ({EVAL})"

_prec = ", ".join(f"CASE WHEN possible_{n} > 0 THEN matches_{n} / possible_{n} ELSE 0.0 END AS precision_{n}" for n in range(1, 5))
BLEU = f"""
WITH o AS ({overlap_sql(BLEU_TOKENS, (1, 2, 3, 4))}),
     s AS (SELECT CAST(sum(pred_len) AS BIGINT) AS translation_length, CAST(sum(ref_len) AS BIGINT) AS reference_length,
                  {', '.join(f'CAST(sum(overlap_{n}) AS BIGINT) AS matches_{n}' for n in range(1, 5))},
                  {', '.join(f'CAST(sum(pred_{n}grams) AS BIGINT) AS possible_{n}' for n in range(1, 5))} FROM o),
     p AS (SELECT *, {_prec}, translation_length / reference_length AS ratio FROM s)
SELECT *, CASE WHEN ratio > 1.0 THEN 1.0 ELSE exp(1.0 - 1.0 / ratio) END AS brevity_penalty,
       CASE WHEN least(precision_1, precision_2, precision_3, precision_4) > 0
            THEN exp((ln(precision_1) + ln(precision_2) + ln(precision_3) + ln(precision_4)) / 4.0) ELSE 0.0 END
       * CASE WHEN ratio > 1.0 THEN 1.0 ELSE exp(1.0 - 1.0 / ratio) END AS bleu
FROM p"""
SQL["bleu_corpus"] = BLEU

SQL["evaluation_summary"] = f"""
WITH r1 AS (SELECT avg(rouge1) AS r1 FROM ({rouge_n_sql(1)})),
     r2 AS (SELECT avg(rouge2) AS r2 FROM ({rouge_n_sql(2)})),
     rl AS (SELECT avg(lib_rouge_l) AS rl FROM ({LCS_LIB})),
     b AS (SELECT bleu FROM ({BLEU})),
     pp AS (SELECT perplexity FROM ({SQL['perplexity_by_run'].replace('GROUP BY run', '').replace('SELECT run, sum', 'SELECT sum').replace('SELECT run, CAST(steps', 'SELECT CAST(steps')}))
SELECT round(r1 * 100.0, 4) AS rouge1, round(r2 * 100.0, 4) AS rouge2, round(rl * 100.0, 4) AS rougeL,
       round(bleu * 100.0, 4) AS bleu, round(perplexity, 4) AS perplexity
FROM r1, r2, rl, b, pp"""

# -- paired tests --------------------------------------------------------------

VARIANTS = f"""
SELECT run AS group_id, CAST((step + 1) // 2 AS BIGINT) AS sample_id,
       CASE WHEN step % 2 = 1 THEN 'base' ELSE 'fused' END AS variant, loss AS score
FROM ({LOSS_LOG})"""

PAIRED = f"""
SELECT group_id, sample_id, max(score) FILTER (WHERE variant = 'base') AS base,
       max(score) FILTER (WHERE variant = 'fused') AS fused
FROM ({VARIANTS}) GROUP BY group_id, sample_id
HAVING max(score) FILTER (WHERE variant = 'base') IS NOT NULL AND max(score) FILTER (WHERE variant = 'fused') IS NOT NULL"""

SQL["paired_scores"] = f"""
WITH v AS ({VARIANTS})
SELECT b.group_id, b.sample_id, b.score AS base, f.score AS fused, f.score - b.score AS delta
FROM v b JOIN v f ON b.group_id = f.group_id AND b.sample_id = f.sample_id
WHERE b.variant = 'base' AND f.variant = 'fused'"""

SQL["unmatched_pairs"] = f"""
WITH v AS ({VARIANTS}), b AS (SELECT * FROM v WHERE variant = 'base'), f AS (SELECT * FROM v WHERE variant = 'fused'),
     j AS (SELECT coalesce(b.group_id, f.group_id) AS group_id, b.sample_id IS NOT NULL AS hb, f.sample_id IS NOT NULL AS hf
           FROM b FULL OUTER JOIN f ON b.group_id = f.group_id AND b.sample_id = f.sample_id)
SELECT group_id, CAST(count(*) FILTER (WHERE hb) AS BIGINT) AS n_base, CAST(count(*) FILTER (WHERE hf) AS BIGINT) AS n_fused,
       CAST(count(*) FILTER (WHERE hb AND NOT hf) AS BIGINT) AS unmatched_base,
       CAST(count(*) FILTER (WHERE hf AND NOT hb) AS BIGINT) AS unmatched_fused
FROM j GROUP BY group_id"""

SQL["model_comparison"] = f"""
SELECT group_id,
       CAST(count(score) FILTER (WHERE variant = 'base') AS BIGINT) AS base_n, avg(score) FILTER (WHERE variant = 'base') AS base_mean,
       min(score) FILTER (WHERE variant = 'base') AS base_min, max(score) FILTER (WHERE variant = 'base') AS base_max,
       CAST(count(score) FILTER (WHERE variant = 'fused') AS BIGINT) AS fused_n, avg(score) FILTER (WHERE variant = 'fused') AS fused_mean,
       min(score) FILTER (WHERE variant = 'fused') AS fused_min, max(score) FILTER (WHERE variant = 'fused') AS fused_max
FROM ({VARIANTS}) GROUP BY group_id"""

SUMMARY = f"""
SELECT group_id, CAST(count(*) AS BIGINT) AS n, avg(base) AS base_mean, avg(fused) AS fused_mean,
       avg(fused - base) AS dm, stddev_samp(fused - base) AS sd
FROM ({PAIRED}) GROUP BY group_id"""

SQL["paired_means"] = f"SELECT group_id, n, base_mean, fused_mean, fused_mean - base_mean AS mean_delta FROM ({SUMMARY})"
SQL["paired_t"] = f"""
SELECT group_id, n, CASE WHEN n < 2 THEN NULL
                         WHEN sd = 0 THEN CASE WHEN dm = 0 THEN 'nan'::DOUBLE WHEN dm > 0 THEN 'inf'::DOUBLE ELSE '-inf'::DOUBLE END
                         ELSE dm / (sd / sqrt(n)) END AS t_statistic
FROM ({SUMMARY})"""
SQL["cohens_d"] = f"SELECT group_id, CASE WHEN sd > 0 THEN dm / sd ELSE 0.0 END AS cohens_d FROM ({SUMMARY})"

SQL["wilcoxon_signed_rank"] = f"""
WITH d AS (SELECT group_id, fused - base AS d FROM ({PAIRED}) WHERE fused - base <> 0),
     t AS (SELECT group_id, abs(d) AS a, count(*) AS t, count(*) FILTER (WHERE d > 0) AS pos FROM d GROUP BY ALL),
     r AS (SELECT *, sum(t) OVER (PARTITION BY group_id ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - (t - 1) / 2.0 AS rk FROM t),
     s AS (SELECT group_id, CAST(sum(t) AS BIGINT) AS n_nonzero, sum(pos * rk)::DOUBLE AS r_plus, sum((t - pos) * rk)::DOUBLE AS r_minus,
                  CAST(sum(t * t * t - t) AS DOUBLE) AS tie_term FROM r GROUP BY group_id)
SELECT group_id, n_nonzero, r_plus, r_minus, least(r_plus, r_minus) AS w_statistic, tie_term FROM s"""

SQL["metric_improvement"] = f"""
WITH g AS (SELECT group_id, avg(base) AS base_mean, avg(fused) AS fused_mean FROM ({PAIRED}) GROUP BY group_id)
SELECT group_id, base_mean, fused_mean, fused_mean - base_mean AS abs_improvement,
       CASE WHEN base_mean <> 0 THEN (fused_mean - base_mean) / base_mean * 100.0 END AS pct_improvement
FROM g"""

SQL["delta_histogram"] = histogram_sql(f"SELECT fused - base AS v FROM ({PAIRED})", 15)

SQL["score_boxplot"] = f"""
WITH l AS (SELECT 'base' AS variant, base AS score FROM ({PAIRED}) UNION ALL SELECT 'fused', fused FROM ({PAIRED})),
     q AS (SELECT variant, quantile_cont(score, 0.25) AS q1, quantile_cont(score, 0.5) AS median,
                  quantile_cont(score, 0.75) AS q3 FROM l GROUP BY variant),
     j AS (SELECT l.variant, l.score, q.q1, q.median, q.q3, q.q3 - q.q1 AS iqr FROM l JOIN q ON l.variant = q.variant)
SELECT variant, q1, median, q3, iqr,
       min(score) FILTER (WHERE score >= q1 - 1.5 * iqr AND score <= q3 + 1.5 * iqr) AS whisker_lo,
       max(score) FILTER (WHERE score >= q1 - 1.5 * iqr AND score <= q3 + 1.5 * iqr) AS whisker_hi,
       CAST(count(*) FILTER (WHERE NOT (score >= q1 - 1.5 * iqr AND score <= q3 + 1.5 * iqr)) AS BIGINT) AS n_outliers
FROM j GROUP BY ALL"""

# -- model application ---------------------------------------------------------


def _rule(i: str, j: str, a: int, b: int, m: int, shift: int, scale: float) -> str:
    return f"((({a} * {i} + {b} * {j}) % {m}) - {shift}) / {scale}"


PROJ = f"""
WITH m AS (SELECT list_transform(range(64), lambda i: list_transform(range(64), lambda j:
                    {_rule('i', 'j', 7, 3, 11, 5, 50.0)} + 2.0 * list_sum(list_transform(range(8), lambda k:
                    {_rule('i', 'k', 3, 7, 9, 4, 30.0)} * {_rule('k', 'j', 5, 11, 13, 6, 40.0)})))) AS fw,
                  list_transform(range(64), lambda i: list_transform(range(64), lambda j: {_rule('i', 'j', 7, 3, 11, 5, 50.0)})) AS w,
                  list_transform(range(8), lambda k: list_transform(range(64), lambda j: {_rule('k', 'j', 5, 11, 13, 6, 40.0)})) AS a,
                  list_transform(range(64), lambda i: list_transform(range(8), lambda k: {_rule('i', 'k', 3, 7, 9, 4, 30.0)})) AS b),
     x AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
     ax AS (SELECT vec_id, x, list_transform(m.a, lambda row: list_dot_product(row, x)) AS ax, m.fw, m.w, m.b FROM x, m)
SELECT vec_id,
       list_transform(fw, lambda row: list_dot_product(row, x)) AS fused,
       list_transform(range(64), lambda i: list_dot_product(w[i + 1], x) + 2.0 * list_dot_product(b[i + 1], ax)) AS two_step
FROM ax"""

SQL["low_rank_projection"] = f"""
SELECT vec_id, CAST(i - 1 AS BIGINT) AS i, round(fused[i], 6) AS fused, round(two_step[i], 6) AS two_step
FROM ({PROJ}), range(1, 65) r(i)"""

SQL["projection_parity"] = f"""
SELECT vec_id, round(list_max(list_transform(range(1, 65), lambda i: abs(fused[i] - two_step[i]))), 6) AS max_abs_diff,
       list_max(list_transform(range(1, 65), lambda i: abs(fused[i] - two_step[i]))) < 1e-4 AS parity_ok
FROM ({PROJ})"""

SQL["memory_peak"] = """
WITH m AS (SELECT user_id % 4 AS device, value AS allocated,
                  value + CAST(json_extract_string(props, '$.k') AS DOUBLE) AS reserved FROM events),
     r AS (SELECT device, round(allocated, 3) AS allocated_gb, round(reserved, 3) AS reserved_gb FROM m)
SELECT device, CAST(count(*) AS BIGINT) AS samples, max(allocated_gb) AS peak_allocated_gb,
       max(reserved_gb) AS peak_reserved_gb,
       max(round((reserved_gb - allocated_gb) / (reserved_gb + 1e-6) * 100.0, 2)) AS max_fragmentation_pct
FROM r GROUP BY device"""


# Streams: the SQL of their batch twins.
SQL["stream_turns"] = SQL["read_pairs_source"]
SQL["stream_instructions"] = f"""
SELECT t.conv_id, formatted_prompt, formatted_response, prompt_tokens, response_tokens, total_tokens
FROM ({SQL["chat_template"]}) t JOIN ({LENGTHS}) l ON t.conv_id = l.conv_id"""

SQL["fold_turns"] = SQL["stream_fold_turns"] = """
WITH t AS (SELECT *, 1700000000 + conv_id * 86400 + turn * 60 + (turn // 8) * 1800 AS ts FROM conversations),
     s AS (SELECT *, coalesce(ts - lag(ts) OVER (PARTITION BY conv_id ORDER BY ts) >= 600, true) AS opens
           FROM t WHERE ts IS NOT NULL),
     n AS (SELECT *, sum(CAST(opens AS INT)) OVER (PARTITION BY conv_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS session FROM s)
SELECT conv_id, min(ts) AS session_start, max(ts) + 600 AS session_end, count(*) AS turns,
       arg_max(text, turn) FILTER (WHERE role = 'user') AS prompt,
       arg_max(text, turn) FILTER (WHERE role = 'assistant') AS response
FROM n GROUP BY conv_id, session"""

SQL["buffer_shuffle"] = SQL["stream_buffer_shuffle"] = """
WITH d AS (SELECT doc_id, md5('42:' || doc_id) AS shuffle_key FROM documents),
     s AS (SELECT *, CAST('0x' || substr(shuffle_key, 1, 8) AS BIGINT) % 64 AS slot FROM d),
     p AS (SELECT doc_id, shuffle_key, lead(doc_id) OVER (PARTITION BY slot ORDER BY doc_id) AS pushed_by FROM s)
SELECT doc_id, pushed_by, shuffle_key,
       row_number() OVER (ORDER BY pushed_by NULLS LAST, shuffle_key) - 1 AS position
FROM p"""

SQL["stream_checkpoints"] = f"""
SELECT run, step, is_best, best_metric_value, lag(step, 3) OVER (PARTITION BY run ORDER BY step) AS purged_step
FROM ({CKPT_BEST})"""
SQL["stream_retention"] = f"SELECT run, step, kept, best_copy, action FROM ({SQL['checkpoint_retention']})"
SQL["stream_perplexity"] = SQL["perplexity_by_run"]
SQL["stream_metric_targets"] = f"""
SELECT run, step, key, value, target
FROM ({SQL["metric_log_long"]}), (VALUES ('parquet'), ('json')) AS t(target) WHERE key <> 'train/ppl'"""

# p-values: the incomplete beta and the error function by Simpson's rule, the signed-rank distribution by a fold.
SIMPSON = "list_sum(list_transform(range(0, 801), lambda i: (CASE WHEN i IN (0, 800) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * {f})) * {h} / 3.0"
T_P = ("1.0 - 2.0 * exp(lgamma((n - 1 + 1) / 2.0) - lgamma((n - 1) / 2.0)) / sqrt(pi()) * "
       + SIMPSON.format(f="pow(cos(i * atan(abs(t) / sqrt(n - 1)) / 800.0), n - 2)", h="(atan(abs(t) / sqrt(n - 1)) / 800.0)"))
Z_P = "1.0 - 2.0 / sqrt(pi()) * " + SIMPSON.format(f="exp(-pow(i * abs(z) / sqrt(2.0) / 800.0, 2))", h="(abs(z) / sqrt(2.0) / 800.0)")

SQL["significance_report"] = f"""
WITH RECURSIVE dist(k, counts) AS (
  SELECT 0, [1.0::DOUBLE]
  UNION ALL
  SELECT k + 1, list_transform(range(0, len(counts) + k + 1), lambda s:
           coalesce(counts[s + 1], 0.0) + CASE WHEN s >= k + 1 THEN coalesce(counts[s - k], 0.0) ELSE 0.0 END)
  FROM dist WHERE k < 50),
m AS (SELECT * FROM ({SUMMARY})),
z AS (SELECT group_id, count(*) FILTER (WHERE fused = base) AS n_zero FROM ({PAIRED}) GROUP BY group_id),
w AS (SELECT *, (n_nonzero * (n_nonzero + 1) / 4.0 - w_statistic) /
             sqrt(n_nonzero * (n_nonzero + 1) * (2 * n_nonzero + 1) / 24.0 - tie_term / 48.0) AS z
      FROM ({SQL["wilcoxon_signed_rank"]})),
j AS (SELECT m.*, z.n_zero, w.n_nonzero, w.w_statistic, w.tie_term, w.z, p.t_statistic AS t,
             w.n_nonzero + z.n_zero <= 50 AND z.n_zero = 0 AND w.tie_term = 0 AS exact
      FROM m JOIN z ON m.group_id = z.group_id LEFT JOIN w ON m.group_id = w.group_id
      JOIN ({SQL["paired_t"]}) p ON m.group_id = p.group_id),
r AS (SELECT j.*, CASE WHEN n < 2 THEN NULL WHEN isinf(t) THEN 0.0 WHEN isnan(t) THEN 'nan'::DOUBLE ELSE {T_P} END AS tp,
             CASE WHEN n_nonzero IS NULL THEN 1.0
                  WHEN exact THEN least(1.0, 2.0 * list_sum(counts[1:CAST(floor(w_statistic) AS BIGINT) + 1]) / pow(2, n_nonzero))
                  ELSE {Z_P} END AS wp
      FROM j LEFT JOIN dist ON dist.k = j.n_nonzero)
SELECT group_id, n, CASE WHEN n < 2 THEN 'too_few' ELSE 'ok' END AS status,
       round(t, 6) AS t_statistic, round(tp, 6) AS t_test_p_value,
       round(coalesce(w_statistic, 0.0), 6) AS wilcoxon_statistic, round(wp, 6) AS wilcoxon_p_value,
       CASE WHEN n_nonzero IS NULL THEN 'none' WHEN exact THEN 'exact' ELSE 'approx' END AS wilcoxon_method,
       round(CASE WHEN sd > 0 THEN dm / sd ELSE 0.0 END, 6) AS cohens_d, 0.01::DOUBLE AS alpha_threshold,
       coalesce(NOT isnan(tp) AND tp < 0.01 AND fused_mean - base_mean > 0, false) AS is_statistically_significant
FROM r"""

# Exact distribution with ties: one convolution for each value, by its doubled mid-rank.
SQL["significance_report_ties"] = f"""
WITH RECURSIVE p AS (SELECT group_id, sample_id, floor(base) AS base, floor(fused) AS fused FROM ({PAIRED})),
d AS (SELECT group_id, fused - base AS d FROM p WHERE fused <> base),
v AS (SELECT group_id, d, row_number() OVER (PARTITION BY group_id ORDER BY abs(d)) AS i,
             2 * rank() OVER (PARTITION BY group_id ORDER BY abs(d)) + count(*) OVER (PARTITION BY group_id, abs(d)) - 1 AS doubled,
             count(*) OVER (PARTITION BY group_id) AS nz FROM d),
s AS (SELECT group_id, max(nz) AS nz, sum(doubled) FILTER (WHERE d > 0) AS plus, sum(doubled) FILTER (WHERE d < 0) AS minus,
             sum(doubled) AS total FROM v GROUP BY group_id),
t AS (SELECT group_id, sum(c * c * c - c) AS tie_term FROM (SELECT group_id, count(*) AS c FROM d GROUP BY group_id, abs(d)) GROUP BY group_id),
fold(group_id, i, counts) AS (
  SELECT group_id, 0::BIGINT, [1.0::DOUBLE] FROM s WHERE nz <= 50
  UNION ALL
  SELECT f.group_id, f.i + 1, list_transform(range(0, len(counts) + v.doubled), lambda x:
           coalesce(counts[x + 1], 0.0) + CASE WHEN x >= v.doubled THEN coalesce(counts[x - v.doubled + 1], 0.0) ELSE 0.0 END)
  FROM fold f JOIN v ON v.group_id = f.group_id AND v.i = f.i + 1),
e AS (SELECT s.*, least(coalesce(plus, 0), coalesce(minus, 0)) AS doubled_w, counts, tie_term,
             (nz * (nz + 1) / 4.0 - least(coalesce(plus, 0), coalesce(minus, 0)) / 2.0) /
             sqrt(nz * (nz + 1) * (2 * nz + 1) / 24.0 - tie_term / 48.0) AS z
      FROM s JOIN t ON s.group_id = t.group_id LEFT JOIN fold f ON f.group_id = s.group_id AND f.i = s.nz),
g AS (SELECT group_id, count(*) AS n FROM p GROUP BY group_id)
SELECT g.group_id, g.n, round(coalesce(doubled_w / 2.0, 0.0), 6) AS wilcoxon_statistic,
       round(CASE WHEN nz IS NULL THEN 1.0 WHEN nz <= 50 THEN least(1.0, 2.0 * list_sum(counts[1:CAST(doubled_w AS BIGINT) + 1]) / pow(2, nz))
                  ELSE {Z_P} END, 6) AS wilcoxon_p_value,
       CASE WHEN nz IS NULL THEN 'none' WHEN nz <= 50 THEN 'exact' ELSE 'approx' END AS wilcoxon_method
FROM g LEFT JOIN e ON g.group_id = e.group_id"""

SQL["custom_tokenizer_lengths"] = r"""
SELECT doc_id, CAST(len(regexp_extract_all(text, '[\p{L}\p{N}\p{M}_]+|[^\p{L}\p{N}\p{M}_\s\p{Z}]')) AS BIGINT) AS n_tokens FROM documents"""

SQL["score_with_callable"] = f"""
WITH e AS (SELECT conv_id, regexp_extract_all(reference, {WS}) AS pw, regexp_extract_all(prediction, {WS}) AS rw FROM ({EVAL}))
SELECT conv_id, array_to_string(pw, ' ') AS prediction,
       CASE WHEN len(rw) = 0 THEN 0.0 ELSE ln(1.0 + len(list_filter(rw, lambda x: NOT list_contains(pw, x))) / len(rw)) END AS loss,
       CAST(len(rw) AS BIGINT) AS num_tokens
FROM e"""

POISSON = " + ".join(f"CAST(h >= {int(sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) * 2 ** 32)} AS INT)" for k in range(9))
SQL["rouge_bootstrap"] = f"""
WITH s AS (SELECT a.conv_id, rouge1, rouge2, lib_rouge_l AS "rougeL" FROM ({SQL["rouge_1"]}) a
           JOIN ({SQL["rouge_2"]}) b ON a.conv_id = b.conv_id JOIN ({SQL["rouge_l_lib"]}) c ON a.conv_id = c.conv_id),
     h AS (SELECT *, CAST('0x' || substr(md5('42:' || conv_id || ':' || (r // 4)), 1 + 8 * (r % 4), 8) AS BIGINT) AS h
           FROM s, (SELECT unnest(range(0, 200)) AS r)),
     w AS (SELECT *, {POISSON} AS w FROM h),
     m AS (SELECT 'rouge1' AS metric, r, sum(w * rouge1) / sum(w) AS mean FROM w WHERE w > 0 GROUP BY r
           UNION ALL SELECT 'rouge2', r, sum(w * rouge2) / sum(w) FROM w WHERE w > 0 GROUP BY r
           UNION ALL SELECT 'rougeL', r, sum(w * "rougeL") / sum(w) FROM w WHERE w > 0 GROUP BY r)
SELECT metric, round(quantile_cont(mean, 0.025) * 100.0, 4) AS low, round(quantile_cont(mean, 0.5) * 100.0, 4) AS mid,
       round(quantile_cont(mean, 0.975) * 100.0, 4) AS high
FROM m GROUP BY metric"""

SQL["merged_quantiles"] = """
SELECT lang, q, n, true AS within_bound FROM (SELECT lang, count(text) AS n FROM documents GROUP BY lang),
       (VALUES (0.5::DOUBLE), (0.9), (0.95), (0.99)) AS t(q) WHERE n > 0"""

SQL["checkpoint_folders"] = f"""
WITH k AS (SELECT run, step FROM ({SQL["checkpoint_retention"]}) WHERE kept OR best_copy),
     e AS (SELECT user_id AS run, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step FROM events)
SELECT CAST(e.event_id AS BIGINT) AS step, e.step AS epoch, b.metric AS eval_loss, b.is_best, b.best_metric_value,
       CAST(e.run AS VARCHAR) AS run
FROM k JOIN e ON k.run = e.run AND k.step = e.step JOIN ({CKPT_BEST}) b ON b.run = e.run AND b.step = e.step"""


def _evaluated(name: str, words: int) -> str:
    """The metrics of a model that repeats the first words of the prompt."""
    said = f"""SELECT conv_id, array_to_string(regexp_extract_all(prompt, {WS})[1:{words}], ' ') AS prediction,
                      response AS reference FROM ({PAIRS})"""
    r1, r2, rl, bleu = (SQL[q].replace(EVAL, said) for q in ("rouge_1", "rouge_2", "rouge_l_lib", "bleu_corpus"))
    return f"""
SELECT '{name}' AS variant, round((SELECT avg(rouge1) FROM ({r1})) * 100.0, 4) AS rouge1,
       round((SELECT avg(rouge2) FROM ({r2})) * 100.0, 4) AS rouge2,
       round((SELECT avg(lib_rouge_l) FROM ({rl})) * 100.0, 4) AS "rougeL",
       round((SELECT bleu FROM ({bleu})) * 100.0, 4) AS bleu,
       round((SELECT CASE WHEN sum(loss * num_tokens) / sum(num_tokens) <= 0 THEN 1.0
                          ELSE exp(least(sum(loss * num_tokens) / sum(num_tokens), 100.0)) END
              FROM ({SQL["score_with_callable"].replace(EVAL, f"SELECT conv_id, response AS prediction, prompt AS reference FROM ({PAIRS})")})), 4) AS perplexity"""


SQL["model_evaluation"] = " UNION ALL ".join(_evaluated(n, w) for n, w in (("base", 4), ("fused", 12)))
