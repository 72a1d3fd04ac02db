"""The same queries in SQL, written for DuckDB over views of the tables."""

from __future__ import annotations

# Fixed values, as in functions.text.
SPACE = r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
SCRIPT = r"[\x{0600}-\x{06FF}\x{0750}-\x{077F}\x{FB50}-\x{FDFF}\x{FE70}-\x{FEFF}]"
PRETOKENS = r"[\p{L}\p{M}]+|\p{N}+|[^\s\p{L}\p{M}\p{N}]"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def _filled(column: str) -> str:
    return _strip(f"coalesce({column}, '')")


def _clean(x: str) -> str:
    x = f"coalesce({x}, '')"
    return _strip(f"regexp_replace(regexp_replace({x}, '[ \\t]+', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')")


def _count(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all({x}, '{pattern}'))"


def _ratio(x: str) -> str:
    n = _count(x, SCRIPT)
    return f"coalesce({n}::DOUBLE / nullif({n} + {_count(x, '[a-zA-Z]')}, 0), 0.0)"


def _stripped(x: str) -> str:
    gone = f"regexp_replace(regexp_replace({x}, '{SCRIPT}', '', 'g'), ' +', ' ', 'g')"
    return f"CASE WHEN {_ratio(x)} > 0.5 THEN {x} ELSE {_strip(gone)} END"


def _percent(x: str) -> str:
    return f"round_even(100 * {x}, 0)::INT::VARCHAR || '%'"


TAGGED = f"""
WITH c AS (SELECT row_id, {_clean('instruction')} AS i, {_clean('input')} AS n, {_clean('output')} AS o, coalesce(source, 'unknown') AS source FROM train),
f AS (SELECT *, i <> '' AND o <> '' AS filled, length(i) + length(n) + length(o) AS size FROM c),
k AS (SELECT *, row_number() OVER (PARTITION BY filled, lower(i) ORDER BY row_id) AS nth FROM f),
g AS (SELECT * REPLACE (CASE WHEN source IN ('urdu-instruct-roman', 'redgerd-roman') THEN {_stripped('i')} ELSE i END AS i, CASE WHEN source IN ('urdu-instruct-roman', 'redgerd-roman') THEN {_stripped('o')} ELSE o END AS o) FROM k),
r AS (SELECT *, {_ratio('i')} AS ri, {_ratio('o')} AS ro FROM g),
tagged AS (SELECT *, CASE WHEN NOT filled THEN 'empty_field' WHEN nth > 1 THEN 'duplicate' WHEN size < 20 THEN 'too_short' WHEN size > 5000 THEN 'too_long'
  WHEN source IN ('urdu-instruct-roman', 'redgerd-roman') AND (length(i) < 5 OR length(o) < 5) THEN 'roman_cleanup_empty'
  WHEN source IN ('urdu-instruct', 'aya-urdu') AND greatest(ri, ro) < 0.3 THEN 'low_urdu_ratio' END AS reason_code FROM r)
"""

CHAT = f"""
WITH f AS (SELECT row_id, coalesce(source, 'unknown') AS source,
  '<|im_start|>system' || chr(10) || 'You are a helpful assistant.<|im_end|>' || chr(10) || '<|im_start|>user' || chr(10) || coalesce(instruction, '')
  || CASE WHEN {_strip("coalesce(input, '')")} <> '' THEN chr(10) || chr(10) || input ELSE '' END || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) || coalesce(output, '') || '<|im_end|>' || chr(10) AS text FROM train),
t AS (SELECT *, {_count('text', PRETOKENS)} AS n_tokens FROM f)
"""

UNIFIED = f"""
WITH e AS (SELECT *, run_id * 1000 + id AS row_id FROM eval_results),
a AS (
  SELECT 0 AS source_rank, row_id, instruction AS i, input AS n, output AS o, coalesce(source, 'unknown') AS source FROM train
  UNION ALL SELECT 1, row_id, prompt, '', finetuned_response, 'eval-finetuned' FROM e
  UNION ALL SELECT 2, row_id, prompt, '', base_response, 'eval-base' FROM e),
u AS (SELECT source_rank, row_id, source, {_strip("coalesce(i, '')")} AS i, {_strip("coalesce(n, '')")} AS n, {_strip("coalesce(o, '')")} AS o FROM a WHERE coalesce(i, '') <> '' AND coalesce(o, '') <> '')
"""

RATES = """
WITH v AS (SELECT judge, coalesce(category, 'unknown') AS category, winner FROM verdicts),
g AS (SELECT judge, CASE WHEN grouping(category) = 1 THEN 'overall' ELSE category END AS category, count(*) FILTER (winner = 'finetuned') AS finetuned, count(*) FILTER (winner = 'base') AS base,
  count(*) FILTER (winner = 'tie') AS tie, count(*) FILTER (winner IN ('finetuned', 'base', 'tie')) AS total FROM v GROUP BY GROUPING SETS ((judge, category), (judge))),
rates AS (SELECT *, coalesce(100.0::DOUBLE * finetuned / nullif(total, 0), 0.0) AS ft_pct FROM g)
"""

BATCHED = """
WITH h AS (SELECT row_id, instruction, output, row_number() OVER (ORDER BY md5('42:' || row_id), row_id) - 1 AS pos FROM train),
b AS (SELECT *, pos // 5 AS batch FROM h WHERE pos < 1000 AND pos >= 15)
"""

EVENTS = """
WITH ev AS (SELECT user_id, event_id AS step, value AS eval_loss FROM events WHERE event_type = 'purchase'),
st AS (SELECT user_id, event_id AS step, value AS loss FROM events WHERE event_type <> 'purchase')
"""


def _ranks(value: str, names: dict[str, float]) -> str:
    """Value at zero-based rank floor(n * p), from a sorted list."""
    return ", ".join(f"list_sort(list({value}))[floor(count({value})::DOUBLE * {p})::BIGINT + 1]::BIGINT AS {n}" for n, p in names.items())


def oracle_sql() -> dict[str, str]:
    probs = {"median": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}
    from tarazu.plans import catalogue as c

    mapped = "instruction"
    single = {k: v for k, v in c.LETTERS.items() if len(v) == 1}
    mapped = f"translate({mapped}, '{''.join(single)}', '{''.join(single.values())}')"
    for k, v in c.LETTERS.items():
        if len(v) != 1:
            mapped = f"replace({mapped}, '{k}', '{v}')"
    baseline = ", ".join(f"('{k}', {v}::DOUBLE)" for k, v in c.BASELINE.items())
    new = "('code-roman-synthetic', 'urdu-instruct-roman-v2')"
    columns = lambda cs: " UNION ALL ".join(f"SELECT '{x}' AS \"column\", {x} AS v FROM train" for x in cs)
    return {
        "clean_reason_counts": TAGGED + "SELECT coalesce(reason_code, 'kept') AS reason_code, count(*) AS n_records, min(row_id) AS first_row FROM tagged GROUP BY 1",
        "clean_totals": TAGGED + "SELECT count(*) AS n_input, count(*) FILTER (reason_code IS NULL) AS n_kept, count(*) FILTER (reason_code IS NOT NULL) AS n_removed, round(100.0::DOUBLE * count(*) FILTER (reason_code IS NULL) / count(*), 6) AS kept_share FROM tagged",
        "clean_kept_rows": TAGGED + "SELECT row_id, md5(i) AS instruction, md5(n) AS input, md5(o) AS output, source FROM tagged WHERE reason_code IS NULL",
        "clean_removed_rows": TAGGED + f"SELECT row_id, reason_code, CASE WHEN reason_code = 'low_urdu_ratio' THEN 'low_urdu_ratio (instr:' || {_percent('ri')} || ', out:' || {_percent('ro')} || ')' ELSE reason_code END AS removal_reason FROM tagged WHERE reason_code IS NOT NULL",
        "clean_stats_by_source": TAGGED + "SELECT source, count(*) AS n_records, min(row_id) AS first_row, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 6) AS share FROM tagged WHERE reason_code IS NULL GROUP BY source",
        "script_ratio_rows": f"SELECT row_id, {_count('i', SCRIPT)} AS n_script, round({_ratio('i')}, 6) AS ratio FROM (SELECT row_id, coalesce(instruction, '') AS i FROM train)",
        "script_strip_rows": f"SELECT row_id, md5({_stripped('o')}) AS stripped FROM (SELECT row_id, coalesce(output, '') AS o FROM train)",
        "low_ratio_gate": f"SELECT row_id, {_percent('ri')} AS instruction_share, {_percent('ro')} AS output_share FROM (SELECT row_id, {_ratio('i')} AS ri, {_ratio('o')} AS ro FROM (SELECT row_id, coalesce(instruction, '') AS i, coalesce(output, '') AS o FROM train)) WHERE greatest(ri, ro) < 0.3",
        "ratio_histogram": f"SELECT source, count(*) FILTER (r > 0.9) AS n_high, count(*) FILTER (r BETWEEN 0.5 AND 0.9) AS n_middle, count(*) FILTER (r < 0.5) AS n_low, round(avg(r), 6) AS mean_ratio FROM (SELECT source, {_ratio('o')} AS r FROM (SELECT source, coalesce(output, '') AS o FROM train)) GROUP BY source",
        "source_union": UNIFIED + "SELECT source_rank, source, count(*) AS n_records, sum(length(i) + length(n) + length(o))::BIGINT AS n_chars, min(row_id) AS first_row FROM u GROUP BY ALL",
        "source_counts": UNIFIED + "SELECT *, repeat('█', floor(share / 2)::INT) AS bar FROM (SELECT source, count(*) AS n_records, min(row_id) AS first_row, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 6) AS share FROM u GROUP BY source)",
        "language_filter": "SELECT lang, count(*) AS n_records, contains(lower(lang), 'urdu') OR lower(lang) = 'urd' AS variant_a, contains(lower(lang), 'urdu') OR contains(lower(lang), 'urd') AS variant_b, contains(lower(lang), 'urdu') OR lang = 'urd' AS variant_c FROM train WHERE lang IS NOT NULL GROUP BY lang",
        "urdu_documents": "SELECT lang, count(*) AS n_records FROM documents WHERE contains(lower(lang), 'urdu') OR lower(lang) = 'urd' GROUP BY lang",
        "chat_format": CHAT + "SELECT row_id, source, md5(text) AS text, n_tokens FROM t WHERE n_tokens <= 2048",
        "format_statistics": CHAT + "SELECT count(*) AS n_input, count(*) FILTER (n_tokens <= 100) AS n_output, count(*) FILTER (n_tokens > 100) AS n_too_long FROM t",
        "token_length_profile": CHAT + f"SELECT source, count(*) AS n, min(n_tokens) AS min, max(n_tokens) AS max, (sum(n_tokens) // count(*))::BIGINT AS mean, {_ranks('n_tokens', probs)} FROM t GROUP BY source",
        "length_profile_columns": f"SELECT \"column\", count(*) AS n, min(l) AS min, max(l) AS max, (sum(l) // count(*))::BIGINT AS mean, {_ranks('l', {'median': 0.5})}, count(*) FILTER (l = 0) AS n_empty, count(*) FILTER (l < 20) AS n_short, count(*) FILTER (l > 5000) AS n_long FROM (SELECT \"column\", length(coalesce(v, '')) AS l FROM ({columns(['instruction', 'input', 'output'])})) GROUP BY 1",
        "duplicate_profile": f"SELECT \"column\", count(v) AS n_values, count(DISTINCT v) AS n_distinct, count(v) - count(DISTINCT v) AS n_duplicates, round(100.0::DOUBLE * (count(v) - count(DISTINCT v)) / count(v), 6) AS duplicate_share FROM ({columns(['instruction', 'input', 'output', 'source'])}) GROUP BY 1",
        "low_cardinality_values": f"WITH a AS ({columns(['source', 'category', 'lang', 'instruction'])}), n AS (SELECT \"column\", v AS value, count(*) AS n_records FROM a WHERE v IS NOT NULL GROUP BY ALL) SELECT * FROM n WHERE \"column\" IN (SELECT \"column\" FROM n GROUP BY 1 HAVING count(*) < 50)",
        "top_languages": "SELECT lang, count(*) AS n_records FROM train WHERE lang IS NOT NULL GROUP BY lang ORDER BY n_records DESC, lang LIMIT 20",
        "has_input_share": f"SELECT source, count(*) AS n_records, count(*) FILTER (x <> '') AS n_with_input, round(100.0::DOUBLE * count(*) FILTER (x <> '') / count(*), 6) AS input_share FROM (SELECT source, {_filled('input')} AS x FROM train) GROUP BY source",
        "dataset_comparison": "SELECT 'train' AS dataset, count(*) AS n_records, (sum(length(coalesce(instruction, ''))) // count(*))::BIGINT AS mean_instruction, (sum(length(coalesce(output, ''))) // count(*))::BIGINT AS mean_output FROM train UNION ALL SELECT 'documents', count(*), 0, (sum(length(coalesce(text, ''))) // count(*))::BIGINT FROM documents UNION ALL SELECT 'prompts', count(*), (sum(length(coalesce(prompt, ''))) // count(*))::BIGINT, 0 FROM prompts",
        "combine_new": f"WITH a AS (SELECT 'original' AS origin, source FROM train WHERE coalesce(source, '') NOT IN {new} UNION ALL SELECT source, source FROM train WHERE source IN {new} AND {_filled('instruction')} <> '' AND {_filled('output')} <> '' AND length(coalesce(instruction, '')) + length(coalesce(output, '')) BETWEEN 20 AND 5000) SELECT origin, source, count(*) AS n_records FROM a GROUP BY ALL",
        "seeded_sample": "SELECT row_id FROM train ORDER BY md5('42:' || row_id), row_id LIMIT 500",
        "disjoint_second_sample": "SELECT row_id FROM train WHERE row_id NOT IN (SELECT row_id FROM train ORDER BY md5('42:' || row_id), row_id LIMIT 500) ORDER BY md5('123:' || row_id), row_id LIMIT 500",
        "gathered_rows": "SELECT row_id, source, length(coalesce(instruction, '')) + length(coalesce(output, '')) AS n_chars FROM train WHERE row_id IN (SELECT row_id FROM train ORDER BY md5('7:' || row_id), row_id LIMIT 100)",
        "shuffle_positions": "SELECT row_id, row_number() OVER (ORDER BY md5('42:' || row_id), row_id) - 1 AS pos FROM train",
        "train_val_split": "SELECT row_id, CASE WHEN row_number() OVER (ORDER BY md5('42:' || row_id), row_id) <= ceil(count(*) OVER () * 0.05) THEN 'val' ELSE 'train' END AS part FROM train",
        "batch_pack": BATCHED + "SELECT batch, count(*) AS n_rows, string_agg(row_id, ',' ORDER BY pos) AS rows FROM b GROUP BY batch",
        "batch_requests": BATCHED + "SELECT batch, count(*) AS n_rows, (count(*) * (count(*) - 1) // 2)::BIGINT AS id_sum, md5(string_agg(coalesce(instruction, ''), '|' ORDER BY pos)) AS instructions FROM b GROUP BY batch",
        "topic_cycle": "WITH p AS (SELECT b AS batch, (11 + b * 7) % (SELECT count(*) FROM topics) AS start FROM range(200) r(b)), s AS (SELECT batch, topic_id - 1 AS pos, topic FROM p JOIN topics ON topic_id - 1 BETWEEN start AND start + 6), n AS (SELECT *, row_number() OVER (PARTITION BY batch ORDER BY pos) AS k FROM s) SELECT batch, count(*) AS n_topics, string_agg(k || '. ' || topic, chr(10) ORDER BY pos) AS list FROM n GROUP BY batch",
        "running_budget": "SELECT user_id, count(*) AS n_written, round(max(spent), 6) AS spent FROM (SELECT *, sum(value) OVER (PARTITION BY user_id ORDER BY event_id) AS spent FROM events) WHERE spent < 100 GROUP BY user_id",
        "failure_breaker": "WITH a AS (SELECT *, count(*) FILTER (event_type IN ('error', 'signup')) OVER (PARTITION BY user_id ORDER BY event_id) AS failures FROM events), b AS (SELECT *, min(CASE WHEN event_type = 'error' AND failures > 10 THEN event_id END) OVER (PARTITION BY user_id) AS stop FROM a) SELECT user_id, count(*) AS n_done, max(failures) AS failures FROM b WHERE stop IS NULL OR event_id <= stop GROUP BY user_id",
        "response_parse": "SELECT event_id, CASE WHEN event_id % 7 IN (4, 6) THEN NULL ELSE k END AS any_form, CASE WHEN event_id % 7 IN (0, 1) THEN k END AS list_only FROM (SELECT event_id, props->>'$.k' AS k FROM events)",
        "positional_match": "WITH b AS (SELECT row_id, (row_id - 1) // 5 AS batch FROM train), p AS (SELECT *, row_number() OVER (PARTITION BY batch ORDER BY row_id) - 1 AS nth FROM b) SELECT row_id, batch, 'r' || nth AS output FROM p WHERE nth < batch % 8",
        "progress_marks": "SELECT job_id, count(*) AS n_marks, max(done)::BIGINT AS furthest FROM (SELECT DISTINCT job_id, done FROM progress) WHERE (done + 1) % 20 = 0 OR done = 0 GROUP BY job_id",
        "job_states": "WITH p AS (SELECT *, row_number() OVER (PARTITION BY job_id, job ORDER BY done DESC, saved_at DESC, coalesce(total_output_tokens, 0) DESC) AS k, count(*) OVER (PARTITION BY job_id, job) AS n_states FROM progress) SELECT job_id, job, done::BIGINT AS done, coalesce(total_output_tokens, 0)::BIGINT AS total_output_tokens, n_states FROM p WHERE k = 1",
        "log_merge": "WITH p AS (SELECT *, row_number() OVER (PARTITION BY job_id, done ORDER BY saved_at NULLS FIRST, coalesce(total_output_tokens, -1)) AS k FROM progress) SELECT job_id, done::BIGINT AS done, total_output_tokens FROM p WHERE k = 1",
        "eval_asof_trend": EVENTS + "SELECT ev.user_id, ev.step, eval_loss, st.loss AS loss_asof, CASE WHEN lag(eval_loss) OVER w IS NULL THEN '' WHEN eval_loss > lag(eval_loss) OVER w + 0.01 THEN '<< EVAL RISING' WHEN eval_loss < lag(eval_loss) OVER w THEN 'improving' ELSE 'plateau' END AS trend FROM ev ASOF LEFT JOIN st ON ev.user_id = st.user_id AND ev.step >= st.step WINDOW w AS (PARTITION BY ev.user_id ORDER BY ev.step)",
        "ema_loss": "WITH RECURSIVE s AS (SELECT user_id, event_id AS step, value AS loss, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM events WHERE event_type <> 'purchase'), e AS (SELECT user_id, step, loss, k, loss AS ema FROM s WHERE k = 1 AND n > 50 UNION ALL SELECT s.user_id, s.step, s.loss, s.k, e.ema + 2.0::DOUBLE / 51 * (s.loss - e.ema) FROM e JOIN s ON s.user_id = e.user_id AND s.k = e.k + 1) SELECT user_id, step, loss, round(ema, 6) AS ema FROM e",
        "best_and_overfit": EVENTS + "SELECT user_id, arg_min(step, {'l': eval_loss, 's': step}) AS best_step, min(eval_loss) AS best_loss, arg_max(eval_loss, step) AS last_loss, max(step) AS last_step, arg_max(eval_loss, step) > min(eval_loss) + 0.02 AS overfit FROM ev GROUP BY user_id",
        "epoch_boundaries": EVENTS + "SELECT user_id, k AS epoch, round(k * max(step)::DOUBLE / 3, 6) AS boundary FROM st, range(1, 4) r(k) GROUP BY user_id, k",
        "log_kinds": "SELECT CASE WHEN event_type = 'purchase' AND value IS NOT NULL THEN 'eval' WHEN event_type <> 'error' AND value IS NOT NULL THEN 'train' ELSE 'neither' END AS kind, count(*) AS n_entries FROM events GROUP BY 1",
        "eval_join": "WITH b AS (SELECT id, arg_max(base_response, {'r': run_id, 't': base_response}) AS x FROM eval_results WHERE base_response IS NOT NULL GROUP BY id), f AS (SELECT id, arg_max(finetuned_response, {'r': run_id, 't': finetuned_response}) AS x FROM eval_results WHERE finetuned_response IS NOT NULL GROUP BY id) SELECT p.id, p.category, md5(b.x) AS base, md5(f.x) AS finetuned FROM prompts p JOIN b ON b.id = p.id JOIN f ON f.id = p.id",
        "eval_counts": f"SELECT category, count(*) AS n_records, count(DISTINCT id) AS n_prompts, count(*) FILTER ({_filled('base_response')} = '') AS n_empty_base, count(*) FILTER ({_filled('finetuned_response')} = '') AS n_empty_finetuned FROM eval_results GROUP BY category",
        "judge_winrates": RATES + "SELECT judge, category, finetuned, base, tie, total, round(ft_pct, 6) AS ft_pct FROM rates",
        "judge_median_delta": RATES + f"SELECT r.category, count(*) AS n_judges, round(median(ft_pct), 6) AS median, round(min(ft_pct), 6) AS lowest, round(max(ft_pct), 6) AS highest, round(b.v1, 6) AS v1, round(median(ft_pct) - b.v1, 6) AS delta FROM rates r LEFT JOIN (VALUES {baseline}) b(category, v1) ON b.category = r.category GROUP BY r.category, b.v1",
        "judge_bands": RATES + "SELECT category, round(median(ft_pct), 6) AS median, CASE WHEN median(ft_pct) >= 60 THEN 'pass' WHEN median(ft_pct) >= 50 THEN 'iterate' ELSE 'regress' END AS band FROM rates WHERE judge <> 'judge-delta' GROUP BY category",
        "judge_agreement": "WITH a AS (SELECT run_id, id, count(DISTINCT judge) AS n_judges, count(DISTINCT winner) AS n_winners FROM verdicts WHERE winner IN ('finetuned', 'base', 'tie') GROUP BY ALL) SELECT n_judges, count(*) AS n_items, count(*) FILTER (n_winners = 1) AS n_agreed FROM a GROUP BY n_judges",
        "blinded_ab": "SELECT id, CASE WHEN ('0x' || substr(md5('42:' || id), 1, 1))::INT % 2 = 0 THEN 'A' ELSE 'B' END AS side FROM prompts",
        "char_map": f"SELECT row_id, md5({mapped}) AS roman FROM train WHERE instruction IS NOT NULL",
        "preview_rows": "SELECT doc_id, md5(CASE WHEN length(text) > 200 THEN substring(text, 1, 200) || '...' ELSE text END) AS preview FROM documents WHERE text IS NOT NULL",
        "event_windows": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n_events, round(sum(value), 6) AS total FROM events GROUP BY ALL",
        "low_ratio_examples": f"SELECT row_id, md5(substring(o, 1, 300) || '...') AS start, round(r, 6) AS ratio FROM (SELECT row_id, o, {_ratio('o')} AS r FROM (SELECT row_id, coalesce(output, '') AS o FROM train)) WHERE r < 0.5 ORDER BY row_id LIMIT 3",
        "steps_per_epoch": "SELECT count(*) AS n_records, ceil(count(*) * 0.05)::BIGINT AS n_held, (count(*) - ceil(count(*) * 0.05)::BIGINT) // 16 AS steps_per_epoch FROM train",
        "usage_totals": "WITH p AS (SELECT *, row_number() OVER (PARTITION BY job_id, job ORDER BY done DESC, saved_at DESC, coalesce(total_output_tokens, 0) DESC) AS k FROM progress) SELECT job, count(*) AS n_jobs, sum(done)::BIGINT AS n_done, sum(coalesce(total_input_tokens, 0))::BIGINT AS input_tokens, sum(coalesce(total_output_tokens, 0))::BIGINT AS output_tokens FROM p WHERE k = 1 GROUP BY job",
        "pair_duplicates": "WITH g AS (SELECT instruction, output, count(*) AS n FROM train WHERE instruction IS NOT NULL AND output IS NOT NULL GROUP BY ALL) SELECT n AS copies, count(*) AS n_pairs FROM g GROUP BY n",
        "judge_labels": RATES + "SELECT r.judge, coalesce(l.label, r.judge) AS label, round(ft_pct, 6) AS ft_pct FROM rates r LEFT JOIN (VALUES ('judge-alpha', 'A'), ('judge-beta', 'B')) l(judge, label) ON l.judge = r.judge WHERE category = 'overall'",
        "eval_languages": "SELECT coalesce(language, 'none') AS language, category, count(*) AS n_prompts FROM prompts GROUP BY ALL",
        "message_roles": f"WITH m AS (SELECT unnest(['system', 'user', 'assistant']) AS role, unnest([28, length(coalesce(instruction, '')) + CASE WHEN {_filled('input')} <> '' THEN 2 + length(input) ELSE 0 END, length(coalesce(output, ''))]) AS l FROM train) SELECT role, count(*) AS n_turns, sum(l)::BIGINT AS n_chars FROM m GROUP BY role",
        "document_text_columns": f"SELECT \"column\", count(*) AS n, min(l) AS min, max(l) AS max, (sum(l) // count(*))::BIGINT AS mean, {_ranks('l', {'median': 0.5})}, count(*) FILTER (l = 0) AS n_empty, count(*) FILTER (l < 50) AS n_short, count(*) FILTER (l > 3000) AS n_long FROM (SELECT \"column\", length(coalesce(v, '')) AS l FROM (SELECT 'text' AS \"column\", text AS v FROM documents UNION ALL SELECT 'lang', lang FROM documents UNION ALL SELECT 'domain', domain FROM documents UNION ALL SELECT 'source', source FROM documents)) GROUP BY 1",
        "checksum_by_source": "SELECT source, count(*) AS n_records, sum(('0x' || substr(md5(coalesce(instruction, '') || chr(31) || coalesce(input, '') || chr(31) || coalesce(output, '')), 1, 8))::BIGINT)::BIGINT AS checksum FROM train GROUP BY source",
    }
