"""DuckDB SQL twins of the catalogue queries (the correctness oracle).

Tables are the pre-registered views ``documents labels events lineitem part
benchmark conversations ...``. Each statement re-derives the same recipe as
``plans.fixtures`` in plain SQL and rounds computed doubles to 6 decimals.
"""

from __future__ import annotations

Z = "1.96::DOUBLE"


def wilson_half(k: str, n: str) -> str:
    """Half-width of the Wilson interval (percent, clamped), as SQL text."""
    n_ = f"CAST({n} AS DOUBLE)"
    p = f"(CAST({k} AS DOUBLE) / {n_})"
    zz = f"({Z} * {Z})"
    d = f"(1.0::DOUBLE + {zz} / {n_})"
    center = f"(({p} + {zz} / (2.0::DOUBLE * {n_})) / {d})"
    half = f"({Z} * sqrt({p} * (1.0::DOUBLE - {p}) / {n_} + {zz} / (4.0::DOUBLE * {n_} * {n_})) / {d})"
    lo = f"greatest(0.0::DOUBLE, ({center} - {half}) * 100.0::DOUBLE)"
    hi = f"least(100.0::DOUBLE, ({center} + {half}) * 100.0::DOUBLE)"
    return f"(({hi}) - ({lo})) / 2.0::DOUBLE"


def model(key: str) -> str:
    return f"'src' || CAST({key} % 20 AS VARCHAR)"


def run(key: str) -> str:
    """Run of the model of a numeric key: models alternate between two runs."""
    return f"'r' || CAST({key} % 2 AS VARCHAR)"


def run_of(model_id: str) -> str:
    return run(f"CAST(regexp_extract({model_id}, '(\\d+)$', 1) AS INTEGER)")


ITEMS = f"""items AS (
  SELECT {run_of('d.source')} AS run_id, d.source AS model_id, d.lang AS subject, d.doc_id,
         CAST(CASE WHEN l.quality = 1 THEN 1 ELSE 0 END AS DOUBLE) AS correct
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"""

TRY_ORDER = "(l_shipdate, l_orderkey, l_linenumber, l_suppkey, l_quantity, l_extendedprice)"


def exflags(language: str = "'python'") -> str:
    return f"""ex AS (
  SELECT {run('l_suppkey')} AS run_id, {model('l_suppkey')} AS model_id, {language} AS language,
         CAST(l_partkey AS VARCHAR) AS exercise,
         arg_min(l_returnflag = 'R', {TRY_ORDER}) AS pass_1,
         bool_or(l_returnflag = 'R') AS pass_any
  FROM lineitem GROUP BY ALL)"""


MODELS = f"""models AS (
  SELECT {run_of('model_id')} AS run_id, model_id, CAST(regexp_extract(model_id, '(\\d+)$', 1) AS INTEGER) AS ordinal
  FROM (SELECT DISTINCT source AS model_id FROM documents UNION ALL SELECT 'src20'))"""

FILES = """files AS (
  SELECT strftime(l_shipdate, '%Y') || '-01-01-00-00-00--' || 'src' || CAST(l_suppkey % 20 AS VARCHAR) AS run,
         l_linestatus AS language, CAST(l_partkey AS VARCHAR) AS exercise, max(l_shipdate) AS mtime
  FROM lineitem GROUP BY ALL)"""

CHUNKS = f"""ch AS (
  SELECT {run('user_id')} AS run_id, {model('user_id')} AS model_id,
         CAST(user_id AS VARCHAR) || '-' || strftime(CAST(ts AS DATE), '%Y-%m-%d') AS request_id,
         CAST(CAST(ts AS DATE) AS TIMESTAMP) AS t_start, ts,
         CASE WHEN event_type = 'error' THEN '' ELSE event_type END AS delta,
         event_type = 'purchase' AS is_end
  FROM events),
ends AS (SELECT run_id, model_id, request_id, min(CASE WHEN is_end THEN ts END) AS em FROM ch GROUP BY ALL),
live AS (
  SELECT c.*, e.em FROM ch c JOIN ends e USING (run_id, model_id, request_id)
  WHERE e.em IS NULL OR c.ts < e.em OR (c.ts = e.em AND NOT c.is_end)),
per0 AS (
  SELECT run_id, model_id, request_id, min(t_start) AS t_start,
         min(CASE WHEN NOT is_end AND delta IS NOT NULL AND length(delta) > 0 THEN ts END) AS t_first,
         coalesce(min(em), max(ts)) AS t_end,
         count_if(NOT is_end AND delta IS NOT NULL AND length(delta) > 0) AS n_tokens
  FROM live GROUP BY ALL
  HAVING count_if(NOT is_end AND delta IS NOT NULL AND length(delta) > 0) > 0),
per AS (
  SELECT *, date_diff('microsecond', t_start, t_first) AS ttft_us,
         date_diff('microsecond', t_start, t_first) / 1e6 * 1000.0::DOUBLE AS ttft_ms,
         n_tokens / greatest(date_diff('microsecond', t_first, t_end) / 1e6, 1e-6) AS tok_s
  FROM per0)"""

PPL_LOGS = f"""logs AS (
  SELECT {run('user_id')} AS run_id, {model('user_id')} AS model_id, event_id AS run_no,
    CASE WHEN event_type = 'error' THEN 'main: error loading model' || chr(10) || 'failed ' || props
         WHEN event_type = 'view' THEN 'llama_perf: overall_ppl = ' || CAST(CAST(20.0 + value AS DECIMAL(12,4)) AS VARCHAR)
         ELSE '[1]4.1,[2]5.2' || chr(13) || chr(10) || 'Final estimate: PPL = '
              || CAST(CAST(20.0 + value AS DECIMAL(12,4)) AS VARCHAR) || ' +/- '
              || CAST(CAST(value / 100 AS DECIMAL(12,4)) AS VARCHAR) END AS log
  FROM events),
norm AS (SELECT *, replace(log, chr(13), chr(10)) AS txt FROM logs),
parsed AS (
  SELECT run_id, model_id, run_no,
    CAST(nullif(regexp_extract(txt, '{{FE}}', 1), '') AS DOUBLE) AS fin,
    CAST(nullif(regexp_extract(txt, '{{FE}}', 2), '') AS DOUBLE) AS fin_se,
    CAST(nullif(regexp_extract(txt, '{{OV}}', 1), '') AS DOUBLE) AS ov
  FROM norm),
runs AS (
  SELECT run_id, model_id, run_no, coalesce(fin, ov) AS ppl, CASE WHEN fin IS NOT NULL THEN fin_se END AS ppl_se
  FROM parsed)"""


# The two result lines of the perplexity tool, stated here anew: a twin takes nothing from the code it checks.
FINAL_LINE = r"(?i)final estimate:\s*ppl\s*=\s*(\d+(?:\.\d+)?)(?:\s*\+/-\s*(\d+(?:\.\d+)?))?"
OVERALL_LINE = r"(?i)overall_ppl\s*=\s*(\d+(?:\.\d+)?)"


def _ppl_logs_sql() -> str:
    return PPL_LOGS.replace("{FE}", FINAL_LINE).replace("{OV}", OVERALL_LINE)


def _composite() -> str:
    """All steps of the leaderboard; ``nb`` has its rows, ``present`` their components."""
    return f"""
WITH {ITEMS},
acc AS (SELECT run_id, model_id, avg(correct) AS acc_score, stddev_samp(correct) / sqrt(count(correct)) AS acc_stderr
        FROM items GROUP BY ALL),
{exflags()},
cod AS (SELECT run_id, model_id, count(*) AS completed, count_if(pass_1) AS k1, count_if(pass_any) AS k2,
               CASE WHEN count(*) > 0 THEN 100.0::DOUBLE * count_if(pass_any) / count(*) END AS rate2
        FROM ex GROUP BY ALL),
ev AS (SELECT {model('user_id')} AS model_id, event_type, value FROM events WHERE event_type <> 'error'
       UNION ALL SELECT 'src20', event_type, value FROM events WHERE event_type <> 'error'),
pruns AS (SELECT model_id, event_type, avg(20.0::DOUBLE + value) AS ppl, avg(value / 100) AS se FROM ev GROUP BY ALL),
ppl AS (SELECT {run_of('model_id')} AS run_id, model_id, avg(ppl) AS ppl, avg(se) AS ppl_se, count(*) AS n_runs,
               min(ppl) AS run_min, max(ppl) AS run_max FROM pruns GROUP BY ALL),
pn AS (SELECT *, min(CASE WHEN ppl > 0 THEN ppl END) OVER (PARTITION BY run_id) AS min_ppl FROM ppl),
pc AS (SELECT run_id, model_id,
              CASE WHEN ppl > 0 THEN 100.0::DOUBLE * min_ppl / ppl END AS ppl_score,
              CASE WHEN ppl > 0 AND (ppl_se IS NOT NULL OR n_runs >= 2)
                   THEN sqrt(coalesce(power({Z} * ((100.0::DOUBLE * min_ppl / (ppl * ppl)) * ppl_se), 2), 0)
                             + CASE WHEN n_runs >= 2 THEN power((100.0::DOUBLE * min_ppl / run_min - 100.0::DOUBLE * min_ppl / run_max) / 2, 2)
                                    ELSE 0 END) END AS ppl_ci
       FROM pn),
{MODELS},
wide AS (
  SELECT m.run_id, m.model_id, m.ordinal, pc.ppl_score, pc.ppl_ci,
         a.acc_score * 100.0::DOUBLE AS mmlu_v,
         CASE WHEN a.acc_stderr IS NOT NULL THEN {Z} * a.acc_stderr * 100.0::DOUBLE END AS mmlu_ci,
         c.rate2 AS cod_v,
         CASE WHEN c.completed > 0 AND c.rate2 IS NOT NULL THEN {wilson_half('c.k2', 'c.completed')} END AS cod_ci
  FROM models m LEFT JOIN acc a USING (run_id, model_id) LEFT JOIN cod c USING (run_id, model_id)
       LEFT JOIN pc USING (run_id, model_id)),
comp AS (
  SELECT run_id, model_id, 'ppl' AS name, 0.5::DOUBLE AS wt, ppl_score AS v, ppl_ci AS ci FROM wide
  UNION ALL SELECT run_id, model_id, 'mmlu', 0.25::DOUBLE, mmlu_v, mmlu_ci FROM wide
  UNION ALL SELECT run_id, model_id, 'coding', 0.25::DOUBLE, cod_v, cod_ci FROM wide),
present AS (SELECT *, wt / sum(wt) OVER (PARTITION BY run_id, model_id) AS nw FROM comp
            WHERE wt > 0 AND v IS NOT NULL),
sc AS (SELECT run_id, model_id, sum(nw * v) AS score,
              CASE WHEN count(ci) = count(*) THEN sqrt(sum((nw * ci) * (nw * ci))) END AS ci_half,
              count(*) AS n_components, list(name) AS names
       FROM present GROUP BY ALL),
allnames AS (SELECT run_id, list(DISTINCT name) AS names FROM present GROUP BY run_id),
lb AS (
  SELECT w.run_id, w.model_id, w.ordinal, sc.score, sc.ci_half, coalesce(sc.n_components, 0) AS n_components,
         array_to_string(list_sort(list_filter(an.names, lambda x: NOT list_contains(coalesce(sc.names, []), x))), ',')
           AS missing
  FROM wide w LEFT JOIN sc USING (run_id, model_id) LEFT JOIN allnames an USING (run_id)),
rk AS (SELECT *, CASE WHEN score IS NOT NULL THEN row_number() OVER (PARTITION BY run_id ORDER BY score DESC NULLS LAST,
              ordinal) END AS rnk FROM lb),
nb AS (SELECT *, lead(score) OVER o AS ns, lead(ci_half) OVER o AS nc, lag(score) OVER o AS ps,
              lag(ci_half) OVER o AS pci
       FROM rk WINDOW o AS (PARTITION BY run_id ORDER BY rnk NULLS LAST, ordinal))"""


MARKED = """(rnk IS NOT NULL AND (coalesce(score - ns <= sqrt(ci_half * ci_half + nc * nc), false)
                             OR coalesce(ps - score <= sqrt(pci * pci + ci_half * ci_half), false)))"""


def composite_leaderboard() -> str:
    return _composite() + f"""
SELECT run_id, model_id, CAST(ordinal AS BIGINT) AS ordinal, CAST(rnk AS BIGINT) AS rank,
       round(score, 6) AS score, round(ci_half, 6) AS score_ci_half,
       {MARKED} AS nonsignificant,
       missing, CAST(n_components AS BIGINT) AS n_components
FROM nb"""


def _with_latency() -> str:
    return _composite() + f""",
{CHUNKS},
lat AS (SELECT run_id, model_id, count(*) AS n_requests, quantile_cont(ttft_ms, 0.5) AS ttft, quantile_cont(tok_s, 0.5) AS tok_s
        FROM per GROUP BY ALL)"""


def leaderboard_display() -> str:
    return _with_latency() + f"""
SELECT n.run_id, n.model_id, coalesce(CAST(rnk AS VARCHAR), '-') AS rank_cell, round(p.ppl, 6) AS ppl, round({Z} * p.ppl_se, 6) AS ppl_half,
       round(a.acc_score * 100, 6) AS acc_pct, round({Z} * a.acc_stderr * 100, 6) AS acc_half,
       round(100.0::DOUBLE * k1 / completed, 6) AS pass_rate_1, round(CASE WHEN completed > 0 THEN {wilson_half('k1', 'completed')} END, 6) AS pass1_half,
       round(rate2, 6) AS pass_rate_2, round(CASE WHEN completed > 0 THEN {wilson_half('k2', 'completed')} END, 6) AS pass2_half,
       round(l.ttft, 5) AS ttft_ms_p50, round(l.tok_s, 3) AS tok_s_median, round(n.score, 6) AS score,
       CASE WHEN {MARKED} THEN '*' ELSE '' END || CASE WHEN coalesce(missing, '') <> '' THEN '†' ELSE '' END AS marks
FROM nb n LEFT JOIN ppl p USING (run_id, model_id) LEFT JOIN acc a USING (run_id, model_id) LEFT JOIN cod c USING (run_id, model_id)
     LEFT JOIN lat l USING (run_id, model_id)"""


def _rates(k: str) -> str:
    """Text of a pass rate with its interval half, of the counts ``k`` in ``completed``."""
    return f"coalesce(printf('%.1f%% ±%.1f', 100.0::DOUBLE * {k} / completed, CASE WHEN completed > 0 THEN {wilson_half(k, 'completed')} END), 'n/a')"


def wilson_bounds(k: str, n: str) -> tuple[str, str]:
    """Both ends of the Wilson interval (percent, clamped), as SQL texts."""
    n_ = f"CAST({n} AS DOUBLE)"
    p = f"(CAST({k} AS DOUBLE) / {n_})"
    zz = f"({Z} * {Z})"
    d = f"(1.0::DOUBLE + {zz} / {n_})"
    center = f"(({p} + {zz} / (2.0::DOUBLE * {n_})) / {d})"
    half = f"({Z} * sqrt({p} * (1.0::DOUBLE - {p}) / {n_} + {zz} / (4.0::DOUBLE * {n_} * {n_})) / {d})"
    return f"greatest(0.0::DOUBLE, ({center} - {half}) * 100.0::DOUBLE)", f"least(100.0::DOUBLE, ({center} + {half}) * 100.0::DOUBLE)"


LINE_NO = "row_number() OVER (PARTITION BY n.run_id ORDER BY rnk NULLS LAST, n.ordinal)"
MARKS = f"CASE WHEN {MARKED} THEN '*' ELSE '' END || CASE WHEN coalesce(missing, '') <> '' THEN '†' ELSE '' END"
STAGES = """FROM nb n LEFT JOIN ppl p USING (run_id, model_id) LEFT JOIN acc a USING (run_id, model_id) LEFT JOIN cod c USING (run_id, model_id)
     LEFT JOIN pc USING (run_id, model_id) LEFT JOIN lat l USING (run_id, model_id)"""


def leaderboard_cells() -> str:
    return _with_latency() + f"""
SELECT n.run_id, {LINE_NO} AS line_no, coalesce(CAST(rnk AS VARCHAR), '-') AS rank_cell, n.model_id AS label_cell,
       coalesce(printf('%.2f±%.2f', p.ppl, {Z} * p.ppl_se), printf('%.2f', p.ppl), 'n/a') AS ppl_cell,
       coalesce(printf('%.1f%% ±%.1f', a.acc_score * 100, {Z} * a.acc_stderr * 100), printf('%.1f%%', a.acc_score * 100), 'n/a') AS accuracy_cell,
       {_rates('k1')} AS pass1_cell, {_rates('k2')} AS pass2_cell, coalesce(printf('%.0f', l.ttft), 'n/a') AS ttft_cell, coalesce(printf('%.0f', l.tok_s), 'n/a') AS rate_cell,
       coalesce(printf('%.2f', n.score) || {MARKS}, 'n/a') AS score_cell
{STAGES}"""


def model_details() -> str:
    (lo1, hi1), (lo2, hi2) = wilson_bounds("k1", "completed"), wilson_bounds("k2", "completed")
    name = lambda c: f"CASE {c} WHEN 'ppl' THEN 'PPL' WHEN 'mmlu' THEN 'MMLU' ELSE 'Coding' END"
    return _with_latency() + f""",
parts AS (SELECT run_id, model_id, string_agg(printf('%.2f×%s(%.1f)', nw, {name('name')}, v), ' + ' ORDER BY CASE name WHEN 'ppl' THEN 0 WHEN 'mmlu' THEN 1 ELSE 2 END) AS breakdown
          FROM present GROUP BY ALL),
each AS (SELECT model_id, string_agg(printf('%.2f', ppl), ', ' ORDER BY event_type) AS runs FROM pruns GROUP BY model_id),
tok AS (SELECT source AS model_id, sum(length(text) // 4) AS n_tokens FROM documents GROUP BY source),
ns AS (SELECT run_id, model_id, count(correct) AS n FROM items GROUP BY ALL),
lat95 AS (SELECT run_id, model_id, quantile_cont(ttft_ms, 0.95) AS p95 FROM per GROUP BY ALL)
SELECT n.run_id, {LINE_NO} AS line_no, n.model_id, printf('%.2f', n.score) || {MARKS} AS score, coalesce(parts.breakdown, '') AS breakdown,
       coalesce(array_to_string(list_transform(list_filter(string_split(missing, ','), lambda x: x <> ''), lambda x: {name('x')}), ', '), '') AS missing,
       concat_ws('; ',
         printf('accuracy %.2f%%', a.acc_score * 100) || coalesce(printf(' ± %.2f pts', {Z} * a.acc_stderr * 100), '') || ' (n=' || CAST(ns.n AS VARCHAR) || ')',
         printf('pass@1 %.1f%% [%.1f-%.1f], pass@2 %.1f%% [%.1f-%.1f] (%s/? tests)', 100.0::DOUBLE * k1 / completed, {lo1}, {hi1}, rate2, {lo2}, {hi2}, CAST(completed AS VARCHAR)),
         printf('PPL %.2f', p.ppl) || coalesce(printf(' ±%.2f', {Z} * p.ppl_se), '') || coalesce(printf(', ~%.0fK tokens', n_tokens / 1000.0::DOUBLE), '')
           || ' (' || CAST(p.n_runs AS VARCHAR) || ' runs: ' || each.runs || ')' || coalesce(printf(', fidelity %.1f/100', pc.ppl_score), ''),
         printf('first token p50 %.0f ms (p95 %.0f ms), %.1f tok/s over %s requests', l.ttft, lat95.p95, l.tok_s, CAST(l.n_requests AS VARCHAR)),
         CASE WHEN l.n_requests IS NULL THEN 'latency error: ValueError: no usable requests (no tokens received)' END) AS facts
{STAGES} LEFT JOIN parts USING (run_id, model_id) LEFT JOIN each USING (model_id) LEFT JOIN tok USING (model_id) LEFT JOIN ns USING (run_id, model_id)
     LEFT JOIN lat95 USING (run_id, model_id)"""


def report_legends() -> str:
    return _composite() + f"""
SELECT DISTINCT run_id, '*' AS mark FROM nb WHERE {MARKED} UNION ALL SELECT DISTINCT run_id, '†' FROM nb WHERE coalesce(missing, '') <> ''"""


def stage_failures() -> str:
    """The leaderboard without its perplexity stage, which fails on the logs without a result."""
    return _composite().replace("FROM pn),", "FROM pn WHERE FALSE),") + """
SELECT run_id, model_id, CAST(rnk AS BIGINT) AS rank, round(score, 6) AS score, round(ci_half, 6) AS score_ci_half,
       'USER_RAISED_EXCEPTION: the server answered with errors' AS server_error,
       'USER_RAISED_EXCEPTION: could not parse perplexity output: main: error loading model' AS ppl_error, 'skipped' AS latency FROM nb"""


def perplexity_runs() -> str:
    return _composite() + f"""
SELECT {run_of('r.model_id')} AS run_id, r.model_id, row_number() OVER (PARTITION BY r.model_id ORDER BY event_type) - 1 AS at, event_type AS run_no, round(r.ppl, 6) AS ppl,
       round(se, 6) AS ppl_se, round(CASE WHEN r.ppl > 0 THEN 100.0::DOUBLE * min_ppl / r.ppl END, 6) AS fidelity
FROM pruns r JOIN pn USING (model_id)"""


def _wide_matrix(rows: str, with_results: str, head: str, body: str) -> str:
    """A wide matrix of run r0: line 0 names its models in rank order, the other lines come from ``body`` (line_no, ``rows``, pos, cell)."""
    columns = ", ".join(f"max(CASE WHEN pos = {k + 1} THEN cell END) AS m{k + 1:02d}" for k in range(10))
    return _composite() + f""",
{body.split('=>')[0]},
cols AS (SELECT model_id, row_number() OVER (ORDER BY rnk NULLS LAST, ordinal) AS pos FROM nb WHERE run_id = 'r0' AND model_id IN ({with_results})),
lines AS (SELECT 0 AS line_no, {head}, pos, model_id AS cell FROM cols UNION ALL {body.split('=>')[1]})
SELECT line_no, {rows}, {columns} FROM lines GROUP BY line_no, {rows}"""


def subject_matrix_wide() -> str:
    return _wide_matrix("subject, spread", "SELECT model_id FROM subj WHERE run_id = 'r0'", "NULL AS subject, NULL AS spread", f"""{SUBJ},
sp AS (SELECT subject, max(acc) - min(acc) AS d FROM subj WHERE run_id = 'r0' GROUP BY subject HAVING count(DISTINCT model_id) >= 2),
so AS (SELECT *, row_number() OVER (ORDER BY d DESC, subject) AS line_no FROM sp) => 
SELECT line_no, so.subject, printf('%.1f', d * 100.0::DOUBLE) || CASE WHEN d >= 0.04 THEN ' †' ELSE '' END, pos, coalesce(printf('%.1f', acc * 100.0::DOUBLE), '–')
FROM so CROSS JOIN cols LEFT JOIN subj s ON s.subject = so.subject AND s.model_id = cols.model_id AND s.run_id = 'r0'""")


def exercise_matrix_wide() -> str:
    return _wide_matrix("exercise", "SELECT model_id FROM ex WHERE run_id = 'r0'", "NULL AS exercise", """
eo AS (SELECT exercise, row_number() OVER (ORDER BY exercise) AS line_no FROM (SELECT DISTINCT exercise FROM ex WHERE run_id = 'r0')) =>
SELECT line_no, eo.exercise, pos, CASE WHEN pass_1 IS NULL THEN '–' WHEN pass_1 THEN '1' WHEN pass_any THEN '2' ELSE '·' END
FROM eo CROSS JOIN cols LEFT JOIN ex ON ex.exercise = eo.exercise AND ex.model_id = cols.model_id AND ex.run_id = 'r0'""")


def score_breakdown() -> str:
    return _composite() + """
SELECT p.run_id, p.model_id, p.name AS component, round(nw, 6) AS weight, round(v, 6) AS value, round(ci, 6) AS ci_half, n.missing
FROM present p JOIN nb n USING (run_id, model_id)"""


def report_records() -> str:
    n = "CAST(completed AS DOUBLE)"
    return _with_latency() + f"""
SELECT n.run_id, n.model_id, CAST(rnk AS BIGINT) AS rank, coalesce(missing, '') <> '' AS partial, CAST(n_components AS BIGINT) AS n_components,
       round(a.acc_score, 6) AS accuracy, round({Z} * a.acc_stderr * 100, 6) AS accuracy_ci, completed, CAST(k2 AS BIGINT) AS pass_num_2,
       round(CASE WHEN completed > 0 THEN {wilson_half('k2', 'completed')} END, 6) AS coding_half, round(p.ppl, 6) AS ppl, p.n_runs, round(p.run_min, 6) AS run_min,
       round(p.run_max, 6) AS run_max, round(pc.ppl_score, 6) AS fidelity, round(pc.ppl_ci, 6) AS ppl_ci, l.n_requests,
       l.n_requests IS NULL AS latency_failed
FROM nb n LEFT JOIN ppl p USING (run_id, model_id) LEFT JOIN acc a USING (run_id, model_id) LEFT JOIN cod c USING (run_id, model_id)
     LEFT JOIN pc USING (run_id, model_id) LEFT JOIN lat l USING (run_id, model_id)"""


def subject_accuracy() -> str:
    return f"""
WITH {ITEMS}
SELECT run_id, model_id, coalesce(subject, '(all)') AS subject, round(avg(correct), 6) AS acc,
       round(stddev_samp(correct) / sqrt(count(correct)), 6) AS acc_stderr,
       round({Z} * (stddev_samp(correct) / sqrt(count(correct))) * 100, 6) AS ci_half,
       CAST(count(correct) AS BIGINT) AS n, grouping(subject) = 1 AS is_overall
FROM items GROUP BY GROUPING SETS ((run_id, model_id, subject), (run_id, model_id))"""


LIMIT_PER_SUBJECT = """
SELECT subject, doc_no, source FROM (
  SELECT lang AS subject, doc_id AS doc_no, source, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rn
  FROM documents) WHERE rn <= 50"""


def pass_summary() -> str:
    return f"""
WITH {exflags()}
SELECT run_id, model_id, count(*) AS completed, count_if(pass_1) AS pass_num_1, count_if(pass_any) AS pass_num_2,
       round(100.0::DOUBLE * count_if(pass_1) / count(*), 6) AS pass_rate_1,
       round(100.0::DOUBLE * count_if(pass_any) / count(*), 6) AS pass_rate_2,
       round({wilson_half('count_if(pass_any)', 'count(*)')}, 6) AS pass_ci_half
FROM ex GROUP BY ALL"""


def pass_by_language_rollup() -> str:
    return f"""
WITH {exflags('l_linestatus')}
SELECT run_id, model_id, coalesce(language, '(all)') AS language, count(*) AS completed,
       count_if(pass_1) AS pass_num_1, count_if(pass_any) AS pass_num_2,
       round(100.0::DOUBLE * count_if(pass_1) / count(*), 6) AS pass_rate_1,
       round(100.0::DOUBLE * count_if(pass_any) / count(*), 6) AS pass_rate_2,
       grouping(language) = 1 AS is_total
FROM ex GROUP BY GROUPING SETS ((run_id, model_id, language), (run_id, model_id))"""


TOKEN_TOTALS = f"""
SELECT {run('l_suppkey')} AS run_id, {model('l_suppkey')} AS model_id, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS prompt_tokens,
       CAST(sum(CAST(floor(l_extendedprice / 100) AS BIGINT)) AS BIGINT) AS completion_tokens
FROM lineitem GROUP BY ALL"""

FIRST_N_TRIES = f"""
WITH t AS (
  SELECT {run('l_suppkey')} AS run_id, {model('l_suppkey')} AS model_id, l_returnflag = 'R' AS passed,
         row_number() OVER (PARTITION BY {model('l_suppkey')}, l_partkey
                            ORDER BY l_shipdate, l_orderkey, l_linenumber, l_suppkey, l_quantity, l_extendedprice)
           AS try_no
  FROM lineitem)
SELECT run_id, model_id, CAST(try_no AS BIGINT) AS try_no, count(*) AS n_tries, count_if(passed) AS n_passed
FROM t WHERE try_no <= 2 GROUP BY ALL"""


def exercise_matrix_long() -> str:
    return f"""
WITH {exflags()}, {MODELS},
grid AS (SELECT DISTINCT run_id, language, exercise FROM ex)
SELECT g.run_id, g.language, g.exercise, m.model_id,
       CASE WHEN x.pass_1 IS NULL AND x.pass_any IS NULL THEN '–' WHEN x.pass_1 THEN '1'
            WHEN x.pass_any THEN '2' ELSE '·' END AS cell
FROM grid g JOIN models m ON g.run_id = m.run_id
LEFT JOIN ex x ON x.run_id = g.run_id AND x.language = g.language AND x.exercise = g.exercise
              AND x.model_id = m.model_id"""


PROGRESS = f"""
WITH {FILES},
done AS (SELECT run, count(*) AS done FROM files WHERE language IN ('F', 'O') GROUP BY run),
cat AS (SELECT unnest(['F', 'O']) AS language, CAST(p_partkey AS VARCHAR) AS exercise FROM part),
total AS (SELECT count(DISTINCT language || '|' || exercise) AS total FROM cat WHERE language IN ('F', 'O'))
SELECT run, CAST(done AS BIGINT) AS done, CAST(total AS BIGINT) AS total FROM done CROSS JOIN total"""

LATEST_RUN = f"""
WITH {FILES},
runs AS (SELECT run, max(mtime) AS mtime FROM files GROUP BY run),
p AS (SELECT run, mtime, nullif(regexp_extract(run, '^(\\d{{4}}-\\d{{2}}-\\d{{2}}-\\d{{2}}-\\d{{2}}-\\d{{2}})--(.+)$', 2), '')
        AS slug FROM runs)
SELECT slug, arg_max(run, (mtime, run)) AS run, strftime(max(mtime), '%Y-%m-%d %H:%M:%S') AS mtime
FROM p WHERE slug IS NOT NULL GROUP BY slug"""

NEW_RUNS = f"""
WITH {FILES},
runs AS (SELECT run, max(mtime) AS mtime FROM files GROUP BY run)
SELECT run, strftime(mtime, '%Y-%m-%d %H:%M:%S') AS mtime FROM runs
WHERE run NOT IN (SELECT run FROM runs WHERE mtime < TIMESTAMP '1996-01-01 00:00:00')"""

REQUEST_LATENCY = f"""
WITH {CHUNKS}
SELECT run_id, model_id, request_id, n_tokens, round(ttft_ms, 3) AS ttft_ms, round(tok_s, 3) AS tok_s FROM per"""

LATENCY_SUMMARY = f"""
WITH {CHUNKS}
SELECT run_id, model_id, count(*) AS n_requests, round(sum(ttft_us) / count(*) / 1000.0, 3) AS ttft_ms_mean,
       round(quantile_cont(ttft_ms, 0.5), 5) AS ttft_ms_p50, round(quantile_cont(ttft_ms, 0.95), 5) AS ttft_ms_p95,
       round(avg(tok_s), 3) AS tok_s_mean, round(quantile_cont(tok_s, 0.5), 3) AS tok_s_median,
       CAST(sum(n_tokens) AS BIGINT) AS total_tokens
FROM per GROUP BY ALL"""


def ppl_log_parse() -> str:
    return f"""
WITH {_ppl_logs_sql()}
SELECT run_id, model_id, run_no, ppl, ppl_se, ppl IS NULL AS failed FROM runs"""


def ppl_summary() -> str:
    return f"""
WITH {_ppl_logs_sql()}
SELECT run_id, model_id, round(avg(ppl), 6) AS ppl, round(avg(ppl_se), 6) AS ppl_se, count(*) AS n_runs,
       round(min(ppl), 6) AS run_min, round(max(ppl), 6) AS run_max
FROM runs WHERE ppl IS NOT NULL GROUP BY ALL"""


TOKEN_ESTIMATE = """
SELECT source AS model_id, CAST(sum(floor(length(text) / 4)) AS BIGINT) AS est_tokens, count(*) AS n_docs
FROM documents GROUP BY source"""


# ---- scoring (bigram stand-in) ---------------------------------------------------------------

WORDS = "list_filter(string_split_regex(lower({t}), '[ \\n]+'), lambda w: length(w) > 0)"
# Python's str.strip() white space set, for the normalised-text branch (NFC stands in for NFKC)
_WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(28) || chr(29) || chr(30) || chr(31) || chr(133) || chr(160) || chr(5760) || chr(8192) || chr(8193) || chr(8194) || chr(8195) || chr(8196) || chr(8197) || chr(8198) || chr(8199) || chr(8200) || chr(8201) || chr(8202) || chr(8232) || chr(8233) || chr(8239) || chr(8287) || chr(12288)"


def tid(x: str) -> str:
    return f"CAST(('0x' || substr(md5({x}), 1, 15)) AS BIGINT)"


def nrm(x: str) -> str:
    return f"trim(nfc_normalize(coalesce({x}, '')), {_WS})"


CANDS = f"""docs AS (SELECT doc_id, source AS model_id, {WORDS.format(t='text')} AS w FROM documents),
pairs AS (SELECT model_id, w[i] AS prev, w[i + 1] AS nxt
          FROM (SELECT model_id, w, unnest(range(1, len(w))) AS i FROM docs)),
counts AS (SELECT model_id, prev, nxt, count(*) AS n FROM pairs GROUP BY ALL),
totals AS (SELECT model_id, prev, count(*) AS n_prev FROM pairs GROUP BY ALL),
ranked AS (SELECT c.*, t.n_prev,
                  row_number() OVER (PARTITION BY c.model_id, c.prev ORDER BY c.n DESC, c.nxt) AS cand_pos
           FROM counts c JOIN totals t USING (model_id, prev)),
top AS (SELECT model_id, {tid('prev')} AS prefix_id, cand_pos, {tid('nxt')} AS cand_id, nxt AS cand_token,
               ln(CAST(n AS DOUBLE) / CAST(n_prev AS DOUBLE)) AS lp
        FROM ranked WHERE cand_pos <= 50),
cands AS (SELECT * FROM top UNION ALL
          SELECT model_id, prefix_id, 0 AS cand_pos, cand_id, cand_token, lp FROM top WHERE cand_pos = 1),
by_id AS (SELECT model_id, prefix_id, cand_id AS target_id, min(cand_pos) AS prio, arg_min(lp, cand_pos) AS lp
          FROM cands GROUP BY ALL),
by_tx AS (SELECT model_id, prefix_id, {nrm('cand_token')} AS nrm, min(cand_pos) AS prio,
                 arg_min(lp, cand_pos) AS lp
          FROM cands GROUP BY ALL)"""


def lookup(toks: str) -> str:
    return f"""lk AS (
  SELECT t.*, bi.prio AS id_prio, bi.lp AS id_lp,
         CASE WHEN {nrm('t.target_text')} <> '' THEN bt.prio END AS tx_prio,
         CASE WHEN {nrm('t.target_text')} <> '' THEN bt.lp END AS tx_lp
  FROM {toks} t
  LEFT JOIN by_id bi ON bi.model_id = t.model_id AND bi.prefix_id = t.prefix_id AND bi.target_id = t.target_id
  LEFT JOIN by_tx bt ON bt.model_id = t.model_id AND bt.prefix_id = t.prefix_id AND bt.nrm = {nrm('t.target_text')}),
res AS (
  SELECT *, CASE WHEN id_prio IS NOT NULL THEN id_prio ELSE tx_prio END AS prio,
         coalesce(CASE WHEN id_prio IS NOT NULL THEN id_lp ELSE tx_lp END, -100.0::DOUBLE) AS logprob
  FROM lk)"""


DOC_TOKENS = f"""toks AS (
  SELECT {run_of('model_id')} AS run_id, model_id, doc_id AS request_id, i - 1 AS pos, {tid('w[i]')} AS prefix_id,
         CASE WHEN substr(md5(w[i + 1]), 1, 1) <> '0' THEN {tid('w[i + 1]')} END AS target_id, w[i + 1] AS target_text
  FROM (SELECT model_id, doc_id, w, unnest(range(1, len(w))) AS i FROM docs))"""


def token_logprob_lookup() -> str:
    return f"""
WITH {CANDS}, {DOC_TOKENS}, {lookup('toks')}
SELECT run_id, model_id, CASE WHEN prio IS NULL THEN 'floor' WHEN prio = 0 THEN 'greedy' ELSE 'candidate' END
         AS outcome, count(*) AS n, round(sum(logprob), 3) AS sum_logprob
FROM res GROUP BY ALL"""


def request_loglik() -> str:
    return f"""
WITH {CANDS}, {DOC_TOKENS}, {lookup('toks')},
agg AS (SELECT model_id, request_id, sum(logprob) AS ll, bool_and(coalesce(prio = 0, false)) AS g, count(*) AS n
        FROM res GROUP BY ALL)
SELECT {run_of('d.model_id')} AS run_id, d.model_id, d.doc_id AS request_id, round(coalesce(a.ll, 0.0), 3) AS loglik,
       coalesce(a.g, true) AS is_greedy, CAST(coalesce(a.n, 0) AS BIGINT) AS n_tokens
FROM docs d LEFT JOIN agg a ON a.model_id = d.model_id AND a.request_id = d.doc_id"""


def choice_accuracy() -> str:
    return f"""
WITH {CANDS}, {MODELS},
bench AS (SELECT item_id, {WORDS.format(t='text')} AS w FROM benchmark),
parts AS (SELECT item_id, CAST(floor(len(w) / 2) AS BIGINT) AS h, w FROM bench),
parts2 AS (SELECT item_id, list_slice(w, 1, h) AS head, list_slice(w, h + 1, len(w)) AS tail FROM parts),
nitems AS (SELECT count(*) AS n FROM benchmark),
creq AS (
  SELECT m.model_id, p.item_id, c.choice_no, p.head, t.tail
  FROM parts2 p CROSS JOIN (SELECT unnest(range(4)) AS choice_no) c CROSS JOIN nitems
  JOIN parts2 t ON t.item_id = (p.item_id + c.choice_no) % nitems.n
  CROSS JOIN models m),
ctoks AS (
  SELECT model_id, item_id, choice_no, j - 1 AS pos,
         {tid("CASE WHEN j = 1 THEN (CASE WHEN len(head) > 0 THEN head[len(head)] END) ELSE tail[j - 1] END")}
           AS prefix_id,
         CASE WHEN substr(md5(tail[j]), 1, 1) <> '0' THEN {tid('tail[j]')} END AS target_id, tail[j] AS target_text
  FROM (SELECT *, unnest(range(1, len(tail) + 1)) AS j FROM creq)),
{lookup('ctoks')},
agg AS (SELECT model_id, item_id, choice_no, sum(logprob) AS ll FROM res GROUP BY ALL),
ll AS (SELECT r.model_id, r.item_id, r.choice_no, coalesce(a.ll, 0.0) AS ll
       FROM creq r LEFT JOIN agg a USING (model_id, item_id, choice_no)),
pred AS (SELECT model_id, item_id, arg_max(choice_no, (ll, -choice_no)) AS pred FROM ll GROUP BY ALL)
SELECT {run_of('model_id')} AS run_id, model_id, count(*) AS n_items, count_if(pred = 0) AS n_correct,
       round(avg(CASE WHEN pred = 0 THEN 1.0 ELSE 0.0 END), 6) AS acc
FROM pred GROUP BY ALL"""


TOKEN_PERPLEXITY = f"""
WITH occ AS (SELECT source AS model_id, unnest({WORDS.format(t='text')}) AS word FROM documents),
uni AS (SELECT word, count(*) AS c FROM occ GROUP BY word),
tot AS (SELECT sum(c) AS total FROM uni),
lp AS (SELECT word, ln(CAST(c AS DOUBLE) / CAST(total AS DOUBLE)) AS lp FROM uni CROSS JOIN tot)
SELECT model_id, round(exp(-avg(lp)), 6) AS ppl, round(exp(-avg(lp)) * stddev_samp(lp) / sqrt(count(*)), 6) AS ppl_se,
       count(*) AS n_tokens
FROM occ JOIN lp USING (word) GROUP BY model_id"""


# The count of a word before its place is its running number less one; the most frequent one so far has the largest.
PREFIX_SCORES = f"""
WITH d AS (SELECT source, doc_id, {WORDS.format(t='text')} AS w FROM documents),
o AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS k FROM d),
c AS (SELECT *, row_number() OVER (PARTITION BY doc_id, word ORDER BY k) - 1 AS n FROM o),
m AS (SELECT *, max(n + 1) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS most FROM c),
s AS (SELECT doc_id, sum(ln((n + 1) / (k + 10000)::DOUBLE)) AS ll, bool_and(n > 0 AND n = most) AS g, count(*) AS t FROM m WHERE k > 0 GROUP BY doc_id)
SELECT {run_of('source')} AS run_id, source AS model_id, doc_id AS request_id, doc_id AS request_no, round(coalesce(ll, 0), 3) AS loglik, coalesce(g, TRUE) AS is_greedy,
       coalesce(t, 0) AS n_tokens
FROM d LEFT JOIN s USING (doc_id)"""

GENERATIONS = f"""
WITH u AS (SELECT {run('conv_id')} AS run_id, {model('conv_id')} AS model_id, conv_id, turn, {WORDS.format(t='text')} AS w FROM conversations WHERE role = 'user'),
p AS (SELECT *, w[greatest(1, len(w) - 39):] AS c FROM u WHERE (model_id, w) NOT IN (SELECT model_id, w FROM u WHERE conv_id % 2 = 0)),
l AS (SELECT *, len(c) - 1 - list_position(list_reverse(c[:len(c) - 1]), c[len(c)]) + 1 AS last FROM p)
SELECT run_id, model_id, CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS request_id, turn AS request_no,
       coalesce(CASE WHEN last > 0 AND len(c) > 1 THEN array_to_string(c[last + 1:least(last + 8, len(c))], ' ') END, '[no response]') AS generated,
       NOT coalesce(last > 0 AND len(c) > 1, FALSE) AS is_placeholder
FROM l"""

WINDOW_PERPLEXITY = f"""
WITH d AS (SELECT source AS model_id, doc_id, {WORDS.format(t='text')} AS w FROM documents),
o AS (SELECT *, coalesce(sum(len(w)) OVER (PARTITION BY model_id ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d),
occ AS (SELECT model_id, before, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS k FROM o),
uni AS (SELECT word, count(*) AS c FROM occ GROUP BY word),
tot AS (SELECT sum(c) AS total FROM uni),
lp AS (SELECT word, ln(CAST(c AS DOUBLE) / CAST(total AS DOUBLE)) AS lp FROM uni CROSS JOIN tot),
t AS (SELECT model_id, CAST((before + k) // 1024 AS BIGINT) AS chunk_no, lp FROM occ JOIN lp USING (word))
SELECT model_id, chunk_no, round(exp(-avg(lp)), 6) AS ppl, round(exp(-avg(lp)) * stddev_samp(lp) / sqrt(count(*)), 6) AS ppl_se, count(*) AS n_tokens
FROM t GROUP BY ALL"""


SUBJ = """subj AS (SELECT run_id, model_id, subject, avg(correct) AS acc FROM items GROUP BY ALL)"""


def subject_spread() -> str:
    return f"""
WITH {ITEMS}, {SUBJ},
runm AS (SELECT run_id, count(DISTINCT model_id) AS n_run_models FROM subj GROUP BY run_id),
per AS (SELECT run_id, subject, max(acc) - min(acc) AS spread, count(DISTINCT model_id) AS n_models
        FROM subj GROUP BY ALL)
SELECT p.run_id, p.subject, round(spread, 6) AS spread, n_models, spread >= 0.04 AS flagged
FROM per p JOIN runm USING (run_id) WHERE n_models >= 2 AND n_run_models >= 2"""


def subject_matrix() -> str:
    return f"""
WITH {ITEMS}, {SUBJ},
runm AS (SELECT run_id, count(DISTINCT model_id) AS n_run_models FROM subj GROUP BY run_id),
kept AS (SELECT run_id, subject FROM subj JOIN runm USING (run_id) GROUP BY run_id, subject, n_run_models
         HAVING count(DISTINCT model_id) >= 2 AND n_run_models >= 2),
models AS (SELECT DISTINCT run_id, model_id FROM subj)
SELECT k.run_id, k.subject, m.model_id, round(s.acc, 6) AS acc
FROM kept k JOIN models m ON k.run_id = m.run_id
LEFT JOIN subj s ON s.run_id = k.run_id AND s.subject = k.subject AND s.model_id = m.model_id"""


def metrics_task_summary() -> str:
    return f"""
WITH {ITEMS}
SELECT run_id, model_id, round(avg(correct), 6) AS score,
       round(stddev_samp(correct) / sqrt(count(correct)), 6) AS score_stderr,
       CAST(count(correct) AS BIGINT) AS n_samples, CAST(NULL AS VARCHAR) AS error
FROM items GROUP BY ALL"""


def metrics_subjects() -> str:
    return f"""
WITH {ITEMS}
SELECT run_id, model_id, subject, round(avg(correct), 6) AS acc FROM items GROUP BY ALL"""


REG_ENTRIES = """e AS (
  SELECT p_brand AS run_id, p_size % 3 AS g, regexp_extract(p_brand, '(\\d+)$', 1) AS bno, p_partkey, p_type,
         replace(p_name, ' ', '_') || CASE WHEN p_partkey % 7 = 0 THEN '.bin' ELSE '.gguf' END AS name
  FROM part),
e2 AS (
  SELECT run_id, g AS group_pos, '/tok/b' || bno || '/g' || CAST(g AS VARCHAR) AS tokenizer,
         CASE WHEN g <> 0 THEN '/models/b' || bno END AS models_dir,
         ['--ctx=' || CAST(1024 * (g + 1) AS VARCHAR)] AS group_flags, CAST(p_partkey AS BIGINT) AS model_pos,
         CASE WHEN g = 2 THEN '/abs/' || name ELSE name END AS path,
         CASE WHEN p_partkey % 3 = 0 THEN CAST([] AS VARCHAR[]) ELSE ['--type=' || lower(p_type)] END AS flags
  FROM e),
r AS (
  SELECT *, CASE WHEN path LIKE '/%' THEN path ELSE coalesce(models_dir, tokenizer) || '/' || path END AS rp
  FROM e2)"""


def registry_flatten() -> str:
    label = "string_split(rp, '/')[-1]"
    stem = f"regexp_replace({label}, '^(.+)\\.[^.]*$', '\\1')"
    slug = f"regexp_replace(regexp_replace({stem}, '[^A-Za-z0-9._-]+', '-', 'g'), '^[-.]+|[-.]+$', '', 'g')"
    return f"""
WITH {REG_ENTRIES}
SELECT run_id, CAST(row_number() OVER (PARTITION BY run_id ORDER BY group_pos, model_pos) AS BIGINT) AS ordinal,
       coalesce(nullif({slug}, ''), 'model') AS model_id, {label} AS label, rp AS resolved_path,
       array_to_string(CASE WHEN len(flags) > 0 THEN flags ELSE coalesce(group_flags, []) END, ' ') AS flags
FROM r"""


def registry_violations() -> str:
    return f"""
WITH {REG_ENTRIES},
d AS (SELECT *, count(*) OVER (PARTITION BY run_id, rp) AS dups FROM r),
v AS (
  SELECT run_id, group_pos, model_pos, rp AS detail, 'not_gguf' AS rule FROM d
  WHERE path IS NOT NULL AND NOT lower(path) LIKE '%.gguf'
  UNION ALL
  SELECT run_id, group_pos, model_pos, rp, 'duplicate_path' FROM d WHERE path IS NOT NULL AND dups > 1
  UNION ALL
  SELECT run_id, group_pos, model_pos, rp, 'tokenizer_required' FROM d WHERE coalesce(tokenizer, '') = ''
  UNION ALL
  SELECT run_id, group_pos, model_pos, rp, 'path_required' FROM d WHERE coalesce(path, '') = '')
SELECT * FROM v"""


RUN_OPTION_VIOLATIONS = """
WITH u AS (SELECT DISTINCT user_id FROM events),
o AS (
  SELECT 'u' || CAST(user_id AS VARCHAR) AS run_id, CAST(user_id % 13 AS DOUBLE) / 10.0 AS weights_mmlu,
         CAST(user_id % 7 AS DOUBLE) / 5.0 AS weights_ppl,
         CASE WHEN user_id % 3 = 0 THEN 'mmlu' WHEN user_id % 3 = 1 THEN 'mmlu_generative' ELSE 'mmlu_pro' END
           AS mmlu_task,
         user_id % 5 = 0 AS skip_mmlu, ['f16', 'no-cache', 'off', 'q8'][user_id % 4 + 1] AS coding_kv_fix
  FROM u)
SELECT run_id, 'weights_mmlu_range' AS rule FROM o WHERE NOT (weights_mmlu BETWEEN 0.0 AND 1.0)
UNION ALL SELECT run_id, 'weights_ppl_range' FROM o WHERE NOT (weights_ppl BETWEEN 0.0 AND 1.0)
UNION ALL SELECT run_id, 'unknown_task' FROM o WHERE NOT skip_mmlu AND mmlu_task NOT IN ('mmlu', 'mmlu_generative')
UNION ALL SELECT run_id, 'unknown_kv_fix' FROM o WHERE coding_kv_fix NOT IN ('f16', 'no-cache', 'off')"""

GENERATION_EXACT_MATCH = f"""
WITH users AS (SELECT conv_id, turn, text AS prompt FROM conversations WHERE role = 'user'),
asst AS (SELECT conv_id, turn - 1 AS turn, text AS generated FROM conversations WHERE role = 'assistant'),
g AS (
  SELECT {run('u.conv_id')} AS run_id, {model('u.conv_id')} AS model_id, lower(string_split(trim(u.prompt), ' ')[1]) AS gold,
         a.generated IS NULL AS is_placeholder,
         lower(coalesce(regexp_split_to_array(a.generated, ' |\\n|,')[1], '[no response]')) AS answer
  FROM users u LEFT JOIN asst a USING (conv_id, turn))
SELECT run_id, model_id, count(*) AS n_prompts, count_if(answer = gold) AS n_exact,
       round(avg(CASE WHEN answer = gold THEN 1.0 ELSE 0.0 END), 6) AS exact_match,
       count_if(is_placeholder) AS n_placeholder
FROM g GROUP BY ALL"""


METRICS_GENERATIVE = f"""
WITH users AS (SELECT conv_id, turn, text AS prompt FROM conversations WHERE role = 'user'),
asst AS (SELECT conv_id, turn - 1 AS turn, text AS generated FROM conversations WHERE role = 'assistant'),
g AS (SELECT {run('u.conv_id')} AS run_id, {model('u.conv_id')} AS model_id, u.conv_id % 20 AS k,
             coalesce(lower(string_split(a.generated, ' ')[1]) = lower(string_split(trim(u.prompt), ' ')[1]), FALSE) AS hit
      FROM users u LEFT JOIN asst a USING (conv_id, turn))
SELECT run_id, model_id, CASE WHEN k % 7 <> 0 THEN round(avg(CAST(hit AS DOUBLE)), 6) END AS score, count(*) AS n_samples,
       CASE WHEN k % 7 = 0 THEN 'metric ''exact_match'' not found' END AS error FROM g GROUP BY run_id, model_id, k"""

EXERCISE_CAP = """
SELECT language, exercise FROM (
  SELECT language, exercise, row_number() OVER (PARTITION BY language ORDER BY md5('7:' || exercise), exercise) AS rn
  FROM (SELECT unnest(['F', 'O']) AS language, CAST(p_partkey AS VARCHAR) AS exercise FROM part))
WHERE rn <= 100"""

RUN_META = """
WITH per AS (SELECT user_id AS u, count(*) AS n FROM events GROUP BY user_id)
SELECT 'u' || CAST(u AS VARCHAR) AS run_id, 'bench-server' AS binary, 'b' || CAST(u % 17 AS VARCHAR) AS version,
       '/runs/' || CAST(u AS VARCHAR) || '.yaml' AS config, round(sqrt(CAST(n AS DOUBLE)) * 10.0, 1) AS duration_s,
       CASE WHEN u % 5 = 0 THEN NULL WHEN u % 3 = 0 THEN 'mmlu' ELSE 'mmlu_generative' END AS mmlu_task,
       CAST(u % 50 AS INTEGER) AS mmlu_limit,
       CASE WHEN u % 4 = 0 THEN NULL WHEN u % 2 = 0 THEN 'python' ELSE 'python,go' END AS languages,
       CASE WHEN u % 4 <> 0 THEN CAST(u % 30 AS INTEGER) END AS coding_limit,
       CASE WHEN u % 4 = 0 THEN NULL WHEN u % 3 = 1 THEN 'f16' ELSE 'off' END AS coding_kv_fix,
       CAST(u % 3 + 1 AS INTEGER) AS coding_tries,
       CASE WHEN u % 7 <> 0 THEN CAST(u % 7 AS DOUBLE) / 10.0 END AS weights_ppl,
       CASE WHEN u % 7 <> 0 THEN '/texts/reference.txt' END AS ppl_reference
FROM per"""

GENERATION_TEXTS = f"""
WITH users AS (SELECT conv_id, turn, text AS prompt FROM conversations WHERE role = 'user'),
asst AS (SELECT conv_id, turn - 1 AS turn, text AS answer FROM conversations WHERE role = 'assistant'),
j AS (SELECT u.conv_id, u.prompt, a.answer FROM users u LEFT JOIN asst a USING (conv_id, turn))
SELECT {run('conv_id')} AS run_id, {model('conv_id')} AS model_id, count(*) AS n_requests,
       CAST(sum(CASE WHEN answer IS NULL THEN 1 ELSE 2 END) AS BIGINT) AS n_texts,
       CAST(sum(length(CASE WHEN answer IS NULL THEN prompt ELSE answer END)) AS BIGINT) AS first_text_chars
FROM j GROUP BY ALL"""

STREAM_PROGRESS = f"""
WITH {FILES}, tot AS (SELECT count(DISTINCT p_partkey) AS total FROM part)
SELECT run, language, count(*) AS done, CAST(max(total) AS BIGINT) AS total FROM files, tot GROUP BY run, language"""


LANDED_RESULTS = """
WITH f AS (
  SELECT '2024-01-01-00-00-00--src' || CAST(s_suppkey % 20 AS VARCHAR) AS run, ['go', 'java', 'python', 'rust'][s_nationkey % 4 + 1] AS language, s_acctbal > 0 AS p1,
         s_suppkey % 7 = 0 AS empty, s_suppkey % 7 <> 0 AND s_suppkey % 9 = 0 AS unreadable, s_suppkey * 3 AS tokens
  FROM supplier)
SELECT run, language, count(*) AS done, count_if(NOT empty AND NOT unreadable) AS completed, count_if(NOT empty AND NOT unreadable AND p1) AS pass_num_1,
       count_if(NOT empty AND NOT unreadable) AS pass_num_2, CAST(coalesce(sum(tokens) FILTER (NOT empty AND NOT unreadable), 0) AS BIGINT) AS prompt_tokens,
       count_if(empty) AS n_empty, count_if(unreadable) AS n_unreadable
FROM f WHERE language IN ('python', 'go') GROUP BY ALL"""

# A document's line breaks count one each, whatever their bytes; bad bytes count nothing; a line break follows each document.
REFERENCE_COUNTS = """
SELECT source AS corpus, CAST(sum(length(replace(coalesce(text, ''), chr(13) || chr(10), chr(10))) + CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END + 1) AS BIGINT) AS n_chars
FROM documents GROUP BY source"""

PPL_ERROR_TAILS = """
WITH u AS (SELECT user_id, count(*) AS n FROM events GROUP BY user_id),
l AS (SELECT user_id, n, list_concat(list_transform(generate_series(1, user_id % 17 + 1), lambda i: '[step ' || CAST(i AS VARCHAR) || '] 4.' || CAST(i AS VARCHAR)),
             ['failed to load the model']) AS lines FROM u)
SELECT user_id AS file, CASE WHEN user_id % 3 <> 0 THEN n + 0.5::DOUBLE END AS ppl, CASE WHEN user_id % 3 <> 0 THEN 0.25::DOUBLE END AS ppl_se,
       CASE WHEN user_id % 3 = 0 THEN 'could not parse perplexity output: ' || array_to_string(lines[-12:], chr(10)) END AS error FROM l"""

COMPOSITE_LABELS = """
WITH o AS (SELECT DISTINCT 'u' || CAST(user_id AS VARCHAR) AS run_id, CAST(user_id % 13 AS DOUBLE) / 10.0 AS m, CAST(user_id % 7 AS DOUBLE) / 5.0 AS p FROM events)
SELECT run_id, CASE WHEN p > 0 THEN printf('%.2f x PPL + ', p) ELSE '' END
       || printf('%.2f x MMLU + %.2f x aider pass@2', (1.0::DOUBLE - greatest(p, 0.0::DOUBLE)) * m, (1.0::DOUBLE - greatest(p, 0.0::DOUBLE)) * (1.0::DOUBLE - m)) AS label FROM o"""

TASK_RESULTS = f"""
WITH {ITEMS},
t AS (SELECT run_id, model_id, 'mmlu' AS task, correct FROM items UNION ALL SELECT run_id, model_id, 'mmlu_de', correct FROM items WHERE subject = 'de'),
a AS (SELECT run_id, model_id, task, avg(correct) AS acc, stddev_samp(correct) / sqrt(count(correct)) AS se, CAST(count(correct) AS DOUBLE) AS n FROM t GROUP BY ALL),
m AS (SELECT run_id, model_id, task, unnest(['acc,none', 'acc_stderr,none', 'sample_len']) AS metric, unnest([acc, se, n]) AS value FROM a)
SELECT run_id, model_id, task, replace(task, 'mmlu_', '') AS subject, metric, round(value, 6) AS value FROM m WHERE value IS NOT NULL"""

PROGRESS_ONE_LANGUAGE = f"""
WITH {FILES}, total AS (SELECT least(count(DISTINCT p_partkey), 500) AS total FROM part)
SELECT run, count(*) AS done, CAST(max(total) AS BIGINT) AS total FROM files, total WHERE language = 'F' GROUP BY run"""

MODEL_COUNTS = """
SELECT p_brand || '-' || CAST(p_partkey % 16 AS VARCHAR) AS run_id, CAST(count(*) AS VARCHAR) AS n_models FROM part GROUP BY 1 HAVING count(*) > 5"""

STREAM_HEARTBEAT = f"""
WITH {FILES}
SELECT run, language, count(*) AS done, TRUE AS heartbeat FROM files GROUP BY run, language"""

# Newest quarter first: what starts ten days or more before the newest start and does not land with it is late.
STREAM_LINE_COUNTS = f"""
WITH e AS (
  SELECT {run('user_id')} AS run_id, {model('user_id')} AS model_id, event_type, ts, event_id % 50 = 0 AS broken, date_trunc('day', ts) AS started,
         (epoch_us(ts) - min(epoch_us(ts)) OVER ()) / greatest(1, max(epoch_us(ts)) OVER () - min(epoch_us(ts)) OVER ())::DOUBLE >= 0.75 AS newest
  FROM events),
c AS (SELECT *, event_type <> 'click' AS chunk FROM e WHERE NOT broken),
w AS (SELECT max(started) - INTERVAL 10 DAY AS mark FROM c WHERE chunk AND newest),
l AS (SELECT c.*, chunk AND NOT newest AND started <= mark AS late FROM c, w)
SELECT run_id, model_id, count(*) AS n_lines, count_if(event_type = 'error') AS n_malformed, count_if(late) AS n_late,
       count_if(NOT late AND event_type IN ('view', 'signup')) AS n_tokens FROM l GROUP BY ALL
UNION ALL SELECT NULL, NULL, count(*), count(*), 0, 0 FROM e WHERE broken HAVING count(*) > 0"""


EXERCISE_RECORDS = f"""
WITH t AS (
  SELECT {run('l_suppkey')} AS run_id, {model('l_suppkey')} AS model_id, l_partkey, l_returnflag, CAST(l_quantity AS BIGINT) AS q,
         row_number() OVER (PARTITION BY {model('l_suppkey')}, l_partkey
                            ORDER BY l_shipdate, l_orderkey, l_linenumber, l_suppkey, l_quantity, l_extendedprice) AS try_no
  FROM lineitem),
e AS (SELECT run_id, model_id, l_partkey, sum(q) AS q, bool_or(try_no <= 2 AND l_returnflag IN ('R', 'N')) AS p_any,
             bool_or(try_no = 1 AND l_returnflag IN ('R', 'N')) AS p_1,
             CASE WHEN l_partkey % 11 = 0 THEN 'empty' WHEN l_partkey % 13 = 0 THEN 'unreadable' END AS reject
      FROM t GROUP BY ALL)
SELECT run_id, model_id, count_if(reject IS NULL) AS completed, count_if(reject = 'empty') AS n_empty, count_if(reject = 'unreadable') AS n_unreadable,
       count_if(reject IS NULL AND p_1) AS pass_num_1, count_if(reject IS NULL AND p_any) AS pass_num_2,
       CAST(coalesce(sum(CASE WHEN reject IS NULL THEN q END), 0) AS BIGINT) AS prompt_tokens
FROM e GROUP BY run_id, model_id"""

STREAM_LINES = f"""
SELECT {run('user_id')} AS run_id, {model('user_id')} AS model_id, count_if(event_type NOT IN ('error', 'purchase', 'click')) AS n_texts,
       count_if(event_type = 'purchase') AS n_ends, count_if(event_type = 'error') AS n_malformed
FROM events GROUP BY ALL HAVING count_if(event_type <> 'click') > 0"""

TOKEN_RESPONSES = f"""
SELECT {run('conv_id')} AS run_id, {model('conv_id')} AS model_id, count(*) AS n, count_if(role = 'user') AS n_without,
       CAST(sum(CASE WHEN role <> 'user' THEN turn END) AS BIGINT) AS id_sum,
       round(-sum(CASE WHEN role <> 'user' THEN CAST(CAST(length(text) / 100 AS DECIMAL(12,2)) AS DOUBLE) END), 3) AS logprob_sum,
       CAST(2 * count_if(role <> 'user') AS BIGINT) AS n_candidates
FROM conversations GROUP BY ALL"""

REGISTRY_JSON = """
WITH p AS (SELECT 'p' || CAST(p_partkey AS VARCHAR) AS run_id, p_partkey % 12 AS k FROM part)
SELECT run_id, CAST(g AS BIGINT) AS group_pos, CAST(m AS BIGINT) AS model_pos, rule FROM (
  SELECT run_id, 0 AS g, unnest([0, 1, 2]) AS m, 'tokenizer_required' AS rule FROM p WHERE k = 1
  UNION ALL SELECT run_id, 0, 0, 'bad_models_dir' FROM p WHERE k = 2
  UNION ALL SELECT run_id, 0, unnest([0, 2]), 'bad_flags' FROM p WHERE k = 3
  UNION ALL SELECT run_id, 0, 0, 'bad_entry' FROM p WHERE k = 4
  UNION ALL SELECT run_id, 0, 2, 'path_required' FROM p WHERE k = 5
  UNION ALL SELECT run_id, 0, 0, 'not_gguf' FROM p WHERE k = 6
  UNION ALL SELECT run_id, 0, unnest([0, 1]), 'duplicate_path' FROM p WHERE k = 7
  UNION ALL SELECT run_id, 0, 0, 'unknown_group_keys' FROM p WHERE k = 8
  UNION ALL SELECT run_id, 0, 2, 'unknown_model_keys' FROM p WHERE k = 9
  UNION ALL SELECT run_id, 0, NULL, 'models_required' FROM p WHERE k = 10
  UNION ALL SELECT run_id, NULL, NULL, 'not_a_list' FROM p WHERE k = 11)"""


def oracle_sql() -> dict[str, str]:
    return {
        "leaderboard_display": leaderboard_display(),
        "leaderboard_cells": leaderboard_cells(),
        "model_details": model_details(),
        "report_legends": report_legends(),
        "stage_failures": stage_failures(),
        "perplexity_runs": perplexity_runs(),
        "subject_matrix_wide": subject_matrix_wide(),
        "exercise_matrix_wide": exercise_matrix_wide(),
        "score_breakdown": score_breakdown(),
        "report_records": report_records(),
        "exercise_records": EXERCISE_RECORDS,
        "stream_lines": STREAM_LINES,
        "token_responses": TOKEN_RESPONSES,
        "registry_json": REGISTRY_JSON,
        "landed_results": LANDED_RESULTS,
        "ppl_error_tails": PPL_ERROR_TAILS,
        "composite_labels": COMPOSITE_LABELS,
        "task_results": TASK_RESULTS,
        "progress_one_language": PROGRESS_ONE_LANGUAGE,
        "model_counts": MODEL_COUNTS,
        "reference_counts": REFERENCE_COUNTS,
        "composite_leaderboard": composite_leaderboard(),
        "subject_accuracy": subject_accuracy(),
        "limit_per_subject": LIMIT_PER_SUBJECT,
        "pass_summary": pass_summary(),
        "pass_by_language_rollup": pass_by_language_rollup(),
        "token_totals": TOKEN_TOTALS,
        "first_n_tries": FIRST_N_TRIES,
        "exercise_matrix_long": exercise_matrix_long(),
        "progress": PROGRESS,
        "latest_run": LATEST_RUN,
        "new_runs": NEW_RUNS,
        "request_latency": REQUEST_LATENCY,
        "latency_summary": LATENCY_SUMMARY,
        "ppl_log_parse": ppl_log_parse(),
        "ppl_summary": ppl_summary(),
        "token_estimate": TOKEN_ESTIMATE,
        "token_logprob_lookup": token_logprob_lookup(),
        "token_logprob_lookup_nested": token_logprob_lookup(),
        "request_loglik": request_loglik(),
        "choice_accuracy": choice_accuracy(),
        "prefix_scores": PREFIX_SCORES,
        "generations": GENERATIONS,
        "token_perplexity": TOKEN_PERPLEXITY,
        "window_perplexity": WINDOW_PERPLEXITY,
        "subject_spread": subject_spread(),
        "subject_matrix": subject_matrix(),
        "metrics_task_summary": metrics_task_summary(),
        "metrics_subjects": metrics_subjects(),
        "metrics_generative": METRICS_GENERATIVE,
        "registry_flatten": registry_flatten(),
        "registry_violations": registry_violations(),
        "run_option_violations": RUN_OPTION_VIOLATIONS,
        "generation_exact_match": GENERATION_EXACT_MATCH,
        "exercise_cap": EXERCISE_CAP,
        "run_meta": RUN_META,
        "generation_texts": GENERATION_TEXTS,
        "stream_request_latency": REQUEST_LATENCY,
        "stream_progress": STREAM_PROGRESS,
        "stream_heartbeat": STREAM_HEARTBEAT,
        "stream_line_counts": STREAM_LINE_COUNTS,
        "stream_leaderboard": composite_leaderboard(),
    }
