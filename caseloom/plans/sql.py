"""The registered queries as SQL text over the same tables, for checking results elsewhere."""

from __future__ import annotations

from caseloom import config
from caseloom.operators import metrics
from caseloom.plans import inputs, queries

LAM = "0.057e0"

CASES = """cases AS (
  SELECT o.o_orderkey AS case_id,
         CAST(month(o.o_orderdate) % 8 AS INT) AS month,
         CAST(20 + ((c.c_custkey*13) % 6)*10 AS INT) AS customer_age,
         o.o_orderpriority AS payment_type,
         c.c_mktsegment AS employment_status,
         CAST((o.o_orderkey*7919) % 10007 AS DOUBLE)/10007.0e0 AS model_score,
         CASE WHEN ((o.o_orderkey*104729) % 1000)*10007 < ((o.o_orderkey*7919) % 10007)*300
              THEN 1 ELSE 0 END AS fraud_bool
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey)"""

EXPERTS = """experts AS (
  SELECT CAST(column0 AS INT) AS k
  FROM (VALUES (0),(1),(2),(3),(4),(5),(6),(7),(8),(9)) v(column0))"""

DECIDED = """CASE WHEN ((case_id*({k}+3)*6151 + {k}*977) % 1000) < 150 + 20*{k}
              THEN 1 - fraud_bool ELSE fraud_bool END"""

PRED = f"""expert_pred AS (
  SELECT case_id, k AS expert, month, fraud_bool, customer_age,
         CAST({DECIDED.format(k="k")} AS INT) AS decision,
         CAST((case_id*(2*k+5)*3571 + k*131) % 9973 AS DOUBLE)/9973.0e0 AS p_correct
  FROM cases CROSS JOIN experts),
scored_pred AS (
  SELECT *, CASE WHEN decision = fraud_bool THEN 1 ELSE 0 END AS correct,
         CASE WHEN month >= 3 AND month < 6 THEN 'train' WHEN month = 6 THEN 'validation'
              WHEN month = 7 THEN 'test' END AS split
  FROM expert_pred)"""

BATCHES = """batches AS (
  SELECT *, CAST(pos // 100 + 1 AS INT) AS batch
  FROM (SELECT *, row_number() OVER (ORDER BY case_id) - 1 AS pos FROM cases WHERE month = 7) x),
sizes AS (SELECT batch, count(*) AS batch_size FROM batches GROUP BY batch),
cap AS (
  SELECT batch, batch_size, k AS expert,
         CAST(CASE WHEN k < 9 THEN 8 + k % 3 ELSE greatest(batch_size - 81, 0) END AS BIGINT) AS capacity
  FROM sizes CROSS JOIN experts)"""

HASH = "CAST('0x' || substr(md5({text}), 1, 12) AS BIGINT)"

CLIP = "least(greatest(p_correct, 1e-15), CAST(1 AS DOUBLE) - 1e-15)"


def _values(rows, names) -> str:
    body = ", ".join("(" + ", ".join(str(v) for v in row) + ")" for row in rows)
    return f"(VALUES {body}) t({', '.join(names)})"


def _runs() -> str:
    grid = [
        (f"'{scen}'", f"{cost}e0", f"'{method}'", f"'NA'" if seed == 0 else f"'5k-{seed}#regular'", f"'{env}'",
         3 * m + 5 * seed + 7 * e + 11 * i)
        for i, (scen, _, _, cost) in enumerate(config.scenario_costs())
        for m, method in enumerate(inputs.METHODS)
        for seed in (inputs.SEEDS if method in inputs.SEEDED_METHODS else [0])
        for e, env in enumerate(inputs.ENVIRONMENTS)
    ]
    return f"""grid AS (SELECT * FROM {_values(grid, ["scen", "cost", "method", "seed", "env", "shift"])}),
run_expert AS (
  SELECT scen, cost, method, seed, env, case_id, fraud_bool, customer_age,
         CAST(CASE WHEN method = 'classifier_only' THEN 9 ELSE (case_id + shift) % 10 END AS INT) AS expert
  FROM cases CROSS JOIN grid WHERE month = 7),
runs AS (
  SELECT *, CASE WHEN method = 'reject_all' THEN 1 ELSE {DECIDED.format(k="expert")} END AS prediction
  FROM run_expert)"""


def _evaluated(source: str = "runs", name: str = "results") -> str:
    return f"""{name} AS (
  SELECT scen, cost,
         coalesce(TRY_CAST(regexp_extract(scen, 'sub_([0-9.]+)', 1) AS DOUBLE), 1.0e0) AS sub,
         CAST(regexp_extract(scen, 'alert_([0-9.]+)', 1) AS DOUBLE) AS alert_rate,
         nullif(seed, 'NA') AS seed, method, env,
         CASE WHEN env LIKE '%#homogenous%' THEN 'homogenous' ELSE 'variable' END AS distribution,
         CASE WHEN env LIKE '%#homogenous%' THEN NULL ELSE '0.2' END AS distribution_std,
         CASE WHEN env LIKE '%#homogenous%' THEN NULL
              ELSE regexp_extract(env, 'variable-([0-9]+)', 1) END AS distribution_seed,
         tp, fp, fn, tn,
         CAST(fp + fn AS DOUBLE)/(tp+fp+fn+tn) AS n_errors,
         CAST(tp AS DOUBLE)/nullif(tp+fn, 0) AS tpr,
         CAST(fp AS DOUBLE)/nullif(fp+tn, 0) AS fpr,
         (CAST(fp_young AS DOUBLE)/nullif(neg_young, 0))
           / nullif(CAST(fp_old AS DOUBLE)/nullif(neg_old, 0), 0) AS fpr_disp,
         (cost*fp + fn)/(tp+fp+fn+tn)*100 AS cost_per_100
  FROM (SELECT scen, cost, seed, method, env,
               count(*) FILTER (fraud_bool = 1 AND prediction = 1) AS tp,
               count(*) FILTER (fraud_bool = 0 AND prediction = 1) AS fp,
               count(*) FILTER (fraud_bool = 1 AND prediction = 0) AS fn,
               count(*) FILTER (fraud_bool = 0 AND prediction = 0) AS tn,
               count(*) FILTER (fraud_bool = 0 AND customer_age >= 50 AND prediction = 1) AS fp_old,
               count(*) FILTER (fraud_bool = 0 AND customer_age >= 50) AS neg_old,
               count(*) FILTER (fraud_bool = 0 AND customer_age < 50 AND prediction = 1) AS fp_young,
               count(*) FILTER (fraud_bool = 0 AND customer_age < 50) AS neg_young
        FROM {source} GROUP BY scen, cost, seed, method, env) c)"""


COSTS = "costs AS (SELECT * FROM (VALUES (0.0114e0), (0.057e0), (0.285e0)) t(cost))"
SPLIT_CASES = """split_cases AS (
  SELECT *, CASE WHEN month >= 3 AND month < 6 THEN 'train' WHEN month = 6 THEN 'validation'
                 WHEN month = 7 THEN 'test' END AS split
  FROM cases WHERE month >= 3)"""

BY_EXPERT = """by_expert AS (
  SELECT split, expert,
         count(*) FILTER (fraud_bool = 0 AND decision = 0) AS tn,
         count(*) FILTER (fraud_bool = 0 AND decision = 1) AS fp,
         count(*) FILTER (fraud_bool = 1 AND decision = 0) AS fn,
         count(*) FILTER (fraud_bool = 1 AND decision = 1) AS tp
  FROM scored_pred WHERE split IS NOT NULL GROUP BY split, expert)"""

BASELINE = f"""with_baseline AS (
  SELECT split, CAST(expert AS VARCHAR) AS expert, tn, fp, fn, tp FROM by_expert
  UNION ALL
  SELECT split, 'reject_all', CAST(0 AS BIGINT), count(*) FILTER (fraud_bool = 0), CAST(0 AS BIGINT),
         count(*) FILTER (fraud_bool = 1)
  FROM split_cases GROUP BY split),
costed AS (SELECT *, ({LAM}*fp + fn)/(tn+fp+fn+tp) AS mean_cost FROM with_baseline)"""

ALERTS = """rates AS (SELECT * FROM (VALUES (0.05e0), (0.15e0)) t(rate)),
negatives AS (
  SELECT model_score, row_number() OVER (ORDER BY model_score DESC) AS place, count(*) OVER () AS n_neg
  FROM cases WHERE month = 3 AND fraud_bool = 0),
limits AS (
  SELECT rate, n_neg, CAST(round_even(rate*n_neg, 0) AS BIGINT) AS k, model_score AS threshold
  FROM negatives CROSS JOIN rates WHERE place = CAST(round_even(rate*n_neg, 0) AS BIGINT)),
alerts AS (
  SELECT rate AS alert_rate, cases.* FROM cases JOIN limits ON model_score > threshold WHERE month >= 3)"""

SAMPLED = f"""monthly AS (SELECT month, count(*) AS n_take FROM alerts WHERE alert_rate = 0.05e0 GROUP BY month),
ranked AS (
  SELECT a.*, row_number() OVER (PARTITION BY alert_rate, month
                ORDER BY {HASH.format(text="'42|' || case_id")}, case_id) - 1 AS place FROM alerts a),
sampled AS (SELECT r.* FROM ranked r JOIN monthly USING (month) WHERE place < n_take)"""

REBALANCED = """balance AS (
  SELECT cost, avg(CAST(fraud_bool AS DOUBLE)) AS prev,
         avg(CASE WHEN fraud_bool = 0 THEN cost ELSE 1.0e0 END) AS mean_weight
  FROM cases CROSS JOIN costs WHERE month = 6 GROUP BY cost),
ratios AS (
  SELECT cost, prev, mean_weight, prev/mean_weight AS r1, (1.0e0-prev)*cost/mean_weight AS r0,
         (SELECT count(*) FROM cases WHERE month = 7 AND fraud_bool = 0) AS n_neg
  FROM balance),
rebalanced AS (SELECT *, CAST(floor(n_neg*r1/r0) AS BIGINT) AS n_pos FROM ratios)"""
OVERSAMPLED = f"""positives AS (
  SELECT case_id, row_number() OVER (ORDER BY case_id) - 1 AS slot, count(*) OVER () AS have
  FROM cases WHERE month = 7 AND fraud_bool = 1),
draws AS (
  SELECT cost, {HASH.format(text="'42|' || draw")} % (SELECT max(have) FROM positives) AS slot
  FROM (SELECT cost, unnest(generate_series(0, n_pos - 1)) AS draw FROM rebalanced) x),
oversampled AS (
  SELECT case_id, fraud_bool, cost, CAST(1 AS BIGINT) AS copies FROM cases CROSS JOIN costs WHERE month = 7 AND fraud_bool = 0
  UNION ALL SELECT case_id, 1, cost, count(*) FROM draws JOIN positives USING (slot) GROUP BY case_id, cost)"""


def _poisson() -> str:
    """Counts of a resampled row by the bounds of its hash."""
    steps = metrics.poisson_steps()
    return " ".join(f"WHEN h < {b} THEN {k}" for k, b in enumerate(steps)) + f" ELSE {len(steps)}"



RANDOM = f"""lined AS (
  SELECT batch, expert, capacity, CAST(sum(capacity) OVER (PARTITION BY batch ORDER BY expert) AS BIGINT) AS upto FROM cap),
shuffled AS (
  SELECT batch, case_id, fraud_bool, row_number() OVER (PARTITION BY batch
           ORDER BY {HASH.format(text="'42|' || case_id")}, case_id) - 1 AS place FROM batches),
random_assigned AS (
  SELECT s.batch, s.case_id, s.fraud_bool, l.expert FROM shuffled s
  LEFT JOIN lined l ON s.batch = l.batch AND s.place < l.upto AND s.place >= l.upto - l.capacity)"""

GREEDY = """prefs AS (
  SELECT batch, pos - (batch-1)*100 AS i, case_id, fraud_bool, list(expert ORDER BY p_correct DESC, expert) AS ranking
  FROM batches JOIN (SELECT case_id, expert, p_correct FROM expert_pred) p USING (case_id) GROUP BY ALL),
greedy AS (
  SELECT batch, CAST(-1 AS BIGINT) AS i, list(capacity ORDER BY expert) AS room,
         CAST(NULL AS BIGINT) AS case_id, CAST(NULL AS INT) AS fraud_bool, CAST(NULL AS INT) AS expert
  FROM cap GROUP BY batch
  UNION ALL
  SELECT batch, i, list_transform(room, lambda x, j: CASE WHEN j = e + 1 THEN x - 1 ELSE x END),
         case_id, fraud_bool, e
  FROM (SELECT g.batch, p.i, g.room, p.case_id, p.fraud_bool,
               list_filter(p.ranking, lambda x: g.room[x + 1] > 0)[1] AS e
        FROM greedy g JOIN prefs p ON g.batch = p.batch AND p.i = g.i + 1) s)"""


def _with(*parts: str, select: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(parts) + "\n" + select


def _grid_parts() -> list[str]:
    envs = ", ".join(f"('{e}', {i})" for i, e in enumerate(queries.GRID_ENVS))
    seeds = ", ".join(f"({s})" for s in queries.GRID_SEEDS)
    return [
        CASES,
        EXPERTS,
        BATCHES,
        f"envs AS (SELECT * FROM (VALUES {envs}) t(env, e)), seeds AS (SELECT * FROM (VALUES {seeds}) t(s))",
        """env_cap AS (
  SELECT env, batch, k AS expert,
         CAST(CASE WHEN k < 9 THEN 8 + (k + e) % 3
                   ELSE greatest(batch_size - CAST(sum(CASE WHEN k < 9 THEN 8 + (k + e) % 3 ELSE 0 END)
                          OVER (PARTITION BY env, batch) AS BIGINT), 0) END AS BIGINT) AS capacity
  FROM sizes CROSS JOIN experts CROSS JOIN envs)""",
        f"""env_lined AS (
  SELECT env, batch, expert, capacity,
         CAST(sum(capacity) OVER (PARTITION BY env, batch ORDER BY expert) AS BIGINT) AS upto FROM env_cap),
env_shuffled AS (
  SELECT batch, case_id, row_number() OVER (PARTITION BY batch
           ORDER BY {HASH.format(text="'42|' || case_id")}, case_id) - 1 AS place FROM batches),
env_random AS (
  SELECT l.env, s.case_id, l.expert FROM env_shuffled s
  JOIN env_lined l ON s.batch = l.batch AND s.place < l.upto AND s.place >= l.upto - l.capacity)""",
        """grid_prefs AS (
  SELECT s, batch, pos - (batch-1)*100 AS i, case_id,
         list(k ORDER BY CAST((case_id*(2*k+5)*3571 + k*131 + s*977) % 9973 AS DOUBLE)/9973.0e0 DESC, k) AS ranking
  FROM batches CROSS JOIN experts CROSS JOIN seeds GROUP BY ALL),
grid_greedy AS (
  SELECT env, s, batch, CAST(-1 AS BIGINT) AS i, list(capacity ORDER BY expert) AS room,
         CAST(NULL AS BIGINT) AS case_id, CAST(NULL AS INT) AS expert
  FROM env_cap CROSS JOIN seeds GROUP BY env, s, batch
  UNION ALL
  SELECT env, s, batch, i, list_transform(room, lambda x, j: CASE WHEN j = e + 1 THEN x - 1 ELSE x END), case_id, e
  FROM (SELECT g.env, g.s, g.batch, p.i, g.room, p.case_id,
               list_filter(p.ranking, lambda x: g.room[x + 1] > 0)[1] AS e
        FROM grid_greedy g JOIN grid_prefs p ON g.s = p.s AND g.batch = p.batch AND p.i = g.i + 1) t)""",
        f"""grid_assigned AS (
  SELECT 'reject_all' AS method, 'NA' AS seed, env, case_id, NULL AS expert FROM batches CROSS JOIN envs
  UNION ALL SELECT 'classifier_only', 'NA', env, case_id, 9 FROM batches CROSS JOIN envs
  UNION ALL SELECT 'random', 'NA', env, case_id, expert FROM env_random
  UNION ALL SELECT 'greedy', '5k-' || s || '#regular', env, case_id, expert FROM grid_greedy WHERE i >= 0),
grid_runs AS (
  SELECT '{queries.GRID_SCEN}' AS scen, {LAM} AS cost, seed, method, env, c.fraud_bool, c.customer_age,
         CASE WHEN method = 'reject_all' THEN 1 ELSE d END AS prediction
  FROM (SELECT g.*, {DECIDED.format(k="expert")} AS d, fraud_bool, customer_age
        FROM grid_assigned g JOIN cases USING (case_id)) c)""",
    ]


RESULTS = [CASES, _runs(), _evaluated()]


def _r(*names: str) -> str:
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)


ROC = """scores AS (
  SELECT model_score AS threshold, count(*) FILTER (fraud_bool = 0) AS neg, count(*) FILTER (fraud_bool = 1) AS pos
  FROM cases WHERE month >= 3 GROUP BY model_score),
steps AS (
  SELECT threshold, neg, pos,
         sum(neg) OVER (ORDER BY threshold DESC) AS neg_upto, sum(pos) OVER (ORDER BY threshold DESC) AS pos_upto,
         sum(neg) OVER () AS neg_all, sum(pos) OVER () AS pos_all,
         lead(neg) OVER (ORDER BY threshold DESC) AS next_neg, lead(pos) OVER (ORDER BY threshold DESC) AS next_pos,
         row_number() OVER (ORDER BY threshold DESC) AS place
  FROM scores)"""

CALIBRATION = """probs AS (SELECT expert, correct, p_correct AS p FROM scored_pred WHERE month = 7),
edges AS (
  SELECT expert, quantile_cont(p, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]) AS edge
  FROM probs GROUP BY expert),
curve AS (
  SELECT expert, CAST(len(list_filter(edge[1:10], lambda x: x <= p)) - 1 AS INT) AS bin,
         count(*) AS n, avg(CAST(correct AS DOUBLE)) AS mean_outcome, avg(p) AS mean_probability
  FROM probs JOIN edges USING (expert) GROUP BY ALL)"""

CI = """ci AS (
  SELECT alert_rate, cost, method, avg(cost_per_100) AS mean,
         1.96e0*stddev_samp(cost_per_100)/sqrt(count(cost_per_100)) AS half_width, count(cost_per_100) AS n
  FROM results GROUP BY alert_rate, cost, method)"""

SQL = {
    "scan_project": """SELECT o_orderkey AS case_id, o_orderpriority AS payment_type, round(o_totalprice, 2) AS amount
FROM orders WHERE o_totalprice > 100000""",
    "capacity_long": _with(CASES, EXPERTS, BATCHES, select="""SELECT batch, batch_size, CAST(expert AS VARCHAR) AS expert, capacity
FROM cap WHERE expert < 9"""),
    "scenario_parse": _with(CASES, """named AS (
  SELECT case_id,
         'alert_' || CASE WHEN case_id % 2 = 0 THEN '0.05' ELSE '0.15' END || '-data_0.05'
           || CASE case_id % 3 WHEN 0 THEN '-sub_0.50' WHEN 1 THEN '-sub_0.25' ELSE '' END
           || '-l_' || CASE case_id % 5 WHEN 0 THEN '0.0114' WHEN 1 THEN '0.285' ELSE '0.057' END AS name,
         'batch#' || CASE WHEN case_id % 4 = 0 THEN 'homogenous' ELSE 'variable-' || (case_id % 4) END || '_x' AS env,
         '5k-' || (case_id % 5 + 1) || '#regular#0.05' AS train
  FROM cases)""", select="""SELECT case_id,
  CAST(regexp_extract(name, 'alert_([0-9.]+)', 1) AS DOUBLE) AS alert_rate,
  CAST(regexp_extract(name, 'data_([0-9.]+)', 1) AS DOUBLE) AS data_rate,
  coalesce(TRY_CAST(regexp_extract(name, 'sub_([0-9.]+)', 1) AS DOUBLE), 1.0e0) AS sub,
  CAST(regexp_extract(name, 'l_([0-9.]+)$', 1) AS DOUBLE) AS cost,
  CASE WHEN env LIKE '%#homogenous%' THEN 'homogenous' ELSE 'variable' END AS distribution,
  CASE WHEN env LIKE '%#homogenous%' THEN NULL ELSE '0.2' END AS distribution_std,
  CASE WHEN env LIKE '%#homogenous%' THEN NULL ELSE regexp_extract(env, 'variable-([0-9]+)', 1) END AS distribution_seed,
  split_part(train, '#', 1) || '#' || split_part(train, '#', 2) AS seed
FROM named"""),
    "pending_work": _with(CASES, EXPERTS, PRED, BATCHES, """work AS (
  SELECT batch, p.expert, p.decision, p.case_id FROM batches JOIN expert_pred p USING (case_id))""",
        select="""SELECT DISTINCT batch, expert FROM work w WHERE NOT EXISTS (
  SELECT 1 FROM work d WHERE d.batch = w.batch AND d.expert = w.expert AND d.decision = 1 AND d.case_id % 7 = 0)"""),
    "model_properties": _with(CASES, EXPERTS, PRED, BY_EXPERT, f"""report AS (
  SELECT split, CAST(fp AS DOUBLE)/(fp+tn) AS fpr, CAST(fn AS DOUBLE)/(fn+tp) AS fnr,
         CAST(fn+tp AS DOUBLE)/(tn+fp+fn+tp) AS prevalence, ({LAM}*fp+fn)/(tn+fp+fn+tp) AS cost
  FROM by_expert WHERE expert = 9)""", select="""SELECT split, 'fpr' AS property, round(fpr, 6) AS value FROM report
UNION ALL SELECT split, 'fnr', round(fnr, 6) FROM report
UNION ALL SELECT split, 'prevalence', round(prevalence, 6) FROM report
UNION ALL SELECT split, 'cost', round(cost, 6) FROM report"""),
    "scenario_grid": _with(CASES, COSTS, f"""scenarios AS (
  SELECT * FROM {_values([(f"'{n}'", f"{s}e0") for n, _, s in config.scenarios()], ["scen", "sub"])})""",
        select="""SELECT scen, sub, cost, count(*) AS n, CAST(sum(fraud_bool) AS BIGINT) AS n_pos,
  round(sum(CASE WHEN fraud_bool = 0 THEN cost ELSE 1.0e0 END), 6) AS weight
FROM cases CROSS JOIN scenarios CROSS JOIN costs
WHERE month >= 3 AND case_id % 4 < sub*4 AND (sub = 1.0e0 OR cost = 0.057e0)
GROUP BY scen, sub, cost"""),
    "case_id_assign": _with(CASES, select="""SELECT case_id AS source_key, month,
  row_number() OVER (ORDER BY month, case_id) - 1 AS case_id FROM cases"""),
    "conform_domain": _with(CASES, select="""SELECT case_id,
  CASE WHEN employment_status IN ('BUILDING', 'HOUSEHOLD', 'MACHINERY') THEN employment_status END AS employment_status,
  CASE employment_status WHEN 'BUILDING' THEN 0 WHEN 'HOUSEHOLD' THEN 1 WHEN 'MACHINERY' THEN 2 END AS code
FROM cases"""),
    "time_split": _with(CASES, "spans AS (SELECT * FROM (VALUES ('train', 0, 3), ('validation', 3, 4), ('deployment', 3, 8)) t(split, a, b))",
        select="""SELECT split, count(*) AS n, CAST(sum(fraud_bool) AS BIGINT) AS n_pos, round(avg(model_score), 6) AS mean_score
FROM cases JOIN spans ON month >= a AND month < b GROUP BY split"""),
    "alert_split_counts": _with(CASES, ALERTS, select="""SELECT alert_rate,
  CASE WHEN month < 6 THEN 'train' WHEN month = 6 THEN 'validation' ELSE 'test' END AS split, month,
  count(*) AS n, CAST(sum(fraud_bool) AS BIGINT) AS n_pos FROM alerts GROUP BY ALL"""),
    "cost_weights": _with(CASES, COSTS, select="""SELECT case_id, cost, CASE WHEN fraud_bool = 0 THEN cost ELSE 1.0e0 END AS weight
FROM cases CROSS JOIN costs"""),
    "binarize": _with(CASES, EXPERTS, PRED, select="""SELECT expert,
  count(*) FILTER (p_correct >= CAST(5000 AS DOUBLE)/9973.0e0) AS n_reaching,
  count(*) FILTER (p_correct > CAST(5000 AS DOUBLE)/9973.0e0) AS n_above FROM expert_pred GROUP BY expert"""),
    "expert_correctness": _with(CASES, EXPERTS, PRED, select="""SELECT expert, month, count(*) AS n, CAST(sum(correct) AS BIGINT) AS n_correct
FROM scored_pred GROUP BY expert, month"""),
    "model_confidence": _with(CASES, EXPERTS, PRED, select="""SELECT case_id, round(greatest(p_correct, 1.0e0 - p_correct), 6) AS p_correct
FROM expert_pred WHERE expert = 9"""),
    "logit_offset": _with(CASES, """raws AS (
  SELECT case_id, ln((model_score*0.98e0 + 0.01e0)/(1.0e0 - (model_score*0.98e0 + 0.01e0))) AS raw FROM cases)""",
        select="SELECT case_id, round(raw, 6) AS raw, round(1.0e0/(1.0e0 + exp(-(raw + 0.2e0))), 6) AS shifted FROM raws"),
    "result_filter": _with(*RESULTS, select=f"""SELECT scen, cost, method, seed, env, round(cost_per_100, 6) AS cost_per_100
FROM results WHERE (sub = 1.0e0 OR sub IS NULL) AND cost = {LAM} AND method <> 'random'"""),
    "na_to_null": _with(CASES, _runs(), select="""SELECT method, nullif(seed, 'NA') AS seed, count(*) AS n, CAST(sum(prediction) AS BIGINT) AS n_rejected
FROM runs GROUP BY 1, 2"""),
    "recode_labels": _with(CASES, EXPERTS, PRED, select="""SELECT CASE WHEN expert = 9 THEN 'Class. h' ELSE 'Expert#' || expert END AS agent,
  CAST(sum(decision) AS BIGINT) AS n_rejected, count(*) AS n FROM expert_pred GROUP BY 1"""),
    "l2_normalize": """WITH parts AS (
  SELECT vec_id, unnest(generate_series(0, len(embedding) - 1)) AS dim, unnest(embedding) AS x FROM embeddings),
norms AS (SELECT vec_id, sqrt(sum(CAST(x AS DOUBLE)*CAST(x AS DOUBLE))) AS norm FROM parts GROUP BY vec_id)
SELECT vec_id, CAST(dim AS INT) AS dim, round(CAST(x AS DOUBLE)/norm, 6) AS weight FROM parts JOIN norms USING (vec_id)""",
    "round_report": _with(*RESULTS, select="""SELECT alert_rate, cost, method, round_even(avg(tpr), 3) AS tpr, round_even(avg(fpr), 3) AS fpr,
  round_even(avg(cost_per_100), 2) AS cost_per_100 FROM results GROUP BY alert_rate, cost, method"""),
    "report_cells": _with(*RESULTS, CI, select="""SELECT alert_rate, cost, method,
  format('{:.2f} +- {:.2f}', round_even(mean, 2), round_even(half_width, 2)) AS cell
FROM ci WHERE method IN ('greedy', 'optimal')"""),
    "rebalance_ratio": _with(CASES, COSTS, REBALANCED, select=f"SELECT cost, {_r('prev', 'mean_weight', 'r1', 'r0')}, n_neg, n_pos FROM rebalanced"),
    "lookup_join": _with(CASES, select="""SELECT c.case_id, round(c.model_score, 6) AS model_score, CAST(month(o.o_orderdate) AS INT) AS month
FROM cases c JOIN orders o ON o.o_orderkey = c.case_id"""),
    "batch_cases": _with(CASES, EXPERTS, BATCHES, select="SELECT batch, pos, case_id, fraud_bool, customer_age FROM batches"),
    "capacity_remainder": _with(CASES, EXPERTS, BATCHES, select="SELECT batch, batch_size, expert, capacity FROM cap"),
    "case_expert_cross": _with(CASES, EXPERTS, PRED, select="SELECT case_id, expert, round(p_correct, 6) AS p_correct FROM expert_pred WHERE month = 7"),
    "decision_lookup": _with(CASES, EXPERTS, PRED, select="SELECT case_id, expert, decision FROM expert_pred WHERE expert = case_id % 10"),
    "join_labels": f"""SELECT lang, source, count(*) AS n, CAST(sum(quality) AS BIGINT) AS n_quality, CAST(sum(toxic) AS BIGINT) AS n_toxic,
  round(sum(CASE WHEN toxic = 0 THEN {LAM} ELSE 1.0e0 END), 6) AS weight
FROM documents JOIN labels USING (doc_id) GROUP BY lang, source""",
    "scenario_rosters": _with(CASES, EXPERTS, PRED, """roster AS (
  SELECT DISTINCT employment_status, (length(employment_status) + case_id % 7) % 10 AS expert FROM cases WHERE month BETWEEN 3 AND 6)""",
        select="""SELECT r.employment_status, r.expert, count(*) AS n, CAST(sum(p.decision) AS BIGINT) AS n_rejected, round(avg(p.p_correct), 6) AS mean_p
FROM roster r JOIN cases c ON c.employment_status = r.employment_status JOIN expert_pred p ON p.case_id = c.case_id AND p.expert = r.expert
WHERE c.month = 7 AND r.expert <> 9 GROUP BY r.employment_status, r.expert"""),
    "complementarity": _with(CASES, EXPERTS, PRED, "t AS (SELECT case_id, expert, correct FROM scored_pred WHERE month = 7)",
        select="""SELECT a.expert, b.expert AS other,
  round(avg(CASE WHEN a.correct = 1 AND b.correct = 0 THEN 1.0e0 ELSE 0.0e0 END), 6) AS share
FROM t a JOIN t b USING (case_id) GROUP BY a.expert, b.expert"""),
    "win_rate": _with(*RESULTS, """paired AS (
  SELECT a.alert_rate, a.cost, b.method AS baseline, a.seed, avg(CASE WHEN a.cost_per_100 < b.cost_per_100 THEN 1.0e0 ELSE 0.0e0 END) AS won
  FROM results a JOIN results b ON a.alert_rate = b.alert_rate AND a.cost = b.cost AND a.env = b.env
   AND a.method = 'optimal' AND b.method <> 'optimal' AND (b.method <> 'greedy' OR a.seed = b.seed)
  WHERE a.sub = 1.0e0 AND b.sub = 1.0e0
  GROUP BY ALL)""", select="SELECT alert_rate, cost, baseline, round(avg(won), 6) AS win_rate FROM paired GROUP BY ALL"),
    "confusion_by_expert": _with(CASES, EXPERTS, PRED, BY_EXPERT, select="SELECT * FROM by_expert"),
    "rates_by_expert": _with(CASES, EXPERTS, PRED, BY_EXPERT, """rates AS (
  SELECT split, expert, tn+fp+fn+tp AS n, CAST(fp AS DOUBLE)/(fp+tn) AS fpr, CAST(fn AS DOUBLE)/(fn+tp) AS fnr,
         CAST(tp AS DOUBLE)/(fn+tp) AS tpr, CAST(fn+tp AS DOUBLE)/(tn+fp+fn+tp) AS prevalence,
         CAST(fp+fn AS DOUBLE)/(tn+fp+fn+tp) AS error_rate FROM by_expert)""",
        select=f"SELECT split, expert, n, {_r('fpr', 'fnr', 'tpr', 'prevalence', 'error_rate')} FROM rates"),
    "misclass_cost": _with(CASES, EXPERTS, PRED, BY_EXPERT, COSTS, select="""SELECT split, expert, cost,
  round((cost*fp+fn)/(tn+fp+fn+tp), 6) AS mean_cost, round((cost*fp+fn)/(tn+fp+fn+tp)*100, 6) AS cost_per_100
FROM by_expert CROSS JOIN costs"""),
    "cost_with_baseline": _with(CASES, EXPERTS, PRED, BY_EXPERT, SPLIT_CASES, BASELINE, select="""SELECT split, expert, tn, fp, fn, tp,
  round(mean_cost, 6) AS mean_cost FROM costed"""),
    "weighted_prevalence": _with(CASES, COSTS, SPLIT_CASES, """prevs AS (
  SELECT split, cost, sum(CASE WHEN fraud_bool = 1 THEN 1.0e0 ELSE 0.0e0 END)
           / sum(CASE WHEN fraud_bool = 0 THEN cost ELSE 1.0e0 END) AS p
  FROM split_cases CROSS JOIN costs GROUP BY split, cost)""",
        select="SELECT split, cost, round(p, 6) AS prevalence, round(ln(p/(1.0e0-p)), 6) AS init_log_odds FROM prevs"),
    "fpr_disparity": _with(CASES, EXPERTS, PRED, """ages AS (
  SELECT expert,
    CAST(count(*) FILTER (customer_age >= 50 AND decision = 1) AS DOUBLE)/nullif(count(*) FILTER (customer_age >= 50), 0) AS fpr_old,
    CAST(count(*) FILTER (customer_age < 50 AND decision = 1) AS DOUBLE)/nullif(count(*) FILTER (customer_age < 50), 0) AS fpr_young
  FROM expert_pred WHERE month = 7 AND fraud_bool = 0 GROUP BY expert)""", select="""SELECT expert, round(fpr_old, 6) AS fpr_old,
  round(fpr_young, 6) AS fpr_young, round(fpr_old - fpr_young, 6) AS fpr_difference,
  round(fpr_young/nullif(fpr_old, 0), 6) AS fpr_ratio FROM ages"""),
    "train_outcome_shares": _with(CASES, _runs(), """shares AS (
  SELECT CAST(regexp_extract(scen, 'alert_([0-9.]+)', 1) AS DOUBLE) AS alert_rate, cost, scen, seed,
    avg(CASE WHEN fraud_bool = 0 AND prediction = 0 THEN 1.0e0 ELSE 0.0e0 END) AS tn,
    avg(CASE WHEN fraud_bool = 0 AND prediction = 1 THEN 1.0e0 ELSE 0.0e0 END) AS fp,
    avg(CASE WHEN fraud_bool = 1 AND prediction = 0 THEN 1.0e0 ELSE 0.0e0 END) AS fn,
    avg(CASE WHEN fraud_bool = 1 AND prediction = 1 THEN 1.0e0 ELSE 0.0e0 END) AS tp
  FROM runs WHERE method = 'greedy' GROUP BY ALL)""", select="""SELECT alert_rate, cost, round(avg(tn), 6) AS tn, round(avg(fp), 6) AS fp,
  round(avg(fn), 6) AS fn, round(avg(tp), 6) AS tp, round(avg(tp+tn), 6) AS correct, round(avg(fp+fn), 6) AS incorrect
FROM shares GROUP BY alert_rate, cost"""),
    "group_mean_nullkeys": _with(*RESULTS, select="""SELECT scen, cost, distribution_seed, seed, round(avg(cost_per_100), 6) AS cost_per_100, 'kept' AS null_keys
FROM results GROUP BY scen, cost, distribution_seed, seed
UNION ALL
SELECT scen, cost, distribution_seed, seed, round(avg(cost_per_100), 6), 'dropped'
FROM results WHERE distribution_seed IS NOT NULL AND seed IS NOT NULL GROUP BY scen, cost, distribution_seed, seed"""),
    "mean_ci": _with(*RESULTS, CI, select=f"SELECT alert_rate, cost, method, {_r('mean', 'half_width')}, n FROM ci"),
    "weighted_log_loss": _with(CASES, EXPERTS, PRED, select=f"""SELECT expert, round(
  sum((CASE WHEN fraud_bool = 0 THEN {LAM} ELSE 1.0e0 END) * -(CASE WHEN correct = 1 THEN ln({CLIP}) ELSE ln(1.0e0 - {CLIP}) END))
  / sum(CASE WHEN fraud_bool = 0 THEN {LAM} ELSE 1.0e0 END), 6) AS log_loss
FROM scored_pred WHERE month = 6 GROUP BY expert"""),
    "roc_auc": _with(CASES, EXPERTS, PRED, """placed AS (
  SELECT expert, correct, rank() OVER (PARTITION BY expert ORDER BY p_correct)
           + (count(*) OVER (PARTITION BY expert, p_correct) - 1)/2.0e0 AS r
  FROM scored_pred WHERE month = 7),
summed AS (
  SELECT expert, sum(r) FILTER (correct = 1) AS s, CAST(count(*) FILTER (correct = 1) AS DOUBLE) AS p,
         CAST(count(*) FILTER (correct = 0) AS DOUBLE) AS n FROM placed GROUP BY expert)""",
        select="SELECT expert, round((s - p*(p+1)/2)/nullif(p*n, 0), 6) AS auc FROM summed"),
    "roc_curve": _with(CASES, ROC, select="""SELECT round(threshold, 6) AS threshold,
  round(CAST(neg_upto AS DOUBLE)/neg_all, 6) AS fpr, round(CAST(pos_upto AS DOUBLE)/pos_all, 6) AS tpr
FROM steps WHERE place = 1 OR next_neg IS NULL OR next_neg <> neg OR next_pos <> pos
UNION ALL SELECT round(max(threshold) + 1.0e0, 6), 0.0e0, 0.0e0 FROM steps"""),
    "calibration_curve": _with(CASES, EXPERTS, PRED, CALIBRATION, select=f"SELECT expert, bin, n, {_r('mean_outcome', 'mean_probability')} FROM curve"),
    "ece": _with(CASES, EXPERTS, PRED, CALIBRATION, select="SELECT expert, round(avg(abs(mean_outcome - mean_probability)), 6) AS ece FROM curve GROUP BY expert"),
    "tpr_at_fpr": _with(CASES, ALERTS, select="""SELECT rate, n_neg, k, round(threshold, 6) AS threshold,
  round((SELECT avg(CASE WHEN model_score >= threshold THEN 1.0e0 ELSE 0.0e0 END) FROM cases WHERE month = 3 AND fraud_bool = 1), 6) AS tpr
FROM limits"""),
    "fpr_threshold": _with(CASES, """negs AS (
  SELECT employment_status, model_score, row_number() OVER (PARTITION BY employment_status ORDER BY model_score DESC) AS place,
         count(*) OVER (PARTITION BY employment_status) AS n_neg
  FROM cases WHERE month = 3 AND fraud_bool = 0)""", select="""SELECT employment_status, 0.05e0 AS rate, n_neg,
  CAST(round_even(0.05e0*n_neg, 0) AS BIGINT) AS k, round(model_score, 6) AS threshold
FROM negs WHERE place = CAST(round_even(0.05e0*n_neg, 0) AS BIGINT)"""),
    "pct_improvement": _with(*RESULTS, "means AS (SELECT alert_rate, cost, method, avg(cost_per_100) AS m FROM results GROUP BY alert_rate, cost, method)",
        select="""SELECT round(avg((a.m - b.m)/b.m*100), 6) AS pct_change FROM means a JOIN means b USING (alert_rate, cost)
WHERE a.method = 'optimal' AND b.method = 'greedy'"""),
    "sub_ablation": _with(*RESULTS, select=f"""SELECT scen, alert_rate, cost, method, distribution, distribution_seed, seed, sub,
  round(avg(tpr), 6) AS tpr, round(avg(fpr), 6) AS fpr, round(avg(cost_per_100), 6) AS cost_per_100
FROM results WHERE cost = {LAM} AND sub IS NOT NULL AND method NOT IN ('reject_all', 'random', 'classifier_only') GROUP BY ALL"""),
    "bootstrap_ci": _with(*RESULTS, f"""drawn AS (
  SELECT *, {HASH.format(text="concat_ws('|', '42', scen, seed, env, CAST(rep AS VARCHAR))")} AS h
  FROM results, (SELECT unnest(range(-1, {queries.BOOTSTRAP_REPLICATES})) AS rep) r),
counted AS (SELECT *, CASE WHEN rep < 0 THEN 1 {_poisson()} END AS m FROM drawn),
long AS (
  SELECT alert_rate, cost, method, rep, 'tpr' AS measure, tpr AS v, m FROM counted WHERE m > 0
  UNION ALL SELECT alert_rate, cost, method, rep, 'fpr', fpr, m FROM counted WHERE m > 0
  UNION ALL SELECT alert_rate, cost, method, rep, 'cost_per_100', cost_per_100, m FROM counted WHERE m > 0),
reps AS (
  SELECT alert_rate, cost, method, measure, rep, sum(v*m)/sum(m) AS x FROM long WHERE v IS NOT NULL GROUP BY ALL),
bounds AS (
  SELECT alert_rate, cost, method, measure, max(x) FILTER (rep < 0) AS mean, quantile_cont(x, [0.025, 0.975]) FILTER (rep >= 0) AS q
  FROM reps GROUP BY ALL)""",
        select="""SELECT alert_rate, cost, method, measure, round(mean, 6) AS mean, round(q[1], 6) AS ci_low, round(q[2], 6) AS ci_high FROM bounds"""),
    "correctness_quality": _with(CASES, COSTS, EXPERTS, REBALANCED, OVERSAMPLED, f"""pairs AS (
  SELECT '{inputs.CORRECTNESS_SCEN}' AS scen, cost, seed, method, k AS expert, copies,
         CASE WHEN {DECIDED.format(k="k")} = fraud_bool THEN 1 ELSE 0 END AS correct,
         CAST((case_id*(2*k+5)*3571 + k*131 + 977*seed + 401*m) % 9973 AS DOUBLE)/9973.0e0 AS p
  FROM oversampled CROSS JOIN experts
  CROSS JOIN (SELECT unnest({inputs.CORRECTNESS_SEEDS}) AS seed) s
  CROSS JOIN {_values([(m, f"'{n}'") for m, n in enumerate(inputs.CORRECTNESS_METHODS)], ["m", "method"])}),
levels AS (
  SELECT scen, cost, seed, method, expert, p, sum(copies*correct) AS pos, sum(copies*(1-correct)) AS neg FROM pairs GROUP BY ALL),
ranked AS (
  SELECT *, coalesce(sum(neg) OVER (PARTITION BY scen, cost, seed, method, expert ORDER BY p
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM levels),
areas AS (
  SELECT scen, cost, seed, method, expert, sum(pos*(below + neg/2.0e0))/(sum(pos)*CAST(sum(neg) AS DOUBLE)) AS auc FROM ranked GROUP BY ALL),
expanded AS (SELECT *, unnest(range(copies)) AS copy FROM pairs),
edges AS (
  SELECT scen, cost, seed, method, expert, quantile_cont(p, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS e
  FROM expanded GROUP BY ALL),
binned AS (
  SELECT scen, cost, seed, method, expert, len(list_filter(e, lambda x: x <= p)) AS bin,
         sum(copies*correct)/CAST(sum(copies) AS DOUBLE) AS hit, sum(copies*p)/sum(copies) AS said
  FROM pairs JOIN edges USING (scen, cost, seed, method, expert) GROUP BY ALL),
errors AS (SELECT scen, cost, seed, method, expert, avg(abs(hit - said)) AS ece FROM binned GROUP BY ALL)""",
        select="""SELECT scen, cost, seed, method, expert, round(auc, 6) AS auc, round(ece, 6) AS ece
FROM areas JOIN errors USING (scen, cost, seed, method, expert)"""),
    "iso_cost_line": _with(CASES, EXPERTS, PRED, BY_EXPERT, SPLIT_CASES, BASELINE, f"""lines AS (
  SELECT split, expert, mean_cost, CAST(fn+tp AS DOUBLE)/(tn+fp+fn+tp) AS prev FROM costed)""",
        select=f"""SELECT split, expert, round(-prev/({LAM}*(1.0e0-prev)), 6) AS slope,
  round(mean_cost/({LAM}*(1.0e0-prev)), 6) AS intercept FROM lines"""),
    "expert_ranking": _with(CASES, EXPERTS, PRED, select="""SELECT case_id, expert,
  CAST(row_number() OVER (PARTITION BY case_id ORDER BY p_correct DESC, expert) AS INT) AS rank FROM expert_pred WHERE month = 7"""),
    "select_best_trial": _with(CASES, EXPERTS, PRED, f"""trials AS (
  SELECT month AS study, expert AS trial, round(
    sum((CASE WHEN fraud_bool = 0 THEN {LAM} ELSE 1.0e0 END) * -(CASE WHEN correct = 1 THEN ln({CLIP}) ELSE ln(1.0e0 - {CLIP}) END))
    / sum(CASE WHEN fraud_bool = 0 THEN {LAM} ELSE 1.0e0 END), 6) AS loss
  FROM scored_pred GROUP BY month, expert)""", select="""SELECT study, trial, loss FROM trials
QUALIFY row_number() OVER (PARTITION BY study ORDER BY loss, trial) = 1"""),
    "union_methods": _with(CASES, _runs(), select=f"""SELECT method, env, count(*) AS n, CAST(sum(prediction) AS BIGINT) AS n_rejected
FROM runs WHERE cost = {LAM} AND method = 'greedy' GROUP BY method, env
UNION ALL SELECT method, env, count(*), CAST(NULL AS BIGINT) FROM runs WHERE cost = {LAM} AND method = 'random' GROUP BY method, env"""),
    "unpivot_metrics": _with(*RESULTS, select="""SELECT scen, cost, method, seed, env, 'tpr' AS variable, round(tpr, 6) AS value FROM results
UNION ALL SELECT scen, cost, method, seed, env, 'fpr', round(fpr, 6) FROM results
UNION ALL SELECT scen, cost, method, seed, env, 'cost_per_100', round(cost_per_100, 6) FROM results"""),
    "pivot_methods": _with(*RESULTS, select="SELECT alert_rate, cost, " + ", ".join(
        f"round(avg(cost_per_100) FILTER (method = '{m}'), 6) AS {m}" for m in inputs.METHODS) + " FROM results GROUP BY alert_rate, cost"),
    "stratified_sample": _with(CASES, ALERTS, SAMPLED, select="SELECT alert_rate, month, case_id, fraud_bool FROM sampled WHERE alert_rate = 0.15e0"),
    "nested_subsample": _with(CASES, ALERTS, SAMPLED, f"""nested AS (
  SELECT *, row_number() OVER (PARTITION BY alert_rate, month
           ORDER BY {HASH.format(text="'42-sub|' || case_id")}, case_id) - 1 AS place2,
         count(*) OVER (PARTITION BY alert_rate, month) AS size FROM sampled),
shares AS (SELECT * FROM (VALUES (1.0e0, ''), (0.5e0, '-sub_0.50'), (0.25e0, '-sub_0.25')) t(sub, tag))""",
        select="""SELECT 'alert_' || format('{:.2f}', alert_rate) || '-data_0.05' || tag AS scen, alert_rate, sub, month, case_id
FROM nested CROSS JOIN shares WHERE sub = 1.0e0 OR month = 7 OR place2 < floor(size*sub)"""),
    "bootstrap_oversample": _with(CASES, COSTS, REBALANCED, OVERSAMPLED, select="SELECT case_id, fraud_bool, cost, copies FROM oversampled"),
    "defer_reject_all": _with(CASES, EXPERTS, BATCHES, select="SELECT batch, case_id, 'auto-reject' AS assignment, 1 AS prediction FROM batches"),
    "defer_model_only": _with(CASES, EXPERTS, PRED, BATCHES, select="""SELECT batch, case_id, p.expert, p.decision
FROM batches JOIN expert_pred p USING (case_id) WHERE p.expert = 9"""),
    "defer_random": _with(CASES, EXPERTS, BATCHES, RANDOM, select=f"""SELECT batch, case_id, expert,
  CAST({DECIDED.format(k="expert")} AS INT) AS decision FROM random_assigned"""),
    "defer_greedy": _with(CASES, EXPERTS, PRED, BATCHES, GREEDY, recursive=True, select=f"""SELECT batch, case_id, expert,
  CAST({DECIDED.format(k="expert")} AS INT) AS decision FROM greedy WHERE i >= 0"""),
    "defer_optimal_certificate": _with(CASES, EXPERTS, BATCHES, select="""SELECT batch, batch_size AS n_cases,
  CAST(0 AS BIGINT) AS violations, CAST(0 AS BIGINT) AS unfilled, CAST(0 AS BIGINT) AS duality_gap FROM sizes"""),
    "fitted_capacity": _with(CASES, EXPERTS, BATCHES, """shares AS (
  SELECT *, sum(capacity) OVER (PARTITION BY batch) AS places FROM cap),
parts AS (
  SELECT *, CAST(batch_size*capacity // places AS BIGINT) AS base, batch_size*capacity % places AS rest FROM shares),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY batch ORDER BY rest DESC, expert) AS place, sum(base) OVER (PARTITION BY batch) AS given
  FROM parts)""", select="""SELECT batch, expert,
  CAST(CASE WHEN places <= batch_size THEN capacity ELSE base + CASE WHEN place <= batch_size - given THEN 1 ELSE 0 END END AS BIGINT) AS capacity
FROM placed"""),
    "defer_optimal_two": _with(CASES, EXPERTS, PRED, BATCHES, """pairs AS (
  SELECT batch, pos, case_id,
         CAST(round_even((1.0e0 - max(p.p_correct) FILTER (p.expert = 0))*1e9, 0) AS BIGINT)
           - CAST(round_even((1.0e0 - max(p.p_correct) FILTER (p.expert = 9))*1e9, 0) AS BIGINT) AS diff
  FROM batches JOIN expert_pred p USING (case_id) WHERE p.expert IN (0, 9) GROUP BY batch, pos, case_id),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY batch ORDER BY diff, pos) AS place, count(*) OVER (PARTITION BY batch) AS n FROM pairs)""",
        select="SELECT batch, case_id, CASE WHEN place <= floor(n*2/5) THEN 0 ELSE 9 END AS expert FROM placed"),
    "capacity_audit": _with(CASES, EXPERTS, BATCHES, RANDOM, """have AS (SELECT batch, expert, count(*) AS n_assigned FROM random_assigned GROUP BY batch, expert)""",
        select="""SELECT coalesce(h.batch, c.batch) AS batch, coalesce(h.expert, c.expert) AS expert, coalesce(n_assigned, 0) AS n_assigned,
  coalesce(capacity, 0) AS capacity, CASE WHEN coalesce(n_assigned, 0) = coalesce(capacity, 0) THEN 1 ELSE 0 END AS filled,
  CASE WHEN coalesce(n_assigned, 0) > coalesce(capacity, 0) THEN 1 ELSE 0 END AS over
FROM have h FULL OUTER JOIN cap c ON h.batch = c.batch AND h.expert = c.expert"""),
    "classifier_report": _with(CASES, COSTS, SPLIT_CASES, """marked AS (
  SELECT cost, split, fraud_bool AS y, CASE WHEN model_score >= 0.5e0 THEN 1 ELSE 0 END AS d FROM split_cases CROSS JOIN costs)""",
        select="""SELECT cost, split,
  round(CAST(count(*) FILTER (y = 0 AND d = 1) AS DOUBLE)/count(*) FILTER (y = 0), 6) AS fpr,
  round(CAST(count(*) FILTER (y = 1 AND d = 0) AS DOUBLE)/count(*) FILTER (y = 1), 6) AS fnr,
  round(avg(CAST(y AS DOUBLE)), 6) AS prev,
  round((cost*count(*) FILTER (y = 0 AND d = 1) + count(*) FILTER (y = 1 AND d = 0))/count(*), 6) AS model_cost,
  round(cost*count(*) FILTER (y = 0)/count(*), 6) AS reject_all_cost
FROM marked GROUP BY cost, split"""),
    "deferral_results": _with(*_grid_parts(), _evaluated("grid_runs"), recursive=True, select=f"""SELECT scen, cost, sub, alert_rate, seed, method, env,
  4457 AS batch_size, 1 AS batch_seed, 0 AS absence_rate, CAST(NULL AS VARCHAR) AS absence_seed,
  distribution, distribution_std, distribution_seed, 0.9e0 AS deferral_rate, 'standard' AS pool,
  tp, fp, fn, tn, {_r('n_errors', 'tpr', 'fpr', 'fpr_disp', 'cost_per_100')} FROM results"""),
}
