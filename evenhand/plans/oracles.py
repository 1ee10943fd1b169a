"""The registered queries as DuckDB SQL over the same tables."""

from __future__ import annotations

from ..functions import fixed_values as fv
from ..functions.text import WHITESPACE

ORACLES: dict[str, str] = {}


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _strip(c: str) -> str:
    return f"trim({c}, {_quoted(WHITESPACE)})"


def _rec(c: str) -> str:
    return f"printf('rec_%06d', {c})"


def _round(*names: str) -> str:
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)


# --- base tables ----------------------------------------------------------------

DOCS = """docs AS (
  SELECT l.doc_id, l.quality, l.toxic, d.lang, d.source, d.n_chars,
         CASE l.quality WHEN 1 THEN 'good' ELSE 'bad' END AS truth
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"""

LOAN_ROWS = """credit AS (
  SELECT c_mktsegment AS g, CASE WHEN l_returnflag = 'R' THEN 'yes' ELSE 'no' END AS t,
         CASE WHEN l_discount >= 0.05::DOUBLE AND l_quantity <= 25 THEN 'yes' ELSE 'no' END AS careful,
         CASE WHEN l_discount >= 0.03::DOUBLE AND l_quantity <= 30 THEN 'yes' ELSE 'no' END AS broad,
         CASE WHEN l_tax <= 0.03::DOUBLE THEN 'yes' ELSE 'no' END AS taxwise
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey),
pairs AS (SELECT 'careful' AS e, g, t, careful AS p FROM credit
  UNION ALL SELECT 'broad', g, t, broad FROM credit
  UNION ALL SELECT 'taxwise', g, t, taxwise FROM credit)"""

FINE_ROWS = DOCS + """,
limits(e, lim) AS (VALUES ('short', 800), ('long', 1500)),
pairs AS (SELECT e, lang || '_' || source AS g, truth AS t,
  CASE WHEN n_chars >= lim THEN 'good' ELSE 'bad' END AS p FROM docs, limits)"""

LANG_ROWS = DOCS + """,
pairs AS (SELECT 'short' AS e, lang AS g, truth AS t,
  CASE WHEN n_chars >= 800 THEN 'good' ELSE 'bad' END AS p FROM docs)"""

PREDICTIONS = DOCS + f""",
limits(e, lim) AS (VALUES ('short', 800), ('long', 1500)),
said AS (SELECT *, CASE WHEN n_chars >= lim THEN 'good' WHEN n_chars >= 150 THEN 'bad' END AS p FROM docs, limits),
predictions AS (
  SELECT {_rec('doc_id')} AS record_id, truth AS ground_truth, p AS prediction,
    CASE WHEN source = 'src7' THEN 'None' WHEN source <> 'src11' THEN lang END AS sensitive_feature,
    e AS experiment_id, NULL::VARCHAR AS reasoning, toxic = 0 AS api_success,
    least(5, 1 + n_chars // 1000)::INTEGER AS attempts_made, '2024-01-01T00:00:00' AS "timestamp",
    coalesce(toxic = 0 AND p = truth, false) AS correct
  FROM said),
analysed AS (SELECT * FROM predictions WHERE api_success AND sensitive_feature IS NOT NULL
  AND sensitive_feature <> 'None' AND prediction IS NOT NULL AND ground_truth IS NOT NULL)"""

ANALYSED_ROWS = PREDICTIONS + """,
pairs AS (SELECT experiment_id AS e, sensitive_feature AS g, ground_truth AS t, prediction AS p FROM analysed)"""

# --- metric layer over pairs(e, g, t, p) -------------------------------------------

FRAME = """cube AS (SELECT e, g, t, p, count(*) AS n FROM pairs GROUP BY ALL),
lab AS (SELECT e, g, t AS label, n AS s, 0 AS pr, CASE WHEN t = p THEN n ELSE 0 END AS tp FROM cube
  UNION ALL SELECT e, g, p, 0, n, 0 FROM cube),
sums AS (SELECT e, g, grouping(g) AS whole, label, sum(s)::DOUBLE AS s, sum(pr)::DOUBLE AS pr, sum(tp)::DOUBLE AS tp
  FROM lab GROUP BY GROUPING SETS ((e, g, label), (e, label))),
frame AS (SELECT e, g, CASE whole WHEN 1 THEN 'overall' ELSE 'group' END AS level, sum(s)::BIGINT AS n,
  sum(tp) / sum(s) AS accuracy, sum(s * coalesce(tp / nullif(pr, 0), 0)) / sum(s) AS prec,
  sum(s * coalesce(tp / nullif(s, 0), 0)) / sum(s) AS recall,
  sum(s * coalesce(2 * tp / nullif(pr + s, 0), 0)) / sum(s) AS f1_score,
  avg(tp / nullif(s, 0)) AS balanced, sum(s * pr) AS cross_sum, sum(tp) AS hits
  FROM sums GROUP BY e, g, whole),
long AS (SELECT e, g, level, 'accuracy' AS metric, accuracy AS v FROM frame
  UNION ALL SELECT e, g, level, 'precision', prec FROM frame
  UNION ALL SELECT e, g, level, 'recall', recall FROM frame
  UNION ALL SELECT e, g, level, 'f1_score', f1_score FROM frame),
best AS (SELECT e, metric, g, v, row_number() OVER (PARTITION BY e, metric ORDER BY v DESC, g) AS b,
  row_number() OVER (PARTITION BY e, metric ORDER BY v, g) AS w FROM long WHERE level = 'group'),
gap AS (SELECT e, metric, count(*) AS num_groups, max(v) - min(v) AS difference,
  min(v) / nullif(max(v), 0) AS ratio, max(v) AS best_value, min(v) AS worst_value,
  max(CASE WHEN b = 1 THEN g END) AS best_group, max(CASE WHEN w = 1 THEN g END) AS worst_group
  FROM best GROUP BY e, metric)"""


def _rates(positive: str) -> str:
    return f"""rates AS (SELECT e, g, count(*) AS n,
  count(*) FILTER (t = {positive}) AS positives, count(*) FILTER (t <> {positive}) AS negatives,
  count(*) FILTER (p = {positive}) AS selected,
  count(*) FILTER (t = {positive} AND p = {positive}) AS true_positives,
  count(*) FILTER (t <> {positive} AND p = {positive}) AS false_positives FROM pairs GROUP BY e, g),
shares AS (SELECT *, selected / n AS selection_rate, coalesce(true_positives / nullif(positives, 0), 0) AS tpr,
  coalesce(false_positives / nullif(negatives, 0), 0) AS fpr FROM rates),
gate AS (SELECT e, count(DISTINCT t) = 2 AND count(*) FILTER (t = {positive}) > 0 AS "binary" FROM pairs GROUP BY e),
spread AS (SELECT e, max(selection_rate) - min(selection_rate) AS dp, max(tpr) - min(tpr) AS dt,
  max(fpr) - min(fpr) AS df, min(selection_rate) / nullif(max(selection_rate), 0) AS dr FROM shares GROUP BY e),
parity AS (SELECT e, "binary", CASE WHEN "binary" THEN dp END AS dp, CASE WHEN "binary" THEN dr END AS dr,
  CASE WHEN "binary" THEN dt END AS dt, CASE WHEN "binary" THEN df END AS df,
  CASE WHEN "binary" THEN greatest(dt, df) END AS eo FROM spread JOIN gate USING (e))"""


ORACLES["group_accuracy"] = f"""WITH {LANG_ROWS}, {FRAME}
SELECT g AS sensitive_feature, level, n, round(accuracy, 6) AS accuracy FROM frame"""

_METRICS = """SELECT e AS experiment_id, g AS sensitive_feature, level, n, round(accuracy, 6) AS accuracy,
round(prec, 6) AS "precision", round(recall, 6) AS recall, round(f1_score, 6) AS f1_score FROM frame"""
ORACLES["weighted_metrics_by_group"] = f"WITH {LOAN_ROWS}, {FRAME} {_METRICS}"
ORACLES["weighted_metrics_many_groups"] = f"WITH {FINE_ROWS}, {FRAME} {_METRICS}"
ORACLES["fairness_gaps"] = f"""WITH {LOAN_ROWS}, {FRAME}
SELECT e AS experiment_id, metric, num_groups, round(difference, 6) AS difference, round(ratio, 6) AS ratio,
  round(best_value - worst_value, 6) AS gap, ratio >= 0.8::DOUBLE AS meets_four_fifths FROM gap"""
ORACLES["best_worst_group"] = f"""WITH {FINE_ROWS}, {FRAME}
SELECT e AS experiment_id, metric, best_group, round(best_value, 6) AS best_value, worst_group, round(worst_value, 6) AS worst_value FROM gap"""
ORACLES["selection_rates"] = f"""WITH {LOAN_ROWS}, {_rates("'yes'")}
SELECT e AS experiment_id, g AS sensitive_feature, n, positives, negatives, selected, true_positives,
  false_positives, {_round('selection_rate', 'tpr', 'fpr')} FROM shares"""
ORACLES["demographic_parity"] = f"""WITH {LOAN_ROWS}, {_rates("'yes'")}
SELECT e AS experiment_id, "binary", round(dp, 6) AS demographic_parity_difference,
  round(dr, 6) AS demographic_parity_ratio FROM parity"""
ORACLES["equalized_odds"] = f"""WITH {FINE_ROWS}, {_rates("'good'")}
SELECT e AS experiment_id, "binary", round(dt, 6) AS tpr_difference, round(df, 6) AS fpr_difference,
  round(eo, 6) AS equalized_odds_difference FROM parity"""
ORACLES["parity_gate"] = f"""WITH base AS (SELECT o_orderpriority AS g, o_orderstatus AS s,
  CASE WHEN o_totalprice >= 250000 THEN 'F' ELSE 'O' END AS p FROM orders),
pairs AS (SELECT 'two' AS e, g, CASE WHEN s = 'F' THEN 'F' ELSE 'O' END AS t, p FROM base
  UNION ALL SELECT 'three', g, s, p FROM base UNION ALL SELECT 'one', g, 'F', p FROM base), {_rates("'F'")}
SELECT e AS experiment_id, "binary", round(dp, 6) AS demographic_parity_difference,
  round(eo, 6) AS equalized_odds_difference FROM parity"""
ORACLES["group_sizes"] = f"""WITH {FINE_ROWS}
SELECT e AS experiment_id, g AS sensitive_feature, count(*) AS "count",
  round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (PARTITION BY e), 6) AS percentage FROM pairs GROUP BY e, g"""
ORACLES["class_distributions"] = f"""WITH {LOAN_ROWS},
kinds AS (SELECT e, g, 'ground_truth' AS kind, t AS label FROM pairs UNION ALL SELECT e, g, 'predictions', p FROM pairs)
SELECT e AS experiment_id, g AS sensitive_feature, kind, label, count(*) AS "count",
  round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (PARTITION BY e, g, kind), 6) AS percentage
FROM kinds GROUP BY e, g, kind, label"""
ORACLES["custom_metric"] = f"""WITH {LOAN_ROWS}, {FRAME}
SELECT e AS experiment_id, g AS sensitive_feature, level, 'balanced_accuracy' AS metric, round(balanced, 6) AS value FROM frame
UNION ALL SELECT e, g, level, 'kappa',
  round((accuracy - cross_sum / (n::DOUBLE * n)) / (1 - cross_sum / (n::DOUBLE * n)), 6) FROM frame"""

# --- predictions tables ---------------------------------------------------------------

ORACLES["analysis_filter"] = f"""WITH {PREDICTIONS}
SELECT experiment_id, record_id, sensitive_feature, ground_truth, prediction, correct FROM analysed"""
_TOTALS = """count(*) AS total_predictions, count(*) FILTER (api_success) AS successful_predictions,
  count(*) FILTER (NOT api_success) AS failed_predictions,
  round(coalesce(count(*) FILTER (correct) / nullif(count(*) FILTER (api_success), 0), 0), 6) AS accuracy,
  round(avg(attempts_made), 6) AS mean_attempts"""
ORACLES["prediction_summary"] = f"WITH {PREDICTIONS} SELECT experiment_id, {_TOTALS} FROM predictions GROUP BY experiment_id"
ORACLES["threshold_curve"] = """WITH d AS (SELECT lang, quality = 1 AS good, least(n_chars // 250, 15) AS b
  FROM labels JOIN documents USING (doc_id) WHERE quality IS NOT NULL),
t AS (SELECT range AS b FROM range(16)),
c AS (SELECT l.lang, t.b, count(*) FILTER (d.good AND d.b >= t.b) AS true_positives, count(*) FILTER (NOT d.good AND d.b >= t.b) AS false_positives,
    count(*) FILTER (d.good AND d.b = t.b) AS p, count(*) FILTER (NOT d.good AND d.b = t.b) AS q,
    count(*) FILTER (NOT d.good AND d.b < t.b) AS below, count(*) FILTER (d.good) AS pos, count(*) FILTER (NOT d.good) AS neg
  FROM (SELECT DISTINCT lang FROM d) l, t, d WHERE d.lang IS NOT DISTINCT FROM l.lang GROUP BY ALL)
SELECT lang, round(sum(p * (2 * below + q)) OVER (PARTITION BY lang) / nullif(2.0::DOUBLE * pos * neg, 0), 6) AS auc, b * 250.0::DOUBLE AS threshold,
  true_positives, false_positives, round(true_positives / nullif(pos, 0), 6) AS tpr, round(false_positives / nullif(neg, 0), 6) AS fpr FROM c"""
ORACLES["group_sketch_store"] = """SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, true AS "within" FROM lineitem GROUP BY 1"""
ORACLES["label_indicators"] = f"""WITH {PREDICTIONS} SELECT experiment_id, record_id, (ground_truth = 'good')::INTEGER AS truth,
  coalesce(prediction = 'good', false)::INTEGER AS predicted FROM predictions"""
ORACLES["prediction_label_counts"] = f"""WITH {PREDICTIONS}
SELECT experiment_id, 'prediction' AS kind, prediction AS label, count(*) AS "count" FROM predictions
  WHERE prediction IS NOT NULL GROUP BY ALL
UNION ALL SELECT experiment_id, 'ground_truth', ground_truth, count(*) FROM predictions
  WHERE ground_truth IS NOT NULL GROUP BY ALL"""
ORACLES["layout_store"] = f"""WITH {PREDICTIONS}, mine AS (SELECT * FROM predictions WHERE experiment_id = 'short')
SELECT 'predictions' AS kind, count(*) AS "rows" FROM mine
UNION ALL SELECT 'analysis', count(*) FROM analysed WHERE experiment_id = 'short'
UNION ALL SELECT 'label_counts', (SELECT count(*) FROM ({ORACLES['prediction_label_counts']}) WHERE experiment_id = 'short')
UNION ALL SELECT 'prediction_summaries', count(DISTINCT experiment_id) FROM mine"""
ORACLES["confusion_counts"] = f"""WITH {PREDICTIONS}
SELECT experiment_id, sensitive_feature, ground_truth, prediction, count(*) AS n FROM analysed GROUP BY ALL"""
ORACLES["analysis_totals"] = f"""WITH {PREDICTIONS}
SELECT experiment_id, count(*) AS total_samples, count(DISTINCT sensitive_feature) AS num_groups
FROM analysed GROUP BY experiment_id"""


def _comparison(rows: str, positive: str, ids: list[str], extra: str = "") -> str:
    listed = ", ".join(f"({i}, {_quoted(x)})" for i, x in enumerate(ids))
    return f"""WITH {rows}, {FRAME}, {_rates(positive)}, listed(pos, e) AS (VALUES {listed})
SELECT pos, e AS experiment_id, {extra} round(accuracy, 6) AS accuracy, round(difference, 6) AS accuracy_difference,
  round(ratio, 6) AS accuracy_ratio, round(dp, 6) AS demographic_parity_diff, round(eo, 6) AS equalized_odds_diff
FROM listed JOIN frame USING (e) JOIN gap USING (e) JOIN parity USING (e)
WHERE level = 'overall' AND metric = 'accuracy'"""


ORACLES["model_comparison"] = _comparison(LOAN_ROWS, "'yes'", ["taxwise", "absent", "careful"])
ORACLES["summary_store"] = _comparison(
    ANALYSED_ROWS, "'good'", ["long", "absent", "short"], "e AS model, 'german_credit' AS dataset,")
ORACLES["summary_document"] = f"""WITH {ANALYSED_ROWS}, {FRAME}, {_rates("'good'")},
kinds AS (SELECT e, g, 'ground_truth' AS kind, t AS label FROM pairs UNION ALL SELECT e, g, 'predictions', p FROM pairs),
out AS (
SELECT e, 'total_samples' AS section, NULL AS metric, NULL AS g, NULL AS label, count(*) AS c, count(DISTINCT g)::DOUBLE AS v
  FROM pairs GROUP BY e
UNION ALL SELECT e, 'overall_metrics', metric, NULL, NULL, NULL, v FROM long WHERE level = 'overall'
UNION ALL SELECT e, 'fairness_differences', metric, NULL, NULL, NULL, difference FROM gap
UNION ALL SELECT e, 'fairness_ratios', metric, NULL, NULL, NULL, ratio FROM gap
UNION ALL SELECT e, 'best', metric, best_group, NULL, NULL, best_value FROM gap
UNION ALL SELECT e, 'worst', metric, worst_group, NULL, NULL, worst_value FROM gap
UNION ALL SELECT e, 'binary_metrics', 'demographic_parity_difference', NULL, NULL, NULL, dp FROM parity
UNION ALL SELECT e, 'binary_metrics', 'equalized_odds_difference', NULL, NULL, NULL, eo FROM parity
UNION ALL SELECT e, 'group_sizes', NULL, g, NULL, count(*), count(*) * 100.0::DOUBLE / sum(count(*)) OVER (PARTITION BY e)
  FROM pairs GROUP BY e, g
UNION ALL SELECT e, kind, NULL, g, label, count(*), count(*) * 100.0::DOUBLE / sum(count(*)) OVER (PARTITION BY e, g, kind)
  FROM kinds GROUP BY e, g, kind, label
UNION ALL SELECT e, 'metrics_by_group', metric, g, NULL, NULL, v FROM long WHERE level = 'group')
SELECT e AS experiment_id, section, metric, g AS grp, label, c::BIGINT AS "count", round(v, 6) AS value FROM out"""

# --- artefacts --------------------------------------------------------------------------

ORACLES["custom_metric_stray"] = """WITH rows_ AS (SELECT c_mktsegment AS g,
  CASE l_returnflag WHEN 'R' THEN 'yes' WHEN 'A' THEN 'no' ELSE 'maybe' END AS t,
  CASE WHEN l_linenumber = 7 THEN 'unsure' WHEN l_linenumber = 6 THEN 'maybe' WHEN l_quantity <= 25 THEN 'yes' ELSE 'no' END AS p
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey)
SELECT 'stray' AS experiment_id, g AS sensitive_feature, CASE grouping(g) WHEN 1 THEN 'overall' ELSE 'group' END AS level,
  'agreement' AS metric, round(count(*) FILTER (t = p) / count(*), 6) AS value FROM rows_ GROUP BY GROUPING SETS ((g), ())"""
ORACLES["predictions_store"] = f"WITH {PREDICTIONS} SELECT * FROM predictions"
ORACLES["analysis_store"] = ORACLES["analysis_filter"]
ORACLES["label_counts_store"] = ORACLES["prediction_label_counts"]
ORACLES["prediction_summary_store"] = ORACLES["prediction_summary"]
ORACLES["group_rows_store"] = ORACLES["summary_document"] + " WHERE section IN ('group_sizes', 'ground_truth', 'predictions', 'metrics_by_group')"
ORACLES["unanalysed_store"] = "SELECT DISTINCT 'failed' AS experiment_id, 'No successful predictions' AS error FROM labels"
ORACLES["comparison_store"] = _comparison(LOAN_ROWS, "'yes'", ["taxwise", "broad", "careful"], "'loans' AS dataset,").replace(
    "SELECT pos, e AS", "SELECT e AS")
ORACLES["largest_groups"] = f"""SELECT * FROM ({ORACLES["group_sizes"]}) WHERE experiment_id = 'short'
ORDER BY "count" DESC, sensitive_feature LIMIT 10"""
_LIMITED = " ".join(f"WHEN {i} THEN {_quoted(k)}" for i, k in enumerate(fv.MODELS))
_NAMED = ", ".join(f"({_quoted(k)}, {_quoted(n)}, {_quoted(p)})" for k, (n, p) in fv.MODELS.items())
ORACLES["models_lookup"] = f"""WITH models(model_key, model_name, api_provider) AS (VALUES {_NAMED}),
runs AS (SELECT CASE o_orderkey % {len(fv.MODELS) + 1} {_LIMITED} END AS model_key FROM orders)
SELECT model_key, model_name, api_provider, count(*) AS n FROM runs LEFT JOIN models USING (model_key) GROUP BY ALL"""
ORACLES["datasets_without_alias"] = """SELECT CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'german_credit' WHEN 'BUILDING' THEN 'compas'
  ELSE 'folktables' END AS dataset_name, count(*) AS n FROM customer
WHERE c_mktsegment IN ('AUTOMOBILE', 'BUILDING', 'FURNITURE') GROUP BY 1"""

# --- preparation ------------------------------------------------------------------------

ORACLES["target_recode"] = f"""SELECT {_rec('o_orderkey')} AS record_id,
  CASE o_orderstatus WHEN 'F' THEN 'readmitted' WHEN 'O' THEN 'not_readmitted' END AS ground_truth
FROM orders WHERE o_orderstatus IN ('F', 'O')"""
ORACLES["threshold_target"] = """SELECT c_custkey,
  CASE WHEN c_acctbal > 5000 THEN 'high_income' ELSE 'low_income' END AS ground_truth FROM customer"""
_AGE = "'[' || (floor(o_totalprice / 50000) * 10)::BIGINT || '-' || (floor(o_totalprice / 50000) * 10 + 10)::BIGINT || ')'"
_SENIOR = "CASE WHEN age LIKE '%70%' OR age LIKE '%80%' OR age LIKE '%90%' THEN '>=65' ELSE '<65' END"
ORACLES["age_bucket"] = f"""WITH a AS (SELECT o_orderkey, {_AGE} AS age FROM orders)
SELECT o_orderkey, age, {_SENIOR} AS age_group FROM a"""
ORACLES["group_key"] = """SELECT c_custkey,
  n_name || '_' || coalesce(CASE WHEN c_acctbal >= 0 THEN c_mktsegment END, 'nan') AS sensitive_feature
FROM customer JOIN nation ON c_nationkey = n_nationkey"""
_BRANDS = " ".join(f"WHEN 'Brand#{i}' THEN 'house brand {i}'" for i in range(1, 13))
ORACLES["code_decode"] = f"""SELECT p_partkey, CASE p_type WHEN 'ECONOMY' THEN 'low budget' WHEN 'PROMO' THEN 'special offer'
  WHEN 'SMALL' THEN 'small size' ELSE p_type END AS kind, CASE p_brand {_BRANDS} ELSE p_brand END AS brand FROM part"""
ORACLES["row_description"] = f"""SELECT {_rec('p_partkey')} AS record_id,
  'p_name: ' || p_name || chr(10) || 'p_brand: ' || p_brand || chr(10) || 'Kind: ' ||
  CASE p_type WHEN 'PROMO' THEN 'special offer' ELSE p_type END || chr(10) || 'p_size: ' || p_size || chr(10) ||
  'p_retailprice: ' || p_retailprice::VARCHAR AS data_description FROM part"""

_DATASETS = [
    ("german_credit", "German Credit", "finance", "good", "bad", "assess credit risk for loan approval"),
    ("compas", "COMPAS Recidivism", "criminal_justice", "low_risk", "high_risk", "predict two-year recidivism risk"),
    ("folktables", "Folktables (ACS Income)", "socioeconomic", "high_income", "low_income",
     "predict high income from census data"),
    ("diabetes_readmission", "Diabetes Hospital Readmission", "healthcare", "readmitted", "not_readmitted",
     "predict 30-day hospital readmission for diabetic patients"),
]
_DATASET_ROWS = ", ".join("(" + ", ".join(_quoted(v) for v in row) + ")" for row in _DATASETS)
_REGISTRY = f"""registry(dataset_name, name, dataset_type, positive_class, negative_class, task) AS (VALUES {_DATASET_ROWS}),
segments(segment, dataset_name) AS (VALUES ('AUTOMOBILE', 'german_credit'), ('BUILDING', 'compas'),
  ('FURNITURE', 'folktables'), ('HOUSEHOLD', 'diabetes_readmission'))"""
_TEMPLATES = ", ".join(
    f"({_quoted(k)}, {_quoted(s)}, {_quoted(u)})" for k, (s, u) in fv.PROMPTS.items())
ORACLES["prompt_render"] = f"""WITH {_REGISTRY}, templates(dataset_type, s, u) AS (VALUES {_TEMPLATES})
SELECT {_rec('c_custkey')} AS record_id,
  replace(replace(replace(replace(replace(s, '{{{{', '{{'), '}}}}', '}}'), '{{task_description}}', task),
    '{{positive_class}}', positive_class), '{{negative_class}}', negative_class) AS system_prompt,
  replace(replace(u, '{{record_id}}', {_rec('c_custkey')}), '{{data_description}}', 'c_name: ' || c_name || chr(10) ||
    'c_nationkey: ' || c_nationkey || chr(10) || 'c_acctbal: ' || c_acctbal::VARCHAR) AS user_prompt
FROM customer LEFT JOIN segments ON c_mktsegment = segment LEFT JOIN registry USING (dataset_name)
LEFT JOIN templates USING (dataset_type)"""
ORACLES["dimension_lookup"] = f"""WITH {_REGISTRY}
SELECT coalesce(s.dataset_name, 'unknown') AS dataset_name, name, dataset_type, positive_class, negative_class, count(*) AS n
FROM customer LEFT JOIN segments s ON c_mktsegment = segment LEFT JOIN registry r ON s.dataset_name = r.dataset_name
GROUP BY ALL"""
ORACLES["feature_target_join"] = """SELECT coalesce(p_partkey, l_partkey) AS row_id, p_name, p_size, target
FROM part FULL JOIN (SELECT l_partkey, max(l_quantity) AS target FROM lineitem GROUP BY 1) ON p_partkey = l_partkey"""


def _split(size: float = 0.2, seed: int = 42) -> str:
    """From samples(record_id, ground_truth, ...) to taken(...), its exact test rows."""
    return f"""cnt AS (SELECT ground_truth, count(*) AS c FROM samples WHERE ground_truth IS NOT NULL GROUP BY 1),
tot AS (SELECT sum(c)::BIGINT AS n, (sum(c) - ceil({size}::DOUBLE * sum(c)))::BIGINT AS tr FROM cnt),
quo AS (SELECT ground_truth, c, (c * tr) // n AS base, (c * tr) % n AS rem, tr FROM cnt, tot),
rk AS (SELECT *, row_number() OVER (ORDER BY rem DESC, ground_truth) AS r, tr - sum(base) OVER () AS short FROM quo),
quota AS (SELECT ground_truth, c - base - CASE WHEN r <= short THEN 1 ELSE 0 END AS k FROM rk),
ranked AS (SELECT *, row_number() OVER (PARTITION BY ground_truth ORDER BY md5(record_id || '_{seed}'), record_id) AS rn
  FROM samples),
taken AS (SELECT * FROM ranked JOIN quota USING (ground_truth) WHERE rn <= k)"""


ORACLES["stratified_split"] = f"""WITH samples AS (SELECT {_rec('o_orderkey')} AS record_id,
  CASE WHEN o_orderstatus = 'F' THEN 'readmitted' ELSE 'not_readmitted' END AS ground_truth FROM orders), {_split()}
SELECT record_id, ground_truth FROM taken"""
ORACLES["stratified_split_open"] = f"""WITH samples AS (SELECT {_rec('p_partkey')} AS record_id, p_brand AS ground_truth
  FROM part), {_split(0.15, 7)} SELECT record_id, ground_truth FROM taken"""
ORACLES["stratified_split_many"] = f"""WITH samples AS (SELECT {_rec('o_orderkey')} AS record_id,
  CASE WHEN (o_orderkey // 2) % 3 = 0 THEN 'frequent' ELSE (o_orderkey // 2)::VARCHAR END AS ground_truth FROM orders), {_split()}
SELECT record_id, ground_truth FROM taken"""
ORACLES["capped_sample"] = f"""SELECT {_rec('o_orderkey')} AS record_id, o_totalprice FROM orders
ORDER BY md5({_rec('o_orderkey')} || '_42'), 1 LIMIT 5000"""

# --- answers -----------------------------------------------------------------------------


def _json(label: str, reasoning: str) -> str:
    return f"json_object('prediction_label', {label}, 'reasoning', {reasoning})::VARCHAR"


# Answers(content, provider, ...) to parsed(..., outcome, label, why, err).
PARSE = f"""read1 AS (SELECT *, coalesce(json_valid(content), false) AS valid, provider = 'gemini' AS fenced FROM answers),
read2 AS (SELECT *, CASE WHEN NOT valid AND fenced
  THEN nullif(regexp_extract(content, '(?s)```json\\s*(\\{{.*?\\}})\\s*```', 1), '') END AS fence FROM read1),
read3 AS (SELECT *, CASE WHEN valid THEN content WHEN json_valid(fence) THEN fence END AS doc FROM read2),
read4 AS (SELECT *, json_type(doc) AS top, json_type(doc, '$.prediction_label') AS lt,
  CASE WHEN doc IS NULL AND fence IS NULL THEN nullif(CASE WHEN fenced
    THEN regexp_extract(content, '(?i)prediction_label["\\s:]+([^,\\n"]+)', 1)
    ELSE regexp_extract(content, '(?i)prediction_label[:\\s]+([^,\\n]+)', 1) END, '') END AS found,
  nullif(CASE WHEN fenced THEN regexp_extract(content, '(?is)reasoning["\\s:]+(.+?)(?:\\n|$|")', 1)
    ELSE regexp_extract(content, '(?is)reasoning[:\\s]+(.+)', 1) END, '') AS said FROM read3),
read5 AS (SELECT *, CASE WHEN top <> 'OBJECT' OR lt <> 'VARCHAR' OR content IS NULL THEN true END AS bad FROM read4),
read6 AS (SELECT *, CASE WHEN bad IS NULL THEN lower({_strip(f"""CASE WHEN doc IS NOT NULL
    THEN coalesce(doc->>'$.prediction_label', '')
    ELSE trim(trim({_strip('found')}, '"'), '''') END""")}) END AS lab FROM read5),
parsed AS (SELECT * EXCLUDE (lab),
  CASE WHEN bad IS NOT NULL THEN 'api_error' WHEN lab IS NULL THEN 'json_error' WHEN lab = '' THEN 'empty'
    ELSE 'success' END AS res,
  nullif(lab, '') AS label,
  CASE WHEN nullif(lab, '') IS NULL THEN NULL
    WHEN doc IS NOT NULL THEN CASE WHEN json_type(doc, '$.reasoning') IS NULL THEN 'No reasoning provided'
      ELSE doc->>'$.reasoning' END
    ELSE coalesce({_strip('said')}, 'No reasoning') END AS why,
  CASE WHEN bad IS NOT NULL THEN '{fv.MISSHAPEN}'
    WHEN lab IS NULL THEN '{fv.UNPARSEABLE}'
    WHEN lab = '' THEN 'Empty prediction (keys: [' || CASE WHEN found IS NOT NULL THEN '''prediction_label'', ''reasoning'''
      ELSE list_aggregate(list_transform(json_keys(doc), lambda k: '''' || k || ''''), 'string_agg', ', ') END || '])'
    END AS err FROM read6)"""

_SHAPES = [
    _json("'good'", "text"), _json("' Good '", "text"),
    "'Sure:' || chr(10) || '```json' || chr(10) || " + _json("'good'", "text") + " || chr(10) || '```' || chr(10) || 'bye'",
    f"left({_json("'bad'", 'text')}, -2)", "'prediction_label: good, reasoning: ' || text",
    _json("''", "text"), "json_object('prediction_label', 1, 'reasoning', text)::VARCHAR",
    "json_object('prediction_label', NULL, 'reasoning', text)::VARCHAR", "json_array(text)::VARCHAR",
    "json_object('label', 'good', 'reasoning', text)::VARCHAR", _json("'good'", "text") + " || ' trailing'", "text",
]
_CASES = " ".join(f"WHEN {i} THEN {shape}" for i, shape in enumerate(_SHAPES))
ORACLES["parse_response"] = f"""WITH answers AS (SELECT doc_id,
  CASE lang WHEN 'en' THEN 'together' WHEN 'de' THEN 'openai' ELSE 'gemini' END AS provider,
  CASE substr(source, 4)::INTEGER {_CASES} ELSE {_json('lang', 'text')} END AS content FROM documents), {PARSE}
SELECT doc_id, provider, res AS outcome, label AS prediction_label, why AS reasoning, err AS error_message FROM parsed"""

_EVENTS = f"""ordered AS (SELECT *, row_number() OVER (PARTITION BY user_id, ts::DATE ORDER BY ts, event_id) AS attempt FROM events),
answers AS (SELECT 'events' AS experiment_id, user_id || '_' || strftime(ts, '%Y-%m-%d') AS record_id,
  CASE WHEN event_type = 'error' THEN 'gemini' WHEN value > 50 THEN 'openai' ELSE 'together' END AS provider,
  attempt::INTEGER AS attempt, CASE WHEN event_type IN ('view', 'error') THEN 'error' ELSE 'ok' END AS status,
  CASE WHEN event_type = 'view' THEN 'HTTP 429 ' || props
    WHEN event_type = 'error' THEN CASE WHEN value > 20 THEN 'request blocked' ELSE 'internal failure' END END AS error_text,
  1 AS finish_reason,
  CASE event_type WHEN 'purchase' THEN {_json("'Yes'", 'props')} WHEN 'click' THEN props
    WHEN 'signup' THEN '{{"prediction_label": " "}}' END AS content, ts
  FROM ordered)"""
_TURNS = f"""answers AS (SELECT 'turns' AS experiment_id, {_rec('conv_id')} AS record_id,
  CASE conv_id % 3 WHEN 0 THEN 'together' WHEN 1 THEN 'gemini' ELSE 'openai' END AS provider,
  (turn + 1)::INTEGER AS attempt, CASE role WHEN 'assistant' THEN 'ok' ELSE 'error' END AS status,
  CASE WHEN role = 'system' THEN 'safety stop' WHEN length(text) > 250 THEN 'HTTP 429 Too Many Requests'
    WHEN length(text) > 150 THEN 'server overload' ELSE 'reset: ' || text END AS error_text,
  CASE WHEN length(text) > 1400 THEN 3 ELSE 1 END AS finish_reason,
  CASE WHEN role = 'assistant' THEN CASE WHEN length(text) < 200 THEN text
    WHEN length(text) < 400 THEN 'Prediction_Label: bad, reasoning: ' || text ELSE {_json("'GOOD'", 'text')} END END AS content,
  TIMESTAMP '2024-01-01 00:00:00' + to_minutes(turn) AS ts FROM conversations)"""

# parsed answers with status and error text to tried(..., outcome, error_message, stops, wait_seconds)
TRIED = """raised AS (SELECT *, 
  CASE WHEN provider = 'gemini' AND status = 'ok' AND finish_reason = 3
      THEN 'Response blocked by safety filters (finish_reason=SAFETY)'
    WHEN provider = 'gemini' AND status = 'ok' AND finish_reason = 2
      THEN 'Response blocked (finish_reason=2, likely safety)'
    WHEN provider = 'gemini' AND status = 'ok' AND content IS NULL
      THEN 'No valid response parts: ' || coalesce(error_text, '') END AS held,
  CASE WHEN status <> 'error' THEN NULL
    WHEN provider = 'together' THEN CASE WHEN error_text LIKE '%503%' OR error_text LIKE '%429%'
      OR lower(error_text) LIKE '%overload%' THEN 'overloaded' ELSE 'api_error' END
    WHEN provider = 'gemini' THEN CASE WHEN error_text LIKE '%429%' OR error_text LIKE '%Resource has been exhausted%'
      THEN 'rate_limited' WHEN error_text LIKE '%finish\\_reason%' ESCAPE '\\' OR lower(error_text) LIKE '%safety%'
      OR lower(error_text) LIKE '%blocked%' THEN 'blocked' ELSE 'api_error' END
    ELSE CASE WHEN error_text LIKE '%429%' OR lower(error_text) LIKE '%rate\\_limit%' ESCAPE '\\' THEN 'rate_limited'
      ELSE 'api_error' END END AS raise_kind FROM parsed),
kinds AS (SELECT *, CASE WHEN held IS NOT NULL THEN 'blocked' ELSE coalesce(raise_kind, res) END AS outcome FROM raised),
tried AS (SELECT *, CASE WHEN outcome = 'success' THEN NULL WHEN held IS NOT NULL THEN held
    WHEN raise_kind = 'overloaded' THEN 'API overloaded (attempt ' || attempt || '/5)'
    WHEN raise_kind = 'rate_limited' THEN 'API rate limited (attempt ' || attempt || '/5)'
    WHEN raise_kind = 'blocked' THEN 'Content blocked by safety filters'
    WHEN raise_kind = 'api_error' THEN 'API error: ' || error_text ELSE err END AS error_message,
  outcome IN ('success', 'blocked') AS stops,
  CASE WHEN attempt >= 5 THEN 0 WHEN outcome IN ('overloaded', 'rate_limited') THEN (2 ** attempt)::INTEGER
    WHEN outcome IN ('json_error', 'api_error') THEN 1 ELSE 0 END AS wait_seconds FROM kinds)"""

REDUCED = """ends AS (SELECT experiment_id, record_id,
  coalesce(min(attempt) FILTER (stops), max(attempt)) AS made FROM tried GROUP BY ALL),
used AS (SELECT t.*, made FROM tried t JOIN ends USING (experiment_id, record_id) WHERE attempt <= made),
reduced AS (SELECT experiment_id, record_id, max(label) FILTER (attempt = made AND outcome = 'success') AS prediction_label,
  max(why) FILTER (attempt = made AND outcome = 'success') AS reasoning,
  count(*) FILTER (outcome = 'success') > 0 AS api_success, max(made)::INTEGER AS attempts_made,
  max(ts) FILTER (attempt = made) AS ts, arg_max(error_message, attempt) AS error_message,
  sum(wait_seconds)::BIGINT AS wait_seconds, max(outcome) FILTER (attempt = made) AS outcome
  FROM used GROUP BY experiment_id, record_id)"""

ORACLES["classify_error"] = f"""WITH {_EVENTS}, {PARSE}, {TRIED}
SELECT experiment_id, record_id, attempt, outcome, error_message, stops, wait_seconds FROM tried"""
ORACLES["reduce_event_attempts"] = f"WITH {_EVENTS}, {PARSE}, {TRIED}, {REDUCED} SELECT * FROM reduced"
ORACLES["reduce_attempts"] = f"WITH {_TURNS}, {PARSE}, {TRIED}, {REDUCED} SELECT * FROM reduced"
ORACLES["incremental_scoring"] = ORACLES["reduce_attempts"]
ORACLES["backoff_budget"] = f"""WITH {_EVENTS}, {PARSE}, {TRIED}, {REDUCED}
SELECT experiment_id, outcome, count(*) AS records, sum(attempts_made)::BIGINT AS attempts,
  sum(wait_seconds)::BIGINT AS wait_seconds FROM reduced GROUP BY ALL"""


def _normalized(label: str, positive: str, negative: str) -> str:
    def bare(c: str) -> str:
        return f"replace(replace(replace({c}, ' ', ''), '_', ''), '-', '')"

    x, p, n = f"lower({_strip(label)})", positive.lower(), negative.lower()
    pos, neg = _quoted(positive), _quoted(negative)
    pb, nb = (_quoted(c.replace(" ", "").replace("_", "").replace("-", "")) for c in (p, n))
    return f"""CASE WHEN coalesce({label}, '') = '' THEN NULL WHEN {x} = {_quoted(p)} THEN {pos}
      WHEN {x} = {_quoted(n)} THEN {neg} WHEN {bare(x)} = {pb} THEN {pos} WHEN {bare(x)} = {nb} THEN {neg}
      WHEN contains({bare(x)}, {pb}) THEN {pos} WHEN contains({bare(x)}, {nb}) THEN {neg} ELSE {x} END"""


ORACLES["normalize_label"] = f"""SELECT o_orderkey,
  {_normalized('o_orderpriority', 'Urgent', 'not_specified')} AS prediction FROM orders"""
ORACLES["normalize_part_names"] = f"""SELECT p_partkey, {_normalized('p_name', 'Red_Widget', 'BOLT')} AS prediction,
  {_normalized('p_brand', 'brand#1', 'brand#2')} AS brand FROM part"""
ORACLES["answered_samples"] = f"""WITH {_TURNS}, {PARSE}, {TRIED}, {REDUCED},
joined AS (SELECT {_rec('doc_id')} AS record_id, lang AS sensitive_feature,
  CASE WHEN n_chars >= 800 THEN 'good' ELSE 'bad' END AS ground_truth,
  {_normalized('r.prediction_label', 'good', 'bad')} AS prediction, coalesce(r.api_success, false) AS api_success,
  coalesce(r.attempts_made, 0) AS attempts_made FROM documents LEFT JOIN reduced r ON r.record_id = {_rec('doc_id')})
SELECT *, coalesce(api_success AND prediction = ground_truth, false) AS correct FROM joined"""
ORACLES["pluggable_scorer"] = f"""SELECT {_rec('c_custkey')} AS record_id, 'scored' AS experiment_id,
  CASE WHEN c_mktsegment = 'BUILDING' THEN 'high_income' ELSE 'low_income' END AS prediction_label,
  true AS api_success, 1 AS attempts_made FROM customer"""

# --- resume and runs -----------------------------------------------------------------------

ORACLES["resume_anti_join"] = """SELECT doc_id, lang, n_chars FROM documents
WHERE doc_id NOT IN (SELECT doc_id FROM labels)"""
ORACLES["resume_union"] = f"""WITH {PREDICTIONS}
SELECT * FROM predictions UNION ALL
SELECT {_rec('doc_id')}, NULL, CASE WHEN n_chars >= 800 THEN 'good' ELSE 'bad' END, lang, 'short', NULL, true, 1, NULL, NULL
FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)"""
ORACLES["checkpoint_store"] = """SELECT 'long' AS experiment_id, count(*) AS "rows" FROM labels
UNION ALL SELECT 'short', (SELECT count(*) FROM documents) UNION ALL SELECT 'left', 0"""
_LABELLED_ANEW = " UNION ALL ".join(
    f"""SELECT '{state}' AS state, CASE WHEN n_chars >= {limit} THEN 'good' ELSE 'bad' END AS prediction, count(*) AS "rows"
FROM documents GROUP BY 2""" for state, limit in (("first", 800), ("broken off", 800), ("anew", 1500)))
ORACLES["checkpoint_replaced"] = _LABELLED_ANEW
_MODELS = ", ".join(f"({_quoted(fv.MODELS[m][0])})" for m in fv.DEFAULT_MODELS)
ORACLES["experiment_matrix"] = f"""WITH models(model_name) AS (VALUES {_MODELS}),
sources AS (SELECT source AS dataset_name, count(*) AS samples FROM documents GROUP BY 1)
SELECT left(md5(dataset_name || '_' || model_name || '_2024-01-01T00:00:00'), 8) AS experiment_id, dataset_name, model_name,
  'together' AS api_provider, 'finance' AS dataset_type, 0.0::DOUBLE AS temperature, 2000 AS max_tokens,
  0.2::DOUBLE AS test_size, 42 AS random_state, '2024-01-01T00:00:00' AS "timestamp", samples,
  ceil(samples * 0.2::DOUBLE)::BIGINT AS test_rows FROM sources, models"""
ORACLES["config_store"] = ORACLES["experiment_matrix"].replace(", samples,\n  ceil(samples * 0.2::DOUBLE)::BIGINT AS test_rows FROM", " FROM")
_RUNS = """runs AS (SELECT left(md5(o_orderpriority || '_' || o_orderstatus || '_r1'), 8) AS experiment_id,
  o_orderpriority AS dataset, o_orderstatus AS model,
  CASE WHEN avg(o_totalprice) < 251000 THEN 'completed' ELSE 'failed' END AS status
  FROM orders GROUP BY o_orderpriority, o_orderstatus),
rollup_ AS (SELECT dataset, count(*) FILTER (status = 'completed') AS completed_models,
  count(*) FILTER (status = 'failed') AS failed_models,
  coalesce(string_agg(experiment_id, ',' ORDER BY experiment_id) FILTER (status = 'completed'), '') AS experiment_ids,
  string_agg(model || ':' || status, ',' ORDER BY model) AS results FROM runs GROUP BY dataset)"""
ORACLES["run_rollup"] = f"WITH {_RUNS} SELECT *, completed_models > 1 AS comparable FROM rollup_"
ORACLES["completed_runs"] = """SELECT left(md5(o_orderpriority || '_' || o_orderstatus || '_r1'), 8) AS experiment_id,
  o_orderpriority AS dataset, o_orderstatus AS model, 'completed' AS status, count(*) AS n FROM orders
GROUP BY o_orderpriority, o_orderstatus HAVING avg(o_totalprice) < 251000"""
ORACLES["run_status"] = f"""WITH {_RUNS} SELECT count(*) AS total_experiments,
  count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status <> 'completed') AS failed,
  round(count(*) FILTER (status = 'completed') * 100.0::DOUBLE / count(*), 6) AS success_rate FROM runs"""
ORACLES["progress_snapshot"] = f"""WITH {_RUNS} SELECT dataset AS current_dataset,
  row_number() OVER (ORDER BY dataset) AS completed_datasets, count(*) OVER () AS total_datasets,
  sum(completed_models) OVER (ORDER BY dataset)::BIGINT AS completed_so_far,
  sum(failed_models) OVER (ORDER BY dataset)::BIGINT AS failed_so_far FROM rollup_"""
ORACLES["batch_summary_store"] = ORACLES["progress_snapshot"].replace(
    "SELECT dataset AS current_dataset", "SELECT '2024-01-01T00-00-00' AS stamp, dataset AS current_dataset")
ORACLES["running_totals"] = f"""WITH limits(experiment_id, lim) AS (VALUES ('low', 10), ('high', 40)),
rows_ AS (SELECT experiment_id, l_linestatus = 'F' AS api_success, l_linestatus = 'F' AND l_quantity >= lim AS correct,
  l_linenumber AS attempts_made FROM lineitem, limits)
SELECT experiment_id, {_TOTALS} FROM rows_ GROUP BY experiment_id"""

# --- sources and loaders ----------------------------------------------------------------------

ORACLES["csv_scan"] = "SELECT doc_id, lang, md5(text) AS text_md5 FROM documents"
ORACLES["partition_scan"] = """SELECT o_orderkey, o_totalprice FROM orders
WHERE year(o_orderdate) = 1997 AND o_orderstatus IN ('F', 'P')"""
ORACLES["dense_row_ids"] = f"""SELECT {_rec('file_row_number')} AS record_id, c_name
FROM (SELECT c_name, row_number() OVER (ORDER BY c_custkey) - 1 AS file_row_number FROM customer)"""


def _loader(samples: str, capped: str = "") -> str:
    return f"""WITH {capped} samples AS ({samples}), {_split()}
SELECT record_id, ground_truth, sensitive_feature, data_description FROM taken"""


_NL = "|| chr(10) ||"
ORACLES["load_credit"] = _loader(f"""SELECT {_rec('p_partkey')} AS record_id,
  CASE WHEN p_retailprice > 1000 THEN 'good' ELSE 'bad' END AS ground_truth, p_type AS sensitive_feature,
  'Checking Account Status: ' || CASE WHEN p_size < 20 THEN 'checking account < 0 DM'
    WHEN p_size < 40 THEN 'checking account 0-200 DM' ELSE 'A19' END {_NL} 'Duration (months): ' || p_size {_NL}
  'Purpose: ' || CASE WHEN p_type = 'PROMO' THEN 'car (new)' ELSE 'others' END AS data_description FROM part""")
ORACLES["load_adult"] = _loader(f"""SELECT {_rec('c_custkey')} AS record_id,
  CASE WHEN c_acctbal > 4000 THEN '>50K' ELSE '<=50K' END AS ground_truth,
  CASE WHEN c_acctbal > 5000 THEN 'Male' ELSE 'Female' END || '_' ||
    coalesce(CASE WHEN c_acctbal > 0 THEN n_name END, 'nan') AS sensitive_feature,
  'workclass: ' || c_mktsegment {_NL} 'age: ' || c_nationkey AS data_description
  FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal <= 9000""")
ORACLES["load_compas"] = _loader(f"""SELECT {_rec('id')} AS record_id,
  CASE WHEN o_orderdate >= DATE '1998-01-01' THEN 'high_risk' ELSE 'low_risk' END AS ground_truth,
  CASE WHEN o_totalprice > 200000 THEN 'Male' ELSE 'Female' END || '_' ||
    CASE o_orderstatus WHEN 'F' THEN 'African-American' ELSE 'Caucasian' END AS sensitive_feature,
  'age: ' || year(o_orderdate) {_NL} 'priors_count: ' || o_custkey {_NL} 'c_charge_degree: ' || o_orderpriority
    AS data_description
  FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS id FROM orders) WHERE o_orderstatus IN ('F', 'O')""")
ORACLES["load_bank"] = _loader(f"""SELECT {_rec('doc_id')} AS record_id,
  CASE quality WHEN 1 THEN 'yes' ELSE 'no' END AS ground_truth, (n_chars // 500) || '_' || lang AS sensitive_feature,
  'balance: ' || n_chars AS data_description FROM docs""", DOCS + ",")
ORACLES["load_bank_three_labels"] = _loader(f"""SELECT {_rec('doc_id')} AS record_id,
  CASE WHEN toxic = 1 THEN 'unknown' WHEN quality = 1 THEN 'yes' ELSE 'no' END AS ground_truth,
  (n_chars // 500) || '_' || lang AS sensitive_feature, 'balance: ' || n_chars AS data_description FROM docs""", DOCS + ",")
ORACLES["load_folktables"] = _loader(f"""SELECT {_rec('o_orderkey')} AS record_id,
  CASE WHEN o_totalprice / 4 > 50000 THEN 'high_income' ELSE 'low_income' END AS ground_truth,
  CASE o_orderstatus WHEN 'F' THEN '1.0' ELSE '2.0' END || '_' || substr(o_orderpriority, 1, 1) || '.0' AS sensitive_feature,
  'AGEP: ' || o_custkey::DOUBLE::VARCHAR AS data_description FROM capped""",
    "capped AS (SELECT * FROM orders WHERE o_totalprice <= 480000),")
ORACLES["load_diabetes"] = _loader(f"""SELECT {_rec('o_orderkey')} AS record_id,
  CASE o_orderstatus WHEN 'F' THEN 'readmitted' ELSE 'not_readmitted' END AS ground_truth,
  {_SENIOR} AS sensitive_feature,
  'time_in_hospital: ' || year(o_orderdate) {_NL} 'num_medications: ' || o_custkey AS data_description
  FROM (SELECT *, {_AGE} AS age FROM orders) WHERE o_totalprice > 10000""")

ORACLES["survey_source"] = """SELECT o_orderkey AS row_id, round(o_totalprice, 2) AS PINCP, year(o_orderdate)::INT AS year,
  CASE o_orderstatus WHEN 'F' THEN 'CA' ELSE 'NV' END AS state FROM orders
WHERE year(o_orderdate) = 1996 AND o_orderstatus IN ('F', 'O') AND o_totalprice > 1000"""
