"""Registered evaluation queries on scored messages, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mailrisk import lexicon as lx
from mailrisk.config import DEFAULT as CFG
from mailrisk.functions import text as tx
from mailrisk.operators import ensemble as en
from mailrisk.operators import metrics as mt
from mailrisk.plans import oracle_base as ob
from mailrisk.plans.mail_view import corpus_view, with_label
from mailrisk.plans.q_scoring import scored_mail
from mailrisk.plans.registry import ORACLES, register
from mailrisk.session import materialise

BASE_RATE, TARGET = 0.01, 0.80
NARROW = [
    "msg_id", "source", "trusted_sender", "rule_score", "model_score", "reason", "promo_reason",
    "v_rules", "v_model", "v_ensemble", "v_uncapped", "v_promo", "v_undamped", "v_legacy",
]


def with_language(df: DataFrame) -> DataFrame:
    spoken = F.concat_ws(" ", "subject", "content")
    return df.withColumn("language", tx.language_of(spoken))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores, language and label of every message; the label is joined after the texts are gone."""
    narrow = with_language(scored_mail(spark, sf_dir)).select(*NARROW, "language")
    return with_label(narrow, spark, sf_dir)


def score_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores without the texts, written once for queries that pass over them more than once."""
    return materialise(scores(spark, sf_dir), "scores")


V = f"""{ob.MAIL}, {ob.variants()},
VL AS (SELECT *, CASE WHEN regexp_matches(subject || ' ' || content, '{ob.HEBREW_PATTERN}') THEN 'Hebrew' ELSE 'English' END AS language FROM V)"""


def metric_sql(source: str, keep: str) -> str:
    return f"""SELECT {keep}, tp, fp, tn, fn, accuracy, "precision", recall, fnr, fpr,
  CASE WHEN "precision" + recall > 0 THEN 2 * "precision" * recall / ("precision" + recall) ELSE 0 END AS f1
FROM (SELECT *, CASE WHEN tp + fp + tn + fn > 0 THEN (tp + tn) / (tp + fp + tn + fn)::DOUBLE ELSE 0 END AS accuracy,
  CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE ELSE 0 END AS "precision",
  CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE ELSE 0 END AS recall,
  CASE WHEN tp + fn > 0 THEN fn / (tp + fn)::DOUBLE ELSE 0 END AS fnr,
  CASE WHEN fp + tn > 0 THEN fp / (fp + tn)::DOUBLE ELSE 0 END AS fpr FROM {source})"""


def conf_sql(cond: str) -> str:
    return f"""count(*) FILTER (WHERE label = 1 AND {cond}) AS tp, count(*) FILTER (WHERE label = 0 AND {cond}) AS fp,
  count(*) FILTER (WHERE label = 0 AND NOT ({cond})) AS tn, count(*) FILTER (WHERE label = 1 AND NOT ({cond})) AS fn"""


# Rows against thresholds, as the definition has it: the ceiling belongs to the threshold tried.
COUNTS = f"""
TH AS (SELECT t::INTEGER AS threshold,
  round_even(t + (100 - t) * 45e-2, 0) - 1 AS cap FROM range(0, 101) r(t)),
CT AS (SELECT threshold, {conf_sql("CASE WHEN rule_score < 15 THEN least(v_uncapped, cap) ELSE v_uncapped END >= threshold")}
  FROM VL, TH GROUP BY threshold),
MT AS ({metric_sql('CT', 'threshold')})"""
CURVE = f"""{COUNTS},
P0 AS (SELECT *, CASE WHEN tp > 0 THEN CASE WHEN 1e-2 * recall + (1 - 1e-2) * fpr > 0
    THEN 1e-2 * recall / (1e-2 * recall + (1 - 1e-2) * fpr) ELSE 0 END END AS projected FROM MT),
CV AS (SELECT threshold, tp, fp, fn, recall, fpr, coalesce(last_value(projected IGNORE NULLS)
    OVER (ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING), 1) AS "precision" FROM P0)"""
SWEEP = f"""{COUNTS},
W0 AS (SELECT threshold, fp, fn, recall, fpr, CASE WHEN 1e-2 * recall + (1 - 1e-2) * fpr > 0
    THEN 1e-2 * recall / (1e-2 * recall + (1 - 1e-2) * fpr) ELSE 0 END AS projected
  FROM MT WHERE threshold BETWEEN 20 AND 99 AND threshold % 2 = 0),
SW AS (SELECT *, CASE WHEN projected + recall > 0 THEN 2 * projected * recall / (projected + recall) ELSE 0 END AS projected_f1,
  fpr * 1000 * (1 - 1e-2) AS alarms_per_1000, recall * 1000 * 1e-2 AS caught_per_1000 FROM W0)"""


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mt.threshold_counts(scores(spark, sf_dir), "v_uncapped", "rule_score")


@register("confusion_by_group", f"""WITH {V},
G AS (SELECT coalesce(language, 'overall') AS language, count(*) AS n_rows, sum(label)::BIGINT AS n_phishing,
  {conf_sql(f'v_ensemble >= {CFG.threshold}')} FROM VL GROUP BY ROLLUP (language))
{metric_sql('G', 'language, n_rows, n_phishing, n_rows < 200 AS small_sample')}""")
def confusion_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mt.metrics_by(scores(spark, sf_dir), "v_ensemble", "language", CFG.threshold)


@register("threshold_curve", f"WITH {V}, {CURVE} SELECT * FROM CV")
def threshold_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mt.pr_curve(counts(spark, sf_dir), BASE_RATE)


@register("average_precision", f"""WITH {V}, {CURVE}
SELECT round(sum(area), 9) AS average_precision FROM (
  SELECT (recall - coalesce(lag(recall) OVER (ORDER BY threshold DESC), 0)) * "precision" AS area FROM CV)""")
def average_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mt.average_precision(mt.pr_curve(counts(spark, sf_dir), BASE_RATE))


@register("recall_targets", f"""WITH {V}, {CURVE},
B AS (SELECT g AS target, max(threshold) AS threshold FROM CV, (SELECT unnest([{', '.join(ob.dbl(t) for t in lx.RECALL_TARGETS)}]) AS g)
  WHERE recall >= g GROUP BY g)
SELECT threshold, min(target) AS target, any_value(recall) AS recall, any_value("precision") AS "precision"
FROM B JOIN CV USING (threshold) GROUP BY threshold""")
def recall_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mt.recall_targets(mt.pr_curve(counts(spark, sf_dir), BASE_RATE))


@register("coarse_sweep", f"WITH {V}, {SWEEP} SELECT * FROM SW")
def coarse_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mt.coarse_sweep(counts(spark, sf_dir), BASE_RATE)


@register("sweep_summary", f"""WITH {V}, {SWEEP},
BE AS (SELECT * FROM SW ORDER BY projected_f1 DESC, threshold LIMIT 1),
HI AS (SELECT min(threshold) AS threshold, arg_min(recall, threshold) AS recall FROM SW WHERE projected >= 8e-1),
CU AS (SELECT * FROM SW ORDER BY abs(threshold - {CFG.threshold}), threshold LIMIT 1),
RG AS (SELECT max(recall) - min(recall) AS recall_span, min(fpr) AS lowest_fpr FROM SW)
SELECT BE.threshold AS best_threshold, coalesce(HI.threshold, -1) AS hit_threshold, CU.threshold AS current_threshold,
  CU.recall AS current_recall, CU.projected AS current_precision, coalesce(CU.recall - HI.recall, 0) AS recall_cost,
  1e-2 * CU.recall * {ob.dbl(1 - TARGET)} / {ob.dbl((1 - BASE_RATE) * TARGET)} AS fpr_needed, lowest_fpr, recall_span
FROM BE, HI, CU, RG""")
def sweep_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mt.sweep_summary(mt.coarse_sweep(counts(spark, sf_dir), BASE_RATE), BASE_RATE, TARGET)


@register("language_sweep", f"""WITH {V}, {COUNTS},
HB AS (SELECT threshold, {conf_sql("CASE WHEN rule_score < 15 THEN least(v_uncapped, cap) ELSE v_uncapped END >= threshold")}
  FROM VL, TH WHERE language = 'Hebrew' GROUP BY threshold)
SELECT MT.threshold, accuracy, f1, MT.fp, MT.fn, HB.fp AS fp_hebrew, HB.fn AS fn_hebrew
FROM MT JOIN HB USING (threshold) WHERE threshold BETWEEN 20 AND 80 AND threshold % 5 = 0""")
def language_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mt.language_sweep(score_table(spark, sf_dir), "v_uncapped", "rule_score")


_GRID = f"""
GB AS (SELECT unnest([{', '.join(ob.dbl(b) for b in mt.BOOSTS)}]) AS boost),
GD AS (SELECT unnest([{', '.join(ob.dbl(d) for d in mt.DAMPINGS)}]) AS damping),
GS AS (SELECT boost, damping, label, floor(least(greatest(model_score * CASE WHEN trusted THEN damping ELSE 1 END
    + boost * rule_score, rule_score::DOUBLE), 1e2))::INTEGER AS step FROM VL, GB, GD),
GH AS (SELECT boost, damping, step, sum(label)::BIGINT AS pos, count(*) - sum(label)::BIGINT AS neg FROM GS GROUP BY ALL),
GT AS (SELECT t::INTEGER AS threshold FROM range(20, 96) r(t)),
GC AS (SELECT boost, damping, threshold, sum(pos) FILTER (WHERE step >= threshold) AS tp0, sum(neg) FILTER (WHERE step >= threshold) AS fp0,
    sum(pos) AS p, sum(neg) AS n FROM GH, GT GROUP BY ALL),
G2 AS (SELECT boost, damping, threshold, coalesce(tp0, 0)::BIGINT AS tp, coalesce(fp0, 0)::BIGINT AS fp,
    (n - coalesce(fp0, 0))::BIGINT AS tn, (p - coalesce(tp0, 0))::BIGINT AS fn FROM GC),
GM AS ({metric_sql('G2', 'boost, damping, threshold')})"""


@register("calibration_grid", f"WITH {V}, {_GRID} SELECT * FROM GM")
def calibration_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mt.calibration_grid(scores(spark, sf_dir))


_CURRENT = (
    f"CASE WHEN rule_score < 15 THEN least(least(greatest(model_score * CASE WHEN trusted THEN 25e-2 ELSE 1 END + 5e-1 * rule_score, "
    f"rule_score::DOUBLE), 1e2), {CFG.ceiling}) ELSE least(greatest(model_score * CASE WHEN trusted THEN 25e-2 ELSE 1 END "
    f"+ 5e-1 * rule_score, rule_score::DOUBLE), 1e2) END >= {CFG.threshold}"
)


@register("calibration_best", f"""WITH {V}, {_GRID},
NW AS (SELECT {conf_sql(_CURRENT)} FROM VL), NM AS ({metric_sql('NW', '1 AS one')}),
BT AS (SELECT 'f1' AS metric, * FROM (SELECT * FROM GM ORDER BY f1 DESC, boost, damping, threshold LIMIT 1)
  UNION ALL SELECT 'accuracy', * FROM (SELECT * FROM GM ORDER BY accuracy DESC, boost, damping, threshold LIMIT 1)
  UNION ALL SELECT 'fnr', * FROM (SELECT * FROM GM ORDER BY fnr, boost, damping, threshold LIMIT 1))
SELECT metric, boost, damping, threshold, BT.tp, BT.fp, BT.f1 - NM.f1 AS f1_change, BT.accuracy - NM.accuracy AS accuracy_change,
  BT.fnr - NM.fnr AS fnr_change FROM BT, NM""")
def calibration_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best grid point per goal, and what it would change against the configured setting."""
    table = score_table(spark, sf_dir)
    grid = materialise(mt.calibration_grid(table), "grid")
    multiplier = F.when(F.col("trusted_sender"), CFG.trust_damping).otherwise(1.0)
    now_score = en.combine(F.col("model_score"), F.col("rule_score"), multiplier)
    now = mt.with_metrics(table.agg(*mt.confusion(F.col("label"), now_score >= CFG.threshold))).select(
        F.col("f1").alias("_f1"), F.col("accuracy").alias("_accuracy"), F.col("fnr").alias("_fnr")
    )
    out = None
    for goal in ("f1", "accuracy", "fnr"):
        best = mt.best_setting(grid, goal).select(F.lit(goal).alias("metric"), "*")
        out = best if out is None else out.unionByName(best)
    # One row on the right: the metrics of the current setting.
    return out.join(F.broadcast(now)).select(
        "metric", "boost", "damping", "threshold", "tp", "fp",
        (F.col("f1") - F.col("_f1")).alias("f1_change"),
        (F.col("accuracy") - F.col("_accuracy")).alias("accuracy_change"),
        (F.col("fnr") - F.col("_fnr")).alias("fnr_change"),
    )


@register("base_rate_projection", f"""WITH {V}, G AS (SELECT {conf_sql(f'v_ensemble >= {CFG.threshold}')} FROM VL),
MT AS ({metric_sql('G', '1 AS one')}),
B0 AS (SELECT b AS base_rate, 1000 * b * recall AS caught, 1000 * b - 1000 * b * recall AS missed,
  1000 * (1 - b) * fpr AS false_alarms, 1000 * (1 - b) AS legit
  FROM MT, (SELECT unnest([{', '.join(ob.dbl(b) for b in lx.BASE_RATES)}]) AS b))
SELECT base_rate, caught, missed, false_alarms, CASE WHEN caught + false_alarms > 0 THEN caught / (caught + false_alarms) ELSE 0 END AS "precision",
  (caught + (legit - false_alarms)) / 1000 AS accuracy FROM B0""")
def base_rate_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = scores(spark, sf_dir).agg(*mt.confusion(F.col("label"), F.col("v_ensemble") >= CFG.threshold))
    return mt.base_rate_projection(mt.with_metrics(measured))


def correctness() -> dict[str, Column]:
    t, truth = CFG.threshold, F.col("label") == 1
    return {
        "the system": (F.col("v_ensemble") >= t) == truth,
        "model alone": (F.col("v_model") >= t) == truth,
        "rules alone": (F.col("v_rules") >= t) == truth,
        "always safe": ~truth,
    }


def _others() -> tuple[Column, dict[str, Column]]:
    every = correctness()
    base = every.pop("the system")
    return base, every


@register("mcnemar_counts", f"""WITH {V}, N AS (SELECT (v_ensemble >= 70) = (label = 1) AS base,
  unnest([{{'c': 'model alone', 'ok': (v_model >= 70) = (label = 1)}}, {{'c': 'rules alone', 'ok': (v_rules >= 70) = (label = 1)}},
          {{'c': 'always safe', 'ok': label <> 1}}]) AS x FROM VL),
K AS (SELECT x.c AS configuration, count(*) FILTER (WHERE NOT x.ok AND base) AS b01, count(*) FILTER (WHERE x.ok AND NOT base) AS b10 FROM N GROUP BY 1)
SELECT *, CASE WHEN b01 + b10 > 0 THEN (abs(b01 - b10) - 1) * (abs(b01 - b10) - 1) / (b01 + b10)::DOUBLE ELSE 0 END AS chi2 FROM K""")
def mcnemar_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, others = _others()
    return mt.mcnemar(scores(spark, sf_dir), base, others)


@register("mcnemar_test", f"""SELECT *, chi2 > {mt.CRITICAL_CHI2!r}::DOUBLE AS significant, true AS p_agrees FROM ({ORACLES['mcnemar_counts']})""")
def mcnemar_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the decision at 5 %, and whether the p-value agrees with it; p itself needs a function SQL lacks."""
    base, others = _others()
    tested = mt.with_p_value(mt.mcnemar(scores(spark, sf_dir), base, others))
    return tested.withColumn("p_agrees", (F.col("p") < 0.05) == F.col("significant")).drop("p")


@register("bootstrap_ci", f"""WITH {V}, N AS (SELECT unnest([
  {{'c': 'the system', 'ok': (v_ensemble >= 70) = (label = 1)}}, {{'c': 'model alone', 'ok': (v_model >= 70) = (label = 1)}},
  {{'c': 'rules alone', 'ok': (v_rules >= 70) = (label = 1)}}, {{'c': 'always safe', 'ok': label <> 1}}]) AS x FROM VL)
SELECT x.c AS configuration, count(*) AS n_rows, count(*) FILTER (WHERE x.ok) / count(*)::DOUBLE AS accuracy,
  true AS holds_accuracy, true AS plausible_width FROM N GROUP BY 1""")
def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resampled ends depend on the random generator; SQL checks what they must satisfy.

    The interval holds the accuracy and is 0.6 to 1.5 times as wide as the normal approximation.
    """
    found = mt.bootstrap_interval(scores(spark, sf_dir), correctness())
    normal = 2 * 1.96 * F.sqrt(F.col("accuracy") * (1 - F.col("accuracy")) / F.col("n_rows"))
    width = F.col("ci_high") - F.col("ci_low")
    return found.select(
        "configuration", "n_rows", "accuracy",
        F.col("accuracy").between(F.col("ci_low"), F.col("ci_high")).alias("holds_accuracy"),
        ((normal == 0) | width.between(0.6 * normal, 1.5 * normal)).alias("plausible_width"),
    )


_SNIP = "trim(regexp_replace({c}, '[" + ob.SP + "]+', ' ', 'g'))"


def _snippet_sql(c: str, n: int) -> str:
    one = _SNIP.replace("{c}", c)
    return f"CASE WHEN length({one}) > {n} THEN substring({one}, 1, {n}) || '...' ELSE {one} END"


ERRORS = f"""
ER AS (SELECT msg_id, CASE WHEN label = 0 THEN 'fp' ELSE 'fn' END AS kind, {ob.py_round('v_ensemble', 1)} AS score,
  {ob.py_round('v_model', 1)} AS model, {ob.py_round('v_rules', 1)} AS rules, source, language,
  CASE WHEN trim(sender) <> '' THEN 'yes' ELSE 'no' END AS has_sender,
  CASE WHEN v_rules >= v_ensemble - 1e-2 THEN 'rules' WHEN v_model >= {CFG.threshold} THEN 'model' ELSE 'both' END AS driver,
  substring(sender, 1, 40) AS sender, {_snippet_sql('subject', 50)} AS subject, {_snippet_sql('content', 90)} AS content
  FROM VL WHERE (v_ensemble >= {CFG.threshold}) <> (label = 1))"""


def found_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    narrow = mt.shown_text(with_language(scored_mail(spark, sf_dir)))
    return mt.errors(with_label(narrow.select(*NARROW, "language", "sender", "subject", "content"), spark, sf_dir))


@register("error_mining", f"WITH {V}, {ERRORS} SELECT * FROM ER")
def error_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found_errors(spark, sf_dir)


@register("error_shares", f"""WITH {V}, {ERRORS}, U AS (
  SELECT kind, unnest([{{'d': 'source', 'v': source}}, {{'d': 'language', 'v': language}}, {{'d': 'has_sender', 'v': has_sender}}, {{'d': 'driver', 'v': driver}}]) AS x FROM ER)
SELECT kind, x.d AS dimension, x.v AS "value", count(*) AS n_errors, count(*) / (sum(count(*)) OVER (PARTITION BY kind, x.d))::DOUBLE AS share
FROM U GROUP BY kind, x.d, x.v""")
def error_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mt.error_shares(found_errors(spark, sf_dir))


@register("worst_errors", f"""WITH {V}, {ERRORS}
SELECT *, row_number() OVER (PARTITION BY kind ORDER BY score DESC, msg_id) AS nth FROM ER QUALIFY nth <= 15""")
def worst_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mt.worst_errors(found_errors(spark, sf_dir))


@register("sanity_margin", f"""WITH {V}, A AS (SELECT max(v_ensemble) FILTER (WHERE label = 0) AS legit_max,
  min(v_ensemble) FILTER (WHERE label = 1) AS phish_min FROM VL),
B AS (SELECT *, floor(legit_max)::INTEGER + 1 AS safe_low, floor(phish_min)::INTEGER AS safe_high FROM A)
SELECT legit_max, phish_min, legit_max >= phish_min AS overlap, safe_low, safe_high,
  floor((safe_low + safe_high) / 2e0)::INTEGER AS middle, safe_low <= 70 AND safe_high >= 70 AS configured_inside FROM B""")
def sanity_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mt.sanity_margin(scores(spark, sf_dir), "v_ensemble")


@register("exact_auc", f"""WITH {V}, R AS (SELECT label, rank() OVER (ORDER BY model_score)
    + (count(*) OVER (PARTITION BY model_score) - 1) / 2e0 AS r FROM VL),
S9 AS (SELECT count(*) FILTER (WHERE label = 1) AS n_pos, count(*) FILTER (WHERE label = 0) AS n_neg, sum(r) FILTER (WHERE label = 1) AS rs FROM R)
SELECT n_pos, n_neg, (2 * rs - n_pos * (n_pos + 1)) / (2e0 * n_pos * n_neg) AS auc FROM S9""")
def exact_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mt.exact_auc(scores(spark, sf_dir), "model_score")


@register("target_gate", f"""WITH {V}, G AS (SELECT {conf_sql(f'v_ensemble >= {CFG.threshold}')} FROM VL),
MT AS ({metric_sql('G', '1 AS one')}),
R AS (SELECT label, rank() OVER (ORDER BY model_score) + (count(*) OVER (PARTITION BY model_score) - 1) / 2e0 AS r FROM VL),
A AS (SELECT count(*) FILTER (WHERE label = 1) AS p, count(*) FILTER (WHERE label = 0) AS n, sum(r) FILTER (WHERE label = 1) AS rs FROM R)
SELECT f1, fnr, (2 * rs - p * (p + 1)) / (2e0 * p * n) AS auc, f1 >= 88e-2 AS f1_met, fnr < 5e-2 AS fnr_met,
  (2 * rs - p * (p + 1)) / (2e0 * p * n) >= 92e-2 AS auc_met FROM MT, A""")
def target_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = score_table(spark, sf_dir)
    measured = mt.with_metrics(table.agg(*mt.confusion(F.col("label"), F.col("v_ensemble") >= CFG.threshold)))
    # Both sides are one row.
    both = measured.select("f1", "fnr").join(F.broadcast(mt.exact_auc(table, "model_score").select("auc")))
    return mt.target_gate(both)


@register("variant_ablation", f"""WITH {V}, N AS (SELECT label, unnest([
  {{'v': 'rules only', 'y': v_rules >= 70}}, {{'v': 'model only', 'y': v_model >= 50}}, {{'v': 'ensemble', 'y': v_ensemble >= 70}},
  {{'v': 'with promo damping', 'y': v_promo >= 70}}, {{'v': 'no damping', 'y': v_undamped >= 70}}, {{'v': 'legacy average', 'y': v_legacy >= 70}}]) AS x FROM VL),
G AS (SELECT x.v AS variant, {conf_sql('x.y')} FROM N GROUP BY x.v)
{metric_sql('G', 'variant')}""")
def variant_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mt.variant_table(scores(spark, sf_dir))


@register("who_decided", f"""WITH {V}, K AS (SELECT
  count(*) FILTER (WHERE label = 1 AND v_model < 50 AND v_ensemble >= 70) AS rescued,
  count(*) FILTER (WHERE label = 1 AND v_model >= 50 AND v_ensemble < 70) AS lost,
  count(*) FILTER (WHERE label = 0 AND v_model < 50 AND v_ensemble >= 70) AS caused,
  count(*) FILTER (WHERE label = 0 AND v_model >= 50 AND v_ensemble < 70) AS prevented FROM VL)
SELECT *, rescued + prevented - lost - caused AS net FROM K""")
def who_decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mt.who_decided(scores(spark, sf_dir))


@register("damping_report", f"""WITH {V} SELECT promo_reason AS reason, count(*) AS n_rows, count(*) FILTER (WHERE label = 1) AS n_phishing,
  count(*) FILTER (WHERE label = 1 AND v_model >= 50 AND v_ensemble < 70) AS n_lost, count(*) FILTER (WHERE reason <> 'none') AS n_fired_now
FROM VL GROUP BY promo_reason""")
def damping_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mt.damping_report(scores(spark, sf_dir))


@register("formula_drift", f"""WITH {ob.MAIL}, {ob.scored()}, E1 AS (SELECT *, {ob.DAMPING} AS d FROM S),
E2 AS (SELECT {ob.combined('d')} AS shipped, least(greatest(model_score * d + rule_score / 2e0, rule_score::DOUBLE),
  CASE WHEN rule_score < {CFG.corroboration_floor} THEN {CFG.ceiling}e0 ELSE 1e2 END) AS mirrored FROM E1)
SELECT count(*) FILTER (WHERE abs(shipped - mirrored) > 1e-9) AS drifted, count(*) AS n_rows FROM E2""")
def formula_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mirrored formula of the ablation against the shipped verdict, on every message."""
    from mailrisk.plans.mail_view import mail_view

    shipped = en.score_ensemble(mail_view(spark, sf_dir))
    return en.formula_drift(shipped)


@register("corpus_guards", f"""WITH {ob.CORPUS} SELECT count(DISTINCT source) AS n_sources, count(DISTINCT label) AS n_labels,
  count(*) < 200 AS too_few, count(*) AS n_rows FROM C""")
def corpus_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = corpus_view(spark, sf_dir)
    per_source = rows.groupBy("source", "label").agg(F.count(F.lit(1)).alias("n"))
    return per_source.agg(
        F.count_distinct("source").alias("n_sources"), F.count_distinct("label").alias("n_labels"),
        (F.sum("n") < 200).alias("too_few"), F.sum("n").alias("n_rows"),
    )
