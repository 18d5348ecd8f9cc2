"""Evaluation: confusion, metrics, curves, sweeps, significance, error mining.

Scores are folded into a histogram of at most 101 integer steps per class in one pass; every
threshold is then read off cumulative sums of that histogram, never off the rows again.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mailrisk import lexicon as lx
from mailrisk.config import DEFAULT, ScoringConfig, bands_for
from mailrisk.functions import text as tx
from mailrisk.session import materialise

SMALL_SAMPLE = 200


def _all():
    """Window over a table of at most 101 score steps or 10,001 score values."""
    return W.partitionBy(F.lit(0))


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def confusion(truth: Column, positive: Column) -> list[Column]:
    return [
        F.count_if((truth == 1) & positive).alias("tp"),
        F.count_if((truth == 0) & positive).alias("fp"),
        F.count_if((truth == 0) & ~positive).alias("tn"),
        F.count_if((truth == 1) & ~positive).alias("fn"),
    ]


def with_metrics(df: DataFrame) -> DataFrame:
    """accuracy, precision, recall, f1, fnr, fpr from tp/fp/tn/fn; 0 where undefined."""
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    rates = df.select(
        "*",
        _ratio(tp + tn, tp + fp + tn + fn).alias("accuracy"),
        _ratio(tp, tp + fp).alias("precision"),
        _ratio(tp, tp + fn).alias("recall"),
        _ratio(fn, tp + fn).alias("fnr"),
        _ratio(fp, fp + tn).alias("fpr"),
    )
    p, r = F.col("precision"), F.col("recall")
    return rates.withColumn("f1", _ratio(2 * p * r, p + r))


def metrics_by(df: DataFrame, score: str, by: str, threshold: float) -> DataFrame:
    """Metrics overall and per value of ``by``, with a flag for groups under 200 rows."""
    grouped = df.rollup(by).agg(
        F.grouping(by).alias("_overall"),
        F.count(F.lit(1)).alias("n_rows"),
        F.sum("label").cast("bigint").alias("n_phishing"),
        *confusion(F.col("label"), F.col(score) >= threshold),
    )
    named = grouped.withColumn(by, F.when(F.col("_overall") == 1, "overall").otherwise(F.col(by)))
    return with_metrics(named.drop("_overall")).withColumn("small_sample", F.col("n_rows") < SMALL_SAMPLE)


def precision_at(tpr: Column, fpr: Column, base_rate: float | Column) -> Column:
    """Precision the measured rates would give at this share of phishing."""
    rate = base_rate if isinstance(base_rate, Column) else F.lit(base_rate)
    hits, alarms = rate * tpr, (1 - rate) * fpr
    return F.when(hits + alarms > 0, hits / (hits + alarms)).otherwise(0.0)


def fpr_needed(tpr: Column, base_rate: float, target: float) -> Column:
    """False-positive rate a precision target requires at a base rate."""
    return F.lit(base_rate) * tpr * F.lit(1 - target) / F.lit((1 - base_rate) * target)


def score_histogram(df: DataFrame, score: str, rules: str | None, cfg: ScoringConfig) -> DataFrame:
    """Counts per integer score step and class; uncorroborated rows are counted apart."""
    held = F.lit(False) if rules is None else F.col(rules) < cfg.corroboration_floor

    def n(label: int, capped: bool) -> Column:
        return F.count_if((F.col("label") == label) & (held if capped else ~held))

    return df.groupBy(F.floor(score).cast("int").alias("step")).agg(
        n(1, False).alias("pos"), n(0, False).alias("neg"),
        n(1, True).alias("pos_held"), n(0, True).alias("neg_held"),
    )


_HIST = ["pos", "neg", "pos_held", "neg_held"]


def threshold_counts(
    df: DataFrame, score: str, rules: str | None = None, cfg: ScoringConfig = DEFAULT
) -> DataFrame:
    """tp, fp, tn, fn at every threshold 0..100.

    With ``rules`` the score is the uncapped one and the ceiling that each threshold implies is
    applied: held-back rows count as negative where that ceiling lies below the threshold.
    """
    hist = score_histogram(df, score, rules, cfg)
    # Empty steps come in by union: a join would push a null test on the score below the scoring.
    empty = df.sparkSession.range(0, 101).select(
        F.col("id").cast("int").alias("step"), *[F.lit(0).cast("bigint").alias(c) for c in _HIST]
    )
    filled = empty.unionByName(hist).groupBy("step").agg(*[F.sum(c).alias(c) for c in _HIST])
    above = _all().orderBy(F.desc("step")).rowsBetween(W.unboundedPreceding, 0)
    blocked = [t for t in range(101) if bands_for(t)[2] - 1 < t]
    counted = ~F.col("step").isin(blocked) if blocked else F.lit(True)

    def reach(plain: str, held: str) -> Column:
        return F.sum(plain).over(above) + F.when(counted, F.sum(held).over(above)).otherwise(0)

    total = filled.select(
        F.col("step").alias("threshold"),
        reach("pos", "pos_held").alias("tp"),
        reach("neg", "neg_held").alias("fp"),
        (F.sum("pos").over(_all()) + F.sum("pos_held").over(_all())).alias("_p"),
        (F.sum("neg").over(_all()) + F.sum("neg_held").over(_all())).alias("_n"),
    )
    return total.select(
        "threshold", "tp", "fp", (F.col("_n") - F.col("fp")).alias("tn"), (F.col("_p") - F.col("tp")).alias("fn")
    )


def pr_curve(counts: DataFrame, base_rate: float = 0.01) -> DataFrame:
    """Recall, FPR and projected precision per threshold; without detections the last one carries."""
    rated = with_metrics(counts)
    projected = F.when(F.col("tp") > 0, precision_at(F.col("recall"), F.col("fpr"), base_rate))
    down = _all().orderBy(F.desc("threshold")).rowsBetween(W.unboundedPreceding, 0)
    carried = F.coalesce(F.last(projected, ignorenulls=True).over(down), F.lit(1.0))
    return rated.select("threshold", "tp", "fp", "fn", "recall", "fpr", carried.alias("precision"))


def average_precision(curve: DataFrame) -> DataFrame:
    """Step-wise area: sum of (recall - previous recall) * precision along falling thresholds."""
    down = _all().orderBy(F.desc("threshold"))
    gain = F.col("recall") - F.coalesce(F.lag("recall").over(down), F.lit(0.0))
    return curve.select((gain * F.col("precision")).alias("area")).agg(
        F.round(F.sum("area"), 9).alias("average_precision")
    )


def recall_targets(curve: DataFrame, targets: Sequence[float] = tuple(lx.RECALL_TARGETS)) -> DataFrame:
    """Highest threshold that reaches each recall target; a repeated threshold is listed once."""
    goals = F.array(*[F.lit(t) for t in targets])
    reached = curve.select(
        "threshold", "recall", "precision", F.explode(F.filter(goals, lambda g: F.col("recall") >= g)).alias("target")
    )
    best = reached.groupBy("target").agg(F.max_by(F.struct("threshold", "recall", "precision"), "threshold").alias("p"))
    return best.groupBy("p.threshold").agg(
        F.min("target").alias("target"),
        F.first("p.recall").alias("recall"),
        F.first("p.precision").alias("precision"),
    )


def coarse_sweep(counts: DataFrame, base_rate: float = 0.01, start: int = 20, stop: int = 100, step: int = 2) -> DataFrame:
    """Threshold table with projected precision, F1, alarms and catches per thousand messages."""
    t = F.col("threshold")
    rows = with_metrics(counts).filter((t >= start) & (t < stop) & ((t - start) % step == 0))
    p = precision_at(F.col("recall"), F.col("fpr"), base_rate)
    rows = rows.select("threshold", "fp", "fn", "recall", "fpr", p.alias("projected"))
    return rows.select(
        "*",
        _ratio(2 * F.col("projected") * F.col("recall"), F.col("projected") + F.col("recall")).alias("projected_f1"),
        (F.col("fpr") * 1000 * F.lit(1 - base_rate)).alias("alarms_per_1000"),
        (F.col("recall") * 1000 * F.lit(base_rate)).alias("caught_per_1000"),
    )


def sweep_summary(
    sweep: DataFrame, base_rate: float = 0.01, target: float = 0.80, cfg: ScoringConfig = DEFAULT
) -> DataFrame:
    """Best F1, first threshold reaching the target precision, current point, recall span."""
    row = F.struct("threshold", "recall", "projected")
    t = F.col("threshold")
    facts = sweep.agg(
        F.max_by(row, F.struct("projected_f1", -t)).alias("best"),
        F.min_by(F.when(F.col("projected") >= target, row), F.when(F.col("projected") >= target, t)).alias("hit"),
        F.min_by(row, F.struct(F.abs(t - cfg.threshold), t)).alias("current"),
        (F.max("recall") - F.min("recall")).alias("recall_span"),
        F.min("fpr").alias("lowest_fpr"),
    )
    return facts.select(
        F.col("best.threshold").alias("best_threshold"),
        F.coalesce("hit.threshold", F.lit(-1)).alias("hit_threshold"),
        F.col("current.threshold").alias("current_threshold"),
        F.col("current.recall").alias("current_recall"),
        F.col("current.projected").alias("current_precision"),
        F.coalesce(F.col("current.recall") - F.col("hit.recall"), F.lit(0.0)).alias("recall_cost"),
        fpr_needed(F.col("current.recall"), base_rate, target).alias("fpr_needed"),
        "lowest_fpr",
        "recall_span",
    )


def language_sweep(df: DataFrame, score: str, rules: str, cfg: ScoringConfig = DEFAULT) -> DataFrame:
    """Accuracy, F1, FP, FN at 20..80 in steps of five, with the Hebrew errors beside them."""
    everything = with_metrics(threshold_counts(df, score, rules, cfg))
    hebrew = threshold_counts(df.filter("language = 'Hebrew'"), score, rules, cfg).select(
        "threshold", F.col("fp").alias("fp_hebrew"), F.col("fn").alias("fn_hebrew")
    )
    t = F.col("threshold")
    picked = everything.filter((t >= 20) & (t <= 80) & (t % 5 == 0))
    return picked.join(hebrew, "threshold").select(
        "threshold", "accuracy", "f1", "fp", "fn", "fp_hebrew", "fn_hebrew"
    )


BOOSTS = [round(x * 0.1, 2) for x in range(0, 11)]
DAMPINGS = [round(x * 0.05, 2) for x in range(1, 21)]
GRID_THRESHOLDS = (20, 95)


def calibration_grid(df: DataFrame) -> DataFrame:
    """Confusion and metrics for every boost, damping and threshold.

    Rows are folded into cells of equal (model, rules, trusted, label) first. Model scores enter with two
    decimals (``ensemble.with_model_score``) and rule scores are whole, so the number of cells does not grow with
    the data. Mail
    from unknown senders does not depend on the damping and is expanded after the histogram.
    """
    cells = df.groupBy(F.col("model_score").alias("m"), "rule_score", "trusted_sender", "label").agg(F.count(F.lit(1)).alias("n"))
    boosts = F.array(*[F.lit(b) for b in BOOSTS])
    dampings = F.array(*[F.lit(d) for d in DAMPINGS])
    undamped = F.array(F.lit(None).cast("double"))
    tried = cells.withColumn("boost", F.explode(boosts)).withColumn(
        "damping", F.explode(F.when(F.col("trusted_sender"), dampings).otherwise(undamped))
    )
    rules = F.col("rule_score")
    score = F.least(
        F.greatest(F.col("m") * F.coalesce("damping", F.lit(1.0)) + F.col("boost") * rules, rules.cast("double")),
        F.lit(100.0),
    )
    hist = tried.groupBy("boost", "damping", F.floor(score).cast("int").alias("step")).agg(
        F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("pos"),
        F.sum(F.when(F.col("label") == 0, F.col("n")).otherwise(0)).alias("neg"),
    )
    spread = F.when(F.col("damping").isNull(), dampings).otherwise(F.array("damping"))
    full = hist.withColumn("damping", F.explode(spread)).groupBy("boost", "damping", "step").agg(
        F.sum("pos").alias("pos"), F.sum("neg").alias("neg")
    )
    n_steps = 101
    ids = df.sparkSession.range(len(BOOSTS) * len(DAMPINGS) * n_steps)
    pair = F.floor(F.col("id") / n_steps)
    grid = ids.select(
        F.element_at(boosts, (F.floor(pair / len(DAMPINGS)) + 1).cast("int")).alias("boost"),
        F.element_at(dampings, (pair % len(DAMPINGS) + 1).cast("int")).alias("damping"),
        (F.col("id") % n_steps).cast("int").alias("step"),
    )
    setting = W.partitionBy("boost", "damping")
    above = setting.orderBy(F.desc("step")).rowsBetween(W.unboundedPreceding, 0)
    counted = (
        grid.join(full, ["boost", "damping", "step"], "left")
        .fillna(0, ["pos", "neg"])
        .select(
            "boost", "damping", F.col("step").alias("threshold"),
            F.sum("pos").over(above).alias("tp"), F.sum("neg").over(above).alias("fp"),
            F.sum("pos").over(setting).alias("_p"), F.sum("neg").over(setting).alias("_n"),
        )
        .withColumn("tn", F.col("_n") - F.col("fp"))
        .withColumn("fn", F.col("_p") - F.col("tp"))
        .drop("_p", "_n")
    )
    low, high = GRID_THRESHOLDS
    return with_metrics(counted.filter(F.col("threshold").between(low, high)))


def best_setting(grid: DataFrame, metric: str = "f1") -> DataFrame:
    """Best grid point; ties go to the smallest boost, then damping, then threshold."""
    goal = -F.col("fnr") if metric == "fnr" else F.col(metric)
    order = F.struct(goal, -F.col("boost"), -F.col("damping"), -F.col("threshold"))
    return grid.agg(F.max_by(F.struct(*grid.columns), order).alias("b")).select("b.*")


def base_rate_projection(rates: DataFrame, base_rates: Sequence[float] = tuple(lx.BASE_RATES)) -> DataFrame:
    """What one row of (recall, fpr) gives per thousand messages at other shares of phishing."""
    spread = rates.select("recall", "fpr", F.explode(F.array(*[F.lit(b) for b in base_rates])).alias("base_rate"))
    phishing, legit = 1000 * F.col("base_rate"), 1000 * (1 - F.col("base_rate"))
    counted = spread.select(
        "base_rate",
        (phishing * F.col("recall")).alias("caught"),
        (phishing - phishing * F.col("recall")).alias("missed"),
        (legit * F.col("fpr")).alias("false_alarms"),
        legit.alias("_legit"),
    )
    caught, alarms = F.col("caught"), F.col("false_alarms")
    return counted.select(
        "base_rate", "caught", "missed", "false_alarms",
        F.when(caught + alarms > 0, caught / (caught + alarms)).otherwise(0.0).alias("precision"),
        ((caught + (F.col("_legit") - alarms)) / 1000).alias("accuracy"),
    )


def mcnemar(df: DataFrame, base: Column, others: dict[str, Column]) -> DataFrame:
    """Per configuration: b01 (it wrong, base right), b10, continuity-corrected chi-square."""
    pairs = F.array(*[
        F.struct(F.lit(name).alias("configuration"), correct.alias("correct")) for name, correct in others.items()
    ])
    rows = df.select(base.alias("_base"), F.explode(pairs).alias("p")).select("_base", "p.*")
    counts = rows.groupBy("configuration").agg(
        F.count_if(~F.col("correct") & F.col("_base")).alias("b01"),
        F.count_if(F.col("correct") & ~F.col("_base")).alias("b10"),
    )
    gap, n = F.abs(F.col("b01") - F.col("b10")) - 1, F.col("b01") + F.col("b10")
    return counts.withColumn("chi2", F.when(n > 0, gap * gap / n).otherwise(0.0))


CRITICAL_CHI2 = 3.841458820694124  # fixed value: 95 % point of a chi-square with one degree of freedom


def with_p_value(tests: DataFrame) -> DataFrame:
    """p of a chi-square with one degree of freedom; ``significant`` compares the statistic itself."""

    @F.pandas_udf("double")
    def survival(x: pd.Series) -> pd.Series:
        return x.map(lambda v: math.erfc(math.sqrt(v / 2)) if v > 0 else 1.0)

    return tests.withColumn("p", survival("chi2")).withColumn("significant", F.col("chi2") > CRITICAL_CHI2)


def bootstrap_interval(df: DataFrame, correct: dict[str, Column], rounds: int = 2000, seed: int = 0) -> DataFrame:
    """95 % percentile interval of each configuration's accuracy.

    Resampling a 0/1 vector and taking its mean is one binomial draw from its two counts, so the
    rows are counted once and ``rounds`` draws are made, each seeded by its own number.
    """
    pairs = F.array(*[F.struct(F.lit(k).alias("configuration"), c.alias("ok")) for k, c in correct.items()])
    counts = df.select(F.explode(pairs).alias("p")).groupBy("p.configuration").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("p.ok").alias("k")
    )

    @F.pandas_udf("double")
    def mean_of_resample(n: pd.Series, k: pd.Series, number: pd.Series) -> pd.Series:
        return pd.Series([
            np.random.default_rng([seed, int(i), int(b), int(a)]).binomial(int(a), b / a) / a if a else 0.0
            for a, b, i in zip(n, k, number)
        ])

    drawn = counts.withColumn("_round", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1)))).withColumn(
        "_mean", mean_of_resample("n", "k", "_round")
    )
    order = W.partitionBy("configuration").orderBy("_mean", "_round")
    ranked = drawn.withColumn("_at", F.row_number().over(order) - 1)
    low, high = int(0.025 * rounds), int(0.975 * rounds) - 1
    return ranked.groupBy("configuration").agg(
        F.first("n").alias("n_rows"),
        F.first(F.col("k") / F.col("n")).alias("accuracy"),
        F.max(F.when(F.col("_at") == low, F.col("_mean"))).alias("ci_low"),
        F.max(F.when(F.col("_at") == high, F.col("_mean"))).alias("ci_high"),
    )


def exact_auc(df: DataFrame, score: str, label: str = "label", per_unit: int = 1000) -> DataFrame:
    """Area under the ROC curve with ties counted half, over the scores as they are.

    Equal scores are folded first. Scores are ordered within steps of 1/``per_unit``, which spread over the tasks;
    only the counts of the steps are summed across them. Null scores are left out.
    """
    values = df.filter(F.col(score).isNotNull()).groupBy(F.col(score).cast("double").alias("s")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg")
    ).withColumn("step", F.floor(F.col("s") * per_unit))
    steps = values.groupBy("step").agg(F.sum("neg").alias("_n"))
    before = _all().orderBy("step").rowsBetween(W.unboundedPreceding, -1)
    lower = steps.select(F.col("step").alias("_step"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_lower"))
    within = W.partitionBy("step").orderBy("s").rowsBetween(W.unboundedPreceding, -1)
    placed = values.withColumn("_near", F.coalesce(F.sum("neg").over(within), F.lit(0))).join(
        lower, F.col("step") == F.col("_step")
    )
    twice = F.col("pos") * (2 * (F.col("_lower") + F.col("_near")) + F.col("neg"))
    summed = placed.select("pos", "neg", twice.alias("t")).agg(
        F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"), F.sum("t").alias("_t")
    )
    area = F.col("_t") / (F.lit(2.0) * F.col("n_pos") * F.col("n_neg"))
    return summed.select("n_pos", "n_neg", F.when(F.col("n_pos") * F.col("n_neg") > 0, area).alias("auc"))


def target_gate(metrics: DataFrame, f1: float = 0.88, fnr: float = 0.05, auc: float = 0.92) -> DataFrame:
    return metrics.select(
        "*", (F.col("f1") >= f1).alias("f1_met"), (F.col("fnr") < fnr).alias("fnr_met"),
        (F.col("auc") >= auc).alias("auc_met"),
    )


VARIANT_COLUMNS = {
    "rules only": "v_rules", "model only": "v_model", "ensemble": "v_ensemble",
    "with promo damping": "v_promo", "no damping": "v_undamped", "legacy average": "v_legacy",
}


def variant_table(df: DataFrame, cfg: ScoringConfig = DEFAULT) -> DataFrame:
    """Metrics of every compared configuration in one aggregation."""
    pairs = F.array(*[
        F.struct(
            F.lit(name).alias("variant"),
            (F.col(c) >= (cfg.model_cutoff if name == "model only" else cfg.threshold)).alias("flagged"),
        )
        for name, c in VARIANT_COLUMNS.items()
    ])
    rows = df.select("label", F.explode(pairs).alias("p")).select("label", "p.*")
    return with_metrics(rows.groupBy("variant").agg(*confusion(F.col("label"), F.col("flagged"))))


def who_decided(df: DataFrame, cfg: ScoringConfig = DEFAULT) -> DataFrame:
    """Verdicts the rules changed against the model alone, and the net effect."""
    phishing = F.col("label") == 1
    model, final = F.col("v_model") >= cfg.model_cutoff, F.col("v_ensemble") >= cfg.threshold
    counted = df.agg(
        F.count_if(phishing & ~model & final).alias("rescued"),
        F.count_if(phishing & model & ~final).alias("lost"),
        F.count_if(~phishing & ~model & final).alias("caused"),
        F.count_if(~phishing & model & ~final).alias("prevented"),
    )
    net = F.col("rescued") + F.col("prevented") - F.col("lost") - F.col("caused")
    return counted.withColumn("net", net)


def damping_report(df: DataFrame, cfg: ScoringConfig = DEFAULT) -> DataFrame:
    """How often each damping fires, on how much phishing, and how many catches it cost."""
    lost = (
        (F.col("label") == 1) & (F.col("v_model") >= cfg.model_cutoff) & (F.col("v_ensemble") < cfg.threshold)
    )
    return df.groupBy(F.col("promo_reason").alias("reason")).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col("label") == 1).alias("n_phishing"),
        F.count_if(lost).alias("n_lost"),
        F.count_if(F.col("reason") != "none").alias("n_fired_now"),
    )


def shown_text(df: DataFrame) -> DataFrame:
    """Sender, subject and content shortened to what an error listing shows."""
    return df.withColumns({
        "sender": F.substring(tx.text_or_empty(F.col("sender")), 1, 40),
        "subject": tx.snippet(F.col("subject"), 50),
        "content": tx.snippet(F.col("content"), 90),
    })


def errors(df: DataFrame, cfg: ScoringConfig = DEFAULT) -> DataFrame:
    """Every wrong verdict with kind, language, sender presence and what drove the score.

    Needs the texts of ``shown_text``, source, language, label, v_ensemble, v_model, v_rules. The
    facts are written once, as a filter on them must not send the scoring over the texts again; texts are written for wrong verdicts only.
    """
    wrong = (F.col("v_ensemble") >= cfg.threshold) != (F.col("label") == 1)
    has_sender = tx.strip_space(F.col("sender")) != ""
    one = tx.round_half_even_exact
    facts = df.select(
        "msg_id",
        F.when(wrong, F.when(F.col("label") == 0, "fp").otherwise("fn")).alias("kind"),
        one(F.col("v_ensemble"), 1).alias("score"),
        one(F.col("v_model"), 1).alias("model"),
        one(F.col("v_rules"), 1).alias("rules"),
        F.coalesce(F.nullif(F.col("source"), F.lit("")), F.lit("unknown")).alias("source"),
        "language",
        F.when(has_sender, "yes").otherwise("no").alias("has_sender"),
        F.when(F.col("v_rules") >= F.col("v_ensemble") - 0.01, "rules")
        .when(F.col("v_model") >= cfg.threshold, "model")
        .otherwise("both")
        .alias("driver"),
        *[F.when(wrong, F.col(c)).alias(c) for c in ("sender", "subject", "content")],
    )
    return materialise(facts, "errors").filter("kind IS NOT NULL")


def error_shares(found: DataFrame) -> DataFrame:
    """Errors of each kind by source, language, sender presence and driver, with shares."""
    dims = ["source", "language", "has_sender", "driver"]
    facts = F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).alias("value")) for d in dims])
    counted = (
        found.select("kind", F.explode(facts).alias("d"))
        .groupBy("kind", "d.dimension", "d.value")
        .agg(F.count(F.lit(1)).alias("n_errors"))
    )
    total = F.sum("n_errors").over(W.partitionBy("kind", "dimension"))
    return counted.withColumn("share", F.col("n_errors") / total)


def worst_errors(found: DataFrame, n: int = 15) -> DataFrame:
    """The ``n`` highest-scored errors of each kind; each task keeps ``n`` before the shuffle."""
    order = W.partitionBy("kind").orderBy(F.desc("score"), "msg_id")
    return found.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= n)


def sanity_margin(df: DataFrame, score: str, cfg: ScoringConfig = DEFAULT) -> DataFrame:
    """Can one threshold separate the classes? Highest legitimate against lowest phishing score."""
    s = F.col(score)
    ends = df.agg(
        F.max(F.when(F.col("label") == 0, s)).alias("legit_max"),
        F.min(F.when(F.col("label") == 1, s)).alias("phish_min"),
    )
    low, high = (F.floor("legit_max") + 1).cast("int"), F.floor("phish_min").cast("int")
    return ends.select(
        "legit_max", "phish_min", (F.col("legit_max") >= F.col("phish_min")).alias("overlap"),
        low.alias("safe_low"), high.alias("safe_high"), F.floor((low + high) / 2).cast("int").alias("middle"),
        ((low <= cfg.threshold) & (high >= cfg.threshold)).alias("configured_inside"),
    )
