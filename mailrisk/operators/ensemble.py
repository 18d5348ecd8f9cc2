"""Combining the model's score with the rules into one explained verdict.

All variants the ablation compares are sibling columns of one frame; nothing is joined back.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailrisk import lexicon as lx
from mailrisk.config import DEFAULT, ScoringConfig
from mailrisk.functions import verdicts as vd
from mailrisk.functions.text import model_input, round_half_even_exact, text_or_empty
from mailrisk.operators import mail_rules as mr


def damping(cfg: ScoringConfig = DEFAULT, user_trusted: Column | None = None) -> Column:
    """Multiplier of the model score: first reason that applies, they do not stack."""
    has_sender = text_or_empty(F.col("sender")) != ""
    ladder = F.when(F.lit(False) if user_trusted is None else user_trusted, cfg.trust_damping)
    return (
        ladder.when(has_sender & F.col("transactional"), cfg.transactional_damping)
        .when(
            has_sender & F.col("trusted_sender") & ~F.col("asks_credentials"), cfg.trust_damping
        )
        .otherwise(1.0)
    )


def damping_reason(promotional: bool = False) -> Column:
    """Why the model was damped; ``promotional`` adds the variant that was withdrawn."""
    has_sender = text_or_empty(F.col("sender")) != ""
    ladder = F.when(has_sender & F.col("transactional"), "transactional").when(
        has_sender & F.col("trusted_sender") & ~F.col("asks_credentials"), "known sender"
    )
    if promotional:
        ladder = ladder.when(F.col("promotional"), "promotional")
    return ladder.otherwise("none")


def combine(
    model: Column,
    rules: Column,
    multiplier: Column,
    cfg: ScoringConfig = DEFAULT,
    ceiling: int | None = -1,
) -> Column:
    """``least(greatest(model*d + boost*rules, rules), 100)``, held back when rules found little.

    ``ceiling=-1`` takes the configured one, ``None`` returns the uncapped score.
    """
    score = F.least(
        F.greatest(model * multiplier + cfg.rule_boost * rules, rules.cast("double")), F.lit(100.0)
    )
    if ceiling is None:
        return score
    cap = float(cfg.ceiling if ceiling == -1 else ceiling)
    return F.when(rules < cfg.corroboration_floor, F.least(score, F.lit(cap))).otherwise(score)


def with_model_score(df: DataFrame, scorer, cfg: ScoringConfig = DEFAULT) -> DataFrame:
    """Attach ``model_score`` (0..100, two decimals) from any text scorer.

    ``scorer`` is a column expression, or a factory returning a batch scorer
    ``list[str] -> list[float in 0..1]``; the factory runs once per Python worker.
    """
    if isinstance(scorer, Column):
        return df.withColumn("model_score", round_half_even_exact(scorer.cast("double"), 2))

    @F.pandas_udf("double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        score = scorer()
        for texts in batches:
            yield pd.Series([round(100.0 * float(p), 2) for p in score(texts.tolist())], dtype="float64")

    return df.withColumn(
        "model_score", predict(model_input(F.col("sender"), F.col("subject"), F.col("content")))
    )


def score_ensemble(df: DataFrame, cfg: ScoringConfig = DEFAULT) -> DataFrame:
    """Full verdict. Needs ``model_score`` (null: no model); ``user_trusted`` is optional.

    Without a model the rule result stands untouched, not even capped.
    """
    trusted = F.coalesce(F.col("user_trusted"), F.lit(False)) if "user_trusted" in df.columns else None
    scored = mr.with_legitimacy(mr.score_prepared(mr.prepare(df), cfg))
    scored = mr.drop_prepared(scored)
    rules, model = F.col("rule_score"), F.col("model_score")
    raw = scored.select("*", damping(cfg, trusted).alias("damping")).select(
        "*",
        F.when(model.isNull(), rules.cast("double"))
        .otherwise(combine(model, rules, F.col("damping"), cfg))
        .alias("final_score"),
    )
    convinced = model >= cfg.model_cutoff
    real = F.filter("rule_indicators", lambda i: i != F.lit(lx.NOTHING_FOUND))
    model_line = F.format_string(lx.REASON_MODEL, F.bround(model, 0).cast("int").cast("string"))
    uncorroborated = F.when(
        rules < cfg.corroboration_floor, F.array(F.lit(lx.NO_TECHNICAL_SIGNS))
    ).otherwise(F.array().cast("array<string>"))
    indicators = F.when(
        convinced, F.concat(real, F.array(model_line), uncorroborated)
    ).otherwise(F.col("rule_indicators"))
    verdict = raw.select(
        "*",
        F.when(model.isNull(), F.col("final_score"))
        .otherwise(round_half_even_exact(F.col("final_score"), 2))
        .alias("risk_score"),
        indicators.alias("indicators"),
        F.when(model.isNull(), cfg.rules_only_version).otherwise(cfg.version).alias("scoring_version"),
    )
    return verdict.select(
        "*",
        vd.is_phishing(F.col("risk_score"), cfg).alias("is_phishing"),
        vd.risk_level(F.col("risk_score"), cfg).alias("risk_level"),
        vd.recommendation(F.col("risk_score"), F.col("indicators"), cfg).alias("recommendation"),
    )


VARIANTS = ["rules only", "model only", "ensemble", "with promo damping", "no damping",
            "legacy average"]


def with_variants(df: DataFrame, cfg: ScoringConfig = DEFAULT) -> DataFrame:
    """Scores of every compared configuration as columns ``v_*`` beside ``reason``/``promo_reason``."""
    model, rules = F.col("model_score"), F.col("rule_score")
    reasons = df.select(
        "*",
        damping_reason().alias("reason"),
        damping_reason(promotional=True).alias("promo_reason"),
        damping(cfg).alias("_d"),
    )
    with_promo = F.when(F.col("promo_reason") == "promotional", cfg.promotional_damping).otherwise(
        F.col("_d")
    )
    return reasons.select(
        "*",
        rules.cast("double").alias("v_rules"),
        model.alias("v_model"),
        combine(model, rules, F.col("_d"), cfg).alias("v_ensemble"),
        combine(model, rules, F.col("_d"), cfg, ceiling=None).alias("v_uncapped"),
        combine(model, rules, with_promo, cfg).alias("v_promo"),
        combine(model, rules, F.lit(1.0), cfg).alias("v_undamped"),
        (cfg.legacy_model_weight * model + cfg.legacy_rule_weight * rules).alias("v_legacy"),
    ).drop("_d")


def mirrored_score(cfg: ScoringConfig = DEFAULT) -> Column:
    """The verdict formula written out a second time, from its definition, without ``combine`` or ``damping``."""
    d = (
        f"CASE WHEN coalesce(sender, '') = '' THEN 1D WHEN transactional THEN {cfg.transactional_damping}D "
        f"WHEN trusted_sender AND NOT asks_credentials THEN {cfg.trust_damping}D ELSE 1D END"
    )
    whole = f"least(100D, greatest(CAST(rule_score AS DOUBLE), model_score * ({d}) + {cfg.rule_boost}D * rule_score))"
    held = f"CASE WHEN rule_score >= {cfg.corroboration_floor} THEN {whole} ELSE least({whole}, {cfg.ceiling}D) END"
    return F.expr(f"CASE WHEN model_score IS NULL THEN CAST(rule_score AS DOUBLE) ELSE {held} END")


def formula_drift(df: DataFrame, cfg: ScoringConfig = DEFAULT, tolerance: float = 1e-9) -> DataFrame:
    """Verdicts on which the mirrored formula differs from the shipped score; must be none."""
    gap = F.abs(mirrored_score(cfg) - F.col("final_score"))
    return df.agg(F.count_if(gap > tolerance).alias("drifted"), F.count(F.lit(1)).alias("n_rows"))
