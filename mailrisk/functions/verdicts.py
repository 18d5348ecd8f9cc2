"""Column functions that turn a score into band, advice and flag."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mailrisk import lexicon as lx
from mailrisk.config import DEFAULT, ScoringConfig


def bands_column(threshold: Column) -> Column:
    """Column twin of :func:`mailrisk.config.bands_for`, rounding half to even."""
    return F.struct(
        F.bround(threshold * 0.6).cast("int").alias("low"),
        threshold.cast("int").alias("medium"),
        F.bround(threshold + (100 - threshold) * 0.45).cast("int").alias("high"),
    )


def risk_level(score: Column, cfg: ScoringConfig = DEFAULT) -> Column:
    low, medium, high = cfg.bands
    return (
        F.when(score >= high, lx.LEVEL_HIGH)
        .when(score >= medium, lx.LEVEL_MEDIUM)
        .when(score >= low, lx.LEVEL_LOW)
        .otherwise(lx.LEVEL_SAFE)
    )


def found_signs(indicators: Column) -> Column:
    """Is there a reason that is more than a line saying nothing was found?"""

    def real(line: Column) -> Column:
        denial = F.lit(False)
        for prefix in lx.DENIAL_PREFIXES:
            denial = denial | F.startswith(line, F.lit(prefix))
        return (F.length(line) > 0) & ~denial

    return F.exists(indicators, real)


def recommendation(score: Column, indicators: Column, cfg: ScoringConfig = DEFAULT) -> Column:
    low, medium, high = cfg.bands
    return (
        F.when(score >= high, lx.ADVICE_HIGH)
        .when(score >= medium, lx.ADVICE_MEDIUM)
        .when(score >= low, lx.ADVICE_LOW)
        .when(found_signs(indicators), lx.ADVICE_WEAK_SIGNS)
        .otherwise(lx.ADVICE_SAFE)
    )


def is_phishing(score: Column, cfg: ScoringConfig = DEFAULT) -> Column:
    return score >= cfg.threshold


def is_reusable(version: Column, model_ready: bool, cfg: ScoringConfig = DEFAULT) -> Column:
    """A full verdict may always be reused; a rules-only one only while there is no model."""
    accepted = [cfg.version] if model_ready else [cfg.version, cfg.rules_only_version]
    return F.coalesce(version.isin(*accepted), F.lit(False))


def indicators_to_json(indicators: Column) -> Column:
    return F.to_json(indicators)


def indicators_from_json(stored: Column) -> Column:
    """Reasons read back; an unreadable or empty value gives an empty list."""
    parsed = F.from_json(stored, "array<string>", {"mode": "PERMISSIVE"})
    return F.coalesce(parsed, F.array().cast("array<string>"))
