"""Scoring parameters and the risk bands derived from them."""

from __future__ import annotations

from dataclasses import dataclass


def bands_for(threshold: int) -> tuple[int, int, int]:
    """Lower edges of the caution, suspicious and high bands for a threshold (half-even rounding)."""
    return round(threshold * 0.6), threshold, round(threshold + (100 - threshold) * 0.45)


@dataclass(frozen=True)
class ScoringConfig:
    """Everything a verdict depends on; one instance is handed to every scoring operator."""

    # They must equal the published scoring model.
    threshold: int = 70
    rule_boost: float = 0.5
    trust_damping: float = 0.25
    transactional_damping: float = 0.10
    promotional_damping: float = 0.30
    corroboration_floor: int = 15
    strong_points: int = 15
    strong_cap: int = 40
    weak_points: int = 4
    weak_cap: int = 16
    lookalike_points: int = 25
    many_links_points: int = 20
    many_links_over: int = 2
    urgency_points: int = 15
    odd_suffix_points: int = 20
    impersonation_subject_points: int = 45
    impersonation_body_points: int = 30
    ip_link_points: int = 25
    shortener_points: int = 15
    official_on_free_points: int = 30
    legacy_model_weight: float = 0.4
    legacy_rule_weight: float = 0.6
    model_cutoff: int = 50
    recent_window: int = 10
    alert_history: int = 5
    dashboard_alerts: int = 10
    trust_refusal_score: int = 30
    trust_list_cap: int = 500
    trust_evidence_window: int = 50
    push_score: int = 80
    subject_chars: int = 200
    content_chars: int = 500
    clean_chars: int = 1000

    @property
    def bands(self) -> tuple[int, int, int]:
        return bands_for(self.threshold)

    @property
    def ceiling(self) -> int:
        """Highest score the model alone may reach when the rules found next to nothing."""
        return self.bands[2] - 1

    @property
    def version(self) -> str:
        """Stamp stored with each verdict; changes whenever a parameter of the formula does."""
        return (
            f"v6|b{self.rule_boost}|t{self.trust_damping}"
            f"|x{self.transactional_damping}|th{self.threshold}"
        )

    @property
    def rules_only_version(self) -> str:
        return f"{self.version}|rules"


DEFAULT = ScoringConfig()
