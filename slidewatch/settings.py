"""Business rules of the growth model, as parameters.

Fixed values: the defaults below are the published rule values and must stay equal for equal results.
"""

from __future__ import annotations

from dataclasses import dataclass

REVENUE_PER_CONVERSION = 8.0
MONTHS_PER_YEAR = 12.0


@dataclass(frozen=True)
class BandRule:
    sliding_drop: float = 0.01
    sliding_rate: float = 0.032
    watch_drop: float = 0.005


@dataclass(frozen=True)
class ActionRule:
    proven_share: float = 0.7
    proven_floor: float = 0.003
    rollout_lift: float = 0.006
    alt_lift: float = 0.004
    ship_cost: float = 5000.0
    rollout_cost: float = 500.0


@dataclass(frozen=True)
class TokenPrices:
    """US dollars per million tokens, as text so that they stay exact decimals."""

    input_per_million: str = "0.15"
    output_per_million: str = "0.60"


ALERT_USD = 0.03
HARD_STOP_USD = 0.05

# Actions in tie-break order.
ACTIONS = ["ship_proven_variant", "rollout_existing_flag", "ship_alt_variant"]

# Bands.
BANDS = ["sliding", "watch", "healthy"]
OPEN_BANDS = ["sliding", "watch"]

# Feature areas and platforms.
FEATURE_AREAS = ["checkout", "onboarding", "discovery", "pricing"]
PLATFORMS = ["ios", "android", "web"]

# Decision life cycle.
DECISION_STATUSES = ["investigating", "investigation_failed", "proposed", "approved", "committed"]

# Analyst note phrases with their label.
NOTE_LABELS = {
    "conversion dropping since the checkout change": "sliding",
    "android funnel regressed, ios fine": "sliding",
    "drop-off at payment step for this segment": "sliding",
    "needs a rollback or a proven variant": "sliding",
    "losing this cohort week over week": "sliding",
    "converting to plan": "healthy",
    "funnel healthy, no regressions": "healthy",
}
# Note label scores.
LABEL_SCORES = {"sliding": 1.0, "at_risk": 0.6, "healthy": 0.1}


def unbounded_read_phrases(store: str = "warehouse") -> list[str]:
    """Request phrases that ask for an unbounded read of the named store."""
    return [
        f"all {store} data",
        "unlimited read",
        "unlimited quer",
        "full database scan",
        "read every table",
    ]


def unbounded_read_reason(store: str = "warehouse") -> str:
    return f"Unbounded {store} reads are not permitted. Request a bounded table, key, filter, and limit."
