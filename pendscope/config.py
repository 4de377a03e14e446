"""Parameters of the analysis."""

from __future__ import annotations

from datetime import date

# ---- fixed values: they decide the results and must stay as they are --------
AS_OF_LAG_DAYS = 2
MIN_WINDOW_DAYS = 63
SLA_DAYS = 30
MIN_CONFIDENCE = 0.55
LABELLED_SAMPLE = 1200
RECENT_DAYS = 21
BASELINE_DAYS = 42
EMERGING_MIN_LIFT = 1.4
EMERGING_MIN_Z = 3.0
MIN_ROWS_TO_SPLIT = 60
CLUSTER_COUNTS = (2, 3, 4, 5)
SIMPLER_SPLIT_TOLERANCE = 0.03
KEY_PHRASES = 4
MOST_INTERVENTIONS = 12
GENERIC_PEND_CODE = "PND-000"
NEEDS_REVIEW = "needs_review"
STAGE_ORDER = ("intake", "pre_adjudication", "adjudication", "post_adjudication")
SEGMENT_DIMENSIONS = ("platform", "lob", "specialty", "channel", "network_status", "claim_type")
RANK_METRICS = ("pend_days", "claims", "avg_pend_days")
# ---- end of fixed values -----------------------------------------------------

DIMENSION_LABELS = {
    "platform": "platform",
    "lob": "line of business",
    "specialty": "specialty",
    "channel": "channel",
    "network_status": "network status",
    "claim_type": "claim type",
}


def check_window(start: date, end: date) -> int:
    """Days in an inclusive window; ValueError when too short to analyse."""
    days = (end - start).days + 1
    if days < MIN_WINDOW_DAYS:
        raise ValueError(f"a window needs at least {MIN_WINDOW_DAYS} days, {start} to {end} has {days}")
    return days
