"""Constants and the unit guard that all engines share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
TRADING_DAYS = 252
DAYS_PER_YEAR = 365.25
DEFAULT_RF_PCT = 6.0
ROLLING_WINDOW_DAYS = 365
ROLLING_GAP_SLACK_DAYS = 10
MIN_POINTS_FOR_STATS = 30
MIN_CAGR_WINDOW_DAYS = 90
MIN_RISK_WINDOW_DAYS = 365
ARTIFACT_RETURN = 0.20


# Plausible bands of metrics in stored units (fractions, years).
BANDS = {"ter": (0.0, 0.05), "ytm": (0.0, 0.35), "duration": (0.0, 60.0), "avg_maturity": (0.0, 60.0)}


def normalize_metric(value: Column, kind: str) -> Column:
    """A value above the band of its kind that a hundredth brings inside is a percentage that leaked in, and is scaled once.

    Other values pass as they are, whether plausible or not, as do all of kinds
    without a band; what is no number is null.
    """
    v = value.try_cast("double")
    v = F.when(~F.isnan(v), v)
    if kind not in BANDS:
        return v
    low, high = BANDS[kind]
    return F.when((v > high) & (v / 100).between(low, high), v / 100).otherwise(v)
