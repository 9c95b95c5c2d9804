"""Risk scoring of events that matched rules, indicators or models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillwatch.functions.scalars import CRITICALITY_TENTHS, RULE_SCORE, c, severity_from_score, true_only, word_map

# Additions, model thresholds and the candidate threshold.
IOC_BONUS, ANOMALY_BONUS, UEBA_BONUS = 20, 15, 10
ANOMALY_FLOOR, UEBA_FLOOR, EXFIL_FLOOR, BEACON_FLOOR = 0.75, 0.80, 0.85, 0.7
CANDIDATE_FLOOR = 40


def rule_score(severity) -> Column:
    return word_map(severity, RULE_SCORE, 0)


def base_score(matches="rule_matches") -> Column:
    """Highest score over the matches, 0 without any."""
    return F.coalesce(F.array_max(F.transform(c(matches), lambda m: rule_score(m["severity"]))), F.lit(0))


def risk(base: Column, ioc_hit, anomaly, ueba, criticality, ioc_floor: int | None = None) -> Column:
    """Capped sum times the asset factor, in whole tenths so no rounding can creep in."""
    cap = lambda x: F.least(F.lit(100), x)
    add = lambda x, cond, n: cap(x + F.when(true_only(cond), n).otherwise(0))
    x = cap(base)
    x = add(x, c(ioc_hit), IOC_BONUS)
    x = add(x, c(anomaly) > ANOMALY_FLOOR, ANOMALY_BONUS)
    x = add(x, c(ueba) > UEBA_FLOOR, UEBA_BONUS)
    scaled = cap(F.floor(x * word_map(criticality, CRITICALITY_TENTHS, CRITICALITY_TENTHS["unknown"]) / 10).cast("int"))
    return scaled if ioc_floor is None else F.when(true_only(c(ioc_hit)), F.greatest(scaled, F.lit(ioc_floor))).otherwise(scaled)


def score_events(df: DataFrame, ioc_floor: int | None = None) -> DataFrame:
    """Needs rule_matches, ioc_hit, anomaly_score, ueba_score, asset_criticality."""
    return df.withColumn("risk_score", risk(base_score(), "ioc_hit", "anomaly_score", "ueba_score", "asset_criticality", ioc_floor)
                         ).withColumn("risk_severity", severity_from_score("risk_score"))


def candidates(scored: DataFrame, floor: int = CANDIDATE_FLOOR) -> DataFrame:
    return scored.filter(c("risk_score") >= floor)
