"""Severity levels from anomaly scores, and what follows from a severity."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, functions as F


@dataclass(frozen=True)
class Thresholds:
    """Scores at or below ``high`` are high, at or below ``medium`` are medium."""

    high: float = -0.10
    medium: float = -0.05

    @classmethod
    def parse(cls, text: str, strict: bool = False) -> "Thresholds":
        """Read "high, medium". Unreadable text gives the defaults, or raises if strict."""
        parts = [p.strip() for p in (text or "").split(",") if p.strip()]
        try:
            high, medium = float(parts[0]), float(parts[1])
        except (IndexError, ValueError):
            if strict:
                raise ValueError("thresholds must be two floats such as '-0.10, -0.05'") from None
            return cls()
        if strict and not high <= medium:
            raise ValueError("thresholds must be 'high, medium' with high <= medium")
        return cls(high, medium)


def severity_of(score: Column, thresholds: Thresholds = Thresholds()) -> Column:
    # The missing check comes first: Spark orders NaN above every number.
    return (
        F.when(score.isNull() | F.isnan(score), "unknown")
        .when(score <= thresholds.high, "high")
        .when(score <= thresholds.medium, "medium")
        .otherwise("low")
    )


def log_level(severity: Column) -> Column:
    s = F.lower(F.coalesce(severity, F.lit("")))
    return F.when(s == "high", "ERROR").when(s == "medium", "WARNING").otherwise("INFO")
