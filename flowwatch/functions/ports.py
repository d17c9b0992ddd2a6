"""Port sets as columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed values.
SENSITIVE_PORTS = [22, 23, 2323, 3389, 5900]
WATCHED_PORTS = [22, 23, 53, 80, 110, 139, 143, 443, 445, 3306, 3389, 5900]
HIGH_RISK_PORTS = [23, 445, 3389, 5900, 21]
EPHEMERAL_FROM = 49152
MAX_PORTS = 64


def port_risk(ports: Column) -> Column:
    """High if any risky port is open, Medium if any port is, Low if none or unknown."""
    risky = F.array(*[F.lit(p) for p in HIGH_RISK_PORTS])
    return (
        F.when(F.arrays_overlap(ports, risky), "High")
        .when(F.size(ports) > 0, "Medium")
        .otherwise("Low")
    )


def ports_to_csv(ports: Column) -> Column:
    return F.coalesce(F.array_join(ports, ","), F.lit(""))


def csv_to_ports(text: Column, limit: int | None = None) -> Column:
    """The ports of a comma list, the first ``limit`` if given; entries that are not integers are dropped."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda p: F.trim(p).try_cast("int"))
    kept = F.filter(parts, lambda p: p.isNotNull())
    return kept if limit is None else F.slice(kept, 1, limit)


def is_ephemeral(sport: Column) -> Column:
    return (sport.cast("int") >= EPHEMERAL_FROM).cast("double")
