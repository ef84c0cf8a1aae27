"""Numeric helpers and classifiers as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_up(x: Column, digits: int = 0) -> Column:
    """Half away from zero by one explicit formula, the same in every SQL engine."""
    scale = F.lit(10.0**digits)
    return F.signum(x) * F.floor(F.abs(x) * scale + 0.5) / scale


def ratio(a: Column, b: Column, otherwise: float | None = None) -> Column:
    """a / b as double; ``otherwise`` where b is 0."""
    return F.when(b != 0, a.cast("double") / b).otherwise(F.lit(otherwise).cast("double"))


def percent(part: Column, whole: Column, digits: int = 1, otherwise: float | None = 0.0) -> Column:
    return F.when(whole != 0, round_half_up(part.cast("double") * 100 / whole, digits)).otherwise(F.lit(otherwise).cast("double"))


def change(now: Column, before: Column, digits: int = 1) -> Column:
    """Percent change; 0 of nothing is 0, something of nothing 100."""
    return F.when(before != 0, round_half_up((now - before).cast("double") * 100 / before, digits)).when(now == 0, 0.0).otherwise(100.0)


def seconds(a: Column, b: Column) -> Column:
    """From a to b, with microseconds."""
    return F.timestamp_diff("MICROSECOND", a, b) / 1e6


def ladder(x: Column, steps: list[tuple[float, str]], otherwise: str, strict: bool = False) -> Column:
    """The first name whose bound x reaches (or exceeds, if strict); steps from the highest."""
    out = None
    for bound, name in steps:
        test = x > bound if strict else x >= bound
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise(otherwise)


def spike_severity(multiplier: Column) -> Column:
    return ladder(multiplier, [(10, "critical"), (5, "high"), (2, "elevated")], "normal")


def correlation_strength(r: Column) -> Column:
    return ladder(F.abs(r), [(0.8, "strong"), (0.5, "moderate")], "weak")


def burst_intensity(n: Column) -> Column:
    return ladder(n, [(20, "high"), (10, "medium")], "low")


def trend_direction(pct: Column) -> Column:
    """Beyond 20 either way significantly, beyond 5 somewhat."""
    return F.when(pct > 20, "increasing_significantly").when(pct > 5, "increasing").when(pct < -20, "decreasing_significantly").when(pct < -5, "decreasing").otherwise("stable")


def pearson(n: Column, sx: Column, sy: Column, sxx: Column, syy: Column, sxy: Column) -> Column:
    """Correlation from sums, to three digits; 0 where it isn't defined or a series is all zero."""
    spread = (n * sxx - sx * sx) * (n * syy - sy * sy)
    usable = (n > 0) & (sx != 0) & (sy != 0) & (spread > 0)
    return F.when(usable, round_half_up((n * sxy - sx * sy) / F.sqrt(F.when(spread > 0, spread).otherwise(1.0)), 3)).otherwise(0.0)


def anomaly_level(x: Column, mean: Column, sd: Column, sensitivity: int = 2) -> Column:
    """How far above the mean, in deviations; no deviation at all makes any excess critical."""
    z = F.when(sd == 0, F.lit(float("inf"))).otherwise((x - mean) / F.when(sd == 0, 1.0).otherwise(sd))
    return F.when(x <= mean, F.lit(None).cast("string")).when(z < sensitivity, F.lit(None).cast("string")).when(z <= sensitivity + 1, "elevated").when(z <= sensitivity + 2, "high").otherwise("critical")


def deviations_above(x: Column, mean: Column, sd: Column) -> Column:
    return F.when(sd != 0, (x - mean) / F.when(sd == 0, 1.0).otherwise(sd))


def priority_score(severity: Column, occurrences: Column, hours_ago: Column, users: Column) -> Column:
    """Weighted severity, frequency, recency and reach, 0 to 100."""
    sev = F.when(severity == "critical", 100).when(severity == "high", 75).when(severity == "medium", 50).otherwise(25)
    log = lambda n: round_half_up(F.least(F.greatest(10 + 30 * F.log10(F.greatest(n, F.lit(1)).cast("double")), F.lit(0.0)), F.lit(100.0)), 0)
    freq = F.when(occurrences <= 1, 10.0).when(occurrences >= 1000, 100.0).otherwise(log(occurrences))
    recent = F.when(hours_ago < 1, 100).when(hours_ago < 24, 80).when(hours_ago < 168, 50).when(hours_ago < 720, 20).otherwise(10)
    reach = F.when(F.coalesce(users, F.lit(0)) == 0, 0.0).otherwise(log(F.coalesce(users, F.lit(0)) + 1))
    return round_half_up(0.4 * sev + 0.25 * freq + 0.2 * recent + 0.15 * reach, 0).cast("int")
