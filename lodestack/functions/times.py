"""Times as the store keeps them (ISO text), ages, freshness and periods."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def moment(text: Column) -> Column:
    """ISO text as a timestamp (UTC where no zone is said); NULL for anything else."""
    iso = text.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?(Z|[+-]\d{2}:\d{2})?)?$")
    return F.when(iso, F.try_to_timestamp(text))


def age_days(seen: Column, now: Column) -> Column:
    """Days since, with fractions; 0 when the time is missing or malformed, never negative."""
    return F.greatest(F.lit(0.0), F.coalesce((F.unix_micros(now) - F.unix_micros(seen)) / 86_400_000_000, F.lit(0.0)))


def freshness(age: Column, horizon: int = 730, archived: Column | None = None) -> Column:
    """1 falling to 0 at the horizon; 0 where archived."""
    score = F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - age / horizon)), 3)
    return score if archived is None else F.when(archived, 0.0).otherwise(score)


def freshness_state(age: Column, aging: int = 180, stale: int = 365, archived: Column | None = None) -> Column:
    """ARCHIVED where a reviewer said so, whatever the age; NULL there says nothing."""
    kept = F.coalesce(archived, F.lit(False)) if archived is not None else F.lit(False)
    return F.when(kept, "ARCHIVED").when(age >= stale, "STALE").when(age >= aging, "AGING").otherwise("FRESH")


def period(t: Column, interval: str) -> Column:
    """A label of the day, ISO month, or week of the year counted from its first Monday (W00 before it)."""
    if interval == "week":
        week = F.floor((F.dayofyear(t) + 6 - F.weekday(t)) / 7)
        return F.concat(F.date_format(t, "yyyy"), F.lit("-W"), F.lpad(week.cast("string"), 2, "0"))
    return F.date_format(t, {"day": "yyyy-MM-dd", "month": "yyyy-MM"}[interval])
