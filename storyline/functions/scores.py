"""Scores, in double arithmetic and fixed order of addition."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Weight of a source that is not listed.
DEFAULT_WEIGHT = 0.1


def _d(value: float) -> Column:
    return F.lit(float(value))


def article_score(weight: Column, points: Column, density: Column, release: Column) -> Column:
    return weight + F.least(points / _d(500), _d(3)) + density * _d(0.2) + F.when(release, _d(0.2)).otherwise(_d(0))


def story_score(best: Column, sources: Column, recent: Column) -> Column:
    return best + F.ln(F.greatest(sources, F.lit(1)).cast("double")) * _d(0.3) + F.when(recent, _d(0.2)).otherwise(_d(0))


def signal_score(weight: Column, points: Column, density: Column, release: Column, hours: Column) -> Column:
    """The older article score: points count for 0.3 at most and age counts against."""
    return (
        weight_of(weight) + F.least(F.coalesce(points, F.lit(0)) / _d(500), _d(0.3)) + F.coalesce(density, _d(0)) * _d(0.2)
        + F.when(release, _d(0.2)).otherwise(_d(0)) - F.coalesce(hours, _d(0)) * _d(0.005)
    )


def effective_score(score: Column, hours: Column) -> Column:
    return score - hours * _d(0.005)


def topic_score(rank: Column, share: Column, hotness: Column) -> Column:
    return rank * _d(0.6) + share * _d(0.3) + hotness * _d(0.1)


def hotness(average_hours: Column) -> Column:
    return F.greatest(_d(0), _d(1) - average_hours / _d(48))


def iso_time(text: Column) -> Column:
    """An ISO-8601 text as timestamp (session zone where it names none), else null."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), text.try_cast("timestamp"))


def hours_old(published: Column, collected: Column, now: Column) -> Column:
    """Hours since the first of the two that is an ISO time, not below 0; 0 if neither is."""
    then = F.coalesce(iso_time(published), iso_time(collected))
    return F.coalesce(F.greatest(_d(0), (now.cast("timestamp").cast("double") - then.cast("double")) / _d(3600)), _d(0))


def parse_published(text: Column) -> Column:
    """Epoch seconds of an ISO-8601 or RFC-2822 time, else null."""
    plain = F.regexp_replace(text, r"^[A-Za-z]{3},?\s+", "")
    mail = [F.try_to_timestamp(plain, F.lit(f"d MMM yyyy HH:mm:ss {zone}")) for zone in ("Z", "z")]
    return F.coalesce(iso_time(text), *mail).cast("long")


def weight_of(weight: Column) -> Column:
    """A source's weight, or that of a source which is not listed."""
    return F.coalesce(weight, F.lit(DEFAULT_WEIGHT))


def valid_time(text: Column) -> Column:
    """Whether a schedule's time of day is an hour of 0 to 23 and a minute of 0 to 59, as HH:MM."""
    return F.coalesce(text.rlike(r"^\s*0*([0-9]|1[0-9]|2[0-3])\s*:\s*0*([0-9]|[1-5][0-9])\s*$"), F.lit(False))
