"""Durations as whole milliseconds, for range frames over epoch milliseconds."""

from __future__ import annotations

from datetime import datetime, timezone


def millis(n: float) -> int:
    return round(n)


def seconds(n: float) -> int:
    return round(n * 1000)


def minutes(n: float) -> int:
    return seconds(60 * n)


def hours(n: float) -> int:
    return minutes(60 * n)


def days(n: float) -> int:
    return hours(24 * n)


def weeks(n: float) -> int:
    return days(7 * n)


def at(text: str) -> int:
    """Epoch milliseconds of an ISO date or time, in UTC."""
    found = datetime.fromisoformat(text)
    return round((found if found.tzinfo else found.replace(tzinfo=timezone.utc)).timestamp() * 1000)
