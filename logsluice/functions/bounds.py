"""Time arguments of a query, resolved on the driver to literal UTC bounds."""

from __future__ import annotations

import re
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo, ZoneInfoNotFoundError

from logsluice.schema import as_utc

# How long each unit of a relative time is (a month is 30 days).
_UNITS = {
    "hour": timedelta(hours=1),
    "day": timedelta(days=1),
    "week": timedelta(weeks=1),
    "month": timedelta(days=30),
}
_RELATIVE = re.compile(r"-(\d+)\s*(hour|day|week|month)s?", re.IGNORECASE)


def zone(name: str) -> ZoneInfo:
    try:
        return ZoneInfo(name)
    except (ZoneInfoNotFoundError, ValueError) as err:
        raise ValueError(f"unknown time zone: {name!r}") from err


def resolve(value: str | datetime, tz: str = "UTC", now: datetime | None = None) -> datetime:
    """One bound as a UTC datetime; raises ``ValueError`` for unreadable text.

    ``today`` is local midnight; ``-N hours/days/weeks/months`` counts back
    from ``now`` and drops the seconds; anything else is an ISO date or time
    read in ``tz`` unless it carries its own offset.
    """
    if isinstance(value, datetime):
        return as_utc(value)
    text = value.strip()
    relative = _RELATIVE.fullmatch(text)
    if text.lower() == "today" or relative:
        if now is None:
            raise ValueError(f"{text!r} needs now=")
        local = as_utc(now).astimezone(zone(tz))
        if relative:
            past = as_utc(now) - int(relative[1]) * _UNITS[relative[2].lower()]
            return past.replace(second=0, microsecond=0)
        return local.replace(hour=0, minute=0, second=0, microsecond=0).astimezone(timezone.utc)
    try:
        moment = datetime.fromisoformat(text)
    except ValueError as err:
        raise ValueError(f"unreadable date: {value!r}") from err
    if moment.tzinfo is None:
        moment = moment.replace(tzinfo=zone(tz))
    return moment.astimezone(timezone.utc)


def resolve_range(
    start: str | datetime | None,
    end: str | datetime | None,
    tz: str = "UTC",
    now: datetime | None = None,
) -> tuple[datetime | None, datetime | None]:
    """Both bounds. ``today`` as a start also ends the range at 23:59 local."""
    low = resolve(start, tz, now) if start else None
    high = resolve(end, tz, now) if end else None
    if isinstance(start, str) and start.strip().lower() == "today" and high is None:
        local = low.astimezone(zone(tz))
        high = local.replace(hour=23, minute=59).astimezone(timezone.utc)
    return low, high


def start_of(unit: str, now: datetime, tz: str = "UTC") -> datetime:
    """Start of the local ``day`` or ``hour`` that ``now`` lies in, in UTC."""
    local = as_utc(now).astimezone(zone(tz)).replace(minute=0, second=0, microsecond=0)
    if unit == "day":
        local = local.replace(hour=0)
    return local.astimezone(timezone.utc)
