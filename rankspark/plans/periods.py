"""Report periods (CMP-2): pairs of inclusive ISO date strings, driver side."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass


@dataclass(frozen=True)
class Periods:
    period1_start: str
    period1_end: str
    period2_start: str
    period2_end: str

    @property
    def span(self) -> tuple[str, str]:
        """Smallest range covering both periods (for pruning the scan)."""
        return (min(self.period1_start, self.period2_start), max(self.period1_end, self.period2_end))


def _period_start(day: dt.date, unit: str) -> dt.date:
    """First day of the ISO week or calendar month that holds ``day``."""
    return day - dt.timedelta(days=day.isoweekday() - 1 if unit == "week" else day.day - 1)


def period_bounds(as_of: dt.date | str, period_type: str = "week", custom: dict | None = None) -> Periods:
    """Period 2 runs from the start of the current week or month to ``as_of``; period 1 is the whole
    week or month before it. ``custom`` gives both as ``{"period1": {"start", "end"}, "period2": {...}}``."""
    if period_type == "custom":
        if not custom:
            raise ValueError("a custom comparison needs both periods")
        return Periods(*(custom[p][edge] for p in ("period1", "period2") for edge in ("start", "end")))
    if period_type not in ("week", "month"):
        raise ValueError(f"unknown period type {period_type!r}")
    day = dt.date.fromisoformat(as_of) if isinstance(as_of, str) else as_of
    current = _period_start(day, period_type)
    before = current - dt.timedelta(days=1)
    bounds = (_period_start(before, period_type), before, current, day)
    return Periods(*(d.isoformat() for d in bounds))
