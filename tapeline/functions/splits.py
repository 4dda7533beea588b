"""Walk-forward splits with purge and embargo over a list of dates."""

from __future__ import annotations

import calendar
from bisect import bisect_left
from collections.abc import Sequence
from datetime import date


def walk_forward(dates: Sequence[date], train: int, validate: int, horizon: int) -> list[dict[str, list[date]]]:
    """Splits by numbers of dates: ``train``, ``horizon`` purged ones, ``validate``, then ``horizon`` embargoed ones in full."""
    found, begin = [], 0
    while True:
        first = begin + train + horizon
        last = first + validate
        if last + horizon > len(dates):
            return found
        found.append({"train": list(dates[begin : begin + train]), "purge": list(dates[begin + train : first]), "validate": list(dates[first:last]), "embargo": list(dates[last : last + horizon])})
        begin += validate


def add_months(day: date, months: int) -> date:
    """The same day ``months`` later, or the last of that month."""
    year, month = divmod(day.year * 12 + day.month - 1 + months, 12)
    return date(year, month + 1, min(day.day, calendar.monthrange(year, month + 1)[1]))


def month_splits(dates: Sequence[date], train: int, validate: int, step: int, horizon: int) -> list[dict[str, list[date]]]:
    """Splits by calendar months from the first date on, moved by ``step`` months as long as the dates reach.

    The last ``horizon`` dates before a validation are purged from its training, the ``horizon`` dates after it embargoed;
    they must exist in full. A split without training or validation dates is left out.
    """
    days = sorted(set(dates))
    found: list[dict[str, list[date]]] = []
    anchor = days[0] if days else date.max
    while days:
        begin = bisect_left(days, anchor)
        first, last = (bisect_left(days, add_months(anchor, m)) for m in (train, train + validate))
        if last >= len(days) or last <= first or last + horizon > len(days):
            break
        end = max(begin, first - horizon)
        if end > begin:
            found.append({"train": days[begin:end], "purge": days[end:first], "validation": days[first:last], "embargo": days[last : last + horizon]})
        anchor = add_months(anchor, step)
    return found
