"""Cron expressions as predicates and next times over timestamp columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bounds of the five fields and the names of months and week days (fixed values).
FIELDS = (("minute", 0, 59), ("hour", 0, 23), ("dom", 1, 31), ("month", 1, 12), ("dow", 0, 6))
NAMES = {
    "month": dict(zip("jan feb mar apr may jun jul aug sep oct nov dec".split(), range(1, 13), strict=True)),
    "dow": dict(zip("sun mon tue wed thu fri sat".split(), range(7), strict=True)),
}


def _number(text: str, field: str) -> int:
    named = NAMES.get(field, {}).get(text.strip().lower())
    value = int(text) if named is None else named
    return 0 if field == "dow" and value == 7 else value


def field_values(spec: str, field: str, low: int, high: int) -> list[int]:
    """Allowed values of a field: lists, ranges (which may wrap), steps, names, * and 7 for Sunday."""
    out: set[int] = set()
    for atom in spec.split(","):
        body, slash, step_text = atom.strip().partition("/")
        step = int(step_text) if slash else 1
        if step <= 0 or not body:
            raise ValueError(f"bad {field} field: {spec!r}")
        first, dash, last = body.partition("-")
        if body == "*":
            a, b = low, high
        elif dash:
            a, b = _number(first, field), _number(last, field)
        else:
            a = _number(body, field)
            b = high if slash else a
        if not (low <= a <= high and low <= b <= high):
            raise ValueError(f"{field} out of range: {spec!r}")
        ring = [*range(a, b + 1)] if a <= b else [*range(a, high + 1), *range(low, b + 1)]
        out.update(ring[::step])
    return sorted(out)


def _restricted(spec: str) -> bool:
    """Whether a day field restricts days for the either-day rule: not if it is stars alone or steps of a star."""
    return not spec.startswith("*/") and any(atom.strip() != "*" for atom in spec.split(","))


@dataclass(frozen=True)
class Cron:
    minutes: tuple[int, ...]
    hours: tuple[int, ...]
    days: tuple[int, ...]
    months: tuple[int, ...]
    week_days: tuple[int, ...]
    either_day: bool  # both day fields are restricted: one of them is enough

    @classmethod
    def parse(cls, text: str) -> Cron:
        parts = text.split()
        if len(parts) != 5:
            raise ValueError(f"five fields are needed: {text!r}")
        sets = [tuple(field_values(p, *f)) for p, f in zip(parts, FIELDS, strict=True)]
        return cls(*sets, either_day=_restricted(parts[2]) and _restricted(parts[4]))

    def describe(self) -> dict[str, tuple[int, ...]]:
        """The allowed values of each field."""
        return {"minutes": self.minutes, "hours": self.hours, "days_of_month": self.days, "months": self.months, "days_of_week": self.week_days}

    def day_matches(self, day: Column) -> Column:
        dom, dow = F.dayofmonth(day).isin(*self.days), (F.dayofweek(day) - 1).isin(*self.week_days)
        return F.month(day).isin(*self.months) & ((dom | dow) if self.either_day else (dom & dow))

    def matches(self, ts: Column) -> Column:
        return F.minute(ts).isin(*self.minutes) & F.hour(ts).isin(*self.hours) & self.day_matches(ts)

    def next_after(self, ts: Column, horizon_days: int = 366 * 8) -> Column:
        """The first matching minute after ts, null beyond the horizon (days, one array per row).

        Eight years hold a 29 February, also around a century's end; years after the first are searched only
        where the first has no match.
        """
        slots = F.array(*[F.lit(h * 60 + m) for h in self.hours for m in self.minutes])
        now = F.hour(ts) * 60 + F.minute(ts)
        today = F.try_element_at(F.filter(slots, lambda s: s > now), F.lit(1))
        day = F.to_date(ts)

        def first_day(low: int, high: int) -> Column:
            days = F.filter(F.sequence(F.lit(low), F.lit(high)), lambda d: self.day_matches(F.date_add(day, d)))
            return F.try_element_at(days, F.lit(1))

        near = first_day(1, min(horizon_days, 366))
        later = F.date_add(day, F.coalesce(near, first_day(367, horizon_days)) if horizon_days > 366 else near)

        def at(d: Column, slot: Column) -> Column:
            return F.timestamp_add("MINUTE", slot, d.cast("timestamp_ntz"))

        return F.when(self.day_matches(day) & today.isNotNull(), at(day, today)).otherwise(at(later, F.element_at(slots, 1)))

    def upcoming(self, ts: Column, count: int, horizon_days: int = 366 * 8) -> Column:
        """The next count matching minutes after ts in order, fewer if the horizon (days after ts) holds fewer.

        The days that match are listed until they hold count slots, a short array per row: only as much of the
        horizon is listed as is sure to be needed, and all of it only where that does not do.
        """
        slots = F.array(*[F.lit(h * 60 + m) for h in self.hours for m in self.minutes])
        day, now = F.to_date(ts), F.hour(ts) * 60 + F.minute(ts)
        days_needed = -(-count // (len(self.hours) * len(self.minutes))) + 1  # the first day may be over already

        def within(horizon: int) -> Column:
            days = F.filter(F.sequence(F.lit(0), F.lit(horizon)), lambda d: self.day_matches(F.date_add(day, d)))
            return F.slice(days, 1, days_needed)

        near = within(min(horizon_days, 366))
        if horizon_days > 366:
            near = F.when(F.size(near) < days_needed, within(horizon_days)).otherwise(near)
        at = F.flatten(F.transform(near, lambda d: F.transform(F.filter(slots, lambda s: (d > 0) | (s > now)), lambda s: F.timestamp_add("MINUTE", s, F.date_add(day, d).cast("timestamp_ntz")))))
        return F.slice(at, 1, count)
