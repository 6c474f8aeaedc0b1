"""Calendar columns. Instants are UTC; days are dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def decade(year: Column) -> Column:
    return (F.floor(year / 10) * 10).cast("int")


def decades(year: int, n: int = 7) -> list[int]:
    """The decade of a year and the ones before it, newest first."""
    return [year // 10 * 10 - 10 * k for k in range(n)]


def calendar_date(text: Column) -> Column:
    """The date that a text begins with, or null."""
    head = F.substring(text, 1, 10)
    return F.when(head.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.try_to_date(head, "yyyy-MM-dd"))


def within(day: Column, today: Column, before: int, after: int) -> Column:
    """Whether a day lies in the calendar window around another."""
    return F.datediff(day, today).between(-before, after)


def soonest_future(days: list[tuple[str, Column]], today: Column) -> Column:
    """(day, label) of the first labelled date after today, or null; of equal days the first label in the list."""
    found = [F.struct(d.alias("day"), F.lit(k).alias("at"), F.lit(label).alias("label")) for k, (label, d) in enumerate(days)]
    best = F.array_min(F.filter(F.array(*found), lambda x: x["day"] > today))
    return F.when(best.isNotNull(), F.struct(best["day"].alias("day"), best["label"].alias("label")))


def day_start(at: Column, back: int = 0) -> Column:
    """Midnight (UTC) of the instant's day, so many days earlier."""
    return F.date_trunc("day", at) - F.make_interval(days=F.lit(back))


def local_day(at: Column, zone: str) -> Column:
    return F.to_date(F.from_utc_timestamp(at, zone))


def next_midnight(at: Column, zone: str) -> Column:
    """The next midnight of a zone, as UTC."""
    return F.to_utc_timestamp(F.date_add(local_day(at, zone), 1).cast("timestamp"), zone)


def remaining(seconds: Column) -> Column:
    """A length of time for people: days and hours, hours and minutes, minutes, or less than a minute."""
    s = F.greatest(seconds, F.lit(0))
    d, h, m = F.floor(s / 86400), F.floor(s % 86400 / 3600), F.floor(s % 3600 / 60)
    return F.when(d > 0, F.format_string("%dd %dh", d, h)).when(h > 0, F.format_string("%dh %dm", h, m)).when(m > 0, F.format_string("%dm", m)).otherwise("under a minute")


def expiry(at: Column, days: Column) -> Column:
    """When an entry of so many fresh days ends; null days: never."""
    return F.when(days.isNotNull(), at + F.make_interval(days=days))
