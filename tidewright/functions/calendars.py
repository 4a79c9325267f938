"""Calendars and further date features as native expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _days(ds: Column) -> Column:
    return F.datediff(ds, F.lit("1970-01-01").cast("date"))


def expanded(ds: Column) -> dict[str, Column]:
    """Further parts of a date: flags of starts and ends, week of the month, days, leap cycle, epoch."""
    day, month = F.dayofmonth(ds), F.month(ds)
    last = F.last_day(ds) == ds
    return {
        "hour": F.hour(ds), "weekom": F.floor((day - 1) / 7) + 1, "midyear": F.dayofyear(ds).between(75, 257), "quarter_start": (day == 1) & (month % 3 == 1), "quarter_end": last & (month % 3 == 0),
        "year_start": F.dayofyear(ds) == 1, "year_end": last & (month == 12), "daysinmonth": F.dayofmonth(F.last_day(ds)), "leap_place": F.year(ds) % 4, "epoch": _days(ds),
    }


def binarized(ds: Column) -> dict[str, Column]:
    """0 or 1 for each month and weekday."""
    return {**{f"month_{m}": F.month(ds) == m for m in range(1, 13)}, **{f"weekday_{d}": F.weekday(ds) == d for d in range(7)}}


def common_fourier(ds: Column, order_year: int = 6, order_week: int = 3) -> dict[str, Column]:
    """Year and week in harmonics from 2030-01-01, rounded to 6 decimals."""
    t = F.datediff(ds, F.lit("2030-01-01").cast("date"))
    terms = {}
    for name, p, n in (("y", 365.25, order_year), ("w", 7.0, order_week)):
        for k in range(1, n + 1):
            a = 2 * F.pi() * k * t / p
            terms |= {f"{name}cos{k}": F.round(F.cos(a), 6), f"{name}sin{k}": F.round(F.sin(a), 6)}
    return terms


def features(dates: DataFrame, parts: dict[str, Column], ds: str = "ds") -> DataFrame:
    return dates.select(ds, *[c.cast("double").alias(n) for n, c in parts.items()])


def shifted(dates: DataFrame, make, lags: tuple[int, ...], ds: str = "ds") -> DataFrame:
    """Features of dates some days before (or, below 0, ahead) beside those of the date itself."""
    cols = [c.cast("double").alias(f"{n}_lag{k}" if k else n) for k in (0, *lags) for n, c in make(F.date_sub(F.col(ds), k)).items()]
    return dates.select(ds, *cols)


def polynomial(dates: DataFrame, names: list[str], ds: str = "ds") -> DataFrame:
    """The columns, their squares and their products of two."""
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    return dates.select(ds, *names, *[(F.col(a) * F.col(b)).alias(f"{a}_{b}") for a, b in pairs])


def wavelets(dates: DataFrame, period: float, order: int = 6, sigma: float = 0.15, kind: str = "morlet", ds: str = "ds") -> DataFrame:
    """Bumps at `order` places of a period: morlet, ricker or haar."""
    phase = F.pmod(_days(F.col(ds)) / F.lit(period), F.lit(1.0))

    def one(i: int) -> Column:
        off = F.pmod(phase - i / order + 0.5, F.lit(1.0)) - 0.5
        x = off / sigma
        bell = F.exp(-x * x / 2)
        return {"morlet": bell * F.cos(5 * x), "ricker": (1 - x * x) * bell, "haar": F.when((off >= 0) & (off < 0.5 / order), 1.0).when((off < 0) & (off >= -0.5 / order), -1.0).otherwise(0.0)}[kind]

    return dates.select(ds, *[one(i).alias(f"{kind}{i}") for i in range(order)])


def islamic(ds: Column) -> dict[str, Column]:
    """Year, month and day of the tabular Islamic calendar, by whole-number arithmetic."""
    jd = _days(ds) + 2440588
    left = jd - 1948440 + 10632
    n = F.floor((left - 1) / 10631)
    left = left - 10631 * n + 354
    j = F.floor((10985 - left) / 5316) * F.floor((50 * left) / 17719) + F.floor(left / 5670) * F.floor((43 * left) / 15238)
    left = left - F.floor((30 - j) / 15) * F.floor((17719 * j) / 50) - F.floor(j / 16) * F.floor((15238 * j) / 43) + 29
    month = F.floor(24 * left / 709)
    return {"islamic_year": 30 * n + j - 30, "islamic_month": month, "islamic_day": left - F.floor(709 * month / 24)}


#: Days of a mean month of the moon, and a new moon in days since 1970 (2000-01-06 18:14 UTC).
SYNODIC, NEW_MOON = 29.530588853, 10962.76


def moon(ds: Column) -> dict[str, Column]:
    """Share of the moon that is lit (by its mean month), and month and day of the moon since 2000."""
    age = (_days(ds) + 0.5 - NEW_MOON) / SYNODIC
    part = age - F.floor(age)
    return {"moon_lit": (1 - F.cos(2 * F.pi() * part)) / 2, "lunar_month": F.floor(age), "lunar_day": F.floor(part * SYNODIC) + 1}


def hebrew_year_start(year: Column) -> Column:
    """Days since 1970 of the first day of a Hebrew year, with the postponements of its rules."""
    months = F.floor((235 * year - 234) / 19)
    parts = 12084 + 13753 * months
    day = 29 * months + F.floor(parts / 25920)
    day = F.when(3 * (day + 1) % 7 < 3, day + 1).otherwise(day)
    return day


def _hebrew_epoch(year: Column) -> Column:
    before, now, after = (hebrew_year_start(y) for y in (year - 1, year, year + 1))
    delay = F.when(after - now == 356, 2).when(now - before == 382, 1).otherwise(0)
    return now + delay - 2092591


def hebrew(ds: Column) -> dict[str, Column]:
    """Year, and day within it, of the Hebrew calendar."""
    days = _days(ds)
    guess = F.year(ds) + 3760
    year = F.when(days >= _hebrew_epoch(guess + 1), guess + 1).otherwise(guess)
    return {"hebrew_year": year, "hebrew_day": days - _hebrew_epoch(year) + 1}


def _nth(ds: Column, month: int, weekday: int, n: int) -> Column:
    """The n-th weekday (Monday 0) of a month; -1 is the last."""
    right = (F.month(ds) == month) & (F.weekday(ds) == weekday)
    return right & ((F.floor((F.dayofmonth(ds) - 1) / 7) + 1 == n) if n > 0 else F.dayofmonth(ds) + 7 > F.dayofmonth(F.last_day(ds)))


def us_holidays(ds: Column) -> dict[str, Column]:
    """Federal holidays of the United States by their rules, without days off in lieu."""
    on = lambda m, d: (F.month(ds) == m) & (F.dayofmonth(ds) == d)
    return {
        "new_year": on(1, 1), "king": _nth(ds, 1, 0, 3), "washington": _nth(ds, 2, 0, 3), "memorial": _nth(ds, 5, 0, -1), "juneteenth": on(6, 19), "independence": on(7, 4),
        "labor": _nth(ds, 9, 0, 1), "columbus": _nth(ds, 10, 0, 2), "veterans": on(11, 11), "thanksgiving": _nth(ds, 11, 3, 4), "christmas": on(12, 25),
    }


def holiday_flags(dates: DataFrame, holidays: DataFrame | None = None, ds: str = "ds", each: bool = False) -> DataFrame:
    """0 or 1 by date: a column `holiday`, or one for each; `holidays`: a table of dates of one's own."""
    if holidays is not None:
        return dates.join(F.broadcast(holidays.select(ds, F.lit(1).alias("holiday")).distinct()), ds, "left").select(ds, F.coalesce("holiday", F.lit(0)).alias("holiday"))
    found = us_holidays(F.col(ds))
    if each:
        return dates.select(ds, *[c.cast("int").alias(n) for n, c in found.items()])
    any_of = F.lit(False)
    for c in found.values():
        any_of = any_of | c
    return dates.select(ds, any_of.cast("int").alias("holiday"))
