"""Calendar features as native expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parts(ds: Column) -> dict[str, Column]:
    """Weekday counts from Monday as 0."""
    day = F.weekday(ds)
    return {
        "year": F.year(ds), "quarter": F.quarter(ds), "month": F.month(ds), "week": F.weekofyear(ds), "day": F.dayofmonth(ds), "dayofyear": F.dayofyear(ds),
        "weekday": day, "weekend": (day > 4).cast("int"), "month_start": (F.dayofmonth(ds) == 1).cast("int"), "month_end": (F.last_day(ds) == ds).cast("int"),
    }


def date_parts(df: DataFrame, ds: str = "ds") -> DataFrame:
    return df.select(ds, *[c.cast("int").alias(k) for k, c in parts(F.col(ds)).items()])


def fourier(df: DataFrame, period: float, order: int, ds: str = "ds") -> DataFrame:
    """sin and cos pairs of a period in days, from 1970-01-01."""
    t = F.datediff(F.col(ds), F.lit("1970-01-01").cast("date"))
    terms = [f(2 * F.pi() * k * t / period).alias(f"{n}{k}") for k in range(1, order + 1) for n, f in (("sin", F.sin), ("cos", F.cos))]
    return df.select(ds, *terms)
