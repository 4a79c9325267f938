"""Scalar functions as native expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def mu_law(x: Column, mu: float = 255.0) -> Column:
    return F.signum(x) * F.log1p(mu * F.abs(x)) / math.log1p(mu)


def mu_law_back(x: Column, mu: float = 255.0) -> Column:
    return F.signum(x) * F.expm1(F.abs(x) * math.log1p(mu)) / mu


def a_law(x: Column, a: float = 87.6) -> Column:
    size = F.abs(x)
    return F.signum(x) * F.when(size < 1 / a, a * size).otherwise(1 + F.log(F.greatest(a * size, F.lit(1.0)))) / (1 + math.log(a))


def a_law_back(x: Column, a: float = 87.6) -> Column:
    size = F.abs(x) * (1 + math.log(a))
    return F.signum(x) * F.when(size < 1, size).otherwise(F.exp(size - 1)) / a


def scaled_round(x: Column, digits: int) -> Column:
    """x rounded half away from zero as a scaled double, the way SQL engines in C do; F.round goes
    by the shortest decimal, so the two part where a border has no exact double."""
    return F.round(x * 10.0**digits) / 10.0**digits


# The coefficients of the published approximation 7.1.26 of the error function,
# whose error is below 1.5e-7.
_ERF = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def erf(x: Column) -> Column:
    t = 1 / (1 + 0.3275911 * F.abs(x))
    poly = F.lit(0.0)
    for c in reversed(_ERF):
        poly = (poly + c) * t
    return F.signum(x) * (1 - poly * F.exp(-x * x))


def normal_survival(x: Column) -> Column:
    return 0.5 * (1 - erf(x / math.sqrt(2)))


#: Survival functions of a score with a location, by distribution.
SURVIVAL = {
    "norm": lambda x, loc: normal_survival(x - loc),
    "laplace": lambda x, loc: F.when(x >= loc, 0.5 * F.exp(-(x - loc))).otherwise(1 - 0.5 * F.exp(x - loc)),
    "cauchy": lambda x, loc: 0.5 - F.atan(x - loc) / math.pi,
    "uniform": lambda x, loc: F.least(F.greatest(1 - (x - loc), F.lit(0.0)), F.lit(1.0)),
    "gamma": lambda x, loc: F.when(x > 0, F.exp(-x)).otherwise(1.0),  # of shape 1
}


def growth(step: Column, horizon: int, final: float) -> Column:
    """Growth until a step on the way to a final growth over the horizon."""
    return F.pow(F.lit(1 + final), step / horizon) - 1


def decay(back: Column, span: float | None = None, halflife: float | None = None) -> Column:
    """Weight of a row that is `back` rows old."""
    return F.pow(F.lit(1 - 2 / (span + 1)), back) if span else F.pow(F.lit(0.5), back / halflife)


def model_id(model: Column, params: Column, transforms: Column) -> Column:
    """A template's name: its parts without white space, hashed."""
    return F.md5(F.regexp_replace(F.concat(*[F.coalesce(c, F.lit("")) for c in (model, params, transforms)]), r"\s", ""))


def frequency_seconds(text: Column) -> Column:
    """The length in seconds of a step such as 15min, 2H, D or W."""
    n = F.coalesce(F.nullif(F.regexp_extract(text, r"^\s*(\d+)", 1), F.lit("")).cast("long"), F.lit(1))
    unit = F.lower(F.regexp_extract(text, r"([A-Za-z]+)", 1))
    size = F.when(unit.isin("s", "sec"), 1).when(unit.isin("t", "min"), 60).when(unit.isin("h", "hr"), 3600).when(unit.isin("d", "day"), 86400).when(unit.startswith("w"), 604800)
    return n * size
