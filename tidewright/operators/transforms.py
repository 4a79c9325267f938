"""Transformations of a filled panel and their inverses.

A transformer is three functions: `fit` makes a table of parameters with a row a series, `apply`
and `invert` are joins with it and expressions. Parameters are a row a series, so they are
broadcast or shuffled as the planner sees fit, and what was fitted on one panel can be applied to
another and inverted on a forecast (series_id, ds, y).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .impute import BEFORE, S, T, impute
from .lineage import cut

Y = F.col
ORIGIN = "1970-01-01"


def _day() -> Column:
    """Days since 1970, the clock of trends."""
    return F.datediff("ds", F.lit(ORIGIN).cast("date")).cast("double")


def _q(p: float) -> Column:
    return F.percentile("y", F.lit(p))


def _or(c: Column, value: float) -> Column:
    """c, or the value where it is 0 or null."""
    return F.coalesce(F.nullif(c, F.lit(0.0)), F.lit(value))


@dataclass(frozen=True)
class Transformer:
    fit: Callable[[DataFrame], DataFrame]
    apply: Callable[[DataFrame, DataFrame], DataFrame]
    invert: Callable[[DataFrame, DataFrame, str], DataFrame]


def _out(df: DataFrame, y: Column) -> DataFrame:
    return df.select("series_id", "ds", y.alias("y"))


def pointwise(stats: Callable[[], dict[str, Column]], forward: Callable[[], Column], back: Callable[[], Column] | None = None) -> Transformer:
    """Each value for itself, given some statistics of its series; without `back` the inverse
    gives values as they are."""

    def fit(panel: DataFrame) -> DataFrame:
        return panel.groupBy("series_id").agg(*[c.alias(f"_{k}") for k, c in stats().items()])

    return Transformer(fit, lambda p, s: _out(p.join(s, "series_id"), forward()), lambda p, s, mode="forecast": _out(p.join(s, "series_id"), back()) if back else p.select("series_id", "ds", "y"))


def ordered(stats: Callable[[], dict[str, Column]], forward: Callable[[], Column], back: Callable[[], Column], first: Callable[[], Column]) -> Transformer:
    """Values that depend on the ones before. `back` is the inverse on rows that follow the history
    (`_last` is known), `first` that on the history itself (`_first` is)."""

    def fit(panel: DataFrame) -> DataFrame:
        return panel.groupBy("series_id").agg(*[c.alias(f"_{k}") for k, c in stats().items()])

    return Transformer(fit, lambda p, s: _out(p.join(s, "series_id"), forward()), lambda p, s, mode="forecast": _out(p.join(s, "series_id"), back() if mode == "forecast" else first()))


_rank = lambda: F.row_number().over(S().orderBy(F.col("ds").desc()))
_sum = lambda c: F.sum(c).over(BEFORE())
_lag = lambda c="y": F.lag(c).over(T())
_ends = lambda: {"first": F.min_by("y", "ds"), "last": F.max_by("y", "ds")}


def _product(c: Column) -> Column:
    """Running product over a series; 0 from its first 0 on."""
    size = F.exp(_sum(F.log(F.abs(F.nullif(c, F.lit(0.0))))))
    sign = F.when(F.pmod(_sum((c < 0).cast("int")), F.lit(2)) == 1, -1.0).otherwise(1.0)
    return F.when(_sum((c == 0).cast("int")) > 0, 0.0).otherwise(size * sign)


def _zeros_replaced() -> Column:
    return F.coalesce(F.nullif("y", F.lit(0.0)), Y("_least"), F.lit(0.1))


_CENTER = {"median": lambda: _q(0.5), "mean": lambda: F.avg("y"), "midhinge": lambda: (_q(0.25) + _q(0.75)) / 2}


def scaler_of(shift: str, scale: str) -> Transformer:
    return pointwise(
        lambda: {
            "m": {"mean": F.avg("y"), "min": F.min("y"), "median": _q(0.5), "zero": F.lit(0.0)}[shift],
            "s": _or({"std": F.stddev_pop("y"), "range": F.max("y") - F.min("y"), "max": F.max(F.abs("y")), "iqr": _q(0.75) - _q(0.25)}[scale], 1.0),
        },
        lambda: (Y("y") - Y("_m")) / Y("_s"),
        lambda: Y("y") * Y("_s") + Y("_m"),
    )


def positive_shift(center_one: bool = True, squared: bool = False, log: bool = False) -> Transformer:
    """Values moved up until the least is 1 (or 0), where it is below; squared or logarithmic if asked."""
    stats = lambda: {"shift": F.greatest(F.lit(1.0 if center_one else 0.0) - F.min("y"), F.lit(0.0))}
    up = lambda: Y("y") + Y("_shift")
    forward = lambda: F.log(up()) if log else up() * up() if squared else up()
    back = lambda: (F.exp("y") if log else F.sqrt(F.greatest("y", F.lit(0.0))) if squared else Y("y")) - Y("_shift")
    return pointwise(stats, forward, back)


def clip_outliers(k: float = 4.0, method: str = "clip") -> Transformer:
    """Values beyond k sample deviations from the mean are cut there, or become null (`remove`)."""
    stats = lambda: {"lo": F.avg("y") - k * F.stddev_samp("y"), "hi": F.avg("y") + k * F.stddev_samp("y")}
    cut = lambda: F.greatest(F.least("y", "_hi"), "_lo") if method == "clip" else F.when(Y("y").between(Y("_lo"), Y("_hi")) | Y("_lo").isNull(), Y("y"))
    return pointwise(stats, cut)


def rounding(decimals: int = 0, on_transform: bool = False, on_inverse: bool = True) -> Transformer:
    """Half to even, on the way out and/or back."""
    even = lambda: F.bround("y", decimals)
    return pointwise(lambda: {"n": F.count("y")}, even if on_transform else lambda: Y("y"), even if on_inverse else None)


def detrend(intercept: bool = True, phi: float = 1.0) -> Transformer:
    """The least-squares line over days off, with an intercept or (as generalised least squares by
    default) through the origin of time. The inverse adds it, its growth damped by phi a step."""

    def fit(panel: DataFrame) -> DataFrame:
        held = panel.where("y IS NOT NULL").withColumn("_x", _day())
        x = Y("_x")
        if intercept:
            stats = (F.coalesce(F.regr_slope("y", "_x"), F.lit(0.0)), F.coalesce(F.regr_intercept("y", "_x"), F.avg("y")))
        else:
            stats = (F.coalesce(F.sum(Y("y") * x) / F.nullif(F.sum(x * x), F.lit(0.0)), F.lit(0.0)), F.lit(0.0))
        return held.groupBy("series_id").agg(stats[0].alias("_b"), stats[1].alias("_a"), F.max("_x").alias("_end"))

    line = lambda: Y("_a") + Y("_b") * _day()
    ahead = lambda: _day() - Y("_end")
    damped = lambda: Y("_a") + Y("_b") * (Y("_end") + F.lit(phi) * (1 - F.pow(F.lit(phi), ahead())) / F.lit(1 - phi if phi != 1 else 1.0))
    back = lambda p, s, mode="forecast": _out(p.join(s, "series_id"), Y("y") + (line() if phi == 1 or mode != "forecast" else damped()))
    return Transformer(fit, lambda p, s: _out(p.join(s, "series_id"), Y("y") - line()), back)


def intermittent(center: str = "median") -> Transformer:
    """-1, 0 or 1: below, at or above the centre; back to the centre and the mean excess each way."""

    def fit(panel: DataFrame) -> DataFrame:
        mid = panel.groupBy("series_id").agg(_CENTER[center]().alias("_c"))
        up, down = (F.coalesce(F.avg(F.when(f(Y("y"), Y("_c")), Y("y") - Y("_c"))), F.lit(0.0)) for f in (lambda a, b: a > b, lambda a, b: a < b))
        return panel.join(mid, "series_id").groupBy("series_id", "_c").agg(up.alias("_up"), down.alias("_down"))

    back = lambda: Y("_c") + F.when(Y("y") > 0, Y("y") * Y("_up")).when(Y("y") < 0, -Y("y") * Y("_down")).otherwise(0.0)
    return Transformer(fit, lambda p, s: _out(p.join(s, "series_id"), F.signum(Y("y") - Y("_c"))), lambda p, s, mode="forecast": _out(p.join(s, "series_id"), back()))


def discretize(how: str = "center", bins: int = 10) -> Transformer:
    """Each value becomes that of its bin: the bins' edges are quantiles; `lower` and `upper` are
    the edges around a value, `center` the middle between them."""
    edges = lambda: {"e": F.percentile("y", F.array(*[F.lit(i / bins) for i in range(bins + 1)]))}

    def value() -> Column:
        at = F.greatest(F.least(F.size(F.filter("_e", lambda e: e <= Y("y"))), F.lit(bins)), F.lit(1))
        lo, hi = F.element_at("_e", at), F.element_at("_e", at + 1)
        return {"lower": lo, "upper": hi, "center": (lo + hi) / 2}[how]

    return pointwise(edges, value)


def center_last(rows: int = 1) -> Transformer:
    """Divided by the mean of the last rows; where that is 0, by the median of the others, else by 1."""

    def fit(panel: DataFrame) -> DataFrame:
        held = panel.withColumn("_r", _rank())
        last, rest = F.avg(F.when(Y("_r") <= rows, Y("y"))), F.percentile(F.nullif("y", F.lit(0.0)), F.lit(0.5))
        return held.groupBy("series_id").agg(F.coalesce(F.nullif(last, F.lit(0.0)), F.nullif(rest, F.lit(0.0)), F.lit(1.0)).alias("_c"))

    return Transformer(fit, lambda p, s: _out(p.join(s, "series_id"), Y("y") / Y("_c")), lambda p, s, mode="forecast": _out(p.join(s, "series_id"), Y("y") * Y("_c")))


def shift_first(rows: int = 1) -> Transformer:
    """Less the mean of the first known rows."""

    def fit(panel: DataFrame) -> DataFrame:
        held = panel.where("y IS NOT NULL").withColumn("_r", F.row_number().over(T()))
        return held.where(Y("_r") <= rows).groupBy("series_id").agg(F.avg("y").alias("_c"))

    return Transformer(fit, lambda p, s: _out(p.join(s, "series_id"), Y("y") - Y("_c")), lambda p, s, mode="forecast": _out(p.join(s, "series_id"), Y("y") + Y("_c")))


def seasonal_difference(lag: int = 7, how: str = "last") -> Transformer:
    """Less the season's profile: the last value, mean or median of each place, counted from the end.
    Parameters have a row a series and place."""

    def fit(panel: DataFrame) -> DataFrame:
        held = panel.withColumns({"_r": _rank(), "_b": F.pmod(-_rank(), F.lit(lag))})
        stat = {"last": F.min_by("y", "_r"), "mean": F.avg("y"), "median": F.median("y")}[how]
        return held.groupBy("series_id", "_b").agg(stat.alias("_p"))

    def place(p: DataFrame, mode: str) -> DataFrame:
        return p.withColumn("_b", F.pmod(F.row_number().over(T()) - 1, F.lit(lag)) if mode == "forecast" else F.pmod(-_rank(), F.lit(lag)))

    def invert(p: DataFrame, s: DataFrame, mode: str = "forecast") -> DataFrame:
        return _out(place(p, mode).join(s, ["series_id", "_b"]), Y("y") + Y("_p"))

    return Transformer(fit, lambda p, s: _out(place(p, "history").join(s, ["series_id", "_b"]), Y("y") - Y("_p")), invert)


def mean_difference() -> Transformer:
    """Less the mean of all series at the step before; the first step stays. The inverse on the
    history adds the same means; forecasts add the last one."""
    every = lambda panel: panel.groupBy("ds").agg(F.avg("y").alias("_a")).withColumn("_p", F.lag("_a").over(Window.orderBy("ds")))  # noqa: E731  (a row a date)

    def fit(panel: DataFrame) -> DataFrame:
        return every(panel).select("ds", F.coalesce("_p", F.lit(0.0)).alias("_p"), F.max_by("_a", "ds").over(Window.partitionBy()).alias("_last"))

    def invert(p: DataFrame, s: DataFrame, mode: str = "forecast") -> DataFrame:
        if mode != "forecast":
            return _out(p.join(s, "ds"), Y("y") + Y("_p"))
        return _out(p.crossJoin(F.broadcast(s.select("_last").limit(1))), Y("y") + Y("_last"))

    return Transformer(fit, lambda p, s: _out(p.join(s, "ds"), Y("y") - Y("_p")), invert)


def rolling_mean(window: int = 10, center: bool = False, geometric: bool = False) -> Transformer:
    """Mean of the last rows (fixed: the inverse gives values as they are). `center` takes half of
    them from ahead; `geometric` is the mean of the logarithms of values above 0."""
    ahead = window // 2 if center else 0
    w = lambda: T().rowsBetween(1 - window + ahead, ahead)
    y = lambda: F.exp(F.avg(F.when(Y("y") > 0, F.log("y"))).over(w())) if geometric else F.avg("y").over(w())
    return pointwise(lambda: {"n": F.count("y")}, y)


def companding(law: str = "mu", mu: float = 255.0, a: float = 87.6, factor: float = 3.0) -> Transformer:
    """Around the median, over `factor` median absolute deviations from it, and through the mu or A law."""

    def fit(panel: DataFrame) -> DataFrame:
        mid = panel.groupBy("series_id").agg(_q(0.5).alias("_m"))
        dev = F.percentile(F.abs(Y("y") - Y("_m")), F.lit(0.5)) * factor
        return panel.join(mid, "series_id").groupBy("series_id", "_m").agg(_or(dev, 1.0).alias("_s"))

    from ..functions.scalar import a_law, a_law_back, mu_law, mu_law_back

    forward, back = ((lambda x: mu_law(x, mu)), (lambda x: mu_law_back(x, mu))) if law == "mu" else ((lambda x: a_law(x, a)), (lambda x: a_law_back(x, a)))
    return Transformer(
        fit,
        lambda p, s: _out(p.join(s, "series_id"), forward((Y("y") - Y("_m")) / Y("_s"))),
        lambda p, s, mode="forecast": _out(p.join(s, "series_id"), back(Y("y")) * Y("_s") + Y("_m")),
    )


def align_last(rows: int = 1, strength: float = 1.0, multiplicative: bool = False) -> Transformer:
    """Nothing on the history; a forecast is moved so that its first step meets the mean of the
    history's last rows, by `strength` of the way."""

    def fit(panel: DataFrame) -> DataFrame:
        return panel.withColumn("_r", _rank()).where(Y("_r") <= rows).groupBy("series_id").agg(F.avg("y").alias("_c"))

    def invert(p: DataFrame, s: DataFrame, mode: str = "forecast") -> DataFrame:
        if mode != "forecast":
            return p
        first = F.first("y").over(T())
        y = Y("y") * (1 + (Y("_c") / F.nullif(first, F.lit(0.0)) - 1) * strength) if multiplicative else Y("y") + strength * (Y("_c") - first)
        return _out(p.join(s, "series_id"), F.coalesce(y, Y("y")))

    return Transformer(fit, lambda p, s: p.select("series_id", "ds", "y"), invert)


def align_last_diff(quantile: float = 0.5) -> Transformer:
    """A forecast whose first step is further from the history's last row than the quantile of its
    steps that way is moved back by the excess."""

    def fit(panel: DataFrame) -> DataFrame:
        d = panel.withColumn("_d", Y("y") - _lag())
        up, down = (F.coalesce(F.percentile(F.when(c, Y("_d")), F.lit(p)), F.lit(0.0)) for c, p in ((Y("_d") > 0, quantile), (Y("_d") < 0, 1 - quantile)))
        return d.groupBy("series_id").agg(up.alias("_up"), down.alias("_down"), F.max_by("y", "ds").alias("_last"))

    def invert(p: DataFrame, s: DataFrame, mode: str = "forecast") -> DataFrame:
        if mode != "forecast":
            return p
        gap = F.first("y").over(T()) - Y("_last")
        return _out(p.join(s, "series_id"), Y("y") - F.greatest(gap - Y("_up"), F.lit(0.0)) - F.least(gap - Y("_down"), F.lit(0.0)))

    return Transformer(fit, lambda p, s: p.select("series_id", "ds", "y"), invert)


def replace_constant(constant: float = 0.0, fill: str = "interpolate") -> Transformer:
    """The constant becomes missing and is filled; the inverse gives values as they are."""
    return Transformer(lambda p: p.select("series_id").distinct(), lambda p, s: impute(p.withColumn("y", F.nullif("y", F.lit(constant))), fill), lambda p, s, mode="forecast": p)


def level_shift(window: int = 90, alpha: float = 2.5, gap: int = 3, most: int = 20) -> Transformer:
    """Level shifts taken out of a series' past.

    A row whose mean behind and mean ahead (`window` rows each, itself in both) differ by more
    than `alpha` deviations of these differences is a candidate; candidates at most `gap` rows
    apart are one group, of which the row of the largest difference stays, `most` of them at most.
    A row is moved by the sum of the differences at the shifts from it on. Parameters have a row a
    shift.
    """

    def fit(panel: DataFrame) -> DataFrame:
        behind, ahead = F.avg("y").over(T().rowsBetween(1 - window, 0)), F.avg("y").over(T().rowsBetween(0, window - 1))
        d = panel.withColumns({"_d": behind - ahead, "_i": F.row_number().over(T())})
        found = d.withColumn("_sd", F.stddev_samp("_d").over(S())).where(F.abs("_d") > alpha * Y("_sd"))
        new = F.coalesce((Y("_i") - F.lag("_i").over(T()) > gap).cast("int"), F.lit(1))
        grouped = found.withColumn("_new", new).withColumn("_g", F.sum("_new").over(BEFORE()))
        top = grouped.groupBy("series_id", "_g").agg(F.max_by(F.struct("ds", "_d"), F.struct(F.abs("_d").alias("a"), (-Y("_i")).alias("i"))).alias("b")).select("series_id", "b.ds", "b._d")
        w = S().orderBy(F.abs("_d").desc(), "ds")
        return top.withColumn("_r", F.row_number().over(w)).where(Y("_r") <= most).select("series_id", "ds", "_d")

    def moved(p: DataFrame, s: DataFrame, sign: int) -> DataFrame:
        joined = p.select("series_id", "ds", "y").join(s, ["series_id", "ds"], "left")
        later = F.sum(F.coalesce("_d", F.lit(0.0))).over(S().orderBy(F.col("ds").desc()).rowsBetween(Window.unboundedPreceding, 0))
        return joined.withColumn("y", Y("y") - sign * later).select("series_id", "ds", "y")

    return Transformer(fit, lambda p, s: moved(p, s, 1), lambda p, s, mode="forecast": p if mode == "forecast" else moved(p, s, -1))


TRANSFORMERS: dict[str, Callable[..., Transformer]] = {
    "none": lambda: pointwise(lambda: {"n": F.count("y")}, lambda: Y("y"), lambda: Y("y")),
    "standard": lambda: scaler_of("mean", "std"),
    "min_max": lambda: scaler_of("min", "range"),
    "max_abs": lambda: scaler_of("zero", "max"),
    "robust": lambda: scaler_of("median", "iqr"),
    "positive_shift": positive_shift,
    "log": lambda: positive_shift(log=True),
    "clip_outliers": clip_outliers,
    "remove_outliers": lambda k=4.0: clip_outliers(k, "remove"),
    "round": rounding,
    "detrend": detrend,
    "detrend_through_origin": lambda phi=1.0: detrend(False, phi),
    "intermittent": intermittent,
    "discretize": discretize,
    "center_last": center_last,
    "shift_first": shift_first,
    "seasonal_difference": seasonal_difference,
    "mean_difference": mean_difference,
    "rolling_mean": rolling_mean,
    "mu_law": lambda: companding("mu"),
    "a_law": lambda: companding("A"),
    "align_last": align_last,
    "align_last_diff": align_last_diff,
    "replace_constant": replace_constant,
    "level_shift": level_shift,
    "difference": lambda: ordered(_ends, lambda: F.coalesce(Y("y") - _lag(), F.lead("y").over(T()) - Y("y")), lambda: Y("_last") + _sum("y"), lambda: Y("_first") + _sum(Y("y")) - F.first("y").over(T())),
    "cumsum": lambda: ordered(lambda: {"first": F.min_by("y", "ds"), "last": F.sum("y")}, lambda: _sum("y"), lambda: Y("y") - F.coalesce(_lag(), Y("_last")), lambda: Y("y") - F.coalesce(_lag(), F.lit(0.0))),
    "pct_change": lambda: ordered(
        lambda: {"first": F.min_by("y", "ds"), "last": F.max_by("y", "ds"), "least": F.min(F.nullif(F.abs("y"), F.lit(0.0)))},
        lambda: F.coalesce(_zeros_replaced() / F.lag(_zeros_replaced()).over(T()) - 1, F.lit(0.0)),
        lambda: F.coalesce(F.nullif("_last", F.lit(0.0)), Y("_least"), F.lit(0.1)) * _product(1 + Y("y")),
        lambda: F.coalesce(F.nullif("_first", F.lit(0.0)), Y("_least"), F.lit(0.1)) * _product(1 + Y("y")),
    ),
}


def transformer(name: str, **params) -> Transformer:
    if name not in TRANSFORMERS:
        from . import transform_models

        return transform_models.TRANSFORMERS[name](**params)
    return TRANSFORMERS[name](**params)


def transform(panel: DataFrame, name: str, **params) -> DataFrame:
    """Fit and apply: series_id, ds and the transformed y."""
    t = transformer(name, **params)
    return t.apply(panel, t.fit(panel))


@dataclass
class Pipeline:
    """Filling, then transformers one after another; the inverse goes through them backwards.

    steps: (name, parameters); `fitted` holds each one's parameters after `fit_apply`. Numbered
    steps of a JSON pipeline are put in the order of their numbers. `cut` is given what each step
    makes and writes it, so that no step is computed anew by all that follow and no task holds the
    sorts of more than one.
    """

    steps: list[tuple[str, dict]]
    fill: str | None = "ffill"
    cut: Callable[[DataFrame], DataFrame] = cut

    @classmethod
    def of(cls, said: dict) -> Pipeline:
        names, params = said.get("transformations", {}), said.get("transformation_params", {})
        order = sorted(names, key=int)
        return cls([(names[k], params.get(k) or {}) for k in order], said.get("fillna"))

    def fit_apply(self, panel: DataFrame) -> DataFrame:
        self.fitted = []
        out = self.cut(impute(panel, self.fill)) if self.fill else panel
        for name, params in self.steps:
            t = transformer(name, **params)
            found = t.fit(out)
            found = self.cut(found) if isinstance(found, DataFrame) else found
            self.fitted.append((t, found))
            out = self.cut(t.apply(out, found))
        return out

    def invert(self, values: DataFrame, mode: str = "forecast") -> DataFrame:
        return reduce(lambda df, x: self.cut(x[0].invert(df, x[1], mode)), reversed(self.fitted), values)


def slice_tail(panel: DataFrame, n: int) -> DataFrame:
    """The last n rows of each series; Spark keeps only candidates of each partition."""
    return panel.withColumn("_r", _rank()).where(F.col("_r") <= n).drop("_r")


def context_slice(panel: DataFrame, method, horizon: int) -> DataFrame:
    """The tail that a method names: None, HalfMax, `n`ForecastLength, a number of rows, -n (all
    but the first n) or a share below 1."""
    if method in (None, "None", "none"):
        return panel
    text = str(method)
    held = panel.withColumns({"_r": _rank(), "_n": F.count("*").over(S())})
    if text.lower() == "halfmax":
        keep = F.ceil(Y("_n") / 2)
    elif "forecastlength" in text.lower():
        keep = F.lit(int("".join(c for c in text if c.isdigit()) or 1) * horizon)
    elif 0 < float(text) < 1:
        keep = F.ceil(Y("_n") * float(text))
    else:
        keep = F.lit(int(float(text))) if float(text) > 0 else Y("_n") + int(float(text))
    return held.where(Y("_r") <= keep).drop("_r", "_n")


def undo_difference(changes: DataFrame, last: DataFrame) -> DataFrame:
    """Forecast of differences (series_id, step, y) on from the last value (series_id, last)."""
    running = F.sum("y").over(S().orderBy("step").rowsBetween(Window.unboundedPreceding, 0))
    return changes.withColumn("y", running).join(last, "series_id").select("series_id", "step", (F.col("y") + F.col("last")).alias("y"))
