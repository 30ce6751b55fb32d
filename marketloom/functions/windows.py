"""Window helpers for time series: one row per (symbol, ts)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def series(*keys: str, order: str = "ts") -> WindowSpec:
    return Window.partitionBy(*(keys or ("symbol",))).orderBy(order)


def last_rows(n: int, *keys: str, order: str = "ts") -> WindowSpec:
    """The present row and the n - 1 before it."""
    return series(*keys, order=order).rowsBetween(1 - n, 0)


def up_to_now(*keys: str, order: str = "ts") -> WindowSpec:
    return series(*keys, order=order).rowsBetween(Window.unboundedPreceding, 0)


def gated(value: Column, counted: Column | str, over: WindowSpec, n: int) -> Column:
    """The value where n rows of the window are there, else null."""
    return F.when(F.count(counted).over(over) >= n, value)


def rolling_mean(c: str, n: int, *keys: str, least: int | None = None) -> Column:
    w = last_rows(n, *keys)
    return gated(F.avg(c).over(w), c, w, n if least is None else least)


def rolling_z(value: Column, counted: str, n: int = 60, least: int = 10, *keys: str) -> Column:
    """(x - mean) / sample deviation over the last n rows, of which least must be there; 0 where that is undefined."""
    w = last_rows(n, *keys)
    deviation = F.nullif(F.stddev_samp(value).over(w), F.lit(0.0))
    return F.coalesce(gated((value - F.avg(value).over(w)) / deviation, counted, w, least), F.lit(0.0))


def growth(returns: Column, over: WindowSpec) -> Column:
    """Running product of 1 + r; 0 from a total loss on."""
    lost = F.max((returns <= -1).cast("int")).over(over) == 1
    logs = F.sum(F.when(returns > -1, F.log1p(returns)).otherwise(0.0)).over(over)
    return F.when(lost, 0.0).otherwise(F.exp(logs))


def forward_filled(c: str, over: WindowSpec) -> Column:
    return F.last(c, ignorenulls=True).over(over)


def change(c: str, n: int, over: WindowSpec) -> Column:
    """x / x n rows before - 1, null where that is missing or zero."""
    return F.try_divide(F.col(c), F.lag(c, n).over(over)) - 1


def _joined(parts: DataFrame, whole: DataFrame, keys: list[str]) -> DataFrame:
    """Left join in which null keys are equal."""
    if not keys:
        return parts.join(whole, F.lit(True), "left")
    named = whole.select(*(F.col(k).alias(f"__{i}") for i, k in enumerate(keys)), *(c for c in whole.columns if c not in keys))
    on = [F.col(k).eqNullSafe(F.col(f"__{i}")) for i, k in enumerate(keys)]
    return parts.join(named, on, "left").drop(*(f"__{i}" for i in range(len(keys))))


def running(rows: DataFrame, keys: list[str], values: dict[str, tuple[Callable, Column]], order: str = "ts", unit: str = "month") -> DataFrame:
    """Rows with running aggregates in the order of an instant: name -> (F.sum, F.max, F.min or F.last, value).

    Instants are cut in calendar units. Only one row a unit stands in a window over all time, and
    instants in one over their own unit, so that no task gets all instants of a key, or of the table
    where there are no keys. F.last carries the last value that is not null forward.
    """
    combine = lambda f, c, w: (F.last(c, ignorenulls=True) if f is F.last else f(c)).over(w)
    cut = rows.withColumn("__unit", F.date_trunc(unit, order)).withColumns({f"__v_{n}": v for n, (_, v) in values.items()})
    within = Window.partitionBy(*keys, "__unit").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    inner = cut.withColumns({f"__i_{n}": combine(f, f"__v_{n}", within) for n, (f, _) in values.items()})
    ends = {n: F.max_by(F.when(F.col(f"__v_{n}").isNotNull(), F.col(f"__v_{n}")), F.when(F.col(f"__v_{n}").isNotNull(), F.col(order))) if f is F.last else f(f"__v_{n}") for n, (f, _) in values.items()}
    units = cut.groupBy(*keys, "__unit").agg(*(e.alias(f"__u_{n}") for n, e in ends.items()))
    earlier = Window.partitionBy(*keys).orderBy("__unit").rowsBetween(Window.unboundedPreceding, -1)
    units = units.select(*keys, "__unit", *(combine(f, f"__u_{n}", earlier).alias(f"__b_{n}") for n, (f, _) in values.items()))
    both = _joined(inner, units, [*keys, "__unit"])

    def total(n: str, f: Callable) -> Column:
        inside, prior = F.col(f"__i_{n}"), F.col(f"__b_{n}")
        if f is F.last:
            return F.coalesce(inside, prior)
        if f is F.sum:
            return F.when(inside.isNotNull() & prior.isNotNull(), inside + prior).otherwise(F.coalesce(inside, prior))
        return (F.greatest if f is F.max else F.least)(inside, prior)

    out = both.withColumns({n: total(n, f) for n, (f, _) in values.items()})
    return out.drop("__unit", *(f"__{k}_{n}" for n in values for k in "vib"))
