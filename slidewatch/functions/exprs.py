"""Column expressions of the growth model. All are built-in functions, so they stay inside code generation."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slidewatch.settings import (
    MONTHS_PER_YEAR,
    OPEN_BANDS,
    REVENUE_PER_CONVERSION,
    BandRule,
)


# Sentence parts of the generated texts.
SLIDING_TEXT = "Conversion sliding since the checkout change; a proven variant may recover it."
HEALTHY_TEXT = "Funnel healthy, converting to plan."
WON_TEXT = "WON: lifted conversion by %s points. A proven variant to replicate for similar cohorts."
LOST_TEXT = "Did not lift conversion; not recommended."
EXPERIMENT_TEXT = "Experiment on the %s flow, %s, tested on %s / %s. %s"
SEGMENT_TEXT = "%s cohort on %s in %s . %s"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def format_id(prefix: str, number: Column | str, width: int) -> Column:
    """``prefix`` and the zero-padded number; longer numbers keep all digits (``lpad`` would cut them)."""
    return F.format_string(f"{prefix}%0{width}d", col(number))


def in_set(value: Column | str, members: Iterable) -> Column:
    return col(value).isin(list(members))


def pick(members: Sequence, index: Column) -> Column:
    """Entry of a short fixed list by zero-based position."""
    return F.element_at(F.array(*[F.lit(m) for m in members]), (index + 1).cast("int"))


def case_assign(pairs: Sequence[tuple[Column, object]], default: object) -> Column:
    """First matching condition wins."""
    (first_cond, first_value), *rest = pairs
    out = F.when(first_cond, _value(first_value))
    for cond, value in rest:
        out = out.when(cond, _value(value))
    return out.otherwise(_value(default))


def _value(v: object) -> Column:
    return v if isinstance(v, Column) else F.lit(v)


def segment_summary(cohort: Column, platform: Column, region: Column, affected: Column) -> Column:
    state = F.when(affected, F.lit(SLIDING_TEXT)).otherwise(F.lit(HEALTHY_TEXT))
    return F.format_string(SEGMENT_TEXT, cohort, platform, region, state)


def experiment_name(area: Column, variant: Column, cohort: Column) -> Column:
    return F.concat(F.initcap(area), F.lit(" "), variant, F.lit(" ["), cohort, F.lit("]"))


def experiment_description(
    area: Column, variant: Column, cohort: Column, platform: Column, won: Column, lift: Column
) -> Column:
    points = F.round(lift * 100, 2).cast("string")
    result = F.when(won, F.format_string(WON_TEXT, points)).otherwise(F.lit(LOST_TEXT))
    return F.format_string(EXPERIMENT_TEXT, area, variant, cohort, platform, result)


def days_before(anchor: Column, n: Column) -> Column:
    return F.date_sub(anchor, n.cast("int"))


def ramp(days_ago: Column, n_days: int, start: float, delta: float) -> Column:
    """Linear value over a window of ``n_days``: ``start`` at the oldest day, ``start + delta`` today."""
    last = max(n_days - 1, 1)
    fraction = (F.lit(n_days - 1) - days_ago) / F.lit(float(last))
    return F.round(F.lit(start) + fraction * F.lit(delta), 4)


def conversion_drop(baseline: Column | str, current: Column | str) -> Column:
    """Rounded to four places before it is banded, so that float noise cannot cross a threshold."""
    return F.round(col(baseline) - col(current), 4)


def conv_band(drop: Column | str, rate: Column | str, rule: BandRule = BandRule()) -> Column:
    drop, rate = col(drop), col(rate)
    return (
        F.when((drop >= rule.sliding_drop) & (rate < rule.sliding_rate), F.lit("sliding"))
        .when(drop >= rule.watch_drop, F.lit("watch"))
        .otherwise(F.lit("healthy"))
    )


def at_risk(
    mau: Column | str, drop: Column | str, band: Column | str, per_conversion: float = REVENUE_PER_CONVERSION
) -> Column:
    annual = col(mau) * col(drop) * F.lit(per_conversion) * F.lit(MONTHS_PER_YEAR)
    return F.when(col(band).isin(OPEN_BANDS), annual).otherwise(F.lit(0.0))


def net_value(
    lift: Column | str, mau: Column | str, cost: Column | str, per_conversion: float = REVENUE_PER_CONVERSION
) -> Column:
    return col(lift) * col(mau) * F.lit(per_conversion) * F.lit(MONTHS_PER_YEAR) - col(cost)


def rollout_forecast(current: Column | str, lift: Column | str, pct: Column | str) -> Column:
    return col(current) + col(lift) * (col(pct) / F.lit(100.0))


def percentage(numerator: Column | str, denominator: Column | str, places: int = 1) -> Column:
    """``numerator`` as a percentage of ``denominator``; 0 where the denominator is not positive."""
    num = F.coalesce(col(numerator).cast("double"), F.lit(0.0))
    den = F.coalesce(col(denominator).cast("double"), F.lit(0.0))
    return F.when(den > 0, F.round(num * 100.0 / den, places)).otherwise(F.lit(0.0))


def count_if(condition: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, F.lit(1)).otherwise(F.lit(0))), F.lit(0)).cast("long")


def bounded(n: int, maximum: int) -> int:
    return min(max(int(n), 1), maximum)


NUMERIC_TEXT = r"^-?\d+(\.\d+)?$"


def coerce_numeric(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Text cells that are clean numbers become doubles in ``<column>_num``; all other cells give null there."""
    return df.withColumns(
        {f"{c}_num": F.when(F.col(c).rlike(NUMERIC_TEXT), F.col(c).try_cast("double")) for c in columns}
    )
