"""Scaling of matrix columns: one aggregate, one projection."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F


def _fit(df: DataFrame, columns: Sequence[str], makers: Mapping[str, Callable]) -> dict[str, dict[str, float | None]]:
    """One aggregate over the rows; its single row comes to the driver, like any fitted scaler."""
    row = df.agg(*[make(c).alias(f"{name}__{c}") for name, make in makers.items() for c in columns]).first()
    return {c: {name: row[f"{name}__{c}"] for name in makers} for c in columns}


MOMENTS = {"mean": F.avg, "sd": F.stddev_pop}
ENDS = {"low": F.min, "high": F.max}


def _standard(c: str, fitted: Mapping[str, float | None]) -> Column:
    sd = 1.0 if fitted["sd"] == 0 else fitted["sd"]
    return ((F.col(c) - F.lit(fitted["mean"])) / F.lit(sd)).cast("double")


def _minmax(c: str, fitted: Mapping[str, float | None]) -> Column:
    low, high = fitted["low"], fitted["high"]
    width = None if low is None or high == low else high - low
    return ((F.col(c) - F.lit(low)) / F.lit(width)).cast("double")


def _apply(df: DataFrame, columns: Sequence[str], form: Callable, fitted: Mapping[str, Mapping]) -> DataFrame:
    return df.select(*[form(c, fitted[c]).alias(c) if c in columns else F.col(c) for c in df.columns])


def standard_scale(df: DataFrame, columns: Sequence[str], fit_on: DataFrame | None = None) -> DataFrame:
    """(x - mean) / population deviation, missing values ignored and kept; a zero deviation counts as 1.

    ``fit_on`` takes the moments from other rows, for instance the training part.
    """
    return _apply(df, columns, _standard, _fit(df if fit_on is None else fit_on, columns, MOMENTS))


def standard_scale_all_but(df: DataFrame, key: str) -> DataFrame:
    return standard_scale(df, [c for c in df.columns if c != key])


def minmax_scale(df: DataFrame, columns: Sequence[str], fit_on: DataFrame | None = None) -> DataFrame:
    """(x - min) / (max - min); null where a column is constant."""
    return _apply(df, columns, _minmax, _fit(df if fit_on is None else fit_on, columns, ENDS))


@dataclass
class Scaling:
    """Moments or ends of every column, as fitted; ``how`` is standard, minmax or none."""

    how: str
    columns: list[str]
    fitted: dict[str, dict[str, float | None]]

    def apply(self, df: DataFrame) -> DataFrame:
        form = {"standard": _standard, "minmax": _minmax, "none": lambda c, _: F.col(c)}[self.how]
        return _apply(df, self.columns, form, self.fitted)


def fit_scale(df: DataFrame, columns: Sequence[str], how: str) -> Scaling:
    makers = {"standard": MOMENTS, "minmax": ENDS, "none": {}}[how]
    return Scaling(how, list(columns), _fit(df, columns, makers) if makers else {c: {} for c in columns})


def scale(df: DataFrame, columns: Sequence[str], how: str) -> DataFrame:
    return {"none": lambda d, c: d, "standard": standard_scale, "minmax": minmax_scale}[how](df, columns)


def all_scalings(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Unscaled, standardised and min-max form of every row, told apart by ``scaling``, in one pass."""
    fitted = _fit(df, columns, {**MOMENTS, **ENDS})
    forms = {"none": lambda c, _: F.col(c), "standard": _standard, "minmax": _minmax}
    rows = F.array(
        *[
            F.struct(F.lit(name).alias("scaling"), *[form(c, fitted[c]).alias(c) for c in columns])
            for name, form in forms.items()
        ]
    )
    return df.select(*keys, F.inline(rows))
