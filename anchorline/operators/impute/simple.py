"""Fill missing values with one number per column."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from anchorline.functions.ordered import exact_quantiles
from anchorline.operators.impute.grouped import GROUP, group_number, group_values
from anchorline.operators.quality import melt


@dataclass
class Constants:
    """One value per group and column; null where a column has no known cell."""

    columns: list[str]
    by: str | None
    values: list
    found: Mapping[tuple[int, str], object]

    def fill(self, df: DataFrame) -> DataFrame:
        """Coalesce every column with its value. Rows not seen in the fit are filled alike. Narrow."""
        number = group_number(self.by, self.values)

        def filled(c: str):
            each = [self.found.get((g, c)) for g in range(len(self.values))]
            if all(v is None for v in each):
                return F.col(c)
            value = F.lit(each[0]) if self.by is None else F.get(F.array(*map(F.lit, each)), number)
            return F.coalesce(F.col(c), value).alias(c)

        return df.select(*[filled(c) if c in self.columns else F.col(c) for c in df.columns])


def _grouped(df: DataFrame, columns: Sequence[str], by: str | None) -> tuple[DataFrame, list]:
    values = group_values(df, by)
    return df.select(group_number(by, values).alias(GROUP), *columns), values


def fit_mean(df: DataFrame, columns: Sequence[str], by: str | None = None) -> Constants:
    rows, values = _grouped(df, columns, by)
    found = rows.groupBy(GROUP).agg(*[F.avg(c).alias(c) for c in columns]).collect()
    return Constants(list(columns), by, values, {(r[GROUP], c): r[c] for r in found for c in columns})


def fit_median(df: DataFrame, columns: Sequence[str], by: str | None = None) -> Constants:
    rows, values = _grouped(df, columns, by)
    found = exact_quantiles(melt(rows, columns, keep=[GROUP]), [GROUP, "column_name"], "value", {"median": 0.5})
    return Constants(list(columns), by, values, {(r[GROUP], r["column_name"]): r["median"] for r in found.collect()})


def fit_mode(df: DataFrame, columns: Sequence[str], by: str | None = None) -> Constants:
    rows, values = _grouped(df, columns, by)
    return Constants(list(columns), by, values, {(r[GROUP], r["column_name"]): r["mode"] for r in modes(rows, columns, [GROUP]).collect()})


def impute_mean(df: DataFrame, columns: Sequence[str], by: str | None = None) -> DataFrame:
    return fit_mean(df, columns, by).fill(df)


def impute_median(df: DataFrame, columns: Sequence[str], by: str | None = None) -> DataFrame:
    return fit_median(df, columns, by).fill(df)


def modes(df: DataFrame, columns: Sequence[str], group: Sequence[str] = ()) -> DataFrame:
    """The most frequent value per column, the smallest one on a tie; the columns share one type."""
    keys = [*group, "column_name"]
    counts = (
        df.select(*group, *columns)
        .unpivot(list(group), list(columns), "column_name", "value")
        .where(F.col("value").isNotNull())
        .groupBy(*keys, "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    best = F.min(F.struct((-F.col("n")).alias("n"), "value"))
    return counts.groupBy(*keys).agg(best["value"].alias("mode"))


def impute_mode(df: DataFrame, columns: Sequence[str], by: str | None = None) -> DataFrame:
    return fit_mode(df, columns, by).fill(df)
