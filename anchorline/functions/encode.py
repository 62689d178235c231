"""Column encodings and column naming."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

# fixed values: category -> indicator column
ETHNICITIES = {
    "WHITE": "ethnicity_WHITE",
    "BLACK/AFRICAN AMERICAN": "ethnicity_BLACK",
    "UNKNOWN": "ethnicity_UNKNOWN",
    "OTHER": "ethnicity_OTHER",
    "HISPANIC/LATINO": "ethnicity_HISPANIC",
    "ASIAN": "ethnicity_ASIAN",
    "UNABLE TO OBTAIN": "ethnicity_UNABLE_TO_OBTAIN",
    "AMERICAN INDIAN/ALASKA NATIVE": "ethnicity_AMERICAN_INDIAN",
}


def encode_binary(column: str, positive: str) -> Column:
    """1 for the positive value, 0 for anything else and for null."""
    return F.when(F.col(column) == positive, 1).otherwise(0)


def one_hot(df: DataFrame, column: str, categories: Mapping[str, str] = ETHNICITIES) -> DataFrame:
    """One indicator per listed category, source column dropped; unlisted values are 0 everywhere."""
    return df.select(
        *[c for c in df.columns if c != column],
        *[encode_binary(column, value).alias(name) for value, name in categories.items()],
    )


def add_suffix(df: DataFrame, suffix: str, keep: Sequence[str] = ()) -> DataFrame:
    return df.select([F.col(c) if c in keep else F.col(c).alias(c + suffix) for c in df.columns])


def sanitize_names(df: DataFrame) -> DataFrame:
    """Keep letters, digits and underscores of every column name; a collision is an error."""
    clean = [re.sub(r"\W", "", c, flags=re.ASCII) for c in df.columns]
    repeated = sorted({c for c in clean if clean.count(c) > 1})
    if repeated:
        raise ValueError(f"column names collide once cleaned: {repeated}")
    return df.toDF(*clean)


def merge_on(frames: Sequence[DataFrame], key: str) -> DataFrame:
    """Inner merge of frames whose other columns are already distinct."""
    return reduce(lambda left, right: left.join(right, key), frames)


def binarize(probability: Column | str, threshold: float = 0.5) -> Column:
    """0 below the threshold, 1 from it on."""
    p = F.col(probability) if isinstance(probability, str) else probability
    return F.when(p < threshold, 0).otherwise(1)


def rowwise_max(columns: Sequence[str]) -> Column:
    """Largest of the columns, nulls skipped."""
    return F.greatest(*columns) if len(columns) > 1 else F.col(columns[0])
