"""Deduplication: strict, by keys, masked, and against a history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def strict(df: DataFrame) -> DataFrame:
    """One of each set of identical rows."""
    return df.dropDuplicates()


def keep_first(df: DataFrame, keys: list[Column], order: list[Column], exempt: Column | None = None) -> DataFrame:
    """The first row of each key by `order`; rows for which `exempt` holds all stay."""
    turn = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    keep = F.col("_turn") == 1
    return df.withColumn("_turn", turn).filter(keep if exempt is None else keep | exempt).drop("_turn")


def unseen(df: DataFrame, history: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys the history does not hold."""
    return df.join(history.select(*keys).distinct(), keys, "left_anti")


def normal(c: Column) -> Column:
    """A text as key: trimmed and lower-cased; blank as null."""
    return F.nullif(F.lower(F.trim(c)), F.lit(""))
