"""Percentiles by brackets are the exact ones."""

import pytest
from pyspark.sql import functions as F

from cadastra.operators import impute

SHARES = [0.0, 0.01, 0.25, 0.5, 0.505, 0.99, 1.0]


@pytest.mark.parametrize("accuracy", [50, 100_000])
def test_percentiles_are_exact(spark, accuracy):
    """Hot group, ties, negative values, a small group, a group of nulls, a null key."""
    df = spark.range(20_000).select(
        F.when(F.col("id") % 3 < 2, "hot").when(F.col("id") % 300 == 2, "rare").when(F.col("id") % 300 == 5, "none").when(F.col("id") % 3 == 2, F.lit(None)).alias("k"),
        F.when(F.col("id") % 300 != 5, F.when(F.col("id") % 5 == 0, 7.0).otherwise((F.pmod(F.xxhash64("id"), F.lit(9973)) - 4000) / 7)).alias("x"),
    )
    exact = lambda *keys: {tuple(r)[:-1]: r[-1] for r in df.groupBy(*keys).agg(F.percentile("x", F.array(*map(F.lit, SHARES))).alias("q")).collect()}
    ours = lambda keys: {tuple(r)[:-1]: r[-1] for r in impute.percentiles(df, keys, "x", SHARES, "q", accuracy).collect()}
    assert ours([]) == exact()
    wanted = exact("k")
    assert wanted[("none",)] is None and ours(["k"]) == {**wanted, ("none",): [None] * len(SHARES)}


def test_percentiles_of_nothing(spark):
    empty = spark.createDataFrame([], "k string, x double")
    assert impute.percentiles(empty, ["k"], "x", [0.5], "q").collect() == []
    assert [r.m for r in impute.group_medians(empty, [], "x", "m").collect()] in ([], [None])
