"""Golden cases of the expressions, and properties of the operators."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from cadastra.functions import dates, text
from cadastra.operators import dedup, forest, impute, lookup, scoring


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("raw, expected", [("1.234,5 TND", None), ("250 000 DT", 250000.0), ("", None), (None, None)])
def test_number(spark, raw, expected):
    assert value(spark, text.number(F.lit(raw).cast("string"))) == expected


@pytest.mark.parametrize("raw, expected", [("Béja   ville", "Bja ville"), ("é", None), (None, None)])
def test_strip_noise(spark, raw, expected):
    assert value(spark, text.strip_noise(F.lit(raw).cast("string"))) == expected


@pytest.mark.parametrize("raw, expected", [("s+2", 3), ("3 pièces", 3), ("studio", 1), ("triplex", 3), ("f4", 4), ("nothing", None)])
def test_rooms(spark, raw, expected):
    assert value(spark, text.rooms(F.lit(raw))) == expected


def test_dates(spark):
    at = F.lit("2026-02-20 00:00:00").cast("timestamp")
    assert value(spark, dates.relative(F.lit("2 months ago"), at).cast("string")) == "2025-12-22 00:00:00"
    assert value(spark, dates.from_path(F.lit("/uploads/2025/07/x.jpg")).cast("string")) == "2025-07-01 00:00:00"
    assert tuple(value(spark, dates.french_quarter(F.lit("deuxième-trimestre 2024")))) == (2024, 2)
    assert value(spark, dates.parse(F.lit("31/01/2024"))) == datetime(2024, 1, 31)
    assert value(spark, dates.parse(F.lit("soon"))) is None


@pytest.mark.parametrize("x, phase", [((2.5, 5, 7), "peak"), ((0.2, 5, 7), "stabilization"), ((-0.5, 8, 7), "recovery"), ((-2, 5, 7), "decline"), ((1, 6.5, 8), "growth")])
def test_market_cycle(spark, x, phase):
    assert value(spark, scoring.market_cycle(*[F.lit(float(v)) for v in x])) == phase


def test_decile_of_eleven(spark):
    rows = spark.range(11).select("id", scoring.decile("id", "id", []).alias("d")).orderBy("id").collect()
    assert [r["d"] for r in rows] == [0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 9]


def test_constant_minmax(spark):
    assert {r["s"] for r in scoring.minmax(spark.range(3).withColumn("x", F.lit(0.4)), "x", "s").collect()} == {0.4}


def test_inverse_frequency_has_mean_one(spark):
    w = scoring.inverse_frequency(spark.range(100).withColumn("k", F.col("id") % 7), "k", 5.0)
    assert w.agg(F.avg("weight")).first()[0] == pytest.approx(1.0)


def test_dedup_is_idempotent(spark):
    df = spark.createDataFrame([(1, "a"), (2, "A "), (3, None), (4, None), (5, "")], "i int, t string").withColumn("k", dedup.normal(F.col("t")))
    once = dedup.keep_first(df, [F.col("k")], [F.col("i")], F.col("k").isNull())
    assert sorted(r["i"] for r in once.collect()) == [1, 3, 4, 5]
    assert dedup.keep_first(once, [F.col("k")], [F.col("i")], F.col("k").isNull()).count() == 4


def test_first_contained_prefers_exact_then_order(spark):
    dim = spark.createDataFrame([(1, "tun", "x"), (2, "tunis", "y")], "o int, k string, g string")
    df = spark.createDataFrame([("tunis",), ("tunis nord",), ("",), (None,)], "v string")
    assert {r["v"]: r["g"] for r in lookup.first_contained(df, "v", dim, "k", "o", "g").collect()} == {"tunis": "y", "tunis nord": "x", "": None, None: None}


def test_seeded_steps_do_not_depend_on_partitions(spark):
    df = spark.range(200).select("id", F.when(F.col("id") % 3 > 0, F.col("id").cast("double")).alias("x"))
    runs = [sorted(map(tuple, impute.hot_deck(d, "id", "x", "s", "y").select("id", "y").collect())) for d in (df.repartition(1), df.repartition(7))]
    assert runs[0] == runs[1]


def test_forest_drops_planted_outliers(spark):
    rows = [(i, "g", float(i % 10), float(i % 7)) for i in range(300)] + [(1000 + i, "g", 500.0 + i, -300.0) for i in range(5)]
    kept = forest.inliers(spark.createDataFrame(rows, "i int, g string, a double, b double"), ["g"], ["a", "b"], ["i"], 0.04)
    assert not {r["i"] for r in kept.collect()} & set(range(1000, 1005))
