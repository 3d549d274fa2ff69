"""Automaton and grid lookups against all pairs, and their plans."""

from __future__ import annotations

import datetime
import math
import random

import pytest
from pyspark.sql import functions as F

from cadastra.operators import lookup
from cadastra.operators.nearby import k_nearest
from cadastra.streaming import ingest


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def first_of(value, rows, exact_first):
    if not value:
        return None
    hits = [(exact_first and k != value, o, k, t) for o, k, t in rows if k is not None and (value.startswith(k) or k.startswith(value) or k in value)]
    return min(hits)[3] if hits else None


@pytest.mark.parametrize("exact_first", [True, False])
@pytest.mark.parametrize("bound", [16 << 20, 400])
def test_first_contained_by_all_pairs(spark, monkeypatch, exact_first, bound):
    monkeypatch.setattr(lookup, "AUTOMATON_BYTES", bound)
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abé ") for _ in range(rng.randint(1, n)))
    rows = [(rng.randint(0, 30), word(4), f"t{i}") for i in range(60)] + [(3, None, "none"), (40, "", "any")]
    values = [(word(7),) for _ in range(400)] + [(None,), ("",), ("zz",)]
    dim = spark.createDataFrame(rows, "o int, k string, t string")
    out = lookup.first_contained(spark.createDataFrame(values, "v string"), "v", dim, "k", "o", "t", exact_first)
    found = {(r["v"], r["t"]) for r in out.collect()}
    assert {v for v, _ in found} == {v for (v,) in values}
    assert found == {(v, first_of(v, rows, exact_first)) for (v,) in values}


def test_a_hundred_thousand_keys(spark):
    dim = spark.range(100_000).select(F.col("id").alias("o"), F.format_string("key%06d", "id").alias("k"), F.md5(F.col("id").cast("string")).alias("t"))
    df = spark.range(5000).select(F.format_string("in key%06d and key%06d", F.col("id") * 19, F.col("id") * 7).alias("v"), "id")
    out = lookup.first_contained(df, "v", dim, "k", "o", "t")
    assert "NestedLoop" not in plan(out) and "Cartesian" not in plan(out) and "Exchange" not in plan(out)
    assert out.filter(F.col("t") != F.md5((F.col("id") * 7).cast("string"))).count() == 0 and out.filter("t IS NULL").count() == 0


@pytest.mark.parametrize("k", [1, 4])
@pytest.mark.parametrize("shape", ["even", "clusters", "line", "spot", "few"])
def test_nearest_places_by_all_pairs(spark, k, shape):
    rng = random.Random(7)
    n = 3 if shape == "few" else 300
    at = {"even": lambda: (rng.uniform(0, 9), rng.uniform(0, 4)), "clusters": lambda: (rng.choice([0, 50, 51]) + rng.gauss(0, 0.01), rng.choice([0, 90]) + rng.gauss(0, 0.01)), "line": lambda: (rng.randint(0, 40) / 4, 0.0), "spot": lambda: (1.0, 2.0), "few": lambda: (rng.uniform(0, 9), 1.0)}[shape]
    places = [(i, *at()) for i in range(n)] + [(-1, None, 1.0), (-2, float("nan"), 1.0)]
    points = {(round(x + rng.gauss(0, 0.5), 3), round(y + rng.gauss(0, 0.5), 3)) for x, y in [at() for _ in range(150)]} | {(1e5, -3.0), (-40.0, 7.0)}
    away = lambda x, y, a, b: math.sqrt((x - a) * (x - a) + (y - b) * (y - b))
    p = spark.createDataFrame([*points, (None, 1.0)], "x double, y double")
    d = spark.createDataFrame(places, "i int, a double, b double")
    c = F.col
    distance = F.sqrt((c("x") - c("a")) * (c("x") - c("a")) + (c("y") - c("b")) * (c("y") - c("b")))
    out = k_nearest(p, d, (c("x"), c("y")), (c("a"), c("b")), distance, ["i"], ["a", "b"], k=k)
    assert "NestedLoop" not in plan(out) and "Cartesian" not in plan(out)
    found = {(r["x"], r["y"]): r["near"] and [(round(q["distance"], 9), q["i"]) for q in r["near"]] for r in out.collect()}
    assert found.pop((None, 1.0)) is None and found.keys() == points
    for x, y in points:
        best = sorted((away(x, y, a, b), i) for i, a, b in places if i >= 0)[:k]
        assert found[x, y] == [(round(s, 9), i) for s, i in best]


def test_nearest_of_no_places(spark):
    p, d = spark.createDataFrame([(1.0, 2.0)], "x double, y double"), spark.createDataFrame([], "a double, b double")
    out = k_nearest(p, d, (F.col("x"), F.col("y")), (F.col("a"), F.col("b")), F.col("x") - F.col("a"), ["a"], ["b"])
    assert [tuple(r) for r in out.collect()] == [(1.0, 2.0, None)]


def test_neighbours_with_many_at_one_value(spark):
    rows = [(i, float(i % 3), float(i)) for i in range(200)] + [(900, 50.0, 1.0)]
    found = {r["k"]: r["estimate"] for r in lookup.neighbours_mean(spark.createDataFrame(rows, "k int, a double, v double"), "k", "a", "v").collect()}
    for k, a, _ in rows:
        best = sorted((max(abs(a - b), 1e-6), o, v) for o, b, v in rows if o != k)[:3]
        assert math.isclose(found[k], sum(v / d for d, _, v in best) / sum(1 / d for d, _, _ in best), rel_tol=1e-9)


def test_daily_counts_go_on_and_show_the_open_day(spark, tmp_path):
    source, out, state = (f"{tmp_path}/{x}" for x in ("in", "out", "state"))
    schema = spark.createDataFrame([], "ts timestamp, kind string").schema
    day = lambda d, h: datetime.datetime(2024, 1, d, h)
    run = lambda **more: {(r["day"].day, r["kind"]): r["n"] for r in ingest.daily_counts(spark, source, schema, "ts", "kind", out, state, **more).collect()}
    add = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
    add([])
    assert run() == {}
    add([(day(1, 1), "a"), (day(1, 2), "a"), (day(2, 1), "b")])
    assert run() == {(1, "a"): 2, (2, "b"): 1}
    assert run() == {(1, "a"): 2, (2, "b"): 1}
    add([(day(2, 5), "b"), (day(1, 9), "a"), (day(3, 1), None)])
    assert run(files=1) == {(1, "a"): 3, (2, "b"): 2, (3, None): 1}


def test_days_behind_the_watermark_are_closed(spark, tmp_path):
    source, out, state = (f"{tmp_path}/{x}" for x in ("in", "out", "state"))
    schema = spark.createDataFrame([], "ts timestamp, kind string").schema
    for d in (1, 9, 1, 9):
        spark.createDataFrame([(datetime.datetime(2024, 1, d, 3), "a")], schema).coalesce(1).write.mode("append").parquet(source)
        rows = ingest.daily_counts(spark, source, schema, "ts", "kind", out, state, late="2 days").collect()
    assert {(r["day"].day, r["n"]) for r in rows} == {(1, 1), (9, 2)}
