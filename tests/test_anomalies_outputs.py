"""Isolation forests by a plain re-implementation, nearest texts by brute force, growing and committed outputs."""

from __future__ import annotations

import collections
import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadastra.operators import forest
from cadastra.sources import sinks


def plain_tree(rows, rng, limit, depth=0):
    """Preorder, as dictionaries, one row at a time."""
    varied = [c for c in range(len(rows[0])) if max(r[c] for r in rows) > min(r[c] for r in rows)] if len(rows) > 1 else []
    if depth >= limit or not varied:
        n = len(rows)
        return {"path": depth + (0 if n <= 1 else 1 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n)}
    c = int(rng.choice(varied))
    at = float(rng.uniform(min(r[c] for r in rows), max(r[c] for r in rows)))
    low, high = [r for r in rows if r[c] < at], [r for r in rows if r[c] >= at]
    return {"c": c, "at": at, "low": plain_tree(low, rng, limit, depth + 1), "high": plain_tree(high, rng, limit, depth + 1)}


def plain_path(tree, row):
    while "path" not in tree:
        tree = tree["low"] if row[tree["c"]] < tree["at"] else tree["high"]
    return tree["path"]


def plain_scores(rows, trees):
    """rows: (id, values); values standardised by the group's mean and deviation."""
    x = np.array([v for _, v in rows])
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    turn = {i: int(hashlib.md5(str(i).encode()).hexdigest()[:8], 16) / 4294967296.0 for i, _ in rows}
    order = sorted(range(len(rows)), key=lambda k: (turn[rows[k][0]], *z[k]))[: forest.SAMPLED]
    sample, size = z[order], min(forest.SAMPLE, len(order))
    total = np.zeros(len(rows))
    for t in range(trees):
        rng = np.random.default_rng([42, t])
        tree = plain_tree([tuple(r) for r in sample[rng.choice(len(sample), size, replace=False)]], rng, math.ceil(math.log2(max(2, size))))
        total += [plain_path(tree, r) for r in z]
    norm = 2 * (math.log(size - 1) + 0.5772156649) - 2 * (size - 1) / size
    return {rows[k][0]: 2.0 ** -(total[k] / trees / norm) for k in range(len(rows))}


@pytest.mark.parametrize("parts", [1, 7])
def test_scores_of_a_plain_forest(spark, parts):
    rng = np.random.default_rng(0)
    data = [(i, "hot" if i % 3 else "rare", float(rng.normal(0, 1 + 20 * (i % 97 == 0))), float(rng.exponential())) for i in range(2400)]
    data += [(9000 + i, "few", float(i), 1.0) for i in range(20)] + [(9100, "hot", None, 1.0), (9101, None, 1.0, 2.0)]
    df = spark.createDataFrame(data, "i long, g string, a double, b double").repartition(parts)
    kept = {r["i"]: r["score"] for r in forest.inliers(df, ["g"], ["a", "b"], ["i"], 0.04, trees=20).collect()}
    assert kept.keys() >= set(range(9000, 9020)) | {9100, 9101} and all(kept[k] is None for k in (*range(9000, 9020), 9100, 9101))
    for g in ("hot", "rare"):
        own = [(i, (a, b)) for i, name, a, b in data if name == g and a is not None]
        scores = plain_scores(own, 20)
        cut = np.quantile(list(scores.values()), 0.96)
        wanted = {i: s for i, s in scores.items() if s <= cut + 1e-12}
        found = {i: kept[i] for i in scores if i in kept}
        assert found.keys() == wanted.keys() and all(math.isclose(found[i], round(s, 6), abs_tol=2e-6) for i, s in wanted.items())


def test_blocks_of_forests_and_clashing_columns(spark, monkeypatch):
    data = [(i, i % 5, float(i * i % 101), float(i % 7)) for i in range(600)]
    df = spark.createDataFrame(data, "i long, key int, a double, z double")
    rows = lambda: sorted(map(tuple, forest.inliers(df, ["key"], ["a", "z"], ["i"], 0.1, trees=5).collect()))
    once = rows()
    monkeypatch.setattr(forest, "FOREST_BYTES", 1000)
    assert rows() == once and 500 < len(once) < 600
    assert forest.inliers(df.filter("i < 0"), ["key"], ["a"], ["i"], 0.1, trees=5).count() == 0


def test_variants(spark):
    data = [(i, "big" if i < 900 else "mid" if i < 1100 else "low", float(i * 37 % 1000), None if i % 10 == 0 else float(i % 13)) for i in range(1120)]
    df = spark.createDataFrame(data, "i long, g string, a double, b double")
    out = forest.trimmed_or_inliers(df, ["g"], ["a", "b"], ["i"], 0.05, large=500, trees=10).collect()
    kept = collections.Counter(r["g"] for r in out)
    assert kept["low"] == 20 and 190 <= kept["mid"] < 200 and kept["big"] == 900 - 41  # what is above the 95th percentile of the 810 whole rows
    mid = [(a, b) for _, g, a, b in data if g == "mid"]
    low, high = np.quantile([a for a, _ in mid], [0.01, 0.99])
    assert {r["a"] for r in out if r["g"] == "mid"} <= {a for a, _ in mid if low <= a <= high}
    filled = forest.inliers(df, ["g"], ["a", "b"], ["i"], 0.02, trees=10, standardise=False, fill=True)
    assert filled.filter("score IS NULL").select("g").distinct().collect() == [("low",)] and filled.filter("g = 'big'").count() == 882


@pytest.mark.parametrize("block", [16 << 20, 500])
def test_nearest_texts_by_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(forest, "QUERY_BYTES", block)
    rng = np.random.default_rng(2)
    x = np.round(rng.normal(size=(120, 4)), 2)
    x[60:70] = x[3]  # ties
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [0.0] * 4)], "doc_id long, vector array<double>").repartition(5)
    found = collections.defaultdict(list)
    for r in forest.nearest_texts(df, df.filter("doc_id % 2 = 1 OR doc_id = 900"), 6).orderBy("doc_id", "rank").collect():
        found[r["doc_id"]].append(r["other"])
    rows = {i: v for i, v in enumerate(x)} | {901: np.zeros(4)}
    wanted = {i: sorted((j for j in rows if j != i), key=lambda j: (-round(float(rows[i] @ rows[j]), 12), j))[:6] for i in rows if i % 2}
    assert found == wanted


def test_no_texts(spark):
    empty = spark.createDataFrame([], "doc_id long, vector array<double>")
    assert forest.nearest_texts(empty, empty).count() == 0


def test_flat_and_grown(spark, tmp_path):
    df = spark.createDataFrame([(1, "x", {"a": 1}, ((2.5, ["p", "q"]), "in\r\n\nner"), [1, 2], "a\nb")], "i int, meta_u string, m map<string,int>, s struct<v: struct<w: double, l: array<string>>, u: string>, n array<int>, t string")
    out = sinks.flat(df)
    assert out.first().asDict() == {"i": 1, "meta_u": "x", "m": '{"a":1}', "meta_w": 2.5, "meta_l": "p, q", "meta_s_u": "in ner", "n": "1, 2", "t": "a b"}
    for batch in (out.select("i"), out.select("t", "i"), out.select("meta_w")):
        sinks.append_run(batch, f"{tmp_path}/g")
    assert sorted(map(str, sinks.grown(spark, f"{tmp_path}/g").select("i", "t", "meta_w").collect())) == sorted(map(str, spark.createDataFrame([(1, None, None), (1, "a b", None), (None, None, 2.5)], "i int, t string, meta_w double").collect()))
    assert [r["i"] for r in sinks.history(spark, f"{tmp_path}/g", "i", 2).collect()] == [1, 1]


def test_a_writer_that_breaks_off_shows_nothing(spark, tmp_path):
    path = f"{tmp_path}/book"
    assert sinks.sheets(spark, path) == {}
    first, broken = spark.range(3), spark.range(3).select(F.raise_error(F.lit("killed")).alias("x"))
    with pytest.raises(Exception, match="killed"):
        sinks.commit_sheets({"a": first, "b": broken}, path)
    assert sinks.sheets(spark, path) == {}
    sinks.commit_sheets({"a": first, "b": spark.range(5)}, path)
    with pytest.raises(Exception, match="killed"):
        sinks.commit_sheets({"a": spark.range(9), "b": broken}, path)
    assert {n: df.count() for n, df in sinks.sheets(spark, path).items()} == {"a": 3, "b": 5}
    sinks.commit_sheets({"c": spark.range(1)}, path)
    assert list(sinks.sheets(spark, path)) == ["c"]
