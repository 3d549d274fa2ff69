"""Steps on few large groups: no row of a large group is shuffled by its key; forests, vectors and nearest texts against plain versions."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadastra.functions import text
from cadastra.operators import forest, impute
from cadastra.plans import completed


@pytest.fixture
def shuffled(spark):
    """Joins shuffle unless a hint says otherwise."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    yield lambda df: df._jdf.queryExecution().executedPlan().toString().count("SortMergeJoin")
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def _rows(spark):
    return spark.range(4000).select("id", (F.col("id") % 3).alias("g"), F.when(F.col("id") % 10 > F.col("id") % 3 * 4, (F.col("id") * 37 % 1009).cast("double")).alias("x"))


def test_filled_forests_shuffle_no_rows(spark, shuffled):
    assert shuffled(forest.inliers(_rows(spark), ["g"], ["x", "id"], ["id"], 0.1, trees=3, standardise=False, fill=True)) == 0


def test_fences_shuffle_no_rows(spark, shuffled):
    out = impute.iqr_fences(_rows(spark).filter("x IS NOT NULL"), ["g"], "x")
    assert shuffled(out) <= 1  # of groups with groups
    assert out.count() == 3


def test_rate_tiers_shuffle_only_what_is_drawn(spark, shuffled):
    out = impute.rate_tiered(_rows(spark), "g", "id", "x", "s", "filled", most=0.6)
    assert shuffled(out.filter("x IS NOT NULL")) <= 2 and out.count() == 4000 and out.filter("filled IS NULL").count() == 0
    known = {r["x"] for r in _rows(spark).filter("g = 2 AND x IS NOT NULL").collect()}
    assert {r["filled"] for r in out.filter("g = 2 AND x IS NULL").collect()} <= known and out.filter("x IS NOT NULL AND x <> filled").count() == 0


def test_path_sums_of_mixed_forests():
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(3000, 3)), 1)
    arrays = lambda t: tuple(np.array(c, dtype=k) for c, k in zip(t, (np.int64, float, np.int64, np.int64), strict=True))
    forests = [[arrays(forest.grown(x[rng.choice(len(x), n, replace=False)], rng, limit)) for _ in range(4)] for n, limit in ((256, 8), (5, 3), (1, 1))]
    own = rng.integers(0, 3, len(x))

    def path(tree, row):
        column, at, left, right = tree
        n = 0
        while column[n] >= 0:
            n = left[n] if row[column[n]] < at[n] else right[n]
        return at[n]

    found = forest.path_sums(forest.levelled(forests), own, x)
    assert np.allclose(found, [sum(path(t, r) for t in forests[f]) for f, r in zip(own, x, strict=True)], rtol=0, atol=1e-12)


def test_text_vectors_by_a_plain_svd(spark):
    rng = np.random.default_rng(5)
    texts = [" ".join(rng.choice([f"w{i}" for i in range(40)], 12, p=(w := 1 / np.arange(1, 41)) / w.sum())) for _ in range(300)] + [None, "?", "w1"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    found = np.array([r["vector"] for r in forest.text_vectors(df, 6).orderBy("doc_id").collect()])
    grams = [[" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)] for w in ((t or "").replace("?", "").split() for t in texts)]
    shown = sorted({g for gs in grams for g in gs if sum(g in o for o in grams) >= 2})
    tf = np.array([[gs.count(g) for g in shown] for gs in grams], dtype=float)
    a = np.where(tf > 0, 1 + np.log(np.maximum(tf, 1)), 0) * np.log((len(texts) + 1) / ((tf > 0).sum(axis=0) + 1))
    a /= np.maximum(np.linalg.norm(a, axis=1, keepdims=True), 1e-300)
    y = a @ np.linalg.svd(a)[2][:6].T
    y /= np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-12)
    assert np.abs(found @ found.T - y @ y.T).max() < 1e-6


def test_nearest_of_many_copies(spark):
    """Of 3,000 equal vectors those with the smallest ids come first, in few comparisons."""
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.array(F.lit(0.6), F.lit(0.8)).alias("vector")).repartition(3)
    out = forest.nearest_texts(df, df.filter("doc_id % 50 = 0"), 3)
    found = {}
    for r in out.orderBy("doc_id", "rank").collect():
        found.setdefault(r["doc_id"], []).append(r["other"])
    assert found == {i: [j for j in range(5) if j != i][:3] for i in range(0, 3000, 50)}


def test_similar_documents_asks_for_each_fiftieth(spark, sf):
    rows = completed.similar_documents(spark, sf).groupBy("doc_id").count().collect() if hasattr(completed, "similar_documents") else []
    ids = {r[0] for r in spark.read.parquet(f"{sf}/documents.parquet").filter("doc_id % 50 = 0").select("doc_id").collect()}
    assert {r["doc_id"] for r in rows} == ids and {r["count"] for r in rows} == {10}


def test_keywords_in_plenty(spark):
    """Each part is measured once: the plan sums no slices again for each keyword."""
    t = "é tion, " * 500 + "x"
    found = spark.createDataFrame([(t,)], "t string").select(text.kwic(F.col("t"), "tion", 15, 50).alias("c"))
    starts = [i for i in range(len(t)) if t.startswith("tion", i)]
    assert found.first().c == [t[max(s - 15, 0) : max(s - 15, 0) + min(s, 15) + 54] for s in starts]
    assert found._jdf.queryExecution().analyzed().toString().count("aggregate(slice(") == 1 and "transform(split(" not in found._jdf.queryExecution().analyzed().toString()
