"""Frequent n-grams by count, sparse products, and neighbours over many batches, against plain versions."""

import collections
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cadastra.functions.text import fold_accents
from cadastra.operators import forest, grams

ODD = [None, "", "?", "a", "ab", "É ça VA", "ab", "cd ab", "x" * 300 + " yy", "ab cd " * 200, "éab 1 22", "日本ab語cd", "\x00ab\x00"]


def plain(text, longest=3):
    words = re.findall("[a-z0-9]{2,}", text)
    return [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


def hashed(text):
    """The grams of a folded text with their hashes."""
    n, own = grams.words(pa.array([text]))
    h = np.concatenate([h for _, h in grams.grams(n, own, 3)])
    return dict(zip(plain(text), h.view(np.int64).tolist(), strict=True))


@pytest.mark.parametrize(("features", "block", "looked", "buckets"), [(300, 256 << 10, 192, 1 << 20), (300, 3000, 2, 1 << 20), (1000, 3000, 1, 1 << 10), (10**6, 20000, 3, 1 << 20)])
def test_most_frequent_grams_by_count(spark, sf, monkeypatch, features, block, looked, buckets):
    for name, value in (("BLOCK_BYTES", block), ("LOOKED", looked), ("BUCKETS", buckets)):
        monkeypatch.setattr(grams, name, value)
    df = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame([(-i, t) for i, t in enumerate(ODD, 1)], "doc_id long, text string")).repartition(3)
    df = df.select("doc_id", fold_accents(F.coalesce("text", F.lit(""))).alias("text"))
    packed = grams.blocks(df)
    known, docs = grams.most_frequent(packed, 3, features, 2)
    often, shown, hashes = collections.Counter(), collections.Counter(), {}
    rows = {r["doc_id"]: r["text"] for r in df.collect()}
    for t in rows.values():
        own = plain(t)
        often.update(own)
        shown.update(set(own))
        hashes |= hashed(t)
    best = sorted((g for g in often if shown[g] >= 2), key=lambda g: (-often[g], hashes[g]))[:features]
    assert dict(zip(known.view(np.int64).tolist(), docs.tolist(), strict=True)) == {hashes[g]: shown[g] for g in best} and (np.diff(known.astype(object)) > 0).all()
    place = {int(h): i for i, h in enumerate(known.view(np.int64))}
    for r in grams.counts(packed, 3, known).collect():
        sizes = np.frombuffer(r["size"], np.int32)
        i, x = (np.frombuffer(r[c], f"u{len(r[c]) // max(int(sizes.sum()), 1) or 1}") for c in "ix")
        for at, lo, size in zip(r["ids"], np.cumsum([0, *sizes]).tolist(), sizes.tolist(), strict=False):
            wanted = collections.Counter(place[hashes[g]] for g in plain(rows[at]) if hashes[g] in place)
            assert dict(zip(i[lo : lo + size].tolist(), x[lo : lo + size].tolist(), strict=True)) == wanted
            del rows[at]
    assert not rows


def test_equal_counts_at_the_last_feature(spark):
    """Which of equally frequent grams count depends on neither partitions nor order."""
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(f"w{j}" for j in rng.permutation(60)[:12])) for i in range(90)]
    found = []
    for own, parts in ((rows, 1), (rows[::-1], 6)):
        v = forest.text_vectors(spark.createDataFrame(own, "doc_id long, text string").repartition(parts), 5, features=40)
        found.append(np.array([r["vector"] for r in v.orderBy("doc_id").collect()]))
    assert np.abs(found[0] @ found[0].T - found[1] @ found[1].T).max() < 1e-6


def test_sparse_products():
    rng = np.random.default_rng(1)
    a = rng.normal(size=(70, 30)) * (rng.random((70, 30)) < np.linspace(0.02, 0.9, 30))
    a[[0, 11, 69]] = 0
    row, i = np.nonzero(a)
    size, q = np.bincount(row, minlength=70), np.asfortranarray(rng.normal(size=(30, 6)))
    sums = np.ones((30, 6))
    y = forest.products(size, i.astype(np.uint8), a[row, i], q, sums)
    assert np.allclose(y, a @ q, atol=1e-12) and np.allclose(sums, 1 + a.T @ a @ q, atol=1e-12)


@pytest.mark.parametrize("kind", ["long", "string"])
def test_nearest_texts_over_many_batches(spark, kind):
    """Bounds that a task carries from batch to batch lose no row and no tie."""
    rng = np.random.default_rng(8)
    x = np.round(rng.normal(size=(900, 3)), 1)
    x[rng.integers(0, 900, 300)] = x[5]
    x[rng.integers(0, 900, 100)] = 0
    name = (lambda i: i * 7 % 900) if kind == "long" else (lambda i: f"d{i * 7 % 900}")
    df = spark.createDataFrame([(name(i), v.tolist()) for i, v in enumerate(x)], f"doc_id {kind}, vector array<double>").repartition(2)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 37)
    try:
        found = collections.defaultdict(list)
        asked = sorted(name(i) for i in range(0, 900, 9))
        for r in forest.nearest_texts(df, df.filter(F.col("doc_id").isin(asked)), 7).orderBy("doc_id", "rank").collect():
            found[r["doc_id"]].append((r["other"], r["score"]))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    rows = {name(i): v for i, v in enumerate(x)}
    score = lambda a, b: round(float(rows[a] @ rows[b]), 12)
    assert dict(found) == {a: [(b, score(a, b)) for b in sorted((b for b in rows if b != a), key=lambda b: (-score(a, b), b))[:7]] for a in asked}


def test_products_that_reach_a_bound():
    """Found in single precision, but exactly those of double precision, at the bounds too."""
    rng = np.random.default_rng(3)
    q, x = rng.normal(size=(40, 32)), rng.normal(size=(32, 3000))
    x[:, 7] = x[:, 9] * (1 + 1e-9)
    product = q @ x
    length = np.linalg.norm(q, axis=1)
    slack = 36 * 2.0**-24 * length * np.linalg.norm(x, axis=0).max()
    for rank in (5, 1000):  # few, then many
        bound = np.sort(product, axis=1)[:, -rank] - 1e-13
        bound[3] = product[3, 9] if rank > 5 else bound[3]
        n, j, score = forest.reaching(q, x, bound, slack)
        assert set(zip(n.tolist(), j.tolist(), strict=True)) == set(zip(*(c.tolist() for c in np.nonzero(product >= bound[:, None])), strict=True))
        assert np.allclose(score, product[n, j], rtol=0, atol=1e-13)
    assert len(forest.reaching(q, x, np.full(40, -np.inf), slack)[0]) == product.size
    assert len(forest.reaching(q * 1e300, x, np.full(40, 1e298), slack * 1e300)[0]) == (product >= 0.01).sum()


def test_nearest_texts_of_many_rows(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(6000, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "doc_id long, vector array<double>").repartition(3)
    found = collections.defaultdict(list)
    for r in forest.nearest_texts(df, df.filter("doc_id % 5 = 0"), 10).orderBy("doc_id", "rank").collect():
        found[r["doc_id"]].append(r["other"])
    product = np.round(x[::5] @ x.T, 12)
    product[np.arange(1200), np.arange(0, 6000, 5)] = -np.inf
    assert dict(found) == {5 * n: np.argsort(-p, kind="stable")[:10].tolist() for n, p in enumerate(product)}
