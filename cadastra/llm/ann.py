"""Approximate nearest neighbours by largest inner product: an inverted file of coarse
centroids with product-quantised residuals, asymmetric distance tables and exact reranking.

Centroids and codebooks are fitted on at most SAMPLE vectors, drawn by a hash of vec_id;
every vector is indexed. Index rows are dealt over parts by a hash of vec_id, so each
part holds a slice of every list and a list that holds a third of all rows burdens no
task more than others. A block of queries meets a part: distances of the rows in the
probed lists come from tables, the best RERANK of them are scored exactly (in double
precision, from first to last component), and the best of all parts are the answer.

Edge cases: vectors that are null, empty, zero, or hold null or non-finite components, and
those of another length than most (the shorter on ties), take no part, nor do rows
without vec_id; of rows with the same vec_id the smallest vector counts; ties go to the
smaller vec_id; with fewer candidates than asked for, all are returned; an empty table
gives an empty result. Only vec_id and embedding are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadastra.llm.tables import written

SAMPLE, LISTS, PROBED, SUBSPACES, CODES, RERANK = 20_000, 128, 0.8, 32, 256, 100
#: Rows of a part of the index, queries of a block.
PART, QUERIES = 8192, 1024


def kmeans(x: np.ndarray, k: int, rounds: int, seed: int = 7) -> np.ndarray:
    """Lloyd's algorithm on a bounded sample, from k distinct rows if there are so many."""
    unique = np.unique(x, axis=0)
    rng = np.random.default_rng(seed)
    c = unique[rng.permutation(len(unique))[:k]].copy()
    for _ in range(rounds):
        near = nearest(x, c)
        n = np.bincount(near, minlength=len(c))
        order = np.argsort(near, kind="stable")
        has = np.flatnonzero(n)
        c[has] = np.add.reduceat(x[order], (np.cumsum(n) - n)[has], axis=0) / n[has, None]
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (x @ c.T - 0.5 * (c * c).sum(axis=1)).argmax(axis=1)


def taking_part(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding as array<double>) of the rows that take part, once each vec_id."""
    v = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).filter("vec_id IS NOT NULL AND size(embedding) > 0")
    bad: Column = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    v = v.filter(~bad & F.exists("embedding", lambda x: x != 0))
    length = v.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").head()
    if length is None:
        return v
    v = v.filter(F.size("embedding") == length["d"])
    rows, ids = v.agg(F.count(F.lit(1)), F.count_distinct("vec_id")).first()
    return v if rows == ids else v.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))


def fit(v: DataFrame, n: int) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Coarse centroids, the components of each subspace, and its codebook."""
    share = min(1.0, SAMPLE / n)
    drawn = v.filter(F.pmod(F.xxhash64("vec_id", F.lit("sample")), F.lit(1_000_000)) < int(share * 1_000_000)) if share < 1 else v
    rows = drawn.orderBy(F.xxhash64("vec_id", F.lit("sample")), "vec_id").limit(SAMPLE).collect()  # bounded by SAMPLE
    x = np.array([r["embedding"] for r in rows] or [v.head()["embedding"]])
    c = kmeans(x, max(1, min(LISTS, n // 16)), 8)
    rest = x - c[nearest(x, c)]
    spaces = np.array_split(np.arange(x.shape[1]), min(SUBSPACES, x.shape[1]))
    return c, spaces, [kmeans(rest[:, s], CODES, 4) for s in spaces]


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def search(vectors: DataFrame, query: Column, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id and score: the k nearest found of each row that `query` selects."""
    v = written(taking_part(vectors))
    n = v.count()
    schema = "query_id long, vec_id long, score double"
    if not n:
        return v.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    model = v.sparkSession.sparkContext.broadcast(fit(v, n))  # LISTS centroids and SUBSPACES x CODES words
    parts = -(-n // PART)
    queries = v.filter(query)
    blocks = max(1, -(-queries.count() // QUERIES))

    def encode(batches):
        c, spaces, books = model.value
        for b in batches:
            x = _matrix(b.column("embedding"))
            if not len(x):
                continue
            near = nearest(x, c)
            rest = x - c[near]
            codes = np.stack([nearest(rest[:, s], w) for s, w in zip(spaces, books, strict=True)], axis=1).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("embedding"), pa.array(near.astype(np.int32)), pa.array([r.tobytes() for r in codes], pa.binary())], names=["vec_id", "embedding", "list", "codes"])

    def probe(rows: pa.Table, asked: pa.Table) -> pa.Table:
        c, spaces, books = model.value
        out = {"query_id": [], "vec_id": [], "score": []}
        if rows.num_rows and asked.num_rows:
            ids = rows.column("vec_id").to_numpy()
            order = np.argsort(ids, kind="stable")
            ids, x = ids[order], _matrix(rows.column("embedding"))[order]
            lists = rows.column("list").to_numpy()[order]
            codes = np.frombuffer(b"".join(rows.column("codes").to_pylist()), dtype=np.uint8).reshape(len(ids), -1)[order]
            qid, q = asked.column("vec_id").to_numpy(), _matrix(asked.column("embedding"))
            coarse = (q @ c.T).astype(np.float32)
            n_probed = max(1, int(np.ceil(PROBED * len(c))))
            probed = np.zeros(coarse.shape, dtype=bool)
            np.put_along_axis(probed, np.argsort(-coarse, axis=1, kind="stable")[:, :n_probed], True, axis=1)
            for at in range(0, len(q), 256):  # bounds the block of distances
                sub = slice(at, at + 256)
                near = coarse[sub][:, lists]
                for m, (s, w) in enumerate(zip(spaces, books, strict=True)):
                    near += (q[sub][:, s] @ w.T).astype(np.float32)[:, codes[:, m]]  # the query's distance table
                near[~probed[sub][:, lists] | (qid[sub, None] == ids[None, :])] = -np.inf
                take = min(max(RERANK, k), near.shape[1])
                edge = np.partition(near, near.shape[1] - take, axis=1)[:, near.shape[1] - take, None]
                level = near == edge
                chosen = (near > edge) | (level & (np.cumsum(level, axis=1) <= take - (near > edge).sum(axis=1, keepdims=True)))
                chosen &= near > -np.inf
                qi, xi = np.nonzero(chosen)
                score = np.zeros(len(qi))
                for d in range(x.shape[1]):
                    score += x[xi, d] * q[sub][qi, d]
                best = np.lexsort((ids[xi], -score, qi))
                qi, xi, score = qi[best], xi[best], score[best]
                first = np.searchsorted(qi, qi)
                top = np.arange(len(qi)) - first < k
                out["query_id"].append(qid[sub][qi[top]])
                out["vec_id"].append(ids[xi[top]])
                out["score"].append(score[top])
        kinds = {"query_id": np.int64, "vec_id": np.int64, "score": np.float64}
        return pa.table({name: pa.array(np.concatenate(x).astype(kinds[name]) if x else np.zeros(0, kinds[name])) for name, x in out.items()})

    vec = lambda name: F.pmod(F.xxhash64("vec_id", F.lit(name)), F.lit(parts if name == "part" else blocks)).cast("int")
    index = v.select(F.col("vec_id").cast("long"), "embedding").mapInArrow(encode, "vec_id long, embedding array<double>, list int, codes binary")
    index = index.withColumn("part", vec("part")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    asked = queries.select(F.col("vec_id").cast("long"), "embedding").withColumn("block", vec("block")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    found = index.groupBy("part", "block").cogroup(asked.groupBy("part", "block")).applyInArrow(probe, schema)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
