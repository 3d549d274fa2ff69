"""Fitted models: isolation forests per group, dense text vectors and their neighbours."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from cadastra.functions.text import fold_accents
from cadastra.operators import grams
from cadastra.operators.impute import group_summary, percentiles, uniform
from cadastra.operators.lookup import dimension
from cadastra.sources.folders import written

#: Rows of a tree's sample, trees, and sampled rows a group; fixed whatever the data. Bytes of forests that a task holds at once.
SAMPLE, TREES, SAMPLED, FOREST_BYTES = 256, 100, 1024, 64 << 20
#: Rows that go down a tree together, so that they stay in the processor's cache.
ROWS = 8192
#: Texts and grams that are multiplied at once; a feature that one of OFTEN texts shows counts as dense.
TEXTS, FOUND, OFTEN = 4096, 1 << 20, 9
#: Bytes of query vectors that a task holds at once, and queries whose products it holds.
QUERY_BYTES, TILE = 16 << 20, 512


def average_path(n: float) -> float:
    """Mean path length of an unsuccessful search in a binary tree of n rows."""
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


def grown(x: np.ndarray, rng, limit: int) -> tuple[list, list, list, list]:
    """A tree as columns (-1: a leaf), splits (of leaves: path lengths), and the places of left and right nodes; nodes in preorder."""
    column, at, left, right = [], [], [], []
    todo = [(x, 0, None)]
    while todo:
        own, depth, link = todo.pop()
        if link is not None:
            link[0][link[1]] = len(column)
        spread = np.flatnonzero(own.max(axis=0) > own.min(axis=0)) if len(own) > 1 else ()
        left.append(-1)
        right.append(-1)
        if depth >= limit or not len(spread):
            column.append(-1)
            at.append(depth + average_path(len(own)))
            continue
        c = int(rng.choice(spread))
        split = float(rng.uniform(own[:, c].min(), own[:, c].max()))
        column.append(c)
        at.append(split)
        low = own[:, c] < split
        todo += [(own[~low], depth + 1, (right, len(column) - 1)), (own[low], depth + 1, (left, len(column) - 1))]
    return column, at, left, right


def levelled(forests: list[list[tuple]]) -> list[tuple[list, np.ndarray]]:
    """For each tree number the trees of all forests side by side, as complete ones of one depth: of each level the columns and splits of all places,
    then the path lengths below the last level. A leaf further up sends its rows on to copies of itself."""
    out = []
    for trees in zip(*forests, strict=True):
        starts = np.cumsum([0, *[len(t[0]) for t in trees]])
        column, at = (np.concatenate([t[i] for t in trees]) for i in (0, 1))
        left, right = (np.concatenate([t[i] + start for t, start in zip(trees, starts, strict=False)]) for i in (2, 3))
        nodes, levels = starts[:-1], []
        while (column[nodes] >= 0).any():
            leaf = column[nodes] < 0
            levels.append((np.where(leaf, 0, column[nodes]), np.where(leaf, np.inf, at[nodes])))
            nodes = np.stack([np.where(leaf, nodes, left[nodes]), np.where(leaf, nodes, right[nodes])], axis=1).ravel()
        out.append((levels, at[nodes]))
    return out


def path_sums(levelled_: list[tuple[list, np.ndarray]], forest: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The sum of each row's path lengths in the trees of its forest (a number), ROWS rows going down a level at a time, whatever their forests."""
    total = np.zeros(len(x))
    for lo in range(0, len(x), ROWS):
        own = np.ascontiguousarray(x[lo : lo + ROWS].T)
        n, flat, first = own.shape[1], own.ravel(), forest[lo : lo + ROWS]
        row, sums = np.arange(n), total[lo : lo + n]
        for levels, lengths in levelled_:
            place = first.astype(np.int64)
            for column, at in levels:
                right = flat.take((column * n).take(place) + row) >= at.take(place)
                place <<= 1
                place += right
            sums += lengths.take(place)
    return total


def forests(sample: DataFrame, columns: list[str], trees: int) -> DataFrame:
    """(_key, tree, size, column, at, left, right): the trees of each group's sampled rows, grown in grouped tasks of at most about SAMPLED rows."""
    kinds = "_key string, tree int, size long, column array<int>, at array<double>, left array<int>, right array<int>"

    def grow(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("_hash", "ascending"), *[(c, "ascending") for c in columns]]).slice(0, SAMPLED)
        x = np.stack([rows.column(c).to_numpy() for c in columns], axis=1)
        size, out = min(SAMPLE, len(x)), []
        for tree in range(trees):
            rng = np.random.default_rng([42, tree])
            out.append((rows.column("_key")[0].as_py(), tree, size, *grown(x[rng.choice(len(x), size, replace=False)], rng, int(np.ceil(np.log2(max(2, size)))))))
        names = ["_key", "tree", "size", "column", "at", "left", "right"]
        types = [pa.string(), pa.int32(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.float64()), pa.list_(pa.int32()), pa.list_(pa.int32())]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    return sample.groupBy("_key").applyInArrow(grow, kinds)


def scorer(shared):
    """A function on Arrow arrays (group, list of values): anomaly scores by the group's forest, null for groups that it lacks."""

    def score(keys: pa.Array, rows: pa.Array) -> pa.Array:
        out = np.full(len(keys), np.nan)
        x = rows.flatten().to_numpy().reshape(len(keys), -1) if len(keys) else np.zeros((0, 1))
        numbers, norms, trees = shared.value
        coded = keys.dictionary_encode()
        known = np.array([numbers.get(k, -1) for k in coded.dictionary.to_pylist()] + [-1], dtype=np.int64)  # the last is for null keys
        forest = known[coded.indices.fill_null(len(known) - 1).to_numpy()]
        at = np.flatnonzero(forest >= 0)
        if len(at):
            out[at] = 2.0 ** -(path_sums(trees, forest[at], x[at]) / len(trees) / norms[forest[at]])
        return pa.array(out, mask=np.isnan(out))

    return score


def inliers(df: DataFrame, groups: list[str], columns: list[str], row: list[str], contamination: float, least: int = 50, trees: int = TREES, standardise: bool = True, fill: bool = False) -> DataFrame:
    """The rows with `score`, but for the share with the shortest mean path in their group's forest.

    Groups of fewer than `least` whole rows stay, and so do rows with a null (no score); `fill`: nulls count as the
    group's median instead. `standardise`: columns in standard deviations from their group's mean. A group's sample are
    about its SAMPLED rows with the least hashes of `row`, found by a bound on the hash, so that no task sees a whole
    group; forests grow in grouped tasks, and rows are scored where they are, FOREST_BYTES of forests at a time. The
    cut is an exact percentile. The same rows give the same trees for any partitioning.
    """
    df = df.withColumn("_key", F.to_json(F.array(*[F.col(g).cast("string") for g in groups])) if groups else F.lit("[]"))
    values = [F.col(c).cast("double") for c in columns]
    if fill:
        medians = written(group_summary(df, ["_key"], {f"_fill_{i}": F.col(c) for i, c in enumerate(columns)}))
        df = df.join(dimension(medians), "_key")
        values = [F.coalesce(v, F.col(f"_fill_{i}")) for i, v in enumerate(values)]
    zs = [f"_z_{i}" for i in range(len(columns))]
    whole = reduce(lambda a, b: a & b, [v.isNotNull() & ~F.isnan(v) for v in values])
    df = df.withColumn("_whole", F.coalesce(whole, F.lit(False)))
    stats = df.filter("_whole").withColumns(dict(zip(zs, values, strict=True))).groupBy("_key").agg(F.count(F.lit(1)).alias("_n"), *[f(z).alias(f"{z}_{n}") for z in zs for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    z = df.join(dimension(written(stats)), "_key", "left")
    shown = lambda v, i: F.coalesce(F.try_divide(v - F.col(f"_z_{i}_m"), F.col(f"_z_{i}_s")), F.lit(0.0)) if standardise else v
    z = z.withColumns({zs[i]: shown(v, i) for i, v in enumerate(values)}).drop(*[f"{c}_{n}" for c in zs for n in "ms"])
    z = z.withColumn("_hash", uniform(*[F.col(c) for c in row]))
    bound = (SAMPLED + 10 * np.sqrt(SAMPLED)) / F.col("_n")  # ten standard deviations above, so SAMPLED rows are below it
    sample = z.filter(F.col("_whole") & (F.col("_n") >= least) & (F.col("_hash") < bound)).select("_key", "_hash", *zs)
    grown_ = written(forests(sample, zs, trees))
    size = grown_.agg(F.sum(24 * F.size("column"))).first()[0] or 0
    blocks = max(1, -(-size // FOREST_BYTES))
    scored, parts = z.withColumn("_row", F.when(F.col("_whole"), F.array(*zs)).otherwise(F.array(*[F.lit(0.0)] * len(zs)))), []
    for block in range(blocks):
        held: dict = {}
        for r in grown_.filter(F.pmod(F.xxhash64("_key"), F.lit(blocks)) == block).orderBy("_key", "tree").toLocalIterator():  # of counted bytes
            tree = tuple(np.array(r[c], dtype=t) for c, t in (("column", np.int64), ("at", np.float64), ("left", np.int64), ("right", np.int64)))
            held.setdefault(r["_key"], ([], average_path(r["size"])))[0].append(tree)
        parts.append(f"_score_{block}")
        norms = np.array([max(norm, 1e-9) for _, norm in held.values()])
        shared = df.sparkSession.sparkContext.broadcast(({k: i for i, k in enumerate(held)}, norms, levelled([t for t, _ in held.values()])))
        scored = scored.withColumn(parts[-1], F.arrow_udf(scorer(shared), "double")("_key", "_row"))
    score = F.when(F.col("_whole"), F.coalesce(*parts))
    scored = written(scored.withColumn("_score", score).drop("_row", "_hash", "_whole", *parts, *zs, *[f"_fill_{i}" for i in range(len(columns))]))
    cut = percentiles(scored.filter("_score IS NOT NULL"), ["_key"], "_score", [1 - contamination], "_q").select("_key", F.col("_q")[0].alias("_cut"))
    kept = scored.join(dimension(written(cut)), "_key", "left").filter("_score IS NULL OR _score <= _cut")
    return kept.withColumn("score", F.round("_score", 6)).drop("_key", "_n", "_score", "_cut")


def trimmed_or_inliers(df: DataFrame, groups: list[str], columns: list[str], row: list[str], contamination: float = 0.05, large: int = 5000, least: int = 50, trees: int = 50) -> DataFrame:
    """Inliers of groups of `large` whole rows and more; of others from `least` on the rows within the 1st and 99th percentile of each column in turn, nulls kept."""
    same = [F.col(f"_a.{g}").eqNullSafe(F.col(f"_b.{g}")) for g in groups]
    whole = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])
    sizes = df.groupBy(*groups).agg(F.count_if(whole).alias("_size"))
    sized = df.alias("_a").join(dimension(written(sizes)).alias("_b"), same).select("_a.*", "_size")
    big = inliers(sized.filter(F.col("_size") >= large).drop("_size"), groups, columns, row, contamination, large, trees)
    rest = sized.filter(F.col("_size") < large)
    for c in columns:
        q = written(percentiles(rest, groups, c, [0.01, 0.99], "_q"))
        joined = rest.alias("_a").join(dimension(q).alias("_b"), same).select("_a.*", "_q")
        rest = joined.filter((F.col("_size") < least) | F.coalesce(F.col(c).between(F.col("_q")[0], F.col("_q")[1]), F.lit(True))).drop("_q")
    return big.unionByName(rest.drop("_size").withColumn("score", F.lit(None).cast("double")))


def text_vectors(df: DataFrame, dims: int, features: int = 10_000, least_docs: int = 2) -> DataFrame:
    """(doc_id, vector): TF-IDF of the most frequent 1- to 3-grams of words, with 1 + ln(tf), reduced by a distributed SVD and normalised.

    Letters lose their accents; texts without any of the grams have a zero vector.
    """
    packed = grams.blocks(df.select("doc_id", fold_accents(F.coalesce("text", F.lit(""))).alias("text")))
    docs = packed.agg(F.sum(F.size("ids"))).first()[0] or 0
    known, shown = grams.most_frequent(packed, 3, features, least_docs)
    counts = grams.counts(packed, 3, known)  # read by each step of the SVD
    weights = df.sparkSession.sparkContext.broadcast(np.log((docs + 1) / (shown + 1)))
    basis = df.sparkSession.sparkContext.broadcast(right_vectors(counts, weights, dims))

    def project(batches):
        for ids, *rows in stacked(batches, weights.value):
            y = products(*rows, basis.value)
            y /= np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-12)
            ends = np.arange(len(y) + 1, dtype=np.int32) * y.shape[1]
            yield pa.RecordBatch.from_arrays([pa.concat_arrays(ids), pa.ListArray.from_arrays(ends, y.ravel())], names=["doc_id", "vector"])

    return counts.mapInArrow(grams.frugal(project), f"doc_id {dict(df.dtypes)['doc_id']}, vector array<double>")


def stacked(batches, idf: np.ndarray):
    """From blocks of counts (`grams.counts`; ids, if read) some TEXTS texts at a time: their ids, then TF-IDF rows of length 1 as sizes, features and values."""

    def rows(held):
        ids, size, i, x = zip(*held, strict=True)
        size, i = np.concatenate(size), np.concatenate(i)
        values = (1 + np.log(np.concatenate(x), dtype=np.float64)) * idf[i]
        row = np.repeat(np.arange(len(size)), size)
        norm = np.sqrt(np.bincount(row, weights=values * values, minlength=len(size)))
        return ids, size, i, values / np.maximum(norm, 1e-300)[row]

    held, texts, found = [], 0, 0
    for b in batches:
        for at in range(b.num_rows):
            ids = b.column("ids").slice(at, 1).flatten() if "ids" in b.schema.names else None
            size, i, x = (b.column(c)[at].as_buffer() for c in ("size", "i", "x"))
            size = np.frombuffer(size, np.int32)
            held.append((ids, size, *[np.frombuffer(c, f"u{c.size // max(int(size.sum()), 1) or 1}") for c in (i, x)]))
            texts, found = texts + len(held[-1][1]), found + len(held[-1][2])
            if texts >= TEXTS or found >= FOUND:
                yield rows(held)
                held, texts, found = [], 0, 0
    if held:
        yield rows(held)


def products(size: np.ndarray, i: np.ndarray, values: np.ndarray, q: np.ndarray, sums: np.ndarray | None = None) -> np.ndarray:
    """A q for sparse rows A (sizes, features, values); A'A q is added to `sums`.

    Features that a block shows in one of OFTEN rows or more are multiplied as a dense matrix, the others row by row
    and back feature by feature.
    """
    row = np.repeat(np.arange(len(size)), size)
    head = np.flatnonzero(np.bincount(i, minlength=len(q)) * OFTEN > len(size))
    column = np.full(len(q), -1)
    column[head] = np.arange(len(head))
    dense = column[i] >= 0
    a = np.zeros((len(size), len(head)))
    a[row[dense], column[i[dense]]] = values[dense]
    y = a @ q[head]
    row, i, values = row[~dense], i[~dense], values[~dense]
    ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(size)))]).tolist()
    for r, (lo, hi) in enumerate(zip(ends, ends[1:], strict=False)):
        if hi > lo:
            y[r] += values[lo:hi] @ q.take(i[lo:hi], axis=0)
    if sums is not None:
        sums[head] += a.T @ y
        order = np.argsort(i, kind="stable")
        row, values, often = row[order], values[order], np.bincount(i, minlength=len(q))
        ends = np.cumsum(often).tolist()
        for f, n in enumerate(often.tolist()):
            if n:
                sums[f] += values[ends[f] - n : ends[f]] @ y.take(row[ends[f] - n : ends[f]], axis=0)
    return y


def gram_product(counts: DataFrame, weights, q: np.ndarray) -> np.ndarray:
    """A'A q for the matrix A of unit rows: a sum over the tasks' own products, added up by Spark in parts."""
    shared = counts.sparkSession.sparkContext.broadcast(np.ascontiguousarray(q))  # rows are gathered

    def multiply(batches):
        out = np.zeros(shared.value.shape)
        for _, *rows in stacked(batches, weights.value):
            products(*rows, shared.value, out)
        yield from grams.tables(out.ravel())

    total = grams.added(counts.select("size", "i", "x").mapInArrow(grams.frugal(multiply), "part int, x binary"), np.float64)  # features times width: of fixed size
    shared.unpersist()
    return total.reshape(q.shape)


def right_vectors(counts: DataFrame, weights, dims: int, tolerance: float = 1e-8, held: int = 800) -> np.ndarray:
    """The leading right singular vectors of the unit rows, by a block Krylov iteration with Rayleigh-Ritz: each step is one pass for a whole block.

    It ends when A'A v = s v holds for all of them to `tolerance` of the largest s; above `held` columns it goes on from
    the best ones. Of each vector the largest entry is positive. Vectors of singular values below 1e-9 of the largest are left out.
    """
    n = len(weights.value)
    dims, block = min(dims, n), min(dims + 16, n)
    if not dims:
        return np.zeros((n, 0))
    basis = np.linalg.qr(np.random.default_rng(42).normal(size=(n, block)))[0]
    image = gram_product(counts, weights, basis)
    for _ in range(100):
        s, y = np.linalg.eigh((basis.T @ image + image.T @ basis) / 2)
        s, y = s[::-1], y[:, ::-1]
        wrong = image @ y[:, :block] - (basis @ y[:, :block]) * s[:block]
        if np.linalg.norm(wrong[:, :dims], axis=0).max() <= tolerance * max(s[0], 1e-300) or basis.shape[1] >= n:
            break
        if basis.shape[1] + block > held:
            basis, image = basis @ y[:, : 2 * block], image @ y[:, : 2 * block]
        for _ in range(2):
            wrong = wrong - basis @ (basis.T @ wrong)
        new, size, _ = np.linalg.svd(wrong, full_matrices=False)
        new = new[:, size > 1e-14 * max(s[0], 1e-300)][:, : n - basis.shape[1]]
        new = np.linalg.qr(new - basis @ (basis.T @ new))[0]
        if not new.shape[1]:
            break
        basis, image = np.concatenate([basis, new], axis=1), np.concatenate([image, gram_product(counts, weights, new)], axis=1)
    else:
        raise ValueError("the singular vectors did not converge")
    s, y = np.linalg.eigh((basis.T @ image + image.T @ basis) / 2)
    s, y = s[::-1][:dims], y[:, ::-1][:, :dims]
    out = (basis @ y)[:, s > 1e-18 * max(s[0], 1e-300)]
    return np.ascontiguousarray(out * np.where(np.take_along_axis(out, np.abs(out).argmax(axis=0)[None], 0) < 0, -1.0, 1.0))


def best_rows(n: np.ndarray, score: np.ndarray, name: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each query number the k rows of largest score, ties to the smaller name, in order."""
    order = np.lexsort((name, -score, n))
    n = n[order]
    first = np.searchsorted(n, n)
    keep = np.arange(len(n)) - first < k
    return n[keep], score[order][keep], name[order][keep]


def places_of(hits: np.ndarray) -> np.ndarray:
    """Flat places of the few true ones, eight at a time."""
    flat = hits.ravel()
    whole = len(flat) // 8 * 8
    some = np.flatnonzero(flat[:whole].view(np.uint64))
    n, at = np.nonzero(flat[:whole].reshape(-1, 8)[some])
    return np.concatenate([some[n] * 8 + at, whole + np.flatnonzero(flat[whole:])])


def reaching(q: np.ndarray, x: np.ndarray, bound: np.ndarray, slack: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, product) of the products q x that reach their row's bound.

    They are found in single precision, whose error is below `slack`, and computed in double precision; where there are
    many, or numbers beyond 1e18, all are.
    """
    at = None
    if np.abs(q).max(initial=0) < 1e18 and np.abs(x).max(initial=0) < 1e18 and np.abs(bound).max(initial=0) < 1e37:
        low = np.nextafter((bound - slack).astype(np.float32), np.float32(-np.inf))
        at = places_of(q.astype(np.float32) @ x.astype(np.float32) >= low[:, None])
    if at is None or len(at) * 16 > len(q) * x.shape[1]:
        product = q @ x
        at = np.flatnonzero(product >= bound[:, None])
        return *np.divmod(at, x.shape[1]), product.ravel()[at]
    n, j = np.divmod(at, x.shape[1])
    product = np.einsum("ij,ij->i", q[n], x.T[j])
    near = product >= bound[n]
    return n[near], j[near], product[near]


def nearest_texts(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(doc_id, rank, other, score): for each row of `queries` (doc_id, vector) the k other rows of `vectors` with the largest inner product (to 12 digits), ties to the smaller id.

    Queries come in blocks of about QUERY_BYTES, each against all vectors where they are: matrix products in tiles, of
    which only those that reach a query's kth best so far are looked at; a task keeps k rows a query. The result is
    exact. Null vectors take no part; a zero vector has products of 0.
    """
    name = dict(vectors.dtypes)["doc_id"]
    kind = to_arrow_type(vectors.schema["doc_id"].dataType)
    own = written(queries.filter("vector IS NOT NULL").select("doc_id", "vector"))
    blocks = max(1, -(-(own.agg(F.sum(8 * F.size("vector"))).first()[0] or 0) // QUERY_BYTES))
    found = None
    for block in range(blocks):
        held = own.filter(F.pmod(F.xxhash64("doc_id"), F.lit(blocks)) == block).orderBy("doc_id").toArrow()  # of counted bytes
        if not held.num_rows:
            continue
        q = held.column("vector").combine_chunks().flatten().to_numpy().reshape(held.num_rows, -1 if len(held.column("vector")[0].values) else 0)
        asked = vectors.sparkSession.sparkContext.broadcast((held.column("doc_id").combine_chunks(), q))

        def search(batches, asked=asked):
            ids, q = asked.value
            numbers: dict = {}
            same = np.array([numbers.setdefault(x, n) for n, x in enumerate(ids.to_pylist())])  # the first query of this id
            length, least = np.linalg.norm(q, axis=1), np.full(len(ids), -np.inf)
            late = np.zeros(len(ids), bool)
            kept, waiting = (np.zeros(0, np.int64), np.zeros(0), None), []

            def settled():
                parts = [*([kept] if len(kept[0]) else []), *waiting]
                best = best_rows(*[np.concatenate(c) for c in zip(*parts, strict=True)], k)
                last = np.flatnonzero(np.diff(best[0], append=-1))
                last = last[np.bincount(best[0], minlength=len(ids))[best[0][last]] == k]
                least[best[0][last]] = best[1][last]
                return best

            for b in batches:
                if not b.num_rows:
                    continue
                names = np.array(b.column("doc_id").to_pylist())
                turn = np.argsort(names, kind="stable")  # so that of equal scores the first columns are the smaller ids
                names, x = names[turn], b.column("vector").flatten().to_numpy().reshape(b.num_rows, q.shape[1])[turn]
                own = np.array([numbers.get(y, -1) for y in names.tolist()])
                late[:] = False
                if len(kept[0]):  # of queries with k rows, the last of a smaller id than all rows here, ties are lost
                    last = np.flatnonzero(np.diff(kept[0], append=-1))
                    late[kept[0][last]] = kept[2][last] < names[0]
                bound = least + np.where(late, 0.4e-12, -0.6e-12)
                for left in range(0, len(names), 2 * TILE):
                    columns = np.ascontiguousarray(x[left : left + 2 * TILE].T)
                    slack = (len(columns) + 4) * 2.0**-24 * length * np.sqrt((columns * columns).sum(axis=0).max()) + 1e-15
                    for lo in range(0, len(ids), TILE):
                        hi = min(lo + TILE, len(ids))
                        if np.isfinite(bound[lo:hi]).all():
                            n, j, score = reaching(q[lo:hi], columns, bound[lo:hi], slack[lo:hi])
                            other = own[left + j] != same[lo + n]  # not the query's own row
                            n, j, score = n[other], j[other], score[other]
                        else:
                            product = q[lo:hi] @ columns
                            product[same[lo:hi, None] == own[None, left : left + 2 * TILE]] = -np.inf
                            few = min(k, product.shape[1])
                            own_kth = np.partition(product, product.shape[1] - few, axis=1)[:, product.shape[1] - few]
                            n, j = np.nonzero((product >= np.maximum(bound[lo:hi], own_kth - 1.2e-12)[:, None]) & (product > -np.inf))
                            score = product[n, j]
                        score = np.round(score, 12)
                        if len(n) > k * (hi - lo):
                            n, score, j = best_rows(n, score, j, k)
                        if len(n):
                            waiting.append((n + lo, score, names[left + j]))
                    if sum(len(w[0]) for w in waiting) > (k * len(ids) if np.isfinite(bound).all() else 0):
                        kept, waiting = settled(), []
                        bound = np.maximum(bound, least - 0.6e-12)
            if waiting:
                kept = settled()
            if len(kept[0]):
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(kept[0])), pa.array(kept[2].tolist(), kind), pa.array(kept[1])], names=["doc_id", "other", "score"])

        part = vectors.filter("vector IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", "vector").mapInArrow(grams.frugal(search), f"doc_id {name}, other {name}, score double")
        found = part if found is None else found.unionByName(part)
    if found is None:
        return vectors.sparkSession.createDataFrame([], f"doc_id {name}, rank int, other {name}, score double")
    order = Window.partitionBy("doc_id").orderBy(F.desc("score"), "other")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("doc_id", F.col("rank").cast("int").alias("rank"), "other", "score")
