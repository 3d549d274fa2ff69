"""N-gram Jaccard join: a blocked sparse matrix product of documents by n-grams.

Exact, for all pairs of different shingle sets, without forming the pairs of a group:

1. A document's set of k-word shingles is hashed to 64 bits each; equal sets form one
   class, the unit of all later steps.
2. Columns. The incidence matrix is dealt by columns (shingles) in packed form. A column
   with one class links nothing; a class of n shingles of which fewer than t * n occur in
   another class cannot reach the similarity t and is discarded. Among the classes that
   stay columns are counted again and ordered, rarest first. The smallest common column of
   two similar classes is among the first n - ceil(t * n) + 1 columns of either, counting
   those that are its own alone; only these are shown.
   Classes that show a column are joined to the first of them, and the components of
   these links are the blocks of rows: no similar pair lies across two.
3. Product. A component's incidence matrix is multiplied by its transpose, columns in
   blocks: overlaps accumulate, and pairs whose overlap so far and the rest of the
   smaller row cannot reach the bound that their sizes require are discarded.
   A component over BLOCK rows is cut into row blocks, and each pair of row blocks is
   a task of its own.
4. The links' spanning edges give the connected components.

Edge cases: fewer words than k make one shingle of the whole sequence; a text that is
null or without words has no shingles and is linked with nothing; a repeated doc_id
is several documents; a component without any doc_id has a null component_id; an
empty table gives an empty result. Only doc_id and text are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadastra.llm.graph import components
from cadastra.llm.tables import fresh, parallelism, small, written
from cadastra.llm.text import U, chunks, frugal, hash_spans, mix, mix_int, shingles, slices

#: Rows of a block of the product, columns multiplied at once, entries of the incidence matrix for each partition of its columns.
BLOCK, COLUMNS, ENTRIES = 512, 4096, 2_000_000


def shingle_sets(texts: pa.Array, k: int):
    """The sorted distinct shingle hashes of each text of a batch."""
    for c in chunks(texts, lower=True):
        starts, ends, first = c.words()
        h = hash_spans(c.data, starts, ends)
        s = shingles(h, k)
        for i in range(c.n):
            a, b = first[i], first[i + 1]
            if b - a >= k:
                yield np.unique(s[a : b - k + 1])
            elif b > a:
                yield shingles(h[a:b], int(b - a)) ^ U(b - a)
            else:
                yield np.zeros(0, dtype=U)


def set_class(s: np.ndarray) -> int:
    """The class of a set as a signed 64-bit number."""
    x = mix_int(int(mix(s).sum(dtype=U)) + len(s))
    return x - (1 << 64) if x >> 63 else x


def stars(key: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of the distinct (key, node) rows, a flag on each key's first row, and for each row that first row's node."""
    order = np.lexsort((node, key))
    k, n = key[order], node[order]
    new = np.ones(len(k), dtype=bool)
    new[1:] = (k[1:] != k[:-1]) | (n[1:] != n[:-1])
    order, k, n = order[new], k[new], n[new]
    first = np.ones(len(k), dtype=bool)
    first[1:] = k[1:] != k[:-1]
    return order, first, n[np.maximum.accumulate(np.where(first, np.arange(len(k)), 0))] if len(k) else n


def _rows(names, *arrays):
    return pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], names=names)


def classes(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, key, n_shingles, cls (null for an empty set) of (doc_id, key, text)."""

    def run(batches):
        for b in slices(batches):
            sets = list(shingle_sets(b.column("text"), k))
            cls = [set_class(s) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("key"), pa.array([len(s) for s in sets], pa.int64()), pa.array(cls, pa.int64())], names=["doc_id", "key", "n_shingles", "cls"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "key", "text").mapInArrow(frugal(run), f"doc_id {kind}, key long, n_shingles long, cls long")


PACKED = "to_part int, owners binary, sizes binary, counts binary, h binary, df binary"


def _deal(part: np.ndarray, owner: np.ndarray, owners: np.ndarray, sizes: np.ndarray, h: np.ndarray, df: np.ndarray, parts: int):
    """One packed row for each part: its entries by owner. owner: index into owners and sizes, ascending."""
    order = np.argsort(part.astype(np.uint16 if parts < 65536 else np.int64), kind="stable")
    part, owner, h, df = part[order], owner[order], h[order], df[order]
    cuts = np.searchsorted(part, np.arange(parts + 1))
    rows = []
    for p in np.flatnonzero(np.diff(cuts)):
        at = slice(cuts[p], cuts[p + 1])
        o = owner[at]
        first = np.flatnonzero(np.concatenate([[True], o[1:] != o[:-1]]))
        counts = np.diff(np.append(first, len(o)))
        rows.append((int(p), owners[o[first]].tobytes(), sizes[o[first]].astype(np.uint32).tobytes(), counts.astype(np.uint32).tobytes(), h[at].tobytes(), df[at].tobytes()))
    cols = list(zip(*rows, strict=True)) if rows else [()] * 6
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[1:])], names=["to_part", "owners", "sizes", "counts", "h", "df"])


def _gather(batches, kind):
    """(owner, size, h, df) of all entries dealt to a task."""
    kinds = {"owners": np.int64, "sizes": np.uint32, "counts": np.uint32, "h": kind, "df": np.uint32}
    found = {n: [np.zeros(0, k)] for n, k in kinds.items()}
    for b in batches:
        for n, k in kinds.items():
            found[n] += [np.frombuffer(x.as_py(), dtype=k) for x in b.column(n)]
    owners, sizes, counts, h, df = (np.concatenate(found[n]) for n in kinds)
    return np.repeat(owners, counts), np.repeat(sizes, counts).astype(np.int64), h, df


def _repeated(owner, size, h):
    """The distinct (owner, size, h) whose h occurs with two owners or more, by owner, and how many owners each h has."""
    order = np.argsort(h, kind="stable")
    sorted_h = h[order]
    same = sorted_h[1:] == sorted_h[:-1]
    often = np.zeros(len(h), dtype=bool)
    often[1:] |= same
    often[:-1] |= same
    at = order[often]
    owner, size, h = owner[at], size[at], h[at]
    order = np.lexsort((owner, h))
    owner, size, h = owner[order], size[order], h[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    owner, size, h = owner[new], size[new], h[new]
    start = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
    df = np.repeat(np.diff(np.append(start, len(h))), np.diff(np.append(start, len(h))))
    keep = df > 1
    owner, size, h, df = owner[keep], size[keep], h[keep], df[keep]
    order = np.argsort(owner, kind="stable")
    return owner[order], size[order], h[order], df[order]


def _part_of(x: np.ndarray, parts: int) -> np.ndarray:
    return (((x.view(U) >> U(32)) * U(parts)) >> U(32)).astype(np.int64)


def _sets(b, k: int, wanted: list | None = None):
    """(classes, sizes, owner of each entry, entries) of a batch's different sets, only those wanted if given."""
    sets, seen = [], {}
    for i, s in enumerate(shingle_sets(b.column("text"), k)):
        if len(s) and (c := set_class(s)) not in seen and (wanted is None or wanted[i] == c):
            seen[c] = len(sets)
            sets.append(s)
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    return np.array(list(seen), dtype=np.int64), sizes, np.repeat(np.arange(len(sets)), sizes), np.concatenate([np.zeros(0, U), *sets])


def _dealt_columns(df: DataFrame, k: int, parts: int, narrow: bool, wanted: bool) -> DataFrame:
    """The incidence matrix dealt by columns; narrow: 32 bits of a column's hash beside its part, which only ever join too much."""

    def show(batches):
        for b in slices(batches):
            cls, sizes, owner, h = _sets(b, k, b.column("cls").to_pylist() if wanted else None)
            if len(h):
                yield _deal(_part_of(h, parts), owner, cls, sizes, h.astype(np.uint32) if narrow else h, np.zeros(len(h), np.uint8), parts)

    columns = ["text", "cls"] if wanted else ["text"]
    return df.select(*columns).mapInArrow(frugal(show), PACKED).repartition(parts, "to_part")


def repeated_counts(docs: DataFrame, k: int, parts: int) -> DataFrame:
    """(cls, repeated): how many of a class's shingles occur in other classes too (a few more at worst)."""

    def count(batches):
        owner, _, h, _ = _gather(_no_df(batches), np.uint32)
        owner, _, _, _ = _repeated(owner, np.zeros(len(owner), np.uint8), h)
        cls, n = np.unique(owner, return_counts=True)
        if len(cls):
            yield _deal(_part_of(mix(cls.view(U)).view(np.int64), parts), np.arange(len(cls)), cls, n, np.zeros(len(cls), np.uint8), np.zeros(len(cls), np.uint8), parts)

    def total(batches):
        cls, n = [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)]
        for b in batches:
            cls += [np.frombuffer(x.as_py(), dtype=np.int64) for x in b.column("owners")]
            n += [np.frombuffer(x.as_py(), dtype=np.uint32) for x in b.column("sizes")]
        own, at = np.unique(np.concatenate(cls), return_inverse=True)
        sums = np.zeros(len(own), dtype=np.int64)
        np.add.at(sums, at, np.concatenate(n).astype(np.int64))
        yield _rows(["cls", "repeated"], own, sums)

    counted = _dealt_columns(docs, k, parts, True, False).mapInArrow(frugal(count), PACKED)
    return counted.repartition(parts, "to_part").mapInArrow(frugal(total), "cls long, repeated long")


def _no_df(batches):
    """Batches whose df column stands empty for their entries."""
    for b in batches:
        empty = pa.array([b""] * len(b), pa.binary())
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("owners", "sizes", "counts", "h")), empty], names=["owners", "sizes", "counts", "h", "df"])


def candidates(kept: DataFrame, k: int, percent: int, parts: int) -> DataFrame:
    """Edges (a, b) between classes that show a column; each column's classes form a star. kept: (text, cls)."""

    def order(batches):
        owner, size, h, df = _repeated(*_gather(_no_df(batches), U)[:3])
        if len(h):
            cls, first, at = np.unique(owner, return_index=True, return_inverse=True)
            yield _deal(_part_of(mix(owner.view(U)).view(np.int64), parts), at, cls, size[first], h, df.astype(np.uint32), parts)

    def show(batches):
        owner, size, h, df = _gather(batches, U)
        at = np.lexsort((h, df, owner))
        owner, size, h = owner[at], size[at], h[at]
        start = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])) if len(h) else np.zeros(0, np.int64)
        n = np.diff(np.append(start, len(h)))
        length = size[start] - -(-percent * size[start] // 100) + 1  # columns to show, its own alone included
        take = length - (size[start] - n)
        keep = np.arange(len(h)) - np.repeat(start, n) < np.repeat(take, n)
        yield _rows(["x", "y"], h[keep].view(np.int64), owner[keep])

    def meet(batches):
        found = [(b.column("x").to_numpy(), b.column("y").to_numpy()) for b in batches]
        if not found:
            return
        x, y = (np.concatenate(c) for c in zip(*found, strict=True))
        rows, first, head = stars(x, y)
        pairs = np.unique(np.stack([y[rows][~first], head[~first]], axis=1), axis=0)
        yield _rows(["a", "b"], pairs[:, 0].copy(), pairs[:, 1].copy())

    ordered = _dealt_columns(kept, k, parts, False, True).mapInArrow(frugal(order), PACKED)
    shown = ordered.repartition(parts, "to_part").mapInArrow(frugal(show), "x long, y long")
    return shown.repartition(parts, "x").mapInArrow(frugal(meet), "a long, b long").distinct()


def product(sets: list[np.ndarray], side: np.ndarray | None, percent: int) -> np.ndarray:
    """Which pairs of rows (of different sides, if given) reach the similarity, as a symmetric boolean matrix."""
    m = len(sets)
    n = np.array([len(s) for s in sets], dtype=np.int64)
    need = -(-percent * (n[:, None] + n[None, :]) // (100 + percent))
    open_ = ~np.eye(m, dtype=bool) & (need <= np.minimum(n[:, None], n[None, :]))
    if side is not None:
        open_ &= side[:, None] != side[None, :]
    h = np.concatenate(sets)
    row = np.repeat(np.arange(m), n)
    order = np.argsort(h, kind="stable")
    h, row = h[order], row[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = h[1:] != h[:-1]
    col = np.cumsum(new) - 1
    often = np.bincount(col) > 1
    rank = np.cumsum(often) - 1
    keep = often[col]
    col, row = rank[col[keep]], row[keep]
    overlap = np.zeros((m, m), dtype=np.float32)
    rest = np.bincount(row, minlength=m)
    cuts = np.searchsorted(col, np.arange(0, (col[-1] + 1 if len(col) else 0) + COLUMNS, COLUMNS))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        rows = np.flatnonzero(open_.any(axis=1))
        if not len(rows):
            break
        place = np.full(m, -1)
        place[rows] = np.arange(len(rows))
        r, c = row[a:b], col[a:b] - (col[a] if b > a else 0)
        rest -= np.bincount(r, minlength=m)
        live = place[r] >= 0
        block = np.zeros((len(rows), int(c.max()) + 1 if len(c) else 1), dtype=np.float32)
        block[place[r[live]], c[live]] = 1
        overlap[np.ix_(rows, rows)] += block @ block.T
        open_ &= overlap + np.minimum(rest[:, None], rest[None, :]) >= need
    return open_ & (overlap >= need)


def _links(batches, percent):
    """Rows sorted by (comp, i, j): for each row of a block with links its first linked mate and the number of its links."""

    def solve(key, group):
        seen = {}
        for cls, blk, s in group:
            seen.setdefault(cls, (blk, s))
        cls = np.array(list(seen), dtype=np.int64)
        if len(cls) < 2:
            return None
        side = np.array([b for b, _ in seen.values()]) if key[1] != key[2] else None
        linked = product([s for _, s in seen.values()], side, percent)
        label = np.arange(len(cls))
        while True:  # smallest label among a row's links, until none changes
            low = np.minimum(label, np.where(linked, label[None, :], len(cls)).min(axis=1))
            if (low == label).all():
                break
            label = low
        has = linked.any(axis=1)
        return _rows(["a", "b", "links"], cls[has], cls[label[has]], linked.sum(axis=1)[has].astype(np.int64)) if has.any() else None

    key, group = None, []
    for batch in batches:
        cols = [batch.column(c).to_pylist() for c in ("comp", "i", "j", "cls", "blk")]
        for comp, i, j, cls, blk, s in zip(*cols, batch.column("hashes"), strict=True):
            if (comp, i, j) != key:
                if group and (out := solve(key, group)) is not None:
                    yield out
                key, group = (comp, i, j), []
            group.append((cls, blk, np.frombuffer(s.as_py(), dtype=U)))
    if group and (out := solve(key, group)) is not None:
        yield out


def linked_rows(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """doc_id, key, n_shingles, n_links, root (any class of the row's component; null for an empty set) and least (doc_id, key): the component's first row, of (doc_id, key, text)."""
    spark = docs.sparkSession
    rows = written(classes(docs, k))
    parts = max(parallelism(spark), -(-(rows.agg(F.sum("n_shingles")).first()[0] or 0) // ENTRIES))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("least")
    reps = rows.filter("cls IS NOT NULL").groupBy("cls").agg(first, F.first("n_shingles").alias("n"))
    reps = written(reps.withColumn("rep", F.col("least.key")))
    able = repeated_counts(docs, k, parts).join(reps, "cls").filter(F.col("repeated") * 100 >= F.col("n") * percent)
    able = written(able.select("cls", "rep"))
    kept = docs.join(small(able, 24), F.col("key") == F.col("rep")).select("text", "cls")
    near = components(candidates(kept, k, percent, parts)).select(F.col("node").alias("cls"), F.col("root").alias("comp"))
    blocks = near.groupBy("comp").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    near = near.join(blocks, "comp").withColumn("blk", F.pmod(F.xxhash64("cls", F.lit("row")), F.col("blocks")).cast("int"))
    shown = written(able.join(near, "cls"))

    def sets(batches):
        keep = ["cls", "comp", "blocks", "blk"]
        for b in slices(batches):
            found = list(shingle_sets(b.column("text"), k))
            right = pa.array([set_class(s) == c for s, c in zip(found, b.column("cls").to_pylist(), strict=True)], pa.bool_())
            out = pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array([s.tobytes() for s in found], pa.binary())], names=[*keep, "hashes"])
            yield out.filter(right)  # rows of equal keys may differ in text, if hashes meet

    texts = docs.join(small(shown, 48), F.col("key") == F.col("rep"))
    matrix = texts.select("text", "cls", "comp", "blocks", "blk").mapInArrow(frugal(sets), "cls long, comp long, blocks int, blk int, hashes binary")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    matrix = matrix.select("comp", "cls", "blk", "hashes", other.alias("o")).select("comp", F.least("blk", "o").alias("i"), F.greatest("blk", "o").alias("j"), "cls", "blk", "hashes")
    matrix = matrix.repartition(parts, "comp", "i", "j").sortWithinPartitions("comp", "i", "j")
    links = written(matrix.mapInArrow(frugal(lambda b: _links(b, percent)), "a long, b long, links long"))

    # components meet as classes, each of which stands for all its copies; only then rows learn of them
    roots = components(links.select("a", "b"))
    counts = links.groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("n_links"))
    linked = written(roots.join(counts, "node", "left").withColumnRenamed("node", "cls"))
    every = reps.select("cls", "least").join(small(linked, 40), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    joined = every.filter("n_links IS NOT NULL").groupBy("root").agg(F.min("least").alias("lowest"))
    every = written(every.join(small(written(joined), 64), "root", "left").select("cls", "root", "n_links", F.coalesce("lowest", "least").alias("least")))
    return rows.join(small(every, 64), "cls", "left").select("doc_id", "key", "n_shingles", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "root", "least")


def with_keys(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.xxhash64("doc_id", "text").alias("key"), "text")


def join(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links for each document.

    Two documents link when 100 * intersection >= percent * union of their shingle
    sets; n_links counts the other sets linked with a document's own.
    """
    rows = linked_rows(with_keys(docs), k, percent)
    component = F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("least.doc_id"))
    return rows.select("doc_id", "n_shingles", component.alias("component_id"), "n_links")


def keep_first(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group, with the columns of docs: the one with the smallest doc_id, those without last.

    Documents without words stay, as they are linked with nothing; of rows alike in
    doc_id and text one stays, and so do different texts of one doc_id that nothing links.
    """
    found = written(linked_rows(with_keys(docs), k, percent))
    key, row = fresh(docs, "_stay", "_key")
    first = F.col("root").isNotNull() & (F.col("key") == F.col("least.key")) & F.col("doc_id").eqNullSafe(F.col("least.doc_id"))
    stay = written(found.filter(first).select(F.col("key").alias(key)).distinct())
    rows = docs.withColumn(row, F.xxhash64("doc_id", "text"))
    kept = rows.join(small(stay, 8), F.col(row) == F.col(key)).drop(key)
    if found.filter(first).count() > stay.count():
        kept = kept.dropDuplicates([row])
    bare = found.filter("root IS NULL").select(F.col("key").alias(key)).distinct()
    empty = rows.join(small(written(bare), 8), F.col(row) == F.col(key), "left_semi")
    return kept.unionByName(empty).drop(row)
