"""Ranked lexical search of all documents for each item, by dual trees.

Terms are maximal runs of ASCII letters, digits and characters beyond ASCII; only A-Z are
lower-cased. N documents hold a term, L terms in all (with repeats), a document n of them.
A term's weight is w = floor(1000 ln((2N + 2) / (2 df + 1))); a document's gain for it is
(10^9 tf) div (1000 tf + 8 m) with m = 10 + (90 n N) div L; a score is the sum of w times
gain over the item's terms. All of it is whole and below 2^53, so doubles add it exactly.

How it runs:
1. Items come in blocks of about BLOCK bytes of text; a block (its terms, its tree) is what
   tasks are given, so it is bounded however many items there are. For each block:
2. Documents are tokenised once into a table of packed rows: each text's length and how often
   it has which of the block's terms.
3. N, L and the terms' df are summed over that table.
4. The items form a tree, and in each task so do some thousands of documents at a time. A node
   holds for each term the largest weight (of its items) or gain (of its documents), so the
   product of two nodes bounds the score of every item and document under them. Both trees are
   descended together; a pair of nodes goes where its bound is below the weakest kth score
   among its items, and whole batches of items and documents with it. Nothing else goes, so
   the result is exact.
5. The kth scores start from those of each SEED-th document, which are never too high, and
   rise as documents are met. A task returns at most k documents for an item.

Edge cases: null or termless items have no rows; null and termless documents count nowhere and
are never found; scores of 0 are not returned; ties go to the smaller doc_id, null doc_ids last;
repeated documents are documents of their own; repeated items (same id and text) are one item;
two texts of one item_id are ranked apart; empty tables give an empty result. Only item_id,
doc_id and text are read. Terms are known by 64-bit hashes.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadastra.llm.pitman_yor import batch, shape, squeeze, steps, unsqueeze, unsteps
from cadastra.llm.tables import discard, written
from cadastra.llm.text import chunks, frugal, hash_spans

#: Bytes of item text in a block; one document of so many gives the first kth scores.
BLOCK, SEED = 1 << 20, 32
#: Documents in a leaf of their tree, children of a node of either tree, documents in a tree at most, bytes of its maxima.
LEAF, FAN, DOCS, MAXIMA = 32, 4, 8192, 32 << 20
#: Leaves of documents that are scored before the kth score is looked at again.
SLAB = 8

APART = np.ones(256, dtype=bool)
APART[np.r_[0x30:0x3A, 0x41:0x5B, 0x61:0x7B, 0x80:0x100]] = False


def terms(texts: pa.Array):
    """For each chunk of texts: its first row, hashes of all its terms and each row's first term."""
    for c in chunks(texts, lower=True):
        starts, ends, first = c.words(APART)
        yield c.first, hash_spans(c.data, starts, ends), first


CODED = shape(docs="l", terms="l", n="b", starts="b", at="b", tf="b")


def coded(docs: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """Packed rows of documents: how many have terms and how many terms they have; of those with a term of the sorted vocabulary the lengths, terms and counts."""
    kind, size = dict(docs.dtypes)["doc_id"], len(vocabulary)

    @frugal
    def run(batches):
        for b in batches:
            for row, h, first in terms(b.column("text")):
                n = np.diff(first)
                at = np.minimum(np.searchsorted(vocabulary, h), size - 1)
                hit = np.flatnonzero(vocabulary[at] == h)
                key, tf = np.unique(np.repeat(np.arange(len(n)), n)[hit] * size + at[hit], return_counts=True)
                own, starts = np.unique(key // size, return_index=True)
                head = [int((n > 0).sum()), int(n.sum()), squeeze(n[own]), steps(np.append(starts, len(key))), squeeze(key % size), squeeze(tf)]
                columns = [pa.array([x], f.type) for x, f in zip(head, CODED[0], strict=True)]
                ids = b.column("doc_id").take(pa.array(own + row))
                yield pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), ids)], names=[*CODED[0].names, "ids"])

    return written(docs.select("doc_id", "text").mapInArrow(run, f"{CODED[1]}, ids array<{kind}>"), codec="zstd")


def document_counts(texts: DataFrame, size: int) -> np.ndarray:
    """In how many documents each of so many terms is."""
    schema, spark = shape(term="l", n="l")

    def run(batches):
        df = np.zeros(size, dtype=np.int64)
        for b in batches:
            for x in b.column("at"):
                np.add.at(df, unsqueeze(x.as_py()), 1)
        at = np.flatnonzero(df)
        yield batch(schema, list(zip(at.tolist(), df[at].tolist(), strict=True)))

    df = np.zeros(size, dtype=np.int64)
    for r in texts.select("at").mapInArrow(run, spark).groupBy("term").agg(F.sum("n").alias("n")).collect():  # a row for each term of the block
        df[r["term"]] = r["n"]
    return df


class Node:
    """Items of a block: the terms of any of them, each with its largest weight; children, if they are several."""

    def __init__(self, items: list[int], at: np.ndarray, weight: np.ndarray, children=()):
        self.items, self.at, self.weight, self.children = items, at, weight, children


def item_tree(items: list[np.ndarray], weight: np.ndarray) -> Node | None:
    """A tree over the items that have terms; neighbours share their weightiest terms."""
    leaves = [Node([i], x, weight[x]) for i, x in enumerate(items) if len(x)]
    leaves.sort(key=lambda leaf: sorted(zip(-leaf.weight, leaf.at, strict=True))[:3])
    while len(leaves) > 1:
        groups, leaves = [leaves[i : i + FAN] for i in range(0, len(leaves), FAN)], []
        for g in groups:
            at = np.unique(np.concatenate([x.at for x in g]))
            leaves.append(Node([i for x in g for i in x.items], at, weight[at], g) if len(g) > 1 else g[0])
    return leaves[0] if leaves else None


class Documents:
    """Some thousands of documents: sparse gains by document, and for each level of their tree dense maxima by node (level 0: leaves)."""

    def __init__(self, ids: list, n: np.ndarray, counts: np.ndarray, at: np.ndarray, tf: np.ndarray, weight: np.ndarray, total: tuple[int, int]):
        m = 10 + (90 * n * total[0]) // total[1]
        starts = np.cumsum(counts) - counts
        gain = (1_000_000_000 * tf) // (1000 * tf + 8 * np.repeat(m, counts))
        # documents that owe most to the same term share leaves, then those of about the same length
        owed = weight[at] * gain
        doc = np.repeat(np.arange(len(n)), counts)
        best = np.maximum.reduceat(owed, starts)
        lead = np.minimum.reduceat(np.where(owed == best[doc], at, len(weight)), starts)
        order = np.lexsort((m, lead))
        self.ids = [ids[i] for i in order]
        self.counts = counts[order]
        self.starts = np.append(0, np.cumsum(self.counts))
        pick = np.repeat(starts[order] - self.starts[:-1], self.counts) + np.arange(len(at))
        self.at, self.gain = at[pick], gain[pick].astype(np.float64)
        leaf = np.repeat(np.arange(len(n)) // LEAF, self.counts)
        maxima = np.zeros((-(-len(n) // LEAF), len(weight)))
        key = leaf * len(weight) + self.at
        by = np.argsort(key, kind="stable")
        first = np.flatnonzero(np.diff(key[by], prepend=-1))
        maxima.ravel()[key[by][first]] = np.maximum.reduceat(self.gain[by], first)
        self.levels = [maxima]
        while len(maxima) > 1:
            maxima = np.maximum.reduceat(maxima, np.arange(0, len(maxima), FAN), axis=0)
            self.levels.append(maxima)

    def scores(self, leaves: np.ndarray, weight: np.ndarray):
        """Numbers and scores of the leaves' documents, given the item's weight of every term (0: not its term)."""
        for leaf in leaves.tolist():
            lo, hi = leaf * LEAF, min((leaf + 1) * LEAF, len(self.counts))
            a, b = self.starts[lo], self.starts[hi]
            yield lo, np.add.reduceat(self.gain[a:b] * weight[self.at[a:b]], self.starts[lo:hi] - a)


class Search:
    """The best documents so far of each item of a block."""

    def __init__(self, tree: Node, items: int, size: int, k: int, floor: np.ndarray):
        self.tree, self.k = tree, k
        self.least = floor.copy()  # what a document must reach to be among an item's k best
        self.best: list[list] = [[] for _ in range(items)]  # (-score, doc_id is null, doc_id)
        self.weight = np.zeros(size)

    def meet(self, docs: Documents) -> None:
        self.visit(docs, self.tree, len(docs.levels) - 1, np.zeros(1, dtype=np.int64))

    def visit(self, docs: Documents, node: Node, level: int, nodes: np.ndarray) -> None:
        bound = docs.levels[level][nodes][:, node.at] @ node.weight
        keep = bound >= self.least[node.items].min()
        nodes, bound = nodes[keep], bound[keep]
        if not len(nodes):
            return
        if level and (not node.children or len(nodes) < len(node.items)):
            below = (nodes[:, None] * FAN + np.arange(FAN)).ravel()
            self.visit(docs, node, level - 1, below[below < len(docs.levels[level - 1])])
        elif node.children:
            for child in node.children:
                self.visit(docs, child, level, nodes)
        else:
            self.judge(docs, node, nodes, bound)

    def judge(self, docs: Documents, node: Node, leaves: np.ndarray, bound: np.ndarray) -> None:
        item = node.items[0]
        self.weight[node.at] = node.weight
        order = np.argsort(-bound, kind="stable")  # the kth score rises early
        for i in range(0, len(order), SLAB):
            slab = order[i : i + SLAB]
            slab = slab[bound[slab] >= self.least[item]]
            if not len(slab):
                break
            found = self.best[item]
            for lo, score in docs.scores(leaves[slab], self.weight):
                for j in np.flatnonzero(score >= self.least[item]).tolist():
                    at = docs.ids[lo + j]
                    found.append((-int(score[j]), at is None, at))
            found.sort(key=lambda x: (x[0], x[1], x[2] if x[2] is not None else 0))
            del found[self.k :]
            if len(found) == self.k:
                self.least[item] = max(self.least[item], -found[-1][0])
        self.weight[node.at] = 0


def searched(texts: DataFrame, tree: Node, items: int, weight: np.ndarray, total: tuple[int, int], k: int, floor: np.ndarray, stride: int = 1) -> DataFrame:
    """(item, doc_id, score) of at most k documents a task for each item; stride: only each so many-th document is met."""
    kind = dict(texts.dtypes)["ids"].removeprefix("array<").removesuffix(">")
    most = max(LEAF, min(DOCS, MAXIMA // (8 * len(weight)) * LEAF))

    @frugal
    def run(batches):
        search, held, n = Search(tree, items, len(weight), k, floor), [], 0

        def meet():
            ids = [x for part in held for x in part[0]]
            if ids:
                search.meet(Documents(ids, *(np.concatenate([part[i] for part in held]) for i in range(1, 5)), weight, total))
            held.clear()

        for b in batches:
            for row in range(b.num_rows):
                ids = b.column("ids")[row].as_py()
                lengths, starts, at, tf = (read(b.column(c)[row].as_py()) for c, read in (("n", unsqueeze), ("starts", unsteps), ("at", unsqueeze), ("tf", unsqueeze)))
                counts = np.diff(starts)
                if stride > 1:
                    own = np.arange(0, len(ids), stride)
                    entries = np.flatnonzero(np.repeat(np.arange(len(ids)) % stride == 0, counts))
                    ids, lengths, counts, at, tf = [ids[i] for i in own], lengths[own], counts[own], at[entries], tf[entries]
                    starts = np.append(0, np.cumsum(counts))
                for lo in range(0, len(ids), most):
                    hi = min(lo + most, len(ids))
                    if n + hi - lo > most:
                        meet()
                        n = 0
                    held.append((ids[lo:hi], lengths[lo:hi], counts[lo:hi], at[starts[lo] : starts[hi]], tf[starts[lo] : starts[hi]]))
                    n += hi - lo
        meet()
        rows = [(i, x[2], -x[0]) for i, best in enumerate(search.best) for x in best]
        columns = list(zip(*rows, strict=True)) if rows else [(), (), ()]
        own = pa.array(columns[1]).cast(id_type) if rows and any(x is not None for x in columns[1]) else pa.nulls(len(rows), id_type)
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), own, pa.array(columns[2], pa.int64())], names=["item", "doc_id", "score"])

    from pyspark.sql.pandas.types import to_arrow_type

    id_type = to_arrow_type(texts.schema["ids"].dataType.elementType)
    return texts.mapInArrow(run, f"item int, doc_id {kind}, score long")


def best(found: DataFrame, k: int, *keys: str) -> DataFrame:
    """The k best rows of each item, ranked."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank (from 1), doc_id and score of the k best documents of each item."""
    spark = docs.sparkSession
    items = written(items.select("item_id", F.coalesce("text", F.lit("")).alias("text")).distinct())
    blocks = max(1, -(-(items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BLOCK))
    items = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))
    kind, doc_kind = dict(items.dtypes)["item_id"], dict(docs.dtypes)["doc_id"]
    found = []
    for block in range(blocks):
        rows = items.filter(F.col("block") == block).select("item_id", "text").orderBy("item_id", "text").collect()  # about BLOCK bytes
        hashes = [np.unique(h[first[i] : first[i + 1]]) for _, h, first in terms(pa.array([r["text"] for r in rows], pa.string())) for i in range(len(first) - 1)]
        vocabulary = np.unique(np.concatenate([np.zeros(0, dtype=np.uint64), *hashes]))
        if not len(vocabulary):
            continue
        texts = coded(docs, vocabulary)
        total = tuple(x or 0 for x in texts.agg(F.sum("docs"), F.sum("terms")).first())
        df = document_counts(texts, len(vocabulary))
        weight = np.floor(1000 * np.log((2 * total[0] + 2) / (2 * df + 1)))
        tree = item_tree([np.searchsorted(vocabulary, h) for h in hashes], weight)
        look = functools.partial(searched, texts, tree, len(rows), weight, total, k)
        floor = np.ones(len(rows))
        for r in best(look(floor, stride=SEED), k, "item").filter(F.col("rank") == k).collect():  # a row an item of the block
            floor[r["item"]] = r["score"]
        names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(rows)], f"item int, item_id {kind}")
        found.append(written(best(look(floor), k, "item").join(F.broadcast(names), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")))
        discard(texts)
    if not found:
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id {doc_kind}, score long")
    return functools.reduce(DataFrame.unionByName, found)


def oracle(k: int = 10) -> str:
    """DuckDB SQL for the rows of search over documents and benchmark items with distinct ids."""
    words = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
    return f"""
WITH d AS (SELECT doc_id, {words} AS t FROM documents),
s AS (SELECT count(*) FILTER (len(t) > 0) AS n_docs, sum(len(t))::BIGINT AS n_terms FROM d),
tf AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(t) AS n, unnest(t) AS term FROM d) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tf, s GROUP BY term, n_docs),
i AS (SELECT item_id, unnest(list_distinct({words})) AS term FROM benchmark),
x AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_terms))))::BIGINT AS score FROM i JOIN w USING (term) JOIN tf USING (term), s GROUP BY 1, 2),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM x WHERE score > 0)
SELECT * FROM r WHERE rank <= {k}"""
