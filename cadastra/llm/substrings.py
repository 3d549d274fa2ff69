"""Substring dedup over words, by fixed-block anchors.

Every document's words are cut into non-overlapping reference blocks of
(window + 1) // 2 words, so each window of `window` words holds a whole block.
1. Index and probe: blocks (with their places) and all rolling windows of a block's
   length (as 32-bit remainders of their hashes) meet in hash partitions. A block that
   a window at another place also has is a hit. Rolling windows travel packed, at most
   twice a batch each, so frequent passages stay small.
2. Extend: every window that holds a hit block is hashed whole, and the hashes meet
   in partitions; windows whose sequence starts at two places or more are repeats.
   Runs of them are the maximal exact repeats.
A repeated passage shows its block as a hit wherever it starts, so none is missed;
false hits of step 1 end in step 2, which compares 64-bit hashes of whole windows.

Edge cases: a null text has no words; texts shorter than a window keep all words;
equal rows repeat each other; a repeated or null doc_id does no harm, as rows are
known by a hash of doc_id and text; an empty table gives an empty result. Only doc_id
and text are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadastra.llm.tables import BROADCAST_BYTES, parallelism, written
from cadastra.llm.text import U, Rolling, chunks, frugal, hash_spans, mix, slices


#: Bytes of text for each partition in which hashes meet.
PART = 16 << 20


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text (null as empty) and a row's key."""
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("key", F.xxhash64("doc_id", "text"))


def sized(df: DataFrame, column: str) -> DataFrame:
    """A written table, with a broadcast hint if its rows and the bytes of its binary column fit the bound."""
    n, size = df.agg(F.count(F.lit(1)), F.sum(F.octet_length(column))).first()
    return F.broadcast(df) if 16 * n + (size or 0) <= BROADCAST_BYTES else df


def word_hashes(texts: pa.Array):
    """(first row, first word of each text, word hashes) of each chunk of a batch."""
    for c in chunks(texts):
        starts, ends, first = c.words()
        yield c, starts, ends, first, hash_spans(c.data, starts, ends)


def split(h: np.ndarray, parts: int) -> np.ndarray:
    """Bounds of the hash partitions in sorted hashes."""
    p = ((h >> U(32)) * U(parts)) >> U(32)
    return np.searchsorted(p, np.arange(parts + 1, dtype=U))


def inside(first: np.ndarray, n_words: int, window: int, least: int) -> np.ndarray:
    """Which starts 0 .. n_words - window lie with their window inside one text of `least` words or more."""
    ok = np.zeros(max(0, n_words - window + 1), dtype=bool)
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= least:
            ok[a : b - window + 1] = True
    return ok


def hit_blocks(docs: DataFrame, window: int, parts: int) -> DataFrame:
    """(key, blocks): the numbers of a row's reference blocks that also occur at another place, as packed int32."""
    size = (window + 1) // 2

    def show(batches):
        rolling = Rolling()
        for b in batches:
            keys = b.column("key").to_numpy()
            probes, refs, owners, numbers = [], [], [], []
            for c, _, _, first, words in word_hashes(b.column("text")):
                h = rolling(words, size)
                probes.append(h[inside(first, len(words), size, window)])
                for i in range(c.n):
                    n = first[i + 1] - first[i]
                    if n >= window:
                        at = np.arange(n // size)
                        refs.append(h[first[i] + at * size])
                        owners.append(np.full(len(at), keys[c.first + i]))
                        numbers.append(at.astype(np.int32))
            if not refs:
                continue
            probe = np.sort(np.concatenate(probes))
            twice = np.ones(len(probe), dtype=bool)
            twice[2:] = probe[2:] != probe[:-2]  # two of a kind tell as much as more
            probe = probe[twice]
            ref, owner, number = np.concatenate(refs), np.concatenate(owners), np.concatenate(numbers)
            order = np.argsort(ref, kind="stable")
            ref, owner, number = ref[order], owner[order], number[order]
            pb, rb = split(probe, parts), split(ref, parts)
            low = lambda x: x.astype(np.uint32).tobytes()
            rows = [(p, low(probe[pb[p] : pb[p + 1]]), low(ref[rb[p] : rb[p + 1]]), owner[rb[p] : rb[p + 1]].tobytes(), number[rb[p] : rb[p + 1]].tobytes()) for p in range(parts)]
            cols = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *(pa.array(x, pa.binary()) for x in cols[1:])], names=["p", "probe", "ref", "owner", "number"])

    def meet(batches):
        names, kinds = ("probe", "ref", "owner", "number"), (np.uint32, np.uint32, np.int64, np.int32)
        found = {n: [] for n in names}
        for b in batches:
            for n, kind in zip(names, kinds, strict=True):
                found[n] += [np.frombuffer(x.as_py(), dtype=kind) for x in b.column(n)]
        if not found["ref"]:
            return
        probe, ref, owner, number = (np.concatenate(found[n]) for n in names)
        # several hash partitions may share a task; a block of another one is a false hit at worst
        probe.sort()
        again = np.unique(probe[1:][probe[1:] == probe[:-1]])
        at = np.minimum(np.searchsorted(again, ref), max(0, len(again) - 1))
        hit = again[at] == ref if len(again) else np.zeros(len(ref), dtype=bool)
        yield pa.RecordBatch.from_arrays([pa.array(owner[hit]), pa.array(number[hit])], names=["key", "number"])

    shown = docs.select("key", "text").mapInArrow(frugal(show), "p int, probe binary, ref binary, owner binary, number binary")
    hits = shown.repartition(parts, "p").mapInArrow(frugal(meet), "key long, number int")
    return hits.groupBy("key").agg(F.collect_set("number").alias("numbers"))


def _runs(starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """First and end of the unions of [s, s + length) over sorted distinct starts."""
    if not len(starts):
        return starts, starts
    cut = np.flatnonzero(starts[1:] > starts[:-1] + length) + 1
    return starts[np.concatenate([[0], cut])], starts[np.concatenate([cut - 1, [len(starts) - 1]])] + length


def repeats(docs: DataFrame, window: int) -> DataFrame:
    """(key, spans): a row's words that repeated windows cover, as packed int32 pairs (first, end). Rows without any are absent."""
    size = (window + 1) // 2
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(parallelism(docs.sparkSession), -(-total // PART))

    def pack(batches):
        for b in batches:
            packed = [np.array(x.as_py(), dtype=np.int32).tobytes() for x in b.column("numbers")]
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(packed, pa.binary())], names=["hit_key", "blocks"])

    hits = written(hit_blocks(docs, window, parts).mapInArrow(frugal(pack), "hit_key long, blocks binary"))

    def extend(batches):
        rolling = Rolling()
        for b in batches:
            keys, blocks = b.column("key").to_numpy(), b.column("blocks").to_pylist()
            hashes, rows, places = [], [], []
            for c, _, _, first, words in word_hashes(b.column("text")):
                h = rolling(words, window)
                for i in range(c.n):
                    last = first[i + 1] - first[i] - window  # the last window's start
                    if last < 0:
                        continue
                    number = np.frombuffer(blocks[c.first + i], dtype=np.int32).astype(np.int64)
                    near = (number[:, None] * size - np.arange(window - size + 1)[None, :]).ravel()
                    near = np.unique(near[(near >= 0) & (near <= last)])
                    hashes.append(h[first[i] + near])
                    rows.append(np.full(len(near), c.first + i, dtype=np.int32))
                    places.append(near.astype(np.int32))
            if not hashes:
                continue
            h, row, place = np.concatenate(hashes), np.concatenate(rows), np.concatenate(places)
            order = np.argsort(h, kind="stable")
            h, row, place = h[order], row[order], place[order]
            at = split(h, parts)
            out = [(p, h[at[p] : at[p + 1]].tobytes(), keys[row[at[p] : at[p + 1]]].tobytes(), place[at[p] : at[p + 1]].tobytes()) for p in range(parts) if at[p] < at[p + 1]]
            cols = list(zip(*out, strict=True)) if out else [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *(pa.array(x, pa.binary()) for x in cols[1:])], names=["p", "h", "key", "place"])

    def agree(batches):
        found = [[np.frombuffer(x.as_py(), dtype=k) for x in b.column(n)] for b in batches for n, k in (("h", U), ("key", np.int64), ("place", np.int32))]
        if not found:
            return
        h, key, place = (np.concatenate([y for x in found[i::3] for y in x] or [np.zeros(0, k)]) for i, k in enumerate((U, np.int64, np.int32)))
        order = np.argsort(h, kind="stable")
        h, key, place = h[order], key[order], place[order]
        same = h[1:] == h[:-1]
        again = np.zeros(len(h), dtype=bool)
        again[1:] |= same
        again[:-1] |= same
        key, place = key[again], place[again]
        to = mix(key.view(U))
        order = np.argsort(to, kind="stable")
        at = split(to[order], parts)
        key, place = key[order], place[order]
        out = [(q, key[at[q] : at[q + 1]].tobytes(), place[at[q] : at[q + 1]].tobytes()) for q in range(parts) if at[q] < at[q + 1]]
        cols = list(zip(*out, strict=True)) if out else [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *(pa.array(x, pa.binary()) for x in cols[1:])], names=["q", "key", "place"])

    candidates = docs.join(sized(hits, "blocks"), F.col("key") == F.col("hit_key")).select("key", "text", "blocks")
    windows = candidates.mapInArrow(frugal(extend), "p int, h binary, key binary, place binary").repartition(parts, "p")
    found = windows.mapInArrow(frugal(agree), "q int, key binary, place binary").repartition(parts, "q")

    def unite(batches):
        keys, places = [], []
        for b in batches:
            keys += [np.frombuffer(x.as_py(), dtype=np.int64) for x in b.column("key")]
            places += [np.frombuffer(x.as_py(), dtype=np.int32) for x in b.column("place")]
        if not keys:
            return
        key, place = np.concatenate(keys), np.concatenate(places)
        order = np.lexsort((place, key))
        key, place = key[order], place[order]
        cut = np.flatnonzero(np.diff(key)) + 1
        spans = []
        for x in np.split(place, cut):
            first, end = _runs(x[np.concatenate([[True], x[1:] != x[:-1]])], window)
            spans.append(np.stack([first, end], axis=1).astype(np.int32).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(key[np.concatenate([[0], cut])]), pa.array(spans, pa.binary())], names=["span_key", "spans"])

    return written(found.mapInArrow(frugal(unite), "span_key long, spans binary"))


def dedup(docs: DataFrame, window: int = 35) -> DataFrame:
    """doc_id, n_words, n_removed and kept (the words that stay, joined by one space) of each document."""
    docs = keyed(docs)
    kind = dict(docs.dtypes)["doc_id"]

    def cut(batches):
        for b in slices(batches):
            spans = b.column("spans").to_pylist()
            n_words, n_removed, kept = [], [], []
            for c in chunks(b.column("text")):
                starts, ends, first = c.words()
                raw = c.data.tobytes()
                for i in range(c.n):
                    lo, hi = first[i], first[i + 1]
                    stay = np.ones(hi - lo, dtype=bool)
                    for a, e in np.frombuffer(spans[c.first + i] or b"", dtype=np.int32).reshape(-1, 2):
                        stay[a:e] = False
                    s, e = starts[lo:hi][stay].tolist(), ends[lo:hi][stay].tolist()
                    n_words.append(int(hi - lo))
                    n_removed.append(int(hi - lo) - len(s))
                    kept.append(b" ".join([raw[x:y] for x, y in zip(s, e, strict=True)]))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    covered = docs.join(sized(repeats(docs, window), "spans"), F.col("key") == F.col("span_key"), "left").select("doc_id", "text", "spans")
    return covered.mapInArrow(frugal(cut), f"doc_id {kind}, n_words long, n_removed long, kept string")
