"""Suffix-array dedup over bytes.

Finds every `window`-byte string that starts at two places or more, in the same
document or another, without sorting the corpus as a whole:

1. Each window is known by its smallest 16-byte gram (by hash, leftmost on ties) and
   by the context on the gram's longer side, half a window or more. Equal windows
   agree in both. Runs of windows with the same gram and side make one chunk of text.
2. Chunks whose gram and context occur once hold no repeat. Of the others, each
   different chunk of a context goes, once and with its number of copies, to the
   partition of its context.
3. There a suffix array over the partition's chunks is built in two stages: suffixes
   not greater than their successors by their first byte are sorted directly; the
   others are induced by scanning the buckets in order. Adjacent common prefixes of
   `window` bytes are repeats, and so are all windows of a chunk with copies. Contexts
   whose chunks exceed MOST bytes go by another way: the hashes of their windows are
   counted by a shuffle on the hash, so that they spread over all tasks.
4. The repeats return to the documents as spans.

Edge cases: a null text counts as empty; texts shorter than a window stay whole;
matches never cross documents; equal rows repeat each other; rows are known by a hash
of doc_id and text, so repeated or null doc_ids do no harm; an empty table gives an
empty result. Cuts may fall inside a character, so what stays is binary. Only doc_id
and text are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadastra.llm.substrings import _runs, keyed, sized
from cadastra.llm.tables import parallelism, small, written
from cadastra.llm.text import U, Rolling, chunks, frugal, hash_spans, mix, slices

#: Bytes after which a suffix array is built, and the most of a context's chunks, which stay together: beyond, window hashes are counted by a shuffle instead.
BLOCK, MOST = 1 << 20, 8 << 20
#: A byte that UTF-8 never has: it ends each chunk.
END = 0xFF
TABLE = mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))


def _words_at(data: np.ndarray, order: str) -> np.ndarray:
    """The 8 bytes from each position on as one number (past the end: END)."""
    padded = np.full(len(data) + 8, END, dtype=np.uint8)
    padded[: len(data)] = data
    return np.ndarray(shape=(len(data),), dtype=f"{order}u8", buffer=padded.data, strides=(1,)).astype(U)


def gram_length(window: int) -> int:
    return min(16, max(1, window // 4))


def smallest(x: np.ndarray, n: int) -> np.ndarray:
    """The minimum of each n consecutive values."""
    rows = -(-len(x) // n)
    a = np.full(rows * n, np.iinfo(U).max, dtype=U)
    a[: len(x)] = x
    a = a.reshape(rows, n)
    up = np.minimum.accumulate(a, axis=1).ravel()
    down = np.minimum.accumulate(a[:, ::-1], axis=1)[:, ::-1].ravel()
    last = len(x) - n + 1
    return np.minimum(down[:last], up[n - 1 : n - 1 + last])


def anchors(c, window: int):
    """Chunks of windows of one piece of text: (row, first window, windows, context hash, content hash)."""
    g = gram_length(window)
    half = (window - g) // 2
    if len(c.data) < window:
        return None
    lengths = np.diff(c.offs)
    ok = np.zeros(len(c.data) + 1, dtype=np.int32)
    has = lengths >= window
    np.add.at(ok, c.offs[:-1][has], 1)
    np.add.at(ok, c.offs[1:][has] - window + 1, -1)
    i = np.flatnonzero(np.cumsum(ok)[: len(c.data) - window + 1] > 0)
    if not len(i):
        return None
    w = _words_at(c.data, "<")
    keep = lambda x, n: x if n >= 8 else x & U((1 << (8 * n)) - 1)
    n = len(c.data) - g + 1
    h = keep(w[:n], g)
    if g > 8:
        h = h ^ mix(keep(w[8 : 8 + n], g - 8) + U(1))
    h = (mix(h) & U(0xFFFFFFFF00000000)) | np.arange(n, dtype=U)
    p = (smallest(h, window - g + 1)[i] & U(0xFFFFFFFF)).astype(np.int64)
    left = p - i >= half
    cut = np.flatnonzero((p[1:] != p[:-1]) | (left[1:] != left[:-1]) | (i[1:] != i[:-1] + 1)) + 1
    a = np.concatenate([[0], cut])
    b = np.concatenate([cut, [len(i)]]) - 1
    first, last, p, left = i[a], i[b], p[a], left[a]
    context = hash_spans(c.data, np.where(left, p - half, p), np.where(left, p + g, p + g + half))
    context = mix(context ^ left.astype(U))
    content = hash_spans(c.data, first, last + window)
    row = np.searchsorted(c.offs, first, side="right") - 1
    return row, first - c.offs[row], last - first + 1, context, content


def _ties(same: np.ndarray) -> np.ndarray:
    """Places in the order that are tied with the one before (same) or after."""
    tied = same.copy()
    tied[:-1] |= same[1:]
    return np.flatnonzero(tied)


def _refine(o: np.ndarray, same: np.ndarray, idx: np.ndarray, key: np.ndarray) -> None:
    """Sorts the tied places idx of the order o by key, group by group, and marks which stay tied."""
    group = np.cumsum(~same[idx]) - 1
    differ = np.flatnonzero((key[1:] != key[:-1]) & (group[1:] == group[:-1])) + 1
    if not len(differ):
        return
    bad = np.zeros(group[-1] + 1, dtype=bool)
    bad[group[differ]] = True
    sub = bad[group]
    at, k, g = idx[sub], key[sub], group[sub]
    order = np.lexsort((k, g))
    o[at], k = o[at[order]], k[order]
    same[at[1:]] = (g[1:] == g[:-1]) & (k[1:] == k[:-1])


def direct_sort(data: np.ndarray, words: np.ndarray, blocks: np.ndarray, which: np.ndarray, depth: int) -> np.ndarray:
    """The positions `which` in the order of their suffixes' first `depth` bytes at least.

    Most significant bytes first, 8 at a time; 64 bytes in which all of a group agree are passed over by hash.
    """
    read = lambda x, at: x[np.minimum(at, len(x) - 1)]
    o = which[np.argsort(words[which], kind="stable")]
    same = np.zeros(len(o), dtype=bool)
    same[1:] = words[o[1:]] == words[o[:-1]]
    for far in range(8, depth, 64):
        idx = _ties(same)
        if not len(idx):
            break
        b = read(blocks, o[idx] + far)
        group = np.cumsum(~same[idx]) - 1
        differ = np.flatnonzero((b[1:] != b[:-1]) & (group[1:] == group[:-1])) + 1
        open_ = np.zeros(group[-1] + 1, dtype=bool)
        open_[group[differ]] = True
        idx = idx[open_[group]]
        for off in range(far, far + 64, 8):
            if not len(idx):
                break
            _refine(o, same, idx, read(words, o[idx] + off))
            tied = same[idx].copy()
            tied[:-1] |= same[idx[1:]] & (idx[1:] == idx[:-1] + 1)
            idx = idx[tied]
    return o


def suffix_array(data: np.ndarray, words: np.ndarray, blocks: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in order (as far as `depth` bytes tell), in two stages."""
    n = len(data)
    after = np.full(n, END, dtype=np.uint8)
    after[:-1] = data[1:]
    greater = data > after  # than their successors: induced
    direct = direct_sort(data, words, blocks, np.flatnonzero(~greater), depth)
    sa = np.full(n, -1, dtype=np.int64)
    ends = np.cumsum(np.bincount(data, minlength=256))
    n_direct = np.bincount(data[direct], minlength=256)
    heads = np.concatenate([[0], ends[:-1]])
    at = 0
    for c in range(256):  # in a bucket the induced ones, being smaller, stand before the direct ones
        sa[ends[c] - n_direct[c] : ends[c]] = direct[at : at + n_direct[c]]
        at += n_direct[c]
    free = heads.copy()
    for c in range(256):
        before = sa[heads[c] : ends[c]] - 1
        before = before[before >= 0]
        before = before[data[before] > c]
        if len(before):
            ch = data[before]
            before = before[np.argsort(ch, kind="stable")]
            got = np.bincount(ch, minlength=256)
            where = np.repeat(free - (np.cumsum(got) - got), got) + np.arange(len(before))
            sa[where] = before
            free += got
    return sa


def common(words: np.ndarray, blocks: np.ndarray, i: np.ndarray, j: np.ndarray, depth: int) -> np.ndarray:
    """Whether the suffixes at i and j have a common prefix of `depth` bytes."""
    eq, at = np.ones(len(i), dtype=bool), np.arange(len(i))
    off = 0
    while off < depth and len(at):
        step = 64 if depth - off >= 64 else 8 if depth - off >= 8 else depth - off
        x = blocks if step == 64 else words
        a, b = x[i[at] + off], x[j[at] + off]
        if step < 8:
            a, b = a & U((1 << (8 * step)) - 1), b & U((1 << (8 * step)) - 1)
        ok = a == b
        eq[at[~ok]] = False
        at = at[ok]
        off += step
    return eq


def repeated_windows(texts: list[bytes], copies: list[int], window: int) -> list[np.ndarray]:
    """For each chunk of text which of its windows also start elsewhere in the chunks (or in its copies)."""
    data = np.frombuffer(bytes([END]).join(texts) + bytes([END]), dtype=np.uint8)
    sizes = np.array([len(t) for t in texts])
    starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    rolling = Rolling()
    again = np.zeros(len(data), dtype=bool)
    if len(data) > MOST:
        h = rolling(TABLE[data], window)
        at = np.concatenate([np.arange(s, s + n - window + 1) for s, n in zip(starts, sizes, strict=True)])
        _, inverse, count = np.unique(h[at], return_inverse=True, return_counts=True)
        again[at] = count[inverse] > 1
    else:
        words = _words_at(data, ">")
        blocks = rolling(TABLE[np.concatenate([data, np.full(63, END, np.uint8)])], 64)
        sa = suffix_array(data, words, blocks, window)
        is_window = np.zeros(len(data), dtype=np.int32)
        is_window[starts] += 1
        np.add.at(is_window, starts + sizes - window + 1, -1)
        is_window = np.cumsum(is_window) > 0
        pair = np.flatnonzero(is_window[sa[1:]] & is_window[sa[:-1]])
        i, j = sa[pair], sa[pair + 1]
        little = _words_at(data, "<")
        eq = common(little, blocks, i, j, window)
        again[i[eq]] = True
        again[j[eq]] = True
    out = []
    for s, n, m in zip(starts, sizes, copies, strict=True):
        flags = again[s : s + n - window + 1]
        out.append(np.ones_like(flags) if m > 1 else flags)
    return out


def window_hashes(texts: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text, place) of each window of the texts."""
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    sizes = np.array([len(t) for t in texts])
    n = sizes - window + 1
    which = np.repeat(np.arange(len(texts)), n)
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    h = Rolling()(TABLE[data], window)
    return h[(np.cumsum(sizes) - sizes)[which] + at].view(np.int64), which, at.astype(np.int32)


def wide_runs(pieces: DataFrame, window: int) -> DataFrame:
    """(context, content, at): the repeated windows of written chunks (context, content, copies, chunk), by a shuffle on their hashes."""

    def parts(b, size=1 << 20):
        ends = np.cumsum(pc.binary_length(b.column("chunk")).to_numpy(zero_copy_only=False)) // size
        cut = [0, *(np.flatnonzero(np.diff(ends)) + 1).tolist(), b.num_rows]
        return (b.slice(i, j - i) for i, j in zip(cut[:-1], cut[1:], strict=True) if j > i)

    def count(batches):
        for b in batches:
            for part in parts(b):
                h, n = np.unique(window_hashes(part.column("chunk").to_pylist(), window)[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(np.minimum(n, 2).astype(np.int64))], names=["h", "n"])

    def place(batches):
        for b in batches:
            for part in parts(b):
                h, which, at = window_hashes(part.column("chunk").to_pylist(), window)
                which = pa.array(which)
                yield pa.RecordBatch.from_arrays([pa.array(h), part.column("context").take(which), part.column("content").take(which), pa.array(at)], names=["h", "context", "content", "at"])

    twice = written(pieces.mapInArrow(frugal(count), "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).filter("n > 1").select("h"))
    single = pieces.filter("copies = 1").mapInArrow(frugal(place), "h long, context long, content long, at int").join(small(twice, 8), "h", "left_semi")
    single = single.groupBy("context", "content").agg(F.sort_array(F.collect_list("at")).alias("at"))
    copied = pieces.filter("copies > 1").select("context", "content", F.sequence(F.lit(0), F.length("chunk") - window).alias("at"))
    return single.unionByName(copied)


def repeats(docs: DataFrame, window: int) -> DataFrame:
    """(span_key, spans): a row's bytes that repeated windows cover, as packed int32 pairs (first, end)."""
    spark = docs.sparkSession

    def find(batches):
        for b in slices(batches):
            keys = b.column("key").to_numpy()
            found = []
            for c in chunks(b.column("text")):
                if (got := anchors(c, window)) is not None:
                    row, *rest = got
                    found.append([keys[c.first + row], *rest])
            if found:
                key, first, n, context, content = (np.concatenate(x) for x in zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(first.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(context.view(np.int64)), pa.array(content.view(np.int64))], names=["key", "first", "n", "context", "content"])

    items = written(docs.select("key", "text").mapInArrow(frugal(find), "key long, first int, n int, context long, content long"))
    shared = written(items.groupBy("context").agg(F.count(F.lit(1)).alias("times")).filter("times > 1").select("context"))
    items = written(items.join(small(shared, 8), "context"))
    chosen = items.groupBy("context", "content").agg(F.count(F.lit(1)).cast("int").alias("copies"), F.min(F.struct("key", "first", "n")).alias("rep"))
    chosen = written(chosen)
    # no more than one for each MOST bytes of text
    wide = written(chosen.groupBy("context").agg(F.sum(F.col("rep.n") + window).alias("size")).filter(F.col("size") > MOST).select("context"))
    n_wide = wide.count()

    def cut(batches):
        for b in slices(batches):
            rows = {n: [] for n in ("context", "content", "copies", "chunk")}
            for text, reps in zip(b.column("text"), b.column("reps").to_pylist(), strict=True):
                raw = text.as_buffer()
                raw = raw.to_pybytes() if raw is not None else b""
                for r in reps:
                    for k in ("context", "content", "copies"):
                        rows[k].append(r[k])
                    rows["chunk"].append(raw[r["first"] : r["first"] + r["n"] + window - 1])
            yield pa.RecordBatch.from_arrays([pa.array(rows["context"], pa.int64()), pa.array(rows["content"], pa.int64()), pa.array(rows["copies"], pa.int32()), pa.array(rows["chunk"], pa.binary())], names=list(rows))

    def sort(batches):
        group, size, last = [], 0, None

        def solve():
            flags = repeated_windows([g[2] for g in group], [g[3] for g in group], window)
            runs = []
            for f in flags:
                a, b = _runs(np.flatnonzero(f), 1)
                runs.append(np.stack([a, b], axis=1).astype(np.int32).tobytes())
            keep = [i for i, r in enumerate(runs) if r]
            return pa.RecordBatch.from_arrays([pa.array([group[i][0] for i in keep], pa.int64()), pa.array([group[i][1] for i in keep], pa.int64()), pa.array([runs[i] for i in keep], pa.binary())], names=["context", "content", "runs"])

        for b in batches:
            for context, content, chunk, copies in zip(*(b.column(k).to_pylist() for k in ("context", "content", "chunk", "copies")), strict=True):
                if group and context != last and size > BLOCK:
                    yield solve()
                    group, size = [], 0
                group.append((context, content, chunk, copies))
                size, last = size + len(chunk) + 1, context
        if group:
            yield solve()

    def runs_of(batches):
        for b in batches:
            runs = [np.stack(_runs(np.array(at), 1), axis=1).astype(np.int32).tobytes() for at in b.column("at").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("context"), b.column("content"), pa.array(runs, pa.binary())], names=["context", "content", "runs"])

    def chunks_of(chosen):
        chosen = chosen.groupBy(F.col("rep.key").alias("rep_key")).agg(F.collect_list(F.struct("rep.first", "rep.n", "context", "content", "copies")).alias("reps"))
        chosen = written(chosen)
        n_chunks = chosen.agg(F.sum(F.size("reps"))).first()[0] or 0
        pieces = docs.join(small(chosen, 64, n_chunks, bound=64 << 20), F.col("key") == F.col("rep_key")).select("text", "reps")
        return pieces.mapInArrow(frugal(cut), "context long, content long, copies int, chunk binary")

    own = chosen.join(small(wide, 8, n_wide), "context", "left_anti") if n_wide else chosen
    pieces = chunks_of(own).repartition(parallelism(spark), "context").sortWithinPartitions("context")
    runs = pieces.mapInArrow(frugal(sort), "context long, content long, runs binary")
    if n_wide:
        spread = written(chunks_of(chosen.join(small(wide, 8, n_wide), "context", "left_semi")))
        runs = runs.unionByName(wide_runs(spread, window).mapInArrow(frugal(runs_of), "context long, content long, runs binary"))
    runs = written(runs)
    back = items.join(small(runs, 64), ["context", "content"]).select("key", "first", "runs")
    back = back.groupBy(F.col("key").alias("span_key")).agg(F.collect_list(F.struct("first", "runs")).alias("found"))

    def unite(batches):
        for b in batches:
            spans = []
            for found in b.column("found").to_pylist():
                ab = np.concatenate([np.frombuffer(x["runs"], dtype=np.int32).reshape(-1, 2) + x["first"] for x in found])
                ab = ab[np.argsort(ab[:, 0], kind="stable")]
                a, e = ab[:, 0], np.maximum.accumulate(ab[:, 1] - 1 + window)
                new = np.ones(len(a), dtype=bool)
                new[1:] = a[1:] > e[:-1]
                last = np.concatenate([np.flatnonzero(new)[1:] - 1, [len(a) - 1]])
                spans.append(np.stack([a[new], e[last]], axis=1).astype(np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([b.column("span_key"), pa.array(spans, pa.binary())], names=["span_key", "spans"])

    return written(back.mapInArrow(frugal(unite), "span_key long, spans binary"))


def dedup(docs: DataFrame, window: int = 400) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept (the bytes that stay) of each document."""
    docs = keyed(docs)
    kind = dict(docs.dtypes)["doc_id"]

    def take(batches):
        for b in slices(batches):
            spans = b.column("spans").to_pylist()
            n_bytes, n_removed, n_spans, kept = [], [], [], []
            for c in chunks(b.column("text")):
                raw = c.data.tobytes()
                for i in range(c.n):
                    text = raw[c.offs[i] : c.offs[i + 1]]
                    ab = np.frombuffer(spans[c.first + i] or b"", dtype=np.int32).reshape(-1, 2).tolist()
                    parts, at = [], 0
                    for a, e in ab:
                        parts.append(text[at:a])
                        at = e
                    parts.append(text[at:])
                    n_bytes.append(len(text))
                    n_removed.append(sum(e - a for a, e in ab))
                    n_spans.append(len(ab))
                    kept.append(b"".join(parts))
            longs = [pa.array(x, pa.int64()) for x in (n_bytes, n_removed, n_spans)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *longs, pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    covered = docs.join(sized(repeats(docs, window), "spans"), F.col("key") == F.col("span_key"), "left").select("doc_id", "text", "spans")
    return covered.mapInArrow(frugal(take), f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary")
