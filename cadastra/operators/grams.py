"""Word n-grams of texts as numbers: the most frequent ones of a corpus, counted exactly, and each text's counts of them.

Grams are known by 64-bit hashes: of a billion different ones a frequent one is confused with another once in about a million corpora.
"""

from __future__ import annotations

import ctypes
from functools import lru_cache, wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from cadastra.sources.folders import written

#: Bytes of texts in a block, blocks that a task holds at once, and blocks of the first look.
BLOCK_BYTES, HELD, LOOKED = 256 << 10, 4, 192
#: Buckets of hashes, leading bits by which known hashes are found, and bytes of a part when tables are added up.
BUCKETS, LEAD, PART_BYTES = 1 << 20, 20, 1 << 16
#: Bytes that words are made of; an odd number for polynomials modulo 2 ** 64, and its inverse.
LETTER = np.isin(np.arange(256), list(b"abcdefghijklmnopqrstuvwxyz0123456789"))
BASE = 0x9E3779B97F4A7C15 | 4
INVERSE = pow(BASE, -1, 1 << 64)


def frugal(run):
    """A function over batches that gives freed memory back to the system at its end, as its worker stays for other steps."""

    @wraps(run)
    def bounded(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
        if trim is not None:
            trim(0)

    return bounded


def mixed(h: np.ndarray) -> np.ndarray:
    """Numbers whose bits all depend on all bits of the given ones."""
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(by)
    return h ^ (h >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(max(n - 1, 0), base, np.uint64)]), dtype=np.uint64)


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """How many words `[a-z0-9]{2,}` each text has, and the words of all as hashes, in their order."""
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    at = ends - ends[0]
    inside = np.concatenate([LETTER[data], [False]])
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    border = at[(at > 0) & (at < len(data))]
    first[border], last[border - 1] = inside[border], inside[border - 1]  # no word crosses two texts
    first, last = np.flatnonzero(first), np.flatnonzero(last) + 1
    long = last - first > 1
    first, last = first[long], last[long]
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(data * powers(BASE, len(data))[: len(data)], dtype=np.uint64)])
    own = (sums[last] - sums[first]) * powers(INVERSE, len(data) + 1)[first]
    return np.diff(np.searchsorted(first, at)), mixed(own + (last - first).astype(np.uint64))


def blocks(df: DataFrame) -> DataFrame:
    """(ids, n, words): blocks of about BLOCK_BYTES of texts, their ids, how many words each has, and the hashes of all words."""
    kind = to_arrow_type(df.schema["doc_id"].dataType)

    def pack(batches):
        for b in batches:
            text = b.column("text").cast(pa.string())
            size = np.cumsum(np.diff(np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + len(text) + 1]).astype(np.int64) + 1)
            cuts = [0, *(np.flatnonzero(np.diff(size // BLOCK_BYTES)) + 1).tolist(), b.num_rows] if b.num_rows else []
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                n, own = words(text.slice(lo, hi - lo))
                ids = pa.ListArray.from_arrays(pa.array([0, hi - lo], pa.int32()), b.column("doc_id").slice(lo, hi - lo))
                columns = [ids, *[pa.array([x.tobytes()], pa.binary()) for x in (n, own)]]
                yield pa.RecordBatch.from_arrays(columns, schema=pa.schema([("ids", pa.list_(kind)), ("n", pa.binary()), ("words", pa.binary())]))

    return written(df.select("doc_id", "text").mapInArrow(frugal(pack), f"ids array<{dict(df.dtypes)['doc_id']}>, n binary, words binary"))


def grams(n: np.ndarray, word: np.ndarray, longest: int):
    """Of texts with n words each the grams of one word, of two, up to `longest`: the number of each one's text, and its hash."""
    text, h = np.repeat(np.arange(len(n), dtype=np.int32), n), word
    yield text, h
    for k in range(1, longest):
        h = mixed(h[:-1] * np.uint64(BASE) + word[k:] + np.uint64(k))
        whole = text[k:] == text[: max(len(text) - k, 0)]
        yield text[k:][whole], h[whole]


def repeats(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different ones of an array of numbers, ascending, and how often each occurs; the array is sorted in place."""
    key.sort()
    new = np.flatnonzero(np.concatenate([np.ones(min(len(key), 1), bool), key[1:] != key[:-1]]))
    return key[new], np.diff(np.append(new, len(key)))


def texts_and_places(n: np.ndarray, own: np.ndarray, longest: int, known: np.ndarray, total: np.ndarray | None = None) -> np.ndarray:
    """text * len(known) + place for each gram that the ascending `known` hold; all grams are added to the buckets `total`."""
    out = [np.zeros(0, np.int64)]
    for text, h in grams(n, own, longest):
        at, place = places(h, known)
        out.append(text[at].astype(np.int64) * max(len(known), 1) + place)
        if total is not None:
            np.add.at(total, (h & np.uint64(BUCKETS - 1)).view(np.int64), 1)
    return np.concatenate(out)


def together(batches):
    """HELD blocks at a time: their rows, their texts' numbers of words, and the words."""
    for b in batches:
        for lo in range(0, b.num_rows, HELD):
            rows = b.slice(lo, HELD)
            yield rows, *[np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in rows.column(c)]) for c, kind in (("n", np.int64), ("words", np.uint64))]


@lru_cache(2)
def index(known: bytes) -> tuple[np.ndarray, np.ndarray, int]:
    """Of ascending hashes, by their leading bits: whether there are any, where they begin, and the most that share theirs."""
    ends = np.searchsorted(np.frombuffer(known, np.uint64) >> np.uint64(64 - LEAD), np.arange((1 << LEAD) + 1, dtype=np.uint64)).astype(np.int32)
    size = np.diff(ends)
    return size > 0, ends[:-1], int(size.max())


def places(found: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the hashes are in the ascending `known`, and where."""
    some, start, most = index(known.tobytes())
    lead = (found >> np.uint64(64 - LEAD)).view(np.int64)
    near = np.flatnonzero(some[lead])
    first, found, place = start[lead[near]], found[near], np.full(len(near), -1)
    for step in range(most):
        at = np.minimum(first + step, len(known) - 1)
        np.copyto(place, at, where=known[at] == found)
    same = place >= 0
    return near[same], place[same]


def added(parts: DataFrame, kind: type = np.int64) -> np.ndarray:
    """Tables of numbers (eight bytes each) of one size, as (part int, x binary), added up by Spark in parts: the driver holds one."""

    def add(rows: pa.Table) -> pa.Table:
        total = np.zeros(len(rows.column("x")[0].as_py()) // 8, kind)
        for x in rows.column("x"):
            total += np.frombuffer(x.as_buffer(), kind)
        return pa.table({"part": rows.column("part").slice(0, 1), "x": pa.array([total.tobytes()], pa.binary())})

    found = parts.groupBy("part").applyInArrow(add, "part int, x binary").collect()  # of fixed size
    return np.concatenate([np.zeros(0, kind), *[np.frombuffer(r["x"], kind) for r in sorted(found, key=lambda r: r["part"])]])


def tables(total: np.ndarray):
    """A task's table of numbers as Arrow batches, in parts."""
    for part, lo in enumerate(range(0, len(total), PART_BYTES // 8)):
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([total[lo : lo + PART_BYTES // 8].tobytes()], pa.binary())], names=["part", "x"])


def counted(packed: DataFrame, longest: int, wanted=None, least: int = 1) -> DataFrame:
    """(h, n, docs): the grams in the buckets that `wanted` holds (all, if None), how often they occur and in how many texts; a block's with n below `least` are left out."""

    def count(batches):
        for _, n, own in together(batches):
            found = [[], []]
            for text, h in grams(n, own, longest):
                asked = slice(None) if wanted is None else wanted.value[h & np.uint64(BUCKETS - 1)]
                found[0].append(text[asked])
                found[1].append(h[asked])
            text, h = map(np.concatenate, found)
            order = np.lexsort((text, h))
            text, h = text[order], h[order]
            first = np.ones(min(len(h), 1), bool)
            new = np.concatenate([first, h[1:] != h[:-1]])
            other = np.concatenate([first, text[1:] != text[:-1]]) | new
            new = np.flatnonzero(new)
            often = np.diff(np.append(new, len(h)))
            docs = np.add.reduceat(other.astype(np.int64), new) if len(new) else often
            keep = often >= least
            yield pa.RecordBatch.from_arrays([pa.array(h[new][keep].view(np.int64)), pa.array(often[keep], pa.int64()), pa.array(docs[keep], pa.int64())], names=["h", "n", "docs"])

    kinds = "h long, n long, docs long"
    return packed.select("n", "words").mapInArrow(frugal(count), kinds).groupBy("h").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def most_frequent(packed: DataFrame, longest: int, features: int, least_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the `features` grams that occur most often, of those in `least_docs` texts (ties by hash), and the number of texts that hold each; ascending hashes.

    A look at a few blocks names candidates. One pass counts these exactly, and all other grams in buckets of hashes:
    a gram that occurs as often as the last of the best candidates makes its bucket as full. Those buckets' grams,
    if there are any, are counted exactly in a second pass. So the result is exact, whatever the first look showed.
    """
    sc = packed.sparkSession.sparkContext
    every = max(1, packed.count() // LOOKED)
    looked = packed.filter(F.pmod(F.xxhash64("n"), F.lit(every)) == 0)
    named = counted(looked, longest, least=3).orderBy(F.desc("n"), "h").limit(4 * features).select("h").collect()
    known = np.sort(np.array([r["h"] for r in named], np.int64).view(np.uint64))
    held = sc.broadcast(known)

    def count(batches):
        known = held.value
        total = np.zeros(BUCKETS + 2 * len(known), np.int64)
        often, docs = total[BUCKETS : BUCKETS + len(known)], total[BUCKETS + len(known) :]
        for _, n, own in together(batches):
            key, x = repeats(texts_and_places(n, own, longest, known, total[:BUCKETS]))
            place = key % max(len(known), 1)
            np.add.at(often, place, x)
            np.add.at(docs, place, 1)
        np.subtract.at(total, (known & np.uint64(BUCKETS - 1)).view(np.int64), often)
        yield from tables(total)

    total = added(packed.select("n", "words").mapInArrow(frugal(count), "part int, x binary"))
    if not len(total):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    often, docs = total[BUCKETS : BUCKETS + len(known)], total[BUCKETS + len(known) :]
    enough = docs >= least_docs
    last = max(1, np.sort(often[enough])[-features]) if enough.sum() >= features else 1
    full = total[:BUCKETS] >= last
    if full.any():
        rest = counted(packed, longest, sc.broadcast(full)).filter((F.col("n") >= int(last)) & (F.col("docs") >= least_docs))
        rows = rest.orderBy(F.desc("n"), "h").limit(features + len(known)).collect()
        more = np.array([tuple(r) for r in rows], np.int64).reshape(-1, 3)
        new = ~np.isin(more[:, 0].view(np.uint64), known)
        known, often, docs = (np.concatenate([a, b[new]]) for a, b in ((known, more[:, 0].view(np.uint64)), (often, more[:, 1]), (docs, more[:, 2])))
    best = np.flatnonzero(docs >= least_docs)
    best = best[np.lexsort((known[best].view(np.int64), -often[best]))][:features]
    best = best[np.argsort(known[best])]
    return known[best], docs[best]


def counts(packed: DataFrame, longest: int, known: np.ndarray) -> DataFrame:
    """(ids, size, i, x): for each block its texts' ids, how many of the grams `known` (ascending hashes) each holds, which, and how often; as bytes of int32 and, the last two, of the smallest unsigned type."""
    held = packed.sparkSession.sparkContext.broadcast(known)

    def count(batches):
        for rows, n, own in together(batches):
            key, x = repeats(texts_and_places(n, own, longest, held.value))
            text, i = np.divmod(key, max(len(held.value), 1))
            size = np.bincount(text, minlength=len(n))
            ids = rows.column("ids").flatten()
            ids = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
            columns = [size.astype(np.int32), i.astype(np.min_scalar_type(len(held.value))), x.astype(np.min_scalar_type(x.max(initial=0)))]
            yield pa.RecordBatch.from_arrays([ids, *[pa.array([a.tobytes()], pa.binary()) for a in columns]], names=["ids", "size", "i", "x"])

    return written(packed.mapInArrow(frugal(count), f"ids {dict(packed.dtypes)['ids']}, size binary, i binary, x binary"))
