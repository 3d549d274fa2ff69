"""LM scoring by a hierarchical Pitman-Yor model.

Two levels of restaurants over all words of the training texts:
- One restaurant for each context (the word before; the start is one). Its dishes are all
  words that follow it.
- Their shared parent: its customers are the tables of the context restaurants; its base
  is uniform over all words and one unseen word.
Seating is sampled by Gibbs sweeps: each dish's number of tables is drawn from its exact
conditional distribution given the tables of all other dishes and the parent's
probabilities (generalised Stirling numbers count the seatings of c customers at t tables).
A sweep draws the dishes in parallel from the last sweep's totals; for a dish with more than
TOP customers the Stirling numbers follow from those of TOP customers, as the number of
tables grows like a power of the customers. In the first BURN sweeps discount and strength of either level are drawn from their posterior on a grid and
then stand; predictive probabilities are averaged over SAMPLES further sweeps and score
the texts.

All training documents are counted and all documents scored whole. How it runs:
1. Texts are tokenised once into a table of chunks (about TEXT bytes of text a row).
2. Chunks ask the partitions of the word hashes for counts and get numbers of words back,
   in the order in which they asked, so that no key travels twice.
3. Pairs of words, counted within a chunk, meet in partitions by a hash of the pair. A pair
   that occurs once always has one table, so sweeps hold only the pairs that repeat; the
   others are written once, so that every pair's count is looked up when texts are scored.
4. In a sweep, partitions of pairs tell partitions of words their sums of tables, and are
   told the parent's probabilities and the contexts' tables.
5. Chunks ask again, for all their pairs and words, and score their documents.
What travels is packed: one row for each two partitions, with arrays of the least width.
The partitions' number follows the tokens, so that none grows with the corpus.

Edge cases: a null text counts as empty and has one token, its end; a null doc_id hashes as
the empty string; without training documents all tokens are unseen; repeated rows are
documents of their own; an empty table gives an empty result. Only doc_id and text are read.
Words are known by 63-bit hashes.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadastra.llm.langid import held_out
from cadastra.llm.tables import discard, settle, written
from cadastra.llm.text import U, chunks, hash_spans, mix, mix_int

BURN, SAMPLES = 2, 3
#: Most customers of a dish whose Stirling numbers are worked out, numbers of tables that are weighed beyond.
TOP, GRID = 512, 1024
#: Grids of discounts and strengths.
DISCOUNTS, STRENGTHS = np.linspace(0.05, 0.95, 19), 2.0 ** np.arange(-3, 10)
#: Bytes of text in a chunk, tokens for each partition of words and of pairs, turns in which the chunks are scored.
TEXT, PART, TURNS = 8 << 20, 2_000_000, 3
#: The end of a text as a token, and its start as a context.
END, START = np.int64(mix_int(0xE0F) >> 1), np.int64(mix_int(0x57A) >> 1)
SEED = 11


# packed arrays


def squeeze(x: np.ndarray) -> bytes:
    """Whole numbers from 0 on in the fewest bytes each, how many the first byte tells."""
    width = max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 1
    if width in (1, 2, 4, 8):
        return bytes([width]) + x.astype(f"<u{width}").tobytes()
    return bytes([width]) + x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unsqueeze(b: bytes) -> np.ndarray:
    if not b:
        return np.zeros(0, np.int64)
    width = b[0]
    if width in (1, 2, 4, 8):
        return np.frombuffer(b, dtype=f"<u{width}", offset=1).astype(np.int64)
    out = np.zeros(((len(b) - 1) // width, 8), dtype=np.uint8)
    out[:, :width] = np.frombuffer(b, dtype=np.uint8, offset=1).reshape(-1, width)
    return out.view("<i8").ravel()


def steps(x: np.ndarray) -> bytes:
    """Ascending numbers as squeezed differences."""
    return squeeze(np.diff(x, prepend=0))


def unsteps(b: bytes) -> np.ndarray:
    return np.cumsum(unsqueeze(b))


def joined(column, read=unsqueeze) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.int64), *(read(x.as_py()) for x in column)])


def batch(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


def shape(**kinds: str) -> tuple[pa.Schema, str]:
    """An Arrow schema and the same for Spark; b: binary, l: long, ab: array of binary, ad: array of double."""
    arrow = {"b": pa.binary(), "l": pa.int64(), "ab": pa.list_(pa.binary()), "ad": pa.list_(pa.float64())}
    spark = {"b": "binary", "l": "long", "ab": "array<binary>", "ad": "array<double>"}
    return pa.schema([(n, arrow[k]) for n, k in kinds.items()]), ", ".join(f"{n} {spark[k]}" for n, k in kinds.items())


def dealt(part: np.ndarray):
    """(part, from, to) of each run of equal values in ascending part numbers."""
    at = np.flatnonzero(np.diff(part, prepend=-1))
    return zip(part[at].tolist(), at.tolist(), np.append(at, len(part))[1:].tolist(), strict=True)


def part_of(h: np.ndarray, parts: int) -> np.ndarray:
    """The partition of 63-bit hashes, ascending with them."""
    return (((h.astype(U) >> U(31)) * U(parts)) >> U(32)).astype(np.int64)


def pair_hash(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    return (mix(mix(u.astype(U) + U(1)) + w.astype(U)) >> U(1)).astype(np.int64)


# seating


def stirling(d: float, top: int = TOP) -> np.ndarray:
    """Logarithms of the generalised Stirling numbers [c, t]: the weight of all seatings of c customers at t tables."""
    out = np.full((top + 1, top + 1), -np.inf)
    out[1, 1] = 0.0
    for c in range(1, top):
        t = np.arange(1, c + 1)
        out[c + 1, 1 : c + 1] = np.log(c - d * t) + out[c, 1 : c + 1]
        out[c + 1, 2 : c + 2] = np.logaddexp(out[c + 1, 2 : c + 2], out[c, 1 : c + 1])
    return out


def lgamma(x) -> np.ndarray:
    """The logarithm of the gamma function of positive numbers, by Stirling's series from 8 on."""
    x = np.asarray(x, dtype=np.float64)
    small = np.ones_like(x)
    for k in range(8):
        small *= x + k
    y = x + 8
    series = (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    return np.where(x < 1e6, series - np.log(np.where(x < 1e6, small, 1)), (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x))


def scaled(c: np.ndarray, t: np.ndarray, d: float, table: np.ndarray) -> np.ndarray:
    """log S(c, t) for c beyond the table: t / c ** d has about the same law for its last row."""
    top = len(table) - 1
    k = np.arange(1, top + 1)
    law = np.append(0.0, (k - 1) * math.log(d) + lgamma(k) + table[top, 1:])
    x = t * (top / c) ** d
    low = np.clip(x.astype(np.int64), 1, top - 1)
    share = np.clip(x - low, 0, 1)
    logs = (1 - share) * law[low] + share * law[low + 1]
    return np.where(x <= top, lgamma(c) - math.lgamma(top) + d * np.log(top / c) - (t - 1) * math.log(d) - lgamma(t) + logs, -np.inf)


class Dice:
    """Random numbers by hashes of keys: the same for any partitioning."""

    def __init__(self, keys: np.ndarray, *seed: int):
        self.keys, self.turn = mix(keys.astype(U) ^ U(mix_int(sum(x << (16 * i) for i, x in enumerate(seed))))), np.zeros(len(keys), dtype=U)

    def random(self, at: np.ndarray) -> np.ndarray:
        self.turn[at] += U(1)
        h = mix(self.keys[at] + mix(self.turn[at]))
        return ((h >> U(11)).astype(np.float64) + 0.5) * 2.0**-53


def draw(c: np.ndarray, base: np.ndarray, others: np.ndarray, d: float, theta: float, table: np.ndarray, dice: Dice) -> np.ndarray:
    """Each dish's tables given those of the other dishes: P(t) ~ S(c, t) prod_{j < t} (theta + d (others + j)) base."""
    top = len(table) - 1
    out = np.minimum(c, 1).astype(np.int64)
    order = np.argsort(c, kind="stable")
    values, first = np.unique(c[order], return_index=True)
    for value, lo, hi in zip(values.tolist(), first.tolist(), np.append(first, len(c))[1:].tolist(), strict=True):
        if value < 2 or value > top:
            continue
        slab = max(1, (1 << 20) // value)
        for a in range(lo, hi, slab):
            at = order[a : min(hi, a + slab)]
            weight = np.log((theta + d * (others[at, None] + np.arange(value))) * base[at, None])
            np.cumsum(weight, axis=1, out=weight)
            weight += table[value, 1 : value + 1]
            weight -= weight.max(axis=1, keepdims=True)
            upto = np.cumsum(np.exp(weight), axis=1)
            out[at] = 1 + (upto < (dice.random(at) * upto[:, -1])[:, None]).sum(axis=1)
    big = np.flatnonzero(c > top)
    for a in range(0, len(big), 1024):  # over at most GRID numbers of tables, closer where they are few
        at = big[a : a + 1024]
        most = top * (c[at, None] / top) ** d
        t = np.floor(np.exp(np.log(most) * np.arange(GRID + 1) / GRID))
        width = np.diff(t, axis=1)
        t = t[:, :-1]
        own = theta / d + others[at, None]
        with np.errstate(divide="ignore"):
            weight = np.log(width) + scaled(c[at, None], t, d, table) + t * np.log(d * base[at, None]) + lgamma(own + t) - lgamma(own)
        upto = np.cumsum(np.exp(weight - weight.max(axis=1, keepdims=True)), axis=1)
        place = (upto < (dice.random(at) * upto[:, -1])[:, None]).sum(axis=1)
        rows = np.arange(len(at))
        out[at] = (t[rows, place] + np.floor(dice.random(at) * width[rows, place])).astype(np.int64)
    return out


def seatings(c: np.ndarray, t: np.ndarray) -> list[float]:
    """For each discount of the grid the log weight of so many customers at so many tables, summed over dishes."""
    width = int(t.max()) + 1 if len(t) else 1
    key, n = np.unique(c * width + t, return_counts=True)
    c, t = key // width, key % width
    near = c <= TOP
    out = []
    for d in DISCOUNTS:
        table = stirling(float(d))
        far = np.maximum(scaled(c[~near], t[~near], float(d), table), -1e300)
        out.append(float((n[near] * table[c[near], t[near]]).sum() + (n[~near] * far).sum()))
    return out


def restaurants(c: np.ndarray, t: np.ndarray) -> np.ndarray:
    """For each discount and strength of the grids the log probability of the numbers of tables t and customers c, but for `seatings`."""
    out = np.zeros((len(DISCOUNTS), len(STRENGTHS)))
    (tables, n_t), (guests, n_c) = (np.unique(x[t > 0], return_counts=True) for x in (t, c))
    for j, theta in enumerate(STRENGTHS):
        out[:, j] -= (n_c * (lgamma(theta + guests) - math.lgamma(theta + 1))).sum()
        for i, d in enumerate(DISCOUNTS):
            out[i, j] += (n_t * ((tables - 1) * math.log(d) + lgamma(theta / d + tables) - math.lgamma(theta / d + 1))).sum()
    return out


def pick(logs: np.ndarray, *seed: int) -> tuple[float, float]:
    """A discount and a strength drawn from their posterior on the grids."""
    noise = np.random.default_rng([SEED, *seed]).gumbel(size=logs.shape)
    i, j = np.unravel_index(int((logs + noise).argmax()), logs.shape)
    return float(DISCOUNTS[i]), float(STRENGTHS[j])


# texts and words

HEAD = {"chunk": "l", "n": "l", "train": "l", "held": "b", "starts": "b", "tokens": "b"}


def coded(docs: DataFrame) -> DataFrame:
    """Chunks of texts: doc_ids, held (bytes), starts of each text's tokens, tokens as places in dict (word hashes; START last)."""
    kind = docs.schema["doc_id"].dataType
    _, spark = shape(**HEAD)

    def run(batches):
        from pyspark import TaskContext

        chunk = TaskContext.get().partitionId() << 32  # read back from the written table, so it need only differ
        for b in batches:
            held = b.column("held_out").to_numpy(zero_copy_only=False)
            for c in chunks(b.column("text"), lower=True, size=TEXT):
                starts, ends, first = c.words()
                tokens = np.insert((hash_spans(c.data, starts, ends) >> U(1)).astype(np.int64), first[1:], END)
                words, tokens, n = np.unique(tokens, return_inverse=True, return_counts=True)
                often = np.argsort(-n, kind="stable")  # frequent words get small numbers, which pack better
                place = np.empty(len(often), dtype=np.int64)
                place[often] = np.arange(len(often))
                own = held[c.first : c.first + c.n]
                ids = b.column("doc_id").slice(c.first, c.n)
                head = [chunk, len(tokens), int((~own).sum()), own.astype(np.uint8).tobytes(), steps(first + np.arange(c.n + 1)), squeeze(place[tokens])]
                kinds = [pa.int64()] * 3 + [pa.binary()] * 3
                columns = [*(pa.array([x], k) for x, k in zip(head, kinds, strict=True)), pa.array([np.append(words[often], START).tobytes()], pa.binary())]
                yield pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(pa.array([0, c.n], pa.int32()), ids)], names=[*HEAD, "dict", "ids"])
                chunk += 1

    rows = docs.mapInArrow(run, f"{spark}, dict binary, ids array<{kind.simpleString()}>")
    return written(rows, codec="zstd")


def rows_of(batches, *names):
    """Each row's values of the named columns."""
    for b in batches:
        yield from zip(*(b.column(n).to_pylist() for n in names), strict=True)


def text_of(held: bytes, starts: bytes, tokens: bytes):
    """(starts, tokens, training text?) of a chunk; the last for each token."""
    starts, tokens = unsteps(starts), unsqueeze(tokens)
    train = np.repeat(np.frombuffer(held, dtype=np.uint8) == 0, np.diff(starts))
    return starts, tokens, train


COUNTED = shape(part="l", chunk="l", a="b", b="b", words="l", total="l")


def counted(texts: DataFrame, parts: int) -> DataFrame:
    """A row for each partition (chunk -1) with its training words' hashes and counts, and for each chunk there its words' ranks in it (0: unseen)."""
    schema, spark = COUNTED

    def ask(batches):
        for chunk, held, starts, tokens, words in rows_of(batches, "chunk", "held", "starts", "tokens", "dict"):
            _, tokens, train = text_of(held, starts, tokens)
            h = np.frombuffer(words, dtype=np.int64)
            n = np.bincount(tokens[train], minlength=len(h))
            order = np.argsort(h)
            h, n = h[order], n[order]
            yield batch(schema, [(p, chunk, h[a:b].tobytes(), squeeze(n[a:b]), 0, 0) for p, a, b in dealt(part_of(h, parts))])

    def meet(asked: pa.Table) -> pa.Table:
        part, chunk = asked.column("part")[0].as_py(), asked.column("chunk").to_pylist()
        sets = [np.frombuffer(x.as_py(), dtype=np.int64) for x in asked.column("a")]
        w, at = np.unique(np.concatenate(sets), return_inverse=True)
        c = np.zeros(len(w), dtype=np.int64)
        np.add.at(c, at, joined(asked.column("b")))
        known = (c > 0) | (w == START)
        rank = np.cumsum(known) * known
        cuts = np.cumsum([0, *map(len, sets)])
        out = [(part, k, squeeze(rank[at[a:b]]), b"", 0, 0) for k, a, b in zip(chunk, cuts[:-1], cuts[1:], strict=True)]
        out.append((part, -1, w[known].tobytes(), squeeze(c[known]), int((c > 0).sum()), int(c.sum())))
        return pa.Table.from_batches([batch(schema, out)])

    return written(texts.mapInArrow(ask, spark).groupBy("part").applyInArrow(meet, spark))


def named(texts: DataFrame, replies: DataFrame, base: np.ndarray) -> DataFrame:
    """The chunks with the numbers of their words (dict; ascending in a partition and over partitions from base on; 0: unseen)."""
    parts = len(base)

    def name(text: pa.Table, told: pa.Table) -> pa.Table:
        h = np.frombuffer(text.column("dict")[0].as_py(), dtype=np.int64)
        told = told.sort_by("part")
        rank, order = joined(told.column("a")), np.argsort(h)
        ids = np.empty(len(h), dtype=np.int64)
        ids[order] = np.where(rank > 0, base[part_of(h[order], parts)] + rank, 0)
        at = text.schema.get_field_index("dict")
        return text.set_column(at, "dict", pa.array([squeeze(ids)], pa.binary()))

    kinds = ", ".join(f"{n} {k}" for n, k in texts.dtypes)
    return written(texts.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(name, kinds), codec="zstd")


def local_pairs(starts: np.ndarray, tokens: np.ndarray, ids: np.ndarray):
    """(context, word) of a chunk's distinct pairs by their numbers, in ascending order, and each token's pair."""
    order = np.argsort(ids, kind="stable")
    place = np.empty(len(ids), dtype=np.int64)
    place[order] = np.arange(len(ids))
    w = place[tokens]
    u = np.empty_like(w)
    u[1:] = w[:-1]
    u[starts[:-1]] = place[-1]
    key, at = np.unique(u * len(ids) + w, return_inverse=True)
    return ids[order[key // len(ids)]], ids[order[key % len(ids)]], at


def dealt_pairs(u: np.ndarray, w: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs whose words are both known, by partition and otherwise in order, and their partitions."""
    at = np.flatnonzero((u > 0) & (w > 0))
    part = part_of(pair_hash(u[at], w[at]), parts)
    order = np.argsort(part.astype(np.uint16) if parts < 65536 else part, kind="stable")
    return at[order], part[order]


ASKED = shape(part="l", chunk="l", u="b", w="b", n="b")


def asked_pairs(texts: DataFrame, parts: int, trained: bool) -> DataFrame:
    """What each chunk asks each partition of pairs: contexts, words and training counts of its distinct pairs (trained: only those with any)."""
    schema, spark = ASKED

    def ask(batches):
        for chunk, held, starts, tokens, ids in rows_of(batches, "chunk", "held", "starts", "tokens", "dict"):
            starts, tokens, train = text_of(held, starts, tokens)
            u, w, at = local_pairs(starts, tokens, unsqueeze(ids))
            n = np.bincount(at[train], minlength=len(u))
            if trained:
                u, w, n = u[n > 0], w[n > 0], n[n > 0]
            at, part = dealt_pairs(u, w, parts)
            u, w, n = u[at], w[at], n[at]
            yield batch(schema, [(p, chunk, steps(u[a:b]), squeeze(w[a:b]), squeeze(n[a:b])) for p, a, b in dealt(part)])

    return texts.mapInArrow(ask, spark)


def summed(u: np.ndarray, w: np.ndarray, n: np.ndarray):
    """The distinct pairs in order, their sums, and each row's pair."""
    order = np.lexsort((w, u))
    u, w = u[order], w[order]
    new = np.ones(len(u), dtype=bool)
    new[1:] = (u[1:] != u[:-1]) | (w[1:] != w[:-1])
    at = np.empty(len(u), dtype=np.int64)
    at[order] = np.cumsum(new) - 1
    return u[new], w[new], np.add.reduceat(n[order], np.flatnonzero(new)) if len(n) else n, at


# sweeps: states of partitions of pairs and of words, and what they tell each other

#: to -1: a partition's own state, -2: its pairs that occur once, otherwise what it tells the partition `to` (of words: words, contexts, the tables and at first the customers of either).
PAIRS = shape(part="l", to="l", u="b", w="b", c="b", t="b", ts="b", more="b", like="ad")
WORDS = shape(part="l", to="l", c="b", rest_w="b", rest_u="b", g="b", t0="b", tu="b", gs="ab", t0s="ab", tus="ab", sums="ad", like="ad")


def told_words(part: int, state, base: np.ndarray, first: bool, like: list) -> pa.Table:
    """A partition's pairs as its state, and their tables summed by word and by context (first: customers too) for the partitions of words."""
    u, w, c, t, ts = state
    rows = [(part, -1, steps(u), squeeze(w), squeeze(c), squeeze(t), squeeze(ts), None, like)]
    sums = {}
    for at, k in ((0, w), (1, u)):
        ids, where = np.unique(k, return_inverse=True)
        values = [np.bincount(where, weights=x).astype(np.int64) for x in ((t, c) if first else (t,))]
        for p, lo, hi in dealt(np.searchsorted(base, ids, side="left") - 1):
            own = sums.setdefault(p, [None] * 6)
            own[at], own[2 + at] = steps(ids[lo:hi]), squeeze(values[0][lo:hi])
            if first:
                own[4 + at] = squeeze(values[1][lo:hi])
    rows += [(part, p, *x, []) for p, x in sorted(sums.items())]
    return pa.Table.from_batches([batch(PAIRS[0], rows)])


def first_pairs(texts: DataFrame, parts: int, base: np.ndarray) -> DataFrame:
    """All pairs of the training texts: those that repeat as states, with a table each, and those that occur once beside them."""

    def meet(asked: pa.Table) -> pa.Table:
        part = asked.column("part")[0].as_py()
        u, w, c, _ = summed(joined(asked.column("u"), unsteps), joined(asked.column("w")), joined(asked.column("n")))
        once = (part, -2, steps(u[c == 1]), squeeze(w[c == 1]), None, None, None, None, None)
        u, w, c = u[c > 1], w[c > 1], c[c > 1]
        told = told_words(part, (u, w, c, np.ones_like(c), np.zeros_like(c)), base, True, [0.0] * len(DISCOUNTS))
        return pa.concat_tables([told, pa.Table.from_batches([batch(PAIRS[0], [once])])])

    return written(asked_pairs(texts, parts, True).groupBy("part").applyInArrow(meet, PAIRS[1]))


def seat_words(words: DataFrame, pairs: DataFrame, base: np.ndarray, unit: float, tables: float, level: tuple[float, float], start: tuple[int, int], end: int, sweep: int) -> DataFrame:
    """The words' states after the tables of the pairs, and what they tell the pairs: guests, the parent's tables, contexts' tables.

    start: number of START and how many customers it has as a context; end: number of END, which is none.
    """
    d0, theta0 = level

    def run(own: pa.Table, told: pa.Table) -> pa.Table:
        row = own.to_pylist()[0]
        part, c = row["part"], unsqueeze(row["c"])
        low = int(base[part])
        place = lambda b: unsteps(b) - low - 1
        told = told.to_pylist()
        if row["rest_w"] is None:  # what pairs that occur once leave
            rest_w, rest_u = c.copy(), c.copy()
            if 0 <= start[0] - low - 1 < len(c):
                rest_u[start[0] - low - 1] = start[1]
            if 0 <= end - low - 1 < len(c):
                rest_u[end - low - 1] = 0
            for x in told:
                for at, n, rest in (("u", "ts", rest_w), ("w", "more", rest_u)):
                    if x[at]:
                        rest[place(x[at])] -= unsqueeze(x[n])
        else:
            rest_w, rest_u = unsqueeze(row["rest_w"]), unsqueeze(row["rest_u"])
        g, tu = rest_w.copy(), rest_u.copy()
        for x in told:
            for at, n, to in (("u", "c", g), ("w", "t", tu)):
                if x[at]:
                    to[place(x[at])] += unsqueeze(x[n])
        t0 = unsqueeze(row["t0"]) if row["t0"] else np.minimum(g, 1)
        dice = Dice(np.arange(low, low + len(g)), SEED, sweep, 2)
        t0 = draw(g, np.full(len(g), unit), np.maximum(tables - t0, 0), d0, theta0, stirling(d0), dice)
        customers = c.copy()
        if 0 <= start[0] - low - 1 < len(c):
            customers[start[0] - low - 1] = start[1]
        if 0 <= end - low - 1 < len(c):
            customers[end - low - 1] = 0
        like = [*restaurants(customers, tu).ravel().tolist(), *seatings(g[g > 0], t0[g > 0])] if sweep <= BURN else []
        add = lambda name, x: [*(row[name] or []), *([squeeze(x)] if sweep > BURN else [])]
        state = (part, -1, squeeze(c), squeeze(rest_w), squeeze(rest_u), b"", squeeze(t0), b"", add("gs", g), add("t0s", t0), add("tus", tu), [float(g.sum()), float(t0.sum())], like)
        rows = [state]
        for x in told:
            w, u = (place(x[k]) if x[k] else np.zeros(0, np.int64) for k in ("u", "w"))
            rows.append((part, x["part"], None, None, None, squeeze(g[w]), squeeze(t0[w]), squeeze(tu[u]), None, None, None, None, None))
        return pa.Table.from_batches([batch(WORDS[0], rows)])

    states = words.filter(F.col("to") < 0).groupBy("part")
    return written(states.cogroup(pairs.filter(F.col("to") >= 0).groupBy("to")).applyInArrow(run, WORDS[1]))


def seat_pairs(pairs: DataFrame, words: DataFrame, base: np.ndarray, unit: float, guests: float, tables: float, level: tuple[float, float], own_level: tuple[float, float], sweep: int) -> DataFrame:
    """The pairs' states with tables drawn anew."""
    (d0, theta0), (d, theta) = level, own_level

    def run(own: pa.Table, told: pa.Table) -> pa.Table:
        row, told = own.to_pylist()[0], told.sort_by("part")
        u, w, c, t, ts = unsteps(row["u"]), *(unsqueeze(row[k]) for k in ("w", "c", "t", "ts"))
        if len(u):
            g, t0, tu = (joined(told.column(k)) for k in ("g", "t0", "tu"))
            p = (g - d0 * t0 + (theta0 + d0 * tables) * unit) / (theta0 + guests)
            p, tu = p[np.unique(w, return_inverse=True)[1]], tu[np.unique(u, return_inverse=True)[1]]
            t = draw(c, p, np.maximum(tu - t, 0), d, theta, stirling(d), Dice(pair_hash(u, w), SEED, sweep, 1))
            ts = ts + t if sweep > BURN else ts
        return told_words(row["part"], (u, w, c, t, ts), base, False, seatings(c, t) if sweep <= BURN else [])

    states = pairs.filter(F.col("to") == -1).groupBy("part")
    return written(states.cogroup(words.filter(F.col("to") >= 0).groupBy("to")).applyInArrow(run, PAIRS[1]))


def totals(states: DataFrame, column: str) -> np.ndarray:
    """The sums of an array column over the partitions' states."""
    rows = states.filter(F.col("to") == -1).select(F.posexplode(column).alias("at", "x")).groupBy("at").agg(F.sum("x").alias("x")).collect()  # one row a place
    return np.array([r["x"] for r in sorted(rows, key=lambda r: r["at"])])


class Model:
    """The sampled model's numbers: totals of words, and for each sample the parent's; words and pairs are tables."""

    def __init__(self, total: int, distinct: int, n_parts: int):
        self.total, self.distinct, self.parts, self.unit = total, distinct, n_parts, 1.0 / (distinct + 1)
        self.own_level, self.level = (0.75, 1.0), (0.75, 1.0)
        self.samples: list[tuple[float, float]] = []  # guests and tables of the parent

    def parent(self, sample: int, g: np.ndarray, t0: np.ndarray) -> np.ndarray:
        """The parent's probability of words with g guests at t0 tables."""
        (guests, tables), (d0, theta0) = self.samples[sample], self.level
        return (g - d0 * t0 + (theta0 + d0 * tables) * self.unit) / (theta0 + guests)


def sampled(texts: DataFrame, met: DataFrame, base: np.ndarray, model: Model, start: tuple[int, int], end: int):
    """The states of words and of pairs after all sweeps, and the pairs that occur once; fills the model's levels and samples."""
    words = met.filter("chunk < 0").select("part", F.lit(-1).cast("long").alias("to"), F.col("b").alias("c"), *[F.lit(None).cast("binary").alias(n) for n in ("rest_w", "rest_u", "g", "t0", "tu")], *[F.lit(None).cast("array<binary>").alias(n) for n in ("gs", "t0s", "tus")], *[F.lit(None).cast("array<double>").alias(n) for n in ("sums", "like")])
    pairs = first_pairs(texts, model.parts, base)
    once = written(pairs.filter("to = -2").select("part", "u", "w"), codec="zstd")
    guests, tables, old = 0.0, float(model.distinct), None
    for sweep in range(BURN + SAMPLES + 1):
        if sweep:
            last, pairs = pairs, seat_pairs(pairs, words, base, model.unit, guests, tables, model.level, model.own_level, sweep)
            discard(last)
        words = seat_words(words, pairs, base, model.unit, tables, model.level, start, end, sweep)
        if old is not None:
            discard(old)
        old = words
        sums = totals(words, "sums")
        guests, tables = sums.tolist() if len(sums) else (0.0, 0.0)
        if sweep <= BURN:
            like, shape_ = totals(words, "like"), (len(DISCOUNTS), len(STRENGTHS))
            if guests and len(like):
                own = totals(pairs, "like")
                cells = shape_[0] * shape_[1]
                if sweep:
                    model.own_level = pick(like[:cells].reshape(shape_) + (own if len(own) else np.zeros(shape_[0]))[:, None], sweep, 1)
                top = restaurants(np.array([int(guests)]), np.array([int(tables)]))
                model.level = pick(top + like[cells:, None], sweep, 2)
        else:
            model.samples.append((guests, tables))
    return words, pairs, once


# scores

TOLD = shape(part="l", chunk="l", kind="l", a="b", b="b", more="ab")


def found_pairs(known: tuple[np.ndarray, np.ndarray], u: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Each pair's place among distinct known pairs in ascending order, or -1; both numbers are compared."""
    if not len(known[0]):
        return np.full(len(u), -1)
    width = int(max(known[1].max(), w.max(initial=0))) + 1
    if (int(max(known[0].max(), u.max(initial=0))) + 1) * width >= 1 << 63:  # beyond three thousand million words
        both = np.unique(np.concatenate([known[1], w]))
        known, w, width = (known[0], np.searchsorted(both, known[1])), np.searchsorted(both, w), len(both)
        us = np.unique(np.concatenate([known[0], u]))
        known, u = (np.searchsorted(us, known[0]), known[1]), np.searchsorted(us, u)
    key, asked = known[0] * width + known[1], u * width + w
    place = np.minimum(np.searchsorted(key, asked), len(key) - 1)
    return np.where(key[place] == asked, place, -1)


def told_pairs(texts: DataFrame, pairs: DataFrame, once: DataFrame, parts: int) -> DataFrame:
    """For each chunk and partition counts of the pairs that the chunk asks for, and sums of their tables over the samples.

    Both come from the partition's own pairs, never from what happens to be asked at once.
    """
    schema, spark = TOLD

    def run(own: pa.Table, asked: pa.Table) -> pa.Table:
        if not asked.num_rows:
            return pa.Table.from_batches([batch(schema, [])])
        of = {r["to"]: r for r in own.to_pylist()}  # -2: the pairs that occur once, -1: those that repeat
        pairs_of = lambda r: (unsteps(r["u"]), unsqueeze(r["w"])) if r else (np.zeros(0, np.int64),) * 2
        single, repeat = pairs_of(of.get(-2)), pairs_of(of.get(-1))
        c, ts = (np.append(unsqueeze(of[-1][k]) if -1 in of else [], 0).astype(np.int64) for k in ("c", "ts"))  # the last: of no pair
        part, out = asked.column("part")[0].as_py(), []
        for chunk, us, ws in rows_of(asked.to_batches(), "chunk", "u", "w"):
            u, w = unsteps(us), unsqueeze(ws)
            once_, more = found_pairs(single, u, w) >= 0, found_pairs(repeat, u, w)
            out.append((part, chunk, 0, squeeze(c[more] + once_), squeeze(ts[more] + once_ * SAMPLES), None))
        return pa.Table.from_batches([batch(schema, out)])

    states = pairs.filter("to = -1").select("part", "to", "u", "w", "c", "ts")
    single = once.select("part", F.lit(-2).cast("long").alias("to"), "u", "w", F.lit(None).cast("binary").alias("c"), F.lit(None).cast("binary").alias("ts"))
    return states.unionByName(single).groupBy("part").cogroup(asked_pairs(texts, parts, False).drop("n").groupBy("part")).applyInArrow(run, spark)


def told_words_again(texts: DataFrame, words: DataFrame, base: np.ndarray) -> DataFrame:
    """For each chunk and partition counts of the chunk's words there, and for each sample guests, parent's tables and context's tables."""
    schema, spark = TOLD

    def ask(batches):
        for chunk, ids in rows_of(batches, "chunk", "dict"):
            ids = np.sort(unsqueeze(ids))
            ids = ids[ids > 0]
            yield batch(schema, [(p, chunk, 1, steps(ids[a:b]), None, None) for p, a, b in dealt(np.searchsorted(base, ids, side="left") - 1)])

    def run(own: pa.Table, asked: pa.Table) -> pa.Table:
        row = own.to_pylist()[0]
        low = int(base[row["part"]])
        c, columns = unsqueeze(row["c"]), [unsqueeze(x) for k in ("gs", "t0s", "tus") for x in row[k]]
        out = []
        for chunk, ids in rows_of(asked.to_batches(), "chunk", "a"):
            at = unsteps(ids) - low - 1
            out.append((row["part"], chunk, 1, squeeze(c[at]), None, [squeeze(x[at]) for x in columns]))
        return pa.Table.from_batches([batch(schema, out)])

    states = words.filter(F.col("to") < 0).groupBy("part")
    return states.cogroup(texts.select("chunk", "dict").mapInArrow(ask, spark).groupBy("part")).applyInArrow(run, spark)


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each document."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("held_out", held_out(5, 1))
    kind = dict(docs.dtypes)["doc_id"]
    spark = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    texts = coded(docs)
    tokens, train_docs = (x or 0 for x in texts.agg(F.sum("n"), F.sum("train")).first())
    parts = max(1, -(-tokens // PART))
    met = counted(texts, parts)
    sizes = np.zeros(parts, dtype=np.int64)
    total = distinct = 0
    start, end = 0, 0
    states = met.filter("chunk < 0")
    for r in states.select("part", (F.octet_length("a") / 8).cast("long").alias("ranks"), "words", "total").collect():  # a row for each PART tokens
        sizes[r["part"]] = r["ranks"]
        total, distinct = total + r["total"], distinct + r["words"]
    base = np.cumsum(sizes) - sizes
    special = {int(part_of(np.array([x]), parts)[0]): [] for x in (START, END)}
    for r in states.filter(F.col("part").isin(list(special))).select("part", "a").collect():  # two partitions at most
        w = np.frombuffer(r["a"], dtype=np.int64)
        for x in (START, END):
            at = int(np.searchsorted(w, x))
            if at < len(w) and w[at] == x:
                start, end = (int(base[r["part"]]) + at + 1, end) if x == START else (start, int(base[r["part"]]) + at + 1)
    model = Model(total, distinct, parts)
    known = named(texts, met.filter("chunk >= 0").select("part", "chunk", "a"), base)
    discard(texts)
    words, pairs, once = sampled(known, met, base, model, (start, train_docs), end)
    discard(met)
    low = total + 0.5 * (distinct + 1)

    def judge(text: pa.Table, told: pa.Table) -> pa.Table:
        row = {n: text.column(n)[0].as_py() for n in ("held", "starts", "tokens", "dict")}
        starts, tokens, _ = text_of(row["held"], row["starts"], row["tokens"])
        ids = unsqueeze(row["dict"])
        told = told.sort_by("part")
        kinds = told.column("kind").to_numpy()
        of_pairs, of_words = told.filter(pa.array(kinds == 0)), told.filter(pa.array(kinds == 1))
        order = np.argsort(ids, kind="stable")
        order = order[ids[order] > 0]

        def spread(values):
            out = np.zeros(len(ids))
            out[order] = values
            return out

        c = spread(joined(of_words.column("a")))
        more = of_words.column("more").to_pylist()
        columns = [spread(np.concatenate([np.zeros(0, np.int64), *(unsqueeze(m[i]) for m in more)])) for i in range(3 * SAMPLES)]
        (d, theta) = model.own_level
        customers = c.copy()
        customers[-1] = train_docs  # START as a context
        u = np.empty_like(tokens)
        u[1:] = tokens[:-1]
        u[starts[:-1]] = len(ids) - 1
        up = np.zeros(len(tokens))
        for s in range(SAMPLES):
            p = model.parent(s, columns[s], columns[SAMPLES + s])
            up += (theta + d * columns[2 * SAMPLES + s][u]) * p[tokens] / SAMPLES
        pu, pw, at = local_pairs(starts, tokens, ids)
        asked, _ = dealt_pairs(pu, pw, parts)
        pair_c, pair_t = np.zeros(len(pu)), np.zeros(len(pu))
        pair_c[asked], pair_t[asked] = joined(of_pairs.column("a")), joined(of_pairs.column("b")) / SAMPLES
        logs = np.log10((pair_c[at] - d * pair_t[at] + up) / (theta + customers[u]))
        if not np.isfinite(logs).all():
            raise ArithmeticError("a token's probability is not a positive number: counts and tables of its pair do not fit")
        begin, count = starts[:-1], c[tokens]
        rows = len(begin)
        held = np.frombuffer(row["held"], dtype=np.uint8) == 1
        values = {
            "doc_id": text.column("ids").combine_chunks().flatten(),
            "held_out": pa.array(held),
            "n_tokens": pa.array(np.diff(starts)),
            "n_known": pa.array(np.add.reduceat((count > 0).astype(np.int64), begin)),
            "train_tokens": pa.array(np.full(rows, total, dtype=np.int64)),
            "base_score": pa.array(np.add.reduceat(np.log10((count + 0.5) / low), begin)),
            "score": pa.array(np.add.reduceat(logs, begin)),
        }
        return pa.table(values)

    scores = []
    for turn in range(TURNS):  # a part of the chunks at a time, so that what travels takes a part of the disk
        own = known.filter(F.pmod(F.xxhash64("chunk"), F.lit(TURNS)) == turn)
        told = told_pairs(own, pairs, once, parts).unionByName(told_words_again(own, words, base))
        scores.append(written(own.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(judge, spark)))
        del own, told
        if turn == TURNS - 1:
            for table in (known, words, pairs, once):
                discard(table)
        else:
            settle(known)
    return functools.reduce(DataFrame.unionByName, scores)
