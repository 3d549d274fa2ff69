"""Phrase collocations of each language: phrases are counted in the tasks, then by a shuffle of packed counts.

A task cuts its texts into words, gives each different word of a language a number, and each different phrase of k
words the number of its first k - 1 words and of its last; so phrases of numbers are counted by sorting integers, exactly.
The different phrases of a block of text go out sorted, with their counts, as compressed packages, one for each bucket of
their hash. There the texts themselves are compared and their counts summed, so nothing rests on a hash. Phrases of one
word and more travel each for itself: no word or prefix gathers its continuations in one task, nothing is
broadcast, and what is shuffled grows with the text.

Candidates have 2 to `longest` words and at least `least` occurrences, so all their parts are
among the phrases that occur as often; rarer ones go right after the sum. The score of a cut is
floor(10^6 a a / (l r)), in decimals of 38 digits, which hold it up to 10^16 occurrences (more
are an error, never a wrong number).

Hot words meet others only as counts: blocks sum first, and the lookups of
parts are equi joins of distinct phrases, which Spark splits where they are skewed.

Edge cases: null texts are empty and have no words; null languages count as `und`, together with
those that say so; a text without separators is one piece; repeated documents count as often as
they occur; an empty table gives an empty result. Only text and lang are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadastra.llm.tables import parallelism, written
from cadastra.llm.text import U, chunks, frugal, hash_spans, mix, slices

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of phrases that a bucket takes in before repeated ones among them are summed.
PRUNE_BYTES = 64 << 20
#: Bytes of text and words whose phrases are counted at once, and bytes of all texts for each task that sums.
BLOCK, WORDS, BUCKET = 3 << 20, 1 << 20, 16 << 20
#: What ends pieces beside the full stop; the same as a pattern, and what words are made of.
STOP = ",;:!?\n\x0b\x0c\r"
STOPS, WORD = "[.,;:!?\\x0A-\\x0D]", "[^\\x20\\x09]+"
ENDS = np.isin(np.arange(256), list(f".{STOP}".encode()))
APART = ENDS | np.isin(np.arange(256), list(b" \t"))
#: Signs that no word holds: one stands before a phrase's language (in hex), one ends it.
BEFORE_LANG, END = b"\n", b"\t"


def codec() -> pa.Codec:
    return pa.Codec("zstd", compression_level=6)


def _bytes(a: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a binary array without nulls."""
    _, offsets, data = a.buffers()
    offs = np.frombuffer(offsets, dtype=np.int32)[a.offset : a.offset + len(a) + 1]
    return offs, np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)


def _hashes(a: pa.Array) -> np.ndarray:
    offs, data = _bytes(a)
    return hash_spans(data, offs[:-1].astype(np.int64), offs[1:].astype(np.int64))


def _take(a: pa.Array, at: np.ndarray) -> pa.Array:
    return a.take(pa.array(at))


def _joined(*parts) -> pa.Array:
    *parts, apart = parts
    return pc.binary_join_element_wise(*parts, pa.scalar(apart, pa.binary()))


def words_of(b: pa.Table):
    """(words, language, follows) of a block: words as binary, each one's place in its languages, whether it stands in one piece with the word before; and the languages."""
    langs = b.column("lang").combine_chunks().dictionary_encode()
    codes = langs.indices.to_numpy()
    for c in chunks(b.column("text"), lower=True, size=2 * BLOCK):
        starts, ends, firsts = c.words(APART)
        if not len(starts):
            continue
        follows = np.zeros(len(starts), dtype=bool)
        ended = np.cumsum(ENDS[c.data], dtype=np.int32)[starts]
        follows[1:] = ended[1:] == ended[:-1]
        follows[firsts[:-1][firsts[:-1] < len(starts)]] = False
        offs = np.zeros(len(starts) + 1, dtype=np.int32)
        np.cumsum(ends - starts, out=offs[1:])
        words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offs), pa.py_buffer(c.data[~APART[c.data]])])
        yield words, np.repeat(codes[c.first : c.first + c.n], np.diff(firsts)), follows, langs.dictionary.cast(pa.binary())


def counted(words: pa.Array, lang: np.ndarray, follows: np.ndarray, langs: pa.Array, longest: int, seen: int = 0):
    """(phrases, counts, hashes) of the words, for no word, one, two and so on: different phrases with their language, sorted. The first `seen` words were counted before; they only begin phrases."""
    follows = follows & (np.arange(len(follows)) > 0)
    coded = words.dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy()
    place = np.empty(len(order), dtype=np.int64)
    place[order] = np.arange(len(order))
    first, ids = np.unique(lang.astype(np.int64) * len(order) + place[coded.indices.to_numpy()], return_inverse=True)
    ids = ids.astype(np.int64)
    plain = _take(_take(coded.dictionary, order), first % len(order))
    suffix = _joined(langs, pa.array([b""] * len(langs), pa.binary()), END)
    tail = _joined(plain, _take(suffix, first // len(order)), BEFORE_LANG)
    del coded, place, order

    n = np.bincount(lang[seen:], minlength=len(langs))
    none = _take(_joined(pa.array([b""] * len(langs), pa.binary()), suffix, BEFORE_LANG), np.flatnonzero(n))
    yield none, n[n > 0], _hashes(none)
    h = word_h = _hashes(tail)
    n = np.bincount(ids[seen:], minlength=len(first))
    yield _take(tail, np.flatnonzero(n)), n[n > 0], h[n > 0]

    text, own, at = plain, ids, np.arange(len(ids))  # phrases of k words: their texts, and the number of that which ends at each of the words `at`
    for k in range(2, longest + 1):
        number = np.full(len(ids), -1, dtype=np.int64)
        number[at] = own
        at = np.flatnonzero(follows)
        at = at[number[at - 1] >= 0]
        if not len(at):
            return
        key = number[at - 1] * len(first) + ids[at]
        del number
        found, own = np.unique(key, return_inverse=True)
        n = np.bincount(own[at >= seen], minlength=len(found))
        head, last = np.divmod(found, len(first))
        del key, found
        heads = _take(text, head)
        h = mix(h[head] * U(0x9E3779B97F4A7C15) + word_h[last])
        some = np.flatnonzero(n)
        yield _joined(_take(heads, some), _take(tail, last[some]), b" "), n[some], h[some]
        if k < longest:
            text = _joined(heads, _take(plain, last), b" ")


def packed(phrases: pa.Array, counts: np.ndarray, hashes: np.ndarray, buckets: int) -> pa.RecordBatch:
    """(bucket, phrases, raw, package): for each bucket the counts, byte by byte, and the phrases, compressed to `package` from `raw` bytes."""
    bucket = (hashes % U(buckets)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    bucket, counts = bucket[order], counts[order].astype("<i4")
    offs, data = _bytes(_take(phrases, order))
    cuts = np.flatnonzero(np.diff(bucket, prepend=-1, append=buckets))
    zstd, rows = codec(), []
    for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        raw = counts[i:j].view(np.uint8).reshape(-1, 4).T.tobytes() + data[offs[i] : offs[j]].tobytes()
        rows.append((j - i, len(raw), zstd.compress(raw, asbytes=True)))
    n, raw, package = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(bucket[cuts[:-1]]), pa.array(n, pa.int32()), pa.array(raw, pa.int32()), pa.array(package, pa.binary())], names=["bucket", "phrases", "raw", "package"])


def summed(tables: list[pa.Table]) -> pa.Table:
    return pa.concat_tables(tables).group_by("phrase", use_threads=False).aggregate([("f", "sum")]).rename_columns(["phrase", "f"])


def phrases(docs: DataFrame, longest: int, least: int) -> DataFrame:
    """lang, words (array), f: all phrases of up to `longest` words that occur `least` times; with no words: all of the language's words (of languages with `least` words)."""
    spark = docs.sparkSession
    docs = docs.select(F.col("text").cast("string").alias("text"), F.hex(F.coalesce(F.col("lang").cast("string"), F.lit("und"))).alias("lang"))
    tasks = max(parallelism(spark), (docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BUCKET)
    buckets = 4 * tasks  # so that tasks get more even shares, and hold a part of them at once

    def count(batches):
        def pack(held):
            for words, lang, follows, langs in words_of(pa.Table.from_batches(held).combine_chunks()):
                for i in range(0, len(words), WORDS):
                    seen = min(i, longest - 1)
                    part = slice(i - seen, i + WORDS)
                    for found in counted(words[part], lang[part], follows[part], langs, longest, seen):
                        if len(found[0]):
                            yield packed(*found, buckets)

        held, size = [], 0
        for b in slices(batches, rows=1 << 20, size=BLOCK // 3):
            held.append(b)
            size += b.column("text").nbytes
            if size >= BLOCK:
                yield from pack(held)
                held, size = [], 0
        if held:
            yield from pack(held)

    def gather(bucket: pa.Table) -> pa.Table:
        zstd, held, size, most = codec(), [], 0, PRUNE_BYTES
        for n, raw, package in zip(bucket.column("phrases").to_pylist(), bucket.column("raw").to_pylist(), bucket.column("package"), strict=True):
            x = np.frombuffer(zstd.decompress(package.as_buffer(), raw), dtype=np.uint8)
            counts = np.ascontiguousarray(x[: 4 * n].reshape(4, n).T).view("<i4").ravel()
            text = x[4 * n :]
            offs = np.zeros(n + 1, dtype=np.int32)
            offs[1:] = np.flatnonzero(text == END[0]) + 1
            found = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offs), pa.py_buffer(text)])
            held.append(pa.table({"phrase": found, "f": pa.array(counts.astype(np.int64))}))
            size += raw
            if size > most:
                held = [summed(held)]
                size = held[0].nbytes
                most = max(PRUNE_BYTES, 2 * size)
        found = summed(held)
        del held
        return found.filter(pc.greater_equal(found.column("f"), least))

    packages = docs.mapInArrow(frugal(count), "bucket int, phrases int, raw int, package binary").repartition(tasks, "bucket")
    found = packages.groupBy("bucket").applyInArrow(gather, "phrase binary, f long")
    parts = F.split(F.col("phrase").cast("string"), f"[{BEFORE_LANG.decode()}{END.decode()}]")
    found = found.select(parts[0].alias("phrase"), F.unhex(parts[1]).cast("string").alias("lang"), "f")
    return found.select("lang", F.when(F.col("phrase") == "", F.array().cast("array<string>")).otherwise(F.split("phrase", " ")).alias("words"), "f")


def mine(docs: DataFrame, longest: int = 3, least: int = 10, share: int = 50, top: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's best phrases: lowest score over the cuts, but for those that mostly occur in a longer candidate."""
    said = lambda x: F.array_join(x, " ")
    grams = written(phrases(docs, longest, least))
    known = grams.filter(F.size("words") > 0).select("lang", said("words").alias("part"), "f")
    found = grams.filter(F.size("words") > 1)

    cuts = found.select("lang", "words", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("cut"))
    cuts = cuts.select("lang", said("words").alias("phrase"), "a", "cut", said(F.slice("words", F.lit(1), F.col("cut"))).alias("head"), said(F.slice("words", F.col("cut") + 1, F.size("words"))).alias("tail"))
    cuts = cuts.join(known.select("lang", F.col("part").alias("head"), F.col("f").alias("l")), ["lang", "head"])
    cuts = cuts.join(known.select("lang", F.col("part").alias("tail"), F.col("f").alias("r")), ["lang", "tail"])
    score = F.expr("(1000000 * (CAST(a AS DECIMAL(38, 0)) * a)) div (CAST(l AS DECIMAL(38, 0)) * r)")
    scored = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("low"))

    spans = [(at, size) for size in range(2, longest) for at in range(1, longest - size + 2)]
    inside = found.filter(F.size("words") > 2).select("lang", "f", F.explode(F.array(*[F.when(F.size("words") > F.greatest(F.lit(size), F.lit(at + size - 2)), said(F.slice("words", at, size))) for at, size in spans])).alias("phrase")) if spans else None
    if inside is not None:
        inside = inside.filter(F.col("phrase").isNotNull()).groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
        scored = scored.join(inside, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("a")))

    rows = scored.select("lang", "phrase", "a", "low.l", "low.r", "low.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    totals = grams.filter(F.size("words") == 0).select("lang", F.col("f").alias("n"))
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def oracle(least: int = 10, share: int = 50, top: int = 2000) -> str:
    """DuckDB SQL for the rows of mine with phrases of 2 to 3 words."""
    return f"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{STOPS}')) AS piece FROM documents),
q AS (SELECT row_number() OVER () AS pid, lang, regexp_extract_all(piece, '{WORD}') AS w FROM p),
o AS (SELECT pid, lang, unnest(w) AS w1, unnest(range(1, len(w) + 1)) AS i FROM q),
l AS (SELECT lang, w1, lead(w1) OVER (PARTITION BY pid ORDER BY i) AS w2, lead(w1, 2) OVER (PARTITION BY pid ORDER BY i) AS w3 FROM o),
f1 AS (SELECT lang, w1 AS g, count(*) AS f FROM l GROUP BY ALL),
f2 AS (SELECT lang, w1, w2, w1 || ' ' || w2 AS g, count(*) AS f FROM l WHERE w2 IS NOT NULL GROUP BY ALL),
f3 AS (SELECT lang, w1, w2, w3, w1 || ' ' || w2 || ' ' || w3 AS g, count(*) AS f FROM l WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= {least}),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f1 GROUP BY 1),
f AS (SELECT lang, g, f FROM f1 UNION ALL SELECT lang, g, f FROM f2),
c AS (SELECT lang, g, f AS a, 1 AS k, w1 AS head, w2 AS tail FROM f2 WHERE f >= {least} UNION ALL SELECT lang, g, f, 1, w1, w2 || ' ' || w3 FROM f3 UNION ALL SELECT lang, g, f, 2, w1 || ' ' || w2, w3 FROM f3),
s AS (SELECT c.lang, c.g, a, k, x.f AS l, y.f AS r, ((1000000::HUGEINT * a * a) // (x.f::HUGEINT * y.f))::BIGINT AS score FROM c JOIN f x ON x.lang = c.lang AND x.g = head JOIN f y ON y.lang = c.lang AND y.g = tail),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
i AS (SELECT lang, g, max(f) AS longer FROM (SELECT lang, w1 || ' ' || w2 AS g, f FROM f3 UNION ALL SELECT lang, w2 || ' ' || w3, f FROM f3) GROUP BY ALL),
r AS (SELECT lang, g AS phrase, a, l, r, score FROM b LEFT JOIN i USING (lang, g) WHERE longer IS NULL OR 100 * longer < {share} * a),
t AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM r)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score FROM t JOIN n USING (lang) WHERE rank <= {top}"""
