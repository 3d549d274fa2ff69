"""The exact operators against brute force, on tables small enough for it; edge cases."""

import collections
import hashlib
import itertools
import random
import re
import unicodedata

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from cadastra.llm import fingerprints, graph, mixing, ngram_join, substrings, suffixes
from cadastra.llm.text import Rolling, chunks

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string, component_id string")


# op1


def components(rows, k, percent):
    sets = []
    for _, t in rows:
        w = WORD.findall(lower(t))
        sets.append(frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
            root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min([x for x in (least.get(find(i)), d) if x is not None], default=None)
    return collections.Counter((d, len(sets[i]), least[find(i)] if sets[i] else d) for i, (d, _) in enumerate(rows))


def joined(df, k, percent):
    return collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.join(df, k, percent).collect())


def near_copies(seed):
    rng, rows = random.Random(seed), []
    for _ in range(40):
        base = [f"w{rng.randrange(40)}" for _ in range(rng.randint(1, 60))]
        for _ in range(6):
            w = list(base)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = f"w{rng.randrange(40)}"
            rows.append((len(rows), " ".join(w)))
    return [*rows, (900, ""), (901, None), (None, "only one"), (3, "twice the id"), (3, "twice the id")]


@pytest.mark.parametrize("k, percent", [(4, 85), (1, 60), (5, 80)])
def test_join_finds_all_links(spark, k, percent):
    rows = near_copies(k)
    assert joined(spark.createDataFrame(rows, "doc_id long, text string"), k, percent) == components(rows, k, percent)


def test_join_on_documents(docs):
    assert joined(docs, 4, 85) == components(pairs(docs), 4, 85)


def test_keep_first(spark, docs):
    kept = ngram_join.keep_first(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {c for _, _, c in components(pairs(docs), 5, 80)}
    rows = [(3, "one two three four five six"), (3, "seven eight nine ten eleven twelve"), (4, "one two three four five six"), (4, "a b c d e f"), (3, "one two three four five six"), (None, "a b c d e f"), (None, "g h i j k l"), (None, None), (5, "")]
    kept = ngram_join.keep_first(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert collections.Counter((r["doc_id"], r["text"]) for r in kept) == collections.Counter([rows[0], rows[1], rows[3], rows[6], rows[7], rows[8]])
    assert ngram_join.keep_first(empty(spark)).count() == 0


def test_product_in_row_blocks(monkeypatch, spark):
    monkeypatch.setattr(ngram_join, "BLOCK", 3)
    rows = near_copies(9)
    assert joined(spark.createDataFrame(rows, "doc_id long, text string"), 2, 70) == components(rows, 2, 70)


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (101, 102), (200, 200)]
    roots = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert len({roots[i] for i in range(41)}) == 1 and len({roots[i] for i in (0, 100, 200)}) == 3
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


# op2


def removed_bytes(rows, window):
    texts = [(t or "").encode() for _, t in rows]
    count = collections.Counter(x[i : i + window] for x in texts for i in range(len(x) - window + 1))
    out = []
    for (d, _), x in zip(rows, texts, strict=True):
        stay = np.ones(len(x), dtype=bool)
        for i in range(len(x) - window + 1):
            if count[x[i : i + window]] > 1:
                stay[i : i + window] = False
        gone = np.concatenate([[False], ~stay])
        out.append((d, len(x), int((~stay).sum()), int((gone[1:] & ~gone[:-1]).sum()), np.frombuffer(x, np.uint8)[stay].tobytes()))
    return collections.Counter(out)


def cut_bytes(df, window):
    return collections.Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in suffixes.dedup(df, window).collect())


@pytest.mark.parametrize("window", [6, 13, 70, 400])
def test_suffix_dedup(spark, window):
    rng = random.Random(window)
    rows = [(i % 50, "".join(rng.choice("abé") for _ in range(rng.randint(0, 90)))) for i in range(120)]
    rows += [(1, None), (None, "ab" * 500), (7, "z " * 300), (9, "is onhe. " * 200)] * 2
    long = "abcdefgh" * 40 + "".join(rng.choice("abé") for _ in range(900))
    rows += [(300, long), (301, "q" + long[:450] + "r" + long[460:1000]), (302, long[5:700] * 2)]
    assert cut_bytes(spark.createDataFrame(rows, "doc_id long, text string"), window) == removed_bytes(rows, window)


def test_suffix_dedup_beyond_a_block(monkeypatch, spark):
    monkeypatch.setattr(suffixes, "MOST", 128)
    rng = random.Random(0)
    rows = [(i, "".join(rng.choice("ab") for _ in range(60)) + "shared passage of some length" + str(i % 7)) for i in range(60)]
    assert cut_bytes(spark.createDataFrame(rows, "doc_id long, text string"), 24) == removed_bytes(rows, 24)


def test_suffix_dedup_on_documents(spark, docs):
    assert cut_bytes(docs, 400) == removed_bytes(pairs(docs), 400)
    assert suffixes.dedup(empty(spark)).count() == 0


@pytest.mark.parametrize("text", ["a" * 300, "ab" * 150, "mississippi" * 20, "abcabcab", "a"])
def test_suffix_array(text):
    data = np.frombuffer(text.encode() + bytes([suffixes.END]), dtype=np.uint8)
    blocks = Rolling()(suffixes.TABLE[np.concatenate([data, np.full(63, suffixes.END, np.uint8)])], 64)
    found = suffixes.suffix_array(data, suffixes._words_at(data, ">"), blocks, 400)
    tail = bytes([suffixes.END]) * 500
    assert found.tolist() == sorted(range(len(data)), key=lambda i: bytes(data[i:]) + tail)


# op3


def removed_words(rows, window):
    words = [WORD.findall(t or "") for _, t in rows]
    count = collections.Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for (d, _), w in zip(rows, words, strict=True):
        stay = [True] * len(w)
        for i in range(len(w) - window + 1):
            if count[tuple(w[i : i + window])] > 1:
                stay[i : i + window] = [False] * window
        out.append((d, len(w), len(w) - sum(stay), " ".join(x for x, s in zip(w, stay, strict=True) if s)))
    return collections.Counter(out)


def cut_words(df, window):
    return collections.Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in substrings.dedup(df, window).collect())


@pytest.mark.parametrize("window", [5, 6, 35])
def test_substring_dedup(spark, window):
    rng = random.Random(window)
    rows = [(i % 50, "  ".join(rng.choice("abcdef") for _ in range(rng.randint(0, 40))) + "\n") for i in range(200)]
    rows += [(1, None), (None, "a " * 13), (7, "z " * 50), (8, "É è " * 30)] * 2
    assert cut_words(spark.createDataFrame(rows, "doc_id long, text string"), window) == removed_words(rows, window)


def test_substring_dedup_on_documents(spark, docs):
    assert cut_words(docs, 35) == removed_words(pairs(docs), 35)
    assert substrings.dedup(empty(spark)).count() == 0


def test_words_of_chunks():
    import pyarrow as pa

    texts = ["Hello  W\tx", "", None, " a ", "é" * 40, "last"]
    for size in (4, 10, 1000):
        found = []
        for c in chunks(pa.array(texts), lower=True, size=size):
            s, e, first = c.words()
            found += [[c.data[s[j] : e[j]].tobytes().decode() for j in range(first[i], first[i + 1])] for i in range(c.n)]
        assert found == [WORD.findall(lower(t)) for t in texts]


# op4


@pytest.mark.parametrize("rows", [None, [(1, "a b c", "x"), (1, "a b c", "x"), (2, None, "x"), (3, "", "y"), (4, "w " * 50, None), (5, " q ", ""), (None, "z z", "x"), (6, "k", "é")], [(1, "", "x")], []])
def test_mixing_equals_sql(spark, docs, rows):
    df = docs if rows is None else spark.createDataFrame(rows, "doc_id long, text string, source string")
    con = duckdb.connect()
    documents = df.toPandas()
    if rows == []:
        documents = documents.astype({"doc_id": "Int64", "text": "string", "source": "string"})
    con.register("documents", documents)
    columns = ["doc_id", "source", "size", "source_size", "target", "taken", "copies"]
    key = lambda t: str([None if x != x else x for x in t])
    ours = sorted((tuple(r[c] for c in columns) for r in mixing.mix(df).collect()), key=key)
    theirs = sorted(con.execute(f"SELECT {', '.join(columns)} FROM ({mixing.oracle()})").fetchall(), key=key)
    assert [tuple(None if x != x else x for x in t) for t in ours] == [tuple(None if x != x else x for x in t) for t in theirs]


def test_mixing_meets_targets(docs):
    rows = mixing.mix(docs).collect()
    assert sum(r["taken"] for r in rows) <= sum(r["size"] for r in rows)
    biggest = max(r["size"] for r in rows)
    for source in {r["source"] for r in rows}:
        own = [r for r in rows if r["source"] == source]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= biggest
    assert all(r["taken"] <= 3 * r["size"] for r in rows)
    assert mixing.mixed(docs).count() == sum(r["copies"] for r in rows)


# op8


def canon(t):
    return " ".join(unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", t).casefold()).split())


@pytest.mark.parametrize("rows", [None, [(5, "Ａb  c"), (9, "ab C"), (2, None), (2, ""), (None, "ＳTRASSE straße"), (70, "x" * 3000), (71, "ﬁn al"), (72, "fin al")], [(1, "alone")]])
def test_fingerprints(spark, docs, rows):
    df = docs if rows is None else spark.createDataFrame(rows, "doc_id long, text string")
    own = sorted(((d, t or "") for d, t in pairs(df)), key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode()))
    found = sorted(fingerprints.fingerprint_pairs(df).collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["n_chars"]))
    prints, expected = collections.defaultdict(set), []
    for i, (d, t) in enumerate(own):
        after = own[(i + 1) % len(own)][1]
        half = len(t) // 2
        edit = t[: len(t) - half] + after[:half]
        expected.append((d, len(t), hashlib.sha256(edit.encode()).hexdigest(), float(canon(t) == canon(edit)), float(canon(t) == canon(after))))
        prints[canon(t)].add(found[i]["fingerprint"])
        prints[canon(edit)].add(found[i]["edited_fingerprint"])
    assert [(r["doc_id"], r["n_chars"], r["edited_sha256"], r["near_edited"], r["near_next"]) for r in found] == expected
    assert all(len(x) == 1 for x in prints.values()) and len(set.union(*prints.values())) == len(prints)


def test_colliding_hashes_are_told_apart(monkeypatch, spark):
    monkeypatch.setattr(fingerprints, "wide_hash", lambda c: F.substring(F.md5(c), 1, 1))
    df = spark.createDataFrame([(i, f"text {i % 40}") for i in range(80)], "doc_id long, text string")
    rows = fingerprints.fingerprint_pairs(df).collect()
    assert len({r["fingerprint"] for r in rows}) == 40
    assert len({(r["doc_id"] % 40, r["fingerprint"]) for r in rows}) == 40
    assert fingerprints.fingerprints(empty(spark)).count() == 0
