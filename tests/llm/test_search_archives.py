"""Archives, collocations and ranked search against brute force, and their edge cases."""

from __future__ import annotations

import collections
import gzip
import hashlib
import json
import math
import os
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadastra.llm import collocations, lexical, warc
from cadastra.llm.tables import written

# op11

PAGES = "page_id long, url string, html string"


def expected_pages(rows, least=100):
    """(page_id, bytes, digest, type, refers_to) of rows with distinct ids."""
    first, out = {}, []
    for i, _, html in rows:
        data = (html or "").encode()
        first[data] = min(first.get(data, i), i)
        out.append((i, data))
    kind = lambda i, d: ("response", None) if len(d) < least or first[d] == i else ("revisit", first[d])
    return sorted((i, len(d), hashlib.sha256(d).hexdigest(), *kind(i, d)) for i, d in out)


def some_pages():
    rows = [(i, f"http://a.example/{i % 7}?q=ä b", f"<p>{'x' * (i % 50)}{i % 40}</p>" * (1 + i % 9)) for i in range(300)]
    rows += [(1000 + i, "http://hot.example/", "<html>" + "same " * 60) for i in range(200)]
    return rows + [(2000 + i, None, "") for i in range(150)] + [(3000, "u", None), (3001, "u", "tiny"), (3002, "v", "tiny"), (3003, "w", "long é " * 40_000)]


@pytest.mark.parametrize("parts", [1, 5])
def test_archives_say_what_the_pages_are(spark, parts):
    rows = some_pages()
    found = warc.archived(spark.createDataFrame(rows, PAGES).repartition(parts), file_bytes=4000)
    assert sorted(map(tuple, found.collect()), key=lambda r: r[0]) == expected_pages(rows)


def files_of(path):
    at = path.removeprefix("file://")
    return {f["name"]: f["sha256"] for f in json.load(open(f"{at}/{warc.MANIFEST}"))["files"]}, at


def test_equal_pages_make_equal_files(spark, tmp_path):
    df = spark.createDataFrame([*some_pages(), *some_pages()[:5]], PAGES)
    made = []
    for i, parts in enumerate((1, 6)):
        warc.write(df.repartition(parts, "url"), f"file://{tmp_path}/{i}", file_bytes=3000)
        made.append(files_of(f"file://{tmp_path}/{i}"))
    assert made[0][0] == made[1][0] and len(made[0][0]) > 8
    names, at = made[0]
    assert set(os.listdir(at)) >= set(names) and not os.listdir(f"{at}/_temporary")
    sizes = [os.path.getsize(f"{at}/{n}") for n in names]
    assert sum(s > 3000 for s in sizes) and sum(names[n] == hashlib.sha256(open(f"{at}/{n}", "rb").read()).hexdigest() for n in names) == len(names)
    text = b"".join(gzip.open(f"{at}/{n}").read() for n in names)  # any reader of gzip sees whole records
    ids = re.findall(rb"WARC-Record-ID: (\S+)", text)
    assert len(ids) == len(set(ids)) == len(names) + df.count()
    assert set(re.findall(rb"WARC-Refers-To: (\S+)", text)) <= set(ids)


def test_read_back_and_repeated_rows(spark, tmp_path):
    html = "<b>é</b>" + "y" * 200
    df = spark.createDataFrame([(5, "http://x/ü", html), (5, "http://x/ü", html), (None, None, html), (7, "a", None)], PAGES)
    warc.write(df, f"file://{tmp_path}/w")
    rows = {(r["page"], r["record_type"]): r for r in warc.read(spark, f"file://{tmp_path}/w").collect()}
    assert rows.keys() == {("5", "response"), ("5", "revisit"), (None, "revisit"), ("7", "response")}
    assert bytes(rows["5", "response"]["payload"]).decode() == html and rows["5", "response"]["target_uri"] == "http://x/%C3%BC"
    assert rows[None, "revisit"]["refers_to"] == rows["5", "response"]["record_id"] and rows[None, "revisit"]["refers_to_page"] == "5"


def test_unfinished_and_damaged_archives_are_not_read(spark, tmp_path):
    path = f"{tmp_path}/w"
    writer = warc.Writer({"path": f"file://{path}", "file_bytes": "1000", "date": warc.DATE})
    shards = warc.Shards(writer.path, writer.job, 1000, warc.DATE)
    shards.add("00000", b"x")  # a task that never ends
    with pytest.raises(Exception, match="manifest"):
        warc.read(spark, f"file://{path}").count()
    shards.close()
    writer.abort([])
    assert not os.listdir(f"{path}/_temporary")
    warc.write(spark.createDataFrame(some_pages(), PAGES), f"file://{path}")
    names, _ = files_of(path)
    name = sorted(names)[0]
    data = open(f"{path}/{name}", "rb").read()
    open(f"{path}/{name}", "wb").write(data[:-200])
    with pytest.raises(Exception, match="cut off|manifest"):
        warc.read(spark, f"file://{path}").count()


def test_archives_of_no_pages(spark):
    assert warc.archived(spark.createDataFrame([], PAGES)).count() == 0
    other = spark.createDataFrame([("a+b %", "u", "z" * 300, 1)], "page_id string, url string, html string, digest int")
    assert warc.archived(other).first()["page_id"] == "a+b %"


# op12


def expected_phrases(rows, longest, least, share, top):
    count, total = collections.Counter(), collections.Counter()
    lower = str.maketrans(collocations.UPPER, collocations.LOWER)
    for text, lang in rows:
        lang = lang or "und"
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(lower)):
            w = re.findall("[^ \t]+", piece)
            total[lang] += len(w)
            count.update((lang, tuple(w[i : i + k])) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    found = {(g, w): a for (g, w), a in count.items() if len(w) > 1 and a >= least}
    out = collections.defaultdict(list)
    for (g, w), a in found.items():
        if any(100 * f >= share * a for (h, v), f in found.items() if h == g and len(v) > len(w) and any(v[i : i + len(w)] == w for i in range(len(v) - len(w) + 1))):
            continue
        score, _, left, right = min((1_000_000 * a * a // (count[g, w[:k]] * count[g, w[k:]]), k, count[g, w[:k]], count[g, w[k:]]) for k in range(1, len(w)))
        out[g].append((-score, -a, " ".join(w).encode(), a, left, right, total[g], score))
    return sorted((g, i + 1, p.decode(), *rest) for g, x in out.items() for i, (_, _, p, *rest) in enumerate(sorted(x)[:top]))


TEXTS = [("The cat sat. the cat ran, The cat sat\tdown", "en")] * 6 + [("a a a a a a", None), ("A a; é ü É ü é ü", "und"), ("A\tb\x0bc d\x0cA\tb\rc d\nA b", "und"), (".a b..a b?!a b:", "und"), (None, "en"), ("", None), ("le chat dort le chat dort", "fr")] * 7 + [("x" + " y z" * 3000, "long")]


@pytest.mark.parametrize(("longest", "share", "most"), [(3, 50, 1 << 20), (4, 80, 1 << 20), (2, 50, 1 << 20), (3, 50, 0)])
def test_phrases_by_brute_force(spark, monkeypatch, longest, share, most):
    monkeypatch.setattr(collocations, "PRUNE_BYTES", most)
    df = spark.createDataFrame([(*r, 1, "f") for r in TEXTS], "text string, lang string, f int, words string").repartition(5)
    found = [tuple(r) for r in collocations.mine(df, longest, 5, share, 4).collect()]
    assert sorted(found) == expected_phrases(TEXTS, longest, 5, share, 4)


@pytest.mark.parametrize("words", [1, 2, 7])
def test_phrases_across_parts_of_a_text(spark, monkeypatch, words):
    monkeypatch.setattr(collocations, "WORDS", words)
    rows = [("The cat sat. the cat ran, The cat sat\tdown", "e\tn\n"), ("a a a a a a", None), ("x y z. x", "z")] * 7
    df = spark.createDataFrame(rows, "text string, lang string").repartition(3)
    assert sorted(tuple(r) for r in collocations.mine(df, 3, 5, 50, 4).collect()) == expected_phrases(rows, 3, 5, 50, 4)


def test_phrases_travel_packed(spark):
    rng = np.random.default_rng(3)
    words = np.array([f"word{i}" for i in range(5000)])
    texts = [" ".join(words[np.minimum(rng.zipf(1.2, 300), 5000) - 1]) for _ in range(1500)]
    docs = written(spark.createDataFrame([(t, "en") for t in texts], "text string, lang string").coalesce(2))

    def shuffled():
        sc = spark.sparkContext._jsc.sc()
        sc.listenerBus().waitUntilEmpty()
        return sc.statusStore().executorList(True).apply(0).totalShuffleWrite()

    before = shuffled()
    found = collocations.phrases(docs, 3, 10).filter(F.size("words") == 0).collect()
    assert [r["f"] for r in found] == [1500 * 300]
    assert shuffled() - before < sum(map(len, texts))


def test_no_phrases(spark):
    assert collocations.mine(spark.createDataFrame([], "text string, lang string")).count() == 0
    assert collocations.mine(spark.createDataFrame([(None, None), (" . ", "x")], "text string, lang string")).count() == 0


def test_large_counts_are_exact(spark):
    a = 3_000_000_000_000
    score = spark.sql(f"SELECT (1000000 * (CAST({a}L AS DECIMAL(38, 0)) * {a}L)) div (CAST({a + 1}L AS DECIMAL(38, 0)) * {a + 2}L)").first()[0]
    assert score == 1_000_000 * a * a // ((a + 1) * (a + 2))


# op13


def expected_ranks(docs, items, k):
    lower = str.maketrans(collocations.UPPER, collocations.LOWER)
    cut = lambda t: re.findall("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+", (t or "").translate(lower))
    sets = [(i, collections.Counter(cut(t))) for i, t in docs]
    n_docs, n_terms = sum(bool(c) for _, c in sets), sum(sum(c.values()) for _, c in sets)
    df = collections.Counter(w for _, c in sets for w in c)
    out = []
    for item, text in {(i, t or "") for i, t in items}:
        found = []
        for doc, c in sets:
            m = 10 + 90 * sum(c.values()) * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (1_000_000_000 * c[w] // (1000 * c[w] + 8 * m)) for w in set(cut(text)) if c[w])
            if score > 0:
                found.append((-score, doc is None, doc or 0))
        out += [(item, r + 1, None if none else doc, -s) for r, (s, none, doc) in enumerate(sorted(found)[:k])]
    return sorted(out, key=str)


def some_docs():
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(60)] + ["Été", "ÉTÉ", "x_y", "a-b"]
    weights = 1 / np.arange(1, len(words) + 1)
    docs = [(i, " ".join(rng.choice(words, size=int(rng.integers(1, 60)), p=weights / weights.sum()))) for i in range(700)]
    docs += [(900 + i, "w3 w50 w51 same copy") for i in range(300)] + [(2000, None), (2001, ""), (2002, "-- !"), (None, "w50 w51"), (7, "w3 w50 w51 same copy"), (2003, "w55 " * 90_000)]
    items = [(i, " ".join(rng.choice(words, size=8))) for i in range(40)] + [(50, "w3 w50 w51 same copy"), (51, None), (52, "nowhere"), (53, "W1 w1 w1"), (53, "W1 w1 w1"), (54, "été w55")]
    return docs, items


@pytest.mark.parametrize(("parts", "block"), [(1, 1 << 20), (7, 300)])
def test_ranks_by_brute_force(spark, monkeypatch, parts, block):
    monkeypatch.setattr(lexical, "BLOCK", block)
    docs, items = some_docs()
    df = spark.createDataFrame([(*r, "x") for r in docs], "doc_id long, text string, score string").repartition(parts)
    found = lexical.search(df, spark.createDataFrame(items, "item_id long, text string"), k=10)
    assert sorted(map(tuple, found.collect()), key=str) == expected_ranks(docs, items, 10)


def test_bounds_prune_and_hold(spark, monkeypatch):
    """Whole batches go, and no pair of nodes is below the score of what it holds."""
    docs, items = some_docs()
    met = collections.Counter()
    real = lexical.Search.judge

    def judged(self, own, node, leaves, bound):
        met["scored"] += len(leaves)
        weight = np.zeros(len(self.weight))
        weight[node.at] = node.weight
        for leaf, most in zip(leaves, bound, strict=True):
            for _, score in own.scores(np.array([leaf]), weight):
                assert score.max() <= most
        real(self, own, node, leaves, bound)

    monkeypatch.setattr(lexical.Search, "judge", judged)
    import pyarrow as pa

    vocabulary = np.unique(np.concatenate([h for _, h, _ in lexical.terms(pa.array([t for _, t in items]))]))
    rng = np.random.default_rng(1)
    n, size = 4000, len(vocabulary)
    counts = np.full(n, 6)
    at = np.sort(np.argsort(rng.random((n, size)) / (1 / np.arange(1, size + 1)), axis=1)[:, :6], axis=1).ravel()
    df = np.bincount(at, minlength=size)
    weight = np.floor(1000 * np.log((2 * n + 2) / (2 * df + 1)))
    hashes = [np.unique(h[f[i] : f[i + 1]]) for _, h, f in lexical.terms(pa.array([t for _, t in items])) for i in range(len(f) - 1)]
    tree = lexical.item_tree([np.searchsorted(vocabulary, h) for h in hashes], weight)
    search = lexical.Search(tree, len(items), size, 10, np.ones(len(items)))
    sets = [np.searchsorted(vocabulary, h) for h in hashes for _ in range(10)]  # ten documents for each item
    sizes = np.array([len(x) for x in sets])
    planted = lexical.Documents(list(range(len(sets))), np.full(len(sets), 9), sizes, np.concatenate(sets), np.ones(sizes.sum(), dtype=np.int64), weight, (n, 9 * n))
    search.meet(planted)
    met.clear()
    own = lexical.Documents(list(range(n)), np.full(n, 9), counts, at, np.ones(len(at), dtype=np.int64), weight, (n, 9 * n))
    search.meet(own)
    assert 0 < met["scored"] < 0.3 * len(items) * len(own.levels[0])


def test_search_of_nothing(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical.search(docs, items).count() == 0
    some = spark.createDataFrame([("k", "a b"), (None, "A")], "doc_id string, text string")
    assert [tuple(r) for r in lexical.search(some, items).select("rank", "doc_id").orderBy("rank").collect()] == [(1, None), (2, "k")]
    assert lexical.search(some, items.filter(F.lit(False))).count() == 0
