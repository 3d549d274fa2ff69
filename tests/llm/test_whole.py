"""Whole jobs: nothing is left out above a fixed size."""

from __future__ import annotations

import collections
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadastra.llm import pitman_yor, suffixes

# op6

ONE_CHUNK: dict = {}


def split(n):
    """n ids of training and of held-out documents."""
    out = {True: [], False: []}
    for i in range(20 * n):
        out[zlib.crc32(str(i).encode()) % 5 == 1].append(i)
    return out[False][:n], out[True][:n]


def test_pairs_beyond_the_most_frequent_words(spark):
    train, held = split(40)
    common = " ".join(f"w{i} " * 3 for i in range(700))
    rows = [(i, f"{common} zig zag" if j % 2 else f"{common} zag dig") for j, i in enumerate(train[:4])]
    rows += [(held[0], "zig zag"), (held[1], "zag zig")]
    score = {r["doc_id"]: r["score"] for r in pitman_yor.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert score[held[0]] > score[held[1]] + 1


@pytest.mark.parametrize(("parts", "turns"), [(4, 1), (17, 5)])
def test_scores_do_not_depend_on_chunks_and_turns(spark, monkeypatch, parts, turns):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    if "scores" not in ONE_CHUNK:
        ONE_CHUNK["scores"] = {r["doc_id"]: r["score"] for r in pitman_yor.score(docs.coalesce(1)).collect()}
    monkeypatch.setattr(pitman_yor, "TURNS", turns)
    found = {r["doc_id"]: r["score"] for r in pitman_yor.score(docs.repartition(parts, "doc_id")).collect()}
    assert found.keys() == ONE_CHUNK["scores"].keys() and all(np.isfinite(x) for x in found.values())
    assert all(np.isclose(x, found[k], rtol=1e-12) for k, x in ONE_CHUNK["scores"].items())


def test_squeezed_numbers():
    for top in (0, 255, 256, 65_535, 65_536, 1 << 24, (1 << 24) - 1, 1 << 39, (1 << 62) + 1):
        x = np.array([0, top // 3, top, 1 if top else 0])
        packed = pitman_yor.squeeze(x)
        assert pitman_yor.unsqueeze(packed).tolist() == x.tolist() and len(packed) == 1 + 4 * max(1, (top.bit_length() + 7) // 8)
        assert pitman_yor.unsteps(pitman_yor.steps(np.sort(x))).tolist() == sorted(x.tolist())
    assert pitman_yor.unsqueeze(pitman_yor.squeeze(x[:0])).tolist() == [] == pitman_yor.unsqueeze(None).tolist()


def test_found_pairs_compares_both_numbers():
    u, w = np.array([3, 3, 7, 9]), np.array([5, 8, 5, 9])
    at = pitman_yor.found_pairs((u, w), np.array([7, 3, 3, 9, 1, 7]), np.array([5, 8, 9, 9, 5, 8]))
    assert at.tolist() == [2, 1, -1, 3, -1, -1]
    assert pitman_yor.found_pairs((u[:0], w[:0]), u, w).tolist() == [-1] * 4
    far = np.int64(1) << 40
    at = pitman_yor.found_pairs((u * far, w * far), np.array([7, 3, 3, 9, 1, 7]) * far, np.array([5, 8, 9, 9, 5, 8]) * far)
    assert at.tolist() == [2, 1, -1, 3, -1, -1]


def test_probabilities_sum_to_one(spark):
    texts = ["a b a b c", "a b b", "c a b a a d", "a " * 300, "b b " * 90]
    ids = split(5)[0]
    docs = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string").withColumn("held_out", F.lit(False))
    coded = pitman_yor.coded(docs)
    met = pitman_yor.counted(coded, 1)
    row = met.filter("chunk < 0").first()
    hashes = np.frombuffer(row["a"], dtype=np.int64)
    at = {int(h): i + 1 for i, h in enumerate(hashes)}
    start, end = at[int(pitman_yor.START)], at[int(pitman_yor.END)]
    base = np.zeros(1, dtype=np.int64)
    model = pitman_yor.Model(row["total"], row["words"], 1)
    named = pitman_yor.named(coded, met.filter("chunk >= 0"), base)
    words, pairs, _ = pitman_yor.sampled(named, met, base, model, (start, 5), end)
    w, p = (x.filter("to = -1").first() for x in (words, pairs))
    read = pitman_yor.unsqueeze
    c = read(w["c"])
    c[start - 1], own = 5, np.arange(1, len(c) + 1) != start
    for s in range(pitman_yor.SAMPLES):
        prob = model.parent(s, *(read(w[k][s]).astype(float) for k in ("gs", "t0s")))
        assert np.isclose(prob[own].sum() + model.parent(s, np.zeros(1), np.zeros(1))[0], 1.0)
    u, pc, ts = pitman_yor.unsteps(p["u"]), read(p["c"]), read(p["ts"])
    tables = sum(read(x) for x in w["tus"])
    for i in range(1, len(c) + 1):
        if i != end:  # all tables of a context: one for each pair that occurs once, and those of the others
            once = c[i - 1] - pc[u == i].sum()
            assert tables[i - 1] == once * pitman_yor.SAMPLES + ts[u == i].sum()


# op2


def test_a_wide_context_is_not_one_task(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "MOST", 1 << 14)
    passage = "".join(chr(97 + (i * i + i // 7) % 26) for i in range(60))
    texts = [f"{i:05d}{zlib.crc32(str(i).encode()):010d}" * 3 + passage + f"{zlib.crc32(str(-i).encode()):010d}" * 3 for i in range(900)]
    docs = spark.createDataFrame(list(enumerate([*texts, *texts[:20]])), "doc_id long, text string")
    tasks, real = [], suffixes.wide_runs

    def spied(pieces, window):
        tasks.append(pieces.count())
        return real(pieces, window)

    monkeypatch.setattr(suffixes, "wide_runs", spied)
    found = {r["doc_id"]: bytes(r["kept"]).decode() for r in suffixes.dedup(docs, 40).collect()}
    assert tasks and tasks[0] > 100
    texts += texts[:20]
    times = collections.Counter(t[i : i + 40] for t in texts for i in range(len(t) - 39))
    for i, t in enumerate(texts):
        gone = {j for k in range(len(t) - 39) if times[t[k : k + 40]] > 1 for j in range(k, k + 40)}
        assert found[i] == "".join(c for j, c in enumerate(t) if j not in gone)


def test_planted_passages_go_from_400_bytes_on(spark):
    """Passages of 300 to 700 bytes, each planted in two or three documents: those of 400 bytes and more go whole, shorter ones stay."""
    rng = np.random.default_rng(8)
    words = lambda n: " ".join("".join(map(chr, rng.integers(97, 123, size=int(rng.integers(2, 9))))) for _ in range(n))
    passages = [("|" + words(200))[:size] for size in (300, 394, 398, 399, 400, 401, 430, 560, 700)]
    texts = [f"{words(60)} é{i % 10}{passages[i % len(passages)]}{i % 10}# {words(40)}" for i in range(27)]  # other signs on either side of each copy
    found = {r["doc_id"]: bytes(r["kept"]).decode() for r in suffixes.dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5), 400).collect()}
    for i, text in enumerate(texts):
        p = passages[i % len(passages)]
        assert found[i] == (text.replace(p, "") if len(p) >= 400 else text), len(p)
