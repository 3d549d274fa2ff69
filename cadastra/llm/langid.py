"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. A
word's probability is the sum over all its segmentations into pieces of the product
of their probabilities, found by a forward pass; expected piece counts from
forward-backward passes re-estimate the probabilities (EM). A text's words are its
runs of letters, lower-cased; its score is the posterior of the likeliest language.

The model is fitted on at most SAMPLE_DOCS labelled documents a language (hashed by
doc_id, whole texts); every document is scored whole.

Edge cases: a null text or one without letters is `und` with score 0; without
training documents all are `und`; a null doc_id hashes as the empty string; ties go
to the first language by name; an empty table gives an empty result. Only doc_id,
text and lang are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadastra.llm.tables import written
from cadastra.llm.text import U, frugal

SAMPLE_DOCS = 1500
ROUNDS = 3
#: Added to each piece's expected count, and the probability of a letter that no piece covers.
SMOOTHING, UNKNOWN = 0.05, 1e-7
#: Letters of a word (with its mark) up to which words of one length are summed together, words a task remembers.
SHORT, REMEMBERED = 32, 150_000
#: Texts whose new words are scored together.
GROUP = 250
WORD = r"\p{L}[\p{L}\p{M}]*"
MARK = "▁"


def pieces(model_path: str) -> list[str]:
    """The ordinary pieces of a sentencepiece model."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=model_path)
    return [m.id_to_piece(i) for i in range(m.get_piece_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))]


def _step(h: np.ndarray, code: np.ndarray) -> np.ndarray:
    """The hash of a string with one more letter."""
    h = (h ^ (code + U(0x9E3779B97F4A7C15))) * U(0xBF58476D1CE4E5B9)
    return h ^ (h >> U(29))


def _codes(words: list[str]) -> np.ndarray:
    """Code points of words of equal length, one row each."""
    return np.frombuffer("".join(words).encode("utf-32-le"), dtype="<u4").reshape(len(words), -1).astype(U)


class Segmenter:
    """Sums over segmentations of many words at once. probabilities: a row for each piece, a column for each language."""

    def __init__(self, names: list[str], probabilities: np.ndarray):
        self.p = np.asarray(probabilities, dtype=np.float64).reshape(len(names), -1)
        self.longest = max(map(len, names), default=1)
        by_length: dict[int, list[int]] = {}
        for i, name in enumerate(names):
            by_length.setdefault(len(name), []).append(i)
        hashes, rows = [], []
        for n, own in by_length.items():
            codes, h = _codes([names[i] for i in own]), np.zeros(len(own), dtype=U)
            for j in range(n):
                h = _step(h, codes[:, j])
                hashes.append(h)
                rows.append(np.array(own) if j == n - 1 else np.full(len(own), -1))
        h, row = np.concatenate(hashes), np.concatenate(rows)
        order = np.lexsort((-row, h))  # a piece before the same string as a mere prefix
        h, row = h[order], row[order]
        first = np.concatenate([[True], h[1:] != h[:-1]])
        self.hash, self.row = h[first], row[first]

    def arcs(self, codes: np.ndarray):
        """(i, j, words, rows): where a piece spans letters i to j; row -1 is a letter that no piece covers."""
        every = np.arange(len(codes))
        for i in range(codes.shape[1]):
            at, h = every, np.zeros(len(codes), dtype=U)
            for j in range(i + 1, min(codes.shape[1], i + self.longest) + 1):
                h = _step(h, codes[at, j - 1])
                place = np.minimum(np.searchsorted(self.hash, h), len(self.hash) - 1)
                hit = self.hash[place] == h
                row = np.where(hit, self.row[place], -1)
                if j == i + 1 and (row < 0).any():
                    yield i, j, at[row < 0], None
                piece = row >= 0
                if piece.any():
                    yield i, j, at[piece], row[piece]
                at, h = at[hit], h[hit]
                if not len(at):
                    break

    def forward(self, codes: np.ndarray, arcs) -> np.ndarray:
        """alpha[i, word, language]: the probability of the first i letters."""
        alpha = np.zeros((codes.shape[1] + 1, len(codes), self.p.shape[1]))
        alpha[0] = 1.0
        for i, j, at, row in arcs:
            alpha[j, at] += alpha[i, at] * (UNKNOWN if row is None else self.p[row])
        return alpha

    @staticmethod
    def grouped(words: list[str]):
        """(word numbers, code points) of the short words with their marks, of equal length and not too many at once."""
        by_length: dict[int, list[int]] = {}
        for i, word in enumerate(words):
            if len(word) < SHORT:
                by_length.setdefault(len(word), []).append(i)
        for group in by_length.values():
            for k in range(0, len(group), 4096):
                number = group[k : k + 4096]
                yield np.array(number), _codes([MARK + words[i] for i in number])

    def lattice(self, word: str) -> np.ndarray:
        """[i, n]: the piece of n + 1 letters from letter i of a marked word on, or -1."""
        codes = _codes([MARK + word])[0]
        rows = np.full((len(codes), self.longest), -1)
        h, at = np.zeros(len(codes), dtype=U), np.arange(len(codes))
        for n in range(self.longest):
            at = at[at + n < len(codes)]
            if not len(at):
                break
            h[at] = _step(h[at], codes[at + n])
            place = np.minimum(np.searchsorted(self.hash, h[at]), len(self.hash) - 1)
            hit = self.hash[place] == h[at]
            rows[at[hit], n] = self.row[place[hit]]
            at = at[hit]
        return rows

    def _arcs_of(self, rows: np.ndarray, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of letters and pieces (-1: a letter that no piece covers) of the steps from letter i on."""
        n = np.flatnonzero(rows[i] >= 0)
        if not len(n) or n[0] > 0:
            n = np.append(0, n)
        return n + 1, rows[i, n]

    def long_forward(self, rows: np.ndarray) -> np.ndarray:
        """[i, language]: the log probability of the first i letters of a long word; logarithms, as it would underflow."""
        logs = np.log(np.vstack([self.p, np.full(self.p.shape[1], UNKNOWN)]))
        alpha = np.full((len(rows) + 1, self.p.shape[1]), -np.inf)
        alpha[0] = 0.0
        for i in range(len(rows)):
            n, row = self._arcs_of(rows, i)
            alpha[i + n] = np.logaddexp(alpha[i + n], alpha[i] + logs[row])
        return alpha

    def logs(self, words: list[str]) -> np.ndarray:
        """The log probability of each word in each language."""
        total = np.zeros((len(words), self.p.shape[1]))
        for number, codes in self.grouped(words):
            total[number] = np.log(self.forward(codes, self.arcs(codes))[-1])
        for i, word in enumerate(words):
            if len(word) >= SHORT:
                total[i] = self.long_forward(self.lattice(word))[-1]
        return total

    def expected(self, words: list[str], k: np.ndarray, times: np.ndarray) -> np.ndarray:
        """Expected piece counts by language, when word i occurs times[i] times in language k[i]."""
        size, counts = self.p.shape, np.zeros(self.p.size)
        for number, codes in self.grouped(words):
            arcs = list(self.arcs(codes))
            every, lang = np.arange(len(codes)), k[number]
            alpha = self.forward(codes, arcs)[:, every, lang]
            beta = np.zeros_like(alpha)
            beta[-1] = 1.0
            for i, j, at, row in reversed(arcs):
                beta[i, at] += beta[j, at] * (UNKNOWN if row is None else self.p[row, lang[at]])
            scale = times[number] / beta[0]
            for i, j, at, row in arcs:
                if row is not None:
                    share = alpha[i, at] * self.p[row, lang[at]] * beta[j, at] * scale[at]
                    np.add.at(counts, row * size[1] + lang[at], share)
        for word, lang, n in zip(words, k.tolist(), times.tolist(), strict=True):
            if len(word) >= SHORT:
                rows = self.lattice(word)
                own = np.append(np.log(self.p[:, lang]), np.log(UNKNOWN))
                alpha = self.long_forward(rows)[:, lang]
                beta = np.full(len(rows) + 1, -np.inf)
                beta[-1] = 0.0
                for i in range(len(rows) - 1, -1, -1):
                    step, row = self._arcs_of(rows, i)
                    logs = own[row] + beta[i + step]
                    beta[i] = np.logaddexp.reduce(logs)
                    seen = row >= 0
                    np.add.at(counts, row[seen] * size[1] + lang, n * np.exp(alpha[i] + logs[seen] - alpha[-1]))
        return counts.reshape(size)


def held_out(modulus: int = 3, remainder: int = 1) -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % modulus == remainder


def _words(batches):
    import regex

    split = regex.compile(WORD).findall
    for batch in batches:
        counts: dict = {}
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            for w in split(text.lower()):
                counts[lang, w] = counts.get((lang, w), 0) + 1
        langs, words = zip(*counts, strict=True) if counts else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(words, pa.string()), pa.array(counts.values(), pa.int64())], names=["lang", "word", "n"])


def fit(docs: DataFrame, names: list[str], rounds: int = ROUNDS, sample_docs: int = SAMPLE_DOCS) -> tuple[list[str], np.ndarray]:
    """Languages, and for each piece its probability in each of them, from labelled documents (doc_id, text, lang)."""
    docs = docs.filter("text IS NOT NULL AND lang IS NOT NULL").select("doc_id", "text", "lang")
    seen = {r["lang"]: r["count"] for r in docs.groupBy("lang").count().collect()}  # one row a label
    langs = sorted(seen)
    if not langs:
        return [], np.zeros((len(names), 0))
    share = F.create_map(*[F.lit(x) for k in langs for x in (k, int(min(1.0, sample_docs / seen[k]) * 1_000_000))])
    sample = docs.filter(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1_000_000)) < F.element_at(share, F.col("lang")))
    words = written(sample.mapInArrow(frugal(_words), "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")))
    at = {k: i for i, k in enumerate(langs)}
    table = np.full((len(names), len(langs)), 1.0 / len(names))
    context = docs.sparkSession.sparkContext
    for _ in range(rounds):
        shared = context.broadcast((names, table))  # a fixed vocabulary times the labels

        def gather(batches, shared=shared):
            model = Segmenter(*shared.value)
            total = np.zeros(model.p.shape)
            for batch in batches:
                k = np.array([at[x] for x in batch.column("lang").to_pylist()], dtype=np.int64)
                total += model.expected(batch.column("word").to_pylist(), k, batch.column("n").to_numpy())
            row, k = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(row.astype(np.int32)), pa.array(k.astype(np.int32)), pa.array(total[row, k])], names=["row", "k", "n"])

        counts = words.mapInArrow(frugal(gather), "row int, k int, n double").groupBy("row", "k").agg(F.round(F.sum("n"), 3).alias("n")).collect()
        table = np.full((len(names), len(langs)), SMOOTHING)
        for r in counts:  # at most the vocabulary times the labels
            table[r["row"], r["k"]] += r["n"]
        table /= table.sum(axis=0)
    return langs, table


def predict(docs: DataFrame, names: list[str], langs: list[str], table: np.ndarray) -> DataFrame:
    """docs with lang_pred and score."""
    shared = docs.sparkSession.sparkContext.broadcast((names, table, langs))
    keep = [c for c in docs.columns if c not in ("lang_pred", "score")]

    def run(batches):
        import regex

        names, table, langs = shared.value
        model, split = Segmenter(names, table), regex.compile(WORD).findall
        known: dict[str, int] = {}
        rows = np.zeros((0, len(langs)))
        for batch in batches:
            preds, scores = [], []
            texts = batch.column("text")
            for at in range(0, len(texts), GROUP):
                words = [split((t.as_py() or "").lower()) if langs else [] for t in texts[at : at + GROUP]]
                if len(known) > REMEMBERED:
                    known, rows = {}, rows[:0]
                fresh = sorted({w for own in words for w in own} - known.keys())
                if fresh:
                    rows = np.concatenate([rows, model.logs(fresh)])
                    known.update(zip(fresh, range(len(known), len(known) + len(fresh)), strict=True))
                for own in words:
                    if not own:
                        preds.append("und")
                        scores.append(0.0)
                        continue
                    total = rows[np.fromiter(map(known.__getitem__, own), dtype=np.int64, count=len(own))].sum(axis=0)
                    best = int(total.argmax())
                    preds.append(langs[best])
                    scores.append(float(1.0 / np.exp(total - total[best]).sum()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(preds, pa.string()), pa.array(scores, pa.float64())], names=[*keep, "lang_pred", "score"])

    from pyspark.sql import types as T

    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return docs.mapInArrow(frugal(run), schema)


def identify(docs: DataFrame, names: list[str]) -> DataFrame:
    """doc_id, held_out, lang_pred and score; learned from the documents that are not held out."""
    langs, table = fit(docs.filter(~held_out()), names)
    rows = docs.select("doc_id", "text", held_out().alias("held_out"))
    return predict(rows, names, langs, table).drop("text")
