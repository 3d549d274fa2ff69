"""Byte-level BPE: encoding and decoding of whole texts.

A rank file (base64 token, rank) becomes a sentencepiece BPE model, written field by
field: each byte of a token is mapped to one printable character, a piece's score is
its negative rank, and the normaliser changes nothing. Texts are split by the
vocabulary's pattern, each distinct pre-token is encoded once per task, and decoding
maps ids back to the bytes of their tokens.

Edge cases: a null text counts as empty and has no ids; an empty table gives an
empty result; texts of any length are encoded whole; null ids decode to no bytes;
further columns are kept, except one named as an output, which is replaced.
"""

from __future__ import annotations

import base64
import struct
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadastra.llm.text import frugal, slices

#: Bytes (about) of distinct pre-tokens and their ids that a task remembers; the memory is emptied when full.
REMEMBERED = 48 << 20


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file, by rank."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    tokens = [b""] * len(pairs)
    for token, rank in pairs:
        tokens[int(rank)] = base64.b64decode(token)
    return tokens


def byte_characters() -> list[str]:
    """A printable character for each byte: itself where Latin-1 prints it, else the next code point from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value) -> bytes:
    """One field of a protocol buffer: bytes and str by length, int as varint, float as 32 bits."""
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    value = value.encode() if isinstance(value, str) else value
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def serialise(tokens: list[bytes]) -> bytes:
    """The sentencepiece model of the tokens; ids are ranks, and one unused <unk> stands behind them."""
    chars = byte_characters()
    pieces = [_field(1, _field(1, "".join(chars[b] for b in t)) + _field(2, float(-rank))) for rank, t in enumerate(tokens)]
    unk = _field(1, _field(1, "<unk>") + _field(2, 0.0) + _field(3, 2))
    # model_type BPE, vocab_size, unk_id; no bos, eos or pad
    absent = 2**64 - 1
    trainer = _field(3, 2) + _field(4, len(tokens) + 1) + _field(40, len(tokens)) + b"".join(_field(k, absent) for k in (41, 42, 43))
    normaliser = _field(1, "identity") + b"".join(_field(k, 0) for k in (3, 4, 5))
    return b"".join(pieces) + unk + _field(2, trainer) + _field(3, normaliser)


class Coder:
    """Encodes and decodes single texts; distinct pre-tokens are remembered up to REMEMBERED bytes."""

    def __init__(self, tokens: list[bytes], model: bytes, pattern: str):
        import regex
        import sentencepiece

        self.whole = {t: (rank,) for rank, t in enumerate(tokens)}
        self.spm = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.chars = {b: c for b, c in enumerate(byte_characters())}
        self.split, self.known, self.held = regex.compile(pattern).findall, {}, 0

    def ids(self, text: str) -> np.ndarray:
        pre = self.split(text)
        if self.held > REMEMBERED:
            self.known.clear()
            self.held = 0
        known, todo = self.known, []
        for t in set(pre):
            if t not in known:
                raw = t.encode()
                if raw in self.whole:  # a pre-token that is a token needs no merges
                    known[t] = self.whole[raw]
                    self.held += 250
                else:
                    todo.append((t, raw.decode("latin-1").translate(self.chars)))
        if todo:
            for (t, mapped), ids in zip(todo, self.spm.encode([m for _, m in todo], num_threads=1), strict=True):
                known[t] = tuple(ids)
                self.held += 250 + 4 * len(mapped) + 40 * len(ids)
        return np.fromiter(chain.from_iterable(map(known.__getitem__, pre)), dtype=np.int32)


def _schema(df: DataFrame, kinds: dict[str, T.DataType]) -> T.StructType:
    return T.StructType([*(f for f in df.schema.fields if f.name not in kinds), *(T.StructField(n, k) for n, k in kinds.items())])


def _coded(df: DataFrame, tokens: list[bytes], pattern: str, source: str, outputs: dict[str, str]) -> DataFrame:
    """df with the outputs (name: "ids" or "decoded") of its source column, which holds texts if ids are asked for, else ids."""
    encode = "ids" in outputs.values()
    shared = df.sparkSession.sparkContext.broadcast((tokens, serialise(tokens) if encode else b""))
    keep = [c for c in df.columns if c not in outputs]
    kinds = {"ids": T.ArrayType(T.IntegerType()), "decoded": T.BinaryType()}

    def run(batches):
        tokens, model = shared.value
        coder = Coder(tokens, model, pattern) if encode else None
        at = tokens.__getitem__
        for b in slices(batches, column=source) if encode else batches:
            found = {"ids": [], "decoded": []}
            for x in b.column(source):
                if encode:
                    ids = coder.ids(x.as_py() or "")
                else:
                    ids = x.values.to_numpy(zero_copy_only=False) if x.is_valid else np.zeros(0, np.int32)
                found["ids"].append(ids)
                if "decoded" in outputs.values():
                    found["decoded"].append(b"".join(map(at, ids.tolist())))
            columns = []
            for kind in outputs.values():
                if kind == "ids":
                    offs = np.cumsum([0, *map(len, found["ids"])]).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(offs), pa.array(np.concatenate([np.zeros(0, np.int32), *found["ids"]]))))
                else:
                    columns.append(pa.array(found["decoded"], pa.binary()))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *columns], names=[*keep, *outputs])

    return df.mapInArrow(frugal(run), _schema(df, {n: kinds[k] for n, k in outputs.items()}))


def encode(df: DataFrame, tokens: list[bytes], pattern: str, column: str = "text", output: str = "ids") -> DataFrame:
    """df with the ids of its text column as array<int>."""
    return _coded(df, tokens, pattern, column, {output: "ids"})


def decode(df: DataFrame, tokens: list[bytes], column: str = "ids", output: str = "decoded") -> DataFrame:
    """df with the bytes of its ids."""
    return _coded(df, tokens, "", column, {output: "decoded"})


def round_trip(df: DataFrame, tokens: list[bytes], pattern: str, column: str = "text") -> DataFrame:
    """df with ids and, from these, decoded: both in one step."""
    return _coded(df, tokens, pattern, column, {"ids": "ids", "decoded": "decoded"})


def digests(docs: DataFrame, tokens: list[bytes], pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each document: encoded, then decoded from the ids."""
    coded = round_trip(docs.select("doc_id", "text"), tokens, pattern)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
