"""Lookups: with defaults, first pattern contained, nearest period, nearest place, inverse-distance neighbours."""

from __future__ import annotations

from bisect import bisect_left

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from cadastra.operators.nearby import k_nearest

#: Rows of a dimension up to which it is broadcast; bytes of keys in an automaton.
DIMENSION_ROWS, AUTOMATON_BYTES = 100_000, 16 << 20


def dimension(dim: DataFrame, bound: int = DIMENSION_ROWS) -> DataFrame:
    """A broadcast hint if the dimension's counted rows fit the bound; else a shuffle join takes over."""
    return F.broadcast(dim) if dim.limit(bound + 1).count() <= bound else dim


def with_default(df: DataFrame, dim: DataFrame, on: str, defaults: dict) -> DataFrame:
    """Left lookup; values that are missing take the defaults."""
    out = df.join(dimension(dim), on, "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def nearest(df: DataFrame, dim: DataFrame, keys: list[str], at: tuple[Column, Column], dim_at: tuple[Column, Column], distance: Column, order: list[str], take: list[str]) -> DataFrame:
    """For each distinct key of df the dimension row at the least distance (ties: least `order`), joined back.

    `at` and `dim_at` are coordinates on a plane in which `distance` is the straight one, up to rounding.
    """
    best = k_nearest(df.select(*keys).distinct(), dim, at, dim_at, distance, order, take)
    return df.join(best.select(*keys, *[F.col("near")[0][c].alias(c) for c in take]), keys, "left")


class Patterns:
    """Keys in their order: an automaton that finds all keys inside a value in one pass, and for values that begin a key the least place among those."""

    def __init__(self, keys: list[str]):
        self.first, self.least = {}, None  # key -> place; least place of sorted keys from i on for 2 ** level keys
        self.found = ahocorasick.Automaton()
        for place, k in enumerate(keys):
            self.first.setdefault(k, place)
        for k, place in self.first.items():
            if k:
                self.found.add_word(k, place)
        self.found.make_automaton()
        self.sorted = sorted(self.first)
        level = np.array([self.first[k] for k in self.sorted], dtype=np.int64)
        self.least = [level]
        while len(level) > 1 << (len(self.least) - 1):
            step = 1 << (len(self.least) - 1)
            level = np.minimum(level, np.append(level[step:], level[-1:].repeat(min(step, len(level)))))
            self.least.append(level)

    def beginning_with(self, value: str) -> list[int]:
        """The least place of the keys that the value begins, if there are any."""
        lo = bisect_left(self.sorted, value)
        hi = bisect_left(self.sorted, value + "\U0010ffff", lo)
        if lo == hi:
            return []
        level = (hi - lo).bit_length() - 1
        return [int(min(self.least[level][lo], self.least[level][hi - (1 << level)]))]

    def place(self, value: str, exact_first: bool) -> int | None:
        if exact_first and value in self.first:
            return self.first[value]
        found = [place for _, place in self.found.iter(value)] if len(self.found) else []
        found += self.beginning_with(value) + ([self.first[""]] if "" in self.first else [])
        return min(found, default=None)


def matcher(data, exact_first: bool):
    """A function on Arrow arrays: each value's first key by (whether it is another text, order, key), with what is taken from its row."""

    def found(values: pa.Array) -> pa.Array:
        patterns, columns = data.value
        coded = pc.dictionary_encode(values)
        distinct = coded.dictionary.to_pylist()
        places = pa.array([patterns.place(v, exact_first) if v else None for v in distinct], pa.int64()).take(coded.indices)
        other = pa.array([not exact_first or v not in patterns.first for v in distinct], pa.bool_()).take(coded.indices)
        return pa.StructArray.from_arrays([other, *[c.take(places) for c in columns]], names=["other", "o", "k", "t"], mask=pc.is_null(places))

    return found


def first_contained(df: DataFrame, value: str, dim: DataFrame, key: str, order: str, take: str, exact_first: bool = True) -> DataFrame:
    """The first dimension row (by `order`, then key) whose key is the value, or starts it, or is started by it, or lies in it.

    Rows are not dealt anew: each task walks its values through an automaton of the keys. Keys come in blocks of
    about AUTOMATON_BYTES, an automaton each, so what a task holds is bounded. Null and empty values and values
    without a key have null; null keys match nothing.
    """
    rows = dim.select(F.col(key).alias("k"), F.col(order).alias("o"), F.col(take).alias("t")).filter("k IS NOT NULL")
    first = rows.groupBy("k").agg(F.min(F.struct("o", "t")).alias("f")).select("f.o", "k", "f.t")
    blocks = max(1, -(-(first.agg(F.sum(F.octet_length("k") + 32)).first()[0] or 0) // AUTOMATON_BYTES))
    kinds = [(n, first.schema[n].dataType) for n in ("o", "k", "t")]
    shape = ", ".join(["other boolean", *[f"{n} {k.simpleString()}" for n, k in kinds]])
    out = df
    for block in range(blocks):
        held = first.filter(F.pmod(F.xxhash64("k"), F.lit(blocks)) == block).orderBy("o", "k").collect()  # of counted bytes
        columns = [pa.array([r[n] for r in held], to_arrow_type(k)) for n, k in kinds]
        data = df.sparkSession.sparkContext.broadcast((Patterns([r["k"] for r in held]), columns))
        out = out.withColumn(f"_found_{block}", F.arrow_udf(matcher(data, exact_first), shape)(F.col(value)))
    names = [f"_found_{block}" for block in range(blocks)]
    best = F.least(*names) if blocks > 1 else F.col(names[0])
    return out.withColumn(take, best["t"]).drop(*names)


def planar_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column, at_degrees: float = 34.0) -> Column:
    """Distance on a plane: 111 km a degree, longitudes shortened at the given latitude."""
    dlat = (lat1 - lat2) * 111.0
    dlon = (lon1 - lon2) * 111.0 * F.cos(F.radians(F.lit(at_degrees)))
    return F.sqrt(dlat * dlat + dlon * dlon)


def plane(lat: Column, lon: Column, at_degrees: float = 34.0) -> tuple[Column, Column]:
    """Coordinates in which planar_km is the straight distance."""
    return lon * 111.0 * F.cos(F.radians(F.lit(at_degrees))), lat * 111.0


def neighbours_mean(groups: DataFrame, key: str, at: str, value: str, k: int = 3) -> DataFrame:
    """(key, estimate): the mean of the k nearest other groups by `at` (ties: the least key), weighted by inverse distance (at least 1e-6)."""
    other = groups.select(F.col(key).alias("_key"), F.col(at).alias("_at"), F.col(value).alias("_value"))
    away = F.greatest(F.abs(F.col(at) - F.col("_at")), F.lit(1e-6))
    line = lambda c: (F.col(c).cast("double"), F.lit(0.0))
    near = k_nearest(groups.select(at).distinct(), other, line(at), line("_at"), away, ["_key"], ["_value"], k=k + 1, least=1e-6)
    own = groups.select(key, at).join(near, at)
    own = own.select(key, F.slice(F.filter("near", lambda x: x["_key"] != F.col(key)), 1, k).alias("near"))
    weigh = lambda f: F.aggregate("near", F.lit(0.0), lambda a, x: a + f(x))
    return own.filter(F.size("near") > 0).select(key, (weigh(lambda x: x["_value"] / x["distance"]) / weigh(lambda x: 1 / x["distance"])).alias("estimate"))
