"""Weights, normalisations, encodings, indices and simulations."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadastra.operators.impute import uniform


def clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(x, F.lit(high)), F.lit(low))


def minmax(df: DataFrame, value: str, output: str) -> DataFrame:
    """0 to 1 over all rows; a constant column keeps its clipped value, null becomes 0.5."""
    ends = df.agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    x = F.when(F.col("_hi") == F.col("_lo"), clip(F.col(value), 0.0, 1.0)).otherwise(F.try_divide(F.col(value) - F.col("_lo"), F.col("_hi") - F.col("_lo")))
    return df.join(F.broadcast(ends), how="cross").withColumn(output, F.coalesce(x, F.lit(0.5))).drop("_lo", "_hi")


def weighted_minmax(df: DataFrame, parts: list[tuple[Column, float]], output: str, digits: int = 4) -> DataFrame:
    """The weighted sum of the parts, each scaled to 0 to 1 over all rows: one pass finds all ends."""
    names = [f"_part_{i}" for i in range(len(parts))]
    wide = df.select("*", *[c.alias(n) for (c, _), n in zip(parts, names, strict=True)])
    ends = wide.agg(*[f(n).alias(f"{n}_{e}") for n in names for f, e in ((F.min, "lo"), (F.max, "hi"))])

    def scaled(n: str) -> Column:
        low, high = F.col(f"{n}_lo"), F.col(f"{n}_hi")
        return F.coalesce(F.when(low == high, clip(F.col(n), 0.0, 1.0)).otherwise((F.col(n) - low) / F.nullif(high - low, F.lit(0.0))), F.lit(0.5))

    score = sum((scaled(n) * w for n, (_, w) in zip(names, parts, strict=True)), F.lit(0.0))
    out = wide.join(F.broadcast(ends), how="cross").withColumn(output, F.round(score, digits))
    return out.select(*df.columns, output)


def hierarchical_code(df: DataFrame, group: str, key: str, rare: int) -> DataFrame:
    """(group, key, n, code): group * 1000 + rank by frequency; keys rarer than `rare` share group * 1000."""
    n = df.groupBy(group, key).agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("n"), key))
    return n.withColumn("code", (F.col(group) * 1000 + F.when(F.col("n") >= rare, rank).otherwise(0)).cast("long"))


def decile(value: str, row: str, partition: list[str]) -> Column:
    """0 to 9 by equal steps of the rank, as a cut of ranks into ten gives it."""
    w = Window.partitionBy(*partition)
    rank, n = F.row_number().over(w.orderBy(value, row)), F.count(F.lit(1)).over(w)
    return F.when(rank == 1, 0).otherwise(F.ceil((rank - 1) * 10 / (n - 1)) - 1).cast("int")


def inverse_frequency(df: DataFrame, key: str, cap: float) -> DataFrame:
    """(key, n, weight): total / (categories * n), capped, then divided by its mean over the categories."""
    n = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    every = Window.partitionBy(F.lit(0))
    w = n.withColumn("w", F.least(F.sum("n").over(every) / (F.count(F.lit(1)).over(every) * F.col("n")), F.lit(cap)))
    return w.withColumn("weight", F.col("w") / F.avg("w").over(every)).drop("w")


def shrunk(own: Column, n: Column, wider: Column, full: int = 100, some: int = 30) -> Column:
    """A group's median, drawn to the wider one the fewer rows it has: 1, 0.7 and 0.3 of its own."""
    return F.when(n >= full, own).when(n >= some, 0.7 * own + 0.3 * wider).otherwise(0.3 * own + 0.7 * wider)


def market_cycle(growth: Column, inflation: Column, rate: Column) -> Column:
    """Phases by quarterly growth, inflation and the key rate, first match wins."""
    phases = [
        ("peak", (growth >= 2) & (inflation < 6) & (rate < 7.5)),
        ("growth", (growth >= 0.5) & (inflation < 7)),
        ("recovery", growth.between(-1, 0) & (growth < 0)),
        ("decline", (growth < -1) | ((rate >= 8) & (inflation > 8))),
    ]
    return F.coalesce(*[F.when(holds, F.lit(name)) for name, holds in phases], F.lit("stabilization"))


def pressure(base: Column, days: Column, half_life: Column, slope: Column, cap: Column, low: float = 0.03, high: float = 0.2) -> Column:
    """A discount that grows with the logarithm of the days on the market."""
    return clip(base + F.least(slope * F.log(1 + F.coalesce(F.nullif(days, F.lit(0)), F.lit(30)) / half_life), cap), low, high)


def monte_carlo(df: DataFrame, key: str, mean: Column, spread: Column, n: int) -> DataFrame:
    """Normal draws by Box-Muller from md5 uniforms; mean, 5th percentile, mean below it, mean / spread, share above 0."""
    draws = df.select(key, mean.alias("m"), spread.alias("s"), F.explode(F.sequence(F.lit(1), F.lit(n))).alias("i"))
    u1 = F.greatest(uniform(F.col(key), F.col("i"), F.lit("a")), F.lit(1e-12))
    x = F.col("m") + F.col("s") * F.sqrt(-2 * F.log(u1)) * F.cos(F.lit(2 * math.pi) * uniform(F.col(key), F.col("i"), F.lit("b")))
    draws = draws.select(key, x.alias("x"))
    stats = draws.groupBy(key).agg(F.avg("x").alias("mean"), F.stddev_samp("x").alias("sd"), F.percentile("x", F.lit(0.05)).alias("var_95"), F.avg((F.col("x") > 0).cast("int")).alias("prob_gain"))
    tail = draws.join(stats.select(key, "var_95"), key).filter(F.col("x") < F.col("var_95")).groupBy(key).agg(F.avg("x").alias("cvar"))
    return stats.join(tail, key, "left").withColumn("sharpe", F.try_divide(F.col("mean"), F.col("sd")))


def balanced(df: DataFrame, label: str, row: str, target: int, salt: str) -> DataFrame:
    """`target` rows of each label in an md5 order: the first ones, or all again and again; `copy` numbers the turns."""
    turn = F.row_number().over(Window.partitionBy(label).orderBy(F.md5(F.concat_ws("-", F.col(row).cast("string"), F.lit(salt))), row))
    numbered = df.withColumn("_turn", turn).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(label)))
    copies = F.floor((F.lit(target) - F.col("_turn")) / F.col("_n"))
    return numbered.filter(F.col("_turn") <= target).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), copies))).drop("_turn", "_n")
