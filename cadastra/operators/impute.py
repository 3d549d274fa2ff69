"""Filling of missing values, and outliers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadastra.operators.lookup import dimension
from cadastra.sources.folders import written

#: Groups above the bound of `percentiles` that are told apart from the rest; with more all are bracketed.
LARGE_GROUPS = 10_000


def percentiles(df: DataFrame, keys: list[str], value: str, shares: list[float], name: str, accuracy: int = 100_000) -> DataFrame:
    """Exact interpolated percentiles of each group (no keys: of all rows) as an array, without all values of a large group in one task.

    Groups of fewer than 10 * accuracy rows come from one aggregate. The others, which are counted first, are fewer than
    the rows over that bound: their ranks are bracketed and counted (see bracketed). Nulls are left out; a group of nulls
    has nulls.
    """
    rows = df.select(*keys, F.col(value).cast("double").alias("_v"))
    plain = lambda x: x.groupBy(*keys).agg(F.percentile("_v", F.array(*[F.lit(float(p)) for p in shares])).alias(name)).select(*keys, F.coalesce(name, F.array(*[F.lit(None).cast("double")] * len(shares))).alias(name))
    sizes = rows.groupBy(*keys).agg(F.count("_v").alias("_size")).filter(F.col("_size") >= 10 * accuracy)
    large = sizes.limit(LARGE_GROUPS).collect()
    if not large:
        return plain(rows)
    if not keys or len(large) == LARGE_GROUPS:
        return bracketed(rows, keys, shares, name, accuracy)
    own = df.sparkSession.createDataFrame(large, sizes.schema).drop("_size")
    same = reduce(lambda a, b: a & b, [F.col(f"_l.{k}").eqNullSafe(F.col(f"_r.{k}")) for k in keys])
    split = lambda how: rows.alias("_l").join(F.broadcast(own.alias("_r")), same, how)
    return bracketed(split("left_semi"), keys, shares, name, accuracy).unionByName(plain(split("left_anti")))


def bracketed(rows: DataFrame, keys: list[str], shares: list[float], name: str, accuracy: int) -> DataFrame:
    """Percentiles of `_v` in large groups: a sketch, whose ranks are off by a share of 1 / accuracy at most, brackets each
    rank between two values 4 / accuracy of the rows apart; rows are counted by value inside the brackets and as a whole
    between them, so what meets in one task is a ten-thousandth of the group."""
    v, margin = F.col("_v"), 2 / accuracy
    ends = [F.lit(min(max(p + m, 0.0), 1.0)) for p in shares for m in (-margin, margin)]
    cuts = written(rows.groupBy(*keys).agg(F.percentile_approx("_v", F.array(*ends), accuracy).alias("_ends"), F.count("_v").alias("_n")))
    large, known = F.col("_n") >= 10 * accuracy, []
    for i, p in enumerate(shares):
        low = F.when(large & F.lit(p > margin), F.col("_ends")[2 * i]).otherwise(float("-inf"))
        known.append((low, F.when(large & F.lit(p < 1 - margin), F.col("_ends")[2 * i + 1]).otherwise(float("inf"))))
    if keys:
        same = [F.col(f"_l.{k}").eqNullSafe(F.col(f"_r.{k}")) for k in keys]
        rows = rows.alias("_l").join(dimension(cuts).alias("_r"), same).select(*[F.col(f"_l.{k}").alias(k) for k in keys], "_v", "_ends", "_n")
    else:
        rows = rows.join(F.broadcast(cuts), how="cross")
    inside, last = F.lit(False), F.lit(float("inf"))
    for low, high in known:
        inside, last = inside | v.between(low, high), F.least(last, F.when(low > v, low).otherwise(float("inf")))
    steps = rows.select(*keys, "_n", F.when(inside, v).otherwise(last).alias("_at"), F.coalesce(inside, F.lit(False)).alias("_in"), "_v")
    steps = steps.groupBy(*keys, "_n", "_at", "_in").agg(F.count("_v").alias("_c"))
    steps = steps.withColumn("_c", F.sum("_c").over(Window.partitionBy(*keys).orderBy("_at", "_in")))
    place = [(F.col("_n") - 1) * F.lit(p) for p in shares]
    found = [F.min(F.when((F.col("_n") > 0) & (F.col("_c") > f(x)), F.struct("_at", "_in"))).alias(f"_{n}_{i}") for i, x in enumerate(place) for n, f in (("a", F.floor), ("b", F.ceil))]
    out, got = steps.groupBy(*keys, "_n").agg(*found), []
    for i, x in enumerate(place):
        a, b = F.col(f"_a_{i}"), F.col(f"_b_{i}")
        mixed = (F.ceil(x) - x) * a["_at"] + (x - F.floor(x)) * b["_at"]
        got.append(F.when(~(a["_in"] & b["_in"]), F.raise_error(F.lit("a percentile outside its bracket")).cast("double")).when(a["_at"] == b["_at"], a["_at"]).otherwise(mixed))
    return out.select(*keys, F.array(*got).alias(name))


def group_medians(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """(keys, median) of the groups."""
    return percentiles(df, keys, value, [0.5], "_q").select(*keys, F.col("_q")[0].alias(name))


def group_summary(df: DataFrame, keys: list[str], medians: dict[str, Column], *others: Column) -> DataFrame:
    """A row for each group: exact medians of columns, all worked out at once, and other aggregates; no keys: one row."""
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("n"), c.cast("double").alias("x")) for n, c in medians.items()]))
    long = percentiles(df.select(*keys, each.alias("_e")).select(*keys, F.col("_e.n").alias("_which"), F.col("_e.x").alias("_x")), [*keys, "_which"], "_x", [0.5], "_q")
    wide = long.groupBy(*keys).agg(*[F.max(F.when(F.col("_which") == n, F.col("_q")[0])).alias(n) for n in medians])
    if not others:
        return wide
    rest = df.groupBy(*keys).agg(*others)
    if not keys:
        return rest.join(F.broadcast(wide), how="cross")
    same = reduce(lambda a, b: a & b, [F.col(f"_l.{k}").eqNullSafe(F.col(f"_r.{k}")) for k in keys])
    return rest.alias("_l").join(wide.alias("_r"), same).select("_l.*", *medians)


def hierarchical(df: DataFrame, value: str, levels: list[list[str]], output: str) -> DataFrame:
    """The value, else the median of the first level (list of keys; [] is all rows) that has one."""
    names, out = [], df
    for i, keys in enumerate(levels):
        names.append(f"_median_{i}")
        medians = written(group_medians(df, keys, value, names[-1]))
        out = out.join(dimension(medians), keys, "left") if keys else out.join(F.broadcast(medians), how="cross")
    return out.withColumn(output, F.coalesce(F.col(value), *[F.col(n) for n in names])).drop(*names)


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the md5 of the parts: the same for any partitioning, and in any engine."""
    text = F.concat_ws("-", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def drawn(u: Column, choices: list[tuple[Column, float]]) -> Column:
    """The choice into whose share of the weights a number in [0, 1) falls."""
    total, above = sum(w for _, w in choices), 0.0
    ends = []
    for c, w in choices:
        above += w
        ends.append((c, above / total))
    out = ends[-1][0]
    for c, end in reversed(ends[:-1]):
        out = F.when(u < end, c).otherwise(out)
    return out


def filled_with_mode(df: DataFrame, keys: list[str], value: str, default: str) -> DataFrame:
    """Missing values by the most frequent one of their group (ties: the smallest), else the default."""
    n = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    best = F.min_by(value, F.struct(-F.col("_n"), value)).alias("_mode")
    return df.join(n.groupBy(*keys).agg(best), keys, "left").withColumn(value, F.coalesce(value, "_mode", F.lit(default))).drop("_mode")


def with_mode(df: DataFrame, value: str) -> DataFrame:
    """Missing values by the most frequent one of all rows (ties: the smallest)."""
    n = df.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("_n"))
    mode = n.agg(F.min_by(value, F.struct(-F.col("_n"), value)).alias("_mode"))
    return df.join(F.broadcast(mode), how="cross").withColumn(value, F.coalesce(value, "_mode")).drop("_mode")  # one row


def numbered(df: DataFrame, keys: list[str], row: str, output: str) -> DataFrame:
    """df with a number from 0 on in each group, in an order by the md5 of the row's id: counted in 4,096 buckets, so that no group meets in one task."""
    df = df.withColumn("_bucket", F.substring(F.md5(F.col(row).cast("string")), 1, 3))
    ahead = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = df.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_size"))
    sizes = sizes.select(*keys, "_bucket", F.coalesce(F.sum("_size").over(ahead), F.lit(0)).alias("_ahead"))
    own = F.row_number().over(Window.partitionBy(*keys, "_bucket").orderBy(row)) - 1
    return df.withColumn("_own", own).join(sizes, [*keys, "_bucket"]).withColumn(output, (F.col("_ahead") + F.col("_own")).cast("long")).drop("_bucket", "_own", "_ahead")


def hot_deck(df: DataFrame, row: str, value: str, salt: str, output: str) -> DataFrame:
    """Missing values drawn from the known ones by a hash of the row's id."""
    donors = df.filter(F.col(value).isNotNull())
    n = donors.count()
    if not n:
        return df.withColumn(output, F.col(value))
    deck = numbered(donors.select(F.col(value).alias("_donor"), row, F.lit(0).alias("_all")), ["_all"], row, "_slot").select("_donor", "_slot")
    drawn = df.withColumn("_slot", F.floor(uniform(F.col(row), F.lit(salt)) * n).cast("long"))
    return drawn.join(deck, "_slot", "left").withColumn(output, F.coalesce(F.col(value), F.col("_donor"))).drop("_slot", "_donor")


def rate_tiered(df: DataFrame, group: str, row: str, value: str, salt: str, output: str, most: float = 0.6) -> DataFrame:
    """Missing values of a group: its median while no more than `most` are missing, else drawn from its known ones."""
    stats = df.groupBy(group).agg(F.count(F.lit(1)).alias("_n"), F.count(value).alias("_known")).join(group_medians(df, [group], value, "_median"), group)
    stats = dimension(written(stats.withColumn("_drawn", 1 - F.col("_known") / F.col("_n") > most)))
    known = df.join(stats, group)  # few groups are broadcast: rows of a large one stay where they are
    deck = numbered(known.filter(F.col("_drawn") & F.col(value).isNotNull()).select(group, row, F.col(value).alias("_donor")), [group], row, "_slot").select(group, "_slot", "_donor")
    missing = F.col("_drawn") & F.col(value).isNull()
    slot = F.floor(uniform(F.col(row), F.lit(salt)) * F.col("_known")).cast("long")
    drawn = known.filter(missing).withColumn("_slot", slot).join(deck, [group, "_slot"], "left").withColumn(output, F.col("_donor"))
    rest = known.filter(~missing).withColumn(output, F.coalesce(F.col(value), F.col("_median")))
    names = [c for c in df.columns if c != output] + [output]
    return drawn.select(*names).unionByName(rest.select(*names))


def filled_with_medians(df: DataFrame, columns: list[str]) -> DataFrame:
    """Each column's missing values by its median."""
    for c in columns:
        m = group_medians(df, [], c, f"_m_{c}")
        df = df.join(F.broadcast(m), how="cross").withColumn(c, F.coalesce(F.col(c).cast("double"), F.col(f"_m_{c}"))).drop(f"_m_{c}")
    return df


def without_empty(df: DataFrame, most: float, protected: list[str]) -> DataFrame:
    """df without the columns that are null in more than `most` of the rows or hold one value alone, but for protected ones."""
    share = [F.avg(F.col(c).isNull().cast("int")).alias(f"null_{c}") for c in df.columns]
    ends = [x for c in df.columns for x in (F.min(c).alias(f"min_{c}"), F.max(c).alias(f"max_{c}"))]
    row = df.agg(*share, *ends).first()
    gone = [c for c in df.columns if c not in protected and row[f"null_{c}"] is not None and (row[f"null_{c}"] > most or (row[f"null_{c}"] == 0 and row[f"min_{c}"] == row[f"max_{c}"]))]
    return df.drop(*gone)


def quantile_trim(df: DataFrame, columns: list[str], low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Rows within the quantiles, column after column, each on what the one before left; nulls stay."""
    for c in columns:
        q = percentiles(df, [], c, [low, high], "_q")
        df = df.join(F.broadcast(q), how="cross").filter(F.coalesce(F.col(c).between(F.col("_q")[0], F.col("_q")[1]), F.lit(True))).drop("_q")
    return df


def iqr_fences(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Quartiles, fences at 1.5 times their distance, and rows beyond."""
    q = written(percentiles(df, keys, value, [0.25, 0.75], "_q"))
    q = q.select(*keys, F.col("_q")[0].alias("q1"), F.col("_q")[1].alias("q3"))
    q = q.withColumn("low", F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))).withColumn("high", F.col("q3") + 1.5 * (F.col("q3") - F.col("q1")))
    out = df.join(dimension(q), keys).filter((F.col(value) < F.col("low")) | (F.col(value) > F.col("high"))).groupBy(*keys).agg(F.count(F.lit(1)).alias("n_out"))
    return q.join(out, keys, "left").withColumn("n_out", F.coalesce("n_out", F.lit(0)).cast("long"))


def distance_trim(df: DataFrame, columns: list[str], share: float) -> DataFrame:
    """Rows whose distance from the mean in population standard deviations is within the quantile 1 - share."""
    stats = df.agg(*[f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    z = sum((F.pow(F.try_divide(F.col(c) - F.col(f"_m_{c}"), F.col(f"_s_{c}")), 2) for c in columns), F.lit(0.0))
    scored = df.join(F.broadcast(stats), how="cross").withColumn("z", F.sqrt(z)).drop(*[f"_{n}_{c}" for c in columns for n in "ms"])
    cut = percentiles(scored, [], "z", [1 - share], "_q").select(F.col("_q")[0].alias("_cut"))
    return scored.join(F.broadcast(cut), how="cross").filter(F.col("z") <= F.col("_cut")).drop("_cut")
