"""The k nearest places of each point, exactly and without all pairs: a pyramid of grids.

Places lie in square cells, and each level's cells are four of the level below. If the 3 x 3 cells around a
point hold k places at some level, the k nearest are less than 2.83 cells away, so the 3 x 3 cells two levels up,
which reach 4 of those cells in every direction, hold them and all ties. Two equi joins on cells do the rest.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def k_nearest(points: DataFrame, places: DataFrame, at: tuple[Column, Column], place_at: tuple[Column, Column], distance: Column, order: list[str], take: list[str], k: int = 1, least: float = 1e-6) -> DataFrame:
    """The points (distinct rows) with `near`: an array of (distance, order, take) structs of their k nearest places, nearest first, ties by `order`.

    `distance` must not differ by more than `least` from the straight distance of the coordinates. Of places at one
    spot only the first k count, so hot spots stay small. A point far outside the places' extent, or with fewer than k
    places near it at every level, meets all places. Points and places without finite coordinates take no part: their
    `near` is null. No places: null.
    """
    own, x, y = points.columns, F.col("_x"), F.col("_y")
    finite = (F.abs(x) < float("inf")) & (F.abs(y) < float("inf"))
    here = points.withColumns({"_x": at[0].cast("double"), "_y": at[1].cast("double")}).filter(finite)
    rest = list(dict.fromkeys([*order, *take]))
    spots = places.withColumns({"_x": place_at[0].cast("double"), "_y": place_at[1].cast("double")}).filter(finite)
    first = F.row_number().over(Window.partitionBy("_x", "_y").orderBy(*order))
    spots = spots.withColumn("_first", first).filter(F.col("_first") <= k).drop("_first")
    n, x0, x1, y0, y1 = spots.agg(F.count(F.lit(1)), F.min("_x"), F.max("_x"), F.min("_y"), F.max("_y")).first()
    size, top = least, 0
    if n:
        wide, high = x1 - x0, y1 - y0
        size = max(math.sqrt(wide * high / n) if wide and high else max(wide, high) / n, max(wide, high) / 2**30, 4 * least)
        top = max(1, math.ceil(max(wide, high) / size)).bit_length()
    cell = lambda c, low: F.floor((c - F.lit(float(low or 0.0))) / size).cast("long")
    cells = {"_cx": cell(x, x0), "_cy": cell(y, y0)}
    up = lambda c: F.expr(f"shiftright({c}, _level)")
    levels = F.explode(F.sequence(F.lit(0), F.lit(top))).alias("_level")

    spots = spots.withColumns(cells)
    at_levels = spots.select("*", levels).withColumns({"_nx": up("_cx"), "_ny": up("_cy")})
    at_all = spots.withColumns({"_level": F.lit(top + 1), "_nx": F.lit(0).cast("long"), "_ny": F.lit(0).cast("long")})
    counts = at_levels.groupBy("_level", "_nx", "_ny").agg(F.count(F.lit(1)).alias("_n"))

    here = here.withColumns(cells)
    around = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])).alias("_by")
    beside = {"_nx": up("_cx") + F.col("_by.i"), "_ny": up("_cy") + F.col("_by.j")}
    held = here.select("_cx", "_cy").distinct().select("*", levels).select("*", around).withColumns(beside).join(counts, ["_level", "_nx", "_ny"])
    held = held.groupBy("_cx", "_cy", "_level").agg(F.sum("_n").alias("_n")).filter(F.col("_n") >= k)
    held = held.groupBy("_cx", "_cy").agg((F.min("_level") + 2).alias("_at"))
    sought = here.join(held, ["_cx", "_cy"], "left").withColumn("_level", F.least(F.coalesce("_at", F.lit(top + 1)), F.lit(top + 1)))
    once = F.when(F.col("_level") > top, F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j")))).otherwise(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    all_cells = {c: F.when(F.col("_level") > top, F.lit(0).cast("long")).otherwise(e) for c, e in beside.items()}
    sought = sought.select(*own, "_level", "_cx", "_cy", F.explode(once).alias("_by")).withColumns(all_cells).select(*own, "_level", "_nx", "_ny")
    columns = ["_level", "_nx", "_ny", *[c for c in places.columns]]
    pairs = sought.join(at_levels.select(*columns).unionByName(at_all.select(*columns)), ["_level", "_nx", "_ny"])
    found = F.struct(distance.alias("distance"), *rest)
    near = pairs.select(*own, found.alias("_found"))
    if k == 1:
        near = near.groupBy(*own).agg(F.array(F.min("_found")).alias("near"))
    else:
        ranked = near.withColumn("_r", F.row_number().over(Window.partitionBy(*own).orderBy("_found"))).filter(F.col("_r") <= k)
        near = ranked.groupBy(*own).agg(F.sort_array(F.collect_list("_found")).alias("near"))
    near = near.select(*[F.col(c).alias(f"_near_{c}") for c in own], "near")
    return points.join(near, [F.col(c).eqNullSafe(F.col(f"_near_{c}")) for c in own], "left").select(*own, "near")
