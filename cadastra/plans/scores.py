"""Queries on scores of regions, bounds of prices, months, telephone numbers and missing dates."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadastra.functions import dates, fixed, text
from cadastra.operators import dedup, impute, lookup, scoring
from cadastra.plans.tables import LISTINGS, listings, read

QUERIES: dict = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


def _scaled(c: str) -> str:
    return f"coalesce(CASE WHEN min({c}) OVER () = max({c}) OVER () THEN greatest(least({c}, 1), 0) ELSE ({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()) END, 0.5)"


@query(f"""WITH g AS (SELECT c_nationkey AS k, avg(o_custkey % 10) AS infl, avg(o_orderkey % 7) AS gdp, greatest(least(avg(o_totalprice) / 200000 - 1, 0.5), -0.5) AS change FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1)
SELECT k, round(0.35 * {_scaled('infl')} + 0.40 * {_scaled('gdp')} + 0.25 * {_scaled('change')}, 4)::DOUBLE AS macro FROM g""")
def macro_score(spark, sf_dir):
    c = read(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("k"))
    o = read(spark, sf_dir, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"))
    g = o.groupBy("k").agg(F.avg(F.col("o_custkey") % 10).alias("infl"), F.avg(F.col("o_orderkey") % 7).alias("gdp"), F.avg("o_totalprice").alias("p"))
    change = scoring.clip(F.col("p") / 200000 - 1, -0.5, 0.5)
    return scoring.weighted_minmax(g, [(F.col("infl"), 0.35), (F.col("gdp"), 0.40), (change, 0.25)], "macro").select("k", "macro")


@query(f"""WITH g AS (SELECT c_nationkey AS k, (avg(1 + c_custkey % 5) - 1) / 4 AS note, avg(1 + c_custkey % 4) / 5 AS density, ln(1 + count(*)) AS amenities, avg(c_acctbal) AS roads, ln(1 + count(*) FILTER (WHERE c_acctbal > 5000)) AS stops FROM customer GROUP BY 1)
SELECT k, round(0.30 * {_scaled('note')} + 0.20 * {_scaled('density')} + 0.20 * {_scaled('amenities')} + 0.15 * {_scaled('roads')} + 0.15 * {_scaled('stops')}, 4)::DOUBLE AS attractive FROM g""")
def attractiveness_score(spark, sf_dir):
    g = read(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(
        F.avg(1 + F.col("c_custkey") % 5).alias("note"), F.avg(1 + F.col("c_custkey") % 4).alias("density"), F.count(F.lit(1)).alias("n"), F.avg("c_acctbal").alias("roads"), F.count_if(F.col("c_acctbal") > 5000).alias("stops")
    )
    parts = [((F.col("note") - 1) / 4, 0.30), (F.col("density") / 5, 0.20), (F.log1p("n"), 0.20), (F.col("roads"), 0.15), (F.log1p("stops"), 0.15)]
    return scoring.weighted_minmax(g, parts, "attractive").select("k", "attractive")


@query("""WITH s AS (SELECT s_nationkey, count(*) AS places, max(s_acctbal) AS score FROM supplier WHERE s_nationkey % 5 > 0 GROUP BY 1),
f AS (SELECT n_nationkey, coalesce(score, 0) AS score, coalesce(places, 0) AS places FROM nation LEFT JOIN s ON s_nationkey = n_nationkey)
SELECT n_nationkey, round(score / 100, 4) AS score, CASE WHEN max(score) OVER () > 0 THEN round(score / max(score) OVER (), 4) ELSE 0 END AS score_norm, places::BIGINT AS places, CASE WHEN max(places) OVER () > 0 THEN round(places / max(places) OVER (), 4) ELSE 0 END AS places_norm FROM f""")
def region_features(spark, sf_dir):
    s = read(spark, sf_dir, "supplier").filter("s_nationkey % 5 > 0").groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("places"), F.max("s_acctbal").alias("score"))
    f = read(spark, sf_dir, "nation").join(s, F.col("s_nationkey") == F.col("n_nationkey"), "left").fillna(0, ["places", "score"])
    most = f.agg(F.max("places").alias("_p"), F.max("score").alias("_s"))
    norm = lambda c, m: F.when(F.col(m) > 0, F.round(F.col(c) / F.col(m), 4)).otherwise(0.0)
    f = f.join(F.broadcast(most), how="cross")
    return f.select("n_nationkey", F.round(F.col("score") / 100, 4).alias("score"), norm("score", "_s").alias("score_norm"), "places", norm("places", "_p").alias("places_norm"))


_LEVEL = "CASE substring(o_orderpriority, 1, 1) WHEN '1' THEN ' Very_High' WHEN '2' THEN 'high' WHEN '3' THEN 'LOW ' WHEN '4' THEN NULL ELSE 'very_low' END"


@query(f"SELECT o_custkey, round(avg(CASE trim(lower({_LEVEL})) WHEN 'very_high' THEN 5 WHEN 'high' THEN 4 WHEN 'medium' THEN 3 WHEN 'low' THEN 2 WHEN 'very_low' THEN 1 ELSE 3 END), 4) AS level FROM orders GROUP BY 1")
def ordinal_levels(spark, sf_dir):
    levels = F.create_map(*[F.lit(x) for kv in fixed.LEVELS.items() for x in kv])
    level = F.coalesce(F.try_element_at(levels, F.trim(F.lower(F.expr(_LEVEL)))), F.lit(fixed.LEVEL_DEFAULT))
    return read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.round(F.avg(level), 4).alias("level"))


@query("SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 50000 THEN 'medium' ELSE 'low' END AS density FROM orders")
def population_class(spark, sf_dir):
    out = F.lit("low")
    for above, label in reversed(fixed.POPULATION_STEPS):
        out = F.when(F.col("o_totalprice") > above, label).otherwise(out)
    return read(spark, sf_dir, "orders").select("o_orderkey", out.alias("density"))


@query("""WITH p AS (SELECT p_partkey, p_brand, CASE WHEN p_partkey % 6 > 0 AND p_brand <> 'Brand#1' THEN p_type END AS kind FROM part), n AS (SELECT p_brand, kind, count(*) AS n FROM p WHERE kind IS NOT NULL GROUP BY 1, 2),
m AS (SELECT p_brand, kind AS top FROM n QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, kind) = 1) SELECT p_partkey, coalesce(kind, top, 'Divers') AS kind FROM p LEFT JOIN m USING (p_brand)""")
def mode_fill(spark, sf_dir):
    kind = F.when((F.col("p_partkey") % 6 > 0) & (F.col("p_brand") != "Brand#1"), F.col("p_type"))
    p = read(spark, sf_dir, "part").select("p_partkey", "p_brand", kind.alias("kind"))
    return impute.filled_with_mode(p, ["p_brand"], "kind", "Divers").select("p_partkey", "kind")


#: Texts with telephone numbers of eight forms, from the md5 of an order's number.
CALL = """CASE o_orderkey % 8
 WHEN 0 THEN concat('Tel: +216 ', substring(d, 1, 2), ' ', substring(d, 3, 3), ' ', substring(d, 6, 3), ', matin')
 WHEN 1 THEN concat('+216', d) WHEN 2 THEN concat('216', d, ' ou 2', substring(d, 1, 7))
 WHEN 3 THEN concat('appelez 9', substring(d, 2, 7)) WHEN 4 THEN concat('ref 1', substring(d, 2, 7))
 WHEN 5 THEN concat('x5', substring(d, 2, 7), ' / 7', substring(d, 1, 7)) WHEN 6 THEN '' END"""
DIGITS = "lpad(CAST(o_orderkey * 7919 % 100000000 AS STRING), 8, '0')"


@query(f"""WITH c AS (SELECT o_orderkey, {CALL} AS c FROM (SELECT o_orderkey, {DIGITS} AS d FROM orders)), f AS (SELECT o_orderkey, coalesce({", ".join(f"nullif(regexp_extract(c, '{p}'), '')" for p in text.PHONES)}) AS f FROM c)
SELECT o_orderkey, right(regexp_replace(f, '[^0-9]', '', 'g'), 8) AS phone FROM f""")
def phone_numbers(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select("o_orderkey", F.expr(DIGITS).alias("d"))
    return o.select("o_orderkey", text.phone(F.expr(CALL)).alias("phone"))


_NAMES = "list_extract" + "([" + ", ".join(f"'{m}'" for m in dates.MONTHS) + "], (1 + o_orderkey % 12)::INT)"
_LABEL = "CASE o_custkey % 6 WHEN 0 THEN concat(upper(m), ' ', y) WHEN 1 THEN concat('indice ', m, '-', y, ' (base 100)') WHEN 2 THEN m WHEN 3 THEN concat('trimestre ', y) WHEN 4 THEN concat(m, ' ', substring(y, 1, 3)) END"


@query(f"""WITH l AS (SELECT o_orderkey, lower({_LABEL}) AS t FROM (SELECT o_orderkey, o_custkey, {_NAMES} AS m, CAST(2000 + o_custkey % 30 AS VARCHAR) AS y FROM orders)),
x AS (SELECT o_orderkey, try_cast(nullif(regexp_extract(t, '([0-9]{{4}})', 1), '') AS INT) AS y, CASE {" ".join(f"WHEN contains(t, '{m}') THEN {i}" for i, m in enumerate(dates.MONTHS, 1))} END AS m FROM l)
SELECT o_orderkey, CASE WHEN m IS NOT NULL THEN y END AS year, CASE WHEN y IS NOT NULL THEN m END AS month FROM x""")
def month_labels(spark, sf_dir):
    names = F.array(*[F.lit(m) for m in dates.MONTHS])
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.get(names, (F.col("o_orderkey") % 12).cast("int")).alias("m"), (2000 + F.col("o_custkey") % 30).cast("string").alias("y"))
    return o.select("o_orderkey", dates.french_month(F.expr(_LABEL)).alias("p")).select("o_orderkey", "p.year", "p.month")


@query(f"WITH {LISTINGS} SELECT nation, count(*)::BIGINT AS n, round(avg(price), 2) AS mean_price, round(avg(surface), 4) AS mean_surface FROM listings GROUP BY 1")
def listing_means(spark, sf_dir):
    return listings(spark, sf_dir).groupBy("nation").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("price"), 2).alias("mean_price"), F.round(F.avg("surface"), 4).alias("mean_surface"))


_TOLD = "CASE WHEN p_partkey % 9 = 0 THEN ' ' WHEN p_partkey % 9 = 1 THEN NULL ELSE concat(' ', upper(p_name)) END"


@query(f"""WITH p AS (SELECT p_partkey, nullif(lower(trim({_TOLD})), '') AS t, lower(trim(p_brand)) AS g, CASE WHEN p_size > 10 THEN p_size END AS price FROM part)
SELECT p_partkey FROM p QUALIFY t IS NULL OR row_number() OVER (PARTITION BY t, g, price ORDER BY p_partkey) = 1""")
def dedup_text_region_price(spark, sf_dir):
    p = read(spark, sf_dir, "part").select("p_partkey", dedup.normal(F.expr(_TOLD)).alias("t"), dedup.normal(F.col("p_brand")).alias("g"), F.when(F.col("p_size") > 10, F.col("p_size")).alias("price"))
    blank = F.col("t").isNull()  # dealt by their number, as all of them stay
    keys = [F.col("t"), F.col("g"), F.col("price"), F.when(blank, F.col("p_partkey"))]
    return dedup.keep_first(p, keys, [F.col("p_partkey")]).select("p_partkey")


_SEGMENT = "CASE l_linenumber % 5 WHEN 0 THEN 'residentiel' WHEN 1 THEN 'foncier' WHEN 2 THEN 'commercial' WHEN 3 THEN 'divers' ELSE 'autre' END"
_BOUNDS = ", ".join(f"('{k}', {a}, {b})" for k, (a, b) in fixed.PRICE_M2_BOUNDS.items())


@query(f"""WITH l AS (SELECT l_orderkey, l_linenumber, {_SEGMENT} AS segment, l_extendedprice / nullif(l_quantity, 0) * 3 AS m2, l_discount * 3000 - 60 AS change, l_quantity * 3 - 6 AS idx FROM lineitem)
SELECT l_orderkey, l_linenumber FROM l LEFT JOIN (VALUES {_BOUNDS}) b(segment, lo, hi) USING (segment) WHERE m2 BETWEEN coalesce(lo, 5) AND coalesce(hi, 10000) AND change BETWEEN -50 AND 200 AND idx BETWEEN 0 AND 100""")
def index_range_filters(spark, sf_dir):
    low, high = (F.lit(x) for x in fixed.PRICE_M2_OTHER)
    for name, (a, b) in fixed.PRICE_M2_BOUNDS.items():
        low, high = F.when(F.expr(_SEGMENT) == name, a).otherwise(low), F.when(F.expr(_SEGMENT) == name, b).otherwise(high)
    m2 = F.try_divide("l_extendedprice", "l_quantity") * 3
    change, index = F.col("l_discount") * 3000 - 60, F.col("l_quantity") * 3 - 6
    return read(spark, sf_dir, "lineitem").filter(m2.between(low, high) & change.between(*fixed.CHANGE_BOUNDS) & index.between(0, 100)).select("l_orderkey", "l_linenumber")


@query("SELECT o_orderkey, md5(concat_ws('-', o_orderkey, 42)) AS place FROM orders ORDER BY place, o_orderkey")
def seeded_shuffle(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select("o_orderkey", F.md5(F.concat_ws("-", F.col("o_orderkey").cast("string"), F.lit("42"))).alias("place"))
    return o.orderBy("place", "o_orderkey")


_U = "(('0x' || substring(md5(concat_ws('-', o_orderkey, '{}')), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


def _quarter_rows() -> str:
    total, above, rows = sum(fixed.DATE_SHARES.values()), 0.0, []
    for (y, q), w in sorted(fixed.DATE_SHARES.items()):
        below, above = above, above + w
        rows.append(f"({y}, {q}, {below / total!r}::DOUBLE, {above / total!r}::DOUBLE)")
    return ", ".join(rows)


@query(f"""WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 4 > 0 THEN CAST(o_orderdate AS DATE) END AS own, {_U.format('quarter')} AS u, {_U.format('month')} AS v FROM orders)
SELECT o_orderkey, coalesce(own, make_date(y, ((q - 1) * 3 + 1 + floor(v * 3))::INT, 1)) AS published FROM o JOIN (VALUES {_quarter_rows()}) w(y, q, lo, hi) ON u >= lo AND u < hi""")
def undated_by_quarter(spark, sf_dir):
    key = F.col("o_orderkey")
    month = F.floor(impute.uniform(key, F.lit("month")) * 3).cast("int")
    choices = [(F.make_date(F.lit(y), F.lit((q - 1) * 3 + 1) + month, F.lit(1)), w) for (y, q), w in sorted(fixed.DATE_SHARES.items())]
    own = F.when(key % 4 > 0, F.to_date("o_orderdate"))
    o = read(spark, sf_dir, "orders").select("o_orderkey", own.alias("own"), impute.uniform(key, F.lit("quarter")).alias("u"))
    return o.select("o_orderkey", F.coalesce("own", impute.drawn(F.col("u"), choices)).alias("published"))


@query("""WITH n AS (SELECT o_custkey % 150 AS bucket, month(o_orderdate)::INT AS m, count(*) AS n FROM orders GROUP BY 1, 2), b AS (SELECT bucket, sum(n) AS rows, median(n) AS med FROM n GROUP BY 1)
SELECT bucket, m, CASE WHEN rows > 100 THEN n > med ELSE m IN (3, 4, 5, 9, 10, 11) END AS high FROM n JOIN b USING (bucket)""")
def season_months(spark, sf_dir):
    n = read(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 150).alias("bucket"), F.month("o_orderdate").alias("m")).agg(F.count(F.lit(1)).alias("n"))
    b = n.groupBy("bucket").agg(F.sum("n").alias("rows"), F.median("n").alias("med"))
    high = F.when(F.col("rows") > 100, F.col("n") > F.col("med")).otherwise(F.col("m").isin(fixed.HIGH_SEASON))
    return n.join(lookup.dimension(b), "bucket").select("bucket", "m", high.alias("high"))
