"""Queries of the deduplication, lookup, aggregation, window and set operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cadastra.operators import dedup, impute, lookup, scoring
from cadastra.plans.tables import LISTINGS, listings, read
from cadastra.sources.folders import written

QUERIES: dict = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


@query(f"""WITH {LISTINGS}, m AS (SELECT nation, year(published)::INT AS y, month(published)::INT AS m, avg(CASE WHEN unit_price BETWEEN 500 AND 2000 THEN unit_price END) AS idx FROM listings GROUP BY ALL),
n AS (SELECT nation, median(idx) AS med FROM m GROUP BY 1), g AS (SELECT median(idx) AS med FROM m)
SELECT m.nation, y, m, round(coalesce(idx, n.med, g.med), 4) AS price_index FROM m LEFT JOIN n ON m.nation = n.nation, g""")
def regional_price_index(spark, sf_dir):
    df = listings(spark, sf_dir)
    valid = F.when(F.col("unit_price").between(500, 2000), F.col("unit_price"))
    index = df.groupBy("nation", F.year("published").alias("y"), F.month("published").alias("m")).agg(F.avg(valid).alias("idx"))
    filled = impute.hierarchical(written(index), "idx", [["nation"], []], "price_index")
    return filled.select("nation", "y", "m", F.round("price_index", 4).alias("price_index"))


@query("SELECT DISTINCT user_id, event_type FROM events")
def dedup_strict(spark, sf_dir):
    return dedup.strict(read(spark, sf_dir, "events").select("user_id", "event_type"))


@query("SELECT doc_id FROM (SELECT doc_id, lower(trim(text)) AS k, row_number() OVER (PARTITION BY lower(trim(text)) ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1 OR k IS NULL OR k = ''")
def dedup_key_keep_first(spark, sf_dir):
    df = read(spark, sf_dir, "documents").withColumn("k", dedup.normal(F.col("text")))
    return dedup.keep_first(df, [F.col("k")], [F.col("doc_id")], F.col("k").isNull()).select("doc_id")


@query("""SELECT doc_id FROM (SELECT doc_id, n_chars, row_number() OVER (PARTITION BY source, lower(trim(text)) ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1 OR n_chars < 20""")
def dedup_two_key_masked(spark, sf_dir):
    df = read(spark, sf_dir, "documents").withColumn("k", F.lower(F.trim("text")))
    return dedup.keep_first(df, [F.col("source"), F.col("k")], [F.col("doc_id")], F.col("n_chars") < 20).select("doc_id")


@query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY substring(lower(text), 1, 200), lang ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1")
def dedup_hash_prefix(spark, sf_dir):
    df = read(spark, sf_dir, "documents").withColumn("k", F.substring(F.lower("text"), 1, 200))
    blank = ~F.coalesce(F.col("text").rlike(r"(?U)\S"), F.lit(False))
    keys = [F.col("k"), F.col("lang"), F.when(blank, F.col("doc_id"))]  # blank ones are dealt by their number, as all of them stay
    return dedup.keep_first(df, keys, [F.col("doc_id")], blank).select("doc_id")


@query("SELECT DISTINCT e.user_id, e.event_type FROM events e WHERE e.ts >= TIMESTAMP '2024-01-15' AND NOT EXISTS (SELECT 1 FROM events h WHERE h.ts < TIMESTAMP '2024-01-15' AND h.user_id = e.user_id AND h.event_type = e.event_type)")
def incremental_antijoin(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    old, new = e.filter("ts < timestamp'2024-01-15'"), e.filter("ts >= timestamp'2024-01-15'")
    return dedup.unseen(new, old, ["user_id", "event_type"]).select("user_id", "event_type").distinct()


@query("SELECT c_name AS name, c_nationkey AS nation, c_mktsegment AS segment, 'customer' AS source FROM customer UNION ALL SELECT s_name, s_nationkey, NULL, 'supplier' FROM supplier")
def union_heterogeneous(spark, sf_dir):
    c = read(spark, sf_dir, "customer").select(F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"), F.lit("customer").alias("source"))
    s = read(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"), F.lit("supplier").alias("source"))
    return c.unionByName(s, allowMissingColumns=True)


@query("SELECT DISTINCT c_custkey AS k, 'both' AS kind FROM customer JOIN orders ON c_custkey = o_custkey UNION ALL SELECT c_custkey, 'none' FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def intersect_except_keys(spark, sf_dir):
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"))
    return c.intersect(o).withColumn("kind", F.lit("both")).unionByName(c.exceptAll(o.distinct()).withColumn("kind", F.lit("none")))


BOUNDS = [("1-URGENT", 1000.0, 300000.0), ("2-HIGH", 2000.0, 250000.0), ("3-MEDIUM", 5000.0, 200000.0)]
_VALUES = ", ".join(f"('{p}', {a}, {b})" for p, a, b in BOUNDS)


@query(f"SELECT o_orderkey FROM orders LEFT JOIN (VALUES {_VALUES}) b(p, lo, hi) ON o_orderpriority = p WHERE o_totalprice BETWEEN coalesce(lo, 100.0) AND coalesce(hi, 150000.0)")
def threshold_filter_by_segment(spark, sf_dir):
    bounds = spark.createDataFrame(BOUNDS, "o_orderpriority string, lo double, hi double")
    df = lookup.with_default(read(spark, sf_dir, "orders"), bounds, "o_orderpriority", {"lo": 100.0, "hi": 150000.0})
    return df.filter(F.col("o_totalprice").between(F.col("lo"), F.col("hi"))).select("o_orderkey")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity IS NULL OR l_quantity BETWEEN 1 AND 45 AND NOT (l_returnflag = 'R' AND coalesce(l_extendedprice / nullif(l_quantity, 0) > 1500, false))")
def ratio_guard(spark, sf_dir):
    df = read(spark, sf_dir, "lineitem")
    dear = F.coalesce(F.try_divide("l_extendedprice", "l_quantity") > 1500, F.lit(False))
    return df.filter(F.col("l_quantity").isNull() | F.col("l_quantity").between(1, 45) & ~((F.col("l_returnflag") == "R") & dear)).select("l_orderkey", "l_linenumber")


@query("""SELECT 'o_totalprice' AS name, avg((CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_totalprice END IS NULL)::INT)::DOUBLE AS null_ratio FROM orders
UNION ALL SELECT 'o_orderpriority', avg((nullif(o_orderpriority, '1-URGENT') IS NULL)::INT)::DOUBLE FROM orders UNION ALL SELECT 'o_orderdate', avg((o_orderdate IS NULL)::INT)::DOUBLE FROM orders""")
def null_ratio_profile(spark, sf_dir):
    df = read(spark, sf_dir, "orders").select(F.when(F.col("o_orderkey") % 3 != 0, F.col("o_totalprice")).alias("o_totalprice"), F.nullif("o_orderpriority", F.lit("1-URGENT")).alias("o_orderpriority"), "o_orderdate")
    ratios = df.agg(*[F.avg(F.col(c).isNull().cast("int")).alias(c) for c in df.columns])
    return ratios.unpivot([], df.columns, "name", "null_ratio")


_DESCRIBE = " UNION ALL ".join(f"SELECT '{c}' AS name, count({c})::BIGINT AS n, round(avg({c}), 4) AS mean, round(median({c}::DOUBLE), 4) AS median, round(stddev_samp({c}), 4) AS std, min({c})::DOUBLE AS least, max({c})::DOUBLE AS most FROM part" for c in ("p_size", "p_retailprice"))


@query(_DESCRIBE)
def describe_columns(spark, sf_dir):
    df = read(spark, sf_dir, "part").select(F.col("p_size").cast("double"), "p_retailprice").unpivot([], ["p_size", "p_retailprice"], "name", "x")
    others = [F.count("x").alias("n"), F.round(F.avg("x"), 4).alias("mean"), F.round(F.stddev_samp("x"), 4).alias("std"), F.min("x").alias("least"), F.max("x").alias("most")]
    return impute.group_summary(df, ["name"], {"median": F.col("x")}, *others).withColumn("median", F.round("median", 4))


@query("SELECT o_orderpriority, count(*)::BIGINT AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 4)::DOUBLE AS pct FROM orders GROUP BY 1")
def value_counts_pct(spark, sf_dir):
    n = read(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("pct", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))), 4))


@query("SELECT o_orderpriority, round(avg((o_orderstatus = 'O')::INT), 6)::DOUBLE AS rent_share, round(count(*) / max(count(*)) OVER (), 6)::DOUBLE AS liquidity FROM orders GROUP BY 1")
def rent_share_liquidity(spark, sf_dir):
    g = read(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.round(F.avg((F.col("o_orderstatus") == "O").cast("int")), 6).alias("rent_share"), F.count(F.lit(1)).alias("n"))
    return g.select("o_orderpriority", "rent_share", F.round(F.col("n") / F.max("n").over(Window.partitionBy(F.lit(0))), 6).alias("liquidity"))


@query("SELECT c_nationkey, round(median(c_acctbal), 4) AS med FROM customer GROUP BY 1")
def median_by_key(spark, sf_dir):
    return impute.group_medians(read(spark, sf_dir, "customer"), ["c_nationkey"], "c_acctbal", "m").select("c_nationkey", F.round("m", 4).alias("med"))


@query("SELECT o_custkey, o_orderpriority AS most FROM (SELECT o_custkey, o_orderpriority, row_number() OVER (PARTITION BY o_custkey ORDER BY count(*) DESC, o_orderpriority) AS rn FROM orders GROUP BY 1, 2) WHERE rn = 1")
def mode_by_key(spark, sf_dir):
    n = read(spark, sf_dir, "orders").groupBy("o_custkey", "o_orderpriority").count()
    return n.groupBy("o_custkey").agg(F.min_by("o_orderpriority", F.struct(-F.col("count"), "o_orderpriority")).alias("most"))


@query("""WITH p AS (SELECT o_orderpriority, count(DISTINCT (year(o_orderdate), month(o_orderdate)))::BIGINT AS periods FROM orders GROUP BY 1)
SELECT o_orderpriority, periods, periods >= (SELECT median(periods) FROM p) AS eligible FROM p""")
def distinct_periods(spark, sf_dir):
    p = read(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count_distinct(F.struct(F.year("o_orderdate"), F.month("o_orderdate"))).alias("periods"))
    return p.join(F.broadcast(p.agg(F.median("periods").alias("m"))), how="cross").select("o_orderpriority", "periods", (F.col("periods") >= F.col("m")).alias("eligible"))


@query("""WITH a AS (SELECT *, (SELECT quantile_cont(p_retailprice, 0.01) FROM part) AS lo, (SELECT quantile_cont(p_retailprice, 0.99) FROM part) AS hi FROM part), b AS (SELECT * FROM a WHERE p_retailprice BETWEEN lo AND hi)
SELECT p_partkey FROM b WHERE p_size BETWEEN (SELECT quantile_cont(p_size::DOUBLE, 0.01) FROM b) AND (SELECT quantile_cont(p_size::DOUBLE, 0.99) FROM b)""")
def quantile_trim_sequential(spark, sf_dir):
    return impute.quantile_trim(read(spark, sf_dir, "part"), ["p_retailprice", "p_size"]).select("p_partkey")


@query("""WITH q AS (SELECT l_returnflag, quantile_cont(l_extendedprice, 0.25) AS q1, quantile_cont(l_extendedprice, 0.75) AS q3 FROM lineitem GROUP BY 1), f AS (SELECT *, q1 - 1.5 * (q3 - q1) AS low, q3 + 1.5 * (q3 - q1) AS high FROM q)
SELECT f.l_returnflag, round(q1, 4) AS q1, round(q3, 4) AS q3, round(low, 4) AS low, round(high, 4) AS high, count_if(l_extendedprice < low OR l_extendedprice > high)::BIGINT AS n_out FROM f JOIN lineitem l ON l.l_returnflag = f.l_returnflag GROUP BY ALL""")
def iqr_fences(spark, sf_dir):
    f = impute.iqr_fences(read(spark, sf_dir, "lineitem").select("l_returnflag", "l_extendedprice"), ["l_returnflag"], "l_extendedprice")
    return f.select("l_returnflag", *[F.round(c, 4).alias(c) for c in ("q1", "q3", "low", "high")], "n_out")


@query("SELECT floor(l_extendedprice / 5000)::BIGINT AS bucket, count(*)::BIGINT AS n FROM lineitem GROUP BY 1")
def histogram_buckets(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").groupBy(F.floor(F.col("l_extendedprice") / 5000).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 2) AS intercept FROM lineitem GROUP BY 1")
def linear_fit(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.round(F.regr_slope("l_extendedprice", "l_quantity"), 4).alias("slope"), F.round(F.regr_intercept("l_extendedprice", "l_quantity"), 2).alias("intercept"))


#: Weights of the signals, here by event type.
SIGNALS = [("signup", 0.35), ("purchase", 0.30), ("view", 0.20), ("click", 0.10), ("error", 0.05)]
_SIGNALS = ", ".join(f"('{a}', {b})" for a, b in SIGNALS)


@query(f"""WITH c AS (SELECT user_id, event_type, count(*) AS nb, coalesce(avg(CASE WHEN value > 0 THEN value END), 0) AS note FROM events GROUP BY 1, 2), m AS (SELECT event_type, max(nb) AS mx, max(note) AS mn FROM c GROUP BY 1)
SELECT user_id, round(sum(w * nb / mx * coalesce(note / nullif(mn, 0), 0) * 100), 2) AS score FROM c JOIN m USING (event_type) JOIN (VALUES {_SIGNALS}) s(event_type, w) USING (event_type) GROUP BY 1""")
def weighted_signal_score(spark, sf_dir):
    c = read(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("nb"), F.coalesce(F.avg(F.when(F.col("value") > 0, F.col("value"))), F.lit(0)).alias("note"))
    m = c.groupBy("event_type").agg(F.max("nb").alias("mx"), F.max("note").alias("mn"))
    w = spark.createDataFrame(SIGNALS, "event_type string, w double")
    c = c.join(lookup.dimension(m), "event_type").join(lookup.dimension(w), "event_type")
    part = F.col("w") * F.col("nb") / F.col("mx") * F.coalesce(F.try_divide("note", "mn"), F.lit(0)) * 100
    return c.groupBy("user_id").agg(F.round(F.sum(part), 2).alias("score"))


@query("""WITH c AS (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1), s AS (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1),
u AS (SELECT n_nationkey AS k, coalesce(c.n, 0) AS a, coalesce(s.n, 0) AS b FROM nation LEFT JOIN c ON c.k = n_nationkey LEFT JOIN s ON s.k = n_nationkey)
SELECT k, a::BIGINT AS customers, b::BIGINT AS suppliers, round(((a + b) / 2.0) / max((a + b) / 2.0) OVER () * 100, 1)::DOUBLE AS score FROM u""")
def composite_city_score(spark, sf_dir):
    c = read(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("customers"))
    s = read(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("suppliers"))
    u = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k")).join(c, "k", "left").join(s, "k", "left").fillna(0)
    mean = (F.col("customers") + F.col("suppliers")) / 2.0
    return u.withColumn("score", F.round(mean / F.max(mean).over(Window.partitionBy(F.lit(0))) * 100, 1))


@query("SELECT o_orderpriority, count_if(o_orderstatus = 'O')::BIGINT AS o, count_if(o_orderstatus = 'F')::BIGINT AS f, count_if(o_orderstatus = 'P')::BIGINT AS p FROM orders GROUP BY 1")
def pivot_status(spark, sf_dir):
    p = read(spark, sf_dir, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["O", "F", "P"]).count().fillna(0)
    return p.select("o_orderpriority", F.col("O").alias("o"), F.col("F").alias("f"), F.col("P").alias("p"))


@query("""WITH a AS (SELECT l_returnflag, round(avg(l_quantity), 4) AS quantity, round(avg(l_discount), 6) AS discount FROM lineitem GROUP BY 1)
SELECT l_returnflag, 'quantity' AS series, quantity AS value FROM a UNION ALL SELECT l_returnflag, 'discount', discount FROM a""")
def unpivot_measures(spark, sf_dir):
    a = read(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.round(F.avg("l_quantity"), 4).alias("quantity"), F.round(F.avg("l_discount"), 6).alias("discount"))
    return a.unpivot("l_returnflag", ["quantity", "discount"], "series", "value").filter("value IS NOT NULL")


@query("""WITH n AS (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY 1, 2)
SELECT c_nationkey, c_mktsegment, n::BIGINT AS n, (c_nationkey * 1000 + CASE WHEN n >= 5 THEN row_number() OVER (PARTITION BY c_nationkey ORDER BY n DESC, c_mktsegment) ELSE 0 END)::BIGINT AS code FROM n""")
def hierarchical_code(spark, sf_dir):
    return scoring.hierarchical_code(read(spark, sf_dir, "customer"), "c_nationkey", "c_mktsegment", 5)


@query("""WITH q AS (SELECT o_orderpriority, (year(o_orderdate) * 10 + quarter(o_orderdate))::INT AS period, avg(o_totalprice) AS x FROM orders GROUP BY 1, 2)
SELECT o_orderpriority, period, round(coalesce(x / lag(x) OVER (PARTITION BY o_orderpriority ORDER BY period) - 1, 0), 4) AS change FROM q""")
def pct_change(spark, sf_dir):
    q = read(spark, sf_dir, "orders").groupBy("o_orderpriority", (F.year("o_orderdate") * 10 + F.quarter("o_orderdate")).alias("period")).agg(F.avg("o_totalprice").alias("x"))
    before = F.lag("x").over(Window.partitionBy("o_orderpriority").orderBy("period"))
    return q.select("o_orderpriority", "period", F.round(F.coalesce(F.try_divide(F.col("x"), before) - 1, F.lit(0.0)), 4).alias("change"))


@query("SELECT c_custkey, round(c_acctbal - m, 4) AS above FROM customer JOIN (SELECT c_nationkey, median(c_acctbal) AS m FROM customer GROUP BY 1) USING (c_nationkey)")
def group_median_broadcast(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    return c.join(lookup.dimension(impute.group_medians(c, ["c_nationkey"], "c_acctbal", "m")), "c_nationkey").select("c_custkey", F.round(F.col("c_acctbal") - F.col("m"), 4).alias("above"))


@query("""WITH r AS (SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) AS r, count(*) OVER (PARTITION BY p_brand) AS n FROM part)
SELECT p_partkey, (CASE WHEN r = 1 THEN 0 ELSE ceil((r - 1) * 10 / (n - 1)) - 1 END)::INT AS decile FROM r""")
def decile_in_partition(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", scoring.decile("p_retailprice", "p_partkey", ["p_brand"]).alias("decile"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice DESC, o_orderkey LIMIT 200")
def topk_filtered(spark, sf_dir):
    return read(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(200).select("o_orderkey", "o_totalprice")


_RATES = [(0, 4.5), (3, 6.25), (7, 8.0), (12, 5.5)]


@query("SELECT n_nationkey, n_name, coalesce(rate, 6.0)::DOUBLE AS rate FROM nation LEFT JOIN (VALUES " + ", ".join(map(str, _RATES)) + ") d(k, rate) ON n_nationkey = k")
def lookup_default(spark, sf_dir):
    d = spark.createDataFrame(_RATES, "n_nationkey int, rate double")
    return lookup.with_default(read(spark, sf_dir, "nation"), d, "n_nationkey", {"rate": 6.0}).select("n_nationkey", "n_name", "rate")


_SPARSE = [(1995, 2, 7.0), (1996, 4, 6.5), (1998, 1, 6.0), (2000, 3, 5.5)]


@query("WITH o AS (SELECT o_orderkey, year(o_orderdate) AS y, quarter(o_orderdate) AS q FROM orders), r AS (SELECT o_orderkey, rate, row_number() OVER (PARTITION BY o_orderkey ORDER BY abs(4 * (y - dy) + q - dq), dy, dq) AS n FROM o, (VALUES " + ", ".join(map(str, _SPARSE)) + ") d(dy, dq, rate)) SELECT o_orderkey, rate::DOUBLE AS rate FROM r WHERE n = 1")
def nearest_period_lookup(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select("o_orderkey", F.year("o_orderdate").alias("y"), F.quarter("o_orderdate").alias("q"))
    d = spark.createDataFrame(_SPARSE, "dy int, dq int, rate double")
    away = F.abs(4 * (F.col("y") - F.col("dy")) + F.col("q") - F.col("dq"))
    at, dim_at = ((4 * F.col(y) + F.col(q), F.lit(0.0)) for y, q in (("y", "q"), ("dy", "dq")))
    return lookup.nearest(o, d, ["y", "q"], at, dim_at, away, ["dy", "dq"], ["rate"]).select("o_orderkey", "rate")


@query("""WITH c AS (SELECT c_custkey, 30 + (c_custkey * 37 % 1000) / 100.0 AS lat, 5 + (c_custkey * 91 % 1000) / 100.0 AS lon FROM customer), n AS (SELECT n_nationkey, 30 + (n_nationkey * 7 % 25) / 2.5 AS nlat, 5 + (n_nationkey * 11 % 25) / 2.5 AS nlon FROM nation),
d AS (SELECT c_custkey, n_nationkey, sqrt(((lat - nlat) * 111.0) ** 2 + ((lon - nlon) * 111.0 * cos(radians(34))) ** 2) AS km FROM c, n)
SELECT c_custkey, n_nationkey, round(km, 3)::DOUBLE AS km FROM (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY round(km, 6), n_nationkey) AS r FROM d) WHERE r = 1""")
def nearest_centroid(spark, sf_dir):
    c = read(spark, sf_dir, "customer").select("c_custkey", (30 + (F.col("c_custkey") * 37 % 1000) / 100.0).alias("lat"), (5 + (F.col("c_custkey") * 91 % 1000) / 100.0).alias("lon"))
    n = read(spark, sf_dir, "nation").select("n_nationkey", (30 + (F.col("n_nationkey") * 7 % 25) / 2.5).alias("nlat"), (5 + (F.col("n_nationkey") * 11 % 25) / 2.5).alias("nlon"))
    km = lookup.planar_km(F.col("lat"), F.col("lon"), F.col("nlat"), F.col("nlon"))
    at, dim_at = lookup.plane(F.col("lat"), F.col("lon")), lookup.plane(F.col("nlat"), F.col("nlon"))
    out = lookup.nearest(c, n, ["lat", "lon"], at, dim_at, F.round(km, 6), ["n_nationkey"], ["n_nationkey", "nlat", "nlon"])
    return out.select("c_custkey", "n_nationkey", F.round(km, 3).alias("km"))


_KEYS = [(1, "blue", "cold"), (2, "red", "warm"), (3, "green", "mild"), (4, "lue", "odd"), (5, "widget", "part"), (6, "a", "any")]


@query("WITH h AS (SELECT p_partkey, cat, row_number() OVER (PARTITION BY p_partkey ORDER BY (p_name <> k)::INT, o) AS r FROM part LEFT JOIN (VALUES " + ", ".join(map(str, _KEYS)) + ") d(o, k, cat) ON starts_with(p_name, k) OR starts_with(k, p_name) OR contains(p_name, k)) SELECT p_partkey, coalesce(cat, 'Unknown') AS cat FROM h WHERE r = 1")
def fuzzy_ordered_lookup(spark, sf_dir):
    d = spark.createDataFrame(_KEYS, "o int, k string, cat string")
    return lookup.first_contained(read(spark, sf_dir, "part"), "p_name", d, "k", "o", "cat").select("p_partkey", F.coalesce("cat", F.lit("Unknown")).alias("cat"))


@query("""WITH g AS (SELECT c_nationkey AS k, avg(c_acctbal) AS a, count(*)::DOUBLE AS x FROM customer GROUP BY 1), p AS (SELECT g.k, o.x AS v, greatest(abs(g.a - o.a), 1e-6) AS d, row_number() OVER (PARTITION BY g.k ORDER BY greatest(abs(g.a - o.a), 1e-6), o.k) AS r FROM g JOIN g o ON g.k <> o.k)
SELECT k, round(sum(v / d) / sum(1 / d), 4) AS estimate FROM p WHERE r <= 3 GROUP BY 1""")
def knn_idw(spark, sf_dir):
    g = read(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.avg("c_acctbal").alias("a"), F.count(F.lit(1)).cast("double").alias("x"))
    return lookup.neighbours_mean(g, "k", "a", "x").select("k", F.round("estimate", 4).alias("estimate"))


@query(f"""WITH {LISTINGS}, m AS (SELECT nation, median(CASE WHEN l_returnflag = 'R' THEN unit_price END) AS rent, median(CASE WHEN l_returnflag <> 'R' THEN unit_price END) AS sale FROM listings GROUP BY 1)
SELECT nation, round(greatest(least(coalesce(rent, sale * 0.005) / nullif(sale, 0) * 12, 20), 2), 4) AS yield FROM m""")
def outer_align_ratio(spark, sf_dir):
    rent = F.col("l_returnflag") == "R"
    m = impute.group_summary(written(listings(spark, sf_dir).select("nation", "l_returnflag", "unit_price")), ["nation"], {"rent": F.when(rent, F.col("unit_price")), "sale": F.when(~rent, F.col("unit_price"))})
    y = F.try_divide(F.coalesce("rent", F.col("sale") * 0.005), F.col("sale")) * 12
    return m.select("nation", F.round(scoring.clip(y, 2, 20), 4).alias("yield"))


@query("SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AS has_orders FROM customer")
def semi_anti(spark, sf_dir):
    c, o = read(spark, sf_dir, "customer").select("c_custkey"), read(spark, sf_dir, "orders")
    on = F.col("c_custkey") == F.col("o_custkey")
    return c.join(o, on, "left_semi").withColumn("has_orders", F.lit(True)).unionByName(c.join(o, on, "left_anti").withColumn("has_orders", F.lit(False)))
