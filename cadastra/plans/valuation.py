"""Queries of imputation, outlier, encoding, weighting, scoring, sampling and simulation operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cadastra.functions import fixed
from cadastra.operators import forest, impute, lookup, scoring
from cadastra.plans.tables import LISTINGS, listings, read

QUERIES: dict = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


def every():
    """A window over all rows of a small aggregate."""
    return Window.partitionBy(F.lit(0))


@query("""WITH b AS (SELECT l_orderkey, l_linenumber, l_returnflag, least(floor(l_quantity / 10), 4)::INT AS bucket, CASE WHEN l_linenumber = 3 THEN NULL ELSE l_extendedprice END AS x FROM lineitem),
a AS (SELECT l_returnflag, bucket, median(x) AS m1 FROM b GROUP BY 1, 2), c AS (SELECT bucket, median(x) AS m2 FROM b GROUP BY 1)
SELECT l_orderkey, l_linenumber, round(coalesce(x, m1, m2), 3) AS filled FROM b LEFT JOIN a USING (l_returnflag, bucket) LEFT JOIN c USING (bucket)""")
def conditional_median_impute(spark, sf_dir):
    df = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", F.least(F.floor(F.col("l_quantity") / 10), F.lit(4)).cast("int").alias("bucket"), F.when(F.col("l_linenumber") != 3, F.col("l_extendedprice")).alias("x"))
    return impute.hierarchical(df, "x", [["l_returnflag", "bucket"], ["bucket"]], "filled").select("l_orderkey", "l_linenumber", F.round("filled", 3).alias("filled"))


_U = "(('0x' || substring(md5(concat_ws('-', {})), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


@query(f"""WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS x FROM orders), d AS (SELECT x AS donor, row_number() OVER (ORDER BY substring(md5(o_orderkey::VARCHAR), 1, 3), o_orderkey) - 1 AS slot FROM o WHERE x IS NOT NULL)
SELECT o_orderkey, coalesce(x, donor) AS filled FROM (SELECT *, floor({_U.format("o_orderkey, 'deck'")} * (SELECT count(*) FROM d))::BIGINT AS slot FROM o) LEFT JOIN d USING (slot)""")
def tiered_impute(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice")).alias("x"))
    return impute.hot_deck(o, "o_orderkey", "x", "deck", "filled").select("o_orderkey", "filled")


@query("""WITH c AS (SELECT c_custkey, c_nationkey, CASE WHEN c_custkey % 3 = 0 OR c_nationkey = 4 THEN NULL ELSE c_acctbal END AS x FROM customer)
SELECT c_custkey, round(coalesce(x, m, (SELECT median(x) FROM c)), 4) AS filled FROM c LEFT JOIN (SELECT c_nationkey, median(x) AS m FROM c GROUP BY 1) USING (c_nationkey)""")
def hierarchical_fill(spark, sf_dir):
    c = read(spark, sf_dir, "customer").withColumn("x", F.when((F.col("c_custkey") % 3 != 0) & (F.col("c_nationkey") != 4), F.col("c_acctbal")))
    return impute.hierarchical(c, "x", [["c_nationkey"], []], "filled").select("c_custkey", F.round("filled", 4).alias("filled"))


@query("WITH g AS (SELECT c_nationkey, avg(c_acctbal) AS x FROM customer GROUP BY 1) SELECT c_nationkey, round((x - min(x) OVER ()) / (max(x) OVER () - min(x) OVER ()), 6) AS scaled FROM g")
def minmax_norm(spark, sf_dir):
    g = read(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.avg("c_acctbal").alias("x"))
    return scoring.minmax(g, "x", "s").select("c_nationkey", F.round("s", 6).alias("scaled"))


_PROFILES = ", ".join(str(p) for p in fixed.PRESSURE)
_TYPES = ["Appartement", "Maison", "Villa", "Terrain", "Ferme", "Bureau", "Chambre"]


@query(f"""WITH o AS (SELECT o_orderkey, 1 + (o_orderstatus = 'O')::INT AS tx, list_extract({_TYPES}, (o_orderkey % 7)::INT + 1) AS kind, date_diff('day', o_orderdate, TIMESTAMP '2001-08-01') AS days FROM orders)
SELECT o_orderkey, round(greatest(least(0.05::DOUBLE + least(coalesce(slope, 0.03)::DOUBLE * ln(1 + CASE WHEN days = 0 THEN 30 ELSE days END / coalesce(half, 45)::DOUBLE), coalesce(cap, 0.08)::DOUBLE), 0.2), 0.03), 6)::DOUBLE AS rate FROM o LEFT JOIN (VALUES {_PROFILES}) p(tx, kind, slope, half, cap) USING (tx, kind)""")
def log_pressure_rate(spark, sf_dir):
    kinds = F.array(*[F.lit(k) for k in _TYPES])
    o = read(spark, sf_dir, "orders").select("o_orderkey", (1 + (F.col("o_orderstatus") == "O").cast("int")).alias("tx"), F.get(kinds, (F.col("o_orderkey") % 7).cast("int")).alias("kind"), F.datediff(F.lit("2001-08-01").cast("date"), "o_orderdate").alias("days"))
    p = spark.createDataFrame(fixed.PRESSURE, "tx int, kind string, slope double, half double, cap double")
    o = o.join(lookup.dimension(p), ["tx", "kind"], "left").fillna(dict(zip(("slope", "half", "cap"), fixed.PRESSURE_DEFAULT, strict=True)))
    return o.select("o_orderkey", F.round(scoring.pressure(F.lit(0.05), F.col("days"), F.col("half"), F.col("slope"), F.col("cap")), 6).alias("rate"))


@query("""WITH q AS (SELECT (year(o_orderdate) * 10 + quarter(o_orderdate))::INT AS period, avg(o_totalprice) AS x, avg(o_custkey % 10) AS infl, avg(o_orderkey % 9) AS rate FROM orders GROUP BY 1),
g AS (SELECT period, round(coalesce(x / lag(x) OVER (ORDER BY period) - 1, 0) * 100, 4) AS growth, round(infl, 4) AS infl, round(rate, 4) AS rate FROM q)
SELECT period, CASE WHEN growth >= 2 AND infl < 6 AND rate < 7.5 THEN 'peak' WHEN growth >= 0.5 AND infl < 7 THEN 'growth' WHEN growth >= -1 AND growth < 0 THEN 'recovery' WHEN growth < -1 OR (rate >= 8 AND infl > 8) THEN 'decline' ELSE 'stabilization' END AS phase,
CASE WHEN growth > 10 THEN 0.03 WHEN growth > 5 THEN 0.05 WHEN growth > 2 THEN 0.07 ELSE 0.09 END::DOUBLE AS discount FROM g""")
def market_cycle_rules(spark, sf_dir):
    q = read(spark, sf_dir, "orders").groupBy((F.year("o_orderdate") * 10 + F.quarter("o_orderdate")).alias("period"))
    q = q.agg(F.avg("o_totalprice").alias("x"), F.round(F.avg(F.col("o_custkey") % 10), 4).alias("infl"), F.round(F.avg(F.col("o_orderkey") % 9), 4).alias("rate"))
    # a row a quarter, so one task orders them
    q = q.withColumn("growth", F.round(F.coalesce(F.col("x") / F.lag("x").over(Window.orderBy("period")) - 1, F.lit(0.0)) * 100, 4))
    step = F.coalesce(*[F.when(F.col("growth") > above, F.lit(base)) for above, base in fixed.DISCOUNT_STEPS], F.lit(fixed.DISCOUNT_LEAST_GROWTH))
    return q.select("period", scoring.market_cycle(F.col("growth"), F.col("infl"), F.col("rate")).alias("phase"), step.alias("discount"))


@query("""WITH g AS (SELECT c_nationkey AS k, median(c_acctbal) AS price, count(*) AS n, avg(c_custkey % 5) AS note FROM customer GROUP BY 1),
s AS (SELECT k, greatest(least(12 * 0.005 * abs(price) / nullif(min(abs(price)) OVER (), 0), 20), 2) AS yield, (price - min(price) OVER ()) / (max(price) OVER () - min(price) OVER ()) AS macro, (note - min(note) OVER ()) / (max(note) OVER () - min(note) OVER ()) AS a, (ln(1 + n) - min(ln(1 + n)) OVER ()) / (max(ln(1 + n)) OVER () - min(ln(1 + n)) OVER ()) AS b FROM g)
SELECT k, round(greatest(least(100 * (0.45 * yield / 20 + 0.30 * macro + 0.25 * (0.6 * a + 0.4 * b)), 100), 0), 2)::DOUBLE AS profitability FROM s""")
def profitability_index(spark, sf_dir):
    g = read(spark, sf_dir, "customer").withColumnRenamed("c_nationkey", "k")
    g = impute.group_summary(g, ["k"], {"price": F.col("c_acctbal")}, F.log1p(F.count(F.lit(1))).alias("n"), F.avg(F.col("c_custkey") % 5).alias("note"))
    for c, out in (("price", "macro"), ("note", "a"), ("n", "b")):
        g = scoring.minmax(g, c, out)
    y = scoring.clip(F.try_divide(12 * 0.005 * F.abs("price"), F.min(F.abs("price")).over(every())), 2, 20)
    index = 100 * (0.45 * y / 20 + 0.30 * F.col("macro") + 0.25 * (0.6 * F.col("a") + 0.4 * F.col("b")))
    return g.select("k", F.round(scoring.clip(index, 0, 100), 2).alias("profitability"))


@query("""WITH n AS (SELECT year(o_orderdate)::INT AS y, count(*) AS n FROM orders GROUP BY 1), w AS (SELECT y, n, least(sum(n) OVER () / (count(*) OVER () * n), 5)::DOUBLE AS w FROM n)
SELECT y, n::BIGINT AS n, round(w / avg(w) OVER (), 6) AS weight FROM w""")
def inverse_freq_weights(spark, sf_dir):
    o = read(spark, sf_dir, "orders").withColumn("y", F.year("o_orderdate"))
    return scoring.inverse_frequency(o, "y", 5.0).select("y", "n", F.round("weight", 6).alias("weight"))


@query("""WITH n AS (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1), w AS (SELECT c_nationkey, n, greatest(least((SELECT avg(n) FROM n) / n, 6), 0.1)::DOUBLE AS w FROM n), m AS (SELECT sum(w * n) / sum(n) AS mean FROM w)
SELECT c_custkey, round(w / mean, 6) AS weight FROM customer JOIN w USING (c_nationkey), m""")
def adaptive_geo_weights(spark, sf_dir):
    c = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    n = c.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"))
    w = n.withColumn("w", scoring.clip(F.avg("n").over(every()) / F.col("n"), 0.1, 6.0))
    w = w.withColumn("w", F.col("w") / (F.sum(F.col("w") * F.col("n")).over(every()) / F.sum("n").over(every())))
    return c.join(lookup.dimension(w), "c_nationkey").select("c_custkey", F.round("w", 6).alias("weight"))


@query("""WITH c AS (SELECT c_nationkey, n_regionkey, c_acctbal FROM customer JOIN nation ON c_nationkey = n_nationkey), r AS (SELECT n_regionkey, median(c_acctbal) AS wide FROM c GROUP BY 1), g AS (SELECT c_nationkey, n_regionkey, median(c_acctbal) AS own, count(*) AS n FROM c GROUP BY 1, 2)
SELECT c_nationkey, round(CASE WHEN n >= 100 THEN own WHEN n >= 30 THEN 0.7 * own + 0.3 * wide ELSE 0.3 * own + 0.7 * wide END, 3) AS shrunk FROM g JOIN r USING (n_regionkey)""")
def shrunk_median(spark, sf_dir):
    c = read(spark, sf_dir, "customer").join(read(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    wide = impute.group_medians(c, ["n_regionkey"], "c_acctbal", "wide")
    g = impute.group_summary(c, ["c_nationkey", "n_regionkey"], {"own": F.col("c_acctbal")}, F.count(F.lit(1)).alias("n")).join(lookup.dimension(wide), "n_regionkey")
    return g.select("c_nationkey", F.round(scoring.shrunk(F.col("own"), F.col("n"), F.col("wide")), 3).alias("shrunk"))


@query("""WITH s AS (SELECT avg(l_extendedprice) AS mp, stddev_pop(l_extendedprice) AS sp, avg(l_quantity) AS mq, stddev_pop(l_quantity) AS sq FROM lineitem), z AS (SELECT l_orderkey, l_linenumber, sqrt(((l_extendedprice - mp) / sp) ** 2 + ((l_quantity - mq) / sq) ** 2) AS z FROM lineitem, s)
SELECT l_orderkey, l_linenumber, round(z, 4) AS z FROM z WHERE z <= (SELECT quantile_cont(z, 0.96) FROM z)""")
def zscore_distance_trim(spark, sf_dir):
    df = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity")
    return impute.distance_trim(df, ["l_extendedprice", "l_quantity"], 0.04).select("l_orderkey", "l_linenumber", F.round("z", 4).alias("z"))


def _balance(target):
    return f"""WITH t AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY md5(concat_ws('-', doc_id, 'balance')), doc_id) AS r, count(*) OVER (PARTITION BY quality) AS n FROM labels)
SELECT doc_id, quality, unnest(range(0, (({target} - r) // n)::BIGINT + 1)) AS copy FROM t WHERE r <= {target}"""


@query(_balance(20))
def balance_down(spark, sf_dir):
    return scoring.balanced(read(spark, sf_dir, "labels"), "quality", "doc_id", 20, "balance").select("doc_id", "quality", "copy")


@query(_balance(1000))
def balance_up(spark, sf_dir):
    return scoring.balanced(read(spark, sf_dir, "labels"), "quality", "doc_id", 1000, "balance").select("doc_id", "quality", "copy")


_RETURN = "WITH g AS (SELECT c_nationkey AS k, 0.02 + avg(c_acctbal) / 1000000 AS m, 0.02 + count(*) / 1000000.0::DOUBLE AS s FROM customer GROUP BY 1)"


def _returns(spark, sf_dir):
    g = read(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.avg("c_acctbal").alias("a"), F.count(F.lit(1)).alias("n"))
    return g, 0.02 + F.col("a") / 1000000, 0.02 + F.col("n") / 1000000.0


@query(_RETURN + f""", d AS (SELECT k, m + s * sqrt(-2 * ln(greatest({_U.format("k, i, 'a'")}, 1e-12))) * cos(2 * pi() * {_U.format("k, i, 'b'")}) AS x FROM g, (SELECT unnest(range(1, 1001)) AS i)),
t AS (SELECT k, avg(x) AS mean, stddev_samp(x) AS sd, quantile_cont(x, 0.05) AS v, avg((x > 0)::INT) AS p FROM d GROUP BY 1)
SELECT t.k, round(mean, 5) AS mean, round(v, 5) AS var_95, round((SELECT avg(x) FROM d WHERE d.k = t.k AND x < v), 5) AS cvar, round(mean / sd, 4) AS sharpe, round(p, 4)::DOUBLE AS prob_gain FROM t""")
def monte_carlo_return(spark, sf_dir):
    r = scoring.monte_carlo(*_order(*_returns(spark, sf_dir)))
    return r.select("k", *[F.round(c, d).alias(c) for c, d in (("mean", 5), ("var_95", 5), ("cvar", 5), ("sharpe", 4), ("prob_gain", 4))])


def _order(g, mean, spread):
    return g, "k", mean, spread, 1000


@query(_RETURN + " SELECT k, round(m, 6) AS mean, round(m - 1.6448536269514722 * s, 6) AS var_95, round(m - 2.0627128075074257 * s, 6) AS cvar, round(m / s, 4) AS sharpe FROM g")
def monte_carlo_closed_form(spark, sf_dir):
    g, m, s = _returns(spark, sf_dir)
    return g.select("k", F.round(m, 6).alias("mean"), F.round(m - 1.6448536269514722 * s, 6).alias("var_95"), F.round(m - 2.0627128075074257 * s, 6).alias("cvar"), F.round(m / s, 4).alias("sharpe"))


_QUARTERS = [("2022-01-01", 0.0, 0.2), ("2023-01-01", 0.2, 0.45), ("2024-01-01", 0.45, 0.75), ("2025-01-01", 0.75, 1.0)]


@query(f"SELECT o_orderkey, coalesce(own, day) AS imputed FROM (SELECT o_orderkey, {_U.format('o_orderkey, 1')} AS u, CASE WHEN o_orderkey % 5 > 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS own FROM orders) JOIN (VALUES " + ", ".join(map(str, _QUARTERS)) + ") q(day, lo, hi) ON u >= lo AND u < hi")
def weighted_date_impute(spark, sf_dir):
    own = F.when(F.col("o_orderkey") % 5 > 0, F.date_format("o_orderdate", "yyyy-MM-dd"))
    o = read(spark, sf_dir, "orders").select("o_orderkey", own.alias("own"), impute.uniform(F.col("o_orderkey"), F.lit(1)).alias("u"))
    day = F.lit(None).cast("string")
    for name, low, high in _QUARTERS:
        day = F.when((F.col("u") >= low) & (F.col("u") < high), name).otherwise(day)
    return o.select("o_orderkey", F.coalesce("own", day).alias("imputed"))


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 4) AS norm FROM embeddings")
def embedding_norm(spark, sf_dir):
    square = F.aggregate("embedding", F.lit(0.0).cast("double"), lambda a, x: a + x.cast("double") * x.cast("double"))
    return read(spark, sf_dir, "embeddings").select("vec_id", F.round(F.sqrt(square), 4).alias("norm"))


@query(f"""WITH {LISTINGS}, d AS (SELECT nation, l_returnflag, date_diff('day', published, TIMESTAMP '2001-08-01') AS days, unit_price FROM listings)
SELECT nation, count(*)::BIGINT AS n, round(avg((l_returnflag = 'R')::INT), 6)::DOUBLE AS rent_share, round(count(*) / max(count(*)) OVER (), 6)::DOUBLE AS liquidity, round(least(greatest(0.40 * avg((l_returnflag = 'R')::INT) + 0.35 * count(*) / max(count(*)) OVER () + 0.25 * least(avg(days) / 3000, 1), 0), 1), 4)::DOUBLE AS tension FROM d GROUP BY 1""")
def market_tension(spark, sf_dir):
    d = listings(spark, sf_dir).withColumn("days", F.datediff(F.lit("2001-08-01").cast("date"), "published"))
    g = d.groupBy("nation").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("l_returnflag") == "R").cast("int")).alias("rent"), F.avg("days").alias("days"))
    liquid = F.col("n") / F.max("n").over(every())
    tension = scoring.clip(0.40 * F.col("rent") + 0.35 * liquid + 0.25 * F.least(F.col("days") / 3000, F.lit(1.0)), 0.0, 1.0)
    return g.select("nation", "n", F.round("rent", 6).alias("rent_share"), F.round(liquid, 6).alias("liquidity"), F.round(tension, 4).alias("tension"))


@query(None)
def isolation_forest(spark, sf_dir):
    df = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_extendedprice", "l_quantity")
    return forest.inliers(df, ["l_returnflag"], ["l_extendedprice", "l_quantity"], ["l_orderkey", "l_linenumber"], 0.04)


@query(None)
def tfidf_svd(spark, sf_dir):
    return forest.text_vectors(read(spark, sf_dir, "documents").select("doc_id", "text"), 32)
