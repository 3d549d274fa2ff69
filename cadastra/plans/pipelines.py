"""The four analytic pipelines end to end on the driver's tables: valuation, trends, conformity, profitability."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadastra.functions import text
from cadastra.operators import dedup, impute, lookup, scoring
from cadastra.plans.tables import LISTINGS, listings, read
from cadastra.sources.folders import written

QUERIES: dict = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


def every():
    """A window over all rows of a small aggregate."""
    return Window.partitionBy(F.lit(0))


def valuation(df: DataFrame, region: str, deal_is_rent, price: str, surface: str, low: float, high: float) -> DataFrame:
    """Listings with a believable unit price, missing surfaces filled, regional median, weight and estimate."""
    df = written(df.withColumn("rent", deal_is_rent).filter(F.col(price).isNotNull()))  # read by each median
    df = impute.hierarchical(df, surface, [[region, "rent"], []], "surface_filled")
    df = df.withColumn("unit", F.try_divide(F.col(price), F.col("surface_filled"))).filter(F.coalesce(F.col("unit").between(low, high), F.lit(False)))
    medians = impute.group_summary(df, [region, "rent"], {"own": F.col("unit")}, F.count(F.lit(1)).alias("n"))
    whole = impute.group_medians(df, ["rent"], "unit", "wide")
    medians = written(medians.join(lookup.dimension(written(whole)), "rent").withColumn("regional", scoring.shrunk(F.col("own"), F.col("n"), F.col("wide"))))
    weights = written(scoring.inverse_frequency(df, region, 6.0).select(region, "weight"))
    out = df.join(lookup.dimension(medians.select(region, "rent", "regional")), [region, "rent"]).join(lookup.dimension(weights), region)
    return out.withColumn("estimate", F.col("regional") * F.col("surface_filled"))


@query(f"""WITH {LISTINGS}, l AS (SELECT *, l_returnflag = 'R' AS rent, CASE WHEN l_linenumber = 5 THEN NULL ELSE surface END AS s0 FROM listings WHERE price IS NOT NULL),
m AS (SELECT nation, rent, median(s0) AS ms FROM l GROUP BY 1, 2), f AS (SELECT l.*, coalesce(s0, ms, (SELECT median(s0) FROM l)) AS s FROM l LEFT JOIN m ON m.nation = l.nation AND m.rent = l.rent),
u AS (SELECT *, price / nullif(s, 0) AS unit FROM f WHERE coalesce(price / nullif(s, 0) BETWEEN 500 AND 2000, false)),
g AS (SELECT nation, rent, median(unit) AS own, count(*) AS n FROM u GROUP BY 1, 2), w AS (SELECT rent, median(unit) AS wide FROM u GROUP BY 1),
r AS (SELECT nation, g.rent, CASE WHEN n >= 100 THEN own WHEN n >= 30 THEN 0.7 * own + 0.3 * wide ELSE 0.3 * own + 0.7 * wide END AS regional FROM g JOIN w ON g.rent = w.rent),
c AS (SELECT nation, count(*) AS n FROM u GROUP BY 1), k AS (SELECT nation, least(sum(n) OVER () / (count(*) OVER () * n), 6)::DOUBLE AS x FROM c), z AS (SELECT nation, x / avg(x) OVER () AS weight FROM k)
SELECT l_orderkey, l_linenumber, u.nation, round(s, 3) AS surface, round(regional, 3) AS regional, round(regional * s, 2) AS estimate, round(weight, 5) AS weight FROM u JOIN r ON r.nation = u.nation AND r.rent = u.rent JOIN z ON z.nation = u.nation""")
def valuation_pipeline(spark, sf_dir):
    df = listings(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_returnflag", "nation", "price", F.when(F.col("l_linenumber") != 5, F.col("surface")).alias("surface"))
    out = valuation(df, "nation", F.col("l_returnflag") == "R", "price", "surface", 500, 2000)
    return out.select("l_orderkey", "l_linenumber", "nation", F.round("surface_filled", 3).alias("surface"), F.round("regional", 3).alias("regional"), F.round("estimate", 2).alias("estimate"), F.round("weight", 5).alias("weight"))


@query(f"""WITH {LISTINGS}, p AS (SELECT nation, year(published)::INT AS y, month(published)::INT AS m, avg(CASE WHEN unit_price BETWEEN 800 AND 1500 THEN unit_price END) AS idx, count(*) AS n FROM listings WHERE year(published) >= 1997 GROUP BY 1, 2, 3),
f AS (SELECT p.*, coalesce(idx, g.med, (SELECT median(idx) FROM p)) AS filled FROM p LEFT JOIN (SELECT nation, median(idx) AS med FROM p GROUP BY 1) g USING (nation)),
c AS (SELECT nation, count(*) AS points FROM p GROUP BY 1), w AS (SELECT y, count(*) AS n FROM f GROUP BY 1), k AS (SELECT y, least(sum(n) OVER () / (count(*) OVER () * n), 5)::DOUBLE AS x FROM w), z AS (SELECT y, x / avg(x) OVER () AS weight FROM k)
SELECT nation, y, m, round(filled, 3) AS price_index, points >= (SELECT median(points) FROM c) AS eligible, round(weight, 5) AS weight, (m BETWEEN 6 AND 8)::INT AS high_season FROM f JOIN c USING (nation) JOIN z USING (y)""")
def trend_pipeline(spark, sf_dir):
    df = listings(spark, sf_dir).filter(F.year("published") >= 1997)
    price = F.when(F.col("unit_price").between(800, 1500), F.col("unit_price"))
    p = written(df.groupBy("nation", F.year("published").alias("y"), F.month("published").alias("m")).agg(F.avg(price).alias("idx")))
    f = impute.hierarchical(p, "idx", [["nation"], []], "filled")
    c = p.groupBy("nation").agg(F.count(F.lit(1)).alias("points"))
    c = c.withColumn("eligible", F.col("points") >= F.median("points").over(every()))
    z = scoring.inverse_frequency(f, "y", 5.0).select("y", "weight")
    out = f.join(lookup.dimension(c), "nation").join(lookup.dimension(z), "y")
    return out.select("nation", "y", "m", F.round("filled", 3).alias("price_index"), "eligible", F.round("weight", 5).alias("weight"), F.col("m").between(6, 8).cast("int").alias("high_season"))


CONTRACT = {"parties": ["the ", "les ", "los "], "term": ["tion", "ción"], "price": ["1", "5"], "transfer": ["und ", "et "], "notice": ["@", "+1"]}
_P = {k: "(" + " OR ".join(f"contains(t, '{w}')" for w in ws) + ")" for k, ws in CONTRACT.items()}


@query(f"""WITH d AS (SELECT doc_id, lower(text) AS t, n_chars, row_number() OVER (PARTITION BY lower(trim(text)) ORDER BY doc_id) AS r FROM documents),
c AS (SELECT doc_id, n_chars, ({' + '.join(f'(NOT {_P[k]})::INT' for k in CONTRACT)})::INT AS missing, least(({' + '.join(f'(NOT {_P[k]})::INT' for k in CONTRACT)}) * 2 + CASE WHEN n_chars < 500 THEN 2 ELSE 0 END, 10)::INT AS score FROM d WHERE r = 1 AND n_chars >= 20)
SELECT doc_id, missing, score, CASE WHEN score <= 2 THEN 'Faible' WHEN score <= 5 THEN 'Moyen' WHEN score <= 8 THEN 'Élevé' ELSE 'Critique' END AS label, CASE WHEN score >= 9 THEN 'CRITIQUE' WHEN score >= 5 THEN 'ÉLEVÉ' ELSE 'NORMALE' END AS alert FROM c""")
def conformity_pipeline(spark, sf_dir):
    d = read(spark, sf_dir, "documents").withColumn("k", dedup.normal(F.col("text")))
    d = dedup.keep_first(d, [F.col("k")], [F.col("doc_id")]).filter("n_chars >= 20")
    missing = sum(((~text.contains_any(F.lower("text"), ws)).cast("int") for ws in CONTRACT.values()), F.lit(0))
    d = d.select("doc_id", missing.alias("missing"), F.least(missing * 2 + F.when(F.col("n_chars") < 500, 2).otherwise(0), F.lit(10)).alias("score"))
    score = F.col("score")
    label = F.when(score <= 2, "Faible").when(score <= 5, "Moyen").when(score <= 8, "Élevé").otherwise("Critique")
    return d.withColumn("label", label).withColumn("alert", F.when(score >= 9, "CRITIQUE").when(score >= 5, "ÉLEVÉ").otherwise("NORMALE"))


@query(f"""WITH {LISTINGS}, m AS (SELECT nation, median(unit_price) AS price, median(CASE WHEN l_returnflag = 'R' THEN unit_price END) AS rent, median(CASE WHEN l_returnflag <> 'R' THEN unit_price END) AS sale, count(*) AS n FROM listings GROUP BY 1),
s AS (SELECT *, greatest(least(coalesce(rent, sale * 0.005) / nullif(sale, 0) * 12, 20), 2) AS yield, (price - min(price) OVER ()) / (max(price) OVER () - min(price) OVER ()) AS macro, (ln(1 + n) - min(ln(1 + n)) OVER ()) / (max(ln(1 + n)) OVER () - min(ln(1 + n)) OVER ()) AS attract FROM m),
i AS (SELECT nation, greatest(least(100 * (0.45 * yield / 20 + 0.30 * macro + 0.25 * attract), 100), 0) AS idx, yield FROM s)
SELECT nation, round(idx, 2) AS profitability, round(yield / 100 - 0.063, 5)::DOUBLE AS expected, round(yield / 100 - 0.063 - 1.6448536269514722 * 0.05, 5)::DOUBLE AS var_95, round((yield / 100 - 0.063) / 0.05, 4)::DOUBLE AS sharpe FROM i""")
def profitability_pipeline(spark, sf_dir):
    rent = F.col("l_returnflag") == "R"
    unit = F.col("unit_price")
    df = written(listings(spark, sf_dir).select("nation", "l_returnflag", "unit_price"))  # read by each step of the medians
    m = impute.group_summary(df, ["nation"], {"price": unit, "rent": F.when(rent, unit), "sale": F.when(~rent, unit)}, F.log1p(F.count(F.lit(1))).alias("n"))
    m = written(m)
    m = scoring.minmax(scoring.minmax(m, "price", "macro"), "n", "attract")
    y = scoring.clip(F.try_divide(F.coalesce("rent", F.col("sale") * 0.005), F.col("sale")) * 12, 2, 20)
    index = scoring.clip(100 * (0.45 * y / 20 + 0.30 * F.col("macro") + 0.25 * F.col("attract")), 0, 100)
    mean = y / 100 - 0.063
    return m.select("nation", F.round(index, 2).alias("profitability"), F.round(mean, 5).alias("expected"), F.round(mean - 1.6448536269514722 * 0.05, 5).alias("var_95"), F.round(mean / 0.05, 4).alias("sharpe"))
