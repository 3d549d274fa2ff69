"""Queries of the sinks, the listing adapters and the streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadastra.functions import fixed
from cadastra.operators import lookup
from cadastra.plans.tables import read
from cadastra.sources import listings, sinks
from cadastra.streaming import ingest

QUERIES: dict = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


@query("""SELECT n_nationkey, '{"type":"Feature","geometry":{"type":"Point","coordinates":[' || (5 + n_nationkey)::DOUBLE || ',' || (30 + n_nationkey)::DOUBLE || ']},"properties":{"name":"' || n_name || '"' || CASE WHEN n_regionkey > 2 THEN ',"region":' || n_regionkey ELSE '' END || '}}' AS feature FROM nation""")
def geojson_features(spark, sf_dir):
    n = read(spark, sf_dir, "nation")
    region = F.when(F.col("n_regionkey") > 2, F.col("n_regionkey")).alias("region")
    k = F.col("n_nationkey").cast("double")
    return n.select("n_nationkey", sinks.feature(30 + k, 5 + k, [F.col("n_name").alias("name"), region]).alias("feature"))


@query("SELECT '{' || string_agg('\"' || k || '\":\"' || v || '\"', ',' ORDER BY k) || '}' AS decoder FROM (SELECT DISTINCT c_nationkey::VARCHAR AS k, n_name AS v FROM customer JOIN nation ON c_nationkey = n_nationkey)")
def encoding_decoder(spark, sf_dir):
    c = read(spark, sf_dir, "customer").join(read(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return sinks.decoder(c, "c_nationkey", "n_name")


@query("""SELECT 'tunisie_annonces' AS source, o_totalprice AS price, (10 + o_orderkey % 90)::DOUBLE AS surface, coalesce(nullif(CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE o_orderpriority END, ''), o_orderstatus) AS city, o_orderstatus AS region, date_trunc('day', o_orderdate)::TIMESTAMP AS published FROM orders""")
def listing_adapter(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    raw = o.select(
        F.concat(F.col("o_totalprice").cast("decimal(18,2)").cast("string"), F.lit(" DT")).alias("prix_montant"),
        (10 + F.col("o_orderkey") % 90).cast("string").alias("surface_couverte"),
        F.when(F.col("o_orderkey") % 4 == 0, F.lit("")).otherwise(F.col("o_orderpriority")).alias("region"),
        F.col("o_orderstatus").alias("gouvernorat"),
        F.date_format("o_orderdate", "dd/MM/yyyy").alias("date_modification"),
    )
    out = listings.canonical(raw, "tunisie_annonces")
    return out.select("source", "price", "surface", "city", "region", F.col("published").cast("timestamp_ntz").alias("published"))


_B = ", ".join(str(b) for b in fixed.BOUNDS)


@query(f"""WITH l AS (SELECT o_orderkey, list_extract(['Residentiel', 'Foncier', 'Commercial', 'Divers'], (o_orderkey % 4)::INT + 1) AS segment, o_orderstatus = 'O' AS rent, o_totalprice / CASE WHEN o_orderstatus = 'O' THEN 100 ELSE 1 END AS price FROM orders)
SELECT o_orderkey, segment FROM l JOIN (VALUES {_B}) b(segment, rl, rh, sl, sh, al, ah) USING (segment) WHERE CASE WHEN rent THEN price BETWEEN rl AND rh ELSE price BETWEEN sl AND sh END""")
def segment_bounds(spark, sf_dir):
    segments = F.array(*[F.lit(b[0]) for b in fixed.BOUNDS])
    rent = F.col("o_orderstatus") == "O"
    o = read(spark, sf_dir, "orders").select("o_orderkey", F.get(segments, (F.col("o_orderkey") % 4).cast("int")).alias("segment"), rent.alias("rent"), (F.col("o_totalprice") / F.when(rent, 100).otherwise(1)).alias("price"))
    b = spark.createDataFrame(fixed.BOUNDS, "segment string, rl double, rh double, sl double, sh double, al double, ah double")
    fits = F.when(F.col("rent"), F.col("price").between(F.col("rl"), F.col("rh"))).otherwise(F.col("price").between(F.col("sl"), F.col("sh")))
    return o.join(lookup.dimension(b), "segment").filter(fits).select("o_orderkey", "segment")


@query("SELECT date_trunc('day', ts)::TIMESTAMP AS day, event_type, count(*)::BIGINT AS n FROM events GROUP BY 1, 2")
def stream_daily_counts(spark, sf_dir):
    schema = read(spark, sf_dir, "events").schema
    out = ingest.daily_counts(spark, f"{sf_dir}/events.parque[t]", schema, "ts", "event_type")
    return out.select(F.col("day").cast("timestamp_ntz").alias("day"), "event_type", "n")
