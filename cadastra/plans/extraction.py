"""Queries that read listings' texts, links, places and ratings, and resolve what they leave open."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cadastra.functions import extract, fixed, nested, text
from cadastra.operators import dedup, impute, lookup
from cadastra.plans.tables import LISTINGS, listings, read
from cadastra.sources.folders import written
from cadastra.sources import markup

QUERIES: dict = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


#: Descriptions of seven forms, one of them empty and one null, with the numbers of a line item; the same words in both dialects.
NOTE = """CASE (l_orderkey + l_linenumber) % 7
 WHEN 0 THEN concat('Appartement S+', CAST(l_linenumber AS STRING), ', ', q, ' m² habitable au 3eme étage, parking, ', p, ' TND')
 WHEN 1 THEN concat('Villa ', q, ' m2 couverte, ', q, '0 m² jardin, ', CAST(l_linenumber AS STRING), ' Chambres, 2 Salles de bain, piscine. Menzah, Tunis ', q, ' m²')
 WHEN 2 THEN concat('terrain ', q, '00 m² terrain prix ', p, ' 000  TND')
 WHEN 3 THEN concat('Bureau au rez de chaussée, haut standing, construit en 19', q, ' et rénové')
 WHEN 4 THEN ''
 WHEN 5 THEN concat('à louer studio meublé neuf, ascenseur, 2eme étage. Corniche, Sousse ', q, ' m') END"""
NUMBERS = {"q": "CAST(CAST(l_quantity AS INT) AS STRING)", "p": "CAST(CAST(floor(l_extendedprice) AS BIGINT) AS STRING)"}
NOTES = f"notes AS (SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, {NOTE} AS note FROM (SELECT *, {NUMBERS['q']} AS q, {NUMBERS['p']} AS p FROM lineitem))"


def notes(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem").withColumns({n: F.expr(e) for n, e in NUMBERS.items()})
    return li.select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", F.expr(NOTE).alias("note"))


def _x(pattern: str, group: int = 1, c: str = "note") -> str:
    return f"nullif(regexp_extract({c}, '{pattern}', {group}), '')"


def _i(pattern: str, c: str = "note") -> str:
    return f"try_cast({_x(pattern, 1, c)} AS INT)"


ID = ["l_orderkey", "l_linenumber"]


@query(f"WITH {NOTES} SELECT l_orderkey, l_linenumber, coalesce({_i(extract.COVERED)}, {_i(extract.ANY_SURFACE)}) AS covered, {_i(extract.GARDEN)} AS garden, {_i(extract.LAND)} AS land FROM notes")
def surface_kinds(spark, sf_dir):
    return notes(spark, sf_dir).select(*ID, *[c.alias(n) for n, c in extract.surfaces(F.col("note")).items()])


def _has(*words, c="lower(note)"):
    return "(" + " OR ".join(f"contains({c}, '{w}')" for w in words) + ")"


@query(f"""WITH {NOTES} SELECT l_orderkey, l_linenumber, coalesce({_i(extract.FLOOR)}, CASE WHEN regexp_matches(note, '{extract.GROUND}') THEN 0 END) AS floor, {_has('meublé', 'meuble', 'furnished')} AS furnished,
 {_has('parking', 'garage')} AS parking, {_has('piscine', 'pool')} AS pool, {_has('ascenseur', 'elevator')} AS lift, lower({_x(extract.STANDING)}) AS standing, {_i(extract.BUILT)} AS built,
 CASE WHEN regexp_matches(note, '{extract.NEW}') THEN 'neuf' WHEN regexp_matches(note, '{extract.RENOVATED}') THEN 'rénové' WHEN regexp_matches(note, '{extract.OLD}') THEN 'ancien' END AS state FROM notes""")
def listing_features(spark, sf_dir):
    return notes(spark, sf_dir).select(*ID, *[c.alias(n) for n, c in extract.features(F.col("note")).items()])


@query(f"""WITH {NOTES}, o AS (SELECT *, CASE WHEN l_linenumber % 2 = 0 THEN l_extendedprice ELSE 0 END AS own_price, CASE WHEN l_orderkey % 3 = 0 THEN l_quantity END AS own_surface,
 try_cast(nullif(regexp_replace({_x(extract.PRICE)}, '\\s+', '', 'g'), '') AS DOUBLE) AS p, {_i(extract.ANY_SURFACE)} AS s FROM notes)
SELECT l_orderkey, l_linenumber, coalesce(nullif(own_price, 0), CASE WHEN p BETWEEN 10000 AND 100000000 THEN p END, own_price) AS price, coalesce(nullif(own_surface, 0), CASE WHEN s BETWEEN 10 AND 10000 THEN s END, own_surface)::DOUBLE AS surface,
 {_i('(?i)([0-9]+)\\s*Chambre')} AS bedrooms, {_i('(?i)([0-9]+)\\s*Salle')} AS bathrooms, {_x(extract.PLACE)} AS quarter, {_x(extract.PLACE, 2)} AS city FROM o""")
def description_backfill(spark, sf_dir):
    n, note = notes(spark, sf_dir), F.col("note")
    own_price = F.when(F.col("l_linenumber") % 2 == 0, F.col("l_extendedprice")).otherwise(0.0)
    own_surface = F.when(F.col("l_orderkey") % 3 == 0, F.col("l_quantity"))
    surface = extract.guarded(extract.whole(note, extract.ANY_SURFACE), 10, 10_000)
    return n.select(
        *ID,
        extract.filled(own_price, extract.price(note)).alias("price"),
        extract.filled(own_surface, surface).alias("surface"),
        extract.whole(note, r"(?i)([0-9]+)\s*Chambre").alias("bedrooms"),
        extract.whole(note, r"(?i)([0-9]+)\s*Salle").alias("bathrooms"),
        extract.found(note, extract.PLACE, 1).alias("quarter"),
        extract.found(note, extract.PLACE, 2).alias("city"),
    )


SHORTHAND = "CASE p_partkey % 6 WHEN 0 THEN concat('App. ', CAST(p_size AS STRING), ' Pic') WHEN 1 THEN 'Surfaces' WHEN 2 THEN concat(' app ', CAST(p_size AS STRING), 'pic ') WHEN 3 THEN 'Surface' WHEN 4 THEN concat('Villa ', p_name) END"


@query(f"""WITH t AS (SELECT p_partkey, trim({SHORTHAND}) AS v FROM part), n AS (SELECT *, {_i(extract.ROOM_SHORT, 'v')} AS rooms FROM t)
SELECT p_partkey, CASE WHEN rooms IS NOT NULL THEN 'Appartement' WHEN regexp_matches(v, '(?i)^Surfaces?$') THEN 'Terrain' END AS kind, rooms FROM n""")
def room_shorthand(spark, sf_dir):
    kind, rooms = extract.room_shorthand(F.expr(SHORTHAND))
    return read(spark, sf_dir, "part").select("p_partkey", kind.alias("kind"), rooms.alias("rooms"))


PLACES = """CASE c_custkey % 11 WHEN 0 THEN 'Location de vacances Hammamet' WHEN 1 THEN 'Tunis , 2 months ago' WHEN 2 THEN ', 3 days ago' WHEN 3 THEN '2 weeks ago'
 WHEN 4 THEN 'boulevard 14 janvier , kantaoui 4089 hammam sousse residence' WHEN 5 THEN 'nabul' WHEN 6 THEN 'Non spécifié' WHEN 7 THEN ' a ' WHEN 8 THEN 'Ariana   Ville' WHEN 9 THEN concat('vente ', lower(c_mktsegment), ' no street 12345678 far from any known city') END"""


def _city_sql(c: str) -> str:
    prefix = " ".join(f"WHEN starts_with(v, '{p}') THEN trim(substr(v, {len(p) + 1}))" for p in fixed.CITY_PREFIXES)
    known = " ".join(f"WHEN contains(v, '{k}') THEN '{k}'" for k in fixed.ADDRESS_CITIES)
    typos = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in fixed.CITY_TYPOS.items())
    none = ", ".join(f"'{x}'" for x in fixed.NO_CITIES)
    return f"""a AS (SELECT *, lower(trim(regexp_replace(regexp_replace({c}, '[^\\x00-\\x7F]', '', 'g'), ' +', ' ', 'g'))) AS v FROM raw), b AS (SELECT * EXCLUDE (v), CASE {prefix} ELSE v END AS v FROM a),
c AS (SELECT * EXCLUDE (v), CASE WHEN NOT {_has(*fixed.RELATIVE_WORDS, c='v')} THEN v WHEN contains(v, ',') AND length(trim(split_part(v, ',', 1))) > 1 THEN trim(split_part(v, ',', 1)) END AS v FROM b),
d AS (SELECT * EXCLUDE (v), CASE WHEN length(v) > 45 AND regexp_matches(v, '[0-9]') THEN CASE {known} END ELSE v END AS v FROM c),
cities AS (SELECT * EXCLUDE (v), CASE WHEN length(t) >= 2 THEN trim(t) END AS city FROM (SELECT *, CASE WHEN v IN ({none}) THEN NULL ELSE CASE v {typos} ELSE v END END AS t FROM d))"""


@query(f"WITH raw AS (SELECT c_custkey, {PLACES} AS place FROM customer), {_city_sql('place')} SELECT c_custkey, city FROM cities")
def city_clean(spark, sf_dir):
    return read(spark, sf_dir, "customer").select("c_custkey", extract.city(F.expr(PLACES)).alias("city"))


_REGION_CASES = " ".join(f"WHEN contains(lower(t), '{r.lower()}') THEN '{r}'" for r in fixed.REGIONS)
POSTS = """concat(text, CASE conv_id % 5 WHEN 0 THEN ' à Hammamet, Nabeul' WHEN 1 THEN ' in Sousse' WHEN 2 THEN '. Ben Arous' WHEN 3 THEN ' près de GAFSA' ELSE '' END)"""


@query(rf"""WITH p AS (SELECT conv_id, turn, {POSTS} AS t FROM conversations), r AS (SELECT *, CASE {_REGION_CASES} ELSE 'Tunisie' END AS region, {_x(r'(?:à|À|in|,)\s+([A-ZÀ-Ú][a-zà-ú -]+)', 1, 't')} AS v FROM p)
SELECT conv_id, turn, region, CASE WHEN v IS NOT NULL AND lower(trim(v)) <> lower(region) THEN trim(v) WHEN region <> 'Tunisie' THEN region ELSE 'Non spécifié' END AS city FROM r""")
def governorate_place(spark, sf_dir):
    t = F.expr(POSTS)
    p = read(spark, sf_dir, "conversations").select("conv_id", "turn", extract.region(t, "Tunisie").alias("region"), F.trim(extract.found(t, r"(?:à|À|in|,)\s+([A-ZÀ-Ú][a-zà-ú -]+)")).alias("v"))
    city = F.when(F.lower("v") != F.lower("region"), F.col("v")).when(F.col("region") != "Tunisie", F.col("region")).otherwise("Non spécifié")
    return p.select("conv_id", "turn", "region", city.alias("city"))


@query(f"WITH raw AS (SELECT c_custkey, {PLACES} AS place, CASE WHEN c_custkey % 4 = 0 THEN 'Sfax' END AS own FROM customer), {_city_sql('place')}, t AS (SELECT *, city AS t FROM cities) SELECT c_custkey, coalesce(own, CASE {_REGION_CASES} END) AS region FROM t WHERE coalesce(own, CASE {_REGION_CASES} END) IS NOT NULL")
def region_from_city(spark, sf_dir):
    own = F.when(F.col("c_custkey") % 4 == 0, "Sfax")
    c = read(spark, sf_dir, "customer").select("c_custkey", F.coalesce(own, extract.region(extract.city(F.expr(PLACES)))).alias("region"))
    return c.filter("region IS NOT NULL")


URLS = "CASE (l_orderkey + l_linenumber) % 6 WHEN 0 THEN 'https://img.example.org/full/12_3.jpg?w=1' WHEN 1 THEN concat('http://x.example.org/a-', CAST(l_linenumber AS STRING), '/thumb.png') WHEN 2 THEN 'http://x.example.org/medium.webp' WHEN 3 THEN 'no link' WHEN 4 THEN 'http://x.example.org/pic' END"
SOURCES = "CASE l_orderkey % 4 WHEN 0 THEN 'Century21' WHEN 1 THEN 'Mubawab Partial' WHEN 2 THEN 'BnB' ELSE 'other' END"
_QUALITY = " ".join(f"WHEN contains(lower(source), '{k}') THEN {v}" for k, v in fixed.SOURCE_QUALITY.items())
_ends = lambda *e: " OR ".join(f"ends_with(split_part(lower(url), '?', 1), '{x}')" for x in e)
PICTURES = f"""pics AS (SELECT l_orderkey, l_linenumber, {URLS} AS url, {SOURCES} AS source, (l_extendedprice IS NOT NULL)::INT + (l_quantity > 10)::INT + 3 + (({URLS}) IS NOT NULL)::INT AS n_filled,
 CASE WHEN l_quantity > 10 THEN 1.0 ELSE 0.5 END AS price_ok, CASE WHEN l_linenumber % 3 > 0 THEN l_discount END AS liquidity, l_tax AS nearby FROM lineitem),
scored AS (SELECT l_orderkey, l_linenumber, nearby, round(greatest(least(coalesce(starts_with(url, 'http'), false)::INT * 0.20 + (nearby * 0.60 + CASE {_QUALITY} ELSE 0.40 END * 0.40) * 0.20
 + CASE WHEN {_ends('.jpg', '.jpeg')} THEN 1.0 WHEN {_ends('.png')} THEN 0.8 WHEN {_ends('.webp')} THEN 0.6 WHEN starts_with(url, 'http') THEN 0.3 ELSE 0.0 END * 0.10 + round(n_filled / 7.0::DOUBLE, 4) * 0.20
 + CASE WHEN {_has('large', 'hd', 'high', '1200', '800', 'full', c='lower(url)')} THEN 1.0 WHEN {_has('medium', 'med', '600', '400', c='lower(url)')} THEN 0.6 WHEN {_has('thumb', 'small', 'tiny', '150', '200', c='lower(url)')} THEN 0.3 WHEN starts_with(url, 'http') THEN 0.5 ELSE 0.0 END * 0.10
 + CASE WHEN regexp_matches(url, '[_/-][0-9]{{1,2}}[_/.-]') THEN 1.0 WHEN starts_with(url, 'http') THEN 0.5 ELSE 0.0 END * 0.05 + price_ok * 0.10 + round(coalesce(liquidity, 0.3), 4) * 0.05, 1.0), 0.0), 4)::DOUBLE AS quality FROM pics)"""


def _pictures(spark, sf_dir):
    url = F.expr(URLS)
    li = read(spark, sf_dir, "lineitem")
    n = F.col("l_extendedprice").isNotNull().cast("int") + (F.col("l_quantity") > 10).cast("int") + 3 + url.isNotNull().cast("int")
    liquidity = F.when(F.col("l_linenumber") % 3 > 0, F.col("l_discount"))
    quality = extract.image_quality(url, F.expr(SOURCES), n, F.when(F.col("l_quantity") > 10, 1.0).otherwise(0.5), liquidity, F.col("l_tax"))
    return li.select(*ID, "l_tax", quality.alias("quality"))


@query(f"WITH {PICTURES} SELECT l_orderkey, l_linenumber, round(quality, 3) AS quality FROM scored")
def image_quality(spark, sf_dir):
    return _pictures(spark, sf_dir).select(*ID, F.round("quality", 3).alias("quality"))


@query(f"WITH {PICTURES} SELECT l_orderkey, l_linenumber, round(0.5 * nearby + 0.3 * 0.25 + 0.2 * quality, 5)::DOUBLE AS fused FROM scored")
def multimodal_score(spark, sf_dir):
    return _pictures(spark, sf_dir).select(*ID, F.round(0.5 * F.col("l_tax") + 0.3 * 0.25 + 0.2 * F.col("quality"), 5).alias("fused"))


_RATE_ROWS = ", ".join(f"({y}, {q}, {r})" for (y, q), r in fixed.RATES.items())


@query(f"""WITH rates(y, q, rate) AS (VALUES {_RATE_ROWS}), growth AS (SELECT (year(o_orderdate) + 24)::INT AS y, quarter(o_orderdate)::INT AS q, avg(o_totalprice) / 100000 AS g FROM orders WHERE year(o_orderdate) < 2001 OR quarter(o_orderdate) < 3 GROUP BY 1, 2),
months AS (SELECT (year(o_orderdate) + 24)::INT AS y, quarter(o_orderdate)::INT AS q, avg(o_totalprice) / 50000 AS m FROM orders WHERE month(o_orderdate) NOT IN (4, 5, 6) OR year(o_orderdate) < 1999 GROUP BY 1, 2),
last AS (SELECT g FROM growth ORDER BY y DESC, q DESC LIMIT 1)
SELECT coalesce(g.y, r.y) AS y, coalesce(g.q, r.q) AS q, coalesce(rate, 7.0)::DOUBLE AS rate, round(coalesce(g.g, (SELECT g FROM last), 1.5), 4) AS growth, round(CASE WHEN g.y IS NULL THEN 5.0 ELSE coalesce(a.m, b.m, 5.5) END, 4)::DOUBLE AS inflation
FROM growth g FULL JOIN rates r ON g.y = r.y AND g.q = r.q LEFT JOIN months a ON a.y = g.y AND a.q = g.q LEFT JOIN months b ON b.y = g.y - 1 AND b.q = g.q""")
def market_context(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select((F.year("o_orderdate") + 24).alias("y"), F.quarter("o_orderdate").alias("q"), F.month("o_orderdate").alias("m"), "o_totalprice")
    rates = spark.createDataFrame([(*k, r) for k, r in fixed.RATES.items()], "y int, q int, rate double")
    growth = o.filter("y < 2025 OR q < 3").groupBy("y", "q").agg((F.avg("o_totalprice") / 100_000).alias("g")).withColumn("known", F.lit(True))
    months = o.filter("m NOT IN (4, 5, 6) OR y < 2023").groupBy("y", "q").agg((F.avg("o_totalprice") / 50_000).alias("now"))
    before = months.select((F.col("y") + 1).alias("y"), "q", F.col("now").alias("before"))
    out = growth.join(rates, ["y", "q"], "full").join(months, ["y", "q"], "left").join(before, ["y", "q"], "left")
    every = Window.partitionBy(F.lit(0))  # a row a quarter
    last = F.max(F.when(F.col("known"), F.struct("y", "q", "g"))).over(every)["g"]
    inflation = F.when(F.col("known"), F.coalesce("now", "before", F.lit(5.5))).otherwise(5.0)
    return out.select("y", "q", F.coalesce("rate", F.lit(7.0)).alias("rate"), F.round(F.coalesce("g", last, F.lit(1.5)), 4).alias("growth"), F.round(inflation, 4).alias("inflation"))


def _n(words):
    return " + ".join(f"coalesce(contains(lower(note), '{w}'), false)::INT" for w in words)


@query(f"""WITH {NOTES}, v AS (SELECT *, ({_n(fixed.RENT_WORDS)}) AS rent, ({_n(fixed.SALE_WORDS)}) AS sale, CASE WHEN l_linenumber = 1 THEN 2 WHEN l_linenumber = 2 THEN 7 END AS own, CASE WHEN l_linenumber < 6 THEN l_extendedprice END AS price FROM notes)
, r AS (SELECT l_orderkey, l_linenumber, CASE WHEN own IN (1, 2) THEN own WHEN rent > 0 AND rent >= sale THEN 1 WHEN sale > 0 THEN 2 WHEN price < 5000 THEN 1 WHEN price > 20000 THEN 2 WHEN price IS NOT NULL THEN 1 END AS transaction FROM v)
SELECT l_orderkey, l_linenumber, coalesce(transaction, (SELECT transaction FROM r WHERE transaction IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS transaction FROM r""")
def transaction_resolved(spark, sf_dir):
    t = F.lower(F.coalesce("note", F.lit("")))
    own = F.when(F.col("l_linenumber") == 1, 2).when(F.col("l_linenumber") == 2, 7)
    v = notes(spark, sf_dir).select(*ID, own.alias("own"), F.when(F.col("l_linenumber") < 6, F.col("l_extendedprice")).alias("price"), text.hits(t, fixed.RENT_WORDS).alias("rent"), text.hits(t, fixed.SALE_WORDS).alias("sale"))
    price, rent, sale = F.col("price"), F.col("rent"), F.col("sale")
    bands = F.when(price < 5000, 1).when(price > 20_000, 2).when(price.isNotNull(), 1)
    known = v.select(*ID, F.when(F.col("own").isin(1, 2), F.col("own")).when((rent > 0) & (rent >= sale), 1).when(sale > 0, 2).otherwise(bands).alias("transaction"))
    return impute.with_mode(known, "transaction")


_TYPES = " ".join(f"WHEN {_has(*ws, c='lower(note)')} THEN '{k}'" for k, ws in fixed.TYPE_WORDS.items())
_SEGMENTS = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in fixed.SEGMENT.items())


@query(f"WITH {NOTES}, t AS (SELECT l_orderkey, l_linenumber, CASE {_TYPES} ELSE 'Divers' END AS kind FROM notes) SELECT l_orderkey, l_linenumber, kind, CASE kind {_SEGMENTS} END AS segment FROM t")
def listing_segments(spark, sf_dir):
    kind = text.first_match(F.lower("note"), fixed.TYPE_WORDS, "Divers")
    segments = F.create_map(*[F.lit(x) for pair in fixed.SEGMENT.items() for x in pair])
    return notes(spark, sf_dir).select(*ID, kind.alias("kind"), F.element_at(segments, kind).alias("segment"))


@query(f"WITH {NOTES}, t AS (SELECT CASE {_TYPES} ELSE 'Divers' END AS kind, l_quantity FROM notes), s AS (SELECT CASE kind {_SEGMENTS} END AS segment, l_quantity FROM t) SELECT CASE WHEN segment = 'Divers' AND l_quantity > 40 THEN 'Foncier' WHEN segment = 'Residentiel' AND l_quantity < 5 THEN 'Divers' ELSE segment END AS segment, count(*)::BIGINT AS n FROM s GROUP BY 1")
def regrouped_counts(spark, sf_dir):
    segments = F.create_map(*[F.lit(x) for pair in fixed.SEGMENT.items() for x in pair])
    s = notes(spark, sf_dir).select("l_quantity", F.element_at(segments, text.first_match(F.lower("note"), fixed.TYPE_WORDS, "Divers")).alias("segment"))
    moved = F.when((F.col("segment") == "Divers") & (F.col("l_quantity") > 40), "Foncier").when((F.col("segment") == "Residentiel") & (F.col("l_quantity") < 5), "Divers").otherwise(F.col("segment"))
    return s.groupBy(moved.alias("segment")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {NOTES}, t AS (SELECT l_orderkey, l_linenumber, round(l_extendedprice / 1000) AS p, round(l_quantity) AS s, md5(coalesce(substring(note, 1, 120), '')) AS h, note FROM notes)
SELECT l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY coalesce(p, -1), coalesce(s, -1), h ORDER BY l_orderkey, l_linenumber) AS r FROM t) WHERE r = 1 OR coalesce(trim(note), '') = ''""")
def dedup_price_surface_text(spark, sf_dir):
    n = notes(spark, sf_dir)
    key = [F.coalesce(F.round(F.col("l_extendedprice") / 1000), F.lit(-1.0)), F.coalesce(F.round("l_quantity"), F.lit(-1.0)), F.md5(F.coalesce(F.substring("note", 1, 120), F.lit("")))]
    blank = F.coalesce(F.trim("note"), F.lit("")) == ""
    return dedup.keep_first(n, key, [F.col(c) for c in ID], blank).select(*ID)


OSM = "CASE s_suppkey % 3 WHEN 0 THEN concat('{\"type\":\"node\",\"id\":', CAST(s_suppkey AS STRING), ',\"lat\":36.5,\"lon\":10.25,\"tags\":{\"amenity\":\"school\",\"name\":\"', s_name, '\"}}') WHEN 1 THEN concat('{\"type\":\"way\",\"id\":', CAST(s_suppkey AS STRING), ',\"center\":{\"lat\":35.75,\"lon\":11.5},\"tags\":{\"building\":\"yes\"}}') ELSE '{\"type\":\"way\"' END"


@query(f"""WITH t AS (SELECT s_suppkey, CASE WHEN json_valid(j) THEN j END AS j FROM (SELECT s_suppkey, {OSM} AS j FROM supplier))
SELECT s_suppkey, json_extract_string(j, '$.type') AS type, coalesce(json_extract(j, '$.lat')::DOUBLE, json_extract(j, '$.center.lat')::DOUBLE) AS lat, coalesce(json_extract(j, '$.lon')::DOUBLE, json_extract(j, '$.center.lon')::DOUBLE) AS lon, json_extract_string(j, '$.tags.amenity') AS amenity, json_extract_string(j, '$.tags.name') AS name FROM t WHERE j IS NOT NULL""")
def osm_elements(spark, sf_dir):
    schema = "type string, id long, lat double, lon double, center struct<lat: double, lon: double>, tags map<string, string>, _bad string"
    e = read(spark, sf_dir, "supplier").select("s_suppkey", F.from_json(F.expr(OSM), schema, {"columnNameOfCorruptRecord": "_bad"}).alias("e")).filter("e._bad IS NULL")
    tag = lambda k: F.try_element_at("e.tags", F.lit(k)).alias(k)
    return e.select("s_suppkey", "e.type", F.coalesce("e.lat", "e.center.lat").alias("lat"), F.coalesce("e.lon", "e.center.lon").alias("lon"), tag("amenity"), tag("name"))


@query("""WITH m AS (SELECT page_id, unnest(regexp_extract_all(html, '<li><a href="([^"]*)">([^<]*)</a></li>', 0)) AS li, generate_subscripts(regexp_extract_all(html, '<li><a href="([^"]*)">([^<]*)</a></li>', 0), 1) AS pos FROM pages)
SELECT page_id, pos::INT AS pos, regexp_extract(li, 'href="([^"]*)"', 1) AS category, regexp_extract(li, '">([^<]*)</a>', 1) AS description FROM m""")
def html_rows(spark, sf_dir):
    items = F.regexp_extract_all("html", F.lit('(<li><a href="[^"]*">[^<]*</a></li>)'), F.lit(1))
    m = read(spark, sf_dir, "pages").select("page_id", F.posexplode(items).alias("at", "li"))
    return m.select("page_id", (F.col("at") + 1).alias("pos"), F.regexp_extract("li", 'href="([^"]*)"', 1).alias("category"), F.regexp_extract("li", '">([^<]*)</a>', 1).alias("description"))


@query("""WITH j AS (SELECT n_name, '<table><tr><th>name</th><th>balance</th></tr>' || string_agg('<tr><td>' || s_name || '</td><td> ' || s_suppkey || ',5 </td></tr>', '' ORDER BY s_suppkey) || '</table>' AS html FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1),
r AS (SELECT n_name, unnest(regexp_extract_all(html, '<tr><td>.*?</tr>')) AS row FROM j)
SELECT n_name, trim(regexp_extract(row, '<td>(.*?)</td><td>(.*?)</td>', 1)) AS name, replace(trim(regexp_extract(row, '<td>(.*?)</td><td>(.*?)</td>', 2)), ',', '.')::DOUBLE AS balance FROM r""")
def html_table(spark, sf_dir):
    s = read(spark, sf_dir, "supplier").join(lookup.dimension(read(spark, sf_dir, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))
    row = F.concat(F.lit("<tr><td>"), "s_name", F.lit("<td> "), F.col("s_suppkey").cast("string"), F.lit(",5 "))
    body = s.groupBy("n_name").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("s_suppkey", row.alias("row")))), lambda x: x["row"]), "").alias("body"))
    cells = markup.tables(body.select("n_name", F.concat(F.lit("<table><tr><th>name</th><th>balance</th></tr>"), "body").alias("html")), "n_name", "html")
    of = lambda name: F.max(F.when(F.col("header") == name, F.col("value")))
    return cells.groupBy("n_name", "table", "line").agg(of("name").alias("name"), text.number(of("balance")).alias("balance")).select("n_name", "name", "balance")


#: The links of a page's navigation as a table with two rows of headers, spans and tags that are never closed, in the midst of the page.
AS_TABLE = [("<nav><ul>", "<table><thead><tr><th rowspan=2>path<th colspan=2>text<th></tr><tr><th>name<th>kind<th></thead>"), ('<li><a href="([^"]*)">([^<]*)</a></li>', "<tr><td>$1<td> <b>$2</b> <td colspan=2>link &lt;a&gt;"), ("</ul></nav>", "</table>")]


@query("""WITH m AS (SELECT page_id, regexp_extract_all(regexp_extract(html, '<nav>.*?</nav>'), '<li><a href="([^"]*)">([^<]*)</a></li>', 0) AS li FROM pages), i AS (SELECT page_id, unnest(range(0, len(li))) AS line, unnest(li) AS li FROM m),
c AS (SELECT page_id, line::INT AS line, regexp_extract(li, 'href="([^"]*)"', 1) AS a, regexp_extract(li, '">([^<]*)</a>', 1) AS b FROM i)
SELECT * FROM (SELECT page_id, line, 0 AS at, 'path' AS header, trim(a) AS value FROM c UNION ALL SELECT page_id, line, 1, 'text name', trim(b) FROM c UNION ALL SELECT page_id, line, 2, 'text kind', 'link <a>' FROM c UNION ALL SELECT page_id, line, 3, 'Col_3', 'link <a>' FROM c) WHERE value <> ''""")
def html_page_tables(spark, sf_dir):
    html = F.col("html")
    for pattern, tags in AS_TABLE:
        html = F.regexp_replace(html, pattern, tags)
    cells = markup.tables(read(spark, sf_dir, "pages").select("page_id", html.alias("html")), "page_id", "html")
    return cells.filter("table = 0").select("page_id", "line", "at", "header", "value")


NESTED = "concat('{\"', event_type, '\":[{\"note\":', CAST(value AS STRING), ',\"avis\":', CAST(user_id AS STRING), '},{\"note\":null,\"avis\":1}],\"none\":[]}')"


@query("""WITH j AS (SELECT ('{"' || event_type || '":[{"note":' || value || ',"avis":' || user_id || '},{"note":null,"avis":1}],"none":[]}')::JSON AS j FROM events), r AS (SELECT k.key AS region, k.value AS places FROM j, json_each(j.j) k)
SELECT region, count(try_cast(p.value ->> 'note' AS DOUBLE))::BIGINT AS rated, sum((p.value ->> 'avis')::BIGINT)::BIGINT AS avis FROM r, json_each(r.places) p GROUP BY 1""")
def nested_json(spark, sf_dir):
    """Places by region from objects whose keys are not known before."""
    regions = nested.entries(read(spark, sf_dir, "events").select(F.try_parse_json(F.expr(NESTED)).alias("v")), "v", "_pos", "region", "places")
    p = nested.entries(regions.select("region", "places"), "places", "_pos", "_key", "p")
    return p.groupBy("region").agg(F.count(F.try_variant_get("p", "$.note", "double")).alias("rated"), F.sum(F.try_variant_get("p", "$.avis", "long")).alias("avis"))


@query("""SELECT event_type, p.key AS path, count(*)::BIGINT AS n, round(avg(p.value::DOUBLE), 6)::DOUBLE AS mean, 0::BIGINT AS broken FROM (SELECT event_type, props::JSON AS j FROM events WHERE json_valid(props)) e, json_each(e.j) p GROUP BY 1, 2
UNION ALL SELECT event_type, NULL, 0, NULL, count(*) FROM (SELECT event_type, CASE WHEN event_id % 9 = 0 THEN props[:4] ELSE props END AS props FROM events) WHERE NOT json_valid(props) GROUP BY 1""")
def json_props(spark, sf_dir):
    """Leaves of raw properties by path, and how many texts of a kind that lost their ends are no JSON."""
    e = read(spark, sf_dir, "events")
    found = nested.leaves(e, "event_id", "props").join(e.select("event_id", "event_type"), "event_id")
    found = found.groupBy("event_type", "path").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.expr("try_cast(value AS DOUBLE)")), 6).alias("mean")).withColumn("broken", F.lit(0).cast("long"))
    cut = e.select("event_id", F.when(F.col("event_id") % 9 == 0, F.substring("props", 1, 4)).otherwise(F.col("props")).alias("props"))
    lost = nested.malformed(cut, "event_id", "props").join(e.select("event_id", "event_type"), "event_id").groupBy("event_type").agg(F.count(F.lit(1)).alias("broken"))
    return found.unionByName(lost.select("event_type", F.lit(None).cast("string").alias("path"), F.lit(0).cast("long").alias("n"), F.lit(None).cast("double").alias("mean"), "broken"))


@query("SELECT o_orderkey, o_totalprice, sparse AS kept_sparse FROM (SELECT *, CASE WHEN o_orderkey % 10 = 0 THEN 1 END AS sparse FROM orders)")
def null_columns_dropped(spark, sf_dir):
    """Columns null in more than 0.8 of the rows, or with one value alone, go unless protected."""
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", F.when(F.col("o_orderkey") % 10 == 0, 1).alias("kept_sparse"), F.when(F.col("o_orderkey") % 10 == 1, 1).alias("sparse"), F.lit("x").alias("same"), F.lit(None).cast("int").alias("none"))
    return impute.without_empty(o, 0.8, ["kept_sparse"])


@query("SELECT 0::INT AS missing, c_custkey, c_name, coalesce(c_acctbal, 0)::DOUBLE AS c_acctbal FROM customer WHERE c_nationkey <> 0")
def projected_known_codes(spark, sf_dir):
    """Rows with a known code in a fixed order of columns; a column that is absent is 0."""
    c = read(spark, sf_dir, "customer").filter("c_nationkey != 0")
    return c.select(*[(F.coalesce(F.col(n), F.lit(0).cast(dict(c.dtypes)[n])) if n in c.columns else F.lit(0)).alias(n) for n in ("missing", "c_custkey", "c_name", "c_acctbal")])


_RATED = "CASE event_id % 4 WHEN 0 THEN concat('Note 4,', CAST(user_id % 10 AS STRING), ' sur 5, 1 234 avis') WHEN 1 THEN '3 étoiles' WHEN 2 THEN concat('2.9 (', CAST(user_id AS STRING), ')') END"


@query(f"""WITH r AS (SELECT event_id, {_RATED} AS t FROM events), n AS (SELECT event_id, coalesce(try_cast(replace(nullif(regexp_extract(t, '([0-9][,.][0-9])', 1), ''), ',', '.') AS DOUBLE), try_cast(nullif(regexp_extract(t, '([0-9])\\s+étoile', 1), '') AS DOUBLE), 0)::DOUBLE AS note,
 coalesce(try_cast(nullif(regexp_extract(regexp_replace(regexp_replace(t, '^[^,]*, ', ''), '[  ,]', '', 'g'), '([0-9]+)', 1), '') AS BIGINT), 0) AS avis FROM r)
SELECT event_id, note, avis, note >= 4 AND avis >= 5 AS good, (note > 0 AND note < 3) OR (avis >= 20 AND note < 3.5) AS alert FROM n""")
def rating_filters(spark, sf_dir):
    t = F.expr(_RATED)
    r = read(spark, sf_dir, "events").select("event_id", extract.rating(t).alias("note"), extract.reviews(F.regexp_replace(t, "^[^,]*, ", "")).alias("avis"))
    note, avis = F.col("note"), F.col("avis")
    return r.select("event_id", "note", "avis", ((note >= 4) & (avis >= 5)).alias("good"), (((note > 0) & (note < 3)) | ((avis >= 20) & (note < 3.5))).alias("alert"))


@query("WITH l AS (SELECT page_id, CASE WHEN page_id % 3 > 0 THEN url END AS url, CASE WHEN page_id % 4 = 0 THEN '  ' ELSE regexp_extract(html, '<title>([^<]*)</title>', 1) END AS title FROM pages) SELECT page_id, coalesce(url, '') <> '' AS linked FROM l WHERE trim(coalesce(url, '')) <> '' OR trim(coalesce(title, '')) <> ''")
def valid_listings(spark, sf_dir):
    p = read(spark, sf_dir, "pages").select("page_id", F.when(F.col("page_id") % 3 > 0, F.col("url")).alias("url"), F.when(F.col("page_id") % 4 == 0, "  ").otherwise(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("title"))
    given = lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""
    return p.filter(given("url") | given("title")).select("page_id", (F.coalesce("url", F.lit("")) != "").alias("linked"))


@query("WITH m AS (SELECT s_nationkey AS k, median(s_acctbal / 100) AS lat, median(s_suppkey % 180) AS lon FROM supplier WHERE s_suppkey % 3 > 0 GROUP BY 1) SELECT n_nationkey, round(coalesce(lat, 36.8), 4)::DOUBLE AS lat, round(coalesce(lon, 10.1), 4)::DOUBLE AS lon FROM nation LEFT JOIN m ON k = n_nationkey")
def region_coordinates(spark, sf_dir):
    m = read(spark, sf_dir, "supplier").filter("s_suppkey % 3 > 0").withColumnRenamed("s_nationkey", "k")
    m = impute.group_summary(m, ["k"], {"lat": F.col("s_acctbal") / 100, "lon": F.col("s_suppkey") % 180})
    n = read(spark, sf_dir, "nation").join(m, F.col("k") == F.col("n_nationkey"), "left")
    return n.select("n_nationkey", F.round(F.coalesce("lat", F.lit(36.8)), 4).alias("lat"), F.round(F.coalesce("lon", F.lit(10.1)), 4).alias("lon"))


@query("WITH g AS (SELECT c_nationkey, round(avg(c_acctbal), 6) AS score, count(*)::BIGINT AS n FROM customer GROUP BY 1) SELECT c_nationkey, score, n, row_number() OVER (ORDER BY score DESC, n, c_nationkey)::INT AS rank FROM g")
def ranked_regions(spark, sf_dir):
    g = read(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.round(F.avg("c_acctbal"), 6).alias("score"), F.count(F.lit(1)).alias("n"))
    order = [F.desc("score"), F.asc("n"), F.asc("c_nationkey")]
    return g.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order))).orderBy(*order)  # one row a region


@query("SELECT upper(trim(n_name)) AS place FROM nation UNION SELECT upper(trim(r_name)) FROM region UNION SELECT upper(trim(c_mktsegment)) FROM customer")
def place_union(spark, sf_dir):
    parts = [("nation", "n_name"), ("region", "r_name"), ("customer", "c_mktsegment")]
    first, *rest = [read(spark, sf_dir, t).select(F.upper(F.trim(c)).alias("place")) for t, c in parts]
    for df in rest:
        first = first.union(df)
    return first.distinct()


_INDICATORS = {"rate": "click", "inflation": "purchase", "growth": "view"}


@query("SELECT user_id, " + ", ".join(f"arg_max(value, (ts, event_id)) FILTER (WHERE contains(upper(event_type), upper('{w[:4]}'))) AS {k}" for k, w in _INDICATORS.items()) + " FROM events GROUP BY 1")
def last_indicator(spark, sf_dir):
    own = lambda w: F.upper("event_type").contains(w[:4].upper())
    return read(spark, sf_dir, "events").groupBy("user_id").agg(*[F.max_by(F.when(own(w), F.col("value")), F.when(own(w), F.struct("ts", "event_id"))).alias(k) for k, w in _INDICATORS.items()])


_LINKS = "array_of(concat('/img/', CAST(page_id AS STRING), '_thumb.jpg'), '//cdn.example.org/a.PNG', '/img/icon.png', CASE WHEN page_id % 2 = 0 THEN '/img/full.jpeg' ELSE '/doc.pdf' END, CASE WHEN page_id % 3 = 0 THEN url ELSE 'https://x.example.org/b_thumb.webp' END)"


@query(f"""WITH l AS (SELECT page_id, list_transform({_LINKS.replace('array_of', 'list_value')}, lambda x: CASE WHEN starts_with(x, 'http') THEN x WHEN starts_with(x, '//') THEN 'https:' || x ELSE 'https://home.example.org' || x END) AS l FROM pages),
p AS (SELECT page_id, list_filter(l, lambda x: NOT regexp_matches(lower(x), 'icon|spacer|logo') AND regexp_matches(lower(x), '[.](jpg|jpeg|png|webp|gif)')) AS l FROM l), f AS (SELECT *, list_filter(l, lambda x: NOT contains(lower(x), 'thumb')) AS f FROM p)
SELECT page_id, array_to_string(CASE WHEN len(f) > 0 THEN f ELSE l END, '|') AS links FROM f""")
def picture_links(spark, sf_dir):
    links = F.expr(_LINKS.replace("array_of", "array"))
    return read(spark, sf_dir, "pages").select("page_id", F.array_join(extract.image_links(links, "https://home.example.org"), "|").alias("links"))


_POST = "concat('https://m.example.org/marketplace/item/', CAST(conv_id AS STRING), '00/?ref=', role)"
_PHRASE = "CASE turn % 4 WHEN 0 THEN concat(CAST(conv_id AS STRING), ' DT par mois') WHEN 1 THEN concat('prix: ', CAST(conv_id AS STRING), ' dinars') WHEN 2 THEN text ELSE concat('TND ', CAST(conv_id AS STRING), '.500') END"
_PRICES = [r"([0-9][0-9 ,.]*)\s*(?:DT|TND|dinars)", r"(?:DT|TND)\s*([0-9][0-9 ,.]*)"]


@query(f"SELECT conv_id, turn, regexp_extract({_POST}, '/item/([0-9]+)', 1) AS listing, coalesce(" + ", ".join(_x(p, 1, f"({_PHRASE})") for p in _PRICES) + ") AS price FROM conversations")
def link_id_price(spark, sf_dir):
    c = read(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", F.regexp_extract(F.expr(_POST), "/item/([0-9]+)", 1).alias("listing"), F.coalesce(*[extract.found(F.expr(_PHRASE), p) for p in _PRICES]).alias("price"))


_COMMA = "CASE c_custkey % 3 WHEN 0 THEN concat(c_mktsegment, ', ', c_name) WHEN 1 THEN c_mktsegment ELSE concat('a, b, ', c_name) END"


@query(f"SELECT c_custkey, trim(split_part({_COMMA}, ',', 1)) AS quarter, CASE WHEN contains({_COMMA}, ',') THEN trim(string_split({_COMMA}, ',')[-1]) END AS city FROM customer")
def comma_places(spark, sf_dir):
    parts = F.split(F.expr(_COMMA), ",")
    return read(spark, sf_dir, "customer").select("c_custkey", F.trim(parts[0]).alias("quarter"), F.when(F.size(parts) > 1, F.trim(F.element_at(parts, -1))).alias("city"))


_SPANS = "array_of(concat(CAST(p_size AS STRING), ' m²'), concat(CAST(p_partkey % 5 + 1 AS STRING), ' Pièces'), 'Chambre: 2', CASE WHEN p_partkey % 2 = 0 THEN '1 Salle de bain' ELSE 'vue' END, 'Capacité 6', concat('min ', CAST(p_size % 4 AS STRING), ' nuits'))"
_MARKS = {"surface": "m²", "rooms": "Pièce", "bedrooms": "Chambre", "bathrooms": "Salle de bain", "capacity": "Capacité", "nights": "nuit"}


@query(f"WITH s AS (SELECT p_partkey, {_SPANS.replace('array_of', 'list_value')} AS spans FROM part) SELECT p_partkey, " + ", ".join(f"try_cast(nullif(regexp_extract(list_filter(spans, lambda x: contains(x, '{w}'))[1], '([0-9]+)', 1), '') AS INT) AS {k}" for k, w in _MARKS.items()) + " FROM s")
def feature_spans(spark, sf_dir):
    spans = F.expr(_SPANS.replace("array_of", "array"))
    first = lambda w: F.get(F.filter(spans, lambda x: x.contains(w)), F.lit(0))
    return read(spark, sf_dir, "part").select("p_partkey", *[extract.whole(first(w), "([0-9]+)").alias(k) for k, w in _MARKS.items()])


_FILES = "CASE page_id % 3 WHEN 0 THEN concat('annonces_2024', lpad(CAST(page_id % 12 + 1 AS STRING), 2, '0'), lpad(CAST(page_id % 40 AS STRING), 2, '0'), '.csv') WHEN 1 THEN url ELSE 'listing_20251305.csv' END"


@query(rf"SELECT page_id, coalesce(try_strptime(nullif(regexp_extract({_FILES}, '([0-9]{{8}})', 1), ''), '%Y%m%d')::DATE, DATE '2026-02-19') AS day FROM pages")
def file_dates(spark, sf_dir):
    day = F.try_to_timestamp(extract.found(F.expr(_FILES), "([0-9]{8})"), F.lit("yyyyMMdd")).cast("date")
    return read(spark, sf_dir, "pages").select("page_id", F.coalesce(day, F.lit("2026-02-19").cast("date")).alias("day"))


_WHEN = "CASE event_id % 8 WHEN 0 THEN '3 months ago' WHEN 1 THEN '9 months ago' WHEN 2 THEN concat(CAST(user_id % 12 AS STRING), ' years ago') WHEN 3 THEN 'just now' WHEN 4 THEN '5 days ago' WHEN 5 THEN concat(CAST(2015 + user_id % 14 AS STRING), '-03-01') WHEN 6 THEN 'soon' END"


@query(rf"""WITH s AS (SELECT event_id, lower(trim({_WHEN})) AS s FROM events), n AS (SELECT *, coalesce(try_cast(nullif(regexp_extract(s, '([0-9]+)', 1), '') AS INT), 1) AS n, try_cast(s AS DATE) AS d FROM s)
SELECT event_id, CASE WHEN s IS NULL THEN 2026 WHEN {_has('minute', 'hour', 'day', 'week', c='s')} THEN 2026 WHEN contains(s, 'month') THEN CASE WHEN n <= 6 THEN 2026 ELSE 2025 END WHEN contains(s, 'year') THEN greatest(2026 - n, 2018)
 WHEN {_has('ago', 'just', c='s')} THEN 2026 WHEN d IS NULL THEN 2026 WHEN year(d) BETWEEN 2018 AND 2026 THEN year(d) ELSE 2018 END::INT AS year FROM n""")
def year_rules(spark, sf_dir):
    s = F.lower(F.trim(F.expr(_WHEN)))
    n, day = F.coalesce(extract.whole(s, "([0-9]+)"), F.lit(1)), F.year(s.try_cast("date"))
    has = lambda *w: text.contains_any(s, list(w))
    year = F.when(s.isNull() | has("minute", "hour", "day", "week"), 2026).when(s.contains("month"), F.when(n <= 6, 2026).otherwise(2025)).when(s.contains("year"), F.greatest(2026 - n, F.lit(2018)))
    year = year.when(has("ago", "just") | day.isNull(), 2026).when(day.between(2018, 2026), day).otherwise(2018)
    return read(spark, sf_dir, "events").select("event_id", year.alias("year"))


@query("SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN CASE WHEN o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '2000-06-30' THEN o_orderdate END ELSE o_orderdate END::DATE AS day FROM orders")
def trusted_window(spark, sf_dir):
    day = F.col("o_orderdate")
    inside = F.when(day.between(F.lit("1996-01-01").cast("timestamp"), F.lit("2000-06-30").cast("timestamp")), day)
    return read(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderpriority") == "1-URGENT", inside).otherwise(day).cast("date").alias("day"))


@query(r"SELECT doc_id, md5(trim(regexp_replace(regexp_replace(coalesce(text, ''), '[^\x20-\x7E]', '', 'g'), ' +', ' ', 'g'))) AS cell, round(n_chars / 7, 4)::DOUBLE AS number FROM documents")
def export_cells(spark, sf_dir):
    """What an export writes: printable ASCII, numbers to four digits."""
    cell = F.trim(F.regexp_replace(F.regexp_replace(F.coalesce("text", F.lit("")), r"[^\x20-\x7E]", ""), " +", " "))
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(cell).alias("cell"), F.round(F.col("n_chars") / 7, 4).alias("number"))


_DICTIONARY = [("user", "who", "long"), ("value", "how much", "double"), ("event_type", "what", "string")]


@query("""WITH g AS (SELECT event_type, count(*) AS n, avg(value) AS m FROM events GROUP BY 1) SELECT 'signal' AS sheet, event_type AS key, round(m, 3)::DOUBLE AS value FROM g UNION ALL SELECT 'top', event_type, n FROM g WHERE n >= (SELECT max(n) FROM g)
UNION ALL SELECT 'alert', event_type, n FROM g WHERE m < (SELECT avg(value) FROM events) UNION ALL """ + " UNION ALL ".join(f"SELECT 'dictionary', '{a}: {b} ({c})', NULL" for a, b, c in _DICTIONARY))
def signal_sheets(spark, sf_dir):
    """The sheets of a report as one table: measures, the largest groups, those below the mean, and the columns' meanings."""
    e = read(spark, sf_dir, "events")
    g = e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("m"), F.sum("value").alias("s"), F.count("value").alias("c"))
    every = Window.partitionBy(F.lit(0))  # a row a type
    g = g.withColumns({"most": F.max("n").over(every), "mean": F.sum("s").over(every) / F.sum("c").over(every)})
    sheet = lambda name, value, rows: rows.select(F.lit(name).alias("sheet"), F.col("event_type").alias("key"), value.cast("double").alias("value"))
    words = spark.createDataFrame([("dictionary", f"{a}: {b} ({c})", None) for a, b, c in _DICTIONARY], "sheet string, key string, value double")
    return sheet("signal", F.round("m", 3), g).unionByName(sheet("top", F.col("n"), g.filter("n >= most"))).unionByName(sheet("alert", F.col("n"), g.filter("m < mean"))).unionByName(words)


@query(f"WITH {LISTINGS}, g AS (SELECT nation, count(*) AS n, median(unit_price) AS m FROM listings GROUP BY 1) SELECT nation || ': ' || n || ' listings' AS line, round(m, 2) AS median_price FROM g UNION ALL SELECT 'all: ' || count(*) || ' listings', round(avg(unit_price), 2) FROM listings")
def report_lines(spark, sf_dir):
    li = written(listings(spark, sf_dir).select("nation", "unit_price"))
    g = impute.group_summary(li, ["nation"], {"median_price": F.col("unit_price")}, F.count(F.lit(1)).alias("n")).withColumn("median_price", F.round("median_price", 2))
    total = li.agg(F.lit("all").alias("nation"), F.count(F.lit(1)).alias("n"), F.round(F.avg("unit_price"), 2).alias("median_price"))
    return g.unionByName(total).select(F.concat("nation", F.lit(": "), F.col("n").cast("string"), F.lit(" listings")).alias("line"), "median_price")


#: Contracts: a document and the first words of some of the clauses, by its number.
_WORDS = [ws[0] for ws in fixed.CLAUSES.values()]
_KINDS = ["وعد بالبيع", "وكالة", "بيع عقار مبني", "بيع قطعة", "بيع ماشية", "بيع", "كراء مسكن", "تسويغ محل تجاري", "إيجار مكتب", "كراء", ""]
_KIND_CASE = "CASE doc_id % 11 " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(_KINDS)) + " END"
_SUB_CASE = "CASE doc_id % 5 " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(fixed.MANDATORY)) + " ELSE 'أخرى' END"


@query(f"""WITH c AS (SELECT doc_id, coalesce(text, '') || ' ' || {_KIND_CASE} AS t FROM documents), n AS (SELECT *, lower(trim(regexp_replace(regexp_replace(translate(t, 'أإآٱةى', 'ااااهي'), '[\\x{{064B}}-\\x{{065F}}]', '', 'g'), '[ \\t\\n\\r]+', ' ', 'g'))) AS n FROM c)
SELECT doc_id, CASE WHEN contains(t, 'وعد بالبيع') THEN 'وعد بالبيع' WHEN contains(n, 'وكاله') THEN 'وكالة عقارية' WHEN contains(t, 'بيع') AND contains(t, 'مبني') THEN 'بيع عقار مبني'
 WHEN contains(t, 'بيع') AND {_has('ارض', 'قطعه', 'فلاح', c='n')} THEN 'بيع أرض' WHEN contains(t, 'بيع') AND {_has('ابقار', 'ماشيه', 'بومنيار', c='n')} THEN 'بيع منقول' WHEN contains(t, 'بيع') THEN 'بيع عقاري'
 WHEN {_has('كراء', 'تسويغ', c='t')} OR contains(n, 'ايجار') THEN CASE WHEN {_has('سكني', 'سكنى', 'مسكن', c='t')} THEN 'كراء سكني' WHEN {_has('تجاري', 'تجارة', 'محل', c='t')} THEN 'كراء تجاري' WHEN {_has('مهني', 'مكتب', 'شركة', c='t')} THEN 'كراء مهني' ELSE 'كراء مختلط' END
 ELSE 'عقد غير مصنف' END AS kind FROM n""")
def contract_types(spark, sf_dir):
    t = F.concat(F.coalesce("text", F.lit("")), F.lit(" "), F.expr(_KIND_CASE))
    return read(spark, sf_dir, "documents").select("doc_id", extract.contract_type(t)[0].alias("kind"))


_CLAUSE_TEXT = "concat(coalesce(text, ''), " + ", ".join(f"CASE WHEN (doc_id * 7 + {i}) % 4 = 0 THEN ' {w}' ELSE '' END" for i, w in enumerate(_WORDS)) + ")"
_CLAUSE_LIST = ", ".join(f"CASE WHEN {_has(*ws, c='t')} THEN '{k}' END" for k, ws in fixed.CLAUSES.items())
_MUST_CASE = "CASE sub " + " ".join(f"WHEN '{k}' THEN [{', '.join(repr(x) for x in v)}]" for k, v in fixed.MANDATORY.items()) + f" ELSE [{', '.join(repr(x) for x in fixed.MANDATORY[fixed.LEASE])}] END"


@query(f"""WITH c AS (SELECT doc_id, {_SUB_CASE} AS sub, {_CLAUSE_TEXT} AS t FROM documents), p AS (SELECT doc_id, {_MUST_CASE} AS must, list_filter([{_CLAUSE_LIST}], lambda x: x IS NOT NULL) AS present FROM c)
SELECT doc_id, array_to_string(present, ',') AS present, array_to_string(list_filter(must, lambda x: NOT list_contains(present, x)), ',') AS missing FROM p""")
def contract_clauses(spark, sf_dir):
    c = read(spark, sf_dir, "documents").select("doc_id", F.expr(_SUB_CASE).alias("sub"), F.expr(_CLAUSE_TEXT).alias("t"))
    shown = [F.when(text.contains_any(F.col("t"), ws), k).alias(f"c{i}") for i, (k, ws) in enumerate(fixed.CLAUSES.items())]
    c = c.select("doc_id", "sub", F.filter(F.array(*shown), lambda x: x.isNotNull()).alias("present"))
    must = F.coalesce(*[F.when(F.col("sub") == k, F.array(*map(F.lit, v))) for k, v in fixed.MANDATORY.items()], F.array(*map(F.lit, fixed.MANDATORY[fixed.LEASE])))
    return c.select("doc_id", F.array_join("present", ",").alias("present"), F.array_join(F.array_except(must, "present"), ",").alias("missing"))


@query(f"""WITH r(y, q, rate) AS (VALUES {_RATE_ROWS}) SELECT o_orderkey, coalesce(r.rate, 7.0)::DOUBLE AS rate FROM orders LEFT JOIN r ON r.y = year(o_orderdate) + 24 AND r.q = quarter(o_orderdate)""")
def quarter_rate(spark, sf_dir):
    r = spark.createDataFrame([(*k, x) for k, x in fixed.RATES.items()], "y int, q int, rate double")
    o = read(spark, sf_dir, "orders").select("o_orderkey", (F.year("o_orderdate") + 24).alias("y"), F.quarter("o_orderdate").alias("q"))
    return o.join(F.broadcast(r), ["y", "q"], "left").select("o_orderkey", F.coalesce("rate", F.lit(7.0)).alias("rate"))  # one row a quarter


_U = "('0x' || substring(md5(concat_ws('-', {}::VARCHAR, 'tier')), 1, 8))::BIGINT / 4294967296.0"


@query(f"""WITH t AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_returnflag AS g, CASE WHEN (l_orderkey * 10 + l_linenumber) % 10 < CASE l_returnflag WHEN 'R' THEN 2 WHEN 'A' THEN 5 ELSE 8 END THEN NULL ELSE l_extendedprice END AS x FROM lineitem),
s AS (SELECT g, count(*) AS n, count(x) AS known, median(x) AS m FROM t GROUP BY 1), d AS (SELECT g, x AS donor, row_number() OVER (PARTITION BY g ORDER BY substring(md5(id::VARCHAR), 1, 3), id) - 1 AS slot FROM t WHERE x IS NOT NULL)
SELECT id, round(coalesce(x, CASE WHEN 1 - known / n <= 0.6 THEN m ELSE donor END), 4)::DOUBLE AS filled FROM (SELECT t.*, s.n, s.known, s.m, floor({_U.format('id')} * s.known)::BIGINT AS slot FROM t JOIN s USING (g)) LEFT JOIN d USING (g, slot)""")
def rate_tiered_impute(spark, sf_dir):
    """Missing values of a group: its median up to a rate of 0.6, else drawn from its known values."""
    li = read(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_returnflag").alias("g"), "l_extendedprice")
    gone = F.when(F.col("g") == "R", 2).when(F.col("g") == "A", 5).otherwise(8)
    t = li.select("id", "g", F.when(F.col("id") % 10 >= gone, F.col("l_extendedprice")).alias("x"))
    return impute.rate_tiered(t, "g", "id", "x", "tier", "filled").select("id", F.round("filled", 4).alias("filled"))


@query("""WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_totalprice END AS a, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_custkey END AS b FROM orders)
SELECT o_orderkey, coalesce(a, (SELECT median(a) FROM o)) AS a, coalesce(b, (SELECT median(b) FROM o))::DOUBLE AS b FROM o""")
def medians_everywhere(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_totalprice")).alias("a"), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_custkey")).alias("b"))
    return impute.filled_with_medians(o, ["a", "b"])


@query("SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ')[1:9] AS title FROM part")
def title_cut(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", F.substring(F.initcap("p_name"), 1, 9).alias("title"))
