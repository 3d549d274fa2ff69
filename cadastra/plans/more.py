"""Further queries: place deduplication, tiered lookups, period and score rules, extraction, enrichment."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cadastra.functions import dates, text
from cadastra.operators import dedup, impute, lookup, scoring
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


@query(r"WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]+') AS w FROM documents), p AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM w), f AS (SELECT doc_id, x, min(i) AS i FROM p GROUP BY 1, 2) SELECT doc_id, md5(coalesce(string_agg(x, ' ' ORDER BY i) FILTER (WHERE x IS NOT NULL), '')) AS words, count(x)::INT AS n FROM (SELECT w.doc_id, f.x, f.i FROM w LEFT JOIN f ON f.doc_id = w.doc_id) GROUP BY doc_id")
def array_order_distinct(spark, sf_dir):
    w = F.array_distinct(F.coalesce(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), F.lit(1)), F.array().cast("array<string>")))
    d = read(spark, sf_dir, "documents").select("doc_id", w.alias("w"))
    return d.select("doc_id", F.md5(F.array_join("w", " ")).alias("words"), F.size("w").alias("n"))


@query("SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY lower(event_type), user_id ORDER BY event_id) AS r FROM events) WHERE r = 1")
def place_dedup(spark, sf_dir):
    return dedup.keep_first(read(spark, sf_dir, "events"), [F.lower("event_type"), F.col("user_id")], [F.col("event_id")]).select("event_id")


@query("SELECT o_custkey, arg_min(p, o_orderkey) AS first_priority FROM (SELECT o_custkey, o_orderkey, nullif(o_orderpriority, '1-URGENT') AS p FROM orders) WHERE p IS NOT NULL GROUP BY 1")
def first_non_null(spark, sf_dir):
    o = read(spark, sf_dir, "orders").withColumn("p", F.nullif("o_orderpriority", F.lit("1-URGENT"))).filter("p IS NOT NULL")
    return o.groupBy("o_custkey").agg(F.min_by("p", "o_orderkey").alias("first_priority"))


@query(f"WITH {LISTINGS} SELECT nation, round(avg(unit_price), 3) AS mean_price FROM listings GROUP BY 1 ORDER BY avg(unit_price) DESC, nation LIMIT 5")
def best_groups(spark, sf_dir):
    g = listings(spark, sf_dir).groupBy("nation").agg(F.avg("unit_price").alias("m"))
    return g.orderBy(F.desc("m"), "nation").limit(5).select("nation", F.round("m", 3).alias("mean_price"))


@query("SELECT count(*)::BIGINT AS n, count(DISTINCT user_id)::BIGINT AS users, count(DISTINCT event_type)::BIGINT AS types, count(DISTINCT date_trunc('day', ts))::BIGINT AS days FROM events")
def dataset_metadata(spark, sf_dir):
    return read(spark, sf_dir, "events").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users"), F.count_distinct("event_type").alias("types"), F.count_distinct(F.to_date("ts")).alias("days"))


@query("WITH g AS (SELECT c_nationkey, avg(c_acctbal) AS score FROM customer GROUP BY 1) SELECT r_name, round(avg(score), 4) AS score, count(*)::BIGINT AS nations FROM g JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def region_rollup(spark, sf_dir):
    g = read(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.avg("c_acctbal").alias("score"))
    n, r = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    g = g.join(lookup.dimension(n), g.c_nationkey == n.n_nationkey).join(lookup.dimension(r), F.col("n_regionkey") == F.col("r_regionkey"))
    return g.groupBy("r_name").agg(F.round(F.avg("score"), 4).alias("score"), F.count(F.lit(1)).alias("nations"))


@query("SELECT event_type, count_if(value > 50)::BIGINT AS high, count_if(value BETWEEN 10 AND 50)::BIGINT AS mid, count_if(value < 10 OR value IS NULL)::BIGINT AS low FROM events GROUP BY 1")
def conditional_counts(spark, sf_dir):
    v = F.col("value")
    return read(spark, sf_dir, "events").groupBy("event_type").agg(F.count_if(v > 50).alias("high"), F.count_if(v.between(10, 50)).alias("mid"), F.count_if((v < 10) | v.isNull()).alias("low"))


_OWN, _WIDE = [(1, 10.5), (4, 20.25), (9, 30.75)], [(0, 1.5), (2, 2.5)]


@query("SELECT s_suppkey, coalesce(own, wide, 9.0)::DOUBLE AS lat FROM supplier JOIN nation ON s_nationkey = n_nationkey LEFT JOIN (VALUES " + ", ".join(map(str, _OWN)) + ") a(k, own) ON a.k = s_nationkey LEFT JOIN (VALUES " + ", ".join(map(str, _WIDE)) + ") b(k, wide) ON b.k = n_regionkey")
def tiered_lookup(spark, sf_dir):
    own, wide = spark.createDataFrame(_OWN, "s_nationkey int, own double"), spark.createDataFrame(_WIDE, "n_regionkey int, wide double")
    s = read(spark, sf_dir, "supplier").join(lookup.dimension(read(spark, sf_dir, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))
    s = s.join(lookup.dimension(own), "s_nationkey", "left").join(lookup.dimension(wide), "n_regionkey", "left")
    return s.select("s_suppkey", F.coalesce("own", "wide", F.lit(9.0)).alias("lat"))


@query("SELECT o_orderkey, greatest(date_diff('day', CASE WHEN o_orderdate < TIMESTAMP '1996-01-01' OR o_orderdate > TIMESTAMP '2001-01-01' THEN TIMESTAMP '2001-01-01' ELSE o_orderdate END, TIMESTAMP '2001-01-01'), 0)::INT AS days FROM orders")
def days_on_market(spark, sf_dir):
    at, d = F.lit("2001-01-01").cast("timestamp"), F.col("o_orderdate").cast("timestamp")
    valid = F.when((d < F.lit("1996-01-01").cast("timestamp")) | (d > at), at).otherwise(d)
    return read(spark, sf_dir, "orders").select("o_orderkey", F.greatest(F.datediff(at, valid), F.lit(0)).alias("days"))


@query("WITH m AS (SELECT month(o_orderdate)::INT AS m, count(*) AS n FROM orders GROUP BY 1) SELECT m, n::BIGINT AS n, n > (SELECT median(n) FROM m) AS high_season FROM m")
def high_season_from_data(spark, sf_dir):
    m = read(spark, sf_dir, "orders").groupBy(F.month("o_orderdate").alias("m")).agg(F.count(F.lit(1)).alias("n"))
    return m.withColumn("high_season", F.col("n") > F.median("n").over(every()))


#: Links of pictures of seven forms, from the md5 of an event's number: with an expiry, in capitals, short of a digit, with other letters, without it, empty, null.
LINK = """CASE event_id % 7
 WHEN 0 THEN concat('https://cdn.example/v/a.jpg?oh=00_', h, '&oe=6', substring(h, 1, 7), '&_nc=1')
 WHEN 1 THEN concat('https://cdn.example/b.png?oe=5', upper(substring(h, 3, 7)))
 WHEN 2 THEN concat('https://cdn.example/c.png?oe=', substring(h, 1, 5))
 WHEN 3 THEN concat('https://cdn.example/d.png?oe=zz', h)
 WHEN 4 THEN 'https://cdn.example/e.png'
 WHEN 5 THEN '' END"""


@query(f"WITH l AS (SELECT event_id, {LINK} AS link FROM (SELECT event_id, md5(event_id::VARCHAR) AS h FROM events)), x AS (SELECT event_id, nullif(regexp_extract(link, 'oe=([0-9A-Fa-f]{{8}})', 1), '') AS code FROM l) SELECT event_id, make_timestamp((('0x' || lower(code))::BIGINT - 90 * 86400) * 1000000) AS published FROM x")
def hex_epoch_dates(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("event_id", F.md5(F.col("event_id").cast("string")).alias("h"))
    return e.select("event_id", dates.from_expiry(F.expr(LINK)).cast("timestamp_ntz").alias("published"))


#: Paths of pictures of seven forms, from an order's number: with a month, with a month that is none, without a day's folder, and others.
PATH = """CASE o_orderkey % 7
 WHEN 0 THEN concat('https://x.example/wp/uploads/', y, '/', m, '/a-300x200.jpg')
 WHEN 1 THEN concat('/uploads/', y, '/', m, '/uploads/1999/12/b.jpg')
 WHEN 2 THEN concat('/uploads/', y, '/13/c.jpg')
 WHEN 3 THEN concat('/uploads/', y, '/00/d.jpg')
 WHEN 4 THEN concat('/uploads/', y, '-', m, '/e.jpg')
 WHEN 5 THEN '' END"""
PATH_PARTS = {"y": "CAST(2015 + o_custkey % 11 AS STRING)", "m": "lpad(CAST(1 + o_orderkey % 12 AS STRING), 2, '0')"}


@query(f"WITH p AS (SELECT o_orderkey, {PATH} AS p FROM (SELECT *, {PATH_PARTS['y']} AS y, {PATH_PARTS['m']} AS m FROM orders)) SELECT o_orderkey, try_strptime(regexp_extract(p, '/uploads/([0-9]{{4}}/[0-9]{{2}})/', 1) || '/01', '%Y/%m/%d') AS uploaded FROM p")
def path_dates(spark, sf_dir):
    o = read(spark, sf_dir, "orders").withColumns({n: F.expr(e) for n, e in PATH_PARTS.items()})
    return o.select("o_orderkey", dates.from_path(F.expr(PATH)).cast("timestamp_ntz").alias("uploaded"))


@query("""WITH s AS (SELECT p_partkey, least(100, round(least(p_size * 11, 500) / 500.0 * 60 + (p_partkey % 6) / 5.0 * 30 + CASE WHEN p_partkey % 2 = 0 THEN 10 ELSE 0 END, 0))::INT AS score FROM part)
SELECT p_partkey, score, CASE WHEN score >= 70 THEN 'very high' WHEN score >= 50 THEN 'high' WHEN score >= 30 THEN 'medium' WHEN score >= 15 THEN 'low' ELSE 'very low' END AS band FROM s""")
def activity_score(spark, sf_dir):
    reviews = F.least(F.col("p_size") * 11, F.lit(500)) / 500 * 60
    score = F.least(F.lit(100), F.round(reviews + F.col("p_partkey") % 6 / 5 * 30 + F.when(F.col("p_partkey") % 2 == 0, 10).otherwise(0), 0).cast("int"))
    band = F.when(score >= 70, "very high").when(score >= 50, "high").when(score >= 30, "medium").when(score >= 15, "low").otherwise("very low")
    return read(spark, sf_dir, "part").select("p_partkey", score.alias("score"), band.alias("band"))


@query("SELECT doc_id, round(((text IS NOT NULL)::INT + (lang <> 'en')::INT + (n_chars > 100)::INT + (source IS NOT NULL)::INT) / 4, 4)::DOUBLE AS completeness FROM documents")
def completeness_score(spark, sf_dir):
    filled = [F.col("text").isNotNull(), F.col("lang") != "en", F.col("n_chars") > 100, F.col("source").isNotNull()]
    return read(spark, sf_dir, "documents").select("doc_id", F.round(sum((x.cast("int") for x in filled), F.lit(0)) / len(filled), 4).alias("completeness"))


_CODES = {"en": 1, "fr": 2, "es": 3}


@query("SELECT doc_id, CASE lang WHEN 'en' THEN 1 WHEN 'fr' THEN 2 WHEN 'es' THEN 3 ELSE 9 END AS code FROM documents")
def label_encode_default(spark, sf_dir):
    codes = F.create_map(*[F.lit(x) for kv in _CODES.items() for x in kv])
    return read(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.try_element_at(codes, F.col("lang")), F.lit(9)).alias("code"))


_KINDS = {"Appartement": ["standard", "medium"], "Villa": ["large"], "Terrain": ["economy", "promo"]}


@query("SELECT p_partkey, CASE WHEN contains(lower(p_type), 'standard') OR contains(lower(p_type), 'medium') THEN 'Appartement' WHEN contains(lower(p_type), 'large') THEN 'Villa' WHEN contains(lower(p_type), 'economy') OR contains(lower(p_type), 'promo') THEN 'Terrain' WHEN p_size > 25 THEN 'Ferme' ELSE 'Divers' END AS kind FROM part")
def property_type_rules(spark, sf_dir):
    kind = F.coalesce(text.first_match(F.lower("p_type"), _KINDS, None), F.when(F.col("p_size") > 25, "Ferme"), F.lit("Divers"))
    return read(spark, sf_dir, "part").select("p_partkey", kind.alias("kind"))


@query("""WITH c AS (SELECT c_custkey, c_nationkey, n_regionkey, c_acctbal FROM customer JOIN nation ON c_nationkey = n_nationkey), r AS (SELECT n_regionkey, median(c_acctbal) AS m FROM c GROUP BY 1)
SELECT c_custkey, round(CASE WHEN count(*) OVER (PARTITION BY c_nationkey) < 6 THEN m ELSE c_acctbal END, 4) AS price FROM c JOIN r USING (n_regionkey)""")
def small_sample_fallback(spark, sf_dir):
    c = read(spark, sf_dir, "customer").join(lookup.dimension(read(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    few = c.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"))
    wide = impute.group_medians(c, ["n_regionkey"], "c_acctbal", "m")
    c = c.join(lookup.dimension(few), "c_nationkey").join(lookup.dimension(wide), "n_regionkey")
    return c.select("c_custkey", F.round(F.when(F.col("n") < 6, F.col("m")).otherwise(F.col("c_acctbal")), 4).alias("price"))


@query("SELECT c_custkey, CASE WHEN c_acctbal < 2000 THEN 1 WHEN c_acctbal < 4000 THEN 2 WHEN c_acctbal < 7000 THEN 3 ELSE 4 END AS density FROM customer")
def density_class(spark, sf_dir):
    b = F.col("c_acctbal")
    return read(spark, sf_dir, "customer").select("c_custkey", F.when(b < 2000, 1).when(b < 4000, 2).when(b < 7000, 3).otherwise(4).alias("density"))


@query("""WITH n AS (SELECT c_nationkey AS k, count(*) * 0.5 AS km FROM customer GROUP BY 1), d AS (SELECT n_nationkey, km / nullif(n_nationkey % 5 * 10, 0) AS density FROM nation LEFT JOIN n ON k = n_nationkey)
SELECT n_nationkey, round(coalesce(density, (SELECT avg(density) FROM d)), 5)::DOUBLE AS density FROM d""")
def road_density(spark, sf_dir):
    km = read(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("k")).agg((F.count(F.lit(1)) * 0.5).cast("double").alias("km"))
    n = read(spark, sf_dir, "nation").join(km, F.col("k") == F.col("n_nationkey"), "left")
    n = n.withColumn("d", F.try_divide(F.col("km"), (F.col("n_nationkey") % 5 * 10).cast("double")))
    return n.select("n_nationkey", F.round(F.coalesce("d", F.avg("d").over(every())), 5).alias("density"))


@query(r"SELECT doc_id, md5(trim(regexp_replace(regexp_replace(translate(text || ' أإآ ة ى مُدَّة', 'أإآٱةى', 'اااا' || 'هي'), '[\x{064B}-\x{065F}]', '', 'g'), '[ \t\n\r]+', ' ', 'g'))) AS normal FROM documents")
def arabic_normalise(spark, sf_dir):
    t = F.concat("text", F.lit(" أإآ ة ى مُدَّة"))
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(text.arabic(t)).alias("normal"))


@query(r"SELECT conv_id, turn, md5(trim(regexp_replace(regexp_replace('☎ ' || text, '\p{So}', '', 'g'), '[ \t\n\r]+', ' ', 'g'))) AS clean FROM conversations")
def symbol_strip(spark, sf_dir):
    t = F.regexp_replace(F.concat(F.lit("☎ "), F.col("text")), r"\p{So}", "")
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(F.trim(F.regexp_replace(t, "[ \t\n\r]+", " "))).alias("clean"))


#: Criteria of a part as lines of labels and values: repeated labels, lines without a value, values with a second colon, none, null.
CRITERIA = """CASE p_partkey % 5
 WHEN 0 THEN concat('brand : ', p_brand, '|size: ', CAST(p_size AS STRING), '|name: ', p_name)
 WHEN 1 THEN concat('size: 0|brand:', p_brand, '|no value|size:', CAST(p_size AS STRING))
 WHEN 2 THEN concat('brand: ', p_brand, ': ', p_type, '|size: n/a')
 WHEN 3 THEN '' END"""


@query(f"""WITH c AS (SELECT p_partkey, {CRITERIA} AS c FROM part), l AS (SELECT p_partkey, unnest(string_split(c, '|')) AS line, generate_subscripts(string_split(c, '|'), 1) AS i FROM c),
k AS (SELECT p_partkey, i, trim(split_part(line, ':', 1)) AS k, trim(split_part(line, ':', 2)) AS v FROM l WHERE len(string_split(line, ':')) = 2)
SELECT p_partkey, arg_max(v, i) FILTER (WHERE k = 'brand') AS brand, try_cast(arg_max(v, i) FILTER (WHERE k = 'size') AS INT) AS size FROM part LEFT JOIN k USING (p_partkey) GROUP BY 1""")
def label_value_map(spark, sf_dir):
    m = text.pairs(F.expr(CRITERIA), r"\|", ":")
    return read(spark, sf_dir, "part").select("p_partkey", F.try_element_at(m, F.lit("brand")).alias("brand"), F.try_element_at(m, F.lit("size")).try_cast("int").alias("size"))


@query(r"SELECT doc_id, len(regexp_extract_all(text, '[0-9]{3}[ .-][0-9]{4}'))::INT AS phones FROM documents")
def phone_counts(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.size(F.regexp_extract_all("text", F.lit("([0-9]{3}[ .-][0-9]{4})"), F.lit(1))).alias("phones"))


@query("WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 0 ELSE o_totalprice END AS x FROM orders) SELECT o_orderkey, round(coalesce(nullif(x, 0), (SELECT median(nullif(x, 0)) FROM o)), 4) AS score FROM o")
def zero_replacement(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 4 == 0, F.lit(0.0)).otherwise(F.col("o_totalprice")).alias("x"))
    o = o.withColumn("x", F.nullif("x", F.lit(0.0)))
    return impute.hierarchical(o, "x", [[]], "score").select("o_orderkey", F.round("score", 4).alias("score"))


_SUBJECTS = {"size": "SMALL|MEDIUM|LARGE", "price": "ECONOMY|PROMO", "plain": "STANDARD|MEDIUM"}


@query(" UNION ALL ".join(f"SELECT p_partkey, '{k}' AS subject FROM part WHERE regexp_matches(upper(p_type), '{p}')" for k, p in _SUBJECTS.items()))
def multi_label_routing(spark, sf_dir):
    found = F.array(*[F.when(F.upper("p_type").rlike(p), k) for k, p in _SUBJECTS.items()])
    return read(spark, sf_dir, "part").select("p_partkey", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("subject"))


@query("SELECT o_orderkey, least(o_orderkey % 8 + o_custkey % 5, 10)::INT AS gravity, CASE WHEN least(o_orderkey % 8 + o_custkey % 5, 10) >= 8 THEN 'CRITIQUE' WHEN least(o_orderkey % 8 + o_custkey % 5, 10) >= 5 THEN 'ÉLEVÉ' ELSE 'NORMALE' END AS alert FROM orders")
def rule_gravity(spark, sf_dir):
    g = F.least((F.col("o_orderkey") % 8 + F.col("o_custkey") % 5).cast("int"), F.lit(10))
    return read(spark, sf_dir, "orders").select("o_orderkey", g.alias("gravity"), F.when(g >= 8, "CRITIQUE").when(g >= 5, "ÉLEVÉ").otherwise("NORMALE").alias("alert"))


@query("SELECT doc_id, coalesce(nullif(CASE WHEN doc_id % 3 = 0 THEN '' ELSE lang END, ''), CASE WHEN contains(text, 'é') THEN 'fr' ELSE 'en' END) AS lang FROM documents")
def enrich_blank_only(spark, sf_dir):
    given = F.nullif(F.when(F.col("doc_id") % 3 == 0, F.lit("")).otherwise(F.col("lang")), F.lit(""))
    return read(spark, sf_dir, "documents").select("doc_id", F.coalesce(given, F.when(F.col("text").contains("é"), "fr").otherwise("en")).alias("lang"))


@query("SELECT 'orders' AS family, o_orderpriority AS series, count(*)::DOUBLE AS value FROM orders GROUP BY 2 UNION ALL SELECT 'parts', p_brand, round(avg(p_retailprice), 4) FROM part GROUP BY 2 UNION ALL SELECT 'events', event_type, count(*)::DOUBLE FROM events GROUP BY 2")
def indicator_union(spark, sf_dir):
    o = read(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("series")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    p = read(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("series")).agg(F.round(F.avg("p_retailprice"), 4).alias("value"))
    e = read(spark, sf_dir, "events").groupBy(F.col("event_type").alias("series")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    out = [d.select(F.lit(k).alias("family"), "series", "value") for k, d in (("orders", o), ("parts", p), ("events", e))]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query(r"""WITH w AS (SELECT doc_id, n_chars, (contains(lower(text), 'the ')::INT + contains(lower(text), 'und ')::INT + contains(lower(text), 'que ')::INT) AS flags, list_filter(regexp_split_to_array(lower(text), '[ \t\n\r\f\x0B]+'), lambda x: x <> '') AS w FROM documents)
SELECT doc_id, round(0.35 * flags / 3 + 0.25 * least(n_chars / 2000, 1) + 0.20 * least(n_chars / 500, 1) + 0.15 * flags / 12 + 0.05 * CASE WHEN len(w) > 5 THEN len(list_distinct(w)) / len(w) ELSE 0.3 END, 4)::DOUBLE AS text_score FROM w""")
def text_score(spark, sf_dir):
    t, n = F.lower("text"), F.col("n_chars")
    flags = text.hits(t, ["the ", "und ", "que "])
    score = 0.35 * flags / 3 + 0.25 * F.least(n / 2000, F.lit(1.0)) + 0.20 * F.least(n / 500, F.lit(1.0)) + 0.15 * flags / 12 + 0.05 * text.richness(F.col("text"))
    return read(spark, sf_dir, "documents").select("doc_id", F.round(score, 4).alias("text_score"))


@query("SELECT page_id, len(string_split(html, '<h2'))::INT - 1 AS sections, len(regexp_extract_all(html, '<td'))::INT AS cells, length(regexp_replace(html, '<[^>]*>', '', 'g'))::INT AS text_chars FROM pages")
def html_sections(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", (F.size(F.split("html", "<h2")) - 1).alias("sections"), F.regexp_count("html", F.lit("<td")).alias("cells"), F.length(F.regexp_replace("html", "<[^>]*>", "")).alias("text_chars"))


@query("""WITH g AS (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1) SELECT n_nationkey, round(coalesce(n, 0) / max(n) OVER (), 4)::DOUBLE AS norm, round(ln(1 + coalesce(n, 0)), 4)::DOUBLE AS log_n FROM nation LEFT JOIN g ON k = n_nationkey""")
def max_norm(spark, sf_dir):
    g = read(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    n = read(spark, sf_dir, "nation").join(g, F.col("k") == F.col("n_nationkey"), "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return n.select("n_nationkey", F.round(F.col("n") / F.max("n").over(every()), 4).alias("norm"), F.round(F.log1p("n"), 4).alias("log_n"))


@query(f"""WITH {LISTINGS}, w AS (SELECT nation, count(*) AS n FROM listings GROUP BY 1), t AS (SELECT year(published)::INT AS y, count(*) AS n FROM listings GROUP BY 1),
a AS (SELECT l_orderkey, l_linenumber, greatest(least((SELECT avg(n) FROM w) / w.n * (SELECT avg(n) FROM t) / t.n, 6), 0.1) AS x FROM listings JOIN w USING (nation) JOIN t ON t.y = year(published))
SELECT l_orderkey, l_linenumber, round(x / avg(x) OVER (), 5) AS weight FROM a""")
def combined_weights(spark, sf_dir):
    li = listings(spark, sf_dir).withColumn("y", F.year("published"))
    a = li.groupBy("nation").agg(F.count(F.lit(1)).alias("n")).select("nation", (F.avg("n").over(every()) / F.col("n")).alias("wa"))
    b = li.groupBy("y").agg(F.count(F.lit(1)).alias("n")).select("y", (F.avg("n").over(every()) / F.col("n")).alias("wb"))
    li = li.join(lookup.dimension(a), "nation").join(lookup.dimension(b), "y").withColumn("x", scoring.clip(F.col("wa") * F.col("wb"), 0.1, 6.0))
    mean = li.agg(F.avg("x").alias("mean"))
    return li.join(F.broadcast(mean), how="cross").select("l_orderkey", "l_linenumber", F.round(F.col("x") / F.col("mean"), 5).alias("weight"))
