"""Queries of the text, date, rule and streaming-like operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cadastra.functions import dates, fixed, text
from cadastra.plans.tables import read

QUERIES: dict = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


@query(r"SELECT doc_id, md5(coalesce(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[^\x00-\x7F]', '', 'g'), '[\x00-\x1F\x7F]', ' ', 'g'), '[^A-Za-z0-9 .,;:!?''()/+%&@-]', '', 'g'), ' +', ' ', 'g')), '')) AS clean FROM documents")
def noise_strip(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(F.coalesce(text.strip_noise(F.col("text")), F.lit(""))).alias("clean"))


@query("SELECT page_id, try_cast(nullif(regexp_replace(replace(regexp_extract(html, '([0-9][0-9.,]*)', 1), ',', '.'), '[^0-9.]', '', 'g'), '') AS DOUBLE) AS n FROM pages")
def numeric_parse(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", text.number(F.regexp_extract("html", r"([0-9][0-9.,]*)", 1)).alias("n"))


#: Words of the test tables' invented prose that stand in for the amenity words.
FLAGS = {"the": ["the ", "of "], "und": ["und ", "der "], "que": ["que ", "los "], "les": ["les ", "des "]}


@query("SELECT doc_id, " + ", ".join(f"({' OR '.join(f'contains(lower(text), {w!r})' for w in ws)}) AS has_{k}" for k, ws in (FLAGS | fixed.AMENITIES).items()) + " FROM documents")
def keyword_flags(spark, sf_dir):
    t = F.lower("text")
    return read(spark, sf_dir, "documents").select("doc_id", *[text.contains_any(t, ws).alias(f"has_{k}") for k, ws in (FLAGS | fixed.AMENITIES).items()])


def _sum(words, c="t"):
    return " + ".join(f"contains({c}, {chr(39)}{w}{chr(39)})::INT" for w in words)


@query(f"""WITH v AS (SELECT conv_id, turn, lower(text) AS t FROM conversations), n AS (SELECT conv_id, turn, ({_sum([*fixed.RENT_WORDS, 'the ', 'of '])})::INT AS rent, ({_sum([*fixed.SALE_WORDS, 'and ', 'to '])})::INT AS sale FROM v)
SELECT conv_id, turn, rent, sale, CASE WHEN rent > sale THEN 1 WHEN sale > rent THEN 2 ELSE 0 END AS transaction_type FROM n""")
def keyword_votes(spark, sf_dir):
    t = F.lower("text")
    n = read(spark, sf_dir, "conversations").select("conv_id", "turn", text.hits(t, [*fixed.RENT_WORDS, "the ", "of "]).alias("rent"), text.hits(t, [*fixed.SALE_WORDS, "and ", "to "]).alias("sale"))
    return n.withColumn("transaction_type", F.when(F.col("rent") > F.col("sale"), 1).when(F.col("sale") > F.col("rent"), 2).otherwise(0))


THEMES = [(["the", "of", "and", "was"], 0.25), (["ing", "tion", "able"], 0.2), (["und", "der", "die"], 0.15), (["que", "los"], 0.4)]


@query("SELECT doc_id, round(least(" + " + ".join(f"least(({_sum(ws, 'lower(text)')}) / {max(0.3 * len(ws), 1.0)}::DOUBLE, 1.0) * {w}::DOUBLE" for ws, w in THEMES) + ", 1.0), 4)::DOUBLE AS theme FROM documents")
def theme_score(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", text.theme_score(F.lower("text"), THEMES).alias("theme"))


@query(r"WITH w AS (SELECT doc_id, n_chars, list_filter(regexp_split_to_array(lower(text), '[ \t\n\r\f\x0B]+'), lambda x: x <> '') AS w FROM documents) SELECT doc_id, len(w)::INT AS n_words, round(CASE WHEN len(w) > 5 THEN len(list_distinct(w)) / len(w) ELSE 0.3 END, 6)::DOUBLE AS richness, round(least(n_chars / 500, 1.0), 6)::DOUBLE AS length_score FROM w")
def lexical_richness(spark, sf_dir):
    c = F.col("text")
    return read(spark, sf_dir, "documents").select("doc_id", F.size(text.words(c)).alias("n_words"), F.round(text.richness(c), 6).alias("richness"), F.round(F.least(F.col("n_chars") / 500, F.lit(1.0)), 6).alias("length_score"))


_ORDER = sorted(fixed.PHRASES, key=len, reverse=True)
_LISTED = "text || CASE doc_id % 6 WHEN 0 THEN ' Dar El Baraka, pieds dans l eau' WHEN 1 THEN ' VUE PANORAMIQUE LAC s+3 résidence fermée' WHEN 2 THEN ' entièrement rénové, bord de mer, urgent' WHEN 3 THEN ' haouma et houma, rdc' ELSE '' END"


@query(f"SELECT doc_id, md5({'replace(' * len(_ORDER)}translate(lower(trim({_LISTED})), '{fixed.ACCENTED}', '{fixed.PLAIN}')" + "".join(f", '{k}', '{fixed.PHRASES[k]}')" for k in _ORDER) + ") AS phrases FROM documents")
def phrase_normalise(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(text.replace_phrases(text.fold_accents(F.trim(F.expr(_LISTED))), fixed.PHRASES)).alias("phrases"))


@query("SELECT p_partkey, concat_ws(' ', p_name, lower(p_type), p_brand, CASE WHEN p_size <= 10 THEN 'small' WHEN p_size <= 30 THEN 'medium' ELSE 'large' END, CASE WHEN p_retailprice > 1000 THEN 'premium' END) AS rich FROM part")
def rich_text_concat(spark, sf_dir):
    size = F.when(F.col("p_size") <= 10, "small").when(F.col("p_size") <= 30, "medium").otherwise("large")
    return read(spark, sf_dir, "part").select("p_partkey", F.concat_ws(" ", "p_name", F.lower("p_type"), "p_brand", size, F.when(F.col("p_retailprice") > 1000, "premium")).alias("rich"))


_ADS = "'s+' || (p_size % 4) || ' ' || p_name, p_size || ' chambres', 'f' || (p_size % 5) || ' ' || p_name, 'studio ' || p_name, p_name"
_AD = f"CASE p_partkey % 5 {' '.join(f'WHEN {i} THEN {a}' for i, a in enumerate(_ADS.split(', ')))} END"


@query(f"""WITH a AS (SELECT p_partkey, lower({_AD}) AS t FROM part) SELECT p_partkey, coalesce(try_cast(nullif(regexp_extract(t, 's ?\\+ ?([0-9]+)', 1), '') AS INT) + 1, try_cast(nullif(regexp_extract(t, '([0-9]+) ?pi[eè]ces?', 1), '') AS INT), try_cast(nullif(regexp_extract(t, '([0-9]+) ?chambres?', 1), '') AS INT),
try_cast(nullif(regexp_extract(t, '(?:^|[^a-z])[ft]([0-9])(?:[^0-9]|$)', 1), '') AS INT), CASE WHEN contains(t, 'studio') THEN 1 END, try_cast(nullif(regexp_extract(t, '([0-9]+) ?pic', 1), '') AS INT)) AS rooms FROM a""")
def rooms_regex_rules(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", text.rooms(F.expr(_AD)).alias("rooms"))


@query("SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, len(regexp_extract_all(html, '<a '))::INT AS links, len(regexp_extract_all(html, '<h[1-6]'))::INT AS headings FROM pages")
def html_extract(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.regexp_count("html", F.lit("<a ")).alias("links"), F.regexp_count("html", F.lit("<h[1-6]")).alias("headings"))


@query("SELECT page_id, string_split(url, '/')[3] AS host, len(string_split(url, '/'))::INT AS parts, string_split(url, '/')[-1] AS last FROM pages")
def url_path_parts(spark, sf_dir):
    p = F.split("url", "/")
    return read(spark, sf_dir, "pages").select("page_id", F.get(p, F.lit(2)).alias("host"), F.size(p).alias("parts"), F.element_at(p, -1).alias("last"))


@query(f"SELECT doc_id, md5(translate(lower(text), '{fixed.ACCENTED}', '{fixed.PLAIN}')) AS folded FROM documents")
def accent_fold(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(text.fold_accents(F.col("text"))).alias("folded"))


@query("SELECT o_orderkey, year(o_orderdate)::INT AS y, month(o_orderdate)::INT AS m, quarter(o_orderdate)::INT AS q, (CASE WHEN month(o_orderdate) <= 6 THEN 1 ELSE 2 END)::INT AS semester, (month(o_orderdate) BETWEEN 6 AND 8)::INT AS high_season, strftime(o_orderdate, '%Y-%m') AS period FROM orders")
def date_parts_season(spark, sf_dir):
    d, m = F.col("o_orderdate"), F.month("o_orderdate")
    return read(spark, sf_dir, "orders").select("o_orderkey", F.year(d).alias("y"), m.alias("m"), F.quarter(d).alias("q"), F.when(m <= 6, 1).otherwise(2).alias("semester"), m.between(6, 8).cast("int").alias("high_season"), F.date_format(d, "yyyy-MM").alias("period"))


_LAYOUTS = [("%d/%m/%Y %H:%M", "dd/MM/yyyy HH:mm"), ("%d/%m/%Y", "dd/MM/yyyy"), ("%Y-%m-%d %H:%M:%S", "yyyy-MM-dd HH:mm:ss"), ("%Y-%m-%d %H:%M", "yyyy-MM-dd HH:mm"), ("%Y-%m-%d", "yyyy-MM-dd"), ("%d-%m-%Y", "dd-MM-yyyy"), ("%Y/%m/%d", "yyyy/MM/dd"), ("%d.%m.%Y", "dd.MM.yyyy")]
_TEXT_DATE = "CASE o_orderkey % 9 " + " ".join(f"WHEN {i} THEN strftime(o_orderdate, '{a}')" for i, (a, _) in enumerate(_LAYOUTS)) + " ELSE 'soon' END"


@query(f"WITH t AS (SELECT o_orderkey, {_TEXT_DATE} AS t FROM orders) SELECT o_orderkey, coalesce({', '.join(f"try_strptime(t, '{a}')" for a, _ in _LAYOUTS)}) AS parsed FROM t")
def multi_format_dates(spark, sf_dir):
    t = F.lit("soon")
    for i, (_, layout) in enumerate(_LAYOUTS):
        t = F.when(F.col("o_orderkey") % 9 == i, F.date_format("o_orderdate", layout)).otherwise(t)
    return read(spark, sf_dir, "orders").select("o_orderkey", dates.parse(t).cast("timestamp_ntz").alias("parsed"))


@query("SELECT o_orderkey, (CASE o_orderkey % 3 WHEN 0 THEN o_orderdate - to_days((o_orderkey % 9)::INT) WHEN 1 THEN o_orderdate - to_days((30 * (o_orderkey % 9))::INT) ELSE o_orderdate - to_hours(o_orderkey % 9) END)::TIMESTAMP AS published FROM orders")
def relative_dates(spark, sf_dir):
    k = F.col("o_orderkey") % 3
    label = F.concat_ws(" ", (F.col("o_orderkey") % 9).cast("string"), F.when(k == 0, "days").when(k == 1, "months").otherwise("hours"), F.lit("ago"))
    return read(spark, sf_dir, "orders").select("o_orderkey", dates.relative(label, F.col("o_orderdate")).cast("timestamp_ntz").alias("published"))


COVER = {"parties": ["the ", "les ", "los "], "term": ["tion", "ción"], "price": ["1", "5"], "transfer": ["und ", "et "], "notice": ["@", "+1"]} | fixed.CLAUSES
MANDATORY = ["parties", "term", "price"]


@query("WITH f AS (SELECT doc_id, lower(text) AS t FROM documents), c AS (SELECT doc_id, list_filter([" + ", ".join(f"CASE WHEN {' OR '.join(f'contains(t, {chr(39)}{w}{chr(39)})' for w in ws)} THEN '{k}' END" for k, ws in COVER.items()) + "], lambda x: x IS NOT NULL) AS present FROM f) SELECT doc_id, array_to_string(present, ',') AS present, array_to_string(list_filter(['parties', 'term', 'price'], lambda x: NOT list_contains(present, x)), ',') AS missing FROM c")
def clause_coverage(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", F.lower("text").alias("t"))
    d = d.select("doc_id", F.filter(F.array(*[F.when(text.contains_any(F.col("t"), ws), k) for k, ws in COVER.items()]), lambda x: x.isNotNull()).alias("present"))
    missing = F.array_except(F.array(*[F.lit(k) for k in MANDATORY]), "present")
    return d.select("doc_id", F.array_join("present", ",").alias("present"), F.array_join(missing, ",").alias("missing"))


_CASES = " ".join(f"WHEN {' OR '.join(f'contains(t, {chr(39)}{w}{chr(39)})' for w in ws)} THEN '{k}'" for k, ws in fixed.LEGAL_LABELS.items())


@query(f"WITH f AS (SELECT doc_id, n_chars, lower(text) AS t FROM documents) SELECT doc_id, CASE {_CASES} ELSE '{fixed.LEGAL_DEFAULT}' END AS label, CASE WHEN n_chars % 11 <= 2 THEN 'Faible' WHEN n_chars % 11 <= 5 THEN 'Moyen' WHEN n_chars % 11 <= 8 THEN 'Élevé' ELSE 'Critique' END AS risk, CASE WHEN n_chars % 11 >= 9 THEN 'CRITIQUE' WHEN n_chars % 11 >= 5 THEN 'ÉLEVÉ' ELSE 'NORMALE' END AS alert FROM f")
def ordered_rule_label(spark, sf_dir):
    score = F.col("n_chars") % 11
    risk = F.when(score <= 2, "Faible").when(score <= 5, "Moyen").when(score <= 8, "Élevé").otherwise("Critique")
    alert = F.when(score >= 9, "CRITIQUE").when(score >= 5, "ÉLEVÉ").otherwise("NORMALE")
    return read(spark, sf_dir, "documents").select("doc_id", text.first_match(F.lower("text"), fixed.LEGAL_LABELS, fixed.LEGAL_DEFAULT).alias("label"), risk.alias("risk"), alert.alias("alert"))


@query("""WITH p AS (SELECT doc_id, text, string_split(text, 'tion') AS parts FROM documents), o AS (SELECT doc_id, text, unnest(list_transform(range(1, len(parts)), lambda i: list_sum(list_transform(parts[1:i], lambda x: length(x)))::BIGINT + (i - 1) * 4)) AS s, unnest(range(1, len(parts))) AS n FROM p)
SELECT doc_id, n::INT AS n, md5(substring(text, greatest(s - 150 + 1, 1), least(s, 150) + 4 + 500)) AS chunk FROM o""")
def kwic_chunks(spark, sf_dir):
    df = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(text.kwic(F.col("text"), "tion", 150, 500)).alias("i", "c"))
    return df.select("doc_id", (F.col("i") + 1).alias("n"), F.md5("c").alias("chunk"))


@query("SELECT event_id, try_cast(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_extract(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", F.from_json("props", "k long").k.alias("k"))


@query("SELECT date_trunc('day', ts)::TIMESTAMP AS day, event_type, count(*)::BIGINT AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def tumbling_window(spark, sf_dir):
    e = read(spark, sf_dir, "events").groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return e.select(F.col("w.start").cast("timestamp_ntz").alias("day"), "event_type", "n", "total")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts)::TIMESTAMP AS began, count(*)::BIGINT AS n FROM s GROUP BY user_id, k""")
def session_window(spark, sf_dir):
    s = read(spark, sf_dir, "events").groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return s.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("began"), "n")


@query("SELECT conv_id, role, turn, min(turn) OVER (PARTITION BY conv_id, role) = turn AS first_of_role FROM conversations")
def first_occurrence_flag(spark, sf_dir):
    w = Window.partitionBy("conv_id", "role")
    return read(spark, sf_dir, "conversations").select("conv_id", "role", "turn", (F.min("turn").over(w) == F.col("turn")).alias("first_of_role"))


@query("SELECT p_partkey, CASE WHEN p_type LIKE '%SMALL%' OR p_type LIKE '%LARGE%' THEN 'sized' ELSE 'other' END AS kind, coalesce(nullif(trim(p_name), ''), 'unnamed') AS name FROM part WHERE p_name IS NOT NULL")
def keyword_routing(spark, sf_dir):
    p = read(spark, sf_dir, "part").filter("p_name IS NOT NULL")
    return p.select("p_partkey", F.when(F.col("p_type").rlike("SMALL|LARGE"), "sized").otherwise("other").alias("kind"), F.coalesce(F.nullif(F.trim("p_name"), F.lit("")), F.lit("unnamed")).alias("name"))
