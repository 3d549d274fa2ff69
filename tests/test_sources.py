"""Adapters on small files in the sources' layouts, sinks, streams and the runner."""

from pyspark.sql import functions as F

from cadastra.plans.runner import Step, run
from cadastra.sources import listings, sinks
from cadastra.streaming import ingest


def test_sources_unite(spark, tmp_path):
    (tmp_path / "c21.csv").write_text("property_id;type;localisation;prix;surface_m2;date_scraping;status;description\n1;Villa;Sfax - Sakiet Ezzit;250 000 DT;120,5;2026-01-05;Vente;belle villa\n2;Villa;La Marsa;;x;;;\n")
    (tmp_path / "tayara.csv").write_text("price,superficie,location,category,date,scraped_at\n900,80,Tunis,Appartements,2 months ago,2026-02-20 00:00:00\n")
    (tmp_path / "bnb.csv").write_text("titre,prix_montant,localisation,image\nStudio,120,Sousse,https://x.example/uploads/2025/07/a.jpg\n")
    df = listings.unified(spark, {"century21": str(tmp_path / "c21.csv"), "tayara": str(tmp_path / "tayara.csv"), "bnb": str(tmp_path / "bnb.csv")})
    rows = {(r["source"], r["city"]): r for r in df.collect()}
    assert df.columns == [f.name for f in listings.CANONICAL.fields] and len(rows) == 4
    assert rows["century21", "sakiet ezzit"]["price"] == 250000.0 and rows["century21", "sakiet ezzit"]["surface"] == 120.5
    assert rows["century21", "la marsa"]["price"] is None and rows["century21", "la marsa"]["surface"] is None
    assert str(rows["tayara", "Tunis"]["published"]) == "2025-12-22 00:00:00"
    assert rows["bnb", "Sousse"]["deal"] == "Location Courte Duree" and rows["bnb", "Sousse"]["published"].month == 7


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "k int, v string, g string")
    assert sinks.decoder(df, "k", "v").first()["decoder"] == '{"1":"a","2":"b"}'
    sinks.write_partitioned(df, str(tmp_path / "out"), "g")
    assert spark.read.parquet(str(tmp_path / "out")).filter("g = 'x'").count() == 1
    for _ in range(2):
        sinks.append_run(df, str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 4


def test_ingest_resumes(spark, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    rows = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (2, "2024-01-01 01:00:00")], "id int, at string").withColumn("at", F.to_timestamp("at"))
    rows.write.parquet(f"{source}/a")
    take = lambda: ingest.ingest(spark, f"{source}/*", rows.schema, "id", "at", out, state)
    take()
    rows.union(rows.withColumn("id", F.lit(3))).write.parquet(f"{source}/b")
    take()
    take()
    assert sorted(r["id"] for r in spark.read.parquet(out).collect()) == [1, 2, 3]


def test_runner_retries_and_skips():
    tried = []

    def flaky():
        tried.append(1)
        if len(tried) < 2:
            raise OSError("busy")
        return 5

    def broken():
        raise ValueError("PATH_NOT_FOUND")

    log = run([Step("a", flaky), Step("b", broken), Step("c", lambda: 1, ("a", "b")), Step("d", lambda: 2, ("a",)), Step("e", lambda: 3, ("nowhere",))], pause_s=0)
    assert [(n, s, r) for n, s, r, *_ in log] == [("a", "ok", 5), ("b", "failed", 0), ("c", "skipped", 0), ("d", "ok", 2), ("e", "skipped", 0)]


def test_missing_and_newest_sources(spark, tmp_path):
    import os

    from cadastra.sources import listings

    for i, name in enumerate(("b_old.csv", "a_new.csv")):
        (tmp_path / name).write_text("id,prix_affiche,ville\n1,12 000,Sfax\n")
        os.utime(tmp_path / name, (1000 + i, 1000 + i))
    absent = str(tmp_path / "absent.csv")
    assert listings.first_existing(spark, absent, str(tmp_path / "b_old.csv")).endswith("b_old.csv") and listings.first_existing(spark, absent) is None
    assert listings.latest(spark, f"{tmp_path}/*.csv").endswith("a_new.csv") and listings.latest(spark, f"{tmp_path}/*.csv", by_name=True).endswith("b_old.csv")
    both = listings.unified(spark, {"facebook": [absent, str(tmp_path / "a_new.csv")], "mubawab": absent})
    assert [(r["source"], r["city"]) for r in both.collect()] == [("facebook", "Sfax")]


def test_sheet_with_header_offset(spark, tmp_path):
    from cadastra.sources import listings

    (tmp_path / "s.csv").write_text("title,,\n,,\nyear, rate ,\n2024,7.5,\n,,\n2025,7.0,x\n")
    rows = listings.sheet(spark, str(tmp_path / "s.csv"), 2)
    assert rows.columns == ["year", "rate", "column_2"] and [r["year"] for r in rows.collect()] == ["2024", "2025"]
    assert listings.sheet(spark, str(tmp_path / "s.csv"), 99).count() == 0


def test_region_order_and_city_rules(spark):
    from pyspark.sql import functions as F

    from cadastra.functions import extract

    cases = {"Vente Tunis": "tunis", "mgrine": "megrine", "Inconnu": None, " x ": None, "Sousse, 3 days ago": "sousse", None: None}
    df = spark.createDataFrame([(k,) for k in cases], "c string")
    assert {r["c"]: r["v"] for r in df.select("c", extract.city(F.col("c")).alias("v")).collect()} == cases
    assert df.select(extract.region(F.lit("sousse et TUNIS"))).first()[0] == "Tunis"


def test_headers_of_several_sheets(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"s{i}.csv").write_text(f"report {i},\nkey,value\na{i},{i}\n,\nb{i},9\n")
    rows = listings.sheet(spark, str(tmp_path), header_row=1).collect()
    assert sorted((r["key"], r["value"]) for r in rows) == sorted((f"{k}{i}", v) for i in range(3) for k, v in (("a", str(i)), ("b", "9")))


def test_a_byte_order_mark_and_a_bound_of_rows(spark, tmp_path):
    (tmp_path / "f.csv").write_bytes("\ufeffprix,ville\n1,Sfax\n2,Tunis\n".encode())
    raw = listings.scan(spark, str(tmp_path / "f.csv"), listings.Layout(columns={}))
    assert raw.columns == ["prix", "ville"] and raw.count() == 2
    assert listings.scan(spark, str(tmp_path / "f.csv"), listings.Layout(columns={}), rows=1).count() == 1
