"""Listing sources: raw files of eight layouts to one typed schema."""

from __future__ import annotations

import logging
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadastra.functions import dates, extract, text

CANONICAL = T.StructType(
    [
        T.StructField("source", T.StringType()),
        T.StructField("row_id", T.LongType()),
        *[T.StructField(c, T.DoubleType()) for c in ("price", "surface", "rooms", "bedrooms")],
        *[T.StructField(c, T.StringType()) for c in ("city", "region", "kind", "deal", "description", "image_url", "url")],
        T.StructField("published", T.TimestampType()),
    ]
)


def after_dash(c: Column) -> Column:
    """The city in the part of a place behind its first ' - ', or in all of it; noise, longer dashes too, goes before."""
    v = text.strip_noise(c)
    return extract.city(F.trim(F.coalesce(F.get(F.split(v, " - ", 2), F.lit(1)), v)))


@dataclass(frozen=True)
class Layout:
    """Where a source keeps the canonical columns: names, tried in order, or expressions."""

    separator: str = ","
    columns: dict[str, list[str]] = field(default_factory=dict)
    constants: dict[str, str] = field(default_factory=dict)
    place_behind_dash: bool = False
    relative_to: str | None = None


# Column names of the sources.
LAYOUTS = {
    "facebook": Layout(columns={"price": ["prix_affiche"], "city": ["ville"], "region": ["gouvernorat"], "kind": ["type_bien"], "deal": ["type_annonce"], "description": ["description"], "image_url": ["image_url"]}),
    "mubawab": Layout(columns={"price": ["prix_tnd"], "surface": ["surface_m2"], "city": ["ville"], "region": ["gouvernorat"], "kind": ["type_bien"], "deal": ["categorie"], "bedrooms": ["nb_chambres"], "rooms": ["nb_pieces"], "description": ["titre"], "url": ["url"], "image_url": ["image_url"]}),
    "mubawab_partial": Layout(columns={"price": ["prix"], "surface": ["surface_m2"], "city": ["ville"], "region": ["ville"], "kind": ["type_propriete"], "bedrooms": ["nombre_chambres"], "description": ["description", "titre"], "url": ["url"], "published": ["date_collecte"]}),
    "tayara": Layout(columns={"price": ["price"], "surface": ["superficie"], "city": ["location"], "region": ["location"], "kind": ["category"], "deal": ["type_de_transaction"], "bedrooms": ["chambres"], "description": ["description"], "url": ["url"], "published": ["date"]}, relative_to="scraped_at"),
    "tunisie_annonces": Layout(columns={"price": ["prix_montant"], "surface": ["surface_couverte"], "city": ["region", "gouvernorat"], "region": ["gouvernorat"], "kind": ["type_bien"], "deal": ["type_transaction"], "bedrooms": ["nombre_chambres"], "rooms": ["nombre_pieces"], "description": ["description_complete"], "url": ["url"], "published": ["date_insertion", "date_modification"]}),
    "century21": Layout(separator=";", columns={"price": ["prix"], "surface": ["surface_m2"], "city": ["localisation"], "region": ["localisation"], "kind": ["type"], "deal": ["status"], "description": ["description"], "url": ["url"], "image_url": ["image_url"], "published": ["date_scraping"]}, place_behind_dash=True),
    "homeintunisia": Layout(separator=";", columns={"price": ["prix"], "surface": ["surface_m2"], "city": ["localisation"], "region": ["localisation"], "kind": ["type"], "bedrooms": ["nombre_chambres"], "rooms": ["nombre_pieces"], "description": ["titre"], "url": ["url"], "published": ["date_scraping"]}, place_behind_dash=True),
    "bnb": Layout(columns={"price": ["prix_montant"], "surface": ["meta_Surface"], "city": ["localisation"], "region": ["localisation"], "bedrooms": ["meta_Lits"], "description": ["description"], "url": ["url"], "image_url": ["image"]}, constants={"deal": "Location Courte Duree"}),
}


def scan(spark: SparkSession, path: str, layout: Layout, rows: int | None = None) -> DataFrame:
    """The raw strings of a CSV source, of the first `rows` at most where that is asked for; malformed lines are dropped, a byte order mark is no text."""
    raw = spark.read.option("header", True).option("sep", layout.separator).option("mode", "DROPMALFORMED").option("multiLine", True).option("escape", '"').csv(path)
    raw = raw.toDF(*[c.removeprefix("\ufeff") for c in raw.columns])
    return raw if rows is None else raw.limit(rows)


def canonical(raw: DataFrame, source: str) -> DataFrame:
    """A raw source in the canonical schema; columns it lacks are null."""
    layout = LAYOUTS[source]
    blank = F.lit(None).cast("string")

    def value(name: str) -> Column:
        if name in layout.constants:
            return F.lit(layout.constants[name])
        own = [F.nullif(F.trim(F.col(f"`{c}`").cast("string")), F.lit("")) for c in layout.columns.get(name, []) if c in raw.columns]
        return F.coalesce(*own) if own else blank

    numbers = {c: text.number(value(c)).alias(c) for c in ("price", "surface", "rooms", "bedrooms")}
    places = {c: (after_dash(value(c)) if layout.place_behind_dash and c == "city" else value(c)).alias(c) for c in ("city", "region", "kind", "deal", "description", "image_url", "url")}
    day = dates.parse(value("published"))
    if layout.relative_to and layout.relative_to in raw.columns:
        day = F.coalesce(dates.relative(value("published"), F.to_timestamp(F.col(layout.relative_to))), day)
    if source == "bnb":
        day = dates.from_path(value("image_url"))
    row = F.xxhash64(F.lit(source), *[F.col(f"`{c}`") for c in raw.columns])
    return raw.select(F.lit(source).alias("source"), row.alias("row_id"), *numbers.values(), *places.values(), day.alias("published"))


def _files(spark: SparkSession, pattern: str):
    """(path, time of change) of what a path or pattern names, in any store that Spark reads."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return [(f.getPath().toString(), f.getModificationTime()) for f in found or []]


def first_existing(spark: SparkSession, *paths: str) -> str | None:
    """The first of the candidate paths that exists."""
    return next((p for p in paths if _files(spark, p)), None)


def latest(spark: SparkSession, pattern: str, by_name: bool = False) -> str | None:
    """The newest file of a pattern by time of change, or the last by name."""
    found = _files(spark, pattern)
    return max(found, key=lambda f: (f[0],) if by_name else (f[1], f[0]))[0] if found else None


def sheet(spark: SparkSession, path: str, header_row: int = 0, separator: str = ",") -> DataFrame:
    """The exported sheets of workbooks (a file or a folder) whose header stands in row header_row (from 0) of each; rows without any value go."""
    raw = spark.read.option("sep", separator).option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(path)
    top = raw.head(header_row + 1)
    if len(top) <= header_row:
        return raw.limit(0)
    names = [(v or f"column_{i}").strip() for i, v in enumerate(top[-1])]
    own = raw.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start")).withColumn("_id", F.monotonically_increasing_id())
    line = F.row_number().over(Window.partitionBy("_file", "_start").orderBy("_id"))  # of each file's first block at most a split
    body = own.withColumn("_line", line).filter((F.col("_start") > 0) | (F.col("_line") > header_row + 1)).drop("_file", "_start", "_id", "_line")
    return body.toDF(*names).dropna("all")


def unified(spark: SparkSession, paths: dict[str, str | list[str]]) -> DataFrame:
    """All sources in one table; of a source's candidate paths the first that exists counts, and a source without any is passed over."""
    out = spark.createDataFrame([], CANONICAL)
    for source, candidates in paths.items():
        path = first_existing(spark, *([candidates] if isinstance(candidates, str) else candidates))
        if path is None:
            logging.getLogger(__name__).warning("source %s is missing", source)
            continue
        out = out.unionByName(canonical(scan(spark, path, LAYOUTS[source]), source))
    return out
