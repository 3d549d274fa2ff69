"""JSON of unknown keys as VARIANT: leaves by path, and what is no JSON kept apart."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def entries(df: DataFrame, value: str, position: str, key: str, output: str) -> DataFrame:
    """A row for each member of an object (its key) or element of an array (key null) in a VARIANT column; others and nulls have none."""
    names = [c for c in df.columns if c != value]
    exploded = df.lateralJoin(df.sparkSession.tvf.variant_explode(F.col(value).outer()))
    return exploded.select(*names, F.col("pos").alias(position), F.col("key").alias(key), F.col("value").alias(output))


def malformed(df: DataFrame, row: str, text: str) -> DataFrame:
    """The rows whose text is no JSON."""
    return df.filter(F.col(text).isNotNull() & F.try_parse_json(text).isNull()).select(row, text)


def leaves(df: DataFrame, row: str, text: str, depth: int = 5) -> DataFrame:
    """(row, path, kind, value): the scalars of each JSON text, objects' keys and arrays' places joined by dots.

    Nulls of JSON have the kind VOID and no value; empty objects and arrays have no leaves; what lies deeper than
    `depth` stays as JSON text of the kind OBJECT or ARRAY; texts that are no JSON have no rows (see malformed).
    """
    kind = lambda v: F.regexp_extract(F.schema_of_variant(v), "^[A-Z_]+", 0)
    nested = lambda v: kind(v).isin("OBJECT", "ARRAY")
    shown = lambda v: F.when(nested(v), F.to_json(v)).otherwise(F.try_variant_get(v, "$", "string"))
    level, out = df.select(row, F.lit(None).cast("string").alias("path"), F.try_parse_json(text).alias("v")).filter("v IS NOT NULL"), None
    for at in range(depth + 1):
        done = level.filter(~nested("v")) if at < depth else level
        done = done.select(row, F.coalesce("path", F.lit("")).alias("path"), kind("v").alias("kind"), shown("v").alias("value"))
        out = done if out is None else out.unionByName(done)
        if at < depth:
            deeper = entries(level.filter(nested("v")), "v", "_pos", "_key", "_next")
            level = deeper.select(row, F.concat_ws(".", "path", F.coalesce("_key", F.col("_pos").cast("string"))).alias("path"), F.col("_next").alias("v"))
    return out
