"""Outputs: GeoJSON features, encodings as JSON, growing tables, run logs, and sheets that are seen all together."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def feature(lat: Column, lon: Column, properties: list[Column]) -> Column:
    """A GeoJSON point; null properties are left out."""
    geometry = F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates"))
    return F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(*properties).alias("properties")))


def decoder(df: DataFrame, code: str, name: str) -> DataFrame:
    """One row: the distinct codes and names as a JSON object, by code."""
    pairs = df.select(F.col(code).cast("string").alias("k"), F.col(name).alias("v")).distinct()
    return pairs.agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct("k", "v"))))).alias("decoder"))


def write_partitioned(df: DataFrame, path: str, by: str) -> None:
    """Parquet by segment; Spark commits the whole output or nothing."""
    df.repartition(by).write.mode("overwrite").partitionBy(by).parquet(path)


def flat(df: DataFrame, prefix: str = "meta_") -> DataFrame:
    """Fields of nested columns as columns of their own (prefix, then the field's name), lists as texts joined by ', ', breaks of lines as spaces.

    A field whose name another column has takes its own column's name before it.
    """
    out: list[Column] = []
    taken = {f.name.lower() for f in df.schema if not isinstance(f.dataType, T.StructType)}

    def add(path: str, name: str, kind: T.DataType) -> None:
        if isinstance(kind, T.StructType):
            for f in kind:
                own = f"{prefix}{f.name}" if f"{prefix}{f.name}".lower() not in taken else f"{prefix}{name.removeprefix(prefix)}_{f.name}"
                if not isinstance(f.dataType, T.StructType):
                    taken.add(own.lower())
                add(f"{path}.`{f.name}`", own, f.dataType)
        elif isinstance(kind, T.ArrayType):
            items = F.col(path) if isinstance(kind.elementType, (T.AtomicType, T.NullType)) else F.transform(path, lambda x: F.to_json(x))
            out.append(F.array_join(items.cast("array<string>"), ", ").alias(name))
        elif isinstance(kind, T.MapType):
            out.append(F.to_json(path).alias(name))
        elif isinstance(kind, T.StringType):
            out.append(F.regexp_replace(path, "[\r\n]+", " ").alias(name))
        else:
            out.append(F.col(path).alias(name))

    for f in df.schema:
        add(f"`{f.name}`", f.name, f.dataType)
    return df.select(*out)


def append_run(df: DataFrame, path: str) -> None:
    """A batch more of a growing table; it may have other columns than the batches before."""
    df.write.mode("append").parquet(path)


def grown(spark: SparkSession, path: str) -> DataFrame:
    """All batches with all their columns; those that a batch lacks are null."""
    return spark.read.option("mergeSchema", "true").parquet(path)


def history(spark: SparkSession, path: str, by: str, n: int) -> DataFrame:
    """The n latest runs of a log, the latest first."""
    log = grown(spark, path)
    return log.orderBy(F.desc(by), *[c for c in log.columns if c != by]).limit(n)


MANIFEST = "manifest-"


def _folder(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _manifests(spark: SparkSession, path: str) -> list[str]:
    files, at = _folder(spark, path)
    found = [f.getPath() for f in files.listStatus(at)] if files.exists(at) else []
    return sorted(p.toString() for p in found if p.getName().startswith(MANIFEST) and p.getName().endswith(".json"))


def commit_sheets(named: dict[str, DataFrame], path: str) -> None:
    """Several tables in one commit: each is written in a folder of this run; the manifest that names them comes last, by a rename.

    Readers see the sheets of the latest manifest, so a run that breaks off between two sheets shows nothing. Of two runs
    at once one fails.
    """
    spark, run = next(iter(named.values())).sparkSession, uuid.uuid4().hex
    for name, df in named.items():
        df.write.parquet(f"{path}/run-{run}/{name}")
    number = len(_manifests(spark, path))
    files, at = _folder(spark, f"{path}/{MANIFEST}{number:08d}.json")
    _, own = _folder(spark, f"{path}/run-{run}/manifest")
    out = files.create(own)
    out.write(bytearray(json.dumps({"run": run, "sheets": list(named)}).encode()))
    out.close()
    if not files.rename(own, at):
        raise FileExistsError(f"another run has committed {at.toString()}")


def sheets(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The sheets of the latest commit by name, none without one."""
    found = _manifests(spark, path)
    if not found:
        return {}
    said = json.loads("".join(r["value"] for r in spark.read.text(found[-1]).collect()))  # a few names
    return {name: spark.read.parquet(f"{path}/run-{said['run']}/{name}") for name in said["sheets"]}
