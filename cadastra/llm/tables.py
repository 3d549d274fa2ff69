"""Tables written between the steps of an operator, and joins with sides of a checked size."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes up to which a side of known row count may be broadcast; above, joins shuffle.
BROADCAST_BYTES = 32 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or one of our own where it is unset (local tests)."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if spark.sparkContext.master.startswith("local["):
            at = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
            spark.conf.set("spark.checkpoint.dir", at)
        else:
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return at


def written(df: DataFrame, codec: str = "snappy") -> DataFrame:
    """The rows, written as a Parquet table in the shared folder and read back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path)


def settle(df: DataFrame) -> None:
    """Lets Spark drop the shuffles and broadcasts that no table in use needs."""
    gc.collect()
    df.sparkSession._jvm.System.gc()


def discard(df: DataFrame) -> None:
    """Deletes the files of a written table that nothing reads any more."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        at = jvm.org.apache.hadoop.fs.Path(folder)
        at.getFileSystem(conf).delete(at, True)
    settle(df)


def small(df: DataFrame, row_bytes: int, rows: int | None = None, bound: int = BROADCAST_BYTES) -> DataFrame:
    """A written table, with a broadcast hint if its counted rows fit the bound; without, the join shuffles."""
    rows = df.count() if rows is None else rows
    return F.broadcast(df) if rows * row_bytes <= bound else df


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like these that df does not have (in any case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n = f"_{n}"
        out.append(n)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parallelism(spark: SparkSession) -> int:
    """The session's number of shuffle partitions, which its owner sizes to the data."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
