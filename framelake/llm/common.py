"""Helpers that the training-data operators share."""

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Regular expressions for the contract's white space and words (ASCII only).
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
#: Whether shuffle files go when the query that made them ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bytes at which Spark ends an Arrow batch for Python (by itself at 10,000 rows or 64 MB): each is held by Spark and by the worker.
PIECES = {"spark.sql.execution.arrow.maxBytesPerBatch": str(1 << 21)}


def shared_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir; where that is unset, under a temporary folder, in local mode only."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        base = "file://" + tempfile.mkdtemp(prefix="framelake-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/framelake-{uuid.uuid4().hex[:12]}"


def dropped(spark: SparkSession, paths: list[str]) -> None:
    """Deletes staged tables that nothing reads any more."""
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    paths.clear()


@contextmanager
def configured(spark: SparkSession, conf: dict[str, str]) -> Iterator[None]:
    """Settings that hold for the queries that run inside."""
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def staged(df: DataFrame, paths: list[str] | None = None, pieces: bool = False) -> DataFrame:
    """Writes df to a shared folder and reads it back: cuts lineage, fixes row identity, survives lost executors.

    The shuffles that led to the table end with its write, so Spark is told to drop their files then. Its path is added to
    `paths`, for dropped(). pieces: Python gets texts in PIECES."""
    spark = df.sparkSession
    path = shared_dir(spark)
    if paths is not None:
        paths.append(path)
    with configured(spark, {CLEANUP: "true"} | (PIECES if pieces else {})):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def held_out(doc_id):
    """True for ids whose CRC-32 of the decimal text is 0 modulo 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def few(df: DataFrame, most: int = 200_000) -> bool:
    """Whether a narrow table has so few rows that it may be broadcast; else Spark joins by shuffling."""
    return df.limit(most + 1).count() <= most


#: A key that more than one in so many rows has is hot: there are fewer hot keys than this.
HOT = 1000


def looked_up(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """rows, each with the columns that `table` has for its key (nulls where it has none, and for null keys).

    `table` has one row a key; its column n, which isn't taken over, says how many of the rows have the key. Hot keys, fewer
    than HOT, are looked up in a broadcast part; other rows meet the rest of the table by a shuffle, in which no key has
    many rows. Rows that are done, and null keys, are spread over that shuffle's tasks. `table` should be staged."""
    new = [c for c in table.columns if c not in (key, "n")]
    least = (table.agg(F.sum("n")).first()[0] or 0) / HOT
    hot = table.where(F.col("n") > least).select(F.col(key).alias("__key"), F.struct(*new).alias("__hot"))
    rest = table.where(F.col("n") <= least).select(F.col(key).alias("__key"), F.lit(0).alias("__spread"), F.struct(*new).alias("__cold"))
    done = F.col("__hot").isNotNull() | F.col(key).isNull()
    met = rows.join(F.broadcast(hot), F.col(key) == F.col("__key"), "left").drop("__key")
    met = met.withColumn("__at", F.when(done, 1 + F.monotonically_increasing_id() % 65536).otherwise(F.lit(0)))
    met = met.join(rest, (F.col(key) == F.col("__key")) & (F.col("__at") == F.col("__spread")), "left")
    return met.select(*rows.columns, *(F.coalesce(F.col(f"__hot.{c}"), F.col(f"__cold.{c}")).alias(c) for c in new))
