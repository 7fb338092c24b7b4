"""Zero-order hold: signals on a common axis of ticks, in chunks of time so that no log is one task's work.

Ticks are all distinct instants of data frames of a log, whatever signals are asked for. Of several samples at one
instant the last recorded wins. Within a chunk the last sample is carried forward by a window; what was in force before
a chunk comes from one small row per chunk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelake.operators.decode import data_frames, resolve, sample, SAMPLE, with_words
from framelake.plans.catalog import Catalog


def ticks(frames: DataFrame) -> DataFrame:
    return data_frames(frames).select("log_id", "t").distinct()


def chunk_of(t: Column, seconds: float) -> Column:
    return F.floor(t / F.lit(float(seconds))).cast("long")


def previous(rows: DataFrame, keys: list[str], values: dict[str, str], chunk_seconds: float = 600.0) -> DataFrame:
    """rows(keys..., t, seq, ...) with values {column: new name} of the row before among those with the same keys, by (t, seq);
    null at the first. Within chunks of time a window looks back; each chunk's last row, one small row, goes on to the
    next chunk. So no task has a key's whole history."""
    packed = F.struct(*values)
    rows = rows.withColumn("__chunk", chunk_of(F.col("t"), chunk_seconds))
    last = rows.groupBy(*keys, "__chunk").agg(F.max_by(packed, F.struct("t", "seq")).alias("__last"))
    carried = last.select(*keys, "__chunk", F.lag("__last").over(Window.partitionBy(*keys).orderBy("__chunk")).alias("__carried"))
    before = F.coalesce(F.lag(packed).over(Window.partitionBy(*keys, "__chunk").orderBy("t", "seq")), F.col("__carried"))
    found = rows.join(carried, [*keys, "__chunk"]).withColumn("__before", before)
    return found.withColumns({new: F.col("__before")[c] for c, new in values.items()}).drop("__chunk", "__carried", "__before")


def at_ticks(frames: DataFrame, catalog: Catalog, names: list[str]) -> DataFrame:
    """(log_id, t, one nullable sample struct per name, sampled): what was recorded at each tick."""
    found = resolve(catalog, names)
    columns = [(sample(*found[n], words=True) if n in found else F.lit(None).cast(SAMPLE)).alias(n) for n in names]
    rows = with_words(data_frames(frames)).select("log_id", "t", "seq", *columns)
    last = [F.max_by(n, F.when(F.col(n).isNotNull(), F.col("seq"))).alias(n) for n in names]
    out = rows.groupBy("log_id", "t").agg(*last) if last else rows.select("log_id", "t").distinct()
    return out.withColumn("sampled", recorded(names))


def recorded(names: list[str] | tuple[str, ...]) -> Column:
    """Whether any of the names has a sample at the row's tick."""
    return F.coalesce(*(F.when(F.col(n).isNotNull(), True) for n in names), F.lit(False))


def _prefixed(small: DataFrame, names: list[str]) -> DataFrame:
    """The last non-null value of each column over all earlier chunks; one row per chunk goes in and comes out."""
    before = Window.partitionBy("log_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    return small.select("log_id", "chunk", *(F.last(n, ignorenulls=True).over(before).alias(f"__before_{n}") for n in names))


def hold(rows: DataFrame, names: list[str], chunk_seconds: float = 600.0) -> DataFrame:
    """rows(log_id, t, names...) one per tick -> with cur_<name> and prev_<name>: the value in force at the tick and at
    the tick before (null at the first tick of a log)."""
    rows = rows.withColumn("chunk", chunk_of(F.col("t"), chunk_seconds))
    if not names:
        return rows
    inside = Window.partitionBy("log_id", "chunk").orderBy("t")
    up_to = inside.rowsBetween(Window.unboundedPreceding, 0)
    carry = rows.groupBy("log_id", "chunk").agg(*(F.max_by(n, F.when(F.col(n).isNotNull(), F.col("t"))).alias(n) for n in names))
    known = rows.join(_prefixed(carry, names), ["log_id", "chunk"])
    known = known.withColumns({f"cur_{n}": F.coalesce(F.last(n, ignorenulls=True).over(up_to), F.col(f"__before_{n}")) for n in names})
    first = F.row_number().over(inside) == 1
    known = known.withColumns({f"prev_{n}": F.when(first, F.col(f"__before_{n}")).otherwise(F.lag(f"cur_{n}").over(inside)) for n in names})
    return known.drop(*(f"__before_{n}" for n in names))


def held(frames: DataFrame, catalog: Catalog, names: list[str], chunk_seconds: float = 600.0) -> DataFrame:
    return hold(at_ticks(frames, catalog, names), names, chunk_seconds)


def value_at(frames: DataFrame, catalog: Catalog, names: list[str], t: float) -> DataFrame:
    """(log_id, signal, raw, num, label, t): the last sample of each name at or before t."""
    from framelake.operators.decode import samples

    rows = samples(frames.where(F.col("t") <= t), catalog, names)
    last = F.max_by(F.struct("raw", "num", "label", "t"), F.struct("t", "seq")).alias("v")
    return rows.groupBy("log_id", "signal").agg(last).select("log_id", "signal", "v.*")


def asof(left: DataFrame, right: DataFrame, keys: list[str], values: list[str], chunk_seconds: float = 600.0) -> DataFrame:
    """left(keys..., t, ...) with, for each row, the right row of the same keys with the largest (t, seq), t not after
    the left row's: a union in time order, carried forward in chunks."""
    tagged = left.withColumn("__side", F.lit(1)).withColumn("__seq", F.lit(None).cast("long")).withColumn("__row", F.struct(*left.columns)).select(*keys, "t", "__side", "__seq", "__row", F.lit(None).cast(right.select(F.struct(*values, "t").alias("v")).schema["v"].dataType).alias("__v"))
    other = right.select(*keys, "t", F.lit(0).alias("__side"), F.col("seq").cast("long").alias("__seq"), F.lit(None).cast(tagged.schema["__row"].dataType).alias("__row"), F.struct(*values, "t").alias("__v"))
    both = tagged.unionByName(other).withColumn("chunk", chunk_of(F.col("t"), chunk_seconds))
    carry = both.groupBy(*keys, "chunk").agg(F.max_by("__v", F.when(F.col("__v").isNotNull(), F.struct("t", "__seq"))).alias("__last"))
    before = Window.partitionBy(*keys).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    carry = carry.select(*keys, "chunk", F.last("__last", ignorenulls=True).over(before).alias("__before"))
    inside = Window.partitionBy(*keys, "chunk").orderBy("t", "__side", "__seq").rowsBetween(Window.unboundedPreceding, 0)
    filled = both.join(carry, [*keys, "chunk"]).withColumn("__found", F.coalesce(F.last("__v", ignorenulls=True).over(inside), F.col("__before")))
    found = [F.col("__found")[v].alias(f"right_{v}") for v in [*values, "t"]]
    return filled.where("__side = 1").select("__row.*", *found)
