"""What a reviewer of a recording asks beside its findings: whether spec, schema and log belong together, why a list is empty,
which event comes next, how far an axis goes; frames as sparse JSON; digests that tell whether results have changed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelake.functions.bits import payload_text
from framelake.plans.catalog import Catalog

#: Share of ids that the schema lacks from which on schema and log don't seem to belong together.
UNKNOWN_SHARE = 0.3


def frame_json(frames: DataFrame) -> DataFrame:
    """(log_id, seq, json): a frame as an object; what only events have is left out of data frames, and nulls everywhere."""
    event = F.col("kind") != "data"
    only = [F.when(event, F.col(c)).alias(c) for c in ("kind", "error_type", "tec", "rec", "state", "direction")]
    return frames.select("log_id", "seq", F.to_json(F.struct("t", F.col("frame_id").alias("id"), payload_text(F.col("data")).alias("data"), "channel", "is_extended", *only)).alias("json"))


def function_status(coverage: DataFrame) -> DataFrame:
    """coverage(function, signal, status) -> (function, available, nodata, missing, dead): how many of a function's signals
    the log has, and whether it has none."""
    counts = [F.count_if(F.col("status") == s).alias(s) for s in ("available", "nodata", "missing")]
    return coverage.groupBy("function").agg(*counts).withColumn("dead", F.col("available") == 0)


def mismatches(coverage: DataFrame, ids: int, unknown_ids: int) -> list[tuple[str, int, int]]:
    """(what, how many, of how many) that speak against spec, schema and log belonging together: unknown_ids, and one of
    all_functions_dead, functions_dead and signals_without_data."""
    row = function_status(coverage).agg(F.count("*").alias("n"), F.count_if("dead").alias("dead")).first()
    silent = coverage.where("status = 'nodata'").select("signal").distinct().count()
    told = [("unknown_ids", unknown_ids, ids)] if ids and unknown_ids / ids > UNKNOWN_SHARE else []
    if row["dead"]:
        told.append(("all_functions_dead" if row["dead"] == row["n"] else "functions_dead", row["dead"], row["n"]))
    elif silent:
        told.append(("signals_without_data", silent, coverage.select("signal").distinct().count()))
    return told


def empty_reason(coverage: DataFrame, filtered: bool) -> str:
    """Why no event is listed: filtered (a filter is set), no_data (no function has a signal in the log), or never_met."""
    if filtered:
        return "filtered"
    return "no_data" if coverage.count() and not function_status(coverage).where("not dead").count() else "never_met"


def around(events: DataFrame, t: float) -> DataFrame:
    """events(log_id, t, position, type, ...) with which: of each log the event that a cursor at t is on (the last one not
    after it, but for rounding), the one before that in the list's order, and the next one."""
    order = ["t", "position", "type"]
    behind = F.col("t") <= t + 1e-9
    last = F.row_number().over(Window.partitionBy("log_id").orderBy(*(F.desc(c) for c in order)))
    first = F.row_number().over(Window.partitionBy("log_id").orderBy(*order))
    two = events.where(behind).withColumn("__n", last).where("__n <= 2").withColumn("which", F.when(F.col("__n") == 1, "current").otherwise("previous"))
    return two.unionByName(events.where(~behind).withColumn("__n", first).where("__n <= 1").withColumn("which", F.lit("next"))).drop("__n")


def axis_ranges(bounds: DataFrame, catalog: Catalog) -> DataFrame:
    """bounds(log_id, signal, lowest, highest, n) -> (log_id, signal, low, high): an enumeration has a place for each of its
    names, a constant one unit around it, other signals 8 % of their span; without values 0 to 1."""
    names = catalog.signal_table(bounds.sparkSession).groupBy(F.col("name").alias("signal")).agg(F.max_by(F.size("choices"), "message_id").alias("names"))
    span = F.col("highest") - F.col("lowest")
    pad = F.when(span == 0, 1.0).otherwise(span * 0.08)
    low = F.when(F.col("names") > 0, F.lit(-0.4)).when(F.col("lowest").isNull(), 0.0).otherwise(F.col("lowest") - pad)
    high = F.when(F.col("names") > 0, F.col("names") - 0.6).when(F.col("highest").isNull(), 1.0).otherwise(F.col("highest") + pad)
    return bounds.join(F.broadcast(names), "signal", "left").select("log_id", "signal", low.alias("low"), high.alias("high"))  # a row per signal of the schema


def digest(rows: DataFrame, *columns: Column) -> DataFrame:
    """One row (n, digest): the number of rows, and a sum of hashes of their columns as text, whatever their order. Numbers
    should come as integers, so that rounding is decided before."""
    text = F.concat_ws("|", *(F.coalesce(c.cast("string"), F.lit("~")) for c in columns))
    part = F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("decimal(20,0)")
    return rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(part), F.lit(0)).cast("string").alias("digest"))


def golden(frames: DataFrame, samples: DataFrame, events: DataFrame) -> DataFrame:
    """(part, n, digest) of a log's frames, its samples and its events: equal as long as nothing has changed."""
    micro = lambda t: F.rint(F.col(t) * 1e6).cast("long")
    parts = {
        "frames": digest(frames, F.col("seq"), micro("t"), F.col("channel"), F.col("frame_id"), F.col("kind"), F.lower(F.hex("data"))),
        "samples": digest(samples, F.col("signal"), F.col("seq"), F.col("raw"), micro("num"), F.col("label")),
        "events": digest(events, F.col("function"), F.col("type"), micro("t")),
    }
    out = None
    for name, part in parts.items():
        part = part.select(F.lit(name).alias("part"), "n", "digest")
        out = part if out is None else out.unionByName(part)
    return out
