"""What charts and lists ask for: series of a window, downsampling, frame traces, event lists and coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framelake.functions.bits import payload_text
from framelake.operators.decode import data_frames, decode_status, plotted, resolve, sample, with_words
from framelake.plans.catalog import Catalog
from framelake.sources.frames import first_of_each


def points(frames: DataFrame, catalog: Catalog, names: list[str], start: float | None = None, end: float | None = None) -> DataFrame:
    """(log_id, signal, t, seq, y, enumerated): samples of an inclusive window as numbers to draw."""
    rows = data_frames(frames, sorted({m.frame_id for m, _ in resolve(catalog, names).values()}))
    if start is not None:
        rows = rows.where(F.col("t") >= start)
    if end is not None:
        rows = rows.where(F.col("t") <= end)
    rows, each = with_words(rows), []
    for name, (message, signal) in resolve(catalog, names).items():
        value = sample(message, signal, words=True)
        each.append(F.when(value.isNotNull(), F.struct(F.lit(name).alias("signal"), plotted(signal, value).alias("y"), F.lit(bool(signal.choices)).alias("enumerated"))))
    return rows.select("log_id", "t", "seq", F.explode(F.array_compact(F.array(*each))).alias("s")).select("log_id", "s.signal", "t", "seq", "s.y", "s.enumerated")


def bounds(series: DataFrame) -> DataFrame:
    """Lowest and highest finite value of each signal over the whole window, null for enumerations, and the points."""
    finite = F.when(~F.col("enumerated") & ~F.isnan("y"), F.col("y"))
    return series.groupBy("log_id", "signal").agg(F.min(finite).alias("lowest"), F.max(finite).alias("highest"), F.count("*").alias("n"))


def _numbered(series: DataFrame, keys: list[str], chunk_seconds: float) -> DataFrame:
    """Adds nth (from 0, in order of time) in chunks of time, and n, the rows of the keys."""
    from framelake.operators.align import chunk_of

    rows = series.withColumn("__chunk", chunk_of(F.col("t"), chunk_seconds))
    sums = rows.groupBy(*keys, "__chunk").agg(F.count("*").alias("__n"))
    order = Window.partitionBy(*keys).orderBy("__chunk")
    base = sums.select(*keys, "__chunk", F.coalesce(F.sum("__n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__base"), F.sum("__n").over(Window.partitionBy(*keys)).alias("n"))
    inside = F.row_number().over(Window.partitionBy(*keys, "__chunk").orderBy("t", "seq")) - 1
    return rows.join(base, [*keys, "__chunk"]).withColumn("nth", F.col("__base") + inside).drop("__chunk", "__base")


def strided(series: DataFrame, most: int = 4000, chunk_seconds: float = 600.0) -> DataFrame:
    """Every ceil(n / most)-th point of each signal, the first one always."""
    rows = _numbered(series, ["log_id", "signal"], chunk_seconds)
    return rows.where(F.col("nth") % F.ceil(F.col("n") / most) == 0).drop("nth", "n")


def lowest_highest(series: DataFrame, buckets: int, start: float, end: float) -> DataFrame:
    """(log_id, signal, bucket, lowest, highest, n): extremes in equal buckets of a window, so that spikes stay."""
    at = F.least(F.floor((F.col("t") - start) / F.lit((end - start) / buckets)), F.lit(buckets - 1)).cast("long")
    return series.where(F.col("t").between(start, end)).groupBy("log_id", "signal", at.alias("bucket")).agg(F.min("y").alias("lowest"), F.max("y").alias("highest"), F.count("*").alias("n"))


def trace(frames: DataFrame, catalog: Catalog, start: float, end: float, most: int = 2000) -> DataFrame:
    """(log_id, t, seq, channel, frame_id, name, dlc, payload, signals map<string, string>): of each log the
    first frames of a window."""
    rows = with_words(first_of_each(data_frames(frames).where(F.col("t").between(start, end)), most, "t", "seq"))
    name, decoded = F, F
    for message in catalog.messages:
        name = name.when(F.col("frame_id") == message.frame_id, F.lit(message.name))
        pairs = []
        for signal in message.signals:
            value = sample(message, signal, words=True)
            pairs.append(F.when(value.isNotNull(), F.struct(F.lit(signal.name).alias("k"), F.coalesce(value["label"], value["num"].cast("string")).alias("v"))))
        decoded = decoded.when(F.col("frame_id") == message.frame_id, F.map_from_entries(F.array_compact(F.array(*pairs))))
    return rows.select("log_id", "t", "seq", "channel", "frame_id", name.alias("name"), "dlc", payload_text(F.col("data")).alias("payload"), decoded.alias("signals"))


def matching_events(events: DataFrame, functions: DataFrame, types: list[str] | None = None, ids: list[str] | None = None, text: str | None = None) -> DataFrame:
    """Events (and attempts) with their function's name; filters by type, function, and text in id, name or summary
    whatever its case."""
    rows = events.join(F.broadcast(functions.select("function", "name")), "function", "left")  # a row per function
    if types:
        rows = rows.where(F.col("type").isin(types))
    if ids:
        rows = rows.where(F.col("function").isin(ids))
    if text:
        where = F.lower(F.concat_ws(" ", "function", "name", "summary"))
        rows = rows.where(where.contains(text.lower()))
    return rows


def event_list(events: DataFrame, functions: DataFrame, types: list[str] | None = None, ids: list[str] | None = None, text: str | None = None, most: int = 3000) -> DataFrame:
    """The first of the matching events, in order of time."""
    return matching_events(events, functions, types, ids, text).orderBy("t", "position", "type").limit(most)


def event_total(events: DataFrame, functions: DataFrame, types: list[str] | None = None, ids: list[str] | None = None, text: str | None = None, most: int = 3000) -> DataFrame:
    """One row (total, truncated): how many events match, and whether event_list() leaves some out."""
    return matching_events(events, functions, types, ids, text).agg(F.count("*").alias("total"), (F.count("*") > most).alias("truncated"))


def latest_event(events: DataFrame, t: float) -> DataFrame:
    """Of each log and function the last event at or before t (or later by less than rounding may make of it)."""
    before = events.where(F.col("t") <= t + 1e-9)
    return before.groupBy("log_id", "function").agg(F.max_by(F.struct("type", "t", "summary"), F.struct("t", "position", "type")).alias("e")).select("log_id", "function", "e.*")


def event_counts(events: DataFrame, functions: DataFrame) -> DataFrame:
    """(function, type, n) over all events; functions without any have n 0 and no type."""
    counts = events.groupBy("function", "type").agg(F.count("*").alias("n"))
    return functions.select("function").join(counts, "function", "left").select("function", "type", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def coverage(function_signals: DataFrame, catalog: Catalog, frames: DataFrame | None) -> DataFrame:
    """function_signals(function, position, signal) -> status: missing in the schema, nodata in the log, or available.
    Without a log everything in the schema is available; without a schema everything is."""
    if not catalog.messages:
        return function_signals.withColumn("status", F.lit("available"))
    spark = function_signals.sparkSession
    signals = catalog.signal_table(spark).groupBy(F.col("name").alias("signal")).agg(F.max("message_id").alias("frame_id"))
    rows = function_signals.join(signals, "signal", "left")
    if frames is None:
        return rows.withColumn("status", F.when(F.col("frame_id").isNull(), "missing").otherwise("available")).drop("frame_id")
    some = decode_status(frames, catalog.message_table(spark)).where("n_decodable > 0").select("frame_id", F.lit(True).alias("__has"))
    status = F.when(F.col("frame_id").isNull(), "missing").when(F.col("__has").isNull(), "nodata").otherwise("available")
    return rows.join(some, "frame_id", "left").withColumn("status", status).drop("frame_id", "__has")


def constant_runs(ticks: DataFrame, chunk_seconds: float = 600.0) -> DataFrame:
    """ticks(log_id, t, sampled) -> (log_id, start, end, ticks): spans of ticks in which no signal is recorded anew; a new
    span starts at each sampled tick."""
    rows = ticks.select("log_id", "t", "sampled").withColumn("seq", F.lit(0))
    marked = rows.where("sampled").select("log_id", "t", "seq", F.lit("").alias("signal"))
    numbers = _numbered(marked, ["log_id", "signal"], chunk_seconds).select("log_id", "t", (F.col("nth") + 1).alias("run"))
    from framelake.operators.align import hold

    held = hold(rows.join(numbers, ["log_id", "t"], "left"), ["run"], chunk_seconds)
    return held.groupBy("log_id", F.coalesce("cur_run", F.lit(0)).alias("run")).agg(F.min("t").alias("start"), F.max("t").alias("end"), F.count("*").alias("ticks")).drop("run")
