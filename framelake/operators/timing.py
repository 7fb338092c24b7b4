"""Timing of messages and of the bus: gaps, period statistics, load, silence, and what traffic lies inside a gap.

Message timing is per (log, id, channel); bus timing merges channels. Every order is (t, seq).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelake.functions.bits import frame_bits
from framelake.operators.align import chunk_of, previous
from framelake.operators.decode import data_frames

MESSAGE = ["log_id", "frame_id", "channel"]


#: Seconds of a chunk of time, where a caller names none: what a task looks at in one piece.
CHUNK = 600.0


def deltas(frames: DataFrame, keys: list[str], chunk_seconds: float = CHUNK) -> DataFrame:
    """Data frames with before (the previous instant of the same keys) and delta; in chunks of time."""
    return previous(data_frames(frames), keys, {"t": "before"}, chunk_seconds).withColumn("delta", F.col("t") - F.col("before"))


#: Bins of an octave into which values are sorted before their order is looked at.
BINS = 4096


def quantiles(rows: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """(keys..., one column for each share): exact quantiles of values that aren't negative, interpolated between neighbours.

    Equal values are counted first, before any shuffle; then values are counted by bins of their logarithm. A wanted rank
    names a bin, and only values in such bins (of which a key has two for each share at most) are put in order. So no
    task holds a key's values."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("__v")).agg(F.count("*").alias("__n"))
    counts = counts.withColumn("__bin", F.when(F.col("__v") > 0, F.floor(F.log2("__v") * BINS)).otherwise(F.lit(-(1 << 40))))
    bins = counts.groupBy(*keys, "__bin").agg(F.sum("__n").alias("__m"))
    upto = F.sum("__m").over(Window.partitionBy(*keys).orderBy("__bin").rowsBetween(Window.unboundedPreceding, 0))
    placed = bins.withColumn("__under", upto - F.col("__m")).withColumn("__all", F.sum("__m").over(Window.partitionBy(*keys)))
    rank = lambda share: F.lit(float(share)) * (F.col("__all") - 1)
    holds = lambda r, under, n: (r >= F.col(under)) & (r < F.col(under) + F.col(n))
    wanted = F.lit(False)
    for share in shares.values():
        wanted = wanted | holds(F.floor(rank(share)), "__under", "__m") | holds(F.ceil(rank(share)), "__under", "__m")
    chosen = placed.where(wanted).select(*keys, "__bin", "__under", "__all")
    within = F.sum("__n").over(Window.partitionBy(*keys, "__bin").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0))
    ranked = counts.join(chosen, [*keys, "__bin"]).withColumn("__from", F.col("__under") + within - F.col("__n"))
    at = lambda r: F.max(F.when(holds(r, "__from", "__n"), F.col("__v")))
    ends = [c for name, share in shares.items() for c in (at(F.floor(rank(share))).alias(f"__low_{name}"), at(F.ceil(rank(share))).alias(f"__high_{name}"))]
    found = ranked.groupBy(*keys).agg(F.max("__all").alias("__all"), *ends)
    part = lambda share: rank(share) - F.floor(rank(share))
    return found.select(*keys, *((F.col(f"__low_{n}") * (1 - part(p)) + F.col(f"__high_{n}") * part(p)).alias(n) for n, p in shares.items()))


def period_stats(frames: DataFrame, keys: list[str] = MESSAGE, chunk_seconds: float = CHUNK) -> DataFrame:
    """Frames, first and last instant, and inter-arrival statistics in milliseconds (population deviation)."""
    rows = deltas(frames, keys, chunk_seconds).select(*keys, "t", (F.col("delta") * 1000).alias("ms"))
    whole = rows.groupBy(*keys).agg(
        F.count("*").alias("n_frames"), F.min("t").alias("first_t"), F.max("t").alias("last_t"), F.avg("ms").alias("mean_ms"), F.min("ms").alias("min_ms"), F.max("ms").alias("max_ms"), F.stddev_pop("ms").alias("std_ms")
    )
    found = whole.join(quantiles(rows, keys, "ms", {"median_ms": 0.5, "p99_ms": 0.99}), keys, "left")
    return found.select(*keys, "n_frames", "first_t", "last_t", "median_ms", "mean_ms", "min_ms", "max_ms", "p99_ms", "std_ms")


def rate(n: Column, first: Column, last: Column) -> Column:
    """Frames a second, null without a span."""
    return F.when(last > first, (n - 1) / (last - first))


def base_period(stats: DataFrame, periods: DataFrame | None, tolerance: float) -> DataFrame:
    """stats with dbc_ms and base_ms: the schema's period, or the measured median where there is none or the median is
    off by more than the tolerance."""
    known = stats if periods is None else stats.join(periods.select("frame_id", F.col("cycle_time_ms").alias("dbc_ms")), "frame_id", "left")
    known = known if periods is not None else known.withColumn("dbc_ms", F.lit(None).cast("double"))
    off = F.abs(F.col("median_ms") - F.col("dbc_ms")) / F.col("dbc_ms") > tolerance
    return known.withColumn("base_ms", F.when(F.col("dbc_ms").isNull() | (F.col("dbc_ms") <= 0) | off, F.coalesce("median_ms", "dbc_ms")).otherwise(F.col("dbc_ms")))


def missing(gap: Column, base: Column) -> Column:
    """Frames that a gap lacks, at least one; halves round to even."""
    return F.greatest(F.lit(1.0), F.rint(gap / base) - 1).cast("long")


def message_gaps(frames: DataFrame, bases: DataFrame, factor: float, chunk_seconds: float = CHUNK) -> DataFrame:
    """Gaps of more than base_ms * factor: (keys..., start, end, gap_ms, missing, base_ms)."""
    rows = deltas(frames, MESSAGE, chunk_seconds).where("before is not null").join(F.broadcast(bases.select(*MESSAGE, "base_ms")), MESSAGE)  # a row for each message and channel
    gap = F.col("delta") * 1000
    return rows.where((F.col("base_ms") > 0) & (gap > F.col("base_ms") * factor)).select(*MESSAGE, F.col("before").alias("start"), F.col("t").alias("end"), gap.alias("gap_ms"), missing(gap, F.col("base_ms")).alias("missing"), "base_ms")


def bursts(frames: DataFrame, bases: DataFrame, chunk_seconds: float = CHUNK) -> DataFrame:
    """Per id: arrivals less than a quarter of the base period after the one before; ids without any are left out."""
    rows = deltas(frames, MESSAGE, chunk_seconds).join(F.broadcast(bases.select(*MESSAGE, "base_ms")), MESSAGE)
    counts = rows.groupBy("log_id", "frame_id").agg(F.count_if(F.col("delta") * 1000 < 0.25 * F.col("base_ms")).alias("bursts"))
    return counts.where("bursts > 0")


def log_bounds(frames: DataFrame) -> DataFrame:
    return data_frames(frames).groupBy("log_id").agg(F.min("t").alias("log_start"), F.max("t").alias("log_end"))


def stop_late(frames: DataFrame, bases: DataFrame) -> DataFrame:
    """(keys..., stopped, late, silent_s, late_s, first_t, last_t, log_start, log_end, base_ms): messages that end well before the log or begin well after it does."""
    bound = F.greatest(5 * F.col("base_ms") / 1000, F.lit(0.5))
    rows = bases.join(F.broadcast(log_bounds(frames)), "log_id")  # a row per log
    rows = rows.withColumn("silent_s", F.col("log_end") - F.col("last_t")).withColumn("late_s", F.col("first_t") - F.col("log_start"))
    return rows.select(*MESSAGE, (F.col("silent_s") > bound).alias("stopped"), (F.col("late_s") > bound).alias("late"), "silent_s", "late_s", "first_t", "last_t", "log_start", "log_end", "base_ms")


def counts_before(frames: DataFrame, keys: list[str] = ["log_id"], chunk_seconds: float = CHUNK) -> DataFrame:  # noqa: B006
    """(keys..., t, upto, under): data frames at or before each instant, and before it; in chunks of time."""
    at = data_frames(frames).groupBy(*keys, "t").agg(F.count("*").alias("n")).withColumn("chunk", chunk_of(F.col("t"), chunk_seconds))
    sums = at.groupBy(*keys, "chunk").agg(F.sum("n").alias("n"))
    earlier = Window.partitionBy(*keys).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(*keys, "chunk", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("__base"))
    upto = F.sum("n").over(Window.partitionBy(*keys, "chunk").orderBy("t").rowsBetween(Window.unboundedPreceding, 0))
    return at.join(base, [*keys, "chunk"]).withColumn("upto", F.col("__base") + upto).select(*keys, "t", "upto", (F.col("upto") - F.col("n")).alias("under"))


def with_traffic(gaps: DataFrame, counts: DataFrame) -> DataFrame:
    """gaps(log_id, start, end, ...) with inside: bus frames strictly between start and end. Both ends are instants of
    frames, so two equi-joins replace a range join."""
    first = counts.select("log_id", F.col("t").alias("start"), F.col("upto").alias("__from"))
    last = counts.select("log_id", F.col("t").alias("end"), F.col("under").alias("__to"))
    return gaps.join(first, ["log_id", "start"]).join(last, ["log_id", "end"]).withColumn("inside", F.col("__to") - F.col("__from")).drop("__from", "__to")


def errors_near(gaps: DataFrame, frames: DataFrame, slack: float = 0.05, chunk_seconds: float = CHUNK) -> DataFrame:
    """(gap columns..., what, n): communication events within slack of a gap, counted by what they say.

    No gap meets an event: of each kind that a log has (a few), the events up to a gap's end are counted, and those before its
    start, by running counts in chunks of time; their difference is what lies between."""
    events = frames.where("kind <> 'data'").groupBy("log_id", F.coalesce("error_type", "state", "kind").alias("what"), "t").agg(F.count("*").alias("__n"))
    kinds = events.select("log_id", "what").distinct()
    ends = F.array(F.struct((F.col("start") - slack).alias("t"), F.lit(-1).alias("__side")), F.struct((F.col("end") + slack).alias("t"), F.lit(1).alias("__side")))
    asked = gaps.distinct().join(F.broadcast(kinds), "log_id").select(F.struct(*gaps.columns).alias("__gap"), "log_id", "what", F.inline(ends))
    none = F.lit(None).cast(asked.schema["__gap"].dataType)
    both = asked.withColumn("__n", F.lit(0).cast("long")).unionByName(events.select(none.alias("__gap"), "log_id", "what", "t", F.lit(0).alias("__side"), "__n"))
    both = both.withColumn("__chunk", chunk_of(F.col("t"), chunk_seconds))
    keys = ["log_id", "what"]
    sums = both.groupBy(*keys, "__chunk").agg(F.sum("__n").alias("__m"))
    earlier = Window.partitionBy(*keys).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(*keys, "__chunk", F.coalesce(F.sum("__m").over(earlier), F.lit(0)).alias("__base"))
    inside = F.sum("__n").over(Window.partitionBy(*keys, "__chunk").orderBy("t", "__side").rowsBetween(Window.unboundedPreceding, 0))
    counted = both.join(base, [*keys, "__chunk"]).withColumn("__upto", F.col("__base") + inside).where("__gap is not null")
    found = counted.groupBy("__gap", "what").agg(F.sum(F.col("__upto") * F.col("__side")).alias("n")).where("n > 0")
    return found.select("__gap.*", "what", "n")


def binned(rows: DataFrame, keys: list[str], seconds: float, weight: Column) -> DataFrame:
    """(keys..., bin, bins, span, start, weight): bins of equal width over each group's own span, about `seconds` wide
    (their number is rounded up), the last one closed."""
    spans = rows.groupBy(*keys).agg(F.min("t").alias("start"), F.max("t").alias("end"))
    spans = spans.withColumn("span", F.col("end") - F.col("start")).withColumn("bins", F.greatest(F.ceil(F.col("span") / seconds), F.lit(1)).cast("long"))
    at = F.least(F.floor((F.col("t") - F.col("start")) / (F.col("span") / F.col("bins"))), F.col("bins") - 1)
    placed = rows.withColumn("__w", weight).join(F.broadcast(spans.drop("end")), keys).where("span > 0").withColumn("bin", at.cast("long"))
    return placed.groupBy(*keys, "bin", "bins", "span", "start").agg(F.sum("__w").alias("weight"))


def bus_load(frames: DataFrame, baud: float = 500_000, seconds: float = 0.1) -> DataFrame:
    """(log_id, channel, n_frames, mean_load, peak_load) in per cent; the peak is the fullest bin over the nominal
    window, the mean 0 where a channel has no span."""
    rows = data_frames(frames)
    bits = frame_bits(F.col("dlc"), F.col("is_extended"))
    whole = rows.groupBy("log_id", "channel").agg(F.count("*").alias("n_frames"), F.sum(bits).alias("bits"), (F.max("t") - F.min("t")).alias("span"))
    peak = binned(rows, ["log_id", "channel"], seconds, bits).groupBy("log_id", "channel").agg(F.max("weight").alias("most"))
    mean = F.when(F.col("span") > 0, F.col("bits") / (baud * F.col("span")) * 100).otherwise(0.0)
    joined = whole.join(peak, ["log_id", "channel"], "left")
    return joined.select("log_id", "channel", "n_frames", mean.alias("mean_load"), F.coalesce(F.col("most") / (baud * seconds) * 100, F.lit(0.0)).alias("peak_load"))


def silence(frames: DataFrame, seconds: float = 0.5, chunk_seconds: float = CHUNK) -> DataFrame:
    """(log_id, start, end, gap): gaps between consecutive bus frames, across channels; in chunks of time."""
    at = data_frames(frames).select("log_id", "t").distinct().withColumn("chunk", chunk_of(F.col("t"), chunk_seconds))
    ends = at.groupBy("log_id", "chunk").agg(F.max("t").alias("__last"))
    ends = ends.select("log_id", "chunk", F.lag("__last").over(Window.partitionBy("log_id").orderBy("chunk")).alias("__before"))
    before = F.coalesce(F.lag("t").over(Window.partitionBy("log_id", "chunk").orderBy("t")), F.col("__before"))
    gaps = at.join(ends, ["log_id", "chunk"]).select("log_id", before.alias("start"), F.col("t").alias("end"))
    return gaps.withColumn("gap", F.col("end") - F.col("start")).where(F.col("gap") > seconds)


def longest_runs(rows: DataFrame, keys: list[str], value: str, chunk_seconds: float = CHUNK) -> DataFrame:
    """(keys..., n, changes, run_start, run_end, run_length) of rows(keys..., t, seq, value): the longest stretch of
    equal consecutive values, by samples; the earliest of equally long ones.

    Runs are found within chunks of time, in one sort: where one begins, the one before has ended. A small row a chunk has
    its first and its last run and the longest of the others. Only the first and the last may go on in the neighbours:
    over all chunks these are put in order, and joined where their values are equal."""
    order = Window.partitionBy(*keys, "__chunk").orderBy("t", "seq")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    place = F.struct("t", "seq")
    marked = rows.select(*keys, "t", "seq", F.col(value).alias("__v"), chunk_of(F.col("t"), chunk_seconds).alias("__chunk"))
    marked = marked.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys, "__chunk")  # few bytes a row: Spark would join these into large tasks
    marked = marked.withColumns({"__nth": F.row_number().over(order), "__new": ~F.col("__v").eqNullSafe(F.lag("__v").over(order)), "__before": F.lag(place).over(order)})
    marked = marked.withColumns({"__n": F.count("*").over(whole), "__final": F.last(place).over(whole)})
    runs = marked.where("__nth = 1 or __new").withColumns({"__next": F.lead("__nth").over(order), "__ended": F.lead("__before").over(order)})
    length = F.coalesce(F.col("__next"), F.col("__n") + 1) - F.col("__nth")
    runs = runs.select(*keys, "__chunk", "__v", (F.col("__nth") > 1).alias("__later"), F.col("__next").isNotNull().alias("__inner"), length.alias("length"), place.alias("start"), F.coalesce("__ended", "__final").alias("end"))
    run, inner = F.struct("__v", "length", "start", "end"), F.col("__later") & F.col("__inner")
    best = lambda which: F.min_by(F.struct("start", "end", "length"), F.when(which, F.struct((-F.col("length")).alias("size"), "start")))
    chunks = runs.groupBy(*keys, "__chunk").agg(
        F.count("*").alias("__runs"), F.min_by(run, "start").alias("__a"), F.max_by(run, "start").alias("__z"), F.sum(F.when(inner, F.col("length"))).alias("samples"), best(inner).alias("__most")
    )
    within = chunks.where("__runs > 2").select(*keys, "__most.length", "__most.start", "__most.end", "samples", (F.col("__runs") - 2).alias("runs"))
    ends = F.when(F.col("__runs") > 1, F.array("__a", "__z")).otherwise(F.array("__a"))
    edges, outer = chunks.select(*keys, "__chunk", F.posexplode(ends).alias("__pos", "__r")).select(*keys, "__chunk", "__pos", "__r.*"), Window.partitionBy(*keys).orderBy("__chunk", "__pos")
    goes_on = F.col("__v").eqNullSafe(F.lag("__v").over(outer)) & (F.col("__chunk") != F.lag("__chunk").over(outer))
    edges = edges.withColumn("__new", F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1))
    edges = edges.withColumn("__run", F.sum("__new").over(outer.rowsBetween(Window.unboundedPreceding, 0)))
    edges = edges.groupBy(*keys, "__run").agg(F.sum("length").alias("length"), F.min("start").alias("start"), F.max("end").alias("end"))
    every = edges.select(*keys, "length", "start", "end", F.col("length").alias("samples"), F.lit(1).cast("long").alias("runs")).unionByName(within)
    found = every.groupBy(*keys).agg(F.sum("samples").alias("n"), (F.sum("runs") - 1).alias("changes"), best(F.lit(True)).alias("r"))
    return found.select(*keys, "n", "changes", F.col("r.start.t").alias("run_start"), F.col("r.end.t").alias("run_end"), F.col("r.length").alias("run_length"))


def stuck_bound(span: Column) -> Column:
    """Seconds after which something that doesn't change counts as stuck."""
    return F.greatest(F.lit(1.0), F.least(0.25 * span, F.lit(10.0)))
