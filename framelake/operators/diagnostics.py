"""Checks of a bus, its messages and its signals; each gives findings in one schema.

finding: (log_id, check, severity, title, explanation, confidence, suggestion, time_start, time_end, entities, evidence, value);
evidence is a short array of (t, id), the instants to look at, id null where it means the bus.
"""

from __future__ import annotations

import functools
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelake.operators import timing
from framelake.operators.align import previous
from framelake.operators.decode import byte_values, data_frames, nibbles, samples
from framelake.plans.catalog import Catalog
from framelake.sources.places import staged

SEVERITIES = ("critical", "error", "warn", "info")
# Names that say what a signal is.
COUNTER_NAME = r"(?i)(rolling|alive|counter|cntr|msgcnt|_cnt|\bcnt\b|_alv|_rc\b)"
CHECKSUM_NAME = r"(?i)(checksum|chksum|chks|crc|_cs\b)"


@dataclass(frozen=True)
class Config:
    """Thresholds; those of time in seconds unless the name says milliseconds."""

    baud: float = 500_000
    load_critical: float = 70.0
    load_warn: float = 50.0
    load_window: float = 0.1
    silence: float = 0.5
    tolerance: float = 0.25
    storm_count: int = 10
    storm_window: float = 0.1
    offline_factor: float = 3.0
    near: float = 0.05
    chunk: float = timing.CHUNK  # of time, which a task looks at in one piece
    periods: dict[int, float] = field(default_factory=dict)
    nodes: dict[str, tuple[int, ...]] = field(default_factory=dict)

    @classmethod
    def of(cls, catalog: Catalog, **changes) -> Config:
        """Periods and nodes as the schema has them."""
        nodes: dict[str, list[int]] = {}
        for message in catalog.messages:
            for node in message.senders:
                nodes.setdefault(node, []).append(message.frame_id)
        return cls(periods={m.frame_id: m.cycle_ms for m in catalog.messages if m.cycle_ms}, nodes={n: tuple(i) for n, i in nodes.items()}, **changes)

    def node_period(self, node: str) -> float:
        """Milliseconds: the shortest period of the node's messages, 100 where none is known."""
        return min((self.periods[i] for i in self.nodes[node] if i in self.periods), default=100.0)


#: What to do about a finding of each check.
ADVICE = {
    "bus_load": "lower the rates of periodic messages, or spread them over more buses or a faster one",
    "periodicity": "look at the sending node around that time: restarts, blocked tasks, arbitration lost to urgent messages",
    "bus_silence": "tell a sleeping or unpowered bus from a recorder that was cut off",
    "node_offline": "check the node's power, connector and transceiver, and whether the recording has its channel",
    "error_frame": "look for a faulty node, shielding, ground or disturbances from outside",
    "error_state_machine": "check the transceiver and wiring of the node that counts errors; leaving bus-off takes a reset",
    "baud_mismatch": "measure bit widths and compare bit rate and sample point of the nodes",
    "termination_wiring": "measure the resistance between both lines and look at the levels for reflections",
    "msg_period": "compare the schema's cycle time with what the sender is meant to do; event messages have none",
    "msg_gap": "where others went on sending, look at the sender at that time; else at power and recorder",
    "msg_burst": "look for a second sender of the id, a gateway that sends it back, or events on top of the cycle",
    "msg_stop": "find what happened to the sender at its last frame: power, reset, or bus-off without recovery",
    "msg_late": "check when the sender wakes up and whether the recording began before it",
    "msg_dlc": "compare the sender's version with the schema's",
    "msg_multichannel": "find out whether a gateway forwards the message or the recording joins two taps",
    "msg_payload_stuck": "see whether the sender still fills in its signals; without a counter frozen data go unnoticed",
    "msg_error_nearby": "see whether the errors stopped the message or both have one cause",
    "msg_decode": "use the schema of this vehicle's version, or its other length variant",
    "msg_absent": "check the id and its base, or whether this recording has the bus it is on",
    "msg_raw_counter": "see whether frames were lost or the sender restarted at that time",
    "sig_constant": "if it should follow what the vehicle does, see whether the sender fills it in",
    "sig_stuck": "compare with related signals during that time",
    "sig_range": "check scale and bounds of the schema, and the sender's invalid values",
    "sig_enum_invalid": "add the values to the schema, or find out why the sender uses reserved ones",
    "sig_counter": "see whether frames were lost, or the sender restarted or stopped its task",
    "sig_checksum": "see whether the sender computes it at all",
}


def finding(rows: DataFrame, check: str, severity: Column | str, title: Column, start: Column | None = None, end: Column | None = None, entities: Column | None = None, value: Column | None = None, why: Column | None = None, evidence: Column | None = None, confidence: float = 1.0) -> DataFrame:
    of = lambda c, kind: (c if c is not None else F.lit(None)).cast(kind)
    return rows.select(
        "log_id", F.lit(check).alias("check"), (F.lit(severity) if isinstance(severity, str) else severity).alias("severity"), title.alias("title"), (title if why is None else why).alias("explanation"),
        F.lit(float(confidence)).alias("confidence"), F.lit(ADVICE.get(check, "")).alias("suggestion"), of(start, "double").alias("time_start"), of(end, "double").alias("time_end"),
        F.coalesce(of(entities, "array<string>"), F.array().cast("array<string>")).alias("entities"), F.coalesce(of(evidence, EVIDENCE), F.array().cast(EVIDENCE)).alias("evidence"), of(value, "double").alias("value"),
    )


EVIDENCE = "array<struct<t:double,id:bigint>>"


def seen_at(*instants: Column | str, ident: Column | str | None = None) -> Column:
    """Evidence: frames of an id (or of the bus) at some instants."""
    of = F.lit(None).cast("long") if ident is None else F.col(ident) if isinstance(ident, str) else ident
    return F.array(*(F.struct((F.col(t) if isinstance(t, str) else t).cast("double").alias("t"), of.cast("long").alias("id")) for t in instants))


def the_bus() -> Column:
    return F.array(F.lit("bus"))


def hex_id(frame_id: Column | str) -> Column:
    return F.concat(F.lit("0x"), F.hex(frame_id))


def periods_table(frames: DataFrame, config: Config) -> DataFrame:
    rows = [(i, float(p)) for i, p in config.periods.items()]
    return frames.sparkSession.createDataFrame(rows, "frame_id long, cycle_time_ms double")


# --- bus ---------------------------------------------------------------------------------------------------------


def check_load(frames: DataFrame, config: Config) -> DataFrame:
    most = F.greatest("mean_load", "peak_load")
    severity = F.when(most >= config.load_critical, "critical").when(most >= config.load_warn, "warn")
    rows = timing.bus_load(frames, config.baud, config.load_window).withColumn("severity", severity).where("severity is not null")
    title = F.format_string("channel %d: mean load %.2f %%, peak %.2f %%", "channel", "mean_load", "peak_load")
    why = F.format_string("frames fill %.2f %% of the time on average and %.2f %% at most, at %s bits a second", "mean_load", "peak_load", F.lit(f"{config.baud:g}"))
    return finding(rows, "bus_load", F.col("severity"), title, entities=F.array(F.col("channel").cast("string")), value=F.round("peak_load", 2), why=why)


def periodicity(frames: DataFrame, config: Config) -> DataFrame:
    """(log_id, frame_id, start, end, gap_ms, missing): gaps beyond the schema's period, all channels merged."""
    rows = timing.deltas(frames, ["log_id", "frame_id"], config.chunk).where("before is not null").join(periods_table(frames, config), "frame_id")
    gap = F.col("delta") * 1000
    late = rows.where(gap > F.col("cycle_time_ms") * (1 + config.tolerance))
    return late.select("log_id", "frame_id", F.col("before").alias("start"), F.col("t").alias("end"), gap.alias("gap_ms"), timing.missing(gap, F.col("cycle_time_ms")).alias("missing"), "cycle_time_ms")


def check_periodicity(frames: DataFrame, config: Config) -> DataFrame:
    title = F.format_string("%s silent for %.1f ms, about %d frames missing", hex_id("frame_id"), "gap_ms", "missing")
    why = F.format_string("due every %.0f ms, came after %.1f ms", "cycle_time_ms", "gap_ms")
    return finding(periodicity(frames, config), "periodicity", "warn", title, F.col("start"), F.col("end"), F.array(hex_id("frame_id")), F.col("gap_ms"), why, seen_at("start", "end", ident="frame_id"))


def check_silence(frames: DataFrame, config: Config) -> DataFrame:
    rows = timing.silence(frames, config.silence, config.chunk)
    why = F.format_string("no channel has a frame between %.3f and %.3f s", "start", "end")
    return finding(rows, "bus_silence", "error", F.format_string("no frame for %.3f s", "gap"), F.col("start"), F.col("end"), the_bus(), F.col("gap"), why, seen_at("start", "end"))


def node_table(frames: DataFrame, config: Config) -> DataFrame:
    rows = [(n, i, config.node_period(n)) for n, ids in config.nodes.items() for i in ids]
    return frames.sparkSession.createDataFrame(rows, "node string, frame_id long, period_ms double")


def node_gaps(frames: DataFrame, config: Config) -> tuple[DataFrame, DataFrame]:
    """(gaps, unseen): spans (log_id, node, start, end, gap) without a frame of a node while others sent, and nodes of
    which a log has no frame at all (log_id, node)."""
    nodes = node_table(frames, config)
    sent = data_frames(frames).join(nodes, "frame_id")
    sent = sent.select("log_id", "node", "period_ms", "t", "seq", "kind")
    gaps = previous(sent, ["log_id", "node"], {"t": "start"}, config.chunk).withColumn("end", F.col("t"))
    gaps = gaps.withColumn("gap", F.col("end") - F.col("start")).where(F.col("gap") * 1000 > F.col("period_ms") * config.offline_factor)
    # Frames of others within [start, end]: all frames of the closed span, less the node's own at its ends.
    both = timing.counts_before(frames, chunk_seconds=config.chunk)
    own = timing.counts_before(sent, ["log_id", "node"], config.chunk)
    first = both.select("log_id", F.col("t").alias("start"), F.col("under").alias("__a")).join(own.select("log_id", "node", F.col("t").alias("start"), F.col("under").alias("__own_a")), ["log_id", "start"])
    last = both.select("log_id", F.col("t").alias("end"), F.col("upto").alias("__b")).join(own.select("log_id", "node", F.col("t").alias("end"), F.col("upto").alias("__own_b")), ["log_id", "end"])
    gaps = gaps.join(first, ["log_id", "node", "start"]).join(last, ["log_id", "node", "end"])
    alive = gaps.where(F.col("__b") - F.col("__a") > F.col("__own_b") - F.col("__own_a")).select("log_id", "node", "start", "end", "gap")
    logs = data_frames(frames).select("log_id").distinct()
    every = logs.withColumn("node", F.explode(F.array(*(F.lit(n) for n in config.nodes)))) if config.nodes else logs.withColumn("node", F.lit("")).limit(0)
    return alive, every.join(sent.select("log_id", "node").distinct(), ["log_id", "node"], "left_anti")


def check_nodes(frames: DataFrame, config: Config) -> DataFrame:
    gaps, unseen = node_gaps(frames, config)
    ids, first = F.lit(None).cast("string"), F.lit(None).cast("long")
    for node, sends in config.nodes.items():
        ids = F.when(F.col("node") == node, ", ".join(f"0x{i:X}" for i in sends[:8]) + ("" if len(sends) <= 8 else ", ...")).otherwise(ids)
        first = F.when(F.col("node") == node, F.lit(sends[0]) if sends else F.lit(None)).otherwise(first)
    one = finding(unseen, "node_offline", "error", F.format_string("node %s sent nothing", "node"), entities=F.array("node"), why=F.concat(F.lit("the recording has none of its messages: "), ids))
    why = F.format_string("none of its messages between %.3f and %.3f s, while other nodes sent", "start", "end")
    return one.unionByName(finding(gaps, "node_offline", "error", F.format_string("node %s silent for %.3f s while others sent", "node", "gap"), F.col("start"), F.col("end"), F.array("node"), F.col("gap"), why, seen_at("start", ident=first)))


def error_storms(frames: DataFrame, config: Config) -> DataFrame:
    """(log_id, start, end, n): bins of a log's error frames with at least storm_count of them."""
    errors = frames.where("kind = 'error'")
    bins = timing.binned(errors, ["log_id"], config.storm_window, F.lit(1))
    width = F.col("span") / F.col("bins")
    storms = bins.where(F.col("weight") >= config.storm_count)
    return storms.select("log_id", (F.col("start") + F.col("bin") * width).alias("begin"), (F.col("start") + (F.col("bin") + 1) * width).alias("end"), F.col("weight").cast("long").alias("n")).withColumnRenamed("begin", "start")


def error_types(frames: DataFrame) -> DataFrame:
    kind = F.when(F.coalesce("error_type", F.lit("")) == "", "other").otherwise(F.col("error_type"))
    return frames.where("kind = 'error'").groupBy("log_id", kind.alias("error_type")).agg(F.count("*").alias("n"))


def check_errors(frames: DataFrame, config: Config) -> DataFrame:
    storms = error_storms(frames, config)
    why = F.format_string("%d error frames between %.3f and %.3f s", "n", "start", "end")
    storm = finding(storms, "error_frame", "critical", F.format_string("error storm: %d error frames", "n"), F.col("start"), F.col("end"), the_bus(), F.col("n"), why, seen_at("start"))
    told = error_types(frames).groupBy("log_id").agg(F.sum("n").alias("n"), F.array_sort(F.collect_list(F.format_string("%s x%d", "error_type", "n"))).alias("types"))
    few = told.join(storms.select("log_id").distinct(), "log_id", "left_anti")
    return storm.unionByName(finding(few, "error_frame", "warn", F.format_string("%d scattered error frames", "n"), entities=the_bus(), value=F.col("n"), why=F.concat(F.lit("by kind: "), F.array_join("types", ", "))))


def first_states(frames: DataFrame) -> DataFrame:
    """(log_id, state, t, channel): where each error state is first reached."""
    rows = frames.where("state is not null")
    return rows.groupBy("log_id", "state").agg(F.min("t").alias("t"), F.min_by("channel", F.struct("t", "seq")).alias("channel"))


def check_states(frames: DataFrame, config: Config) -> DataFrame:
    rows = first_states(frames).where("state in ('bus_off', 'passive')")
    severity = F.when(F.col("state") == "bus_off", "critical").otherwise("warn")
    why = F.when(F.col("state") == "bus_off", F.format_string("at %.3f s a node had so many errors that it left the bus", "t")).otherwise(F.format_string("at %.3f s a node's error count passed 127", "t"))
    return finding(rows, "error_state_machine", severity, F.format_string("first %s", "state"), F.col("t"), None, the_bus(), F.col("channel"), why, seen_at("t"))


def error_ratios(frames: DataFrame) -> DataFrame:
    """(log_id, total, bit_level, ack): bit_level counts stuff, form, crc and bit errors."""
    return frames.where("kind = 'error'").groupBy("log_id").agg(F.count("*").alias("total"), F.count_if(F.col("error_type").isin("stuff", "form", "crc", "bit")).alias("bit_level"), F.count_if(F.col("error_type") == "ack").alias("ack"))


def check_physical(frames: DataFrame, config: Config) -> DataFrame:
    rows = error_ratios(frames)
    share = F.col("ack") / F.col("total")
    baud = rows.where((F.col("bit_level") / F.col("total") > 0.5) & (F.col("bit_level") > F.col("ack")))
    wiring = rows.where((F.col("ack") > 0) & (F.col("bit_level") > 0) & (share > 0.2) & (share < 0.8))
    told = F.format_string("%d of %d errors are on the level of bits, %d are missing acknowledgements", "bit_level", "total", "ack")
    one = finding(baud, "baud_mismatch", "warn", F.lit("mostly bit-level errors: bit rates may differ"), entities=the_bus(), value=F.col("bit_level") / F.col("total"), why=told, confidence=0.5)
    return one.unionByName(finding(wiring, "termination_wiring", "warn", F.lit("bit-level and acknowledge errors: termination or wiring may be wrong"), entities=the_bus(), value=share, why=told, confidence=0.4))


BUS_CHECKS = (check_load, check_periodicity, check_silence, check_nodes, check_errors, check_states, check_physical)


def union(parts: list[DataFrame]) -> DataFrame:
    return functools.reduce(DataFrame.unionByName, parts)


def severity_order() -> Column:
    return F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("severity"))


def severity_counts(findings: DataFrame) -> DataFrame:
    """(severity, n): a row for each severity, worst first, n 0 where there is no finding."""
    every = findings.sparkSession.createDataFrame([(s,) for s in SEVERITIES], "severity string")
    counts = findings.groupBy("severity").agg(F.count("*").alias("n"))
    return every.join(counts, "severity", "left").select("severity", F.coalesce("n", F.lit(0)).cast("long").alias("n")).orderBy(severity_order())


def bus_findings(frames: DataFrame, config: Config) -> DataFrame:
    """All bus findings, worst first, then latest first. A log without data frames has none."""
    logs = data_frames(frames).select("log_id").distinct()
    return union([check(frames, config) for check in BUS_CHECKS]).join(logs, "log_id", "left_semi").orderBy(severity_order(), F.desc(F.coalesce("time_start", F.lit(0.0))), "check", "title")


def capabilities(frames: DataFrame, with_schema: bool) -> dict[str, bool]:
    """What a log allows to check, by name."""
    row = frames.agg(F.bool_or(F.col("kind") == "error").alias("errors"), F.bool_or(F.col("state").isNotNull() | F.col("tec").isNotNull() | F.col("rec").isNotNull()).alias("states"), (F.max("channel") + 1).alias("channels")).first()
    errors, states = bool(row["errors"]), bool(row["states"])
    return {"bus_load": True, "periodicity": True, "bus_silence": True, "node_offline": True, "messages": True, "signals": with_schema, "error_frame": errors, "baud_mismatch": errors, "termination_wiring": errors, "error_state_machine": states}


# --- messages ----------------------------------------------------------------------------------------------------


def bases(frames: DataFrame, config: Config) -> DataFrame:
    return timing.base_period(timing.period_stats(frames, chunk_seconds=config.chunk), periods_table(frames, config), config.tolerance)


def gap_factor(config: Config) -> float:
    return 1 + max(config.tolerance, 0.5)


def message_gaps(frames: DataFrame, config: Config, every: DataFrame | None = None) -> DataFrame:
    """Gaps of messages with the bus frames inside them, counted among `every` (else among frames)."""
    return timing.with_traffic(timing.message_gaps(frames, bases(frames, config), gap_factor(config), config.chunk), timing.counts_before(frames if every is None else every, chunk_seconds=config.chunk))


def check_message_gaps(frames: DataFrame, config: Config, most: int = 10, every: DataFrame | None = None, gaps: DataFrame | None = None) -> DataFrame:
    """The longest gaps of each id; where there are more, a summary says how many frames are missing in all. gaps: what
    message_gaps() gives, if it is at hand."""
    gaps = message_gaps(frames, config, every) if gaps is None else gaps
    by_length = Window.partitionBy("log_id", "frame_id").orderBy(F.desc("gap_ms"), "start", "channel")
    longest = gaps.withColumn("nth", F.row_number().over(by_length)).where(F.col("nth") <= most)
    traffic = F.when(F.col("inside") > 0, F.format_string("%d frames of others lie between", "inside")).otherwise("the bus was silent too")
    why = F.concat(F.format_string("due every %.1f ms, about %d frames are missing; ", "base_ms", "missing"), traffic)
    one = finding(longest, "msg_gap", F.when(F.col("inside") > 0, "error").otherwise("warn"), F.format_string("%s missing for %.1f ms", hex_id("frame_id"), "gap_ms"), F.col("start"), F.col("end"), F.array(hex_id("frame_id")), F.col("missing"), why, seen_at("start", "end", ident="frame_id"))
    many = gaps.groupBy("log_id", "frame_id").agg(F.count("*").alias("n"), F.sum("missing").alias("missing"), F.min("start").alias("start"), F.max("end").alias("end")).where(F.col("n") > most)
    why = F.format_string("of %d gaps the %d longest are listed", "n", F.lit(most))
    return one.unionByName(finding(many, "msg_gap", "error", F.format_string("%s: %d gaps, %d frames missing", hex_id("frame_id"), "n", "missing"), F.col("start"), F.col("end"), F.array(hex_id("frame_id")), F.col("missing"), why))


def primary(stats: DataFrame) -> DataFrame:
    """Of each id the channel with most frames."""
    nth = F.row_number().over(Window.partitionBy("log_id", "frame_id").orderBy(F.desc("n_frames"), "channel"))
    return stats.withColumn("__nth", nth).where("__nth = 1").drop("__nth")


def check_message_periods(frames: DataFrame, config: Config, base: DataFrame | None = None) -> DataFrame:
    rows = primary(bases(frames, config) if base is None else base)
    off = F.abs(F.col("median_ms") - F.col("dbc_ms")) / F.col("dbc_ms") > config.tolerance
    jitter = F.col("p99_ms") > F.col("dbc_ms") * (1 + config.tolerance)
    what = F.when(F.col("n_frames") == 1, "single frame").when(off, "period differs from the schema").when(jitter, "jitter").when(F.col("dbc_ms").isNull(), "period measured")
    rows = rows.withColumn("what", what).where("what is not null")
    severity = F.when(F.col("what") == "period measured", "info").otherwise("warn")
    shown = lambda c: F.coalesce(F.format_string("%.1f ms", c), F.lit("none"))
    why = F.concat(F.format_string("%d frames; schema: ", "n_frames"), F.when(F.col("dbc_ms").isNull(), "none").otherwise(shown("dbc_ms")), *(F.concat(F.lit(f", {name}: "), F.when(F.col(c).isNull(), "none").otherwise(shown(c))) for name, c in (("median", "median_ms"), ("least", "min_ms"), ("most", "max_ms"), ("99 of 100 below", "p99_ms"))))
    return finding(rows, "msg_period", severity, F.format_string("%s: %s", hex_id("frame_id"), "what"), F.when(F.col("n_frames") == 1, F.col("first_t")), None, F.array(hex_id("frame_id")), F.col("median_ms"), why)


def check_stop_late(frames: DataFrame, config: Config, every: DataFrame | None = None, base: DataFrame | None = None) -> DataFrame:
    rows = timing.stop_late(frames if every is None else every, bases(frames, config) if base is None else base)
    id_ = F.array(hex_id("frame_id"))
    stopped = finding(rows.where("stopped"), "msg_stop", "error", F.format_string("%s ends %.3f s before the log", hex_id("frame_id"), "silent_s"), F.col("last_t"), F.col("log_end"), id_, F.col("silent_s"), F.format_string("last frame at %.3f s, the log ends at %.3f s; due every %.1f ms", "last_t", "log_end", "base_ms"), seen_at("last_t", ident="frame_id"))
    return stopped.unionByName(finding(rows.where("late"), "msg_late", "warn", F.format_string("%s begins %.3f s after the log", hex_id("frame_id"), "late_s"), F.col("log_start"), F.col("first_t"), id_, F.col("late_s"), F.format_string("the log begins at %.3f s, the first frame comes at %.3f s; due every %.1f ms", "log_start", "first_t", "base_ms"), seen_at("first_t", ident="frame_id")))


def check_bursts(frames: DataFrame, config: Config, base: DataFrame | None = None) -> DataFrame:
    rows = timing.bursts(frames, bases(frames, config) if base is None else base, config.chunk)
    return finding(rows, "msg_burst", "warn", F.format_string("%s: %d frames too early", hex_id("frame_id"), "bursts"), entities=F.array(hex_id("frame_id")), value=F.col("bursts"), why=F.format_string("%d frames came less than a quarter of the period after the one before", "bursts"))


def dlc_histogram(frames: DataFrame) -> DataFrame:
    return data_frames(frames).groupBy("log_id", "frame_id", "dlc").agg(F.count("*").alias("n"))


def channels_of(frames: DataFrame) -> DataFrame:
    return data_frames(frames).groupBy("log_id", "frame_id").agg(F.sort_array(F.collect_set("channel")).alias("channels"))


def check_dlc(frames: DataFrame, messages: DataFrame) -> DataFrame:
    rows = dlc_histogram(frames).groupBy("log_id", "frame_id").agg(F.count("*").alias("lengths"), F.max("dlc").alias("dlc")).join(messages.select("frame_id", "length"), "frame_id", "left")
    what = F.when(F.col("lengths") > 1, "several lengths").when(F.col("dlc") != F.col("length"), "length differs from the schema")
    rows = rows.withColumn("what", what).where("what is not null")
    return finding(rows, "msg_dlc", "warn", F.format_string("%s: %s", hex_id("frame_id"), "what"), entities=F.array(hex_id("frame_id")))


def check_channels(frames: DataFrame) -> DataFrame:
    rows = channels_of(frames).where("size(channels) > 1")
    return finding(rows, "msg_multichannel", "info", F.format_string("%s on %d channels", hex_id("frame_id"), F.size("channels")), entities=F.array(hex_id("frame_id")))


def payload_key(data: Column | str = "data") -> Column:
    """Payload padded with zeros, so that lengths don't count."""
    return F.rpad(F.hex(data), 128, "0")


def payload_runs(frames: DataFrame, chunk_seconds: float = timing.CHUNK) -> DataFrame:
    """(log_id, frame_id, n, changes, run_start, run_end, run_length, first_t, last_t) of payloads, channels merged."""
    rows = data_frames(frames).select("log_id", "frame_id", "t", "seq", payload_key().alias("p"))
    bounds = rows.groupBy("log_id", "frame_id").agg(F.min("t").alias("first_t"), F.max("t").alias("last_t"))
    return timing.longest_runs(rows, ["log_id", "frame_id"], "p", chunk_seconds).join(bounds, ["log_id", "frame_id"])


def check_payloads(frames: DataFrame, config: Config = Config()) -> DataFrame:
    rows = payload_runs(frames, config.chunk).withColumn("held", F.col("run_end") - F.col("run_start"))
    id_ = F.array(hex_id("frame_id"))
    whole = rows.where("n >= 3 and changes = 0")
    part = rows.where("changes > 0").where(F.col("held") >= timing.stuck_bound(F.col("last_t") - F.col("first_t")))
    one = finding(whole, "msg_payload_stuck", "warn", F.format_string("%s never changes", hex_id("frame_id")), F.col("first_t"), F.col("last_t"), id_, F.col("held"), F.format_string("all %d payloads are equal", "n"))
    why = F.format_string("%d equal payloads in a row, with %d changes in all", "run_length", "changes")
    return one.unionByName(finding(part, "msg_payload_stuck", "warn", F.format_string("%s unchanged for %.3f s", hex_id("frame_id"), "held"), F.col("run_start"), F.col("run_end"), id_, F.col("held"), why, seen_at("run_start", "run_end", ident="frame_id")))


def check_errors_near(frames: DataFrame, config: Config, most: int = 10, gaps: DataFrame | None = None) -> DataFrame:
    if gaps is None:
        gaps = timing.message_gaps(frames, bases(frames, config), gap_factor(config), config.chunk)
    near = timing.errors_near(gaps.select("log_id", "frame_id", "channel", "start", "end"), frames, config.near, config.chunk)
    near = near.groupBy("log_id", "frame_id", "channel", "start", "end").agg(F.array_sort(F.collect_list(F.format_string("%s x%d", "what", "n"))).alias("what"), F.sum("n").alias("n"))
    first = near.withColumn("nth", F.row_number().over(Window.partitionBy("log_id", "frame_id").orderBy("start", "channel"))).where(F.col("nth") <= most)
    why = F.concat(F.format_string("within %s s of the gap: ", F.lit(f"{config.near:g}")), F.array_join("what", ", "))
    return finding(first, "msg_error_nearby", "error", F.format_string("%s: %d bus errors at a gap", hex_id("frame_id"), "n"), F.col("start"), F.col("end"), F.array(hex_id("frame_id")), F.col("n"), why, seen_at("start", "end", ident="frame_id"))


def check_decode(frames: DataFrame, messages: DataFrame) -> DataFrame:
    rows = data_frames(frames).join(messages.select("frame_id", "length"), "frame_id").groupBy("log_id", "frame_id").agg(F.count("*").alias("n"), F.count_if(F.col("dlc") >= F.col("length")).alias("ok")).where("ok = 0")
    return finding(rows, "msg_decode", "error", F.format_string("%s: none of %d frames can be decoded", hex_id("frame_id"), "n"), entities=F.array(hex_id("frame_id")), value=F.col("n"))


def message_findings(frames: DataFrame, catalog: Catalog, config: Config) -> DataFrame:
    """Findings of all messages, worst first, then earliest first."""
    messages = catalog.message_table(frames.sparkSession)
    base = staged(bases(frames, config))  # a row for each message and channel
    gaps = staged(timing.with_traffic(timing.message_gaps(frames, base, gap_factor(config), config.chunk), timing.counts_before(frames, chunk_seconds=config.chunk)))
    parts = [check_message_periods(frames, config, base), check_message_gaps(frames, config, gaps=gaps), check_bursts(frames, config, base), check_stop_late(frames, config, base=base), check_dlc(frames, messages), check_channels(frames)]
    parts += [check_payloads(frames, config), check_errors_near(frames, config, gaps=gaps), check_decode(frames, messages)]
    return union(parts).orderBy(severity_order(), F.coalesce("time_start", F.lit(0.0)), "check", "title")


def ranking(frames: DataFrame, config: Config, most: int = 30) -> DataFrame:
    """(log_id, frame_id, score, gaps, max_gap_ms, ...): messages that deserve a look, the most suspicious first."""
    base = bases(frames, config)
    gaps = message_gaps(frames, config).groupBy("log_id", "frame_id").agg(F.count("*").alias("gaps"), F.max("gap_ms").alias("max_gap_ms"), F.bool_or(F.col("inside") > 0).alias("busy"))
    stopped = timing.stop_late(frames, base).groupBy("log_id", "frame_id").agg(F.bool_or("stopped").alias("stopped"))
    lengths = dlc_histogram(frames).groupBy("log_id", "frame_id").agg((F.count("*") > 1).alias("mixed"))
    payload = data_frames(frames).groupBy("log_id", "frame_id").agg((F.count_distinct(payload_key()) == 1).alias("constant"), F.count("*").alias("n_frames"))
    main = primary(base).select("log_id", "frame_id", "median_ms", "dbc_ms")
    rows = payload
    for part in (main, stopped, lengths, gaps):
        rows = rows.join(part, ["log_id", "frame_id"], "left")
    n_gaps, on = F.coalesce("gaps", F.lit(0)), lambda c: F.coalesce(c, F.lit(False)).cast("long")
    off = F.abs(F.col("median_ms") - F.col("dbc_ms")) / F.col("dbc_ms") > config.tolerance
    score = 3 * n_gaps + 20 * on(F.col("stopped")) + 8 * on(F.col("mixed")) + 6 * on(F.col("constant") & (F.col("n_frames") > 10)) + 6 * on(off) + 2 * on(F.col("busy")) * F.least(n_gaps, F.lit(10))
    kept = rows.select("log_id", "frame_id", "n_frames", F.round("median_ms", 2).alias("period_ms"), n_gaps.alias("gaps"), F.round(F.coalesce("max_gap_ms", F.lit(0.0)), 1).alias("max_gap_ms"), score.cast("long").alias("score")).where("score > 0")
    return kept.orderBy(F.desc("score"), F.desc("max_gap_ms"), "frame_id").limit(most)


# --- raw fields without a schema ----------------------------------------------------------------------------------


def raw_fields(frames: DataFrame, chunk_seconds: float = timing.CHUNK) -> DataFrame:
    """(log_id, frame_id, byte, field, bits, n, uniques, steps, equal, changes, max_value) of the primary channel's bytes and
    nibbles, as wide as the shortest frame; ids with at least 8 frames."""
    sizes = data_frames(frames).groupBy("log_id", "frame_id", "channel").agg(F.count("*").alias("n"), F.min("dlc").alias("width"))
    nth = F.row_number().over(Window.partitionBy("log_id", "frame_id").orderBy(F.desc("n"), "channel"))
    main = sizes.withColumn("nth", nth).where("nth = 1 and n >= 8").select("log_id", "frame_id", "channel", "width")
    rows = data_frames(frames).where("dlc > 0").join(F.broadcast(main), ["log_id", "frame_id", "channel"])  # a row for each message
    rows = previous(rows.select("log_id", "frame_id", "t", "seq", "data", "width"), ["log_id", "frame_id"], {"data": "last"}, chunk_seconds)
    # Of a byte 65,537 pairs of neighbours at most are left, before any shuffle but that of the frames.
    both = F.arrays_zip(byte_values("data", "width").alias("v"), byte_values("last", "width").alias("last"))
    pairs = rows.where("width > 0").select("log_id", "frame_id", F.posexplode(both).alias("byte", "p")).groupBy("log_id", "frame_id", "byte", "p.v", "p.last").agg(F.count("*").alias("m"))
    now, last = nibbles(F.col("v")), nibbles(F.col("last"))
    fields = F.array(*(F.struct(F.lit(name).alias("field"), F.lit(bits).alias("bits"), now[name].alias("value"), (now[name] - last[name]).alias("step")) for name, bits in (("byte", 8), ("low", 4), ("high", 4))))
    rows = pairs.select("log_id", "frame_id", "byte", "m", F.inline(fields))
    is_step = (F.col("step") == 1) | (F.col("step") == 1 - F.when(F.col("bits") == 8, 256).otherwise(16))
    number = lambda which: F.coalesce(F.sum(F.when(which, F.col("m"))), F.lit(0))
    return rows.groupBy("log_id", "frame_id", "byte", "field", "bits").agg(
        F.sum("m").alias("n"), F.count_distinct("value").alias("uniques"), number(is_step).alias("steps"), number(F.col("step") == 0).alias("equal"), number(F.col("step") != 0).alias("changes")
    )


def raw_counters(fields: DataFrame) -> DataFrame:
    """Fields that count up: of each byte the one with the best share of steps, the narrower of equals."""
    ratio = F.col("steps") / (F.col("n") - 1)
    good = fields.withColumn("ratio", ratio).where((F.col("uniques") >= 4) & (ratio >= 0.55) & ((F.col("steps") + F.col("equal")) / (F.col("n") - 1) >= 0.85))
    nth = F.row_number().over(Window.partitionBy("log_id", "frame_id", "byte").orderBy(F.desc("ratio"), "bits", "field"))
    return good.withColumn("nth", nth).where("nth = 1").select("log_id", "frame_id", "byte", "field", "bits", "ratio")


def checksum_bytes(fields: DataFrame, counters: DataFrame, most: int = 4) -> DataFrame:
    """Other bytes that take many values and change often; the first of them by their share of changes."""
    share = F.col("changes") / (F.col("n") - 1)
    rows = fields.where("field = 'byte' and uniques >= 8").withColumn("ratio", share).where("ratio >= 0.5").join(counters.select("log_id", "frame_id", "byte"), ["log_id", "frame_id", "byte"], "left_anti")
    nth = F.row_number().over(Window.partitionBy("log_id", "frame_id").orderBy(F.desc("ratio"), "byte"))
    return rows.withColumn("nth", nth).where(F.col("nth") <= most).select("log_id", "frame_id", "byte", "ratio", "uniques")


# --- signals -----------------------------------------------------------------------------------------------------

SIGNAL = ["log_id", "message_id", "signal"]


def signal_profiles(values: DataFrame, chunk_seconds: float = timing.CHUNK) -> DataFrame:
    """values as decode.samples() gives them -> (log_id, message_id, signal, n, changes, uniques, minimum, maximum,
    last, constant, run_start, run_end, first_t, last_t)."""
    rows = values.withColumn("shown", F.coalesce("label", F.col("num").cast("string")))
    stats = rows.groupBy(*SIGNAL).agg(
        F.count_distinct("shown").alias("uniques"), F.min(F.when(F.col("label").isNull(), F.col("num"))).alias("minimum"), F.max(F.when(F.col("label").isNull(), F.col("num"))).alias("maximum"),
        F.max_by("shown", F.struct("t", "seq")).alias("last"), F.min("t").alias("first_t"), F.max("t").alias("last_t"),
    )
    runs = timing.longest_runs(rows, SIGNAL, "shown", chunk_seconds)
    return runs.join(stats, SIGNAL).withColumn("constant", F.col("changes") == 0)


def signal_meta(values: DataFrame, catalog: Catalog) -> DataFrame:
    return catalog.signal_table(values.sparkSession).select("message_id", F.col("name").alias("signal"), "minimum", "maximum", (F.size("choices") > 0).alias("enumerated"), F.col("length").alias("bits"))


def signal_entities() -> Column:
    return F.array(hex_id("message_id"), F.col("signal"))


def check_constant(profiles: DataFrame) -> DataFrame:
    rows = profiles.where("constant and n >= 3")
    return finding(rows, "sig_constant", "info", F.format_string("%s never changes", "signal"), F.col("first_t"), F.col("last_t"), signal_entities(), F.col("n"), F.format_string("all %d samples are %s", "n", "last"))


def check_stuck(profiles: DataFrame) -> DataFrame:
    """Held longer than the bound and than ten times its usual time between changes."""
    held, span = F.col("run_end") - F.col("run_start"), F.col("last_t") - F.col("first_t")
    rows = profiles.where("changes > 0").withColumn("held", held).where((held >= timing.stuck_bound(span)) & (held >= 10 * span / F.col("changes")))
    why = F.format_string("%d equal samples in a row, though it changes %d times", "run_length", "changes")
    return finding(rows, "sig_stuck", "warn", F.format_string("%s unchanged for %.3f s", "signal", "held"), F.col("run_start"), F.col("run_end"), signal_entities(), F.col("held"), why, seen_at("run_start", "run_end", ident="message_id"))


def out_of_range(values: DataFrame, catalog: Catalog) -> DataFrame:
    """(keys..., n, first_t, lowest, highest): samples of plain signals beyond their bounds."""
    rows = values.join(signal_meta(values, catalog), ["message_id", "signal"]).where("not enumerated and maximum > minimum")
    rows = rows.where((F.col("num") < F.col("minimum") - 1e-9) | (F.col("num") > F.col("maximum") + 1e-9))
    return rows.groupBy(*SIGNAL).agg(F.count("*").alias("n"), F.min("t").alias("first_t"), F.min("num").alias("lowest"), F.max("num").alias("highest"))


def invalid_labels(values: DataFrame, catalog: Catalog) -> DataFrame:
    """(keys..., n, first_t, raws): samples of enumerated signals whose raw value has no name."""
    rows = values.join(signal_meta(values, catalog), ["message_id", "signal"]).where("enumerated and label is null")
    return rows.groupBy(*SIGNAL).agg(F.count("*").alias("n"), F.min("t").alias("first_t"), F.sort_array(F.collect_set("raw")).alias("raws"))


def counter_steps(values: DataFrame, catalog: Catalog, chunk_seconds: float = timing.CHUNK) -> DataFrame:
    """Samples of counters with their step since the last one: signals named like counters, or that behave so (8 samples
    or more, 4 values or more, 70 % steps)."""
    rows = values.join(signal_meta(values, catalog).select("message_id", "signal", "bits", "enumerated"), ["message_id", "signal"]).where("not enumerated")
    rows = previous(rows, [*SIGNAL, "channel"], {"t": "before", "raw": "last"}, chunk_seconds).withColumn("step", F.col("raw") - F.col("last")).withColumn("modulus", F.expr("shiftleft(1L, bits)"))
    rows = rows.withColumn("is_step", (F.col("step") == 1) | (F.col("step") == 1 - F.col("modulus")))
    about = rows.groupBy(*SIGNAL).agg(F.count("*").alias("n"), F.count_distinct("raw").alias("uniques"), F.count_if("is_step").alias("steps"), F.count("step").alias("pairs"))
    counts = about.where(F.regexp_like("signal", F.lit(COUNTER_NAME)) | ((F.col("n") >= 8) & (F.col("uniques") >= 4) & (F.col("steps") >= 0.7 * F.col("pairs")))).select(*SIGNAL)
    return rows.join(F.broadcast(counts), SIGNAL, "left_semi")  # a row for each signal


def counter_jumps(steps: DataFrame, gaps: DataFrame) -> DataFrame:
    """Steps that are neither one nor none, unless they span a gap of their message: (keys..., channel, t, step)."""
    rows = steps.where("step is not null and step <> 0 and not is_step")
    across = gaps.select("log_id", F.col("frame_id").alias("message_id"), "channel", F.col("start").alias("before")).distinct()
    return rows.join(across, ["log_id", "message_id", "channel", "before"], "left_anti").select(*SIGNAL, "channel", "t", "step")


def counter_freezes(steps: DataFrame, base: DataFrame, chunk_seconds: float = timing.CHUNK) -> DataFrame:
    """Longest stretch without a step, if 0.1 s or five base periods long: (keys..., channel, start, end)."""
    runs = timing.longest_runs(steps, [*SIGNAL, "channel"], "raw", chunk_seconds).join(base.select("log_id", F.col("frame_id").alias("message_id"), "channel", "base_ms"), ["log_id", "message_id", "channel"])
    held = F.col("run_end") - F.col("run_start")
    return runs.where(held >= F.greatest(F.lit(0.1), 5 * F.col("base_ms") / 1000)).where("run_length > 1").select(*SIGNAL, "channel", F.col("run_start").alias("start"), F.col("run_end").alias("end"))


def signal_findings(frames: DataFrame, catalog: Catalog, config: Config) -> DataFrame:
    """Findings of all signals of all messages that can be decoded, worst first."""
    values = samples(frames, catalog)
    profiles, base = signal_profiles(values, config.chunk), staged(bases(frames, config))
    steps = counter_steps(values, catalog, config.chunk)
    name, at = signal_entities(), seen_at("first_t", ident="message_id")
    beyond, unnamed = out_of_range(values, catalog), invalid_labels(values, catalog)
    jumps = counter_jumps(steps, timing.message_gaps(frames, base, gap_factor(config), config.chunk)).groupBy(*SIGNAL).agg(F.count("*").alias("n"), F.min("t").alias("first_t"), F.min_by("step", "t").alias("step"))
    sums = [s.name for m in catalog.messages for s in m.signals if re.search(CHECKSUM_NAME, s.name)]
    same = profiles.where("constant and n >= 3").where(F.col("signal").isin(sums))
    parts = [
        check_constant(profiles),
        check_stuck(profiles),
        finding(beyond, "sig_range", "warn", F.format_string("%s out of range %d times", "signal", "n"), F.col("first_t"), None, name, F.col("n"), F.format_string("from %s to %s", F.col("lowest").cast("string"), F.col("highest").cast("string")), at),
        finding(unnamed, "sig_enum_invalid", "warn", F.format_string("%s has unnamed values %d times", "signal", "n"), F.col("first_t"), None, name, F.col("n"), F.concat(F.lit("raw values: "), F.array_join(F.transform(F.slice("raws", 1, 8), lambda r: r.cast("string")), ", ")), at),
        finding(jumps, "sig_counter", "error", F.format_string("%s jumps %d times", "signal", "n"), F.col("first_t"), None, name, F.col("n"), F.format_string("first by %d, and not across a gap", "step"), at),
        finding(counter_freezes(steps, base, config.chunk), "sig_counter", "error", F.format_string("%s stops counting", "signal"), F.col("start"), F.col("end"), name, F.col("end") - F.col("start"), F.format_string("no step between %.3f and %.3f s", "start", "end"), seen_at("start", "end", ident="message_id")),
        finding(same, "sig_checksum", "warn", F.format_string("checksum %s never changes", "signal"), F.col("first_t"), F.col("last_t"), name, F.col("n"), F.format_string("all %d samples are %s", "n", "last")),
    ]
    return union(parts).orderBy(severity_order(), F.coalesce("time_start", F.lit(0.0)), "check", "title")


def nearby_ids(frames: DataFrame, frame_id: int, most: int = 8) -> DataFrame:
    """Ids in the log that may be meant: at most 4 away, or the same digits read in the other base."""
    text = str(frame_id)
    swapped = {int(text, 16)} | ({int(f"{frame_id:x}")} if f"{frame_id:x}".isdigit() else set())
    ids = data_frames(frames).select("frame_id").distinct().where((F.abs(F.col("frame_id") - frame_id) <= 4) | F.col("frame_id").isin(list(swapped)))
    return ids.where(F.col("frame_id") != frame_id).orderBy(F.abs(F.col("frame_id") - frame_id), "frame_id").limit(most)
