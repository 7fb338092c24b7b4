"""Diagnosis of one message: who it is, how it comes, what its signals or raw bytes do, and what is wrong with it.

Only the message's own frames are examined; all frames serve where the bus around it counts (traffic inside a gap, the
log's ends, bus errors). An id that the log doesn't have gets one finding, with the ids that may be meant.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.operators import diagnostics, timing
from framelake.operators.align import previous
from framelake.operators.decode import byte_fields, data_frames
from framelake.plans.catalog import Catalog
from framelake.sources.places import staged


@dataclass
class Report:
    identity: dict
    in_schema: bool
    in_log: bool
    findings: DataFrame
    nearby: DataFrame | None = None  # (frame_id, frames, name), where the log lacks the id
    stats: DataFrame | None = None  # a row for each log and channel
    signals: DataFrame | None = None  # profiles with the checks that found something
    raw: DataFrame | None = None  # fields that count, where the schema lacks the id
    notes: list[str] = field(default_factory=list)


def identity(catalog: Catalog, frame_id: int) -> dict:
    message = catalog.message(frame_id)
    return {
        "frame_id": frame_id, "hex": f"0x{frame_id:X}", "name": message.name if message else None, "senders": list(message.senders) if message else [],
        "length": message.length if message else None, "cycle_ms": message.cycle_ms if message else None, "is_extended": message.extended if message else frame_id > 0x7FF,
        "signals": len(message.signals) if message else 0, "comment": message.comment if message else "",
    }


def nearby(frames: DataFrame, catalog: Catalog, frame_id: int) -> DataFrame:
    """(frame_id, frames, name) of ids in the log that may be meant."""
    ids = diagnostics.nearby_ids(frames, frame_id)  # eight at most
    counts = data_frames(frames).join(F.broadcast(ids), "frame_id", "left_semi").groupBy("frame_id").agg(F.count("*").alias("frames"))
    return counts.join(catalog.message_table(frames.sparkSession).select("frame_id", "name"), "frame_id", "left")


def absent(frames: DataFrame, catalog: Catalog, frame_id: int) -> DataFrame:
    """The one finding of an id without frames; its value is the number of ids that may be meant."""
    message = catalog.message(frame_id)
    why = f"the schema has {message.name}, the log has no frame of it" if message else "neither the schema nor the log has it"
    near = nearby(frames, catalog, frame_id).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.concat(diagnostics.hex_id("frame_id"), F.lit(" x"), F.col("frames").cast("string")))).alias("ids"))
    title = F.concat(F.lit(f"0x{frame_id:X} is absent: {why}"), F.when(F.col("n") > 0, F.concat(F.lit("; similar ids: "), F.array_join("ids", ", "))).otherwise(""))
    return diagnostics.finding(near.withColumn("log_id", F.lit(None).cast("string")), "msg_absent", "error", title, entities=F.array(F.lit(f"0x{frame_id:X}")), value=F.col("n"))


def raw_steps(frames: DataFrame, counters: DataFrame, chunk_seconds: float = timing.CHUNK) -> DataFrame:
    """Values of raw fields that count, of the primary channel, with their steps, as counter_steps() gives those of signals."""
    main = diagnostics.primary(data_frames(frames).groupBy("log_id", "frame_id", "channel").agg(F.count("*").alias("n_frames"))).select("log_id", "frame_id", "channel")
    own = data_frames(frames).join(F.broadcast(main), ["log_id", "frame_id", "channel"])  # a row for each message, and for each of its bytes
    rows = byte_fields(own).join(F.broadcast(counters.select("log_id", "frame_id", "byte", "field")), ["log_id", "frame_id", "byte", "field"])
    name = F.concat(F.lit("Byte"), F.col("byte").cast("string"), F.when(F.col("field") == "byte", "").otherwise(F.concat(F.lit("."), F.col("field"))))
    rows = rows.select("log_id", F.col("frame_id").alias("message_id"), name.alias("signal"), "channel", "t", "seq", F.col("value").alias("raw"), "bits")
    modulus = F.when(F.col("bits") == 8, 256).otherwise(16)
    rows = previous(rows, [*diagnostics.SIGNAL, "channel"], {"t": "before", "raw": "last"}, chunk_seconds).withColumn("step", F.col("raw") - F.col("last"))
    return rows.withColumn("is_step", (F.col("step") == 1) | (F.col("step") == 1 - modulus))


def raw_findings(frames: DataFrame, config: diagnostics.Config) -> tuple[DataFrame, DataFrame]:
    """(counting fields and bytes that may be checksums, findings): jumps and stops of the fields that count. Nothing is said
    about whether a checksum is right, as its rule can't be known."""
    fields = diagnostics.raw_fields(frames, config.chunk)
    counters = diagnostics.raw_counters(fields)
    steps, base = raw_steps(frames, counters, config.chunk), diagnostics.bases(frames, config)
    gaps = timing.message_gaps(frames, base, diagnostics.gap_factor(config), config.chunk)
    jumps = diagnostics.counter_jumps(steps, gaps).groupBy(*diagnostics.SIGNAL).agg(F.count("*").alias("n"), F.min("t").alias("t"))
    name = diagnostics.signal_entities()
    found = diagnostics.finding(jumps, "msg_raw_counter", "error", F.format_string("%s jumps %d times", "signal", "n"), F.col("t"), None, name, F.col("n"), F.format_string("%d steps are neither one nor none, and not across a gap", "n"), diagnostics.seen_at("t", ident="message_id"))
    stops = diagnostics.finding(diagnostics.counter_freezes(steps, base, config.chunk), "msg_raw_counter", "error", F.format_string("%s stops counting", "signal"), F.col("start"), F.col("end"), name, F.col("end") - F.col("start"), F.format_string("no step between %.3f and %.3f s", "start", "end"), diagnostics.seen_at("start", "end", ident="message_id"))
    kinds = counters.select("log_id", "frame_id", "byte", "field", F.lit("counter").alias("role"), "ratio")
    sums = diagnostics.checksum_bytes(fields, counters).select("log_id", "frame_id", "byte", F.lit("byte").alias("field"), F.lit("checksum").alias("role"), "ratio")
    return kinds.unionByName(sums), found.unionByName(stops)


def signal_section(frames: DataFrame, catalog: Catalog, config: diagnostics.Config) -> tuple[DataFrame, DataFrame]:
    """(profiles with issues, the checks that found something for each signal; findings)."""
    from framelake.operators.decode import samples

    found = diagnostics.signal_findings(frames, catalog, config)
    issues = found.select("log_id", F.col("entities")[1].alias("signal"), "check", "time_start").groupBy("log_id", "signal").agg(F.array_sort(F.collect_set("check")).alias("issues"), F.min("time_start").alias("first_issue_t"))
    roles = F.when(F.regexp_like("signal", F.lit(diagnostics.COUNTER_NAME)), "counter").when(F.regexp_like("signal", F.lit(diagnostics.CHECKSUM_NAME)), "checksum")
    profiles = diagnostics.signal_profiles(samples(frames, catalog), config.chunk).join(issues, ["log_id", "signal"], "left")
    return profiles.withColumn("issues", F.coalesce("issues", F.array().cast("array<string>"))).withColumn("role", roles), found


def diagnose(frames: DataFrame, catalog: Catalog, frame_id: int, config: diagnostics.Config | None = None) -> Report:
    config = config or diagnostics.Config.of(catalog)
    message = catalog.message(frame_id)
    about = identity(catalog, frame_id)
    own = frames.where((F.col("kind") != "data") | (F.col("frame_id") == frame_id))
    mine = data_frames(own)
    if mine.isEmpty():
        return Report(about, message is not None, False, absent(frames, catalog, frame_id), nearby=nearby(frames, catalog, frame_id))
    small = Catalog((message,) if message else (), catalog.nodes)
    table = small.message_table(frames.sparkSession)
    base = staged(diagnostics.bases(own, config))
    gaps = staged(timing.with_traffic(timing.message_gaps(own, base, diagnostics.gap_factor(config), config.chunk), timing.counts_before(frames, chunk_seconds=config.chunk)))
    parts = [diagnostics.check_message_periods(own, config, base), diagnostics.check_message_gaps(own, config, gaps=gaps), diagnostics.check_bursts(own, config, base), diagnostics.check_stop_late(own, config, frames, base)]
    parts += [diagnostics.check_dlc(own, table), diagnostics.check_channels(own), diagnostics.check_payloads(own, config), diagnostics.check_errors_near(own, config, gaps=gaps), diagnostics.check_decode(own, table)]
    stats = base.join(diagnostics.channels_of(mine), ["log_id", "frame_id"])
    out = Report(about, message is not None, True, diagnostics.union(parts), stats=stats)
    if message is None:
        out.raw, more = raw_findings(mine, config)
        out.notes.append("the schema lacks this id: its signals can't be checked, raw bytes were looked at instead; bytes that may be checksums aren't verified")
        parts.append(more)
    elif mine.where(F.col("dlc") >= message.length).isEmpty():
        out.notes.append("no frame can be decoded: signals weren't checked")
    else:
        out.signals, more = signal_section(mine, small, config)
        parts.append(more)
    out.findings = diagnostics.union(parts).orderBy(diagnostics.severity_order(), F.coalesce("time_start", F.lit(0.0)), "check", "title")
    return out


def as_dict(report: Report) -> dict:
    """The report as plain values, for JSON; its tables have a row per channel, signal, field or finding of one message."""
    rows = lambda table, *order: [] if table is None else [r.asDict(True) for r in table.orderBy(*order).collect()]
    return {
        "message": report.identity, "in_schema": report.in_schema, "in_log": report.in_log, "stats": rows(report.stats, "log_id", "channel"), "signals": rows(report.signals, "log_id", "signal"),
        "raw": rows(report.raw, "byte", "field"), "nearby": rows(report.nearby, "frame_id"), "findings": rows(report.findings, diagnostics.severity_order(), "time_start", "check", "title"), "notes": report.notes,
    }


def markdown(report: Report) -> str:
    """The report as text; it has a row per channel, signal and finding of one message."""
    about = report.identity
    lines = [f"# Message {about['hex']}" + (f" {about['name']}" if about["name"] else ""), "", "## Identity", ""]
    lines += [f"- schema: {'known' if report.in_schema else 'unknown'}", f"- log: {'has frames' if report.in_log else 'has no frame'}", *(f"- {k}: {about[k]}" for k in ("senders", "length", "cycle_ms", "signals"))]
    if report.stats is not None:
        lines += ["", "## Timing", ""]
        for r in report.stats.orderBy("log_id", "channel").collect():
            shown = ", ".join(f"{k} {r[f'{k}_ms']:.1f}" for k in ("median", "min", "max", "p99") if r[f"{k}_ms"] is not None)
            lines.append(f"- channel {r['channel']}: {r['n_frames']} frames, {r['first_t']:.3f} to {r['last_t']:.3f} s; period in ms: {shown or 'unknown'}")
    if report.signals is not None:
        lines += ["", "## Signals", "", "| signal | samples | changes | range | issues |", "|---|---|---|---|---|"]
        for r in report.signals.orderBy("log_id", "signal").collect():
            span = f"{r['minimum']:g} to {r['maximum']:g}" if r["minimum"] is not None else "-"
            lines.append(f"| {r['signal']} | {r['n']} | {r['changes']} | {span} | {', '.join(r['issues']) or 'none'} |")
    if report.raw is not None:
        lines += ["", "## Raw fields", "", *(f"- byte {r['byte']} ({r['field']}): {r['role']}, {r['ratio']:.2f}" for r in report.raw.orderBy("byte", "field").collect())]
    lines += ["", "## Findings", ""]
    found = [f"- **{r['severity']}** {r['check']}: {r['title']}" + (f" ({r['time_start']:.3f} s)" if r["time_start"] is not None else "") for r in report.findings.collect()]
    return "\n".join([*lines, *(found or ["none"]), *(["", "## Notes", "", *(f"- {n}" for n in report.notes)] if report.notes else [])]) + "\n"
