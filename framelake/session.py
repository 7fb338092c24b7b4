"""A project: a schema, a log and a spec, swapped independently, and what is asked of them."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.operators import align, code_functions, decode, diagnostics, machines, message_report, review, series, timing
from framelake.plans import functions as specs
from framelake.plans.catalog import Catalog, parse_dbc
from framelake.sources import frames as source
from framelake.sources.places import staged
from framelake.sources.textlogs import read_log


class Project:
    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.catalog = Catalog()
        self.frames: DataFrame | None = None
        self.spec: dict = {}

    def load_schema(self, text: str) -> None:
        self.catalog = parse_dbc(text)

    def load_log(self, path: str, start: float | None = None, end: float | None = None, most: int | None = None) -> None:
        self.frames = read_log(self.spark, path, start, end, most)

    def load_spec(self, text: str) -> None:
        self.spec = specs.load_spec(text)

    def load_demo(self) -> None:
        self.catalog, self.frames, self.spec = source.cruise_catalog(), source.cruise_frames(self.spark), source.CRUISE_SPEC

    def save(self, path: str) -> None:
        """Frames as Parquet, a folder per log, in order of id and time so that scans skip what a query leaves out."""
        self.frames.repartitionByRange("log_id", "frame_id", "t").sortWithinPartitions("frame_id", "t", "seq").write.partitionBy("log_id").parquet(path)

    def summary(self) -> dict:
        rows = self.frames.agg(F.count_if(F.col("kind") == "data").alias("frames"), F.count_if(F.col("kind") != "data").alias("events"), F.min(F.when(F.col("kind") == "data", F.col("t"))).alias("start"), F.max(F.when(F.col("kind") == "data", F.col("t"))).alias("end"))
        unknown = decode.unknown_ids(self.frames, self.catalog.message_table(self.spark)).count() if self.catalog.messages else 0
        ids = decode.data_frames(self.frames).select("frame_id").distinct().count()
        return rows.first().asDict() | {"ids": ids, "unknown_ids": unknown, "mismatch": bool(ids) and unknown / ids > 0.3}

    def messages(self) -> DataFrame:
        table = self.catalog.message_table(self.spark)
        return (decode.with_data(self.frames, table) if self.frames is not None else table.withColumn("has_data", F.lit(True))).orderBy("frame_id")

    def signals(self) -> DataFrame:
        has = self.messages().select(F.col("frame_id").alias("message_id"), "has_data")
        return self.catalog.signal_table(self.spark).join(has, "message_id").orderBy("name")

    def values(self, names: list[str], t: float) -> DataFrame:
        return align.value_at(self.frames, self.catalog, names, t)

    def series(self, names: list[str], start: float | None = None, end: float | None = None, most: int = 4000) -> DataFrame:
        return series.strided(series.points(self.frames, self.catalog, names, start, end), most)

    def trace(self, start: float, end: float, most: int = 2000) -> DataFrame:
        return series.trace(self.frames, self.catalog, start, end, most)

    def analysis(self, fast: bool = False, allow_code: bool = False) -> dict[str, DataFrame]:
        """events, attempts and intervals of all functions of the spec; code functions only if they are allowed."""
        declared, coded = specs.parse(self.spec, self.catalog)
        out: dict[str, list[DataFrame]] = {"events": [], "attempts": [], "intervals": []}
        if declared:
            steps = machines.run(self.frames, self.catalog, declared, fast)
            out["events"].append(machines.events(steps, self.catalog, declared).select("log_id", "function", "type", "t", "summary"))
            out["attempts"].append(machines.attempts(steps, self.catalog, declared).select("log_id", "function", "t", F.col("trigger").alias("summary")))
            out["intervals"].append(machines.intervals(steps).select("log_id", "function", "start", "end"))
        if coded:
            rows = code_functions.run(self.frames, self.catalog, coded, fast, allow_code)
            out["events"].append(rows.where("kind = 'event'").select("log_id", "function", "type", "t", "summary"))
            out["attempts"].append(rows.where("kind = 'attempt'").select("log_id", "function", "t", "summary"))
            out["intervals"].append(rows.where("kind = 'interval'").select("log_id", "function", F.col("t").alias("start"), "end"))
        return {name: diagnostics.union(parts) for name, parts in out.items() if parts}

    def events(self, types: list[str] | None = None, ids: list[str] | None = None, text: str | None = None, most: int = 3000, fast: bool = False, allow_code: bool = False) -> dict:
        """events (the first that match, in order of time), their total, whether some were left out, and counts of all events by
        function and type; of declared functions and, if they are allowed, code functions. They are computed once."""
        declared, coded = specs.parse(self.spec, self.catalog)
        parts, columns = [], ["log_id", "function", "position", "type", "t", "summary"]
        if declared:
            parts.append(machines.events(machines.run(self.frames, self.catalog, declared, fast), self.catalog, declared).select(columns))
        if coded:
            place = F.lit(len(declared))
            for k, one in enumerate(coded):
                place = F.when(F.col("function") == one.id, F.lit(len(declared) + k)).otherwise(place)
            rows = code_functions.run(self.frames, self.catalog, coded, fast, allow_code)
            parts.append(rows.where("kind = 'event'").withColumn("position", place).select(columns))
        found = staged(diagnostics.union(parts))
        names = self.spark.createDataFrame([(f.id, f.name) for f in (*declared, *coded)], "function string, name string")
        total = series.event_total(found, names, types, ids, text, most).first()
        return {"events": series.event_list(found, names, types, ids, text, most), "total": total["total"], "truncated": total["truncated"], "counts": series.event_counts(found, names), "reason": None if total["total"] else review.empty_reason(self.coverage(), bool(types or ids or text))}

    def coverage(self) -> DataFrame:
        """(function, position, signal, status) of the signals that the spec's functions name."""
        declared, coded = specs.parse(self.spec, self.catalog)
        wanted = [(f.id, k, n) for f in (*declared, *coded) for k, n in enumerate(f.signals)]
        return series.coverage(self.spark.createDataFrame(wanted, "function string, position int, signal string"), self.catalog, self.frames)

    def mismatches(self) -> list[tuple[str, int, int]]:
        """What speaks against schema, log and spec belonging together."""
        about = self.summary()
        return review.mismatches(self.coverage(), about["ids"], about["unknown_ids"])

    def diagnose(self, text: str | int, config: diagnostics.Config | None = None) -> message_report.Report | dict:
        """The report of one message, named as resolve() understands it; if that knows no message, what may be meant."""
        meant = {"frame_id": text, "matched_by": "dec"} if isinstance(text, int) else self.resolve(text)
        if meant["frame_id"] is None:
            return meant
        out = message_report.diagnose(self.frames, self.catalog, meant["frame_id"], config)
        if meant["matched_by"] == "dec_as_hex":
            out.notes.append(f"no id is {text} in decimal, so it was read as hexadecimal")
        return out

    def watch(self, condition: dict) -> tuple[DataFrame, DataFrame]:
        return machines.watch(self.frames, self.catalog, condition)

    def findings(self, config: diagnostics.Config | None = None) -> DataFrame:
        config = config or diagnostics.Config.of(self.catalog)
        parts = [diagnostics.bus_findings(self.frames, config), diagnostics.message_findings(self.frames, self.catalog, config)]
        if self.catalog.messages:
            parts.append(diagnostics.signal_findings(self.frames, self.catalog, config))
        return diagnostics.union(parts)

    def report(self, config: diagnostics.Config | None = None, form: str = "markdown", most: int = 1000, ident: str | int | None = None) -> str:
        """Findings as text, the `most` worst of them and the number of all by severity; with ident, the report of that one
        message. A log may have many more findings than a text should: findings() gives them all as a table."""
        if ident is not None:
            one = self.diagnose(ident, config)
            if form == "json":
                return json.dumps(message_report.as_dict(one) if isinstance(one, message_report.Report) else one)
            return message_report.markdown(one) if isinstance(one, message_report.Report) else "No such message. Candidates: " + ", ".join(one["candidates"]) + "\n"
        every = staged(self.findings(config))
        rows = every.orderBy(diagnostics.severity_order(), "time_start", "check", "title").limit(most).collect()
        counts = {r["severity"]: r["n"] for r in diagnostics.severity_counts(every).collect()}
        about, can = self.summary(), diagnostics.capabilities(self.frames, bool(self.catalog.messages))
        if form == "json":
            return json.dumps({"summary": about, "capabilities": can, "metrics": self.metrics(config), "severity_counts": counts, "findings": [r.asDict(True) for r in rows]})
        about |= {f"{k} findings": n for k, n in counts.items()}
        if sum(counts.values()) > len(rows):
            about["findings listed"] = len(rows)
        lines = ["# Bus report", "", "## Overview", *(f"- {k}: {v}" for k, v in about.items()), "", "## Capabilities", *(f"- {k}: {'yes' if v else 'no'}" for k, v in can.items()), "", "## Findings"]
        return "\n".join([*lines, *(f"- **{r['severity']}** {r['check']}: {r['title']}" + (f" ({r['time_start']:.3f} s)" if r["time_start"] is not None else "") for r in rows)]) + "\n"

    def metrics(self, config: diagnostics.Config | None = None) -> dict:
        """Figures of the bus beside its findings: load of each log and channel, and error frames by kind."""
        config = config or diagnostics.Config.of(self.catalog)
        load = timing.bus_load(self.frames, config.baud, config.load_window).orderBy("log_id", "channel").collect()
        errors = diagnostics.error_types(self.frames).orderBy("log_id", "error_type").collect()
        return {"load": [r.asDict() for r in load], "errors": [r.asDict() for r in errors]}

    def resolve(self, text: str) -> dict:
        """The message that a text means: 0x1F, 1Fh, decimal (or, where only that is known, its digits as hexadecimal), a
        name or part of one; else what may be meant, at most 20."""
        known = {m.frame_id: m.name for m in self.catalog.messages}
        clean = text.strip()
        low = clean.lower()
        as_hex = lambda s: int(s, 16) if s and all(c in "0123456789abcdef" for c in s) else None
        meant = [i for i in (int(clean) if clean.isdigit() else None, as_hex(low)) if i is not None]
        ids = set(known)
        if self.frames is not None and meant:  # only the ids that the text can mean are looked for
            ids |= {r[0] for r in decode.data_frames(self.frames, meant).select("frame_id").distinct().collect()}
        by_name = [m for m in self.catalog.messages if m.name.lower() == low]
        if low.startswith("0x") and as_hex(low[2:]) is not None:
            return {"frame_id": as_hex(low[2:]), "matched_by": "hex"}
        if low.endswith("h") and as_hex(low[:-1]) is not None and not by_name:
            return {"frame_id": as_hex(low[:-1]), "matched_by": "hex"}
        if clean.isdigit():
            if int(clean) not in ids and as_hex(low) in ids:
                return {"frame_id": as_hex(low), "matched_by": "dec_as_hex"}
            return {"frame_id": int(clean), "matched_by": "dec"}
        if by_name:
            return {"frame_id": by_name[-1].frame_id, "matched_by": "name"}
        if as_hex(low) is not None:
            return {"frame_id": as_hex(low), "matched_by": "hex"}
        part = [m for m in self.catalog.messages if low and low in m.name.lower()]
        if len(part) == 1:
            return {"frame_id": part[0].frame_id, "matched_by": "name_prefix"}
        return {"frame_id": None, "candidates": sorted(m.name for m in part)[:20]}
