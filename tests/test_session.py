"""A project from loading to report, and streams."""

import json

from pyspark.sql import functions as F

from framelake.session import Project
from framelake.streaming import live


def test_project(spark, tmp_path):
    project = Project(spark)
    project.load_demo()
    assert project.summary() == {"frames": 6004, "events": 0, "start": 0.0, "end": 30.0, "ids": 4, "unknown_ids": 0, "mismatch": False}
    assert project.analysis()["events"].count() == 4
    assert project.series(["VehSpd"], 1.0, 2.0, 10).count() <= 11
    assert project.trace(0.0, 0.02, 3).count() == 3
    assert [project.resolve(t)["matched_by"] for t in ("0x100", "100h", "256", "100", "vehstatus", "motor")] == ["hex", "hex", "dec", "dec_as_hex", "name", "name_prefix"]
    report = json.loads(project.report(form="json"))
    assert report["summary"]["frames"] == 6004 and isinstance(report["findings"], list)
    project.save(str(tmp_path / "frames"))
    assert spark.read.parquet(str(tmp_path / "frames")).count() == 6004


def test_streams(spark, tmp_path):
    project = Project(spark)
    project.load_demo()
    project.frames.withColumn("ts", F.timestamp_micros((F.col("t") * 1e6).cast("long"))).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in"))

    def rows(df, mode="append"):
        name = f"out{abs(hash(str(df.schema))) % 1000}{df.columns[-1]}"
        running = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).start()
        running.processAllAvailable()
        running.stop()
        return spark.table(name).collect()

    loads = rows(live.load(stream, baud=500_000, window="1 second", seconds=1.0))
    assert len(loads) > 20 and all(abs(r["load"] - 200 * 111 * 1.2 / 5000) < 0.2 for r in loads)
    assert rows(live.busy_spans(stream)) == []


def test_events_of_code_functions_and_counts(spark):
    project = Project(spark)
    project.load_demo()
    project.spec = {"functions": [*project.spec["functions"], {"id": "fast", "name": "Driving fast", "code": "def update(t, s, dt):\n    return 'FAST' if (s.VehSpd or 0) > 31 else 'SLOW'\n", "active_states": ["FAST"]}]}
    found = project.events(allow_code=True)
    rows = found["events"].collect()
    assert {"cruise", "overtemp", "fast"} == {r["function"] for r in rows} and [r["t"] for r in rows] == sorted(r["t"] for r in rows)
    counts = {(r["function"], r["type"]): r["n"] for r in found["counts"].collect()}
    assert counts["cruise", "enter"] == counts["cruise", "exit"] == 1 and sum(counts.values()) == found["total"] == len(rows)
    assert project.events(allow_code=True, ids=["fast"])["total"] == sum(n for (f, _), n in counts.items() if f == "fast") > 0


def test_reports_as_json(spark):
    project = Project(spark)
    project.load_demo()
    whole = json.loads(project.report(form="json", most=3))
    assert len(whole["findings"]) <= 3 and sum(whole["severity_counts"].values()) >= len(whole["findings"]) and whole["metrics"]["load"][0]["n_frames"] == 6004
    assert all({"check", "severity", "title", "explanation", "confidence", "suggestion", "time_start", "time_end", "entities", "evidence"} <= set(f) for f in whole["findings"])
    one = json.loads(project.report(form="json", ident="VehStatus"))
    assert one["message"]["hex"] == "0x100" and {s["signal"] for s in one["signals"]} == {"VehSpd", "BrakePedal", "AccelPedal"} and one["stats"][0]["n_frames"] == 1501
    assert json.loads(project.report(form="json", ident="nothing like it"))["frame_id"] is None


def test_caps_are_per_log(spark):
    from pyspark.sql import functions as F

    from framelake.sources import frames as source

    one = source.cruise_frames(spark)
    both = one.unionByName(one.withColumn("log_id", F.lit("again")))
    assert {r["log_id"]: r["count"] for r in source.window(both, 1.0, 2.0, 50).groupBy("log_id").count().collect()} == {"cruise": 50, "again": 50}
    assert {r["log_id"]: r["count"] for r in source.capped_by_time(both, 30).groupBy("log_id").count().collect()} == {"cruise": 30, "again": 30}
    assert {tuple(r) for r in source.truncated(both, 6005).collect()} == {("cruise", False), ("again", False)}


def test_mismatches_and_reasons(spark):
    from dataclasses import replace

    from framelake.plans.catalog import Catalog

    project = Project(spark)
    project.load_demo()
    assert project.mismatches() == [] and project.events(text="no such name")["reason"] == "filtered" and project.events()["reason"] is None
    project.spec = {"functions": [{"id": "never", "enter": {"signal": "VehSpd", "op": ">", "value": 900}}]}
    assert project.events()["reason"] == "never_met"
    project.spec["functions"].append({"id": "other", "enter": {"signal": "Elsewhere", "op": "==", "value": "A"}})
    assert project.mismatches() == [("functions_dead", 1, 2)]
    project.spec["functions"] = project.spec["functions"][1:]
    assert project.mismatches() == [("all_functions_dead", 1, 1)]
    project.catalog = Catalog(tuple(replace(m) for m in project.catalog.messages[:2]), ())
    assert ("unknown_ids", 2, 4) in project.mismatches()
