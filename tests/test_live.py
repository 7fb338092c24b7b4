"""Streams: frames from files that appear, held signals, machines with initial states and attempts."""

import random

import pytest
from pyspark.sql import functions as F

from framelake.operators import align, machines
from framelake.plans import functions
from framelake.sources import frames as source
from framelake.sources import textlogs
from framelake.streaming import live


def rows(stream, name):
    query = stream.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name).collect()


def test_frames_of_files(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"{i}.asc").write_bytes(f"date now\nbase hex timestamps relative\n{i}.5 1 1A{i} Rx d 2 01 0{i}\n{i}.75 2 ErrorFrame stuff\n// caf".encode() + b"\xe9\n")
    got = rows(live.frames_of(spark, str(tmp_path), 0.6, 2.5), "live_frames")
    assert sorted((r["log_id"], r["t"], r["kind"], r["frame_id"]) for r in got) == [("0.asc", 0.75, "error", 0), ("1.asc", 1.5, "data", 0x1A1), ("1.asc", 1.75, "error", 0), ("2.asc", 2.5, "data", 0x1A2)]
    assert {r["line"] for r in textlogs.lines_of(spark, str(tmp_path)).where("line like '//%'").collect()} == {"// café"}


def test_machine_with_initial_state_and_attempts(spark, tmp_path):
    steps = [("l", "f", 1.0, False, True, False), ("l", "f", 2.0, False, False, True), ("l", "f", 3.0, True, False, True), ("l", "g", 1.0, False, True, False)]
    frame = spark.createDataFrame(steps, "log_id string, function string, t double, on_enter boolean, on_exit boolean, on_trigger boolean")
    frame.coalesce(1).write.parquet(str(tmp_path / "steps"))
    stream = spark.readStream.schema(frame.schema).parquet(str(tmp_path / "steps"))
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        got = rows(live.machine_events(stream, frozenset({"f"})), "live_events")
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    assert sorted((r["function"], r["type"], r["t"]) for r in got) == [("f", "attempt", 2.0), ("f", "enter", 3.0), ("f", "exit", 1.0)]


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.set(name, before)


SPEC = {
    "functions": [
        *source.CRUISE_SPEC["functions"],
        {"id": "level", "enter": {"signal": "VehSpd", "op": ">", "value": 31}, "exit": {"signal": "CruiseState", "op": "==", "value": "IDLE"}, "trigger": {"signal": "BrakePedal", "op": "==", "value": 1}, "initial_active": True},
    ]
}


def batches(spark, tmp_path, parts):
    """A stream of the parts, one after the other; the files' names give their order."""
    folder = tmp_path / "frames"
    folder.mkdir()
    for k, part in enumerate(parts):
        part.coalesce(1).write.parquet(str(tmp_path / f"p{k}"))
        file = next((tmp_path / f"p{k}").glob("*.parquet"))
        file.rename(folder / f"{k:03d}.parquet")
        import os

        os.utime(folder / f"{k:03d}.parquet", (1_000_000 + k, 1_000_000 + k))
    return spark.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def shuffled_parts(spark, seconds=2.0):
    """The demo of two logs, with the frames of three seconds out of order, and a frame far ahead that ends it."""
    draw = random.Random(4)
    one = source.cruise_frames(spark).where("t < 20")
    both = one.unionByName(one.withColumn("log_id", F.lit("again")).where("frame_id <> 256 or t < 9")).withColumn("ts", F.timestamp_seconds("t"))
    rows = sorted(both.collect(), key=lambda r: (r["t"] // 3, draw.random()))
    end = both.where("seq = 0").withColumn("t", F.lit(1000.0)).withColumn("ts", F.timestamp_seconds("t")).collect()
    size = len(rows) // 5
    parts = [rows[k : k + size] for k in range(0, len(rows), size)] + [end]
    return both, [spark.createDataFrame(p, both.schema) for p in parts]


def test_held_signals_of_shuffled_batches(spark, tmp_path, rocks):
    both, parts = shuffled_parts(spark)
    names = ["VehSpd", "CruiseState", "Nothing"]
    got = {(r["log_id"], r["t"]): r for r in rows(live.held(batches(spark, tmp_path, parts), source.cruise_catalog(), names, "4 seconds"), "live_held")}
    want = align.held(both, source.cruise_catalog(), names).collect()
    assert len(got) == len(want) == 2 * 1000
    for r in want:
        for n in names:
            for which in ("cur", "prev"):
                assert got[r["log_id"], r["t"]][f"{which}_{n}"] == r[f"{which}_{n}"], (r["t"], n, which)


def test_machines_over_a_stream_that_starts_again(spark, tmp_path, rocks):
    both, parts = shuffled_parts(spark)
    catalog = source.cruise_catalog()
    declared, _ = functions.parse(SPEC, catalog)
    steps = machines.run(both, catalog, declared)
    want = {(r["log_id"], r["function"], r["type"], r["t"]) for r in machines.events(steps, catalog, declared).collect()}
    want |= {(r["log_id"], r["function"], "attempt", r["t"]) for r in machines.attempts(steps, catalog, declared).collect()}
    spans = {(r["log_id"], r["function"], r["start"], r["end"]) for r in machines.intervals(steps).where("not open").collect()}
    stream = live.machines_of(batches(spark, tmp_path, parts[:3]), catalog, declared, "4 seconds")
    folder = tmp_path / "frames"

    def run():
        query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "checkpoint")).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
        return spark.read.parquet(str(tmp_path / "out")).collect()

    first = len(run())
    for k, part in enumerate(parts[3:], 3):  # more files come, and the query starts again where it was
        part.coalesce(1).write.parquet(str(tmp_path / f"p{k}"))
        next((tmp_path / f"p{k}").glob("*.parquet")).rename(folder / f"{k:03d}.parquet")
    got = run()
    assert 0 < first < len(got) == len(want)
    assert {(r["log_id"], r["function"], r["type"], r["t"]) for r in got} == want
    assert {(r["log_id"], r["function"], r["since"], r["t"]) for r in got if r["type"] == "exit" and r["since"] is not None} <= spans


class Shelf(dict):
    """A state of a processor, kept in memory."""

    def containsKey(self, key):
        return key in self

    def getValue(self, key):
        return self[key]

    def updateValue(self, key, value):
        self[key] = value

    def removeKey(self, key):
        del self[key]

    def exists(self):
        return bool(self)

    def get(self):
        return self["value"]

    def update(self, value):
        self["value"] = value


def test_hold_keeps_a_piece_of_a_batch_in_memory():
    import tracemalloc
    from types import SimpleNamespace

    from pyspark.sql import Row

    timers = []
    handle = SimpleNamespace(getMapState=lambda *_: Shelf(), getValueState=lambda *_: Shelf(), registerTimer=timers.append)
    hold = live.Hold(["x"], 5.0)
    hold.BUFFER = 500
    hold.init(handle)
    told, n = Row("t", "seq", "x_raw", "x_num", "x_label"), 40_000
    tracemalloc.start()
    assert not list(hold.handleInputRows(("log",), (told((n - k) / 100, k, k % 7 or None, None, None) for k in range(n)), None))
    stays, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert peak - stays < 1_000_000 and len(timers) == len(set(timers)) == 81
    out = [r for at in sorted(timers) for r in hold.handleExpiredTimer(("log",), None, SimpleNamespace(getExpiryTimeInMs=lambda at=at: at))]
    assert [r["t"] for r in out] == [k / 100 for k in range(1, n + 1)] and not hold.packs and not hold.count
    assert all(a["cur_x_raw"] == b["prev_x_raw"] for a, b in zip(out, out[1:]))


def test_only_packs_go_through_the_task_of_a_log(spark, tmp_path, rocks, monkeypatch):
    both, parts = shuffled_parts(spark)
    seen, plain = tmp_path / "seen", live.Hold

    class Counted(plain):
        def handleInputRows(self, key, rows, timerValues):
            rows = list(rows)
            with seen.open("a") as f:
                f.write(f"{len(rows)}\n")
            return plain.handleInputRows(self, key, iter(rows), timerValues)

    monkeypatch.setattr(live, "Hold", Counted)
    got = rows(live.held(batches(spark, tmp_path, parts), source.cruise_catalog(), ["VehSpd"], "4 seconds"), "live_packs")
    assert len(got) == 2 * 1000 and both.where("kind = 'data'").count() > 2000
    assert 0 < sum(map(int, seen.read_text().split())) <= 2 * 21  # a row for each second of a log


@pytest.mark.parametrize("overlap", [False, True])
def test_machines_in_packs_against_a_loop(overlap):
    from types import SimpleNamespace

    import numpy as np
    import pandas as pd

    draw = random.Random(overlap)
    latch, state = live.Latch(frozenset({"f"})), Shelf()
    latch.init(SimpleNamespace(getValueState=lambda *_: state))
    latch.STEPS = 20
    on, since, want, got = True, None, [], []
    for batch in range(3):
        steps = [(batch * 1000.0 + k, draw.choice([0, 0, 0, 1, 1, 2, 3, 4, 5, 6, 7])) for k in range(300)]
        for t, code in steps:
            enter, leave, trigger = code & 4, code & 2, code & 1
            if on and leave:
                want.append(("exit", t, since))
                on, since = False, None
            elif not on and enter:
                want.append(("enter", t, None))
                on, since = True, t
            if trigger and not enter and not on:
                want.append(("attempt", t, None))
        parts = [steps[k :: 25] for k in range(25)] if overlap else [steps[k : k + 12] for k in range(0, 300, 12)]
        draw.shuffle(parts)
        packs = [(p[0][0], p[-1][0], np.array([t for t, _ in p]).tobytes() + bytes(code for _, code in p)) for p in parts]
        frames = [pd.DataFrame(packs[k : k + 10], columns=["first", "last", "pack"]) for k in range(0, 25, 10)]
        found = list(latch.handleInputRows(("log", "f"), iter(frames), None))
        assert overlap or len(found) > 10
        got += [(kind, t, None if np.isnan(s) else s) for f in found for kind, t, s in zip(f["type"], f["t"], f["since"])]
    assert got == want and len(want) > 200 and state.get() == (on, since)
