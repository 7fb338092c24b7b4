"""Checks on synthetic faults."""

import pytest

from framelake.operators import diagnostics, timing
from framelake.plans.catalog import Catalog, Message, Signal
from framelake.sources.frames import normalised

SCHEMA = "seq long, t double, frame_id long, channel int, data binary"


def periodic(frame_id, period, start, end, payload=lambda i: bytes([i % 16]) * 8, skip=(), channel=0):
    rows, i = [], 0
    while start + i * period < end - 1e-9:
        t = round(start + i * period, 6)
        if not any(lo < t < hi for lo, hi in skip):
            rows.append((t, frame_id, channel, bytearray(payload(i))))
        i += 1
    return rows


@pytest.fixture
def make(spark):
    return lambda *parts: normalised(spark.createDataFrame([(i, *r) for i, r in enumerate(sorted(sum(parts, []), key=lambda r: r[0]))], SCHEMA))


CATALOG = Catalog((Message(0x100, "A", 8, (Signal("AliveCounter", 0, 4), Signal("Mode", 8, 4, choices=((0, "OFF"), (1, "ON")))), ("NodeA",), cycle_ms=20.0), Message(0x200, "B", 8, (), ("NodeB",), cycle_ms=20.0)))
CONFIG = diagnostics.Config.of(CATALOG)


def checks(found):
    return sorted((r["check"], r["severity"]) for r in found.collect())


def test_gap_with_and_without_traffic(make):
    hole = [(1.0, 1.2)]
    rows = diagnostics.message_gaps(make(periodic(0x100, 0.02, 0, 2, skip=hole), periodic(0x200, 0.02, 0, 2)), CONFIG).collect()
    assert [(r["missing"], r["inside"] > 0) for r in rows] == [(9, True)]
    rows = diagnostics.message_gaps(make(periodic(0x100, 0.02, 0, 2, skip=hole)), CONFIG).collect()
    assert [(r["missing"], r["inside"]) for r in rows] == [(9, 0)]


def test_many_gaps_are_summed_up(make):
    hole = [(i * 0.5 + 0.1, i * 0.5 + 0.3) for i in range(38)]
    found = diagnostics.check_message_gaps(make(periodic(0x100, 0.02, 0, 20, skip=hole), periodic(0x200, 0.02, 0, 20)), CONFIG).collect()
    assert len(found) == 11 and sum("38 gaps" in r["title"] for r in found) == 1


def test_stop_late_silence_and_nodes(make):
    frames = make(periodic(0x100, 0.02, 0, 1), periodic(0x200, 0.02, 1.5, 3))
    assert checks(diagnostics.check_stop_late(frames, CONFIG)) == [("msg_late", "warn"), ("msg_stop", "error")]
    assert [round(r["gap"], 2) for r in timing.silence(frames, 0.4).collect()] == [0.52]
    config = diagnostics.Config(**(vars(CONFIG) | {"nodes": {"NodeA": (0x100,), "NodeB": (0x200,), "Ghost": (0x300,)}}))
    frames = make(periodic(0x100, 0.02, 0, 2, skip=[(1.0, 1.3)]), periodic(0x200, 0.02, 0, 2))
    gaps, unseen = diagnostics.node_gaps(frames, config)
    assert [r["node"] for r in gaps.collect()] == ["NodeA"] and [r["node"] for r in unseen.collect()] == ["Ghost"]


def test_channels_are_timed_apart(make):
    frames = make(periodic(0x100, 0.02, 0, 2), periodic(0x100, 0.02, 0.01, 2, channel=1))
    assert {round(r["median_ms"], 6) for r in timing.period_stats(frames).collect()} == {20.0}
    assert diagnostics.message_gaps(frames, CONFIG).count() == 0
    assert checks(diagnostics.check_channels(frames)) == [("msg_multichannel", "info")]


def test_payloads_and_lengths(make):
    same = make(periodic(0x100, 0.02, 0, 2, payload=lambda i: b"\1" * 8))
    assert checks(diagnostics.check_payloads(same)) == [("msg_payload_stuck", "warn")]
    frozen = make(periodic(0x100, 0.02, 0, 4, payload=lambda i: bytes([min(i, 25)]) * 8))
    assert "unchanged" in diagnostics.check_payloads(frozen).first()["title"]
    mixed = make(periodic(0x100, 0.02, 0, 1, payload=lambda i: bytes(8 if i % 2 else 4)))
    messages = CATALOG.message_table(mixed.sparkSession)
    assert checks(diagnostics.check_dlc(mixed, messages)) == [("msg_dlc", "warn")]
    short = make(periodic(0x100, 0.02, 0, 1, payload=lambda i: bytes(4)))
    assert checks(diagnostics.check_decode(short, messages)) == [("msg_decode", "error")]


def test_counters_and_labels(make):
    clean = make(periodic(0x100, 0.02, 0, 2, payload=lambda i: bytes([i % 16, 0]) + bytes(6)))
    assert not [c for c in checks(diagnostics.signal_findings(clean, CATALOG, CONFIG)) if c[0] in ("sig_counter", "sig_enum_invalid")]
    bad = make(periodic(0x100, 0.02, 0, 2, payload=lambda i: bytes([(i + 6 * (i >= 50)) % 16, 5]) + bytes(6)))
    assert {("sig_counter", "error"), ("sig_enum_invalid", "warn")} <= set(checks(diagnostics.signal_findings(bad, CATALOG, CONFIG)))
    frozen = make(periodic(0x100, 0.02, 0, 2, payload=lambda i: bytes([(i if i < 30 else max(30, i - 20)) % 16, 0]) + bytes(6)))
    found = diagnostics.signal_findings(frozen, CATALOG, CONFIG).where("check = 'sig_counter'").collect()
    assert len(found) == 1 and found[0]["time_end"] - found[0]["time_start"] > 0.3


def test_errors(spark):
    storm = [(i, 1 + i * 0.005, "error", "stuff", None) for i in range(20)]
    frames = normalised(spark.createDataFrame([(99, 0.0, "data", None, None), *storm, (30, 2.0, "status", None, "bus_off")], "seq long, t double, kind string, error_type string, state string").selectExpr("*", "0L as frame_id", "X'' as data"))
    assert checks(diagnostics.check_errors(frames, CONFIG)) == [("error_frame", "critical")]
    assert checks(diagnostics.check_states(frames, CONFIG)) == [("error_state_machine", "critical")]
    assert checks(diagnostics.check_physical(frames, CONFIG)) == [("baud_mismatch", "warn")]
    few = frames.where("kind <> 'error' or seq % 7 = 0")
    assert checks(diagnostics.check_errors(few, CONFIG)) == [("error_frame", "warn")]


def test_bus_load(make):
    frames = make(periodic(0x100, 0.01, 0, 2))
    row = timing.bus_load(frames, 12_500).first()
    assert row["mean_load"] > 70
    assert checks(diagnostics.check_load(frames, diagnostics.Config(baud=12_500))) == [("bus_load", "critical")]
