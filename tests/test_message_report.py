"""One message's report on the demo: known, absent, unknown to the schema; events with totals."""

from dataclasses import replace

from framelake.plans.catalog import Catalog
from framelake.session import Project


def demo(spark):
    project = Project(spark)
    project.load_demo()
    return project


def test_known_message(spark):
    project = demo(spark)
    one = project.diagnose("VehStatus")
    assert one.in_schema and one.in_log and one.identity["hex"] == "0x100" and one.identity["senders"] == ["BCM"]
    assert {r["signal"] for r in one.signals.collect()} == {"VehSpd", "BrakePedal", "AccelPedal"}
    assert one.stats.first()["n_frames"] == 1501 and not one.notes
    text = project.report(ident="0x100")
    assert "## Signals" in text and "VehSpd" in text and "## Findings" in text


def test_absent_message(spark):
    one = demo(spark).diagnose("0x103")
    assert not one.in_log and one.stats is None
    found = one.findings.collect()
    assert [(r["check"], r["severity"], r["value"]) for r in found] == [("msg_absent", "error", 3.0)] and "0x102 x1501" in found[0]["title"]
    assert {r["frame_id"] for r in one.nearby.collect()} == {256, 257, 258}
    assert demo(spark).diagnose("nothing like it")["frame_id"] is None


def test_message_without_schema(spark):
    project = demo(spark)
    project.catalog = Catalog(tuple(replace(m) for m in project.catalog.messages if m.frame_id != 512), project.catalog.nodes)
    one = project.diagnose(512)
    assert not one.in_schema and one.in_log and one.raw is not None and one.signals is None and len(one.notes) == 1


def test_events_with_totals(spark):
    project = demo(spark)
    every = project.events()
    assert every["total"] == every["events"].count() > 2 and not every["truncated"]
    some = project.events(types=["enter"], most=1)
    assert some["truncated"] and some["events"].count() == 1
