"""Machines, conditions and alignment against a loop over ticks, and the cruise demo's known events."""

import random

import pytest
from pyspark.sql import functions as F

from framelake.operators import align, code_functions, machines
from framelake.plans import conditions, functions
from framelake.plans.catalog import SchemaError
from framelake.sources import frames as source


@pytest.fixture(scope="module")
def cruise(spark):
    return source.cruise_frames(spark).cache()


@pytest.mark.parametrize("chunk", [600.0, 1.7])
def test_cruise(cruise, chunk):
    catalog = source.cruise_catalog()
    found, _ = functions.parse(source.CRUISE_SPEC, catalog)
    steps = machines.run(cruise, catalog, found, chunk_seconds=chunk).cache()
    events = [(r["function"], r["type"], r["t"]) for r in machines.events(steps, catalog, found).orderBy("t").collect()]
    assert events == [("cruise", "enter", 8.0), ("cruise", "exit", 15.0), ("overtemp", "enter", 16.76), ("overtemp", "exit", 26.7)]
    blocked = machines.attempts(steps, catalog, found).collect()
    assert [(r["t"], [(b["signal"], b["actual"]) for b in r["blocking"]]) for r in blocked] == [(5.0, [("VehSpd", "20.0")])]
    spans = {r["function"]: (r["start"], r["end"], r["open"]) for r in machines.intervals(steps).collect()}
    assert spans == {"cruise": (8.0, 15.0, False), "overtemp": (16.76, 26.7, False)}


def test_values_at(cruise):
    found = {r["signal"]: r["label"] or r["num"] for r in align.value_at(cruise, source.cruise_catalog(), ["VehSpd", "CruiseState", "MotorTemp", "Absent"], 10.0).collect()}
    assert found == {"VehSpd": 32.0, "CruiseState": "ACTIVE", "MotorTemp": 96.0}
    assert cruise.count() == 6004


@pytest.mark.parametrize("initial", [False, True])
def test_latch_equals_loop(spark, initial):
    draw = random.Random(4)
    ticks = [(float(i), draw.random() < 0.2, draw.random() < 0.2) for i in range(400)]
    rows = spark.createDataFrame([("l", "f", t, e, x, initial) for t, e, x in ticks], "log_id string, function string, t double, on_enter boolean, on_exit boolean, initial boolean")
    for width in (7.0, 1e9):
        got = machines.latch(rows.withColumn("chunk", align.chunk_of(F.col("t"), width)), ["log_id", "function"]).orderBy("t").collect()
        state = initial
        for row, (_, e, x) in zip(got, ticks):
            assert row["before"] == state
            state = (not x) if state else e
            assert row["after"] == state


def test_code_function(cruise):
    code = """
ACTIVE = "ACTIVE"
INITIAL = "IDLE"

def update(t, s, dt):
    if s.rising("CruiseSetBtn"):
        if s.VehSpd >= 30 and s.BrakePedal == 0:
            reason(f"speed {s.VehSpd:.1f}")
            return "ACTIVE"
        attempt("too slow")
    if s.BrakePedal == 1:
        return "IDLE"
"""
    catalog = source.cruise_catalog()
    _, coded = functions.parse({"functions": [{"id": "c", "code": code}]}, catalog)
    with pytest.raises(PermissionError):
        code_functions.run(cruise, catalog, coded)
    for fast in (False, True):
        rows = code_functions.run(cruise, catalog, coded, fast, allow_code=True).orderBy("t", "kind").collect()
        assert [(r["kind"], r["type"], r["t"]) for r in rows] == [("attempt", None, 5.0), ("event", "enter", 8.0), ("interval", None, 8.0), ("event", "exit", 15.0)]
        assert rows[1]["summary"] == "speed 32.0" and rows[1]["evidence"]["CruiseSetBtn"] == "1"


def test_watch(cruise):
    turns, spans = machines.watch(cruise, source.cruise_catalog(), {"signal": "CruiseState", "op": "==", "value": "ACTIVE"}, 1.3)
    assert [(r["t"], r["to"]) for r in turns.orderBy("t").collect()] == [(8.0, True), (15.0, False)]
    assert [(r["start"], r["end"]) for r in spans.collect()] == [(8.0, 15.0)]


def test_comparisons_of_plain_values():
    holds = conditions.holds
    assert holds("0x10", "==", 16) and holds(3, "<", "4.5") and holds("RUN", "==", "RUN") and holds("b", ">", "a")
    assert holds(None, ">", 30) and not holds(None, "<", 30) and holds(None, "!=", 1) and not holds(None, "==", 0)


@pytest.mark.parametrize("bad", [3, {}, {"all": []}, {"signal": "A", "op": "~", "value": 1}, {"signal": "A"}, {"any": 1}])
def test_bad_conditions(bad):
    with pytest.raises(SchemaError):
        conditions.normalised(bad)


def test_specs():
    with pytest.raises(SchemaError):
        functions.parse({"functions": []})
    with pytest.raises(SchemaError):
        functions.parse({"functions": [{"id": "x"}]})
    with pytest.raises(SchemaError):
        functions.parse({"functions": [{"enter": {"rising": "A"}}]})
    names, dynamic = functions.code_signals("def update(t, s, dt):\n  tracks.append(s.A)\n  return s['B'] or s.rising('C') or s.prev.D or s[x]")
    assert names == ["A", "B", "C", "D"] and dynamic
    assert conditions.default_trigger({"all": [{"rising": "A"}, {"changed": "B"}]}) == {"any": [{"rising": "A"}, {"changed": "B"}]}


def test_code_function_orders_packed_pieces(spark):
    """The task that runs the code gets pieces that others have put in order; of samples at one instant the last counts."""
    from pyspark.sql import functions as F

    from framelake.operators import code_functions
    from framelake.plans.functions import CodeFunction

    rows = [("log", "f", float(k // 3), k, "x", float(k), None, k % 3 == 0) for k in range(3000)]
    changes = spark.createDataFrame(rows[::-1], "log_id string, function string, t double, seq long, signal string, num double, text string, runs boolean").repartition(3)
    code = "def update(t, s, dt):\n    if t % 100 == 0:\n        attempt(str(s.x))\n"
    found = code_functions.replay_changes(changes, [CodeFunction("f", "f", "", code, ("x",), False)])
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 2 and "RepartitionByExpression [log_id" in plan
    assert [(r["t"], r["summary"]) for r in found.orderBy("t").collect()] == [(100.0 * k, str(300.0 * k + 2)) for k in range(10)]
