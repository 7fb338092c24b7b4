"""Work in chunks of time equals the same over whole logs, whatever the chunks' width."""

import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelake.operators import align, timing
from framelake.sources.frames import normalised

WIDTHS = (0.3, 2.0, 7.5, 1e6)


def random_rows(seed, n=400):
    draw, t, rows = random.Random(seed), 0.0, []
    for seq in range(n):
        t += draw.choice([0.0, 0.001, 0.01, 0.1, 0.25, 3.0])
        rows.append((draw.choice("ab"), round(t, 6), seq, draw.choice([None, 1, 1, 1, 2])))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "k string, t double, seq long, v int").repartition(3)


@pytest.mark.parametrize("seed", [1, 2])
def test_previous_and_longest_runs(spark, seed):
    rows = random_rows(seed)
    expected, best = {}, {}
    for key in "ab":
        mine, before = [r for r in rows if r[0] == key], (None, None)
        runs = []
        for _, t, seq, v in mine:
            expected[seq] = before
            if runs and runs[-1][0] == v:
                runs[-1][1].append(t)
            else:
                runs.append((v, [t]))
            before = (t, v)
        top = max(runs, key=lambda r: len(r[1]))  # the first of equally long ones
        best[key] = (len(mine), len(runs) - 1, top[1][0], top[1][-1], len(top[1]))
    for width in WIDTHS:
        got = align.previous(frame(spark, rows), ["k"], {"t": "was_t", "v": "was_v"}, width)
        assert {r["seq"]: (r["was_t"], r["was_v"]) for r in got.collect()} == expected
        found = timing.longest_runs(frame(spark, rows), ["k"], "v", width).collect()
        assert {r["k"]: tuple(r)[1:] for r in found} == best
    assert timing.longest_runs(frame(spark, rows).limit(0), ["k"], "v").count() == 0


def test_one_long_run_over_many_chunks(spark):
    rows = [("a", float(i), i, 5 if 10 <= i < 300 else i) for i in range(400)]
    for width in WIDTHS:
        r = timing.longest_runs(frame(spark, rows), ["k"], "v", width).first()
        assert (r["run_start"], r["run_end"], r["run_length"], r["changes"]) == (10.0, 299.0, 290, 110)


def test_quantiles(spark):
    draw = random.Random(3)
    sets = {"a": [draw.choice([0.0, 0.01, 10.0, 10.0, 10.0, 10.004, 250.5]) for _ in range(501)], "b": [draw.random() * 1e-3 for _ in range(80)], "c": [7.25], "d": [0.0, 1e9], "e": [20.0] * 300 + [20.0 + 1e-9]}
    rows = spark.createDataFrame([(k, v) for k, some in sets.items() for v in some] + [("a", None), ("f", None)], "k string, v double").repartition(4)
    got = {r["k"]: (r["mid"], r["top"], r["low"]) for r in timing.quantiles(rows, ["k"], "v", {"mid": 0.5, "top": 0.99, "low": 0.0}).collect()}
    assert set(got) == set(sets)
    for k, (mid, top, low) in got.items():
        assert mid == pytest.approx(statistics.median(sets[k]), rel=1e-12) and top == pytest.approx(np.percentile(sets[k], 99), rel=1e-12) and low == min(sets[k])


def test_errors_near_gaps(spark):
    draw = random.Random(5)
    errors = [(draw.choice("lm"), i, round(draw.uniform(0, 60), 2), draw.choice(["ack", "bit", None])) for i in range(300)]
    gaps = [(draw.choice("lmn"), k, a := round(draw.uniform(0, 55), 2), round(a + draw.choice([0.0, 0.05, 1.0, 5.0]), 2)) for k in range(60)]
    gaps.append(("l", 99, errors[0][2] + 0.05, errors[0][2] + 0.05))  # an event just at the slack's end
    events = normalised(spark.createDataFrame(errors, "log_id string, seq long, t double, error_type string").select("*", F.lit("error").alias("kind"), F.lit(b"").alias("data"), F.lit(0).cast("long").alias("frame_id")))
    spans = spark.createDataFrame(gaps, "log_id string, frame_id long, start double, end double")
    expected = {}
    for log, k, a, b in gaps:
        for l, _, t, what in errors:
            if l == log and a - 0.05 <= t <= b + 0.05:
                key = (log, k, a, b, what or "error")
                expected[key] = expected.get(key, 0) + 1
    for width in WIDTHS:
        assert {tuple(r)[:-1]: r["n"] for r in timing.errors_near(spans, events, 0.05, width).collect()} == expected


def windows_over_whole_keys(df) -> list[str]:
    """Window nodes of the plan that order frames without a chunk among their keys."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return [line for line in plan.splitlines() if "Window [" in line and "lag(t" in line and "__chunk" not in line]


def test_no_window_over_a_whole_log(spark):
    rows = normalised(spark.range(10).select(F.col("id").alias("seq"), (F.col("id") * 1.0).alias("t"), F.lit(1).cast("long").alias("frame_id"), F.lit(b"1").alias("data")))
    for df in (timing.period_stats(rows), timing.message_gaps(rows, timing.base_period(timing.period_stats(rows), None, 0.25), 1.5)):
        assert not windows_over_whole_keys(df)
        assert "percentile" not in df._jdf.queryExecution().optimizedPlan().toString()


def hot_joins(spark, df):
    """Joins that shuffle all rows of a message, signal or channel into one task."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    lines = [line for line in plan.splitlines() if "SortMergeJoin [" in line or "ShuffledHashJoin [" in line]
    return [line for line in lines if "channel#" in line and not any(part in line for part in ("__chunk", "__bin", "before#", "start#"))]


@pytest.mark.parametrize("part", ["raw fields", "raw steps", "gaps"])
def test_small_tables_are_not_joined_by_shuffling(spark, part):
    from framelake.operators import diagnostics, message_report

    rows = normalised(spark.range(100).select(F.col("id").alias("seq"), (F.col("id") * 1.0).alias("t"), F.lit(1).cast("long").alias("frame_id"), F.to_binary(F.lpad(F.hex("id"), 4, "0"), F.lit("hex")).alias("data")))
    fields = diagnostics.raw_fields(rows, 7.0)
    if part == "raw fields":
        assert not hot_joins(spark, fields)
        found = {(r["byte"], r["field"]): (r["n"], r["uniques"], r["steps"], r["equal"], r["changes"]) for r in fields.collect()}
        assert found == {
            (0, "byte"): (100, 1, 0, 99, 0), (0, "low"): (100, 1, 0, 99, 0), (0, "high"): (100, 1, 0, 99, 0),
            (1, "byte"): (100, 100, 99, 0, 99), (1, "low"): (100, 16, 99, 0, 99), (1, "high"): (100, 7, 6, 93, 6),
        }
    elif part == "raw steps":
        counters = spark.createDataFrame([("log", 1, 1, "byte")], "log_id string, frame_id long, byte int, field string")
        assert not hot_joins(spark, message_report.raw_steps(rows, counters, 7.0))
    else:
        base = spark.createDataFrame([("log", 1, 0, 1000.0)], "log_id string, frame_id long, channel int, base_ms double")
        assert not hot_joins(spark, timing.message_gaps(rows, base, 1.5))


def test_counters_are_chosen_without_shuffling_samples(spark):
    from framelake.operators import decode, diagnostics
    from framelake.sources import frames as source

    catalog = source.event_catalog((256,))
    rows = normalised(spark.range(20).select(F.col("id").alias("seq"), (F.col("id") * 1.0).alias("t"), F.lit(256).cast("long").alias("frame_id"), F.lit(b"12345678").alias("data")))
    steps = diagnostics.counter_steps(decode.samples(rows, catalog), catalog, 7.0)
    plan = steps._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.splitlines() if "SortMergeJoin [" in line and "LeftSemi" in line]
    # Rows of equal consecutive values take few bytes: their tasks are numbered, so that none grows with the log.
    runs = timing.longest_runs(steps, ["signal"], "raw", 7.0)
    assert "REPARTITION_BY_NUM" in runs._jdf.queryExecution().executedPlan().toString()
