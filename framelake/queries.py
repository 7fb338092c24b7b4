"""Queries of the engine over frames projected from `events`, and the same in SQL for DuckDB."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.functions import bits
from framelake.operators import align, code_functions, decode, diagnostics, machines, message_report, review, series, timing
from framelake.plans import functions as specs
from framelake.plans.catalog import parse_dbc
from framelake.plans.conditions import Compiler, normalised
from framelake.sources import frames as source
from framelake.sources import blf, mf4, textlogs
from framelake.sources.places import shared_folder
from framelake.streaming import live

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

#: Frames of the projection, and samples decoded from their words by shifts.
BASE = """
WITH f0 AS (
  SELECT event_id AS seq, epoch_us(ts) AS t_us, (user_id % 2)::INT AS channel, 256 + user_id % 8 AS frame_id, CASE WHEN event_type = 'error' THEN 'error' ELSE 'data' END AS kind,
         CASE WHEN event_type = 'signup' THEN 4 ELSE 8 END AS dlc, round(value * 100)::BIGINT AS v100, json_extract_string(props, '$.k')::BIGINT AS k FROM events),
f1 AS (SELECT *, row_number() OVER (PARTITION BY frame_id, channel, kind ORDER BY t_us, seq) AS rn FROM f0),
frames AS (
  SELECT seq, t_us, t_us / 1e6 AS t, channel, frame_id, kind, dlc, ((rn - CASE WHEN rn % 97 = 0 THEN 1 ELSE 0 END) % 16) + v100 * 256 + k * 4294967296 AS word, v100, k,
         CASE WHEN kind = 'error' THEN (['stuff', 'form', 'crc', 'ack', 'bit'])[(k % 5) + 1] END AS error_type,
         CASE WHEN kind = 'error' AND v100 > 15000 THEN 'bus_off' WHEN kind = 'error' AND v100 > 5000 THEN 'passive' END AS state FROM f1),
data AS (SELECT * FROM frames WHERE kind = 'data'),
good AS (SELECT *, word & 15 AS c_raw, (word >> 8) & 65535 AS v_raw, (word >> 32) & 127 AS k_raw, (word >> 34) & 7 AS m_raw, (['OFF', 'READY', 'RUN', 'FAULT'])[((word >> 34) & 7) + 1] AS m_label
         FROM data WHERE dlc >= 8 AND frame_id <= 261)
"""
#: Held values on all ticks: Value256, Mode257 and Counter258 with the tick before.
ZOH = (
    BASE
    + """,
sampled_at AS (
  SELECT t, max_by(CASE WHEN frame_id = 256 AND dlc >= 8 THEN ((word >> 8) & 65535) * 0.01::DOUBLE + 0.0 END, seq) FILTER (frame_id = 256 AND dlc >= 8) AS v,
         max_by(CASE WHEN frame_id = 257 AND dlc >= 8 THEN coalesce((['OFF', 'READY', 'RUN', 'FAULT'])[((word >> 34) & 7) + 1], ((word >> 34) & 7)::VARCHAR) END, seq) FILTER (frame_id = 257 AND dlc >= 8) AS m,
         max_by(CASE WHEN frame_id = 258 AND dlc >= 8 THEN (word & 15)::DOUBLE END, seq) FILTER (frame_id = 258 AND dlc >= 8) AS c FROM data GROUP BY t),
cur AS (SELECT t, v IS NOT NULL OR m IS NOT NULL OR c IS NOT NULL AS sampled, v IS NOT NULL AS sv, m IS NOT NULL AS sm, c IS NOT NULL AS sc, last_value(v IGNORE NULLS) OVER w AS v, last_value(m IGNORE NULLS) OVER w AS m, last_value(c IGNORE NULLS) OVER w AS c FROM sampled_at
        WINDOW w AS (ORDER BY t ROWS UNBOUNDED PRECEDING)),
zoh AS (SELECT *, lag(v) OVER (ORDER BY t) AS pv, lag(m) OVER (ORDER BY t) AS pm, lag(c) OVER (ORDER BY t) AS pc, row_number() OVER (ORDER BY t) AS n FROM cur)"""
)
NAMES = ["Value256", "Mode257", "Counter258"]
CHUNK = 86_400.0


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


#: Logs that a session has loaded: (application, folder of the tables) -> where its frames are.
_LOADED: dict[tuple[str, str], str] = {}


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of `events`, loaded once a session as a log is: projected, and written to Parquet in order of time."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _LOADED:
        folder = shared_folder(spark)
        source.event_frames(spark, sf_dir).repartitionByRange("t", "seq").sortWithinPartitions("t", "seq").write.parquet(folder)
        _LOADED[key] = folder
    return spark.read.schema(source.FRAMES).parquet(_LOADED[key])


def _held(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.held(_frames(spark, sf_dir), source.event_catalog(), NAMES, CHUNK)


def _config(**changes) -> diagnostics.Config:
    return diagnostics.Config.of(source.event_catalog(), baud=1.0, load_window=3600.0, silence=1800.0, storm_count=3, storm_window=3600.0, near=60.0, chunk=CHUNK, **changes)


@query(BASE + "SELECT seq, t_us, channel, frame_id, frame_id > 2047 AS is_extended, kind, dlc, array_to_string(list_transform(range(dlc), lambda i: printf('%02x', (word >> (8 * i)) & 255)), ' ') AS payload FROM frames")
def q_frames_projection(spark, sf_dir):
    frames = _frames(spark, sf_dir)
    return frames.select("seq", F.rint(F.col("t") * 1e6).cast("long").alias("t_us"), "channel", "frame_id", "is_extended", "kind", "dlc", bits.payload_text(F.col("data")).alias("payload"))


@query(
    BASE
    + """SELECT seq, signal, raw, num, label FROM (
    SELECT seq, 'Counter' || frame_id AS signal, c_raw AS raw, c_raw::DOUBLE AS num, NULL::VARCHAR AS label FROM good UNION ALL SELECT seq, 'Value' || frame_id, v_raw, round(v_raw * 0.01::DOUBLE, 6), NULL FROM good
    UNION ALL SELECT seq, 'K' || frame_id, k_raw, k_raw::DOUBLE, NULL FROM good UNION ALL SELECT seq, 'Mode' || frame_id, m_raw, m_raw::DOUBLE, m_label FROM good)"""
)
def q_decode_signals(spark, sf_dir):
    return decode.samples(_frames(spark, sf_dir), source.event_catalog()).select("seq", "signal", "raw", F.round("num", 6).alias("num"), "label")


#: Samples of all signals in long form.
LONG_OF = (
    """, long AS (SELECT frame_id AS message_id, channel, t, seq, 'Counter' || frame_id AS signal, c_raw AS raw, c_raw::DOUBLE AS num, NULL::VARCHAR AS label, 4 AS bits FROM good
  UNION ALL SELECT frame_id, channel, t, seq, 'Value' || frame_id, v_raw, v_raw * 0.01::DOUBLE, NULL, 16 FROM good UNION ALL SELECT frame_id, channel, t, seq, 'K' || frame_id, k_raw, k_raw::DOUBLE, NULL, 7 FROM good
  UNION ALL SELECT frame_id, channel, t, seq, 'Mode' || frame_id, m_raw, m_raw::DOUBLE, m_label, 3 FROM good)"""
)


#: Two selectors, one selected by the other, and members selected by ranges of values.
NESTED = """
BU_: N
BO_ 256 Nested: 8 N
 SG_ Root M : 34|3@1+ (1,0) [0|0] "" N
 SG_ Sub m1M : 0|4@1+ (1,0) [0|0] "" N
 SG_ Plain m0 : 8|16@1+ (0.01,0) [0|0] "" N
 SG_ Deep m2 : 8|16@1+ (1,0) [0|0] "" N
 SG_ Span m2 : 32|7@1+ (1,0) [0|0] "" N
SG_MUL_VAL_ 256 Sub Root 1-1;
SG_MUL_VAL_ 256 Deep Sub 2-5, 9-9;
SG_MUL_VAL_ 256 Span Root 2-3, 6-7;
"""


@query(
    BASE
    + """, n AS (SELECT seq, (word >> 34) & 7 AS root, word & 15 AS sub, (word >> 8) & 65535 AS v, (word >> 32) & 127 AS k FROM data WHERE frame_id = 256 AND dlc >= 8)
    SELECT seq, 'Root' AS signal, root AS raw, root::DOUBLE AS num FROM n UNION ALL SELECT seq, 'Sub', sub, sub::DOUBLE FROM n WHERE root = 1 UNION ALL SELECT seq, 'Plain', v, round(v * 0.01::DOUBLE, 6) FROM n WHERE root = 0
    UNION ALL SELECT seq, 'Deep', v, v::DOUBLE FROM n WHERE root = 1 AND (sub BETWEEN 2 AND 5 OR sub = 9) UNION ALL SELECT seq, 'Span', k, k::DOUBLE FROM n WHERE root IN (2, 3, 6, 7)"""
)
def q_nested_multiplexers(spark, sf_dir):
    return decode.samples(_frames(spark, sf_dir), parse_dbc(NESTED)).select("seq", "signal", "raw", F.round("num", 6).alias("num"))


@query(BASE + "SELECT seq, frame_id, kind FROM frames WHERE t BETWEEN (SELECT min(t) + 100000 FROM frames) AND (SELECT min(t) + 900000 FROM frames) ORDER BY seq LIMIT 500")
def q_window_filter_cap(spark, sf_dir):
    frames = _frames(spark, sf_dir)
    first = frames.agg(F.min("t")).first()[0]
    return source.window(frames, first + 100_000, first + 900_000, 500).select("seq", "frame_id", "kind")


@query(BASE + "SELECT seq, kind FROM (SELECT *, row_number() OVER (ORDER BY t, kind = 'data', seq) AS n FROM frames) f WHERE n <= 700 AND t <= (SELECT max(t) FROM (SELECT * FROM frames ORDER BY t, kind = 'data', seq LIMIT 700) x WHERE kind = 'data')")
def q_cap_by_time(spark, sf_dir):
    return source.capped_by_time(_frames(spark, sf_dir), 700).select("seq", "kind")


@query(BASE + "SELECT frame_id, CASE WHEN frame_id <= 261 THEN 'known' ELSE 'unknown' END AS status, bool_or(dlc >= 8) AND frame_id <= 261 AS has_data FROM data GROUP BY frame_id")
def q_known_unknown_ids(spark, sf_dir):
    frames, messages = _frames(spark, sf_dir), source.event_catalog().message_table(spark)
    known = decode.with_data(frames, messages).select("frame_id", F.lit("known").alias("status"), "has_data")
    return known.unionByName(decode.unknown_ids(frames, messages).select("frame_id", F.lit("unknown").alias("status"), F.lit(False).alias("has_data")))


@query(BASE + "SELECT frame_id, count(*)::BIGINT AS n_frames, count_if(dlc >= 8)::BIGINT AS n_decodable, arg_min(dlc, (t, seq))::INT AS first_dlc FROM data WHERE frame_id <= 261 GROUP BY frame_id")
def q_decode_status(spark, sf_dir):
    return decode.decode_status(_frames(spark, sf_dir), source.event_catalog().message_table(spark)).select("frame_id", "n_frames", "n_decodable", "first_dlc")


@query(BASE + "SELECT count_if(kind = 'data')::BIGINT AS n_frames, count_if(kind <> 'data')::BIGINT AS n_events, count(DISTINCT CASE WHEN kind = 'data' THEN frame_id END)::BIGINT AS n_ids, count(DISTINCT CASE WHEN kind = 'data' AND frame_id > 261 THEN frame_id END)::BIGINT AS n_unknown, min(CASE WHEN kind = 'data' THEN t END) AS first_t, max(CASE WHEN kind = 'data' THEN t END) AS last_t FROM frames")
def q_summary(spark, sf_dir):
    messages = source.event_catalog().message_table(spark).select("frame_id", F.lit(True).alias("known"))
    rows = _frames(spark, sf_dir).join(F.broadcast(messages), "frame_id", "left")  # a row per message of the schema
    is_data = F.col("kind") == "data"
    return rows.agg(
        F.count_if(is_data).alias("n_frames"), F.count_if(~is_data).alias("n_events"), F.count_distinct(F.when(is_data, F.col("frame_id"))).alias("n_ids"),
        F.count_distinct(F.when(is_data & F.col("known").isNull(), F.col("frame_id"))).alias("n_unknown"), F.min(F.when(is_data, F.col("t"))).alias("first_t"), F.max(F.when(is_data, F.col("t"))).alias("last_t"),
    )


@query(BASE + "SELECT 'Value' || frame_id AS signal, round(arg_max(v_raw * 0.01::DOUBLE, (t, seq)), 6) AS num, max(t) AS t FROM good WHERE t <= (SELECT min(t) + 1000000 FROM frames) GROUP BY frame_id")
def q_value_at(spark, sf_dir):
    frames = _frames(spark, sf_dir)
    at = frames.agg(F.min("t")).first()[0] + 1_000_000
    found = align.value_at(frames, source.event_catalog(), [f"Value{i}" for i in range(256, 262)], at)
    return found.select("signal", F.round("num", 6).alias("num"), "t")


@query(BASE + "SELECT e.seq, e.error_type, round(g.v_raw * 0.01::DOUBLE, 6) AS value FROM (SELECT * FROM frames WHERE kind = 'error') e LEFT JOIN LATERAL (SELECT v_raw FROM good g WHERE g.frame_id = 256 AND g.t <= e.t ORDER BY g.t DESC, g.seq DESC LIMIT 1) g ON true")
def q_asof_errors(spark, sf_dir):
    frames = _frames(spark, sf_dir)
    right = decode.samples(frames, source.event_catalog(), ["Value256"]).select("log_id", "t", "seq", "num")
    left = frames.where("kind = 'error'").select("log_id", "t", F.col("seq").alias("event"), "error_type")
    return align.asof(left, right, ["log_id"], ["num"], CHUNK).select(F.col("event").alias("seq"), "error_type", F.round("right_num", 6).alias("value"))


@query(ZOH + "SELECT t, round(v, 6) AS value, m AS mode, c AS count, round(pv, 6) AS previous FROM zoh")
def q_zoh_align(spark, sf_dir):
    mode = Compiler(source.event_catalog()).actual("Mode257")
    return _held(spark, sf_dir).select("t", F.round("cur_Value256.num", 6).alias("value"), mode.alias("mode"), F.col("cur_Counter258.num").alias("count"), F.round("prev_Value256.num", 6).alias("previous"))


_TRUTHY = "({0} IS NOT NULL AND lower({0}) NOT IN ('off', '0', '0.0'))"


@query(
    ZOH
    + f"SELECT t, {_TRUTHY.format('m')} AND NOT {_TRUTHY.format('pm')} AS rising, {_TRUTHY.format('pm')} AND NOT {_TRUTHY.format('m')} AS falling, m IS DISTINCT FROM pm AS changed, coalesce(c, 0) <> 0 AND coalesce(pc, 0) = 0 AS count_rising FROM zoh"
)
def q_edges(spark, sf_dir):
    test = Compiler(source.event_catalog()).test
    return _held(spark, sf_dir).select("t", test({"rising": "Mode257"}).alias("rising"), test({"falling": "Mode257"}).alias("falling"), test({"changed": "Mode257"}).alias("changed"), test({"rising": "Counter258"}).alias("count_rising"))


CONDITION = {"all": [{"any": [{"signal": "Value256", "op": ">=", "value": 300}, {"signal": "Mode257", "op": "==", "value": "RUN"}]}, {"not": {"signal": "Counter258", "op": "<", "value": "0x4"}}]}


@query(ZOH + "SELECT t, (CASE WHEN v IS NULL THEN true ELSE v >= 300 END OR coalesce(m = 'RUN', false)) AND NOT CASE WHEN c IS NULL THEN false ELSE c < 4 END AS ok, round(v - 300, 6) AS margin FROM zoh")
def q_condition_eval(spark, sf_dir):
    compiler, condition = Compiler(source.event_catalog()), normalised(CONDITION)
    leaf = condition["all"][0]["any"][0]
    return _held(spark, sf_dir).select("t", compiler.test(condition).alias("ok"), F.round(compiler.margin(leaf), 6).alias("margin"))


@query(ZOH + "SELECT min(t) AS start, max(t) AS \"end\", count(*)::BIGINT AS ticks FROM (SELECT t, sum(sampled::INT) OVER (ORDER BY t) AS r FROM zoh) GROUP BY r")
def q_constant_runs(spark, sf_dir):
    return series.constant_runs(align.at_ticks(_frames(spark, sf_dir), source.event_catalog(), NAMES), CHUNK).select("start", "end", "ticks")


SPEC = {
    "functions": [
        {"id": "level", "name": "Level high", "enter": {"signal": "Value256", "op": ">", "value": 350}, "exit": {"signal": "Value256", "op": "<", "value": 150}, "trigger": {"changed": "Mode257"}},
        {"id": "mode", "name": "Mode runs", "enter": {"all": [{"rising": "Mode257"}, {"signal": "Counter258", "op": ">=", "value": 8}]}, "exit": {"signal": "Mode257", "op": "==", "value": "OFF"}, "initial": True},
    ]
}
#: The machines as tests per tick, then as scans: the state is the last set or reset, turned by later toggles.
LATCH = """,
steps0 AS (
  SELECT 'level' AS function, t, n, sampled, CASE WHEN v IS NULL THEN true ELSE v > 350 END AS e, CASE WHEN v IS NULL THEN false ELSE v < 150 END AS x, m IS DISTINCT FROM pm AS g, false AS initial FROM {z}
  UNION ALL SELECT 'mode', t, n, sampled, {up} AND CASE WHEN c IS NULL THEN true ELSE c >= 8 END, coalesce(m = 'OFF', false), {up}, true FROM {z}),
steps1 AS (SELECT *, sum((e AND x)::INT) OVER w AS tog, CASE WHEN e AND NOT x THEN 1 WHEN x AND NOT e THEN 0 END AS s FROM steps0 WINDOW w AS (PARTITION BY function ORDER BY t ROWS UNBOUNDED PRECEDING)),
steps2 AS (SELECT *, last_value(s IGNORE NULLS) OVER w AS ls, last_value(CASE WHEN s IS NOT NULL THEN tog END IGNORE NULLS) OVER w AS lt FROM steps1 WINDOW w AS (PARTITION BY function ORDER BY t ROWS UNBOUNDED PRECEDING)),
steps3 AS (SELECT *, (coalesce(ls + tog - lt, initial::INT + tog) % 2) = 1 AS after FROM steps2),
steps AS (SELECT *, coalesce(lag(after) OVER (PARTITION BY function ORDER BY t), initial) AS before FROM steps3)""".replace("{up}", f"({_TRUTHY.format('m')} AND NOT {_TRUTHY.format('pm')})")
FSM = ZOH + LATCH.replace("{z}", "zoh")
#: In fast mode a machine keeps ticks with a sample of its own signals, and the first; the tick before is the one kept before.
_KEPT = "{} AS (SELECT t, sampled, v, m, c, lag(v) OVER (ORDER BY t) AS pv, lag(m) OVER (ORDER BY t) AS pm, lag(c) OVER (ORDER BY t) AS pc, row_number() OVER (ORDER BY t) AS n FROM cur WHERE {})"
FAST = ZOH + ", " + _KEPT.format("fast_level", "sv OR sm OR t = (SELECT min(t) FROM cur)") + ", " + _KEPT.format("fast_mode", "sm OR sc OR t = (SELECT min(t) FROM cur)") + LATCH.replace("{z}", "fast_level", 1).replace("{z}", "fast_mode")


def _machines():
    return specs.parse(SPEC)[0]


def _steps(spark, sf_dir, fast=False):
    return machines.run(_frames(spark, sf_dir), source.event_catalog(), _machines(), fast, CHUNK)


@query(FSM + "SELECT function, CASE WHEN after THEN 'enter' ELSE 'exit' END AS type, t FROM steps WHERE before <> after")
def q_fsm_events(spark, sf_dir):
    return machines.events(_steps(spark, sf_dir), source.event_catalog(), _machines()).select("function", "type", "t")


_TRIED = "SELECT function, t, CASE WHEN function = 'level' THEN 1 ELSE 2 - (NOT e)::INT END::INT AS blocking FROM steps WHERE g AND NOT e AND NOT after"


@query(FSM + _TRIED)
def q_fsm_attempts(spark, sf_dir):
    found = machines.attempts(_steps(spark, sf_dir), source.event_catalog(), _machines())
    return found.select("function", "t", F.size("blocking").alias("blocking"))


@query(
    FSM
    + """, turns AS (SELECT function, t, after AS on_, 1 AS k FROM steps WHERE before <> after UNION ALL SELECT function, min(t), true, 0 FROM steps WHERE initial GROUP BY function),
    paired AS (SELECT *, lead(t) OVER (PARTITION BY function ORDER BY t, k) AS e FROM turns) SELECT function, t AS start, coalesce(e, (SELECT max(t) FROM zoh)) AS "end", e IS NULL AS open FROM paired WHERE on_"""
)
def q_fsm_intervals(spark, sf_dir):
    return machines.intervals(_steps(spark, sf_dir)).drop("log_id")


@query(FAST + "SELECT function, CASE WHEN after THEN 'enter' ELSE 'exit' END AS type, t FROM steps WHERE before <> after")
def q_fsm_fast(spark, sf_dir):
    return machines.events(_steps(spark, sf_dir, True), source.event_catalog(), _machines()).select("function", "type", "t")


@query(FAST + _TRIED)
def q_fsm_fast_attempts(spark, sf_dir):
    found = machines.attempts(_steps(spark, sf_dir, True), source.event_catalog(), _machines())
    return found.select("function", "t", F.size("blocking").alias("blocking"))


#: Machines whose results depend on which ticks they see: a trigger that is a level, and one that all ticks above a value turn.
LEVEL_SPEC = {
    "functions": [
        {"id": "low", "enter": {"signal": "Value256", "op": ">", "value": 400}, "exit": {"signal": "Value256", "op": "<", "value": 50}, "trigger": {"signal": "Value256", "op": ">", "value": 300}},
        {"id": "turn", "enter": {"signal": "Value256", "op": ">", "value": 250}, "exit": {"signal": "Value256", "op": ">", "value": 250}},
    ]
}
_LEVEL_SQL = """,
l0 AS (SELECT 'low' AS function, t, coalesce(v > 400, true) AS e, coalesce(v < 50, false) AS x, coalesce(v > 300, true) AS g FROM {z} UNION ALL SELECT 'turn', t, coalesce(v > 250, true), coalesce(v > 250, true), false FROM {z}),
l1 AS (SELECT *, sum((e AND x)::INT) OVER w AS tog, CASE WHEN e AND NOT x THEN 1 WHEN x AND NOT e THEN 0 END AS s FROM l0 WINDOW w AS (PARTITION BY function ORDER BY t ROWS UNBOUNDED PRECEDING)),
l2 AS (SELECT *, last_value(s IGNORE NULLS) OVER w AS ls, last_value(CASE WHEN s IS NOT NULL THEN tog END IGNORE NULLS) OVER w AS lt FROM l1 WINDOW w AS (PARTITION BY function ORDER BY t ROWS UNBOUNDED PRECEDING)),
l3 AS (SELECT *, (coalesce(ls + tog - lt, tog) % 2) = 1 AS after FROM l2), l4 AS (SELECT *, coalesce(lag(after) OVER (PARTITION BY function ORDER BY t), false) AS before FROM l3)
SELECT function, CASE WHEN after THEN 'enter' ELSE 'exit' END AS type, t FROM l4 WHERE before <> after UNION ALL SELECT function, 'attempt', t FROM l4 WHERE g AND NOT e AND NOT after"""


def _levels(spark, sf_dir, fast) -> DataFrame:
    machines_, catalog = specs.parse(LEVEL_SPEC)[0], source.event_catalog()
    steps = machines.run(_frames(spark, sf_dir), catalog, machines_, fast, CHUNK)
    tried = machines.attempts(steps, catalog, machines_).select("function", F.lit("attempt").alias("type"), "t")
    return machines.events(steps, catalog, machines_).select("function", "type", "t").unionByName(tried)


@query(ZOH + _LEVEL_SQL.replace("{z}", "zoh"))
def q_fsm_levels(spark, sf_dir):
    return _levels(spark, sf_dir, False)


@query(ZOH + ", " + _KEPT.format("own", "sv OR t = (SELECT min(t) FROM cur)") + _LEVEL_SQL.replace("{z}", "own"))
def q_fsm_levels_fast(spark, sf_dir):
    return _levels(spark, sf_dir, True)


@query(
    ZOH
    + """, ok AS (SELECT t, CASE WHEN v IS NULL THEN true ELSE v > 250 END AS ok FROM zoh), w AS (SELECT *, lag(ok) OVER (ORDER BY t) AS was FROM ok),
    st AS (SELECT t, ok, lead(t) OVER (ORDER BY t) AS e FROM w WHERE was IS NULL OR ok <> was) SELECT t AS start, coalesce(e, (SELECT max(t) FROM ok)) AS "end" FROM st WHERE ok"""
)
def q_watch_timeline(spark, sf_dir):
    _, spans = machines.watch(_frames(spark, sf_dir), source.event_catalog(), {"signal": "Value256", "op": ">", "value": 250}, CHUNK)
    return spans.select("start", "end")


def _functions(spark):
    return spark.createDataFrame([(m.id, m.name) for m in _machines()] + [("never", "Never runs")], "function string, name string")


@query(FSM + "SELECT function, name, type, t FROM (SELECT function, CASE function WHEN 'level' THEN 'Level high' ELSE 'Mode runs' END AS name, CASE WHEN after THEN 'enter' ELSE 'exit' END AS type, t FROM steps WHERE before <> after) WHERE type = 'enter' AND contains(lower(name), 'high') ORDER BY t LIMIT 100")
def q_event_list(spark, sf_dir):
    found = machines.events(_steps(spark, sf_dir), source.event_catalog(), _machines())
    return series.event_list(found, _functions(spark), ["enter"], None, "HIGH", 100).select("function", "name", "type", "t")


@query(FSM + "SELECT f AS function, type, coalesce(n, 0)::BIGINT AS n FROM (VALUES ('level'), ('mode'), ('never')) v(f) LEFT JOIN (SELECT function, CASE WHEN after THEN 'enter' ELSE 'exit' END AS type, count(*) AS n FROM steps WHERE before <> after GROUP BY 1, 2) c ON c.function = f")
def q_event_counts(spark, sf_dir):
    return series.event_counts(machines.events(_steps(spark, sf_dir), source.event_catalog(), _machines()), _functions(spark))


@query(
    BASE
    + """, p AS (SELECT 'Value256' AS signal, t, seq, round(v_raw * 0.01::DOUBLE, 6) AS y FROM good WHERE frame_id = 256 UNION ALL SELECT 'Mode257', t, seq, coalesce(list_position(['FAULT', 'OFF', 'READY', 'RUN'], NULL)::DOUBLE, m_raw::DOUBLE) FROM good WHERE frame_id = 257),
    n AS (SELECT *, row_number() OVER (PARTITION BY signal ORDER BY t, seq) - 1 AS i, count(*) OVER (PARTITION BY signal) AS c FROM p) SELECT signal, t, y FROM n WHERE i % ceil(c / 50.0)::BIGINT = 0"""
)
def q_series_downsample(spark, sf_dir):
    found = series.points(_frames(spark, sf_dir), source.event_catalog(), ["Value256", "Mode257"])
    return series.strided(found, 50, CHUNK).select("signal", "t", F.round("y", 6).alias("y"))


@query(BASE + "SELECT 'Value' || frame_id AS signal, round(min(v_raw * 0.01::DOUBLE), 6) AS lowest, round(max(v_raw * 0.01::DOUBLE), 6) AS highest, count(*)::BIGINT AS n FROM good WHERE frame_id IN (256, 257) GROUP BY frame_id")
def q_series_bounds(spark, sf_dir):
    return series.bounds(series.points(_frames(spark, sf_dir), source.event_catalog(), ["Value256", "Value257"])).select("signal", F.round("lowest", 6).alias("lowest"), F.round("highest", 6).alias("highest"), "n")


@query(BASE + ", b AS (SELECT min(t) AS a, min(t) + 1000000 AS z FROM frames) SELECT least(floor((t - a) / ((z - a) / 40)), 39)::BIGINT AS bucket, round(min(v_raw * 0.01::DOUBLE), 6) AS lowest, round(max(v_raw * 0.01::DOUBLE), 6) AS highest, count(*)::BIGINT AS n FROM good, b WHERE frame_id = 256 AND t BETWEEN a AND z GROUP BY 1")
def q_minmax_downsample(spark, sf_dir):
    frames = _frames(spark, sf_dir)
    first = frames.agg(F.min("t")).first()[0]
    found = series.lowest_highest(series.points(frames, source.event_catalog(), ["Value256"]), 40, first, first + 1_000_000)
    return found.select("bucket", F.round("lowest", 6).alias("lowest"), F.round("highest", 6).alias("highest"), "n")


@query(
    BASE
    + """SELECT seq, frame_id, CASE WHEN frame_id <= 261 THEN 'Event' || frame_id END AS name, dlc, CASE WHEN frame_id <= 261 AND dlc >= 8 THEN (word & 15)::DOUBLE::VARCHAR END AS count
    FROM data WHERE t BETWEEN (SELECT min(t) + 100000 FROM frames) AND (SELECT min(t) + 900000 FROM frames) ORDER BY t, seq LIMIT 300"""
)
def q_trace(spark, sf_dir):
    frames = _frames(spark, sf_dir)
    first = frames.agg(F.min("t")).first()[0]
    rows = series.trace(frames, source.event_catalog(), first + 100_000, first + 900_000, 300)
    return rows.select("seq", "frame_id", "name", "dlc", F.col("signals")[F.concat(F.lit("Counter"), F.col("frame_id"))].alias("count"))


@query(
    BASE
    + """, wanted(function, signal, id) AS (VALUES ('level', 'Value256', 256), ('level', 'Absent', NULL), ('level', 'K260', 260), ('mode', 'Mode257', 257), ('mode', 'Counter262', NULL))
    SELECT function, signal, CASE WHEN id IS NULL THEN 'missing' WHEN EXISTS (SELECT 1 FROM data WHERE frame_id = id AND frame_id <> 260 AND dlc >= 8) THEN 'available' ELSE 'nodata' END AS status FROM wanted"""
)
def q_function_coverage(spark, sf_dir):
    wanted = spark.createDataFrame([("level", 0, "Value256"), ("level", 1, "Absent"), ("level", 2, "K260"), ("mode", 0, "Mode257"), ("mode", 1, "Counter262")], "function string, position int, signal string")
    return series.coverage(wanted, source.event_catalog(), _frames(spark, sf_dir).where("frame_id <> 260")).select("function", "signal", "status")


@query(
    BASE
    + """, wanted(function, signal, id) AS (VALUES ('level', 'Value256', 256), ('level', 'Absent', NULL), ('gone', 'K260', 260), ('gone', 'Nothing', NULL), ('mode', 'Mode257', 257)),
    has AS (SELECT *, CASE WHEN id IS NULL THEN 'missing' WHEN EXISTS (SELECT 1 FROM data WHERE frame_id = id AND frame_id <> 260 AND dlc >= 8) THEN 'available' ELSE 'nodata' END AS status FROM wanted)
    SELECT function, count_if(status = 'available')::BIGINT AS available, count_if(status = 'nodata')::BIGINT AS nodata, count_if(status = 'missing')::BIGINT AS missing, count_if(status = 'available') = 0 AS dead FROM has GROUP BY 1"""
)
def q_dead_functions(spark, sf_dir):
    wanted = spark.createDataFrame([("level", 0, "Value256"), ("level", 1, "Absent"), ("gone", 0, "K260"), ("gone", 1, "Nothing"), ("mode", 0, "Mode257")], "function string, position int, signal string")
    return review.function_status(series.coverage(wanted, source.event_catalog(), _frames(spark, sf_dir).where("frame_id <> 260")))


@query(
    BASE
    + """ SELECT seq, array_to_string(list_sort(list_concat(['t', 'id', 'data', 'channel', 'is_extended'], CASE WHEN kind = 'error' THEN list_concat(['kind', 'error_type'], CASE WHEN state IS NULL THEN [] ELSE ['state'] END) ELSE [] END)), ',') AS fields,
    frame_id AS id, array_to_string(list_transform(range(dlc), lambda i: printf('%02x', (word >> (8 * i)) & 255)), ' ') AS data, CASE WHEN kind = 'error' THEN error_type END AS error_type FROM frames"""
)
def q_frame_json(spark, sf_dir):
    rows = review.frame_json(_frames(spark, sf_dir))
    of = lambda name: F.get_json_object("json", f"$.{name}")
    return rows.select("seq", F.array_join(F.sort_array(F.json_object_keys("json")), ",").alias("fields"), of("id").cast("long").alias("id"), of("data").alias("data"), of("error_type").alias("error_type"))


@query(
    FSM
    + """, ev AS (SELECT function, CASE WHEN after THEN 'enter' ELSE 'exit' END AS type, t, CASE function WHEN 'level' THEN 0 ELSE 1 END AS position FROM steps WHERE before <> after), cursor_ AS (SELECT min(t) + 2000000 AS t FROM zoh),
    b AS (SELECT ev.*, row_number() OVER (ORDER BY ev.t DESC, position DESC, type DESC) AS n FROM ev, cursor_ WHERE ev.t <= cursor_.t), a AS (SELECT ev.*, row_number() OVER (ORDER BY ev.t, position, type) AS n FROM ev, cursor_ WHERE ev.t > cursor_.t)
    SELECT CASE n WHEN 1 THEN 'current' ELSE 'previous' END AS which, function, type, t FROM b WHERE n <= 2 UNION ALL SELECT 'next', function, type, t FROM a WHERE n = 1"""
)
def q_event_steps(spark, sf_dir):
    frames = _frames(spark, sf_dir)
    at = frames.where("kind = 'data'").agg(F.min("t")).first()[0] + 2_000_000
    found = machines.events(_steps(spark, sf_dir), source.event_catalog(), _machines())
    return review.around(found, at).select("which", "function", "type", "t")


@query(BASE + """, v AS (SELECT min(v_raw * 0.01::DOUBLE) AS lo, max(v_raw * 0.01::DOUBLE) AS hi FROM good WHERE frame_id = 256), k AS (SELECT min(k_raw)::DOUBLE AS lo, max(k_raw)::DOUBLE AS hi FROM good WHERE frame_id = 258 AND k_raw = 7)
    SELECT 'Value256' AS signal, round(lo - (hi - lo) * 0.08, 6) AS low, round(hi + (hi - lo) * 0.08, 6) AS high FROM v UNION ALL SELECT 'Mode257', -0.4, 3.4 UNION ALL SELECT 'K258', lo - 1, hi + 1 FROM k""")
def q_axis_ranges(spark, sf_dir):
    """Axes of a signal, of an enumeration, and of one that is constant among the frames kept."""
    frames, catalog = _frames(spark, sf_dir), source.event_catalog()
    points = series.points(frames, catalog, ["Value256", "Mode257", "K258"]).where("signal <> 'K258' or y = 7")
    return review.axis_ranges(series.bounds(points), catalog).select("signal", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


@query(
    FSM
    + LONG_OF
    + """, texts AS (SELECT 'frames' AS part, concat_ws('|', seq, t_us, channel, frame_id, kind, array_to_string(list_transform(range(dlc), lambda i: printf('%02x', (word >> (8 * i)) & 255)), '')) AS x FROM frames
    UNION ALL SELECT 'samples', concat_ws('|', signal, seq, raw, round_even(num * 1e6, 0)::BIGINT, coalesce(label, '~')) FROM long
    UNION ALL SELECT 'events', concat_ws('|', function, CASE WHEN after THEN 'enter' ELSE 'exit' END, round_even(t * 1e6, 0)::BIGINT) FROM steps WHERE before <> after)
    SELECT part, count(*)::BIGINT AS n, sum(('0x' || substr(md5(x), 1, 12))::BIGINT)::VARCHAR AS digest FROM texts GROUP BY part"""
)
def q_golden(spark, sf_dir):
    frames, catalog = _frames(spark, sf_dir), source.event_catalog()
    return review.golden(frames, decode.samples(frames, catalog), machines.events(_steps(spark, sf_dir), catalog, _machines()))


@query(
    BASE
    + """, s AS (SELECT channel, count(*)::BIGINT AS n_frames, sum((47 + 8 * dlc) * 1.2::DOUBLE) AS bits, min(t) AS a, max(t) - min(t) AS span FROM data GROUP BY channel),
    b AS (SELECT d.channel, least(floor((d.t - a) / (span / greatest(ceil(span / 3600), 1))), greatest(ceil(span / 3600), 1) - 1) AS bin, sum((47 + 8 * dlc) * 1.2::DOUBLE) AS w FROM data d JOIN s USING (channel) GROUP BY 1, 2)
    SELECT channel, n_frames, round(bits / span * 100, 6) AS mean_load, round((SELECT max(w) FROM b WHERE b.channel = s.channel) / 3600 * 100, 6) AS peak_load FROM s"""
)
def q_bus_load(spark, sf_dir):
    return timing.bus_load(_frames(spark, sf_dir), 1.0, 3600.0).select("channel", "n_frames", F.round("mean_load", 6).alias("mean_load"), F.round("peak_load", 6).alias("peak_load"))


@query(BASE + ", d AS (SELECT frame_id, t, lag(t) OVER (PARTITION BY frame_id ORDER BY t, seq) AS b FROM data WHERE frame_id IN (256, 258, 260)) SELECT frame_id, b AS start, t AS \"end\", greatest(1, round_even((t - b) * 1000 / 2000000, 0) - 1)::BIGINT AS missing FROM d WHERE (t - b) * 1000 > 2000000 * 1.25")
def q_periodicity(spark, sf_dir):
    return diagnostics.periodicity(_frames(spark, sf_dir), _config()).select("frame_id", "start", "end", "missing")


@query(BASE + ", d AS (SELECT t, lag(t) OVER (ORDER BY t) AS b FROM (SELECT DISTINCT t FROM data)) SELECT b AS start, t AS \"end\" FROM d WHERE t - b > 1800")
def q_bus_silence(spark, sf_dir):
    return timing.silence(_frames(spark, sf_dir), 1800.0, CHUNK).select("start", "end")


@query(
    BASE
    + """, n AS (SELECT 'Node' || (frame_id % 3) AS node, t, seq FROM data WHERE frame_id <= 261), g AS (SELECT node, lag(t) OVER (PARTITION BY node ORDER BY t, seq) AS a, t AS z FROM n)
    SELECT node, a AS start, z AS "end" FROM g WHERE (z - a) * 1000 > 3 * 2000000 AND EXISTS (SELECT 1 FROM data d WHERE d.t BETWEEN a AND z AND (d.frame_id > 261 OR 'Node' || (d.frame_id % 3) <> node))
    UNION ALL SELECT 'Ghost', NULL, NULL"""
)
def q_node_offline(spark, sf_dir):
    config = _config()
    config = diagnostics.Config(**(vars(config) | {"nodes": {**config.nodes, "Ghost": (999,)}}))
    gaps, unseen = diagnostics.node_gaps(_frames(spark, sf_dir), config)
    null = F.lit(None).cast("double")
    return gaps.select("node", "start", "end").unionByName(unseen.select("node", null.alias("start"), null.alias("end")))


@query(
    BASE
    + """, s AS (SELECT min(t) AS a, max(t) - min(t) AS span, greatest(ceil((max(t) - min(t)) / 3600), 1) AS bins FROM frames WHERE kind = 'error')
    SELECT least(floor((t - a) / (span / bins)), bins - 1)::BIGINT AS bin, count(*)::BIGINT AS n FROM frames, s WHERE kind = 'error' GROUP BY 1 HAVING count(*) >= 3"""
)
def q_error_storm(spark, sf_dir):
    errors = _frames(spark, sf_dir).where("kind = 'error'")
    return timing.binned(errors, ["log_id"], 3600.0, F.lit(1)).where("weight >= 3").select("bin", F.col("weight").cast("long").alias("n"))


@query(BASE + "SELECT error_type, count(*)::BIGINT AS n FROM frames WHERE kind = 'error' GROUP BY 1")
def q_error_types(spark, sf_dir):
    return diagnostics.error_types(_frames(spark, sf_dir)).select("error_type", "n")


@query(BASE + "SELECT count(*)::BIGINT AS total, count_if(error_type <> 'ack')::BIGINT AS bit_level, count_if(error_type = 'ack')::BIGINT AS ack FROM frames WHERE kind = 'error'")
def q_error_ratios(spark, sf_dir):
    return diagnostics.error_ratios(_frames(spark, sf_dir)).drop("log_id")


@query(BASE + "SELECT state, min(t) AS t, arg_min(channel, (t, seq)) AS channel FROM frames WHERE state IS NOT NULL GROUP BY 1")
def q_state_first(spark, sf_dir):
    return diagnostics.first_states(_frames(spark, sf_dir)).drop("log_id")


#: Period statistics and base periods of each message and channel.
STATS = (
    BASE
    + """, d AS (SELECT frame_id, channel, t, seq, lag(t) OVER w AS b, (t - lag(t) OVER w) * 1000 AS ms FROM data WINDOW w AS (PARTITION BY frame_id, channel ORDER BY t, seq)),
st AS (SELECT frame_id, channel, count(*)::BIGINT AS n_frames, min(t) AS first_t, max(t) AS last_t, median(ms) AS median_ms, avg(ms) AS mean_ms, min(ms) AS min_ms, max(ms) AS max_ms, quantile_cont(ms, 0.99) AS p99_ms, stddev_pop(ms) AS std_ms FROM d GROUP BY 1, 2),
base AS (SELECT *, CASE WHEN frame_id IN (256, 258, 260) AND NOT abs(median_ms - 2000000) / 2000000 > 0.25 THEN 2000000.0::DOUBLE ELSE median_ms END AS base_ms FROM st),
gaps AS (SELECT d.frame_id, d.channel, b AS start, t AS "end", ms AS gap_ms, greatest(1, round_even(ms / base_ms, 0) - 1)::BIGINT AS missing, base_ms FROM d JOIN base USING (frame_id, channel) WHERE base_ms > 0 AND ms > base_ms * 1.5),
inside AS (SELECT g.*, (SELECT count(*) FROM data x WHERE x.t > g.start AND x.t < g."end")::BIGINT AS inside FROM gaps g)"""
)


@query(STATS + "SELECT frame_id, channel, n_frames, " + ", ".join(f"round({c}, 3) AS {c}" for c in ("median_ms", "mean_ms", "min_ms", "max_ms", "p99_ms", "std_ms")) + " FROM st")
def q_period_stats(spark, sf_dir):
    return timing.period_stats(_frames(spark, sf_dir), chunk_seconds=CHUNK).select("frame_id", "channel", "n_frames", *(F.round(c, 3).alias(c) for c in ("median_ms", "mean_ms", "min_ms", "max_ms", "p99_ms", "std_ms")))


@query(STATS + "SELECT frame_id, channel, round((n_frames - 1) / (last_t - first_t), 9) AS rate FROM st")
def q_message_rates(spark, sf_dir):
    stats = timing.period_stats(_frames(spark, sf_dir), chunk_seconds=CHUNK)
    return stats.select("frame_id", "channel", F.round(timing.rate(F.col("n_frames"), F.col("first_t"), F.col("last_t")), 9).alias("rate"))


@query(STATS + 'SELECT frame_id, channel, start, "end", round(gap_ms, 3) AS gap_ms, missing, inside FROM inside')
def q_gaps(spark, sf_dir):
    return diagnostics.message_gaps(_frames(spark, sf_dir), _config()).select("frame_id", "channel", "start", "end", F.round("gap_ms", 3).alias("gap_ms"), "missing", "inside")


@query(STATS + "SELECT frame_id, count(*)::BIGINT AS bursts FROM d JOIN base USING (frame_id, channel) WHERE ms < 0.25 * base_ms GROUP BY 1")
def q_bursts(spark, sf_dir):
    frames = _frames(spark, sf_dir)
    return timing.bursts(frames, diagnostics.bases(frames, _config()), CHUNK).drop("log_id")


@query(STATS + ", l AS (SELECT min(t) AS a, max(t) AS z FROM data) SELECT frame_id, channel, z - last_t > greatest(5 * base_ms / 1000, 0.5) AS stopped, first_t - a > greatest(5 * base_ms / 1000, 0.5) AS late, round(z - last_t, 3) AS silent_s, round(first_t - a, 3) AS late_s FROM base, l")
def q_stop_late(spark, sf_dir):
    frames = _frames(spark, sf_dir)
    return timing.stop_late(frames, diagnostics.bases(frames, _config())).select("frame_id", "channel", "stopped", "late", F.round("silent_s", 3).alias("silent_s"), F.round("late_s", 3).alias("late_s"))


@query(BASE + "SELECT frame_id, dlc, count(*)::BIGINT AS n FROM data GROUP BY 1, 2")
def q_dlc_hist(spark, sf_dir):
    return diagnostics.dlc_histogram(_frames(spark, sf_dir)).drop("log_id")


@query(BASE + "SELECT frame_id, count(DISTINCT channel)::INT AS channels FROM data GROUP BY 1")
def q_multichannel(spark, sf_dir):
    return diagnostics.channels_of(_frames(spark, sf_dir)).select("frame_id", F.size("channels").alias("channels"))


@query(
    BASE
    + """, p AS (SELECT frame_id, t, seq, CASE WHEN dlc = 4 THEN word & 4294967295 ELSE word END AS w FROM data), c AS (SELECT *, coalesce((w IS DISTINCT FROM lag(w) OVER o AND row_number() OVER o > 1)::INT, 0) AS ch FROM p WINDOW o AS (PARTITION BY frame_id ORDER BY t, seq)),
    r AS (SELECT *, sum(ch) OVER (PARTITION BY frame_id ORDER BY t, seq ROWS UNBOUNDED PRECEDING) AS run FROM c), g AS (SELECT frame_id, run, count(*) AS len, min(t) AS a, max(t) AS z FROM r GROUP BY 1, 2)
    SELECT frame_id, sum(len)::BIGINT AS n, (count(*) - 1)::BIGINT AS changes, max(len)::BIGINT AS run_length FROM g GROUP BY 1"""
)
def q_payload_stuck(spark, sf_dir):
    return diagnostics.payload_runs(_frames(spark, sf_dir), CHUNK).select("frame_id", "n", "changes", "run_length")


@query(STATS + ", e AS (SELECT t, coalesce(error_type, state, kind) AS what FROM frames WHERE kind <> 'data') SELECT frame_id, channel, start, what, count(*)::BIGINT AS n FROM gaps JOIN e ON e.t BETWEEN start - 60 AND \"end\" + 60 GROUP BY 1, 2, 3, 4")
def q_error_nearby(spark, sf_dir):
    frames = _frames(spark, sf_dir)
    gaps = timing.message_gaps(frames, diagnostics.bases(frames, _config()), 1.5, CHUNK).select("log_id", "frame_id", "channel", "start", "end")
    return timing.errors_near(gaps, frames, 60.0, CHUNK).select("frame_id", "channel", "start", "what", "n")


#: Bytes and nibbles of the primary channel of each id, without a schema.
FIELDS = (
    BASE
    + """, z AS (SELECT frame_id, channel, count(*) AS n, min(dlc) AS width, row_number() OVER (PARTITION BY frame_id ORDER BY count(*) DESC, channel) AS i FROM data GROUP BY 1, 2),
m AS (SELECT d.frame_id, d.t, d.seq, b.b AS byte, (d.word >> (8 * b.b)) & 255 AS v FROM data d JOIN z USING (frame_id, channel), range(8) b(b) WHERE i = 1 AND z.n >= 8 AND b.b < width),
f AS (SELECT frame_id, t, seq, byte, 'byte' AS field, 8 AS bits, v AS value FROM m UNION ALL SELECT frame_id, t, seq, byte, 'low', 4, v & 15 FROM m UNION ALL SELECT frame_id, t, seq, byte, 'high', 4, v >> 4 FROM m),
s AS (SELECT *, value - lag(value) OVER (PARTITION BY frame_id, byte, field ORDER BY t, seq) AS step FROM f),
a AS (SELECT frame_id, byte, field, bits, count(*) AS n, count(DISTINCT value) AS uniques, count_if(step = 1 OR step = 1 - (1 << bits)) AS steps, count_if(step = 0) AS equal, count_if(step <> 0) AS changes FROM s GROUP BY 1, 2, 3, 4),
counters AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY frame_id, byte ORDER BY steps / (n - 1) DESC, bits, field) AS nth FROM a WHERE uniques >= 4 AND steps / (n - 1) >= 0.55 AND (steps + equal) / (n - 1) >= 0.85) WHERE nth = 1)"""
)


@query(FIELDS + "SELECT frame_id, byte::INT AS byte, field, bits::INT AS bits, round(steps / (n - 1), 6) AS ratio FROM counters")
def q_raw_counter(spark, sf_dir):
    return diagnostics.raw_counters(diagnostics.raw_fields(_frames(spark, sf_dir), CHUNK)).select("frame_id", "byte", "field", "bits", F.round("ratio", 6).alias("ratio"))


@query(
    FIELDS
    + """SELECT frame_id, byte::INT AS byte, round(r, 6) AS ratio, uniques::BIGINT AS uniques FROM (SELECT *, changes / (n - 1) AS r, row_number() OVER (PARTITION BY frame_id ORDER BY changes / (n - 1) DESC, byte) AS nth FROM a
    WHERE field = 'byte' AND uniques >= 8 AND changes / (n - 1) >= 0.5 AND NOT EXISTS (SELECT 1 FROM counters c WHERE c.frame_id = a.frame_id AND c.byte = a.byte)) WHERE nth <= 4"""
)
def q_checksum_bytes(spark, sf_dir):
    fields = diagnostics.raw_fields(_frames(spark, sf_dir), CHUNK)
    return diagnostics.checksum_bytes(fields, diagnostics.raw_counters(fields)).select("frame_id", "byte", F.round("ratio", 6).alias("ratio"), "uniques")


@query(
    STATS
    + """, l AS (SELECT max(t) AS z FROM data), sp AS (SELECT frame_id, bool_or(z - last_t > greatest(5 * base_ms / 1000, 0.5)) AS stopped FROM base, l GROUP BY 1), mx AS (SELECT frame_id, count(DISTINCT dlc) > 1 AS mixed, count(*) AS n FROM data GROUP BY 1),
    pr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY n_frames DESC, channel) AS i FROM base) WHERE i = 1), gp AS (SELECT frame_id, count(*) AS gaps, max(gap_ms) AS max_gap_ms, bool_or(inside > 0) AS busy FROM inside GROUP BY 1),
    r AS (SELECT frame_id, n::BIGINT AS n_frames, round(median_ms, 2) AS period_ms, coalesce(gaps, 0)::BIGINT AS gaps, round(coalesce(max_gap_ms, 0), 1) AS max_gap_ms,
      (3 * coalesce(gaps, 0) + 20 * stopped::INT + 8 * mixed::INT + 6 * (frame_id IN (256, 258, 260) AND abs(median_ms - 2000000) / 2000000 > 0.25)::INT + 2 * coalesce(busy, false)::INT * least(coalesce(gaps, 0), 10))::BIGINT AS score
      FROM mx JOIN sp USING (frame_id) JOIN pr USING (frame_id) LEFT JOIN gp USING (frame_id)) SELECT * FROM r WHERE score > 0"""
)
def q_rank_messages(spark, sf_dir):
    return diagnostics.ranking(_frames(spark, sf_dir), _config()).drop("log_id")


#: Long samples of all signals.
LONG = BASE + LONG_OF


@query(
    LONG
    + """, c AS (SELECT *, coalesce(label, raw::VARCHAR) AS shown FROM long), h AS (SELECT *, coalesce((shown IS DISTINCT FROM lag(shown) OVER o AND row_number() OVER o > 1)::INT, 0) AS ch FROM c WINDOW o AS (PARTITION BY signal ORDER BY t, seq))
    SELECT signal, count(*)::BIGINT AS n, sum(ch)::BIGINT AS changes, count(DISTINCT shown)::BIGINT AS uniques, round(min(CASE WHEN label IS NULL THEN num END), 6) AS minimum, round(max(CASE WHEN label IS NULL THEN num END), 6) AS maximum FROM h GROUP BY 1"""
)
def q_signal_profile(spark, sf_dir):
    profiles = diagnostics.signal_profiles(decode.samples(_frames(spark, sf_dir), source.event_catalog()), CHUNK)
    return profiles.select("signal", "n", "changes", "uniques", F.round("minimum", 6).alias("minimum"), F.round("maximum", 6).alias("maximum"))


@query(
    LONG
    + """, c AS (SELECT *, coalesce(label, raw::VARCHAR) AS shown FROM long), h AS (SELECT *, coalesce((shown IS DISTINCT FROM lag(shown) OVER o AND row_number() OVER o > 1)::INT, 0) AS ch FROM c WINDOW o AS (PARTITION BY signal ORDER BY t, seq)),
    r AS (SELECT *, sum(ch) OVER (PARTITION BY signal ORDER BY t, seq ROWS UNBOUNDED PRECEDING) AS run FROM h), g AS (SELECT signal, run, count(*)::BIGINT AS len, min(t) AS a, max(t) AS z FROM r GROUP BY 1, 2)
    SELECT signal, arg_max(a, len * 1000000 - run) AS run_start, arg_max(z, len * 1000000 - run) AS run_end, max(len) AS run_length FROM g GROUP BY 1"""
)
def q_sig_stuck(spark, sf_dir):
    profiles = diagnostics.signal_profiles(decode.samples(_frames(spark, sf_dir), source.event_catalog()), CHUNK)
    return profiles.select("signal", "run_start", "run_end", "run_length")


@query(LONG + "SELECT signal, count(*)::BIGINT AS n, min(t) AS first_t, round(min(num), 6) AS lowest, round(max(num), 6) AS highest FROM long WHERE signal LIKE 'Value%' AND (num > 480 + 1e-9 OR num < -1e-9) GROUP BY 1")
def q_sig_range(spark, sf_dir):
    values = decode.samples(_frames(spark, sf_dir), source.event_catalog())
    return diagnostics.out_of_range(values, source.event_catalog()).select("signal", "n", "first_t", F.round("lowest", 6).alias("lowest"), F.round("highest", 6).alias("highest"))


@query(LONG + "SELECT signal, count(*)::BIGINT AS n, min(t) AS first_t, count(DISTINCT raw)::INT AS raws FROM long WHERE signal LIKE 'Mode%' AND label IS NULL GROUP BY 1")
def q_enum_invalid(spark, sf_dir):
    values = decode.samples(_frames(spark, sf_dir), source.event_catalog())
    return diagnostics.invalid_labels(values, source.event_catalog()).select("signal", "n", "first_t", F.size("raws").alias("raws"))


#: Steps of the counters (named so, or behaving so; here only those named so do).
STEPS = (
    STATS
    + """, c AS (SELECT frame_id, channel, t, seq, c_raw, lag(t) OVER o AS before, c_raw - lag(c_raw) OVER o AS step FROM good WINDOW o AS (PARTITION BY frame_id, channel ORDER BY t, seq))"""
)


@query(STEPS + 'SELECT \'Counter\' || c.frame_id AS signal, c.channel, c.t, c.step FROM c WHERE step IS NOT NULL AND step NOT IN (0, 1, -15) AND NOT EXISTS (SELECT 1 FROM gaps g WHERE g.frame_id = c.frame_id AND g.channel = c.channel AND g.start = c.before)')
def q_counter_jump(spark, sf_dir):
    frames, catalog = _frames(spark, sf_dir), source.event_catalog()
    steps = diagnostics.counter_steps(decode.samples(frames, catalog), catalog, CHUNK)
    gaps = timing.message_gaps(frames, diagnostics.bases(frames, _config()), 1.5, CHUNK)
    return diagnostics.counter_jumps(steps, gaps).select("signal", "channel", "t", "step")


@query(
    STEPS
    + """, h AS (SELECT *, coalesce((step <> 0)::INT, 0) AS ch FROM c), r AS (SELECT *, sum(ch) OVER (PARTITION BY frame_id, channel ORDER BY t, seq ROWS UNBOUNDED PRECEDING) AS run FROM h),
    g AS (SELECT frame_id, channel, run, count(*) AS len, min(t) AS a, max(t) AS z FROM r GROUP BY 1, 2, 3), b AS (SELECT frame_id, channel, arg_max(a, len * 1000000 - run) AS a, arg_max(z, len * 1000000 - run) AS z, max(len) AS len FROM g GROUP BY 1, 2)
    SELECT 'Counter' || frame_id AS signal, channel, a AS start, z AS "end" FROM b JOIN base USING (frame_id, channel) WHERE len > 1 AND z - a >= greatest(0.1, 0.5 * base_ms / 1000)"""
)
def q_counter_freeze(spark, sf_dir):
    frames, catalog = _frames(spark, sf_dir), source.event_catalog()
    steps = diagnostics.counter_steps(decode.samples(frames, catalog), catalog, CHUNK)
    tenth = diagnostics.bases(frames, _config()).withColumn("base_ms", F.col("base_ms") / 10)  # this projection never stops for five periods
    return diagnostics.counter_freezes(steps, tenth, CHUNK).select("signal", "channel", "start", "end")


@query(BASE + "SELECT 'msg_absent' AS \"check\", 'error' AS severity, '0x109' AS entity, (SELECT count(DISTINCT frame_id) FROM data WHERE abs(frame_id - 265) <= 4)::DOUBLE AS value")
def q_message_absent(spark, sf_dir):
    found = message_report.diagnose(_frames(spark, sf_dir), source.event_catalog(), 265, _config())
    return found.findings.select("check", "severity", F.col("entities")[0].alias("entity"), "value")


@query(BASE + "SELECT channel, count(*) AS n_frames, min(t) AS first_t, max(t) AS last_t, (SELECT count(DISTINCT channel) FROM data WHERE frame_id = 257)::INT AS channels FROM data WHERE frame_id = 257 GROUP BY channel")
def q_message_report(spark, sf_dir):
    found = message_report.diagnose(_frames(spark, sf_dir), source.event_catalog(), 257, _config())
    return found.stats.select("channel", "n_frames", "first_t", "last_t", F.size("channels").alias("channels"))


@query(
    STATS
    + """, m AS (SELECT frame_id, arg_max(channel, n * 10 - channel) AS channel FROM (SELECT frame_id, channel, count(*) AS n FROM data WHERE frame_id IN (262, 263) GROUP BY 1, 2) GROUP BY 1),
    c AS (SELECT frame_id, channel, t, seq, lag(t) OVER o AS before, (word & 15) - lag(word & 15) OVER o AS step FROM data JOIN m USING (frame_id, channel) WINDOW o AS (PARTITION BY frame_id ORDER BY t, seq))
    SELECT frame_id AS message_id, 'Byte0.low' AS signal, count(*) AS n, min(t) AS t FROM c WHERE step IS NOT NULL AND step NOT IN (0, 1, -15)
    AND NOT EXISTS (SELECT 1 FROM gaps g WHERE g.frame_id = c.frame_id AND g.channel = c.channel AND g.start = c.before) GROUP BY 1"""
)
def q_raw_counter_jumps(spark, sf_dir):
    frames = decode.data_frames(_frames(spark, sf_dir), [262, 263])
    counters = diagnostics.raw_counters(diagnostics.raw_fields(frames, CHUNK))
    gaps = timing.message_gaps(frames, diagnostics.bases(frames, _config()), 1.5, CHUNK)
    jumps = diagnostics.counter_jumps(message_report.raw_steps(frames, counters, CHUNK), gaps)
    return jumps.groupBy("message_id", "signal").agg(F.count("*").alias("n"), F.min("t").alias("t"))


@query(FSM + "SELECT count(*) AS total, count(*) > 10 AS truncated FROM steps WHERE before <> after AND after")
def q_event_total(spark, sf_dir):
    found = machines.events(_steps(spark, sf_dir), source.event_catalog(), _machines())
    return series.event_total(found, _functions(spark), ["enter"], most=10)


@query(FSM + "SELECT function, CASE WHEN after THEN 'enter' ELSE 'exit' END AS type, t FROM (SELECT *, row_number() OVER (PARTITION BY function ORDER BY t DESC) AS k FROM steps WHERE before <> after AND t <= (SELECT min(t) + 2000000 FROM zoh)) WHERE k = 1")
def q_latest_event(spark, sf_dir):
    frames = _frames(spark, sf_dir)
    at = frames.where("kind = 'data'").agg(F.min("t")).first()[0] + 2_000_000
    found = machines.events(_steps(spark, sf_dir), source.event_catalog(), _machines())
    return series.latest_event(found, at).select("function", "type", "t")


CODE = """
ACTIVE = "HIGH"
INITIAL = "LOW"

def update(t, s, dt):
    if s.Value256 is None:
        return None
    if s.Value256 > 350:
        reason("above")
        return "HIGH"
    if s.Value256 < 150:
        return "LOW"
    if s.changed("Mode257") and s.Mode257 == "RUN":
        attempt("between")
"""


_CODE_SQL = """, r AS (SELECT t, m, pm, n, v, CASE WHEN v > 350 THEN 1 WHEN v < 150 THEN 0 END AS s FROM {z}), l AS (SELECT *, coalesce(last_value(s IGNORE NULLS) OVER (ORDER BY t ROWS UNBOUNDED PRECEDING), 0) AS st FROM r), b AS (SELECT *, coalesce(lag(st) OVER (ORDER BY t), 0) AS was FROM l)
    SELECT 'event' AS kind, CASE WHEN st = 1 THEN 'enter' ELSE 'exit' END AS type, t FROM b WHERE st <> was UNION ALL SELECT 'attempt', NULL, t FROM b WHERE v BETWEEN 150 AND 350 AND m = 'RUN' AND m IS DISTINCT FROM pm"""


def _coded(spark, sf_dir, fast):
    _, coded = specs.parse({"functions": [{"id": "high", "code": CODE}]}, source.event_catalog())
    out = code_functions.run(_frames(spark, sf_dir), source.event_catalog(), coded, fast, allow_code=True)
    return out.where("kind <> 'interval'").select("kind", "type", "t")


@query(ZOH + _CODE_SQL.replace("{z}", "zoh"))
def q_code_function(spark, sf_dir):
    return _coded(spark, sf_dir, False)


@query(ZOH + ", " + _KEPT.format("fast", "sv OR sm") + _CODE_SQL.replace("{z}", "fast"))
def q_code_fast(spark, sf_dir):
    return _coded(spark, sf_dir, True)


#: Says something at every tick above a value: in fast mode at its own ticks alone.
TICK_CODE = """
def update(t, s, dt):
    if s.Value256 is not None and s.Value256 > 400:
        attempt("high")
"""


def _ticking(spark, sf_dir, fast):
    _, coded = specs.parse({"functions": [{"id": "high", "code": TICK_CODE}]}, source.event_catalog())
    out = code_functions.run(_frames(spark, sf_dir), source.event_catalog(), coded, fast, allow_code=True)
    return out.select("kind", "t")


@query(ZOH + " SELECT 'attempt' AS kind, t FROM zoh WHERE v > 400")
def q_code_ticks(spark, sf_dir):
    return _ticking(spark, sf_dir, False)


@query(ZOH + " SELECT 'attempt' AS kind, t FROM cur WHERE v > 400 AND sv")
def q_code_ticks_fast(spark, sf_dir):
    return _ticking(spark, sf_dir, True)


# --- the same over streams ------------------------------------------------------------------------------------------


def _stream(spark, sf_dir) -> DataFrame:
    """The log's frames as a stream, and a data and an error frame a month later, so that the watermark passes all others."""
    frames = _frames(spark, sf_dir)
    last = frames.agg(F.max("t")).first()[0]
    ends = [frames.where(F.col("kind") == kind).limit(1).withColumn("t", F.lit(last + 30 * 86_400.0)).withColumn("frame_id", F.lit(0).cast("long")) for kind in ("data", "error")]
    folder = shared_folder(spark)
    diagnostics.union([frames, *ends]).withColumn("ts", F.timestamp_seconds("t")).write.parquet(folder)
    return spark.readStream.schema(f"{source.FRAMES}, ts timestamp").parquet(folder)


def _streamed(stream: DataFrame) -> DataFrame:
    """What the stream gives until its input is used up."""
    spark, folder, name = stream.sparkSession, shared_folder(stream.sparkSession), "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        query_ = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start()
        query_.awaitTermination()
    finally:
        spark.conf.set(name, before)
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


@query(ZOH + _LEVEL_SQL.replace("{z}", "zoh"))
def q_stream_machines(spark, sf_dir):
    """The machines of q_fsm_levels over a stream of frames: signals held, and their states kept, by operators with state."""
    return _streamed(live.machines_of(_stream(spark, sf_dir), source.event_catalog(), specs.parse(LEVEL_SPEC)[0], "1 hour", 21_600.0)).select("function", "type", "t")


@query(BASE + " SELECT channel, floor(t / 3600)::BIGINT * 3600 AS start, round(sum((47 + 8 * dlc) * 1.2::DOUBLE) / 3600 * 100, 6) AS load FROM data GROUP BY 1, 2")
def q_stream_load(spark, sf_dir):
    found = _streamed(live.load(_stream(spark, sf_dir), 1.0, "1 hour", 3600.0))
    return found.select("channel", F.unix_seconds("start").alias("start"), F.round("load", 6).alias("load"))


@query(BASE + " SELECT floor(t / 3600)::BIGINT * 3600 AS start, count(*)::BIGINT AS n FROM frames WHERE kind = 'error' GROUP BY 1 HAVING count(*) >= 4")
def q_stream_storms(spark, sf_dir):
    return _streamed(live.storms(_stream(spark, sf_dir), 4, "1 hour")).select(F.unix_seconds("start").alias("start"), "n")


@query(BASE + ", b AS (SELECT t_us, lag(t_us) OVER (ORDER BY t_us) AS p FROM data), s AS (SELECT t_us, sum((p IS NULL OR t_us - p >= 1200000000)::INT) OVER (ORDER BY t_us ROWS UNBOUNDED PRECEDING) AS k FROM b) SELECT min(t_us) AS start_us, max(t_us) + 1200000000 AS end_us, count(*)::BIGINT AS n FROM s GROUP BY k")
def q_stream_busy(spark, sf_dir):
    found = _streamed(live.busy_spans(_stream(spark, sf_dir), "20 minutes"))
    return found.select(F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n")


def _rendered(spark, sf_dir, line) -> DataFrame:
    """Lines of text made of the projection's frames, one log per channel."""
    frames = _frames(spark, sf_dir)
    return frames.select(F.lit("log").alias("log_id"), F.col("seq").alias("line_no"), line(F.rint(F.col("t") * 1e6).cast("long")).alias("line"))


def _seconds(t_us):
    return F.format_string("%d.%06d", F.floor(t_us / 1_000_000), t_us % 1_000_000)


_PARSED = BASE + "SELECT seq, t_us, {channel} AS channel, {id} AS frame_id, kind, {dlc} AS dlc, {error} AS error_type FROM frames {where}"


def _parsed(frames: DataFrame) -> DataFrame:
    return frames.select("seq", F.rint(F.col("t") * 1e6).cast("long").alias("t_us"), "channel", "frame_id", "kind", "dlc", "error_type")


@query(_PARSED.format(channel="CASE WHEN kind = 'data' THEN 0 ELSE channel END", id="CASE WHEN kind = 'data' THEN frame_id ELSE 0 END", dlc="CASE WHEN kind = 'data' THEN dlc ELSE 0 END", error="error_type", where=""))
def q_parse_asc(spark, sf_dir):
    data = lambda t: F.format_string(" %s %d  %s  Rx   d %d %s", _seconds(t), "channel", F.hex("frame_id"), "dlc", bits.payload_text(F.col("data")))
    error = lambda t: F.format_string("%s %d ErrorFrame Flags = %s error", _seconds(t), "channel", "error_type")
    return _parsed(textlogs.parse_asc(_rendered(spark, sf_dir, lambda t: F.when(F.col("kind") == "data", data(t)).otherwise(error(t)))))


@query(_PARSED.format(channel="0", id="frame_id", dlc="dlc", error="NULL::VARCHAR", where="WHERE kind = 'data'"))
def q_parse_csv(spark, sf_dir):
    line = lambda t: F.when(F.col("kind") == "data", F.concat_ws(",", t.cast("string"), F.concat(F.lit("0x"), F.hex("frame_id")), bits.payload_text(F.col("data")))).otherwise("spoilt,row")
    head = ["time_us,id,data"]
    return _parsed(textlogs.parse_csv(_rendered(spark, sf_dir, line), head))


@query(BASE + "SELECT kind, t_us, CASE WHEN kind = 'data' THEN frame_id ELSE 0 END AS frame_id, CASE WHEN kind = 'data' THEN dlc ELSE 0 END AS dlc FROM frames WHERE t BETWEEN (SELECT min(t) + 100000 FROM frames) AND (SELECT min(t) + 900000 FROM frames)")
def q_read_log(spark, sf_dir):
    """The log written as text files, data frames in one format and errors in another, and a span of it read by their names."""
    frames, folder = _frames(spark, sf_dir), shared_folder(spark)
    first = frames.agg(F.min("t")).first()[0]
    data = F.format_string("%d) %s %s Rx %d %s", "seq", _seconds(F.rint(F.col("t") * 1e6).cast("long")), F.lpad(F.hex("frame_id"), 4, "0"), "dlc", bits.payload_text(F.col("data")))
    error = F.format_string("%s %d ErrorFrame Flags = %s error", _seconds(F.rint(F.col("t") * 1e6).cast("long")), "channel", "error_type")
    frames.where("kind = 'data'").select(data.alias("value")).write.text(f"{folder}/log.trc")
    frames.where("kind = 'error'").select(error.alias("value")).write.text(f"{folder}/log.asc")
    parts = [textlogs.read_log(spark, f"{folder}/log.{form}", first + 100_000, first + 900_000) for form in ("trc", "asc")]
    return diagnostics.union(parts).select("kind", F.rint(F.col("t") * 1e6).cast("long").alias("t_us"), "frame_id", "dlc")


@query(_PARSED.format(channel="0", id="frame_id", dlc="dlc", error="NULL::VARCHAR", where="WHERE kind = 'data'"))
def q_parse_csv_heads(spark, sf_dir):
    """Four tables of the same frames' quarters, whose heads name the columns otherwise and in other orders."""
    hexed, data = F.concat(F.lit("0x"), F.hex("frame_id")), bits.payload_text(F.col("data"))
    forms = [
        ("identifier,raw,dlc,time[us]", lambda t: F.concat_ws(",", hexed, data, "dlc", t.cast("string"))),
        ("d;msgid;t[us]", lambda t: F.concat_ws(";", data, F.col("frame_id").cast("string"), t.cast("string"))),
        ("direction\tts\tpayload\tarbitration_id", lambda t: F.concat_ws("\t", F.lit("Rx"), _seconds(t), data, hexed)),
        ('"timestamp[us]","can_id","data_bytes"', lambda t: F.concat_ws(",", F.format_string('"%d"', t), F.concat(F.lit('"'), hexed, F.lit('"')), F.concat(F.lit('"'), data, F.lit('"')))),
    ]
    frames = _frames(spark, sf_dir).where("kind = 'data'")
    parts = []
    for k, (head, line) in enumerate(forms):
        some = frames.where(F.col("seq") % len(forms) == k)
        rows = some.select(F.lit("log").alias("log_id"), F.col("seq").alias("line_no"), line(F.rint(F.col("t") * 1e6).cast("long")).alias("line"))
        parts.append(_parsed(textlogs.parse_csv(rows, [head, *(r["line"] for r in rows.orderBy("line_no").limit(5).collect())])))
    return diagnostics.union(parts)


@query(BASE + """SELECT t_us, channel, kind, CASE WHEN kind = 'data' THEN dlc ELSE 0 END AS dlc, error_type,
    CASE WHEN kind = 'data' THEN frame_id ELSE map {'stuff': 1, 'form': 2, 'ack': 4, 'bit': 8, 'crc': 32}[error_type] END::BIGINT AS frame_id,
    CASE WHEN kind = 'error' THEN 0 WHEN dlc = 4 THEN word & 4294967295 ELSE word END::BIGINT AS word FROM frames""")
def q_read_blf(spark, sf_dir):
    """All frames written as binary logs, one for each of Spark's partitions, and read again by ranges of 128 kB."""
    folder = shared_folder(spark)
    blf.write(_frames(spark, sf_dir).orderBy("t", "seq"), folder).agg(F.sum("frames")).collect()
    frames = blf.read(spark, folder, 128 << 10)
    return frames.select(F.rint(F.col("t") * 1e6).cast("long").alias("t_us"), "channel", "kind", "dlc", "error_type", "frame_id", F.when(F.col("kind") == "error", F.lit(0).cast("long")).otherwise(bits.little_word(F.col("data"))).alias("word"))


@query(BASE + "SELECT t_us, channel, dlc, frame_id, CASE WHEN dlc = 4 THEN word & 4294967295 ELSE word END::BIGINT AS word FROM data")
def q_read_mf4(spark, sf_dir):
    """All data frames written as measurement files, one for each of Spark's partitions, and read again by 64 kB of records."""
    folder = shared_folder(spark)
    mf4.write(_frames(spark, sf_dir), folder, 20_000).agg(F.sum("frames")).collect()
    frames = mf4.read(spark, folder, 64 << 10)
    return frames.select(F.rint(F.col("t") * 1e6).cast("long").alias("t_us"), "channel", "dlc", "frame_id", bits.little_word(F.col("data")).alias("word"))


@query(_PARSED.format(channel="channel", id="frame_id", dlc="dlc", error="NULL::VARCHAR", where="WHERE kind = 'data'"))
def q_parse_json(spark, sf_dir):
    frames = _frames(spark, sf_dir).where("kind = 'data'")
    entry = F.to_json(F.struct(F.col("t").alias("time"), F.col("frame_id").alias("can_id"), bits.payload_text(F.col("data")).alias("payload"), "channel"))
    documents = frames.select(F.col("seq").cast("string").alias("log_id"), F.concat(F.lit('{"frames":['), entry, F.lit("]}")).alias("text"))
    return _parsed(textlogs.parse_json(documents).withColumn("seq", F.col("log_id").cast("long")))


@query(_PARSED.format(channel="0", id="frame_id", dlc="dlc", error="NULL::VARCHAR", where="WHERE kind = 'data'"))
def q_parse_trc(spark, sf_dir):
    line = lambda t: F.when(F.col("kind") == "data", F.format_string("%d) %s %s Rx %d %s", "seq", _seconds(t), F.lpad(F.hex("frame_id"), 4, "0"), "dlc", bits.payload_text(F.col("data")))).otherwise(";note")
    return _parsed(textlogs.parse_trc(_rendered(spark, sf_dir, line)))


_FORMS = ", f AS (SELECT seq, (seq % 9)::INT AS form, printf('%02x', k) AS a, printf('%02x', v100 & 255) AS b FROM frames)"


@query(
    BASE + _FORMS + """ SELECT seq, CASE form WHEN 0 THEN upper(a || b) WHEN 1 THEN upper(a || b) WHEN 2 THEN upper(a || b) WHEN 3 THEN upper('0' || substr(a, 2, 1) || '0' || substr(b, 2, 1)) WHEN 4 THEN upper('0' || substr(b, 2, 1)) WHEN 5 THEN '' END AS bytes FROM f"""
)
def q_hex_bytes(spark, sf_dir):
    """Numbers of the frames written in nine forms, of which three are none of bytes, and read."""
    two = lambda n: F.lower(F.lpad(F.hex(n), 2, "0"))
    frames = source.event_words(spark.read.parquet(f"{sf_dir}/events.parquet")).select("seq", two(F.col("k")).alias("a"), two(F.col("v100").bitwiseAND(F.lit(255))).alias("b"))
    forms = ("{a} {b}", "{a}{b}", "0x{a} 0x{b}", "{a1},{b1}", "{b1}", "", "1{a} 1", "z{a}", "0x1{b}")
    text = F.lit(None).cast("string")
    for i, form in enumerate(forms):
        parts = {"a": F.col("a"), "b": F.col("b"), "a1": F.substring("a", 2, 1), "b1": F.substring("b", 2, 1)}
        cells = [parts[p[1:-1]] if p.startswith("{") else F.lit(p) for p in re.findall(r"\{\w+\}|[^{}]+", form)] or [F.lit("")]
        text = F.when(F.col("seq") % len(forms) == i, F.concat(*cells)).otherwise(text)
    return frames.select("seq", text.alias("text")).select("seq", F.hex(bits.hex_bytes(F.col("text"))).alias("bytes"))


@query(BASE + " SELECT seq, CASE (seq % 6)::INT WHEN 0 THEN seq WHEN 1 THEN seq + 2684354560 WHEN 2 THEN seq WHEN 3 THEN NULL WHEN 4 THEN NULL WHEN 5 THEN -seq END::BIGINT AS number FROM frames")
def q_parse_int(spark, sf_dir):
    """Numbers of the frames written as 0x and digits, as digits with a letter, as decimals, as too long runs, as no numbers, and
    with a sign, and read."""
    n, form = F.col("seq"), F.col("seq") % 6
    hexed = F.lower(F.hex(n + F.lit(0xA0000000)))
    text = F.when(form == 0, F.concat(F.lit("0X"), F.hex(n))).when(form == 1, hexed).when(form == 2, n.cast("string")).when(form == 3, F.concat(hexed, F.lit("0f"))).when(form == 4, F.concat(F.lit("x"), n.cast("string"))).otherwise(F.concat(F.lit(" -"), n.cast("string")))
    return _frames(spark, sf_dir).select("seq", text.alias("text")).select("seq", bits.integer(F.col("text")).alias("number"))


@query(BASE + "SELECT DISTINCT frame_id FROM data WHERE abs(frame_id - 258) <= 4 AND frame_id <> 258")
def q_nearby_ids(spark, sf_dir):
    return diagnostics.nearby_ids(_frames(spark, sf_dir), 258)


#: Findings as compared: times in milliseconds, evidence as text.
_TOLD = """ SELECT "check", severity, entities, confidence, CASE WHEN a IS NULL THEN NULL ELSE round(a * 1000)::BIGINT END AS start_ms, CASE WHEN z IS NULL THEN NULL ELSE round(z * 1000)::BIGINT END AS end_ms,
    round(value, 3)::DOUBLE AS value, array_to_string(list_transform(evidence, lambda e: round(e[1] * 1000)::BIGINT || CASE WHEN e[2] IS NULL THEN '' ELSE '@' || e[2]::BIGINT END), ',') AS evidence FROM found"""


def _told(found: DataFrame) -> DataFrame:
    ms = lambda t: F.round(t * 1000).cast("long")
    evidence = F.array_join(F.transform("evidence", lambda e: F.concat(ms(e["t"]).cast("string"), F.coalesce(F.concat(F.lit("@"), e["id"].cast("string")), F.lit("")))), ",")
    return found.select("check", "severity", F.array_join("entities", ",").alias("entities"), "confidence", ms(F.col("time_start")).alias("start_ms"), ms(F.col("time_end")).alias("end_ms"), F.round("value", 3).alias("value"), evidence.alias("evidence"))


_COLUMNS = ', {entities} AS entities, {sure}::DOUBLE AS confidence, {a}::DOUBLE AS a, {z}::DOUBLE AS z, {value}::DOUBLE AS value, {evidence}::DOUBLE[][] AS evidence FROM {rows}'
_HEX = "printf('0x%X', frame_id)"


def _found(check: str, severity: str, rows: str, entities: str = "'bus'", a: str = "NULL", z: str = "NULL", value: str = "NULL", evidence: str = "[]", sure: str = "1") -> str:
    """SQL of one check's findings."""
    severity = severity if severity.startswith("CASE") else f"'{severity}'"
    return f"SELECT '{check}' AS \"check\", {severity} AS severity" + _COLUMNS.format(entities=entities, sure=sure, a=a, z=z, value=value, evidence=evidence, rows=rows)


_ENDS = "[[a, id], [z, id]]"
_BUS_SQL = (
    BASE
    + """, load AS (SELECT channel, sum((47 + 8 * dlc) * 1.2::DOUBLE) AS bits, min(t) AS a, max(t) - min(t) AS span FROM data GROUP BY channel),
    bins AS (SELECT d.channel, least(floor((d.t - a) / (span / greatest(ceil(span / 3600), 1))), greatest(ceil(span / 3600), 1) - 1) AS bin, sum((47 + 8 * dlc) * 1.2::DOUBLE) AS w FROM data d JOIN load USING (channel) GROUP BY 1, 2),
    loads AS (SELECT channel, bits / span * 100 AS mean, (SELECT max(w) FROM bins WHERE bins.channel = load.channel) / 3600 * 100 AS peak FROM load),
    p AS (SELECT frame_id AS id, lag(t) OVER (PARTITION BY frame_id ORDER BY t, seq) AS a, t AS z FROM data WHERE frame_id IN (256, 258, 260)),
    quiet AS (SELECT lag(t) OVER (ORDER BY t) AS a, t AS z FROM (SELECT DISTINCT t FROM data)),
    n AS (SELECT 'Node' || (frame_id % 3) AS node, (frame_id % 3) AS m, t, seq FROM data WHERE frame_id <= 261), g AS (SELECT node, m, lag(t) OVER (PARTITION BY node ORDER BY t, seq) AS a, t AS z FROM n),
    s AS (SELECT min(t) AS first, max(t) - min(t) AS span, greatest(ceil((max(t) - min(t)) / 3600), 1) AS bins FROM frames WHERE kind = 'error'),
    storms AS (SELECT first + bin * (span / bins) AS a, first + (bin + 1) * (span / bins) AS z, n FROM s, (SELECT least(floor((t - first) / (span / bins)), bins - 1) AS bin, count(*) AS n FROM frames, s WHERE kind = 'error' GROUP BY 1 HAVING count(*) >= 3)),
    states AS (SELECT state, min(t) AS a, arg_min(channel, (t, seq)) AS channel FROM frames WHERE state IN ('bus_off', 'passive') GROUP BY 1),
    r AS (SELECT count(*) AS total, count_if(error_type <> 'ack') AS bits, count_if(error_type = 'ack') AS ack FROM frames WHERE kind = 'error'),
    found AS ("""
    + " UNION ALL ".join([
        _found("bus_load", "CASE WHEN greatest(mean, peak) >= 70 THEN 'critical' ELSE 'warn' END", "loads WHERE greatest(mean, peak) >= 50", "channel::VARCHAR", value="round(peak, 2)"),
        _found("periodicity", "warn", "p WHERE (z - a) * 1000 > 2000000 * 1.25", "printf('0x%X', id)", "a", "z", "(z - a) * 1000", _ENDS),
        _found("bus_silence", "error", "quiet WHERE z - a > 1800", a="a", z="z", value="z - a", evidence="[[a, NULL], [z, NULL]]"),
        _found("node_offline", "error", "g WHERE (z - a) * 1000 > 3 * 2000000 AND EXISTS (SELECT 1 FROM data d WHERE d.t BETWEEN a AND z AND (d.frame_id > 261 OR d.frame_id % 3 <> m))", "node", "a", "z", "z - a", "[[a, [258, 256, 257][m + 1]]]"),
        _found("error_frame", "critical", "storms", a="a", z="z", value="n", evidence="[[a, NULL]]"),
        _found("error_frame", "warn", "r WHERE total > 0 AND NOT EXISTS (SELECT 1 FROM storms)", value="total"),
        _found("error_state_machine", "CASE WHEN state = 'bus_off' THEN 'critical' ELSE 'warn' END", "states", a="a", value="channel", evidence="[[a, NULL]]"),
        _found("baud_mismatch", "warn", "r WHERE bits / total > 0.5 AND bits > ack", value="bits / total", sure="0.5"),
        _found("termination_wiring", "warn", "r WHERE ack > 0 AND bits > 0 AND ack / total > 0.2 AND ack / total < 0.8", value="ack / total", sure="0.4"),
    ])
    + ")" + _TOLD
)


@query(_BUS_SQL)
def q_bus_findings(spark, sf_dir):
    return _told(diagnostics.bus_findings(_frames(spark, sf_dir), _config()))


@query(_BUS_SQL[: -len(_TOLD)] + " SELECT v.severity, count(f.severity)::BIGINT AS n FROM (VALUES ('critical'), ('error'), ('warn'), ('info')) v(severity) LEFT JOIN found f ON f.severity = v.severity GROUP BY 1")
def q_severity_counts(spark, sf_dir):
    return diagnostics.severity_counts(diagnostics.bus_findings(_frames(spark, sf_dir), _config()))


_STUCK = "greatest(1, least(0.25 * (last_t - first_t), 10))"
_MESSAGE_SQL = (
    STATS
    + f""", ends AS (SELECT min(t) AS log_start, max(t) AS log_end FROM data),
    known AS (SELECT *, CASE WHEN frame_id IN (256, 258, 260) THEN 2000000.0::DOUBLE END AS dbc_ms FROM base, ends),
    main AS (SELECT *, abs(median_ms - dbc_ms) / dbc_ms > 0.25 AS off, p99_ms > dbc_ms * 1.25 AS jitter FROM known QUALIFY row_number() OVER (PARTITION BY frame_id ORDER BY n_frames DESC, channel) = 1),
    listed AS (SELECT frame_id, frame_id AS id, channel, start AS a, "end" AS z, missing, inside, row_number() OVER (PARTITION BY frame_id ORDER BY gap_ms DESC, start, channel) AS nth FROM inside),
    many AS (SELECT frame_id, min(start) AS a, max("end") AS z, sum(missing) AS missing FROM inside GROUP BY 1 HAVING count(*) > 10),
    early AS (SELECT frame_id, count(*) AS n FROM d JOIN base USING (frame_id, channel) WHERE ms < 0.25 * base_ms GROUP BY 1),
    lengths AS (SELECT frame_id, count(DISTINCT dlc) AS n, max(dlc) AS dlc, count(DISTINCT channel) AS channels, count_if(dlc >= 8) AS ok, count(*) AS frames FROM data GROUP BY 1),
    pay AS (SELECT frame_id, t, seq, CASE WHEN dlc = 4 THEN word & 4294967295 ELSE word END AS w FROM data), c AS (SELECT *, coalesce((w IS DISTINCT FROM lag(w) OVER o AND row_number() OVER o > 1)::INT, 0) AS ch FROM pay WINDOW o AS (PARTITION BY frame_id ORDER BY t, seq)),
    r AS (SELECT *, sum(ch) OVER (PARTITION BY frame_id ORDER BY t, seq ROWS UNBOUNDED PRECEDING) AS run FROM c), runs AS (SELECT frame_id, run, count(*) AS len, min(t) AS a, max(t) AS z FROM r GROUP BY 1, 2),
    held AS (SELECT frame_id, frame_id AS id, sum(len) AS n, count(*) - 1 AS changes, arg_max(a, len * 1000000 - run) AS a, arg_max(z, len * 1000000 - run) AS z, min(a) AS first_t, max(z) AS last_t FROM runs GROUP BY 1),
    e AS (SELECT t FROM frames WHERE kind <> 'data'),
    near AS (SELECT frame_id, frame_id AS id, start AS a, "end" AS z, n, row_number() OVER (PARTITION BY frame_id ORDER BY start, channel) AS nth FROM (SELECT frame_id, channel, start, "end", count(*) AS n FROM gaps JOIN e ON e.t BETWEEN start - 60 AND "end" + 60 GROUP BY 1, 2, 3, 4)),
    found AS ("""
    + " UNION ALL ".join([
        _found("msg_period", "CASE WHEN n_frames > 1 AND NOT coalesce(off, false) AND NOT coalesce(jitter, false) THEN 'info' ELSE 'warn' END", "main WHERE n_frames = 1 OR off OR jitter OR dbc_ms IS NULL", _HEX, "CASE WHEN n_frames = 1 THEN first_t END", value="median_ms"),
        _found("msg_gap", "CASE WHEN inside > 0 THEN 'error' ELSE 'warn' END", "listed WHERE nth <= 10", _HEX, "a", "z", "missing", _ENDS),
        _found("msg_gap", "error", "many", _HEX, "a", "z", "missing"),
        _found("msg_burst", "warn", "early", _HEX, value="n"),
        _found("msg_stop", "error", "known WHERE log_end - last_t > greatest(5 * base_ms / 1000, 0.5)", _HEX, "last_t", "log_end", "log_end - last_t", "[[last_t, frame_id]]"),
        _found("msg_late", "warn", "known WHERE first_t - log_start > greatest(5 * base_ms / 1000, 0.5)", _HEX, "log_start", "first_t", "first_t - log_start", "[[first_t, frame_id]]"),
        _found("msg_dlc", "warn", "lengths WHERE n > 1 OR (frame_id <= 261 AND dlc <> 8)", _HEX),
        _found("msg_multichannel", "info", "lengths WHERE channels > 1", _HEX),
        _found("msg_payload_stuck", "warn", "held WHERE n >= 3 AND changes = 0", _HEX, "first_t", "last_t", "z - a"),
        _found("msg_payload_stuck", "warn", f"held WHERE changes > 0 AND z - a >= {_STUCK}", _HEX, "a", "z", "z - a", _ENDS),
        _found("msg_error_nearby", "error", "near WHERE nth <= 10", _HEX, "a", "z", "n", _ENDS),
        _found("msg_decode", "error", "lengths WHERE frame_id <= 261 AND ok = 0", _HEX, value="frames"),
    ])
    + ")" + _TOLD
)


@query(_MESSAGE_SQL)
def q_message_findings(spark, sf_dir):
    return _told(diagnostics.message_findings(_frames(spark, sf_dir), source.event_catalog(), _config()))


_SIGNAL = "printf('0x%X', id) || ',' || signal"
_SIGNAL_SQL = (
    STEPS
    + LONG_OF
    + f""", v AS (SELECT *, coalesce(label, raw::VARCHAR) AS shown FROM long), h AS (SELECT *, coalesce((shown IS DISTINCT FROM lag(shown) OVER o AND row_number() OVER o > 1)::INT, 0) AS ch FROM v WINDOW o AS (PARTITION BY signal ORDER BY t, seq)),
    r AS (SELECT *, sum(ch) OVER (PARTITION BY signal ORDER BY t, seq ROWS UNBOUNDED PRECEDING) AS run FROM h), runs AS (SELECT message_id AS id, signal, run, count(*) AS len, min(t) AS a, max(t) AS z FROM r GROUP BY 1, 2, 3),
    held AS (SELECT id, signal, sum(len) AS n, count(*) - 1 AS changes, arg_max(a, len * 1000000 - run) AS a, arg_max(z, len * 1000000 - run) AS z, min(a) AS first_t, max(z) AS last_t FROM runs GROUP BY 1, 2),
    beyond AS (SELECT message_id AS id, signal, count(*) AS n, min(t) AS a FROM long WHERE signal LIKE 'Value%' AND (num > 480 + 1e-9 OR num < -1e-9) GROUP BY 1, 2),
    unnamed AS (SELECT message_id AS id, signal, count(*) AS n, min(t) AS a FROM long WHERE signal LIKE 'Mode%' AND label IS NULL GROUP BY 1, 2),
    jumps AS (SELECT frame_id AS id, 'Counter' || frame_id AS signal, count(*) AS n, min(t) AS a FROM c WHERE step IS NOT NULL AND step NOT IN (0, 1, -15) AND NOT EXISTS (SELECT 1 FROM gaps g WHERE g.frame_id = c.frame_id AND g.channel = c.channel AND g.start = c.before) GROUP BY 1, 2),
    sh AS (SELECT *, coalesce((step <> 0)::INT, 0) AS ch FROM c), sr AS (SELECT *, sum(ch) OVER (PARTITION BY frame_id, channel ORDER BY t, seq ROWS UNBOUNDED PRECEDING) AS run FROM sh), sg AS (SELECT frame_id, channel, run, count(*) AS len, min(t) AS a, max(t) AS z FROM sr GROUP BY 1, 2, 3),
    frozen AS (SELECT frame_id AS id, 'Counter' || frame_id AS signal, a, z FROM (SELECT frame_id, channel, arg_max(a, len * 1000000 - run) AS a, arg_max(z, len * 1000000 - run) AS z, max(len) AS len FROM sg GROUP BY 1, 2) JOIN base USING (frame_id, channel) WHERE len > 1 AND z - a >= greatest(0.1, 5 * base_ms / 1000)),
    found AS ("""
    + " UNION ALL ".join([
        _found("sig_constant", "info", "held WHERE changes = 0 AND n >= 3", _SIGNAL, "first_t", "last_t", "n"),
        _found("sig_stuck", "warn", f"held WHERE changes > 0 AND z - a >= {_STUCK} AND z - a >= 10 * (last_t - first_t) / changes", _SIGNAL, "a", "z", "z - a", _ENDS),
        _found("sig_range", "warn", "beyond", _SIGNAL, "a", value="n", evidence="[[a, id]]"),
        _found("sig_enum_invalid", "warn", "unnamed", _SIGNAL, "a", value="n", evidence="[[a, id]]"),
        _found("sig_counter", "error", "jumps", _SIGNAL, "a", value="n", evidence="[[a, id]]"),
        _found("sig_counter", "error", "frozen", _SIGNAL, "a", "z", "z - a", _ENDS),
    ])
    + ")" + _TOLD
)


@query(_SIGNAL_SQL)
def q_signal_findings(spark, sf_dir):
    return _told(diagnostics.signal_findings(_frames(spark, sf_dir), source.event_catalog(), _config()))


@query(BASE + "SELECT seq, array_to_string(list_transform(range(dlc), lambda i: printf('%02x', (word >> (8 * i)) & 255)), ' ') AS payload FROM frames")
def q_hex_payloads(spark, sf_dir):
    """Every payload written in one of the four forms, by its number, and read again."""
    spaced = bits.payload_text(F.col("data"))
    form = F.col("seq") % 4
    text = F.when(form == 0, spaced).when(form == 1, F.hex("data")).when(form == 2, F.regexp_replace(spaced, "([0-9a-f]{2})", "0x$1")).otherwise(F.replace(spaced, F.lit(" "), F.lit(",")))
    return _frames(spark, sf_dir).select("seq", text.alias("text")).select("seq", bits.payload_text(bits.hex_bytes(F.col("text"))).alias("payload"))


@query(BASE + "SELECT seq, CASE WHEN seq % 3 = 2 THEN seq + 2684354560 ELSE seq END::BIGINT AS value FROM frames")
def q_parse_ids(spark, sf_dir):
    """Numbers written as 0x and digits, as decimals, or as bare hexadecimal digits, and read again."""
    form, number = F.col("seq") % 3, F.col("seq")
    text = F.when(form == 0, F.concat(F.lit("0x"), F.hex(number))).when(form == 1, number.cast("string")).otherwise(F.lower(F.hex(number + F.lit(0xA0000000))))
    return _frames(spark, sf_dir).select("seq", text.alias("text")).select("seq", bits.integer(F.col("text")).alias("value"))
