"""Frames: the one row type of a bus log, a generator of the cruise demo, and a projection of event rows to frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framelake.functions.bits import little
from framelake.plans.catalog import Catalog, Message, Signal, parse_dbc

FRAMES = (
    "log_id string, seq bigint, t double, channel int, frame_id bigint, is_extended boolean, kind string, dlc int, data binary,"
    " error_type string, tec int, rec int, state string, direction string"
)
#: Column -> its default where a source doesn't know it.
DEFAULTS = {"log_id": "'log'", "seq": "0L", "channel": "0", "kind": "'data'", "error_type": "null", "tec": "null", "rec": "null", "state": "null", "direction": "null"}


def normalised(rows: DataFrame) -> DataFrame:
    """rows with all columns of FRAMES, in their order and types; is_extended follows from the id, dlc from the data."""
    kinds = dict(part.strip().split(" ", 1) for part in FRAMES.split(","))
    have = set(rows.columns)
    for name, default in DEFAULTS.items():
        if name not in have:
            rows = rows.withColumn(name, F.expr(default))
    data = F.coalesce(F.col("data"), F.lit(b""))
    rows = rows.withColumn("data", data).withColumn("dlc", F.length(data)).withColumn("is_extended", F.col("frame_id") > 0x7FF)
    return rows.select(*(F.col(n).cast(k).alias(n) for n, k in kinds.items()))


def window(frames: DataFrame, start: float | None = None, end: float | None = None, most: int | None = None) -> DataFrame:
    """Frames of an inclusive span of time; of each log at most `most`, the first in recording order."""
    if start is not None:
        frames = frames.where(F.col("t") >= start)
    if end is not None:
        frames = frames.where(F.col("t") <= end)
    return frames if most is None else first_of_each(frames, most, "seq")


def first_of_each(frames: DataFrame, most: int, *order: Column | str) -> DataFrame:
    """The first `most` rows of each log; Spark leaves out all others before it shuffles."""
    nth = F.row_number().over(Window.partitionBy("log_id").orderBy(*order))
    return frames.withColumn("__nth", nth).where(F.col("__nth") <= most).drop("__nth")


def capped_by_time(frames: DataFrame, most: int) -> DataFrame:
    """Of each log the first `most` frames in order of time, events before data at one instant. Where no data frame fits,
    only events stay; else events after the last data frame kept go."""
    first = first_of_each(frames, most, "t", F.col("kind") == "data", "seq")
    last = F.max(F.when(F.col("kind") == "data", F.col("t"))).over(Window.partitionBy("log_id"))
    return first.withColumn("last", last).where("last is null or t <= last").drop("last")


def truncated(frames: DataFrame, most: int) -> DataFrame:
    """(log_id, truncated): whether at least `most` frames came of each log."""
    return frames.groupBy("log_id").agg((F.count("*") >= most).alias("truncated"))


# The demo's schema.
CRUISE_DBC = """
BU_: BCM CCM MCU
BO_ 256 VehStatus: 8 BCM
 SG_ VehSpd : 0|12@1+ (0.1,0) [0|300] "km/h" Vector__XXX
 SG_ BrakePedal : 12|1@1+ (1,0) [0|1] "" Vector__XXX
 SG_ AccelPedal : 16|8@1+ (1,0) [0|100] "%" Vector__XXX
BO_ 257 DriverInput: 8 BCM
 SG_ CruiseSetBtn : 0|1@1+ (1,0) [0|1] "" Vector__XXX
 SG_ CruiseCancelBtn : 1|1@1+ (1,0) [0|1] "" Vector__XXX
 SG_ CruiseResumeBtn : 2|1@1+ (1,0) [0|1] "" Vector__XXX
BO_ 258 CCM_Status: 8 CCM
 SG_ CruiseActive : 0|1@1+ (1,0) [0|1] "" Vector__XXX
 SG_ CruiseSetSpeed : 8|12@1+ (0.1,0) [0|300] "km/h" Vector__XXX
 SG_ CruiseState : 20|3@1+ (1,0) [0|3] "" Vector__XXX
BO_ 512 MotorStatus: 8 MCU
 SG_ MotorTemp : 0|8@1+ (1,-40) [-40|215] "degC" Vector__XXX
 SG_ MotorSpeed : 8|16@1+ (1,0) [0|20000] "rpm" Vector__XXX
BA_DEF_DEF_ "GenMsgCycleTime" 20;
VAL_ 258 CruiseState 0 "IDLE" 1 "ARMED" 2 "ACTIVE" 3 "CANCEL";
"""
# The demo's functions.
CRUISE_SPEC = {
    "functions": [
        {
            "id": "cruise",
            "enter": {"all": [{"rising": "CruiseSetBtn"}, {"signal": "VehSpd", "op": ">=", "value": 30}, {"signal": "BrakePedal", "op": "==", "value": 0}]},
            "exit": {"any": [{"signal": "BrakePedal", "op": "==", "value": 1}, {"signal": "CruiseCancelBtn", "op": "==", "value": 1}]},
        },
        {"id": "overtemp", "enter": {"signal": "MotorTemp", "op": ">", "value": 120}, "exit": {"signal": "MotorTemp", "op": "<", "value": 105}},
    ]
}


def cruise_catalog() -> Catalog:
    return parse_dbc(CRUISE_DBC)


def cruise_frames(spark: SparkSession) -> DataFrame:
    """6,004 frames: 1,501 ticks of 20 ms, four messages each."""
    t = F.col("t")
    tick = spark.range(1501).select("id", F.round(F.col("id") * 0.02, 6).alias("t"))
    active = (t >= 8) & (t < 15)
    speed = F.when(t < 8, 4 * t).when(t < 15, F.lit(32.0)).when(t < 17, 32 - 6 * (t - 15)).otherwise(20 + (t - 17) * 15 / 13)
    temperature = F.when(t < 18, 60 + 65 * t / 18).when(t < 22, F.lit(125.0)).otherwise(125 - 35 * (t - 22) / 8)
    pedal = F.when(t < 8, 30).when(t >= 17, 40).otherwise(0)
    bit = lambda c: F.when(c, 1).otherwise(0).cast("long")
    at = lambda value, shift: F.shiftleft(F.rint(value).cast("long"), shift)
    words = [
        (256, at(speed * 10, 0) + at(bit((t >= 15) & (t < 17)), 12) + at(pedal, 16)),
        (257, bit(((t >= 5) & (t < 6)) | ((t >= 8) & (t < 9)))),
        (258, bit(active) + at(F.when(active, 320).otherwise(0), 8) + at(F.when(active, 2).otherwise(0), 20)),
        (512, at(temperature + 40, 0) + at(1000 + 50 * speed, 8)),
    ]
    one = F.array(*(F.struct(F.lit(i).alias("n"), F.lit(f).alias("frame_id"), w.alias("word")) for i, (f, w) in enumerate(words)))
    rows = tick.select("id", "t", F.inline(one)).select(F.lit("cruise").alias("log_id"), (F.col("id") * 4 + F.col("n")).alias("seq"), "t", "frame_id", little(F.col("word")).alias("data"))
    return normalised(rows)


# --- projection of the driver's event rows to frames ------------------------------------------------------------

ERROR_TYPES = ("stuff", "form", "crc", "ack", "bit")


def event_words(events: DataFrame) -> DataFrame:
    """events -> (log_id, seq, t_us, t, channel, frame_id, kind, dlc, word, v100, k, error_type, state)."""
    is_error = F.col("event_type") == "error"
    rows = events.select(
        F.lit("events").alias("log_id"), F.col("event_id").alias("seq"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t_us"),
        (F.col("user_id") % 2).cast("int").alias("channel"), (256 + F.col("user_id") % 8).alias("frame_id"), F.when(is_error, "error").otherwise("data").alias("kind"),
        F.when(F.col("event_type") == "signup", 4).otherwise(8).alias("dlc"), F.round(F.col("value") * 100).cast("long").alias("v100"), F.get_json_object("props", "$.k").cast("long").alias("k"),
    )
    n = F.row_number().over(Window.partitionBy("frame_id", "channel", "kind").orderBy("t_us", "seq"))
    rows = rows.withColumn("rn", n)
    counter = F.pmod(F.col("rn") - F.when(F.col("rn") % 97 == 0, 1).otherwise(0), F.lit(16))
    kinds = F.element_at(F.array(*map(F.lit, ERROR_TYPES)), (F.col("k") % 5 + 1).cast("int"))
    state = F.when(F.col("v100") > 15_000, "bus_off").when(F.col("v100") > 5_000, "passive")
    return rows.select(
        "log_id", "seq", "t_us", (F.col("t_us") / 1e6).alias("t"), "channel", "frame_id", "kind", "dlc", (counter + F.col("v100") * 256 + F.shiftleft("k", 32)).alias("word"), "v100", "k",
        F.when(F.col("kind") == "error", kinds).alias("error_type"), F.when(F.col("kind") == "error", state).alias("state"),
    )


def event_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = event_words(spark.read.parquet(f"{sf_dir}/events.parquet"))
    return normalised(rows.withColumn("data", F.when(F.col("dlc") == 4, little(F.col("word"), 4)).otherwise(little(F.col("word")))))


def event_catalog(ids: tuple[int, ...] = (256, 257, 258, 259, 260, 261)) -> Catalog:
    """Of the eight ids six are known. Each message has its own signals Counter, Value, K and Mode, numbered like the id."""
    messages = []
    for i in ids:
        mode = tuple((n, name) for n, name in enumerate(("OFF", "READY", "RUN", "FAULT")))
        signals = (
            Signal(f"Counter{i}", 0, 4), Signal(f"Value{i}", 8, 16, scale=0.01, minimum=0.0, maximum=480.0, unit="V"), Signal(f"K{i}", 32, 7), Signal(f"Mode{i}", 34, 3, choices=mode),
        )
        messages.append(Message(i, f"Event{i}", 8, signals, (f"Node{i % 3}",), cycle_ms=None if i % 2 else 2_000_000.0))
    return Catalog(tuple(messages), ("Node0", "Node1", "Node2"))
