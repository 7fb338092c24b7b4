"""Text logs as frames: lines are read and parsed by Spark; only the head of a file is looked at on the driver.

Each parser takes a DataFrame of lines (log_id, line_no, line) or a path. Lines that don't parse are skipped.
"""

from __future__ import annotations

import csv
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.functions.bits import hex_bytes, integer
from framelake.plans.catalog import SchemaError
from framelake.sources.frames import normalised

NUMBER = r"(\d+(?:\.\d+)?)"


def lines_of(spark: SparkSession, path: str) -> DataFrame:
    """(log_id, line_no, line) of a text file; the log is the file, line_no its place among the lines as read."""
    text = spark.read.text(path)
    return text.select(F.col("_metadata.file_name").alias("log_id"), F.monotonically_increasing_id().alias("line_no"), line_text(F.col("value")).alias("line"))


def line_text(value: Column) -> Column:
    """A line as text: UTF-8, or where its bytes aren't that Latin-1; without a carriage return at its end."""
    return F.regexp_replace(F.when(F.is_valid_utf8(value), value).otherwise(F.decode(value.cast("binary"), "ISO-8859-1")), "\r$", "")


#: Stands between the parts of a line that a pattern has found; no part can hold it.
CUT = "\u0001"


def _cut(line: Column, *patterns: tuple[str, str]) -> Column:
    """The parts of a line as an array, after an empty one and the name of the first (name, pattern) that fits: all groups of
    it. Each pattern is run once; a line that none fits is an array of one."""
    for name, pattern in patterns:
        line = F.regexp_replace(line, F.lit(pattern), F.lit(CUT + name + "".join(f"{CUT}${i + 1}" for i in range(re.compile(pattern).groups))))
    return F.split(line, CUT)


def payload(text: Column) -> Column:
    """hex_bytes() of text that mostly is pairs of digits with single spaces, for which it is quicker."""
    return F.when(F.regexp_like(text, F.lit("^[0-9a-fA-F]{2}(?: [0-9a-fA-F]{2})*$")), F.unhex(F.replace(text, F.lit(" ")))).otherwise(hex_bytes(text))


def parse_asc(lines: DataFrame) -> DataFrame:
    """Data lines `t channel id Rx|Tx d length bytes` and lines of error frames and bus states. Ids are in the base that
    the head names (hexadecimal if it names none); with absolute timestamps data frames count from their log's first.
    An x at the end of an id marks an extended one. Data frames get channel 0, events keep theirs and their time."""
    head = r"(?i)^\s*base\s+(\w+)\s+timestamps\s+(\w+)"
    said = lines.where(F.lower("line").contains("timestamps") & F.regexp_like("line", F.lit(head))).groupBy("log_id").agg(
        F.max_by(F.lower(F.regexp_extract("line", head, 1)), "line_no").alias("base"), F.max_by(F.lower(F.regexp_extract("line", head, 2)), "line_no").alias("stamps")
    )
    known = lines.join(F.broadcast(said), "log_id", "left").withColumn("absolute", F.coalesce(F.col("stamps").isin("absolute", "abs"), F.lit(False)))  # a row per log
    rows = asc_rows(known)
    first = rows.where("absolute and kind = 'data'").groupBy("log_id").agg(F.min_by("t", "seq").alias("first"))
    rows = rows.join(F.broadcast(first), "log_id", "left")  # a row per log
    return normalised(rows.withColumn("t", F.when(F.col("kind") == "data", F.col("t") - F.coalesce("first", F.lit(0.0))).otherwise(F.col("t"))).drop("absolute", "first"))


def asc_rows(known: DataFrame) -> DataFrame:
    """Frames of known(log_id, line_no, line, base, absolute), line by line, with times as they stand."""
    data = rf"^\s*{NUMBER}\s+(\d+)\s+([0-9a-fA-F]+)x?\s+(?:Rx|Tx)\s+d\s+\d+\s+([0-9a-fA-F ]+?)\s*$"
    event = rf"^\s*{NUMBER}\s+(\d+)\s+(.*)$"
    cut = known.select("log_id", F.col("line_no").alias("seq"), "base", "absolute", F.explode(F.array(_cut(F.col("line"), ("data", data), ("event", event)))).alias("p")).where("size(p) > 1")
    part = lambda n: F.get("p", F.lit(n))
    decimal = F.col("base").isNotNull() & ~F.col("base").isin("hex", "hexadecimal")
    frame_id = F.when(decimal, part(4).try_cast("long")).otherwise(F.conv(part(4), 16, 10).cast("long"))
    is_data = part(1) == "data"
    rest = F.lower(part(4))
    is_error = rest.contains("errorframe") | rest.contains("error frame")
    kind = F
    for word in ("stuff", "form", "crc", "ack", "bit"):
        kind = kind.when(rest.contains(word), word)
    state = F.when(rest.contains("busoff") | rest.contains("bus off"), "bus_off").when(rest.contains("error passive") | rest.contains("errorpassive"), "passive").when(rest.contains("error active") | rest.contains("erroractive"), "active")
    return cut.select(
        "log_id", "seq", "absolute", part(2).cast("double").alias("t"),
        F.when(is_data, F.lit(0)).otherwise(part(3).cast("int")).alias("channel"),
        F.when(is_data, frame_id).otherwise(F.lit(0)).alias("frame_id"),
        F.when(is_data, "data").when(is_error, "error").otherwise("status").alias("kind"),
        F.when(~is_data & is_error, kind.otherwise("other")).alias("error_type"),
        F.when(~is_data & ~is_error, state).alias("state"),
        F.when(is_data, payload(part(5))).otherwise(F.lit(b"")).alias("data"),
    ).where("kind = 'error' or state is not null or (kind = 'data' and data is not null and frame_id is not null)")


def parse_trc(lines: DataFrame) -> DataFrame:
    """`[n)] t id Rx|Tx [d] length bytes`; times as they stand."""
    data = rf"^\s*(?:\d+\)\s+)?{NUMBER}\s+([0-9a-fA-F]+)\s+(?:Rx|Tx)\s+(?:d\s+)?\d+\s+([0-9a-fA-F ]+?)\s*$"
    cut = lines.select("log_id", F.col("line_no").alias("seq"), F.explode(F.array(_cut(F.col("line"), ("data", data)))).alias("p")).where("size(p) > 1")
    part = lambda n: F.get("p", F.lit(n))
    return normalised(cut.select("log_id", "seq", part(2).cast("double").alias("t"), F.conv(part(3), 16, 10).cast("long").alias("frame_id"), payload(part(4)).alias("data")).where("data is not null"))


# Names of columns in heads of tables, and of times that have a unit.
TIME_NAMES = ("timestamp", "time", "t", "t[ms]", "time[ms]", "t[us]", "time[us]", "ts")
ID_NAMES = ("id", "canid", "can_id", "identifier", "arbitration_id", "frame_id", "msgid")
DATA_NAMES = ("data", "payload", "bytes", "data_bytes", "d", "raw")
OTHER_NAMES = ("channel", "dir", "direction", "dlc")
TIME_UNITS = {
    1e-3: ("t[ms]", "time[ms]", "timestamp[ms]", "time_ms", "tms"),
    1e-6: ("t[us]", "time[us]", "timestamp[us]", "time_us", "tus"),
    1e-9: ("t[ns]", "time[ns]"),
}
#: Names of times that only the lists of units have; they count as times too.
UNIT_NAMES = tuple(n for names in TIME_UNITS.values() for n in names if n not in TIME_NAMES)


def time_scale(names: list[str]) -> float:
    """Seconds of a unit of time: of the first name in a head that tells one."""
    return next((scale for n in names for scale, known in TIME_UNITS.items() if n in known), 1.0)


def sniffed(head: list[str]) -> tuple[str, dict[str, int], float, int]:
    """(delimiter, columns of time, id and data, time scale, lines before the rows) from a file's first lines. A first line
    with a known name is a head and must name all three columns; without one they are the first three."""
    first = next((i for i, line in enumerate(head) if line.strip("\ufeff\r\n")), None)
    if first is None:
        raise SchemaError("the table is empty")
    text = [head[first].lstrip("\ufeff"), *head[first + 1 :]]
    try:
        delimiter = csv.Sniffer().sniff("\n".join(text[:20]), ",;\t ").delimiter
    except csv.Error:
        delimiter = next((d for d in ",;\t " if d in text[0]), ",")
    names = [c.strip().strip('"').strip().lower() for c in text[0].split(delimiter)]
    find = lambda known: next((i for i, n in enumerate(names) if n in known), None)
    if find((*TIME_NAMES, *ID_NAMES, *DATA_NAMES, *OTHER_NAMES, *UNIT_NAMES)) is None:
        return delimiter, {"t": 0, "id": 1, "data": 2}, 1.0, first
    time = find(TIME_NAMES)
    at = {"t": find(UNIT_NAMES) if time is None else time, "id": find(ID_NAMES), "data": find(DATA_NAMES)}
    if None in at.values():
        raise SchemaError(f"the table's head {text[0]!r} names no column for {', '.join(k for k, v in at.items() if v is None)}")
    return delimiter, at, time_scale(names), first + 1


def parse_csv(lines: DataFrame, head: list[str]) -> DataFrame:
    """Rows of a table with a head (known names of columns, in any order, and times scaled by their unit) or, without one,
    time, id and data in the first three columns. Rows that lack a cell or don't parse are left out, and so are data of
    decimal digits alone, which may be a number as well as bytes."""
    delimiter, at, scale, before = sniffed(head)
    rows = lines.where(~F.col("line").isin(head[:before])) if before else lines
    # Generators keep Spark from writing the cells' expressions into each of their uses.
    cells = rows.select("log_id", F.col("line_no").alias("seq"), F.explode(F.array(F.split(F.regexp_replace("line", '"', ""), "\\Q" + delimiter + "\\E"))).alias("cells"))
    cell = lambda name: F.trim(F.try_element_at("cells", F.lit(at[name] + 1)))
    data = cell("data")
    if delimiter == " " and at["data"] == max(at.values()):  # then bytes are cells of their own
        data = F.array_join(F.slice("cells", at["data"] + 1, 64), " ")
    said = cells.select("log_id", "seq", F.inline(F.array(F.struct(cell("t").alias("t"), cell("id").alias("id"), data.alias("text")))))
    rows = said.where(~F.regexp_like("text", F.lit("^[0-9]+$"))).select("log_id", "seq", (F.col("t").try_cast("double") * scale).alias("t"), integer(F.col("id")).alias("frame_id"), payload(F.col("text")).alias("data"))
    return normalised(rows.where("t is not null and frame_id is not null and data is not null"))


def parse_json(documents: DataFrame) -> DataFrame:
    """documents(log_id, text), each a list of frames or an object with them under frames or data. Names: t, timestamp or
    time; id, frame_id or can_id; data, payload or bytes (hexadecimal text, or a list of numbers, of which the lowest
    eight bits count); channel if given."""
    inner = F.coalesce(F.get_json_object("text", "$.frames"), F.get_json_object("text", "$.data"), F.col("text"))
    rows = documents.select("log_id", F.posexplode(F.from_json(inner, "array<string>")).alias("seq", "row"))
    first = lambda *names: F.coalesce(*(F.get_json_object("row", f"$.{n}") for n in names))
    data = first("data", "payload", "bytes")
    numbers = F.from_json(data, "array<long>")
    packed = F.unhex(F.array_join(F.transform(numbers, lambda b: F.lpad(F.hex(b.bitwiseAND(F.lit(255))), 2, "0")), ""))
    payload = F.when(F.ltrim(data).startswith("["), packed).otherwise(hex_bytes(data))
    out = rows.select("log_id", F.col("seq").cast("long").alias("seq"), first("t", "timestamp", "time").try_cast("double").alias("t"), integer(first("id", "frame_id", "can_id")).alias("frame_id"), payload.alias("data"), F.coalesce(first("channel").try_cast("int"), F.lit(0)).alias("channel"))
    return normalised(out.where("t is not null and frame_id is not null and data is not null"))


def read_log(spark: SparkSession, path: str, start: float | None = None, end: float | None = None, most: int | None = None) -> DataFrame:
    """Frames of a log by the end of its name, an inclusive span of time and at most so many in recording order."""
    from framelake.sources import blf, mf4
    from framelake.sources.frames import window

    kind = path.lower().rsplit(".", 1)[-1]
    if kind in ("asc", "log"):
        frames = parse_asc(lines_of(spark, path))
    elif kind == "trc":
        frames = parse_trc(lines_of(spark, path))
    elif kind == "csv":
        lines = lines_of(spark, path)
        frames = parse_csv(lines, [r["line"] for r in lines.limit(20).collect()])
    elif kind == "json":
        frames = parse_json(spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("log_id"), F.col("value").alias("text")))
    elif kind == "blf":
        frames = blf.read(spark, path)
    elif kind == "mf4":
        frames = mf4.read(spark, path)
    else:
        raise SchemaError(f"no reader for {path!r}")
    return window(frames, start, end, most)
