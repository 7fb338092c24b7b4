"""Schema text, payload bits, text logs and binary logs."""

import random
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from framelake.functions import bits
from framelake.operators import decode
from framelake.plans.catalog import Catalog, Message, SchemaError, Signal, parse_dbc
from framelake.sources import blf, frames as source, mf4, textlogs


def lines(spark, *texts):
    return spark.createDataFrame([("log", i, t) for i, t in enumerate(texts)], "log_id string, line_no long, line string")


def test_schema_text():
    catalog = parse_dbc(source.CRUISE_DBC)
    message, signal = catalog.find("CruiseState")
    assert (message.frame_id, message.cycle_ms, signal.start, signal.length, dict(signal.choices)[2]) == (258, 20.0, 20, 3, "ACTIVE")
    assert catalog.find("MotorTemp")[1].offset == -40 and catalog.find("Nothing") is None
    mux = parse_dbc('BO_ 2147483906 M: 8 ECU\n SG_ Sel M : 0|8@1+ (1,0) [0|0] "" X\n SG_ A m3 : 15|12@0- (0.5,1) [0|9] "u" X\nSIG_VALTYPE_ 2147483906 A : 1;').messages[0]
    assert mux.extended and mux.frame_id == 258 and mux.selector.name == "Sel" and mux.signals[1].selected_by == 3 and mux.signals[1].is_float and not mux.signals[1].little_endian
    with pytest.raises(SchemaError):
        parse_dbc("nothing")


def test_selectors_of_selectors(spark):
    text = """BO_ 5 M: 4 E
 SG_ A M : 0|4@1+ (1,0) [0|0] "" X
 SG_ B m1M : 4|4@1+ (1,0) [0|0] "" X
 SG_ C m7 : 8|8@1+ (1,0) [0|0] "" X
 SG_ D m2 : 16|8@1+ (1,0) [0|0] "" X
SG_MUL_VAL_ 5 C B 0-2, 7-7;"""
    catalog = parse_dbc(text)
    message = catalog.messages[0]
    assert message.selector.name == "A" and [[(o.name, r) for o, r in message.conditions(s)] for s in message.signals] == [[], [("A", ((1, 1),))], [("B", ((0, 2), (7, 7))), ("A", ((1, 1),))], [("A", ((2, 2),))]]
    payloads = [bytes([a | b << 4, 33, 44, 0]) for a in range(4) for b in range(16)]
    frames = source.normalised(spark.createDataFrame([(i, float(i), 5, bytearray(p)) for i, p in enumerate(payloads)], "seq long, t double, frame_id long, data binary"))
    expected = set()
    for i, p in enumerate(payloads):
        a, b = p[0] & 15, p[0] >> 4
        expected |= {(i, "A", a)} | ({(i, "B", b)} if a == 1 else set()) | ({(i, "C", 33)} if a == 1 and b in (0, 1, 2, 7) else set()) | ({(i, "D", 44)} if a == 2 else set())
    assert {(r["seq"], r["signal"], r["raw"]) for r in decode.samples(frames, catalog).collect()} == expected
    wide = decode.wide(frames, catalog, ["A", "B", "C", "D"]).collect()
    assert {(r["seq"], n, r[n]["raw"]) for r in wide for n in "ABCD" if r[n] is not None} == expected
    assert not Catalog((Message(1, "x", 8, (Signal("S", 0, 8, selector=True, selected_by=1),)),)).messages[0].conditions(Signal("S", 0, 8, selected_by=1, multiplexer="none"))


def plain_raw(signal, data):
    """Bit by bit, from the definition of the two bit orders."""
    value = 0
    if signal.little_endian:
        for i in range(signal.length):
            at = signal.start + i
            value |= (data[at // 8] >> at % 8 & 1) << i
    else:
        at = signal.start
        for _ in range(signal.length):
            value = value << 1 | data[at // 8] >> at % 8 & 1
            at = at - 1 if at % 8 else at + 15
    return value - (1 << signal.length) if signal.signed and value >> signal.length - 1 else value


def test_random_fields(spark):
    draw = random.Random(2)
    signals = []
    while len(signals) < 40:
        little, start, length = draw.random() < 0.5, draw.randrange(64), draw.randint(1, 57)
        end = start + length if little else 8 * (start // 8) + 7 - start % 8 + length
        if end <= 64:
            signals.append(Signal(f"S{len(signals)}", start, length, little, draw.random() < 0.5))
    payloads = [bytes(draw.randrange(256) for _ in range(8)) for _ in range(30)]
    rows = spark.createDataFrame([(i, bytearray(p)) for i, p in enumerate(payloads)], "i int, data binary")
    got = rows.select("i", *(decode.raw(s, F.col("data")).alias(s.name) for s in signals)).collect()
    for row in got:
        for s in signals:
            assert row[s.name] == plain_raw(s, payloads[row["i"]]), s


def test_multiplexed_and_float(spark):
    signals = (Signal("Sel", 0, 8, selector=True), Signal("A", 8, 8, selected_by=1), Signal("B", 8, 32, is_float=True, selected_by=2))
    catalog = Catalog((Message(1, "M", 8, signals),))
    data = [bytes([1, 7, 0, 0, 0, 0, 0, 0]), b"\x02" + struct.pack("<f", 1.5) + b"\0\0\0", b"\x01\x07"]
    frames = source.normalised(spark.createDataFrame([(i, float(i), 1, bytearray(d)) for i, d in enumerate(data)], "seq long, t double, frame_id long, data binary"))
    got = {(r["signal"], r["t"]): r["num"] for r in decode.samples(frames, catalog).collect()}
    assert got == {("Sel", 0.0): 1.0, ("A", 0.0): 7.0, ("Sel", 1.0): 2.0, ("B", 1.0): 1.5}


def test_asc(spark):
    text = ["base hex timestamps absolute", "100.5 1 123 Rx d 2 0A 0b", "101.0 1 18FFx Rx d 1 ff", "101.2 2 ErrorFrame crc", "101.3 2 Status: bus off", "junk"]
    rows = textlogs.parse_asc(lines(spark, *text)).orderBy("seq").collect()
    assert [(r["t"], r["frame_id"], r["kind"], r["channel"], r["error_type"], r["state"]) for r in rows] == [(0.0, 0x123, "data", 0, None, None), (0.5, 0x18FF, "data", 0, None, None), (101.2, 0, "error", 2, "crc", None), (101.3, 0, "status", 2, None, "bus_off")]
    assert bytes(rows[0]["data"]) == b"\x0a\x0b" and rows[1]["is_extended"]


def test_csv_json_trc(spark):
    table = ["time_ms;id;data", "1500;0x10;00 ff", "x;1;00", "2000;20;01 02", "2500;20;0102"]  # digits alone are no bytes
    rows = textlogs.parse_csv(lines(spark, *table), table).orderBy("seq").collect()
    assert [(r["t"], r["frame_id"], bytes(r["data"])) for r in rows] == [(1.5, 16, b"\x00\xff"), (2.0, 20, b"\x01\x02")]
    bare = ["0.1,1F,00 1f", "0.2,2,a1"]
    assert [r["frame_id"] for r in textlogs.parse_csv(lines(spark, *bare), bare).orderBy("seq").collect()] == [31, 2]
    doc = spark.createDataFrame([("a", '{"frames":[{"t":1,"id":"0x1","data":[1,258]},{"time":2,"can_id":5,"payload":"0a","channel":3},{"t":3}]}')], "log_id string, text string")
    assert [(r["t"], r["frame_id"], bytes(r["data"]), r["channel"]) for r in textlogs.parse_json(doc).orderBy("seq").collect()] == [(1.0, 1, b"\x01\x02", 0), (2.0, 5, b"\x0a", 3)]
    assert [r["frame_id"] for r in textlogs.parse_trc(lines(spark, "1) 1.5 0123 Rx 2 01 02", "2.5 7FF Tx d 1 00", ";x")).orderBy("seq").collect()] == [0x123, 0x7FF]


@pytest.mark.parametrize(
    "head, row",
    [
        ("identifier,time,raw", "0x10,1.5,00 ff"), ("\ufeffmsgid;d;t[ms]", "16;0x0 0xff;1500"), ("Arbitration_ID\tDLC\tTimestamp\tPayload", "16\t2\t1.5\t00ff"),
        ('"canid","bytes","time_us"', '"0x10","00 ff","1500000"'), ("dir,ts,can_id,data_bytes", "Rx,1.5,10h,00 ff\nTx,1.5,0x10,00ff"), ("t id data", "1.5 0x10 00 ff"), ("tns,frame_id,data,time[ns]", "0,16,00ff,1500000000"),
    ],
)
def test_heads_of_tables(spark, head, row):
    table = ["", head, *row.split("\n")]
    rows = textlogs.parse_csv(lines(spark, *table), table).collect()
    assert [(r["t"], r["frame_id"], bytes(r["data"])) for r in rows] == [(1.5, 16, b"\x00\xff")]


def test_heads_that_lack_a_column(spark):
    for head in ("channel,x,y", "time,id", "seconds,id,data"):  # a name that isn't in the lists counts for nothing
        with pytest.raises(SchemaError):
            textlogs.sniffed([head, "1,2,3"])
    assert textlogs.sniffed(["a,b,c", "1,2,3"])[1] == {"t": 0, "id": 1, "data": 2}


def obj(kind, body, ticks=0, flags=2):
    whole = b"LOBJ" + struct.pack("<HHII", 32, 1, 32 + len(body), kind) + struct.pack("<IHHQ", flags, 0, 0, ticks) + body
    return whole + b"\0" * (len(whole) % 4)


def classic(ident, data, ticks, channel=2):
    return obj(1, struct.pack("<HBBI", channel, 0, len(data), ident) + data.ljust(8, b"\0"), ticks)


def recording(parts, pack=True):
    """A log whose containers hold the parts; every other one isn't packed, and other objects lie between them."""
    out = b"LOGG" + struct.pack("<I", 144) + b"\0" * 32 + struct.pack("<8H", 1970, 1, 0, 1, 0, 0, 10, 0) + b"\0" * 88
    for k, part in enumerate(parts):
        body = zlib.compress(part) if pack and k % 2 == 0 else part
        out += b"LOBJ" + struct.pack("<HHII", 16, 1, 32 + len(body), 10) + struct.pack("<HHIII", 2 if body != part else 0, 0, 0, len(part), 0) + body
        out += b"\0" * ((32 + len(body)) % 4)
        if k % 5 == 3:
            out += obj(65, b"note" * 3)
    return out


def test_binary_log(spark, tmp_path):
    long = obj(101, struct.pack("<BBBBI", 1, 9, 12, 0, 0x80000123) + b"\0" * 32 + bytes(range(12)), 3_000_000_000)
    short = obj(101, struct.pack("<BBBBI", 1, 9, 12, 0, 0x80000124) + b"\0" * 32 + bytes(range(5)), 3_500_000_000)  # says 12, has 5
    flexible = obj(100, struct.pack("<HBBIIBBB5x", 3, 0, 15, 0x20, 0, 0, 0, 20) + bytes(range(64)), 400_000, 1)
    errors = b"".join(obj(73, struct.pack("<H14xI12x", 1, bits), 2_000_000_000) for bits in (0x80000006, 0x10, 0x21, 0x40, 0x20))
    stream = classic(0x10, b"LOBJ\x01", 1_000_000_000) + errors + long + short + flexible
    cut = len(stream) - 100
    (tmp_path / "a.blf").write_bytes(recording([stream[:cut], stream[cut:]]))
    shown = lambda frames: [(r["t"], r["frame_id"], r["kind"], r["channel"], bytes(r["data"]), r["error_type"]) for r in frames.orderBy("seq").collect()]
    expected = [
        (11.0, 0x10, "data", 1, b"LOBJ\x01", None),
        *((12.0, i, "error", 0, b"", what) for i, what in ((6, "form"), (0x10, "bit"), (0x21, "stuff"), (0x40, "other"), (0x20, "crc"))),
        (13.0, 0x123, "data", 0, bytes(range(12)), None), (13.5, 0x124, "data", 0, bytes(range(5)) + b"\0" * 7, None), (14.0, 0x20, "data", 2, bytes(range(20)), None),
    ]
    assert shown(textlogs.read_log(spark, str(tmp_path / "a.blf"))) == shown(blf.whole_files(spark, str(tmp_path / "a.blf"))) == expected
    with pytest.raises(SchemaError):
        next(blf.frames_of(b"nothing"))


def test_binary_log_in_ranges(spark, tmp_path):
    """Any cut of a file gives the same frames, whether objects end with containers, span several, or hold signatures."""
    draw, stream = random.Random(11), b""
    for i in range(900):
        bait = draw.choice([b"", b"LOBJ", b"LOBJ\x20\0\x01", draw.randbytes(8)])
        stream += classic(draw.randrange(2048), bait.ljust(8, b"!")[: draw.randint(4, 8)], i) if draw.random() < 0.8 else obj(draw.choice([101, 6]), struct.pack("<BBBBI", 1, 0, 64, 0, 5) + b"\0" * 32 + (b"LOBJ" + struct.pack("<HHII", 32, 1, draw.randrange(40, 200), 1)).ljust(64, b"x"), i)
    parts = []
    while stream:
        n = draw.choice([3, 20, 90, 700, 2500])
        parts, stream = [*parts, stream[:n]], stream[n:]
    content = recording(parts)
    log = blf.Log(lambda at, n: content[at : at + n], len(content))
    whole = [r for b in blf.frames_of(content) for r in b.to_pylist()]
    assert len(whole) > 700 and [r["seq"] for r in whole] == sorted({r["seq"] for r in whole})
    for split in (500, 3000, 40_000):
        some = [r for at in range(0, len(content), split) for b in blf.range_frames(log, at, min(at + split, len(content)), "log") for r in b.to_pylist()]
        assert some == whole
    (tmp_path / "b.blf").write_bytes(content)
    read = blf.read(spark, str(tmp_path), split=20_000)
    assert read.rdd.getNumPartitions() == 3 and [bytes(r["data"]) for r in read.orderBy("seq").collect()] == [r["data"] for r in whole]


def test_broken_binary_logs():
    frames = b"".join(classic(i, bytes(8), i) for i in range(60))
    good = recording([frames])
    rows = lambda content: sum(len(b) for b in blf.frames_of(content))
    assert rows(good) == 60
    gap = recording([frames[:480] + b"?" * 9 + frames[480:]], pack=False)  # more than padding between two objects
    late = recording([b"?" * 8 + frames], pack=False)
    zero = recording([frames[:480] + b"LOBJ" + struct.pack("<HHII", 32, 1, 0, 1) + b"\0" * 32 + frames[480:]], pack=False)
    for content in (gap, late, zero, good[:-40], good[:144] + b"junk" + good[144:], good.replace(struct.pack("<HHI", 2, 0, 0), struct.pack("<HHI", 7, 0, 0), 1)):
        with pytest.raises(SchemaError):
            rows(content)
    padded = recording([frames[:480] + b"\0" * 7 + frames[480:]], pack=False)
    assert rows(padded) == 60 and rows(recording([b""])) == 0 and rows(recording([])) == 0


def test_written_binary_logs(spark, tmp_path):
    frames = source.normalised(spark.range(3000).select(F.col("id").alias("seq"), (1e9 + F.col("id") / 1000).alias("t"), (F.col("id") % 3).cast("int").alias("channel"), (F.col("id") % 5000).alias("frame_id"),
        F.when(F.col("id") % 50 == 0, "error").otherwise("data").alias("kind"), F.when(F.col("id") % 50 == 0, F.lit(b"")).otherwise(F.unhex(F.repeat(F.lit("a1"), (F.col("id") % 13).cast("int")))).alias("data"), F.when(F.col("id") % 50 == 0, "ack").alias("error_type")))
    assert blf.write(frames.repartition(2), f"file://{tmp_path}/logs", 5000).agg(F.sum("frames")).first()[0] == 3000
    back = blf.read(spark, f"file://{tmp_path}/logs", 10_000)
    key = lambda df: sorted((round(r["t"] * 1000), r["channel"], r["frame_id"] if r["kind"] == "data" else 4, r["kind"], bytes(r["data"]), r["error_type"]) for r in df.collect())
    assert key(back) == key(frames) and back.select("log_id").distinct().count() == 2


def test_hex_and_numbers(spark):
    rows = spark.createDataFrame([("00 11", b"\x00\x11"), ("0x1 0xFF", b"\x01\xff"), ("abc", None), ("", b""), ("1FF 0", None)], "text string, expected binary")
    for r in rows.select("text", "expected", bits.hex_bytes(F.col("text")).alias("got")).collect():
        assert (r["got"] is None and r["expected"] is None) or bytes(r["got"]) == bytes(r["expected"]), r


def measured(n, seed=1):
    draw = random.Random(seed)
    return [(i / 100, draw.randrange(3), draw.choice([5, 0x7FF, 0x800, 0x1FFFFFFF]), draw.randbytes(draw.choice([0, 1, 8, 12, 64]))) for i in range(n)]


def shown(frames):
    return [(r["t"], r["channel"], r["frame_id"], bytes(r["data"]), r["is_extended"]) for r in frames.orderBy("log_id", "seq").collect()]


def test_measurement_files_in_blocks(spark, tmp_path):
    """Plain and packed blocks that cut records anywhere, several groups, other channels beside frames."""
    rows = measured(700)
    whole = b"".join(mf4.record(*r) for r in rows[:500])
    out, draw = mf4.Builder(), random.Random(2)
    blocks, sizes, at = [], [], 0
    while at < len(whole):
        part = whole[at : at + draw.randint(1, 3000)]
        blocks.append(draw.choice([lambda: out.block("DT", [], part), lambda: out.zipped(part), lambda: out.zipped(part, 79), lambda: out.zipped(part, 7)])())
        sizes.append(len(part))
        at += len(part)
    first = out.group(out.frame_channels(64), 79, 500)
    other = out.group(out.channel("Temperature", 0, 4, 8, 64, out.channel("t", 2, 4, 0, 64)), 16, 1)
    groups = [(other, out.block("DT", [], bytes(16)), 0), (first, out.listed(blocks, sizes), 0), (out.group(out.frame_channels(64), 79, 200), out.block("DT", [], b"".join(mf4.record(*r) for r in rows[500:])), 0)]
    (tmp_path / "a.mf4").write_bytes(out.finished(groups))
    expected = [(t, c, i, d, i > 0x7FF) for t, c, i, d in rows]
    for split in (79, 5000, 1 << 30):
        read = mf4.read(spark, str(tmp_path / "a.mf4"), split if split > 79 else 2000)
        assert shown(read) == expected
    assert mf4.read(spark, str(tmp_path / "a.mf4"), 5000).rdd.getNumPartitions() == 8 + 4
    assert shown(textlogs.read_log(spark, str(tmp_path / "a.mf4"), 1.0, 2.0)) == [r for r in expected if 1.0 <= r[0] <= 2.0]


def test_measurement_files_of_mixed_records(spark, tmp_path):
    """Records of several groups after one another, with numbers; lengths from codes; bytes apart; times with a conversion."""
    rows = measured(300, 3)
    out, data, stored = mf4.Builder(), b"", b""
    for k, (t, c, i, d) in enumerate(rows):
        data += b"\x01" + struct.pack("<IIBQ", round(t * 1000), i | 1 << 31, {0: 0, 1: 1, 8: 8, 12: 9, 64: 15}[len(d)] | 0xF0 & (k << 4), len(stored))
        stored += struct.pack("<I", len(d)) + d
        data += b"\x02" + bytes(5) if k % 3 == 0 else b"\x03" + struct.pack("<I", k % 4) + bytes(k % 4) if k % 3 == 1 else b""
    apart = out.block("SD", [], stored)
    milli = out.block("CC", [0, 0, 0, 0], struct.pack("<BBHHHdddd", 1, 0, 0, 0, 2, 0.0, 0.0, 0.0, 0.001))
    at = out.channel("CAN_DataFrame.DataBytes", 1, 10, 9, 64, data=apart)
    at = out.channel("CAN_DataFrame.DLC", 0, 0, 8, 4, at)
    at = out.channel("CAN_DataFrame.ID", 0, 0, 4, 31, at)
    first = out.channel("t", 2, 0, 0, 32, out.channel("CAN_DataFrame", 0, 10, 4, 104, 0, at), conversion=milli)
    group = out.group(first, 17, 300, out.group(0, 5, 100, out.group(0, 0, 100, number=3, flags=1), number=2), number=1)
    cut = len(data) // 2 + 5
    listed = out.listed([out.block("DT", [], data[:cut]), out.zipped(data[cut:])], [cut, len(data) - cut])
    (tmp_path / "b.mf4").write_bytes(out.finished([(group, listed, 1)]))
    assert [(round(t, 6), c, i, d) for t, c, i, d, _ in shown(mf4.read(spark, str(tmp_path)))] == [(t, 0, i, d) for t, c, i, d in rows]


def test_no_measurement_file(spark, tmp_path):
    (tmp_path / "x.mf4").write_bytes(b"MDF     3.00    ".ljust(200, b"\0"))
    (tmp_path / "y").mkdir()
    (tmp_path / "y/y.mf4").write_bytes(mf4.Builder().finished([]))
    for path in ("x.mf4", "y"):
        with pytest.raises(Exception, match="not a measurement file|no channels"):
            mf4.read(spark, str(tmp_path / path)).count()


def test_written_measurement_files(spark, tmp_path):
    frames = source.cruise_frames(spark)
    assert mf4.write(frames.repartition(2), f"file://{tmp_path}/m", 9000).agg(F.sum("frames")).first()[0] == 6004
    key = lambda df: sorted((r["t"], r["frame_id"], bytes(r["data"])) for r in df.collect())
    assert key(mf4.read(spark, f"file://{tmp_path}/m", 40_000)) == key(frames)
