"""Table-driven samples against plain integers, and how long their plan takes."""

import random
import time

from pyspark.sql import functions as F

from framelake.operators import decode
from framelake.plans.catalog import Catalog, Message, Signal


def plain(signal, data):
    first, count, shift = decode.place(signal)
    value = int.from_bytes(data[first : first + count], "little" if signal.little_endian else "big") >> shift & (1 << signal.length) - 1
    if signal.signed and value >> (signal.length - 1):
        value -= 1 << signal.length
    return value - (1 << 64 if value >> 63 and value > 0 else 0)


def frames(spark, rows):
    kept = spark.createDataFrame([("l", i, float(i), 0, f, bytearray(d), len(d), "data") for i, (f, d) in enumerate(rows)], "log_id string, seq long, t double, channel int, frame_id long, data binary, dlc int, kind string")
    return kept


def test_samples_of_random_schemas(spark):
    draw = random.Random(4)
    messages = []
    for m in range(12):
        size = draw.choice((1, 8, 8, 12, 64))
        signals = []
        for k in range(14):
            length = draw.randint(1, min(64, size * 8))
            little = draw.random() < 0.5
            at = draw.randint(0, size * 8 - length)
            start = at if little else 8 * (at // 8) + 7 - at % 8
            signals.append(Signal(f"S{m}_{k}", start, length, little, draw.random() < 0.5, scale=draw.choice((1.0, 0.1, -2.0)), offset=draw.choice((0.0, 5.0)), choices=((1, "one"), (3, "three")) if k % 3 == 0 else ()))
        if m % 2:
            signals = [Signal(f"Mux{m}", 0, 4, selector=True), *(s if k % 2 else Signal(s.name, s.start, s.length, s.little_endian, s.signed, selected_by=k) for k, s in enumerate(signals))]
        messages.append(Message(m, f"M{m}", size, tuple(signals)))
    rows = [(m.frame_id, bytes(draw.randrange(256) for _ in range(m.length + extra))) for m in messages for extra in (0, 0, 0, 3, -1)]
    catalog = Catalog(tuple(messages))
    expected = set()
    for i, (f, data) in enumerate(rows):
        for s in messages[f].signals if len(data) >= messages[f].length else ():
            if s.selected_by is None or plain(messages[f].selector, data) == s.selected_by:
                expected.add((i, s.name, plain(s, data), dict(s.choices).get(plain(s, data))))
    found = decode.samples(frames(spark, rows), catalog).collect()
    assert {(r["seq"], r["signal"], r["raw"], r["label"]) for r in found} == expected and len(found) == len(expected)
    scale = {s.name: (s.scale, s.offset) for m in messages for s in m.signals}
    assert all(r["num"] == (float(r["raw"]) if scale[r["signal"]] == (1, 0) else float(r["raw"]) * scale[r["signal"]][0] + scale[r["signal"]][1]) for r in found)
    names = [s.name for m in messages[:3] for s in m.signals][:20]
    wide = decode.wide(frames(spark, rows), catalog, names).select("seq", *(F.col(n)["raw"].alias(n) for n in names)).collect()
    assert {(r["seq"], n, r[n]) for r in wide for n in names if r[n] is not None} == {e[:3] for e in expected if e[1] in names}


def test_plan_of_a_whole_schema(spark):
    catalog = Catalog(tuple(Message(i, f"M{i}", 8, tuple(Signal(f"S{i}_{k}", 4 * k, 4) for k in range(15))) for i in range(125)))
    rows = frames(spark, [(3, bytes(range(8))), (124, bytes(8))])
    began = time.time()
    assert decode.samples(rows, catalog).count() == 30
    assert time.time() - began < 10
