"""Signals from payloads: bit fields as column expressions, so decoding stays in generated code.

Frames shorter than their message's schema length are not decoded at all; longer ones are read up to it. A member of a
multiplexed message has a sample only where the selector's raw value is the member's, or in one of its ranges; selectors may
be selected themselves.
"""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framelake.functions.bits import big_word, byteswapped, little_word
from framelake.plans.catalog import Catalog, Message, Signal

SAMPLE = "struct<raw: bigint, num: double, label: string>"


def word(data: Column, first: int, count: int, little_endian: bool) -> Column:
    """count (1 to 8) bytes of data from byte `first` as a 64-bit integer."""
    part = F.substring(data, first + 1, count)
    return little_word(part) if little_endian else big_word(part)


def place(signal: Signal) -> tuple[int, int, int]:
    """(first byte, bytes, shift) of a signal. Big-endian starts are numbered in sawtooth order; in network order the
    field's first bit is 8 * (start // 8) + 7 - start % 8."""
    if signal.little_endian:
        first, bit = divmod(signal.start, 8)
        return first, (bit + signal.length + 7) // 8, bit
    at = 8 * (signal.start // 8) + 7 - signal.start % 8
    first, bit = divmod(at, 8)
    count = (bit + signal.length + 7) // 8
    return first, count, count * 8 - bit - signal.length


@F.pandas_udf(T.LongType())
def _wide_bits(data: pd.Series, first: pd.Series, count: pd.Series, shift: pd.Series, length: pd.Series, little: pd.Series) -> pd.Series:
    """Fields that span nine bytes, which no 64-bit word holds."""
    out = []
    for d, a, n, s, bits, le in zip(data, first, count, shift, length, little):
        value = None
        if d is not None and not pd.isna(a) and len(d) >= a + n:
            a, n, s, bits = int(a), int(n), int(s), int(bits)
            value = int.from_bytes(d[a : a + n], "little" if le else "big") >> s & (1 << bits) - 1
            value -= (value >> 63) << 64
        out.append(value)
    return pd.Series(out, dtype="Int64")


@F.pandas_udf(T.DoubleType())
def _as_float(bits: pd.Series, length: pd.Series) -> pd.Series:
    out = [None if pd.isna(b) else struct.unpack("<f", struct.pack("<I", int(b) & 0xFFFFFFFF))[0] if n == 32 else struct.unpack("<d", struct.pack("<q", int(b)))[0] for b, n in zip(bits, length)]
    return pd.Series(out, dtype="float64")


def with_words(frames: DataFrame) -> DataFrame:
    """frames with __big and __little: the first eight bytes of data (filled up with zeros) as integers, read once a frame."""
    head = F.conv(F.rpad(F.hex(F.substring("data", 1, 8)), 16, "0"), 16, -10).cast("long")
    return frames.withColumn("__big", head).withColumn("__little", byteswapped(F.col("__big")))


def raw(signal: Signal, data: Column, words: bool = False) -> Column:
    """The field's integer, sign-extended where it is signed; with words, over frames that have with_words()'s columns."""
    first, count, shift = place(signal)
    if words and first + count <= 8:
        at = first * 8 + shift if signal.little_endian else 64 - (first + count) * 8 + shift
        value = F.col("__little" if signal.little_endian else "__big")
        value = F.shiftrightunsigned(value, at) if at else value
    elif count > 8:
        value = _wide_bits(data, *(F.lit(x) for x in (first, count, shift, signal.length, signal.little_endian)))
    else:
        value = word(data, first, count, signal.little_endian)
        value = F.shiftrightunsigned(value, shift) if shift else value
    if signal.length < 64:
        value = value.bitwiseAND(F.lit((1 << signal.length) - 1))
        if signal.signed:
            value = F.when(value >= F.lit(1 << signal.length - 1), value - F.lit(1 << signal.length)).otherwise(value)
    return value


def scaled(signal: Signal, value: Column) -> Column:
    """Physical value: one multiplication, then one addition, in double."""
    number = _as_float(value, F.lit(signal.length)) if signal.is_float else value.cast("double")
    return number * F.lit(float(signal.scale)) + F.lit(float(signal.offset)) if (signal.scale, signal.offset) != (1, 0) else number


def label(signal: Signal, value: Column) -> Column:
    """Name of a raw value, null where it has none."""
    if not signal.choices:
        return F.lit(None).cast("string")
    case = F.when(value == signal.choices[0][0], F.lit(signal.choices[0][1]))
    for key, name in signal.choices[1:]:
        case = case.when(value == key, F.lit(name))
    return case


def present(message: Message, signal: Signal, data: Column, dlc: Column, frame_id: Column, words: bool = False) -> Column:
    """Whether a frame carries a sample of the signal."""
    here = (frame_id == message.frame_id) & (dlc >= message.length)
    for selector, ranges in message.conditions(signal):
        value, within = raw(selector, data, words), F.lit(False)
        for low, high in ranges:
            within = within | value.between(low, high)
        here = here & within
    return F.coalesce(here, F.lit(False))


def sample(message: Message, signal: Signal, words: bool = False) -> Column:
    """struct(raw, num, label), null where the frame has no sample; over columns data, dlc, frame_id."""
    data = F.col("data")
    value = raw(signal, data, words)
    whole = F.struct(value.alias("raw"), scaled(signal, value).alias("num"), label(signal, value).alias("label"))
    return F.when(present(message, signal, data, F.col("dlc"), F.col("frame_id"), words), whole)


def resolve(catalog: Catalog, names: list[str]) -> dict[str, tuple[Message, Signal]]:
    """Known names only; unknown ones have no data, which callers must bear."""
    return {n: found for n in names if (found := catalog.find(n))}


def data_frames(frames: DataFrame, ids: list[int] | None = None) -> DataFrame:
    kept = frames.where("kind = 'data'")
    return kept if ids is None else kept.where(F.col("frame_id").isin(ids))


def wide(frames: DataFrame, catalog: Catalog, names: list[str]) -> DataFrame:
    """(log_id, t, seq, channel, frame_id, one struct column per name): samples of the frames that carry any."""
    found = resolve(catalog, names)
    ids = sorted({m.frame_id for m, _ in found.values()})
    columns = [(sample(*found[n], words=True) if n in found else F.lit(None).cast(SAMPLE)).alias(n) for n in names]
    return with_words(data_frames(frames, ids)).select("log_id", "t", "seq", "channel", "frame_id", *columns)


def _field(signal: Signal | None) -> dict:
    """Where a signal's bits are, as columns of the table that frames join with: the word's first byte and size, the shifts
    within it and (for fields in the first eight bytes) within the payload's whole word, mask, and the sign's bit."""
    if signal is None:
        return dict.fromkeys(("first", "count", "shift", "at", "bits", "little", "mask", "sign"))
    first, count, shift = place(signal)
    at = None
    if first + count <= 8:
        at = first * 8 + shift if signal.little_endian else 64 - (first + count) * 8 + shift
    mask = -1 if signal.length >= 64 else (1 << signal.length) - 1
    return {"first": first, "count": count, "shift": shift, "at": at, "bits": signal.length, "little": signal.little_endian, "mask": mask, "sign": 1 << signal.length - 1 if signal.signed and signal.length < 64 else 0}


_FIELD = "struct<first: int, count: int, shift: int, at: int, bits: int, little: boolean, mask: bigint, sign: bigint>"


def _signals(frames: DataFrame, pairs: list[tuple[Message, Signal]]) -> DataFrame:
    """A row per signal, small as the schema is."""
    rows = []
    for m, s in pairs:
        over = [(_field(selector), [{"low": a, "high": b} for a, b in ranges]) for selector, ranges in m.conditions(s)]
        rows.append((m.frame_id, m.length, s.name, _field(s), over, float(s.scale), float(s.offset), s.length, s.is_float, dict(reversed(s.choices))))
    selectors = f"array<struct<field: {_FIELD}, ranges: array<struct<low: bigint, high: bigint>>>>"
    kind = f"message_id long, least int, signal string, field {_FIELD}, selectors {selectors}, scale double, offset double, bits int, is_float boolean, choices map<bigint, string>"
    return frames.sparkSession.createDataFrame(rows, kind)


def _shifted(word_: Column, by: Column) -> Column:
    return F.call_function("shiftrightunsigned", word_, by)


def _bits_of(field: Column, wide_fields: bool) -> Column:
    """The integer of a field, given by columns, of a frame with its payload (data) and its words (__big, __little)."""
    part = F.substring("data", field["first"] + 1, field["count"])
    far = _shifted(F.when(field["little"], little_word(part)).otherwise(big_word(part)), field["shift"])
    if wide_fields:
        far = F.when(field["count"] > 8, _wide_bits(F.col("data"), field["first"], field["count"], field["shift"], field["bits"], field["little"])).otherwise(far)
    near = _shifted(F.when(field["little"], F.col("__little")).otherwise(F.col("__big")), field["at"])
    value = F.when(field["at"].isNotNull(), near).otherwise(far).bitwiseAND(field["mask"])
    return value.bitwiseXOR(field["sign"]) - field["sign"]


def samples(frames: DataFrame, catalog: Catalog, names: list[str] | None = None) -> DataFrame:
    """Long form (log_id, message_id, signal, channel, t, seq, raw, num, label), only for the names asked for; without
    names every signal of every message, each under its own message.

    Frames join a table of the signals, so the plan is as large for one signal as for a whole schema; a payload's first
    eight bytes become a word once, which all its signals shift. Python sees only fields over nine bytes and floats, and
    nothing if the schema has none of them."""
    if names is None:
        pairs = [(m, s) for m in catalog.messages for s in m.signals]
    else:
        pairs = list(resolve(catalog, names).values())
    ids = sorted({m.frame_id for m, _ in pairs})
    chains = [[selector for selector, _ in m.conditions(s)] for m, s in pairs]
    wide_fields = any(place(x)[1] > 8 for (_, s), chain in zip(pairs, chains) for x in (s, *chain))
    rows = with_words(data_frames(frames, ids).select("log_id", "frame_id", "channel", "t", "seq", "dlc", "data"))
    known = F.broadcast(_signals(frames, pairs))  # as many rows as the schema has signals
    rows = rows.join(known, (F.col("frame_id") == F.col("message_id")) & (F.col("dlc") >= F.col("least")))
    for k in range(max(map(len, chains), default=0)):  # selectors of selectors: as deep as the schema nests them
        over = F.get("selectors", F.lit(k))
        rows = rows.withColumn("__over", _bits_of(over["field"], wide_fields))
        rows = rows.where(over.isNull() | F.exists(over["ranges"], lambda r: F.col("__over").between(r["low"], r["high"])))
    rows = rows.select("log_id", "message_id", "signal", "channel", "t", "seq", _bits_of(F.col("field"), wide_fields).alias("raw"), "scale", "offset", "bits", "is_float", "choices")
    number = F.col("raw").cast("double")
    if any(s.is_float for _, s in pairs):
        number = F.when(F.col("is_float"), _as_float(F.col("raw"), F.col("bits"))).otherwise(number)
    plain = (F.col("scale") == 1) & (F.col("offset") == 0)
    number = F.when(plain, number).otherwise(number * F.col("scale") + F.col("offset"))
    return rows.select("log_id", "message_id", "signal", "channel", "t", "seq", "raw", number.alias("num"), F.try_element_at("choices", F.col("raw")).alias("label"))


def plotted(signal: Signal, value: Column) -> Column:
    """Number to draw: of an enumeration the place of its label among the labels in the order of raw values, else the
    scaled number."""
    if not signal.choices:
        return value["num"]
    places = {name: i for i, (_, name) in reversed(list(enumerate(sorted(signal.choices))))}
    case = F
    for name, at in places.items():
        case = case.when(value["label"] == name, F.lit(float(at)))
    return case.otherwise(value["num"])


def decode_status(frames: DataFrame, messages: DataFrame) -> DataFrame:
    """(frame_id, name, n_frames, n_decodable, first_dlc, length) of every known message in the log, exactly."""
    rows = data_frames(frames).join(messages.select("frame_id", "name", "length"), "frame_id")
    return rows.groupBy("frame_id", "name", "length").agg(
        F.count("*").alias("n_frames"), F.count_if(F.col("dlc") >= F.col("length")).alias("n_decodable"), F.min_by("dlc", F.struct("t", "seq")).alias("first_dlc")
    )


def undecodable(frames: DataFrame, messages: DataFrame) -> DataFrame:
    """Known messages of which no frame can be decoded, most frames first."""
    return decode_status(frames, messages).where("n_decodable = 0").orderBy(F.desc("n_frames"), "frame_id")


def unknown_ids(frames: DataFrame, messages: DataFrame) -> DataFrame:
    return data_frames(frames).select("frame_id").distinct().join(messages.select("frame_id"), "frame_id", "left_anti")


def with_data(frames: DataFrame, messages: DataFrame) -> DataFrame:
    """messages with has_data: whether some frame of theirs can be decoded."""
    some = decode_status(frames, messages).where("n_decodable > 0").select("frame_id", F.lit(True).alias("__has"))
    return messages.join(some, "frame_id", "left").withColumn("has_data", F.coalesce("__has", F.lit(False))).drop("__has")


def byte_values(data: str, count: str) -> Column:
    """The first `count` bytes of a payload as numbers; there must be one at least."""
    return F.transform(F.sequence(F.lit(0), F.col(count) - 1), lambda i: F.conv(F.substring(F.hex(data), i * 2 + 1, F.lit(2)), 16, 10).cast("long"))


def nibbles(byte: Column) -> dict[str, Column]:
    return {"byte": byte, "low": byte.bitwiseAND(F.lit(15)), "high": F.shiftright(byte, 4)}


def byte_fields(frames: DataFrame) -> DataFrame:
    """(log_id, frame_id, channel, t, seq, byte, bits, field, value): every byte, its low and its high nibble."""
    rows = data_frames(frames).where("dlc > 0")
    bytes_ = rows.select("log_id", "frame_id", "channel", "t", "seq", F.posexplode(byte_values("data", "dlc")).alias("byte", "v"))
    parts = nibbles(F.col("v"))
    fields = F.array(*(F.struct(F.lit(name).alias("field"), F.lit(bits).alias("bits"), parts[name].alias("value")) for name, bits in (("byte", 8), ("low", 4), ("high", 4))))
    return bytes_.select("log_id", "frame_id", "channel", "t", "seq", "byte", F.inline(fields))
