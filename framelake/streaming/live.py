"""Live recordings: the engine's timing checks, held signals and machines over streams of frames.

Streams have the columns of frames and ts (timestamp). Windows are aligned to the epoch, not to a log's first frame as in
batch. Late rows beyond the watermark are dropped. Operators with state of their own need the RocksDB state store
(spark.sql.streaming.stateStore.providerClass).
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from datetime import datetime, timezone

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from framelake.functions.bits import frame_bits
from framelake.operators import machines
from framelake.operators.decode import SAMPLE, resolve, sample, with_words
from framelake.plans.catalog import Catalog
from framelake.plans.functions import Machine
from framelake.sources import textlogs
from framelake.sources.frames import normalised, window


def load(frames: DataFrame, baud: float = 500_000, window: str = "100 milliseconds", seconds: float = 0.1, late: str = "2 seconds") -> DataFrame:
    """(log_id, channel, start, load): per cent of each tumbling window that frames fill."""
    rows = frames.where("kind = 'data'").withWatermark("ts", late)
    sums = rows.groupBy("log_id", "channel", F.window("ts", window).alias("w")).agg(F.sum(frame_bits(F.col("dlc"), F.col("is_extended"))).alias("bits"))
    return sums.select("log_id", "channel", F.col("w.start").alias("start"), (F.col("bits") / (baud * seconds) * 100).alias("load"))


def storms(frames: DataFrame, least: int = 10, window: str = "100 milliseconds", late: str = "2 seconds") -> DataFrame:
    """(log_id, start, n): windows with at least `least` error frames."""
    rows = frames.where("kind = 'error'").withWatermark("ts", late)
    return rows.groupBy("log_id", F.window("ts", window).alias("w")).agg(F.count("*").alias("n")).where(F.col("n") >= least).select("log_id", F.col("w.start").alias("start"), "n")


def busy_spans(frames: DataFrame, gap: str = "500 milliseconds", late: str = "2 seconds") -> DataFrame:
    """(log_id, start, end, n): spans without a gap as long as `gap`; silence is what lies between two of them."""
    rows = frames.where("kind = 'data'").withWatermark("ts", late)
    return rows.groupBy("log_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("log_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def frames_of(spark: SparkSession, folder: str, start: float | None = None, end: float | None = None, decimal: bool = False, files: int = 1) -> DataFrame:
    """A stream of frames, with ts, from ASC files that appear in a folder, so many at a time; ids are hexadecimal unless
    decimal, times count from the epoch, and an inclusive span of them may be chosen."""
    text = spark.readStream.option("maxFilesPerTrigger", files).text(folder)
    lines = text.select(F.col("_metadata.file_name").alias("log_id"), F.lit(0).alias("line_no"), textlogs.line_text(F.col("value")).alias("line"))
    rows = normalised(textlogs.asc_rows(lines.withColumn("base", F.lit("dec" if decimal else "hex")).withColumn("absolute", F.lit(False))).drop("absolute"))
    return window(rows, start, end).withColumn("ts", F.timestamp_seconds("t"))


def _sample_columns(names: list[str]) -> list[T.StructField]:
    kinds = (("raw", T.LongType()), ("num", T.DoubleType()), ("label", T.StringType()))
    return [T.StructField(f"{n}_{part}", kind) for n in names for part, kind in kinds]


#: Seconds by which event times are put off in Hold, as the first watermark is 0 and logs may begin at 0.
AHEAD = 86_400.0


def _width(piece: float) -> int:
    """Milliseconds of a piece of so many seconds."""
    return max(1, round(piece * 1000))


class Hold(StatefulProcessor):
    """Signals of one log, held: for each instant of its frames the values in force at it and at the instant before.

    Frames wait in pieces of time until the watermark has passed a piece's end, for which there is a timer, so that they come
    out in order of (t, seq) however they came in. State: the waiting frames, in packs by piece; the last value of each
    signal; and the last instant that was given out. Python holds BUFFER new frames or one piece, however many frames a
    batch has. Frames of instants that were given out already are too late and left out.

    A row may stand for many frames, with the last samples of them: then it has them in a column `pack`, which comes out
    with the values before them."""

    BUFFER = 50_000

    def __init__(self, names: list[str], piece: float = 1.0, packed: bool = False):
        self.names, self.width, self.carried = names, _width(piece), ["pack"] if packed else []
        self.columns = ["log_id", "t", "ts", *(f.name for which in ("cur", "prev") for f in _sample_columns([f"{which}_{n}" for n in names])), *self.carried]
        if packed:
            self.BUFFER = 200

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        at = [T.StructField("piece", T.LongType()), T.StructField("pack", T.LongType())]
        self.packs = handle.getMapState("packs", T.StructType(at), T.StructType([T.StructField("frames", T.BinaryType())]))
        self.count = handle.getMapState("count", T.StructType(at[:1]), T.StructType(at[1:]))
        self.values = handle.getMapState("values", T.StructType([T.StructField("signal", T.StringType())]), T.StructType(_sample_columns([""])))
        self.done = handle.getValueState("done", T.StructType([T.StructField("t", T.DoubleType())]))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        done = self.done.get()[0] if self.done.exists() else None
        parts = ["t", "seq", *(f.name for f in _sample_columns(self.names)), *self.carried]
        waiting: dict[int, list[tuple]] = {}
        held = 0
        for r in rows:
            frame = tuple(r[c] for c in parts)
            if done is None or frame[0] > done:
                waiting.setdefault(math.floor((frame[0] + AHEAD) * 1000) // self.width, []).append(frame)
                held += 1
                if held >= self.BUFFER:
                    self._put(waiting)
                    waiting, held = {}, 0
        self._put(waiting)
        return iter(())

    def _put(self, waiting: dict[int, list[tuple]]) -> None:
        for piece, frames in waiting.items():
            pack = self.count.getValue((piece,))[0] if self.count.containsKey((piece,)) else 0
            self.packs.updateValue((piece, pack), (pickle.dumps(frames),))
            self.count.updateValue((piece,), (pack + 1,))
            if not pack:
                self.handle.registerTimer((piece + 1) * self.width)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        piece = expiredTimerInfo.getExpiryTimeInMs() // self.width - 1
        ready: list[tuple] = []
        for pack in range(self.count.getValue((piece,))[0]):
            ready += pickle.loads(self.packs.getValue((piece, pack))[0])
            self.packs.removeKey((piece, pack))
        self.count.removeKey((piece,))
        ready.sort(key=lambda r: r[:2])
        held = [tuple(self.values.getValue((n,))) if self.values.containsKey((n,)) else (None, None, None) for n in self.names]
        started, told = self.done.exists(), Row(*self.columns)
        for k, frame in enumerate(ready):
            if k == 0 or frame[0] != ready[k - 1][0]:
                before = list(held) if started else [(None, None, None)] * len(self.names)
            for i in range(len(self.names)):
                sample = frame[2 + 3 * i : 5 + 3 * i]
                if sample[0] is not None or sample[1] is not None:
                    held[i] = sample
            if k + 1 == len(ready) or ready[k + 1][0] != frame[0]:
                started = True
                yield told(key[0], frame[0], datetime.fromtimestamp(frame[0], timezone.utc), *(x for s in held for x in s), *(x for s in before for x in s), *frame[2 + 3 * len(self.names) :])
        for n, sample in zip(self.names, held):
            if sample != (None, None, None):
                self.values.updateValue((n,), sample)
        self.done.update((ready[-1][0],))

    def close(self) -> None:
        pass


def _instants(t: np.ndarray, seq: np.ndarray, samples: dict[str, pa.StructArray]) -> bytes:
    """The frames of a piece as one pack: their instants, and the last sample of each signal at each, null where none is."""
    order = np.lexsort((seq, t))
    ends = np.append(t[order][1:] != t[order][:-1], True).nonzero()[0]
    starts = np.append(0, ends[:-1] + 1)
    columns, names = [pa.array(t[order][ends])], ["t"]
    for n, sample in samples.items():
        there = pc.or_(pc.is_valid(sample.field("raw")), pc.is_valid(sample.field("num"))).to_numpy(zero_copy_only=False) & sample.is_valid().to_numpy(zero_copy_only=False)
        last = np.maximum.accumulate(np.where(there[order], np.arange(len(order)), -1))[ends]
        at = pa.array(order[np.maximum(last, 0)], mask=last < starts)
        columns += [sample.field(part).take(at) for part in ("raw", "num", "label")]
        names += [f"{n}_{part}" for part in ("raw", "num", "label")]
    sink, batch = pa.BufferOutputStream(), pa.record_batch(columns, names)
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _held_in(pack: bytes, names: list[str], before: dict) -> list[pa.Array]:
    """t, then cur_<name> and prev_<name> (raw, num, label of each) at each instant of a pack; `before` has the values that
    were in force before it."""
    batch = pa.ipc.open_stream(pack).read_next_batch()
    cur, prev = [], []
    for n in names:
        parts = [batch.column(f"{n}_{part}") for part in ("raw", "num", "label")]
        there = pc.or_(pc.is_valid(parts[0]), pc.is_valid(parts[1])).to_numpy(zero_copy_only=False)
        at = np.maximum.accumulate(np.where(there, np.arange(1, len(batch) + 1), 0))  # 0: the value from before
        for part, column in zip(("raw", "num", "label"), parts):
            every = pa.concat_arrays([pa.array([before[f"prev_{n}_{part}"]], column.type), column])
            cur.append(every.take(pa.array(at))), prev.append(every.take(pa.array(np.append(0, at[:-1]))))
    return [batch.column("t"), *cur, *prev]


def held(frames: DataFrame, catalog: Catalog, names: list[str], late: str = "2 seconds", piece: float = 1.0) -> DataFrame:
    """(log_id, t, ts, cur_<name>, prev_<name>) of each instant of a stream's data frames, as align.held() gives it for a log
    that is at rest: an instant comes out when the watermark, `late` behind the newest frame, has passed the end of its
    piece of time. A piece, of so many seconds, is what Python holds at once.

    Frames wait in a window for each piece, so a log's pieces are worked on by many tasks. Only packs, a row for each piece
    with its last samples, go through the one task that carries a log's values on (Hold)."""
    found, width = resolve(catalog, names), _width(piece)
    samples = [(sample(*found[n], words=True) if n in found else F.lit(None).cast(SAMPLE)).alias(n) for n in names]
    timed = frames.where("kind = 'data'").withColumn("__ts", F.timestamp_seconds(F.col("t") + AHEAD)).withWatermark("__ts", late)
    rows = with_words(timed).select("log_id", "__ts", "t", "seq", *samples)

    @F.arrow_udf("binary")
    def packed(frames: pa.Array) -> pa.Array:
        out = []
        for k in range(len(frames)):
            one = frames[k].values
            out.append(_instants(one.field("t").to_numpy(), one.field("seq").to_numpy(), {n: one.field(n) for n in names}))
        return pa.array(out, pa.binary())

    there = lambda n: F.col(f"{n}.raw").isNotNull() | F.col(f"{n}.num").isNotNull()
    last = [F.max_by(n, F.when(there(n), F.struct("t", "seq"))).alias(n) for n in names]
    pieces = rows.groupBy("log_id", F.window("__ts", f"{width} milliseconds").alias("__w")).agg(F.collect_list(F.struct("t", "seq", *names)).alias("frames"), *last)
    packs = pieces.select(
        "log_id", F.window_time("__w").alias("__ts"), (F.unix_millis(F.col("__w.start")) / 1000 - AHEAD + width / 2000).alias("t"), F.lit(0).cast("long").alias("seq"),
        *(F.col(n)[part].alias(f"{n}_{part}") for n in names for part in ("raw", "num", "label")), packed("frames").alias("pack"),
    )
    flat = _sample_columns([f"{which}_{n}" for which in ("cur", "prev") for n in names])
    first = [T.StructField("log_id", T.StringType()), T.StructField("t", T.DoubleType()), T.StructField("ts", T.TimestampType())]
    carried = packs.groupBy("log_id").transformWithState(Hold(names, piece, packed=True), T.StructType([*first, *flat, T.StructField("pack", T.BinaryType())]), "Append", "EventTime")
    wanted = [f.name for f in flat]

    def instants(batches):
        for batch in batches:
            for row in batch.to_pylist():
                columns = _held_in(row["pack"], names, row)
                yield pa.record_batch([pa.array([row["log_id"]] * len(columns[0]), pa.string()), *columns], ["log_id", "t", *wanted])

    spread = carried.select("log_id", "t", *(f"prev_{f.name}" for f in _sample_columns(names)), "pack").repartition("log_id", "t")
    told = spread.mapInArrow(instants, T.StructType([*first[:2], *flat])).withColumn("ts", F.timestamp_seconds("t"))
    one = lambda name: F.when(F.col(f"{name}_raw").isNotNull() | F.col(f"{name}_num").isNotNull(), F.struct(F.col(f"{name}_raw").alias("raw"), F.col(f"{name}_num").alias("num"), F.col(f"{name}_label").alias("label"))).alias(name)
    return told.select("log_id", "t", "ts", *(one(f"{which}_{n}") for n in names for which in ("cur", "prev")))


def machine_steps(frames: DataFrame, catalog: Catalog, functions: list[Machine], late: str = "2 seconds", piece: float = 1.0) -> DataFrame:
    """(log_id, function, t, ts, on_enter, on_exit, on_trigger): what each machine is told at each instant of a stream."""
    names = sorted({n for m in functions for n in m.signals})
    return machines.told(held(frames, catalog, names, late, piece), catalog, functions).select("log_id", "function", "t", "ts", "on_enter", "on_exit", "on_trigger")


#: Flags of a row in a pack of steps.
ENTER, EXIT, TRIGGER = 4, 2, 1


class Latch(StatefulProcessor):
    """One machine of one log: state is whether it is on and since when. Rows are packs of steps (first, last, pack), each in
    order of t, and are taken in order within a batch, STEPS at a time; packs whose times overlap are put in order together.
    Give batches of whole instants. `initial` has the ids of functions that are on at the start."""

    STEPS = 100_000
    TYPES = np.array(["exit", "enter", "attempt"], object)

    def __init__(self, initial: frozenset[str] = frozenset()):
        self.initial = initial

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", T.StructType([T.StructField("on", T.BooleanType()), T.StructField("since", T.DoubleType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        on, since = self.state.get() if self.state.exists() else (key[1] in self.initial, None)
        packs = sorted((row for part in rows for row in zip(part["first"], part["last"], part["pack"])), key=lambda row: row[:2])
        some, size, end = [], 0, -math.inf
        for k, (first, last, pack) in enumerate(packs):
            if size >= self.STEPS and first > end:
                out, on, since = self.latched(key, some, on, since)
                yield out
                some, size = [], 0
            some.append(pack)
            size, end, packs[k] = size + len(pack) // 9, max(end, last), None
        if some:
            out, on, since = self.latched(key, some, on, since)
            yield out
        self.state.update((on, since))

    def latched(self, key, packs: list[bytes], on: bool, since: float | None) -> tuple[pd.DataFrame, bool, float | None]:
        """Events of the packs' steps, and the state after them."""
        t, code = (np.concatenate(x) for x in zip(*map(_unpacked, packs)))
        order = np.lexsort((code, t))
        t, code, at = t[order], code[order], np.arange(len(order))
        enter, leave = code & ENTER > 0, code & EXIT > 0
        # The state is what the last set or reset says, turned once for each toggle since.
        toggles, fixed = np.cumsum(enter & leave), np.maximum.accumulate(np.where(enter ^ leave, at, -1))
        after = np.where(fixed >= 0, enter[fixed], on) ^ ((toggles - np.where(fixed >= 0, toggles[fixed], 0)) % 2 == 1)
        before = np.append(on, after[:-1])
        entered = np.maximum.accumulate(np.where(after & ~before, at, -1))
        begun = np.where(entered >= 0, t[entered], np.nan if since is None else since)
        changed, tried = np.flatnonzero(after != before), np.flatnonzero((code & TRIGGER > 0) & ~enter & ~after)
        kinds = np.append(after[changed].astype(np.int8), np.full(len(tried), 2, np.int8))
        rows = np.append(changed, tried)
        order = np.lexsort((kinds, rows))
        rows, kinds = rows[order], kinds[order]
        out = pd.DataFrame({"log_id": key[0], "function": key[1], "type": self.TYPES[kinds], "t": t[rows], "since": np.where(kinds == 0, begun[rows], np.nan)})
        on = bool(after[-1])
        return out, on, float(begun[-1]) if on and not np.isnan(begun[-1]) else None

    def close(self) -> None:
        pass


def _unpacked(pack: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(pack) // 9
    return np.frombuffer(pack, np.float64, n), np.frombuffer(pack, np.uint8, n, 8 * n)


def _step_packs(steps: DataFrame, piece: float | None) -> DataFrame:
    """(log_id, function, first, last, pack): the steps of an Arrow batch in order of t, 9 bytes each; a pack ends with its
    piece of time."""

    def rows(batches):
        for batch in batches:
            flag = lambda name: pc.fill_null(batch.column(name), False).to_numpy(zero_copy_only=False) if name in batch.schema.names else False
            t = batch.column("t").to_numpy(zero_copy_only=False).astype(np.float64)
            code = (flag("on_enter") * ENTER + flag("on_exit") * EXIT + flag("on_trigger") * TRIGGER).astype(np.uint8)
            who = [batch.column(name).dictionary_encode(null_encoding="encode") for name in ("log_id", "function")]
            ids = [x.indices.to_numpy() for x in who]
            order = np.lexsort((code, t, *ids))
            t, code, ids = t[order], code[order], [x[order] for x in ids]
            parts = [*ids, np.floor((t + AHEAD) * 1000) // _width(piece)] if piece else ids
            cuts = [0, *(np.flatnonzero(sum(np.diff(x) != 0 for x in parts)) + 1).tolist(), len(t)] if len(t) else [0]
            found = [(*(x.dictionary[i[a]].as_py() for x, i in zip(who, ids)), t[a], t[b - 1], t[a:b].tobytes() + code[a:b].tobytes()) for a, b in zip(cuts, cuts[1:])]
            types = pa.string(), pa.string(), pa.float64(), pa.float64(), pa.binary()
            yield pa.record_batch([pa.array(x, kind) for x, kind in zip(zip(*found) if found else [()] * 5, types)], ["log_id", "function", "first", "last", "pack"])

    return steps.mapInArrow(rows, "log_id string, function string, first double, last double, pack binary")


def machines_of(frames: DataFrame, catalog: Catalog, functions: list[Machine], late: str = "2 seconds", piece: float = 1.0) -> DataFrame:
    """(log_id, function, type, t, since) from a stream of frames: enters, exits (with when the machine was entered, so that
    they are intervals too) and blocked attempts, the same as machines.run() finds in the log at rest."""
    initial = frozenset(m.id for m in functions if m.initial)
    return machine_events(machine_steps(frames, catalog, functions, late, piece).where("on_enter or on_exit or on_trigger"), initial, piece)


def machine_events(steps: DataFrame, initial: frozenset[str] = frozenset(), piece: float | None = None) -> DataFrame:
    """(log_id, function, type, t, since) from a stream of steps (log_id, function, t, on_enter, on_exit[, on_trigger]): enters,
    exits and blocked attempts. Steps that come in order of pieces of time, of so many seconds, are packed by these."""
    kept = [c for c in ("log_id", "function", "t", "on_enter", "on_exit", "on_trigger") if c in steps.columns]
    return _step_packs(steps.select(*kept), piece).groupBy("log_id", "function").transformWithStateInPandas(Latch(initial), "log_id string, function string, type string, t double, since double", "Append", "None")
