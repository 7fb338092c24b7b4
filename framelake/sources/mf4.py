"""Measurement files (MDF 4) with logged CAN frames, read by runs of data blocks.

Small blocks describe a file: data groups, their channel groups, and channels. The channels of a CAN_DataFrame say where id,
length, bytes and bus are in a record. Records lie in data blocks, plain or packed, of which a list knows the lengths. So
the reader plans ranges of records from the lists alone; a task unpacks the blocks that hold its records, wherever blocks
cut them. Groups whose records are mixed with others' (told apart by a number before each) are one range.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from framelake.plans.catalog import SchemaError
from framelake.sources.blf import _Blocks
from framelake.sources.frames import normalised
from framelake.sources.places import opened

# Layout of blocks, kinds of channels, data types, packing.
BLOCK_HEAD, FIRST_BLOCK = 24, 64
VARIABLE, MASTER, VIRTUAL_MASTER = 1, 2, 3
LITTLE_UINT, LITTLE_FLOAT = 0, 4
DEFLATE, TRANSPOSED = 0, 1
FD_LENGTHS = np.array([0, 1, 2, 3, 4, 5, 6, 7, 8, 12, 16, 20, 24, 32, 48, 64])
NAME = "CAN_DataFrame"

COLUMNS = "log_id string, seq long, t double, channel int, frame_id long, data binary"
_NAMES = [c.split()[0] for c in COLUMNS.split(", ")]
#: Bytes of records in a range, and records unpacked at a time.
SPLIT, STEP = 64 << 20, 100_000


@dataclass
class Channel:
    name: str
    kind: int
    data_type: int
    bit: int
    byte: int
    bits: int
    data: int  # where values of varying length are
    factor: tuple[float, float]  # offset and factor of a linear conversion

    def numbers(self, records: np.ndarray) -> np.ndarray:
        """Values of records, a row of bytes each."""
        if self.kind == VIRTUAL_MASTER:
            raise SchemaError("times that are record numbers aren't supported")
        count = (self.bit + self.bits + 7) // 8
        raw = np.ascontiguousarray(records[:, self.byte : self.byte + count])
        if self.data_type == LITTLE_FLOAT:
            values = raw.view("<f8" if count == 8 else "<f4").ravel().astype(np.float64)
        elif self.data_type == LITTLE_UINT and count <= 8:
            whole = np.zeros((len(raw), 8), np.uint8)
            whole[:, :count] = raw
            values = (whole.view("<u8").ravel() >> np.uint64(self.bit)) & np.uint64((1 << self.bits) - 1)
        else:
            raise SchemaError(f"channel {self.name!r} has the data type {self.data_type}, which isn't supported")
        return values if self.factor == (0.0, 1.0) else values * self.factor[1] + self.factor[0]


@dataclass
class Raw:
    """What data blocks hold, as one run of bytes."""

    file: File
    blocks: list[tuple[int, int, int]] = field(default_factory=list)  # (first byte of the run, its bytes, place in the file)
    size: int = 0

    def add(self, size: int, at: int) -> None:
        self.blocks.append((self.size, size, at))
        self.size += size

    def read(self, a: int, b: int) -> bytes:
        return b"".join(self.file.content(at)[max(0, a - first) : b - first] for first, size, at in self.blocks if first < b and first + size > a)


@dataclass
class Group:
    """A channel group with CAN frames: its data, and where in a record what is."""

    raw: Raw
    id_size: int
    record_id: int
    sizes: dict[int, int]  # record number -> bytes, of all groups in the same data
    length: int
    channels: dict[str, Channel]


class File:
    def __init__(self, read, size: int):
        self.read, self.size = read, size
        if self.read(0, 8)[:3] != b"MDF" or self.read(8, 1) != b"4":
            raise SchemaError("not a measurement file of version 4")

    def block(self, at: int, kind: str) -> tuple[list[int], bytes]:
        """(links, data) of the block at a place, which must be of the kind."""
        name, length, links = struct.unpack("<4s4xQQ", self.read(at, BLOCK_HEAD))
        if name.decode("latin-1") != f"##{kind}" or length < BLOCK_HEAD + 8 * links:
            raise SchemaError(f"no block ##{kind} at byte {at}")
        body = self.read(at + BLOCK_HEAD, length - BLOCK_HEAD)
        return list(struct.unpack_from(f"<{links}Q", body)), body[8 * links :]

    def kind(self, at: int) -> str:
        return self.read(at, 4)[2:].decode("latin-1")

    def text(self, at: int) -> str:
        return self.block(at, self.kind(at))[1].split(b"\0")[0].decode("utf-8", "replace") if at else ""

    def _factor(self, at: int) -> tuple[float, float]:
        if not at:
            return 0.0, 1.0
        _, data = self.block(at, "CC")
        kind, values = data[0], struct.unpack_from("<H", data, 6)[0]
        if kind == 0:
            return 0.0, 1.0
        if kind == 1 and values >= 2:
            return struct.unpack_from("<2d", data, 24)
        raise SchemaError(f"a conversion of type {kind} isn't supported")

    def _channels(self, at: int) -> Iterator[Channel]:
        while at:
            links, data = self.block(at, "CN")
            kind, _, data_type, bit, byte, bits = struct.unpack_from("<BBBBII", data)
            name = self.text(links[2])
            wanted = name.startswith(NAME) or kind in (MASTER, VIRTUAL_MASTER)
            yield Channel(name, kind, data_type, bit, byte, bits, links[5], self._factor(links[4]) if wanted and name != NAME else (0.0, 1.0))
            if links[1] and self.kind(links[1]) == "CN":
                yield from self._channels(links[1])
            at = links[0]

    def groups(self) -> Iterator[Group]:
        """All groups with the parts of a CAN_DataFrame."""
        at = self.block(FIRST_BLOCK, "HD")[0][0]
        while at:
            (at, first, data, *_), about = self.block(at, "DG")
            raw, found, sizes = Raw(self), [], {}
            while first:
                links, said = self.block(first, "CG")
                number, _, flags, _, _, length, invalid = struct.unpack_from("<QQHHIII", said)
                sizes[number] = 0 if flags & 1 else length + invalid  # flag 1: each record tells its own length
                found.append((number, length + invalid, {c.name or "time": c for c in self._channels(links[1])}))
                first = links[0]
            for number, length, channels in found:
                if {f"{NAME}.ID", f"{NAME}.DataBytes"} <= set(channels):
                    if not raw.blocks and data:
                        self.gather(raw, data)
                    yield Group(raw, about[0], number, sizes, length, channels)

    def gather(self, raw: Raw, at: int) -> None:
        """Puts the data blocks at a place, or in the list there, into raw; blocks are only looked at."""
        kind = self.kind(at)
        if kind in ("DT", "SD", "DV", "RD"):
            raw.add(struct.unpack("<Q", self.read(at + 8, 8))[0] - BLOCK_HEAD, at)
        elif kind == "DZ":
            raw.add(struct.unpack("<Q", self.read(at + BLOCK_HEAD + 8, 8))[0], at)
        elif kind == "HL":
            self.gather(raw, self.block(at, "HL")[0][0])
        elif kind == "DL":
            while at:
                links, _ = self.block(at, "DL")
                for one in links[1:]:
                    self.gather(raw, one)
                at = links[0]
        else:
            raise SchemaError(f"data in a block ##{kind} aren't supported")

    def content(self, at: int) -> bytes:
        """The bytes of a data block, unpacked."""
        length = struct.unpack("<Q", self.read(at + 8, 8))[0]
        body = self.read(at + BLOCK_HEAD, length - BLOCK_HEAD)
        if self.kind(at) != "DZ":
            return body
        method, width, size, packed = struct.unpack_from("<2xBxIQQ", body)
        if method not in (DEFLATE, TRANSPOSED):
            raise SchemaError(f"the block at byte {at} is packed in an unknown way ({method})")
        plain = zlib.decompress(body[24 : 24 + packed])
        if method == TRANSPOSED and width > 1:  # whole rows were written column by column
            rows = len(plain) // width
            head = np.frombuffer(plain, np.uint8, rows * width).reshape(width, rows).T
            plain = head.tobytes() + plain[rows * width :]
        if len(plain) != size:
            raise SchemaError(f"the block at byte {at} has {len(plain)} bytes instead of {size}")
        return plain

    def varying(self, channel: Channel, at: np.ndarray) -> list[bytes]:
        """Values of varying length at some places of a channel's own data, of which only what is needed is unpacked."""
        raw = Raw(self)
        self.gather(raw, channel.data)
        if not len(at):
            return []
        low, last = int(at.min()), int(at.max())
        high = last + 4 + struct.unpack("<I", raw.read(last, last + 4))[0]
        held = raw.read(low, high)
        sizes = [struct.unpack_from("<I", held, a - low)[0] for a in at.tolist()]
        return [held[a - low + 4 : a - low + 4 + n] for a, n in zip(at.tolist(), sizes)]


def _payloads(file: File, group: Group, records: np.ndarray) -> list[bytes]:
    channels = group.channels
    where, length, code = channels[f"{NAME}.DataBytes"], channels.get(f"{NAME}.DataLength"), channels.get(f"{NAME}.DLC")
    if length is not None:
        sizes = length.numbers(records).astype(np.int64)
    elif code is not None:
        sizes = FD_LENGTHS[code.numbers(records).astype(np.int64) & 15]
    else:
        sizes = np.full(len(records), 64)
    if where.kind == VARIABLE:
        place = Channel(where.name, 0, LITTLE_UINT, where.bit, where.byte, where.bits, 0, (0.0, 1.0)).numbers(records).astype(np.int64)
        return [b[:n] for b, n in zip(file.varying(where, place), sizes.tolist())]
    width = where.bits // 8
    whole = np.ascontiguousarray(records[:, where.byte : where.byte + width]).tobytes()
    return [whole[k * width : k * width + n] for k, n in enumerate(np.minimum(sizes, width).tolist())]


def frames_in(file: File, group: Group, records: np.ndarray, seq: int, name: str) -> pa.RecordBatch:
    channels = group.channels
    master = next((c for c in channels.values() if c.kind in (MASTER, VIRTUAL_MASTER)), None)
    if master is None:
        raise SchemaError("a group of frames has no times")
    t = master.numbers(records).astype(np.float64)
    ids = channels[f"{NAME}.ID"].numbers(records).astype(np.int64) & 0x1FFFFFFF
    bus = channels[f"{NAME}.BusChannel"].numbers(records).astype(np.int32) if f"{NAME}.BusChannel" in channels else np.zeros(len(records), np.int32)
    columns = [pa.repeat(pa.scalar(name), len(records)), pa.array(seq + np.arange(len(records))), pa.array(t), pa.array(bus), pa.array(ids), pa.array(_payloads(file, group, records), pa.binary())]
    return pa.record_batch(columns, _NAMES)


def _mixed(group: Group) -> Iterator[np.ndarray]:
    """Records of the group out of data in which several groups' are mixed, a block's bytes at a time."""
    rest, head = b"", group.id_size
    for _, _, at in group.raw.blocks:
        data, place, out = rest + group.raw.file.content(at), 0, []
        while place + head <= len(data):
            number = int.from_bytes(data[place : place + head], "little")
            if number not in group.sizes:
                raise SchemaError(f"a record has the unknown number {number}")
            size = group.sizes[number]
            if not size:
                if place + head + 4 > len(data):
                    break
                size = 4 + struct.unpack_from("<I", data, place + head)[0]
            if place + head + size > len(data):
                break
            if number == group.record_id:
                out.append(data[place + head : place + head + size])
            place += head + size
        rest = data[place:]
        if out:
            yield np.frombuffer(b"".join(out), np.uint8).reshape(len(out), group.length)


def group_frames(file: File, number: int, group: Group, begin: int, end: int, name: str) -> Iterator[pa.RecordBatch]:
    """Frames of the records from `begin` to before `end` of a file's group (the number-th)."""
    base = number << 48
    if group.id_size:
        seq = base
        for records in _mixed(group):
            yield frames_in(file, group, records, seq, name)
            seq += len(records)
        return
    for a in range(begin, end, STEP):
        b = min(a + STEP, end)
        data = group.raw.read(a * group.length, b * group.length)
        yield frames_in(file, group, np.frombuffer(data, np.uint8).reshape(b - a, group.length), base + a, name)


@dataclass
class Records(InputPartition):
    path: str
    group: int
    begin: int
    end: int


class Reader(DataSourceReader):
    def __init__(self, path: str, split: int):
        self.path, self.split = path, split

    def partitions(self) -> list[Records]:
        from pyarrow import fs

        system, path = opened(self.path)
        about = system.get_file_info(path)
        files = [about] if about.type == fs.FileType.File else system.get_file_info(fs.FileSelector(path, recursive=True))
        out = []
        for one in sorted((f for f in files if f.type == fs.FileType.File and (f is about or f.path.lower().endswith(".mf4"))), key=lambda f: f.path):
            with system.open_input_file(one.path) as source:
                groups = list(File(_Blocks(source, 1 << 16).read, source.size()).groups())
            if not groups:
                raise SchemaError(f"{one.path.rsplit('/', 1)[-1]} has no channels of {NAME}")
            for k, group in enumerate(groups):
                n = 1 if group.id_size else group.raw.size // max(1, group.length)
                step = n if group.id_size else max(1, self.split // max(1, group.length))
                out += [Records(one.path, k, a, min(a + step, n)) for a in range(0, n, max(1, step))]
        return out or [Records("", 0, 0, 0)]

    def read(self, partition: Records) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        system, _ = opened(self.path)
        with system.open_input_file(partition.path) as source:
            file = File(_Blocks(source).read, source.size())
            group = list(file.groups())[partition.group]
            yield from group_frames(file, partition.group, group, partition.begin, partition.end, partition.path.rsplit("/", 1)[-1])


class Measurements(DataSource):
    """spark.read.format("framelake_mf4").option("split", bytes).load(path)"""

    @classmethod
    def name(cls) -> str:
        return "framelake_mf4"

    def schema(self) -> str:
        return COLUMNS

    def reader(self, schema) -> DataSourceReader:
        return Reader(self.options["path"], int(self.options.get("split", SPLIT)))


def read(spark: SparkSession, path: str, split: int = SPLIT) -> DataFrame:
    """Frames of all measurement files under a path; each file is a log, in several tasks where it has more than `split` bytes of
    records. Times count from the file's start."""
    spark.dataSource.register(Measurements)
    return normalised(spark.read.format("framelake_mf4").option("split", split).load(path))


# --- writing -------------------------------------------------------------------------------------------------------


class Builder:
    """Bytes of a measurement file, block by block; links are places of blocks that are there already."""

    def __init__(self):
        self.out = bytearray(b"MDF     4.10    framelk ".ljust(28, b"\0") + struct.pack("<H", 410)).ljust(FIRST_BLOCK, b"\0")
        self.out += bytes(BLOCK_HEAD + 8 * 6 + 32)  # the head, filled in at the end

    @staticmethod
    def packed(kind: str, links: list[int], data: bytes) -> bytes:
        whole = struct.pack(f"<4s4xQQ{len(links)}Q", f"##{kind}".encode(), BLOCK_HEAD + 8 * len(links) + len(data), len(links), *links) + data
        return whole + bytes(-len(whole) % 8)

    def block(self, kind: str, links: list[int], data: bytes = b"") -> int:
        at = len(self.out)
        self.out += self.packed(kind, links, data)
        return at

    def text(self, text: str) -> int:
        return self.block("TX", [], text.encode() + b"\0")

    def channel(self, name: str, kind: int, data_type: int, byte: int, bits: int, after: int = 0, inner: int = 0, data: int = 0, bit: int = 0, conversion: int = 0) -> int:
        about = struct.pack("<BBBBIIIIBBHdddddd", kind, int(kind == MASTER), data_type, bit, byte, bits, 0, 0, 0, 0, 0, *[0.0] * 6)
        return self.block("CN", [after, inner, self.text(name), 0, conversion, data, 0, 0], about)

    def frame_channels(self, width: int) -> int:
        """Channels of records (time, bus, id, length, bytes)."""
        parts, at = [("DataBytes", 10, 15, 8 * width), ("DataLength", LITTLE_UINT, 13, 16), ("ID", LITTLE_UINT, 9, 32), ("BusChannel", LITTLE_UINT, 8, 8)], 0
        for name, kind, byte, bits in parts:
            at = self.channel(f"{NAME}.{name}", 0, kind, byte, bits, at)
        whole = self.channel(NAME, 0, 10, 8, 8 * (7 + width), 0, at)
        return self.channel("t", MASTER, LITTLE_FLOAT, 0, 64, whole)

    def group(self, first: int, length: int, records: int, after: int = 0, number: int = 0, flags: int = 0) -> int:
        return self.block("CG", [after, first, 0, 0, 0, 0], struct.pack("<QQHHIII", number, records, flags, 0, 0, length, 0))

    def zipped(self, content: bytes, width: int = 0) -> int:
        """A packed data block; with a width, its rows are written column by column."""
        rows = len(content) // width if width else 0
        plain = np.frombuffer(content, np.uint8, rows * width).reshape(rows, width).T.tobytes() + content[rows * width :] if rows else content
        body = zlib.compress(plain, 1)
        return self.block("DZ", [], struct.pack("<2sBxIQQ", b"DT", TRANSPOSED if rows else DEFLATE, width, len(content), len(body)) + body)

    def listed(self, blocks: list[int], sizes: list[int]) -> int:
        places = np.cumsum([0, *sizes[:-1]]).tolist()
        at = self.block("DL", [0, *blocks], struct.pack(f"<B3xI{len(blocks)}Q", 0, len(blocks), *places))
        return self.block("HL", [at], struct.pack("<HB5x", 0, TRANSPOSED))

    def finished(self, groups: list[tuple[int, int, int]]) -> bytes:
        """The file with data groups (first channel group, data, bytes of a record's number)."""
        at = 0
        for first, data, id_size in reversed(groups):
            at = self.block("DG", [at, first, data, 0], struct.pack("<B7x", id_size))
        head = self.packed("HD", [at, 0, 0, 0, 0, 0], bytes(32))
        self.out[FIRST_BLOCK : FIRST_BLOCK + len(head)] = head
        return bytes(self.out)


def record(t: float, channel: int, frame_id: int, data: bytes, width: int = 64) -> bytes:
    return struct.pack("<dBIH", t, channel, frame_id, len(data)) + data.ljust(width, b"\0")


def write(frames: DataFrame, folder: str, block: int = 1 << 20) -> DataFrame:
    """Writes the data frames of each of Spark's partitions, in their order, to a measurement file of its own, whose records
    are packed in blocks of about `block` bytes. Gives (path, frames); run it once, as an action. A partition's file is
    put together in memory, so partitions should be some hundred megabytes at most."""

    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        system, path = opened(folder)
        system.create_dir(path, recursive=True)
        context = TaskContext.get()
        out, rest, blocks, sizes, n = Builder(), b"", [], [], 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                rest, n = rest + record(*row), n + 1
                if len(rest) >= block:
                    blocks.append(out.zipped(rest, 79)), sizes.append(len(rest))
                    rest = b""
        if not n:
            return
        if rest:
            blocks.append(out.zipped(rest, 79)), sizes.append(len(rest))
        data = out.listed(blocks, sizes)
        whole = out.finished([(out.group(out.frame_channels(64), 79, n), data, 0)])
        name = f"{path}/part-{context.partitionId():05d}.mf4"
        with system.open_output_stream(f"{name}.{context.taskAttemptId()}") as sink:
            sink.write(whole)
        system.move(f"{name}.{context.taskAttemptId()}", name)
        yield pa.record_batch([pa.array([name]), pa.array([n])], ["path", "frames"])

    rows = frames.where("kind = 'data'").select("t", "channel", "frame_id", "data")
    return rows.mapInArrow(files, "path string, frames long")
