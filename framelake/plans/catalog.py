"""Schema of a bus: messages and their signals, read from schema text or built in code."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession


class SchemaError(ValueError):
    """A schema or spec that can't be used."""


@dataclass(frozen=True)
class Signal:
    name: str
    start: int
    length: int
    little_endian: bool = True
    signed: bool = False
    is_float: bool = False
    scale: float = 1.0
    offset: float = 0.0
    minimum: float | None = None
    maximum: float | None = None
    unit: str = ""
    choices: tuple[tuple[int, str], ...] = ()
    selector: bool = False
    selected_by: int | None = None
    comment: str = ""
    multiplexer: str | None = None  # the selector's name, where it isn't the message's own
    ranges: tuple[tuple[int, int], ...] = ()  # its raw values, where they are more than selected_by
    receivers: tuple[str, ...] = ()

    @property
    def integral(self) -> bool:
        """Whether scaled values are integers."""
        return not self.is_float and float(self.scale).is_integer() and float(self.offset).is_integer()


@dataclass(frozen=True)
class Message:
    frame_id: int
    name: str
    length: int
    signals: tuple[Signal, ...] = ()
    senders: tuple[str, ...] = ()
    extended: bool = False
    cycle_ms: float | None = None
    comment: str = ""

    @property
    def selector(self) -> Signal | None:
        """The selector that no other selects, else the first."""
        found = [s for s in self.signals if s.selector]
        return next((s for s in found if s.selected_by is None and not s.ranges), found[0] if found else None)

    def conditions(self, signal: Signal) -> list[tuple[Signal, tuple[tuple[int, int], ...]]]:
        """(selector, its raw values as inclusive ranges) that a frame must have to carry the signal: of its own selector, of
        the one that selects that, and so on."""
        chain: list = []
        while (ranges := signal.ranges or (((signal.selected_by, signal.selected_by),) if signal.selected_by is not None else ())):
            over = next((s for s in self.signals if s.name == signal.multiplexer), None) if signal.multiplexer else self.selector
            if over is None or over is signal or any(over is s for s, _ in chain):
                break
            chain.append((over, ranges))
            signal = over
        return chain


@dataclass(frozen=True)
class Catalog:
    messages: tuple[Message, ...] = ()
    nodes: tuple[str, ...] = field(default=())

    def message(self, frame_id: int) -> Message | None:
        return next((m for m in self.messages if m.frame_id == frame_id), None)

    def find(self, name: str) -> tuple[Message, Signal] | None:
        """Owner and signal; a name that several messages have belongs to the last of them."""
        return next(((m, s) for m in reversed(self.messages) for s in m.signals if s.name == name), None)

    def names(self) -> list[str]:
        return sorted({s.name for m in self.messages for s in m.signals})

    def message_table(self, spark: SparkSession) -> DataFrame:
        rows = [(m.frame_id, m.name, m.length, list(m.senders), m.extended, m.cycle_ms, m.comment) for m in self.messages]
        return spark.createDataFrame(rows, "frame_id long, name string, length int, senders array<string>, is_extended boolean, cycle_time_ms double, comment string")

    def signal_table(self, spark: SparkSession) -> DataFrame:
        rows = [
            (m.frame_id, s.name, s.start, s.length, "little" if s.little_endian else "big", s.signed, s.is_float, float(s.scale), float(s.offset), s.minimum, s.maximum, s.unit, dict(s.choices), s.selector, s.selected_by, s.comment)
            for m in self.messages
            for s in m.signals
        ]
        return spark.createDataFrame(
            rows,
            "message_id long, name string, start_bit int, length int, byte_order string, is_signed boolean, is_float boolean, scale double, offset double,"
            " minimum double, maximum double, unit string, choices map<long,string>, is_selector boolean, selected_by int, comment string",
        )


_MESSAGE = re.compile(r"^BO_\s+(\d+)\s+(\w+)\s*:\s*(\d+)\s+(\w+)")
_SIGNAL = re.compile(r'^\s*SG_\s+(\w+)\s*(M|m\d+M?)?\s*:\s*(\d+)\|(\d+)@([01])([+-])\s*\(([^,]+),([^)]+)\)\s*\[([^|]*)\|([^\]]*)\]\s*"([^"]*)"\s*(.*)$')
_CHOICES = re.compile(r"^VAL_\s+(\d+)\s+(\w+)\s+(.*);\s*$")
_CYCLE = re.compile(r'^BA_\s+"GenMsgCycleTime"\s+BO_\s+(\d+)\s+([-\d.eE+]+)\s*;')
_CYCLE_DEFAULT = re.compile(r'^BA_DEF_DEF_\s+"GenMsgCycleTime"\s+([-\d.eE+]+)\s*;')
_FLOAT = re.compile(r"^SIG_VALTYPE_\s+(\d+)\s+(\w+)\s*:?\s*([12])\s*;")
_MULTIPLEXED = re.compile(r"^SG_MUL_VAL_\s+(\d+)\s+(\w+)\s+(\w+)\s+(.*?);")
_COMMENT = re.compile(r'CM_\s+(BO_\s+(\d+)|SG_\s+(\d+)\s+(\w+))\s+"([^"]*)"\s*;')
_NODES = re.compile(r"^BU_\s*:\s*(.*)$")
_SENDERS = re.compile(r"^BO_TX_BU_\s+(\d+)\s*:\s*(.*);")


def _number(text: str) -> float | None:
    try:
        return float(text)
    except ValueError:
        return None


def parse_dbc(text: str) -> Catalog:
    """A catalog from schema text: messages, signals, value names, cycle times, float types, multiplexers, comments.

    Extended ids carry bit 31; a scale of 0 counts as 1; equal bounds mean none."""
    messages: dict[int, dict] = {}
    choices, floats, cycles, comments, senders, multiplexed = {}, set(), {}, {}, {}, {}
    nodes: tuple[str, ...] = ()
    now = None
    for line in text.splitlines():
        if m := _MESSAGE.match(line):
            now = int(m[1])
            messages[now] = {"name": m[2], "length": int(m[3]), "sender": m[4], "signals": []}
        elif (m := _SIGNAL.match(line)) and now is not None:
            low, high = _number(m[9]), _number(m[10])
            mux = m[2] or ""
            messages[now]["signals"].append(
                Signal(m[1], int(m[3]), int(m[4]), m[5] == "1", m[6] == "-", False, _number(m[7]) or 1.0, _number(m[8]) or 0.0, *((low, high) if low != high else (None, None)),
                       unit=m[11], selector=mux.endswith("M"), selected_by=int(re.sub(r"\D", "", mux)) if mux.startswith("m") else None,
                       receivers=tuple(r for r in re.split(r"[,\s]+", m[12].strip()) if r and r != "Vector__XXX"))
            )
        elif m := _CHOICES.match(line):
            choices[int(m[1]), m[2]] = tuple((int(k), v) for k, v in re.findall(r'(-?\d+)\s+"([^"]*)"', m[3]))
        elif m := _CYCLE.match(line):
            cycles[int(m[1])] = float(m[2])
        elif m := _CYCLE_DEFAULT.match(line):
            cycles.setdefault(None, float(m[1]))
        elif m := _FLOAT.match(line):
            floats.add((int(m[1]), m[2]))
        elif m := _MULTIPLEXED.match(line):
            multiplexed[int(m[1]), m[2]] = (m[3], tuple((int(a), int(b)) for a, b in re.findall(r"(\d+)\s*-\s*(\d+)", m[4])))
        elif m := _NODES.match(line):
            nodes = tuple(m[1].split())
        elif m := _SENDERS.match(line):
            senders[int(m[1])] = tuple(x for x in re.split(r"[,\s]+", m[2]) if x)
    for m in _COMMENT.finditer(text):
        comments[(int(m[2]), None) if m[2] else (int(m[3]), m[4])] = m[5]
    if not messages:
        raise SchemaError("the schema names no message")
    out = []
    for key, found in messages.items():
        signals = tuple(replace(s, choices=choices.get((key, s.name), ()), is_float=(key, s.name) in floats, comment=comments.get((key, s.name), ""), **dict(zip(("multiplexer", "ranges"), multiplexed.get((key, s.name), ())))) for s in found["signals"])
        from_ = tuple(dict.fromkeys(x for x in (found["sender"], *senders.get(key, ())) if x != "Vector__XXX"))
        cycle = cycles.get(key, cycles.get(None)) or None
        out.append(Message(key & 0x1FFFFFFF, found["name"], found["length"], signals, from_, bool(key >> 31), cycle, comments.get((key, None), "")))
    return Catalog(tuple(out), nodes)
