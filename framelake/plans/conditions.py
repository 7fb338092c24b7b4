"""Conditions of function specs: checked, and compiled to column expressions over held signals.

A leaf compares a signal ({signal, op, value}) or asks for an edge ({rising|falling|changed: signal}); {all: [...]},
{any: [...]} and {not: ...} combine. Values are compared as numbers where both look like numbers; else == and != compare
texts, and orderings compare texts too. A signal without data compares as the text "None" (so > and >= of a number hold
then); null_is_false makes every comparison without data false instead.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from framelake.plans.catalog import Catalog, SchemaError, Signal

OPERATORS = (">", "<", ">=", "<=", "==", "!=")
EDGES = ("rising", "falling", "changed")
# Texts that count as false.
FALSE_TEXTS = ("", "0", "0.0", "false", "off", "no", "none", "null", "idle", "inactive", "disabled", "standby", "0x0", "0x00")


def normalised(condition: Any) -> dict:
    """The condition with defaults filled in; raises SchemaError where it isn't one."""
    if not isinstance(condition, dict):
        raise SchemaError(f"a condition must be a mapping, not {condition!r}")
    for edge in EDGES:
        if edge in condition:
            return {edge: str(condition[edge])}
    if "signal" in condition:
        op = condition.get("op", "==")
        if op not in OPERATORS:
            raise SchemaError(f"unknown operator {op!r}")
        if "value" not in condition:
            raise SchemaError(f"the comparison of {condition['signal']!r} has no value")
        return {"signal": str(condition["signal"]), "op": op, "value": condition["value"]}
    for kind in ("all", "any"):
        if kind in condition:
            inner = condition[kind]
            if not isinstance(inner, list) or not inner:
                raise SchemaError(f"{kind} takes a list of conditions, at least one")
            return {kind: [normalised(c) for c in inner]}
    if "not" in condition:
        return {"not": normalised(condition["not"])}
    raise SchemaError(f"no condition: {condition!r}")


def leaves(condition: dict) -> Iterator[dict]:
    """Leaves in the order in which they are written."""
    if "all" in condition or "any" in condition:
        for inner in condition.get("all") or condition.get("any"):
            yield from leaves(inner)
    elif "not" in condition:
        yield from leaves(condition["not"])
    else:
        yield condition


def signals_of(condition: dict) -> list[str]:
    return list(dict.fromkeys(leaf.get("signal") or next(leaf[e] for e in EDGES if e in leaf) for leaf in leaves(condition)))


def edges_of(condition: dict) -> list[dict]:
    return [leaf for leaf in leaves(condition) if "signal" not in leaf]


def default_trigger(enter: dict) -> dict | None:
    """Any edge of the enter condition; without edges nothing counts as an attempt."""
    edges = edges_of(enter)
    return None if not edges else edges[0] if len(edges) == 1 else {"any": edges}


def as_number(value: Any) -> int | float | None:
    """The number that a value is or that its text spells (0x for hexadecimal), else None."""
    if isinstance(value, (bool, int, float)):
        return value
    text = str(value).strip()
    if re.fullmatch(r"0[xX][0-9a-fA-F]+", text):
        return int(text, 16)
    try:
        return int(text)
    except ValueError:
        try:
            return float(text)
        except ValueError:
            return None


def holds(a: Any, op: str, b: Any) -> bool:
    """Compares two plain values by the rules above; used while planning, for labels and for missing data."""
    x, y = as_number(a) if a is not None else None, as_number(b) if b is not None else None
    if x is None or y is None:
        x, y = (str(a).strip() if isinstance(a, str) else str(a)), (str(b).strip() if isinstance(b, str) else str(b))
        if a is not None and as_number(a) is not None:
            x = str(as_number(a))
        if b is not None and as_number(b) is not None:
            y = str(as_number(b))
    return {">": x > y, "<": x < y, ">=": x >= y, "<=": x <= y, "==": x == y, "!=": x != y}[op] if type(x) is type(y) or not isinstance(x, str) else False


def _compare(value: Column, op: str, bound: Column) -> Column:
    return {">": value > bound, "<": value < bound, ">=": value >= bound, "<=": value <= bound, "==": value == bound, "!=": value != bound}[op]


def _shown(number: Column, signal: Signal | None) -> Column:
    """A number as text, integers without a point where the signal is integral."""
    return number.cast("long").cast("string") if signal is None or signal.integral else number.cast("string")


class Compiler:
    """Column expressions of conditions over columns cur_<signal> and prev_<signal> (structs raw, num, label)."""

    def __init__(self, catalog: Catalog, null_is_false: bool = False):
        self.catalog, self.null_is_false = catalog, null_is_false

    def signal(self, name: str) -> Signal | None:
        found = self.catalog.find(name)
        return found[1] if found else None

    def truthy(self, value: Column, name: str) -> Column:
        signal = self.signal(name)
        true_labels = [label for _, label in signal.choices if label.strip().lower() not in FALSE_TEXTS] if signal else []
        by_label = F.when(value["label"].isNotNull(), value["label"].isin(true_labels) if true_labels else F.lit(False))
        return F.coalesce(by_label.otherwise(value["num"] != 0), F.lit(False))

    def compare(self, leaf: dict) -> Column:
        name, op, bound = leaf["signal"], leaf["op"], leaf["value"]
        value, signal, number = F.col(f"cur_{name}"), self.signal(name), as_number(leaf["value"])
        missing = F.lit(False if self.null_is_false else holds(None, op, bound))
        if number is not None:
            plain = _compare(value["num"], op, F.lit(float(number)))
        else:
            plain = _compare(_shown(value["num"], signal), op, F.lit(str(bound).strip()))
        if signal and signal.choices:  # the comparison is made here, once for each label
            fitting = [label for _, label in signal.choices if holds(label, op, bound)]
            plain = F.when(value["label"].isNotNull(), value["label"].isin(fitting) if fitting else F.lit(False)).otherwise(plain)
        return F.when(value.isNull(), missing).otherwise(plain)

    def test(self, condition: dict) -> Column:
        """The condition's truth, never null."""
        if "signal" in condition:
            return self.compare(condition)
        if "all" in condition or "any" in condition:
            tests = [self.test(c) for c in condition.get("all") or condition.get("any")]
            out = tests[0]
            for one in tests[1:]:
                out = out & one if "all" in condition else out | one
            return out
        if "not" in condition:
            return ~self.test(condition["not"])
        edge = next(e for e in EDGES if e in condition)
        name = condition[edge]
        cur, prev = F.col(f"cur_{name}"), F.col(f"prev_{name}")
        if edge == "changed":
            shown = lambda v: F.struct(F.when(v["label"].isNull(), v["num"]).alias("n"), v["label"].alias("l"))
            return F.when(cur.isNull() | prev.isNull(), cur.isNotNull() | prev.isNotNull()).otherwise(~shown(cur).eqNullSafe(shown(prev)))
        now, before = self.truthy(cur, name), self.truthy(prev, name)
        return now & ~before if edge == "rising" else before & ~now

    def actual(self, name: str, which: str = "cur") -> Column:
        value = F.col(f"{which}_{name}")
        return F.coalesce(value["label"], _shown(value["num"], self.signal(name)))

    def margin(self, leaf: dict) -> Column:
        """Distance to the bound of an ordering, at least 0 where it holds; null for == and !=, texts and no data."""
        number = as_number(leaf["value"])
        if leaf["op"] in ("==", "!=") or number is None:
            return F.lit(None).cast("double")
        value = F.col(f"cur_{leaf['signal']}")
        gap = value["num"] - F.lit(float(number))
        return F.when(value["label"].isNull(), gap if leaf["op"] in (">", ">=") else -gap)

    def leaf(self, leaf: dict) -> Column:
        """Evidence of one leaf."""
        kind = "cmp" if "signal" in leaf else next(e for e in EDGES if e in leaf)
        name = leaf.get("signal") or leaf[kind]
        bound = F.lit(str(leaf["value"]) if kind == "cmp" else None).cast("string")
        op = F.lit(leaf.get("op")).cast("string")
        margin = self.margin(leaf) if kind == "cmp" else F.lit(None).cast("double")
        previous = F.lit(None).cast("string") if kind == "cmp" else self.actual(name, "prev")
        return F.struct(
            self.test(leaf).alias("ok"), F.lit(kind).alias("kind"), F.lit(name).alias("signal"), op.alias("op"), bound.alias("value"),
            self.actual(name).alias("actual"), previous.alias("previous"), margin.alias("margin"), F.lit(summary(leaf)).alias("text"),
        )

    def evidence(self, condition: dict) -> Column:
        """All leaves of a condition, in order."""
        return F.array(*(self.leaf(leaf) for leaf in leaves(condition)))

    def tree(self, condition: dict) -> Column:
        """The whole condition with the truth of every part, as JSON text; its shape is fixed by the condition."""

        def node(c: dict) -> Column:
            kind = next((k for k in ("all", "any", "not") if k in c), None)
            if kind is None:
                return self.leaf(c)
            inner = c[kind] if kind != "not" else [c["not"]]
            children = F.struct(*(node(x).alias(f"c{i}") for i, x in enumerate(inner)))
            return F.struct(self.test(c).alias("ok"), F.lit(kind).alias("kind"), children.alias("children"))

        return F.to_json(node(condition))


def summary(condition: dict) -> str:
    """A condition in words."""
    if "signal" in condition:
        return f"{condition['signal']} {condition['op']} {condition['value']}"
    for edge in EDGES:
        if edge in condition:
            return f"{condition[edge]} {edge}"
    if "not" in condition:
        return f"not ({summary(condition['not'])})"
    kind = "all" if "all" in condition else "any"
    return (" and " if kind == "all" else " or ").join(summary(c) for c in condition[kind])
