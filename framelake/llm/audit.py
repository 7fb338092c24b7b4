"""Interaction of filters: what each filter removes, in every order of them, from a packed bitmap index.

Each task sorts a batch's rows by part, so that a part's bitset is a run of 64-bit words, and packs one bitset for each
filter and label. For each set of filters, what is left after them is the AND-NOT of what is left after one fewer; its
popcounts, whole and within good and toxic rows, are added up over all tasks. Every order's steps follow from those sums.
"""

from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.llm.common import WORD, dropped, looked_up, staged

LETTERS = "ABCDE"
#: Parts whose sums a task holds before it hands them on.
PARTS = 4096


def text_filters(text: Column) -> dict[str, Column]:
    """Filter -> whether the text fails it: few words, few distinct ones, many capitals, signs. Null counts as empty."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]", ""))
    return {
        "A": F.size(words) < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        "C": 100 * capitals > 3 * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def index(docs: DataFrame, labels: DataFrame, paths: list[str]) -> DataFrame:
    """Staged (part, fails int, good boolean, toxic boolean), one row for each document: fails has bit k for filter k.

    A text is a copy if a smaller doc_id has the same (by SHA-256); null ids are neither smaller nor larger than others and
    have no labels. Of several labels of an id, any 1 counts. Texts are read once; a text or an id that a third of all
    documents have makes no large task."""
    text = F.coalesce("text", F.lit(""))
    failed = sum((F.coalesce(f, F.lit(False)).cast("int") * (1 << k) for k, f in enumerate(text_filters(text).values())), F.lit(0))
    rows = staged(docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), failed.alias("fails"), F.unhex(F.sha2(text, 256)).alias("digest")), paths)
    copies = rows.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")).where("n > 1")
    marks = labels.groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"), F.lit(1).alias("n"))
    found = looked_up(looked_up(rows, staged(copies, paths), "digest"), staged(marks.where("doc_id is not null"), paths), "doc_id")
    copy = F.coalesce(F.col("doc_id") > F.col("first_id"), F.lit(False)).cast("int") * 16
    return staged(found.select("part", (F.col("fails") + copy).alias("fails"), *(F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic"))), paths)


def popcounts(parts: np.ndarray, fails: np.ndarray, marks: list[np.ndarray], filters: int) -> tuple[np.ndarray, np.ndarray]:
    """(parts in order, counts[part, set of filters, all or one of marks]): rows that pass all filters of the set."""
    names, code, sizes = np.unique(parts, return_inverse=True, return_counts=True)
    words = -(-sizes // 64)
    first = np.cumsum(words) - words
    order = np.argsort(code, kind="stable")
    place = np.empty(len(code), np.int64)
    place[order] = np.arange(len(code)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + 64 * np.repeat(first, sizes)

    def packed(flags: np.ndarray) -> np.ndarray:
        bits = np.zeros(64 * int(words.sum()), bool)
        bits[place] = flags
        return np.packbits(bits).view(np.uint64)

    failing = [packed((fails >> k) & 1 == 1) for k in range(filters)]
    within = [packed(m) for m in marks]
    left = [packed(np.ones(len(code), bool))]
    counts = np.zeros((len(names), 1 << filters, 1 + len(marks)), np.int64)
    for some in range(1 << filters):
        if some:
            top = some.bit_length() - 1
            left.append(left[some ^ (1 << top)] & ~failing[top])
        for k, bits in enumerate([left[some], *(left[some] & m for m in within)]):
            counts[:, some, k] = np.add.reduceat(np.bitwise_count(bits).astype(np.int64), first)
    return names, counts


def passing(rows: DataFrame, filters: int = len(LETTERS)) -> DataFrame:
    """(part, passed, left, good, toxic): rows of the part that pass all filters of the set `passed`, for all 2^filters sets."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}

        def flat():
            counts = np.stack(list(held.values())).reshape(-1, 3)
            names = [n for n in held for _ in range(1 << filters)]
            return pa.record_batch([pa.array(names), pa.array(np.tile(np.arange(1 << filters, dtype=np.int32), len(held))), *map(pa.array, counts.T.copy())], ["part", "passed", "left", "good", "toxic"])

        for batch in batches:
            if not len(batch):
                continue
            fails, good, toxic = (batch.column(k).to_numpy(zero_copy_only=False) for k in (1, 2, 3))
            names, counts = popcounts(np.array(batch.column(0).to_pylist(), object), fails, [good, toxic], filters)
            for name, one in zip(names.tolist(), counts):
                held[name] = held[name] + one if name in held else one
            if len(held) > PARTS:
                yield flat()
                held.clear()
        if held:
            yield flat()

    table = rows.select("part", "fails", "good", "toxic").mapInArrow(sums, "part string, passed int, left long, good long, toxic long")
    return table.groupBy("part", "passed").agg(*(F.sum(c).alias(c) for c in ("left", "good", "toxic")))


def steps(left: np.ndarray, good: np.ndarray, toxic: np.ndarray, letters: str = LETTERS) -> Iterator[tuple]:
    """(order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) for each order's steps, from the
    numbers of rows that pass each set of filters."""
    n, every = len(letters), (1 << len(letters)) - 1
    bit = {c: 1 << k for k, c in enumerate(letters)}
    shares = {c: 0 for c in letters}
    for c, b in bit.items():
        for before in (s for s in range(every + 1) if not s & b):
            size = before.bit_count()
            shares[c] += factorial(size) * factorial(n - 1 - size) * int(left[before] - left[before | b])
    for order in permutations(letters):
        before = 0
        for step, c in enumerate(order, 1):
            after = before | bit[c]
            removed = int(left[before] - left[after])
            alone = int(left[every ^ bit[c]] - left[every])
            yield "".join(order), step, int(left[after]), removed, int(left[0] - left[bit[c]]) - removed, alone, int(good[before] - good[after]), int(toxic[before] - toxic[after]), shares[c]
            before = after


def interactions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each part (language, null as empty), order of the five filters and step; no rows for an empty table.

    docs needs doc_id, text and lang, labels doc_id, quality and toxic; other columns don't matter. Each repeated row counts."""
    paths: list[str] = []
    sums = staged(passing(index(docs, labels, paths)).groupBy("part").agg(F.sort_array(F.collect_list(F.struct("passed", "left", "good", "toxic"))).alias("sets")))  # 32 sums a part
    dropped(docs.sparkSession, paths)
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]

    def reported(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, sets in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                columns = list(zip(*steps(*(np.array([s[c] for s in sets]) for c in ("left", "good", "toxic")))))
                kinds = [pa.string(), pa.int32(), *[pa.int64()] * len(names)]
                yield pa.record_batch([pa.array([part] * len(columns[0])), *(pa.array(c, k) for c, k in zip(columns, kinds))], ["part", "filter_order", "step", *names])

    return sums.mapInArrow(reported, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in names))
