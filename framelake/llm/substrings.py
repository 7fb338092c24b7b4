"""Substring deduplication: passages of a window of words or more that a document with a smaller id has too are cut.

Anchors are short word sequences, hashed only at the places of a difference cover: for any two places i and j there's a
shift below the period that puts both on the cover. So two equal windows, wherever they start, hold an anchor each
at the same shift. Anchors of several ids mark places; there all whole windows are hashed, to 128 bits, and each one
looks up the smallest id that has it. Nowhere are documents paired; a passage that many share is one row for each window
and task before any shuffle.

Words are split at ASCII white space and compared unchanged. Texts with the same words are one class, which is worked on
once: in it only rows with the smallest id keep words. Null texts have no words. A null id is neither smaller nor larger
than others: such rows lose nothing and take nothing. Rows with equal ids don't take words from one another.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.llm import tokens
from framelake.llm.common import dropped, few, looked_up, staged
from framelake.llm.jaccard import sliced, texts_of

WINDOW = 50
#: Perfect difference sets, by period: each difference modulo the period occurs.
COVERS = {1: (0,), 3: (0, 1), 7: (1, 2, 4), 13: (0, 1, 3, 9), 21: (3, 6, 7, 12, 14), 31: (1, 5, 11, 24, 25, 27)}
_ODD = np.uint64(0xD6E8FEB86659FD93)


def cover(window: int) -> tuple[int, np.ndarray, int]:
    """(period, places of the cover, words of an anchor): an anchor is at least a third of the window."""
    period = max(p for p in COVERS if p == 1 or 3 * (window - p + 1) >= window)
    return period, np.array(COVERS[period]), window - period + 1


def sequences(words: np.ndarray, size: int, seed: int) -> np.ndarray:
    """64-bit hashes of the `size` words from each place on; made of hashes of 1, 2, 4, ... words."""
    level, whole, done, span = tokens.mixed(words + np.uint64(seed)), None, 0, 1
    if len(words) < size:
        return np.zeros(0, np.uint64)
    while True:
        if size & span:
            piece = level[done:]
            whole = piece if whole is None else tokens.mixed(whole[: len(piece)] * _ODD + piece[: len(whole)])
            done += span
        if 2 * span > size:
            return whole[: len(words) - size + 1]
        level = tokens.mixed(level[:-span] * _ODD + level[span:])
        span *= 2


def anchor_hashes(texts: pa.Array, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words of each text, anchors of each text, all anchors' hashes); texts shorter than the window have no anchors."""
    period, places, size = cover(window)
    words, first = tokens.words(texts, lower=False)
    counts = np.diff(first)
    hashes = sequences(words, size, 1)
    place = np.arange(len(words)) - np.repeat(first[:-1], counts)
    sizes = np.repeat(counts, counts)
    on = np.isin(np.arange(period), places)[place % period] & (place + size <= sizes) & (sizes >= window)
    at = np.flatnonzero(on)
    return counts, np.diff(np.searchsorted(at, first)), hashes[at].view(np.int64)


def facts(docs: DataFrame, window: int, paths: list[str]) -> DataFrame:
    """Staged (doc_id, row_key, n_words, whole, anchors): whole is the SHA-256 of the words joined by one space."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, part in sliced(batch.column(2)):
                counts, sizes, hashes = anchor_hashes(part, window)
                whole = [hashlib.sha256(b" ".join((t or "").encode().split())).hexdigest() for t in part.to_pylist()]
                offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
                ids = [batch.column(k).slice(start, len(part)) for k in (0, 1)]
                yield pa.record_batch([*ids, pa.array(counts.astype(np.int64)), pa.array(whole), pa.ListArray.from_arrays(offsets, pa.array(hashes))], ["doc_id", "row_key", "n_words", "whole", "anchors"])

    kind = dict(docs.dtypes)["doc_id"]
    return staged(docs.select("doc_id", F.xxhash64("text"), "text").mapInArrow(rows, f"doc_id {kind}, row_key long, n_words long, whole string, anchors array<long>"), paths)


def _unpacked(blobs: pa.Array) -> list[bytes]:
    unpack = zstandard.ZstdDecompressor()
    return [unpack.decompress(b) for b in blobs.to_pylist()]


def candidate_starts(marks: list[int], n: int, window: int) -> np.ndarray:
    """Starts of the windows, in a text of n words, that hold one of the marked anchors whole."""
    period, places, size = cover(window)
    marks = np.unique(np.array(marks, np.int64))
    at = marks // len(places) * period + places[marks % len(places)]
    inside = np.zeros(n - window + 2, np.int64)
    np.add.at(inside, np.maximum(0, at - (window - size)), 1)
    np.add.at(inside, np.minimum(at, n - window) + 1, -1)
    return np.flatnonzero(np.cumsum(inside)[:-1])


def windows(marked: DataFrame, window: int) -> DataFrame:
    """(high, low, c, id, start) of the windows around the marked anchors of marked(c, id, marks, blob)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c, i, marks, blob in zip(batch.column(0), batch.column(1), batch.column(2), batch.column(3)):
                text = zstandard.ZstdDecompressor().decompress(blob.as_py()).decode()
                words, _ = tokens.words(pa.array([text]), lower=False)
                starts = candidate_starts(marks.as_py(), len(words), window)
                hashes = [sequences(words, window, seed)[starts].view(np.int64) for seed in (2, 3)]
                same = [pa.repeat(x, len(starts)) for x in (c, i)]
                yield pa.record_batch([*map(pa.array, hashes), *same, pa.array(starts.astype(np.int32))], ["high", "low", "c", "id", "start"])

    kind = dict(marked.dtypes)["id"]
    return marked.select("c", "id", "marks", "blob").mapInArrow(rows, f"high long, low long, c long, id {kind}, start int")


def _ranges(starts: list[int], window: int) -> list[tuple[int, int]]:
    """The words that windows from these starts cover, as (first, end)."""
    starts = np.unique(np.array(starts, np.int64))
    new = np.flatnonzero(np.append(True, np.diff(starts) > window))
    ends = np.append(starts[new[1:] - 1], starts[-1]) + window
    return list(zip(starts[new].tolist(), ends.tolist()))


def without(words: list, spans: list[tuple[int, int]]) -> list:
    """words outside the spans, which rise and don't overlap."""
    kept, done = [], 0
    for first, end in spans:
        kept += words[done:first]
        done = end
    return kept + words[done:]


def _cut(rows: DataFrame, window: int) -> DataFrame:
    """(c, spans, kept_sha256) of rows(c, starts, blob)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [_ranges(s, window) for s in batch.column(1).to_pylist()]
            kept = [hashlib.sha256(b" ".join(without(t.split(), s))).hexdigest() for t, s in zip(_unpacked(batch.column(2)), spans)]
            some = [[{"first": a, "end": b} for a, b in s] for s in spans]
            yield pa.record_batch([batch.column(0), pa.array(some, pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.string())], ["c", "spans", "kept_sha256"])

    return rows.select("c", "starts", "blob").mapInArrow(cut, "c long, spans array<struct<first:long,end:long>>, kept_sha256 string")


def repeated_spans(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Staged (doc_id, row_key, n_words, spans, kept_sha256), one row for each row of docs(doc_id, text): the removed words as
    rising, disjoint (first, end) and the SHA-256 of the others joined by one space. row_key is xxhash64 of the text."""
    spark, early, late = docs.sparkSession, [], []
    known = facts(docs, window, early)
    grouped = known.groupBy("whole").agg(
        F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "row_key"))).alias("row"), F.max("n_words").alias("n_words"), F.first("anchors").alias("anchors"), F.count("*").alias("n")
    )  # equal words have equal anchors
    classes = staged(grouped.select(F.monotonically_increasing_id().alias("c"), "whole", F.col("row.doc_id").alias("id"), F.col("row.row_key").alias("row_key"), "n_words", "n", "anchors"), early)
    names = staged(classes.drop("anchors"), late)
    rows = staged(known.drop("anchors"), late)
    occurring = classes.where(F.col("id").isNotNull()).select("c", "id", F.posexplode("anchors").alias("k", "anchor"))
    repeated = occurring.groupBy("anchor").agg(F.min("id").alias("least"), F.max("id").alias("most"), F.count("*").alias("n")).where("least < most")
    anchors = staged(repeated.select("anchor", F.lit(True).alias("repeated"), "n"), early)
    marks = staged(looked_up(occurring.drop("id"), anchors, "anchor").where("repeated").groupBy("c").agg(F.collect_list("k").alias("marks")), late)
    dropped(spark, early)
    wanted = names.join(marks.select("c"), "c").select("c", F.col("id").alias("doc_id"), "row_key")
    texts = texts_of(docs.select("doc_id", "text"), staged(wanted, late), late)
    marked = staged(names.select("c", "id").join(marks, "c").join(texts, "c"), late)
    found = windows(marked, window)
    owners = found.groupBy("high", "low").agg(F.min("id").alias("least"), F.max("id").alias("most"), F.count("*").alias("n")).where("least < most")
    owned = staged(owners.select(F.struct("high", "low").alias("hash"), "least", "n"), late)
    found = looked_up(found.select("c", "id", "start", F.struct("high", "low").alias("hash")), owned, "hash").where("least < id")
    removed = staged(found.groupBy("c").agg(F.collect_list("start").alias("starts")), late)
    cut = _cut(removed.join(texts, "c"), window)
    facts_of = names.select("whole", "id", "c", "n").join(cut, "c", "left").drop("c").where("n > 1 or spans is not null")
    each = looked_up(rows, staged(facts_of, late), "whole")
    copy = (F.col("doc_id") > F.col("id")) & (F.col("n_words") >= window)
    first = F.col("doc_id") == F.col("id")
    none = F.array().cast("array<struct<first:long,end:long>>")
    spans = F.when(copy, F.array(F.struct(F.lit(0).cast("long").alias("first"), F.col("n_words").alias("end")))).when(first, F.coalesce("spans", none)).otherwise(none)
    digest = F.when(copy, F.lit(hashlib.sha256(b"").hexdigest())).when(first, F.coalesce("kept_sha256", "whole")).otherwise(F.col("whole"))
    result = staged(each.select("doc_id", "row_key", "n_words", spans.alias("spans"), digest.alias("kept_sha256")))
    dropped(spark, late)
    return result


def removed_words(spans="spans"):
    """How many words the spans hold."""
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["first"])


def deduplicated(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs with the repeated words cut out of their texts, whose kept words are joined by one space; other texts, all columns
    and rows stay as they are."""
    cut = repeated_spans(docs, window).where(F.size("spans") > 0).select(F.col("doc_id").alias("__id"), F.col("row_key").alias("__key"), F.col("spans").alias("__spans")).dropDuplicates(["__id", "__key"])
    same = (docs["doc_id"] == F.col("__id")) & (F.xxhash64(docs["text"]) == F.col("__key"))
    joined = docs.join(F.broadcast(cut) if few(cut, 20_000) else cut, same, "left")
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    ends = F.transform("__spans", lambda s, k: F.slice(words, (F.when(k == 0, F.lit(0)).otherwise(F.col("__spans")[k - 1]["end"]) + 1).cast("int"), (s["first"] - F.when(k == 0, F.lit(0)).otherwise(F.col("__spans")[k - 1]["end"])).cast("int")))
    last = F.element_at("__spans", -1)["end"]
    kept = F.concat(F.flatten(ends), F.slice(words, (last + 1).cast("int"), F.greatest(F.lit(0), F.size(words) - last).cast("int")))
    return joined.withColumn("text", F.when(F.col("__spans").isNotNull(), F.array_join(kept, " ")).otherwise(F.col("text"))).select(*docs.columns)
