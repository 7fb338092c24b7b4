"""Byte-level BPE: encoding by way of a table of distinct words, decoding by way of the table of pieces.

Encoding splits texts into words in Spark, with the tokenizer's own pattern (added tokens come out first, whole). The
texts of a task are taken in blocks; a block holds its distinct words once, its texts as places in that list. Distinct
words are dealt by their hash, so that all blocks' copies of a word meet in one task, which encodes it once, and the ids
go back to the blocks, where places turn into ids. Texts themselves are shuffled once, as compressed word places.

Null texts count as empty and have no ids. Repeated rows are rows of their own; ids of any type (null too) are carried
along. Blocks are made twice, for their words and for their places, from the same files; a block whose words differ
between the two stops the job instead of giving wrong ids.
"""

import functools
import hashlib
import json
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.llm.common import shuffle_partitions

#: Fixed value: the pattern that byte-level tokenizers of this family split texts with.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words of a block, about; and how many groups of words each shuffle partition gets.
BLOCK_WORDS, GROUPS = 1_500_000, 2


class Files:
    """What the tokenizer's file says: vocabulary and added tokens."""

    def __init__(self, path: str):
        with open(path) as source:
            said = json.load(source)
        self.path, self.added = path, {a["content"]: a["id"] for a in said["added_tokens"]}
        self.size = max([*said["model"]["vocab"].values(), *self.added.values()]) + 1
        self.vocabulary = said["model"]["vocab"]

    def pieces(self) -> list[bytes]:
        """Bytes of every id: signs of the vocabulary stand for single bytes."""
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
        table = [b""] * self.size
        for piece, i in self.vocabulary.items():
            table[i] = bytes(byte_of[c] for c in piece)
        for content, i in self.added.items():
            table[i] = content.encode()
        return table


def split_words(text: Column, added: list[str]) -> Column:
    """The words of a text, in order; an added token is a word."""
    java = "(?U)" + PATTERN.replace(r"\S", r"[^\s]")
    words = lambda t: F.regexp_extract_all(t, F.lit(java), F.lit(0))
    text = F.coalesce(text, F.lit(""))
    if not added:
        return words(text)
    quoted = "|".join("\\Q" + a + "\\E" for a in added)
    around = F.split(text, f"(?={quoted})|(?<={quoted})")
    apart = F.flatten(F.transform(around, lambda t: F.when(t.isin(added), F.array(t)).otherwise(words(t))))
    return F.when(F.regexp_like(text, F.lit(quoted)), apart).otherwise(words(text))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, pa.Array, list[np.ndarray], list[pa.Array], list[np.ndarray]]]:
    """(name, distinct words, places, ids of rows, words of each row) of each block of a task's rows."""
    part, number = TaskContext.get().partitionId(), 0
    keys, sizes, chunks, total = [], [], [], 0

    def done():
        words = pa.concat_arrays(chunks).dictionary_encode()
        return f"{part}:{number}", words.dictionary, words.indices.to_numpy(), keys, np.concatenate(sizes)

    for batch in batches:
        lists = batch.column(1)
        at = 0
        while at < len(batch):
            offsets = lists.offsets.to_numpy()[at:]
            n = max(1, int(np.searchsorted(offsets, offsets[0] + BLOCK_WORDS - total, side="right")) - 1)
            some = lists.slice(at, n)
            keys.append(batch.column(0).slice(at, n)), sizes.append(np.diff(some.offsets.to_numpy())), chunks.append(some.flatten())
            total, at = total + len(chunks[-1]), at + n
            if total >= BLOCK_WORDS:
                yield done()
                number, keys, sizes, chunks, total = number + 1, [], [], [], 0
    if keys:
        yield done()


def _hash(words: pa.Array) -> np.ndarray:
    return pd.util.hash_array(np.asarray(words.to_pylist(), dtype=object), categorize=False) if len(words) else np.zeros(0, np.uint64)


def _digest(words: list[str]) -> bytes:
    return hashlib.blake2b("\0".join(words).encode(), digest_size=16).digest()


def _digests(words: pa.Array, sizes: np.ndarray) -> str:
    """One digest of the digests of all groups of a block's words, which are in order of their groups."""
    known, ends = words.to_pylist(), np.cumsum(sizes)
    return hashlib.blake2b(b"".join(_digest(known[b - n : b]) for b, n in zip(ends.tolist(), sizes.tolist())), digest_size=16).hexdigest()


def _packed(x: np.ndarray) -> bytes:
    """Non-negative integers below 2^32, each byte plane by itself, compressed; the first byte tells the number of planes."""
    most = int(x.max(initial=0))
    if most >= 1 << 32:
        raise ValueError(f"{most} is too large")
    planes = max(1, (most.bit_length() + 7) // 8)
    whole = np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :planes].T)
    return bytes([planes]) + zstandard.ZstdCompressor(level=1).compress(whole.tobytes())


def _unpacked(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[1:]), np.uint8).reshape(blob[0], -1)
    whole = np.zeros((planes.shape[1], 4), np.uint8)
    whole[:, : blob[0]] = planes.T
    return whole.reshape(-1).view("<u4")


def encode(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids array<int>) for each row of docs, as the tokenizers library encodes whole texts without special
    tokens."""
    spark = docs.sparkSession
    files = Files(tokenizer)
    kind = dict(docs.dtypes)[key]
    groups = GROUPS * shuffle_partitions(spark)
    rows = docs.select(F.col(key), split_words(F.col(text), list(files.added)).alias("words"))

    def distinct(batches):
        for name, words, *_ in _blocks(batches):
            if not len(words):
                continue
            group = (_hash(words) % np.uint64(groups)).astype(np.int64)
            order = np.argsort(group, kind="stable")
            some, starts = np.unique(group[order], return_index=True)
            lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(order)).astype(np.int32)), words.take(pa.array(order)))
            yield pa.record_batch([pa.array([name] * len(some)), pa.array(some), lists], ["block", "group", "words"])

    def places(batches):
        pack = zstandard.ZstdCompressor(level=1)
        for name, words, at, keys, sizes in _blocks(batches):
            often = np.argsort(-np.bincount(at, minlength=len(words)), kind="stable")  # frequent words get small numbers
            rank = np.empty(len(often), np.int64)
            rank[often] = np.arange(len(often))
            group = (_hash(words) % np.uint64(groups)).astype(np.int64)
            ids = pa.concat_arrays(keys)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, pa.schema([("key", ids.type)])) as stream:
                stream.write_batch(pa.record_batch([ids], ["key"]))
            by_group = np.argsort(group, kind="stable")
            spot = np.empty(len(by_group), np.int64)  # where the words' ids will be, once the groups are in order
            spot[by_group] = np.arange(len(by_group))
            yield pa.record_batch(
                [pa.array([name]), pa.array([_digests(words.take(pa.array(by_group)), np.unique(group, return_counts=True)[1])]), pa.array([pack.compress(sink.getvalue().to_pybytes())], pa.binary()), pa.array([_packed(sizes)], pa.binary()), pa.array([_packed(rank[at])], pa.binary()), pa.array([_packed(spot[often])], pa.binary())],
                ["block", "digest", "keys", "sizes", "ranks", "spots"],
            )

    def encoded(table: pa.Table) -> pa.Table:
        library = _library(tokenizer)
        lists = table.column("words").combine_chunks()
        words = lists.flatten().dictionary_encode()
        known = words.dictionary.to_pylist()
        ids = [e.ids for at in range(0, len(known), 20_000) for e in library.encode_batch_fast(known[at : at + 20_000], add_special_tokens=False)]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter((i for x in ids for i in x), np.int64, int(sizes.sum()))
        starts = np.cumsum(sizes) - sizes
        at, out = words.indices.to_numpy(), []
        offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        for a, b, one in zip(offsets[:-1], offsets[1:], lists):
            mine = at[a:b]
            out.append((_packed(sizes[mine]), _packed(flat[_spread(starts[mine], sizes[mine])]), _digest(one.as_py())))
        columns = [pa.array(c, pa.binary()) for c in zip(*out)]
        return pa.table([table.column("block"), table.column("group"), *columns], ["block", "group", "counts", "ids", "digest"])

    def assembled(batches):
        open_ = zstandard.ZstdDecompressor()
        for batch in batches:
            for row in (batch.slice(i, 1).to_pylist()[0] for i in range(len(batch))):
                parts = sorted(row["parts"] or [], key=lambda p: p["group"])
                counts = np.concatenate([_unpacked(p["counts"]) for p in parts] or [np.zeros(0, np.uint32)]).astype(np.int64)
                flat = np.concatenate([_unpacked(p["ids"]) for p in parts] or [np.zeros(0, np.uint32)])
                if hashlib.blake2b(b"".join(p["digest"] for p in parts), digest_size=16).hexdigest() != row["digest"]:
                    raise RuntimeError("a block's words changed between two reads of the same input")
                starts = np.cumsum(counts) - counts
                spots = _unpacked(row["spots"])
                ranks, sizes = _unpacked(row["ranks"]), _unpacked(row["sizes"]).astype(np.int64)
                keys = pa.ipc.open_stream(open_.decompress(row["keys"])).read_all().column(0).combine_chunks()
                ends = np.cumsum(sizes)
                for lo in range(0, len(sizes), 500):
                    hi = min(lo + 500, len(sizes))
                    words = spots[ranks[ends[lo] - sizes[lo] : ends[hi - 1]]]
                    many = counts[words]
                    tokens = flat[_spread(starts[words], many)].astype(np.int32)
                    upto = np.concatenate([[0], np.cumsum(many)])[np.concatenate([[0], np.cumsum(sizes[lo:hi])])]
                    yield pa.record_batch([keys.slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(upto.astype(np.int32)), pa.array(tokens))], [key, "ids"])

    words = rows.mapInArrow(distinct, "block string, group long, words array<string>")
    word_ids = words.groupBy("group").applyInArrow(encoded, "block string, group long, counts binary, ids binary, digest binary")
    parts = word_ids.groupBy("block").agg(F.collect_list(F.struct("group", "counts", "ids", "digest")).alias("parts"))
    blocks = rows.mapInArrow(places, "block string, digest string, keys binary, sizes binary, ranks binary, spots binary")
    return blocks.join(parts, "block", "left").mapInArrow(assembled, f"{key} {kind}, ids array<int>")


@functools.lru_cache(maxsize=1)
def _library(path: str):
    """The tokenizer, read once in each Python worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task per core; threads of the library only cost more
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    library.no_padding(), library.no_truncation()
    return library


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... sizes[0] of them, then those of starts[1], and so on."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


def decode(encoded: DataFrame, tokenizer: str, key: str = "doc_id") -> DataFrame:
    """(key, ids, text) for each row of encoded(key, ids): ids join the table of pieces (as many as the vocabulary has,
    so every task holds it), and the pieces of a row are put together in order. Bytes that aren't UTF-8 become U+FFFD;
    null ids give null."""
    pieces = encoded.sparkSession.sparkContext.broadcast(Files(tokenizer).pieces())

    def rows(batches):
        table = pa.array(pieces.value, pa.binary())
        for batch in batches:
            for lo in range(0, len(batch), 500):
                part = batch.slice(lo, 500)
                lists = part.column(1)
                offsets = pa.array(lists.offsets.to_numpy() - lists.offsets[0].as_py())
                found = pa.ListArray.from_arrays(offsets, pc.take(table, lists.flatten()), mask=lists.is_null() if lists.null_count else None)
                whole = pc.binary_join(found, b"")
                try:
                    text = whole.cast(pa.string())
                except pa.ArrowInvalid:
                    text = pa.array([None if b is None else b.decode("utf-8", "replace") for b in whole.to_pylist()], pa.string())
                yield pa.record_batch([part.column(0), lists, text], [key, "ids", "text"])

    return encoded.select(key, "ids").mapInArrow(rows, f"{key} {dict(encoded.dtypes)[key]}, ids array<int>, text string")
