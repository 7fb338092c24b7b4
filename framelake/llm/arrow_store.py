"""Token ids in Arrow stream files of fixed-size lists: equal-length sequences with masks, mapped without copying.

A part file holds the documents of one range of ids, in ascending order: record batches of BATCH sequences (the last may
have fewer) of `length` ids and as many mask bits (set: an id, not set: padding, only at a part's end). As all sequences are
equally long and all batches but the last have the same size, sequence k of a part is a fixed slice of the mapped file
(`Sequences`). A second stream file lists (doc_id, start, n_tokens) of the part's documents. Ids are 16 bits wide where
the tokenizer's vocabulary allows it, else 32.

Null and empty texts have the end id alone. Null doc_ids come first, rows with equal ids in the order of the
first 64 characters of their texts (in a part, of their texts). An empty table makes a manifest without rows.
"""

import functools
import gc
import json
import os
import re
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framelake.llm.common import shared_dir, shuffle_partitions, staged
from framelake.llm.tokens import joined

#: Pieces of words whose ids a task keeps at hand (as many young ones, and old ones that haven't come since), bytes of texts
#: that are taken apart at once (a longer text is one by itself), and sequences in a record batch.
KEPT_WORDS, CHUNK, BATCH = 280_000, 1 << 22, 64


def schema(length: int, wide: bool) -> pa.Schema:
    return pa.schema([("ids", pa.list_(pa.uint32() if wide else pa.uint16(), length)), ("mask", pa.list_(pa.bool_(), length))])


#: Signs that end a word without changing how what stands before them is split (an apostrophe would).
ENDINGS = "".join(chr(c) for c in range(0x21, 0x7F) if not chr(c).isalnum() and chr(c) != "'")


#: Finds signs of a word that may be composed or lower-cased otherwise than Python does it.
FAR = re.compile("[^\\x00-\u024f]|\u0130").search

# What WordCache takes for granted in a tokenizer's file.
_NORMAL = ("NFC", "Replace", "Lowercase")
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

# By byte: lower case of ASCII letters, and signs of ENDINGS; by code point of one or two bytes: letters and digits.
_LOWER = np.array([ord(chr(b).lower()) if b < 0x80 else b for b in range(256)], np.uint8)
_SIGN = np.array([chr(b) in ENDINGS for b in range(256)])
_STEM = np.array([chr(c).isalpha() or chr(c).isdecimal() for c in range(0x800)])


def about(path: str) -> tuple[int, bool]:
    """(ids of the vocabulary and the added tokens, whether words can be encoded apart) of a tokenizer."""
    with open(path) as source:
        said = json.load(source)
    vocabulary, suffix = said["model"].get("vocab", {}), said["model"].get("end_of_word_suffix")
    ids = [*vocabulary.values(), *(a["id"] for a in said["added_tokens"])] if isinstance(vocabulary, dict) else []
    normal = tuple(x["type"] for x in (said["normalizer"] or {}).get("normalizers", ()))
    splits = [x for x in (said["pre_tokenizer"] or {}).get("pretokenizers", ()) if x["type"] == "Split"]
    special = all("<|" in a["content"] for a in said["added_tokens"])
    apart = bool(suffix) and normal == _NORMAL and [x["pattern"].get("Regex") for x in splits] == [_PATTERN] and said["post_processor"] is None and special
    return max(ids, default=-1) + 1, apart


def pieces(raw: np.ndarray, offsets: np.ndarray) -> tuple[pa.StringArray, np.ndarray]:
    """(pieces of all words, first piece of each text and their number) of texts, raw[offsets[i] : offsets[i + 1]] in UTF-8.

    Spaces and newlines part words. A word is two pieces, its stem and its trailing signs, where the tokenizer always splits
    it there, else one; ASCII letters are lower-cased. Words with signs that FAR finds or with "<|" are left as they are."""
    gap = (raw == 0x20) | (raw == 0x0A)
    gaps = np.flatnonzero(gap)
    raw, texts = raw[~gap], offsets - np.searchsorted(gaps, offsets)
    edge = np.zeros(len(raw) + 1, bool)
    edge[gaps - np.arange(len(gaps))] = edge[texts] = True
    bounds = np.flatnonzero(edge)
    starts, ends = bounds[:-1], bounds[1:]

    left = raw >= 0xC9  # U+0240 and more, which is U+024F or less for FAR
    left[:-1] |= (raw[:-1] == 0xC4) & (raw[1:] == 0xB0) | (raw[:-1] == ord("<")) & (raw[1:] == ord("|"))
    whole = np.zeros(len(starts), bool)
    whole[np.searchsorted(starts, np.flatnonzero(left), "right") - 1] = True
    low = np.where(np.repeat(whole, ends - starts), raw, _LOWER[raw]) if whole.any() else _LOWER[raw]

    sign = _SIGN[low]
    runs = np.append(0, np.flatnonzero(sign[1:] & ~sign[:-1]) + 1)  # where signs begin
    signed = np.flatnonzero(sign[ends - 1] & ~whole)
    cuts = runs[np.searchsorted(runs, ends[signed]) - 1]
    cuts = cuts[cuts > starts[signed]]
    last, lead = low[cuts - 1].astype(np.int64), low[cuts - 2].astype(np.int64)
    edge[cuts[_STEM[np.where(last < 0x80, last, (lead & 0x1F) << 6 | last & 0x3F)]]] = True

    bounds = np.flatnonzero(edge)
    return pa.StringArray.from_buffers(len(bounds) - 1, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(low)), np.searchsorted(bounds, texts)


def chunks(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """(first, end) of runs of texts of about CHUNK bytes."""
    before = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(), dtype=np.int64) // CHUNK
    first = np.flatnonzero(np.diff(before, prepend=-1)).tolist()
    return zip(first, [*first[1:], len(texts)])


class WordCache:
    """Encodes texts piece by piece, each once while it is kept, with tokenizers that lower-case, drop white space and split
    letters from other signs: space and newline always part words there, and a word's trailing signs are tokens of their
    own. Pieces are found, and their ids put together, for many texts at once. Words of letters alone need no normalising
    (they are lower-cased, and composed as far as they may be) and no splitting, so they go straight to the tokenizer's
    model. Texts of other tokenizers are encoded whole."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task per core; threads of the library only cost more
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding(), self.tokenizer.no_truncation()
        size, self.apart = about(path)
        self.kind = np.dtype(np.uint32 if size > 1 << 16 else np.uint16)
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        near = {c for n in range(0x250) if chr(n).isalpha() for c in chr(n) + chr(n).lower()}
        self.spelt = {c: level.pre_tokenize_str(c)[0][0] for c in near}  # a character per byte
        self.words: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def plain(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.kind) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, new: list[str]) -> None:
        """Puts the ids of pieces into self.words."""
        words, model, other = self.words, self.tokenizer.model.tokenize, []
        for piece in new:
            if piece.isascii():
                low = spelt = piece
            elif FAR(piece) or "<|" in piece:
                low = ""
            else:
                low = piece.lower()
                spelt = "".join(map(self.spelt.__getitem__, low)) if low.isalpha() else ""
            if low.isalpha():
                words[piece] = array(self.kind.char, [t.id for t in model(spelt)]).tobytes()
            else:
                other.append(piece)
        for at in range(0, len(other), 5_000):
            some = other[at : at + 5_000]
            words.update(zip(some, (x.tobytes() for x in self.plain(some))))

    def known(self, some: list[str]) -> list[bytes]:
        """The ids of distinct pieces."""
        if len(self.words) > KEPT_WORDS:  # pieces that come again go over to the young ones
            self.old, self.words = self.words, {}
        words, old = self.words, self.old
        new = [p for p in some if p not in words]
        words.update((p, old[p]) for p in new if p in old)
        self.learn([p for p in new if p not in old])
        return list(map(words.__getitem__, some))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if not self.apart:
            return self.plain(texts)
        gc.disable()  # pieces and their ids make no cycles, but looking for some among so many takes time
        try:
            return self._encode(pa.array(texts, pa.string()))
        finally:
            gc.enable()
            pa.default_memory_pool().release_unused()  # else it keeps some 80 MB from one chunk to the next

    def _encode(self, texts: pa.Array) -> list[np.ndarray]:
        found, first = pieces(*joined(texts))
        found = found.dictionary_encode()
        ids = self.known(found.dictionary.to_numpy(zero_copy_only=False).tolist())  # to_pylist() takes ten times as long
        offsets = np.zeros(len(ids) + 1, np.int32)
        np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)) // self.kind.itemsize, out=offsets[1:])
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(ids), self.kind))).take(found.indices)
        every, bounds = lists.values.to_numpy(), lists.offsets.to_numpy()[first]
        return [every[a:b] for a, b in zip(bounds[:-1], bounds[1:])]


@functools.lru_cache(maxsize=1)
def word_cache(path: str) -> WordCache:
    """The worker's cache: tasks that follow one another in a Python worker share it."""
    return WordCache(path)


def _open(path: str):
    return pa.fs.FileSystem.from_uri(path)


class _Writer:
    """One part: sequences of ids as they fill up, under a name of its own until it is whole."""

    def __init__(self, path: str, length: int, wide: bool):
        self.fs, self.path = _open(path)
        self.temporary = f"{self.path}.{uuid.uuid4().hex}"
        self.schema, self.length, self.kind = schema(length, wide), length, np.uint32 if wide else np.uint16
        self.sink = self.fs.open_output_stream(self.temporary)
        self.stream = pa.ipc.new_stream(self.sink, self.schema)
        self.rest: list[np.ndarray] = []
        self.pending = self.total = 0

    def add(self, ids: np.ndarray) -> None:
        self.rest.append(ids)
        self.pending, self.total = self.pending + len(ids), self.total + len(ids)
        if self.pending >= BATCH * self.length:
            self._flush(self.pending // (BATCH * self.length) * BATCH * self.length, 0)

    def _flush(self, n: int, padding: int) -> None:
        flat = np.concatenate(self.rest) if self.rest else np.zeros(0, self.kind)
        self.rest, self.pending = [flat[n:]], len(flat) - n
        values = np.concatenate([flat[:n], np.zeros(padding, self.kind)]).astype(self.kind, copy=False)
        mask = np.ones(n + padding, bool)
        mask[n:] = False
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (values, mask)]
        whole = pa.record_batch(lists, schema=self.schema)
        for at in range(0, len(whole), BATCH):
            self.stream.write_batch(whole.slice(at, BATCH))

    def close(self) -> None:
        if self.pending:
            self._flush(self.pending, -self.pending % self.length)
        self.stream.close(), self.sink.close()
        self.fs.move(self.temporary, self.path)  # a repeated task writes the same once more


class _Index:
    """The list of a part's documents, written as it grows, under a name of its own until it is whole."""

    def __init__(self, path: str, kind: pa.DataType):
        self.fs, self.path = _open(path)
        self.temporary = f"{self.path}.{uuid.uuid4().hex}"
        self.schema = pa.schema([("doc_id", kind), ("start", pa.int64()), ("n_tokens", pa.int64())])
        self.sink = self.fs.open_output_stream(self.temporary)
        self.stream = pa.ipc.new_stream(self.sink, self.schema)
        self.rows: list[tuple] = []
        self.total = 0

    def flush(self) -> None:
        if self.rows:
            self.stream.write_batch(pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*self.rows), self.schema)], schema=self.schema))
            self.total += len(self.rows)
            self.rows = []

    def close(self) -> None:
        self.flush()
        self.stream.close(), self.sink.close()
        self.fs.move(self.temporary, self.path)


def write(docs: DataFrame, tokenizer: str, end_id: int = 1, length: int = 2048, folder: str | None = None) -> DataFrame:
    """Writes docs(doc_id, text) in ascending doc_id order; returns the staged manifest (part, path, n_docs, n_tokens,
    start), start being the number of ids in all parts before.

    Texts are dealt by ranges of doc_id (one shuffle) and encoded where they are written; many rows with one id are dealt by
    the heads of their texts, and equal ones by their places.
    """
    folder = folder or shared_dir(docs.sparkSession)
    wide = max(about(tokenizer)[0], end_id + 1) > 1 << 16
    fs, root = _open(folder)
    fs.create_dir(root, recursive=True)

    def rows(batches):
        part = TaskContext.get().partitionId()
        path, cache, writer, index = f"{folder}/part-{part:07d}.arrows", None, None, None
        for batch in batches:
            for lo, hi in chunks(batch.column(1)):
                cache = cache or word_cache(tokenizer)
                if not writer:
                    writer, index = _Writer(path, length, wide), _Index(f"{path}.docs", kind)
                some = batch.slice(lo, hi - lo)
                for doc, ids in zip(some.column(0).to_pylist(), cache.encode([t or "" for t in some.column(1).to_pylist()])):
                    index.rows.append((doc, writer.total, len(ids) + 1))
                    writer.add(np.append(ids, np.asarray(end_id, writer.kind)))
                if len(index.rows) >= 4096:
                    index.flush()
        if writer:
            writer.close(), index.close()
            yield pa.record_batch([pa.array([part]), pa.array([path]), pa.array([index.total]), pa.array([writer.total])], ["part", "path", "n_docs", "n_tokens"])

    kind = pa.string() if dict(docs.dtypes)["doc_id"] == "string" else pa.int64()
    n = max(1, shuffle_partitions(docs.sparkSession))
    head, row = F.substring("text", 1, 64).alias("__head"), F.monotonically_increasing_id().alias("__row")
    dealt = docs.select("doc_id", "text", head, row).repartitionByRange(n, "doc_id", "__head", "__row")  # so null and repeated ids, and equal rows, fill several parts
    ordered = dealt.sortWithinPartitions("doc_id", "text").select("doc_id", "text")
    manifest = staged(ordered.mapInArrow(rows, "part long, path string, n_docs long, n_tokens long"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per part
    return manifest.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def sequences(path: str) -> Iterator[pa.RecordBatch]:
    """The record batches of a part; local files are mapped, so their lists are views of the file."""
    fs, name = _open(path)
    source = pa.memory_map(name) if isinstance(fs, pa.fs.LocalFileSystem) else fs.open_input_file(name)
    with pa.ipc.open_stream(source) as stream:
        yield from stream


class Sequences:
    """Random access to the sequences of a part: [k] is (ids, mask) of sequence k, an array of numbers and an Arrow array of
    bits, for local files as views of the mapped file. Nothing but one batch's head is read to find it."""

    def __init__(self, path: str):
        fs, name = _open(path)
        self.source = pa.memory_map(name) if isinstance(fs, pa.fs.LocalFileSystem) else fs.open_input_file(name)
        self.schema = pa.ipc.read_schema(pa.ipc.read_message(self.source))
        self.first = self.source.tell()
        pa.ipc.read_message(self.source)
        self.stride = self.source.tell() - self.first  # of every batch but the last
        self.length = self.schema.field("ids").type.list_size

    def __getitem__(self, k: int) -> tuple[np.ndarray, pa.BooleanArray]:
        number, at = divmod(k, BATCH)
        place = self.first + number * self.stride
        if k < 0 or place >= self.source.size() - 8:  # 8 bytes end the stream
            raise IndexError(k)
        self.source.seek(place)
        batch = pa.ipc.read_record_batch(pa.ipc.read_message(self.source), self.schema)
        if at >= len(batch):
            raise IndexError(k)
        ids, mask = (batch.column(i).values.slice(at * self.length, self.length) for i in (0, 1))
        return ids.to_numpy(), mask


def read(manifest: DataFrame, key_type: str = "bigint") -> DataFrame:
    """(doc_id, start, ids) of every document in the files that the manifest names, start counted over all parts."""

    def rows(batches):
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                parts = sequences(path)
                fs, name = _open(f"{path}.docs")
                with fs.open_input_file(name) as source, pa.ipc.open_stream(source) as stream:
                    index = stream.read_all()
                held, first = np.zeros(0, np.uint32), 0
                keys, starts, sizes = index.column(0).combine_chunks(), index.column(1).to_numpy(), index.column(2).to_numpy()
                for lo in range(0, len(sizes), 512):
                    hi = min(lo + 512, len(sizes))
                    last = starts[hi - 1] + sizes[hi - 1]
                    while first + len(held) < last:
                        one = next(parts)
                        values, mask = one.column(0).flatten().to_numpy(), one.column(1).flatten()
                        held = np.concatenate([held, values if mask.true_count == len(mask) else values[mask.to_numpy(zero_copy_only=False)]])
                    offsets = np.append(starts[lo:hi], last) - first
                    ids = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(held.astype(np.int32)))
                    yield pa.record_batch([keys.slice(lo, hi - lo), pa.array(starts[lo:hi] + base), ids], ["doc_id", "start", "ids"])
                    held, first = held[last - first :], last

    parts = manifest.select("path", "start").repartition(max(1, shuffle_partitions(manifest.sparkSession)), "path")
    return parts.mapInArrow(rows, f"doc_id {key_type}, start long, ids array<int>")


def with_crc(read_back: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32): the unsigned CRC-32 of the ids as little-endian 32-bit integers."""

    def rows(batches):
        for batch in batches:
            lists = batch.column(2)
            offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy().astype("<u4")
            crc = [zlib.crc32(values[a:b]) for a, b in zip(offsets[:-1], offsets[1:])]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(np.diff(offsets).astype(np.int64)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    kind = dict(read_back.dtypes)["doc_id"]
    return read_back.mapInArrow(rows, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")
