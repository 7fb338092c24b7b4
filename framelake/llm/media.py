"""Media columns: payloads cut where their content says, chunks stored once, ordered chunk lists that give them back.

A payload is a text's UTF-8 bytes (null: none) and bytes 255 up to a positive multiple of UNIT. A rolling gear hash of
the last 32 bytes cuts it, so equal passages make equal chunks wherever they stand. Each task packs its distinct chunks
(compressed) with the chunk lists of its documents; Spark joins then find digests that several packs hold, make the
pack with the smallest name their owner, and every other pack's documents take these chunks from the owner's copy.

Reading back puts chunks together in the order of a document's list and compares every digest; a difference stops the
job. Documents whose chunks are all in their own pack never leave it; only shared chunks and what they belong to are
shuffled. Repeated and equal documents share chunks and give equal values; ids of any type (null too) are carried along.
"""

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.llm.common import staged

UNIT = 576
LEAST, MOST, MASK = 2048, 65536, np.uint32(0xFFF80000)
#: Bytes of payload that one pack holds, about.
PACK = 8 << 20
#: Shared chunk references up to which the list of them may be broadcast; beyond that packs are shuffled to it.
FEW = 200_000
GEAR = np.random.default_rng(8).integers(0, 1 << 32, 256, np.uint32)
RESULT = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def payload(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode()
    return len(raw), raw + b"\xff" * (-len(raw) % UNIT if raw else UNIT)


def cut_ends(data: np.ndarray, offsets: np.ndarray) -> Iterator[list[int]]:
    """Ends of the chunks of each payload data[offsets[i]:offsets[i + 1]]. A chunk ends LEAST bytes after its start at
    the earliest, so no hash there reaches beyond it, and at MOST at the latest."""
    h = GEAR[data]
    for reach in (1, 2, 4, 8, 16):
        h[reach:] = h[reach:] + (h[:-reach] << np.uint32(reach))
    places = np.flatnonzero((h & MASK) == 0) + 1
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        inside = places[np.searchsorted(places, a + LEAST) : np.searchsorted(places, b)].tolist()
        ends, start = [], a
        for p in inside:
            while p - start > MOST:
                start += MOST
                ends.append(start)
            if p - start >= LEAST:
                ends.append(p)
                start = p
        while b - start > MOST:
            start += MOST
            ends.append(start)
        yield [*ends, b]


def store(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Staged packs(pack, blob, digests, sizes, rows): blob holds the chunks one after another; rows say for each
    distinct document its ids, its length and the places of its chunks in this pack."""
    kind = dict(docs.dtypes)[key]

    def packs(batches):
        part, number = TaskContext.get().partitionId(), 0
        pack = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            values = [payload(t) for t in batch.column(1).to_pylist()]
            keys, lo = batch.column(0).to_pylist(), 0
            while lo < len(values):
                hi, total = lo, 0
                while hi < len(values) and (hi == lo or total + len(values[hi][1]) <= PACK):
                    total += len(values[hi][1])
                    hi += 1
                some = values[lo:hi]
                offsets = np.concatenate([[0], np.cumsum([len(v) for _, v in some])])
                data = np.frombuffer(b"".join(v for _, v in some), np.uint8)
                chunks: dict[bytes, tuple[int, bytes]] = {}
                rows: dict[tuple, dict] = {}
                for i, (ends, a) in enumerate(zip(cut_ends(data, offsets), offsets)):
                    places = []
                    for b in ends:
                        body = data[a:b].tobytes()
                        places.append(chunks.setdefault(hashlib.sha256(body).digest(), (len(chunks), body))[0])
                        a = b
                    one = rows.setdefault((some[i][0], *places), {"keys": [], "n_bytes": some[i][0], "places": places})
                    one["keys"].append(keys[lo + i])
                blob = pack.compress(b"".join(c for _, c in chunks.values()))
                row_type = pa.list_(pa.struct([("keys", pa.list_(batch.column(0).type)), ("n_bytes", pa.int64()), ("places", pa.list_(pa.int32()))]))
                yield pa.record_batch(
                    [pa.array([f"{part:08d}:{number:06d}"]), pa.array([blob], pa.binary()), pa.array([list(chunks)], pa.list_(pa.binary())), pa.array([[len(c) for _, c in chunks.values()]], pa.list_(pa.int32())), pa.array([list(rows.values())], row_type)],
                    ["pack", "blob", "digests", "sizes", "rows"],
                )
                lo, number = hi, number + 1

    schema = f"pack string, blob binary, digests array<binary>, sizes array<int>, rows array<struct<keys: array<{kind}>, n_bytes: long, places: array<int>>>"
    return staged(docs.select(key, text).mapInArrow(packs, schema))


def shared_chunks(packs: DataFrame) -> DataFrame:
    """Staged (pack, digest, owner): chunks that a pack has but another owns."""
    held = packs.select("pack", F.explode("digests").alias("digest"))
    owners = staged(held.groupBy("digest").agg(F.min("pack").alias("owner"), F.count("*").alias("n")).where("n > 1").select("digest", "owner"))
    return staged(held.join(owners, "digest").where("pack <> owner"))


def _with_lists(packs: DataFrame, shared: DataFrame) -> DataFrame:
    """packs with `given` (digests that others take from it) and `missing` (those it takes from others)."""
    given = shared.groupBy(F.col("owner").alias("pack")).agg(F.collect_set("digest").alias("given"))
    missing = shared.groupBy("pack").agg(F.collect_set("digest").alias("missing"))
    both = given.join(missing, "pack", "full")
    return packs.join(F.broadcast(both) if shared.count() <= FEW else both, "pack", "left")


def result_of(n_bytes: int, parts: list[bytes], digests: list[bytes]) -> tuple:
    """What is reported of a payload put together from verified parts. Its stored form, which alone gives it back, is its
    ordered chunk list followed by each of its distinct chunks once."""
    for part, digest in zip(parts, digests, strict=True):
        if hashlib.sha256(part).digest() != digest:
            raise RuntimeError("a chunk isn't what its digest says")
    whole = b"".join(parts)
    if len(whole) % UNIT or not 0 <= len(whole) - n_bytes <= UNIT or whole[n_bytes:].strip(b"\xff"):
        raise RuntimeError("a payload has the wrong length or padding")
    form = b"".join([*(d + len(p).to_bytes(4, "little") for p, d in zip(parts, digests)), *dict(zip(digests, parts)).values()])
    counts = np.bincount(np.frombuffer(whole, np.uint8), minlength=256) / len(whole)
    mean = float(counts @ np.arange(256))
    entropy = float(-(counts[counts > 0] * np.log2(counts[counts > 0])).sum())
    feature = f"chunks={len(parts)};mean={mean:.3f};entropy={entropy:.4f}"
    return n_bytes, len(whole), hashlib.sha256(whole).hexdigest(), zlib.crc32(whole[-32:]), len(form), hashlib.sha256(form).hexdigest(), feature


def _chunks(row: dict) -> list[bytes]:
    data = zstandard.ZstdDecompressor().decompress(row["blob"], max_output_size=sum(row["sizes"]))
    ends = np.cumsum(row["sizes"]).tolist()
    return [data[b - n : b] for b, n in zip(ends, row["sizes"])]


def _rows(batches, without: str | None = None) -> Iterator[dict]:
    for batch in batches:
        for i in range(len(batch)):
            row = batch.slice(i, 1).to_pylist()[0]
            if without is None or row[without]:
                yield row


def read_back(packs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature), a row for each
    stored document, from the stored bytes."""
    kind = packs.schema["rows"].dataType.elementType["keys"].dataType.elementType.simpleString()
    names = [key, *(f.split()[0] for f in RESULT.split(", "))]
    shared = shared_chunks(packs)
    listed = _with_lists(packs, shared)

    def table(rows: list[tuple], key_type: pa.DataType) -> pa.RecordBatch:
        types = [key_type, pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        return pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)

    def key_type_of(schema: pa.Schema) -> pa.DataType:
        return schema.field("rows").type.value_type.field("keys").type.value_type

    def complete(batches):
        for batch in batches:
            for row in _rows([batch]):
                chunks, missing = _chunks(row), set(row["missing"] or [])
                out = []
                for one in row["rows"]:
                    digests = [row["digests"][p] for p in one["places"]]
                    if missing.isdisjoint(digests):
                        result = result_of(one["n_bytes"], [chunks[p] for p in one["places"]], digests)
                        out += [(k, *result) for k in one["keys"]]
                yield table(out, key_type_of(batch.schema))

    def exported(batches):
        for row in _rows(batches, "given"):
            chunks, given = _chunks(row), set(row["given"])
            both = [(d, c) for d, c in zip(row["digests"], chunks) if d in given]
            yield pa.record_batch([pa.array([x[i] for x in both], pa.binary()) for i in (0, 1)], ["digest", "body"])

    def parts(batches):
        for batch in batches:
            keys_type = pa.list_(key_type_of(batch.schema))
            types = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), keys_type]
            for row in _rows([batch], "missing"):
                chunks, missing, out = _chunks(row), set(row["missing"]), []
                for number, one in enumerate(row["rows"]):
                    digests = [row["digests"][p] for p in one["places"]]
                    if not missing.isdisjoint(digests):
                        for at, (p, d) in enumerate(zip(one["places"], digests)):
                            out.append((row["pack"], number, one["n_bytes"], at, d, None if d in missing else chunks[p], [] if at else one["keys"]))
                yield pa.record_batch([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], ["pack", "number", "n_bytes", "at", "digest", "body", "keys"])

    def together(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("at")
        result = result_of(int(rows["n_bytes"].iloc[0]), [bytes(b) for b in rows["body"]], [bytes(d) for d in rows["digest"]])
        return pd.DataFrame([(k, *result) for k in rows["keys"].iloc[0]], columns=names)

    inside = listed.select("blob", "digests", "sizes", "rows", "missing").mapInArrow(complete, f"{key} {kind}, {RESULT}")
    bodies = listed.select("blob", "digests", "sizes", "given").mapInArrow(exported, "digest binary, body binary")
    split = listed.select("pack", "blob", "digests", "sizes", "rows", "missing").mapInArrow(parts, f"pack string, number long, n_bytes long, at int, digest binary, body binary, keys array<{kind}>")
    split = staged(split)
    taken = split.where("body is null").drop("body").join(bodies, "digest").select(split.columns)
    across = split.where("body is not null").unionByName(taken).groupBy("pack", "number").applyInPandas(together, f"{key} {kind}, {RESULT}")
    return inside.unionByName(across)


def compacted(packs: DataFrame) -> DataFrame:
    """packs without the bytes of chunks that another pack owns: what long-term storage keeps, every chunk once."""

    def kept(batches):
        pack = zstandard.ZstdCompressor(level=3)
        for row in _rows(batches):
            missing = set(row["missing"] or [])
            both = [(d, c) for d, c in zip(row["digests"], _chunks(row)) if d not in missing]
            yield pa.record_batch([pa.array([row["pack"]]), pa.array([pack.compress(b"".join(c for _, c in both))], pa.binary()), pa.array([[d for d, _ in both]], pa.list_(pa.binary()))], ["pack", "blob", "digests"])

    listed = _with_lists(packs, shared_chunks(packs)).select("pack", "blob", "digests", "sizes", "missing")
    return listed.mapInArrow(kept, "pack string, blob binary, digests array<binary>")
