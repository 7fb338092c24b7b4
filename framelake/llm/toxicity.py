"""Toxicity: a linear classifier of character n-grams, whose features are scaled by naive Bayes log-count ratios.

Features say which 3- to 5-grams (hashed, A-Z lower-cased) occur in a text. Over the sample of labelled rows, each
gets r = log of (share of toxic rows with it / share of others with it); all are scaled by r and weighted by a
regularised logistic regression. Null and empty texts have no features: their score is the bias's.
"""

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.llm.common import held_out, staged
from framelake.llm.jaccard import sliced
from framelake.llm.labelled import SAMPLE, logits, training_rows

BITS = 18
ORDERS = (3, 4, 5)
_ODD = [np.uint32(x) for x in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1)]
_LOWER = np.arange(128, dtype=np.uint32)
_LOWER[0x41:0x5B] += 0x20


def grams(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, feature, text): occurrences of hashed n-grams in a slice of the texts, text counted in the slice."""
    for start, part in sliced(texts):
        values = [(t or "") for t in part.to_pylist()]
        sizes = np.fromiter((len(v) + 2 for v in values), np.int64, len(values))
        signs = np.frombuffer("".join(f" {v} " for v in values).encode("utf-32-le"), np.uint32)
        signs = np.where(signs < 128, _LOWER[np.minimum(signs, 127)], signs)
        owner = np.repeat(np.arange(len(values), dtype=np.int32), sizes)
        code = np.zeros(len(signs), np.uint32)
        for k in range(max(ORDERS)):
            code[: max(0, len(signs) - k)] += (signs[k:] + np.uint32(1)) * _ODD[k] if k else (signs + np.uint32(1)) * _ODD[0]
            if k + 1 in ORDERS:
                n = max(0, len(signs) - k)
                whole = owner[:n] == owner[k:]
                hashed = code[:n] ^ (code[:n] >> np.uint32(15))
                hashed = (hashed * np.uint32(0x2C1B3C6D) + np.uint32(k)) >> np.uint32(32 - BITS)
                yield start, hashed[whole].astype(np.int32), owner[:n][whole]


def features(texts: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(text, the distinct features that it has) for each text that has any."""
    last = np.zeros(1 << BITS, np.int32)
    for start, orders in groupby(grams(texts), itemgetter(0)):
        parts = [(hashed, owner, np.searchsorted(owner, np.arange(owner[-1] + 2 if len(owner) else 1))) for _, hashed, owner in orders]
        for t in range(max(len(first) - 1 for *_, first in parts)):
            found = np.concatenate([hashed[first[t] : first[t + 1]] for hashed, _, first in parts if t + 1 < len(first)])
            if len(found):
                at = np.arange(len(found), dtype=np.int32)
                last[found] = at
                yield start + t, found[last[found] == at]


@dataclass
class Model:
    weights: np.ndarray  # of each hashed feature: regression weight times log-count ratio
    bias: float


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = SAMPLE, steps: int = 200, l2: float = 1e-3) -> Model:
    """Counts and features are gathered by Spark; the driver gets at most 2^BITS ratios and, for each of the at most
    `sample` rows, which features it has: in 2 bytes each, or in 2^BITS bits if there are many. So however long texts are,
    a row takes 32 kB at most, and 8,000 rows take 262 MB."""

    def counts(batches):
        total = np.zeros((2, 1 << BITS), np.int64)
        for batch in batches:
            truth = batch.column(1).to_pylist()
            for t, has in features(batch.column(0)):
                total[1 if truth[t] == 1 else 0, has] += 1
        at = np.flatnonzero(total.sum(0))
        yield pa.record_batch([pa.array(at), pa.array(total[1][at]), pa.array(total[0][at])], ["feature", "ones", "zeros"])

    rows = staged(training_rows(docs, labels, label, sample))  # at most `sample` texts; read three times
    sizes = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    ones, zeros = sizes.get(1, 0), sizes.get(0, 0)
    if not ones or not zeros:
        return Model(np.zeros(1 << BITS), float(np.log((ones + 1) / (zeros + 1))))
    ratio = F.log((F.col("ones") + 1) / (ones + 2)) - F.log((F.col("zeros") + 1) / (zeros + 2))
    table = rows.select("text", "label").mapInArrow(counts, "feature long, ones long, zeros long").groupBy("feature").agg(F.sum("ones").alias("ones"), F.sum("zeros").alias("zeros"))
    known = table.select("feature", ratio.alias("r")).toPandas()
    ratios = np.zeros(1 << BITS, np.float32)
    ratios[known["feature"].to_numpy()] = known["r"].to_numpy()

    def hits(batches):
        for batch in batches:
            has = [b""] * len(batch)
            for t, one in features(batch.column(0)):
                has[t] = one.tobytes()
            yield pa.record_batch([batch.column(1), pa.array(has, pa.binary())], ["label", "has"])

    truth, has = [], []
    for r in staged(rows.select("text", "label").mapInArrow(hits, "label int, has binary")).toLocalIterator():  # a part at a time
        truth.append(r[0])
        has.append(Features(np.frombuffer(r[1], np.int32)))
    order = sorted(range(len(has)), key=lambda i: (truth[i], has[i].digest()))  # the rows' order is Spark's
    weights, bias = regression([has[i] for i in order], np.array(truth)[order], ratios, steps, l2)
    return Model(weights * ratios, bias)


class Features:
    """Which features a row has: sorted, 2 bytes for each with the places at which the upper bits change; or a bit for every one."""

    def __init__(self, ids: np.ndarray):
        ids = np.sort(ids)
        self.dense = 16 * len(ids) > 1 << BITS
        if self.dense:
            flags = np.zeros(1 << BITS, bool)
            flags[ids] = True
            self.held = np.packbits(flags)
        else:
            self.held, self.ends = ids.astype(np.uint16), np.searchsorted(ids, np.arange(0, (1 << BITS) + 1, 1 << 16)).astype(np.int32)

    def ids(self) -> np.ndarray:
        if self.dense:
            return np.flatnonzero(np.unpackbits(self.held))
        return self.held + np.repeat(np.arange(len(self.ends) - 1) << 16, np.diff(self.ends))

    def digest(self) -> bytes:
        return hashlib.blake2b(self.ids().astype(np.int32).tobytes(), digest_size=16).digest()


def regression(has: list[Features], truth: np.ndarray, ratios: np.ndarray, steps: int, l2: float) -> tuple[np.ndarray, float]:
    """Weights and bias of the logistic regression on features scaled by ratios, both labels weighing the same; L-BFGS."""
    scale = np.where(truth == 1, 0.5 / (truth == 1).sum(), 0.5 / (truth != 1).sum())

    def loss(x):
        w = (x[:-1] * ratios).astype(np.float32)
        z = np.array([w[one.ids()].sum() for one in has], np.float64) + x[-1]
        error = (logits(z) - truth) * scale
        g = np.zeros(len(ratios), np.float32)
        for one, e in zip(has, error.astype(np.float32)):
            g[one.ids()] += e  # the features of a row are distinct
        value = float((scale * (np.logaddexp(0, z) - truth * z)).sum() + l2 / 2 * (x[:-1] @ x[:-1]))
        return value, np.append(g * ratios + l2 * x[:-1], error.sum())

    x = np.zeros(len(ratios) + 1)
    value, g = loss(x)
    past: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(steps):
        q, back = g.copy(), []
        for s, y, rho in reversed(past):
            back.append(rho * (s @ q))
            q -= back[-1] * y
        q *= (past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1]) if past else 1 / max(1e-12, float(np.linalg.norm(g)))
        for (s, y, rho), a in zip(past, reversed(back)):
            q += (a - rho * (y @ q)) * s
        slope, length = float(g @ q), 1.0
        for _ in range(20):
            new, new_g = loss(x - length * q)
            if new <= value - 1e-4 * length * slope:
                break
            length /= 2
        else:
            break
        s, y = -length * q, new_g - g
        if (curve := float(s @ y)) > 1e-12:
            past = [*past[-5:], (s, y, 1 / curve)]
        done = value - new < 1e-6 * max(value, 1e-6)
        x, value, g = x + s, new, new_g
        if done:
            break
    return x[:-1], float(x[-1])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batches):
        known = shared.value
        for batch in batches:
            total = np.full(len(batch), known.bias)
            for t, has in features(batch.column(1)):
                total[t] += known.weights[has].sum()
            yield pa.record_batch([batch.column(0), pa.array(logits(total))], ["doc_id", "score"])

    kind = dict(docs.dtypes)["doc_id"]
    scored = docs.select("doc_id", "text").mapInArrow(rows, f"doc_id {kind}, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
