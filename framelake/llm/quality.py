"""Quality: random-indexing word vectors, pooled per document, and a two-layer network with calibrated probabilities.

Every token (letters and digits, or other signs) falls into one of BUCKETS; each bucket has a fixed sparse random index
vector. A bucket's word vector is the sum of the index vectors of its neighbours in all texts, scaled to length one.
A document is the mean and the spread of its tokens' vectors. The network is fitted on a bounded sample of labelled
rows, and its temperature on those of them that it didn't see. Null and empty texts pool to zeros.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framelake.llm import tokens
from framelake.llm.common import PIECES, configured, held_out
from framelake.llm.jaccard import sliced
from framelake.llm.labelled import SAMPLE, logits, training_rows

BUCKETS, WIDTH, SPARSE, WINDOW = 1 << 14, 32, 4, 2
THRESHOLD = 0.3


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """(places, signs) of the SPARSE entries of each bucket's index vector."""
    draw = np.random.default_rng(5)
    return draw.integers(0, WIDTH, (BUCKETS, SPARSE)), draw.choice([-1.0, 1.0], (BUCKETS, SPARSE))


def _buckets(part: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    hashes, first = tokens.runs(part)
    return (hashes >> np.uint64(64 - 14)).astype(np.int64), first


def word_vectors(docs: DataFrame) -> np.ndarray:
    """BUCKETS x WIDTH, over all texts; each task sends at most BUCKETS rows, the driver gets BUCKETS."""

    def sums(batches):
        places, signs = index_vectors()
        total = np.zeros(BUCKETS * WIDTH)
        for batch in batches:
            for _, part in sliced(batch.column(0)):
                bucket, first = _buckets(part)
                owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
                for step in range(1, WINDOW + 1):
                    same = np.flatnonzero(owner[step:] == owner[:-step])
                    left, right = bucket[same], bucket[same + step]
                    for a, b in ((left, right), (right, left)):
                        total += np.bincount((a[:, None] * WIDTH + places[b]).ravel(), signs[b].ravel(), BUCKETS * WIDTH)
        table = total.reshape(BUCKETS, WIDTH)
        some = np.flatnonzero(np.abs(table).sum(1))
        yield pa.record_batch([pa.array(some), *(pa.array(table[some, j]) for j in range(WIDTH))], ["bucket", *(f"v{j}" for j in range(WIDTH))])

    columns = [f"v{j}" for j in range(WIDTH)]
    rows = docs.select("text").mapInArrow(sums, ", ".join(["bucket long", *(f"{c} double" for c in columns)]))
    with configured(docs.sparkSession, PIECES):
        found = rows.groupBy("bucket").agg(*(F.sum(c).alias(c) for c in columns)).toPandas()
    vectors = np.zeros((BUCKETS, WIDTH))
    vectors[found["bucket"].to_numpy(np.int64)] = found[columns].to_numpy()
    return (vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def pooled(texts: pa.Array, vectors: np.ndarray) -> np.ndarray:
    """Mean and spread of each text's token vectors, and of how far neighbouring tokens agree: 2 x WIDTH + 1 columns."""
    out = [np.zeros((0, 2 * WIDTH + 1), np.float32)]
    for _, part in sliced(texts):
        bucket, first = _buckets(part)
        n = np.diff(first)
        mean, square, alike = np.zeros((len(n), WIDTH)), np.zeros((len(n), WIDTH)), np.zeros(len(n))
        full = np.flatnonzero(n)
        if len(full):
            at = first[:-1][full]
            one = vectors[bucket]
            mean[full], square[full] = np.add.reduceat(one, at), np.add.reduceat(one * one, at)
            alike[full] = np.add.reduceat(np.append((bucket[1:] == bucket[:-1]).astype(np.float64), 0.0), at)
        size = np.maximum(n, 1)[:, None]
        mean, square = mean / size, square / size
        out.append(np.hstack([mean, np.sqrt(np.maximum(square - mean * mean, 0)), alike[:, None] / size]).astype(np.float32))
    return np.vstack(out)


@dataclass
class Model:
    vectors: np.ndarray
    centre: np.ndarray
    scale: np.ndarray
    layers: tuple[np.ndarray, ...]
    temperature: float

    def logit(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return np.tanh((x - self.centre) / self.scale @ w1 + b1) @ w2 + b2


def _network(x: np.ndarray, truth: np.ndarray, hidden: int, steps: int, l2: float) -> tuple[np.ndarray, ...]:
    draw = np.random.default_rng(3)
    p = [draw.normal(0, x.shape[1] ** -0.5, (x.shape[1], hidden)), np.zeros(hidden), draw.normal(0, hidden**-0.5, hidden), np.zeros(1)]
    m, v = [np.zeros_like(q) for q in p], [np.zeros_like(q) for q in p]
    for step in range(1, steps + 1):
        at = draw.integers(0, len(x), min(512, len(x)))
        h = np.tanh(x[at] @ p[0] + p[1])
        error = (logits(h @ p[2] + p[3]) - truth[at]) / len(at)
        back = np.outer(error, p[2]) * (1 - h * h)
        for k, g in enumerate((x[at].T @ back + l2 * p[0], back.sum(0), h.T @ error + l2 * p[2], error.sum(keepdims=True))):
            m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
            p[k] = p[k] - 0.01 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return tuple(p)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE, hidden: int = 32, steps: int = 1500, l2: float = 1e-4) -> Model:
    """The driver gets the word vectors (of fixed size) and one pooled vector for each of at most `sample` rows."""
    vectors = word_vectors(docs)
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    def rows(batches):
        for batch in batches:
            x = pooled(batch.column(0), shared.value)
            yield pa.record_batch([pa.array(list(x), pa.list_(pa.float32())), batch.column(1), batch.column(2)], ["x", "label", "fold"])

    got = training_rows(docs, labels, label, sample).mapInArrow(rows, "x array<float>, label int, fold int").toPandas()
    width = 2 * WIDTH + 1
    x, truth, fold = np.array(got["x"].tolist(), np.float64).reshape(-1, width), got["label"].to_numpy(np.float64), got["fold"].to_numpy()
    if not 0 < truth.sum() < len(truth):
        bias = np.log((truth.sum() + 1) / (len(truth) - truth.sum() + 1))
        return Model(vectors, np.zeros(width), np.ones(width), (np.zeros((width, 1)), np.zeros(1), np.zeros(1), np.array([bias])), 1.0)
    order = np.lexsort((*x.T[:3], truth))  # the rows' order is Spark's; fits agree from run to run
    x, truth, fold = x[order], truth[order], fold[order]
    fresh = (fold < 2) & (len(truth) > 20)
    centre, scale = x[~fresh].mean(0), x[~fresh].std(0) + 1e-6
    model = Model(vectors, centre, scale, _network((x[~fresh] - centre) / scale, truth[~fresh], hidden, steps, l2), 1.0)
    if fresh.any():
        z, t = model.logit(x[fresh]), truth[fresh]
        loss = [(-np.mean(np.log(np.clip(np.where(t == 1, logits(z / k), 1 - logits(z / k)), 1e-12, 1))), k) for k in np.geomspace(0.25, 8, 61)]
        model.temperature = float(min(loss)[1])
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of docs."""
    scored = with_score(docs.select("doc_id", "text"), model, "score").drop("text")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def with_score(docs: DataFrame, model: Model, name: str) -> DataFrame:
    """docs with a column `name`: the calibrated probability of label 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index("text")

    def rows(batches):
        for batch in batches:
            known = shared.value
            for start, part in sliced(batch.column(place)):
                x = pooled(part, known.vectors)
                yield pa.record_batch([*batch.slice(start, len(part)).columns, pa.array(logits(known.logit(x) / known.temperature))], [*batch.schema.names, name])

    return docs.mapInArrow(rows, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def keep_good(docs: DataFrame, model: Model) -> DataFrame:
    """docs whose probability is at least THRESHOLD; columns as they are."""
    return with_score(docs, model, "__quality").where(F.col("__quality") >= THRESHOLD).select(*docs.columns)
