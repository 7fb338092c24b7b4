"""A bounded sample of labelled rows to fit classifiers on, and measures of their scores."""

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.llm.common import held_out

#: Most labelled rows that a classifier is fitted on.
SAMPLE = 8000


def training_rows(docs: DataFrame, labels: DataFrame, label: str, most: int = SAMPLE) -> DataFrame:
    """(text, label int, fold 0-9) of at most `most` documents with a label, none of them held out: those whose hashed
    id is smallest. Of several labels of one id the largest counts; null ids and labels are left out."""
    rows = labels.where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull() & F.col(label).isNotNull())
    chosen = rows.groupBy("doc_id").agg(F.max(label).cast("int").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    chosen = chosen.withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(10)).cast("int"))
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "label", "fold")  # at most `most` small rows


def logits(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def area_under_curve(score: np.ndarray, truth: np.ndarray) -> float:
    """Probability that a row of label 1 scores above one of label 0, ties counting half."""
    values, inverse, counts = np.unique(score, return_inverse=True, return_counts=True)
    rank = (np.cumsum(counts) - (counts - 1) / 2)[inverse]
    ones = int(truth.sum())
    return float((rank[truth == 1].sum() - ones * (ones + 1) / 2) / max(1, ones * (len(truth) - ones)))
