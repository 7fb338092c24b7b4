"""From documents to token ids: quality, exact and near duplicates, source weights, BPE.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before kept.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.llm import bpe, exact, jaccard, mixing, quality
from framelake.llm.common import dropped, read, staged

#: SQL can't express the classifier, the similarity join or the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return quality.keep_good(docs, quality.fit(docs, read(spark, sf_dir, "labels")))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of equal texts."""
    return exact.keep_first(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return jaccard.keep_one(docs)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, each whole: the last of a source is taken or left."""
    return mixing.resample(docs, whole=True)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids) of each row."""
    import public_tokenizers

    return bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.json")).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality classifier", good_quality),
    ("exact dedup", without_copies),
    ("n-gram Jaccard join", without_near_copies),
    ("mixing sources", mixed_sources),
    ("BPE encoding", token_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over `documents`, each on the table that the one before wrote; a table goes when the next one is whole, the
    last but one stays, as the result reads it. Null and empty texts, null and repeated ids are rows like others."""
    docs, old = read(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            new: list[str] = []
            docs = staged(docs, new)
            dropped(spark, old)
            old = new
    return docs
