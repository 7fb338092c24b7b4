"""Exact deduplication: local, then salted, then global combining, each comparing whole texts.

A group is a set of texts that are identical once every run of ASCII white space is one space; null counts as empty.
The smallest id of a group stays (a group whose ids are all null keeps one row); of repeated rows with that id and
text exactly one stays. Ids keep their type.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.llm.common import SPACE, few, shuffle_partitions, staged


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256): one row for each row of docs.

    Grouping on (digest, salt, text) combines within each map task before anything is shuffled; the salt spreads the
    copies of one text over as many groups as there are shuffle partitions. Only one row for each salt group goes on to
    the global combination on (digest, text). Both branches read the same salted aggregate, whose shuffle is reused (its
    keys can't be null, else Spark would filter one branch below it), so texts are shuffled twice in all; ids come back through a join on the salt group's smallest id.
    """
    salts = max(16, shuffle_partitions(docs.sparkSession))
    text = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), SPACE, " ")
    rows = docs.select(F.struct(F.col(id_col).alias("id")).alias("row"), text.alias("text")).select(
        "row", "text", F.coalesce(F.sha2("text", 256), F.lit("")).alias("digest"), F.coalesce(F.pmod(F.xxhash64("row.id"), F.lit(salts)), F.lit(0)).alias("salt")
    )
    salted = rows.groupBy("digest", "salt", "text").agg(F.collect_list("row").alias("members"))
    ids = F.array_compact("members.id")
    winners = (
        salted.select("digest", "text", "salt", F.array_min(ids).alias("first_id"), F.size("members").cast("long").alias("n"))
        .groupBy("digest", "text")
        .agg(F.min("first_id").alias("keep_id"), F.sum("n").alias("group_size"), F.collect_list("salt").alias("salts"))
    )
    key = lambda: F.xxhash64("text").alias("text_key")
    parts = winners.select("digest", key(), "keep_id", "group_size", F.explode("salts").alias("salt"))
    members = salted.select("digest", key(), "salt", F.sort_array("members").alias("members"))
    home = F.when(F.col("keep_id").isNull(), F.lit(0)).otherwise(F.array_position("members.id", F.col("keep_id")) - 1)
    return (
        members.join(parts, ["digest", "text_key", "salt"])
        .select("digest", "keep_id", "group_size", home.alias("home"), F.posexplode("members").alias("pos", "row"))
        .select(F.col("row.id").alias(id_col), "keep_id", "group_size", F.coalesce(F.col("pos") == F.col("home"), F.lit(False)).alias("kept"), F.col("digest").alias("text_sha256"))
    )


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that groups() drops; columns as they are. Of repeated rows (one id, equal texts) the one stays
    that comes first by its text as it is, then by its other columns written as JSON.

    groups() runs once, into a narrow staged table. What it drops is a key (id, digest), so docs are read once more and
    filtered by a join with the dropped keys, which is a map-side one where they are few."""
    found = staged(groups(docs, id_col, text_col).select(F.col(id_col).alias("__id"), F.col("text_sha256").alias("__digest"), "kept"))
    keys = found.groupBy("__id", "__digest").agg(F.count("*").alias("rows"), F.max("kept").alias("kept"))
    digest = F.sha2(F.regexp_replace(F.coalesce(docs[text_col], F.lit("")), SPACE, " "), 256)

    def joined(rows: DataFrame, some: DataFrame, how: str) -> DataFrame:
        some = some.select("__id", "__digest")
        same = rows[id_col].eqNullSafe(some["__id"]) & (digest == some["__digest"])
        return rows.join(F.broadcast(some) if few(some) else some, same, how)

    kept = joined(docs, keys.where(~F.col("kept")), "left_anti")
    repeated = keys.where("kept and rows > 1")
    if repeated.isEmpty():
        return kept
    others = [c for c in docs.columns if c not in (id_col, text_col)]
    order = F.struct(F.col(text_col).isNotNull(), F.col(text_col), F.to_json(F.struct(*others)) if others else F.lit(""))
    first = joined(kept, repeated, "left_semi").groupBy(F.col(id_col).alias("__id"), digest.alias("__digest")).agg(F.min_by(F.struct(*docs.columns), order).alias("row"))
    return joined(kept, repeated, "left_anti").unionByName(first.select("row.*"))
