"""Connected components of an edge table, by alternating large and small stars on staged tables."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.llm.common import dropped, staged


def _with_least(edges: DataFrame) -> DataFrame:
    """edges(a, b) with m, the smallest of a and its neighbours b: summed up before the shuffle, then joined back, so the
    centre of a large star needs no task of its own (Spark splits its partition)."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    return edges.join(least, "a").withColumn("m", F.least("a", "m"))


def components(edges: DataFrame) -> DataFrame:
    """edges(a, b), two longs -> (node, root): every node that an edge has, with the smallest node it can reach.

    Each step connects a node's larger (then smaller) neighbours with its smallest one, until nothing changes; stars
    double the reach of a step, so the number of steps grows with the logarithm of the longest path.
    """
    spark, old = edges.sparkSession, []
    stars = staged(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), old)
    mark = None
    while True:
        both = stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _with_least(both).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        small = _with_least(large).select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        new: list[str] = []
        stars = staged(small, new)
        now = stars.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        dropped(spark, old)
        old = new
        if now == mark:
            roots = stars.select(F.col("a").alias("node"), F.col("b").alias("root"))
            return roots.unionByName(roots.select(F.col("root").alias("node"), "root")).distinct()
        mark = now
