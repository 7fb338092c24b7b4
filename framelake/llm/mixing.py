"""Mixing sources to target weights with a low-discrepancy schedule of equal-token blocks.

Every source's documents are laid end to end in a shuffled order (a hash of the row's content identity), up to
`max_epochs` times; the stream is cut into blocks of equally many words. Points of the golden-ratio sequence, mapped
through the cumulative weights, say which source each slot of the mix takes its next block from.

Null texts have no words and null is a source of its own, after all others. A document without words is returned with
taken 0. Repeated rows are separate documents. Rows keep their identity because the compact table (no texts) is staged
before anything is ranked.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelake.llm.common import WORD, few, shuffle_partitions, staged

#: Fractional part of the golden ratio: the step of the point sequence.
GOLDEN = 0.6180339887498949
#: Rows that one ranking task may hold, on average: sources are cut into so many chunks that none is larger.
CHUNK = 4096
#: Fewest blocks a source with enough words is cut into, so that small sources interleave as well.
LEAST_BLOCKS = 16
SEED = 7


def targets(sizes: DataFrame, max_epochs: int = 3) -> DataFrame:
    """sizes(source, source_size) -> with weight, target.

    Weights 1, 2, 3 repeat over the sources by code point, null last. Raising one level over all sources, each stops at
    max_epochs times its size; sorted by where they stop, prefix sums give the level at which the targets add up to all
    words. Windows here run over one row per source, never over documents.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    ranked = sizes.withColumn("weight", ((F.row_number().over(by_name) - 1) % 3 + 1).cast("double")).withColumn("cap", F.col("source_size").cast("double") * max_epochs)
    by_stop = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    before, after, everyone = by_stop.rowsBetween(Window.unboundedPreceding, -1), by_stop.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy()
    left = F.sum("source_size").over(everyone) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    level = ranked.withColumn("stop", F.col("cap") / F.col("weight")).withColumn("level", left / F.sum("weight").over(after))
    fitting = F.min(F.when(F.col("level") <= F.col("stop"), F.struct("stop", "level"))).over(everyone)["level"]
    return level.select("source", "source_size", "weight", F.least("cap", F.coalesce(fitting, F.lit(0.0)) * F.col("weight")).alias("target"))


def _running(rows: DataFrame, keys: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """Adds the sum of value over all earlier rows of the same keys; rows already carry a chunk that rises with order.

    Sums within chunks, then over one row per chunk: no task holds more than a chunk, however large a key is.
    """
    chunks = rows.groupBy(*keys, "chunk").agg(F.sum(value).alias("__sum"))
    earlier = Window.partitionBy(*keys).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    base = chunks.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("chunk").alias("__chunk"), F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__base"))
    within = Window.partitionBy(*keys, "chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    match = [rows[k].eqNullSafe(base[f"__{k}"]) for k in keys] + [rows["chunk"] == base["__chunk"]]
    joined = rows.join(base, match).drop(*[f"__{k}" for k in keys], "__chunk")
    return joined.withColumn(out, F.col("__base") + F.coalesce(F.sum(value).over(within), F.lit(0))).drop("__base")


def place(seed: int) -> Column:
    return F.xxhash64("doc_id", "text", F.lit(seed))


def sizes_of(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """Staged (row_id, doc_id, source, size, place): place is the row's position on the shuffled circle of its source, a hash
    of id and text (so rows without an id, or of one id, are spread too)."""
    size = F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select(F.monotonically_increasing_id().alias("row_id"), "doc_id", "source", size.alias("size"), place(seed).alias("place"))
    return staged(rows)


def schedule(plan: DataFrame, slots: int) -> DataFrame:
    """plan(source_no, blocks, low, high) and the number of points -> (source_no, rank, slot): where each block comes.

    Points are drawn in proportion to the blocks that each source needs, some more than that; ranks beyond a source's
    blocks are dropped. A point finds its source through an equi-join on one of 4,096 cells of the unit interval. Ranks
    that the points didn't reach (their share of an interval is off by a few points) take slots after all points.
    """
    cells = 4096
    spark = plan.sparkSession
    extra = slots + slots // 50 + 64
    points = spark.range(extra).select(F.col("id").alias("slot"), F.expr(f"pmod((id + 0.5D) * {GOLDEN}D, 1.0D)").alias("at")).withColumn("cell", F.floor(F.col("at") * cells))
    spans = plan.withColumn("cell", F.explode(F.sequence(F.floor(F.col("low") * cells), F.least(F.floor(F.col("high") * cells), F.lit(cells - 1)))))
    drawn = points.join(spans, "cell").where((F.col("at") >= F.col("low")) & (F.col("at") < F.col("high"))).select("source_no", "blocks", "slot", F.floor(F.col("slot") / CHUNK).alias("chunk"), F.lit(1).alias("one"))
    ranked = staged(_running(drawn, ["source_no"], ["slot"], "one", "rank").where(F.col("rank") < F.col("blocks")).select("source_no", "rank", "slot"))
    reached = ranked.groupBy("source_no").agg(F.count("*").alias("reached"))
    short = plan.join(reached, "source_no", "left").withColumn("reached", F.coalesce("reached", F.lit(0))).where("reached < blocks")
    late = short.select("source_no", F.explode(F.sequence(F.col("reached"), F.col("blocks") - 1)).alias("rank"))
    return ranked.unionByName(late.select("source_no", "rank", (F.lit(extra) + F.col("rank")).alias("slot")))


def mix(docs: DataFrame, block: int = 1024, max_epochs: int = 3, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(pieces, documents).

    pieces(slot, row_id, epoch, words): the mix, in the order of its slots; each piece is some words of one document. Only
    what the schedule gave a slot is in it. The schedule has a slot for every block, so every source takes its target, rounded
    down, to the word.
    documents(row_id, place, doc_id, source, size, source_size, target, taken, first_slot): one row for each row of docs, with the
    words that its pieces take and the first slot of them (null if it has none).
    """
    rows = sizes_of(docs, seed)
    spark = docs.sparkSession
    per_source = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), max_epochs)
    number = Window.orderBy(F.col("source").isNull(), "source")
    words = F.floor(F.col("target") + F.lit(1e-6)).cast("long")
    plan = per_source.withColumn("source_no", F.row_number().over(number)).withColumn("words", F.least(words, F.col("source_size") * max_epochs))
    plan = plan.withColumn("block", F.greatest(F.lit(1), F.least(F.lit(block), F.floor(F.col("words") / LEAST_BLOCKS))).cast("long")).withColumn("blocks", F.ceil(F.col("words") / F.col("block")).cast("long"))
    so_far, everyone = number.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy()
    plan = plan.withColumn("all_blocks", F.sum("blocks").over(everyone)).withColumn("high", F.sum("blocks").over(so_far) / F.col("all_blocks")).withColumn("low", F.col("high") - F.col("blocks") / F.col("all_blocks"))
    plan = staged(plan)  # one row per source
    slots = plan.agg(F.max("all_blocks")).first()[0] or 0

    # Chunks of the shuffled circle: equal arcs of the hash, enough for the largest source.
    most = rows.groupBy("source").count().agg(F.max("count")).first()[0] or 0
    arcs = max(1, -(-most // CHUNK))
    chunk = F.floor((F.shiftrightunsigned("place", 16).cast("double") / float(1 << 48)) * arcs)
    full = rows.withColumn("chunk", chunk).where("size > 0")
    placed = _running(full, ["source"], ["place", "row_id"], "size", "start")
    source_plan = plan.select(F.col("source").alias("__source"), "source_no", "source_size", "words", "block", "target")
    laid = placed.join(source_plan, placed["source"].eqNullSafe(F.col("__source"))).drop("__source")
    epochs = laid.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(max_epochs - 1)))).withColumn("from", F.col("start") + F.col("epoch") * F.col("source_size"))
    epochs = epochs.where(F.col("from") < F.col("words")).withColumn("to", F.least(F.col("from") + F.col("size"), F.col("words")))
    cut = epochs.withColumn("rank", F.explode(F.sequence(F.floor(F.col("from") / F.col("block")), F.floor((F.col("to") - 1) / F.col("block")))))
    piece = F.least("to", (F.col("rank") + 1) * F.col("block")) - F.greatest("from", F.col("rank") * F.col("block"))
    cut = cut.select("row_id", "source_no", "epoch", "rank", piece.cast("long").alias("words"))
    pieces = cut.join(schedule(plan.select("source_no", "blocks", "low", "high"), slots), ["source_no", "rank"]).select("slot", "row_id", "epoch", "words")
    taken = pieces.groupBy("row_id").agg(F.sum("words").alias("taken"), F.min("slot").alias("first_slot"))
    per_doc = rows.join(taken, "row_id", "left")
    known = plan.select(F.col("source").alias("__source"), "source_size", "target")
    documents = per_doc.join(F.broadcast(known) if few(plan) else known, per_doc["source"].eqNullSafe(F.col("__source"))).select(
        "row_id", "place", "doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "first_slot"
    )
    return pieces, documents


def resample(docs: DataFrame, whole: bool = False, **options) -> DataFrame:
    """docs as the mix takes them, with docs' columns, in the order of the mix's slots: a document as often as the mix takes
    it whole, and where a source's target ends inside it once more with only the words taken (from the start of its text,
    n_chars adapted); if whole, once more as it is when at least half of its words are taken, else not, so no text is changed.
    Rows that share id, source, size and text are matched to their takings in the order of these."""
    pieces, documents = mix(docs, **options)
    key = lambda size: F.xxhash64("doc_id", "source", size, "__place").alias("__key")
    copies = pieces.groupBy("row_id", "epoch").agg(F.min("slot").alias("slot"), F.sum("words").cast("long").alias("words"))
    taken = copies.groupBy("row_id").agg(F.sort_array(F.collect_list(F.struct("slot", "words"))).alias("copies"))  # max_epochs at most
    rows = documents.select("row_id", "doc_id", "source", "size", F.col("place").alias("__place")).join(taken, "row_id")
    takings = rows.select(key(F.col("size")), "copies").groupBy("__key").agg(F.sort_array(F.collect_list("copies")).alias("__takings"))
    size = F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long")
    marked = docs.withColumn("__size", size).where("__size > 0").withColumn("__place", place(options.get("seed", SEED)))
    marked = marked.withColumn("__key", key(F.col("__size"))).join(takings, "__key")
    marked = marked.withColumn("__nth", F.row_number().over(Window.partitionBy("__key").orderBy("text")))
    known = marked.withColumn("__copy", F.explode(F.try_element_at("__takings", F.col("__nth"))))
    words = F.col("__copy.words")
    if whole:
        out = known.where(words * 2 >= F.col("__size"))
    else:
        cut = F.concat_ws(" ", F.slice(F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(1)), F.lit(1), words.cast("int")))
        part = words < F.col("__size")
        out = known.withColumn("text", F.when(part, cut).otherwise(F.col("text")))
        if "n_chars" in docs.columns:
            out = out.withColumn("n_chars", F.when(part, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    out = out.withColumn("__slot", F.col("__copy.slot"))
    return out.repartitionByRange(shuffle_partitions(docs.sparkSession), "__slot").sortWithinPartitions("__slot", "__key").select(*docs.columns)
