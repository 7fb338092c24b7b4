"""State machines over held signals: events, blocked attempts, active intervals, and timelines of a condition.

Per tick a machine is told E (enter), X (exit) and T (trigger). E without X sets it, X without E resets it, both toggle
it, neither leaves it: its state is the last set or reset, turned once for each toggle since. That is a scan over ticks
with an associative step, so it runs as window expressions in chunks of time, with one small row per chunk to carry
states over.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelake.operators.align import at_ticks, hold, recorded
from framelake.plans.catalog import Catalog
from framelake.plans.conditions import Compiler, summary
from framelake.plans.functions import Machine
from framelake.sources.places import staged

EVIDENCE = "array<struct<ok: boolean, kind: string, signal: string, op: string, value: string, actual: string, previous: string, margin: double, text: string>>"


def latch(rows: DataFrame, keys: list[str], enter: str = "on_enter", exit_: str = "on_exit", initial: str = "initial") -> DataFrame:
    """rows(keys..., chunk, t, on_enter, on_exit, initial) -> with before and after, the state before and after each tick."""
    sets = F.when(F.col(enter) & ~F.col(exit_), F.lit(1)).when(F.col(exit_) & ~F.col(enter), F.lit(0))
    toggles = (F.col(enter) & F.col(exit_)).cast("int")
    inside = Window.partitionBy(*keys, "chunk").orderBy("t")
    up_to = inside.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("__toggles", F.sum(toggles).over(up_to)).withColumn("__set", sets)
    # A set remembers how many toggles were before it; the parity of those since then turns the state.
    rows = rows.withColumn("__last", F.last(F.when(F.col("__set").isNotNull(), F.struct("__set", "__toggles")), ignorenulls=True).over(up_to))
    whole = rows.groupBy(*keys, "chunk").agg(
        F.max("__toggles").alias("__all"), F.max_by("__last", F.when(F.col("__last").isNotNull(), F.col("t"))).alias("__fixed"), F.first(initial).cast("int").alias("__initial")
    )
    # Over chunks the same once more: what a chunk leaves is fixed by its last set, or turns what it got.
    order = Window.partitionBy(*keys).orderBy("chunk")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    fixed = F.when(F.col("__fixed").isNotNull(), F.pmod(F.col("__fixed.__set") + F.col("__all") - F.col("__fixed.__toggles"), F.lit(2)))
    turned = F.when(F.col("__fixed").isNull(), F.col("__all")).otherwise(F.lit(0))
    whole = whole.withColumn("__turned", F.sum(turned).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    whole = whole.withColumn("__left", F.when(fixed.isNotNull(), F.struct(fixed.alias("state"), F.col("__turned").alias("at"))))
    whole = whole.withColumn("__got", F.last("__left", ignorenulls=True).over(earlier)).withColumn("__so_far", F.coalesce(F.sum(turned).over(earlier), F.lit(0)))
    start = F.pmod(F.coalesce(F.col("__got.state") + F.col("__so_far") - F.col("__got.at"), F.col("__initial") + F.col("__so_far")), F.lit(2))
    rows = rows.join(whole.select(*keys, "chunk", start.alias("__start")), [*keys, "chunk"])
    state = F.pmod(F.coalesce(F.col("__last.__set") + F.col("__toggles") - F.col("__last.__toggles"), F.col("__start") + F.col("__toggles")), F.lit(2))
    rows = rows.withColumn("after", state == 1)
    rows = rows.withColumn("before", F.coalesce(F.lag("after").over(inside), F.col("__start") == 1))
    return rows.drop("__toggles", "__set", "__last", "__start")


def _evaluated(frames: DataFrame, catalog: Catalog, machines: list[Machine], fast: bool, chunk_seconds: float) -> DataFrame:
    """One row per tick and machine: function, position, on_enter, on_exit, on_trigger, initial."""
    names = sorted({n for m in machines for n in m.signals})
    ticks = at_ticks(frames, catalog, names)
    if fast:  # only ticks at which a signal of some machine was recorded, and each log's first
        starts = ticks.groupBy("log_id").agg(F.min("t").alias("__first"))
        ticks = ticks.join(starts, "log_id").where(F.col("sampled") | (F.col("t") == F.col("__first")))
    wide = hold(ticks, names, chunk_seconds)
    return told(wide, catalog, machines, lambda machine: recorded(machine.signals) | (F.col("t") == F.col("__first")) if fast else None).drop("__first")


def told(wide: DataFrame, catalog: Catalog, machines: list[Machine], seen=lambda machine: None) -> DataFrame:
    """wide(log_id, t, cur_<name>, prev_<name>, ...), a row per tick -> one row per tick and machine, with function, position,
    on_enter, on_exit, on_trigger and initial. Of all ticks a machine sees those for which seen(machine) holds; between
    them its signals keep their values, so the tick before is right too."""
    compiler, each = Compiler(catalog), []
    for position, machine in enumerate(machines):
        enter, exit_ = compiler.test(machine.enter), compiler.test(machine.exit) if machine.exit else F.lit(False)
        trigger = compiler.test(machine.trigger) if machine.trigger else F.lit(False)
        one = F.struct(F.lit(machine.id).alias("function"), F.lit(position).alias("position"), enter.alias("on_enter"), exit_.alias("on_exit"), trigger.alias("on_trigger"), F.lit(machine.initial).alias("initial"))
        condition = seen(machine)
        each.append(one if condition is None else F.when(condition, one))
    return wide.withColumn("__m", F.explode(F.array_compact(F.array(*each)))).select("*", "__m.*").drop("__m")


def _by_machine(machines: list[Machine], value, kind: str) -> Column:
    """value(machine) of the row's machine, null for others."""
    case = F
    for machine in machines:
        case = case.when(F.col("function") == machine.id, value(machine))
    return case.otherwise(F.lit(None).cast(kind)) if case is not F else F.lit(None).cast(kind)


def run(frames: DataFrame, catalog: Catalog, machines: list[Machine], fast: bool = False, chunk_seconds: float = 600.0) -> DataFrame:
    """(log_id, function, position, t, on_enter, on_exit, on_trigger, before, after, initial, cur_..., prev_...): all machines at all ticks."""
    return latch(_evaluated(frames, catalog, machines, fast, chunk_seconds), ["log_id", "function"])


def events(steps: DataFrame, catalog: Catalog, machines: list[Machine]) -> DataFrame:
    """(log_id, function, position, type, t, summary, evidence): every enter and exit."""
    compiler = Compiler(catalog)
    changed = steps.where("before <> after").withColumn("type", F.when(F.col("after"), "enter").otherwise("exit"))
    about = _by_machine(machines, lambda m: F.when(F.col("after"), F.lit(summary(m.enter))).otherwise(F.lit(summary(m.exit) if m.exit else "")), "string")
    evidence = _by_machine(machines, lambda m: F.when(F.col("after"), compiler.evidence(m.enter)).otherwise(compiler.evidence(m.exit) if m.exit else compiler.evidence(m.enter)), EVIDENCE)
    return changed.select("log_id", "function", "position", "type", "t", about.alias("summary"), evidence.alias("evidence"))


def attempts(steps: DataFrame, catalog: Catalog, machines: list[Machine]) -> DataFrame:
    """(log_id, function, position, t, trigger, satisfied, blocking): ticks at which the trigger fires, yet the machine
    is off after the tick and its enter condition false."""
    compiler = Compiler(catalog)
    tried = steps.where("on_trigger and not on_enter and not after")
    evidence = _by_machine(machines, lambda m: compiler.evidence(m.enter), EVIDENCE)
    trigger = _by_machine(machines, lambda m: F.lit(summary(m.trigger) if m.trigger else ""), "string")
    rows = tried.select("log_id", "function", "position", "t", trigger.alias("trigger"), evidence.alias("e"))
    return rows.select("log_id", "function", "position", "t", "trigger", F.filter("e", lambda x: x["ok"]).alias("satisfied"), F.filter("e", lambda x: ~x["ok"]).alias("blocking"))


def intervals(steps: DataFrame) -> DataFrame:
    """(log_id, function, start, end, open): when each machine was on. One that starts on is on from the log's first
    tick; one still on at the end is closed at the last tick. Steps are read once, into a small row for each chunk."""
    turned = F.when(F.col("before") != F.col("after"), F.struct("t", F.col("after").alias("on")))
    chunks = staged(steps.groupBy("log_id", "function", "chunk").agg(F.min("t").alias("first"), F.max("t").alias("last"), F.first("initial").alias("initial"), F.array_compact(F.collect_list(turned)).alias("turned")))
    bounds = chunks.groupBy("log_id", "function").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.first("initial").alias("initial"))
    begun = bounds.where("initial").select("log_id", "function", F.col("first").alias("t"), F.lit(True).alias("on"), F.lit(0).alias("nth"))
    both = begun.unionByName(chunks.select("log_id", "function", F.inline("turned")).withColumn("nth", F.lit(1)))
    following = F.lead("t").over(Window.partitionBy("log_id", "function").orderBy("t", "nth"))
    spans = both.withColumn("end", following).where("on").join(bounds.select("log_id", "function", "last"), ["log_id", "function"])
    return spans.select("log_id", "function", F.col("t").alias("start"), F.coalesce("end", "last").alias("end"), F.col("end").isNull().alias("open"))


def watch(frames: DataFrame, catalog: Catalog, condition: dict, chunk_seconds: float = 600.0) -> tuple[DataFrame, DataFrame]:
    """(transitions, intervals) of a condition: transitions (log_id, t, to, summary, evidence), the first tick silently;
    intervals (log_id, start, end) in which it holds, the last one closed at the last tick."""
    from framelake.plans.conditions import normalised, signals_of

    condition = normalised(condition)
    compiler, names = Compiler(catalog), signals_of(condition)
    wide = hold(at_ticks(frames, catalog, names), names, chunk_seconds).withColumn("ok", compiler.test(condition))
    # The condition's truth at the tick before, across chunks: each chunk's last one goes to the next.
    last = staged(wide.groupBy("log_id", "chunk").agg(F.max_by("ok", "t").alias("__left"), F.max("t").alias("__last")))
    ends = last.groupBy("log_id").agg(F.max("__last").alias("last"))
    got = last.select("log_id", "chunk", F.lag("__left").over(Window.partitionBy("log_id").orderBy("chunk")).alias("__got"))
    inside = Window.partitionBy("log_id", "chunk").orderBy("t")
    wide = wide.join(got, ["log_id", "chunk"]).withColumn("was", F.coalesce(F.lag("ok").over(inside), F.col("__got")))
    turned = wide.where("was is null or ok <> was")  # few: both tables come of them
    turned = staged(turned.select("log_id", "t", "ok", "was", compiler.evidence(condition).alias("evidence")))
    transitions = turned.where("was is not null").select("log_id", "t", F.col("ok").alias("to"), F.lit(summary(condition)).alias("summary"), "evidence")
    spans = turned.withColumn("end", F.lead("t").over(Window.partitionBy("log_id").orderBy("t"))).where("ok").join(ends, "log_id")
    return transitions, spans.select("log_id", F.col("t").alias("start"), F.coalesce("end", "last").alias("end"))
