"""Alert conditions and the alert state machine."""

from __future__ import annotations

import sys
from collections.abc import Iterable
from dataclasses import dataclass, replace

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from telmora.functions.integers import floor_div
from telmora.operators.logs import search_logs
from telmora.operators.traces import trace_summaries
from telmora.runtime import checkpointed
from telmora.schema import NS_PER_S

# On streams ``advance`` runs on workers; it travels with its code, so they need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Alert states.
OK, PENDING, FIRING, RESOLVED = "Ok", "Pending", "Firing", "Resolved"


def metric_condition(vector: DataFrame) -> DataFrame:
    """Per step: fires if any sample is neither 0 nor NaN; the value is the greatest of those, else 0."""
    hit = ~F.isnan("value") & (F.col("value") != 0)
    return vector.groupBy("t_ms").agg(
        (F.count(F.when(hit, 1)) > 0).alias("firing"),
        F.coalesce(F.max(F.when(hit, F.col("value"))), F.lit(0.0)).alias("value"),
        F.count(F.when(hit, 1)).alias("hits"),
        F.count(F.lit(1)).alias("total"),
    ).withColumn(
        "message",
        F.when(F.col("firing"), F.concat_ws("/", F.col("hits").cast("string"), F.col("total").cast("string"))),
    )


def _count_condition(matches: DataFrame, threshold: int) -> DataFrame:
    counted = matches.agg(F.count(F.lit(1)).cast("double").alias("value"))
    return counted.select((F.col("value") > threshold).alias("firing"), "value")


def log_condition(
    logs: DataFrame,
    now_ns: int,
    window_s: int,
    threshold: int,
    text: str | None = None,
    min_severity: int | None = None,
) -> DataFrame:
    """Fires if more than ``threshold`` logs of the window match; the value is their number."""
    since = now_ns - max(1, window_s) * NS_PER_S
    found = search_logs(logs, text=text, min_severity=min_severity, from_ns=since, to_ns=now_ns)
    return _count_condition(found.select("ts_unix_nano"), threshold)


def trace_condition(
    spans: DataFrame,
    now_ns: int,
    window_s: int,
    threshold: int,
    has_error: bool | None = None,
    service_name: str | None = None,
    name_contains: str | None = None,
) -> DataFrame:
    """Fires if more than ``threshold`` traces of the window match; the value is their number."""
    since = now_ns - max(1, window_s) * NS_PER_S
    found = trace_summaries(
        spans, since, now_ns, has_error, service_name=service_name, name_contains=name_contains
    )
    return _count_condition(found.select("trace_id"), threshold)


@dataclass
class RuleState:
    """Persisted state of one rule; ``state`` None means never stored."""

    state: str | None = None
    since_ms: int | None = None
    notified_ms: int | None = None
    last_value: float | None = None
    eval_ms: int | None = None


def advance(
    s: RuleState, now: int, firing: bool, value: float, enabled: bool, for_s: int, every_s: int
) -> tuple[RuleState, str | None] | None:
    """State after one evaluation and the notification it causes; None if the tick leaves no trace.

    Ok → Pending → Firing → Resolved → Ok. Pending becomes Firing once it has lasted ``for_s`` (at the
    earliest on the tick after). Firing notifies once; Resolved notifies if Firing did. A disabled rule
    resolves if it was firing, else returns to Ok. Ticks closer than ``every_s`` to the last evaluation
    are skipped.
    """
    if every_s > 0 and s.eval_ms is not None and now - s.eval_ms < every_s * 1000:
        return None
    if not enabled:
        if s.state is None or s.state == OK:
            return None
        target = RESOLVED if s.state == FIRING else OK
        return replace(s, state=target, since_ms=now, eval_ms=now), (RESOLVED if s.state == FIRING else None)
    state = s.state or OK
    since = now if s.since_ms is None else s.since_ms
    notified, notify = s.notified_ms, None
    if firing:
        if state == PENDING and now - since >= for_s * 1000:
            state, notified, notify = FIRING, now, FIRING
        elif state in (OK, RESOLVED):
            notified = notified if state == OK else None
            state, since = PENDING, now
    elif state == FIRING:
        notify = RESOLVED if notified is not None else None
        state, since = RESOLVED, now
    elif state in (PENDING, RESOLVED):
        state, since, notified = OK, now, None
    last = value if firing or s.last_value is None else s.last_value
    return RuleState(state, since, notified, last, now), notify


HISTORY = (
    "rule_id string, t_ms long, state string, since_ms long, notified_ms long, last_value double, "
    "value double, notify string"
)


def state_history(ticks: DataFrame, rules: DataFrame) -> DataFrame:
    """Run the state machine over the ticks of each rule; one row per tick that stores a state.

    ``ticks``: ``rule_id, t_ms, firing, value`` — one row per rule and evaluation. ``rules``: ``rule_id,
    enabled, for_s, every_s``. Gives what ``advance`` gives tick by tick from an unknown state, so a disabled
    rule stores nothing. Of ticks of a rule at one time the one with the greatest (firing, value) counts; a
    null condition does not fire; ticks without a rule or time, or of unknown rules, fall out.

    States follow from runs of equal conditions: the first tick of a firing run is Pending, later ones are Firing
    once ``for_s`` have passed since; the first quiet tick after Firing is Resolved. A rule's time is cut into
    chunks. What a chunk must know of the ones before it is one row of a small table (last condition, start of
    the run, when it fired), composed over chunks in two rounds, so no rule meets in one task.
    """
    settings = rules.where("enabled").select(
        "rule_id", (F.col("for_s") * F.lit(1000).cast("long")).alias("for_ms"), (F.col("every_s") * F.lit(1000).cast("long")).alias("every_ms")
    )
    best = F.max(F.struct(F.coalesce("firing", F.lit(False)).alias("firing"), F.col("value").cast("double").alias("value")))
    one = (
        ticks.where("rule_id is not null and t_ms is not null")
        .groupBy("rule_id", "t_ms").agg(best.alias("x"))
        .select("rule_id", "t_ms", "x.firing", "x.value")
        .join(settings, "rule_id")
    )
    return _states(_evaluated(one, settings))


def _evaluated(ticks: DataFrame, settings: DataFrame) -> DataFrame:
    """Ticks that are at least ``every_ms`` after the evaluated one before; the first one always is.

    Every tick points to the one that would follow it. The ticks reached from the first are found by doubling
    the pointers, so rounds grow with the logarithm of the number of evaluations. Only rules with a pause take part.
    """
    if settings.where("every_ms > 0").isEmpty():
        return ticks
    paced = ticks.where("every_ms > 0")
    at = paced.select("rule_id", "t_ms", F.col("t_ms").alias("at"), F.lit(1).alias("is_tick"))
    due = paced.select("rule_id", "t_ms", (F.col("t_ms") + F.col("every_ms")).alias("at"), F.lit(0).alias("is_tick"))
    chunk = floor_div(F.col("at"), CHUNK_MS)
    both = at.unionByName(due).withColumn("chunk", chunk).repartition("rule_id", "chunk")
    later = Window.partitionBy("rule_id").orderBy(F.col("chunk").desc()).rowsBetween(Window.unboundedPreceding, -1)
    firsts = both.groupBy("rule_id", "chunk").agg(F.min(F.when(F.col("is_tick") == 1, F.col("at"))).alias("first"))
    following = firsts.withColumn("after", F.min("first").over(later)).select("rule_id", "chunk", "after")
    # backwards in time, a due time follows the ticks at or after it
    backwards = Window.partitionBy("rule_id", "chunk").orderBy(F.col("at").desc(), F.col("is_tick").desc())
    seen = F.min(F.when(F.col("is_tick") == 1, F.col("at"))).over(backwards.rowsBetween(Window.unboundedPreceding, 0))
    found = both.withColumn("next", seen).where("is_tick = 0").join(following, ["rule_id", "chunk"], "left")
    jumps = checkpointed(
        found.select("rule_id", "t_ms", F.coalesce("next", "after").alias("next")).where("next is not null")
    )
    reached = paced.groupBy("rule_id").agg(F.min("t_ms").alias("t_ms"))
    while not jumps.isEmpty():  # ``jumps`` leads 2^k evaluations ahead, ``reached`` holds the first 2^k ones
        ahead = reached.join(jumps, ["rule_id", "t_ms"]).select("rule_id", F.col("next").alias("t_ms"))
        reached = checkpointed(reached.unionByName(ahead))
        on = jumps.select("rule_id", F.col("t_ms").alias("next"), F.col("next").alias("next2"))
        jumps = checkpointed(jumps.join(on, ["rule_id", "next"]).select("rule_id", "t_ms", F.col("next2").alias("next")))
    return ticks.where("every_ms <= 0").unionByName(paced.join(reached, ["rule_id", "t_ms"], "left_semi").select(*ticks.columns))


#: Length of a chunk of a rule's ticks; a chunk and the table of a rule's chunks fit a task.
CHUNK_MS = 86_400_000


def _states(ticks: DataFrame) -> DataFrame:
    keys = ["rule_id", "chunk"]
    rows = ticks.withColumn("chunk", floor_div(F.col("t_ms"), CHUNK_MS)).repartition(*keys)
    w = Window.partitionBy(*keys).orderBy("t_ms")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    chunks = Window.partitionBy("rule_id").orderBy("chunk")
    earlier = chunks.rowsBetween(Window.unboundedPreceding, -1)
    sofar = chunks.rowsBetween(Window.unboundedPreceding, 0)

    # Round one: the tick before, the start of the run, the last firing value.
    firing_at = F.when(F.col("firing"), F.col("t_ms"))
    edge = F.when(F.col("firing") != F.lag("firing").over(w), F.col("t_ms"))
    local = rows.withColumn("edge", edge)
    ends = (
        local.groupBy(*keys)
        .agg(
            F.min(F.struct("t_ms", "firing", "value")).alias("first"), F.max(F.struct("t_ms", "firing")).alias("last"), F.max("edge").alias("edge"),
            F.max(F.struct(firing_at.alias("t"), F.col("value").alias("v"))).alias("fired"),
        )
        .withColumn("before", F.lag("last").over(chunks))
        .withColumn("opens", F.coalesce(F.col("before.firing") != F.col("first.firing"), F.lit(True)))
        .withColumn("own_start", F.coalesce("edge", F.when(F.col("opens"), F.col("first.t_ms"))))
        .withColumn("start", F.last("own_start", ignorenulls=True).over(sofar))
        .withColumn("fired", F.last(F.when(F.col("fired.t").isNotNull(), F.col("fired")), ignorenulls=True).over(earlier))
        .withColumn("origin", F.first("first").over(sofar))
        .select(
            *keys, "before", F.when(F.col("opens"), F.col("first.t_ms")).otherwise(F.lag("start").over(chunks)).alias("start0"),
            F.lag("start").over(chunks).alias("start_before"), "fired", "origin",
        )
    )
    known = rows.join(ends, keys)
    first_in_chunk = F.lag("t_ms").over(w).isNull()
    known = (
        known.withColumn("prev_t", F.when(first_in_chunk, F.col("before.t_ms")).otherwise(F.lag("t_ms").over(w)))
        .withColumn("prev_firing", F.when(first_in_chunk, F.col("before.firing")).otherwise(F.lag("firing").over(w)))
        .withColumn("edge", F.when(F.col("firing") != F.lag("firing").over(w), F.col("t_ms")))
        .withColumn("start", F.coalesce(F.max("edge").over(upto), F.col("start0")))
        .withColumn("prev_start", F.when(first_in_chunk, F.col("start_before")).otherwise(F.lag("start").over(w)))
        .withColumn("last_fired", F.coalesce(F.max(F.when(F.col("firing"), F.struct(F.col("t_ms").alias("t"), F.col("value").alias("v")))).over(upto), F.col("fired")))
        .withColumn("last_value", F.when(F.col("last_fired").isNull(), F.col("origin.value")).otherwise(F.col("last_fired.v")))
    )

    def up(firing: str, t: str, start: str) -> Column:
        """Whether a tick is in state Firing."""
        return F.coalesce(F.col(firing) & (F.col(t) > F.col(start)) & (F.col(t) - F.col(start) >= F.col("for_ms")), F.lit(False))

    known = known.withColumn("up", up("firing", "t_ms", "start")).withColumn("prev_up", up("prev_firing", "prev_t", "prev_start"))
    resolved = ~F.col("firing") & F.col("prev_up")
    # the tick after Resolved
    after_quiet = ~F.col("firing") & (F.col("prev_firing") == F.lit(False)) & (F.col("prev_t") == F.col("start"))
    marked = known.withColumn("fire", F.when(F.col("up") & ~F.col("prev_up"), F.col("t_ms"))).select(
        *keys, "t_ms", "firing", "value", "last_value", "start", "up", resolved.alias("resolved"), "fire",
        F.when(after_quiet, F.col("t_ms")).alias("ok_after"),
        F.when(resolved, F.col("t_ms")).alias("down"),
    )

    # Round two: the latest of each of these events before a chunk.
    events = ["fire", "ok_after", "down"]
    carried = marked.groupBy(*keys).agg(*[F.max(e).alias(e) for e in events])
    carried = carried.select(*keys, *[F.max(e).over(earlier).alias(f"{e}0") for e in events])
    full = marked.join(carried, keys).select(
        "*", *[F.coalesce(F.max(e).over(upto), F.col(f"{e}0")).alias(f"{e}_t") for e in events]
    )
    state = (
        F.when(F.col("up"), FIRING).when(F.col("firing"), PENDING).when(F.col("resolved"), RESOLVED).otherwise(OK)
    )
    # a quiet run that began with Resolved is Ok since its second tick, others since their first
    was_down = F.coalesce(F.col("down_t") == F.col("start"), F.lit(False))
    since = F.when(F.col("firing") | F.col("resolved") | ~was_down, F.col("start")).otherwise(F.col("ok_after_t"))
    notify = F.when(F.col("fire").isNotNull(), FIRING).when(F.col("resolved"), RESOLVED)
    return full.select(
        "rule_id", "t_ms", state.alias("state"), since.alias("since_ms"),
        F.when(F.col("up") | F.col("resolved"), F.col("fire_t")).alias("notified_ms"), "last_value", "value", notify.alias("notify"),
    )


def transitions(history: DataFrame) -> DataFrame:
    """The rows that notify: Firing and Resolved."""
    return history.where(F.col("notify").isNotNull())


def latest_states(history: DataFrame) -> DataFrame:
    """Newest state row per rule."""
    row = F.struct("t_ms", "state", "since_ms", "notified_ms", "last_value")
    return history.groupBy("rule_id").agg(F.max(row).alias("s")).select("rule_id", "s.*")


def rules_in_state(rules: DataFrame, states: DataFrame, state: str | None = None) -> DataFrame:
    """Rules with their current state (Ok if unknown), optionally only those in one state (any case)."""
    out = rules.join(states.select("rule_id", "state"), "rule_id", "left").withColumn(
        "state", F.coalesce("state", F.lit(OK))
    )
    return out if not state else out.where(F.lower("state") == state.lower())


def state_overview(rules: DataFrame, states: DataFrame, shown: Iterable[str] = (FIRING, PENDING, RESOLVED)) -> DataFrame:
    """Number of rules per active state."""
    return (
        rules_in_state(rules, states)
        .where(F.col("state").isin(list(shown)))
        .groupBy("state")
        .agg(F.count(F.lit(1)).alias("rules"))
    )
