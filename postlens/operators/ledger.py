"""The task ledger as a log of events: many events a task, replayed in order, and the attempts that they make.

An event maps every state that a task can be in to the state after it, the attempts it adds and the result it leaves.
Such maps compose associatively, so what a stretch of a task's log does is one small map, whatever the state it begins in.
The log is dealt into ranges of (task, order); of tasks whose log lies in several ranges each range is first summed up as its map, the
maps are applied one after the other, and then every range is replayed from the state that it begins in.
"""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlens.operators.scan import PART, deal, of_keys, spread
from postlens.operators.tasks import TRANSITIONS
from postlens.workspace import stage

STATES = ("pending", "running", "succeeded", "failed")


def after(status: str, result: str | None, event: str, given: str | None) -> tuple[str, str | None, int, bool]:
    """(status, result, attempts added, accepted) after one event. A result that repeats a success unchanged is accepted, and changes nothing."""
    new = TRANSITIONS.get((status, event))
    if new is None:
        return status, result, 0, status == "succeeded" and event == "succeed" and given == result
    return new, given if new == "succeeded" else result, int(new == "running"), True


def compose(first: dict, then: dict) -> dict:
    """The map of two stretches: {state: (end, attempts added, result or None if it is not touched, whether it is touched)}."""
    out = {}
    for s, (end, n, result, touched) in first.items():
        end2, n2, result2, touched2 = then[end]
        out[s] = (end2, n + n2, result2 if touched2 else result, touched or touched2)
    return out


def of_event(event: str, given: str | None) -> dict:
    out = {}
    for s in STATES:
        new = TRANSITIONS.get((s, event))
        out[s] = (new or s, int(new == "running"), given if new == "succeeded" else None, new == "succeeded")
    return out


IDENTITY = {s: (s, 0, None, False) for s in STATES}


def _maps(rows: DataFrame, id_: str) -> DataFrame:
    """One row per task and range: the composed map as columns."""
    names = [f"{c}_{s}" for s in STATES for c in ("end", "n", "result", "touched")]
    types = {"end": "string", "n": "long", "result": "string", "touched": "boolean"}

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        whole = IDENTITY
        for event, given in zip(pdf.sort_values("_order")["event"], pdf.sort_values("_order")["result"]):
            whole = compose(whole, of_event(event, given))
        return pd.DataFrame([[pdf[id_].iloc[0], pdf[PART].iloc[0], *[v for s in STATES for v in whole[s]]]], columns=[id_, PART, *names])

    kind = rows.schema[id_].dataType.simpleString()
    schema = f"`{id_}` {kind}, {PART} int, " + ", ".join(f"{n} {types[n.split('_')[0]]}" for n in names)
    return rows.groupBy(id_, PART).applyInPandas(fold, schema)


def replay(tasks: DataFrame, events: DataFrame, order: str, id_: str = "task_id", parts: int | None = None) -> DataFrame:
    """events with status_before, accepted, status_after, attempt (starts so far) and is_last (of its task), in the order of a whole number column.

    tasks: id, status, attempts and result, one row each. events: id, event, result (null unless it succeeds) and the
    order, distinct within a task. Events of unknown tasks are rejected and have null states; they come back too.
    """
    own = events.select(id_, "event", "result", F.col(order).cast("long").alias("_order"))
    dealt = deal(own, [id_], ["_order"], parts)
    wide = stage(spread(dealt, [id_]), "ledger-wide")
    maps = _maps(of_keys(dealt, wide, [id_]), id_)
    kind = events.schema[id_].dataType.simpleString()
    starting = tasks.select(id_, "status", F.col("attempts").cast("long").alias("attempts"), F.col("result").alias("held"))

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, now = [], None
        for r in pdf.sort_values(PART).itertuples():
            status, n, held = now or (r.status, int(r.attempts), r.held)
            rows.append([getattr(r, id_), getattr(r, "part_no"), status, n, held])
            step = lambda c: getattr(r, f"{c}_{status}")  # noqa: B023, E731
            now = (step("end"), n + int(step("n")), step("result") if step("touched") else held)
        return pd.DataFrame(rows, columns=[id_, PART, "_status", "_attempts", "_held"])

    # a row for each range that a task lies in; itertuples has no names that begin with a line
    entered = maps.withColumn("part_no", F.col(PART)).join(starting, id_).groupBy(id_).applyInPandas(walk, f"`{id_}` {kind}, {PART} int, _status string, _attempts long, _held string")
    first = dealt.join(starting, id_, "left").join(F.broadcast(entered), [id_, PART], "left").withColumn("known", F.col("status").isNotNull())
    ready = first.select(
        id_, PART, "_order", "event", "result", "known", F.coalesce("_status", "status").alias("status"), F.coalesce("_attempts", "attempts").alias("attempts"),
        F.when(F.col("_status").isNotNull(), F.col("_held")).otherwise(F.col("held")).alias("held"),
    )
    schema = f"`{id_}` {kind}, {PART} int, {order} long, event string, result string, status_before string, accepted boolean, status_after string, attempt long, held_after string"
    names = [id_, PART, order, "event", "result", "status_before", "accepted", "status_after", "attempt", "held_after"]

    def run(batches):
        at, now = None, None
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in (id_, PART, "_order", "event", "result", "known", "status", "attempts", "held")]
            out = []
            for task, part, order_, event, given, known, status, attempts, held in zip(*columns):
                if at != (task, part):
                    at, now = (task, part), (status, held, attempts)
                if not known:
                    out.append((task, part, order_, event, given, None, False, None, None, None))
                    continue
                before = now[0]
                status, held, n, fine = after(*now[:2], event, given)
                now = (status, held, now[2] + n)
                out.append((task, part, order_, event, given, before, fine, status, now[2], held))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), [batch.schema.field(id_).type, pa.int32(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.string(), pa.int64(), pa.string()])], names=names)

    n = parts or int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stage(ready.repartition(n, id_, PART).sortWithinPartitions(id_, PART, "_order").mapInArrow(run, schema), "replayed").drop(PART)


def rejected(replayed: DataFrame, order: str, id_: str = "task_id") -> DataFrame:
    """The events that did nothing and should have, one by one."""
    return replayed.where("not accepted").select(id_, order, "event", F.col("status_before").alias("status"))


def states(tasks: DataFrame, replayed: DataFrame, order: str, id_: str = "task_id") -> DataFrame:
    """tasks with the status, attempts and result after their last event."""
    last = replayed.where("status_after is not null").groupBy(id_).agg(F.max_by(F.struct("status_after", "attempt", "held_after"), order).alias("_l"))
    both = tasks.join(last, id_, "left")
    now = {"status": F.coalesce("_l.status_after", "status"), "attempts": F.coalesce("_l.attempt", "attempts"), "result": F.when(F.col("_l").isNotNull(), F.col("_l.held_after")).otherwise(F.col("result"))}
    return both.withColumns(now).drop("_l")


def attempts(replayed: DataFrame, order: str, id_: str = "task_id") -> DataFrame:
    """One row per task and attempt: started and finished (orders), outcome (succeeded, failed, recovered; null while it runs) and result."""
    moved = replayed.where("accepted and status_before <> status_after and event <> 'retry'")
    ended = F.when(F.col("event") == "succeed", "succeeded").when(F.col("event") == "fail", "failed").when(F.col("event") == "recover", "recovered")
    return moved.groupBy(id_, "attempt").agg(
        F.min(F.when(F.col("event") == "start", F.col(order))).alias("started"), F.max(F.when(ended.isNotNull(), F.col(order))).alias("finished"),
        F.max(ended).alias("outcome"), F.max(F.when(F.col("event") == "succeed", F.col("result"))).alias("result"),
    )


def append_attempts(ledger: DataFrame, new: DataFrame, id_: str = "task_id") -> DataFrame:
    """ledger with the attempts that it lacks; an attempt that comes again finishes its row if that is open, and else changes nothing."""
    both = ledger.withColumn("_new", F.lit(0)).unionByName(new.select(*ledger.columns).withColumn("_new", F.lit(1)))
    rest = [c for c in ledger.columns if c not in (id_, "attempt")]
    # a finished row goes before an open one, an older one before a newer one
    rank = F.struct((F.col("finished").isNull()).cast("int").alias("open"), "_new")
    return both.groupBy(id_, "attempt").agg(*[F.min_by(F.struct(F.col(c)), rank)[c].alias(c) for c in rest]).select(*ledger.columns)


def attempt_counts(ledger: DataFrame, id_: str = "task_id") -> DataFrame:
    """Attempts of every task, by outcome, from the ledger alone."""
    n = lambda c, name: F.count_if(c).alias(name)
    return ledger.groupBy(id_).agg(F.count("*").alias("attempts"), n(F.col("outcome") == "failed", "n_failed"), n(F.col("outcome") == "recovered", "n_recovered"), n(F.col("outcome").isNull(), "n_open"), F.max(F.when(F.col("outcome") == "succeeded", F.col("attempt"))).alias("succeeded_at"))
