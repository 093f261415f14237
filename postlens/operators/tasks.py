"""The task ledger as snapshots: preparation, reuse, transitions, attempts and extraction by a user's function."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postlens.operators.joins import keys_of_batches
from postlens.operators.search import places

#: Allowed transitions: (status, event) to the new status. Success never changes.
TRANSITIONS = {("pending", "start"): "running", ("running", "succeed"): "succeeded", ("running", "fail"): "failed", ("failed", "retry"): "pending", ("running", "recover"): "pending"}


def select_tasks(latest: DataFrame, observed: DataFrame, key: str, batch: str, post_key=None, batches: list | None = None, rerun: bool = False) -> DataFrame:
    """The latest observations to prepare: of one key, of all keys that some batches saw, or all.

    An unknown key, an unknown or empty batch, and a rerun without a key are errors.
    """
    if rerun and post_key is None:
        raise ValueError("a rerun needs a key, so that other results stay")
    out = latest
    if batches:
        known = {r[0] for r in observed.where(F.col(batch).isin(*batches)).select(batch).distinct().collect()}
        if lacking := sorted(set(batches) - known):
            raise ValueError(f"unknown or empty batches: {lacking}")
        out = out.join(keys_of_batches(observed, key, batch, batches), key, "left_semi")
    if post_key is not None:
        out = out.where(F.col(key) == post_key)
        if out.isEmpty():
            raise ValueError(f"unknown key: {post_key}")
    return out


def targets(pointers: DataFrame, tasks: DataFrame, id_: str = "task_id") -> DataFrame:
    """The task that each target names."""
    return pointers.join(tasks, id_)


def reuse(tasks: DataFrame, contract: list[str], finished: str = "finished_at", id_: str = "task_id") -> DataFrame:
    """The newest succeeded task of every key and contract."""
    w = Window.partitionBy(*contract).orderBy(F.desc(finished), F.desc(id_))
    return tasks.where("status = 'succeeded'").withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def prepare(latest: DataFrame, tasks: DataFrame, contract: list[str], id_: Column) -> DataFrame:
    """One task per latest observation: an equal one is reused (reused_from), else it is pending. latest has the contract columns."""
    old = reuse(tasks, contract).select(*contract, F.col("task_id").alias("reused_from"), F.col("result").alias("_result"))
    joined = latest.join(old, contract, "left")
    return joined.withColumns({"task_id": id_, "status": F.when(F.col("reused_from").isNotNull(), "succeeded").otherwise("pending"), "result": F.col("_result")}).drop("_result")


def upsert(targets: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """New rows replace those of their key."""
    return targets.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def transition(tasks: DataFrame, events: DataFrame, id_: str = "task_id") -> tuple[DataFrame, DataFrame]:
    """(tasks after one event each, rejected events). A result that repeats a success unchanged is no error.

    events: id, event, and result (null unless it succeeds).
    """
    table = F.create_map(*[F.lit(x) for (s, e), new in TRANSITIONS.items() for x in (f"{s}:{e}", new)])
    both = tasks.join(events.withColumnRenamed("result", "_result"), id_, "left")
    new = F.try_element_at(table, F.concat_ws(":", "status", "event"))
    same = (F.col("status") == "succeeded") & (F.col("event") == "succeed") & F.col("result").eqNullSafe(F.col("_result"))
    after = both.withColumns({"result": F.when(new == "succeeded", F.col("_result")).otherwise(F.col("result")), "attempts": F.col("attempts") + F.when(new == "running", 1).otherwise(0), "status": F.coalesce(new, "status")}).drop("event", "_result")
    wrong = both.where(F.col("event").isNotNull() & new.isNull() & ~same).select(id_, "status", "event")
    unknown = events.join(tasks.select(id_), id_, "left_anti").select(id_, F.lit(None).cast("string").alias("status"), "event")
    return after, wrong.unionByName(unknown)


def claimable(tasks: DataFrame, most_attempts: int, limit: int, order: list[str]) -> DataFrame:
    """Pending tasks and failed ones with attempts left, in order, at most ``limit``."""
    return tasks.where((F.col("status") == "pending") | (F.col("status") == "failed") & (F.col("attempts") < most_attempts)).orderBy(*order).limit(limit)


def claim_posts(tasks: DataFrame, post: str, order: str, most_attempts: int, limit: int) -> DataFrame:
    """Claimable tasks of the first ``limit`` distinct posts in order; a post's tasks are claimed together."""
    able = tasks.where((F.col("status") == "pending") | (F.col("status") == "failed") & (F.col("attempts") < most_attempts))
    first = able.groupBy(post).agg(F.min(order).alias("_first")).orderBy("_first", post).limit(limit)
    return able.join(first.select(post), post, "left_semi")


def open_ids(tasks: DataFrame, id_: str = "task_id") -> DataFrame:
    """The ids that a summary calls incomplete, and whether they failed."""
    return tasks.where("status <> 'succeeded'").select(id_, (F.col("status") == "failed").alias("failed"))


def chunks(df: DataFrame, order: list[str], size: int) -> DataFrame:
    """Adds chunk: the number (from 0) of a row's group of ``size`` rows in a total order, of any number of rows."""
    if not 1 <= size <= 100:
        raise ValueError("chunk size must be from 1 to 100")
    return places(df, [F.col(c) for c in order], name="_place").withColumn("chunk", F.floor((F.col("_place") - 1) / size)).drop("_place")


def latest_attempt(attempts: DataFrame, id_: str = "task_id", number: str = "attempt") -> DataFrame:
    w = Window.partitionBy(id_).orderBy(F.desc(number))
    return attempts.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def summary(tasks: DataFrame, by: list[str] | None = None) -> DataFrame:
    n = lambda v: F.count_if(F.col("status") == v).alias(v)
    return tasks.groupBy(*by or []).agg(
        F.count("*").alias("total"), n("pending"), n("running"), n("succeeded"), n("failed"), F.count_if(F.col("reused_from").isNotNull()).alias("reused"),
        F.count_if(F.coalesce("needs_review", F.lit(False))).alias("needs_review"), F.coalesce(F.bool_or(F.col("status") != "succeeded"), F.lit(False)).alias("partial"),
    )


def progress(tasks: DataFrame, most_attempts: int) -> DataFrame:
    n = lambda v: F.count_if(F.col("status") == v).alias(v)
    failed = F.col("status") == "failed"
    return tasks.agg(n("pending"), n("running"), n("succeeded"), n("failed"), F.count_if(failed & (F.col("attempts") < most_attempts)).alias("retry_pending"), F.count_if(failed & (F.col("attempts") >= most_attempts)).alias("exhausted"))


def accept_results(tasks: DataFrame, results: DataFrame, valid: Column, contract: str, id_: str = "task_id") -> DataFrame:
    """An outcome for every result: accepted, unknown, duplicate, old_contract or invalid. ``valid`` is about result columns."""
    repeated = results.groupBy(id_).agg(F.count("*").alias("_times"))
    own = tasks.select(id_, F.col(contract).alias("_contract"))
    both = results.join(repeated, id_).join(own, id_, "left")
    outcome = F.when(F.col("_contract").isNull(), "unknown").when(F.col("_times") > 1, "duplicate").when(F.col("_contract") != F.col(contract), "old_contract").when(~F.coalesce(valid, F.lit(False)), "invalid").otherwise("accepted")
    return both.withColumn("outcome", outcome).drop("_times", "_contract")


def extract(tasks: DataFrame, call: Callable[[pd.DataFrame], list], most_attempts: int = 3, batch_size: int = 50) -> DataFrame:
    """task_id, result, error and attempts, from a user's function over batches of tasks.

    call gets a pandas frame of up to batch_size tasks (task_id, context, error of the attempt before) and returns a JSON
    text for each row, None or an exception where there is none. Rows without a text are tried again together, with
    their error; after a call that raises, each of its rows by itself, so that one cannot fail the others. Runs where the tasks are.
    """

    def run(batches):
        for pdf in batches:
            for at in range(0, len(pdf), batch_size):
                left = pdf.iloc[at : at + batch_size][["task_id", "context"]].assign(error=None, result=None, attempts=0)
                alone = False
                for n in range(1, most_attempts + 1):
                    open_ = left.index[left["result"].isna()]
                    for rows in [open_[k : k + 1] for k in range(len(open_))] if alone else [open_] if len(open_) else []:
                        left.loc[rows, "attempts"] = n
                        try:
                            said = list(call(left.loc[rows]))
                            if len(said) != len(rows):
                                raise ValueError(f"{len(said)} answers for {len(rows)} tasks")
                        except Exception as e:  # noqa: BLE001  a user's function may raise anything; its text is the result
                            said, alone = [e] * len(rows), True
                        for i, text in zip(rows, said):
                            wrong = text is None or isinstance(text, Exception)
                            left.loc[i, "result"] = None if wrong else text
                            left.loc[i, "error"] = (str(text)[:500] if isinstance(text, Exception) else "no answer") if wrong else None
                yield left[["task_id", "result", "error", "attempts"]]

    return tasks.mapInPandas(run, "task_id string, result string, error string, attempts long")


def frozen(selection: DataFrame, now: DataFrame, id_: str = "task_id", settings: tuple[dict, dict] = ({}, {})) -> DataFrame:
    """What changed since a selection was frozen: (task_id, change); no rows means the handoff still holds.

    settings: contract versions and dataset, frozen and now; each that differs is a row without an id.
    """
    gone, new = selection.select(id_).exceptAll(now.select(id_)), now.select(id_).exceptAll(selection.select(id_))
    out = gone.withColumn("change", F.lit("gone")).unionByName(new.withColumn("change", F.lit("new")))
    then, since = settings
    for name in sorted(n for n in {*then, *since} if then.get(n) != since.get(n)):
        out = out.unionByName(selection.sparkSession.range(1).select(F.lit(None).cast(selection.schema[id_].dataType).alias(id_), F.lit(f"changed {name}").alias("change")))
    return out
