"""State folds, run pairs and audit counts: a batch form, and a Structured Streaming form that agrees with it."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: The states that may follow each state.
NEXT_STATES = {
    "PENDING": ("BACKED_UP", "DROPPED", "CREATED", "FAILED"),
    "BACKED_UP": ("CREATED", "FAILED", "ROLLED_BACK"),
    "DROPPED": ("CREATED", "FAILED"),
    "CREATED": ("MIGRATED", "COMPLETED", "SKIPPED", "FAILED", "ROLLED_BACK"),
    "MIGRATED": ("COMPLETED", "FAILED"),
    "COMPLETED": (),
    "SKIPPED": (),
    "FAILED": ("BACKED_UP", "DROPPED", "CREATED", "MIGRATED", "COMPLETED", "ROLLED_BACK"),
    "ROLLED_BACK": (),
}
LEGAL = tuple((a, b) for a, after in NEXT_STATES.items() for b in after)
#: States that end an attempt, and those of them that clear the error of an earlier one.
TERMINAL, CLEARING = ("COMPLETED", "SKIPPED", "FAILED", "ROLLED_BACK"), ("COMPLETED", "SKIPPED", "ROLLED_BACK")
_FOLDED = "object string, state string, started_at timestamp, completed_at timestamp, error string, n_events long, n_illegal long"


def fold_state(events: DataFrame) -> DataFrame:
    """events(object, seq, ts, state, error) -> (object, state, started_at, completed_at, error, n_events, n_illegal).

    The first event starts an object; completed_at is the time of its last terminal event, also when a new attempt follows;
    an event's error stays until another error or a clearing state.
    """
    before = F.lag("state").over(W.partitionBy("object").orderBy("ts", "seq"))
    pair = F.concat_ws(">", F.col("__before"), F.col("state"))
    legal = pair.isin(*[f"{a}>{b}" for a, b in LEGAL]) | F.col("__before").isNull()
    marked = events.withColumn("__before", before).withColumn("__illegal", ~legal)
    place = F.struct("ts", "seq")
    sets = F.col("error").isNotNull() | F.col("state").isin(*CLEARING)
    folded = marked.groupBy("object").agg(
        F.max_by("state", place).alias("state"), F.min("ts").alias("started_at"), F.max(F.when(F.col("state").isin(*TERMINAL), F.col("ts"))).alias("completed_at"),
        F.max_by(F.struct("error"), F.when(sets, place)).alias("error"), F.count("*").alias("n_events"), F.count_if("__illegal").alias("n_illegal"))
    return folded.withColumn("error", F.col("error.error"))


class _Fold(StatefulProcessor):
    """Of an object: its fold up to the watermark, and its later events, which are folded in event order with those still to come.

    Events older than the watermark no longer arrive, so what lies before it is settled and kept as one fold. A timer ends
    objects in a state that nothing may follow.
    """

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("fold", "ts array<timestamp>, seq array<long>, state array<string>, error array<string>, last string, started timestamp, done timestamp, failure string, n long, bad long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        moment = lambda t: None if t is None or pd.isna(t) else pd.Timestamp(t).to_pydatetime()
        settled, open_ = (None, None, None, None, 0, 0), []
        if self.kept.exists():
            ts, seq, state, error, *rest = self.kept.get()
            open_ = [(moment(t), s, x, e) for t, s, x, e in zip(ts, seq, state, error)]
            settled = (rest[0], moment(rest[1]), moment(rest[2]), rest[3], rest[4], rest[5])
        open_ += [(moment(r.ts), int(r.seq), r.state, None if pd.isna(r.error) else r.error) for part in rows for r in part.itertuples()]
        open_.sort(key=lambda e: e[:2])
        now = timerValues.getCurrentWatermarkInMs()
        old = sum(pd.Timestamp(e[0]).value // 1_000_000 < now for e in open_)
        settled, open_ = _folded(settled, open_[:old]), open_[old:]
        last, started, done, error, n, bad = whole = _folded(settled, open_)
        self.kept.update((*([e[k] for e in open_] for k in range(4)), *settled))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if not NEXT_STATES.get(last, ("",)):
            end = pd.Timestamp(max(e[0] for e in open_) if open_ else done or whole[1]).value // 1_000_000
            self.handle.registerTimer(max(end, now) + self.keep_ms)
        yield pd.DataFrame({
            "object": [key[0]], "state": [last], "started_at": [pd.Timestamp(started)], "completed_at": [pd.Timestamp(done) if done else pd.NaT],
            "error": pd.Series([error], dtype=object), "n_events": [n], "n_illegal": [bad]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.kept.clear()
        yield pd.DataFrame()

    def close(self) -> None:
        pass


def _folded(fold: tuple, events: list[tuple]) -> tuple:
    """fold (last state, started, done, error, events, illegal ones) carried on over events in their order."""
    last, started, done, error, n, bad = fold
    for t, _, state, failure in events:
        bad += last is not None and (last, state) not in LEGAL
        last, started, n = state, started or t, n + 1
        done = t if state in TERMINAL else done
        error = failure if failure is not None or state in CLEARING else error
    return last, started, done, error, n, bad


def fold_state_stream(events: DataFrame, watermark: str = "7 days", keep_days: int = 30) -> DataFrame:
    """The same fold over a stream; each batch emits the rows of the objects it touched. Needs the RocksDB state store.

    Events later than the watermark are dropped. An object's state is its events of that time and one fold of the rest; it
    goes keep_days after an end state (COMPLETED, SKIPPED, ROLLED_BACK), so an event after that starts the object anew.
    """
    return events.withWatermark("ts", watermark).groupBy("object").transformWithStateInPandas(statefulProcessor=_Fold(keep_days * 86_400_000), outputStructType=_FOLDED, outputMode="update", timeMode="EventTime")


_PAIRED = "run_id string, started timestamp, ended timestamp, seconds long, outcome string, outputs string, failed_objects string"


def pair_runs(events: DataFrame, as_of: Column | None = None, timeout: str = "1 day") -> DataFrame:
    """events(run_id, kind START, COMPLETE or FAIL, ts, outputs, failed) -> (run_id, started, ended, seconds, outcome, outputs, failed_objects).

    outputs and failed are arrays of names; each result is the sorted list of all. outcome: complete, failed, orphan (no start),
    open, or, given as_of, abandoned where the start is older than the timeout.
    """
    of = lambda *kinds: F.when(F.col("kind").isin(*kinds), F.col("ts"))
    names = lambda c: F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set(c)))), ",")
    runs = events.groupBy("run_id").agg(
        F.min(of("START")).alias("started"), F.max(of("COMPLETE", "FAIL")).alias("ended"), F.bool_or(F.col("kind") == "FAIL").alias("failed"),
        names(F.when(F.col("kind").isin("COMPLETE", "FAIL"), F.col("outputs"))).alias("outputs"), names(F.when(F.col("kind") == "FAIL", F.col("failed"))).alias("failed_objects"))
    late = F.lit(False) if as_of is None else F.col("started") + F.expr(f"INTERVAL {timeout}") <= as_of
    outcome = F.when(F.col("started").isNull(), "orphan").when(F.col("ended").isNull(), F.when(late, "abandoned").otherwise("open")).when(F.col("failed"), "failed").otherwise("complete")
    seconds = F.timestamp_diff("SECOND", F.col("started"), F.col("ended"))
    return runs.where("started IS NOT NULL OR ended IS NOT NULL").select("run_id", "started", "ended", seconds.alias("seconds"), outcome.alias("outcome"), "outputs", "failed_objects")


def pair_runs_stream(events: DataFrame, watermark: str = "1 hour", timeout_ms: int = 86_400_000) -> DataFrame:
    """The pairs of a stream: a batch emits the runs it touched; an open run is emitted as abandoned when event time passes its timeout.

    A run's state goes at that time whatever its outcome, so state is bounded by the runs of a timeout; later events start anew.
    """

    def fold(key, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        started, ended, failed, outputs, bad = state.get if state.exists else (None, None, False, [], [])
        due = state.hasTimedOut
        if due:
            state.remove()
        else:
            for r in (r for part in parts for r in part.itertuples()):
                at = r.ts.to_pydatetime()
                if r.kind == "START":
                    started = min(started or at, at)
                elif r.kind in ("COMPLETE", "FAIL"):
                    ended, failed = max(ended or at, at), failed or r.kind == "FAIL"
                    outputs = sorted({*outputs, *(r.outputs if r.outputs is not None else ())})
                    if r.kind == "FAIL":
                        bad = sorted({*bad, *(r.failed if r.failed is not None else ())})
            if started or ended:
                state.update((started, ended, failed, outputs, bad))
                end = int(pd.Timestamp(started or ended).timestamp() * 1000) + timeout_ms
                state.setTimeoutTimestamp(max(end, state.getCurrentWatermarkMs() + 1))
        if not (started or ended) or (due and (ended or not started)):
            return
        outcome = "orphan" if not started else "failed" if ended and failed else "complete" if ended else "abandoned" if due else "open"
        seconds = int((ended - started).total_seconds()) if started and ended else None
        yield pd.DataFrame({
            "run_id": [str(key[0])], "started": [pd.Timestamp(started) if started else pd.NaT], "ended": [pd.Timestamp(ended) if ended else pd.NaT],
            "seconds": pd.array([seconds], "Int64"), "outcome": [outcome], "outputs": [",".join(outputs)], "failed_objects": [",".join(bad)]})

    kept = "started timestamp, ended timestamp, failed boolean, outputs array<string>, bad array<string>"
    return events.withWatermark("ts", watermark).groupBy("run_id").applyInPandasWithState(fold, _PAIRED, kept, "update", GroupStateTimeout.EventTimeTimeout)


def audit_counts(rows: DataFrame, window: str = "1 day") -> DataFrame:
    """(day, outcome[, target], n): audit rows by window of their time, and by target where the rows name one."""
    by = ["outcome", *(c for c in ("target",) if c in rows.columns)]
    return rows.groupBy(F.window("ts", window), *by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("day"), *by, "n")


def audit_counts_stream(spark: SparkSession, path: str, watermark: str = "2 days", window: str = "1 day") -> DataFrame:
    """The counts over a folder of audit lines as they arrive; rows later than the watermark are dropped."""
    rows = spark.readStream.schema("ts timestamp, outcome string, target string").json(path)
    return audit_counts(rows.withWatermark("ts", watermark), window)
