"""Job lifecycle from an event log: a batch reducer, the same as a stateful stream, and its outputs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# Times, tries, and what becomes of an error.
JOB_TIMEOUT_S, GRACE_S, JOB_TTL_S, MAX_TRIES = 900, 120, 86_400, 2
REASONS = {
    "LowQualityTreeError": "low_quality_tree",
    "ConverterOOMError": "converter_oom",
    "MemoryError": "converter_oom",
    "TimeoutError": "converter_timeout",
}
DEFAULT_REASON = "converter_child_failed"
TERMINAL = ("low_quality_tree",)
EVENTS = ("pending", "processing", "done", "error")


def reason_of(error: Column) -> Column:
    out = F.lit(DEFAULT_REASON)
    for k, v in REASONS.items():
        out = F.when(error == k, F.lit(v)).otherwise(out)
    return F.when(error.isNotNull(), out)


def job_states(events: DataFrame, clear_on_success: bool = True) -> DataFrame:
    """events: job_id, seq (order), ts (seconds), event, attempt, error, doc_id. One row per job: its
    status after all events. Fields are merged: each keeps its last value; a new attempt overwrites
    the start. clear_on_success drops the reason of an earlier failure from a job that is done."""
    last = lambda c, when: F.max_by(c, F.when(when, F.col("seq")))
    is_ = lambda e: F.col("event") == e
    out = events.groupBy("job_id").agg(
        F.max_by("event", "seq").alias("status"),
        last("ts", is_("processing")).alias("processing_started_at"),
        last("doc_id", is_("done")).alias("doc_id"),
        last(reason_of(F.col("error")), is_("error")).alias("reason"),
        F.max("attempt").alias("attempts"),
        F.max("ts").alias("updated_at"),
    )
    if clear_on_success:
        out = out.withColumn("reason", F.when(F.col("status") != "done", F.col("reason")))
    return out


#: Seconds that a conversion may take, and what memory admission waits between looks and in all.
CHILD_TIMEOUT_S, POLL_S, MAX_WAIT_S = 870, 3, 120
KILLED = -9


def child_reason(code: Column, seconds: Column, line: Column) -> Column:
    """Why a conversion in a process of its own failed, null if it didn't: it took too long, it was killed
    (out of memory), it ended with an error, or its line of output isn't JSON."""
    return (
        F.when(seconds >= CHILD_TIMEOUT_S, "converter_timeout")
        .when(code == KILLED, "converter_oom")
        .when((code != 0) | F.get_json_object(line, "$").isNull(), DEFAULT_REASON)
    )


def admission_wait(readings: Column, floor: float) -> Column:
    """Seconds until a job may start, given what is free at each look: at the first one with enough, or that
    nobody could read; after the longest wait it starts anyway."""
    looks = F.slice(readings, 1, MAX_WAIT_S // POLL_S)
    good = F.transform(looks, lambda x, k: F.when(x.isNull() | (x >= floor), k))
    return F.coalesce(F.array_min(good) * POLL_S, F.lit(MAX_WAIT_S))


def lookup(states: DataFrame, now: Column, ttl: int = JOB_TTL_S) -> DataFrame:
    """Jobs that are still known: others have expired."""
    return states.filter(now - F.col("updated_at") <= ttl)


def retryable(failures: DataFrame) -> DataFrame:
    """Failures with outcome: terminal (no retry, staging purged), retry, or dead (last try)."""
    reason = reason_of(F.col("error"))
    outcome = F.when(reason.isin(*TERMINAL), "terminal").when(F.col("attempt") >= MAX_TRIES, "dead").otherwise("retry")
    return failures.select("*", reason.alias("reason"), outcome.alias("outcome"))


def dead_letters(failures: DataFrame) -> DataFrame:
    return retryable(failures).filter("outcome = 'dead'").select("job_id", "attempt", F.substring("error", 1, 200).alias("error"))


def purged(failures: DataFrame, successes: DataFrame) -> DataFrame:
    """Jobs whose staged file goes: those with a final outcome."""
    return retryable(failures).filter("outcome = 'terminal'").select("job_id").union(successes.select("job_id")).distinct()


def stale(states: DataFrame, now: Column) -> DataFrame:
    """Jobs that have been processing for longer than a job may take; a job without a start is left alone."""
    late = now - F.col("processing_started_at") > JOB_TIMEOUT_S + GRACE_S
    return states.filter((F.col("status") == "processing") & F.coalesce(late, F.lit(False)))


def queue_depth(states: DataFrame) -> DataFrame:
    return states.agg(F.count(F.when(F.col("status") == "pending", 1)).alias("depth"))


def enqueue(files: DataFrame, supported: Column) -> DataFrame:
    """files: batch_id, seq, filename. Files up to the first that can't be read are queued; that one
    is refused, and so is what follows it."""
    bad = F.min(F.when(~supported, F.col("seq")))
    first = files.groupBy("batch_id").agg(bad.alias("first_bad"))
    state = F.when(F.col("first_bad").isNull() | (F.col("seq") < F.col("first_bad")), "pending").when(F.col("seq") == F.col("first_bad"), "refused").otherwise("skipped")
    return files.join(first, "batch_id").select("batch_id", "seq", "filename", state.alias("status"))


STATE = "status string, started long, doc_id string, reason string, attempts int, updated long, seq long"
OUTPUT = "job_id string, status string, processing_started_at long, doc_id string, reason string, attempts int, updated_at long"


def _advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        state.remove()
        return
    status, started, doc, reason, attempts, updated, seq = state.get if state.exists else (None, None, None, None, 0, 0, -1)
    rows = pd.concat(list(batches)).sort_values("seq")
    for r in rows.itertuples():
        attempts, updated = max(attempts, int(r.attempt)), max(updated, int(r.ts))
        if r.seq <= seq:
            continue
        status, seq = r.event, int(r.seq)
        if r.event == "processing":
            started = int(r.ts)
        elif r.event == "done":
            doc, reason = (None if pd.isna(r.doc_id) else r.doc_id), None
        elif r.event == "error":
            reason = REASONS.get(r.error, DEFAULT_REASON) if isinstance(r.error, str) else None
    state.update((status, started, doc, reason, attempts, updated, seq))
    state.setTimeoutDuration(JOB_TTL_S * 1000)
    yield pd.DataFrame([(key[0], status, started, doc, reason, attempts, updated)], columns=[c.split()[0] for c in OUTPUT.split(", ")])


def job_stream(events: DataFrame) -> DataFrame:
    """The reducer over a stream of events, with state per job and its time to live."""
    return events.groupBy("job_id").applyInPandasWithState(_advance, OUTPUT, STATE, "update", GroupStateTimeout.ProcessingTimeTimeout)
