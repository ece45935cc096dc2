"""Job state from redelivered messages.

A job goes QUEUED → IN_PROGRESS → COMPLETED or FAILED. The first final event wins,
later messages change nothing: what has been reported as ended stays ended.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# States, and seconds until a message comes again by how often it came.
QUEUED, IN_PROGRESS, COMPLETED, FAILED = "QUEUED", "IN_PROGRESS", "COMPLETED", "FAILED"
BACKOFF = ((720, 900), (480, 300), (240, 60))
BACKOFF_DEFAULT = 30
RANK = {QUEUED: 0, IN_PROGRESS: 1, COMPLETED: 2, FAILED: 2}


def backoff(received: Column) -> Column:
    """Seconds until a message becomes visible again."""
    out = F.when(F.lit(False), 0)
    for above, seconds in BACKOFF:
        out = out.when(received > above, seconds)
    return out.otherwise(BACKOFF_DEFAULT)


def classify_failure(df: DataFrame) -> DataFrame:
    """Failed messages (received, retryable, error, ts): redelivered later, or dead with a reason."""
    again = F.coalesce("retryable", F.lit(False))
    wait = F.make_interval(secs=backoff(F.col("received")).cast("decimal(18,6)"))
    return (
        df.withColumn("action", F.when(again, "redeliver").otherwise("dead"))
        .withColumn("visible_at", F.when(again, F.col("ts") + wait))
        .withColumn("reason", F.when(~again, F.coalesce("error", F.lit("unknown"))))
    )


def event_state(outcome: Column) -> Column:
    """State an event asks for: queued, started, retry, completed or failed."""
    return (
        F.when(outcome == "completed", COMPLETED)
        .when(outcome == "failed", FAILED)
        .when(outcome.isin("started", "retry"), IN_PROGRESS)
        .otherwise(QUEUED)
    )


def job_state(events: DataFrame) -> DataFrame:
    """(job, status, seq, attempts, detail) of events (job, seq, outcome, detail).

    An aggregate, so events of one busy job fold on the map side first.
    """
    state = event_state(F.col("outcome"))
    final = state.isin(COMPLETED, FAILED)
    first = F.min(F.when(final, F.struct("seq", state.alias("status"), "detail")))
    grouped = events.groupBy("job").agg(
        first.alias("f"),
        F.max(F.when(state == IN_PROGRESS, F.lit(IN_PROGRESS))).alias("p"),
        F.max("seq").alias("last"),
        F.count_if(F.col("outcome") == "started").alias("attempts"),
    )
    return grouped.select(
        "job", F.coalesce("f.status", "p", F.lit(QUEUED)).alias("status"), F.coalesce("f.seq", "last").alias("seq"),
        "attempts", F.col("f.detail").alias("detail"),
    )


CHANGES = "job string, status string, seq bigint, attempts bigint, detail string, version bigint"
STATE = "status string, seq bigint, attempts bigint, detail string, version bigint"


#: Groups that jobs are dealt to. A call into Python and a batch of results serve all jobs of a group, not one job.
GROUPS = 4096


class JobState(StatefulProcessor):
    """State of a job: its status, the message that decided it, attempts, detail and version.

    A group of jobs has a map of their states. Messages of a batch are folded one by one, so a job with many of them needs
    no more memory.
    """

    def __init__(self, expire_ms: int | None = None):
        self.expire_ms = expire_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.states = handle.getMapState("jobs", "job string", STATE, self.expire_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        heard: dict[str | None, list] = {}  # job: state, end, last, attempts, running
        known = self.states.exists()  # asked once, so that new groups ask for no job
        for row in rows:
            job = heard.get(row.job)
            if job is None:
                old = tuple((known and self.states.getValue((row.job,))) or (QUEUED, -1, 0, None, 0))
                job = heard[row.job] = [old, None, old[1], old[2], old[0] == IN_PROGRESS]
            if RANK[job[0][0]] == 2:
                continue
            job[2] = max(job[2], row.seq)
            if row.outcome in ("completed", "failed"):
                if job[1] is None or row.seq < job[1][1]:
                    job[1] = (COMPLETED if row.outcome == "completed" else FAILED, row.seq, row.detail)
            elif row.outcome in ("started", "retry"):
                job[4] = True
                job[3] += row.outcome == "started"
        for name, (old, end, last, tries, running) in heard.items():
            status, seq, attempts, detail, version = old
            if RANK[status] == 2:
                if self.expire_ms:  # heard of again: its time starts anew
                    self.states.updateValue((name,), old)
                continue
            new = (*(end or (IN_PROGRESS if running else status, last, detail)), tries)
            if new != (status, seq, detail, attempts):
                status, seq, detail, attempts, version = *new, version + 1
                yield Row(job=name, status=status, seq=seq, attempts=attempts, detail=detail, version=version)
            elif not self.expire_ms:
                continue
            self.states.updateValue((name,), (status, seq, attempts, detail, version))

    def close(self) -> None:
        pass


def job_changes(events: DataFrame, expire_ms: int | None = None) -> DataFrame:
    """The same as a stream: one row per change of a job's state, with a version.

    A job that has ended stays as it is, whatever comes later: its end has already been reported. Among the messages
    of one batch the one with the smallest ``seq`` ends it; ``job_state`` takes a whole table as one batch. A
    continuous job sets ``expire_ms``: the state of a job that nothing was heard of for so long is dropped by the
    state store itself, and a message that comes later begins the job anew. Such a stream always has a next batch to look
    for expired state, so a run that is to stop at the end of its input must not set it.
    """
    mode = "ProcessingTime" if expire_ms else "None"
    group = F.pmod(F.xxhash64("job"), F.lit(GROUPS)).cast("int").alias("group")
    grouped = events.select(group, "job", "seq", "outcome", "detail").groupBy("group")
    return grouped.transformWithState(JobState(expire_ms), CHANGES, "Append", mode)


def current(changes: DataFrame) -> DataFrame:
    """The latest state per job of a change log."""
    rest = [c for c in changes.columns if c not in ("job", "version")]
    return changes.groupBy("job").agg(F.max_by(F.struct(*rest), "version").alias("s")).select("job", "s.*")


def invocation_events(messages: DataFrame, histories: DataFrame) -> DataFrame:
    """Poll results (key, seq, poll_status) as job events.

    COMPLETED and ERROR end an invocation, anything else is asked again; a message whose
    history row is gone ends as an error.
    """
    known = histories.select("key").distinct().withColumn("_known", F.lit(True))
    joined = messages.join(known, "key", "left")
    poll = F.col("poll_status")
    outcome = (
        F.when(F.col("_known").isNull(), "failed").when(poll == "COMPLETED", "completed").when(poll == "ERROR", "failed").otherwise("retry")
    )
    detail = F.when(F.col("_known").isNull(), "invoke history not found").when(poll == "ERROR", "external app reported ERROR")
    return joined.select(F.col("key").alias("job"), "seq", outcome.alias("outcome"), detail.alias("detail"))


def invocation_status(state: DataFrame) -> DataFrame:
    """running, success or error of a job state."""
    shown = F.when(F.col("status") == COMPLETED, "success").when(F.col("status") == FAILED, "error").otherwise("running")
    return state.withColumn("status", shown)


def dedup_messages(messages: DataFrame, ts: str = "ts", key: str = "message_id", late: str = "1 hour") -> DataFrame:
    """Drop redelivered messages; the watermark bounds what must be remembered."""
    return messages.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])
