"""Event streams: ingestion with bounded deduplication, folded state of steps and jobs, recent events, counts.

The stream is any streaming source of JSON or Parquet event files (or Kafka rows of the same schema).
Late duplicates are dropped within the watermark; that bound is ours. The state of a job is a map of its steps, its status
and its funnel; a completed job's state goes after ``FINISHED``, and any state after ``FORGOTTEN`` without a change. Events
that come later begin a new state.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from sieveline.operators.runs import FIRST_PERCENT, JOB_STATUS, LEAST_PERCENT, STEP_STATUS, UNKNOWN_FAILURE, activity_kind

FUNNEL = "array<struct<stage:string,n:bigint>>"
EVENT = (
    "id long, job_id long, type string, phase int, step int, percent double, ts timestamp, tool string, message string, error string, duration int, "
    "funnel array<struct<stage:string,n:bigint>>"
)
STATE = "job_id long, phase int, step int, status string, percent int, duration int, error string, funnel array<struct<stage:string,n:bigint>>"
RECENT = "job_id long, id long, ts timestamp, type string"
WATERMARK = "1 hour"
DAY = 24 * 3600 * 1000
FINISHED, FORGOTTEN = DAY, 30 * DAY  # milliseconds
STORE = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_events(spark: SparkSession, path: str, fmt: str = "parquet", files_per_trigger: int = 8) -> DataFrame:
    return spark.readStream.format(fmt).schema(EVENT).option("maxFilesPerTrigger", files_per_trigger).load(path)


def deduplicated(events: DataFrame) -> DataFrame:
    """Control events reuse ids, so the time belongs to the key."""
    return events.withWatermark("ts", WATERMARK).dropDuplicatesWithinWatermark(["job_id", "id", "ts"])


def event_counts(events: DataFrame) -> DataFrame:
    """Events by kind, in update or complete mode."""
    return events.groupBy(activity_kind(F.col("type")).alias("kind")).agg(F.count("*").alias("n"))


def windowed_counts(events: DataFrame, width: str = "10 minutes") -> DataFrame:
    """Events by kind and tumbling window, in append mode behind the watermark."""
    grouped = events.withWatermark("ts", WATERMARK).groupBy(F.window("ts", width), activity_kind(F.col("type")).alias("kind"))
    return grouped.agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "kind", "n")


def _whole(x: object) -> int | None:
    return None if x is None or x != x else int(x + 0.5)


def apply_event(state: tuple | None, kind: str, percent: float | None, duration: float | None = None, error: str | None = None) -> tuple | None:
    """Next (status, percent, duration, error) of a step; progress never takes back a success."""
    status, so_far, took, failure = state or (None, None, None, None)
    if kind == "step_started":
        return "running", 0, took, failure
    if kind == "step_completed":
        return "success", 100, took if _whole(duration) is None else _whole(duration), failure
    if kind == "step_failed":
        return "failed", so_far, took, error if isinstance(error, str) else UNKNOWN_FAILURE
    if kind == "step_progress" and status != "success":
        known = _whole(percent) if _whole(percent) is not None else FIRST_PERCENT if so_far is None else so_far
        return "running", min(100, max(LEAST_PERCENT, known)), took, failure
    return state


STEPS = "array<struct<phase:int,step:int,status:string,percent:int,duration:int,error:string>>"
_CHANGED = Row(*(c.split()[0] for c in STATE.split(", ")))


def _in_order(event: Row) -> tuple:
    return tuple((x is None, x) for x in (event["ts"], event["id"]))


class JobFold(StatefulProcessor):
    """The state of one job: its status, funnel and steps in one value, as every call to the store costs a round trip; a timer and a time to live let it go."""

    def __init__(self, finished_ms: int, forgotten_ms: int):
        self.finished_ms, self.forgotten_ms = finished_ms, forgotten_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", f"status string, progress int, error string, funnel {FUNNEL}, steps {STEPS}", self.forgotten_ms)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        old = self.job.get()
        before, progress, error, funnel, known = old or (None, None, None, None, None)
        status, touched = before, {}
        funnel = funnel and [tuple(s) for s in funnel]
        steps = {(s[0], s[1]): tuple(s[2:]) for s in known or ()}
        for e in sorted(rows, key=_in_order):  # one job's events of one trigger, which maxFilesPerTrigger bounds
            kind, phase, step = e["type"], _whole(e["phase"]), _whole(e["step"])
            if kind in STEP_STATUS:
                if phase is None:
                    continue
                place = (phase, 1 if step is None else step)
                touched[place] = steps[place] = apply_event(steps.get(place), kind, e["percent"], e["duration"], e["error"])
            if kind == "step_failed":
                error = e["error"] if isinstance(e["error"], str) else UNKNOWN_FAILURE
            if kind == "filter_applied" and e["funnel"]:
                funnel = [(s["stage"], s["n"]) for s in e["funnel"]]
            if kind == "pipeline_completed":
                progress = 100
            status = JOB_STATUS.get(kind, status)
        self.job.update((status, progress, error, funnel, [(*place, *state) for place, state in steps.items()]))
        if before == "completed" or self.finished_ms >= self.forgotten_ms:  # else it has no timer
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
        if status == "completed":
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.finished_ms)
        for place, state in sorted(touched.items(), key=lambda t: t[0]):
            yield _CHANGED(key[0], *place, *state, None)
        yield _CHANGED(key[0], None, None, status, progress, None, error, funnel and [{"stage": s, "n": n} for s, n in funnel])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        self.job.clear()
        yield from ()

    def close(self) -> None:
        pass


def job_state(events: DataFrame, finished_ms: int = FINISHED, forgotten_ms: int = FORGOTTEN) -> DataFrame:
    """Changed steps of each trigger and the state of their jobs (rows without phase and step), in update mode, folded in event order by job."""
    events.sparkSession.conf.set(*STORE)
    used = events.select("job_id", "id", "ts", "type", "phase", "step", "percent", "duration", "error", "funnel")
    return used.groupBy("job_id").transformWithState(JobFold(finished_ms, forgotten_ms), STATE, "Update", "ProcessingTime")


def recent_events(events: DataFrame, n: int = 1000) -> DataFrame:
    """The last n events of each job that a trigger touched (update mode)."""

    def keep(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        old = pd.DataFrame(state.get[0] if state.exists else [], columns=["id", "ts", "type"])
        new = pd.concat([old, *(f[["id", "ts", "type"]] for f in frames)]).sort_values(["ts", "id"]).tail(n)
        state.update(([(int(i), t.to_pydatetime(), k) for i, t, k in new.itertuples(index=False)],))
        yield new.assign(job_id=key[0])[["job_id", "id", "ts", "type"]]

    return events.groupBy("job_id").applyInPandasWithState(
        keep, RECENT, "events array<struct<id:long,ts:timestamp,type:string>>", "update", GroupStateTimeout.NoTimeout
    )


def write_events(events: DataFrame, path: str, checkpoint: str):
    """Appends the stream to Parquet files; the checkpoint makes it exactly once."""
    return events.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
