"""Run operators: progress, status, funnels, comparison, activity and the folded event state."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SECONDS_PER_STEP = 9
MOST_STAGES = 10_000
#: kinds of events in the feed: fixed values; unknown events are "info"
ACTIVITY = {
    "step_started": "running", "step_progress": "running", "step_completed": "success", "step_failed": "error", "filter_applied": "success",
    "pipeline_paused": "warning", "pipeline_resumed": "info", "pipeline_completed": "success",
}
#: status of a job after an event; others leave it as it is
JOB_STATUS = {"step_failed": "paused", "pipeline_paused": "paused", "pipeline_resumed": "running", "pipeline_completed": "completed"}
STEP_STATUS = {"step_started": "running", "step_progress": "running", "step_completed": "success", "step_failed": "failed"}
UNKNOWN_FAILURE, FIRST_PERCENT, LEAST_PERCENT = "Unknown step failure", 10, 5


def job_progress(steps: DataFrame) -> DataFrame:
    """Per job: steps, completed ones, percent, first incomplete (phase, step) and seconds left."""
    done = F.col("status") == "success"
    first = F.min(F.when(~done, F.struct("phase", "step")))
    out = steps.groupBy("job_id").agg(F.count("*").alias("total"), F.count_if(done).alias("completed"), first.alias("next"))
    return out.select(
        "job_id", "total", "completed", (F.col("completed") * 100.0 / F.col("total")).alias("percent"), F.col("next.phase").alias("next_phase"),
        F.col("next.step").alias("next_step"), ((F.col("total") - F.col("completed")) * SECONDS_PER_STEP).alias("seconds_left"),
    )


def phase_status(steps: DataFrame) -> DataFrame:
    """Completed if every step is done; else failed, running, paused if any is; else pending. With summed seconds."""
    any_ = lambda s: F.bool_or(F.col("status") == s)
    status = (
        F.when(F.bool_and(F.col("status").isin("success", "skipped")), "completed").when(any_("failed"), "failed").when(any_("running"), "running")
        .when(any_("paused"), "paused").otherwise("pending")
    )
    return steps.groupBy("job_id", "phase").agg(status.alias("phase_status"), F.sum("seconds").alias("seconds"))


def job_status_counts(jobs: DataFrame) -> DataFrame:
    """Jobs by status for the dashboard; failed and paused count together."""
    s = F.col("status")
    return jobs.agg(
        F.count("*").alias("total"), F.count_if(s == "completed").alias("completed"), F.count_if(s == "running").alias("running"),
        F.count_if(s.isin("failed", "paused")).alias("stopped"),
    )


def stage_funnel(steps: DataFrame) -> DataFrame:
    """Steps done by run and stage; stages without any drop out, the last one is final."""
    counts = steps.groupBy("job_id", "stage").agg(F.count_if(F.col("status") == "success").alias("n")).filter("n > 0")
    last = F.max("stage").over(Window.partitionBy("job_id"))
    return counts.withColumn("final", F.col("stage") == last)


def stage_union(funnels: DataFrame) -> DataFrame:
    """Stage keys over all runs in first-seen order."""
    return funnels.groupBy("stage").agg(F.min("job_id").alias("first_job"), F.count("*").alias("n_jobs"))


def compare_runs(funnels: DataFrame, jobs: DataFrame) -> DataFrame:
    """Every stage of the union for every run, with the run's count or null.

    The stages are a short list of at most ``MOST_STAGES`` names; the runs are never multiplied with each other.
    """
    stages = funnels.select("stage").distinct()
    if stages.limit(MOST_STAGES + 1).count() > MOST_STAGES:
        raise ValueError(f"more than {MOST_STAGES} stage names")
    names = F.array_sort(F.collect_set("stage"))
    wide = jobs.select("job_id").join(F.broadcast(stages.agg(names.alias("stages"))))  # one row: the stage names
    grid = wide.select("job_id", F.explode("stages").alias("stage"))
    return grid.join(funnels.select("job_id", "stage", "n"), ["job_id", "stage"], "left")


def stage_fallback(candidates: DataFrame) -> DataFrame:
    """Rows of the most filtered non-empty stage of each run (greatest ``priority``)."""
    top = candidates.groupBy("job_id").agg(F.max("priority").alias("priority"))
    return candidates.join(top, ["job_id", "priority"], "left_semi")


def provenance_status(explicit: Column, paused: Column, cached: Column, method: Column) -> Column:
    """Explicit status, else paused: unavailable, cached: cached-real, else by keywords of the method, else unavailable."""
    text = F.lower(method)
    return F.coalesce(
        explicit,
        F.when(paused, "unavailable").when(cached, "cached-real").when(text.rlike("local|approximation|heuristic"), "local-analysis")
        .when(text.rlike("api|blast|service|remote"), "real").otherwise("unavailable"),
    )


def activity_feed(events: DataFrame, jobs: DataFrame, n: int = 20) -> DataFrame:
    """The newest n events over all jobs with the job's name (or id), kind and message; a limited sort keeps n rows for each task."""
    newest = events.orderBy(F.col("ts").desc(), F.col("id").desc()).limit(max(1, n))
    named = newest.join(jobs, "job_id", "left")
    name = F.coalesce("job_name", F.col("job_id").cast("string"))
    return named.select("id", "job_id", name.alias("job_name"), activity_kind(F.col("type")).alias("kind"), activity_message().alias("message"), "ts")


def _mapped(kind: Column, values: dict[str, str], default: str | None = None) -> Column:
    out = F.lit(default)
    for name, shown in values.items():
        out = F.when(kind == name, shown).otherwise(out)
    return out


def activity_kind(kind: Column) -> Column:
    return _mapped(kind, ACTIVITY, "info")


def activity_message() -> Column:
    """What the feed says about an event: columns type, phase, step, tool, message, error, duration. Empty texts count as absent."""
    given = lambda c: F.when(F.col(c) != "", F.col(c))
    kind, tool = F.col("type"), F.coalesce(F.concat(F.lit(" · "), given("tool")), F.lit(""))
    step = F.when((F.col("phase") != 0) & (F.col("step") != 0), F.concat(F.lit("Step "), F.col("phase").cast("string"), F.lit("."), F.col("step").cast("string")))
    took = F.coalesce(F.when(F.col("duration") != 0, F.concat(F.lit(" · "), F.col("duration").cast("string"), F.lit("s"))), F.lit(""))
    by = F.concat(step, F.lit(" ("), F.coalesce(given("tool"), F.lit("tool")), F.lit(") "))
    return (
        F.when((kind == "step_started") & step.isNotNull(), F.concat(by, F.lit("started"))).when((kind == "step_progress") & step.isNotNull(), F.concat(by, F.lit("progressing")))
        .when((kind == "step_completed") & step.isNotNull(), F.concat(step, F.lit(" completed"), tool, took))
        .when((kind == "step_failed") & step.isNotNull(), F.concat(step, F.lit(" failed"), tool, F.lit(": "), F.coalesce(given("error"), F.lit("unknown error"))))
        .when(kind == "pipeline_paused", F.concat(F.lit("Pipeline paused — "), F.coalesce(given("message"), F.lit("step review required"))))
        .when(kind == "pipeline_resumed", F.concat(F.lit("Pipeline resumed — "), F.coalesce(given("message"), F.lit("continuing"))))
        .when(kind == "pipeline_completed", "Pipeline completed — all phases finished").when(kind == "filter_applied", "Filter applied — funnel counts updated")
        .otherwise(F.coalesce(given("message"), kind))
    )


def recent_events(events: DataFrame, n: int = 1000) -> DataFrame:
    """The newest n events of each job; the group limit runs before the shuffle."""
    rank = F.row_number().over(Window.partitionBy("job_id").orderBy(F.col("ts").desc(), F.col("id").desc()))
    return events.withColumn("rank", rank).filter(F.col("rank") <= n)


def events_since(events: DataFrame, cursors: DataFrame) -> DataFrame:
    """Events of each job behind its cursor event; all of them if the cursor is unknown."""
    known = events.select("job_id", F.col("id").alias("cursor"), F.struct("ts", "id").alias("place"))
    at = cursors.join(known, ["job_id", "cursor"], "left").select("job_id", "place")
    return events.join(at, "job_id").filter(F.col("place").isNull() | (F.struct("ts", "id") > F.col("place"))).drop("place")


def event_counts(events: DataFrame) -> DataFrame:
    return events.groupBy(activity_kind(F.col("type")).alias("kind")).agg(F.count("*").alias("n"))


def step_state(events: DataFrame) -> DataFrame:
    """Events folded in order to the state of each (job, phase, step): status, percent, duration, error.

    Progress never takes back a success: after a completed step only a later start or failure counts. A start sets 0, a completed
    step 100; progress is clamped to 5..100 and keeps the percent so far (else 10) where the event has none. The last error and
    duration stay. Events without a phase count for no step, those without a step for step 1.
    """
    order = F.struct("ts", "id")
    kind = F.col("type")
    e = events.filter(kind.isin(*STEP_STATUS) & F.col("phase").isNotNull()).withColumn("step", F.coalesce("step", F.lit(1)))
    before = Window.partitionBy("job_id", "phase", "step").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, -1)
    settled = F.last(F.when(kind != "step_progress", kind), ignorenulls=True).over(before)
    e = e.withColumn("settled", settled).filter((kind != "step_progress") | F.coalesce(F.col("settled") != "step_completed", F.lit(True)))
    clamped = F.least(F.greatest(F.round("percent").cast("int"), F.lit(LEAST_PERCENT)), F.lit(100))
    put = F.when(kind == "step_started", 0).when(kind == "step_completed", 100).when((kind == "step_progress") & F.col("percent").isNotNull(), clamped)
    agg = e.withColumn("put", put).groupBy("job_id", "phase", "step").agg(
        F.max_by("type", order).alias("last"), F.max_by("put", F.when(F.col("put").isNotNull(), order)).alias("put"), F.max(F.when(F.col("put").isNotNull(), order)).alias("put_at"),
        F.max(F.when(kind == "step_progress", order)).alias("moved_at"),
        F.max_by("duration", F.when((kind == "step_completed") & F.col("duration").isNotNull(), order)).alias("duration"),
        F.max_by(F.coalesce("error", F.lit(UNKNOWN_FAILURE)), F.when(kind == "step_failed", order)).alias("error"),
    )
    kept = F.col("moved_at").isNotNull() & (F.col("put_at").isNull() | (F.col("moved_at") > F.col("put_at")))
    percent = F.when(kept, F.greatest(F.coalesce("put", F.lit(FIRST_PERCENT)), F.lit(LEAST_PERCENT))).otherwise(F.col("put"))
    return agg.select("job_id", "phase", "step", _mapped(F.col("last"), STEP_STATUS).alias("status"), percent.alias("percent"), "duration", "error")


def job_status(events: DataFrame) -> DataFrame:
    """Events folded in order to the state of each job: status (null until an event sets one), progress (100 once completed), last error, funnel.

    A failed step pauses its job; the last funnel that isn't empty replaces those before.
    """
    order, kind = F.struct("ts", "id"), F.col("type")
    counted = (kind != "step_failed") | F.col("phase").isNotNull()
    return events.filter(counted).groupBy("job_id").agg(
        F.max_by(_mapped(kind, JOB_STATUS), F.when(kind.isin(*JOB_STATUS), order)).alias("status"), F.max(F.when(kind == "pipeline_completed", 100)).alias("progress"),
        F.max_by(F.coalesce("error", F.lit(UNKNOWN_FAILURE)), F.when(kind == "step_failed", order)).alias("error"),
        F.max_by("funnel", F.when((kind == "filter_applied") & (F.size("funnel") > 0), order)).alias("funnel"),
    )


def job_state(events: DataFrame) -> DataFrame:
    """Steps and jobs in one table: a job's own row has no phase and step."""
    return step_state(events).unionByName(job_status(events).withColumnRenamed("progress", "percent"), allowMissingColumns=True)


def live_metrics(epitopes: DataFrame) -> DataFrame:
    """Epitopes by run and type; ``mixed`` provenance if several alleles contribute."""
    out = epitopes.groupBy("run_id", "type").agg(F.count("*").alias("n"), F.count_distinct("allele").alias("sources"))
    return out.withColumn("provenance", F.when(F.col("sources") > 1, "mixed").otherwise("single"))


def validation_summary(scores: DataFrame, constructs: DataFrame) -> DataFrame:
    """Gates by run: toxic CTL and HTL epitopes, and the construct's gravy, antigenicity and solubility (and ``instability`` where given).

    The status is ``pass`` where every gate has a value; a run without a construct fails.
    """
    toxic = F.lit(1) - F.col("toxin_score") >= 0.4
    counts = scores.groupBy("run_id").agg(
        F.count_if((F.col("type") == "CTL") & toxic).alias("ctl_toxic"), F.count_if((F.col("type") == "HTL") & toxic).alias("htl_toxic")
    )
    gates = [c for c in ("instability", "antigenicity", "solubility") if c in constructs.columns]
    out = counts.join(constructs, "run_id", "left").withColumn("is_soluble", F.col("solubility") >= 0.4)
    complete = reduce(and_, [F.col(c).isNotNull() for c in gates])
    return out.withColumn("status", F.when(complete, "pass").otherwise("fail"))


def funnel_evidence(funnels: DataFrame, steps: DataFrame) -> DataFrame:
    """Funnel rows with an evidence text: stage, its worst step status and the step count."""
    by = steps.groupBy("job_id", "stage").agg(F.count("*").alias("n_steps"), F.bool_or(F.col("status") == "failed").alias("failed"))
    status = F.when(F.col("failed"), "unavailable").otherwise("real")
    joined = funnels.join(by, ["job_id", "stage"], "left")
    count = F.when(~F.col("failed"), F.col("n"))
    return joined.select("job_id", "stage", count.alias("n"), F.concat_ws(" · ", "stage", status, F.col("n_steps").cast("string")).alias("evidence"))
