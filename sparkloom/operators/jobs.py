"""A queue of jobs as a table: each step takes the table and gives the next one, so that it can be written as one transaction (MERGE or overwrite).

Jobs: job_id, project_id, state, priority, created_at, scheduled_at, updated_at, attempt, max_attempts, lease_owner, lease_until, resource_class.
Dependencies: job_id, dependency_id. States: queued, running, succeeded, failed, dead-letter, cancelled. Times are seconds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import cut

# The longest delay before a job is tried again, and states in which a project counts as served.
LONGEST_DELAY = 3600.0
SERVED = ("running", "succeeded", "failed")


def _set(jobs: DataFrame, where: Column, **values) -> DataFrame:
    return jobs.select(*[F.when(where, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in jobs.columns])


def reap(jobs: DataFrame, now: float) -> DataFrame:
    """Jobs whose lease ran out are queued again, or dead after their last attempt."""
    over = (F.col("state") == "running") & (F.col("lease_until") > 0) & (F.col("lease_until") <= now)
    state = F.when(F.col("attempt") < F.col("max_attempts"), F.lit("queued")).otherwise(F.lit("dead-letter"))
    return _set(jobs, over, state=state, lease_owner=F.lit(""), lease_until=F.lit(0.0), scheduled_at=F.lit(now), updated_at=F.lit(now))


def claimable(jobs: DataFrame, dependencies: DataFrame, now: float, concurrency: int = 2, classes: tuple[str, ...] = ()) -> DataFrame:
    """Queued jobs that are due, wait for no job that hasn't succeeded, and whose project runs fewer than `concurrency`; with served, when their project was
    last served. Joins on keys: open dependencies by anti join, projects by one aggregate row each."""
    open_ = dependencies.join(jobs.where("state <> 'succeeded'").select(F.col("job_id").alias("dependency_id")), "dependency_id", "left_semi").select("job_id").distinct()
    projects = jobs.groupBy("project_id").agg(F.count_if(F.col("state") == "running").alias("_running"), F.max(F.when(F.col("state").isin(*SERVED), F.col("updated_at"))).alias("served"))
    due = jobs.where((F.col("state") == "queued") & (F.col("scheduled_at") <= now))
    if classes:
        due = due.where(F.col("resource_class").isin(*classes))
    ready = due.join(open_, "job_id", "left_anti").join(projects, "project_id")
    return ready.where(F.col("_running") < concurrency).drop("_running").withColumn("served", F.coalesce("served", F.lit(0.0)))


def claim(jobs: DataFrame, dependencies: DataFrame, worker: str, now: float, lease: float = 60.0, **limits) -> tuple[DataFrame, DataFrame]:
    """The table after a claim, and the one row that is claimed: the highest priority, then the project served longest ago, then the oldest. Leases that ran
    out are reaped first. The table is written before and after, as a step reads it several times."""
    if not worker or lease <= 0:
        raise ValueError("a claim needs a worker and a lease")
    jobs = cut(reap(jobs, now))
    chosen = claimable(jobs, dependencies, now, **limits).orderBy(F.desc("priority"), "served", "created_at", "job_id").limit(1).select("job_id")
    hit = jobs.join(F.broadcast(chosen.withColumn("_hit", F.lit(True))), "job_id", "left")
    out = cut(_set(hit, F.coalesce("_hit", F.lit(False)), state=F.lit("running"), attempt=F.col("attempt") + 1, lease_owner=F.lit(worker), lease_until=F.lit(now + lease), updated_at=F.lit(now)))
    return out.drop("_hit").select(*jobs.columns), out.where("_hit").drop("_hit").select(*jobs.columns)


def claim_batch(jobs: DataFrame, dependencies: DataFrame, workers: list[str], now: float, lease: float = 60.0, concurrency: int = 2, classes: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """The table after the workers have claimed a job each, in their order, and the rows that are claimed: what as many single claims at `now` would give, in one step.

    A project's first claim counts as served now, so that its others come behind the projects of the same priority that weren't. That leaves one order of all
    jobs, as each project's jobs are taken by priority and age: a project's first job by when it was last served, its others by now; no more of them than it may still run.
    Within a project ranks are limited before the shuffle, and only as many rows as there are workers are broadcast.
    """
    if not workers or not all(workers) or lease <= 0:
        raise ValueError("a claim needs workers and a lease")
    jobs = cut(reap(jobs, now))
    running = jobs.groupBy("project_id").agg(F.count_if(F.col("state") == "running").alias("_running"))
    place = F.row_number().over(Window.partitionBy("project_id").orderBy(F.desc("priority"), "created_at", "job_id"))
    ready = claimable(jobs, dependencies, now, concurrency, classes).withColumn("_place", place).where(F.col("_place") <= concurrency)
    free = ready.join(running, "project_id").where(F.col("_place") + F.col("_running") <= concurrency)
    served = F.when(F.col("_place") == 1, F.col("served")).otherwise(F.greatest("served", F.lit(now)))
    best = free.withColumn("_served", served).orderBy(F.desc("priority"), "_served", "created_at", "job_id").limit(len(workers))
    turn = F.row_number().over(Window.orderBy(F.desc("priority"), "_served", "created_at", "job_id"))  # of as many rows as there are workers
    chosen = best.select("job_id", F.get(F.array(*map(F.lit, workers)), turn - 1).alias("_worker"))
    hit = jobs.join(F.broadcast(chosen), "job_id", "left")
    took = F.col("_worker").isNotNull()
    out = cut(_set(hit, took, state=F.lit("running"), attempt=F.col("attempt") + 1, lease_owner=F.col("_worker"), lease_until=F.lit(now + lease), updated_at=F.lit(now)))
    return out.drop("_worker").select(*jobs.columns), out.where(took).select(*jobs.columns)


def _owned(job_id, worker: str) -> Column:
    return (F.col("job_id") == job_id) & (F.col("state") == "running") & (F.col("lease_owner") == worker)


def _require(jobs: DataFrame, job_id, worker: str) -> None:
    if not jobs.where(_owned(job_id, worker)).take(1):
        raise ValueError("the worker doesn't hold the job's lease")


def heartbeat(jobs: DataFrame, job_id, worker: str, now: float, lease: float = 60.0) -> DataFrame:
    _require(jobs, job_id, worker)
    return _set(jobs, _owned(job_id, worker), lease_until=F.lit(now + lease), updated_at=F.lit(now))


def complete(jobs: DataFrame, job_id, worker: str, now: float) -> DataFrame:
    _require(jobs, job_id, worker)
    return _set(jobs, _owned(job_id, worker), state=F.lit("succeeded"), lease_owner=F.lit(""), lease_until=F.lit(0.0), updated_at=F.lit(now))


def backoff(attempt: Column, base: float = 2.0) -> Column:
    """Seconds before the next attempt: doubled each time."""
    return F.least(F.lit(LONGEST_DELAY), base * F.pow(F.lit(2.0), F.greatest(attempt - 1, F.lit(0))))


def fail(jobs: DataFrame, job_id, worker: str, now: float, retryable: bool = True, base: float = 2.0) -> DataFrame:
    """Queued again after a delay while attempts are left; else dead, or failed where it isn't to be retried."""
    _require(jobs, job_id, worker)
    left = F.col("attempt") < F.col("max_attempts")
    again = left & F.lit(retryable)
    state = F.when(again, "queued").when(~left, "dead-letter").otherwise("failed")
    when = F.when(again, F.lit(now) + backoff(F.col("attempt"), base)).otherwise(F.lit(now))
    return _set(jobs, _owned(job_id, worker), state=state, scheduled_at=when, lease_owner=F.lit(""), lease_until=F.lit(0.0), updated_at=F.lit(now))
