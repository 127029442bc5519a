"""States of unattended jobs: logs of requested transitions, of any length for any job, applied in order in parallel.

A request is a function from states to states: it leads where the state allows it and changes nothing elsewhere. Such functions are tuples with a place for
each state, and one after the other they make a function again. So a job's requests are folded in pieces, wherever they lie: pieces of rows, pieces of a
partition, partitions of the job; then the state before each piece goes down the same levels. No task holds more than a piece, whatever share of the log one job has.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import cut

# States, and those that each leads to.
STATES = ["queued", "claimed", "running", "verifying", "blocked", "completed", "failed", "cancelled"]
ALLOWED = {
    "queued": ["claimed", "cancelled"],
    "claimed": ["running", "queued", "cancelled"],
    "running": ["verifying", "completed", "failed", "blocked", "cancelled"],
    "verifying": ["completed", "failed", "blocked", "cancelled"],
    "blocked": ["queued", "cancelled"],
    "completed": [],
    "failed": ["queued"],
    "cancelled": ["queued"],
}
#: Requests in a piece.
PIECE = 256
_OTHER = len(STATES)
_REQUEST = ["seq", "state", "claimed_by"]


def _number(state: Column) -> Column:
    """A state's number; null for others."""
    at = F.array_position(F.array(*map(F.lit, STATES)), state)
    return F.when(at > 0, (at - 1).cast("int"))


def _led(state: Column, asked: Column) -> Column:
    """The number of the state after a request; null where the state is."""
    to = [STATES.index(t) if t in ALLOWED[s] else i for i, s in enumerate(STATES) for t in [*STATES, None]]
    return F.get(F.array(*map(F.lit, to)), state * (_OTHER + 1) + asked)


def _composed(items: Column, step: Callable[[Column, Column], Column]) -> Column:
    """The function that the items make one after the other; step gives the state after an item."""
    return F.aggregate(items, F.array(*[F.lit(i) for i in range(_OTHER)]), lambda f, x: F.transform(f, lambda s: step(s, x)))


def _before(items: Column, start: Column, step: Callable[[Column, Column], Column]) -> Column:
    """The state before each item."""
    zero = F.struct(start.cast("int").alias("s"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(items, zero, lambda a, x: F.struct(step(a["s"], x).alias("s"), F.concat(a["out"], F.array(a["s"])).alias("out")))["out"]


def _by_function(state: Column, item: Column) -> Column:
    return F.get(item["f"], state)


def _by_request(state: Column, item: Column) -> Column:
    return _led(state, item["asked"])


def transitions(jobs: DataFrame, requests: DataFrame, piece: int = PIECE) -> DataFrame:
    """One row per request: job_id, place, seq, state, claimed_by, came_from, accepted.

    jobs (job_id, state) has a row a job; requests (job_id, seq, state, claimed_by) ask for transitions in order of seq, then state, then claimed_by; equal rows count one
    after the other. A request that the job's state at that moment doesn't allow is refused and changes nothing; so is one for an unknown state, and one for a job that is null, not
    in the table or in an unknown state (came_from null). place orders a job's requests. Other columns are ignored.
    """
    asked = requests.select("job_id", *_REQUEST, F.coalesce(_number(F.col("state")), F.lit(_OTHER)).alias("asked"))
    known = asked.where("job_id IS NOT NULL").repartitionByRange("job_id", *_REQUEST).withColumn("_part", F.spark_partition_id())
    here = F.row_number().over(Window.partitionBy("job_id", "_part").orderBy(*_REQUEST))
    row = F.struct("n", *_REQUEST, "asked")
    pieces = known.withColumn("n", here).groupBy("job_id", "_part", F.floor((F.col("n") - 1) / piece).alias("_piece")).agg(F.array_sort(F.collect_list(row)).alias("rows"))
    pieces = cut(pieces.withColumn("f", _composed(F.col("rows"), _by_request)))
    parts = pieces.groupBy("job_id", "_part").agg(F.array_sort(F.collect_list(F.struct("_piece", "f"))).alias("items"))
    wholes = parts.withColumn("f", _composed(F.col("items"), _by_function)).groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct("_part", "f"))).alias("items"))
    starts = wholes.join(jobs.select("job_id", _number(F.col("state")).alias("start")), "job_id", "left")
    level = lambda df, name: df.withColumn("_s", F.explode(F.arrays_zip(F.col("items")[name].alias(name), _before(F.col("items"), F.col("start"), _by_function).alias("start"))))
    of_part = level(starts, "_part").select("job_id", "_s.*")
    of_piece = level(parts.join(of_part, ["job_id", "_part"]), "_piece").select("job_id", "_part", "_s.*")
    last = pieces.drop("f").join(of_piece, ["job_id", "_part", "_piece"])
    rows = last.withColumn("_s", F.explode(F.arrays_zip(F.col("rows").alias("r"), _before(F.col("rows"), F.col("start"), _by_request).alias("before"))))
    place = F.shiftleft(F.col("_part").cast("bigint"), 40) + F.col("_s.r.n")
    came = F.col("_s.before")
    out = rows.select("job_id", place.alias("place"), *[F.col(f"_s.r.{c}").alias(c) for c in _REQUEST], F.get(F.array(*map(F.lit, STATES)), came).alias("came_from"), F.coalesce(_led(came, F.col("_s.r.asked")) != came, F.lit(False)).alias("accepted"))
    lost = asked.where("job_id IS NULL").select("job_id", F.lit(None).cast("bigint").alias("place"), *_REQUEST, F.lit(None).cast("string").alias("came_from"), F.lit(False).alias("accepted"))
    return out.unionByName(lost)


def advanced(jobs: DataFrame, log: DataFrame) -> DataFrame:
    """The table of jobs (job_id, state, attempts, claimed_by and others) after a log of transitions: the last accepted state, one attempt more for each time a job came to
    run, and who was last named with an accepted request. Batches of a log, one after the other, give what the whole log gives."""
    done = log.where("accepted").groupBy("job_id").agg(
        F.max_by("state", "place").alias("_state"),
        F.count_if(F.col("state") == "running").alias("_runs"),
        F.max_by("claimed_by", F.when(F.col("claimed_by").isNotNull(), F.col("place"))).alias("_owner"),
    )
    new = {"state": F.coalesce("_state", "state"), "attempts": F.col("attempts") + F.coalesce("_runs", F.lit(0)), "claimed_by": F.coalesce("_owner", "claimed_by")}
    return jobs.join(done, "job_id", "left").select(*[new[c].alias(c) if c in new else F.col(c) for c in jobs.columns])
