"""The stream of job states: any split of its log gives the same states, and jobs that get stuck fail."""

import datetime as dt
import random

from pyspark.sql import functions as F

from lectern.streaming import jobs

LOG = "id long, status string, event_id long, updated_at timestamp"


def _at(minute):
    return dt.datetime(2024, 5, 1) + dt.timedelta(minutes=minute)


def _runner(spark, tmp_path, **options):
    path, out, marks = (str(tmp_path / n) for n in ("log", "out", "marks"))

    def run(*batches):
        for rows in batches:
            spark.createDataFrame(rows, LOG).coalesce(1).write.mode("append").parquet(path)
        stream = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(path)
        jobs.run_job_stream(spark, stream, out, marks, **options)
        return {r.id: (r.status, r.event_id, r.error) for r in jobs.last_changes(spark.read.parquet(out)).collect()}

    return run


def test_any_split_gives_the_last_states(spark, tmp_path):
    rng = random.Random(3)
    rows = [(k % 7, rng.choice(["queued", "running", "succeeded", "failed"]), k, _at(rng.randrange(40))) for k in range(60)]
    rng.shuffle(rows)
    run = _runner(spark, tmp_path, late="3650 days")
    want = {}
    for id_, status, number, at in rows:
        want[id_] = max(want.get(id_, (at, status, number)), (at, status, number))
    run(rows[:25], rows[25:30])
    assert run(rows[30:]) == {k: (v[1], v[2], None) for k, v in want.items()}  # from its checkpoint on
    assert run() == {k: (v[1], v[2], None) for k, v in want.items()}


def test_stuck_jobs_time_out_and_late_rows_are_passed_over(spark, tmp_path):
    run = _runner(spark, tmp_path, late="10 minutes", stuck_after_ms=30 * 60_000)
    first = [(1, "queued", 1, _at(0)), (2, "running", 2, _at(1)), (3, "running", 3, _at(2))]
    later = [(3, "succeeded", 4, _at(20)), (4, "queued", 5, _at(70))]
    found = run(first, later, [(4, "running", 6, _at(90))], [(4, "succeeded", 8, _at(95)), (1, "running", 7, _at(5))])
    assert found == {1: ("failed", 1, jobs.TIMED_OUT), 2: ("failed", 2, jobs.TIMED_OUT), 3: ("succeeded", 4, None), 4: ("succeeded", 8, None)}


def test_batch_form(spark):
    rows = [(1, "queued", 1, _at(0)), (1, "running", 2, _at(3)), (2, "queued", 3, _at(1))]
    got = jobs.job_changes(spark.createDataFrame(rows, LOG).repartition(3), late="1 day").select("id", "status", F.col("event_id")).collect()
    assert {tuple(r) for r in got} == {(1, "running", 2), (2, "queued", 3)}


def test_without_timers_no_row_is_too_late_and_nulls_are_least(spark, tmp_path):
    run = _runner(spark, tmp_path, late="10 minutes")
    first = [(1, "running", 1, _at(0)), (2, "queued", 2, _at(90)), (5, None, 9, _at(3))]
    found = run(first, [(2, "queued", 3, _at(91))], [(3, "queued", 4, _at(5)), (1, "succeeded", 5, _at(6)), (2, "failed", 6, _at(7)), (5, "queued", 8, _at(3)), (5, "failed", 7, None)])
    assert found == {1: ("succeeded", 5, None), 2: ("queued", 3, None), 3: ("queued", 4, None), 5: ("queued", 8, None)}


def test_states_without_timers_are_kept_without_python(spark, tmp_path):
    stream = spark.readStream.schema(LOG).parquet(str(tmp_path))
    plan = lambda **options: jobs.job_changes(stream, **options)._jdf.queryExecution().analyzed().toString()
    assert "TransformWithState" in plan(stuck_after_ms=1) and "TransformWithState" not in plan()


def test_timers_follow_a_longer_time_to_be_stuck(spark, tmp_path):
    _runner(spark, tmp_path, late="10 minutes", stuck_after_ms=30 * 60_000)([(1, "queued", 1, _at(0))])
    run = _runner(spark, tmp_path, late="10 minutes", stuck_after_ms=120 * 60_000)
    assert run([(2, "succeeded", 2, _at(60))]) == {1: ("queued", 1, None), 2: ("succeeded", 2, None)}
    assert run([(2, "succeeded", 3, _at(140))]) == {1: ("failed", 1, jobs.TIMED_OUT), 2: ("succeeded", 3, None)}
