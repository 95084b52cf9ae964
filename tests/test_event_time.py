"""Event-time windows as a real stream: watermark, late rows, append output, restarts."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from babelqa.streaming import windows as W

SCHEMA = "id long, t long, subset string, correct long, total long, ts timestamp"


def frame(spark, rows):
    df = spark.createDataFrame([(*r, None) for r in rows], SCHEMA)
    return df.withColumn("ts", F.timestamp_seconds("t"))


def simulate(loads, every, lateness):
    """Closed and open windows and dropped rows, load by load."""
    closed, open_, late, mark, latest = {}, defaultdict(lambda: [0, 0, 0]), defaultdict(int), None, None
    for rows in loads:
        for _, t, subset, correct, total in rows:
            if not total or t is None:
                continue
            lang, start = (subset or "").split("_")[0] or "unknown", t // every * every
            if mark is not None and start + every <= mark:
                late[lang] += 1
                continue
            for k, v in enumerate((correct, total, 1)):
                open_[start, lang][k] += v
        times = [r[1] for r in rows if r[1] is not None and r[4]]
        latest = max([*times, *([] if latest is None else [latest])], default=None)
        if latest is not None:
            mark = max(0, latest - lateness)
            for key in [k for k in open_ if k[0] + every <= mark]:
                closed[key] = tuple(open_.pop(key))
    return closed, {k: tuple(v) for k, v in open_.items()}, dict(late)


def table(df):
    return {(int(r.window_start.timestamp()), r.lang): (r.correct, r.total, r.rows) for r in df.collect()}


@pytest.mark.parametrize("seed", [1])
def test_windows_state_and_late_rows_over_restarts(spark, scratch, seed):
    rng = random.Random(seed)
    loads = []
    for k in range(4):
        rows = [(100 * k + j, max(0, 200 * k + rng.randrange(-150 if j % 5 else -500, 200)), rng.choice(["Eng_Ken", "Swa_Ken", "Aka"]),
                 rng.randrange(3), rng.randrange(4)) for j in range(40)]
        loads.append(rows + [(100 * k + 99, None, "Eng_Ken", 1, 1)])
    src, out, ck = scratch("in"), scratch("out"), scratch("ck")
    for k, rows in enumerate(loads):
        frame(spark, rows).write.mode("append").parquet(src)
        # every load is taken in by a new run that goes on from the checkpoint
        W.stream_event_windows(spark, spark.readStream.schema(SCHEMA).parquet(src), "50 seconds", "100 seconds", out, ck)
        closed, still, late = simulate(loads[:k + 1], 50, 100)
        assert table(W.closed_windows(spark, out)) == closed
    assert table(W.open_windows(spark, ck)) == still and closed and still and late
    got = W.late_rows(spark.read.schema(SCHEMA).parquet(src), W.closed_windows(spark, out), W.open_windows(spark, ck))
    assert {r.lang: r.rows for r in got.collect()} == late


def test_a_run_without_news_changes_nothing(spark, scratch):
    src, out, ck = scratch("in"), scratch("out"), scratch("ck")
    frame(spark, [(k, 10 * k, "Eng_Ken", 1, 2) for k in range(30)]).write.parquet(src)
    for _ in range(2):
        W.stream_event_windows(spark, spark.readStream.schema(SCHEMA).parquet(src), "50 seconds", "20 seconds", out, ck)
        assert table(W.closed_windows(spark, out)) == {(50 * k, "Eng"): (5, 10, 5) for k in range(5)}
        assert table(W.open_windows(spark, ck)) == {(250, "Eng"): (5, 10, 5)}
    assert W.late_rows(spark.read.parquet(src), W.closed_windows(spark, out), W.open_windows(spark, ck)).count() == 0


def test_several_files_in_one_load_and_no_rows(spark, scratch):
    src, out, ck = scratch("in"), scratch("out"), scratch("ck")
    frame(spark, []).write.parquet(src)
    W.stream_event_windows(spark, spark.readStream.schema(SCHEMA).parquet(src), "50 seconds", "20 seconds", out, ck)
    assert W.closed_windows(spark, out).count() == 0
    frame(spark, [(k, 7 * k, "Swa_Ken", 0, 1) for k in range(100)]).repartition(5).write.mode("append").parquet(src)
    W.stream_event_windows(spark, spark.readStream.schema(SCHEMA).parquet(src), "70 seconds", "0 seconds", out, ck)
    assert table(W.closed_windows(spark, out)) == {(70 * k, "Swa"): (0, 10, 10) for k in range(9)}
