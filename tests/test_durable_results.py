"""Resumable inference, the result table that takes a batch once, counts of the writing job."""

import os
import threading

import pytest
from pyspark.sql import functions as F

from babelqa.operators import inference as INF
from babelqa.operators.records import shard
from babelqa.sources import files as FS
from babelqa.sources import results as RS
from babelqa.sources.qa import merge_parts
from babelqa.sources.reports import write_merged, write_reported, write_shards
from babelqa.sources.sinks import write_csv


def counting(log, die_at=None, fail=()):
    """A predictor that notes every row it is called for and may die (the whole job) or fail."""

    def make():
        def predict(batch):
            for k in batch["row_id"]:
                if k == die_at:
                    raise SystemExit("the machine is gone")
            if set(batch["row_id"]) & set(fail):
                raise RuntimeError("simulated generation failure")
            with open(f"{log}/{os.getpid()}-{threading.get_ident()}", "a") as f:
                f.write("".join(f"{k}\n" for k in batch["row_id"]))
            return [f"a{k}" for k in batch["row_id"]]
        return predict
    return make


def called(log):
    return sorted(int(x) for n in os.listdir(log) for x in open(f"{log}/{n}").read().split())


@pytest.fixture
def rows(spark, scratch):
    path = scratch("prompts")
    spark.range(80).select(F.col("id").alias("row_id"), F.concat(F.lit("q"), "id").alias("input")).repartitionByRange(8, "row_id") \
        .write.parquet(path)
    return spark.read.option("mergeSchema", "false").parquet(path)


def test_killed_run_is_resumed(spark, rows, scratch, tmp_path):
    log, out = str(tmp_path), scratch("answers")
    ordered = rows.repartitionByRange(8, "row_id")
    assert INF.answers(spark, out) is None
    with pytest.raises(Exception, match="gone|exited|crashed|SystemExit"):
        INF.infer_durable(ordered, "row_id", counting(log, die_at=79), out, batch_size=5)
    half = INF.answers(spark, out)
    kept = {r.row_id for r in half.collect()} if half is not None else set()
    report = INF.infer_durable(ordered, "row_id", counting(log), out, batch_size=5)
    got = INF.answers(spark, out).collect()
    assert sorted((r.row_id, r.answer) for r in got) == [(k, f"a{k}") for k in range(80)]
    assert kept and 79 not in kept and report["rows"] == 80 - len(kept) and report["failed_rows"] == 0
    # rows of tasks that had ended are not predicted again
    assert all(called(log).count(k) == 1 for k in kept)
    again = INF.infer_durable(ordered, "row_id", counting(log), out)
    assert again["rows"] == 0 and INF.answers(spark, out).count() == 80


def test_one_task_at_a_time_calls_once_per_row(spark, rows, scratch, tmp_path):
    """With nothing in flight when the run stops, each row is predicted exactly once."""
    log, out = str(tmp_path), scratch("answers")
    INF.infer_durable(rows.where("row_id < 37"), "row_id", counting(log), out)
    INF.infer_durable(rows, "row_id", counting(log), out)
    assert called(log) == list(range(80)) and INF.answers(spark, out).select("row_id").distinct().count() == 80


def test_failed_batches_are_counted_and_may_be_retried(spark, rows, scratch, tmp_path):
    log, out = str(tmp_path), scratch("answers")
    one = rows.coalesce(1).sortWithinPartitions("row_id")
    report = INF.infer_durable(one, "row_id", counting(log, fail=(3, 12, 13)), out, batch_size=10)
    assert report == {"rows": 80, "batches": 8, "failed_rows": 20, "failed_batches": 2}
    kept = INF.infer_durable(one, "row_id", counting(log), out)
    assert kept["rows"] == 0 and INF.answers(spark, out).where("error IS NOT NULL").count() == 20
    more = INF.infer_durable(one, "row_id", counting(log, fail=(3,)), out, batch_size=10, retry_failed=True)
    assert (more["rows"], more["failed_rows"]) == (20, 10)
    got = {r.row_id: r for r in INF.answers(spark, out).collect()}
    assert len(got) == 80 and sorted(k for k in got if got[k].error) == list(range(10))
    INF.infer_durable(one, "row_id", counting(log), out, retry_failed=True)
    assert INF.answers(spark, out).where("error IS NULL").count() == INF.answers(spark, out).count() == 80
    assert called(log) == list(range(80))


def test_bad_keys_are_an_error(spark, rows, scratch, tmp_path):
    for bad in (rows.unionByName(rows.limit(1)), rows.withColumn("row_id", F.when(F.col("row_id") > 2, F.col("row_id")))):
        with pytest.raises(ValueError, match="row_id is NULL or repeated"):
            INF.infer_durable(bad, "row_id", counting(str(tmp_path)), scratch("answers"))


def test_a_batch_is_taken_once(spark, scratch):
    out, x = scratch("results"), spark.range(30).withColumn("b", F.pmod("id", F.lit(3)))
    with pytest.raises(FileNotFoundError):
        RS.read_results(spark, out)
    for turn in range(2):
        took = [RS.write_batch(x.where(F.col("b") == k), out, f"batch-{k}", columns=["id"]) for k in range(3)]
        assert took == [None if turn else 10] * 3
    assert sorted(r.id for r in RS.read_results(spark, out).collect()) == list(range(30))


def test_empty_batches(spark, scratch):
    out = scratch("results")
    assert RS.write_batch(spark.range(0), out, "a", keep_empty=False) == 0 and RS.read_results(spark, out).count() == 0
    assert RS.write_batch(spark.range(0), out, "b", keep_empty=False) == 0 and RS.folder_count(spark, out) == 1
    assert RS.write_batch(spark.range(0), out, "c") == 0 and RS.folder_count(spark, out) == 2 and RS.version(spark, out) == 1


def test_reader_during_compaction_sees_all_rows(spark, scratch):
    out = scratch("results")
    for k in range(6):
        RS.write_batch(spark.range(10 * k, 10 * k + 10), out, str(k))
    before = RS.read_results(spark, out)               # planned on the old folders
    assert RS.compact(spark, out, files=1) == 6 and before.count() == 60
    assert RS.read_results(spark, out).count() == 60 and len(RS.read_results(spark, out).inputFiles()) == 1
    assert RS.write_batch(spark.range(5), out, "3") is None and RS.write_batch(spark.range(60, 70), out, "6") == 10
    assert RS.clean(spark, out) == 6 and RS.compact(spark, out) == 2
    assert sorted(r.id for r in RS.read_results(spark, out).collect()) == list(range(70)) and RS.clean(spark, out) == 2


def test_lost_race_is_retried(spark, scratch, monkeypatch):
    out = scratch("results")
    RS.write_batch(spark.range(3), out, "a")
    real, stolen = RS._publish, []

    def late(s, path, number, state):
        if not stolen:                                  # another writer takes the number first
            stolen.append(real(s, path, number, {"folders": state["folders"][:-1], "batches": [*state["batches"][:-1], "other"]}))
        return real(s, path, number, state)

    monkeypatch.setattr(RS, "_publish", late)
    assert RS.write_batch(spark.range(3, 5), out, "b") and stolen == [True]
    assert RS._version(spark, out)[1]["batches"] == ["a", "other", "b"]
    assert sorted(r.id for r in RS.read_results(spark, out).collect()) == list(range(5))


def test_failed_write_leaves_nothing_visible(spark, scratch):
    out = scratch("results")
    RS.write_batch(spark.range(3), out, "a")
    broken = spark.range(5).select(F.when(F.col("id") > 3, F.raise_error(F.lit("broken")).cast("long")).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="broken"):
        RS.write_batch(broken, out, "b")
    assert RS.read_results(spark, out).count() == 3 and RS.write_batch(spark.range(3, 8), out, "b")
    assert RS.read_results(spark, out).count() == 8


def test_created_files_are_whole_or_absent(spark, scratch):
    path = scratch("file") + "/x"
    assert FS.create(spark, path, "é1") and not FS.create(spark, path, "2") and FS.read_text(spark, path) == "é1"
    assert FS.files(spark, path.rsplit("/", 1)[0]) == ["x"] and FS.folders(spark, path + "/none") == []


def test_counts_come_out_of_the_writing_job(spark, scratch):
    x = shard(spark.range(100).select(F.col("id").alias("row_index")), 3)
    base = scratch("shards")
    got = write_shards(x, 3, lambda d: d.write.partitionBy("shard").parquet(base))
    assert got == {"rows": 100, "shard_0": 34, "shard_1": 33, "shard_2": 33}
    parts = [f"{scratch('part')}/p{k}" for k in range(3)]
    for k, p in enumerate(parts):
        write_csv(spark.range(k * 5).selectExpr("CAST(id AS STRING) AS ID"), p)
    merged = merge_parts(spark, parts, schema=spark.createDataFrame([], "ID string").schema)
    out = scratch("merged")
    assert write_merged(merged, parts, lambda d: write_csv(d.drop("part_file"), out)) == {"rows": 15, "part_0": 0, "part_1": 5, "part_2": 10}
    assert write_reported(spark.range(0), lambda d: d.write.parquet(scratch("none")), {"x": F.col("id") > 0}) == {"rows": 0, "x": 0}
