"""Quoted CSV read by many tasks per file, and numbering in file order, against one-task reads."""

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from babelqa.operators import ranking as R
from babelqa.sources.csv_split import split_lines, split_states
from babelqa.sources.qa import QA_SCHEMA, read_qa, read_qa_indexed


@pytest.fixture
def tiny(spark):
    """A session that cuts files into splits of 2,000 bytes."""
    s = spark.newSession()
    s.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    s.conf.set("spark.sql.files.openCostInBytes", "1")
    return s


def body(rng, n, more=()):
    words = ['a', 'b,c', '"', '""', 'x\ny', '\n', '\n\n', 'é ü', 'tail ', '', ' lead', "it's", ';', '日本', *more]
    return "".join(rng.choice(words) for _ in range(rng.randrange(n)))


def write(path, rows, end="\n"):
    out = io.StringIO()
    w = csv.writer(out, quoting=csv.QUOTE_ALL, lineterminator=end)
    w.writerow(["ID", "subset", "input", "output"])
    w.writerows(rows)
    path.write_bytes(out.getvalue().encode())


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("seed,end", [(0, "\n"), (2, "\r\n")])
def test_equals_the_one_task_reader(spark, tiny, tmp_path, seed, end):
    rng, more = random.Random(seed), ["r\r"] if end == "\n" else []   # Spark's reader rewrites breaks of \r\n files in texts
    for name in ("b", "a"):
        rows = [(f"{name}{k}", rng.choice(["Eng_Ken", "Swa_Ken"]), body(rng, 12), body(rng, 30, more) if k % 9 else "z\n," * 2000) for k in range(30)]
        write(tmp_path / f"{name}.csv", rows, end)
    path = str(tmp_path)
    want = rows_of(read_qa(spark, path))
    got = read_qa(tiny, path, split=True)
    assert rows_of(got) == want and len(want) == 60
    lines = split_lines(tiny, path)
    assert lines.select("_file", "_block").distinct().count() > 6
    assert lines.rdd.getNumPartitions() > 2
    state = split_states(lines).collect()
    # borders inside quotes, splits that lie wholly inside one field
    assert any(r.starts_open and not r.ends_open for r in state) and any(r.starts_open and r.ends_open for r in state)


def test_plain_fields_nulls_blank_lines_and_markers(spark, tiny, tmp_path):
    text = 'ID,subset,input,output\n1,Eng_Ken,,NA\n\n2,,q,a\n3,Eng_Ken,"say ""hi""\n\nthere",""\n4,Eng_Ken,only\n5,Swa_Ken,"open to the end\nof the file'
    (tmp_path / "x.csv").write_text(text * 1)
    for kw in ({}, {"na_values": ("NA",)}, {"drop_null_subset": False}):
        assert rows_of(read_qa(tiny, str(tmp_path), split=True, **kw)) == rows_of(read_qa(spark, str(tmp_path), **kw))
    (tmp_path / "x.csv").write_text("ID,subset,input,output\n")
    assert read_qa(tiny, str(tmp_path), split=True).count() == 0
    (tmp_path / "x.csv").write_text("")
    assert read_qa(tiny, str(tmp_path), split=True).count() == 0
    with pytest.raises(ValueError, match="CSV"):
        read_qa(tiny, str(tmp_path), fmt="json", split=True)


def test_shuffled_by_split_beyond_the_broadcast(spark, tiny, tmp_path, monkeypatch):
    rng = random.Random(5)
    write(tmp_path / "a.csv", [(str(k), "Eng_Ken", body(rng, 9), body(rng, 60)) for k in range(60)])
    want = rows_of(read_qa(spark, str(tmp_path)))
    monkeypatch.setattr(R, "BROADCAST_SPLITS", 0)
    assert rows_of(read_qa(tiny, str(tmp_path), split=True)) == want
    got = read_qa_indexed(tiny, str(tmp_path), split=True).orderBy("row_id").collect()
    assert [(r.row_id, r.ID) for r in got] == [(k, str(k)) for k in range(60)]


@pytest.mark.parametrize("split", [True, False])
def test_numbers_follow_the_files(tiny, tmp_path, split):
    rng = random.Random(7)
    want = []
    for name in ("c", "a", "b"):
        rows = [(f"{name}{k}", "Eng_Ken", body(rng, 9), body(rng, 50)) for k in range(30)]
        write(tmp_path / f"{name}.csv", rows)
        want.append((name, [r[0] for r in rows]))
    x = read_qa_indexed(tiny, str(tmp_path), split=split)
    got = x.orderBy("row_id").collect()
    assert [r.row_id for r in got] == list(range(90))
    assert [r.ID for r in got] == [i for _, ids in sorted(want) for i in ids]


def test_numbers_skip_dropped_rows(tiny, tmp_path):
    rng = random.Random(8)
    ids = []
    lines = ["ID,subset,input,output"]
    for k in range(90):
        subset = "" if rng.random() < 0.3 else "Eng_Ken"
        ids += [str(k)] if subset else []
        lines.append(f'{k},{subset},"q\n{"z" * rng.randrange(30)}",a')
    (tmp_path / "a.csv").write_text("\n".join(lines) + "\n")
    got = read_qa_indexed(tiny, str(tmp_path), split=True).orderBy("row_id").collect()
    assert [(r.row_id, r.ID) for r in got] == list(enumerate(ids))
    fresh = read_qa_indexed(tiny, str(tmp_path), split=True, schema=type(QA_SCHEMA)(QA_SCHEMA.fields[1:]))
    assert "ID" in fresh.columns and fresh.where("ID <> row_id").count() == 0


def test_file_order_needs_no_exchange_of_rows(tiny, tmp_path):
    tiny.range(5000).selectExpr("id", "repeat('x', 50) AS t").repartition(6).write.parquet(str(tmp_path / "p"))
    df = tiny.read.parquet(str(tmp_path / "p"))
    x = R.in_file_order(df.where("id % 3 = 0"))
    plan = x._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "Exchange rangepartitioning" not in plan and "Sort " not in plan
    rows = x.orderBy("row_id").collect()
    assert [r.row_id for r in rows] == list(range(len(rows))) and len({r.id for r in rows}) == len(rows) == 1667


def test_other_splits_than_counted_are_an_error(tiny, tmp_path):
    tiny.range(4000).repartition(1).write.parquet(str(tmp_path / "p"))
    df = tiny.read.parquet(str(tmp_path / "p"))
    placed = R.file_places(df)
    counts = R.split_offsets(R.split_counts(placed)).withColumn("_first", F.col("_first") + 3)
    with pytest.raises(Exception, match="split anew"):
        R.numbered_in_splits(placed, counts, "row_id").collect()
