"""Sources, sinks, streaming = batch, inference isolation and the end-to-end runs."""

import pytest
from pyspark.sql import functions as F

from babelqa.operators import inference as INF
from babelqa.operators import lookups as LK
from babelqa.operators import metrics as MT
from babelqa.operators.records import clean_generation
from babelqa.operators.scoring import KEPT_FOLDERS, kept_stems, rouge_score, score_answers
from babelqa.plans import evaluation as EV
from babelqa.plans import training as TR
from babelqa.sources import fixtures as FX
from babelqa.session import measured
from babelqa.sources.qa import QA_SCHEMA, read_qa, read_qa_indexed
from babelqa.sources.results import folder_count, read_results
from babelqa.sources.sinks import write_csv, write_incremental, write_training_set
from babelqa.streaming.scoring import scored, stream_scoring
from babelqa.streaming.windows import stream_log_windows
from conftest import SF001, SF01
from model_stubs import echo_predictor, failing_predictor


def test_csv_round_trip(spark, scratch):
    rows = [("1", "Eng_Ken", ' lead "quoted"\nsecond line ', "x,y"), ("2", None, "q", ""), ("3", "Swa_Ken", "NA", "b")]
    df = spark.createDataFrame(rows, "ID string, subset string, input string, output string")
    path = write_csv(df, scratch("csv"))
    back = {r.ID: r for r in read_qa(spark, path, na_values=("NA",)).collect()}
    assert set(back) == {"1", "3"}  # NULL subset dropped
    assert back["1"].input == ' lead "quoted"\nsecond line ' and back["1"].output == "x,y"
    assert back["3"].input is None
    assert read_qa(spark, path, drop_null_subset=False).count() == 3


def test_training_set_and_incremental(spark, scratch):
    ex = TR.training_examples(FX.qa(spark, SF001), FX.countries(spark))
    path = write_training_set(ex, scratch("train"))
    assert spark.read.parquet(path).count() == ex.count() > 0
    one = ex.first()
    assert len(one.ids) == len(one.labels) and one.labels[0] == -100 and one.labels[-1] != -100
    batches = TR.training_batches(ex, micro=4, accum=2)
    assert batches.where(F.size("input_ids") != F.size("labels_padded")).count() == 0
    out = scratch("incr")
    few = ex.select("row_id", "subset").limit(3)
    assert [write_incremental(few, out, b, columns=["row_id"]) for b in ("1", "2", "1")] == [3, 3, None]
    assert read_results(spark, out).columns == ["row_id"] and read_results(spark, out).count() == 6


def test_stream_scoring_equals_batch(spark, scratch):
    gen = FX.gen(spark, SF001)
    src = scratch("in")
    gen.repartition(3).write.parquet(src)
    out, ck = scratch("out"), scratch("ck")
    stream_scoring(spark, src, out, ck, gen.schema)
    streamed = {tuple(r) for r in scored(spark, out).collect()}
    batch = {tuple(r) for r in score_answers(clean_generation(gen)).collect()}
    assert streamed == batch and len(batch) > 0


def test_stream_windows_equal_batch(spark, scratch):
    seqs = MT.token_counts(MT.token_positions_to_sequences(FX.tok_pred(spark, SF01))).select(
        "seq_id", "step", "subset", "correct", "total")
    src = scratch("win-in")
    seqs.repartition(4).write.parquet(src)
    sdf = spark.readStream.schema(seqs.schema).option("maxFilesPerTrigger", 1).parquet(src)
    streamed = {(r.log_window, r.lang, r.correct, r.total) for r in
                stream_log_windows(spark, sdf, 10, scratch("win-out"), scratch("win-ck")).collect()}
    batch = {(r.log_window, r.lang, r.correct, r.total) for r in MT.token_accuracy(seqs, every=10).collect()}
    assert streamed == batch


def test_inference_failure_isolation(spark):
    qa = FX.qa(spark, SF001)
    fails = failing_predictor(lambda b: bool((b["row_id"] % 3 == 0).any()), echo_predictor())
    out = INF.batch_infer(qa, fails, batch_size=4).collect()
    by_batch = {}
    for r in out:
        by_batch.setdefault(r.batch, []).append(r)
    for rows in by_batch.values():
        failed = any(r.row_id % 3 == 0 for r in rows)
        assert all((r.error is not None) == failed for r in rows)
        assert all((r.answer == "") == failed for r in rows)
        assert len(rows) <= 4
    assert len(out) == qa.count()


def test_inference_answers_every_row(spark):
    df = spark.createDataFrame([(1, "q1", "a"), (1, "q2", "b"), (None, "q3", "c")], "row_id long, input string, output string")
    out = INF.batch_infer(df, echo_predictor(), batch_size=2).collect()
    assert sorted(r.answer for r in out) == ["q1 a a", "q2 b b", "q3 c c"]


def test_eval_run_over_predicted_answers(spark):
    qa = FX.qa(spark, SF001)
    prompts = EV.eval_prompts(qa, FX.countries(spark), "qwen")
    answers = measured(INF.batch_infer(prompts, echo_predictor()).select("row_id", "answer"), "predicted")
    records, summary = EV.eval_run(qa, answers, sample_size=20)
    assert 0 < records.count() <= 20
    s = summary.collect()
    assert any(r.expected_lang is None for r in s)
    assert {"rouge1_f1", "rougeL_f1", "score", "exact_match"} <= set(summary.columns)


def test_align_fails_on_repeated_null_and_missing_keys(spark):
    q = spark.createDataFrame([(1, "x"), (2, "y")], "row_id long, input string")
    good = spark.createDataFrame([(2, "b"), (1, "a")], "row_id long, answer string")
    assert sorted((r.row_id, r.answer) for r in LK.align_answers(q, good).collect()) == [(1, "a"), (2, "b")]
    for bad in ([(1, "a")], [(1, "a"), (2, "b"), (2, "c")], [(1, "a"), (2, "b"), (3, "c")], [(1, "a"), (2, "b"), (None, "c")]):
        with pytest.raises(Exception, match="do not align"):
            LK.align_answers(q, spark.createDataFrame(bad, "row_id long, answer string")).collect()
    with pytest.raises(Exception, match="do not align"):
        LK.align_answers(q.unionByName(q), good).select("row_id").collect()


def test_unknown_subset_fails_whatever_is_selected(spark):
    df = spark.createDataFrame([(1, "Xyz_Abc")], "row_id long, subset string")
    for cols in (["row_id"], ["subset"], ["max_new_tokens"]):
        with pytest.raises(Exception, match="no max_new_tokens"):
            LK.with_max_len(df, FX.max_lens(spark)).select(*cols).collect()


def test_files_are_numbered_in_order(spark, tmp_path):
    for k, name in enumerate(("b.csv", "a.csv", "c.csv")):
        lines = ["subset,input,output"] + [f'Eng_Ken,"q{k}\nline {j}",a' for j in range(3)] + [",dropped,a"]
        (tmp_path / name).write_text("\n".join(lines) + "\n")
    schema = type(QA_SCHEMA)([f for f in QA_SCHEMA.fields if f.name != "ID"])
    got = [(r.row_id, r.ID, r.input) for r in read_qa_indexed(spark, str(tmp_path), schema=schema).orderBy("row_id").collect()]
    assert got == [(3 * i + j, 3 * i + j, f"q{k}\nline {j}") for i, k in enumerate((1, 0, 2)) for j in range(3)]


def test_training_table(spark):
    import __spark_entry__ as E
    t = E.queries()["training_table"](spark, SF001)
    rows = t.collect()
    assert rows and all(r.n_labels > 0 for r in rows)
    per_micro = {}
    for r in rows:
        per_micro.setdefault(r.micro_batch, set()).add(r.padded_len)
    assert all(len(v) == 1 for v in per_micro.values())  # one padded length per micro-batch


def test_inference_raise_mode(spark):
    qa = FX.qa(spark, SF001)
    always = failing_predictor(lambda b: True, echo_predictor())
    with pytest.raises(Exception, match="simulated generation failure"):
        INF.batch_infer(qa, always, on_error="raise").collect()


def test_later_micro_batches_stem_no_old_word(spark, scratch):
    kept = scratch("stems")
    one = spark.createDataFrame([(["running", "dogs"],), (["dogs", None],)], "t array<string>")
    table, n = kept_stems(one, "t", kept)
    assert n == 3 and {(r.word, r.stem) for r in table.collect()} == {("running", "run"), ("dogs", "dog"), (None, None)}
    assert kept_stems(one.where("t[1] = 'dogs'"), "t", kept)[1] == 0
    two = spark.createDataFrame([(["dogs", "jumping"],)], "t array<string>")
    table, n = kept_stems(two, "t", kept)
    assert n == 1 and table.where("word IS NOT NULL").count() == 3
    for k in range(20):
        table, n = kept_stems(spark.createDataFrame([([f"word{k}"],)], "t array<string>"), "t", kept)
        assert n == 1 and folder_count(spark, kept) <= KEPT_FOLDERS
    assert table.where("word IS NOT NULL").count() == 23


def test_kept_dictionary_gives_the_same_scores(spark, scratch):
    """Equal and NULL keys stay apart, odd column names come back, both ways score alike."""
    rows = [(k % 7 if k % 5 else None, f"a{k} running dogs the" if k % 6 else None, f"a{k} the run {'dog ' * (k % 4)}" if k % 9 else "", "x.y")
            for k in range(60)]
    df = spark.createDataFrame(rows, "`row.id` long, output string, gen_answer string, `_g` string").repartition(5)
    narrow = sorted(map(str, rouge_score(df, "output").collect()))
    kept = scratch("stems")
    assert sorted(map(str, rouge_score(df, "output", stems=kept).collect())) == narrow and len(narrow) == 60
    assert sorted(map(str, rouge_score(df, "output", stems=kept).collect())) == narrow
    plan = rouge_score(df, "output")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1      # the input's own


def test_stream_scoring_resumes_from_checkpoint(spark, scratch):
    gen = FX.gen(spark, SF001)
    first, second = gen.where("row_id % 2 = 0"), gen.where("row_id % 2 = 1")
    src, out, ck = scratch("rs-in"), scratch("rs-out"), scratch("rs-ck")
    first.repartition(2).write.parquet(src)
    stream_scoring(spark, src, out, ck, gen.schema)
    n1 = scored(spark, out).count()
    second.repartition(2).write.mode("append").parquet(src)
    stream_scoring(spark, src, out, ck, gen.schema)  # restart: only the new files are scored
    done = scored(spark, out)
    assert n1 == first.count() and done.count() == gen.count()
    assert {tuple(r) for r in done.collect()} == {tuple(r) for r in score_answers(clean_generation(gen)).collect()}
