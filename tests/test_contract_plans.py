"""Driver contract and physical-plan properties."""

import re
import subprocess
import sys

from babelqa.operators import records as RC
from babelqa.operators import repetition as RP
from babelqa.plans import queries as Q
from babelqa.sources import fixtures as FX
from conftest import SF01


def test_registry_imports_without_session():
    code = ("import sys; sys.path.insert(0, '.'); import __spark_entry__ as E; "
            "q, o = E.queries(), E.oracle_sql(); assert set(o) <= set(q); print(len(q), len(o))")
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=120,
                         cwd=__file__.rsplit("/tests/", 1)[0])
    assert out.returncode == 0, out.stderr[-2000:]


def test_entry(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) >= 1 and {"expected_lang", "n", "exact_match"} <= set(df.columns)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_lookup_is_broadcast(spark):
    x = RC.with_subset_parts(FX.qa(spark, SF01), strict=True)
    p = plan(RC.with_country_name(x, FX.countries(spark)))
    assert "BroadcastHashJoin" in p or "BroadcastExchange" in p


def test_scan_prunes_columns(spark):
    p = Q.q_lang_prefix(spark, SF01)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,lang:string,source:string>" in p


def test_native_summary_has_no_python(spark):
    p = plan(Q.q_eval_summary(spark, SF01))
    assert "Python" not in p and "ArrowEval" not in p


def test_ngram_operator_single_shuffle(spark):
    # broadcasts off, as for large inputs: no join may sneak in a second shuffle
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        for op in (RP.first_repeated_ngram, RP.trim_repetition):
            df = op(Q._doc_tokens(spark, SF01))
            df.write.format("noop").mode("overwrite").save()
            final = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
            # one repartition of the documents by key; windows and aggregates reuse it
            shuffles = [ln for ln in final.splitlines() if "Exchange" in ln and "Reused" not in ln]
            assert len(shuffles) == 1 and "hashpartitioning(row_id" in shuffles[0], final
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")


def test_required_columns_and_lookup_errors(spark):
    import pytest
    from babelqa.operators import lookups as LK
    df = spark.createDataFrame([(1, "Xyz_Abc", "q")], "row_id long, subset string, input string")
    with pytest.raises(ValueError, match="missing required"):
        RC.build_sft(df, "train", FX.countries(spark))
    with pytest.raises(Exception, match="no max_new_tokens"):
        LK.with_max_len(df, FX.max_lens(spark)).collect()
    # unknown country code passes through
    x = RC.with_country_name(RC.with_subset_parts(df, strict=True), FX.countries(spark)).first()
    assert x.country_name == "Abc"
    a = spark.createDataFrame([(1, "a"), (2, "b")], "row_id long, answer string")
    with pytest.raises(Exception, match="do not align"):
        LK.align_answers(df.select("row_id", "input"), a).collect()


def test_pad_id_falls_back_to_eos(spark):
    from babelqa.operators import batching as BT
    df = spark.createDataFrame([(0, 0, [1, 2]), (1, 0, [3])], "row_id long, batch long, ids array<int>")
    out = {r.row_id: r.input_ids for r in BT.pad_batches(df, pad_id=None, eos_id=99, side="right").collect()}
    assert out[1] == [3, 99]


def test_language_is_never_a_shuffle_key_of_rows(spark):
    """Facts per language are joined map-side from written tables; only aggregated tables are
    shuffled by language."""
    for name in ("stratified_sample", "batch_plan", "training_table"):
        lines = plan(Q.QUERIES[name](spark, SF01)).splitlines()
        assert not any(re.search(r"hashpartitioning\(lang#\d+, \d+\)", ln) for ln in lines), name
        assert not any("SinglePartition" in ln for ln in lines), name


def test_training_table_plan_is_short(spark):
    p = plan(Q.QUERIES["training_table"](spark, SF01))
    assert p.count("Exchange") < 20 and "Python" not in p


def test_rouge_is_one_narrow_pass(spark):
    """Scoring moves no row and evaluates its function once: the exchanges are the input's."""
    given = plan(Q.QUERIES["answer_fallback"](spark, SF01)).count("Exchange")
    for name in ("rouge1", "rouge_score", "rougeL_counts"):
        p = plan(Q.QUERIES[name](spark, SF01))
        assert p.count("Exchange") == given and len(re.findall(r"ArrowEvalPython \[pair_", p)) == 1, name
    p = plan(Q.QUERIES["gen_metrics_scored"](spark, SF01))
    assert len(re.findall(r"ArrowEvalPython \[pair_scores\(", p)) == 1 and p.count("pair_scores(") == 1


def test_scratch_needs_a_shared_folder_off_local_masters(spark, monkeypatch):
    import pytest
    from babelqa import session as S

    class Conf:
        def get(self, key, default=None):
            return None

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        S.ensure_checkpoint_dir(Session())


def test_workers_need_no_path(tmp_path):
    """Started from another folder, with the package found by the driver alone."""
    root = __file__.rsplit("/tests/", 1)[0]
    code = (f"import sys; sys.path.insert(0, {root!r})\n"
            "from babelqa.session import get_session\n"
            "from babelqa.operators.scoring import rouge_score\n"
            "s = get_session('local[1]', shuffle_partitions=1)\n"
            "df = s.createDataFrame([('running dogs', 'the dog runs')], 'gold_answer string, gen_answer string')\n"
            "print('SCORE', rouge_score(df).first().rouge1_f1)")
    import os
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=180, cwd=tmp_path, env=env)
    assert "SCORE 0.8" in out.stdout, out.stderr[-1500:]


def test_materialised_tables_live_under_checkpoint_dir(spark):
    import glob
    import os

    from babelqa.operators.ranking import with_row_id
    base = spark.conf.get("spark.checkpoint.dir").replace("file:", "")
    before = set(glob.glob(os.path.join(base, "babelqa-ranked-*")))
    with_row_id(spark.range(10), ["id"]).collect()
    assert len(set(glob.glob(os.path.join(base, "babelqa-ranked-*"))) - before) == 1
