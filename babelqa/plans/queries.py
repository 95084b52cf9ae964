"""Registered queries: one per operator of the blueprint, each over the driver's tables.

``QUERIES[name](spark, sf_dir) -> DataFrame`` runs the Spark operator; ``ORACLE[name]``
is the same question in DuckDB SQL (tables are pre-registered views there). Every
computed column is aliased identically on both sides. Arrays of messages or ids are
reported as rows (``posexplode``) or joined to text so both engines compare plain values.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..constants import LOSSLESS_TOKEN_PATTERN
from ..constants import WORD_PATTERN
from ..functions import arrays as A
from ..functions import locale as L
from ..functions import params as PR
from ..functions import prompts as P
from ..functions import rouge as RG
from ..functions import text as TX
from ..operators import batching as BT
from ..operators import lookups as LK
from ..operators import metrics as MT
from ..operators import records as RC
from ..operators import repetition as RP
from ..operators import sampling as SM
from ..operators import scoring as SC
from ..operators import vocab as VC
from ..operators.ranking import with_row_id
from ..sources import fixtures as FX
from ..session import measured
from ..sources.qa import QA_SCHEMA, read_qa, read_qa_indexed
from . import duck as D
from . import duck_rouge as DR
from . import evaluation as EV
from . import submission as SU
from . import training as TRN

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None, views=(), extra=()):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = FX.with_views(sql, *views, extra=extra)
        return fn
    return deco


def _messages_long(df: DataFrame, col: str, keys) -> DataFrame:
    return df.select(*keys, F.posexplode(col).alias("msg_pos", "m")).select(
        *keys, "msg_pos", F.col("m.role").alias("role"), F.col("m.content").alias("content"))


def _answers(spark, sf):
    return RC.clean_generation(FX.gen(spark, sf))


_ANSWERS_SQL = f"""SELECT *, {D.with_fallback(D.strip_thinking('raw_answer', 'input'))} AS gen_answer FROM gen"""


# ------------------------------------------------------------------ 2.10 scalar ----

@query("py_strip", f"SELECT row_id, {D.py_strip('raw_answer')} AS stripped FROM gen", ["gen"])
def q_py_strip(spark, sf):
    return FX.gen(spark, sf).select("row_id", TX.py_strip("raw_answer").alias("stripped"))


@query("strip_thinking", f"SELECT row_id, {D.strip_thinking('raw_answer', 'input')} AS cleaned FROM gen", ["gen"])
def q_strip_thinking(spark, sf):
    return FX.gen(spark, sf).select("row_id", TX.strip_thinking("raw_answer", "input").alias("cleaned"))


@query("strip_echo", f"SELECT row_id, {D.strip_echo('raw_answer', 'input')} AS cleaned FROM gen", ["gen"])
def q_strip_echo(spark, sf):
    return FX.gen(spark, sf).select("row_id", TX.strip_echo("raw_answer", "input").alias("cleaned"))


@query("answer_fallback", f"SELECT row_id, {D.with_fallback('raw_answer')} AS answer FROM gen", ["gen"])
def q_answer_fallback(spark, sf):
    return FX.gen(spark, sf).select("row_id", TX.with_fallback("raw_answer").alias("answer"))


_ANS = [("ans", _ANSWERS_SQL)]


@query("exact_match", f"SELECT row_id, {D.exact_match('gen_answer', 'output')} AS exact_match FROM ans",
       ["gen"], _ANS)
def q_exact_match(spark, sf):
    return _answers(spark, sf).select("row_id", TX.exact_match("gen_answer", "output").alias("exact_match"))


# ------------------------------------------------------------------ 2.2 locale -----

@query("subset_strict", """SELECT row_id, split_part(subset, '_', 1) AS lang, split_part(subset, '_', 2) AS country
FROM qa""", ["qa"])
def q_subset_strict(spark, sf):
    lang, country = L.subset_parts_strict("subset")
    return FX.qa(spark, sf).select("row_id", lang.alias("lang"), country.alias("country"))


@query("subset_lenient", f"""SELECT row_id, {D.lenient_lang('subset')} AS lang,
  {D.lenient_country('subset')} AS country FROM docs""", ["docs"])
def q_subset_lenient(spark, sf):
    lang, country = L.subset_parts_lenient("subset")
    return FX.docs(spark, sf).select("row_id", lang.alias("lang"), country.alias("country"))


@query("lang_prefix", f"SELECT row_id, {D.lang_of('subset')} AS lang FROM docs", ["docs"])
def q_lang_prefix(spark, sf):
    return FX.docs(spark, sf).select("row_id", L.lang_of("subset").alias("lang"))


@query("model_family", """SELECT conv_id, turn,
  CASE WHEN contains(lower(text), 'aya') THEN 'aya' ELSE 'qwen' END AS family FROM conversations""")
def q_model_family(spark, sf):
    c = FX.table(spark, sf, "conversations")
    return c.select("conv_id", "turn", L.model_family("text").alias("family"))


# ------------------------------------------------------------ 2.1 scans/params -----

@query("scan_qa", "SELECT CAST(ID AS VARCHAR) AS ID, subset, input, output FROM qa", ["qa"])
def q_scan_qa(spark, sf):
    """Write the QA view as CSV to the shared scratch folder, read it back."""
    from ..session import scratch_path
    from ..sources.sinks import write_csv
    path = scratch_path(spark, "scan-qa")
    write_csv(FX.qa(spark, sf).select(F.col("ID").cast("string").alias("ID"), "subset", "input", "output"), path)
    return read_qa(spark, path)


@query("scan_qa_split", "SELECT CAST(ID AS VARCHAR) AS ID, subset, input, output FROM qa", ["qa"])
def q_scan_qa_split(spark, sf):
    """The QA view as one CSV file, its records cut by many tasks."""
    from ..session import scratch_path
    from ..sources.sinks import write_csv
    path = scratch_path(spark, "scan-split")
    rows = FX.qa(spark, sf).select(F.col("ID").cast("string").alias("ID"), "subset", "input", "output")
    write_csv(rows, path, single_file=True)
    return read_qa(spark, path, split=True)


@query("drop_null_subset", """SELECT CAST(d.row_id AS VARCHAR) AS ID, d.subset FROM docs d JOIN labels l ON d.row_id = l.doc_id""", ["docs"])
def q_drop_null_subset(spark, sf):
    """Subset is NULL in the file for documents without a label row; the reader drops them."""
    from ..session import scratch_path
    from ..sources.sinks import write_csv
    d = FX.docs(spark, sf)
    lab = FX.table(spark, sf, "labels").select(F.col("doc_id").alias("_l"))
    x = d.join(lab, d["row_id"] == lab["_l"], "left").select(
        F.col("row_id").cast("string").alias("ID"), F.when(F.col("_l").isNotNull(), F.col("subset")).alias("subset"),
        F.col("text").alias("input"), F.lit(None).cast("string").alias("output"))
    return read_qa(spark, write_csv(x, scratch_path(spark, "null-subset"))).select("ID", "subset")


@query("row_index", "SELECT row_id, row_number() OVER (ORDER BY row_id) - 1 AS row_index FROM qa", ["qa"])
def q_row_index(spark, sf):
    return with_row_id(FX.qa(spark, sf).select("row_id"), ["row_id"])


def _params_text(spark, sf):
    """Five kinds of parameter text: the event's own object, a wider one, broken, empty, NULL."""
    k = F.pmod("event_id", F.lit(5))
    text = (F.when(k == 0, F.col("props"))
            .when(k == 1, F.concat(F.lit('{"top_k": '), F.col("event_id").cast("string"), F.lit(', "seed": 7, "num_beams": 2}')))
            .when(k == 2, F.concat(F.lit("not json "), F.col("props"))).when(k == 3, F.lit("")))
    return FX.table(spark, sf, "events").select("event_id", text.alias("text"))


_PARAMS = [
    ("pt", """SELECT event_id, CASE event_id % 5 WHEN 0 THEN props
  WHEN 1 THEN '{"top_k": ' || CAST(event_id AS VARCHAR) || ', "seed": 7, "num_beams": 2}'
  WHEN 2 THEN 'not json ' || props WHEN 3 THEN '' END AS text FROM events"""),
    ("pk", """SELECT event_id, text, CASE WHEN text IS NOT NULL AND json_valid(text) THEN json_keys(text)
  ELSE CAST([] AS VARCHAR[]) END AS keys FROM pt"""),
    ("pm", "SELECT *, list_distinct(list_concat(keys, [" + ", ".join(D.sq(k) for k in K.GENERATION_PARAMS) + "])) AS merged FROM pk"),
]
_ACCEPTED = ["do_sample", "k", "num_beams", "seed"]
_ACCEPTED_SQL = "[" + ", ".join(D.sq(k) for k in _ACCEPTED) + "]"


@query("parse_params", """SELECT event_id, CASE WHEN list_contains(keys, 'k') THEN CAST(json_extract_string(text, '$.k') AS VARCHAR) END AS k,
  CAST(len(keys) AS INTEGER) AS n_keys FROM pm""", extra=_PARAMS)
def q_parse_params(spark, sf):
    m = PR.parse_params("text")
    return _params_text(spark, sf).select("event_id", F.try_element_at(m, F.lit("k")).alias("k"), F.size(m).alias("n_keys"))


def _merged_params(spark, sf):
    return _params_text(spark, sf).withColumn("m", LK.merge_params(LK.params_map(K.GENERATION_PARAMS), PR.parse_params("text")))


@query("params_filter", f"""SELECT event_id, array_to_string(list_sort(list_filter(merged, lambda x: list_contains({_ACCEPTED_SQL}, x))), ',')
  AS kept FROM pm""", extra=_PARAMS)
def q_params_filter(spark, sf):
    kept = PR.filter_params("m", allowed=_ACCEPTED)
    return _merged_params(spark, sf).select("event_id", F.array_join(F.array_sort(F.map_keys(kept)), ",").alias("kept"))


@query("params_dropped", f"""SELECT event_id, array_to_string(list_sort(list_filter(merged, lambda x: NOT list_contains({_ACCEPTED_SQL}, x))), ',')
  AS dropped FROM pm""", extra=_PARAMS)
def q_params_dropped(spark, sf):
    return _merged_params(spark, sf).select("event_id", F.array_join(PR.dropped_params("m", allowed=_ACCEPTED), ",").alias("dropped"))


@query("eval_params", f"""SELECT event_id, coalesce(CASE WHEN list_contains(keys, 'num_beams') THEN json_extract_string(text, '$.num_beams') END,
    {D.sq(str(K.GENERATION_PARAMS['num_beams']))}) AS num_beams, '64' AS max_new_tokens,
  array_to_string(list_sort(list_filter(merged, lambda x: NOT list_contains(['max_new_tokens', 'num_beams'], x))), ',') AS dropped
FROM pm""", extra=_PARAMS)
def q_eval_params(spark, sf):
    """Parameters of an evaluation: file over defaults, the new-token override over both,
    keys that the predictor does not accept left out and reported."""
    x = EV.eval_params(_params_text(spark, sf), "text", ["max_new_tokens", "num_beams"], max_new_tokens=64)
    return x.select("event_id", F.col("params")["num_beams"].alias("num_beams"),
                    F.col("params")["max_new_tokens"].alias("max_new_tokens"), F.array_join("dropped", ",").alias("dropped"))


# ------------------------------------------------------------------ 2.3 lookups ----

@query("country_lookup", """SELECT q.row_id, split_part(q.subset, '_', 2) AS country,
  coalesce(c.name, split_part(q.subset, '_', 2)) AS country_name
FROM qa q LEFT JOIN countries c ON split_part(q.subset, '_', 2) = c.code""", ["qa", "countries"])
def q_country_lookup(spark, sf):
    x = RC.with_subset_parts(FX.qa(spark, sf), strict=True)
    return RC.with_country_name(x, FX.countries(spark)).select("row_id", "country", "country_name")


@query("max_len_lookup", """SELECT q.row_id, q.subset, m.max_new_tokens
FROM qa q JOIN max_lens m ON q.subset = m.subset""", ["qa", "max_lens"])
def q_max_len_lookup(spark, sf):
    return LK.with_max_len(FX.qa(spark, sf), FX.max_lens(spark)).select("row_id", "subset", "max_new_tokens")


_ALT_SQL = "SELECT * FROM (VALUES " + ", ".join(f"('{k}', {v})" for k, v in K.MAX_NEW_TOKENS_BY_SUBSET_ALT.items()) + ") t(subset, max_new_tokens)"


@query("max_len_lookup_alt", """SELECT q.row_id, q.subset, m.max_new_tokens
FROM qa q JOIN alt m ON q.subset = m.subset""", ["qa"], [("alt", _ALT_SQL)])
def q_max_len_lookup_alt(spark, sf):
    """The other preset of answer lengths."""
    lens = FX.max_lens(spark, K.MAX_NEW_TOKENS_BY_SUBSET_ALT)
    return LK.with_max_len(FX.qa(spark, sf), lens).select("row_id", "subset", "max_new_tokens")


@query("align_answers", f"""SELECT q.row_id, q.input, a.gen_answer FROM qa q JOIN
  (SELECT row_id, {D.with_fallback(D.strip_thinking('raw_answer', 'input'))} AS gen_answer FROM gen) a
  ON q.row_id = a.row_id""", ["gen"])
def q_align_answers(spark, sf):
    ans = _answers(spark, sf).select("row_id", "gen_answer")
    return LK.align_answers(FX.qa(spark, sf).select("row_id", "input"), ans)


@query("decode_params", """SELECT q.row_id, concat('do_sample=false,max_new_tokens=', CAST(m.max_new_tokens AS VARCHAR),
  ',num_beams=5,use_cache=true') AS params
FROM qa q JOIN max_lens m ON q.subset = m.subset""", ["qa", "max_lens"])
def q_decode_params(spark, sf):
    x = LK.decode_params(FX.qa(spark, sf), FX.max_lens(spark))
    kv = F.transform(F.array_sort(F.map_entries("params")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return x.select("row_id", F.array_join(kv, ",").alias("params"))


_SOME_SUBSETS = list(K.MAX_NEW_TOKENS_BY_SUBSET)[:5]


@query("subset_filter", "SELECT row_id, subset FROM qa WHERE subset IN (" + ", ".join(map(D.sq, _SOME_SUBSETS)) + ")", ["qa"])
def q_subset_filter(spark, sf):
    some = FX.max_lens(spark).where(F.col("subset").isin(_SOME_SUBSETS))
    return RC.per_subset(FX.qa(spark, sf), some).select("row_id", "subset")


@query("required_columns", "SELECT row_id, subset, input, output FROM qa", ["qa"])
def q_required_columns(spark, sf):
    """The columns that evaluation asks for, checked before any job runs."""
    need = ["row_id", "subset", "input", "output"]
    return RC.require_columns(FX.qa(spark, sf), need).select(*need)


# ------------------------------------------------------------------ 2.4 metrics ----

_REC_SQL = f"""SELECT ID, input, output AS gold_answer, gen_answer, {D.lenient_lang('subset')} AS expected_lang,
  {D.lenient_country('subset')} AS expected_country, {D.exact_match('gen_answer', 'output')} AS exact_match
FROM ans"""


def _with_ans(sql: str, *views) -> str:
    return FX.with_views(sql, "gen", *views, extra=_ANS + [("rec", _REC_SQL)])


def _eval_records(spark, sf):
    return RC.to_eval_records(_answers(spark, sf))


@query("eval_records")
def q_eval_records(spark, sf):
    return _eval_records(spark, sf)


ORACLE["eval_records"] = _with_ans("SELECT * FROM rec")


@query("eval_summary")
def q_eval_summary(spark, sf):
    return MT.eval_summary(_eval_records(spark, sf), require_rouge=False)


_SUMMARY_SQL = """SELECT expected_lang, CAST(grouping(expected_lang) AS INTEGER) AS is_overall, count(*) AS n,
  CAST(sum(exact_match) AS BIGINT) AS exact_match_sum, count(*) - count(exact_match) AS exact_match_null,
  CAST(sum(exact_match) AS DOUBLE) / CAST(nullif(count(exact_match), 0) AS DOUBLE) AS exact_match
FROM rec GROUP BY ROLLUP (expected_lang)"""
ORACLE["eval_summary"] = _with_ans(_SUMMARY_SQL)


@query("eval_summary_null_gold")
def q_eval_summary_null_gold(spark, sf):
    """Rows without a gold answer have no score: they are counted, and leave the mean alone."""
    gold = F.when(F.pmod("row_id", F.lit(3)) != 0, F.col("output"))
    rec = RC.to_eval_records(_answers(spark, sf).withColumn("output", gold))
    return MT.eval_summary(rec, require_rouge=False)


ORACLE["eval_summary_null_gold"] = FX.with_views(_SUMMARY_SQL, "gen", extra=[
    ("ans", f"""SELECT row_id, ID, subset, input, CASE WHEN row_id % 3 <> 0 THEN output END AS output,
  {D.with_fallback(D.strip_thinking('raw_answer', 'input'))} AS gen_answer FROM gen"""), ("rec", _REC_SQL)])


@query("submission")
def q_submission(spark, sf):
    return RC.to_submission(_answers(spark, sf))


ORACLE["submission"] = _with_ans(
    "SELECT ID, gen_answer AS TargetRLF1, gen_answer AS TargetR1F1, gen_answer AS TargetLLM FROM ans")


@query("lang_counts", "SELECT lang, count(*) AS n FROM docs GROUP BY lang", ["docs"])
def q_lang_counts(spark, sf):
    return MT.lang_counts(FX.docs(spark, sf))


@query("distinct_first_seen", """SELECT lang, first_seen, row_number() OVER (ORDER BY first_seen, lang) - 1 AS first_rank
FROM (SELECT lang, min(row_id) AS first_seen FROM docs GROUP BY lang) t""", ["docs"])
def q_distinct_first_seen(spark, sf):
    return MT.distinct_first_seen(FX.docs(spark, sf), "lang", "row_id")


def _tok_sequences(spark, sf):
    return MT.token_counts(MT.token_positions_to_sequences(FX.tok_pred(spark, sf)))


_TOKACC = [
    ("shifted", """SELECT seq_id, step, subset, pred_id,
         lead(label_id) OVER (PARTITION BY seq_id ORDER BY pos) AS next_label FROM tok_pred"""),
    ("seqs", """SELECT seq_id, any_value(step) AS step, any_value(subset) AS subset,
         count(*) FILTER (WHERE next_label IS NOT NULL AND next_label <> -100 AND pred_id = next_label) AS correct,
         count(*) FILTER (WHERE next_label IS NOT NULL AND next_label <> -100) AS total
  FROM shifted GROUP BY seq_id"""),
]


@query("token_accuracy")
def q_token_accuracy(spark, sf):
    return MT.token_accuracy(_tok_sequences(spark, sf))


ORACLE["token_accuracy"] = FX.with_views(f"""
SELECT CAST(NULL AS BIGINT) AS log_window, lang, CAST(sum(correct) AS BIGINT) AS correct, CAST(sum(total) AS BIGINT) AS total,
  CAST(sum(correct) AS DOUBLE) / CAST(sum(total) AS DOUBLE) AS accuracy
FROM (SELECT *, {D.lang_of('subset')} AS lang FROM seqs WHERE total > 0) s
GROUP BY ROLLUP (lang) HAVING sum(total) > 0""", "tok_pred", extra=_TOKACC)


@query("log_window_accuracy")
def q_log_window_accuracy(spark, sf):
    return MT.token_accuracy(_tok_sequences(spark, sf), every=10)


ORACLE["log_window_accuracy"] = FX.with_views(f"""
SELECT CAST(floor(step / 10) AS BIGINT) AS log_window, lang, CAST(sum(correct) AS BIGINT) AS correct,
  CAST(sum(total) AS BIGINT) AS total, CAST(sum(correct) AS DOUBLE) / CAST(sum(total) AS DOUBLE) AS accuracy
FROM (SELECT *, {D.lang_of('subset')} AS lang FROM seqs WHERE total > 0) s
GROUP BY GROUPING SETS ((floor(step / 10), lang), (floor(step / 10))) HAVING sum(total) > 0""", "tok_pred",
    extra=_TOKACC)


@query("gen_metrics")
def q_gen_metrics(spark, sf):
    return MT.gen_metrics(_eval_records(spark, sf).withColumn("subset", F.concat_ws(
        "_", "expected_lang", "expected_country")), prefix="eval", metrics=("exact_match",))


def _round4_sql(num: str, den: str) -> str:
    """Half-even rounding of num/den to 4 places with integer arithmetic (exact for
    ratios of counts)."""
    q = f"(({num}) * 10000 // ({den}))"
    r = f"(({num}) * 10000 % ({den}))"
    return (f"(CAST(CASE WHEN 2 * {r} > ({den}) THEN {q} + 1 WHEN 2 * {r} < ({den}) THEN {q} "
            f"ELSE {q} + ({q} % 2) END AS DOUBLE) / 10000.0)")


ORACLE["gen_metrics"] = _with_ans(f"""SELECT CASE WHEN grouping(lang) = 1 THEN 'eval_gen_exact_match'
    ELSE 'eval_gen_exact_match_' || lang END AS metric,
  CASE WHEN grouping(lang) = 1 THEN NULL ELSE lang END AS lang, count(*) AS n,
  {_round4_sql('sum(exact_match)', 'count(*)')} AS value
FROM (SELECT *, {D.lang_of("expected_lang || '_' || expected_country")} AS lang FROM rec) r GROUP BY ROLLUP (lang)
UNION ALL SELECT 'eval_gen_n_samples', NULL, count(*), CAST(count(*) AS DOUBLE) FROM rec""")


# ------------------------------------------------------- 2.6/2.7 sampling, batches --


_SAMPLE_N = 101


@query("stratified_sample")
def q_stratified_sample(spark, sf):
    return SM.stratified_sample(FX.docs(spark, sf), _SAMPLE_N).select("row_id", "lang")


ORACLE["stratified_sample"] = FX.with_views(f"""
SELECT r.row_id, r.lang FROM ranked r JOIN quota q ON r.lang = q.lang WHERE r.pos < q.quota""", "docs", extra=[
    ("d", "SELECT row_id, split_part(subset, '_', 1) AS lang FROM docs WHERE subset IS NOT NULL"),
    ("langs", """SELECT lang, row_number() OVER (ORDER BY min(row_id), lang) - 1 AS rk, count(*) OVER () AS nl
                 FROM d GROUP BY lang"""),
    ("quota", f"SELECT lang, {_SAMPLE_N} // nl + CASE WHEN rk < {_SAMPLE_N} % nl THEN 1 ELSE 0 END AS quota FROM langs"),
    ("ranked", """SELECT row_id, lang, row_number() OVER (PARTITION BY lang
                  ORDER BY md5(concat_ws('|', 42, row_id)), row_id) - 1 AS pos FROM d"""),
])


@query("uniform_sample", """SELECT row_id FROM docs ORDER BY md5(concat_ws('|', 7, row_id)), row_id LIMIT 50""",
       ["docs"])
def q_uniform_sample(spark, sf):
    return SM.uniform_sample(FX.docs(spark, sf), 50, seed=7).select("row_id")


@query("head_n", "SELECT row_id, subset FROM qa ORDER BY row_id LIMIT 50", ["qa"])
def q_head_n(spark, sf):
    return SM.head_n(FX.qa(spark, sf), 50).select("row_id", "subset")


_ALLOC_SQL = [
    ("cnt", "SELECT lang, count(*) AS n FROM docs GROUP BY lang"),
    ("a1", """SELECT lang, n, pow(CAST(n AS DOUBLE), 0.5) / sum(pow(CAST(n AS DOUBLE), 0.5)) OVER () * 64.0 AS raw
              FROM cnt"""),
    ("a2", """SELECT lang, n, raw, CAST(floor(raw) AS BIGINT) AS fl, greatest(CAST(floor(raw) AS BIGINT), 1) AS s
              FROM a1"""),
    ("a3", """SELECT *, sum(s) OVER () AS total, count(*) OVER () AS nl,
                sum(CASE WHEN s > 1 THEN 1 ELSE 0 END) OVER (ORDER BY n DESC, lang
                    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS erank,
                row_number() OVER (ORDER BY raw - fl DESC, lang) - 1 AS frank FROM a2"""),
    ("alloc", """SELECT lang, n, CAST(s
                 - CASE WHEN total > 64 AND s > 1 AND erank <= total - 64 THEN 1 ELSE 0 END
                 + CASE WHEN total < 64 THEN (64 - total) // nl
                        + CASE WHEN frank < (64 - total) % nl THEN 1 ELSE 0 END ELSE 0 END AS BIGINT) AS slots
                 FROM a3"""),
]


def _doc_alloc(spark, sf):
    return BT.lang_allocation(FX.docs(spark, sf).groupBy("lang").agg(F.count(F.lit(1)).alias("n")), 64)


@query("lang_allocation", "SELECT lang, n, slots FROM alloc", ["docs"], _ALLOC_SQL)
def q_lang_allocation(spark, sf):
    return _doc_alloc(spark, sf)


@query("batch_plan_size", """SELECT CAST(ceil(max(n) / max(slots)) AS BIGINT) AS batches,
  CAST(ceil(max(n) / max(slots)) AS BIGINT) * 8 AS reported_len,
  CAST(ceil(max(n) / max(slots)) * ceil(sum(slots) / 8) AS BIGINT) AS real_micro_batches FROM alloc""",
       ["docs"], _ALLOC_SQL)
def q_batch_plan_size(spark, sf):
    return BT.batch_plan_size(_doc_alloc(spark, sf), 8, 8)


_PLAN_CTES = [
    ("dims", """SELECT lang, n, slots, CAST(ceil(max(n) OVER () / max(slots) OVER ()) AS BIGINT) AS batches,
                sum(slots) OVER () AS batch_slots FROM alloc"""),
    ("cyc", "SELECT *, CAST(ceil(batches * slots / n) AS BIGINT) AS cycles FROM dims"),
    ("rows_c", """SELECT d.row_id, c.lang, c.n, c.slots, c.batches, c.batch_slots,
                    unnest(generate_series(0, c.cycles - 1)) AS cycle
                  FROM docs d JOIN cyc c ON d.lang = c.lang"""),
    ("drawn", """SELECT *, cycle * n + row_number() OVER (PARTITION BY lang, cycle
                   ORDER BY md5(concat_ws('|', 42, lang, cycle, row_id)), row_id) - 1 AS d FROM rows_c"""),
]


_PLAN_SELECT = """SELECT effective_batch,
  effective_batch * CAST(ceil(batch_slots / 8) AS BIGINT) + p // 8 AS micro_batch, p % 8 AS micro_pos, lang, row_id, cycle
FROM (SELECT *, row_number() OVER (PARTITION BY effective_batch
        ORDER BY md5(concat_ws('|', 42, 'batch', effective_batch, lang, slot)), lang, slot) - 1 AS p
      FROM (SELECT *, d // slots AS effective_batch, d % slots AS slot FROM drawn WHERE d < batches * slots) t) u"""


@query("batch_plan", _PLAN_SELECT,
       ["docs"], _ALLOC_SQL + _PLAN_CTES)
def q_batch_plan(spark, sf):
    return BT.batch_plan(FX.docs(spark, sf), 8, 8)


@query("micro_batches", """SELECT row_id, row_number() OVER (ORDER BY row_id) - 1 AS row_index,
  (row_number() OVER (ORDER BY row_id) - 1) // 8 AS batch FROM qa""", ["qa"])
def q_micro_batches(spark, sf):
    return BT.micro_batches(FX.qa(spark, sf).select("row_id"), 8)


@query("shard_round_robin", """SELECT row_id, row_number() OVER (ORDER BY row_id) - 1 AS row_index,
  CAST((row_number() OVER (ORDER BY row_id) - 1) % 3 AS INTEGER) AS shard FROM qa""", ["qa"])
def q_shard_round_robin(spark, sf):
    return RC.shard(with_row_id(FX.qa(spark, sf).select("row_id"), ["row_id"]), 3)


_ACCESS_CTES = _ALLOC_SQL + [
    ("dims", """SELECT lang, n, slots, CAST(ceil(max(n) OVER () / max(slots) OVER ()) AS BIGINT) AS batches,
                sum(slots) OVER () AS total, sum(slots) OVER (ORDER BY lang) - slots AS start FROM alloc"""),
    ("pool", """SELECT row_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5(concat_ws('|', 42, row_id)), row_id) - 1 AS place FROM docs"""),
    ("draws", """SELECT b AS effective_batch, lang, n, slots, total, start + j AS slot, b * slots + j AS d FROM
  (SELECT *, unnest(range(0, slots)) AS j FROM (SELECT *, unnest(range(0, batches)) AS b FROM dims) x) y"""),
    ("ask", """SELECT effective_batch * total + slot AS id, d % n AS x, n, concat_ws('|', 42, lang, d // n) AS k FROM draws"""),
    ("found", D.permuted("ask")),
    ("ask2", """SELECT effective_batch * total + slot AS id, slot AS x, CAST(total AS BIGINT) AS n, concat_ws('|', 42, 'batch', effective_batch) AS k FROM draws"""),
    ("shuffled", D.permuted("ask2")),
]


@query("batch_plan_access", """SELECT w.effective_batch, CAST(w.effective_batch * CAST(ceil(total / 8) AS BIGINT) + s.y // 8 AS BIGINT) AS micro_batch,
  s.y % 8 AS micro_pos, w.lang, p.row_id, w.d // w.n AS cycle
FROM draws w JOIN found f ON f.id = w.effective_batch * w.total + w.slot JOIN shuffled s ON s.id = f.id
JOIN pool p ON p.lang = w.lang AND p.place = f.y""", ["docs"], _ACCESS_CTES)
def q_batch_plan_access(spark, sf):
    """The plan by random access: its second half computed without the first, then the first."""
    index, facts = BT.plan_index(FX.docs(spark, sf), 8, 8)
    batches = facts[0]["batches"] if facts else 0
    late, early = ((batches // 2, batches), (0, batches // 2))
    return BT.plan_batches(index, facts, *late, micro=8).unionByName(BT.plan_batches(index, facts, *early, micro=8))


@query("shard_counts", """SELECT shard, count(*) AS rows FROM (SELECT CAST((row_number() OVER (ORDER BY row_id) - 1) % 3
  AS INTEGER) AS shard FROM qa) t GROUP BY ROLLUP (shard)""", ["qa"])
def q_shard_counts(spark, sf):
    s = RC.shard(with_row_id(FX.qa(spark, sf).select("row_id"), ["row_id"]), 3)
    return s.rollup("shard").agg(F.count(F.lit(1)).alias("rows"))


@query("union_shards", "SELECT row_id, subset FROM qa", ["qa"])
def q_union_shards(spark, sf):
    s = RC.shard(with_row_id(FX.qa(spark, sf).select("row_id", "subset"), ["row_id"]), 3)
    return SM.union_shards(*[s.where(F.col("shard") == i) for i in range(3)]).select("row_id", "subset")


@query("default_id", "SELECT row_id, row_number() OVER (ORDER BY row_id) - 1 AS ID FROM docs", ["docs"])
def q_default_id(spark, sf):
    return RC.with_id(FX.docs(spark, sf).select("row_id"), "row_id")


# ------------------------------------------------------------------ 2.8 prompts ----

_SYS = D.sq(K.SYSTEM_PROMPT)
_MARK = D.sq(K.ANSWER_MARKER)
_STUDENT_SQL = ("CASE WHEN lang <> '' OR country <> '' THEN concat(chr(10), 'Answer in ', lang, chr(10), "
                "'Question:', chr(10), input) ELSE input END")
_QA_PARTS = [("qp", """SELECT q.*, split_part(q.subset, '_', 1) AS lang,
    coalesce(c.name, split_part(q.subset, '_', 2)) AS country
  FROM qa q LEFT JOIN countries c ON split_part(q.subset, '_', 2) = c.code""")]


def _qa_parts(spark, sf):
    x = RC.with_subset_parts(FX.qa(spark, sf), strict=True)
    return RC.with_country_name(x, FX.countries(spark))


@query("student_prompt", f"SELECT row_id, {_STUDENT_SQL} AS prompt FROM qp", ["qa", "countries"], _QA_PARTS)
def q_student_prompt(spark, sf):
    return _qa_parts(spark, sf).select("row_id", P.student_prompt("input", "lang", "country_name").alias("prompt"))


@query("teacher_prompt", """SELECT row_id, concat(chr(10), 'Answer in ', lang, ' as spoken in ', country, chr(10),
  'Question:', chr(10), input, chr(10), chr(10), 'Reference answer (use it to ground your response):', chr(10), output)
  AS prompt FROM qp""", ["qa", "countries"], _QA_PARTS)
def q_teacher_prompt(spark, sf):
    return _qa_parts(spark, sf).select(
        "row_id", P.teacher_prompt("input", "lang", "country_name", "output").alias("prompt"))


@query("sft_train", f"""SELECT row_id, subset, 0 AS msg_pos, 'system' AS role, {_SYS} AS content FROM qp
UNION ALL SELECT row_id, subset, 1, 'user', {_STUDENT_SQL} FROM qp
UNION ALL SELECT row_id, subset, 2, 'assistant', concat({_MARK}, ' ', output) FROM qp""",
       ["qa", "countries"], _QA_PARTS)
def q_sft_train(spark, sf):
    return _messages_long(RC.build_sft(FX.qa(spark, sf), "train", FX.countries(spark), keep=("row_id", "subset")),
                          "messages", ["row_id", "subset"])


@query("sft_test", f"""SELECT row_id, subset, 0 AS msg_pos, 'system' AS role, {_SYS} AS content FROM qp
UNION ALL SELECT row_id, subset, 1, 'user', {_STUDENT_SQL} FROM qp
UNION ALL SELECT row_id, subset, 2, 'assistant', {_MARK} FROM qp""", ["qa", "countries"], _QA_PARTS)
def q_sft_test(spark, sf):
    return _messages_long(RC.build_sft(FX.qa(spark, sf), "test", FX.countries(spark), keep=("row_id", "subset")),
                          "messages", ["row_id", "subset"])


@query("sft_pairs", f"""SELECT row_id, output AS answer, 0 AS msg_pos, 'system' AS role, {_SYS} AS content FROM qp
UNION ALL SELECT row_id, output, 1, 'user', {_STUDENT_SQL} FROM qp
UNION ALL SELECT row_id, output, 2, 'assistant', concat({_MARK}, ' ', output) FROM qp""", ["qa", "countries"], _QA_PARTS)
def q_sft_pairs(spark, sf):
    p = RC.sft_pairs(FX.qa(spark, sf), "val", FX.countries(spark))
    return _messages_long(p, "messages", ["row_id", "answer"])


@query("preference_pairs")
def q_preference_pairs(spark, sf):
    rec = _eval_records(spark, sf)
    pref = RC.build_preferences(rec, keep=("ID",))
    return pref.select("ID", F.size("prompt").alias("n_prompt"), F.col("prompt")[1]["content"].alias("prompt_user"),
                       F.col("chosen")[0]["content"].alias("chosen"), F.col("rejected")[0]["content"].alias("rejected"))


ORACLE["preference_pairs"] = _with_ans(f"""SELECT ID, CAST(2 AS INTEGER) AS n_prompt,
  CASE WHEN expected_lang <> '' OR expected_country <> '' THEN concat(chr(10), 'Answer in ', expected_lang, chr(10),
    'Question:', chr(10), input) ELSE input END AS prompt_user,
  concat({_MARK}, ' ', gold_answer) AS chosen, concat({_MARK}, ' ', gen_answer) AS rejected FROM rec""")


def _turn_sql(role: str, content: str) -> str:
    tokens = {"system": K.SYSTEM_TOKEN, "user": K.USER_TOKEN, "assistant": K.CHATBOT_TOKEN}
    tok = f"CASE {role} " + " ".join(f"WHEN '{r}' THEN {D.sq(t)}" for r, t in tokens.items()) + " END"
    body = f"CASE WHEN {role} = 'assistant' THEN concat({D.sq(K.RESPONSE_START)}, {content}, {D.sq(K.RESPONSE_END)}) " \
           f"ELSE {content} END"
    return f"concat({D.sq(K.START_TURN)}, {tok}, {body}, {D.sq(K.END_TURN)})"


_HEAD = D.sq(K.BOS_TOKEN + K.START_TURN + K.SYSTEM_TOKEN + K.SYSTEM_PROMPT + K.END_TURN)
_OPEN = D.sq(K.START_TURN + K.CHATBOT_TOKEN + K.RESPONSE_START)
_RENDER_SQL = (f"concat({_HEAD}, array_to_string(list_transform(list_filter(messages, lambda m: m.role <> 'system'), "
               f"lambda m: {_turn_sql('m.role', 'm.content')}), ''), "
               f"CASE WHEN messages[-1].role = 'user' THEN {_OPEN} ELSE '' END)")


@query("render_chat", f"SELECT conv_id, {_RENDER_SQL} AS rendered FROM chat", ["chat"])
def q_render_chat(spark, sf):
    return FX.chat(spark, sf).select("conv_id", P.render_chat("messages", generation=True).alias("rendered"))


@query("drop_assistant", """SELECT conv_id, CAST(unnest(generate_series(0, len(m) - 1)) AS INTEGER) AS msg_pos,
  unnest(list_transform(m, lambda x: x.role)) AS role, unnest(list_transform(m, lambda x: x.content)) AS content
FROM (SELECT conv_id, list_filter(messages, lambda m: m.role <> 'assistant') AS m FROM chat) t WHERE len(m) > 0""", ["chat"])
def q_drop_assistant(spark, sf):
    left = FX.chat(spark, sf).select("conv_id", P.drop_role("messages", "assistant").alias("m"))
    return _messages_long(left, "m", ["conv_id"])


_OWN_TEMPLATE = P.ChatTemplate(system_prompt="Be brief.", bos="<s>", start_turn="<turn>", end_turn="</turn>", system_token="[S]",
                               user_token="[U]", chatbot_token="[A]", response_start="(", response_end=")")


@query("render_template", """SELECT conv_id, '<s><turn>[S]Be brief.</turn>' || array_to_string(list_transform(
  list_filter(messages, lambda m: m.role <> 'system'), lambda m: '<turn>' ||
  CASE m.role WHEN 'user' THEN '[U]' || m.content ELSE '[A](' || m.content || ')' END || '</turn>'), '') AS rendered FROM chat""", ["chat"])
def q_render_template(spark, sf):
    """The chat in another template: every marker is a setting."""
    return FX.chat(spark, sf).select("conv_id", P.render_chat("messages", _OWN_TEMPLATE).alias("rendered"))


_Q_RENDER = f"{_HEAD}, {D.sq(K.START_TURN + K.USER_TOKEN)}, {_STUDENT_SQL}, {D.sq(K.END_TURN)}"


@query("cut_after_marker", f"""SELECT row_id, substr(r, 1, strpos(r, {_MARK}) + {len(K.ANSWER_MARKER) - 1}) AS prompt
FROM (SELECT row_id, concat({_Q_RENDER}, {D.sq(K.START_TURN + K.CHATBOT_TOKEN + K.RESPONSE_START)}, {_MARK},
  {D.sq(K.RESPONSE_END + K.END_TURN)}) AS r FROM qp) t""", ["qa", "countries"], _QA_PARTS)
def q_cut_after_marker(spark, sf):
    x = _qa_parts(spark, sf).select("row_id", P.question_messages("input", "lang", "country_name").alias("m"))
    return x.select("row_id", P.cut_after_marker(P.render_chat("m")).alias("prompt"))


@query("append_marker", f"""SELECT row_id, concat({_Q_RENDER}, {_OPEN}, {_MARK}) AS prompt FROM qp""",
       ["qa", "countries"], _QA_PARTS)
def q_append_marker(spark, sf):
    x = _qa_parts(spark, sf).select("row_id", P.question_messages("input", "lang", "country_name", None).alias("m"))
    return x.select("row_id", P.append_marker(P.render_chat("m", generation=True)).alias("prompt"))


# ------------------------------------------------------------------- 2.9 tokens ----


_WORD = D.regex(WORD_PATTERN)
_CHAT_TOK = D.regex(VC.CHAT_TOKEN_PATTERN)


def _ids_str(c) -> F.Column:
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",")


def _vocab_sql(src: str, col: str) -> list:
    """CTEs ``v_all`` (token, cnt, id) over the token lists ``col`` of ``src``."""
    return [("v_cnt", f"SELECT token, count(*) AS cnt FROM (SELECT unnest({col}) AS token FROM {src}) t GROUP BY token"),
            ("v_all", "SELECT token, cnt, row_number() OVER (ORDER BY cnt DESC, token) - 1 AS id FROM v_cnt")]


def _enc_sql(name: str, src: str, key: str, col: str) -> tuple:
    """CTE ``name`` (key, ids) encoding the token list ``col`` of ``src`` with ``v_all``."""
    return (name, f"""SELECT x.{key}, list(v.id ORDER BY x.pos) AS ids FROM
      (SELECT {key}, unnest(generate_series(0, len({col}) - 1)) AS pos, unnest({col}) AS token FROM {src}) x
      JOIN v_all v ON x.token = v.token GROUP BY x.{key}""")


_DOC_TOKS = [("dt", f"SELECT row_id, regexp_extract_all(text, {_WORD}) AS toks FROM docs")]


def _doc_tokens(spark, sf):
    """Documents hash-partitioned by key, then tokenised in parallel; the doc-keyed
    operators downstream reuse this partitioning instead of shuffling again."""
    return FX.docs_by_key(spark, sf).select("row_id", TX.words("text").alias("tokens"))


def _doc_words(spark, sf):
    """Documents' tokens as they are scanned: counting and encoding need no order of texts."""
    return FX.spread(FX.docs(spark, sf)).select("row_id", VC.split_words("text").alias("tokens"))


@query("build_vocab", "SELECT token, cnt, id FROM v_all", ["docs"], _DOC_TOKS + _vocab_sql("dt", "toks"))
def q_build_vocab(spark, sf):
    return VC.build_vocab(_doc_words(spark, sf))


@query("encode_tokens", "SELECT row_id, CAST(len(ids) AS INTEGER) AS n_ids, array_to_string(ids, ',') AS ids FROM enc",
       ["docs"], _DOC_TOKS + _vocab_sql("dt", "toks") + [_enc_sql("enc", "dt", "row_id", "toks")])
def q_encode_tokens(spark, sf):
    t = _doc_words(spark, sf)
    e = VC.encode_tokens(t, VC.build_vocab(t))
    return e.select("row_id", F.size("ids").alias("n_ids"), _ids_str(F.col("ids")).alias("ids"))


@query("decode_tokens", "SELECT row_id, array_to_string(toks, ' ') AS text FROM dt", ["docs"], _DOC_TOKS)
def q_decode_tokens(spark, sf):
    t = _doc_words(spark, sf)
    v = VC.build_vocab(t)
    return VC.decode_tokens(VC.encode_tokens(t, v), v)


_MERGES = 8


@query("subword_merges", " UNION ALL ".join(f"SELECT CAST({k} AS INTEGER) AS rank, pair, n FROM m{k}" for k in range(_MERGES)), ["docs"],
       _DOC_TOKS + [("wc", "SELECT w, count(*) AS cnt FROM (SELECT unnest(toks) AS w FROM dt) t GROUP BY w")] + D.subword_merges("wc", _MERGES))
def q_subword_merges(spark, sf):
    """The first merges learned from all words of the documents."""
    from ..operators.subwords import learn_merges
    counts = VC.count_tokens(_doc_words(spark, sf))
    rows = [(k, pair, n) for k, (pair, n) in enumerate(learn_merges(counts, _MERGES))]
    return spark.createDataFrame(rows, "rank int, pair string, n long")


@query("subword_round_trip", "SELECT row_id, md5(text) AS text_md5 FROM docs", ["docs"])
def q_subword_round_trip(spark, sf):
    """Documents encoded with merges learned from them, and decoded."""
    from ..operators.subwords import decode_subwords, encode_subwords, learn_merges
    counts = VC.count_tokens(_doc_words(spark, sf))
    merges = learn_merges(counts, 24)
    ids = encode_subwords(FX.spread(FX.docs(spark, sf)).select("row_id", "text"), merges).select("row_id", "ids")
    return decode_subwords(ids, merges).select("row_id", F.md5(F.encode("text", "UTF-8")).alias("text_md5"))


@query("argmax_label", "SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS INTEGER) AS argmax "
       "FROM embeddings")
def q_argmax_label(spark, sf):
    e = FX.table(spark, sf, "embeddings")
    return e.select("vec_id", A.argmax_label("embedding").alias("argmax"))


_QA_TOKS = [("qt", f"""SELECT row_id, regexp_extract_all(input, {_WORD}) AS p,
    regexp_extract_all(output, {_WORD}) AS a, list_concat(regexp_extract_all(input, {_WORD}),
    regexp_extract_all(output, {_WORD})) AS pa FROM qa""")]


def _qa_encoded(spark, sf, col: str):
    """qa with the word-token ids of the question (p), the answer (a) or both (pa), and the
    number of question tokens; ids come from the vocabulary of both."""
    q = FX.qa(spark, sf).select("row_id", TX.words("input").alias("p"), TX.words("output").alias("a"))
    q = measured(q.select("row_id", "p", "a", F.concat("p", "a").alias("pa"), F.size("p").alias("n_p")), "qa-words")
    return VC.encode_tokens(q, VC.build_vocab(q, "pa"), col, carry=("n_p",))


@query("strip_prompt_ids", "SELECT row_id, array_to_string(ids, ',') AS ids FROM ea", ["qa"],
       _QA_TOKS + _vocab_sql("qt", "pa") + [_enc_sql("ea", "qt", "row_id", "a")])
def q_strip_prompt_ids(spark, sf):
    e = _qa_encoded(spark, sf, "pa")
    return e.select("row_id", _ids_str(A.strip_prompt_ids("ids", F.col("n_p"))).alias("ids"))


@query("truncate_at_stop", """SELECT row_id, array_to_string(CASE WHEN k IS NULL THEN ids ELSE list_slice(ids, 1, k - 1) END,
  ',') AS ids FROM (SELECT row_id, ids, list_filter(list_transform(generate_series(1, len(ids)),
    lambda i: CASE WHEN ids[i] IN (0, 1) THEN i END), lambda x: x IS NOT NULL)[1] AS k FROM ea) t""", ["qa"],
       _QA_TOKS + _vocab_sql("qt", "pa") + [_enc_sql("ea", "qt", "row_id", "a")])
def q_truncate_at_stop(spark, sf):
    e = _qa_encoded(spark, sf, "a")
    return e.select("row_id", _ids_str(A.truncate_at_stop("ids", [0, 1, None])).alias("ids"))


def _pad_sql(side: str, pad_id: int = 0) -> str:
    fill = "list_transform(generate_series(1, L - len(cut)), lambda i: {v})"

    def pad(arr, v):
        f = fill.format(v=v)
        return f"list_concat({f}, {arr})" if side == "left" else f"list_concat({arr}, {f})"
    ones = "list_transform(cut, lambda x: 1)"
    return f"""SELECT row_id, batch, array_to_string({pad('cut', pad_id)}, ',') AS input_ids,
  array_to_string({pad('cut', -100)}, ',') AS labels, array_to_string({pad(ones, 0)}, ',') AS attention_mask
FROM (SELECT row_id, batch, L, list_slice(ids, 1, L) AS cut FROM
  (SELECT row_id, ids, batch, least(max(len(ids)) OVER (PARTITION BY batch), {K.DEFAULT_MAX_SEQ_LEN}) AS L FROM
    (SELECT row_id, ids, (row_number() OVER (ORDER BY row_id) - 1) // 8 AS batch FROM ep) b) m) c"""


_PAD_CTES = _QA_TOKS + _vocab_sql("qt", "pa") + [_enc_sql("ep", "qt", "row_id", "p")]


def _padded(spark, sf, side, pad_id=0):
    b = BT.micro_batches(measured(_qa_encoded(spark, sf, "p"), "questions"), 8)
    p = BT.pad_batches(b, "ids", batch="batch", pad_id=pad_id, eos_id=7, side=side)
    return p.select("row_id", "batch", _ids_str(F.col("input_ids")).alias("input_ids"),
                    _ids_str(F.col("labels_padded")).alias("labels"),
                    _ids_str(F.col("attention_mask")).alias("attention_mask"))


@query("pad_left", _pad_sql("left"), ["qa"], _PAD_CTES)
def q_pad_left(spark, sf):
    return _padded(spark, sf, "left")


@query("pad_right", _pad_sql("right"), ["qa"], _PAD_CTES)
def q_pad_right(spark, sf):
    return _padded(spark, sf, "right")


@query("pad_eos", _pad_sql("right", 7), ["qa"], _PAD_CTES)
def q_pad_eos(spark, sf):
    """No pad id: the end-of-text id pads."""
    return _padded(spark, sf, "right", pad_id=None)


@query("batch_max_len", """SELECT batch, max_len, CAST(max(max_len) OVER (ORDER BY batch
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS INTEGER) AS running_max_len FROM
  (SELECT batch, CAST(least(max(len(ids)), 2048) AS INTEGER) AS max_len FROM
    (SELECT ids, (row_number() OVER (ORDER BY row_id) - 1) // 8 AS batch FROM ep) b GROUP BY batch) t""",
       ["qa"], _PAD_CTES)
def q_batch_max_len(spark, sf):
    e = measured(_qa_encoded(spark, sf, "p"), "questions")
    return BT.batch_max_len(BT.micro_batches(e, 8), "ids", "batch")


def _render_sql(msgs: str) -> str:
    return (f"concat({_HEAD}, array_to_string(list_transform(list_filter({msgs}, lambda m: m.role <> 'system'), "
            f"lambda m: {_turn_sql('m.role', 'm.content')}), ''))")


@query("label_mask", """SELECT conv_id, CAST(len(ids) AS INTEGER) AS n_ids, CAST(r AS INTEGER) AS label_start,
  array_to_string(list_concat(list_transform(generate_series(1, r), lambda i: -100), list_slice(ids, r + 1, len(ids))),
    ',') AS labels
FROM (SELECT l.conv_id, e.ids, l.plen + list_position(list_slice(l.toks, l.plen + 1, len(l.toks)),
        '<|START_RESPONSE|>') AS r FROM lt l JOIN el e ON l.conv_id = e.conv_id) t""", ["chat"], [
    ("la", """SELECT conv_id, messages, list_position(list_transform(list_reverse(messages), lambda m: m.role = 'assistant'), true) AS back
       FROM chat"""),
    ("lm", "SELECT conv_id, list_slice(messages, 1, len(messages) - back + 1) AS msgs FROM la WHERE back > 0"),
    ("lt", f"""SELECT conv_id, regexp_extract_all({_render_sql('msgs')}, {_CHAT_TOK}) AS toks,
       len(regexp_extract_all({_render_sql('list_slice(msgs, 1, len(msgs) - 1)')}, {_CHAT_TOK})) AS plen FROM lm""")]
       + _vocab_sql("lt", "toks") + [_enc_sql("el", "lt", "conv_id", "toks")])
def q_label_mask(spark, sf):
    """Every conversation with an answer, cut behind its last one."""
    c = FX.chat(spark, sf)
    last = F.array_max(F.transform("messages", lambda m, i: F.when(m["role"] == "assistant", i + 1)))
    c = c.withColumn("n", last).where("n is not null").select("conv_id", F.slice("messages", F.lit(1), F.col("n")).alias("m"))
    c = c.select("conv_id", VC.chat_tokens(P.render_chat("m")).alias("toks"),
                 F.size(VC.chat_tokens(P.render_chat(F.slice("m", 1, F.size("m") - 1)))).alias("plen"))
    c = measured(c.select("conv_id", "toks", A.response_start("toks", F.col("plen"), [K.RESPONSE_START]).alias("start")), "chats")
    e = VC.encode_tokens(c, VC.build_vocab(c, "toks"), "toks", key="conv_id", carry=("start",))
    x = e.select("conv_id", "ids", A.mask_before("ids", F.col("start")).alias("labels"))
    return x.select("conv_id", F.size("ids").alias("n_ids"),
                    F.size(F.filter("labels", lambda v_: v_ == K.IGNORE_INDEX)).alias("label_start"),
                    _ids_str(F.col("labels")).alias("labels"))


# --------------------------------------------------------------- 2.6 repetition ----


@query("first_repeated_ngram", """SELECT row_id, CAST(first_start AS INTEGER) AS first_start, CAST(n AS INTEGER) AS n FROM (
  SELECT row_id, n, pos, p1 AS first_start, row_number() OVER (PARTITION BY row_id ORDER BY n DESC, pos) AS k
  FROM (SELECT row_id, n, pos, row_number() OVER (PARTITION BY row_id, n, gram ORDER BY pos) AS rn,
          min(pos) OVER (PARTITION BY row_id, n, gram) AS p1 FROM g) t WHERE rn = 2) u WHERE k = 1""", ["docs"],
       _DOC_TOKS + [("gs", """SELECT row_id, toks, n, unnest(generate_series(0, len(toks) - n)) AS pos
                               FROM dt, range(3, 9) r(n) WHERE len(toks) >= n"""),
                    ("g", "SELECT row_id, n, pos, list_slice(toks, pos + 1, pos + n) AS gram FROM gs")])
def q_first_repeated_ngram(spark, sf):
    return RP.first_repeated_ngram(_doc_tokens(spark, sf))


def _trim_sql(src: str, m: int) -> list:
    return [
        ("tg", f"""SELECT row_id, pos, list_slice(toks, pos + 1, pos + {m}) AS gram FROM
                  (SELECT row_id, toks, unnest(generate_series(0, len(toks) - {m})) AS pos FROM {src}
                   WHERE len(toks) >= {m}) t"""),
        ("tf", "SELECT row_id, gram, min(pos) AS p FROM tg GROUP BY row_id, gram"),
        ("tb", f"""SELECT row_id, j, len(toks) - (j + 1) * {m} AS s,
                  list_slice(toks, len(toks) - (j + 1) * {m} + 1, len(toks) - j * {m}) AS gram FROM
                  (SELECT row_id, toks, unnest(generate_series(0, len(toks) // {m} - 1)) AS j FROM {src}
                   WHERE len(toks) >= {m}) t"""),
        ("tj", f"""SELECT b.row_id, coalesce(min(b.j) FILTER (WHERE NOT (f.p + {m} <= b.s)), count(*)) AS jj
                  FROM tb b JOIN tf f ON b.row_id = f.row_id AND b.gram = f.gram GROUP BY b.row_id"""),
        ("tk", f"""SELECT d.row_id, CAST(len(d.toks) AS INTEGER) AS n_tokens,
                  CAST(len(d.toks) - coalesce(tj.jj, 0) * {m} AS INTEGER) AS n_kept
                  FROM {src} d LEFT JOIN tj ON d.row_id = tj.row_id"""),
    ]


@query("trim_repetition", "SELECT row_id, n_tokens, n_kept FROM tk", ["docs"], _DOC_TOKS + _trim_sql("dt", 3))
def q_trim_repetition(spark, sf):
    return RP.trailing_keep_length(_doc_tokens(spark, sf), min_n=3, max_n=8)


_LOSSLESS = D.regex(LOSSLESS_TOKEN_PATTERN)


@query("clean_repetition", f"""SELECT row_id, {D.py_strip("array_to_string(list_slice(toks, 1, n_kept), '')")} AS cleaned
FROM lt2 JOIN tk USING (row_id)""", ["docs"],
       [("lt2", f"SELECT row_id, regexp_extract_all(text, {_LOSSLESS}) AS toks FROM docs")] + _trim_sql("lt2", 3))
def q_clean_repetition(spark, sf):
    return RP.clean_repetition(FX.docs_by_key(spark, sf).select("row_id", "text")).select("row_id", "cleaned")


# ------------------------------------------------------------------ 2.5 scoring ----


def _scoring_input(spark, sf):
    return SC.scoring_tokens(_answers(spark, sf), "output", "gen_answer").select("row_id", "_gen_t", "_gold_t")


_ROUGE = _ANS + DR.rouge_ctes("ans", "row_id", "gen_answer", "output")


@query("rouge_tokens")
def q_rouge_tokens(spark, sf):
    return _answers(spark, sf).select("row_id", F.array_join(RG.rouge_tokens("gen_answer"), " ").alias("tokens"))


ORACLE["rouge_tokens"] = FX.with_views(
    "SELECT row_id, array_to_string(regexp_extract_all(lower(gen_answer), '[a-z0-9]+'), ' ') AS tokens FROM ans",
    "gen", extra=_ANS)


@query("rouge1_counts")
def q_rouge1_counts(spark, sf):
    return SC.rouge1_counts(_scoring_input(spark, sf), "_gen_t", "_gold_t")


ORACLE["rouge1_counts"] = FX.with_views("""SELECT t.row_id, CAST(coalesce(o.overlap, 0) AS INTEGER) AS overlap,
  CAST(len(t.g) AS INTEGER) AS n_gen, CAST(len(t.r) AS INTEGER) AS n_gold
FROM rt t LEFT JOIN (SELECT row_id, sum(least(cg, cr)) AS overlap FROM (
    SELECT coalesce(a.row_id, b.row_id) AS row_id, coalesce(a.c, 0) AS cg, coalesce(b.c, 0) AS cr
    FROM (SELECT row_id, tok, count(*) AS c FROM (SELECT row_id, unnest(g) AS tok FROM rt) x GROUP BY ALL) a
    FULL JOIN (SELECT row_id, tok, count(*) AS c FROM (SELECT row_id, unnest(r) AS tok FROM rt) y GROUP BY ALL) b
      ON a.row_id = b.row_id AND a.tok = b.tok) z GROUP BY row_id) o ON t.row_id = o.row_id""", "gen", extra=_ANS + [
    ("rt", """SELECT row_id, regexp_extract_all(lower(gen_answer), '[a-z0-9]+') AS g,
              regexp_extract_all(lower(output), '[a-z0-9]+') AS r FROM ans""")])


@query("stem_vocab", "SELECT word, stem FROM stems", ["gen"], _ROUGE)
def q_stem_vocab(spark, sf):
    return SC.stem_vocab(_scoring_input(spark, sf).select(F.concat("_gen_t", "_gold_t").alias("t")), "t")


@query("stem_documents", "SELECT word, stem FROM stems", ["docs"], [
    ("dw", "SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS word FROM docs")] + DR.stem_ctes("dw"))
def q_stem_documents(spark, sf):
    """Stems of the documents' whole vocabulary."""
    return SC.stem_vocab(FX.docs(spark, sf).select(RG.rouge_tokens("text").alias("t")), "t")


@query("rouge1", "SELECT row_id, rouge1_f1 FROM rouge", ["gen"], _ROUGE)
def q_rouge1(spark, sf):
    return SC.rouge1_score(_answers(spark, sf).select("row_id", "output", "gen_answer"), "output").select("row_id", "rouge1_f1")


@query("rougeL_counts", "SELECT row_id, lcs, CAST(n_gen AS INTEGER) AS n_gen, CAST(n_gold AS INTEGER) AS n_gold FROM rouge", ["gen"], _ROUGE)
def q_rougeL_counts(spark, sf):
    return SC.rougeL_counts(_scoring_input(spark, sf), "_gen_t", "_gold_t")


@query("rouge_score", "SELECT row_id, rouge1_f1, rougeL_f1, score FROM rouge", ["gen"], _ROUGE)
def q_rouge_score(spark, sf):
    s = SC.rouge_score(_answers(spark, sf).select("row_id", "output", "gen_answer"), "output")
    return s.select("row_id", "rouge1_f1", "rougeL_f1", "score")


_SCORED = _ROUGE + [("rec", _REC_SQL.replace("FROM ans", "FROM ans").replace("SELECT ID,", "SELECT row_id, ID,")),
                    ("scored", "SELECT rec.* EXCLUDE (row_id), rouge1_f1, rougeL_f1, score FROM rec JOIN rouge USING (row_id)")]


@query("score_answers", "SELECT * FROM scored", ["gen"], _SCORED)
def q_score_answers(spark, sf):
    return SC.score_answers(_answers(spark, sf))


# ------------------------------------------- 2.11 runs over an answer table, streaming ----


def _answer_table(spark, sf):
    return FX.gen(spark, sf).select("row_id", F.col("raw_answer").alias("answer"))


@query("submission_run", f"""SELECT ef.ID, c.cleaned AS TargetRLF1, c.cleaned AS TargetR1F1, c.cleaned AS TargetLLM
FROM ef JOIN (SELECT lt3.row_id, {D.py_strip("array_to_string(list_slice(toks, 1, n_kept), '')")} AS cleaned
  FROM lt3 JOIN tk ON lt3.row_id = tk.row_id) c ON ef.row_id = c.row_id""", ["gen"], [
    ("ef", f"SELECT row_id, ID, {D.strip_echo('raw_answer', 'input')} AS t FROM gen"),
    ("lt3", f"SELECT row_id, regexp_extract_all(t, {_LOSSLESS}) AS toks FROM ef")] + _trim_sql("lt3", 3))
def q_submission_run(spark, sf):
    return SU.submission_run(FX.qa(spark, sf), _answer_table(spark, sf))


@query("submission_prompts", f"""SELECT row_id, concat({_Q_RENDER}, {D.sq(K.START_TURN + K.CHATBOT_TOKEN + K.RESPONSE_START)}, {_MARK},
    {D.sq(K.RESPONSE_END + K.END_TURN)}) AS prompt, CAST(m.max_new_tokens AS VARCHAR) AS max_new_tokens
FROM qp JOIN max_lens m ON m.subset = qp.subset""", ["qa", "countries", "max_lens"], _QA_PARTS)
def q_submission_prompts(spark, sf):
    x = SU.submission_prompts(FX.qa(spark, sf), FX.countries(spark), FX.max_lens(spark))
    return x.select("row_id", "prompt", F.col("params")["max_new_tokens"].alias("max_new_tokens"))


@query("eval_prompts", f"""SELECT row_id, 'aya' AS family, concat({_Q_RENDER}, {_OPEN}) AS prompt FROM qp
UNION ALL SELECT row_id, 'qwen', concat({_Q_RENDER}, {D.sq(K.START_TURN + K.CHATBOT_TOKEN + K.RESPONSE_START)}, {_MARK}) FROM qp""",
       ["qa", "countries"], _QA_PARTS)
def q_eval_prompts(spark, sf):
    """The evaluation prompt of both model families."""
    q, c = FX.qa(spark, sf), FX.countries(spark)
    both = [EV.eval_prompts(q, c, f).select("row_id", F.lit(f).alias("family"), "prompt") for f in ("aya", "qwen")]
    return both[0].unionByName(both[1])


@query("eval_run", "SELECT * FROM scored", ["gen"], _SCORED)
def q_eval_run(spark, sf):
    return EV.eval_run(FX.qa(spark, sf), _answer_table(spark, sf))[0]


@query("eval_run_test")
def q_eval_run_test(spark, sf):
    return EV.eval_run_test(FX.qa(spark, sf).drop("output"), _answer_table(spark, sf))


ORACLE["eval_run_test"] = ORACLE["submission"]


def _metrics_sql(source: str, names: dict[str, str]) -> str:
    """Long generation metrics of ``source`` (lang and the columns of ``names``)."""
    parts = [f"""SELECT CASE WHEN grouping(lang) = 1 THEN 'eval_gen_{m}' ELSE 'eval_gen_{m}_' || lang END AS metric,
  CASE WHEN grouping(lang) = 1 THEN NULL ELSE lang END AS lang, count({c}) AS n,
  {DR.round4(f"{DR.exact_sum(c)} / CAST(count({c}) AS DOUBLE)")} AS value FROM {source} GROUP BY ROLLUP (lang)""" for m, c in names.items()]
    parts.append(f"SELECT 'eval_gen_n_samples', NULL, count(*), CAST(count(*) AS DOUBLE) FROM {source}")
    return " UNION ALL ".join(parts)


_VAL = [("picked", "SELECT * FROM gen ORDER BY md5(concat_ws('|', 11, row_id)), row_id LIMIT 64"),
        ("vt", f"""SELECT row_id, subset, {D.py_strip('raw_answer')} AS a, {D.py_strip('output')} AS b FROM picked""")]


@query("validation_run", _metrics_sql("vs", {"exact_match": "exact_match", "rouge1": "rouge1_f1", "rougeL": "rougeL_f1", "score": "score"}),
       ["gen"], _VAL + DR.rouge_ctes("vt", "row_id", "a", "b") + [
    ("vs", f"SELECT {D.lang_of('subset')} AS lang, CAST(lower(a) = lower(b) AS INTEGER) AS exact_match, rouge.* FROM vt JOIN rouge USING (row_id)")])
def q_validation_run(spark, sf):
    """A training step's validation: uniform sample by step, answers stripped and scored."""
    return EV.validation_run(FX.qa(spark, sf), _answer_table(spark, sf), step=11, n=64)


@query("validation_prompts", f"""SELECT row_id, concat({_Q_RENDER}, {_OPEN}, {_MARK}) AS prompt
FROM (SELECT * FROM qp ORDER BY md5(concat_ws('|', 11, row_id)), row_id LIMIT 64) t""", ["qa", "countries"], _QA_PARTS)
def q_validation_prompts(spark, sf):
    return EV.validation_prompts(FX.qa(spark, sf), FX.countries(spark), step=11, n=64).select("row_id", "prompt")


def _csv_in_order(spark, sf, name, columns):
    """The QA rows as CSV files whose order of paths and lines is the order of row_id."""
    from ..session import scratch_path
    from ..sources.sinks import write_csv
    rows = FX.qa(spark, sf).repartitionByRange(3, "row_id").sortWithinPartitions("row_id")
    path = scratch_path(spark, name)
    write_csv(rows.select(*columns), path)
    return path


@query("file_row_index", """SELECT row_number() OVER (ORDER BY row_id) - 1 AS row_id, CAST(ID AS VARCHAR) AS ID, subset, input FROM qa""", ["qa"])
def q_file_row_index(spark, sf):
    """Rows of CSV files numbered in file order, end to end from the written files."""
    path = _csv_in_order(spark, sf, "ordered", [F.col("ID").cast("string").alias("ID"), "subset", "input", "output"])
    return read_qa_indexed(spark, path).select("row_id", "ID", "subset", "input")


@query("file_row_index_split", """SELECT row_number() OVER (ORDER BY row_id) - 1 AS row_id, CAST(ID AS VARCHAR) AS ID, subset, input FROM qa""", ["qa"])
def q_file_row_index_split(spark, sf):
    """The same numbers where each file is read by many tasks."""
    path = _csv_in_order(spark, sf, "ordered-split", [F.col("ID").cast("string").alias("ID"), "subset", "input", "output"])
    return read_qa_indexed(spark, path, split=True).select("row_id", "ID", "subset", "input")


@query("file_default_id", """SELECT row_number() OVER (ORDER BY row_id) - 1 AS ID, input FROM qa""", ["qa"])
def q_file_default_id(spark, sf):
    """Files without an ID column: the row's number stands in."""
    path = _csv_in_order(spark, sf, "unnamed", ["subset", "input", "output"])
    schema = type(QA_SCHEMA)([f for f in QA_SCHEMA.fields if f.name != "ID"])
    return read_qa_indexed(spark, path, schema=schema).select("ID", "input")


@query("incremental_sink")
def q_incremental_sink(spark, sf):
    """Results made durable batch by batch, projected to the submission columns; a batch that
    comes twice is taken once, and the small folders are compacted in between."""
    from ..session import scratch_path
    from ..sources import results as RS
    from ..sources.sinks import write_incremental
    out, path = RC.to_submission(_answers(spark, sf)), scratch_path(spark, "incremental")
    for k in (0, 1, 0, 2, 1):
        write_incremental(out.where(F.pmod("ID", F.lit(3)) == k), path, f"batch-{k}", columns=["ID", *K.SUBMISSION_TARGETS])
        if k == 1:
            RS.compact(spark, path)
    return RS.read_results(spark, path)


ORACLE["incremental_sink"] = ORACLE["submission"]


@query("resumed_answers", "SELECT row_id, coalesce(raw_answer, '') AS answer FROM gen", ["gen"])
def q_resumed_answers(spark, sf):
    """An answer table that an earlier run left half filled is completed: recorded answers are
    played back for the rows that have none."""
    from ..operators import inference as INF
    from ..session import scratch_path
    rows, path = measured(FX.gen(spark, sf).select("row_id", "raw_answer"), "recorded"), scratch_path(spark, "answer-table")
    INF.infer_durable(rows.where(F.pmod("row_id", F.lit(5)) < 2), "row_id", INF.recorded("raw_answer"), path)
    INF.infer_durable(rows, "row_id", INF.recorded("raw_answer"), path)
    return INF.answers(spark, path).select("row_id", "answer")


@query("training_set")
def q_training_set(spark, sf):
    """The SFT table handed over as Parquet, nested messages kept."""
    from ..session import scratch_path
    from ..sources.sinks import write_training_set
    sft = RC.build_sft(FX.qa(spark, sf), "train", FX.countries(spark), keep=("row_id", "subset"))
    return _messages_long(spark.read.parquet(write_training_set(sft, scratch_path(spark, "sft"))), "messages", ["row_id", "subset"])


ORACLE["training_set"] = ORACLE["sft_train"]


@query("format_metrics")
def q_format_metrics(spark, sf):
    """Display form of the summary: counts without, means with four decimals."""
    s = MT.eval_summary(_eval_records(spark, sf), require_rouge=False).select("expected_lang", "n", "exact_match")
    return MT.format_metrics(s)


ORACLE["format_metrics"] = _with_ans("""SELECT expected_lang, CAST(count(*) AS VARCHAR) AS n,
  printf('%.4f', CAST(sum(exact_match) AS DOUBLE) / CAST(count(*) AS DOUBLE)) AS exact_match FROM rec GROUP BY ROLLUP (expected_lang)""")


@query("debug_sample", f"""SELECT row_id, concat({_Q_RENDER}, {_OPEN}, {_MARK}) AS prompt, raw_answer
FROM qp JOIN (SELECT row_id AS rid, raw_answer FROM gen) g ON qp.row_id = g.rid ORDER BY row_id LIMIT 5""",
       ["gen", "countries"], _QA_PARTS)
def q_debug_sample(spark, sf):
    x = _qa_parts(spark, sf).select("row_id", P.question_messages("input", "lang", "country_name", None).alias("m"))
    x = x.select("row_id", P.append_marker(P.render_chat("m", generation=True)).alias("prompt"))
    g = FX.gen(spark, sf).select("row_id", "raw_answer")
    return SM.debug_sample(x.join(g, "row_id"), 5)


@query("merge_parts", """SELECT CAST(shard AS INTEGER) AS part, count(*) AS rows FROM (SELECT (row_number() OVER (ORDER BY row_id)
  - 1) % 3 AS shard FROM qa) t GROUP BY ROLLUP (shard)""", ["qa"])
def q_merge_parts(spark, sf):
    """Write three round-robin shards as CSV part folders, merge them in one read."""
    from ..session import scratch_path
    from ..sources.qa import merge_parts, part_report
    from ..sources.sinks import write_csv
    base = scratch_path(spark, "parts")
    s = RC.shard(with_row_id(FX.qa(spark, sf).select("row_id", "subset", "input"), ["row_id"]), 3)
    for i in range(3):
        write_csv(s.where(F.col("shard") == i).drop("shard"), f"{base}/shard={i}")
    merged = merge_parts(spark, [f"{base}/shard={i}" for i in range(3)])
    part = F.regexp_extract("part_file", r"shard=(\d+)", 1).cast("int")
    return part_report(merged, part)


@query("write_report", """SELECT 'shard_' || shard AS name, count(*) AS rows FROM (SELECT (row_number() OVER (ORDER BY row_id) - 1) % 3 AS shard
  FROM qa) t GROUP BY shard UNION ALL SELECT 'rows', count(*) FROM qa
UNION ALL SELECT 'part_' || shard, count(*) FROM (SELECT (row_number() OVER (ORDER BY row_id) - 1) % 3 AS shard FROM qa) t GROUP BY shard
UNION ALL SELECT 'merged', count(*) FROM qa""", ["qa"])
def q_write_report(spark, sf):
    """Rows per shard and per merged part, counted by the jobs that write them."""
    from ..session import scratch_path
    from ..sources.qa import merge_parts
    from ..sources.reports import write_merged, write_shards
    base, merged = scratch_path(spark, "shards"), scratch_path(spark, "merged")
    s = RC.shard(with_row_id(FX.qa(spark, sf).select("row_id", "subset", "input"), ["row_id"]), 3)
    counts = write_shards(s, 3, lambda x: x.write.partitionBy("shard").parquet(base))
    parts = [f"{base}/shard={k}" for k in range(3)]
    again = write_merged(merge_parts(spark, parts, fmt="parquet"), parts, lambda x: x.write.parquet(merged))
    rows = [*counts.items(), ("merged", again["rows"]), *((k, n) for k, n in again.items() if k != "rows")]
    return spark.createDataFrame(rows, "name string, rows long")


def _stream_inputs(spark, sf, df, name):
    from ..session import scratch_path
    d = scratch_path(spark, name)
    df.repartition(4).write.parquet(d)
    return d


@query("stream_scoring", "SELECT * FROM scored", ["gen"], _SCORED)
def q_stream_scoring(spark, sf):
    from ..session import scratch_path
    from ..streaming.scoring import scored, stream_scoring
    gen = FX.gen(spark, sf)
    src = _stream_inputs(spark, sf, gen, "stream-in")
    out, ck = scratch_path(spark, "stream-out"), scratch_path(spark, "stream-ck")
    stream_scoring(spark, src, out, ck, gen.schema)
    return scored(spark, out)


@query("stream_log_windows")
def q_stream_log_windows(spark, sf):
    from ..session import scratch_path
    from ..streaming.windows import stream_log_windows
    seqs = _tok_sequences(spark, sf).select("seq_id", "step", "subset", "correct", "total")
    src = _stream_inputs(spark, sf, seqs, "windows-in")
    sdf = spark.readStream.schema(seqs.schema).option("maxFilesPerTrigger", 1).parquet(src)
    out, ck = scratch_path(spark, "windows-out"), scratch_path(spark, "windows-ck")
    return stream_log_windows(spark, sdf, 10, out, ck)


_EVENT_SQL = [
    ("ev", """SELECT *, least(3, CAST(floor(date_diff('day', TIMESTAMP '2024-01-01', ts) / 8) AS BIGINT)
  + CASE WHEN event_id % 11 = 0 THEN 2 WHEN event_id % 7 = 0 THEN 1 ELSE 0 END) AS arrival,
  CAST(date_trunc('day', ts) AS TIMESTAMP) AS w, CASE WHEN event_type = 'error' THEN 'errors' ELSE 'use' END AS lang,
  CAST(value > 20 AS BIGINT) AS correct, CAST(1 AS BIGINT) AS total FROM events"""),
    ("marks", """SELECT a.arrival, max(e.ts) - INTERVAL 2 DAY AS mark FROM (SELECT unnest(range(0, 5)) AS arrival) a
  JOIN ev e ON e.arrival < a.arrival GROUP BY a.arrival"""),
    ("judged", """SELECT ev.*, coalesce(w + INTERVAL 1 DAY <= mark, false) AS late FROM ev LEFT JOIN marks USING (arrival)"""),
]


@query("stream_event_windows", """SELECT CASE WHEN w + INTERVAL 1 DAY <= (SELECT mark FROM marks WHERE arrival = 4) THEN 'closed' ELSE 'open' END AS kind,
  CAST(epoch(w) AS BIGINT) AS window_start, lang, CAST(sum(correct) AS BIGINT) AS correct, CAST(sum(total) AS BIGINT) AS total,
  count(*) AS rows FROM judged WHERE NOT late GROUP BY ALL
UNION ALL SELECT 'late', NULL, lang, NULL, NULL, count(*) FROM judged WHERE late GROUP BY lang""", [], _EVENT_SQL)
def q_stream_event_windows(spark, sf):
    """Events that arrive out of order in four loads, each taken in by a restarted stream:
    daily windows closed by a watermark two days behind, those still open, and what came late."""
    from ..session import scratch_path
    from ..streaming.windows import closed_windows, late_rows, open_windows, stream_event_windows
    day = F.datediff("ts", F.lit("2024-01-01"))
    delay = F.when(F.col("event_id") % 11 == 0, 2).when(F.col("event_id") % 7 == 0, 1).otherwise(0)
    # the table's times have no zone; they are taken as UTC whatever the session's zone is
    utc = F.expr("timestamp_micros(timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ)))")
    ev = FX.table(spark, sf, "events").select(
        utc.alias("ts"), F.when(F.col("event_type") == "error", "errors").otherwise("use").alias("subset"),
        (F.col("value") > 20).cast("long").alias("correct"), F.lit(1).cast("long").alias("total"),
        F.least(F.lit(3), F.floor(day / 8) + delay).alias("arrival"))
    src, out, ck = (scratch_path(spark, f"events-{n}") for n in ("in", "out", "ck"))
    for k in range(4):
        ev.where(F.col("arrival") == k).write.mode("append").parquet(src)
        stream_event_windows(spark, spark.readStream.schema(ev.schema).parquet(src), "1 day", "2 days", out, ck)
    closed, still = closed_windows(spark, out), open_windows(spark, ck)
    late = late_rows(spark.read.parquet(src), closed, still)
    shape = lambda df, kind: df.select(
        F.lit(kind).alias("kind"), F.unix_seconds("window_start").alias("window_start"), "lang", "correct", "total", "rows")
    none = F.lit(None).cast("long")
    return shape(closed, "closed").unionByName(shape(still, "open")).unionByName(
        late.select(F.lit("late").alias("kind"), none.alias("window_start"), "lang", none.alias("correct"), none.alias("total"), "rows"))


# ------------------------------------------------------ training-table composition --


@query("training_table")
def q_training_table(spark, sf):
    """QA rows -> chat ids and label masks -> language-stratified plan -> padded
    micro-batches (the collator's output, one row per example and micro-batch)."""
    ex = TRN.training_examples(FX.qa(spark, sf), FX.countries(spark))
    b = TRN.training_batches(ex, micro=8, accum=8)
    return b.select("effective_batch", "micro_batch", "micro_pos", "row_id", "lang",
                    F.size("input_ids").alias("padded_len"),
                    F.size(F.filter("labels_padded", lambda v: v != K.IGNORE_INDEX)).alias("n_labels"))


# ------------------------------------------- summaries over fully scored records --

def _scored(spark, sf):
    return SC.score_answers(_answers(spark, sf))


_MEANS = ", ".join(f"""{DR.exact_sum(m)} AS {m}_sum, count(*) - count({m}) AS {m}_null,
  {DR.exact_sum(m)} / CAST(count({m}) AS DOUBLE) AS {m}""" for m in ("rouge1_f1", "rougeL_f1", "score"))


@query("eval_summary_scored", f"""SELECT expected_lang, CAST(grouping(expected_lang) AS INTEGER) AS is_overall, count(*) AS n,
  CAST(sum(exact_match) AS BIGINT) AS exact_match_sum, count(*) - count(exact_match) AS exact_match_null,
  CAST(sum(exact_match) AS DOUBLE) / CAST(count(exact_match) AS DOUBLE) AS exact_match, {_MEANS}
FROM scored GROUP BY ROLLUP (expected_lang)""", ["gen"], _SCORED)
def q_eval_summary_scored(spark, sf):
    """A1/A2 with every metric: exact match and the stemmed ROUGE scores."""
    return MT.eval_summary(_scored(spark, sf))


@query("gen_metrics_scored", _metrics_sql("sl", {"exact_match": "exact_match", "rouge1": "rouge1_f1", "rougeL": "rougeL_f1",
                                                 "score": "score"}), ["gen"], _SCORED + [
    ("sl", f"""SELECT *, {D.lang_of("expected_lang || '_' || expected_country")} AS lang FROM scored""")])
def q_gen_metrics_scored(spark, sf):
    """A3 over exact match, ROUGE-1, ROUGE-L and the combined score."""
    s = _scored(spark, sf).select(
        F.concat_ws("_", "expected_lang", "expected_country").alias("subset"), "exact_match",
        F.col("rouge1_f1").alias("rouge1"), F.col("rougeL_f1").alias("rougeL"), "score")
    return MT.gen_metrics(s, prefix="eval")


# The stream's final state is the batch log-window table, so it shares that oracle.
ORACLE["stream_log_windows"] = ORACLE["log_window_accuracy"]


def _plan_ctes(src: str) -> list:
    """The allocation and batch-plan CTEs of ``batch_plan`` over another (row_id, lang)
    source, ending in ``plan``."""
    ctes = [(n, q.replace("FROM docs GROUP BY lang", f"FROM {src} GROUP BY lang")) for n, q in _ALLOC_SQL]
    ctes += [(n, q.replace("FROM docs d JOIN cyc c", f"FROM {src} d JOIN cyc c"))
             for n, q in _PLAN_CTES]
    ctes.append(("plan", _PLAN_SELECT))
    return ctes



_TRAIN_RENDER = (f"concat({_Q_RENDER}, {D.sq(K.START_TURN + K.CHATBOT_TOKEN + K.RESPONSE_START)}, "
                 f"{_MARK}, ' ', output, {D.sq(K.RESPONSE_END + K.END_TURN)})")
_TRAIN_PREFIX = f"concat({_Q_RENDER})"

ORACLE["training_table"] = FX.with_views("""SELECT p.effective_batch, p.micro_batch, p.micro_pos, p.row_id, p.lang,
  CAST(least(max(len(e.toks)) OVER (PARTITION BY p.micro_batch), 2048) AS INTEGER) AS padded_len,
  CAST(len(e.toks) - e.r AS INTEGER) AS n_labels
FROM plan p JOIN ex e ON p.row_id = e.row_id""", "qa", "countries", extra=_QA_PARTS + [
    ("ex0", f"""SELECT row_id, split_part(subset, '_', 1) AS lang,
                  regexp_extract_all({_TRAIN_RENDER}, {_CHAT_TOK}) AS toks,
                  len(regexp_extract_all({_TRAIN_PREFIX}, {_CHAT_TOK})) AS plen FROM qp"""),
    ("ex", f"""SELECT *, plen + list_position(list_slice(toks, plen + 1, len(toks)), {D.sq(K.RESPONSE_START)}) AS r
               FROM ex0"""),
] + _plan_ctes("ex"))
