"""Sampling quotas, language allocation and the batch plan's contract."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from babelqa.operators import batching as BT
from babelqa.operators import sampling as SM
from babelqa.operators.ranking import rank_within, with_row_id


def test_stratified_quota_and_shortfall(spark):
    rows = [(i, "zz_A" if i % 10 == 0 else ("yy_B" if i % 3 else "xx_C")) for i in range(200)]
    df = spark.createDataFrame(rows, "row_id long, subset string")
    # first appearance: zz (row 0), yy (row 1), xx (row 3); 20 zz rows only
    got = Counter(r.lang for r in SM.stratified_sample(df, 100).collect())
    assert got == {"zz": 20, "yy": 33, "xx": 33}
    assert SM.stratified_sample(df, 0).count() == 200
    assert SM.stratified_sample(df.drop("subset"), 7).count() == 7


def test_stratified_is_deterministic(spark):
    df = spark.range(500).withColumnRenamed("id", "row_id").withColumn(
        "subset", F.concat(F.lit("L"), (F.col("row_id") % 3).cast("string"), F.lit("_X")))
    a = sorted(r.row_id for r in SM.stratified_sample(df, 31).collect())
    b = sorted(r.row_id for r in SM.stratified_sample(df.repartition(7), 31).collect())
    assert a == b and len(a) == 31


def alloc(spark, counts, batch, alpha):
    df = spark.createDataFrame(list(counts.items()), "lang string, n long")
    return {r.lang: r.slots for r in BT.lang_allocation(df, batch, alpha).collect()}


def test_allocation_cases(spark):
    a = alloc(spark, {"en": 620, "fr": 145, "de": 129, "es": 106}, 64, 0.5)
    assert sum(a.values()) == 64 and all(v >= 1 for v in a.values())
    assert alloc(spark, {"a": 10, "b": 10}, 8, 0.0) == {"a": 4, "b": 4}
    # overshoot kept as in the original rule: 9 languages, one huge, alpha 1
    counts = {"big": 1_000_000, **{f"s{i}": 1 for i in range(8)}}
    got = alloc(spark, counts, 64, 1.0)
    assert got["big"] == 62 and sum(got.values()) == 70


def test_batch_plan_contract(spark):
    rows = [(i, "en" if i < 50 else ("fr" if i < 62 else "de")) for i in range(65)]
    df = spark.createDataFrame(rows, "row_id long, lang string")
    plan = BT.batch_plan(df, micro=4, accum=2).collect()
    slots = {r.lang: r.slots for r in BT.lang_allocation(df.groupBy("lang").count().withColumnRenamed(
        "count", "n"), 8).collect()}
    per_batch = Counter((r.effective_batch, r.lang) for r in plan)
    batches = {r.effective_batch for r in plan}
    assert all(per_batch[(b, lang)] == s for b in batches for lang, s in slots.items())
    # inside one cycle of a language's pool no row repeats, and a complete cycle uses every row
    pool = Counter(lang for _, lang in rows)
    cyc = {}
    for r in plan:
        cyc.setdefault((r.lang, r.cycle), []).append(r.row_id)
    for (lang, c), ids in cyc.items():
        assert len(ids) == len(set(ids))
        if len(ids) == pool[lang]:
            assert set(ids) == {i for i, lg in rows if lg == lang}
    micro_sizes = Counter(r.micro_batch for r in plan)
    assert set(micro_sizes.values()) == {4}
    size = BT.batch_plan_size(BT.lang_allocation(df.groupBy("lang").count().withColumnRenamed("count", "n"), 8),
                              4, 2).first()
    assert size.batches == len(batches) and size.reported_len == 2 * len(batches)


def test_rank_within_hot_group(spark):
    # one group holds most rows: ranks must still be dense 0..n-1 per group
    df = spark.range(5000).withColumn("g", F.when(F.col("id") % 10 == 0, "cold").otherwise("hot"))
    r = rank_within(df, ["g"], [F.col("id").desc()], out="rk", num_partitions=8).collect()
    by = {}
    for x in r:
        by.setdefault(x.g, []).append((x.rk, x.id))
    for g, pairs in by.items():
        pairs.sort()
        assert [p[0] for p in pairs] == list(range(len(pairs)))
        assert [p[1] for p in pairs] == sorted((p[1] for p in pairs), reverse=True)
    ids = with_row_id(df, ["id"], num_partitions=8).collect()
    assert sorted((x.row_index, x.id) for x in ids) == [(i, i) for i in range(5000)]


def test_micro_batches_and_max_len(spark):
    df = spark.createDataFrame([(i, list(range(i % 7))) for i in range(20)], "row_id long, ids array<int>")
    mb = BT.micro_batches(df, 8)
    assert sorted(Counter(r.batch for r in mb.collect()).values()) == [4, 8, 8]
    ml = {r.batch: (r.max_len, r.running_max_len) for r in BT.batch_max_len(mb, "ids", max_seq_len=5).collect()}
    assert ml[0] == (5, 5) and all(v[1] == 5 for v in ml.values())


@pytest.mark.parametrize("side", ["left", "right"])
def test_padding(spark, side):
    df = spark.createDataFrame([(0, 0, [1, 2, 3]), (1, 0, [4]), (2, 1, [5, 6, 7, 8, 9])],
                               "row_id long, batch long, ids array<int>")
    out = {r.row_id: r for r in BT.pad_batches(df, "ids", batch="batch", max_len=4, pad_id=0, side=side,
                                               overflow="truncate").collect()}
    assert all(len(r.input_ids) == len(r.attention_mask) == len(r.labels_padded) for r in out.values())
    if side == "left":
        assert out[1].input_ids == [0, 0, 4] and out[1].attention_mask == [0, 0, 1]
        assert out[1].labels_padded == [-100, -100, 4]
    else:
        assert out[1].input_ids == [4, 0, 0]
    assert out[2].input_ids == [5, 6, 7, 8]  # truncated on request, first tokens kept and the loss counted
    assert (out[0].n_cut, out[1].n_cut, out[2].n_cut) == (0, 0, 1)
    with pytest.raises(Exception, match="longer than max_len"):
        BT.pad_batches(df, "ids", batch="batch", max_len=4).collect()


def test_rank_by_hash_hot_group(spark):
    from babelqa.operators.ranking import rank_by_hash
    df = spark.range(20000).withColumn("g", F.when(F.col("id") % 50 == 0, "cold").otherwise("hot")) \
        .withColumn("h", F.md5(F.col("id").cast("string")))
    rows = rank_by_hash(df, ["g"], "h", ["id"], out="rk").collect()
    for g in ("hot", "cold"):
        mine = sorted((r.rk, r.h) for r in rows if r.g == g)
        assert [m[0] for m in mine] == list(range(len(mine)))
        assert [m[1] for m in mine] == sorted(m[1] for m in mine)


def test_batch_plan_cycles_in_chunks(spark, monkeypatch):
    rows = [(i, "big" if i < 300 else ("mid" if i < 330 else "one")) for i in range(331)]
    df = spark.createDataFrame(rows, "row_id long, lang string")
    full = {tuple(r) for r in BT.batch_plan(df, micro=4, accum=2).collect()}
    monkeypatch.setattr(BT, "CYCLE_CHUNK", 3)
    assert full == {tuple(r) for r in BT.batch_plan(df, micro=4, accum=2).collect()} and len(full) > 0


def test_index_by_key_fails_on_null_and_repeated_keys(spark):
    for bad in ([(1,), (1,)], [(None,), (2,)]):
        df = spark.createDataFrame(bad, "row_id long")
        with pytest.raises(Exception, match="NULL or repeated"):
            with_row_id(df, ["row_id"], key="row_id").collect()


def test_uniform_sample_is_the_front_of_the_hash_order(spark):
    df = spark.range(3000).withColumnRenamed("id", "row_id")
    want = [r.row_id for r in df.orderBy(SM.md5_order(5, F.col("row_id")), "row_id").limit(77).collect()]
    assert sorted(want) == sorted(r.row_id for r in SM.uniform_sample(df, 77, seed=5).collect())
    assert SM.uniform_sample(df, 5000, seed=5).count() == 3000 and SM.uniform_sample(df.limit(0), 5, seed=5).count() == 0


def test_null_groups_are_kept(spark):
    from babelqa.operators.ranking import rank_by_hash, rank_within
    df = spark.createDataFrame([(i, None if i % 2 else "a") for i in range(10)], "id long, g string") \
        .withColumn("h", F.md5(F.col("id").cast("string")))
    assert rank_by_hash(df, ["g"], "h", ["id"]).count() == 10
    assert rank_within(df, ["g"], ["id"], num_partitions=3).count() == 10
    s = spark.createDataFrame([(0, "x_A"), (1, None), (2, None), (3, "y_B")], "row_id long, subset string")
    assert SM.stratified_sample(s, 3, keep_null_subset=True).count() == 3
