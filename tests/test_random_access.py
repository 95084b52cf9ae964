"""Keyed permutations and batches of the plan computed alone."""

from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from babelqa.functions.permute import permuted
from babelqa.operators import batching as BT


def test_permutations_and_their_inverse(spark):
    sizes = [1, 2, 3, 5, 7, 10, 17, 97, 101, 360]
    df = spark.createDataFrame([(n, x) for n in sizes for x in range(n)], "n long, x long")
    y = df.withColumn("y", permuted(F.col("x"), F.col("n"), F.lit("k"))).withColumn("z", permuted(F.col("x"), F.col("n"), F.lit("l")))
    rows = y.withColumn("back", permuted(F.col("y"), F.col("n"), F.lit("k"), back=True)).collect()
    for n in sizes:
        mine = sorted((r.x, r.y, r.z, r.back) for r in rows if r.n == n)
        assert sorted(r[1] for r in mine) == list(range(n)) == [r[3] for r in mine]
        if n > 50:
            assert len({r[1] - r[0] for r in mine}) > n // 3 and [r[1] for r in mine] != [r[2] for r in mine]
    with pytest.raises(Exception, match="outside of the pool"):
        spark.range(1).select(permuted(F.lit(4), F.lit(4), F.lit("k"))).collect()


def test_batches_alone_equal_the_whole_plan(spark):
    rows = [(k, "ab"[k % 2] if k % 5 else ("c" if k % 10 else None)) for k in range(83)]
    df = spark.createDataFrame(rows, "row_id long, lang string")
    index, facts = BT.plan_index(df, micro=4, accum=2)
    batches = facts[0]["batches"]
    whole = {tuple(r) for r in BT.plan_batches(index, facts, 0, 3 * batches, micro=4).collect()}
    for k in (0, 1, batches, 3 * batches - 1):
        alone = {tuple(r) for r in BT.plan_batches(index, facts, k, k + 1, micro=4).collect()}
        assert alone == {r for r in whole if r[0] == k} and len(alone) == 8
    slots = {f["lang"]: f["slots"] for f in facts}
    used = defaultdict(Counter)
    for batch, micro, pos, lang, row, cycle in whole:
        assert micro // 2 == batch and 0 <= pos < 4 and dict(rows)[row] == lang
        used[lang, cycle][row] += 1
    assert all(Counter(r[3] for r in whole if r[0] == b) == slots for b in range(3 * batches))
    assert all(set(c.values()) == {1} for c in used.values())          # no row twice in a cycle
    for f in facts:                                                     # every cycle but the last is complete
        cycles = sorted(c for lang, c in used if lang == f["lang"])
        assert all(len(used[f["lang"], c]) == f["n"] for c in cycles[:-1])
    assert BT.plan_batches(index, facts, 5, 5, micro=4).count() == 0
    none = BT.plan_index(df.limit(0), micro=4, accum=2)
    assert BT.plan_batches(*none, 0, 5, micro=4).count() == 0
