"""Keyed pseudo-random permutations of 0..n-1 as Column expressions.

A number below ``a * b``, the smallest such product of near equal factors with ``a * b >= n``, is
split into two digits. In each round one digit is shifted by a hash of the key, the round and
the other digit, which can be undone, so all rounds together permute the numbers below
``a * b`` (a Feistel network on mixed radices). A result that is not below n is permuted again
until it is (cycle walking): the walk meets each of the fewer than ``a`` numbers from n on at
most once, which bounds it.

Any single value is computed alone, so position p of a shuffled pool of billions of rows costs
a few hashes, with no sort, no table and no state.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ROUNDS = 6
FIRST_STEPS = 8      # walks longer than this are rare; only they evaluate the long form


def factors(n: Column) -> tuple[Column, Column]:
    """a = ceil(sqrt(n)) and b = ceil(n / a), at least 1."""
    a = F.greatest(F.ceil(F.sqrt(n.cast("double"))), F.lit(1)).cast("long")
    return a, F.greatest(F.ceil(n / a), F.lit(1)).cast("long")


def _shift(key: Column, round_: int, digit: Column) -> Column:
    text = F.concat_ws("|", key, F.lit(str(round_)), digit.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def _digits(x: Column, a: Column) -> Column:
    return F.struct(F.pmod(x, a).alias("l"), F.floor(x / a).cast("long").alias("r"))


def _step(state: Column, round_: int, key: Column, a: Column, b: Column, back: bool) -> Column:
    l, r = state["l"], state["r"]
    sign = -1 if back else 1
    if round_ % 2 == 0:
        return F.struct(F.pmod(l + sign * _shift(key, round_, r), a).alias("l"), r.alias("r"))
    return F.struct(l.alias("l"), F.pmod(r + sign * _shift(key, round_, l), b).alias("r"))


def _once(x: Column, key: Column, a: Column, b: Column, back: bool) -> Column:
    """One pass of all rounds. The rounds run inside ``aggregate``, so that each round's digits
    are computed once and not once for every use in the next."""
    rounds = [F.lit(i) for i in (reversed(range(ROUNDS)) if back else range(ROUNDS))]

    def step(state, i):
        out = _step(state, ROUNDS - 1, key, a, b, back)
        for k in range(ROUNDS - 1):
            out = F.when(i == k, _step(state, k, key, a, b, back)).otherwise(out)
        return out

    return F.aggregate(F.array(*rounds), _digits(x, a), step, lambda s: s["r"] * a + s["l"])


def permuted(x: Column, n: Column, key: Column, back: bool = False) -> Column:
    """Where the permutation of ``key`` takes x (0 <= x < n); ``back`` is the inverse."""
    a, b = factors(n)

    def walk(start, steps):
        return F.aggregate(steps, start, lambda v, i: F.when((i > 0) & (v < n), v).otherwise(_once(v, key, a, b, back)))

    near = walk(x.cast("long"), F.array(*[F.lit(i) for i in range(FIRST_STEPS)]))
    far = walk(x.cast("long"), F.sequence(F.lit(0).cast("long"), a))
    return F.when((x < 0) | (x >= n), F.raise_error(F.lit("place outside of the pool")).cast("long")).otherwise(
        F.transform(F.array(near), lambda v: F.when(v < n, v).otherwise(far))[0])
