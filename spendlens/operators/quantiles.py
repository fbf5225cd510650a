"""Exact, skew-safe quantiles (linear interpolation, as pandas / quantile_cont).

Spark's exact ``percentile``/``median`` merge a value->count map per group in
one task, so one hot group (say a third of all rows) would be held by a single
task.  Here a sketch only brackets the wanted ranks, and an exact pass counts:

1. one partial aggregate per group: the row count and ``percentile_approx`` a
   little below and above each probability.  The sketch errs by at most
   ``n / accuracy`` ranks and the margin is four times that, so the two rows
   around the wanted rank lie inside the bracket; groups of up to ``accuracy``
   rows are one bracket as a whole.
2. one partial aggregate of counts: values inside a bracket by themselves, all
   the others by the gap between brackets in which they fall.
3. a running sum over those counts - at most about ``8 n / accuracy`` rows a
   probability for a group of ``n`` - gives exact ranks, and the values at the
   two ranks around ``1 + p (n - 1)`` are interpolated.

All probabilities of all groups share both passes, whatever the size, and
nothing runs while the plan is made.  A rank outside its bracket would raise.
Result: one row per group with ``n`` and one column per probability.
"""

from __future__ import annotations

import math
from functools import reduce
from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Width of a bracket on either side, in sketch errors.
MARGIN = 4

#: Groups up to which every task may get all brackets (a row is some 200 bytes in memory).
FEW_GROUPS = 200_000


def _any(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def _brackets(vals: DataFrame, keys: Sequence[str], probs: Sequence[float], accuracy: int) -> DataFrame:
    """(keys, _n, _lo0, _hi0, _lo1, ...): pass 1."""
    eps = MARGIN / accuracy
    asks = [x for p in probs for x in (p - eps, p + eps)]
    sketch = F.percentile_approx("_v", F.array(*[F.lit(min(max(x, 0.0), 1.0)) for x in asks]), accuracy)
    out = vals.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), sketch.alias("_b"))
    whole = F.col("_n") <= accuracy
    ends = []
    for j, x in enumerate(asks):
        low = j % 2 == 0
        beyond = F.lit(-math.inf if low else math.inf)
        inner = beyond if (x <= 0.0 if low else x >= 1.0) else F.when(whole, beyond).otherwise(F.col("_b")[j])
        ends.append(inner.alias(f"_{'lo' if low else 'hi'}{j // 2}"))
    return out.select(*keys, "_n", *ends)


def ranked_values(counts: DataFrame, probs: Sequence[float], names: Sequence[str], keys: Sequence[str] = (),
                  order: Sequence[str] = ("_v",), size: Column | None = None) -> DataFrame:
    """Pass 3: quantiles of values ``_v`` that occur ``_c`` times (null ``_v``: some
    values between its neighbours).  One row per group with ``_n``."""
    keys = list(keys)
    group = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    upto = group.orderBy(*[F.col(c).asc_nulls_first() for c in order]).rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.withColumn("_n", F.sum("_c").over(group) if size is None else size).withColumn("_end", F.sum("_c").over(upto))
    aggs = [F.max("_n").alias("_n")]
    for i, p in enumerate(probs):
        pos = F.lit(1.0) + F.lit(float(p)) * (F.col("_n") - 1)
        for rank, name in ((F.floor(pos), f"_a{i}"), (F.ceil(pos), f"_z{i}")):
            at = (rank > F.col("_end") - F.col("_c")) & (rank <= F.col("_end"))
            aggs.append(F.max(F.when(at, F.col("_v"))).alias(name))
        aggs.append(F.max(pos - F.floor(pos)).alias(f"_f{i}"))
    one = ranked.groupBy(*keys).agg(*aggs)
    lost = F.raise_error(F.lit("a rank lies outside its bracket")).cast("double")
    def between(i: int) -> Column:
        a, z = F.col(f"_a{i}"), F.col(f"_z{i}")
        return F.when(a == z, a).otherwise(a + F.col(f"_f{i}") * (z - a))       # also for infinite values
    return one.select(*keys, "_n", *[F.when(F.col("_n").isNotNull(), F.coalesce(between(i), lost)).alias(names[i])
                                     for i in range(len(probs))])


def _bracketed(vals: DataFrame, brackets: DataFrame, keys: Sequence[str], bounds: Sequence[str], few: bool,
               salts: int = 16) -> DataFrame:
    """Every value with the bounds of its group.  Every task gets the brackets of a
    ``few`` groups, and no value is dealt or sorted; of any number they are joined by
    shuffle, each group in ``salts`` parts, so that a hot one does not meet in one task."""
    named = brackets.select(*[F.col(c).alias(f"{c}_") for c in keys], *bounds)
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"{c}_")) for c in keys])
    if few:
        return vals.join(F.broadcast(named), same)
    named = named.withColumn("_dp", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))))
    dealt = vals.withColumn("_part", F.pmod(F.xxhash64("_v"), F.lit(salts)))
    return dealt.join(named, same & (F.col("_part") == F.col("_dp"))).drop("_part", "_dp")


def exact_percentiles(df: DataFrame, value: str, probs: Sequence[float],
                      by: Sequence[str] = (), names: Sequence[str] | None = None,
                      accuracy: int = 10_000, exact: bool = True, few: bool = False) -> DataFrame:
    """See the module docstring.  ``few``: at most ``FEW_GROUPS`` groups are known to
    come, so that their brackets can be broadcast.  ``exact=False`` returns the sketch values
    (``percentile_approx``, rank error <= n / accuracy) in one aggregation."""
    by = list(by)
    probs = [float(p) for p in probs]
    k = len(probs)
    names = list(names) if names else [f"q{i}" for i in range(k)]
    keys = [f"_k{i}" for i in range(len(by))]
    vals = df.select(*[F.col(c).alias(key) for c, key in zip(by, keys)], F.col(value).cast("double").alias("_v"))
    vals = vals.where(F.col("_v").isNotNull() & ~F.isnan("_v"))

    def finish(out: DataFrame) -> DataFrame:
        out = out if by else out.where("_n is not null")
        return out.select(*[F.col(key).alias(c) for c, key in zip(by, keys)], F.col("_n").alias("n"), *names)

    if not exact:
        sketch = F.percentile_approx("_v", F.array(*[F.lit(p) for p in probs]), accuracy)
        out = vals.groupBy(*keys).agg(F.count(F.lit(1)).alias("_c"), sketch.alias("_q"))
        return finish(out.withColumn("_n", F.when(F.col("_c") > 0, F.col("_c")))
                      .select(*keys, "_n", *[F.col("_q")[i].cast("double").alias(names[i]) for i in range(k)]))

    brackets = _brackets(vals, keys, probs, accuracy)
    bounds = [c for c in brackets.columns if c not in keys]
    if by:
        seen = _bracketed(vals, brackets, keys, bounds, few)
    else:
        seen = vals.withColumn("_br", brackets.select(F.struct(*bounds)).scalar()).select("_v", "_br.*")
    v = F.col("_v")
    above = sum(((v >= F.col(f"_lo{i}")).cast("int") + (v > F.col(f"_hi{i}")).cast("int") for i in range(k)), F.lit(0))
    inside = _any([(v >= F.col(f"_lo{i}")) & (v <= F.col(f"_hi{i}")) for i in range(k)])
    cells = (seen.groupBy(*keys, above.alias("_s"), F.when(inside, v).alias("_v"))
             .agg(F.count(F.lit(1)).alias("_c")))
    return finish(ranked_values(cells, probs, names, keys, order=("_s", "_v")))


def exact_percentile_scalar(df: DataFrame, value: str, probs: Sequence[float],
                            names: Sequence[str], accuracy: int = 10_000, exact: bool = True) -> DataFrame:
    """Global quantiles as a one-row frame (zero rows in -> one row of nulls)."""
    q = exact_percentiles(df, value, probs, names=names, accuracy=accuracy, exact=exact)
    return q.agg(*[F.max(n).alias(n) for n in names])
