"""ML-10: isolation forest on one numeric column (Liu, Ting, Zhou 2008).

With a single feature every isolation tree is a partition of the real line
into leaf intervals, so the forest's mean path length E[h](x) is a step
function with at most ``n_trees * sample_size`` breakpoints.  The job:

1. **Sample** (one pass, no per-row Python): a tree draws a row with chance
   ``rate = 2 * psi / n``.  A hash of a few narrow columns and the seed gives a
   row one uniform number ``u`` for every block of ``1 / rate`` trees (one block
   where there are many rows): it survives where ``u < trees * rate``, and only
   then is its tree worked out, ``floor(u / rate)``.  A tree keeps the ``psi`` rows
   of the smallest ``u`` (``row_number`` per tree: <= ~2 psi rows each).
2. **Fit** each tree on its <= psi values with ``applyInPandas`` grouped by
   tree id (100 groups of <= 256 rows): random splits uniform in
   [min, max], ``x <= threshold`` goes left, height limit ceil(log2 psi),
   leaf path = depth + c(size).
3. **Merge** the trees into one step table: path-length deltas at every
   breakpoint, summed per breakpoint and accumulated (<= T * psi rows, a
   bound fixed by the parameters, not by the data).
4. **Score** rows with the JVM ``Bucketizer`` (binary search over the
   breakpoints) and a broadcast join to the step values -- no Python in the
   per-row pass.  score = 2 ** (-E[h] / c(psi)).
5. **Threshold**: rows are counted per step, and the quantile of the scores is
   the weighted quantile of the steps.

Deterministic under repartitioning: the sample depends on row content and
the seed only, and each tree's random splits on (seed, tree id).
"""

from __future__ import annotations

import dataclasses
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import aggregates as A
from .quantiles import ranked_values

EULER = 0.5772156649015329


def avg_path(n: float) -> float:
    """c(n): average path length of an unsuccessful BST search."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + EULER) - 2.0 * (n - 1.0) / n


def _fit_tree(values: np.ndarray, rng: np.random.Generator, height_limit: int) -> list[tuple[float, float, float]]:
    """Leaves of one isolation tree as (lo, hi, path) with lo < x <= hi."""
    leaves = []
    stack = [(np.sort(values), -np.inf, np.inf, 0)]
    while stack:
        v, lo, hi, depth = stack.pop()
        if depth >= height_limit or len(v) <= 1 or v[0] == v[-1]:
            leaves.append((lo, hi, depth + avg_path(len(v))))
            continue
        thr = rng.uniform(v[0], v[-1])
        if thr >= v[-1]:          # guard the open upper end of uniform()
            thr = np.nextafter(v[-1], -np.inf)
        cut = np.searchsorted(v, thr, side="right")
        stack.append((v[:cut], lo, thr, depth + 1))
        stack.append((v[cut:], thr, hi, depth + 1))
    return leaves


def _fit_group_factory(seed: int, psi: int):
    height = int(math.ceil(math.log2(max(psi, 2))))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree_id"].iloc[0])
        rng = np.random.default_rng([seed, tree])
        leaves = _fit_tree(pdf["x"].to_numpy(dtype=float), rng, height)
        out = pd.DataFrame(leaves, columns=["lo", "hi", "path"])
        out.insert(0, "tree_id", tree)
        return out
    return fit


@dataclasses.dataclass
class IsolationModel:
    step: DataFrame         # (b, mean_path) : E[h](x) for x in (b, next b]
    base_path: float        # E[h] for x <= first breakpoint
    splits: list[float]     # breakpoints, ascending
    values: list[float]     # E[h] per bucket (len = len(splits) + 1)
    c_psi: float
    psi: int
    n_trees: int


#: Columns whose hash draws a row, where present; rows that agree in all of them
#: and the value are drawn alike.
KEY = ("request_line", "request_id", "line_no", "order_date")


def sample(df: DataFrame, value: str, n_trees: int, sample_size: int, seed: int, n: int) -> DataFrame:
    """Step 1: (tree_id, x) rows, at most ``psi`` per tree (``n`` = row count)."""
    key = [F.col(c) for c in KEY if c in df.columns][:2]
    psi = min(sample_size, n)
    rate = min(2.0 * psi / max(n, 1), 1.0)
    block = min(n_trees, int(1.0 / rate)) if rate > 0 else n_trees        # trees of one draw
    draws = -(-n_trees // block)

    def drawn(j: int):
        h = F.xxhash64(*key, F.col(value), F.lit(seed), F.lit(j))
        u = h.bitwiseAND(F.lit((1 << 53) - 1)).cast("double") / float(1 << 53)
        trees = min(block, n_trees - j * block)
        tree = F.least(F.floor(u / rate), F.lit(trees - 1)).cast("int") + j * block
        return F.when(u < trees * rate, F.struct(tree.alias("tree_id"), u.alias("_u")))

    if draws == 1:
        cand = df.select(F.col(value).cast("double").alias("x"), drawn(0).alias("d")).where("d is not null")
    else:
        some = F.array_compact(F.array(*[drawn(j) for j in range(draws)]))
        cand = df.select(F.col(value).cast("double").alias("x"), F.explode(some).alias("d"))
    w = Window.partitionBy("tree_id").orderBy("_u", "x")
    return (cand.select("x", "d.*").withColumn("_rk", F.row_number().over(w))
            .where(F.col("_rk") <= psi).select("tree_id", "x"))


def fit(df: DataFrame, value: str = "amount", n_trees: int = 100, sample_size: int = 256,
        seed: int = 42) -> IsolationModel:
    """Steps 1-3.  Only the step table (<= n_trees * sample_size rows, a
    parameter bound) is brought to the driver, as any fitted model is."""
    n = df.count()
    psi = int(min(sample_size, n))
    s = sample(df, value, n_trees, sample_size, seed, n)
    leaves = A.keep_small(s.groupBy("tree_id").applyInPandas(          # <= T * psi rows, fitted once
        _fit_group_factory(seed, psi), "tree_id int, lo double, hi double, path double"))
    # step deltas at each finite upper bound of a leaf: next leaf's path - this one's
    w = Window.partitionBy("tree_id").orderBy("lo")
    lv = leaves.withColumn("_next", F.lead("path").over(w))
    # every tree has exactly one leftmost leaf: its count is the number of trees
    head = lv.where(F.col("lo") == float("-inf")).agg(F.sum("path").alias("s"), F.count(F.lit(1)).alias("t")).first()
    first, trees = head["s"] or 0.0, head["t"]
    deltas = (lv.where(F.col("_next").isNotNull())
              .groupBy(F.col("hi").alias("b")).agg(F.sum(F.col("_next") - F.col("path")).alias("d")))
    ws = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, 0)   # <= T * psi rows
    step = deltas.withColumn("mean_path", (F.lit(first) + F.sum("d").over(ws)) / float(max(trees, 1)))
    rows = step.orderBy("b").select("b", "mean_path").collect()
    splits = [r["b"] for r in rows]
    values = [first / max(trees, 1)] + [r["mean_path"] for r in rows]
    return IsolationModel(step=step.select("b", "mean_path"), base_path=values[0], splits=splits,
                          values=values, c_psi=avg_path(psi), psi=psi, n_trees=trees)


def bucketed(model: IsolationModel, df: DataFrame, value: str = "amount") -> DataFrame:
    """``df`` with ``_bk``, the number of the step in which a row's value lies (binary
    search in the JVM)."""
    from pyspark.ml.feature import Bucketizer

    # Bucketizer buckets are [s_i, s_i+1); ours are (b_i, b_i+1]: shift each
    # breakpoint to the next representable double.
    inner = [float(np.nextafter(b, np.inf)) for b in model.splits]
    splits = [float("-inf")] + inner + [float("inf")]
    tmp = df.withColumn("_x", F.col(value).cast("double"))
    if len(splits) > 2:
        b = Bucketizer(splits=splits, inputCol="_x", outputCol="_bk", handleInvalid="keep").transform(tmp)
    else:
        b = tmp.withColumn("_bk", F.lit(0.0))
    return b.withColumn("_bk", F.col("_bk").cast("int")).drop("_x")


def step_scores(model: IsolationModel, spark) -> DataFrame:
    """(bucket, score = 2^(-E[h]/c(psi))) of every step (<= T * psi + 1 rows)."""
    c = model.c_psi if model.c_psi > 0 else 1.0
    tab = spark.createDataFrame(list(enumerate(model.values)), "bucket int, mean_path double")
    return tab.select("bucket", F.pow(F.lit(2.0), -F.col("mean_path") / c).alias("_score"))


def score(model: IsolationModel, df: DataFrame, value: str = "amount",
          out: str = "anomaly_score") -> DataFrame:
    """Step 4: the score of the step of every row."""
    steps = F.broadcast(step_scores(model, df.sparkSession))                # <= T * psi + 1 rows
    b = bucketed(model, df, value)
    return b.join(steps, b["_bk"] == steps["bucket"], "left").withColumnRenamed("_score", out).drop("_bk", "bucket")


def threshold(model: IsolationModel, df: DataFrame, quantile: float, value: str = "amount") -> DataFrame:
    """Step 5: the exact quantile of the row scores (one row, ``_thr``), from the number
    of rows on each step: at most T * psi + 1 groups, no rank of rows."""
    spark = df.sparkSession
    rows = bucketed(model, df.where(F.col(value).isNotNull()).select(value), value).groupBy("_bk").agg(F.count("*").alias("_c"))
    counts = (rows.join(F.broadcast(step_scores(model, spark)), F.col("_bk") == F.col("bucket"))
              .groupBy(F.col("_score").alias("_v")).agg(F.sum("_c").alias("_c")))
    return ranked_values(counts, [quantile], ["_thr"]).select("_thr")


def score_with_python(model: IsolationModel, values: np.ndarray) -> np.ndarray:
    """Reference scorer on the driver for tests (not used by the jobs)."""
    idx = np.searchsorted(np.asarray(model.splits), values, side="left")
    path = np.asarray(model.values)[idx]
    c = model.c_psi if model.c_psi > 0 else 1.0
    return np.power(2.0, -path / c)
