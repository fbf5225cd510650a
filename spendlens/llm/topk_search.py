"""Exact top-k inner products by norm-bucketed retrieval (LEMP).

Vectors are grouped by length into buckets.  A query's k-th best score so far,
divided by its own length and by the bucket's greatest length, is the local
cosine threshold t of that bucket.  Per query and bucket one way is chosen:

* t > 1: the whole bucket is pruned by length;
* t <= ``LENGTH_BELOW``: length pruning - only the bucket's beginning, where
  length x query length still reaches the threshold, is multiplied;
* otherwise coordinate pruning - the query's largest coordinate f gives an
  interval outside of which no unit vector can reach the cosine t
  (``q_f t +- sqrt((1 - q_f^2)(1 - t^2))``), and only vectors inside the
  interval are multiplied.

All surviving products are verified exactly.  First thresholds come from a
seeding pass over about ``SEED_ROWS`` vectors, half an evenly hashed set and half
the longest of the others (a number that does not grow with the input); any lower
bound keeps results exact, so the seed decides speed only.  A bound is a score and
an id: of equal scores, which a very common vector gives in any number, only ids
below that of the k-th best can still enter.  Bounds rise inside a cell from
bucket to bucket.

Vectors are sorted by length over the whole cluster (range partitions on length
and id, so equal lengths are no hot key) and packed into bounded buckets, the
queries into bounded blocks.  The work is a grid of cells, each a few blocks
beside a few buckets; a cell emits at most k rows per query, merged by a final
window.  In its cell, a bucket shorter than anything a block still needs is
passed over unread.  Components become ``floor(64 x)``; products are exact integers
(float64 while they stay below 2^53, Python integers beyond; a product that no long
holds raises).

Vectors that are null, or hold a null, NaN or infinity, take no part; nor do
null ids.  Rows that repeat an id are candidates, and queries, each by itself (so
they are candidates of each other); vectors only meet vectors of the same dimension; an empty table gives no rows; a query with fewer
than k candidates returns them all; ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spendlens.operators.ranks import placed
from spendlens.session import materialize

BLOCK = 1024              # queries per block
BUCKET = 4096             # vectors per bucket
CELL = 2                  # blocks and buckets per side of a grid cell
SEED_ROWS = 2048          # vectors of the seeding pass, about (one task packs them)
LENGTH_BELOW = 0.6        # local threshold up to which length pruning is used
EXACT = 2.0 ** 52
ANY = 2 ** 63 - 1         # id of a bound without one


def quantize(df: DataFrame, key: str = "vec_id", vector: str = "embedding", scale: float = 64.0) -> DataFrame:
    """(id, v, dim, norm) of the rows that take part; v is array<double> of integers."""
    x = F.col(vector)
    bad = F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    rows = (df.select(F.col(key).cast("long").alias("id"), x.cast("array<double>").alias(vector))
            .where(F.col("id").isNotNull() & x.isNotNull() & ~F.coalesce(bad, F.lit(True)))
            # floor as a double: a bigint would saturate far components
            .withColumn("v", F.transform(vector, lambda e: F.rint(F.lit(scale) * e)
                                         - F.when(F.rint(F.lit(scale) * e) > F.lit(scale) * e, 1.0).otherwise(0.0)))
            .select("id", "v"))
    return rows.withColumn("dim", F.size("v")).withColumn(
        "norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, e: a + e * e)))


def _pack(df: DataFrame, size: int, few: bool = False) -> DataFrame:
    """Rows (id, v, dim, norm, floor, last) sorted by length, longest first, and packed
    into rows of at most ``size`` vectors of one dimension.  ``few``: the rows are
    of a fixed number and packed by one task, into as few packs as can be."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = []

        def packs(last: bool) -> Iterator[pd.DataFrame]:
            rows = pd.concat(held) if held else pd.DataFrame()
            held.clear()
            at = 0
            while at < len(rows):
                dim = rows["dim"].iloc[at]
                part = rows.iloc[at:at + size]
                part = part[(part["dim"] != dim).cumsum() == 0]
                if not last and at + len(part) == len(rows) and len(part) < size:
                    break
                at += len(part)
                raw = [np.ascontiguousarray(part[c].to_numpy(), dtype=kind).tobytes()
                       for c, kind in (("id", "<i8"), ("norm", "<f8"), ("floor", "<f8"), ("last", "<i8"))]
                v = np.array(part["v"].tolist(), dtype="<f8").tobytes()
                yield pd.DataFrame([(int(dim), int(part["id"].iloc[0]), float(part["norm"].max()), *raw, v)],
                                   columns=["dim", "pack", "top", "ids", "norms", "floors", "lasts", "vs"])
            if at < len(rows):
                held.append(rows.iloc[at:])

        for frame in frames:
            held.append(frame)
            if sum(map(len, held)) >= size:
                yield from packs(False)
        yield from packs(True)

    return ((df.repartition(1) if few else df.repartitionByRange("dim", F.desc("norm"), "id"))
            .sortWithinPartitions("dim", F.desc("norm"), "id")
            .mapInPandas(run, "dim int, pack long, top double, ids binary, norms binary, floors binary, lasts binary, "
                               "vs binary"))


def _products(q: np.ndarray, p: np.ndarray, reach: float) -> np.ndarray:
    if reach < EXACT:
        return p @ q
    full = [sum(int(a) * int(b) for a, b in zip(row, q, strict=True)) for row in p]
    if any(not -2 ** 63 <= x < 2 ** 63 for x in full):
        raise OverflowError("an inner product is beyond the long range")
    return np.array(full, dtype=object)


def _below(score: int) -> float:
    """The score as a double that is not above it."""
    return float(score) if abs(score) < EXACT else float(score) - abs(float(score)) * 2.0 ** -50


def search_bucket(q_ids, q, floor, last, p_ids, p, norms, k: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """(query's place, its best (-score, candidate)) of one bucket, as far as they
    may belong to a top k.

    ``floor`` and ``last``: per query a proven lower bound of its k-th best score
    (-inf if none), and the id that scores equal to it must not exceed;
    ``norms`` falls along the bucket."""
    out = []
    if not len(p_ids):
        return out
    unit = p / np.maximum(norms, 1e-300)[:, None]
    order = {}                                             # coordinate -> rows sorted by it
    lengths = np.sqrt((q * q).sum(1))
    slack = 1e-9
    for i in range(len(q_ids)):
        ql, at_least = lengths[i], floor[i]
        rows = None
        if np.isfinite(at_least) and ql > 0 and norms[0] > 0:
            t = at_least / (ql * norms[0])
            if t > 1 + slack:
                continue
            if t > LENGTH_BELOW:
                f = int(np.argmax(np.abs(q[i])))
                c = q[i, f] / ql
                spread = np.sqrt(max(1 - c * c, 0.0) * max(1 - t * t, 0.0)) + 1e-7
                if f not in order:
                    by = np.argsort(unit[:, f], kind="stable")
                    order[f] = by, unit[by, f]
                by, values = order[f]
                # angles to the axis lie within arccos(t) of the query's own
                low = c * t - spread if c >= -t else -1.1
                high = c * t + spread if c <= t else 1.1
                rows = by[np.searchsorted(values, low, "left"):np.searchsorted(values, high, "right")]
            elif at_least > 0:
                rows = np.arange(np.searchsorted(-norms, -(at_least / ql) * (1 - slack), "right"))
        part = p if rows is None else p[rows]
        ids = p_ids if rows is None else p_ids[rows]
        if not len(ids):
            continue
        s = _products(q[i], part, float(ql * norms[0]))
        keep = ids != q_ids[i]
        if np.isfinite(at_least):
            keep &= (s > at_least) | ((s == at_least) & (ids <= last[i]))
        s, ids = s[keep], ids[keep]
        if len(s) > k:
            edge = np.sort(s)[-k] if s.dtype == object else np.partition(s, len(s) - k)[-k]
            near = s >= edge
            s, ids = s[near], ids[near]
        if len(ids):
            out.append((i, sorted(zip((-int(x) for x in s), ids.tolist(), strict=True))[:k]))
    return out


def _run(blocks: DataFrame, buckets: DataFrame, k: int) -> DataFrame:
    """Every block beside every bucket of its dimension (a stated query set in
    blocks against all rows in blocks): block i is sent to the cells of its row
    of the grid, bucket j to the cells of its column."""
    down = max(1, -(-blocks.count() // CELL))
    across = max(1, -(-buckets.count() // CELL))

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        right = right.sort_values("top", ascending=False)
        for b in left.itertuples(index=False):
            q_ids = np.frombuffer(b.ids, "<i8")
            floor, last = np.frombuffer(b.floors, "<f8").copy(), np.frombuffer(b.lasts, "<i8").copy()
            q = np.frombuffer(b.vs, "<f8").reshape(len(q_ids), -1)
            lengths = np.maximum(np.sqrt((q * q).sum(1)), 1e-300)
            held = [[] for _ in q_ids]
            for p in right.itertuples(index=False):
                need = float(np.min(floor / lengths)) * (1 - 1e-9)
                if need > 0 and p.top < need:
                    break
                ids = np.frombuffer(p.ids, "<i8")
                for i, found in search_bucket(q_ids, q, floor, last, ids, np.frombuffer(p.vs, "<f8").reshape(len(ids), -1),
                                              np.frombuffer(p.norms, "<f8"), k):
                    held[i] = sorted(held[i] + found)[:k]
                    if len(held[i]) == k:
                        least, c = held[i][-1]
                        if (_below(-least), -c) > (floor[i], -last[i]):
                            floor[i], last[i] = _below(-least), c
            out += [(int(q_ids[i]), c, -x) for i, best in enumerate(held) for x, c in best]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype("int64")

    row = F.pmod(F.xxhash64("pack", F.lit(1)), F.lit(down)).cast("int")       # one type on both sides: keys are hashed
    column = F.pmod(F.xxhash64("pack", F.lit(2)), F.lit(across)).cast("int")
    left = blocks.withColumn("r", row).withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(across - 1))))
    right = buckets.withColumn("c", column).withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(down - 1))))
    return (left.groupBy("dim", "r", "c").cogroup(right.groupBy("dim", "r", "c"))
            .applyInPandas(run, "query_id long, vec_id long, score long"))


def _best(scores: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def top_k(df: DataFrame, k: int = 20, every: int = 20, key: str = "vec_id", vector: str = "embedding",
          scale: float = 64.0) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of every row but the query's
    own, for the rows whose id is divisible by ``every``."""
    # every row is named by its place in the order of ids, so that of equal scores the
    # smaller id comes first, and a row that shares its id with others stays one of them
    rows = placed(quantize(df, key, vector, scale).withColumnRenamed("id", "vec").withColumn("all", F.lit(0)), "all", [F.col("vec")], "topk-ids")
    rows = materialize(rows.select(F.col("pos").alias("id"), "vec", "v", "dim", "norm"), "topk-rows")
    names, rows, asked = rows.select("id", "vec"), rows.drop("vec"), rows.where(F.col("vec") % every == 0).select("id")
    unbound = {"floor": F.lit(float("-inf")), "last": F.lit(ANY)}
    buckets = materialize(_pack(rows.withColumns(unbound), BUCKET), "topk-buckets")
    queries = rows.join(asked, "id", "left_semi")
    # seeding: half an even sample, half the longest of the others
    share = min(1.0, SEED_ROWS / 2 / max(rows.count(), 1))
    even = F.pmod(F.xxhash64("id", F.lit(9)), F.lit(1 << 40)) < share * (1 << 40)
    seeds = rows.where(even).unionByName(rows.where(~even).orderBy(F.desc("norm"), "id").limit(SEED_ROWS // 2))
    found = _best(_run(materialize(_pack(queries.withColumns(unbound), BLOCK), "topk-first"),
                       materialize(_pack(seeds.withColumns(unbound), BUCKET, few=True), "topk-seeds"), k), k)
    score = F.col("score").cast("double")
    below = F.when(F.abs(score) < EXACT, score).otherwise(score - F.abs(score) * 2.0 ** -50)
    floors = (found.where(F.col("rank") == k)
              .select(F.col("query_id").alias("id"), below.alias("floor"), F.col("vec_id").alias("last")))
    known = queries.join(floors, "id", "left").withColumns({c: F.coalesce(c, none) for c, none in unbound.items()})
    scores = _run(materialize(_pack(known, BLOCK), "topk-blocks"), buckets, k)
    best = _best(materialize(scores, "topk-scores"), k).select(F.col("query_id").alias("q"), F.col("rank").cast("int").alias("rank"),
                                                               F.col("vec_id").alias("c"), "score")
    return (best.join(names.select(F.col("id").alias("q"), F.col("vec").alias("query_id")), "q")
            .join(names.select(F.col("id").alias("c"), F.col("vec").alias("vec_id")), "c")
            .select("query_id", "rank", "vec_id", "score"))
