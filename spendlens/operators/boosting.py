"""ML-3: training of Spark ML's ``GBTRegressor``, with squared error, over rows of a few bytes.

The result is the estimator's own ``GBTRegressionModel``: the same candidates of
splits, from the same sample of rows, the same gains, order of ties and pruning.
Spark's own training keeps some 440 bytes a row from pass to pass and looks at every
feature of every row by itself.  Here

1. a row is its bins, a byte a feature, and its label, kept in blocks of ``BLOCK`` rows
   and never written again; beside them its prediction, which every tree replaces;
2. a pass counts a block by (node, bin) with numpy, row after row as Spark adds, so that
   ties fall alike; one array a task goes back, whatever its rows;
3. the driver picks the splits from those counts, 3 x nodes x features x bins numbers.
"""

from __future__ import annotations

import json
import sys
import uuid
from typing import Iterable, Iterator, Sequence

import numpy as np
from pyspark import RDD, StorageLevel, cloudpickle
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.serializers import BatchedSerializer, CPickleSerializer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import delete_path, ensure_checkpoint_dir

cloudpickle.register_pickle_by_value(sys.modules[__name__])        # executors need the public libraries only

#: Rows of one block, and of the part of it that is counted at a time (its numbers stay in a
#: processor's own cache).
BLOCK, CHUNK = 262_144, 16_384

#: Tasks from which their counts are added up by other tasks before the driver.
TASKS_TO_DRIVER = 64

EPSILON = 2.0 ** -52

#: Parameters of a row of trees that one tree does not have.
ENSEMBLE = ("lossType", "maxIter", "stepSize", "validationTol", "validationIndicatorCol", "featureSubsetStrategy", "subsamplingRate")

#: A node as Spark stores it.
NODE = ("treeID int, nodeData struct<id: int, prediction: double, impurity: double, impurityStats: array<double>, rawCount: bigint, "
        "gain: double, leftChild: int, rightChild: int, split: struct<featureIndex: int, leftCategoriesOrThreshold: array<double>, numCategories: int>>")


def _sample(rows: DataFrame, fraction: float, seed: int) -> np.ndarray:
    """The rows that Spark's trees look at for the candidates of their splits (about
    10,000): the JVM's sample by partition and place."""
    spark = rows.sparkSession
    if fraction < 1:
        drawn = spark._jvm.org.apache.spark.util.random.XORShiftRandom(seed).nextInt()
        rows = DataFrame(spark._jsparkSession.createDataFrame(rows._jdf.toJavaRDD().sample(False, fraction, drawn), rows._jdf.schema()), spark)
    return np.array([tuple(r) for r in rows.collect()], dtype=np.float64).reshape(-1, len(rows.columns))


def thresholds(values: np.ndarray, expected: float, splits: int) -> np.ndarray:
    """Candidates of the splits of one feature, as ``RandomForest`` finds them: zeros
    are what the sample lacks to the ``expected`` rows."""
    v, n = np.unique(values[values != 0], return_counts=True)
    if not len(v):
        return np.empty(0)
    n = n.astype(np.float64)
    lacking = expected - n.sum()
    if lacking > EPSILON * n.sum() * 100:
        at = np.searchsorted(v, 0.0)
        v, n = np.insert(v, at, 0.0), np.insert(n, at, lacking)
    middle = (v[:-1] + v[1:]) / 2.0
    if len(middle) <= splits:
        return middle
    stride = expected / (splits + 1)
    upto, target, out = n.cumsum(), stride, []
    for i in range(len(middle)):
        if abs(upto[i] - target) < abs(upto[i + 1] - target):
            out.append(middle[i])
            target += stride
    return np.array(out)


class Task:
    """What a task does with blocks ``((bins, label), prediction)``; no prediction before the first tree."""

    def __init__(self, cuts: list[np.ndarray], block: int = BLOCK):
        self.cuts, self.block = cuts, block
        self.bins = [len(c) + 1 for c in cuts]
        self.varies = [f for f, b in enumerate(self.bins) if b > 1] or [0]      # one feature that does not: every tree is one leaf
        self.type = np.uint8 if max(self.bins) <= 256 else np.uint16

    def encode(self, batches: Iterable) -> Iterator:
        """Arrow batches of the features and the label as blocks."""
        import pyarrow as pa

        def block(held):
            x = pa.Table.from_batches(held)
            cols = [c.to_numpy().astype(np.float64, copy=False) for c in x.columns]
            if not all(np.isfinite(c).all() for c in cols):
                raise ValueError("features and labels of the training must not be null, NaN or infinite")
            bins = [np.searchsorted(self.cuts[f], cols[f], side="left").astype(self.type).tobytes() for f in self.varies]
            return pa.RecordBatch.from_arrays([pa.array([b"".join(bins)], pa.binary()), pa.array([cols[-1].tobytes()], pa.binary())],
                                              names=["bins", "label"])

        held, n = [], 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= self.block:
                yield block(held)
                held, n = [], 0
        if n:
            yield block(held)

    def opened(self, row) -> tuple[np.ndarray, np.ndarray]:
        label = np.frombuffer(row[1], dtype=np.float64)
        return np.frombuffer(row[0], dtype=self.type).reshape(len(self.varies), len(label)), label

    def at(self, tree: list[dict], bins: np.ndarray) -> np.ndarray:
        """The node of every row."""
        node = np.zeros(bins.shape[1], dtype=np.int64)
        todo: list = [(0, None)]
        while todo:
            i, rows = todo.pop()
            if "feature" not in tree[i]:
                node[slice(None) if rows is None else rows] = i
                continue
            of = bins[self.varies.index(tree[i]["feature"])]
            right = (of if rows is None else of[rows]) > tree[i]["cut"]
            for side, child in ((~right, "left"), (right, "right")):
                todo.append((tree[i][child], np.flatnonzero(side) if rows is None else rows[side]))
        return node

    def count(self, blocks: Iterable, tree: list[dict], nodes: list[int]) -> Iterator[np.ndarray]:
        """(count, sum, sum of squares) x nodes x bins of all features, of one task."""
        slots = np.full(len(tree), -1, dtype=np.int64)
        slots[nodes] = np.arange(len(nodes))
        m = len(nodes)
        sums = [np.zeros((3, m * self.bins[f])) for f in self.varies]
        for (bins, label), prediction in blocks:
            for at in range(0, len(label), CHUNK):
                part = slice(at, at + CHUNK)
                of, y = bins[:, part], np.empty(len(label[part]))           # numpy adds slowly where a number type was unpickled
                y[:] = label[part] if prediction is None else 2.0 * (label[part] - prediction[part])
                slot = slots[self.at(tree, of)]
                if (slot < 0).any():
                    keep = np.flatnonzero(slot >= 0)
                    slot, of, y = slot[keep], of[:, keep], y[keep]
                square = y * y
                for f, b, total in zip(self.varies, of, sums):
                    key = slot * self.bins[f] + b
                    total[0] += np.bincount(key, minlength=m * self.bins[f])
                    np.add.at(total[1], key, y)         # row after row, as Spark adds
                    np.add.at(total[2], key, square)
        yield np.concatenate([s.reshape(3, m, -1) for s in sums], axis=2)

    def learnt(self, blocks: Iterable, tree: list[dict], weight: float) -> Iterator[np.ndarray]:
        """The predictions of the blocks after one more tree."""
        value = np.array([n["sum"] / n["n"] for n in tree])
        for (bins, _), prediction in blocks:
            one = value[self.at(tree, bins)] * weight
            yield one if prediction is None else prediction + one


def _variance(n, s, q):
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(n == 0, 0.0, (q - s * s / n) / n)


def best_split(task: Task, sums: np.ndarray, node: dict) -> tuple | None:
    """(gain, feature, cut, counts left, counts right) of one node, the first of the best
    in order of features and cuts; none where no split gains."""
    at, best = 0, None
    for f in task.varies:
        upto = sums[:, at:at + task.bins[f]].cumsum(axis=1)
        at += task.bins[f]
        left = upto[:, :-1]
        right = upto[:, -1:] - left
        if not node:                    # the root, counted with its first split
            node |= dict(zip(("n", "sum", "q"), left[:, 0] + right[:, 0] if task.bins[f] > 1 else upto[:, 0]))
        if task.bins[f] == 1:
            continue
        n = left[0] + right[0]
        gain = _variance(node["n"], node["sum"], node["q"]) - left[0] / n * _variance(*left) - right[0] / n * _variance(*right)
        gain = np.where((left[0] < 1) | (right[0] < 1) | ~(gain > 0), 0.0, gain)
        i = int(gain.argmax())
        if gain[i] > (best[0] if best else 0.0):
            best = float(gain[i]), f, i, left[:, i], right[:, i]
    return best


def _kept(blocks: RDD) -> RDD:
    """Kept block by block, so that what is zipped need not be batched anew."""
    return blocks._reserialize(BatchedSerializer(CPickleSerializer(), 1)).persist(StorageLevel.MEMORY_AND_DISK)


def _grow(task: Task, state: RDD, depth: int) -> list[dict]:
    """One tree, a job a level."""
    tree: list[dict] = [{}]
    nodes = [0]
    for level in range(depth):
        part = state.mapPartitions(lambda blocks, t=tree, o=nodes: task.count(blocks, t, o))
        total = part.treeReduce(np.add) if part.getNumPartitions() > TASKS_TO_DRIVER else part.reduce(np.add)
        asked, nodes = nodes, []
        for i, sums in zip(asked, total.transpose(1, 0, 2)):
            split = best_split(task, sums, tree[i])
            if split is None:
                tree[i]["impurity"] = -1.0
                continue
            gain, feature, cut, *sides = split
            tree[i] |= dict(feature=feature, cut=cut, gain=gain, left=len(tree), right=len(tree) + 1)
            for n, s, q in sides:
                if abs(float(_variance(n, s, q))) >= EPSILON and level + 1 < depth:
                    nodes.append(len(tree))
                tree.append(dict(n=n, sum=s, q=q))
        if not nodes:
            break
    _prune(tree, 0)
    return tree


def _prune(tree: list[dict], i: int) -> bool:
    """Makes two leaves of one prediction one; true for a leaf."""
    n = tree[i]
    if "feature" in n:
        both = [_prune(tree, n[side]) for side in ("left", "right")]
        a, z = tree[n["left"]], tree[n["right"]]
        if all(both) and a["sum"] / a["n"] == z["sum"] / z["n"]:
            del n["feature"]
    return "feature" not in n


def _rows(tree: list[dict], cuts: list[np.ndarray], number: int) -> list[tuple]:
    """The nodes of a tree as Spark stores them."""
    out: list = []

    def put(i: int) -> int:
        n, at = tree[i], len(out)
        out.append(None)
        inner = "feature" in n
        kids = (put(n["left"]), put(n["right"])) if inner else (-1, -1)
        split = (n["feature"], [float(cuts[n["feature"]][n["cut"]])], -1) if inner else (-1, [], -1)
        stats = [float(n[k]) for k in ("n", "sum", "q")]
        impurity = n.get("impurity", float(_variance(*map(np.float64, stats))))
        out[at] = (number, (at, stats[1] / stats[0], impurity, stats, int(stats[0]), n["gain"] if inner else -1.0, *kids, split))
        return at

    put(0)
    return out


def _model(spark: SparkSession, estimator: GBTRegressor, trees: list[list[dict]], cuts: list[np.ndarray]) -> GBTRegressionModel:
    """The trees as the model of the estimator, by way of its stored form."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/materialized/boosted-{uuid.uuid4().hex[:12]}"
    params = estimator.extractParamMap()

    def about(kind: str, uid: str, without: Sequence[str] = (), **more) -> str:
        return json.dumps({"class": f"org.apache.spark.ml.regression.{kind}", "timestamp": 0, "sparkVersion": spark.version, "uid": uid,
                           "paramMap": {p.name: v for p, v in params.items() if p.name not in without and estimator.isSet(p)},
                           "defaultParamMap": {p.name: v for p, v in estimator._defaultParamMap.items() if p.name not in without}} | more)

    def put(rows: list, schema: str):
        return spark.createDataFrame(rows, schema).coalesce(1).write

    put([(about("GBTRegressionModel", estimator.uid, numFeatures=len(cuts), numTrees=len(trees)),)], "value string").text(f"{path}/metadata")
    put([(i, about("DecisionTreeRegressionModel", f"dtr_{uuid.uuid4().hex[:12]}", ENSEMBLE), estimator.getStepSize() if i else 1.0)
         for i in range(len(trees))], "_1 int, _2 string, _3 double").parquet(f"{path}/treesMetadata")
    put([r for i, t in enumerate(trees) for r in _rows(t, cuts, i)], NODE).parquet(f"{path}/data")
    model = GBTRegressionModel.load(path)
    delete_path(spark, path)
    return model


def fit(estimator: GBTRegressor, rows: DataFrame, columns: Sequence[str]) -> GBTRegressionModel:
    """``estimator.fit`` on the assembled ``columns`` of ``rows``.  Squared error, all
    features and rows, continuous features: what the amount model asks for."""
    get = estimator.getOrDefault
    plain = {"lossType": "squared", "impurity": "variance", "featureSubsetStrategy": "all", "subsamplingRate": 1.0,
             "minInstancesPerNode": 1, "minInfoGain": 0.0, "minWeightFractionPerNode": 0.0}
    if other := [k for k, v in plain.items() if get(k) != v] or [k for k in ("validationIndicatorCol", "weightCol") if estimator.isSet(k)]:
        raise ValueError(f"not trained here: {other}")
    spark = rows.sparkSession
    rows = rows.select(*[F.col(c).cast("double").alias(c) for c in columns], F.col(get("labelCol")).cast("double").alias("_label"))
    n = rows.count()
    if not n:
        raise ValueError("no rows to learn from")
    fraction = min(1.0, max(get("maxBins") ** 2, 10_000) / n)
    seen = _sample(rows.select(*columns), fraction, get("seed"))
    cuts = [thresholds(seen[:, f], fraction * n, min(get("maxBins"), n) - 1) for f in range(len(columns))]
    task = Task(cuts)
    points = _kept(rows.mapInArrow(task.encode, "bins binary, label binary").rdd.map(task.opened))
    state, made, trees = points.map(lambda b: (b, None)), [], []
    for m in range(get("maxIter")):
        trees.append(_grow(task, state, get("maxDepth")))
        weight = get("stepSize") if m else 1.0
        made.append(_kept(state.mapPartitions(lambda blocks, t=trees[-1], w=weight: task.learnt(blocks, t, w))))
        state = points.zip(made[-1])
        if m > 1:
            made[m - 2].unpersist()         # the last one is there since this tree's first pass
    for old in (points, *made[-3:]):
        old.unpersist()
    return _model(spark, estimator, trees, cuts)
