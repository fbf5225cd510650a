"""Exact quantiles equal numpy's linear interpolation at every group size, with a
hot group, many ties and null groups."""

import numpy as np
import pytest

from spendlens.operators.quantiles import exact_percentile_scalar, exact_percentiles

PROBS = [0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 1.0]


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(7)
    rows = []
    # a hot key holding a third of the rows, a tie-heavy key, and small keys
    for i in range(6000):
        rows.append(("hot", float(rng.lognormal(10, 1))))
    for i in range(3000):
        rows.append(("ties", float(rng.integers(0, 5))))
    for k in range(30):
        for i in range(int(rng.integers(1, 300))):
            rows.append((f"k{k}", float(rng.normal(100, 30))))
    rows.append(("hot", None))
    rows.append(("hot", float("nan")))
    df = spark.createDataFrame(rows, "g string, v double").repartition(7)
    return rows, df


def expected(rows):
    out = {}
    for g in {r[0] for r in rows}:
        v = np.array([r[1] for r in rows if r[0] == g and r[1] is not None and not np.isnan(r[1])])
        out[g] = (len(v), np.percentile(v, [p * 100 for p in PROBS]))
    return out


@pytest.mark.parametrize("parts", ["1", "8", "61"])
def test_grouped(spark, data, parts):
    rows, df = data
    want = expected(rows)
    old = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = exact_percentiles(df, "v", PROBS, by=["g"]).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old[1])
    assert len(got) == len(want)
    for r in got:
        n, q = want[r["g"]]
        assert r["n"] == n
        for i in range(len(PROBS)):
            assert r[f"q{i}"] == pytest.approx(q[i], rel=1e-12, abs=1e-9), (r["g"], PROBS[i])


@pytest.mark.parametrize("kw", [dict(), dict(accuracy=100_000)])
def test_global(spark, data, kw):
    rows, df = data
    v = np.array([r[1] for r in rows if r[1] is not None and not np.isnan(r[1])])
    got = exact_percentiles(df, "v", [0.25, 0.5, 0.75], **kw).collect()[0]
    assert got["n"] == len(v)
    for i, p in enumerate([0.25, 0.5, 0.75]):
        assert got[f"q{i}"] == pytest.approx(np.percentile(v, p * 100), rel=1e-12)


def test_no_null_for_any_size(spark):
    sizes = {"a": 1, "b": 2, "c": 3, "d": 1002, None: 7}
    rows = [(g, float(i)) for g, n in sizes.items() for i in range(n)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r["g"]: r for r in exact_percentiles(df, "v", [0.25, 0.5, 0.75, 0.95], by=["g"]).collect()}
    assert set(got) == set(sizes)
    for g, n in sizes.items():
        want = np.percentile(np.arange(n), [25, 50, 75, 95])
        assert [got[g][f"q{i}"] for i in range(4)] == pytest.approx(want.tolist())


def test_scalar_on_empty_input(spark):
    df = spark.createDataFrame([], "v double")
    got = exact_percentile_scalar(df, "v", [0.5], ["m"]).collect()
    assert len(got) == 1 and got[0]["m"] is None


def test_sketch_only_mode_is_close(spark, data):
    rows, df = data
    want = expected(rows)
    got = exact_percentiles(df, "v", [0.5], by=["g"], exact=False, accuracy=10_000).collect()
    for r in got:
        n, q = want[r["g"]]
        v = np.sort([x[1] for x in rows if x[0] == r["g"] and x[1] is not None and not np.isnan(x[1])])
        # the sketch value is an observed value within rank error n / accuracy of the median
        lo, hi = np.searchsorted(v, r["q0"], side="left"), np.searchsorted(v, r["q0"], side="right")
        err = n / 10_000 + 1
        assert lo - err <= 0.5 * (n - 1) <= hi + err


def test_brackets_hold_every_rank(spark, data):
    """A coarse sketch over groups far larger than its accuracy: values equal numpy's,
    and only a small part of the values is ranked."""
    rows, df = data
    want = expected(rows)
    for r in exact_percentiles(df, "v", PROBS, by=["g"], accuracy=100).collect():
        n, q = want[r["g"]]
        assert r["n"] == n
        assert [r[f"q{i}"] for i in range(len(PROBS))] == pytest.approx(q.tolist(), rel=1e-12, abs=1e-9)
    v = np.array([r[1] for r in rows if r[1] is not None and not np.isnan(r[1])])
    got = exact_percentiles(df, "v", [0.25, 0.5], accuracy=200).first()
    assert [got["q0"], got["q1"]] == pytest.approx(np.percentile(v, [25, 50]).tolist(), rel=1e-12)


def test_planned_without_a_job(spark, data):
    """Two scans, no job while planning, however many probabilities."""
    _, df = data
    before = len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
    q = exact_percentiles(df, "v", PROBS, by=["g"])
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) == before
    assert len(q.collect()) == len(expected(data[0]))


def test_infinite_values(spark):
    df = spark.createDataFrame([(float("-inf"),), (1.0,), (2.0,), (float("inf"),), (float("inf"),)], "v double")
    got = exact_percentiles(df, "v", [0.0, 0.25, 0.5, 1.0]).first()
    assert [got[f"q{i}"] for i in range(4)] == [float("-inf"), 1.0, 2.0, float("inf")]
