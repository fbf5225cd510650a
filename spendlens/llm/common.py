"""Helpers shared by the training-data operators."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from types import ModuleType
from typing import TypeVar

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spendlens.session import materialize

T = TypeVar("T")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


#: Rows that Spark hands to a Python task at a time: texts are long, and the
#: session's default of 10,000 would hold tens of megabytes several times over.
ARROW_ROWS = 1_000


def small_transfers(df: DataFrame) -> DataFrame:
    """``df``, with the session's Arrow batches held to ``ARROW_ROWS`` rows."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= ARROW_ROWS:
        conf.set(name, str(ARROW_ROWS))
    return df


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """``doc_id`` and ``text`` (null read as empty) and the named columns; any
    other column of the input, whatever its name, is left behind."""
    small_transfers(docs)
    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a number of its own for every row - doc_id may be null or repeated -
    written once, so that every later reader sees the same numbers; and the name of
    that column, which no column of ``docs`` has."""
    name = "_row_key"
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    return materialize(docs.withColumn(name, F.monotonically_increasing_id()), "numbered-rows"), name


def id_mod(column: str, n: int) -> Column:
    """crc32 of the id written as text, modulo n (null ids: 0)."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % n, F.lit(0))


def hash_sample(rows: DataFrame, stratum: str, per_stratum: int, seed: int = 7) -> DataFrame:
    """About ``per_stratum`` rows of each value of ``stratum``, chosen by a hash of
    the whole row, so rows that share an id (or have none) are drawn one by one.

    One counting job (a value per stratum reaches the driver) turns the bound
    into a hash threshold per stratum; the sample itself is a plain filter, so
    no stratum is shuffled or sorted however large it is.  Values of
    ``stratum`` must be few (languages, label values).  Rows that are equal in all
    columns come together; should so many come that the sample is over four times
    its bound, it is cut there.
    """
    counts = {r[0]: r[1] for r in rows.groupBy(stratum).count().collect() if r[0] is not None}
    u = F.pmod(F.xxhash64(*[F.col(c) for c in rows.columns], F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    keep = F.lit(False)
    for value, n in sorted(counts.items(), key=lambda kv: str(kv[0])):
        keep = keep | ((F.col(stratum) == F.lit(value)) & (u < F.lit(per_stratum / n)))
    picked, most = rows.where(keep), 4 * per_stratum * max(len(counts), 1)
    return picked.limit(most) if picked.select(F.lit(1)).limit(most + 1).count() > most else picked


def small_batches(frames: Iterator[pd.DataFrame], chars: int = 4_000_000,
                  column: str = "text") -> Iterator[pd.DataFrame]:
    """Cut Arrow batches where their texts add up to about ``chars``, so the
    Python-side arrays stay small beside very long texts."""
    for frame in frames:
        if not len(frame):
            continue
        part = (frame[column].str.len().fillna(0).cumsum().to_numpy(dtype=np.int64)) // chars
        for cut in np.split(np.arange(len(frame)), np.flatnonzero(np.diff(part)) + 1):
            yield frame.iloc[cut[0]:cut[-1] + 1]


def per_worker(key: tuple, make: Callable[[], T]) -> T:
    """The object of ``key`` in this Python worker, made at its first use: Spark
    reuses workers, so large read-only tables are loaded once, not once a task.
    Those of other operators (another ``key[0]``) go first."""
    box = _worker_box()
    if key not in box:
        release(key[0])
        box[key] = make()
    return box[key]


def _worker_box() -> dict:
    return sys.modules.setdefault("spendlens_worker_box", ModuleType("spendlens_worker_box")).__dict__


def release(keep: str = "") -> None:
    """Drop what ``per_worker`` holds for operators other than ``keep``.  Tasks that need
    none of it begin with this: the worker was perhaps left by another operator of a
    pipeline, whose tables and remembered words would lie beside their texts."""
    box = _worker_box()
    for key in [k for k in box if isinstance(k, tuple) and k[0] != keep]:
        del box[key]


class RecentMemory(dict):
    """A dict that forgets what was not asked for among the last ``most`` to
    ``2 * most`` distinct keys: two generations, the older one dropped when the
    younger is full."""

    def __init__(self, most: int):
        self.most, self.old = most, {}

    def __missing__(self, key):
        value = self[key] = self.old[key]
        return value

    def missing(self, keys) -> list:
        """The keys that are in neither generation; room is made for the others."""
        if len(self) > self.most:
            self.old = dict(self)
            self.clear()
        return [k for k in keys if k not in self and k not in self.old]


def gathered(ids: list[bytes], word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids (little-endian u32 bytes by distinct word) of a row of words given by
    number, end to end, and where each word's begin (and the end)."""
    pool = np.frombuffer(b"".join(ids), dtype="<u4")
    size = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // 4
    per_word = size[word]
    ends = np.concatenate(([0], np.cumsum(per_word)))
    return pool[np.repeat((np.cumsum(size) - size)[word] - ends[:-1], per_word) + np.arange(ends[-1])], ends


def codepoints(text: str) -> np.ndarray:
    """The code points of a text as uint32."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
