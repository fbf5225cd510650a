"""Suffix-array dedup: bytes covered by a string of ``WIDTH`` bytes that also starts
elsewhere, found by a radix sort of suffixes that goes no deeper than ``WIDTH``.

A suffix matters through its first ``WIDTH`` bytes only (its window).  Suffixes
travel in bundles: each window is given to its anchor, the place of its smallest
``GRAM``-byte hash (ties: leftmost), which depends on the window's bytes alone, so
equal windows have equal distances to their anchors; neighbouring windows share an
anchor and one row stands for about a hundred suffixes.

A bundle holds the windows at distances ``a`` to ``b`` from one anchor.  Its digit is
what all of them have in common, the bytes from ``x - a`` to ``x - b + WIDTH``; its
reach is all that any of them holds.  Most significant digit first:

1. bundles of half the distances are dealt by their digit (at least 208 bytes).  A
   bundle alone in its group holds no repeated window and drops out.  Where the reach
   of all bundles of a group is the same, all their windows are repeated.
2. of each different reach in the other groups one bundle goes on.  It is cut into
   finer bundles with longer digits, and these are dealt again (``CUTS``), until a
   bundle is one window and its digit the whole string: equal groups are then exactly
   the repeated windows.

Groups are only counted and compared by least and greatest reach, in partial
aggregates, so a passage of any number of documents meets in no task.  Digit and
reach are told apart by 64-bit hashes of different seeds; windows count as equal
where both agree.  Bundles that agree inside one batch of texts are settled there
and send one row on, so runs of one letter cost no row per letter.

Null texts are empty; texts shorter than ``WIDTH`` keep all bytes; rows that repeat
a text, with equal or other ids, are copies of each other, and none of their bytes
stay where the text has ``WIDTH`` bytes or more; null ids stay in the result; texts
of any length are read in pieces of ``PIECE`` bytes; an empty table gives no rows;
further columns are left behind.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendlens.session import materialize

from .common import small_transfers

WIDTH, GRAM = 400, 16
REACH = WIDTH - GRAM + 1                    # distances that a window can have to its anchor
HALF = -(-REACH // 2)
CUTS = (28, 4, 1)                           # distances of a bundle in the later passes
PIECE = 1 << 20
PLACE = np.uint64((1 << 22) - 1)            # low bits of an anchor's key: its place

BUNDLE = "key binary, x int, lo int, hi int, digit long, reach long, many boolean, done boolean"


def anchors(data: bytes) -> np.ndarray:
    """For every start of a window in ``data``, the place of its anchor."""
    n = len(data) - GRAM + 1
    words = np.empty(n + 8, dtype=np.uint64)
    padded = data + bytes(16)
    for r in range(8):
        part = words[r::8]
        part[:] = np.frombuffer(padded, dtype="<u8", offset=r, count=len(part))
    h = words[:n] * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(31)
    h += words[8:]
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h = (h & ~PLACE) | np.arange(n, dtype=np.uint64)
    full = -(-n // REACH) * REACH
    rows = np.concatenate((h, np.full(full - n, np.iinfo(np.uint64).max, dtype=np.uint64))).reshape(-1, REACH)
    ahead = np.minimum.accumulate(rows, axis=1).reshape(-1)
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    starts = n - REACH + 1
    return (np.minimum(back[:starts], ahead[REACH - 1:REACH - 1 + starts]) & PLACE).astype(np.int64)


def bundles(pieces: list[tuple[int, int, bytes]]) -> tuple[np.ndarray, ...]:
    """Of pieces (owner, first byte's place in the text, bytes): owner, place x of the
    anchor in the text, least and greatest distance, digit and reach of each bundle."""
    data = b"".join(p[2] for p in pieces)
    size = np.array([len(p[2]) for p in pieces], dtype=np.int64)
    empty = np.zeros(0, dtype=np.int64)
    if len(data) < WIDTH:
        return (empty,) * 6
    at = anchors(data)
    first = np.cumsum(size) - size
    piece = np.repeat(np.arange(len(pieces)), size)[:len(at)]
    inside = np.flatnonzero(np.arange(len(at)) + WIDTH <= (first + size)[piece])
    if not len(inside):
        return (empty,) * 6
    of, x = piece[inside], at[inside]
    new = np.flatnonzero(np.concatenate(([True], (x[1:] != x[:-1]) | (of[1:] != of[:-1]))))
    last = np.concatenate((new[1:], [len(inside)])) - 1
    x, of, near, far = x[new], of[new], x[new] - inside[last], x[new] - inside[new]
    out = []
    for a, b in ((0, HALF - 1), (HALF, REACH - 1)):
        some = np.flatnonzero((near <= b) & (far >= a))
        out.append((some, np.maximum(near[some], a), np.minimum(far[some], b), np.full(len(some), a), np.full(len(some), b)))
    some, lo, hi, a, b = (np.concatenate(c) for c in zip(*out, strict=True))
    x, of = x[some], of[some]
    view, code = memoryview(data), xxhash.xxh3_64_intdigest
    spans = [np.stack((x - a, x - b + WIDTH), 1).tolist(), np.stack((x - hi, x - lo + WIDTH), 1).tolist()]
    digit, reach = (np.fromiter((code(view[s:e], seed) for s, e in part), dtype=np.uint64, count=len(part)).view(np.int64)
                    for seed, part in zip((1, 2), spans, strict=True))
    start = np.array([p[1] for p in pieces], dtype=np.int64)
    owner = np.array([p[0] for p in pieces], dtype=np.int64)
    return owner[of], x - first[of] + start[of], lo, hi, digit, reach


def _settled(frame: pd.DataFrame, keys: np.ndarray) -> Iterator[pd.DataFrame]:
    """Bundles that agree with another of the batch are done; one of each goes on
    for all (``many``); runs of done windows are joined."""
    twice = frame.duplicated(["digit", "reach"], keep=False)
    same = frame[twice]
    on = pd.concat([frame[~twice], same.drop_duplicates(["digit", "reach"])])
    yield on.drop(columns="owner").assign(key=keys[on["owner"]], many=twice[on.index], done=False)
    if not len(same):
        return
    runs = pd.DataFrame({"owner": same["owner"], "s": same["x"] - same["hi"], "e": same["x"] - same["lo"]}).sort_values(["owner", "s"])
    most = runs.groupby("owner")["e"].cummax().shift(fill_value=-1)
    new = (runs["owner"] != runs["owner"].shift(fill_value=-1)) | (runs["s"] > most + 1)
    got = runs.groupby(new.cumsum()).agg(owner=("owner", "first"), s=("s", "min"), e=("e", "max"))
    # a done row: windows that start from x - hi to x - lo
    yield pd.DataFrame({"key": keys[got["owner"]], "done": True, "x": got["e"], "lo": 0, "hi": got["e"] - got["s"], "digit": 0, "reach": 0, "many": True})


def _first(docs: DataFrame) -> DataFrame:
    """The bundles of all texts (key, data)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in BUNDLE.split(", ")]
        for frame in frames:
            keys = np.array([*frame["key"], None], dtype=object)[:-1]
            held, pieces, total = [], [], 0
            for i, data in enumerate(frame["data"]):
                for at in range(0, max(len(data) - WIDTH + 1, 0), PIECE):
                    pieces.append((i, at, data[at:at + PIECE + WIDTH - 1]))
                    total += len(pieces[-1][2])
                    if total >= PIECE:
                        held.append(bundles(pieces))
                        pieces, total = [], 0
            held.append(bundles(pieces))
            columns = [np.concatenate(c) for c in zip(*held, strict=True)]
            rows = pd.DataFrame(dict(zip(("owner", "x", "lo", "hi", "digit", "reach"), columns, strict=True)))
            for part in _settled(rows, keys):
                yield part[names]

    return docs.mapInPandas(run, BUNDLE)


def _grouped(rows: DataFrame, by: list[str], mark: str) -> DataFrame:
    """Rows whose digit other bundles have too, with ``pure``: all agree in reach."""
    groups = (rows.groupBy(*by).agg(F.min(mark).alias("m0"), F.max(mark).alias("m1"), F.max("many").alias("some"),
                                    F.min("reach").alias("r0"), F.max("reach").alias("r1"))
              .where("m0 != m1 or some").select(*by, (F.col("r0") == F.col("r1")).alias("pure")))
    return rows.join(materialize(groups, "repeats-groups"), by)


def _finer(rows: DataFrame, whole: DataFrame, size: int) -> DataFrame:
    """The bundles of ``size`` distances of the given ones (id, a, b: distances)."""
    cut = rows.select("id", F.explode(F.sequence("a", F.greatest("a", "b"), F.lit(size))).alias("a"),
                      F.col("b").alias("top"))
    cut = cut.select("id", "a", F.least(F.col("a") + size - 1, F.col("top")).alias("b")).join(whole, "id")
    cut = cut.where("a <= hi and b >= lo").withColumns({"near": F.greatest("lo", "a"), "far": F.least("hi", "b")})
    part = lambda s, e: F.substring("data", F.col("hi") - s + 1, s - e + WIDTH)     # noqa: E731
    return cut.select("id", "many", "a", "b", "near", "far",
                      F.xxhash64(F.lit(3), part(F.col("a"), F.col("b"))).alias("digit"),
                      F.xxhash64(F.lit(4), part(F.col("far"), F.col("near"))).alias("reach"))


def repeated_starts(docs: DataFrame) -> DataFrame:
    """(key, s, e): windows of the text of ``key`` that start from ``s`` to ``e`` also
    start elsewhere.  ``docs``: key, data (bytes); rows of one key are equal."""
    all_ = materialize(_first(docs), "repeats-bundles")
    starts = ["key", (F.col("x") - F.col("hi")).alias("s"), (F.col("x") - F.col("lo")).alias("e")]
    done = all_.where("done").select(*starts)
    rows = all_.where("not done").drop("done")
    groups = (rows.groupBy("digit").agg(F.count("*").alias("n"), F.max("many").alias("some"),
                                        F.min("reach").alias("r0"), F.max("reach").alias("r1")).where("n > 1 or some")
              .select("digit", (F.col("r0") == F.col("r1")).alias("pure")))
    met = materialize(rows.join(materialize(groups, "repeats-groups"), "digit"), "repeats-met")
    done = done.unionByName(met.where("pure").select(*starts))
    mixed = met.where("not pure").drop("pure")
    kinds = (mixed.groupBy("digit", "reach")
             .agg(F.count("*").alias("n"), F.max("many").alias("some"), F.min(F.struct("key", "x", "lo", "hi")).alias("one")))
    kinds = materialize(kinds.select("digit", "reach", "one", (F.col("some") | (F.col("n") > 1)).alias("many")), "repeats-kinds")
    many = mixed.join(kinds.where("many").select("digit", "reach"), ["digit", "reach"], "left_semi")
    done = done.unionByName(many.select(*starts))
    # one bundle of each reach goes on, with its bytes
    asked = (kinds.groupBy("one.key")
             .agg(F.collect_list(F.struct("one.x", "one.lo", "one.hi", "many", "digit", "reach")).alias("asked")))
    cut = lambda p: F.struct("key", *[p[c].alias(c) for c in ("x", "lo", "hi", "many", "digit", "reach")],      # noqa: E731
                             F.substring("data", p["x"] - p["hi"] + 1, p["hi"] - p["lo"] + WIDTH).alias("data"))
    whole = docs.join(asked, "key").select(F.inline(F.transform("asked", cut)))
    name = F.concat(*[F.lpad(F.hex(c), 16, "0") for c in ("digit", "reach")])
    whole = materialize(whole.select(F.unhex(name).alias("id"), "key", "x", "lo", "hi", "many", "data"), "repeats-reaches")
    first = F.when(F.col("lo") < HALF, 0).otherwise(HALF)
    now = whole.select("id", first.alias("a"), F.when(F.col("lo") < HALF, HALF - 1).otherwise(REACH - 1).alias("b"))
    for size in CUTS:
        cut = materialize(_finer(now.distinct(), whole.select("id", "lo", "hi", "many", "data"), size), "repeats-finer")
        got = materialize(_grouped(cut, ["digit", "reach"] if size == 1 else ["digit"], "id"), "repeats-met")
        single = whole.where("not many").select("id", "key", "x")
        done = done.unionByName(got.where("pure and not many").select("id", "near", "far").distinct().join(single, "id")
                                .select("key", (F.col("x") - F.col("far")).alias("s"), (F.col("x") - F.col("near")).alias("e")))
        now = got.where("not pure").select("id", "a", "b")
    return done


def _key(docs: DataFrame) -> Column:
    """Sixteen bytes that name a row by its id and text."""
    return F.unhex(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit(":"), F.col("text"))))


def cleaned(docs: DataFrame) -> DataFrame:
    """doc_id, data (the bytes that stay), n_bytes, n_removed, n_spans of every row."""
    kind = dict(docs.dtypes)["doc_id"]
    texts = small_transfers(docs).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    named = texts.select("doc_id", _key(texts).alias("key"), F.col("text").cast("binary").alias("data"))
    found = repeated_starts(named.where(F.octet_length("data") >= WIDTH).select("key", "data"))
    spans = found.groupBy("key").agg(F.collect_set(F.struct("s", "e")).alias("spans"))
    of = named.join(materialize(spans, "repeats-spans"), "key", "left")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for data, some in zip(frame["data"], frame["spans"], strict=True):
                kept, at, runs, gone = [], 0, 0, 0
                for s, e in sorted((r["s"], r["e"] + WIDTH) for r in some) if some is not None else ():
                    if s > at or not runs:
                        kept.append(data[at:s])
                        runs += 1
                        gone += e - s
                    else:
                        gone += max(0, e - at)
                    at = max(at, e)
                out.append((b"".join([*kept, data[at:]]), len(data), gone, runs))
            done = pd.DataFrame(out, columns=["data", "n_bytes", "n_removed", "n_spans"])
            done.insert(0, "doc_id", frame["doc_id"].to_numpy())
            yield done

    return of.select("doc_id", "data", "spans").mapInPandas(
        run, f"doc_id {kind}, data binary, n_bytes long, n_removed long, n_spans long")
