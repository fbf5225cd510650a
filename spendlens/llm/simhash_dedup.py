"""SimHash near-duplicates by covering locality-sensitive hashing.

Fingerprint: 64 bits, a bit is 1 where it is set in over half of the XXH64
values (seed 42) of a text's word shingles.  Two texts link where their
fingerprints differ in at most ``radius`` bits.

Covering masks (Pagh, 2016): bit position ``i`` gets a code ``m(i)`` of
``radius + 1`` bits; the table of a non-zero vector ``v`` keeps the positions
with odd ``<m(i), v>``.  For any ``radius`` differing positions some ``v`` is
orthogonal to all their codes, so that table keeps none of them: every pair
within the radius collides in some table, with certainty.

Inside a bucket pairs are never listed.  Fingerprints of a bucket differ only
in the positions its table leaves out; each stands for the balls of radius
``ceil(radius / 2)`` and ``floor(radius / 2)`` around it, and those that share
a ball value are tied to the smallest among them - a row per member instead of
a row per pair.  For radius 2: two fingerprints within 2 bits share a value one
flip away from each, and any two that share one are within 2 bits, so the
components are exact for groups of any size.

Exact copies share a fingerprint and meet once, as one row.  Null and empty
texts have fingerprint zero and link like any other; repeated doc_ids are one
node; null doc_ids stay in the result with the component of their fingerprint;
extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendlens.session import materialize

from .common import release, small_batches, texts
from .components import components

BITS, SEED = 64, 42


def fingerprint(text: str, shingle: int = 3) -> int:
    """The 64-bit fingerprint of one text (0 without words)."""
    words = text.encode("utf-8", "surrogatepass").lower().split()      # bytes: A-Z, ASCII white space
    if not words:
        return 0
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    joined = b" ".join(words)
    if len(words) <= shingle:
        pieces = [joined]
    else:
        starts = np.concatenate(([0], ends[:len(words) - shingle] + 1)).tolist()
        pieces = [joined[s:e] for s, e in zip(starts, ends[shingle - 1:].tolist(), strict=True)]
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(p, SEED) for p in pieces), dtype=">u8", count=len(pieces))
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(h), 4096):
        ones += np.unpackbits(h[at:at + 4096].view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(h)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp) with fp as a signed long, for whole texts."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        release()
        for frame in small_batches(frames):
            fp = np.array([fingerprint(t, shingle) for t in frame["text"]], dtype=np.uint64).view(np.int64)
            yield pd.DataFrame({"doc_id": frame["doc_id"], "fp": fp})

    return texts(docs).mapInPandas(run, f"doc_id {dict(docs.dtypes)['doc_id']}, fp long")


def masks(radius: int) -> list[int]:
    """The 2^(radius+1) - 1 covering masks."""
    codes = [i % (2 ** (radius + 1) - 1) + 1 for i in range(BITS)]
    return [sum(1 << i for i, m in enumerate(codes) if (m & v).bit_count() % 2)
            for v in range(1, 2 ** (radius + 1))]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _flips(mask: int, depth: int) -> list[int]:
    """XOR patterns of up to ``depth`` positions that the mask leaves out."""
    free = [1 << i for i in range(BITS) if not mask >> i & 1]
    out = [0]
    for _ in range(depth):
        out = sorted({x | f for x in out for f in free} | set(out))
    return [_signed(x) for x in out]


def links(fps: DataFrame, radius: int = 2) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column fp) whose components
    are those of "differ in at most ``radius`` bits"."""
    if radius % 2:
        raise ValueError("the ball argument needs an even radius")
    tables = masks(radius)
    keys = F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key"))
                               for t, m in enumerate(tables)]))
    hashed = fps.select("fp", keys.alias("k")).select("fp", "k.t", "k.key")
    shared = (hashed.groupBy("t", "key").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi"))
              .where("lo != hi").select("t", "key"))
    shared = materialize(shared, "simhash-buckets")        # so that AQE can split a hot bucket of the join
    members = materialize(hashed.join(shared, ["t", "key"], "left_semi").select("t", "fp"), "simhash-members")
    flips: Column = F.array(*[F.array(*[F.lit(x) for x in _flips(m, radius // 2)]) for m in tables])
    balls = (members.select("t", "fp", F.explode(F.element_at(flips, F.col("t") + 1)).alias("x"))
             .select("t", "fp", F.col("fp").bitwiseXOR(F.col("x")).alias("ball")))
    centre = (balls.groupBy("t", "ball").agg(F.min("fp").alias("c"), F.max("fp").alias("hi"))
              .where("c != hi").select("t", "ball", "c"))
    centre = materialize(centre, "simhash-centres")
    return (balls.join(centre, ["t", "ball"])
            .where((F.col("fp") != F.col("c")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("c"))) <= radius))
            .select(F.col("fp").alias("a"), F.col("c").alias("b")).distinct())


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 2) -> DataFrame:
    """doc_id, fp and component_id (smallest doc_id reachable over links)."""
    marked = materialize(fingerprints(docs, shingle), "simhash-fp")
    distinct = marked.groupBy("fp").agg(F.min("doc_id").alias("least"))
    # the same doc_id may occur with several texts: its fingerprints are one node
    twice = (marked.where(F.col("doc_id").isNotNull()).groupBy("doc_id")
             .agg(F.min("fp").alias("a"), F.max("fp").alias("b")).where("a != b").select("doc_id", "a"))
    same_id = marked.join(twice, "doc_id").where("fp != a").select(F.col("fp").alias("b"), "a")
    groups = components(links(distinct.select("fp"), radius).unionByName(same_id))
    rep = distinct.join(groups, F.col("fp") == F.col("node"), "left")
    named = materialize(rep.select("fp", "least", F.coalesce("component", "fp").alias("g")), "simhash-groups")
    least = materialize(named.groupBy("g").agg(F.min("least").alias("component_id")), "simhash-least")
    of = materialize(named.join(least, "g").select("fp", "component_id"), "simhash-named")
    return marked.join(of, "fp").select("doc_id", "fp", "component_id")
