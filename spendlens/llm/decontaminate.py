"""Benchmark decontamination with DataFrame functions alone.

Words are the lower-cased runs of non-white-space.  A document is contaminated by
an item if some window of as many words as the item has (the whole document, if
it is shorter) reaches ``similarity`` in weighted-shingle overlap: five-word
shingles (fewer words: the whole sequence) weigh as often as they occur, overlap
is the sum of the smaller weights over the larger total.  For two texts of one
size this is at least their weighted Jaccard similarity, so every window with a
Jaccard similarity of 0.8 is found, and more.

Steps:

1. Anchors.  Every word position of every document carries the hash of its
   shingle; positions whose hash occurs in the benchmark are kept.  A window
   without any such position has overlap 0, so nothing is lost.
2. Windows.  The overlap of a window is at most the number of its anchors over
   the item's number of shingles, and moving a window right up to its next
   anchor loses none; so windows that begin at an anchor (or end with the
   document) and hold enough anchors are all that can reach the threshold.
   A document's anchors per item are one array, bounded by its own length.
3. SimHash.  Every such item-sized window gets a 64-bit fingerprint of its
   weighted shingles.  Multi-index blocks: eight blocks of eight bits; of two
   fingerprints within ``RADIUS`` (below 32) bits some block differs in at most
   three, so each item lists the values within three bits of each of its blocks
   and windows meet them by equality: all pairs within the radius, with
   certainty.  Blocks this wide let most pairs of one length through, so a window
   is asked only about the items whose anchors it holds (step 2: no other item can
   reach the threshold), and the items are part of the key.  At overlap 0.8 the expected distance is 13 bits with a standard
   deviation of 3.2, so the radius of 28 lies 4.6 deviations out.
4. Verification.  Candidates are compared by exact weighted overlap of the
   shingles themselves (as text), not their hashes.

The benchmark's shingles are broadcast while they are at most
``BROADCAST_SHINGLES``, which is checked; beyond, the join shuffles.

Null and empty texts and items hold no words and match nothing; repeated items
are judged one by one, repeated item or document rows count once per id and
text; null ids are left out of the pairs, ``clean`` judges every row; an empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendlens.session import materialize

from .common import numbered

SHINGLE, SIMILARITY, RADIUS = 5, 0.8, 28
BLOCKS, WIDTH = 8, 8
BROADCAST_SHINGLES = 2_000_000


def words(text: str = "text") -> Column:
    return F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"\s+"), lambda w: w != "")


def _shingle_count(n: Column) -> Column:
    return F.greatest(n - (SHINGLE - 1), F.least(n, F.lit(1)))


def _hashes(w: str) -> Column:
    """Shingle hashes of the array column ``w`` by position."""
    parts = ", ".join(f"get({w}, i + {j})" for j in range(SHINGLE))
    return F.expr(f"transform(sequence(0, greatest(size({w}) - {SHINGLE}, 0)), i -> xxhash64({parts}))")


def _shingles(w: Column) -> Column:
    """The shingles of an array of words, as text."""
    last = F.greatest(F.size(w) - SHINGLE, F.lit(0))
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.array_join(F.slice(w, i + 1, SHINGLE), " "))


def _overlap(a: Column, b: Column) -> Column:
    """Weighted overlap of two shingle arrays.  Where one of them has no repeats
    every common shingle weighs 1, else the smaller count."""
    def of(z: Column) -> Column:
        common = F.array_intersect(z["a"], z["b"])
        plain = (F.size(F.array_distinct(z["a"])) == F.size(z["a"])) | (F.size(F.array_distinct(z["b"])) == F.size(z["b"]))
        counted = F.aggregate(common, F.lit(0), lambda n, x: n + F.least(
            F.size(F.filter(z["a"], lambda y: y == x)), F.size(F.filter(z["b"], lambda y: y == x))))
        return F.when(plain, F.size(common)).otherwise(counted) / F.greatest(F.size(z["a"]), F.size(z["b"]))

    return F.transform(F.array(F.struct(a.alias("a"), b.alias("b"))), of)[0]      # bound once, used often


def _fingerprint(hashes: Column) -> Column:
    """SimHash: bit b is 1 where more than half of the hashes have it set."""
    bits = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda b: F.aggregate(
        hashes, F.lit(0), lambda a, h: a + F.getbit(h, b)))
    value = F.aggregate(F.transform(bits, lambda c, b: F.when(c * 2 > F.size(hashes), F.call_function(
        "shiftleft", F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long"))),
        F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x))
    return value


def _block(fp: str, b: Column) -> Column:
    return F.call_function("shiftrightunsigned", F.col(fp), (b * WIDTH).cast("int")).bitwiseAND(F.lit(255)).cast("int")


def items_of(benchmark: DataFrame) -> DataFrame:
    """Items with words: item_id, iw (words), n (words), shingles (number), fp."""
    rows = (benchmark.where(F.col("item_id").isNotNull()).select("item_id", words().alias("iw"))
            .where(F.size("iw") > 0).distinct())
    return materialize(rows.withColumn("n", F.size("iw")).withColumn("shingles", _shingle_count(F.size("iw")))
                       .withColumn("h", _hashes("iw")).withColumn("fp", _fingerprint(F.col("h"))), "decon-items")


def _item_hash() -> Column:
    return F.sha2(F.array_join("iw", " "), 256)


def anchors(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, dn, pos, item row) for every document position whose shingle
    occurs in an item.  Shorter items need shingles of their own length."""
    keys = materialize(items.select("item_id", "iw", "n", "shingles", F.explode("h").alias("k"))
                       .select("item_id", "n", "shingles", _item_hash().alias("ih"), "k")
                       .distinct(), "decon-keys")
    small = keys.count() <= BROADCAST_SHINGLES
    distinct = keys.select("k").distinct()
    short = [r[0] for r in items.where(F.col("n") < SHINGLE).select("n").distinct().collect()]   # at most 4 values
    rows = docs.where(F.col("doc_id").isNotNull()).select("doc_id", words().alias("w")).where(F.size("w") > 0)
    # shorter items: all runs of their number of words, hashed as their one shingle is (missing words are null)
    sizes = [(SHINGLE, _hashes("w"))] + [(n, F.expr(
        f"transform(sequence(0, greatest(size(w) - {n}, 0)), i -> xxhash64("
        + ", ".join(f"get(w, i + {j})" if j < n else "cast(null as string)" for j in range(SHINGLE)) + "))")) for n in short]
    found = None
    for size, hashes in sizes:
        one = rows.select("doc_id", F.size("w").alias("dn"), F.posexplode(hashes).alias("pos", "k"))
        one = one.join(F.broadcast(distinct) if small else distinct, "k", "left_semi")
        one = one.join(F.broadcast(keys) if small else keys, "k").where(
            F.col("n") >= SHINGLE if size == SHINGLE else F.col("n") == size)
        found = one if found is None else found.unionByName(one)
    return found.select("doc_id", "dn", "pos", "item_id", "ih", "n", "shingles")


def contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY,
                 radius: int = RADIUS) -> DataFrame:
    """doc_id, item_id, similarity and word_start of the best window of each
    contaminated (document, item) pair (of equally good windows that begin at an
    anchor, the first)."""
    if radius >= BLOCKS * 4:
        raise ValueError("eight blocks of three bits guarantee a radius below 32 only")
    docs = docs.select("doc_id", "text")
    items = items_of(benchmark)
    marks = (anchors(docs, items).groupBy("doc_id", "dn", "item_id", "ih", "n", "shingles")
             .agg(F.array_sort(F.collect_set("pos")).alias("a")))
    # enough anchors: the one `need - 1` places further must lie in the same window; the
    # window's last shingle starts at start + shingles - 1, or at the document's last one
    need = F.ceil(F.col("shingles") * F.lit(similarity) - F.lit(1e-9)).cast("int")
    starts = F.expr("filter(a, (p, i) -> get(a, i + need - 1) <= p + shingles - 1)")
    clamp = F.transform(starts, lambda p: F.greatest(F.least(p, F.col("dn") - F.col("n")), F.lit(0)))
    spots = materialize(marks.withColumn("need", need).withColumn("starts", F.array_distinct(clamp))
                        .where(F.size("starts") > 0)
                        .select("doc_id", "dn", "n", "item_id", "ih", F.explode("starts").alias("start")).distinct(), "decon-windows")
    # the words of each window; a document's windows travel as one small row, its text once
    wanted = spots.groupBy("doc_id", "dn").agg(F.collect_set(F.struct("start", "n")).alias("spots"))
    texts = (docs.join(materialize(wanted, "decon-wanted"), "doc_id").withColumn("w", words())
             .where(F.size("w") == F.col("dn"))
             .select("doc_id", "w", F.explode("spots").alias("at"))
             .select("doc_id", F.col("at.start").alias("start"), F.col("at.n").alias("n"),
                     F.expr("slice(w, at.start + 1, at.n)").alias("ww")).distinct())
    marked = materialize(texts.withColumn("h", _hashes("ww")).withColumn("fp", _fingerprint(F.col("h"))).drop("h"),
                         "decon-prints")
    numbers = F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1)))
    near = F.expr(f"filter(sequence(0, 255), x -> bit_count(x ^ v) <= {radius // BLOCKS})")
    index = (items.select("item_id", _item_hash().alias("ih"), "iw", "n", F.col("fp").alias("ifp"), numbers.alias("b"))
             .withColumn("v", _block("ifp", F.col("b"))).withColumn("v", F.explode(near)))
    # a window asks only for the items whose anchors it holds: no other can reach the threshold
    probes = (marked.join(spots.select("doc_id", "start", "n", "item_id", "ih").distinct(), ["doc_id", "start", "n"])
              .select("doc_id", "start", "n", "item_id", "ih", "ww", "fp", numbers.alias("b"))
              .withColumn("v", _block("fp", F.col("b"))))
    # a pair may collide in several blocks: the first block whose distance is small
    # enough speaks for it, so that no later distinct is needed
    diff = F.col("fp").bitwiseXOR(F.col("ifp"))
    earlier = F.expr(f"exists(filter(sequence(0, {BLOCKS - 1}), j -> j < b), j -> bit_count("
                     f"shiftrightunsigned(fp ^ ifp, j * {WIDTH}) & 255) <= {radius // BLOCKS})")
    pairs = probes.join(index, ["item_id", "ih", "n", "b", "v"]).where((F.bit_count(diff) <= radius) & ~earlier)
    # written before the costly comparison: it then runs once a pair, in evenly dealt tasks
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = materialize(pairs.select("doc_id", "start", "ww", "item_id", "iw")
                        .repartition(tasks, "doc_id", "start", "item_id"), "decon-pairs")
    exact = (pairs.withColumn("similarity", _overlap(_shingles(F.col("ww")), _shingles(F.col("iw"))))
             .select("doc_id", "item_id", "start", "similarity"))
    best = F.max(F.struct("similarity", (-F.col("start")).alias("s")))
    return (materialize(exact, "decon-exact").where(F.col("similarity") >= F.lit(similarity) - 1e-12)
            .groupBy("doc_id", "item_id").agg(best.alias("m"))
            .select("doc_id", "item_id", F.col("m.similarity").alias("similarity"), (-F.col("m.s")).alias("word_start")))


def clean(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """``docs`` without contaminated documents, row by row, whatever their doc_id."""
    rows, key = numbered(docs)
    found = contaminated(rows.select(F.col(key).alias("doc_id"), "text"), benchmark, similarity, radius)
    bad = materialize(found.select(F.col("doc_id").alias(key)).distinct(), "decon-bad")
    return rows.join(bad, key, "left_anti").drop(key).select(*docs.columns)
