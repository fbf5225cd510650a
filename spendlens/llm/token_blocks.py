"""Token ids in patched frame-of-reference blocks.

``encode`` turns whole texts into ids; ``write`` lays the ids of all documents
in ascending doc_id order into images (byte strings, rows of a Parquet folder);
``read`` gets documents back from the images alone.

Image format (little-endian), one or more whole documents each:

    magic "PFB1" | u32 documents | u32 blocks | u64 ids
    documents x u32     ids of each document (end id included)
    (blocks + 1) x u32  index: byte at which each block starts
    block               u32 minimum | u8 width | u8 bytes per exception | u16 exceptions
                        128 values of ``width`` bits, value = id - minimum, low bits only:
                        a plane of bytes for every whole byte of the width, then a
                        plane of bits for every further bit
                        exceptions x u8 (position), exceptions x high bits

A block holds 128 ids (the last one is filled up with its last id).  The width is the number of bits
that ``PERCENTILE`` percent of the block's values need; a value with more bits
keeps its low bits in place and its high bits in the exception list.  The index
gives random access to any block.

Executors write through Spark's Parquet writer, whose commit protocol survives
lost executors; no task opens a file itself, so any store that Spark reaches
will do.

Null texts are empty and give the end id alone; an empty table gives no rows;
rows with one doc_id keep their own lines, ordered by text; null ids come first;
very long texts fill an image of their own; extra columns are ignored.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spendlens.session import ensure_checkpoint_dir, materialize

from .common import RecentMemory, gathered, per_worker, texts

BLOCK, PERCENTILE, IMAGE_IDS, CACHE = 128, 95, 1 << 18, 450_000
PLANE = BLOCK // 8            # bytes of a plane of bits
BATCH = 4_000_000             # characters that are encoded at a time, about
HEAD = np.dtype([("low", "<u4"), ("width", "u1"), ("wide", "u1"), ("odd", "<u2")])


class WordEncoder:
    """``tokenizers`` ids of whole texts, through a memory of words.

    A word-end tokenizer of the known form (``FORM``) never joins anything across
    white space, so the ids of a text are those of its words in order.  Texts of
    Latin letters are lower-cased and cut at spaces and line feeds in Arrow, each
    distinct word is encoded once, and the ids are gathered.  Words of letters
    alone skip the normaliser, which leaves them as they are.  Texts with other
    scripts or special tokens, and tokenizers of another form, go to the
    tokenizer whole."""

    #: The parts of a tokenizer file that the word memory relies on.
    FORM = {"normalizers": ["NFC", "Replace", "Lowercase"], "suffix": "</w>", "pattern":
            r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}
    OTHER = r"[^\x00-\x{12f}\x{131}-\x{24f}]|<\|"

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.full = Tokenizer.from_file(path)
        spec = json.loads(self.full.to_str())
        self.by_word = {
            "normalizers": [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])],
            "suffix": spec["model"].get("end_of_word_suffix"),
            "pattern": (spec["pre_tokenizer"] or {}).get("pretokenizers", [{}])[0].get("pattern", {}).get("Regex"),
        } == self.FORM
        spaces = pre_tokenizers.Split(" ", "removed")
        self.ascii, self.letters = Tokenizer(self.full.model), Tokenizer(self.full.model)
        self.ascii.pre_tokenizer = spaces                   # a-z stand for themselves among the byte symbols
        self.letters.pre_tokenizer = pre_tokenizers.Sequence([
            spaces, pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        names = self.full.get_vocab()
        self.ends = np.zeros(max(names.values(), default=0) + 1, dtype=bool)
        self.ends[[i for name, i in names.items() if name.endswith("</w>")]] = True
        self.known = RecentMemory(CACHE)

    def _full(self, strings: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes()
                for e in self.full.encode_batch(strings, add_special_tokens=False)]

    def _learn(self, words: list[str]) -> None:
        """Remember words: letters alone, letters and one full stop or comma, others."""
        bare = {w: w if w.isalpha() else w[:-1] if w[-1:] in (".", ",") and w[:-1].isalpha() else None for w in words}
        plain = {b for b in bare.values() if b}
        of: dict[str, bytes] = {}
        for tokenizer, some in ((self.ascii, [w for w in plain if w.isascii()]),
                                (self.letters, [w for w in plain if not w.isascii()])):
            for at in range(0, len(some), 16_384):          # the library's own result objects are large
                part = some[at:at + 16_384]
                ids = [np.array(e.ids, dtype="<u4") for e in tokenizer.encode_batch_fast(
                    [" ".join(part[i:i + 64]) for i in range(0, len(part), 64)], add_special_tokens=False)]
                flat = np.concatenate(ids)
                cuts = [0, *((np.flatnonzero(self.ends[flat]) + 1) * 4).tolist()]
                if len(cuts) != len(part) + 1:
                    raise ValueError("a word of letters did not end in a word-end id")
                raw = flat.tobytes()
                of.update((w, raw[a:b]) for w, a, b in zip(part, cuts, cuts[1:], strict=False))
        odd = [w for w, b in bare.items() if b is None]
        known = self.known
        known.update(zip(odd, self._full(odd), strict=True))
        stop = dict(zip(".,", self._full([".", ","]), strict=True))
        for w, b in bare.items():
            if b is not None:
                known[w] = of[b] if len(b) == len(w) else of[b] + stop[w[-1]]

    def encode(self, many: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, end to end, and the number of each text's ids."""
        n = np.zeros(len(many), dtype=np.int64)
        whole = np.ones(len(many), dtype=bool)
        if self.by_word:
            whole = pc.match_substring_regex(many, self.OTHER).to_numpy(zero_copy_only=False)
        rest = self._full(many.filter(pa.array(whole)).to_pylist())
        n[whole] = [len(b) // 4 for b in rest]
        lines = pc.replace_substring(pc.utf8_lower(many.filter(pa.array(~whole))), "\n", " ")
        cut = pc.split_pattern(lines, " ")
        at = cut.offsets.to_numpy()
        coded = cut.flatten().dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()        # to_pylist takes ten times as long
        known = self.known
        if new := known.missing(distinct):
            self._learn(new)
        ids = list(map(known.__getitem__, distinct))
        flat, ends = gathered(ids, coded.indices.to_numpy())
        n[~whole] = np.diff(ends[at - at[0]])
        if not whole.any():
            return flat, n
        out, first = np.zeros(n.sum(), dtype="<u4"), np.cumsum(n) - n
        kept = np.repeat(~whole, n)
        out[kept] = flat
        for i, b in zip(np.flatnonzero(whole), rest, strict=True):
            out[first[i]:first[i] + n[i]] = np.frombuffer(b, dtype="<u4")
        return out, n


def pack_blocks(ids: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Blocks of an id array, and the byte at which each starts (and the end)."""
    n = -(-len(ids) // BLOCK)
    if not n:
        return b"", np.zeros(1, dtype="<u4")
    padded = np.full(n * BLOCK, ids[-1], dtype=np.uint32)
    padded[:len(ids)] = ids
    v = padded.reshape(n, BLOCK)
    low = v.min(1)
    v = v - low[:, None]
    bits = np.frexp(v.astype(np.float64))[1].astype(np.int64)
    width = np.partition(bits, BLOCK * PERCENTILE // 100 - 1, axis=1)[:, BLOCK * PERCENTILE // 100 - 1]
    odd = bits > width[:, None]
    many = odd.sum(1)
    wide = -(-(bits.max(1) - width) // 8)
    head = np.zeros(n, dtype=HEAD)
    head["low"], head["width"], head["wide"], head["odd"] = low, width, wide, many
    ends = np.cumsum(HEAD.itemsize + PLANE * width + many * (1 + wide))
    starts = np.concatenate(([0], ends))
    out = np.zeros(starts[-1], dtype=np.uint8)
    out[starts[:-1, None] + np.arange(HEAD.itemsize)] = head.view(np.uint8).reshape(n, -1)
    for w in np.unique(width[width > 0]).tolist():
        rows = np.flatnonzero(width == w)
        x = v[rows]
        planes = [(x >> np.uint32(8 * b)).astype(np.uint8) for b in range(w // 8)]
        planes += [np.packbits((x >> np.uint32(b)).astype(np.uint8) & 1, axis=1, bitorder="little")
                   for b in range(w // 8 * 8, w)]
        out[starts[rows][:, None] + HEAD.itemsize + np.arange(PLANE * w)] = np.concatenate(planes, axis=1)
    r, c = np.nonzero(odd)
    rank = np.arange(len(r)) - (np.cumsum(many) - many)[r]
    tail = starts[r] + HEAD.itemsize + PLANE * width[r]
    out[tail + rank] = c
    high = v[r, c].astype(np.uint64) >> width[r].astype(np.uint64)
    for j in range(int(wide.max())):
        at = np.flatnonzero(wide[r] > j)
        out[(tail + many[r] + rank * wide[r] + j)[at]] = (high[at] >> np.uint64(8 * j)) & np.uint64(255)
    return out.tobytes(), starts.astype("<u4")


def unpack_blocks(image: bytes, base: int, starts: np.ndarray) -> np.ndarray:
    """The ids of the blocks that start at ``base + starts[:-1]``."""
    raw, at = np.frombuffer(image, np.uint8), base + starts[:-1].astype(np.int64)
    n = len(at)
    head = np.ascontiguousarray(raw[at[:, None] + np.arange(HEAD.itemsize)]).view(HEAD).ravel()
    width, wide, many = (head[c].astype(np.int64) for c in ("width", "wide", "odd"))
    v = np.zeros((n, BLOCK), dtype=np.uint32)
    for w in np.unique(width[width > 0]).tolist():
        rows = np.flatnonzero(width == w)
        body = raw[at[rows][:, None] + HEAD.itemsize + np.arange(PLANE * w)]
        x, flat = np.zeros((len(rows), BLOCK), dtype=np.uint32), w // 8
        for b in range(flat):
            x |= body[:, BLOCK * b:BLOCK * (b + 1)].astype(np.uint32) << np.uint32(8 * b)
        for b in range(8 * flat, w):
            p = BLOCK * flat + PLANE * (b - 8 * flat)
            x |= np.unpackbits(body[:, p:p + PLANE], axis=1, bitorder="little").astype(np.uint32) << np.uint32(b)
        v[rows] = x
    r = np.repeat(np.arange(n), many)
    rank = np.arange(len(r)) - (np.cumsum(many) - many)[r]
    tail = at[r] + HEAD.itemsize + PLANE * width[r]
    high = np.zeros(len(r), dtype=np.uint64)
    for j in range(int(wide.max(initial=0))):
        on = np.flatnonzero(wide[r] > j)
        high[on] |= raw[(tail + many[r] + rank * wide[r] + j)[on]].astype(np.uint64) << np.uint64(8 * j)
    v[r, raw[tail + rank]] |= (high << width[r].astype(np.uint64)).astype(np.uint32)
    return (v + head["low"][:, None]).ravel().astype("<u4")


def build_image(docs: list[np.ndarray]) -> bytes:
    """One image of whole documents (arrays of u32 ids)."""
    ids = np.concatenate(docs) if docs else np.zeros(0, dtype=np.uint32)
    body, starts = pack_blocks(ids)
    return b"".join([b"PFB1", np.array([len(docs), len(starts) - 1], "<u4").tobytes(), np.array([len(ids)], "<u8").tobytes(),
                     np.array([len(d) for d in docs], "<u4").tobytes(), starts.tobytes(), body])


def open_image(image: bytes) -> tuple[np.ndarray, np.ndarray, int, int]:
    """(ids per document, block starts, byte of the first block, number of ids)."""
    if image[:4] != b"PFB1":
        raise ValueError("not an image of patched blocks")
    docs, blocks = np.frombuffer(image, "<u4", 2, 4).tolist()
    total = int(np.frombuffer(image, "<u8", 1, 12)[0])
    lengths = np.frombuffer(image, "<u4", docs, 20)
    starts = np.frombuffer(image, "<u4", blocks + 1, 20 + 4 * docs)
    return lengths, starts, 20 + 4 * docs + 4 * (blocks + 1), total


def read_ids(image: bytes, first: int, last: int) -> np.ndarray:
    """Ids ``first`` to ``last`` (exclusive) of an image, through its block index."""
    _, starts, base, total = open_image(image)
    last = min(last, total)
    if first >= last:
        return np.zeros(0, dtype="<u4")
    b0, b1 = first // BLOCK, -(-last // BLOCK)
    return unpack_blocks(image, base, starts[b0:b1 + 1])[first - b0 * BLOCK:last - b0 * BLOCK]


def split_image(image: bytes) -> list[np.ndarray]:
    """The documents of an image."""
    lengths, starts, base, total = open_image(image)
    ids = unpack_blocks(image, base, starts)[:total]
    return np.split(ids, np.cumsum(lengths)[:-1]) if len(lengths) else []


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 1) -> None:
    """Encode whole texts and write their images, in ascending doc_id order.

    Texts are range-partitioned on doc_id and a hash of the text before they are
    encoded, so ids are made once, in place, and never shuffled, and no text is
    sampled for the ranges; texts of one doc_id stand in the order of their hashes."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = per_worker(("words", tokenizer), lambda: WordEncoder(tokenizer))
        keys, held, size, image_no = [], [], 0, 0

        def flush(schema: pa.DataType) -> pa.RecordBatch:
            nonlocal size, image_no
            out = pa.RecordBatch.from_arrays(
                [pa.array([image_no], pa.int32()), pa.array([keys], pa.list_(schema)), pa.array([size], pa.int64()),
                 pa.array([build_image(held)], pa.binary())], ["image_no", "doc_ids", "n_ids", "image"])
            keys.clear(), held.clear()
            size, image_no = 0, image_no + 1
            return out

        for batch in batches:
            names = batch.schema.field("doc_id").type
            sizes = np.cumsum(pc.binary_length(batch["text"]).to_numpy(zero_copy_only=False))
            cuts = np.flatnonzero(np.diff(sizes // BATCH, prepend=0)).tolist()
            for a, b in zip([0, *cuts], [*cuts, len(batch)], strict=True):
                if a == b:
                    continue
                flat, n = encoder.encode(batch["text"].slice(a, b - a))
                flat = np.insert(flat, np.cumsum(n), end_id)
                for doc_id, ids in zip(batch["doc_id"].slice(a, b - a).to_pylist(),
                                       np.split(flat, np.cumsum(n + 1)[:-1]), strict=True):
                    if size and size + len(ids) > IMAGE_IDS:
                        yield flush(names)
                    keys.append(doc_id)
                    held.append(ids)
                    size += len(ids)
        if held:
            yield flush(names)

    (texts(docs).withColumn("mark", F.xxhash64("text")).repartitionByRange("doc_id", "mark")
     .sortWithinPartitions("doc_id", "mark", "text").drop("mark")
     .mapInArrow(run, f"image_no int, doc_ids array<{kind}>, n_ids long, image binary")
     .withColumn("shard", F.spark_partition_id())
     .write.mode("overwrite").parquet(folder))


def read(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the images.

    ``start`` adds up in three steps: ids per shard (one row per partition that
    wrote), images within a shard, documents within an image."""
    images = spark.read.parquet(folder)
    kind = dict(images.dtypes)["doc_ids"][6:-1]
    shards = materialize(images.groupBy("shard").agg(F.sum("n_ids").alias("ids")), "blocks-shards")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shard_start = shards.select("shard", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("shard_start"))
    within = Window.partitionBy("shard").orderBy("image_no").rowsBetween(Window.unboundedPreceding, -1)
    starts = (images.select("shard", "image_no", F.coalesce(F.sum("n_ids").over(within), F.lit(0)).alias("image_start"))
              .join(shard_start, "shard")
              .select("shard", "image_no", (F.col("shard_start") + F.col("image_start")).alias("first")))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples(index=False):
                docs = split_image(r.image)
                n = np.array([len(d) for d in docs], dtype=np.int64)
                yield pd.DataFrame({"doc_id": pd.Series(list(r.doc_ids), dtype="object"),
                                    "shard": np.int32(r.shard), "image_no": np.int32(r.image_no),
                                    "start": np.cumsum(n) - n, "n_tokens": n,
                                    "ids_crc32": [zlib.crc32(d.tobytes()) for d in docs]})

    got = images.select("shard", "image_no", "doc_ids", "image").mapInPandas(
        run, f"doc_id {kind}, shard int, image_no int, start long, n_tokens long, ids_crc32 long")
    return (got.join(materialize(starts, "blocks-starts"), ["shard", "image_no"])
            .select("doc_id", (F.col("first") + F.col("start")).alias("start"), "n_tokens", "ids_crc32"))


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = 1) -> DataFrame:
    """Write ``docs`` into a new folder under the shared checkpoint folder and read it back."""
    import uuid

    spark = docs.sparkSession
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/token-blocks-{uuid.uuid4().hex[:12]}"
    write(docs, folder, tokenizer, end_id)
    return read(spark, folder)
