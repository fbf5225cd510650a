"""Phrase collocations, counted in HAT-tries.

Tasks turn texts into word ids and count the runs of ``k`` words of a piece in a
HAT-trie: a shallow trie over word ids whose leaves are hash containers.  A
container holds a range of first words; when it is full it bursts at a word
border, and one that holds a single first word bursts by the second word.  When a
task's tries hold more than ``ENTRIES`` counts, whole subtrees - those that have
merged least - leave as sorted runs, one row for each prefix partition (a hash of
the first two words), so that memory is bounded whatever the vocabulary.

All runs of a prefix partition are merged in one task; the number of partitions
follows the bytes of the texts, so a partition stays small, and a very common word
is spread by its second word.  Only phrases of ``least`` occurrences or more leave
the merge.

Words are counted first, then pairs, then triples: a phrase occurs no more often
than its parts, so only phrases whose parts are frequent are counted.  Tasks ask a
Bloom filter of the frequent parts, of at most ``2 ** FILTER_BITS`` bits; it never
says no to one, and where it is too small for its parts it only saves less.
Scores are joins and partial aggregates over the frequent phrases.

Null texts are empty, null languages are ``und``; phrases never cross a piece or a
text; repeated rows count each time; texts of any length are read in parts that
end between pieces; ties are ordered as the query states; an empty table gives no
rows; doc_id and further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendlens.operators.ranks import placed
from spendlens.session import forget, materialize

from .common import small_transfers

LONGEST = 3
BITS = 21                                   # of a word id; three fit into a signed long
BURST = 16_384                              # counts of a container
ENTRIES = 300_000                           # counts of a task's tries
WORDS = 250_000                             # word ids of a task between two starts
PART = 2_000_000                            # bytes of text counted at a time
SHARE = 8_000_000                           # bytes of text for each merging task
PREFIXES = 4                                # prefix partitions of a merging task, so that tasks are even
FILTER_BITS = 26                            # at most 8 MB go to a task

_TO = bytearray(range(256))
_TO[65:91] = bytes(range(97, 123))          # A-Z
_TO[9] = 32
for _c in b".,;:!?\n\x0b\x0c\r":
    _TO[_c] = 10
FOLD = bytes(_TO)


class HatTrie:
    """Counts of packed phrases (first word highest): containers by range."""

    def __init__(self) -> None:
        self.low, self.held, self.seen = [0], [{}], [0]     # least key, counts and additions of each container

    def __len__(self) -> int:
        return sum(map(len, self.held))

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        """Add counts of ascending distinct keys."""
        cuts = [*np.searchsorted(keys, np.array(self.low[1:], dtype=np.int64)).tolist(), len(keys)]
        at, full = 0, []
        for i, end in enumerate(cuts):
            if end > at:
                box = self.held[i]
                get = box.get
                box.update([(k, n + get(k, 0)) for k, n in zip(keys[at:end].tolist(), counts[at:end].tolist(), strict=True)])
                self.seen[i] += end - at
                if len(box) > BURST:
                    full.append(i)
                at = end
        for i in reversed(full):
            self._burst(i)

    def _burst(self, i: int) -> None:
        """Cut a container at word borders until its parts fit; one that holds a
        single pair of first words stays as it is."""
        todo, done = [np.sort(np.fromiter(self.held[i], dtype=np.int64, count=len(self.held[i])))], []
        while todo:
            keys = todo.pop()
            for shift in (2 * BITS, BITS):
                heads = keys >> shift
                new = np.flatnonzero(heads[1:] != heads[:-1]) + 1
                if len(keys) > BURST and len(new):
                    cut = new[np.argmin(abs(new - len(keys) // 2))]
                    todo += [keys[cut:], keys[:cut]]        # ascending order comes out first
                    break
            else:
                done.append(keys)
        box, rate = self.held[i], self.seen[i] / len(self.held[i])
        self.low[i:i + 1] = [self.low[i], *[int(k[0]) for k in done[1:]]]
        self.held[i:i + 1] = [{k: box[k] for k in keys.tolist()} for keys in done]
        self.seen[i:i + 1] = [rate * len(keys) for keys in done]

    def leave(self, most: int) -> tuple[np.ndarray, np.ndarray]:
        """Take whole subtrees out, least merged first, until ``most`` counts stay;
        ascending keys and their counts."""
        rate = [s / max(len(b), 1) for s, b in zip(self.seen, self.held, strict=True)]
        out, left = {}, len(self)
        for i in sorted(range(len(rate)), key=rate.__getitem__):
            if left <= most:
                break
            left -= len(self.held[i])
            out.update(self.held[i])
            self.held[i], self.seen[i] = {}, 0
        keys = np.fromiter(out, dtype=np.int64, count=len(out))
        order = np.argsort(keys)
        return keys[order], np.fromiter(out.values(), dtype=np.int64, count=len(out))[order]


def _strings(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    offsets = np.concatenate(([0], ends)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def words_of(text: bytes) -> tuple[pa.Array, np.ndarray]:
    """The words of a text, and the number of the piece of each."""
    data = np.frombuffer(text.translate(FOLD), dtype=np.uint8)
    space, cut = data <= 32, data == 10
    space &= (data == 32) | cut                             # other control characters belong to words
    inside = ~space
    last = np.flatnonzero(inside & np.concatenate((space[1:], [True])))
    ends = np.cumsum(inside)[last]
    return _strings(data[inside], ends), np.cumsum(cut)[last]


def codes(words: list[np.ndarray], lang: str) -> np.ndarray:
    """A 64-bit code for each phrase, from the hashes of its words in order."""
    out = np.full(len(words[0]), xxhash.xxh3_64_intdigest(lang.encode()), dtype=np.uint64)
    for h in words:
        out = (out * np.uint64(0x9E3779B97F4A7C15) + h) * np.uint64(0xD6E8FEB86659FD93)
        out ^= out >> np.uint64(32)
    return out


class Bloom:
    """Two bits for each code; ``cells`` are 64 bits each."""

    def __init__(self, cells: np.ndarray) -> None:
        self.cells, self.mask = cells, np.uint64(len(cells) * 64 - 1)

    def __contains__(self, code: int) -> bool:
        return bool(self.has(np.array([code], dtype=np.uint64))[0])

    def has(self, code: np.ndarray) -> np.ndarray:
        out = np.ones(len(code), dtype=bool)
        for place in (code & self.mask, code >> np.uint64(32) & self.mask):
            out &= (self.cells[place >> np.uint64(6)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)
        return out


def bloom(known: DataFrame) -> Bloom:
    """The filter of a column ``code``: 16 bits a code, up to ``2 ** FILTER_BITS``."""
    bits = 1 << min(FILTER_BITS, max(12, (16 * known.count()).bit_length()))
    places = F.array(F.col("code").bitwiseAND(F.lit(bits - 1)), F.shiftrightunsigned("code", 32).bitwiseAND(F.lit(bits - 1)))
    got = (known.select(F.explode(places).alias("p")).groupBy(F.shiftright("p", 6).alias("cell"))
           .agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("bits"))).toPandas()
    cells = np.zeros(bits // 64, dtype=np.uint64)
    cells[got["cell"].to_numpy(dtype=np.int64)] = got["bits"].to_numpy(dtype=np.int64).view(np.uint64)
    return Bloom(cells)


class Counter:
    """Word ids and a trie for each language of one task, for phrases of ``k`` words."""

    def __init__(self, partitions: int, k: int, parts: Bloom | None = None) -> None:
        self.partitions, self.k, self.parts, self.tries = partitions, k, parts, {}
        self.start()

    def start(self) -> None:
        self.ids, self.names, self.hashes = {}, [b""], [0]

    def add(self, lang: str, text: bytes) -> Iterator[dict]:
        words, piece = words_of(text)
        if len(words) < self.k:
            return
        coded = words.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        if len(self.names) + len(distinct) > WORDS and len(self.names) > 1:
            yield from self.flush()
            self.start()
        ids, names = self.ids, self.names
        new = [w for w in distinct if w not in ids]
        ids.update(zip(new, range(len(names), len(names) + len(new)), strict=True))
        names += new
        self.hashes += [xxhash.xxh3_64_intdigest(w) for w in new]
        number = np.array([ids[x] for x in distinct], dtype=np.int64)
        at = coded.indices.to_numpy()
        k, n = self.k, len(at) - self.k + 1
        w = number[at]
        keep = piece[k - 1:] == piece[:n]
        if self.parts is not None:                          # both parts of k - 1 words are frequent
            h = np.array(self.hashes, dtype=np.uint64)[w]
            part = self.parts.has(codes([h[i:len(h) - k + 2 + i] for i in range(k - 1)], lang))
            keep &= part[:n] & part[1:n + 1]
        key = np.zeros(n, dtype=np.int64)
        for i in range(k):
            key |= w[i:n + i] << (BITS * (LONGEST - 1 - i))
        keys, counts = np.unique(key[keep], return_counts=True)
        trie = self.tries.setdefault(lang, HatTrie())
        for i in range(0, len(keys), ENTRIES):
            trie.add(keys[i:i + ENTRIES], counts[i:i + ENTRIES])
            if sum(map(len, self.tries.values())) > ENTRIES:
                yield from self.flush(ENTRIES // 2)

    def flush(self, most: int = 0) -> Iterator[dict]:
        """Runs of what leaves the tries, ordered by their words: a row for each language
        and partition."""
        total = sum(map(len, self.tries.values()))
        out = {lang: trie.leave(most * len(trie) // max(total, 1)) for lang, trie in self.tries.items()}
        if not most:
            self.tries = {}
        out = {lang: x for lang, x in out.items() if len(x[0])}
        if not out:
            return
        hashes, order = np.array(self.hashes, dtype=np.uint64), np.argsort(np.array(self.names, dtype=object), kind="stable")
        names = pa.array(self.names, pa.binary()).take(pa.array(order))
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = np.arange(len(order))
        for lang, (keys, counts) in out.items():
            ids = [keys >> (BITS * (LONGEST - 1 - i)) & (1 << BITS) - 1 for i in range(self.k)]
            prefix = codes([hashes[i] for i in ids[:2]], lang)
            part = ((prefix >> np.uint64(33)) % np.uint64(self.partitions)).astype(np.int64)
            ranks = [rank[i] for i in ids]
            sort = np.lexsort((*ranks[::-1], part))
            part, counts = part[sort], counts[sort].astype("<i8")
            columns = [names.take(pa.array(r[sort])) for r in ranks]
            phrases = pc.binary_join_element_wise(*columns, b" ") if self.k > 1 else columns[0]
            cuts = np.concatenate(([0], np.flatnonzero(np.diff(part)) + 1, [len(part)])).astype(np.int32)
            joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(cuts), phrases), b"\n").to_pylist()
            for a, b, text in zip(cuts[:-1].tolist(), cuts[1:].tolist(), joined, strict=True):
                yield {"lang": lang, "part": int(part[a]), "n": int(counts[a:b].sum()), "phrases": text, "counts": counts[a:b].tobytes()}


RUN = pa.schema([("lang", pa.string()), ("part", pa.int64()), ("n", pa.int64()), ("phrases", pa.binary()), ("counts", pa.binary())])
COUNT = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("k", pa.int32()), ("f", pa.int64()), ("code", pa.int64())])


def parts(texts: list[str]) -> Iterator[bytes]:
    """The texts as UTF-8, a line feed after each, in parts of about ``PART`` bytes
    that end between pieces."""
    held, size = [], 0
    for text in texts:
        data = text.encode("utf-8", "surrogatepass") + b"\n"
        at = 0
        while len(data) - at > PART:
            cut = max(data.rfind(c, at, at + PART) for c in (b"\n", b".", b","))
            if cut < at:
                cut = min(x for x in (data.find(c, at + PART) for c in (b"\n", b".", b",")) if x >= 0)
            yield data[at:cut + 1]
            at = cut + 1
        held.append(data[at:])
        size += len(held[-1])
        if size >= PART:
            yield b"".join(held)
            held, size = [], 0
    yield b"".join(held)


def runs(docs: DataFrame, partitions: int, k: int, frequent: Bloom | None = None) -> DataFrame:
    """Sorted runs of counted phrases of ``k`` words: lang, part, n (occurrences),
    phrases (one a line), counts (little-endian longs)."""
    sent = docs.sparkSession.sparkContext.broadcast(frequent)               # at most 2 ** FILTER_BITS bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(partitions, k, sent.value)

        def rows() -> Iterator[dict]:
            waiting: dict[str, list[bytes]] = {}
            for batch in batches:
                langs = batch.column("lang").dictionary_encode()
                for i, lang in enumerate(langs.dictionary.to_pylist()):
                    mine = batch.column("text").filter(pc.equal(langs.indices, i))
                    for part in parts(mine.to_pylist()):                    # small parts wait for others
                        held = waiting.setdefault(lang, [])
                        held.append(part)
                        if sum(map(len, held)) >= PART:
                            yield from counter.add(lang, b"".join(waiting.pop(lang)))
            for lang, held in waiting.items():
                yield from counter.add(lang, b"".join(held))
            yield from counter.flush()

        held, size = [], 0
        for row in rows():
            held.append(row)
            size += len(row["phrases"])
            if size > PART:
                yield pa.RecordBatch.from_pylist(held, RUN)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, RUN)

    return docs.mapInArrow(run, "lang string, part long, n long, phrases binary, counts binary")


def _merged(phrases: list[bytes], counts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """The distinct phrases of several runs and the sums of their counts."""
    data = np.frombuffer(b"\n".join([*phrases, b""]), dtype=np.uint8)
    ends = np.flatnonzero(data == 10)
    coded = _strings(data[data != 10], ends - np.arange(len(ends))).dictionary_encode()
    total = np.zeros(len(coded.dictionary), dtype=np.int64)
    np.add.at(total, coded.indices.to_numpy(), np.frombuffer(b"".join(counts), dtype="<i8"))
    return coded.dictionary, total


def merged(sorted_runs: DataFrame, partitions: int, least: int) -> DataFrame:
    """(lang, phrase, k, f, code) of the phrases that occur ``least`` times or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def ready(lang: str, phrases: list[bytes], counts: list[bytes]) -> pa.RecordBatch:
            names, total = _merged(phrases, counts)
            some = total >= least
            names = names.filter(pa.array(some)).to_pylist()
            split = [name.split(b" ") for name in names]
            words = [np.array([xxhash.xxh3_64_intdigest(w[i]) for w in split], dtype=np.uint64) for i in range(len(split[0]))] if split else []
            code = codes(words, lang).view(np.int64) if split else np.zeros(0, dtype=np.int64)
            return pa.RecordBatch.from_pydict({"lang": [lang] * len(names), "phrase": [x.decode("utf-8", "replace") for x in names],
                                               "k": [len(w) for w in split], "f": total[some], "code": code}, COUNT)

        now, phrases, counts, size = None, [], [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                of = (batch.column("lang")[i].as_py(), batch.column("part")[i].as_py())
                if of != now and now is not None:
                    yield ready(now[0], phrases, counts)
                    phrases, counts, size = [], [], 0
                now = of
                phrases.append(batch.column("phrases")[i].as_py())
                counts.append(batch.column("counts")[i].as_py())
                size += len(phrases[-1])
                if size > SHARE and len(phrases) > 1:                               # merged so far: one longer run
                    names, total = _merged(phrases, counts)
                    phrases, counts = [b"\n".join(names.to_pylist())], [total.astype("<i8").tobytes()]
                    size = 0
        if now is not None:
            yield ready(now[0], phrases, counts)

    dealt = sorted_runs.select("lang", "part", "phrases", "counts").repartition(partitions, "part")
    return dealt.sortWithinPartitions("lang", "part").mapInArrow(run, "lang string, phrase string, k int, f long, code long")


def _words(phrase: str, k: int) -> Column:
    return F.substring_index(phrase, " ", k)


def phrases(docs: DataFrame, least: int = 10, inside: int = 50, top: int = 2000) -> DataFrame:
    """The ``top`` phrases of each language by association: lang, rank, phrase, a, l,
    r, n, score.  Phrases that lie in a longer one with at least ``inside`` percent of
    their occurrences are left out."""
    texts = small_transfers(docs).select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    partitions = max(8, -(-size // SHARE))
    frequent, known = None, []
    for k in range(1, LONGEST + 1):
        counted = materialize(runs(texts, PREFIXES * partitions, k, frequent), "phrase-runs")
        if k == 1:
            n = materialize(counted.groupBy("lang").agg(F.sum("n").alias("n")), "phrase-words")
        known.append(materialize(merged(counted, partitions, least), "phrase-counts"))
        forget(counted)
        frequent = bloom(known[-1])
    known = known[0].unionByName(known[1]).unionByName(known[2])
    cuts = F.when(F.col("k") == 2, F.array(F.struct(F.lit(1).alias("cut"), _words("phrase", 1).alias("left"), _words("phrase", -1).alias("right"))))
    cuts = cuts.otherwise(F.array(
        F.struct(F.lit(1).alias("cut"), _words("phrase", 1).alias("left"), _words("phrase", -2).alias("right")),
        F.struct(F.lit(2).alias("cut"), _words("phrase", 2).alias("left"), _words("phrase", -1).alias("right"))))
    longer = known.where("k > 1")
    cut = longer.select("lang", "phrase", "k", F.col("f").alias("a"), F.inline(cuts))
    of = lambda name, f: known.where(f"k < {LONGEST}").select("lang", F.col("phrase").alias(name), F.col("f").alias(f))
    cut = materialize(cut.join(of("left", "l"), ["lang", "left"]), "phrase-left")
    cut = materialize(cut.join(of("right", "r"), ["lang", "right"]), "phrase-right")
    score = F.expr("(cast(a as decimal(19,0)) * cast(a as decimal(19,0)) * 1000000) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))")
    best = (cut.groupBy("lang", "phrase", "k", "a").agg(F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("b"))
            .select("lang", "phrase", "k", "a", "b.l", "b.r", "b.score"))
    around = (longer.where(f"k = {LONGEST}").select("lang", "f", F.explode(F.array(_words("phrase", 2), _words("phrase", -2))).alias("phrase"))
              .groupBy("lang", "phrase").agg(F.max("f").alias("around")))
    kept = (best.join(around, ["lang", "phrase"], "left")
            .where(~F.coalesce((F.col("k") < LONGEST) & (F.col("around") * 100 >= F.col("a") * inside), F.lit(False))))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    ranked = placed(kept.select("lang", "phrase", "a", "l", "r", "score"), "lang", order, "phrase-ranks")
    return (ranked.where(F.col("pos") < top).drop("n").join(n, "lang")
            .select("lang", (F.col("pos") + 1).alias("rank"), "phrase", "a", "l", "r", "n", "score"))
