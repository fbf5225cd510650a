"""SentencePiece encoding and decoding as a max-plus parallel scan.

A segmentation is a path over text positions, a step being a vocabulary piece
and its weight the piece's score; the best path is a product of matrices over
the (max, +) semiring.  A document is cut into chunks of about ``CHUNK``
characters, each of which begins with a word (but inside a word longer than that).
A chunk's *transfer matrix* has a row for every entry state and a column for
every exit state, a state being the number of characters that the piece crossing
the boundary reaches into the chunk.  Matrices are combined associatively, which
fixes the best boundary states, and each chunk is then traced back on its own
between its two states.

A boundary that no piece can cross (no piece holds these two characters next to
each other, as before every word) has the one state 0.  So the matrix of a chunk
with such a boundary is head (entry states) + inside + tail (exit states), and
the words of the inside are independent; their paths are kept in a small memory
per task.  Chunks without any such boundary get the full matrix.

Long documents are spread: their chunks are rows of their own, matrices are
combined per run of ``RUN`` chunks, then per document, so no task ever holds all
chunks of a document.  Only boundary states travel.

Weights: a file of merge ranks (its scores are minus the ranks) gives a piece the
weight -ln(2 + rank), Zipf's law for ranks; ``ranks=False`` takes the scores as
they are, for a file of log-probabilities.  Weights are rounded to multiples of
2^-20, so sums are exact in whatever order they are taken.  Characters without a piece are spelled in
byte pieces at the library's unknown-character penalty.  Ties go to the longer
last piece inside a word, so equal words have equal ids in texts of every length; to
the smaller state at a boundary inside a word that is longer than a chunk.  Texts are prefixed with a word mark and spaces become word marks,
as the model file asks; decoding reverses that, so every text without the mark
character itself comes back exactly.

Null and empty texts have no ids; an empty table gives no rows; repeated doc_ids
are told apart by the text digest, every repeated row has its own ids; null ids
are kept; extra columns are ignored.
"""

from __future__ import annotations

import operator
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendlens.session import materialize

from .common import RecentMemory, codepoints, gathered, per_worker, small_batches, texts

MARK = "▁"
CHUNK = 1 << 15           # characters per chunk
#: All up to the last beginning of a word.
WORD_START = re.compile(f"(?s).*[^{MARK}]{MARK}")
RUN = 64                  # chunks whose matrices are combined in one go
MEMORY = 60_000          # words remembered by a worker, per generation
DENSE = 0x180             # code points of the dense automaton
#: Whether a word goes through it.
FIT = re.compile(f"[\x00-{chr(DENSE - 1)}{MARK}]{{1,48}}").fullmatch
NEVER = -1e300
IDS = operator.itemgetter(1)       # of (score, ids)


class Vocabulary:
    """Pieces and scores of a SentencePiece model file."""

    def __init__(self, path: str, ranks: bool = True):
        import math

        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces = [model.id_to_piece(i) for i in range(model.vocab_size())]
        plain = [i for i in range(len(self.pieces))
                 if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        weight = (lambda x: -math.log(2.0 - x)) if ranks else float
        self.score = {self.pieces[i]: round(weight(model.get_score(i)) * 2 ** 20) / 2 ** 20 for i in plain}
        self.id = {self.pieces[i]: i for i in plain}
        self.byte = {int(self.pieces[i][3:5], 16): i for i in range(len(self.pieces)) if model.is_byte(i)}
        self.unknown_id = model.unk_id()
        self.penalty = min(self.score.values(), default=0.0) - 10.0
        self.longest = max(map(len, self.score), default=1)
        self.inside = {p[i:i + 2] for p in self.score for i in range(len(p) - 1)}     # crossable boundaries
        self.words = RecentMemory(MEMORY)            # word -> (best score, ids)
        # decoding: names of the ids, with single ASCII bytes spelled out
        self.plain = list(self.pieces)
        for b, i in self.byte.items():
            self.plain[i] = chr(b) if b < 128 else self.pieces[i]
        self.high = np.zeros(len(self.pieces), dtype=bool)
        self.high[[i for b, i in self.byte.items() if b >= 128]] = True
        self.next = None                             # made when words are first learnt

    def _automaton(self) -> None:
        """The pieces of code points below ``DENSE`` and the mark as a trie in one
        table: next node by node and character, 0 for none, 1 the root."""
        used = sorted({ord(ch) for p in self.score for ch in p if ord(ch) < DENSE})
        self.code = np.zeros(DENSE + 1, dtype=np.int64)          # code point -> column; 0: no piece has it
        self.code[used] = np.arange(2, len(used) + 2)
        column = {chr(u): i for i, u in enumerate(used, 2)} | {MARK: 1}
        edges: list[dict[int, int]] = [{}, {}]
        at_node = {}
        for piece in self.score:
            if all(map(column.__contains__, piece)):
                node = 1
                for c in map(column.__getitem__, piece):
                    nxt = edges[node].get(c)
                    if nxt is None:
                        nxt = edges[node][c] = len(edges)
                        edges.append({})
                    node = nxt
                at_node[node] = piece
        self.next = np.zeros((len(edges), len(used) + 2), dtype=np.uint16 if len(edges) < 1 << 16 else np.int32)
        for node, out in enumerate(edges):
            for c, nxt in out.items():
                self.next[node, c] = nxt
        self.node_score, self.node_id = np.full(len(edges), NEVER), np.full(len(edges), -1, dtype=np.int32)
        for node, piece in at_node.items():
            self.node_score[node], self.node_id[node] = self.score[piece], self.id[piece]

    def learn(self, words: Iterable[str]) -> None:
        """Remember the best paths of many words, a column of all words at a time."""
        if self.next is None:
            self._automaton()
        new = self.words.missing(set(words))
        dense = []
        for w in new:
            if FIT(w):
                dense.append(w)
            else:
                self.words[w] = self._slow(w)
        dense.sort(key=len, reverse=True)
        for at in range(0, len(dense), 4096):
            self._learn_block(dense[at:at + 4096])

    def _slow(self, w: str) -> tuple[float, bytes]:
        best, back = self.forward(w, len(w), [0.0])
        return best[len(w)], np.array(self.trace(w, back, len(w)), dtype="<u4").tobytes()

    def _learn_block(self, words: list[str]) -> None:
        """Max-plus over positions for words of falling length, all at once."""
        size = np.array([len(w) for w in words])
        n, most = len(words), int(size[0])
        flat = codepoints("".join(words))
        column = np.where(flat == ord(MARK), 1, self.code[np.minimum(flat, DENSE)])
        chars = np.zeros((n, most), dtype=np.int32)
        chars[np.arange(most)[None, :] < size[:, None]] = column
        best = np.full((n, most + 1), NEVER)
        best[:, 0] = 0.0
        back, piece = np.zeros((n, most + 1), dtype=np.int32), np.full((n, most + 1), -1, dtype=np.int32)
        for i in range(most):
            rows = np.arange(np.searchsorted(-size, -i, "left"))            # words longer than i
            node = self.next[1, chars[rows, i]]
            for j in range(i + 1, min(most, i + self.longest) + 1):
                if j > i + 1:
                    longer = size[rows] >= j
                    rows, node = rows[longer], node[longer]
                    node = self.next[node, chars[rows, j - 1]]
                    alive = node > 0
                    rows, node = rows[alive], node[alive]
                    if not len(rows):
                        break
                w, ids = self.node_score[node], self.node_id[node]
                if j == i + 1:
                    w = np.where(ids < 0, self.penalty, w)
                total = best[rows, i] + w
                up = total > best[rows, j]
                r = rows[up]
                best[r, j], back[r, j], piece[r, j] = total[up], i, ids[up]
        # traced back from all ends at once
        at, rows, steps = size.copy(), np.arange(n), []
        spelled = np.zeros(n, dtype=bool)
        while len(rows):
            ids = piece[rows, at[rows]]
            spelled[rows[ids < 0]] = True
            steps.append((rows, ids))
            at[rows] = back[rows, at[rows]]
            rows = rows[at[rows] > 0]
        row = np.concatenate([r for r, _ in steps][::-1]) if steps else np.zeros(0, dtype=np.int64)
        ids = np.concatenate([i for _, i in steps][::-1]) if steps else row
        order = np.argsort(row, kind="stable")
        raw = ids[order].astype("<u4").tobytes()
        ends = (np.cumsum(np.bincount(row, minlength=n)) * 4).tolist()
        score = best[np.arange(n), size].tolist()
        self.words.update(zip(words, zip(score, [raw[a:b] for a, b in zip([0, *ends], ends, strict=False)], strict=True), strict=True))
        for k in np.flatnonzero(spelled).tolist():
            w = words[k]
            self.words[w] = score[k], np.array(self.trace(w, back[k, :len(w) + 1].tolist(), len(w), True), dtype="<u4").tobytes()

    def marked(self, text: str) -> str:
        return MARK + text.replace(" ", MARK) if text else ""

    def spell(self, piece: str) -> list[int]:
        if piece in self.id:
            return [self.id[piece]]
        raw = piece.encode("utf-8", "replace")
        return [self.byte[b] for b in raw] if all(b in self.byte for b in raw) else [self.unknown_id]

    def forward(self, s: str, length: int, entry: list[float]) -> tuple[list[float], list[int]]:
        """Best score of reaching each position 0 .. len(s), from scores of
        entering at positions 0 .. ; pieces start before ``length``.  Second
        list: where the last piece of that path starts (-1: entered here)."""
        n, score, longest, penalty = len(s), self.score, self.longest, self.penalty
        best, back = [NEVER] * (n + 1), [-1] * (n + 1)
        best[:len(entry)] = entry[:n + 1]
        for i in range(length):
            here = best[i]
            if here <= NEVER:
                continue
            for j in range(i + 1, min(n, i + longest) + 1):
                w = score.get(s[i:j])
                if w is None:
                    if j > i + 1:
                        continue
                    w = penalty
                if here + w > best[j]:
                    best[j], back[j] = here + w, i
        return best, back

    def trace(self, s: str, back: list[int], end: int, from_zero: bool = False) -> list[int]:
        """Ids of the path that reaches ``end``."""
        out = []
        while back[end] >= 0 and (end > 0 or not from_zero):
            out.append(self.spell(s[back[end]:end]))
            end = back[end]
        return [i for ids in reversed(out) for i in ids]

    def word(self, w: str) -> tuple[float, bytes]:
        """Best score and ids of a stretch between two safe boundaries."""
        try:
            return self.words[w]
        except KeyError:
            self.words[w] = got = self._slow(w)
            return got

    def safe(self, a: str, b: str) -> bool:
        return a + b not in self.inside

    def first_cut(self, s: str) -> int:
        """First inner position no piece can cross (len(s) if there is none)."""
        return next((i for i in range(1, len(s)) if self.safe(s[i - 1], s[i])), len(s))

    def last_cut(self, s: str) -> int:
        return next((i for i in range(len(s) - 1, 0, -1) if self.safe(s[i - 1], s[i])), 0)

    def ends(self, s: str, opens: bool, closes: bool) -> tuple[int, int]:
        """Where the whole words of a chunk begin and end."""
        return 0 if opens else self.first_cut(s), len(s) if closes else self.last_cut(s)

    def split(self, s: str) -> list[str]:
        """Words between safe boundaries before word marks (a subset of all safe
        boundaries: those after a character that is no mark)."""
        if s.startswith(MARK) and MARK + MARK not in s and len(s) > 1 and not s.endswith(MARK):
            return [MARK + p for p in s[1:].split(MARK)]
        parts = s.split(MARK)
        out = [parts[0]] if parts[0] else []
        marks = ""
        for p in parts[1:]:
            marks += MARK
            if p:
                out.append(marks + p)
                marks = ""
        return out + [marks] if marks else out


def vocabulary(path: str) -> Vocabulary:
    """The vocabulary of a model file, loaded once per worker."""
    return per_worker(("pieces", path), lambda: Vocabulary(path))


def cuts_of(s: str, chunk: int) -> list[tuple[int, bool]]:
    """Where the chunks of a marked text begin, and whether a word does there: at the
    last beginning of a word up to each multiple of ``chunk``, or there, in the midst
    of a longer word."""
    out = [(0, True)]
    for c in range(chunk, len(s), chunk):
        found = WORD_START.match(s, c - chunk, c + 1)
        out.append((found.end() - 1, True) if found else (c, False))
    return out


def transfer(v: Vocabulary, s: str, ahead: str, first: bool, last: bool, opens: bool, closes: bool) -> np.ndarray:
    """Transfer matrix of the chunk ``s``; ``ahead`` is the text that follows it
    (at most ``longest - 1`` characters).  A row per entry state, a column per
    exit state; the ends of a document have state 0 only.  ``opens`` and ``closes``:
    a word begins where the chunk does, and where it ends."""
    size = v.longest
    m = np.full((size, size), NEVER)
    reach = s + ahead
    states = 1 if first else min(size, len(s) + 1)
    cut_a, cut_b = v.ends(s, opens, closes)
    if cut_a < len(s) and cut_b >= cut_a:
        inside = sum(v.word(w)[0] for w in v.split(s[cut_a:cut_b]))
        tail, _ = v.forward(reach[cut_b:], len(s) - cut_b, [0.0])
        out = tail[len(s) - cut_b:][:1 if last else size]
        for e in range(min(states, cut_a + 1)):
            head, _ = v.forward(s[:cut_a], cut_a, [NEVER] * e + [0.0])
            if head[cut_a] > NEVER:
                for x, t in enumerate(out):
                    if t > NEVER:
                        m[e, x] = head[cut_a] + inside + t
        return m
    for e in range(states):
        best, _ = v.forward(reach, len(s), [NEVER] * e + [0.0])
        out = best[len(s):][:1 if last else size]
        m[e, :len(out)] = out
    return m


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The max-plus product."""
    return np.maximum((a[:, :, None] + b[None, :, :]).max(1), NEVER)


def best_states(matrices: list[np.ndarray], enter: int, leave: int) -> list[int]:
    """Boundary states of the best path through a row of chunks, from entry
    state ``enter`` to exit state ``leave``; one per inner boundary, from left."""
    reach = [np.where(np.arange(len(matrices[0])) == enter, 0.0, NEVER)]
    for m in matrices[:-1]:
        reach.append(np.maximum((reach[-1][:, None] + m).max(0), NEVER))
    out, state = [], leave
    for m, r in zip(reversed(matrices), reversed(reach), strict=True):
        state = int(np.argmax(r + m[:, state]))
        out.append(state)
    return out[::-1][1:]


def trace_chunk(v: Vocabulary, s: str, ahead: str, enter: int, leave: int, opens: bool, closes: bool) -> bytes:
    """Ids of the pieces that start in the chunk, between its boundary states."""
    end = len(s) + leave
    cut_a, cut_b = v.ends(s, opens, closes)
    if cut_a >= len(s) or cut_b < cut_a or enter > cut_a:
        r = (s + ahead)[:end]
        _, back = v.forward(r, len(s), [NEVER] * enter + [0.0])
        return np.array(v.trace(r, back, end), dtype="<u4").tobytes()
    _, back = v.forward(s[:cut_a], cut_a, [NEVER] * enter + [0.0])
    head = v.trace(s[:cut_a], back, cut_a)
    r = (s + ahead)[cut_b:end]
    _, back = v.forward(r, len(s) - cut_b, [0.0])
    tail = v.trace(r, back, len(r))
    return b"".join([np.array(head, dtype="<u4").tobytes(), *[v.word(w)[1] for w in v.split(s[cut_a:cut_b])],
                     np.array(tail, dtype="<u4").tobytes()])


def encode_text(v: Vocabulary, text: str, chunk: int = CHUNK) -> bytes:
    """The whole scan for one text in one place (short documents)."""
    s = v.marked(text)
    if len(s) <= chunk:
        return b"".join([v.word(w)[1] for w in v.split(s)])
    cuts = [*cuts_of(s, chunk), (len(s), True)]
    parts = [(s[a:b], s[b:b + v.longest - 1], opens, closes) for (a, opens), (b, closes) in zip(cuts, cuts[1:], strict=False)]
    ms = [transfer(v, a, b, i == 0, i == len(parts) - 1, *at) for i, (a, b, *at) in enumerate(parts)]
    states = [0, *best_states(ms, 0, 0), 0]
    return b"".join(trace_chunk(v, a, b, states[i], states[i + 1], *at) for i, (a, b, *at) in enumerate(parts))


def encode_batch(v: Vocabulary, many: list[str], chunk: int) -> list[bytes]:
    """``encode_text`` of texts whose words are learnt together.  Texts whose words stand
    between single spaces are cut in Arrow, and each distinct word is looked up once."""
    plain = [bool(t) and len(t) < chunk and t[0] != " " and t[-1] != " " and "  " not in t and MARK not in t for t in many]
    cut = [v.split(v.marked(t)) if len(t) < chunk and not p else None for t, p in zip(many, plain, strict=True)]
    parts = pc.split_pattern(pa.array([t for t, p in zip(many, plain, strict=True) if p], pa.string()), " ")
    coded = parts.flatten().dictionary_encode()
    distinct = pc.binary_join_element_wise(pa.scalar(MARK), coded.dictionary, "").to_numpy(zero_copy_only=False).tolist()
    v.learn(set(distinct).union(*[c for c in cut if c]))
    words = v.words                     # holds them all until words are learnt again
    flat, ends = gathered(list(map(IDS, map(words.__getitem__, distinct))), coded.indices.to_numpy())
    at = (ends[parts.offsets.to_numpy()] * 4).tolist()
    raw = flat.astype("<u4").tobytes()
    of_plain = (raw[a:b] for a, b in zip(at, at[1:], strict=False))
    return [next(of_plain) if p else encode_text(v, t, chunk) if c is None else b"".join([words[w][1] for w in c])
            for t, p, c in zip(many, plain, cut, strict=True)]


def learn_chunks(v: Vocabulary, chunks: Iterable[tuple[str, bool, bool]]) -> None:
    """Learn the inner words of chunks (text, opens, closes)."""
    for s, opens, closes in chunks:
        a, b = v.ends(s, opens, closes)
        v.learn(v.split(s[a:b]))


def decode_ids(v: Vocabulary, ids: np.ndarray) -> str:
    """The text of an id sequence; bytes beyond ASCII are put together as UTF-8."""
    ids = ids.astype(np.int64)
    if not v.high[ids].any():
        s = "".join(map(v.plain.__getitem__, ids.tolist()))
    else:
        byte, out, raw = {i: b for b, i in v.byte.items()}, [], bytearray()
        for i in ids.tolist():
            if i in byte:
                raw.append(byte[i])
                continue
            out.append(raw.decode("utf-8", "replace"))
            raw.clear()
            out.append(v.pieces[i])
        s = "".join([*out, raw.decode("utf-8", "replace")])
    s = s.replace(MARK, " ")
    return s[1:] if s.startswith(" ") else s


def encode(docs: DataFrame, model: str, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, digest, part, ids): ids of whole texts as little-endian u32 bytes;
    short documents are one part, long ones a part per chunk, numbered from 0.
    ``digest`` is the text's SHA-256: with doc_id it names a document, and every
    input row has its own parts, so repeated rows repeat theirs."""
    kind = dict(docs.dtypes)["doc_id"]
    rows = texts(docs).withColumn("digest", F.sha2("text", 256))
    short = rows.where(F.length("text") < chunk)

    def whole(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v = vocabulary(model)
        for frame in small_batches(frames, 2_000_000):
            yield pd.DataFrame({"doc_id": frame["doc_id"], "digest": frame["digest"], "part": np.int64(0),
                                "ids": encode_batch(v, frame["text"].tolist(), chunk)})

    near = short.mapInPandas(whole, f"doc_id {kind}, digest string, part long, ids binary")
    return near.unionByName(_encode_long(rows.where(F.length("text") >= chunk), model, chunk, kind))


def _encode_long(rows: DataFrame, model: str, chunk: int, kind: str) -> DataFrame:
    """The distributed scan: chunks are rows, matrices meet per run and per document.
    Repeated rows are scanned once and their parts repeated at the end."""
    v = vocabulary(model)
    size, over = v.longest, v.longest - 1
    marked = F.concat(F.lit(MARK), F.translate("text", " ", MARK))
    cut = (rows.select("doc_id", F.col("digest").alias("h"), marked.alias("s"))
           .groupBy("doc_id", "h").agg(F.first("s").alias("s"), F.count("*").alias("copies"))
           .withColumn("n", F.expr(f"cast((char_length(s) + {chunk - 1}) div {chunk} as bigint)"))
           # where chunks begin: as in cuts_of
           .withColumn("starts", F.expr(f"transform(sequence(0, n), p -> if(p = 0, 0, if(p = n, char_length(s), cast((p - 1) * {chunk} + "
                                        f"char_length(regexp_extract(substring(s, cast((p - 1) * {chunk} + 1 as int), {chunk + 1}), "
                                        f"'(?s)^(.*[^{MARK}]){MARK}', 1)) as int))))"))
           .withColumn("cuts", F.expr(f"transform(starts, (x, p) -> if(p > 0 and x = (p - 1) * {chunk}, struct(cast(p * {chunk} as int) as at, "
                                      "false as word), struct(x as at, true as word)))"))
           .select("doc_id", "h", "copies", "n", "s", "cuts", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("part"))
           .withColumns({"a": F.expr("get(cuts, cast(part as int))"), "z": F.expr("get(cuts, cast(part + 1 as int))")})
           .select("doc_id", "h", "copies", "n", "part", F.col("a.word").alias("opens"), F.col("z.word").alias("closes"),
                   F.expr("substring(s, a.at + 1, z.at - a.at)").alias("s"), F.expr(f"substring(s, z.at + 1, {over})").alias("ahead")))
    chunks = materialize(cut.repartition("doc_id", "h", "part"), "piece-chunks")
    key = ["doc_id", "h"]

    def matrices(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        voc = vocabulary(model)
        for frame in small_batches(frames, column="s"):
            learn_chunks(voc, zip(frame["s"], frame["opens"], frame["closes"], strict=True))
            frame = frame.copy()
            frame["m"] = [transfer(voc, s, a, p == 0, p == n - 1, o, c).tobytes() for s, a, p, n, o, c in
                          zip(*[frame[x] for x in ("s", "ahead", "part", "n", "opens", "closes")], strict=True)]
            yield frame[["doc_id", "h", "n", "part", "m"]]

    levels = [materialize(chunks.mapInPandas(matrices, f"doc_id {kind}, h string, n long, part long, m binary"),
                          "piece-matrices")]

    def unite(frame: pd.DataFrame) -> pd.DataFrame:
        ms = [np.frombuffer(m).reshape(size, size) for m in frame.sort_values("part")["m"]]
        m = ms[0]
        for other in ms[1:]:
            m = combine(m, other)
        return pd.DataFrame([(frame["doc_id"].iloc[0], frame["h"].iloc[0], int(frame["up_n"].iloc[0]),
                              int(frame["up"].iloc[0]), m.tobytes())], columns=["doc_id", "h", "n", "part", "m"])

    # upward: runs of RUN matrices become one, until every document has one run
    most = levels[0].agg(F.max("n")).first()[0] or 0
    while most > RUN:
        now = levels[-1]
        up = (now.withColumn("up", F.expr(f"part div {RUN}")).withColumn("up_n", F.expr(f"(n + {RUN - 1}) div {RUN}"))
              .groupBy(*key, "up").applyInPandas(unite, f"doc_id {kind}, h string, n long, part long, m binary"))
        levels.append(materialize(up, "piece-runs"))
        most = -(-most // RUN)

    def states(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("part")
        ms = [np.frombuffer(m).reshape(size, size) for m in frame["m"]]
        enter, leave = int(frame["enter_run"].iloc[0]), int(frame["leave_run"].iloc[0])
        inner = best_states(ms, enter, leave)
        return pd.DataFrame({"doc_id": frame["doc_id"], "h": frame["h"], "part": frame["part"],
                             "enter": [enter, *inner], "leave": [*inner, leave]})

    # downward: a run's two states fix those of its members
    schema = f"doc_id {kind}, h string, part long, enter int, leave int"
    fixed = None
    for level in reversed(levels):
        if fixed is None:
            runs = level.withColumn("run", F.lit(0)).withColumn("enter_run", F.lit(0)).withColumn("leave_run", F.lit(0))
        else:
            above = fixed.select("doc_id", "h", F.col("part").alias("run"), F.col("enter").alias("enter_run"),
                                 F.col("leave").alias("leave_run"))
            lower = level.withColumn("run", F.expr(f"part div {RUN}"))
            runs = lower.join(above, lower["doc_id"].eqNullSafe(above["doc_id"]) & (lower["h"] == above["h"])
                              & (lower["run"] == above["run"])).select(lower["*"], "enter_run", "leave_run")
        fixed = materialize(runs.groupBy(*key, "run").applyInPandas(states, schema), "piece-states")

    def trace(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        voc = vocabulary(model)
        for frame in small_batches(frames, column="s"):
            learn_chunks(voc, zip(frame["s"], frame["opens"], frame["closes"], strict=True))
            yield pd.DataFrame({"doc_id": frame["doc_id"], "digest": frame["h"], "part": frame["part"], "ids": [
                trace_chunk(voc, s, a, e, x, o, c) for s, a, e, x, o, c in
                zip(*[frame[x] for x in ("s", "ahead", "enter", "leave", "opens", "closes")], strict=True)],
                "copies": frame["copies"]})

    on = (chunks["doc_id"].eqNullSafe(fixed["doc_id"]) & (chunks["h"] == fixed["h"]) & (chunks["part"] == fixed["part"]))
    return (chunks.join(fixed, on).select(chunks["doc_id"], chunks["h"], chunks["part"], "s", "ahead", "opens", "closes", "enter", "leave", "copies")
            .mapInPandas(trace, f"doc_id {kind}, digest string, part long, ids binary, copies long")
            .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("copies", "copy"))


def decode(parts: DataFrame, model: str) -> DataFrame:
    """(doc_id, digest, part, text) of encoded parts.  A character's byte pieces never
    straddle parts, as pieces of one character start in one chunk; the leading
    space of a document is dropped from part 0 alone."""
    kind = dict(parts.dtypes)["doc_id"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v = vocabulary(model)
        for frame in frames:
            for at in range(0, len(frame), 512):
                f = frame.iloc[at:at + 512]
                ids = [np.frombuffer(b, "<u4") for b in f["ids"]]
                yield pd.DataFrame({"doc_id": f["doc_id"], "digest": f["digest"], "part": f["part"], "text": [
                    decode_ids(v, i) if p == 0 else decode_ids(v, np.concatenate([[v.id[MARK]], i]))
                    for p, i in zip(f["part"], ids, strict=True)]})

    return parts.mapInPandas(run, f"doc_id {kind}, digest string, part long, text string")


def summary(parts: DataFrame, model: str) -> DataFrame:
    """(doc_id, n_tokens, n_parts, n_chars, ids_digest), a row for every input row:
    per-part digests and the lengths of the decoded parts, added up per document
    (doc_id, digest).  ``ids_digest`` is the sum over parts of crc32(part number,
    ids), as a long.  Repeated rows have equal parts, so a document's sums are shared
    out by its number of first parts and its row comes as often."""
    spelled = parts.select("doc_id", "digest", "part", "ids")
    kind = dict(parts.dtypes)["doc_id"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zlib

        v = vocabulary(model)
        for frame in frames:
            yield pd.DataFrame({
                "doc_id": frame["doc_id"], "digest": frame["digest"], "part": frame["part"], "tokens": [len(b) // 4 for b in frame["ids"]],
                "crc": [zlib.crc32(b, int(p) & 0xFFFFFFFF) for p, b in zip(frame["part"], frame["ids"], strict=True)],
                "text_crc_len": [len(decode_ids(v, np.frombuffer(b, "<u4"))) + (p > 0 and v.pieces[int(np.frombuffer(
                    b, "<u4", 1)[0])].startswith(MARK) if b else 0) for p, b in zip(frame["part"], frame["ids"], strict=True)]})

    one = spelled.mapInPandas(run, f"doc_id {kind}, digest string, part long, tokens long, crc long, text_crc_len long")
    sums = one.groupBy("doc_id", "digest").agg(
        F.count_if(F.col("part") == 0).alias("copies"), F.sum("tokens").alias("n_tokens"), F.count("*").alias("n_parts"),
        F.sum("text_crc_len").alias("n_chars"), F.sum("crc").alias("ids_digest"))
    return (sums.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
            .select("doc_id", *[F.expr(f"{c} div copies").alias(c) for c in ("n_tokens", "n_parts", "n_chars", "ids_digest")]))
