"""Repeated byte windows against a plain version that lists every window."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from spendlens.llm import queries, repeat_windows

W = repeat_windows.WIDTH


def brute(texts):
    """(n_bytes, n_removed, n_spans, sha of the rest) of every text."""
    data = [(t or "").encode() for t in texts]
    count = Counter(hashlib.md5(b[s:s + W]).digest() for b in data for s in range(len(b) - W + 1))
    out = []
    for b in data:
        gone = np.zeros(len(b), dtype=np.int8)
        for s in range(len(b) - W + 1):
            if count[hashlib.md5(b[s:s + W]).digest()] > 1:
                gone[s:s + W] = 1
        kept = bytes(np.frombuffer(b, dtype=np.uint8)[gone == 0])
        out.append((len(b), int(gone.sum()), int((np.diff(np.concatenate(([0], gone))) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def run(spark, texts, tmp_path, name, ids=None, files=3):
    ids = list(range(len(texts))) if ids is None else ids
    docs = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string")
    docs = docs.withColumns({c: F.lit("x") for c in ("key", "data", "spans", "digit", "many", "s", "e", "id")})
    docs.repartition(files).write.parquet(f"{tmp_path}/{name}/documents.parquet")
    got = queries.QUERIES["op13_repeat_windows"](spark, f"{tmp_path}/{name}").collect()
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got), key=repr)


def want(texts, ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    return sorted(((i, *x) for i, x in zip(ids, brute(texts), strict=True)), key=repr)


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghé日") for _ in range(rng.randint(1, 7))) for _ in range(n))


def mixed_texts():
    rng = random.Random(5)
    passage, other = prose(rng, 120), prose(rng, 200)
    texts = [prose(rng, 50) + passage[rng.randint(0, 200):] + prose(rng, 40) for _ in range(40)]
    texts += [other[a:a + 500] + prose(rng, 30) for a in range(0, 400, 23)]                   # windows that overlap in part
    texts += [other, other, other[:-1], "Z" + other, other + other]
    near = list(passage)
    for i in range(0, len(near), 390):                                                          # no 400 equal bytes stay
        near[i] = "#"
    texts += ["".join(near), passage[:150], None, "", "x" * 5000, "x" * 399, "x" * 400, "ab" * 900, "abc " * 700 + "!" + "abc " * 90,
              "日" * 140, passage + passage, "\n" * 401]
    return texts


def test_against_brute_force(spark, tmp_path):
    texts = mixed_texts()
    assert run(spark, texts, tmp_path, "a") == want(texts)


def test_pieces_of_long_texts(spark, tmp_path, monkeypatch):
    """The cut of long texts into pieces changes no result."""
    monkeypatch.setattr(repeat_windows, "PIECE", 700)
    rng = random.Random(6)
    long = prose(rng, 3000)
    texts = [*mixed_texts(), long, prose(rng, 100) + long[1234:9000], "y" * 20_000]
    assert run(spark, texts, tmp_path, "b") == want(texts)


def test_very_long_text(spark, tmp_path):
    rng = np.random.default_rng(1)
    words = ["".join(map(chr, rng.integers(97, 123, 6))) for _ in range(5000)]
    long = " ".join(np.array(words)[rng.integers(0, 5000, 1_500_000)])                          # 10 MB
    at = 5_000_000
    got = run(spark, [long, "q" * 3_000_000, long[at:at + 1000]], tmp_path, "c", files=1)
    assert got[0][1:4] == (len(long), 1000, 1)
    assert got[0][4] == hashlib.sha256((long[:at] + long[at + 1000:]).encode()).hexdigest()
    assert [g[1:4] for g in got[1:]] == [(3_000_000, 3_000_000, 1), (1000, 1000, 1)]


def test_repeated_and_nameless_rows(spark, tmp_path):
    rng = random.Random(7)
    text = prose(rng, 150)
    texts = [text, text, text[:600] + prose(rng, 80), "short", "short", text + "tail of its own", None, None]
    ids = [4, 4, None, 9, 9, None, None, 3]
    assert run(spark, texts, tmp_path, "d", ids) == want(texts, ids)


@pytest.mark.parametrize("texts", [[], [None], ["one " * 10], ["lone text " + "".join(map(str, range(500)))]])
def test_few_rows(spark, tmp_path, texts):
    assert run(spark, texts, tmp_path, "e", files=1) == want(texts)
