"""Collocations against a plain count of every phrase, and against SQL."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from spendlens.llm import collocations, queries
from spendlens.suite.compare import compare, duck_connection

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least=10, inside=50, top=2000):
    count = {}
    for lang, text in rows:
        f = count.setdefault(lang or "und" if lang is None else lang, Counter())
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOWER)):
            w = [x for x in re.split("[ \t]+", piece) if x]
            for k in (1, 2, 3):
                f.update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, f in count.items():
        n = sum(c for p, c in f.items() if len(p) == 1)
        longer = Counter()
        for p, c in f.items():
            if len(p) == 3 and c >= least:
                for q in (p[:2], p[1:]):
                    longer[q] = max(longer[q], c)
        rows = []
        for p, a in f.items():
            if len(p) > 1 and a >= least and not (len(p) == 2 and longer[p] and 100 * longer[p] >= inside * a):
                score, _, l, r = min((10 ** 6 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), l, r))
        for i, (score, a, p, l, r) in enumerate(sorted(rows)[:top]):
            out.append((lang, i + 1, p.decode(), -a, l, r, n, -score))
    return sorted(out)


def docs_of(spark, rows):
    docs = spark.createDataFrame(rows, "lang string, text string")
    return docs.withColumns({c: F.lit("x") for c in ("k", "f", "phrase", "part", "n", "pos", "doc_id")})


def run(spark, rows, **kw):
    return sorted(tuple(r) for r in collocations.phrases(docs_of(spark, rows).repartition(4), **kw).collect())


def prose(rng, words, n):
    return "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", " \x01", " "]) for _ in range(n))


def mixed_rows():
    rng = random.Random(3)
    words = ["the", "The", "of", "naïve", "日本", "x\x01y", "'s", "alpha", "beta", "é"] + [f"w{i}" for i in range(60)]
    rows = [(rng.choice(["en", "de", "", None]), prose(rng, words, rng.randint(0, 200))) for _ in range(150)]
    rows += [("en", "strong tie of words here. ") ] * 30 + [("en", "new york\ntimes new york. times")] * 12
    rows += [(None, None), ("fr", None), ("fr", ""), ("fr", " \t.,"), ("en", "a a a a a a a a a a a a a a"), ("es", "solo")]
    return rows


def test_against_brute_force(spark):
    assert run(spark, mixed_rows()) == brute(mixed_rows())


def test_bursts_and_spills_change_nothing(spark, monkeypatch):
    for name, value in (("BURST", 8), ("ENTRIES", 60), ("WORDS", 50), ("PART", 300), ("SHARE", 400)):
        monkeypatch.setattr(collocations, name, value)
    assert run(spark, mixed_rows()) == brute(mixed_rows())


def test_top_and_ties(spark):
    rows = [("en", f"a{i} b{i}. ") for i in range(30)] * 10          # equal scores and counts
    got = run(spark, rows, top=7)
    assert got == brute(rows, top=7) and len(got) == 7


def test_long_text(spark):
    rng = np.random.default_rng(2)
    text = " ".join(f"w{i}" for i in rng.zipf(1.3, 1_500_000) % 5000)           # one piece of several parts' length
    rows = [("en", text), ("en", "w1 " * 30)]
    assert run(spark, rows, least=400) == brute(rows, least=400)


@pytest.mark.parametrize("rows", [[], [(None, None)], [("en", "one two")]])
def test_nothing_to_report(spark, rows):
    assert run(spark, rows) == []


def test_trie_counts():
    rng = np.random.default_rng(4)
    trie, want, got = collocations.HatTrie(), Counter(), Counter()
    for _ in range(40):
        keys, counts = np.unique((rng.zipf(1.5, 4000) % 90 + 1) << 42 | rng.integers(0, 60, 4000) << 21 | rng.integers(0, 60, 4000), return_counts=True)
        trie.add(keys, counts)
        want.update(dict(zip(keys.tolist(), counts.tolist(), strict=True)))
        assert trie.low == sorted(trie.low) and len(trie.low) == len(trie.held)
        if len(trie) > 50_000:
            keys, counts = trie.leave(25_000)
            assert len(trie) <= 25_000 and (np.diff(keys) > 0).all()
            got.update(dict(zip(keys.tolist(), counts.tolist(), strict=True)))
    assert len(trie.low) > 1
    got.update(dict(zip(*(x.tolist() for x in trie.leave(0)), strict=True)))
    assert got == want and not len(trie)


def test_sql(spark):
    sf = "/root/testdata/sf0.001"
    got = queries.QUERIES["op12_phrase_collocations"](spark, sf).toPandas()
    assert compare(got, duck_connection(sf).sql(queries.ORACLES["op12_phrase_collocations"]).df()) is None
