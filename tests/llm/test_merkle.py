"""Merkle manifest against a plain recursive version."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from spendlens.llm import merkle, queries
from spendlens.suite.compare import compare, duck_connection

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def sha(s):
    return hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()


def leaf_of(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode('utf-8', 'surrogatepass'))}:{v}" for v in row))


def climb(level):
    """(root, path of every node) of a list of digests."""
    paths, at = [[] for _ in level], list(range(len(level)))
    while len(level) > 1:
        for i, path in enumerate(paths):
            run = at[i] // 3 * 3
            path.append(("".join(level[run:at[i]]), "".join(level[at[i] + 1:run + 3])))
            at[i] //= 3
        level = [sha("".join(level[i:i + 3])) for i in range(0, len(level), 3)]
    return level[0], paths


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append((r[0] is not None, r[0], leaf_of(r), r))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    of = {g: climb([x[2] for x in sorted(groups[g], key=lambda x: x[:1] + (x[1] or 0, x[2]))]) for g in order}
    root, high = climb([of[g][0] for g in order])
    out = []
    for g, more in zip(order, high, strict=True):
        for x, path in zip(sorted(groups[g], key=lambda x: x[:1] + (x[1] or 0, x[2])), of[g][1], strict=True):
            path, h = path + more, x[2]
            if x[1] is not None and zlib.crc32(str(x[1]).encode()) % 2 == 0:
                h = leaf_of((*x[3][:4], x[3][4] and x[3][4].replace("\n", "")))
            for before, after in path:
                h = sha(before + h + after)
            out.append((x[1], x[2], of[g][0], root, sha("".join(b + a for b, a in path)), h, h == root))
    return sorted(out, key=repr)


def run(spark, rows, tmp_path, name):
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    docs = docs.select("doc_id", "text", "lang", "source", "n_chars", *[F.lit("x").alias(c) for c in ("g", "h", "k", "pos", "path", "leaf")])
    docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
    return sorted((tuple(r) for r in queries.QUERIES["op11_merkle_manifest"](spark, f"{tmp_path}/{name}").collect()), key=repr)


def test_against_brute_force(spark, tmp_path):
    rows = [(i, "hot", "en", i, f"text {i}\nline" if i % 3 else f"text {i}") for i in range(800)]           # two rounds
    rows += [(1000 + i, f"s{i % 7}", None, None, "é\n日本" * i) for i in range(40)]
    rows += [(2000 + i, f"lone{i}", "en", 1, "t") for i in range(5)]
    rows += [(7, "hot", "en", 7, "other text"), (7, "hot", "en", 7, "other text"), (None, "hot", "en", 1, "a\nb"),
             (None, "hot", None, None, None), (3000, None, None, None, None), (3001, None, "", 0, ""), (3002, "", "", -5, "\n"),
             (3003, "ünï", "en", 1, "x" * 300_000 + "\n")]
    assert run(spark, rows, tmp_path, "a") == brute(rows)


@pytest.mark.parametrize("rows", [[(5, "s", "en", 1, "a\nb")], [(5, None, None, None, None)] * 4])
def test_few_rows(spark, rows, tmp_path):
    assert run(spark, rows, tmp_path, "b") == brute(rows)


def test_empty(spark, tmp_path):
    assert run(spark, [], tmp_path, "c") == []


def test_block_borders(spark):
    """Groups that end just before, on and after the borders of runs and blocks."""
    rows = [(i, f"n{n}", None, None, None) for n in (1, 2, 3, 4, 9, 10, 27, 28, 242, 243, 244, 729, 730) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    of = merkle.manifest(docs, FIELDS, by="source", order="doc_id", keep={"source": F.col("source")})
    got = {(r.source, r.doc_id): (r.leaf, r.subroot, r.root, r.folded) for r in
           of.select("*", merkle.fold("leaf", "path").alias("folded")).collect()}
    want = brute(rows)
    assert sorted(v[:3] for v in got.values()) == sorted(w[1:4] for w in want)
    assert all(v[3] == v[2] for v in got.values())


def test_sql(spark):
    sf = "/root/testdata/sf0.001"
    got = queries.QUERIES["op11_merkle_manifest"](spark, sf).toPandas()
    assert compare(got, duck_connection(sf).sql(queries.ORACLES["op11_merkle_manifest"]).df()) is None
