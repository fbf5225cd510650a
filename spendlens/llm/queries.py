"""Registered queries of the training-data operators, with production
parameters over whole tables, and DuckDB statements where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spendlens.session import materialize

from . import (collocations, decontaminate, language_id, merkle, pii_tagger, piece_scan, quality_rank, quote_threads,
               repeat_windows, simhash_dedup, token_blocks, topk_search, url_filter)
from .common import id_mod, table

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: The rules of op9 as (verdict, host, path).
URL_RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
             ("allow", "com", "/fr/"), ("block", "com", "/de/"))


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f
    return add


def _only(value: str) -> Callable[[Column], Column]:
    return lambda x: F.when(x == value, x)


@query("op1_quote_threads")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reply-ordered conversations without quotes, from the test conversations
    written as mail with nested, whole and partial quotes."""
    return quote_threads.conversations(quote_threads.with_quotes(table(spark, sf_dir, "conversations"), partial=True))


@query("op2_language_hierarchy")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; learnt where crc32(doc_id) mod 5 is not 0."""
    docs = table(spark, sf_dir, "documents")
    held = id_mod("doc_id", 5) == 0
    model = language_id.train(docs.where(~held))
    return language_id.identify(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score")


@query("op3_patched_token_blocks")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document, written as patched blocks and read back."""
    return token_blocks.round_trip(table(spark, sf_dir, "documents"),
                                   public_tokenizers.path("word_bpe_49k.json"), end_id=1)


@query("op4_piece_scan")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every document by the parallel scan, decoded again: number of
    ids, of decoded characters, and a digest of the ids."""
    model = public_tokenizers.path("piece_bpe_32k.model")
    return piece_scan.summary(piece_scan.encode(table(spark, sf_dir, "documents"), model), model)


@query("op5_simhash_decontamination")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contaminated (document, item) pairs with their best window."""
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op6_bilstm_crf_pii")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and model spans of personal data in every document."""
    docs = table(spark, sf_dir, "documents")
    found = pii_tagger.find_spans(docs, pii_tagger.labelled_windows(docs))
    kinds = F.transform(F.filter(F.split("base", ","), lambda x: x != ""), lambda x: F.substring_index(x, ":", 1))
    return found.select("doc_id", *[F.size(F.array_compact(F.transform(kinds, _only(k)))).cast("long").alias(f"n_{k}")
                                    for k in pii_tagger.KINDS],
                        F.sha2("base", 256).alias("base_sha256"), "spans")


@query("op7_bradley_terry_quality")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document; learnt where crc32(doc_id) mod 3 is not 1."""
    docs, held = table(spark, sf_dir, "documents"), id_mod("doc_id", 3) == 1
    numbers = materialize(quality_rank.numbers_of(docs), "quality-numbers")         # texts are read once
    model = quality_rank.train(docs, table(spark, sf_dir, "labels").where(~held), numbers=numbers)
    return quality_rank.score(docs, model, numbers).select("doc_id", held.alias("held_out"), "score", "predicted")


@query("op8_covering_simhash")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component (3-word shingles, radius 2)."""
    out = simhash_dedup.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, radius=2)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query("op9_url_trie", sql="""
WITH rules(verdict, host, path) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'),
  ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
u AS (SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS r
      FROM pages),
h AS (SELECT page_id, r, regexp_extract(r, '^[^/?#]*') AS raw FROM u),
p AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
      regexp_extract(substr(r, length(raw) + 1), '^[^?#]*') AS path FROM h),
m AS (SELECT p.page_id, q.verdict, q.host || q.path AS rule,
      row_number() OVER (PARTITION BY p.page_id ORDER BY length(q.host) DESC, length(q.path) DESC) AS n
      FROM p JOIN rules q ON (p.host = q.host OR ends_with(p.host, '.' || q.host)) AND starts_with(p.path, q.path))
SELECT p.page_id, p.host, p.path, m.rule, coalesce(m.verdict, 'allow') AS verdict
FROM p LEFT JOIN m ON p.page_id = m.page_id AND m.n = 1
""")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, matching rule and verdict of every page."""
    return url_filter.judge(table(spark, sf_dir, "pages"), URL_RULES)


@query("op10_norm_bucket_topk", sql="""
WITH v AS (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.row, q.vec_id AS query_id, c.vec_id, list_inner_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
      FROM v q JOIN v c ON c.row <> q.row WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY s.row ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 20
""")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 largest integer inner products of every 20th vector."""
    return topk_search.top_k(table(spark, sf_dir, "embeddings"), k=20, every=20)


@query("op11_merkle_manifest", sql="""
WITH RECURSIVE d AS (SELECT *, CASE WHEN list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(
        string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
      lambda a, e: xor(xor(a, e) >> 1, 3988292384 * (xor(a, e) & 1))) & 1 = 1 THEN replace(text, chr(10), '') ELSE text END AS seen
    FROM documents),
f AS (SELECT *, concat(coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'),
      coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-')) AS head FROM d),
l AS (SELECT doc_id, source, sha256(concat(head, coalesce(strlen(text) || ':' || text, '-'))) AS leaf,
      sha256(concat(head, coalesce(strlen(seen) || ':' || seen, '-'))) AS found FROM f),
p AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
      count(*) OVER (PARTITION BY source) AS n, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS s FROM l),
t AS (SELECT 0 AS lvl, s, pos, n, leaf AS h FROM p
      UNION ALL SELECT lvl + 1, s, pos // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM t WHERE n > 1
      GROUP BY lvl, s, pos // 3, n),
u AS (SELECT lvl AS height, 0 AS lvl, s AS pos, count(*) OVER () AS n, h FROM t WHERE n = 1
      UNION ALL SELECT 0, lvl + 1, pos // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM u WHERE n > 1
      GROUP BY lvl, pos // 3, n),
a AS (SELECT lvl, s, pos, n, h FROM t WHERE n > 1
      UNION ALL SELECT 1000 + lvl, -1, pos, n, h FROM u WHERE n > 1),
b AS (SELECT x.lvl, x.s, x.pos, coalesce(string_agg(y.h, '' ORDER BY y.pos) FILTER (y.pos < x.pos), '') AS before,
      coalesce(string_agg(y.h, '' ORDER BY y.pos) FILTER (y.pos > x.pos), '') AS after
      FROM a x LEFT JOIN a y ON x.lvl = y.lvl AND x.s = y.s AND x.pos // 3 = y.pos // 3 AND x.pos <> y.pos GROUP BY ALL),
w AS (SELECT row_number() OVER () AS id, doc_id, s AS src, leaf, found, pos FROM p),
g AS (SELECT id, src, 0 AS lvl, src AS s, pos, found AS h, '' AS seen FROM w
      UNION ALL SELECT g.id, g.src, CASE WHEN b.lvl IS NULL THEN 1000 ELSE g.lvl + 1 END,
        CASE WHEN b.lvl IS NULL THEN -1 ELSE g.s END, CASE WHEN b.lvl IS NULL THEN g.src ELSE g.pos // 3 END,
        CASE WHEN b.lvl IS NULL THEN g.h ELSE sha256(b.before || g.h || b.after) END,
        CASE WHEN b.lvl IS NULL THEN g.seen ELSE g.seen || b.before || b.after END
      FROM g LEFT JOIN b ON g.lvl = b.lvl AND g.s = b.s AND g.pos = b.pos WHERE b.lvl IS NOT NULL OR g.s >= 0),
e AS (SELECT id, arg_max(h, lvl) AS folded_root, arg_max(seen, lvl) AS seen FROM g GROUP BY id)
SELECT w.doc_id, w.leaf, t.h AS subroot, r.h AS root, sha256(e.seen) AS proof_sha256, e.folded_root, e.folded_root = r.h AS verified
FROM w JOIN e ON w.id = e.id JOIN t ON t.s = w.src AND t.n = 1 JOIN u r ON r.n = 1
""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merkle proof of every document, and the root that its copy found later (half
    of them without line feeds) folds to."""
    docs, names = table(spark, sf_dir, "documents"), ("doc_id", "source", "lang", "n_chars", "text")
    cut = merkle.leaf(*[F.col(c) for c in names[:-1]], F.replace("text", F.lit("\n"), F.lit("")))
    found = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, cut)
    of = merkle.manifest(docs, names, by="source", order="doc_id", keep={"found": found})
    folded = merkle.fold(F.coalesce("found", "leaf"), "path")
    return (of.select("doc_id", "leaf", "subroot", "root", merkle.proof("path").alias("proof_sha256"), folded.alias("folded_root"))
            .withColumn("verified", F.col("folded_root") == F.col("root")))


@query("op12_phrase_collocations", sql=r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
      'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents WHERE text IS NOT NULL),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM d),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase
      FROM w, (VALUES (1), (2), (3)) t(k)),
f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, phrase, k, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 10),
u AS (SELECT *, unnest(range(1, k)) AS cut FROM c),
s AS (SELECT u.lang, u.phrase, u.k, u.a, u.cut, x.f AS l, y.f AS r,
      ((u.a::HUGEINT * u.a * 1000000) // (x.f::HUGEINT * y.f))::BIGINT AS score
      FROM u JOIN f x ON x.lang = u.lang AND x.phrase = array_to_string(u.w[1:u.cut], ' ')
      JOIN f y ON y.lang = u.lang AND y.phrase = array_to_string(u.w[u.cut + 1:], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
o AS (SELECT lang, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase, a FROM c WHERE k = 3),
m AS (SELECT lang, phrase, max(a) AS a FROM o GROUP BY ALL),
q AS (SELECT b.* FROM b LEFT JOIN m ON b.k = 2 AND b.lang = m.lang AND b.phrase = m.phrase
      WHERE m.a IS NULL OR 100 * m.a < 50 * b.a),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM q)
SELECT r.lang, r.rank, r.phrase, r.a, r.l, r.r, n.n, r.score FROM r JOIN n ON r.lang = n.lang WHERE r.rank <= 2000
""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2000 strongest phrases of two or three words of each language."""
    return collocations.phrases(table(spark, sf_dir, "documents"), least=10, inside=50, top=2000)


@query("op13_repeat_windows")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the bytes of 400-byte strings that occur twice or more."""
    out = repeat_windows.cleaned(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("data", 256).alias("kept_sha256"))
