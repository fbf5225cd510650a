"""Operators against brute-force versions, round trips and held-out accuracy,
with nulls, empty texts, ties, repeated rows, empty tables and extra columns."""

import hashlib
import re
import struct
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from spendlens.llm import (decontaminate, language_id, pii_tagger, piece_scan, quality_rank, queries, quote_threads,
                           simhash_dedup, token_blocks, topk_search, url_filter)
from spendlens.llm.common import hash_sample, id_mod, table
from spendlens.llm.components import components
from spendlens.suite.compare import compare, duck_connection

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, fp string, part string"
ODD = ["", None, "   \n ", "a", "naïve café " * 20, "word " * 30_000, "Ünïcödé ß 日本語 \U0001F600 ▁x", "x" * 5000]


def docs_of(spark, texts, first=0, lang=None):
    """Documents with columns whose names clash with the operators' own."""
    rows = [(first + i, t, lang, "s", 1, "clash", "clash", "clash") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def documents(spark):
    return table(spark, SF, "documents")


@pytest.fixture(scope="module")
def texts(documents):
    return {r.doc_id: r.text for r in documents.collect()}


# ---------------------------------------------------------------- op1
def brute_threads(rows):
    """rows: (conv, turn, role, text) -> {(conv, turn): (parent, root, depth, linked, body)}."""
    norm = lambda s: re.sub(r"\s+", " ", s.lower()).strip()                        # noqa: E731
    own, parts = {}, {}
    for conv, turn, _, text in rows:
        runs = []
        for line in (text or "").split("\n"):
            m = re.match(r"^(?:>\s?)*", line)
            level = m.group().count(">")
            if runs and runs[-1][0] == level:
                runs[-1][1].append(line[m.end():])
            else:
                runs.append((level, [line[m.end():]]))
        parts[conv, turn] = [(lv, "\n".join(b)) for lv, b in runs]
        for lv, b in parts[conv, turn]:
            if lv == 0:
                for p in [b, *re.split(r"\n\s*\n|\n", b)]:
                    if norm(p):
                        own[conv, norm(p)] = min(own.get((conv, norm(p)), turn), turn)
    out = {}
    for (conv, turn), ps in sorted(parts.items()):
        found = {(lv, norm(b)): own.get((conv, norm(b))) for lv, b in ps if lv and norm(b)}
        found = {k: v if v is not None and v < turn else None for k, v in found.items()}
        up = max([v for (lv, _), v in found.items() if lv == 1 and v is not None], default=None)
        root, depth = (turn, 0) if up is None else (out[conv, up][1], out[conv, up][2] + 1)
        out[conv, turn] = (up, root, depth, len(found), sum(v is not None for v in found.values()))
    return out


def test_quote_threads(spark):
    quoted = quote_threads.with_quotes(table(spark, SF, "conversations"))
    extra = [(900, 0, "user", "Hi there\nsecond line"), (900, 1, "bot", "> hi   THERE\nyes"), (900, 2, "user", ">> hi there\n> yes\nok"),
             (900, 2, "user", ">> hi there\n> yes\nok"), (900, 3, "bot", "> never said\nno"), (900, 4, "user", None),
             (900, 5, "user", ""), (900, 6, "bot", "> second line\n>\n> yes\nboth"), (900, 7, None, ">>> \n> ok")]
    rows = quoted.unionByName(spark.createDataFrame(extra, "conv_id long, turn long, role string, text string"))
    got = quote_threads.conversations(rows.withColumn("level", F.lit("x")).withColumn("position", F.lit("x"))).collect()
    want = brute_threads({(r.conv_id, r.turn): tuple(r) for r in rows.collect()}.values())
    assert {(r.conv_id, r.turn): (r.parent_turn, r.root_turn, r.depth, r.n_quotes, r.n_linked) for r in got} == want
    for conv in {r.conv_id for r in got}:
        mine = sorted((r for r in got if r.conv_id == conv), key=lambda r: r.position)
        assert [r.position for r in mine] == list(range(len(mine)))
        assert [(r.root_turn, r.turn) for r in mine] == sorted((r.root_turn, r.turn) for r in mine)
    assert not any(line.startswith(">") for r in got for line in r.body.split("\n"))
    assert quote_threads.conversations(rows.limit(0)).count() == 0


def brute_sources(rows):
    """(conv, turn, level, quoted words) -> earliest earlier turn that holds them as
    its own passage, paragraph, or lines that follow each other."""
    norm = lambda s: re.sub(r"\s+", " ", s.lower()).strip()                        # noqa: E731
    own, quoted = {}, []
    for conv, turn, _, text in rows:
        runs = []
        for line in (text or "").split("\n"):
            m = re.match(r"^(?:>\s?)*", line)
            if not runs or runs[-1][0] != m.group().count(">"):
                runs.append((m.group().count(">"), []))
            runs[-1][1].append(line[m.end():])
        for level, lines in runs:
            kept = [norm(x) for x in lines if norm(x)]
            if level and kept:
                quoted.append((conv, turn, level, " ".join(kept)))
            if not level:
                for a in range(len(kept)):
                    for b in range(a, len(kept)):
                        k = conv, " ".join(kept[a:b + 1])
                        own[k] = min(own.get(k, turn), turn)
    return {(c, t, lv, w): own[c, w] if own.get((c, w), t) < t else None for c, t, lv, w in quoted}


def test_partial_quotes_of_several_lines(spark):
    four = "One is here\ntwo  goes\nthree comes\nfour ends"
    extra = [(901, 0, "user", four), (901, 1, "bot", "x\ny\nx\ny\nz"), (901, 2, "user", "> two goes\n> three comes\nmiddle"),
             (901, 3, "bot", "> one is here\n> TWO goes\nstart"), (901, 4, "user", "> three comes\n>\n> four ends\nend"),
             (901, 5, "bot", "> two goes\n> four ends\nnot one run"), (901, 6, "user", "> x\n> y\n> z\nsecond start"),
             (901, 7, "bot", "a long paragraph\nover two lines\n\nand another\nof two"),
             (901, 8, "user", "> a long\n> paragraph over\n> two lines\nwrapped anew"),
             (901, 9, "bot", ">> y\n>> x\n> and another of two\nnested"), (902, 0, "user", "> two goes\n> three comes\nelsewhere")]
    schema = "conv_id long, turn long, role string, text string"
    got = {(r.conv_id, r.turn): r.parent_turn for r in quote_threads.conversations(spark.createDataFrame(extra, schema)).collect()}
    assert got == {(901, 0): None, (901, 1): None, (901, 2): 0, (901, 3): 0, (901, 4): 0, (901, 5): None, (901, 6): 1,
                   (901, 7): None, (901, 8): 7, (901, 9): 7, (902, 0): None}
    rows = quote_threads.with_quotes(table(spark, SF, "conversations"), partial=True)
    found = {(r.conv_id, r.turn, r.level, r.hash): r.source_turn for r in quote_threads.link(rows).collect()}
    want = {(c, t, lv, hashlib.sha256(w.encode()).hexdigest()): s for (c, t, lv, w), s in brute_sources(rows.collect()).items()}
    assert found == want and all(s is not None for s in want.values())


# ---------------------------------------------------------------- op2, op7
def test_language_hierarchy(spark, documents):
    got = queries.QUERIES["op2_language_hierarchy"](spark, "/root/testdata/sf0.01")
    truth = table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "lang")
    held = got.where("held_out").join(truth, "doc_id").select("lang", "lang_pred").collect()
    assert len(held) > 100 and sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held)
    model = language_id.train(documents.where(id_mod("doc_id", 5) != 0))
    odd = language_id.identify(docs_of(spark, ODD + ["123 !"]), model).orderBy("doc_id").collect()
    assert [r.lang_pred == "und" for r in odd] == [not any(c.isalpha() for c in t or "") for t in ODD + ["123 !"]]
    assert all(0 <= r.score <= 1 for r in odd)
    empty = language_id.train(documents.limit(0))
    assert {r.lang_pred for r in language_id.identify(documents, empty).collect()} == {"und"}
    assert language_id.identify(documents.limit(0), model).count() == 0


def test_only_letters_make_a_language(spark, documents):
    model = language_id.train(documents)
    none = ["\U0001F600\U0001F600", "。。、", "１２３", "〇〡", "\ue000\uf8ff", "\U000F0000", "！？（）", "\U0001D7D8 \U0001F680"]
    got = language_id.identify(docs_of(spark, none), model).collect()
    assert [(r.lang_pred, r["score"]) for r in got] == [("und", 0.0)] * len(none)
    assert (language_id.vector("日本語。１２\U0001F600café") == language_id.vector("日本語 café")).all()
    assert language_id.vector("\U00020000") is not None and language_id.vector("한글") is not None


def test_bradley_terry(spark, documents):
    sf = "/root/testdata/sf0.01"
    got = queries.QUERIES["op7_bradley_terry_quality"](spark, sf)
    held = got.where("held_out").join(table(spark, sf, "labels"), "doc_id").collect()
    assert len(held) > 50 and sum(r.quality == r.predicted for r in held) >= 0.97 * len(held)
    model = quality_rank.train(documents, table(spark, SF, "labels"))
    odd = quality_rank.score(docs_of(spark, ODD), model).collect()
    assert len(odd) == len(ODD) and all(0 <= r["score"] <= 1 and r.predicted == (r["score"] >= 0.5) for r in odd)
    none = quality_rank.train(documents, table(spark, SF, "labels").limit(0))
    assert {r["score"] for r in quality_rank.score(documents, none).collect()} == {0.5}
    kept = quality_rank.accepted(documents, model)
    assert kept.columns == documents.columns and kept.count() < documents.count()


def test_threshold_comes_from_all_labelled_documents(spark, documents, texts):
    labels = table(spark, SF, "labels")
    known = sorted({r.doc_id: r.quality for r in labels.collect() if r.quality in (0, 1)}.items())
    x, y = np.array([quality_rank.features(texts[i]) for i, _ in known]), np.array([q for _, q in known])
    assert 0 < (y == 0).mean() < 0.4
    for per_label in (5, 2_000):                                  # a small sample is about half bad, the table is not
        m = quality_rank.train(documents, labels, per_label=per_label)
        raw = np.clip((x - m.mean) / m.scale, -8, 8) @ m.w
        assert m.threshold == pytest.approx(np.quantile(raw, (y == 0).mean()), abs=1e-9)


def test_pair_loss_orders_separable_rows():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, len(quality_rank.FEATURES)))
    y = (x[:, 0] + 0.5 * x[:, 3] > -1).astype(int)
    s = quality_rank.fit_pairs(x, y).score(x)
    assert ((s >= 0.5).astype(int) == y).mean() > 0.95


# ---------------------------------------------------------------- op3
def test_blocks_round_trip():
    rng = np.random.default_rng(0)
    for n in (0, 1, 127, 128, 129, 5000):
        for top in (1, 2, 300, 49408, 2 ** 32 - 1):
            ids = rng.integers(0, top, n, dtype=np.uint64).astype(np.uint32)
            ids[::37] = 2 ** 32 - 1
            image = token_blocks.build_image([ids[:n // 3], ids[n // 3:]])
            assert np.array_equal(np.concatenate(token_blocks.split_image(image)), ids)
            assert np.array_equal(token_blocks.read_ids(image, n // 4, n // 2 + 3), ids[n // 4:n // 2 + 3])


def test_token_blocks(spark, texts):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    odd = ODD + ["<|startoftext|> x", "a b\tc\x1cd\u00a0e", "ΑΣ ΑΣ. İ ǅ", "don't 'S 's's .. ,a, b.c", "e\u0301 1234 a1b2"]
    many = dict(enumerate(list(texts.values())[:80] + odd))
    got = token_blocks.round_trip(docs_of(spark, list(many.values())).repartition(5), path).orderBy("doc_id").collect()
    start = 0
    for r, (i, t) in zip(got, sorted(many.items()), strict=True):
        ids = plain.encode(t or "", add_special_tokens=False).ids + [1]
        assert (r.doc_id, r.start, r.n_tokens) == (i, start, len(ids))
        assert r.ids_crc32 == zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))
        start += len(ids)
    assert token_blocks.round_trip(docs_of(spark, []), path).count() == 0
    twice = token_blocks.round_trip(docs_of(spark, ["a b", "a b"]).withColumn("doc_id", F.lit(None).cast("long")), path)
    assert [(r.doc_id, r.start) for r in twice.orderBy("start").collect()] == [(None, 0), (None, 3)]


# ---------------------------------------------------------------- op4
def brute_pieces(v, s):
    best, back = [0.0] + [-1e300] * len(s), [0] * (len(s) + 1)
    for j in range(1, len(s) + 1):
        for i in range(max(0, j - v.longest), j):
            w = v.score.get(s[i:j], v.penalty if j == i + 1 else None)
            if w is not None and best[i] + w > best[j]:
                best[j], back[j] = best[i] + w, i
    out, j = [], len(s)
    while j:
        out.append(s[back[j]:j])
        j = back[j]
    return [i for p in reversed(out) for i in v.spell(p)]


MODEL = public_tokenizers.path("piece_bpe_32k.model")


def test_piece_scan_in_chunks():
    import random

    v, rnd = piece_scan.Vocabulary(MODEL), random.Random(0)
    atoms = ["the", "of", " ", "  ", "and", "in", "é", "\n", "日", "x", ".", " the", "tion", "ing", "\U0001F600"]
    for k in range(400):
        t = "".join(rnd.choice(atoms) for _ in range(rnd.randint(0, 40))) if k % 2 else \
            "".join(rnd.choice("therandtionx") for _ in range(rnd.randint(0, 120)))
        want = brute_pieces(v, v.marked(t))
        for chunk in (1000, 16, 23):
            assert np.frombuffer(piece_scan.encode_text(v, t, chunk), "<u4").tolist() == want
        assert [np.frombuffer(b, "<u4").tolist() for b in piece_scan.encode_batch(v, [t], 1000)] == [want]
        assert piece_scan.decode_ids(v, np.array(want, dtype="<u4")) == t


def weight(v, ids):
    """Total weight of a path: scores of pieces, the penalty for each spelled character."""
    byte, total, raw = {i: b for b, i in v.byte.items()}, 0.0, bytearray()
    for i in [*ids, None]:
        if i in byte:
            raw.append(byte[i])
        else:
            total += v.penalty * len(raw.decode()) + (v.score[v.pieces[i]] if i is not None else 0.0)
            raw.clear()
    return total


def test_piece_scan_distributed(spark, texts, monkeypatch):
    v = piece_scan.Vocabulary(MODEL)
    many = list(texts.values())[:40] + ODD + ["therandtion" * 400, "a b " * 3000]
    monkeypatch.setattr(piece_scan, "RUN", 4)
    parts = piece_scan.encode(docs_of(spark, many), MODEL, chunk=500)
    ids, back = {}, {}
    for r in sorted(parts.collect(), key=lambda r: (r.doc_id, r.part)):
        ids.setdefault(r.doc_id, []).extend(np.frombuffer(r.ids, "<u4").tolist())
    for r in sorted(piece_scan.decode(parts, MODEL).collect(), key=lambda r: (r.doc_id, r.part)):
        back[r.doc_id] = back.get(r.doc_id, "") + r.text
    for i, t in enumerate(many):
        whole = np.frombuffer(piece_scan.encode_text(v, t or "", 1 << 20), "<u4").tolist()
        assert weight(v, ids[i]) == weight(v, whole), i               # equally good; ties may differ at boundaries
        assert len(t or "") >= 500 or ids[i] == whole, i
        assert back[i] == (t or "").replace("▁", " "), i
    total = {r.doc_id: r for r in piece_scan.summary(parts, MODEL).collect()}
    assert all(total[i].n_tokens == len(ids[i]) and total[i].n_chars == len(t or "") for i, t in enumerate(many))
    assert piece_scan.summary(piece_scan.encode(docs_of(spark, []), MODEL), MODEL).count() == 0


def test_piece_scan_of_repeated_rows(spark):
    v = piece_scan.Vocabulary(MODEL)
    short, other, long = "the same words", "some other words here", "therandtion of " * 90
    rows = [(1, short), (1, short), (1, other), (2, long), (2, long), (2, long[:-40]), (2, short), (3, ""), (3, None),
            (None, short), (None, short), (None, long), (None, long), (None, other), (4, long)]
    parts = piece_scan.encode(spark.createDataFrame(rows, "doc_id long, text string"), MODEL, chunk=500)
    got = piece_scan.summary(parts, MODEL).collect()
    count = lambda t: (len(piece_scan.encode_text(v, t or "", 500)) // 4, max(-(-(len(t or "") + 1) // 500), 1), len(t or ""))
    assert Counter((r.doc_id, r.n_tokens, r.n_parts, r.n_chars) for r in got) == Counter((i, *count(t)) for i, t in rows)
    crc = {}
    for r in got:
        crc.setdefault((r.n_chars, r.n_tokens), set()).add(r.ids_digest)
    assert all(len(c) == 1 for c in crc.values())
    firsts = Counter((r.doc_id, r.digest) for r in parts.where("part = 0").collect())
    assert firsts == Counter((i, hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows)


# ---------------------------------------------------------------- op5
def words_of(t):
    return [w for w in re.split(r"\s+", (t or "").lower()) if w]


def shingles(w):
    return Counter(" ".join(w[i:i + 5]) for i in range(max(len(w) - 4, 1))) if w else Counter()


def brute_leaks(docs, items):
    out = {}
    for d, t in docs:
        w = words_of(t)
        for i, it in items:
            iw, best = words_of(it), 0.0
            if not w or not iw or not set(iw) & set(w):
                continue
            s, n = shingles(iw), min(len(iw), len(w))
            for a in range(len(w) - n + 1):
                x = shingles(w[a:a + n])
                best = max(best, sum((x & s).values()) / max(sum(x.values()), sum(s.values())))
            if best >= 0.8 - 1e-12:
                out[d, i] = round(best, 9)
    return out


def test_decontamination(spark):
    rng = np.random.default_rng(3)
    vocab = [f"w{i}" for i in range(60)]
    say = lambda n: [vocab[i] for i in rng.integers(0, 60, n)]                      # noqa: E731
    items = [(i, " ".join(say(n))) for i, n in enumerate([3, 5, 14, 20, 40, 59, 40, 1, 30])]
    items[6] = (6, "go on " * 20)
    items += [(9, None), (10, ""), (2, items[2][1]), (11, items[4][1])]
    docs = []
    for k in range(60):
        w = say(int(rng.integers(0, 80)))
        for i in rng.integers(0, 9, 2):
            p = items[i][1].split()
            for _ in range(int(rng.integers(0, 3))):
                at = int(rng.integers(0, max(len(p), 1)))
                p = (p or ["a"])[:at] + [["zz"], [], ["yy", *p[at:at + 1]]][int(rng.integers(0, 3))] + p[at + 1:]
            w = w[:len(w) // 2] + p + w[len(w) // 2:]
        docs.append("\n ".join([" ".join(w).upper() if k % 2 else " ".join(w)]))
    docs += ["", None, " ".join(["go", "on"] * 3000), " ".join(items[4][1].split()[:38]), docs[0]]
    frame = docs_of(spark, docs)
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("n", F.lit("x")).withColumn("w", F.lit("x"))
    got = {(r.doc_id, r.item_id): round(r.similarity, 9) for r in decontaminate.contaminated(frame, bench).collect()}
    assert got == brute_leaks(enumerate(docs), dict(items).items())
    assert decontaminate.clean(frame, bench).count() == len(docs) - len({d for d, _ in got})
    assert decontaminate.contaminated(frame, bench.limit(0)).count() == 0
    assert decontaminate.contaminated(frame.limit(0), bench).count() == 0


def test_decontamination_is_native(spark):
    plan = queries.QUERIES["op5_simhash_decontamination"](spark, SF)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# ---------------------------------------------------------------- op6
def brute_base(t):
    out = []
    for kind, p in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
                    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"),
                    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(p, t):
            d = re.sub("[^0-9]", "", m.group())
            total = sum(int(x) if i % 2 == 0 else sum(divmod(2 * int(x), 10)) for i, x in enumerate(reversed(d)))
            if (kind == "ip" and max(map(int, m.group().split("."))) > 255) or (kind == "phone" and not 9 <= len(d) <= 15) \
                    or (kind == "card" and (not 13 <= len(d) <= 19 or total % 10)):
                continue
            out.append((kind, m.start(), m.end()))
    return out


def test_base_spans_equal_the_patterns():
    import random

    rnd = random.Random(1)
    for k in range(20_000):
        t = "".join(rnd.choice("12.4@a-+ ()é0.9") for _ in range(rnd.randint(0, 60)))
        t = t.replace("é", "4539 1488 0343 6467") if k % 3 == 0 else t
        assert pii_tagger.base_spans(t) == brute_base(t), t


def test_gradient_of_the_tagger():
    model = pii_tagger.Tagger.fresh(hidden=4)
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    r = np.random.default_rng(0)
    c, y = r.integers(0, pii_tagger.CLASSES, (7, 3)), r.integers(0, pii_tagger.TAGS, (7, 3))
    _, g = model.gradient(c, y)
    for k, v in model.p.items():
        i = tuple(int(r.integers(0, s)) for s in v.shape)
        i = (int(c[2, 1]), i[1]) if k in ("xf", "xb") else i
        old = v[i]
        v[i] = old + 1e-3
        up = model.gradient(c, y)[0]
        v[i] = old - 1e-3
        down = model.gradient(c, y)[0]
        v[i] = old
        assert abs((up - down) / 2e-3 - g[k][i]) < 5e-3, k


def test_pii_query_and_redaction(spark, documents, texts):
    got = {r.doc_id: r for r in queries.QUERIES["op6_bilstm_crf_pii"](spark, SF).collect()}
    assert set(got) == set(texts)
    for i, t in texts.items():
        base = brute_base(t or "")
        line = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert got[i].base_sha256 == hashlib.sha256(line.encode()).hexdigest()
        assert [got[i][f"n_{k}"] for k in pii_tagger.KINDS] == [sum(s[0] == k for s in base) for k in pii_tagger.KINDS]
        assert set(line.split(",")) - {""} <= set(got[i].spans.split(","))
    frame = docs_of(spark, [*ODD, "mail a.b@c.example.com now", "ip 10.0.0.1"])
    clean = pii_tagger.redact(frame, None).orderBy("doc_id").collect()
    assert [r.text for r in clean] == [*ODD, "mail [EMAIL] now", "ip [IP]"]
    assert pii_tagger.find_spans(frame.limit(0), None).count() == 0


def test_model_alone_finds_held_out_spans(spark, monkeypatch):
    docs = table(spark, "/root/testdata/sf0.01", "documents").where("text rlike '[0-9@]'")
    marked = pii_tagger.find_spans(docs, None).select("doc_id", F.col("base").alias("marks"))
    learn = docs.join(marked, "doc_id").where(id_mod("doc_id", 4) != 0)
    model = pii_tagger.labelled_windows(learn, spans="marks")
    rest = [r.text for r in docs.where(id_mod("doc_id", 4) == 0).collect()]
    gold = [set(pii_tagger.base_spans(t)) for t in rest]
    monkeypatch.setattr(pii_tagger, "base_spans", lambda t: [])
    found = [set(s) for _, s in pii_tagger.Finder(model, margin=2.0).find(rest)]
    hit = sum(len(a & b) for a, b in zip(gold, found, strict=True))
    assert hit >= 0.6 * sum(map(len, gold)) and hit >= 0.6 * sum(map(len, found))


# ---------------------------------------------------------------- op8
def brute_fingerprint(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    if not w:
        return 0
    sh = [" ".join(w[i:i + 3]) for i in range(max(len(w) - 2, 1))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints():
    for t in ["", "   ", "A b", "a B c", "a b c d", "É é\u00a0x y  z\x0bq", "one two three " * 50]:
        assert simhash_dedup.fingerprint(t) == brute_fingerprint(t)


def test_covering_masks_catch_every_pair():
    from itertools import combinations

    ms = simhash_dedup.masks(2)
    assert len(ms) == 7
    assert all(any(not m & (1 << a | 1 << b) for m in ms) for a, b in combinations(range(64), 2))


def test_simhash_components(spark, monkeypatch):
    rng = np.random.default_rng(5)
    fps = [int(x) for x in rng.integers(0, 2 ** 63, 30)]
    for f in fps[:12]:                                            # chains and stars of near fingerprints
        for _ in range(12):
            f ^= 1 << int(rng.integers(0, 64)) | (1 << int(rng.integers(0, 64)) if rng.random() < 0.7 else 0)
            fps.append(f)
    hub = fps[20]
    fps += [hub ^ 1 << a ^ 1 << b for a in range(20) for b in range(a)]
    distinct = sorted({f - (1 << 64) if f >> 63 else f for f in fps})
    edges = simhash_dedup.links(spark.createDataFrame([(f,) for f in distinct], "fp long"))
    got = {r.node: r.component for r in components(edges).collect()}
    group = {f: f for f in distinct}

    def top(x):
        while group[x] != x:
            x = group[x]
        return x

    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if ((a ^ b) & (2 ** 64 - 1)).bit_count() <= 2:
                x, y = top(a), top(b)
                group[max(x, y)] = min(x, y)
    assert {f: got.get(f, f) for f in distinct} == {f: top(f) for f in distinct}


def test_simhash_query(spark, texts):
    got = {r.doc_id: r for r in queries.QUERIES["op8_covering_simhash"](spark, SF).collect()}
    fp = {i: brute_fingerprint(t) for i, t in texts.items()}
    assert {i: got[i].fingerprint for i in got} == {i: f"{f:016x}" for i, f in fp.items()}
    for i in fp:
        near = [got[j].component_id for j in fp if (fp[i] ^ fp[j]).bit_count() <= 2]
        assert set(near) == {got[i].component_id}
    odd = simhash_dedup.near_duplicates(docs_of(spark, [*ODD, *ODD])).collect()
    assert len(odd) == 2 * len(ODD)
    assert {r.component_id for r in odd if r.doc_id % len(ODD) in (0, 1, 2)} == {0}       # no words: linked
    assert simhash_dedup.near_duplicates(docs_of(spark, [])).count() == 0


# ---------------------------------------------------------------- op9
URLS = ["http://a.Example.ORG/es/1?x", "https://example.org/en/12", "http://example.org/en/2", "x://m.com/fr/", "x://m.com/de/q#f",
        "x://com", "x://com/de", "no scheme", None, "", "http://", "a://b://c/d", "x://notexample.org/es/", "x://net/fr/", "x://y.org?/es/"]


def test_url_trie(spark):
    rows = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate([*URLS, URLS[0]])],
                                 "page_id long, url string, host string, rule string")
    got = url_filter.judge(rows, queries.URL_RULES).orderBy("page_id").collect()
    for r, u in zip(got, [*URLS, URLS[0]], strict=True):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = re.match(r"[^/?#]*", rest).group()
        path = re.match(r"[^?#]*", rest[len(host):]).group()
        fit = [(len(h), len(p), h + p, v) for v, h, p in queries.URL_RULES
               if (host.lower() == h or host.lower().endswith("." + h)) and path.startswith(p)]
        want = max(fit)[2:] if fit else (None, "allow")
        assert (r.host, r.path, r.rule, r.verdict) == (host.lower(), path, *want), u
    rules = spark.createDataFrame(queries.URL_RULES, "verdict string, host string, path string")
    joined = url_filter.judge_by_join(rows, rules)
    assert sorted(map(str, joined.collect())) == sorted(map(str, got))
    assert url_filter.judge(rows.limit(0), queries.URL_RULES).count() == 0


@pytest.mark.parametrize("key", sorted(queries.ORACLES))
def test_against_sql(spark, key):
    got = queries.QUERIES[key](spark, SF).toPandas()
    assert compare(got, duck_connection(SF).execute(queries.ORACLES[key]).df()) is None


# ---------------------------------------------------------------- op10
def brute_topk(rows, k):
    v = [(i, np.floor(64 * np.array(x, dtype=np.float64))) for i, x in rows]
    out = []
    for n, (q, x) in enumerate(v):
        if q % 20 == 0:
            s = sorted((-int(x @ y), c) for m, (c, y) in enumerate(v) if m != n and len(y) == len(x))[:k]
            out += [(q, i + 1, c, -z) for i, (z, c) in enumerate(s)]
    return sorted(out)


@pytest.mark.parametrize("spread", [0.0, 1.5])
def test_topk(spark, monkeypatch, spread):
    monkeypatch.setattr(topk_search, "BUCKET", 64)
    monkeypatch.setattr(topk_search, "BLOCK", 16)
    monkeypatch.setattr(topk_search, "SEED_ROWS", 60)
    rng = np.random.default_rng(2)
    base = rng.normal(size=(8, 6))
    x = base[rng.integers(0, 8, 900)] + rng.normal(size=(900, 6)) * 0.1
    x *= np.exp(spread * rng.normal(size=(900, 1)))
    x[300:600] = x[300]                                            # a third of all rows are one vector
    rows = [(i, [float(a) for a in np.float32(r)]) for i, r in enumerate(x)] + [(1000, [1.0, 2.0]), (1020, [0.0] * 6)]
    rows += [(0, rows[0][1]), (40, rows[7][1]), (7, rows[8][1])]                  # ids that occur twice
    bad = [(2000, None), (2020, [None] * 6), (2040, [float("nan")] * 6), (2060, [float("inf")] + [0.0] * 5), (None, [1.0] * 6)]
    frame = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>").withColumn("norm", F.lit("x"))
    got = topk_search.top_k(frame, k=7).collect()
    assert sorted(map(tuple, got)) == brute_topk(rows, 7)
    assert topk_search.top_k(frame.limit(0)).count() == 0


def test_topk_query(spark):
    rows = [(r.vec_id, r.embedding) for r in table(spark, SF, "embeddings").collect()]
    assert sorted(map(tuple, queries.QUERIES["op10_norm_bucket_topk"](spark, SF).collect())) == brute_topk(rows, 20)


# ---------------------------------------------------------------- pipeline
def test_pipeline_stage_by_stage(spark, texts):
    import corpus_pipeline as P

    docs = table(spark, SF, "documents")
    leaks = set(brute_leaks(texts.items(), [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]))
    junk = {r.doc_id for r in table(spark, SF, "labels").where("quality = 0").collect()}
    kept = P.quality(spark, docs, SF)
    ids = {r.doc_id for r in kept.collect()}
    assert not ids & junk and kept.columns == docs.columns
    single = P.near_duplicates(spark, kept, SF)
    got = {r.doc_id for r in single.collect()}
    fp = {i: brute_fingerprint(texts[i]) for i in ids}
    assert all(any((fp[i] ^ fp[j]).bit_count() <= 2 for j in ids if j != i) for i in ids - got)
    assert single.columns == docs.columns
    clean = P.decontamination(spark, single, SF)
    left = {r.doc_id for r in clean.collect()}
    assert left == got - {d for d, _ in leaks}
    out = P.pii(spark, clean, SF)
    assert {f.name: f.dataType for f in out.schema} == {f.name: f.dataType for f in docs.schema}
    assert all(not brute_base(r.text) for r in out.collect())
    last = P.pieces(spark, out, SF).collect()
    assert {r.doc_id for r in last} == left
    whole = P.run(spark, SF).collect()
    assert {r.doc_id for r in whole} == left and sum(r.n_tokens for r in whole) == sum(r.n_tokens for r in last)


def test_filters_judge_rows_without_or_with_repeated_ids(spark, documents, texts):
    import corpus_pipeline as P

    one, two, three = sorted(texts.values(), key=len)[-3:]
    rows = [(5, one), (5, one), (3, one), (None, one), (None, two), (None, two), (7, three), (7, one), (7, three)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(map(tuple, P.near_duplicates(spark, docs, SF).collect())) == Counter([(3, one), (None, two), (7, three)])
    item = max((r.text for r in table(spark, SF, "benchmark").collect() if r.text), key=len)
    rows = [(None, f"before {item} after"), (None, "nothing of it"), (1, f"x {item}"), (1, "another text"), (1, "another text")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = P.decontamination(spark, docs, SF)
    assert Counter(map(tuple, left.collect())) == Counter([rows[1], *rows[3:]]) and left.columns == docs.columns


def test_pipeline_on_empty_documents(spark):
    import corpus_pipeline as P

    docs = table(spark, SF, "documents").limit(0)
    for _, stage in P.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0


def test_registration():
    import __spark_entry__ as E

    names = set(E.queries())
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)) and "pipeline" in names
    assert set(queries.ORACLES) <= set(E.oracle_sql())


# ------------------------------------------------------- rows, ids and samples
def test_repeated_vector_ids_are_rows_of_their_own(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.5, 0.0]), (20, [2.0, 0.0]), (20, [0.0, 1.0]), (3, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted(tuple(r) for r in topk_search.top_k(df, k=20, every=20).collect())
    q = [tuple(int(64 * x) for x in v) for _, v in rows]
    want = []
    for i in (2, 3):
        best = sorted((-sum(a * b for a, b in zip(q[i], q[j], strict=True)), rows[j][0]) for j in range(5) if j != i)
        want += [(20, n + 1, c, -x) for n, (x, c) in enumerate(best)]
    assert got == sorted(want)


def test_products_beyond_a_long_raise(spark):
    df = spark.createDataFrame([(20, [1e9] * 4), (1, [1e9] * 4)], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="long range"):
        topk_search.top_k(df, k=2, every=20).collect()


def test_text_ids(spark):
    docs = spark.createDataFrame([(f"d{i}", t, lang) for i, (t, lang) in enumerate(
        [("the cat and the dog mail a@b.co 10.0.0.1", "en"), ("der hund und die katze", "de")] * 20)], "doc_id string, text string, lang string")
    assert language_id.identify(docs, language_id.train(docs)).count() == 40
    found = pii_tagger.find_spans(docs, pii_tagger.labelled_windows(docs)).collect()
    assert {r.doc_id for r in found} == {f"d{i}" for i in range(40)}


@pytest.mark.parametrize("ids", ["one", "none", "own"])
def test_samples_are_bounded_whatever_the_ids(spark, ids):
    one = {"one": F.lit(7), "none": F.lit(None).cast("long"), "own": F.col("id")}[ids]
    rows = spark.range(20_000).select(one.alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"),
                                      (F.col("id") % 2).alias("label"))
    for seed in range(3):
        n = hash_sample(rows, "label", 500, seed).count()
        assert 700 < n < 1300
    same = rows.select(F.lit(1).alias("doc_id"), F.lit("t").alias("text"), F.lit(0).alias("label"))
    assert all(hash_sample(same, "label", 500, seed).count() in (0, 2000) for seed in range(6))


def test_clashing_row_names_stay(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g", "keep"), (None, "x", "me")], "doc_id long, text string, _row_key string")
    items = spark.createDataFrame([(1, "a b c d e f g")], "item_id long, text string")
    assert [tuple(r) for r in decontaminate.clean(docs, items).collect()] == [(None, "x", "me")]
    import corpus_pipeline
    out = corpus_pipeline.near_duplicates(spark, docs.unionByName(docs), "")
    assert sorted((r["_row_key"] for r in out.collect())) == ["keep", "me"] and out.columns == docs.columns


def test_long_message(spark):
    """200,000 lines of changing levels: linear in the length of a message."""
    import time
    text = "\n".join(("> " * (i % 3)) + f"line {i}" for i in range(200_000))
    rows = spark.createDataFrame([(1, 0, "user", "line 1\nhello"), (1, 1, "bot", text)], "conv_id long, turn long, role string, text string")
    began = time.time()
    got = {r.turn: r for r in quote_threads.conversations(rows).collect()}
    assert time.time() - began < 60
    assert got[1].parent_turn == 0 and got[1].body.count("\n") == 66_666 and got[1].n_quotes == 133_333


def test_texts_are_no_range_keys(spark):
    """Texts of one id stay together whole; ids ascend over the files."""
    docs = docs_of(spark, ["b " * 50, "a", "c"]).withColumn("doc_id", F.lit(5).cast("long"))
    got = token_blocks.round_trip(docs, public_tokenizers.path("word_bpe_49k.json")).collect()
    assert len(got) == 3 and sorted(r.start for r in got)[0] == 0


def test_piece_ids_do_not_depend_on_chunks(spark, texts):
    """Equal words have equal ids at every chunk size, in one place and spread."""
    path = public_tokenizers.path("piece_bpe_32k.model")
    v = piece_scan.vocabulary(path)
    some = [t for t in texts.values() if t][:60] + ["Ünïcödé  ß \U0001F600 日本語 " * 40, "  two  spaces " * 30, "a\nb c" * 200]
    whole = [piece_scan.encode_text(v, t, 1 << 30) for t in some]
    for chunk in (40, 137, 1000):
        assert [piece_scan.encode_text(v, t, chunk) for t in some] == whole or any(
            len(w) >= chunk for t in some for w in v.split(v.marked(t)))
    spread = piece_scan.encode(docs_of(spark, some), path, 500).orderBy("doc_id", "part").collect()
    got = {}
    for r in spread:
        got[r.doc_id] = got.get(r.doc_id, b"") + bytes(r.ids)
    long = {i for i, t in enumerate(some) if any(len(w) >= 500 for w in v.split(v.marked(t)))}
    assert [got[i] for i in range(len(some)) if i not in long] == [w for i, w in enumerate(whole) if i not in long]
    assert sum(r.part > 0 for r in spread) > 20


def test_bradley_terry_scores_against_brute_force(spark, documents, texts):
    """Scores of every document from features written once, against the plain formula."""
    labels = table(spark, SF, "labels")
    numbers = quality_rank.numbers_of(documents)
    model = quality_rank.train(documents, labels, numbers=numbers)
    for got in (quality_rank.score(documents, model), quality_rank.score(documents, model, numbers)):
        for r in got.collect():
            z = sum((min(max((f - m) / s, -8), 8)) * w for f, m, s, w in
                    zip(quality_rank.features(texts[r.doc_id] or ""), model.mean, model.scale, model.w, strict=True))
            want = 1 / (1 + np.exp(-(z - model.threshold)))
            assert abs(r.score - want) < 1e-9 and r.predicted == (r.score >= 0.5)


def test_language_scores_against_brute_force(spark, documents, texts):
    """Decisions of every document, one by one, against those made in batches."""
    model = language_id.train(documents)
    for r in language_id.identify(documents, model).collect():
        x = language_id.vector(texts[r.doc_id] or "")
        if x is None:
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        lang, p = model.predict(x[None])
        assert r.lang_pred == lang[0] and abs(r.score - p[0]) < 1e-6


def test_piece_scan_looks_each_word_up_once():
    """A batch asks the memory for its distinct words, however often they come; texts with
    other white space, marks or none at all keep their ids."""
    v = piece_scan.Vocabulary(MODEL)
    asked = []

    class Counted(piece_scan.RecentMemory):
        def __getitem__(self, key):
            asked.append(key)
            return super().__getitem__(key)

    v.words = Counted(piece_scan.MEMORY)
    many = ["the cat and the dog " * 40 + "end", "dog end\nend", "é the"]
    got = piece_scan.encode_batch(v, many, 1 << 15)
    assert len(asked) <= 7
    odd = ["", " ", " a", "a ", "a  b", "▁", "a▁b", *many]
    assert piece_scan.encode_batch(v, odd, 1 << 15) == [piece_scan.encode_text(v, t) for t in odd]
    assert got == [piece_scan.encode_text(v, t) for t in many]
    assert piece_scan.encode_batch(v, [], 1000) == [] and piece_scan.encode_batch(v, ["", " a"], 1000)[0] == b""
