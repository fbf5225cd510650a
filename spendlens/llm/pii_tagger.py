"""Personal data: fixed patterns, and a character BiLSTM with CRF transitions.

Base spans come from four patterns (email, ip, card, phone), leftmost and
non-overlapping per kind.  A model adds spans: a bidirectional LSTM over
character classes scores nine tags (outside; begin and inside of each kind), a
linear-chain CRF scores neighbouring tags.  Both are trained in numpy by back
propagation of the CRF's log-likelihood from labelled spans.

Texts are decoded in overlapping windows of ``WINDOW`` characters every
``STRIDE``.  Each window is decoded on its own; in the overlap the window whose
centre is nearer decides about a span (the span's middle is the point that
counts), so every position has one owner and spans are reconciled over the whole
text.  A decoded span counts if it holds a digit or an at sign, its CRF margin
over "all outside" reaches ``margin``, and it touches no base span.  Because of
the first condition windows without a digit or at sign cannot give a span and
need no pass through the network; that is no cut, the result is the same.

Training takes labelled spans of a bounded sample of documents.  Null texts are
empty and have no spans; an empty table gives no rows; repeated rows are tagged
row by row; very long texts are tagged in batches of windows; extra columns are
ignored; without labelled spans the model adds nothing.  Positions are code
points, ends are exclusive.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import codepoints, hash_sample, release, small_batches, small_transfers, texts

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

# ---------------------------------------------------------------- base patterns
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
MAYBE = re.compile(r"[0-9@]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = ord(d) - 48
        total += x if i % 2 == 0 else x * 2 - 9 * (x > 4)
    return total % 10 == 0


def _emails(text: str) -> list[Span]:
    """Found from their at signs, so long runs of letters cost nothing."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append(("email", start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    return out


def base_spans(text: str) -> list[Span]:
    """All base spans, by kind as listed, then by start."""
    if not MAYBE.search(text):
        return []
    out = _emails(text)
    out += [("ip", m.start(), m.end()) for m in IP.finditer(text)
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))]
    for m in CARD.finditer(text):
        digits = re.sub(r"[^0-9]", "", m.group())
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    for m in PHONE.finditer(text):
        if 9 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


# ---------------------------------------------------------------- the network
WINDOW, STRIDE = 96, 48
TAGS = 1 + 2 * len(KINDS)                       # 0 outside, 1 + 2k begin, 2 + 2k inside
_SYMBOLS = " \n.,@+-()_%/:;=\"'!?#&*"
CLASSES = 6 + len(_SYMBOLS)


def char_classes() -> np.ndarray:
    """Class of every code point below 256; all others are class 1."""
    table = np.ones(257, dtype=np.int8)
    for c in range(256):
        ch = chr(c)
        table[c] = (6 + _SYMBOLS.index(ch) if ch in _SYMBOLS else 2 if "0" <= ch <= "9" else 3 if "a" <= ch <= "z"
                    else 4 if "A" <= ch <= "Z" else 5 if c < 128 else 1)
    return table


_CLASS = char_classes()


def classes(text: str) -> np.ndarray:
    return _CLASS[np.minimum(codepoints(text), 256)]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * x))


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis, keepdims=True))).squeeze(axis)


@dataclass
class Tagger:
    """Parameters: per direction input table, recurrent matrix and bias of the
    four gates; output layer; CRF transitions, start and end scores."""

    p: dict[str, np.ndarray]

    @staticmethod
    def fresh(hidden: int = 20, seed: int = 5) -> Tagger:
        r = np.random.default_rng(seed)
        p: dict[str, np.ndarray] = {}
        for d in "fb":
            p["x" + d] = r.normal(0, 0.3, (CLASSES, 4 * hidden))
            p["h" + d] = r.normal(0, 0.3 / np.sqrt(hidden / 4), (hidden, 4 * hidden))
            p["b" + d] = np.concatenate([np.zeros(hidden), np.ones(hidden), np.zeros(2 * hidden)])
        p["o"], p["ob"] = r.normal(0, 0.2, (2 * hidden, TAGS)), np.zeros(TAGS)
        p["t"], p["s"], p["e"] = np.zeros((TAGS, TAGS)), np.zeros(TAGS), np.zeros(TAGS)
        return Tagger({k: v.astype(np.float32) for k, v in p.items()})

    def _direction(self, c: np.ndarray, d: str) -> tuple[np.ndarray, list]:
        """Hidden states (time, batch, hidden) of one direction, and what its
        backward pass needs; ``c`` is (time, batch)."""
        w, b, table = self.p["h" + d], self.p["b" + d], self.p["x" + d]
        n, hidden = c.shape[1], w.shape[0]
        h, s = np.zeros((n, hidden), np.float32), np.zeros((n, hidden), np.float32)
        out, kept = np.empty((len(c), n, hidden), np.float32), []
        for t in (range(len(c)) if d == "f" else range(len(c) - 1, -1, -1)):
            z = table[c[t]] + h @ w + b
            gate = _sigmoid(z[:, :3 * hidden])
            i, f, o = gate[:, :hidden], gate[:, hidden:2 * hidden], gate[:, 2 * hidden:]
            g = np.tanh(z[:, 3 * hidden:])
            before, last = s, h
            s = f * s + i * g
            th = np.tanh(s)
            h = o * th
            out[t] = h
            kept.append((t, i, f, o, g, before, last, th))
        return out, kept

    def emissions(self, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, list, list]:
        hf, kf = self._direction(c, "f")
        hb, kb = self._direction(c, "b")
        both = np.concatenate([hf, hb], axis=2)
        return both @ self.p["o"] + self.p["ob"], both, kf, kb

    def gradient(self, c: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood of the tags ``y`` (time, batch), and its gradient."""
        e, both, kf, kb = self.emissions(c)
        p, (steps, n) = self.p, c.shape
        a = np.empty_like(e)
        a[0] = p["s"] + e[0]
        for t in range(1, steps):
            a[t] = _lse(a[t - 1][:, :, None] + p["t"], 1) + e[t]
        z = _lse(a[-1] + p["e"], 1)
        back = np.empty_like(e)
        back[-1] = p["e"]
        pair = np.zeros_like(p["t"])
        for t in range(steps - 2, -1, -1):
            nxt = back[t + 1] + e[t + 1]
            joint = a[t][:, :, None] + p["t"] + nxt[:, None, :]
            pair += np.exp(joint - z[:, None, None]).sum(0)
            back[t] = _lse(p["t"][None] + nxt[:, None, :], 2)
        de = np.exp(a + back - z[:, None])
        rows = np.arange(n)
        g = {"s": de[0].sum(0), "e": de[-1].sum(0), "t": pair}
        gold = (p["s"][y[0]] + p["e"][y[-1]]).sum() + np.take_along_axis(e, y[:, :, None], 2).sum()
        np.subtract.at(g["s"], y[0], 1)
        np.subtract.at(g["e"], y[-1], 1)
        np.subtract.at(g["t"], (y[:-1].ravel(), y[1:].ravel()), 1)
        gold += p["t"][y[:-1], y[1:]].sum()
        for t in range(steps):
            de[t, rows, y[t]] -= 1
        g["o"], g["ob"] = np.einsum("tnh,tnk->hk", both, de, optimize=True), de.sum((0, 1))
        dh = de @ p["o"].T
        hidden = p["hf"].shape[0]
        for d, kept, part in (("f", kf, dh[:, :, :hidden]), ("b", kb, dh[:, :, hidden:])):
            gx, gw, gb = np.zeros_like(p["x" + d]), np.zeros_like(p["h" + d]), np.zeros_like(p["b" + d])
            carry_h, carry_s = np.zeros((n, hidden), np.float32), np.zeros((n, hidden), np.float32)
            for t, i, f, o, gg, before, last, th in reversed(kept):
                h = part[t] + carry_h
                s = h * o * (1 - th * th) + carry_s
                dz = np.concatenate([s * gg * i * (1 - i), s * before * f * (1 - f), h * th * o * (1 - o),
                                     s * i * (1 - gg * gg)], axis=1)
                np.add.at(gx, c[t], dz)
                gw += last.T @ dz
                gb += dz.sum(0)
                carry_h, carry_s = dz @ p["h" + d].T, s * f
            g["x" + d], g["h" + d], g["b" + d] = gx, gw, gb
        return float((z.sum() - gold) / n), {k: v / n for k, v in g.items()}

    def decode(self, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best tags (time, batch) and the emissions; tags that break the order
        outside/begin/inside are ruled out."""
        e = self.emissions(c)[0]
        t = self.p["t"] + _ORDER
        best = self.p["s"] + _START + e[0]
        back = np.empty(e.shape, dtype=np.int8)
        for i in range(1, len(e)):
            way = best[:, :, None] + t
            back[i] = way.argmax(1)
            best = np.take_along_axis(way, back[i][:, None, :].astype(np.int64), 1)[:, 0, :] + e[i]
        tags = np.empty(c.shape, dtype=np.int64)
        tags[-1] = (best + self.p["e"]).argmax(1)
        rows = np.arange(c.shape[1])
        for i in range(len(e) - 1, 0, -1):
            tags[i - 1] = back[i][rows, tags[i]]
        return tags, e


def _order() -> tuple[np.ndarray, np.ndarray]:
    inside = {2 + 2 * k for k in range(len(KINDS))}
    t = np.zeros((TAGS, TAGS), np.float32)
    for a in range(TAGS):
        for b in inside:
            if a not in (b, b - 1):
                t[a, b] = -1e4
    s = np.array([-1e4 if b in inside else 0 for b in range(TAGS)], np.float32)
    return t, s


_ORDER, _START = _order()


def tag_row(n: int, spans: Sequence[Span]) -> np.ndarray:
    """Tags of a text of ``n`` characters; earlier spans win where they overlap."""
    y = np.zeros(n, dtype=np.int64)
    for kind, a, b in spans:
        if not y[a:b].any():
            k = KINDS.index(kind)
            y[a:b] = 2 + 2 * k
            y[a] = 1 + 2 * k
    return y


def windows(c: np.ndarray, hot: np.ndarray) -> list[int]:
    """Starts of the windows that hold a hot character (digit or at sign)."""
    if not hot.any():
        return []
    starts = np.arange(0, max(len(c) - WINDOW, 0) + STRIDE, STRIDE)
    held = np.concatenate(([0], np.cumsum(hot)))
    return starts[held[np.minimum(starts + WINDOW, len(c))] > held[np.minimum(starts, len(c))]].tolist()


def fit(rows: Sequence[tuple[np.ndarray, np.ndarray]], steps: int = 360, batch: int = 64, rate: float = 0.02,
        seed: int = 5) -> Tagger | None:
    """Train on (classes, tags) windows of WINDOW characters: ``steps`` Adam steps,
    whatever the number of windows, over one shuffle of them after the other."""
    if not rows:
        return None
    model, rng = Tagger.fresh(seed=seed), np.random.default_rng(seed)
    c, y = np.array([r[0] for r in rows]).T, np.array([r[1] for r in rows]).T
    m = {k: np.zeros_like(v) for k, v in model.p.items()}
    s = {k: np.zeros_like(v) for k, v in model.p.items()}
    order = np.concatenate([rng.permutation(c.shape[1]) for _ in range(-(-steps * batch // c.shape[1]))])
    for step in range(1, steps + 1):
        pick = order[(step - 1) * batch:step * batch]
        _, g = model.gradient(c[:, pick], y[:, pick])
        norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
        lr = rate * 0.25 ** (step / steps)
        for k, x in g.items():
            x = x * min(1.0, 5.0 / max(norm, 1e-9))
            m[k] += 0.1 * (x - m[k])
            s[k] += 0.01 * (x * x - s[k])
            model.p[k] -= (lr * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(s[k] / (1 - 0.99 ** step)) + 1e-7)).astype(np.float32)
    return model


def labelled_windows(docs: DataFrame, spans: str | None = None, most: int = 1_000, per_doc: int = 4) -> Tagger | None:
    """Train a tagger on a bounded sample: about ``most`` documents with a digit
    or at sign, at most ``per_doc`` windows of each (both documented bounds).

    ``spans`` names a column of labelled spans (``kind:start:end``, comma-joined);
    without one the base spans are the labels.  Windows reach the driver as
    WINDOW class numbers and tags."""
    columns = ["doc_id", "text", *([spans] if spans else [])]
    asked = (docs.select(*columns).where(F.col("text").rlike("[0-9@]"))
             .withColumn("_one", F.lit(1)))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        release()
        for frame in small_batches(frames):
            out = []
            for r in frame.itertuples(index=False):
                text = r.text
                marked = base_spans(text) if not spans else [
                    (k, int(a), int(b)) for k, a, b in (x.split(":") for x in (getattr(r, spans) or "").split(",") if x)]
                c, y = classes(text), tag_row(len(text), marked)
                for a in windows(c, (c == 2) | (c == 6 + _SYMBOLS.index("@")))[:per_doc]:
                    wc, wy = np.zeros(WINDOW, np.int8), np.zeros(WINDOW, np.int8)
                    wc[:len(c[a:a + WINDOW])], wy[:len(y[a:a + WINDOW])] = c[a:a + WINDOW], y[a:a + WINDOW]
                    if wy[0] and wy[0] % 2 == 0:                # a span cut by the window's edge
                        wy[0] -= 1
                    out.append((r.doc_id, a, wc.tobytes() + wy.tobytes()))
            yield pd.DataFrame(out, columns=["doc_id", "a", "w"])

    rows = (hash_sample(asked, "_one", most).mapInPandas(run, f"doc_id {dict(docs.dtypes)['doc_id']}, a long, w binary").toPandas()
            .sort_values(["doc_id", "a", "w"], kind="stable"))
    arrays = [np.frombuffer(bytes(w), np.int8).astype(np.int64) for w in rows["w"]]
    return fit([(a[:WINDOW], a[WINDOW:]) for a in arrays])


class Finder:
    """Base and model spans of texts, many windows of many texts at a time."""

    def __init__(self, model: Tagger | None, margin: float = 6.0, batch: int = 512):
        self.model, self.margin, self.batch = model, margin, batch

    def find(self, many: Sequence[str]) -> list[tuple[list[Span], list[Span]]]:
        """Per text: its base spans, and base and model spans together (by kind
        as listed, then by start)."""
        base = [base_spans(t) for t in many]
        if self.model is None:
            return [(b, b) for b in base]
        places, rows = [], []
        added: list[list[Span]] = [[] for _ in many]
        for i, text in enumerate(many):
            if not MAYBE.search(text):
                continue
            c = classes(text)
            for a in windows(c, (c == 2) | (c == 6 + _SYMBOLS.index("@"))):
                row = np.zeros(WINDOW, np.int64)
                part = c[a:a + WINDOW]
                row[:len(part)] = part
                places.append((i, a, len(part), len(c)))
                rows.append(row)
                if len(rows) == self.batch:
                    self._decode(many, places, rows, base, added)
        if rows:
            self._decode(many, places, rows, base, added)
        out = []
        for b, extra in zip(base, added, strict=True):
            both = sorted(set(b) | set(extra), key=lambda s: (KINDS.index(s[0]), s[1], s[2])) if extra else b
            out.append((b, both))
        return out

    def _decode(self, many, places, rows, base, added) -> None:
        tags, e = self.model.decode(np.array(rows).T)
        for w, (i, a, n, total) in enumerate(places):
            t = tags[:n, w]
            begins = np.flatnonzero(t % 2 == 1)
            for s in begins.tolist():
                k, end = (int(t[s]) - 1) // 2, s + 1
                while end < n and t[end] == t[s] + 1:
                    end += 1
                middle = (s + end) / 2
                # the window whose centre is nearest owns the span's middle
                if (a > 0 and middle < (WINDOW - STRIDE) / 2) or (a + WINDOW < total and middle >= (WINDOW + STRIDE) / 2):
                    continue
                if (s == 0 and a > 0) or (end == n and a + n < total):
                    continue                                        # cut by the edge: a longer span than a window
                found = many[i][a + s:a + end]
                score = float(e[s:end, w, :][np.arange(end - s), t[s:end]].sum() - e[s:end, w, 0].sum())
                if (MAYBE.search(found) and score >= self.margin
                        and all(a + end <= x or a + s >= y for _, x, y in base[i])
                        and all(a + end <= x or a + s >= y for _, x, y in added[i])):
                    added[i].append((KINDS[k], a + s, a + end))
        places.clear(), rows.clear()


def joined(spans: Sequence[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find_spans(docs: DataFrame, model: Tagger | None) -> DataFrame:
    """doc_id, base (joined base spans) and spans (all spans) for every document."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        release()
        finder = Finder(model)
        for frame in small_batches(frames):
            found = finder.find(frame["text"].tolist())
            yield pd.DataFrame({"doc_id": frame["doc_id"], "base": [joined(b) for b, _ in found],
                                "spans": [joined(s) for _, s in found]})

    return texts(docs).mapInPandas(run, f"doc_id {dict(docs.dtypes)['doc_id']}, base string, spans string")


def redact_text(text: str, spans: Sequence[Span]) -> str:
    """The text with every span replaced by ``[KIND]``; overlapping spans become
    one mark of the first kind."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, model: Tagger | None) -> DataFrame:
    """``docs`` with spans in ``text`` replaced; null texts stay null and
    ``n_chars``, where it is a column, follows the new text."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        release()
        finder = Finder(model)
        for frame in small_batches(frames):
            frame = frame.copy()
            raw = [t if isinstance(t, str) else None for t in frame["text"]]
            found = finder.find([t or "" for t in raw])
            frame["text"] = [None if t is None else redact_text(t, s) if s else t
                             for t, (_, s) in zip(raw, found, strict=True)]
            yield frame

    clean = small_transfers(docs).mapInPandas(run, docs.schema)
    return clean.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else clean
