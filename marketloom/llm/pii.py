"""Personal data: fixed patterns, and a character-level bidirectional LSTM with CRF transitions that adds spans.

The base spans (``base_spans``) are exact matches of the patterns. The network is trained in numpy on
windows around base spans of a bounded sample of documents, and on rewritten forms of the same spans
(other separators, spelled-out signs, neighbours without a gap) that the patterns miss. Overlapping
windows cover every digit, ``@``, ``(at)`` and ``[at]`` of the whole text; each is decoded, pieces of one span that
windows share are stitched, and of conflicting spans the set of highest total confidence stays
(weighted interval scheduling over the whole text). Of these, spans that touch no base span, are
confident, and pass their kind's arithmetic (Luhn, octets, number of digits) are added.

All four kinds hold a digit, ``@`` or a spelled-out sign, ``(at)`` or ``[at]``, so texts and windows without any of
these are settled without the network. Spelled-out addresses have no label: windows with one are no training examples.

Edge cases: a null text is empty and has no span. A text of any length is read whole, in windows.
Without any base span in the sample there is no network, and base spans are all. Repeated rows
are read each for itself; a null doc_id is kept. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256
from itertools import accumulate
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, fresh, shared, small_batches, table, thinned

KINDS = ("email", "ip", "card", "phone")
TAGS = 1 + 2 * len(KINDS)  # O, then B and I of each kind
#: Signs of an address, in the forms that ``plausible`` takes for one.
SPELLED = r"\(at\)|\[at\]"
TRIGGER = rf"[0-9@]|{SPELLED}"
WINDOW, STRIDE = 96, 48
SAMPLE_DOCS, SAMPLE_WINDOWS, OF_TEXT = 60_000, 400, 2
STEPS, BATCH, HIDDEN, EMBED, RATE = 800, 48, 16, 12, 0.02
#: Ways to rewrite a span of each kind that the network is trained on.
WAYS = (0, 1, 2, 3)
SURE = 0.6
Span = tuple[str, int, int]

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DIGITS = frozenset("0123456789")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")  # from the start of a run of digits: inner starts fail where it fails
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    double = [int(d) * 2 for d in digits[-2::-2]]
    return (sum(map(int, digits[::-2])) + sum(d - 9 if d > 9 else d for d in double)) % 10 == 0


def digits_of(text: str) -> str:
    return re.sub(r"[^0-9]", "", text)


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each kind, by start and kind; those that fail the kind's test are dropped."""
    found: list[Span] = []
    free, at = 0, text.find("@")
    while at >= 0:  # from each sign back over the local part: linear in the text, as a search from the left is not
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            found.append(("email", start, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    found += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]
    found += [("card", m.start(), m.end()) for m in CARD.finditer(text) if 14 <= len(d := digits_of(m[0])) <= 19 and luhn(d)]
    if "+" in text:
        found += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 10 <= len(digits_of(m[0])) <= 15]
    return ordered(found)


def ordered(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def plausible(kind: str, text: str) -> bool:
    """Whether a span of the network is such data, once signs are written plainly."""
    if kind == "email":
        plain = re.sub(rf"\s*(?:{SPELLED}|@)\s*", "@", text)
        return plain.count("@") == 1 and base_spans(plain)[:1] == [("email", 0, len(plain))]
    if kind == "ip":
        parts = re.split(r"\s*\.\s*", text)
        return len(parts) == 4 and all(p.isascii() and p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in parts)
    digits = digits_of(text)
    if kind == "card":
        return bool(re.fullmatch(r"[0-9][0-9 ._/-]*[0-9]", text)) and 14 <= len(digits) <= 19 and luhn(digits)
    return bool(re.fullmatch(r"[+(]?[0-9][0-9 ().+/-]*[0-9]", text)) and 10 <= len(digits) <= 15 and len(re.split(r"[^0-9]+", text.strip("+("))) > 1


CLASSES = {c: i for i, c in enumerate("\n abcdefghijklmnopqrstuvwxyz0@.+-_()[]%/,:;=\"'<>#*!?$&", 2)}
VOCABULARY = len(CLASSES) + 2  # 0: beyond the text, 1: any other character


def encode(text: str) -> np.ndarray:
    low = [c.lower() for c in text]
    ids = [CLASSES["0"] if c in "0123456789" else CLASSES.get(c, CLASSES["e"] if c.isalpha() else 1) for c in low]
    return np.array(ids + [0] * (WINDOW - len(ids)), np.int64)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-x))


def log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


@dataclass
class Tagger:
    """Parameters by name; directions are stacked in the first axis of ``wx``, ``wh`` and ``b``."""

    p: dict[str, np.ndarray]

    @classmethod
    def new(cls, seed: int = 7) -> Tagger:
        rng = np.random.default_rng(seed)
        draw = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[-2]), shape).astype(np.float32)
        b = np.zeros((2, 1, 4 * HIDDEN), np.float32)
        b[..., HIDDEN : 2 * HIDDEN] = 1.0
        zeros = lambda *shape: np.zeros(shape, np.float32)
        return cls({"emb": draw(VOCABULARY, EMBED) * 3, "wx": draw(2, EMBED, 4 * HIDDEN), "wh": draw(2, HIDDEN, 4 * HIDDEN), "b": b, "wo": draw(2 * HIDDEN, TAGS), "bo": zeros(TAGS), "move": zeros(TAGS, TAGS), "start": zeros(TAGS)})

    def emissions(self, ids: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """(positions, windows, tags)."""
        p, (n, t) = self.p, ids.shape
        x = p["emb"][ids].transpose(1, 0, 2)
        x = np.stack([x, x[::-1]])
        pre = x @ p["wx"][:, None] + p["b"][:, None]
        h = c = np.zeros((2, n, HIDDEN), np.float32)
        hs, cs, gates = [], [], []
        for k in range(t):
            z = pre[:, k] + h @ p["wh"]
            s, g = sigmoid(z[..., : 3 * HIDDEN]), np.tanh(z[..., 3 * HIDDEN :])
            i, f, o = s[..., :HIDDEN], s[..., HIDDEN : 2 * HIDDEN], s[..., 2 * HIDDEN :]
            c = f * c + i * g
            h = o * np.tanh(c)
            hs.append(h)
            if keep is not None:
                cs.append(c)
                gates.append((i, f, o, g))
        both = np.stack(hs, 1)
        out = np.concatenate([both[0], both[1][::-1]], axis=-1)
        if keep is not None:
            keep |= {"x": x, "hs": hs, "cs": cs, "gates": gates, "out": out}
        return out @ p["wo"] + p["bo"]

    def chain(self, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Forward and backward log sums of the CRF, and the log partition of each window."""
        move = self.p["move"]
        fwd, back = np.empty_like(e), np.zeros_like(e)
        fwd[0] = e[0] + self.p["start"]
        for k in range(1, len(e)):
            fwd[k] = e[k] + log_sum(fwd[k - 1][:, :, None] + move, 1)
        for k in range(len(e) - 2, -1, -1):
            back[k] = log_sum(move + (e[k + 1] + back[k + 1])[:, None, :], 2)
        return fwd, back, log_sum(fwd[-1], 1)

    def gradients(self, ids: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Negative log-likelihood of ``tags`` per window, and its gradients."""
        p, keep, n = self.p, {}, len(ids)
        e = self.emissions(ids, keep)
        fwd, back, whole = self.chain(e)
        t, y = len(e), tags.T
        rows = np.arange(n)
        gold = p["start"][y[0]] + sum(e[k, rows, y[k]] for k in range(t)) + sum(p["move"][y[k - 1], y[k]] for k in range(1, t))
        de = np.exp(fwd + back - whole[:, None])
        pairs = np.exp(fwd[:-1, :, :, None] + p["move"] + (e[1:] + back[1:])[:, :, None, :] - whole[:, None, None]).sum(axis=(0, 1))
        np.subtract.at(pairs, (y[:-1].ravel(), y[1:].ravel()), 1.0)
        g = {"move": pairs, "start": de[0].sum(0) - np.bincount(y[0], minlength=TAGS)}
        np.subtract.at(de, (np.arange(t)[:, None], rows[None], y), 1.0)
        g["wo"] = np.tensordot(keep["out"], de, ((0, 1), (0, 1)))
        g["bo"] = de.sum((0, 1))
        dout = de @ p["wo"].T
        dh_all = np.stack([dout[..., :HIDDEN], dout[::-1, :, HIDDEN:]])
        dh = dc = np.zeros((2, n, HIDDEN), np.float32)
        dz_all = np.empty((2, t, n, 4 * HIDDEN), np.float32)
        back_h = p["wh"].transpose(0, 2, 1)
        zero = np.zeros((2, n, HIDDEN), np.float32)
        for k in range(t - 1, -1, -1):
            i, f, o, u = keep["gates"][k]
            c = np.tanh(keep["cs"][k])
            before = keep["cs"][k - 1] if k else zero
            dh = dh + dh_all[:, k]
            dc = dc + dh * o * (1 - c * c)
            dz_all[:, k] = np.concatenate([dc * u * i * (1 - i), dc * before * f * (1 - f), dh * c * o * (1 - o), dc * i * (1 - u * u)], axis=-1)
            dh = dz_all[:, k] @ back_h
            dc = dc * f
        hs = np.stack([zero, *keep["hs"][:-1]], 1)
        g["wh"] = np.einsum("dtnh,dtnz->dhz", hs, dz_all, optimize=True)
        g["wx"] = np.einsum("dtne,dtnz->dez", keep["x"], dz_all, optimize=True)
        g["b"] = dz_all.sum((1, 2))[:, None]
        dx = dz_all @ p["wx"].transpose(0, 2, 1)[:, None]
        dx = dx[0] + dx[1][::-1]
        g["emb"] = np.zeros_like(p["emb"])
        np.add.at(g["emb"], ids.T, dx)
        return float((whole - gold).mean()), {k: v / n for k, v in g.items()}

    def train(self, ids: np.ndarray, tags: np.ndarray, steps: int = STEPS, seed: int = 11) -> float:
        """Adam on batches; the last loss."""
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        loss = 0.0
        for step in range(1, steps + 1):
            some = rng.integers(0, len(ids), BATCH)
            loss, g = self.gradients(ids[some], tags[some])
            scale = min(1.0, 5.0 / (1e-9 + float(np.sqrt(sum((x**2).sum() for x in g.values())))))
            rate = RATE * (1 - step / (steps + 1))
            for k, x in g.items():
                m[k] = 0.9 * m[k] + 0.1 * x * scale
                v[k] = 0.99 * v[k] + 0.01 * (x * scale) ** 2
                self.p[k] = (self.p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return loss

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Viterbi tags of each window and the posterior probability of each chosen tag, both (windows, positions)."""
        e = self.emissions(ids)
        fwd, back, whole = self.chain(e)
        best, frm = e[0] + self.p["start"], []
        for k in range(1, len(e)):
            all_ = best[:, :, None] + self.p["move"]
            frm.append(all_.argmax(1))
            best = all_.max(1) + e[k]
        tags = np.empty(e.shape[:2], np.int64)
        tags[-1] = best.argmax(1)
        rows = np.arange(len(ids))
        for k in range(len(e) - 2, -1, -1):
            tags[k] = frm[k][rows, tags[k + 1]]
        sure = np.exp(fwd + back - whole[:, None])[np.arange(len(e))[:, None], rows[None], tags]
        return tags.T, sure.T


def window_starts(text: str) -> list[int]:
    """Starts of the overlapping windows that hold a digit, @ or a spelled-out sign."""
    found: set[int] = set()
    last = -1
    for m in re.finditer(TRIGGER, text):
        if m.start() != last:
            k = m.start() // STRIDE
            found.update(x * STRIDE for x in (k - 1, k) if x >= 0)
            last = m.start()
    return sorted(found)


def reconcile(spans: list[tuple[str, int, int, float]]) -> list[tuple[str, int, int, float]]:
    """Stitch overlapping spans of a kind, then choose the disjoint set of the highest total confidence."""
    stitched: list[tuple[str, int, int, float]] = []
    for kind in KINDS:
        for k, a, b, sure in sorted(s for s in spans if s[0] == kind):
            if stitched and stitched[-1][0] == k and a < stitched[-1][2]:
                _, a0, b0, sure0 = stitched[-1]
                stitched[-1] = (k, a0, max(b, b0), max(sure, sure0))
            else:
                stitched.append((k, a, b, sure))
    by_end = sorted(stitched, key=lambda s: (s[2], s[1]))
    ends = [s[2] for s in by_end]
    total, taken = [0.0], []
    for i, (_, a, b, sure) in enumerate(by_end):
        j = int(np.searchsorted(ends[:i], a, side="right"))
        gain = total[j] + sure * (b - a)
        taken.append((j, gain > total[i]))
        total.append(max(gain, total[i]))
    out, i = [], len(by_end)
    while i:
        j, take = taken[i - 1]
        if take:
            out.append(by_end[i - 1])
            i = j
        else:
            i -= 1
    return out[::-1]


def added_spans(tagger: Tagger, texts: list[str], base: list[list[Span]]) -> list[list[Span]]:
    """What the network adds to the base spans of each text."""
    places = [(i, at) for i, text in enumerate(texts) for at in window_starts(text)]
    found: list[list[tuple[str, int, int, float]]] = [[] for _ in texts]
    for k in range(0, len(places), 512):
        part = places[k : k + 512]
        tags, sure = tagger.decode(np.stack([encode(texts[i][at : at + WINDOW]) for i, at in part]))
        for (i, at), row, s in zip(part, tags, sure, strict=True):
            if not row.any():
                continue
            heads = [j for j in np.flatnonzero(row) if row[j] % 2 == 1 or row[j - 1] not in (row[j], row[j] - 1) or j == 0]
            for a in heads:
                kind = (int(row[a]) - 1) // 2
                b = a + 1
                while b < WINDOW and row[b] == 2 * kind + 2:
                    b += 1
                found[i].append((KINDS[kind], at + a, min(at + b, len(texts[i])), float(s[a:b].mean())))
    out = []
    for text, own, spans in zip(texts, base, found, strict=True):
        more = []
        for kind, a, b, sure in reconcile(spans):
            while a < b and text[a].isspace():
                a += 1
            while b > a and text[b - 1].isspace():
                b -= 1
            a, b = widened(kind, text, a, b)
            if sure < SURE or any(a < y and x < b for _, x, y in own):
                continue
            # neighbours of a kind without a boundary tag between them are told apart by blanks
            parts = [(a, b)] if plausible(kind, text[a:b]) else [(a + m.start(), a + m.end()) for m in re.finditer(r"\S+", text[a:b])]
            more += [(kind, int(x), int(y)) for x, y in parts if plausible(kind, text[x:y])]
        out.append(more)
    return out


def widened(kind: str, text: str, a: int, b: int) -> tuple[int, int]:
    """The span with the rest of the names or numbers that its ends cut."""
    head, tail = (LOCAL, LOCAL - set("_%+")) if kind == "email" else (DIGITS, DIGITS)
    while 0 < a < len(text) and text[a] in head and text[a - 1] in head:
        a -= 1
    while 0 < b < len(text) and text[b - 1] in tail and text[b] in tail:
        b += 1
    while kind == "email" and b > a and text[b - 1] in ".-":
        b -= 1
    return a, b


def rewritten(rng: np.random.Generator, kind: str, text: str, ways: tuple = WAYS) -> str:
    """Another way to write a span, which the patterns may miss."""
    way = int(rng.choice(ways))
    if kind == "email":
        return text.replace("@", (" @ ", "(at)", " [at] ", " (at) ")[way], 1)
    if kind == "ip":
        return text.replace(".", (" . ", ". ", " .", ".")[way])
    if kind == "card":
        digits = digits_of(text)
        return (".", "  ", "/", "_")[way].join(digits[i : i + 4] for i in range(0, len(digits), 4))
    digits = digits_of(text)[-10:]
    return (f"({digits[:3]}) {digits[3:6]}-{digits[6:]}", f"{digits[:3]}-{digits[3:6]}-{digits[6:]}", f"{digits[:3]}.{digits[3:6]}.{digits[6:]}", f"+{digits[:3]}/{digits[3:6]}/{digits[6:]}")[way]


def relettered(rng: np.random.Generator, text: str) -> str:
    """An address of the same shape: other letters, and letters for most digits; parts grow or lose letters."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    draw = lambda n: "".join(letters[i] for i in rng.integers(0, 26, n))
    out = [c if not c.isalnum() or (c.isdigit() and rng.random() < 0.3) else draw(int(rng.choice((0, 1, 1, 1, 2)))) for c in text]
    parts = re.split(r"([@.])", "".join(out))
    return "".join(p or draw(3) for p in parts)


def examples(windows: list[tuple[str, list[Span]]], seed: int = 5, ways: tuple = WAYS) -> tuple[np.ndarray, np.ndarray]:
    """Encoded windows and tags: each window as it is, with its spans rewritten or doubled, and each span in each way in windows without any."""
    rng = np.random.default_rng(seed)
    ids, tags = [], []

    def put(text: str, spans: list[Span]) -> None:
        row = np.zeros(WINDOW, np.int64)
        for kind, a, b in spans:
            if a < WINDOW:
                tag = 1 + 2 * KINDS.index(kind)
                row[a : min(b, WINDOW)] = tag + 1
                row[a] = tag
        ids.append(encode(text[:WINDOW]))
        tags.append(row)

    clean = [text for text, spans in windows if not spans]
    for text, spans in windows:
        put(text, spans)
        if not spans:
            continue
        for (kind, a, b), way in ((s, w) for s in spans for w in ways if clean):
            span = relettered(rng, text[a:b]) if kind == "email" and rng.random() < 0.7 else text[a:b]
            new, host = rewritten(rng, kind, span, (way,)), clean[int(rng.integers(len(clean)))]
            at = int(rng.integers(0, max(1, WINDOW - len(new) - 1)))
            before = host[:at].rpartition(" ")[0]
            before += " " if before else ""
            put(f"{before}{new} {host[at:].partition(' ')[2]}", [(kind, len(before), len(before) + len(new))])
        other, moved, at = "", [], 0
        for kind, a, b in spans:
            if a < at:
                continue
            new = text[a:b] + " " + text[a:b] if kind == "card" and rng.random() < 0.3 else rewritten(rng, kind, text[a:b], ways)
            other += text[at:a]
            if kind == "card" and len(new) == 2 * (b - a) + 1:
                moved += [(kind, len(other), len(other) + b - a), (kind, len(other) + b - a + 1, len(other) + len(new))]
            else:
                moved.append((kind, len(other), len(other) + len(new)))
            other += new
            at = b
        put(other + text[at:], moved)
    return np.stack(ids), np.stack(tags)


def fit(docs: DataFrame, sample: int = SAMPLE_WINDOWS, ways: tuple = WAYS) -> Tagger | None:
    """Train on windows of about ``SAMPLE_DOCS`` documents: at most ``sample`` of each kind, and as many without a span.

    Windows are drawn by hash, from all of a text: ``OF_TEXT`` of each kind at most, so that a list of numbers does not fill the sample.
    """

    @F.pandas_udf("array<struct<kind:string,text:string,kinds:array<string>,places:array<int>>>")
    def windows(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out = []
            for text in texts:
                base, rows = base_spans(text), []
                starts, ends = [a for _, a, _ in base], list(accumulate((b for _, _, b in base), max))
                seen: dict[str, int] = {}
                for at in sorted(window_starts(text), key=lambda at: crc32(f"{at} {text[at : at + WINDOW]}".encode())):
                    own = [s for s in base[bisect_right(ends, at) : bisect_left(starts, at + WINDOW)] if s[2] > at]
                    kind = own[0][0] if own else "none"
                    cut = any(a < at or b > at + WINDOW for _, a, b in own)
                    if cut or seen.get(kind, 0) >= OF_TEXT or re.search(SPELLED, text[at : at + WINDOW]):
                        continue
                    seen[kind] = seen.get(kind, 0) + 1
                    rows.append({"kind": kind, "text": text[at : at + WINDOW], "kinds": [s[0] for s in own], "places": [x for s in own for x in (s[1] - at, s[2] - at)]})
                out.append(rows)
            yield pd.Series(out)

    some = thinned(docs, SAMPLE_DOCS, "doc_id").where(F.col("text").rlike(TRIGGER)).select(F.explode(windows("text")).alias("w"))
    nth = F.row_number().over(Window.partitionBy("kind").orderBy(F.xxhash64("text"), "text"))
    with small_batches(docs.sparkSession):
        drawn = some.select("w.*").withColumn("nth", nth).where(F.col("nth") <= sample).orderBy("kind", "nth").collect()  # `sample` of each kind
    got = [(r["text"], [(k, r["places"][2 * i], r["places"][2 * i + 1]) for i, k in enumerate(r["kinds"])]) for r in drawn]
    if not any(spans for _, spans in got):
        return None
    tagger = Tagger.new()
    tagger.train(*examples(got, ways=ways))
    return tagger


def spans_of(spark: SparkSession, tagger: Tagger | None) -> Column:
    """Struct (base, added: arrays of kind, start, end; redacted: the text with ``<KIND>`` for each span) of column ``text``.

    Null where the text has no ``TRIGGER``.
    """
    learned = shared(spark, tagger)  # a few thousand numbers
    kind = "array<struct<kind:string,start:int,end:int>>"

    @F.pandas_udf(f"base {kind}, added {kind}, redacted string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        tagger = learned()
        for texts in batches:
            whole = [t or "" for t in texts]
            base = [base_spans(t) if t else [] for t in whole]
            more = added_spans(tagger, whole, base) if tagger else [[] for _ in whole]
            hidden = [redact(t, b + m) if b or m else t for t, b, m in zip(whole, base, more, strict=True)]
            yield pd.DataFrame({"base": base, "added": more, "redacted": hidden})

    return run(F.when(F.col("text").rlike(TRIGGER), F.col("text")))


def redact(text: str, spans: list[Span]) -> str:
    out, at = [], 0
    for kind, a, b in ordered(spans):
        if a >= at:
            out += [text[at:a], f"<{kind.upper()}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def find(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``doc_id, base, added`` (arrays of kind, start, end) for every row of ``docs`` (doc_id, text)."""
    rows = docs.select(F.col("doc_id").cast("long"), "text").withColumn("found", spans_of(spark, fit(docs)))
    with small_batches(spark):
        return Scratch(spark, "pii").finish(rows.select("doc_id", "found.base", "found.added"))


def redacted(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``docs`` with every span of ``text`` replaced by its kind, and ``n_chars`` to match."""
    name = fresh(docs, "_found")
    out = docs.withColumn(name, spans_of(spark, fit(docs)))
    text = F.when(F.col("text").rlike(TRIGGER), F.col(name)["redacted"]).otherwise(F.col("text"))
    out = out.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    with small_batches(spark):
        return Scratch(spark, "pii").finish(out.select(docs.columns))


def joined(spans: Column) -> Column:
    """``kind:start:end`` by start, then kind as listed, joined by commas."""
    rank = F.create_map(*[F.lit(x) for i, k in enumerate(KINDS) for x in (k, i)])
    keyed = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("a"), rank[s["kind"]].alias("k"), s["end"].alias("b"), s["kind"].alias("kind"))))
    return F.array_join(F.transform(keyed, lambda s: F.concat_ws(":", s["kind"], s["a"].cast("string"), s["b"].cast("string"))), ",")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(spark, table(spark, sf_dir, "documents"))
    none = F.array().cast("array<struct<kind:string,start:int,end:int>>")
    found = found.select("doc_id", F.coalesce("base", none).alias("base"), F.coalesce("added", none).alias("added"))
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [F.size(F.filter(kinds, (lambda k: lambda x: x == k)(kind))).cast("long").alias(f"n_{kind}") for kind in KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.concat("base", "added")).alias("spans"))


def brute_digest(text: str) -> str:
    return sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base_spans(text)).encode()).hexdigest()
