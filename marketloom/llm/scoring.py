"""Masked pseudo-likelihood of documents: every token predicted from both sides by a window network.

A token is a lower-cased word, hashed to one of 2 ** 18 buckets: six bits from its ending (the class) and twelve from the
word, of which six are the cell within its class. The network sums embeddings of the cells of ``SIDE`` tokens on the left
and on the right by position, and predicts the masked token between them in two steps: its class, and its cell within
that class, by a softmax of the class's own. Of its 64 cell mates a token has its share of the corpus counts. A document's
score is the sum over its tokens of the logarithm of all three.

Counts cover every token of all documents, and the network trains on every token (``every`` takes one in so many, by a hash
of the window). Blocks of tokens are dealt to parts of bounded size by contents, doc_id and place, so that copies of a text spread,
each part takes steps of Adam in numpy from the common weights, and the weights are averaged through a tree of groups,
once for each epoch: reruns agree, however the rows lie.
Only averaged weights and bucket counts reach the driver, whose sizes do not depend on the corpus.

Edge cases: a text that is null or blank has no tokens and score 0. Repeated rows are counted and scored each for
itself, alike but for rounding (rows are scored in blocks); a null doc_id is kept. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Generations, Scratch, shared, table, worker_wide

CLASSES, CELLS, LEAF_BITS = 64, 64, 6
NODES = CLASSES * CELLS
BUCKETS = NODES << LEAF_BITS
SIDE = 2
WIDTH = 2 * SIDE + 1
HIDDEN = 16
EVERY = 1
EPOCHS = 1
BATCH, STEPS = 512, 128  # the least windows of a step of Adam, and the most steps of a part
RATE = 0.03
PART = 524_288
FAN = 16
CHUNK = 1 << 13
EDGE = NODES  # the cell beyond the ends of a text
CACHE = 200_000
SAFE = 40  # exponentials of scores up to it, their sums and those times a batch fit single floats


def class_of(ending: bytes) -> int:
    return zlib.crc32(ending) & 63


def bucket(word: bytes) -> int:
    return class_of(word[-2:]) << 12 | zlib.crc32(word) >> 20


def word_buckets() -> Generations:
    """The classes of endings. Whole words are hashed anew: in large tables so many occur once that to look them up costs more."""
    return worker_wide("word endings", lambda: Generations(class_of, CACHE))


def buckets(known: Generations, text: str | None) -> np.ndarray:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    out = np.fromiter(map(known.__getitem__, [w[-2:] for w in words]), np.int32, len(words))
    out <<= 12
    out |= (np.fromiter(map(zlib.crc32, words), np.uint32, len(words)) >> np.uint32(20)).astype(np.int32)
    return out


def windows_of(padded: np.ndarray, every: int) -> np.ndarray:
    """Windows (rows of ``WIDTH`` cells, the token in the middle) of a block with its margins, or one in ``every`` by a hash of the window."""
    whole = np.lib.stride_tricks.sliding_window_view(padded, WIDTH)
    if every == 1:
        return whole
    h = np.zeros(len(whole), np.uint32)
    for k in range(WIDTH):
        h = (h ^ whole[:, k]) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
    return whole[h < np.uint32(min(0xFFFFFFFF, (1 << 32) // every))]


def gather(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counts of a task's tokens by bucket, and the cells of each text in blocks of ``CHUNK`` tokens with ``SIDE`` cells before and after them."""
    known, counts = word_buckets(), np.zeros(BUCKETS, np.int64)
    edge = np.full(SIDE, EDGE, np.uint16)
    kinds = {"bucket": "Int32", "n": "Int64", "id": "Int64", "place": "Int32"}
    for batch in batches:
        found, all_ = [], [np.zeros(0, np.int32)]
        for id_, text in zip(batch["doc_id"], batch["text"], strict=True):
            b = buckets(known, text)
            all_.append(b)
            padded = np.concatenate([edge, (b >> LEAF_BITS).astype(np.uint16), edge])
            for at in range(0, len(b), CHUNK):
                found.append((pd.NA, min(CHUNK, len(b) - at), id_, at // CHUNK, padded[at : at + CHUNK + 2 * SIDE].tobytes()))
        counts += np.bincount(np.concatenate(all_), minlength=BUCKETS)
        yield pd.DataFrame(found, columns=[*kinds, "cells"]).astype(kinds)
    some = np.flatnonzero(counts)
    yield pd.DataFrame({"bucket": some, "n": counts[some], "id": pd.NA, "place": pd.NA, "cells": pd.Series([None] * len(some), dtype=object)}).astype(kinds)


@dataclass
class Network:
    """Embeddings ``t`` (2 SIDE, NODES + 1, HIDDEN) and ``b``; class softmax ``w``, ``c``; the classes' own ``ww``, ``cc``."""

    t: np.ndarray
    b: np.ndarray
    w: np.ndarray
    c: np.ndarray
    ww: np.ndarray
    cc: np.ndarray

    @staticmethod
    def shapes() -> list[tuple[int, ...]]:
        return [(2 * SIDE, NODES + 1, HIDDEN), (HIDDEN,), (HIDDEN, CLASSES), (CLASSES,), (CLASSES, HIDDEN, CELLS), (CLASSES, CELLS)]

    @classmethod
    def new(cls, counts: np.ndarray, seed: int = 3) -> Network:
        """Untrained: it predicts the shares of the ``counts`` of the nodes."""
        rng = np.random.default_rng(seed)
        t, b, w, c, ww, cc = (np.zeros(s, np.float32) for s in cls.shapes())
        shares = (counts + 0.5).reshape(CLASSES, CELLS)
        c[:] = np.log(shares.sum(1) / shares.sum())
        cc[:] = np.log(shares / shares.sum(1, keepdims=True))
        for x, scale in ((t, 0.3), (w, 0.1), (ww, 0.1)):
            x[:] = rng.normal(0, scale, x.shape)
        return cls(t, b, w, c, ww, cc)

    def parts(self) -> list[np.ndarray]:
        return [self.t, self.b, self.w, self.c, self.ww, self.cc]

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in self.parts()])

    @classmethod
    def of(cls, flat: np.ndarray) -> Network:
        """Views of ``flat``."""
        sizes = [int(np.prod(s)) for s in cls.shapes()]
        return cls(*[x.reshape(s) for x, s in zip(np.split(flat, np.cumsum(sizes)[:-1]), cls.shapes(), strict=True)])

    def hidden(self, around: np.ndarray) -> np.ndarray:
        h = self.t[0].take(around[:, 0], axis=0)
        for k in range(1, 2 * SIDE):
            h += self.t[k].take(around[:, k], axis=0)
        h += self.b
        return np.tanh(h, out=h)

    def own_scores(self, h: np.ndarray, runs: list[tuple[int, slice]], z: np.ndarray) -> np.ndarray:
        """Each row's scores of the cells of its own class, written over ``z``."""
        for k, own in runs:
            np.matmul(h[own], self.ww[k], out=z[own])
            z[own] += self.cc[k]
        return z

    def log_probability(self, around: np.ndarray, middle: np.ndarray) -> np.ndarray:
        """Of each row's ``middle`` cell, from the cells ``around`` it."""
        order, runs = by_class(middle)
        h, middle = self.hidden(around.T.take(order, axis=1).T), middle.take(order)
        z = h @ self.w
        z += self.c
        found = picked(z, middle // CELLS)
        found += picked(self.own_scores(h, runs, z), middle % CELLS)
        out = np.empty_like(found)
        out[order] = found
        return out

    def gradient(self, around: np.ndarray, middle: np.ndarray) -> tuple[float, np.ndarray]:
        """Mean negative log-probability and its gradient, flat."""
        order, runs = by_class(middle)
        sides, middle = around.T.take(order, axis=1), middle.take(order)
        h, n = self.hidden(sides.T), len(middle)
        flat = np.zeros(sum(int(np.prod(s)) for s in self.shapes()), np.float32)
        g, ones = Network.of(flat), np.ones(n, h.dtype)
        z = h @ self.w
        z += self.c
        loss, d = missed(z, middle // CELLS)
        g.w[:], g.c[:] = h.T @ d, ones @ d
        dh = d @ self.w.T
        part, d = missed(self.own_scores(h, runs, z), middle % CELLS)
        for k, own in runs:
            g.ww[k], g.cc[k] = h[own].T @ d[own], ones[own] @ d[own]
            dh[own] += d[own] @ self.ww[k].T
        h *= h
        dh *= np.subtract(1, h, out=h)
        g.b[:] = ones @ dh
        pairs = dh.astype(np.float32, copy=False).view(np.complex64).ravel()  # two units as one number: half as many additions
        unit = np.arange(HIDDEN // 2)
        for k in range(2 * SIDE):
            np.add.at(g.t[k].view(np.complex64).reshape(-1), (sides[k][:, None] * (HIDDEN // 2) + unit).ravel(), pairs)
        return (loss + part) / n, flat

    def trained(self, windows: np.ndarray, seed: int) -> Network:
        """One pass of Adam over ``windows`` of cells, in ``STEPS`` steps or fewer.

        ``m`` and ``v`` are ten and a hundred times the usual means, all in place: the constants are part of the step's.
        """
        x, rng = self.flat().astype(np.float32), np.random.default_rng(seed)
        m, v, step_of = np.zeros_like(x), np.zeros_like(x), np.empty_like(x)
        order, batch = rng.permutation(len(windows)), max(BATCH, -(-len(windows) // STEPS))
        for step, at in enumerate(range(0, len(order), batch), 1):
            some = windows.take(order[at : at + batch], axis=0).T.astype(np.int64, order="C")
            _, g = Network.of(x).gradient(np.delete(some, SIDE, axis=0).T, some[SIDE])
            m *= np.float32(0.9)
            m += g
            g *= g
            v *= np.float32(0.99)
            v += g
            unbiased = np.sqrt(0.01 / (1 - 0.99**step))
            np.sqrt(v, out=step_of)
            step_of += np.float32(1e-8 / unbiased)
            np.divide(m, step_of, out=step_of)
            step_of *= np.float32(RATE * 0.1 / (1 - 0.9**step) / unbiased)
            x -= step_of
        return Network.of(x)


def by_class(middle: np.ndarray) -> tuple[np.ndarray, list[tuple[int, slice]]]:
    """An order of the rows by the class of their ``middle`` cell, and each class with its run of rows in it."""
    cls = (middle // CELLS).astype(np.uint8)
    ends = np.cumsum(np.bincount(cls, minlength=CLASSES)).tolist()
    runs = [(k, slice(low, high)) for k, (low, high) in enumerate(zip([0, *ends], ends, strict=False)) if low < high]
    return np.argsort(cls, kind="stable"), runs


def exponentials(z: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Their sum for each row of ``z``, which turns into them; where they could leave float32 first less the row's largest, as ``own``, the row's at one place."""
    if max(z.max(initial=0), -z.min(initial=0)) > SAFE:
        top = z.max(axis=1)
        z -= top[:, None]
        own -= top
    np.exp(z, out=z)
    return z @ np.ones(z.shape[1], z.dtype)


def picked(z: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Log-softmax of each row at one place; ``z`` is used up."""
    own = z.ravel().take(np.arange(0, z.size, z.shape[1]) + at)
    own -= np.log(exponentials(z, own))
    return own


def missed(z: np.ndarray, at: np.ndarray) -> tuple[float, np.ndarray]:
    """Sum of the negative log-softmax at one place of each row, and the derivative of its mean, written over ``z``."""
    places = np.arange(0, z.size, z.shape[1]) + at
    own = z.ravel().take(places)
    whole = exponentials(z, own)
    loss = float((np.log(whole) - own).sum(dtype=np.float64))
    z *= (1 / (whole * z.dtype.type(len(z))))[:, None]
    z.reshape(-1)[places] -= z.dtype.type(1 / len(z))
    return loss, z


@dataclass
class Model:
    share: np.ndarray  # logarithm of each bucket's share of its cell
    network: Network

    def scores(self, texts: list[np.ndarray]) -> np.ndarray:
        """Sums over the tokens of each text (as buckets) of their log-probabilities."""
        total = np.zeros(len(texts))
        edge = np.full(SIDE, EDGE, np.int32)
        rows = np.concatenate([x for b in texts for x in (edge, b >> LEAF_BITS)] + [edge]) if texts else edge
        sizes = np.array([len(b) for b in texts], np.int64)
        of = np.repeat(np.arange(len(texts)), sizes)
        at = np.arange(len(of)) + SIDE * (of + 1)
        every = np.concatenate(texts) if texts else edge[:0]
        for low in range(0, len(at), CHUNK):
            here, own = at[low : low + CHUNK], slice(low, low + CHUNK)
            around = np.stack([rows[here + k] for k in range(-SIDE, SIDE + 1) if k], 1)
            total += np.bincount(of[own], self.network.log_probability(around, rows[here]) + self.share[every[own]].astype(np.float64), len(texts))
        return total


def shares(counts: np.ndarray) -> np.ndarray:
    """Logarithm of the smoothed share of each bucket among those of its cell."""
    smooth = (counts + 0.5).reshape(NODES, -1)
    return np.log(smooth / smooth.sum(axis=1, keepdims=True)).ravel().astype(np.float32)


def averaged(parts: DataFrame) -> np.ndarray:
    """Weighted mean of weights (part, n, flat) through groups of at most ``FAN``, until one group is left."""

    def mean(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("part")
        n = rows["n"].to_numpy(np.float64)
        flat = sum(np.frombuffer(x, np.float32) * (k / n.sum()) for x, k in zip(rows["flat"], n, strict=True))
        return pd.DataFrame({"part": [rows["part"].iloc[0] // FAN], "n": [int(n.sum())], "flat": [flat.astype(np.float32).tobytes()]})

    groups = parts.agg(F.max("part")).first()[0] + 1
    while groups > 1:
        parts = parts.groupBy(F.floor(F.col("part") / FAN).alias("g")).applyInPandas(mean, "part long, n long, flat binary")
        groups = -(-groups // FAN)
    return np.frombuffer(parts.first()["flat"], np.float32)


def trainer(network: Callable[[], Network], epoch: int, every: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """What a part makes of the common weights: one pass over its windows."""

    def train(rows: pd.DataFrame) -> pd.DataFrame:
        part = int(rows["part"].iloc[0])
        windows = np.concatenate([windows_of(np.frombuffer(x, np.uint16), every) for x in sorted(rows["cells"])])
        flat = network().trained(windows, 1000 * epoch + part % 997).flat()
        return pd.DataFrame({"part": [part], "n": [max(1, len(windows))], "flat": [flat.astype(np.float32).tobytes()]})

    return train


def dealt(blocks: DataFrame, every: int) -> tuple[DataFrame, int]:
    """``part``, ``cells`` of blocks (n, id, place, cells), in parts of about ``PART`` windows, and their number."""
    parts = -(-(blocks.agg(F.sum("n")).first()[0] or 0) // (PART * every))
    return blocks.select("cells", F.pmod(F.xxhash64("cells", "id", "place"), F.lit(max(1, parts))).alias("part")), parts


def fit(spark: SparkSession, docs: DataFrame, scratch: Scratch, epochs: int = EPOCHS, every: int = EVERY) -> Model:
    """Counts of all tokens, and the network trained on the windows of all tokens of ``docs`` (doc_id, text), or one in ``every``."""
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    found = scratch.save(rows.mapInPandas(gather, "bucket int, n long, id long, place int, cells binary"), "gathered")
    counts = np.zeros(BUCKETS, np.int64)
    got = found.where("bucket is not null").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()  # at most BUCKETS rows
    counts[got["bucket"]] = got["n"]
    network = Network.new(counts.reshape(NODES, -1).sum(1))
    blocks, parts = dealt(found.where("cells is not null"), every)
    if parts:
        blocks = scratch.save(blocks.repartition(min(parts, 2048), "part"), "blocks")
        scratch.drop("gathered")
        for epoch in range(epochs):
            train = trainer(shared(spark, network), epoch, every)
            trained = scratch.save(blocks.groupBy("part").applyInPandas(train, "part long, n long, flat binary"), f"weights-{epoch}")
            network = Network.of(averaged(trained))
            scratch.drop(f"weights-{epoch}")
        scratch.drop("blocks")
    return Model(shares(counts), network)


def score(spark: SparkSession, docs: DataFrame, model: Model | None = None) -> DataFrame:
    """``doc_id, n_tokens, pll, mean_pll`` for every row of ``docs`` (doc_id, text)."""
    scratch = Scratch(spark, "scoring")
    learned = shared(spark, model or fit(spark, docs, scratch))

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, m = word_buckets(), learned()
        for batch in batches:
            texts = [buckets(known, t) for t in batch["text"]]
            n, pll = np.array([len(b) for b in texts], np.int64), m.scores(texts)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n_tokens": n, "pll": pll, "mean_pll": pll / np.maximum(1, n)})

    found = docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(run, "doc_id long, n_tokens long, pll double, mean_pll double")
    return scratch.finish(found)


def op4_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(spark, table(spark, sf_dir, "documents"))
