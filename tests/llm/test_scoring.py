"""Masked pseudo-likelihood: counts, gradients, sums, and what the model has learned."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketloom.llm import scoring
from marketloom.llm.common import Scratch

DOC = "doc_id long, text string"


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="module")
def model(spark, docs):
    return scoring.fit(spark, docs, Scratch(spark, "test"))


def log_softmax(z):
    return z - z.max() - np.log(np.exp(z - z.max()).sum())


def token_by_token(model, b):
    """Log-probability of each token of a text (buckets), one at a time."""
    net, out = model.network, []
    cells = [x >> scoring.LEAF_BITS for x in b]
    for i, cell in enumerate(cells):
        h = net.b.astype(float)
        for k, j in enumerate((i - 2, i - 1, i + 1, i + 2)):
            h = h + net.t[k][cells[j] if 0 <= j < len(cells) else scoring.EDGE]
        h, (cls, own) = np.tanh(h), divmod(cell, scoring.CELLS)
        out.append(log_softmax(h @ net.w + net.c)[cls] + log_softmax(h @ net.ww[cls] + net.cc[cls])[own] + model.share[b[i]])
    return out


def test_scores_are_sums_of_conditional_log_probabilities(spark, docs, model):
    found = {r.doc_id: r for r in scoring.score(spark, docs, model).collect()}
    for d in docs.limit(5).collect():
        b = [scoring.bucket(w) for w in d.text.encode().lower().split()]
        assert found[d.doc_id].n_tokens == len(b) and found[d.doc_id].pll == pytest.approx(sum(token_by_token(model, b)), rel=1e-4)


def test_counts_cover_all_tokens(spark, docs, model):
    counts = np.zeros(scoring.BUCKETS, np.int64)
    for d in docs.collect():
        np.add.at(counts, [scoring.bucket(w) for w in d.text.encode().lower().split()], 1)
    assert np.allclose(scoring.shares(counts), model.share)
    assert np.allclose(np.exp(model.share.astype(float)).reshape(scoring.NODES, -1).sum(1), 1, atol=1e-3)


def test_gradient_is_that_of_the_loss():
    rng = np.random.default_rng(0)
    net = scoring.Network.new(rng.integers(0, 9, scoring.NODES))
    around, middle = rng.integers(0, scoring.NODES + 1, (60, 4)), rng.integers(0, 256, 60)
    _, g = net.gradient(around, middle)
    sizes = np.cumsum([0, *[int(np.prod(s)) for s in net.shapes()]])
    x = net.flat().astype(np.float64)
    for low, high in zip(sizes[:-1], sizes[1:], strict=True):  # the steepest of each kind of weight
        at = low + int(np.argmax(np.abs(g[low:high])))
        up, down = x.copy(), x.copy()
        up[at] += 1e-2
        down[at] -= 1e-2
        slope = (scoring.Network.of(up).gradient(around, middle)[0] - scoring.Network.of(down).gradient(around, middle)[0]) / 2e-2
        assert slope == pytest.approx(g[at], rel=0.05, abs=1e-4)


def test_words_have_the_buckets_of_their_letters():
    text = "A bb \t the The THE re-read x\u00e9 \u4e2d\u6587\u5b57 \ud800 " + " ".join(f"w{i}" for i in range(3_000))
    words = [w.encode("utf-8", "surrogatepass").lower() for w in text.split()]
    for _ in range(2):  # cold and warm
        assert scoring.buckets(scoring.word_buckets(), text).tolist() == [scoring.bucket(w) for w in words]


@pytest.mark.parametrize("scale", [1, 500])
def test_probabilities_and_loss_are_those_of_a_plain_softmax(scale):
    """Also where scores are too large for the exponentials of single floats."""
    rng = np.random.default_rng(4)
    net = scoring.Network.of((scoring.Network.new(rng.integers(0, 9, scoring.NODES)).flat() * scale).astype(np.float32))
    around, middle = rng.integers(0, scoring.NODES + 1, (80, 4)), rng.integers(0, scoring.NODES, 80)
    h = np.tanh(net.b + sum(net.t[k].astype(float)[around[:, k]] for k in range(4)))
    z, own = h @ net.w + net.c, np.einsum("ni,nij->nj", h, net.ww[middle // 64].astype(float)) + net.cc[middle // 64]
    plain = [log_softmax(a)[m // 64] + log_softmax(b)[m % 64] for a, b, m in zip(z, own, middle, strict=True)]
    assert (np.abs(z).max() > scoring.SAFE) == (scale > 1)
    assert np.allclose(net.log_probability(around, middle), plain, rtol=1e-4, atol=1e-3)
    assert net.gradient(around, middle)[0] == pytest.approx(-np.mean(plain), rel=1e-4)


@pytest.mark.parametrize("top", [35, 79, 300])
def test_loss_and_its_derivative_where_scores_are_large(top):
    """A batch of 5,000 rows, all with scores of ``top``."""
    z = np.random.default_rng(6).normal(top, 0.2, (5_000, 64))
    at = np.arange(5_000) % 64
    shares = np.exp(z - z.max(1, keepdims=True))
    shares /= shares.sum(1, keepdims=True)
    loss, d = scoring.missed(z.astype(np.float32), at)
    assert loss == pytest.approx(-np.log(shares[np.arange(5_000), at]).sum(), rel=1e-4)
    assert np.allclose(d * 5_000, shares - np.eye(64)[at], atol=1e-4)
    assert np.allclose(scoring.picked(z.astype(np.float32), at), np.log(shares[np.arange(5_000), at]), atol=1e-3)


def test_training_is_plain_adam(monkeypatch):
    monkeypatch.setattr(scoring, "BATCH", 64)
    rng = np.random.default_rng(5)
    net, windows = scoring.Network.new(rng.integers(0, 9, scoring.NODES)), rng.integers(0, 300, (500, 5)).astype(np.uint16)
    order = np.random.default_rng(7).permutation(500)
    x = net.flat().astype(float)
    m, v = np.zeros_like(x), np.zeros_like(x)
    for step in range(1, 9):
        some = windows[order[64 * step - 64 : 64 * step]].astype(int)
        g = scoring.Network.of(x.astype(np.float32)).gradient(np.delete(some, 2, axis=1), some[:, 2])[1].astype(float)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        x -= scoring.RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    off = np.abs(net.trained(windows, 7).flat() - x)
    assert np.quantile(off, 0.999) < 1e-4 and off.max() < 0.03


def test_softmaxes_take_all_rows_at_once(monkeypatch):
    """Not those of a class at a time: these small calls took most of a step's time."""
    calls = []
    for name in ("missed", "picked"):
        monkeypatch.setattr(scoring, name, lambda z, *rest, name=name, do=getattr(scoring, name): (calls.append((name, len(z))), do(z, *rest))[1])
    rng = np.random.default_rng(0)
    net = scoring.Network.new(rng.integers(0, 9, scoring.NODES))
    around, middle = rng.integers(0, scoring.NODES + 1, (4_096, 4)), rng.integers(0, scoring.NODES, 4_096)
    net.gradient(around, middle)
    net.log_probability(around, middle)
    assert calls == [("missed", 4_096)] * 2 + [("picked", 4_096)] * 2


def test_words_that_occur_once_fill_no_cache():
    known = scoring.word_buckets()
    before = len(known)
    scoring.buckets(known, " ".join(f"once{i}" for i in range(20_000)))
    assert len(known) - before <= 110  # endings of two digits, or of a letter and one


def losses(model, docs):
    """Mean negative log-probability of a token: by the model, by the shares of classes with context, and by shares alone."""
    known = scoring.word_buckets()
    b = [scoring.buckets(known, d.text) for d in docs]
    return -model.scores(b).sum() / sum(map(len, b))


def test_held_out_tokens_are_predicted_from_their_sides(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    train, held = docs.where("doc_id % 4 <> 0"), docs.where("doc_id % 4 = 0").collect()
    model = scoring.fit(spark, train, Scratch(spark, "test"), epochs=1, every=1)
    alone = scoring.fit(spark, train, Scratch(spark, "test"), epochs=0)
    for x in (alone.network.t, alone.network.w, alone.network.ww):
        x[:] = 0  # what is left are the shares of the counts
    assert losses(model, held) < losses(alone, held) - 0.1


def test_weights_do_not_depend_on_the_partitions(spark, docs):
    one, other = (scoring.fit(spark, docs.repartition(n), Scratch(spark, "test"), epochs=1) for n in (1, 5))
    assert (one.network.flat() == other.network.flat()).all() and (one.share == other.share).all()


def test_every_token_is_trained_on(spark, docs, monkeypatch):
    """Also across blocks, each once; a repeated text is dealt over the parts."""
    monkeypatch.setattr(scoring, "CHUNK", 50)
    monkeypatch.setattr(scoring, "PART", 4_000)
    rows = docs.select("doc_id", "text").limit(20).unionByName(spark.range(2_000).select((F.col("id") + 10_000).alias("doc_id"), F.lit("one two three four five six").alias("text")))
    blocks = scoring.gather(iter([rows.toPandas()]))
    import pandas as pd

    got = pd.concat(list(blocks))
    cells = [c for x in got["cells"].dropna() for c in scoring.windows_of(np.frombuffer(x, np.uint16), scoring.EVERY)[:, scoring.SIDE].tolist()]
    known = scoring.word_buckets()
    assert sorted(cells) == sorted(c for r in rows.collect() for c in (scoring.buckets(known, r.text) >> scoring.LEAF_BITS).tolist())
    some = spark.createDataFrame(got.dropna(subset=["cells"])[["n", "id", "place", "cells"]].astype({"n": "int64", "id": "int64", "place": "int64"}))
    parts, many = scoring.dealt(some, 1)
    largest = max(r.n for r in parts.groupBy("part").agg(F.sum(F.length("cells") / 2 - 2 * scoring.SIDE).alias("n")).collect())
    assert many > 2 and largest < 2 * scoring.PART


def test_both_sides_help_and_order_matters(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(("the red fox runs", "a blue bird sings", "der alte Mann geht")) for _ in range(120))) for i in range(150)]
    model = scoring.fit(spark, spark.createDataFrame(rows, DOC), Scratch(spark, "test"), epochs=8, every=1)
    text = "the red fox runs a blue bird sings " * 10
    words = text.split()
    rng.shuffle(words)
    mixed = " ".join(words)
    found = {r.doc_id: r.mean_pll for r in scoring.score(spark, spark.createDataFrame([(1, text), (2, mixed)], DOC), model).collect()}
    assert found[1] > found[2] + 1


def test_edge_cases(spark, model):
    rows = [(1, None), (2, " \n"), (None, "one"), (3, "same text"), (3, "same text"), (4, "w " * 50_000)]
    df = spark.createDataFrame(rows, DOC).withColumn("n_tokens", F.lit(1)).withColumn("part", F.lit(1))
    found = scoring.score(spark, df, model).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in found) == [(0, 1), (1, 0), (2, 0), (3, 2), (3, 2), (4, 50_000)]
    assert all(r.pll == 0 for r in found if r.n_tokens == 0) and np.ptp([r.pll for r in found if r.doc_id == 3]) < 1e-3
    assert scoring.score(spark, df.limit(0)).count() == 0 and scoring.score(spark, df).count() == 6


def test_weights_average_through_the_tree(spark):
    rng = np.random.default_rng(2)
    flats, n = rng.normal(size=(150, 5)).astype(np.float32), rng.integers(1, 9, 150)
    df = spark.createDataFrame([(i, int(k), f.tobytes()) for i, (k, f) in enumerate(zip(n, flats, strict=True))], "part long, n long, flat binary")
    df = df.withColumn("flat", F.col("flat").cast("binary"))
    assert np.allclose(scoring.averaged(df), np.average(flats, axis=0, weights=n), atol=1e-5)
