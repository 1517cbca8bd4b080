"""Stages of the pipeline, each against brute force, on rows with nulls, repeats, long texts and clashing names; and tasks without the package."""

from __future__ import annotations

import itertools
import os
import random
import re
import subprocess
import sys
from collections import Counter, defaultdict
from pathlib import Path

import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from marketloom.llm import common, mixing, packing, pii, simhash

ROOT = Path(__file__).resolve().parents[2]
STAGE = dict(corpus_pipeline.STAGES)
DOC = "doc_id long, text string, lang string, source string, n_chars int"
CLASH = ("node", "label", "bucket", "first", "key", "size", "taken", "found", "_key_a", "_copies", "piece", "start", "length")


def words(a: int, n: int) -> str:
    return " ".join(f"word{a}x{k}" for k in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    long = words(900, 30_000)
    near = words(3, 60)
    rows = [
        (1, words(1, 40), "en", "a"), (2, words(1, 40), "en", "b"), (2, words(2, 40), "en", "a"), (None, words(1, 40), "en", "a"), (None, words(7, 9), "en", None),
        (3, near, "en", "a"), (4, near + " end", "en", "c"), (5, near.replace("word3x30", "other"), "en", None), (6, words(4, 3), "en", "a"), (6, words(4, 3), "en", "a"),
        (7, None, "en", "a"), (8, "", None, "a"), (9, "12 34", "en", "b"), (10, long, "en", "a"), (11, "mail bob@site.org or +44 20 7946 0958 now", "en", "b"), (12, "one", "en", "c"),
    ]
    rows += [(100 + i, words(100 + i, 12 + i), "en", "abc"[i % 3]) for i in range(20)]
    df = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], DOC)
    return df.withColumns({c: F.lit(c) for c in CLASH})


def plain(rows) -> Counter:
    return Counter(tuple(r) for r in rows)


def texts(df) -> Counter:
    return Counter((r.doc_id, r.text, r.source) for r in df.collect())


def test_language_stage_drops_what_has_no_letters(spark, docs):
    kept = STAGE["language_id"](spark, docs, "")
    assert kept.columns == docs.columns
    assert plain(kept.collect()) == plain(r for r in docs.collect() if r.text and re.search("[a-z]", r.text))


def shingles(text: str | None) -> frozenset:
    w = (text or "").lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def test_near_dedup_stage_keeps_one_of_each_class(spark, docs):
    rows = docs.collect()
    sets = [shingles(r.text) for r in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            union = len(sets[i] | sets[j])
            if not union or 5 * len(sets[i] & sets[j]) >= 4 * union:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    classes = defaultdict(list)
    for r, g in zip(rows, group, strict=True):
        classes[g].append(r)
    kept = STAGE["simhash_near_dedup"](spark, docs, "")
    assert kept.columns == docs.columns
    got = kept.collect()
    assert len(got) == len(classes)
    for members in classes.values():
        least = min(members, key=lambda r: (r.doc_id is None, r.doc_id or 0))
        assert sum(r in members for r in got) == 1 and any(r.doc_id == least.doc_id for r in got if r in members)


def test_personal_data_stage_hides_spans_only(spark, docs):
    got = STAGE["personal_data"](spark, docs, "")
    assert got.columns == docs.columns
    wanted = Counter()
    for r in docs.collect():
        text = pii.redact(r.text, pii.base_spans(r.text)) if r.text else r.text
        wanted[r.doc_id, text, len(text) if text is not None else None, r.node] += 1
    assert Counter((r.doc_id, r.text, r.n_chars, r.node) for r in got.collect()) == wanted


def test_mix_stage_repeats_rows_as_the_targets_say(spark, docs):
    got = STAGE["source_mix"](spark, docs, "")
    assert got.columns == docs.columns
    before, after = texts(docs), texts(got)
    assert set(after) <= set(before)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    goal = {r.source: (r.source_size, r.target) for r in mixing.mix(spark, docs).select("source_size", "target", "size", "doc_id").join(docs.select("doc_id", "source"), "doc_id").distinct().collect()}
    for source, (whole, target) in goal.items():
        took = sum(n * size(t) for (_, t, s), n in after.items() if s == source)
        assert abs(took - target) <= max((size(t) for (_, t, s) in before if s == source), default=0)
        assert all(n <= 2 * before[k] for k, n in after.items() if k[2] == source)


def test_packing_stage_places_every_piece(spark, docs):
    got = STAGE["best_fit_packing"](spark, docs, "").collect()
    assert Counter(r.doc_id for r in got if r.piece == 0) == Counter(r.doc_id for r in docs.collect())
    held = defaultdict(list)
    for r in got:
        held[r.sequence_id].append((r.offset, r.length))
    for places in held.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    pieces = defaultdict(int)
    for r in got:
        pieces[r.doc_id, r.piece] += 1
        assert r.start == 2048 * r.piece


def test_packing_stage_leaves_no_full_caches_in_idle_workers(spark, docs):
    """Idle workers stay beside those of other stages: their encoders hold no words once a task is over."""

    def held(batches):
        for batch in batches:
            found = vars(sys.modules.get("marketloom_worker", sys)).items()
            sizes = [(x.bound, len(x.chunks) + len(x.chunks.older) + len(x.parts) + len(x.parts.older)) for name, x in found if name.startswith(f"encoder {packing.STAGE_CACHE} ")]
            yield pd.DataFrame(sizes, columns=["bound", "entries"])

    STAGE["best_fit_packing"](spark, docs, "")
    got = spark.range(0, 64, 1, 64).mapInPandas(held, "bound long, entries long").collect()
    assert got and {(r.bound, r.entries) for r in got} == {(packing.STAGE_CACHE, 0)}


def test_training_windows_of_personal_data_come_in_small_batches(spark, docs, monkeypatch):
    asked, small = [], pii.small_batches
    monkeypatch.setattr(pii, "small_batches", lambda session: asked.append(common.BATCH_ROWS) or small(session))
    pii.fit(docs)
    assert asked == [common.BATCH_ROWS]


@pytest.mark.parametrize("name", list(STAGE))
def test_stages_of_nothing_give_nothing(spark, docs, name):
    assert STAGE[name](spark, docs.limit(0), "").count() == 0


def test_crowded_buckets_are_dealt_anew_and_blocks_meet(spark, monkeypatch):
    """Texts that share a passage but are not alike, and near copies of one that differ from each other: blocks of 8 nodes."""
    monkeypatch.setattr(simhash, "BLOCK", 8)
    passage = words(1, 60)
    rows = [(i, f"{passage} {words(10 + i, 45)}") for i in range(30)]
    base = words(2, 100).split()
    for i in range(30):
        changed = list(base)
        changed[3 * i + 2] = f"changed{i}"
        rows.append((100 + i, " ".join(changed)))
    rows += [(200, " ".join(base))]
    got = simhash.keep_first(spark, spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in got.collect()) == [*range(30), 100]


def agree_in(one: str, other: str) -> list[int]:
    """Bands in which two texts agree."""
    x, y = (simhash.minima(simhash.shingle_hashes(t)).reshape(simhash.BANDS, simhash.MINIMA) for t in (one, other))
    return [k for k in range(simhash.BANDS) if (x[k] == y[k]).all()]


def test_links_in_one_crowded_band_only_are_found(spark, monkeypatch):
    """Two alike texts agree in a single band, in which a crowd of others agrees with them: no other band brings them together."""
    monkeypatch.setattr(simhash, "BLOCK", 8)
    rng, base = random.Random(7), words(3, 150)

    def changed() -> str:
        w = base.split()
        for at in rng.sample(range(5, 145, 6), 3):
            w[at] = f"c{rng.random()}"
        return " ".join(w)

    copy = next(t for t in iter(changed, None) if len(agree_in(base, t)) == 1 and 5 * len(shingles(base) & shingles(t)) >= 4 * len(shingles(base) | shingles(t)))
    (band,) = agree_in(base, copy)
    low = simhash.minima(simhash.shingle_hashes(base)).reshape(simhash.BANDS, -1)[band]
    own = [g for g in zip(*[base.split()[i:] for i in range(5)], strict=False) if (simhash.minima(simhash.shingle_hashes(" ".join(g))).reshape(simhash.BANDS, -1)[band] == low).any()]
    crowd: list[str] = []
    while len(crowd) < 30:
        text = " ".join([*(" ".join(g) + f" e{rng.random()}" for g in rng.sample(own, len(own))), words(rng.randrange(1 << 30), 25)])
        if agree_in(base, text) == [band]:
            crowd.append(text)
    rows = [(1, base), (2, copy), *[(10 + i, t) for i, t in enumerate(crowd)]]
    got = simhash.keep_first(spark, spark.createDataFrame(rows, "doc_id long, text string"))
    assert not {r.doc_id for r in got.collect()} & {2}


def test_nodes_of_two_classes_meet_once_and_a_large_class_not_with_itself(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 8)
    label = {i: 0 if i < 400 else i for i in range(420)}
    members = spark.createDataFrame([(5, 1, i, k) for i, k in label.items()] + [(6, 1, i, 3) for i in range(9)], "bucket long, band long, node long, label long")
    blocks = simhash.in_blocks(members, members.select("node", F.col("node").alias("payload")).distinct(), "payload").collect()
    met, rows = Counter(), 0
    for b in blocks:
        assert b.bucket == 5 and (b.one or b.other)
        one, other = ([r.node for r in x] for x in (b.one, b.other))
        rows += len(one) + len(other)
        met.update(frozenset(p) for p in ([(i, j) for i in one for j in other] or itertools.combinations(one, 2)) if label[p[0]] != label[p[1]])
    assert len(met) == 400 * 20 + 20 * 19 // 2 and set(met.values()) == {1}
    assert rows < 4 * 400 + 20 * 100  # 420 nodes in 53 blocks would be 22,000


@pytest.mark.parametrize("name", ["op2_pii_bilstm_crf", "op4_pseudo_likelihood", "op7_language_viterbi", "op10_ivf_pq"])
def test_tasks_need_no_installed_package(name, sf_dir, tmp_path):
    code = f"""import sys
sys.path.insert(0, {str(ROOT)!r})
import __spark_entry__ as e
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4").getOrCreate()
print("rows", e.queries()[{name!r}](spark, {sf_dir!r}).count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"PYSPARK_PYTHON": sys.executable}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert re.search(r"rows \d+", done.stdout), done.stderr[-2000:]
