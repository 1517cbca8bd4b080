"""Operators on pages and embeddings, and the pipeline."""

from __future__ import annotations

import gzip
import os
import random
import re
from collections import Counter, defaultdict
from html import unescape

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from marketloom.llm import covertree, html_text, ivfpq, queries, warc

PAGE = "page_id long, url string, html string"
VECTOR = "vec_id long, embedding array<float>, label int"


@pytest.fixture(scope="module")
def odd_pages(spark):
    body = "<p>" + "same words " * 20 + "</p>"
    rows = [
        (3, "http://h.example/a b\r\n", body), (1, None, body), (2, "http://h.example/b", body), (2, "http://h.example/b", body), (None, "http://h.example/c", body),
        (4, "http://www.h.example/x?q=1", None), (5, "nonsense", ""), (6, "http://h.example/d", "\r\n\r\nWARC/1.0\r\n" * 30 + "é"), (7, "http://h.example/e", "x" * 200_000),
    ]
    return spark.createDataFrame(rows, PAGE).withColumn("payload", F.lit("x")).withColumn("first", F.lit(1)).withColumn("key", F.lit("k"))


def test_warc_equals_sql(spark, sf_dir):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{sf_dir}/pages.parquet'")
    wanted = sorted(map(tuple, con.sql(warc.OP1_SQL).fetchall()))
    assert sorted(tuple(r) for r in warc.op1_warc(spark, sf_dir).collect()) == wanted


def test_warc_round_trip_of_odd_pages(spark, odd_pages):
    found = warc.archive_and_index(spark, odd_pages).collect()
    kinds = Counter((r.page_id, r.record_type, r.refers_to) for r in found)
    assert kinds == Counter({(1, "response", None): 1, (2, "revisit", 1): 2, (3, "revisit", 1): 1, (None, "revisit", 1): 1, (4, "response", None): 1, (5, "response", None): 1, (6, "response", None): 1, (7, "response", None): 1})
    assert [warc.order(tuple(r)) for r in found] == sorted(warc.order(tuple(r)) for r in found)
    assert next(r.payload_bytes for r in found if r.page_id == 7) == 200_000 and next(r.url_key for r in found if r.page_id == 4) == "example,h)/x?q=1"
    assert warc.archive_and_index(spark, odd_pages.limit(0)).count() == 0


def test_loser_tree_merges_any_runs():
    rng = random.Random(4)
    for k in (0, 1, 2, 3, 7, 8):
        runs = []
        for i in range(k):
            run = [(f"k{rng.randint(0, 5)}", f"t{rng.randint(0, 3)}", rng.randint(0, 9), None, 0, "", "", None, f"f{i}", j, 1) for j in range(rng.randint(0, 12))]
            runs.append(sorted(run, key=warc.order))
        assert list(warc.LoserTree(runs)) == sorted((e for r in runs for e in r), key=warc.order)


def test_archives_are_parsed_by_length():
    record = lambda n, b: f"WARC/1.0\r\nWARC-Type: response\r\nContent-Length: {len(b)}\r\n\r\n".encode() + b + b"\r\n\r\n"
    data = record(1, b"a\r\n\r\nWARC/1.0") + record(2, b"")
    assert [b for _, b, _, _ in warc.parse(gzip.decompress(gzip.compress(data)))] == [b"a\r\n\r\nWARC/1.0", b""]


# main text


def test_main_text_of_structured_pages():
    html = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
    <header>Top</header><nav><ul><li>Menu</ul></nav><!-- <p>no</p> --><div class="cookie-notice">We use</div><main><article><h1>One &amp;
    two</h1><p>First <b>bold<br><p>Second&nbsp;line &lt;x&gt;</p><aside>Side</aside><div class="ad">Buy</div><form>Mail<input></form><ul><li>a<li>b</ul>
    <section id="comments"><p>Nice!</p></section><p title="a > b">Last</article></main><footer>End</footer>"""
    assert html_text.main_text(html) == "One & two\nFirst bold\nSecond line <x>\na\nb\nLast"
    assert html_text.main_text("") == "" and html_text.main_text("<p>plain") == "plain" and html_text.main_text("<p 'broken>x</p><p>y") != ""


def test_differencing_deletes_what_neighbours_share(spark):
    frame = lambda x, y: f"<div>Welcome to the site</div><div>News of today</div><p>{x}</p><p>{y}</p><div>All rights</div>"
    rows = [(i, f"http://h.example/n/{i:03d}", frame(f"story {i} begins", f"story {i} ends")) for i in range(150)]
    rows += [(200, "http://alone.example/", frame("a", "b")), (201, None, frame("c", "d")), (202, "http://copy.example/1", "<p>x</p><p>y</p><p>z</p>"), (203, "http://copy.example/2", "<p>x</p><p>y</p><p>z</p>")]
    for parts in (1, 7):
        found = {r.page_id: r.text for r in html_text.extract(spark, spark.createDataFrame(rows, PAGE).repartition(parts)).collect()}
        assert all(found[i] == f"story {i} begins\nstory {i} ends" for i in range(150))
        assert found[200].startswith("Welcome") and found[201].startswith("Welcome") and found[202] == found[203] == "x\ny\nz"


def test_frames_go_and_copies_stay(spark):
    menu = [f"Menu entry {k}" for k in range(9)]
    tail = "".join(f"<p>{x}</p>" for x in ("Follow us everywhere", "Rate this story"))
    rows = [(i, f"http://short.example/a/{i:02d}", "".join(f"<div>{x}</div>" for x in menu) + f"<p>one {i}</p><p>two {i}</p>") for i in range(12)]
    rows += [(100 + i, f"http://inside.example/a/{i:02d}", f"<article><h1>Head {i}</h1><p>{'Quoted passage' if i in (3, 4) else f'Own {i}'}</p>{tail}</article>") for i in range(12)]
    # a near copy of one page, once among others and once alone with it
    rows += [(200 + i, f"http://copies.example/{i:02d}", f"<p>a {i // 2}</p><p>b {i // 2}</p><p>c {i}</p>") for i in range(12)]
    found = {r.page_id: r.text for r in html_text.extract(spark, spark.createDataFrame(rows, PAGE)).collect()}
    assert all(found[i] == f"one {i}\ntwo {i}" for i in range(12))
    assert all(found[100 + i] == f"Head {i}\n{'Quoted passage' if i in (3, 4) else f'Own {i}'}" for i in range(12))
    assert all(found[200 + i] == f"a {i // 2}\nb {i // 2}\nc {i}" for i in range(12))


def test_articles_keep_what_stands_inside(spark):
    """A clause that all pages of a host repeat stays between own lines, and an article that is all shared stays whole."""
    clause, award = "<p>The usual clause applies.</p>", '<p>Terms as agreed.</p>'
    rows = [(i, f"http://law.example/case/{i:02d}", f"<article><h1>Case {i}</h1>{clause}<p>Own {i}</p>{award}<p>Closing {i}</p></article><div>{i}</div>") for i in range(6)]
    rows += [(100 + i, f"http://same.example/{i:02d}", f"<div>Page {i}</div><article><h1>One text</h1><p>for all</p></article>") for i in range(12)]
    found = {r.page_id: r.text for r in html_text.extract(spark, spark.createDataFrame(rows, PAGE)).collect()}
    assert all(found[i] == f"Case {i}\nThe usual clause applies.\nOwn {i}\nTerms as agreed.\nClosing {i}" for i in range(6))
    assert all(found[100 + i] == "One text\nfor all" for i in range(12))


def article_by_pattern(page):
    """The driver's pages by one pattern, without a reader of elements."""
    body = re.search("<article>(.*?)</article>", page, re.S)[1]
    blocks = [" ".join(unescape(re.sub("</?b>", "", b)).split()) for b in re.split("</?(?:h1|p|br)>", body)]
    return "\n".join(b for b in blocks if b)


def plain_difference(pages):
    """Lines of pages (path, lines), each in one block, without those in line with half of the eight nearest others."""
    everywhere = pages
    pages = sorted({lines: path for path, lines in sorted(pages, reverse=True)}.items(), key=lambda p: p[1])  # equal pages are one
    pages = [(path, lines) for lines, path in pages]
    out = {}
    for i, (path, lines) in enumerate(pages):
        around = [j for j in range(max(0, i - html_text.REACH), min(len(pages), i + html_text.REACH + 1)) if j != i]
        around = sorted(around, key=lambda j: (-len(os.path.commonprefix([path.split("/"), pages[j][0].split("/")])), abs(i - j), j))[:8]
        votes = Counter()
        for j in around:
            b = pages[j][1]
            table = [[0] * (len(b) + 1) for _ in range(len(lines) + 1)]
            for x in range(len(lines)):
                for y in range(len(b)):
                    table[x + 1][y + 1] = table[x][y] + 1 if lines[x] == b[y] else max(table[x][y + 1], table[x + 1][y])
            x, y = len(lines), len(b)
            while x and y:
                if lines[x - 1] == b[y - 1] and table[x][y] == table[x - 1][y - 1] + 1:
                    votes[x - 1] += 1
                    x, y = x - 1, y - 1
                elif table[x - 1][y] >= table[x][y - 1]:
                    x -= 1
                else:
                    y -= 1
        out[lines] = "\n".join(line for k, line in enumerate(lines) if not votes[k] or votes[k] < len(around) / 2)
    return {path: out[lines] for path, lines in everywhere}


@pytest.mark.parametrize("seed", range(4))
def test_differencing_is_that_of_plain_alignment(spark, seed):
    rng = random.Random(seed)
    pages, rows = defaultdict(list), []
    for i in range(70):
        host, path = f"h{rng.randint(0, 4)}.example", f"/{rng.choice('ab')}/{rng.choice('cd')}/{i:02d}"
        head, foot = ([f"{where} {k}" for k in range(2) if rng.random() < 0.7] for where in ("head", "foot"))
        lines = head + [f"text {i} {k}" for k in range(rng.randint(0, 3))] + [f"quote {rng.randint(0, 5)}"] + foot
        pages[host].append((path, tuple(lines)))
        rows.append((i, f"https://{host}{path}", "".join(f"<p>{x}</p>" for x in lines)))
    wanted = {(host, path): text for host, own in pages.items() for path, text in plain_difference(own).items()}
    got = html_text.extract(spark, spark.createDataFrame(rows, PAGE)).collect()
    assert {(r.url.split("/")[2], "/" + r.url.split("/", 3)[3]): r.text for r in got} == wanted
    assert any(r.text != html_text.main_text(rows[r.page_id][2]) for r in got)  # without differencing they differ


def test_html_edge_cases(spark, odd_pages, sf_dir):
    found = html_text.extract(spark, odd_pages).collect()
    assert len(found) == 9 and all(r.n_chars == len(r.text) for r in found) and next(r.text for r in found if r.page_id == 4) == ""
    assert html_text.extract(spark, odd_pages.limit(0)).count() == 0
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    for r in html_text.op6_extract(spark, sf_dir).collect():
        assert r.text == article_by_pattern(pages[r.page_id]) and "track(" not in r.text and "©" not in r.text.split("\n")[-1][:3]


def test_longest_common_subsequence_is_longest():
    rng = random.Random(8)
    for _ in range(60):
        a, b = ([rng.randint(0, 4) for _ in range(rng.randint(0, 12))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        got = html_text.longest_common(a, b)
        assert len(got) == table[-1][-1] and all(a[i] == b[j] for i, j in got) and got == sorted(got)


# embeddings


def usable(v):
    return v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v)


def brute_pairs(rows, least=0.98):
    ok = [i for i, (_, v, label) in enumerate(rows) if label is not None and usable(v)]
    near = defaultdict(set)
    for i in ok:
        for j in ok:
            if i < j and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                a, b = (np.array(rows[k][1], np.float64) for k in (i, j))
                if a @ b / np.sqrt(a @ a) / np.sqrt(b @ b) >= least:
                    near[i].add(j)
                    near[j].add(i)
    out = []
    for i in range(len(rows)):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        component = min(rows[j][0] for j in seen)
        out.append((rows[i][0], len(near[i]), component, component == rows[i][0]))
    return Counter(out)


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(3)
    base = rng.normal(size=(40, 8))
    near = np.concatenate([base, base[:1] + rng.normal(size=(60, 8)) * 0.15, base[1:2] + rng.normal(size=(30, 8)) * 0.3, base[2:3].repeat(25, 0), base[3:13] + rng.normal(size=(10, 8)) * 0.05])
    rows = [(i, [float(np.float32(x)) for x in v], int(i % 7 == 0)) for i, v in enumerate(near)]
    rows += [(500, None, 0), (501, [], 0), (502, [0.0] * 8, 0), (503, [float("nan")] + [1.0] * 7, 0), (504, [None] + [1.0] * 7, 0), (505, rows[0][1], None), (506, [1.0, 2.0], 0), (507, [2.0, 4.0], 0), (508, [float("inf")] * 8, 0)]
    return rows


@pytest.mark.parametrize("cell", [2048, 16])
def test_cover_tree_pairs_equal_brute_force(spark, vectors, cell):
    df = spark.createDataFrame(vectors, VECTOR).withColumn("v", F.lit(1)).withColumn("n", F.lit(1)).withColumn("key", F.lit("x"))
    assert Counter(tuple(r) for r in covertree.near_pairs(spark, df, cell=cell).collect()) == brute_pairs(vectors)


def test_cover_tree_of_nothing(spark):
    assert covertree.near_pairs(spark, spark.createDataFrame([], VECTOR)).count() == 0
    only = spark.createDataFrame([(1, None, 1), (2, [1.0], None)], VECTOR)
    assert sorted(tuple(r) for r in covertree.near_pairs(spark, only).collect()) == [(1, 0, 1, True), (2, 0, 2, True)]


def test_cover_tree_radii_hold():
    v = np.random.default_rng(1).normal(size=(300, 4))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    t = covertree.Tree(v, np.ones(300, int))
    for level, r in enumerate(covertree.RADII):
        assert sorted(np.concatenate(t.members[level]).tolist()) == list(range(300))
        for c, own, far in zip(t.centres[level], t.members[level], t.radius[level], strict=True):
            d = np.linalg.norm(v[own] - v[c], axis=1)
            assert d.max() <= far + 1e-7 <= r + 2e-7


def test_search_recall_and_exact_scores(spark, sf_dir):
    rows = {r.vec_id: np.array(r.embedding, np.float64) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()}
    by = defaultdict(list)
    for r in ivfpq.op10_search(spark, sf_dir).collect():
        by[r.query_id].append(r)
    assert set(by) == {i for i in rows if i % 20 == 0}
    hits = 0
    for q, found in by.items():
        found.sort(key=lambda r: r["rank"])
        wanted = sorted(((-(rows[q] @ v), i) for i, v in rows.items() if i != q))[:20]
        assert [r["rank"] for r in found] == list(range(1, 21)) and all(r.score == pytest.approx(rows[q] @ rows[r.vec_id], abs=1e-12) for r in found)
        assert [(-r.score, r.vec_id) for r in found] == sorted((-r.score, r.vec_id) for r in found)
        hits += len({i for _, i in wanted} & {r.vec_id for r in found})
    assert hits >= 0.9 * 20 * len(by)


def test_search_edge_cases(spark, vectors):
    odd = vectors[-9:] + [(0, [1.0] * 8, 1), (20, [0.5] * 8, 1), (21, [1.0] * 8, None), (22, [1.0] * 8, 1), (22, [1.0] * 8, 1)]
    found = defaultdict(list)
    df = spark.createDataFrame(odd, VECTOR).withColumn("v", F.lit(1)).withColumn("shard", F.lit(1))
    for r in ivfpq.search(spark, df).collect():
        found[r.query_id].append((r["rank"], r.vec_id))
    assert {q: [i for _, i in sorted(v)] for q, v in found.items()} == {0: [21, 22, 22, 20, 505], 20: [0, 21, 22, 22, 505]}
    assert ivfpq.search(spark, spark.createDataFrame([], VECTOR)).count() == 0


def test_search_misses_nothing_on_hostile_rows(spark):
    """Lengths of heavy tails, and dense groups that the codes cannot tell apart."""
    rng = np.random.default_rng(11)
    spread = rng.normal(size=(1500, 16)) * rng.lognormal(0, 2, (1500, 1))
    dense = rng.normal(size=(3, 16)).repeat(500, 0) * 5 + rng.normal(size=(1500, 16)) * 1e-4
    vectors = np.concatenate([spread, dense])[rng.permutation(3000)]
    found = {}
    for r in ivfpq.search(spark, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>"), rerank=40).collect():
        found.setdefault(r.query_id, {})[r.rank] = r.vec_id
    for query, got in found.items():
        score = vectors @ vectors[query]
        score[query] = -np.inf
        assert [got[k + 1] for k in range(20)] == np.lexsort((np.arange(3000), -score))[:20].tolist()
    assert len(found) == 150


def test_search_over_many_shards(spark):
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=6).tolist(), 0) for i in range(400)]
    df = spark.createDataFrame(rows, VECTOR)
    found = ivfpq.search(spark, df, probe=1.0, rerank=400, shard=64)
    v = {i: np.array(x, np.float32).astype(np.float64) for i, x, _ in rows}
    got = defaultdict(dict)
    for r in found.collect():
        got[r.query_id][r["rank"]] = r.vec_id
    for q, ranks in got.items():
        assert [ranks[k] for k in range(1, 21)] == [i for _, i in sorted((-(v[q] @ x), i) for i, x in v.items() if i != q)[:20]]


def test_routes_go_in_small_frames_with_the_lists_of_their_shard():
    """One frame of all queries and shards, each with all lists, took the executor's memory."""
    rng = np.random.default_rng(3)
    q = ivfpq.Quantiser(rng.normal(size=(40, 8)), np.array([0, 8]), [np.zeros((1, 8))])
    counts = np.full(40, 90)
    counts[[3, 7]] = 0
    base, split = (np.cumsum(counts) - counts) // 200, -(-counts // 200)
    batch = pd.DataFrame({"vec_id": np.arange(300), "v": list(rng.normal(size=(300, 8))), "own": 1})
    frames = list(ivfpq.routed([batch, batch[:0]], q, counts, base, split, 20, 1.0))
    assert len(frames) > 5 and max(map(len, frames)) <= ivfpq.ROUTED
    asked = defaultdict(list)
    for f in frames:
        for query_id, probes, shard in zip(f["query_id"], f["probes"], f["shard"], strict=True):
            assert all(base[p] == shard for p in probes)
            asked[query_id] += probes.tolist()
    assert len(asked) == 300 and all(sorted(x) == np.flatnonzero(counts).tolist() for x in asked.values())


def test_equal_vectors_of_a_shard_rank_by_id():
    """As many pairs as there are scores reach the exact step; equal vectors score equal, wherever they stand."""
    rng = np.random.default_rng(5)
    v = rng.normal(size=(3001, 24))
    v[rng.permutation(3001)[:2900]] = v[0] * 3
    ids = rng.permutation(3001)
    q = ivfpq.Quantiser.fit(v[:500], 4)
    own, codes = q.encode(v)
    index = pd.DataFrame({"vec_id": ids, "v": list(v), "list": own.astype(np.int32), "codes": [c.tobytes() for c in codes]})
    asked = pd.DataFrame({"query_id": ids[:50], "v": list(v[:50]), "probes": [np.arange(4, dtype=np.int32)] * 50})
    found = ivfpq.search_shard(q, index, asked, 20, 40)
    for x, i in zip(v[:50], ids[:50], strict=True):
        score = (v * x).sum(axis=1)
        score[ids == i] = -np.inf
        assert found[found.query_id == i].vec_id.tolist() == ids[np.lexsort((ids, -score))[:20]].tolist()


# pipeline


def test_pipeline_stages(spark, sf_dir, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, ids = docs.columns, None
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id for r in docs.select("doc_id").collect()}
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        ids = {r.doc_id for r in docs.select("doc_id").collect()}
        assert ids <= before and (docs.columns == columns) == (k < 4)
    assert ids and [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "simhash_near_dedup", "personal_data", "source_mix", "best_fit_packing"]


def test_near_dedup_stage_shares_four_fifths_of_five_word_shingles(spark):
    from marketloom.llm import simhash

    rng = random.Random(4)
    rows, shingles = [], []
    for k in range(30):
        base = [f"w{rng.randrange(5000)}" for _ in range(120)]
        for j, changes in enumerate((0, 1, 2, 2, 3, 5)):  # each change alters five shingles of 116
            words = list(base)
            for at in rng.sample(range(5, 115, 10), changes):
                words[at] = f"x{k}y{j}z{at}"
            rows.append((len(rows), " ".join(words), "en", "a", 1))
            shingles.append({tuple(words[i : i + 5]) for i in range(116)})
    label = list(range(len(rows)))
    apart = 0
    for i in range(len(rows)):
        for j in range(i):
            if len(shingles[i] & shingles[j]) >= 0.8 * len(shingles[i] | shingles[j]):
                apart += (simhash.fingerprint(rows[i][1], 5) ^ simhash.fingerprint(rows[j][1], 5)).bit_count() > 3
                label = [min(label[i], label[j]) if x in (label[i], label[j]) else x for x in label]
    assert apart and len(set(label)) > 30
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.doc_id for r in simhash.keep_first(spark, docs).collect()} == set(label)


def test_stages_tell_rows_apart_without_ids(spark):
    from marketloom.llm import mixing, simhash

    text = lambda k: " ".join(f"w{k}x{i}" for i in range(40))
    rows = [(None, text(0), "en", "a", 1), (None, text(1), "en", "a", 1), (3, text(2), "en", "a", 1), (3, text(3), "en", "a", 1), (3, text(3), "en", "a", 1), (None, text(2), "en", None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("_key_a", F.lit("x"))
    kept = simhash.keep_first(spark, docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text) for r in kept.collect()) == sorted([(0, text(0)), (0, text(1)), (3, text(2)), (3, text(3))])
    got = Counter(r.text for r in mixing.mixed(spark, kept).collect())  # 1.5 times the words
    assert sum(got.values()) == 6 and set(got) == {text(i) for i in range(4)} and set(got.values()) <= {1, 2}


def test_thirteen_queries_are_registered():
    names = sorted(int(n[2:].split("_")[0]) for n in queries.queries())
    assert names == list(range(1, 14))
