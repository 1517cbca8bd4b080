"""Substring dedup, divergence audit and Merkle manifest, against brute force and on edge cases."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marketloom.llm import divergence, manifest, substrings
from marketloom.llm.common import Scratch

DOC = "doc_id long, text string, lang string, source string, n_chars long"
EXTRA = "spans string, _spans int, kept string, n_words int, n_removed int, _of int, _text string, term string, n int, g int, h string, tree int, many int, seen int, leaf string, tie int, range int, bucket int, path string"


def widened(df):
    for c in EXTRA.split(", "):
        name, kind = c.split()
        df = df.withColumn(name, F.lit("x" if kind == "string" else 1).cast(kind))
    return df


@pytest.fixture(scope="module")
def rows():
    """Passages shared in all ways: exact and near copies, repeats within a text, equal and null ids, blank and long texts."""
    rng = random.Random(5)
    words = [*"abcdefgh", "Größe", "ÉTÉ", "don't", "x1y", "Ab"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passages = [text(n) for n in (12, 13, 14, 40)]
    out = [(1, None, "en", "a", None), (2, "", None, None, 0), (3, " \t\n\x0b\x0c", "en", "b", 3), (4, "a " * 3000, "fr", "a", 6000), (5, "a " * 50, "fr", None, 100)]
    out += [(6, passages[3], "en", "b", 9), (6, passages[3], "en", "b", 9), (6, passages[3] + " z", "de", "b", 9), (None, passages[3], None, "b", 9), (None, "q " + passages[2] + " r", "", "b", 9)]
    out += [(-(2**63), passages[2], "en", "c", 1), (2**63 - 1, passages[3] + " " + passages[1], "en", "c", 1), (7, text(9000), "en", "a", 1)]
    for k in range(10, 90):
        parts = [text(rng.randint(0, 30)), rng.choice(passages), rng.choice([" ", "\n", " \t "]).join(text(9).split()), rng.choice(passages)]
        rng.shuffle(parts)
        out.append((k, " ".join(parts), rng.choice(["en", "de", "fr", None]), rng.choice(["a", "b", "c", "d", None, ""]), rng.choice([None, 5, -7])))
    rng.shuffle(out)
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return widened(spark.createDataFrame(rows, DOC))


# substring dedup


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), max_size=50), st.lists(st.booleans(), max_size=50))
def test_varints_and_sums_round_trip(values, breaks):
    x = np.array(values, np.uint64)
    data, many = substrings.varints(x)
    back, per = substrings.unvarints(data, np.concatenate([[0], np.cumsum(many)]))
    assert (back == x).all() and (per == 1).all()
    first = np.array([True, *breaks, *[False] * len(values)][: len(values)], bool)
    if len(x):
        assert (substrings.running(substrings.steps(x, first), first) == x).all()


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), max_size=40), st.integers(1, 13))
def test_rolled_hash_is_the_polynomial(values, width):
    base = substrings.BASES[0]
    found = substrings.rolled(np.array(values, np.uint64), base, width)
    wanted = [sum(v * pow(base, width - 1 - k, 1 << 64) for k, v in enumerate(values[at : at + width])) % (1 << 64) for at in range(len(values) - width + 1)]
    assert found.tolist() == wanted


def test_rolled_hash_of_long_runs():
    values = np.random.default_rng(1).integers(0, 2**63, 3 * substrings.STRETCH + 5).astype(np.uint64)
    whole = substrings.rolled(values, substrings.BASES[1], 13)
    for at in (0, substrings.STRETCH - 13, substrings.STRETCH - 1, substrings.STRETCH, len(whole) - 1):
        assert whole[at] == substrings.rolled(values[at : at + 13], substrings.BASES[1], 13)[0]


def kept_by_brute_force(rows, width=13):
    words = [(r[0], re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in rows]
    first = {}
    order = lambda d: (d is None, d or 0)
    for doc_id, w in words:
        for k in range(len(w) - width + 1):
            key = tuple(w[k : k + width])
            first[key] = min(first.get(key, (True, 0)), order(doc_id))
    out = []
    for doc_id, w in words:
        keep = [True] * len(w)
        for k in range(len(w) - width + 1):
            if first[tuple(w[k : k + width])] < order(doc_id):
                keep[k : k + width] = [False] * width
        kept = " ".join(x for x, yes in zip(w, keep, strict=True) if yes)
        out.append((doc_id, len(w), len(w) - sum(keep), kept))
    return sorted(out, key=str)


@pytest.mark.parametrize(("flush", "bucket"), [(1 << 20, 1 << 21), (100, 50)])
def test_substrings_are_those_of_brute_force(docs, rows, flush, bucket):
    found = substrings.without_repeats(docs, flush=flush, bucket=bucket)
    new = found.columns[len(docs.columns) :]
    assert found.columns[: len(docs.columns)] == docs.columns and len({c.lower() for c in found.columns}) == len(found.columns)
    got = sorted(((r[0], r[new[1]], r[new[2]], r[new[0]]) for r in found.select("doc_id", *new).collect()), key=str)
    assert got == kept_by_brute_force(rows)


def test_wider_hashes_find_the_same(docs, rows, monkeypatch):
    monkeypatch.setattr(substrings.math, "log2", lambda x: 44.0 if x > 1000 else 3.0)  # as for a table of 100 TB
    new = substrings.without_repeats(docs.select("doc_id", "text"))
    assert sorted(((r[0], r[3], r[4], r[2]) for r in new.collect()), key=str) == kept_by_brute_force(rows)


def test_shared_passage_goes_once_a_flush(spark):
    """A passage that all documents share: a bucket gets one entry of it for each flush, not one a document."""
    passage = " ".join(f"w{k}" for k in range(13))
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.xxhash64("id").alias("h"), F.lit(passage).alias("text")).coalesce(1)
    sent = df.mapInArrow(substrings.sender(8, 0, 13, 1 << 20), substrings.SENT).where("docs IS NULL")
    assert sent.agg(F.sum(F.octet_length("keys"))).head()[0] == 8
    assert substrings.without_repeats(df.select("doc_id", "text")).where("n_removed = 13").count() == 2999


def test_no_documents(spark, docs):
    none = docs.limit(0)
    assert substrings.without_repeats(none).count() == 0
    assert divergence.audit(none, Scratch(spark, "t")).count() == 0
    assert manifest.manifest(none, F.col("text"), Scratch(spark, "t")).count() == 0


# divergence audit


def audit_by_brute_force(rows, ranks=200):
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    group, seen, langs = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source, _ in rows:
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(low))
        group[lang or "", source or ""].update(terms)
        langs[lang or ""].update(terms)
        seen[lang or ""].update(set(terms))
    out = []
    for (lang, source), n in group.items():
        kept = [t for t, docs in seen[lang].items() if docs >= 3]
        share = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c[x] for x in kept) + len(kept)) for t in kept}  # noqa: E731, B023
        p = share(n)
        found = {"pair": {}, "term": {}}
        for (other, item), m in group.items():
            if other == lang and item != source:
                q = share(m)
                found["pair"][item] = sum((p[t] - q[t]) ** 2 // q[t] for t in kept)
        q = share(langs[lang])
        found["term"] = {t: (p[t] - q[t]) ** 2 // q[t] for t in kept if n[t] and p[t] > q[t]}
        for part, values in found.items():
            best = sorted(values.items(), key=lambda x: (-x[1], x[0].encode()))
            out += [(lang, source, part, item, v, k) for k, (item, v) in enumerate(best, 1) if part == "pair" or k <= ranks]
    return sorted(out)


@pytest.fixture(scope="module")
def many_sources(rows):
    """Beside the rows a language of 12 sources, with terms in one to all of them."""
    rng = random.Random(8)
    out = list(rows)
    for k in range(200):
        source = rng.randrange(12)
        words = [f"t{'abcdefghijkl'[j]}" for j in range(12) if source <= j] + rng.choices("uvw", k=3) + [f"own{'abcdefghijkl'[source]}"] * 2
        out.append((1000 + k, " ".join(words * rng.randint(1, 3)), "xx", f"s{source}", None))
    return out + [(5000, "lonely", "yy", "s1", None), (5001, None, "yy", "s2", None)]


@pytest.mark.parametrize("limits", [{}, {"light": 2, "block": 5, "tile": 3, "chunk": 20}, {"light": 100, "block": 1, "tile": 1, "chunk": 1}])
def test_audit_is_that_of_brute_force(spark, many_sources, limits):
    found = divergence.audit(widened(spark.createDataFrame(many_sources, DOC)), Scratch(spark, "t"), **limits)
    assert sorted(map(tuple, found.select("lang", "source", "part", "item", "value", "rank").collect())) == audit_by_brute_force(many_sources)


def test_light_terms_alone_and_ranks(spark):
    """Sparse terms in many sources, so that none is heavy; the list of terms ends at its rank."""
    rng = random.Random(2)
    rows = [(k, " ".join("q" + "abcdefghij"[rng.randrange(10)] + "abcdefghij"[k % 10] for _ in range(4)), "en", f"s{k % 40}", None) for k in range(400)]
    found = divergence.audit(spark.createDataFrame(rows, DOC), Scratch(spark, "t"), ranks=3)
    assert sorted(map(tuple, found.collect())) == audit_by_brute_force(rows, 3)


def test_counts_of_whole_corpora_do_not_overflow(spark):
    made = spark.createDataFrame([(10**13, 3 * 10**13)], "n long, whole long").select(divergence.share("n", "whole")).head()[0]
    assert made == 1 + 10**9 * (10**13 + 1) // (3 * 10**13)


# manifest


def digest(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()


def manifest_by_brute_force(rows):
    """``(doc_id, leaf, subroot, root, proof, folded root)``, from lists of whole levels."""
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    leaf = lambda r: digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in r))

    def tree(level):
        at, sides = list(range(len(level))), [[] for _ in level]
        while len(level) > 1:
            for k, j in enumerate(at):
                run = j // 8 * 8
                sides[k].append(("".join(level[run:j]), "".join(level[j + 1 : run + 8])))
            at = [j // 8 for j in at]
            level = [digest("".join(level[k : k + 8])) for k in range(0, len(level), 8)]
        return level[0], sides

    by = defaultdict(list)
    for doc_id, text, lang, source, n_chars in rows:
        fields = (doc_id, source, lang, n_chars, text)
        hit = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0 and text is not None
        by[lang].append((doc_id is not None, doc_id or 0, leaf(fields), doc_id, leaf((*fields[:4], text.translate(low))) if hit else leaf(fields)))
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    trees = [tree([x[2] for x in sorted(by[lang])]) for lang in langs]
    root, tops = tree([t[0] for t in trees])
    out = []
    for lang, (subroot, sides), top in zip(langs, trees, tops, strict=True):
        for (_, _, mine, doc_id, seen), path in zip(sorted(by[lang]), sides, strict=True):
            for before, after in path + top:
                seen = digest(before + seen + after)
            out.append((doc_id, mine, subroot, root, digest("".join(a + b for a, b in path + top)), seen, seen == root))
    return sorted(out, key=str)


@pytest.mark.parametrize(("levels", "langs"), [(4, 0), (1, 0), (1, 70)])
def test_manifest_is_that_of_brute_force(spark, rows, levels, langs):
    """With buckets of one level the 8 nodes of a bucket make several tiers, of documents and of languages."""
    rows = rows + [(k, "Odd Text", f"l{k % langs}", "s", k) for k in range(2 * langs)] if langs else rows
    found = manifest.manifest(widened(spark.createDataFrame(rows, DOC)), manifest.tampered(), Scratch(spark, "t"), levels)
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, found.select(*names).collect()), key=str) == manifest_by_brute_force(rows)


def test_one_document_is_its_own_root(spark):
    one = spark.createDataFrame([(3, "A", "en", "s", 1)], DOC)
    row = manifest.manifest(one, F.col("text"), Scratch(spark, "t")).head()
    assert row.leaf == row.subroot == row.root == row.folded_root and row.proof_sha256 == digest("") and row.verified
