"""Operators on documents, against brute force and on edge cases."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marketloom.llm import language, mixing, packing, pii, simhash
from marketloom.llm.common import Scratch

DOC = "doc_id long, text string, lang string, source string, n_chars long"
EXTRA = "size long, part string, fp string, label string, found string, score string, _salt int, _language string, _found string, _copies string"


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in any column, blank and long texts, repeated rows, clashing columns."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdeéñß") for _ in range(rng.randint(1, 7)))
    long = " ".join(word() for _ in range(30_000))
    rows = [
        (1, None, "en", "a", None), (2, "", None, None, 0), (3, " \t\n", "en", "b", 3), (4, long, "fr", "a", len(long)), (5, "one two", "en", None, 7), (5, "one two", "en", None, 7),
        (None, "three words here", "de", "c", 9), (7, "mail a@b.co and +1 (555) 555-1234, 10.0.0.1 and 4539 1488 0343 6467", "en", "b", 1), (8, "1" * 50_000, "en", "b", 1), (9, "a" * 50_000 + "@", "en", "b", 1),
        (10, "дом и 家 ok", "ru", "b", 1), (11, "!!! ???", "en", "a", 1),
    ]
    df = spark.createDataFrame(rows, DOC)
    for c in EXTRA.split(", "):
        name, kind = c.split()
        df = df.withColumn(name, F.lit("x" if kind == "string" else 1).cast(kind))
    return df


def none(df):
    return df.limit(0)


# packing


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


@pytest.fixture(scope="module")
def encoder():
    import public_tokenizers

    return packing.WordEncoder(public_tokenizers.path("word_bpe_49k.json"), bound=200)


@settings(max_examples=300, deadline=None)
@given(text=st.one_of(st.text(), st.text(alphabet="abcÉéß'st .,!$%<|endoftx>\n\t ́İΣ12")))
def test_chunks_encode_as_whole_texts(tokenizer, encoder, text):
    wanted = np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    assert encoder.encode(text) == wanted


def packed_is_sound(rows, capacity):
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_packing_covers_all_ids(spark, docs, tokenizer):
    found = packing.best_fit(spark, docs).collect()
    n = packed_is_sound(found, 2048)
    assert n <= -(-sum(r.length for r in found) // 2048) + 2
    of = defaultdict(list)
    for r in found:
        of[r.doc_id].append(r)
    for d in docs.limit(40).collect():
        ids = np.array([*tokenizer.encode(d.text, add_special_tokens=False).ids, 0], "<u4")
        pieces = sorted(of[d.doc_id], key=lambda r: r.piece)
        assert [(r.piece, r.start, r.length, r.ids_crc32) for r in pieces] == [(k, at, len(ids[at : at + 2048]), zlib.crc32(ids[at : at + 2048].tobytes())) for k, at in enumerate(range(0, len(ids), 2048))]


def test_packing_edge_cases(spark, odd):
    found = packing.best_fit(spark, odd).collect()
    packed_is_sound(found, 2048)
    assert Counter(r.doc_id for r in found if r.piece == 0) == Counter({1: 1, 2: 1, 3: 1, 4: 1, 5: 2, None: 1, 7: 1, 8: 1, 9: 1, 10: 1, 11: 1})
    assert next(r.length for r in found if r.doc_id == 1) == 1
    assert packing.best_fit(spark, none(odd)).count() == 0


def best_fit_one_by_one(lengths, capacity):
    gaps: list[int] = []
    for x in sorted(lengths, reverse=True):
        fits = [g for g in gaps if g >= x]
        if fits:
            gaps.remove(min(fits))
            gaps.append(min(fits) - x)
        else:
            gaps.append(capacity - x)
    return len(gaps)


def matched_one_by_one(sizes, slot):
    stack, pairs = [], set()
    for i, is_slot in enumerate(slot):
        if is_slot:
            stack.append(i)
        elif stack:
            pairs.add((stack.pop(), i))
    return pairs


@settings(max_examples=200, deadline=None)
@given(rows=st.lists(st.tuples(st.integers(1, 9), st.booleans()), max_size=40))
def test_sweep_gives_each_piece_its_successor(rows):
    rows = sorted(rows, key=lambda r: (-r[0], not r[1]))
    slot = np.array([r[1] for r in rows], bool)
    slots, mates, alone, left = packing.sweep_heights(slot)
    assert set(zip(slots.tolist(), mates.tolist())) == matched_one_by_one([r[0] for r in rows], slot)
    assert sorted([*slots, *mates, *alone, *left]) == list(range(len(rows)))


@pytest.mark.parametrize("kind", ["mixed", "ties", "short", "few"])
def test_sweeps_pack_like_best_fit_decreasing(spark, kind):
    rng = np.random.default_rng(3)
    lengths = {
        "mixed": np.minimum(200, rng.lognormal(3.2, 1.2, 1500).astype(int) + 1),
        "ties": rng.choice([200, 101, 67, 50, 3], 1000),
        "short": rng.integers(1, 4, 2000),
        "few": np.array([120, 90, 80, 70, 7, 1]),
    }[kind]
    rows = [(None if i == 5 else i, 0, 0, int(n), i, i) for i, n in enumerate(lengths)]
    scratch = Scratch(spark, "packing-test")
    found = scratch.save(spark.createDataFrame(rows, packing.ITEM), "pieces")
    got = packing.pack(found, scratch, 200, range_rows=300).collect()  # several ranges: what is left meets across them
    assert Counter((r.doc_id, r.length) for r in got) == Counter((r[0], r[3]) for r in rows)
    assert packed_is_sound(got, 200) <= best_fit_one_by_one(lengths.tolist(), 200) * 1.01 + 1


# SimHash


def brute_classes(rows):
    fps = [(r.doc_id, int(r.fingerprint, 16)) for r in rows]
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i][1] ^ fps[j][1]).bit_count() <= 3:
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(fps):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return [least.get(root(i)) for i in range(len(fps))]


@pytest.mark.parametrize("bucket", [2048, 1])
def test_simhash_links_equal_brute_force(spark, docs, bucket):
    found = simhash.near_duplicates(spark, docs, bucket=bucket).collect()
    assert [r.component_id for r in found] == brute_classes(found)


def test_planted_fingerprints_meet_within_three_bits(spark):
    rng = random.Random(9)
    base = rng.getrandbits(64)
    fps = {base}
    for k in range(1, 6):
        for _ in range(12):
            x = base
            for b in rng.sample(range(64), k):
                x ^= 1 << b
            fps.add(x)
    signed = sorted(np.array(list(fps), np.uint64).view(np.int64).tolist())

    from marketloom.llm.graph import components

    wanted = {}
    rows = [type("R", (), {"doc_id": i, "fingerprint": f"{x & (2**64 - 1):016x}"}) for i, x in enumerate(signed)]
    for i, c in enumerate(brute_classes(rows)):
        wanted[signed[i]] = c
    for bucket in (2048, 2):
        s = Scratch(spark, "t")
        links = simhash.fingerprint_links(spark.createDataFrame([(x,) for x in signed], "fp long"), s, bucket)
        label = {r.node: r.label for r in components(links, s).collect()}
        classes = defaultdict(set)
        for x in signed:
            classes[label.get(x, x)].add(wanted[x])
        assert all(len(v) == 1 for v in classes.values()) and len(classes) == len(set(wanted.values()))


def test_variants_of_fingerprints_are_shuffled_once(spark, monkeypatch, capsys):
    """With many buckets of more than two, too: they are compared in runs of sorted variants, however batches cut these."""
    rng = np.random.default_rng(5)
    near = [int(b) ^ 1 << int(i) for b in rng.integers(0, 1 << 62, 200) for i in rng.integers(0, 64, 4)]
    signed = sorted({x - (1 << 64) if x >= 1 << 63 else x for x in near})
    save, shuffles = Scratch.save, []

    def counted(self, df, name):
        df.explain()
        shuffles.append(capsys.readouterr().out.count("hashpartitioning(bucket"))
        return save(self, df, name)

    monkeypatch.setattr(Scratch, "save", counted)
    s = Scratch(spark, "t")
    links = simhash.fingerprint_links(spark.createDataFrame([(x,) for x in signed], "fp long"), s)
    links.explain()
    assert sum(shuffles) + capsys.readouterr().out.count("hashpartitioning(bucket") == 1
    found = {(r.a, r.b) for r in links.collect()}
    assert found and all(((a ^ b) & (1 << 64) - 1).bit_count() <= 3 for a, b in found)


@pytest.mark.parametrize("most", [2, 5, 100])
def test_runs_of_buckets_go_on_from_batch_to_batch(most):
    import pandas as pd

    buckets = {1: 1, 2: 2, 5: 4, 6: 1, 7: 5, 9: 40, 10: 2, 11: 3}
    rows = pd.DataFrame([(b, b << 32 | k) for b, n in buckets.items() for k in range(n)], columns=["bucket", "fp"], dtype="int64")
    seen = []
    for size in (1, 3, 7, 100):
        got = pd.concat(simhash.linked_in_runs(most)(rows[at : at + size] for at in range(0, len(rows), size)))
        alone = {int(a) for a in got["a"][got["b"].isna()]}
        assert alone == {f for b, f in rows.itertuples(index=False) if buckets[b] > most}
        seen.append({(int(a), int(b)) for a, b in got.dropna().itertuples(index=False)})
    assert all(x == seen[0] for x in seen)
    assert all((a ^ b).bit_count() <= 3 for a, b in seen[0])
    assert len(seen[0]) == sum(n - 1 for n in buckets.values() if n <= most)  # low numbers of up to six bits: each bucket is one tree


def test_fingerprint_of_words(spark):
    import xxhash

    assert simhash.fingerprint(None) == simhash.fingerprint(" \n") == 0
    assert simhash.fingerprint("A  b") == xxhash.xxh64_intdigest("a b", seed=42)
    text = "Ä one two three one two"
    grams = ["Ä one two", "one two three", "two three one", "three one two"]
    hashes = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    wanted = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    assert simhash.fingerprint(text) == wanted
    got = spark.createDataFrame([("Ä one two",)], "t string").select(F.xxhash64("t")).first()[0]
    assert got & (2**64 - 1) == hashes[0]


def test_simhash_edge_cases(spark, odd):
    found = simhash.near_duplicates(spark, odd).collect()
    assert len(found) == 12 and [r.component_id for r in found] == brute_classes(found)
    assert {r.component_id for r in found if r.doc_id in (1, 2, 3)} == {1}
    kept = simhash.keep_first(spark, odd)
    assert kept.columns == odd.columns and Counter(r.doc_id for r in kept.collect())[5] == 1
    assert simhash.near_duplicates(spark, none(odd)).count() == 0


# mixing


def brute_targets(sizes):
    order = sorted(s for s in sizes if s is not None) + [s for s in sizes if s is None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    held: dict = {}
    while True:
        rest = [s for s in order if s not in held]
        free = 1.5 * sum(sizes.values()) - sum(held.values())
        total = sum(weight[s] for s in rest)
        now = {s: free * weight[s] / total for s in rest}
        over = {s: 2.0 * sizes[s] for s in rest if now[s] > 2 * sizes[s]}
        if not over:
            return held | now
        held |= over


def test_mixing_meets_targets(spark, docs):
    found = mixing.mix(spark, docs).collect()
    again = mixing.mix(spark, docs.repartition(3)).collect()
    assert {(r.doc_id, r.taken) for r in found} == {(r.doc_id, r.taken) for r in again}
    info = {r.doc_id: r for r in docs.collect()}
    by = defaultdict(list)
    for r in found:
        assert r.size == len(re.findall(r"[^\x20\x09-\x0D]+", info[r.doc_id].text)) and r.taken in (0, r.size, 2 * r.size)
        by[info[r.doc_id].source].append(r)
    wanted = brute_targets({s: sum(r.size for r in rows) for s, rows in by.items()})
    for s, rows in by.items():
        assert rows[0].target == pytest.approx(wanted[s]) and rows[0].source_size == sum(r.size for r in rows)
        assert abs(sum(r.taken for r in rows) - wanted[s]) <= max(r.size for r in rows)


def test_mixing_edge_cases(spark, odd):
    found = mixing.mix(spark, odd).collect()
    assert len(found) == 12 and all(r.taken == 0 for r in found if r.size == 0)
    assert all(r.source_size == 4 and r.target <= 8.0 for r in found if r.doc_id == 5)
    assert mixing.mix(spark, none(odd)).count() == 0
    blank = spark.createDataFrame([(1, " ", "en", "a", 1), (2, None, "en", None, 1)], DOC)
    assert [(r.target, r.taken) for r in mixing.mix(spark, blank).collect()] == [(0.0, 0), (0.0, 0)]
    assert mixing.mixed(spark, odd).columns == odd.columns


def test_pivot_keeps_words():
    import pandas as pd

    rng = np.random.default_rng(1)
    rows = pd.DataFrame({"doc_id": range(500), "source": ["a", None] * 250, "size": rng.integers(1, 50, 500), "copies": 0, "p": rng.random(500), "u": rng.random(500), "bucket": 0})
    before = rows.assign(w=rows["p"] * rows["size"]).groupby("source", dropna=False)["w"].sum()
    after = mixing.pivot(rows)
    assert after.assign(w=after["p"] * after["size"]).groupby("source", dropna=False)["w"].sum().tolist() == pytest.approx(before.tolist())
    assert ((after["p"] > 0) & (after["p"] < 1)).groupby(after["source"].fillna("~")).sum().max() <= 1


# personal data

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")


def plain_spans(text):
    out = [("email", m.start(), m.end()) for m in EMAIL.finditer(text)]
    out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub(r"\D", "", m[0])
        total = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d)))
        if 14 <= len(d) <= 19 and total % 10 == 0:
            out.append(("card", m.start(), m.end()))
    out += [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(re.sub(r"\D", "", m[0])) <= 15]
    return sorted(out, key=lambda s: (s[1], ["email", "ip", "card", "phone"].index(s[0])))


@settings(max_examples=500, deadline=None)
@given(text=st.text(alphabet="ab.@-+ ()0123456789%\n", max_size=60))
def test_base_spans_equal_plain_patterns(text):
    assert pii.base_spans(text) == plain_spans(text)


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(2)
    tagger = pii.Tagger.new()
    tagger.p = {k: v.astype(np.float64) for k, v in tagger.p.items()}
    ids, tags = rng.integers(0, pii.VOCABULARY, (2, 7)), rng.integers(0, pii.TAGS, (2, 7))
    _, g = tagger.gradients(ids, tags)
    for name in ("wx", "wh", "b", "wo", "move", "start", "emb"):
        at = np.unravel_index(np.abs(g[name]).argmax(), g[name].shape)
        keep, step = tagger.p[name][at], 1e-3
        tagger.p[name][at] = keep + step
        up, _ = tagger.gradients(ids, tags)
        tagger.p[name][at] = keep - step
        down, _ = tagger.gradients(ids, tags)
        tagger.p[name][at] = keep
        assert (up - down) / (2 * step) == pytest.approx(g[name][at], rel=2e-2, abs=1e-3)


def test_viterbi_beats_every_other_path():
    import itertools

    tagger = pii.Tagger.new()
    tagger.p["move"] = np.random.default_rng(4).normal(size=(pii.TAGS, pii.TAGS)).astype(np.float32)
    ids = np.random.default_rng(5).integers(0, pii.VOCABULARY, (1, 3))
    e = tagger.emissions(ids)[:, 0]
    tags, _ = tagger.decode(ids)
    value = lambda y: tagger.p["start"][y[0]] + sum(e[k, y[k]] for k in range(3)) + sum(tagger.p["move"][y[k - 1], y[k]] for k in (1, 2))
    assert value(tags[0]) == pytest.approx(max(value(y) for y in itertools.product(range(pii.TAGS), repeat=3)), abs=1e-4)


def test_pii_query_and_added_spans(spark, odd, docs):
    many = docs.withColumn("doc_id", F.col("doc_id") + 1000).unionByName(odd.select(docs.columns))
    text = {r.doc_id: r.text for r in many.collect()}
    for r in pii.find(spark, many).collect():
        own = [(s.kind, s.start, s.end) for s in r.base or []]
        assert own == plain_spans(text[r.doc_id] or "")
        assert not any(s.start < b and a < s.end for s in r.added or [] for _, a, b in own)
    assert pii.find(spark, none(odd)).count() == 0


def test_tagger_adds_spans_that_patterns_miss(spark):
    rows = []
    for k in range(400):
        kind = (f"user{k}@host{k % 7}.example.com", f"+1 (5{k % 90 + 10}) 555-{1000 + k}", f"10.{k % 250}.0.{k % 200}", "4539 1488 0343 6467", f"version {k}.{k % 9} of {1900 + k % 100}")[k % 5]
        rows.append((k, f"some words here {'and more ' * (k % 4)}then {kind} follows in the text", "en", "a", 1))
    tagger = pii.fit(spark.createDataFrame(rows, DOC))
    texts = ["some words here then (555) 555-2345 follows in the text", "some words here and more then 4539 1488 0343 6467 4539 1488 0343 6467 follows", "released in 1998 with version 4.2 of it"]
    base = [pii.base_spans(t) for t in texts]
    added = pii.added_spans(tagger, texts, base)
    assert base == [[], [], []] and [(k, texts[0][a:b]) for k, a, b in added[0]] == [("phone", "(555) 555-2345")] and added[2] == []


def test_spelled_out_addresses_are_read_without_digit_or_at_sign(spark):
    rows = [(k, f"some words here {'and more ' * (k % 4)}then {'abcdefghij'[k % 10]}nna.{'klmnopqrst'[k // 10 % 10]}eyer@host.example.{('com', 'org')[k % 2]} follows in the text", "en", "a", 1) for k in range(400)]
    forms = ["anna.meyer (at) host.example.org", "anna.meyer(at)host.example.org", "anna.meyer [at] host.example.com"]
    rows += [(1000 + i, f"some words here and more then {form} follows in the text", "en", "a", 1) for i, form in enumerate(forms)]
    got = {r.doc_id: r.text for r in pii.redacted(spark, spark.createDataFrame(rows, DOC)).collect()}
    assert {got[1000 + i] for i in range(len(forms))} == {"some words here and more then <EMAIL> follows in the text"}


def test_redaction_keeps_columns(spark, odd):
    got = {r.doc_id: r for r in pii.redacted(spark, odd).collect()}
    assert got[7].text.startswith("mail <EMAIL> and <PHONE>, <IP> and <CARD>") and got[7].n_chars == len(got[7].text)
    assert got[1].text is None and pii.redacted(spark, odd).columns == odd.columns and got[7]._found == "x"


def test_reconcile_prefers_total_confidence():
    got = pii.reconcile([("email", 0, 10, 0.9), ("email", 8, 14, 0.8), ("phone", 12, 20, 0.5), ("ip", 30, 40, 0.7)])
    assert got == [("email", 0, 14, 0.9), ("ip", 30, 40, 0.7)]


# language


def test_language_held_out_accuracy(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = {r.doc_id: r for r in language.identify(spark, docs).collect()}
    held = [(r.lang, found[r.doc_id].lang_pred) for r in docs.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert all(found[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in docs.collect())
    assert sum(a == b for a, b in held) >= 0.95 * len(held)


def viterbi_loop(scores, penalty):
    n, k = scores.shape
    best, back = scores[0].astype(float), []
    for t in range(1, n):
        step = np.where(np.eye(k, dtype=bool), best[:, None], best[:, None] - penalty)
        back.append(step.argmax(0))
        best = step.max(0) + scores[t]
    return best.max()


def path_value(scores, path, penalty):
    return sum(scores[t, path[t]] for t in range(len(path))) - penalty * sum(a != b for a, b in zip(path[1:], path[:-1], strict=True))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 9), min_size=1, max_size=5), st.integers(0, 99))
def test_viterbi_paths_are_best(counts, seed):
    counts = np.array(counts)
    scores = np.random.default_rng(seed).normal(size=(counts.sum(), 3)).astype(np.float32)
    got, at = language.viterbi(scores, counts, 1.0), 0
    for n in counts:
        s = scores[at : at + n]
        assert path_value(s, got[at : at + n], 1.0) == pytest.approx(viterbi_loop(s, 1.0), abs=1e-4)
        at += n


def test_language_spans_of_mixed_text(spark, docs):
    model = language.fit(docs)
    by = {}
    for r in docs.orderBy("doc_id").collect():
        if 300 < len(r.text) < 3000 and "!!" not in r.text and "%%" not in r.text:
            by.setdefault(r.lang, r.text[:250])
    text = by["de"] + " " + by["es"]
    (pred, score, spans), = language.judge(model, [text], language.PENALTY)
    assert pred in ("de", "es") and 0.3 < score < 0.7 and [s[2] for s in spans][0] == "de" and spans[-1][2] == "es"
    assert spans[0][0] == 0 and spans[-1][1] <= len(text)


def test_language_edge_cases(spark, odd):
    found = {r.doc_id: r for r in language.identify(spark, odd).collect()}
    assert [(found[i].lang_pred, found[i].score) for i in (1, 2, 3, 8, 11)] == [("und", 0.0)] * 5
    kept = language.keep_identified(spark, odd)
    assert kept.columns == odd.columns and not {1, 2, 3, 8, 11} & {r.doc_id for r in kept.collect()}
    assert language.identify(spark, none(odd)).count() == 0
    blank = odd.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in language.identify(spark, blank).collect()} == {"und"}


def test_scripts_narrow_candidates(spark):
    rows = [(i, t, lang, "a", 1) for i, (t, lang) in enumerate([("дом мир сад " * 20, "ru"), ("house world garden " * 20, "en")] * 10)]
    model = language.fit(spark.createDataFrame(rows, DOC))
    (a, b) = language.judge(model, ["zzz дом", "сад"], 8.0)
    assert {s[2] for s in a[2]} == {"en", "ru"} and b[0] == "ru"
