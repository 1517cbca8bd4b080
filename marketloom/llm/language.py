"""Language identification of mixed text: script ranges, word scores, and a Viterbi path with a switching penalty.

A model has, for each learned language, log-probabilities of hashed letter trigrams (word ends
included) and the scripts its letters came from. A word's candidates are the languages of its
script; its score in each is the sum over its letters. The Viterbi path through all words of a text pays
``penalty`` for each change of language, which labels spans; the document's language is the one
that labels most letters, and its score that share of letters.

The model is fitted on a sample of labelled documents of at most about ``sample`` per language, chosen by
hash, of the commonest ``MOST_LANGS`` languages: these bounds are parameters. Everything else covers whole texts of all rows.

Edge cases: a text that is null, empty or has no letter is ``und`` with score 0; so is every text if
nothing could be learned. Ties go to the first language by code point. Words in a script that no
language was learned in have all languages as candidates. Repeated rows are judged each for
itself; a null doc_id counts as held out. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, fresh, shared, small_batches, table, worker_wide

BITS = 16
SAMPLE = 2_000
#: Most values of lang that are learned, the commonest: tables of the driver and of tasks are bounded by it.
MOST_LANGS = 128
FOLDS = 5
PENALTY = 8.0
#: Of a language's letters, the share from which a script counts as its own.
OWN_SCRIPT = 0.001
#: Words whose Viterbi paths are found together.
BATCH_WORDS = 1_500_000
SLICE = 1 << 20
#: First and last code point of the scripts told apart; all other letters are one more.
SCRIPTS = {
    "latin": [(0x41, 0x24F), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xFF21, 0xFF5A)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)],
    "armenian": [(0x530, 0x58F)],
    "hebrew": [(0x590, 0x5FF)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)],
    "devanagari": [(0x900, 0x97F)],
    "bengali": [(0x980, 0x9FF)],
    "tamil": [(0xB80, 0xBFF)],
    "thai": [(0xE00, 0xE7F)],
    "georgian": [(0x10A0, 0x10FF)],
    "hangul": [(0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF)],
    "kana": [(0x3040, 0x30FF), (0x31F0, 0x31FF)],
    "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3134F)],
}
OTHER = len(SCRIPTS) + 1
TOP = 0x32000


def script_table() -> np.ndarray:
    """Script number of each code point below ``TOP``; 0 for what is no letter."""
    return worker_wide("script table", made_script_table)


def made_script_table() -> np.ndarray:
    letters = np.fromiter((chr(c).isalpha() for c in range(TOP)), bool, TOP)
    found = np.full(TOP, OTHER, np.uint8)
    for k, ranges in enumerate(SCRIPTS.values(), 1):
        for first, last in ranges:
            found[first : last + 1] = k
    return np.where(letters, found, 0).astype(np.uint8)


def features(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashed trigram of each letter; of each word the first letter's place among letters, its script, and its offset."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    scripts = script_table()[np.minimum(codes, TOP - 1)]
    at = np.flatnonzero(scripts)
    if not len(at):
        none = np.zeros(0, np.int64)
        return none, none, none, none
    padded = np.zeros(len(codes) + 2, np.uint32)
    padded[1:-1] = np.where(scripts > 0, codes, 0)
    h = padded[at] * np.uint32(0x9E3779B1) ^ padded[at + 1] * np.uint32(0x85EBCA77) ^ padded[at + 2] * np.uint32(0xC2B2AE3D)
    h ^= h >> np.uint32(15)
    grams = (h * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - BITS)
    first = np.flatnonzero(np.diff(at, prepend=-2) > 1)
    return grams, first, scripts[at[first]], at[first]


@dataclass
class Model:
    langs: list[str]
    logp: np.ndarray  # (grams, languages)
    barred: np.ndarray  # (scripts, languages): added to the score of each word, 0 or very low

    def word_scores(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores (words, languages), letters and offset of each word; texts are taken in slices that end between words."""
        parts, at = [], 0
        while at < len(text):
            end = at + SLICE
            while end < len(text) and text[end - 1].isalpha() and end < at + 2 * SLICE:
                end += 1
            part = text[at:end]
            low = part.lower()
            low = low if len(low) == len(part) else "".join(c if len(c.lower()) != 1 else c.lower() for c in part)
            grams, first, scripts, offset = features(low)
            if len(first):
                scores = np.add.reduceat(self.logp[grams], first, axis=0) + self.barred[scripts]
                parts.append((scores, np.diff(first, append=len(grams)), offset + at))
            at = end
        if not parts:
            return np.zeros((0, len(self.langs)), np.float32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def viterbi(scores: np.ndarray, counts: np.ndarray, penalty: float) -> np.ndarray:
    """Best label of every word of documents of ``counts`` words, one after the other in ``scores``; documents move in step."""
    by_length = np.argsort(-counts, kind="stable")
    first = (np.cumsum(counts) - counts)[by_length]
    sorted_counts = counts[by_length]
    active = np.searchsorted(-sorted_counts, -np.arange(1, (sorted_counts[0] if len(counts) else 0) + 1), side="right")
    stays = np.ones(scores.shape, bool)
    best = np.zeros(len(scores), np.uint8)  # of the word before, where a change pays
    value = np.zeros((len(counts), scores.shape[1]), np.float64)
    for t, m in enumerate(active):
        v = value[:m]
        top = v.max(axis=1, keepdims=True) - penalty
        rows = first[:m] + t
        if t:
            best[rows] = v.argmax(axis=1)
            stays[rows] = v >= top
            np.maximum(v, top, out=v)
        v += scores[rows]
    label = np.zeros(len(scores), np.uint8)
    now = value.argmax(axis=1).astype(np.uint8)
    for t in range(len(active) - 1, -1, -1):
        m = active[t]
        rows = first[:m] + t
        n = now[:m]
        label[rows] = n
        now[:m] = np.where(stays[rows, n], n, best[rows])
    return label


def judge(model: Model, texts: Iterable[str | None], penalty: float) -> Iterator[tuple[str, float, list[tuple[int, int, str]]]]:
    """Language, score and spans (start, end, language) of each text."""
    batch: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    words = 0

    def flush() -> Iterator[tuple[str, float, list]]:
        counts = np.array([len(s) for s, _, _ in batch], np.int64)
        some = np.flatnonzero(counts)
        if len(some):
            label = viterbi(np.concatenate([batch[i][0] for i in some]), counts[some], penalty)
        at = 0
        for (_, letters, offset), n in zip(batch, counts, strict=True):
            if not n:
                yield "und", 0.0, []
                continue
            own, at = label[at : at + n], at + n
            share = np.bincount(own, letters, minlength=len(model.langs)) / letters.sum()
            heads = np.flatnonzero(np.diff(own, prepend=255))
            tails = np.append(heads[1:], n) - 1
            spans = [(int(offset[a]), int(offset[b] + letters[b]), model.langs[own[a]]) for a, b in zip(heads, tails, strict=True)]
            yield model.langs[int(share.argmax())], float(share.max()), spans

    for text in texts:
        got = model.word_scores(text or "") if model.langs else (np.zeros((0, 0)), np.zeros(0), np.zeros(0))
        batch.append(got)
        words += len(got[0])
        if words >= BATCH_WORDS or len(batch) >= 20_000:
            yield from flush()
            batch, words = [], 0
    yield from flush()


def fold() -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(FOLDS))


def fit(docs: DataFrame, sample: int = SAMPLE, most: int = MOST_LANGS) -> Model:
    """Learn from text and lang of labelled documents outside fold 0: the ``most`` commonest values, about ``sample`` documents of each."""
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold() != 0)).select("doc_id", "lang", "text")
    by_lang = labelled.groupBy("lang").count().orderBy(F.col("count").desc(), "lang")
    counts = {r["lang"]: r["count"] for r in by_lang.limit(most).collect()}
    langs = sorted(counts)
    if not langs:
        return Model([], np.zeros((1 << BITS, 0), np.float32), np.zeros((OTHER + 1, 0), np.float32))
    draw = F.pmod(F.xxhash64("doc_id", F.lit("language sample")), F.lit(1_000_000)) / 1_000_000
    shares = F.create_map(*[F.lit(x) for lang in langs for x in (lang, min(1.0, sample / counts[lang]))])

    def count(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = np.zeros((len(langs), (1 << BITS) + OTHER + 1), np.int64)
        place = {lang: i for i, lang in enumerate(langs)}
        for batch in batches:
            for lang, text in zip(batch["lang"], batch["text"], strict=True):
                for at in range(0, len(text), SLICE):
                    grams, first, scripts, _ = features(text[at : at + SLICE].lower())
                    row = table[place[lang]]
                    row[: 1 << BITS] += np.bincount(grams, minlength=1 << BITS)
                    row[1 << BITS :] += np.bincount(scripts, np.diff(first, append=len(grams)), OTHER + 1).astype(np.int64)
        i, j = table.nonzero()
        yield pd.DataFrame({"lang": i, "feature": j, "n": table[i, j]})

    sampled = labelled.where(F.col("lang").isin(langs)).where(draw < shares[F.col("lang")]).select("lang", "text")
    sums = sampled.mapInPandas(count, "lang int, feature int, n long").groupBy("lang", "feature").agg(F.sum("n").alias("n"))
    with small_batches(docs.sparkSession):
        got = sums.toPandas()  # at most languages * (2 ** BITS + scripts) rows
    counted = np.zeros((len(langs), (1 << BITS) + OTHER + 1))
    counted[got["lang"], got["feature"]] = got["n"]
    grams, scripts = counted[:, : 1 << BITS] + 0.5, counted[:, 1 << BITS :]
    logp = np.log(grams / grams.sum(axis=1, keepdims=True)).T.astype(np.float32)
    own = scripts >= OWN_SCRIPT * np.maximum(1, scripts.sum(axis=1, keepdims=True))
    own |= ~own.any(axis=0, keepdims=True)
    return Model(langs, np.ascontiguousarray(logp), np.where(own, 0.0, -1e6).T.astype(np.float32))


def identified(spark: SparkSession, model: Model, penalty: float = PENALTY) -> Column:
    """Struct (lang_pred, score, spans) of the column ``text``."""
    learned = shared(spark, model)  # at most MOST_LANGS * 2 ** BITS numbers

    @F.pandas_udf("lang_pred string, score double, spans array<struct<start:int,end:int,lang:string>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = learned()
        for texts in batches:
            found = list(judge(own, texts, penalty))
            yield pd.DataFrame(found, columns=["lang_pred", "score", "spans"])

    return run(F.col("text"))


def identify(spark: SparkSession, docs: DataFrame, model: Model | None = None) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, spans`` for every row of ``docs`` (doc_id, text; lang to learn from)."""
    model = model or fit(docs)
    rows = docs.select("doc_id", "text").withColumn("found", identified(spark, model))
    held_out = F.coalesce(fold() == 0, F.lit(True))
    with small_batches(spark):
        return Scratch(spark, "language").finish(rows.select(F.col("doc_id").cast("long"), held_out.alias("held_out"), "found.lang_pred", "found.score", "found.spans"))


def keep_identified(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``docs`` without the documents that are in no language."""
    name = fresh(docs, "_language")
    found = docs.withColumn(name, identified(spark, fit(docs)))
    with small_batches(spark):
        return Scratch(spark, "language").finish(found.where(F.col(name)["lang_pred"] != "und").select(docs.columns))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(spark, table(spark, sf_dir, "documents")).drop("spans")
