"""Substring dedup: Rabin-Karp hashes of every window of words, counted over the corpus, merged into removal intervals.

A task reads whole texts, hashes each window of ``WINDOW`` words in constant work a word (differences of prefix sums
of a polynomial modulo 2^64, two of them) and sends the hashes on in flushes of about ``FLUSH`` windows. Within a
flush a window goes once, with the smallest document that has it; windows of larger ones are known to repeat there
and then, so that a window which a third of all documents share is sent once a flush. Spark deals hashes over
buckets; a bucket finds the smallest document of each hash and sends the places of windows that are not its first
back to their flush, where they merge into maximal intervals.

The hash is as wide as the corpus asks for: so many bits that two different windows anywhere share bucket and key
with a probability below 2^-12. A bucket holds about ``BUCKET`` windows, a flush at most twice ``FLUSH``.

Defined results: null texts have no words; texts shorter than a window keep all words; a null ``doc_id`` counts as
larger than any other and removes nothing elsewhere; rows of equal ``doc_id`` do not remove each other's words;
repeated rows are treated alike; further columns, of whatever name, stay as they are. ``docs`` is to come from files
(or any source that gives its rows in the same order when a lost task runs anew); write a shuffled frame first.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, fresh, small_batches, table

#: Words of a window.
WINDOW = 13
#: Windows of a flush, and of a bucket.
FLUSH, BUCKET = 1 << 20, 1 << 21
#: Words whose hashes a worker remembers.
VOCABULARY = 1 << 19
#: Odd bases of the two polynomials, words of one run of prefix sums.
BASES, STRETCH = (0x9E3779B97F4A7C13, 0xC2B2AE3D27D4EB4B), 1 << 15

SENT = "bucket int, flush long, known int, ids binary, ordinals binary, counts binary, gaps binary, keys binary, docs binary"
BACK = "flush long, ordinals binary, counts binary, gaps binary, docs binary"
FOUND = "doc_id long, text_hash long, spans array<struct<start:int,end:int>>"


class Words(dict):
    """Numbers of words, in order of appearance, with a digest of 128 bits each."""

    def __init__(self):
        super().__init__()
        self.digests = bytearray()

    def __missing__(self, word: bytes) -> int:
        import xxhash

        self.digests += xxhash.xxh3_128_digest(word)
        n = self[word] = len(self)
        return n

    def halves(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        both = np.frombuffer(bytes(self.digests), "<u8").reshape(-1, 2)
        return both[ids, 0], both[ids, 1]


def rolled(values: np.ndarray, base: int, width: int) -> np.ndarray:
    """The polynomial of each ``width`` consecutive values, modulo 2^64: one subtraction of prefix sums each."""
    n = min(len(values), STRETCH + width)
    power, inverse = np.full(n, base, np.uint64), np.full(n, pow(base, -1, 1 << 64), np.uint64)
    power[:1] = inverse[:1] = 1
    power, inverse = np.cumprod(power, dtype=np.uint64), np.cumprod(inverse, dtype=np.uint64)
    out = np.empty(max(0, len(values) - width + 1), np.uint64)
    for at in range(0, len(out), STRETCH):
        part = values[at : at + STRETCH + width - 1]
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(part * inverse[: len(part)], dtype=np.uint64)])
        many = len(part) - width + 1
        out[at : at + many] = (sums[width:] - sums[:many]) * power[width - 1 : width - 1 + many]
    return out


def varints(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Seven bits a byte, low ones first: the bytes, and how many each value took."""
    left, many = values.astype(np.uint64), np.ones(len(values), np.int64)
    for bits in range(7, 64, 7):
        longer = left >> np.uint64(bits) != 0
        if not longer.any():
            break
        many += longer
    out, at, place = np.empty(many.sum(), np.uint8), np.cumsum(many) - many, np.arange(len(values))
    for k in range(int(many.max(initial=0))):
        place = place[many[place] > k]
        out[at[place] + k] = (left[place] >> np.uint64(7 * k) & np.uint64(127)).astype(np.uint8) | (many[place] > k + 1).astype(np.uint8) << 7
    return out, many


def unvarints(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values of ``varints``, and how many lie in each part of ``offsets``."""
    last = data < 128
    ends = np.flatnonzero(last)
    starts = np.concatenate([[0], ends[:-1] + 1]).astype(np.int64) if len(ends) else ends
    shift = (np.arange(len(data)) - np.repeat(starts, ends - starts + 1)) * 7
    parts = (data & 127).astype(np.uint64) << shift.astype(np.uint64)
    values = np.add.reduceat(parts, starts) if len(ends) else np.zeros(0, np.uint64)
    return values, np.diff(np.concatenate([[0], np.cumsum(last)])[offsets])


def running(steps: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of steps, begun anew wherever ``first`` holds."""
    total, at = np.cumsum(steps), np.flatnonzero(first)
    return total - np.repeat(total[at] - steps[at], np.diff(np.append(at, len(steps))))


def steps(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """What ``running`` sums up to ``values``."""
    return np.where(first, values, values - np.concatenate([values[:1], values[:-1]]))


def changes(*columns: np.ndarray) -> np.ndarray:
    """Where any column differs from the row before; the first row does."""
    out = np.ones(len(columns[0]), bool)
    out[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return out


def binaries(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])


def flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a binary column, and where each row's begin and end (nulls: nothing)."""
    values = [v.as_buffer() for v in column]
    offsets = np.cumsum([0, *(0 if v is None else v.size for v in values)])
    return np.frombuffer(b"".join(v for v in values if v is not None), np.uint8), offsets


def packed(segment: np.ndarray, ordinal: np.ndarray, place: np.ndarray, ids: np.ndarray | None = None, known: int = 0) -> tuple[np.ndarray, dict]:
    """Entries sorted by (segment, ordinal, place) as one row of binaries for each segment."""
    head = changes(segment, ordinal)
    at = np.flatnonzero(head)
    opens = np.flatnonzero(changes(segment))
    heads = np.searchsorted(at, np.append(opens, len(segment)))
    first = np.zeros(len(at), bool)
    first[heads[:-1]] = True
    streams = {
        "ordinals": (steps(ordinal[at], first), heads),
        "counts": (np.diff(np.append(at, len(segment))), heads),
        "gaps": (steps(place, head), np.append(opens, len(segment))),
    }
    if ids is not None:
        has = ordinal[at] < known
        firsts = changes(segment[at])[has] if has.all() else changes(segment[at][has])
        streams["ids"] = (steps(ids[ordinal[at]][has], firsts), np.concatenate([[0], np.cumsum(has)])[heads])
    out = {}
    for name, (values, bounds) in streams.items():
        data, many = varints(values)
        out[name] = binaries(data, np.concatenate([[0], np.cumsum(many)])[bounds])
    return opens, out


def unpacked(rows: pa.Table) -> dict[str, np.ndarray]:
    """Entries of ``packed`` rows: row, ordinal and place of each, and the head that it belongs to."""
    ordinals, heads = unvarints(*flat(rows["ordinals"]))
    counts, _ = unvarints(*flat(rows["counts"]))
    gaps, _ = unvarints(*flat(rows["gaps"]))
    row = np.repeat(np.arange(len(heads)), heads)
    ordinals = running(ordinals.astype(np.int64), changes(row)) if len(row) else ordinals.astype(np.int64)
    head = np.repeat(np.arange(len(row)), counts.astype(np.int64))
    place = running(gaps.astype(np.int64), changes(head)) if len(head) else gaps.astype(np.int64)
    return {"head_row": row, "head_ordinal": ordinals, "head": head, "row": row[head], "ordinal": ordinals[head], "place": place}


def repeated(keys: list[np.ndarray], owner: np.ndarray, bounded: np.ndarray) -> np.ndarray:
    """Which entries have an equal key with a smaller owner; where ``bounded`` fails the owner is larger than all."""
    order = np.argsort(keys[0]) if len(keys) == 1 else np.lexsort(keys[::-1])
    first = changes(*[k[order] for k in keys])
    at = np.flatnonzero(first)
    out = np.zeros(len(owner), bool)
    if len(at) < len(owner):
        owners, has = owner[order], bounded[order]
        top = np.iinfo(owner.dtype).max
        least = np.repeat(np.minimum.reduceat(np.where(has, owners, top), at), np.diff(np.append(at, len(owner))))
        some = np.repeat(np.logical_or.reduceat(has, at), np.diff(np.append(at, len(owner))))
        out[order] = np.where(has, owners > least, some)
    return out


def ordered(ids: np.ndarray) -> np.ndarray:
    return ids.astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)


class Flush:
    """Documents, or pieces of long ones, whose windows are sent together."""

    def __init__(self, words: Words, buckets: int, extra: int, window: int):
        self.words, self.buckets, self.extra, self.window = words, buckets, extra, window
        self.pieces: dict[tuple, np.ndarray] = {}
        self.size = 0

    def add(self, doc_id: int | None, text_hash: int, at: int, ids: np.ndarray) -> None:
        if len(ids) >= self.window and (key := (doc_id is None, doc_id or 0, text_hash, at)) not in self.pieces:
            self.pieces[key] = ids
            self.size += len(ids)

    def batches(self, flush: int) -> Iterator[pa.RecordBatch]:
        if not self.pieces:
            return
        docs = sorted(self.pieces)
        known = sum(not d[0] for d in docs)
        ids, hashes, begins = (np.array([d[k] for d in docs], np.int64) for k in (1, 2, 3))
        lengths = np.array([len(self.pieces[d]) for d in docs])
        windows = lengths - self.window + 1
        words = self.words.halves(np.concatenate([self.pieces[d] for d in docs]))
        whole = [rolled(w, base, self.window) for w, base in zip(words, BASES, strict=True)]
        ordinal = np.repeat(np.arange(len(docs)), windows)
        inside = np.arange(len(ordinal)) - np.repeat(np.cumsum(windows) - windows, windows)
        start = np.repeat(np.cumsum(lengths) - lengths, windows) + inside
        a, b = (w[start] for w in whole)
        del words, whole, start
        a ^= b >> np.uint64(29)
        a *= np.uint64(0xBF58476D1CE4E5B9)
        bucket = ((a >> np.uint64(32)) % np.uint64(self.buckets)).astype(np.int32)
        rest = (a & np.uint64((1 << 8 * self.extra) - 1)).astype(np.uint32)
        place = inside + begins[ordinal]
        owner = ordered(ids)
        done = repeated([b, a], owner[ordinal], ordinal < known)
        packed_docs = np.array([known], np.int64).tobytes() + ids.tobytes() + hashes.tobytes()
        opens, row = packed(np.zeros(done.sum(), np.int8), ordinal[done], place[done])
        none = pa.array([b""])
        row = row if len(opens) else {"ordinals": none, "counts": none, "gaps": none}
        row |= {"bucket": pa.array([flush * 0x9E3779B1 % self.buckets], pa.int32()), "flush": pa.array([flush]), "known": pa.array([known], pa.int32()), "ids": none, "keys": none, "docs": pa.array([packed_docs])}
        yield sent(row)
        left = np.flatnonzero(~done)
        left = left[np.argsort(bucket[left], kind="stable")]
        opens, row = packed(bucket[left], ordinal[left], place[left], owner, known)
        keys = np.empty((len(left), 8 + self.extra), np.uint8)
        keys[:, :8] = b[left].view(np.uint8).reshape(-1, 8)
        keys[:, 8:] = rest[left].view(np.uint8).reshape(-1, 4)[:, : self.extra]
        many = len(opens)
        row |= {"bucket": pa.array(bucket[left][opens]), "flush": pa.array(np.full(many, flush)), "known": pa.array(np.full(many, known, np.int32))}
        row |= {"keys": binaries(keys, np.append(opens, len(left)) * (8 + self.extra)), "docs": pa.nulls(many, pa.binary())}
        yield sent(row)


def sent(row: dict) -> pa.RecordBatch:
    names = [c.split()[0] for c in SENT.split(", ")]
    return pa.RecordBatch.from_arrays([row[n] for n in names], names)


def sender(buckets: int, extra: int, window: int, most: int):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        flush, number = Flush(words, buckets, extra, window), TaskContext.get().partitionId() << 32
        for batch in batches:
            for doc_id, text_hash, text in zip(*(batch.column(k) for k in range(3)), strict=True):
                found = text.as_py().encode().split() if text.is_valid else []
                if len(found) < window:
                    continue
                ids = np.fromiter(map(words.__getitem__, found), np.int32, len(found))
                for at in range(0, len(ids) - window + 1, most):
                    flush.add(doc_id.as_py(), text_hash.as_py(), at, ids[at : at + most + window - 1])
                    if flush.size >= most:
                        yield from flush.batches(number)
                        number += 1
                        flush = Flush(words, buckets, extra, window)
                if len(words) > VOCABULARY:
                    yield from flush.batches(number)
                    number += 1
                    words = Words()
                    flush = Flush(words, buckets, extra, window)
        yield from flush.batches(number)

    return send


def counter(extra: int):
    def count(rows: pa.Table) -> pa.Table:
        """One bucket: places of windows that a smaller document has; rows of documents go through."""
        through = rows.filter(rows["docs"].is_valid())
        out = [through.select(["flush", "ordinals", "counts", "gaps", "docs"])]
        rows = rows.filter(rows["docs"].is_null())
        if len(rows):
            e = unpacked(rows)
            known = rows["known"].to_numpy()
            has = e["head_ordinal"] < known[e["head_row"]]
            owner = np.zeros(len(has), np.uint64)
            ids, _ = unvarints(*flat(rows["ids"]))
            if len(ids):
                owner[has] = running(ids, changes(e["head_row"][has]))
            keys = flat(rows["keys"])[0].reshape(-1, 8 + extra)
            parts = [np.ascontiguousarray(keys[:, :8]).view(np.uint64).ravel()]
            if extra:
                rest = np.zeros((len(keys), 4), np.uint8)
                rest[:, :extra] = keys[:, 8:]
                parts.append(rest.view(np.uint32).ravel())
            hit = repeated(parts, owner[e["head"]], has[e["head"]])
            if hit.any():
                row = e["row"][hit]
                opens, found = packed(row, e["ordinal"][hit], e["place"][hit])
                found |= {"flush": pa.array(rows["flush"].to_numpy()[row[opens]]), "docs": pa.nulls(len(opens), pa.binary())}
                out.append(pa.table({n: found[n] for n in ("flush", "ordinals", "counts", "gaps", "docs")}))
        return pa.concat_tables(out)

    return count


def merger(window: int):
    def merge(rows: pa.Table) -> pa.Table:
        """One flush: its documents' repeated windows as maximal intervals."""
        docs = np.frombuffer(rows["docs"].drop_null()[0].as_py(), np.int64)
        known, ids, hashes = int(docs[0]), *np.split(docs[1:], 2)
        e = unpacked(rows)
        order = np.lexsort((e["place"], e["ordinal"]))
        ordinal, place = e["ordinal"][order], e["place"][order]
        opens = changes(ordinal)
        opens[1:] |= place[1:] > place[:-1] + window
        at = np.flatnonzero(opens)
        last = np.append(at[1:], len(place))[: len(at)] - 1
        spans = pa.StructArray.from_arrays([pa.array(place[at].astype(np.int32)), pa.array((place[last] + window).astype(np.int32))], ["start", "end"])
        per = np.flatnonzero(changes(ordinal[at]))
        of = ordinal[at][per]
        lists = pa.ListArray.from_arrays(pa.array(np.append(per, len(at)).astype(np.int32)), spans)
        return pa.table({"doc_id": pa.array(ids[of], pa.int64(), mask=of >= known), "text_hash": pa.array(hashes[of]), "spans": lists})

    return merge


def repeated_spans(docs: DataFrame, window: int = WINDOW, flush: int = FLUSH, bucket: int = BUCKET) -> DataFrame:
    """``(doc_id, text_hash, spans)``: of each text with windows that a smaller ``doc_id`` has too, the intervals of words that they cover.

    ``text_hash`` is ``xxhash64(text)`` and tells texts of one ``doc_id`` apart. Spans count words from 0, ends are exclusive; those of
    one row are maximal within a piece of about ``flush`` words and in order.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    size = texts.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / 6 / bucket))
    # windows are at most half the bytes; the pairs among them need so many bits
    extra = min(4, max(0, math.ceil((2 * math.log2(size / 2 + 2) + 12 - math.log2(buckets)) / 8) - 8))
    entries = texts.mapInArrow(sender(buckets, extra, window, flush), SENT)
    back = entries.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(counter(extra), BACK)
    found = back.groupBy("flush").applyInArrow(merger(window), FOUND)
    # pieces of a long text, and repeats of a row, meet here
    return found.groupBy("doc_id", "text_hash").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("spans")))).alias("spans"))


def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Appends to (..., text, spans): the kept text, the number of words and of removed ones."""
    for batch in batches:
        kept, total, gone = [], [], []
        for text, spans in zip(batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1), strict=True):
            words = text.as_py().encode().split() if text.is_valid else []
            total.append(len(words))
            if spans.is_valid:
                keep = np.ones(len(words), bool)
                for span in spans.as_py():
                    keep[span["start"] : span["end"]] = False
                words = [words[k] for k in np.flatnonzero(keep)]
            kept.append(b" ".join(words))
            gone.append(total[-1] - len(words))
        made = [pa.array(kept, pa.binary()).cast(pa.string()), pa.array(total, pa.int64()), pa.array(gone, pa.int64())]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-2], *made], [str(k) for k in range(batch.num_columns + 1)])


def without_repeats(docs: DataFrame, window: int = WINDOW, flush: int = FLUSH, bucket: int = BUCKET) -> DataFrame:
    """``docs`` with ``kept`` (the words that stay, joined by a space), ``n_words`` and ``n_removed`` after its columns."""
    spans = repeated_spans(docs, window, flush, bucket).select(F.col("doc_id").alias("_of"), F.col("text_hash").alias("_text_hash"), F.col("spans").alias("_spans"))
    plain = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])  # names of no column clash
    lower = [c.lower() for c in docs.columns]
    doc_id, text = (F.col(f"c{lower.index(n)}") for n in ("doc_id", "text"))
    joined = plain.join(spans, doc_id.cast("long").eqNullSafe(F.col("_of")) & (F.xxhash64(text) == F.col("_text_hash")), "left")
    joined = joined.select(*plain.columns, text.alias("_text"), "_spans")
    names = []
    for name in ("kept", "n_words", "n_removed"):
        names.append(fresh(docs, name))
    kinds = [f"{c} {t}" for c, t in plain.dtypes] + ["kept string", "n_words long", "n_removed long"]

    def renamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels = [k.split()[0] for k in kinds]
        for batch in cut(batches):
            yield batch.rename_columns(labels)

    return joined.mapInArrow(renamed, ", ".join(kinds)).toDF(*docs.columns, *names)


def op12_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole ``documents``: numbers of words and of removed ones, digest of the kept words."""
    scratch = Scratch(spark, "substrings")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    with small_batches(spark):
        kept = without_repeats(docs)
        return scratch.finish(kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256")))


OP12_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
p AS (SELECT doc_id, words, unnest(generate_series(1, len(words))) AS pos FROM w),
s AS (SELECT doc_id, pos, words[pos] AS word, CASE WHEN pos + 12 <= len(words) THEN array_to_string(words[pos:pos + 12], ' ') END AS span FROM p),
f AS (SELECT *, CASE WHEN span IS NOT NULL AND doc_id > min(doc_id) OVER (PARTITION BY span) THEN 1 ELSE 0 END AS hit FROM s),
c AS (SELECT *, max(hit) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) AS gone FROM f),
k AS (SELECT doc_id, count(*) AS n_words, sum(gone) AS n_removed, string_agg(word, ' ' ORDER BY pos) FILTER (gone = 0) AS kept FROM c GROUP BY doc_id)
SELECT w.doc_id, CAST(coalesce(n_words, 0) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN k USING (doc_id)
"""
