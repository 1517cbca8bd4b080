"""Best-fit packing of tokenized documents into sequences of a fixed length, in bulk-synchronous supersteps.

Pieces of documents go in classes from the longest down; a class holds the lengths of which ``k`` to ``k'`` fit a whole
sequence (``CLASSES``). A superstep takes the pieces of a class and all gaps that hold one of them:

1. A gap becomes slots, as many as pieces of the class's longest length fit, one at least. Pieces and slots
   are range-sorted together by size, largest first, so that a length that many pieces have fills many tasks.
2. Successor sweep: going down, a piece takes the smallest slot met before it that no piece before it took: its
   successor in size. Two pieces that want one slot are so resolved by rank. Each task sweeps its own range. What is left
   of ranges meets across them: by counts of each range, the height at which a range's slots are stacked and
   its pieces take from is known, and pieces and slots of one height alternate.
3. Gaps are updated by what they took, and the sweep is repeated while it places over one in ``AGAIN`` pieces.
4. Pieces without a slot open sequences, as many of one length class to a sequence as fit, by rank. Those that fill no
   sequence wait for the gaps of the next class.

In the end there are at most a few thousand pieces left, whatever the corpus (less than a sequence of each ``k``); one
task gives them to the best of sequences of their own.

Edge cases: a null text is an empty document (one closing id). Repeated rows are packed once for
each row. A null doc_id is kept as it is. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Generations, Scratch, small_batches, table, worker_wide

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
ITEM = f"{PIECES}, item long"
#: Least number of pieces to a sequence in each class but the first, which has one.
CLASSES = (2, 3, 4, 6, 8, 12, 16, 32, 64, 256)
#: Rows of a range of the sweep.
RANGE_ROWS = 8_192
#: A sweep is repeated while it places over one in so many pieces.
AGAIN = 16
#: Entries of each generation of the word caches (chunks between blanks, and their parts).
CACHE = 200_000
#: The same in the pipeline, whose other stages share the memory of the workers.
STAGE_CACHE = 50_000


class WordEncoder:
    """Ids of whole texts, from bounded caches of the ids of chunks between blanks.

    The tokenizer drops white space, so a text's ids are those of its chunks. Chunks of Latin
    letters with closing punctuation go straight to the tokenizer's model; all others are
    encoded by the whole tokenizer.
    """

    SIMPLE = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\\[-`{-~]*)")

    def __init__(self, path: str, bound: int = CACHE):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.bound = bound
        self.forget()
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in printable]
        as_char = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}
        self.table = {c: "".join(as_char[b] for b in chr(c).encode()) for c in range(256)}

    def _part(self, part: str) -> bytes:
        return np.array([t.id for t in self.model.tokenize(part.translate(self.table))], "<u4").tobytes() if part else b""

    def _chunk(self, chunk: str) -> bytes:
        if m := self.SIMPLE.fullmatch(chunk):
            word = m[1].lower()
            return self.parts[chunk if word == chunk else word] + self.parts[m[2]]  # one key for both caches
        return np.array(self.tokenizer.encode(chunk, add_special_tokens=False).ids, "<u4").tobytes() if chunk else b""

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        return b"".join(map(self.chunks.__getitem__, text.replace("\n", " ").split(" ")))

    def forget(self) -> None:
        """Start with empty caches."""
        self.chunks, self.parts = Generations(self._chunk, self.bound), Generations(self._part, self.bound)


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, cache: int = CACHE, keep: bool = True) -> DataFrame:
    """A row for each piece of each document: ids of the text, then ``end_id``, cut at ``capacity``.

    Caches of ``cache`` entries; without ``keep`` they go with their task: Spark takes turns with idle workers, all of which would hold them.
    """
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_wide(f"encoder {cache} {tokenizer_path}", lambda: WordEncoder(tokenizer_path, cache))
        try:
            for batch in batches:
                rows = []
                for doc_id, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                    ids = encoder.encode(text) + end
                    for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[at : at + 4 * capacity]
                        rows.append((doc_id, k, at // 4, len(part) // 4, zlib.crc32(part)))
                columns = zip(*rows, strict=True) if rows else [()] * 5
                types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names(PIECES))
        finally:
            if not keep:
                encoder.forget()

    return docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(cut, PIECES)


def names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def sweep_heights(slot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pieces and slots in order, largest first (``slot`` tells which): places of the matched slots and of their pieces, of
    the pieces without a slot, and of the slots left."""
    walk = np.cumsum(np.where(slot, 1, -1))
    low = np.minimum.accumulate(np.minimum(walk, 0))
    alone = ~slot & (np.diff(low, prepend=0) < 0)  # met with no slot stacked
    height = walk - low + ~slot  # of the slot that is put or taken
    meet = np.flatnonzero(~alone)
    meet = meet[np.argsort(height[meet], kind="stable")]  # at each height slots and pieces alternate, slots first
    pair = np.flatnonzero(slot[meet[:-1]] & ~slot[meet[1:]])
    taken = np.zeros(len(slot), bool)
    taken[meet[pair]] = taken[meet[pair + 1]] = True
    return meet[pair], meet[pair + 1], np.flatnonzero(alone), np.flatnonzero(slot & ~taken)


SWEPT = f"part int, what string, nth long, {ITEM}, sequence long, slot int, used long"


def swept(batches: Iterable[pa.RecordBatch], part: int) -> Iterator[pa.RecordBatch]:
    """One range of a sweep: rows ``pair`` (a piece with its slot), and what is left, ``piece`` and ``slot``, by rank."""
    held = list(batches)  # about RANGE_ROWS
    if not sum(b.num_rows for b in held):
        return
    rows = pa.Table.from_batches(held).combine_chunks()
    own, gap = names(ITEM), ["sequence", "slot", "used"]
    slots, mates, alone, left = sweep_heights(rows["sequence"].is_valid().to_numpy())
    for what, some, at in (("pair", mates, slots), ("piece", alone, alone), ("slot", left, left)):
        columns = [rows[c].take(some) for c in own] + [rows[c].take(at) for c in gap]
        first = [pa.array(np.full(len(some), part, np.int32)), pa.array([what] * len(some), pa.string()), pa.array(np.arange(len(some)))]
        yield from pa.table(first + columns, names(SWEPT)).to_batches()


def sweep(scratch: Scratch, found: DataFrame, gaps: DataFrame, longest: int, many: int, name: str, range_rows: int = RANGE_ROWS) -> tuple[DataFrame, int]:
    """One successor sweep of the pieces ``found`` over the slots of ``gaps`` (sequence, used, room).

    Rows ``pair``, and ``piece`` for those without a slot with their range and rank in it; and the number of pairs.
    """
    rooms = gaps.groupBy("room").count().collect()  # at most `capacity` rows
    each = max(1, -(-2 * many // max(1, sum(r["count"] for r in rooms))))  # slots beyond twice the pieces wait for the next sweep
    slots_of = F.least(F.lit(each), F.greatest(F.lit(1), F.floor(F.col("room") / longest))).cast("int")
    total = many + sum(r["count"] * min(each, max(1, r["room"] // longest)) for r in rooms)
    cut = gaps.withColumn("slots", slots_of).withColumn("slot", F.explode(F.sequence(F.lit(0), F.col("slots") - 1)))
    rest = F.when(F.col("slot") == 0, F.col("room") - (F.col("slots") - 1) * F.floor(F.col("room") / F.col("slots")))
    cut = cut.select("sequence", "slot", "used", F.coalesce(rest, F.floor(F.col("room") / F.col("slots"))).alias("size"))
    both = found.withColumn("size", F.col("length")).unionByName(cut, allowMissingColumns=True)
    order = [F.col("size").desc(), F.col("sequence").isNull(), F.coalesce("item", "sequence"), F.col("slot")]
    n = -(-total // range_rows)
    ranged = both.repartitionByRange(n, *order) if n > 1 else both.coalesce(1)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return swept(batches, TaskContext.get().partitionId())

    columns = [*names(ITEM), "sequence", "slot", "used"]
    rows = scratch.save(ranged.sortWithinPartitions(*order).select(columns).mapInArrow(run, SWEPT), name)
    sizes = rows.groupBy("part").agg(*[F.count_if(F.col("what") == w).alias(w) for w in ("pair", "piece", "slot")]).orderBy("part").collect()  # a row for each range
    stacked, heights, met = 0, [], sum(r["pair"] for r in sizes)
    for r in sizes:
        takes = min(stacked, r["piece"])
        heights.append((r["part"], stacked, takes))
        stacked += r["slot"] - takes
        met += takes
    if met > sum(r["pair"] for r in sizes):
        part, before, takes = (pa.array(c, t) for c, t in zip(zip(*heights, strict=True), (pa.int32(), pa.int64(), pa.int64()), strict=True))
        known = scratch.spark.createDataFrame(pa.table([part, before, takes], ["part", "stacked", "takes"]))
        left = rows.where("what <> 'pair'").join(F.broadcast(known), "part")  # a row for each range
        height = F.when(F.col("what") == "slot", F.col("stacked") - F.col("takes") + F.col("nth")).when(F.col("nth") < F.col("takes"), F.col("stacked") - 1 - F.col("nth"))
        left = left.withColumn("height", height)
        by = Window.partitionBy("height").orderBy("part", "what")  # a range's pieces take before its slots are put
        mates = left.where("height is not null")
        for c in ("sequence", "slot", "used"):
            mates = mates.withColumn(f"_{c}", F.lag(c).over(by))
        mates = mates.where("what = 'piece'").select("part", F.lit("pair").alias("what"), "nth", *names(ITEM), *[F.col(f"_{c}").alias(c) for c in ("sequence", "slot", "used")])
        alone = left.where("what = 'piece' and height is null").select(rows.columns)
        rows = scratch.save(rows.where("what = 'pair'").unionByName(mates).unionByName(alone), f"{name}-met")
        scratch.drop(name)
    return rows, met


def placed(pairs: DataFrame) -> DataFrame:
    """Rows of the result for pieces with a slot: those of one sequence lie behind each other, and behind what it held."""
    behind = Window.partitionBy("sequence").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.col("used") + F.coalesce(F.sum("length").over(behind), F.lit(0))
    return pairs.select(*names(PIECES), F.col("sequence").alias("sequence_id"), offset.alias("offset"))


def opened(rows: DataFrame, capacity: int) -> DataFrame:
    """Pieces by ``part`` and ``nth`` with the sequence that they open, full ones only: as many pieces to a sequence as its length class fits."""
    k = F.floor(F.lit(capacity) / F.col("length"))
    by = Window.partitionBy("part", "k")
    rows = rows.withColumn("k", k).withColumn("rank", F.row_number().over(by.orderBy("nth")) - 1).withColumn("all", F.count(F.lit(1)).over(by))
    rows = rows.withColumn("bin", F.when(F.col("rank") < F.col("all") - F.col("all") % F.col("k"), F.floor(F.col("rank") / F.col("k"))))
    within = Window.partitionBy("part", "k", "bin").orderBy("rank")
    behind = F.coalesce(F.sum("length").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = F.first("item").over(within.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    full = F.col("bin").isNotNull()
    return rows.withColumn("sequence_id", F.when(full, first)).withColumn("offset", F.when(full, behind)).drop("rank", "all", "bin")


def best_left(batches: Iterable[pa.RecordBatch], capacity: int) -> Iterator[pa.RecordBatch]:
    """Best fit of a bounded rest, longest first, in sequences of its own."""
    held = list(batches)
    if not held:
        return
    found = pa.Table.from_batches(held).combine_chunks().sort_by([("length", "descending"), ("item", "ascending")])
    rooms: list[tuple[int, int]] = []
    out = []
    for item, length in zip(found["item"].to_pylist(), found["length"].to_pylist(), strict=True):
        at = bisect_left(rooms, (length, -1))
        room, sequence = rooms.pop(at) if at < len(rooms) else (capacity, item)
        out.append((sequence, capacity - room))
        if room > length:
            insort(rooms, (room - length, sequence))
    for k, name in enumerate(("sequence_id", "offset")):
        found = found.append_column(name, pa.array([o[k] for o in out], pa.int64()))
    yield from found.to_batches()


def pack(found: DataFrame, scratch: Scratch, capacity: int = 2048, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Place pieces (columns of ``ITEM``, already written once) in sequences."""
    item, result = names(ITEM), [*names(PIECES), "sequence_id", "offset"]
    counts = {r["length"]: r["count"] for r in found.groupBy("length").count().collect()}  # at most `capacity` rows
    alone = found.where(F.col("length") > capacity // 2)
    done = [alone.select(*result[:-2], F.col("item").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))]
    gaps = alone.where(F.col("length") < capacity).select(F.col("item").alias("sequence"), F.col("length").alias("used"))
    gaps = scratch.save(gaps, "gaps")
    carried, waiting, step = None, 0, 0
    spans = [(capacity // after + 1, capacity // k) for k, after in zip(CLASSES, (*CLASSES[1:], capacity + 1), strict=True)]
    spans = [(a, b, sum(n for length, n in counts.items() if a <= length <= b)) for a, b in spans]
    spans = [s for s in spans if s[2]]
    for shortest, longest, many in spans:
        now, many = found.where(F.col("length").between(shortest, longest)), many + waiting
        now = now if carried is None else now.unionByName(carried)
        while many:
            step += 1
            open_now = gaps.withColumn("room", F.lit(capacity) - F.col("used")).where(F.col("room") >= shortest)
            rows, met = sweep(scratch, now, open_now, longest, many, f"sweep-{step}", range_rows)
            if met:
                pairs = scratch.save(placed(rows.where("what = 'pair'")), f"placed-{step}")
                done.append(pairs)
                took = pairs.select(F.col("sequence_id").alias("sequence"), F.col("length").alias("used"))
                gaps = gaps.unionByName(took).groupBy("sequence").agg(F.sum("used").alias("used")).where(F.col("used") < capacity)
                gaps = scratch.save(gaps, f"gaps-{step}")
            now, again = rows.where("what = 'piece'"), met * AGAIN > many or (met > 0 and shortest == spans[-1][0])
            many -= met
            if not again:
                break
            now = now.select(item)
        carried, waiting = None, 0
        if many:
            first = scratch.save(opened(now.select("part", "nth", *item), capacity), f"opened-{step}")
            # what fills no sequence within its range meets across ranges
            across = opened(first.where("sequence_id is null").select(F.lit(0).alias("part"), "item", *item[:-1], F.struct("part", "nth").alias("nth")), capacity)
            rest = scratch.save(across, f"across-{step}")
            both = first.where("sequence_id is not null").select(result).unionByName(rest.where("sequence_id is not null").select(result))
            done.append(both)
            new = both.groupBy(F.col("sequence_id").alias("sequence")).agg(F.sum("length").alias("used")).where(F.col("used") < capacity)
            gaps = scratch.save(gaps.unionByName(new), f"gaps-{step}-opened")
            carried = rest.where("sequence_id is null").select(item)
            waiting = carried.count()
    if waiting:
        last = carried.coalesce(1).mapInArrow(lambda batches: best_left(batches, capacity), f"{ITEM}, sequence_id long, offset long")
        done.append(last.select(result))
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return scratch.finish(out)


def best_fit(spark: SparkSession, docs: DataFrame, tokenizer_path: str | None = None, capacity: int = 2048, cache: int = CACHE, keep: bool = True) -> DataFrame:
    """Tokenize, cut and pack ``docs`` (doc_id, text); ``cache`` and ``keep`` as in ``pieces``."""
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path("word_bpe_49k.json")
    scratch = Scratch(spark, "packing")
    with small_batches(spark):
        found = scratch.save(pieces(docs, tokenizer_path, capacity, cache=cache, keep=keep).withColumn("item", F.monotonically_increasing_id()), "pieces")
    return pack(found, scratch, capacity)


def op5_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit(spark, table(spark, sf_dir, "documents"))
