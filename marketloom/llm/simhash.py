"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Fingerprints link at ``RADIUS`` = 3 or fewer differing bits. An odd radius has no middle, so one of ``MASKS`` blocks of bits is left
out at a time: two fingerprints that differ in 3 bits differ in 2 at most outside of a block that holds one of them.
For each block every fingerprint emits all variants within half of that, 1 bit, of its other bits (132 variants for
three blocks). Two fingerprints within 2 bits there share a variant. Variants are shuffled once and sorted in their tasks;
fingerprints that collide are verified on all 64 bits, and pairs deduplicated.

Buckets are runs of the sorted variants, compared as they pass, up to ``BUCKET`` distinct fingerprints. Beyond, pairs would be
too many, and the exact way is whole balls on 64 bits: radius 1 from fingerprints with an odd number of ones and radius 2
(2,081 variants) from the others. At a variant that both kinds reach, every odd one is within 3 bits of every even one, and
two of a kind that share a radius-1 variant are within 2 bits, so all that meet so are linked through the
variant as a hub, without pairs.

Copies share a fingerprint; graphs are over distinct fingerprints, and documents look up their class by
fingerprint and salt.

The pipeline's stage (``keep_first``) links texts that share four fifths or more of their five-word shingles; texts with
equal shingle sets are one node. Candidates are fingerprints in each other's balls, and, as few such texts are within 3
bits, nodes that agree in a band of shingle minima. In each bucket the nodes are held against two drawn members.
Buckets whose nodes are still in several classes are searched whole, whatever their size, in pairs of blocks of ``BLOCK``
nodes: every two nodes of different classes are compared, in the first band in which they agree. Minima rule out pairs
that are far from alike, and every link is checked on the whole shingle sets. No task emits pairs: blocks say which nodes
have anything near, and then give forests of links. What the largest class of a bucket holds is not compared with itself,
so that near copies of one text, however many, cost in proportion; many texts that agree in a band and are in as many
classes cost the square of their number, a block at a time.

Edge cases: a null text has no words, like an empty one: fingerprint zero, linked like any
other. A null doc_id gets a class from the others of its class. Repeated rows are repeated in the
result. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, batches_of, keyed, small_batches, table
from .graph import components, looked_up

WORDS = 3
RADIUS = 3
#: Blocks of bits that are left out, one at a time.
MASKS = 3
#: Most distinct fingerprints of a bucket that are compared with each other in one task.
BUCKET = 2048
CHUNK = 1 << 15
#: Rows of variants in an Arrow batch: two longs each.
RUN_ROWS = 1 << 16
#: Fingerprints whose variants one task emits.
FPS_OF_TASK = 8_192
#: Keys up to which a table that only selects rows is broadcast; a larger one is joined by a shuffle.
BROADCAST_KEYS = 1 << 20
#: What the pipeline's stage takes for near copies: this share, in fifths, of the shingles of so many words.
STAGE_WORDS, FIFTHS = 5, 4
#: Bands of minima and minima in each: texts that share four fifths meet in a band with probability 1 - (1 - 0.8**4)**14 = 0.9994.
BANDS, MINIMA = 14, 4
#: Share of equal minima under which a pair is not checked: 3.4 standard errors below four fifths.
NEAR = 0.62
#: Most drawn nodes that a node is held to by its whole set; what else is alike comes to light in the buckets that are still apart.
NEAREST = 2
#: Nodes of a bucket that are compared with each other, or with another block, in one go: larger buckets take all pairs of blocks.
BLOCK = 512


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """Bit i is set if it is in over half of the shingles' hashes."""
    import xxhash

    found = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z and ASCII white space
    if not found:
        return 0
    if len(found) < words:
        return xxhash.xxh64_intdigest(b" ".join(found), seed=42)
    total = len(found) - words + 1
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_digest
    for at in range(0, total, CHUNK):
        many = min(CHUNK, total - at)
        part = found[at : at + many + words - 1]
        raw = b"".join([digest(s, 42) for s in map(b" ".join, zip(*[part[i : i + many] for i in range(words)], strict=True))])
        bits = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(many, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * ones > total).tobytes(), "big")


def fingerprints(docs: DataFrame, key: Sequence[str] = ()) -> DataFrame:
    """``doc_id``, ``fp`` (the 64 bits as a signed long), and the long columns ``key`` of ``docs``."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fps = np.array([fingerprint(t) for t in batch["text"]], np.uint64).view(np.int64)
            yield batch[["doc_id", *key]].assign(fp=fps)

    kept = "".join(f", `{k}` long" for k in key)
    return docs.select(F.col("doc_id").cast("long"), *key, "text").mapInPandas(run, f"doc_id long{kept}, fp long")


def variants(fps: DataFrame) -> DataFrame:
    """``bucket`` for every distinct fingerprint ``fp`` and block: its other bits and all within one bit of them, the block's number in its place."""
    cuts = [64 * k // MASKS for k in range(MASKS + 1)]
    signed = lambda x: x - (1 << 64) if x >= 1 << 63 else x
    balls = []
    for k, (low, high) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        block = (1 << high) - (1 << low)
        flips = F.array(*[F.lit(signed(f)).cast("long") for f in [0, *[1 << i for i in range(64) if not block >> i & 1]]])
        base = F.col("fp").bitwiseAND(F.lit(signed(~block & (1 << 64) - 1))).bitwiseXOR(F.lit(signed((k + 1) << low)))
        balls.append(F.transform(flips, (lambda own: lambda f: own.bitwiseXOR(f))(base)))
    return fps.select(F.explode(F.concat(*balls)).alias("bucket"), "fp")


def forest(u: np.ndarray) -> list[tuple[np.uint64, np.uint64]]:
    """A forest of the links among the distinct fingerprints ``u``: every linked one with an earlier one."""
    edges, label = [], np.arange(len(u))
    for i in range(1, len(u)):
        near = np.flatnonzero(np.bitwise_count(u[:i] ^ u[i]) <= RADIUS)
        roots = np.unique(label[near])
        if len(roots):  # links that join trees are enough
            edges += [(u[near[label[near] == r][0]], u[i]) for r in roots]
            label[np.isin(label, roots)] = roots[0]
            label[i] = roots[0]
    return edges


def linked_in_runs(most: int) -> Callable[[Iterable[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Links (a, b) within each bucket of rows (bucket, fp) in the order of buckets; of a bucket of over ``most`` rows, each fingerprint as ``a`` alone.

    Only the last bucket of a batch waits for the next batch, until it has more than ``most`` rows.
    """

    def links(bucket: np.ndarray, fp: np.ndarray) -> list[np.ndarray]:
        start = np.flatnonzero(np.diff(bucket, prepend=~bucket[:1]))
        size = np.diff(start, append=len(bucket))
        two = start[size == 2]
        a, b = fp[two], fp[two + 1]
        hit = (a != b) & (np.bitwise_count(a ^ b) <= RADIUS)
        found = [np.stack([a[hit], b[hit]], 1)]
        for at, n in zip(start[size > 2], size[size > 2], strict=True):
            if n <= most:
                found.append(np.array(forest(np.unique(fp[at : at + n])), np.uint64).reshape(-1, 2))
        return found

    def table(found: list[np.ndarray], alone: list[np.ndarray]) -> pd.DataFrame:
        pairs = np.concatenate(found or [np.empty((0, 2), np.uint64)]).view(np.int64)
        one = np.concatenate(alone or [np.empty(0, np.uint64)]).view(np.int64)
        a, b = np.concatenate([pairs[:, 0], one]), pd.array(np.concatenate([pairs[:, 1], one]), "Int64")
        b[len(pairs) :] = pd.NA
        return pd.DataFrame({"a": a, "b": b}).drop_duplicates()

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bucket, fp = np.empty(0, np.int64), np.empty(0, np.uint64)
        wide = None  # a crowded bucket whose rows still come
        for batch in batches:
            bucket = np.concatenate([bucket, batch["bucket"].to_numpy(np.int64)])
            fp = np.concatenate([fp, batch["fp"].to_numpy(np.int64).view(np.uint64)])
            alone = []
            if wide is not None:
                more = int(np.searchsorted(bucket, wide, "right"))
                alone.append(fp[:more])
                bucket, fp = bucket[more:], fp[more:]
            if not len(bucket):
                yield table([], alone)
                continue
            last = int(np.searchsorted(bucket, bucket[-1]))
            found = links(bucket[:last], fp[:last])
            start = np.flatnonzero(np.diff(bucket[:last], prepend=~bucket[:1]))
            alone += [fp[at : at + n] for at, n in zip(start, np.diff(start, append=last), strict=True) if n > most]
            bucket, fp, wide = bucket[last:], fp[last:], None
            if len(bucket) > most:
                alone.append(fp)
                bucket, fp, wide = bucket[:0], fp[:0], bucket[0]
            yield table(found, alone)
        yield table(links(bucket, fp), [])

    return run


def ball_hubs(fps: DataFrame) -> DataFrame:
    """Links among ``fps`` (fp) by whole balls on 64 bits: an edge from each member to a hub's smallest member."""
    one = F.lit(1).cast("long")
    bits = F.sequence(F.lit(0), F.lit(63))
    fp = F.col("fp")
    flip = lambda i: F.call_function("shiftleft", one, i)
    near = F.concat(F.array(fp), F.transform(bits, lambda i: fp.bitwiseXOR(flip(i))))
    shell = F.flatten(
        F.transform(
            F.sequence(F.lit(1), F.lit(63)),
            lambda i: F.transform(F.sequence(F.lit(0), i - 1), lambda j: fp.bitwiseXOR(flip(i)).bitwiseXOR(flip(j))),
        )
    )
    inner = fps.select(F.explode(near).alias("v"), "fp", F.lit(0).alias("wide"))
    outer = fps.where(F.bit_count("fp") % 2 == 0).select(F.explode(shell).alias("v"), "fp", F.lit(1).alias("wide"))
    reach = inner.unionByName(outer)
    odd = (F.bit_count("fp") % 2 == 1) & (F.col("wide") == 0)
    hubs = reach.groupBy("v").agg(
        F.min(F.when(F.col("wide") == 0, fp)).alias("inner_min"),
        F.min(F.when(odd, fp)).alias("odd_min"),
        F.count(F.lit(1)).alias("n"),
    ).where("n > 1")
    met = reach.join(hubs, "v")
    by_inner = met.where("wide = 0 and fp <> inner_min").select(F.col("inner_min").alias("a"), F.col("fp").alias("b"))
    by_odd = met.where("odd_min is not null and bit_count(fp) % 2 = 0").select(F.col("odd_min").alias("a"), F.col("fp").alias("b"))
    return by_inner.unionByName(by_odd)


def fingerprint_links(fps: DataFrame, scratch: Scratch, bucket: int = BUCKET) -> DataFrame:
    """Edges (a, b) that connect distinct fingerprints as all links within ``RADIUS`` do. Variants are shuffled once."""
    parts = max(8, -(-fps.count() // FPS_OF_TASK))
    reach = variants(fps.repartition(parts)).repartition(parts, "bucket").sortWithinPartitions("bucket")
    with batches_of(scratch.spark, RUN_ROWS):
        met = scratch.save(reach.mapInPandas(linked_in_runs(bucket), "a long, b long").distinct(), "ball-links")
    links, crowded = met.where("b is not null"), met.where("b is null").select(F.col("a").alias("fp"))
    return links if crowded.isEmpty() else links.unionByName(ball_hubs(crowded)).distinct()


def near_duplicates(spark: SparkSession, docs: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """``doc_id``, ``fingerprint``, ``component_id`` for every row of ``docs`` (doc_id, text)."""
    scratch = Scratch(spark, "simhash")
    with small_batches(spark):
        found = scratch.save(fingerprints(docs), "fingerprints")
    first = scratch.save(found.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    links = scratch.save(fingerprint_links(first.select("fp"), scratch, bucket), "links")
    labels = components(links, scratch).withColumnRenamed("node", "fp")
    classed = first.join(labels, "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    smallest = classed.groupBy("label").agg(F.min("first").alias("component_id"))
    component = scratch.save(looked_up(classed, "label", "fp", smallest).select("fp", "component_id"), "components")
    out = looked_up(found, "fp", "doc_id", component)
    return scratch.finish(out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"))


def shingle_hashes(text: str | None, words: int = STAGE_WORDS) -> np.ndarray:
    """Hashes of the distinct shingles, sorted; a text of fewer words is one shingle, one without words has none."""
    import xxhash

    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.empty(0, np.uint64)
    grams = zip(*[found[i:] for i in range(words)], strict=False) if len(found) >= words else [found]
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(b" ".join(g), seed=42) for g in grams), np.uint64))


def minima(hashes: np.ndarray) -> np.ndarray:
    """The least of the shingles' hashes under each of ``BANDS * MINIMA`` mixings."""
    rng = np.random.default_rng(17)
    flip, odd = rng.integers(0, 1 << 63, (2, BANDS * MINIMA), np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    low = np.full(BANDS * MINIMA, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 2048):
        mixed = (hashes[at : at + 2048, None] ^ flip) * odd
        low = np.minimum(low, (mixed ^ (mixed >> np.uint64(32))).min(axis=0))
    return low


def sketches(rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """``doc_id``, ``key``, ``node`` (a hash of the shingle set), ``fp``, ``bands`` and ``sketch`` (8 bits of each minimum) of every row."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        for batch in batches:
            out = []
            for text in batch["text"]:
                sets = shingle_hashes(text)
                ones = np.unpackbits(sets.byteswap().view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
                fp = np.packbits(2 * ones > len(sets)).view(">u8")[0]
                low = minima(sets)
                raw = [xxhash.xxh64_intdigest(row.tobytes(), seed=k) for k, row in enumerate(low.reshape(BANDS, MINIMA))]
                ids = np.array([xxhash.xxh64_intdigest(sets.tobytes(), seed=7), fp, *raw], np.uint64).view(np.int64).tolist()
                out.append((ids[0], ids[1], ids[2:], (low & np.uint64(0xFF)).astype(np.uint8).tobytes()))
            yield pd.concat([batch[["doc_id", *key]].reset_index(drop=True), pd.DataFrame(out, columns=["node", "fp", "bands", "sketch"])], axis=1)

    kept = "".join(f", `{k}` long" for k in key)
    return rows.select(F.col("doc_id").cast("long"), *key, "text").mapInPandas(run, f"doc_id long{kept}, node long, fp long, bands array<long>, sketch binary")


def shingle_sets(texts: DataFrame) -> DataFrame:
    """``node``, ``shingles`` of (node, text)."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"node": batch["node"], "shingles": [shingle_hashes(t).view(np.int64) for t in batch["text"]]})

    return texts.select("node", "text").mapInPandas(run, "node long, shingles array<long>")


def with_both(pairs: DataFrame, found: DataFrame, column: str) -> DataFrame:
    """Pairs (a, b) of nodes with a column of ``found`` (node, ...) for both."""
    one = looked_up(pairs, "a", "b", found.select(F.col("node").alias("a"), F.col(column).alias("of_a")))
    return looked_up(one, "b", "a", found.select(F.col("node").alias("b"), F.col(column).alias("of_b")))


def nearest_by_sketch(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """For each ``a`` of the pairs (a, b) those ``NEAREST`` b that agree with it in most minima, if that is a share ``NEAR`` of them. (An ``a`` has few pairs.)"""

    @F.pandas_udf("double")
    def share(a: pd.Series, b: pd.Series) -> pd.Series:
        x, y = (np.frombuffer(b"".join(s), np.uint8).reshape(len(s), -1) for s in (a, b))
        return pd.Series((x == y).mean(axis=1))

    found = with_both(pairs, nodes, "sketch").select("a", "b", share("of_a", "of_b").alias("share")).where(F.col("share") >= NEAR)
    best = F.slice(F.sort_array(F.collect_list(F.struct("share", "b")), asc=False), 1, NEAREST)
    return found.groupBy("a").agg(best.alias("best")).select("a", F.explode("best.b").alias("b"))


def alike(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) of nodes whose shingle sets share ``FIFTHS`` fifths of their union or more."""
    both = F.size(F.array_intersect("of_a", "of_b"))
    found = with_both(pairs, sets, "shingles").where(5 * both >= FIFTHS * (F.size("of_a") + F.size("of_b") - both))
    return found.select("a", "b")


def in_blocks(members: DataFrame, found: DataFrame, payload: str) -> DataFrame:
    """Pairs of blocks of each bucket of ``members`` (bucket, band, node, label): ``bucket``, ``band``, ``one``, ``other``.

    Both are lists of (node, label, ``payload`` of ``found``) of at most about ``BLOCK``; ``other`` is empty where a block meets
    itself. Every two nodes of different classes meet. In a bucket of several blocks those of the largest class have blocks of
    their own, which meet the blocks of the rest only. The payload joins last, as a node is in few buckets and its blocks.
    """
    classes = members.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("many"))
    sizes = classes.groupBy("bucket").agg(F.count(F.lit(1)).alias("classes"), F.sum("many").alias("all"), F.max(F.struct("many", "label")).alias("most"))
    sizes = sizes.where("classes > 1").select("bucket", "all", F.col("most.label").alias("largest"), (F.col("all") - F.col("most.many")).alias("rest"))
    cut = looked_up(members, "bucket", "node", sizes).where("all is not null")
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    whole, large = F.col("all") <= BLOCK, F.col("label") == F.col("largest")
    of_rest, of_all = blocks(F.col("rest")), blocks(F.col("rest")) + blocks(F.col("all") - F.col("rest"))
    draw = F.xxhash64("node", "bucket")
    own = F.when(whole, 0).when(large, of_rest + F.pmod(draw, of_all - of_rest).cast("int")).otherwise(F.pmod(draw, of_rest).cast("int"))
    last = F.when(whole, 0).when(large, of_rest - 1).otherwise(of_all - 1)
    cut = cut.withColumn("own", own).withColumn("with", F.explode(F.sequence(F.lit(0), last))).select("bucket", "band", "node", "label", "own", "with")
    cut = cut.join(found.select("node", payload), "node")
    row = F.struct("node", "label", payload)
    cut = cut.groupBy("bucket", "band", F.least("own", "with").alias("low"), F.greatest("own", "with").alias("high"))
    lists = cut.agg(F.collect_list(F.when(F.col("own") <= F.col("with"), row)).alias("one"), F.collect_list(F.when(F.col("own") > F.col("with"), row)).alias("other"))
    return lists.where("low = high or (size(one) > 0 and size(other) > 0)").select("bucket", "band", "one", "other")


def apart(one: list, other: list) -> tuple[list, np.ndarray]:
    """Members of a pair of blocks, and which pairs of them are in two classes and meet here."""
    rows = [*one, *other]
    label = np.array([r["label"] for r in rows], np.int64)
    ask = label[:, None] != label[None]
    if len(other):
        ask[: len(one), : len(one)] = ask[len(one) :, len(one) :] = False
    return rows, ask


def with_near(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Members of a bucket that agree in a share ``NEAR`` of minima with one of another class, in no earlier band as a whole."""
    for batch in batches:
        out = []
        for bucket, band, one, other in zip(batch["bucket"], batch["band"], batch["one"], batch["other"], strict=True):
            rows, ask = apart(list(one), list(other))
            sketch = np.frombuffer(b"".join(r["sketch"] for r in rows), np.uint8).reshape(len(rows), -1)
            near = np.zeros(len(rows), bool)
            for i in range(len(rows)):
                at = np.flatnonzero(ask[i])
                same = sketch[at] == sketch[i]
                close = np.flatnonzero(same.sum(axis=1) >= NEAR * same.shape[1])
                if len(close) and band:  # who meets in an earlier band is compared there
                    close = close[~same[close, : MINIMA * band].reshape(len(close), band, MINIMA).all(axis=2).any(axis=1)]
                near[at[close]] = True
                near[i] |= len(close) > 0
            out += [(bucket, band, rows[i]["node"], rows[i]["label"]) for i in np.flatnonzero(near)]
        yield pd.DataFrame(out, columns=["bucket", "band", "node", "label"], dtype="int64")


def linked_by_sets(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A forest of the links between classes within pairs of blocks, by the exact shares of their shingle sets."""
    for batch in batches:
        edges: list[tuple[int, int]] = []
        for one, other in zip(batch["one"], batch["other"], strict=True):
            rows, ask = apart(list(one), list(other))
            size = np.array([len(r["shingles"]) for r in rows])
            at = np.repeat(np.arange(len(rows)), size)
            _, column, many = np.unique(np.concatenate([r["shingles"] for r in rows]), return_inverse=True, return_counts=True)
            some = many[column] > 1  # shingles of one row alone are in no intersection
            at, column = at[some], np.unique(column[some], return_inverse=True)[1]
            both = np.zeros((len(rows), len(rows)), np.float32)
            for low in range(0, int(column.max(initial=-1)) + 1, 4096):
                here = (column >= low) & (column < low + 4096)
                held = np.zeros((len(rows), 4096), np.float32)
                held[at[here], column[here] - low] = 1
                both += held @ held.T
            hit = ask & (5 * both >= FIFTHS * (size[:, None] + size[None] - both))
            root = np.unique([r["label"] for r in rows], return_inverse=True)[1]
            for i in np.flatnonzero(hit.any(axis=1)):
                near = np.flatnonzero(hit[i])
                for r in np.unique(root[near]):
                    if r != root[i]:
                        edges.append((rows[i]["node"], rows[near[root[near] == r][0]]["node"]))
                        root[root == r] = root[i]
        yield pd.DataFrame(edges, columns=["a", "b"], dtype="int64")


def if_small(keys: DataFrame) -> DataFrame:
    """``keys`` with a hint to broadcast, where it is known to have few rows."""
    return F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys


def alike_links(rows: DataFrame, key: Sequence[str], nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """``node``, ``label`` of the nodes (node, fp, bands, sketch, first) that links of shared shingles connect."""

    def sets_of(asked: DataFrame, name: str) -> DataFrame:
        asked = scratch.save(asked.join(nodes, "node").select("node", *[F.col("first")[k].alias(k) for k in key]), f"{name}-asked")
        texts = rows.select(*key, "text").join(if_small(asked), key).select("node", "text")
        return scratch.save(shingle_sets(texts).groupBy("node").agg(F.first("shingles").alias("shingles")), name)  # equal rows share a key

    def ends(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()

    # within balls of fingerprints: nodes of one fingerprint with its first, and those that stand for linked ones
    stand = scratch.save(nodes.groupBy("fp").agg(F.min("node").alias("stand")), "stand")
    of_fp = looked_up(nodes.select("fp", "node"), "fp", "node", stand).where("node <> stand").select(F.col("node").alias("a"), F.col("stand").alias("b"))
    balls = fingerprint_links(stand.select("fp"), scratch)
    for c in ("a", "b"):
        balls = balls.join(stand.select(F.col("fp").alias(c), F.col("stand").alias(f"node_{c}")), c)
    balls = balls.select(F.col("node_b").alias("a"), F.col("node_a").alias("b"))
    # in bands: each node with two drawn ones of its bucket
    reach = nodes.select("node", F.posexplode("bands").alias("band", "bucket"))
    drawn = [F.min_by("node", F.xxhash64("node", "bucket", F.lit(turn))).alias(f"drawn_{turn}") for turn in range(2)]
    sizes = scratch.save(reach.groupBy("bucket").agg(F.count(F.lit(1)).alias("many"), *drawn).where("many > 1"), "sizes-of-bands")
    met = scratch.save(looked_up(reach, "bucket", "node", sizes).where("many > 1"), "met")
    stars = met.select("node", "drawn_0", "drawn_1")
    stars = stars.select(F.col("node").alias("a"), F.explode(F.array("drawn_0", "drawn_1")).alias("b")).where("a <> b")
    # each node is held to its nearest ones of these; what else is alike comes to light below
    pairs = scratch.save(of_fp.unionByName(balls).unionByName(stars).distinct(), "pairs")
    pairs = scratch.save(nearest_by_sketch(pairs, nodes), "near-pairs")
    links = scratch.save(alike(pairs, sets_of(ends(pairs), "sets")), "links")
    label = scratch.save(components(links, scratch, "star-labels"), "star-label")
    # buckets that are still apart, whole: every two nodes of different classes
    seen = looked_up(met.select("bucket", "node", "band"), "node", "bucket", label).withColumn("label", F.coalesce("label", "node"))
    seen = scratch.save(seen.select("bucket", "band", "node", "label"), "members")
    near = in_blocks(seen, nodes, "sketch").mapInPandas(with_near, "bucket long, band long, node long, label long")
    near = scratch.save(near.distinct(), "near")
    sets = sets_of(near.select("node").distinct(), "rest-sets")
    rest = in_blocks(near, sets, "shingles").select("one", "other").mapInPandas(linked_by_sets, "a long, b long")
    rest = scratch.save(rest.distinct(), "rest-links")
    return components(links.unionByName(rest), scratch, "all-labels")


def keep_first(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """One row of each class: that with the smallest doc_id, null last; of rows with one doc_id, that with the smallest row key."""
    scratch = Scratch(spark, "simhash-first")
    rows, key = keyed(docs)
    with small_batches(spark):
        found = scratch.save(sketches(rows, key), "sketches")
    place = F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", *key))
    nodes = scratch.save(found.groupBy("node").agg(place.alias("first"), F.min("fp").alias("fp"), F.min("bands").alias("bands"), F.min("sketch").alias("sketch")), "nodes")
    with small_batches(spark):
        label = scratch.save(alike_links(rows, key, nodes, scratch), "labels")
    classed = nodes.join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    best = looked_up(classed, "label", "node", classed.groupBy("label").agg(F.min("first").alias("best"))).where("first = best")
    # rows that go: those of other nodes or keys, and all but one of rows that are equal throughout
    keys = looked_up(found.select("node", *key), "node", key[0], best.select("node", "first"))
    gone = keys.where(F.col("first").isNull() | F.lit(False).eqNullSafe(F.struct(*key) == F.struct(*[F.col("first")[k].alias(k) for k in key])))
    gone = scratch.save(gone.select(*key).distinct(), "gone")
    again = scratch.save(found.groupBy(*key).count().where("count > 1").select(*key).join(gone, key, "left_anti"), "again")
    scratch.keep("gone", "again")
    left = rows.join(if_small(gone), key, "left_anti")
    once = left.join(if_small(again), key, "left_anti").unionByName(left.join(if_small(again), key, "left_semi").dropDuplicates(key))
    return once.select(docs.columns)


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark, table(spark, sf_dir, "documents"))
