"""Approximate nearest neighbours: an inverted file of coarse centroids with product-quantised residuals.

Centroids and codebooks are fitted on at most ``SAMPLE`` vectors, drawn by hash; every row is indexed. A
vector goes to the list of its nearest centroid, and its residual is coded by the nearest codeword of
each of ``PARTS`` parts. Lists are dealt to shards of ``SHARD`` to ``SHARD_MOST`` rows, lists of more rows to several.
A query asks the lists whose centroids have the largest inner products with it: a share ``PROBE`` of
them, and more until they hold ``k`` candidates beside itself. In each shard with such lists, its
inner products with what their list and codewords say give all candidates asymmetric scores, for a block of queries at once; the best
``RERANK`` are ranked by exact inner products of the original vectors in double precision, and so are all
others that the error of their codes would let into the best ``k``. The best ``k`` of each shard meet in the query's final
ranking. With all lists asked (the setting) nothing near is missed, whatever the rows; the work then grows with queries times rows.
No task holds more than a shard, ``QUERIES`` queries and a block of scores; a query goes to each shard with the lists that it asks there.

Unclustered vectors in 64 dimensions have neighbours in most lists, so all are asked: README.md has
the measured recalls.

Edge cases: vectors that are null, empty, zero, or hold null or non-finite components take no part, nor do
rows with a null vec_id. Vectors of another dimension than most of the sample take no part. Rows
repeated with one vec_id are candidates each; as a query the id's smallest vector is asked once, and
no row of its own id is its candidate. Ties go to the smaller vec_id. Queries without candidates,
and an empty table, give no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, shared, table, thinned
from .covertree import usable

K = 20
EVERY = 20
SAMPLE = 16_384
#: Vectors of the sample to a list at least: lists grow with the square root of the rows up to ``SAMPLE / OF_LIST``, a bound of the driver's tables.
OF_LIST = 16
PARTS, WORDS = 16, 256
#: Rows of a shard; more, up to ``SHARD_MOST``, where there would be over ``SHARDS``, as each takes a copy of the queries.
SHARD, SHARD_MOST, SHARDS = 4_096, 32_768, 32
#: Queries of a group that meets a copy of the shards.
QUERIES = 16_384
#: Scores of a block of queries with a shard, pairs that are scored exactly at once, and routed queries of a batch.
BLOCK, PAIRS, ROUTED = 1 << 20, 8_192, 1_000
PROBE = 1.0
RERANK = 400


def k_means(points: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    """Centroids; empty ones take the points furthest from their own."""
    rng = np.random.default_rng(seed)
    centres = points[rng.choice(len(points), min(k, len(points)), replace=False)].copy()
    for _ in range(rounds):
        near = nearest(points, centres)
        sums = np.stack([np.bincount(near, points[:, d], len(centres)) for d in range(points.shape[1])], 1)
        counts = np.bincount(near, minlength=len(centres))
        empty = np.flatnonzero(counts == 0)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(1, counts)[:, None], centres)
        if len(empty):
            far = np.argsort(-((points - centres[near]) ** 2).sum(1), kind="stable")[: len(empty)]
            centres[empty] = points[far]
    return centres


def nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = 0.5 * (centres * centres).sum(axis=1)
    return np.concatenate([(points[i : i + 4096] @ centres.T - half).argmax(axis=1) for i in range(0, len(points), 4096)]) if len(points) else np.zeros(0, np.int64)


@dataclass
class Quantiser:
    centres: np.ndarray  # (lists, dimension)
    cuts: np.ndarray  # ends of the parts
    books: list[np.ndarray]  # of each part: (words, its dimensions)

    @classmethod
    def fit(cls, sample: np.ndarray, lists: int) -> Quantiser:
        centres = k_means(sample, lists, 12, 1)
        rest = sample - centres[nearest(sample, centres)]
        cuts = np.linspace(0, sample.shape[1], min(PARTS, sample.shape[1]) + 1).astype(int)
        return cls(centres, cuts, [k_means(rest[:, a:b], WORDS, 8, 2) for a, b in zip(cuts[:-1], cuts[1:], strict=True)])

    def encode(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """List and codes of each vector."""
        own = nearest(vectors, self.centres)
        rest = vectors - self.centres[own]
        codes = [nearest(rest[:, a:b], book) for a, b, book in zip(self.cuts[:-1], self.cuts[1:], self.books, strict=True)]
        return own, np.stack(codes, 1).astype(np.uint8)

    def decode(self, lists: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """What list and codes, (parts, vectors), say of each vector."""
        return self.centres[lists] + np.concatenate([book[c] for book, c in zip(self.books, codes, strict=True)], axis=1)


def search_shard(q: Quantiser, index: pd.DataFrame, asked: pd.DataFrame, k: int, rerank: int) -> pd.DataFrame:
    """The best ``k`` of a shard's rows for each query, among the lists that it asks."""
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    if len(index) and len(asked):
        index = index.sort_values(["list", "vec_id"], kind="stable")
        lists, ids = index["list"].to_numpy(), index["vec_id"].to_numpy()
        vectors = np.stack(list(index["v"])).astype(np.float64)
        coded = q.decode(lists, np.frombuffer(b"".join(index["codes"]), np.uint8).reshape(len(index), -1).T)
        # how far each vector is from what its list and codes say: a score is off by at most that times the query's length
        long = np.linalg.norm(vectors, axis=1)
        off = np.linalg.norm(vectors - coded, axis=1) * (1 + 1e-9) + 1e-12 * (1 + long)
        held, place = np.unique(lists, return_inverse=True)
        queries, asks = asked["query_id"].to_numpy(), list(asked["v"])
        step = max(1, BLOCK // len(ids))
        for i in range(0, len(asked), step):
            own, v = queries[i : i + step], np.stack(asks[i : i + step]).astype(np.float64)
            among = ids != own[:, None]
            hit = np.stack([np.isin(held, probes) for probes in asked["probes"].iloc[i : i + step]])
            if not hit.all():
                among &= hit[:, place]
            length = np.linalg.norm(v, axis=1)[:, None]
            if len(ids) > rerank:
                rough = np.where(among, v @ coded.T, -np.inf)
                first_ones = np.argpartition(rough, len(ids) - rerank, axis=1)[:, len(ids) - rerank :]
                exact = np.stack([vectors[rows] @ x for rows, x in zip(first_ones, v, strict=True)])
                exact[~np.take_along_axis(among, first_ones, 1)] = -np.inf
                at_k = np.sort(exact, axis=1)[:, -min(k, rerank), None]
                at_k -= 1e-9 * np.where(np.isfinite(at_k), abs(at_k), 0) + 1e-12 * length * long.max()
                among &= rough + length * off >= at_k
            else:
                at_k = np.full((len(v), 1), -np.inf)
            some = np.flatnonzero(among.any(axis=0))  # rows that some query of the block needs exactly
            which, row = np.nonzero(among[:, some] & (v @ (vectors[some] if len(some) < len(ids) else vectors).T >= at_k))
            row = some[row]
            # of equal vectors equal, wherever they stand; there may be as many as the block has scores
            score = np.concatenate([(vectors[row[j : j + PAIRS]] * v[which[j : j + PAIRS]]).sum(axis=1) for j in range(0, max(1, len(row)), PAIRS)])
            order = np.lexsort((ids[row], -score, which))
            which, row, score = which[order], row[order], score[order]
            best = np.arange(len(which)) - np.searchsorted(which, which) < k
            out.append((own[which[best]], ids[row[best]], score[best]))
    return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), map(np.concatenate, zip(*out, strict=True)), strict=True)))


def routed(batches: Iterable[pd.DataFrame], q: Quantiser, counts: np.ndarray, base: np.ndarray, split: np.ndarray, k: int, probe: float) -> Iterator[pd.DataFrame]:
    """A row for each query and shard with lists that it asks, with these lists: list ``p`` lies in ``split[p]`` shards from ``base[p]`` on."""
    out, names = [], ["query_id", "v", "probes", "shard"]
    for batch in batches:
        for query_id, v, own in zip(batch["vec_id"], batch["v"], batch["own"], strict=True):
            by = np.argsort(-(q.centres @ np.asarray(v)), kind="stable")
            by = by[counts[by] > 0]
            # the query's own rows may be among the candidates that the lists hold
            enough = int(np.searchsorted(np.cumsum(counts[by]), k + own)) + 1
            shards: dict[int, list[int]] = {}
            for p in by[: max(int(np.ceil(probe * len(by))), enough)].tolist():
                for s in range(int(base[p]), int(base[p] + split[p])):
                    shards.setdefault(s, []).append(p)
            for s, there in shards.items():
                out.append((query_id, v, np.array(there, np.int32), s))
                if len(out) >= ROUTED:
                    yield pd.DataFrame(out, columns=names)
                    out = []
    if out:
        yield pd.DataFrame(out, columns=names)


def search(spark: SparkSession, rows: DataFrame, k: int = K, every: int = EVERY, probe: float = PROBE, rerank: int = RERANK, shard: int = SHARD) -> DataFrame:
    """``query_id, rank, vec_id, score``: queries are the rows of ``rows`` (vec_id, embedding) whose id divides by ``every``."""
    scratch = Scratch(spark, "ivfpq")
    valid = rows.select(F.col("vec_id").cast("long"), usable(F.col("embedding")).alias("v")).where("vec_id is not null and v is not null")
    drawn = thinned(valid, SAMPLE + SAMPLE // 16, "vec_id").orderBy(F.xxhash64("vec_id", F.lit("sample")), "vec_id").limit(SAMPLE).select("v").toPandas()["v"]
    empty = "query_id long, rank int, vec_id long, score double"
    if drawn.empty:
        return spark.createDataFrame([], empty)
    sizes = drawn.map(len)
    dimension = int(sizes.mode().iloc[0])
    sample = np.stack(list(drawn[sizes == dimension]))
    valid = valid.where(F.size("v") == dimension)
    rows_in = valid.count()
    quantiser = Quantiser.fit(sample, max(1, min(int(np.sqrt(rows_in)), len(sample) // OF_LIST)))
    fitted = shared(spark, quantiser)  # lists * dimension + WORDS * dimension numbers

    def code(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        q = fitted()
        for batch in batches:
            if len(batch):
                own, codes = q.encode(np.stack(list(batch["v"])))
                yield batch.assign(list=own.astype(np.int32), codes=[c.tobytes() for c in codes])

    index = scratch.save(valid.mapInPandas(code, "vec_id long, v array<double>, list int, codes binary"), "index")
    counts = np.zeros(len(quantiser.centres), np.int64)
    for r in index.groupBy("list").count().collect():  # a row for each list
        counts[r["list"]] = r["count"]
    shard = max(shard, min(SHARD_MOST, rows_in // SHARDS))
    base, split = (np.cumsum(counts) - counts) // shard, -(-counts // shard)
    base_of, split_of = (F.array(*[F.lit(int(x)) for x in xs]) for xs in (base, np.maximum(1, split)))
    part = F.pmod(F.xxhash64("vec_id", F.lit("part")), F.get(split_of, F.col("list")))
    queries = index.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"), F.count(F.lit(1)).alias("own"))
    asks = max(1, -(-queries.count() // QUERIES))  # groups of queries, each of which meets a copy of a shard

    def route(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return routed(batches, fitted(), counts, base, split, k, probe)

    asked = queries.mapInPandas(route, "query_id long, v array<double>, probes array<int>, shard long")
    asked = asked.withColumn("ask", F.pmod(F.xxhash64("query_id"), F.lit(asks)))
    dealt = index.withColumn("shard", (F.get(base_of, F.col("list")) + part).cast("long"))
    dealt = dealt.withColumn("ask", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(asks - 1).cast("long"))))

    def meet(key: tuple, own: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        return search_shard(fitted(), own, asked, k, rerank)

    met = dealt.groupBy("shard", "ask").cogroup(asked.groupBy("shard", "ask")).applyInPandas(meet, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    found = scratch.save(met, "found").withColumn("rank", rank)
    return scratch.finish(found.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"))


def op10_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark, table(spark, sf_dir, "embeddings"))
