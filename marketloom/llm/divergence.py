"""Source divergence audit: how far the word shares of each source lie from those of every other source of its language.

Terms are runs of ASCII letters and of all other characters above ASCII, A-Z in lower case. A language keeps the terms
of at least ``LEAST`` of its documents. Shares are whole billionths, smoothed by one count a term, and all sums exact.

Tasks count terms before the shuffle, Spark adds the counts. The sum over all kept terms of a pair of sources then
splits by how many sources have a term. A *heavy* term, which many have, goes as a row of counts to a dense tile of
its language, where numpy takes all pairs of sources at once. All other terms are *light*: there a pair gets what it has
if neither source has the term, plus a correction of each source alone (which depends on the count only, so that counts
are corrected together), plus a correction for each light term that both have, from its short posting list. The partial
sums of tiles, counts and postings add up to the whole.

Defined results: null text, language and source are read as empty; a group without terms, or a language without kept
terms, has its pairs of value 0; further columns, of whatever name, play no part; an empty table gives no rows. Languages
may have any number of sources: tiles take pairs of blocks of ``BLOCK`` sources, postings of more than ``LIGHT`` are heavy.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, small_batches, table

#: Documents of a language that a kept term is in, terms listed of a group, and what shares are counted in.
LEAST, RANKS, UNIT = 3, 200, 1_000_000_000
#: Sources of a block, heavy terms of a tile, longest posting list of a light term, light postings of a chunk.
BLOCK, TILE, LIGHT, CHUNK = 256, 1024, 512, 200_000
#: Entries of a task's table of counts.
HELD = 500_000

#: A-Z to a-z, letters and bytes of longer characters as they are, all else to spaces.
BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
COUNTS = "lang string, source string, term string, n long, docs long"


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of terms, and of the documents that have them, of what this task has read."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    size = 0

    def out() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in held.items():
            terms = pa.array([t.decode() for t in n], pa.string())
            same = [pa.array([v], pa.string()).take(pa.array(np.zeros(len(n), np.int32))) for v in (lang, source)]
            numbers = [pa.array(list(n.values()), pa.int64()), pa.array([docs[t] for t in n], pa.int64())]
            if len(n):
                yield pa.RecordBatch.from_arrays([*same, terms, *numbers], ["lang", "source", "term", "n", "docs"])
        held.clear()

    for batch in batches:
        for lang, source, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            found = text.encode().translate(BYTES).split()
            n, docs = held.setdefault((lang, source), (Counter(), Counter()))
            size -= len(n)
            n.update(found)
            docs.update(set(found))
            size += len(n)
            if size > HELD:
                yield from out()
                size = 0
    yield from out()


def share(count: str, whole: str) -> F.Column:
    """``1 + floor(UNIT * (count + 1) / whole)``, in decimals: counts of large corpora pass 2^63 on the way."""
    return (F.lit(1) + F.expr(f"({UNIT}BD * cast({count} + 1 AS decimal(20, 0))) div cast({whole} AS decimal(20, 0))")).cast("long")


def f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


PARTIAL = "lang string, g int, h int, value decimal(38,0)"


def pairs(lang: str, g: np.ndarray, h: np.ndarray, value: list[int]) -> pa.Table:
    return pa.table({"lang": pa.array([lang] * len(g), pa.string()), "g": pa.array(g.astype(np.int32)), "h": pa.array(h.astype(np.int32)), "value": pa.array(value, pa.int64()).cast(pa.decimal128(38, 0))})


def tile_sums(block: int):
    def sums(rows: pa.Table, groups: pa.Table) -> pa.Table:
        """One tile for one pair of blocks of sources, from ``(term, g, p, n)``: sums of all pairs across the blocks.

        A tile of heavy terms has a row for each of ``terms`` in it. Tile -1 has light counts: there ``term`` is the count, ``n`` the number of light terms
        of ``g`` with it; then only ``g`` departs from its share of nothing, and ``terms`` is the number of all light ones.
        """
        lang, tile, low, high = (groups[c][0].as_py() for c in ("lang", "tile", "low", "high"))
        ids, none, terms = (groups[c].to_numpy() for c in ("g", "none", "terms"))
        order = np.argsort(ids)
        ids, none, terms = ids[order], none[order], terms[order]
        g, p, n = (rows[c].to_numpy() for c in ("g", "p", "n"))
        at = np.searchsorted(ids, g)
        left = np.flatnonzero(ids // block == low)
        right = np.flatnonzero(ids // block == high)
        base = f(none[:, None], none[None, :])
        if tile < 0:
            total = terms[0] * base
            for k in range(len(at)):
                j = at[k]
                total[j] += n[k] * (f(p[k], none) - base[j])
                total[:, j] += n[k] * (f(none, p[k]) - base[:, j])
        else:
            _, term = np.unique(rows["term"].to_numpy(), return_inverse=True)
            dense = np.tile(none, (term.max(initial=-1) + 1, 1))
            dense[term, at] = p
            total = (terms[0] - len(dense)) * base  # terms of this tile that none of these sources has
            for j in range(len(ids)):
                total[j] += f(dense[:, j : j + 1], dense).sum(axis=0)
        out = [(a, b) for a, b in ((left, right), (right, left))][: 1 if low == high else 2]
        a, b = (np.concatenate([np.repeat(x, len(y)) if k == 0 else np.tile(y, len(x)) for x, y in out]) for k in range(2))
        a, b = a[a != b], b[a != b]
        return pairs(lang, ids[a], ids[b], total[a, b].tolist())

    return sums


def posting_sums(rows: pa.Table) -> pa.Table:
    """A chunk of light terms: for each pair of sources that both have a term, what ``f`` departs from the corrections of each alone."""
    lang = rows["lang"][0].as_py()
    term, g, p, none = (rows[c].to_numpy() for c in ("term", "g", "p", "none"))
    order = np.lexsort((g, term))
    term, g, p, none = term[order], g[order], p[order], none[order]
    opens = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]]))
    sizes = np.diff(np.append(opens, len(term)))
    ids, sums = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for size in np.unique(sizes[sizes > 1]):
        lists = opens[sizes == size][:, None] + np.arange(size)
        for part in np.array_split(lists, -(-lists.size // 50_000)):
            for shift in range(1, size):
                a, b = part.ravel(), np.roll(part, -shift, axis=1).ravel()
                value = f(p[a], p[b]) - f(p[a], none[b]) - f(none[a], p[b]) + f(none[a], none[b])
                key, place = np.unique(np.concatenate([ids, g[a].astype(np.int64) << 32 | g[b]]), return_inverse=True)
                added = np.zeros(len(key), np.int64)
                np.add.at(added, place, np.concatenate([sums, value]))
                ids, sums = key, added
    return pairs(lang, ids >> 32, ids & 0xFFFFFFFF, sums.tolist())


def audit(docs: DataFrame, scratch: Scratch, ranks: int = RANKS, light: int = LIGHT, block: int = BLOCK, tile: int = TILE, chunk: int = CHUNK) -> DataFrame:
    """``(lang, source, part, item, value, rank)``: every other source by divergence, and the terms that a source has most in excess of its language."""
    docs = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    key = ["lang", "source"]
    with small_batches(docs.sparkSession):
        # groups without terms come along as rows without a term
        there = docs.select(*key).distinct().select(*key, F.lit(None).cast("string").alias("term"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("docs"))
        found = docs.mapInArrow(counted, COUNTS).unionByName(there)
        counts = scratch.save(found.groupBy(*key, "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "counts")
    terms = counts.where("term IS NOT NULL").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n"), F.count(F.lit(1)).alias("groups"))
    terms = scratch.save(terms.where(F.col("docs") >= LEAST).drop("docs"), "terms")
    langs = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("lang_n").alias("lang_whole"))  # one row a language
    kept = scratch.save(counts.join(terms.select("lang", "term", "lang_n", "groups"), ["lang", "term"]).drop("docs"), "kept")
    sizes = kept.groupBy(*key).agg(F.sum("n").alias("whole"))
    numbers = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    groups = counts.select(*key).distinct().select(*key, numbers.alias("g")).join(sizes, key, "left").join(langs, "lang", "left").na.fill(0, ["whole", "v", "lang_whole"])
    groups = groups.withColumn("none", F.when(F.col("v") > 0, share("0L", "whole + v")).otherwise(1))
    groups = scratch.save(groups.withColumn("of", F.count(F.lit(1)).over(Window.partitionBy("lang"))), "groups")
    shares = kept.join(groups, key).withColumn("p", share("n", "whole + v"))
    # numpy takes all pairs of a heavy term at about the cost of a third as many from postings
    heavy = (F.col("groups") * 3 >= F.col("of")) | (F.col("groups") > light)
    shares = scratch.save(shares.select(*key, "term", "n", "g", "p", "none", "of", "lang_n", "lang_whole", "v", heavy.alias("heavy"), F.xxhash64("term").alias("hash")), "shares")

    listed = shares.withColumn("q", share("lang_n", "lang_whole + v")).where("p > q")
    listed = listed.select(*key, F.lit("term").alias("part"), F.col("term").alias("item"), F.expr("(p - q) * (p - q) div q").alias("value"))
    by_value = Window.partitionBy(*key).orderBy(F.col("value").desc(), F.col("item").asc())
    listed = listed.withColumn("rank", F.row_number().over(by_value)).where(F.col("rank") <= ranks)

    stats = shares.groupBy("lang").agg(F.sum(F.when(F.col("heavy"), 1).otherwise(0)).alias("heavy_rows"), F.sum(F.when(F.col("heavy"), 0).otherwise(1)).alias("light_rows"))
    groups = groups.join(stats, "lang", "left").na.fill(0, ["heavy_rows", "light_rows"])
    # tiles of about TILE terms that all sources have; -1 for the light counts
    tiles = F.ceil(F.col("heavy_rows") / F.col("of") / F.lit(tile)).cast("int")
    meta = scratch.save(groups.select("lang", "source", "g", "none", "light_rows", "of", tiles.alias("tiles")), "meta")
    of_lang = meta.groupBy("lang").agg(F.max("tiles").alias("tiles"), F.max("light_rows").alias("light_rows"), F.max("of").alias("of"))
    of_lang = F.broadcast(of_lang) if of_lang.count() < 10_000 else of_lang
    tile_of = F.when(F.col("heavy"), F.pmod(F.xxhash64("term"), "tiles").cast("int")).otherwise(-1).alias("tile")
    of_tile = terms.join(of_lang, "lang").withColumn("heavy", heavy).groupBy("lang", tile_of).agg(F.count(F.lit(1)).alias("terms"))
    last = F.floor((F.col("of") - 1) / block).cast("int")
    mine = F.floor(F.col("g") / block).cast("int")
    meets = lambda df: df.withColumn("other", F.explode(F.sequence(F.lit(0), last))).select("*", F.least(mine, "other").alias("low"), F.greatest(mine, "other").alias("high"))
    rows = shares.join(of_lang.drop("of"), "lang")
    dense = rows.where("heavy").select("lang", tile_of, "term", "g", "p", F.lit(1).cast("long").alias("n"), "of")
    single = rows.where("NOT heavy").groupBy("lang", "g", "n", "p", "of").agg(F.count(F.lit(1)).alias("many"))
    single = single.select("lang", F.lit(-1).alias("tile"), F.lit("").alias("term"), "g", "p", F.col("many").alias("n"), "of")
    keys = ["lang", "tile", "low", "high"]
    left = meets(dense.unionByName(single)).drop("of", "other")
    right = meta.withColumn("tile", F.explode(F.sequence(F.lit(-1), F.col("tiles") - 1))).join(of_tile, ["lang", "tile"], "left").na.fill(0, ["terms"])
    right = meets(right).select(*keys, "g", "none", "terms")
    tiled = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(tile_sums(block), PARTIAL)
    chunks = F.pmod("hash", F.ceil(F.col("light_rows") / chunk)).cast("int")
    listed_pairs = rows.where("NOT heavy").select("lang", chunks.alias("chunk"), F.col("hash").alias("key"), "term", "g", "p", "none").groupBy("lang", "chunk").applyInArrow(posting_sums, PARTIAL)
    sums = tiled.unionByName(listed_pairs).groupBy("lang", "g", "h").agg(F.sum("value").cast("long").alias("value"))
    names = meta.select("lang", "g", "source")
    named = sums.join(names, ["lang", "g"]).join(names.select("lang", F.col("g").alias("h"), F.col("source").alias("item")), ["lang", "h"])
    named = named.select(*key, F.lit("pair").alias("part"), "item", "value")
    named = named.withColumn("rank", F.row_number().over(by_value))
    return named.unionByName(listed)


def op11_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole ``documents``."""
    scratch = Scratch(spark, "divergence")
    return scratch.finish(audit(table(spark, sf_dir, "documents"), scratch))


OP11_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
w AS (SELECT row, lang, source, unnest(terms) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM w GROUP BY lang, term HAVING count(DISTINCT row) >= 3),
c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*) AS v, sum(n) AS whole FROM kept GROUP BY lang),
s AS (SELECT lang, source, sum(n) AS whole FROM c GROUP BY ALL),
p AS (SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n, CAST(1 + (1000000000 :: HUGEINT * (coalesce(c.n, 0) + 1)) // (coalesce(s.whole, 0) + v.v) AS BIGINT) AS p,
    CAST(1 + (1000000000 :: HUGEINT * (kept.n + 1)) // (v.whole + v.v) AS BIGINT) AS q
  FROM g JOIN kept ON kept.lang = g.lang JOIN v ON v.lang = g.lang LEFT JOIN s ON s.lang = g.lang AND s.source = g.source
  LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
x AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
o AS (
  SELECT g.lang, g.source, 'pair' AS part, h.source AS item, CAST(coalesce(x.value, 0) AS BIGINT) AS value
  FROM g JOIN g h ON g.lang = h.lang AND g.source <> h.source LEFT JOIN x ON x.lang = g.lang AND x.source = g.source AND x.item = h.source
  UNION ALL SELECT lang, source, 'term', term, CAST(((p - q) * (p - q)) // q AS BIGINT) FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM o QUALIFY part = 'pair' OR rank <= 200
"""
