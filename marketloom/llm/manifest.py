"""Merkle dataset manifest: a tree of SHA-256 digests over a corpus, with a proof for each document.

Spark makes the leaves, numbers them within each language by ``doc_id`` (ranges, then a number within each range) and
deals them into aligned buckets of ``ARITY ** LEVELS`` consecutive ones, so that a bucket holds whole subtrees. Each
bucket goes as an Arrow table to a DuckDB in its task, whose ordered ``string_agg`` and ``sha256`` make one level from
the one below. Spark combines the bucket roots, again in buckets, until one root a language is left, and then in the
same way the roots of the languages. On the way down each bucket's outer proof is joined to it, and DuckDB folds its
nodes through their siblings.

Defined results: null fields are ``-``; within a language null ``doc_id`` come first and equal ones by leaf; null
languages come first; a language of one document has its leaf as its root; an empty table gives no rows; further
columns, of whatever name, play no part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, table, worker_wide

#: Children of a node; levels of a bucket of nodes, so 4,096 nodes in it.
ARITY, LEVELS = 8, 4
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

#: One level from the one below: ``n`` numbers the nodes of a level, ``h`` is the digest.
LEVEL = f"""CREATE OR REPLACE TEMP TABLE up AS
SELECT n // {ARITY} AS n, sha256(string_agg(h, '' ORDER BY n)) AS h FROM nodes GROUP BY ALL"""
#: Of each node what stands before it in its run, and after it.
SIDES = f"""CREATE OR REPLACE TEMP TABLE sides AS
SELECT n, coalesce(string_agg(h, '') OVER (run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
       coalesce(string_agg(h, '') OVER (run ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after
FROM nodes WINDOW run AS (PARTITION BY n // {ARITY} ORDER BY n)"""


def connection() -> Any:
    """One DuckDB for each Python worker, of one thread and bounded memory, which writes no files."""

    def make() -> Any:
        import duckdb

        return duckdb.connect(config={"threads": 1, "memory_limit": "600MB", "temp_directory": ""})

    return worker_wide("manifest_duckdb", make)


def levels_of(many: int) -> int:
    """Levels from ``many`` nodes up to one."""
    levels = 0
    while ARITY**levels < many:
        levels += 1
    return levels


def subtree(levels: int):
    def climb(rows: pa.Table) -> pa.Table:
        """The root of one bucket of ``(tree, n, many, h)``, as a node of the next tier."""
        duck = connection()
        tree, bucket, many = (rows[c][0].as_py() for c in ("tree", "bucket", "many"))
        duck.register("given", rows.select(["n", "h"]))
        duck.execute("CREATE OR REPLACE TEMP TABLE nodes AS SELECT n, h FROM given")
        duck.unregister("given")
        for _ in range(min(levels, levels_of(many))):
            duck.execute(LEVEL)
            duck.execute("CREATE OR REPLACE TEMP TABLE nodes AS FROM up")
        root = duck.execute("SELECT h FROM nodes").fetchall()
        assert len(root) == 1
        size = ARITY**levels
        return pa.table({"tree": pa.array([tree], pa.int64()), "n": pa.array([bucket], pa.int64()), "many": pa.array([-(-many // size)], pa.int64()), "h": [root[0][0]]})

    return climb


UP = "tree long, n long, many long, h string"


def bucket_of(levels: int) -> Column:
    return F.floor(F.col("n") / F.lit(ARITY**levels)).cast("long").alias("bucket")


def climbed(nodes: DataFrame, scratch: Scratch, name: str, levels: int) -> list[DataFrame]:
    """Tiers of nodes ``(tree, n, many, h)``: the given ones, their buckets' roots, and so on until each tree has one node.

    ``many`` is the number of nodes of the tree in that tier. A tier is smaller than the one below by the size of a
    bucket, so that a few tiers reach the roots of any corpus.
    """
    tiers = [nodes]
    while True:
        below = tiers[-1].select("*", bucket_of(levels))
        tiers.append(scratch.save(below.groupBy("tree", "bucket").applyInArrow(subtree(levels), UP), f"{name}-{len(tiers)}"))
        if tiers[-1].where("many > 1").isEmpty():
            return tiers


def folding(finish: Callable[[Any, dict], pa.Table], levels: int):
    """For one bucket: the sides of each of its nodes, level by level, as ``path`` of table ``docs``; ``finish`` adds the row of its outer proof."""

    def fold(rows: pa.Table, outer: pa.Table) -> pa.Table:
        duck = connection()
        many = rows["many"][0].as_py()
        duck.register("given", rows)
        duck.execute("CREATE OR REPLACE TEMP TABLE docs AS SELECT *, n AS place, [] :: STRUCT(before VARCHAR, after VARCHAR)[] AS path FROM given")
        duck.execute("CREATE OR REPLACE TEMP TABLE nodes AS SELECT n, h FROM given")
        duck.unregister("given")
        for _ in range(min(levels, levels_of(many))):
            duck.execute(SIDES)
            duck.execute(LEVEL)
            duck.execute(
                f"CREATE OR REPLACE TEMP TABLE docs AS SELECT docs.* REPLACE (place // {ARITY} AS place, list_append(path, {{before: before, after: after}}) AS path)"
                " FROM docs JOIN sides ON sides.n = place"
            )
            duck.execute("CREATE OR REPLACE TEMP TABLE nodes AS FROM up")
        return finish(duck, outer.slice(0, 1).to_pylist()[0] if len(outer) else {})

    return fold


PATH = "array<struct<before:string,after:string>>"
STEPS = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))


def passed(duck: Any, outer: dict) -> pa.Table:
    """Nodes of a tier with their whole paths; they name the buckets of the tier below."""
    found = duck.sql("SELECT tree, n AS bucket, path FROM docs").to_arrow_table()
    paths = [p + outer.get("path", []) for p in found["path"].to_pylist()]
    return pa.table({"tree": found["tree"].cast(pa.int64()), "bucket": found["bucket"].cast(pa.int64()), "path": pa.array(paths, STEPS)})


def descended(tiers: list[DataFrame], outer: DataFrame | None, scratch: Scratch, name: str, levels: int) -> DataFrame:
    """``(tree, bucket, path)`` of all buckets of the lowest tier; ``outer`` has those above the trees' roots, as ``(tree, bucket, path)``."""
    for k in range(len(tiers) - 1, 0, -1):
        nodes = tiers[k].select("*", bucket_of(levels))
        above = outer if outer is not None else tiers[k].sparkSession.createDataFrame([], f"tree long, bucket long, path {PATH}")
        outer = nodes.groupBy("tree", "bucket").cogroup(above.groupBy("tree", "bucket")).applyInArrow(folding(passed, levels), f"tree long, bucket long, path {PATH}")
        outer = scratch.save(outer, f"{name}-outer-{k}")
    return outer


PROVED = "doc_id long, lang string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def proved(duck: Any, outer: dict) -> pa.Table:
    """Documents of a bucket: what their siblings hash to, and the root that the seen leaf folds to."""
    duck.register("above", pa.table({"above": pa.array([outer["path"]], STEPS), "subroot": [outer["subroot"]], "root": [outer["root"]]}))
    proof = "sha256(array_to_string(list_transform(path, lambda s: s.before || s.after), ''))"
    folded = "list_reduce(list_prepend({before: seen, after: ''}, path), lambda a, s: {before: sha256(s.before || a.before || s.after), after: ''}).before"
    out = duck.sql(
        f"SELECT doc_id, lang, h AS leaf, subroot, root, {proof} AS proof_sha256, {folded} AS folded_root, folded_root = root AS verified"
        " FROM (SELECT docs.* REPLACE (list_concat(path, (SELECT above FROM above)) AS path), (SELECT subroot FROM above) AS subroot, (SELECT root FROM above) AS root FROM docs)"
    ).to_arrow_table()
    duck.unregister("above")
    return out


def leaf_of(text: Column) -> Column:
    """Digest of a row, each field as its length in bytes and itself."""
    parts = []
    for name in FIELDS:
        value = text if name == "text" else F.col(name).cast("string")
        parts.append(F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value)))
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def numbered(leaves: DataFrame, scratch: Scratch) -> DataFrame:
    """``leaves`` with ``tree`` (the number of the language), ``n`` (of the leaf in it) and ``many`` (leaves of it), from 0.

    Rows are dealt in ranges of language, ``doc_id`` and leaf and numbered within their range; only the counts of each range and
    language meet. Equal rows are dealt over ranges too: which of them gets which number changes nothing.
    """
    order = [F.col("lang").asc_nulls_first(), F.col("doc_id").asc_nulls_first(), F.col("leaf").asc()]
    ranges = max(8, int(leaves.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = leaves.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(ranges, *order, "tie")
    ranged = scratch.save(ranged.withColumn("range", F.spark_partition_id()), "leaves")
    counts = ranged.groupBy("range", "lang").agg(F.count(F.lit(1)).alias("rows"))
    before = Window.partitionBy("lang").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    langs = counts.groupBy("lang").agg(F.sum("rows").alias("many"))
    langs = langs.withColumn("tree", F.row_number().over(Window.orderBy(F.col("lang").asc_nulls_first())).cast("long") - 1)
    counts = counts.withColumn("before", F.coalesce(F.sum("rows").over(before), F.lit(0))).alias("c")
    counts = counts.join(langs.alias("l"), F.expr("c.lang <=> l.lang")).select("c.range", "c.lang", "before", "tree", "many")
    within = Window.partitionBy("range", "lang").orderBy(*order[1:], "tie")
    rows = ranged.withColumn("within", F.row_number().over(within)).alias("r").join(counts.alias("c"), F.expr("r.range = c.range AND r.lang <=> c.lang"))
    return rows.select("r.doc_id", "r.lang", "tree", (F.col("before") + F.col("within") - 1).alias("n"), "many", F.col("leaf").alias("h"), "seen")


def manifest(docs: DataFrame, seen: Column, scratch: Scratch, levels: int = LEVELS) -> DataFrame:
    """The tree over ``docs``, and whether the text ``seen`` proves to be each document's.

    Gives ``doc_id``, ``lang`` (of the document), its ``leaf``, the ``subroot`` of its language, the ``root``, a digest of its proof,
    the ``folded_root`` of the leaf with ``seen`` for its text, and ``verified``.
    """
    leaves = docs.select("doc_id", "lang", leaf_of(F.col("text")).alias("leaf"), leaf_of(seen).alias("seen"))
    nodes = scratch.save(numbered(leaves, scratch), "nodes")
    tiers = climbed(nodes.select("tree", "n", "many", "h"), scratch, "lang", levels)
    subroots = tiers[-1].select("tree", F.col("h").alias("subroot"))  # one row a language
    trees = subroots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("n"), F.count(F.lit(1)).over(Window.partitionBy(F.lit(0))).alias("many"), F.col("subroot").alias("h"))
    top = climbed(scratch.save(trees, "trees"), scratch, "top", levels)
    root = top[-1].select(F.col("tree").alias("_top"), F.col("h").alias("root"))  # one row
    # the lowest nodes of the top are the trees' roots: their paths are the outer proofs of the trees' only buckets
    paths = descended(top, None, scratch, "top", levels)
    lowest = top[0].select("*", bucket_of(levels))
    above = lowest.groupBy("tree", "bucket").cogroup(paths.groupBy("tree", "bucket")).applyInArrow(folding(passed, levels), f"tree long, bucket long, path {PATH}")
    outer = above.select(F.col("bucket").alias("tree"), F.lit(0).cast("long").alias("bucket"), "path")
    outer = descended(tiers, scratch.save(outer, "outer"), scratch, "lang", levels)
    outer = outer.join(subroots.withColumn("_top", F.lit(0).cast("long")).join(root, "_top").drop("_top"), "tree")
    rows = nodes.select("*", bucket_of(levels))
    return rows.groupBy("tree", "bucket").cogroup(outer.groupBy("tree", "bucket")).applyInArrow(folding(proved, levels), PROVED)


def tampered() -> Column:
    """The text with A-Z in lower case where 3 divides the CRC-32 of the decimal ``doc_id``."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.translate("text", upper, upper.lower())).otherwise(F.col("text"))


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole ``documents``: the manifest, and what tampering with a third of the texts does to it."""
    scratch = Scratch(spark, "manifest")
    found = manifest(table(spark, sf_dir, "documents").select(*FIELDS), tampered(), scratch)
    return scratch.finish(found.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"))


def digit(value: str) -> str:
    """SQL of a leaf's field."""
    return f"CASE WHEN {value} IS NULL THEN '-' ELSE strlen(CAST({value} AS VARCHAR)) || ':' || {value} END"


_LEAF = "sha256(" + " || ".join(digit(f) for f in FIELDS) + ")"
_SEEN = "sha256(" + " || ".join(digit(f if f != "text" else "seen_text") for f in FIELDS) + ")"
OP13_SQL = f"""
WITH RECURSIVE c AS (
  SELECT *, list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT))),
    lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), [0, 0, 0, 0, 0, 0, 0, 0] :: BIGINT[]), lambda x, _: xor(x >> 1, 3988292384 * (x & 1)))) AS crc
  FROM documents),
d AS (SELECT *, CASE WHEN xor(crc, 4294967295) % 3 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS seen_text FROM c),
l AS (SELECT doc_id, lang, leaf, seen, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS n, count(*) OVER (PARTITION BY lang) AS many
  FROM (SELECT *, {_LEAF} AS leaf, {_SEEN} AS seen FROM d)),
up AS (SELECT lang, 0 AS level, n, many, leaf AS h FROM l
  UNION ALL SELECT lang, level + 1, n // 8, (any_value(many) + 7) // 8, sha256(string_agg(h, '' ORDER BY n)) FROM up WHERE many > 1 GROUP BY lang, level, n // 8),
sub AS (SELECT lang, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS n, count(*) OVER () AS many FROM up WHERE many = 1),
top AS (SELECT 0 AS level, n, many, subroot AS h FROM sub
  UNION ALL SELECT level + 1, n // 8, (any_value(many) + 7) // 8, sha256(string_agg(h, '' ORDER BY n)) FROM top WHERE many > 1 GROUP BY level, n // 8),
side AS (SELECT lang, level, n, coalesce(string_agg(h, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
    coalesce(string_agg(h, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after
  FROM up WHERE many > 1 WINDOW w AS (PARTITION BY lang, level, n // 8 ORDER BY n)),
tops AS (SELECT level, n, coalesce(string_agg(h, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
    coalesce(string_agg(h, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after
  FROM top WHERE many > 1 WINDOW w AS (PARTITION BY level, n // 8 ORDER BY n)),
upper_path AS (SELECT sub.lang, sub.subroot, list({{before: before, after: after}} ORDER BY level) FILTER (level IS NOT NULL) AS above
  FROM sub LEFT JOIN tops ON tops.n = sub.n // CAST(pow(8, tops.level) AS BIGINT) GROUP BY sub.lang, sub.subroot),
lower_path AS (SELECT l.doc_id, l.lang, l.n, leaf, seen, list({{before: before, after: after}} ORDER BY level) FILTER (level IS NOT NULL) AS path
  FROM l LEFT JOIN side ON side.lang IS NOT DISTINCT FROM l.lang AND side.n = l.n // CAST(pow(8, side.level) AS BIGINT) GROUP BY ALL),
proof AS (SELECT doc_id, leaf, seen, subroot, (SELECT h FROM top WHERE many = 1) AS root, list_concat(path, above) AS path
  FROM lower_path p JOIN upper_path u ON u.lang IS NOT DISTINCT FROM p.lang)
SELECT doc_id, leaf, subroot, root, sha256(coalesce(array_to_string(list_transform(path, lambda s: s.before || s.after), ''), '')) AS proof_sha256,
  list_reduce(list_prepend({{before: seen, after: ''}}, coalesce(path, [])), lambda a, s: {{before: sha256(s.before || a.before || s.after), after: ''}}).before AS folded_root,
  folded_root = root AS verified
FROM proof
"""
