"""Main text of web pages: differencing with the nearest URLs of the host, on lines whose elements give roles.

``read`` turns html into lines (blocks of text in page order), each with a role: boilerplate (menus, headers, footers,
sidebars, notices, adverts, forms, comments, by element, role or class), article (inside an article or main element), or
open. Pages of one host with the same lines are one page. Pages are ordered by host and URL path; each is aligned with
its ``ASKED`` nearest ones by longest common subsequences of lines. A line that ``SHARED`` of them or more have in line
with it belongs to the frame and is deleted. A passage that a few neighbours quote or copy stays. Of a page with an
article the other lines go, as markup that says where the text is needs no neighbours; within it only lines at its ends
go that all neighbours, ``FEW`` at least, have in line, and a line between two that stay never does.

Only 64-bit hashes of lines are shuffled for the alignment, in chunks of ``CHUNK`` pages in URL order that
overlap by ``REACH``, so a host of any size is spread over tasks and results do not depend on the partitions.

Edge cases: null and empty html give empty text. A null url belongs to a host of its own without
neighbours. Unclosed elements end with their parent. Repeated rows are one page to the alignment and
each get a result. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from html import unescape

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, table

CHUNK = 64
REACH = 8
#: Nearest pages that a page is aligned with, the share of them that makes a line the frame's, and the least number that empties an article's ends.
ASKED, SHARED, FEW = 8, 0.5, 3
RANGE_ROWS = 20_000
BOILERPLATE, ARTICLE, OPEN = 0, 1, 2

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
RAW = {t: re.compile(rf"</{t}\b[^>]*>|\Z", re.I) for t in ("script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "math", "xmp", "noembed", "noframes")}
ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th "
    "thead tr ul".split()
)
DROP = frozenset("nav header footer aside form menu button select dialog head object".split())
ARTICLES = frozenset(("article", "main"))
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSED_BY = {"p": BLOCK - {"br"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}}
HOLDS = frozenset("ul ol dl table div article section main body".split())
NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|advertising|sponsor(?:ed)?|cookies?|consent|notices?|nav(?:bar|igation)?|menu|"
    r"sidebar|footer|header|masthead|comments?|disqus|replies|breadcrumbs?)(?:$|[\s_-])",
    re.I,
)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())


def dropped(tag: str, attributes: str, in_article: bool) -> bool:
    if tag in DROP and not (tag == "header" and in_article):
        return True
    if not attributes or tag in ("html", "body"):
        return False
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or "").strip("\"'")
        if name == "role" and value.lower() in ROLES or name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        if name in ("class", "id") and value and tag not in ARTICLES and tag not in HEADINGS and NAMES.search(value):
            return True
    return False


def read(html: str) -> list[tuple[str, int]]:
    """Lines of the page with their roles."""
    lines: list[tuple[str, int]] = []
    held: list[str] = []
    stack: list[tuple[str, int]] = [("", OPEN)]
    at = 0

    def flush() -> None:
        line = " ".join("".join(held).split())
        held.clear()
        if line:
            lines.append((line, stack[-1][1]))

    while True:
        m = TAG.search(html, at)
        text = html[at : m.start() if m else len(html)]
        if text:
            held.append(unescape(text) if "&" in text else text)
        if not m:
            break
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            if tag in BLOCK:
                flush()
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    if tag not in BLOCK and any(stack[i][0] in HOLDS for i in range(k + 1, len(stack))):
                        break
                    del stack[k:]
                    break
            continue
        if tag in RAW:
            end = RAW[tag].search(html, at)
            at = end.end()
            continue
        if tag in BLOCK:
            flush()
            for k in range(len(stack) - 1, 0, -1):
                if tag in CLOSED_BY.get(stack[k][0], ()):
                    del stack[k:]
                    break
                if stack[k][0] in HOLDS:
                    break
        if tag in VOID:
            continue
        role = stack[-1][1]
        if role != BOILERPLATE:
            attributes = m[3] or m[6] or ""
            if dropped(tag, attributes, role == ARTICLE):
                role = BOILERPLATE
            elif tag in ARTICLES or 'role="main"' in attributes:
                role = ARTICLE
        stack.append((tag, role))
    flush()
    return lines


def longest_common(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Positions of a longest common subsequence, from the matches in order (Hunt and Szymanski)."""
    places: dict[int, list[int]] = {}
    for j, x in enumerate(b):
        places.setdefault(x, []).append(j)
    tails: list[int] = []
    nodes: list[tuple] = []
    for i, x in enumerate(a):
        for j in reversed(places.get(x, ())):
            k = bisect_left(tails, j)
            node = (i, j, nodes[k - 1] if k else None)
            if k == len(tails):
                tails.append(j)
                nodes.append(node)
            else:
                tails[k], nodes[k] = j, node
    out, node = [], nodes[-1] if nodes else None
    while node:
        out.append(node[:2])
        node = node[2]
    return out[::-1]


def runs(lines: list[int]) -> tuple[list[int], list[list[int]]]:
    """Lines with repeats in a row taken as one, and the positions of each."""
    heads: list[int] = []
    own: list[list[int]] = []
    for i, x in enumerate(lines):
        if heads and heads[-1] == x:
            own[-1].append(i)
        else:
            heads.append(x)
            own.append([i])
    return heads, own


def shared_prefix(a: str, b: str) -> int:
    x, y = a.split("/"), b.split("/")
    n = 0
    while n < min(len(x), len(y)) and x[n] == y[n]:
        n += 1
    return n


def difference(rows: list[tuple[str, str, list[int], list[int]]], i: int) -> list[int]:
    """Positions of the lines of page ``i`` (host, path, line hashes, roles) that its nearest pages share."""
    host, path, lines, roles = rows[i]
    near = [j for j in range(max(0, i - REACH), min(len(rows), i + REACH + 1)) if j != i and rows[j][0] == host]
    near.sort(key=lambda j: (-shared_prefix(path, rows[j][1]), abs(j - i), j))
    near = near[:ASKED]
    votes = [0] * len(lines)
    held = set(lines)
    for j in near:
        both = held.intersection(rows[j][2])
        if not both:
            continue
        mine = [p for p, x in enumerate(lines) if x in both]  # other lines are in no common subsequence
        heads, own = runs([lines[p] for p in mine])
        other, _ = runs([x for x in rows[j][2] if x in both])
        for a, _ in longest_common(heads, other):
            for p in own[a]:
                votes[mine[p]] += 1
    gone = [p for p, n in enumerate(votes) if n and roles[p] != ARTICLE and n >= SHARED * len(near)]
    return sorted(gone + ends(votes, roles, len(near)))


def ends(votes: list[int], roles: list[int], asked: int) -> list[int]:
    """Lines at either end of an article that all neighbours have in line; never the whole article, nor a line between two kept ones."""
    own = [p for p, role in enumerate(roles) if role == ARTICLE]
    kept = [k for k, p in enumerate(own) if votes[p] < max(asked, FEW)]
    return own[: kept[0]] + own[kept[-1] + 1 :] if kept else []


def split_url(pages: DataFrame) -> DataFrame:
    host = F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))
    path = F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    key = F.concat_ws(":", F.coalesce(F.col("page_id").cast("string"), F.lit("null")), F.hex(F.xxhash64("url", "html")))
    return pages.select(F.col("page_id").cast("long"), "url", F.coalesce("html", F.lit("")).alias("html"), host.alias("host"), path.alias("path"), key.alias("key"))


def hashed_lines(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    digest = xxhash.xxh64_intdigest
    for batch in batches:
        lines, roles = [], []
        for html in batch.column("html").to_pylist():
            found = read(html)
            lines.append(np.array([digest(x) for x, _ in found], np.uint64).view(np.int64))
            roles.append([r for _, r in found])
        yield pa.RecordBatch.from_arrays(
            [batch.column("key"), batch.column("host"), batch.column("path"), pa.array(lines, pa.list_(pa.int64())), pa.array(roles, pa.list_(pa.int32()))],
            names=["key", "host", "path", "lines", "roles"],
        )


def shared_lines(parts: DataFrame, scratch: Scratch) -> DataFrame:
    """``key``, ``gone`` (positions of lines to delete), for pages that have any."""
    slim = parts.select("key", "host", "path", "html").mapInArrow(hashed_lines, "key string, host string, path string, lines array<long>, roles array<int>")
    slim = scratch.save(slim.withColumn("same", F.xxhash64("host", "lines", "roles")), "lines")
    pages = slim.where("host <> ''").groupBy("host", "same").agg(F.min("path").alias("path"), F.min("lines").alias("lines"), F.min("roles").alias("roles"))
    pages = scratch.save(pages, "pages")
    n = max(8, -(-pages.count() // RANGE_ROWS))
    ranged = pages.repartitionByRange(n, "host", "path", "same").sortWithinPartitions("host", "path", "same")
    ranged = ranged.withColumn("part", F.spark_partition_id()).withColumn("nth", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    ranged = scratch.save(ranged, "ranged")  # numbered once
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy("part").count().select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))  # n rows
    placed = ranged.join(F.broadcast(starts), "part").withColumn("at", F.col("start") + F.col("nth"))
    chunk, rest = F.floor(F.col("at") / CHUNK).cast("long"), F.col("at") % CHUNK
    chunks = F.array_compact(F.array(chunk, F.when(rest < REACH, chunk - 1), F.when(rest >= CHUNK - REACH, chunk + 1)))
    spread = placed.select("same", "host", "path", "lines", "roles", "at", F.explode(chunks).alias("chunk"))

    def align(chunk: pd.DataFrame) -> pd.DataFrame:
        chunk = chunk.sort_values("at")
        rows = list(zip(chunk["host"], chunk["path"], map(list, chunk["lines"]), map(list, chunk["roles"]), strict=True))
        mine = (chunk["at"] // CHUNK == chunk["chunk"]).to_numpy()
        found = [(rows[i][0], chunk["same"].iloc[i], difference(rows, int(i))) for i in np.flatnonzero(mine)]
        return pd.DataFrame([f for f in found if f[2]], columns=["host", "same", "gone"], dtype=object)

    gone = scratch.save(spread.groupBy("chunk").applyInPandas(align, "host string, same long, gone array<int>"), "gone")
    return scratch.save(slim.join(gone, ["host", "same"]).dropDuplicates(["key"]).select("key", "gone"), "gone-by-key")


def main_text(html: str, gone: Iterable[int] | None = None) -> str:
    lines = read(html)
    wanted = ARTICLE if any(role == ARTICLE for _, role in lines) else OPEN
    out = set(gone if gone is not None else ())
    return "\n".join(line for i, (line, role) in enumerate(lines) if role == wanted and i not in out)


def extract(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` for every row of ``pages`` (page_id, url, html)."""
    scratch = Scratch(spark, "html")
    parts = split_url(pages)
    gone = shared_lines(parts, scratch)

    @F.pandas_udf("string")
    def text_of(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for html, out in batches:
            yield pd.Series([main_text(h, g) for h, g in zip(html, out, strict=True)], dtype=object)

    found = parts.join(gone, "key", "left").select("page_id", "url", text_of("html", "gone").alias("text"))
    return scratch.finish(found.withColumn("n_chars", F.char_length("text").cast("long")))


def op6_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark, table(spark, sf_dir, "pages"))
