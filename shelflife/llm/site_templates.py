"""Main text of HTML pages by removal of what a site repeats.

Every block element of a page is hashed with all that is in it. The hashes are counted per host: on how many of the
host's pages with different contents does the same subtree occur. A subtree that recurs on many of them is part of
the site's template and is deleted wherever it occurs on that host. What is left is cleaned of parts that name themselves
by element, class, id or role (menus, adverts, forms, comments), which also catches templates of hosts with few pages.

A page's content is told by its longest block of text, so a thousand copies of one article count as one page, and their
common parts aren't a template. Inside an article or main element only parts of a page (lists, boxes, sections) can be a
template; paragraphs and headings there stay however often they recur. Elsewhere such a
leaf must also be on LEAF_SHARE of the host's contents. If a page has an article (or main) element, its text is what is in
the articles (or main parts), else all that is left.

Pages are read twice. The first time only their hashes are kept, by a key of url and html, so that equal pages are one. The second
time a page goes, compressed, to where its key's marks are; a key of very many pages is sent to them instead.

A null or empty html gives an empty text. A null or odd url is a host of its own, `''`, without a template. Repeated
rows are pages with equal contents and get equal texts. Bad markup never fails. An empty table gives no rows. All columns
but the html stay, also those named like an inner column; the operator's own is `extracted`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from shelflife.llm.html_blocks import Page, read_page
from shelflife.llm.joins import join_uneven
from shelflife.llm.scratch import text_batches, unboxed, written
from shelflife.llm.text import pieces

#: A template is on so many pages of its host with different contents.
MANY_PAGES = 5
#: A paragraph outside articles must be on this share of them as well.
LEAF_SHARE = 0.01
#: Salts of the join with the contents of a host.
SALTS = 64

_HOST = re.compile(r"^\s*[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]+)")
_SURVEY = "_key binary, _host long, _content long, _hashes array<long>"
_PACKED = "_key binary, _size long, _page binary"
EXTRACTED = "text string, n_chars long, n_template long, n_ruled long"


def host_of(url: str | None) -> str:
    found = _HOST.match(url or "")
    return found[1].lower() if found else ""


def _number(text: str) -> int:
    return int.from_bytes(blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def content_of(page: Page) -> int:
    """A hash of the longest block that no rule drops; of several, the first."""
    return _number(max((b.text for b in page.blocks if not b.ruled), key=len, default=""))


def _key(url: str | None, html: str) -> bytes:
    """Equal for equal html and url; a null url differs from an empty one, which makes no difference to the text."""
    return blake2b(repr(url).encode() + b"\0" + html.encode(), digest_size=16).digest()


def _survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        keys, hosts, contents, hashes = [], [], [], []
        for url, html in zip(batch.column("_url").to_pylist(), batch.column("text").to_pylist()):
            host = host_of(url)
            page = read_page(html or "")
            keys.append(_key(url, html or ""))
            hosts.append(_number(host) if host else None)
            contents.append(content_of(page))
            hashes.append(list({e.hash for e in page.elements}) if host else [])
        arrays = [pa.array(v, t) for v, t in ((keys, pa.binary()), (hosts, pa.int64()), (contents, pa.int64()), (hashes, pa.list_(pa.int64())))]
        yield pa.RecordBatch.from_arrays(arrays, ["_key", "_host", "_content", "_hashes"])


def templates(kinds: DataFrame) -> DataFrame:
    """(host, hash) of the subtrees that recur: `common` is true if also a leaf may go; `kinds` is on how many different pages they are."""
    occurrences = kinds.where("_host IS NOT NULL").select("_host", "_content", F.explode("_hashes").alias("_hash"))
    counts = (
        occurrences.groupBy("_host", "_hash", "_content").agg(F.count("*").alias("kinds"))
        .groupBy("_host", "_hash").agg(F.count("*").alias("contents"), F.sum("kinds").alias("kinds"))
        .where(F.col("contents") >= MANY_PAGES)
        .withColumn("_salt", F.pmod(F.col("_hash"), F.lit(SALTS)).cast("int"))
    )
    hosts = (
        kinds.where("_host IS NOT NULL").select("_host", "_content").distinct().groupBy("_host").agg(F.count("*").alias("_of"))
        .where(F.col("_of") >= MANY_PAGES)
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    )
    common = F.col("contents") >= F.col("_of") * LEAF_SHARE
    return counts.join(hosts, ["_host", "_salt"]).select("_host", "_hash", common.alias("common"), "kinds")


def _text_of(page: Page, recurring: dict[int, bool]) -> tuple[str, int, int]:
    """The page's text without subtrees that recur and blocks that a rule drops, and the numbers of both kinds of blocks."""
    gone = [False] * len(page.blocks)
    for element in page.elements:
        if element.hash in recurring and (recurring[element.hash] or not element.leaf):
            gone[element.first : element.end] = [True] * (element.end - element.first)
    least = 2 if page.has_article else 1 if page.has_main else 0
    kept = [b.text for b, g in zip(page.blocks, gone) if not (g or b.ruled) and b.scope >= least]
    return "\n".join(kept), sum(gone), sum(b.ruled and not g for b, g in zip(page.blocks, gone))


def _assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    codec = pa.Codec("zstd")
    for batch in batches:
        rows = []
        for size, packed, found in zip(*[batch.column(c).to_pylist() for c in ("_size", "_page", "_found")]):
            html = codec.decompress(packed, size, asbytes=True).decode()
            text, n_template, n_ruled = _text_of(read_page(html), {m["_hash"]: m["common"] for m in found or ()})
            rows.append((text, len(text), n_template, n_ruled))
        columns = list(zip(*rows)) or [()] * 4
        result = pa.StructArray.from_arrays(
            [pa.array(columns[0], pa.string()), *[pa.array(c, pa.int64()) for c in columns[1:]]], ["text", "n_chars", "n_template", "n_ruled"]
        )
        yield pa.RecordBatch.from_arrays([batch.column("_box"), result], ["_box", "extracted"])
    pa.default_memory_pool().release_unused()


def extract_text(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """The columns of `pages` but for `html`, and a struct `extracted`: text, n_chars (code points), n_template (blocks that
    recur on the host) and n_ruled (other blocks that a rule drops)."""
    text_batches(pages.sparkSession)
    kept = [c for c in pages.columns if c != html]
    box = F.struct(*[F.col(f"`{c}`") for c in kept]) if kept else F.lit(None).cast("int")
    boxes = pages.select(box.alias("_box"), F.col(f"`{url}`").alias("_url"), F.col(f"`{html}`").alias("text"))
    box_field = boxes.schema["_box"]
    survey = boxes.select("_url", "text").mapInArrow(_survey, _SURVEY)
    kinds = written(
        survey.groupBy("_key").agg(*[F.first(c).alias(c) for c in ("_host", "_content", "_hashes")], F.count("*").alias("_pages")), "page-kinds", "zstd"
    )
    recurring = written(templates(kinds), "templates", "zstd")
    sizes = kinds.agg(F.sum("_pages").alias("pages"), F.sum(F.size("_hashes")).alias("hashes")).first()
    occurrences = kinds.where("_host IS NOT NULL").select("_key", "_host", F.explode("_hashes").alias("_hash"))
    marks = join_uneven(occurrences, recurring, ["_host", "_hash"], "kinds", sizes["hashes"] or 0)
    marks = marks.groupBy("_key").agg(F.collect_list(F.struct("_hash", "common")).alias("_found"))
    marked = written(kinds.select("_key", "_pages").join(marks, "_key", "left"), "page-marks", "zstd")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd", compression_level=3)
        for batch in pieces(batches):
            htmls = [h or "" for h in batch.column("text").to_pylist()]
            keys = [_key(u, h) for u, h in zip(batch.column("_url").to_pylist(), htmls)]
            raw = [h.encode() for h in htmls]
            arrays = [pa.array(keys, pa.binary()), pa.array(map(len, raw), pa.int64()), pa.array([codec.compress(r, asbytes=True) for r in raw], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("_box"), *arrays], ["_box", "_key", "_size", "_page"])

    packed_schema = StructType([box_field, *StructType.fromDDL(_PACKED).fields])
    rows = boxes.mapInArrow(packed, packed_schema)
    found = join_uneven(rows, marked, ["_key"], "_pages", sizes["pages"] or 0).select("_box", "_size", "_page", "_found")
    result_schema = StructType([box_field, StructField("extracted", StructType.fromDDL(EXTRACTED))])
    return unboxed(found.mapInArrow(_assemble, result_schema), kept, (), "extracted")
