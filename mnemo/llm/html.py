"""Main text of web pages, with site templates removed by subtree hashes counted per host.

A forgiving tag scanner builds elements (implied ends of p, li, cells and the like; void elements;
scripts and comments skipped). Every element gets a hash of its tag and content. Spark counts in how
many different articles of a host each hash stands, so that copies of a page count once. Subtrees that
stand in at least ``min_pages`` articles and at least the square root of the host's articles are deleted
from each page; paragraphs, headings, list items and cells, which a few articles may well share, only
from ``share`` of the articles on. Then the article is read: the elements named article (else main, else
body), without navigation, headers, footers, asides, forms, adverts, notices and reader comments,
recognised by element, role, class or id.

The lists that travel to the pages hold a page's own recurring subtrees, whatever the size of the host.

Null html counts as empty and gives an empty text; a null URL belongs to host ''; repeated rows are
kept. Nested articles are read once. Character references are decoded, white space
inside a block becomes one space, blocks are trimmed and joined by one line feed in page order.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._io import materialize

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|title|iframe|svg|math|object|select)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?][^>]*>",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_SPACE = re.compile(r"[\s ]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
DROPPED = frozenset("nav header footer aside form button menu dialog fieldset audio video canvas map head frameset noframes".split())
#: A start tag ends an open element of these kinds (up to the nearest of the stoppers).
ENDS = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select"), "tbody": ("thead tbody tr td th", "table")}
ENDS = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in ENDS.items()}
_UNWANTED = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert|adverts|advertisement|advertising|sponsor|sponsored|promo|banner|cookie|cookies|consent|gdpr|notice|popup|modal|overlay|"
    r"nav|navbar|navigation|menu|breadcrumb|breadcrumbs|sidebar|side-bar|widget|footer|masthead|toolbar|pagination|pager|share|sharing|social|"
    r"comment|comments|commentlist|disqus|reply|replies|respond|related|recommended|newsletter|subscribe|signup|login|search)(?=$|[\s_-])",
    re.I,
)
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())


@dataclass(slots=True)
class Element:
    tag: str
    attributes: str
    parts: list[str] = field(default_factory=list)
    items: list = field(default_factory=list)
    hash: int = 0
    words: bool = False


def _unwanted(e: Element) -> bool:
    if e.tag in DROPPED:
        return True
    if "=" in e.attributes:
        for m in _ATTRIBUTE.finditer(e.attributes):
            name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if name in ("class", "id") and _UNWANTED.search(value) or name == "role" and value.lower() in _ROLES or name == "aria-hidden" and value.lower() == "true" and e.tag not in ("html", "body"):
                return True
    return " hidden" in f" {e.attributes.strip()} ".replace("=", " ") and e.tag not in ("html", "body") and bool(re.search(r"(?:^|\s)hidden(?:\s|=|/|$)", re.sub(r"\"[^\"]*\"|'[^']*'", "", e.attributes)))


def parse(text: str) -> Element:
    """The tree of a page; every element's hash covers its tag and content."""
    root = Element("", "")
    stack = [root]

    def close() -> None:
        e = stack.pop()
        e.hash = xxhash.xxh3_64_intdigest("\x01".join((e.tag, *e.parts)).encode("utf-8", "surrogatepass"))
        stack[-1].parts.append(f"\x02{e.hash:x}")
        stack[-1].words |= e.words

    def words(raw: str) -> None:
        if raw:
            value = entities.unescape(raw)
            stack[-1].items.append(value)
            if not value.isspace():
                stack[-1].words = True
                stack[-1].parts.append(" ".join(value.split()))

    at = 0
    for m in _TOKEN.finditer(text):
        words(text[at : m.start()])
        at = m.end()
        tag = m[3] or m[6]
        if not tag:
            continue
        tag, attributes = tag.lower(), m[4] or m[7] or ""
        if m[2] or m[5]:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == tag:
                    while len(stack) > depth:
                        close()
                    break
            continue
        if tag in ENDS:
            closes, stops = ENDS[tag]
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag in stops:
                    break
                if stack[depth].tag in closes:
                    while len(stack) > depth:
                        close()
                    break
        elif tag not in INLINE:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == "p":
                    while len(stack) > depth:
                        close()
                    break
                if stack[depth].tag not in INLINE:
                    break
        e = Element(tag, attributes)
        stack[-1].items.append(e)
        if tag in VOID or attributes.endswith("/"):
            stack[-1].parts.append(f"\x02{tag}")
        else:
            stack.append(e)
    words(text[at:])
    while len(stack) > 1:
        close()
    return root


_WHOLE = frozenset(["", "html", "body", "article", "main"])


def _walk(root: Element) -> Iterator[Element]:
    todo = [root]
    while todo:
        e = todo.pop()
        yield e
        todo += [x for x in reversed(e.items) if isinstance(x, Element)]


#: Blocks that are text of their own.
TEXT = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd tr td th caption figcaption blockquote pre".split())


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def tops_of(root: Element) -> list[Element]:
    """The elements named article, else main, else body, else the root."""
    for name in ("article", "main", "body"):
        tops: list[Element] = []
        todo = [root]
        while todo:
            e = todo.pop()
            if e.tag == name and e.words:
                tops.append(e)
            elif e.tag == name or not _unwanted(e):
                todo += [x for x in reversed(e.items) if isinstance(x, Element)]
        if tops:
            return tops
    return [root]


def subtrees(text: str) -> tuple[int, list[int], list[int]]:
    """Hash of the page's article; hashes of its block elements with words: those of ``TEXT`` and the others."""
    tops = tops_of(parse(text))
    blocks = [e for top in tops for e in _walk(top) if e.words and e.tag not in INLINE and e.tag not in _WHOLE]
    article = xxhash.xxh3_64_intdigest("\x01".join(p for top in tops for p in top.parts).encode("utf-8", "surrogatepass"))
    return _signed(article), sorted({_signed(e.hash) for e in blocks if e.tag in TEXT}), sorted({_signed(e.hash) for e in blocks if e.tag not in TEXT})


def main_text(text: str, template: frozenset[int] = frozenset()) -> str:
    """Blocks of the article, less the subtrees whose (signed) hash is in ``template``."""
    tops = tops_of(parse(text))
    blocks: list[str] = []
    line: list[str] = []

    def flush() -> None:
        if block := _SPACE.sub(" ", "".join(line)).strip():
            blocks.append(block)
        line.clear()

    for top in tops:
        todo: list = [top]
        while todo:
            x = todo.pop()
            if x is None:
                flush()
            elif isinstance(x, str):
                line.append(x)
            elif x.tag == "br":
                line.append(" ")
            elif x is not top and (_unwanted(x) or _signed(x.hash) in template):
                if x.tag not in INLINE:
                    flush()
            elif x.tag in INLINE:
                todo += reversed(x.items)
            else:
                flush()
                todo.append(None)
                todo += reversed(x.items)
        flush()
    return "\n".join(blocks)


def keyed(pages: DataFrame, url: str, page: str) -> DataFrame:
    """Pages with their host and a hash of their content."""
    host = F.lower(F.coalesce(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))
    return pages.withColumn("__host", host).withColumn("__content", F.xxhash64(F.coalesce(page, F.lit(""))))


def templates(pages: DataFrame, url: str, page: str, min_pages: int = 5, share: float = 0.5) -> DataFrame:
    """(host, content, template): hashes of the subtrees of a page that recur on its host."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                found = [subtrees(t.as_py() or "") for t in part.column(2)]
                arrays = [pa.array([x[0] for x in found], pa.int64()), *(pa.array([x[i] for x in found], pa.list_(pa.int64())) for i in (1, 2))]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *arrays], names=["host", "content", "article", "texts", "others"])

    found = keyed(pages, url, page).select("__host", "__content", page).mapInArrow(run, "host string, content bigint, article bigint, texts array<bigint>, others array<bigint>")
    found = materialize(found)
    # Distinct articles first, by partial sums; neither copies nor a host meet in one task.
    blocks = found.select("host", "content", "article", F.explode(F.concat(F.transform("texts", lambda h: F.struct(h.alias("hash"), F.lit(True).alias("own"))), F.transform("others", lambda h: F.struct(h.alias("hash"), F.lit(False).alias("own"))))).alias("x"))
    blocks = blocks.select("host", "content", "article", "x.hash", "x.own")
    times = blocks.select("host", "hash", "own", "article").distinct().groupBy("host", "hash", "own").agg(F.count("*").alias("n")).filter(F.col("n") >= min_pages)
    total = found.select("host", "article").distinct().groupBy("host").agg(F.count("*").alias("pages"))
    enough = F.when(F.col("own"), F.col("pages") * F.lit(share)).otherwise(F.sqrt("pages"))
    often = materialize(times.join(total, "host").filter(F.col("n") >= enough).select("host", "hash"))
    return materialize(blocks.select("host", "content", "hash").join(often, ["host", "hash"]).groupBy("host", "content").agg(F.collect_set("hash").alias("template")))


def extract(pages: DataFrame, url: str = "url", page: str = "html", out: str = "text", min_pages: int = 5, share: float = 0.5) -> DataFrame:
    """Append ``out`` (replacing a column of that name): the main text of each page."""
    pages = pages.drop(out)
    own = "__template"
    lists = templates(pages, url, page, min_pages, share).select(F.col("host").alias("__host"), F.col("content").alias("__content"), F.col("template").alias(own))
    schema = T.StructType([*pages.schema.fields, T.StructField(out, T.StringType())])
    names = pages.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                made = [main_text(t.as_py() or "", frozenset(x.as_py() or ())) for t, x in zip(part.column(page), part.column(own), strict=True)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(made, pa.string())], names=[*names, out])

    return keyed(pages, url, page).join(lists, ["__host", "__content"], "left").drop("__host", "__content").mapInArrow(run, schema)
