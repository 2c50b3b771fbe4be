"""Article bodies: HTML as a flat list of typed blocks, and what is counted and compared over them.

Nested columns are flattened depth first; `path` says where a block stood. The
parser is the standard library's, one page at a time behind an Arrow batch
function; everything after it is column expressions.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as c

#: Fixed values of the domain: hosts of embeds, and block types that count as rich structure.
PROVIDERS = (("youtube", "(youtube\\.com|youtu\\.be)"), ("instagram", "instagram\\.com"), ("facebook", "facebook\\.com"), ("twitter", "(twitter|x)\\.com"), ("maps", "google\\.[a-z.]+/maps"), ("vimeo", "vimeo\\.com"), ("spotify", "spotify\\.com"))
AT_ONCE = 256
RICH = ("heading", "list", "quote", "gallery", "image", "embed", "columns")
BLOCK = "struct<type:string,level:int,text:string,url:string,items:array<string>,path:string>"

_HEADINGS = {f"h{n}": n for n in range(1, 7)}
_TEXT = {"p": "paragraph", "div": "paragraph", "section": "paragraph", "article": "paragraph", "blockquote": "quote", "figcaption": "caption", "pre": "paragraph", "table": "raw_html"}
_HIDDEN = {"script", "style", "svg", "noscript", "template", "head"}
_COLUMNS = {"wp-block-columns", "wp-block-column", "row", "column"}


class _Blocks(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[dict] = []
        self.kind, self.level, self.text, self.hidden = "paragraph", None, [], 0
        self.items: list[str] | None = None
        self.item: list[str] | None = None
        self.path: list[int] = []
        self.opened: list[str] = []

    def put(self, kind: str, **more) -> None:
        self.out.append({"type": kind, "level": None, "text": None, "url": None, "items": None, "path": ".".join(map(str, self.path)), **more})

    def flush(self) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            self.put(self.kind, level=self.level, text=text)
        self.kind, self.level, self.text = "paragraph", None, []

    def handle_starttag(self, tag, attrs) -> None:
        given = dict(attrs)
        if tag in _HIDDEN:
            self.hidden += 1
        elif self.hidden:
            return
        elif tag in _HEADINGS:
            self.flush()
            self.kind, self.level = "heading", _HEADINGS[tag]
        elif tag in ("ul", "ol") and self.items is None:
            self.flush()
            self.items = []
        elif tag == "li" and self.items is not None:
            self.end_item()
            self.item = []
        elif tag == "img":
            url = given.get("src") or given.get("data-src")
            if self.item is None:
                held = (self.kind, self.level)
                self.flush()
                self.kind, self.level = held
            self.put("image", url=url, text=given.get("alt") or None)
        elif tag == "iframe":
            self.flush()
            self.put("embed", url=given.get("src"))
        elif tag == "hr":
            self.flush()
            self.put("separator")
        elif tag == "br":
            (self.text if self.item is None else self.item).append(" ")
        elif tag in _TEXT:
            if _COLUMNS & set((given.get("class") or "").split()):
                self.flush()
                self.path.append(len(self.out))
                self.opened.append(tag)
                return
            if self.item is None:
                self.flush()
                self.kind = _TEXT[tag]
            if tag == "div" and self.opened:
                self.opened.append("")

    def end_item(self) -> None:
        if self.item is not None:
            text = " ".join("".join(self.item).split())
            if text:
                self.items.append(text)
        self.item = None

    def handle_endtag(self, tag) -> None:
        if tag in _HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        elif self.hidden:
            return
        elif tag in ("ul", "ol") and self.items is not None:
            self.end_item()
            if self.items:
                self.put("list", items=self.items, level=int(tag == "ol"))
            self.items = None
        elif tag == "li":
            self.end_item() if self.items is not None else None
        elif tag in _HEADINGS or tag in _TEXT:
            if self.item is None:
                self.flush()
            if tag == "div" and self.opened and self.opened.pop():
                self.path.pop()

    def handle_data(self, data) -> None:
        if not self.hidden:
            (self.text if self.item is None else self.item).append(data)


def parse_blocks(html: str | None) -> list[dict]:
    """Blocks of a page; broken HTML gives what can be read of it."""
    parser = _Blocks()
    parser.feed(html or "")
    parser.close()
    if parser.items is not None:
        parser.handle_endtag("ul")
    parser.flush()
    return parser.out


def with_blocks(pages: DataFrame, html: str = "html", into: str = "blocks") -> DataFrame:
    """pages with their blocks; a task holds those of AT_ONCE pages as objects, the rest of its batch as Arrow."""
    fields = [("type", pa.string()), ("level", pa.int32()), ("text", pa.string()), ("url", pa.string()), ("items", pa.list_(pa.string())), ("path", pa.string())]

    @F.arrow_udf(f"array<{BLOCK}>")
    def read(text: pa.Array) -> pa.Array:
        parts = [pa.array([parse_blocks(t) for t in text[i : i + AT_ONCE].to_pylist()], pa.list_(pa.struct(fields))) for i in range(0, len(text), AT_ONCE)]
        return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.struct(fields)))

    return pages.withColumn(into, read(F.col(html)))


def block_text(block: Column) -> Column:
    """What a reader sees of a block: list items, captions and text; nothing of embeds and separators."""
    return F.when(block["type"] == "list", F.array_join(block["items"], " ")).when(block["type"].isin("embed", "separator", "image"), "").otherwise(F.coalesce(block["text"], F.lit("")))


def text_of(blocks: Column) -> Column:
    return c.collapse(F.array_join(F.filter(F.transform(blocks, block_text), lambda t: t != ""), " "))


def stats(blocks: Column) -> Column:
    """struct(chars, headings, media, rich_types, blocks)."""
    of = lambda *kinds: F.size(F.filter(blocks, lambda b: b["type"].isin(*kinds)))
    rich = F.size(F.array_distinct(F.filter(F.transform(blocks, lambda b: b["type"]), lambda t: t.isin(*RICH))))
    return F.struct(F.length(text_of(blocks)).alias("chars"), of("heading").alias("headings"), of("image", "embed").alias("media"), rich.alias("rich_types"), F.size(blocks).alias("blocks"))


def provider(url: Column) -> Column:
    out = F.lit("other")
    for name, pattern in reversed(PROVIDERS):
        out = F.when(url.rlike(pattern), name).otherwise(out)
    return out


def without_shortcodes(html: Column) -> Column:
    """Shortcodes as what they stand for: captions and embeds keep their inside, others go; editor comments go."""
    html = F.regexp_replace(html, "(?s)<!-- /?wp:.*?-->", "")
    html = F.regexp_replace(html, "(?is)\\[caption[^\\]]*\\](.*?)\\[/caption\\]", "<figure>$1</figure>")
    html = F.regexp_replace(html, "(?is)\\[embed[^\\]]*\\](.*?)\\[/embed\\]", '<iframe src="$1"></iframe>')
    return F.regexp_replace(html, "\\[/?[a-z][a-z0-9_-]*[^\\]\\[]*\\]", "")


def block_kinds(html: Column) -> Column:
    """How often the editor's comment marks open each kind of block."""
    return F.regexp_extract_all(html, F.lit("<!-- wp:([a-z0-9/-]+)"), 1)


def content_loss(before: Column, after: Column) -> Column:
    """Share of the visible characters that cleaning lost, in percent."""
    n = F.length(F.regexp_replace(before, "[ \t\r\n]", ""))
    m = F.length(F.regexp_replace(after, "[ \t\r\n]", ""))
    return F.when(n > 0, F.greatest(F.lit(0.0), (n - m) * 100.0 / F.nullif(n, F.lit(0)))).otherwise(0.0)


def _lost_and_gained(key: str):
    words = re.compile("[^ \t\r\n]+").findall

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for at in range(0, b.num_rows, AT_ONCE):
                few = b.slice(at, AT_ONCE)
                for k, text, part in zip(*(few.column(i).to_pylist() for i in range(3)), strict=True):
                    have, left = Counter(words(text or "")), Counter(words(part or ""))
                    if have or left:
                        rows.append((k, (have - left).total(), (left - have).total()))
            columns = list(zip(*rows, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], b.schema.field(0).type), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64())], [key, "lost", "gained"])

    return run


def word_delta(docs: DataFrame, text: str, part: str, key: str = "id") -> DataFrame:
    """(key, lost, gained): how many words `text` has more often than `part` has, and how many less often; a key without words isn't listed.

    A document's words are counted inside its row, so none are shuffled. Only rows
    that repeat a key are counted together, word by word, and so are rows without
    a key, whose two sides don't meet.
    """
    again = docs.groupBy(F.col(key).alias("__k")).agg(F.count("*").alias("__n")).filter("__n > 1 OR __k IS NULL").select("__k")
    own = lambda rows: rows.select(key, text, part).mapInArrow(_lost_and_gained(key), f"{key} {dict(docs.dtypes)[key]}, lost long, gained long")
    if again.isEmpty():
        return own(docs)
    same = F.col(key).eqNullSafe(F.col("__k"))
    each = lambda t, n: docs.join(again, same, "left_semi").select(key, F.explode(F.split(F.col(t), "[ \t\r\n]+")).alias("w")).filter("w <> ''").groupBy(key, "w").agg(F.count("*").alias(n))
    both = each(text, "a").join(each(part, "b"), [key, "w"], "full").na.fill(0, ["a", "b"])
    sums = both.groupBy(key).agg(F.sum(F.greatest(F.col("a") - F.col("b"), F.lit(0))).alias("lost"), F.sum(F.greatest(F.col("b") - F.col("a"), F.lit(0))).alias("gained"))
    return own(docs.join(again, same, "left_anti")).unionByName(sums)
