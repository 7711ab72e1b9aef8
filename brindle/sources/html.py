"""HTML pages shredded into nodes, lines, table rows and embedded JSON, once for each page.

The elements of a page are numbered in document order, and each knows the last number below it: an element contains
those from its own number to that one. Parents, and the nearest heading and list item above, are numbers too, so that a
tree of any depth takes room in proportion to its elements. What a page shows is decided by a small cascade (styles).
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from html import unescape
from html.parser import HTMLParser
from itertools import chain
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from brindle.sources import styles

#: Tags without content, tags that end a line, tags that close an open one.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCK = frozenset("address article aside blockquote br dd div dl dt figcaption footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table tbody td th thead title tr ul".split())
SELF_CLOSING = frozenset("p li tr td th dt dd option".split())
HEADINGS = ("h1", "h2", "h3", "h4", "h5")
#: Tags that take room without text.
REPLACED = frozenset("img svg input button video iframe canvas picture select textarea".split())
#: Characters of what a page shows that are kept; rows of tables, and characters of one.
VISIBLE_MOST, ROWS_MOST, ROW_CHARS = 12_000, 20, 300
MAIN_IDS, MAIN_CLASSES = ("main", "MainContent"), ("main-content", "content")

NODE = (
    "struct<node_id: int, last: int, parent: int, heading: int, item: int, depth: int, tag: string, start: int, end: int, shown_start: int, shown_end: int, control: int, "
    "href: string, role: string, aria_label: string, title: string, link_count: int, interactive: boolean, main: boolean>"
)
SCHEMA = f"page_id long, url string, title string, text string, shown string, region struct<first: int, last: int>, error string, nodes array<{NODE}>, lines array<string>, table_rows array<string>, jsonld array<string>"
FIELDS = [x.split(":")[0].strip() for x in NODE[len("struct<") : -1].split(",")]
SPACE = re.compile(r"\s+")


#: Pages of lower-case tags and quoted attributes without references are read by this pattern, a tag and the text after it
#: at a time; the standard parser, which takes several times as long, reads any other.
TOKEN = re.compile(r"""<(/?)([a-z][a-z0-9]*+)((?: [a-z][a-z-]*+="[^"&]*+")*+)>([^<]*+)""")
PLAIN = re.compile(r"""[^<]*+(?:<(?:/[a-z][a-z0-9]*+|[a-z][a-z0-9]*+(?: [a-z][a-z-]*+="[^"&]*+")*+)>[^<]*+)*+""")
ATTRIBUTE = re.compile(r' ([a-z-]+)="([^"]*)"')
#: Tags in which parsers look for no others: those of PLAIN_RAW are plain if they hold text alone.
PLAIN_RAW, RAW = frozenset("script style title textarea".split()), frozenset("xmp iframe noembed noframes noscript plaintext".split())
CONTROLS, CONTROL_ROLES = frozenset(("a", "button")), frozenset(("link", "button"))
BARE: dict[str, str] = {}


class _Flat:
    """Text put together with its white space collapsed."""

    def __init__(self) -> None:
        self.parts: list[str] = []
        self.size, self.spaced = 0, True

    def add(self, flat: str) -> None:
        """A text in which white space is single spaces."""
        flat = flat[1:] if self.spaced and flat.startswith(" ") else flat
        if flat:
            self.parts.append(flat)
            self.size += len(flat)
            self.spaced = flat.endswith(" ")


class _Parser(HTMLParser):
    """Elements in document order, and the page as steps: the number of an element that opens, its complement where it
    ends, or text. Elements know their nearest heading and list item above, and controls the number of those before."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.elements: list[dict] = []
        self.steps: list[int | str] = []
        self.stack: list[dict] = []
        self.open: Counter[str] = Counter()
        self.sheets: list[str] = []
        self.jsonld: list[str] = []
        self.raw: list[str] | None = None
        self.controls = 0

    def read_plain(self, html: str) -> bool:
        """Reads a page of plain markup; False, with some of it read, for any other."""
        if not PLAIN.fullmatch(html):
            return False
        first = html.find("<")
        if first:
            self.handle_data(unescape(html[:first] if first > 0 else html))
        held = ""
        for ends, tag, attributes, text in TOKEN.findall(html):
            if held and not (ends and tag == held):
                return False
            if ends:
                held = ""
                self.handle_endtag(tag)
            else:
                if tag in RAW:
                    return False
                held = tag if tag in PLAIN_RAW else ""
                self.handle_starttag(tag, ATTRIBUTE.findall(attributes) if attributes else ())
            if text:
                self.handle_data(unescape(text) if "&" in text and self.raw is None else text)
        return not held

    def handle_starttag(self, tag, attrs):
        stack, number = self.stack, len(self.elements)
        if tag in SELF_CLOSING and stack and stack[-1]["tag"] == tag:
            self._close()
        a = BARE
        if attrs:
            a = {}
            for k, v in attrs:
                a.setdefault(k, v or "")
        role = a.get("role", "")
        control = -1
        if tag in CONTROLS or role in CONTROL_ROLES:
            control = self.controls
            self.controls += 1
        if stack:
            above = stack[-1]
            parent = above["node_id"]
            heading, item = parent if above["tag"] in HEADINGS else above["heading"], parent if above["tag"] == "li" else above["item"]
        else:
            parent = heading = item = -1
        main = tag == "main" or bool(a) and (role == "main" or a.get("id") in MAIN_IDS or any(c in MAIN_CLASSES for c in a.get("class", "").split()))
        element = {
            "node_id": number, "last": number, "parent": parent, "heading": heading, "item": item, "depth": len(stack) + 1, "tag": tag, "attributes": a, "control": control, "main": main,
            "role": role, "href": a.get("href", ""), "aria_label": a.get("aria-label", ""), "title": a.get("title", ""),
        }
        self.elements.append(element)
        self.steps.append(number)
        if tag in VOID:
            self.steps.append(~number)
            return
        stack.append(element)
        self.open[tag] += 1
        self.raw = [] if tag in ("script", "style") else None

    def _close(self):
        element = self.stack.pop()
        element["last"] = len(self.elements) - 1
        self.open[element["tag"]] -= 1
        self.steps.append(~element["node_id"])
        if self.raw is not None:
            raw, self.raw = "".join(self.raw), None
            if element["tag"] == "style":
                self.sheets.append(raw)
            elif element["attributes"].get("type", "").lower() == "application/ld+json":
                self.jsonld.append(raw)

    def handle_endtag(self, tag):
        if self.open[tag]:
            while self.stack[-1]["tag"] != tag:
                self._close()
            self._close()

    def handle_data(self, data):
        if self.raw is not None:
            self.raw.append(data)
        else:
            self.steps.append(data)

    def finish(self):
        self.close()
        while self.stack:
            self._close()


def _parsed(html: str) -> _Parser:
    p = _Parser()
    if not p.read_plain(html):
        p = _Parser()
        p.feed(html)
    p.finish()
    return p


def shred_text(html: str) -> dict:
    """One page's title, text, shown, region (first and last number), nodes (dicts of FIELDS), lines, table_rows and jsonld.

    text is that of all elements but scripts and style sheets, shown what the page shows of it; a node's stretches
    of both are from start to end and from shown_start to shown_end.
    """
    p = _parsed(html or "")
    elements = p.elements
    seen = styles.visibility(elements, p.sheets)
    text, shown, lines = _Flat(), _Flat(), []
    stack: list[int] = []
    links = boxes = 0
    for step in p.steps:
        if isinstance(step, str):
            flat = SPACE.sub(" ", step)
            text.add(flat)
            if not stack or seen[stack[-1]] == styles.SHOWN:
                shown.add(flat)
                lines.append(flat)
            continue
        number = step if step >= 0 else ~step
        e = elements[number]
        tag = e["tag"]
        if step < 0:
            if stack and stack[-1] == number:
                stack.pop()
            e["end"], e["shown_end"], e["link_count"] = text.size, shown.size, links - e["link_count"]
            # an icon drawn by a style sheet has a name at least
            e["interactive"] = e["control"] >= 0 and seen[number] == styles.SHOWN and not e["flat"] and (shown.size > e["shown_start"] or boxes > e["boxes"] or tag in REPLACED or bool(e["aria_label"] or e["title"]))
        if tag in BLOCK:
            if not text.spaced:
                text.add(" ")
            if seen[number] != styles.GONE:
                if not shown.spaced:
                    shown.add(" ")
                lines.append("\n")
        if step >= 0:
            links += tag == "a" and e["href"] != ""
            e["start"], e["end"], e["shown_start"], e["shown_end"], e["link_count"], e["boxes"] = text.size, text.size, shown.size, shown.size, links, boxes
            boxes += tag in REPLACED and seen[number] == styles.SHOWN
            if tag not in VOID:
                stack.append(number)
    text, shown = "".join(text.parts), "".join(shown.parts)
    rows = (text[e["start"] : e["end"]].strip() for e in elements if e["tag"] == "tr" and e["end"] - e["start"] <= ROW_CHARS + 2)
    rows = [r for r in rows if 0 < len(r) <= ROW_CHARS][:ROWS_MOST]
    title = next((t for e in elements if e["tag"] == "title" and (t := text[e["start"] : e["end"]].strip())), "")
    region = next((e for e in elements if e["main"]), None) or next((e for e in elements if e["tag"] == "body"), None)
    region = {"first": region["node_id"], "last": region["last"]} if region else {"first": -1, "last": len(elements)}
    shown_lines = [x for x in (" ".join(line.split()) for line in "".join(lines).split("\n")) if x]
    return {"title": title, "text": text, "shown": shown, "region": region, "error": None, "nodes": elements, "lines": shown_lines, "table_rows": rows, "jsonld": p.jsonld}


def _shredded(html: str) -> dict:
    try:
        return shred_text(html)
    except Exception as e:  # whatever one page does to the parser, the others go on
        return {"title": "", "text": "", "shown": "", "region": {"first": -1, "last": 0}, "error": f"{type(e).__name__}: {e}", "nodes": [], "lines": [], "table_rows": [], "jsonld": []}


def _batch(keys: list[pa.Array], pages: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    """Pages as one batch, column by column."""
    columns = dict(zip(("page_id", "url"), keys))
    for name in ("title", "text", "shown", "region", "error", "lines", "table_rows", "jsonld"):
        columns[name] = pa.array([p[name] for p in pages], schema.field(name).type)
    kind = schema.field("nodes").type
    sizes, offsets = [len(p["nodes"]) for p in pages], [0]
    for n in sizes:
        offsets.append(offsets[-1] + n)
    fields = [kind.value_type.field(i) for i in range(kind.value_type.num_fields)]
    values = zip(*map(itemgetter(*[f.name for f in fields]), chain.from_iterable(p["nodes"] for p in pages))) if offsets[-1] else [()] * len(fields)
    values = [pa.array(v, f.type) for v, f in zip(values, fields)]
    columns["nodes"] = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(values, fields=fields), type=kind)
    return pa.RecordBatch.from_arrays([columns[f.name] for f in schema], schema=schema)


#: Characters of pages made into one batch: their elements are all a task holds besides the batch that it reads.
BATCH_CHARS = 250_000


def shredded_batches(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Batches of page_id, url, html as batches of the schema, of BATCH_CHARS and what the last page has beyond."""
    for batch in batches:
        html, low, size, done = batch.column("html"), 0, 0, []
        for i in range(batch.num_rows):
            page = html[i].as_py()
            done.append(_shredded(page))
            size += len(page or "")
            if size >= BATCH_CHARS or i == batch.num_rows - 1:
                yield _batch([batch.column(k).slice(low, len(done)) for k in ("page_id", "url")], done, schema)
                low, size, done = i + 1, 0, []


def shred(pages: DataFrame) -> DataFrame:
    """page_id, url, title, text, shown, region, error, nodes, lines, table_rows, jsonld of every page (page_id, url, html).

    A node's text is its stretch of the page's (see node_text), and containment is an interval of numbers, so that a
    deep tree takes no more room than a flat one. Null html is an empty page. A page that the parser fails on is an
    empty page with an error.
    """
    schema = to_arrow_schema(StructType.fromDDL(SCHEMA))
    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(lambda batches: shredded_batches(batches, schema), SCHEMA)


def _stretch(text: Column | str, start: Column, end: Column) -> Column:
    return F.trim(F.substring(F.col(text) if isinstance(text, str) else text, start + 1, end - start))


def node_text(node: Column, text: Column | str = "text", shown: Column | str = "shown") -> Column:
    """The text of a node (a struct of FIELDS) of a page: what it shows, else all it holds."""
    seen = _stretch(shown, node.getField("shown_start"), node.getField("shown_end"))
    return F.coalesce(F.nullif(seen, F.lit("")), _stretch(text, node.getField("start"), node.getField("end")))


def node_at(number: Column) -> Column:
    """The node of that number; null below 0."""
    return F.when(number >= 0, F.get("nodes", number))


def within(node: Column, first: Column, last: Column) -> Column:
    """Whether a node is the element `first`, whose last descendant is `last`, or below it."""
    return (node.getField("node_id") >= first) & (node.getField("node_id") <= last)


def ancestor(node: Column, qualifies: Callable[[Column], Column], most: int) -> Column:
    """Number of the nearest of `most` ancestors for which qualifies(number) holds; -1 if there is none. Within its page's row."""
    up = F.sequence(F.lit(1), F.least(node.getField("depth") - 1, F.lit(most)))
    step = lambda s, _: F.when(s["hit"] >= 0, s).otherwise(F.struct(F.get("nodes", s["at"]).getField("parent").alias("at"), F.when(qualifies(s["at"]), s["at"]).otherwise(F.lit(-1)).alias("hit")))
    walked = F.aggregate(up, F.struct(node.getField("parent").alias("at"), F.lit(-1).alias("hit")), step)
    return F.when(node.getField("depth") > 1, walked["hit"]).otherwise(F.lit(-1))


def visible_text(shredded: DataFrame, most: int = VISIBLE_MOST) -> DataFrame:
    """page_id, url and the first `most` characters of what a page shows, line by line."""
    return shredded.select("page_id", "url", shown_text(most).alias("visible_text"))


def shown_text(most: int = VISIBLE_MOST) -> Column:
    return F.substring(F.array_join("lines", "\n"), 1, most)


#: Where texts of many nodes of a page are taken, it is cut into pieces of 2 to the power of so many characters once:
#: a stretch of the whole is found by counting from its start, which for all nodes is quadratic.
PIECE_BITS = 12


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _pieces(text: str) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{1 << PIECE_BITS}}}"), F.lit(0))


def _piece_stretch(pieces: Column, start: Column, end: Column) -> Column:
    first = F.shiftright(start, PIECE_BITS)
    near = F.array_join(F.slice(pieces, first + 1, F.shiftright(end, PIECE_BITS) - first + 1), "")
    return _stretch(near, start % (1 << PIECE_BITS), end - start + start % (1 << PIECE_BITS))


def controls(most: int | None = None) -> Column:
    """The visible links and buttons of a page, all or the first `most`, as an array of control (their number among all of
    them), tag, text (see node_text), role, href, aria_label, title."""
    found = F.filter("nodes", lambda n: n.interactive)
    found = found if most is None else F.slice(found, 1, most)

    def read(n: Column, text: Column, shown: Column) -> Column:
        seen = _piece_stretch(shown, n.shown_start, n.shown_end)
        own = F.coalesce(F.nullif(seen, F.lit("")), _piece_stretch(text, n.start, n.end))
        return F.struct(n.control.alias("control"), n.tag.alias("tag"), own.alias("text"), *[n.getField(c).alias(c) for c in ("role", "href", "aria_label", "title")])

    return let(_pieces("text"), lambda text: let(_pieces("shown"), lambda shown: F.transform(found, lambda n: read(n, text, shown))))


def nodes(shredded: DataFrame, most: int | None = None) -> DataFrame:
    """The visible links and buttons of each page, all or the first `most`, one row each, in document order; ids count all of them."""
    rows = shredded.select("page_id", "url", F.posexplode(controls(most)).alias("ord", "n"))
    return rows.select("page_id", "url", "ord", F.concat(F.lit("n"), "n.control").alias("id"), "n.tag", "n.text", "n.role", "n.href", "n.aria_label", "n.title")
