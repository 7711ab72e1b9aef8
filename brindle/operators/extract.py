"""From shredded pages to links, cards, submenus, listings and product records.

Tree relations are found in a page's own row: elements are numbered in document order, so that containment is an
interval, and parents, nearest headings and list items are numbers. Nothing is joined or shuffled for them.
"""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions import jsonld, lexicon, text, url
from brindle.operators import pages, records
from brindle.sources import html
from brindle.sources.html import let as _let


def _label(node: Column) -> Column:
    """A link's text, else its title."""
    return F.coalesce(F.nullif(html.node_text(node), F.lit("")), text.clean(node.getField("title")))


def _links(within_region: bool) -> Column:
    kept = F.filter("nodes", lambda n: (n.tag == "a") & (n.href != ""))
    return F.filter(kept, lambda n: html.within(n, F.col("region.first"), F.col("region.last"))) if within_region else kept


def _resolved(rows: DataFrame, same_origin: bool) -> DataFrame:
    rows = rows.withColumn("href", url.resolve("href", "url"))
    return rows.where(url.origin("href") == url.origin("url")) if same_origin else rows


def page_links(shredded: DataFrame, within_region: bool = True, same_origin: bool = True) -> DataFrame:
    """page_id, url, node_id, ord, href (absolute), text of the links of pages, in document order.

    within_region: of the main region only; same_origin: only links to the page's own site. A link without text
    has its title.
    """
    found = F.transform(_links(within_region), lambda n: F.struct(n.node_id.alias("node_id"), n.href.alias("href"), _label(n).alias("text")))
    rows = shredded.select("page_id", "url", F.posexplode(found).alias("ord", "n"))
    return _resolved(rows.select("page_id", "url", "n.node_id", "ord", "n.href", "n.text"), same_origin)


def _cards(within_region: bool) -> Column:
    """The links of a page with their heading and card, as an array in its own row; null if it has none. Only elements that hold links are tried as cards."""

    def trade(n: Column) -> Column:
        own = html.node_text(n)
        compact = (n.end - n.start <= pages.CARD_CHARS + 2) & (n.link_count > 0) & (n.link_count <= pages.CARD_LINKS)
        return F.when(compact, _let(own, lambda t: (F.length(t) <= pages.CARD_CHARS) & (t.rlike(text.PRICE) | t.rlike(pages.ANY + lexicon.COMMERCIAL)))).otherwise(F.lit(False))

    def card(n: Column, trades: Column) -> Column:
        near = html.node_at(html.ancestor(n, lambda at: F.get(trades, at), pages.CARD_LEVELS))
        over = html.node_at(n.heading)
        return F.struct(n.node_id.alias("node_id"), n.href.alias("href"), _label(n).alias("text"), html.node_text(over).alias("heading"), html.node_text(near).alias("card"))

    found = _let(F.transform("nodes", trade), lambda trades: F.transform(_links(within_region), lambda n: card(n, trades)))
    return F.when(F.exists("nodes", lambda n: (n.tag == "a") & (n.href != "")), found)


def _card_rows(rows: DataFrame, same_origin: bool = True) -> DataFrame:
    """cards of rows (page_id, url, cards: as _cards has them)."""
    rows = rows.select("page_id", "url", F.posexplode("cards").alias("ord", "n"))
    rows = _resolved(rows.select("page_id", "url", "n.node_id", "ord", "n.href", "n.text", "n.heading", "n.card"), same_origin)
    rows = rows.withColumn("title", F.coalesce(F.nullif("heading", F.lit("")), "text")).where("title <> ''")
    return rows.withColumn("card", F.coalesce("card", "title")).drop("heading")


def cards(shredded: DataFrame, within_region: bool = True, same_origin: bool = True) -> DataFrame:
    """page_links with title (of the closest heading, else the link's own text) and card: the text of the nearest of
    seven ancestors that is compact and has a price or a shop's phrase; the title if there is none. Links without a
    title are left out."""
    return _card_rows(shredded.select("page_id", "url", _cards(within_region).alias("cards")), same_origin)


def nearest(shredded: DataFrame, tag: str, most: int, name: str) -> DataFrame:
    """All links of pages (page_id, url, ord, href, text) with the text of the nearest of `most` ancestors of a tag;
    links without one are left out."""
    at = lambda n: html.ancestor(n, lambda i: F.get("nodes", i).getField("tag") == tag, most)
    found = F.transform(_links(False), lambda n: F.struct(n.href.alias("href"), _label(n).alias("text"), html.node_text(html.node_at(at(n))).alias(name)))
    rows = shredded.select("page_id", "url", F.posexplode(found).alias("ord", "n"))
    return _resolved(rows.select("page_id", "url", "ord", "n.href", "n.text", F.col(f"n.{name}").alias(name)), False).where(F.col(name).isNotNull())


def surroundings(shredded: DataFrame, within_region: bool = False, same_origin: bool = False, most: int = 4) -> DataFrame:
    """page_links with near: the longest text of up to `most` ancestors (of equally long ones the nearest), or the
    link's own if none is longer."""

    def near(n: Column) -> Column:
        up = F.sequence(F.lit(1), F.least(n.depth - 1, F.lit(most)))
        longer = lambda a, b: F.when(F.length(a) >= F.length(b), a).otherwise(b)
        step = lambda s, _: _let(F.get("nodes", s["at"]), lambda e: F.struct(e.parent.alias("at"), longer(s["near"], html.node_text(e)).alias("near")))
        walked = F.aggregate(up, F.struct(n.parent.alias("at"), _label(n).alias("near")), step)
        return F.when(n.depth > 1, walked["near"]).otherwise(_label(n))

    found = F.transform(_links(within_region), lambda n: F.struct(n.node_id.alias("node_id"), n.href.alias("href"), _label(n).alias("text"), near(n).alias("near")))
    rows = shredded.select("page_id", "url", F.posexplode(found).alias("ord", "n"))
    return _resolved(rows.select("page_id", "url", "n.node_id", "ord", "n.href", "n.text", "n.near"), same_origin)


def children(shredded: DataFrame, roots: DataFrame) -> DataFrame:
    """root_id, page_id, ord, text, href of all links in the list item closest to each root (else in its parent), without the root itself.

    roots: root_id, page_id, node_id, text, href (absolute), as page_links gives them. The roots of a page meet its row
    once; ord counts all links of the page.
    """
    asked = roots.groupBy("page_id").agg(F.collect_list(F.struct("root_id", "node_id", F.col("text").alias("root_text"), F.col("href").alias("root_href"))).alias("roots"))
    link = lambda n, i: F.struct(i.alias("ord"), n.node_id.alias("node_id"), n.href.alias("href"), _label(n).alias("text"))

    def inside(root: Column, links: Column) -> Column:
        own = F.get("nodes", root.node_id)
        box = html.node_at(F.when(own.item >= 0, own.item).otherwise(own.parent))
        found = lambda b: F.filter(links, lambda x: (x.node_id > b.node_id) & (x.node_id <= b.last) & (x.text != ""))
        return F.transform(_let(box, found), lambda x: F.struct(root.root_id.alias("root_id"), root.root_text.alias("root_text"), root.root_href.alias("root_href"), x.ord.alias("ord"), x.text.alias("text"), x.href.alias("href")))

    found = _let(F.transform(_links(False), link), lambda links: F.flatten(F.transform("roots", lambda r: F.coalesce(inside(r, links), F.slice(inside(r, links), 1, 0)))))
    rows = shredded.join(asked.hint("merge"), "page_id").select("page_id", "url", F.explode(found).alias("n")).select("page_id", "url", "n.*")
    return _resolved(rows, False).where("not (href = root_href and text = root_text)").select("root_id", "page_id", "ord", "text", "href")


def region_text() -> Column:
    """The text of a page's main element, else of its body, else all that it shows."""
    return F.coalesce(html.node_text(html.node_at(F.col("region.first"))), F.trim("shown"))


def _details() -> list[Column]:
    """What a record takes of a page's row, from headings, labelled lines and embedded JSON."""
    label = lambda kind: text.find_label(F.col("lines"), [pages.ANY + p for p in lexicon.LABELS[kind]])
    h1 = F.get(F.filter("nodes", lambda n: n.tag == "h1"), F.lit(0))
    summary = text.summary(F.col("lines"), lexicon.SUMMARY_HEADING, lexicon.SUMMARY_STOP)
    return [
        F.coalesce(html.node_text(h1), F.lit("")).alias("h1"), F.array_join("lines", "\n").alias("body_text"),
        label("price").alias("dom_price"), label("stock").alias("stock"), label("accessories").alias("accessories"), label("warranty").alias("warranty"), label("bundle").alias("bundle"),
        F.coalesce(F.nullif(summary, F.lit("")), F.array_join("table_rows", " | ")).alias("summary"), text.matching_lines(F.col("lines"), lexicon.CONDITIONS).alias("rental_conditions"),
        jsonld.product_fields(F.col("jsonld")).alias("p"),
    ]


def _first_details(rows: DataFrame) -> DataFrame:
    return pages.first_by(rows, ["url"], ["page_id"]).select("*", "p.*").drop("p", "page_id")


def detail_rows(shredded: DataFrame) -> DataFrame:
    """What records.details takes of every page: one row a canonical URL, from headings, labelled lines and embedded JSON.

    Without a summary section the table rows are the summary. error is that of the page, if it could not be read.
    """
    return _first_details(shredded.select("page_id", url.canonical("url").alias("url"), "error", *_details()))


def products(shredded: DataFrame) -> DataFrame:
    """page_id, url and the fields of the first product of every page's embedded JSON."""
    return shredded.select("page_id", "url", jsonld.product_fields(F.col("jsonld")).alias("p")).select("page_id", "url", "p.*")


def from_pages(corpus: DataFrame, seeds: DataFrame, checkpoint, most: int = pages.MOST_VISITED, start_url: str = "", gates: bool = False) -> dict[str, DataFrame]:
    """From pages at rest (page_id, url, html) and seeds (ord, url, intent, label) to crawled, products, records and audit.

    Catalog pages are those that pagination reaches from the seeds; every product on them belongs to the first page
    visited that shows it, and its record comes of its own page. The audit's numbers are observed while the tables are
    written. gates: raise as soon as there are no seeds, catalogs are not complete, or there are no products.
    """
    began = time.monotonic()
    spark = corpus.sparkSession
    seen = []

    def kept(rows: DataFrame, what: str) -> DataFrame:
        rows, counts = records.observed(rows, what)
        seen.append(counts)
        return checkpoint(rows, what)

    seeds = kept(seeds, "roots")
    # all that a run takes of a page is found in its row as it is shredded, so that its elements are not kept
    declared = text.declared_pages(region_text()).alias("n")
    read = html.shred(corpus).select("page_id", "url", url.canonical("url").alias("page_url"), "error", declared, _cards(True).alias("cards"), F.struct(*_details()).alias("details"))
    read = checkpoint(read, "read")
    titled = checkpoint(_card_rows(read).withColumn("page_url", url.canonical("url")), "cards")
    turns = titled.where(~F.lower("title").isin(lexicon.NAVIGATION_TITLES)).select("page_url", "ord", "href")
    edges = pages.turned(read.select("page_url", "n"), turns)
    order = F.coalesce(url.parameter("next_url", "page"), url.parameter("next_url", "p")).try_cast("int")
    edges = checkpoint(edges.select(F.col("page_url").alias("url"), F.coalesce(order, F.lit(0)).alias("ord"), "next_url"), "edges")
    loaded = checkpoint(read.where("error is null").select(F.col("page_url").alias("url")).distinct(), "loaded")  # met by every wave
    crawled = pages.crawl(seeds, edges, loaded, checkpoint, most)
    crawled = kept(pages.with_unfollowed(crawled, edges, checkpoint), "crawled")
    visits = crawled.where("status = 'visited'").select(F.col("url").alias("page_url"), "intent", F.struct("wave", "rank").alias("visit_rank"))
    listed = titled.select("page_url", "ord", "href", "title", "card").join(visits.select("page_url", "intent"), "page_url")
    products = pages.owned_products(pages.page_products(listed), visits.select("page_url", "visit_rank"))
    products = kept(products.select(F.col("product_url").alias("url"), "title", "intent", "catalog_url", "price_text"), "products")
    if gates:
        records.checked(seeds, crawled, products)
    details = _first_details(read.select("page_id", F.col("page_url").alias("url"), "error", "details.*"))
    made = kept(records.details(products, details), "records")
    audit = records.audit_of(spark, start_url, seen, int(time.monotonic() - began + 0.5))
    return {"crawled": crawled, "products": products, "records": made, "audit": audit}
