"""What a site is and where its catalogs start: site mode, menu ranking, roots, root links, seeds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions import lexicon, rules, text, url
from brindle.sources import html

MENU_MOST, ROOTS_MOST, SURE, ELEMENTS_MOST = 25, 15, 100, 600
CONVENTIONAL_SCORE = 80


def mode_of(rental, second_hand, new_camera):
    """The decision table of a site's mode, from its three findings."""
    return (
        F.when(rental & (second_hand | new_camera), "MIXED")
        .when(second_hand & new_camera, "SALE_MIXED")
        .when(rental, "RENTAL")
        .when(second_hand, "SALE_SECOND_HAND")
        .when(new_camera, "SALE_NEW")
        .otherwise("UNKNOWN")
    )


def site_modes(pages: DataFrame, nodes: DataFrame) -> DataFrame:
    """page_id, rental, second_hand, new_camera, site_mode of every page.

    pages: page_id, visible_text; nodes: page_id, ord, text, aria_label, title (an observation's, a few hundred at
    most; without ord they are read in order of their text). The rules are tried on all of a page's nodes in order
    and then its text, as one text.
    """
    nodes = nodes if "ord" in nodes.columns else nodes.withColumn("ord", F.lit(0))
    raw = F.concat_ws(" ", F.coalesce("text", F.lit("")), F.coalesce("aria_label", F.lit("")), F.coalesce("title", F.lit("")))
    menus = nodes.select("page_id", "ord", raw.alias("raw")).groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("ord", "raw"))).alias("n"))
    texts = pages.select("page_id", "visible_text").join(menus.select("page_id", F.col("n.raw").alias("n")), "page_id", "full")
    return _modes(texts)


def page_modes(shredded: DataFrame) -> DataFrame:
    """The same of shredded pages, by what they show: each in its own row."""
    raw = F.transform(html.controls(), lambda n: F.concat_ws(" ", n.text, n.aria_label, n.title))
    return _modes(shredded.select("page_id", raw.alias("n"), html.shown_text().alias("visible_text")))


def _modes(texts: DataFrame) -> DataFrame:
    """Modes of rows page_id, n (texts of nodes), visible_text."""
    found = texts.select("page_id", text.fold(F.concat_ws("\n", "n", "visible_text")).alias("text"))
    found = found.select("page_id", *[rules.holds(r).alias(r.label) for r in lexicon.SITE])
    return found.withColumn("site_mode", mode_of(F.col("rental"), F.col("second_hand"), F.col("new_camera")))


def menu_scores(nodes: DataFrame) -> DataFrame:
    """nodes (text, aria_label, title, ...) with score and intent, all of them."""
    folded = nodes.withColumn("_raw", F.col("text")).withColumn("text", text.fold(F.concat_ws(" ", "text", "aria_label", "title")))
    scored = folded.withColumns({"score": rules.score(lexicon.MENU), "intent": rules.first_label(lexicon.MENU_INTENT, "CAMERA_GENERIC")})
    return scored.withColumn("text", F.col("_raw")).drop("_raw")


def sure_candidates(menu: DataFrame) -> DataFrame:
    """Menu candidates whose score is that of an explicit catalog root."""
    return menu.where(F.col("score") >= SURE)


def menu_candidates(nodes: DataFrame, most: int = MENU_MOST) -> DataFrame:
    """Of each page the best nodes with a score over 0, by score and then by place (page_id, ord)."""
    rank = F.row_number().over(Window.partitionBy("page_id").orderBy(F.desc("score"), "ord"))
    return menu_scores(nodes).where("score > 0").withColumn("rank", rank).where(F.col("rank") <= most)


def generic_roots(links: DataFrame, pages: DataFrame, most: int = ROOTS_MOST) -> DataFrame:
    """Likely catalog roots of rental sites: the best links of each page, then conventional paths, each URL once.

    links: page_id, ord, text, href (absolute); pages: page_id, url.
    """
    near = links.join(pages.select("page_id", F.col("url").alias("page_url")), "page_id")
    near = near.where((url.origin("href") == url.origin("page_url")) & (url.path("href") != "/"))
    folded = near.withColumn("label", F.col("text")).withColumn("text", text.fold("text"))
    folded = folded.withColumn("place", text.fold(F.concat_ws(" ", "text", F.translate(url.path("href"), "-_/", "   "))))
    scored = folded.withColumn("score", rules.score(lexicon.ROOTS)).where("score > 0")
    rank = F.row_number().over(Window.partitionBy("page_id").orderBy(F.desc("score"), "ord"))
    best = scored.withColumn("rank", rank).where(F.col("rank") <= most).select("page_id", "rank", F.col("label").alias("text"), "href", "score")
    paths = F.posexplode(F.array(*[F.lit(p) for p in lexicon.CONVENTIONAL_PATHS]))
    usual = pages.select("page_id", "url", paths.alias("i", "text")).select("page_id", (F.col("i") + most + 1).alias("rank"), "text", url.resolve("text", "url").alias("href"), F.lit(CONVENTIONAL_SCORE).alias("score"))
    first = F.row_number().over(Window.partitionBy("page_id", "href").orderBy("rank"))
    return best.unionByName(usual).withColumn("_r", first).where("_r = 1").drop("_r")


def synthetic_nodes(links: DataFrame) -> DataFrame:
    """links (page_id, text, href) that no page showed, as nodes: without role, labels or room."""
    none, zero = F.lit(""), F.lit(0)
    number = F.row_number().over(Window.partitionBy("page_id").orderBy("href", "text"))
    made = links.select("page_id", "text", "href").withColumn("id", F.concat(F.lit("s"), number))
    return made.select("page_id", "id", F.lit("a").alias("tag"), "text", none.alias("role"), "href", none.alias("aria_label"), none.alias("title"), *[zero.alias(c) for c in ("x", "y", "width", "height")])


def resolve_roots(candidates: DataFrame, links: DataFrame, pages: DataFrame) -> DataFrame:
    """candidate_id, href: a candidate's own link, else the best link of its page by text, place and path.

    candidates: candidate_id, page_id, text, href; links: page_id, ord, text, title, aria_label, href. The first
    of equally good links wins; '' if none scores over 0.
    """
    own = candidates.where("href <> ''").select("candidate_id", "href")
    open_ = candidates.where("coalesce(href, '') = ''").select("candidate_id", "page_id", text.fold("text").alias("want"))
    near = links.join(pages.select("page_id", "url"), "page_id").select("page_id", "ord", "href", "url", text.fold("text").alias("t"), text.fold("title").alias("title"), text.fold("aria_label").alias("aria"))
    near = near.withColumn("base", F.when(url.origin("href") == url.origin("url"), 50).otherwise(0) + F.when(url.path("href") != "/", 30).otherwise(0) + F.when(F.lower(url.path("href")).rlike(lexicon.BAD_ROOT_PATH), -200).otherwise(0))
    want = F.col("want")
    match = F.when(F.col("t") == want, 300).otherwise(0) + F.when(F.col("title") == want, 150).otherwise(0) + F.when(F.col("aria") == want, 150).otherwise(0) + F.when(F.col("t").contains(want), 40).otherwise(0)
    scored = open_.join(near, "page_id").withColumn("score", match + F.col("base")).where("score > 0")
    best = scored.withColumn("_r", F.row_number().over(Window.partitionBy("candidate_id").orderBy(F.desc("score"), "ord"))).where("_r = 1")
    found = open_.select("candidate_id").join(best.select("candidate_id", "href"), "candidate_id", "left").fillna("", ["href"])
    return own.unionByName(found)


GRID = 60


def _keys(text_: Column, href: Column, label: Column) -> Column:
    """A key for each set of things that two elements may have in common besides their place, and one that all have."""
    parts = [("t", text_, F.lit(True)), ("h", href, href != ""), ("l", label, label != "")]
    out = [F.lit("first")]
    for bits in range(1, 1 << len(parts)):
        some = [p for i, p in enumerate(parts) if bits >> i & 1]
        ok = reduce(lambda x, y: x & y, [p[2] for p in some])
        out.append(F.when(ok, F.to_json(F.array(F.lit("".join(p[0] for p in some)), *[p[1] for p in some]))))
    return F.array_compact(F.array(*out))


def match_elements(nodes: DataFrame, elements: DataFrame) -> DataFrame:
    """node_id, element_id, score: the element of the same page most like each observed node.

    Both have page_id, text, href, aria_label, x, y. Text 120, link 220, label 80, place 80 (within 10) or 30
    (within 60); the first of the best wins, at score 0 too. Of a page's elements the first ELEMENTS_MOST count.

    Pairs are not formed: a node meets the first element with each set of its text, link and label, the first of the
    page, and the elements of the nine cells around it on a grid. An element with more in common is the first of a
    larger set, or one of those cells.
    """
    first = F.row_number().over(Window.partitionBy("page_id").orderBy("element_id"))
    elements = elements.withColumn("_e", first).where(F.col("_e") <= ELEMENTS_MOST)
    side = lambda df, key: df.select("page_id", F.col(key).alias("key"), text.light("text").alias("t"), F.coalesce("href", F.lit("")).alias("h"), text.light("aria_label").alias("l"), "x", "y")
    a, b = side(nodes, "node_id"), side(elements, "element_id")
    cell = lambda c: F.floor(F.col(c) / GRID)
    place = lambda dx, dy: F.concat_ws(",", F.lit("place"), cell("x") + dx, cell("y") + dy)
    around = F.array(*[place(dx, dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1)])
    own = F.struct("key", "t", "h", "l", "x", "y").alias("e")
    common = _keys(F.col("t"), F.col("h"), F.col("l"))
    firsts = b.select("page_id", own, F.explode(common).alias("k")).groupBy("page_id", "k").agg(F.min("e").alias("e"))
    near = b.select("page_id", place(0, 0).alias("k"), own)
    asked = a.withColumn("k", F.explode(F.concat(common, around)))
    pairs = asked.join(firsts.unionByName(near), ["page_id", "k"])
    far = F.abs(F.col("e.x") - F.col("x")) + F.abs(F.col("e.y") - F.col("y"))
    score = (
        F.when(F.col("t") == F.col("e.t"), 120).otherwise(0)
        + F.when((F.col("h") != "") & (F.col("h") == F.col("e.h")), 220).otherwise(0)
        + F.when((F.col("l") != "") & (F.col("l") == F.col("e.l")), 80).otherwise(0)
        + F.when(far < 10, 80).when(far < 60, 30).otherwise(0)
    )
    best = pairs.groupBy(F.col("key").alias("node_id")).agg(F.max_by("e.key", F.struct(score, -F.col("e.key"))).alias("element_id"), F.max(score).alias("score"))
    return best.select("node_id", "element_id", "score")


def submenu_items(before: DataFrame, after: DataFrame) -> DataFrame:
    """page_id, text, href seen after and not before, each once; text or link must not be empty."""
    key = lambda df: df.select("page_id", "ord", text.clean("text").alias("text"), "href", F.concat(text.light("text"), F.lit("|"), "href").alias("k")).where("text <> '' and href <> ''")
    # never by way of the driver: what shredded pages hold is far more than Spark takes it for
    new = key(after).join(key(before).select("page_id", "k").distinct().hint("merge"), ["page_id", "k"], "left_anti")
    return new.groupBy("page_id", "k").agg(F.min_by(F.struct("text", "href"), "ord").alias("i")).select("page_id", "i.text", "i.href")


def submenu(structural: DataFrame, before: DataFrame, after: DataFrame, structural_after: DataFrame | None = None) -> DataFrame:
    """page_id, text, href, method of a root's submenu: the structural children (see extract.children), and those that
    are there after it was opened (structural_after), each once; a page without any has what is seen after and not before."""
    structural = structural.withColumn("ord", F.struct(F.lit(0).alias("turn"), "ord"))
    if structural_after is not None:
        structural = structural.unionByName(structural_after.withColumn("ord", F.struct(F.lit(1).alias("turn"), "ord")))
    key = F.concat(text.light("text"), F.lit("|"), "href").alias("k")
    inside = structural.where("text <> '' and href <> ''").select("page_id", "ord", "text", "href", key).groupBy("page_id", "k").agg(F.min_by(F.struct("text", "href"), "ord").alias("i"))
    inside = inside.select("page_id", "i.text", "i.href", F.lit("DOM_CHILDREN").alias("method"))
    seen = submenu_items(before, after).join(inside.select("page_id").distinct().hint("merge"), "page_id", "left_anti")
    return inside.unionByName(seen.withColumn("method", F.lit("VISIBLE_DIFF")))


def select_seeds(explicit: DataFrame, generic: DataFrame, modes: DataFrame) -> DataFrame:
    """site, url, intent, label: accepted explicit roots, each URL once; without any, a rental site's best generic root.

    explicit and generic: site, ord, url, intent, label, accepted; modes: site, site_mode.
    """
    first = F.row_number().over(Window.partitionBy("site", "url").orderBy("ord"))
    sure = explicit.where("accepted").withColumn("_r", first).where("_r = 1").select("site", "url", "intent", "label")
    best = F.row_number().over(Window.partitionBy("site").orderBy("ord"))
    fallback = generic.where("accepted").join(modes.where("site_mode = 'RENTAL'").select("site"), "site").join(sure.select("site").distinct(), "site", "left_anti")
    return sure.unionByName(fallback.withColumn("_r", best).where("_r = 1").select("site", "url", "intent", "label"))
