"""Catalog pages: links, products, pagination, probes, and the crawl over pages at rest."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions import lexicon, text, url

ANY = "(?iu)"
CARD_LEVELS, CARD_CHARS, CARD_LINKS = 7, 1400, 10
MOST_VISITED, MOST_WAVES = 2000, 1000


#: A link by pattern, the same for Java and RE2: with an href in quotes of either kind or none, and an end tag.
ANCHOR = r"""(?is)<a\s(?:[^>]*?\s)?href\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+)[^>]*>(.*?)</a>"""
QUOTES = """^["']|["']$"""


def anchors(pages: DataFrame, outer: bool = False) -> DataFrame:
    """page_id, url, ord, href (absolute), text of every link of pages (page_id, url, html), by pattern alone: of links
    with an end tag (extract.page_links has all). outer: one row, with a null ord, for pages without links."""
    tags = F.regexp_extract_all("html", F.lit(ANCHOR), F.lit(0))
    found = pages.select("page_id", "url", (F.posexplode_outer if outer else F.posexplode)(tags).alias("ord", "tag"))
    href = F.regexp_replace(F.regexp_extract("tag", ANCHOR, 1), QUOTES, "")
    return found.select("page_id", "url", "ord", url.resolve(href, "url").alias("href"), text.clean(F.regexp_replace(F.regexp_replace("tag", r"(?is)^<a\s[^>]*>|</a>$", ""), "<[^>]*>", "")).alias("text"))


def product_verdicts(links: DataFrame) -> DataFrame:
    """links (href, title, card) with navigation, product and price_text."""
    title, place = F.col("title"), url.path("href")
    product = (
        ~F.lower(place).rlike(lexicon.BAD_PATH) & ~url.is_pagination("href") & ~title.rlike(ANY + lexicon.ACCESSORY_TITLE)
        & title.rlike(ANY + lexicon.BRANDS) & title.rlike(ANY + lexicon.MODELS)
        & (F.col("card").rlike(text.PRICE) | F.col("card").rlike(ANY + lexicon.COMMERCIAL))
    )
    return links.withColumns({"navigation": F.lower(title).isin(lexicon.NAVIGATION_TITLES), "price_text": text.price_text("card")}).withColumn("product", product & ~F.col("navigation"))


def first_by(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One row of each key: the first by the order."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_r = 1").drop("_r")


def page_products(links: DataFrame) -> DataFrame:
    """Products of each page, each canonical URL once, without the page itself (page_url, ord, href, title, card, intent)."""
    rows = product_verdicts(links).where("product").withColumn("product_url", url.canonical("href")).where(F.col("product_url") != url.canonical("page_url"))
    return first_by(rows, ["page_url", "product_url"], ["ord"]).select("page_url", "product_url", "title", "intent", url.canonical("page_url").alias("catalog_url"), "price_text", "ord")


def owned_products(products: DataFrame, visits: DataFrame) -> DataFrame:
    """Every product once, with what the first visited page says. visits: page_url, visit_rank."""
    return first_by(products.join(visits, "page_url"), ["product_url"], ["visit_rank", "ord"])


def page_parameter(links: DataFrame) -> DataFrame:
    """page_url, parameter: how the page's pagination links number pages; the first one tells."""
    named = links.where(url.is_strict_pagination("href", "page_url")).withColumn("parameter", F.when(url.parameter("href", "page").isNotNull(), "page").otherwise("p"))
    return named.groupBy("page_url").agg(F.min_by("parameter", "ord").alias("parameter"))


def page_sequence(pages: DataFrame, links: DataFrame) -> DataFrame:
    """page_url, next_url: pages 2 to the declared number, and the pagination links of the page; each once.

    pages: page_url, region_text; links: page_url, ord, href.
    """
    return turned(pages.select("page_url", text.declared_pages("region_text").alias("n")), links)


def turned(declared: DataFrame, links: DataFrame) -> DataFrame:
    """page_sequence of pages whose declared number n is known (page_url, n). Only those that declare several meet the links."""
    spark = declared.sparkSession
    # their rows are few and small, and would all come to one task, which makes several URLs of each
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    known = declared.where("n > 1").repartition(parts, "page_url").join(page_parameter(links), "page_url", "left").fillna("p", ["parameter"])
    base = url.canonical(F.concat(url.origin("page_url"), url.path("page_url"), F.lit("?"), F.array_join(F.filter(F.split(url.query("page_url"), "&"), lambda x: ~F.substring_index(x, "=", 1).isin(url.PAGE_PARAMETERS) & (x != "")), "&")))
    made = known.select("page_url", "parameter", base.alias("base"), F.explode(F.sequence(F.lit(2), F.col("n"))).alias("k"))
    join = F.when(F.col("base").contains("?"), "&").otherwise("?")
    made = made.select("page_url", url.canonical(F.concat("base", join, "parameter", F.lit("="), "k")).alias("next_url"))
    seen = links.where(url.is_strict_pagination("href", "page_url")).select("page_url", url.canonical("href").alias("next_url"))
    return made.unionByName(seen).distinct().where(F.col("next_url") != url.canonical("page_url"))


def probes(candidates: DataFrame, pages: DataFrame, links: DataFrame) -> DataFrame:
    """candidate_id, url, intent, product_like_links, pagination_links, accepted, reason.

    candidates: candidate_id, url, intent; pages: url, title, body; links: url, href, text, near (text around).
    """
    brand, price = F.concat_ws(" ", "text", "near").rlike(ANY + lexicon.BRANDS), F.col("near").rlike(text.PRICE)
    turn = F.lower(text.clean("text")).isin(lexicon.PAGE_WORDS) | text.is_digits(text.clean("text")) | url.query("href").rlike("(^|&)(p|page)=[0-9]") | url.path("href").rlike("/page/[0-9]+")
    link = url.without_fragment("href")
    counts = links.groupBy("url").agg(F.count_distinct(F.when(brand & price, link)).alias("product_like_links"), F.count_distinct(F.when(turn, link)).alias("pagination_links"))
    seen = candidates.join(pages, "url", "left").join(counts, "url", "left").fillna(0, ["product_like_links", "pagination_links"])
    body = text.fold(F.concat_ws(" ", "title", "body"))
    fits = F.lit(True)
    for intent, pattern in lexicon.INTENT_EVIDENCE.items():
        fits = F.when(F.col("intent") == intent, F.col("folded").rlike(pattern)).otherwise(fits)
    seen = seen.withColumn("folded", body).withColumns({"intent_ok": fits, "camera_ok": F.col("folded").rlike(lexicon.CAMERA_EVIDENCE), "shop_ok": F.col("product_like_links") > 0})
    reason = F.concat_ws("; ", *[F.concat(F.lit(f"{k}="), F.col(f"{k}_ok").cast("string")) for k in ("camera", "shop", "intent")])
    return seen.select("candidate_id", "url", "intent", "product_like_links", "pagination_links", (F.col("intent_ok") & F.col("camera_ok") & F.col("shop_ok")).alias("accepted"), reason.alias("reason"))


def numbered(rows: DataFrame, order: list[str], checkpoint) -> DataFrame:
    """rows with rank, 0, 1, 2, ... by the order: sorted in ranges, each range counted, offsets of ranges added."""
    ranges = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    ids = checkpoint(ranges.withColumn("_id", F.monotonically_increasing_id()), "numbered")
    part, place = F.shiftright("_id", 33), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = ids.groupBy(part.alias("part")).count().collect()  # one row a range
    offsets, n = [], 0
    for r in sorted(sizes, key=lambda r: r["part"]):
        offsets.append((r["part"], n))
        n += r["count"]
    if not offsets:
        return ids.withColumn("rank", F.col("_id")).drop("_id")
    offset = F.create_map(*[F.lit(x).cast("long") for pair in offsets for x in pair])[part]
    return ids.withColumn("rank", offset + place).drop("_id")


def openable(loaded: DataFrame) -> DataFrame:
    """url, _open of pages that open; of a corpus laid out by URL (sources/corpus.py) this moves no row."""
    return loaded.select("url").distinct().withColumn("_open", F.lit(True))


def crawl(seeds: DataFrame, edges: DataFrame, loaded: DataFrame, checkpoint, most: int = MOST_VISITED, waves: int = MOST_WAVES) -> DataFrame:
    """url, intent, rank, wave, status (visited, failed or queued) of a breadth-first crawl from the seeds.

    seeds: ord, url, intent; edges: url, ord, next_url; loaded: url of pages that open. A page takes the intent
    of the page that first leads to it (seeds: of the last seed with its URL). Each wave is ranked by the rank of
    that page and the link's ord, then by URL. The first `most` pages that open are visited; what comes after
    the last of them in its wave is queued. Links that no wave has followed are no rows here: with_unfollowed
    adds them, which audits and coverage need. checkpoint(df, name) cuts lineage. The state is kept as Parts, each wave
    written as it comes.
    """
    edges = checkpoint(edges.where("next_url <> url").groupBy("url", "next_url").agg(F.min("ord").alias("ord")), "edges")  # read by every wave
    opens = openable(loaded)
    front = seeds.withColumn("url", url.canonical("url")).groupBy("url").agg(F.max_by("intent", "ord").alias("intent"), F.min("ord").alias("_o"))
    front = numbered(front.withColumn("wave", F.lit(0)), ["_o", "url"], checkpoint).drop("_o")
    parts, visited = Parts(front.where("false").select("url", "intent", "rank", "wave", F.lit("queued").alias("status")), checkpoint), 0
    for wave in range(waves):
        if front.isEmpty():
            break
        seen = front.join(opens, "url", "left")
        open_ = seen.where("_open")
        count = [F.count(F.lit(1)).alias("n"), F.max("rank").alias("last")]
        fits = open_.agg(*count).first()
        if fits["n"] > most - visited:  # else the wave is taken whole
            fits = open_.orderBy("rank").limit(most - visited).agg(*count).first()
        visited += fits["n"]
        # a wave that does not fill the bound is taken whole, with failed pages behind the last that opens
        last = F.lit(2**63 - 1 if visited < most else -1 if fits["last"] is None else fits["last"]).cast("long")
        status = F.when(F.col("rank") > last, "queued").when(F.col("_open"), "visited").otherwise("failed")
        now = parts.add(seen.select("url", "intent", "rank", "wave", status.alias("status")))
        if visited >= most:
            break
        front = _next(now, parts.all(), edges, checkpoint)
    return parts.all()


class Parts:
    """A table that grows by parts. Each is written once when it comes; as soon as MERGED of about one size are there,
    they are written together, so that a row is written a few times over however many parts there are."""

    MERGED = 8

    def __init__(self, empty: DataFrame, checkpoint) -> None:
        self.empty, self.checkpoint = empty, checkpoint
        self.levels: list[list[DataFrame]] = [[]]

    def add(self, rows: DataFrame) -> DataFrame:
        """The part as written."""
        part = self.checkpoint(rows, "state")
        self.levels[0].append(part)
        for k in range(len(self.levels)):
            if len(self.levels[k]) < self.MERGED:
                break
            merged = self.checkpoint(reduce(DataFrame.unionByName, self.levels[k]), "state")
            self.levels[k] = []
            self.levels += [[]] * (k + 1 == len(self.levels))
            self.levels[k + 1].append(merged)
        return part

    def all(self) -> DataFrame:
        return reduce(DataFrame.unionByName, [p for level in reversed(self.levels) for p in level], self.empty)


def _next(rows: DataFrame, state: DataFrame, edges: DataFrame, checkpoint) -> DataFrame:
    """url, intent, rank, wave of the links of visited rows that are not in the state."""
    new = rows.where("status = 'visited'").join(edges, "url").join(state.select(F.col("url").alias("next_url")), "next_url", "left_anti")
    place = F.struct("wave", "rank", "ord")
    new = new.groupBy("next_url").agg(F.min_by("intent", place).alias("intent"), F.min(place).alias("_o"))
    new = new.select(F.col("next_url").alias("url"), "intent", "_o", (F.col("_o.wave") + 1).alias("wave"))
    return numbered(new, ["_o", "url"], checkpoint).drop("_o")


def with_unfollowed(state: DataFrame, edges: DataFrame, checkpoint) -> DataFrame:
    """The rows of a crawl, and, as queued, all links of its visited pages that `most` or `waves` kept it from."""
    edges = edges.where("next_url <> url").groupBy("url", "next_url").agg(F.min("ord").alias("ord"))
    return state.unionByName(_next(state, state, edges, checkpoint).withColumn("status", F.lit("queued")))
