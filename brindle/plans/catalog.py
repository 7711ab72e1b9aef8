"""Named queries over page corpora, each with the SQL that DuckDB runs for comparison.

Queries named q_page_*, q_anchor_*, q_host_*, q_text_* and q_lines_* run over the whole tables of a data folder, those
of values, labels, texts, nodes and links over whole tables and, with negative ids, over the odd rows of fixtures.py.
The others run over camera shops made of part, supplier and lineitem (shops.py), and over the odd rows too.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions import lexicon, rules, text, url
from brindle.operators import extract, pages, records, site
from brindle.plans import shops
from brindle.plans.fixtures import ALL, TABLES, frame, literal
from brindle.sources import html

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

WS = text.WS
q = rules.quoted
CLEAN = lambda c: f"trim(regexp_replace(coalesce({c}, ''), {q(WS)}, ' ', 'g'))"
FOLD = lambda c: f"trim(regexp_replace(lower(translate(strip_accents(coalesce({c}, '')), 'đĐ', 'dD')), {q(WS)}, ' ', 'g'))"
MONEY = lambda c: f"nullif(TRY_CAST(nullif(regexp_replace(coalesce({c}, ''), '[^0-9]', '', 'g'), '') AS DOUBLE), 0)"
NUM = lambda c: f"CASE WHEN regexp_matches(trim(coalesce({c}, '')), {q(text.NUMBER)}) THEN TRY_CAST(trim({c}) AS DOUBLE) END"
HOST = lambda c: f"regexp_replace(regexp_extract(lower(coalesce({c}, '')), '^[a-z][a-z0-9+.-]*://([^/?#@]*@)?([^/?#:]+)', 2), '^www\\.', '')"
ORIGIN = lambda c: f"regexp_replace(regexp_replace(lower(regexp_extract(coalesce({c}, ''), '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1)), '^(http://.*):80$', '\\1'), '^(https://.*):443$', '\\1')"
PATH = lambda c: f"coalesce(nullif(regexp_extract(coalesce({c}, ''), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), ''), '/')"
QUERY = lambda c: f"regexp_extract(coalesce({c}, ''), '^[^?#]*\\?([^#]*)', 1)"
PARAM = lambda c, n: f"CASE WHEN regexp_matches('&' || {QUERY(c)}, '&{n}(=|&|$)') THEN regexp_extract('&' || {QUERY(c)}, '&{n}(=([^&]*)|&|$)', 2) END"


def CANONICAL(c: str) -> str:
    names = ", ".join(map(q, url.TRACKING))
    kept = f"list_filter([CASE WHEN contains(x, '=') THEN x ELSE x || '=' END FOR x IN string_split({QUERY(c)}, '&') IF x <> ''], lambda x: split_part(x, '=', 1) NOT IN ({names}))"
    for p in url.PAGE_PARAMETERS:
        kept = f"CASE WHEN coalesce({PARAM(c, p)} = '1', false) THEN list_filter({kept}, lambda x: split_part(x, '=', 1) <> '{p}') ELSE {kept} END"
    ordered = f"(SELECT coalesce(string_agg(x, '&' ORDER BY split_part(x, '=', 1), i), '') FROM (SELECT unnest(k) AS x, generate_subscripts(k, 1) AS i FROM (SELECT {kept} AS k)))"
    return f"CASE WHEN regexp_matches(coalesce({c}, ''), '(?i)^https?://[^/?#]') THEN {ORIGIN(c)} || {PATH(c)} || (SELECT CASE WHEN s = '' THEN '' ELSE '?' || s END FROM (SELECT {ordered} AS s)) ELSE coalesce({c}, '') END"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def DOTLESS(c: str) -> str:
    """A path without '.' and '..' steps (six of the latter at most), by rewriting its text."""
    out = f"regexp_replace(regexp_replace({c}, '(/\\.)+(/|$)', '/', 'g'), '(/\\.)+(/|$)', '/', 'g')"
    for _ in range(6):
        out = f"regexp_replace({out}, '(^|/([^/.][^/]*|\\.[^/.][^/]*|\\.\\.[^/]+))/\\.\\.(/|$)', '/')"
    return out


def RESOLVE(raw: str, page: str) -> str:
    head, tail = f"regexp_extract({raw}, '^[^?#]*')", f"substr({raw}, length(regexp_extract({raw}, '^[^?#]*')) + 1)"
    return f"""CASE WHEN regexp_matches({raw}, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN {raw} WHEN {raw} = '' OR {raw}[1] = '#' THEN split_part({page}, '#', 1) || {raw} WHEN {raw}[1:2] = '//' THEN split_part({page}, '//', 1) || {raw}
 WHEN {raw}[1] = '?' THEN {ORIGIN(page)} || {PATH(page)} || {raw} WHEN {raw}[1] = '/' THEN {ORIGIN(page)} || {DOTLESS(head)} || {tail} ELSE {ORIGIN(page)} || {DOTLESS(f"regexp_replace({PATH(page)}, '[^/]*$', '') || {head}")} || {tail} END"""


def ANCHORS(source: str) -> str:
    """The links of a table of pages by pattern, as WITH parts a, h and links."""
    return f"""
a AS (SELECT page_id, url, generate_subscripts(tags, 1) - 1 AS ord, unnest(tags) AS tag
      FROM (SELECT page_id, url, regexp_extract_all(html, {q(pages.ANCHOR)}, 0) AS tags FROM {source})),
h AS (SELECT page_id, url, ord, tag, regexp_replace(regexp_extract(tag, {q(pages.ANCHOR)}, 1), {q(pages.QUOTES)}, '', 'g') AS raw FROM a),
links AS (SELECT page_id, url, ord, {RESOLVE("raw", "url")} AS href,
      {CLEAN("regexp_replace(regexp_replace(tag, '(?is)^<a\\s[^>]*>|</a>$', '', 'g'), '<[^>]*>', '', 'g')")} AS text,
      regexp_extract(tag, '^<a [^>]*aria-label="([^"]*)"', 1) AS aria_label, regexp_extract(tag, '^<a [^>]*title="([^"]*)"', 1) AS title FROM h)"""


ANCHOR_SQL = ANCHORS("pages")
SHOWN_BLOCKS = "|".join(sorted(html.BLOCK))


def SHOWN(source: str) -> str:
    """What pages show, as a WITH part shown; elements of class off or in a style attribute of display:none are not seen."""
    text_ = f"regexp_replace(regexp_replace(regexp_replace(html, '(?is)<!--.*?-->|<(head|script|style)[ >].*?</(head|script|style)>|<li class=\"off\">.*?</li>', '', 'g'), '(?i)</?({SHOWN_BLOCKS})([ /][^>]*)?>', ' ', 'g'), '<[^>]*>', '', 'g')"
    for name, char in (("copy", "©"), ("middot", "·"), ("quot", '"'), ("amp", "&")):
        text_ = f"regexp_replace({text_}, '&{name};?', '{char}', 'g')"
    return f"shown AS (SELECT page_id, {CLEAN(text_)} AS body FROM {source})"


SHOWN_SQL = SHOWN("pages")
#: All given pages, and the home pages of the shops.
SITES = f"(SELECT page_id, url, html FROM pages UNION ALL SELECT page_id, url, html FROM {shops.duck_sql(shops.HOMES)} AS s)"
SITE_SQL = f"sites AS {SITES}, {ANCHORS('sites')}, {SHOWN('sites')}"


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages of SITES, shredded."""
    return html.shred(_site_pages(spark, sf_dir))


def _site_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    homes = spark.sql(f"SELECT page_id, url, html FROM {shops.spark_sql(shops.HOMES, sf_dir)} AS s")
    return _pages(spark, sf_dir).select("page_id", "url", "html").unionByName(shops.spread(homes, "page_id"))


# Rows of fixtures under negative ids, then all rows of a table of the data folder, as SQL and as DataFrames.
WHOLE = {
    "values": f"(SELECT (-id)::BIGINT AS id, t FROM {TABLES['values']} UNION ALL SELECT conv_id * 1000 + turn, text FROM conversations)",
    "lines": f"(SELECT (-id)::BIGINT AS id, body FROM {TABLES['lines']} UNION ALL SELECT doc_id, text FROM documents)",
    "texts": f"(SELECT (-id)::BIGINT AS id, title, body FROM {TABLES['texts']} UNION ALL SELECT doc_id, source, text FROM documents)",
    "pages": f"(SELECT (-page_id)::BIGINT AS page_id, url, visible_text FROM {TABLES['pages']} UNION ALL SELECT page_id, url, body[:{html.VISIBLE_MOST}] FROM sites JOIN shown USING (page_id))",
    "nodes": f"(SELECT (-page_id)::BIGINT AS page_id, ord, text, href, aria_label, title FROM {TABLES['nodes']} UNION ALL SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY ord) - 1)::INT, text, href, aria_label, title FROM links WHERE href NOT LIKE '%/ghost')",
    "links": f"(SELECT (-page_id)::BIGINT AS page_id, ord, text, href FROM {TABLES['links']} UNION ALL SELECT page_id, ord, CASE WHEN text = '' THEN title ELSE text END, href FROM links)",
}


def whole(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The rows of WHOLE[name]."""
    key = "page_id" if name in ("pages", "nodes", "links") else "id"
    made = literal(spark, name).withColumn(key, -F.col(key).cast("long"))
    if name == "values":
        return made.unionByName(spark.read.parquet(f"{sf_dir}/conversations.parquet").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("text").alias("t")))
    if name in ("lines", "texts"):
        return made.unionByName(spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("id"), F.col("source").alias("title"), F.col("text").alias("body")).select(made.columns))
    shredded = sites(spark, sf_dir)
    if name == "pages":
        return made.unionByName(html.visible_text(shredded))
    found = html.nodes(shredded).withColumn("href", url.resolve("href", "url")) if name == "nodes" else extract.page_links(shredded, False, False)
    kept = ["page_id", "ord", "text", "href", *(["aria_label", "title"] if name == "nodes" else [])]
    return made.select(kept).unionByName(found.select(kept))


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url of the rows of WHOLE["pages"], which need no shredding."""
    made = literal(spark, "pages").select((-F.col("page_id").cast("long")).alias("page_id"), "url")
    return made.unionByName(_site_pages(spark, sf_dir).select("page_id", "url"))


@query("q_host_page_counts", f"WITH {ANCHOR_SQL} SELECT {HOST('p.url')} AS host, count(DISTINCT p.page_id) AS n_pages, count(DISTINCT l.href) AS n_links FROM pages p LEFT JOIN links l USING (page_id) GROUP BY 1")
def host_page_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages and distinct links of each host."""
    found = pages.anchors(_pages(spark, sf_dir), outer=True)
    counts = found.groupBy(url.host("url").alias("host")).agg(F.count_distinct("page_id").alias("n_pages"), F.count_distinct(F.when(F.col("ord").isNotNull(), F.col("href"))).alias("n_links"))
    return counts


@query("q_page_canonical_url", f"SELECT page_id, {CANONICAL('url')} AS canonical, {HOST('url')} AS host, {ORIGIN('url')} AS origin, {PATH('url')} AS path FROM pages")
def page_canonical_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).select("page_id", url.canonical("url").alias("canonical"), url.host("url").alias("host"), url.origin("url").alias("origin"), url.path("url").alias("path"))


@query("q_url_functions", f"SELECT id, {CANONICAL('u')} AS canonical, {HOST('u')} AS host, {ORIGIN('u')} AS origin, {PATH('u')} AS path, {PARAM('u', 'p')} AS p, split_part(coalesce(u, ''), '#', 1) AS plain FROM {ALL['urls']}")
def url_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = frame(spark, sf_dir, "urls")
    return u.select("id", url.canonical("u").alias("canonical"), url.host("u").alias("host"), url.origin("u").alias("origin"), url.path("u").alias("path"), url.parameter("u", "p").alias("p"), url.without_fragment("u").alias("plain"))


@query("q_page_dedupe_first", f"SELECT page_id, canonical FROM (SELECT page_id, canonical, row_number() OVER (PARTITION BY canonical ORDER BY page_id) AS r FROM (SELECT page_id, {CANONICAL('url')} AS canonical FROM pages)) WHERE r = 1")
def page_dedupe_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = _pages(spark, sf_dir).select("page_id", url.canonical("url").alias("canonical"))
    return keyed.groupBy("canonical").agg(F.min("page_id").alias("page_id")).select("page_id", "canonical")


@query("q_anchor_explode", f"WITH {ANCHOR_SQL} SELECT page_id, ord::INT AS ord, href, text FROM links")
def anchor_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.anchors(_pages(spark, sf_dir)).select("page_id", "ord", "href", "text")


@query("q_anchor_distinct_per_page", f"WITH {ANCHOR_SQL} SELECT page_id, count(DISTINCT lower(text) || '|' || href) AS n_items, count(DISTINCT href) AS n_links FROM links WHERE text <> '' GROUP BY 1")
def anchor_distinct_per_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = pages.anchors(_pages(spark, sf_dir)).where("text <> ''")
    return a.groupBy("page_id").agg(F.count_distinct(F.concat(F.lower("text"), F.lit("|"), "href")).alias("n_items"), F.count_distinct("href").alias("n_links"))


@query("q_page_pagination", f"SELECT page_id, {PARAM('url', 'p')} IS NOT NULL OR {PARAM('url', 'page')} IS NOT NULL OR regexp_matches({PATH('url')}, '/page/[0-9]+') AS pagination, {PARAM('url', 'page')} AS page FROM pages")
def page_pagination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).select("page_id", url.is_pagination("url").alias("pagination"), url.parameter("url", "page").alias("page"))


@query("q_url_resolve", f"SELECT id, {RESOLVE('href', 'page')} AS target FROM (SELECT id, trim(coalesce(href, '')) AS href, page FROM {ALL['hrefs']})")
def url_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, sf_dir, "hrefs").select("id", url.resolve("href", "page").alias("target"))


@query("q_page_links", f"WITH {ANCHOR_SQL} SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY ord) - 1)::INT AS ord, href, text FROM links WHERE {ORIGIN('href')} = {ORIGIN('url')}")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of every page's main region to its own site, from shredded pages; the SQL takes them by pattern."""
    return extract.page_links(html.shred(_pages(spark, sf_dir))).select("page_id", "ord", "href", "text")


@query("q_link_list_items", f"""WITH i AS (SELECT page_id, url, unnest(regexp_extract_all(html, '(?is)<li>(<a\\s[^>]*>.*?</a>)</li>', 1)) AS tag FROM pages)
SELECT page_id, {RESOLVE('raw', 'url')} AS href, item, count(*) AS n FROM (SELECT page_id, url, regexp_extract(tag, 'href="([^"]*)"', 1) AS raw, {CLEAN("regexp_replace(tag, '<[^>]*>', '', 'g')")} AS item FROM i) GROUP BY ALL""")
def link_list_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of the list item nearest to every link of every page: the walk of cards, on another tag."""
    items = extract.nearest(html.shred(_pages(spark, sf_dir)), "li", pages.CARD_LEVELS, "item")
    return items.groupBy("page_id", "href", "item").agg(F.count(F.lit(1)).alias("n"))


LINES_SHOWN = f"regexp_replace(regexp_replace(regexp_replace(translate(html, chr(10), ' '), '(?is)<!--.*?-->|<(head|script|style)[ >].*?</(head|script|style)>', '', 'g'), '(?i)</?({SHOWN_BLOCKS})([ /][^>]*)?>', chr(10), 'g'), '<[^>]*>', '', 'g')"
for _name, _char in (("copy", "©"), ("middot", "·"), ("quot", '"'), ("amp", "&")):
    LINES_SHOWN = f"regexp_replace({LINES_SHOWN}, '&{_name};?', '{_char}', 'g')"
SHREDDED_SQL = f"""SELECT page_id, len(regexp_extract_all(bare, '<[a-zA-Z]'))::INT AS n_nodes, len(regexp_extract_all(bare, '<a '))::INT AS n_interactive, len(lines)::INT AS n_lines, {CLEAN("replace(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), '&amp;', '&')")} AS title, lines[1] AS first_line
FROM (SELECT page_id, html, regexp_replace(html, '(?is)<!--.*?-->|(<script[^>]*>).*?</script>', '\\1', 'g') AS bare, list_filter(list_transform(string_split({LINES_SHOWN}, chr(10)), lambda x: {CLEAN('x')}), lambda x: x <> '') AS lines FROM pages)"""


@query("q_page_shredded", SHREDDED_SQL)
def page_shredded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes, interactive nodes, lines and title of every page, by the HTML shredder."""
    return html.shred(_pages(spark, sf_dir)).select("page_id", F.size("nodes").alias("n_nodes"), F.size(F.filter("nodes", lambda n: n.interactive)).alias("n_interactive"), F.size("lines").alias("n_lines"), "title", F.get("lines", 0).alias("first_line"))


@query("q_text_fold", f"SELECT doc_id, sha256({FOLD('text')}) AS folded, sha256({CLEAN('text')}) AS cleaned FROM documents")
def text_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", F.sha2(text.fold("text"), 256).alias("folded"), F.sha2(text.clean("text"), 256).alias("cleaned"))


@query("q_lines_clean", rf"SELECT doc_id, len(l)::INT AS n_lines, coalesce(l[1], '') AS first_line FROM (SELECT doc_id, list_filter(list_transform(string_split_regex(coalesce(text, ''), '\r?\n'), lambda x: {CLEAN('x')}), lambda x: x <> '') AS l FROM documents)")
def lines_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", text.lines("text").alias("l"))
    return docs.select("doc_id", F.size("l").alias("n_lines"), F.coalesce(F.get("l", 0), F.lit("")).alias("first_line"))


DOC_RULES = [rules.Rule("licence", "t", rules.sub("licen[cs]e", "copyright"), 5), rules.Rule("table", "t", rules.sub(r"\|.*\|"), -3), rules.Rule("contact", "t", rules.sub("@", "tel"), -2), rules.Rule("the", "t", rules.wb("the", "la", "der"), 1)]


@query("q_text_rule_scores", f"SELECT doc_id, ({rules.score_sql(DOC_RULES)})::INT AS score, array_to_string({rules.labels_sql(DOC_RULES)}, ',') AS labels FROM (SELECT doc_id, {FOLD('text')} AS t FROM documents)")
def text_rule_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", text.fold("text").alias("t")).select("doc_id", rules.findings(DOC_RULES).alias("f"))
    return docs.select("doc_id", rules.score(DOC_RULES, F.col("f")).alias("score"), F.array_join(rules.labels(DOC_RULES, F.col("f")), ",").alias("labels"))


PRICE_SQL = lambda c: f"CASE WHEN regexp_extract(coalesce({c}, ''), {q(text.PRICE)}, 0) <> '' THEN regexp_extract({c}, {q(text.PRICE)}, 0) WHEN contains(lower(coalesce({c}, '')), {q(text.CONTACT.lower())}) THEN {q(text.CONTACT)} ELSE '' END"


@query("q_value_functions", f"""SELECT id, {MONEY('t')} AS money, CASE WHEN ({NUM('t')}) BETWEEN 0 AND 5 THEN {NUM('t')} END AS rating, CASE WHEN ({NUM('t')}) >= 0 THEN floor(({NUM('t')}) + 0.5)::BIGINT END AS reviews,
 {PRICE_SQL('t')} AS price, TRY_CAST(nullif(regexp_extract(coalesce(t, ''), '(?i)Page\\s+[0-9]+\\s*/\\s*([0-9]+)', 1), '') AS INT) AS pages, regexp_matches(coalesce(t, ''), '^[0-9]+$') AS digits, {FOLD('t')} AS folded FROM {WHOLE['values']}""")  # fmt: skip
def value_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = whole(spark, sf_dir, "values")
    return v.select("id", text.digits_money("t").alias("money"), text.rating("t").alias("rating"), text.review_count("t").alias("reviews"), text.price_text("t").alias("price"), text.declared_pages("t").alias("pages"), text.is_digits("t").alias("digits"), text.fold("t").alias("folded"))


@query("q_order_prices", "SELECT o_orderkey, nullif(TRY_CAST(regexp_replace(printf('%.2f', o_totalprice), '[^0-9]', '', 'g') AS DOUBLE), 0) AS as_text, CASE WHEN o_totalprice > 0 THEN o_totalprice END AS as_number FROM orders")
def order_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return orders.select("o_orderkey", text.digits_money(F.format_string("%.2f", "o_totalprice")).alias("as_text"), text.number_money("o_totalprice").alias("as_number"))


def _label_sql(kind: str) -> str:
    cases = " ".join(f"WHEN regexp_matches(line, {q('(?i)' + p)}) AND coalesce(nullif(trim(regexp_replace(regexp_replace(line, {q('(?i)' + p)}, ''), '^\\s*[:：-]\\s*', '')), ''), nullif(following, '')) IS NOT NULL THEN coalesce(nullif(trim(regexp_replace(regexp_replace(line, {q('(?i)' + p)}, ''), '^\\s*[:：-]\\s*', '')), ''), following)" for p in lexicon.LABELS[kind])
    return f"(SELECT arg_min(v, i) FROM (SELECT i, CASE {cases} END AS v FROM (SELECT i, line, coalesce(l[i + 1], '') AS following FROM (SELECT unnest(l) AS line, generate_subscripts(l, 1) AS i))) WHERE v IS NOT NULL)"


LINES_SQL = rf"(SELECT id, list_filter(list_transform(string_split_regex(coalesce(body, ''), '\r?\n'), lambda x: {CLEAN('x')}), lambda x: x <> '') AS l FROM {WHOLE['lines']})"


@query("q_find_label", f"SELECT id, {', '.join(f'''coalesce({_label_sql(k)}, '') AS {k}''' for k in lexicon.LABELS)} FROM {LINES_SQL}")
def find_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whole(spark, sf_dir, "lines").select("id", text.lines("body").alias("l"))
    return rows.select("id", *[text.find_label(F.col("l"), ["(?iu)" + p for p in patterns]).alias(k) for k, patterns in lexicon.LABELS.items()])


SUMMARY_SQL = f"""SELECT id, coalesce((SELECT string_agg(line, ' | ' ORDER BY i) FROM u WHERE u.id = f.id AND i > f.head AND i <= f.head + 24 AND i < coalesce((SELECT min(i) FROM u AS s WHERE s.id = f.id AND s.i > f.head AND s.stop), 1000000) AND length(line) <= 280), '') AS summary,
 coalesce((SELECT string_agg(line, ' | ' ORDER BY i) FROM u WHERE u.id = f.id AND cond), '') AS conditions
FROM (SELECT t.id, min(CASE WHEN u.heading THEN u.i END) AS head FROM {LINES_SQL} AS t LEFT JOIN u ON u.id = t.id GROUP BY 1) AS f"""


@query("q_summary_and_conditions", "WITH u AS (SELECT id, line, i, regexp_matches(line, " + q(lexicon.SUMMARY_HEADING.replace("(?iu)", "(?i)")) + ") AS heading, regexp_matches(line, " + q(lexicon.SUMMARY_STOP.replace("(?iu)", "(?i)")) + ") AS stop, regexp_matches(line, " + q(lexicon.CONDITIONS.replace("(?iu)", "(?i)")) + f") AS cond FROM (SELECT id, unnest(l) AS line, generate_subscripts(l, 1) AS i FROM {LINES_SQL})) " + SUMMARY_SQL)
def summary_and_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whole(spark, sf_dir, "lines").select("id", text.lines("body").alias("l"))
    return rows.select("id", text.summary(F.col("l"), lexicon.SUMMARY_HEADING, lexicon.SUMMARY_STOP).alias("summary"), text.matching_lines(F.col("l"), lexicon.CONDITIONS).alias("conditions"))


SITE_CASE = "CASE WHEN rental AND (second_hand OR new_camera) THEN 'MIXED' WHEN second_hand AND new_camera THEN 'SALE_MIXED' WHEN rental THEN 'RENTAL' WHEN second_hand THEN 'SALE_SECOND_HAND' WHEN new_camera THEN 'SALE_NEW' ELSE 'UNKNOWN' END AS site_mode"


MENU_TEXT = f"SELECT page_id, string_agg(coalesce(text, '') || ' ' || coalesce(aria_label, '') || ' ' || coalesce(title, ''), chr(10) ORDER BY ord) AS menu FROM {WHOLE['nodes']} GROUP BY 1"


@query("q_site_mode", f"WITH {SITE_SQL} SELECT *, {SITE_CASE} FROM (SELECT page_id, {', '.join(f'regexp_matches(text, {q(r.pattern)}) AS {r.label}' for r in lexicon.SITE)} FROM (SELECT page_id, {FOLD('concat_ws(chr(10), menu, visible_text)')} AS text FROM {WHOLE['pages']} FULL JOIN ({MENU_TEXT}) USING (page_id)))")
def site_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = site.site_modes(*[literal(spark, name).withColumn("page_id", -F.col("page_id").cast("long")) for name in ("pages", "nodes")])
    return made.unionByName(site.page_modes(sites(spark, sf_dir)))


@query("q_menu_topk", f"WITH {SITE_SQL} SELECT page_id, ord, score::INT AS score, intent, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, ord) AS rank FROM (SELECT page_id, ord, {rules.score_sql(lexicon.MENU)} AS score, {rules.first_label_sql(lexicon.MENU_INTENT, 'CAMERA_GENERIC')} AS intent FROM (SELECT page_id, ord, {FOLD('''concat_ws(' ', text, aria_label, title)''')} AS text FROM {WHOLE['nodes']})) WHERE score > 0) WHERE rank <= 25")
def menu_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site.menu_candidates(whole(spark, sf_dir, "nodes")).select("page_id", "ord", "score", "intent", "rank")


ROOT_SQL = f"""WITH {SITE_SQL}, s AS (SELECT l.page_id, l.ord, l.text AS label, l.href, {FOLD('l.text')} AS text FROM {WHOLE['links']} AS l JOIN {WHOLE['pages']} AS p ON p.page_id = l.page_id WHERE {ORIGIN('l.href')} = {ORIGIN('p.url')} AND {PATH('l.href')} <> '/'),
b AS (SELECT *, {rules.score_sql(lexicon.ROOTS)} AS score FROM (SELECT *, {FOLD(f"text || ' ' || translate({PATH('href')}, '-_/', '   ')")} AS place FROM s)),
r AS (SELECT page_id, label AS text, href, score, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, ord) AS rank FROM b WHERE score > 0),
best AS (SELECT * FROM r WHERE rank <= 15 UNION ALL SELECT page_id, u.t, {ORIGIN('url')} || u.t, 80, 15 + u.i FROM {WHOLE['pages']}, (VALUES {', '.join(f"({i + 1}, '{p}')" for i, p in enumerate(lexicon.CONVENTIONAL_PATHS))}) AS u(i, t))
SELECT page_id, text, href, score::INT AS score FROM (SELECT *, row_number() OVER (PARTITION BY page_id, href ORDER BY rank) AS k FROM best) WHERE k = 1"""


@query("q_generic_roots", ROOT_SQL)
def generic_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site.generic_roots(whole(spark, sf_dir, "links"), places(spark, sf_dir)).select("page_id", "text", "href", "score")


RESOLVE_SQL = f"""WITH m AS (SELECT c.candidate_id, l.ord, l.href, CASE WHEN {FOLD('l.text')} = {FOLD('c.text')} THEN 300 ELSE 0 END + CASE WHEN {FOLD('l.title')} = {FOLD('c.text')} THEN 150 ELSE 0 END + CASE WHEN {FOLD('l.aria_label')} = {FOLD('c.text')} THEN 150 ELSE 0 END
 + CASE WHEN contains({FOLD('l.text')}, {FOLD('c.text')}) THEN 40 ELSE 0 END + CASE WHEN {ORIGIN('l.href')} = {ORIGIN('p.url')} THEN 50 ELSE 0 END + CASE WHEN {PATH('l.href')} <> '/' THEN 30 ELSE 0 END + CASE WHEN regexp_matches(lower({PATH('l.href')}), {q(lexicon.BAD_ROOT_PATH)}) THEN -200 ELSE 0 END AS score
 FROM {ALL['candidates']} AS c JOIN {ALL['links']} AS l ON l.page_id = c.page_id JOIN {ALL['pages']} AS p ON p.page_id = c.page_id WHERE c.href = ''),
b AS (SELECT candidate_id, href FROM (SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY score DESC, ord) AS r FROM m WHERE score > 0) WHERE r = 1)
SELECT candidate_id, CASE WHEN c.href <> '' THEN c.href ELSE coalesce(b.href, '') END AS href FROM {ALL['candidates']} AS c LEFT JOIN b USING (candidate_id)"""


@query("q_root_resolve", RESOLVE_SQL)
def root_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site.resolve_roots(frame(spark, sf_dir, "candidates"), frame(spark, sf_dir, "links"), frame(spark, sf_dir, "pages"))


ENTITY_SQL = f"""SELECT id, CASE WHEN short THEN -100 ELSE s END::INT AS entity_score, CASE WHEN short THEN 'NOT_CAMERA' WHEN s >= 5 THEN 'CAMERA' WHEN s <= -3 THEN 'NOT_CAMERA' ELSE 'UNCERTAIN' END AS entity_label,
 CASE WHEN short THEN '' ELSE array_to_string(p, ',') END AS positives, CASE WHEN short THEN 'strong non-camera title' ELSE array_to_string(n, ',') END AS negatives
FROM (SELECT id, regexp_matches(title, {q(lexicon.STRONG_NEGATIVE)}) AS short, {rules.score_sql(lexicon.ENTITY + lexicon.NOT_ENTITY)} AS s, {rules.labels_sql(lexicon.ENTITY)} AS p, {rules.labels_sql(lexicon.NOT_ENTITY)} AS n
FROM (SELECT *, title || ' ' || body AS "both" FROM (SELECT id, {FOLD('title')} AS title, {FOLD('body')} AS body FROM {WHOLE['texts']})))""".replace("regexp_matches(both,", 'regexp_matches("both",')  # fmt: skip


@query("q_entity_classify", ENTITY_SQL)
def entity_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.classify(whole(spark, sf_dir, "texts")).select("id", "entity_score", "entity_label", F.array_join("positives", ",").alias("positives"), F.array_join("negatives", ",").alias("negatives"))


@query("q_business_mode", f"SELECT id, {rules.first_label_sql(lexicon.BUSINESS, None)} AS mode FROM (SELECT id, lower(body) AS body FROM {WHOLE['texts']})")
def business_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whole(spark, sf_dir, "texts").select("id", records.business_mode(F.lit("CAMERA_GENERIC"), F.col("body")).alias("mode"))


CARD_PRODUCT = f"""NOT regexp_matches(lower({PATH('href')}), {q(lexicon.BAD_PATH)}) AND NOT ({PARAM('href', 'p')} IS NOT NULL OR {PARAM('href', 'page')} IS NOT NULL OR regexp_matches({PATH('href')}, '/page/[0-9]+'))
 AND NOT regexp_matches(title, {q('(?i)' + lexicon.ACCESSORY_TITLE)}) AND regexp_matches(title, {q('(?i)' + lexicon.BRANDS)}) AND regexp_matches(title, {q('(?i)' + lexicon.MODELS)}) AND (regexp_matches(card, {q(text.PRICE)}) OR regexp_matches(card, {q('(?i)' + lexicon.COMMERCIAL)})) AND lower(title) NOT IN ({', '.join(map(q, lexicon.NAVIGATION_TITLES))})"""


SHOP_SQL = f"""shop AS (SELECT page_id, url, html FROM {ALL['shop']}),
cards AS (SELECT page_id, url, unnest(regexp_extract_all(html, '<div class="card">.*?</div>')) AS card, generate_subscripts(regexp_extract_all(html, '<div class="card">.*?</div>'), 1) AS i FROM shop),
card AS (SELECT page_id, url AS page_url, i, {RESOLVE("regexp_extract(card, 'href=.([^ >]*?).>', 1)", 'url')} AS href, {CLEAN("regexp_extract(card, '<a [^>]*>(.*?)</a>', 1)")} AS title, {CLEAN("regexp_replace(card, '<[^>]*>', ' ', 'g')")} AS card FROM cards)"""


@query("q_card_text", f"WITH {SHOP_SQL} SELECT page_url, href, title, card FROM card")
def card_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title and card of every product link of a shop's catalog pages."""
    found = extract.cards(html.shred(frame(spark, sf_dir, "shop")))
    return found.where("href LIKE '%/p/%'").select(F.col("url").alias("page_url"), "href", "title", "card")


@query("q_product_filter", f"SELECT page_url, ord, {CARD_PRODUCT} AS product, {PRICE_SQL('card')} AS price_text FROM {ALL['cards']}")
def product_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.product_verdicts(frame(spark, sf_dir, "cards")).select("page_url", "ord", "product", "price_text")


@query("q_product_ownership", f"""WITH p AS (SELECT *, {CANONICAL('href')} AS product_url FROM {ALL['cards']} WHERE {CARD_PRODUCT}), f AS (SELECT *, row_number() OVER (PARTITION BY page_url, product_url ORDER BY ord) AS r FROM p)
SELECT product_url, title, intent, catalog_url FROM (SELECT product_url, title, intent, page_url AS catalog_url, row_number() OVER (PARTITION BY product_url ORDER BY visit_rank, ord) AS k FROM f JOIN {ALL['visits']} AS v USING (page_url) WHERE r = 1) WHERE k = 1""")  # fmt: skip
def product_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.owned_products(pages.page_products(frame(spark, sf_dir, "cards")), frame(spark, sf_dir, "visits")).select("product_url", "title", "intent", "catalog_url")


SEQUENCE_SQL = f"""WITH t AS (SELECT *, {PARAM('href', 'p')} AS p, {PARAM('href', 'page')} AS pg FROM {ALL['turns']}),
strict AS (SELECT page_url, ord, href, pg IS NOT NULL AS by_page FROM t WHERE regexp_matches(coalesce(nullif(p, ''), pg, ''), '^[0-9]+$') AND {ORIGIN('href')} = {ORIGIN('page_url')} AND {PATH('href')} = {PATH('page_url')}),
known AS (SELECT page_url, coalesce((SELECT arg_min(by_page, ord) FROM strict AS s WHERE s.page_url = r.page_url), false) AS by_page, TRY_CAST(nullif(regexp_extract(region_text, '(?i)Page\\s+[0-9]+\\s*/\\s*([0-9]+)', 1), '') AS INT) AS n FROM {ALL['turning']} AS r),
made AS (SELECT page_url, {ORIGIN('page_url')} || {PATH('page_url')} || '?' || coalesce((SELECT string_agg(x || '&', '' ORDER BY x) FROM unnest(string_split({QUERY('page_url')}, '&')) AS u(x) WHERE x <> '' AND split_part(x, '=', 1) NOT IN ('p', 'page')), '') || CASE WHEN by_page THEN 'page=' ELSE 'p=' END || k AS raw
 FROM known, unnest(generate_series(2, n)) AS g(k) WHERE n > 1),
both_ AS (SELECT page_url, raw FROM made UNION ALL SELECT page_url, href FROM strict)
SELECT DISTINCT page_url, {CANONICAL('raw')} AS next_url FROM both_ WHERE {CANONICAL('raw')} <> {CANONICAL('page_url')}"""


@query("q_page_sequence", SEQUENCE_SQL)
def page_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.page_sequence(frame(spark, sf_dir, "turning"), frame(spark, sf_dir, "turns"))


PROBE_SQL = f"""WITH c AS (SELECT url, count(DISTINCT CASE WHEN regexp_matches(text || ' ' || near, {q('(?i)' + lexicon.BRANDS)}) AND regexp_matches(near, {q(text.PRICE)}) THEN split_part(href, '#', 1) END) AS product_like_links,
 count(DISTINCT CASE WHEN lower(text) IN ({', '.join(map(q, lexicon.PAGE_WORDS))}) OR regexp_matches(text, '^[0-9]+$') OR regexp_matches({QUERY('href')}, '(^|&)(p|page)=[0-9]') OR regexp_matches({PATH('href')}, '/page/[0-9]+') THEN split_part(href, '#', 1) END) AS pagination_links FROM {ALL['probe_links']} GROUP BY 1),
s AS (SELECT k.candidate_id, k.url, k.intent, coalesce(product_like_links, 0) AS product_like_links, coalesce(pagination_links, 0) AS pagination_links, {FOLD("concat_ws(' ', p.title, p.body)")} AS body FROM {ALL['probed']} AS k LEFT JOIN {ALL['probe_pages']} AS p ON p.url = k.url LEFT JOIN c ON c.url = k.url),
e AS (SELECT *, CASE {' '.join(f"WHEN intent = '{k}' THEN regexp_matches(body, {q(v)})" for k, v in lexicon.INTENT_EVIDENCE.items())} ELSE true END AS i, regexp_matches(body, {q(lexicon.CAMERA_EVIDENCE)}) AS m, product_like_links > 0 AS b FROM s)
SELECT candidate_id, url, intent, product_like_links, pagination_links, i AND m AND b AS accepted, 'camera=' || m::VARCHAR || '; shop=' || b::VARCHAR || '; intent=' || i::VARCHAR AS reason FROM e"""


@query("q_probe_accept", PROBE_SQL)
def probe_accept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.probes(frame(spark, sf_dir, "probed"), frame(spark, sf_dir, "probe_pages"), frame(spark, sf_dir, "probe_links"))


@query("q_submenu_diff", f"SELECT page_id, arg_min(text, ord) AS text, arg_min(href, ord) AS href FROM (SELECT page_id, ord, {CLEAN('text')} AS text, href FROM {ALL['nodes']} WHERE text <> '' AND href <> '') WHERE ord <> 1 GROUP BY page_id, lower(text) || '|' || href")
def submenu_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = frame(spark, sf_dir, "nodes")
    return site.submenu_items(nodes.where("ord = 1"), nodes)


@query("q_seed_select", f"""WITH e AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY site, url ORDER BY ord) AS r FROM {ALL['roots']} WHERE explicit AND accepted) WHERE r = 1),
g AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY ord) AS r FROM {ALL['roots']} WHERE NOT explicit AND accepted AND site IN (SELECT site FROM {ALL['modes']} WHERE site_mode = 'RENTAL') AND site NOT IN (SELECT site FROM e))
SELECT site, url, intent, label FROM e UNION ALL SELECT site, url, intent, label FROM g WHERE r = 1""")  # fmt: skip
def seed_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    roots = frame(spark, sf_dir, "roots")
    return site.select_seeds(roots.where("explicit"), roots.where("not explicit"), frame(spark, sf_dir, "modes"))


@query("q_element_match", f"""SELECT node_id, element_id, score::INT AS score FROM (SELECT a.page_id * 100 + a.ord AS node_id, b.ord AS element_id, s AS score, row_number() OVER (PARTITION BY a.page_id, a.ord ORDER BY s DESC, b.ord) AS r FROM {ALL['nodes']} AS a JOIN {ALL['nodes']} AS b ON a.page_id = b.page_id,
 LATERAL (SELECT CASE WHEN lower({CLEAN('a.text')}) = lower({CLEAN('b.text')}) THEN 120 ELSE 0 END + CASE WHEN a.href <> '' AND a.href = b.href THEN 220 ELSE 0 END + CASE WHEN a.aria_label <> '' AND lower({CLEAN('a.aria_label')}) = lower({CLEAN('b.aria_label')}) THEN 80 ELSE 0 END + CASE WHEN abs(a.x - b.x) + abs(a.y - b.y) < 10 THEN 80 WHEN abs(a.x - b.x) + abs(a.y - b.y) < 60 THEN 30 ELSE 0 END AS s)) WHERE r = 1""")  # fmt: skip
def element_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = frame(spark, sf_dir, "nodes")
    return site.match_elements(nodes.withColumn("node_id", F.col("page_id") * 100 + F.col("ord")), nodes.withColumn("element_id", F.col("ord")))


def _checkpoint(spark: SparkSession) -> Callable[[DataFrame, str], DataFrame]:
    if spark.sparkContext.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(folder)
    return lambda df, name: df.checkpoint()


def _crawled(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = frame(spark, sf_dir, "edges")
    state = pages.crawl(frame(spark, sf_dir, "seeds"), edges, frame(spark, sf_dir, "loaded"), _checkpoint(spark), MOST)
    return pages.with_unfollowed(state, edges, _checkpoint(spark))


#: Pages visited at most in the queries: more than there are.
MOST = 10**9
#: Waves that the SQL spells out.
WAVES = 6


def CRAWL(seeds: str, edges: str, loaded: str) -> str:
    """A breadth-first crawl, wave by wave, as WITH parts; the last is crawl (url, intent, rank, wave, status)."""
    parts = [f"edge AS (SELECT url, next_url, min(ord) AS ord FROM {edges} AS x WHERE next_url <> url GROUP BY 1, 2)", f"opens AS (SELECT DISTINCT url FROM {loaded} AS x)",
             f"w0 AS (SELECT url, intent, row_number() OVER (ORDER BY o, url) - 1 AS rank, 0 AS wave FROM (SELECT {CANONICAL('url')} AS url, arg_max(intent, ord) AS intent, min(ord) AS o FROM {seeds} AS x GROUP BY 1))"]
    for i in range(1, WAVES):
        known = " UNION ALL ".join(f"SELECT url FROM w{k}" for k in range(i))
        parts.append(f"""w{i} AS (SELECT url, intent, row_number() OVER (ORDER BY o, url) - 1 AS rank, {i} AS wave FROM (SELECT next_url AS url, arg_min(intent, rank * 100000 + ord) AS intent, min(rank * 100000 + ord) AS o
 FROM w{i - 1} JOIN edge USING (url) WHERE url IN (SELECT url FROM opens) AND next_url NOT IN ({known}) GROUP BY 1))""")
    waves = " UNION ALL ".join(f"SELECT * FROM w{k}" for k in range(WAVES))
    return ",\n".join([*parts, f"crawl AS (SELECT url, intent, rank, wave, CASE WHEN url IN (SELECT url FROM opens) THEN 'visited' ELSE 'failed' END AS status FROM ({waves}))"])


SHOP_CRAWL = CRAWL(ALL["seeds"], ALL["edges"], ALL["loaded"])


@query("q_frontier", f"WITH {SHOP_CRAWL} SELECT url, intent, rank, wave, status FROM crawl")
def frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages in the order of the crawl, each with the intent of the page that first leads to it."""
    return _crawled(spark, sf_dir).select("url", "intent", "rank", "wave", "status")


def RECORDS(listed: str, details: str) -> str:
    """Records of listed products as a chain of WITH parts; the last is r."""
    full = lambda c: f"nullif({c}, '')"
    first = f"coalesce({full('h1')}, {full('json_name')}, {full('listing_title')}, '')"
    entity = f"{rules.score_sql(lexicon.ENTITY + lexicon.NOT_ENTITY)}".replace("regexp_matches(both,", 'regexp_matches("both",')
    negatives = rules.labels_sql(lexicon.NOT_ENTITY).replace("regexp_matches(both,", 'regexp_matches("both",')
    lexicon_mode = rules.first_label_sql(lexicon.BUSINESS, None).replace("regexp_matches(body,", "regexp_matches(lower(coalesce(body_text, '')),")
    return f"""j AS (SELECT l.url, l.title AS listing_title, l.intent, l.price_text, d.* EXCLUDE (url), d.url IS NOT NULL AS fetched FROM {listed} AS l LEFT JOIN {details} AS d ON d.url = l.url),
n AS (SELECT *, {first} AS product_name, coalesce(CASE WHEN json_price_num > 0 THEN json_price_num::DOUBLE END, {MONEY('json_price_str')}) AS json_price, {MONEY('price_text')} AS listing_price FROM j),
f AS (SELECT *, {FOLD('product_name')} AS title, {FOLD('body_text')} AS body, coalesce(json_price, {MONEY('dom_price')}) AS detail_price,
 CASE WHEN intent IN ('RENTAL', 'SECOND_HAND', 'NEW') THEN intent WHEN fetched THEN {lexicon_mode} END AS mode FROM n),
e AS (SELECT *, title || ' ' || body AS "both", regexp_matches(title, {q(lexicon.STRONG_NEGATIVE)}) AS short FROM f),
s AS (SELECT *, CASE WHEN short THEN -100 ELSE {entity} END AS score, CASE WHEN short THEN ['strong non-camera title'] ELSE {negatives} END AS negatives FROM e),
r AS (SELECT *, CASE WHEN NOT fetched THEN 'review' WHEN score <= {lexicon.NOT_CAMERA_TO} THEN 'excluded' WHEN score < {lexicon.CAMERA_FROM} OR mode IS NULL THEN 'review' ELSE 'accepted' END AS disposition,
 CASE WHEN NOT fetched THEN 'detail fetch failed: page not in corpus' WHEN score <= {lexicon.NOT_CAMERA_TO} THEN 'not camera: ' || coalesce(nullif(array_to_string(negatives, ', '), ''), 'semantic validator') WHEN score < {lexicon.CAMERA_FROM} THEN 'camera identity uncertain; score=' || score
  WHEN mode IS NULL THEN 'business mode uncertain' ELSE 'camera detail confirmed' END AS reason, {HOST('url')} AS website, coalesce(mode, 'NEW') AS business_mode, coalesce(mode = 'RENTAL', false) AS rental, coalesce(detail_price, listing_price) AS price,
 {CLEAN("concat_ws(' | ', nullif(" + CLEAN('summary') + ", ''), CASE WHEN warranty <> '' THEN 'Bảo hành: ' || warranty END)")} AS specs, CASE WHEN ({NUM('json_rating')}) BETWEEN 0 AND 5 THEN {NUM('json_rating')} END AS rating,
 CASE WHEN ({NUM('json_review_count')}) >= 0 THEN floor(({NUM('json_review_count')}) + 0.5)::BIGINT END AS review_count, coalesce(nullif(stock, ''), regexp_replace(coalesce(json_availability, ''), '(?i)^https?://schema.org/', '')) AS stock_text FROM s)"""


SHOP_RECORDS = RECORDS(ALL["listed"], ALL["details"])
RECORD_SQL = "SELECT url, website, product_name, business_mode, specs, CASE WHEN rental THEN coalesce(rental_conditions, '') ELSE '' END AS rental_conditions, coalesce(accessories, '') AS included_accessories, coalesce(bundle, '') AS bundle, listing_price, detail_price, rating, review_count, stock_text AS stock, CASE WHEN fetched AND rental THEN price END AS rental_price_per_day, CASE WHEN fetched AND NOT rental THEN price END AS sale_price, disposition, reason FROM r"
PLAIN_NUMBER = lambda c: f"CASE WHEN {c} = floor({c}) THEN {c}::BIGINT::VARCHAR ELSE {c}::VARCHAR END"
PRICE_FIELD = "CASE WHEN rental THEN 'Giá thuê/ngày' ELSE 'Giá bán' END"


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.details(frame(spark, sf_dir, "listed"), frame(spark, sf_dir, "details"))


@query("q_detail_record", f"WITH {SHOP_RECORDS} {RECORD_SQL}")
def detail_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _records(spark, sf_dir).select(*records.RECORD, "disposition", "reason", "listing_price", "detail_price")


@query("q_price_conflicts", f"WITH {SHOP_RECORDS} SELECT url, {PRICE_FIELD} AS field, {PLAIN_NUMBER('listing_price')} AS listing_value, {PLAIN_NUMBER('detail_price')} AS detail_value FROM r WHERE listing_price <> detail_price")
def price_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.conflicts(_records(spark, sf_dir))


@query("q_order_conflicts", "SELECT o_orderkey, floor(o_totalprice)::BIGINT AS listed, floor(d)::BIGINT AS detail FROM orders JOIN (SELECT l_orderkey, sum(l_quantity) AS d FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey WHERE floor(o_totalprice) <> floor(d)")
def order_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conflict rule at scale: an order's price against a sum over its lines."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("d"))
    both = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_totalprice").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    listed, detail = F.floor("o_totalprice").cast("long"), F.floor("d").cast("long")
    return both.select("o_orderkey", listed.alias("listed"), detail.alias("detail")).where("listed <> detail")


EVIDENCE_SQL = f"""WITH {SHOP_RECORDS}, v AS (SELECT url, disposition, 0 AS i, 'Tên sản phẩm' AS field, product_name AS value, CASE WHEN h1 <> '' THEN 'DOM' WHEN json_name <> '' THEN 'JSON_LD' ELSE 'LISTING' END AS source, CASE WHEN h1 <> '' THEN 0.99 ELSE 0.92 END::DOUBLE AS confidence, product_name AS evidence FROM r WHERE fetched AND product_name <> ''
UNION ALL SELECT url, disposition, 1, {PRICE_FIELD}, {PLAIN_NUMBER('price')}, CASE WHEN json_price IS NOT NULL THEN 'JSON_LD' WHEN detail_price IS NOT NULL THEN 'DOM' ELSE 'LISTING' END, CASE WHEN detail_price IS NOT NULL THEN 0.99 ELSE 0.9 END,
 CASE WHEN detail_price IS NULL THEN coalesce(price_text, '') ELSE coalesce(nullif(json_price_str, ''), {PLAIN_NUMBER('nullif(json_price_num, 0)')}, dom_price, '') END FROM r WHERE fetched AND price IS NOT NULL
UNION ALL SELECT url, disposition, 2, 'Tồn kho', coalesce(nullif(stock, ''), json_availability), CASE WHEN stock <> '' THEN 'DOM' ELSE 'JSON_LD' END, 0.97, coalesce(nullif(stock, ''), json_availability) FROM r WHERE fetched AND coalesce(nullif(stock, ''), nullif(json_availability, '')) IS NOT NULL
UNION ALL SELECT url, disposition, 3, 'Phụ kiện đi kèm', accessories, 'DOM', 0.97, accessories FROM r WHERE fetched AND accessories <> '')
SELECT url, disposition, (row_number() OVER (PARTITION BY url ORDER BY i) - 1)::INT AS ord, field, value, source, confidence, evidence[:280] AS evidence FROM v"""


@query("q_evidence_explode", EVIDENCE_SQL)
def evidence_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of evidence of every record, in order, with its excerpt."""
    return records.evidence_rows(_records(spark, sf_dir))


@query("q_coverage", f"WITH {SHOP_CRAWL} SELECT 'ROOT' AS kind, intent, label, url FROM {ALL['seeds']} UNION ALL SELECT 'CATALOG_PAGE', '', '', url FROM crawl WHERE status = 'visited' AND url NOT IN (SELECT url FROM {ALL['seeds']}) UNION ALL SELECT 'FAILED_PAGE', '', '', url FROM crawl WHERE status = 'failed'")
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.coverage(frame(spark, sf_dir, "seeds"), _crawled(spark, sf_dir))


def _audit_parts(seeds: str, listed: str, start_url: str) -> str:
    """The audit's rows, of WITH parts crawl and r, and all but the elapsed seconds."""
    return f"""c AS (SELECT count(*) FILTER (status = 'visited') AS visited, count(*) FILTER (status = 'failed') AS failed FROM crawl),
d AS (SELECT count(*) AS checked, count(*) FILTER (disposition = 'accepted') AS accepted, count(*) FILTER (disposition = 'excluded') AS excluded, count(*) FILTER (disposition = 'review') AS review, count(*) FILTER (NOT fetched) AS errors, count(*) FILTER (listing_price <> detail_price) AS differ FROM r),
k AS (SELECT *, (SELECT count(*) FROM {seeds} AS x) AS roots, (SELECT count(*) FROM {listed} AS x) AS products FROM c, d),
v AS (SELECT map {{'Target': 'CAMERA', 'Start URL': '{start_url}', 'Catalog roots': roots::VARCHAR, 'Catalog pages visited': visited::VARCHAR, 'Catalog queue remaining': failed::VARCHAR, 'Catalog URLs skipped by safety limit': '0', 'Failed catalog pages': failed::VARCHAR, 'Product candidates': products::VARCHAR,
 'Product details checked': checked::VARCHAR, 'Accepted': accepted::VARCHAR, 'Excluded': excluded::VARCHAR, 'Review': review::VARCHAR, 'Detail errors': errors::VARCHAR, 'Price conflicts': differ::VARCHAR, 'Catalog coverage': CASE WHEN failed = 0 THEN 'PASS' ELSE 'NOT COMPLETE' END,
 'Detail coverage': CASE WHEN checked = products THEN 'PASS' ELSE 'NOT COMPLETE' END, 'Overall completeness': CASE WHEN failed = 0 AND checked = products THEN 'PASS' ELSE 'NOT COMPLETE' END}} AS m FROM k)
SELECT unnest(map_keys(m)) AS metric, unnest(map_values(m)) AS value FROM v"""


AUDIT_SQL = f"WITH {SHOP_CRAWL}, {SHOP_RECORDS}, {_audit_parts(ALL['seeds'], ALL['listed'], 'https://s.vn/')} UNION ALL SELECT 'Elapsed seconds', '0'"


@query("q_audit", AUDIT_SQL)
def audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.audit("https://s.vn/", frame(spark, sf_dir, "seeds"), _crawled(spark, sf_dir), frame(spark, sf_dir, "listed"), _records(spark, sf_dir))


def JSONLD(source: str) -> str:
    """The fields of the first product of every page's embedded JSON."""
    return f"""WITH c AS (SELECT page_id, unnest(regexp_extract_all(coalesce(html, ''), '(?s)<script type="application/ld.json">(.*?)</script>', 1)) AS raw, generate_subscripts(regexp_extract_all(coalesce(html, ''), '(?s)<script type="application/ld.json">(.*?)</script>', 1), 1) AS i FROM {source} AS x),
g AS (SELECT page_id, i, 0 AS k, raw::JSON AS o FROM c WHERE json_valid(raw) AND json_type(raw::JSON) = 'OBJECT'
 UNION ALL SELECT page_id, i, k, o FROM (SELECT page_id, i, unnest(json_extract(raw::JSON, '$[*]')) AS o, generate_subscripts(json_extract(raw::JSON, '$[*]'), 1) AS k FROM c WHERE json_valid(raw) AND json_type(raw::JSON) = 'ARRAY')),
t AS (SELECT page_id, i, k, 0 AS m, o FROM g UNION ALL SELECT page_id, i, k, m, o FROM (SELECT page_id, i, k, unnest(json_extract(o, '$."@graph"[*]')) AS o, generate_subscripts(json_extract(o, '$."@graph"[*]'), 1) AS m FROM g)),
p AS (SELECT page_id, arg_min(o, i * 10000 + k * 100 + m) AS o FROM t WHERE lower(json_extract_string(o, '$."@type"')) = 'product' OR list_contains(list_transform(json_extract_string(o, '$."@type"[*]'), lambda x: lower(x)), 'product') GROUP BY 1),
f AS (SELECT page_id, o, CASE WHEN json_type(o, '$.offers') = 'ARRAY' THEN json_extract(o, '$.offers[0]') ELSE json_extract(o, '$.offers') END AS f FROM p),
v AS (SELECT *, coalesce(json_extract(f, '$.price'), json_extract(f, '$.lowPrice')) AS price FROM f)
SELECT j.page_id, coalesce(json_extract_string(o, '$.name'), '') AS json_name, CASE WHEN o IS NOT NULL AND json_type(price) IS DISTINCT FROM 'UBIGINT' AND json_type(price) IS DISTINCT FROM 'DOUBLE' THEN coalesce(json_extract_string(price, '$'), '') END AS json_price_str, CASE WHEN json_type(price) IN ('UBIGINT', 'DOUBLE') THEN price::DOUBLE END AS json_price_num,
 coalesce(json_extract_string(f, '$.availability'), '') AS json_availability, json_extract_string(o, '$.aggregateRating.ratingValue') AS json_rating, coalesce(json_extract_string(o, '$.aggregateRating.reviewCount'), json_extract_string(o, '$.aggregateRating.ratingCount')) AS json_review_count FROM {source} AS j LEFT JOIN v USING (page_id)"""


@query("q_jsonld_product", JSONLD(ALL["json_pages"]))
def jsonld_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first product of each page's embedded JSON; scripts that do not parse are passed over."""
    return extract.products(html.shred(frame(spark, sf_dir, "json_pages"))).drop("url")


ROW_TEXT = CLEAN("regexp_replace(x, '<[^>]*>', ' ', 'g')")
PRODUCT_SQL = f"""owned AS (SELECT * FROM (SELECT {CANONICAL('href')} AS url, title, c.intent, {PRICE_SQL('card')} AS price_text, row_number() OVER (PARTITION BY {CANONICAL('href')} ORDER BY c.wave, c.rank, i) AS k FROM (SELECT * FROM card WHERE {CARD_PRODUCT}) JOIN crawl AS c ON c.url = page_url AND c.status = 'visited') WHERE k = 1),
ld AS ({JSONLD(ALL['shop'])}),
raw AS (SELECT url, {CLEAN("regexp_extract(html, '<h1>(.*?)</h1>', 1)")} AS h1, {CLEAN("regexp_replace(regexp_replace(html, '<(script|head).*?</(script|head)>', '', 'g'), '<[^>]*>', ' ', 'g')")} AS body_text, ld.* EXCLUDE (page_id),
 regexp_extract(html, '<p>Giá: ([^<]*)', 1) AS dom_price, regexp_extract(html, 'Tình trạng: ([^<]*)', 1) AS stock, regexp_extract(html, 'Phụ kiện: ([^<]*)', 1) AS accessories, regexp_extract(html, 'Bảo hành: ([^<]*)', 1) AS warranty,
 coalesce(nullif(regexp_extract(html, 'Tóm tắt sản phẩm:</h2><p>([^<]*)', 1), ''), array_to_string(list_transform(regexp_extract_all(html, '<tr>(.*?)</tr>', 1), lambda x: {ROW_TEXT}), ' | ')) AS summary,
 regexp_extract(html, '<p>(Đặt cọc[^<]*)', 1) AS rental_conditions, regexp_extract(html, '<p>Combo:</p><p>([^<]*)', 1) AS bundle FROM shop JOIN ld USING (page_id) WHERE contains(url, '/p/'))"""
SHOP_EDGES = f"(SELECT page_url AS url, unnest([page_url || '?page=' || k FOR k IN generate_series(2, n)]) AS next_url, unnest(generate_series(2, n)) AS ord FROM (SELECT url AS page_url, TRY_CAST(nullif(regexp_extract(html, 'Page 1 / ([0-9]+)', 1), '') AS INT) AS n FROM {ALL['shop']}) WHERE n > 1)"
SHOP_WALK = CRAWL(ALL["shop_seeds"], SHOP_EDGES, ALL["shop"])


@query("q_pages_to_records", f"WITH {SHOP_WALK}, {SHOP_SQL}, {PRODUCT_SQL}, {RECORDS('owned', 'raw')} {RECORD_SQL}")
def pages_to_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From HTML to records: shredding, crawl of the catalog, cards, products, details, classification."""
    got = extract.from_pages(frame(spark, sf_dir, "shop"), frame(spark, sf_dir, "shop_seeds"), _checkpoint(spark), MOST)["records"]
    return got.select(*records.RECORD, "disposition", "reason", "listing_price", "detail_price")


@query("q_page_regions", f"WITH {SHOWN_SQL} SELECT page_id, sha256(body) AS region, sha256(body[:12000]) AS visible FROM shown")
def page_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every page's region (the body, as these pages mark no main one) and of what it shows, line ends as spaces."""
    shredded = html.shred(_pages(spark, sf_dir))
    regions = shredded.select("page_id", F.sha2(extract.region_text(), 256).alias("region"), F.array_join("lines", "\n").alias("visible"))
    return regions.withColumn("visible", F.sha2(F.translate(F.substring("visible", 1, html.VISIBLE_MOST), "\n", " "), 256))


@query("q_page_controls", f"WITH {ANCHOR_SQL} SELECT page_id, h.ord::INT AS ord, 'n' || h.ord AS id, 'a' AS tag, l.text, raw AS href FROM h JOIN links AS l USING (page_id, ord) WHERE h.ord < 300")
def page_controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 300 visible links and buttons of every page."""
    return html.nodes(html.shred(_pages(spark, sf_dir)), 300).select("page_id", "ord", "id", "tag", "text", "href")


@query("q_link_surroundings", f"WITH {ANCHOR_SQL}, {SHOWN_SQL} SELECT page_id, ord::INT AS ord, sha256(body) AS near FROM links JOIN shown USING (page_id)")
def link_surroundings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of the longest text around every link, four levels up: these pages' links stand in lists, so it is the body's."""
    return extract.surroundings(html.shred(_pages(spark, sf_dir))).select("page_id", "ord", F.sha2("near", 256).alias("near"))


TAG_TEXT = CLEAN("regexp_replace(tag, '<[^>]*>', '', 'g')")
TAG_HREF = "regexp_extract(tag, 'href=\"([^\"]*)\"', 1)"
SUBMENU_SQL = f"""WITH m AS (SELECT page_id, url, regexp_extract_all(regexp_replace(html, '<li class="off">.*?</li>', '', 'g'), '<a [^>]*>.*?</a>') AS t, regexp_extract_all(regexp_extract(html, '<li class="root">(.*?)<i></i></li>', 1), '<a [^>]*>.*?</a>') || CASE WHEN page_id % 4 = 0 THEN ['<a href="/late">Sau</a>'] ELSE [] END AS kids FROM {ALL['menus']}),
k AS (SELECT page_id, url, t[1] AS root, unnest(kids) AS tag, generate_subscripts(kids, 1) AS ord FROM m),
i AS (SELECT page_id, arg_min(text, ord) AS text, href FROM (SELECT page_id, ord, {TAG_TEXT} AS text, {ORIGIN('url')} || {TAG_HREF} AS href FROM k WHERE tag <> root) GROUP BY page_id, href, lower(text)),
d AS (SELECT page_id, ord, {TAG_TEXT} AS text, {TAG_HREF} AS href FROM (SELECT page_id, unnest(t) AS tag, generate_subscripts(t, 1) AS ord FROM m) WHERE page_id NOT IN (SELECT page_id FROM i))
SELECT page_id, text, href, 'DOM_CHILDREN' AS method FROM i UNION ALL
SELECT page_id, arg_min(text, ord), href, 'VISIBLE_DIFF' FROM d AS x WHERE NOT EXISTS (SELECT 1 FROM d AS y WHERE y.ord = 1 AND y.page_id = x.page_id AND y.href = x.href AND lower(y.text) = lower(x.text)) GROUP BY page_id, href, lower(text)"""


@query("q_submenu", SUBMENU_SQL)
def submenu(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The links in the list item of the first link of every page, before it is opened and after (a link more on every
    fourth page); of pages without any, what that link alone did not show."""
    menus = frame(spark, sf_dir, "menus")
    late = F.replace("html", F.lit("<i></i>"), F.lit('<ul><li><a href="/late">Sau</a></li></ul><i></i>'))
    shredded, opened = html.shred(menus), html.shred(menus.withColumn("html", F.when(F.col("page_id") % 4 == 0, late).otherwise(F.col("html"))))
    roots = extract.page_links(shredded, False, False).where("ord = 0").withColumn("root_id", F.col("page_id"))
    nodes = html.nodes(shredded)
    return site.submenu(extract.children(shredded, roots), nodes.where("ord = 0"), nodes, extract.children(opened, roots))


ROWS_SQL = f"SELECT page_id, regexp_extract_all(html, '<tr>(.*?)</tr>', 1) AS rows FROM {ALL['shop']}"


@query("q_table_rows", f"""SELECT page_id, i::INT AS i, {CLEAN("regexp_replace(line, '<[^>]*>', ' ', 'g')")} AS line FROM (SELECT page_id, unnest(rows) AS line, generate_subscripts(rows, 1) - 1 AS i FROM ({ROWS_SQL}))""")
def table_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of tables: the first 20 of a page, of 300 characters at most."""
    return html.shred(frame(spark, sf_dir, "shop")).select("page_id", F.posexplode("table_rows").alias("i", "line"))


MENU_SCORES = f"""SELECT page_id, ord, {rules.score_sql(lexicon.MENU)} AS score, {rules.first_label_sql(lexicon.MENU_INTENT, 'CAMERA_GENERIC')} AS intent FROM (SELECT page_id, ord, {FOLD("concat_ws(' ', text, aria_label, title)")} AS text FROM {WHOLE['nodes']})"""


@query("q_sure_roots", f"WITH {SITE_SQL} SELECT page_id, ord, score::INT AS score, intent FROM ({MENU_SCORES}) WHERE score >= 100")
def sure_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Menu items that are catalog roots for certain."""
    return site.sure_candidates(site.menu_scores(whole(spark, sf_dir, "nodes"))).select("page_id", "ord", "score", "intent")


@query("q_sheets", f"WITH {SHOP_RECORDS} SELECT CASE disposition WHEN 'accepted' THEN 'main' ELSE disposition END AS sheet, url, product_name, business_mode, CASE WHEN disposition <> 'accepted' THEN reason END AS reason FROM r")
def sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the report's three sheets of products: each record is in one of them."""
    made = records.sheets(_checkpoint(spark)(_records(spark, sf_dir), "records"), frame(spark, sf_dir, "seeds"), frame(spark, sf_dir, "modes"), spark)  # read by each sheet
    main, *others = [made[k].withColumn("sheet", F.lit(k)) for k in ("main", "excluded", "review")]
    for part in others:
        main = main.unionByName(part, allowMissingColumns=True)
    return main.select("sheet", "url", "product_name", "business_mode", "reason")


@query("q_failed_details", f"SELECT l.url, l.title AS product_name, 'detail fetch failed: page not in corpus' AS reason FROM {ALL['listed']} AS l LEFT JOIN {ALL['details']} AS d ON d.url = l.url WHERE d.url IS NULL")
def failed_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listed products whose page is not in the corpus stay, for review."""
    return _records(spark, sf_dir).where("reason LIKE 'detail fetch failed%'").select("url", "product_name", "reason")


@query("q_event_props", "SELECT event_type, count(*) AS n_events, sum(json_extract_string(props, '$.k')::BIGINT)::BIGINT AS total FROM events GROUP BY 1")
def event_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embedded JSON at scale: fields taken from a column of JSON texts without Python."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_type", F.get_json_object("props", "$.k").cast("long").alias("k"))
    return events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n_events"), F.sum("k").alias("total"))


STYLED = """replace(replace(replace(html, '<style>', '<style>/* . */ .off{display:none} a.ghost{visibility:hidden} h1{display:none} @media print{p{display:none}} '), '<a href="/t', '<a class="off" href="/t'), '<a href="/a', '<a class="x ghost" href="/a')"""
STYLED_SQL = f"""styled AS (SELECT page_id, url, {STYLED} AS html FROM pages), seen AS (SELECT page_id, url, regexp_replace(html, '(?s)<a class="(off|x ghost)" .*?</a>|<h1>.*?</h1>', '', 'g') AS html FROM styled)"""


@query("q_page_visibility", f"WITH {STYLED_SQL}, {SHOWN('seen')} SELECT page_id, len(regexp_extract_all(html, '<a '))::INT AS n_controls, len(regexp_extract_all(s.html2, '<a '))::INT AS n_links, sha256(body[:{html.VISIBLE_MOST}]) AS visible FROM seen JOIN shown USING (page_id) JOIN (SELECT page_id, html AS html2 FROM styled) AS s USING (page_id)")
def page_visibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Controls and text that pages show, and all their links, with rules written into their style sheets: links and
    headings that are not displayed, links that are hidden, and a rule for print alone."""
    shredded = html.shred(_pages(spark, sf_dir).select("page_id", "url", F.expr(STYLED.replace("\\", "\\\\")).alias("html")))
    shown = F.translate(F.substring(F.array_join("lines", "\n"), 1, html.VISIBLE_MOST), "\n", " ")
    return shredded.select("page_id", F.size(F.filter("nodes", lambda n: n.interactive)).alias("n_controls"), F.size(F.filter("nodes", lambda n: n.tag == "a")).alias("n_links"), F.sha2(shown, 256).alias("visible"))


WALKED = f"{SHOP_WALK}, {SHOP_SQL}, {PRODUCT_SQL}, {RECORDS('owned', 'raw')}"


@query("q_run_audit", f"WITH {WALKED}, " + _audit_parts(ALL["shop_seeds"], "owned", ""))
def run_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of a run from HTML to records, from numbers observed while its tables are written."""
    got = extract.from_pages(frame(spark, sf_dir, "shop"), frame(spark, sf_dir, "shop_seeds"), _checkpoint(spark), MOST)["audit"]
    return got.where("metric <> 'Elapsed seconds'")


@query("q_main_sheet", f"WITH {SHOP_RECORDS}, sheet AS ({RECORD_SQL}) SELECT {', '.join(f'{c} AS {chr(34)}{h}{chr(34)}' for c, h in records.HEADERS['main'].items())} FROM sheet WHERE disposition = 'accepted'")
def main_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report's main sheet, all columns under their headers."""
    made = records.sheets(_records(spark, sf_dir), frame(spark, sf_dir, "seeds"), frame(spark, sf_dir, "modes"), spark)
    return records.titled("main", made["main"])


@query("q_synthetic_nodes", f"""SELECT page_id, 's' || row_number() OVER (PARTITION BY page_id ORDER BY href, text) AS id, 'a' AS tag, text, '' AS role, href, '' AS aria_label, '' AS title, 0 AS x, 0 AS y, 0 AS width, 0 AS height FROM ({ROOT_SQL})""")
def synthetic_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Likely roots of every page as nodes that no page showed."""
    return site.synthetic_nodes(site.generic_roots(whole(spark, sf_dir, "links"), places(spark, sf_dir)))


ODD = shops.case("page_id", "'/a b/./é/../c?q=a b&z=%20x~*&é=1'", "'&utm_source=x&b=%C3%A9+x&a=%zz&p=%31'", "'/漢字\"<>?page=1&b=!;:&a=='", "'?p=1&p=2&x'", "'/x/../d//e/..#é'")
ODD_PATH = f"array_to_string([CASE WHEN regexp_matches(x, {q(url.PATH_CHARACTER)}) THEN x ELSE url_encode(x) END FOR x IN string_split({DOTLESS(PATH('u'))}, '')], '')"
FORM = lambda x: f"replace(replace(replace(url_encode({x}), '%20', '+'), '~', '%7E'), '%2A', '*')"
ESCAPED_SQL = f"""WITH o AS (SELECT page_id, u, {ORIGIN('u')} || {ODD_PATH} AS place, list_filter(string_split({QUERY('u')}, '&'), lambda x: x <> '') AS pairs FROM (SELECT page_id, url || {ODD} AS u FROM pages)),
p AS (SELECT page_id, i, url_decode(replace(split_part(x, '=', 1), '+', ' ')) AS n, url_decode(replace(CASE WHEN contains(x, '=') THEN substr(x, strpos(x, '=') + 1) ELSE '' END, '+', ' ')) AS v FROM (SELECT page_id, unnest(pairs) AS x, generate_subscripts(pairs, 1) AS i FROM o)),
f AS (SELECT page_id, n, arg_min(v, i) AS v FROM p WHERE n IN ('p', 'page') GROUP BY 1, 2),
k AS (SELECT page_id, string_agg({FORM('n')} || '=' || {FORM('v')}, '&' ORDER BY n, i) AS tail FROM p WHERE n NOT IN ({', '.join(map(q, url.TRACKING))}) AND NOT EXISTS (SELECT 1 FROM f WHERE f.page_id = p.page_id AND f.n = p.n AND f.v = '1') GROUP BY 1)
SELECT page_id, u, place || coalesce('?' || tail, '') AS canonical FROM o LEFT JOIN k USING (page_id)"""


@query("q_url_escaped", ESCAPED_SQL)
def url_escaped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one form of every page's URL with characters that need escaping, dot segments and odd parameters added."""
    odd = _pages(spark, sf_dir).select("page_id", F.concat("url", F.expr(ODD)).alias("u"))
    return odd.select("page_id", "u", url.canonical("u").alias("canonical"))
