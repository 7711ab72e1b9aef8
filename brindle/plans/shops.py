"""Camera shops made of the tables of a data folder, as SQL that Spark and DuckDB both read.

Every supplier is a site and every part a product of one: twenty products a shop, listed on three catalog pages, each
with a page of its own (but for every fifteenth). So the relations grow with part, supplier, lineitem and pages. A table
of the folder is written @name; `spark_sql` and `duck_sql` say it in either engine's way.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

#: Cards that a catalog page starts with, and those of the page before that it repeats.
CARDS, REPEATED = 8, 2


def case(value: str, *texts: str) -> str:
    """One of several SQL expressions by a number's remainder."""
    return f"CASE ({value}) % {len(texts)} {' '.join(f'WHEN {i} THEN {t}' for i, t in enumerate(texts))} END"


def money(thousands: str) -> str:
    """Thousands as a price of the country."""
    high, low = f"CAST(({thousands} - {thousands} % 1000) / 1000 AS BIGINT)", f"lpad(CAST({thousands} % 1000 AS STRING), 3, '0')"
    return f"CASE WHEN {thousands} >= 1000 THEN {high} || '.' || {low} ELSE CAST({thousands} AS STRING) END || '.000 đ'"


SITE = "'https://shop' || s || '.vn'"
INTENT = case("s", "'NEW'", "'SECOND_HAND'", "'RENTAL'", "'CAMERA_GENERIC'")
ROOT = case("s", "'Máy ảnh chính hãng'", "'Máy ảnh cũ'", "'Cho thuê máy ảnh'", "'Camera'")
SHOPS = "(SELECT s_suppkey AS s, s_name AS name, s_nationkey AS nation FROM @supplier)"
MODEL = case("p_partkey", "'Canon EOS R'", "'Sony Alpha A'", "'Nikon Z'", "'Fujifilm X-T'", "'Pin Canon LP-'", "'Ống kính Sony FE '", "'Instax mini '") + " || p_partkey || ' ' || p_name"
OFFERS = f"""(SELECT p_partkey AS k, s_suppkey AS s, CAST(p_partkey % 20 AS INT) AS n, {MODEL} AS title, p_brand AS maker, p_type AS kind, p_size AS size, CAST(floor(p_retailprice) AS BIGINT) AS price, coalesce(sold, 0) AS sold, coalesce(pieces, 0) AS pieces
 FROM @part JOIN @supplier ON s_suppkey = CAST((p_partkey - p_partkey % 20) / 20 AS BIGINT)
 LEFT JOIN (SELECT l_partkey, count(*) AS sold, CAST(sum(l_quantity) AS BIGINT) AS pieces FROM @lineitem GROUP BY l_partkey) AS l ON l_partkey = p_partkey)"""
#: What a card says of the price: mostly the price, else the contact phrase, else nothing.
TERMS = f"CASE WHEN n % 6 = 5 THEN 'Liên hệ báo giá' WHEN n % 9 = 8 THEN '' ELSE 'Giá ' || {money('price')} END"
#: Offers by catalog page (g, from 0): the last cards of a page stand on the next one too.
LISTED = f"""(SELECT *, CAST((n - n % {CARDS}) / {CARDS} AS INT) AS g, {TERMS} AS terms FROM {OFFERS} AS o UNION ALL
 SELECT *, CAST((n - n % {CARDS}) / {CARDS} AS INT) + 1 AS g, {TERMS} AS terms FROM {OFFERS} AS o WHERE n % {CARDS} >= {CARDS - REPEATED} AND n < {2 * CARDS})"""
CATALOG_URL = f"{SITE} || CASE WHEN g = 0 THEN '/c' ELSE '/c?page=' || (g + 1) END"
#: Cards of a page put together in order: the engines differ in how they aggregate text.
CARD = """'<div class="card"><h3><a href="/p/' || k || '">' || title || '</a></h3>' || CASE WHEN terms = '' THEN '' ELSE '<p>' || terms || '</p>' END || '</div>'"""
PAGES_DECLARED = "CASE WHEN s % 4 = 3 THEN 4 ELSE 3 END"  # every fourth shop says that it has a page more than there is
CATALOGS = f"""(SELECT 1000000 + s * 1000 + g AS page_id, {CATALOG_URL} AS url, '<html><head><title>Shop</title></head><body><nav><ul><li><a href="/">Trang chủ</a></li><li><a href="/cart">Giỏ hàng</a></li></ul></nav><main>' || cards
 || '<p>Page ' || (g + 1) || ' / ' || {PAGES_DECLARED} || ' <a href="/c?page=1">1</a> <a href="/c?page=2">2</a> <a href="/c?page=3">3</a> <a href="/x">·</a> <a href="/y">·</a> <a href="/z">·</a></p></main></body></html>' AS html FROM (SELECT s, g, @joined({CARD}; n) AS cards FROM {LISTED} AS x GROUP BY s, g) AS y)"""
LD = lambda body: f"""'<script type="application/ld+json">{body}</script>'"""
RATED = """"aggregateRating":{"ratingValue":"' || k % 6 || '.5","reviewCount":' || sold || '}"""
PRODUCT_LD = case(
    "k",
    "''", LD("""{"@type":"Product","name":"' || title || '","offers":{"price":' || price || '000,"availability":"https://schema.org/InStock"},""" + RATED + "}"),
    LD("""{"@graph":[{"@type":"WebPage","name":"no"},{"@type":"product","name":"' || title || '","offers":{"lowPrice":' || (price + k % 3) || '000}}]}"""),
    LD("""[{"@type":"Thing","name":"no"},{"@type":["X","PRODUCT"],"name":"' || title || '","offers":[{"price":' || price || '500}],""" + RATED + "}]"),
    LD("{broken") + " || " + LD("""{"@type":"Product","name":"' || title || '","offers":{"price":"' || price || '.000"}}"""),
    LD("""{"@type":"WebPage","mainEntity":{"@type":"Product","name":"hidden"}}"""),
)
SPEC = case("k", "'ISO'", "'mirrorless cảm biến ISO'", "'quay video 4K'")
MADE = case("s + n", "'chính hãng'", "'hàng cũ 99%'", "''")
PRODUCT_PAGES = f"""(SELECT 1000000 + s * 1000 + 100 + n AS page_id, {SITE} || '/p/' || k AS url, '<html><head><title>' || title || '</title>' || {PRODUCT_LD} || '</head><body><main>' || CASE WHEN k % 11 = 10 THEN '' ELSE '<h1>' || title || ' ' || {MADE} || '</h1>' END
 || CASE WHEN n % 3 = 0 THEN '<p>Giá: ' || {money('(price + k % 2)')} || '</p>' ELSE '' END || CASE WHEN n % 4 = 0 THEN '' ELSE '<p>Tình trạng: còn ' || pieces || '</p>' END || '<p>Phụ kiện: dây ' || size || '</p>'
 || CASE WHEN n % 5 = 0 THEN '<p>Bảo hành: ' || size || ' tháng</p>' ELSE '' END || CASE WHEN n % 7 = 0 THEN '<p>Đặt cọc ' || size || '%</p>' ELSE '' END || CASE WHEN n % 6 = 0 THEN '<p>Combo:</p><p>túi ' || maker || '</p>' ELSE '' END
 || CASE WHEN k % 4 = 1 THEN '<h2>Tóm tắt sản phẩm:</h2><p>gọn nhẹ ' || kind || '</p><p>Thông số kỹ thuật</p>' ELSE '' END || '<table><tr><td>Loại</td><td>' || {SPEC} || '</td></tr><tr><td>' || kind || '</td></tr></table></main></body></html>' AS html FROM {OFFERS} AS o WHERE k % 15 <> 14)"""
KIDS = f"""CASE WHEN s % 3 > 0 THEN '<li><a href="/r/0">Máy  0</a></li>' ELSE '' END || CASE WHEN s % 3 > 1 THEN '<li><a href="/r/1">Máy  1</a></li><li><a href="/r/0">MÁY 0</a></li><li><a href="/r">' || {ROOT} || '</a></li>' ELSE '' END"""
BESIDE = """CASE WHEN s % 2 = 1 THEN '<li class="off"><a href="/ghost">Ẩn</a></li>' ELSE '' END || CASE WHEN s % 5 > 0 THEN '<li><a href="/b" title="Giá thuê theo ngày">Bên</a></li>' ELSE '' END
 || CASE WHEN s % 5 > 1 THEN '<li><a href="/b">BÊN</a></li><li><a href="/danh-muc">Danh mục</a></li>' ELSE '' END || CASE WHEN s % 5 > 2 THEN '<li><a href="/cart" aria-label="Giỏ hàng">G</a></li>' ELSE '' END"""
HOMES = f"""(SELECT 1000000 + s AS page_id, {SITE} || '/' AS url, '<html><head><title>' || name || '</title><style>.off{{display:none}}</style></head><body><nav><ul><li class="root"><a href="/r">' || {ROOT} || '</a><ul>' || {KIDS} || '</ul><i></i></li>' || {BESIDE} || '</ul></nav><p>'
 || {case('nation', "'Camera moi'", "'second-hand'", "'xin chào'")} || '</p></body></html>' AS html FROM {SHOPS} AS x)"""

#: Rows made for each relation of fixtures.py, with its columns.
MADE_ROWS = {
    "shop": f"SELECT page_id, url, html FROM {CATALOGS} AS c UNION ALL SELECT page_id, url, html FROM {PRODUCT_PAGES} AS p",
    "shop_seeds": f"SELECT 100 + s AS ord, {SITE} || '/c' AS url, {INTENT} AS intent, 'Shop ' || s AS label FROM {SHOPS} AS x",
    "json_pages": f"SELECT page_id, url, html FROM {PRODUCT_PAGES} AS p",
    "menus": f"SELECT page_id, url, html FROM {HOMES} AS h",
    "urls": """SELECT 1000 + 3 * page_id AS id, url AS u FROM @pages UNION ALL SELECT 1001 + 3 * page_id, url || CASE WHEN contains(url, '?') THEN '&' ELSE '?' END || 'utm_source=x&b=2&a=1&page=1&q' FROM @pages
 UNION ALL SELECT 1002 + 3 * page_id, 'HTTP://U@Www.' || page_id || '.Ex.COM:80/page/' || page_id || '?p=' || page_id % 3 || '&page=' || page_id % 2 || '#x' FROM @pages""",
    "hrefs": f"SELECT 1000 + page_id AS id, {case('page_id', *[q for q in ("'../x' || page_id", "'?p=' || page_id", "'/a/./b/../' || page_id", "'//cdn.x/' || page_id", "'#' || page_id", "'c/d?x=../y'", "'mailto:a' || page_id || '@b.c'", "' ./e/.. '", "'../../../f/' || page_id || '/..'")])} AS href, url AS page FROM @pages",
    "nodes": f"SELECT 1000 + s AS page_id, n + 1 AS ord, {case('n', 'title', 'upper(title)', chr(39) + 'Xem' + chr(39))} AS text, CASE WHEN n % 4 = 3 THEN '' ELSE '/p/' || k % 7 END AS href, CASE WHEN n % 5 = 0 THEN kind ELSE '' END AS aria_label, '' AS title, n * 17 AS x, n % 3 * 20 AS y FROM {OFFERS} AS o",
    "pages": f"SELECT 1000 + s AS page_id, {SITE} || '/' AS url, name AS visible_text FROM {SHOPS} AS x",
    "links": f"SELECT 1000 + s AS page_id, n + 1 AS ord, {case('n', 'title', 'kind', ROOT)} AS text, CASE WHEN n % 4 = 0 THEN {ROOT} ELSE '' END AS title, CASE WHEN n % 6 = 1 THEN title ELSE '' END AS aria_label, {SITE} || {case('n', chr(39) + '/p/' + chr(39) + ' || k', chr(39) + '/' + chr(39), chr(39) + '/cart/' + chr(39) + ' || k')} AS href FROM {OFFERS} AS o",
    "candidates": f"SELECT 1000 + k AS candidate_id, 1000 + s AS page_id, {case('n', 'upper(title)', ROOT, 'kind', 'maker')} AS text, CASE WHEN n = 19 THEN {SITE} || '/own' ELSE '' END AS href FROM {OFFERS} AS o",
    "cards": f"SELECT {CATALOG_URL} AS page_url, n + 1 AS ord, {SITE} || CASE WHEN n % 10 = 9 THEN '/blog/' ELSE '/p/' END || k || CASE WHEN n % 4 = 0 THEN '?utm_source=c' ELSE '' END AS href, title, title || ' ' || terms AS card, {INTENT} AS intent FROM {LISTED} AS x",
    "visits": f"SELECT {CATALOG_URL} AS page_url, 10 + g AS visit_rank FROM {LISTED} AS x GROUP BY s, g",
    "edges": f"SELECT {SITE} || '/c' AS url, 1 AS ord, {SITE} || '/c?page=2' AS next_url FROM {SHOPS} AS x UNION ALL SELECT {SITE} || '/c?page=2', 2, {SITE} || '/c?page=3' FROM {SHOPS} AS x UNION ALL SELECT {SITE} || '/c?page=3', 3, {SITE} || '/c?page=4' FROM {SHOPS} AS x WHERE s % 4 = 3 UNION ALL SELECT {SITE} || '/c?page=3', 1, 'https://shop' || (s + 1) || '.vn/c?page=2' FROM {SHOPS} AS x",
    "seeds": f"SELECT 100 + s AS ord, {SITE} || '/c' AS url, {INTENT} AS intent, 'Shop ' || s AS label FROM {SHOPS} AS x",
    "loaded": f"SELECT {SITE} || '/c' AS url FROM {SHOPS} AS x UNION ALL SELECT {SITE} || '/c?page=2' FROM {SHOPS} AS x UNION ALL SELECT {SITE} || '/c?page=3' FROM {SHOPS} AS x WHERE s % 5 > 0",
    "roots": f"SELECT 'shop' || s AS site, n AS ord, '/c' || n % 6 AS url, {INTENT} AS intent, title AS label, (k * 7) % 10 > 6 AS accepted, s % 3 > 0 AND n % 2 = 0 AS explicit FROM {OFFERS} AS o",
    "modes": f"SELECT 'shop' || s AS site, {case('s', chr(39) + 'RENTAL' + chr(39), chr(39) + 'MIXED' + chr(39))} AS site_mode FROM {SHOPS} AS x",
    "details": f"""SELECT {SITE} || '/p/' || k AS url, CASE WHEN k % 11 = 10 THEN '' ELSE title END AS h1, {SPEC} || ' ' || {MADE} AS body_text, CASE WHEN k % 3 = 0 THEN title ELSE '' END AS json_name, CASE WHEN k % 4 = 1 THEN price || '.000' END AS json_price_str, CASE WHEN k % 4 = 2 THEN CAST(price * 1000 + k % 3 AS DOUBLE) END AS json_price_num,
 CASE WHEN n % 3 = 1 THEN 'https://schema.org/InStock' ELSE '' END AS json_availability, k % 7 || '.5' AS json_rating, CAST(sold AS STRING) AS json_review_count, CASE WHEN n % 4 = 3 THEN {money('price')} ELSE '' END AS dom_price, CASE WHEN n % 2 = 0 THEN 'còn ' || pieces ELSE '' END AS stock,
 CASE WHEN n % 3 = 0 THEN 'dây ' || size ELSE '' END AS accessories, CASE WHEN n % 5 = 0 THEN size || ' tháng' ELSE '' END AS warranty, kind AS summary, 'cọc ' || size || '%' AS rental_conditions, CASE WHEN n % 6 = 0 THEN 'túi' ELSE '' END AS bundle FROM {OFFERS} AS o WHERE k % 15 <> 14""",
    "listed": f"SELECT {SITE} || '/p/' || k AS url, title, {INTENT} AS intent, {TERMS} AS price_text FROM {OFFERS} AS o",
    "probed": f"SELECT 1000 + s AS candidate_id, {SITE} || '/c' AS url, {INTENT} AS intent FROM {SHOPS} AS x",
    "probe_pages": f"SELECT {SITE} || '/c' AS url, name AS title, {ROOT} || {case('nation', chr(39) + ' bảo hành chính hãng' + chr(39), chr(39) + ' giá thuê' + chr(39), chr(39) + ' 99%' + chr(39))} AS body FROM {SHOPS} AS x WHERE s % 9 < 8",
    "probe_links": f"SELECT {SITE} || '/c' AS url, {SITE} || {case('n', chr(39) + '/p/' + chr(39) + ' || k', chr(39) + '/c?page=' + chr(39) + ' || n', chr(39) + '/page/' + chr(39) + ' || n')} || '#' || n AS href, {case('n', 'title', 'CAST(n AS STRING)', chr(39) + 'Next' + chr(39))} AS text, CASE WHEN s % 5 > 0 THEN title || ' ' || {TERMS} ELSE '' END AS near FROM {OFFERS} AS o",
    "turning": f"SELECT {SITE} || '/c?x=' || s || {case('s', chr(39) + chr(39), chr(39) + '&page=2' + chr(39), chr(39) + '&p=3&b=1' + chr(39))} AS page_url, 'Máy ảnh Page ' || (1 + s % 3) || ' / ' || (1 + s % 6) AS region_text FROM {SHOPS} AS x",
    "turns": f"SELECT {SITE} || '/c?x=' || s || {case('s', chr(39) + chr(39), chr(39) + '&page=2' + chr(39), chr(39) + '&p=3&b=1' + chr(39))} AS page_url, n AS ord, {SITE} || {case('n', chr(39) + '/c?x=' + chr(39) + ' || s || ' + chr(39) + '&page=' + chr(39) + ' || n', chr(39) + '/z?p=2' + chr(39), chr(39) + '/c?p=' + chr(39) + ' || n', chr(39) + '/c?page=next' + chr(39))} AS href FROM {OFFERS} AS o WHERE s % 7 > 0",
}


def relation(literal: str, name: str) -> str:
    """The rows of a fixture, and those made of the folder's tables after it."""
    return f"(SELECT * FROM {literal} AS f UNION ALL {MADE_ROWS[name]})" if name in MADE_ROWS else literal


#: Relations whose rows take much work each, and the key that they are dealt out by: their tables are small, and Spark
#: would read them, and what it makes of them, in a task or two.
SPREAD = {"shop": "page_id", "json_pages": "page_id", "menus": "page_id", "details": "url", "listed": "url"}


def parts(spark) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)


def spread(rows: DataFrame, key: str) -> DataFrame:
    """rows over as many tasks as the session has room for, however few they were made in."""
    return rows.repartition(parts(rows.sparkSession), key)


_TABLE = re.compile(r"@(part|supplier|lineitem|pages)\b")
_JOINED = re.compile(r"@joined\((.*?); (\w+)\)", re.S)


def spark_sql(sql: str, sf_dir: str) -> str:
    """A relation for spark.sql, over the Parquet files of a folder."""
    sql = _JOINED.sub(r"array_join(transform(array_sort(collect_list(struct(\2, \1 AS c))), x -> x.c), '')", sql)
    return _TABLE.sub(lambda m: f"parquet.`{sf_dir}/{m[1]}.parquet`", sql)


def duck_sql(sql: str) -> str:
    """A relation for DuckDB, over views of the same names."""
    return _TABLE.sub(r"\1", _JOINED.sub(r"string_agg(\1, '' ORDER BY \2)", sql))
