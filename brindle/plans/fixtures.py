"""Small tables of commerce pages with the odd cases, as SQL that Spark and DuckDB both read; shops.py has the large ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from brindle.plans import shops


def _literal(v: object) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).upper()
    if isinstance(v, str):
        return "'" + v.replace("'", "''") + "'"
    if isinstance(v, float):
        return f"CAST({v!r} AS DOUBLE)"
    return str(v)


def relation(columns: str, rows: list[tuple]) -> str:
    """A subquery of literal rows."""
    return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(_literal, r)) + ')' for r in rows)}) AS v({columns}))"


def literal(spark: SparkSession, name: str) -> DataFrame:
    """A fixture's own rows."""
    return spark.sql(f"SELECT * FROM {TABLES[name]} AS t")


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A fixture's own rows and those made of a folder's tables."""
    rows = spark.sql(f"SELECT * FROM {shops.spark_sql(shops.relation(TABLES[name], name), sf_dir)} AS t")
    return shops.spread(rows, shops.SPREAD[name]) if name in shops.SPREAD else rows


NODES = relation("page_id, ord, text, href, aria_label, title, x, y", [
    (1, 1, "Cho thuê máy ảnh", "/thue", "", "", 10, 10), (1, 2, "Máy ảnh cũ", "/cu", "", "", 90, 10), (1, 3, "Đăng nhập", "/dang-nhap", "", "", 200, 10),
    (2, 1, "Máy ảnh cũ", "/may-anh-cu", "", "", 10, 10), (2, 2, "Máy ảnh chính hãng", "/moi", "", "", 50, 10), (2, 3, "Ống kính máy ảnh", "/lens", "", "", 90, 10),
    (3, 1, "Thuê", "/", "", "Giá thuê theo ngày", 0, 0), (4, 1, "Máy ảnh cũng đẹp", "/dep", "", "", 0, 0), (5, 1, "New  camera", "/new", "Camera", "", 0, 0),
    (5, 2, "Thuê máy ảnh cũ", "/thue-cu", "", "", 5, 5), (5, 3, "Camera", "/camera", "", "", 0, 9), (5, 4, "Máy ảnh mới & phụ kiện", "/x", "", "", 3, 3), (6, 1, "", "", "", "", 0, 0),
])
PAGES = relation("page_id, url, visible_text", [
    (1, "https://shop.vn/", "Trang chủ"), (2, "https://www.two.vn/", "second-hand"), (3, "https://three.vn/", ""), (4, "https://four.vn/", ""),
    (5, "https://five.vn/a", "Camera moi"), (6, "https://six.vn/", "cho thuê"), (7, "https://seven.vn/", "nothing here"),
])
LINKS = relation("page_id, ord, text, title, aria_label, href", [
    (1, 1, "Danh mục", "", "", "https://shop.vn/danh-muc"), (1, 2, "Thuê máy", "Cho thuê máy ảnh", "", "https://shop.vn/thue"), (1, 3, "Giỏ hàng", "", "", "https://shop.vn/cart"),
    (1, 4, "Sản phẩm", "", "", "https://shop.vn/san-pham"), (1, 5, "Ngoài", "", "", "https://other.vn/danh-muc"), (1, 6, "Sản phẩm", "", "", "https://shop.vn/products"),
    (2, 1, "Máy ảnh cũ", "", "Máy ảnh cũ", "https://www.two.vn/may-anh-cu"), (2, 2, "Home", "", "", "https://www.two.vn/"), (2, 3, "Máy ảnh cũ giá rẻ", "", "", "https://www.two.vn/re"),
])
CANDIDATES = relation("candidate_id, page_id, text, href", [(1, 1, "Cho thuê máy ảnh", ""), (2, 2, "MÁY ẢNH CŨ", ""), (3, 2, "Tin", "https://www.two.vn/tin"), (4, 3, "Gì đó", "")])
CARDS = relation("page_url, ord, href, title, card, intent", [
    ("https://s.vn/c", 1, "https://s.vn/p/canon-r50?utm_source=a", "Canon EOS R50", "Canon EOS R50 19.900.000đ", "NEW"), ("https://s.vn/c", 2, "https://s.vn/p/canon-r50", "Canon EOS R50 (again)", "Canon EOS R50 liên hệ báo giá", "NEW"),
    ("https://s.vn/c", 3, "https://s.vn/cart", "Canon R5", "Canon R5 100đ", "NEW"), ("https://s.vn/c", 4, "https://s.vn/p/pin", "Pin Canon LP-E6", "Pin 500.000đ", "NEW"),
    ("https://s.vn/c", 5, "https://s.vn/c?p=2", "Canon 2", "Canon 2 100đ", "NEW"), ("https://s.vn/c", 6, "https://s.vn/home", "Trang chủ", "100đ", "NEW"),
    ("https://s.vn/c", 7, "https://s.vn/p/sony", "Sony Alpha", "Sony Alpha", "NEW"), ("https://s.vn/c?p=2", 1, "https://s.vn/p/canon-r50", "Canon R50 other", "còn hàng", "SECOND_HAND"),
    ("https://s.vn/c?p=2", 2, "https://s.vn/p/nikon", "Nikon D850", "Nikon D850 Liên hệ báo giá", "SECOND_HAND"), ("https://s.vn/c?p=2", 3, "https://s.vn/p/the", "Thẻ nhớ Sony 64GB", "1.000 VND", "SECOND_HAND"),
])
TEXTS = relation("id, title, body", [
    (1, "Canon EOS R50", "mirrorless cảm biến ISO 100 RF-mount"), (2, "Sony Alpha Body", ""), (3, "Sony ZV-E10", "E-mount"), (4, "Sony Alpha", ""), (5, "Máy ảnh", "quay video chất lượng 4K 60fps"),
    (6, "X", "thuê phụ kiện cảm biến ISO fps"), (7, "X", "thuê phụ kiện cảm biến ISO"), (8, "Canon", "product description"), (9, "X photobooth", "cảm biến"), (10, "Pin Canon LP-E6", "mirrorless"), (11, "Thẻ nhớ 64GB", ""),
    (12, "", ""), (13, "Body", "Loại pin: LP, dung lượng 1040 mAh, hàng cũ 99%"), (14, "Lensbaby", "chính hãng focused"),
])
VALUES_ = relation("id, t", [
    (1, "1.990.000đ"), (2, "1990000.00"), (3, "500.000đ - 600.000đ"), (4, "-5"), (5, "1e3"), (6, "Liên hệ báo giá"), (7, ""), (8, "0"), (9, None), (10, "4.5"), (11, "4.5d"), (12, "6"), (13, "Kit 2 đèn"), (14, "Page 2 / 17 pages"),
    (15, "giá 1,500,000 VND thôi"), (16, "  Đặc\u00a0biệt   Ếch ộp "), (17, "12"), (18, "7.5"), (19, "LIÊN HỆ BÁO GIÁ ngay"), (20, "page 1/3"),
])
URLS = relation("id, u", [
    (1, "HTTP://Ex.COM:80/a?b=2&a=1&a=0#h"), (2, "https://e.com"), (3, "https://e.com/a/?"), (4, "https://e.com/c?page=1&utm_source=x"), (5, "https://e.com/c?p=10&fbclid=z"), (6, "not a url"), (7, "https://www.e.com/c?p=1&p=2&q"),
    (8, "https://u@host.net:8080/page/3?x=1"), (9, ""), (10, None), (11, "https://e.com:443/x#y?z=1"), (12, "https://e.com/c?page=2&p=3"),
])
LINES = relation("id, body", [
    (1, "Máy ảnh\nGiá: 500k\nTình trạng: còn hàng\nPhụ kiện: pin, sạc\nBảo hành: 12 tháng"), (2, "Giá:\n500k\nTrạng thái\nhết"), (3, "Giá thuê: 200k\nprice: 5"), (4, "x\nGiá:"),
    (5, "Tóm tắt sản phẩm:\nmột\n\nhai\nThông số kỹ thuật\nba\ncọc 50%\nPhí trễ 10%"), (6, ""), (7, "Combo\nmáy + túi\nAvailability\n  In stock "), (8, "TÓM TẮT SẢN PHẨM\nchỉ một"), (9, None),
])
EDGES = relation("url, ord, next_url", [
    ("https://s.vn/c", 1, "https://s.vn/c?p=2"), ("https://s.vn/c", 2, "https://s.vn/c?p=3"), ("https://s.vn/c?p=2", 1, "https://s.vn/c"), ("https://s.vn/c?p=2", 2, "https://s.vn/c?p=4"), ("https://s.vn/d", 1, "https://s.vn/d?p=2"), ("https://s.vn/d?p=2", 1, "https://s.vn/c?p=2"), ("https://s.vn/c?p=4", 1, "https://s.vn/c?p=4"),
])
SEEDS = relation("ord, url, intent, label", [(1, "https://s.vn/c", "NEW", "New"), (2, "https://s.vn/d", "SECOND_HAND", "Old"), (3, "https://s.vn/c#x", "RENTAL", "Rent")])
LOADED = relation("url", [("https://s.vn/c",), ("https://s.vn/d",), ("https://s.vn/c?p=2",), ("https://s.vn/d?p=2",), ("https://s.vn/c?p=4",)])
ROOTS = relation("site, ord, url, intent, label, accepted, explicit", [
    ("a", 1, "/1", "NEW", "n", True, True), ("a", 2, "/1", "RENTAL", "again", True, True), ("a", 3, "/2", "NEW", "no", False, True), ("a", 1, "/g", "RENTAL", "g", True, False),
    ("b", 1, "/x", "RENTAL", "x", False, False), ("b", 2, "/y", "RENTAL", "y", True, False), ("b", 3, "/z", "RENTAL", "z", True, False), ("c", 1, "/q", "RENTAL", "q", True, False),
])
MODES = relation("site, site_mode", [("a", "RENTAL"), ("b", "RENTAL"), ("c", "MIXED")])
DETAILS = relation("url, h1, body_text, json_name, json_price_str, json_price_num, json_availability, json_rating, json_review_count, dom_price, stock, accessories, warranty, summary, rental_conditions, bundle", [
    ("https://www.s.vn/1", "Canon EOS R50", "mirrorless cảm biến ISO 100 RF-mount", "", None, 19900000.0, "https://schema.org/InStock", "4.5", "12.5", "", "", "pin", "12 tháng", "gọn  nhẹ", "cọc", "túi"),
    ("https://s.vn/2", "", "E-mount cho thuê", "Sony ZV-E10", "500.000", None, "", None, None, "450.000đ", "còn hàng", "", "", "", "cọc 50%", ""),
    ("https://s.vn/3", "Pin Canon", "x", "", None, None, "", "9", "-1", "", "", "", "", "", "", ""), ("https://s.vn/4", "Sony Alpha Body", "", "", None, None, "", "", "", "100đ", "", "", "1 năm", "", "", ""),
])
LISTED = relation("url, title, intent, price_text", [
    ("https://www.s.vn/1", "R50", "NEW", "19.500.000đ"), ("https://s.vn/2", "ZV", "CAMERA_GENERIC", "500.000đ"), ("https://s.vn/3", "Pin", "NEW", ""), ("https://s.vn/4", "Alpha", "CAMERA_GENERIC", "Liên hệ báo giá"), ("https://s.vn/5", "Gone R5", "RENTAL", "300.000đ"),
])
PROBED = relation("candidate_id, url, intent", [(1, "https://s.vn/c", "NEW"), (2, "https://s.vn/c", "RENTAL"), (3, "https://s.vn/none", "NEW"), (4, "https://s.vn/d", "CAMERA_GENERIC")])
PROBE_PAGES = relation("url, title, body", [("https://s.vn/c", "Máy ảnh", "Máy ảnh chính hãng Canon"), ("https://s.vn/d", "Sony", "gì đó")])
PROBE_LINKS = relation("url, href, text, near", [
    ("https://s.vn/c", "https://s.vn/p/1#a", "Canon R5", "Canon R5 100.000đ"), ("https://s.vn/c", "https://s.vn/p/1#b", "Canon R5", "100.000đ"), ("https://s.vn/c", "https://s.vn/p/2", "Nikon", "Nikon"), ("https://s.vn/c", "https://s.vn/c?p=2", "2", ""),
    ("https://s.vn/c", "https://s.vn/c?p=3", "Next", ""), ("https://s.vn/d", "https://s.vn/page/2", "xem", ""), ("https://s.vn/d", "https://s.vn/p/9", "Sony A7", "Sony A7 2.000.000 vnd"),
])
LD = '<html><body><h1>x</h1><script type="application/ld+json">{}</script></body></html>'
JSON_PAGES = relation("page_id, url, html", [
    (1, "https://s.vn/1", LD.replace("{}", '{"@type":"Product","name":"R5","offers":{"price":"1.200.000","availability":"InStock"}}')),
    (2, "https://s.vn/2", LD.replace("{}", '[{"@type":"Thing","name":"no"},{"@type":["X","PRODUCT"],"name":"A7","offers":[{"price":150000}],"aggregateRating":{"ratingValue":4.5,"ratingCount":12}}]')),
    (3, "https://s.vn/3", LD.replace("{}", "{broken") + LD.replace("{}", '{"@graph":[{"@type":"WebPage"},{"@type":"product","name":"D850","offers":{"lowPrice":7}}]}')),
    (4, "https://s.vn/4", LD.replace("{}", '{"@type":"WebPage","mainEntity":{"@type":"Product","name":"hidden"}}')), (5, "https://s.vn/5", None),
])
VISITS = relation("page_url, visit_rank", [("https://s.vn/c", 2), ("https://s.vn/c?p=2", 1)])
TURNING = relation("page_url, region_text", [("https://s.vn/c", "Page 1 / 3"), ("https://s.vn/d?x=1", "page 1/2"), ("https://s.vn/e", "Page 1/1"), ("https://s.vn/f?page=2&y=1&b=2", "xem Page 2 / 12 trang"), ("https://s.vn/g", "")])
TURNS = relation("page_url, ord, href", [
    ("https://s.vn/c", 1, "https://s.vn/c?page=2"), ("https://s.vn/c", 2, "https://s.vn/z?p=2"), ("https://s.vn/d?x=1", 1, "https://s.vn/d?x=1&p=5"), ("https://s.vn/f?page=2&y=1&b=2", 1, "https://s.vn/f?page=next"),
    ("https://s.vn/f?page=2&y=1&b=2", 2, "https://s.vn/f?page=3&y=1"), ("https://s.vn/g", 1, "https://s.vn/g?p=1"), ("https://s.vn/g", 2, "https://other.vn/g?p=7"), ("https://s.vn/g", 3, "https://s.vn/g?p=9&utm_source=x"),
])
HREFS = relation("id, href, page", [(i, h, "https://s.vn/x/y?z=1#old") for i, h in enumerate([
    "//cdn.x.com/a", "mailto:a@b.c", "javascript:void(0)", "#top", "", "?p=2", "/a/b?c=1#d", "b", "./b", "../b", "../../../b/..", "/a/./b/../c/.", "/a/b/../../c?x=../y", "HTTP://Other.vn/q", "b/c/../d#e/../f", None, " /spaced ", "..", "/..a/b", "...",
])])
BRANDS = ("Canon EOS R", "Sony Alpha A", "Nikon Z", "Fujifilm X-T", "Pin Canon LP-")


def _product(k: int) -> tuple[str, str, int]:
    return f"{BRANDS[k % len(BRANDS)]}{k}", f"/p/{k}", 1_000_000 + 37_000 * k


def _shop() -> list[tuple]:
    """A shop of 120 products on six catalog pages of 24 cards (four of them on the page before too); each fifteenth has no page of its own."""
    head, rows = '<html><head><title>Shop</title></head><body><nav><ul><li><a href="/">Trang chủ</a></li><li><a href="/cart">Giỏ hàng</a></li></ul></nav><main>', []
    for n in range(6):
        cards = "".join(f'<div class="card"><h3><a href="{link}">{name}</a></h3><p>Giá {price:,} đ</p></div>' for name, link, price in map(_product, range(max(20 * n - 4, 0), 20 * n + 20)))
        rows.append((f"https://shop.vn/c?page={n + 1}" if n else "https://shop.vn/c", f"{head}{cards}<p>Page {n + 1} / 6 <a href=\"/c?page=2\">2</a></p></main></body></html>"))
    for k in range(120):
        name, link, price = _product(k)
        ld = "" if k % 4 == 0 else f'<script type="application/ld+json">{{"@type":"Product","name":"{name}","offers":{{"price":{price + (500 if k % 7 == 0 else 0)}}}}}</script>'
        text = "mirrorless cảm biến ISO" if k % 3 else "ISO"
        if k % 15:
            rows.append((f"https://shop.vn{link}", f"<html><head><title>{name}</title>{ld}</head><body><main><h1>{name} chính hãng</h1><p>Tình trạng: còn {k}</p><p>Phụ kiện: dây {k}</p><table><tr><td>Loại</td><td>{text}</td></tr></table></main></body></html>"))
    return [(i, *r) for i, r in enumerate(rows)]


def _menus() -> list[tuple]:
    """40 pages with a root in a list item: with one to three links below it (of the longer lists one twice, and the root again) or none, and links beside it."""
    rows = []
    for k in range(40):
        kids = "".join(f'<li><a href="/r{k}/{j}">Máy  {j}</a></li>' for j in range(k % 4)) + f'<li><a href="/r{k}/0">MÁY 0</a></li><li><a href="/r{k}">Gốc</a></li>' * (k % 4 > 1)
        beside = "".join(f'<li><a href="/b{j}">Bên {j % 2}</a></li>' for j in range(k % 3))
        rows.append((k, f"https://s{k}.vn/", f'<html><body><nav><ul><li class="root"><a href="/r{k}">Gốc</a><ul>{kids}</ul><i></i></li>{beside}</ul></nav><p>{k}</p></body></html>'))
    return rows


MENUS = relation("page_id, url, html", _menus())
SHOP = relation("page_id, url, html", _shop())
SHOP_SEEDS = relation("ord, url, intent, label", [(1, "https://shop.vn/c", "NEW", "New")])
TABLES = {
    "visits": VISITS, "menus": MENUS, "turning": TURNING, "turns": TURNS, "hrefs": HREFS, "shop": SHOP, "shop_seeds": SHOP_SEEDS,
    "json_pages": JSON_PAGES,
    "nodes": NODES, "pages": PAGES, "links": LINKS, "candidates": CANDIDATES, "cards": CARDS, "texts": TEXTS, "values": VALUES_, "urls": URLS, "lines": LINES, "edges": EDGES, "seeds": SEEDS,
    "loaded": LOADED, "roots": ROOTS, "modes": MODES, "details": DETAILS, "listed": LISTED, "probed": PROBED, "probe_pages": PROBE_PAGES, "probe_links": PROBE_LINKS,
}
#: The same for DuckDB: a fixture's rows and those made of the folder's tables.
ALL = {name: shops.duck_sql(shops.relation(rows, name)) for name, rows in TABLES.items()}
