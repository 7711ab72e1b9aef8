"""The shredder, the crawl, tree joins and the report."""

from __future__ import annotations

import random
import tracemalloc

import pytest
from pyspark.sql import functions as F

from brindle.operators import extract, pages, records, site
from brindle.plans import catalog, fixtures
from brindle.sources import corpus, html

PAGE = """<html><head><title> A  shop </title><script>var t="</p>";</script><script type="application/ld+json">{bad</script>
<script type="application/ld+json">{"@graph":[{"@type":"Thing"},{"@type":["X","Product"],"name":"Cam","offers":[{"price":"","lowPrice":5}],"aggregateRating":{"ratingValue":4.5,"ratingCount":3}}]}</script></head>
<body><nav><ul><li><a href="/a">One</a><li><a href="/b" aria-label="two"></a></ul></nav><main id="x"><h1>Hi<br>there</h1><p>first<p>second <b>bold</b>
<div style="display: none"><a href="/h">hidden</a></div><table><tr><td>k<td>v</table></main></body></html>"""


def test_shredded_page():
    got = html.shred_text(PAGE)
    assert got["title"] == "A shop" and got["table_rows"] == ["k v"]
    assert got["lines"] == ["One", "Hi", "there", "first", "second bold", "k", "v"]
    links = [n for n in got["nodes"] if n["tag"] == "a"]
    assert [(n["href"], n["interactive"]) for n in links] == [("/a", True), ("/b", True), ("/h", False)]
    assert [n["tag"] for n in got["nodes"] if n["main"]] == ["main"]
    text = lambda n: got["text"][n["start"] : n["end"]].strip()
    assert text(next(n for n in got["nodes"] if n["main"])) == "Hi there first second bold hidden k v"
    main = next(n for n in got["nodes"] if n["main"])
    assert got["region"] == {"first": main["node_id"], "last": main["last"]}
    assert got["shown"][main["shown_start"] : main["shown_end"]].strip() == "Hi there first second bold k v"


PRODUCTS = [
    (['{"@graph":[{"@type":"Thing"},{"@type":["X","Product"],"name":"Cam","offers":[{"price":"","lowPrice":5}],"aggregateRating":{"ratingValue":4.5,"ratingCount":3}}]}'], ("Cam", "", None, "", "4.5", "3")),
    (['{"offers": 1}', "[]", "3", "{broken", ""], ("", None, None, "", None, None)),
    (['[[{"@type":"thing"}],[[{"@graph":{"@type":"PRODUCT","name":"deep","offers":{"price":null,"lowPrice":7.25}}}]]]'], ("deep", None, 7.25, "", None, None)),
    (['{"@type":"Thing","mainEntity":{"@type":"Product","name":"hidden"}}'], ("", None, None, "", None, None)),
    (['{"@type":"Product","name":"first","offers":[],"@graph":[{"@type":"Product","name":"below"}]}', '{"@type":"Product","name":"later"}'], ("first", "", None, "", None, None)),
    (None, ("", None, None, "", None, None)),
]


def test_embedded_product(spark):
    rows = spark.createDataFrame([(i, None, s) for i, (s, _) in enumerate(PRODUCTS)], "page_id long, url string, jsonld array<string>")
    found = extract.products(rows)
    got = {r["page_id"]: tuple(r)[2:] for r in found.collect()}
    assert got == {i: want for i, (_, want) in enumerate(PRODUCTS)}
    assert "Python" not in found._jdf.queryExecution().executedPlan().toString()


SHEET = """/* . */ @import 'x'; .off, p.gone { display: none } a.ghost{visibility:hidden;color:red}@media print{.paper{display:none}} #thin{display:block;width:0px}
.off#back{display:block} .late{display:none!important} .late{display:inline} nav a{display:none} .flat{height:0}"""
SEEN = [
    ('<a class="off" href=x>t</a>', False), ('<a class="off" id="back" href=x>t</a>', True), ('<p class="gone"><a href=x>t</a></p>', False), ('<div class="gone"><a href=x>t</a></div>', True), ('<a class="ghost" href=x>t</a>', False),
    ('<b style="visibility:hidden"><a href=x>t</a></b>', False), ('<b style="visibility:hidden"><a style="visibility: visible" href=x>t</a></b>', True), ('<a class="paper" href=x>t</a>', True), ('<a id="thin" href=x>t</a>', False),
    ('<a class="late" href=x>t</a>', False), ('<a class="late" style="display:inline" href=x>t</a>', False), ('<nav><a href=x>t</a></nav>', True), ('<a class="flat" href=x>t</a>', True), ('<button class="flat">t</button>', False),
    ("<div hidden><a href=x>t</a></div>", False), ('<div hidden style="display:block"><a href=x>t</a></div>', True), ("<a href=x></a>", False), ("<a href=x><img></a>", True), ('<a href=x aria-label="n"></a>', True), ("<noscript><a href=x>t</a></noscript>", False),
]


@pytest.mark.parametrize(("body", "seen"), SEEN)
def test_what_style_sheets_hide(body, seen):
    got = html.shred_text(f"<html><head><style>{SHEET}</style></head><body>{body}</body></html>")
    assert [n["interactive"] for n in got["nodes"] if n["control"] >= 0] == [seen]
    assert got["text"].strip() == ("t" if "t<" in body else "")


def test_hidden_parts_are_not_in_the_text_of_what_is_seen(spark):
    page = '<style>.x{display:none}</style><a href="/a">Buy <i class="x">secret</i>now</a><div class="x"><a href="/b">Down</a></div>'
    rows = html.shred(spark.createDataFrame([(1, "https://s.vn/", page)], "page_id long, url string, html string"))
    assert [r["text"] for r in html.nodes(rows).collect()] == ["Buy now"]
    assert [r["text"] for r in extract.page_links(rows).orderBy("ord").collect()] == ["Buy now", "Down"]  # all of it if none is seen
    assert html.visible_text(rows).first()["visible_text"] == "Buy now"


def test_all_controls_of_a_page_are_nodes(spark):
    """However many, with their own texts: characters beyond the first plane, none, and longer than the pieces a text is cut in."""
    texts = [f"é😀 {i}" * (i % 7) for i in range(1500)] + ["w" * (1 << html.PIECE_BITS) * 2 + "\ufeffend", "", "x" * ((1 << html.PIECE_BITS) - 3), "last"]
    page = "".join(f'<p><a href="/{i}">{t}</a><i style="display:none">{i}</i></p><button aria-label="b">😀</button>' if t else f'<a href="/{i}" title="t"></a>' for i, t in enumerate(texts))
    got = html.shred_text(page)
    want = [got["shown"][n["shown_start"] : n["shown_end"]].strip() or got["text"][n["start"] : n["end"]].strip() for n in got["nodes"] if n["interactive"]]
    assert len(want) > 2700 and want[-2:] == ["last", "😀"]
    rows = html.shred(spark.createDataFrame([(1, "https://s.vn/", page), (2, "https://s.vn/", "<a href=/x>y</a>"), (3, "https://s.vn/", "")], "page_id long, url string, html string"))
    found = html.nodes(rows).orderBy("page_id", "ord").collect()
    assert [r["text"] for r in found if r["page_id"] == 1] == want and [r["text"] for r in found if r["page_id"] == 2] == ["y"]
    assert [r["ord"] for r in found if r["page_id"] == 1] == list(range(len(want)))
    assert html.nodes(rows, 300).count() == 301


def test_a_deep_tree_takes_room_in_proportion():
    tracemalloc.start()
    got = html.shred_text("<b>x" * 20_000 + "<a href=/x>y</a>" * 10 + "</p>" * 20_000)
    assert tracemalloc.get_traced_memory()[1] < 200e6 and len(got["nodes"]) == 20_010
    tracemalloc.stop()
    assert got["nodes"][0]["last"] == 20_009 and got["nodes"][0]["link_count"] == 10 and got["nodes"][19_999]["parent"] == 19_998


def test_an_interval_holds_exactly_the_descendants():
    rng = random.Random(4)
    raw = "".join(rng.choice(["<div>", "</div>", "<p>", "<li>", "</ul>", "<ul>", "<b>", "</b>", "t", "<br>", "<a href=x>", "</a>"]) for _ in range(3000))
    nodes = html.shred_text(raw)["nodes"]
    above = lambda n: [] if n["parent"] < 0 else [n["parent"], *above(nodes[n["parent"]])]
    ancestors = [above(n) for n in nodes]
    for n in nodes:
        assert {m["node_id"] for m in nodes if n["node_id"] in ancestors[m["node_id"]]} == set(range(n["node_id"] + 1, n["last"] + 1))
        assert n["link_count"] == sum(m["href"] != "" for m in nodes[n["node_id"] + 1 : n["last"] + 1]) and n["depth"] == len(ancestors[n["node_id"]]) + 1
        assert n["item"] == next((a for a in ancestors[n["node_id"]] if nodes[a]["tag"] == "li"), -1)


@pytest.mark.parametrize("raw", ["", "<a", "</b></b>", "<p>" * 50, "plain", "<a href=x>y"])
def test_odd_html(raw):
    assert isinstance(html.shred_text(raw)["lines"], list)


def test_shredding_at_rest(spark):
    rows = html.shred(spark.createDataFrame([(1, "u", PAGE), (2, "v", None)], "page_id long, url string, html string"))
    assert [r.n for r in rows.orderBy("page_id").select(F.size("nodes").alias("n")).collect()][1] == 0
    assert [(r["id"], r["text"]) for r in html.nodes(rows).orderBy("ord").collect()] == [("n0", "One"), ("n1", "")]
    assert html.visible_text(rows).where("page_id = 1").first()["visible_text"].startswith("One\nHi\nthere")
    assert extract.products(rows).where("json_name = 'Cam'").count() == 1


def test_crawl_is_whole_and_ends(spark):
    frame = lambda n: fixtures.literal(spark, n)
    got = {r.url: r for r in pages.crawl(frame("seeds"), frame("edges"), frame("loaded"), lambda df, n: df.checkpoint()).collect()}
    assert {u for u, r in got.items() if r.status == "failed"} == {"https://s.vn/c?p=3"}
    assert got["https://s.vn/c"].intent == "RENTAL" and got["https://s.vn/c?p=4"].wave == 2


def test_crawl_bound_leaves_the_rest_queued(spark):
    frame = lambda n: fixtures.literal(spark, n)
    got = pages.crawl(frame("seeds"), frame("edges"), frame("loaded"), lambda df, n: df.checkpoint(), most=1).collect()
    assert sorted(r.status for r in got) == ["queued", "visited"]


def _chain(spark, n):
    """A page n links deep whose every link has a large ord, with a second branch of pages at each level."""
    seeds = spark.createDataFrame([(0, "https://c.vn/0", "NEW")], "ord int, url string, intent string")
    edges = spark.createDataFrame([e for k in range(n) for e in ((f"https://c.vn/{k}", 250_000, f"https://c.vn/{k + 1}"), (f"https://c.vn/{k}", 7, f"https://c.vn/side{k}"))], "url string, ord int, next_url string")
    return seeds, edges, spark.createDataFrame([(f"https://c.vn/{k}",) for k in range(n + 1)], "url string")


def test_crawl_of_a_long_chain(spark):
    got = {r.url: r for r in pages.crawl(*_chain(spark, 11), lambda df, n: df.checkpoint()).collect()}
    assert len(got) == 23
    assert all((got[f"https://c.vn/{k}"].wave, got[f"https://c.vn/{k}"].status) == (k, "visited") for k in range(12))
    assert all((got[f"https://c.vn/side{k}"].rank, got[f"https://c.vn/side{k}"].status, got[f"https://c.vn/{k + 1}"].rank) == (0, "failed", 1) for k in range(11))


def test_parts_are_written_a_few_times_each(spark):
    written = []

    def cut(df, name):
        written.append(df.count())
        return df.checkpoint()

    parts = pages.Parts(spark.range(0), cut)
    for k in range(70):
        assert parts.add(spark.range(10 * k, 10 * k + 10)).count() == 10
    assert sorted(r["id"] for r in parts.all().collect()) == list(range(700)) and sum(written) <= 3 * 700


@pytest.mark.parametrize("bounds", [{"most": 2}, {"waves": 2}])
def test_crawl_that_is_cut_has_its_links_queued(spark, bounds):
    """Full exactly at the end of a wave, or out of waves: the links found last are queued."""
    cut = lambda df, n: df.checkpoint()
    seeds, edges, loaded = _chain(spark, 4)
    rows = pages.with_unfollowed(pages.crawl(seeds, edges, loaded, cut, **bounds), edges, cut).collect()
    got = {r.url: r.status for r in rows}
    assert len(got) == len(rows)
    assert got == {"https://c.vn/0": "visited", "https://c.vn/side0": "failed", "https://c.vn/1": "visited", "https://c.vn/2": "queued", "https://c.vn/side1": "queued"}


def test_nearest_ancestor(spark):
    page = "<html><body><div>big <a href=/1>1</a><ul><li>item <b><i><a href=/2>2</a></i></b></li></ul></div><a href=/3>3</a></body></html>"
    rows = html.shred(spark.createDataFrame([(1, "https://s.vn/", page)], "page_id long, url string, html string"))
    near = lambda tag, most: {r["href"][-1]: r["t"] for r in extract.nearest(rows, tag, most, "t").collect()}
    assert near("li", 3) == {"2": "item 2"} and near("li", 2) == {} and near("body", 9) == dict.fromkeys("123", "big 1 item 2 3")
    assert near("a", 9) == {} and near("div", 1) == {"1": "big 1 item 2"}


def test_report_conserves_records(spark):
    rows = records.details(fixtures.literal(spark, "listed"), fixtures.literal(spark, "details"))
    sheets = records.sheets(rows, rows.select("url"), rows.select("url"), spark)
    assert sheets["main"].count() + sheets["excluded"].count() + sheets["review"].count() == rows.count() == 5
    assert sheets["visual_evidence"].count() == 0 and sheets["log"].count() == 1


TREE = """<html><body><div id="top"><a href="/">Home</a></div><ul><li><a href="/cam">Cameras</a><ul><li><a href="/cam/new">New</a></li><li><a href="/cam/old">Old</a></li></ul></li></ul>
<div class="content"><section><div class="card"><h3><a href="/p/r5">Canon R5</a></h3><p>1.000.000 đ</p></div><div class="card"><a href="/p/none" title="Named"></a></div>
<a href="//other.vn/x">Elsewhere</a><a href="mailto:a@b.c">Mail</a></section></div></body></html>"""


@pytest.fixture(scope="module")
def shredded(spark):
    return html.shred(spark.createDataFrame([(1, "https://s.vn/c", TREE)], "page_id long, url string, html string"))


def test_links_of_the_region(shredded):
    got = [(r["href"], r["text"]) for r in extract.page_links(shredded).orderBy("ord").collect()]
    assert got == [("https://s.vn/p/r5", "Canon R5"), ("https://s.vn/p/none", "Named")]
    everything = [r["href"] for r in extract.page_links(shredded, False, False).orderBy("ord").collect()]
    assert everything[-2:] == ["https://other.vn/x", "mailto:a@b.c"] and len(everything) == 8


def test_cards_and_surroundings(shredded):
    got = {r["href"]: (r["title"], r["card"]) for r in extract.cards(shredded).collect()}
    assert got == {"https://s.vn/p/r5": ("Canon R5", "Canon R5 1.000.000 đ"), "https://s.vn/p/none": ("Named", "Canon R5 1.000.000 đ ElsewhereMail")}
    near = {r["href"]: r["near"] for r in extract.surroundings(shredded, True, True, 2).collect()}
    assert near == {"https://s.vn/p/r5": "Canon R5 1.000.000 đ", "https://s.vn/p/none": "Canon R5 1.000.000 đ ElsewhereMail"}


def test_submenu_of_a_root(shredded, spark):
    roots = extract.page_links(shredded, False, False).where("text = 'Cameras'").withColumn("root_id", F.lit(7))
    inside = extract.children(shredded, roots)
    assert [(r["root_id"], r["text"], r["href"]) for r in inside.orderBy("ord").collect()] == [(7, "New", "https://s.vn/cam/new"), (7, "Old", "https://s.vn/cam/old")]
    nodes = html.nodes(shredded)
    assert {r["method"] for r in site.submenu(inside, nodes.where("ord = 0"), nodes).collect()} == {"DOM_CHILDREN"}
    assert {r["method"] for r in site.submenu(inside.where("false"), nodes.where("ord = 0"), nodes).collect()} == {"VISIBLE_DIFF"}


def test_a_page_that_cannot_be_read_is_a_review_row(spark, monkeypatch):
    corpus = spark.createDataFrame([(1, "https://s.vn/p/1", "<h1>Canon R5</h1>")], "page_id long, url string, html string")
    row = html._shredded(5)
    assert row["error"].startswith("TypeError") and row["nodes"] == []
    raw = extract.detail_rows(html.shred(corpus)).withColumn("error", F.lit("ValueError: x"))
    got = records.details(spark.createDataFrame([("https://s.vn/p/1", "Listed", "RENTAL", "5đ")], "url string, title string, intent string, price_text string"), raw).first()
    assert (got["disposition"], got["reason"], got["listing_price"], got["rental_price_per_day"]) == ("review", "detail extraction error: ValueError: x", 5.0, None)


def test_gates_of_a_run(spark):
    some, none = spark.range(1), spark.range(0)
    whole, cut = spark.sql("SELECT 'visited' AS status"), spark.sql("SELECT 'queued' AS status")
    records.checked(some, whole, some)
    for arguments, reason in (((none, whole, some), "no catalog seeds"), ((some, cut, some), "1 pages failed or queued"), ((some, whole, none), "no products")):
        with pytest.raises(ValueError, match=reason):
            records.checked(*arguments)


def test_run_from_pages_observes_its_audit_and_keeps_its_gates(spark):
    page = '<main><div class="card"><h3><a href="/p/1">Canon EOS R5</a></h3><p>1.000.000 đ</p></div><p>Page 1 / {} <a href="/x">·</a></p></main>'
    made = lambda n: spark.createDataFrame([(1, "https://s.vn/c", page.format(n)), (2, "https://s.vn/p/1", "<h1>Canon EOS R5 chính hãng</h1><p>cảm biến mirrorless</p>")], "page_id long, url string, html string")
    seeds = spark.createDataFrame([(1, "https://s.vn/c", "NEW", "n")], "ord int, url string, intent string, label string")
    cut = lambda df, n: df.checkpoint()
    got = extract.from_pages(made(1), seeds, cut, start_url="https://s.vn/", gates=True)
    rows = {r["metric"]: r["value"] for r in got["audit"].collect()}
    counted = records.audit("https://s.vn/", seeds, got["crawled"], got["products"], got["records"])
    assert rows == {r["metric"]: r["value"] for r in counted.collect()} | {"Elapsed seconds": rows["Elapsed seconds"]}
    assert (rows["Accepted"], rows["Overall completeness"]) == ("1", "PASS") and int(rows["Elapsed seconds"]) > 0
    with pytest.raises(ValueError, match="1 pages failed"):
        extract.from_pages(made(2), seeds, cut, gates=True)


def test_a_run_keeps_no_elements_of_pages_and_makes_its_edges_once(spark):
    page = '<main><div class="card"><h3><a href="/p/1">Canon EOS R5</a></h3><p>1.000.000 đ</p></div><p>Page 1 / 2 <a href="/c?page=2">2</a></p></main>'
    corpus = spark.createDataFrame([(1, "https://s.vn/c", page), (2, "https://s.vn/p/1", "<h1>Canon EOS R5</h1>")], "page_id long, url string, html string")
    kept, plans = [], []

    def cut(df, name):
        kept.append(df.columns)
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return df.checkpoint()

    extract.from_pages(corpus, spark.createDataFrame([(1, "https://s.vn/c", "NEW", "n")], "ord int, url string, intent string, label string"), cut)
    assert not any("nodes" in columns for columns in kept)
    assert sum("MapInArrow" in plan for plan in plans) == 1
    assert sum("sequence(2" in plan for plan in plans) == 1


def test_pages_that_declare_several_are_dealt_out(spark):
    declared = spark.range(100).selectExpr("'https://s' || id || '.vn/c' AS page_url", "3 AS n")
    links = spark.createDataFrame([], "page_url string, ord int, href string")
    made = pages.turned(declared, links).checkpoint()
    assert made.count() == 200
    plan = pages.turned(declared, links)._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [page_url" in plan


PLAIN_PAGES = [
    "", "text alone &amp; more", " <p>x &lt; y</p><p>z", '<ul><li>a<li>b</ul><div class="content x"><a href="/x">\n y</a></div>', '<script type="application/ld+json">{"a":"&amp;"}</script><b>x</b>',
    '<style>.off{display:none}</style><p class="off">no</p><p style="width:0">flat</p><button>k</button>', "</p><title>&eacute;t</title><table><tr><td>1<td>2</table>",
]
OTHER_PAGES = ["<P>x</P>", "<br/>", "a < b", "<!-- c --><p>x</p>", "<a href=/x>y</a>", '<a href="?a&amp;b">y</a>', "<script>a</b></script>", "<title>a<b>c</b></title>", "<iframe>x</iframe>", '<p hidden>x</p>', "<style>p{}"]


def test_plain_markup_is_read_as_by_the_standard_parser(monkeypatch):
    plain = [html.shred_text(x) for x in PLAIN_PAGES]
    assert all(html._Parser().read_plain(x) for x in PLAIN_PAGES) and not any(html._Parser().read_plain(x) for x in OTHER_PAGES)
    monkeypatch.setattr(html._Parser, "read_plain", lambda self, raw: False)
    assert plain == [html.shred_text(x) for x in PLAIN_PAGES]


def test_headers_name_all_columns_of_every_sheet(spark):
    rows = records.details(fixtures.literal(spark, "listed"), fixtures.literal(spark, "details"))
    seeds, crawled = fixtures.literal(spark, "seeds"), spark.sql("SELECT 'u' AS url, 'visited' AS status")
    sheets = records.sheets(rows, records.coverage(seeds, crawled), records.audit("", seeds, crawled, rows, rows), spark)
    assert set(sheets) == set(records.HEADERS)
    for name, sheet in sheets.items():
        assert records.titled(name, sheet).columns == list(records.HEADERS[name].values())
    assert records.titled("log", sheets["log"]).first()["Message"] == "Collection completed"


def test_submenu_of_before_and_after(spark):
    frame = lambda *rows: spark.createDataFrame(list(rows), "page_id int, ord int, text string, href string")
    none = frame((0, 0, "", "")).where("false")
    got = site.submenu(frame((1, 5, "A", "/a"), (1, 6, "a ", "/a")), none, none, frame((1, 0, "A b", "/a"), (1, 1, "A", "/a"), (2, 0, "C", "/c")))
    assert sorted((r["page_id"], r["text"], r["href"]) for r in got.collect()) == [(1, "A", "/a"), (1, "A b", "/a"), (2, "C", "/c")]


def test_sheets_are_written(spark, tmp_path):
    folder = records.write_sheets({"main": spark.range(3), "log": spark.range(0)}, str(tmp_path), "s.vn", "2024-01-02")
    assert folder.endswith("/s.vn_camera_2024-01-02")
    assert [spark.read.parquet(f"{folder}/{name}").count() for name in ("main", "log")] == [3, 0]


def test_matching_by_candidates_equals_all_pairs(spark):
    rng = random.Random(8)
    made = lambda page, i: (page, i, rng.choice(["", "A", "a ", "b", None]), rng.choice(["", "/1", "/2", None]), rng.choice(["", "L", "l", "m", None]), rng.randrange(-90, 400), rng.randrange(0, 200))
    nodes, elements = [made(p, 100 * p + i) for p in range(6) for i in range(20)], [made(p, i) for p in range(1, 6) for i in range(60)]
    light = lambda t: " ".join((t or "").split()).lower()

    def score(a, b):
        far = abs(a[5] - b[5]) + abs(a[6] - b[6])
        both = lambda x, y: x and x == y
        return 120 * (light(a[2]) == light(b[2])) + 220 * bool(both(a[3], b[3])) + 80 * bool(both(light(a[4]), light(b[4]))) + (80 if far < 10 else 30 if far < 60 else 0)

    want = {}
    for a in nodes:
        near = [(score(a, b), -b[1]) for b in elements if b[0] == a[0] and b[1] < 50]
        if near:
            want[a[1]] = (-max(near)[1], max(near)[0])
    frame = lambda rows, key: spark.createDataFrame(rows, f"page_id int, {key} int, text string, href string, aria_label string, x int, y int")
    site_most, site.ELEMENTS_MOST = site.ELEMENTS_MOST, 50
    got = site.match_elements(frame(nodes, "node_id"), frame(elements, "element_id"))
    assert {r["node_id"]: (r["element_id"], r["score"]) for r in got.collect()} == want
    site.ELEMENTS_MOST = site_most


def test_waves_meet_a_laid_out_corpus_where_it_lies(spark):
    seeds, edges, loaded = _chain(spark, 3)
    made = loaded.selectExpr("cast(substring_index(url, '/', -1) AS long) AS page_id", "url || '#x' AS url", "'first' AS html")
    table = corpus.lay_out(made.unionByName(made.selectExpr("page_id + 100", "url", "'second'").toDF("page_id", "url", "html")), "laid_out", 5)
    assert [(r["page_id"], r["html"]) for r in table.orderBy("page_id").collect()] == [(k, "first") for k in range(4)]
    cut = lambda df, n: df.checkpoint()
    plain = pages.crawl(seeds, edges, loaded, cut).collect()
    assert sorted(pages.crawl(seeds, edges, table, cut).collect()) == sorted(plain)
    front, kept = seeds.select("url"), {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    for k, v in (("spark.sql.autoBroadcastJoinThreshold", "-1"), ("spark.sql.shuffle.partitions", "5"), ("spark.sql.adaptive.enabled", "false")):
        spark.conf.set(k, v)
    for _ in range(3):  # wave after wave the plan has one exchange, of the wave
        seen = front.join(pages.openable(table), "url", "left")
        assert seen._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
        front = seen.select("url").checkpoint()
    for k, v in kept.items():
        spark.conf.set(k, v)


def test_links_by_pattern_of_any_quoting(spark):
    page = """<a href="/a?x='1'">A</a><a class=b HREF = '/b'><b>B</b></a><a\nhref=/c title="t">C</a><a data-href="/no" href="/d">D</a><abbr href="/e">E</abbr><a name=x>F</a><a href=''>G</a>"""
    rows = spark.createDataFrame([(1, "https://s.vn/", page), (2, "https://s.vn/", None)], "page_id long, url string, html string")
    got = [(r["href"], r["text"]) for r in pages.anchors(rows).orderBy("ord").collect()]
    assert got == [("https://s.vn/a?x='1'", "A"), ("https://s.vn/b", "B"), ("https://s.vn/c", "C"), ("https://s.vn/d", "D"), ("https://s.vn/", "G")]
    assert pages.anchors(rows, outer=True).where("ord is null").count() == 1


def test_shredder_holds_the_elements_of_few_pages(spark):
    """A megabyte of pages in one batch: what is held at a time does not grow with them."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(html.SCHEMA))
    page, n = "<ul>" + "<li><a href='/x'>y</a></li>" * 400 + "</ul>", 100
    batch = pa.RecordBatch.from_pydict({"page_id": list(range(n)), "url": ["u"] * n, "html": [page] * n})
    tracemalloc.start()
    rows = sum(b.num_rows for b in html.shredded_batches(iter([batch]), schema))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == n
    assert peak < 50e6
