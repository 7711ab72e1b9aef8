"""Golden values of the text, URL and rule functions, and laws that hold for any text."""

from __future__ import annotations

import random
import unicodedata

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from brindle.functions import lexicon, text, url
from brindle.operators import records, site

URLS = {
    "HTTP://Ex.COM:80/a b?b=2&a=1&a=0#h": "http://ex.com/a%20b?a=1&a=0&b=2",
    "https://e.com": "https://e.com/",
    "https://e.com/?q=a%20b~*&x": "https://e.com/?q=a+b%7E*&x=",
    "https://e.com/a/?": "https://e.com/a/",
    "https://e.com/a/../b": "https://e.com/b",
    "https://e.com/c?page=1&utm_source=x": "https://e.com/c",
    "https://e.com/c?p=10&fbclid=z": "https://e.com/c?p=10",
    "not a url": "not a url",
}


def one(spark, column):
    return spark.range(1).select(column).first()[0]


@pytest.mark.parametrize("raw,want", URLS.items())
def test_canonical_text(raw, want):
    assert url.canonical_text(raw) == want


ODD_URLS = [
    "https://e.com/a b/é?q=a b&z=%20x~*&é=1&utm_source=x", "https://e.com/a/./b/../c?x", "https://e.com/%zz/%41?a=%zz&b=%C3%A9+x&b=1", "  https://e.com/x\ty?p=1&page=2 ", "https://e.com/..", "https://e.com/a/..?page=1",
    "https://e.com:443/漢字?漢=字#é", "HTTPS://E.com/q?p=%31&r=!'()", "https://e.com?b=%26&a==", "ftp://e.com/a b", "https:///x", "https://e.com/\U0001f642?a=\U0001f642", 'https://e.com/"<>`{}\\?x="', "https://e.com/a//b/../?+=+",
]


def test_canonical_column_equals_one_url_at_a_time(spark):
    rng = random.Random(6)
    made = ["https://e.com/" + "".join(rng.choice(["a", "b", "/", ".", "..", "/../", "?", "&", "=", "p=1", "page=1", "utm_source=", "%20", "%", "+", " ", "é", "~", "*", "#", "'", ";"]) for _ in range(rng.randrange(14))) for _ in range(600)]
    urls = [*URLS, *ODD_URLS, *made]
    got = spark.createDataFrame(list(enumerate(urls)), "i int, u string").repartition(4).select("i", url.canonical("u").alias("c")).collect()
    assert {urls[r.i]: r.c for r in got} == {u: url.canonical_text(u) for u in urls}


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abcp=&?/#12.%~ ", max_size=30))
def test_canonical_is_idempotent(tail):
    first = url.canonical_text("https://e.com/" + tail)
    assert url.canonical_text(first) == first


@pytest.mark.parametrize("raw,want", [("1.990.000đ", 1990000), ("1990000.00", 199000000), ("500.000đ - 600.000đ", 500000600000), ("-5", 5), ("1e3", 13), ("Liên hệ báo giá", None), ("", None), ("0", None), (None, None)])
def test_money_in_text(spark, raw, want):
    assert one(spark, text.digits_money(F.lit(raw).cast("string"))) == want


@pytest.mark.parametrize("raw,want", [(1990000.5, 1990000.5), (-5.0, None), (0.0, None), (None, None), (float("nan"), None), (float("inf"), None)])
def test_money_as_number(spark, raw, want):
    assert one(spark, text.number_money(F.lit(raw).cast("double"))) == want


@pytest.mark.parametrize("lines,want", [(["Giá: 500k"], "500k"), (["Giá:", "500k"], "500k"), (["Giá", "500k"], "500k"), (["Giá thuê: 200k"], ""), (["price: 5"], ""), (["x", "Giá:"], ""), ([], "")])
def test_find_label(spark, lines, want):
    from brindle.functions.lexicon import LABELS

    rows = F.array(*[F.lit(x) for x in lines]).cast("array<string>")
    assert one(spark, text.find_label(rows, ["(?iu)" + p for p in LABELS["price"]])) == want


def test_fold_equals_decomposition(spark):
    letters = "".join(chr(x) for x in [*range(0xC0, 0x180), *range(0x1EA0, 0x1EFA)])
    plain = "".join(c for c in unicodedata.normalize("NFD", letters.replace("đ", "d").replace("Đ", "D")) if not "̀" <= c <= "ͯ").lower()
    assert one(spark, text.fold(F.lit(letters))) == plain
    assert one(spark, text.fold(F.lit("  Đặc  biệt　Ếch "))) == "dac biet ech"


@pytest.mark.parametrize("t,want", [("Cho thuê máy ảnh | Máy ảnh cũ", "MIXED"), ("Máy ảnh cũ, máy ảnh mới", "SALE_MIXED"), ("Giá thuê theo ngày", "RENTAL"), ("Máy ảnh cũ", "SALE_SECOND_HAND"), ("New camera", "SALE_NEW"), ("Máy ảnh cũng đẹp", "UNKNOWN"), ("", "UNKNOWN")])
def test_site_mode(spark, t, want):
    nodes = spark.createDataFrame([], "page_id long, text string, aria_label string, title string")
    got = site.site_modes(spark.createDataFrame([(1, t)], "page_id long, visible_text string"), nodes).first()
    assert got.site_mode == want


@pytest.mark.parametrize("t,score,intent", [("Máy ảnh cũ", 130, "SECOND_HAND"), ("Máy ảnh chính hãng", 130, "NEW"), ("Cho thuê máy ảnh", 130, "RENTAL"), ("Thuê máy ảnh cũ", 230, "RENTAL"), ("Camera", 30, "CAMERA_GENERIC"), ("Máy ảnh mới & phụ kiện", 30, "NEW"), ("Ống kính máy ảnh", -70, "CAMERA_GENERIC"), ("Đăng nhập", -100, "CAMERA_GENERIC")])
def test_menu_score(spark, t, score, intent):
    row = site.menu_scores(spark.createDataFrame([(t, "", "")], "text string, aria_label string, title string")).first()
    assert (row.score, row.intent, row.text) == (score, intent, t)


@pytest.mark.parametrize("title,body,score,label", [("Canon EOS R50", "mirrorless cảm biến ISO 100 RF-mount", 12, "CAMERA"), ("Sony Alpha Body", "", 5, "CAMERA"), ("Sony ZV-E10", "E-mount", 5, "CAMERA"), ("Sony Alpha", "", 3, "UNCERTAIN"), ("Máy ảnh", "quay video chất lượng 4K 60fps", 2, "UNCERTAIN"), ("X", "thuê phụ kiện cảm biến ISO fps", -2, "UNCERTAIN"), ("X", "thuê phụ kiện cảm biến ISO", -3, "NOT_CAMERA"), ("Canon", "product description", -7, "NOT_CAMERA"), ("X photobooth", "cảm biến", -10, "NOT_CAMERA"), ("Pin Canon LP-E6", "mirrorless", -100, "NOT_CAMERA"), ("Thẻ nhớ 64GB", "", -100, "NOT_CAMERA")])
def test_entity(spark, title, body, score, label):
    row = records.classify(spark.createDataFrame([(title, body)], "title string, body string")).first()
    assert (row.entity_score, row.entity_label, row.title) == (score, label, title)


def test_disposition_reasons(spark):
    what, reason = records.disposition(F.col("l"), F.col("s"), F.col("n"), F.col("m"))
    rows = spark.createDataFrame([("NOT_CAMERA", -12, ["photobooth"], None), ("UNCERTAIN", 3, [], "NEW"), ("CAMERA", 9, [], None), ("CAMERA", 9, [], "RENTAL"), ("NOT_CAMERA", -3, [], "NEW")], "l string, s int, n array<string>, m string").select(what, reason).collect()
    assert [tuple(r) for r in rows] == [("excluded", "not camera: photobooth"), ("review", "camera identity uncertain; score=3"), ("review", "business mode uncertain"), ("accepted", "camera detail confirmed"), ("excluded", "not camera: semantic validator")]


def test_every_character_is_decomposed(spark):
    """All code points, alone and in a text with others."""
    strip = lambda t: "".join(m for m in unicodedata.normalize("NFD", t) if not "\u0300" <= m <= "\u036f").replace("đ", "d").replace("Đ", "D")
    points = [x for x in range(0x110000) if not 0xD800 <= x <= 0xDFFF]
    rows = pa.table({"x": points, "t": [f"a{chr(x)}é" for x in points]})
    got = spark.createDataFrame(rows).repartition(8).select("x", text.decomposed("t").alias("t")).toArrow()
    bad = [(hex(x), t) for x, t in zip(got.column("x").to_pylist(), got.column("t").to_pylist()) if t != f"a{strip(chr(x))}e"]
    assert bad == []


def test_fold_of_other_scripts(spark):
    rows = [("Ёлка й", "елка и"), ("Ά ή Ώ", "α η ω"), ("がギパ", "か\u3099キ\u3099ハ\u309a"), ("각 한국", unicodedata.normalize("NFD", "각 한국")), ("ẤÀ Å đĐ", "aa a dd"), ("", ""), (None, "")]
    got = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "i int, t string").select("i", text.fold("t").alias("f")).collect()
    assert {r["i"]: r["f"] for r in got} == {i: want for i, (_, want) in enumerate(rows)}


def test_needles_stand_in_all_that_a_pattern_is_found_in(spark):
    """found equals rlike, on the rules' own terms put together at random and cut short."""
    rng = random.Random(3)
    named = [r for name in ("SITE", "MENU", "ROOTS", "ENTITY", "NOT_ENTITY", "BUSINESS") for r in getattr(lexicon, name)]
    known = [r.pattern for r in named if text.needles(r.pattern)]
    assert len(known) == len(named) - 1
    parts = [n for p in known for n in text.needles(p)[0]]
    texts = ["".join(rng.choice(["", " ", ".", "_", "x", "4k", "mah", "\n"]) + (part := rng.choice(parts))[: rng.randrange(len(part) // 2, len(part) + 1)] for _ in range(rng.randrange(4))) for _ in range(400)] + [None, "iso", "isox", "quay video full hd"]
    columns = [(text.found(F.col("t"), p), F.col("t").rlike(p)) for p in known]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(*[F.struct(a.alias("got"), b.alias("want")) for a, b in columns]).collect()
    assert all(x.got == x.want for row in rows for x in row)
    assert sum(bool(x.want) for row in rows for x in row) > 100
    assert [text.needles(p) for p in ("(a)|(b)", "(?i)(ab)", "([0-9]|x)", "ab", "(ab?c|d)", r"(a\.b)")] == [None, None, None, None, (["a", "d"], False), (["a"], False)]


def test_rules_are_tried_once(spark):
    """Score and labels read the same findings; a text without a needle meets no pattern."""
    plan = records.classify(spark.range(3).select(F.col("id").cast("string").alias("title"), F.col("id").cast("string").alias("body")))._jdf.queryExecution().optimizedPlan().toString()
    for term in ("mirrorless", "cam bien", "dien ap"):
        assert plan.count(f"RLIKE (^|[^a-zA-Z0-9_])({term}") + plan.count(f"RLIKE ({term}") <= 1
    assert plan.count("RLIKE") <= 1 + len(lexicon.ENTITY + lexicon.NOT_ENTITY) + 1  # SEVERAL's and STRONG_NEGATIVE's
    assert "Contains(body" in plan


def test_white_space_of_all_kinds_is_one_space(spark):
    points = [x for x in range(0x10000) if not 0xD800 <= x <= 0xDFFF]
    rows = spark.createDataFrame(pa.table({"x": points, "t": [f"{chr(x)} a {chr(x)}{chr(x)}b{chr(x)}" for x in points]})).repartition(8)
    same = [(F.trim(F.regexp_replace("t", text.WS, " ")), text.clean("t")), (F.trim(F.regexp_replace(F.lower(text.decomposed("t")), text.WS, " ")), text.fold("t"))]
    assert rows.select("x", *[c.alias(f"{n}{i}") for i, p in enumerate(same) for n, c in zip("ab", p)]).where("a0 <> b0 or a1 <> b1").collect() == []


def test_urls_that_are_their_own_form_and_those_that_only_look_so(spark):
    same = ["https://s.vn/p/1", "http://a-b.c0/x_(y)~z;a=1/", "https://s.vn/"]
    other = ["https://s.vn", "https://S.vn/p", "https://s.vn:443/p", "https://s.vn/a/../b", "https://s.vn/p\n", "https://s.vn/p#x", "https://s.vn/p?page=1", "https://s.vn/é"]
    rows = spark.createDataFrame([(u,) for u in same + other], "u string")
    plan = {r["u"]: (r["s"], r["c"]) for r in rows.select("u", F.col("u").rlike(url.SAME).alias("s"), url.canonical("u").alias("c")).collect()}
    assert all(plan[u] == (True, u) for u in same) and not any(plan[u][0] for u in other)
    assert all(url.canonical_text(u) == u for u in same)
