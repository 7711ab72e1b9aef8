"""Product records: entity and mode, prices, disposition, evidence; and the report's tables."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from brindle.functions import lexicon, rules, text, url

EXCERPT = 280
RECORD = "website product_name business_mode specs rental_price_per_day rental_conditions included_accessories bundle rating review_count stock sale_price url".split()

# The headers of the report's sheets, by column.
_PART = {"website": "Website", "product_name": "Tên sản phẩm", "business_mode": "Hình thức", "reason": "Lý do", "url": "URL"}
HEADERS = {
    "main": {
        "website": "Website", "product_name": "Tên sản phẩm", "business_mode": "Hình thức", "specs": "Thông số mô tả", "rental_price_per_day": "Giá thuê/ngày",
        "rental_conditions": "Điều kiện thuê riêng", "included_accessories": "Phụ kiện đi kèm", "bundle": "Combo/gói đi kèm", "rating": "Điểm đánh giá",
        "review_count": "Số lượt đánh giá/review", "stock": "Tồn kho", "sale_price": "Giá bán", "url": "URL",
    },
    "excluded": _PART, "review": _PART,
    "evidence": {"url": "URL", "field": "Field", "value": "Value", "source": "Source", "confidence": "Confidence", "evidence": "Evidence"},
    "visual_evidence": {"url": "URL", "image_url": "Image URL", "text": "Text", "bbox": "BBox", "confidence": "Confidence"},
    "conflicts": {"url": "URL", "field": "Field", "listing_value": "Listing Value", "detail_value": "Detail Value"},
    "coverage": {"kind": "Loại", "intent": "Intent", "label": "Nhãn", "url": "URL"},
    "audit": {"metric": "Metric", "value": "Value"}, "log": {"time": "Time", "level": "Level", "message": "Message"},
}


def titled(sheet: str, rows: DataFrame) -> DataFrame:
    """A sheet's columns under its headers, in their order."""
    return rows.select(*[F.col(c).alias(h) for c, h in HEADERS[sheet].items()])


def classify(rows: DataFrame) -> DataFrame:
    """rows (title, body) with entity_label, entity_score, positives, negatives."""
    folded = rows.withColumns({"_title": F.col("title"), "_body": F.col("body")}).withColumns({"title": text.fold("title"), "body": text.fold("body")}).withColumn("both", F.concat("title", F.lit(" "), "body"))
    # found once, read by the score and both lists
    folded = folded.withColumns({"_short": F.col("title").rlike(lexicon.STRONG_NEGATIVE), "_for": rules.findings(lexicon.ENTITY), "_against": rules.findings(lexicon.NOT_ENTITY)})
    short, for_, against = F.col("_short"), F.col("_for"), F.col("_against")
    score = rules.score(lexicon.ENTITY, for_) + rules.score(lexicon.NOT_ENTITY, against)
    out = folded.withColumns(
        {
            "entity_score": F.when(short, -100).otherwise(score),
            "positives": F.when(short, F.array().cast("array<string>")).otherwise(rules.labels(lexicon.ENTITY, for_)),
            "negatives": F.when(short, F.array(F.lit("strong non-camera title"))).otherwise(rules.labels(lexicon.NOT_ENTITY, against)),
        }
    )
    label = F.when(F.col("entity_score") >= lexicon.CAMERA_FROM, "CAMERA").when(F.col("entity_score") <= lexicon.NOT_CAMERA_TO, "NOT_CAMERA").otherwise("UNCERTAIN")
    return out.withColumns({"entity_label": label, "title": F.col("_title"), "body": F.col("_body")}).drop("_title", "_body", "both", "_short", "_for", "_against")


def business_mode(intent: Column, body: Column) -> Column:
    """A sure intent, else by the page's words, else null."""
    low = F.lower(F.coalesce(body, F.lit("")))
    by_words = F.coalesce(*[F.when(text.found(low, r.pattern), F.lit(r.label)) for r in lexicon.BUSINESS])
    return F.when(intent.isin("RENTAL", "SECOND_HAND", "NEW"), intent).otherwise(by_words)


def disposition(label: Column, score: Column, negatives: Column, mode: Column) -> tuple[Column, Column]:
    """Disposition and its reason."""
    why = F.coalesce(F.nullif(F.array_join(negatives, ", "), F.lit("")), F.lit("semantic validator"))
    what = F.when(label == "NOT_CAMERA", "excluded").when((label == "UNCERTAIN") | mode.isNull(), "review").otherwise("accepted")
    reason = (
        F.when(label == "NOT_CAMERA", F.concat(F.lit("not camera: "), why))
        .when(label == "UNCERTAIN", F.concat(F.lit("camera identity uncertain; score="), score.cast("string")))
        .when(mode.isNull(), "business mode uncertain")
        .otherwise("camera detail confirmed")
    )
    return what, reason


def _full(c: str) -> Column:
    return F.nullif(F.coalesce(F.col(c), F.lit("")), F.lit(""))


def details(candidates: DataFrame, raw: DataFrame) -> DataFrame:
    """One record for every candidate (url, title, intent, price_text); raw: one row a detail page, by url.

    A candidate without a detail page, or with one that could not be read (raw.error, if there is such a column, is
    not null), becomes a review record with its listing price only.
    """
    raw = raw if "error" in raw.columns else raw.withColumn("error", F.lit(None).cast("string"))
    rows = candidates.select("url", F.col("title").alias("listing_title"), "intent", "price_text").join(raw.withColumn("fetched", F.col("error").isNull()), "url", "left")
    rows = rows.withColumn("product_name", F.coalesce(_full("h1"), _full("json_name"), _full("listing_title"), F.lit("")))
    rows = classify(rows.withColumns({"title": F.col("product_name"), "body": F.coalesce("body_text", F.lit(""))}))
    rows = rows.withColumn("mode", F.when(F.col("fetched"), business_mode(F.col("intent"), F.col("body"))).otherwise(F.when(F.col("intent") != "CAMERA_GENERIC", F.col("intent"))))
    json_price = F.coalesce(text.number_money("json_price_num"), text.digits_money("json_price_str"))
    rows = rows.withColumns({"json_price": json_price, "listing_price": text.digits_money("price_text")}).withColumn("detail_price", F.coalesce("json_price", text.digits_money("dom_price")))
    rows = rows.withColumn("price", F.coalesce("detail_price", "listing_price"))
    what, reason = disposition(F.col("entity_label"), F.col("entity_score"), F.col("negatives"), F.col("mode"))
    rental = F.coalesce(F.col("mode") == "RENTAL", F.lit(False))
    cut = lambda c: F.substring(c, 1, EXCERPT)
    price_label = F.when(rental, "Giá thuê/ngày").otherwise("Giá bán")
    stock_raw = F.coalesce(_full("stock"), _full("json_availability"))

    def entry(field, value, number, source, excerpt, confidence):
        return F.struct(field.alias("field"), value.alias("value"), number.alias("value_num"), source.alias("source"), excerpt.alias("evidence"), confidence.cast("double").alias("confidence"))

    none = F.lit(None).cast("double")
    words = F.lit(None).cast("string")
    evidence = F.array_compact(
        F.array(
            F.when(F.col("product_name") != "", entry(F.lit("Tên sản phẩm"), F.col("product_name"), none, F.when(_full("h1").isNotNull(), "DOM").when(_full("json_name").isNotNull(), "JSON_LD").otherwise("LISTING"), cut(F.col("product_name")), F.when(_full("h1").isNotNull(), 0.99).otherwise(0.92))),
            F.when(F.col("detail_price").isNotNull(), entry(price_label, words, F.col("detail_price"), F.when(F.col("json_price").isNotNull(), "JSON_LD").otherwise("DOM"), cut(F.coalesce(_full("json_price_str"), plain_number(F.nullif(F.col("json_price_num"), F.lit(0.0))), F.col("dom_price"), F.lit(""))), F.lit(0.99)))
            .when(F.col("listing_price").isNotNull(), entry(price_label, words, F.col("listing_price"), F.lit("LISTING"), F.coalesce("price_text", F.lit("")), F.lit(0.9))),
            F.when(stock_raw.isNotNull(), entry(F.lit("Tồn kho"), stock_raw, none, F.when(_full("stock").isNotNull(), "DOM").otherwise("JSON_LD"), cut(stock_raw), F.lit(0.97))),
            F.when(_full("accessories").isNotNull(), entry(F.lit("Phụ kiện đi kèm"), F.col("accessories"), none, F.lit("DOM"), cut(F.col("accessories")), F.lit(0.97))),
        )
    )
    warranty = F.when(_full("warranty").isNotNull(), F.concat(F.lit("Bảo hành: "), "warranty"))
    ok = F.coalesce("fetched", F.lit(False))
    text_or = lambda c: F.coalesce(F.col(c), F.lit(""))
    return rows.select(
        url.host("url").alias("website"), "product_name", F.coalesce("mode", F.lit("NEW")).alias("business_mode"),
        text.clean(F.concat_ws(" | ", F.nullif(text.clean("summary"), F.lit("")), warranty)).alias("specs"),
        F.when(ok & rental, F.col("price")).alias("rental_price_per_day"), F.when(rental, text_or("rental_conditions")).otherwise("").alias("rental_conditions"),
        text_or("accessories").alias("included_accessories"), text_or("bundle").alias("bundle"), text.rating("json_rating").alias("rating"), text.review_count("json_review_count").alias("review_count"),
        F.coalesce(_full("stock"), F.regexp_replace(text_or("json_availability"), "(?i)^https?://schema.org/", "")).alias("stock"),
        F.when(ok & ~rental, F.col("price")).alias("sale_price"), "url",
        F.when(ok, what).otherwise("review").alias("disposition"), F.when(ok, reason).when(F.col("error").isNotNull(), F.concat(F.lit("detail extraction error: "), "error")).otherwise("detail fetch failed: page not in corpus").alias("reason"),
        F.when(ok, evidence).otherwise(F.slice(evidence, 1, 0)).alias("evidence"), "listing_price", "detail_price", ok.alias("fetched"),
    )


def plain_number(c: Column) -> Column:
    """A number as text, without a fraction if it is whole."""
    return F.when(c == F.floor(c), c.cast("decimal(38,0)").cast("string")).otherwise(c.cast("string"))


def conflicts(records: DataFrame) -> DataFrame:
    """Records whose listing and detail prices differ."""
    field = F.when(F.col("business_mode") == "RENTAL", "Giá thuê/ngày").otherwise("Giá bán")
    return records.where("listing_price <> detail_price").select("url", field.alias("field"), plain_number(F.col("listing_price")).alias("listing_value"), plain_number(F.col("detail_price")).alias("detail_value"))


def evidence_rows(records: DataFrame) -> DataFrame:
    """One row for each piece of evidence, with its record's disposition and its place there; records without any have none."""
    rows = records.select("url", "disposition", F.posexplode("evidence").alias("ord", "e"))
    value = F.coalesce(F.col("e.value"), plain_number(F.col("e.value_num")))
    return rows.select("url", "disposition", "ord", "e.field", value.alias("value"), "e.source", "e.confidence", "e.evidence")


def coverage(seeds: DataFrame, crawled: DataFrame) -> DataFrame:
    """kind, intent, label, url: roots, visited pages that are no root as given, failed pages."""
    roots = seeds.select(F.lit("ROOT").alias("kind"), "intent", "label", "url")
    other = crawled.where("status = 'visited'").join(seeds.select("url").distinct(), "url", "left_anti")
    pages = other.select(F.lit("CATALOG_PAGE").alias("kind"), F.lit("").alias("intent"), F.lit("").alias("label"), "url")
    failed = crawled.where("status = 'failed'").select(F.lit("FAILED_PAGE").alias("kind"), F.lit("").alias("intent"), F.lit("").alias("label"), "url")
    return roots.unionByName(pages).unionByName(failed)


def _crawl_counts() -> list[Column]:
    return [F.count_if(F.col("status") == s).alias(s) for s in ("visited", "failed", "queued")]


def _record_counts() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("checked"), *[F.count_if(F.col("disposition") == d).alias(d) for d in ("accepted", "excluded", "review")],
        F.count_if(~F.col("fetched")).alias("errors"), F.count_if(F.coalesce(F.col("listing_price") != F.col("detail_price"), F.lit(False))).alias("conflicts"),
    ]


def observed(rows: DataFrame, what: str) -> tuple[DataFrame, Observation]:
    """rows (of what: crawled, records, or anything else, of which rows are counted), counted as they are next written."""
    counts = {"crawled": _crawl_counts, "records": _record_counts}.get(what, lambda: [F.count(F.lit(1)).alias(what)])()
    seen = Observation(what)
    return rows.observe(seen, *counts), seen


def _report(one: DataFrame, start_url: str, elapsed_seconds: int) -> DataFrame:
    catalog_ok = (F.col("queued") == 0) & (F.col("failed") == 0)
    detail_ok = F.col("checked") == F.col("products")
    mark = lambda ok: F.when(ok, "PASS").otherwise("NOT COMPLETE")
    metrics = [
        ("Target", F.lit("CAMERA")), ("Start URL", F.lit(start_url)), ("Catalog roots", F.col("roots")), ("Catalog pages visited", F.col("visited")),
        ("Catalog queue remaining", F.col("queued") + F.col("failed")), ("Catalog URLs skipped by safety limit", F.col("queued")), ("Failed catalog pages", F.col("failed")),
        ("Product candidates", F.col("products")), ("Product details checked", F.col("checked")), ("Accepted", F.col("accepted")), ("Excluded", F.col("excluded")),
        ("Review", F.col("review")), ("Detail errors", F.col("errors")), ("Price conflicts", F.col("conflicts")), ("Catalog coverage", mark(catalog_ok)),
        ("Detail coverage", mark(detail_ok)), ("Overall completeness", mark(catalog_ok & detail_ok)), ("Elapsed seconds", F.lit(elapsed_seconds)),
    ]
    return one.select(F.inline(F.array(*[F.struct(F.lit(k).alias("metric"), v.cast("string").alias("value")) for k, v in metrics])))


def audit(start_url: str, seeds: DataFrame, crawled: DataFrame, candidates: DataFrame, records: DataFrame, elapsed_seconds: int = 0) -> DataFrame:
    """The 18 metric and value rows of a run, counted in one pass over each table."""
    keyed = lambda df: df.withColumn("_k", F.lit(1))  # noqa: E731  one row each
    one = keyed(seeds.agg(F.count(F.lit(1)).alias("roots")))
    for part in (crawled.agg(*_crawl_counts()), records.agg(*_record_counts()), candidates.agg(F.count(F.lit(1)).alias("products"))):
        one = one.join(keyed(part), "_k")
    return _report(one, start_url, elapsed_seconds)


def audit_of(spark: SparkSession, start_url: str, seen: list[Observation], elapsed_seconds: int = 0) -> DataFrame:
    """The same rows from what was observed while seeds (as roots), crawled, candidates (as products) and records were written."""
    numbers = {k: v for o in seen for k, v in o.get.items()}
    return _report(spark.range(1).select(*[F.lit(v).cast("long").alias(k) for k, v in numbers.items()]), start_url, elapsed_seconds)


def checked(seeds: DataFrame, crawled: DataFrame, candidates: DataFrame) -> None:
    """The gates of a run: raises if there are no seeds, pages of the catalogs are missing, or no product was found."""
    if seeds.isEmpty():
        raise ValueError("no catalog seeds")
    left = crawled.where("status <> 'visited'").count()
    if left:
        raise ValueError(f"catalogs are not complete: {left} pages failed or queued")
    if candidates.isEmpty():
        raise ValueError("no products in the catalogs")


def write_sheets(tables: dict[str, DataFrame], path: str, host: str, day: str | None = None) -> str:
    """Every table of the report as a Parquet folder under <path>/<host>_camera_<day> (today's, if none is given); the folder's name is returned."""
    day = day or datetime.date.today().isoformat()
    folder = f"{path.rstrip('/')}/{host}_camera_{day}"
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{folder}/{name}")
    return folder


def sheets(records: DataFrame, covered: DataFrame, audited: DataFrame, spark: SparkSession) -> dict[str, DataFrame]:
    """The report's nine tables by name."""
    part = lambda d: records.where(F.col("disposition") == d).select("website", "product_name", "business_mode", "reason", "url")
    return {
        "main": records.where("disposition = 'accepted'").select(*RECORD), "excluded": part("excluded"), "review": part("review"), "evidence": evidence_rows(records),
        "visual_evidence": spark.sql("SELECT '' AS url, '' AS image_url, '' AS text, '' AS bbox, 0.0D AS confidence WHERE false"), "conflicts": conflicts(records), "coverage": covered, "audit": audited,
        "log": spark.sql("SELECT current_timestamp() AS time, 'INFO' AS level, 'Collection completed' AS message"),
    }
