"""Products of embedded JSON as columns, by VARIANT."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Lists and graphs within one another that a product is looked for in.
LEVELS = 6
FIELDS = ("json_name", "json_price_str", "json_price_num", "json_availability", "json_rating", "json_review_count")


def field(v: Column, path: str) -> Column:
    """What stands at a path, as a variant; null if it is missing or JSON's null."""
    found = F.try_variant_get(v, path, "variant")
    return F.when(~F.is_variant_null(found), found)


def _values(v: Column, levels: int) -> Column:
    """A value, then those in it if it is a list, or in its @graph if it is an object, in document order."""
    own = F.array(v)
    if not levels:
        return own
    graph = field(v, "$['@graph']")
    below = F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.when(graph.isNotNull(), F.array(graph)))
    inner = F.flatten(F.transform(below, lambda x: _values(x, levels - 1)))
    return F.when(below.isNull(), own).otherwise(F.concat(own, inner))


def is_product(v: Column) -> Column:
    """An object whose type is, or whose types have, product in any case."""
    kinds = F.coalesce(F.try_variant_get(v, "$['@type']", "array<string>"), F.array(F.try_variant_get(v, "$['@type']", "string")))
    return F.coalesce(F.exists(kinds, lambda k: F.lower(k) == "product"), F.lit(False))


def first_product(scripts: Column, levels: int = LEVELS) -> Column:
    """The first product of a page's scripts (texts), as a variant: in lists in order, below an object only in its
    @graph. Scripts that do not parse are passed over."""
    found = F.transform(scripts, lambda raw: F.filter(_values(F.try_parse_json(raw), levels), is_product))
    return F.get(F.flatten(found), F.lit(0))


def _let(value: Column, body) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def product_fields(scripts: Column) -> Column:
    """A struct of FIELDS: name, price (as text or as a number), availability, rating and review count."""

    def of_offer(p: Column, offer: Column) -> Column:
        price = F.coalesce(field(offer, "$.price"), field(offer, "$.lowPrice"))
        is_number = F.coalesce(F.schema_of_variant(price).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT|INT)"), F.lit(False))
        text = lambda v, path: F.try_variant_get(v, path, "string")
        reviews = F.coalesce(field(p, "$.aggregateRating.reviewCount"), field(p, "$.aggregateRating.ratingCount"))
        return F.struct(
            F.coalesce(text(p, "$.name"), F.lit("")).alias("json_name"), F.when(p.isNotNull() & ~is_number, F.coalesce(text(price, "$"), F.lit(""))).alias("json_price_str"),
            F.when(is_number, F.try_variant_get(price, "$", "double")).alias("json_price_num"), F.coalesce(text(offer, "$.availability"), F.lit("")).alias("json_availability"),
            text(field(p, "$.aggregateRating.ratingValue"), "$").alias("json_rating"), text(reviews, "$").alias("json_review_count"),
        )

    def of_product(p: Column) -> Column:
        offers = field(p, "$.offers")
        return _let(F.coalesce(F.get(F.try_variant_get(offers, "$", "array<variant>"), F.lit(0)), offers), lambda offer: of_offer(p, offer))

    return _let(first_product(scripts), of_product)
