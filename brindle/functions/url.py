"""URLs as columns, of any characters, by built-in functions; and one URL at a time, for comparison."""

from __future__ import annotations

import re
from urllib.parse import parse_qsl, quote, quote_plus, urlsplit

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Parameters that do not tell pages apart, and those that number pages.
TRACKING = ["utm_source", "utm_medium", "utm_campaign", "fbclid"]
PAGE_PARAMETERS = ["p", "page"]
PORTS = {"http": 80, "https": 443}


def _c(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def host(c: Column | str) -> Column:
    """Host in lower case, without port or leading www.; '' if there is none."""
    name = F.regexp_extract(F.lower(_c(c)), r"^[a-z][a-z0-9+.-]*://([^/?#@]*@)?([^/?#:]+)", 2)
    return F.regexp_replace(name, r"^www\.", "")


def origin(c: Column | str) -> Column:
    """Scheme and authority in lower case, without a default port."""
    raw = F.lower(F.regexp_extract(_c(c), r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1))
    return F.regexp_replace(F.regexp_replace(raw, "^(http://.*):80$", "$1"), "^(https://.*):443$", "$1")


def path(c: Column | str) -> Column:
    """Path, '/' if empty."""
    return F.coalesce(F.nullif(F.regexp_extract(_c(c), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1), F.lit("")), F.lit("/"))


def query(c: Column | str) -> Column:
    return F.regexp_extract(_c(c), r"^[^?#]*\?([^#]*)", 1)


def parameter(c: Column | str, name: str) -> Column:
    """First value of a parameter; null if there is none."""
    pairs = F.filter(F.split(query(c), "&"), lambda x: F.substring_index(x, "=", 1) == name)
    first = F.get(pairs, 0)
    return F.when(first.isNotNull() & (query(c) != ""), F.when(first.contains("="), F.regexp_replace(first, "^[^=]*=", "")).otherwise(F.lit("")))


def without_fragment(c: Column | str) -> Column:
    return F.substring_index(_c(c), "#", 1)


def without_dots(c: Column) -> Column:
    """A path with its dot segments taken out: '.' is the folder at hand, '..' the one above."""
    steps = F.split(c, "/")

    def walk(done: Column, step: Column) -> Column:
        return F.when(step == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(1)))).when(step == ".", done).otherwise(F.concat(done, F.array(step)))

    folded = F.aggregate(steps, F.array().cast("array<string>"), walk)
    closed = F.when(F.element_at(steps, -1).isin(".", ".."), F.concat(folded, F.array(F.lit("")))).otherwise(folded)
    return F.when(c.rlike(r"/\.\.?(/|$)"), F.array_join(closed, "/")).otherwise(c)


def resolve(href: Column | str, base: Column | str) -> Column:
    """An absolute URL from a link on a page; links with a scheme of their own (mailto: too) come back as they are."""
    href, at = F.trim(_c(href)), origin(base)
    place, tail = F.regexp_extract(href, "^([^?#]*)", 1), F.regexp_extract(href, "^[^?#]*(.*)$", 1)
    return (
        F.when(href.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), href)
        .when((href == "") | href.startswith("#"), F.concat(without_fragment(base), href))
        .when(href.startswith("//"), F.concat(F.regexp_extract(at, "^([^:]*:)", 1), href))
        .when(href.startswith("/"), F.concat(at, without_dots(place), tail))
        .when(href.startswith("?"), F.concat(at, path(base), href))
        .otherwise(F.concat(at, without_dots(F.concat(F.regexp_replace(path(base), "[^/]*$", ""), place)), tail))
    )


#: URLs that need no escaping and have no dot segments, so that their parts stay as they are.
PLAIN = r"^(?i:https?)://[^/?#\s]+(/[A-Za-z0-9!$&'()*+,;=:@~._|^\[\]/-]*)?(\?[A-Za-z0-9&=.*_-]*)?(#.*)?$"
DOTS = r"^[^?#]*/\.\.?([/?#]|$)"
#: URLs that are their own form: PLAIN ones without parameters, fragment, port, capitals in the host, or dots in the path.
SAME = r"^https?://[a-z0-9.-]+/[A-Za-z0-9!$&'()*+,;=:@~_|^\[\]/-]*\z"
PATH_CHARACTER = r"[A-Za-z0-9%!$&'()*+,;=:@~._|^\[\]/-]"


def canonical(c: Column | str) -> Column:
    """One form for URLs of the same page: no fragment, no tracking, no first-page number, parameters by name.

    For absolute http(s) URLs; anything else comes back as it is. Paths are escaped and their dot segments taken out,
    parameters are written as forms write them. Bytes that are no UTF-8 become U+FFFD.
    """
    known = lambda raw: F.when(raw.rlike(SAME), raw).when(raw.rlike(PLAIN) & ~raw.rlike(DOTS), _canonical(raw)).otherwise(_escaped(raw))
    return F.element_at(F.transform(F.array(_c(c)), known), 1)  # the URL's expression is computed once


def _let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def _decoded(x: Column) -> Column:
    """A form's text, of which escapes that are none stay."""
    return F.try_url_decode(F.regexp_replace(x, "%(?![0-9A-Fa-f]{2})", "%25"))


def _escaped(given: Column) -> Column:
    """canonical of a URL of any characters."""
    raw = F.regexp_replace(F.regexp_replace(given, r"^[\s\x00-\x20]+|[\s\x00-\x20]+$", ""), r"[\t\n\r]", "")

    def whole(u: Column) -> Column:
        escape = lambda x: F.when(x.rlike(PATH_CHARACTER), x).otherwise(F.regexp_replace(F.hex(F.encode(x, "UTF-8")), "(..)", "%$1"))
        place = F.array_join(F.transform(F.split(without_dots(path(u)), ""), escape), "")
        own = F.filter(F.split(query(u), "&"), lambda x: x != "")
        pairs = F.transform(own, lambda x: F.named_struct(F.lit("n"), _decoded(_name(x)), F.lit("v"), _decoded(F.when(x.contains("="), F.regexp_replace(x, "^[^=]*=", "")).otherwise(""))))

        def named(some: Column, name: str, wanted: bool) -> Column:
            return F.filter(some, lambda x: (x.n == name) == F.lit(wanted))

        def kept(all_: Column) -> Column:
            out = F.filter(all_, lambda x: ~x.n.isin(TRACKING))
            for p in PAGE_PARAMETERS:
                out = F.when(F.coalesce(F.get(named(all_, p, True), 0).getField("v") == "1", F.lit(False)), named(out, p, False)).otherwise(out)
            ordered = F.array_sort(out, lambda a, b: F.when(a.n < b.n, -1).when(a.n > b.n, 1).otherwise(0))
            return F.array_join(F.transform(ordered, lambda x: F.concat(F.url_encode(x.n), F.lit("="), F.url_encode(x.v))), "&")

        tail = _let(_let(pairs, kept), lambda t: F.when(t == "", "").otherwise(F.concat(F.lit("?"), t)))
        return F.when(u.rlike("(?i)^https?://[^/?#]"), F.concat(origin(u), place, tail)).otherwise(given)

    return _let(raw, whole)


def _name(pair: Column) -> Column:
    return F.substring_index(pair, "=", 1)


def _without(pairs: Column, parameter_name: str) -> Column:
    return F.filter(pairs, lambda x: _name(x) != parameter_name)


def _canonical(raw: Column) -> Column:
    pairs = F.filter(F.split(query(raw), "&"), lambda x: x != "")
    pairs = F.transform(pairs, lambda x: F.when(x.contains("="), x).otherwise(F.concat(x, F.lit("="))))
    kept = F.filter(pairs, lambda x: ~_name(x).isin(TRACKING))
    for p in PAGE_PARAMETERS:
        kept = F.when(F.coalesce(parameter(raw, p) == "1", F.lit(False)), _without(kept, p)).otherwise(kept)
    by_name = F.array_sort(kept, lambda a, b: F.when(_name(a) < _name(b), -1).when(_name(a) > _name(b), 1).otherwise(0))
    tail = F.element_at(F.transform(F.array(F.array_join(by_name, "&")), lambda t: F.when(t == "", "").otherwise(F.concat(F.lit("?"), t))), 1)
    return F.when(raw.rlike("(?i)^https?://[^/?#]"), F.concat(origin(raw), path(raw), tail)).otherwise(raw)


def is_pagination(c: Column | str) -> Column:
    """Has a page parameter, or a path /page/<n>."""
    return parameter(c, "p").isNotNull() | parameter(c, "page").isNotNull() | path(c).rlike("/page/[0-9]+")


def is_strict_pagination(link: Column | str, page: Column | str) -> Column:
    """The same path on the same origin, with a number for p, or else for page."""
    n = F.coalesce(F.nullif(parameter(link, "p"), F.lit("")), parameter(link, "page"))
    numbered = _c(link).contains("p=") | _c(link).contains("page=")  # few links are, and this is soon told
    return numbered & (origin(link) == origin(page)) & (path(link) == path(page)) & F.coalesce(n.rlike("^[0-9]+$"), F.lit(False))


def canonical_text(url: str) -> str:
    """canonical for any one URL, with the web platform's escaping."""
    try:
        parts = urlsplit(re.sub(r"[\t\n\r]", "", url.strip()))
        port = parts.port
    except ValueError:
        return url
    if parts.scheme not in PORTS or not parts.hostname:
        return url
    steps: list[str] = []
    pieces = parts.path.split("/")[1:] or [""]
    for i, step in enumerate(pieces):
        if step in (".", ".."):
            steps = steps[:-1] if step == ".." else steps
            if i == len(pieces) - 1:
                steps.append("")
        else:
            steps.append(quote(step, safe="%!$&'()*+,;=:@~-._[]|^"))
    pairs = [(k, v) for k, v in parse_qsl(parts.query, keep_blank_values=True) if k not in TRACKING]
    for p in PAGE_PARAMETERS:
        if next((v for k, v in pairs if k == p), None) == "1":
            pairs = [(k, v) for k, v in pairs if k != p]
    pairs.sort(key=lambda x: x[0])
    escape = lambda x: quote_plus(x, safe="*").replace("~", "%7E")
    text = "&".join(f"{escape(k)}={escape(v)}" for k, v in pairs)
    place = parts.hostname if port in (None, PORTS[parts.scheme]) else f"{parts.hostname}:{port}"
    return f"{parts.scheme}://{place}/{'/'.join(steps)}" + (f"?{text}" if text else "")
