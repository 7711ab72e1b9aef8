"""Text and number functions as columns. Absent text is '' in records; null counts as ''."""

from __future__ import annotations

import re
import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of the web platform; Java's own class leaves out the wide and joining kinds.
WS = r"[\s\x0b\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]+"
#: Its characters but for the space, for translate.
WHITE = "".join(map(chr, [*range(0x09, 0x0E), 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF]))

#: Marks that folding takes off, of the letters' own and of decomposed ones.
MARKS = "\u0300-\u036f"
#: Blocks of all characters that decompose to several that stay, Hangul's syllables among them.
SEVERAL = r"[\x{0620}-\x{06ff}\x{0900}-\x{1bff}\x{3040}-\x{30ff}\x{ac00}-\x{d7a3}\x{fb00}-\x{fb4f}\x{11000}-\x{1d1ff}]"
HANGUL = (0xAC00, 0xD7A3)


def _decompositions() -> tuple[dict[str, str], dict[str, str]]:
    """Characters that decompose canonically to one other or none without MARKS, and those that do to several."""
    one, several = {"đ": "d", "Đ": "D"}, {}
    for x in range(0xC0, 0x30000):
        whole = unicodedata.normalize("NFD", chr(x)) if not HANGUL[0] <= x <= HANGUL[1] else chr(x)
        kept = "".join(m for m in whole if not "\u0300" <= m <= "\u036f")
        if whole != chr(x):
            (one if len(kept) < 2 else several)[chr(x)] = kept
    return one, several


ONE, MANY = _decompositions()
_LAST = max(map(len, MANY.values()))
#: Tables of translate: characters with one in place of each, those with none and MARKS last; and the k-th of several in place of each.
ACCENTED = "".join(sorted(ONE, key=lambda c: not ONE[c])) + "".join(c for c in map(chr, range(ord(MARKS[0]), ord(MARKS[-1]) + 1)) if c not in ONE)
PLAIN = "".join(ONE.get(c, "") for c in ACCENTED)
_STAYING = "".join(c for c in ACCENTED if c not in WHITE)
_NTH = [(k, "".join(sorted(MANY, key=lambda c, k=k: len(MANY[c]) <= k)), "".join(v[k] for v in sorted(MANY.values(), key=lambda v, k=k: len(v) <= k) if len(v) > k)) for k in range(_LAST)]


def _s(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(c.cast("string"), F.lit(""))


def _single(c: Column) -> Column:
    """Text whose white space is spaces, collapsed and trimmed."""
    return F.trim(F.regexp_replace(c, "  +", " "))


def clean(c: Column | str) -> Column:
    """White space collapsed and trimmed, case kept."""
    return _single(F.translate(_s(c), WHITE, " " * len(WHITE)))


def light(c: Column | str) -> Column:
    """clean, lower case."""
    return F.lower(clean(c))


def _character(c: Column) -> Column:
    """A character's decomposition, of those that have several characters."""
    number = F.ascii(c) - HANGUL[0]
    # a code point as UTF-16
    at = lambda n: F.decode(F.unhex(F.hex(n)), "UTF-16BE")
    last = F.when(number % 28 > 0, at(number % 28 + 0x11A7)).otherwise("")
    syllable = F.concat(at(F.floor(number / 588) + 0x1100), at(F.floor(number % 588 / 28) + 0x1161), last)
    nth = [F.translate(c, source, target) for _, source, target in _NTH]
    return F.when((c >= chr(HANGUL[0])) & (c <= chr(HANGUL[1])), syllable).when(F.lit("".join(MANY)).contains(c), F.concat(*nth)).otherwise(c)


def decomposed(c: Column | str) -> Column:
    """Canonically decomposed, without the marks U+0300 to U+036F. Other marks stay in the order that they are given in."""
    return _split_up(F.translate(_s(c), ACCENTED, PLAIN))


def _split_up(plain: Column) -> Column:
    """Text with the characters that have several in their place decomposed."""
    return F.when(plain.rlike(SEVERAL), F.array_join(F.transform(F.split(plain, ""), _character), "")).otherwise(plain)


def fold(c: Column | str) -> Column:
    """Without accents, lower case, white space collapsed: what the rules are written in."""
    spaced = F.translate(_s(c), WHITE + _STAYING, " " * len(WHITE) + "".join(ONE.get(x, "") for x in _STAYING))
    return _single(F.lower(_split_up(spaced)))


#: What stands before and after the terms of a bounded pattern.
BOUNDS = ("(^|[^a-zA-Z0-9_])", "($|[^a-zA-Z0-9_])")


def any_of(terms: list[str], bounded: bool = False) -> str:
    """A pattern, the same for Java and RE2, of any of the terms (they may be patterns); bounded: as whole words."""
    body = f"({'|'.join(terms)})"
    return body.join(BOUNDS) if bounded else body


def needles(pattern: str) -> tuple[list[str], bool] | None:
    """Texts of which one stands in whatever a pattern of any_of is found in, and whether that is all the pattern asks
    for; None for other patterns, and for those of a term that begins with no character of its own."""
    body = pattern.removeprefix(BOUNDS[0]).removesuffix(BOUNDS[1])
    if not re.fullmatch(r"\((?!\?).*\)", body, re.S):
        return None
    terms, depth = [""], 0
    for part in re.findall(r"\\.|\[(?:\\.|[^\]])*\]|.", body[1:-1], re.S):
        depth += (part == "(") - (part == ")")
        if depth < 0:  # the first parenthesis is not the last one's
            return None
        if part == "|" and not depth:
            terms.append("")
        else:
            terms[-1] += part
    plain = [re.match(r"(?:[^\\^$.|?*+()\[\]{}](?![?*{]))*", t)[0] for t in terms]
    return (plain, plain == terms and body == pattern) if all(plain) else None


def found(c: Column, pattern: str) -> Column:
    """Whether a pattern is found in a text: rlike, tried only on texts that hold one of the pattern's needles."""
    known = needles(pattern)
    if not known:
        return c.rlike(pattern)
    held = reduce(lambda a, b: a | b, [F.contains(c, F.lit(n)) for n in known[0]])
    return held if known[1] else held & c.rlike(pattern)


def digits_money(c: Column | str) -> Column:
    """A price in text: all its digits as one number; null without digits or for 0."""
    digits = F.nullif(F.regexp_replace(_s(c), "[^0-9]", ""), F.lit(""))
    return F.nullif(digits.try_cast("double"), F.lit(0.0))


def number_money(c: Column | str) -> Column:
    """A price that is a number already: itself if finite and above 0, else null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when((c > 0) & ~F.isnan(c) & (c < float("inf")), c.cast("double"))


NUMBER = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"


def number(c: Column | str) -> Column:
    """Text that is a decimal number in full, as a double; else null."""
    t = F.trim(_s(c))
    return F.when(t.rlike(NUMBER), t.try_cast("double"))


def rating(c: Column | str) -> Column:
    """0 to 5, else null."""
    return F.when(number(c).between(0, 5), number(c))


def review_count(c: Column | str) -> Column:
    """Rounded half up, from 0; else null."""
    return F.when(number(c) >= 0, F.floor(number(c) + 0.5).cast("long"))


PRICE = r"(?i)([0-9]{1,3}([.,][0-9]{3})+|[0-9]+)\s*(đ|₫|vnd)"
CONTACT = "Liên hệ báo giá"


def price_text(c: Column | str) -> Column:
    """The first price of a text, else the contact phrase if it stands there, else ''."""
    found = F.regexp_extract(_s(c), PRICE, 0)
    return F.when(found != "", found).when(F.lower(_s(c)).contains(CONTACT.lower()), F.lit(CONTACT)).otherwise(F.lit(""))


def declared_pages(c: Column | str) -> Column:
    """N of the first 'Page n / N', else null."""
    return F.nullif(F.regexp_extract(_s(c), r"(?i)Page\s+[0-9]+\s*/\s*([0-9]+)", 1), F.lit("")).try_cast("int")


def is_digits(c: Column | str) -> Column:
    return _s(c).rlike("^[0-9]+$")


def lines(c: Column | str) -> Column:
    """Lines of a text, cleaned, empty ones left out, in order."""
    return F.filter(F.transform(F.split(_s(c), "\r?\n"), clean), lambda x: x != "")


def find_label(rows: Column, patterns: list[str]) -> Column:
    """What stands after the first label of an array of lines: the rest of the line, else the line after it.

    Lines are tried in order and for each line the patterns; '' if none gives a value.
    """
    rest = lambda line, p: F.trim(F.regexp_replace(F.regexp_replace(line, p, ""), r"^\s*[:：-]\s*", ""))
    empty = F.lit("")

    def value(line: Column, following: Column) -> Column:
        tries = [F.when(line.rlike(p), F.coalesce(F.nullif(rest(line, p), empty), F.nullif(following, empty))) for p in patterns]
        return F.when(line.rlike("|".join(patterns)), F.coalesce(*tries))

    after = F.concat(F.slice(rows, 2, F.greatest(F.size(rows), F.lit(1))), F.array(empty))
    found = F.filter(F.zip_with(rows, after, value), lambda x: x.isNotNull())
    return F.coalesce(F.get(found, 0), empty)


def summary(rows: Column, heading: str, stop: str, most: int = 24, longest: int = 280) -> Column:
    """Up to `most` lines after the heading line, as far as a stop line, without long ones, joined by ' | '."""
    at = F.coalesce(F.array_position(F.transform(rows, lambda x: x.rlike(heading)), True), F.lit(0))
    block = F.when(at > 0, F.slice(rows, (at + 1).cast("int"), most)).otherwise(F.array().cast("array<string>"))
    end = F.coalesce(F.array_position(F.transform(block, lambda x: x.rlike(stop)), True), F.lit(0))
    body = F.when(end > 0, F.slice(block, 1, (end - 1).cast("int"))).otherwise(block)
    return F.array_join(F.filter(body, lambda x: F.length(x) <= longest), " | ")


def matching_lines(rows: Column, pattern: str, most: int = 10) -> Column:
    """The first lines that match, joined by ' | '."""
    return F.array_join(F.slice(F.filter(rows, lambda x: x.rlike(pattern)), 1, most), " | ")
