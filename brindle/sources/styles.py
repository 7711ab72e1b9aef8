"""Which elements of a page are seen: a small cascade over its style sheets and style attributes.

Selectors are lists of compounds of one tag, classes and an id (`a.menu#top`, `*`). Selectors with combinators,
attributes or pseudo-classes, and rules in at-rules, are passed over. Of the declarations display, visibility, width
and height count. The later of equally specific rules wins, an id beats classes, a class beats tags, the style
attribute beats all of them, and !important beats the rest. Elements below one that is not displayed are not displayed;
visibility is inherited and may be taken back below.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

#: An element is seen, is there without being seen (its descendants may be), or is not displayed with all below it.
SHOWN, UNSEEN, GONE = 0, 1, 2
#: Tags never displayed, tags that are blocks, tags with a size of their own.
NEVER = frozenset("script style head noscript template".split())
BLOCKS = frozenset("address article aside blockquote body dd div dl dt figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section table tbody td th thead tr ul".split())
SIZED = frozenset("button img input select textarea video iframe canvas".split())
PROPERTIES = ("display", "visibility", "width", "height")

COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.S)
COMPOUND = re.compile(r"(?:\*|[a-z][a-z0-9-]*)?(?:[.#][a-z0-9_-]+)*", re.I)
ZERO = re.compile(r"[+-]?0*\.?0+(?:[a-z]+|%)?$")


@dataclass(frozen=True)
class Rule:
    """tag, ids and classes that an element must have, and what it then gets; declarations: value and importance."""

    tag: str
    ids: frozenset[str]
    classes: frozenset[str]
    declarations: dict[str, tuple[str, bool]]
    rank: tuple[int, int, int, int]


def declarations(text: str) -> dict[str, tuple[str, bool]]:
    """The declarations that count, by property."""
    out: dict[str, tuple[str, bool]] = {}
    for part in text.split(";"):
        name, colon, value = part.partition(":")
        name, value = name.strip().lower(), value.strip().lower()
        if colon and name in PROPERTIES and value:
            important = value.endswith("!important")
            value = value.removesuffix("!important").strip()
            if important or not out.get(name, ("", False))[1]:
                out[name] = (value, important)
    return out


def blocks(sheet: str) -> list[tuple[str, str]]:
    """Selectors and bodies of a sheet's rules, those within at-rules left out."""
    out, sheet, at = [], COMMENT.sub(" ", sheet), 0
    while at < len(sheet):
        brace, end = sheet.find("{", at), sheet.find(";", at)
        head = sheet[at : brace if brace >= 0 else len(sheet)].strip()
        if head.startswith("@") and 0 <= end and (brace < 0 or end < brace):  # @import and its like
            at = end + 1
            continue
        if brace < 0:
            break
        depth, i = 1, brace + 1
        for m in re.compile(r"[{}]").finditer(sheet, i):
            depth += 1 if m[0] == "{" else -1
            i = m.end()
            if not depth:
                break
        body = sheet[brace + 1 : i - 1] if not depth else sheet[brace + 1 :]
        if not head.startswith("@"):
            out.append((head, body))
        at = i if not depth else len(sheet)
    return out


def rules(sheets: list[str]) -> list[Rule]:
    """Rules of sheets, in order."""
    out = []
    for sheet in sheets:
        for selectors, body in blocks(sheet):
            found = declarations(body)
            for selector in map(str.strip, selectors.split(",")) if found else ():
                if not selector or not COMPOUND.fullmatch(selector):
                    continue
                tag = re.match(r"[^.#]*", selector)[0].lower()
                tag = "" if tag == "*" else tag
                ids, classes = frozenset(re.findall(r"#([^.#]+)", selector)), frozenset(re.findall(r"\.([^.#]+)", selector))
                out.append(Rule(tag, ids, classes, found, (len(ids), len(classes), bool(tag), len(out))))
    return out


class Sheets:
    """Rules by the rarest thing that their elements must have, so that an element meets only those it may match."""

    def __init__(self, found: list[Rule]) -> None:
        self.by: dict[tuple[str, str], list[Rule]] = {}
        for r in found:
            key = ("#", min(r.ids)) if r.ids else (".", min(r.classes)) if r.classes else ("", r.tag)
            self.by.setdefault(key, []).append(r)

    def declared(self, tag: str, attributes: dict[str, str]) -> dict[str, str]:
        """The winning values of an element."""
        ids, classes = {attributes["id"]} if attributes.get("id") else set(), set(attributes.get("class", "").split())
        best: dict[str, tuple] = {"display": (((-1,), False), "none")} if "hidden" in attributes else {}
        keys = [("#", x) for x in ids] + [(".", x) for x in classes] + [("", tag), ("", "")]
        found = [(r.rank, r.declarations) for k in keys for r in self.by.get(k, ()) if r.ids <= ids and r.classes <= classes and r.tag in ("", tag)]
        style = attributes.get("style")
        if style:
            found.append(((1 << 30,), declarations(style)))
        for rank, values in found:
            for name, (value, important) in values.items():
                if name not in best or (important, rank) >= (best[name][0][1], best[name][0][0]):
                    best[name] = ((rank, important), value)
        return {k: v for k, (_, v) in best.items()}


def visibility(elements: list[dict], sheets: list[str]) -> list[int]:
    """SHOWN, UNSEEN or GONE for each element (tag, attributes, parent's number), in document order. Elements without
    width or height are marked flat."""
    cascade, out, hidden = Sheets(rules(sheets)), [], []
    for e in elements:
        above, tag = e["parent"], e["tag"]
        if tag in NEVER or (above >= 0 and out[above] == GONE):
            out.append(GONE)
            hidden.append(True)
            continue
        own = e["attributes"]
        inherited = above >= 0 and hidden[above]
        if not cascade.by and "style" not in own and "hidden" not in own:  # nothing is declared
            hidden.append(inherited)
            e["flat"] = False
            out.append(UNSEEN if inherited else SHOWN)
            continue
        got = cascade.declared(tag, own)
        unseen = got.get("visibility", "inherit")
        unseen = inherited if unseen in ("inherit", "unset") else unseen in ("hidden", "collapse")
        hidden.append(unseen)
        display = got.get("display", "block" if tag in BLOCKS else "inline-block" if tag in SIZED else "inline")
        e["flat"] = display not in ("inline", "contents") and any(ZERO.match(got.get(k, "auto")) for k in ("width", "height"))
        out.append(GONE if display == "none" else UNSEEN if unseen else SHOWN)
    return out
