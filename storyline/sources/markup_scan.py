"""A recovering scanner of feed markup: entries of RSS and Atom as feeds come in the wild, well-formed or not."""

from __future__ import annotations

import html
import re

#: Prefixes by the namespaces they stand for when a feed does not say; "" is the feed's own vocabulary.
ATOM, ATOM_OLD, DUBLIN_CORE = "http://www.w3.org/2005/Atom", "http://purl.org/atom/ns#", "http://purl.org/dc/elements/1.1/"
OWN = ("", ATOM, ATOM_OLD, "http://purl.org/rss/1.0/", "http://my.netscape.com/rdf/simple/0.9/", "http://backend.userland.com/rss2", "http://channel.netscape.com/rdf/simple/0.9/")
KNOWN = {"atom": ATOM, "a10": ATOM, "dc": DUBLIN_CORE}
ENTRIES = ("item", "entry")
FIELDS = ("title", "link", "id", "guid", "published", "updated", "created", "pubDate", "date")
#: Elements that end an open field, where its own end is missing.
SIBLINGS = frozenset((*FIELDS, "description", "summary", "content", "author", "category", "source", "comments", "enclosure", "rights"))
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<data>.*?)(?:\]\]>|\Z)|<\?.*?(?:\?>|\Z)|<!(?:[^<>\[]|\[[^\]]*\])*>"
    r"|<(?P<end>/?)(?P<name>[A-Za-z_][\w.\-]*(?::[A-Za-z_][\w.\-]*)?)(?P<rest>(?:\s+(?:[^<>\"']|\"[^\"]*\"|'[^']*')*)?/?)>|(?P<text>[^<]+|<)", re.S,
)
_ATTRIBUTE = re.compile(r"""([\w.:\-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>/]+))""")
_ENTITY = re.compile(r"&(?:#\d{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});")


def plain(text: str) -> str:
    """Text without its entities, those of HTML too; what only looks like one stays."""
    return _ENTITY.sub(lambda m: html.unescape(m[0]), text)


def entries(body: str | None) -> list[dict]:
    """Entries in order, each its fields' first texts and its links as ``(relation, address)``.

    An entry ends where its end tag, the next entry or the feed's end stands;
    one that the payload breaks off in is left out, and so is all of what is no
    feed. Only elements of the feed's own vocabulary, and dates of Dublin Core,
    are fields: ``media:title`` is none, nor is what an entry's ``source``
    holds. Markup inside a field counts as its text.
    """
    found: list[dict] = []
    spaces: list[tuple[str, dict[str, str]]] = []  # open elements and what prefixes mean inside
    meaning: dict[str, str] = {}
    entry = field = None
    depth = field_depth = 0
    text: list[str] = []

    def close_field() -> None:
        nonlocal field
        if field == "link":
            entry["links"].append((link_kind, "".join(text).strip() or link_href))
        elif field and field not in entry:
            entry[field] = "".join(text)
        field = None
        text.clear()

    def close_entry() -> None:
        nonlocal entry
        if field:
            close_field()
        found.append(entry)
        entry = None

    link_kind = link_href = None
    seen_root = False
    for token in _TOKEN.finditer(body or ""):
        if (data := token["data"]) is not None:
            if field:
                text.append(data)
            continue
        if (piece := token["text"]) is not None:
            if field:
                text.append(plain(piece))
            continue
        if (name := token["name"]) is None:
            continue
        prefix, _, local = name.rpartition(":")
        if token["end"]:
            place = next((k for k in range(len(spaces) - 1, -1, -1) if spaces[k][0] == name), None)
            if place is None:
                continue  # an end without a begin
            own = spaces[place][1].get(prefix, KNOWN.get(prefix, "" if not prefix else prefix)) in OWN
            if entry is not None:
                if field and place <= field_depth:
                    close_field()
                if place < depth or own and local in ENTRIES and place == depth:
                    close_entry()
            del spaces[place:]
            meaning = spaces[-1][1] if spaces else {}
            continue
        rest = token["rest"]
        attributes = {m[1]: plain(next(v for v in m.groups()[1:] if v is not None)) for m in _ATTRIBUTE.finditer(rest)} if "=" in rest else {}
        inner = meaning
        if any(k == "xmlns" or k.startswith("xmlns:") for k in attributes):
            inner = meaning | {k[6:]: v for k, v in attributes.items() if k == "xmlns" or k.startswith("xmlns:")}
        space = inner.get(prefix, KNOWN.get(prefix, prefix))
        empty = rest.endswith("/")
        seen_root = seen_root or local in ("rss", "RDF", "feed", "channel")
        if space in OWN and local in ENTRIES and (entry is None or field is None or local == "item"):
            if entry is not None:
                close_entry()
                del spaces[depth:]
            entry, depth = {"links": []}, len(spaces)
        elif entry is not None:
            own_child = len(spaces) == depth + 1
            if field and len(spaces) > field_depth and space in OWN and local in SIBLINGS and not any(s[0].rpartition(":")[2] in ("div", "span") for s in spaces[field_depth:]):
                # The field before has no end of its own.
                close_field()
                del spaces[field_depth:]
                own_child = True
            name_here = "date" if space == DUBLIN_CORE and local == "date" else local if space in OWN and local in FIELDS else None
            if field is None and own_child and name_here:
                link_kind, link_href = attributes.get("rel", "alternate"), attributes.get("href")
                field, field_depth = name_here, len(spaces)
                if empty:
                    close_field()
        if not empty:
            spaces.append((name, inner))
            meaning = inner
    return found if seen_root else []
