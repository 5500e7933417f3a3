"""Pages of a directory and of its people to rows: contact cards, course blocks, the fields of a person's page.

A page's markup is read in Python, in Arrow batches, by a small tree of elements; what comes out are arrays of structs that Spark
inlines, classifies and joins. Missing elements give empty texts. Unclosed elements end with their parent; a closing tag without
an opening one is passed over; links are resolved against the page, malformed ones are empty.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from syllabary.sources.schemas import CONTACT, COURSE_BLOCK, PERSON

# Classes and labels of the pages.
CARD, BLOCK = "table.contact.vcard", "div.linked-data-list"
CARD_TEXTS = {"uid": "th.uid", "name": "td.fn.name", "role": "tr.role td", "department": "tr.org td", "address": "tr.adr td", "email": "a.email"}
MAP_LABEL = "[ Vai alla mappa ]"
PARTS = {"integrated_course": "Componente del corso integrato", "lesson_period": "Periodo delle lezioni:"}
HEADERS = {"campus": "Campus", "degree_course": "Corso"}
LINKS = {"schedule_url": "Orario delle lezioni", "virtuale_url": "Risorse didattiche su Virtuale"}
PAGER = ("pages_before", ".totalPageNumber")
PERSON_TEXTS = {"role": "p.qualifica", "affiliation": "p.sede", "ssd": "p.ssd"}
# End of fixed values.

_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


class Element:
    """A tag with its attributes and children (elements and texts)."""

    __slots__ = ("attributes", "children", "classes", "tag")

    def __init__(self, tag: str, attributes: dict[str, str]):
        self.tag, self.attributes, self.children = tag, attributes, []
        self.classes = frozenset(attributes.get("class", "").split())

    def below(self) -> Iterator[Element]:
        """Every element inside, in order."""
        todo = [x for x in reversed(self.children) if isinstance(x, Element)]
        while todo:
            one = todo.pop()
            yield one
            todo += [x for x in reversed(one.children) if isinstance(x, Element)]

    def text(self) -> str:
        """All texts inside, stripped and joined by blanks, their white space squeezed."""
        found, todo = [], [self]
        while todo:
            one = todo.pop()
            if isinstance(one, str):
                found.append(one)
            elif one.tag not in ("script", "style"):
                todo += reversed(one.children)
        return " ".join(" ".join(found).split())

    def find(self, path: str) -> Iterator[Element]:
        """Elements that match the last of ``tag.class`` steps and stand inside matches of those before it."""
        head, _, rest = path.partition(" ")
        tag, *classes = head.split(".")
        seen = set()
        for one in self.below():
            if (not tag or one.tag == tag) and one.classes.issuperset(classes):
                for found in one.find(rest) if rest else (one,):
                    if id(found) not in seen:
                        seen.add(id(found))
                        yield found

    def first_text(self, path: str) -> str:
        return next((x.text() for x in self.find(path)), "")


class _Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open = [Element("", {})]

    def handle_starttag(self, tag, attrs):
        one = Element(tag, {k: v or "" for k, v in attrs})
        self.open[-1].children.append(one)
        if tag not in _VOID:
            self.open.append(one)

    def handle_startendtag(self, tag, attrs):
        self.open[-1].children.append(Element(tag, {k: v or "" for k, v in attrs}))

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return

    def handle_data(self, data):
        self.open[-1].children.append(data)


def tree(html: str) -> Element:
    """The elements of a page."""
    page = _Tree()
    page.feed(html)
    page.close()
    return page.open[0]


def resolved(base: str | None, href: str | None) -> str:
    """A link resolved against its page; empty where it is empty or malformed."""
    try:
        return urljoin(base or "", href.strip()) if href and href.strip() else ""
    except ValueError:
        return ""


def _cards(page: Element, base: str) -> list[dict]:
    rows = []
    for card in page.find(CARD):
        row = {name: card.first_text(path) for name, path in CARD_TEXTS.items()}
        row["address"] = row["address"].replace(MAP_LABEL, "").strip()
        row["website"] = next((resolved(base, x.attributes.get("href")) for x in card.find("a.url")), "")
        row["vcard"] = next((resolved(base, x.attributes.get("href")) for x in card.find("tr td a") if "Vcard" in x.attributes.get("title", "")), "")
        rows.append(row)
    return rows


def table_value(block: Element, label: str) -> str:
    """The cell beside the header cell that says ``label``, its colon apart."""
    return next((row.first_text("td") for row in block.find("table tr") if row.first_text("th").rstrip(":") == label), "")


def _blocks(page: Element, base: str) -> list[dict]:
    rows = []
    for block in page.find(BLOCK):
        title = next(block.find("h4 a"), None)
        row = {"course_title": title.text() if title else "", "course_url": resolved(base, title.attributes.get("href")) if title else ""}
        row |= dict.fromkeys(PARTS, "")
        for child in block.children:
            said = "" if isinstance(child, str) else child.text() if child.tag == "p" else child.first_text("p") if child.tag == "div" else ""
            for name, begin in PARTS.items():
                if said.startswith(begin):  # the last one counts
                    row[name] = said
                    break
        row |= {name: table_value(block, label) for name, label in HEADERS.items()}
        anchors = [(x.text().lower(), x.attributes.get("href")) for x in block.find(".link-wrapper a")]
        row |= {name: next((resolved(base, href) for said, href in anchors if label.lower() in said), "") for name, label in LINKS.items()}
        rows.append(row)
    return rows


def _person(page: Element, base: str) -> dict:
    return {name: page.first_text(path) for name, path in PERSON_TEXTS.items()}


def _reader(read: Callable[[Element, str], object], kind: T.DataType):
    @F.pandas_udf(kind)
    def run(html: pd.Series, base: pd.Series) -> pd.Series:
        return pd.Series([None if h is None else read(tree(h), b or "") for h, b in zip(html, base, strict=True)], dtype=object)

    return run


_cards_of = _reader(_cards, T.ArrayType(CONTACT))
_blocks_of = _reader(_blocks, T.ArrayType(COURSE_BLOCK))


@F.pandas_udf(PERSON)
def _person_of(html: pd.Series, base: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_person(tree(h or ""), b or "") for h, b in zip(html, base, strict=True)], columns=PERSON.names, dtype=object)


def contact_cards(html: Column, base: Column) -> Column:
    """array of ``schemas.CONTACT``: every contact card of a page, in order, roles and departments as they are written."""
    return _cards_of(html, base)


def course_blocks(html: Column, base: Column) -> Column:
    """array of ``schemas.COURSE_BLOCK``: every course block of a page, in order."""
    return _blocks_of(html, base)


def person_fields(html: Column, base: Column) -> Column:
    """``schemas.PERSON``: role, affiliation and sector of a person's page, as they are written; a null page has none."""
    return _person_of(html, base)
