"""Pages to rows (P20 to P26, S10, S19): a small element tree by the standard library, walked in vectorised functions.

Each parser takes a frame of pages and returns rows; pages are independent, so they are spread over all tasks and a page that
can't be read fails alone (R4). Simple things, as links and titles, are expressions and need no Python.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


class Node:
    """An element: name, attributes, children (elements and texts) and parent."""

    def __init__(self, name: str, attrs: dict[str, str], parent: Node | None):
        self.name, self.attrs, self.parent, self.children = name, attrs, parent, []

    @property
    def classes(self) -> list[str]:
        return (self.attrs.get("class") or "").split()

    def walk(self) -> Iterator[Node]:
        for c in self.children:
            if isinstance(c, Node):
                yield c
                yield from c.walk()

    def all(self, name: str | None = None, cls: str | None = None, **attrs: str) -> list[Node]:
        """Elements below this one, in document order, of that name, class and attributes."""
        fits = lambda n: (name is None or n.name == name) and (cls is None or cls in n.classes) and all(n.attrs.get(k) == v for k, v in attrs.items())
        return [n for n in self.walk() if fits(n)]

    def first(self, name: str | None = None, cls: str | None = None, **attrs: str) -> Node | None:
        return next(iter(self.all(name, cls, **attrs)), None)

    def following(self) -> list[Node]:
        """The elements after this one below the same parent."""
        near = [c for c in self.parent.children if isinstance(c, Node)] if self.parent else []
        return near[near.index(self) + 1 :] if self in near else []

    @property
    def text(self) -> str:
        return "".join(c if isinstance(c, str) else c.text for c in self.children)


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)

    def handle_starttag(self, tag, attrs):
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.at.children.append(Node(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag):
        node = self.at
        while node.parent and node.name != tag:
            node = node.parent
        if node.parent:
            self.at = node.parent

    def handle_data(self, data):
        self.at.children.append(data)


def tree(html: str) -> Node:
    b = _Builder()
    b.feed(html or "")
    b.close()
    return b.root


def clean(text: str) -> str:
    return " ".join(text.split())


def spaced(text: str) -> str:
    """Line ends become spaces and runs of spaces one; other white space stays inside."""
    return re.sub(" +", " ", text.replace("\n", " ")).strip()


def ranking_rows(page: Node) -> list[dict]:
    """P20: rows of a ranking table by header; a cell that only says "view" is its link. Even rows come first."""
    heads = [t.first("b").text if t.first("b") else clean(t.text) for t in page.all("th")]
    out = []
    for row in page.all("tr", "evenrow") + page.all("tr", "oddrow"):
        values = dict.fromkeys(heads)
        for head, cell in zip(heads, row.all("td"), strict=False):
            text = cell.text.strip()
            link = cell.first("a")
            values[head] = link.attrs.get("href") if text == "view" and link else text
        out.append(values)
    return out


def board_members(page: Node) -> list[dict]:
    """Profiles of an editorial board; what stands between two section titles has the first one's role."""
    title = page.first(cls="title")
    out = []
    for head in page.all(cls="section__title"):
        for near in head.following():
            if near.classes[:1] == ["section__title"]:
                break
            if near.name != "div" or near.classes[:1] != ["row"]:
                continue
            for profile in near.all("div", "profile-meta"):
                name = profile.first("h4", "item-meta-row")
                place = profile.first("div", "item-meta-row")
                country = profile.first("em")
                out.append({"role": spaced(head.text), "journal": spaced(title.text) if title else None, "name": spaced(name.text) if name else None, "affiliation": spaced(place.text) if place else None, "country": spaced(country.text) if country else None})
    return out


def _facts(page: Node, leave_out: tuple[str, ...] = ()) -> dict:
    """Titles and values of the bibliographic list, titles as column names."""
    out = {}
    for item in page.all("li", "bibliographic-information__item"):
        title, value = item.first("span", "bibliographic-information__title"), item.first("span", "bibliographic-information__value")
        if title and value and clean(title.text) not in leave_out:
            out[clean(title.text).replace(" ", "_").lower()] = clean(value.text)
    return out


def book_info(page: Node) -> list[dict]:
    """What a book page says of the book, and where its front matter is."""
    out = _facts(page, ("Editors", "Topics"))
    link = next((a for item in page.all("li", "front-matter-item") for a in item.all("a") if a.attrs.get("aria-label") == "Download PDF - Front Matter"), None)
    return [out | {"front_matter_url": link.attrs.get("href") if link else None}]


def _people(page: Node, area: str, kind: str, number: str) -> list[dict]:
    place = page.first(id=area)
    out = []
    for n, item in enumerate((x for x in place.all("li") if x.attrs.get("itemprop") == kind), 1) if place else ():
        name, orc, places = item.first("span", "authors-affiliations__name"), item.first("span", "author-information__orcid"), item.first("ul", "authors-affiliations__indexes")
        person = {number: str(n), "name": clean(name.text) if name else None}
        if orc and orc.first("a"):
            person["orc"] = orc.first("a").attrs.get("href")
        info = item.first("span", "author-information")
        for c in (c for s in (info.all("span") if info else []) for c in s.walk() if "itemprop" in c.attrs):
            person[c.attrs["itemprop"]] = c.attrs.get("title") or c.attrs.get("href") or clean(c.text)
        person["affiliation_ids"] = [clean(x.attrs.get("data-affiliation", "")) for x in places.all("li")] if places else []
        out.append(person)
    return out


def editors(page: Node) -> list[dict]:
    """Editors of a book, from the bibliographic list where there is no list of editors."""
    found = _people(page, "editorsandaffiliations", "editor", "editor_id")
    if found:
        return found
    for item in page.all("li", "bibliographic-information__item"):
        title, value = item.first("span", "bibliographic-information__title"), item.first("span", "bibliographic-information__value")
        if title and value and clean(title.text) == "Editors":
            names = [clean(c) for c in value.children if isinstance(c, str) and clean(c)]
            return [{"editor_id": str(n), "name": x, "affiliation_ids": []} for n, x in enumerate(names, 1)]
    return []


def authors(page: Node) -> list[dict]:
    """Authors of a chapter with ORCID and marked properties, as email and url."""
    return _people(page, "authorsandaffiliations", "author", "doc_person_id")


def chapter_info(page: Node) -> list[dict]:
    """What a chapter page says of the chapter."""
    title = page.first("h1", "ChapterTitle")
    return [_facts(page) | {"title": title.text if title else None}]


def affiliations(page: Node) -> list[dict]:
    """Affiliations of a page by number."""
    out = []
    for item in page.all("li", "affiliation"):
        part = lambda c: (lambda x: clean(x.text) if x else None)(item.first("span", c))  # noqa: E731, B023
        number = item.attrs.get("data-affiliation-highlight") or (item.attrs.get("data-test") or "").removeprefix("affiliation-")
        out.append({"id": number, "department": part("affiliation__department"), "name": part("affiliation__name"), "city": part("affiliation__city"), "country": part("affiliation__country")})
    return out


def journals(page: Node) -> list[dict]:
    """P25: journals of a result list."""
    out = []
    for entry in page.all("article", "search-result"):
        title = entry.first(cls="search-result-journal-title")
        link, issn = title.first("a") if title else None, entry.first(cls="journal-result-issn")
        if link:
            out.append({"href": link.attrs.get("href"), "title": link.text, "issn": issn.text if issn else None})
    return out


def chapter_links(page: Node) -> list[dict]:
    """Links to the chapters of a book."""
    return [{"href": a.attrs.get("href")} for c in page.all("li", "chapter-item") if (a := c.first("a", "u-interface-link"))]


def parse(pages: DataFrame, parser: Callable[[Node], list[dict]], key: str = "path", html: str = "html") -> DataFrame:
    """Rows (key, n, status, error, record): each record that the parser finds in each page as a map of texts.

    A page that can't be read has one row with its error; a page with nothing to find has none. Lists in a record are JSON.
    """
    kind = dict(pages.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        text = lambda v: v if v is None or isinstance(v, str) else json.dumps(v)
        for b in batches:
            out = []
            for k, page in zip(b[key], b[html], strict=True):
                try:
                    out += [(k, n, "SUCCEEDED", None, {a: text(v) for a, v in r.items()}) for n, r in enumerate(parser(tree(page)))]
                except Exception as e:  # noqa: BLE001  one page's failure is that page's
                    out.append((k, 0, "FAILED", str(e), {}))
            yield pd.DataFrame(out, columns=[key, "n", "status", "error", "record"])

    return pages.select(key, html).mapInPandas(run, f"`{key}` {kind}, n int, status string, error string, record map<string, string>")


def fields(found: DataFrame, names: list[str], *keys: str) -> DataFrame:
    """The named fields of records as columns, null where a record lacks them."""
    return found.where("status = 'SUCCEEDED'").select(*keys, *[F.col("record").getItem(n).alias(n) for n in names])


def with_affiliations(people: DataFrame, places: DataFrame, key: str, number: str) -> DataFrame:
    """A row for each person and affiliation of the same page; people without one have none."""
    p = people.select(key, number, F.explode(F.from_json("affiliation_ids", "array<string>")).alias("affiliation_id"))
    a = places.select(F.col(key).alias("_key"), F.col("id").alias("_id"), "department", F.col("name").alias("name"), "city", "country")
    return p.join(a, (F.col(key) == F.col("_key")) & (F.col("affiliation_id") == F.col("_id"))).drop("_key", "_id")


def stamped(rows: DataFrame, **values: str) -> DataFrame:
    """The same values on every row of a batch."""
    return rows.withColumns({k: F.lit(v) for k, v in values.items()})


# Expressions for what needs no tree
def title(html: Column | str) -> Column:
    """The text of the title element; empty without one."""
    return F.regexp_extract(html, "(?s)<title>(.*?)</title>", 1)


def links(html: Column | str) -> Column:
    """All href values in order."""
    return F.regexp_extract_all(html, F.lit('href="([^"]*)"'), F.lit(1))


def spans(html: Column | str, *names: str) -> Column:
    """From each start tag without attributes to the next end tag of its name, in order; what lies in a span is not looked at again."""
    return F.regexp_extract_all(html, F.lit("(?s)" + "|".join(f"<{n}>.*?</{n}>" for n in names)), F.lit(0))


def plain(html: Column | str) -> Column:
    """The text of a piece of source: tags go, four entities are read where they are complete, ASCII white space is one space.

    What is cut off, as "&amp" without its end, stays as it is.
    """
    out = F.regexp_replace(html, "<[^>]*>", "")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.regexp_replace(F.regexp_replace(out, r"[\t\n\f\r ]+", " "), r"^\p{Zs}+|\p{Zs}+\z", "")
