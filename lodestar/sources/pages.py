"""Detail pages of listings as records: a small element tree in Arrow batches, one reader for each layout."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser
from urllib.parse import unquote, urljoin

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_BLOCKS = frozenset("p br div li tr td h1 h2 h3 h4 h5 h6 table section".split())
#: Words by which a line names an organisation, and how a contact line begins. Fixed values.
ORGANISATION = ("university", "institute", "college", "centre", "center", "laboratory", "department", "foundation", "corporation")
CONTACT = "for inquiries"
_LEVEL = re.compile(r"TRL[-\s]*(\d)", re.I)
_GAUGE = re.compile(r"renderTo:\s*['\"]TRIGaugeDiv['\"][\s\S]+?data:\s*\[(\d)\]")
_ACRONYM = re.compile(r"\[([A-Z]+[-–][A-Z0-9]+)\]")


@dataclass
class Element:
    tag: str
    attrs: dict[str, str]
    parent: Element | None = None
    children: list[Element | str] = field(default_factory=list)

    def walk(self) -> Iterator[Element]:
        for c in self.children:
            if isinstance(c, Element):
                yield c
                yield from c.walk()

    def text(self, lines: bool = False) -> str:
        """Text without scripts, white space collapsed; with ``lines`` a line for each block."""
        parts: list[str] = []

        def collect(e: Element) -> None:
            for c in e.children:
                if isinstance(c, str):
                    parts.append(c)
                elif c.tag not in ("script", "style"):
                    parts.append("\n" if lines and c.tag in _BLOCKS else " ")
                    collect(c)
                    parts.append("\n" if lines and c.tag in _BLOCKS else " ")

        collect(self)
        whole = "".join(parts)
        return "\n".join(x for x in (" ".join(line.split()) for line in whole.split("\n")) if x) if lines else " ".join(whole.split())

    def all(self, tag: str = "", cls: str = "") -> list[Element]:
        wanted = set(cls.split())
        return [e for e in self.walk() if (not tag or e.tag == tag) and wanted <= set(e.attrs.get("class", "").split())]

    def first(self, tag: str = "", cls: str = "") -> Element | None:
        return next(iter(self.all(tag, cls)), None)


class _Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Element("", {})

    def handle_starttag(self, tag: str, attrs: list) -> None:
        e = Element(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(e)
        if tag not in _VOID:
            self.at = e

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.at.children.append(Element(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag: str) -> None:
        e: Element | None = self.at
        while e is not None and e.tag != tag:
            e = e.parent
        if e is not None and e.parent is not None:
            self.at = e.parent

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)


def parsed(html: str | None) -> Element:
    tree = _Tree()
    tree.feed(html or "")
    tree.close()
    return tree.root


def _level(text: str) -> str:
    m = _LEVEL.search(text)
    return f"TRL-{m.group(1)}" if m else ""


def innovation_page(html: str, url: str) -> dict | None:
    """A page that runs its labels and values together in one block of text; none without that block."""
    block = parsed(html).first(cls="pageContent detail")
    if block is None:
        return None
    text = block.text()

    def between(label: str, *stops: str) -> str:
        m = re.search(rf"{label}:?\s*(.+?)(?:{'|'.join(map(re.escape, stops))}|$)", text)
        return m.group(1).strip() if m else ""

    return {"title": between("Title of the Innovation", "Brief About Innovation"), "sector": between("Area of Technology", "Title of the Innovation"), "summary": between("Brief About Innovation", "Contact for the Technology", "Express Interest") or text, "institute": "", "level": ""}


def profile_page(html: str, url: str) -> dict | None:
    """A page with a table of captions and values, a gauge in a script, and the institute's acronym in brackets beside its picture."""
    root = parsed(html)
    fields: dict[str, str] = {}
    for row in root.all("tr"):
        caption, value = row.first(cls="tech_caption"), row.first(cls="tech_data")
        if caption is not None and value is not None:
            fields[caption.text().rstrip(":").strip().lower()] = value.text()
    title = root.first("title")
    picture = next((e for e in root.all("img") if "img/lab/" in e.attrs.get("src", "")), None)
    institute = ""
    if picture is not None:
        around = picture.parent.parent if picture.parent is not None and picture.parent.parent is not None else picture.parent
        acronym = _ACRONYM.search(around.text())
        institute = acronym.group(1).replace("–", "-") if acronym else " ".join(picture.attrs.get("alt", "").split())
    gauge = _GAUGE.search(html)
    uses: list[str] = []
    for box in root.all(cls="box-info"):
        label = box.first(cls="label-primary")
        if label is not None and "industrial applications" in label.text().lower():
            uses = list(dict.fromkeys(t for t in (e.text() for e in box.all(cls="label-default")) if t))
            break
    summary = " ".join(fields[k] for k in ("value proposition", "summary application", "advantages") if fields.get(k))
    return {"title": fields.get("title") or (title.text() if title is not None else "Untitled"), "sector": "; ".join(uses), "summary": summary, "institute": institute, "level": f"TRL-{gauge.group(1)}" if gauge else _level(root.text())}


def article_page(html: str, url: str) -> dict | None:
    """A page with a headline, paragraphs, and a profile whose lines name the institute before the contact lines."""
    root = parsed(html)
    headline = root.first("h1") or root.first("title")
    institute, profile = "", root.first(cls="field--name-field-profile-of-technologist")
    for p in profile.all("p") if profile is not None else ():
        for line in p.text(lines=True).split("\n"):
            candidate = line.strip(" ,;-")
            if candidate.lower().startswith(CONTACT):
                break
            if not institute and "@" not in candidate and any(w in candidate.lower() for w in ORGANISATION):
                institute = candidate
    body = root.first(cls="field--name-body")
    return {"title": headline.text() if headline is not None else "", "sector": "", "summary": " ".join(p.text() for p in body.all("p") if p.text()) if body is not None else "", "institute": institute, "level": _level(root.text())}


def status_page(html: str, url: str) -> dict | None:
    """A page with one of several kinds of headline, blocks of text each told once, and a status."""
    root = parsed(html)
    content = next((e for e in root.walk() if e.attrs.get("id") == "page-content"), None)
    titles = [e.text() for e in ([content.first("span", "h2 font-weight-bold")] if content is not None else []) + [root.first("h1"), root.first("h2", "title"), root.first(cls="content-title"), root.first("h2")] if e is not None]
    slug = unquote(url.rstrip("/").rsplit("/", 1)[-1])
    number = re.search(r"/content/(\d+)-", url)
    if number:
        slug = slug.removeprefix(f"{number.group(1)}-")
    title = next((t for t in titles if len(t) > 2), "") or slug.replace("-", " ").strip()
    parts: list[str] = []
    for e in (content.all(cls="d-block") or content.all("p")) if content is not None else ():
        t = e.text()
        if len(t) > 20 and t not in parts:
            parts.append(t)
    status, keeper = root.first(cls="text-success"), root.first(cls="conversation-panel")
    name = keeper.first(cls="font-weight-bold") if keeper is not None else None
    return {"title": title, "sector": "", "summary": " ".join(parts[:3]), "institute": name.text() if name is not None and len(name.text()) > 3 else "", "level": status.text() if status is not None else ""}


READERS: dict[str, Callable[[str, str], dict | None]] = {"innovation": innovation_page, "profile": profile_page, "article": article_page, "status": status_page}
RECORD = ("title", "sector", "summary", "institute", "level")


def page_records(df: DataFrame, key: str, html: str, url: str, layout: str) -> DataFrame:
    """(key, title, sector, summary, institute, level) of stored pages by the layout each row names.

    Rows of an unknown layout, null pages and pages without the block their layout needs
    give no record. One narrow Arrow stage.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, out = [], []
            for i, (page, address, name) in enumerate(zip(*(batch.column(c).to_pylist() for c in (1, 2, 3)))):
                found = READERS[name](page, address or "") if page and name in READERS else None
                if found:
                    rows.append(i)
                    out.append(found)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), *(pa.array([o[c] for o in out], pa.string()) for c in RECORD)], ["k", *RECORD])

    return df.select(key, html, url, layout).mapInArrow(run, f"k {kind}, " + ", ".join(f"{c} string" for c in RECORD)).withColumnRenamed("k", key)


def listed_addresses(df: DataFrame, page: str, html: str, base_url: str, pattern: str, fallback: str) -> DataFrame:
    """(page, url): addresses that listing pages link to; a page without any of the pattern gives those of the fallback pattern. Each address once, with the first page that has it."""
    kind = df.schema[page].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, links = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                found = list(dict.fromkeys(urljoin(base_url, e.attrs["href"]) for e in parsed(text).all("a") if e.attrs.get("href")))
                own = [u for u in found if re.search(pattern, u)] or [u for u in found if re.search(fallback, u)]
                rows += [i] * len(own)
                links += own
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(links, pa.string())], ["k", "url"])

    return df.select(page, html).mapInArrow(run, f"k {kind}, url string").groupBy("url").agg(F.min("k").alias(page)).select(page, "url")
