"""Records out of stored HTML pages, parsed in Arrow batches with the standard parser."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import quote, urljoin

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F



class _Events(HTMLParser):
    """Flat list of (tag, text, href, row, cell) of the elements that carry records."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[tuple[str, str, str, int, int]] = []
        self.row = self.cell = -1
        self.open: list[tuple[str, list[str], str, int, int]] = []
        self.skip = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ("script", "style"):
            self.skip += 1
        if tag == "tr":
            self.row, self.cell = self.row + 1, -1
        if tag in ("td", "th"):
            self.cell += 1
        if tag in ("a", "td", "th", "title", "p", "li", "h1", "h2", "h3", "h4", "h5", "h6"):
            self.open.append((tag, [], dict(attrs).get("href") or "", self.row, self.cell))

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style"):
            self.skip = max(0, self.skip - 1)
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                name, parts, href, row, cell = self.open.pop(i)
                self.out.append((name, " ".join("".join(parts).split()), href, row, cell))
                break

    def handle_data(self, data: str) -> None:
        if not self.skip:
            for _, parts, *_rest in self.open:
                parts.append(data)


def page_events(html: str | None) -> list[tuple[str, str, str, int, int]]:
    parser = _Events()
    parser.feed(html or "")
    parser.close()
    return parser.out


ELEMENTS = "ord int, tag string, text string, href string, row int, cell int"


def page_elements(df: DataFrame, key: str, html: str, base_url: str = "") -> DataFrame:
    """(key, ord, tag, text, href, row, cell) of headings, links, cells, list items and paragraphs of every page, links made absolute."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for i, page in enumerate(batch.column(1).to_pylist()):
                for n, (tag, text, href, row, cell) in enumerate(page_events(page)):
                    link = urljoin(base_url, quote(href, safe="%/:=&?~#+!$,;'@()*[]")) if href else ""
                    rows.append((i, n, tag, text, link, row, cell))
            cols = list(zip(*rows)) or [[]] * 7
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(cols[0], pa.int64())), pa.array(cols[1], pa.int32()), *(pa.array(c, pa.string()) for c in cols[2:5]), *(pa.array(c, pa.int32()) for c in cols[5:7])],
                ["k", "ord", "tag", "text", "href", "row", "cell"],
            )

    return df.select(key, html).mapInArrow(run, f"k {kind}, {ELEMENTS}").withColumnRenamed("k", key)


def table_rows(elements: DataFrame, key: str, least_cells: int = 3) -> DataFrame:
    """(key, row, cells) of table rows with enough cells, in order."""
    cells = elements.where(F.col("tag") == "td").groupBy(key, "row").agg(F.transform(F.array_sort(F.collect_list(F.struct("cell", "ord", "text"))), lambda x: x["text"]).alias("cells"))
    return cells.where(F.size("cells") >= least_cells)


def key_values(elements: DataFrame, key: str) -> DataFrame:
    """(key, name, value) of two-cell table rows."""
    return table_rows(elements.withColumn("tag", F.when(F.col("tag") == "th", "td").otherwise(F.col("tag"))), key, 2).select(key, F.lower(F.regexp_replace(F.get("cells", F.lit(0)), r"\s*:\s*$", "")).alias("name"), F.get("cells", F.lit(1)).alias("value"))


def headed_links(elements: DataFrame, key: str, suffix: str = "", excluded_hosts: tuple[str, ...] = ()) -> DataFrame:
    """(key, category, text, href): links with the heading last seen before them on their page, each URL once.

    The heading is carried forward within a page; pages are small, tables of pages are not.
    """
    w = Window.partitionBy(key).orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    heading = F.when(F.col("tag").rlike("^h[1-6]$"), F.col("text"))
    links = elements.withColumn("category", F.last(heading, ignorenulls=True).over(w)).where((F.col("tag") == "a") & (F.col("href") != ""))
    path = F.lower(F.regexp_extract("href", r"^https?://[^/?#]+([^?#]*)", 1))
    host = F.regexp_extract("href", r"^https?://([^/?#]+)", 1)
    kept = links.where((F.endswith(path, F.lit(suffix)) if suffix else F.lit(True)) & ~host.isin(*excluded_hosts, ""))
    return kept.groupBy("href").agg(F.min_by(F.struct(key, "category", "text"), F.struct(key, "ord")).alias("x")).select(f"x.{key}", "x.category", "x.text", "href")


