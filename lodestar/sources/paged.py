"""A paged JSON API as a Spark data source, with predicate push-down to the request."""

from __future__ import annotations

import json
from collections.abc import Iterator
from pathlib import Path
from urllib.parse import urlencode
from urllib.request import urlopen

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition

from lodestar.operators.records import latest_per_key

#: Pages that are asked at most. Fixed value.
MOST_PAGES = 100


class _Page(InputPartition):
    def __init__(self, number: int):
        self.number = number


class _PagedReader(DataSourceReader):
    def __init__(self, options: dict, fields: list[str]):
        self.options, self.fields, self.params = options, fields, {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Equalities on named parameters go into the request; the rest stays with Spark."""
        named = set((self.options.get("parameters") or "").split(","))
        for f in filters:
            if isinstance(f, EqualTo) and len(f.attribute) == 1 and f.attribute[0] in named:
                self.params[f.attribute[0]] = f.value
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        return [_Page(n) for n in range(int(self.options.get("pages", MOST_PAGES)))]

    def read(self, partition: _Page) -> Iterator[tuple]:
        template = self.options["path"].replace("{page}", str(partition.number))
        if template.startswith(("http://", "https://")):
            with urlopen(f"{template}{'&' if '?' in template else '?'}{urlencode(self.params)}" if self.params else template, timeout=float(self.options.get("timeout", 20))) as answer:
                body = answer.read().decode("utf-8-sig")
        else:
            file = Path(template)
            if not file.exists():
                return
            body = file.read_text("utf-8-sig")
        rows = json.loads(body)
        if not isinstance(rows, list):
            raise ValueError(f"page {partition.number} is no list")
        for pos, row in enumerate(rows):
            if isinstance(row, dict) and all(str(row.get(k)) == str(v) for k, v in self.params.items()):
                yield (partition.number, pos, str(row.get("id", "")), json.dumps(row, ensure_ascii=False), *(None if row.get(f) is None else str(row.get(f)) for f in self.fields))


class PagedSource(DataSource):
    """``spark.read.format("paged")``: options ``path`` (with ``{page}``), ``pages``, ``fields`` (columns beside the raw record), ``parameters`` (fields the API filters by)."""

    @classmethod
    def name(cls) -> str:
        return "paged"

    def _fields(self) -> list[str]:
        return [f for f in (self.options.get("fields") or "").split(",") if f]

    def schema(self) -> str:
        return ", ".join(["page int", "pos int", "id string", "record string", *(f"{f} string" for f in self._fields())])

    def reader(self, schema) -> DataSourceReader:
        return _PagedReader(dict(self.options), self._fields())


def read_paged(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """Records of all pages, of a repeated id the first one, like a client that stops at pages without new ids."""
    spark.dataSource.register(PagedSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    rows = spark.read.format("paged").options(path=path, **options).load()
    first = [(-F.col("page")), (-F.col("pos"))]
    return latest_per_key(rows.where(F.col("id") != ""), ["id"], first, rows.columns)
