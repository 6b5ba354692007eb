"""Listings of project folders as a partitioned source: the executors list and read, one task for each place of a root.

``spark.read.format("project_listing").option("roots", json)`` gives the marker files of
the folders in the package directories and directly below each root.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from .. import catalog, schema
from ..session import ship
from .corpus import read_text

#: Files whose content decides something.
READ = ("package.json", "requirements.txt", "pyproject.toml")
#: All files that a listing has.
KNOWN = (*READ, "tsconfig.json", *(n for names in catalog.MARKERS.values() for n in names))


@dataclass
class Place(InputPartition):
    """A directory of a root whose folders are listed: one for packages, or the root itself ('')."""

    root: str
    parent: str


class ListingReader(DataSourceReader):
    """Filters on ``root``, ``parent`` and ``name`` are taken over: places and files that don't pass aren't touched."""

    def __init__(self, roots: list[str], columns: list[str]):
        self.roots, self.columns = roots, columns
        self.only: dict[str, set[str]] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            values = [f.value] if isinstance(f, EqualTo) else list(f.value) if isinstance(f, In) else None
            column = f.attribute[0] if values is not None and len(f.attribute) == 1 else None
            if column in ("root", "parent", "name"):
                self.only[column] = self.only.get(column, set(values)) & set(values)
            else:
                yield f

    def passes(self, column: str, value: str) -> bool:
        return column not in self.only or value in self.only[column]

    def partitions(self) -> list[Place]:
        # a place that isn't there gives no rows; whether it is there is seen by its task
        return [Place(r, p) for r in self.roots if self.passes("root", r) for p in (*catalog.PACKAGE_DIRS, "") if self.passes("parent", p)]

    def read(self, partition: Place | None) -> Iterator[tuple]:
        if partition is None:  # no place passes
            return
        top = Path(partition.root, partition.parent)
        if not top.is_dir():
            return
        for folder in sorted(top.iterdir()):
            if folder.name.startswith(".") or not folder.is_dir():
                continue
            below = f"{partition.parent}/{folder.name}" if partition.parent else folder.name
            for name in sorted({*KNOWN}):
                at = folder / name
                if self.passes("name", name) and at.exists():
                    yield partition.root, partition.parent, below, name, at.is_dir(), read_text(at) if name in READ else None


class ListingSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "project_listing"

    def schema(self) -> str:
        return schema.LISTING

    def reader(self, schema) -> ListingReader:
        return ListingReader(json.loads(self.options["roots"]), schema.fieldNames())


def project_listing(spark: SparkSession, *roots: str) -> DataFrame:
    """Marker files of the folders in the package directories and directly below each root.

    Hidden folders are left out. Files that can't be read or aren't UTF-8 have a null
    content. The roots must be where every executor sees them.
    """
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ListingSource)
    return spark.read.format("project_listing").option("roots", json.dumps(roots)).load()
