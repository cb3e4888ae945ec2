"""Indexed pages as a data source: what is asked of pages, paths and documents reaches the extraction.

The files are packed into ranges of the bytes of their listing, one task a range. Conditions on
the path or the document choose the files before any is opened; those on the page reach the extractor,
which parses the pages that are asked for only.
"""

from __future__ import annotations

import fnmatch
import posixpath
from collections.abc import Container, Iterator, Sequence

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, Not, StringContains, StringEndsWith, StringStartsWith
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions.stores import file_system
from .corpus import WORDS_TYPE
from .files import Extractor, pages_of

SCHEMA = f"path string, page int, words {WORDS_TYPE}, has_image boolean"
#: Bytes of files that one task reads, or one file that has more.
RANGE_BYTES = 64 << 20
#: Setting that lets conditions reach a data source in Python.
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"

_TESTS = {
    EqualTo: lambda v, x: v == x, In: lambda v, x: v in x, GreaterThan: lambda v, x: v > x, GreaterThanOrEqual: lambda v, x: v >= x, LessThan: lambda v, x: v < x, LessThanOrEqual: lambda v, x: v <= x,
    StringStartsWith: lambda v, x: v.startswith(x), StringEndsWith: lambda v, x: v.endswith(x), StringContains: lambda v, x: x in v,
}


class Condition:
    """A condition on one column, as Spark hands it over."""

    def __init__(self, wanted: Filter):
        self.negated = isinstance(wanted, Not)
        inner = wanted.child if self.negated else wanted
        self.known = isinstance(inner, IsNotNull) or type(inner) in _TESTS
        self.column = ".".join(inner.attribute) if self.known else None
        self.kind, self.value = type(inner), getattr(inner, "value", None)

    def holds(self, value: object) -> bool:
        """Whether it holds for a value that isn't null."""
        return self.negated != (self.kind is IsNotNull or _TESTS[self.kind](value, self.value))


class Pages(Container):
    """The page numbers for which all conditions hold."""

    def __init__(self, conditions: Sequence[Condition]):
        self.conditions = list(conditions)

    def __contains__(self, page: object) -> bool:
        return all(c.holds(page) for c in self.conditions)


class Files(InputPartition):
    def __init__(self, paths: list[str]):
        super().__init__(tuple(paths))


class PageReader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: StructType, extractor: Extractor, recognizer: Extractor | None):
        self.path, self.glob = options["path"], options.get("glob", "*")
        self.range_bytes = int(options.get("range_bytes", RANGE_BYTES))
        self.schema, self.extractor, self.recognizer = to_arrow_schema(schema), extractor, recognizer
        self.conditions: list[Condition] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for wanted in filters:
            c = Condition(wanted)
            if c.known and c.column in ("path", "page"):
                self.conditions.append(c)
            else:
                yield wanted

    def _on(self, column: str) -> list[Condition]:
        return [c for c in self.conditions if c.column == column]

    def files(self) -> list[tuple[str, int]]:
        """(path, bytes) of the files that the conditions on paths leave, by path."""
        fs, root = file_system(self.path)
        info = fs.get_file_info(root)
        prefix = self.path[: len(self.path) - len(root)] if self.path.endswith(root) else ""
        found = [info] if info.type == pafs.FileType.File else fs.get_file_info(pafs.FileSelector(root, recursive=True, allow_not_found=True))
        hidden = lambda p: any(part[:1] in "._" for part in p[len(root) :].split("/") if part)
        named = [(prefix + f.path, f.size or 0) for f in found if f.type == pafs.FileType.File and not hidden(f.path) and fnmatch.fnmatch(posixpath.basename(f.path), self.glob)]
        return sorted(x for x in named if all(c.holds(x[0]) for c in self._on("path")))

    def partitions(self) -> list[InputPartition]:
        packs: list[list[str]] = []
        room = 0
        for path, size in self.files():
            if not packs or size > room:
                packs.append([])
                room = self.range_bytes
            packs[-1].append(path)
            room -= size
        return [Files(p) for p in packs] or [Files([])]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        wanted = Pages(self._on("page"))
        for path in partition.value:
            fs, place = file_system(path)
            with fs.open_input_stream(place) as source:
                content = source.read()
            rows = []
            for n, words, image in pages_of(content, self.extractor, wanted if wanted.conditions else None, self.recognizer):
                if n in wanted:
                    rows.append({"path": path, "page": n, "words": words, "has_image": image})
            if rows:
                yield from pa.Table.from_pylist(rows, self.schema).to_batches()


def source(extractor: Extractor, recognizer: Extractor | None = None, name: str = "indexed_pages") -> type[DataSource]:
    """The data source of an extractor, to be registered. Options: path, glob, range_bytes."""

    class IndexedPages(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return SCHEMA

        def reader(self, schema: StructType) -> PageReader:
            return PageReader(dict(self.options), schema, extractor, recognizer)

    return IndexedPages


def read_pages(spark: SparkSession, path: str, extractor: Extractor, recognizer: Extractor | None = None, glob: str = "*", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(path, page, words, has_image) of the files under a path. Conditions on path and page that follow are applied before anything is parsed.

    Hidden files are left out; a folder that isn't there, or is empty, gives no rows.
    """
    spark.conf.set(PUSHDOWN, "true")
    spark.dataSource.register(source(extractor, recognizer))
    return spark.read.format("indexed_pages").option("glob", glob).option("range_bytes", str(range_bytes)).load(path)
