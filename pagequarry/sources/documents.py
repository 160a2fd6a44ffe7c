"""Document files as a Spark data source: balanced partitions of files, pages read as asked, by an extractor that is given.

The extractor gets a document's bytes and a test of page numbers, and yields the pages that
pass it (page, width, height, lines, drawings); lines are (text, x0, y0, x1, y1), drawings
(x0, y0, x1, y1). Conditions on `page`, `path` and `kind` reach it: files and pages that can't match
are never opened or extracted. Files are dealt to partitions by size, the largest first.
A null or empty file yields nothing; one that the extractor fails on gives a row of kind
`error` with the reason as text, or fails the job.
"""

from __future__ import annotations

import fnmatch
import heapq
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

SCHEMA = "path string, kind string, page int, seq int, text string, x0 double, y0 double, x1 double, y1 double"
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
BYTES_A_PARTITION = 32 << 20
#: Bytes and which pages are wanted; (page, width, height, lines, drawings) of these.
Extractor = Callable[[bytes, Callable[[int], bool]], Iterable[tuple[int, float, float, list, list]]]


@dataclass
class _Wanted:
    """What is known of the rows that are asked for; everything, at first."""

    low: int = 1
    high: int = 1 << 31
    pages: frozenset[int] | None = None
    paths: frozenset[str] | None = None
    kinds: frozenset[str] | None = None

    def take(self, f: Filter) -> bool:
        """Narrows to a condition; whether it could."""
        name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
        values = frozenset(f.value if isinstance(f, In) else (f.value,)) if isinstance(f, (In, EqualTo)) else None
        also = lambda old: values if old is None else old & values
        if name in ("path", "kind") and values is not None:
            setattr(self, f"{name}s", also(getattr(self, f"{name}s")))
        elif name == "page" and values is not None:
            self.pages = also(self.pages)
        elif name == "page" and isinstance(f, (GreaterThan, GreaterThanOrEqual)):
            self.low = max(self.low, f.value + isinstance(f, GreaterThan))
        elif name == "page" and isinstance(f, (LessThan, LessThanOrEqual)):
            self.high = min(self.high, f.value - isinstance(f, LessThan))
        else:
            return False
        return True

    def has(self, page: int) -> bool:
        return self.low <= page <= self.high and (self.pages is None or page in self.pages)

    @property
    def any_page(self) -> bool:
        return self.low <= self.high and (self.pages is None or any(self.low <= p <= self.high for p in self.pages))


@dataclass
class Files(InputPartition):
    """Files of about the same bytes as any other partition, each with its range of pages."""

    files: list[tuple[str, int, int]] = field(default_factory=list)
    bytes: int = 0


def balanced(sizes: dict[str, int], each: int) -> list[list[str]]:
    """Files in as many groups as hold `each` bytes, the largest first, always to the smallest group."""
    n = max(1, min(len(sizes), -(-sum(sizes.values()) // each)))
    groups: list[list[str]] = [[] for _ in range(n)]
    heap = [(0, k) for k in range(n)]
    for path, size in sorted(sizes.items(), key=lambda x: (-x[1], x[0])):
        total, k = heapq.heappop(heap)
        groups[k].append(path)
        heapq.heappush(heap, (total + max(size, 1), k))
    return groups


class _Reader(DataSourceReader):
    def __init__(self, root: str, pattern: str, extract: Extractor, ranges: dict[str, tuple[int, int]] | None, each: int, keep_errors: bool):
        self.root, self.pattern, self.extract, self.ranges, self.each, self.keep_errors = root, pattern, extract, ranges, each, keep_errors
        self.wanted = _Wanted()

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if not self.wanted.take(f):
                yield f

    def partitions(self) -> list[Files]:
        system, top = fs.FileSystem.from_uri(self.root) if "://" in self.root else (fs.LocalFileSystem(), self.root)
        found = {i.path: i.size for i in system.get_file_info(fs.FileSelector(top, recursive=True)) if i.type == fs.FileType.File and fnmatch.fnmatch(i.base_name, self.pattern)}
        w = self.wanted
        found = {p: n for p, n in found.items() if w.any_page and (w.paths is None or p in w.paths) and (self.ranges is None or p in self.ranges)}
        if not found:
            return [Files()]
        of = lambda p: (p, *((self.ranges or {}).get(p) or (1, 1 << 31)))
        return [Files([of(p) for p in group], sum(found[p] for p in group)) for group in balanced(found, self.each)]

    def read(self, partition: Files) -> Iterator[tuple]:
        system = fs.FileSystem.from_uri(self.root)[0] if "://" in self.root else fs.LocalFileSystem()
        kind = lambda k: self.wanted.kinds is None or k in self.wanted.kinds
        for path, low, high in partition.files:
            with system.open_input_stream(path) as f:
                content = f.read()
            asked = lambda page, low=low, high=high: low <= page <= high and self.wanted.has(page)
            try:
                for page, width, height, lines, drawings in self.extract(content, asked) if content else ():
                    if not asked(page):
                        continue
                    if kind("page"):
                        yield (path, "page", page, 0, None, 0.0, 0.0, float(width), float(height))
                    texts = [(text.strip(), *box) for text, *box in lines if text.strip()] if kind("line") else []
                    yield from ((path, "line", page, k, text, *map(float, box)) for k, (text, *box) in enumerate(texts, 1))
                    boxes = [b for b in drawings if b[2] > b[0] and b[3] > b[1]] if kind("drawing") else []
                    yield from ((path, "drawing", page, k, None, *map(float, b)) for k, b in enumerate(boxes, 1))
            except Exception as e:
                if not self.keep_errors:
                    raise
                if kind("error"):
                    yield (path, "error", None, 0, f"{type(e).__name__}: {e}", None, None, None, None)


def documents(spark: SparkSession, root: str, extract: Extractor, pattern: str = "*.pdf", ranges: dict[str, tuple[int, int]] | None = None, bytes_a_partition: int = BYTES_A_PARTITION, keep_errors: bool = False) -> DataFrame:
    """Rows of all files below a folder: path, kind (page, line, drawing, error), page, seq, text and box; of a page the box is its size.

    `ranges` (path to first and last page) names the files to read and their pages, as setups do.
    The session must push filters to Python sources, which this sets.
    """

    class Documents(DataSource):
        @classmethod
        def name(cls) -> str:
            return "page_documents"

        def schema(self) -> str:
            return SCHEMA

        def reader(self, schema: StructType) -> _Reader:
            return _Reader(root, pattern, extract, ranges, bytes_a_partition, keep_errors)

    spark.conf.set(PUSHDOWN, "true")
    spark.dataSource.register(Documents)
    return spark.read.format("page_documents").load()


def setup_ranges(setups: DataFrame) -> dict[str, tuple[int, int]]:
    """path and pages of setups (pdf_path, page_range); no range is all pages. A setup is a file to read, so there are as many as files."""
    pages = F.split(F.trim("page_range"), r"\s*-\s*")
    rows = setups.select("pdf_path", F.get(pages, F.lit(0)).cast("int").alias("low"), F.coalesce(F.get(pages, F.lit(1)), F.get(pages, F.lit(0))).cast("int").alias("high"))
    return {r["pdf_path"]: (r["low"] or 1, r["high"] or 1 << 31) for r in rows.toLocalIterator()}


def layout(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pages, lines and drawings for plans.detector.detect; doc_id is a hash of the path."""
    every, box = rows.withColumn("doc_id", F.xxhash64("path")), ["x0", "y0", "x1", "y1"]
    of = lambda kind: every.where(F.col("kind") == kind)
    return of("page").select("doc_id", "page", F.col("x1").alias("width"), F.col("y1").alias("height")), of("line").select("doc_id", "page", F.col("seq").alias("line_seq"), "text", *box), of("drawing").select("doc_id", "page", F.col("seq").alias("draw_seq"), *box)
