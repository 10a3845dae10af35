"""Tables read and written by pages of typed cells, as a remote service gives them: keyset paging, retries, whole commits.

A service is any object that can be pickled and has ``parts`` and ``page`` (see ``FilePages``); ``read_pages`` reads it as a
DataFrame, a task per part, and ``write_pages`` stores a DataFrame as pages below a folder that all executors share.
"""

from __future__ import annotations

import json
import time
import uuid
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage,
)
from pyspark.sql.pandas.types import to_arrow_schema

#: Rows in a page, tries for a page, and seconds before the second try (doubled for each further one).
PAGE_ROWS, TRIES, WAIT = 1000, 4, 0.2


@dataclass(frozen=True)
class Bounds:
    """Keys from ``low`` (beyond it if ``beyond``) to ``high``; None is open."""

    low: Any = None
    beyond: bool = False
    high: Any = None

    def meets(self, first, last) -> bool:
        above = self.low is None or (last > self.low if self.beyond else last >= self.low)
        return above and (self.high is None or first <= self.high)

    def after(self, key) -> Bounds:
        return Bounds(key, True, self.high)

    def narrowed(self, low=None, beyond: bool = False, high=None) -> Bounds:
        here = self
        if low is not None and (here.low is None or (low, beyond) > (here.low, here.beyond)):
            here = Bounds(low, beyond, here.high)
        return Bounds(here.low, here.beyond, high) if high is not None and (here.high is None or high < here.high) else here


def encode_cell(value) -> dict:
    if value is None:
        return {"type": "null"}
    if isinstance(value, bool) or not isinstance(value, (int, float, str)):
        raise TypeError(f"no cell type for {type(value).__name__}; cast the column first")
    return {"type": {int: "integer", float: "float", str: "text"}[type(value)], "value": value if isinstance(value, str) else repr(value)}


def decode_cell(cell: dict):
    kind = cell["type"]
    return None if kind == "null" else {"integer": int, "float": float, "text": str}[kind](cell["value"])


def retried(call: Callable, tries: int, wait: float):
    """``call()``, again after failures of the connection, each time later; the last failure is the task's."""
    for n in range(tries):
        try:
            return call()
        except (OSError, TimeoutError):
            if n + 1 == tries:
                raise
            time.sleep(wait * 2**n)


class FilePages:
    """Pages in a folder.  Each task writes pages and one index of them; a commit writes a manifest that names the indexes.

    What no manifest names does not exist: pages of failed attempts and of aborted jobs are never read.  A commit that is
    repeated changes nothing.
    """

    def __init__(self, path: str):
        self.path = path.rstrip("/")
        self._indexes: dict[str, list] = {}

    def __getstate__(self):
        return {"path": self.path, "_indexes": {}}

    def _at(self, name: str):
        system, root = fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)
        return system, f"{root}/{name}" if name else root

    def _read(self, name: str):
        system, at = self._at(name)
        with system.open_input_stream(at) as stream:
            return json.loads(stream.read())

    def write(self, name: str, content) -> None:
        """A file that is there whole or not at all."""
        system, at = self._at(name)
        system.create_dir(self._at("")[1], recursive=True)
        hidden = f"{at}.{uuid.uuid4().hex}.part"
        with system.open_output_stream(hidden) as stream:
            stream.write(json.dumps(content).encode())
        system.move(hidden, at)

    def manifest(self) -> dict:
        """The last commit's: ``version``, ``commits``, and ``parts`` with their first and last key."""
        system, root = self._at("")
        names = [f.base_name for f in system.get_file_info(fs.FileSelector(root, allow_not_found=True)) if f.base_name.startswith("manifest-") and f.base_name.endswith(".json")]
        return self._read(max(names)) if names else {"version": 0, "commits": [], "parts": []}

    def commit(self, commit: str, parts: list, overwrite: bool) -> None:
        old = self.manifest()
        if commit in old["commits"]:
            return
        kept = {"commits": [], "parts": []} if overwrite else old
        version = old["version"] + 1
        self.write(f"manifest-{version:020d}.json", {"version": version, "commits": [*kept["commits"], commit], "parts": [*kept["parts"], *parts]})

    def parts(self) -> list[tuple[str, Any, Any]]:
        """Name, first and last key of each part; a task reads one."""
        return [tuple(p) for p in self.manifest()["parts"]]

    def page(self, part: str, bounds: Bounds, limit: int) -> dict:
        """``cols``, ``rows`` in order of key, at most ``limit``, the first ones in ``bounds``; ``more`` if some may follow."""
        if part not in self._indexes:
            self._indexes[part] = self._read(part)
        index = self._indexes[part]
        lasts = [p["last"] for p in index["pages"]]
        n = 0 if bounds.low is None else (bisect_right if bounds.beyond else bisect_left)(lasts, bounds.low)
        if n == len(lasts) or not bounds.meets(index["pages"][n]["first"], lasts[n]):
            return {"cols": index["cols"], "rows": [], "more": False}
        rows = self._read(index["pages"][n]["file"])
        keys = [decode_cell(r[index["key"]]) for r in rows]
        begin = 0 if bounds.low is None else (bisect_right if bounds.beyond else bisect_left)(keys, bounds.low)
        end = min(begin + limit, len(keys) if bounds.high is None else bisect_right(keys, bounds.high))
        return {"cols": index["cols"], "rows": rows[begin:end], "more": end < len(keys) or n + 1 < len(lasts)}


class _Part(InputPartition):
    def __init__(self, part: str):
        self.part = part


class PagedReader(DataSourceReader):
    """One task per part whose keys the filters can meet; pages follow each other by the last key read."""

    def __init__(self, service, schema: T.StructType, key: str, page_rows: int, tries: int, wait: float):
        self.service, self.schema, self.key, self.page_rows, self.tries, self.wait = service, schema, key, page_rows, tries, wait
        self.bounds = Bounds()

    def pushFilters(self, filters):
        """Comparisons of the key narrow what is asked for.  Spark applies all filters again, so none is lost."""
        for f in filters:
            if getattr(f, "attribute", None) != (self.key,) or getattr(f, "value", None) is None:
                continue
            if isinstance(f, (EqualTo, EqualNullSafe)):
                self.bounds = self.bounds.narrowed(low=f.value, high=f.value)
            elif isinstance(f, In):
                known = [v for v in f.value if v is not None]
                if known:
                    self.bounds = self.bounds.narrowed(low=min(known), high=max(known))
            elif isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                self.bounds = self.bounds.narrowed(low=f.value, beyond=isinstance(f, GreaterThan))
            elif isinstance(f, (LessThan, LessThanOrEqual)):
                self.bounds = self.bounds.narrowed(high=f.value)
        return filters

    def partitions(self):
        parts = retried(self.service.parts, self.tries, self.wait)
        # Spark wants one partition at least.
        return [_Part(name) for name, first, last in parts if self.bounds.meets(first, last)] or [_Part("")]

    def read(self, partition) -> Iterator[pa.RecordBatch]:
        if not partition.part:
            return
        bounds, more = self.bounds, True
        schema = to_arrow_schema(self.schema)
        while more:
            reply = retried(lambda: self.service.page(partition.part, bounds, self.page_rows), self.tries, self.wait)  # noqa: B023
            rows, more = reply["rows"], reply["more"]
            if not rows:
                # A service that says more may follow and gives nothing would be asked for the same page for ever.
                return
            at = {name: i for i, name in enumerate(reply["cols"])}
            columns = {f.name: [decode_cell(r[at[f.name]]) for r in rows] if f.name in at else [None] * len(rows) for f in self.schema.fields}
            yield pa.RecordBatch.from_pydict(columns, schema=schema)
            bounds = bounds.after(columns[self.key][-1])


@dataclass
class _Written(WriterCommitMessage):
    part: str = ""
    first: Any = None
    last: Any = None


class PagedWriter(DataSourceArrowWriter):
    """Pages of a task's rows, which come in order of key, under names of the attempt's own; the driver gets one line a task."""

    def __init__(self, pages: FilePages, key: str, page_rows: int, overwrite: bool):
        self.pages, self.key, self.page_rows, self.overwrite = pages, key, page_rows, overwrite
        self.commit_id = uuid.uuid4().hex

    def write(self, iterator) -> _Written:
        attempt, pages, cols, held, last = uuid.uuid4().hex, [], None, [], None

        def put(rows):
            at = cols.index(self.key)
            name = f"page-{attempt}-{len(pages):08d}.json"
            self.pages.write(name, [[encode_cell(v) for v in r] for r in rows])
            pages.append({"first": rows[0][at], "last": rows[-1][at], "file": name})

        for batch in iterator:
            cols = batch.schema.names
            at = cols.index(self.key)
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[at] is None or (last is not None and row[at] <= last):
                    raise ValueError(f"{self.key} must be unique and not null: {row[at]!r} after {last!r}")
                last = row[at]
                held.append(row)
                if len(held) == self.page_rows:
                    put(held)
                    held = []
        if held:
            put(held)
        if not pages:
            return _Written()
        part = f"index-{attempt}.json"
        self.pages.write(part, {"cols": cols, "key": cols.index(self.key), "pages": pages})
        return _Written(part, pages[0]["first"], pages[-1]["last"])

    def commit(self, messages) -> None:
        found = sorted((m for m in messages if m is not None and m.part), key=lambda m: m.first)
        self.pages.commit(self.commit_id, [[m.part, m.first, m.last] for m in found], self.overwrite)

    def abort(self, messages) -> None:
        """Nothing to undo: what was written is named by no manifest."""


def paged_source(service, schema: T.StructType, key: str, page_rows: int = PAGE_ROWS, tries: int = TRIES, wait: float = WAIT) -> type[DataSource]:
    """A data source over ``service``, to be registered; its name is new each time."""
    label = f"lumenfold_pages_{uuid.uuid4().hex}"

    class Paged(DataSource):
        @classmethod
        def name(cls) -> str:
            return label

        def schema(self) -> T.StructType:
            return schema

        def reader(self, schema: T.StructType) -> PagedReader:
            return PagedReader(service, schema, key, page_rows, tries, wait)

        def writer(self, schema: T.StructType, overwrite: bool) -> PagedWriter:
            return PagedWriter(service, key, page_rows, overwrite)

    return Paged


def _registered(spark: SparkSession, *args, **options):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    source = paged_source(*args, **options)
    spark.dataSource.register(source)
    return source.name()


def read_pages(spark: SparkSession, service, schema: T.StructType | str, key: str, page_rows: int = PAGE_ROWS, tries: int = TRIES, wait: float = WAIT) -> DataFrame:
    """The rows of ``service``, with ``schema`` (numbers and strings; columns it has not are null).

    ``key`` must be unique and not null in each part, as pages follow each other by it.  A task that is run again reads its
    own part again from the start, so no row comes twice.  Comparisons of the key reach the service.  No part gives no rows.
    """
    schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    return spark.read.format(_registered(spark, service, schema, key, page_rows, tries, wait)).load()


def write_pages(df: DataFrame, path: str, key: str, mode: str = "append", page_rows: int = PAGE_ROWS) -> FilePages:
    """Stores ``df`` as pages below ``path``, in ranges of ``key``; null and repeated keys fail the write, which then changes nothing.

    ``mode`` is ``append`` (the new rows beside the old ones, keys are not compared with theirs) or ``overwrite``.
    """
    pages = FilePages(path)
    ordered = df.repartitionByRange(key).sortWithinPartitions(key)
    ordered.write.format(_registered(df.sparkSession, pages, df.schema, key, page_rows)).mode(mode).save()
    return pages
