"""Web pages as items to scan."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from leakloom.session import ship_package
from leakloom.sources.extract import page_items


def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for page, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            found = page_items(html)
            yield pa.RecordBatch.from_arrays([pa.array([page] * len(found), pa.int64()), pa.array([s for s, _ in found], pa.string()), pa.array([c for _, c in found], pa.string())], ["page_id", "source", "content"])


def items_of(pages: DataFrame) -> DataFrame:
    """(page_id, source, content) of pages (page_id, html)."""
    ship_package(pages.sparkSession)
    return pages.select("page_id", "html").mapInArrow(_items, "page_id long, source string, content string")
