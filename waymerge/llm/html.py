"""Main text of web pages by a tree-structured graphical model of their elements."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices
from .html_examples import examples
from .html_tree import Page, TreeModel, fit


def extract(pages: DataFrame, model: TreeModel | None = None, labelled: int = 80) -> DataFrame:
    """Per row: page_id, url, text, n_chars.

    Each page becomes a tree of block elements. Two labels per element, main text or not, depend on its kind, its names, its text and
    links, and on its parent's label; sum-product gives each element's probability of being main text, and the blocks of those
    that reach one half are joined by line breaks. Without a ``model``, one is fitted on ``labelled`` built-in labelled pages.
    Null, empty and broken html give what text there is, possibly none. Each row stands for itself: null or repeated page_ids are carried along,
    other columns are not read, an empty table gives an empty result.
    """
    model = model or fit(examples(labelled))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            texts = [model.text(Page(h)) if h else "" for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.selectExpr("cast(page_id as bigint) page_id", "url", "html").mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")
