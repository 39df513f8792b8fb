"""The edge to a recogniser: pages that have no result yet are given to a caller's function in batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

RESULT = "file_id bigint, page_index int, text string"


def recognize(work: DataFrame, done: DataFrame, model: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], force: bool = False, schema: str = RESULT) -> DataFrame:
    """The results of *model* for the pages of *work* that *done* lacks, or for all with *force*.

    The model is loaded once for each task, inside *model*.
    """
    todo = work if force else work.join(done.select("file_id", "page_index").distinct(), ["file_id", "page_index"], "left_anti")
    return todo.mapInPandas(model, schema)


def merged(results: DataFrame, retried: DataFrame) -> DataFrame:
    """Results with those of a later attempt in their place."""
    new = retried.select("file_id", "page_index")
    return results.join(new, ["file_id", "page_index"], "left_anti").unionByName(retried, allowMissingColumns=True)
