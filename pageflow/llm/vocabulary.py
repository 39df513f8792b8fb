"""Corpus vocabularies: word counts over all texts, and a trie of their prefixes as rows."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def count_words(df: DataFrame, columns: Sequence[str], words: Callable[..., list[str]]) -> DataFrame:
    """(word, n) over all rows; *words* gets a row's columns and gives its words.

    Each batch is counted before anything is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: Counter[str] = Counter()
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                counts.update(words(*row))
            if counts:
                yield pa.RecordBatch.from_arrays([pa.array(list(counts.keys()), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    return df.select(*columns).mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def trie_nodes(vocabulary: DataFrame) -> DataFrame:
    """(prefix, known, below): the nodes of the vocabulary's trie, whether each is a word, and the number of longer words below it."""
    nodes = vocabulary.select("word", F.explode(F.sequence(F.lit(1), F.length("word"))).alias("k")).select(F.expr("substring(word, 1, k)").alias("prefix"), (F.col("k") == F.length("word")).alias("whole"))
    return nodes.groupBy("prefix").agg(F.max("whole").alias("known"), F.count_if(~F.col("whole")).alias("below"))
